"""Connected components of a graph of links, as joins and aggregations of the links.

Each round replaces the links by links to smaller ids: every node passes its smallest neighbour
to its larger ones, then to its smaller ones. Rounds shrink every component to a star, in a
number of rounds that grows with the logarithm of its width. The links of each round are a
table in the shared folder, so lineage stays short. A hub with very many links is only a hot
key of aggregations, which combine before the shuffle, and of joins, which adaptive execution
splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def _smallest(links: DataFrame, key: str, other: str) -> DataFrame:
    """(k, m): each key with the smaller of itself and its smallest other end."""
    return links.groupBy(F.col(key).alias("k")).agg(F.min(other).alias("m")).select("k", F.least("k", "m").alias("m"))


def _ordered(links: DataFrame) -> DataFrame:
    return links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _round(links: DataFrame) -> DataFrame:
    # Larger neighbours b of a node a get the smallest neighbour of a, or a.
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    large = _ordered(links.join(_smallest(both, "a", "b"), F.col("a") == F.col("k")).select(F.col("m").alias("a"), "b"))
    # Smaller neighbours a of a node b, and b, get the smallest of them.
    low = _smallest(large, "b", "a")
    small = large.join(low, F.col("b") == F.col("k")).select(F.col("m").alias("c"), "a", "b")
    return _ordered(small.select(F.col("c").alias("a"), F.explode(F.array("a", "b")).alias("b")))


def _are_stars(links: DataFrame) -> bool:
    """Whether every node is either a centre or the end of one link."""
    ends = links.select(F.col("b").alias("node"), F.lit(1).alias("n")).unionByName(
        links.select(F.col("a").alias("node"), F.lit(0).alias("n")).distinct()
    )
    roles = ends.groupBy("node").agg(F.sum("n").alias("ends"), F.count("*").alias("roles"))
    return roles.filter("ends > 1 or roles > ends and ends > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b); component: its smallest node.

    Null ends and links of a node to itself are ignored; repeated links count once. No links
    give no rows.
    """
    links = materialise(_ordered(links), "links")
    while not _are_stars(links):
        links = materialise(_round(links), "links")
    ends = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return ends.unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
