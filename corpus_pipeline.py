"""A training-data pipeline over `documents`, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is
written as Parquet and read again as the next one's docs. All but the last return the columns
they were given. The operators state what they do with nulls, empty and long texts, ties,
repeated rows and empty tables; a stage adds what is said in its docstring.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flatloom.llm.decontaminate import contamination
from flatloom.llm.joins import send_if_few
from flatloom.llm.kd_shards import kd_shards
from flatloom.llm.mixing import bounded_cells, sampled, with_cell
from flatloom.llm.near_dedup import near_duplicates
from flatloom.llm.quality import learn, quality_score
from flatloom.llm.queries import KEEP, remainder
from flatloom.queries.registry import table
from flatloom.session import materialise

log = logging.getLogger(__name__)

#: Bytes of a shard.
SHARD_BYTES = 16 << 20
#: Percent of shingles of five words from which documents are near copies, and the probability
#: with which banding may miss such a pair.
NEAR_PERCENT, NEAR_MISS = 80, 1e-6


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.3 or more; labels of held-out documents are not learned from."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(remainder() != 0)
    return docs.filter(quality_score(learn(docs, labels), F.col("text")) >= KEEP)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`docs` with those of its columns renamed that have one of the names, and what gives a result
    the columns of `docs` back."""
    taken, now = {c.lower() for c in docs.columns} | {n.lower() for n in names}, {}
    for c in docs.columns:
        now[c] = c
        if c.lower() in names:
            while now[c].lower() in taken:
                now[c] = f"_{now[c]}"
            taken.add(now[c].lower())
    moved = docs.withColumnsRenamed({c: n for c, n in now.items() if n != c})
    return moved, lambda out: out.select(*[F.col(_quoted(n)).alias(c) for c, n in now.items()])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (a similarity of 0.8 or more links), the one with
    the smallest id; of rows that repeat an id, the one with the smallest text, null last, and of
    equal texts the one whose JSON form is smallest. Rows without an id stay."""
    found = near_duplicates(docs, percent=NEAR_PERCENT, miss=NEAR_MISS)
    docs, back = _aside(docs, ("gone_id", "again_id"))
    gone = materialise(found.filter("not kept").select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    again = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("again_id"))
    again = materialise(again, "again")
    left = docs.join(send_if_few(gone), F.col("doc_id") == F.col("gone_id"), "left_anti")
    repeated = F.col("doc_id") == F.col("again_id")
    row = F.struct(*[_quoted(c) for c in docs.columns])
    rank = F.struct(F.col("text").isNull(), F.col("text"), F.to_json(row))
    first = left.join(send_if_few(again), repeated, "left_semi").groupBy("doc_id").agg(F.min_by(row, rank).alias("first_row")).select("first_row.*")
    return back(left.join(send_if_few(again), repeated, "left_anti").unionByName(first))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    docs, back = _aside(docs, ("contamination",))
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return back(found.filter("contamination.n_hit = 0"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample of the budget that meets the tempered shares of sources, languages and topics,
    calibrated with the bound; targets no sample of that size meets are logged."""
    docs, back = _aside(docs, ("mix_cell", "mix_rate_cell", "mix_probability", "mix_sampled"))
    marked = with_cell(docs)
    cells, missed = bounded_cells(marked.select("mix_cell.*"))
    for dimension, value, target, reached in missed:
        log.warning("mixing: %s %r: target %.4f, reached %.4f", dimension, value, target, reached)
    return back(sampled(marked, cells).filter("mix_sampled"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of each document and its place there."""
    return kd_shards(docs, shard_bytes=SHARD_BYTES)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix),
    ("k-d tree sharding", shard),
]

#: A learned classifier has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
