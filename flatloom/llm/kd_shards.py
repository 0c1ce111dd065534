"""K-d tree partitioning of documents into shards of equal bytes.

Equal texts are one unit, so copies stay together; a unit of more than half a shard is taken
document by document instead. A unit is a point in the metadata dimensions size, source,
language and id (of its first document). Starting from all units, a node that is to become
several shards is split along the dimension in which it is widest, at the weighted median: the
point that gives each side its share of the bytes. Splitting ends when a leaf is one shard.

The median is found without sorting: sums by interval of the dimension, then again within the
interval that holds it, until few enough units are left to be looked at one by one. Each step
is one aggregation over a narrow table; all nodes of a level go on together. What comes to the
driver are at most `SUMS` sums or units a step, or 16 a node if that is more.

Heavy units, of which a node has at most twenty, are placed first, each on the side that
still lacks more; the median of the others then makes up the difference. So one large group of
copies does not upset the balance.

Edge cases: a null text has size 1 and CRC 0; null metadata are the smallest value; rows that
repeat an id or text are units like others; ties in a dimension go by a hash of the unit. A
table with fewer units than shards leaves shards empty. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialise

#: Sums and units a step brings to the driver.
SUMS = 1 << 14
#: A unit of this share of its node is heavy.
HEAVY = 0.05
#: A group of copies up to this share of a shard is one unit.
WHOLE = 0.5
#: Rows that are numbered by one task.
SLOT_ROWS = 200_000

DIMENSIONS = ("by_size", "by_source", "by_lang", "by_id")
_LAST = (1 << 63) - 1
#: A unit's value in the dimension its node is split along.
_VALUE_SQL = f"element_at(array({', '.join(DIMENSIONS)}), dimension + 1)"


#: The bits of monotonically_increasing_id that count the rows of a partition.
_ROW_BITS = 33


def _codes(rows: DataFrame, column: str) -> DataFrame:
    """(value, code): the whole values of a text column, numbered from 1 in their order.

    Distinct values are sorted in ranges, each range by one task; a row per range carries the counts.
    """
    values = rows.select(F.col(column).alias("value")).filter("value is not null").distinct()
    values = values.repartitionByRange("value").sortWithinPartitions("value").withColumn("place", F.monotonically_increasing_id())
    values = materialise(values, "kd-values").withColumn("span", F.shiftright("place", _ROW_BITS))
    earlier = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = values.groupBy("span").agg(F.count("*").alias("n")).select("span", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    code = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    return materialise(values.join(F.broadcast(spans), "span").select("value", code.alias("code")), "kd-codes")


@dataclass
class Node:
    """A part of the units that is to become the shards `first` to `first + shards - 1`."""

    key: int
    first: int
    shards: int
    weight: int = 0
    dimension: int = -1
    goal: float = 0.0
    below: float = 0.0
    #: What is still searched for the median: values, and hashes where there is one value.
    span: tuple[int, int, int, int] = (0, 0, -_LAST - 1, _LAST)
    #: The last (value, hash) of the left side.
    cut: tuple[int, int] = (-_LAST - 1, -_LAST - 1)


def _rows(documents: DataFrame) -> DataFrame:
    """The metadata of each document, with a key of its text in two numbers."""
    text = F.col("text").cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    half = lambda i: F.conv(F.substring("digest", i, 15), 16, 10).cast("bigint")
    numeric = documents.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    rows = documents.select(
        "doc_id",
        size.alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
        digest.alias("digest"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.col("doc_id").cast("bigint" if numeric else "string").alias("number"),
    )
    for column in ("source", "lang") if numeric else ("source", "lang", "number"):
        codes = broadcast_if_small(_codes(rows, column))
        rows = rows.join(codes, F.col(column) == F.col("value"), "left").withColumn(column, F.col("code")).drop("value", "code")
    values = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("source", "lang", "number")]
    return rows.select("doc_id", "size", "text_crc32", *values, half(1).alias("k1"), half(16).alias("k2"))


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("k1", "k2").agg(
        F.sum("size").alias("weight"),
        F.max("size").alias("by_size"),
        F.min("source").alias("by_source"),
        F.min("lang").alias("by_lang"),
        F.min("number").alias("by_id"),
    )


def kd_shards(documents: DataFrame, shard_bytes: int | None = None, shards: int | None = None) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard and slot.

    Either the bytes a shard should have or the number of shards is given. Sizes are UTF-8 bytes
    plus one. Slots number the rows of a shard from 0 without gaps.
    """
    rows = materialise(_rows(documents), "kd-rows")
    total = rows.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
    if not total.n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    shards = shards or max(1, round(total.size / shard_bytes))

    groups = materialise(_grouped(rows), "kd-groups")
    # Groups over half a shard: at most two a shard.
    large = groups.filter((F.col("weight") > WHOLE * total.size / shards) & (F.col("weight") > F.col("by_size"))).select("k1", "k2")
    large = large.withColumn("large", F.lit(True))
    alone = F.when(F.col("large"), F.xxhash64("k2", "doc_id")).otherwise(F.col("k2"))
    rows = rows.join(F.broadcast(large), ["k1", "k2"], "left").withColumn("k2", alone)
    units = groups.join(F.broadcast(large), ["k1", "k2"], "left_anti").unionByName(_grouped(rows.filter("large")))
    units = materialise(units.withColumn("tie", F.xxhash64("k1", "k2")).withColumn("node", F.lit(0).cast("bigint")), "kd-units")
    level = [Node(0, 0, shards)]
    while any(n.shards > 1 for n in level):
        units, level = _split(units, level)
        units = materialise(units, "kd-units")
    shard = _table(units, [Row(node=n.key, shard=n.first) for n in level], "node bigint, shard int")
    placed = units.select("k1", "k2", "node").join(shard, "node").select("k1", "k2", "shard")
    return number_slots(rows.join(placed, ["k1", "k2"]).select("doc_id", "size", "text_crc32", "shard"))


def _table(like: DataFrame, rows: list[Row], columns: str) -> DataFrame:
    """A small table, at most a row for each shard or heavy unit, for every executor."""
    return F.broadcast(like.sparkSession.createDataFrame(rows, columns))


def _split(units: DataFrame, level: list[Node]) -> tuple[DataFrame, list[Node]]:
    """Split every node of several shards in two."""
    ends = [f(d) for d in DIMENSIONS for f in (F.min, F.max)]
    stats = {r[0]: r for r in units.groupBy("node").agg(F.sum("weight"), *ends).collect()}
    width = lambda r, i: r[3 + 2 * i] - r[2 + 2 * i]
    whole = [max(r[3 + 2 * i] for r in stats.values()) - min(r[2 + 2 * i] for r in stats.values()) for i in range(len(DIMENSIONS))]
    active = {n.key: n for n in level if n.shards > 1 and n.key in stats}
    for key, n in active.items():
        r = stats[key]
        n.weight = r[1]
        # Width: the node's share of what the whole table spans.
        n.dimension = max(range(len(DIMENSIONS)), key=lambda i: width(r, i) / max(whole[i], 1))
        n.span = (r[2 + 2 * n.dimension], r[3 + 2 * n.dimension], -_LAST - 1, _LAST)
    limits = [Row(at=n.key, dimension=n.dimension, heavy=HEAVY * n.weight) for n in active.values()]
    limits = _table(units, limits, "at bigint, dimension int, heavy double")
    heavy = units.join(limits, (F.col("node") == F.col("at")) & (F.col("weight") >= F.col("heavy")))
    heavy = heavy.select("node", F.expr(_VALUE_SQL).alias("v"), "tie", "k1", "k2", "weight").collect()
    sides = []
    for key, n in active.items():
        lacking = [n.weight * (n.shards // 2) / n.shards, n.weight * (n.shards - n.shards // 2) / n.shards]
        # Largest first, to the side that lacks more; ties go by the order of the dimension.
        for r in sorted((r for r in heavy if r.node == key), key=lambda r: (-r.weight, r.v, r.tie)):
            side = 0 if lacking[0] >= lacking[1] else 1
            lacking[side] -= r.weight
            sides.append(Row(k1=r.k1, k2=r.k2, side=side))
        n.goal = max(0.0, min(lacking[0], sum(lacking)))
    _medians(units, active)

    cuts = [Row(node=n.key, dimension=n.dimension, cut_v=n.cut[0], cut_tie=n.cut[1]) for n in active.values()]
    cuts = _table(units, cuts, "node bigint, dimension int, cut_v bigint, cut_tie bigint")
    work = units.join(cuts, "node", "left").join(_table(units, sides, "k1 bigint, k2 bigint, side int"), ["k1", "k2"], "left")
    work = work.withColumn("v", F.expr(_VALUE_SQL))
    right = F.expr("coalesce(side, if(cut_v is null or v < cut_v or v = cut_v and tie <= cut_tie, 0, 1))")
    out = work.withColumn("node", F.col("node") * 2 + 1 + right).select(*units.columns)
    children = []
    for n in level:
        half = n.shards // 2 if n.shards > 1 else n.shards
        children.append(Node(2 * n.key + 1, n.first, half))
        if n.shards > 1:
            children.append(Node(2 * n.key + 2, n.first + half, n.shards - half))
    return out, children


def _inside(units: DataFrame, nodes: dict[int, Node]) -> DataFrame:
    """Light units of these nodes that lie in what is still searched: with v and the span."""
    spans = [
        Row(at=k, dimension=n.dimension, heavy=HEAVY * n.weight, v0=n.span[0], v1=n.span[1], t0=n.span[2], t1=n.span[3]) for k, n in nodes.items()
    ]
    spans = _table(units, spans, "at bigint, dimension int, heavy double, v0 bigint, v1 bigint, t0 bigint, t1 bigint")
    same = F.expr(f"node = at and weight < heavy and {_VALUE_SQL} between v0 and v1 and tie between t0 and t1")
    return units.join(spans, same).withColumn("v", F.expr(_VALUE_SQL))


def _medians(units: DataFrame, nodes: dict[int, Node]) -> None:
    """Set each node's cut."""
    todo = dict(nodes)
    fine = max(16, SUMS // max(1, len(nodes)))
    while todo:
        # Intervals of values, or of hashes where one value is left. Doubles only choose the
        # interval: they keep the order, and the ends of an interval are exact.
        wide = "cast({} as double) - cast({} as double)"
        by_value = f"({wide.format('v', 'v0')}) / ({wide.format('v1', 'v0')})"
        by_tie = f"({wide.format('tie', 't0')}) / greatest(1, {wide.format('t1', 't0')})"
        inside = _inside(units, todo)
        bucket = F.expr(f"floor({fine - 1} * if(v1 > v0, {by_value}, {by_tie}))")
        found = inside.groupBy("node", bucket.alias("bucket")).agg(
            F.sum("weight").alias("w"), F.count("*").alias("n"), F.min("v").alias("v0"), F.max("v").alias("v1"), F.min("tie").alias("t0"), F.max("tie").alias("t1")
        )
        by_node: dict[int, list[Row]] = {}
        for r in found.collect():
            by_node.setdefault(r.node, []).append(r)
        few = {}
        for key, n in list(todo.items()):
            hit = None
            for r in sorted(by_node.get(key, []), key=lambda r: r.bucket):
                if n.below + r.w > n.goal:
                    hit = r
                    break
                n.below += r.w
                n.cut = (r.v1, r.t1 if r.v0 == r.v1 else _LAST)
            if hit is None:
                del todo[key]
                continue
            same = hit.v0 == hit.v1
            n.span = (hit.v0, hit.v1, hit.t0 if same else -_LAST - 1, hit.t1 if same else _LAST)
            if hit.n <= fine or same and hit.t0 == hit.t1:
                few[key] = n
                del todo[key]
        if few:
            # Equal (value, hash) pairs are one unit, or copies of a row: they are not parted.
            near = _inside(units, few).groupBy("node", "v", "tie").agg(F.sum("weight").alias("w")).collect()
            for r in sorted(near, key=lambda r: (r.node, r.v, r.tie)):
                n = nodes[r.node]
                # The unit at the median goes where it leaves less of a difference.
                if n.below >= n.goal or n.below + r.w - n.goal > n.goal - n.below:
                    n.below = n.goal
                else:
                    n.below += r.w
                    n.cut = (r.v, r.tie)


def number_slots(rows: DataFrame) -> DataFrame:
    """Add `slot`: gapless numbers from 0 within each shard, in parts that one task can number."""
    sizes = rows.groupBy("shard").agg(F.ceil(F.count("*") / SLOT_ROWS).alias("parts"))
    rows = rows.join(F.broadcast(sizes), "shard").withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), "parts"))
    upto = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    counts = counts.select("shard", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    slot = (F.row_number().over(order) - 1 + F.col("before")).cast("bigint")
    return rows.join(F.broadcast(counts), ["shard", "part"]).withColumn("slot", slot).select("doc_id", "size", "text_crc32", "shard", "slot")
