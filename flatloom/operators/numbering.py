"""Dense numbers and running sums per file without one task per file.

A file may hold a third of all rows, so nothing here sorts a whole file in one
window. Rows are numbered inside a bounded block (a file split or a run of
row numbers); a small table with one row per block carries the totals of the
earlier blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialise

BLOCK_ROWS = 1 << 16


def carry_in(totals: DataFrame, value: str, out: str, *, block: str) -> DataFrame:
    """Sum of ``value`` over the earlier blocks of the same file; one row per block."""
    earlier = (
        Window.partitionBy("src_file")
        .orderBy(block)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.withColumn(out, F.coalesce(F.sum(value).over(earlier), F.lit(0)))


def row_blocks(scan: DataFrame, **marks: Column) -> DataFrame:
    """Number of rows ``n`` and first ``ord`` of every file split of a scan.

    For each of ``marks`` the number of rows it applies to is counted too.
    """
    counts = [F.sum(mark.cast("bigint")).alias(name) for name, mark in marks.items()]
    return materialise(
        scan.groupBy("src_file", "split_start", "task").agg(
            F.min("ord").alias("first_ord"), F.count("*").alias("n"), *counts
        ),
        "row-blocks",
    )


def row_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("src_file").agg(F.sum("n").alias("n_records"))


def number_rows(scan: DataFrame, blocks: DataFrame, out: str = "rec_no") -> DataFrame:
    """1-based row number per file, in input order, without shuffling the rows.

    ``scan`` has ``src_file, split_start, task, ord`` with ``ord`` taken after
    its filters, so within a split it rises by one. Only ``blocks``, a table with
    one row per split, is shuffled. The scan runs twice; if the second run is cut into
    other splits than the first, the query fails instead of misnumbering.
    """
    keys = ["src_file", "split_start", "task"]
    offsets = carry_in(blocks, "n", "before", block="split_start")
    offsets = offsets.select(*keys, "first_ord", "before")
    number = F.col("ord") - F.col("first_ord") + F.col("before") + 1
    checked = F.when(
        F.col("first_ord").isNull(),
        F.raise_error(F.lit("The file splits changed between two scans; run again.")).cast("long"),
    ).otherwise(number)
    offsets = broadcast_if_small(offsets)
    return scan.join(offsets, keys, "left").withColumn(out, checked).drop("first_ord", "before")


def running_sum(df: DataFrame, order: str, value: Column, out: str) -> DataFrame:
    """Sum of ``value`` up to and including each row, per file in the order of a dense number."""
    block = "_block"
    blocked = df.withColumn("_value", value).withColumn(
        block, F.floor(F.col(order) / BLOCK_ROWS)
    )
    totals = blocked.groupBy("src_file", block).agg(F.sum("_value").alias("_total"))
    before = carry_in(totals, "_total", "_before", block=block).drop("_total")
    within = Window.partitionBy("src_file", block).orderBy(order)
    return (
        blocked.join(before, ["src_file", block])
        .withColumn(out, F.col("_before") + F.sum("_value").over(within))
        .drop("_value", "_before", block)
    )
