"""Write test tables as CSV and JSON files in the shared folder, for the scans to read."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sinks.documents import write_csv, write_documents

# Rows per staged file, so that the number of files grows with the table.
BLOCK = 50_000


# Tasks that share small splits; each sends its figures to the driver.
TASKS = 1_024


@contextmanager
def small_splits(spark: SparkSession, size: str = "64k", tasks: int = TASKS) -> Iterator[None]:
    """Cut files into many splits while a result is made, so that records cross borders.

    The number of splits grows with the files, that of tasks does not: one task reads many.
    """
    wanted = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.maxPartitionNum": str(tasks)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def stage_csv(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    write_csv(df, path)
    return path


def _keyed(df: DataFrame, key: str, group: Column | None, text: Column) -> DataFrame:
    block = F.floor(F.col(key) / BLOCK).cast("string")
    name = block if group is None else F.concat(group, F.lit("-"), block)
    return df.select(
        name.alias("out_name"), (F.col(key) % BLOCK + 1).cast("bigint").alias("line_no"), text
    )


def stage_lines(
    df: DataFrame, key: str, header: Column, line: Column, group: Column | None = None
) -> str:
    """Text files of a header line and data lines in key order, one file per block and group."""
    path = scratch_path(df.sparkSession, "staged-csv")
    body = _keyed(df.withColumn("_head", header), key, group, F.struct("_head", line.alias("line")).alias("l"))
    head = body.groupBy("out_name").agg(F.min("l._head").alias("line"))
    lines = body.select("out_name", "line_no", "l.line").unionByName(
        head.select("out_name", F.lit(0).cast("bigint").alias("line_no"), "line")
    )
    write_documents(lines, path)
    return path


def stage_arrays(
    df: DataFrame, key: str, item: Column, group: Column | None = None
) -> str:
    """JSON files of one array each in key order, one file per block and group."""
    path = scratch_path(df.sparkSession, "staged-json")
    body = _keyed(df, key, group, item.alias("line"))
    ends = body.groupBy("out_name").agg(F.min("line_no").alias("first_no"))
    first = F.col("line_no") == F.col("first_no")
    # One row per file: sent to the tasks, so that the items are dealt once, when they are written.
    items = body.join(F.broadcast(ends), "out_name").select(
        "out_name", "line_no", F.concat(F.when(first, "").otherwise(","), "line").alias("line")
    )
    brackets = F.array(
        F.struct(F.lit(0).cast("bigint").alias("line_no"), F.lit("[").alias("line")),
        F.struct(F.lit(BLOCK + 1).cast("bigint").alias("line_no"), F.lit("]").alias("line")),
    )
    write_documents(items.unionByName(ends.select("out_name", F.inline(brackets))), path)
    return path


def staged_group(src_file: Column) -> Column:
    """The group and block a staged file was written for."""
    return F.regexp_extract(src_file, "/out_name=([^/]+)/", 1)
