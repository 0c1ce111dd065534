"""Session settings and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Needed while a job runs, not only while it is built: a repeated key in a
# JSON object keeps its last value instead of failing the parse.
SESSION_CONFS = {"spark.sql.variant.allowDuplicateKeys": "true"}

# Spark cuts files by the current number of cores, which changes as executors come
# and go. Two scans of one file must be cut alike.
PINNED = "spark.sql.files.minPartitionNum"

# Parquet's writer first looks at the size of a page after this many rows, 100 by default, and its
# codec takes the page whole. Among rows of megabytes it must look after every one.
PAGE_CHECK = "parquet.page.size.row.check.min"

_own_folders: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    for name, value in SESSION_CONFS.items():
        spark.conf.set(name, value)
    pin_splits(spark)
    return spark


def pin_splits(spark: SparkSession) -> None:
    """Fix the way files are cut into splits for the rest of the session."""
    if spark.conf.get(PINNED, None) is None:
        spark.conf.set(PINNED, str(spark.sparkContext.defaultParallelism))


def small_pages(spark: SparkSession) -> None:
    """Let Parquet pages of long rows end at their size, for the rest of the session.

    After a look the writer skips half of the rows it still expects in the page, so short rows
    cost a few looks a page. A setting of the session's own is kept.
    """
    if spark.conf.get(PAGE_CHECK, None) is None:
        spark.conf.set(PAGE_CHECK, "1")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local-mode session without the setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share.")
    app = context.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="flatloom-")
    return _own_folders[app]


def _scratch_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/flatloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; nothing is created or deleted here."""
    return f"{_scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application.

    For callers that have written or collected what they wanted: results that are still
    lazy read these tables.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts lineage so that a lost executor costs a re-read and not a
    recomputation, and gives later joins a true size, so Spark broadcasts the
    table only while it is under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# A table sent to every executor stays below this, as measured.
BROADCAST_BYTES = 256 << 20


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Mark a materialised small table for broadcast when its measured size allows it.

    Tables here have one row per file or split, which Spark's default threshold
    would shuffle-join, and with it all records. Beyond the limit the join is left
    to Spark, where adaptive execution splits the partition of a hot file.
    """
    text = F.to_json(F.struct(*df.columns))
    size = df.agg(F.sum(F.octet_length(text)).alias("bytes")).first().bytes or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


@contextmanager
def arrow_batches(spark: SparkSession, size: str) -> Iterator[None]:
    """Hand rows to Python in batches of at most `size` while a plan runs, a longer row by itself.

    A batch is held several times over: as vectors, as a message and by Python, by every task.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def case_sensitive(spark: SparkSession) -> Iterator[None]:
    """Resolve column names by exact case while a plan is built or written."""
    name = "spark.sql.caseSensitive"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
