"""File listing and splittable text scans."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import errors

Paths = str | list[str]


def list_files(spark: SparkSession, paths: Paths) -> DataFrame:
    """One row per file: src_file. Files of no bytes are listed too.

    Spark's scans skip empty files, so the names come from its file index, which
    the driver holds for any scan.
    """
    found = spark.read.format("binaryFile").load(paths).inputFiles()
    # A local path is written file:/// by the index and file:/ by the scan.
    names = [(re.sub("^file:/+", "file:/", n),) for n in found]
    return spark.createDataFrame(names, "src_file string")


def text_pieces(spark: SparkSession, paths: Paths, separator: str) -> DataFrame:
    """The text of every file cut at a one-byte separator, in parallel within files.

    ``src_file, split_start, split_len`` name the byte range a piece was read
    from, ``ord`` rises within it and ``task`` is the reading partition. A byte
    order mark is dropped.
    """
    return (
        spark.read.option("lineSep", separator)
        .text(paths)
        .select(
            F.col("_metadata.file_path").alias("src_file"),
            F.col("_metadata.file_block_start").alias("split_start"),
            F.col("_metadata.file_block_length").alias("split_len"),
            F.col("_metadata.file_size").alias("file_size"),
            F.spark_partition_id().alias("task"),
            F.monotonically_increasing_id().alias("ord"),
            F.col("value").alias("piece"),
        )
    )


def plain_path(src_file: Column) -> Column:
    """The path as a user writes it; Spark's file metadata percent-encodes it."""
    return F.url_decode(F.replace(src_file, F.lit("+"), F.lit("%2B")))


def paths_of(files: DataFrame) -> list[str]:
    """Paths as a driver-side list, as Spark's readers take them.

    It holds names only and is no larger than the listing the driver keeps for
    every file scan anyway.
    """
    names = (unquote(r.src_file) for r in files.select("src_file").toLocalIterator())
    return [re.sub(r"([\\*?\[\]{}])", r"\\\1", name) for name in names]


def file_rejects(verdicts: DataFrame) -> DataFrame:
    """Reject rows of files ruled out as a whole."""
    return verdicts.filter(F.col("error").isNotNull()).select(
        "src_file",
        F.lit(None).cast("bigint").alias("rec_no"),
        F.lit(errors.INVALID_INPUT).alias("error_kind"),
        errors.message(F.col("error")).alias("error_msg"),
    )
