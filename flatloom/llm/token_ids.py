"""Token-id output: texts encoded by a tokenizer of a given file, in files of id planes.

Documents are dealt into ranges of ascending id, by about as many text bytes each as a file shall
hold, and sorted there. Each task encodes its texts (`encoder.py`) and writes one file (`bit_planes.py`).

Edge cases: a null or empty text has only the end id. Null document ids come first; rows that
repeat an id stand together, ordered by a hash of the text, and are dealt to several files if
there are many. No column but doc_id and text is read. An empty table gives files of no document.
A text whose ids take over 2 GB does not fit a row of Spark's, and fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bit_planes import register
from .encoder import CUT

#: UTF-8 bytes of the texts of a file.
FILE_BYTES = 64 << 20
END = 0


def in_order(documents: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """doc_id and text, dealt into ranges of ascending id and sorted."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("size")).first().size or 0
    # The hash and the place part rows that repeat an id.
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("hash"), F.asc("place")]
    placed = rows.withColumn("hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    return placed.repartitionByRange(size // file_bytes + 1, *order).sortWithinPartitions(*order).select("doc_id", "text")


def write_token_ids(documents: DataFrame, folder: str, path: str, *, end: int = END, cut: str | None = CUT, planes: str = "byte", file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of all documents, in ascending order, to a folder of its own."""
    register(documents.sparkSession)
    options = {"tokenizer": path, "end": end, "cut": cut or "", "planes": planes}
    in_order(documents, file_bytes).write.format("id_planes").options(**options).mode("append").save(folder)


def read_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start and ids of each document, from the files."""
    register(spark)
    return spark.read.format("id_planes").load(folder)
