"""Sinks that write one document per source file, and plain dataset sinks."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialise
from .commits import Files, recover

# Defaults would write \" for a quote, "" for empty text, and trim values.
CSV_WRITE = {
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}

# A document of more records is written as several numbered parts.
CHUNK_ROWS = 250_000


def array_lines(records: DataFrame, files: DataFrame, first_no: Column | int = 1) -> DataFrame:
    """Lines of one JSON array per file: ``out_name, line_no, line``.

    ``records`` has ``src_file, rec_no, json``; ``files`` has ``src_file, out_name,
    is_array, n_records`` and also lists files without records, which give an empty
    array. A document that was a single object stays one.
    """
    names = files.withColumn("first", F.lit(first_no) if isinstance(first_no, int) else first_no)
    names = materialise(names.select("src_file", "out_name", "is_array", "n_records", "first"), "array-files")
    separator = F.when(~F.col("is_array") | (F.col("rec_no") == F.col("first")), "").otherwise(",")
    body = records.join(broadcast_if_small(names), "src_file").select(
        "out_name", F.col("rec_no").alias("line_no"), F.concat(separator, "json").alias("line")
    )
    brackets = F.array(
        F.struct(F.lit(0).cast("bigint").alias("line_no"), F.lit("[").alias("line")),
        F.struct(
            (F.coalesce("n_records", F.lit(0)) + 1).cast("bigint").alias("line_no"),
            F.lit("]").alias("line"),
        ),
    )
    frame = names.filter("is_array").select("out_name", F.inline(brackets))
    return body.unionByName(frame)


def csv_lines(records: DataFrame, files: DataFrame) -> DataFrame:
    """Header and record lines per file: ``out_name, line_no, line``.

    ``records`` has ``src_file, rec_no, line``; ``files`` has ``src_file, out_name, header``.
    """
    files = materialise(files.select("src_file", "out_name", "header"), "csv-heads")
    names = broadcast_if_small(files.select("src_file", "out_name"))
    body = records.join(names, "src_file").select(
        "out_name", F.col("rec_no").alias("line_no"), "line"
    )
    head = files.select(
        "out_name", F.lit(0).cast("bigint").alias("line_no"), F.col("header").alias("line")
    )
    return body.unionByName(head)


def write_documents(lines: DataFrame, path: str, chunk_rows: int | None = None) -> None:
    """Write ``out_name, line_no, line`` to ``path/out_name=<name>/chunk=<n>/``.

    One file per chunk of a document, so a large document is written by many
    tasks; its chunks in number order are the document.
    """
    (
        lines.withColumn("chunk", F.floor(F.col("line_no") / (chunk_rows or CHUNK_ROWS)))
        .repartition("out_name", "chunk")
        .sortWithinPartitions("out_name", "chunk", "line_no")
        .select("out_name", "chunk", F.col("line").alias("value"))
        .write.mode("overwrite")
        .partitionBy("out_name", "chunk")
        .text(path)
    )


# Renames asked for at a time; each is a call to the file system and no work of its own.
MOVES = 32


def write_named_documents(lines: DataFrame, path: str, chunk_rows: int | None = None) -> None:
    """Write every document to ``path/<out_name>`` and a list of them to ``path/_manifest``.

    The parts are written first; then each is moved to its name, a change of names only. A
    document of one part is a file, one of several a folder whose parts, in the order of
    their names, are the document; Spark reads either by its name. The list has ``out_name,
    part, file, length`` and is made by a scan of file names; it is written last, so a folder
    with a list is whole. Callers that replace results do so by ``commits.save_all``.
    """
    spark = lines.sparkSession
    files = Files(spark, path)
    staged = f"{path}/_parts"
    write_documents(lines, staged, chunk_rows)

    def seen(folder: str) -> list[str]:
        return [n for n in files.names(folder) if n[0] not in "._"]

    def name(document: str) -> None:
        chunks = sorted(seen(f"{staged}/{document}"), key=lambda c: int(c.removeprefix("chunk=")))
        parts = [f"{staged}/{document}/{c}/{p}" for c in chunks for p in seen(f"{staged}/{document}/{c}")]
        to = f"{path}/{unquote(document.removeprefix('out_name='))}"
        if len(parts) == 1:
            files.move(parts[0], to)
        else:
            files.make(to)
            for i, part in enumerate(parts):
                files.move(part, f"{to}/part-{i:05d}")

    with ThreadPoolExecutor(MOVES) as pool:
        list(pool.map(name, seen(staged)))
    files.delete(staged)
    _write_manifest(spark, files, path)


MANIFEST = "_manifest"
_MANIFEST_COLUMNS = "out_name string, part int, file string, length bigint"


def _write_manifest(spark: SparkSession, files: Files, path: str) -> None:
    """One row per part of a document, with its path within the folder."""
    rows = spark.createDataFrame([], _MANIFEST_COLUMNS)
    if any(n[0] not in "._" for n in files.names(path)):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
        folder = files.at(path).getName()
        inner = F.substring_index("path", f"/{folder}/", -1)
        out_name = F.substring_index(inner, "/", 1)
        part = F.coalesce(F.regexp_extract(inner, r"/part-(\d+)$", 1).try_cast("int"), F.lit(0))
        rows = found.select(out_name.alias("out_name"), part.alias("part"), inner.alias("file"), "length")
    rows.write.parquet(f"{path}/{MANIFEST}")


def saved_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a saved folder by its list: ``out_name, part, file, length``.

    A save that broke off after its commit is finished first, so the list is that of one save.
    """
    recover(spark, path)
    return spark.read.schema(_MANIFEST_COLUMNS).parquet(f"{path}/{MANIFEST}")


def write_lines(lines: DataFrame, column: str, path: str) -> None:
    """One text line per record, straight from the scan's partitions."""
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, quoted only where needed."""
    df.write.mode("overwrite").options(**CSV_WRITE).csv(path, header=True)
