"""The conversions from folder to folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import errors
from ..functions.json import parse_json, pretty, sorted_json
from ..functions.text import base_name, csv_line_of
from ..operators.keys import MAX_COLUMNS, cells, file_keys, key_union, sorted_keys, values_of_file, wide_lines
from ..operators.ledger import record_cancelled, record_failure, record_runs
from ..session import broadcast_if_small, case_sensitive, configure, materialise
from ..sinks.commits import save_all
from ..sinks.documents import array_lines, csv_lines, write_csv, write_lines, write_named_documents
from ..sources.csv_files import scan_csv
from ..sources.files import Paths, list_files, paths_of, plain_path
from ..sources.json_files import JsonScan, scan_json, scan_json_lines
from .actions import CSV_TO_JSON, FORMAT_JSON, JSON_TO_CSV, Action, action_of
from .actions import extension_error

@dataclass
class Conversion:
    """A planned conversion. ``output`` is lazy; ``rejects`` says what is left out and why.

    ``files`` has one row per converted file: src_file, out_name. ``save`` writes
    the output in the layout it was planned for. Planning scans the files several times
    for the checks. A table of very many columns comes as text: its ``header`` and the
    ``line`` of each record.
    """

    action: Action
    output: DataFrame
    rejects: DataFrame
    files: DataFrame
    layout: str
    documents: DataFrame | None = None
    header: DataFrame | None = None

    def check(self) -> None:
        """Strict mode: raise on the first reject."""
        first = self.rejects.orderBy(F.col("rec_no").asc_nulls_first(), "src_file").limit(1)
        for r in first.collect():
            raise errors.InvalidInput(f"{r.error_msg} ({r.src_file})")

    def _write(self, path: str, chunk_rows: int | None) -> None:
        if self.documents is not None:
            write_named_documents(self.documents, path, chunk_rows)
        elif self.header is not None:
            # The header is the first part; all parts in the order of their names are the table.
            write_lines(self.header.unionByName(self.output), "line", path)
        elif self.action is JSON_TO_CSV:
            with case_sensitive(self.output.sparkSession):
                write_csv(self.output, path)
        else:
            write_lines(self.output, "json", path)

    def save(self, path: str, *, rejects: str | None = None, chunk_rows: int | None = None) -> None:
        """Replace what is at ``path`` by the output, and at ``rejects`` by the rejects, as a whole.

        Until all of it is written, the old results stand. A named document of more than
        ``chunk_rows`` lines is a folder of parts; with as many as it can have, it is one file
        written by one task.
        """
        results = {path: lambda to: self._write(to, chunk_rows)}
        if rejects is not None:
            results[rejects] = lambda to: self.rejects.write.parquet(to)
        save_all(self.output.sparkSession, path, results)


def _admitted(spark: SparkSession, src: Paths, action: Action) -> tuple[Paths, DataFrame]:
    """Paths with an extension the action accepts, and rejects for the others."""
    files = list_files(spark, src)
    error = extension_error(
        plain_path(F.col("src_file")), F.lit(action.label), F.array(*map(F.lit, action.allowed))
    )
    judged = files.withColumn("error_msg", error)
    refused = judged.filter(F.col("error_msg").isNotNull()).select(
        "src_file",
        F.lit(None).cast("bigint").alias("rec_no"),
        F.lit(errors.INVALID_INPUT).alias("error_kind"),
        "error_msg",
    )
    if refused.isEmpty():
        return src, refused
    return paths_of(judged.filter(F.col("error_msg").isNull())), refused


def _named(files: DataFrame, action: Action) -> DataFrame:
    """Add the output name; files of the same name in several folders get a folder mark."""
    path = plain_path(F.col("src_file"))
    folder_mark = F.substring(F.sha2(F.col("src_file"), 256), 1, 12)
    same_name = F.count("*").over(Window.partitionBy("base"))
    return (
        files.withColumn("base", base_name(path))
        .withColumn("twins", same_name)
        .withColumn(
            "out_name",
            F.concat(
                "base",
                F.when(F.col("twins") > 1, F.concat(F.lit("-"), folder_mark)).otherwise(""),
                F.lit(action.suffix),
            ),
        )
        .drop("base", "twins")
    )


def _nothing(spark: SparkSession, action: Action, layout: str, rejects: DataFrame) -> Conversion:
    output = spark.createDataFrame([], "src_file string, rec_no bigint, json string, line string")
    files = spark.createDataFrame([], "src_file string, out_name string")
    lines = spark.createDataFrame([], "out_name string, line_no bigint, line string")
    return Conversion(action, output, rejects, files, layout, lines)


def csv_to_json(
    spark: SparkSession, src: Paths, *, layout: str = "lines", keep_crlf: bool = False
) -> Conversion:
    """CSV files to JSON objects of text values with sorted keys.

    ``layout='lines'`` gives JSON Lines without a shuffle; ``'array'`` one pretty
    array per file, in input order.
    """
    configure(spark)
    paths, refused = _admitted(spark, src, CSV_TO_JSON)
    if not paths:
        return _nothing(spark, CSV_TO_JSON, layout, refused)
    as_array = layout == "array"
    scan = scan_csv(spark, paths, numbered=as_array, keep_crlf=keep_crlf, as_json=True)
    output = scan.records
    good = _named(scan.files.filter(F.col("error").isNull()), CSV_TO_JSON)
    documents = None
    if as_array:
        documents = array_lines(
            output.withColumn("json", pretty(F.col("json"))),
            good.join(scan.counts, "src_file", "left").withColumn("is_array", F.lit(True)),
        )
    return Conversion(
        CSV_TO_JSON,
        output,
        refused.unionByName(scan.rejects),
        good.select("src_file", "out_name"),
        layout,
        documents,
    )


def _json_scan(spark: SparkSession, paths: Paths, lines: bool, numbered: bool) -> JsonScan:
    return scan_json_lines(spark, paths, numbered=numbered) if lines else scan_json(spark, paths, numbered=numbered)


def json_to_csv(
    spark: SparkSession,
    src: Paths,
    *,
    layout: str = "dataset",
    lines: bool = False,
    max_columns: int = MAX_COLUMNS,
) -> Conversion:
    """Flat JSON to CSV, columns in sorted order of all keys.

    ``layout='dataset'`` gives one table over all files; ``'per_file'`` one CSV
    document per file with that file's own keys, in input order. A table of more than
    ``max_columns`` columns, or of none, is put together as text lines.
    """
    configure(spark)
    paths, refused = _admitted(spark, src, JSON_TO_CSV)
    if not paths:
        return _nothing(spark, JSON_TO_CSV, layout, refused)
    per_file = layout == "per_file"
    scan = _json_scan(spark, paths, lines, numbered=per_file)
    sound = scan.files.filter(F.col("error").isNull())
    has_keys = F.coalesce(F.col("n_nonempty"), F.lit(0)) > 0
    barren = sound.filter(~has_keys).select(
        "src_file",
        F.lit(None).cast("bigint").alias("rec_no"),
        F.lit(errors.INVALID_INPUT).alias("error_kind"),
        errors.message(errors.NO_RECORDS).alias("error_msg"),
    )
    good = _named(sound.filter(has_keys), JSON_TO_CSV)
    rejects = refused.unionByName(scan.rejects).unionByName(barren)
    header = None
    if per_file:
        keyed, union = file_keys(scan.records)
        keyed = good.join(keyed, "src_file").select(
            "src_file", "out_name", "keys", "positions", csv_line_of(F.col("keys")).alias("header")
        )
        small = broadcast_if_small(keyed.select("src_file", "keys", "positions"))
        with case_sensitive(spark):
            values = values_of_file(F.col("text"), union)
            output = scan.records.join(small, "src_file").select(
                "src_file", "rec_no", csv_line_of(values).alias("line")
            )
        documents = csv_lines(output, keyed)
    else:
        # '{}' next to records with keys is a row of empty fields, but alone in
        # a file it is no record at all.
        kept = scan.records
        if not barren.isEmpty():
            kept = kept.join(broadcast_if_small(barren.select("src_file")), "src_file", "left_anti")
        union = materialise(key_union(scan.records), "keys")
        n_keys = union.count()
        with case_sensitive(spark):
            if 0 < n_keys <= max_columns:
                keys = sorted_keys(union)
                output = kept.select(
                    *[c.alias(k) for k, c in zip(keys, cells(keys, F.col("text")), strict=True)]
                )
            else:
                output = wide_lines(kept, union, n_keys)
                row = union.agg(F.array_sort(F.collect_list("key")).alias("keys"))
                header = row.filter(F.size("keys") > 0).select(csv_line_of(F.col("keys")).alias("line"))
        documents = None
    return Conversion(
        JSON_TO_CSV, output, rejects, good.select("src_file", "out_name"), layout, documents, header
    )


def format_json(
    spark: SparkSession, src: Paths, *, layout: str = "lines", lines: bool = False
) -> Conversion:
    """Flat JSON with sorted keys; value types and nulls are kept.

    ``layout='lines'`` gives one compact object per line without a shuffle;
    ``'array'`` one pretty document per file, in input order.
    """
    configure(spark)
    paths, refused = _admitted(spark, src, FORMAT_JSON)
    if not paths:
        return _nothing(spark, FORMAT_JSON, layout, refused)
    as_array = layout == "array"
    scan = _json_scan(spark, paths, lines, numbered=as_array)
    text = F.col("text")
    output = scan.records.withColumn("json", sorted_json(parse_json(text), text)).drop("text")
    good = _named(scan.files.filter(F.col("error").isNull()), FORMAT_JSON)
    documents = None
    if as_array:
        firsts = materialise(scan.firsts, "first-numbers")
        documents = array_lines(
            output.withColumn("json", pretty(F.col("json"))),
            good.join(firsts, "src_file", "left"),
            first_no=F.coalesce("first_no", F.lit(1)),
        )
    return Conversion(
        FORMAT_JSON,
        output,
        refused.unionByName(scan.rejects),
        good.select("src_file", "out_name"),
        layout,
        documents,
    )


_PLANNERS = {CSV_TO_JSON: csv_to_json, JSON_TO_CSV: json_to_csv, FORMAT_JSON: format_json}


@contextmanager
def _cancellable(spark: SparkSession, tag: str | None) -> Iterator[None]:
    """Jobs within bear the tag; one cancelled by it ends as ``Cancelled``."""
    if tag is None:
        yield
        return
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    except (PySparkException, Py4JJavaError) as e:
        if "SPARK_JOB_CANCELLED" in str(e):
            raise errors.Cancelled(f"The run '{tag}' was cancelled.") from e
        raise
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Cancel the conversions that run under the tag, from any thread."""
    spark.sparkContext.cancelJobsWithTag(tag)


def convert(
    spark: SparkSession,
    action: str | Action,
    src: Paths,
    dst: str | None = None,
    *,
    mode: str = "quarantine",
    ledger: str | None = None,
    ledger_mode: str = "append",
    run_id: str | None = None,
    chunk_rows: int | None = None,
    tag: str | None = None,
    **options,
) -> Conversion:
    """Plan the conversion ``action`` names and, with ``dst``, save it as a whole.

    ``mode='strict'`` raises on any reject and writes nothing. ``'quarantine'``
    writes the good records, and the rejects as Parquet to ``<dst>_rejects``, both or
    neither. With ``ledger`` the outcome of every file is added to that table after saving.
    A run done again under its ``run_id`` counts once in ``usage_counts``.
    A run with a ``tag`` can be given up by ``cancel``: it raises ``Cancelled``, leaves
    the old results, and is ``cancelled`` in the ledger, neither success nor failure.
    """
    if mode not in ("strict", "quarantine"):
        raise errors.InvalidInput(f"Unknown mode '{mode}'.")
    act = action_of(action)
    try:
        with _cancellable(spark, tag):
            planned = _PLANNERS[act](spark, src, **options)
            if mode == "strict":
                try:
                    planned.check()
                except errors.InvalidInput:
                    if ledger is not None:
                        record_failure(ledger, act.name, planned.files, planned.rejects, ledger_mode, run_id)
                    raise
            if dst is not None:
                rejects = f"{dst.rstrip('/')}_rejects" if mode == "quarantine" else None
                planned.save(dst, rejects=rejects, chunk_rows=chunk_rows)
    except errors.Cancelled:
        if ledger is not None:
            record_cancelled(ledger, act.name, list_files(spark, src), ledger_mode, run_id)
        raise
    if dst is not None and ledger is not None:
        record_runs(ledger, act.name, planned.files, planned.rejects, ledger_mode, run_id)
    return planned
