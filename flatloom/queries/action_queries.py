"""Queries on actions, file names, the run ledger and the drop folder."""

from __future__ import annotations

from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, csv_line, file_extension
from ..operators.ledger import usage_counts
from ..plans.actions import action_structs, catalogue, extension_error, output_name
from ..plans.pipelines import convert
from ..session import scratch_path
from ..sinks.commits import save_all
from ..sinks.documents import saved_documents
from ..streaming.drop_folder import drop_folder
from .registry import query, table
from .stage import as_text, stage_lines


def _dropped_path() -> Column:
    """A file name per document, with an extension by language."""
    return F.concat(
        F.lit("in/"), "source", F.lit("/v1.doc"), "doc_id",
        F.when(F.col("lang") == "en", ".json").when(F.col("lang") == "fr", ".TXT")
        .when(F.col("lang") == "de", ".Csv").otherwise(""),
    )


_NAMES_SQL = """
    SELECT doc_id, 'v1.doc' || CAST(doc_id AS VARCHAR) AS stem,
           CASE lang WHEN 'en' THEN '.json' WHEN 'fr' THEN '.TXT' WHEN 'de' THEN '.Csv' ELSE '' END AS dot_ext
    FROM documents
"""
_ACTIONS_SQL = """
    (VALUES ('csvToJSON', 'CSV -> JSON', 'csv', 'json', '_converted.json'),
            ('jsonToCSV', 'JSON -> CSV', 'json', 'csv', '_converted.csv'),
            ('formatJSONByLine', 'Format JSON', 'json', 'json', '_line_formatted.json'))
    AS a(action, label, main_ext, out_ext, suffix)
"""


@query(f"""
    WITH n AS (SELECT doc_id, CASE dot_ext WHEN '' THEN 'doc' || CAST(doc_id AS VARCHAR) ELSE lower(substr(dot_ext, 2)) END AS ext
               FROM ({_NAMES_SQL}))
    SELECT doc_id, action, CASE WHEN ext NOT IN (main_ext, 'txt')
        THEN 'Invalid input: Selected file type ''.' || ext || ''' is not valid for ' || label || '.' END AS error_msg
    FROM n, {_ACTIONS_SQL}
""")
def extension_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file name against the extensions each action accepts."""
    files = table(spark, sf_dir, "documents").select("doc_id", _dropped_path().alias("path"))
    pairs = files.select("doc_id", "path", F.inline(action_structs()))
    return pairs.select(
        "doc_id",
        "action",
        extension_error(F.col("path"), F.col("label"), F.col("allowed")).alias("error_msg"),
    )


@query(f"""
    SELECT doc_id, action, CASE dot_ext WHEN '' THEN 'v1' ELSE stem END || suffix AS out_name,
           CASE dot_ext WHEN '' THEN 'doc' || CAST(doc_id AS VARCHAR) ELSE lower(substr(dot_ext, 2)) END AS extension,
           CASE dot_ext WHEN '' THEN 'v1' ELSE stem END AS base
    FROM ({_NAMES_SQL}), {_ACTIONS_SQL}
""", name="output_name")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base name, extension and the output name each action gives."""
    files = table(spark, sf_dir, "documents").select("doc_id", _dropped_path().alias("path"))
    path = F.col("path")
    return files.select("doc_id", "path", F.inline(action_structs())).select(
        "doc_id",
        "action",
        output_name(path, F.col("suffix")).alias("out_name"),
        file_extension(path).alias("extension"),
        base_name(path).alias("base"),
    )


@query(f"""
    SELECT action, label, main_ext || ',txt' AS allowed, out_ext, suffix,
           (SELECT COUNT(*) FROM ({_NAMES_SQL}) WHERE lower(substr(dot_ext, 2)) IN (main_ext, 'txt')) AS n_accepted
    FROM {_ACTIONS_SQL}
""")
def action_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actions, and how many of the files each would accept."""
    files = table(spark, sf_dir, "documents").select(_dropped_path().alias("path"))
    pairs = files.select("path", F.inline(action_structs()))
    accepted = extension_error(F.col("path"), F.col("label"), F.col("allowed")).isNull()
    return pairs.groupBy(
        "action", "label", F.array_join("allowed", ",").alias("allowed"), "out_ext", "suffix"
    ).agg(F.sum(accepted.cast("bigint")).alias("n_accepted"))


@query("""
    SELECT a.action, CAST(COUNT(e.event_id) AS BIGINT) AS n
    FROM (VALUES ('csvToJSON', 'click'), ('jsonToCSV', 'view'), ('formatJSONByLine', 'none')) AS a(action, event_type)
    LEFT JOIN events e ON e.event_type = a.event_type
    GROUP BY a.action
""", name="usage_counts")
def usage_counts_by_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successful runs per action; failed and cancelled runs do not count."""
    kind = F.col("event_type")
    ledger = table(spark, sf_dir, "events").select(
        F.when(kind.isin("click", "error"), "csvToJSON")
        .when(kind.isin("view", "purchase"), "jsonToCSV")
        .otherwise("formatJSONByLine")
        .alias("action"),
        F.when(kind.isin("error", "purchase"), "failed")
        .when(kind == "signup", "cancelled")
        .otherwise("success")
        .alias("status"),
    )
    return usage_counts(ledger, catalogue(spark))


@query("""
    SELECT CAST(to_json({'event_id': CAST(event_id AS VARCHAR), 'event_type': event_type, 'props': props,
        'ts': CAST(ts AS VARCHAR), 'value': CAST(value AS VARCHAR)}) AS VARCHAR) AS json
    FROM events
""")
def drop_folder_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream converts every CSV file of a folder once; its output read back."""
    names = ["event_id", "ts", "event_type", "value", "props"]
    events = as_text(table(spark, sf_dir, "events").select(*names))
    inbox = stage_lines(
        events,
        "event_id",
        F.lit(",".join(names)),
        csv_line([F.col(c) for c in names]),
        group=F.col("event_type"),
    )
    out, checkpoint = scratch_path(spark, "dropped"), scratch_path(spark, "dropped-checkpoint")
    drop_folder(spark, "csvToJSON", inbox, out, checkpoint).awaitTermination()
    return spark.read.text(f"{out}/batch=*[0-9]").select(F.col("value").alias("json"))


@query("""
    SELECT action, CAST(CASE action WHEN 'csvToJSON' THEN n ELSE 0 END AS BIGINT) AS n
    FROM (VALUES ('csvToJSON'), ('jsonToCSV'), ('formatJSONByLine')) AS a(action),
         (SELECT COUNT(DISTINCT event_type || '-' || CAST(event_id // 50000 AS VARCHAR)) AS n FROM events)
""")
def drop_folder_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage counts of the ledger the stream keeps: one success per file."""
    events = as_text(table(spark, sf_dir, "events").select("event_id", "event_type"))
    inbox = stage_lines(
        events,
        "event_id",
        F.lit("event_id,event_type"),
        csv_line([F.col("event_id"), F.col("event_type")]),
        group=F.col("event_type"),
    )
    out, checkpoint = scratch_path(spark, "dropped"), scratch_path(spark, "dropped-checkpoint")
    ledger = scratch_path(spark, "ledger")
    drop_folder(spark, "csvToJSON", inbox, out, checkpoint, ledger=ledger).awaitTermination()
    return usage_counts(spark.read.parquet(ledger), catalogue(spark))


class _BrokenOff(Exception):
    """Stands for whatever ends a save half-way."""


@query("""
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
           CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment
    FROM customer
""")
def save_replaces_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents saved over older ones, then a save that breaks off; read back by their list."""
    customer = as_text(table(spark, sf_dir, "customer"))
    out = scratch_path(spark, "saved")
    for names in (customer.columns[:2], customer.columns):
        cells = csv_line([F.col(c) for c in names])
        source = stage_lines(customer, "c_custkey", F.lit(",".join(names)), cells, group=F.col("c_mktsegment"))
        convert(spark, "csvToJSON", source, out, layout="array")

    def break_off(path: str) -> None:
        customer.write.csv(path)
        raise _BrokenOff

    with suppress(_BrokenOff):
        save_all(spark, out, {out: break_off})
    files = [f"{out}/{r.file}" for r in saved_documents(spark, out).select("file").toLocalIterator()]
    schema = ", ".join(f"{c} string" for c in customer.columns)
    return spark.read.schema(schema).option("multiLine", "true").json(files)
