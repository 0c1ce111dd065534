"""Validation rules over documents in a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import csv_error, json_error, no_records_error
from ..plans.pipelines import json_to_csv
from ..session import configure
from .registry import query, table
from .stage import stage_arrays, staged_group


def _document(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


@query("""
    SELECT doc_id, CASE lang WHEN 'de' THEN 'Invalid input: JSON must be an object or array of objects.'
                             WHEN 'fr' THEN 'Invalid input: JSON must be an object or array of objects.' END AS error_msg
    FROM documents
""")
def top_level_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are a bare text or number."""
    configure(spark)
    doc = _document("doc_id", "text")
    damaged = (
        F.when(F.col("lang") == "de", F.regexp_extract(_document("text"), r"(?s)^\{[^:]*:(.*)\}$", 1))
        .when(F.col("lang") == "fr", F.concat(F.lit(" "), F.col("doc_id"), F.lit("\n")))
        .when(F.col("lang") == "es", F.concat(F.lit("[ "), doc, F.lit(" ]")))
        .otherwise(doc)
    )
    return table(spark, sf_dir, "documents").select("doc_id", json_error(damaged).alias("error_msg"))


@query("""
    SELECT doc_id, CASE WHEN lang <> 'en' THEN 'Invalid input: JSON is malformed.' END AS error_msg FROM documents
""")
def malformed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brace cut off, text after the value, a second document."""
    configure(spark)
    doc = _document("doc_id", "text")
    damaged = (
        F.when(F.col("lang") == "de", F.expr("left(to_json(struct(doc_id, text)), length(to_json(struct(doc_id, text))) - 1)"))
        .when(F.col("lang") == "fr", F.concat(doc, F.lit(" junk")))
        .when(F.col("lang") == "es", F.concat(doc, F.lit("\n"), doc))
        .otherwise(doc)
    )
    return table(spark, sf_dir, "documents").select("doc_id", json_error(damaged).alias("error_msg"))


@query("""
    SELECT doc_id, CASE lang
        WHEN 'de' THEN 'Invalid input: Only flat JSON is supported. Field ''b'' contains a nested value.'
        WHEN 'fr' THEN 'Invalid input: Array item 2 is not a JSON object.'
        WHEN 'es' THEN 'Invalid input: Only flat JSON is supported. Field ''a'' contains a nested value.' END AS error_msg
    FROM documents
""")
def first_bad_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record at fault names the document's error."""
    configure(spark)
    doc = _document("doc_id", "text")
    wrapped = F.concat(F.lit("["), doc)
    damaged = (
        F.when(F.col("lang") == "de", F.concat(wrapped, F.lit(',{"c":[1],"b":{}},7]')))
        .when(F.col("lang") == "fr", F.concat(wrapped, F.lit(',7,{"b":{}}]')))
        .when(F.col("lang") == "es", F.concat(F.lit('{"z":1,"a":'), doc, F.lit("}")))
        .otherwise(doc)
    )
    return table(spark, sf_dir, "documents").select("doc_id", json_error(damaged).alias("error_msg"))


@query("""
    SELECT doc_id, CASE WHEN lang = 'fr' THEN 'Invalid input: Input is not valid UTF-8 text.' END AS error_msg FROM documents
""")
def utf8_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One byte that is not UTF-8 rules a document out."""
    quoted = F.concat(F.lit('id,"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    damaged = F.when(
        F.col("lang") == "fr", F.concat(quoted, F.expr("cast(X'C3' as string)"))
    ).otherwise(quoted)
    return table(spark, sf_dir, "documents").select("doc_id", csv_error(damaged).alias("error_msg"))


@query("""
    SELECT doc_id, CASE WHEN (length(text) - length(replace(text, '"', ''))) % 2 = 1
        THEN 'Invalid input: CSV contains an unclosed quote.' END AS error_msg
    FROM documents
    UNION ALL
    SELECT page_id + 1000000000, CASE WHEN (length(html) - length(replace(html, '"', ''))) % 2 = 1
        THEN 'Invalid input: CSV contains an unclosed quote.' END
    FROM pages
""")
def unclosed_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw texts and pages as CSV: an odd number of quotes leaves one open."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    pages = table(spark, sf_dir, "pages").select(
        (F.col("page_id") + 1_000_000_000).alias("doc_id"), F.col("html").alias("text")
    )
    return documents.unionByName(pages).select("doc_id", csv_error(F.col("text")).alias("error_msg"))


@query("""
    SELECT doc_id, CASE WHEN lang = 'de' THEN 'Invalid input: CSV is empty or missing a header row.' END AS csv_error,
           CASE WHEN lang IN ('fr', 'es') THEN 'Invalid input: JSON has no records to convert.' END AS json_error
    FROM documents
""")
def empty_input_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a header row or without records."""
    configure(spark)
    lang = F.col("lang")
    csv = F.when(lang == "de", "\r\n").otherwise(F.replace("text", F.lit('"'), F.lit("")))
    json = F.when(lang == "fr", "[ ]").when(lang == "es", "[{}]").otherwise(_document("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", csv_error(csv).alias("csv_error"), no_records_error(json).alias("json_error")
    )


@query("""
    SELECT lang || '-' || CAST(doc_id // 50000 AS VARCHAR) AS doc, CAST(NULL AS BIGINT) AS rec_no,
           CASE lang WHEN 'fr' THEN 'Invalid input: JSON has no records to convert.'
                     ELSE 'Invalid input: JSON is malformed.' END AS error_msg
    FROM documents WHERE lang IN ('fr', 'es') GROUP BY ALL
    UNION ALL
    SELECT lang || '-' || CAST(doc_id // 50000 AS VARCHAR),
           ROW_NUMBER() OVER (PARTITION BY lang, doc_id // 50000 ORDER BY doc_id),
           'Invalid input: Only flat JSON is supported. Field ''n'' contains a nested value.'
    FROM documents WHERE lang = 'de'
""")
def json_file_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without records, malformed files and nested records, as a rejects table."""
    documents = table(spark, sf_dir, "documents")
    item = (
        F.when(F.col("lang") == "fr", "{}")
        .when(F.col("lang") == "es", F.concat(_document("text"), F.lit("}")))
        .when(F.col("lang") == "de", F.concat(F.lit('{"n":'), _document("text"), F.lit("}")))
        .otherwise(_document("text"))
    )
    path = stage_arrays(documents, "doc_id", item, group=F.col("lang"))
    rejects = json_to_csv(spark, path).rejects
    return rejects.select(staged_group(F.col("src_file")).alias("doc"), "rec_no", "error_msg")
