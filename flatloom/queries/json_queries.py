"""Queries over JSON files and JSON text made from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json import kind, parse_strict
from ..functions.text import csv_line
from ..operators.keys import cells, key_union
from ..operators.validate import unwrap
from ..plans.pipelines import convert, format_json, json_to_csv
from ..session import case_sensitive, configure, materialise, scratch_path
from ..sources.json_files import scan_json, scan_json_lines
from .registry import query, table
from .stage import as_text, small_splits, stage_arrays, staged_group

_BLOCK = "50000"


def _rows(df: DataFrame) -> Column:
    """Every row of ``df`` as the text of one JSON object."""
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})


def _texts(records: DataFrame, names: list[str], *more: str) -> DataFrame:
    """The given keys of JSON records as text columns."""
    with case_sensitive(records.sparkSession):
        values = [c.alias(n) for n, c in zip(names, cells(names, F.col("text")), strict=True)]
        return records.select(*values, *more)


@query(f"""
    SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CAST(value AS VARCHAR) AS value,
           CAST(json_extract(props, '$.k') AS VARCHAR) AS k,
           ROW_NUMBER() OVER (PARTITION BY event_id // {_BLOCK} ORDER BY event_id) AS rec_no
    FROM events
""")
def json_scan_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of flat objects, cut at closing braces and numbered in input order."""
    events = table(spark, sf_dir, "events").select(
        "event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k")
    )
    path = stage_arrays(events, "event_id", _rows(events))
    records = scan_json(spark, path, numbered=True).records
    return _texts(records, ["event_id", "event_type", "value", "k"], "rec_no")


_PROPS_SQL = f"""
    SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(ts AS VARCHAR) AS ts, event_type, CAST(value AS VARCHAR) AS value, props,
           ROW_NUMBER() OVER (PARTITION BY event_id // {_BLOCK} ORDER BY event_id) AS rec_no
    FROM events
"""


def _events_with_braces(spark: SparkSession, sf_dir: str, **scan_options) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("string"))
    path = stage_arrays(events, "event_id", _rows(events))
    records = scan_json(spark, path, numbered=True, **scan_options).records
    return _texts(records, ["event_id", "ts", "event_type", "value", "props"], "rec_no")


@query(_PROPS_SQL)
def json_whole_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Braces inside strings, in files that one task can read as one text."""
    return _events_with_braces(spark, sf_dir)


@query(_PROPS_SQL)
def json_stitch_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every file treated as too large for that."""
    return _events_with_braces(spark, sf_dir, whole_file_limit=0)


#: Bytes of an element from the end of the one before it on, for `json_long_elements`.
LONG_ELEMENT = 6000


@query(f"""
    WITH items AS (
        SELECT coalesce(lang, '') || '-' || CAST(doc_id // 50000 AS VARCHAR) AS part, doc_id, hex(text) AS text, lang = 'en' AS deep
        FROM documents
    ), numbered AS (
        SELECT part, row_number() OVER (PARTITION BY part ORDER BY doc_id) AS rec_no, doc_id, text, deep,
               25 + length(CAST(doc_id AS VARCHAR)) + length(text) + CASE WHEN deep THEN 14 ELSE 0 END AS size
        FROM items
    )
    SELECT part, rec_no,
           CASE WHEN size > {LONG_ELEMENT} THEN 'Invalid input: A record is too long for one row.'
                WHEN deep THEN 'Invalid input: Only flat JSON is supported. Field ''more'' contains a nested value.'
                ELSE '{{"doc_id":' || doc_id || ',"text":"' || text || '}}"}}' END AS outcome
    FROM numbered
""")
def json_long_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements over a lowered limit are rejected one by one, flat and nested, and the rest of their arrays is kept."""
    documents = table(spark, sf_dir, "documents")
    more = F.when(F.col("lang") == "en", F.lit(',"more":{"x":1}')).otherwise("")
    item = F.concat(F.lit('{"doc_id":'), "doc_id", F.lit(',"text":"'), F.hex("text"), F.lit('}"'), more, F.lit("}"))
    path = stage_arrays(documents.select("doc_id", "lang", "text"), "doc_id", item, F.coalesce("lang", F.lit("")))
    with small_splits(spark):
        scan = scan_json(spark, path, numbered=True, whole_file_limit=0, max_record_bytes=LONG_ELEMENT)
        kept = scan.records.select("src_file", "rec_no", F.col("text").alias("outcome"))
        found = kept.unionByName(scan.rejects.select("src_file", "rec_no", F.col("error_msg").alias("outcome")))
        return materialise(found.select(staged_group(F.col("src_file")).alias("part"), "rec_no", "outcome"), "long-elements")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents")
def json_scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with escaped quotes and line breaks."""
    documents = table(spark, sf_dir, "documents")
    path = stage_arrays(documents, "doc_id", _rows(documents))
    return _texts(scan_json(spark, path).records, documents.columns)


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
           CAST(o_totalprice AS VARCHAR) AS o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority
    FROM orders
""")
def json_lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON Lines, on request."""
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("string"))
    path = scratch_path(spark, "orders-lines")
    orders.write.json(path)
    return _texts(scan_json_lines(spark, path).records, orders.columns)


@query("""
    SELECT event_id, 0 AS pos, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
    UNION ALL
    SELECT event_id, 1, event_id FROM events WHERE event_type = 'click'
""")
def json_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object or an array of objects in a text column, one row per record."""
    configure(spark)
    events = table(spark, sf_dir, "events")
    doc = (
        F.when(
            F.col("event_type") == "click",
            F.concat(F.lit("["), "props", F.lit(', {"k": '), "event_id", F.lit("}]")),
        )
        .when(F.col("event_type") == "view", F.concat(F.lit("[ "), "props", F.lit(" ]")))
        .otherwise(F.col("props"))
    )
    return events.select(
        "event_id", F.posexplode(unwrap(parse_strict(doc))).alias("pos", "item")
    ).select("event_id", "pos", F.try_variant_get("item", "$.k", "bigint").alias("k"))


@query("""
    SELECT doc_id, CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END AS flag, CAST(quality AS VARCHAR) AS number,
           '' AS nothing, 'say "' || CAST(doc_id AS VARCHAR) || '"' AS quoted,
           CAST(doc_id AS VARCHAR) || '.50' AS literal, '-0.0' AS zero, '1e3' AS power, '' AS missing
    FROM labels
""")
def json_scalar_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of every scalar kind; numbers as they were written."""
    record = F.concat(
        F.lit('{"flag": '),
        F.when(F.col("toxic") == 1, "true").otherwise("false"),
        F.lit(', "number": '),
        "quality",
        F.lit(', "nothing": null, "quoted": "say \\"'),
        "doc_id",
        F.lit('\\"", "literal": '),
        "doc_id",
        F.lit('.50, "zero": -0.0, "power": 1e3}'),
    )
    names = ["flag", "number", "nothing", "quoted", "literal", "zero", "power", "missing"]
    records = table(spark, sf_dir, "labels").select("doc_id", record.alias("text"))
    return _texts(records, names, "doc_id")


@query("SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS o_totalprice FROM orders")
def json_number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal literals of a JSON record keep their text."""
    orders = table(spark, sf_dir, "orders")
    text = F.concat(F.lit('{"o_totalprice":'), F.col("o_totalprice").cast("string"), F.lit("}"))
    return _texts(orders.select("o_orderkey", text.alias("text")), ["o_totalprice"], "o_orderkey")


def _parties(spark: SparkSession, sf_dir: str) -> str:
    """Customers and suppliers as JSON arrays with different keys, in one folder."""
    customer = table(spark, sf_dir, "customer")
    supplier = table(spark, sf_dir, "supplier")
    parties = customer.select(
        F.col("c_custkey").alias("key"), F.lit("customer").alias("origin"), _rows(customer).alias("item")
    ).unionByName(
        supplier.select(
            F.col("s_suppkey").alias("key"), F.lit("supplier").alias("origin"), _rows(supplier).alias("item")
        )
    )
    return stage_arrays(parties, "key", F.col("item"), group=F.col("origin"))


@query("""
    SELECT DISTINCT unnest(json_keys(to_json(customer))) AS key FROM customer
    UNION SELECT DISTINCT unnest(json_keys(to_json(supplier))) FROM supplier
""")
def json_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys of all records of all files."""
    return key_union(scan_json(spark, _parties(spark, sf_dir)).records)


_PARTY_SQL = """
    SELECT CAST(c_acctbal AS VARCHAR) AS c_acctbal, CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment, c_name,
           CAST(c_nationkey AS VARCHAR) AS c_nationkey, '' AS s_acctbal, '' AS s_name, '' AS s_nationkey, '' AS s_suppkey
    FROM customer
    UNION ALL
    SELECT '', '', '', '', '', CAST(s_acctbal AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR), CAST(s_suppkey AS VARCHAR)
    FROM supplier
"""


@query(_PARTY_SQL)
def json_missing_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON folder to one table: the union of all keys, '' where a record lacks one."""
    return json_to_csv(spark, _parties(spark, sf_dir)).output


@query(f"""
    SELECT concat_ws(',', c_acctbal, c_custkey, c_mktsegment, c_name, c_nationkey, s_acctbal, s_name, s_nationkey, s_suppkey) AS line
    FROM ({_PARTY_SQL})
""")
def json_to_csv_dataset_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table, written as CSV files and read back as plain lines."""
    out = scratch_path(spark, "parties-csv")
    convert(spark, "jsonToCSV", _parties(spark, sf_dir), out)
    return spark.read.text(out).filter(~F.col("value").startswith("c_acctbal,")).select(
        F.col("value").alias("line")
    )


@query(f"""
    SELECT 'customer-' || CAST(c_custkey // {_BLOCK} AS VARCHAR) AS doc,
           ROW_NUMBER() OVER (PARTITION BY c_custkey // {_BLOCK} ORDER BY c_custkey) AS rec_no,
           concat_ws(',', CAST(c_acctbal AS VARCHAR), CAST(c_custkey AS VARCHAR), c_mktsegment, c_name, CAST(c_nationkey AS VARCHAR)) AS line
    FROM customer
    UNION ALL
    SELECT 'supplier-' || CAST(s_suppkey // {_BLOCK} AS VARCHAR),
           ROW_NUMBER() OVER (PARTITION BY s_suppkey // {_BLOCK} ORDER BY s_suppkey),
           concat_ws(',', CAST(s_acctbal AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR), CAST(s_suppkey AS VARCHAR))
    FROM supplier
""")
def json_to_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CSV document per JSON file, with that file's own keys."""
    output = json_to_csv(spark, _parties(spark, sf_dir), layout="per_file").output
    return output.select(staged_group(F.col("src_file")).alias("doc"), "rec_no", "line")


@query("""
    SELECT concat_ws(',', CAST(doc_id AS VARCHAR), '"' || replace(text, '"', '""') || '"', lang, source, CAST(n_chars AS VARCHAR)) AS line
    FROM documents WHERE contains(text, ',') OR contains(text, '"') OR contains(text, chr(10))
    UNION ALL
    SELECT concat_ws(',', CAST(doc_id AS VARCHAR), text, lang, source, CAST(n_chars AS VARCHAR)) FROM documents
    WHERE NOT (contains(text, ',') OR contains(text, '"') OR contains(text, chr(10)))
""")
def csv_line_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = as_text(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))
    return documents.select(csv_line([F.col(c) for c in documents.columns]).alias("line"))


_FORMAT_SQL = """
    SELECT CAST(CASE WHEN o_orderstatus = 'F'
        THEN to_json({'o_custkey': o_custkey, 'o_done': true, 'o_note': NULL, 'o_orderdate': CAST(o_orderdate AS VARCHAR), 'o_orderkey': o_orderkey, 'o_orderpriority': o_orderpriority, 'o_serial': CAST('12345678901234567890123456789' || CAST(o_orderkey + 1000000000 AS VARCHAR) || '0' AS VARCHAR)})
        ELSE to_json({'o_custkey': o_custkey, 'o_done': false, 'o_orderdate': CAST(o_orderdate AS VARCHAR), 'o_orderkey': o_orderkey, 'o_orderpriority': o_orderpriority, 'o_serial': CAST('12345678901234567890123456789' || CAST(o_orderkey + 1000000000 AS VARCHAR) || '0' AS VARCHAR)})
        END AS VARCHAR) AS json
    FROM orders
"""


def _shuffled_orders(spark: SparkSession, sf_dir: str) -> str:
    """Orders as JSON arrays: keys out of order, a null only in some records."""
    orders = table(spark, sf_dir, "orders")
    done = F.when(
        F.col("o_orderstatus") == "F", ', "o_note" : null, "o_done" : true'
    ).otherwise(', "o_done" : false')
    item = F.concat(
        F.lit('{ "o_orderpriority" : "'),
        "o_orderpriority",
        F.lit('", "o_orderkey" : '),
        "o_orderkey",
        done,
        F.lit(', "o_custkey":'),
        "o_custkey",
        F.lit(', "o_orderdate":"'),
        F.col("o_orderdate").cast("string"),
        F.lit('", "o_serial":"12345678901234567890123456789'),
        F.col("o_orderkey") + 1_000_000_000,
        F.lit('0" }'),
    )
    return stage_arrays(orders, "o_orderkey", item)


@query("""
    SELECT '{"a":1,"n":1234567890123456789012345678901234567890' || CAST(o_orderkey + 1000000000 AS VARCHAR)
        || ',"p":' || CAST(o_custkey AS VARCHAR) || ',"x":-0.12345678901234567890123456789012345678901,"z":"n, 12345678901234567890123456789012345678901"}' AS json
    FROM orders
""")
def format_json_long_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with more digits than any number type holds keep them."""
    item = F.concat(
        F.lit('{"z":"n, 12345678901234567890123456789012345678901", "n" :1234567890123456789012345678901234567890'),
        F.col("o_orderkey") + 1_000_000_000,
        F.lit(',"x":-0.12345678901234567890123456789012345678901, "p":'),
        F.col("o_custkey").cast("string"),
        F.lit(', "a":1}'),
    )
    return format_json(spark, stage_arrays(table(spark, sf_dir, "orders"), "o_orderkey", item)).output.select("json")


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_totalprice AS VARCHAR) || '0' AS price, '1e3' AS power
    FROM orders
""")
def json_literals_mixed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals of records that stand between items of other kinds."""
    item = F.concat(
        F.lit('7,"{",[1.50],{"o_orderkey":'), "o_orderkey", F.lit(',"price":'), F.col("o_totalprice").cast("string"), F.lit('0 , "power":1e3}'),
    )
    records = scan_json(spark, stage_arrays(table(spark, sf_dir, "orders"), "o_orderkey", item)).records
    return _texts(records, ["o_orderkey", "price", "power"])


@query("""
    SELECT repeat(',', CAST(rank - 1 AS BIGINT)) || CASE WHEN contains(text, ',') OR contains(text, '"') OR contains(text, chr(10))
               THEN '"' || replace(text, '"', '""') || '"' ELSE text END || repeat(',', CAST(n - rank AS BIGINT)) AS line
    FROM (SELECT text, ROW_NUMBER() OVER (ORDER BY 'k' || CAST(doc_id AS VARCHAR)) AS rank, COUNT(*) OVER () AS n FROM documents)
""")
def json_wide_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a column for every document, put together as text lines."""
    text = F.regexp_extract(F.to_json(F.struct("text")), r"(?s)^\{[^:]*:(.*)\}$", 1)
    item = F.concat(F.lit('{"k'), "doc_id", F.lit('":'), text, F.lit("}"))
    path = stage_arrays(table(spark, sf_dir, "documents"), "doc_id", item)
    return json_to_csv(spark, path, max_columns=10).output


@query(f"""
    SELECT lang || '-' || CAST(doc_id // {_BLOCK} AS VARCHAR) AS doc, CAST(COUNT(*) AS BIGINT) AS n_docs,
           CASE lang WHEN 'en' THEN 'Invalid input: JSON has no records to convert.' ELSE 'Invalid input: JSON is malformed.' END AS error_msg
    FROM documents GROUP BY ALL
""")
def json_to_csv_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of empty objects or damaged text: saved without a record, with their rejects."""
    documents = table(spark, sf_dir, "documents")
    item = F.when(F.col("lang") == "en", "{}").otherwise(F.concat(_rows(documents), F.lit("}")))
    out = scratch_path(spark, "nothing")
    convert(spark, "jsonToCSV", stage_arrays(documents, "doc_id", item, group=F.col("lang")), out)
    sizes = documents.groupBy(F.concat("lang", F.lit("-"), F.floor(F.col("doc_id") / 50_000)).alias("doc")).agg(F.count("*").alias("n_docs"))
    written = spark.read.text(out).count()
    rejects = spark.read.parquet(f"{out}_rejects").select(staged_group(F.col("src_file")).alias("doc"), "error_msg")
    return rejects.join(sizes, "doc").withColumn("n_docs", F.col("n_docs") + written)


@query(_FORMAT_SQL, name="format_json")
def format_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted keys; types and nulls kept, missing keys stay missing."""
    return format_json(spark, _shuffled_orders(spark, sf_dir)).output.select("json")


@query(_FORMAT_SQL)
def format_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as pretty documents, written, read back and formatted again."""
    out = scratch_path(spark, "formatted")
    convert(spark, "formatJSONByLine", _shuffled_orders(spark, sf_dir), out, layout="array")
    return format_json(spark, out).output.select("json")


@query(f"""
    SELECT p_partkey // {_BLOCK} AS block, p_partkey % {_BLOCK} + 1 AS rec_no,
           'Invalid input: Only flat JSON is supported. Field '''
           || CASE p_brand WHEN 'Brand#7' THEN 'p_brand' ELSE 'p_size' END || ''' contains a nested value.' AS error_msg
    FROM part WHERE p_brand IN ('Brand#7', 'Brand#11')
""")
def flat_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a nested value are rejected by number, with the smallest key at fault."""
    part = table(spark, sf_dir, "part")
    item = F.concat(
        F.lit('{"p_size":'),
        F.when(F.col("p_brand").isin("Brand#7", "Brand#11"), "[]").otherwise(F.col("p_size").cast("string")),
        F.lit(',"p_brand":'),
        F.when(F.col("p_brand") == "Brand#7", '{"no":{"deep":7}}').otherwise(
            F.concat(F.lit('"'), "p_brand", F.lit('"'))
        ),
        F.lit(',"p_partkey":'),
        "p_partkey",
        F.lit("}"),
    )
    rejects = scan_json(spark, stage_arrays(part, "p_partkey", item)).rejects
    return rejects.select(
        staged_group(F.col("src_file")).cast("bigint").alias("block"), "rec_no", "error_msg"
    )


@query("""
    SELECT 'Invalid input: Only flat JSON is supported. Field ''embedding'' contains a nested value.' AS error_msg,
           COUNT(*) AS n
    FROM embeddings
""")
def flat_validate_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "embeddings-lines")
    table(spark, sf_dir, "embeddings").write.json(path)
    rejects = scan_json_lines(spark, path).rejects
    return rejects.groupBy("error_msg").agg(F.count("*").alias("n"))


@query(f"""
    SELECT doc_id // {_BLOCK} AS block, doc_id % {_BLOCK} + 1 AS rec_no,
           'Invalid input: Array item ' || CAST(doc_id % {_BLOCK} + 1 AS VARCHAR) || ' is not a JSON object.' AS error_msg
    FROM documents WHERE lang <> 'en'
""")
def array_item_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an array that are texts, numbers or arrays, by position."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    item = (
        F.when(F.col("lang") == "fr", F.regexp_extract(F.to_json(F.struct("text")), r"(?s)^\{[^:]*:(.*)\}$", 1))
        .when(F.col("lang") == "de", F.col("doc_id").cast("string"))
        .when(F.col("lang") == "es", F.concat(F.lit("["), "doc_id", F.lit(',{"x":"}"}]')))
        .otherwise(_rows(documents))
    )
    rejects = scan_json(spark, stage_arrays(documents, "doc_id", item)).rejects
    return rejects.select(
        staged_group(F.col("src_file")).cast("bigint").alias("block"), "rec_no", "error_msg"
    )


@query("""
    SELECT doc_id, CASE lang WHEN 'en' THEN 'OBJECT' WHEN 'fr' THEN 'STRING' WHEN 'de' THEN 'VOID' ELSE 'ARRAY' END AS kind
    FROM documents
""")
def json_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of a JSON value."""
    configure(spark)
    documents = table(spark, sf_dir, "documents")
    doc = F.to_json(F.struct("text"))
    value = (
        F.when(F.col("lang") == "fr", F.regexp_extract(doc, r"(?s)^\{[^:]*:(.*)\}$", 1))
        .when(F.col("lang") == "de", "null")
        .when(F.col("lang") == "es", F.concat(F.lit("["), doc, F.lit("]")))
        .otherwise(doc)
    )
    name = F.regexp_extract(kind(parse_strict(value)), "^[A-Z]+", 0)
    return documents.select("doc_id", name.alias("kind"))
