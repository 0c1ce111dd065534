"""Queries over CSV files staged from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json import object_json
from ..functions.text import csv_escape, csv_line, file_name, trim_whitespace
from ..operators.header import header_names
from ..plans.pipelines import convert, csv_to_json
from ..session import materialise, scratch_path
from ..sources.csv_files import inspect_csv, scan_csv
from ..sources.json_files import scan_json
from .registry import query, table
from .stage import as_text, small_splits, stage_csv, stage_lines, staged_group

# Same block size as in stage.py, for the SQL side.
_BLOCK = "50000"


def _text_sql(name: str, columns: str) -> str:
    cells = ", ".join(f"COALESCE(CAST({c} AS VARCHAR), '') AS {c}" for c in columns.split())
    return f"SELECT {cells} FROM {name}"


def _cells(records: DataFrame, names: list[str]) -> DataFrame:
    return records.select(*[F.element_at("rec", F.lit(c)).alias(c) for c in names])


def _round_trip(spark: SparkSession, df: DataFrame) -> DataFrame:
    return _cells(scan_csv(spark, stage_csv(as_text(df), "round-trip")).records, df.columns)


@query(_text_sql("documents", "doc_id text lang source n_chars"))
def csv_roundtrip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, table(spark, sf_dir, "documents"))


@query(_text_sql("pages", "page_id url html"))
def csv_roundtrip_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, table(spark, sf_dir, "pages"))


@query(_text_sql("customer", "c_custkey c_name c_nationkey c_acctbal c_mktsegment"))
def csv_roundtrip_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, table(spark, sf_dir, "customer"))


@query(
    _text_sql(
        "lineitem",
        "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax"
        " l_returnflag l_linestatus l_shipdate",
    )
)
def csv_roundtrip_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, table(spark, sf_dir, "lineitem"))


@query(_text_sql("conversations", "conv_id turn role text"))
def csv_roundtrip_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, table(spark, sf_dir, "conversations"))


@query(_text_sql("documents", "doc_id text lang source n_chars"))
def csv_stitch_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many splits, so that most texts cross a border."""
    documents = table(spark, sf_dir, "documents")
    path = stage_csv(as_text(documents), "stitch")
    with small_splits(spark):
        return materialise(_cells(scan_csv(spark, path).records, documents.columns), "stitched")


_STRAY_SQL = """
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, text FROM documents
    UNION ALL SELECT 'a"' || CAST(doc_id AS VARCHAR), lang || '"', source, 'x' FROM documents
    UNION ALL SELECT '"b" ' || CAST(doc_id AS VARCHAR), '', source, 'two' || chr(10) || 'lines' FROM documents
"""


def _stray_quotes(spark: SparkSession, sf_dir: str) -> str:
    """Documents, each followed by a record with quotes inside its fields and one with text
    after a closing quote and a line break inside quotes."""
    documents = as_text(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    line = F.concat(
        csv_line([F.col(c) for c in documents.columns]),
        F.lit('\na"'), "doc_id", F.lit(","), "lang", F.lit('",'), "source", F.lit(",x"),
        F.lit('\n"b" '), "doc_id", F.lit(',"",'), "source", F.lit(',"two\nlines"'),
    )
    return stage_lines(documents, "doc_id", F.lit(",".join(documents.columns)), line, group=F.col("lang"))


@query(_STRAY_SQL)
def csv_stray_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that do not begin a field are data, over any number of lines."""
    return _cells(scan_csv(spark, _stray_quotes(spark, sf_dir)).records, ["doc_id", "lang", "source", "text"])


@query(_STRAY_SQL)
def csv_route_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files in many splits give the same records."""
    path = _stray_quotes(spark, sf_dir)
    with small_splits(spark):
        records = scan_csv(spark, path).records
        return materialise(_cells(records, ["doc_id", "lang", "source", "text"]), "parity")


@query(_text_sql("documents", "doc_id text lang source n_chars"))
def csv_leading_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank lines of every kind before the header and between records."""
    documents = as_text(table(spark, sf_dir, "documents"))
    blank = F.when(F.col("lang") == "en", "  \n").when(F.col("lang") == "de", "\t\n\u00a0\n").otherwise("\n\r\n\u2003 \n")
    header = F.concat(blank, F.lit(",".join(documents.columns)))
    line = F.concat(csv_line([F.col(c) for c in documents.columns]), F.lit("\n"), F.substring_index(blank, "\n", 1))
    path = stage_lines(documents, "doc_id", header, line, group=F.col("lang"))
    return _cells(scan_csv(spark, path).records, documents.columns)


@query("""
    SELECT chr(31) AS c_custkey, '' AS c_name, '' AS c_acctbal FROM customer
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, CAST(c_acctbal AS VARCHAR) FROM customer
""")
def csv_control_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of one control character is a record and no blank line."""
    names = ["c_custkey", "c_name", "c_acctbal"]
    customer = as_text(table(spark, sf_dir, "customer").select(*names))
    line = F.concat(csv_line([F.col(c) for c in names]), F.lit("\n\x1f"))
    path = stage_lines(customer, "c_custkey", F.lit(",".join(names)), line)
    return _cells(scan_csv(spark, path).records, names)


_ORDERS = "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority"


@query(_text_sql("orders", _ORDERS))
def csv_scan_line_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that end in CRLF."""
    orders = as_text(table(spark, sf_dir, "orders").select(*_ORDERS.split()))
    path = stage_lines(
        orders,
        "o_orderkey",
        F.lit(",".join(orders.columns) + "\r"),
        F.concat(csv_line([F.col(c) for c in orders.columns]), F.lit("\r")),
    )
    records = scan_csv(spark, path).records
    return records.select(*[F.element_at("rec", F.lit(c)).alias(c) for c in orders.columns])


def _drifting_customers(spark: SparkSession, sf_dir: str) -> str:
    """Customer files whose column order depends on the market segment."""
    customer = as_text(
        table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    )
    swapped = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    return stage_lines(
        customer,
        "c_custkey",
        F.when(swapped, "c_name,c_acctbal,c_custkey").otherwise("c_custkey,c_name,c_acctbal"),
        F.when(swapped, csv_line([F.col(c) for c in ("c_name", "c_acctbal", "c_custkey")])).otherwise(
            csv_line([F.col(c) for c in ("c_custkey", "c_name", "c_acctbal")])
        ),
        group=F.col("c_mktsegment"),
    )


@query(f"""
    WITH files AS (
        SELECT c_mktsegment || '-' || CAST(c_custkey // {_BLOCK} AS VARCHAR) AS doc,
               c_mktsegment IN ('BUILDING', 'MACHINERY') AS swapped, COUNT(*) AS n_rows
        FROM customer GROUP BY ALL)
    SELECT doc, 1 AS position, CASE WHEN swapped THEN 'c_name' ELSE 'c_custkey' END AS name, n_rows FROM files
    UNION ALL
    SELECT doc, 2, CASE WHEN swapped THEN 'c_acctbal' ELSE 'c_name' END, n_rows FROM files
    UNION ALL
    SELECT doc, 3, CASE WHEN swapped THEN 'c_custkey' ELSE 'c_acctbal' END, n_rows FROM files
""")
def csv_header_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header names and number of data rows of every file."""
    scan = scan_csv(spark, _drifting_customers(spark, sf_dir), numbered=True)
    return scan.files.join(scan.counts, "src_file").select(
        staged_group(F.col("src_file")).alias("doc"),
        F.posexplode("names").alias("at", "name"),
        F.col("n_records").alias("n_rows"),
    ).select("doc", (F.col("at") + 1).alias("position"), "name", "n_rows")


@query("""
    SELECT CAST(c_custkey AS VARCHAR) AS custkey, 'c_custkey' AS key, CAST(c_custkey AS VARCHAR) AS value FROM customer
    UNION ALL
    SELECT CAST(c_custkey AS VARCHAR), 'c_name', c_name FROM customer
    UNION ALL
    SELECT CAST(c_custkey AS VARCHAR), 'c_acctbal', CAST(c_acctbal AS VARCHAR) FROM customer
""")
def csv_bind_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields bound to the header of their own file, as key-value rows."""
    records = scan_csv(spark, _drifting_customers(spark, sf_dir)).records
    return records.select(
        F.element_at("rec", F.lit("c_custkey")).alias("custkey"), F.explode("rec").alias("key", "value")
    )


@query("""
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, ' ' || c_name || ' ' AS c_name,
           CAST(c_acctbal AS VARCHAR) || chr(9) AS c_acctbal
    FROM customer
""")
def header_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names lose surrounding Unicode whitespace, values keep it."""
    customer = as_text(table(spark, sf_dir, "customer"))
    path = stage_lines(
        customer,
        "c_custkey",
        F.lit(" c_custkey\t, c_name , c_acctbal　"),
        F.concat_ws(
            ",", "c_custkey", F.concat(F.lit(" "), "c_name", F.lit(" ")), F.concat("c_acctbal", F.lit("\t"))
        ),
    )
    records = scan_csv(spark, path).records
    names = ["c_custkey", "c_name", "c_acctbal"]
    return records.select(*[F.element_at("rec", F.lit(c)).alias(c) for c in names])


@query(r"""
    SELECT doc_id, regexp_replace(text, '^[\t\n\x0B\f\r\x{85}\p{Z}]+|[\t\n\x0B\f\r\x{85}\p{Z}]+$', '', 'g') AS trimmed
    FROM documents
""")
def trim_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit(" \t\n "), "text", F.lit(" \u0085\r\n "))
    return table(spark, sf_dir, "documents").select("doc_id", trim_whitespace(padded).alias("trimmed"))


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
           CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END AS o_orderstatus,
           CASE WHEN o_orderstatus = 'F' THEN '' ELSE CAST(o_totalprice AS VARCHAR) END AS o_totalprice,
           CASE WHEN o_orderstatus = 'F' THEN '' ELSE CAST(o_orderdate AS VARCHAR) END AS o_orderdate,
           CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS o_orderpriority
    FROM orders
""")
def csv_ragged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows shorter than the header are padded, longer ones cut."""
    names = _ORDERS.split()
    orders = as_text(table(spark, sf_dir, "orders").select(*names))
    full = csv_line([F.col(c) for c in names])
    line = (
        F.when(F.col("o_orderstatus") == "F", csv_line([F.col(c) for c in names[:2]]))
        .when(F.col("o_orderstatus") == "P", F.concat(full, F.lit(',extra,"one, more"')))
        .otherwise(full)
    )
    records = scan_csv(spark, stage_lines(orders, "o_orderkey", F.lit(",".join(names)), line)).records
    return records.select(*[F.element_at("rec", F.lit(c)).alias(c) for c in names])


@query("""
    SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS id, c_name AS name
    FROM customer
""")
def csv_duplicate_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two columns of one name the later wins, also where it is padded."""
    customer = as_text(table(spark, sf_dir, "customer"))
    both = csv_line([F.col("c_custkey"), F.col("c_name")])
    line = F.when(F.col("c_mktsegment") == "BUILDING", both).otherwise(
        F.concat(both, F.lit(","), "c_nationkey")
    )
    records = scan_csv(spark, stage_lines(customer, "c_custkey", F.lit("id,name,id"), line)).records
    return records.select(*[F.element_at("rec", F.lit(c)).alias(c) for c in ("id", "name")])


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
           CAST(o_totalprice AS VARCHAR) AS o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority
    FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')
""")
def blank_row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of blank fields only are no records."""
    names = _ORDERS.split()
    orders = as_text(table(spark, sf_dir, "orders").select(*names))
    line = (
        F.when(F.col("o_orderpriority") == "1-URGENT", " ,\t, ")
        .when(F.col("o_orderpriority") == "5-LOW", '""," ",," "')
        .otherwise(csv_line([F.col(c) for c in names]))
    )
    records = scan_csv(spark, stage_lines(orders, "o_orderkey", F.lit(",".join(names)), line)).records
    return records.select(*[F.element_at("rec", F.lit(c)).alias(c) for c in names])


_ESCAPE_SQL = (
    "CASE WHEN contains({0}, ',') OR contains({0}, '\"') OR contains({0}, chr(10))"
    " THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"
)


@query(f"""
    SELECT 'documents' AS origin, doc_id AS id, {_ESCAPE_SQL.format("text")} AS escaped FROM documents
    UNION ALL
    SELECT 'pages', page_id, {_ESCAPE_SQL.format("html")} FROM pages
""", name="csv_escape")
def csv_escape_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), csv_escape(F.col("text")).alias("escaped")
    )
    pages = table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("origin"), F.col("page_id").alias("id"), csv_escape(F.col("html")).alias("escaped")
    )
    return documents.unionByName(pages)


@query("""
    SELECT CAST(to_json({'c_acctbal': CAST(c_acctbal AS VARCHAR), 'c_custkey': CAST(c_custkey AS VARCHAR),
        'c_mktsegment': c_mktsegment, 'c_name': c_name, 'c_nationkey': CAST(c_nationkey AS VARCHAR)}) AS VARCHAR) AS json
    FROM customer
""")
def csv_to_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV folder to JSON objects with sorted keys."""
    path = stage_csv(as_text(table(spark, sf_dir, "customer")), "customer-csv")
    return csv_to_json(spark, path).output.select("json")


@query("""
    SELECT CAST(to_json({'doc_id': CAST(doc_id AS VARCHAR), 'lang': lang, 'n_chars': CAST(n_chars AS VARCHAR),
        'source': source, 'text': text}) AS VARCHAR) AS json
    FROM documents
""")
def csv_to_json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_csv(as_text(table(spark, sf_dir, "documents")), "documents-csv")
    return csv_to_json(spark, path).output.select("json")


@query("""
    SELECT page_id, CAST(to_json({'html': html, 'url': url}) AS VARCHAR) AS json FROM pages
""")
def json_object_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON object of a text map, whatever the order its keys came in."""
    rec = F.create_map(F.lit("url"), F.col("url"), F.lit("html"), F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", object_json(rec).alias("json"))


@query(f"""
    SELECT c_mktsegment || '-' || CAST(c_custkey // {_BLOCK} AS VARCHAR) AS doc,
           ROW_NUMBER() OVER (PARTITION BY c_mktsegment, c_custkey // {_BLOCK} ORDER BY c_custkey) AS rec_no,
           CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
           CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment
    FROM customer
""")
def csv_to_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pretty JSON array per CSV file, written and read back in order."""
    customer = as_text(table(spark, sf_dir, "customer"))
    names = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    path = stage_lines(
        customer,
        "c_custkey",
        F.lit(",".join(names)),
        csv_line([F.col(c) for c in names]),
        group=F.col("c_mktsegment"),
    )
    out = scratch_path(spark, "json-arrays")
    planned = convert(spark, "csvToJSON", path, out, layout="array")
    records = scan_json(spark, out, numbered=True).records
    staged = planned.files.select(staged_group(F.col("src_file")).alias("doc"), "out_name")
    row = F.from_json("text", ", ".join(f"{c} string" for c in names))
    name = F.url_decode(file_name(F.col("src_file")))
    return records.select(name.alias("out_name"), "rec_no", row.alias("r")).join(staged, "out_name").select("doc", "rec_no", "r.*")


@query(f"""
    SELECT 'b' || CAST(doc_id // {_BLOCK} AS VARCHAR) || '-' || lang AS doc,
           CASE lang WHEN 'de' THEN 'Invalid input: CSV contains an unclosed quote.'
                     WHEN 'fr' THEN 'Invalid input: Input is not valid UTF-8 text.'
                     WHEN 'es' THEN 'Invalid input: CSV is empty or missing a header row.' END AS error_msg,
           COUNT(*) AS n
    FROM documents GROUP BY ALL
""")
def csv_file_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files ruled out by one bad byte, one open quote or no header."""
    documents = table(spark, sf_dir, "documents").withColumn(
        "doc", F.concat(F.lit("b"), F.floor(F.col("doc_id") / 50_000), F.lit("-"), "lang")
    )
    bad_byte = F.expr("cast(X'FF' as string)")
    text = F.replace("text", F.lit('"'), F.lit('""'))
    line = (
        F.when(F.col("lang") == "de", F.concat(F.lit('1,"'), text, F.lit('"')))
        .when(F.col("lang") == "fr", F.concat(F.lit('1,"'), text, bad_byte, F.lit('"')))
        .when(F.col("lang") == "es", F.lit(""))
        .otherwise(F.concat(F.lit('1,"'), text, F.lit('"')))
    )
    header = F.when(F.col("lang") == "de", 'id,"text').when(F.col("lang") == "es", "").otherwise("id,text")
    path = stage_lines(documents, "doc_id", header, line, group=F.col("lang"))
    verdicts = inspect_csv(spark, path).select(
        staged_group(F.col("src_file")).alias("staged"),
        F.when(F.col("error").isNotNull(), F.concat(F.lit("Invalid input: "), "error")).alias("error_msg"),
    )
    sizes = documents.groupBy(
        "doc", F.concat("lang", F.lit("-"), F.floor(F.col("doc_id") / 50_000)).alias("staged")
    ).agg(F.count("*").alias("n"))
    return sizes.join(verdicts, "staged").select("doc", "error_msg", "n")


@query("""
    SELECT doc_id, CAST(1 AS INTEGER) AS position, 'n' || CAST(doc_id AS VARCHAR) AS name FROM documents
    UNION ALL
    SELECT doc_id, 2, regexp_replace(text, '^[\\t\\n\\x0B\\f\\r\\x{85}\\p{Z}]+|[\\t\\n\\x0B\\f\\r\\x{85}\\p{Z}]+$', '', 'g') FROM documents
""")
def csv_header_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a header record, quoted ones with line breaks included."""
    header = csv_line([F.concat(F.lit(" n"), "doc_id"), F.col("text")])
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(header_names(header)).alias("at", "name")
    ).select("doc_id", (F.col("at") + 1).alias("position"), "name")
