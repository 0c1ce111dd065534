"""Key discovery and rendering against a fixed key list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.json import last_value, let, scalar_texts
from ..functions.text import csv_escape
from ..session import broadcast_if_small, materialise, small_pages
from .numbering import carry_in

# Up to this many keys become columns of a plan; a wider table is made of text lines.
MAX_COLUMNS = 20_000


def key_union(records: DataFrame, text: str = "text") -> DataFrame:
    """Distinct keys of all records: one column ``key``. Duplicates are dropped map-side."""
    return records.select(F.explode(F.json_object_keys(text)).alias("key")).distinct()


def keys_by_file(records: DataFrame) -> DataFrame:
    """``src_file, keys``: sorted distinct keys of each file.

    Records are first reduced to distinct (file, key) pairs, so a hot file costs
    its number of keys, not its number of records.
    """
    pairs = records.select("src_file", F.explode(F.json_object_keys("text")).alias("key"))
    return pairs.distinct().groupBy("src_file").agg(F.array_sort(F.collect_list("key")).alias("keys"))


def sorted_keys(keys: DataFrame) -> list[str]:
    """Distinct keys on the driver, in UTF-8 byte order; their number is checked before."""
    return sorted((r.key for r in keys.collect()), key=lambda k: k.encode())


# Up to this many keys over all files, records are parsed into fixed fields.
FIXED_FIELDS = 1_000


def file_keys(records: DataFrame) -> tuple[DataFrame, list[str] | None]:
    """``src_file, keys, positions`` and the union of all keys, or None when it is wide."""
    keyed = materialise(keys_by_file(records), "file-keys")
    union = keyed.select(F.explode("keys").alias("key")).distinct()
    if union.limit(FIXED_FIELDS + 1).count() > FIXED_FIELDS:
        return keyed.withColumn("positions", F.lit(None).cast("array<int>")), None
    names = sorted_keys(union)
    known = F.array(*map(F.lit, names))
    at = F.transform("keys", lambda k: (F.array_position(known, k) - 1).cast("int"))
    return keyed.withColumn("positions", at), names


def values_of_file(text: Column, union: list[str] | None) -> Column:
    """Texts of one record under the ``keys`` (at ``positions`` of ``union``) of its file."""
    if union is not None:
        return let(
            F.array(*cells(union, text)),
            lambda values: F.transform("positions", lambda i: F.get(values, i)),
        )
    return let(
        scalar_texts(text, "map<string,string>"),
        lambda rec: F.transform("keys", lambda k: F.coalesce(last_value(rec, k), F.lit(""))),
    )


def wide_lines(records: DataFrame, union: DataFrame, n_keys: int) -> DataFrame:
    """CSV lines of records under the sorted keys of ``union``, too many to be columns; ordered by place.

    The values of a record are joined to the numbers of their keys, and the commas between them put in
    at once, so a record costs its own keys and the bytes of its line. Of the keys nothing is gathered.
    A line has a byte for every key, so whoever writes lines as Parquet must not hold many of them.
    """
    small_pages(records.sparkSession)
    ranked = materialise(
        union.orderBy("key").select(
            "key", F.lit("").alias("src_file"), F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("ord")
        ),
        "ranked-keys",
    )
    blocks = ranked.groupBy("src_file", "task").agg(F.min("ord").alias("first_ord"), F.count("*").alias("n"))
    before = F.broadcast(carry_in(blocks, "n", "before", block="task").select("task", "first_ord", "before"))
    ranked = ranked.join(before, "task").select("key", (F.col("ord") - F.col("first_ord") + F.col("before")).cast("int").alias("rank"))
    place = ["src_file", "split_start", "ord"]
    fields = F.map_entries(scalar_texts(F.col("text"), "map<string,string>"))
    pairs = records.select(*place, F.posexplode_outer(fields).alias("at", "field")).select(*place, "at", "field.key", "field.value")
    cell = F.struct("rank", "at", csv_escape(F.coalesce("value", F.lit(""))).alias("cell"))
    rows = (
        pairs.join(broadcast_if_small(materialise(ranked, "key-ranks")), "key", "left")
        .groupBy(*place)
        .agg(F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), cell))).alias("cells"))
        .orderBy(*place)
    )

    cells = F.col("cells")
    rank = lambda i: F.get(cells, i)["rank"]
    # Of equal keys the later wins.
    shown = F.transform(
        cells,
        lambda c, i: F.concat(
            F.repeat(F.lit(","), c["rank"] - F.when(i > 0, rank(i - 1)).otherwise(c["rank"])),
            F.when(c["rank"] == rank(i + 1), "").otherwise(c["cell"]),
        ),
    )
    first, last = (F.coalesce(rank(i), F.lit(0)) for i in (F.lit(0), F.size(cells) - 1))
    line = F.concat_ws("", F.repeat(F.lit(","), first), shown, F.repeat(F.lit(","), F.lit(n_keys - 1) - last))
    return rows.select(line.alias("line"))


def text_schema(keys: list[str]) -> T.StructType:
    return T.StructType([T.StructField(k, T.StringType()) for k in keys])


def cells(keys: list[str], text: Column) -> list[Column]:
    """Text of every key of one record; a missing key and null give ''.

    Run under ``case_sensitive``: keys may differ in case only.
    """
    row = scalar_texts(text, text_schema(keys))
    return [F.coalesce(row.getField(k), F.lit("")) for k in keys]
