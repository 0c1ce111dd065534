"""Join text pieces back to whole records where a separator was inside quotes.

A piece starts a record when the number of quotes before it in the file is
even. Counting quotes is a sum, so it needs no pass over the file in one task:
the totals per split are summed first, then the pieces of each split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import carry_in
from ..session import broadcast_if_small, materialise


# A quote opened early and closed late makes most of a file one record. Such a
# record is not gathered in one task; it is reported instead.
MAX_RECORD_BYTES = 256 << 20


def stitch(
    pieces: DataFrame,
    n_quotes: Column,
    separator: str,
    limit: int,
    stand_in: Callable[[Column, Column], Column],
    weigh: Callable[[Column], Column],
) -> DataFrame:
    """Records as ``src_file, rec_no, text, long_size, long_weight``; ``rec_no`` counts from 1.

    The pieces are shuffled once, by split, so a task never holds more than one
    split of a file. Only records that cross a split border are shuffled again.
    A record of more than ``limit`` bytes is never put together: its text is
    ``stand_in`` of its first and last part, ``long_size`` its bytes and ``long_weight`` the sum
    of ``weigh`` over its parts, each with a quote before it if it begins inside quotes.
    Both are null for all other records.
    """
    split = ["src_file", "split_start", "split_len"]
    counted = pieces.withColumn("quotes", n_quotes)
    quotes = counted.groupBy(*split).agg(F.sum("quotes").alias("quotes"))
    parity = carry_in(quotes, "quotes", "quotes_before", block="split_start").select(
        *split,
        (F.col("quotes_before") % 2).alias("odd_in"),
        ((F.col("quotes_before") + F.col("quotes")) % 2).alias("odd_out"),
    )

    in_split = Window.partitionBy(*split).orderBy("ord")
    earlier = in_split.rowsBetween(Window.unboundedPreceding, -1)
    so_far = in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    odd_in = F.when(
        F.col("odd_in").isNull(),
        F.raise_error(F.lit("The file splits changed between two scans; run again.")).cast("long"),
    ).otherwise(F.col("odd_in"))
    marked = (
        counted.join(parity, split, "left")
        .withColumn("inside", (odd_in + F.coalesce(F.sum("quotes").over(earlier), F.lit(0))) % 2)
        .withColumn("start", F.when(F.col("inside") == 0, 1).otherwise(0))
        .withColumn("nth", F.sum("start").over(so_far))
    )
    # nth = 0 is the rest of a record that began in an earlier split.
    parts = materialise(
        marked.groupBy(*split, "odd_out", "nth").agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("ord", "piece"))), lambda p: p["piece"]
                ),
                separator,
            ).alias("part")
        ),
        "record-parts",
    )
    per_split = parts.groupBy(*split).agg(F.max("nth").alias("starts"))
    numbered = (
        parts.join(carry_in(per_split, "starts", "before", block="split_start"), split)
        .withColumn("rec_no", F.col("before") + F.col("nth"))
        .withColumn(
            "crosses",
            (F.col("nth") == 0) | ((F.col("nth") == F.col("starts")) & (F.col("odd_out") == 1)),
        )
    )
    size, part = F.octet_length("part").cast("bigint"), F.col("part")
    none = F.lit(None).cast("bigint")
    too_long = size > limit
    whole = numbered.filter(~F.col("crosses")).select(
        "src_file",
        "rec_no",
        F.when(too_long, stand_in(part, part)).otherwise(part).alias("text"),
        F.when(too_long, size).alias("long_size"),
        F.when(too_long, weigh(part).cast("bigint")).alias("long_weight"),
    )
    crossing, record = numbered.filter("crosses"), ["src_file", "rec_no"]
    sizes = crossing.groupBy(*record).agg((F.sum(size) + F.count("*") - 1).alias("long_size"))
    long = broadcast_if_small(materialise(sizes.filter(F.col("long_size") > limit), "long-records"))
    joined = (
        crossing.join(long, record, "left_anti")
        .groupBy(*record)
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("split_start", "part"))),
                    lambda p: p["part"],
                ),
                separator,
            ).alias("text")
        )
        .select(*record, "text", none.alias("long_size"), none.alias("long_weight"))
    )
    # Per part, so that only short texts and numbers of a long record meet.
    outside = F.when(F.col("nth") == 0, F.concat(F.lit('"'), part)).otherwise(part)
    kept = crossing.join(long, record).select(
        *record, "long_size", "split_start", stand_in(part, F.lit("")).alias("head"), stand_in(F.lit(""), part).alias("end"), weigh(outside).alias("weight")
    )
    stood_in = kept.groupBy(*record, "long_size").agg(
        F.concat(F.min_by("head", "split_start"), F.max_by("end", "split_start")).alias("text"),
        F.sum("weight").cast("bigint").alias("long_weight"),
    )
    return whole.unionByName(joined).unionByName(stood_in)


def _line_state(lines: Column) -> Column:
    """What a run of lines does: ``f0`` and ``f1`` tell whether it ends inside quotes if it
    begins outside or inside of them."""
    return F.aggregate(
        lines,
        F.struct(F.lit(False).alias("f0"), F.lit(True).alias("f1")),
        lambda s, x: F.struct(
            F.when(s["f0"], x["stays"]).otherwise(x["opens"]).alias("f0"),
            F.when(s["f1"], x["stays"]).otherwise(x["opens"]).alias("f1"),
        ),
    )


def ended(text: Column) -> Column:
    """The text of a record without the break behind its last line."""
    return F.regexp_replace(text, r"(?:\r\n|\n|\r)\z", "")


def acting_lines() -> Column:
    """The lines of a group that may change whether the next one begins inside quotes."""
    return F.collect_list(F.when(F.col("opens") | ~F.col("stays"), F.struct("ord", "sub", "opens", "stays")))


def line_runs(acting: Column) -> Column:
    """What the lines of a split, as collected, do to quotes."""
    return _line_state(F.array_sort(acting))


def stitch_lines(lines: DataFrame, largest_file: int, runs: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """CSV records as ``src_file, rec_no, filled, text`` from lines that know what they do to quotes.

    ``text`` still has the break behind it (``ended``); ``filled`` tells whether a line of it is
    not blank. Whether a line begins inside quotes follows from the lines before it; what a run
    of lines does can be put together, so splits are summed up first and the lines of a
    split are placed then. The lines are shuffled once, by split; only records that cross a
    split border are shuffled again. The second result has ``src_file, rec_no`` of records
    too long for a row, if a file of more bytes than the limit is there to hold one; the third
    whether each file ends inside quotes. ``runs`` has the ``run`` of every split, if the same
    splits were summed up before.
    """
    split = ["src_file", "split_start", "split_len"]
    if runs is None:
        runs = lines.groupBy(*split).agg(line_runs(acting_lines()).alias("run"))
    in_file = runs.groupBy("src_file").agg(
        F.array_sort(F.collect_list(F.struct("split_start", "split_len", F.col("run.f0").alias("opens"), F.col("run.f1").alias("stays")))).alias("runs")
    )
    # Splits of one file are few; the state is carried through them in one fold.
    fold = F.aggregate(
        "runs",
        F.struct(F.lit(False).alias("s"), F.array().cast("array<boolean>").alias("ins")),
        lambda a, x: F.struct(F.when(a["s"], x["stays"]).otherwise(x["opens"]).alias("s"), F.array_append(a["ins"], a["s"]).alias("ins")),
    )
    in_file = materialise(in_file.withColumn("fold", fold), "split-runs")
    unclosed = in_file.select("src_file", F.col("fold.s").alias("unclosed"))
    places = in_file.select("src_file", F.explode(F.arrays_zip("runs", F.col("fold.ins").alias("ins"))).alias("x"))
    places = places.select("src_file", "x.runs.split_start", "x.runs.split_len", F.col("x.ins").alias("inside_in"))
    places = broadcast_if_small(places)

    in_split = Window.partitionBy(*split).orderBy("ord", "sub")
    earlier = in_split.rowsBetween(Window.unboundedPreceding, -1)
    so_far = in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A line either sets the state or, now and then, turns it over.
    sets = F.when(F.col("opens") == F.col("stays"), F.struct("opens", F.col("turns").alias("turned")))
    known = F.coalesce(F.col("last_set.opens"), F.col("inside_in"))
    since = F.coalesce(F.col("turns_before"), F.lit(0)) - F.coalesce(F.col("last_set.turned"), F.lit(0))
    inside = F.when(since % 2 == 1, ~known).otherwise(known)
    checked = F.when(F.col("inside_in").isNull(), F.raise_error(F.lit("The file splits changed between two scans; run again.")).cast("boolean"))
    marked = (
        lines.join(places, split, "left")
        .withColumn("inside_in", F.coalesce(checked, F.col("inside_in")))
        .withColumn("turn", (F.col("opens") & ~F.col("stays")).cast("int"))
        .withColumn("turns", F.sum("turn").over(so_far))
        .withColumn("turns_before", F.sum("turn").over(earlier))
        .withColumn("last_set", F.last(sets, ignorenulls=True).over(earlier))
        .withColumn("start", F.when(inside, 0).otherwise(1))
        .withColumn("ends_inside", F.when(inside, F.col("stays")).otherwise(F.col("opens")))
        .withColumn("nth", F.sum("start").over(so_far))
    )
    # nth = 0 is the rest of a record that began in an earlier split.
    parts = materialise(
        marked.groupBy(*split, "nth").agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("ord", "sub", "line", "sep"))), lambda p: F.concat(p["line"], p["sep"])), ""
            ).alias("part"),
            F.max_by("ends_inside", F.struct("ord", "sub")).alias("open_end"),
            F.max("filled").alias("filled"),
        ),
        "record-parts",
    )
    per_split = parts.groupBy(*split).agg(F.max("nth").alias("starts"))
    carried = broadcast_if_small(materialise(carry_in(per_split, "starts", "before", block="split_start"), "split-starts"))
    numbered = parts.join(carried, split).withColumn("rec_no", F.col("before") + F.col("nth")).withColumn(
        "crosses", (F.col("nth") == 0) | F.col("open_end")
    )
    crossing, too_long = numbered.filter("crosses"), None
    if largest_file > MAX_RECORD_BYTES:
        sizes = crossing.groupBy("src_file", "rec_no").agg(F.sum(F.octet_length("part")).alias("size"))
        too_long = materialise(sizes.filter(F.col("size") > MAX_RECORD_BYTES).select("src_file", "rec_no"), "long-records")
        crossing = crossing.join(broadcast_if_small(too_long), ["src_file", "rec_no"], "left_anti")
    joined = crossing.groupBy("src_file", "rec_no").agg(
        F.max("filled").alias("filled"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split_start", "part"))), lambda p: p["part"]), "").alias("text"),
    )
    whole = numbered.filter(~F.col("crosses")).select("src_file", "rec_no", "filled", F.col("part").alias("text"))
    return whole.unionByName(joined), too_long, unclosed
