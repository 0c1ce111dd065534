"""Line dedup: a deletion-neighbourhood join over all lines of all documents.

A line goes if an earlier line (by doc_id, then place) is at most one character edit away:
changed, added or left out. Lines under `SHORT` characters go only if an earlier one is equal;
blank lines stay. Places of equal lines are found by aggregation on the line's hash.

One edit between two lines leaves either the first or the last half of the shorter one as it
is, and all but one of its eight parts. Both facts narrow down, exactly, which lines can have a
neighbour and where the edit must be:

1. Each distinct line gives four keys (first and last half, for both lengths the shorter line
   may have). Only lines that share a key with another go on.
2. They give a key for each part left out. Only pairs (line, part) with a shared key go on.
3. These emit the hashes of all their deletion variants within the part, and of themselves.
   Equal hashes are joined: two lines of a length that agree after deletion at one place, or a
   line that equals a longer one after a deletion. The earliest line of each group is the
   partner of all others, so a group costs a row a line and not all pairs.
4. The edit distance to the partner is verified on the lines.

DataFrame functions only. Hot lines and groups are aggregated before they are shuffled; joins on
them are inner or left joins, which adaptive execution splits.

Edge cases: null and empty texts have one blank line or none and stay as they are. Rows that
repeat an id are the same places and are kept alike; null ids come first. Columns other than
text are kept; those named n_lines and n_dropped are replaced. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

SHORT = 16
PARTS = 8
#: Places of lines sent to every executor at most; beyond, they are joined by a shuffle.
SENT_PLACES = 1 << 20


def _lines(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("pos", "line"))


def _keys(line: str, n: str) -> str:
    """SQL for the hashes of the halves of a line, for both lengths of the shorter line."""
    halves = [f"xxhash64(0, {p}, left({line}, {p})), xxhash64(1, {p}, right({line}, {p}))" for p in (f"({n} - 1) div 2", f"{n} div 2")]
    return f"if({n} >= {SHORT}, array({', '.join(halves)}), null)"


def _in_crowd(rows: DataFrame, key: str, member: list[str]) -> DataFrame:
    """The rows whose key occurs with more than one member."""
    lows = [F.min(F.struct(*member)).alias("low"), F.max(F.struct(*member)).alias("high")]
    crowd = rows.groupBy(key).agg(*lows).filter("low <> high").select(key)
    return rows.join(crowd, key)


def earlier_neighbours(firsts: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, pos) of the first places of lines with an earlier line one edit away.

    `firsts` has a row (doc_id, pos, keys) per distinct line, `lines` (doc_id, pos, line) all.
    """
    place = ["doc_id", "pos"]
    keyed = firsts.filter("keys is not null").select(*place, F.explode(F.array_distinct("keys")).alias("key"))
    near = materialise(_in_crowd(keyed, "key", place).select(*place).distinct(), "line-near")
    wanted = near.select(F.col("doc_id").alias("d"), F.col("pos").alias("p"))
    wanted = F.broadcast(wanted) if near.count() <= SENT_PLACES else wanted
    text = lines.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("pos") == F.col("p"))).select(*place, "line")
    text = materialise(text.distinct().withColumn("n", F.length("line")), "line-texts")

    # Part j of a shorter line of s characters begins at character j * s div PARTS.
    parts = text.withColumn("s", F.explode(F.expr("array(n - 1, n)"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    parts = parts.withColumn("a", F.expr(f"j * s div {PARTS}")).withColumn("b", F.expr(f"(j + 1) * s div {PARTS}"))
    parts = parts.withColumn("key", F.expr("xxhash64(j, s, left(line, cast(a as int)), right(line, cast(s - b as int)))"))
    parts = _in_crowd(parts.select(*place, "key", "n", "s", "a", "b"), "key", place).select(*place, "n", "s", "a", "b").distinct()
    parts = materialise(parts, "line-parts")

    cut = "xxhash64(concat(left(line, cast(i as int)), substring(line, cast(i as int) + 2)))"
    rows = parts.join(text.withColumnsRenamed({"doc_id": "d", "pos": "p"}).drop("n"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("pos") == F.col("p")))
    # As the line of equal length: deletions at one place, which is part of the hash, and the
    # line itself. As the longer line: deletions that may equal the shorter one.
    same = f"flatten(array(array(struct('whole' as kind, xxhash64(line) as v)), transform(sequence(a, b - 1), i -> struct('same' as kind, xxhash64({cut}, i) as v))))"
    same = f"if(b > a, {same}, array(struct('whole' as kind, xxhash64(line) as v)))"
    longer = f"transform(sequence(a, b), i -> struct('cut' as kind, {cut} as v))"
    variants = rows.select(*place, F.explode(F.expr(f"if(n = s, {same}, {longer})")).alias("x")).select(*place, "x.kind", "x.v").distinct()
    variants = materialise(variants, "line-variants")
    own = F.struct(*place)
    first = variants.groupBy("v").agg(*[F.min(F.when(F.col("kind") == k, own)).alias(k) for k in ("same", "whole", "cut")])
    partner = F.when(F.col("kind") == "same", F.col("same")).when(F.col("kind") == "whole", F.col("cut")).otherwise(F.col("whole"))
    pairs = variants.join(first, "v").select(*place, partner.alias("partner")).filter(F.col("partner") < own).distinct()

    one = text.select(F.struct(*place).alias("a"), F.col("line").alias("line_a"))
    two = text.select(F.struct(*place).alias("b"), F.col("line").alias("line_b"))
    pairs = pairs.select(own.alias("a"), F.col("partner").alias("b"))
    both = pairs.join(one, "a").join(two, "b").filter(F.levenshtein("line_a", "line_b", 1) >= 0)
    return both.select("a.*").distinct()


def dedup_lines(documents: DataFrame) -> DataFrame:
    """The columns of `documents` with `text` without the lines that repeat earlier ones, and
    columns n_lines and n_dropped."""
    place = ["doc_id", "pos"]
    lines = _lines(documents)
    found = lines.select(
        *place,
        F.xxhash64("line").alias("h1"),
        F.xxhash64(F.lit(7), "line").alias("h2"),
        F.expr(_keys("line", "length(line)")).alias("keys"),
    ).filter(~F.col("line").rlike("^\\s*$"))
    found = materialise(found, "line-places")
    firsts = found.groupBy("h1", "h2").agg(F.min(F.struct(*place, "keys")).alias("first")).select("h1", "h2", "first.*")
    firsts = materialise(firsts, "line-firsts")
    near = earlier_neighbours(firsts, lines).withColumn("near", F.lit(True))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("pos") == F.col("p"))
    firsts = firsts.drop("keys").join(near.withColumnsRenamed({"doc_id": "d", "pos": "p"}), same, "left")
    firsts = firsts.select("h1", "h2", F.struct(*place).alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    dropped = found.drop("keys").join(firsts, ["h1", "h2"]).filter(F.col("near") | (F.struct(*place) > F.col("first")))
    dropped = dropped.groupBy(F.col("doc_id").alias("_dropped_id")).agg(F.collect_set("pos").alias("_dropped"))
    out = documents.join(dropped, F.col("doc_id").eqNullSafe(F.col("_dropped_id")), "left").drop("_dropped_id")
    split = F.split(F.col("text").cast("string"), "\n", -1)
    kept = F.when(F.col("_dropped").isNull(), F.col("text").cast("string")).otherwise(
        F.array_join(F.filter(split, lambda x, i: ~F.array_contains("_dropped", i)), "\n")
    )
    sizes = {"n_lines": F.coalesce(F.size(split), F.lit(0)), "n_dropped": F.coalesce(F.size("_dropped"), F.lit(0))}
    return out.withColumns({k: F.greatest(v, F.lit(0)).cast("bigint") for k, v in sizes.items()}).withColumn("text", kept).drop("_dropped")
