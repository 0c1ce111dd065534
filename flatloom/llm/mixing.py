"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling.

The token counts of the cells (source, language, topic) are raked: scaled so that the sums by
source meet the target shares of the sources, then by language, then by topic, in rounds.
Documents of a cell are then sampled with the probability that gives the cell its raked share of
the token budget; a cell that holds too few tokens is taken whole. A document is in the sample
if a number made from its id lies below the probability, so a sample can be repeated.

`bounded_cells` calibrates with the bound: no cell gives more than it holds, and what a cell cut at
probability 1 lacks is given by the free cells of the same source, language and topic, so that the
sample meets the targets and the budget. A value with fewer tokens than its target is taken whole
and the rest of its dimension is scaled up to the budget. Where cells cannot meet all targets at
once, the last dimension and the budget are met. Every target missed by more than TOLERANCE is
reported.

`capped_cells` does the same with a fixed number of rounds of one step each.

DataFrame functions only, but for `bounded_cells`, which brings the table of cells (a row per
source, language and topic that occur together, whole) to the driver. Documents are aggregated to cells at once, so a source with a third
of all rows is a few rows; rounds work on the cells, and each is a table in the shared folder.

Edge cases: null dimensions and ids count as the empty string; null and empty texts have no
tokens; cells without tokens and values without a target get probability 0, but a cell without
tokens is taken whole, as it costs nothing. Targets of absent values are left out and the rest
scaled up. Repeated rows share a decision. Other columns are kept; those named `mix_...` are
replaced. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

DIMENSIONS = ("source", "lang", "topic")
#: Topics by what a text holds, the first that applies; else "prose".
TOPICS = {
    "legal": ("icensed under", "ights reserved", "MIT License"),
    "contact": ("@", "http://", "https://"),
    "table": (" | ",),
    "emphasis": ("!!", "$$$"),
}
#: Without given targets, a value's target is its token share to this power, scaled to sum to 1.
TEMPER = 0.7
ROUNDS = 8
#: Rounds of `capped_cells`. A round is one step by dimension; sixteen met the targets to 8e-5 of the
#: budget on 86 cells and to 1e-7 on 180 cells and more.
SWEEPS = 16
#: A cell's weight stays within this factor of its tokens, both ways.
REACH = 1e12
#: Tokens of the sample, as a share of all.
BUDGET = 0.6
#: A share within this of its target is met.
TOLERANCE = 1e-4


def topic_of(text: Column) -> Column:
    topic = F.lit("prose")
    for name, parts in reversed(TOPICS.items()):
        any_part = F.lit(False)
        for part in parts:
            any_part |= F.contains(text, F.lit(part))
        topic = F.when(any_part, name).otherwise(topic)
    return topic


def n_tokens(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0)).cast("bigint")


def sampling_number(doc_id: Column) -> Column:
    """A number from 0 up to 1 made from the id."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 48))


def _target(cells: DataFrame, dimension: str, given: dict[str, float] | None) -> DataFrame:
    """(dimension, target): shares of the values that have tokens; they sum to 1."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("sum")).filter("sum > 0")
    if given is None:
        raw = sums.select(dimension, F.pow("sum", F.lit(TEMPER)).alias("raw"))
    else:
        rows = cells.sparkSession.createDataFrame(list(given.items()), f"{dimension} string, raw double")
        raw = sums.join(rows, dimension).select(dimension, "raw")
    whole = raw.agg(F.sum("raw").alias("whole"))
    return raw.crossJoin(F.broadcast(whole)).select(dimension, (F.col("raw") / F.col("whole")).alias(f"target_{dimension}"))


def calibrated_cells(rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """(dimensions, tokens, share, probability) of every cell of rows (dimensions, tokens).

    `targets` gives shares by dimension and value; a dimension without any is tempered.
    """
    cells = materialise(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    fitted = cells.withColumn("w", F.col("tokens").cast("double"))
    for d in DIMENSIONS:
        fitted = fitted.join(_target(cells, d, (targets or {}).get(d)), d, "left")
    fitted = materialise(fitted.fillna(0.0, [f"target_{d}" for d in DIMENSIONS]), "mix-targets")
    columns = fitted.columns
    for _ in range(rounds):
        for d in DIMENSIONS:
            sums = fitted.groupBy(d).agg(F.sum("w").alias("sum"))
            scaled = F.when(F.col("sum") > 0, F.col("w") * F.col(f"target_{d}") / F.col("sum")).otherwise(0.0)
            fitted = fitted.join(sums, d).withColumn("w", scaled).select(*columns)
        fitted = materialise(fitted, "mix-round")
    total = fitted.agg(F.sum("w").alias("all_w"), F.sum("tokens").alias("all_tokens"))
    share = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w")).otherwise(0.0)
    wanted = F.least(F.lit(1.0), F.lit(budget) * F.col("all_tokens") * F.col("share") / F.col("tokens"))
    probability = F.when(F.col("tokens") > 0, wanted).otherwise(1.0)
    return fitted.crossJoin(F.broadcast(total)).withColumn("share", share).select(*DIMENSIONS, "tokens", "share", probability.alias("probability"))


def _held(cells: DataFrame, dimension: str, whole: float) -> DataFrame:
    """(dimension, wanted): the tokens each value is to give, none more than it holds, `whole` in all.

    A value that holds less than its share gives all; the others share what is left.
    """
    values = cells.groupBy(dimension).agg(F.sum("held").alias("held"), F.max(f"target_{dimension}").alias("target"))
    values = materialise(values.filter("held > 0"), "mix-values")
    scale, n_cut, last = 0.0, 0, -1
    while n_cut != last:
        cut = F.col("target") * F.lit(scale) >= F.col("held")
        sums = values.agg(F.sum(F.when(cut, F.col("held"))), F.sum(F.when(~cut, F.col("target"))), F.count(F.when(cut, 1))).first()
        last, n_cut = n_cut if scale else -1, sums[2]
        if sums[1] is None:
            break
        scale = max(whole - (sums[0] or 0.0), 0.0) / sums[1]
    return values.select(dimension, F.least(F.col("held"), F.col("target") * F.lit(scale)).alias(f"wanted_{dimension}"))


def capped_cells(rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, sweeps: int = SWEEPS) -> DataFrame:
    """As `calibrated_cells`, with the bound: the cells; share is that of the sample.

    Each value's cells are scaled by one Newton step towards the sum of least(weight, tokens) that
    the value is to give, by dimension in turn. What cells cut at their tokens lack is so given by
    others. DataFrame functions only; numbers of the whole table are all that the driver sees.
    """
    cells = materialise(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    fitted = cells
    for d in DIMENSIONS:
        fitted = fitted.join(_target(cells, d, (targets or {}).get(d)), d, "left")
    usable = F.lit(True)
    for d in DIMENSIONS:
        usable &= F.coalesce(F.col(f"target_{d}"), F.lit(0.0)) > 0
    fitted = materialise(fitted.withColumn("held", F.when(usable, F.col("tokens").cast("double")).otherwise(0.0)), "mix-targets")
    sums = fitted.agg(F.sum("tokens"), F.sum("held")).first()
    held = sums[1] or 0.0
    whole = min(budget * (sums[0] or 0), held)
    for d in DIMENSIONS:
        fitted = fitted.join(_held(fitted, d, whole), d, "left")
    fitted = fitted.fillna(0.0, [f"wanted_{d}" for d in DIMENSIONS]).withColumn("w", F.col("held") * F.lit(whole / held if held else 0.0))
    columns = [*DIMENSIONS, "tokens", "held", *[f"wanted_{d}" for d in DIMENSIONS], "w"]
    fitted = materialise(fitted.select(*columns), "mix-round")
    cut = F.col("w") >= F.col("held")
    bound, free = F.col("bound"), F.col("free")
    for _ in range(sweeps):
        for d in DIMENSIONS:
            given = fitted.groupBy(d).agg(F.sum(F.when(cut, F.col("held")).otherwise(0.0)).alias("bound"), F.sum(F.when(cut, 0.0).otherwise(F.col("w"))).alias("free"))
            wanted = F.col(f"wanted_{d}")
            low = wanted < bound + free
            step = F.when(free > 0, (wanted - bound) / free).when(low, 0.0).otherwise(1.0)
            step = F.when(low, F.greatest(step, wanted / F.greatest(bound + free, F.lit(1e-300)))).otherwise(step)
            scaled = F.least(F.greatest(F.col("w") * step, F.col("held") / REACH), F.col("held") * REACH)
            fitted = fitted.join(given, d).withColumn("w", F.when(F.col("w") > 0, scaled).otherwise(0.0)).select(*columns)
        fitted = materialise(fitted, "mix-round")
    tokens = F.least("w", "held")
    total = fitted.agg(F.sum(tokens).alias("all_given"))
    share = F.when(F.col("all_given") > 0, tokens / F.col("all_given")).otherwise(0.0)
    probability = F.when(F.col("tokens") > 0, tokens / F.col("tokens")).otherwise(1.0)
    return fitted.crossJoin(F.broadcast(total)).select(*DIMENSIONS, "tokens", share.alias("share"), probability.alias("probability"))


def _filled(wanted: np.ndarray, held: np.ndarray, whole: float) -> np.ndarray:
    """`wanted`, scaled to sum to `whole` as far as `held` allows, none above what is held."""
    out, free = np.zeros(len(held)), wanted > 0
    while free.any():
        scaled = np.where(free, wanted * max(whole - out[~free].sum(), 0.0) / wanted[free].sum(), out)
        cut = free & (scaled >= held)
        if not cut.any():
            return scaled
        out[cut], free = held[cut], free & ~cut
    return out


def _scaled(weight: np.ndarray, held: np.ndarray, of: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """`weight`, scaled by value so that the sums of least(weight, held) are `wanted`.

    Newton steps on a concave function of the scale; a value that is cut in all cells stays.
    """
    n = len(wanted)
    for _ in range(100):
        cut = weight >= held
        bound, free = np.bincount(of, np.where(cut, held, 0), n), np.bincount(of, np.where(cut, 0, weight), n)
        off = wanted - bound - free
        low = wanted < bound + free
        step = np.where(free > 0, (wanted - bound) / np.where(free > 0, free, 1), np.where(low, 0.0, 1.0))
        step = np.where(low, np.maximum(step, wanted / np.maximum(bound + free, 1e-300)), step)
        if (np.abs(off)[(free > 0) | low] <= 1e-12 * held.sum()).all():
            break
        weight = np.clip(weight * step[of], 1e-12 * held, 1e12 * held) * (weight > 0)
    return weight


def bounded(tokens: np.ndarray, values: list[np.ndarray], targets: list[np.ndarray], budget: float) -> np.ndarray:
    """The tokens each cell gives. `values` has each cell's value by dimension, `targets` shares."""
    usable = np.all([t[v] > 0 for t, v in zip(targets, values, strict=True)], axis=0)
    held = np.where(usable, tokens, 0.0)
    whole = min(budget * tokens.sum(), held.sum())
    wanted = [_filled(t, np.bincount(v, held, len(t)), whole) for t, v in zip(targets, values, strict=True)]
    weight = held * (whole / held.sum() if whole else 0.0)
    given = np.minimum(weight, held)
    while whole:
        last = given
        for v, need in zip(values, wanted, strict=True):
            weight = _scaled(weight, held, v, need)
        given = np.minimum(weight, held)
        gap = max(np.abs(np.bincount(v, given, len(need)) - need).max() for v, need in zip(values, wanted, strict=True))
        if gap <= TOLERANCE / 100 * whole or np.abs(given - last).max() <= 1e-7 * whole:
            break
    return given


def bounded_cells(
    rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET
) -> tuple[DataFrame, list[tuple[str, str, float, float]]]:
    """As `calibrated_cells`, with the bound: the cells (share is that of the sample), and the
    targets that are not met: dimension, value, target and reached share."""
    cells = materialise(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    found = cells.toArrow()
    tokens = found["tokens"].to_numpy().astype(float)
    values, names, wanted = [], [], []
    for d in DIMENSIONS:
        coded = found[d].combine_chunks().dictionary_encode()
        values.append(coded.indices.to_numpy(zero_copy_only=False))
        names.append(coded.dictionary.to_pylist())
        sums, own = np.bincount(values[-1], tokens, len(names[-1])), (targets or {}).get(d)
        raw = sums**TEMPER if own is None else np.array([own.get(x, 0.0) if n else 0.0 for x, n in zip(names[-1], sums, strict=True)])
        wanted.append(raw / raw.sum() if raw.sum() else raw)
    given = bounded(tokens, values, wanted, budget) if len(tokens) else tokens
    share = given / given.sum() if given.sum() else np.zeros(len(tokens))
    missed = []
    for d, v, own, t in zip(DIMENSIONS, values, names, wanted, strict=True):
        reached = np.bincount(v, share, len(t)) if len(v) else t
        missed += [(d, own[i], float(t[i]), float(reached[i])) for i in np.flatnonzero(np.abs(reached - t) > TOLERANCE)]
    probability = np.where(tokens > 0, np.minimum(given / np.where(tokens > 0, tokens, 1), 1.0), 1.0)
    out = found.append_column("share", pa.array(share)).append_column("probability", pa.array(probability))
    return rows.sparkSession.createDataFrame(out), missed


def with_cell(documents: DataFrame) -> DataFrame:
    """`documents` and a struct `mix_cell`: source, lang, topic and tokens."""
    text = F.col("text").cast("string")
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")]
    topic = F.coalesce(topic_of(text), F.lit("prose")).alias("topic")
    return documents.withColumn("mix_cell", F.struct(*named, topic, n_tokens(text).alias("tokens")))


def sampled(documents: DataFrame, cells: DataFrame) -> DataFrame:
    """`documents` with mix_cell, and columns mix_probability and mix_sampled."""
    rates = cells.select(F.struct(*DIMENSIONS).alias("mix_rate_cell"), F.col("probability").alias("mix_probability"))
    same = [F.col(f"mix_cell.{d}") == F.col(f"mix_rate_cell.{d}") for d in DIMENSIONS]
    out = documents.drop("mix_probability").join(rates, same[0] & same[1] & same[2]).drop("mix_rate_cell")
    return out.withColumn("mix_sampled", sampling_number(F.col("doc_id")) < F.col("mix_probability"))
