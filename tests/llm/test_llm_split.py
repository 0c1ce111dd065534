"""Sharding, mixing and line dedup against plain versions."""

import random
import zlib

import pytest
from llm_brute import deduped_lines

import corpus_pipeline
from flatloom.llm.kd_shards import kd_shards
from flatloom.llm.line_dedup import dedup_lines
from flatloom.llm.mixing import DIMENSIONS, ROUNDS, TEMPER, TOLERANCE, bounded_cells, calibrated_cells, capped_cells, sampled, with_cell

DOCS = "doc_id long, text string, lang string, source string, shard string, node int"


def documents(spark, texts, seed=1):
    rng = random.Random(seed)
    rows = [(k, t, rng.choice(["en", "de", None]), f"s{min(rng.randrange(9), rng.randrange(9))}", "x", 1) for k, t in texts]
    return spark.createDataFrame(rows, DOCS)


# Sharding


def shards_of(frame):
    found = {}
    for r in frame.collect():
        found.setdefault(r.shard, []).append(r)
    return found


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_balanced_shards(spark, shards):
    rng = random.Random(shards)
    texts = [(i, "é" * int(rng.lognormvariate(4, 1))) for i in range(1500)]
    texts += [(1500 + i, "copy of a text" * 5) for i in range(150)] + [(1650, None), (1651, ""), (None, "no id"), (3, texts[3][1])]
    found = shards_of(kd_shards(documents(spark, texts), shards=shards))
    rows = [r for own in found.values() for r in own]
    assert len(rows) == len(texts) and set(found) == set(range(shards))
    plain = sorted((repr(k), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in texts)
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in rows) == plain
    sizes = [sum(r.size for r in own) for own in found.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)
    for own in found.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    copies = {s for s, own in found.items() for r in own if r.text_crc32 == zlib.crc32(b"copy of a text" * 5)}
    assert len(copies) == 1


def test_hot_group_is_split(spark):
    """A third of all rows are one text: over half a shard, so it is dealt by document."""
    texts = [(i, "hot text " * 9 if i % 3 == 0 else f"text number {i} " * (i % 11)) for i in range(1200)]
    found = shards_of(kd_shards(documents(spark, texts), shards=8))
    sizes = [sum(r.size for r in own) for own in found.values()]
    assert len(found) == 8 and max(sizes) - min(sizes) < 0.1 * max(sizes)


def test_shards_by_bytes_and_edges(spark):
    docs = documents(spark, [(i, "word " * 20) for i in range(100)] + [(i, f"{i}" * 50) for i in range(100, 300)])
    total = sum(len((r.text or "").encode()) + 1 for r in docs.collect())
    assert len(shards_of(kd_shards(docs, shard_bytes=5000))) == round(total / 5000)
    assert kd_shards(docs.limit(0), shards=4).collect() == []
    one = kd_shards(documents(spark, [(1, None)]), shards=8).collect()
    assert [(r.size, r.text_crc32, r.slot) for r in one] == [(1, 0, 0)]


# Mixing


def raked(cells, rounds):
    weight = {k: float(v) for k, v in cells.items()}
    targets = []
    for i in range(3):
        sums = {}
        for k, v in cells.items():
            sums[k[i]] = sums.get(k[i], 0) + v
        raw = {k: v**TEMPER for k, v in sums.items() if v}
        targets.append({k: v / sum(raw.values()) for k, v in raw.items()})
    for _ in range(rounds):
        for i in range(3):
            sums = {}
            for k, v in weight.items():
                sums[k[i]] = sums.get(k[i], 0) + v
            weight = {k: v * targets[i].get(k[i], 0) / sums[k[i]] if sums[k[i]] else 0.0 for k, v in weight.items()}
    return weight, targets


def test_values_that_begin_alike_are_split(spark):
    """Sources and ids are compared whole: one that is as wide as its values is split along."""
    sources = ["https://example.org/a", "https://example.org/b", "https://example.org/c", "https://example.org/zz"]
    rows = [(f"https://id/{i:04}", f"text {i:04}", "en", sources[i % 4]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    found = {r.doc_id: r.shard for r in kd_shards(docs, shards=4).collect()}
    by_shard = {}
    for doc_id, _, _, source in rows:
        by_shard.setdefault(found[doc_id], []).append((source, doc_id))
    assert sorted(len(v) for v in by_shard.values()) == [100] * 4
    # Each shard is one range of sources or one of ids.
    for own in by_shard.values():
        ids = sorted(d for _, d in own)
        assert len({s for s, _ in own}) < 4 or int(ids[-1][-4:]) - int(ids[0][-4:]) < 400 / len(by_shard) * 2


def test_raking(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(["word"] * int(rng.lognormvariate(3, 1))) + rng.choice(["", " | x", "!!", " @"])) for i in range(900)]
    texts += [(900, None), (901, ""), (902, "x " * 40_000), (None, "no id here"), texts[0]]
    docs = with_cell(documents(spark, texts).withColumnRenamed("node", "probability").withColumnRenamed("shard", "topic"))
    cells = calibrated_cells(docs.select("mix_cell.*"))
    rows = [r.mix_cell for r in docs.collect()]
    plain = {}
    for r in rows:
        key = tuple(r[d] for d in DIMENSIONS)
        plain[key] = plain.get(key, 0) + r.tokens
    weight, targets = raked(plain, ROUNDS)
    found = {tuple(r[d] for d in DIMENSIONS): r for r in cells.collect()}
    total = sum(plain.values())
    assert set(found) == set(plain)
    for k, r in found.items():
        assert r.tokens == plain[k] and abs(r.share - weight[k] / sum(weight.values())) < 1e-9
        assert abs(r.probability - (min(1, 0.6 * total * r.share / r.tokens) if r.tokens else 1)) < 1e-9
    for i in range(3):  # the marginals are met
        for value, share in targets[i].items():
            assert abs(sum(r.share for k, r in found.items() if k[i] == value) - share) < 0.01
    out = sampled(docs, cells)
    assert out.columns == [*docs.columns, "mix_probability", "mix_sampled"]
    kept = out.collect()
    assert len(kept) == len(texts)
    share = sum(r.mix_cell.tokens * r.mix_probability for r in kept) / total
    assert abs(sum(r.mix_cell.tokens for r in kept if r.mix_sampled and r.doc_id != 902) / total - share) < 0.4
    assert {r.mix_sampled for r in kept if r.doc_id == 900} == {True}
    none = with_cell(documents(spark, []))
    assert sampled(none, calibrated_cells(none.select("mix_cell.*"))).collect() == []


def reached(cells, i):
    given, whole = {}, sum(r.tokens * r.probability for r in cells)
    for r in cells:
        given[r[i]] = given.get(r[i], 0) + r.tokens * r.probability / whole
    return given, whole


def test_bounded_cells(spark):
    """Cells cut at probability 1 are made up for by others: marginals and budget are met."""
    schema = "source string, lang string, topic string, tokens long"
    rows = [("a", "en", "x", 100), ("a", "de", "x", 500), ("a", "en", "y", 500), ("a", "de", "y", 500)]
    rows += [("b", "en", "x", 500), ("b", "de", "x", 30), ("b", "en", "y", 30), ("b", "de", "y", 500), ("b", "fr", "x", 0)]
    frame = spark.createDataFrame(rows, schema)
    even = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"x": 0.5, "y": 0.5}}
    total = sum(r[3] for r in rows)

    def gap(cells):
        shares = [reached(cells, i) for i in range(3)]
        off = [abs(found.get(k, 0) - t) for (found, _), d in zip(shares, DIMENSIONS, strict=True) for k, t in even[d].items()]
        return max(off), abs(shares[0][1] / total - 0.7)

    cut = calibrated_cells(frame, even, budget=0.7).collect()
    assert max(gap(cut)) > 1e-3
    cells, missed = bounded_cells(frame, even, budget=0.7)
    cells = cells.collect()
    assert missed == [] and max(gap(cells)) < 1e-4 and sum(r.probability == 1 for r in cells) >= 2
    assert all(0 <= r.probability <= 1 for r in cells) and len(cells) == len(rows)

    # A value that holds less than its target is taken whole and reported; the budget is met.
    cells, missed = bounded_cells(frame, {"source": {"a": 0.9, "b": 0.1}}, budget=0.7)
    (found, whole), held = reached(cells.collect(), 0), sum(r[3] for r in rows if r[0] == "a")
    assert abs(whole - 0.7 * total) < 1e-3 * total and abs(found["a"] - held / whole) < 1e-6
    assert [(d, v) for d, v, _, _ in missed if d == "source"] == [("source", "a"), ("source", "b")]
    cells, missed = bounded_cells(frame.limit(0))
    assert cells.collect() == [] and missed == []


@pytest.mark.parametrize("targets", [None, {"source": {"a": 0.6, "b": 0.3, "absent": 0.1}, "lang": {"en": 1.0}}])
def test_capped_cells_are_those_of_the_bound(spark, targets):
    """Rounds of single steps end where the exact calibration does; every target that can be met is."""
    rng = random.Random(4)
    rows = [(s, la, t, int(rng.lognormvariate(5, 2))) for s in "abcdefgh" for la in ("en", "de", "fr") for t in ("prose", "table", "legal") for _ in range(3)]
    rows += [("a", "en", "prose", 60_000), ("i", "en", "prose", 0)]
    frame = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    exact = {tuple(r[d] for d in DIMENSIONS): r for r in bounded_cells(frame, targets, budget=0.4)[0].collect()}
    found = capped_cells(frame, targets, budget=0.4).collect()
    assert len(found) == len(exact)
    for r in found:
        e = exact[tuple(r[d] for d in DIMENSIONS)]
        assert abs(r.share - e.share) < 10 * TOLERANCE and r.tokens == e.tokens and 0 <= r.probability <= 1
        assert abs(r.probability - e.probability) * r.tokens < 10 * TOLERANCE * sum(x[3] for x in rows)
    for i in range(3):
        own, whole = reached(found, i)
        for value, share in reached(exact.values(), i)[0].items():
            assert abs(own[value] - share) < TOLERANCE
    assert capped_cells(frame.limit(0), targets).collect() == []
    nothing = capped_cells(frame.filter("tokens = 0")).collect()
    assert {(r.share, r.probability) for r in nothing} == {(0.0, 1.0)}


def test_pipeline_mix_meets_what_can_be_met(spark):
    rng = random.Random(6)
    rows = []
    for i in range(6000):
        lang = "en" if rng.random() < 0.9 else "es"
        source = "s0" if rng.random() < (0.9 if lang == "en" else 0.2) else "s1"
        rows.append((i, "word " * 20 + ("| " if rng.random() < (0.02 if lang == "es" else 0.3) else ""), lang, source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    marked = with_cell(docs)
    cells, missed = bounded_cells(marked.select("mix_cell.*"))
    cells, total = {tuple(r[d] for d in DIMENSIONS): r for r in cells.collect()}, sum(r.mix_cell.tokens for r in marked.collect())
    kept = {r.doc_id for r in corpus_pipeline.mix(spark, docs, "").collect()}
    taken = [r.mix_cell for r in marked.collect() if r.doc_id in kept]
    assert abs(sum(r.tokens for r in taken) / total - 0.6) < 0.02
    old = calibrated_cells(marked.select("mix_cell.*")).collect()
    assert sum(r.tokens * r.probability for r in old) / total < 0.59
    for i, d in enumerate(DIMENSIONS):
        for value, share in reached(cells.values(), i)[0].items():
            assert abs(sum(r.tokens for r in taken if r[d] == value) / sum(r.tokens for r in taken) - share) < 0.02


def test_given_targets(spark):
    rows = [("a", "en", "prose", 100), ("b", "en", "prose", 300), ("c", "de", "prose", 100), ("c", "en", "prose", 0)]
    frame = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.5, "b": 0.25, "absent": 0.25}, "lang": {"en": 1.0}}
    found = {(r.source, r.lang): r for r in calibrated_cells(frame, targets, budget=0.2).collect()}
    assert abs(found["a", "en"].share - 2 / 3) < 1e-9 and abs(found["b", "en"].share - 1 / 3) < 1e-9
    assert found["c", "de"].probability == 0 and found["c", "en"].probability == 1
    assert abs(found["a", "en"].probability - 2 / 3) < 1e-9


# Lines


def edited(rng, line):
    i = rng.randrange(len(line))
    return rng.choice([line[:i] + "é" + line[i + 1 :], line[:i] + line[i + 1 :], line[:i] + "xx"[rng.randrange(2)] + line[i:], line])


def test_lines(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(12, 90))) for _ in range(40)]
    base += ["a" * n for n in range(14, 22)] + ["ab" * n for n in range(8, 12)]
    texts = {}
    for i in range(120):
        texts[i] = "\n".join(rng.choice([edited(rng, rng.choice(base)), rng.choice(base), "", "short", "new " + str(rng.random())]) for _ in range(rng.randrange(1, 9)))
    long = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    texts |= {200: long, 201: long[:1500] + "X" + long[1500:], 202: long[:-1], 203: long[:700] + "Y" + long[701:], 204: "", 205: "\n\n", 206: long[::-1]}
    rows = [(k, t, "x", 1) for k, t in texts.items()]
    docs = spark.createDataFrame([*rows, rows[0], (300, None, "x", 1)], "doc_id long, text string, line string, n_lines int")
    found = dedup_lines(docs).collect()
    assert len(found) == len(rows) + 2
    got, expected = {r.doc_id: r for r in found}, deduped_lines(texts)
    assert {k: got[k].text for k in texts} == expected
    assert got[300].text is None and (got[300].n_lines, got[300].n_dropped) == (0, 0)
    assert got[205].n_lines == 3 and got[201].n_dropped == 1
    assert dedup_lines(docs.limit(0)).collect() == []


def test_hot_line(spark):
    rows = [(i, f"the same line for all of them\nthe same line for all of the{i % 5}\nown line number {i * 7919}") for i in range(600)]
    found = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.n_dropped for r in found) >= 600 + 599
    assert {r.doc_id: r.text for r in found} == deduped_lines(dict(rows))
