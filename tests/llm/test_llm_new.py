"""Token-id files, whitening and phrase mining against plain versions."""

import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from conftest import SF_DIR
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flatloom.llm import collocations as phrases
from flatloom.llm import encoder, queries, qdwh, token_ids, whitening
from flatloom.llm.bit_planes import PlaneFile, PlaneReader, from_planes, register, to_planes
from flatloom.llm.bloom import bloom
from flatloom.llm.hat_trie import HatTrie

BPE = public_tokenizers.path("byte_bpe_50k.json")


# Token ids


@given(st.lists(st.integers(0, 2**32 - 1), max_size=70), st.sampled_from(["bit", "byte"]))
def test_planes_round_trip(values, kind):
    values = np.array(values, "<u4")
    planes = to_planes(values, kind)
    assert len(planes) == (32 if kind == "bit" else 4)
    assert np.array_equal(from_planes(planes, len(values), 4, kind), values)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.none() | st.integers(-(2**63), 2**63 - 1), st.lists(st.integers(0, 50256), max_size=30)), max_size=12), st.sampled_from(["bit", "byte"]))
def test_file_round_trip(docs, kind):
    sink = io.BytesIO()
    file = PlaneFile(sink, kind, block=16)
    for doc, ids in docs:
        file.append(doc, np.array(ids, "<u4"))
    file.close()
    found = []
    for names, null, lengths, ids in PlaneReader(sink).documents():
        parts = np.split(ids, np.cumsum(lengths)[:-1])
        found += [(None if n else int(d), p.tolist()) for d, n, p in zip(names, null, parts, strict=True)]
    assert found == docs


def test_cut_off_file():
    sink = io.BytesIO()
    file = PlaneFile(sink, "byte")
    file.append(1, np.arange(9, dtype="<u4"))
    file.close()
    with pytest.raises(ValueError):
        PlaneReader(io.BytesIO(sink.getvalue()[:-1]))


_ODD = ["a", "B", "z", " ", "  ", "\n", "\t", "\r\n", " ", "\x1c", "'s", "'ll", "'", "é", "ß", "β", "Ж", "中", "ǅ", "ˠ", "1", "½", ".", ",", "!?", "<|endoftext|>", "😀", "́", "×", "the", " word"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(_ODD) | st.characters(exclude_categories=["Cs"]), max_size=40))
def test_pieces_give_the_ids_of_the_whole(parts):
    text = "".join(parts)
    cut, whole = encoder.Encoder(BPE), encoder.Encoder(BPE, None)
    assert cut([text, "", text]) == [*whole.whole([text]), b"", *whole.whole([text])]


def plain_ids(texts):
    """{id: (start, ids)} of [(id, text)] in ascending order."""
    tokenizer, start, found = encoder.tokenizer(BPE), 0, {}
    for doc, text in sorted(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        found[doc] = (start, ids)
        start += len(ids)
    return found


def test_query_token_ids(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op11_bit_plane_token_ids"](spark, SF_DIR).collect()}
    assert found == {d: (s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, (s, i) in plain_ids(texts).items()}


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_token_files(spark, tmp_path, planes):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choices(["alpha", "beta,", "gamma.\n\n", "'s", "dé"], k=rng.randrange(60)))) for i in range(300)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in texts], "doc_id int, text string, ids string, start int")
    folder = str(tmp_path / "ids")
    token_ids.write_token_ids(docs.orderBy(F.rand(3)), folder, BPE, planes=planes, file_bytes=4000)
    assert len([p for p in (tmp_path / "ids").iterdir() if p.suffix == ".planes"]) > 3
    (tmp_path / "ids" / "part-000000-lost.planes").write_bytes(b"of a lost attempt")
    rows = token_ids.read_token_ids(spark, f"file:{folder}").collect()
    assert {r.doc_id: (r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in rows} == plain_ids(texts)


def test_ids_as_they_are(spark, tmp_path):
    """The data source alone, with ids that come from elsewhere."""
    register(spark)
    rows = [(i, np.arange(i, dtype="<u4").tobytes()) for i in range(5)]
    spark.createDataFrame(rows, "d bigint, b binary").coalesce(1).write.format("id_planes").mode("append").save(str(tmp_path / "x"))
    found = sorted(tuple(r) for r in spark.read.format("id_planes").load(str(tmp_path / "x")).collect())
    assert [(d, s, bytes(b)) for d, s, b in found] == [(i, i * (i - 1) // 2, b) for i, b in rows]


def test_token_ids_edges(spark, tmp_path):
    docs = spark.createDataFrame([(5, "same"), (None, "n"), (5, "same"), (5, None), (2, ""), (None, None), (1, "x " * 300_000)], "doc_id bigint, text string")
    token_ids.write_token_ids(docs, str(tmp_path / "a"), BPE, file_bytes=100_000)
    rows = sorted(token_ids.read_token_ids(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, 1, 2, 5, 5, 5]
    assert [r.start for r in rows] == np.cumsum([0, *(len(r.ids) // 4 for r in rows)])[:-1].tolist()
    assert all(r.ids[-4:] == bytes(4) for r in rows) and rows[3].ids == bytes(4)
    token_ids.write_token_ids(docs.limit(0), str(tmp_path / "b"), BPE)
    assert token_ids.read_token_ids(spark, str(tmp_path / "b")).collect() == []


# Whitening


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_components_of_random_matrices(n):
    x = np.random.default_rng(n).standard_normal((3 * n + 5, n))
    a = x.T @ x
    values, vectors = qdwh.components(a)
    wanted = np.linalg.eigvalsh(a)[::-1]
    assert np.abs(values - wanted).max() < 1e-13 * wanted[0]
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * wanted[0]
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13


@pytest.mark.parametrize("values", [[0] * 4, [3] * 5, [7, 7, 7, 1, 1, 0], [1, 1e-8, 1e-16, 0], [1 + 1e-12, 1, 1], [1e200, 1e190], [-2, -1, 3]])
def test_components_of_special_spectra(values):
    q = np.linalg.qr(np.random.default_rng(4).standard_normal((len(values),) * 2))[0]
    a = q @ np.diag(np.array(values, float)) @ q.T
    found, vectors = qdwh.components(a)
    size = max(map(abs, values)) or 1
    assert np.abs(found - sorted(values, reverse=True)).max() <= 1e-13 * size
    assert np.abs(a @ vectors - vectors * found).max() <= 1e-13 * size


@pytest.mark.parametrize("bound", [1, 100, 40_000, 2**31, 2**62])
def test_codes_round_trip(bound):
    x = np.random.default_rng(2).integers(-bound, bound, (20, 7))
    x[3], x[4, 2:], x[5, :5] = 0, 0, 0
    codes = whitening._pack(x)
    assert np.array_equal(whitening._unpack(codes, 7), x)
    assert whitening._pack(np.hstack([x, np.zeros((20, 2), np.int64)])) == codes


def plain_whitening(rows, scale=256, k=4):
    """{id: [(deviation, whitened)]} and what each component explains, of {id: entries}."""
    whole = {i: tuple(int(np.floor(scale * c)) for c in v) for i, v in rows.items()}
    fit = sorted(set(whole.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[n * x - s for x, s in zip(v, sums, strict=True)] for v in fit], float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    found = {}
    for i, v in whole.items():
        y = [n * x - s for x, s in zip(v, sums, strict=True)]
        found[i] = (sum(c * c for c in y), (np.array(y) / n) @ vectors[:, :k] / np.sqrt(values[:k]))
    return found, values[:k] / values.sum(), n


def test_query_whitening(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()}
    wanted, explained, n = plain_whitening(rows)
    found = queries.QUERIES["op12_embedding_whitening"](spark, SF_DIR).collect()
    assert len(found) == 4 * len(rows)
    signs = {}
    for r in found:
        deviation, whitened = wanted[r.vec_id]
        want = whitened[r.component - 1]
        assert r.deviation == deviation and r.n == n and r.identity_error < 1e-12
        assert abs(r.explained - explained[r.component - 1]) < 1e-12
        sign = signs.setdefault(r.component, 1 if r.whitened * want > 0 else -1)
        assert abs(sign * r.whitened - want) < 1e-8


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.0]), (2, [1.0, 2.0]), (None, [0.0, -1.0, 5.0]), (4, None), (5, [1.0, None, 2.0]), (6, [nan, 1.0, 1.0]), (7, [inf, 0.0, 0.0]), (1, [1.0, 2.0, 0.0]), (8, [-0.0, 0.0, 0.0]), (9, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id int, embedding array<double>, n string")
    model = whitening.fit_whitening(df)
    assert model.n == 3 and model.sums == [256, 256, 1280]
    found = whitening.whiten(df, model).collect()
    assert len(found) == 6 * 3 and Counter(r.vec_id for r in found) == {1: 6, 2: 3, None: 3, 8: 3, 9: 3}
    # Three points span two dimensions; a third component has no variance.
    assert all((r.whitened is None) == (r.component == 3) for r in found)
    assert abs(sum(model.explained) - 1) < 1e-12 and model.identity_error < 1e-12
    one = df.filter("vec_id = 1")
    assert {(r.deviation, r.whitened, r.explained) for r in whitening.whiten(one, whitening.fit_whitening(one)).collect()} == {(0, None, 0.0)}
    none = df.limit(0)
    assert whitening.whiten(none, whitening.fit_whitening(none)).collect() == []


def test_whitening_of_far_and_large_entries(spark):
    rng = np.random.default_rng(3)
    rows = {i: (1e9 + rng.standard_normal(5)).tolist() for i in range(40)}
    df = spark.createDataFrame(list(rows.items()), "vec_id int, embedding array<double>")
    model = whitening.fit_whitening(df)
    assert model.identity_error < 1e-9
    wanted = plain_whitening(rows)[0]
    assert {r.vec_id: r.deviation for r in whitening.whiten(df, model).collect()} == {i: w[0] for i, w in wanted.items()}
    large = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 0.0]), (3, [0.0, 5.0])], "vec_id int, embedding array<double>")
    found = whitening.whiten(large, whitening.fit_whitening(large)).collect()
    assert {r.vec_id: r.deviation for r in found}[1] is None
    # Beside 2**63 a variance of some units is lost in rounding.
    assert all((r.whitened is None) == (r.component == 2) for r in found)


# Phrases


@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=5).map(tuple), max_size=200), st.integers(1, 8), st.integers(0, 30))
def test_trie_counts_and_spills(seen, burst, keep):
    trie, words = HatTrie(burst), [b"", b"d", b"b", b"a", b"c"]
    for ids in seen:
        trie.add(ids)
    assert trie.size == len(set(seen))
    found = Counter()
    for level in (keep, 0):
        for run in trie.spill(words, level):
            assert [r[0] for r in run] == sorted(r[0] for r in run)
            assert len({r[1][0] for r in run}) == 1
            found.update({ids: n for _, ids, n in run})
        assert trie.size <= level
    assert found == Counter(seen)


def plain_pieces(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [re.findall("[^ \t]+", piece) for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered)]


def plain_phrases(rows, least, longest=5, top=2000):
    """The rows of the contract, of (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in plain_pieces(text or ""):
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + m])) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    kept = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    inside = set()
    for (lang, w), a in kept.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                if a >= f[lang, w[i : i + m]]:
                    inside.add((lang, w[i : i + m]))
    found = []
    for lang in n:
        own = []
        for (other, w), a in kept.items():
            if other == lang and (lang, w) not in inside:
                cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
                score, k = min(cuts)
                own.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(found)


_WORDS = ["a", "b", "Ab", "é", "x" * 40, "q r", "the", "of"]


@pytest.fixture
def small_budgets(monkeypatch):
    for name, value in {"TRIE_ENTRIES": 60, "TASK_WORDS": 6, "_HASHES": 16, "_ROWS": 7, "HOT": 6}.items():
        monkeypatch.setattr(phrases, name, value)


def phrase_rows(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["en", "de", "und", None]), "".join(rng.choice(_WORDS) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r"]) for _ in range(rng.randrange(40)))) for _ in range(60)]
    return [*rows, ("en", None), ("fr", ""), ("es", "the of the of the of")]


@pytest.mark.parametrize("least,top", [(2, 2000), (8, 5)])
def test_phrases_against_plain_version(spark, small_budgets, least, top):
    """The budgets of a task are module values; its code takes them along when they change here."""
    rows = phrase_rows(least)
    df = spark.createDataFrame([(1, *r, "p") for r in rows], "doc_id int, lang string, text string, phrase string").repartition(3)
    found = phrases.collocations(df, least=least, top=top).collect()
    assert sorted(map(tuple, found)) == plain_phrases(rows, least, top=top)


def test_splits_are_counted_together(spark, monkeypatch):
    """Rows of runs are tasks times phrases: more splits alone do not make more of them."""
    made, tasks = [], 2 * spark.sparkContext.defaultParallelism
    kept = phrases.merged
    monkeypatch.setattr(phrases, "merged", lambda runs, least: made.append(runs) or kept(runs, least))
    rows = spark.range(600).selectExpr("'en' AS lang", "'a b' AS text").repartition(40)
    found = phrases.collocations(rows).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.n) for r in found] == [("a b", 600, 600, 600, 1200)]
    assert made[-1].filter("phrase = 'a b'").count() <= tasks < 40
    assert phrases._together(rows, 100 * phrases.COUNTED_WORDS).rdd.getNumPartitions() == 40


def test_counting_spills_in_any_order(small_budgets):
    """A task that spills all the time hands out the same counts."""

    class All:
        def names(self, hashes):
            return np.ones(len(hashes), bool)

    rows = [(lang or "und", text or "") for lang, text in phrase_rows(5)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["lang", "text"])
    found = Counter()
    for out in phrases.Counting(5, All(), All(), None, frozenset({("en", b"a")}))(iter([batch])):
        for r in out.to_pylist():
            found[r["lang"], r["phrase"]] += r["f"]
            first = r["phrase"].split(" ")
            assert r["prefix"] == " ".join(first[:2] if (r["lang"], first[0]) == ("en", "a") else first[:1])
    wanted = Counter()
    for lang, text in rows:
        for piece in plain_pieces(text):
            wanted.update((lang, " ".join(piece[i : i + m])) for m in range(2, 6) for i in range(len(piece) - m + 1))
    assert found == wanted


def test_large_products_stay_exact(spark):
    row = spark.sql("SELECT (1000 * cast(9000000000001 as decimal(19,0)) * cast(90000000000000007 as decimal(19,0))) div (cast(9000000000003 as decimal(19,0)) * cast(9000000000001 as decimal(19,0))) AS s").first()
    assert row.s == 1000 * 9000000000001 * 90000000000000007 // (9000000000003 * 9000000000001)


def test_no_phrases(spark):
    df = spark.createDataFrame([("en", "a b")], "lang string, text string")
    assert phrases.collocations(df).collect() == []
    assert phrases.collocations(df.limit(0)).collect() == []


def test_bloom_names_all_its_hashes(spark):
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63, 8000)
    found = bloom(spark.createDataFrame([(int(h),) for h in hashes[:3000]], "h bigint"))
    named = found.names(hashes.view(np.uint64))
    assert named[:3000].all() and named[3000:].sum() < 50


def test_words_of_a_slice():
    """Both ways to cut a text give the same words."""
    texts = ["A b\t,c", "", "d", "É.e\x0b\x0cf \x85g\u2003h", " "]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 5), pa.array(texts)], names=["lang", "text"])
    (s,) = phrases._slices([batch])
    assert s.text() == [w.encode() for t in texts for p in plain_pieces(t) for w in p]
    assert s.goes_on.tolist() == [True, False, False, False, False, False, True]
