"""Near duplicates of texts and vectors, components and decontamination."""

import random

import numpy as np
import pytest
from conftest import SF_DIR
from llm_brute import contamination as plain_contamination
from llm_brute import near_components, smallest_reachable
from pyspark.sql import functions as F

import corpus_pipeline
from flatloom.llm.components import components
from flatloom.llm.decontaminate import contamination
from flatloom.llm.embedding_dedup import similar_embeddings, tables_needed
from flatloom.llm.near_dedup import bands_needed, least_matches, most_differences, near_duplicates

WORDS = [f"w{i}" for i in range(400)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, b) for b in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    found = components(spark.createDataFrame(links + [(7, 7), (None, 3)], "a long, b long"))
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.component for r in found.collect()} == smallest_reachable(nodes, [x for x in links if x[0] != x[1]])
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("block", [5, 256])
def test_near_duplicates(spark, block):
    rng = random.Random(5)
    base, texts = text(rng, 120), {}
    for i in range(150):  # one large group of near copies, in a chain
        w = base.split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "x" + str(rng.randrange(9))
        texts[i] = " ".join(w)
    passage = text(rng, 60)
    for i in range(150, 190):  # a passage that many share, not alike enough
        texts[i] = passage + " " + text(rng, 40)
    for i in range(190, 230):
        texts[i] = base.upper() if i % 2 else text(rng, 1 + i % 7)
    long = text(rng, 60_000)
    texts |= {230: None, 231: "", 232: " \t\n", 233: long, 234: long + " end", 235: "One two three", 236: "one TWO three", 237: "É É", 238: "é é"}
    rows = [(k, t, 1.5) for k, t in texts.items()]
    docs = spark.createDataFrame(rows + rows[:3] + [(None, base, 1.0)], "doc_id long, text string, bucket double")
    found = near_duplicates(docs, block=block).collect()
    assert len(found) == len(rows) + 4
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == near_components(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found if r.doc_id is not None)
    lone = [r for r in found if r.doc_id is None]
    assert [(r.component_id, r.kept) for r in lone] == [(None, True)]
    assert near_duplicates(docs.limit(0)).collect() == []


def test_pipeline_stage_links_from_80(spark):
    """Pairs from 0.8 up to 0.85 are near copies for the stage, and pairs below 0.8 are not."""
    rng, texts = random.Random(11), {}
    for i in range(300):
        w = text(rng, 120).split()
        texts[2 * i] = " ".join(w)
        n = 10 + i % 14
        texts[2 * i + 1] = " ".join(w[:-n] + [f"y{i}z{k}" for k in range(n)])
    at_80, at_85 = ({k for k, (_, c) in near_components(texts, p).items() if k == c} for p in (80, 85))
    assert len(at_85) - len(at_80) > 40 and len(at_80) > 400
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == at_80


def test_pipeline_stage_on_the_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = corpus_pipeline.near_dedup(spark, docs, SF_DIR)
    assert found.columns == docs.columns
    assert {r.doc_id for r in found.collect()} == {k for k, (_, c) in near_components(texts, 80).items() if k == c}


def test_bands_needed():
    assert bands_needed(0.85) == 28 and bands_needed(0.8, 1e-6) == 46
    assert max(least_matches(0.85)) == 168 and max(least_matches(0.8, n_bands=46)) == 264


def test_posterior_bounds():
    least = least_matches(0.85)
    assert least[24] < 20 and least[168] < 143 and least[168] / 168 > least[24] / 24
    assert 20 < most_differences(0.85) < 40


@pytest.mark.parametrize("block", [8, 512])
def test_embeddings(spark, block):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + rng.standard_normal(16) * 0.07).tolist(), 1) for i in range(60)]
    rows += [(i, rows[i % 3][1], 1) for i in range(60, 90)] + [(i, rows[0][1], 2) for i in range(90, 93)]
    rows += [(i, rng.standard_normal(16).tolist(), i % 2) for i in range(93, 140)]
    rows += [(140, None, 1), (141, [0.0] * 16, 1), (142, [float("nan")] * 16, 1), (143, rows[0][1], None), (144, [1.0, None], 1)]
    rows += [(145, [float("inf")] * 16, 1), (146, [], 1), (147, [3.0, 4.0], 1), (148, [30.0, 40.0], 1), (149, (np.array(rows[0][1]) * 1e-200).tolist(), 1)]
    good = [(i, np.array(v), label) for i, v, label in rows if label is not None and i not in (140, 141, 142, 144, 145, 146)]
    links = []
    for a in range(len(good)):
        for b in range(a):
            (i, v, x), (j, w, y) = good[a], good[b]
            v, w = v / np.abs(v).max(), w / np.abs(w).max()
            if x == y and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links.append((i, j))
    assert len(links) > 500
    table = spark.createDataFrame(rows + [(None, rows[0][1], 1), rows[5]], "vec_id long, embedding array<double>, label int")
    found = similar_embeddings(table, block=block).collect()
    expected = smallest_reachable([r[0] for r in rows], links)
    assert {r.vec_id: r.component_id for r in found if r.vec_id is not None} == expected
    assert {r.vec_id: r.n_links for r in found if r.vec_id is not None} == {i: sum(i in x for x in links) for i, _, _ in rows}
    assert len(found) == len(rows) + 2 and all(r.kept == (r.vec_id == r.component_id) for r in found if r.vec_id is not None)
    assert similar_embeddings(table.limit(0)).collect() == []


def test_embeddings_with_labels_of_any_type(spark):
    """Labels are only compared: texts and numbers of any size will do."""
    vector, big = [1.0, 2.0, 3.0], -(1 << 62)
    texts = spark.createDataFrame([(1, vector, "a"), (2, vector, "a b"), (3, [2.0, 4.0, 6.0], "a"), (4, vector, None)], "vec_id long, embedding array<double>, label string")
    numbers = texts.withColumn("label", F.when(F.col("label") == "a", F.lit(big)).when(F.col("label").isNotNull(), F.lit(7)))
    for table in (texts, numbers):
        assert {r.vec_id: (r.n_links, r.component_id) for r in similar_embeddings(table).collect()} == {1: (1, 1), 2: (0, 2), 3: (1, 1), 4: (0, 4)}


def test_tables_needed():
    assert tables_needed(0.98, 20) == 45


@pytest.mark.parametrize("block_windows", [1 << 19, 7])
def test_contamination(spark, block_windows):
    rng = random.Random(9)
    items = [(1, text(rng, 30)), (2, "Short Item, here!"), (3, None), (4, "..."), (10, text(rng, 12)), (11, "SHORT item — here")]
    passage = items[0][1].split()
    texts = {
        0: text(rng, 50) + " " + " ".join(passage[5:20]) + " " + text(rng, 9),
        1: " ".join(passage[:9]),
        2: "a short. item, HERE short item here",
        3: None,
        4: "",
        5: text(rng, 30_000) + " " + items[4][1].upper(),
        6: "short item" + " x " + "here",
    }
    rows = [(k, t, "same", 3) for k, t in texts.items()]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, items string, contamination int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = contamination(docs, bench, block_windows=block_windows)
    assert found.columns == ["doc_id", "text", "items", "contamination"]
    got = [(r.doc_id, (r.contamination["n_words"], r.contamination["n_hit"], list(r.contamination["items"]))) for r in found.collect()]
    assert len(got) == len(rows) + 1 and dict(got) == plain_contamination(texts, items)
    assert contamination(docs.limit(0), bench, block_windows=block_windows).collect() == []
    assert all(r.contamination["n_hit"] == 0 for r in contamination(docs, bench.limit(0), block_windows=block_windows).collect())
