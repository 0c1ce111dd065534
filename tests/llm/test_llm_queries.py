"""The registered queries against their SQL, and the pipeline against plain versions."""

import glob
import os
import zlib

import duckdb
import pytest
from conftest import SF_DIR
from llm_brute import contamination, near_components
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from flatloom.llm import queries


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([v[i] for i in order]) for v in values)


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    found = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, found.fetchall())


def test_registered():
    assert {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


def test_pipeline_against_plain_versions(spark):
    """Each stage is given what its predecessor kept."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        columns = docs.columns
        docs = corpus_pipeline.materialise(stage(spark, docs, SF_DIR), "test")
        kept[name] = {r.doc_id for r in docs.collect()}
        assert kept[name] <= set(before)
        if name == "MinHash near-dedup":
            assert kept[name] == {k for k, (_, c) in near_components(before, percent=corpus_pipeline.NEAR_PERCENT).items() if k == c}
        if name == "benchmark decontamination":
            assert kept[name] == {k for k, (_, hit, _) in contamination(before, items).items() if not hit}
        if name != "k-d tree sharding":
            assert docs.columns == columns
        else:
            assert kept[name] == set(before)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    ids = {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    marked = [d for d in labels if d in ids]
    right = sum((d in kept["quality classifier"]) == (labels[d] == 1) for d in marked)
    assert right >= 0.93 * len(marked)


def test_held_out_by_crc(spark):
    found = queries.QUERIES["op1_attention_quality"](spark, SF_DIR).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found)
    assert all(r.predicted == int(r.score >= 0.3) for r in found)


def test_stages_keep_clashing_columns_and_take_null_ids_and_empty_tables(spark):
    """Columns that a stage uses itself come back as they were; repeated ids follow the stated rule."""
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words, "en", "s"), (1, "a other", "en", "s"), (1, None, "en", "s"), (2, words, "en", "s"), (None, "no id at all", None, "s"), (None, "no id at all", "en", None), (7, None, "en", "s"), (8, "", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = ("_gone", "_again", "gone_id", "Again_id", "contamination", "mix_cell", "mix_sampled", "a.b")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.coalesce("text", F.lit("-"))) for c in extra})
    for name, stage in corpus_pipeline.STAGES[1:]:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, SF_DIR)
            if name == corpus_pipeline.STAGES[-1][0]:
                assert out.count() == given.count()
                continue
            assert out.columns == given.columns
            kept = out.collect()
            assert all(r[c] == c + (r.text or ("-" if r.text is None else "")) for r in kept for c in extra)
            if name == "MinHash near-dedup":
                found = sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None and r.doc_id < 7)
                assert found == ([(1, "a other")] if given is docs else [])
