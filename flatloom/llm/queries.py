"""Registered queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..queries.registry import Query, table
from ..session import materialise, scratch_path
from . import oracles
from .class_lm import learn, scores
from .collocations import collocations
from .decontaminate import contamination
from .embedding_dedup import similar_embeddings
from .html_text import extract
from .kd_shards import kd_shards
from .licenses import license_scan
from .line_dedup import dedup_lines
from .mixing import capped_cells, sampled, with_cell
from .near_dedup import near_duplicates
from .quality import learn as learn_quality
from .quality import quality_score
from .token_ids import read_token_ids, write_token_ids
from .whitening import fit_whitening, whiten

#: Score from which a document is taken for good.
KEEP = 0.3

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


@query()
def op1_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(remainder() != 0)
    score = quality_score(learn_quality(documents, labels), F.col("text"))
    found = documents.select("doc_id", (remainder() == 0).alias("held_out"), score.alias("score"))
    return found.withColumn("predicted", (F.col("score") >= KEEP).cast("int"))


@query()
def op2_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kd_shards(table(spark, sf_dir, "documents"), shards=8)
    return found.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


@query(oracles.MIXING)
def op3_raked_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = with_cell(table(spark, sf_dir, "documents")).select("doc_id", "mix_cell")
    documents = materialise(documents, "mix-rows")
    found = sampled(documents, capped_cells(documents.select("mix_cell.*")))
    return found.select(
        "doc_id", "mix_cell.topic", F.col("mix_cell.tokens").alias("n_tokens"), F.round("mix_probability", 6).alias("probability"), F.col("mix_sampled").alias("sampled")
    )


@query(oracles.NEAR_DEDUP)
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query(oracles.EMBEDDING_DEDUP)
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_embeddings(table(spark, sf_dir, "embeddings"))


@query()
def op6_fuzzy_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    # Certainty: 1 for a phrase, else the share of the best notice's characters without edits.
    near = F.expr("array_max(transform(notices, x -> 1 - x.edits / greatest(x.end - x.begin, 1)))")
    base = F.size("places") > 0
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.expr("array_min(transform(places, x -> x.word))").alias("first_word"),
        F.expr("array_max(transform(places, x -> x.word))").alias("last_word"),
        F.expr("array_join(array_sort(array_distinct(transform(places, x -> x.label))), ',')").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        F.when(base, 1.0).otherwise(F.greatest(F.coalesce(near, F.lit(0.0)), F.lit(0.0))).alias("score"),
    )


@query(oracles.DECONTAMINATION)
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contamination.*").select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )



@query()
def op8_class_bigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scores(documents, learn(documents.filter(remainder() != 1)))
    return found.withColumn("held_out", remainder() == 1)


@query()
def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


@query(oracles.LINE_DEDUP)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


@query()
def op11_bit_plane_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-ids")
    write_token_ids(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    found = read_token_ids(spark, folder)
    n_tokens = (F.octet_length("ids") / 4).cast("bigint")
    return found.select("doc_id", "start", n_tokens.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query()
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return whiten(embeddings, fit_whitening(embeddings))


@query(oracles.COLLOCATIONS)
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
