"""Embedding near-dedup: random-hyperplane sign hashing, exact cosine, connected components.

1. Equal vectors of a label form a class; only its smallest id goes on, with the class size.
2. Each class gets one bucket in each of several tables: the signs of its products with the
   table's random hyperplanes. Two vectors of cosine c agree on a sign with probability
   1 - arccos(c) / pi; 45 tables of 20 signs miss a pair of cosine 0.98 with probability 8e-7.
3. Buckets of more than one class are dealt out by bucket. A bucket of any size is cut into
   blocks of bounded size, and every pair of blocks is a group of its own: products of blocks
   are matrix products, and no row is made for a pair.
4. A pair counts in the first table in which it meets. A group returns, for each class, the
   number of vectors it links to and one link to the smallest class of its local component.
5. Those links give components by joins.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows
with a null label or id, link with nothing (a null id: component null, kept). Vectors of other
lengths never link. Rows that repeat an id and its vector are one vector. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .components import components
from .tokens import mix

BITS = 20
MISS = 1e-6
BLOCK = 512

_U = np.uint64


def tables_needed(threshold: float, bits: int = BITS, miss: float = MISS) -> int:
    """Tables after which a pair at the threshold is missed with at most this probability."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log(1 - agree))


def sign_buckets(vectors: np.ndarray, labels: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """A 64-bit bucket per vector and table; label, length and table are part of it."""
    n, size = vectors.shape
    planes = np.random.default_rng(size).standard_normal((size, tables * bits))
    signs = (vectors @ planes > 0).reshape(n, tables, bits)
    packed = (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2).astype(_U)
    group = mix(labels.astype(np.int64).view(_U) * _U(0x9E3779B97F4A7C15) + _U(size))
    table = np.arange(tables, dtype=_U) << _U(48)
    return mix(mix(packed + table[None, :]) + group[:, None])


def _vectors(embeddings: DataFrame, tables: int, bits: int) -> DataFrame:
    """Usable vectors: vec_id, a key of label and vector, the unit vector's bytes, buckets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            labels = batch.column(2).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes[sizes > 0]):
                own = np.flatnonzero(sizes == size)
                vectors = flat[starts[own][:, None] + np.arange(size)] + 0.0
                norms = np.linalg.norm(vectors / np.abs(vectors).max(axis=1, keepdims=True).clip(min=1e-300), axis=1)
                good = np.isfinite(vectors).all(axis=1) & (norms > 0)
                own, vectors = own[good], vectors[good]
                # Scaled first, so that neither large nor tiny components leave the range of doubles.
                scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
                unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
                buckets = sign_buckets(unit, labels[own], tables, bits)
                keys = np.array(
                    [np.frombuffer(hashlib.blake2b(v.tobytes(), digest_size=16, salt=k.tobytes()).digest(), np.int64) for v, k in zip(vectors, labels[own], strict=True)],
                    dtype=np.int64,
                ).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(own)),
                        pa.array(keys[:, 0]),
                        pa.array(keys[:, 1]),
                        pa.array([u.tobytes() for u in unit], pa.binary()),
                        pa.array(list(buckets.view(np.int64)), pa.list_(pa.int64())),
                    ],
                    names=["vec_id", "key_1", "key_2", "unit", "buckets"],
                )

    usable = embeddings.filter("vec_id is not null and label is not null and embedding is not null").filter(
        "not exists(embedding, x -> x is null)"
    )
    # Labels of any type; whole numbers stand for themselves, others for the hash of their text.
    whole = embeddings.schema["label"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    label = F.col("label").cast("bigint") if whole else F.xxhash64(F.col("label").cast("string"))
    usable = usable.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), label.alias("label"))
    id_type = embeddings.schema["vec_id"].dataType.simpleString()
    return usable.mapInArrow(scan, f"vec_id {id_type}, key_1 bigint, key_2 bigint, unit binary, buckets array<bigint>")


def _roots(n: int, ones: np.ndarray, twos: np.ndarray) -> np.ndarray:
    """The smallest position that each position is linked with, over any number of links."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, ones, root[twos])
        np.minimum.at(low, twos, root[ones])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _links(blocks: DataFrame, threshold: float, id_type: str) -> DataFrame:
    """Per group of blocks and linked class: vec_id, n_links, root."""

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        ids, size = table["vec_id"], table["size"].to_numpy()
        unit = np.frombuffer(b"".join(table["unit"].to_pylist()), np.float64).reshape(len(ids), -1)
        buckets = table["buckets"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        here, part = table["bucket"][0].as_py(), table["part"].to_numpy()
        one, two = table["part_1"][0].as_py(), table["part_2"][0].as_py()
        left, right = np.flatnonzero(part == one), np.flatnonzero(part == two)
        i, j = np.nonzero(unit[left] @ unit[right].T >= threshold)
        i, j = left[i], right[j]
        if one == two:
            i, j = i[i < j], j[i < j]
        first = np.argmax(buckets[i] == buckets[j], axis=1)
        mine = buckets[i, first] == here
        counts = np.zeros(len(ids), dtype=np.int64)
        np.add.at(counts, i[mine], size[j[mine]])
        np.add.at(counts, j[mine], size[i[mine]])
        root = _roots(len(ids), i, j)
        linked = np.unique(np.concatenate([i, j]))
        take = lambda at: ids.take(pa.array(at)).combine_chunks()
        return pa.table({"vec_id": take(linked), "n_links": pa.array(counts[linked]), "root": take(root[linked])})

    return blocks.groupBy("bucket", "part_1", "part_2").applyInArrow(group, f"vec_id {id_type}, n_links bigint, root {id_type}")


def similar_embeddings(embeddings: DataFrame, threshold: float = 0.98, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked directly), component_id and kept."""
    tables = tables_needed(threshold, bits)
    id_type = embeddings.schema["vec_id"].dataType.simpleString()
    keys = ["key_1", "key_2"]
    vectors = materialise(_vectors(embeddings, tables, bits), "vectors")
    ids = vectors.select("vec_id", *keys).distinct()
    sizes = ids.groupBy(*keys).agg(F.min("vec_id").alias("class_id"), F.count("*").alias("size"))
    classes = materialise(sizes, "vector-classes")
    own = vectors.join(classes, keys).filter("vec_id = class_id").select("vec_id", *keys, "size", "unit", "buckets")
    own = materialise(own.dropDuplicates(["vec_id", *keys]), "vector-firsts")

    rows = own.select("vec_id", *keys, F.explode("buckets").alias("bucket"))
    full = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = rows.join(full, "bucket").withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    members = members.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = members.select(
        "vec_id", *keys, "bucket", "part", F.least("part", "other").alias("part_1"), F.greatest("part", "other").alias("part_2")
    ).join(own, ["vec_id", *keys])
    found = materialise(_links(blocks.drop(*keys), threshold, id_type), "vector-links")

    counts = found.groupBy("vec_id").agg(F.sum("n_links").alias("n_others"))
    labels = components(found.select(F.col("root").alias("a"), F.col("vec_id").alias("b")))
    named = (
        classes.join(counts.withColumnRenamed("vec_id", "class_id"), "class_id", "left")
        .join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
        .select(*keys, (F.coalesce("n_others", F.lit(0)) + F.col("size") - 1).alias("n"), F.coalesce("component", "class_id").alias("c"))
    )
    named = ids.join(named, keys).groupBy(F.col("vec_id").alias("id")).agg(F.max("n").alias("n"), F.min("c").alias("c"))
    out = embeddings.select("vec_id").join(named, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("c", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
