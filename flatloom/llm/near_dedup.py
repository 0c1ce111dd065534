"""MinHash near-dedup with sequential Bayesian verification.

1. Documents of equal shingle sets form a class; only its smallest id goes on.
2. Signatures are banded; a bucket holds the classes that agree on a band.
3. A star first: in each bucket the smallest member is paired with the others. A large group of
   near copies so costs one pair per member and not all pairs. Buckets that then still span
   several components are dealt out whole, in blocks of bounded size, and every pair of blocks
   is compared by one task: no row is made for a pair, and no candidate is left out.
4. Signature batches of a pair are compared one after the other. After each batch the posterior
   of the similarity (uniform prior) is known; a pair that reaches the threshold with less than
   the chosen miss probability is pruned. The first batch is one bit of each of 128 hashes; the
   further batches are the hashes themselves. Pairs of one component need no comparison.
5. Survivors are verified on their full shingle sets, made anew from the whole texts.
6. Links give components by joins.

Banding is the only step that can miss a link. The number of bands follows from the threshold and
the chosen miss probability of a pair just there (a more similar one is missed with less): 28 bands
of 6 for 0.85 and 2e-6, 46 for 0.8 and 1e-6.

Edge cases: null and empty texts and texts without words have no shingles and link with
nothing; a null id links with nothing, its component is null and it is kept. Rows that repeat an
id count as one document. Columns other than doc_id and text are ignored. An empty table gives
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
from .joins import send_if_few
from .tokens import SPACED, Words, mix, windows, word_slices

SHINGLE = 5
ROWS = 6
#: Probability with which banding misses a pair at the threshold.
BAND_MISS = 2e-6
BATCH = 24
BITS = 128
MISS = 1e-6
#: Members of a block.
BLOCK = 256

_U = np.uint64


def bands_needed(threshold: float, miss: float = BAND_MISS) -> int:
    """The fewest bands that miss a pair of this similarity with at most this probability."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**ROWS)))


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of the first n hash functions."""
    seeds = np.random.default_rng(20240607).integers(0, 1 << 31, size=(n, 2), dtype=np.uint32)
    return seeds[:, 0] * np.uint32(2) + np.uint32(1), seeds[:, 1] * np.uint32(2)


def shingle_sets(w: Words, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, sorted; fewer words than n are one shingle."""
    runs = windows(w.hash, n)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(runs[a : b - n + 1])
        else:
            yield windows(w.hash[a:b], b - a) if b > a else np.zeros(0, dtype=_U)


def signature(shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The minimum of each hash function over a set."""
    multiply, add = functions
    low = np.full(len(multiply), np.iinfo(np.uint32).max, dtype=np.uint32)
    short = (shingles >> _U(32)).astype(np.uint32)
    for a in range(0, len(short), 256):
        block = short[a : a + 256, None] * multiply
        block += add
        np.minimum(low, block.min(axis=0), out=low)
    return low


def _sketches(signatures: np.ndarray) -> np.ndarray:
    """One bit of each of the first hashes, as two 64-bit numbers for each signature."""
    m = signatures[:, :BITS]
    m = (m ^ (m >> np.uint32(16))) * np.uint32(0x7FEB352D)
    m = (m ^ (m >> np.uint32(15))) * np.uint32(0x846CA68B)
    return np.packbits(m >> np.uint32(31) > 0, axis=1).view(np.int64)


def _bands(signatures: np.ndarray) -> np.ndarray:
    """64 bits for each band of each signature; the band's number is part of them."""
    parts = signatures.reshape(len(signatures), -1, ROWS).astype(_U)
    out = np.broadcast_to(np.arange(parts.shape[1], dtype=_U), parts.shape[:2]) * _U(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        out = mix(out + parts[:, :, i])
    return out


def features(documents: DataFrame, n_bands: int) -> DataFrame:
    """doc_id, n_shingles, a key of the shingle set, its signature and its band hashes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions = _functions(n_bands * ROWS)
        for batch in batches:
            for w in word_slices(batch.column(1), SPACED):
                sizes, keys, signatures = [], [], []
                for s in shingle_sets(w):
                    sizes.append(len(s))
                    keys.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64))
                    signatures.append(signature(s, functions))
                keys, signatures = np.array(keys), np.array(signatures)
                bands, sketches = _bands(signatures).view(np.int64), _sketches(signatures)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(w.lo, w.hi - w.lo),
                        pa.array(sizes, pa.int64()),
                        pa.array(keys[:, 0]),
                        pa.array(keys[:, 1]),
                        pa.array([s.tobytes() for s in signatures], pa.binary()),
                        pa.array(sketches[:, 0]),
                        pa.array(sketches[:, 1]),
                        pa.array(list(bands), pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "key_1", "key_2", "signature", "bits_1", "bits_2", "bands"],
                )

    id_type = documents.schema["doc_id"].dataType.simpleString()
    columns = "n_shingles bigint, key_1 bigint, key_2 bigint, signature binary, bits_1 bigint, bits_2 bigint, bands array<bigint>"
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scan, f"doc_id {id_type}, {columns}")


def most_differences(threshold: float, miss: float = MISS) -> int:
    """The most differing bits with which a pair is not pruned by the first batch.

    Bits of a pair of similarity x agree with probability (1 + x) / 2.
    """
    x = (np.arange(20_000) + 0.5) / 20_000
    found = 0
    for k in range(BITS + 1):
        log = k * np.log((1 - x) / 2) + (BITS - k) * np.log((1 + x) / 2)
        density = np.exp(log - log.max())
        if density[x >= threshold].sum() < miss * density.sum():
            break
        found = k
    return found


def least_matches(threshold: float, miss: float = MISS, n_bands: int | None = None) -> dict[int, int]:
    """For each number of compared hashes, the fewest matches with which a pair is not pruned.

    The posterior of the similarity after m matches of n is Beta(1 + m, 1 + n - m).
    """
    hashes = (n_bands or bands_needed(threshold)) * ROWS
    x = (np.arange(20_000) + 0.5) / 20_000
    above, found = x >= threshold, {}
    for n in range(BATCH, hashes + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(x) + (n - m) * np.log1p(-x)
            density = np.exp(log - log.max())
            if density[above].sum() >= miss * density.sum():
                found[n] = m
                break
    return found


def likely(pairs: DataFrame, signatures: DataFrame, least: dict[int, int]) -> DataFrame:
    """The pairs (a, b) that no batch of their signatures rules out."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            left, right = (
                np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(len(batch), -1) for c in (batch.column(2), batch.column(3))
            )
            alive, matches = np.arange(len(batch)), np.zeros(len(batch), dtype=np.int64)
            for n, m in least.items():
                batch_of = slice(n - BATCH, n)
                matches = matches + (left[alive, batch_of] == right[alive, batch_of]).sum(axis=1)
                passed = matches >= m
                alive, matches = alive[passed], matches[passed]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(alive)) for c in (batch.column(0), batch.column(1))], names=["a", "b"])

    one = signatures.select(F.col("doc_id").alias("a"), F.col("signature").alias("sig_a"))
    two = signatures.select(F.col("doc_id").alias("b"), F.col("signature").alias("sig_b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "sig_a", "sig_b")
    return both.mapInArrow(scan, pairs.select("a", "b").schema).distinct()


def _alike(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(one, two, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(one) + len(two) - common)


def _sets(texts: pa.Array) -> list[np.ndarray]:
    return [s for w in word_slices(texts, SPACED) for s in shingle_sets(w)]


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union of their full shingle sets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                both = zip(_sets(part.column(2)), _sets(part.column(3)), strict=True)
                keep = pa.array([i for i, (one, two) in enumerate(both) if _alike(one, two, percent)], pa.int64())
                yield pa.RecordBatch.from_arrays([c.take(keep) for c in (part.column(0), part.column(1))], names=["a", "b"])

    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(scan, pairs.select("a", "b").schema).distinct()


def _links_of_blocks(blocks: DataFrame, percent: int, least: dict[int, int], id_type: str) -> DataFrame:
    """Links (a, b) between members of different components, found within each pair of blocks.

    A pair is compared in the first bucket it shares. Links that join nothing new within the
    block are not looked for.
    """
    differences = most_differences(percent / 100)

    def group(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("doc_id")
        n = len(table)
        ids, here = table["doc_id"], table["bucket"][0].as_py()
        signatures = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint32).reshape(n, -1)
        bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(n, -1)
        bits = np.stack([table[c].to_numpy() for c in ("bits_1", "bits_2")], axis=1).view(_U)
        sizes, part = table["n_shingles"].to_numpy(), table["part"].to_numpy()
        one, two = table["part_1"][0].as_py(), table["part_2"][0].as_py()
        root = np.unique(table["label"].to_numpy(zero_copy_only=False), return_inverse=True)[1]
        sets: dict[int, np.ndarray] = {}

        def shingles(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = _sets(table["text"].slice(i, 1).combine_chunks())[0]
            return sets[i]

        right, links = np.flatnonzero(part == two), []
        for i in np.flatnonzero(part == one).tolist():
            at = right[right > i] if one == two else right
            at = at[root[at] != root[i]]
            low, high = np.minimum(sizes[at], sizes[i]), np.maximum(sizes[at], sizes[i])
            at = at[100 * low >= percent * high]
            at = at[np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1) <= differences]
            same = bands[at] == bands[i]
            at = at[bands[i][np.argmax(same, axis=1)] == here]
            matches = np.zeros(len(at), dtype=np.int64)
            for n_compared, m in least.items():
                batch = slice(n_compared - BATCH, n_compared)
                matches = matches + (signatures[at, batch] == signatures[i, batch]).sum(axis=1)
                at, matches = at[matches >= m], matches[matches >= m]
            for j in at.tolist():
                if root[i] != root[j] and _alike(shingles(i), shingles(j), percent):
                    links.append((i, j))
                    root[root == root[j]] = root[i]
        ends = np.array(links, dtype=np.int64).reshape(-1, 2)
        return pa.table({c: ids.take(pa.array(ends[:, k])) for k, c in enumerate("ab")})

    return blocks.groupBy("bucket", "part_1", "part_2").applyInArrow(group, f"a {id_type}, b {id_type}")


def near_duplicates(documents: DataFrame, percent: int = 85, block: int = BLOCK, miss: float = BAND_MISS) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest linked id) and kept."""
    n_bands = bands_needed(percent / 100, miss)
    least = least_matches(percent / 100, n_bands=n_bands)
    found = materialise(features(documents, n_bands), "near-features")
    real = found.filter("n_shingles > 0 and doc_id is not null")
    keys = ["key_1", "key_2"]
    copies = real.groupBy(*keys).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    copies = copies.select(*keys, "first_id")
    first = F.coalesce("first_id", "doc_id")
    classes = materialise(real.select("doc_id", *keys).join(copies, keys, "left").select("doc_id", *keys, first.alias("class_id")), "near-classes")
    # A class is its first document; rows that repeat it count once.
    others = materialise(classes.filter("doc_id <> class_id").select("doc_id", *keys).distinct(), "near-copies")
    own = real.join(send_if_few(others, 1 << 18), ["doc_id", *keys], "left_anti")

    rows = own.select("doc_id", F.explode("bands").alias("bucket"))
    pivots = rows.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    shared = materialise(rows.join(pivots.select("bucket"), "bucket"), "near-shared")
    ids = shared.select("doc_id").distinct()
    own = materialise(own.join(ids, "doc_id").dropDuplicates(["doc_id", *keys]).drop(*keys), "near-signatures")
    facts = ["n_shingles", "bits_1", "bits_2"]
    members = materialise(shared.join(own.select("doc_id", *facts), "doc_id"), "near-members")
    all_texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))

    def texts_of(some: DataFrame) -> DataFrame:
        needed = send_if_few(materialise(some.distinct(), "near-needed"))
        return all_texts.join(needed, F.col("doc_id") == F.col("id")).drop("id").distinct()

    # The star.
    close = F.expr(
        f"100 * least(a.n_shingles, b.n_shingles) >= {int(percent)} * greatest(a.n_shingles, b.n_shingles) and "
        f"bit_count(a.bits_1 ^ b.bits_1) + bit_count(a.bits_2 ^ b.bits_2) <= {most_differences(percent / 100)}"
    )
    pivots = members.groupBy("bucket").agg(F.min(F.struct("doc_id", *facts)).alias("pivot")).select("bucket", "pivot.*")
    same_bucket = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.doc_id") < F.col("b.doc_id"))
    pairs = pivots.alias("a").join(members.alias("b"), same_bucket & close)
    pairs = materialise(pairs.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct(), "near-pairs")
    survivors = materialise(likely(pairs, own, least), "near-survivors")
    ends = survivors.select(F.col("a").alias("id")).union(survivors.select("b"))
    links = materialise(verified(survivors, texts_of(ends), percent), "near-links")
    labels = components(links)

    # The rest of the buckets that are still apart.
    now = members.join(labels, F.col("doc_id") == F.col("node"), "left")
    now = now.select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("label"))
    apart = now.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"))
    apart = apart.filter("low < high").select("bucket", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    rest = now.join(apart, "bucket").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    rest = materialise(rest, "near-rest")
    if not rest.isEmpty():
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        blocks = rest.withColumn("other", other).select(
            "bucket", "doc_id", "label", "part", F.least("part", "other").alias("part_1"), F.greatest("part", "other").alias("part_2")
        )
        blocks = blocks.join(own, "doc_id").join(texts_of(rest.select(F.col("doc_id").alias("id"))), "doc_id")
        id_type = documents.schema["doc_id"].dataType.simpleString()
        labels = components(links.unionByName(_links_of_blocks(blocks, percent, least, id_type)))

    labels = labels.withColumnsRenamed({"node": "class_id", "component": "component_class"})
    named = classes.select("doc_id", "class_id").distinct().join(labels, "class_id", "left")
    # An id with several texts has several classes; the smallest names it.
    named = named.groupBy(F.col("doc_id").alias("id")).agg(F.min(F.coalesce("component_class", "class_id")).alias("component_id"))
    out = found.select("doc_id", "n_shingles").join(named, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("component_id", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))
