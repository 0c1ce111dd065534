"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Items give windows of `n` words, an item of fewer words one window. Document texts are scanned
whole; a window whose hash is in the set is verified word by word, and the words it covers are
hit. The set is sent to all executors in blocks of a bounded number of windows: a benchmark of
any size is scanned for block by block, and only the hits of each block meet again.

Edge cases: a null or empty text, and an item without words, has no windows. Items with equal
texts all count. A null item id counts as the empty string. Repeated rows give repeated rows.
Other columns are kept; one named `contamination` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .tokens import ALNUM, Words, window_starts, windows, word_slices

NGRAM = 10
#: Windows sent to the executors at once: with their words, some 100 bytes each.
BLOCK_WINDOWS = 1 << 19

_WINDOWS = "item string, n int, hash bigint, words binary"


def item_windows(items: DataFrame, n: int = NGRAM) -> DataFrame:
    """The distinct windows of each item: its id as text, the words, their number and hash."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for w in word_slices(batch.column(1), ALNUM):
                rows = []
                for i in range(w.hi - w.lo):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    size = min(n, b - a)
                    if size:
                        hashes = windows(w.hash[a:b], size).view(np.int64)
                        rows += [(ids[w.lo + i], size, int(h), w.normal(a + k, a + k + size)) for k, h in enumerate(hashes)]
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary())
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["item", "n", "hash", "words"])

    ids = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    return items.select(ids.alias("item"), F.col("text").cast("string").alias("text")).mapInArrow(scan, _WINDOWS).distinct()


class WindowSet:
    """A block of windows, looked up by hash and verified by their words."""

    def __init__(self, rows: pa.Table) -> None:
        order = np.lexsort((rows["hash"].to_numpy(), rows["n"].to_numpy()))
        self.item = rows["item"].to_numpy(zero_copy_only=False)[order]
        self.words = rows["words"].to_numpy(zero_copy_only=False)[order]
        sizes, hashes = rows["n"].to_numpy()[order], rows["hash"].to_numpy()[order]
        self.by_size = {}
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            self.by_size[int(size)] = (hashes[own], int(own[0]))

    def hits(self, w: Words) -> list[tuple[int, int, int, list[str]]]:
        """(text, first word, number of words, items) of each verified window."""
        found = []
        for size, (known, base) in self.by_size.items():
            at = window_starts(w.first, size)
            if not len(at):
                continue
            own = windows(w.hash, size)[at].view(np.int64)
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            for k in np.flatnonzero(known[place] == own):
                word, slot = int(at[k]), int(place[k])
                text, items = w.normal(word, word + size), []
                while slot < len(known) and known[slot] == own[k]:
                    if self.words[base + slot] == text:
                        items.append(str(self.item[base + slot]))
                    slot += 1
                if items:
                    row = int(np.searchsorted(w.first, word, side="right")) - 1
                    found.append((row, word - int(w.first[row]), size, items))
        return found


_FOUND = "struct<n_words:bigint,spans:array<struct<first_word:bigint,n:bigint>>,items:array<string>>"


def _scan(text: Column, block: Broadcast) -> Column:
    """Per text: number of words, verified windows and the items they come from."""

    def scan(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        wanted = WindowSet(block.value)
        for column in columns:
            n_words = np.zeros(len(column), dtype=np.int64)
            spans: list[list[dict]] = [[] for _ in range(len(column))]
            items: list[set[str]] = [set() for _ in range(len(column))]
            for w in word_slices(column, ALNUM):
                n_words[w.lo : w.hi] = np.diff(w.first)
                for row, word, size, names in wanted.hits(w):
                    spans[w.lo + row].append({"first_word": word, "n": size})
                    items[w.lo + row].update(names)
            span = pa.list_(pa.struct([("first_word", pa.int64()), ("n", pa.int64())]))
            yield pa.StructArray.from_arrays(
                [pa.array(n_words), pa.array(spans, span), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                names=["n_words", "spans", "items"],
            )

    # The annotations are read as types, which this module keeps as text.
    scan.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(scan, _FOUND)(text)


def contamination(documents: DataFrame, items: DataFrame, n: int = NGRAM, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The columns of `documents` and a struct `contamination`: n_words, n_hit, spans (first word
    and number of words of every hit window) and items (ids of the items with a window in the
    text, sorted as strings)."""
    text = F.col("text").cast("string")
    windows_found = materialise(item_windows(items, n), "item-windows")
    n_blocks = max(1, -(-windows_found.count() // block_windows))
    block = F.pmod(F.xxhash64("hash"), F.lit(n_blocks))
    send = documents.sparkSession.sparkContext.broadcast
    blocks = [send(windows_found.filter(block == i).toArrow()) for i in range(n_blocks)]
    if n_blocks == 1:
        out = documents.withColumn("contamination", _scan(text, blocks[0]))
    else:
        key = F.struct(F.col("doc_id").cast("string").alias("id"), F.xxhash64(text).alias("text"))
        hits = None
        for b in blocks:
            own = documents.select(key.alias("hit_key"), _scan(text, b).alias("found")).filter("size(found.spans) > 0")
            hits = own if hits is None else hits.unionByName(own)
        hits = hits.groupBy("hit_key").agg(
            F.array_distinct(F.flatten(F.collect_set("found.spans"))).alias("hit_spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("found.items")))).alias("hit_items"),
        )
        # The words of every text, by a block that holds no window.
        none = send(windows_found.limit(0).toArrow())
        out = documents.withColumn("contamination", _scan(text, none)).withColumn("hit_own", key)
        same = F.col("hit_own.id").eqNullSafe(F.col("hit_key.id")) & (F.col("hit_own.text") == F.col("hit_key.text"))
        merged = [F.coalesce(f"hit_{c}", f"contamination.{c}").alias(c) for c in ("spans", "items")]
        out = out.join(hits, same, "left").withColumn("contamination", F.struct("contamination.n_words", *merged))
        out = out.drop("hit_own", "hit_key", "hit_spans", "hit_items")
    # Words covered by sorted windows: each adds what lies beyond the furthest word so far.
    covered = F.expr(
        "aggregate(array_sort(contamination.spans), named_struct('upto', 0L, 'n', 0L), (s, x) -> named_struct("
        "'upto', greatest(s.upto, x.first_word + x.n),"
        "'n', s.n + greatest(0L, x.first_word + x.n - greatest(s.upto, x.first_word))), s -> s.n)"
    )
    return out.withColumn("contamination", F.struct("contamination.n_words", covered.alias("n_hit"), "contamination.spans", "contamination.items"))
