"""Phrase collocation mining: HAT-trie counting with spilled, sorted runs.

Texts are cut at marks and line ends into pieces and these into words. Phrases of up to `longest`
words are counted per language. A phrase can have `least` occurrences only if its words, its pairs
and its own hash have, so passes over the words, the hashes of pairs and those of longer phrases
first make filters of bounded size (`bloom.py`). They only save work: every phrase with `least`
occurrences is named, and all that are named are counted by their words.

1. A task counts in a HAT-trie over the ids of its own words. If the trie holds too many entries,
   whole subtrees leave it as runs sorted by the phrase. Every task names most frequent phrases
   once, so splits of the table are counted together, up to `COUNTED_WORDS` words a task.
2. Runs are dealt by the prefix of their phrases: the first word, or two where the first is hot (at
   most `HOT` of them, by their share of all words). A partition sorts its runs into one, by disk
   if need be, and adds up neighbours as they stream by; no group is ever held.
3. Candidates are joined with the counts of their first and last parts for every cut; the
   arithmetic is in decimals without fractions. Candidates inside a longer one of equal count go.

Edge cases: null and empty texts have no words. A null language is `und`, and counts with it.
Repeated rows count each time, null ids too; no other column is read. A phrase takes any bytes
but spaces, tabs and marks. A language of fewer words than `least` has no rows; an empty table
gives an empty result. Ties are broken by count, then by the bytes of the phrase.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .bloom import Bloom, bloom
from .hat_trie import HatTrie
from .tokens import Words, byte_table, mix, windows, word_slices

LEAST, LONGEST, TOP = 100, 5, 2000
#: Percent of its own count that a longer candidate must have to replace a shorter one.
INSIDE_PERCENT = 100
#: Entries a task holds in its trie, and words it holds counts or ids of.
TRIE_ENTRIES, TASK_WORDS = 400_000, 300_000
#: Words a task that counts phrases reads at least, once every core has two tasks.
COUNTED_WORDS = 1 << 24
#: Prefixes that hold more than this share of all words are dealt by one word more.
HOT = 1024

#: Marks and line ends become line feeds, A-Z are lowered.
_CUT = bytes(10 if c in b".,;:!?\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))

_RUN = "lang string, prefix string, phrase string, f bigint"
_SCHEMA = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
_ROWS = 1 << 16
#: Hashes a task counts together.
_HASHES = 1 << 21
_MARKS = b".,;:!?\n\x0b\x0c\r"
_WORDS = byte_table({*_MARKS, 0x20, 0x09})
_IS_MARK = np.isin(np.arange(256), list(_MARKS))


class Output:
    """Rows of runs, gathered into Arrow batches."""

    def __init__(self, hot: frozenset[tuple[str, bytes]]) -> None:
        self.hot, self.rows = hot, []

    def prefix(self, lang: str, phrase: bytes) -> bytes:
        """The shortest beginning of the phrase that is not hot."""
        end = phrase.find(b" ")
        while end >= 0 and (lang, phrase[:end]) in self.hot:
            end = phrase.find(b" ", end + 1)
        return phrase if end < 0 else phrase[:end]

    def add(self, lang: str, run: Iterator[tuple[bytes, int]]) -> Iterator[pa.RecordBatch]:
        for phrase, count in run:
            self.rows.append((lang, self.prefix(lang, phrase), phrase, count))
            if len(self.rows) >= _ROWS:
                yield self.batch()

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * 4
        self.rows = []
        lang, prefix, phrase, f = columns
        texts = [pa.array(c, pa.binary()).cast(pa.string()) for c in (prefix, phrase)]
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), *texts, pa.array(f, pa.int64())], schema=_SCHEMA)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    for batch in batches:
        lang, text = batch.column(0), batch.column(1)
        for i in range(len(batch)):
            yield lang[i].as_py(), text[i].as_py()


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of words; a trie of one level is a hash container. The empty phrase counts all."""
    counts, out = {}, Output(frozenset())

    def spilled() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            own[b""] = own.total()
            yield from out.add(lang, sorted(own.items()))
        counts.clear()

    for lang, text in _texts(batches):
        counts.setdefault(lang, Counter()).update(text.encode().translate(_CUT).split())
        if sum(map(len, counts.values())) > TASK_WORDS:
            yield from spilled()
    yield from spilled()
    yield out.batch()


class Slice:
    """The words of some texts: their hashes, and which windows lie in one piece.

    A window's hash covers its words and its language.
    """

    def __init__(self, w: Words, langs: list[str]) -> None:
        self.words, self.n = w, len(w.start)
        self.langs, row = langs[w.lo : w.hi], w.row
        seeds = {lang: np.uint64(zlib.crc32(lang.encode()) * 0x9E3779B1 + 1) for lang in set(self.langs)}
        self.seed = np.array([seeds[x] for x in self.langs], np.uint64)[row]
        marks = np.cumsum(_IS_MARK[w.data])[w.start] if self.n else np.zeros(0, np.int64)
        # A word goes on a piece if neither a mark nor a new text stands before it.
        self.goes_on = (marks[1:] == marks[:-1]) & (row[1:] == row[:-1])

    def hashes(self, size: int) -> np.ndarray:
        return mix(windows(self.words.hash, size) ^ self.seed[: max(self.n - size + 1, 0)])

    def linked(self, words: Bloom, pairs: Bloom | None) -> np.ndarray:
        """Whether the pair of words from each place on lies in a piece and is named."""
        known = words.names(self.hashes(1))
        good = self.goes_on & known[1:] & known[:-1]
        if pairs is not None:
            at = np.flatnonzero(good)
            good[at] = pairs.names(self.hashes(2)[at])
        return good

    def starts(self, linked: np.ndarray, size: int) -> np.ndarray:
        """Where a window of linked words begins."""
        good = linked[: max(self.n - size + 1, 0)].copy()
        for i in range(1, size - 1):
            good &= linked[i : len(good) + i]
        return np.flatnonzero(good)

    def text(self) -> list[bytes]:
        """All words, in the order of the hashes."""
        found, w = [], self.words
        data, ends = w.data.tobytes().translate(_CUT), w.offsets
        for a, b in pairwise(ends.tolist()):
            found += data[a:b].split()
        return found


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for w in word_slices(batch.column(1), _WORDS):
            yield Slice(w, langs)


def named_windows(rows: DataFrame, sizes: range, words: Bloom, pairs: Bloom | None, least: int, n_words: int) -> Bloom:
    """A filter that names all windows of these sizes with `least` occurrences.

    Windows are counted by 40 bits of their hash, of which the first ones are the part they are
    dealt to; few others share all 40. A part holds about a million windows at most, whatever
    the size of the texts.
    """
    part_bits = min(max(n_words.bit_length() - 20, 4), 20)
    low_bits = np.uint64(40 - part_bits)

    def runs(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]) >> np.uint64(24), return_counts=True)
        parts = (keys >> low_bits).astype(np.int32)
        first = np.flatnonzero(np.concatenate([[len(keys) > 0], parts[1:] != parts[:-1]])[: len(keys)])
        low = keys & np.uint64((1 << int(low_bits)) - 1)
        kind = "<u4" if int(low_bits) <= 32 else "<u8"
        last = [*first[1:].tolist(), len(keys)]
        # No more is asked of a count than whether it reaches `least`.
        counts = np.minimum(counts, least).astype("<u4" if least > 255 else "<u1")
        columns = [[v[a:b].tobytes() for a, b in zip(first.tolist(), last)] for v in (low.astype(kind), counts)]
        yield pa.RecordBatch.from_arrays([pa.array(parts[first]), *(pa.array(c, pa.binary()) for c in columns)], names=["part", "keys", "counts"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for s in _slices(batches):
            linked = s.linked(words, pairs)
            for size in sizes:
                held.append(s.hashes(size)[s.starts(linked, size)])
                n += len(held[-1])
            if n > _HASHES:
                yield from runs(held)
                held, n = [], 0
        yield from runs(held)

    def frequent(table: pa.Table) -> pa.Table:
        part, keys, counts = table["part"][0].as_py(), table["keys"].to_pylist(), table["counts"].to_pylist()
        kind = "<u4" if int(low_bits) <= 32 else "<u8"
        low = np.concatenate([np.frombuffer(k, kind) for k in keys])
        n = np.concatenate([np.frombuffer(c, "<u4" if least > 255 else "<u1") for c in counts])
        order = np.argsort(low, kind="stable")
        low = low[order]
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        keep = np.add.reduceat(n[order].astype(np.int64), first) >= least
        whole = (np.uint64(part) << low_bits) | low[first][keep].astype(np.uint64)
        return pa.table({"h": pa.array(mix(whole).view(np.int64))})

    parts = rows.mapInArrow(hashed, "part int, keys binary, counts binary")
    found = parts.groupBy("part").applyInArrow(frequent, "h bigint")
    return bloom(materialise(found, "windows"))


def _named(windows: Bloom, hashes: np.ndarray) -> np.ndarray:
    return windows.names(mix(hashes >> np.uint64(24)))


class Pairs:
    """The filter of pairs, asked for window hashes."""

    def __init__(self, windows: Bloom) -> None:
        self.windows = windows

    def names(self, hashes: np.ndarray) -> np.ndarray:
        return _named(self.windows, hashes)


class Counting:
    """Counts the phrases of one task that the filters name, in a trie of its own word ids."""

    def __init__(self, longest: int, words: Bloom, pairs: Pairs, longer: Pairs | None, hot: frozenset) -> None:
        self.longest, self.words, self.pairs, self.longer = longest, words, pairs, longer
        self.out = Output(hot)
        self.reset()

    def reset(self) -> None:
        self.trie, self.text, self.lang, self.ids = HatTrie(), [b""], [""], {}

    def number(self, lang: str, word: bytes) -> int:
        found = self.ids.get((lang, word))
        if found is None:
            found = self.ids[lang, word] = len(self.text)
            self.text.append(word)
            self.lang.append(lang)
        return found

    def runs(self, keep: int = 0) -> Iterator[pa.RecordBatch]:
        for run in self.trie.spill(self.text, keep):
            yield from self.out.add(self.lang[run[0][1][0]], ((phrase, n) for phrase, _, n in run))

    def add(self, s: Slice) -> None:
        linked = s.linked(self.words, self.pairs)
        starts = {2: np.flatnonzero(linked)}
        for size in range(3, self.longest + 1):
            at = s.starts(linked, size)
            starts[size] = at if self.longer is None else at[self.longer.names(s.hashes(size)[at])]
        used = np.zeros(s.n, bool)
        used[starts[2]] = used[starts[2] + 1] = True
        ids, text, row = np.zeros(s.n, np.int64), s.text(), s.words.row
        at = np.flatnonzero(used)
        ids[at] = [self.number(s.langs[r], text[i]) for i, r in zip(at.tolist(), row[at].tolist())]
        for size, at in starts.items():
            for phrase, n in Counter(zip(*(ids[at + i].tolist() for i in range(size)))).items():
                self.trie.add(phrase, n)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches):
            self.add(s)
            if self.trie.size > TRIE_ENTRIES:
                yield from self.runs(keep=TRIE_ENTRIES // 2)
            if len(self.ids) > TASK_WORDS:
                yield from self.runs()
                self.reset()
        yield from self.runs()
        yield self.out.batch()


def merged(runs: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, f) of phrases with `least` occurrences, and of the empty phrase.

    Runs are dealt by prefix and sorted there; equal phrases are neighbours and are added up
    batch by batch, the last one of a batch is carried on.
    """
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])

    def enough(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keep = pc.or_(pc.equal(rows["phrase"], ""), pc.greater_equal(rows["f"], least))
        yield from rows.filter(keep).to_batches()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = schema.empty_table()
        for batch in batches:
            rows = pa.concat_tables([held, pa.Table.from_batches([batch]).cast(schema)]).combine_chunks()
            if not len(rows):
                continue
            new = [pc.not_equal(rows[c][1:], rows[c][:-1]).to_numpy() for c in ("lang", "phrase")]
            first = np.flatnonzero(np.concatenate([[True], new[0] | new[1]]))
            f = pa.array(np.add.reduceat(rows["f"].to_numpy(), first))
            rows = rows.take(first).set_column(2, "f", f)
            held = rows.slice(len(rows) - 1)
            yield from enough(rows.slice(0, len(rows) - 1))
        yield from enough(held)

    dealt = runs.repartition("lang", "prefix").sortWithinPartitions("lang", "phrase")
    return dealt.select("lang", "phrase", "f").mapInArrow(add_up, "lang string, phrase string, f bigint")


def _together(rows: DataFrame, n_words: int) -> DataFrame:
    """The rows in fewer partitions: the rows of runs are as many as tasks times phrases."""
    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, n_words // COUNTED_WORDS)
    return rows.coalesce(tasks)


def _hot(counts: DataFrame, words: int) -> frozenset[tuple[str, bytes]]:
    """Phrases with more than 1/HOT of all words; there are fewer than HOT of each length."""
    rows = counts.filter(F.col("f") * F.lit(HOT).cast("decimal(20,0)") > words).collect()
    return frozenset((r.lang, r.phrase.encode()) for r in rows)


def _word_filter(counts: DataFrame) -> Bloom:
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(s.hashes(1).view(np.int64))], names=["h"])

    return bloom(materialise(counts.select("lang", "phrase").mapInArrow(hashed, "h bigint"), "words"))


def phrase_counts(texts: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of up to `longest` words with `least` occurrences, and
    (lang, n) with the number of words of each language."""
    rows = texts.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).filter("text <> ''")

    def counted(rows: DataFrame, task: Callable) -> DataFrame:
        return materialise(merged(rows.mapInArrow(task, _RUN), least), "phrases")

    first = counted(rows, count_words)
    totals = first.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    words = first.filter("phrase <> ''")
    if longest < 2:
        return words, totals
    n = int(totals.agg(F.sum("n").alias("n")).first().n or 0)
    word_filter, hot = _word_filter(words), _hot(words, n)
    pairs = Pairs(named_windows(rows, range(2, 3), word_filter, None, least, n))
    longer = None
    if longest > 2:
        longer = Pairs(named_windows(rows, range(3, longest + 1), word_filter, pairs, least, n))
    found = counted(_together(rows, n), lambda batches: Counting(longest, word_filter, pairs, longer, hot)(batches))
    return words.unionByName(found), totals


def collocations(texts: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts, totals = phrase_counts(texts, least, longest)
    counts = counts.withColumn("words", F.split("phrase", " ", -1)).withColumn("size", F.size("words"))
    candidates = counts.filter("size > 1").withColumnRenamed("f", "a")

    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.expr("slice(words, 1, k)"), " ").alias("first"),
        F.array_join(F.expr("slice(words, k + 1, size)"), " ").alias("rest"),
    )
    firsts = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rests = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    # As many rows as there are languages; of any number, Spark chooses the join.
    cuts = cuts.join(firsts, ["lang", "first"]).join(rests, ["lang", "rest"]).join(totals, "lang")
    exact = {c: f"cast({c} as decimal(19,0))" for c in ("a", "n", "l", "r")}
    score = F.expr(f"(1000 * {exact['a']} * {exact['n']}) div ({exact['l']} * {exact['r']})")
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r", "n")).alias("cut"))

    spans = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(words, i, m), ' '))))")
    inner = candidates.filter("size > 2").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = lowest.select("lang", "phrase", "cut.*").join(inner, ["lang", "phrase"], "left")
    whole = F.col("longer").cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * INSIDE_PERCENT
    left = left.filter(F.col("longer").isNull() | ~whole)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
