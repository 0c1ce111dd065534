"""Language-model scoring with Brown class bigrams.

Learning, over all training documents:

1. Token counts: aggregated by Spark, kept as a table in the shared folder; its size follows
   the corpus. The head, words from the least count at which at most `vocabulary` words are as
   frequent, goes to the executors; the counts' histogram gives that count. All other words,
   the tail, stay in Spark tables.
2. What stands before and after each word of the head is counted once, word by word. Exchange
   clustering of the `frequent` most frequent words, one after the other, starts the classes: each in turn moves to the class with the highest likelihood of the class bigrams,
   until a sweep moves none or gains little. The matrix has `frequent` squared cells. All other
   words start in one more class, that of unknown words.
3. Exchange sweeps over the whole head, as Spark jobs over the counted neighbours: a word's
   neighbours lie in one row, so nothing is shuffled, and every word moves to its best class at
   once, in the first sweep by neighbours among the frequent words only. Sweeps go on until none moves
   or one gains less than `MIN_GAIN` of the information the classes share; one that loses is undone.
4. Two exchange steps for every word of the tail, as joins: first by its neighbours in the head,
   then by all its neighbours and their classes.
5. Class transitions over all training tokens, those of the tail by joins.

Every word of the corpus may move. To leave the class of unknown words, it must gain more than
log(classes), the price of naming its class; words seen too rarely to tell stay there, and what
is learned of them holds for words never seen.

Scoring: log10 P = sum over tokens of log10 P(class | class before) + log10 P(token | class),
with P(class | before) = (n(before, class) + SMOOTH * P(class)) / (n(before) + SMOOTH) and
P(token | class) = (n(token) + 0.5) / (n(class) + 0.5 * size). Unknown tokens are one more word
of their class, so that the probabilities sum to one. Classes and counts of tail tokens come by
a join on their hash; what they add to the score is a sum, so the texts are not shuffled.

Edge cases: null and empty texts are one end token. Rows that repeat an id are scored each by
its own text. With no training tokens, score equals base_score. A null id has the remainder of
the empty string. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import arrow_batches, materialise
from .tokens import SPACED, word_slices

CLASSES = 64
FREQUENT = 1024
VOCABULARY = 1 << 18
#: A sweep that gains less than this share of what the classes tell about each other is the last.
MIN_GAIN = 0.02
SMOOTH = 4.0
#: The end token, a number no word hash is expected to be.
END = 1
#: Distinct counts a task holds before it hands them on.
HELD = 1 << 20
#: Neighbours a task counts together, and about how many of one part are a row of their table.
NEIGHBOURS, ENTRIES = 1 << 22, 1 << 14
#: Texts that go to Python at once, and keys that come back at once.
BATCH_BYTES, BATCH_KEYS = "2m", 1 << 16


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)])


class _Counter:
    """Sums of counts by an integer key, handed on when there are many."""

    def __init__(self) -> None:
        self.keys, self.counts, self.held = [], [], 0

    def hold(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.hold(*np.unique(keys, return_counts=True))
        if self.held > 2 * HELD:
            self.merge()
            if self.held > HELD:
                yield from self.rest()

    def merge(self) -> None:
        """One sorted array of keys; what is not needed any more goes before the next copy is made."""
        keys, self.keys = np.concatenate(self.keys), []
        order = np.argsort(keys)
        keys = keys[order]
        counts, self.counts = np.concatenate(self.counts), []
        counts = counts[order]
        del order
        first = _starts(keys)
        self.keys, self.counts, self.held = [keys[first]], [np.add.reduceat(counts, first)], len(first)

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.held:
            self.merge()
            keys, counts = self.keys[0], self.counts[0]
            for a in range(0, len(keys), BATCH_KEYS):
                yield keys[a : a + BATCH_KEYS], counts[a : a + BATCH_KEYS]
        self.keys, self.counts, self.held = [], [], 0


def _tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of texts: the first text, the token hashes with an END after each text, and the
    place of each text's first token."""
    for w in word_slices(column, SPACED):
        hashes = w.hash.view(np.int64)
        hashes = np.where(hashes == END, END + 1, hashes)
        yield w.lo, np.insert(hashes, w.first[1:], END), w.first + np.arange(len(w.first))


def _count(texts: DataFrame, keys_of, name: str) -> DataFrame:
    """Aggregate integer keys of all texts: `keys_of` gives those of a slice of tokens."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()

        def out(pairs):
            for keys, counts in pairs:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["k", "n"])

        for batch in batches:
            for _, hashes, first in _tokens(batch.column(0)):
                if len(hashes):
                    yield from out(counter.add(keys_of(hashes, first)))
        yield from out(counter.rest())

    return texts.mapInArrow(scan, "k bigint, n bigint").groupBy(F.col("k").alias(name)).agg(F.sum("n").alias("n"))


class Lexicon:
    """Numbers of the vocabulary's words, by hash; `rare` for all others."""

    def __init__(self, order: np.ndarray, ordered: np.ndarray) -> None:
        self.order, self.sorted, self.rare = order, ordered, len(ordered)

    @classmethod
    def of(cls, hashes: np.ndarray) -> Lexicon:
        order = np.argsort(hashes)
        return cls(order, hashes[order])

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not self.rare:
            return np.zeros(len(hashes), dtype=np.int64)
        place = np.minimum(np.searchsorted(self.sorted, hashes), self.rare - 1)
        return np.where(self.sorted[place] == hashes, self.order[place], self.rare)


def _before(ids: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """The token before each; the end token before the first of a text."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[first[:-1]] = end
    return before


def information(table: np.ndarray) -> float:
    """What classes tell about the next one: sum of n log n over cells less that over margins."""
    log = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    n = table.sum()
    return log(table) - log(table.sum(axis=0)) - log(table.sum(axis=1)) + float(n * np.log(max(n, 1)))


def exchange(bigrams: np.ndarray, classes: int) -> np.ndarray:
    """Classes of the rows of a square matrix of bigram counts, by exchange clustering.

    Words start, by frequency, one in each class in turn. A word moves to the class with the
    highest sum of n log n over class bigrams less that over both class margins. Sweeps end
    when none moves, or one gains less than a thousandth of `information`; every move gains.
    """
    n = len(bigrams)
    weight = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    of = np.empty(n, dtype=np.int64)
    of[np.argsort(-weight, kind="stable")] = np.arange(n) % classes
    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    log = lambda x: x * np.log(np.maximum(x, 1))
    table = member.T @ bigrams @ member
    reached, last = information(table), -np.inf
    while reached > last + 1e-3 * abs(reached):
        moved, last = 0, reached
        for w in np.argsort(-weight, kind="stable"):
            if not weight[w]:
                continue
            own = bigrams[w, w]
            right, left = bigrams[w] @ member, bigrams[:, w] @ member
            a = of[w]
            right[a] -= own
            left[a] -= own
            table[a] -= right
            table[:, a] -= left
            table[a, a] -= own
            rows, columns = table.sum(axis=1), table.sum(axis=0)
            to, since = right.sum() + own, left.sum() + own
            # Adding w to class b changes row b by `right`, column b by `left`, cell (b, b) by all three.
            base = log(table)
            row_gain = log(table + right[None, :]) - base
            column_gain = log(table + left[:, None]) - base
            gain = row_gain.sum(axis=1) + column_gain.sum(axis=0)
            cell = np.diag(table)
            gain += log(cell + right + left + own) - log(cell) - np.diag(row_gain) - np.diag(column_gain)
            gain -= log(rows + to) - log(rows) + log(columns + since) - log(columns)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += right
            table[:, b] += left
            table[b, b] += own
            if b != a:
                member[w, a], member[w, b], of[w] = 0, 1, b
                moved += 1
        if not moved:
            break
        reached = information(table)
    return of


def _gather(cells: DataFrame, word: str) -> DataFrame:
    """One row per word with the counts of what stands beside it: at most four per class."""
    return cells.groupBy(word).agg(F.collect_list(F.struct(F.col("key").cast("bigint"), F.col("n").cast("bigint"))).alias("near"))


def _best(table: np.ndarray, told: bool = True) -> Callable[[np.ndarray], np.ndarray]:
    """The best class of words by how often each class stands before and after them.

    The last class is that of unknown words, the others have their price. Unless `told`, neighbours
    of that class say nothing yet.
    """
    classes = len(table)
    smooth = table + 0.1
    after = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    totals = np.log(smooth.sum(axis=0))
    price = np.append(np.full(classes - 1, np.log(max(classes - 1, 1))), 0.0)

    def best(near: np.ndarray) -> np.ndarray:
        if not told:
            near[:, [classes - 1, 2 * classes - 1]] = 0
        gain = near[:, :classes] @ (after - totals) + near[:, classes:] @ after.T - price
        return gain.argmax(axis=1).astype(np.int64)

    return best


def _assign(words: DataFrame, table: np.ndarray) -> DataFrame:
    """One exchange step: the columns of `words`, the best class of each and its count n.

    `near` lists (key, n): key is the class of a neighbour plus 0 if it stands before, one number
    of classes if after, plus two numbers of classes for neighbours of the tail.
    """
    classes, best = len(table), _best(table)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            lists = batch.column(1)
            row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            pairs = lists.flatten()
            key, n = pairs.field(0).to_numpy() % (2 * classes), pairs.field(1).to_numpy()
            near = np.bincount(row * 2 * classes + key, weights=n, minlength=len(batch) * 2 * classes).reshape(-1, 2 * classes)
            befores = near[:, :classes].sum(axis=1)
            columns = [batch.column(0), lists, pa.array(best(near)), pa.array(befores.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "near", "class", "n"])

    schema = "word bigint, near array<struct<key:bigint,n:bigint>>, class bigint, n bigint"
    return words.toDF("word", "near").mapInArrow(scan, schema)


@dataclass
class ClassModel:
    """What scoring needs: the head's lexicon and the logarithms of transitions and emissions.

    `tail` is the table (hash, n, class) of all other training words. The last class holds
    unknown words.
    """

    tail: DataFrame | None
    n_tokens: int
    n_types: int
    lexicon: Lexicon
    frequency: np.ndarray
    of: np.ndarray
    transition: np.ndarray
    per_class: np.ndarray


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("text").cast("string").alias("text"))


def _head(counts: DataFrame, vocabulary: int) -> pa.Table:
    """The end token and all words from the least count at which at most `vocabulary` are as frequent.

    Counts from 4,096 on are told apart by 256 steps per doubling, so the histogram is small.
    """
    step = F.expr("if(n < 4096, n, 4096 + cast(floor(256 * log2(n / 4096)) as bigint))")
    steps = sorted(((r.step, r.types) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("types")).collect()), reverse=True)
    held, least = 0, None
    for at, types in steps:
        held += types
        if held > vocabulary:
            break
        least = at
    wanted = F.col("hash") == END
    return counts.filter(wanted if least is None else wanted | (step >= least)).toArrow().sort_by([("n", "descending"), ("hash", "ascending")])


#: Kinds of counts by their bytes.
_WIDTHS = {1: "<u1", 2: "<u2", 4: "<u4", 8: "<i8"}


def _packed(counts: np.ndarray) -> bytes:
    """Positive counts in as few bytes each as the largest needs."""
    most = int(counts.max())
    return counts.astype(next(k for k in _WIDTHS.values() if most <= np.iinfo(k).max)).tobytes()


def _unpacked(data: bytes | pa.Buffer, n: int) -> np.ndarray:
    return np.frombuffer(data, _WIDTHS[len(data) // n]).astype(np.int64)


def _neighbours(texts: DataFrame, lexicon: Lexicon, end: int, n_tokens: int) -> DataFrame:
    """What stands beside every word of the head, counted: rows of arrays, which `_entries` reads as (word, other, n).

    `other` is the word before, or the one after plus the number of words; the tail is one more
    word. Words are dealt to parts by their number, so frequent ones lie apart; a part holds what
    stands beside its words, and a row all of that for each of its words.
    """
    width = lexicon.rare + 1
    span, parts = 2 * width, min(max(n_tokens >> 18, 64), 4096)
    slots = -(-width // parts)
    kind = "<u4" if slots * span <= 1 << 32 else "<i8"
    words = texts.sparkSession.sparkContext.broadcast((lexicon.order, lexicon.sorted))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = Lexicon(*words.value), np.arange(width)
        base = (number % parts * slots + number // parts) * span
        held, n = np.empty(NEIGHBOURS, np.int64), 0
        for batch in batches:
            for _, tokens, first in _tokens(batch.column(0)):
                if not len(tokens):
                    continue
                ids = known.ids(tokens)
                before = _before(ids, first, end)
                for keys in (base[ids] + before, base[before] + ids + width):
                    if n + len(keys) > len(held):
                        yield from _runs(held[:n], slots * span, kind)
                        n = 0
                    if len(keys) > len(held):
                        yield from _runs(keys, slots * span, kind)
                        continue
                    held[n : n + len(keys)] = keys
                    n += len(keys)
        yield from _runs(held[:n], slots * span, kind)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, most, part = _Counter(), 2 * HELD, None
        for batch in batches:
            for i in range(len(batch)):
                part = batch["part"][i].as_py()
                keys = np.frombuffer(batch["keys"][i].as_buffer(), kind).astype(np.int64)
                counter.hold(keys, _unpacked(batch["counts"][i].as_buffer(), len(keys)))
                if counter.held > most:
                    counter.merge()
                    most = 2 * max(HELD, counter.held)
        counter.merge()
        n, (slot, other) = counter.counts[0], np.divmod(counter.keys[0], span)
        begins = _starts(slot)
        word, size = (slot[begins] * parts + part).astype("<i4"), np.diff(begins, append=len(slot)).astype("<i4")
        other, begins = other.astype("<i4"), np.append(begins, len(slot))
        cuts = np.searchsorted(begins[:-1], np.arange(0, len(slot), ENTRIES)).tolist()
        for i, j in pairwise(sorted({*cuts, len(word)})):
            a, b = begins[i], begins[j]
            row = {"word": word[i:j].tobytes(), "size": size[i:j].tobytes(), "other": other[a:b].tobytes(), "n": _packed(n[a:b])}
            yield pa.RecordBatch.from_pydict({c: pa.array([v], pa.binary()) for c, v in row.items()})

    found = texts.mapInArrow(scan, "part int, keys binary, counts binary").groupBy("part")
    return materialise(found.applyInArrow(merged, "word binary, size binary, other binary, n binary"), "neighbours")


def _runs(keys: np.ndarray, span: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows (part, keys, counts) of the keys, which are sorted in place; a part has `span` keys.

    Parts go out a few at a time, so little is held besides the keys.
    """
    keys.sort()
    a = 0
    while a < len(keys):
        last = int(keys[min(a + BATCH_KEYS, len(keys)) - 1]) // span
        b = int(np.searchsorted(keys, (last + 1) * span))
        own = keys[a:b]
        first = _starts(own)
        counts = np.diff(first, append=len(own))
        part, low = np.divmod(own[first], span)
        first, low = _starts(part), low.astype(kind)
        cuts = list(pairwise([*first.tolist(), len(low)]))
        columns = [[low[i:j].tobytes() for i, j in cuts], [_packed(counts[i:j]) for i, j in cuts]]
        columns = [pa.array(c, pa.binary()) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), *columns], names=["part", "keys", "counts"])
        a = b


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(len(batch)):
            word, size, other, n = (c[i].as_buffer() for c in batch.columns)
            word, size, other = (np.frombuffer(v, "<i4").astype(np.int64) for v in (word, size, other))
            yield np.repeat(word, size), other, _unpacked(n, len(other))


def _cells(cells: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n)], names=["cell", "n"])


def _frequent_bigrams(neighbours: DataFrame, m: int) -> np.ndarray:
    """The matrix of bigram counts of the `m` first words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for word, other, n in _entries(batches):
            use = (word < m) & (other < m)
            yield _cells(other[use] * m + word[use], n[use])

    return _square(neighbours.mapInArrow(scan, "cell bigint, n bigint"), m)


def _sweeps(neighbours: DataFrame, of: np.ndarray, classes: int) -> np.ndarray:
    """Classes of all words of the head, from those in `of`; the tail counts as unknown words."""
    send, rare = neighbours.sparkSession.sparkContext.broadcast, len(of)
    last, kept, told = -np.inf, of, False
    while True:
        # The tail is one more word, which never moves.
        now = send(np.append(of, classes - 1))

        def own(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            of, found = now.value, np.zeros(classes * classes, np.int64)
            for word, other, n in _entries(batches):
                use = other <= rare
                cell = of[other[use]] * classes + of[word[use]]
                found += np.bincount(cell, weights=n[use], minlength=len(found)).astype(np.int64)
            cells = np.flatnonzero(found)
            yield _cells(cells, found[cells])

        table = _square(neighbours.mapInArrow(own, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")), classes)
        reached = information(table)
        if reached < last:
            return kept
        if reached - last < MIN_GAIN * abs(reached):
            return of
        best = _best(table, told)

        def place(batches: Iterator[pa.RecordBatch], now=now, best=best) -> Iterator[pa.RecordBatch]:
            of = now.value
            for word, other, n in _entries(batches):
                use = word < rare
                word, other, n = word[use], other[use], n[use]
                first = _starts(word)
                row = np.repeat(np.arange(len(first)), np.diff(first, append=len(word)))
                after = other > rare
                key = of[other - after * (rare + 1)] + after * classes
                near = np.bincount(row * 2 * classes + key, weights=n, minlength=len(first) * 2 * classes).reshape(-1, 2 * classes)
                yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(best(near))], names=["word", "class"])

        placed = neighbours.mapInArrow(place, "word bigint, class bigint").toArrow()
        kept, of = of, of.copy()
        of[placed["word"].to_numpy()] = placed["class"].to_numpy()
        if (of == kept).all():
            return of
        last, told = reached, True


def _square(cells: DataFrame, side: int) -> np.ndarray:
    """A matrix of side * side cells from rows (cell, n)."""
    found, out = cells.toArrow(), np.zeros(side * side)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(side, side)


#: Kinds of rows of the table of steps: head to head by classes, a tail word beside a class, two tail words.
HEADS, BESIDE, TAILS = 0, 1, 2


def _steps(texts: DataFrame, lexicon: Lexicon, of: np.ndarray, end: int, classes: int) -> DataFrame:
    """All steps of the texts, counted: (kind, a, b, n).

    HEADS: a is the cell of both classes. BESIDE: a is the tail word, b the class of the head
    word before it, or that of the one after it plus the number of classes. TAILS: both words.
    """
    known = texts.sparkSession.sparkContext.broadcast((lexicon.order, lexicon.sorted, of))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, ordered, of = known.value
        lexicon, of = Lexicon(order, ordered), np.append(of, classes - 1)
        heads = np.zeros(classes * classes, dtype=np.int64)
        for batch in batches:
            for _, tokens, first in _tokens(batch.column(0)):
                if not len(tokens):
                    continue
                ids = lexicon.ids(tokens)
                before = _before(ids, first, end)
                left = _before(tokens, first, END)
                tail, tail_before = ids == lexicon.rare, before == lexicon.rare
                both = ~tail & ~tail_before
                heads += np.bincount(of[before[both]] * classes + of[ids[both]], minlength=len(heads))
                one, two, pair = tail & ~tail_before, ~tail & tail_before, tail & tail_before
                sizes = [int(x.sum()) for x in (one, two, pair)]
                yield _step_rows(
                    np.repeat([BESIDE, BESIDE, TAILS], sizes),
                    np.concatenate([tokens[one], left[two], left[pair]]),
                    np.concatenate([of[before[one]], of[ids[two]] + classes, tokens[pair]]),
                    np.ones(sum(sizes), dtype=np.int64),
                )
        cells = np.flatnonzero(heads)
        yield _step_rows(np.full(len(cells), HEADS), cells, np.zeros(len(cells), dtype=np.int64), heads[cells])

    rows = texts.mapInArrow(scan, "kind int, a bigint, b bigint, n bigint")
    return rows.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def _step_rows(kind: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(a), pa.array(b), pa.array(n)], names=["kind", "a", "b", "n"])


def _classed(pairs: DataFrame, tail: DataFrame) -> DataFrame:
    """Pairs (a, b, n) of tail words with the classes of both: a_class, b_class; null for unknown words."""
    for side in ("a", "b"):
        pairs = pairs.join(tail.select(F.col("hash").alias(side), F.col("class").alias(f"{side}_class")), side, "left")
    return pairs


def _tail_classes(steps: DataFrame, heads: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """The table (hash, n, class) of tail words, and `heads` with the steps from and to them."""
    classes = len(heads)
    rare = classes - 1
    # All steps, with every tail word among the unknown ones.
    start = F.expr(f"case when kind = {TAILS} then {classes * rare + rare} when b < {classes} then b * {classes} + {rare} else {rare * classes - classes} + b end")
    start = steps.filter(F.col("kind") != HEADS).groupBy(start.cast("bigint").alias("cell")).agg(F.sum("n").alias("n"))
    table = heads + _square(start, classes)
    beside = steps.filter(F.col("kind") == BESIDE).select(F.col("a").alias("hash"), F.col("b").alias("key"), "n")
    pairs = steps.filter(F.col("kind") == TAILS).select("a", "b", "n")
    first = _assign(_gather(beside, "hash"), table).select(F.col("word").alias("hash"), "class")
    first = materialise(first, "tail-first")
    c = F.lit(2 * classes)
    near = _classed(pairs, first).fillna(rare, ["a_class", "b_class"])
    right = near.select(F.col("b").alias("hash"), (F.col("a_class") + c).alias("key"), "n")
    left = near.select(F.col("a").alias("hash"), (F.col("b_class") + c + classes).alias("key"), "n")
    cells = beside.unionByName(right).unionByName(left).groupBy("hash", "key").agg(F.sum("n").alias("n"))
    tail = materialise(_assign(_gather(cells, "hash"), table).withColumnRenamed("word", "hash"), "tail-classes")
    k = F.lit(classes)
    own = tail.select("class", F.explode("near").alias("x")).select("class", "x.key", "x.n").filter(F.col("key") < c)
    cell = F.when(F.col("key") < k, F.col("key") * k + F.col("class")).otherwise(F.col("class") * k + F.col("key") - k)
    heads = heads + _square(own.groupBy(cell.alias("cell")).agg(F.sum("n").alias("n")), classes)
    cell = F.col("a_class") * k + F.col("b_class")
    heads = heads + _square(_classed(pairs, tail).groupBy(cell.alias("cell")).agg(F.sum("n").alias("n")), classes)
    return tail.select("hash", "n", "class"), heads


def learn(training: DataFrame, classes: int = CLASSES, frequent: int = FREQUENT, vocabulary: int = VOCABULARY) -> ClassModel:
    """Fit the model on all rows of `training` (column text)."""
    with arrow_batches(training.sparkSession, BATCH_BYTES):
        return _fit(_texts(training), classes, frequent, vocabulary)


def _fit(texts: DataFrame, classes: int, frequent: int, vocabulary: int) -> ClassModel:
    counts = materialise(_count(texts, lambda hashes, first: hashes, "hash"), "token-counts")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_tokens, n_types = total.n or 0, total.v
    head = _head(counts, vocabulary)
    hashes, frequency = head["hash"].to_numpy(), head["n"].to_numpy()
    lexicon, v = Lexicon.of(hashes), len(hashes)
    k = classes + 1
    if not n_tokens:
        return ClassModel(None, 0, 0, lexicon, frequency, np.zeros(0, dtype=np.int64), np.full((k, k), -np.log10(k)), np.zeros(k))
    end = int(np.flatnonzero(hashes == END)[0])
    m = min(frequent, v)
    neighbours = _neighbours(texts, lexicon, end, n_tokens)
    of = np.full(v, classes, dtype=np.int64)
    of[:m] = exchange(_frequent_bigrams(neighbours, m), classes)
    of = _sweeps(neighbours, of, k)
    steps = _steps(texts, lexicon, of, end, k)
    tail, sizes = None, np.bincount(of, minlength=k).astype(float)
    in_class = np.bincount(of, weights=frequency, minlength=k)
    if n_types > v:
        steps = materialise(steps, "class-steps")
    table = _square(steps.filter(F.col("kind") == HEADS).select(F.col("a").alias("cell"), "n"), k)
    if n_types > v:
        tail, table = _tail_classes(steps, table)
        own = tail.groupBy("class").agg(F.count("*").alias("types"), F.sum("n").alias("n")).toArrow()
        at = own["class"].to_numpy()
        sizes[at] += own["types"].to_numpy()
        in_class[at] += own["n"].to_numpy()
    sizes[classes] += 1
    share = (in_class + 0.5) / (in_class + 0.5).sum()
    transition = np.log10((table + SMOOTH * share) / (table.sum(axis=1, keepdims=True) + SMOOTH))
    per_class = np.log10(in_class + 0.5 * np.maximum(sizes, 1))
    return ClassModel(tail, n_tokens, n_types, lexicon, frequency, of, transition, per_class)


def scores(documents: DataFrame, model: ClassModel) -> DataFrame:
    """Per row of `documents`: doc_id, n_tokens, n_known, base_score and score."""
    spark = documents.sparkSession
    id_type = documents.schema["doc_id"].dataType.simpleString()
    n, v, classes = model.n_tokens, model.n_types, len(model.transition)
    floor, rare_log = float(np.log10(n + 0.5 * (v + 1))), float(np.log10(0.5))
    log_count = np.append(np.log10(model.frequency + 0.5), rare_log)
    # Without a tail, words beyond the head are unknown ones and have the class of these.
    whole = model.tail is None
    of = np.append(model.of, classes - 1)
    known = spark.sparkContext.broadcast((model.lexicon.order, model.lexicon.sorted, of, model.transition, model.per_class, log_count))
    at = np.flatnonzero(model.lexicon.sorted == END)
    end = int(model.lexicon.order[at[0]]) if len(at) else model.lexicon.rare

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, ordered, of, transition, per_class, log_count = known.value
        lexicon = Lexicon(order, ordered)
        for batch in batches:
            for lo, tokens, first in _tokens(batch.column(2)):
                if not len(tokens):
                    continue
                ids, hi = lexicon.ids(tokens), lo + len(first) - 1
                before, heads = _before(ids, first, end), first[:-1]
                tail = np.zeros(len(ids), dtype=bool) if whole else ids == lexicon.rare
                tail_before = np.zeros(len(ids), dtype=bool) if whole else before == lexicon.rare
                own, last = of[ids], of[before]
                steps = np.where(tail | tail_before, 0.0, transition[last, own])
                emission = np.where(tail, 0.0, log_count[ids] - per_class[own])
                # Per tail token the class before and after it, or -1 where a tail token stands there.
                places, pairs = np.flatnonzero(tail), np.flatnonzero(tail & tail_before)
                follow = np.append(own[1:], 0)[places]
                follow = np.where(np.append(tail[1:], False)[places], -1, follow)
                lead = np.where(tail_before[places], -1, last[places])
                cut, pair_cut = (np.searchsorted(p, first).astype(np.int32) for p in (places, pairs))
                lists = lambda cuts, values: pa.ListArray.from_arrays(pa.array(cuts), pa.array(values))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array(np.diff(first)),
                        pa.array(np.add.reduceat((ids != lexicon.rare).astype(np.int64), heads)),
                        pa.array(np.add.reduceat(steps + emission, heads)),
                        pa.array(np.add.reduceat(np.where(tail, 0.0, log_count[ids]), heads)),
                        lists(cut, tokens[places]),
                        lists(cut, ((lead + 1) * (classes + 1) + follow + 1).astype(np.int32)),
                        lists(pair_cut, tokens[pairs - 1]),
                        lists(pair_cut, tokens[pairs]),
                    ],
                    names=["doc_id", "text_key", "n_tokens", "n_local", "local_score", "local_base", "rare", "beside", "lefts", "rights"],
                )

    text = F.col("text").cast("string")
    docs = documents.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"))
    columns = "n_tokens bigint, n_local bigint, local_score double, local_base double"
    columns += ", rare array<bigint>, beside array<int>, lefts array<bigint>, rights array<bigint>"
    out = docs.mapInArrow(scan, f"doc_id {id_type}, text_key bigint, {columns}")
    tail_known, tail_base, tail_score = F.lit(0), F.lit(0.0), F.lit(0.0)
    if not whole:
        with arrow_batches(spark, BATCH_BYTES):
            out = materialise(out, "local-scores")
        added = _tail_scores(out, model)
        out = out.withColumn("n_rare", F.size("rare")).drop("rare", "beside", "lefts", "rights")
        same = F.col("doc_id").eqNullSafe(F.col("tail_id")) & (F.col("text_key") == F.col("tail_key"))
        out = out.join(added, same, "left")
        copies = F.coalesce(F.col("tail_n") / F.nullif("n_rare", F.lit(0)), F.lit(1.0))
        tail_known, tail_base, tail_score = (F.coalesce(c, F.lit(0)) / copies for c in ("tail_known", "tail_base", "tail_score"))
    # Without training tokens every token has probability one.
    base = F.col("local_base") + tail_base - F.col("n_tokens") * F.lit(floor) if n else F.lit(0.0)
    score = F.col("local_score") + tail_score
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("n_local") + tail_known).cast("bigint").alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        base.alias("base_score"),
        (score if n else base).alias("score"),
    )


def _tail_scores(local: DataFrame, model: ClassModel) -> DataFrame:
    """What tail tokens add, per text: (tail_id, tail_key, tail_n, tail_known, tail_base, tail_score).

    Rows that repeat an id and its text are summed: tail_n counts the tail tokens of all. Steps are looked up in a table of
    classes squared rows, which goes to every executor.
    """
    spark, classes = local.sparkSession, len(model.transition)
    # As Arrow tables, which need no Python workers on the executors.
    x, y = np.divmod(np.arange(classes * classes), classes)
    log = F.broadcast(spark.createDataFrame(pa.table({"x": x, "y": y, "log": model.transition.ravel()})))
    emitted = F.broadcast(spark.createDataFrame(pa.table({"class": np.arange(classes), "per_class": model.per_class})))
    text = ["doc_id", "text_key"]
    rows = local.filter(F.size("rare") > 0).select(*text, F.explode(F.arrays_zip("rare", "beside")).alias("z"))
    rows = rows.groupBy(*text, F.col("z.rare").alias("hash"), F.col("z.beside").alias("beside")).agg(F.count("*").alias("tf"))
    found = rows.join(model.tail, "hash", "left").fillna(classes - 1, ["class"])
    found = found.withColumns({"lead": F.expr(f"beside div {classes + 1} - 1"), "follow": F.expr(f"beside % {classes + 1} - 1")})
    found = found.join(emitted, "class")
    for x, y, name in (("lead", "class", "into"), ("class", "follow", "out_of")):
        step = log.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("log").alias(name))
        found = found.join(step, (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y")), "left").drop("_x", "_y")
    count = F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    score = count - F.col("per_class") + F.coalesce("into", F.lit(0.0)) + F.coalesce("out_of", F.lit(0.0))
    known = F.when(F.col("n") > 0, F.col("tf")).otherwise(0)
    found = found.select(*text, F.col("tf").alias("n"), known.alias("known"), (F.col("tf") * count).alias("base"), (F.col("tf") * score).alias("score"))
    pairs = local.filter(F.size("lefts") > 0).select(*text, F.explode(F.arrays_zip("lefts", "rights")).alias("z"))
    pairs = pairs.groupBy(*text, F.col("z.lefts").alias("a"), F.col("z.rights").alias("b")).agg(F.count("*").alias("tf"))
    pairs = _classed(pairs, model.tail).fillna(classes - 1, ["a_class", "b_class"])
    pairs = pairs.join(log, (F.col("a_class") == F.col("x")) & (F.col("b_class") == F.col("y")))
    pairs = pairs.select(*text, F.lit(0).alias("n"), F.lit(0).alias("known"), F.lit(0.0).alias("base"), (F.col("tf") * F.col("log")).alias("score"))
    sums = [F.sum(c).alias(f"tail_{c}") for c in ("n", "known", "base", "score")]
    both = found.unionByName(pairs).groupBy(*text).agg(*sums)
    return both.withColumnsRenamed({"doc_id": "tail_id", "text_key": "tail_key"})
