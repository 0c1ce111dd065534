"""License scans: fuzzy search for short notices.

A notice with at most k edits in it still holds one of its k + 1 pieces unchanged (pigeonhole).
One automaton finds all pieces of all notices in the lowered text; each hit gives a window in
which the notice must lie, and windows that overlap are joined. There the regex library
matches the notice with at most k errors, which verifies the edits and gives the span; the best
match comes first, then those in the parts of the window before and behind it.

Beside the fuzzy notices, fixed phrases are counted word by word: places where their words
stand consecutively.

Edge cases: a null text is empty; it has no words, labels or spans. Labels of both kinds are
distinct and sorted. Rows that repeat an id are scanned each. Columns other than doc_id and
text are ignored. Whole texts are scanned, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import ALNUM, Words, word_slices

#: Phrases that count word by word, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short notices in lower case, and their labels.
NOTICES = {
    "licensed under the apache license, version 2.0": "apache-2.0",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "released under the mit license": "mit",
    "redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "licensed under the gnu general public license": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "subject to the terms of the mozilla public license": "mpl-2.0",
    "licensed under a creative commons attribution 4.0 international license": "cc-by",
    "licensed under a creative commons attribution-sharealike": "cc-by-sa",
    "licensed under cc by-nc 4.0": "cc-by-nc",
    "dedicated to the public domain": "public-domain",
    "permission to use, copy, modify, and/or distribute this software for any purpose": "isc",
}
#: One edit for so many characters of a notice.
CHARS_PER_EDIT = 12

_LOWER = bytes(a + 32 if 65 <= a <= 90 else a for a in range(256))


def edits_allowed(notice: str) -> int:
    return max(1, len(notice) // CHARS_PER_EDIT)


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces of nearly equal length, each with its place in the notice."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class NoticeScanner:
    """Finds all notices in a lowered text."""

    def __init__(self, notices: dict[str, str]) -> None:
        self.notices = list(notices.items())
        self.edits = [edits_allowed(n) for n, _ in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (notice, _) in enumerate(self.notices):
            for place, piece in pieces(notice, self.edits[i]):
                seeds.setdefault(piece, []).append((i, place))
        self.seeds = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()
        self.patterns = [
            regex.compile(f"(?b)(?:{regex.escape(n, special_only=True)}){{e<={k}}}") for (n, _), k in zip(self.notices, self.edits, strict=True)
        ]

    def _windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each notice the parts of the text it can lie in, joined where they overlap."""
        found: dict[int, list[list[int]]] = {}
        for last, (length, where) in self.seeds.iter(text):
            begin = last + 1 - length
            for i, place in where:
                k, n = self.edits[i], len(self.notices[i][0])
                found.setdefault(i, []).append([max(0, begin - place - k), min(len(text), begin - place + n + k)])
        for i, own in found.items():
            own.sort()
            joined = own[:1]
            for a, b in own[1:]:
                if a <= joined[-1][1]:
                    joined[-1][1] = max(b, joined[-1][1])
                else:
                    joined.append([a, b])
            found[i] = joined
        return found

    def scan(self, text: str) -> list[tuple[str, int, int, int]]:
        """(label, first character, end, edits) of each notice, in order."""
        spans = []
        for i, parts in self._windows(text).items():
            for a, b in parts:
                rest = [(a, b)]
                while rest:
                    low, high = rest.pop()
                    m = self.patterns[i].search(text, low, high)
                    if m is None:
                        continue
                    spans.append((self.notices[i][1], m.start(), m.end(), sum(m.fuzzy_counts)))
                    shortest = len(self.notices[i][0]) - self.edits[i]
                    rest += [(x, y) for x, y in ((low, m.start()), (m.end(), high)) if y - x >= shortest]
        return sorted(spans, key=lambda s: (s[1], s[2], s[0]))


def _hashes(phrase: str) -> np.ndarray:
    return next(word_slices(pa.array([phrase]), ALNUM)).hash


def _phrase_places(w: Words, phrases: list[str]) -> list[tuple[int, int, int]]:
    """(text, first word within the text, phrase) of every place, in order."""
    out = []
    for p, phrase in enumerate(phrases):
        wanted = _hashes(phrase)
        n = len(w.hash) - len(wanted) + 1
        if n <= 0:
            continue
        match = np.ones(n, dtype=bool)
        for k, word in enumerate(wanted):
            match &= w.hash[k : k + n] == word
        for at in np.flatnonzero(match):
            row = int(np.searchsorted(w.first, at, side="right")) - 1
            if at + len(wanted) <= w.first[row + 1] and w.normal(at, at + len(wanted)) == phrase.encode():
                out.append((row, int(at - w.first[row]), p))
    return sorted(out)


def license_scan(documents: DataFrame, notices: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, places of phrases (first word and label), notices (label,
    characters from `begin` to `end`, edits) and labels of both, sorted."""
    notices, phrases = notices or NOTICES, phrases or PHRASES
    names = list(phrases.values())
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = NoticeScanner(notices)
        for batch in batches:
            for w in word_slices(batch.column(1), ALNUM):
                n = w.hi - w.lo
                places: list[list[dict]] = [[] for _ in range(n)]
                for row, word, p in _phrase_places(w, list(phrases)):
                    places[row].append({"word": word, "label": names[p]})
                found, lowered = [], w.data.tobytes().translate(_LOWER)
                for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True):
                    spans = scanner.scan(lowered[a:b].decode()) if a < b else []
                    found.append([dict(zip(("label", "begin", "end", "edits"), s, strict=True)) for s in spans])
                labels = [sorted({x["label"] for x in a} | {x["label"] for x in b}) for a, b in zip(places, found, strict=True)]
                place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
                span = pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(w.lo, n),
                        pa.array(np.diff(w.first)),
                        pa.array(places, place),
                        pa.array(found, span),
                        pa.array(labels, pa.list_(pa.string())),
                    ],
                    names=["doc_id", "n_words", "places", "notices", "labels"],
                )

    columns = (
        "n_words bigint, places array<struct<word:bigint,label:string>>, "
        "notices array<struct<label:string,begin:bigint,end:bigint,edits:bigint>>, labels array<string>"
    )
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(scan, f"doc_id {id_type}, {columns}")
