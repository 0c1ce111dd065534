"""Token ids of texts by a tokenizer of a given file, piece by piece.

Texts are cut where the tokenizer's own pattern always cuts: before a space or line feed with a
letter behind it, and where letters end. The pieces are mostly single words; new ones are encoded
side by side, told apart by the bytes of their tokens, and kept, so a frequent word is encoded once
a Python worker. The ids are those of the tokenizer on the whole text; `cut=None` encodes texts
whole, for tokenizers that are not byte-level or have other patterns. Special tokens in a text
are ordinary text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LETTER = "[A-Za-zÀ-ÖØ-öø-ɏ]"
#: Pieces of a text that byte-level BPE patterns tell apart: a space or line feed with the letters
#: behind it, up to an ASCII character that is none; and all between two of these.
CUT = rf"(?s)[ \n]{_LETTER}++(?=[\x00-\x7F]|\Z)|.+?(?=[ \n]{_LETTER}|\Z)"
#: Pieces that are told apart from whatever stands before.
INNER = rf"[ \n]{_LETTER}"
#: Pieces whose ids a task keeps, and characters of the longest it keeps.
KEPT_PIECES, KEPT_LENGTH = 1 << 18, 64
#: Bytes of the texts that are encoded together.
TEXT_BYTES = 2 << 20


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


class Encoder:
    """Ids of texts as little-endian 32-bit integers."""

    def __init__(self, path: str, cut: str | None = CUT) -> None:
        self.tokenizer, self.kept = tokenizer(path), {}
        self.cut, self.inner = cut and re.compile(cut), re.compile(INNER)
        # A byte-level token is written with one character a byte.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.size[list(vocabulary.values())] = [len(token) for token in vocabulary]

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that are cut from each other wherever they stand side by side."""
        if not pieces:
            return []
        ids = np.frombuffer(self.whole(["".join(pieces)])[0], "<u4")
        ends = np.cumsum(np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces)))
        bytes_to = np.cumsum(self.size[ids])
        places = np.searchsorted(bytes_to, ends)
        if not np.array_equal(bytes_to[np.minimum(places, len(ids) - 1)], ends):
            raise ValueError("The tokenizer does not cut texts where this module does; use cut=None.")
        raw, places = ids.tobytes(), ((places + 1) * 4).tolist()
        return [raw[i:j] for i, j in zip([0, *places], places)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.cut is None:
            return self.whole(texts)
        kept = self.kept
        if len(kept) > KEPT_PIECES:
            kept.clear()
        cut = list(map(self.cut.findall, texts))
        new = set().union(*cut).difference(kept)
        inner = list(filter(self.inner.match, new))
        single = list(new.difference(inner))
        kept.update(zip(inner, self.joined(inner)))
        kept.update(zip(single, self.whole(single)))
        found = [b"".join(map(kept.__getitem__, p)) for p in cut]
        for long in [p for p in new if len(p) > KEPT_LENGTH]:
            del kept[long]
        return found


@lru_cache(maxsize=2)
def encoder_of(path: str, cut: str | None) -> Encoder:
    """One encoder a Python worker, which Spark uses for one task after the other."""
    return Encoder(path, cut)


def encoded(batches: Iterator[pa.RecordBatch], path: str, end: int, cut: str | None = CUT) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """The first columns of (id, text) batches with the ids of the texts and the end id."""
    encoder, last = encoder_of(path, cut), np.array([end], "<u4").tobytes()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        ends, first = np.cumsum(sizes, dtype=np.int64), 0
        while first < len(batch):
            before = ends[first - 1] if first else 0
            until = max(first + 1, int(np.searchsorted(ends, before + TEXT_BYTES, side="right")))
            part = batch.slice(first, until - first)
            yield part.column(0), [ids + last for ids in encoder([t or "" for t in part.column(1).to_pylist()])]
            first = until
