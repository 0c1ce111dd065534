"""Files of token ids in bit or byte planes, as a Spark data source.

A file holds the ids of whole documents one after the other. Ids are cut into blocks of a fixed
size; a block is transposed, so that all first bits (or bytes) stand together, then all second
ones, and each plane is compressed by zstandard. The documents' ids and lengths follow as blocks
of the same kind, then the index of all chunks:

    "IDPLANE1" | chunk | chunk | ... | index | bytes of the index, 8, little-endian | "IDPLANE1"

The index is JSON, compressed: the kind of planes, the number of documents and ids, and of each
chunk its column, offset, values, bytes a value and the bytes of each plane (0 for one of zeros).

Tasks write files of their own names. The commit, after all of them, writes the list of files in
the order of the partitions, so files of lost or repeated attempts are never read. A reader gets
one partition a file. Paths are those of pyarrow's file systems, `file:` included, and must be
shared by all executors.

    df.select("doc_id", "text").write.format("id_planes").option("tokenizer", path).mode("append").save(folder)
    df.select("doc_id", "ids").write.format("id_planes").mode("append").save(folder)
    spark.read.format("id_planes").load(folder)          # doc_id, start, ids

Options of a write: `planes`, "byte" (default) or "bit"; for texts `tokenizer`, a file all executors
have, `end`, the id put behind each text (0), and `cut` (see `encoder.py`). `ids` are unsigned 32-bit integers, little-endian. `start` counts the ids of all documents before.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .encoder import CUT, encoded

MAGIC = b"IDPLANE1"
INDEX = "_files.json"
#: Values of a block, and bytes of ids a reader hands on at once.
BLOCK, BATCH_BYTES = 1 << 16, 4 << 20
LEVEL = 3
SCHEMA = "doc_id bigint, start bigint, ids binary"


def to_planes(values: np.ndarray, kind: str) -> list[bytes]:
    """Planes of unsigned integers, the least significant first."""
    raw = values.view(np.uint8).reshape(len(values), values.itemsize)
    if kind == "byte":
        return [plane.tobytes() for plane in raw.T]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [plane.tobytes() for plane in np.packbits(bits.T, axis=1, bitorder="little")]


def from_planes(planes: list[bytes | None], n: int, width: int, kind: str) -> np.ndarray:
    if kind == "byte":
        raw = np.zeros((width, n), np.uint8)
        for row, plane in zip(raw, planes, strict=True):
            if plane is not None:
                row[:] = np.frombuffer(plane, np.uint8)
    else:
        packed = np.zeros((8 * width, -(-n // 8)), np.uint8)
        for row, plane in zip(packed, planes, strict=True):
            if plane is not None:
                row[:] = np.frombuffer(plane, np.uint8)
        bits = np.unpackbits(packed, axis=1, count=n, bitorder="little")
        raw = np.packbits(bits.T, axis=1, bitorder="little").T
    return np.ascontiguousarray(raw.T).reshape(-1).view(f"<u{width}")


class PlaneFile:
    """Writes one file; `append` takes documents in order."""

    def __init__(self, sink, kind: str, block: int = BLOCK, level: int = LEVEL) -> None:
        if kind not in ("bit", "byte"):
            raise ValueError(f"Planes are of bits or bytes, not of {kind!r}.")
        self.sink, self.kind, self.block = sink, kind, block
        self.pack = zstandard.ZstdCompressor(level=level)
        self.at, self.chunks, self.n_ids = len(MAGIC), [], 0
        self.waiting, self.n_waiting = [], 0
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        sink.write(MAGIC)

    def append(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.lengths.append(len(ids))
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            ids = np.concatenate(self.waiting)
            whole = len(ids) - len(ids) % self.block
            for i in range(0, whole, self.block):
                self._chunk("ids", ids[i : i + self.block])
            self.waiting, self.n_waiting = [ids[whole:].copy()], len(ids) - whole

    def _chunk(self, column: str, values: np.ndarray) -> None:
        sizes = []
        for plane in to_planes(np.ascontiguousarray(values), self.kind):
            packed = self.pack.compress(plane) if plane.strip(b"\0") else b""
            self.sink.write(packed)
            sizes.append(len(packed))
        self.chunks.append([column, self.at, len(values), values.dtype.itemsize, sizes])
        self.at += sum(sizes)

    def close(self) -> None:
        if self.n_waiting:
            self._chunk("ids", np.concatenate(self.waiting))
        columns = {
            "null": np.array([d is None for d in self.docs], "<u1"),
            "doc": np.array([d or 0 for d in self.docs], "<i8").view("<u8"),
            "length": np.array(self.lengths, "<u8"),
        }
        for name, values in columns.items():
            for i in range(0, len(values), self.block):
                self._chunk(name, values[i : i + self.block])
        index = {"planes": self.kind, "documents": len(self.docs), "ids": self.n_ids, "chunks": self.chunks}
        packed = self.pack.compress(json.dumps(index).encode())
        self.sink.write(packed + struct.pack("<Q", len(packed)) + MAGIC)


class PlaneReader:
    """Reads a file by its index, chunk by chunk."""

    def __init__(self, source) -> None:
        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        size = source.seek(0, 2)
        tail = len(MAGIC) + 8
        end = self._bytes(size - tail, tail) if size >= tail + len(MAGIC) else b""
        if end[8:] != MAGIC:
            raise ValueError("This is no file of id planes, or it is cut off.")
        length = struct.unpack("<Q", end[:8])[0]
        self.index = json.loads(self.unpack.decompress(self._bytes(size - tail - length, length)))

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def chunks(self, column: str) -> Iterator[np.ndarray]:
        for name, at, n, width, sizes in self.index["chunks"]:
            if name == column:
                data, planes = self._bytes(at, sum(sizes)), []
                for size in sizes:
                    planes.append(self.unpack.decompress(data[:size]) if size else None)
                    data = data[size:]
                yield from_planes(planes, n, width, self.index["planes"])

    def column(self, name: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, "<u8"), *self.chunks(name)])

    def documents(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(ids of documents, which are null, lengths, token ids) of some documents at a time."""
        docs, null, lengths = self.column("doc").view("<i8"), self.column("null") > 0, self.column("length").astype(np.int64)
        ends, chunks = np.cumsum(lengths), self.chunks("ids")
        first = base = 0
        waiting, held = [], 0
        while first < len(docs):
            # As many chunks as fill a batch, or as one long document takes.
            while held < max(BATCH_BYTES // 4, lengths[first]) and base + held < ends[-1]:
                waiting.append(next(chunks))
                held += len(waiting[-1])
            last = max(first + 1, int(np.searchsorted(ends, base + held, side="right")))
            ids = np.concatenate([np.zeros(0, "<u4"), *waiting])
            size = int(ends[last - 1] - base)
            yield docs[first:last], null[first:last], lengths[first:last], ids[:size]
            waiting, held, base, first = [ids[size:]], held - size, base + size, last


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    documents: int
    ids: int


class PlaneWriter(DataSourceArrowWriter):
    def __init__(self, path: str, options: dict[str, str], texts: bool) -> None:
        self.path, self.options, self.texts = path, dict(options), texts

    def _rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
        if not self.texts:
            return ((b.column(0), b.column(1).to_pylist()) for b in batches)
        return encoded(batches, self.options["tokenizer"], int(self.options.get("end", "0")), self.options.get("cut", CUT) or None)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file per task that has documents; the attempt's own name keeps it apart."""
        system, folder = _place(self.path)
        partition, file, name = TaskContext.get().partitionId(), None, ""
        for docs, rows in self._rows(iterator):
            for doc, ids in zip(docs.to_pylist(), rows, strict=True):
                if file is None:
                    name = f"part-{partition:06d}-{uuid.uuid4().hex}.planes"
                    system.create_dir(folder, recursive=True)
                    file = PlaneFile(system.open_output_stream(f"{folder}/{name}"), self.options.get("planes", "byte"))
                file.append(doc, np.frombuffer(ids or b"", "<u4"))
        if file is None:
            return Written(partition, "", 0, 0)
        file.close()
        file.sink.close()
        return Written(partition, name, len(file.docs), file.n_ids)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _place(self.path)
        system.create_dir(folder, recursive=True)
        files = sorted((m for m in messages if m and m.name), key=lambda m: m.partition)
        rows = [[m.name, m.documents, m.ids] for m in files]
        draft = f"{folder}/_draft-{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as out:
            out.write(json.dumps({"files": rows}).encode())
        system.move(draft, f"{folder}/{INDEX}")

    def abort(self, messages: list[Written | None]) -> None:
        """Files without a list are never read."""


@dataclass
class PlanePart(InputPartition):
    name: str
    start: int


class PlanesReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[PlanePart]:
        system, folder = _place(self.path)
        with system.open_input_file(f"{folder}/{INDEX}") as file:
            files = json.loads(file.read())["files"]
        parts, start = [], 0
        for name, _, ids in files:
            parts.append(PlanePart(name, start))
            start += ids
        # Spark wants a partition; one without a name reads nothing.
        return parts or [PlanePart("", 0)]

    def read(self, partition: PlanePart) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, folder = _place(self.path)
        start = partition.start
        with system.open_input_file(f"{folder}/{partition.name}") as file:
            for docs, null, lengths, ids in PlaneReader(file).documents():
                ends = np.concatenate([[0], np.cumsum(lengths)])
                data = np.ascontiguousarray(ids)
                binary = pa.Array.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer((4 * ends).astype("<i4").tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(docs, mask=null), pa.array(start + ends[:-1]), binary], names=["doc_id", "start", "ids"])
                start += int(ends[-1])


class IdPlanes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "id_planes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PlanesReader:
        return PlanesReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> PlaneWriter:
        kinds = [f.dataType.simpleString() for f in schema]
        if kinds not in (["bigint", "binary"], ["bigint", "string"]):
            raise ValueError("Columns to write: an id of bigint, and token ids as binary or a text.")
        return PlaneWriter(self.options["path"], self.options, kinds[1] == "string")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(IdPlanes)
