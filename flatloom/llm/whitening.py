"""Embedding whitening: spectral divide and conquer of the covariance, then broadcast whitening.

Entries become whole numbers x = floor(scale * entry), so that counts, sums and products are
exact. The fit list holds each distinct x vector once. Two passes over it give its size n, the
sums S, and the products of vectors centred at the rounded mean; both leave the tasks as whole
numbers, are added up by Spark and make the covariance to the last bit of a double. Its unit
eigenvectors come by QDWH divide and conquer (`qdwh.py`) on the driver: the matrix has as many
rows as a vector has entries, whatever the number of vectors. Mean and components are sent to
all tasks, which project every row.

Edge cases: vectors that are null or hold a null, NaN or infinite entry are dropped. A vector
shorter than the longest counts as one with zeros behind, so an empty one is all zeros. Entries
beyond the range of a long become its ends. Repeated rows and null ids each give their rows; no
column but the id and the vector is read. There are at most as many components as entries; one
without variance (n = 1, or too few independent vectors) has a null `whitened` and explains 0. A
deviation beyond the range of a long is null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from . import qdwh

SCALE, COMPONENTS = 256, 4
_LONG = 1 << 63
_EXACT = 1 << 53  # whole numbers below are exact as doubles
_LIMB = 48
#: Entries of the vectors that are worked on at once.
_ENTRIES = 1 << 20


def _pack(rows: np.ndarray) -> list[bytes]:
    """One code per vector of whole numbers, whatever zeros follow: the width of its entries in
    bytes, then the entries."""
    if not rows.shape[1]:
        return [b"\1"] * len(rows)
    filled = rows != 0
    length = np.where(filled.any(1), rows.shape[1] - filled[:, ::-1].argmax(1), 0)
    span = np.maximum(rows.max(1), -1 - rows.min(1))
    width = 1 << np.searchsorted([1 << 7, 1 << 15, 1 << 31], span, side="right")
    return [bytes([w]) + row[:k].astype(f"<i{w}").tobytes() for row, k, w in zip(rows, length.tolist(), width.tolist(), strict=True)]


def _unpack(codes: list[bytes], dims: int) -> np.ndarray:
    rows, alike = np.zeros((len(codes), dims), np.int64), {}
    for i, code in enumerate(codes):
        alike.setdefault((code[0], len(code)), []).append(i)
    for (width, length), own in alike.items():
        data = np.frombuffer(b"".join(codes[i][1:] for i in own), f"<i{width}").reshape(len(own), (length - 1) // width)
        rows[own, : data.shape[1]] = data
    return rows


def _slices(n: int, dims: int) -> Iterator[slice]:
    step = max(1, _ENTRIES // max(dims, 1))
    return (slice(i, i + step) for i in range(0, n, step))


def _whole(entries: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.floor(entries * scale)
    out = np.clip(x, -float(_LONG), float(_LONG - 1024)).astype(np.int64)
    out[x >= _LONG] = _LONG - 1
    return out


def _codes(vectors: DataFrame, id_column: str, column: str, scale: int) -> DataFrame:
    """id, the code of its whole numbers and the number of its entries, for sound vectors."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("v"))
    schema = T.StructType([rows.schema["id"], T.StructField("x", T.BinaryType()), T.StructField("size", T.IntegerType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sound = batch.filter(pc.is_valid(batch.column(1)))
            lists = sound.column(1)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            entries = lists.flatten()
            finite = pc.fill_null(pc.is_finite(entries), False).to_numpy(zero_copy_only=False)
            entries = pc.fill_null(entries, 0.0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~finite)])
            keep = bad[ends] == bad[ends - sizes]
            codes: list = [None] * len(sizes)
            for size in np.unique(sizes[keep]).tolist():
                own = np.flatnonzero(keep & (sizes == size))
                for part in _slices(len(own), size):
                    at = own[part]
                    values = entries[(ends[at] - size)[:, None] + np.arange(size)]
                    for i, code in zip(at.tolist(), _pack(_whole(values, scale)), strict=True):
                        codes[i] = code
            columns = [sound.column(0), pa.array(codes, pa.binary()), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "x", "size"]).filter(pa.array(keep))

    return rows.mapInArrow(encode, schema)


def _limbs(numbers: dict[int, int]) -> pa.RecordBatch:
    """Whole numbers of any size as signed parts, which Spark can add."""
    cells, limbs, parts = [], [], []
    for cell, number in numbers.items():
        sign, rest, limb = (-1 if number < 0 else 1), abs(number), 0
        while rest:
            cells.append(cell)
            limbs.append(limb)
            parts.append(sign * (rest & ((1 << _LIMB) - 1)))
            rest, limb = rest >> _LIMB, limb + 1
    return pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(limbs, pa.int32()), pa.array(parts, pa.int64())], names=["cell", "limb", "part"])


def _added(fit: DataFrame, task) -> dict[int, int]:
    """The sums per cell over all tasks; as many rows come to the driver as there are cells."""
    parts = fit.select("x").mapInArrow(task, "cell bigint, limb int, part bigint")
    sums = parts.groupBy("cell", "limb").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("part"))
    found = {}
    for r in sums.collect():
        found[r.cell] = found.get(r.cell, 0) + (int(r.part) << (_LIMB * r.limb))
    return found


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, at: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for part in _slices(len(batch), dims):
            own = batch.slice(part.start, min(part.stop, len(batch)) - part.start)
            yield own, _unpack(own.column(at).to_pylist(), dims)


def _largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def _minus(x: np.ndarray, by: int, taken: list[int]) -> np.ndarray:
    """by * x - taken, as long numbers where they hold it and else as Python's."""
    most = max(map(abs, taken), default=0)
    if by * _largest(x) + most < _LONG:
        return by * x - np.array(taken, np.int64)
    return by * x.astype(object) - np.array(taken, object)


def _products(y: np.ndarray) -> np.ndarray:
    """The exact products of the columns, summed over the rows, as Python's whole numbers."""
    most = _largest(y)
    if most < 1 << 26:
        step, total = max(1, _EXACT // max(1, most * most)), 0
        for i in range(0, len(y), step):
            block = y[i : i + step].astype(np.float64)
            total = total + (block.T @ block).astype(np.int64).astype(object)
        return total
    y = y.astype(object)
    return y.T @ y


@dataclass(frozen=True)
class Whitening:
    """n and the sums of the fit list; eigenvalues and components by falling eigenvalue; the
    whitened fit list's covariance differs from the identity by at most `identity_error`."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    scale: int = SCALE
    identity_error: float = 0.0

    @property
    def dims(self) -> int:
        return len(self.sums)

    def project(self, y: np.ndarray) -> np.ndarray:
        """n * x - S to the whitened components, without those of no variance."""
        own = self.values > 0
        centred = (y / self.n).astype(np.float64)
        return centred @ self.vectors[:, own] / np.sqrt(self.values[own])


def fit_whitening(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int | None = COMPONENTS, scale: int = SCALE) -> Whitening | None:
    """The mean and the first components of the distinct vectors, None if there are no vectors."""
    codes = _codes(vectors, id_column, column, scale)
    fit = materialise(codes.groupBy("x").agg(F.max("size").alias("size")), "fit-list")
    whole = fit.agg(F.count("*").alias("n"), F.max("size").alias("dims")).first()
    n, dims = whole.n, whole.dims or 0
    if not n:
        return None

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims, object)
        for _, x in _blocks(batches, dims):
            # Halves of 32 bits keep the sums of a block within a long.
            total += (x >> 32).sum(0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
        yield _limbs(dict(enumerate(total.tolist())))

    found = _added(fit, add_up)
    sums = [found.get(i, 0) for i in range(dims)]
    middle = [(2 * s + n) // (2 * n) for s in sums]
    rows, columns = np.triu_indices(dims)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        for _, x in _blocks(batches, dims):
            total += _products(_minus(x, 1, middle))
        yield _limbs(dict(zip((rows * dims + columns).tolist(), total[rows, columns].tolist(), strict=True)))

    products, left = _added(fit, multiply), [s - n * m for s, m in zip(sums, middle, strict=True)]
    covariance = np.zeros((dims, dims))
    for i, j in zip(rows.tolist(), columns.tolist(), strict=True):
        covariance[i, j] = covariance[j, i] = (n * products.get(i * dims + j, 0) - left[i] * left[j]) / (n * n)
    values, basis = qdwh.components(covariance)
    trace = float(np.trace(covariance))
    # What rounding leaves of an eigenvalue of zero is none.
    values = np.where(values > dims * qdwh.EPS * (values[0] if dims else 0), values, 0.0)
    k = dims if components is None else min(components, dims)
    explained = values[:k] / trace if trace else np.zeros(k)
    model = Whitening(n, sums, values[:k], basis[:, :k], explained, scale)
    return Whitening(n, sums, values[:k], basis[:, :k], explained, scale, _identity_error(fit, model))


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """Measured on the whitened vectors of the whole fit list."""
    k = int((model.values > 0).sum())

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for _, x in _blocks(batches, model.dims):
            w = model.project(_minus(x, model.n, model.sums))
            total += w.sum(0)
            products += w.T @ w
        cells = np.concatenate([total, products.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "part"])

    if not k:
        return 0.0
    rows = fit.select("x").mapInArrow(moments, "cell bigint, part double").groupBy("cell").agg(F.sum("part").alias("part")).collect()
    cells = np.zeros(k + k * k)
    for r in rows:
        cells[r.cell] = r.part
    mean = cells[:k] / model.n
    return float(np.abs(cells[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def _deviation(y: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row, null beyond a long."""
    most = _largest(y)
    if most * most * y.shape[1] < _LONG:
        y = y.astype(np.int64)
        return (y * y).sum(1).tolist()
    about = (y.astype(np.float64) ** 2).sum(1)
    exact = (sum(v * v for v in row.tolist()) if a < 1.01 * _LONG else _LONG for row, a in zip(y, about, strict=True))
    return [v if v < _LONG else None for v in exact]


def whiten(vectors: DataFrame, model: Whitening | None, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row per sound vector and component: id, component, n, deviation, whitened, explained,
    identity_error."""
    codes = _codes(vectors, id_column, column, model.scale if model else SCALE)
    kinds = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    id_field = T.StructField(id_column, codes.schema["id"].dataType)
    schema = T.StructType([id_field, *(T.StructField(name, kind) for name, kind in kinds)])
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    k, names = len(model.values), [f.name for f in schema]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, model.dims, at=1):
            y = _minus(x, model.n, model.sums)
            whitened = np.full((len(x), k), np.nan)
            whitened[:, model.values > 0] = model.project(y)
            whitened = whitened.ravel()
            rows = len(x) * k
            deviation = pa.array(_deviation(y), pa.int64())
            each = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(rows, model.n)),
                    deviation.take(each),
                    pa.array(whitened, mask=np.isnan(whitened)),
                    pa.array(np.tile(model.explained, len(x))),
                    pa.array(np.full(rows, model.identity_error)),
                ],
                names=names,
            )

    return codes.select("id", "x").mapInArrow(project, schema)
