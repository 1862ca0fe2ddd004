"""Whitening of integer-scaled embeddings by shifted CholeskyQR.

A vector's entries c become x = floor(64 c) + 1,000,000.  The distinct x vectors (the fit list) are written once.
Their exact sums give centred rows without cancellation; every pass then solves the rows against the triangular
factors found so far and sums a Gram matrix, whose Cholesky factor is the next one.  The first pass is shifted so
that it cannot fail, the following ones remove the loss of orthogonality.  The product R of the factors is the R
of the centred rows, so its singular values and right vectors are the components.

A Gram matrix has dimension x dimension numbers, whatever the number of rows; one is summed per task, then per
slot, and at most `SLOTS` come to the driver.  Copies are collapsed before the shuffle by partial aggregation.

Null vectors, empty vectors and vectors with null or non-finite entries give no row, and neither do vectors
whose length is not the most frequent one (ties: the longer).  |64 c| is clipped at 2**61.  Rows with equal or null ids
give rows each, equal vectors count once in the fit and get equal values.  Components whose singular value is below
1e-9 of the largest carry rounding only and are left out, so a table with one distinct vector or none gives no row.  Equal
eigenvalues may have any orthonormal components; the largest entry of a component is positive.  A deviation beyond a
long is null.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cellsight.llm.common import materialise

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
SLOTS = 16
MOST_PASSES = 6
_CLIP = float(2**61)
_UNIT = np.finfo(np.float64).eps / 2
RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """Fit of a table: exact sums of `n` distinct vectors, unit components (columns) and their eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0
    passes: int = 0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the integer part is subtracted exactly, the rest is below one."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n x - S)**2, exactly."""
        sums = np.array(self.sums, dtype=object)
        furthest = max((abs(self.n * int(v) - s) for side in (x.min(axis=0), x.max(axis=0)) for v, s in zip(side, self.sums)), default=0)
        if furthest * furthest * max(1, x.shape[1]) < 2**63 and self.n * max(abs(int(x.min())), abs(int(x.max()))) < 2**62:
            away = self.n * x - np.array(self.sums, dtype=np.int64)
            return pa.array((away * away).sum(axis=1))
        exact = ((x.astype(object) * self.n - sums) ** 2).sum(axis=1)
        return pa.array([v if v < 2**63 else None for v in exact], pa.int64())


def _usable(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """Rows (_id, _v) with finite vectors of the most frequent length, and that length (0: none)."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("_v"))
    rows = rows.where("size(_v) > 0 AND forall(_v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('inf'))")
    lengths = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    return rows.where(F.size("_v") == d), d


def _integers(column: pa.Array, d: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.clip(np.floor(SCALE * values), -_CLIP, _CLIP).astype(np.int64) + OFFSET


def _pack(x: np.ndarray) -> pa.Array:
    """One binary value a vector, of 32-bit entries wherever they fit, so that equal vectors have equal bytes."""
    narrow = (np.abs(x) < 2**31).all(axis=1)
    small = x.astype(np.int32)
    return pa.array([small[i].tobytes() if narrow[i] else x[i].tobytes() for i in range(len(x))], pa.binary())


def _unpack(column: pa.Array, d: int) -> np.ndarray:
    sizes = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1])
    if (sizes == 4 * d).all():
        return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int32).reshape(-1, d).astype(np.int64)
    return np.vstack([np.frombuffer(v, dtype=np.int32 if len(v) == 4 * d else np.int64).astype(np.int64) for v in column.to_pylist()])


def _gram(fit: DataFrame, d: int, rows_of: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum over the fit list of the outer products of `rows_of(x)`."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                q = rows_of(_unpack(batch.column(0), d))
                total += q.T @ q
        yield _one(TaskContext.get().partitionId() % SLOTS, total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(width * width), False
        for batch in batches:
            for value in batch.column(1).to_pylist():
                total, seen = total + np.frombuffer(value), True
        if seen:
            yield _one(0, total)

    schema = "slot int, g binary"
    found = fit.mapInArrow(partial, schema).repartition(SLOTS, "slot").mapInArrow(add, schema).collect()
    return sum((np.frombuffer(bytes(r["g"])) for r in found), np.zeros(width * width)).reshape(width, width)


def _one(slot: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "g"])


def solved(y: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """y times the inverses of upper triangular factors, one substitution after the other."""
    for r in factors:
        q = np.empty_like(y)
        for j in range(y.shape[1]):
            q[:, j] = (y[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
        y = q
    return y


def _factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper Cholesky factor of gram + shift, the shift raised until the factor exists."""
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, 1e-15 * max(np.trace(gram), 1e-300))


def fit(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Components of the distinct vectors; None where there is nothing to whiten."""
    rows, d = _usable(df, id_col, vec_col)
    if not d:
        return None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_pack(_integers(batch.column(0), d))], names=["x"])

    listed = materialise(rows.select("_v").mapInArrow(pack, "x binary").distinct(), "fit_list")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, np.zeros(d, dtype=object)
        for batch in batches:
            if batch.num_rows:
                x = _unpack(batch.column(0), d)
                count += len(x)
                narrow = int(np.abs(x).max()) * len(x) < 2**62
                total = total + (x.sum(axis=0).astype(object) if narrow else x.astype(object).sum(axis=0))
        places = pa.array(np.arange(-1, d), pa.int32())
        yield pa.RecordBatch.from_arrays([places, pa.array([str(count), *map(str, total)], pa.string())], names=["place", "s"])

    added = listed.mapInArrow(sums, "place int, s string").groupBy("place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    exact = {r["place"]: int(r["s"]) for r in added.collect()}
    model = Whitening(exact[-1], [exact[i] for i in range(d)], np.zeros((d, 0)), np.zeros(0), 0.0)

    factors: list[np.ndarray] = []
    most = 11 * (model.n * d + d * (d + 1)) * _UNIT
    for _ in range(MOST_PASSES):
        gram = _gram(listed, d, lambda x, m=model, f=tuple(factors): solved(m.centred(x), f), d)
        if not factors:
            model.trace = float(np.trace(gram)) / model.n
            if model.trace == 0:
                return None
            factors.append(_factor(gram, min(most, 1e-8) * np.linalg.norm(gram, 2)))
            continue
        factors.append(_factor(gram, 0.0))
        if np.abs(gram - np.eye(d)).max() < 1e-13:
            break
    r = np.eye(d)
    for f in factors:
        r = f @ r
    _, singular, right = np.linalg.svd(r)
    kept = min(components, int((singular > 1e-9 * singular[0]).sum()))
    signs = np.sign(right[np.arange(d), np.abs(right).argmax(axis=1)])
    model.components = (right * signs[:, None])[:kept].T
    model.eigenvalues = singular[:kept] ** 2 / model.n
    model.passes = len(factors)
    again = _gram(listed, d, lambda x, m=model: m.whitened(x), kept) / model.n
    model.identity_error = float(np.abs(again - np.eye(kept)).max())
    return model


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component, with the figures of the fit."""
    spark = df.sparkSession
    kind = f"`{id_col}` long, {RESULT}"
    model = fit(df, id_col, vec_col, components)
    if model is None:
        return spark.createDataFrame([], kind)
    rows, d = _usable(df, id_col, vec_col)
    k = len(model.eigenvalues)
    explained = model.eigenvalues / model.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _integers(part.column(1), d)
                m = len(x)
                repeated = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(repeated),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n)),
                        model.deviations(x).take(repeated),
                        pa.array(model.whitened(x).ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, model.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(project, kind)
