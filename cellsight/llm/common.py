"""Vectorised text kernels and Spark helpers shared by the operators of this subpackage.

Texts reach Python as UTF-8 bytes in Arrow batches.  A chunk of a batch (about half a megabyte, or one
longer text) is handled with NumPy as one byte array, so memory is bounded by the longest text.
Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; A-Z are folded to a-z.
A null text is an empty text everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellsight.session import materialise  # noqa: F401  (for the operators)

CHUNK_BYTES = 1 << 19
CHUNK_ROWS = 1 << 15
#: Bits of a shingle hash; two of one document's shingles fall together with a probability near n*n/2**49.
SHINGLE_BITS = 48
BROADCAST_BYTES = 64 << 20
ROW = "_row"
WORD = r"[^\x20\x09-\x0D]+"

_U = np.uint64
_RNG = np.random.default_rng(20240607)
_BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_FOLDED_VALUES = _BYTE_VALUES.copy()
_FOLDED_VALUES[65:91] = _FOLDED_VALUES[97:123]
_POSITION = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(name: str = "text") -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("binary"), F.lit(bytearray()).cast("binary"))


def with_row(df: DataFrame) -> DataFrame:
    """Number the rows.  The result has to be written before it is read twice."""
    return df.withColumn(ROW, F.monotonically_increasing_id())


def sized(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the counted rows stay below the limit; a shuffle join does the rest."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES + 65536)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _POWERS[name] = np.cumprod(out)
    return _POWERS["up"], _POWERS["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Chunk:
    """Some rows of a batch with the bytes of one binary column."""

    def __init__(self, batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        self.batch, self.data, self.offsets = batch, data, offsets
        self.rows = len(offsets) - 1

    def running(self, folded: bool = False, salt: int = 0) -> np.ndarray:
        """Running sums of the position-weighted byte values: the difference of two gives a substring's hash."""
        values = _FOLDED_VALUES if folded else _BYTE_VALUES
        if salt:
            values = mixed(values + _U(salt)) | _U(1)
        up, _ = powers(len(self.data) + 1)
        out = np.empty(len(self.data) + 1, dtype=np.uint64)
        out[0] = 0
        np.cumsum(values[self.data] * up[: len(self.data)], out=out[1:])
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and the row that it lies in."""
        space = _SPACE[self.data]
        n = len(space)
        if not n:
            none = np.empty(0, dtype=np.int64)
            return none, none, none
        first = np.empty(n, dtype=bool)
        first[0] = True
        first[1:] = space[:-1]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        first[inner] = True
        last = np.empty(n, dtype=bool)
        last[-1] = True
        last[:-1] = space[1:]
        last[inner - 1] = True
        solid = ~space
        starts, ends = np.flatnonzero(first & solid), np.flatnonzero(last & solid) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1

    def word_hashes(self, folded: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit hash of every word, and its row."""
        starts, ends, rows = self.words()
        return substring_hashes(self.running(folded), starts, ends), rows


def substring_hashes(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(running))
    return mixed((running[ends] - running[starts]) * down[starts])


def chunks(batches: Iterator[pa.RecordBatch], column: str, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut batches into chunks of about `size` bytes of a binary column; a longer value is a chunk of its own."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        if values.null_count:
            values = values.fill_null(b"")
        wide = pa.types.is_large_binary(values.type)
        offsets = np.frombuffer(values.buffers()[1], dtype=np.int64 if wide else np.int32)
        offsets = offsets[values.offset : values.offset + len(values) + 1].astype(np.int64)
        raw = values.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, dtype=np.uint8)
        at = 0
        while at < len(values):
            end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
            end = min(max(end, at + 1), at + CHUNK_ROWS, len(values))
            yield Chunk(batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
            at = end


def group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.empty(0, dtype=np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1))


def shingle_sets(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row: 48-bit hashes sorted within rows, and n_rows + 1 offsets.

    A row with 1 to k - 1 words has its whole sequence as one shingle; a row without words has none.
    """
    count = np.bincount(rows, minlength=n_rows)
    value = np.zeros(max(0, len(hashes) - k + 1), dtype=np.uint64)
    for j in range(k):
        if len(value):
            value += hashes[j : len(hashes) - k + 1 + j] * _POSITION[j]
    at = np.flatnonzero(rows[: len(value)] == rows[k - 1 :]) if len(value) else np.empty(0, dtype=np.int64)
    value, owner = mixed(value[at]), rows[at]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        begin = np.concatenate(([0], np.cumsum(count)))[short]
        whole = count[short].astype(np.uint64) * _POSITION[k]
        for j in range(k - 1):
            has = count[short] > j
            whole[has] += hashes[begin[has] + j] * _POSITION[j]
        value, owner = np.concatenate((value, mixed(whole))), np.concatenate((owner, short))
    packed = (owner.astype(np.uint64) << _U(SHINGLE_BITS)) | (value >> _U(64 - SHINGLE_BITS))
    packed = np.unique(packed)
    ends = np.searchsorted(packed >> _U(SHINGLE_BITS), np.arange(n_rows + 1, dtype=np.uint64))
    return packed & _U((1 << SHINGLE_BITS) - 1), ends


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a stream sorted by integer keys, one table for each group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        merged = pa.Table.from_batches(held)
        columns = [merged.column(k).to_numpy() for k in keys]
        change = np.zeros(merged.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change)
        start = 0
        for cut in cuts:
            yield merged.slice(start, cut - start)
            start = cut
        held = merged.slice(start).to_batches()
    if held:
        yield pa.Table.from_batches(held)


