"""Near-duplicate documents by HyperMinHash.

A document's distinct word shingles are dealt to buckets; a bucket keeps the leading zeros of its least
hash and some mantissa bits after them (a register of 16 bits).  An empty bucket takes the register of a
bucket that hashing picks, so short documents band like long ones.  Bands of registers give candidate
pairs, the share of equal registers less that of chance collisions estimates the Jaccard similarity,
and every link is confirmed on the full sets (48-bit shingle hashes).

Null, empty and blank texts have no shingles and are linked with nothing.  Rows are told apart by a row
number, so repeated and null ids are harmless: a component's id is its least non-null id (null if it has
none).  Other columns are ignored or, in `deduplicated`, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cellsight.llm.common import ROW, Chunk, chunks, group_starts, materialise, mixed, shingle_sets, text_bytes, with_row
from cellsight.llm.linking import Banding, near_duplicates

_U = np.uint64
SHINGLE = 4
BUCKETS = 192
MANTISSA = 10
_HASH_BITS = 40
#: Two sets with similarity 0.8 share one of 32 bands of 6 registers with probability 0.99994; at 0.8 an
#: estimate from 192 registers has a deviation of 0.029, so 0.69 lies almost four of them below.
BANDING = Banding(shingle=SHINGLE, registers=BUCKETS, rows=6, dtype="<u2", floor=0.69, chance=0.17 / (1 << MANTISSA))


def registers(values: np.ndarray, ends: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """(rows, buckets) registers of sorted sets; a row without shingles has zeros."""
    rows = len(ends) - 1
    owner = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(ends))
    h = mixed(values + _U(0x51ED270B))
    bucket = ((h >> _U(44)) * _U(buckets)) >> _U(20)
    tail = mixed(h + _U(0x2545F491)) >> _U(64 - _HASH_BITS)
    packed = np.sort(((owner * _U(256) + bucket) << _U(_HASH_BITS)) | tail)
    first = packed[group_starts(packed >> _U(_HASH_BITS))]
    place = (first >> _U(_HASH_BITS)).astype(np.int64)
    least = (first & _U((1 << _HASH_BITS) - 1)).astype(np.float64)
    fraction, exponent = np.frexp(np.maximum(least, 0.5))
    zeros = np.minimum(_HASH_BITS - exponent, 63)
    mantissa = ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    out, full = np.zeros((rows, 256), dtype=np.uint16), np.zeros((rows, 256), dtype=bool)
    out.ravel()[place], full.ravel()[place] = (zeros << MANTISSA) | mantissa, True
    out, full = out[:, :buckets], full[:, :buckets]
    row, at = np.nonzero(~full & full.any(axis=1)[:, None])
    source, attempt = np.full(len(row), -1), 0
    open_ = np.arange(len(row))
    while len(open_):
        attempt += 1
        probe = ((mixed(at[open_].astype(np.uint64) * _U(1 << 20) + _U(attempt)) >> _U(40)) * _U(buckets)) >> _U(24)
        probe = probe.astype(np.int64)
        hit = full[row[open_], probe]
        source[open_[hit]] = probe[hit]
        open_ = open_[~hit]
    out[row, at] = out[row, source]
    return np.ascontiguousarray(out)


def fingerprints(values: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two sums over each set that do not depend on an order."""
    out = []
    for salt in (0x1B873593, 0xCC9E2D51):
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mixed(values + _U(salt)))))
        out.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
    return out


def signed_chunk(chunk: Chunk, shingle: int, make) -> tuple[np.ndarray, list[np.ndarray], list[bytes]]:
    values, ends = shingle_sets(*chunk.word_hashes(), chunk.rows, shingle)
    return np.diff(ends).astype(np.int64), fingerprints(values, ends), [r.tobytes() for r in make(values, ends)]


def sign(rows: DataFrame, banding: Banding, make, keep_text: bool = True) -> DataFrame:
    """Add n, fp1, fp2 and sig to rows that have a binary column _text, and write them, if wanted without the text."""
    names = [c for c in rows.columns if keep_text or c != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "_text"):
            n, (fp1, fp2), sigs = signed_chunk(chunk, banding.shingle, make)
            arrays = [*chunk.batch.select(names).columns, pa.array(n), pa.array(fp1), pa.array(fp2), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "n", "fp1", "fp2", "sig"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    return materialise(rows.mapInArrow(run, f"{kinds}, n long, fp1 long, fp2 long, sig binary"), "signed")


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: _row, id, n_shingles, component_id, kept, and `first` for one row of each component."""
    rows = with_row(docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), text_bytes(text_col).alias("_text")))
    signed = sign(rows, BANDING, registers)
    roots = materialise(near_duplicates(signed, BANDING), "roots")
    named = signed.select(ROW, "_id", F.col("n").alias("n_shingles")).join(roots, ROW, "left").withColumn("root", F.coalesce("root", ROW))
    named = materialise(named, "named")
    # Ids before null, and the least row among equal ids.
    order = F.struct(F.col("_id").isNull(), F.col("_id"), F.col(ROW))
    least = named.groupBy("root").agg(F.min(order).alias("least"))
    joined = named.join(least, "root")
    return joined.select(
        ROW, F.col("_id").alias(id_col), "n_shingles", F.col("least")["_id"].alias("component_id"),
        F.coalesce(F.col("_id") == F.col("least")["_id"], F.col(ROW) == F.col("least")[ROW]).alias("kept"),
        (F.col(ROW) == F.col("least")[ROW]).alias("first"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without near-duplicates: one row of each component stays, with all its columns.

    Rows without shingles are alone in their components and stay.
    """
    columns = docs.columns
    numbered = materialise(with_row(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])), "numbered")
    id_at, text_at = (f"c{columns.index(c)}" for c in (id_col, text_col))
    rows = numbered.select(ROW, F.col(id_at).cast("long").alias("_id"), text_bytes(text_at).alias("_text"))
    signed = sign(rows, BANDING, registers, keep_text=False)
    roots = materialise(near_duplicates(signed, BANDING, rows.select(ROW, "_text")), "roots")
    named = signed.select(ROW, "_id").join(roots, ROW).select("root", F.struct(F.col("_id").isNull(), F.col("_id"), F.col(ROW)).alias("o"))
    least = named.groupBy("root").agg(F.min("o").alias("least")).select(F.col("least")[ROW].alias(ROW))
    dropped = roots.select(ROW).join(least, ROW, "left_anti")
    kept = numbered.join(materialise(dropped, "dropped"), ROW, "left_anti")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
