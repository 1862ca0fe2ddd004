"""Near-duplicate vectors by random-hyperplane sign hashing, exact cosine verification and components.

A table hashes a vector to the signs of its products with random hyperplanes.  Two vectors at the least
cosine agree in a sign with probability p = 1 - acos(cosine) / pi.  The number of signs follows the number
of vectors, so buckets of unrelated vectors stay small; the number of tables follows from the wanted
probability that a pair at the least cosine shares no bucket, so recall is the same at every size.

Equal vectors are one class and hashed once.  Buckets are compared in blocks of bounded size.  A pair is
counted in the first table where it meets, so no list of pairs is made: tasks return, for a class, how
many vectors it is linked with, and the edges of a spanning forest.

Vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of different
lengths are never linked.  Rows are told apart by a row number: repeated ids are vectors of their own, and
a component's id is its least non-null id.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cellsight.llm.common import ROW, group_starts, materialise, sized, with_row
from cellsight.llm.components import components

COSINE = 0.95
MISSED = 0.001
BLOCK = 1024
SEED = 20240611
_SMALL = 48


def plan_tables(vectors: int, cosine: float = COSINE, missed: float = MISSED) -> tuple[int, int]:
    """Signs per table, and tables, for a number of distinct vectors."""
    bits = max(8, math.ceil(math.log2(max(2, vectors))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(missed) / math.log(1 - agree))


def _units(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(units: np.ndarray, bits: int, tables: int) -> np.ndarray:
    planes = np.random.default_rng(SEED).standard_normal((units.shape[1], bits * tables))
    signs = ((units @ planes) >= 0).reshape(len(units), tables, bits)
    return (np.arange(tables, dtype=np.int64) << 48) | (signs @ (1 << np.arange(bits, dtype=np.int64)))


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """_row, _id, and for usable vectors their bytes and a fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw: list[bytes | None] = []
            for v in batch.column("_vector"):
                x = np.array(v.as_py() or [np.nan], dtype=np.float64)  # null components become nan
                good = np.isfinite(x).all() and 0 < np.linalg.norm(x) < np.inf
                raw.append((x + 0.0).astype("<f8").tobytes() if good else None)
            marks = [None if r is None else hashlib.md5(r).digest() for r in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW), batch.column("_id"), pa.array(raw, pa.binary()), pa.array(marks, pa.binary())], names=[ROW, "_id", "raw", "mark"]
            )

    rows = with_row(vectors.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("_vector")))
    return materialise(rows.mapInArrow(run, f"{ROW} long, _id long, raw binary, mark binary"), "vectors")


def _merge(labels: np.ndarray, members: np.ndarray) -> None:
    found = np.unique(labels[members])
    if len(found) > 1:
        labels[np.isin(labels, found)] = found[0]


def _compare(keys: np.ndarray, block: np.ndarray, i: np.ndarray, j: np.ndarray, units: np.ndarray, size: np.ndarray, bits: int, tables: int, cosine: float):
    """Links of whole groups of rows: vectors linked with each row, and for each row a row that it is connected with."""
    n = len(keys)
    links, labels = np.zeros(n, dtype=np.int64), np.arange(n)
    change = np.zeros(n, dtype=bool)
    change[1:] = (keys[1:] != keys[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    group = np.cumsum(change)
    starts = np.concatenate((np.flatnonzero(np.concatenate(([True], change[1:]))), [n]))
    lengths = np.diff(starts)
    all_keys = _keys(units, bits, tables)

    def first_met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (all_keys[a] == all_keys[b]).argmax(axis=1) == (keys[a] >> 48)

    def sides(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (i[a] == j[a]) | (block[a] != block[b])

    small = lengths[group] <= _SMALL
    for lag in range(1, min(_SMALL, int(lengths.max(initial=0)))):
        a = np.flatnonzero((group[:-lag] == group[lag:]) & small[:-lag])
        b = a + lag
        near = sides(a, b) & (np.einsum("ij,ij->i", units[a], units[b]) >= cosine)
        a, b = a[near], b[near]
        ok = first_met(a, b)
        a, b = a[ok], b[ok]
        np.add.at(links, a, size[b])
        np.add.at(links, b, size[a])
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if labels[x] != labels[y]:
                low, high = starts[group[x]], starts[group[x] + 1]
                part = labels[low:high]
                part[part == labels[y]] = labels[x]
    for g in np.flatnonzero(lengths > _SMALL):
        low, high = starts[g], starts[g + 1]
        cosines = units[low:high] @ units[low:high].T
        for x in range(low, high):
            y = np.flatnonzero(cosines[x - low, x - low + 1 :] >= cosine) + x + 1
            y = y[sides(np.full(len(y), x), y)]
            y = y[first_met(np.full(len(y), x), y)]
            if len(y):
                links[x] += size[y].sum()
                links[y] += size[x]
                part = labels[low:high]
                _merge(part, np.append(y, x) - low)
    return links, labels


def linked_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, missed: float = MISSED) -> DataFrame:
    """Per row: id, n_links, component_id, kept."""
    rows = _usable(vectors, id_col, vector_col)
    usable = rows.where("mark IS NOT NULL")
    classes = materialise(usable.groupBy("mark").agg(F.min(ROW).alias("node"), F.count(F.lit(1)).alias("size")), "classes")
    distinct = classes.count()
    bits, tables = plan_tables(distinct, cosine, missed)
    chosen = sized(classes.select(F.col("node").alias(ROW), "size"), 24)
    nodes = materialise(rows.join(chosen, ROW).select(F.col(ROW).alias("node"), "size", "raw", F.octet_length("raw").alias("length")), "nodes")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            for length in np.unique(lengths):
                part = batch.filter(pa.array(lengths == length))
                keys = _keys(_units(part.column("raw").to_pylist()), bits, tables)
                node = np.repeat(part.column("node").to_numpy(), tables)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.full(len(node), length)), pa.array(node)], names=["key", "length", "node"])

    buckets = materialise(nodes.select("node", "raw", "length").mapInArrow(hashed, "key long, length int, node long"), "buckets")
    shared = buckets.groupBy("key", "length").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    width = max(8, nodes.agg(F.max("length")).first()[0] or 8)
    blocks = F.ceil(F.col("members") / BLOCK)
    met = buckets.join(shared, ["key", "length"]).join(sized(nodes.select("node", "size", "raw"), width + 32), "node")
    met = met.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    met = met.select("length", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "size", "raw")
    dealt = met.repartition("length", "key", "i", "j").sortWithinPartitions("length", "key", "i", "j")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("length", "key", "i", "j")

        def results(t: pa.Table) -> Iterator[pa.RecordBatch]:
            cols = {c: t.column(c).to_numpy() for c in ("length", "key", "i", "j", "block", "node", "size")}
            raw = t.column("raw").to_pylist()
            cuts = [*group_starts(cols["length"]).tolist(), len(raw)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                c = {k: v[low:high] for k, v in cols.items()}
                links, labels = _compare(c["key"], c["block"], c["i"], c["j"], _units(raw[low:high]), c["size"], bits, tables, cosine)
                at = np.flatnonzero(links)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(c["node"][at]), pa.array(links[at]), pa.array(c["node"][labels[at]])], names=["node", "links", "mate"])

        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            last, cols = t.num_rows - 1, [t.column(c).to_numpy() for c in names]
            same = np.logical_and.reduce([c == c[last] for c in cols])
            cut = int(np.flatnonzero(same)[0])  # the last group may go on
            if cut:
                yield from results(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None:
            yield from results(held)

    found = materialise(dealt.mapInArrow(compared, "node long, links long, mate long"), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> mate").select(F.col("node").alias("a"), F.col("mate").alias("b")))
    by_class = classes.join(counts, "node", "left").join(roots, "node", "left")
    by_class = by_class.select("mark", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "node").alias("root"))
    named = rows.select(ROW, "_id", "mark").join(by_class, "mark", "left").withColumn("root", F.coalesce("root", ROW))
    named = materialise(named.drop("mark"), "named")
    least = named.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col(ROW))).alias("least"))
    return named.join(least, "root").select(
        F.col("_id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.col("least")["_id"].alias("component_id"),
        F.coalesce(F.col("_id") == F.col("least")["_id"], F.col(ROW) == F.col("least")[ROW]).alias("kept"),
    )
