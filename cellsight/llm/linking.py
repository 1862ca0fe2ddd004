"""Links between near-equal texts: banded signatures, exact verification, components.

The texts come as a written table `signed`: _row (long), _text (binary), n (size of the shingle set),
fp1 and fp2 (fingerprint of the set) and sig (registers of the set as bytes).  A caller that has the texts
in a written table already passes that table (_row, _text) and leaves them out of `signed`.

1. Texts with equal shingle sets are one class, whose least _row stands for it.  Sets of so few shingles that
   only an equal one is near enough (fewer than four at 80 %) are settled by that.
2. Other representatives that share a band of registers meet in a bucket.  First each is paired with the
   least of its bucket only, the pairs are verified on the full sets, and components are formed.
3. Buckets that still hold several components are compared block by block, in tasks that have the texts:
   pairs of different components whose registers agree often enough are verified too, each in its first
   common band.  Only links leave a task, so a group of many near misses makes no rows.
4. The components of all verified links are the result.

Verification of pairs deals pairs to a grid of cells by the hashes of both ends, so a text travels to at most one
row or column of the grid, a text with very many partners is spread, and no cell is unbounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cellsight.llm.common import ROW, Chunk, chunks, group_starts, grouped, materialise, mixed, shingle_sets, sized
from cellsight.llm.components import components

_U = np.uint64
PAIRS_PER_CELL = 6000
BLOCK = 256


@dataclass(frozen=True)
class Banding:
    """How registers are cut into bands; pairs with an estimate below `floor` are not verified."""

    shingle: int
    registers: int
    rows: int
    dtype: str
    floor: float
    #: Probability that registers of unrelated sets agree, taken out of the estimate.
    chance: float
    percent: int = 80

    @property
    def bands(self) -> int:
        return self.registers // self.rows

    @property
    def least_size(self) -> int:
        """The size from which a set can be linked with one that is not equal: a subset with one shingle less is near enough."""
        return math.ceil(self.percent / (100 - self.percent))

    def matrix(self, sigs: pa.Array) -> np.ndarray:
        data = b"".join(s.as_py() for s in sigs)
        return np.frombuffer(data, dtype=self.dtype).reshape(len(sigs), self.registers)

    def keys(self, matrix: np.ndarray) -> np.ndarray:
        """Per row and band a 64-bit key that holds the number of the band."""
        parts = matrix[:, : self.bands * self.rows].reshape(len(matrix), self.bands, self.rows).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
        for j in range(self.rows):
            key = mixed(key * _U(0x9E3779B97F4A7C15) + parts[:, :, j])
        return key.view(np.int64)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Exact test on two sorted arrays of distinct shingles."""
        if len(a) > len(b):
            a, b = b, a
        if not len(a) or 100 * len(a) < self.percent * len(b):
            return False
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        common = int(np.count_nonzero(b[at] == a))
        return 100 * common >= self.percent * (len(a) + len(b) - common)


def _bands(classes: DataFrame, banding: Banding) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = banding.keys(banding.matrix(batch.column("sig")))
                nodes = np.repeat(batch.column("node").to_numpy(), banding.bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes)], names=["key", "node"])

    return classes.select("node", "sig").mapInArrow(run, "key long, node long")


def verified(pairs: DataFrame, texts: DataFrame, banding: Banding) -> DataFrame:
    """Links `a, b` that hold the pairs' components: verified pairs, without those that close a ring in a cell.

    `pairs` is a written table of distinct (a, b); `texts` has (node, _text).
    """
    side = max(1, math.ceil(math.sqrt(pairs.count() / PAIRS_PER_CELL)))
    cell = F.pmod(F.xxhash64("a"), F.lit(side)) * side + F.pmod(F.xxhash64("b", F.lit(1)), F.lit(side))
    dealt = pairs.select(cell.alias("cell"), "a", "b")
    places = materialise(dealt.select("cell", F.col("a").alias("node")).unionByName(dealt.select("cell", F.col("b").alias("node"))).distinct(), "places")
    wanted = sized(places.select("node").distinct(), 16)
    needed = texts.join(wanted, "node", "left_semi")
    sent = places.join(needed, "node").select("cell", F.lit(0).alias("kind"), F.col("node").alias("a"), F.lit(0).cast("long").alias("b"), "_text")
    asked = dealt.select("cell", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        parent: dict[int, int] = {}
        current = None

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            out = []
            cells, kinds = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
            starts = group_starts(cells * 2 + kinds).tolist()
            for start, end in zip(starts, [*starts[1:], len(cells)], strict=True):
                if cells[start] != current:
                    current = cells[start]
                    sets.clear()
                    parent.clear()
                part = batch.slice(start, end - start)
                if kinds[start] == 0:
                    for chunk in chunks(iter([part]), "_text"):
                        values, ends = shingle_sets(*chunk.word_hashes(), chunk.rows, banding.shingle)
                        for node, low, high in zip(chunk.batch.column("a").to_pylist(), ends[:-1], ends[1:], strict=True):
                            sets[node] = values[low:high].copy()
                    continue
                for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True):
                    x, y = root(a), root(b)
                    if x != y and banding.linked(sets[a], sets[b]):
                        parent[x] = y
                        out.append((a, b))
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = sent.unionByName(asked).repartition("cell").sortWithinPartitions("cell", "kind")
    return materialise(rows.mapInArrow(run, "a long, b long"), "links")


def _one_set(text: bytes, shingle: int) -> np.ndarray:
    data = np.frombuffer(text, dtype=np.uint8)
    return shingle_sets(*Chunk(None, data, np.array([0, len(data)])).word_hashes(), 1, shingle)[0]


def _residual_links(members: DataFrame, classes: DataFrame, texts: DataFrame | None, labels: DataFrame, banding: Banding) -> DataFrame:
    """Links between different components of a bucket, without those that close a ring in a block."""
    labelled = members.join(labels.withColumnRenamed("root", "_root"), "node", "left").select("key", "node", F.coalesce("_root", "node").alias("root"))
    labelled = materialise(labelled, "labelled")
    mixed_keys = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high")
    blocks = F.ceil(F.col("size") / BLOCK)
    rows = materialise(labelled.join(mixed_keys.select("key", "size"), "key"), "mixed")
    wanted = sized(rows.select("node").distinct(), 16)
    needed = classes.join(wanted, "node", "left_semi")
    if texts is not None:
        needed = needed.join(texts.join(wanted, "node", "left_semi"), "node")
    rows = rows.join(needed.select("node", "sig", "_text"), "node")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root", "sig", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["key", "i", "j"]):
            i, j, key = (group.column(c)[0].as_py() for c in ("i", "j", "key"))
            block, node, root = (group.column(c).to_numpy() for c in ("block", "node", "root"))
            if len(node) < 2 or root.min() == root.max():
                continue
            root = root.copy()
            sigs = banding.matrix(group.column("sig").combine_chunks())
            band = int(np.flatnonzero(banding.keys(sigs[:1])[0] == key)[0])
            sets: dict[int, np.ndarray] = {}

            def full(x: int, group: pa.Table = group, sets: dict = sets) -> np.ndarray:
                if x not in sets:
                    sets[x] = _one_set(group.column("_text")[x].as_py(), banding.shingle)
                return sets[x]

            found = []
            for x in range(len(node)):
                if i != j and block[x] != i:
                    continue
                others = np.flatnonzero((root != root[x]) & ((node > node[x]) if i == j else (block == j)))
                if not len(others):
                    continue
                same = sigs[others] == sigs[x]
                near = (same.mean(axis=1) - banding.chance) / (1 - banding.chance) >= banding.floor
                others, same = others[near], same[near]
                if not len(others):
                    continue
                whole = same[:, : banding.bands * banding.rows].reshape(len(others), banding.bands, banding.rows).all(axis=2)
                for y in others[whole.argmax(axis=1) == band].tolist():
                    if root[x] != root[y] and banding.linked(full(x), full(y)):
                        root[root == root[y]] = root[x]
                        found.append((min(node[x], node[y]), max(node[x], node[y])))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return materialise(dealt.mapInArrow(run, "a long, b long"), "links")


def bucket_components(members: DataFrame, classes: DataFrame, texts: DataFrame | None, banding: Banding) -> DataFrame:
    """`node, root` for the nodes that have a link, from the written table `members` (key, node, leader) of buckets.

    `classes` has one row (node, sig, _text) per node; with `texts` (node, _text) the texts are taken from there.
    """
    pairs = materialise(members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = verified(pairs, classes.select("node", "_text") if texts is None else texts, banding)
    rest = _residual_links(members.select("key", "node"), classes, texts, components(links), banding)
    return components(links.unionByName(rest))


def near_duplicates(signed: DataFrame, banding: Banding, texts: DataFrame | None = None) -> DataFrame:
    """`_row, root` for all rows with a shingle: the least _row that is reachable by links."""
    present = signed.where("n > 0")
    groups = materialise(present.groupBy("fp1", "fp2", "n").agg(F.min(ROW).alias("node")), "classes")
    classes = signed.join(sized(groups.where(F.col("n") >= banding.least_size).select(F.col("node").alias(ROW)), 16), ROW, "left_semi").withColumnRenamed(ROW, "node")
    apart = None if texts is None else texts.select(F.col(ROW).alias("node"), "_text")
    buckets = materialise(_bands(classes, banding), "bands")
    shared = buckets.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last")
    members = materialise(buckets.join(shared.select("key", "leader"), "key"), "members")
    labels = bucket_components(members, classes, apart, banding)
    of_class = groups.join(labels, "node", "left").select("fp1", "fp2", "n", F.coalesce("root", "node").alias("root"))
    return present.select(ROW, "fp1", "fp2", "n").join(of_class, ["fp1", "fp2", "n"]).select(ROW, "root")
