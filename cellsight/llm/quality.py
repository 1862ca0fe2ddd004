"""Quality classifier: averaged hashed word and character n-gram vectors with a softmax output.

Features of a text: its words, word pairs, pairs of a word with itself, byte 3- and 5-grams, and one
end-of-text feature, so that an empty text has a score too.  Vectors and output weights are trained by
NumPy stochastic gradient descent on a sample of at most `sample_rows` labelled rows (those with the
smallest hash of their id; a documented bound, the only one).  Whole texts are used in both steps.

A trained model scores a text by one number per feature, so only a table of fixed size is broadcast.
Without usable labels every score is 0.5.  Null texts are empty texts, rows with equal ids are scored
each, null labels and null ids in the labels teach nothing, rows equal in id, text and label teach once, ties of the
hash go to the smaller label, a very long text is a chunk of its own, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cellsight.llm.common import Chunk, chunks, materialise, mixed, substring_hashes, text_bytes

_U = np.uint64
BUCKET_BITS = 17
DIMENSIONS = 12
GRAMS = (3, 5)
SAMPLE_ROWS = 4000
#: Steps of the descent, in whole rounds over the sample.
STEPS = 16_000
RATE = 0.4
ACCEPT = 0.3
_END, _TWICE = 0, 1


def remainder(id_col: str) -> Column:
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5


def features(chunk: Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, bucket numbers), one pair of arrays for each kind of feature."""
    shift = _U(64 - BUCKET_BITS)
    yield np.arange(chunk.rows), np.full(chunk.rows, _END, dtype=np.int64)
    words, rows = chunk.word_hashes(folded=False)
    yield rows, (mixed(words) >> shift).astype(np.int64)
    same = rows[1:] == rows[:-1]
    pairs = (mixed(words[:-1] * _U(0x9E3779B97F4A7C15) + words[1:]) >> shift).astype(np.int64)
    pairs[words[:-1] == words[1:]] = _TWICE
    yield rows[1:][same], pairs[same]
    running = chunk.running()
    row_of = np.repeat(np.arange(chunk.rows), np.diff(chunk.offsets))
    for n in GRAMS:
        if len(chunk.data) < n:
            continue
        starts = np.flatnonzero(row_of[: len(row_of) - n + 1] == row_of[n - 1 :])
        grams = substring_hashes(running, starts, starts + n)
        yield row_of[starts], (grams >> shift).astype(np.int64)


@dataclass
class Model:
    """`worth`: for each bucket, what the feature adds to the log-odds of label 1."""

    worth: np.ndarray
    bias: float

    def scores(self, chunk: Chunk) -> np.ndarray:
        total, count = np.zeros(chunk.rows), np.zeros(chunk.rows)
        for rows, buckets in features(chunk):
            total += np.bincount(rows, weights=self.worth[buckets], minlength=chunk.rows)
            count += np.bincount(rows, minlength=chunk.rows)
        return 1 / (1 + np.exp(-np.clip(total / count + self.bias, -500, 500)))


def fit(bags: list[tuple[np.ndarray, np.ndarray, int]], steps: int = STEPS, rate: float = RATE, seed: int = 7) -> Model:
    """Stochastic gradient descent over bags of (buckets, counts, label)."""
    rng = np.random.default_rng(seed)
    size = 1 << BUCKET_BITS
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (size, DIMENSIONS)).astype(np.float32)
    output, bias = np.zeros((DIMENSIONS, 2), dtype=np.float64), np.zeros(2)
    rounds, done = -(-steps // len(bags)), 0
    steps = rounds * len(bags)
    for _ in range(rounds):
        for i in rng.permutation(len(bags)):
            buckets, counts, label = bags[i]
            share = (counts / counts.sum()).astype(np.float32)
            hidden = share @ vectors[buckets]
            logits = hidden @ output + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            step = rate * (1 - done / steps)
            toward = output @ p
            output -= step * np.outer(hidden, p)
            bias -= step * p
            # A gradient of a mean vanishes for rare features of long texts; the step is scaled by the bag's size.
            vectors[buckets] -= (step * np.minimum(1.0, share * len(buckets)))[:, None] * toward.astype(np.float32) / np.sqrt(len(buckets))
            done += 1
    worth = vectors.astype(np.float64) @ (output[:, 1] - output[:, 0])
    return Model(worth.astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled rows that are not held out.  The bounded sample is handled by one task; the model comes to the driver."""
    known = labels.where(F.col(f"`{label_col}`").isin(0, 1) & F.col(f"`{id_col}`").isNotNull() & (remainder(id_col) != 0))
    chosen = known.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64(F.col("_id").cast("string")), "_label").limit(sample_rows)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_bytes(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = rows.select(F.xxhash64(F.col("_id").cast("string"), "_text").alias("_order"), "_label", "_text")
    # Repeated ids could make the join larger than the sample: choose by the numbers alone, then take the texts of those.
    picked = materialise(rows.select("_order", "_label").distinct().orderBy("_order", "_label").limit(sample_rows), "sample")
    rows = rows.join(F.broadcast(picked), ["_order", "_label"]).dropDuplicates(["_order", "_label"])

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "_text"):
            parts = list(features(chunk))
            packed = np.concatenate([(r.astype(np.int64) << BUCKET_BITS) | b for r, b in parts])
            packed, counts = np.unique(packed, return_counts=True)
            ends = np.searchsorted(packed >> BUCKET_BITS, np.arange(chunk.rows + 1)).astype(np.int32)
            buckets = pa.ListArray.from_arrays(pa.array(ends), pa.array((packed & ((1 << BUCKET_BITS) - 1)).astype(np.int32)))
            sizes = pa.ListArray.from_arrays(pa.array(ends), pa.array(counts.astype(np.int32)))
            kept = [chunk.batch.column("_order"), chunk.batch.column("_label")]
            yield pa.RecordBatch.from_arrays([*kept, buckets, sizes], names=["_order", "_label", "buckets", "counts"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags = []
        for batch in batches:
            for i in range(batch.num_rows):
                b, c = (batch.column(k)[i].values.to_numpy() for k in ("buckets", "counts"))
                bags.append((batch.column("_order")[i].as_py(), b, c, batch.column("_label")[i].as_py()))
        bags.sort(key=lambda x: (x[0], x[3]))
        if bags:
            model = fit([x[1:] for x in bags])
            yield pa.RecordBatch.from_arrays([pa.array([model.worth.tobytes()], pa.binary()), pa.array([model.bias])], names=["worth", "bias"])

    bags = rows.mapInArrow(bag, "_order long, _label int, buckets array<int>, counts array<int>")
    found = bags.repartition(1).mapInArrow(learn, "worth binary, bias double").collect()
    if not found:
        return Model(np.zeros(1 << BUCKET_BITS, dtype=np.float32), 0.0)
    return Model(np.frombuffer(bytes(found[0]["worth"]), dtype=np.float32).copy(), found[0]["bias"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "_text"):
            kept = [chunk.batch.column(c) for c in ("_id", "_held")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(shared.value.scores(chunk))], names=["_id", "_held", "score"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(remainder(id_col) == 0, F.lit(False)).alias("_held"), text_bytes(text_col).alias("_text"))
    scored = rows.mapInArrow(run, "_id long, _held boolean, score double")
    return scored.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the model accepts, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "_text"):
            good = chunk.batch.filter(pa.array(shared.value.scores(chunk) >= ACCEPT))
            if good.num_rows:
                yield good.select([c for c in good.schema.names if c != "_text"])

    return docs.withColumn("_text", text_bytes(text_col)).mapInArrow(run, docs.schema)
