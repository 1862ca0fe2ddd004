"""Toxic texts and their offending sentences by multiple-instance learning with a noisy-or.

A text is a bag of sentences.  A sentence ends after a word that ends with one of . ! ?, at a line break, or after
`SENTENCE_WORDS` words.  Its features are its distinct words (A-Z folded, ASCII punctuation around a word left out) and
their beginnings of 3 to 8 bytes, hashed.  A linear model gives each sentence a probability p; the text's score is the
noisy-or 1 - prod(1 - p), so one bad sentence is enough and the length of the rest does not hide it.  Only texts
have labels: the gradient of the text's log-loss shares the blame among its sentences in proportion to p.

The model is fitted by NumPy on a bounded sample of the labelled rows that are not held out: for each label the
`SAMPLE_ROWS` rows with the smallest hash of their id, as long as their texts add up to `SAMPLE_BYTES` at most (the
only bound; where one label has fewer rows, its rows count more, by the root of the ratio).  Whole texts are used in both steps; scoring reads the
table once, and only the weights (2**18 numbers) are broadcast.

Null texts are empty texts; a text without words has one sentence without features.  A very long text is a chunk of
its own.  Rows with equal or null ids are scored each; a null id counts as not held out.  Null or other labels and null
ids in the labels teach nothing, repeated label rows teach once, contradicting ones teach both; ties of the hash go to
the smaller label and text.  Without both labels every score is 0.5.  Empty tables give no rows.  Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cellsight.llm.common import Chunk, chunks, materialise, mixed, substring_hashes, text_bytes

_U = np.uint64
BUCKET_BITS = 18
BEGINNINGS = range(3, 9)
SENTENCE_WORDS = 64
SAMPLE_ROWS = 2000
SAMPLE_BYTES = 8 << 20
EPOCHS = 10
RATE = 0.6
#: Pull of a weight towards zero (the proximal step of an absolute-value penalty), so that chance words stay out.
PENALTY = 2e-3
#: A feature counts from so many texts of the sample on.
LEAST_TEXTS = 3
MOST_WEIGHT = 3.0
FLAGGED = 0.5
_START_BIAS = -4.0

_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_STOPS = np.zeros(256, dtype=bool)
_STOPS[list(b".!?")] = True


def remainder(id_col: str) -> Column:
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5


@dataclass
class Sentences:
    """Sentences of a chunk: the row and byte span of each, and the buckets of their distinct words."""

    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    word_sentence: np.ndarray
    word_buckets: list[tuple[np.ndarray, np.ndarray]]


def split(chunk: Chunk) -> Sentences:
    data = chunk.data
    starts, ends, rows = chunk.words()
    none = np.empty(0, dtype=np.int64)
    if not len(starts):
        return Sentences(none, none, none, none, [])
    lines = np.concatenate(([0], np.cumsum((data == 10) | (data == 13))))
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | _STOPS[data[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]])
    first = np.flatnonzero(new)
    place = np.arange(len(starts)) - np.repeat(first, np.diff(np.concatenate((first, [len(starts)]))))
    new |= place % SENTENCE_WORDS == 0
    first = np.flatnonzero(new)
    sentence = np.cumsum(new) - 1
    last = np.concatenate((first[1:], [len(starts)])) - 1
    result = Sentences(rows[first], starts[first], ends[last], none, [])

    # Words without the punctuation around them.
    at = np.arange(len(data))
    plain = ~_PUNCTUATION[data]
    before = np.maximum.accumulate(np.where(plain, at, -1))
    after = np.minimum.accumulate(np.where(plain, at, len(data))[::-1])[::-1]
    begin, end = after[starts], before[ends - 1] + 1
    good = np.flatnonzero(begin < end)
    begin, end, sentence = begin[good], end[good], sentence[good]
    running = chunk.running(folded=True)
    hashes = substring_hashes(running, begin, end)
    _, one = np.unique((sentence.astype(np.uint64) << _U(40)) | (hashes >> _U(24)), return_index=True)
    begin, end, hashes = begin[one], end[one], hashes[one]
    result.word_sentence = sentence[one]
    shift = _U(64 - BUCKET_BITS)
    result.word_buckets.append((np.arange(len(one)), (mixed(hashes) >> shift).astype(np.int64)))
    for n in BEGINNINGS:
        longer = np.flatnonzero(end - begin > n)
        if len(longer):
            beginnings = substring_hashes(running, begin[longer], begin[longer] + n)
            result.word_buckets.append((longer, (mixed(beginnings + _U(n)) >> shift).astype(np.int64)))
    return result


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    fitted: bool = True

    def logits(self, found: Sentences) -> np.ndarray:
        total = np.full(len(found.rows), self.bias)
        for words, buckets in found.word_buckets:
            total += np.bincount(found.word_sentence[words], weights=self.weights[buckets], minlength=len(total))
        return total

    def scores(self, chunk: Chunk) -> tuple[np.ndarray, Sentences, np.ndarray]:
        """Scores of the rows, the sentences and their probabilities."""
        found = split(chunk)
        if not self.fitted:
            return np.full(chunk.rows, 0.5), found, np.full(len(found.rows), 0.5)
        logits = self.logits(found)
        free = np.bincount(found.rows, weights=np.logaddexp(0, logits), minlength=chunk.rows)
        empty = np.bincount(found.rows, minlength=chunk.rows) == 0
        free[empty] = np.logaddexp(0, self.bias)
        return -np.expm1(-free), found, np.exp(-np.logaddexp(0, -logits))


def fit(bags: list[tuple[np.ndarray, np.ndarray, int]], weights: tuple[float, float] = (1.0, 1.0), epochs: int = EPOCHS, seed: int = 11) -> Model:
    """Descent with adaptive steps over bags of (sentence of each feature, its bucket, label); every text is one step."""
    size = 1 << BUCKET_BITS
    texts = np.zeros(size, dtype=np.int32)
    local = []
    for sentence, bucket, label in bags:
        seen, inverse = np.unique(bucket, return_inverse=True)
        texts[seen] += 1
        local.append((sentence, int(sentence.max(initial=0)) + 1, seen, inverse.astype(np.int32), label))
    rare = texts < LEAST_TEXTS
    w, spread = np.zeros(size), np.full(size, 1e-2)
    bias, bias_spread = _START_BIAS, 1e-2
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for i in rng.permutation(len(local)):
            sentence, n, seen, inverse, label = local[i]
            logits = bias + np.bincount(sentence, weights=w[seen][inverse], minlength=n)
            p = np.exp(-np.logaddexp(0, -logits))
            free = np.logaddexp(0, logits).sum()
            # d loss / d logit of a sentence: p for a clean text, -p (1 - P) / P for a toxic one.
            toward = weights[label] * (p if label == 0 else -p * np.exp(-free) / max(-np.expm1(-free), 1e-12))
            step = np.bincount(inverse, weights=toward[sentence], minlength=len(seen))
            step[rare[seen]] = 0.0
            spread[seen] += step * step
            pace = rate / np.sqrt(spread[seen])
            moved = w[seen] - pace * step
            w[seen] = np.sign(moved) * np.maximum(np.abs(moved) - pace * PENALTY, 0.0)
            total = float(toward.sum())
            bias_spread += total * total
            bias -= rate * total / np.sqrt(bias_spread)
    return Model(w.astype(np.float32), float(bias))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches, "_text"):
        found = split(chunk)
        first = np.searchsorted(found.rows, np.arange(chunk.rows))
        sentences = [found.word_sentence[w] for w, _ in found.word_buckets]
        sentence = np.concatenate(sentences) if sentences else np.empty(0, dtype=np.int64)
        bucket = np.concatenate([b for _, b in found.word_buckets]) if sentences else np.empty(0, dtype=np.int64)
        row = found.rows[sentence] if len(sentence) else sentence
        order = np.argsort(row, kind="stable")
        ends = pa.array(np.searchsorted(row[order], np.arange(chunk.rows + 1)).astype(np.int32))
        inside = (sentence - first[row])[order].astype(np.int32) if len(row) else sentence.astype(np.int32)
        lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (inside, bucket[order].astype(np.int32))]
        kept = [chunk.batch.column(c) for c in ("_order", "_label", "_bytes")]
        yield pa.RecordBatch.from_arrays([*kept, *lists], names=["_order", "_label", "_bytes", "sentences", "buckets"])


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES,
) -> Model:
    """Fit on labelled rows that are not held out.  The bounded sample is handled by one task; the model comes to the driver."""
    known = labels.where(F.col(f"`{label_col}`").isin(0, 1) & F.col(f"`{id_col}`").isNotNull() & (remainder(id_col) != 0))
    known = known.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_label")).distinct()
    known = materialise(known, "labels")
    if known.select("_label").distinct().count() < 2:
        return Model(np.zeros(1 << BUCKET_BITS, dtype=np.float32), 0.0, fitted=False)
    hashed = F.xxhash64(F.col("_id").cast("string"))
    first, second = (known.where(F.col("_label") == v).orderBy(hashed, "_id").limit(sample_rows) for v in (0, 1))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_bytes(text_col).alias("_text"))
    rows = rows.withColumn("_bytes", F.octet_length("_text")).where(F.col("_bytes") <= sample_bytes)
    rows = rows.join(F.broadcast(first.unionByName(second)), "_id")
    rows = rows.select(hashed.alias("_order"), "_label", F.col("_bytes").cast("long").alias("_bytes"), "_text")
    schema = "_order long, _label int, _bytes long, sentences array<int>, buckets array<int>"
    bags = materialise(rows.mapInArrow(_bags, schema), "bags")
    # Repeated document ids could make the join larger than the sample.
    order = Window.partitionBy("_label").orderBy("_order", "_bytes", F.xxhash64("buckets"))
    sums = bags.select("*", F.row_number().over(order).alias("_place"), F.sum("_bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_sum"))
    picked = sums.where((F.col("_place") <= sample_rows) & (F.col("_sum") <= sample_bytes)).select("_order", "_label", "_bytes", "sentences", "buckets")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            s, b = batch.column(3), batch.column(4)
            for i in range(batch.num_rows):
                pair = (s[i].values.to_numpy(), b[i].values.to_numpy())
                found.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), *pair))
        found.sort(key=lambda x: (x[0], x[1], x[2], x[4].tobytes()))
        counts = [sum(1 for x in found if x[1] == v) for v in (0, 1)]
        if all(counts):
            ratio = float(np.clip(np.sqrt(counts[0] / counts[1]), 1 / MOST_WEIGHT, MOST_WEIGHT))
            model = fit([(x[3], x[4], x[1]) for x in found], (1.0, ratio))
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], names=["weights", "bias"])

    learned = picked.repartition(1).mapInArrow(learn, "weights binary, bias double").collect()
    if not learned:
        return Model(np.zeros(1 << BUCKET_BITS, dtype=np.float32), 0.0, fitted=False)
    return Model(np.frombuffer(bytes(learned[0]["weights"]), dtype=np.float32).copy(), learned[0]["bias"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted, and the number of sentences and of offending ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "_text"):
            scores, found, p = shared.value.scores(chunk)
            counts = [np.bincount(found.rows, weights=v, minlength=chunk.rows).astype(np.int64) for v in (np.ones(len(p)), p >= FLAGGED)]
            kept = [chunk.batch.column(c) for c in ("_id", "_held")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores), *map(pa.array, counts)], names=["_id", "_held", "score", "n_sentences", "n_offending"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(remainder(id_col) == 0, F.lit(False)).alias("_held"), text_bytes(text_col).alias("_text"))
    scored = rows.mapInArrow(run, "_id long, _held boolean, score double, n_sentences long, n_offending long")
    return scored.select(
        F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "score", (F.col("score") >= FLAGGED).cast("int").alias("predicted"), "n_sentences", "n_offending"
    )


def offending_sentences(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = FLAGGED) -> DataFrame:
    """Rows (id, first byte, number of bytes, sentence, probability) of the sentences with a probability of `least` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "_text"):
            _, found, p = shared.value.scores(chunk)
            bad = np.flatnonzero(p >= least)
            rows, starts, ends = found.rows[bad], found.starts[bad], found.ends[bad]
            texts = [chunk.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [chunk.batch.column("_id").take(pa.array(rows)), pa.array(starts - chunk.offsets[rows]), pa.array(ends - starts), pa.array(texts, pa.string()), pa.array(p[bad])],
                names=["_id", "first_byte", "n_bytes", "sentence", "probability"],
            )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), text_bytes(text_col).alias("_text"))
    found = rows.mapInArrow(run, "_id long, first_byte long, n_bytes long, sentence string, probability double")
    return found.withColumnRenamed("_id", id_col)
