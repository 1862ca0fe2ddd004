"""A bigram language model whose counts live in a log-frequency Bloom filter.

The logarithmic level q of a bigram's count is stored as the members (bigram, 1) ... (bigram, q).  A probe asks
for level 1, 2, ... until one is missing; the last one found gives the count.  With c(v w) from the filter
and exact word counts, the probability of w after v is (c(v w) + M * P(w)) / (c(v) + M), where
P(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)) is the base model.  Every text ends with an end token, which
is counted like a word, and begins after a begin mark, which is not.

Sizes.  The filter has six bits per training token and is cut into parts of 1 MiB.  Texts are stored in compressed units of a few megabytes:
the distinct bigrams of a unit go once to the parts they hash to, with their training counts; the task of a part builds it,
probes it with all that came and returns a level per bigram, so neither the passes over the texts nor any broadcast grow with the corpus.
Exact counts of at most 2**22 words, the most frequent, are broadcast (64 MiB); the counts of all other
words are joined to the units that hold them.  Nothing is cut off.

Words are compared by 64-bit hashes.  A null text is an empty text and has the end token only.  Null ids
are not held out: they train.  Rows with equal ids are texts of
their own; other columns are ignored.  Without training rows the base has N = V = 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from cellsight.llm.common import ROW, Chunk, chunks, grouped, materialise, mixed, text_bytes, with_row

_U = np.uint64
BITS_PER_TOKEN = 6
#: Filter bytes whose parts leave a task in one Arrow batch.
SLICE_BYTES = 32 << 20
UNIT_BYTES = 4 << 20
PART_BYTES = 1 << 20
HEAD_WORDS = 1 << 22
LEVEL_BASE = 1.5
SMOOTHING = 20.0
_END, _BEGIN = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)
_TOKENS_PER_COUNT = 2_000_000
_PART_WORDS = PART_BYTES // 8


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens with the end tokens, the token before each, and the row of each."""
    words, rows = chunk.word_hashes()
    per_row = np.bincount(rows, minlength=chunk.rows) + 1
    out = np.full(len(words) + chunk.rows, _END)
    out[np.arange(len(words)) + rows] = words
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[np.cumsum(per_row) - per_row] = _BEGIN
    return out, before, np.repeat(np.arange(chunk.rows), per_row)


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(before * _U(0x9E3779B97F4A7C15) + word)


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(LEVEL_BASE) + 1e-9).astype(np.int64)


def level_counts(most: int = 120) -> np.ndarray:
    """The mean of the whole numbers of each level; 0 for level 0."""
    out = np.zeros(most + 1)
    for q in range(1, most + 1):
        low, high = math.ceil(LEVEL_BASE ** (q - 1) - 1e-9), math.ceil(LEVEL_BASE**q - 1e-9) - 1
        out[q] = (low + max(low, high)) / 2
    return out


@dataclass(frozen=True)
class Layout:
    """Where bigrams lie: a part is picked by the bigram, a word of the part by the bigram and the level."""

    parts: int

    @staticmethod
    def of(training_tokens: int) -> "Layout":
        return Layout(max(1, math.ceil(training_tokens * BITS_PER_TOKEN / 8 / PART_BYTES)))

    @property
    def slices(self) -> list[tuple[int, int]]:
        step = SLICE_BYTES // PART_BYTES
        return [(at, min(at + step, self.parts)) for at in range(0, self.parts, step)]

    def part(self, keys: np.ndarray) -> np.ndarray:
        return (((keys >> _U(32)) * _U(self.parts)) >> _U(32)).astype(np.int64)

    @staticmethod
    def place(keys: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """The word of the part, and the three bits in it."""
        h = mixed(keys + np.asarray(level, dtype=np.uint64) * _U(0xD1342543DE82EF95))
        bits = (_U(1) << (h & _U(63))) | (_U(1) << ((h >> _U(6)) & _U(63))) | (_U(1) << ((h >> _U(12)) & _U(63)))
        return ((h >> _U(20)) % _U(_PART_WORDS)).astype(np.int64), bits


def build_part(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The words of one part from rows of (bigram, count); a bigram may come in several rows."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    keys, level = keys[first], levels(np.add.reduceat(counts, first))
    out = np.zeros(_PART_WORDS, dtype=np.uint64)
    for q in range(1, int(level.max()) + 1):
        at, bits = Layout.place(keys[level >= q], q)
        np.bitwise_or.at(out, at, bits)
    return out


def probe(filter_words: np.ndarray, parts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Levels of bigrams in a slice; `parts` count from the slice's first."""
    found, open_, level = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys)), 0
    base = parts * _PART_WORDS
    while len(open_) and level < 120:
        level += 1
        at, bits = Layout.place(keys[open_], level)
        open_ = open_[(filter_words[base[open_] + at] & bits) == bits]
        found[open_] = level
    return found


def _units(texts: DataFrame) -> DataFrame:
    """Numbered texts in units of UNIT_BYTES or one longer text: a row with the ids, what is held out, the lengths and the compressed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids, out, text = (pa.concat_arrays([b.column(c) for b in held]) for c in ("_id", "_held", "_text"))
            data = b"".join(bytes(c.data) for c in chunks(iter(held), "_text"))
            ends = pa.array([0, len(ids)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, values) for values in (ids, out, pc.binary_length(text).cast(pa.int64()))]
            columns = [held[0].column(ROW).slice(0, 1), *lists, pa.array([pa.compress(data, codec="zstd", asbytes=True)], pa.binary())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["_unit", "_ids", "_out", "_lengths", "_texts"])

        for batch in batches:
            start = 0
            for at, length in enumerate(pc.binary_length(batch.column("_text")).to_pylist()):
                if size and size + length > UNIT_BYTES:
                    held.append(batch.slice(start, at - start))
                    yield flush()
                    start, size = at, 0
                size += length + 8
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield flush()

    return texts.mapInArrow(run, "_unit long, _ids array<long>, _out array<boolean>, _lengths array<long>, _texts binary")


def _unit_tokens(lengths: np.ndarray, packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `tokens`, over the texts of a unit."""
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    data = pa.decompress(packed, decompressed_size=int(offsets[-1]), codec="zstd") if offsets[-1] else pa.py_buffer(b"")
    texts = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int64)), data])
    found, base = [], 0
    for chunk in chunks(iter([pa.RecordBatch.from_arrays([texts], names=["_text"])]), "_text"):
        word, before, row = tokens(chunk)
        found.append((word, before, row + base))
        base += chunk.rows
    word, before, row = (np.concatenate(c) for c in zip(*found))
    return word, before, row


def _word_counts(units: DataFrame) -> DataFrame:
    """Words of training texts and their counts, summed within a few million tokens of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(keys), 1 << 18):
                k, c = keys[at : at + (1 << 18)].view(np.int64), counts[at : at + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], names=["key", "n"])
            held.clear()

        size = 0
        for batch in batches:
            for out, lengths, packed in zip(*batch.columns):
                word, _, row = _unit_tokens(lengths.values.to_numpy(), packed.as_py())
                held.append(word[~_flags(out)[row]])
                size += len(held[-1])
                if size > _TOKENS_PER_COUNT:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return units.select("_out", "_lengths", "_texts").mapInArrow(run, "key long, n long")


def _flags(values: pa.ListScalar) -> np.ndarray:
    return values.values.to_numpy(zero_copy_only=False).astype(bool)


def _packed(keys: np.ndarray) -> bytes:
    """Differences of ascending keys by byte planes: the upper planes are zeros, which compress."""
    return np.diff(keys, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(value: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(value, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _pair_rows(units: DataFrame, layout: Layout) -> DataFrame:
    """Per unit and part of the filter: the sorted distinct bigrams and how often training texts hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, out, lengths, packed in zip(*batch.columns):
                word, before, row = _unit_tokens(lengths.values.to_numpy(), packed.as_py())
                keys, back = np.unique(pair_keys(before, word), return_inverse=True)
                counts = np.bincount(back, weights=~_flags(out)[row], minlength=len(keys)).astype(np.int32)
                part = layout.part(keys)  # keys ascend, so parts do
                for low, high in layout.slices:
                    at = np.searchsorted(part, np.arange(low, high + 1))
                    some = np.flatnonzero(at[1:] > at[:-1])
                    spans = [slice(at[i], at[i + 1]) for i in some]
                    columns = [pa.array(np.full(len(some), unit.as_py())), pa.array(some + low)]
                    columns += [pa.array([v(values[x]) for x in spans], pa.binary()) for v, values in ((_packed, keys), (np.ndarray.tobytes, counts))]
                    yield pa.RecordBatch.from_arrays(columns, names=["_unit", "part", "keys", "counts"])

    return units.select("_unit", "_out", "_lengths", "_texts").mapInArrow(run, "_unit long, part long, keys binary, counts binary")


def _levels(pairs: DataFrame, layout: Layout) -> DataFrame:
    """The rows of `_pair_rows` with the level of each bigram; every part is built and probed by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ["part"]):
            split = [_unpacked(v) for v in rows.column("keys").to_pylist()]
            keys = np.concatenate(split)
            counts = np.concatenate([np.frombuffer(v, dtype=np.int32) for v in rows.column("counts").to_pylist()]).astype(np.int64)
            learnt = counts > 0
            words = build_part(keys[learnt], counts[learnt]) if learnt.any() else np.zeros(_PART_WORDS, dtype=np.uint64)
            found = probe(words, np.zeros(len(keys), dtype=np.int64), keys).astype(np.uint8)
            levels = [v.tobytes() for v in np.split(found, np.cumsum([len(k) for k in split])[:-1])]
            columns = [rows.column(c).combine_chunks() for c in ("_unit", "part")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(levels, pa.binary())], names=["_unit", "part", "levels"])

    dealt = pairs.repartition(layout.parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "_unit long, part long, levels binary")


def _head(vocabulary: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """The most frequent words (at most HEAD_WORDS) as sorted keys and counts, and the table of the others."""
    if size <= HEAD_WORDS:
        head, tail = vocabulary, None
    else:
        level = F.floor(F.log2("c"))
        least, total = 64, 0
        for row in vocabulary.groupBy(level.alias("l")).count().orderBy(F.desc("l")).collect():  # some 60 rows at most
            if total + row["count"] > HEAD_WORDS:
                break
            least, total = row["l"], total + row["count"]
        head, tail = vocabulary.where(level >= least), vocabulary.where(level < least)
    found = head.select("key", "c").toArrow()
    keys, counts = found.column("key").to_numpy().view(np.uint64), found.column("c").to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order], tail


def _lookup(table: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Counts of keys, -1 where the table has none."""
    if not len(table):
        return np.full(len(keys), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, counts[at], -1)


def _tail_counts(units: DataFrame, head, tail: DataFrame) -> DataFrame:
    """Per unit, the hashes and counts of words outside the head (words never seen are left out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, lengths, packed in zip(*batch.columns):
                unique = np.unique(_unit_tokens(lengths.values.to_numpy(), packed.as_py())[0])
                rare = unique[_lookup(*head.value, unique) < 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rare), unit.as_py())), pa.array(rare.view(np.int64))], names=["_unit", "key"])

    rows = units.select("_unit", "_lengths", "_texts").mapInArrow(run, "_unit long, key long")
    return rows.join(tail, "key").groupBy("_unit").agg(F.collect_list("key").alias("_keys"), F.collect_list("c").alias("_counts"))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    context = docs.sparkSession.sparkContext
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), held_out(id_col).alias("_held"), text_bytes(text_col).alias("_text"))
    units = materialise(_units(with_row(named)), "texts")
    vocabulary = materialise(_word_counts(units).groupBy("key").agg(F.sum("n").alias("c")), "vocabulary")
    n, v = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    layout = Layout.of(n)
    keys, counts, tail = _head(vocabulary, v)
    begins = int(_lookup(keys, counts, np.array([_END]))[0])  # as many texts begin as end
    head = context.broadcast((keys, counts))
    smoothing, means, denominator = SMOOTHING, level_counts(), math.log10(n + 0.5 * (v + 1))

    def scored(levels: np.ndarray, rare: tuple[np.ndarray, np.ndarray], ids: pa.Array, out: pa.Array, lengths: np.ndarray, packed: bytes) -> pa.RecordBatch:
        word, before, row = _unit_tokens(lengths, packed)
        unique, inverse = np.unique(word, return_inverse=True)
        c = np.maximum(_lookup(*head.value, unique), _lookup(*rare, unique))[inverse]
        c = np.maximum(c, 0).astype(np.float64)
        base = np.log10(c + 0.5) - denominator
        history = np.empty_like(c)
        history[1:] = c[:-1]
        history[before == _BEGIN] = max(begins, 0)
        seen, back = np.unique(pair_keys(before, word), return_inverse=True)
        if len(seen) != len(levels):
            raise RuntimeError(f"{len(levels)} levels came back for {len(seen)} bigrams")
        joint = np.minimum(means[levels][back], np.minimum(history, c))
        p = (joint + smoothing * 10**base) / (history + smoothing)
        total = lambda x: np.bincount(row, weights=x, minlength=len(lengths))
        return pa.RecordBatch.from_arrays(
            [
                ids, out, pa.array(np.bincount(row, minlength=len(lengths))),
                pa.array(total(c > 0).astype(np.int64)), pa.array(total(base)), pa.array(total(np.log10(p))),
            ],
            names=["_id", "_held", "n_tokens", "n_known", "base_score", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        levels, rare = [], none
        for batch in batches:
            for role, ids, out, lengths, value, words, found in zip(*batch.columns[1:2], *batch.columns[3:]):
                if role.as_py() == 0:
                    levels.append(np.frombuffer(value.as_py(), dtype=np.uint8))
                elif role.as_py() == 1:
                    words = words.values.to_numpy().view(np.uint64)
                    order = np.argsort(words)
                    rare = words[order], found.values.to_numpy()[order]
                else:
                    yield scored(np.concatenate(levels), rare, ids.values, out.values, lengths.values.to_numpy(), value.as_py())
                    levels, rare = [], none

    # Before the texts of a unit come the levels of its bigrams, by part, and its rare words.
    given = {"_part": "long", "_ids": "array<long>", "_out": "array<boolean>", "_lengths": "array<long>", "_texts": "binary", "_keys": "array<long>", "_counts": "array<long>"}

    def staged(df: DataFrame, role: int) -> DataFrame:
        return df.select("_unit", F.lit(role).alias("_role"), *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in given.items()])

    answers = _levels(_pair_rows(units, layout), layout).withColumnsRenamed({"part": "_part", "levels": "_texts"})
    stream = staged(answers, 0).unionByName(staged(units, 2))
    if tail is not None:
        stream = stream.unionByName(staged(_tail_counts(units, head, tail), 1))
    stream = stream.repartition("_unit").sortWithinPartitions("_unit", "_role", "_part")
    found = materialise(stream.mapInArrow(run, "_id long, _held boolean, n_tokens long, n_known long, base_score double, score double"), "scores")
    head.destroy()
    return found.select(
        F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "n_tokens", "n_known",
        F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score",
    )
