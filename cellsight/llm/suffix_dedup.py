"""Removal of repeated 200-byte strings by sharded external suffix sorting.

1. In every run of 126 starts the least hash of a 75-byte string names an anchor, so equal 200-byte strings
   have an equal anchor at an equal offset.  An anchor owns the consecutive starts that chose it; its stretch is
   the bytes from the first of these starts to 200 bytes beyond the last.
2. Anchors are sorted by their hash and the hash of their stretch (64 bits each) and read as a stream.  Copies
   of a stretch collapse: all their starts are repeated.  An anchor without an equal one is unique.  What is left,
   different stretches around an equal anchor and one copy of each that has copies, goes to shards.
3. A shard, the stretches of some anchors, is suffix-sorted by induction with common-prefix values; a start
   is repeated when its suffix shares 200 bytes with a neighbour.  Tuples beyond a bound lie in files.
4. An anchor whose stretches exceed a shard is not sorted: its starts are dealt by the hash of their 200 bytes
   (64 bits, beside those of the anchor) and read as a stream in that order, where equal neighbours are repeated.
   So a shard is never longer than two bounds and one stretch, and a frequent line between different
   neighbours goes to all tasks.
5. Starts become byte spans, which are merged for each document and cut from its text.

Matches never cross documents.  Null and empty texts have no bytes.  Rows are told apart by a row number,
so repeated rows are repeated texts and null ids are harmless.  Other columns are ignored, or kept by
`without_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cellsight.llm.common import ROW, Chunk, chunks, materialise, mixed, sized, substring_hashes, text_bytes, with_row
from cellsight.llm.induced_sort import repeated_positions

_U = np.uint64
LENGTH = 200
GRAM = 75
_STARTS = LENGTH - GRAM + 1
#: Bytes of a shard; the stretches of one anchor are never parted, and with more than this they are not sorted.
SHARD_BYTES = 1 << 20
SORT_MEMORY = 48 << 20
_PIECE = 1 << 20
_WINDOWS = 1 << 16
_PLACE_BITS = 22
_FULL, _PART, _COPY = 0, 1, 2


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if width > span:
        out = np.minimum(out[: -(width - span)], out[width - span :])
    return out


def _anchors(chunk: Chunk) -> dict[str, np.ndarray] | None:
    """Owner row, first start in the row, number of further starts, anchor hash and stretch hash."""
    n = len(chunk.data)
    if n < LENGTH:
        return None
    running = chunk.running()
    row_of = np.repeat(np.arange(chunk.rows), np.diff(chunk.offsets))
    found: list[tuple] = []
    # Starts in pieces: places in a piece are packed into the low bits of the hashes.
    for low in range(0, n - LENGTH + 1, _PIECE):
        high = min(low + _PIECE, n - LENGTH + 1)
        at = np.arange(low, high + _STARTS - 1)
        hashes = substring_hashes(running, at, at + GRAM)
        mask = _U((1 << _PLACE_BITS) - 1)
        least = _window_least((hashes & ~mask) | (at - low).astype(_U), _STARTS)
        starts = np.flatnonzero(row_of[low:high] == row_of[low + LENGTH - 1 : high + LENGTH - 1])
        if not len(starts):
            continue
        place = (least[starts] & mask).astype(np.int64)
        new = np.concatenate(([True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)))
        first = np.flatnonzero(new)
        begin, end = starts[first] + low, starts[np.append(first[1:], len(starts)) - 1] + low
        anchor = place[first]
        shape = mixed((anchor + low - begin).astype(_U) * _U(1 << 16) + (end - begin).astype(_U))
        found.append((row_of[begin], begin - chunk.offsets[row_of[begin]], end - begin, hashes[anchor], substring_hashes(running, begin, end + LENGTH) ^ shape))
    if not found:
        return None
    return dict(zip(("row", "start", "more", "key", "stretch"), (np.concatenate(x) for x in zip(*found, strict=True)), strict=True))


def _anchor_rows(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "_text"):
            a = _anchors(chunk)
            if a is not None:
                ids = chunk.batch.column(ROW).to_numpy()[a["row"]]
                arrays = [a["key"].view(np.int64), a["stretch"].view(np.int64), ids, a["start"].astype(np.int32), a["more"].astype(np.int16)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["key", "stretch", ROW, "start", "more"])

    return texts.select(ROW, "_text").mapInArrow(run, f"key long, stretch long, {ROW} long, start int, more short")


def _sorted_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor and stretch: mark copies, and the stretches to be sorted.

    Of a run of equal stretches only the first and the last row wait for the next batch.
    """
    names = ["key", "stretch", ROW, "start", "more"]
    held: dict[str, np.ndarray] | None = None
    for batch in _then_none(batches):
        if batch is not None:
            new = {c: batch.column(c).to_numpy() for c in names} | {"told": np.zeros(batch.num_rows, dtype=bool), "many": np.zeros(batch.num_rows, dtype=bool)}
            if not batch.num_rows:
                continue
            held = new if held is None else {c: np.concatenate((held[c], new[c])) for c in new}
        if held is None:
            return
        n = len(held["key"])
        same_key = held["key"][1:] == held["key"][:-1]
        same = same_key & (held["stretch"][1:] == held["stretch"][:-1])
        first = np.concatenate(([True], ~same))
        run = np.cumsum(first) - 1
        heads = np.flatnonzero(first)
        size = np.diff(np.append(heads, n))
        copies = size > 1
        # An anchor has several stretches when a neighbouring run has the same hash; `many` remembers earlier ones.
        linked = held["key"][heads[1:]] == held["key"][heads[:-1]]
        several = held["many"][heads].copy()
        several[1:] |= linked
        several[:-1] |= linked
        last_run = len(heads) - 1
        final = batch is None
        ready_run = np.ones(len(heads), dtype=bool)
        ready_run[last_run] = final
        full = copies[run] & ~held["told"]
        full[-1] &= final
        head = np.zeros(n, dtype=bool)
        head[heads] = True
        shard = head & (several & ready_run)[run]
        for kind, mask in ((_FULL, full), (_PART, shard & ~copies[run]), (_COPY, shard & copies[run])):
            if mask.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(int(mask.sum()), kind, dtype=np.int8)), *[pa.array(held[c][mask]) for c in ("key", ROW, "start", "more")]],
                    names=["kind", "key", ROW, "start", "more"],
                )
        if final:
            return
        keep = np.array([heads[last_run]] if size[last_run] == 1 else [heads[last_run], n - 1])
        many = several[last_run]
        told = full | held["told"]
        held = {c: v[keep].copy() for c, v in held.items()}
        held["many"][:], held["told"] = many, told[keep]


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _stretches(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """The bytes of the stretches to be sorted."""
    wanted = marks.where(F.col("kind") != _FULL).groupBy(ROW).agg(F.collect_list(F.struct("key", "start", "more", "kind")).alias("_wanted"))
    wanted = materialise(wanted, "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for r in range(batch.num_rows):
                text, row = batch.column("_text")[r].as_py(), batch.column(ROW)[r].as_py()
                for w in batch.column("_wanted")[r].as_py():
                    rows.append({"key": w["key"], "kind": w["kind"], ROW: row, "start": w["start"], "more": w["more"], "part": text[w["start"] : w["start"] + w["more"] + LENGTH]})
                if len(rows) > 5000 or (rows and r == batch.num_rows - 1):
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []

    schema = pa.schema([("key", pa.int64()), ("kind", pa.int8()), (ROW, pa.int64()), ("start", pa.int32()), ("more", pa.int16()), ("part", pa.binary())])
    joined = texts.select(ROW, "_text").join(sized(wanted, 400), ROW)
    return joined.mapInArrow(run, f"key long, kind byte, {ROW} long, start int, more short, part binary")


def _window_rows(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """One row for every start of the marked stretches: anchor, hash of its 200 bytes, row and start."""
    wanted = marks.groupBy(ROW).agg(F.collect_list(F.struct("key", "start", "more")).alias("_wanted"))
    wanted = materialise(wanted, "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "_text"):
            running = chunk.running()
            lists = chunk.batch.column("_wanted")
            asked = lists.flatten()
            owner = np.repeat(np.arange(chunk.rows), pa.compute.list_value_length(lists).to_numpy())
            size = asked.field("more").to_numpy().astype(np.int64) + 1
            key, start = asked.field("key").to_numpy(), asked.field("start").to_numpy()
            ids = chunk.batch.column(ROW).to_numpy()[owner]
            ends = np.cumsum(size)
            low = 0
            while low < len(size):
                high = max(low + 1, int(np.searchsorted(ends, ends[low] + _WINDOWS)))
                many = size[low:high]
                begin = np.repeat(start[low:high].astype(np.int64), many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                at = begin + np.repeat(chunk.offsets[owner[low:high]], many)
                window = substring_hashes(running, at, at + LENGTH).view(np.int64)
                arrays = [np.repeat(key[low:high], many), window, np.repeat(ids[low:high], many), begin.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["key", "window", ROW, "start"])
                low = high

    joined = texts.select(ROW, "_text").join(sized(wanted, 400), ROW)
    return joined.mapInArrow(run, f"key long, window long, {ROW} long, start int")


def _equal_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts sorted by anchor and window: those that have an equal one.  Only the last row waits for the next batch."""
    names = ["key", "window", ROW, "start"]
    held: dict[str, np.ndarray] | None = None
    before = False  # whether the row that waits equals the one before it
    for batch in _then_none(batches):
        if batch is not None:
            if not batch.num_rows:
                continue
            new = {c: batch.column(c).to_numpy() for c in names}
            held = new if held is None else {c: np.concatenate((held[c], new[c])) for c in names}
        if held is None:
            return
        same = (held["key"][1:] == held["key"][:-1]) & (held["window"][1:] == held["window"][:-1])
        hit = np.concatenate(([before], same)) | np.append(same, False)
        before = bool(same[-1]) if len(same) else before
        if batch is not None:
            hit[-1] = False
        if hit.any():
            low = held["start"][hit].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(held[ROW][hit]), pa.array(low), pa.array(low + LENGTH)], names=[ROW, "low", "high"])
        held = {c: v[-1:].copy() for c, v in held.items()}


def _sorted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by anchor: suffix-sort shards and return runs of repeated starts."""
    rows: list[tuple] = []
    size, key = 0, None

    def finish() -> pa.RecordBatch:
        # A byte is its value and 2, strings end with 1; bytes from 0xFE on are not in UTF-8 and need wider symbols.
        raw = b"".join(r[4] for r in rows)
        symbols = np.frombuffer(raw, dtype=np.uint8)
        lengths = np.array([len(r[4]) for r in rows])
        ends = np.cumsum(lengths)
        dtype = np.uint16 if len(symbols) and symbols.max() > 253 else np.uint8
        text = np.insert(symbols.astype(dtype) + dtype(2), ends, dtype(1))
        flags = repeated_positions(text, LENGTH, SORT_MEMORY)
        begin = ends - lengths + np.arange(len(rows))
        out_row, out_low, out_high = [], [], []
        for (kind, row, start, more, _), at in zip(rows, begin.tolist(), strict=True):
            if kind != _PART:
                continue
            hit = np.flatnonzero(np.diff(np.concatenate(([False], flags[at : at + more + 1], [False])).astype(np.int8)))
            for low, high in zip(hit[::2].tolist(), hit[1::2].tolist(), strict=True):
                out_row.append(row)
                out_low.append(start + low)
                out_high.append(start + high - 1 + LENGTH)
        return pa.RecordBatch.from_arrays([pa.array(out_row, pa.int64()), pa.array(out_low, pa.int64()), pa.array(out_high, pa.int64())], names=[ROW, "low", "high"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "kind", ROW, "start", "more", "part")]
        for k, *rest in zip(*columns, strict=True):
            if k != key and size >= SHARD_BYTES:
                yield finish()
                rows, size = [], 0
            key = k
            rows.append(tuple(rest))
            size += len(rest[4]) + 1
    if rows:
        yield finish()


def repeated_spans(texts: DataFrame) -> DataFrame:
    """`_row, lows, highs`: the merged spans of bytes to remove, for rows that have any.

    `texts` is a written table with _row and _text (binary).
    """
    ordered = _anchor_rows(texts).repartition("key").sortWithinPartitions("key", "stretch")
    marks = materialise(ordered.mapInArrow(_sorted_marks, f"kind byte, key long, {ROW} long, start int, more short"), "marks")
    differing = marks.where(F.col("kind") != _FULL)
    large = differing.groupBy("key").agg(F.sum(F.col("more") + LENGTH + 1).alias("bytes")).where(F.col("bytes") > SHARD_BYTES)
    large = materialise(large.select("key"), "large")
    hinted = sized(large, 16)
    shards = _stretches(texts, marks.join(hinted, "key", "left_anti")).repartition("key").sortWithinPartitions("key")
    found = shards.mapInArrow(_sorted_shards, f"{ROW} long, low long, high long")
    if large.limit(1).count():
        dealt = _window_rows(texts, differing.join(hinted, "key", "left_semi")).repartition("window").sortWithinPartitions("window", "key")
        found = found.unionByName(dealt.mapInArrow(_equal_windows, f"{ROW} long, low long, high long"))
    copies = marks.where(F.col("kind") == _FULL)
    copies = copies.select(ROW, F.col("start").cast("long").alias("low"), (F.col("start") + F.col("more") + LENGTH).cast("long").alias("high"))
    grouped = copies.unionByName(found).groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("spans"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            lists = spans.flatten()
            low, high = lists.field("low").to_numpy(), lists.field("high").to_numpy()
            offsets = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(spans).to_numpy())))
            lows, highs = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                reach = np.maximum.accumulate(high[a:b])
                new = np.flatnonzero(np.concatenate(([True], low[a + 1 : b] > reach[:-1])))
                lows.append(low[a:b][new])
                highs.append(reach[np.append(new[1:], b - a) - 1])
            yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(lows, pa.list_(pa.int64())), pa.array(highs, pa.list_(pa.int64()))], names=[ROW, "lows", "highs"])

    return materialise(grouped.mapInArrow(merge, f"{ROW} long, lows array<long>, highs array<long>"), "spans")


def _remaining(text: bytes, lows: list[int] | None, highs: list[int] | None) -> bytes:
    if not lows:
        return text
    return b"".join(text[a:b] for a, b in zip([0, *highs], [*lows, len(text)], strict=True))


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans and the digest of the remaining bytes."""
    texts = materialise(with_row(docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), text_bytes(text_col).alias("_text"))), "texts")
    joined = texts.join(sized(repeated_spans(texts), 120), ROW, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_kept, n_spans, digest = [], [], [], []
            for r in range(batch.num_rows):
                text, lows, highs = (batch.column(c)[r].as_py() for c in ("_text", "lows", "highs"))
                rest = _remaining(text, lows, highs)
                n_bytes.append(len(text))
                n_kept.append(len(rest))
                n_spans.append(len(lows or ()))
                digest.append(hashlib.sha256(rest).hexdigest())
            removed = pa.array(np.array(n_bytes, dtype=np.int64) - np.array(n_kept, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(n_bytes, pa.int64()), removed, pa.array(n_spans, pa.int64()), pa.array(digest, pa.string())],
                names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return joined.mapInArrow(run, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """The rows of `docs` with the repeated bytes cut from their texts.

    A character of which some bytes are repeated goes whole.  Rows whose text is left blank by the cut go;
    rows that were blank before stay.  `chars_col`, if given, is set to the new number of characters.
    """
    columns = docs.columns
    numbered = materialise(with_row(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])), "numbered")
    text_at = f"c{columns.index(text_col)}"
    spans = repeated_spans(numbered.select(ROW, text_bytes(text_at).alias("_text")))
    joined = numbered.join(sized(spans, 120), ROW, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = (batch.column(c).to_pylist() for c in ("_text", "lows", "highs"))
            cut = [None if lows is None else _remaining(t, lows, highs).decode("utf-8", "ignore") for t, lows, highs in zip(*parts, strict=True)]
            names = [c for c in batch.schema.names if c not in ("_text", "lows", "highs")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(cut, pa.string())], names=[*names, "_cut"])

    inner = joined.withColumn("_text", F.when(F.col("lows").isNotNull(), text_bytes(text_at)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema)
    done = inner.select(*numbered.columns, "_text", "lows", "highs").mapInArrow(run, f"{kinds}, _cut string")
    done = done.where("_cut IS NULL OR _cut RLIKE '[^ \\\\x09-\\\\x0D]'")
    text = F.coalesce(F.col("_cut"), F.col(text_at))
    out = []
    for i, c in enumerate(columns):
        value = F.col(f"c{i}")
        if c == text_col:
            value = text
        elif c == chars_col:
            value = F.when(F.col("_cut").isNotNull(), F.length("_cut")).otherwise(value).cast(docs.schema[c].dataType)
        out.append(value.alias(c))
    return done.select(*out)
