"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

No piece of the vocabulary crosses the start of a run of spaces or a line break (checked when the
model is loaded), so the count of a prefix is the count at the last such start plus the count of the
rest.  Inside a segment the table is filled from left to right: the encoding of a prefix ends with the
one piece that may follow the last piece of a shorter prefix, which a probe of two pieces decides.
A segment is cut again between any two characters that stand side by side in no piece; the count of such a
stretch is the last entry of its table, and a worker remembers the counts of stretches and of segments.
The model's own space sign in a text counts like a space, as the library has it.

Null and empty texts have no tokens.  A very long text is handled segment by segment.  Other columns of
the input are ignored, whatever their names; rows are kept as they are, repeated ones included; an empty
table gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from cellsight.llm.common import text_bytes

SPACE_SIGN = "▁"
_SIGN_BYTES = SPACE_SIGN.encode()
#: Longer pieces are looked up by this many last characters.
_TAIL = 3
#: Characters at the start of a stretch whose table is kept for the stretches that begin alike.
_HEAD = 6
_SEGMENT = re.compile(rb"\n[^ \n]*| +[^ \n]*|[^ \n]+")
#: Segments, and pairs of pieces, that a worker remembers before it starts anew; longer segments are counted each time.
REMEMBERED = 1 << 19
REMEMBERED_BYTES = 64


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class PrefixCounter(dict):
    """Counts of segments (as a dictionary) and of all prefixes, for one sentencepiece BPE model."""

    def __init__(self, model: bytes):
        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.separable = not any(SPACE_SIGN in p.lstrip(SPACE_SIGN) or "\n" in p or " " in p for p in pieces)
        self.pieces = set(pieces)
        tails: dict[str, set[int]] = {}
        for piece in self.pieces:
            if len(piece) >= _TAIL:
                tails.setdefault(piece[-_TAIL:], set()).add(len(piece))
        self.tails = {tail: tuple(sorted(sizes | {2}, reverse=True)) for tail, sizes in tails.items()}
        self.pairs = {pair for piece in self.pieces for pair in zip(piece, piece[1:])}
        self.follows: dict[tuple[str, str], bool] = {}
        self.stretches: dict[str, int] = {}
        self.heads: dict[str, tuple[list[int], list[str]]] = {}

    def _stretch(self, text: str) -> int:
        """The count of a stretch, from its prefix table."""
        count = self.stretches.get(text)
        if count is None:
            count = self.inside(text)[-1]
            if len(text) <= REMEMBERED_BYTES:
                if len(self.stretches) > REMEMBERED:
                    self.stretches.clear()
                self.stretches[text] = count
        return count

    def __missing__(self, segment: bytes) -> int:
        text = segment.decode("utf-8", "replace").replace(" ", SPACE_SIGN)
        pairs, count, start = self.pairs, 0, 0
        for end, pair in enumerate(zip(text, text[1:]), 1):
            if pair not in pairs:
                count += self._stretch(text[start:end])
                start = end
        count += self._stretch(text[start:])
        if len(segment) <= REMEMBERED_BYTES:
            if len(self) > REMEMBERED:
                self.clear()
            self[segment] = count
        return count

    def segments(self, text: bytes) -> tuple[list[bytes], list[int]]:
        """The segments and the token count at the end of each."""
        if not text:
            return [], []
        if not self.separable:
            return [text], [len(self.library.encode(text.decode("utf-8", "replace")))]
        found = _SEGMENT.findall(b" " + text.replace(_SIGN_BYTES, b" "))
        return found, list(accumulate(map(self.__getitem__, found)))

    def count(self, text: bytes) -> int:
        ends = self.segments(text)[1]
        return ends[-1] if ends else 0

    def _encoded(self, escaped: str) -> list[str]:
        """Pieces of a text that already holds space signs, without the one that the library adds."""
        return self.library.encode("\n" + escaped.replace(SPACE_SIGN, " "), out_type=str)[2:]

    def _fits(self, last: str, piece: str) -> bool:
        key = (last, piece)
        if key not in self.follows:
            if len(self.follows) > REMEMBERED:
                self.follows.clear()
            self.follows[key] = self._encoded(last + piece) == ([last, piece] if last else [piece])
        return self.follows[key]

    def inside(self, segment: str) -> list[int]:
        """Counts of the prefixes of a segment that has space signs for spaces, from the empty one on."""
        head = self.heads.get(segment[:_HEAD])
        counts, last = (head[0][:], head[1][:]) if head else ([0], [""])
        pieces, tails, follows = self.pieces, self.tails, self.follows
        for end in range(len(counts), len(segment) + 1):
            for size in tails.get(segment[end - _TAIL : end], (2,)) if end >= _TAIL else (2,):
                if size > end:
                    continue
                piece, before = segment[end - size : end], last[end - size]
                if piece in pieces:
                    fits = follows.get((before, piece))
                    if fits if fits is not None else self._fits(before, piece):
                        counts.append(counts[end - size] + 1)
                        last.append(piece)
                        break
            else:
                char = segment[end - 1]
                # A character outside the vocabulary stands for its bytes and joins nothing.
                known = char in pieces
                counts.append(counts[end - 1] + (1 if known else len(char.encode())))
                last.append(char if known else "")
        if not head and len(segment) >= _HEAD:
            if len(self.heads) > REMEMBERED:
                self.heads.clear()
            self.heads[segment[:_HEAD]] = counts[: _HEAD + 1], last[: _HEAD + 1]
        return counts

    def prefixes(self, text: str) -> list[int]:
        """counts[i]: tokens of text[:i]."""
        if not text:
            return [0]
        if not self.separable:
            return [0, *(len(self.library.encode(text[:i])) for i in range(1, len(text) + 1))]
        escaped = (" " + text.replace(SPACE_SIGN, " ")).encode()
        out, total = [], 0
        for segment in _SEGMENT.findall(escaped):
            counts = self.inside(segment.decode().replace(" ", SPACE_SIGN))
            out += [total + c for c in counts[1:]]
            total += counts[-1]
        return [0, *out[1:]]  # out[0] belongs to the added space

    def cut(self, text: bytes, limit: int) -> int:
        """Characters in the longest prefix with at most `limit` tokens."""
        found, ends = self.segments(text)
        if not ends or ends[-1] <= limit:
            return len(text.decode("utf-8", "replace"))
        if not self.separable:
            counts = self.prefixes(text.decode("utf-8", "replace"))
            return max(i for i, c in enumerate(counts) if c <= limit)
        at = bisect_right(ends, limit)  # the first segment that ends beyond the limit
        before = ends[at - 1] if at else 0
        counts = self.inside(found[at].decode("utf-8", "replace").replace(" ", SPACE_SIGN))
        inner = max(i for i, c in enumerate(counts) if before + c <= limit)
        return max(0, len(b"".join(found[:at]).decode("utf-8", "replace")) + inner - 1)


_COUNTERS: dict[bytes, PrefixCounter] = {}


def _counter(model: bytes) -> PrefixCounter:
    """The counter of a model; a worker keeps the last one, with what it remembers, for its next tasks."""
    if model not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[model] = PrefixCounter(model)
    return _COUNTERS[model]


def count_tokens(docs: DataFrame, model: bytes, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit and cut_chars (characters of the longest prefix within the limit)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in batches:
            texts = batch.column("_text")
            n_tokens, cuts = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            n_bytes = np.zeros(batch.num_rows, dtype=np.int64)
            for i, value in enumerate(texts):
                text = value.as_py()
                n_bytes[i], n_tokens[i] = len(text), counter.count(text)
                cuts[i] = counter.cut(text, limit) if n_tokens[i] > limit else len(text.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit), pa.array(cuts)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit", "cut_chars"],
            )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), text_bytes(text_col).alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long")


def prefix_table(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and `counts`, the token count of every prefix by its number of characters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):  # a row at a time: the table of a long text is large
                counts = counter.prefixes(batch.column("_text")[i].as_py().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(i, 1), pa.array([counts], type=pa.list_(pa.int32()))], names=[id_col, "counts"]
                )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), text_bytes(text_col).alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` long, counts array<int>")


def longest_within(prefixes: DataFrame, budget: str, output: str = "fits") -> DataFrame:
    """Characters of the longest stored prefix within the budget (an SQL expression), without encoding anything."""
    at = f"array_max(filter(transform(counts, (c, i) -> IF(c <= ({budget}), i, -1)), i -> i >= 0))"
    return prefixes.withColumn(output, F.expr(at))
