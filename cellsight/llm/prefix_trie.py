"""Prefix trie of conversations: union-find over the common prefixes of sorted neighbours.

A conversation is a sequence of turns; a turn stands as the SHA-256 digest of its role and text (lengths included), so texts are
read once and never sorted or compared again.  Sequences are range-sorted by digests and id; copies stand side by side, and
as the id is part of the order a hot conversation is spread over partitions.  Each sorted partition is cut into blocks of
bounded size.  In a block the neighbours' common prefix lengths are edges; joined in descending depth by union-find, every
merge creates a branching node (or adds a child to one of the same depth), which gives the forest of the block.

Only prefixes of a block's first and last sequence, its two spines, can occur in another block.  All other nodes are
final and leave at once; below a spine node the forest is contracted to sums.  Spine nodes, known by the digest of their
prefix, are merged over all blocks by partial aggregation: members and least id directly, sums over subtrees by running
sums along each spine in which every merged node is counted by one owner.  A final row below a spine takes its parent's
id by (block, side, depth), so no join key is hotter than a block.

Ids that end in a node are hashed as a stream in id order, in a block or, for the few nodes that span blocks, over pieces.

What a task holds: a block, and the longest conversation (32 bytes a turn).  Rows with a null conversation id
belong to no conversation and are left out; null turns come first; equal turns (ties) are ordered by the digest of role
and text; repeated rows are turns of their own; null roles and texts are empty; texts may have any length; an empty table has
no node, not even a root.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cellsight.llm.common import WORD, materialise

DIGEST = 32
#: A block ends at so many distinct sequences, turns, or bytes of ids.
BLOCK_SEQUENCES = 8_192
BLOCK_TURNS = 1 << 17
BLOCK_ID_BYTES = 1 << 19
NO_ENDS = hashlib.sha256(b"").hexdigest()
_WHOLE = 2**31 - 1

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_PASS = NODE + ", block long, side int, node binary, parent binary, words long, ids string"
_NAMES = [field.split()[0] for field in _PASS.split(", ")]


def turn_digest(role: str = "role", text: str = "text") -> Column:
    """SHA-256 of role and text; the length of the role parts the two."""
    role_, text_ = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    return F.unhex(F.sha2(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_), 256))


def sequences(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (id, turns): each conversation's ordered turns as structs (digest, words)."""
    words = F.regexp_count(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.lit(WORD)).cast("int")
    position = F.coalesce(F.col(f"`{turn_col}`").cast("long"), F.lit(0))
    rows = turns.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.struct(F.col(f"`{turn_col}`").isNotNull().alias("known"), position.alias("turn"), turn_digest(role_col, text_col).alias("digest"), words.alias("words")).alias("t"),
    )
    ordered = rows.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return ordered.select("id", F.transform("ts", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Conversations that begin with the first h turns of the conversation id - id % 20; h is crc32(id) % 4."""
    convs = materialise(convs, "conversations")
    heads = convs.where(F.col("id") % 20 == 0).select(F.col("id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    h = (F.crc32(F.col("id").cast("string").cast("binary")) % 4).cast("int")
    joined = convs.withColumns({"base": F.col("id") - F.col("id") % 20, "h": h}).join(heads, "base", "left")
    begin = F.when(F.col("head").isNull() | (F.col("h") == 0), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    return joined.select("id", F.concat(begin, F.slice("turns", F.col("h") + 1, F.lit(_WHOLE))).alias("turns"))


class _Block:
    """Distinct sequences of a block in ascending order with their members, and the forest over them."""

    def __init__(self, keys: list[bytes], words: list[np.ndarray], counts: list[int], least: list[int], ids: list[str]):
        self.keys, self.ids = keys, ids
        self.counts, self.least = np.array(counts), least
        self.length = np.array([len(k) // DIGEST for k in keys])
        self.words = [np.concatenate(([0], np.cumsum(w))) for w in words]
        self.depth, self.parent, self.first, self.last = self.length.tolist(), [], [], []
        self._join(self._common())

    def _common(self) -> np.ndarray:
        """Common prefix, in turns, of each sequence and the next."""
        m = len(self.keys)
        turns = np.frombuffer(b"".join(self.keys), dtype=np.dtype((np.void, DIGEST)))
        begin = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        common, alive = np.zeros(max(0, m - 1), dtype=np.int64), np.arange(m - 1)
        depth = 0
        while len(alive):
            alive = alive[(self.length[alive] > depth) & (self.length[alive + 1] > depth)]
            alive = alive[turns[begin[alive] + depth] == turns[begin[alive + 1] + depth]]
            depth += 1
            common[alive] = depth
        return common

    def _join(self, common: np.ndarray) -> None:
        """Union-find over the edges in descending depth; nodes 0..m-1 are the ends of the sequences."""
        m = len(self.keys)
        leader, top = list(range(m)), list(range(m))
        self.parent, self.first, self.last = [-1] * m, list(range(m)), list(range(m))

        def find(i: int) -> int:
            while leader[i] != i:
                leader[i] = leader[leader[i]]
                i = leader[i]
            return i

        for e in np.argsort(-common, kind="stable").tolist():
            d = int(common[e])
            left, right = find(e), find(e + 1)
            a, b = top[left], top[right]
            if self.depth[a] != d:
                # Neither side ends or branches here yet: a new branching node.
                node = len(self.depth)
                self.depth.append(d)
                self.parent.append(-1)
                self.first.append(self.first[a])
                self.last.append(self.last[a])
                self.parent[a] = node
                a = node
            self.parent[b] = a
            self.last[a] = max(self.last[a], self.last[b])
            leader[right] = left
            top[left] = a
        if self.depth[top[find(0)]] > 0:
            node = len(self.depth)
            self.depth.append(0)
            self.parent.append(-1)
            self.first.append(0)
            self.last.append(m - 1)
            self.parent[top[find(0)]] = node

    def rows(self) -> list[list]:
        """Columns of all rows of the block: final nodes, and the partial sums of the spines."""
        m, n = len(self.keys), len(self.depth)
        members = np.concatenate(([0], np.cumsum(self.counts)))
        order = sorted(range(n), key=lambda k: -self.depth[k])
        children: list[list[int]] = [[] for _ in range(n)]
        for k in range(n):
            if self.parent[k] >= 0:
                children[self.parent[k]].append(k)
        above = [self.depth[p] if (p := self.parent[k]) >= 0 else -1 for k in range(n)]
        convs = [int(members[self.last[k] + 1] - members[self.first[k]]) for k in range(n)]
        smallest, leaves, below = [0] * n, [0] * n, [0] * n
        # An end that carries a child is deeper in the order than its parent, so children come first.
        spine = [self.first[k] == 0 or self.last[k] == m - 1 for k in range(n)]
        at_top = [0] * n
        for k in order:
            own = [self.least[k]] if k < m else []
            smallest[k] = min(own + [smallest[c] for c in children[k]])
            final = [c for c in children[k] if not spine[c]]
            kept = final if spine[k] else children[k]
            leaves[k] = sum(leaves[c] for c in kept) if children[k] else int(not spine[k])
            below[k] = sum(at_top[c] for c in kept)
            w = self.words[self.first[k]]
            at_top[k] = below[k] + (convs[k] - 1) * int(w[self.depth[k]] - w[above[k]] if above[k] >= 0 else w[self.depth[k]])
        out: list[list] = [[] for _ in _NAMES]

        def emit(*row) -> None:
            for column, value in zip(out, row):
                column.append(value)

        block = self.least[0]
        for k in range(n):
            if spine[k]:
                continue
            w, d = self.words[self.first[k]], self.depth[k]
            p = self.parent[k]
            for depth in range(above[k] + 1, d + 1):
                chain_top, end = depth == above[k] + 1, depth == d
                saved = below[k] + (convs[k] - 1) * int(w[d] - w[depth - 1])
                count = len(children[k]) if end else 1
                ends = hashlib.sha256(self.ids[k].encode()).hexdigest() if end and k < m else NO_ENDS
                under = chain_top and spine[p]
                parent_conv = None if under else smallest[p] if chain_top else smallest[k]
                # A parent on the spines is named by its block, side and depth.
                side = (0 if self.first[p] == 0 else 1) if under else None
                emit(smallest[k], depth, parent_conv, convs[k], count, leaves[k], saved, ends, block if under else None, side, None, None, None, None)
        self._spines(emit, block, spine, above, children, convs, smallest, leaves, below)
        return out

    def _spines(self, emit, block, spine, above, children, convs, smallest, leaves, below) -> None:
        m = len(self.keys)
        shared = -1
        for side, s in ((0, 0), (1, m - 1)):
            if side and m == 1:
                break
            at: dict[int, int] = {}
            k = s
            while k >= 0:
                for depth in range(max(0, above[k] + 1), self.depth[k] + 1):
                    at[depth] = k
                k = self.parent[k]
            if not side and m > 1:
                # Nodes of both spines; the right one repeats them without sums.
                shared = max(depth for depth, k in at.items() if self.last[k] == m - 1)
            digest, names = hashlib.sha256(), []
            for depth in range(int(self.length[s]) + 1):
                if depth:
                    digest.update(self.keys[s][(depth - 1) * DIGEST : depth * DIGEST])
                names.append(digest.copy().digest())
            w = self.words[s]
            for depth in range(int(self.length[s]) + 1):
                k, again = at[depth], bool(side) and depth <= shared
                whole = depth == self.depth[k] and not again
                emit(
                    smallest[k], depth, None, 0 if again else convs[k],
                    sum(not spine[c] for c in children[k]) if whole else 0, leaves[k] if whole else 0, below[k] if whole else 0, None,
                    block, side, names[depth], names[depth - 1] if depth else None, int(w[depth] - w[depth - 1]) if depth else 0,
                    self.ids[k] if whole and k < m else None,
                )


def _cutter(most_sequences: int, most_turns: int, most_id_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function that turns a stream of (key, id, words), sorted by key and id, into rows of nodes, block by block."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[bytes] = []
        words: list[np.ndarray] = []
        counts: list[int] = []
        least: list[int] = []
        ids: list[list[str]] = []
        turns = id_bytes = 0

        def done() -> pa.RecordBatch:
            columns = _Block(keys, words, counts, least, [",".join(i) for i in ids]).rows()
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, _TYPES)], names=_NAMES)

        for batch in batches:
            word_lists = batch.column(2)
            offsets, flat = word_lists.offsets.to_numpy(), word_lists.values.to_numpy()
            for i, (key, conv) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if keys and (id_bytes >= most_id_bytes or (key != keys[-1] and (len(keys) >= most_sequences or turns >= most_turns))):
                    yield done()
                    keys, words, counts, least, ids = [], [], [], [], []
                    turns = id_bytes = 0
                if not keys or key != keys[-1]:
                    keys.append(key)
                    words.append(flat[offsets[i] : offsets[i + 1]].astype(np.int64))
                    counts.append(0)
                    least.append(conv)
                    ids.append([])
                    turns += len(key) // DIGEST
                counts[-1] += 1
                ids[-1].append(str(conv))
                id_bytes += len(ids[-1][-1]) + 1
        if keys:
            yield done()

    return blocks


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
_TYPES = [_ARROW[field.split()[1]] for field in _PASS.split(", ")]


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the joined pieces of each node, from a stream sorted by node and first id; holds one state."""
    current, state = None, None
    found: list[tuple[bytes, str]] = []
    for batch in batches:
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if node != current:
                if state is not None:
                    found.append((current, state.hexdigest()))
                current, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(found) >= 4096:
            yield _ends(found)
            found = []
    if state is not None:
        found.append((current, state.hexdigest()))
    if found:
        yield _ends(found)


def _ends(found: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found])], names=["node", "ends"])


def trie(convs: DataFrame, block_sequences: int = BLOCK_SEQUENCES, block_turns: int = BLOCK_TURNS, block_id_bytes: int = BLOCK_ID_BYTES) -> DataFrame:
    """One row per node of the trie over `convs` (id, turns: structs of digest and words).

    The bounds of a block only set what a task holds at a time; the result is the same for all.
    """
    cut = _cutter(block_sequences, block_turns, block_id_bytes)
    digests = F.concat(F.lit(b"").cast("binary"), F.aggregate("turns", F.lit(b"").cast("binary"), lambda acc, t: F.concat(acc, t["digest"])))
    flat = materialise(convs.select(digests.alias("key"), "id", F.col("turns.words").alias("words")), "sequences")
    passed = flat.repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInArrow(cut, _PASS)
    passed = materialise(passed, "forests")
    final = passed.where("node IS NULL")
    spines = passed.where("node IS NOT NULL")

    # Merge the spine nodes of all blocks.
    merged = spines.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.min("conv_id").alias("least"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("final_children"), F.min(F.struct("block", "side")).alias("owner"),
    )
    merged = materialise(merged, "merged")
    spine_children = merged.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("spine_children"))
    pieces = spines.where("ids IS NOT NULL").select("node", "conv_id", "ids")
    # Pieces are whole blocks of members, so the least id of a piece orders it among the pieces of its node.
    first_id = F.split_part("ids", F.lit(","), F.lit(1)).cast("long")
    pieces = pieces.select("node", first_id.alias("first_id"), "ids")
    ends = pieces.repartition("node").sortWithinPartitions("node", "first_id").mapInArrow(_hashed_ends, "node binary, ends string")
    known = merged.join(spine_children, "node", "left").join(ends, "node", "left").select(
        "node", "parent", "depth", "words", "least", "n_convs", "owner", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends"),
        (F.col("final_children") + F.coalesce("spine_children", F.lit(0))).alias("n_children"),
    )
    known = materialise(known, "spine_nodes")

    # Sums over subtrees: along each spine from its end, each merged node counted by its owner.
    own = F.struct("block", "side") == F.col("owner")
    path = spines.select("block", "side", "node", F.col("n_leaves").alias("part_leaves"), F.col("saved_tokens").alias("part_saved")).join(
        known.select("node", "depth", "owner", "n_convs", "n_children", "words"), "node"
    )
    path = path.withColumns(
        {
            "leaves": F.col("part_leaves") + F.when(own & (F.col("n_children") == 0), 1).otherwise(0),
            "saved": F.col("part_saved") + F.when(own, (F.col("n_convs") - 1) * F.col("words")).otherwise(0),
        }
    )
    upward = Window.partitionBy("block", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = path.withColumns({"leaves": F.sum("leaves").over(upward), "saved": F.sum("saved").over(upward)})
    sums = sums.groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    parents = known.select(F.col("node").alias("parent"), F.col("least").alias("parent_conv_id"))
    spine_nodes = known.join(sums, "node").join(parents, "parent", "left").selectExpr(
        "least AS conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends AS ends_sha256"
    )

    names = [field.split()[0] for field in NODE.split(", ")]
    inner = final.where("block IS NULL").select(*names)
    # The parent lies one turn above, on a spine of the block that the row left.
    above = spines.join(known.select("node", "least"), "node").select("block", "side", (F.col("depth") + 1).alias("depth"), "least")
    under = final.where("block IS NOT NULL").join(above, ["block", "side", "depth"]).withColumn("parent_conv_id", F.col("least")).select(*names)
    return inner.unionByName(under).unionByName(spine_nodes.select(*names))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    return trie(rebuilt(sequences(turns)))
