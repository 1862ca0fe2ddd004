"""The conversation trie against a dictionary of all prefixes, in blocks of every size."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cellsight.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth long, block string"


def brute(rows):
    """Nodes of the trie from rows (conv_id, turn, role, text), as tuples in the order of the columns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:".encode() + role.encode() + text.encode()).digest()
            own[c].append(((turn is not None, turn or 0, digest), (role, text)))
    turns = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    whole = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(turns.get(base, [])[:h] + t[h:])
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, t in whole.items():
        ends[t].append(c)
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
            if d:
                kids[t[: d - 1]].add(t[:d])
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
    return sorted(
        (
            min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


def found(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def make(spark, rows):
    return spark.createDataFrame([(*r, "n", 7, "b") for r in rows], SCHEMA).repartition(4)


def invented(n, seed=1):
    """Conversations over few turns, so that prefixes are shared at all depths; a third are copies of one."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(0, 3 * n, 3):
        length = int(rng.integers(0, 7)) + 1
        picks = rng.integers(0, 3, length) if c % 9 else np.array([1, 1, 2, 0])
        rows += [(c, t, "user" if t % 2 else "bot", f"turn {k} of {'x ' * k}") for t, k in enumerate(picks.tolist())]
    return rows


@pytest.mark.parametrize("sequences,turns,ids", [(8192, 1 << 17, 1 << 19), (1, 1, 1), (2, 5, 9), (7, 30, 40)])
def test_blocks_of_any_size_give_the_same_trie(spark, sequences, turns, ids):
    rows = invented(250)
    convs = prefix_trie.rebuilt(prefix_trie.sequences(make(spark, rows)))
    assert found(prefix_trie.trie(convs, sequences, turns, ids)) == brute(rows)


def test_blocks_are_cut_at_their_bounds():
    keys = [bytes([k]) * 32 for k in (1, 1, 1, 2, 3, 3)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.binary()), pa.array([10, 20, 30, 40, 50, 60]), pa.array([[1]] * 6, pa.list_(pa.int32()))], names=["key", "id", "words"]
    )
    count = {bounds: len(list(prefix_trie._cutter(*bounds)(iter([batch])))) for bounds in ((9, 99, 99), (1, 99, 99), (9, 2, 99), (9, 99, 6), (9, 99, 1))}
    assert count == {(9, 99, 99): 1, (1, 99, 99): 3, (9, 2, 99): 2, (9, 99, 6): 3, (9, 99, 1): 6}


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "lost"), (0, None, "user", "first"), (0, 0, None, None), (0, 0, "user", "tie"), (0, 0, "user", "tie"), (1, 5, "a", "one"), (2, 0, "", ""),
        (2, 1, None, "é 日本"), (3, 0, "user", "x"), (-1, 0, "user", "neg"), (-21, 0, "user", "neg"), (-20, 3, "user", "base"), (-20, 4, "user", "base two"), (-23, 0, "u", "q"),
        (41, 0, "user", "w " * 60_000), (41, 1, "user", "y"), (60, 0, "user:", "a"), (61, 0, "user", ":a"), *[(80, t, "user", f"long {t}") for t in range(300)], *[(81, t, "user", f"long {t}") for t in range(300)],
    ]
    assert found(prefix_trie.conversation_trie(make(spark, rows))) == brute(rows)


def test_conversations_without_turns_are_members_of_the_root(spark):
    # One turn of its own is replaced by the head of an absent conversation, so nothing is left.
    lone = next(c for c in range(101, 120) if zlib.crc32(str(c).encode()) % 4 >= 1)
    rows = [(lone, 0, "user", "gone")]
    assert found(prefix_trie.conversation_trie(make(spark, rows))) == brute(rows)
    assert len(brute(rows)) == 1 and brute(rows)[0][7] == hashlib.sha256(str(lone).encode()).hexdigest()


def test_empty_table(spark):
    assert prefix_trie.conversation_trie(make(spark, [(1, 1, "a", "b")]).limit(0)).count() == 0


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op11_trie(spark, sf_dir)) == brute(rows)
