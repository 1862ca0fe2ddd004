"""The operators against brute force on small fixtures."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import checker
import corpus_pipeline
from cellsight.llm import components, decontaminate, embedding_dedup, hyperminhash, induced_sort, mixing, ngram_lm, paragraph_dedup, quality, queries, suffix_dedup, token_counts, warc
from cellsight.llm.common import Chunk
from cellsight.session import scratch_path

TINY = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def linked(a, b):
    common = len(a & b)
    return bool(a) and 100 * common >= 80 * (len(a) + len(b) - common)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    assert checker.compare(queries.QUERIES[name](spark, TINY), TINY, queries.ORACLE[name]) == ""


def test_all_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, k) for k in range(501, 540)]
    parent = list(range(600))
    for a, b in edges:
        parent[find(parent, max(find(parent, a), find(parent, b)))] = min(find(parent, a), find(parent, b))
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(parent, x) for x in {v for e in edges if e[0] != e[1] for v in e}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 16))
    vectors = [(int(i), [float(x) for x in base[i % 30] + rng.standard_normal(16) * 0.12 * (i % 4)]) for i in range(240)]
    vectors += [(300, vectors[0][1]), (300, vectors[0][1]), (301, [2 * x for x in vectors[0][1]]), (None, vectors[0][1]), (302, None), (303, []), (304, [0.0] * 16)]
    vectors += [(305, [float("nan")] * 16), (306, [None, 1.0]), (307, [float("inf")] * 16), (308, vectors[0][1][:8])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("node", F.lit("x"))
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.linked_vectors(df, missed=1e-6).collect()]
    unit = [None if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v) else np.array(v) / np.linalg.norm(v) for _, v in vectors]
    n, parent, links = len(vectors), list(range(len(vectors))), Counter()
    for i, j in itertools.combinations(range(n), 2):
        if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95 - 1e-12:
            links[i] += 1
            links[j] += 1
            parent[find(parent, j)] = find(parent, i)
    groups = defaultdict(list)
    for i in range(n):
        groups[find(parent, i)].append(vectors[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    want = Counter((vectors[i][0], links[i], least[find(parent, i)]) for i in range(n))
    assert Counter(x[:3] for x in got) == want
    assert all(kept == (i == c) for i, _, c, kept in got if i is not None)
    assert embedding_dedup.linked_vectors(df.where("1 = 0")).count() == 0


def test_language_model(spark, make_docs, odd_rows):
    df = ngram_lm.score_texts(make_docs(odd_rows))
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in df.collect()]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _, _ in odd_rows]
    tokens = [[*words(t), None] for _, t, _ in odd_rows]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    base = [sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t) for t in tokens]
    assert Counter(got) == Counter((r[0], h, len(t), sum(c[w] > 0 for w in t), round(b, 6)) for r, h, t, b in zip(odd_rows, held, tokens, base))
    assert ngram_lm.score_texts(make_docs([])).count() == 0


def test_language_model_slices_and_tail(spark, make_docs, odd_rows, monkeypatch):
    docs = make_docs(odd_rows)
    whole = {(r["doc_id"], r["n_tokens"], round(r["base_score"], 6)) for r in ngram_lm.score_texts(docs).collect()}
    monkeypatch.setattr(ngram_lm, "HEAD_WORDS", 40)
    monkeypatch.setattr(ngram_lm.Layout, "of", staticmethod(lambda n: ngram_lm.Layout(7)))
    monkeypatch.setattr(ngram_lm, "SLICE_BYTES", 2 * ngram_lm.PART_BYTES)
    assert {(r["doc_id"], r["n_tokens"], round(r["base_score"], 6)) for r in ngram_lm.score_texts(docs).collect()} == whole


def test_language_model_is_better_than_its_base(spark):
    s = queries.op2_language_model(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert s[0] > s[1]


def test_filter_keeps_counts():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64)
    counts = np.random.default_rng(2).integers(1, 5000, 5000)
    part = ngram_lm.build_part(np.concatenate((keys, keys)), np.concatenate((counts, counts)))
    found = ngram_lm.probe(part, np.zeros(5000, dtype=np.int64), keys)
    assert (found >= ngram_lm.levels(2 * counts)).all() and (found == ngram_lm.levels(2 * counts)).mean() > 0.95


def test_quality(spark, make_docs, odd_rows):
    scored = queries.op3_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = scored.where("held_out").join(labels, "doc_id").select(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert held >= 0.93
    docs, none = make_docs(odd_rows), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    untrained = quality.train(docs, none)
    assert {r["score"] for r in quality.score(docs, untrained).collect()} == {0.5} and quality.score(docs, untrained).count() == len(odd_rows)
    assert quality.accepted(docs, untrained).columns == docs.columns and quality.accepted(docs, untrained).count() == len(odd_rows)


def test_mixing(spark, make_docs, odd_rows):
    random.seed(9)
    rows = [(i, "w " * random.randrange(0, 60), f"s{i % 7}") for i in range(400)] + [(900 + i, "w " * 30, "hot") for i in range(300)]
    for data in (rows, odd_rows):
        got = mixing.pareto_mix(make_docs(data)).toPandas()
        sizes = Counter()
        for _, t, s in data:
            sizes[s] += len(words(t))
        names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
        weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
        target, free = {}, set(names)
        total = 1.5 * sum(sizes.values())
        while free:
            level = (total - sum(target.values())) / sum(weight[s] for s in free)
            over = {s for s in free if level * weight[s] >= 2 * sizes[s]}
            for s in over or free:
                target[s] = 2 * sizes[s] if over else level * weight[s]
            free -= over or free
        assert len(got) == len(data) and (got.taken <= 2 * got["size"]).all()
        for s in names:
            mine = got[got._source.isna() if s is None else got._source == s]
            assert abs(mine.target.iloc[0] - target[s]) < 1e-6 * max(1, target[s]) and mine.source_size.iloc[0] == sizes[s]
            assert abs(mine.taken.sum() - target[s]) <= max([1, *mine["size"].tolist()]) / 2 + 1
    again = mixing.pareto_mix(make_docs(rows).repartition(11)).toPandas()
    first = mixing.pareto_mix(make_docs(rows)).toPandas()
    assert sorted(zip(again._id, again.taken)) == sorted(zip(first._id, first.taken))
    docs = make_docs(odd_rows)
    assert mixing.mixed_rows(docs).columns == [*docs.columns, "copy"] and mixing.pareto_mix(make_docs([])).count() == 0


def test_tokens(spark, make_docs, odd_rows):
    import public_tokenizers

    model = token_counts.model_bytes(public_tokenizers.path(queries.TOKENIZER))
    counter = token_counts.PrefixCounter(model)
    odd = ["a  b", "  a", " ", "", "a\nb", "\n", "a \n b", "▁x", "<s>a</s>", "a\tb", "日本語", " \n", "😀😀 😀", "a\x00b", *[t for _, t, _ in odd_rows if t and len(t) < 800]]
    for text in odd:
        want = [len(counter.library.encode(text[:i])) for i in range(len(text) + 1)]
        assert counter.prefixes(text) == want
        for limit in (0, 1, 5, 40):
            assert counter.cut(text.encode(), limit) == max(i for i, c in enumerate(want) if c <= limit)
    docs = make_docs(odd_rows)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs, model, limit=50).collect())
    n = lambda t: len(counter.library.encode(t or ""))
    assert got == Counter((i, len((t or "").encode()), n(t), n(t) > 50) for i, t, _ in odd_rows)
    stored = token_counts.longest_within(token_counts.prefix_table(docs.where("doc_id = 1"), model), "20").first()
    assert stored["fits"] == max(i for i, c in enumerate(stored["counts"]) if c <= 20) and token_counts.count_tokens(make_docs([]), model).count() == 0


def test_tokens_of_long_texts_come_from_prefix_tables():
    import random
    import time

    import public_tokenizers

    counter = token_counts.PrefixCounter(token_counts.model_bytes(public_tokenizers.path(queries.TOKENIZER)))
    library, draw = counter.library, random.Random(5)
    for _ in range(300):
        text = "".join(draw.choice("ab the▁▁ \n\té語🙂.ing") for _ in range(draw.randint(0, 40)))
        want = [len(library.encode(text[:i])) for i in range(len(text) + 1)]
        assert counter.prefixes(text) == want and counter.count(text.encode()) == want[-1]
    for text in ("word ▁ block text of some length " * 32_000, "x" * 300_000, "▁" * 300_000):
        started = time.time()
        at = counter.cut(text.encode(), 4096)
        assert time.time() - started < 5  # linear, whatever signs the text holds
        assert counter.count(text.encode()) == len(library.encode(text))
        assert len(library.encode(text[:at])) <= 4096 < len(library.encode(text[: at + 1]))


def test_seeds_miss_nothing():
    masks = [sum(1 << p for p in m) for m in decontaminate.MASKS]
    for wrong in itertools.combinations(range(decontaminate.WINDOW), 3):
        good = sum(1 << p for p in range(decontaminate.WINDOW) if p not in wrong)
        assert any(good & (m << s) == m << s for m in masks for s in range(decontaminate.WINDOW) if (m << s) < 1 << decontaminate.WINDOW)


def substitutions(n):
    """All sets of places in n words that may differ with 80 % equal words."""
    return [c for k in range(n + 1) if (n - k) * 100 >= n * 80 for c in itertools.combinations(range(n), k)]


def test_seeds_miss_nothing_at_any_length():
    for n in range(1, decontaminate.WINDOW + 1):
        for wrong in substitutions(n):
            places = [{s + p for p in m} for m in decontaminate.masks_of(n) for s in range(n - m[-1])]
            assert any(not p & set(wrong) for p in places), (n, wrong)


def test_decontamination_by_short_items(spark, make_docs):
    items = {n: [f"q{n}x{i}" for i in range(n)] for n in range(1, decontaminate.WINDOW)}
    rows, want = [], set()
    for n, item in items.items():
        for wrong in substitutions(n):
            rows.append((len(rows), " ".join(["before", *["other" if i in wrong else w for i, w in enumerate(item)], "after"]), "a"))
            want.add((rows[-1][0], n, n - len(wrong), 1))
        # One word too many differs.
        most = max(map(len, substitutions(n)))
        rows.append((len(rows), " ".join(["before", *["other"] * (most + 1), *item[most + 1 :], "after"]), "a"))
    rows.append((len(rows), "q1x0 " * 400, "a"))
    want.add((rows[-1][0], 1, 1, 0))
    bench = spark.createDataFrame([(n, " ".join(item)) for n, item in items.items()], "item_id long, text string")
    found = decontaminate.contaminated(make_docs(rows), bench).collect()
    assert {(r["doc_id"], r["item_id"], r["n_equal"], r["doc_word"]) for r in found} == want


def test_decontamination(spark, make_docs, odd_rows):
    random.seed(4)
    item = [f"q{i}" for i in range(40)]
    noise = lambda n: [f"z{random.randrange(10**6)}" for _ in range(n)]
    changed = list(item)
    for k in (2, 9, 16, 23, 30, 37):
        changed[k] = "other"
    rows = [
        (101, " ".join([*noise(50), *item, *noise(50)]), "a"), (102, " ".join([*noise(70), *changed]).upper(), "a"), (103, " ".join(noise(300)), "a"),
        (104, " ".join([*noise(5), *item[10:26], *noise(30)]), "b"), (105, " ".join([*noise(5), *item[:9], *noise(30)]), "b"), (None, " ".join(item), None), *odd_rows,
    ]
    bench = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (8, None), (9, ""), (10, "a b c"), (None, " ".join(noise(20)))], "item_id long, text string")
    docs = make_docs(rows)
    got = {(r["doc_id"], r["item_id"], r["n_equal"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(101, 7, 15), (102, 7, 13), (104, 7, 15), (None, 7, 15)}
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 4
    assert decontaminate.contaminated(make_docs([]), bench).count() == 0 and decontaminate.contaminated(docs, bench.where("1 = 0")).count() == 0


def pieces_of(text):
    """Paragraphs of one text, cut word by word: (start byte, byte count, words)."""
    raw = (text or "").encode()
    chunk = Chunk(None, np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
    starts, ends, one = chunk.words()
    if not len(starts):
        return []
    ranks = paragraph_dedup.border_ranks(chunk, starts, ends, one, chunk.word_hashes()[0]).tolist()
    reach, n = paragraph_dedup.REACH, len(ranks)
    borders = [0]
    for j in range(reach + 1, n - reach):
        if ranks[j] < min(ranks[j - reach : j]) and ranks[j] <= min(ranks[j + 1 : j + 1 + reach]):
            borders.append(j)
    return [(int(starts[x]), int(ends[y - 1] - starts[x]), raw[starts[x] : ends[y - 1]].lower().split()) for x, y in itertools.pairwise([*borders, n])]


def paragraphs_by_force(rows, least_words):
    cut = [(text, k, piece) for text, (_, t, _) in enumerate(rows) for k, piece in enumerate(pieces_of(t))]
    sets = [shingles(b" ".join(piece[2]).decode(), 5) for _, _, piece in cut]
    parent = list(range(len(cut)))
    for a, b in itertools.combinations(range(len(cut)), 2):
        if linked(sets[a], sets[b]):
            parent[find(parent, b)] = find(parent, a)
    groups = defaultdict(list)
    for k in range(len(cut)):
        groups[find(parent, k)].append(k)
    repeated = {(cut[k][0], cut[k][1]): (g, cut[k]) for g in groups.values() if len(g) > 1 for k in g}
    want = Counter()
    for (text, k), (g, (_, _, (start, size, tokens))) in repeated.items():
        low, high = k, k
        while (text, low - 1) in repeated:
            low -= 1
        while (text, high + 1) in repeated:
            high += 1
        length = sum(len(repeated[text, x][1][2][2]) for x in range(low, high + 1))
        if length >= least_words:
            kept = min(((rows[cut[m][0]][0], cut[m][1]) for m in g), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
            want[rows[text][0], k, start, size, len(tokens), length, kept, len(g)] += 1
    return want


def found_paragraphs(df):
    return Counter((r["doc_id"], r["paragraph"], r["start_byte"], r["n_bytes"], r["n_words"], r["passage_words"], (r["kept_doc_id"], r["kept_paragraph"]), r["component_size"]) for r in df.collect())


def test_paragraphs(spark, make_docs, monkeypatch):
    random.seed(6)
    line = lambda n: [f"v{random.randrange(400)}" + random.choice(["", "", "", "", "", ".", "!"]) for _ in range(n)]
    shared = [line(random.randrange(12, 90)) for _ in range(12)]
    rows = []
    for i in range(60):
        edited = [w if random.random() > 0.01 else "edit" for w in random.choice(shared)]
        # The passage stands between other words, in a line of its own or inside a longer one.
        gap = random.choice([" ", "\n"])
        rows.append((i, "\n".join([" ".join(line(random.randrange(1, 20))), " ".join(line(random.randrange(1, 40))) + gap + " ".join(edited) + gap + " ".join(line(random.randrange(1, 40)))]), "a"))
    rows += [(None, rows[0][1], None), (5, None, None), (6, "", "x"), (8, " \n ", "x"), (7, rows[3][1], "a"), (7, rows[3][1], "a"), (9, "one two\nthree", "b"), (10, "and " * 300, "b")]
    rows += [(11, "Of " + "and " * 300 + "end", "b"), (12, "One two\tthree", "b")]
    for least in (1, paragraph_dedup.MIN_WORDS):
        want = paragraphs_by_force(rows, least)
        got = paragraph_dedup.repeated_paragraphs(make_docs(rows), min_words=least)
        assert found_paragraphs(got) == want and len(want) > 60
    monkeypatch.setattr(queries, "table", lambda *_: make_docs(rows))
    assert found_paragraphs(queries.op7_paragraphs(spark, "")) == want
    every = paragraph_dedup.repeated_paragraphs(make_docs(rows), min_words=1).collect()
    assert sum(not r["removed"] for r in every) == len({(r["kept_doc_id"], r["kept_paragraph"]) for r in every})
    assert paragraph_dedup.repeated_paragraphs(make_docs([])).count() == 0


def test_paragraphs_inside_longer_lines(spark, make_docs, monkeypatch):
    """A passage of 60 words inside a line is found in every text, a line of common words in none."""
    random.seed(16)
    word = lambda: "".join(random.choices("abcdefgh", k=6)) + random.choice(["", "", "", "", "", "", "", "", "."])
    passages = [" ".join(word() for _ in range(60)) for _ in range(60)]
    rows = [(2 * k + j, " ".join([*(word() for _ in range(30)), p, *(word() for _ in range(30))]), "a") for k, p in enumerate(passages) for j in range(2)]
    rows += [(1000 + k, " ".join(word() for _ in range(40)) + "\nHome\nThis work is licensed under the general terms\n" + " ".join(word() for _ in range(40)), "b") for k in range(60)]
    found = {r["doc_id"] for r in paragraph_dedup.repeated_paragraphs(make_docs(rows)).collect()}
    assert len(found) >= 0.95 * 120 and max(found) < 1000
    monkeypatch.setattr(paragraph_dedup, "_PIECES", 1 << 9)
    long = " ".join(word() for _ in range(60_000))
    got = paragraph_dedup.repeated_paragraphs(make_docs([(1, "Before it " + long, "a"), (2, long + " after", "a")])).collect()
    assert sum(r["n_words"] for r in got) > 119_800


def test_induced_sort():
    rng = np.random.default_rng(1)
    for trial in range(120):
        text = rng.integers(1, rng.integers(2, 6), rng.integers(1, 200)).astype(np.uint8)
        if trial % 3 == 0:
            text = np.concatenate((text, text[: len(text) // 2], text[len(text) // 3 :]))
        raw, length = bytes(text), int(rng.integers(1, 12))
        count = Counter(raw[i : i + length] for i in range(len(raw) - length + 1))
        want = [i <= len(raw) - length and count[raw[i : i + length]] > 1 for i in range(len(raw))]
        for memory, base in ((1 << 20, 1 << 20), (64, 4)):  # in memory; spilled and recursive
            assert induced_sort.repeated_positions(text, length, memory, base).tolist() == want


def test_sorted_marks_do_not_depend_on_batches():
    random.seed(2)
    rows = sorted((random.randrange(6), random.randrange(4), i, i, 1) for i in range(60))
    names = ["key", "stretch", "_row", "start", "more"]

    def marks(size):
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[k : k + size]]) for k in range(0, len(rows), size)]
        return sorted((r["kind"], r["key"], r["_row"] if r["kind"] == 0 else -1) for b in suffix_dedup._sorted_marks(iter(batches)) for r in b.to_pylist())

    assert all(marks(size) == marks(1000) for size in (1, 2, 3, 7))


def removed_by_force(texts, length=200):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(gone)
    return out


def test_suffixes(spark, make_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4000)
    random.seed(8)
    noise = lambda n: "".join(random.choice("abcdefgh \n") for _ in range(n))
    shared = noise(600)
    rows = [*odd_rows, *[(200 + i, noise(150) + shared[i * 9 : 420 + i * 7] + noise(90), "s") for i in range(20)], (300, shared, "t"), (301, "ab" * 300, "t")]
    texts = [(t or "").encode() for _, t, _ in rows]
    want = Counter()
    for (i, _, _), t, gone in zip(rows, texts, removed_by_force(texts)):
        rest = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for k, _ in itertools.groupby(gone) if k)
        want[(i, len(t), sum(gone), spans, hashlib.sha256(rest).hexdigest())] += 1
    docs = make_docs(rows)
    assert Counter(tuple(r) for r in suffix_dedup.removal_report(docs).collect()) == want
    cut = suffix_dedup.without_repeats(docs, chars_col="n_chars")
    assert cut.columns == docs.columns and cut.where("doc_id = 8").first()["n_chars"] <= len(rows[10][1])
    assert {r["doc_id"] for r in cut.where("doc_id IN (3, 4, 5, 6)").collect()} == {3, 4, 5, 6}
    assert suffix_dedup.removal_report(make_docs([])).count() == 0


def test_suffixes_of_an_anchor_beyond_a_shard(spark, make_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 8000)
    sorted_bytes, stretches = [], suffix_dedup._stretches

    def spied(texts, marks):
        parts = stretches(texts, marks)
        sorted_bytes.extend(r[1] for r in parts.groupBy("key").agg(F.sum(F.length("part"))).collect())
        return parts

    monkeypatch.setattr(suffix_dedup, "_stretches", spied)
    random.seed(21)
    noise = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    line, sides = noise(150), [noise(90) for _ in range(3)]
    rows = [(i, noise(200) + line + noise(200), "s") for i in range(150)]
    # Some share a neighbour on one side, some hold a whole copy.
    rows += [(200 + i, noise(200) + sides[i % 3] + line + noise(200), "s") for i in range(12)]
    rows += [(300 + i, noise(200) + line + sides[i % 3][: 40 + i] + noise(200), "s") for i in range(12)]
    rows += [(400 + i, rows[i % 2][1], "s") for i in range(4)]
    texts = [t.encode() for _, t, _ in rows]
    want = Counter((r[0], len(t), sum(gone)) for r, t, gone in zip(rows, texts, removed_by_force(texts)))
    assert Counter(tuple(r)[:3] for r in suffix_dedup.removal_report(make_docs(rows)).collect()) == want
    assert max(sorted_bytes, default=0) <= 8000 and sum(n for _, _, n in want) > 12 * 200


def test_equal_windows_do_not_depend_on_batches():
    random.seed(5)
    rows = sorted((random.randrange(4), random.randrange(9), i, i) for i in range(60))
    count = Counter(r[:2] for r in rows)
    names = ["key", "window", "_row", "start"]
    for size in (1, 2, 3, 7, 1000):
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[k : k + size]]) for k in range(0, len(rows), size)]
        got = sorted(r["_row"] for b in suffix_dedup._equal_windows(iter(batches)) for r in b.to_pylist())
        assert got == sorted(r[2] for r in rows if count[r[:2]] > 1)


def test_hyperminhash(spark, make_docs, odd_rows):
    random.seed(12)
    base = [f"t{random.randrange(500)}" for _ in range(300)]
    near = [(400 + i, " ".join(w if random.random() > i / 1500 else f"e{random.randrange(99)}" for w in base), "n") for i in range(60)]
    for rows in (odd_rows, near):
        sets = [shingles(t, 4) for _, t, _ in rows]
        parent = list(range(len(rows)))
        for a, b in itertools.combinations(range(len(rows)), 2):
            if linked(sets[a], sets[b]):
                parent[find(parent, b)] = find(parent, a)
        groups = defaultdict(list)
        for k, r in enumerate(rows):
            groups[find(parent, k)].append(r[0])
        least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
        docs = make_docs(rows)
        found = hyperminhash.clusters(docs).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == Counter((r[0], len(sets[k]), least[find(parent, k)]) for k, r in enumerate(rows))
        assert sum(r["first"] for r in found) == len(groups)
        kept = hyperminhash.deduplicated(docs)
        assert kept.columns == docs.columns and kept.count() == len(groups)
    assert hyperminhash.clusters(make_docs([])).count() == 0


def test_estimate_is_unbiased():
    rng = np.random.default_rng(3)
    values = np.sort(rng.choice(2**48, 3000, replace=False).astype(np.uint64))
    both = np.concatenate((values[:2000], values[1000:]))
    r = hyperminhash.registers(both, np.array([0, 2000, 4000]))
    assert abs((r[0] == r[1]).mean() - 1 / 3) < 0.1


def test_archive(spark):
    rows = [(1, "http://a/\r\nX: y", "<p>same</p>"), (4, None, "<p>same</p>"), (4, "u", "<p>same</p>"), (2, "u", None), (3, "u", ""), (None, "u", "é"), (9, "u", "é"), (10, "u", "big" * 4000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    path = scratch_path(spark, "archive")
    warc.write_archive(pages, path)
    records = warc.reconstruct(spark, path)
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.describe(records).collect())
    assert got == Counter([(1, 11, "revisit", 4), (4, 11, "response", None), (4, 11, "revisit", 4), (2, 0, "revisit", 3), (3, 0, "response", None), (None, 2, "revisit", 9), (9, 2, "response", None), (10, 12000, "response", None)])
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    for r in records.collect():
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert block == (b"" if fields[b"WARC-Type"] == b"revisit" else bytes(r["payload"])) + b"\r\n\r\n" and int(fields[b"Content-Length"]) == len(block) - 4
    small = scratch_path(spark, "archive")
    warc.write_archive(pages, small, min_bytes=3)
    assert {r["record_type"] for r in warc.describe(warc.reconstruct(spark, small)).where("payload_bytes < 3").collect()} == {"response"}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    assert corpus_pipeline.run(spark, TINY).columns == [*docs.columns, "copy"]


def test_pipeline_stages_on_odd_rows(spark, make_docs, odd_rows):
    for rows in (odd_rows, []):
        docs = make_docs(rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, TINY)
            assert out.columns[: len(docs.columns)] == docs.columns, name
            assert out.count() <= 2 * len(rows), name


def test_held_out_rule():
    table = pq.read_table(f"{TINY}/documents.parquet", columns=["doc_id"])
    assert 0 < sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in table["doc_id"].to_pylist()) < table.num_rows
