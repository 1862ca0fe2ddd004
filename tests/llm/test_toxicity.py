"""Multiple-instance scores against a plain Python version, gradients against differences, held-out accuracy."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cellsight.llm import queries, toxicity
from cellsight.llm.common import Chunk

BAD = ["grozzle", "fimp", "snarkwad"]
LABELS = "doc_id long, toxic int, quality int, text string, score double"


def chunk_of(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    return Chunk(pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], names=["_text"]), data, np.concatenate(([0], np.cumsum([len(r) for r in raw]))))


def plain_sentences(text):
    """Spans of sentences and their distinct trimmed words."""
    raw = text.encode()
    out, open_ = [], None
    for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw):
        if open_ and (raw[open_[1] - 1] in b".!?" or re.search(rb"[\n\r]", raw[open_[1] : m.start()]) or len(open_[2]) == toxicity.SENTENCE_WORDS):
            out.append(open_)
            open_ = None
        if open_ is None:
            open_ = [m.start(), m.end(), []]
        open_[1] = m.end()
        open_[2].append(bytes(b + 32 if 65 <= b <= 90 else b for b in m.group()).strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
    return [(a, b, {w for w in words if w}) for a, b, words in out + ([open_] if open_ else [])]


def test_sentences_and_features_against_plain_python():
    texts = ["One two. Three, four!\nFive five FIVE", "", " \t ", "é日本 x. ... -- y", "a " * 200, "end.\r\n(next) 'word'"]
    found = toxicity.split(chunk_of(texts))
    spans = [(r, a, b) for r, t in enumerate(texts) for a, b, _ in plain_sentences(t)]
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    assert [(r, a - offsets[r], b - offsets[r]) for r, a, b in zip(found.rows, found.starts, found.ends)] == spans
    words = [w for t in texts for _, _, w in plain_sentences(t)]
    counts = np.zeros(len(spans), dtype=int)
    for at, _ in found.word_buckets:
        counts += np.bincount(found.word_sentence[at], minlength=len(spans))
    assert counts.tolist() == [sum(1 + sum(len(w) > n for n in toxicity.BEGINNINGS) for w in ws) for ws in words]
    # Equal words have equal buckets wherever they stand.
    one, two = (toxicity.split(chunk_of([t])).word_buckets for t in ("Grozzle", "x. ,GROZZLE!"))
    assert set(one[0][1]) <= set(two[0][1])


def test_noisy_or_of_the_sentences():
    model = toxicity.Model(np.random.default_rng(3).normal(size=1 << toxicity.BUCKET_BITS).astype(np.float32), -1.0)
    texts = ["a b. c d. e", "", "f g"]
    scores, found, p = model.scores(chunk_of(texts))
    for row in range(3):
        clean = math.prod(1 - p[found.rows == row]) if (found.rows == row).any() else 1 / (1 + math.exp(-1.0))
        expected = 1 - clean if (found.rows == row).any() else 1 / (1 + math.exp(1.0))
        assert math.isclose(scores[row], expected, rel_tol=1e-9)
    alone = [model.scores(chunk_of([s]))[0][0] for s in ("a b.", "c d.", "e")]
    assert math.isclose(scores[0], 1 - math.prod(1 - a for a in alone), rel_tol=1e-9)


@pytest.mark.parametrize("label", [0, 1])
def test_step_follows_the_gradient_of_the_text_loss(label, monkeypatch):
    """One step from zero weights moves the bias against the numeric derivative of the noisy-or loss."""
    monkeypatch.setattr(toxicity, "LEAST_TEXTS", 1)
    bag = (np.array([0, 0, 1, 2]), np.array([5, 6, 5, 7]), label)
    model = toxicity.fit([bag], epochs=1)

    def loss(bias, w):
        z = np.array([bias + w[5] + w[6], bias + w[5], bias + w[7]])
        free = np.logaddexp(0, z).sum()
        return free if label == 0 else -np.log(-np.expm1(-free))

    zero, h = {5: 0.0, 6: 0.0, 7: 0.0}, 1e-6
    start = toxicity._START_BIAS
    slope = (loss(start + h, zero) - loss(start - h, zero)) / (2 * h)
    moved = toxicity.RATE * slope / math.sqrt(1e-2 + slope**2)
    assert math.isclose(model.bias, start - moved, rel_tol=1e-5)
    for k in zero:
        up, down = dict(zero), dict(zero)
        up[k], down[k] = h, -h
        slope = (loss(start, up) - loss(start, down)) / (2 * h)
        pace = toxicity.RATE / math.sqrt(1e-2 + slope**2)
        expected = -math.copysign(max(abs(pace * slope) - pace * toxicity.PENALTY, 0), slope)
        assert math.isclose(model.weights[k], expected, rel_tol=1e-4, abs_tol=1e-9)


def invented(n, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(n):
        toxic = int(i % 3 == 0)
        sentences = [" ".join(rng.choice(words, 8)) + "." for _ in range(int(rng.integers(2, 9)))]
        if toxic:
            at = int(rng.integers(len(sentences)))
            sentences[at] = f"you {BAD[int(rng.integers(3))]} " + sentences[at]
        rows.append((i, " ".join(sentences), toxic))
    return rows


def test_learns_from_labels_of_texts_and_locates_the_sentence(spark, make_docs):
    rows = invented(900)
    docs = make_docs([(i, t, "a") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y, None, "t", 0.1) for i, _, y in rows] * 2, LABELS)
    model = toxicity.train(docs, labels)
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert np.mean([found[i]["predicted"] == y for i, y in held]) >= 0.98
    texts = {i: t for i, t, _ in rows}
    hits = toxicity.offending_sentences(docs, model).collect()
    assert len(hits) >= 270
    right = [any(b in r["sentence"] for b in BAD) for r in hits]
    assert np.mean(right) >= 0.98
    for r in hits:
        assert texts[r["doc_id"]].encode()[r["first_byte"] : r["first_byte"] + r["n_bytes"]].decode() == r["sentence"]


def test_held_out_labels_teach_nothing(spark, make_docs):
    rows = invented(300, 4)
    docs = make_docs([(i, t, "a") for i, t, _ in rows])
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, None, "t", 0.1) for i, _, y in rows]
    plain = toxicity.train(docs, spark.createDataFrame([(i, y, None, "t", 0.1) for i, _, y in rows], LABELS))
    other = toxicity.train(docs, spark.createDataFrame(flip, LABELS).repartition(4))
    assert np.array_equal(plain.weights, other.weights) and plain.bias == other.bias


def test_odd_rows_empty_tables_and_sample_bound(spark, make_docs, odd_rows):
    docs = make_docs([*odd_rows, (90, "fine. " * 40_000 + "you grozzle", "a")])
    labels = spark.createDataFrame([(1, 1, 0, "", 0.0), (1, 0, 0, "", 0.0), (2, None, 0, "", 0.0), (None, 1, 0, "", 0.0), (6, 7, 0, "", 0.0)], LABELS)
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(rows) == len(odd_rows) + 1 and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["n_sentences"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    none = toxicity.train(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0
    assert toxicity.offending_sentences(docs.limit(0), none).count() == 0
    few = invented(300, 4)
    docs = make_docs([(i, t, "a") for i, t, _ in few])
    labels = spark.createDataFrame([(i, y, None, "t", 0.1) for i, _, y in few], LABELS)
    assert toxicity.train(docs, labels, sample_rows=5).fitted
    assert not toxicity.train(docs, labels, sample_bytes=1).fitted


def test_query_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = queries.op12_toxicity(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    toxic, clean = ([r["predicted"] for r in rows if r["toxic"] == y] for y in (1, 0))
    assert np.mean(toxic) >= 0.8 and np.mean(clean) <= 0.02
