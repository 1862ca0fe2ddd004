from pyspark.sql import functions as F

from cellsight.llm import ngram_lm


def test_texts_are_scored_once_whatever_the_filter_size(spark, make_docs, odd_rows, monkeypatch):
    docs = make_docs(odd_rows)
    whole = sorted(tuple(r) for r in ngram_lm.score_texts(docs).fillna(-1).collect())
    labels, write = [], ngram_lm.materialise
    monkeypatch.setattr(ngram_lm, "materialise", lambda df, label: labels.append(label) or write(df, label))
    monkeypatch.setattr(ngram_lm, "SLICE_BYTES", ngram_lm.PART_BYTES)
    monkeypatch.setattr(ngram_lm.Layout, "of", staticmethod(lambda n: ngram_lm.Layout(5)))
    found = sorted(tuple(r) for r in ngram_lm.score_texts(docs).fillna(-1).collect())
    assert labels.count("scores") == 1
    assert [r[:5] for r in found] == [r[:5] for r in whole]


def test_units_change_nothing(spark, make_docs, odd_rows, monkeypatch):
    docs = make_docs(odd_rows * 4)
    monkeypatch.setattr(ngram_lm.Layout, "of", staticmethod(lambda n: ngram_lm.Layout(3)))

    def scores():
        rows = ngram_lm.score_texts(docs).withColumns({c: F.round(c, 9) for c in ("base_score", "score")})
        return sorted(tuple(r) for r in rows.fillna(-1).collect())

    whole = scores()
    monkeypatch.setattr(ngram_lm, "UNIT_BYTES", 2_000)
    assert scores() == whole
    monkeypatch.setattr(ngram_lm, "HEAD_WORDS", 40)
    assert scores() == whole
