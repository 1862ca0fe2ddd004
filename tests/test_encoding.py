"""Sparse one-hot encoding against the dense columns and plain Python."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from cellsight.operators import clean, encoding


def test_positions_agree_with_dense_columns(spark):
    rows = [(i, "abca"[i % 4], i % 3 if i % 5 else None) for i in range(40)] + [(0, "a", None)]
    df = spark.createDataFrame(rows, "id long, `k 1` string, n long")
    dictionary = encoding.fit_dictionary(df, ["k 1", "n"])
    places = {r["position"]: (r["feature"], r["value"], r["n"]) for r in dictionary.collect()}
    assert sorted(places) == list(range(6)) and [places[i][:2] for i in range(6)] == sorted(p[:2] for p in places.values())
    assert {p[:2]: p[2] for p in places.values()} == {
        **{("k 1", v): n for v, n in Counter(r[1] for r in rows).items()},
        **{("n", str(v)): n for v, n in Counter(r[2] for r in rows if r[2] is not None).items()},
    }
    sparse = encoding.one_hot_sparse(df, dictionary, ["k 1", "n"], keep=True)
    dense = clean.one_hot(sparse, clean.fit_categories(df, ["k 1", "n"]))
    got = dense.collect()
    assert len(got) == len(rows)
    for row in got:
        assert row["positions"] == [i for i in sorted(places) if row["_".join(places[i][:2])] == 1]


def test_five_thousand_categories_one_of_them_hot(spark, tmp_path):
    df = spark.range(15_000).select(
        "id", F.expr("IF(id % 3 = 0, 'hot', concat('v', id % 4999))").alias("v"), F.expr("IF(id % 2 = 0, 'even', NULL)").alias("g")
    )
    with pytest.raises(ValueError):
        clean.fit_categories(df, ["v"])
    encoding.write_dictionary(encoding.fit_dictionary(df, ["v"]), str(tmp_path / "dictionary"))
    dictionary = encoding.read_dictionary(spark, str(tmp_path / "dictionary"))
    assert dictionary.count() == 5_000 and dictionary.agg(F.max("position")).first()[0] == 4_999
    encoded = encoding.one_hot_sparse(df, dictionary, ["v"])
    assert encoded.columns == ["id", "g", "positions"] and encoded.where("size(positions) = 1").count() == 15_000
    shares = {(r["g"], r["value"]): (r["ones"], r["share"]) for r in encoding.column_shares(encoded, dictionary, ["g"]).collect()}
    assert shares[("even", "hot")] == (2_500, pytest.approx(1 / 3)) and shares[(None, "hot")] == (2_500, pytest.approx(1 / 3))
    assert sum(ones for ones, _ in shares.values()) == 15_000
    whole = {r["value"]: r["ones"] for r in encoding.column_shares(encoded, dictionary, []).collect()}
    assert whole["hot"] == 5_000 and len(whole) == 5_000


def test_unseen_missing_and_empty(spark):
    fitted = encoding.fit_dictionary(spark.createDataFrame([("a",)], "k string"), ["k"])
    rows = spark.createDataFrame([("a", 1), ("z", 2), (None, 3)], "k string, _place long")
    got = {r["_place"]: r["positions"] for r in encoding.one_hot_sparse(rows, fitted, ["k"]).collect()}
    assert got == {1: [0], 2: [], 3: []}
    empty = rows.limit(0)
    assert encoding.fit_dictionary(empty, ["k"]).count() == 0
    assert encoding.one_hot_sparse(empty, fitted, ["k"]).count() == 0
    assert encoding.one_hot_sparse(rows, encoding.fit_dictionary(rows, []), []).where("size(positions) = 0").count() == 3
