"""Whitening against the singular values of the exactly centred distinct rows."""

import math

import numpy as np
import pytest

from cellsight.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n string"


def brute(vectors):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=np.int64)
    listed = np.unique(x, axis=0)
    n, sums = len(listed), listed.sum(axis=0)
    centred = (n * listed - sums) / n
    # Singular values of the rows, since a covariance would lose the small ones.
    _, singular, right = np.linalg.svd(centred, full_matrices=False)
    return x, n, sums, singular**2 / n, right.T


def check(rows, ids, vectors, components=16):
    x, n, sums, values, columns = brute(vectors)
    assert len(rows) == len(vectors) * components
    found = {}
    for r in rows:
        found.setdefault(r["vec_id"], {})[r["component"]] = r
    z = (n * x - sums) / n @ columns[:, :components] / np.sqrt(values[:components])
    signs = np.sign([sum(found[i][c + 1]["whitened"] * z[k, c] for k, i in enumerate(ids)) for c in range(components)])
    for k, i in enumerate(ids):
        for c in range(components):
            row = found[i][c + 1]
            assert row["n"] == n and row["deviation"] == int(((n * x[k] - sums) ** 2).sum())
            assert math.isclose(row["whitened"], signs[c] * z[k, c], rel_tol=1e-6, abs_tol=1e-7)
            assert math.isclose(row["explained"], values[c] / values.sum(), rel_tol=1e-9)
            assert row["identity_error"] < 1e-9


def test_query_against_eigenvectors(spark):
    sf_dir = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    check(queries.op13_whitening(spark, sf_dir).collect(), [r["vec_id"] for r in given], [r["embedding"] for r in given])


def test_odd_vectors_copies_and_clashing_names(spark):
    rng = np.random.default_rng(5)
    # One vector holds a third of the rows; scales differ by 1e3.
    vectors = (rng.normal(size=(60, 6)) * [100, 30, 10, 3, 1, 0.3]).astype(np.float32)
    good = [*vectors.tolist(), *[vectors[7].tolist()] * 30]
    bad = [None, [], [1.0] * 5, [None] * 6, [float("nan")] * 6, [1.0, 2.0, 3.0, 4.0, 5.0, float("inf")]]
    rows = [(i, v, 0, "x", "y") for i, v in enumerate([*good, *bad])]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    check(found, list(range(len(good))), good, 6)


def test_repeated_and_null_ids(spark):
    rows = [(1, [0.0, 1.0], 0, "", ""), (1, [1.0, 0.5], 0, "", ""), (None, [3.0, 0.0], 0, "", ""), (None, [3.0, 0.0], 0, "", "")]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 8 and {r["n"] for r in found} == {3}
    assert sorted((r["vec_id"] is None) for r in found) == [False] * 4 + [True] * 4


def test_empty_and_constant_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, "", "")] * 3, SCHEMA)).count() == 0


def test_rank_below_dimension(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-50, 50, (40, 3))
    # The last three places are sums and copies of the first, one is constant.
    vectors = np.column_stack([base, base[:, 0], base[:, 1], np.full(40, 2)]).astype(float) / 1.0
    rows = [(i, v, 0, "", "") for i, v in enumerate(vectors.tolist())]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component"] for r in found} == {1, 2, 3}
    check(found, list(range(40)), vectors.tolist(), 3)


def test_shift_is_corrected_for_ill_conditioned_rows(spark):
    rng = np.random.default_rng(2)
    turn, _ = np.linalg.qr(rng.normal(size=(5, 5)))
    vectors = rng.normal(size=(200, 5)) * [1e6, 1e4, 100, 10, 1] @ turn
    rows = [(i, v, 0, "", "") for i, v in enumerate(vectors.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, component string, n string")
    model = whitening.fit(df)
    assert 3 <= model.passes <= whitening.MOST_PASSES and model.identity_error < 1e-8
    x, n, sums, values, _ = brute(vectors)
    assert np.allclose(model.eigenvalues, values, rtol=1e-7)


@pytest.mark.parametrize("size", [1e-3, 1e15])
def test_entries_beyond_the_integers(spark, size):
    rows = [(i, [size * i, -size * i * i], 0, "", "") for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, component string, n string")
    found = whitening.whiten(df).collect()
    exact = {r["vec_id"]: r["deviation"] for r in found}
    x, n, sums, _, _ = brute([r[1] for r in rows])
    for i in exact:
        true = sum((n * int(a) - sum(map(int, x2))) ** 2 for a, x2 in zip(x[i], np.unique(x, axis=0).T.tolist()))
        assert exact[i] == (true if true < 2**63 else None)
