"""Whitening against a plain eigendecomposition in numpy, and the odd rows."""

import numpy as np
import pytest

from pagesheaf.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def check(rows, points, components=16):
    """Rows of the operator against numpy, up to the sign of a component; variances are apart in these tables."""
    x = np.array([v for _, v in points])
    once = np.unique(x, axis=0)
    n, sums = len(once), once.sum(0)
    centred = (n * once - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-9 * values[0]).sum()))
    assert len(rows) == len(points) * k
    z = (n * x - sums) / n @ vectors[:, :k] / np.sqrt(values[:k])
    got = np.zeros((len(points), k))
    place = {}
    for i, (key, _) in enumerate(points):
        place.setdefault(key, i)
    for r in rows:
        got[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[place[r.vec_id]], sums))
        assert abs(r.explained - values[r.component - 1] / values.sum()) <= 1e-9
        assert 0 <= r.identity_error <= 1e-9
    used = sorted(set(place.values()))
    signs = np.sign((got[used] * z[used]).sum(0))
    assert np.abs(got[used] * signs - z[used]).max() < 1e-6


def test_query(spark):
    points = [(r.vec_id, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in r.embedding])
              for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(queries.op11_whitening(spark, SF).collect(), points)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(60, 5)) * [5, 4, 3, 2, 1]).tolist()
    nan, inf = float("nan"), float("inf")
    rows = [(i, v, "a", 1) for i, v in enumerate(vectors)] + [(100 + i, vectors[3], "a", 1) for i in range(40)]
    rows += [(None, vectors[4], "a", 1), (7, vectors[7], "a", 1)]
    bad = [(200, None, "a", 1), (201, [1.0, None, 2.0, 3.0, 4.0], "a", 1), (202, [nan] * 5, "a", 1), (203, [1.0, inf, 0.0, 0.0, 0.0], "a", 1),
           (204, [], "a", 1), (205, [1.0, 2.0], "a", 1), (206, [1e300] * 5, "a", 1)]
    df = spark.createDataFrame(rows + bad, "vec_id int, embedding array<double>, x string, key int")
    points = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for i, v, _, _ in rows]
    check(whitening.whiten(df).collect(), points)
    check(whitening.whiten(df, components=2).collect(), points, 2)


def test_ranks_below_the_dimension(spark):
    rng = np.random.default_rng(6)
    base = np.floor(rng.normal(size=(50, 2)) * 6) @ np.array([[1, 0, 2, 1], [0, 1, 1, -3]])
    df = spark.createDataFrame([(i, v) for i, v in enumerate((base / 64).tolist())], "vec_id bigint, embedding array<double>")
    check(whitening.whiten(df).collect(), [(i, [int(c) + 1_000_000 for c in v]) for i, v in enumerate(base)])


def test_one_vector_and_no_rows(spark):
    one = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id bigint, embedding array<float>")
    assert whitening.whiten(one).collect() == [] and whitening.whiten(one.limit(0)).collect() == []
    single = spark.createDataFrame([(1, [0.5]), (2, [1.5])], "vec_id bigint, embedding array<float>")
    rows = whitening.whiten(single).collect()
    assert sorted(abs(r.whitened) for r in rows) == [1.0, 1.0] and abs(rows[0].explained - 1) < 1e-12 and rows[0].deviation == 4096


def test_deviation_beyond_64_bits(spark):
    far = [(i, [2.0 ** (30 + i % 10), float(i)]) for i in range(50)]
    rows = whitening.whiten(spark.createDataFrame(far, "vec_id bigint, embedding array<double>")).collect()
    x = {i: [int(64 * c) + 1_000_000 for c in v] for i, v in far}
    sums = [sum(v[j] for v in x.values()) for j in range(2)]
    want = {i: sum((50 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in x.items()}
    assert any(w >= 2**63 for w in want.values())
    assert all(r.deviation == (want[r.vec_id] if want[r.vec_id] < 2**63 else None) for r in rows)


@pytest.mark.parametrize("d", [1, 2, 3, 8, 33])
def test_factor_and_rotation(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d + 4, d)) * np.logspace(0, -4, d)
    scatter = a.T @ a
    factor = whitening.pivoted_cholesky(scatter)
    assert np.abs(factor @ factor.T - scatter).max() <= 1e-12 * scatter.max()
    turned = whitening.one_sided_jacobi(factor)
    norms = (turned * turned).sum(0)
    assert np.allclose(norms, np.linalg.eigvalsh(scatter)[::-1], rtol=1e-7, atol=0)
    unit = turned / np.sqrt(norms)
    assert np.abs(unit.T @ unit - np.eye(d)).max() < 1e-12
