"""Whitening against numpy on the distinct vectors, exact sums, and the awkward rows."""
import numpy as np
import pytest

from bourseflow.llm import whitening
from bourseflow.llm.catalog import op13_multiplicity_whitening
from tests.conftest import SMALL

ROWS = "vec_id long, embedding array<double>"


def by_hand(vectors, weights=None):
    """Deviation, eigenvalues, |whitened| of each row of `vectors`, the fit over distinct x."""
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    once, counts = np.unique(x.astype(np.int64), axis=0, return_counts=True)
    w = counts if weights == "count" else np.ones(len(once), np.int64)
    n, s = int(w.sum()), (once * w[:, None]).sum(axis=0)
    centred = once - s / n
    values, axes = np.linalg.eigh((centred * w[:, None]).T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = [int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s))) for r in x]
    return n, deviation, values, np.abs((x.astype(float) - s / n) @ axes / np.sqrt(np.maximum(values, 1e-300)))


def check(got, vectors, weights=None):
    ids = {v: i for i, v in enumerate(sorted({r.vec_id for r in got}))}
    n, deviation, values, white = by_hand(vectors, weights)
    for r in got:
        i = ids[r.vec_id]
        assert r.n == n and r.deviation == deviation[i] and r.identity_error < 1e-9
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9
        assert abs(abs(r.whitened) - white[i, r.component - 1]) < 1e-6


def test_sample_against_numpy(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    got = op13_multiplicity_whitening(spark, SMALL).collect()
    assert len(got) == 16 * len(rows)
    check(got, [r.embedding for r in rows])


@pytest.mark.parametrize("weights", ["one", "count"])
def test_copies_and_weights(spark, weights):
    rng = np.random.default_rng(5)
    distinct = rng.normal(size=(60, 5)) * [3, 2, 1, 0.5, 0.2]
    vectors = [distinct[0]] * 200 + [distinct[1]] * 7 + list(distinct)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], ROWS)
    got = whitening.components_of(df, whitening.Settings(weights=weights)).collect()
    assert len(got) == 5 * len(vectors)
    check(got, vectors, weights)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [1.0, 0.5]), (3, [-1.0, 0.25]), (4, [0.3, -2.0]), (5, [1e300, 0.0])]
    bad = [(6, None), (7, []), (8, [None, 1.0]), (9, [nan, 1.0]), (10, [inf, 0.0])]
    other = [(20, [1.0, 2.0, 3.0]), (21, [0.0, 2.5, 1.0])]
    df = spark.createDataFrame(good + bad + other, ROWS).selectExpr("*", "1 as n", "2 as component", "3 as width", "4 as x", "5 as h1", "6 as whitened")
    got = whitening.components_of(df).collect()
    assert {r.vec_id for r in got if r.width == 2} == {1, None, 3, 4, 5} and {r.vec_id for r in got if r.width == 3} == {20, 21}
    assert len([r for r in got if r.vec_id == 1]) == 2 * len([r for r in got if r.vec_id == 3])
    # two vectors have one direction only
    assert {r.component for r in got if r.width == 3} == {1}
    assert next(r.deviation for r in got if r.vec_id == 5) is None


def test_no_variance_and_empty(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], ROWS)
    assert whitening.components_of(same).count() == 0
    assert whitening.components_of(spark.createDataFrame([], ROWS)).count() == 0


def test_deviation_is_exact_beyond_doubles(spark):
    rows = [(i, [float(i * 1000 + 1), float(i)]) for i in range(3000)]
    got = {r.vec_id: r.deviation for r in whitening.components_of(spark.createDataFrame(rows, ROWS)).where("component = 1").collect()}
    n, deviation, _, _ = by_hand([v for _, v in rows])
    assert [got[i] for i in range(n)] == [d if d <= whitening.LONG else None for d in deviation] and max(deviation) > 2**53
