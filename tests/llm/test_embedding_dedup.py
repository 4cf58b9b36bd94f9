import numpy as np
import pytest

from bourseflow.llm.embedding_dedup import Settings, buckets, hadamard, near_duplicates, plan


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(ids, v, cosine):
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= cosine
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        least = np.minimum(label, np.where(near, label[None, :], 2**62).min(axis=1))
        if (least == label).all():
            return near.sum(axis=1), label
        label = least


def test_transform_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(hadamard(hadamard(x)), x)


def test_links_against_brute_force(spark):
    """Recall of links of at least 0.9, none too many, on pairs close to the threshold; blocks smaller than a bucket."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 24))
    v = np.concatenate([base, np.repeat(base[:60], 3, axis=0) + rng.normal(scale=0.22, size=(180, 24)),
                        base[0] + rng.normal(scale=0.05, size=(90, 24)), base[1][None, :].repeat(20, axis=0)]).astype(np.float32)
    ids = rng.permutation(len(v)) + 1
    got = {r.vec_id: r for r in near_duplicates(table(spark, [(int(i), [float(x) for x in e], 0) for i, e in zip(ids, v)]), Settings(block=16)).collect()}
    n, label = brute(ids, v.astype(float), 0.95)
    found = np.array([got[int(i)].n_links for i in ids])
    assert (found <= n).all() and found.sum() >= 0.95 * n.sum() and n.sum() > 5000
    assert np.mean([got[int(i)].component_id == c for i, c in zip(ids, label)]) >= 0.95
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


@pytest.mark.parametrize("d, vectors", [(8, 10**9), (8, 10**10), (16, 10**9), (64, 10**9), (128, 10**10), (768, 10**9)])
def test_recall_with_the_axes_of_large_tables(d, vectors):
    """Pairs a little above the threshold, hashed as in a table of that many vectors."""
    s, hashes = plan(vectors, d, Settings())
    rng = np.random.default_rng(d)
    n = 200 if d > 200 else 600
    a, b = rng.normal(size=(2, n, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.951 * a + np.sqrt(1 - 0.951 ** 2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    x, y = buckets(a, s, hashes), buckets(b, s, hashes)
    recall = (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3)).mean()
    print(d, vectors, s.tables, hashes, recall)
    assert recall >= 0.95


def test_awkward_rows(spark):
    one, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [(1, one, 0), (2, one, 1), (2, one, 1), (3, None, 0), (4, [], 0), (5, [0.0, 0.0, 0.0], 0), (6, [1.0, None, 3.0], 0), (7, [1.0, nan, 3.0], 0),
            (8, [1.0, inf, 3.0], None), (None, one, 0), (9, [1.0, 2.0], 0), (10, [2.0, 4.0, 6.0], 0), (11, [-1.0, -2.0, -3.0], 0), (12, [1e-30, 2e-30, 3e-30], 0)]
    got = near_duplicates(table(spark, rows).selectExpr("*", "1 as id", "2 as key", "3 as weight", "4 as n_links")).collect()
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert len(got) == len(rows)
    assert by[1] == (3, 1, True) and by[2] == by[10] == by[12] == (3, 1, False)
    assert all(by[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11)) and by[None] == (0, None, True)
    assert near_duplicates(table(spark, [])).count() == 0
