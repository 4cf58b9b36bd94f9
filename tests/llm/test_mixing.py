import hashlib
import math

import pytest

from bourseflow.llm.mixing import Settings, mixed, rates, with_counts

from tests.llm.fixtures import awkward, docs_of, words


def quantile(u, rate):
    p = cdf = math.exp(-rate)
    k = 0
    while cdf <= u:
        k += 1
        p *= rate / k
        cdf += p
    return k


def brute(rows, s):
    n, of = {}, {}
    for i, _, _, source in rows:
        n[source] = n.get(source, 0) + 1
    weights = {k: 1.0 for k in n} if s.weights is None else {k: s.weights.get(k, 0.0) for k in n}
    for i, _, _, source in rows:
        rate = s.epochs * weights[source] / sum(weights.values()) * len(rows) / n[source]
        parts = max(1, math.ceil(rate / 64))
        of[i] = sum(quantile(int(hashlib.md5(f"{s.seed}|{i}|{j}".encode()).hexdigest()[:13], 16) / 2**52, rate / parts) for j in range(1, parts + 1))
    return of


@pytest.mark.parametrize("s", [Settings(), Settings(epochs=2.5, seed=1), Settings(weights={"a": 1.0, "b": 3.0, None: 1.0})])
def test_counts_as_brute_force(spark, s):
    rows = [(i, words(i, 5), "en", ("a", "a", "a", "b", None)[i % 5] if i < 400 else "rare") for i in range(402)]
    docs = docs_of(spark, rows)
    want = brute(rows, s)
    assert {r.doc_id: r.copies for r in with_counts(docs, s).collect()} == want
    out = mixed(docs, s).collect()
    assert len(out) == sum(want.values()) and [r.order_key for r in out] == sorted(r.order_key for r in out)
    assert sorted((r.doc_id, r.copy) for r in out) == sorted((i, k) for i, n in want.items() for k in range(1, n + 1))


def test_shares_meet_the_target(spark):
    docs = docs_of(spark, [(i, "x", "en", "big" if i % 10 else "small") for i in range(4000)])
    got = {r.source: r["count"] for r in mixed(docs).groupBy("source").count().collect()}
    assert abs(got["big"] - 2000) < 200 and abs(got["small"] - 2000) < 250
    assert {r.source: r.rate for r in rates(docs, Settings()).collect()} == pytest.approx({"big": 2000 / 3600, "small": 5.0})


def test_awkward_rows(spark):
    docs = awkward(spark)
    out = mixed(docs, Settings(epochs=3.0))
    assert out.columns == [c for c in docs.columns if c not in ("rate", "copies")] + ["copy", "order_key"]
    assert out.count() > 13 and mixed(docs.limit(0)).count() == 0
    assert mixed(docs, Settings(weights={})).count() == 0
