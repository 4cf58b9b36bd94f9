"""Scoring stages against a plain Python model."""
import statistics
from collections import defaultdict
from datetime import date

import pytest
from pyspark.sql import functions as F

from bourseflow import constants as K
from bourseflow.operators import scoring

D = date(2024, 6, 28)
LONG = "stock_id long, snapshot date, country string, family string, group_id int, metric string, factor string, raw_value double"


def long_frame(spark, rows):
    return spark.createDataFrame([(s, D, c, f, g, m, K.METRICS[m][0], v) for s, c, f, g, m, v in rows], LONG)


def test_rank_normal_ties(spark):
    df = long_frame(spark, [(i, "KR", "general", None, "book_yield", v) for i, v in enumerate((1.0, 1.0, 1.0, 1.0, 5.0))])
    p = {r.stock_id: r.p for r in scoring.rank_normal(df).collect()}
    assert p == {0: 0.4, 1: 0.4, 2: 0.4, 3: 0.4, 4: 0.9}


def test_rank_normal_single_direction_and_penalty(spark):
    rows = [(1, "KR", "general", None, "momentum", 3.0)]
    rows += [(i, "KR", "general", None, "volatility", float(i)) for i in range(5)]
    rows += [(i, "KR", "general", None, "trap_signal", float(i)) for i in range(5)]
    z = {(r.metric, r.stock_id): r.z_raw for r in scoring.rank_normal(long_frame(spark, rows)).collect()}
    assert z[("momentum", 1)] == 0.0
    assert z[("volatility", 0)] == 1.2816 and z[("volatility", 4)] == -1.2816
    assert z[("trap_signal", 4)] == 0.0 and z[("trap_signal", 0)] == -1.2816


def test_value_shrink(spark):
    df = spark.createDataFrame([(2,), (1,), (0,), (None,)], "r int").select(scoring.value_shrink(F.col("r")))
    assert [round(x[0], 6) for x in df.collect()] == [1.0, round(2 / 3, 6), round(1 / 3, 6), round(1 / 3, 6)]


def model(rows, rules, weights):
    """The whole model from raw values, written with statistics.NormalDist."""
    z, groups = {}, defaultdict(list)
    for s, c, f, g, m, v in rows:
        groups[(c, f, m)].append((s, v))
    info = {s: (c, f, g) for s, c, f, g, _, _ in rows}
    for (c, f, m), xs in groups.items():
        for s, v in xs:
            r = sum(x < v for _, x in xs) + (sum(x == v for _, x in xs) + 1) / 2
            q = statistics.NormalDist().inv_cdf((r - 0.5) / len(xs)) * K.METRICS[m][1]
            z[(s, m)] = round(min(0.0, q) if K.METRICS[m][3] else q, 4)
    adj = {}
    for (s, m), v in z.items():
        c, _, g = info[s]
        peers = [z[(t, m)] for t in info if (t, m) in z and info[t][0] == c and info[t][2] == g] if g is not None else []
        n = len(peers)
        plain = not K.METRICS[m][4] or g is None or n == 1
        adj[(s, m)] = v if plain else round(max(-3.0, min(3.0, v - n / (n + K.SHRINKAGE_K) * sum(peers) / n)), 4)
    fac = defaultdict(dict)
    for s in info:
        for f in K.FACTORS:
            xs = [(K.METRICS[m][2], adj[(s, m)]) for m in K.METRICS if K.METRICS[m][0] == f and (s, m) in adj]
            if xs:
                fac[s][f] = sum(w * v for w, v in xs) / sum(w for w, _ in xs)
        if "value" in fac[s] and rules[s] < 2:
            fac[s]["value"] *= (rules[s] + 1) / 3
    std = defaultdict(dict)
    for key in {(c, f) for c, f, _ in info.values()}:
        ids = [s for s in info if info[s][:2] == key]
        for f in K.FACTORS:
            xs = [fac[s][f] for s in ids if f in fac[s]]
            sd = statistics.stdev(xs) if len(xs) > 1 else 0.0
            for s in ids:
                if f in fac[s]:
                    std[s][f] = (fac[s][f] - statistics.fmean(xs)) / sd if sd > 0 else 0.0
    comp = {s: sum(w * std[s].get(f, 0.0) for f, w in zip(K.FACTORS, weights)) for s in info
            if info[s][1] != "financial" and {"value", "quality"} <= set(std[s]) and len(std[s]) >= 3}
    score = {}
    for s, c in comp.items():
        peers = [comp[t] for t in comp if info[t][:2] == info[s][:2]]
        n = len(peers)
        score[s] = 50.0 if n == 1 else round(100 * (n - 1 - sum(p > c for p in peers)) / n, 2)
    return adj, comp, score


def test_whole_model(spark):
    import random
    rnd = random.Random(5)
    rows, rules = [], {}
    for s in range(60):
        c = "KR" if s % 3 else "US"
        f = "financial" if s % 11 == 0 else "general"
        g = None if s % 13 == 0 else s % 4
        rules[s] = s % 3
        for m in K.METRICS:
            if rnd.random() < (0.5 if s == 7 else 0.9):
                rows.append((s, c, f, g, m, round(rnd.uniform(-1, 1), 2)))
    long = long_frame(spark, rows)
    values = scoring.neutralize(scoring.rank_normal(long)).cache()
    ids = {s: (c, f, g) for s, c, f, g, _, _ in rows}
    inputs = spark.createDataFrame([(s, D, *ids[s], rules[s]) for s in ids], "stock_id long, snapshot date, country string, family string, group_id int, value_rules int")
    scores = scoring.percentile_scores(scoring.composites(scoring.standardize(scoring.factor_table(values, inputs)))).where("preset = 'growth'")
    adj, comp, score = model(rows, rules, K.PRESETS["growth"])
    for r in values.collect():
        assert r.z_adj == pytest.approx(adj[(r.stock_id, r.metric)], abs=1.01e-4)
    for r in scores.collect():
        if r.stock_id in comp:
            assert r.composite == pytest.approx(comp[r.stock_id], abs=1e-3)
            assert r.score == pytest.approx(score[r.stock_id], abs=100 / 30)
        else:
            assert r.composite is None and r.score is None


def test_preset_problems(spark):
    good = [(p, K.PRESET_ORDER[p], False, f, w) for p, ws in K.PRESETS.items() for f, w in zip(K.FACTORS, ws)]
    schema = "preset string, sort_order int, is_default boolean, factor string, weight double"
    assert scoring.preset_problems(spark.createDataFrame(good, schema)).count() == 0
    bad = good + [("x", 9, False, f, 0.2001) for f in K.FACTORS] + [("y", 1, False, f, 0.2) for f in K.FACTORS]
    got = {r.preset: r.problem for r in scoring.preset_problems(spark.createDataFrame(bad, schema)).collect()}
    assert got == {"x": "range", "y": "sort_order", "aggressive": "sort_order"}


def test_insert_positions(spark):
    pool = spark.createDataFrame([("a", float(v)) for v in (1, 2, 2, 3)], "g string, v double")
    rows = spark.createDataFrame([(1, "a", 2.0), (2, "a", 9.0), (3, "b", 1.0)], "id int, g string, v double")
    got = {r.id: (r.less, r.equal, r.n) for r in scoring.insert_positions(rows, pool, ["g"], "v").collect()}
    assert got == {1: (1, 2, 4), 2: (4, 0, 4), 3: (0, 0, 0)}
