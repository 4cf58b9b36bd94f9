import itertools
import random

from bourseflow.llm.minhash_dedup import Settings, drop_near_duplicates, near_duplicates

from tests.llm.fixtures import awkward, docs_of, words


def brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus():
    rng, rows = random.Random(3), []
    shared = words(99, 40)
    for g in range(30):
        base = words(g, 120).split()
        for copy in range(1 + g % 6):
            w = base[:]
            for _ in range(rng.choice([0, 1, 2, 4, 9])):
                w[rng.randrange(len(w))] = f"edit{rng.random()}"
            rows.append((len(rows) + 1, " ".join(w).title() if copy % 2 else " ".join(w)))
    hub = words(77, 200).split()                                  # one large group of near copies
    for k in range(60):
        w = hub[:]
        w[(k * 3) % 200] = f"edit{k}"
        rows.append((len(rows) + 1, " ".join(w)))
    rows += [(len(rows) + 1 + k, shared + " " + words(500 + k, 30)) for k in range(40)]      # a passage that many share
    return rows


def test_components_as_brute_force(spark):
    rows = corpus()
    for size, percent in ((3, 85), (5, 80)):
        got = near_duplicates(docs_of(spark, rows), Settings(shingle=size, percent=percent)).collect()
        want = brute(rows, size, percent)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.component_id == r.doc_id) for r in got)


def test_awkward_rows(spark):
    got = near_duplicates(awkward(spark), Settings(shingle=3, percent=85)).collect()
    assert len(got) == 13
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == [(58, 1, True)] and by[2] == [(58, 1, False)] * 2
    assert by[3] == by[4][:0] + [(0, 3, True)] and by[5] == [(0, 5, True)]
    assert sorted(by[None]) == [(0, None, True), (38, None, True)]
    assert by[9] == [(1, 9, True)] and by[10] == [(1, 10, True)]
    empty = near_duplicates(awkward(spark).limit(0))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "kept"] and empty.count() == 0


def test_one_of_each_group_stays(spark):
    docs = awkward(spark)
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    assert sorted(x for x in ids if x) == [1, 3, 4, 5, 7, 8, 9, 10, 11] and ids.count(None) == 2
    again = docs_of(spark, [(1, words(1, 60)), (1, words(1, 60))])
    assert drop_near_duplicates(again).count() == 1
