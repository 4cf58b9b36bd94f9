import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from bourseflow.llm.language import Settings, accepted, identified, learn, predict

from tests.llm.fixtures import awkward, docs_of

EN, DE = "the house of his mother is near the old river and the water was cold".split(), "das haus der mutter ist nahe dem alten fluss und das wasser war kalt".split()


def sentences(lang, n, start=0):
    bag = EN if lang == "en" else DE
    return [(start + i, " ".join(bag[(i * 7 + k * 3) % len(bag)] for k in range(12)), lang, "s") for i in range(n)]


def brute(rows, s, texts):
    """The same model with dictionaries, one text at a time."""
    langs = sorted({r[2] for r in rows})
    words = {g: Counter(w for _, t, lang, _ in rows if lang == g for w in t.lower().split()) for g in langs}

    def table(counts, most):
        total = Counter()
        for c in counts.values():
            total.update(c)
        keys = sorted((k for k in total if total[k] >= s.least_count), key=lambda k: (-total[k], k))[:most]
        size = {g: sum(counts[g][k] for k in keys) for g in langs}
        logs = {k: [math.log((counts[g][k] + s.smoothing) / (size[g] + s.smoothing * (len(keys) + 1))) for g in langs] for k in keys}
        return {k: [x - sum(v) / len(v) for x in v] for k, v in logs.items()}
    known, grams = table(words, s.words), {}
    for n in range(1, s.longest + 1):
        counts = {g: Counter() for g in langs}
        for g in langs:
            for w, c in words[g].items():
                for k in range(len(w) + 3 - n):
                    counts[g][f" {w} "[k:k + n]] += c
        grams[n] = table(counts, s.grams)

    def of(word):
        if word in known:
            return known[word]
        for n in range(s.longest, 0, -1):
            found = [grams[n][x] for k in range(len(word) + 3 - n) if (x := f" {word} "[k:k + n]) in grams[n]]
            if found:
                return [sum(x) / len(found) for x in zip(*found)]
        return [0.0] * len(langs)
    out = []
    for t in texts:
        total = [math.log(sum(r[2] == g for r in rows) / len(rows)) for g in langs]
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            total = [x + y for x, y in zip(total, of(w))]
        top = max(total)
        out.append((langs[total.index(top)], 1 / sum(math.exp(x - top) for x in total)))
    return out


def test_scores_as_brute_force(spark):
    rows = sentences("en", 40) + sentences("de", 30, 100)
    texts = [t for _, t, _, _ in rows] + ["Muttern wassers, flusses 7 hausen!", "housing mothers rivers coldest", "x", "qqqq zzzz", "ñandú über", "water wasser"]
    for s in (Settings(), Settings(words=10, grams=30), Settings(least_count=1, longest=3)):
        pred, score = learn(docs_of(spark, rows), s).scores(pa.array(texts))
        want = brute(rows, s, texts)
        assert pred == [x for x, _ in want] and score.tolist() == pytest.approx([y for _, y in want])


def test_held_out_accuracy(spark):
    docs = docs_of(spark, sentences("en", 60) + sentences("de", 60, 100))
    got = identified(docs).collect()
    assert {r.doc_id: r.held_out for r in got} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got}
    want = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.lang_pred == want[r.doc_id] and 0 <= r.score <= 1 for r in got)


def test_awkward_rows(spark):
    docs = awkward(spark).unionByName(docs_of(spark, sentences("en", 30, 1000)).selectExpr(*awkward(spark).columns[:5], "'x' as score", "1 as shard",
                                      "2 as copies", "3 as component", "4 as id", "5 as key", "6 as rate", "7 as count", "8 as version"))
    got = identified(docs).collect()
    assert len(got) == 43
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (3, 4, 5, 8))
    assert all(r.lang_pred != "und" for r in got if r.doc_id in (1, 2, 7, 9, 1000))
    left = accepted(docs, Settings(least_score=0.0))
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} & {3, 4, 5, 8} == set()
    assert identified(docs.limit(0)).count() == 0
    untaught = docs_of(spark, [(1, "a b", None, "s")])
    assert [r.lang_pred for r in predict(untaught, learn(untaught)).collect()] == ["und"]
