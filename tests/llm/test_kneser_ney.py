import math
import shutil
import zlib
from collections import Counter, defaultdict
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest

from bourseflow.llm.kneser_ney import Settings, discounts_of, language_model_scores, train

from tests.llm.fixtures import awkward, docs_of, words


def brute(rows):
    """The model with plain dictionaries."""
    texts = {i: (t or "").encode().lower().split() + ["end"] for i, t in rows}
    train = [w for i, w in texts.items() if zlib.crc32(str(i).encode()) % 10]
    c, pairs = Counter(x for w in train for x in w), Counter()
    for w in train:
        pairs.update(zip(["start", *w], w))
    a = Counter(w for _, w in pairs)
    counts = lambda x: [sum(v == k for v in x.values()) for k in (1, 2, 3, 4)]
    d, e, total, v, n = discounts_of(counts(pairs)), discounts_of(counts(a)), sum(a.values()), len(c), sum(c.values())
    mass = sum(e[min(x, 3) - 1] for x in a.values()) / total
    seen, free = Counter(), defaultdict(float)
    for (h, _), k in pairs.items():
        seen[h] += k
        free[h] += d[min(k, 3) - 1]

    def low(w):
        return (max(a[w] - e[min(a[w], 3) - 1], 0) / total if w in a else 0) + mass / (v + 1)

    def p(h, w):
        if h not in seen:
            return low(w)
        k = pairs.get((h, w), 0)
        return (max(k - d[min(k, 3) - 1], 0) / seen[h] if k else 0) + free[h] / seen[h] * low(w)
    out = {}
    for i, w in texts.items():
        out[i] = (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w),
                  sum(math.log10(p(h, x)) for h, x in zip(["start", *w], w)))
    return out, sum(p(next(iter(c)), x) for x in c) + p(next(iter(c)), "no such word")


@pytest.mark.parametrize("least_shards", [128, 2])
def test_scores_as_brute_force(spark, least_shards):
    common = "the of and to in a is that".split()
    rows = [(i, " ".join(common[(i * k) % 8] + (" " + words(i % 17, 30).split()[k % 30] if k % 3 else "") for k in range(5 + i % 90)))
            for i in range(1, 120)] + [(300 + i, "the of " * 400) for i in range(3)] + [(400, ""), (401, None), (402, "Ünder\x0bthe of THE")]
    want, whole = brute(rows)
    assert whole == pytest.approx(1.0)
    got = language_model_scores(docs_of(spark, rows), Settings(shard_rows=500, least_shards=least_shards, flush=2_000)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][3:], rel=1e-9)


def test_awkward_rows(spark):
    got = language_model_scores(awkward(spark)).collect()
    assert len(got) == 13 and all(r.score <= 0 and math.isfinite(r.score) for r in got)
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (3, 4, 5))
    assert all(r.held_out is False for r in got if r.doc_id is None)
    assert language_model_scores(awkward(spark).limit(0)).count() == 0
    nothing = [i for i in range(1, 200) if zlib.crc32(str(i).encode()) % 10 == 0][0]
    alone = language_model_scores(docs_of(spark, [(nothing, "a b")])).first()
    assert alone.held_out and alone.train_tokens == 0 and alone.score == 0


def test_missing_shard_is_an_error(spark, tmp_path):
    """Scores are never made without a part of the model; shards without rows have files of their own."""
    docs = docs_of(spark, [(i, words(i, 20)) for i in range(1, 30)])
    model = train(docs, Settings(shard_rows=50, least_shards=4))
    folder = Path(model.folder.removeprefix("file:"))
    assert len(list(folder.glob("pairs-*.npy"))) == model.shards
    elsewhere = str(tmp_path / "model")
    shutil.copytree(folder, elsewhere, ignore=shutil.ignore_patterns("pairs-1.npy"))
    with pytest.raises(FileNotFoundError):
        replace(model, folder=elsewhere).pair_counts(np.arange(10_000, dtype=np.uint64) << np.uint64(32))
    with pytest.raises(FileNotFoundError):
        replace(model, folder=str(tmp_path / "nothing")).find_ids(np.arange(4, dtype=np.uint64) << np.uint64(62))
