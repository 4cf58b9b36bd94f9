import random

import numpy as np

from bourseflow.llm.decontaminate import Settings, align, align_whole, bit_filter, clean, contaminated, passing

from tests.llm.fixtures import awkward, docs_of, words


def benches(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def smith_waterman(a, b):
    """Best local alignment score cell by cell."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_scores_as_cell_by_cell():
    rng = random.Random(2)
    for _ in range(60):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 14))]
        b = [rng.randrange(6) for _ in range(rng.randrange(1, 18))]
        matched, first, last = align(np.array(a, np.uint64), np.array(b, np.uint64))
        best = smith_waterman(a, b)
        assert best <= matched <= min(len(a), len(b)) and (best == 0) == (matched == 0)
        if best:
            # the alignment found reaches the best score on the part of b that it spans
            assert smith_waterman(a, b[first:last + 1]) == best
    assert align(np.array([1, 2, 3, 4], np.uint64), np.array([9, 1, 2, 7, 3, 4, 9], np.uint64)) == (4, 1, 5)


def edited(text, share, seed):
    rng, w = random.Random(seed), text.split()
    for k in rng.sample(range(len(w)), int(share * len(w))):
        w[k] = f"new{k}"
    return " ".join(w)


def test_copies_and_edits_are_found_and_clean_ones_left(spark):
    items = [(i, words(1000 + i, 20 + i)) for i in range(20)]
    rows, want = [], set()
    for i, t in items:
        for k, copy in enumerate((t, t.upper().replace(" ", ", "), edited(t, 0.15, i), "x " + t + " y")):
            rows.append((i * 10 + k, words(i * 10 + k, 150) + "\n" + copy + ". " + words(i * 10 + k + 5000, 80)))
            want.add((i * 10 + k, i))
    rows += [(5000 + i, words(9000 + i, 200)) for i in range(30)] + [(6000 + i, edited(t, 0.6, i)) for i, t in items]
    for s in (Settings(), Settings(filter_bits=64)):        # filters that let most n-grams pass
        got = contaminated(docs_of(spark, rows), benches(spark, items), s)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want
        assert all(r.similarity >= 0.8 for r in got.collect())
        left = {r.doc_id for r in clean(docs_of(spark, rows), benches(spark, items), s).collect()}
        assert left == {i for i, _ in rows} - {d for d, _ in want}


def test_awkward_rows(spark):
    docs = awkward(spark)
    items = benches(spark, [(1, words(1, 60)[:90]), (None, words(7, 20)), (3, None), (4, ""), (5, "one"), (6, words(1, 60)[:90])])
    got = contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(1, 1), (2, 1), (1, 6), (7, None)}
    assert sum(r.doc_id == 2 for r in got) == 4
    left = clean(docs, items)
    assert left.columns == docs.columns and not {r.doc_id for r in left.collect()} & {1, 2, 7}
    assert contaminated(docs, items.limit(0)).count() == 0 and clean(docs, items.limit(0)).count() == 13
    assert contaminated(docs.limit(0), items).count() == 0


def test_edits_near_the_ends_cost_only_the_edited_words(spark):
    items = [(k, words(3000 + k, m)) for k, m in enumerate((15, 16, 20, 33, 59))]
    rows, want = [], {}
    for k, t in items:
        w = t.split()
        m = len(w)
        for copy, kept in ((["new"] if i in (1, m - 2) else [x] for i, x in enumerate(w)), m - 2), \
                (([] if i in (1, m - 2) else [x] for i, x in enumerate(w)), m - 2), \
                (([x, "new"] if i in (0, m - 2) else [x] for i, x in enumerate(w)), m):
            want[len(rows), k] = kept
            rows.append((len(rows), " ".join([words(len(rows), 90), *sum(copy, []), words(len(rows) + 700, 90)])))
        few = int(0.2 * m) + 1                                   # one edited word too many
        rows.append((len(rows), " ".join([words(len(rows), 90), *("new" if i % 4 == 1 and i < 4 * few else x for i, x in enumerate(w)), words(len(rows) + 700, 90)])))
    got = contaminated(docs_of(spark, rows), benches(spark, items)).collect()
    assert {(r.doc_id, r.item_id): r.matched_words for r in got} == want
    assert all(r.first_word == 90 for r in got) and all(r.similarity == r.matched_words / r.item_words for r in got)
    assert clean(docs_of(spark, rows), benches(spark, items)).count() == len(items)


def test_whole_alignment_matches_no_fewer_words_than_an_edited_copy_keeps():
    rng = random.Random(5)
    for _ in range(200):
        m = rng.randrange(5, 40)
        item = [rng.randrange(30) for _ in range(m)]
        edits = set(rng.sample(range(m), rng.randrange(m // 4 + 1)))
        copy = [x if i not in edits else 99 for i, x in enumerate(item) if i not in edits or rng.random() < 0.5]
        window = [rng.randrange(30) for _ in range(9)] + copy + [rng.randrange(30) for _ in range(9)]
        matched, first, last = align_whole(np.array(item, np.uint64), np.array(window, np.uint64))
        assert m - len(edits) <= matched <= min(m, last - first + 1)
    assert align_whole(np.array([1], np.uint64), np.array([2], np.uint64)) == (0, 0, -1)
    assert align_whole(np.array([1, 2], np.uint64), np.array([], np.uint64)) == (0, 0, -1)


def test_short_items_are_found_whole_and_unbroken(spark):
    items = [(1, "the capital of"), (2, "red fox runs home"), (3, "two words"), (4, "one")]
    rows = [(1, words(1, 40) + " The capital, of. " + words(2, 40)), (2, "a red fox runs home"), (3, "a red fox runs far home"), (4, "red fox fox runs home"),
            (5, "two words one"), (6, "the capital")]
    got = contaminated(docs_of(spark, rows), benches(spark, items)).collect()
    assert {(r.doc_id, r.item_id, r.matched_words, r.similarity) for r in got} == {(1, 1, 3, 1.0), (2, 2, 4, 1.0)}
    assert {r.doc_id for r in clean(docs_of(spark, rows), benches(spark, items)).collect()} == {3, 4, 5, 6}


def test_bit_filter_lets_all_keys_pass_at_any_size(spark):
    keys = np.random.default_rng(3).integers(-2**63, 2**63 - 1, 5000)
    frame = spark.createDataFrame([(int(k),) for k in keys], "key long")
    others = np.random.default_rng(4).integers(0, 2**63 - 1, 20_000).astype(np.uint64)
    for most in (64, 1 << 15, 1 << 20):
        bits = bit_filter(frame, most)
        assert len(bits) * 8 <= most and passing(bits, keys.view(np.uint64)).all()
    assert passing(bits, others).mean() < 0.08
    assert not passing(bit_filter(frame.limit(0), 1 << 20), others).any()


def test_many_copies_of_an_item_and_repeated_words(spark):
    items = [(k, words(5, 30)) for k in range(40)] + [(99, "na " * 30)]
    rows = [(d, words(d + 50, 60) + " " + words(5, 30)) for d in range(30)] + [(100, "na " * 3000), (101, None)]
    got = contaminated(docs_of(spark, rows), benches(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, k) for d in range(30) for k in range(40)} | {(100, 99)} and len(got) == 1201
    assert all(r.first_word == 60 and r.last_word == 89 for r in got if r.doc_id < 100)
