"""The rule ledger against plain counting, policies and ablations against one document at a time."""
import re

import pytest

from bourseflow.llm import quality_rules as q
from tests.llm.fixtures import awkward, docs_of, words

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def by_hand(text):
    text = text or ""
    w = [x for x in SPACE.split(text) if x]
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    fives = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    count = {}
    for f in fives:
        count[f] = count.get(f, 0) + 1
    covered = {i + k for i, f in enumerate(fives) if count[f] > 1 for k in range(5)}
    return {"n_words": len(w), "word_chars": len(SPACE.sub("", text)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
            "n_letter_words": sum(any(c.isalpha() for c in x) for x in w)}


TEXTS = [None, "", " \t\n", "one", "a b c d e", "a b c d e a b c d e", "a b c d e f a b c d e", "a a a a a a a", "a a a a a", "x\ny\nx\nx\n \n \n",
         "a b c d e f g h i j\x0bk\x0cl\rm\n", "### $$$ <a> & b | c", "déjà vu 東京 ½ \U0001F600 naïve " * 3, "   ", words(1, 40) + " " + words(2, 9) + " " + words(1, 40),
         "1 2 3 4 5 6 7 8 9 10 11", "- one\n- two\n* three...\n- four…", words(9, 3000), "x" * 200 + " y", (words(4, 12) + "\n") * 30]


def test_measurements(spark):
    docs = docs_of(spark, list(enumerate(TEXTS)))
    got = {r.doc_id: r.asDict() for r in q.measured(docs).collect()}
    for i, text in enumerate(TEXTS):
        want = by_hand(text)
        assert {k: got[i][k] for k in want} == want, text


def verdict(bits, policy):
    never, counted = q.mask(policy.never), q.mask(policy.counted)
    return bits & never == 0 and bin(bits & counted).count("1") <= policy.most


@pytest.mark.parametrize("policy", q.POLICIES, ids=lambda p: f"v{p.version}")
def test_policies_and_ablations(spark, policy):
    rows = spark.createDataFrame([(i, b) for i, b in enumerate([0, 0, 1, 2, 3, 4, 6, 8, 128, 256, 384, 385, 64, 32, 4])], "doc_id long, fail_bits long")
    all_bits = [r.fail_bits for r in rows.collect()]
    kept = {r.doc_id for r in rows.where(q.passes(policy)).collect()}
    assert kept == {i for i, b in enumerate(all_bits) if verdict(b, policy)}
    bit = {r.name: 1 << r.bit for r in q.RULES}
    got = {r.rule: r for r in q.ablations(rows, (policy,)).collect()}
    assert set(got) == {*policy.never, *policy.counted}
    for name, r in got.items():
        without = q.Policy(0, tuple(x for x in policy.never if x != name), tuple(x for x in policy.counted if x != name), policy.most)
        failing = [b for b in all_bits if b & bit[name]]
        together = 0
        for b in failing:
            together |= b
        assert (r.documents, r.kept, r.failed, r.fails_with) == (len(all_bits), len(kept), len(failing), together)
        assert r.sole == sum(not verdict(b, policy) and verdict(b, without) for b in all_bits)


def test_judged_and_accepted(spark):
    docs = docs_of(spark, [(1, words(1, 60)), (2, "few words"), (3, "a b c d e " * 9), (4, " ".join(x + "###" for x in words(5, 50).split())), (5, None)])
    got = {r.doc_id: r for r in q.judged(docs).collect()}
    assert {i: (r.base_failed, r.kept) for i, r in got.items()} == {
        1: (False, True), 2: (True, False), 3: (True, False), 4: (False, False), 5: (True, False)}
    assert got[4].sole_rule == "symbols" and got[4].readmitted == 1 and got[1].sole_rule is None
    kept = q.accepted(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]
    assert sorted(r.doc_id for r in q.accepted(docs, q.POLICIES[0]).collect()) == [1, 4]


def test_awkward_rows(spark):
    docs = awkward(spark).selectExpr("*", "'n' as n_words", "0 as fail_bits", "1 as kept", "2 as policy", "3 as sole_rule", "4 as readmitted")
    got = q.judged(docs).collect()
    assert len(got) == docs.count() and sum(r.doc_id is None for r in got) == 2
    long = next(r for r in got if r.doc_id == 7)
    assert long.n_words == 200_000
    kept = q.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert q.judged(docs.limit(0)).count() == 0 and q.accepted(docs.limit(0)).count() == 0


def test_stored_ledger_of_two_runs(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    for run, n in (("a", 40), ("b", 5), ("b", 12)):
        q.write_ledger(q.ledger(docs_of(spark, [(1, words(n, n))])), folder, run)
    rows = q.verdicts(q.read_ledger(spark, folder))
    assert {(r.run, r.n_words, r.kept_v1, r.kept_v2) for r in rows.collect()} == {("a", 40, True, True), ("b", 12, True, True)}


def test_rules_own_their_bits(spark):
    with pytest.raises(ValueError):
        q.ledger(docs_of(spark, [(1, "x")]), (q.Rule(1, "a", "n_words > 1"), q.Rule(1, "b", "n_words > 2")))
