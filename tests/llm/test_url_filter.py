import math
import random
from collections import Counter

from pyspark.sql import functions as F

from bourseflow.llm.url_filter import Settings, fitting_rule, host_and_path, judged, learn, lexical, weak_labels

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, html string")


def split(url):
    """Host and path letter by letter."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([k for c in "/?#" if (k := rest.find(c)) >= 0], default=len(rest))
    tail = rest[at:]
    end = min([k for c in "?#" if (k := tail.find(c)) >= 0], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at]), tail[:end]


def decide(host, path, rules):
    best = None
    for said, text in rules:
        of, _, rest = text.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith("/" + rest) and (best is None or len(text) > len(best[0])):
            best = text, said
    return best or (None, None)


URLS = [None, "", "no scheme", "http://Example.NET/en/1?x=/de/", "https://a.example.com/de/2#f", "https://a.example.com/de", "http://net", "http://net/", "http://xnet/",
        "ftp://b.org/fr/", "http://b.org/FR/", "a://b://c.net/x", "http://ÄB.org/fr/é\n", "http://u@h.net:80/p?q=a://b", "http://example.net?/en/", "http://c.example.net/en/x"]


def test_hosts_paths_and_rules_as_letter_by_letter(spark):
    host, path = host_and_path(F.col("url"))
    rule, verdict = fitting_rule(F.col("h"), F.col("p"), RULES)
    got = pages_of(spark, URLS).select("url", host.alias("h"), path.alias("p")).select("*", rule.alias("r"), verdict.alias("v")).collect()
    for r in got:
        assert (r.h, r.p) == split(r.url) and (r.r, r.v) == decide(r.h, r.p, RULES)


def test_features(spark):
    r = lexical(pages_of(spark, ["https://ab-ab.cc.example.com/x/y9?a=1&b=2#t"])).first()
    n = Counter("ab-ab.cc")
    assert abs(r.f_entropy + sum(k / 8 * math.log2(k / 8) for k in n.values())) < 1e-12
    assert (r.f_depth, r.f_parameters, r.f_hyphens, r.f_labels, r.f_fragment, r.suffix1, r.suffix2) == (2, 2, 1, 3, 1, "com", "example.com")


def test_trees_learn_unseen_hosts(spark):
    rng = random.Random(1)
    good = [f"https://{a}{b}.example.org/en/{rng.randrange(9999)}" for a in ("the", "on", "in") for b in ("river", "house", "sea", "hill") for _ in range(20)]
    bad = [f"http://{a}-{b}.example.org/{rng.randrange(10**9)}?x=1&y={k}" for a in ("win", "free") for b in ("gold", "cash") for k in range(30)]
    labelled = spark.createDataFrame([(u, 0.0) for u in good] + [(u, 1.0) for u in bad], "url string, label double")
    got = judged(pages_of(spark, ["http://big-luck.example.org/777777777?x=1&y=3", "https://atsea.example.org/en/12"]), labelled)
    assert {r.page_id: r.verdict for r in got.collect()} == {0: "block", 1: "allow"}


def test_awkward_rows(spark):
    docs = pages_of(spark, URLS + URLS + ["http://x.org/" + "a" * 50_000]).selectExpr("*", "1 as host", "2 as score", "3 as label", "4 as features", "5 as f_length")
    got = judged(docs, weak_labels(docs.select("url")), Settings(rules=RULES)).collect()
    assert len(got) == 2 * len(URLS) + 1 and all(r.verdict in ("block", "allow") for r in got)
    nothing = spark.createDataFrame([], "url string, label double")
    assert {r.verdict for r in judged(docs, nothing).collect()} == {"allow"}
    assert judged(docs.limit(0), nothing).count() == 0


def test_suffix_statistics_count_all_labelled_urls(spark):
    urls = [(f"http://h{k}.site{k % 97}.{'com' if k % 3 else 'org'}/{k}", float(k % 97 % 2)) for k in range(1200)]
    labelled = spark.createDataFrame(urls, "url string, label double")
    prior = sum(y for _, y in urls) / len(urls)
    for s in (Settings(sample_rows=60, suffixes=3, trees=2), Settings(sample_rows=60, trees=2)):
        t = learn(labelled, s)
        for k, name in ((1, "suffix1"), (2, "suffix2")):
            n, bad = Counter(), Counter()
            for u, y in urls:
                suffix = ".".join(split(u)[0].split(".")[-k:])
                n[suffix] += 1
                bad[suffix] += y
            got = {r[0]: (r[1], r[2]) for r in t.suffixes[name].collect()}
            assert got.keys() == n.keys() and len(n) == (2 if k == 1 else 97 * 2)
            assert all(abs(got[x][0] - (bad[x] + 10 * prior) / (n[x] + 10)) < 1e-12 and abs(got[x][1] - math.log1p(n[x])) < 1e-12 for x in n)
    pages = pages_of(spark, [u for u, _ in urls] + ["http://new.place/"])
    by_shuffle, by_broadcast = ({r.page_id: (r.verdict, r.score) for r in judged(pages, labelled, Settings(suffixes=k, trees=2)).collect()} for k in (3, 5_000))
    assert by_shuffle.keys() == by_broadcast.keys() and len(by_shuffle) == 1201
    assert all(x[0] == by_broadcast[i][0] and abs(x[1] - by_broadcast[i][1]) < 1e-9 for i, x in by_shuffle.items())


def test_random_labels_cannot_be_looked_up(spark):
    """3,000 hosts with one page each and random labels: a row does not see its own label in the suffix statistics."""
    rng = random.Random(9)
    rows = [(i, f"http://h{i}x.d{i}z.org/a/{i % 7}", float(rng.random() < 0.5)) for i in range(3000)]
    labelled = spark.createDataFrame(rows, "page_id long, url string, label double")
    got = {r.page_id: r.verdict for r in judged(labelled.drop("label"), labelled.drop("page_id")).collect()}
    right = sum((got[i] == "block") == (label == 1.0) for i, _, label in rows) / len(rows)
    assert right < 0.65


def test_labels_by_whole_parts_of_the_host(spark):
    hosts = {"uploads.example.org": 0, "roads.gov.uk": 0, "soundtracks.com": 0, "alphabets.org": 0, "ads.example.org": 1, "x-casino.net": 1,
             "bets24.com": 1, "track.site.de": 1, "adultery.org": 0}
    df = spark.createDataFrame([(f"https://{h}/p",) for h in hosts], "url string")
    assert {r.url[8:-2]: r.label for r in weak_labels(df).collect()} == hosts
