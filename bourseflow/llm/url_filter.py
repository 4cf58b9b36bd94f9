"""URL filter: rules first, else gradient-boosted trees on lexical features.

A rule names a host and a path prefix; it fits the host and all its subdomains, and the longest fitting rule decides. Other URLs are
judged by trees over length, depth, digit share, character entropy, marks, parameter counts and statistics of the host's suffixes,
trained from labelled URLs: at most about `sample_rows` different ones, chosen by a hash of the URL. Suffix statistics are counted over
all labelled URLs and kept for every suffix; a table of more than `suffixes` of them is joined by a shuffle. Labelled URLs are dealt into
folds, and a URL sees the statistics of the other folds, so that the trees do not learn to look up a row's own label.

Defined results: null or no `://`: host and path are empty, and the trees judge the empty URL; nothing to learn from, or one kind
of label only: that kind, else allow. Repeated rows give repeated rows. A null page_id is kept. Extra columns are ignored. An empty table
gives no rows."""
from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from bourseflow.llm.common import sampled, small_side, stored

#: Parts that labelled URLs are dealt into.
FOLDS = 5
#: Words in a host that mark it as unwanted when no other label is at hand.
UNWANTED = ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "track", "warez")


@dataclass(frozen=True)
class Settings:
    rules: tuple[tuple[str, str], ...] = ()      # (verdict, "host/path prefix")
    sample_rows: int = 20_000
    suffixes: int = 5_000                        # most suffixes to broadcast
    trees: int = 15
    depth: int = 4
    threshold: float = 0.5
    seed: int = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) after the first `://`, and path; both empty for a null or a text without `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2)


def fitting_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Rule and verdict of the longest fitting rule (of equally long ones the first in text order); null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        of, slash, rest = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def _entropy(text: Column) -> Column:
    letters = F.split(text, "")
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    counts = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / n)
    return F.aggregate(counts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def fold(url: Column) -> Column:
    """Which of FOLDS parts of the labelled URLs a URL is in."""
    return F.pmod(F.xxhash64(F.lit("fold"), F.coalesce(url, F.lit(""))), F.lit(FOLDS)).cast("int")


def suffixes_of(host: Column) -> dict[str, Column]:
    """The last one and the last two labels of a host."""
    return {f"suffix{k}": F.substring_index(host, ".", -k) for k in (1, 2)}


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path, the suffixes and the numeric features (columns f_...)."""
    whole = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(whole, r"\?([^#]*)", 1)
    host, path = host_and_path(F.col(url))
    rows = urls.withColumn("host", host).withColumn("path", path).withColumns(suffixes_of(F.col("host"))).withColumn("own", F.regexp_replace("host", r"(^|\.)[^.]*\.[^.]*$", ""))
    return rows.withColumns({
        "f_length": F.length(whole), "f_host_length": F.length("host"), "f_path_length": F.length("path"), "f_query_length": F.length(query),
        "f_depth": F.regexp_count("path", F.lit(r"/[^/]+")), "f_labels": F.regexp_count("host", F.lit(r"\.")),
        "f_hyphens": F.regexp_count("host", F.lit("-")), "f_digits": _share(whole, r"\d"), "f_host_digits": _share(F.col("host"), r"\d"),
        "f_path_digits": _share(F.col("path"), r"\d"), "f_vowels": _share(F.col("own"), "[aeiou]"), "f_own_length": F.length("own"),
        "f_entropy": _entropy(F.col("own")), "f_path_entropy": _entropy(F.col("path")),
        "f_parameters": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1),
        "f_fragment": whole.contains("#").cast("int"), "f_secure": whole.startswith("https").cast("int"),
        "f_marks": F.regexp_count(whole, F.lit(r"[%_~@=+]"))})


def weak_labels(urls: DataFrame) -> DataFrame:
    """Adds `label`: 1 for hosts that have an unwanted word between marks or digits, 0 for other hosts, null without a host."""
    host, _ = host_and_path(F.col("url"))
    return urls.withColumn("label", F.when(host != "", host.rlike(rf"(^|[^a-z])({'|'.join(UNWANTED)})([^a-z]|$)").cast("double")))


@dataclass
class Trained:
    model: object                    # None: one kind of label only
    only: float
    suffixes: dict[str, DataFrame]   # stored: suffix, rate and rows over all labelled URLs, and the counts in all and by fold
    prior: float
    most: int                        # suffixes to broadcast


def with_suffixes(rows: DataFrame, t: Trained) -> DataFrame:
    """Adds the statistics of a row's suffixes and the vector of all features. A row, fitted or judged, sees the statistics of the other
    folds only, so never its own label nor that of its copies."""
    own = fold(F.col("url"))
    for name, table in t.suffixes.items():
        rows = rows.join(small_side(table.drop("rate", "rows"), t.most), name, "left")
        n, bad = (F.coalesce(F.col(c) - F.get(f"{c}_of", own), F.lit(0)) for c in ("n", "bad"))
        rows = rows.withColumns({f"f_{name}_rate": (bad + 10 * t.prior) / (n + 10), f"f_{name}_rows": F.log1p(n)}).drop("n", "bad", "n_of", "bad_of")
    names = sorted(c for c in rows.columns if c.startswith("f_"))
    return VectorAssembler(inputCols=names, outputCol="features").transform(rows.withColumns({c: F.col(c).cast("double") for c in names}))


def learn(labelled: DataFrame, s: Settings = Settings()) -> Trained:
    """labelled: url, label (1 block, 0 allow; other labels teach nothing)."""
    rows = labelled.select("url", "label").where("url is not null and label in (0, 1)")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("bad")).first()
    if not total["n"] or total["bad"] in (0, total["n"]):
        return Trained(None, 1.0 if total["bad"] else 0.0, {}, 0.0, s.suffixes)
    prior = total["bad"] / total["n"]
    host, _ = host_and_path(F.col("url"))
    pairs = stored(rows.select(host.alias("host"), fold(F.col("url")).alias("fold"), "label")
                   .select(*[c.alias(k) for k, c in suffixes_of(F.col("host")).items()], "fold", "label")
                   .groupBy("suffix1", "suffix2", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("bad")), "suffix-counts")
    tables = {}
    for name in ("suffix1", "suffix2"):
        of = {c: F.array(*[F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)) for k in range(FOLDS)]).alias(f"{c}_of") for c in ("n", "bad")}
        counts = pairs.groupBy(name).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), *of.values())
        tables[name] = stored(counts.select(name, ((F.col("bad") + 10 * prior) / (F.col("n") + 10)).alias("rate"), F.log1p("n").alias("rows"),
                                            "n", "bad", "n_of", "bad_of"), name)
    share = min(1.0, s.sample_rows / total["n"])
    chosen = sampled(rows, share, "url")
    chosen = stored(lexical(chosen).repartition(8, "url"), "labelled-urls")
    kinds = [x["label"] for x in chosen.select("label").distinct().collect()]
    if len(kinds) < 2:                                               # the sample shows one kind only
        return Trained(None, kinds[0] if kinds else float(prior >= 0.5), {}, prior, s.suffixes)
    out = Trained(None, 0.0, tables, prior, s.suffixes)
    data = stored(with_suffixes(chosen, out).select("features", "label"), "url-features")
    out.model = GBTClassifier(maxIter=s.trees, maxDepth=s.depth, stepSize=0.3, seed=s.seed).fit(data)
    return out


def judged(pages: DataFrame, labelled: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per page row: page_id, host, path, rule, verdict, score (the trees' probability of block)."""
    t = learn(labelled, s)
    rows = lexical(pages.select("page_id", "url"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), s.rules)
    if t.model is None:
        scored = rows.withColumn("score", F.lit(t.only))
    else:
        scored = t.model.transform(with_suffixes(rows, t)).withColumn("score", vector_to_array("probability")[1])
    guess = F.when(F.col("score") >= s.threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, guess).alias("verdict"), "score")
