"""Near-duplicate documents by a signature-coordinate inverted join.

Every document posts itself under its MinHash (coordinate, value) pairs. Pairs that agree in `least_matches` of the `coordinates`
must meet under one of the first `coordinates - least_matches + 1` of their own pairs in a global order (rarest first), so only
that prefix is posted, and a pair held by one document takes a place of the prefix without being posted at all. Pairs of
documents that meet have their agreeing coordinates counted; those above the match threshold are confirmed on the full sets.

Documents with equal sets are one class throughout. Inside a posting list documents are first tried against four fixed members
(linear in the list). Lists that still hold more than one component are cut into blocks, and tasks compare two blocks at a time by a
longer signature, across components only; they hand on just the pairs that may be similar enough, to be confirmed on the full sets.
So a large group of near copies is never expanded into all its pairs.

Defined results: null text, empty text or no word: empty set, linked with nothing, component is the own doc_id. Null doc_id:
linked with nothing, null component, kept. Rows that repeat a doc_id are judged by their own text, and texts under one doc_id count
as linked through it when either has a link. Extra columns are ignored. An empty table gives no rows."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bourseflow.llm.common import (MIX_1, MIX_2, U, as_long, ascii_words, components, mix, shingle_hashes, slices, small_side, stored,
                                   word_hashes)

#: Most candidate ids that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Settings:
    shingle: int = 5                 # words
    percent: int = 80                # least similarity, 100 * intersection / union
    coordinates: int = 48
    slack: float = 4.0               # standard deviations that agreeing coordinates may fall below their mean
    seed: int = 7
    long: int = 1024                 # coordinates, of one byte, of the longer signature
    block: int = 1024                # documents compared with as many others at once

    @property
    def least_matches(self) -> int:
        p, m = self.percent / 100, self.coordinates
        return max(1, int(m * p - self.slack * (m * p * (1 - p)) ** 0.5))

    @property
    def prefix(self) -> int:
        return self.coordinates - self.least_matches + 1

    @property
    def least_long(self) -> int:
        p, m = self.percent / 100, self.long
        p += (1 - p) / 256                            # bytes also agree by chance
        return max(1, int(m * p - self.slack * (m * p * (1 - p)) ** 0.5))


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """Per row: doc_id, set size, 128-bit hash of the set, and the signature (null for an empty set)."""
    rng = np.random.default_rng(s.seed)
    a = rng.integers(1, 2**63, s.coordinates, dtype=np.uint64) * U(2) + U(1)
    b = rng.integers(0, 2**63, s.coordinates, dtype=np.uint64)
    size = s.shingle

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                word_at, words = ascii_words(batch.column("text"))
                at, h = shingle_hashes(word_at, word_hashes(words), size)
                n = np.diff(at)
                full = np.flatnonzero(n)
                sig = np.empty((len(full), len(a)), np.int32)
                if len(full):
                    for k in range(len(a)):
                        sig[:, k] = np.minimum.reduceat(h * a[k] + b[k], at[:-1][full]).view(np.int64) >> 32
                count, one, two = np.zeros(len(n), np.int64), np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                for d in full:
                    own = np.unique(h[at[d]:at[d + 1]])
                    count[d], one[d], two[d] = len(own), mix(own ^ MIX_1).sum(), mix(own ^ MIX_2).sum()
                lists = np.concatenate([[0], np.cumsum(np.where(n > 0, len(a), 0))]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(lists), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count), as_long(one), as_long(two), listed],
                                                 ["doc_id", "n_shingles", "h1", "h2", "sig"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, h1 long, h2 long, sig array<int>")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """Per document: id and sorted distinct shingle hashes."""
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                word_at, words = ascii_words(batch.column("text"))
                at, h = shingle_hashes(word_at, word_hashes(words), size)
                sets = [np.unique(h[at[d]:at[d + 1]]) for d in range(batch.num_rows)]
                lists = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(lists), as_long(values))],
                                                 ["id", "shingles"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "id long, shingles array<long>")


def postings(classes: DataFrame, s: Settings) -> DataFrame:
    """(key, id) for the rarest coordinate-value pairs of each class that another class holds too."""
    pairs = classes.select("id", F.posexplode("sig").alias("k", "value")).select(
        "id", (F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("key"))
    held = stored(pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "frequencies")
    own = pairs.join(held, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("shared"))
    # pairs that no other class holds are the rarest and fill the prefix first
    room = F.lit(s.prefix) - (F.lit(s.coordinates) - F.size("shared"))
    return own.where(room > 0).select("id", F.explode(F.slice("shared", 1, F.greatest(room, F.lit(1)))).alias("p")).select("id", "p.key")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) that agree in enough coordinates and whose full sets are similar enough."""
    left = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    agree = F.size(F.filter(F.arrays_zip("sa", "sb"), lambda x: x["sa"] == x["sb"]))
    near = stored(pairs.join(left, "a").join(right, "b")
                  .where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * s.percent) & (agree >= s.least_matches))
                  .select("a", "b", "na", "nb"), "candidates")
    wanted = stored(near.select("a").union(near.select("b")).toDF("doc_id").distinct(), "wanted")
    # rows that repeat a doc_id with other texts: the class's own text is found by its set hash
    sets = stored(shingle_sets(docs.join(small_side(wanted, BROADCAST_ROWS), "doc_id", "left_semi"), s.shingle)
                  .where(F.size("shingles") > 0), "sets")
    both = (near.join(sets.toDF("a", "ha"), "a").join(sets.toDF("b", "hb"), "b")
            .withColumn("common", F.size(F.array_intersect("ha", "hb")))
            .where(F.col("common") * 100 >= (F.size("ha") + F.size("hb") - F.col("common")) * s.percent))
    return both.select("a", "b").distinct()


def long_signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """Per document: id, set size, and a signature of `long` bytes."""
    rng = np.random.default_rng(s.seed + 1)
    a = rng.integers(1, 2**63, s.long, dtype=np.uint64) * U(2) + U(1)
    b = rng.integers(0, 2**63, s.long, dtype=np.uint64)
    size = s.shingle

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                word_at, words = ascii_words(batch.column("text"))
                at, h = shingle_hashes(word_at, word_hashes(words), size)
                full = np.flatnonzero(np.diff(at))
                sig = np.empty((len(full), len(a)), np.uint8)
                if len(full):
                    for k in range(len(a)):
                        sig[:, k] = mix(np.minimum.reduceat(h * a[k] + b[k], at[:-1][full])) & U(255)
                n = [len(np.unique(h[at[d]:at[d + 1]])) for d in full]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(full)), pa.array(n, pa.int64()),
                                                  pa.array([x.tobytes() for x in sig], pa.binary())], ["id", "n", "sketch"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "id long, n long, sketch binary")


def across(left: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """left: (key, id, c), posting lists with more than one component c. Pairs (a, b) across components that may be similar enough.

    A document carries the keys of all its lists (no more than the prefix is long), and a pair is handed on by the first list it shares."""
    ids = stored(left.select(F.col("id").alias("doc_id")).distinct(), "unsettled-ids")
    sketched = stored(long_signatures(docs.join(small_side(ids, BROADCAST_ROWS), "doc_id", "left_semi"), s), "long-signatures")
    sizes = stored(left.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / s.block).cast("int").alias("blocks")), "list-blocks")
    held = left.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # a document goes to all pairs of blocks that hold its own
    spread = held.select("key", "id", "c", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select(
        "key", "id", "c", F.least("own", "o").alias("x"), F.greatest("own", "o").alias("y"), (F.col("own") > F.col("o")).cast("int").alias("side"))
    carried = left.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("lists"))
    sketched = stored(sketched.join(carried, "id"), "sketched")
    least, percent = s.least_long, s.percent

    def run(group: pa.Table) -> pa.Table:
        key = group["key"][0].as_py()
        group = group.combine_chunks()
        ids, c, side, n = (group[k].to_numpy() for k in ("id", "c", "side", "n"))
        sig = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(len(ids), -1)
        lists = [set(x) for x in group["lists"].to_pylist()]
        alone = group["x"][0].as_py() == group["y"][0].as_py()
        left, right = (np.arange(len(ids)),) * 2 if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        out_a, out_b = [], []
        for i in left:
            to = right[right > i] if alone else right
            to = to[(c[to] != c[i]) & (np.minimum(n[to], n[i]) * 100 >= np.maximum(n[to], n[i]) * percent)]
            to = to[(sig[to] == sig[i]).sum(axis=1) >= least]
            to = to[[min(lists[i] & lists[j]) == key for j in to]] if len(to) else to
            out_a.append(np.maximum(ids[to], ids[i]))
            out_b.append(np.minimum(ids[to], ids[i]))
        none = [np.empty(0, np.int64)]
        return pa.table({"a": pa.array(np.concatenate(out_a or none), pa.int64()), "b": pa.array(np.concatenate(out_b or none), pa.int64())})
    return spread.join(sketched, "id").groupBy("key", "x", "y").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept."""
    signed = stored(signatures(docs, s), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stored(full.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("x"))
                     .select("h1", "h2", F.col("x.doc_id").alias("id"), F.col("x.n_shingles").alias("n"), F.col("x.sig").alias("sig")),
                     "classes")
    posted = stored(postings(classes, s), "postings")
    tried = F.array(F.min("id"), F.max("id"), F.min_by("id", F.xxhash64("id")), F.max_by("id", F.xxhash64("id")))
    pivots = stored(posted.groupBy("key").agg(F.array_distinct(tried).alias("p")), "pivots")
    first = stored(posted.join(pivots, "key").select("id", F.explode("p").alias("p")).where("id <> p")
                   .select(F.greatest("id", "p").alias("a"), F.least("id", "p").alias("b")).distinct(), "first-pairs")
    links = stored(verified(first, classes, docs, s), "first-links")
    linked = components(links)
    at = stored(posted.join(linked, posted.id == linked.node, "left")
                .select("key", "id", F.coalesce("component", "id").alias("c")), "placed")
    mixed = stored(at.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key"), "mixed")
    left = stored(at.join(mixed, "key", "left_semi"), "unsettled")
    cross = across(left, docs, s).join(first, ["a", "b"], "left_anti")
    more = stored(verified(cross, classes, docs, s), "cross-links")
    # classes whose smallest doc_id is shared (rows that repeat a doc_id) meet in that id
    linked = components(links.union(more))
    placed = stored(classes.join(linked, classes.id == linked.node, "left")
                    .select("h1", "h2", F.coalesce("component", "id").alias("component")), "class-components")
    ids = signed.select("doc_id", "n_shingles", "h1", "h2")
    rows = ids.where("n_shingles > 0 and doc_id is not null").join(placed, ["h1", "h2"]).select("doc_id", "n_shingles", "component")
    rest = ids.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    return rows.union(rest).select("doc_id", "n_shingles", F.col("component").alias("component_id"),
                                   F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents without near copies: one row of each component stays; all columns are kept.

    Rows without a word or without doc_id stay."""
    found = near_duplicates(docs, s)
    gone = stored(found.where("not kept").select("doc_id").distinct(), "near-copies")
    stay = docs.join(small_side(gone, BROADCAST_ROWS), "doc_id", "left_anti")
    # exact repeats of a kept row
    repeated = stored(found.where("kept and doc_id is not null and n_shingles > 0").groupBy("doc_id").count().where("count > 1")
                      .select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return stay
    some = small_side(repeated, BROADCAST_ROWS)
    return stay.join(some, "doc_id", "left_anti").unionByName(stay.join(some, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
