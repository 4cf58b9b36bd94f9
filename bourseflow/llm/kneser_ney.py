"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted arrays, memory-mapped by the scoring tasks.

Counting. Tasks count words of Arrow batches by 64-bit hash; the counts are summed in Spark and written as shards of sorted hashes
with counts, cut by the top bits of the hash. A word's id is its place in that order. Bigrams are pairs of ids in one 64-bit key,
again counted inside tasks first, then merged shard by shard. A shard holds whole contexts, so their numbers of followers need no
further shuffle; contexts with more tokens than a shard should hold are spread over all shards by key.

Model. With discounts D1, D2, D3+ of each level from its counts of counts,
    p(w | h) = max(c(h,w) - D, 0) / c(h) + g(h) * p(w),   p(w) = max(a(w) - D, 0) / A + g / (V + 1),
where a(w) is the number of different predecessors of w, A their sum, V the number of words and the end, and g the mass that the
discounts free. A text is its words, then one end; the first word's context is the start. Unknown words get g / (V + 1), a context never
seen gives p(w). Probabilities are computed from stored counts when scoring, so the files hold keys and counts only.

Scoring. A task looks its batch's distinct keys up in sorted order, shard by shard; pages of the mapped files are read as needed
and belong to no heap. Where the shared folder is no local path, a worker copies a shard to its executor's block folder when it first
needs it. Every shard of the model has a file, empty or not, and one that cannot be found is an error.

Defined results: a null text is an empty one (one token, the end); a null doc_id is trained on and not held out; no training
rows: every probability 1 and score 0. Repeated rows are counted as often as they occur. Extra columns are ignored. An empty
table gives no rows. Limits: fewer than 2^32 distinct words; different words whose 64-bit hashes agree count as one."""
from __future__ import annotations

import io
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from bourseflow.llm.common import U, ascii_words, mix, new_folder, slices, stored, word_hashes

#: Stands for the end of a text; it holds a blank, so it is no word.
END = U(xxhash.xxh3_64_intdigest(" end"))
LOW = U(0xFFFFFFFF)


@dataclass(frozen=True)
class Settings:
    added: float = 0.1               # of the base score
    shard_rows: int = 2_000_000      # keys that a shard is meant to hold
    least_shards: int = 128
    flush: int = 1_500_000           # keys that a counting task holds


# --- files -----------------------------------------------------------------------------------------------------------------

def put(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array under its final name in one step, so a repeated task leaves the same whole file."""
    system, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    system.create_dir(path, recursive=True)
    data = io.BytesIO()
    np.save(data, array)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data.getbuffer())
    system.move(part, f"{path}/{name}.npy")


_MAPPED: dict[str, np.ndarray] = {}


def mapped(folder: str, name: str) -> np.ndarray:
    """A stored array, memory-mapped. A file that is missing, or not visible yet, is an error: the task is tried again, nothing is scored without it.

    Files of a remote folder are copied, piece by piece, to the executor's own block folder, which Spark deletes with the executor."""
    key = f"{folder}/{name}"
    if key not in _MAPPED:
        parts = urlparse(folder)
        path = f"{parts.path}/{name}.npy"
        if parts.scheme not in ("", "file"):
            system, there = fs.FileSystem.from_uri(folder)
            local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or tempfile.gettempdir()
            path = f"{local}/{re.sub(r'[^A-Za-z0-9.-]', '_', key)}.npy"
            if not os.path.exists(path):
                part = f"{path}-{uuid.uuid4().hex}"
                with system.open_input_stream(f"{there}/{name}.npy") as source, open(part, "wb") as copy:
                    shutil.copyfileobj(source, copy, 1 << 22)
                os.replace(part, path)
        _MAPPED[key] = np.load(path, mmap_mode="r")
    return _MAPPED[key]


# --- counting ----------------------------------------------------------------------------------------------------------------

class Tally:
    """Counts by 64-bit key, merged now and then."""

    def __init__(self, limit: int):
        self.limit, self.parts, self.rows = limit, [], 0

    def add(self, keys: np.ndarray) -> None:
        key, n = np.unique(keys, return_counts=True)
        self.parts.append((key, n.astype(np.int64)))
        self.rows += len(key)

    def full(self) -> bool:
        return self.rows > self.limit

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts])) if self.parts else (
            np.empty(0, np.uint64), np.empty(0, np.int64))
        self.parts, self.rows = [], 0
        return out


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and word hashes of texts, each closed by END."""
    at, words = ascii_words(texts)
    h = word_hashes(words)
    n = np.diff(at)
    ends = at[1:] + np.arange(1, len(at)) - 1
    out = np.empty(len(h) + len(n), np.uint64)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[ends], out[inner] = END, h
    return np.concatenate([[0], ends + 1]), out


def counted(docs: DataFrame, keys_of: Callable[[pa.Array], np.ndarray], s: Settings) -> DataFrame:
    """(key long, n long), counted over each task's texts."""
    limit = s.flush

    def run(batches):
        tally = Tally(limit)

        def out():
            key, n = tally.take()
            for i in range(0, len(key), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[i:i + 500_000].view(np.int64)), pa.array(n[i:i + 500_000])], ["key", "n"])
        for whole in batches:
            for batch in slices(whole, "text"):
                tally.add(keys_of(batch.column("text")))
                if tally.full():
                    yield from out()
        yield from out()
    return docs.select("text").mapInArrow(run, "key long, n long")


def power_of_two(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(n, 1)))))


# --- the stored model ----------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Model:
    folder: str
    tokens: int                       # N
    words: int                        # V
    offsets: tuple[int, ...]          # first id of each shard of words, and V
    shards: int                       # of bigrams
    hot: tuple[int, ...]              # ids of contexts spread over all shards
    block: int                        # ids in a block of the weights
    discounts: tuple[float, float, float]
    base_mass: float                  # g of the word level
    start: tuple[float, float]        # c and g of the start context

    def find_ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of word hashes."""
        distinct, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64)
        shards = len(self.offsets) - 1
        cut = np.searchsorted(distinct >> U(64 - int(np.log2(shards))) if shards > 1 else np.zeros(len(distinct), np.uint64),
                              np.arange(shards + 1, dtype=np.uint64))
        for p in np.flatnonzero(np.diff(cut)):
            if self.offsets[p + 1] > self.offsets[p]:              # shards without words have no file
                keys = mapped(self.folder, f"words-{p}")
                mine = distinct[cut[p]:cut[p + 1]]
                at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                hit = keys[at] == mine
                ids[cut[p]:cut[p + 1]] = np.where(hit, at + self.offsets[p], -1)
                counts[cut[p]:cut[p + 1]] = np.where(hit, mapped(self.folder, f"word-counts-{p}")[at], 0)
        return ids[back], counts[back]

    def shard_of(self, keys: np.ndarray) -> np.ndarray:
        return bigram_shard(keys, self.shards, np.array(self.hot, np.uint64))

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(keys, return_inverse=True)
        shard = self.shard_of(distinct)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(self.shards + 1))
        counts = np.zeros(len(distinct), np.int64)
        for p in np.flatnonzero(np.diff(cut)):
            stored_keys = mapped(self.folder, f"pairs-{p}")
            if len(stored_keys):
                mine = order[cut[p]:cut[p + 1]]
                want = distinct[mine]
                at = np.minimum(np.searchsorted(stored_keys, want), len(stored_keys) - 1)
                n = np.where(stored_keys[at] == want, mapped(self.folder, f"pair-counts-{p}")[at], 0).astype(np.int64)
                if (large := n == 255).any():                  # larger counts stand in a list of their own
                    n[large] = mapped(self.folder, f"large-counts-{p}")[np.searchsorted(mapped(self.folder, f"large-pairs-{p}"), want[large])]
                counts[mine] = n
        return counts[back]

    def weights(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """p(w) and g(w as context) of known ids."""
        low, free = np.empty(len(ids)), np.empty(len(ids))
        block = ids // self.block
        order = np.argsort(block, kind="stable")
        cut = np.searchsorted(block[order], np.arange(self.words // self.block + 2))
        for b in np.flatnonzero(np.diff(cut)):
            mine = order[cut[b]:cut[b + 1]]
            low[mine] = mapped(self.folder, f"low-{b}")[ids[mine] - b * self.block]
            free[mine] = mapped(self.folder, f"free-{b}")[ids[mine] - b * self.block]
        return low, free

    def score(self, texts: pa.Array, added: float) -> dict[str, np.ndarray]:
        at, h = token_hashes(texts)
        ids, counts = self.find_ids(h)
        first = np.zeros(len(h), bool)
        first[at[:-1]] = True
        known = ids >= 0
        low, free = np.full(len(h), self.base_mass / (self.words + 1)), np.ones(len(h))
        distinct, back = np.unique(ids[known], return_inverse=True)
        low_of, free_of = self.weights(distinct)
        low[known], free[known] = low_of[back], free_of[back]
        before, total, mass = np.roll(ids, 1), np.roll(counts, 1).astype(float), np.roll(free, 1)
        before[first], total[first], mass[first] = self.words, self.start[0], self.start[1]
        seen = (before >= 0) & (total > 0)
        p = np.where(seen, mass * low, low)
        both = np.flatnonzero(seen & known)
        n = self.pair_counts((before[both].astype(np.uint64) << U(32)) | ids[both].astype(np.uint64))
        cut = np.array([0.0, *self.discounts])[np.minimum(n, 3)]
        p[both] += np.maximum(n - cut, 0) / total[both]
        base = np.log10((counts + added) / (self.tokens + added * (self.words + 1)))
        add = np.add.reduceat
        return {"n_tokens": np.diff(at), "n_known": add((counts > 0).astype(np.int64), at[:-1]), "base_score": add(base, at[:-1]),
                "score": add(np.log10(p), at[:-1])}


def bigram_shard(keys: np.ndarray, shards: int, hot: np.ndarray) -> np.ndarray:
    context = keys >> U(32)
    spread = np.isin(context, hot)
    return (mix(np.where(spread, keys, context) + U(0x77)) >> U(32)).astype(np.int64) % shards


def discounts_of(n: list[float]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of keys with count 1 to 4; plain halves where these are too few to tell."""
    out = []
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else k / 2
        out.append(float(min(max(d, 0.0), k)))
    return tuple(out)


def train(docs: DataFrame, s: Settings = Settings()) -> Model:
    """Count the texts of `docs` (whole column `text`) and store the model in the shared folder."""
    spark = docs.sparkSession
    folder = new_folder(spark, "bigram-model")
    # words
    words = stored(counted(docs, lambda t: token_hashes(t)[1], s).groupBy("key").agg(F.sum("n").alias("n")), "word-counts")
    size = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    v, tokens = int(size[0]), int(size[1])
    if not v:
        return Model(folder, 0, 0, (0, 0), 1, (), 1, (0.5, 1.0, 1.5), 1.0, (0.0, 1.0))
    word_shards = power_of_two(max(s.least_shards, v / s.shard_rows))

    def write_words(key: tuple, group: pa.Table) -> pa.Table:
        p = key[0].as_py()
        h, n = summed(group["key"].to_numpy().view(np.uint64), group["n"].to_numpy())
        put(folder, f"words-{p}", h)
        put(folder, f"word-counts-{p}", n)
        return pa.table({"p": pa.array([p], pa.int64()), "rows": pa.array([len(h)], pa.int64())})
    bits = int(np.log2(word_shards))
    written = (words.withColumn("p", F.shiftrightunsigned("key", 64 - bits)).groupBy("p")
               .applyInArrow(write_words, "p long, rows long").collect())                    # word_shards rows
    rows = dict((r["p"], r["rows"]) for r in written)
    offsets = tuple(int(x) for x in np.concatenate([[0], np.cumsum([rows.get(p, 0) for p in range(word_shards)])]))
    if v >= 2**32:
        raise ValueError(f"{v} distinct words do not fit ids of 32 bits")
    # bigrams
    shards = power_of_two(max(s.least_shards, tokens / s.shard_rows))
    plain = Model(folder, tokens, v, offsets, shards, (), 1, (0.5, 1.0, 1.5), 1.0, (0.0, 1.0))
    frequent = np.array([r["key"] for r in words.where(F.col("n") > tokens // shards).select("key").collect()], np.int64)   # < shards rows
    hot = tuple(int(x) for x in plain.find_ids(frequent.view(np.uint64))[0]) + (v,)           # and the start

    def pairs(texts: pa.Array) -> np.ndarray:
        at, h = token_hashes(texts)
        ids = plain.find_ids(h)[0].astype(np.uint64)
        before = np.roll(ids, 1)
        before[at[:-1]] = v
        return (before << U(32)) | ids
    found = counted(docs, pairs, s)
    hot_ids = np.array(hot, np.uint64)

    def shard_column(batches):
        for b in batches:
            p = bigram_shard(b.column("key").to_numpy().view(np.uint64), shards, hot_ids)
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), b.column("key"), b.column("n").cast(pa.int32())], ["p", "key", "n"])

    def write_pairs(key: tuple, group: pa.Table) -> pa.Table:
        p = key[0].as_py()
        n = group["n"].to_numpy().astype(np.int64)
        k, n = summed(group["key"].to_numpy().view(np.uint64)[n > 0], n[n > 0])
        put(folder, f"pairs-{p}", k)
        put(folder, f"pair-counts-{p}", np.minimum(n, 255).astype(np.uint8))
        if (large := n >= 255).any():
            put(folder, f"large-pairs-{p}", k[large])
            put(folder, f"large-counts-{p}", n[large])
        context = (k >> U(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(context, prepend=-1))
        after, times = np.unique((k & LOW).astype(np.int64), return_counts=True)
        by = [np.concatenate([np.add.reduceat((n == i) if i < 3 else (n >= 3), first, dtype=np.int64), np.zeros(len(after), np.int64)])
              for i in (1, 2, 3)]
        kinds = np.array([int((n == i).sum()) for i in (1, 2, 3, 4)])
        return pa.table({"id": pa.array(np.concatenate([context[first], after, [-1, -2, -3, -4]])),
                         "n1": pa.array(np.concatenate([by[0], np.zeros(4, np.int64)])), "n2": pa.array(np.concatenate([by[1], np.zeros(4, np.int64)])),
                         "n3": pa.array(np.concatenate([by[2], np.zeros(4, np.int64)])),
                         "a": pa.array(np.concatenate([np.zeros(len(first), np.int64), times, kinds]))})
    # one empty row for each shard: every shard has a file, so a missing one can be told from an empty one
    every = spark.range(shards).select(F.col("id").cast("int").alias("p"), F.lit(0).cast("long").alias("key"), F.lit(0).alias("n"))
    partial = stored(found.mapInArrow(shard_column, "p int, key long, n int").union(every).groupBy("p").applyInArrow(
        write_pairs, "id long, n1 long, n2 long, n3 long, a long"), "pair-statistics")
    each = stored(partial.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("n1", "n2", "n3", "a"))), "word-statistics")
    kinds = {r["id"]: r["a"] for r in each.where("id < 0").collect()}                         # 4 rows
    d = discounts_of([kinds.get(-k, 0) for k in (1, 2, 3, 4)])
    known = each.where("id >= 0")
    by_a = {r["k"]: (r["rows"], r["a"]) for r in known.where("a > 0").groupBy(F.least("a", F.lit(5)).alias("k"))
            .agg(F.count(F.lit(1)).alias("rows"), F.sum("a").alias("a")).collect()}           # 5 rows
    n_a = [by_a.get(k, (0, 0))[0] for k in (1, 2, 3, 4)]
    low_d, total_a = discounts_of(n_a), sum(a for _, a in by_a.values())
    all_words = sum(rows for rows, _ in by_a.values())
    mass = (low_d[0] * n_a[0] + low_d[1] * n_a[1] + low_d[2] * (all_words - n_a[0] - n_a[1])) / total_a
    first_row = known.where(F.col("id") == v).first()
    starts = docs.count()
    start = (float(starts), (d[0] * first_row["n1"] + d[1] * first_row["n2"] + d[2] * first_row["n3"]) / starts)
    block = max(4096, -(-v // power_of_two(max(s.least_shards, v / s.shard_rows))))

    def write_weights(key: tuple, group: pa.Table) -> pa.Table:
        b = key[0].as_py()
        size_of = min(block, v - b * block)
        c = np.empty(size_of, np.int64)                       # counts of these ids, from the shards of words
        lo = b * block
        for p in range(np.searchsorted(offsets, lo, "right") - 1, len(offsets) - 1):
            if offsets[p] >= lo + size_of:
                break
            i, j = max(lo, offsets[p]), min(lo + size_of, offsets[p + 1])
            if i < j:
                c[i - lo:j - lo] = mapped(folder, f"word-counts-{p}")[i - offsets[p]:j - offsets[p]]
        at = group["id"].to_numpy() - lo
        a, n1, n2, n3 = (np.zeros(size_of, np.int64) for _ in range(4))
        for column, into in (("a", a), ("n1", n1), ("n2", n2), ("n3", n3)):
            into[at] = group[column].to_numpy()
        put(folder, f"low-{b}", np.maximum(a - np.array([0.0, *low_d])[np.minimum(a, 3)], 0) / total_a + mass / (v + 1))
        # the end is never a context: its free mass is 1 and unused
        put(folder, f"free-{b}", np.where(n1 + n2 + n3 > 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / c, 1.0))
        return pa.table({"rows": pa.array([size_of], pa.int64())})
    known.where(F.col("id") < v).withColumn("b", F.floor(F.col("id") / block)).groupBy("b").applyInArrow(
        write_weights, "rows long").agg(F.sum("rows")).collect()
    return Model(folder, tokens, v, offsets, shards, hot, block, d, mass, start)


def scored(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    added = s.added

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                out = model.score(batch.column("text"), added)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(out["n_tokens"]), pa.array(out["n_known"]),
                     pa.array(np.full(batch.num_rows, model.tokens, np.int64)), pa.array(out["base_score"]), pa.array(out["score"])],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return docs.select("doc_id", "held_out", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
             "base_score double, score double")


def held_out(docs: DataFrame) -> DataFrame:
    """With `held_out`: crc32 of the doc_id as text leaves 0 when divided by 10 (false for a null doc_id)."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False)))


def language_model_scores(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Train on the rows that are not held out, score all."""
    folded = held_out(docs.select("doc_id", "text"))
    return scored(folded, train(folded.where("not held_out"), s), s)
