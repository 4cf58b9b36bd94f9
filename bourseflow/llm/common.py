"""Helpers shared by the corpus operators: stored steps, words in Arrow batches, connected components."""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bourseflow.session import checkpoint_dir

#: Texts handled at once inside a task, in characters (a single longer text is handled alone).
SLICE_CHARS = 1_000_000

U = np.uint64
MIX_1, MIX_2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for each call, in the folder that all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/bourseflow-llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back: lineage ends here, and a lost executor repeats only the scan."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most: int) -> DataFrame:
    """Broadcast hint only if a count of `df` (a stored step) shows at most `most` rows; beyond that the join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def by_hash(share: float, *columns) -> Column:
    """True for about `share` of the values of the columns, chosen by 63 bits of a hash: fine enough for any number of rows."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1) <= F.lit(min(int(share * 2**63), 2**63 - 1))


def sampled(rows: DataFrame, share: float, *columns: str) -> DataFrame:
    """About `share` of the rows by a hash of the columns, each distinct row once, so that copies of one text do not fill the sample;
    all rows where the sample holds the whole table. An error if rows exist and none was chosen: a model that learnt nothing would judge everything alike."""
    if share >= 1:
        return rows
    out = rows.where(by_hash(share, F.lit("sample"), *columns)).dropDuplicates()
    if out.isEmpty() and not rows.isEmpty():
        raise ValueError("no labelled row was chosen to learn from: the sample is too small for this table")
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> U(31))
    x = x * MIX_1
    x = x ^ (x >> U(29))
    x = x * MIX_2
    return x ^ (x >> U(32))


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about SLICE_CHARS at most."""
    n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, k in enumerate(n):
        if total and total + k > SLICE_CHARS:
            yield batch.slice(start, i - start)
            pa.default_memory_pool().release_unused()         # what the last part needed goes back to the machine
            start, total = i, 0
        total += int(k)
    if start < batch.num_rows:
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def ascii_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text, A-Z in lower case.

    Returns offsets (one more than texts; null texts have no words) and the words of all texts in order."""
    texts = pc.fill_null(texts, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    parent = pc.list_parent_indices(parts)
    words = pc.list_flatten(parts)
    full = pc.greater(pc.binary_length(words), 0)
    words, parent = words.filter(full), parent.filter(full)
    counts = np.bincount(parent.to_numpy(zero_copy_only=False), minlength=len(texts)) if len(words) else np.zeros(len(texts), np.int64)
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), words


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word; each distinct word of the batch is hashed once."""
    if not len(words):
        return np.empty(0, np.uint64)
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return table[coded.indices.to_numpy(zero_copy_only=False)]


def shingle_hashes(offsets: np.ndarray, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams of each text in order; a text with 1 to size-1 words counts as one n-gram.

    Returns offsets and hashes."""
    n = np.diff(offsets)
    short = (n > 0) & (n < size)
    counts = np.where(n >= size, n - size + 1, short.astype(n.dtype))
    out_offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    out = np.empty(int(out_offsets[-1]), np.uint64)
    if len(words) >= size:
        h = np.zeros(len(words) - size + 1, np.uint64)
        for i in range(size):
            h = mix(h + words[i:len(words) - size + 1 + i] + U(i + 1))
        doc = np.repeat(np.arange(len(n)), np.where(n >= size, counts, 0))
        within = np.arange(len(doc)) - np.repeat((np.cumsum(np.where(n >= size, counts, 0)) - np.where(n >= size, counts, 0)),
                                                  np.where(n >= size, counts, 0))
        out[out_offsets[doc] + within] = h[offsets[doc] + within]
    for d in np.flatnonzero(short):
        h = np.zeros(1, np.uint64)
        for k in range(int(n[d])):
            h = mix(h + words[offsets[d] + k] + U(k + 1))
        out[out_offsets[d]] = mix(h + U(0x51))[0]
    return out_offsets, out


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """Connected components of an edge list (a long, b long): rows (node, component) for every node that has an edge.

    Alternating large-star and small-star steps: each node's neighbours are hung on the smallest one, until all that is left
    are stars around the smallest node. Every step is two map-side combined minima and joins whose two sides are shuffled
    plainly, so a hub of any degree can be split; each step is stored in the shared folder."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    seen = None
    for _ in range(rounds):
        print_of = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if print_of == seen or not print_of[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select("v", "v").distinct()) if print_of[0] else now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = print_of
        both = now.select("u", "v").union(now.select("v", "u").toDF("u", "v"))
        least = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), name)
        large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), name)
        hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(hung.union(least.select("u", "m").toDF("u", "v")).distinct(), name)
    raise RuntimeError(f"no fixed point after {rounds} rounds")
