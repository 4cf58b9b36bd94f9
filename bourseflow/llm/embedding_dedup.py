"""Near-duplicate embeddings by cross-polytope hashing.

A vector is rotated by sign flips and fast Hadamard transforms, three times over, and hashes to the signed axis nearest to it;
several such hashes make the bucket of one table. Each table also posts a vector under the next best buckets (multiprobe). Vectors that
meet in a bucket are compared exactly, in blocks: a bucket of any size is cut into blocks of bounded size and every task compares two
blocks. A pair counts in the first bucket it shares and nowhere else, so links are counted without writing pairs down; what leaves a
task is a number of links per vector and a spanning forest of its blocks.

Equal vectors are one class with a weight. The number of hashes in a table follows the number of vectors, so that buckets keep
their size as the table grows; the number of tables follows the hashes, so that the recall of a pair at the threshold stays (`plan`).

Defined results: a vector that is null, empty, zero or holds null or non-finite components links with nothing; vectors of different
lengths do not link; a null vec_id links with nothing, has a null component and is kept; rows that repeat vec_id and vector are
copies of one row and count once; an empty table gives no rows. Extra columns are ignored."""
from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from bourseflow.llm.common import U, components, mix, stored


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.95
    tables: int = 10                 # at least
    recall: float = 0.99             # of a pair exactly at the threshold
    probes: int = 4                  # buckets of a table that a vector is posted under
    block: int = 512                 # vectors compared with as many others at once
    seed: int = 8


def width_of(d: int) -> int:
    """Components after padding: a power of two, and enough of them that sign flips give many different rotations."""
    return max(16, 1 << int(np.ceil(np.log2(d))))


def hashes_for(vectors: int, width: int, s: Settings) -> int:
    """Axes in a bucket: enough that an unrelated vector is met less than once over all tables and probes."""
    meetings = max(vectors, 2) * s.probes ** 2 * s.tables
    return max(2, int(np.ceil(np.log(meetings) / np.log(2 * width))))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (the width is a power of two), scaled to keep lengths."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def buckets(vectors: np.ndarray, s: Settings, hashes: int) -> np.ndarray:
    """Keys of shape (vectors, tables, probes), best first."""
    n, d = vectors.shape
    width = width_of(d)
    padded = np.zeros((n, width))
    padded[:, :d] = vectors
    rng = np.random.default_rng([s.seed, d])
    out = np.empty((n, s.tables, s.probes), np.uint64)
    near = min(s.probes, 2 * width)
    for t in range(s.tables):
        key, cost = np.full((n, 1), U(0x1234 + t)), np.zeros((n, 1))
        for h in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            both = np.concatenate([y, -y], axis=1)
            axis = np.argpartition(-both, near - 1, axis=1)[:, :near]
            height = np.take_along_axis(both, axis, axis=1)
            loss = (both.max(axis=1, keepdims=True) - height) ** 2
            # the best combinations so far with the nearest axes of this hash
            all_cost = (cost[:, :, None] + loss[:, None, :]).reshape(n, -1)
            all_key = mix(key[:, :, None] * U(0x9E3779B97F4A7C15) + axis[:, None, :].astype(np.uint64) + U(1)).reshape(n, -1)
            best = np.argsort(all_cost, axis=1, kind="stable")[:, :s.probes]
            cost, key = np.take_along_axis(all_cost, best, axis=1), np.take_along_axis(all_key, best, axis=1)
        out[:, t] = key if key.shape[1] == s.probes else np.repeat(key[:, :1], s.probes, axis=1)
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return pa.compute.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _normal(x: np.ndarray) -> np.ndarray:
    """Unit length without overflow or underflow on the way."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def meets(d: int, s: Settings, hashes: int) -> tuple[float, int]:
    """How often a pair of random vectors at the threshold cosine shares a bucket of one table, and how many times that was tried."""
    n = min(max(256, 2**15 // d), 2048)
    rng = np.random.default_rng([s.seed, d])
    a, b = (_normal(rng.normal(size=(n, d))) for _ in range(2))
    if d > 1:
        b = s.cosine * a + np.sqrt(1 - s.cosine ** 2) * _normal(b - (a * b).sum(axis=1, keepdims=True) * a)
    else:
        b = a
    x, y = buckets(a, s, hashes), buckets(b, s, hashes)
    return float((x[:, :, :, None] == y[:, :, None, :]).any(axis=(2, 3)).mean()), n * x.shape[1]


def plan(vectors: int, d: int, s: Settings) -> tuple[Settings, int]:
    """Tables and hashes for a number of vectors of d components.

    The share p of meetings in one table is measured on random pairs at the threshold and lowered by two standard errors; tables have rotations of
    their own, so 1 - (1 - p)^tables is set to the recall asked for. Vectors of less than eight components have few different
    rotations and fall short of it somewhat. More tables mean more meetings of unrelated vectors, for which the hashes are
    computed again until both agree."""
    width = width_of(d)
    hashes = hashes_for(vectors, width, s)
    while True:
        p, tried = meets(d, s, hashes)
        low = min(max(p - 2 * np.sqrt(max(p * (1 - p), 1 / tried) / tried), 1e-3), 1 - 1e-9)
        tables = max(s.tables, int(np.ceil(np.log(1 - s.recall) / np.log(1 - low))))
        more = hashes_for(vectors, width, replace(s, tables=tables))
        if more <= hashes:
            return replace(s, tables=tables), hashes
        hashes = more


def hashed(classes: DataFrame, s: Settings, hashes: int) -> DataFrame:
    """The classes with `keys`: all their buckets, table by table."""
    def run(batches):
        for b in batches:
            size = pa.compute.list_value_length(b.column("embedding")).to_numpy(zero_copy_only=False)
            for width in np.unique(size):
                rows = b.filter(pa.array(size == width))
                key = buckets(_normal(matrix(rows.column("embedding"), int(width))), s, hashes).reshape(len(rows), -1)
                at = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * key.shape[1])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(at, pa.array(key.ravel().view(np.int64)))],
                                                 [*rows.schema.names, "keys"])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    return classes.mapInArrow(run, f"{fields}, keys array<long>")


def meeting_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bucket in which each pair counts: the smallest shared key of the first table in which they share one.

    a, b: keys of shape (pairs, tables, probes)."""
    out, todo = np.zeros(len(a), np.int64), np.arange(len(a))
    for t in range(a.shape[1]):
        same = a[todo, t][:, :, None] == b[todo, t][:, None, :]
        hit = same.any(axis=(1, 2))
        out[todo[hit]] = np.where(same[hit], a[todo[hit], t][:, :, None], np.iinfo(np.int64).max).min(axis=(1, 2))
        todo = todo[~hit]
        if not len(todo):
            break
    return out


def _forest(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that each vector reaches by links inside these blocks."""
    label = ids.copy()
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (least == label).all():
            return label
        label = least


def compare(pairs: DataFrame, s: Settings) -> DataFrame:
    """pairs: (key, x, y, side, id, weight, embedding, keys), the rows of two blocks x <= y of one bucket. Links and forest by vector."""
    def run(group: pa.Table) -> pa.Table:
        key = group["key"][0].as_py()
        x, y = group["x"][0].as_py(), group["y"][0].as_py()
        group = group.combine_chunks()
        size = pa.compute.list_value_length(group["embedding"]).to_numpy()
        found = []
        for width in np.unique(size):
            rows = group.filter(pa.array(size == width))
            ids, weight, side = (rows[c].to_numpy() for c in ("id", "weight", "side"))
            unit = _normal(matrix(rows["embedding"].combine_chunks(), int(width)))
            left, right = (np.arange(len(ids)),) * 2 if x == y else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            near = unit[left] @ unit[right].T >= s.cosine
            near &= ids[left][:, None] != ids[right][None, :]
            if x == y:
                near = np.triu(near | near.T, 1)
            i, j = np.nonzero(near)
            if not len(i):
                continue
            keys = rows["keys"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), s.tables, -1)
            first = np.concatenate([meeting_keys(keys[left[i[k:k + 20_000]]], keys[right[j[k:k + 20_000]]]) == key
                                    for k in range(0, len(i), 20_000)])
            i, j = i[first], j[first]
            if len(i):
                found.append((ids, weight, left[i], right[j]))
        out = {"id": [], "links": [], "root": []}
        for ids, weight, i, j in found:
            n = np.zeros(len(ids), np.int64)
            np.add.at(n, i, weight[j])
            np.add.at(n, j, weight[i])
            used = np.unique(np.concatenate([i, j]))
            linked = np.zeros((len(used), len(used)), bool)
            a, b = np.searchsorted(used, i), np.searchsorted(used, j)
            linked[a, b] = linked[b, a] = True
            out["id"].append(ids[used])
            out["links"].append(n[used])
            out["root"].append(_forest(linked, ids[used]))
        return pa.table({c: pa.array(np.concatenate(v) if v else np.empty(0, np.int64), pa.int64()) for c, v in out.items()})
    return pairs.groupBy("key", "x", "y").applyInArrow(run, "id long, links long, root long")


def near_duplicates(vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per row: vec_id, n_links, component_id (smallest vec_id reachable by links), kept."""
    e = F.col("embedding")
    fine = F.coalesce(F.size(e) > 0, F.lit(False)) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) \
        & F.exists(e, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn(
        "fine", F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())
    rows = rows.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(s.seed), "embedding"))
    classes = stored(rows.where("fine").dropDuplicates(["vec_id", "h1", "h2"]).groupBy("h1", "h2").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding")), "vector-classes")
    n = classes.count()
    width = classes.agg(F.max(F.size("embedding"))).first()[0] or 1
    s, hashes = plan(n, int(width), s)
    classes = stored(hashed(classes, s, hashes), "hashed-vectors")
    keys = classes.select("id", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
    blocks = F.ceil(F.col("n") / s.block).cast("int")
    held = keys.join(sizes, "key").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # every vector goes to all pairs of blocks that hold its own
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = held.select("key", "id", "own", other.alias("o")).select(
        "key", "id", F.least("own", "o").alias("x"), F.greatest("own", "o").alias("y"), F.when(F.col("own") <= F.col("o"), 0).otherwise(1).alias("side"))
    compared = stored(compare(spread.join(classes.select("id", "weight", "embedding", "keys"), "id"), s), "block-links")
    links = compared.groupBy("id").agg(F.sum("links").alias("links"))
    linked = components(compared.select(F.col("id").alias("a"), F.col("root").alias("b")))
    found = stored(classes.select("h1", "h2", "id", "weight").join(links, "id", "left").join(linked, F.col("id") == F.col("node"), "left")
                   .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                           F.coalesce("component", "id").alias("component_id")), "vector-links")
    good = rows.where("fine").select("vec_id", "h1", "h2").join(found, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
