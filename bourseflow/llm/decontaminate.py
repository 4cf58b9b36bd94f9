"""Benchmark decontamination: rare n-gram seeds join training passages to test items, local alignment scores the copies found.

Words are compared in lower case without punctuation at their ends. Every item gives its n-grams as seeds, but for common ones: a
seed stays if words in the corpus are so rare that it meets by chance in fewer than `chance` of all places, and the rarest half of an
item's n-grams stay in any case. Rarity is judged from word frequencies, not from how often the n-gram occurs, so an item copied into
millions of documents keeps its seeds. An item of m words of which at least 80 % stay in order keeps a run of three words (m >= 15), so
seeds of three words miss no such copy but for dropped common seeds.

1. Items, their words and seeds are tables. The corpus frequencies of the items' words come from one scan of the documents.
2. A second scan cuts the passages around places whose n-gram may be a seed. A bitmap of the seeds' hashes, of bounded size however
   many items there are, keeps other n-grams from being written; what passes it by chance falls out of the join.
3. The distinct n-grams of the passages are joined with the seeds; each pair of passage and item is aligned once, pairs dealt evenly.

Around each seed that a passage shares with an item, a window is aligned with the item (match 1, mismatch and gap -1): once locally
(Smith-Waterman), and once over the item from its first word to its last, with free ends in the window. The similarity is the share of
the item's words matched by the better of the two. The whole alignment matches at least the words that stay in order in any copy with
words replaced or left out, so an edit near an end does not cost the words beyond it; words put in count against a copy only where they
part off fewer than half as many of the item's words. Items of three or four words are found as unbroken exact copies only.

Items with equal texts are aligned as one. Nothing of the items is on the driver but the two bitmaps.

Defined results: null or empty texts and items match nothing; an item of fewer than `least_words` words (one or two, which ordinary
text holds by chance) is not looked for; repeated items are one per row with their own item_id; repeated documents are one per row; a
null doc_id is reported as null; an empty benchmark or table gives no pairs and drops nothing. Extra columns are ignored by
`contaminated` and kept by `clean`, which drops every row whose text is that of a document found."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from bourseflow.llm.common import as_long, shingle_hashes, slices, stored

MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’…–—¿¡"

#: Items of fewer words are found only as unbroken exact copies.
EXACT_BELOW = 5
#: Pairs of passage and item that one task aligns.
TASK_PAIRS = 2_000


@dataclass(frozen=True)
class Settings:
    seed_words: int = 3
    similarity: float = 0.8          # least share of the item's words that an alignment matches
    chance: float = 1e-8             # greatest chance of a seed at one place
    least_words: int = 3             # of an item; never fewer than seed_words
    filter_bits: int = 1 << 27       # most bits of a filter that goes to the tasks (16 MB), a power of two


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and word hashes of each text, in lower case and without marks at their ends; bare marks are no words."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    parent, words = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False), pc.list_flatten(parts)
    coded = words.dictionary_encode()
    plain = pc.utf8_trim(pc.utf8_lower(coded.dictionary), MARKS).to_pylist()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) if w else 0 for w in plain), np.uint64, len(plain))
    h = table[coded.indices.to_numpy(zero_copy_only=False)] if len(plain) else np.empty(0, np.uint64)
    full = h != 0
    n = np.bincount(parent[full], minlength=len(texts)) if full.any() else np.zeros(len(texts), np.int64)
    return np.concatenate([[0], np.cumsum(n)]).astype(np.int64), h[full]


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: matched words, first and last place in the window (0, 0, -1: nothing).

    Of equally good alignments the one that ends first counts."""
    m, n = len(item), len(window)
    score = np.zeros((m + 1, n + 1), np.int32)
    step = np.arange(n + 1)
    equal = np.where(item[:, None] == window[None, :], 1, -1)
    for i in range(1, m + 1):
        row = np.maximum(score[i - 1] - 1, 0)
        row[1:] = np.maximum(row[1:], score[i - 1, :-1] + equal[i - 1])
        score[i] = np.maximum.accumulate(row + step) - step          # gaps in the item, one word after another
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    matched, last = 0, int(j) - 1
    while i and j and score[i, j] > 0:
        if score[i, j] == score[i - 1, j - 1] + equal[i - 1, j - 1]:
            matched += int(equal[i - 1, j - 1] == 1)
            i, j = i - 1, j - 1
        elif score[i, j] == score[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return matched, int(j), last


def align_whole(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best alignment of all words of the item with a part of the window: matched words, first and last matched place (0, 0, -1: nothing).

    Of equally good alignments one with the most matched words counts; its share of the item is never below that of a copy in the
    window that replaces or leaves out words."""
    m, n = len(item), len(window)
    unit = m + 1                                                     # one point of score; below it the matched words count
    score = np.zeros((m + 1, n + 1), np.int64)
    score[:, 0] = -unit * np.arange(m + 1)
    step = unit * np.arange(n + 1)
    equal = np.where(item[:, None] == window[None, :], unit + 1, -unit)
    for i in range(1, m + 1):
        row = score[i - 1] - unit
        row[1:] = np.maximum(row[1:], score[i - 1, :-1] + equal[i - 1])
        score[i] = np.maximum.accumulate(row + step) - step
    i, j, found = m, int(score[m].argmax()), []
    while i and j:
        if score[i, j] == score[i - 1, j - 1] + equal[i - 1, j - 1]:
            if equal[i - 1, j - 1] > 0:
                found.append(j - 1)
            i, j = i - 1, j - 1
        elif score[i, j] == score[i - 1, j] - unit:
            i -= 1
        else:
            j -= 1
    return (len(found), found[-1], found[0]) if found else (0, 0, -1)


def copied(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """The better of the local and the whole alignment (the local one of equally good ones)."""
    return max(align(item, window), align_whole(item, window), key=lambda x: x[0])


def bit_filter(keys: DataFrame, most: int) -> np.ndarray:
    """Bitmap of the 64-bit hashes in column `key`, at most `most` bits: no key fails it, few other values pass."""
    bits = min(most, max(64, 1 << (16 * keys.count()).bit_length()))
    slot = F.col("key").bitwiseAND(F.lit(bits - 1))
    rows = keys.groupBy(F.floor(slot / 32768).alias("part")).agg(F.bitmap_construct_agg(slot % 32768).alias("bits")).collect()      # bits / 32768 rows of 4 KB
    out = np.zeros(max(bits, 32768) // 8, np.uint8)
    for r in rows:
        out[r["part"] * 4096:(r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out[:max(bits // 8, 1)]


def passing(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def hashes_of(cell: bytes) -> np.ndarray:
    return np.frombuffer(cell, np.uint64)


def item_table(bench: DataFrame, s: Settings) -> DataFrame:
    """Distinct item texts that are long enough: item, text, words (their hashes)."""
    least = max(s.least_words, s.seed_words)

    def run(batches):
        for batch in batches:
            at, h = plain_words(batch.column("text"))
            keep = np.flatnonzero(np.diff(at) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("text").take(pa.array(keep)), pa.array([h[at[k]:at[k + 1]].tobytes() for k in keep], pa.binary())],
                                             ["text", "words"])
    texts = bench.select("text").where("text is not null").distinct().mapInArrow(run, "text string, words binary")
    return stored(texts.withColumn("item", F.monotonically_increasing_id()), "items")


def word_counts(docs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """Occurrences in the corpus of the words (hashes) in `wanted.word`: word, n; the row without a word holds the number of all words."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(F.col("word").alias("key")), s.filter_bits))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                h = plain_words(batch.column("text"))[1]
                word, n = np.unique(h[passing(shared.value, h)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([*word.view(np.int64).tolist(), None], pa.int64()), pa.array(np.append(n, len(h)).astype(np.int64))], ["word", "n"])
    return stored(docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "item-words")


def seeded(docs: DataFrame, items: DataFrame, s: Settings) -> DataFrame:
    """The items with the places of their seeds and the seeds themselves: item, words, places, seeds."""
    def own_words(batches):
        for batch in batches:
            for item, cell in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist()):
                h = np.unique(hashes_of(cell))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), item, np.int64)), as_long(h)], ["item", "word"])
    own = items.select("item", "words").mapInArrow(own_words, "item long, word long")
    counts = word_counts(docs, own.select("word").distinct(), s)
    total = counts.where("word is null").agg(F.sum("n")).first()[0] or 0
    # the distinct words of one item
    known = own.join(counts, "word", "left").groupBy("item").agg(F.collect_list(F.struct("word", F.coalesce("n", F.lit(0)).alias("n"))).alias("known"))
    size, chance = s.seed_words, s.chance

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "words")):
            rows = []
            for item, cell, known in zip(*(batch.column(c).to_pylist() for c in ("item", "words", "known"))):
                w = hashes_of(cell)
                n = {k["word"]: k["n"] for k in known}
                share = (np.array([n[int(x)] for x in w.view(np.int64)], float) + 1) / (total + 1)
                rare = np.convolve(np.log(share), np.ones(size), "valid")
                places = np.flatnonzero((rare <= np.log(chance)) | (rare <= np.median(rare)))
                grams = shingle_hashes(np.array([0, len(w)]), w, size)[1][places]
                rows.append((item, cell, places.tolist(), np.unique(grams).view(np.int64).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(
                (pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())))], ["item", "words", "places", "seeds"])
    rated = items.select("item", "words").join(known, "item").select("item", "words", "known")
    return stored(rated.mapInArrow(run, "item long, words binary, places array<int>, seeds array<long>"), "item-seeds")


def passages(docs: DataFrame, seeds: DataFrame, longest: int, s: Settings) -> DataFrame:
    """Passages around n-grams that may be seeds: passage, row (of the document row), text_key, doc_id, first (word), words, seeds.

    A passage reaches as far as any window of an item around its n-grams; reaches that overlap are one passage."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(seeds.select(F.col("seed").alias("key")), s.filter_bits))
    size, reach = s.seed_words, longest + longest // 2 + 8

    def run(batches):
        part, count = TaskContext.get().partitionId() << 40, 0
        for whole in batches:
            for batch in slices(whole, "text"):
                at, h = plain_words(batch.column("text"))
                grams_at, grams = shingle_hashes(at, h, size)
                place = np.flatnonzero(passing(shared.value, grams))
                of = np.searchsorted(grams_at, place, "right") - 1
                rows, source = [], []
                for d in np.unique(of):
                    hits = place[np.searchsorted(of, d):np.searchsorted(of, d, "right")] - grams_at[d]
                    words, own = h[at[d]:at[d + 1]], grams[grams_at[d]:grams_at[d + 1]]
                    for near in np.split(hits, np.flatnonzero(np.diff(hits) > 2 * reach) + 1):
                        lo = max(0, int(near[0]) - reach)
                        rows.append((part + count + int(d), lo, words[lo:int(near[-1]) + reach].tobytes(), np.unique(own[near]).view(np.int64).tolist()))
                        source.append(d)
                count += batch.num_rows
                take = pa.array(source, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("text_key").take(take), batch.column("doc_id").take(take), *(
                    pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))))],
                    ["text_key", "doc_id", "row", "first", "words", "seeds"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.md5("text").alias("text_key")).mapInArrow(
        run, f"text_key string, doc_id {kind}, row long, first long, words binary, seeds array<long>")
    return stored(rows.withColumn("passage", F.monotonically_increasing_id()), "passages")


def windows(item: np.ndarray, places: list[int], words: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Parts of a passage around the n-grams it shares with the item's seeds."""
    m = len(item)
    slack, done = m // 4 + 2, None
    grams = shingle_hashes(np.array([0, len(words)]), words, size)[1]
    order = np.argsort(grams, kind="stable")
    own = shingle_hashes(np.array([0, m]), item, size)[1][places]
    left, right = (np.searchsorted(grams, own, side, sorter=order) for side in ("left", "right"))
    starts = np.empty(0, np.int64)
    for place, a, b in zip(places, left, right):
        if b > a:
            starts = np.union1d(starts, order[a:b] - place)
    for start in starts.tolist():
        if done is None or start - done > slack // 2:                  # else the window before reaches over this one
            done = start
            yield max(0, start - slack), min(len(words), start + m + 2 * slack)


def best_copy(item: np.ndarray, places: list[int], words: np.ndarray, s: Settings, cache: dict, name: int) -> tuple[int, int, int] | None:
    """Matched words, first and last place of the best copy of the item in a passage, if it is similar enough."""
    m, best = len(item), None
    for lo, hi in windows(item, places, words, s.seed_words):
        window = words[lo:hi]
        key = (name, window.tobytes())
        if key not in cache:
            if len(cache) > 5_000:
                cache.clear()
            # no alignment matches more words than occur in the window
            enough = np.isin(item, window).sum() >= s.similarity * m
            cache[key] = copied(item, window) if enough else (0, 0, -1)
        matched, first, last = cache[key]
        if matched >= s.similarity * m and matched > (best or (0,))[0] and (m >= EXACT_BELOW or last - first + 1 == matched == m):
            best = matched, lo + first, lo + last
    return best


def copies(docs: DataFrame, bench: DataFrame, s: Settings) -> DataFrame | None:
    """The best copy of each distinct item text in each document row: row, text_key, doc_id, text (of the item), b.matched, b.first, b.last, size."""
    items = item_table(bench, s)
    longest = items.agg(F.max(F.length("words"))).first()[0]
    if longest is None:
        return None
    table = seeded(docs, items, s)
    seeds = table.select("item", F.explode("seeds").alias("seed"))
    found = passages(docs, seeds, longest // 8, s)
    pairs = stored(found.select("passage", F.explode("seeds").alias("seed")).join(seeds, "seed").select("passage", "item").distinct(), "passage-items")
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, pairs.count() // TASK_PAIRS + 1)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        cache: dict = {}
        for batch in (part for whole in batches for part in slices(whole, "words")):
            rows, source = [], []
            for k, (item, own, places, words, first) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("item", "own", "places", "words", "first")))):
                best = best_copy(hashes_of(own), places, hashes_of(words), s, cache, item)
                if best is not None:
                    rows.append((item, best[0], len(own) // 8, first + best[1], first + best[2]))
                    source.append(k)
            take = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("row", "text_key", "doc_id")), *(
                pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())))],
                ["row", "text_key", "doc_id", "item", "matched", "size", "first", "last"])
    both = (pairs.join(found.drop("seeds"), "passage").join(table.select("item", F.col("words").alias("own"), "places"), "item")
            .repartition(tasks, "passage", "item"))                  # little data and much work: not to be put together by its bytes
    aligned = both.mapInArrow(run, f"row long, text_key string, doc_id {kind}, item long, matched int, size int, first int, last int")
    best = F.max(F.struct("matched", (-F.col("first")).alias("before"), F.col("last")))
    best = aligned.groupBy("row", "text_key", "doc_id", "item", "size").agg(best.alias("b"))
    return stored(best.join(items.select("item", "text"), "item").select(
        "row", "text_key", "doc_id", "text", "size", "b.matched", (-F.col("b.before")).alias("first"), "b.last"), "copies")


def contaminated(docs: DataFrame, bench: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per document row and item found in it: doc_id, item_id, similarity, matched_words, item_words, first_word, last_word."""
    found = copies(docs.select("doc_id", "text"), bench, s)
    kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, "doc_id"), (bench, "item_id")))
    if found is None:
        return docs.sparkSession.createDataFrame(
            [], f"doc_id {kind}, item_id {item_kind}, similarity double, matched_words int, item_words int, first_word int, last_word int")
    return found.join(bench.select("item_id", "text"), "text").select(
        "doc_id", "item_id", (F.col("matched") / F.col("size")).alias("similarity"), F.col("matched").alias("matched_words"), F.col("size").alias("item_words"),
        F.col("first").alias("first_word"), F.col("last").alias("last_word"))


def clean(docs: DataFrame, bench: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents in which no item is found; all columns are kept."""
    found = copies(docs.select("doc_id", "text"), bench, s)
    if found is None:
        return docs
    gone = found.select("text_key").distinct()
    return docs.join(gone, F.md5(docs["text"]) == gone["text_key"], "left_anti")
