"""Language of a text by word-first backoff.

A word of the learned vocabulary scores by its log relative frequency in each language. A word outside it falls back to its
character n-grams: the longest length of which any n-gram is known gives the score (mean over the known ones of that length), then
the next shorter one, down to single letters. Evidence is taken relative to the mean of the languages, so a common word and a rare
word count by how well they tell languages apart.

Learning uses a sample of labelled rows bounded by `sample_rows` (different texts, chosen by a hash over the whole table), and
vocabularies bounded by `words` and `grams`: the model has a fixed greatest size, which is why it may be broadcast. Prediction reads
whole texts and nothing but the text.

Defined results: null text or a text without letters: `und` with score 0; nothing to learn from: `und` for all; a text whose
letters tell nothing: the most frequent language with its share as score; ties go to the first name. Extra columns are
ignored by `predict`; `accepted` keeps them. Empty tables give no rows."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from bourseflow.llm.common import MIX_1, U, mix, sampled, slices, stored

#: What stands between words: anything but letters.
GAP = r"[^\pL]+"


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 8_000         # labelled rows to learn from, about
    words: int = 50_000              # vocabulary, most frequent first
    grams: int = 20_000              # n-grams kept of each length
    longest: int = 5                 # letters
    least_count: int = 2             # of a word or n-gram
    smoothing: float = 0.5
    languages: int = 500             # labels beyond the most frequent ones are not learned
    least_score: float = 0.5         # a document below is rejected


@dataclass
class Table:
    """Scores by key: sorted hashes of the keys and a row of log frequencies (relative to the languages' mean) for each."""
    keys: np.ndarray
    scores: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where it is not known."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)


def word_keys(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def gram_keys(codes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` letters from each place on."""
    h = np.zeros(max(0, len(codes) - length + 1), np.uint64)
    for k in range(length):
        h = (h + codes[k:k + len(h)] + U(k + 1)) * MIX_1
        h ^= h >> U(29)
    return mix(h)


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words with a blank at both ends as one array of code points, and where each begins (and the last ends)."""
    codes = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return codes, np.concatenate([[0], np.cumsum(np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))])


@dataclass
class Model:
    names: list[str]
    prior: np.ndarray
    words: Table
    grams: dict[int, Table]          # by length

    def of_words(self, words: list[str]) -> np.ndarray:
        """Scores of different words, one row each: of the word itself, else of the longest length of which an n-gram is known."""
        row = self.words.find(word_keys(words))
        out = np.zeros((len(words), len(self.names)))
        out[row >= 0] = self.words.scores[row[row >= 0]]
        todo = np.flatnonzero(row < 0)
        if len(todo):
            codes, at = letters([words[k] for k in todo])
            size, left = np.diff(at), np.arange(len(todo))
            for length in sorted(self.grams, reverse=True):
                n = np.maximum(size[left] - length + 1, 0)
                of = np.repeat(np.arange(len(left)), n)
                place = np.repeat(at[left] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                row = self.grams[length].find(gram_keys(codes, length)[place])
                of, row = of[row >= 0], row[row >= 0]
                known = np.bincount(of, minlength=len(left))
                done = known > 0
                for k in range(len(self.names)):
                    total = np.bincount(of, self.grams[length].scores[row, k], minlength=len(left))
                    out[todo[left[done]], k] = total[done] / known[done]
                left = left[~done]
                if not len(left):
                    break
        return out

    def scores(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        parts = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), GAP)
        parent, words = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False), pc.list_flatten(parts)
        full = pc.greater(pc.binary_length(words), 0)
        parent, coded = parent[full.to_numpy(zero_copy_only=False)], words.filter(full).dictionary_encode()
        pred, score = np.full(len(texts), -1), np.zeros(len(texts))
        if self.names and len(parent):
            each = self.of_words(coded.dictionary.to_pylist())
            first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
            total = np.add.reduceat(each[coded.indices.to_numpy(zero_copy_only=False)], first, axis=0) + np.log(self.prior)
            best = total.argmax(axis=1)
            pred[parent[first]] = best
            score[parent[first]] = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.names[k] if k >= 0 else "und" for k in pred], score


def _table(counts: DataFrame, key: str, most: int, s: Settings) -> DataFrame:
    """The `most` most frequent keys with their counts by language."""
    summed = counts.groupBy(key).agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    return summed.where(F.col("n") >= s.least_count).orderBy(F.desc("n"), key).limit(most)


def learn(labelled: DataFrame, s: Settings = Settings()) -> Model:
    """Count words and n-grams of labelled rows (text, lang) in Spark; rows without text or label teach nothing."""
    rows = labelled.select("text", "lang").where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang")
              .limit(s.languages).collect()}
    names = sorted(counts)
    if not names:
        return Model([], np.empty(0), Table(np.empty(0, np.uint64), np.empty((0, 0))), {})
    share = min(1.0, s.sample_rows / sum(counts.values()))
    chosen = sampled(rows.where(F.col("lang").isin(names)), share, "text")
    words = chosen.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    words = stored(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "language-words")
    padded = F.concat(F.lit(" "), "word", F.lit(" "))

    def scored(found: list, keys: np.ndarray) -> Table:
        n = np.array([[r["by"].get(x, 0) for x in names] for r in found], float).reshape(len(found), len(names))
        v = np.log((n + s.smoothing) / (n.sum(axis=0) + s.smoothing * (len(found) + 1)))
        order = np.argsort(keys)
        return Table(keys[order], (v - v.mean(axis=1, keepdims=True))[order])
    found = _table(words, "word", s.words, s).collect()                                 # at most s.words rows
    known, grams = scored(found, word_keys([r["word"] for r in found])), {}
    for length in range(s.longest, 0, -1):
        at = F.sequence(F.lit(1), F.length(padded) - length + 1)
        cut = words.where(F.length(padded) >= length).select(
            "lang", "n", F.explode(F.transform(at, lambda i: F.substring(padded, i, F.lit(length)))).alias("gram"))
        found = _table(cut.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "gram", s.grams, s).collect()
        codes = np.frombuffer("".join(r["gram"] for r in found).encode("utf-32-le"), np.uint32).astype(np.uint64)
        grams[length] = scored(found, gram_keys(codes, length)[::length] if found else np.empty(0, np.uint64))
    prior = np.array([counts[x] for x in names], float)
    return Model(names, prior / prior.sum(), known, grams)


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """One row per row: doc_id, the columns of `keep`, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)             # at most words + longest * grams entries
    names = ["doc_id", *keep]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "_text"):
                pred, score = shared.value.scores(batch.column("_text"))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(pred, pa.string()), pa.array(score)],
                                                 [*names, "lang_pred", "score"])
    rows = docs.select(*names, F.col("text").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema.fields)
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double")


def held_out(docs: DataFrame) -> DataFrame:
    """With `held_out`: crc32 of the doc_id as text leaves 2 when divided by 4 (false for a null doc_id)."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))


def identified(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Learn from the rows that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    folded = held_out(docs.select("doc_id", "text", "lang"))
    return predict(folded, learn(folded.where("not held_out"), s), "held_out")


def accepted(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents whose language is told with at least `least_score`; all columns are kept."""
    model = learn(held_out(docs.select("doc_id", "text", "lang")).where("not held_out"), s)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def told(texts: pd.Series) -> pd.Series:
        out = []
        for part in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), "text"):
            pred, score = shared.value.scores(part.column("text"))
            out += [x != "und" and y >= s.least_score for x, y in zip(pred, score)]
        return pd.Series(out, dtype=bool)
    return docs.where(told("text"))
