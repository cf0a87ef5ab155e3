"""Language identification with word-first backoff.

A known word scores its log frequency in each language. An unseen word falls back to its character 5-grams (word borders
included); where none of them is known to 4-grams, and so on down to single characters: the mean log frequency of those
known. A document's score for a language is the mean over its words, and the reported score the softmax of these means
times the number of words, at most SURE.

The model is fitted on a bounded sample of labelled documents (about DOCS_PER_LANGUAGE of each, chosen by the hash of their
id) and keeps at most WORDS words and GRAMS n-grams of each length, so its size does not grow with the corpus.

Defined cases: a text that is null or has no letter is `und` with score 0, and so is every text where no label was seen;
ties go to the language first in code point order; labels that are null teach nothing; rows with a null id teach nothing
and are not held out; repeated rows are predicted alike; a very long text is read whole, its distinct words scored once.
Further columns are carried, but for those named like a result.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import extended, plain_text, slices, table, tidy
from .words import spaced

DOCS_PER_LANGUAGE = 1000
WORDS, GRAMS, LONGEST = 200_000, 100_000, 5
#: Words that count towards certainty.
SURE = 20
UNKNOWN = "und"
#: Bytes of text scored at once.
SLICE = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def letters(word: str) -> list[str]:
    """The runs of letters of a lower-cased word. Number signs such as ½ or ² are none."""
    return [word] if word.isalpha() else "".join([c if c.isalpha() else " " for c in word]).split()


def _grams(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all character n-grams of the words with their borders, and the word of each."""
    text = "".join(f"\x02{w}\x03" for w in words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.flatnonzero(place + n <= lengths[owner])
    keys = np.zeros(len(at), np.uint64)
    for k in range(n):
        keys = (keys + points[at + k]) * _BASE
        keys ^= keys >> np.uint64(29)
    if n == 1:  # a border alone says nothing
        real = points[at] > 3
        at, keys = at[real], keys[real]
    return keys, owner[at]


class Model:
    """languages; log frequencies of words and n-grams, one column for each language."""

    def __init__(self, texts: dict[str, Counter]):
        self.languages = sorted(texts)
        totals = Counter()
        for c in texts.values():
            totals.update(c)
        kept = [w for w, n in sorted(totals.items(), key=lambda x: (-x[1], x[0]))[:WORDS] if n > 1]
        self.words = {w: i for i, w in enumerate(kept)}
        counts = np.array([[texts[g][w] for g in self.languages] for w in kept], float).reshape(len(kept), len(self.languages))
        sums = np.array([sum(texts[g].values()) for g in self.languages], float)
        self.word_logs = np.log((counts + 0.5) / (sums + 0.5 * max(1, len(kept))))
        self.grams = []
        for n in range(1, LONGEST + 1):
            keys, cols, weights = [], [], []
            for i, g in enumerate(self.languages):
                names = list(texts[g])
                k, owner = _grams(names, n)
                keys.append(k)
                cols.append(np.full(len(k), i))
                weights.append(np.fromiter((texts[g][w] for w in names), float, len(names))[owner])
            both = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            known, place = np.unique(both, return_inverse=True)
            table_ = np.zeros((len(known), len(self.languages)))
            if len(both):
                np.add.at(table_, (place, np.concatenate(cols)), np.concatenate(weights))
            often = np.argsort(-table_.sum(1), kind="stable")[:GRAMS]
            often = np.sort(often[table_[often].sum(1) > 1])
            self.grams.append((known[often], np.log((table_[often] + 0.5) / (table_.sum(0) + 0.5 * max(1, len(often))))))

    def backoff(self, words: list[str]) -> np.ndarray:
        """A row for each unseen word; zeros where not even a character is known."""
        out = np.zeros((len(words), len(self.languages)))
        left = np.arange(len(words))
        for n in range(LONGEST, 0, -1):
            known, logs = self.grams[n - 1]
            if not len(left) or not len(known):
                continue
            keys, owner = _grams([words[i] for i in left], n)
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = known[at] == keys
            at, owner = at[hit], owner[hit]
            n_hits = np.bincount(owner, minlength=len(left))
            found = n_hits > 0
            for c in range(out.shape[1]):
                sums = np.bincount(owner, weights=logs[at, c], minlength=len(left))
                out[left[found], c] = sums[found] / n_hits[found]
            left = left[~found]
        return out


class Scorer:
    """Applies a model, remembering the rows of words met, up to `memory` of them."""

    def __init__(self, model: Model, memory: int = 200_000):
        self.model, self.memory = model, memory
        self.index, self.rows = dict(model.words), model.word_logs

    def _rows(self, words: list[str]) -> np.ndarray:
        if len(self.index) > self.memory + len(self.model.words):
            self.index, self.rows = dict(self.model.words), self.model.word_logs
        place, new = np.empty(len(words), np.int64), []
        for i, w in enumerate(words):
            at = self.index.get(w)
            if at is None:
                at = self.index[w] = len(self.index)
                new.append(w)
            place[i] = at
        if new:
            self.rows = np.concatenate([self.rows, self.model.backoff(new)])
        return place

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text of a large_string array."""
        n, languages = len(texts), self.model.languages
        words = spaced(pc.utf8_lower(texts))
        owner, parts = [], []
        for i, w in enumerate(words.distinct):
            for x in letters(w):
                owner.append(i)
                parts.append(x)
        place, owner = self._rows(parts), np.array(owner, np.int64)
        doc = np.repeat(np.arange(n), np.diff(words.offsets))
        per_word = np.bincount(owner, minlength=len(words.distinct))
        count = np.bincount(doc, weights=per_word[words.index], minlength=n) if len(doc) else np.zeros(n)
        if not languages:
            return [UNKNOWN] * n, np.zeros(n)
        sums = np.zeros((n, len(languages)))
        for c in range(len(languages)):
            of_word = np.bincount(owner, weights=self.rows[place, c], minlength=len(words.distinct))
            if len(doc):
                sums[:, c] = np.bincount(doc, weights=of_word[words.index], minlength=n)
        means = sums / np.maximum(count, 1)[:, None] * np.minimum(count, SURE)[:, None]
        best = means.argmax(1)
        likely = np.exp(means - means.max(1, keepdims=True))
        score = likely.max(1) / likely.sum(1)
        none = count == 0
        return [UNKNOWN if z else languages[b] for z, b in zip(none, best, strict=True)], np.where(none, 0.0, score)


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = DOCS_PER_LANGUAGE) -> bytes:
    """A pickled Model, fitted in one executor task on the bounded sample."""
    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    share = known.groupBy(F.col(lang_col).alias("_g")).agg((F.lit(float(per_language)) / F.count(F.lit(1))).alias("_share"))
    chance = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(23)), 11) / F.lit(float(1 << 53))
    chosen = known.join(F.broadcast(share), F.col(lang_col) == F.col("_g")).where(chance < F.col("_share")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, Counter] = {}
        for whole in batches:
            for b in slices(whole, "text"):
                langs = np.array(b.column("lang").to_pylist(), object)
                words = spaced(pc.utf8_lower(plain_text(b.column("text"))))
                doc = np.repeat(np.arange(b.num_rows), np.diff(words.offsets))
                for g in set(langs.tolist()):
                    counts = np.bincount(words.index[langs[doc] == g], minlength=len(words.distinct)) if len(doc) else []
                    into = texts.setdefault(g, Counter())
                    for i in np.flatnonzero(counts):
                        for x in letters(words.distinct[i]):
                            into[x] += int(counts[i])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Model(texts))], pa.binary())], ["model"])

    got = chosen.repartition(1).mapInArrow(run, "model binary").collect()
    return bytes(got[0][0]) if got else pickle.dumps(Model({}))


def predict(df: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """df with lang_pred and score. A column of df of either name goes. The model is a broadcast of bounded size."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    names = [c for c in df.columns if c.lower() not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pickle.loads(sent.value))  # one for each task: a worker that goes on to other stages keeps nothing
        for whole in batches:
            for b in slices(whole, text_col, SLICE):
                langs, scores = scorer.predict(plain_text(b.column(text_col)))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])
        del scorer
        tidy()

    return df.mapInArrow(run, extended(df, "lang_pred string, score double", names))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), model).drop("text")
