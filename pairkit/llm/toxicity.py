"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of itself and of its character n-grams (3 to 5, its begin and
end marked), each hashed to one of `buckets` rows; a text is the mean of its words, and a linear
layer with softmax gives the classes. Vectors and layer are trained together by descent over a
bounded sample of labelled rows; n-grams that the classes have at like rates get no vector, and
vectors are shrunk towards zero, so that words of one text are not learned by heart. An unseen misspelling shares most n-grams with the word it
stands for. Scoring needs one number for each n-gram (its vector times the layer), and one for
each word, which a bounded table of the worker remembers; whole texts are scored.

Bound of the sample: about `rows_per_class` rows of each label, chosen by a hash of the id.
Defined results: a NULL, empty or wordless text gets the score of the bias alone; rows may
repeat; labels that are NULL or name no document are left out, an id with several labels counts
with each; a column `toxicity` of the input is replaced, others stay; with labels of one class only every score is that class (0 without any); an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairkit.llm.language_id import ORDER, gram_hashes, mix
from pairkit.llm.sampling import bounded_sample

WORD = re.compile(r"[^\W_]+")
SHORTEST = 3
MEMO_WORDS = 200_000
MEMO_CHARS = 4_000_000
PART_CHARS = 1 << 16
LONG_TEXT = 1 << 20


def subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of every word and of the word itself, and the word each belongs to; ordered by word."""
    hashes, seen, owner = gram_hashes(words)
    found, of = [], []
    for n in range(SHORTEST, ORDER + 1):
        full = seen + 1 >= n
        found.append(hashes[n][full])
        of.append(owner[full])
    letters = mix(hashes[1] + seen.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    whole = np.zeros(len(words), np.uint64)
    np.add.at(whole, owner, letters)
    found.append(mix(whole))
    of.append(np.arange(len(words)))
    gram, word = np.concatenate(found), np.concatenate(of)
    order = np.argsort(word, kind="stable")
    return (gram[order] % np.uint64(buckets)).astype(np.int32), word[order].astype(np.int32)


def parts_of(words: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for w in words:
        part.append(w)
        size += len(w) + 1
        if size > PART_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


class Segments:
    """Weighted sums of rows by a sparse matrix given as (row, column, value), and by its transpose."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, rows: int, cols: int):
        self.shape = (rows, cols)
        self.by_row = self._sorted(row, col, value)
        self.by_col = self._sorted(col, row, value)

    @staticmethod
    def _sorted(key, other, value):
        order = np.argsort(key, kind="stable")
        keys, first = np.unique(key[order], return_index=True)
        return keys, first, other[order], value[order].astype(np.float32)

    def times(self, dense: np.ndarray, transposed: bool = False) -> np.ndarray:
        keys, first, other, value = self.by_col if transposed else self.by_row
        out = np.zeros((self.shape[transposed], dense.shape[1]), np.float32)
        step = 1 << 18  # rows are summed in parts, which bounds the gathered copy
        ends = np.append(first[1:], len(other))
        lo = 0
        while lo < len(keys):
            hi = max(lo + 1, int(np.searchsorted(ends, first[lo] + step, side="right")))
            a, b = first[lo], ends[hi - 1]
            out[keys[lo:hi]] = np.add.reduceat(dense[other[a:b]] * value[a:b, None], first[lo:hi] - a, axis=0)
            lo = hi
        return out


def screened(texts: list[str], y: np.ndarray, buckets: int, least_docs: int = 5, least_z: float = 4.0) -> tuple[np.ndarray, Segments]:
    """The n-grams that get a vector, and each text's bag of them: the mean over words of the mean over their n-grams.

    Those count that at least `least_docs` texts have, and that the classes have at rates `least_z` deviations apart.
    """
    words = [Counter(WORD.findall(t.lower())) for t in texts]
    names = sorted(set().union(*words))
    number = {w: i for i, w in enumerate(names)}
    parts, lengths = [], []
    for part in parts_of(names):
        gram, word = subwords(part, buckets)
        parts.append(gram)
        lengths.append(np.bincount(word, minlength=len(part)))
    gram = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    length = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    start = np.cumsum(length) - length
    columns, values, having = [], [], np.zeros((2, buckets))
    for bag, label in zip(words, y):
        own = np.fromiter(map(number.__getitem__, bag), np.int64, len(bag))
        share = np.fromiter(bag.values(), float, len(bag)) / max(1, bag.total())
        n = length[own]
        at = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found, place = np.unique(gram[at], return_inverse=True)
        columns.append(found)
        values.append(np.bincount(place, np.repeat(share / np.maximum(n, 1), n), len(found)).astype(np.float32))
        having[label, found] += 1
    sizes = np.bincount(y, minlength=2)
    rate = having.sum(axis=0) / len(y)
    z = np.abs(having[1] / sizes[1] - having[0] / sizes[0]) / np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / sizes).sum())
    kept = np.flatnonzero((having.sum(axis=0) >= least_docs) & (z >= least_z))
    place = np.full(buckets, -1)
    place[kept] = np.arange(len(kept))
    inside = [place[c] >= 0 for c in columns]
    row = np.repeat(np.arange(len(texts)), [m.sum() for m in inside])
    return kept, Segments(row, np.concatenate([place[c][m] for c, m in zip(columns, inside)]),
                          np.concatenate([v[m] for v, m in zip(values, inside)]), len(texts), len(kept))


class Classifier:
    """What scoring needs: a number for each bucket, and the bias."""

    def __init__(self, grams: np.ndarray, bias: float):
        self.grams, self.bias = grams, bias

    @classmethod
    def train(cls, texts: list[str], labels: list[int], share: float, buckets: int = 1 << 17, width: int = 8,
              rounds: int = 200, rate: float = 4.0, shrink: float = 0.1, seed: int = 11) -> Classifier:
        """`share` of class 1 among all labels; the sample's own shares are balanced by weights."""
        y = np.array(labels, dtype=np.int64)
        if len(set(labels)) < 2:
            return cls(np.zeros(buckets, np.float32), 30.0 if len(y) and y[0] else -30.0)
        grams, bags = screened(texts, y, buckets)
        rng = np.random.default_rng(seed)
        vectors = rng.normal(0, 0.01, (len(grams), width)).astype(np.float32)
        layer, bias, pace = rng.normal(0, 1, (width, 2)).astype(np.float32), np.zeros(2, np.float32), 0.0
        truth = np.eye(2, dtype=np.float32)[y]
        weight = (0.5 / np.bincount(y, minlength=2))[y].astype(np.float32)[:, None]
        for _ in range(rounds if len(grams) else 0):
            hidden = bags.times(vectors)
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            loss = -(np.log(np.maximum((p * truth).sum(axis=1), 1e-9)) * weight[:, 0]).sum()
            error = (p - truth) * weight
            # the steepest n-gram sets the scale, so the few that matter grow first and stay sparse
            slope = bags.times(error @ layer.T, transposed=True)
            pace = 0.8 * pace + slope / max(1e-12, np.sqrt((slope ** 2).sum(axis=1)).max())
            step = rate * min(1.0, 2 * loss)
            vectors = vectors - step * pace
            length = np.sqrt((vectors ** 2).sum(axis=1, keepdims=True))
            vectors = vectors * np.maximum(0, 1 - shrink * step / np.maximum(length, 1e-9))
            turn = hidden.T @ error
            layer = layer - 0.05 * turn / max(1e-9, np.abs(turn).max())
            bias = bias - 0.5 * error.sum(axis=0)
        values = np.zeros(buckets, np.float32)
        values[grams] = vectors @ (layer[:, 1] - layer[:, 0])
        return cls(values, float(bias[1] - bias[0] + np.log(share / (1 - share))))

    def word_values(self, words: list[str]) -> np.ndarray:
        gram, word = subwords(words, len(self.grams))
        return np.bincount(word, self.grams[gram], len(words)) / np.bincount(word, minlength=len(words))


class Scorer:
    """Scores of texts, with the values of words it has met in a bounded table."""

    def __init__(self, model: Classifier):
        self.model, self.values, self.chars = model, {}, 0

    def prepare(self, texts: list[str]) -> None:
        """Meets the words of many texts at once."""
        self._meet([w for t in texts if len(t) <= LONG_TEXT for w in WORD.findall(t.lower())])

    def _meet(self, words: list[str]) -> None:
        if len(self.values) > MEMO_WORDS or self.chars > MEMO_CHARS:
            self.values, self.chars = {}, 0
        new = [w for w in dict.fromkeys(words) if w not in self.values]
        for part in parts_of(new):
            self.values.update(zip(part, self.model.word_values(part).tolist()))
        self.chars += sum(map(len, new))

    def score(self, text: str | None) -> float:
        lowered, total, n = (text or "").lower(), 0.0, 0
        if len(lowered) <= LONG_TEXT:
            words = WORD.findall(lowered)
            try:
                total, n = sum(map(self.values.__getitem__, words)), len(words)
            except KeyError:
                self._meet(words)
                total, n = sum(map(self.values.__getitem__, words)), len(words)
        else:
            found = WORD.finditer(lowered)
            while words := [m.group() for m in islice(found, 1 << 16)]:
                self._meet(words)
                total += sum(map(self.values.__getitem__, words))
                n += len(words)
        logit = self.model.bias + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(logit, -500, 500))))


def train(docs: DataFrame, labels: DataFrame, learnable: Column, rows_per_class: dict[int, int] | None = None,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Classifier:
    """labels: id_col and label_col (0 or 1). Only rows that `learnable` (of id_col) holds for are read."""
    limits = rows_per_class or {0: 2400, 1: 1200}
    known = labels.filter(learnable & F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).cast("int").alias("__label"))
    found = {r["__label"]: r["count"] for r in known.groupBy("__label").count().collect()}
    chosen = bounded_sample(known, "__label", [id_col], limits)
    # the sample's bound is the broadcast's
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select("place", id_col, text_col, "__label").collect()
    rows.sort(key=lambda r: (r["place"], r[id_col], r[text_col] or "", r["__label"]))
    share = found.get(1, 0) / max(1, sum(found.values()))
    return Classifier.train([r[text_col] or "" for r in rows], [r["__label"] for r in rows], share)


def score(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """Append `toxicity`, 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one number per bucket

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(sent.value)
        for batch in batches:
            values = []
            for k in range(0, len(batch), 256):
                part = [t or "" for t in batch.iloc[k:k + 256]]
                scorer.prepare(part)
                values += map(scorer.score, part)
            yield pd.Series(values, dtype="float64")

    return docs.withColumn("toxicity", scored(F.col(text_col)))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learned from four fifths of the labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    rows = score(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return rows.select("doc_id", "held_out", F.col("toxicity").alias("score"),
                       F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"))
