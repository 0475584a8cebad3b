"""Corpus-fitted term weights: vocabulary, smoothed idf, unit-length sparse vectors.

Words and character n-grams share this code; only the tokenizer differs. A text's terms are
counted, weighted and sorted within its row, so no table of texts x terms is shuffled. Tasks
sum the counts of their terms before these are shuffled. Tasks hold the idf of the terms of
highest df; the rare rest, which few texts have, is joined to the texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairkit.functions import text as tx
from pairkit.operators import dictionary
from pairkit.session import materialize
from pairkit.sources import stores

Tokenizer = Callable[[str], Column]

# Vocabulary caps, percentile that makes a word rare.
WORD_CAP, CHAR_CAP = 50_000, 100_000
RARE_PERCENTILE = 0.75
# So many terms of highest df are broadcast: some ten MB of short terms, 100 MB in a Python worker.
HEAD_TERMS = 500_000
# Unknown terms and words of known ones that a task remembers, texts it takes at a time.
HELD_TERMS, HELD_WORDS, AT_ONCE = 400_000, 100_000, 256

# What a saved model names its tokenizer by.
TOKENIZERS = {"words": tx.word_tokens, "topics": tx.topic_tokens, "whitespace": tx.whitespace_tokens,
              "char_wb": tx.char_word_grams, "char": tx.char_grams}


def tokenizer_document(tokenizer: Tokenizer) -> dict:
    """Name and options of one of the library's tokenizers."""
    plain, options = (tokenizer.func, dict(tokenizer.keywords)) if isinstance(tokenizer, partial) else (tokenizer, {})
    name = next((n for n, f in TOKENIZERS.items() if f is plain), None)
    if name is None:
        raise ValueError("only models with a tokenizer of the library can be saved")
    return {"name": name, "options": options}


def char_tokenizer(low: int = 1, high: int = 8, analyzer: str = "char_wb") -> Tokenizer:
    """Character n-grams within padded words ("char_wb") or across the text ("char")."""
    return partial({"char_wb": tx.char_word_grams, "char": tx.char_grams}[analyzer], low=low, high=high)


def readable(tokenizer: Tokenizer) -> tuple[Tokenizer, Callable[[str], list[str]] | None]:
    """What a task reads of a text, and the terms that each item of it gives, if it is not a term itself.

    N-grams within words are made in the task, once for each of its words.
    """
    plain, options = (tokenizer.func, tokenizer.keywords) if isinstance(tokenizer, partial) else (tokenizer, {})
    if plain is not tx.char_word_grams:
        return tokenizer, None
    low, high = options.get("low", 1), options.get("high", 8)
    return tx.whitespace_tokens, lambda word: tx.grams_of_word(word, low, high)


class Numbers:
    """Numbers of terms in a task, with their idf (nan: unknown): first the known ones, then others in the order it met them."""

    def __init__(self, split: Callable[[str], list[str]] | None, known: dict[str, float] | None = None) -> None:
        self.split, self.known, self.known_idf = split, list(known or {}), np.array(list((known or {}).values()), float)
        self.words: dict[str, np.ndarray] = {}
        self.loose: list[str] = []  # words with a term that is not known
        self.clear()

    def clear(self) -> None:
        """Forget the terms met that are not known, and the words that have one."""
        self.names: list[str] = self.known.copy()
        self.number: dict[str, int] = dict(zip(self.known, range(len(self.known))))
        self.idf = np.concatenate([self.known_idf, np.full(1024, np.nan)])
        for word in self.loose:
            del self.words[word]
        self.loose.clear()
        if len(self.words) >= HELD_WORDS:
            self.words.clear()

    @property
    def full(self) -> bool:
        return len(self.names) - len(self.known) >= HELD_TERMS or len(self.words) - len(self.loose) >= HELD_WORDS

    def _of(self, term: str) -> int:
        found = self.number.get(term)
        if found is None:
            found = self.number[term] = len(self.names)
            self.names.append(term)
            if found >= len(self.idf):
                self.idf = np.concatenate([self.idf, np.full(len(self.idf), np.nan)])
        return found

    def _of_word(self, word: str) -> np.ndarray:
        found = self.words.get(word)
        if found is None:
            found = self.words[word] = np.array([self._of(t) for t in self.split(word)], np.int64)
            if found.max(initial=-1) >= len(self.known):
                self.loose.append(word)
        return found

    def count(self, items: list[str] | None) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of a text's terms, rising, and how often it has each."""
        if not items:
            flat = np.zeros(0, np.int64)
        elif self.split is None:
            found = list(map(self.number.get, items))
            flat = np.array([self._of(t) if i is None else i for i, t in zip(found, items)] if None in found else found, np.int64)
        else:
            flat = np.concatenate([self._of_word(w) for w in items])
        return np.unique(flat, return_counts=True)


def values(column: pa.Array) -> list:
    """The values of a column; of lists of strings, each distinct string is made once, and null gives an empty list."""
    if not (pa.types.is_list(column.type) and pa.types.is_string(column.type.value_type)):
        return column.to_pylist()
    coded = column.flatten().dictionary_encode()
    flat = coded.dictionary.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)].tolist()
    lengths = pc.list_value_length(column).fill_null(0).to_pylist()
    return [flat[end - n:end] for n, end in zip(lengths, accumulate(lengths))]


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield [values(c) for c in batch.slice(at, AT_ONCE).columns]


def term_counts(texts: DataFrame, tokenizer: Tokenizer, keep: tuple[str, ...] = ()) -> DataFrame:
    """(text_id, ..., term, tf) of a table with one row per text_id."""
    read, split = readable(tokenizer)

    def run(batches):
        numbers = Numbers(split)
        for ids, tokens in pieces(batches):
            if numbers.full:
                numbers.clear()
            found = [numbers.count(t) for t in tokens]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.string()), pa.array([[numbers.names[i] for i in at] for at, _ in found], pa.list_(pa.string())),
                pa.array([times for _, times in found], pa.list_(pa.int64()))], ["text_id", "term", "tf"])

    if keep:
        return term_counts(texts, tokenizer).join(texts.select("text_id", *keep), "text_id").select("text_id", *keep, "term", "tf")
    rows = texts.select("text_id", read("text").alias("tokens")).mapInArrow(run, "text_id string, term array<string>, tf array<bigint>")
    return rows.select("text_id", F.inline(F.arrays_zip("term", "tf")))


def term_statistics(texts: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(term, tf, df) over a corpus given as distinct texts and their repeats `n`."""
    read, split = readable(tokenizer)

    def run(batches):
        numbers = Numbers(split)
        sums = np.zeros((2, 1024), np.int64)

        def done():
            size = len(numbers.names)
            return pa.RecordBatch.from_arrays([pa.array(numbers.names, pa.string()), *[pa.array(x[:size]) for x in sums]], ["term", "tf", "df"])

        for repeats, tokens in pieces(batches):
            found = [numbers.count(t) for t in tokens]
            if len(numbers.idf) > sums.shape[1]:
                sums = np.concatenate([sums, np.zeros((2, len(numbers.idf) - sums.shape[1]), np.int64)], axis=1)
            for n, (at, times) in zip(repeats, found):
                sums[0, at] += times * n
                sums[1, at] += n
            if numbers.full:
                yield done()
                numbers.clear()
                sums = np.zeros((2, 1024), np.int64)
        yield done()

    parts = texts.select("n", read("text").alias("tokens")).mapInArrow(run, "term string, tf bigint, df bigint")
    return parts.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def cap_vocabulary(terms: DataFrame, size: int) -> DataFrame:
    """The `size` terms of highest tf, ties in term order.

    Terms are range-partitioned by that order; whole partitions before the cut are
    kept and only the partition the cut falls into is sorted for its share. Terms are
    unique, so no partition outgrows its range.
    """
    order = [F.col("tf").desc(), F.col("term").asc()]
    ranged = materialize(
        terms.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "terms")
    # One row per partition.
    sizes = sorted((r["__part"], r["count"]) for r in ranged.groupBy("__part").count().collect())
    whole, room, cut = [], size, None
    for part, count in sizes:
        if count > room:
            cut = part
            break
        whole.append(part)
        room -= count
    if cut is None:
        return ranged.drop("__part")
    last = ranged.filter(F.col("__part") == cut).orderBy(*order).limit(room)
    return ranged.filter(F.col("__part") < cut).unionByName(last).drop("__part")


def idf(n_docs, df) -> Column:
    """Smoothed inverse document frequency."""
    return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df)) + F.lit(1.0)


@dataclass
class Vector:
    """The terms of one text by a task's numbers of them, rising, with idf and unit-length weight."""

    at: np.ndarray
    idf: np.ndarray
    w: np.ndarray


class Weigher:
    """Vectors of texts in a task."""

    def __init__(self, numbers: Numbers, sublinear: bool, known_only: bool) -> None:
        self.numbers, self.sublinear, self.known_only = numbers, sublinear, known_only

    def refresh(self) -> None:
        """Forget the terms met if they are many; vectors made before are no longer comparable."""
        if self.numbers.full:
            self.numbers.clear()

    def __call__(self, items: list[str] | None, terms: list[str] | None = None, idfs: list[float] | None = None) -> Vector:
        """The vector of a text; terms, idfs: what `rare_terms` found of it."""
        numbers = self.numbers
        at, times = numbers.count(items)
        if terms:
            numbers.idf[[numbers.number[t] for t in terms]] = idfs
        idf = numbers.idf[at]
        known = ~np.isnan(idf)
        if not self.known_only:
            idf = np.where(known, idf, 0.0)
        elif not known.all():
            at, times, idf = at[known], times[known], idf[known]
        w = (1.0 + np.log(times) if self.sublinear else times) * idf
        # Added in order of size, so that the sum does not depend on what else the task met.
        norm = math.sqrt(np.sort(w * w).sum())
        return Vector(at, idf, w / norm if norm > 0 else np.zeros(len(w)))


@dataclass
class TermModel:
    """A fitted vocabulary: table (term, tf, df, idf) and three plan-time numbers."""

    vocabulary: DataFrame
    tokenizer: Tokenizer
    n_docs: int
    size: int
    rare_idf: float
    sublinear: bool = True
    # The broadcast terms, and the least df of one of them.
    _head: tuple[Broadcast, int] | None = field(default=None, repr=False, compare=False)

    def commonest(self, limit: int) -> tuple[int, pa.Table]:
        """(term, idf) of the terms of highest df, at most `limit`, and their least df."""
        least = 0
        if self.size > limit:
            # One row per eighth of a power of two.
            step = F.floor(F.log2("df") * 8)
            steps = self.vocabulary.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("terms"), F.min("df").alias("df"))
            room, least = limit, 1 << 62
            for r in sorted(steps.collect(), key=lambda r: -r["step"]):
                room -= r["terms"]
                if room < 0:
                    break
                least = r["df"]
        return least, self.vocabulary.filter(F.col("df") >= least).select("term", "idf").toArrow()

    def head(self) -> tuple[Broadcast, int]:
        """{term: idf} of the terms of highest df, at most `HEAD_TERMS`, in every task; their least df."""
        if self._head is None:
            least, found = self.commonest(HEAD_TERMS)
            known = dict(zip(found["term"].to_pylist(), found["idf"].to_pylist()))
            self._head = self.vocabulary.sparkSession.sparkContext.broadcast(known), least
        return self._head

    def rare_terms(self, texts: DataFrame) -> DataFrame | None:
        """(text_id, rare): the terms of each text that the tasks don't hold, as (term, idf); None if they hold all."""
        if self.size <= HEAD_TERMS:
            return None
        head, least = self.head()
        read, split = readable(self.tokenizer)

        def run(batches):
            numbers = Numbers(split, head.value)
            for ids, tokens in pieces(batches):
                if numbers.full:
                    numbers.clear()
                counted = [numbers.count(x)[0] for x in tokens]
                found = [[numbers.names[i] for i in at[np.isnan(numbers.idf[at])]] for at in counted]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.list_(pa.string()))], ["text_id", "term"])

        others = texts.select("text_id", read("text").alias("tokens")).mapInArrow(run, "text_id string, term array<string>")
        tail = self.vocabulary.filter(F.col("df") < least).select("term", "idf")
        return (others.select("text_id", F.explode("term").alias("term")).join(tail, "term")
                .groupBy("text_id").agg(F.collect_list(F.struct("term", "idf")).alias("rare")))

    def weigher(self, known_only: bool) -> tuple[Tokenizer, Callable[[], Weigher]]:
        """What a task reads of a text, and what makes a task's `Weigher`."""
        head, sublinear = self.head()[0], self.sublinear
        read, split = readable(self.tokenizer)
        return read, lambda: Weigher(Numbers(split, head.value), sublinear, known_only)

    def vectorize(self, texts: DataFrame, known_only: bool = True) -> DataFrame:
        """(text_id, terms) with terms an array of (term, idf, w) in term order.

        `texts` holds one row per text_id. Weights have unit length over the known
        terms; with `known_only=False` other terms are listed too, with idf and w 0.
        """
        read, make = self.weigher(known_only)
        rare = self.rare_terms(texts)

        def run(batches):
            weigh = make()
            for ids, *parts in pieces(batches):
                weigh.refresh()
                kept, names, idfs, ws = [], [], [], []
                for i, *text in zip(ids, *parts):
                    found = weigh(*text)
                    if len(found.at):
                        terms = [weigh.numbers.names[t] for t in found.at]
                        order = sorted(range(len(terms)), key=terms.__getitem__)
                        kept.append(i)
                        names.append([terms[t] for t in order])
                        idfs.append(found.idf[order])
                        ws.append(found.w[order])
                if kept:
                    offsets = pa.array(np.cumsum([0, *map(len, names)]), pa.int32())
                    flat = [pa.array(list(chain.from_iterable(names)), pa.string()), pa.array(np.concatenate(idfs)), pa.array(np.concatenate(ws))]
                    terms = pa.StructArray.from_arrays(flat, ["term", "idf", "w"])
                    yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.ListArray.from_arrays(offsets, terms)], ["text_id", "terms"])

        rows = texts.select("text_id", "text")
        if rare is not None:
            rows = rows.join(rare, "text_id", "left")
        parts = [F.col("rare.term").alias("rare"), F.col("rare.idf").alias("idfs")] if rare is not None else []
        return rows.select("text_id", read("text").alias("tokens"), *parts).mapInArrow(
            run, "text_id string, terms array<struct<term:string,idf:double,w:double>>")

    def both_texts(self, pairs: DataFrame, texts: DataFrame | None = None) -> tuple[DataFrame, list[Column]]:
        """Pairs, and the expressions that `weigher` reads of the left and of the right text.

        Rare terms are joined by the texts' keys. `texts`, if given, are distinct texts among which all of the
        pairs are; then pairs may have the keys alone, as `text_id1` and `text_id2`.
        """
        read, _ = self.weigher(True)
        if self.size <= HEAD_TERMS and "question1" in pairs.columns:
            return pairs, [read(f"question{i}") for i in (1, 2)]
        found = dictionary.distinct_texts(dictionary.corpus(pairs)) if texts is None else texts
        found, rare = found.select("text_id", "text"), self.rare_terms(found)
        if rare is not None:
            found = materialize(found.join(rare, "text_id", "left"), "texts")
        keys = {f"__id{i}": F.col(f"text_id{i}") if f"text_id{i}" in pairs.columns else dictionary.text_key(f"question{i}") for i in (1, 2)}
        out = pairs.withColumns(keys)
        for i in (1, 2):
            side = found.select(F.col("text_id").alias(f"__id{i}"), F.struct(*found.columns[1:]).alias(f"__text{i}"))
            out = out.join(side, f"__id{i}", "left").drop(f"__id{i}")
        rares = [] if rare is None else ["rare.term", "rare.idf"]
        return out, [c for i in (1, 2) for c in (read(f"__text{i}.text"), *[F.col(f"__text{i}.{r}") for r in rares])]

    def attach(self, pairs: DataFrame, known_only: bool = True) -> DataFrame:
        """Pairs with the sparse vectors of both texts, as `terms1` and `terms2`.

        Each distinct text is vectorised once and the vectors are written: both joins
        read the same table, and as a plain scan it lets AQE split the join partitions
        of texts that many pairs share. A text without terms gets an empty array.
        """
        texts = dictionary.distinct_texts(dictionary.corpus(pairs))
        vectors = materialize(self.vectorize(texts, known_only), "term-vectors")
        out = pairs
        for i in (1, 2):
            side = vectors.select(F.col("text_id").alias("__id"), F.col("terms").alias(f"terms{i}"))
            out = (out.withColumn("__id", dictionary.text_key(f"question{i}"))
                   .join(side, "__id", "left").drop("__id")
                   .withColumn(f"terms{i}", F.coalesce(f"terms{i}", F.filter(
                       F.array(F.struct(F.lit("").alias("term"), F.lit(0.0).alias("idf"),
                                        F.lit(0.0).alias("w"))), lambda t: F.lit(False)))))
        return out


    def save(self, path: str) -> None:
        """The vocabulary as a table and the rest as a document."""
        self.vocabulary.write.parquet(f"{path}/vocabulary")
        doc = {"tokenizer": tokenizer_document(self.tokenizer), "n_docs": self.n_docs, "size": self.size,
               "rare_idf": self.rare_idf, "sublinear": self.sublinear}
        stores.write_document(self.vocabulary.sparkSession, doc, f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TermModel:
        """A saved model, in any session."""
        doc = stores.read_document(spark, f"{path}/model")
        plain, options = TOKENIZERS[doc["tokenizer"]["name"]], doc["tokenizer"]["options"]
        return cls(spark.read.parquet(f"{path}/vocabulary"), partial(plain, **options) if options else plain,
                   doc["n_docs"], doc["size"], doc["rare_idf"], doc["sublinear"])


def fit_terms(corpus: DataFrame, tokenizer: Tokenizer, max_features: int | None,
              sublinear: bool = True, percentile: float = RARE_PERCENTILE) -> TermModel:
    """Fit on every text of `corpus`, repeats included; pass training rows only.

    A corpus that is already a table of distinct texts (text_id, text, n) is used as it is.
    """
    texts = corpus if "text_id" in corpus.columns else materialize(dictionary.distinct_texts(corpus), "texts")
    n_docs = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    stats = term_statistics(texts, tokenizer)
    terms = cap_vocabulary(stats, max_features) if max_features else stats
    vocabulary = materialize(terms.withColumn("idf", idf(F.lit(float(n_docs)), F.col("df"))), "vocabulary")
    facts = vocabulary.agg(F.count(F.lit(1)).alias("size"),
                           F.percentile("idf", F.lit(percentile)).alias("rare")).first()
    return TermModel(vocabulary, tokenizer, n_docs, facts["size"], facts["rare"] or 0.0, sublinear)


def fit_tfidf(corpus: DataFrame, max_features: int | None = None, sublinear: bool = True,
              percentile: float = RARE_PERCENTILE) -> TermModel:
    """Word weights."""
    return fit_terms(corpus, tx.word_tokens, max_features, sublinear, percentile)


def fit_char(corpus: DataFrame, max_features: int | None = None, ngram_range: tuple[int, int] = (1, 8),
             analyzer: str = "char_wb", sublinear: bool = True) -> TermModel:
    """Character n-gram weights."""
    return fit_terms(corpus, char_tokenizer(*ngram_range, analyzer), max_features, sublinear)


def postings(vectors: DataFrame) -> DataFrame:
    """Sparse vectors as rows: (text_id, term, idf, w)."""
    return vectors.select("text_id", F.inline("terms"))
