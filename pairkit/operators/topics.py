"""Topic-model pair features: latent semantic indexing and topics of a mixture of term distributions.

Both models keep a table (term, load), one number per topic. Texts are written once, their terms as
numbers and weights in a row. In a round each task holds the numbers of the commonest terms (a
bounded matrix, broadcast) and sums what its texts give back to them; the rarer terms' numbers are
joined to the texts that have them. The driver sees that bounded matrix, matrices of topics x
topics and one likelihood a round; no text and no whole vocabulary. Every term of the corpus counts
unless a cap is asked for.

LSI is a randomised subspace iteration over the term weights A (texts x terms): a table Q of term
loadings is taken through A and back, Z = A'(A Q), in one pass over the texts, and made
orthogonal by the eigenvectors of Z'Z, summed from the tasks' partial products. The loadings end as the leading
right singular vectors of A.

The topic mixture is fitted by expectation maximisation with a Dirichlet prior on each text's shares,
as in latent Dirichlet allocation at its posterior mode: given the topics, each text's best shares
are found from its own terms (the problem is concave), and each term's expected counts per topic are
summed over the texts. So the likelihood rises from round to round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairkit.functions import text as tx, vectors as vx
from pairkit.operators import dictionary, weighting
from pairkit.operators.features import FeatureSet
from pairkit.session import materialize, scratch_path
from pairkit.sources import stores

# Names of the topic features.
NAMES = ("lsi_cosine_sim", "lsi_l1_diff", "lsi_l2_diff",
         "lda_cosine_sim", "lda_hellinger_sim", "lda_l1_diff")
# Directions beyond the topics asked for, which make the leading ones converge sooner.
EXTRA = 10
# Singular values are lost in rounding below this share of the largest.
LEAST_SHARE = 1e-3
# So many numbers of the commonest terms are in every task: 64 MB.
HEAD_NUMBERS = 8_000_000
# Texts that a task takes at a time.
AT_ONCE, SHARES_AT_ONCE = 2048, 256


def _sums(values: Column, size: int, factor: Column | float = 1.0) -> Column:
    """Element-wise sums of an array column, combined map-side."""
    factor = F.lit(factor) if isinstance(factor, float) else factor
    return F.array(*[F.sum(factor * values[j]) for j in range(size)])


def _hash_numbers(size: int, seed: int, make) -> Column:
    """An array of `size` numbers that depend on the term alone."""
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda j: make(F.xxhash64(F.lit(seed), F.col("term"), j)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(rows: np.ndarray) -> pa.ListArray:
    """A list per row of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))


# ---- texts and loads ---------------------------------------------------------

class Head:
    """The commonest terms, numbered; `whole` if they are all terms."""

    def __init__(self, terms: weighting.TermModel, width: int) -> None:
        self.terms, self.width = terms, width
        self.least, found = terms.commonest(min(weighting.HEAD_TERMS, HEAD_NUMBERS // max(1, width)))
        names = found["term"].to_pylist()
        self.names, self.size, self.whole = terms.vocabulary.sparkSession.sparkContext.broadcast(names), len(names), len(names) == terms.size


@dataclass
class Loads:
    """Numbers per topic of the head's terms (topics x terms, in every task), and (term, load) of the others."""

    head: Broadcast
    tail: DataFrame | None


def _loads(head: Head, table: DataFrame, width: int) -> Loads:
    """Of a table (term, load)."""
    def part(rare: bool) -> DataFrame:
        chosen = head.terms.vocabulary.filter(F.col("df") < head.least if rare else F.col("df") >= head.least)
        return table if head.whole else table.join(chosen.select("term"), "term", "left_semi")

    found, matrix = part(False).select("term", "load").toArrow(), np.zeros((width, head.size))  # HEAD_NUMBERS at most
    number = {t: i for i, t in enumerate(head.names.value)}
    if found.num_rows:
        matrix[:, [number[t] for t in found["term"].to_pylist()]] = _matrix(found["load"].combine_chunks(), width).T
    return Loads(table.sparkSession.sparkContext.broadcast(matrix), None if head.whole else part(True))


def _next_loads(head: Head, back: DataFrame, turn: np.ndarray) -> Loads:
    """Of what a round gave back, each term's numbers times `turn`."""
    found, matrix = back.filter("number >= 0").select("number", "load").toArrow(), np.zeros((turn.shape[0], head.size))  # HEAD_NUMBERS at most
    if found.num_rows:
        matrix[:, found["number"].to_numpy()] = _matrix(found["load"].combine_chunks(), turn.shape[0]).T
    tail = None if head.whole else _rotated(back.filter("term IS NOT NULL"), turn)
    return Loads(back.sparkSession.sparkContext.broadcast(turn.T @ matrix), tail)


def _named(head: Head, back: DataFrame, turn: np.ndarray) -> DataFrame:
    """(term, load @ turn) of what a round gave back."""
    names = head.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, term, load in (batch.columns for batch in batches):
            terms = [names.value[i] if i is not None else t for i, t in zip(number.to_pylist(), term.to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), _lists(_matrix(load, turn.shape[0]) @ turn)], ["term", "load"])

    kept = back.filter("number IS NOT NULL OR term IS NOT NULL").select("number", "term", "load")
    return kept.mapInArrow(run, "term string, load array<double>")


def _packed(head: Head, texts: DataFrame, weights: str = "tfidf") -> DataFrame:
    """(text_id, n, at, w, rest), written: the known terms of each text that has any, those of the head by number."""
    terms, names = head.terms, head.names
    counted = texts if "n" in texts.columns else texts.withColumn("n", F.lit(1).cast("bigint"))
    if weights == "tfidf":
        found = terms.vectorize(counted).select("text_id", F.transform("terms", lambda t: F.struct(t.term, t.w)).alias("terms"))
    else:
        counts = weighting.term_counts(counted, terms.tokenizer).join(terms.vocabulary.select("term"), "term")
        found = counts.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("term", F.col("tf").cast("double").alias("w")))).alias("terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(names.value)}
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                ids, lists = batch.slice(start, AT_ONCE).columns
                term, w = lists.flatten().flatten()
                coded = term.dictionary_encode()
                of = np.array([number.get(t, -1) for t in coded.dictionary.to_pylist()], np.int32)
                at = of[coded.indices.to_numpy(zero_copy_only=False)]
                owner = np.repeat(np.arange(len(ids)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))

                def dealt(kept: np.ndarray, values: pa.Array) -> pa.ListArray:
                    ends = np.cumsum(np.bincount(owner[kept], minlength=len(ids)))
                    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)

                known, rare = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
                rest = pa.StructArray.from_arrays([x.take(pa.array(rare)) for x in (term, w)], ["term", "w"])
                yield pa.RecordBatch.from_arrays([ids, dealt(known, pa.array(at[known])), dealt(known, w.take(pa.array(known))), dealt(rare, rest)],
                                                 ["text_id", "at", "w", "rest"])

    rows = found.mapInArrow(run, "text_id string, at array<int>, w array<double>, rest array<struct<term:string,w:double>>")
    rows = counted.select("text_id", "n").join(rows, "text_id").select("text_id", "n", "at", "w", "rest")
    if head.whole:
        return materialize(rows, "topic-texts")
    # Kept in buckets, so that the numbers of rare terms join them round by round and the rows stay.
    spark, path = texts.sparkSession, scratch_path(texts.sparkSession, "topic-texts")
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), path.rpartition("/")[2].replace("-", "_")
    (rows.repartition(buckets, "text_id").write.format("parquet").bucketBy(buckets, "text_id").option("path", path).saveAsTable(name))
    return spark.table(name)


def _passed(rows: DataFrame, loads: Loads, run: Callable, schema: str) -> DataFrame:
    """`run` over the blocks of `_blocks` of the texts of `_packed`."""
    columns = ["text_id", "n", "at", "w"]
    if loads.tail is None:
        given = rows.select(*columns)
    else:
        more = (rows.select("text_id", F.inline("rest")).join(loads.tail, "term").groupBy("text_id")
                .agg(F.collect_list(F.struct("term", "w", "load")).alias("more")))
        given = rows.select(*columns).join(more.hint("shuffle_hash"), "text_id", "left").select(*columns, "more")
    return given.mapInArrow(run, schema)


@dataclass
class Block:
    """Some texts: ids, repeats; each term's text, number (-1 if rare), weight and numbers; names of the rare ones."""

    ids: pa.Array
    n: np.ndarray
    lengths: np.ndarray
    owner: np.ndarray
    at: np.ndarray
    w: np.ndarray
    loads: np.ndarray  # topics x terms
    names: pa.Array

    def sums(self, of_terms: np.ndarray) -> np.ndarray:
        """Sums per text."""
        return np.bincount(self.owner, of_terms, minlength=len(self.ids))


def _blocks(batches: Iterator[pa.RecordBatch], head: np.ndarray, size: int) -> Iterator[Block]:
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            ids, n, at, w, *more = batch.slice(start, size).columns
            lengths = pc.list_value_length(at).to_numpy(zero_copy_only=False)
            at, w, names = at.flatten().to_numpy(zero_copy_only=False), w.flatten().to_numpy(zero_copy_only=False), pa.array([], pa.string())
            loads, owner = head[:, at], np.repeat(np.arange(len(ids)), lengths)
            if more:
                extra = pc.list_value_length(more[0]).fill_null(0).to_numpy(zero_copy_only=False)
                names, weights, numbers = more[0].flatten().flatten()
                order = np.argsort(np.concatenate([owner, np.repeat(np.arange(len(ids)), extra)]), kind="stable")
                at = np.concatenate([at, np.full(len(names), -1, at.dtype)])[order]
                w = np.concatenate([w, weights.to_numpy(zero_copy_only=False)])[order]
                loads = np.concatenate([loads, _matrix(numbers, len(head)).T], axis=1)[:, order]
                lengths = lengths + extra
                owner = np.repeat(np.arange(len(ids)), lengths)
            yield Block(ids, n.to_numpy(zero_copy_only=False), lengths, owner, at, w, loads, names)


# What a round gives back: numbers of a term of the head or of another term, or a part of the likelihood.
BACK = "number int, term string, load array<double>, fit double"


class Back:
    """Sums of a task for the terms of the head; the others' are given on at once."""

    def __init__(self, width: int, size: int) -> None:
        self.sums, self.met, self.fit = np.zeros((width, size)), np.zeros(size, bool), 0.0

    @staticmethod
    def _batch(number, term, load: np.ndarray, fit=None) -> pa.RecordBatch:
        none = lambda x, kind: pa.nulls(len(load), kind) if x is None else pa.array(x, kind)
        return pa.RecordBatch.from_arrays([none(number, pa.int32()), none(term, pa.string()), _lists(load), none(fit, pa.float64())],
                                          ["number", "term", "load", "fit"])

    def add(self, block: Block, back: np.ndarray) -> Iterator[pa.RecordBatch]:
        """back: topics x terms of the block."""
        known = np.flatnonzero(block.at >= 0)
        numbers, where = np.unique(block.at[known], return_inverse=True)
        self.met[numbers] = True
        for j, row in enumerate(back):
            self.sums[j, numbers] += np.bincount(where, row[known], minlength=len(numbers))
        if len(block.names):
            yield self._batch(None, block.names, back[:, block.at < 0].T)

    def done(self) -> Iterator[pa.RecordBatch]:
        numbers = np.flatnonzero(self.met)
        for start in range(0, len(numbers), 10_000):
            part = numbers[start:start + 10_000]
            yield self._batch(part, None, self.sums[:, part].T)
        yield self._batch(None, None, np.zeros((1, len(self.sums))), [self.fit])


def _summed(parts: DataFrame, width: int) -> DataFrame:
    """Parts of `BACK` added up per term, and written."""
    return materialize(parts.groupBy("number", "term").agg(_sums(F.col("load"), width).alias("load"), F.sum("fit").alias("fit")), "topic-back")


# ---- latent semantic indexing ------------------------------------------------

def _there(rows: DataFrame, loads: Loads, scaled: bool) -> DataFrame:
    """(text_id, load): the sum of w * load over the terms of each text."""
    head = loads.head

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, head.value, AT_ONCE):
            w = block.w * np.sqrt(block.n)[block.owner] if scaled else block.w
            yield pa.RecordBatch.from_arrays([block.ids, _lists(np.array([block.sums(w * x) for x in block.loads]).T)], ["text_id", "load"])

    return _passed(rows, loads, run, "text_id string, load array<double>")


def _there_and_back(rows: DataFrame, loads: Loads, size: int) -> DataFrame:
    """A'(A Q), where copies of a text are one row, scaled so that it counts as often."""
    head = loads.head

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = Back(*head.value.shape)
        for block in _blocks(batches, head.value, AT_ONCE):
            w = block.w * np.sqrt(block.n)[block.owner]
            yield from back.add(block, np.array([w * block.sums(w * x)[block.owner] for x in block.loads]))
        yield from back.done()

    return _summed(_passed(rows, loads, run, BACK), size)


def _gram(table: DataFrame, size: int) -> np.ndarray:
    """X'X of the rows X of `load`: a partial product per task, summed per matrix row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product = np.zeros((size, size))
        for batch in batches:
            x = _matrix(batch.column(0), size)
            product += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(product.tolist(), pa.list_(pa.float64()))], ["i", "load"])

    parts = table.select("load").mapInArrow(run, "i int, load array<double>")
    rows = parts.groupBy("i").agg(_sums(F.col("load"), size).alias("load")).collect()  # size x size numbers
    out = np.zeros((size, size))
    for r in rows:
        out[r["i"]] = r["load"]
    return (out + out.T) / 2


def _rotated(table: DataFrame, turn: np.ndarray, key: str = "term") -> DataFrame:
    """(key, load @ turn)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), turn.shape[0]) @ turn
            flat = pa.array(x.ravel())
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * turn.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], [key, "load"])

    return table.select(key, "load").mapInArrow(run, f"{key} string, load array<double>")


def _basis(product: np.ndarray, power: float) -> tuple[np.ndarray, np.ndarray]:
    """Turn that makes the rows' columns orthonormal, and the singular values; product ~ values ** (2 * power)."""
    values, vectors = np.linalg.eigh(product)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    kept = values > max(values[0], 1e-300) * max(LEAST_SHARE ** (2 * power), 1e-13)
    return vectors[:, kept] / np.sqrt(values[kept]), values[kept] ** (0.5 / power)


@dataclass
class LsiModel:
    """Term weights and (term, load): the loadings of each known term on k topics."""

    terms: weighting.TermModel
    loadings: DataFrame
    singular_values: np.ndarray
    rounds: int = 0

    @property
    def k(self) -> int:
        return len(self.singular_values)

    def transform(self, texts: DataFrame) -> DataFrame:
        """(text_id, lsi): unit-length topic vectors of texts with one row per text_id."""
        raw = self._raw(texts).withColumn("length", vx.norm("raw"))
        return raw.select("text_id", F.transform("raw", lambda x: F.when(F.col("length") > 0, x / F.col("length")).otherwise(x)).alias("lsi"))

    def explained_variance(self, texts: DataFrame) -> DataFrame:
        """One row: the share of the variance of the weights that the topics keep.

        `texts` are distinct texts with their number of repeats `n`.
        """
        counts = texts.select("text_id", "n")
        vectors = self.terms.vectorize(texts).join(counts, "text_id").select("n", F.inline("terms"))
        n = F.lit(float(self.terms.n_docs))
        per_term = vectors.groupBy("term").agg(
            (F.sum(F.col("n") * F.col("w") * F.col("w")) / n).alias("sq"),
            (F.sum(F.col("n") * F.col("w")) / n).alias("mean"))
        whole = per_term.agg(F.sum(F.col("sq") - F.col("mean") * F.col("mean"))).scalar()
        raw = self._raw(texts).join(counts, "text_id")
        squares = F.transform("raw", lambda x: x * x)
        per_topic = raw.withColumn("squares", squares).agg(_sums(F.col("squares"), self.k, F.col("n") / n).alias("sq"),
                                                            _sums(F.col("raw"), self.k, F.col("n") / n).alias("mean"))
        kept = vx.total(F.zip_with("sq", "mean", lambda s, m: s - m * m))
        return per_topic.select((kept / whole).alias("explained_variance"))

    def _raw(self, texts: DataFrame) -> DataFrame:
        """(text_id, raw): topic vectors before scaling."""
        if not self.k:
            return texts.select("text_id", F.array().cast("array<double>").alias("raw")).limit(0)
        head = Head(self.terms, self.k)
        return _there(_packed(head, texts), _loads(head, self.loadings, self.k), False).withColumnRenamed("load", "raw")

    def save(self, path: str) -> None:
        self.terms.save(f"{path}/terms")
        self.loadings.write.parquet(f"{path}/loadings")
        stores.write_document(self.loadings.sparkSession, {"singular_values": self.singular_values.tolist(), "rounds": self.rounds}, f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LsiModel:
        doc = stores.read_document(spark, f"{path}/model")
        return cls(weighting.TermModel.load(spark, f"{path}/terms"), spark.read.parquet(f"{path}/loadings"),
                   np.array(doc["singular_values"]), doc["rounds"])


def _distinct(corpus: DataFrame) -> DataFrame:
    """A corpus that is already a table of distinct texts (text_id, text, n) is used as it is."""
    return corpus if "text_id" in corpus.columns else materialize(dictionary.distinct_texts(corpus), "texts")


def fit_lsi(corpus: DataFrame, k: int = 100, max_features: int | None = None, max_rounds: int = 12,
            tolerance: float = 1e-7, seed: int = 42) -> LsiModel:
    """Truncated SVD of the sublinear term weights of every text of `corpus`.

    Rounds end when the squared singular values of the topics change by less than `tolerance` in
    all. A corpus of fewer dimensions than k gives as many topics as it has.
    """
    texts = _distinct(corpus)
    terms = weighting.fit_terms(texts, tx.topic_tokens, max_features)
    size = max(1, min(k + EXTRA, terms.size))
    signs = _hash_numbers(size, seed, lambda h: F.when(h % 2 == 0, 1.0).otherwise(-1.0))
    basis = terms.vocabulary.select("term", signs.alias("load"))
    if not terms.size:
        return LsiModel(terms, basis, np.zeros(0))
    head = Head(terms, size)
    rows, loads = _packed(head, texts), _loads(head, basis, size)
    before, rounds = None, 0
    while rounds < max(1, max_rounds):
        back, sent = _there_and_back(rows, loads, size), loads.head
        turn, values = _basis(_gram(back.filter("number IS NOT NULL OR term IS NOT NULL"), size), power=2.0)
        loads, size, rounds = _next_loads(head, back, turn), turn.shape[1], rounds + 1
        sent.destroy()
        now = (values[:k] ** 2).sum()
        if before is not None and abs(now - before) <= tolerance * now:
            break
        before = now
    values, vectors = np.linalg.eigh(_gram(_there(rows, loads, True), size))
    order = np.argsort(values)[::-1][:k]
    order = order[values[order] > values.max() * LEAST_SHARE ** 2]
    loadings = materialize(_named(head, back, turn @ vectors[:, order]), "lsi-loadings")
    return LsiModel(terms, loadings, np.sqrt(values[order]), rounds)


# ---- topic mixtures ----------------------------------------------------------

def best_shares(loads: np.ndarray, weights: np.ndarray, prior: float, steps: int = 100, close: float = 1e-6) -> np.ndarray:
    """The topic shares of a text that make its terms likeliest. loads: terms x topics, chances of a term given a topic."""
    k = loads.shape[1]
    shares = np.full(k, 1.0 / k)
    for _ in range(steps):
        mix = np.maximum(loads @ shares, 1e-300)
        new = shares * (loads.T @ (weights / mix)) + (prior - 1)
        new /= new.sum()
        if np.abs(new - shares).max() < close:
            return new
        shares = new
    return shares


def shares_of_texts(loads: np.ndarray, weights: np.ndarray, lengths: np.ndarray, prior: float, steps: int = 100,
                    close: float = 1e-6) -> np.ndarray:
    """`best_shares` of many texts at once, their terms one after another; lengths: how many terms each has, one at least."""
    shares = np.full((len(lengths), loads.shape[1]), 1.0 / loads.shape[1])
    going = np.arange(len(lengths))  # texts whose shares still change
    for _ in range(steps):
        owner = np.repeat(np.arange(len(going)), lengths)
        old = shares[going]
        mix = np.maximum(np.einsum("ij,ij->i", loads, old[owner]), 1e-300)
        new = old * np.add.reduceat(loads * (weights / mix)[:, None], np.cumsum(lengths) - lengths, axis=0) + (prior - 1)
        new /= new.sum(axis=1, keepdims=True)
        shares[going] = new
        moved = np.abs(new - old).max(axis=1) >= close
        if not moved.any():
            break
        if not moved.all():
            kept = moved[owner]
            loads, weights, lengths, going = loads[kept], weights[kept], lengths[moved], going[moved]
    return shares


def _best(block: Block, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares and log likelihood of the texts of a block, and the mixture's chance of each term."""
    shares = shares_of_texts(block.loads.T, block.w, block.lengths, prior)
    mix = np.maximum(np.einsum("ji,ij->i", block.loads, shares[block.owner]), 1e-300)
    return shares, block.sums(block.w * np.log(mix)) + (prior - 1) * np.log(np.maximum(shares, 1e-300)).sum(axis=1), mix


def _shares(rows: DataFrame, topics: Loads, prior: float) -> DataFrame:
    """(text_id, n, lda, fit, weight): shares, log likelihood and sum of weights of each text."""
    head = topics.head

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, head.value, SHARES_AT_ONCE):
            shares, fit, _ = _best(block, prior)
            yield pa.RecordBatch.from_arrays([block.ids, pa.array(block.n), _lists(shares), pa.array(fit), pa.array(block.sums(block.w))],
                                             ["text_id", "n", "lda", "fit", "weight"])

    return _passed(rows, topics, run, "text_id string, n bigint, lda array<double>, fit double, weight double")


def _expected(rows: DataFrame, topics: Loads, k: int, prior: float) -> DataFrame:
    """Expected counts of each term per topic, and the log likelihood."""
    head = topics.head

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = Back(*head.value.shape)
        for block in _blocks(batches, head.value, SHARES_AT_ONCE):
            shares, fit, mix = _best(block, prior)
            back.fit += float((block.n * fit).sum())
            yield from back.add(block, (block.n[block.owner] * block.w / mix) * block.loads * shares[block.owner].T)
        yield from back.done()

    return _summed(_passed(rows, topics, run, BACK), k)


@dataclass
class LdaModel:
    """Term weighting and (term, load): each topic's chances of the terms."""

    terms: weighting.TermModel
    topics: DataFrame
    k: int
    weights: str = "tfidf"
    prior: float = 1.1
    log_likelihoods: list[float] = field(default_factory=list)

    def transform(self, texts: DataFrame) -> DataFrame:
        """(text_id, lda): topic shares that sum to 1; equal ones for a text without known terms."""
        head = self._head()
        rows = _packed(head, texts, self.weights)
        found = _shares(rows, _loads(head, self.topics, self.k), self.prior).select("text_id", "lda")
        even = F.array_repeat(F.lit(1.0 / max(1, self.k)), self.k)
        return texts.select("text_id").join(found, "text_id", "left").select("text_id", F.coalesce("lda", even).alias("lda"))

    def log_perplexity(self, corpus: DataFrame) -> float:
        """Negative log likelihood of a corpus per unit of term weight, without the prior."""
        head = self._head()
        rows = _packed(head, _distinct(corpus), self.weights)
        fits, whole = _shares(rows, _loads(head, self.topics, self.k), 1.0).agg(
            F.sum(F.col("n") * F.col("fit")), F.sum(F.col("n") * F.col("weight"))).first()
        return 0.0 if not whole else -fits / whole

    def _head(self) -> Head:
        return Head(self.terms, self.k)

    def save(self, path: str) -> None:
        self.terms.save(f"{path}/terms")
        self.topics.write.parquet(f"{path}/topics")
        doc = {"k": self.k, "weights": self.weights, "prior": self.prior, "log_likelihoods": self.log_likelihoods}
        stores.write_document(self.topics.sparkSession, doc, f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LdaModel:
        doc = stores.read_document(spark, f"{path}/model")
        return cls(weighting.TermModel.load(spark, f"{path}/terms"), spark.read.parquet(f"{path}/topics"), doc["k"], doc["weights"],
                   doc["prior"], doc["log_likelihoods"])


def _scales(table: DataFrame, k: int) -> np.ndarray:
    """What scales each topic's numbers to sum 1, as a matrix."""
    totals = table.agg(_sums(F.col("load"), k).alias("t")).first()["t"]  # k numbers
    return np.diag([1.0 / t if t else 0.0 for t in totals])


def fit_lda(corpus: DataFrame, k: int = 100, max_iter: int = 10, seed: int = 42, max_features: int | None = None,
            weights: str = "tfidf", prior: float = 1.1, tolerance: float = 1e-6, terms: weighting.TermModel | None = None) -> LdaModel:
    """Topics of every text of `corpus`, on unit-length tf-idf (or plain counts with `weights="counts"`).

    `terms`, if given, is a vocabulary fitted on the same corpus with the tokens of topics, whose statistics are
    not counted again. `prior` above 1 is the Dirichlet parameter of a text's shares. Rounds end after `max_iter`, or when the
    likelihood changes by less than `tolerance` of itself; it is kept for each round.
    """
    texts = _distinct(corpus)
    terms = weighting.fit_terms(texts, tx.topic_tokens, max_features, sublinear=False) if terms is None else replace(terms, sublinear=False)
    start = _hash_numbers(k, seed, lambda h: F.pmod(h, F.lit(1 << 20)) / float(1 << 20) + 0.5)
    topics = materialize(terms.vocabulary.select("term", start.alias("load")), "lda-topics")
    topics = materialize(_rotated(topics, _scales(topics, k)), "lda-topics")
    fits: list[float] = []
    if max_iter and terms.size:
        head = Head(terms, k)
        rows, loads = _packed(head, texts, weights), _loads(head, topics, k)
        for _ in range(max_iter):
            back, sent = _expected(rows, loads, k, prior), loads.head
            fits.append(float(back.agg(F.sum("fit")).first()[0]))
            scales = _scales(back, k)
            loads = _next_loads(head, back, scales)
            sent.destroy()
            if len(fits) > 1 and abs(fits[-1] - fits[-2]) <= tolerance * abs(fits[-1]):
                break
        topics = materialize(_named(head, back, scales), "lda-topics")
    return LdaModel(terms, topics, k, weights, prior, fits)


# ---- pair features -----------------------------------------------------------

def lsi_columns() -> dict:
    gaps = vx.abs_diffs("lsi1", "lsi2")
    return {"lsi_cosine_sim": vx.dot("lsi1", "lsi2"), "lsi_l1_diff": vx.total(gaps), "lsi_l2_diff": vx.norm(gaps)}


def lda_columns() -> dict:
    lengths = vx.norm("lda1") * vx.norm("lda2")
    return {"lda_cosine_sim": F.when(lengths > vx.EPS, vx.dot("lda1", "lda2") / lengths).otherwise(0.0),
            "lda_hellinger_sim": vx.hellinger_similarity("lda1", "lda2"),
            "lda_l1_diff": vx.total(vx.abs_diffs("lda1", "lda2"))}


def attach_topics(pairs: DataFrame, lsi: LsiModel, lda: LdaModel, texts: DataFrame | None = None) -> DataFrame:
    """Pairs with the topic vectors of both texts; each distinct text is embedded once
    and the vectors are written, as for term vectors. `texts`, if given, are distinct texts, written, among which all of the pairs are."""
    texts = dictionary.distinct_texts(dictionary.corpus(pairs)) if texts is None else texts
    both = lda.transform(texts).join(lsi.transform(texts), "text_id", "left").withColumn(
        "lsi", F.coalesce("lsi", F.array_repeat(F.lit(0.0), lsi.k)))
    both = materialize(both, "topic-vectors")
    out = pairs
    for i in (1, 2):
        side = both.select(F.col("text_id").alias("__id"), F.col("lsi").alias(f"lsi{i}"), F.col("lda").alias(f"lda{i}"))
        out = out.withColumn("__id", dictionary.text_key(f"question{i}")).join(side, "__id").drop("__id")
    return out


def topic_features(lsi: LsiModel, lda: LdaModel, texts: DataFrame | None = None) -> FeatureSet:
    def build(df):
        done = attach_topics(df, lsi, lda, texts).withColumns({**lsi_columns(), **lda_columns()})
        return done.drop("lsi1", "lsi2", "lda1", "lda2")

    return FeatureSet(NAMES, build)
