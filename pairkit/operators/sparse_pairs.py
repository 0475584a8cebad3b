"""Pair features of two sparse term vectors.

Both texts of a pair are weighted and compared within the pair's row, in a task. No pair x term
table is made, and no vector leaves the task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairkit.operators.features import FeatureSet
from pairkit.operators.weighting import AT_ONCE, TermModel, Vector, Weigher, values

TOP_K = 3
WORD = ("weighted_word_overlap", "rare_word_mismatch_count", "rare_word_mismatch_weight",
        "top1_word_match", "top3_overlap_count", "tfidf_diff_mean", "tfidf_diff_max",
        "tfidf_diff_l1", "tfidf_diff_l2", "tfidf_cosine_sim", "tfidf_dot")
CHAR = ("char_tfidf_cosine_sim", "char_tfidf_l1_diff", "char_tfidf_l2_diff", "char_tfidf_dot",
        "char_bin_cosine_sim", "char_bin_jaccard")


def ranked(vector: Vector, names: list[str], k: int) -> list[int]:
    """The first k terms by falling idf, ties in term order."""
    found = np.arange(len(vector.at))
    if len(found) > k:
        found = found[vector.idf >= np.partition(vector.idf, -k)[-k]]
    best = sorted([(-vector.idf[i], names[vector.at[i]], i) for i in found])[:k]
    return [int(vector.at[i]) for *_, i in best]


def _ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


def shared_terms(left: Vector, right: Vector) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each term of the left text is in the right one, its places there, and whether the left text has the right one's terms."""
    places = np.searchsorted(right.at, left.at)
    both = places < len(right.at)
    both[both] = right.at[places[both]] == left.at[both]
    back = np.zeros(len(right.at), bool)
    back[places[both]] = True
    return both, places[both], back


def differences(left: Vector, right: Vector, both, places, back) -> dict[str, float]:
    """Inner product of both weight vectors and norms of their difference."""
    w1, w2 = left.w[both], right.w[places]
    gaps = np.concatenate([np.abs(w1 - w2), left.w[~both], right.w[~back]])
    return {"dot": (w1 * w2).sum(), "l1": gaps.sum(), "l2": math.sqrt((gaps * gaps).sum()), "max": gaps.max(initial=0.0)}


def compared_words(left: Vector, right: Vector, names: list[str], rare_idf: float, size: int, k: int) -> list[float]:
    """The features `WORD` of two texts."""
    both, places, back = shared_terms(left, right)
    common, alone = left.idf[both].sum(), np.concatenate([left.idf[~both], right.idf[~back]])
    rare = alone[alone >= rare_idf]
    shared = set(left.at[both].tolist())
    top = ranked(left, names, k)
    gaps = differences(left, right, both, places, back)
    return [_ratio(common, common + alone.sum()), len(rare), rare.sum(), bool(top) and top[0] in shared, sum([t in shared for t in top]),
            _ratio(gaps["l1"], size), gaps["max"], gaps["l1"], gaps["l2"], gaps["dot"], gaps["dot"]]


def compared_grams(left: Vector, right: Vector, names: list[str]) -> list[float]:
    """The features `CHAR` of two texts."""
    both, places, back = shared_terms(left, right)
    gaps, common, sizes = differences(left, right, both, places, back), len(places), (len(left.at), len(right.at))
    return [gaps["dot"], gaps["l1"], gaps["l2"], gaps["dot"], _ratio(common, math.sqrt(sizes[0] * sizes[1])), _ratio(common, sum(sizes) - common)]


def _vectors(columns: tuple[pa.Array, ...], weigh: Weigher):
    """The vectors of both texts of each pair, a few pairs at a time in memory."""
    half = len(columns) // 2
    for at in range(0, len(columns[0]), AT_ONCE):
        weigh.refresh()
        for row in zip(*[values(c.slice(at, AT_ONCE)) for c in columns]):
            yield weigh(*row[:half]), weigh(*row[half:])


def _features(names: tuple[str, ...], model: TermModel, known_only: bool, compare, texts: DataFrame | None) -> FeatureSet:
    kind = pa.struct([(n, pa.float64()) for n in names])

    def build(df: DataFrame) -> DataFrame:
        _, make = model.weigher(known_only)
        kept: list[Weigher] = []  # one per task

        def run(*columns: pa.Array) -> pa.Array:
            if not kept:
                kept.append(make())
            found = [compare(left, right, kept[0].numbers.names) for left, right in _vectors(columns, kept[0])]
            made = zip(*found) if found else [[]] * len(names)
            return pa.StructArray.from_arrays([pa.array(map(float, v), pa.float64()) for v in made], fields=list(kind))

        pairs, parts = model.both_texts(df, texts)
        made = F.arrow_udf(run, "struct<" + ",".join(f"{n}:double" for n in names) + ">")(*parts)
        done = pairs.withColumn("__made", made)
        return done.withColumns({n: F.col("__made")[n] for n in names}).drop("__made", "__text1", "__text2")

    return FeatureSet(names, build)


def word_features(model: TermModel, k: int = TOP_K, texts: DataFrame | None = None) -> FeatureSet:
    """Features that need the word weights of `model`; `texts` as in `TermModel.both_texts`."""
    rare_idf, size = model.rare_idf, model.size
    return _features(WORD, model, False, lambda a, b, names: compared_words(a, b, names, rare_idf, size, k), texts)


def char_features(model: TermModel, texts: DataFrame | None = None) -> FeatureSet:
    """Features that need the character n-gram weights of `model`."""
    return _features(CHAR, model, True, compared_grams, texts)


def top_terms(model: TermModel, pairs: DataFrame, k: int = TOP_K, texts: DataFrame | None = None) -> DataFrame:
    """Pairs with the k terms of highest idf of the left text, known or not, as `top_terms`."""
    _, make = model.weigher(False)
    found, parts = model.both_texts(pairs, texts)

    def run(*columns: pa.Array) -> pa.Array:
        weigh, out = make(), []
        for at in range(0, len(columns[0]), AT_ONCE):
            weigh.refresh()
            for row in zip(*[values(c.slice(at, AT_ONCE)) for c in columns]):
                out.append([weigh.numbers.names[t] for t in ranked(weigh(*row), weigh.numbers.names, k)])
        return pa.array(out, pa.list_(pa.string()))

    return found.withColumn("top_terms", F.arrow_udf(run, "array<string>")(*parts[:len(parts) // 2])).drop("__text1", "__text2")
