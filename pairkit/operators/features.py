"""Feature sets: named builders that append one DOUBLE column per feature."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from pairkit.functions import ngrams, sequence, text as tx, vectors as vx

# Names of the features, in their order.
LEXICAL = ("len_q1_chars", "len_q2_chars", "char_len_diff", "len_q1_words", "len_q2_words",
           "word_len_diff", "token_intersection", "token_union", "jaccard", "overlap_min")
EMBEDDING = (*vx.STATS, "norm1", "norm2", "norm_diff")


@dataclass(frozen=True)
class FeatureSet:
    """A list of feature names and the function that appends them to a pair frame."""

    names: tuple[str, ...]
    build: Callable[[DataFrame], DataFrame] = field(compare=False)

    def __add__(self, other: FeatureSet) -> FeatureSet:
        """Both sets; a name both define keeps its first position and its last value."""
        names = tuple(dict.fromkeys([*self.names, *other.names]))
        return FeatureSet(names, lambda df: other.build(self.build(df)))

    def apply(self, df: DataFrame) -> DataFrame:
        return self.build(df)


def from_columns(columns: dict[str, Column]) -> FeatureSet:
    """User-defined features from expressions over the pair columns."""
    as_double = {n: c.cast("double") for n, c in columns.items()}
    return FeatureSet(tuple(columns), lambda df: df.withColumns(as_double))


def from_struct(names: Sequence[str], struct: Column) -> FeatureSet:
    """User-defined features from one struct column, such as a pandas or Arrow UDF call."""
    def build(df):
        packed = df.withColumn("__user", struct)
        return packed.withColumns({n: F.col("__user")[n].cast("double") for n in names}).drop("__user")

    return FeatureSet(tuple(names), build)


REGISTRY: dict[str, FeatureSet] = {}


def register(name: str, features: FeatureSet) -> FeatureSet:
    """Make a feature set available to models by name."""
    REGISTRY[name] = features
    return features


# ---- vectors ---------------------------------------------------------------

def embedding_features(length: int, kernel: str = "auto") -> FeatureSet:
    """Nine statistics of the whole vectors, their norms and the difference of these.

    Needs emb1, emb2, norm1 and norm2.
    """
    def build(df):
        stats = vx.add_vector_stats(df, "emb1", "emb2", [length], [""], kernel)
        return stats.withColumn("norm_diff", F.abs(F.col("norm1") - F.col("norm2")))

    return FeatureSet(EMBEDDING, build)


def prefix_features(length: int, dims: Sequence[int] | None = None, kernel: str = "auto") -> FeatureSet:
    return FeatureSet(tuple(vx.prefix_stat_names(length, dims)),
                      lambda df: vx.prefix_stats(df, length, dims, kernel=kernel))


# ---- text ------------------------------------------------------------------
# Token arrays are staged as columns of their own, so each is computed once per row
# however many features use it.

def with_tokens(df: DataFrame) -> DataFrame:
    """Stage token arrays and token sets of both texts."""
    tokens = df.withColumns({f"__t{i}": tx.whitespace_tokens(f"question{i}") for i in (1, 2)})
    return tokens.withColumns({f"__s{i}": F.array_distinct(f"__t{i}") for i in (1, 2)})


def drop_staged(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def length_columns() -> dict[str, Column]:
    chars = [F.length(f"question{i}") for i in (1, 2)]
    words = [F.size(f"__t{i}") for i in (1, 2)]
    return {"len_q1_chars": chars[0], "len_q2_chars": chars[1],
            "char_len_diff": F.abs(chars[0] - chars[1]),
            "len_q1_words": words[0], "len_q2_words": words[1],
            "word_len_diff": F.abs(words[0] - words[1])}


def overlap_columns() -> dict[str, Column]:
    """Sizes of the token sets' intersection and union, and the ratios made of them."""
    shared = F.size(F.array_intersect("__s1", "__s2"))
    sizes = [F.size(f"__s{i}") for i in (1, 2)]
    either = sizes[0] + sizes[1] - shared
    return {"token_intersection": shared, "token_union": either,
            "jaccard": tx.safe_div(shared, either),
            "overlap_min": tx.safe_div(shared, F.least(*sizes))}


def with_ngrams(df: DataFrame) -> DataFrame:
    """Stage the ratios of both texts' word n-gram sets; the n-grams stay in the task."""
    return df.withColumn("__ngrams", ngrams.ngram_struct("__t1", "__t2"))


def ngram_columns() -> dict[str, Column]:
    return {n: F.col("__ngrams")[n] for n in ngrams.NAMES}


def _first(side: int) -> Column:
    return F.get(f"__t{side}", F.lit(0))


def boundary_columns() -> dict[str, Column]:
    """Flags for equal first word, last word and first two words."""
    def last(side):
        return F.get(f"__t{side}", F.size(f"__t{side}") - 1)

    def flag(cond):
        return F.coalesce(cond, F.lit(False)).cast("double")

    two = [F.slice(f"__t{i}", 1, 2) for i in (1, 2)]
    return {"same_start_word": flag(_first(1) == _first(2)),
            "same_end_word": flag(last(1) == last(2)),
            "same_start_2gram": flag((F.size("__t1") >= 2) & (F.size("__t2") >= 2) & (two[0] == two[1]))}


def conditional_columns() -> dict[str, Column]:
    """Token overlap where the texts start, or end, with the same word; else 0."""
    common = F.col("common_word_pct")
    return {f"common_pct_when_same_{end}": F.when(F.col(f"same_{end}_word") == 1, common).otherwise(0.0)
            for end in ("start", "end")}


def word_shape_columns() -> dict[str, Column]:
    out = {f"len_q{i}_unique_words": F.size(f"__s{i}") for i in (1, 2)}
    for i in (1, 2):
        letters = F.aggregate(f"__t{i}", F.lit(0), lambda acc, w: acc + F.length(w))
        out[f"avg_word_len_q{i}"] = tx.safe_div(letters, F.size(f"__t{i}"))
    out["char_len_ratio"] = tx.safe_div(F.length("question1"), F.length("question2"))
    return out


def surface_columns() -> dict[str, Column]:
    """Counts of capitals, question and exclamation marks, digits and math symbols."""
    counters = {
        "caps": lambda q: tx.count_matching(q, r"\p{Lu}"),
        "qmarks": lambda q: tx.count_any(q, "?"),
        "excl": lambda q: tx.count_any(q, "!"),
        "digits": lambda q: tx.count_matching(q, r"\p{Nd}"),
        "math": lambda q: tx.count_any(q, tx.MATH_SYMBOLS),
    }
    out = {}
    for kind, count in counters.items():
        for i in (1, 2):
            out[f"n_{kind}_q{i}"] = count(f"question{i}")
        if kind == "caps":
            out["caps_diff"] = F.abs(out["n_caps_q1"] - out["n_caps_q2"])
    return out


def starter_columns() -> dict[str, Column]:
    first = [F.coalesce(_first(i), F.lit("")) for i in (1, 2)]
    out = {f"q{i}_starts_{w}": (first[i - 1] == w) for w in tx.STARTERS for i in (1, 2)}
    out["q1q2_same_starter"] = first[0].isin(*tx.STARTERS) & (first[0] == first[1])
    return out


def question_columns() -> dict[str, Column]:
    return {f"q{i}_is_question": tx.is_question(f"question{i}") for i in (1, 2)}


def _doubles(columns: dict[str, Column]) -> dict[str, Column]:
    return {n: c.cast("double") for n, c in columns.items()}


def _lexical(df: DataFrame) -> DataFrame:
    staged = with_tokens(df)
    return drop_staged(staged.withColumns(_doubles({**length_columns(), **overlap_columns()})))


def _classical(df: DataFrame) -> DataFrame:
    staged = with_ngrams(with_tokens(df))
    first = {**ngram_columns(), **boundary_columns(), **length_columns(), **word_shape_columns(),
             **surface_columns(), **starter_columns(), **question_columns()}
    done = staged.withColumns(_doubles(first)).withColumn("common_word_pct", F.col("ngram_1_jaccard"))
    return drop_staged(done.withColumns(conditional_columns()))


_SURFACE = ("n_caps_q1", "n_caps_q2", "caps_diff", *(
    f"n_{kind}_q{i}" for kind in ("qmarks", "excl", "digits", "math") for i in (1, 2)))
# Names of the features, in their order.
CLASSICAL = (
    *ngrams.NAMES,
    "common_word_pct", "same_start_word", "same_end_word", "same_start_2gram",
    "common_pct_when_same_start", "common_pct_when_same_end", *LEXICAL[:6],
    "len_q1_unique_words", "len_q2_unique_words", "avg_word_len_q1", "avg_word_len_q2",
    "char_len_ratio", *_SURFACE,
    *(f"q{i}_starts_{w}" for w in tx.STARTERS for i in (1, 2)),
    "q1q2_same_starter", "q1_is_question", "q2_is_question",
)

lexical_features = register("lexical", FeatureSet(LEXICAL, _lexical))
classical_text_features = register("classical_text", FeatureSet(CLASSICAL, _classical))

def matching_block_features() -> FeatureSet:
    """Similarity by matching blocks, for those who add it: Python within the row, so no built-in
    set has it."""
    return from_struct(sequence.NAMES, sequence.sequence_struct("question1", "question2"))


# ---- combinations ----------------------------------------------------------

def all_features(length: int, kernel: str = "auto") -> FeatureSet:
    """Embedding and lexical features."""
    return embedding_features(length, kernel) + lexical_features


def prefix_all_features(length: int, dims: Sequence[int] | None = None, kernel: str = "auto") -> FeatureSet:
    """Prefix statistics and lexical features."""
    return prefix_features(length, dims, kernel) + lexical_features


def prefix_classical_features(length: int, dims: Sequence[int] | None = None,
                              kernel: str = "auto") -> FeatureSet:
    """Prefix statistics, lexical and classical text features."""
    return prefix_all_features(length, dims, kernel) + classical_text_features


def build_matrix(df: DataFrame, features: FeatureSet, keep: Sequence[str] = ("qid1", "qid2", "label"),
                 output: str = "features", built: bool = False) -> DataFrame:
    """Key columns and one feature vector whose positions follow `features.names`.

    Set `built` when the feature columns are there already, as in a written table.
    """
    from pyspark.ml.feature import VectorAssembler

    frame = df if built else features.apply(df)
    return (VectorAssembler(inputCols=list(features.names), outputCol=output, handleInvalid="error")
            .transform(frame).select(*keep, output))
