"""Pair classifiers on Spark ML.

A `PairModel` names its features, builds a feature table, fits on the rows it is given
and returns probabilities by pair. Users may supply any object with `build_features`,
`fit` and a fitted counterpart with `predict_proba`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairkit.functions import vectors as vx
from pairkit.operators import dictionary, features as fx, networks, ranking, sparse_pairs, splits, topics, weighting
from pairkit.session import materialize
from pairkit.sources import stores

KEY = ("qid1", "qid2")
Params = dict[str, Any]

# Operating points and preset parameters.
COSINE_THRESHOLD, SIAMESE_THRESHOLD, MAX_POSITIVE_WEIGHT = 0.76, 0.42, 2.0
BOOSTED_A = {"n_estimators": 700, "max_depth": 8, "learning_rate": 0.05, "subsample": 0.9,
             "colsample_bytree": 0.8}
BOOSTED_B = {"iterations": 500, "depth": 8, "learning_rate": 0.05}
FOREST = {"n_estimators": 300, "max_depth": 12, "min_samples_leaf": 2}
# Smaller presets for trials on a laptop.
SMALL = {"n_estimators": 10, "max_depth": 4}

# Names that parameter documents use, and the Spark ML parameter each one sets.
BOOSTED_NAMES = {"n_estimators": "maxIter", "iterations": "maxIter", "max_depth": "maxDepth",
                 "depth": "maxDepth", "learning_rate": "stepSize", "subsample": "subsamplingRate",
                 "min_child_weight": "minInstancesPerNode", "colsample_bytree": "featureSubsetStrategy"}
FOREST_NAMES = {"n_estimators": "numTrees", "max_depth": "maxDepth", "subsample": "subsamplingRate",
                "min_samples_leaf": "minInstancesPerNode", "max_features": "featureSubsetStrategy"}
LINEAR_NAMES = {"max_iter": "maxIter", "C": "C"}


class FittedPairModel(Protocol):
    def predict_proba(self, matrix: DataFrame) -> DataFrame: ...


def translate(params: Params, names: dict[str, str]) -> tuple[Params, list[str]]:
    """Spark parameters for the known names, and the names without a counterpart."""
    out, unknown = {}, []
    for name, value in params.items():
        target = names.get(name, name if name in names.values() else None)
        if target is None:
            unknown.append(name)
        elif target == "featureSubsetStrategy":
            out[target] = str(value)
        elif target in ("maxIter", "maxDepth", "numTrees", "minInstancesPerNode"):
            out[target] = max(1, math.ceil(value))
        else:
            out[target] = value
    return out, unknown


@dataclass(frozen=True)
class EarlyStopping:
    """When to stop boosting: `share` of the training pairs is held out, and trees are added until
    the loss on these falls by less than `tolerance` of itself. The best number of trees is kept."""

    share: float = 0.05
    tolerance: float = 0.0
    seed: int = splits.DEFAULT_SEED

    def mark(self, rows: DataFrame) -> DataFrame:
        """Rows that have a key, with `is_validation`; all rows of a pair are on one side."""
        held = splits.held_out(splits.one_per_pair(rows), self.share, self.seed)
        return rows.filter(" AND ".join(f"{k} IS NOT NULL" for k in KEY)).withColumn("is_validation", held)


@dataclass
class Fitted:
    """A fitted pipeline and the names of the features it reads."""

    pipeline: PipelineModel
    names: Sequence[str]

    def predict_proba(self, matrix: DataFrame) -> DataFrame:
        """(qid1, qid2, label, proba)."""
        scored = self.pipeline.transform(matrix)
        return scored.select(*KEY, "label", vector_to_array("probability")[1].alias("proba"))

    @property
    def n_trees(self) -> int | None:
        """Trees of the model, after early stopping if there was any; None for models without."""
        return getattr(self.pipeline.stages[-1], "getNumTrees", None)

    def feature_importances(self) -> DataFrame:
        """(feature, importance), for models that have importances."""
        values = [float(x) for x in self.pipeline.stages[-1].featureImportances.toArray()]
        spark = SparkSession.getActiveSession()
        return spark.createDataFrame(list(zip(self.names, values)), "feature string, importance double")

    def save(self, path: str, config: dict[str, Any] | None = None) -> None:
        """The fitted stages, the names of their features and the model's configuration."""
        self.pipeline.write().save(f"{path}/pipeline")
        stores.write_document(SparkSession.getActiveSession(), {"names": list(self.names), "config": config or {}}, f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Fitted:
        """A saved model, in any session; scores tables whose features have the same names."""
        return cls(PipelineModel.load(f"{path}/pipeline"), tuple(stores.read_document(spark, f"{path}/model")["names"]))


@dataclass
class PairModel:
    """One classifier: how to make its features and its estimator."""

    name: str
    make_features: Callable[[DataFrame], fx.FeatureSet]
    make_estimator: Callable[[Params, int], Estimator]
    param_names: dict[str, str]
    params: Params = field(default_factory=dict)
    threshold: float = 0.5
    weights: str | None = None
    param_space: dict[str, dict[str, Any]] = field(default_factory=dict)
    needs_training_corpus: bool = False
    tuning: dict[str, Any] = field(default_factory=lambda: {"enabled": False})
    feature_names: tuple[str, ...] = ()
    early_stopping: EarlyStopping | None = None

    def build_features(self, pairs: DataFrame, train: DataFrame | None = None) -> DataFrame:
        """(qid1, qid2, label, features) of all pairs. Corpus statistics come from
        `train`, or from all pairs when scoring data nobody evaluates."""
        chosen = self.make_features(pairs if train is None else train)
        self.feature_names = chosen.names
        return fx.build_matrix(pairs, chosen)

    def fit(self, matrix: DataFrame) -> Fitted:
        rows = matrix if self.weights is None else splits.add_weights(matrix, self.weights, MAX_POSITIVE_WEIGHT)
        known, _ = translate(self.params, self.param_names)
        size = rows.count() if "C" in self.param_names else 0
        estimator = self.make_estimator(known, size)
        if self.early_stopping is not None:
            if not estimator.hasParam("validationIndicatorCol"):
                raise ValueError(f"{self.name} has no rounds to stop")
            rows = materialize(self.early_stopping.mark(rows), "validation")  # each tree reads them
            # one held-out pair needs another one to learn from
            if not rows.filter("NOT is_validation").isEmpty():
                estimator = estimator.copy().setValidationIndicatorCol("is_validation")
                estimator.set(estimator.validationTol, self.early_stopping.tolerance)
        pipeline = estimator if isinstance(estimator, Pipeline) else Pipeline(stages=[estimator])
        return Fitted(pipeline.fit(rows), self.feature_names)

    def with_params(self, params: Params) -> PairModel:
        return replace(self, params={**self.params, **params})

    def apply_tuned_params(self, best: Params, source: str | None = None, cv_score: float | None = None,
                           method: str = "external") -> PairModel:
        """Model with the tuned parameters and a record of where they came from."""
        _, ignored = translate(best, self.param_names)
        record = {"enabled": True, "method": method, "best_cv_score": cv_score,
                  "best_params": dict(best), "source": source, "ignored": ignored}
        return replace(self.with_params(best), tuning=record)

    def get_tuning_spec(self) -> dict[str, Any]:
        """What a search may draw; parameters without a counterpart in Spark would make trials that differ in nothing."""
        _, ignored = translate(dict.fromkeys(self.param_space, 1), self.param_names)
        drawn = {n: spec for n, spec in self.param_space.items() if n not in ignored}
        return {"param_space": drawn, "ignored": ignored, "scoring": "f1"}

    def get_config(self) -> dict[str, Any]:
        return {"model_class": self.name, "hyperparams": dict(self.params), "threshold": self.threshold,
                "tuning": self.tuning, "early_stopping": None if self.early_stopping is None else vars(self.early_stopping),
                "n_features": len(self.feature_names), "feature_names": list(self.feature_names)}


# ---- estimators --------------------------------------------------------------

def _boosted(known: Params, _size: int) -> Estimator:
    return GBTClassifier(labelCol="label", featuresCol="features", seed=42, **known)


def _forest(known: Params, _size: int) -> Estimator:
    # Each row keeps its node in every tree; otherwise each pass walks every tree from its root again.
    return RandomForestClassifier(labelCol="label", featuresCol="features", seed=42, cacheNodeIds=True, **known)


def _linear(known: Params, size: int) -> Estimator:
    """Standardised logistic regression; C is the inverse penalty per row."""
    penalty = 1.0 / (known.get("C", 1.0) * max(size, 1))
    return Pipeline(stages=[
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
        LogisticRegression(labelCol="label", featuresCol="scaled", weightCol="weight", standardization=False,
                           regParam=penalty, elasticNetParam=0.0, maxIter=known.get("maxIter", 1000))])


# ---- presets -----------------------------------------------------------------

# Search spaces of the presets.
BOOSTED_SPACE = {
    "max_depth": {"type": "int", "low": 3, "high": 12},
    "min_child_weight": {"type": "int", "low": 1, "high": 10},
    "learning_rate": {"type": "float", "low": 0.01, "high": 0.3, "log": True},
    "n_estimators": {"type": "int", "low": 100, "high": 1000},
    "subsample": {"type": "float", "low": 0.5, "high": 1.0},
    "colsample_bytree": {"type": "float", "low": 0.5, "high": 1.0},
    "reg_alpha": {"type": "float", "low": 0.01, "high": 100.0, "log": True},
}
BOOSTED_B_SPACE = {
    "iterations": {"type": "int", "low": 100, "high": 1000},
    "depth": {"type": "int", "low": 4, "high": 10},
    "learning_rate": {"type": "float", "low": 0.01, "high": 0.3, "log": True},
    "l2_leaf_reg": {"type": "float", "low": 1.0, "high": 20.0, "log": True},
}
FOREST_SPACE = {
    "n_estimators": {"type": "int", "low": 20, "high": 1000},
    "max_depth": {"type": "int", "low": 4, "high": 10},
    "min_samples_split": {"type": "int", "low": 2, "high": 20},
    "min_samples_leaf": {"type": "int", "low": 1, "high": 20},
}
# Own choices: search spaces of the network and of logistic regression.
SIAMESE_SPACE = {
    "hidden": {"type": "int", "low": 16, "high": 512, "log": True},
    "layers": {"type": "int", "low": 1, "high": 3},
    "rate": {"type": "float", "low": 0.0001, "high": 0.05, "log": True},
    "decay": {"type": "float", "low": 0.00001, "high": 0.01, "log": True},
}
LINEAR_SPACE = {"C": {"type": "float", "low": 0.001, "high": 100.0, "log": True}}


def logistic_regression(dim: int, **params) -> PairModel:
    """Embedding and lexical features, standardised, with balanced class weights."""
    return PairModel("LogisticRegression", lambda _: fx.all_features(dim), _linear, LINEAR_NAMES,
                     {"max_iter": 1000, **params}, weights="balanced", param_space=LINEAR_SPACE)


def boosted_trees_a(dim: int, dims=None, early_stopping: EarlyStopping | None = None, **params) -> PairModel:
    return PairModel("BoostedTreesA", lambda _: fx.prefix_all_features(dim, dims), _boosted, BOOSTED_NAMES,
                     {**BOOSTED_A, **params}, param_space=BOOSTED_SPACE, early_stopping=early_stopping)


def boosted_trees_b(dim: int, dims=None, early_stopping: EarlyStopping | None = None, **params) -> PairModel:
    return PairModel("BoostedTreesB", lambda _: fx.prefix_all_features(dim, dims), _boosted, BOOSTED_NAMES,
                     {**BOOSTED_B, **params}, param_space=BOOSTED_B_SPACE, early_stopping=early_stopping)


def full_classical_features(train: DataFrame, dim: int, dims=None, n_topics: int = 100,
                            max_features: int | None = None) -> fx.FeatureSet:
    """Every feature: vector prefixes, text, word and character weights, topics. The
    corpus-fitted parts see the texts of `train` only; `max_features` caps the topics' vocabulary."""
    corpus = materialize(dictionary.distinct_texts(dictionary.corpus(train)), "texts")
    words, chars = weighting.fit_tfidf(corpus), weighting.fit_char(corpus)
    lsi = topics.fit_lsi(corpus, n_topics, max_features)
    # The mixture's vocabulary is that of the indexing, so its terms are counted once.
    lda = topics.fit_lda(corpus, n_topics, terms=lsi.terms)
    return fx.prefix_classical_features(dim, dims) + corpus_features(words, chars, lsi, lda)


def corpus_features(words: weighting.TermModel, chars: weighting.TermModel, lsi: topics.LsiModel, lda: topics.LdaModel) -> fx.FeatureSet:
    """Word, character and topic features; the distinct texts of the pairs are written once for all of them."""
    def parts(texts: DataFrame | None) -> fx.FeatureSet:
        return (sparse_pairs.word_features(words, texts=texts) + sparse_pairs.char_features(chars, texts=texts)
                + topics.topic_features(lsi, lda, texts))

    def build(df: DataFrame) -> DataFrame:
        return parts(materialize(dictionary.distinct_texts(dictionary.corpus(df)), "texts")).build(df)

    return fx.FeatureSet(parts(None).names, build)


def boosted_trees_classical(dim: int, dims=None, n_topics: int = 100,
                            max_features: int | None = None, early_stopping: EarlyStopping | None = None,
                            **params) -> PairModel:
    return PairModel("BoostedTreesClassical",
                     lambda train: full_classical_features(train, dim, dims, n_topics, max_features),
                     _boosted, BOOSTED_NAMES, {**BOOSTED_A, **params}, param_space=BOOSTED_SPACE,
                     needs_training_corpus=True, early_stopping=early_stopping)


def random_forest(dim: int, dims=None, **params) -> PairModel:
    return PairModel("RandomForest", lambda _: fx.prefix_all_features(dim, dims), _forest, FOREST_NAMES,
                     {**FOREST, **params}, param_space=FOREST_SPACE)


@dataclass
class TopKForest:
    """Random forest on the k features that a first forest finds most important."""

    base: PairModel
    k: int = 10
    name: str = "RandomForestTopK"
    threshold: float = 0.5
    needs_training_corpus: bool = False
    selected: tuple[str, ...] = ()

    def build_features(self, pairs: DataFrame, train: DataFrame | None = None) -> DataFrame:
        return self.base.build_features(pairs, train)

    def fit(self, matrix: DataFrame) -> Fitted:
        ranked = ranking.rank_importances(self.base.fit(matrix).feature_importances())
        # At most k of the model's own feature names.
        self.selected = tuple(r["feature"] for r in ranked.limit(self.k).collect())
        names = list(self.base.feature_names)
        slicer = VectorSlicer(inputCol="features", outputCol="chosen",
                              indices=[names.index(n) for n in self.selected])
        known, _ = translate(self.base.params, FOREST_NAMES)
        forest = _forest(known, 0).setFeaturesCol("chosen")
        return Fitted(Pipeline(stages=[slicer, forest]).fit(matrix), self.selected)

    def with_params(self, params: Params) -> TopKForest:
        return replace(self, base=self.base.with_params(params))

    def get_tuning_spec(self) -> dict[str, Any]:
        return self.base.get_tuning_spec()

    def get_config(self) -> dict[str, Any]:
        return {**self.base.get_config(), "model_class": self.name, "top_k": self.k,
                "selected_feature_names": list(self.selected)}


@dataclass
class CosineThreshold:
    """The cosine itself as the score; nothing is fitted."""

    name: str = "CosineThreshold"
    threshold: float = COSINE_THRESHOLD
    needs_training_corpus: bool = False
    feature_names: tuple[str, ...] = ("cos_sim",)

    def build_features(self, pairs: DataFrame, train: DataFrame | None = None) -> DataFrame:
        return pairs.select(*KEY, "label", vx.cosine("emb1", "emb2").alias("cos_sim"))

    def fit(self, matrix: DataFrame) -> CosineThreshold:
        return self

    def predict_proba(self, matrix: DataFrame) -> DataFrame:
        return matrix.select(*KEY, "label", F.col("cos_sim").alias("proba"))

    def with_params(self, params: Params) -> CosineThreshold:
        """The threshold is all there is to set."""
        return replace(self, **params)

    def get_tuning_spec(self) -> dict[str, Any]:
        return {"param_space": {}, "scoring": "f1"}

    def get_config(self) -> dict[str, Any]:
        return {"model_class": self.name, "threshold": self.threshold}


@dataclass
class Siamese:
    """Shallow network over [u, v, |u-v|, u*v, scalars] of the two vectors.

    Rows weigh by their class, and a hold-out of the training pairs stops the rounds.
    """

    hidden: int = 64
    layers: int = 1
    max_iter: int = 100
    rate: float = 0.02
    decay: float = 0.0
    early_stopping: EarlyStopping | None = EarlyStopping()
    patience: int = 10
    seed: int = 42
    name: str = "Siamese"
    threshold: float = SIAMESE_THRESHOLD
    needs_training_corpus: bool = False
    feature_names: tuple[str, ...] = ()

    def build_features(self, pairs: DataFrame, train: DataFrame | None = None) -> DataFrame:
        """Expects emb1, emb2, norm1, norm2, and optionally score features `ce`."""
        scalars = F.array(*vx.scalar_bridge().values())
        if "ce" in pairs.columns:
            scalars = F.concat(scalars, F.transform("ce", lambda x: x.cast("double")))
        vector = vx.interaction_vector(scalars=scalars)
        return pairs.select(*KEY, "label", array_to_vector(vector).alias("features"))

    def fit(self, matrix: DataFrame) -> networks.FittedNetwork:
        rows = splits.add_weights(matrix, "positive_weight", MAX_POSITIVE_WEIGHT)
        if self.early_stopping is not None:
            marked = self.early_stopping.mark(rows)
            rows = rows if marked.filter("NOT is_validation").isEmpty() else marked
        return networks.fit_network(rows, [self.hidden] * self.layers, self.max_iter, self.rate, self.decay, self.patience, seed=self.seed)

    def with_params(self, params: Params) -> Siamese:
        return replace(self, **params)

    def get_tuning_spec(self) -> dict[str, Any]:
        return {"param_space": SIAMESE_SPACE, "scoring": "f1"}

    def get_config(self) -> dict[str, Any]:
        return {"model_class": self.name, "hidden": self.hidden, "layers": self.layers, "max_iter": self.max_iter, "rate": self.rate,
                "decay": self.decay, "patience": self.patience, "threshold": self.threshold,
                "early_stopping": None if self.early_stopping is None else vars(self.early_stopping)}


# Every model by the name it reports.
MODELS = {
    "LogisticRegression": lambda dim, dims, **p: logistic_regression(dim, **p),
    "BoostedTreesA": lambda dim, dims, **p: boosted_trees_a(dim, dims, **p),
    "BoostedTreesB": lambda dim, dims, **p: boosted_trees_b(dim, dims, **p),
    "BoostedTreesClassical": lambda dim, dims, **p: boosted_trees_classical(dim, dims, **p),
    "RandomForest": lambda dim, dims, **p: random_forest(dim, dims, **p),
    "RandomForestTopK": lambda dim, dims, **p: TopKForest(random_forest(dim, dims, **p)),
    "CosineThreshold": lambda dim, dims, **p: CosineThreshold(**p),
    "Siamese": lambda dim, dims, **p: Siamese(**p),
}


def by_name(name: str, dim: int, dims=None, **params):
    """The model of a name; `params` are its own parameters."""
    if name not in MODELS:
        raise KeyError(f"no model {name}; there are {sorted(MODELS)}")
    return MODELS[name](dim, dims, **params)
