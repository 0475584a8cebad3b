"""Combining member models: averages, weighted averages and stacking."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairkit.operators import joins, models, splits
from pairkit.session import materialize

KEY = ("qid1", "qid2")


def average(members: Sequence[DataFrame], weights: Sequence[float] | None = None) -> DataFrame:
    """Aligned members with `proba`, their (weighted) mean; weights are scaled to sum 1."""
    weights = [1.0] * len(members) if weights is None else [float(w) for w in weights]
    if len(weights) != len(members) or sum(weights) <= 0:
        raise ValueError("give one weight per member, with a positive sum")
    parts = [F.lit(w / sum(weights)) * F.col(f"p{i}") for i, w in enumerate(weights)]
    mean = parts[0]
    for part in parts[1:]:
        mean = mean + part
    return joins.align_members(members).withColumn("proba", mean)


# ---- stacking ----------------------------------------------------------------

def out_of_fold(members: Sequence, matrices: Sequence[DataFrame], folds: DataFrame, k: int) -> DataFrame:
    """(qid1, qid2, label, fold, p0, p1, ...): every row scored once per member, by a
    fit that did not see its fold.

    Feature rows are wide: they meet their folds once per member, in a written table that all fits read.
    """
    fold = joins.one_per_key(folds, "fold")
    marked = [materialize(matrix.join(fold, list(KEY)), "fold-rows") for matrix in matrices]
    parts = []
    for f in range(k):
        scored = []
        for member, rows in zip(members, marked):
            fitted = member.fit(rows.filter(F.col("fold") != f).drop("fold"))
            scored.append(fitted.predict_proba(rows.filter(F.col("fold") == f).drop("fold")))
        parts.append(joins.align_members(scored).withColumn("fold", F.lit(f)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@dataclass
class FittedEnsemble:
    fitted: Sequence
    weights: Sequence[float] | None
    meta: PipelineModel | None

    def predict_proba(self, matrices: Sequence[DataFrame]) -> DataFrame:
        """(qid1, qid2, label, proba) from the feature tables of the members, in order."""
        scored = [m.predict_proba(x) for m, x in zip(self.fitted, matrices)]
        if self.meta is None:
            combined = average(scored, self.weights)
        else:
            combined = self.meta.transform(joins.align_members(scored)).withColumn(
                "proba", vector_to_array("probability")[1])
        return combined.select(*KEY, "label", "proba")

    def report(self, members: Sequence) -> DataFrame:
        """(member, coefficient): meta-model coefficients, or scaled weights."""
        if self.meta is not None:
            values = [float(c) for c in self.meta.stages[-1].coefficients]
        else:
            raw = self.weights or [1.0] * len(members)
            values = [w / sum(raw) for w in raw]
        spark = SparkSession.getActiveSession()
        return spark.createDataFrame([(i, m.name, c) for i, (m, c) in enumerate(zip(members, values))],
                                     "position int, member string, coefficient double")


@dataclass
class Ensemble:
    """Members combined by "mean" (optionally weighted) or "stacking"."""

    members: Sequence
    strategy: str = "mean"
    weights: Sequence[float] | None = None
    meta_folds: int = 5
    threshold: float = 0.5
    name: str = "Ensemble"
    oof: DataFrame | None = None

    @property
    def needs_training_corpus(self) -> bool:
        return any(m.needs_training_corpus for m in self.members)

    def build_features(self, pairs: DataFrame, train: DataFrame | None = None) -> list[DataFrame]:
        """One written feature table per member; folds and refits read it again."""
        return [materialize(m.build_features(pairs, train), "member") for m in self.members]

    def fit(self, matrices: Sequence[DataFrame]) -> FittedEnsemble:
        meta = None
        if self.strategy == "stacking":
            folds = materialize(splits.stratified_kfold(matrices[0].select(*KEY, "label"), self.meta_folds), "folds")
            self.oof = materialize(out_of_fold(self.members, matrices, folds, self.meta_folds), "oof")
            meta = fit_meta(self.oof, len(self.members))
        return FittedEnsemble([m.fit(x) for m, x in zip(self.members, matrices)], self.weights, meta)

    def get_config(self) -> dict:
        return {"model_class": self.name, "strategy": self.strategy, "weights": self.weights,
                "meta_folds": self.meta_folds if self.strategy == "stacking" else None,
                "threshold": self.threshold, "n_members": len(self.members),
                "members": [m.name for m in self.members],
                "member_configs": [m.get_config() for m in self.members]}


def fit_meta(oof: DataFrame, n_members: int) -> PipelineModel:
    """Standardised logistic regression over the members' out-of-fold probabilities."""
    columns = [f"p{i}" for i in range(n_members)]
    return Pipeline(stages=[
        VectorAssembler(inputCols=columns, outputCol="stack"),
        StandardScaler(inputCol="stack", outputCol="stack_scaled", withMean=True, withStd=True),
        LogisticRegression(labelCol="label", featuresCol="stack_scaled", standardization=False,
                           regParam=1.0 / max(oof.count(), 1), maxIter=1000)]).fit(oof)


# Members, strategy and weights of the named ensembles.
PRESETS = {
    "mean": (("boosted_a", "boosted_b", "siamese"), "mean", None),
    "mean_weighted": (("boosted_a", "boosted_b", "siamese"), "mean", (2.0, 2.0, 1.0)),
    "stack": (("boosted_a", "boosted_b", "siamese"), "stacking", None),
    "trees_mean": (("boosted_a", "boosted_b", "forest"), "mean", None),
    "classical_mean": (("boosted_classical", "siamese", "boosted_b"), "mean", None),
    "classical_weighted": (("boosted_classical", "siamese", "boosted_b"), "mean", (2.0, 1.0, 2.0)),
    "classical_stack": (("boosted_classical", "siamese", "boosted_b"), "stacking", None),
}


def preset(name: str, dim: int, dims: Sequence[int] | None = None, small: bool = False, **options) -> Ensemble:
    """A named ensemble; `small` shrinks its members for trials on little data."""
    trees = models.SMALL if small else {}
    classical = {"n_topics": 5} if small else {}
    makers = {
        "boosted_a": lambda: models.boosted_trees_a(dim, dims, **trees),
        "boosted_b": lambda: models.boosted_trees_b(
            dim, dims, **({"iterations": trees["n_estimators"], "depth": trees["max_depth"]} if small else {})),
        "forest": lambda: models.random_forest(dim, dims, **trees),
        "siamese": lambda: models.Siamese(**({"hidden": 8, "max_iter": 20} if small else {})),
        "boosted_classical": lambda: models.boosted_trees_classical(dim, dims, **classical, **trees),
    }
    members, strategy, weights = PRESETS[name]
    return Ensemble([makers[m]() for m in members], strategy, weights, name=name, **options)
