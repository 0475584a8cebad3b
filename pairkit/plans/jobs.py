"""The jobs a user runs: load pairs, evaluate a model, score unlabelled pairs, tune a model."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairkit.operators import evaluate, joins, models, ranking, search, splits
from pairkit.session import materialize
from pairkit.sources import pairs as src, stores

KEY = ("qid1", "qid2")


def _filtered(matrix, keys: DataFrame):
    """The rows of a feature table, or of each table of an ensemble, with the given keys."""
    if isinstance(matrix, list):
        return [_filtered(m, keys) for m in matrix]
    return matrix.join(keys.select(*KEY), list(KEY), "left_semi")


def _written(matrix, name: str):
    return matrix if isinstance(matrix, list) else materialize(matrix, name)


def _texts(pairs: DataFrame) -> DataFrame:
    """The texts of each pair, once; of a pair given with several the first in order."""
    if "question1" not in pairs.columns:
        return pairs.select(*KEY, F.lit("").alias("question1"), F.lit("").alias("question2")).distinct()
    first = F.min(F.struct("question1", "question2")).alias("t")
    return pairs.groupBy(*KEY).agg(first).select(*KEY, "t.question1", "t.question2")


def load_pairs(spark: SparkSession, folder: str, vectors: DataFrame, limit: int | None = None,
               hot_share: float | None = None, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Labelled pairs of a folder joined to both vectors, and one row that says what became of the rows read.

    The counts come from the two tables the job writes, not from reading its input again:
    n_rows read, n_bad (ids or label not numbers), n_missing (no vector), n_kept. Texts that no vector is
    joined to are neither written nor moved where `may_have_vectors` tells them. The limit
    takes the first rows, by row_no, of those that have both vectors.
    """
    rows = joins.may_have_vectors(src.typed_labelled(src.read_pairs(spark, folder, multi_line)), vectors)
    wanted = F.col("is_good") & F.col("may_have")
    typed = materialize(rows.withColumns({q: F.when(wanted, F.col(q)) for q in ("question1", "question2")}), "typed")
    joined = materialize(joins.attach_vectors(typed.filter(wanted).drop("is_good", "may_have"), vectors, hot_share), "loaded")
    rows = joined if limit is None else ranking.head_limit(joined, limit)
    read = typed.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("is_good")).alias("n_bad")).first()
    kept = joined.agg(F.count(F.lit(1))).first()[0]
    counts = {"n_rows": read["n_rows"], "n_bad": read["n_bad"], "n_missing": read["n_rows"] - read["n_bad"] - kept,
              "n_kept": kept if limit is None else min(kept, limit)}
    return rows, spark.createDataFrame([tuple(counts.values())], ", ".join(f"{n} bigint" for n in counts))


def configured_model(spark: SparkSession, name: str, dim: int, dims: Sequence[int] | None = None,
                     params_path: str | None = None, **options):
    """The model of a name, with the parameters of a best-parameters document that was written for it."""
    model = models.by_name(name, dim, dims, **options)
    if params_path is None:
        return model
    doc = stores.read_params(spark, params_path, model.name)
    if not doc["matches"]:
        raise ValueError(f"{params_path} was tuned for {doc.get('model')}, not for {model.name}")
    if hasattr(model, "apply_tuned_params"):
        return model.apply_tuned_params(doc["best_params"], params_path, doc.get("best_score"), doc.get("method", "external"))
    return model.with_params(doc["best_params"])


def run_experiment(spark: SparkSession, pairs: DataFrame, model, name: str, split_path: str,
                   results: str, test_size: float = 0.2, threshold: float | None = None,
                   arguments: dict[str, Any] | None = None) -> DataFrame:
    """Evaluate a model on the saved split of `pairs` and write all artefacts.

    Corpus statistics and fits see training rows only; all rows of a pair are on one side of the
    split. Every row of a test pair is scored and counted. Returns the metrics row.
    """
    threshold = model.threshold if threshold is None else threshold
    split = splits.get_split(spark, split_path, splits.one_per_pair(pairs), test_size)
    train, test = (split.filter(F.col("split") == part) for part in ("train", "test"))
    corpus = pairs.join(train.select(*KEY), list(KEY), "left_semi") if model.needs_training_corpus else None
    matrix = _written(model.build_features(pairs, corpus), "features")
    fitted = model.fit(_filtered(matrix, train))
    scored = materialize(fitted.predict_proba(_filtered(matrix, test)), "scored")
    decided = evaluate.decide(scored, threshold)
    result = evaluate.metrics(decided)
    run_at = dt.datetime.now().strftime("%Y-%m-%d %H:%M:%S")
    config = evaluate.run_config(name, run_at, model, threshold, scored.count(), arguments)
    errors = evaluate.error_table(decided.filter("label <> pred").join(_texts(pairs), list(KEY)))
    if getattr(fitted, "n_trees", None) is not None:
        config["n_trees"] = fitted.n_trees
    importances = None
    if hasattr(fitted, "pipeline") and hasattr(fitted.pipeline.stages[-1], "featureImportances"):
        importances = ranking.rank_importances(fitted.feature_importances())
    stores.write_run(spark, f"{results}/{name}", result, errors, config, importances)
    stores.append_ledger(evaluate.ledger_row(
        decided, run_at, name, model.name, len(getattr(model, "feature_names", ())), threshold),
        f"{results}/all_experiments")
    return result


def score_all(labelled: DataFrame, unlabelled: DataFrame, model, ids: DataFrame | None = None,
              default: float | None = None) -> DataFrame:
    """Fit on all labelled pairs and give every test_id a probability.

    Features are built for both sets together, so corpus statistics cover them all.
    Both frames need the columns the model reads; `unlabelled` also test_id. Test ids
    of `ids` (by default those of `unlabelled`) without a score get `default`.
    """
    # The id of an unlabelled pair stands in for its key; that it has no label tells it apart.
    keyed = unlabelled.withColumns({"qid1": F.lit(-1).cast("bigint"), "qid2": F.col("test_id"),
                                    "label": F.lit(None).cast("int")}).drop("test_id")
    shared = [c for c in labelled.columns if c in keyed.columns]
    both = joins.union_train_score(labelled.select(*shared), keyed.select(*shared))
    matrix = _written(model.build_features(both.drop("split")), "features")

    def part(x, scoring: bool):
        if isinstance(x, list):
            return [part(m, scoring) for m in x]
        return x.filter(F.col("label").isNull() == F.lit(scoring))

    scored = model.fit(part(matrix, False)).predict_proba(part(matrix, True))
    by_id = scored.select(F.col("qid2").alias("test_id"), "proba")
    return stores.submission(unlabelled if ids is None else ids, by_id, default)


def tune(spark: SparkSession, pairs: DataFrame, model, name: str, split_path: str, folder: str,
         n_trials: int = 10, k: int = 5, seed: int = 42, candidates: Sequence[dict] | None = None,
         fresh: bool = False, prune: bool = True, parallelism: int = 1) -> dict[str, Any]:
    """Search parameters on the training rows of the saved split; returns and writes the
    best-parameters document. Running it again goes on with the same study. At most
    `parallelism` candidates are fitted at a time."""
    split = splits.get_split(spark, split_path, splits.one_per_pair(pairs))
    train = pairs.join(split.filter("split = 'train'").select(*KEY), list(KEY), "left_semi")
    folds = splits.stratified_kfold(splits.one_per_pair(train), k).drop("label")
    matrix = model.build_features(train, train if model.needs_training_corpus else None)
    rows = materialize(matrix.join(folds, list(KEY)), "tuning")
    if candidates is None:
        candidates = search.sample_params(model.get_tuning_spec()["param_space"], n_trials, seed)

    def fit_score(marked: DataFrame, params: dict) -> DataFrame:
        fitted = model.with_params(params).fit(marked.filter("is_train").drop("is_train", "fold"))
        return fitted.predict_proba(marked.filter("not is_train"))

    trials = search.run_study(spark, f"{folder}/{name}/study", rows, candidates, fit_score,
                              fresh=fresh, k=k, threshold=model.threshold, prune=prune, parallelism=parallelism)
    best = search.best_document(trials, model.name, name)
    stores.write_trials(spark, f"{folder}/{name}", trials, best)
    return best
