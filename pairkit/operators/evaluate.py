"""Decisions, metrics, error tables and reports over scored pairs.

Scored frames hold `label` and `proba`; any key columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from pairkit.functions.text import safe_div
from pairkit.operators import ranking
from pairkit.session import materialize

COUNTS = ("tp", "fp", "tn", "fn")


def decide(df: DataFrame, threshold: float, proba: str = "proba") -> DataFrame:
    """Append `pred`: 1 where the probability reaches the threshold."""
    return df.withColumn("pred", (F.col(proba) >= F.lit(threshold)).cast("int"))


def errors(decided: DataFrame) -> DataFrame:
    """Misjudged rows with `error_type` FN or FP."""
    kind = F.when(F.col("label") == 1, "FN").otherwise("FP")
    return decided.filter(F.col("label") != F.col("pred")).withColumn("error_type", kind)


def error_table(decided: DataFrame) -> DataFrame:
    """Misjudged pairs as reported: texts, both labels, probability to six places."""
    return errors(decided).select(
        "qid1", "qid2", "question1", "question2", F.col("label").alias("true_label"),
        F.col("pred").alias("pred_label"), F.format_string("%.6f", "proba").alias("pred_prob"),
        "error_type")


def confusion_aggs(label: str = "label", pred: str = "pred") -> list[Column]:
    is_pos, said_pos = F.col(label) == 1, F.col(pred) == 1
    cells = (is_pos & said_pos, ~is_pos & said_pos, ~is_pos & ~said_pos, is_pos & ~said_pos)
    return [F.count_if(c).alias(n) for n, c in zip(COUNTS, cells)]


def confusion(decided: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """TP, FP, TN, FN in one pass; all four are present even for a single class."""
    return decided.groupBy(*by).agg(*confusion_aggs()) if by else decided.agg(*confusion_aggs())


def metric_columns() -> dict[str, Column]:
    """Accuracy, precision, recall and F1 of the counts; 0 where undefined."""
    tp, fp, tn, fn = (F.col(n) for n in COUNTS)
    return {"accuracy": safe_div(tp + tn, tp + fp + tn + fn), "precision": safe_div(tp, tp + fp),
            "recall": safe_div(tp, tp + fn), "f1": safe_div(2 * tp, 2 * tp + fp + fn)}


def metrics(decided: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts with the metrics made of them."""
    return confusion(decided, by).withColumns(metric_columns())


def classification_report(decided: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages
    and accuracy. One pass over the rows; the rest works on the four counts."""
    tp, fp, tn, fn = (F.col(n) for n in COUNTS)
    per_class = F.array(
        F.struct(F.lit("0").alias("row"), tn.alias("hit"), fn.alias("false_hit"), fp.alias("miss")),
        F.struct(F.lit("1").alias("row"), tp.alias("hit"), fp.alias("false_hit"), fn.alias("miss")))
    classes = (confusion(decided).select(F.explode(per_class).alias("c")).select("c.*").select(
        "row", safe_div("hit", F.col("hit") + F.col("false_hit")).alias("precision"),
        safe_div("hit", F.col("hit") + F.col("miss")).alias("recall"),
        safe_div(2 * F.col("hit"), 2 * F.col("hit") + F.col("false_hit") + F.col("miss")).alias("f1"),
        (F.col("hit") + F.col("miss")).alias("support"), "hit"))
    names = ("precision", "recall", "f1")
    support = F.sum("support")

    def summary(name: str, values: list[Column]) -> DataFrame:
        return classes.filter("support > 0").agg(
            F.lit(name).alias("row"), *[v.alias(n) for v, n in zip(values, names)],
            support.alias("support"))

    accuracy = safe_div(F.sum("hit"), support)
    return (classes.drop("hit")
            .unionByName(summary("macro avg", [F.avg(n) for n in names]))
            .unionByName(summary("weighted avg",
                                 [safe_div(F.sum(F.col(n) * F.col("support")), support) for n in names]))
            .unionByName(summary("accuracy", [accuracy] * 3)))


def score_profile(scored: DataFrame) -> DataFrame:
    """Range and mean of the probabilities."""
    return scored.agg(F.min("proba").alias("min_proba"), F.max("proba").alias("max_proba"),
                      F.avg("proba").alias("mean_proba"))


def fold_means(fold_scores: DataFrame) -> DataFrame:
    """Mean score of each trial over its folds."""
    return fold_scores.groupBy("trial_number").agg(
        F.avg("score").alias("value"), F.count(F.lit(1)).alias("n_folds"))


def threshold_sweep(scored: DataFrame) -> DataFrame:
    """Counts and metrics at every distinct probability used as the threshold.

    Equal probabilities collapse first. The rest is dealt to partitions by ranges of about
    equal size, wherever the probabilities lie; running counts come from offsets of these.
    """
    levels = scored.groupBy(F.col("proba").alias("threshold")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("pos"))
    levels = materialize(levels.repartitionByRange(F.col("threshold").desc())
                         .withColumn("__range", F.spark_partition_id()), "thresholds")
    summed = ranking.running_sums(levels, F.col("__range"), [F.col("threshold").desc()],
                                  {"called": F.col("n"), "tp": F.col("pos")})
    whole = levels.agg(F.struct(F.sum("n").alias("n"), F.sum("pos").alias("pos"))).scalar()
    return (summed.withColumn("fp", F.col("called") - F.col("tp"))
            .withColumn("fn", whole["pos"] - F.col("tp"))
            .withColumn("tn", whole["n"] - whole["pos"] - F.col("fp"))
            .withColumns(metric_columns())
            .select("threshold", *COUNTS, "accuracy", "precision", "recall", "f1"))


def best_threshold(scored: DataFrame, by: str = "f1") -> DataFrame:
    """One row: the threshold with the best metric, the higher one on a tie."""
    rank = F.struct(F.col(by), F.col("threshold"))
    return threshold_sweep(scored).agg(
        F.max_by("threshold", rank).alias("threshold"), F.max(by).alias(by))


def ledger_row(decided: DataFrame, run_at: str, experiment: str, model: str, n_features: int,
               threshold: float) -> DataFrame:
    """Summary of one run, ready to append to the experiment ledger."""
    def four(c: str) -> Column:
        return F.round(c, 4).alias(c)

    size = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return metrics(decided).select(
        F.lit(run_at).alias("run_at"), F.lit(experiment).alias("experiment_name"),
        F.lit(model).alias("model"), F.lit(n_features).alias("n_features"),
        F.lit(float(threshold)).alias("threshold"), size.alias("test_size"),
        four("accuracy"), four("precision"), four("recall"), four("f1"),
        *[F.col(n).alias(n.upper()) for n in COUNTS])


def compare_runs(ledger: DataFrame, by: str = "f1") -> DataFrame:
    """Ledger rows by falling metric, with their rank."""
    return ranking.rank_trials(ledger, by)


def run_config(experiment: str, run_at: str, model: Any, threshold: float, test_size: int,
               arguments: dict[str, Any] | None = None) -> dict[str, Any]:
    """Driver-side record of a run, for the configuration document."""
    config = model.get_config() if hasattr(model, "get_config") else {}
    tuning = config.get("tuning", {})
    return {"experiment_name": experiment, "run_at": run_at,
            "model": getattr(model, "name", type(model).__name__), "threshold": threshold,
            "optimal_hyperparameters": tuning.get("best_params") if tuning.get("enabled") else None,
            "test_size": test_size, "cli_args": arguments or {}, "model_config": config}
