"""Hyper-parameter search over stratified folds, with resumable trial tables.

The driver holds parameter dictionaries and fold scores only; every fit and every score
is a Spark job on the feature table. Candidates of a fold may be fitted side by side: the
driver's threads only submit jobs, each trial under a job group of its own.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from statistics import median
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.util import inheritable_thread_target

from pairkit.operators import evaluate, ranking

Params = dict[str, Any]
TRIAL_SCHEMA = ("trial_number int, value double, state string, duration_s double, n_folds int, "
                "params string, params_id string, fold_scores array<double>, fold_seconds array<double>")


# ---- parameters --------------------------------------------------------------

def _draw(rng: random.Random, spec: dict[str, Any]) -> Any:
    kind = spec.get("type", "float")
    if kind == "categorical":
        return rng.choice(list(spec["choices"]))
    if kind not in ("int", "float"):
        raise ValueError(f"unknown parameter type {kind!r}")
    low, high = spec["low"], spec["high"]
    if spec.get("log"):
        value = math.exp(rng.uniform(math.log(low), math.log(high)))
    elif kind == "int":
        return rng.randint(low, high)
    else:
        value = rng.uniform(low, high)
    return min(max(round(value), low), high) if kind == "int" else min(max(value, low), high)


def sample_params(space: dict[str, dict[str, Any]], n: int, seed: int = 42) -> list[Params]:
    """n reproducible draws; int, float and categorical entries, the first two also
    on a log scale."""
    rng = random.Random(seed)
    return [{name: _draw(rng, spec) for name, spec in space.items()} for _ in range(n)]


def params_json(params: Params) -> str:
    return json.dumps(params, sort_keys=True, separators=(",", ":"))


def params_id(params: Params) -> str:
    return hashlib.md5(params_json(params).encode()).hexdigest()


# ---- search ------------------------------------------------------------------

def side_by_side(spark: SparkSession, tasks: Sequence[Callable[[], Any]], parallelism: int, name: str) -> list[Any]:
    """Results of the tasks in their order, at most `parallelism` running at a time.

    Each runs in a thread that inherits the caller's Spark properties and sets a job group of its own.
    If one fails, jobs of the others are cancelled, those not begun never begin, and its error is raised.
    """
    if parallelism <= 1:
        return [task() for task in tasks]
    context, study = spark.sparkContext, f"{name}-{uuid.uuid4().hex}"
    groups = [f"{study}-{i}" for i in range(len(tasks))]

    def grouped(group: str, task: Callable[[], Any]) -> Callable[[], Any]:
        def run():
            context.setJobGroup(group, name, interruptOnCancel=True)
            return task()

        return inheritable_thread_target(spark)(run)

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        running = [pool.submit(grouped(g, t)) for g, t in zip(groups, tasks)]
        done, left = wait(running, return_when=FIRST_EXCEPTION)
        failed = next((f for f in running if f in done and f.exception() is not None), None)
        if failed is not None:
            for future in left:
                future.cancel()
            for group in groups:
                context.cancelJobGroup(group)
            raise failed.exception()
        return [f.result() for f in running]


def cv_search(rows: DataFrame, candidates: Sequence[Params],
              fit_score: Callable[[DataFrame, Params], DataFrame], *, k: int = 5,
              threshold: float = 0.5, prune: bool = True, fold: str = "fold",
              first_number: int = 0, parallelism: int = 1) -> list[dict[str, Any]]:
    """Trials of every candidate over the folds of `rows`, maximising mean F1.

    `rows` must hold training rows only, with `label` and a fold column.
    `fit_score(rows, params)` receives rows with `is_train` and returns the scored rows
    of the other kind, with label and proba. Candidates advance fold by fold, up to
    `parallelism` of them at a time; with `prune`, those whose running mean is below the
    median of all are dropped. What a trial scores does not depend on `parallelism`. Each
    trial keeps its score and its seconds of every fold it ran.
    """
    scores: dict[int, list[float]] = {i: [] for i in range(len(candidates))}
    seconds: dict[int, list[float]] = {i: [] for i in range(len(candidates))}
    dropped: set[int] = set()
    for f in range(k):
        marked = rows.withColumn("is_train", F.col(fold) != f)

        def one(params: Params, marked: DataFrame = marked) -> tuple[float, float]:
            start = time.time()
            scored = fit_score(marked, params)
            return float(evaluate.metrics(evaluate.decide(scored, threshold)).first()["f1"]), time.time() - start

        at = [i for i in range(len(candidates)) if i not in dropped]
        results = side_by_side(rows.sparkSession, [lambda p=candidates[i]: one(p) for i in at], parallelism, "cv-search")
        for i, (score, spent) in zip(at, results):
            scores[i].append(score)
            seconds[i].append(spent)
        if prune and f < k - 1:
            means = {i: sum(scores[i]) / len(scores[i]) for i in at}
            middle = median(means.values())
            dropped |= {i for i, mean in means.items() if mean < middle}
    return [{"trial_number": first_number + i, "value": sum(scores[i]) / len(scores[i]),
             "state": "PRUNED" if i in dropped else "COMPLETE", "duration_s": sum(seconds[i]),
             "n_folds": len(scores[i]), "params": params_json(params), "params_id": params_id(params),
             "fold_scores": scores[i], "fold_seconds": seconds[i]}
            for i, params in enumerate(candidates)]


def new_candidates(candidates: Sequence[Params], done: DataFrame | None) -> list[Params]:
    """Candidates, each once, that no stored trial has tried."""
    seen = set() if done is None else {r["params_id"] for r in done.select("params_id").distinct().collect()}
    fresh = {}
    for params in candidates:
        key = params_id(params)
        if key not in seen:
            fresh.setdefault(key, params)
    return list(fresh.values())


def run_study(spark: SparkSession, path: str, rows: DataFrame, candidates: Sequence[Params],
              fit_score: Callable[[DataFrame, Params], DataFrame], *, fresh: bool = False,
              **options: Any) -> DataFrame:
    """Search that appends its trials to the table at `path` and goes on where that
    table ends. With `fresh`, an existing table is an error."""
    jvm = spark._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    exists = location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)
    if exists and fresh:
        raise FileExistsError(f"a study exists at {path}")
    done = spark.read.schema(TRIAL_SCHEMA).parquet(path) if exists else None
    todo = new_candidates(candidates, done)
    if todo:
        first = 0 if done is None else done.agg(F.max("trial_number")).first()[0] + 1
        found = cv_search(rows, todo, fit_score, first_number=first, **options)
        spark.createDataFrame([tuple(t.values()) for t in found], TRIAL_SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(TRIAL_SCHEMA).parquet(path)


# ---- reporting ---------------------------------------------------------------

def fold_profile(trials: DataFrame) -> DataFrame:
    """Each trial's mean, spread and seconds over the folds it ran, and its rank among the complete ones."""
    mean = F.aggregate("fold_scores", F.lit(0.0), lambda a, x: a + x) / F.size("fold_scores")
    square = F.aggregate("fold_scores", F.lit(0.0), lambda a, x: a + (x - F.col("mean_score")) * (x - F.col("mean_score")))
    spent = F.aggregate("fold_seconds", F.lit(0.0), lambda a, x: a + x) / F.size("fold_seconds")
    found = trials.withColumn("mean_score", mean).withColumns({"std_score": F.sqrt(square / F.size("fold_scores")), "mean_seconds": spent})
    complete = ranking.rank_trials(found.filter("state = 'COMPLETE'")).select("trial_number", "rank")
    return found.join(complete, "trial_number", "left").select(
        "trial_number", "state", "rank", "n_folds", "mean_score", "std_score", "mean_seconds", "params")


def summarize(trials: DataFrame) -> DataFrame:
    """One row: counts by state; best, mean and spread of the scores of complete trials."""
    complete = F.when(F.col("state") == "COMPLETE", F.col("value"))
    return trials.agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.count_if(F.col("state") == "COMPLETE").alias("n_complete"),
        F.count_if(F.col("state") == "PRUNED").alias("n_pruned"),
        F.max(complete).alias("best_value"), F.avg(complete).alias("mean_value"), F.stddev_pop(complete).alias("std_value"))


def best_document(trials: DataFrame, model: str, study: str, scoring: str = "f1") -> dict[str, Any]:
    """Best-parameters document of a finished search."""
    best = ranking.best_trial(trials).first()
    return {"model": model, "tuning_name": study, "best_score": best["value"], "scoring": scoring,
            "method": "cv_search", "best_params": json.loads(best["params"])}


# ---- threshold search --------------------------------------------------------

def threshold_fold_scores(scored: DataFrame, grid: Sequence[float]) -> DataFrame:
    """(trial_number, threshold, fold, score): F1 of every threshold on every fold.

    One aggregation counts all thresholds at once. The score is NULL where nothing
    reaches the threshold.
    """
    hits = [F.struct(F.lit(i).alias("trial_number"), F.lit(float(t)).alias("threshold"),
                     F.count_if((F.col("label") == 1) & (F.col("proba") >= t)).alias("tp"),
                     F.count_if(F.col("proba") >= t).alias("called"),
                     F.count_if(F.col("label") == 1).alias("pos")) for i, t in enumerate(grid)]
    counts = scored.groupBy("fold").agg(F.array(*hits).alias("h")).select("fold", F.inline("h"))
    f1 = F.when(F.col("called") > 0, 2.0 * F.col("tp") / (F.col("called") + F.col("pos")))
    return counts.select("trial_number", "threshold", "fold", f1.alias("score"))


def trials_from_folds(fold_scores: DataFrame) -> DataFrame:
    """(trial_number, value, state, params); a trial without all its scores is pruned."""
    params = F.concat(F.lit('{"threshold":'), F.col("threshold").cast("string"), F.lit("}"))
    scored, all_folds = F.count("score"), F.count(F.lit(1))
    return (fold_scores.groupBy("trial_number", "threshold")
            .agg(F.avg("score").alias("value"),
                 F.when(scored == all_folds, "COMPLETE").otherwise("PRUNED").alias("state"))
            .select("trial_number", "value", "state", params.alias("params")))
