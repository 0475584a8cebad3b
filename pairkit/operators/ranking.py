"""Limits, top-k, and exact ranks and running sums that no single task computes.

A window over few groups (two labels, or none) would put all rows into as many tasks.
Here rows first fall into ordered buckets; the small table of bucket totals gives each
bucket its offset, and windows only ever run within one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

DEFAULT_BUCKETS = 1024


def head_limit(df: DataFrame, n: int, order: str = "row_no") -> DataFrame:
    """The first n rows in file order."""
    return df.orderBy(order).limit(n)


def running_sums(df: DataFrame, bucket: Column, order: Sequence[Column | str],
                 sums: dict[str, Column], groups: Sequence[str] = ()) -> DataFrame:
    """Append inclusive running sums over `order`, within `groups`.

    `bucket` must not decrease along `order` and takes a bounded number of values, so
    the bucket totals, (groups x buckets) rows, can be broadcast.
    """
    groups = list(groups)
    parts = df.withColumn("__bucket", bucket).withColumns({f"__v_{n}": c for n, c in sums.items()})
    totals = parts.groupBy(*groups, "__bucket").agg(
        *[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    before = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, "__bucket", *[
        F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    within = Window.partitionBy(*groups, "__bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    joined = parts.join(F.broadcast(offsets), [*groups, "__bucket"])
    result = joined.withColumns(
        {n: F.sum(f"__v_{n}").over(within) + F.col(f"__o_{n}") for n in sums})
    return result.select(*df.columns, *sums)


def rank_trials(trials: DataFrame, score: str = "value") -> DataFrame:
    """Trials with their rank by falling score; trials without a score come last.

    Trials number in the hundreds, so one task may order them.
    """
    best_first = Window.orderBy(F.col(score).desc_nulls_last())
    return trials.withColumn("rank", F.rank().over(best_first))


def best_trial(trials: DataFrame) -> DataFrame:
    """One row: the highest-scoring complete trial and its parameters; the earliest on a tie.

    What an eliminated trial reached on some of the folds is no score of a trial.
    """
    order = F.struct(F.col("value"), -F.col("trial_number"))
    scored = trials.filter((F.col("state") == "COMPLETE") & F.col("value").isNotNull())
    return scored.agg(F.max_by("trial_number", order).alias("trial_number"),
                      F.max("value").alias("value"),
                      F.max_by("params", order).alias("params"))


def rank_importances(importances: DataFrame) -> DataFrame:
    """Features by falling importance."""
    return importances.orderBy(F.col("importance").desc(), "feature")
