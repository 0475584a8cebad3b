"""Bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def bounded_sample(rows: DataFrame, group: str, keys: Sequence[str], limits: dict | int) -> DataFrame:
    """About limits[value] (or `limits`) rows of each value of `group`, which is never NULL.

    A row is taken when the hash of its keys, appended as `place`, lies in the part of the hash range
    that the group's count allows; so no group is sorted, and reruns agree. One row per value of
    `group` reaches the driver.
    """
    counts = {r[group]: r["count"] for r in rows.groupBy(group).count().collect()}
    place = F.pmod(F.xxhash64(F.lit(5), *keys), F.lit(1 << 30))
    if not counts:
        return rows.withColumn("place", place)
    limit = lambda g: limits.get(g, 0) if isinstance(limits, dict) else limits
    share = F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, min(1.0, limit(g) / n))])
    return rows.withColumn("place", place).filter(F.col("place") < F.element_at(share, F.col(group)) * float(1 << 30))
