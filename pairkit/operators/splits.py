"""Exact, reproducible splits, folds and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairkit.operators import ranking

# Multipliers and modulus of the shuffling key, default seed.
_MULT1, _MULT2, _MODULUS = 2654435761, 40503, 4294967296
DEFAULT_SEED = 42
KEY = ("qid1", "qid2")


def shuffle_key(seed: int = DEFAULT_SEED) -> Column:
    """Deterministic pseudo-random order of pairs, a value in [0, 2^32).

    Ids are reduced first so that no product leaves the BIGINT range.
    """
    half = F.lit(_MODULUS // 2)
    q1, q2 = (F.pmod(F.col(k), half) for k in KEY)
    return F.pmod(q1 * F.lit(_MULT1) + q2 * F.lit(_MULT2) + F.lit(seed), F.lit(_MODULUS))


def _ranked(pairs: DataFrame, seed: int, groups: Sequence[str], buckets: int) -> DataFrame:
    """Keys with their exact position `rn` in shuffled order, within groups."""
    keyed = pairs.select(*KEY, *groups, shuffle_key(seed).alias("__k"))
    width = _MODULUS // buckets
    return ranking.running_sums(keyed, F.floor(F.col("__k") / F.lit(width)), ["__k", *KEY],
                                {"rn": F.lit(1).cast("bigint")}, groups)


def _group_sizes(pairs: DataFrame, groups: Sequence[str]) -> DataFrame:
    return pairs.groupBy(*groups).agg(F.count(F.lit(1)).alias("__size"))


def stratified_split(pairs: DataFrame, test_size: float = 0.2, seed: int = DEFAULT_SEED,
                     buckets: int = ranking.DEFAULT_BUCKETS) -> DataFrame:
    """(qid1, qid2, label, split): exactly round(n * test_size) test rows per class."""
    ranked = _ranked(pairs, seed, ["label"], buckets)
    # One row per class of a binary label.
    sizes = F.broadcast(_group_sizes(pairs, ["label"]))
    is_test = F.col("rn") <= F.round(F.col("__size") * F.lit(test_size))
    return (ranked.join(sizes, "label")
            .select(*KEY, "label", F.when(is_test, "test").otherwise("train").alias("split")))


def stratified_kfold(pairs: DataFrame, k: int = 5, seed: int = DEFAULT_SEED,
                     buckets: int = ranking.DEFAULT_BUCKETS) -> DataFrame:
    """(qid1, qid2, label, fold): folds 0..k-1 of equal size per class, give or take one."""
    ranked = _ranked(pairs, seed, ["label"], buckets)
    return ranked.select(*KEY, "label", F.pmod(F.col("rn") - 1, F.lit(k)).cast("int").alias("fold"))


def validation_holdout(pairs: DataFrame, frac: float = 0.05, seed: int = DEFAULT_SEED,
                       buckets: int = ranking.DEFAULT_BUCKETS) -> DataFrame:
    """(qid1, qid2, is_validation): max(1, floor(n * frac)) rows, without regard to class."""
    ranked = _ranked(pairs, seed, [], buckets)
    take = pairs.agg(F.greatest(F.floor(F.count(F.lit(1)) * F.lit(frac)), F.lit(1))).scalar()
    return ranked.select(*KEY, (F.col("rn") <= take).alias("is_validation"))


def held_out(pairs: DataFrame, frac: float = 0.05, seed: int = DEFAULT_SEED,
             buckets: int = ranking.DEFAULT_BUCKETS) -> Column:
    """Whether a row's pair is one that `validation_holdout` holds out of `pairs`, each given once.

    The pair at the end of the hold-out is found, and others are compared with it, so rows need no join.
    """
    take = pairs.agg(F.greatest(F.floor(F.count(F.lit(1)) * F.lit(frac)), F.lit(1))).first()[0]
    last = _ranked(pairs, seed, [], buckets).filter(F.col("rn") <= take).orderBy(F.col("rn").desc()).first()
    if last is None:  # pairs without a key come first and are as many
        return F.lit(False)
    inside = F.lit(True)
    for column, name in reversed([(shuffle_key(seed), "__k"), *[(F.col(k), k) for k in KEY]]):
        inside = (column < F.lit(last[name])) | ((column == F.lit(last[name])) & inside)
    return inside


def split_profile(split: DataFrame) -> DataFrame:
    """Size, share of all rows and positive rate per split."""
    parts = split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("n_positive"),
        F.avg("label").alias("positive_rate"))
    whole = split.agg(F.count(F.lit(1))).scalar()
    return parts.select("split", "n", (100.0 * F.col("n") / whole).alias("pct"),
                        "n_positive", "positive_rate")


def class_weights(pairs: DataFrame, max_positive: float | None = 2.0) -> DataFrame:
    """(label, n, balanced, positive_weight): n/(classes*n_c), and n_neg/n_pos for the
    positive class (capped by `max_positive`), 1 for the other."""
    parts = _group_sizes(pairs, ["label"]).withColumnRenamed("__size", "n")

    def size_of(label: int) -> Column:
        return F.sum(F.when(F.col("label") == label, F.col("n"))).cast("double")

    whole = parts.agg(F.struct(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"),
        F.coalesce(F.try_divide(size_of(0), size_of(1)), F.lit(1.0)).alias("ratio"))).scalar()
    ratio = whole["ratio"] if max_positive is None else F.least(whole["ratio"], F.lit(max_positive))
    return parts.select(
        "label", "n", (whole["rows"] / (whole["classes"] * F.col("n"))).alias("balanced"),
        F.when(F.col("label") == 1, ratio).otherwise(F.lit(1.0)).alias("positive_weight"))


def add_weights(df: DataFrame, kind: str = "balanced", max_positive: float | None = 2.0) -> DataFrame:
    """Rows with `weight`, for estimators that take a weight column."""
    table = class_weights(df, max_positive).select("label", F.col(kind).alias("weight"))
    return df.join(F.broadcast(table), "label")


def one_per_pair(pairs: DataFrame) -> DataFrame:
    """(qid1, qid2, label), each pair once; a pair with labels that differ counts as positive.

    A split of these has all rows of a pair on one side.
    """
    return pairs.groupBy(*KEY).agg(F.max("label").alias("label"))


def population(pairs: DataFrame) -> DataFrame:
    """One row that identifies a multiset of labelled pairs whatever their order."""
    hashed = F.xxhash64(*KEY, "label").cast("decimal(20,0)")
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(hashed), F.lit(0)).cast("string").alias("fingerprint"))


def save_split(split: DataFrame, path: str) -> None:
    """Write a split and the fingerprint of the pairs it was made for."""
    split.write.parquet(f"{path}/rows")
    population(split).write.parquet(f"{path}/population")


def load_split(spark: SparkSession, path: str, pairs: DataFrame) -> DataFrame:
    """A saved split, provided it was made for exactly these pairs."""
    saved = spark.read.parquet(f"{path}/population").first()
    now = population(pairs).first()
    if tuple(saved) != tuple(now):
        raise ValueError(f"split at {path} was made for other pairs: {tuple(saved)} vs {tuple(now)}")
    return spark.read.parquet(f"{path}/rows")


def get_split(spark: SparkSession, path: str, pairs: DataFrame, test_size: float = 0.2,
              seed: int = DEFAULT_SEED) -> DataFrame:
    """The saved split when there is one, else a new one that is saved first."""
    jvm = spark._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/population/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        save_split(stratified_split(pairs, test_size, seed), path)
    return load_split(spark, path, pairs)
