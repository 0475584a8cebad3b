"""Lookup joins that bring vectors and scores to pairs.

Every lookup table holds one row per key. Vector rows are wide and their number
grows with the data, so no side is broadcast by hint: Spark broadcasts a table only
when its known size is below `spark.sql.autoBroadcastJoinThreshold`. Pairs that share
a frequent key are spread either by AQE, which splits skewed join partitions, or by
`lookup(..., hot_share=...)`, which salts the frequent keys itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pairkit.operators import dictionary
from pairkit.session import materialize

# So many ids are sent to every task: 8 MB of numbers.
FEW_IDS = 1_000_000


def frequent_candidates(keys: DataFrame, key: str, share: float) -> DataFrame:
    """(key): a few keys among which are all that hold at least `share` of the rows, from one pass.

    Each task keeps a summary of 4 / share counters: when there are more, all lose what the first one
    too many has, so a key's count falls short by at most share / 4 of the task's rows. Sums over
    the tasks fall short by at most share / 4 of all rows, which leaves at most 4 / (3 * share) keys.
    """
    room, kind = int(4 / share) + 1, dict(keys.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict = {}
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for found in batch.column(0).value_counts().to_pylist():
                counters[found["values"]] = counters.get(found["values"], 0) + found["counts"]
            if len(counters) > room:
                least = sorted(counters.values())[-room - 1]
                counters = {k: n - least for k, n in counters.items() if n > least}
        names, counts = [None, *counters], [rows, *counters.values()]
        yield pa.RecordBatch.from_arrays([pa.array(names, batch_type), pa.array(counts, pa.int64())], [key, "n"])

    batch_type = to_arrow_type(keys.schema[key].dataType)
    summary = keys.select(key).filter(F.col(key).isNotNull()).mapInArrow(run, f"`{key}` {kind}, n bigint")
    merged = materialize(summary.groupBy(key).agg(F.sum("n").alias("n")), "frequent")
    rows = merged.filter(F.col(key).isNull()).agg(F.sum("n")).first()[0] or 0
    return merged.filter(F.col(key).isNotNull() & (F.col("n") >= 0.75 * share * rows)).select(key)


def hot_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """Keys that hold at least `share` of all rows that have one: never more than 1/share of them.

    A summary gives a few candidates, whose rows are then counted exactly. `df` is read twice, so
    give a written table.
    """
    few = materialize(frequent_candidates(df, key, share), "candidates")
    # at most 4 / (3 * share) candidates
    counts = df.select(key).join(F.broadcast(few), key).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    cut = df.filter(F.col(key).isNotNull()).count() * share
    return materialize(counts.filter(F.col("__n") >= cut).select(key), "hot-keys")


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "inner",
           hot_share: float | None = None, salts: int = 32, hot: DataFrame | None = None) -> DataFrame:
    """Join `left` to a table with one row per key.

    With `hot_share`, rows of keys above that share are spread over `salts`
    partitions and only the matching lookup rows are repeated; all other rows join
    as usual. NULL keys match nothing. `hot` gives such keys where they are known, a table of
    few rows with a column of the key's name.
    """
    if hot_share is None and hot is None:
        return left.join(right, key, how)
    if hot is None:
        hot = hot_keys(materialize(left.select(key), "keys"), key, hot_share)
    # At most 1/hot_share rows, hence safe to broadcast.
    hot = F.broadcast(hot.select(key, F.lit(True).alias("__hot")))
    narrow = [c for c, kind in left.dtypes if not kind.startswith(("array", "map", "struct"))]
    spread = F.pmod(F.xxhash64(*narrow), F.lit(salts)).cast("int")
    salted = (left.join(hot, key, "left")
              .withColumn("__salt", F.when(F.col("__hot"), spread).otherwise(F.lit(0))).drop("__hot"))
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = (right.join(hot, key, "left").withColumn("__salt", F.explode(copies)).drop("__hot"))
    return salted.join(repeated, [key, "__salt"], how).drop("__salt")


def _lookup_both(pairs: DataFrame, table: DataFrame, key: str, hot_share: float | None) -> DataFrame:
    """Pairs joined to both sides' rows; hot keys of both sides come from one narrow, written table of keys."""
    keys = materialize(pairs.select(f"{key}1", f"{key}2"), "pair-keys") if hot_share is not None else None
    for i in (1, 2):
        hot = None if keys is None else hot_keys(keys.select(f"{key}{i}"), f"{key}{i}", hot_share)
        pairs = lookup(pairs, _side(table, key, i), f"{key}{i}", hot=hot)
    return pairs


def _side(vectors: DataFrame, key: str, side: int) -> DataFrame:
    cols = [F.col(key).alias(f"{key}{side}"), F.col("embedding").alias(f"emb{side}")]
    if "norm" in vectors.columns:
        cols.append(F.col("norm").alias(f"norm{side}"))
    return vectors.select(*cols)


def attach_vectors(pairs: DataFrame, vectors: DataFrame, hot_share: float | None = None) -> DataFrame:
    """Both vectors (and norms) of every pair by qid; pairs lacking one are dropped."""
    return _lookup_both(pairs, vectors, "qid", hot_share)


def may_have_vectors(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs with `may_have`, false for those that lack a vector, told in their tasks; true for all if the ids are many."""
    ids = materialize(vectors.select("qid").distinct(), "ids")
    if ids.count() > FEW_IDS:
        return pairs.withColumn("may_have", F.lit(True))
    out = pairs
    for i in (1, 2):
        out = out.join(F.broadcast(ids.select(F.col("qid").alias(f"qid{i}"), F.lit(True).alias(f"__has{i}"))), f"qid{i}", "left")
    return out.select(*pairs.columns, (F.col("__has1").isNotNull() & F.col("__has2").isNotNull()).alias("may_have"))


def missing_vectors(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """The pairs `attach_vectors` drops."""
    ids = vectors.select("qid")
    has1 = ids.select(F.col("qid").alias("qid1"), F.lit(True).alias("__has1"))
    has2 = ids.select(F.col("qid").alias("qid2"), F.lit(True).alias("__has2"))
    return (pairs.join(has1, "qid1", "left").join(has2, "qid2", "left")
            .filter(F.col("__has1").isNull() | F.col("__has2").isNull())
            .select(pairs.columns))


def attach_vectors_by_text(pairs: DataFrame, vectors: DataFrame,
                           hot_share: float | None = None) -> DataFrame:
    """Both vectors of every pair, looked up by its texts.

    Keys are 128-bit text hashes: rows shuffle on 32 characters, not on whole texts.
    """
    keyed = vectors.withColumn("text_id", dictionary.text_key("text"))
    left = pairs.withColumns({f"text_id{i}": dictionary.text_key(f"question{i}") for i in (1, 2)})
    return _lookup_both(left, keyed, "text_id", hot_share).drop("text_id1", "text_id2")


def last_pair_scores(scores: DataFrame) -> DataFrame:
    """One feature array per (qid1, qid2): that of the highest index."""
    return (scores.groupBy("qid1", "qid2")
            .agg(F.max_by("features", "index").alias("features")))


def attach_pair_scores(pairs: DataFrame, scores: DataFrame, width: int) -> DataFrame:
    """Pairs with `ce`: the score features of (qid1, qid2), else of (qid2, qid1), else
    zeros. `ce_missing` marks the latter.

    Both lookups use the unordered key, so pairs and scores shuffle once.
    """
    def unordered(df):
        return df.withColumns({"__lo": F.least("qid1", "qid2"), "__hi": F.greatest("qid1", "qid2")})

    forward = F.col("qid1") <= F.col("qid2")
    found = (unordered(scores).groupBy("__lo", "__hi").agg(
        F.max_by(F.when(forward, F.col("features")), F.when(forward, F.col("index"))).alias("__up"),
        F.max_by(F.when(~forward, F.col("features")), F.when(~forward, F.col("index"))).alias("__down")))
    direct = F.when(forward, F.col("__up")).otherwise(F.col("__down"))
    reverse = F.when(forward, F.col("__down")).otherwise(F.col("__up"))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), width)
    ce = F.coalesce(direct, reverse)
    return (unordered(pairs).join(found, ["__lo", "__hi"], "left")
            .withColumns({"ce": F.coalesce(ce, zeros), "ce_missing": ce.isNull()})
            .drop("__lo", "__hi", "__up", "__down"))


def union_train_score(labelled: DataFrame, unlabelled: DataFrame) -> DataFrame:
    """Labelled and unlabelled rows as one frame, told apart by `split`."""
    tagged = labelled.withColumn("split", F.lit("train"))
    return tagged.unionByName(unlabelled.withColumn("split", F.lit("score")),
                              allowMissingColumns=True)


def one_per_key(table: DataFrame, value: str, key: Sequence[str] = ("qid1", "qid2")) -> DataFrame:
    """(key, value): the smallest value of each key, so that a pair given more than once has one split or fold."""
    return table.groupBy(*key).agg(F.min(value).alias(value))


def assign_split(pairs: DataFrame, split: DataFrame, key: Sequence[str] = ("qid1", "qid2")) -> DataFrame:
    """Pairs with the split recorded for their key; repeats of a pair all go where one of them is a test row."""
    return pairs.join(one_per_key(split, "split", key), list(key))


def align_members(members: Sequence[DataFrame], key: Sequence[str] = ("qid1", "qid2")) -> DataFrame:
    """Member score tables side by side: key, label, p0, p1, ... and `agree`, which
    is false where the members' labels differ.

    Rows that repeat a key are matched by their order of label and probability.
    """
    key = list(key)
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("label", "proba"))
    numbered = [m.select(*key, "label", "proba", nth.alias("__nth")) for m in members]
    base = numbered[0].withColumnRenamed("proba", "p0")
    agree: Column = F.lit(True)
    for i, member in enumerate(numbered[1:], start=1):
        base = base.join(member.select(*key, "__nth", F.col("label").alias(f"__l{i}"),
                                       F.col("proba").alias(f"p{i}")), [*key, "__nth"])
        agree = agree & F.col("label").eqNullSafe(F.col(f"__l{i}"))
    return (base.withColumn("agree", agree)
            .drop("__nth", *[f"__l{i}" for i in range(1, len(members))]))


def label_conflicts(aligned: DataFrame) -> DataFrame:
    """One row: how many aligned rows carry differing labels."""
    return aligned.agg(F.count_if(~F.col("agree")).alias("conflicts"))
