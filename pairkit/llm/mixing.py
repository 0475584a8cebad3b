"""Mixing sources to target weights by fixed-length blocks.

Each source's documents are packed, in a pseudorandom order, into one stream of words that is
cut into blocks of `block` words (the last may be shorter). Every source has a quota of slots;
for each output shard the slots are drawn from a multinomial over the sources whose
probabilities follow the quotas still open, so all quotas are met at the end. The n-th slot of
a source takes the block at the n-th place of a pseudorandom permutation of its block indexes,
with a new permutation for each pass, and slots and blocks are joined by that index.
A source's last slot is cut so that the words taken meet its target.

Only one row per source, and one per source and shard, pass through the driver.

Defined results: a NULL source is a source of its own and comes last; NULL or blank texts have
size 0 and nothing is taken of them; rows may repeat; an empty table gives no rows. Columns of any name
stay, but names that begin with two underscores are the stage's own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pairkit.session import materialize

# Fixed value of the contract: the characters between words.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BUCKETS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = 2) -> list[Fraction]:
    """Shares of `total` by weight; none above `most` times its size, the excess goes to the others by weight."""
    caps = [Fraction(most) * s for s in sizes]
    result: list[Fraction] = [Fraction(0)] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes)], Fraction(total)
    while open_:
        weight = sum(Fraction(weights[i]) for i in open_)
        share = {i: left * Fraction(weights[i]) / weight for i in open_}
        full = [i for i in open_ if share[i] > caps[i]]
        if not full:
            for i in open_:
                result[i] = share[i]
            break
        for i in full:
            result[i] = caps[i]
            left -= caps[i]
        open_ = [i for i in open_ if i not in set(full)]
    return result


def draw(slots: Sequence[int], shard_slots: int, seed: int) -> list[tuple[int, int, int, int]]:
    """(shard, source, first slot, slots) of the multinomial draws; every source's slots are used up."""
    left = np.array(slots, dtype=np.int64)
    first = np.zeros_like(left)
    rows, shard = [], 0
    while left.sum():
        rng = np.random.default_rng([seed, shard])
        todo = int(min(shard_slots, left.sum()))
        got = np.zeros_like(left)
        while todo:  # a source drawn beyond its quota gives the excess back
            open_ = left - got
            got = np.minimum(got + rng.multinomial(todo, open_ / open_.sum()), left)
            todo = int(min(shard_slots, left.sum()) - got.sum())
        rows += [(shard, int(s), int(first[s]), int(got[s])) for s in np.flatnonzero(got)]
        first, left, shard = first + got, left - got, shard + 1
    return rows


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each index in a pseudorandom permutation of 0..n-1: a four-round Feistel network that walks on until inside."""
    def mixed(x, k):
        x = (x + k) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    n, out, key = n.astype(np.uint64), index.astype(np.uint64), key.astype(np.uint64)
    half = np.array([max(1, (int(x - 1).bit_length() + 1) // 2) for x in np.maximum(np.unique(n), 1).tolist()], dtype=np.uint64)
    half = half[np.searchsorted(np.unique(n), n)]
    mask, todo = (np.uint64(1) << half) - np.uint64(1), np.arange(len(out))
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        low, high = x & m, x >> h
        for r in range(4):
            low, high = high ^ (mixed(low, k + np.uint64(r)) & m), low
        x = (high << h) | low
        out[todo] = x
        todo = todo[x >= n[todo]]
    return out.astype(np.int64)


class Mix:
    """The mix of `docs`: sources with their targets, packed documents, and the pieces that fill the slots.

    `keys` identify a document (they may be NULL or repeat). `sources`: source_id, source,
    source_size, target. `packed`: keys, source_id, start, size. `pieces()`: one row for each
    slot and document in it: shard, place, source_id, block, pass, keys, start, first_word,
    words. Rows ordered by (shard, place) are the mixed text.
    """

    def __init__(self, docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", source: str = "source",
                 weights: Sequence[float] = WEIGHTS, ratio: float = 1.5, most: float = 2, block: int = 128,
                 shard_slots: int = 1 << 16, seed: int = 17):
        spark, self.keys, self.block, self.seed = docs.sparkSession, list(keys), block, seed
        sizes = materialize(docs.select(*keys, F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "mix-sizes")
        rows = sizes.groupBy("source").agg(F.sum("size").alias("n")).collect()
        rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
        totals = [r["n"] for r in rows]
        goals = targets(totals, [weights[i % len(weights)] for i in range(len(rows))], Fraction(ratio) * sum(totals), most)
        self.sources = spark.createDataFrame(
            [(i, r["source"], n, float(g)) for i, (r, n, g) in enumerate(zip(rows, totals, goals))],
            "source_id int, source string, source_size bigint, target double")
        self.quotas = [self._quota(n, round(g)) for n, g in zip(totals, goals)]
        self.slots = draw([q[0] for q in self.quotas], shard_slots, seed)
        named = sizes.join(F.broadcast(self.sources) if len(rows) < 100_000 else self.sources,
                           sizes["source"].eqNullSafe(self.sources["source"])).drop(self.sources["source"])
        self.packed = self._pack(named)

    def _quota(self, size: int, goal: int) -> tuple[int, int, int]:
        """Slots, blocks in the source, and words in the last slot."""
        if not goal:
            return 0, 0, 0
        blocks = math.ceil(size / self.block)
        passes, rest = divmod(goal, size)
        slots = passes * blocks + math.ceil(rest / self.block)
        last = rest % self.block or self.block if rest else size - (blocks - 1) * self.block
        return slots, blocks, last

    def _pack(self, docs: DataFrame) -> DataFrame:
        """Start of each document in its source's stream: bucket totals give offsets, windows run within a bucket."""
        hashed = docs.withColumn("order", F.xxhash64(*self.keys, F.lit(self.seed)))
        hashed = hashed.withColumn("bucket", F.pmod("order", F.lit(BUCKETS)))
        totals = hashed.groupBy("source_id", "bucket").agg(F.sum("size").alias("n"))
        before = Window.partitionBy("source_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select("source_id", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        within = (Window.partitionBy("source_id", "bucket").orderBy("order", *self.keys, "size")
                  .rowsBetween(Window.unboundedPreceding, -1))
        placed = hashed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
        return materialize(placed.join(offsets, ["source_id", "bucket"])
                           .withColumn("start", F.col("offset") + F.col("inside")).drop("bucket", "order", "offset", "inside"),
                           "mix-packed")

    def blocks(self) -> DataFrame:
        """The part of each document in each block it reaches; documents of size 0 have none."""
        size = F.lit(self.block)
        spans = self.packed.filter("size > 0").withColumn(
            "block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("size") - 1) / size))))
        at = F.greatest(F.col("start"), F.col("block") * size)
        until = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * size)
        return spans.withColumns({"at": at - F.col("block") * size, "first_word": at - F.col("start"), "length": until - at})

    def drawn(self) -> DataFrame:
        """A row for each slot: shard, place, source_id, pass, block, limit (words it takes)."""
        quotas, seed, step = self.quotas, self.seed, 1 << 14

        def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    slots, n, last = quotas[row.source_id]
                    slot = np.arange(row.first, min(row.first + step, row.end), dtype=np.int64)
                    turn, j = slot // n, slot % n
                    at, inner = j.copy(), j < n - 1  # a short last block keeps the last place of each pass
                    key = (turn[inner] + 1) * 1_000_003 + row.source_id * 7919 + seed
                    at[inner] = permute(j[inner], np.full(inner.sum(), n - 1), key)
                    place = permute(slot + row.source_id * (1 << 40), np.full(len(slot), 1 << 62), np.full(len(slot), seed))
                    yield pd.DataFrame({"shard": row.shard, "place": place, "source_id": row.source_id, "pass": turn,
                                        "block": at, "limit": np.where(slot == slots - 1, last, 1 << 40)})

        spark = self.packed.sparkSession
        rows = spark.createDataFrame(self.slots, "shard int, source_id int, lo bigint, n bigint")
        ranges = rows.select("shard", "source_id", F.explode(F.expr(f"sequence(lo, lo + n - 1, {step})")).alias("first"),
                             (F.col("lo") + F.col("n")).alias("end"))
        return ranges.mapInPandas(fill, "shard int, place bigint, source_id int, pass bigint, block bigint, limit bigint")

    def pieces(self) -> DataFrame:
        joined = self.blocks().join(self.drawn(), ["source_id", "block"])
        words = F.least(F.col("length"), F.col("limit") - F.col("at"))
        return joined.withColumn("words", words).filter("words > 0").select(
            "shard", "place", "source_id", "block", "pass", *self.keys, "start", "first_word", "words")

    def taken(self) -> DataFrame:
        """Each row of `packed` with the words the mix takes of it, repeats counted."""
        wanted = self.drawn().groupBy("source_id", "block").agg(F.collect_list("limit").alias("limits"))  # two at most
        words = F.aggregate("limits", F.lit(0).cast("bigint"), lambda s, x: s + F.greatest(
            F.lit(0), F.least(F.col("length"), x - F.col("at"))))
        row = ["source_id", "start", *self.keys, "size"]
        some = (self.blocks().join(wanted, ["source_id", "block"], "left").groupBy(*row)
                .agg(F.sum(F.coalesce(words, F.lit(0))).alias("taken")))
        none = self.packed.filter("size = 0").select(*row, F.lit(0).cast("bigint").alias("taken"))
        return some.unionByName(none)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, seen from each document."""
    mix = Mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mix.taken().join(mix.sources, "source_id").select("doc_id", "source", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row for each pass over a document that takes words of it, with those words.

    A pass that takes the whole document keeps its text as it is, one that takes parts joins their
    words by single spaces. n_chars follows the new text. Documents without words go. Rows are told
    apart by id and text, which the dedup before this stage made distinct.
    """
    keyed = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    pieces = Mix(keyed.select("doc_id", "__row", "source", "text"), ["doc_id", "__row"]).pieces()
    spans = pieces.groupBy("doc_id", "__row", "pass").agg(
        F.sort_array(F.collect_list(F.struct("first_word", "words"))).alias("__spans"), F.sum("words").alias("__taken"))
    spans = materialize(spans.select(F.col("doc_id").alias("__id"), "__row", "__spans", "__taken"), "mix-spans")
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    part = F.array_join(F.flatten(F.transform("__spans", lambda s: F.slice(
        words, s["first_word"].cast("int") + 1, s["words"].cast("int")))), " ")
    mixed = keyed.join(spans, "__row").filter(F.col("doc_id").eqNullSafe(F.col("__id")))
    whole = F.col("__taken") == word_count(F.col("text"))
    mixed = mixed.withColumn("text", F.when(whole, F.col("text")).otherwise(part))
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
