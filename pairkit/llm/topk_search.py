"""Exact top-k search by inner product: a ball tree in each shard, searched by branch and bound.

Vectors are dealt to shards by a hash of their id. A task reads a shard's vectors, builds a ball
tree (center, radius, smallest id of each node) and then streams the queries: nodes are opened in
the order of their upper bound, center . query + |query| * radius, and the search ends when that
falls below the query's current k-th score. The k-th score is shared between shards: a query is
first answered in its own shard, and carries what it found there to all others.

A task holds one shard, of `shard_rows` vectors at most on average, and one batch of queries.
Queries are a stated set, and meet every shard in blocks; no pair but the k best of each query
and shard leaves a task.

Scores are exact integers. Equal scores go to the smaller id; in a node whose vectors are all
equal only the k + 1 smallest ids can matter. Shorter vectors count as if filled up with zeros.
Defined results: vectors that are NULL or hold NULL or non-finite components, and rows without
an id, take no part; rows that repeat an id and a vector count once; a query with no other
vector, and an empty table, give no rows. Ids are compared as 64-bit integers. Columns other than id
and vector are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pairkit.session import materialize

LEAF = 64
EXACT = 2 ** 53


def quantised(embedding: str, scale: int = 256) -> Column:
    """Components as floor(scale * x)."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))


def usable(embedding: str) -> Column:
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine, F.lit(False))


class BallTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.nodes: list[tuple[int, int, int, int]] = []  # first row, end, left child, right child
        self.centers, self.radii, self.least = [], [], []
        order = np.arange(len(ids))
        open_ = [(0, len(ids), None, 0)]
        while open_:
            lo, hi, parent, side = open_.pop()
            rows = order[lo:hi]
            points = vectors[rows]
            center = points.mean(axis=0)
            away = np.sqrt(((points - center) ** 2).sum(axis=1))
            node = len(self.nodes)
            same = bool((points == points[0]).all())
            self.centers.append(center)
            self.radii.append(0.0 if same else float(away.max()))
            self.least.append(int(ids[rows].min()))
            self.nodes.append((lo, hi, -1, -1))
            if parent is not None:
                first, end, left, right = self.nodes[parent]
                self.nodes[parent] = (first, end, node, right) if side == 0 else (first, end, left, node)
            if hi - lo > LEAF and not same:
                # split at the median along the line between two far points
                a = points[int(away.argmax())]
                b = points[int(((points - a) ** 2).sum(axis=1).argmax())]
                along = points @ (b - a)
                middle = (hi - lo) // 2
                order[lo:hi] = rows[np.argpartition(along, middle)]
                open_ += [(lo, lo + middle, node, 0), (lo + middle, hi, node, 1)]
            else:
                order[lo:hi] = rows[np.argsort(ids[rows], kind="stable")]
        self.ids, self.vectors = ids[order], vectors[order]
        self.centers, self.radii = np.array(self.centers), np.array(self.radii)
        self.largest = float(np.abs(vectors).max(initial=0))

    def _scores(self, lo: int, hi: int, query: np.ndarray) -> np.ndarray:
        if self.largest * np.abs(query).max(initial=0) * max(1, len(query)) < EXACT:
            return self.vectors[lo:hi] @ query
        return self.vectors[lo:hi].astype(object) @ query.astype(object)

    def search(self, own: np.ndarray, queries: np.ndarray, floors: list, k: int) -> Iterator[tuple[int, int, int]]:
        """(query, id, score) of the best k that can still be among the query's k best; floors: (score, id) or None."""
        lengths = np.sqrt((queries ** 2).sum(axis=1))
        bounds = queries @ self.centers.T + lengths[:, None] * self.radii
        bounds = np.floor(bounds + 1e-3 + 1e-9 * np.abs(bounds))  # scores are integers
        for at in range(len(own)):
            bound, query, me = bounds[at], queries[at], own[at]
            worst = None if floors[at] is None else (floors[at][0], -floors[at][1])
            best: list[tuple] = []  # heap of (score, -id): its first is the worst kept
            heap = [(-bound[0], 0)]
            while heap:
                upper, node = heapq.heappop(heap)
                upper = -upper
                if worst is not None and upper < worst[0]:
                    break
                lo, hi, left, right = self.nodes[node]
                if worst is not None and upper == worst[0] and -self.least[node] < worst[1]:
                    continue
                if left >= 0:
                    for child in (left, right):
                        if worst is None or bound[child] >= worst[0]:
                            heapq.heappush(heap, (-bound[child], child))
                    continue
                if self.radii[node] == 0:
                    hi = min(hi, lo + k + 1)
                scores = self._scores(lo, hi, query)
                near = range(hi - lo) if worst is None else np.flatnonzero(scores >= worst[0])
                for i in near:
                    if (id_ := int(self.ids[lo + i])) == me:
                        continue
                    found = (int(scores[i]), -id_)
                    if worst is not None and found <= worst:
                        continue
                    heapq.heappush(best, found)
                    if len(best) > k:
                        heapq.heappop(best)
                    if len(best) == k and (worst is None or best[0] > worst):
                        worst = best[0]
            for score, id_ in best:
                yield int(me), -id_, score


def matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros to `width`; longer ones may come, then all get as wide."""
    lengths = np.diff(vectors.offsets.to_numpy())
    width = max(width, int(lengths.max(initial=0)))
    out = np.zeros((len(vectors), width))
    rows = np.repeat(np.arange(len(vectors)), lengths)
    first = np.repeat(vectors.offsets.to_numpy()[:-1], lengths)
    flat = vectors.values.to_numpy(zero_copy_only=False)[vectors.offsets[0].as_py():vectors.offsets[-1].as_py()]
    out[rows, np.arange(len(flat)) + vectors.offsets[0].as_py() - first] = flat
    return out


def widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def distinct_rows(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that repeat an id and a vector once; ids stay whole numbers of 64 bits."""
    order = np.lexsort((*vectors.T[::-1], ids))
    ids, vectors = ids[order], vectors[order]
    first = np.ones(len(ids), bool)
    first[1:] = (ids[1:] != ids[:-1]) | (vectors[1:] != vectors[:-1]).any(axis=1)
    return ids[first], vectors[first]


def search_shards(vectors: DataFrame, queries: DataFrame, k: int, shards: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each query in its shard that reach its floor.

    vectors: shard, id, v; queries: shard, id, v, floor_score, floor_id (NULL where none is known).
    """
    none = F.lit(None).cast("bigint")
    rows = vectors.select("shard", F.lit(0).alias("kind"), "id", "v", none.alias("floor_score"), none.alias("floor_id")).unionByName(
        queries.select("shard", F.lit(1).alias("kind"), "id", "v", "floor_score", "floor_id"))
    rows = rows.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "kind")  # one shard a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, tree = None, [], None
        for batch in batches:
            number, kind = (batch.column(i).to_numpy() for i in range(2))
            cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(int(lo), int(hi - lo))
                if number[lo] != shard:
                    shard, parts, tree = number[lo], [], None
                ids, m = part.column(2).to_numpy(), matrix(part.column(3), 0)
                if kind[lo] == 0:
                    parts.append((ids, m))
                    continue
                if tree is None:
                    if not parts:
                        continue
                    width = max(p[1].shape[1] for p in parts)
                    tree, parts = BallTree(*distinct_rows(np.concatenate([p[0] for p in parts]),
                                                          np.concatenate([widened(p[1], width) for p in parts]))), []
                floors = [None if s is None else (s, i) for s, i in zip(part.column(4).to_pylist(), part.column(5).to_pylist())]
                wide = tree.vectors.shape[1]
                for at in range(0, len(ids), 1024):
                    q = widened(m[at:at + 1024], wide)[:, :wide]  # beyond, all vectors of the shard are 0
                    found = list(tree.search(ids[at:at + 1024], q, floors[at:at + 1024], k))
                    columns = list(zip(*found)) or [[], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          shard_rows: int = 1 << 16, least_rows: int = 1 << 12) -> DataFrame:
    """query_id, rank, vec_id, score of every row of `vectors` that is_query (of column `id`) marks, against all rows."""
    spark = vectors.sparkSession
    rows = materialize(vectors.filter(usable(vector_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), quantised(vector_col).alias("v")), "topk-vectors")
    n = rows.count()
    shards = max(1, -(-n // shard_rows), min(spark.sparkContext.defaultParallelism, -(-n // least_rows)))
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    rows = rows.withColumn("shard", shard)
    queries = rows.filter(is_query).dropDuplicates(["id", "v"])
    none = F.lit(None).cast("bigint")
    home = materialize(search_shards(rows, queries.select("*", none.alias("floor_score"), none.alias("floor_id")), k, shards), "topk-home")
    if shards == 1:
        return best(home, k)
    floors = best(home, k).filter(F.col("rank") == k).select(
        F.col("query_id").alias("id"), F.col("score").alias("floor_score"), F.col("vec_id").alias("floor_id"))
    others = (queries.withColumnRenamed("shard", "home").join(floors, "id", "left")
              .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard <> home"))
    return best(home.unionByName(search_shards(rows, others, k, shards)), k)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    found = top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
