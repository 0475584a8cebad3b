"""N-gram Jaccard join: documents whose sets of word shingles are alike, by a count-vector R-tree.

Two documents link when 100 * |A and B| >= percent * |A or B|. The steps:

1.  Each text gives its set of hashed shingles, a key of the whole set, and signatures. Documents
    with equal sets form a class, and one stands for it.
2.  Signatures bring together what may link, without loss. Sets that link differ in at most
    d = n * (100 - percent) / percent shingles. Shingles are hashed to groups; of d + 1 groups
    that are not empty one at least is equal in both sets, and a signature is the hash of one
    group's content. A shared passage makes no signature unless it fills a whole group. Groups
    hold about five shingles; their number depends on the level of the set's size, and sets near
    a level's edge give signatures for both. Sets of less than `SMALL` shingles have one shingle
    in each group. (A set of 64 shingles or more that fills fewer than d + 1 groups, which has a
    chance under 1e-15, gives what it has.)
3.  The classes of a signature are searched by a count-vector R-tree: the coordinates of a set, 64
    or more for large sets, count its shingles by groups of their hashes, a node's box bounds what a set in it can share with a query by
    the sum of coordinate minima, and pairs pass whose bound allows a link. Passing pairs make
    neighbourhoods, which hold all links. A signature of very many classes is searched in pairs
    of blocks.
4.  The sets of a neighbourhood's classes are read, and passing pairs are compared, again by an
    R-tree. Pairs that links connect already are skipped, so the links found are a spanning
    forest of all links, not all pairs. A neighbourhood of over `block` classes is first compared
    with a few of its members; what these leave apart meets all of it in pairs of blocks.
5.  Components over the found links go back to all members of the classes.

Words are what stands between white space ([\\x20\\x09-\\x0D]), A-Z lower-cased. A text with fewer
than `words` words is one shingle, a NULL text or one without words has the empty set and links
with nothing. Rows without an id have no component. Classes are named by the first key of their
set, so rows that repeat an id each have the component of their own text, and links between them
count. An empty table gives no rows. The join reads id and text alone; the stage keeps columns of any
name. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from pairkit.llm.components import Forest, connected_components
from pairkit.llm.language_id import mix
from pairkit.session import dropped, materialize

LINKS = "a bigint, b bigint"
SMALL = 64
LEAF = 8
LEADERS = 4
BUCKET = 4096
PART_BYTES = 1 << 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD1342543DE82EF95
SPACE = re.compile(rb"[\x20\x09-\x0D]")
LETTER = np.random.default_rng(2024).integers(1, 2 ** 63, 256, dtype=np.uint64)


def kept(name, make):
    """What the worker process has made before; functions travel by value and so lose their globals."""
    state = sys.modules.setdefault("_ngram_join", types.ModuleType("_ngram_join")).__dict__
    if name not in state:
        state[name] = make()
    return state[name]


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 2 ** 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(text: bytes) -> np.ndarray:
    """Hash of each word, from differences of one running sum over the text's bytes."""
    parts, at = [], 0
    while at < len(text):
        cut = SPACE.search(text, at + PART_BYTES)
        end = cut.start() if cut else len(text)
        b = np.frombuffer(text, np.uint8, end - at, at)
        at = end
        blank = (b == 32) | ((b >= 9) & (b <= 13))
        edge = np.diff(np.concatenate([[1], blank.view(np.int8), [1]]))
        start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        size = 1 << max(16, len(b).bit_length())
        up, down = kept(f"powers of {size}", lambda: _powers(size))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTER[b] * up[:len(b)])])
        parts.append(mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64)))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    w = word_hashes((text or "").encode().lower())  # bytes.lower() changes A-Z only
    if not len(w):
        return w
    k, h = min(words, len(w)), np.uint64(0)
    for j in range(k):
        h = mix(h * FACTOR + w[j:len(w) - k + 1 + j] + np.uint64(j + 1))
    return np.unique(mix(h + np.uint64(words - k)))


def levels(percent: int, largest: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """Lowest size of each level, and its number of groups."""
    lows = [SMALL]
    while lows[-1] <= largest:
        lows.append(-(-lows[-1] * 100 ** 3 // percent ** 3))
    groups = [-(-13 * (100 - percent) * ((hi - 1) * 100 // percent) // (10 * percent)) for hi in lows[1:]]
    return np.array(lows[:-1]), np.array(groups)


def signatures(h: np.ndarray, percent: int) -> np.ndarray:
    n = len(h)
    differ = n * (100 - percent) // percent
    if not differ:
        return np.zeros(0, np.uint64)  # only equal sets link
    out = []
    if n * percent < SMALL * 100:
        out.append(mix(h[:differ + 1] ^ FACTOR))
    if n >= SMALL:
        lows, groups = kept(f"levels at {percent}", lambda: levels(percent))
        home = int(np.searchsorted(lows, n, side="right")) - 1
        for level in [home, home - 1] if home > 0 and n * percent < lows[home] * 100 else [home]:
            group = ((h >> np.uint64(32)) * np.uint64(groups[level])) >> np.uint64(32)
            start = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
            end = start[differ + 1] if len(start) > differ + 1 else n
            start = start[:differ + 1]
            content = np.add.reduceat(mix(h[:end]), start)
            size = np.diff(np.append(start, end)).astype(np.uint64)
            out.append(mix(content + mix(group[start] * FACTOR + np.uint64(level)) + size))
    return np.concatenate(out)


def set_key(h: np.ndarray) -> tuple[int, int]:
    parts = mix(h + FACTOR)
    pair = np.array([parts.sum(dtype=np.uint64) + np.uint64(len(h)), np.bitwise_xor.reduce(mix(parts))], np.uint64)
    return tuple(mix(pair).view(np.int64).tolist())


def sets_and_signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """id, text_hash, n, key1, key2, point, signatures; of rows of one task with equal sets, one has the last two. docs: id, text_hash, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for id_, text_hash, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    h = shingle_set(text.as_py(), words)
                    key, marks, point = (set_key(h) if len(h) else (None, None)), None, None
                    if len(h) and id_ is not None and key not in seen:
                        seen.add(key)
                        marks, point = signatures(h, percent).view(np.int64), packed(counts(h, bits_for(len(h))))
                    rows.append((id_, text_hash, len(h), *key, point, marks))
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(),) * 5 + (pa.binary(), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "text_hash", "n", "key1", "key2", "point", "signatures"])

    return docs.mapInArrow(run, "id bigint, text_hash bigint, n bigint, key1 bigint, key2 bigint, point binary, signatures array<bigint>")


def with_sets(docs: DataFrame, words: int) -> DataFrame:
    """neighbourhood, id (the class: its first key), shingles (packed hashes) of docs (text, neighbourhood, key1, key2) whose text has the keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = []
                for r in batch.slice(lo, 256).to_pylist():
                    h = shingle_set(r["text"], words)
                    if len(h) and set_key(h) == (r["key1"], r["key2"]):
                        rows.append((r["neighbourhood"], r["key1"], h.tobytes()))
                columns = list(zip(*rows)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))],
                                                 ["neighbourhood", "id", "shingles"])

    return docs.mapInArrow(run, "neighbourhood bigint, id bigint, shingles binary")


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def bits_for(size: int) -> int:
    """Bits of the hash that choose a shingle's coordinate: 64 coordinates, or as many as leave about 12 shingles in each.

    Unlike sets of n shingles differ by about sqrt(n * coordinates / pi) in their sums of minima, which must stand
    out against n.
    """
    return max(6, int(size // 12).bit_length())


def counts(h: np.ndarray, bits: int) -> np.ndarray:
    """The set as a point: its shingles in each of the groups of the hash's first bits."""
    return np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def packed(point: np.ndarray) -> bytes:
    kind = 1 if point.max() < 256 else 4
    return bytes([kind]) + point.astype(f"<u{kind}").tobytes()


def unpacked(points: list[bytes]) -> np.ndarray:
    """Points as rows, all in the coordinates of the coarsest: finer ones are sums of neighbours."""
    found = [np.frombuffer(p, f"<u{p[0]}", offset=1).astype(np.int64) for p in points]
    width = min(map(len, found))
    return np.stack([p if len(p) == width else p.reshape(width, -1).sum(axis=1) for p in found])


class CountTree:
    """R-tree over points, packed bottom up: by size, then in tiles by the first coordinates."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent, self.points, self.sizes = percent, points, sizes
        order = np.lexsort((self.points[:, 0], self.sizes))
        tile = LEAF * LEAF
        for lo in range(0, len(order), tile):  # within a run of like sizes by another coordinate
            part = order[lo:lo + tile]
            order[lo:lo + tile] = part[np.lexsort((self.points[part, 2], self.points[part, 1]))]
        self.order = order
        high, small = self.points[order], self.sizes[order]
        self.boxes = []  # from the leaves up: the upper corner and the smallest size of each node
        while True:
            first = np.arange(0, len(high), LEAF)
            high, small = np.maximum.reduceat(high, first, axis=0), np.minimum.reduceat(small, first)
            self.boxes.append((high, small))
            if len(high) <= LEAF:
                break

    def _passes(self, point: np.ndarray, size: int, high: np.ndarray, small: np.ndarray) -> np.ndarray:
        shared = np.minimum(high, point).sum(axis=1)
        return (100 + self.percent) * shared >= self.percent * (size + small)

    def near(self, point: np.ndarray, size: int) -> np.ndarray:
        """Sets that can be alike by the bound."""
        nodes = np.arange(len(self.boxes[-1][0]))
        for high, small in reversed(self.boxes):
            nodes = nodes[nodes < len(high)]
            nodes = nodes[self._passes(point, size, high[nodes], small[nodes])]
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
        rows = self.order[nodes[nodes < len(self.order)]]
        return rows[self._passes(point, size, self.points[rows], self.sizes[rows])]


def passing_pairs(keys: list[int], points: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs that the bound lets pass, as a forest that connects what all of them connect."""
    forest = Forest()
    tree = CountTree(points, sizes, percent)
    for q, key in enumerate(keys):
        for i in tree.near(points[q], sizes[q]):
            if forest.join(key, keys[i]):
                yield min(key, keys[i]), max(key, keys[i])


def neighbours(buckets: DataFrame, percent: int) -> DataFrame:
    """a, b: passing pairs of classes in each group. buckets: signature, i, j, key1, n, point."""
    group = ["signature", "i", "j"]
    rows = buckets.select(*group, "key1", "n", "point").repartition(*group).sortWithinPartitions(*group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, known, out = None, {}, {}, []

        def close():
            keys = sorted(held)
            if len(keys) == 2:  # most groups: two classes, which meet in many
                pair = tuple(keys)
                if pair not in known:
                    if len(known) >= 1 << 20:
                        known.clear()
                    (m, a), (n, b) = held[keys[0]], held[keys[1]]
                    known[pair] = (100 + percent) * unpacked([a, b]).min(axis=0).sum() >= percent * (m + n)
                    if known[pair]:
                        out.append(pair)
            elif len(keys) > 2:
                sizes = np.array([held[k][0] for k in keys])
                points = unpacked([held[k][1] for k in keys])
                for pair in passing_pairs(keys, points, sizes, percent):
                    if known.get(pair) is not True:
                        known[pair] = True
                        out.append(pair)

        def found():
            columns = list(zip(*out)) or [[], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(6)]
            for *key, key1, n, point in zip(*columns):
                if key != current:
                    close()
                    current, held = key, {}
                held[key1] = (n, point)
            yield found()
        close()
        yield found()

    return rows.mapInArrow(run, LINKS)


def block_links(rows: list[tuple[int, int, bool, bool, np.ndarray]], percent: int) -> Iterator[tuple[int, int]]:
    """Links between queries and points that connect what was apart. rows: id, name so far, is query, is point, shingles."""
    forest = Forest()
    points = [r for r in rows if r[3]]
    if not points:
        return
    bits = bits_for(min(len(r[4]) for r in rows))
    tree = CountTree(np.stack([counts(r[4], bits) for r in points]), np.array([len(r[4]) for r in points]), percent)
    for id_, name, query, _, h in rows:
        if not query:
            continue
        for i in tree.near(counts(h, bits), len(h)):
            other = points[i]
            if other[0] != id_ and forest.find(name) != forest.find(other[1]) and alike(h, other[4], percent):
                forest.join(name, other[1])
                yield id_, other[0]


def join_groups(groups: DataFrame, percent: int) -> DataFrame:
    """Links of each group. groups: neighbourhood, i, j, id, name, query, point, shingles."""
    key = ["neighbourhood", "i", "j"]
    # a row that is a query and a point of its group comes as both
    rows = groups.select(*key, "id", "name", "query", "point", "shingles").repartition(*key).sortWithinPartitions(*key, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def found():
            pairs = list(zip(*block_links(held, percent))) or [[], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in pairs], ["a", "b"])

        for batch in batches:
            for k in range(batch.num_rows):
                *group, id_, name, query, point, shingles = (batch.column(c)[k].as_py() for c in range(8))
                if group != current:
                    if held:
                        yield found()
                    current, held = group, []
                held.append((id_, name, query, point, np.frombuffer(shingles, np.uint64)))
        if held:
            yield found()

    return rows.mapInArrow(run, LINKS)


def compare_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """Links among the rows of pairs: a, b, shingles, other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, one, two = (batch.column(c) for c in range(4))
            kept = [k for k in range(batch.num_rows) if alike(np.frombuffer(one[k].as_buffer(), np.uint64),
                                                             np.frombuffer(two[k].as_buffer(), np.uint64), percent)]
            yield pa.RecordBatch.from_arrays([a.take(pa.array(kept, pa.int64())), b.take(pa.array(kept, pa.int64()))], ["a", "b"])

    return pairs.select("a", "b", "shingles", "other").mapInArrow(run, LINKS)


def links_of(sets: DataFrame, percent: int, block: int) -> DataFrame:
    """A spanning forest of the links within each neighbourhood. sets: neighbourhood, id, shingles, written."""
    ids = sets.select("neighbourhood", "id")
    sizes = materialize(ids.groupBy("neighbourhood").agg(F.count("*").alias("members")), "join-sizes")
    large = sizes.filter(F.col("members") > block)
    whole = sets.join(sizes.filter(F.col("members") <= block), "neighbourhood").select(
        "neighbourhood", F.lit(0).alias("i"), F.lit(0).alias("j"), "id", F.col("id").alias("name"), F.lit(True).alias("query"),
        F.lit(True).alias("point"), "shingles")
    found = materialize(join_groups(whole, percent), "join-links")
    if large.isEmpty():
        return found
    # a few members, the smallest id and some by hash, are compared with all
    many = ids.join(large, "neighbourhood")
    least = many.groupBy("neighbourhood").agg(
        F.array_distinct(F.array(F.min("id"), *[F.min_by("id", F.xxhash64("id", F.lit(k))) for k in range(1, LEADERS)])).alias("ids"))
    least = least.select("neighbourhood", F.explode("ids").alias("id"))
    leaders = materialize(sets.join(least, ["neighbourhood", "id"]).select(
        "neighbourhood", F.col("id").alias("a"), F.col("shingles").alias("other")), "join-leaders")
    pairs = sets.join(leaders, "neighbourhood").filter("a <> id").withColumnRenamed("id", "b")
    star = materialize(compare_pairs(pairs, percent), "join-stars")
    names = connected_components(star)
    named = materialize(many.join(names, F.col("id") == F.col("node"), "left").select(
        "neighbourhood", "members", "id", F.coalesce("component", "id").alias("name")), "join-named")
    # the component with the most members needs no comparison within itself
    count = named.groupBy("neighbourhood", "name").agg(F.count("*").alias("size"))
    main = materialize(count.groupBy("neighbourhood").agg(F.max_by("name", F.struct("size", "name")).alias("main"),
                                                          (F.sum("size") - F.max("size")).alias("apart")), "join-main").filter("apart > 0")
    rest = named.join(main, "neighbourhood")
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    at = F.pmod(F.xxhash64("id"), blocks("members")).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(9)), blocks("apart")).cast("int")
    queries = rest.filter("name <> main").select(
        "neighbourhood", own.alias("i"), F.explode(F.sequence(F.lit(0), blocks("members") - 1)).alias("j"), "id", "name",
        F.lit(True).alias("query"), F.lit(False).alias("point"))
    points = rest.select(
        "neighbourhood", F.explode(F.sequence(F.lit(0), blocks("apart") - 1)).alias("i"), at.alias("j"), "id", "name",
        F.lit(False).alias("query"), F.lit(True).alias("point"))
    groups = queries.unionByName(points).join(sets.select("id", "shingles"), "id")
    return found.unionByName(star).unionByName(materialize(join_groups(groups, percent), "join-block-links"))


class JaccardJoin:
    """The join of `docs`.

    `rows`: id, text_hash, n, key1, key2 of every row. `classes`: key1, key2, representative (smallest id).
    `links`: a, b, first keys of classes that link, a spanning forest. `members()`: id, text_hash, n, component
    and stays (whether it stands for its component) for every row, in no order.
    """

    def __init__(self, docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                 block: int = 128):
        texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
        texts = texts.select("id", F.xxhash64("text").alias("text_hash"), "text")
        marked = materialize(sets_and_signatures(texts, words, percent), "join-signatures")
        self.rows = materialize(marked.select("id", "text_hash", "n", "key1", "key2"), "join-sets")
        self.classes = materialize(self.rows.filter("id IS NOT NULL AND n > 0").groupBy("key1", "key2").agg(
            F.min("id").alias("representative")), "join-classes")
        near = connected_components(self._passing(marked, percent))
        dropped(marked)
        roots = near.select(F.col("component").alias("node"), "component").distinct()
        near = near.unionByName(roots).withColumnsRenamed({"node": "key1", "component": "neighbourhood"})
        chosen = materialize(self.classes.join(near, "key1"), "join-chosen")
        # merged at every size: the candidates grow with the data, and a broadcast of few would only do for little data
        found = texts.join(chosen.withColumnRenamed("representative", "id").hint("merge"), "id")
        sets = materialize(with_sets(found.select("text", "neighbourhood", "key1", "key2"), words), "join-shingles")
        self.links = links_of(sets, percent, block)

    def _passing(self, marked: DataFrame, percent: int) -> DataFrame:
        """Pairs of classes, by the first of their keys, that share a signature and pass the bound."""
        each = marked.select("key1", F.explode("signatures").alias("signature"))
        same = Window.partitionBy("signature")
        shared = materialize(each.withColumns({"least": F.min("key1").over(same), "most": F.max("key1").over(same),
                                               "members": F.count("*").over(same)}).filter("least < most")
                             .select("signature", "key1", "members"), "join-shared")
        points = marked.filter("point IS NOT NULL").groupBy("key1").agg(F.max("n").alias("n"), F.max("point").alias("point"))
        blocks = F.ceil(F.col("members") / BUCKET).cast("int")
        own = F.pmod(F.xxhash64("key1"), blocks).cast("int")
        other = F.explode(F.sequence(F.lit(0), blocks - 1))
        pairs = shared.withColumn("own", own).withColumn("other", other).select(
            "signature", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key1")
        return materialize(neighbours(pairs.join(materialize(points, "join-points"), "key1"), percent), "join-neighbours")

    def members(self) -> DataFrame:
        names = connected_components(self.links).withColumnRenamed("node", "key1")
        named = materialize(self.classes.join(names, "key1", "left").select(
            "key1", "key2", "representative", F.coalesce("component", "key1").alias("name")), "join-named-classes")
        first = named.groupBy("name").agg(F.min(F.struct("representative", "key1", "key2")).alias("first"))
        named = named.join(first, "name").select("key1", "key2", F.col("first.representative").alias("component"),
                                                 (F.struct("key1", "key2") == F.struct("first.key1", "first.key2")).alias("leads"))
        some = self.rows.filter("id IS NOT NULL AND n > 0").join(named, ["key1", "key2"]).select(
            "id", "text_hash", "n", "component", (F.col("leads") & (F.col("id") == F.col("component"))).alias("stays"))
        none = self.rows.filter("id IS NULL OR n = 0").select("id", "text_hash", "n", F.col("id").alias("component"), F.lit(True).alias("stays"))
        return some.unionByName(none)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component at 4 words and 85 percent."""
    members = JaccardJoin(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=85).members()
    return members.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


OP7_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component at 5 words and 80 percent the smallest id stays; columns of docs.

    Rows without an id stay, as they have no component. A row goes by its id and text: another text of the
    same id has its own component.
    """
    gone = JaccardJoin(docs).members().filter("NOT stays").select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = (F.col("doc_id") == F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__hash"))
    return docs.join(materialize(gone, "join-dropped"), same, "left_anti").select(*docs.columns)
