"""Suffix-array dedup: remove every byte covered by a string of `threshold` bytes that also starts elsewhere.

Only the first `threshold` bytes of suffixes count, so they are ordered to that depth alone, by
most-significant-digit passes; what a pass leaves alone in its bucket is unique and drops out, and
buckets that are still together at full depth are exactly the repeated windows. Digits are taken
from the middle of a window outwards:

1.  First digit: a window's anchor, its 32 bytes of least hash. Equal windows have equal anchors at
    equal places, and neighbouring windows mostly share one, so some 85 windows travel as one row.
    Anchors that occur once drop out.
2.  Second digit: all bytes that the anchor's windows cover. Where two rows agree in them, all these
    windows are repeated, and only one row goes on, as a partner for others.
3.  Further digits: a bucket holds windows of an interval of offsets around one anchor, which share a
    core of bytes. Buckets of up to `bucket` rows are sorted in tasks, byte by byte, from the core to
    both sides, for all offsets at once. Larger ones go through another pass: the interval is halved,
    which makes the core longer, and rows go to the bucket of their new core, down to one offset,
    where the core is the window.

Spans found go back to the documents by a 128-bit key of the text. Anchors, cores and keys are
compared by hashes of 64 bits and more, windows within a bucket by their bytes.

Of copies of a text within a task two stand for all. Matches never cross documents. A NULL text is
empty; one shorter than the threshold stays whole; rows that repeat are each a document, and so
repeat each other; an empty table gives no rows. Columns other than id and text are ignored.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairkit.llm.language_id import mix
from pairkit.session import dropped, materialize

GRAM = 32
SLICE = 1 << 18
BASE = 0xD1342543DE82EF95
BYTE = np.random.default_rng(77).integers(1, 2 ** 63, 256, dtype=np.uint64)
LOCAL_ROWS = 1 << 12
KEY = ["key1", "key2"]


def kept(name, make):
    """What the worker process has made before; functions travel by value and so lose their globals."""
    state = sys.modules.setdefault("_repeated_windows", types.ModuleType("_repeated_windows")).__dict__
    if name not in state:
        state[name] = make()
    return state[name]


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 2 ** 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each `width` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        a, done = pick(a[:-done], a[done:]), done * 2
    return pick(a[:len(a) - (width - done)], a[width - done:]) if done < width else a


# ---- anchors -----------------------------------------------------------------

def slices_of(texts: list[bytes], threshold: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, from, to, lo, hi): bytes to look at, and the positions whose anchors they decide."""
    reach = 2 * threshold
    for t, text in enumerate(texts):
        for lo in range(0, len(text) if len(text) >= threshold else 0, SLICE):
            hi = min(len(text), lo + SLICE)
            yield t, max(0, lo - reach), min(len(text), hi + reach), lo, hi


def anchors_of(texts: list[bytes], threshold: int) -> Iterator[tuple[np.ndarray, ...]]:
    """text, position, hash of the anchor, hash of all its windows' bytes, bytes of these before and after the anchor's start."""
    held, size = [], 0
    for piece in slices_of(texts, threshold):
        held.append(piece)
        size += piece[2] - piece[1]
        if size >= SLICE:
            yield _anchors(texts, held, threshold)
            held, size = [], 0
    if held:
        yield _anchors(texts, held, threshold)


def _anchors(texts: list[bytes], pieces: list, threshold: int) -> tuple[np.ndarray, ...]:
    width = threshold - GRAM + 1
    b = np.frombuffer(b"".join(texts[t][lo:hi] for t, lo, hi, _, _ in pieces), np.uint8)
    n = len(b)
    size = 1 << n.bit_length()
    up, down = kept(f"powers of {size}", lambda: _powers(size))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kept("bytes", lambda: BYTE)[b] * up[:n])])
    gram = mix((total[GRAM:] - total[:-GRAM]) * down[:n - GRAM + 1]) | np.uint64(1)
    sizes = np.array([hi - lo for _, lo, hi, _, _ in pieces])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    least = sliding(gram, width, np.minimum)  # of each window
    fits = np.zeros(len(least) + 1, np.int32)
    np.add.at(fits, begins, 1)
    np.add.at(fits, np.minimum(ends - threshold + 1, len(least)), -1)
    least = np.where(np.cumsum(fits[:-1]) > 0, least, np.uint64(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero(sliding(padded, width, np.maximum)[:len(gram)] == gram)
    piece = np.searchsorted(ends, chosen, side="right")
    text, start, lo, hi = (np.array([p[k] for p in pieces])[piece] for k in (0, 1, 3, 4))
    at = chosen - begins[piece] + start
    own = (at >= lo) & (at < hi)
    chosen, piece, text, at = chosen[own], piece[own], text[own], at[own]
    length = np.array([len(texts[t]) for t in text], np.int64)
    before = np.minimum(at, width - 1)
    after = np.minimum(length - at, threshold)
    around = mix((total[chosen + after] - total[chosen - before]) * down[chosen - before]) + mix((before * 65536 + after).astype(np.uint64))
    return text, at, gram[chosen], mix(around), before, after


ANCHORS = "key1 bigint, key2 bigint, at bigint, gram bigint, around bigint, before int, after int"


def anchors(texts: DataFrame, threshold: int) -> DataFrame:
    """Anchors of texts (key1, key2, data); of equal texts in a task two are taken."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                keys, data = [], []
                for one, two, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    if (times := seen.get((one, two), 0)) < 2:
                        seen[one, two] = times + 1
                        keys.append((one, two))
                        data.append(text.as_py())
                names = np.array(keys, np.int64).reshape(-1, 2)
                for text, at, gram, around, before, after in anchors_of(data, threshold):
                    columns = [names[text, 0], names[text, 1], at, gram.view(np.int64), around.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns] + [
                        pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32))],
                        ["key1", "key2", "at", "gram", "around", "before", "after"])

    return texts.select(*KEY, "data").mapInArrow(run, ANCHORS)


# ---- buckets -----------------------------------------------------------------

MEMBERS = "bucket bigint, key1 bigint, key2 bigint, at bigint, before int, after int, done boolean, bytes binary"


def members(texts: DataFrame, wanted: DataFrame, threshold: int) -> DataFrame:
    """Rows of `wanted` (gram, key1, key2, at, before, after, done) with the bytes around the anchor."""
    lists = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("gram", "at", "before", "after", "done")).alias("wanted"))
    joined = texts.join(lists, KEY).select(*KEY, "data", "wanted")
    names = ["bucket", "key1", "key2", "at", "before", "after", "done", "bytes"]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for k in range(batch.num_rows):
                one, two = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if (one, two) in seen:
                    continue
                seen.add((one, two))
                data = batch.column(2)[k].as_py()
                rows = [(w["gram"], one, two, w["at"], w["before"], w["after"], w["done"], data[w["at"] - w["before"]:w["at"] + w["after"]])
                        for w in batch.column(3)[k].as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return joined.mapInArrow(run, MEMBERS)


def refined(place: np.ndarray, order: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets split by a digit: the places that are not alone, and their new buckets."""
    key = order * 257 + digit
    by = np.argsort(key, kind="stable")
    edge = np.concatenate([[True], np.diff(key[by]) != 0, [True]])
    alone = edge[1:] & edge[:-1]
    number = np.cumsum(edge[:-1]) - 1
    return place[by[~alone]], number[~alone]


def repeated_offsets(bucket: np.ndarray, around: np.ndarray, before: np.ndarray, after: np.ndarray, low: int, high: int, threshold: int) -> np.ndarray:
    """[row, offset - low]: whether a row's window that starts `offset` bytes before its anchor is in another row of its bucket too.

    around: each row's bytes, the anchor's start at column threshold - GRAM. Rows of a bucket agree in the core.
    """
    span, m, zero = high - low, len(bucket), threshold - GRAM
    _, bucket = np.unique(bucket, return_inverse=True)
    ranks = []
    for side in (0, 1):
        # side 0 goes left from the core, side 1 right; step r has r bytes more than the core
        rank = np.full((span + 1, m), -1, np.int64)
        place, order = refined(np.arange(m), bucket, np.zeros(m, np.int64))
        enough = (before >= low) if side == 0 else (after >= threshold - high)
        place, order = place[enough[place]], order[enough[place]]
        rank[0, place] = order
        for r in range(1, span + 1):
            if not len(place):
                break
            far = (before[place] >= low + r) if side == 0 else (after[place] >= threshold - high + r)
            place, order = place[far], order[far]
            if not len(place):
                break
            column = zero - low - r if side == 0 else zero + threshold - high + r - 1
            place, order = refined(place, order, around[place, column].astype(np.int64))
            rank[r, place] = order
        ranks.append(rank)
    out = np.zeros((m, span + 1), bool)
    for j in range(span + 1):
        left, right = ranks[0][j], ranks[1][span - j]
        both = np.flatnonzero((left >= 0) & (right >= 0))
        if len(both) > 1:
            place, _ = refined(both, left[both], np.zeros(len(both), np.int64))
            # buckets of the left ranks, split by the right ones
            key = left[place] * (m + 1) + right[place]
            by = np.argsort(key, kind="stable")
            edge = np.concatenate([[True], np.diff(key[by]) != 0, [True]])
            out[place[by[~(edge[1:] & edge[:-1])]], j] = True
    return out


SPANS = "key1 bigint, key2 bigint, start bigint, end bigint"


def sort_buckets(rows: DataFrame, threshold: int) -> DataFrame:
    """Spans of the repeated windows of rows (bucket, low, high, key1, key2, at, before, after, done, bytes)."""
    order = ["low", "high", "bucket", *KEY, "at"]
    dealt = rows.select(*order, "before", "after", "done", "bytes").repartition("bucket").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero, width, held = threshold - GRAM, 2 * threshold - GRAM, []

        def spans(group):
            (low, high), rows = group[0][:2], group
            around = np.zeros((len(rows), width), np.uint8)
            for k, r in enumerate(rows):
                around[k, zero - r[6]:zero + r[7]] = np.frombuffer(r[9], np.uint8)
            bucket, at, before, after = (np.array([r[c] for r in rows], np.int64) for c in (2, 5, 6, 7))
            again = repeated_offsets(bucket, around, before, after, low, high, threshold)
            again[np.array([r[8] for r in rows])] = False  # known to be repeated
            edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            (row, first), (_, last) = np.nonzero(edge == 1), np.nonzero(edge == -1)
            names = np.array([r[3:5] for r in rows], np.int64).reshape(-1, 2)
            columns = [names[row, 0], names[row, 1], at[row] - (last - 1 + low), at[row] - (first + low) + threshold]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key1", "key2", "start", "end"])

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in range(10))):
                if held and r[:6] == held[-1][:6]:
                    continue  # a copy of the text, from another task
                if held and (r[:2] != held[-1][:2] or r[2] != held[-1][2] and len(held) >= LOCAL_ROWS):
                    yield spans(held)
                    held = []
                held.append(r)
        if held:
            yield spans(held)

    return dealt.mapInArrow(run, SPANS)


def halved(rows: DataFrame, threshold: int) -> DataFrame:
    """One pass: rows go to the buckets of the longer cores that each half of their offsets shares."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.explode(F.array(F.struct(F.col("low").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("high").alias("b"))))
    each = rows.withColumn("half", halves).withColumns({"a": F.greatest("half.a", F.lit(threshold) - F.col("after")), "b": F.least("half.b", "before")})
    each = each.filter("a <= b AND half.a <= half.b")
    core = F.substring("bytes", F.col("before") - F.col("half.a") + 1, F.lit(threshold) - (F.col("half.b") - F.col("half.a")))
    return each.withColumn("bucket", F.xxhash64("bucket", "half.a", core)).withColumn("low", F.col("half.a")).withColumn(
        "high", F.col("half.b")).drop("half", "a", "b")


def spans_of_buckets(rows: DataFrame, threshold: int, bucket: int) -> list[DataFrame]:
    """Spans of repeated windows, bucket by bucket; large buckets are split by further passes."""
    found = []
    rows = rows.withColumns({"low": F.lit(0), "high": F.lit(threshold - GRAM)})
    while True:
        sizes = materialize(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "window-buckets")
        found.append(materialize(sort_buckets(rows.join(sizes.filter(F.col("n") <= bucket).select("bucket"), "bucket", "left_semi"), threshold), "window-spans"))
        large = sizes.filter(F.col("n") > bucket).select("bucket")
        if large.isEmpty():
            return found
        rows = rows.join(large, "bucket", "left_semi")
        single = rows.filter("low = high AND NOT done")  # at full depth
        found.append(materialize(single.select(*KEY, (F.col("at") - F.col("low")).alias("start"),
                                               (F.col("at") - F.col("low") + threshold).alias("end")), "window-spans"))
        rows = materialize(halved(rows.filter("low < high"), threshold), "window-halves")


# ---- documents ---------------------------------------------------------------

KEPT = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


def without_spans(rows: DataFrame) -> DataFrame:
    """Rows (id, data, spans) with overlapping and touching spans merged, and the bytes outside of them."""
    names = ["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out = []
                for k, id_ in enumerate(part.column(0).to_pylist()):
                    data, merged = part.column(1)[k].as_py(), []
                    for start, end in sorted((s["start"], s["end"]) for s in part.column(2)[k].as_py() or []):
                        if merged and start <= merged[-1][1]:
                            merged[-1][1] = max(end, merged[-1][1])
                        else:
                            merged.append([start, end])
                    stays, at = [], 0
                    for start, end in merged:
                        stays.append(data[at:start])
                        at = end
                    stays.append(data[at:])
                    out.append((id_, len(data), sum(e - s for s, e in merged), len(merged), [{"start": s, "end": e} for s, e in merged], b"".join(stays)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return rows.mapInArrow(run, KEPT)


def remove_repeats(docs: DataFrame, threshold: int = 200, id_col: str = "doc_id", text_col: str = "text", bucket: int = 1 << 14) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, spans, kept (bytes, which may cut a character) of every row."""
    if threshold <= GRAM:
        raise ValueError(f"threshold must exceed {GRAM} bytes")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.lit(1), text).alias("key1"),
                       F.xxhash64(F.lit(2), text).alias("key2"), F.encode(text, "UTF-8").alias("data"))
    long = rows.filter(F.octet_length("data") >= threshold)
    all_ = materialize(anchors(long, threshold), "window-anchors")
    again = all_.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
    live = materialize(all_.join(again, "gram", "left_semi"), "window-live")
    dropped(all_)
    one = F.struct(*KEY, "at", "before", "after")
    contexts = materialize(live.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(one).alias("one")), "window-contexts")
    whole = live.join(contexts.filter("n > 1").select("gram", "around"), ["gram", "around"], "left_semi").select(
        *KEY, (F.col("at") - F.col("before")).alias("start"), (F.col("at") + F.col("after")).alias("end"))
    several = contexts.groupBy("gram").agg(F.count("*").alias("contexts")).filter("contexts > 1").select("gram")
    wanted = contexts.join(several, "gram", "left_semi").select("gram", "one.*", (F.col("n") > 1).alias("done"))
    rest = materialize(members(long, wanted, threshold), "window-members")
    spans = whole.distinct()
    for part in spans_of_buckets(rest, threshold, bucket):
        spans = spans.unionByName(part)
    by_text = spans.groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return without_spans(rows.join(by_text, KEY, "left").select("id", "data", "spans"))


def op12_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of repeated windows of 200 bytes."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# Bytes are handled as pairs of hex digits; chunks of 2,000 bytes keep substr() off long strings.
OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT r, len(x) // 2 AS n, unnest(range(0, greatest(len(x) // 2 - 199, 0), 2000)) AS o, x FROM d),
p AS MATERIALIZED (SELECT r, n, o, substr(x, 2 * o + 1, 4400) AS x FROM c),
w AS MATERIALIZED (SELECT r, o + i AS s, md5_number(substr(x, 2 * i + 1, 400)) AS h
  FROM (SELECT r, n, o, x, unnest(range(0, least(2000, n - 199 - o))) AS i FROM p)),
g AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
m AS (SELECT r, s, s - lag(s) OVER (PARTITION BY r ORDER BY s) AS gap FROM w SEMI JOIN g USING (h)),
t AS (SELECT r, s, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY s) AS span FROM m),
u AS (SELECT r, span, min(s) AS a, max(s) + 200 AS b FROM t GROUP BY r, span),
v AS (SELECT r, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM u GROUP BY r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN starts IS NULL THEN x ELSE array_to_string(list_transform(range(0, len(starts) + 1), lambda k:
    x[2 * (CASE WHEN k = 0 THEN 0 ELSE ends[k] END) + 1 : CASE WHEN k = len(starts) THEN len(x) ELSE 2 * starts[k + 1] END]), '') END)) AS kept_sha256
FROM d LEFT JOIN v USING (r)
"""
