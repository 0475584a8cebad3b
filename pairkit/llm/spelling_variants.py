"""Spelling variant grouping: words one edit apart, found by probing edits against Bloom filters.

Two words are near if they differ by one inserted, deleted or replaced code point. Each word's edits
are generated as hashes, not as strings, and probed against blocked Bloom filters of the vocabulary,
one for each word length; only positives become strings and are shuffled to an exact join with the
vocabulary, which removes false positives. Each pair is generated from one side alone: a deletion
from the longer word, a replacement from the word with the smaller letter.

A word's hash is a polynomial of its letters, so an edit's hash comes from the word's by one or two
products. A key sets one bit in each of the eight lanes of one 256-bit block, at 16 bits a key.

What is broadcast is bounded: a round holds at most `round_bytes` of filters, 32 MB by default or
16 million words. Larger vocabularies take several rounds, each with the next ranges of blocks; a
probe belongs to one block and so to one round. A task builds one chunk of a filter, 64 KB, which
some 32 thousand words share. Words of `LAST` letters and more share one filter.

A word's form is its near word of largest count (ties: the smallest in code-point order), if that
count is ten times the word's own or more. Counts grow tenfold along forms, so a chain has fewer
than 20, and roots are found by doubling pointers in at most six rounds.

Words are the maximal runs of `[A-Za-z\\u00C0-\\u00FF]` with A-Z lower-cased. A NULL text has none, a
NULL id is an empty string, repeated rows count again, and an empty table gives no rows. Columns
other than id and text are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairkit.llm.language_id import mix
from pairkit.session import materialize

LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
RUN = r"[A-Za-zÀ-ÿ]"
LAST = 64
BITS_PER_KEY, BLOCK_BITS, LANES = 16, 256, 8
CHUNK_BLOCKS = 2048
BASE = 0xD1342543DE82EF95
LETTER = np.random.default_rng(13).integers(1, 2 ** 63, 256, dtype=np.uint64)
SALT = np.random.default_rng(31).integers(1, 2 ** 31, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PROBES = 1 << 19


# ---- vocabulary --------------------------------------------------------------

def vocabulary(runs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words of `runs` (word) that are long and frequent enough."""
    counted = runs.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 1) -> DataFrame:
    """id, word: every run of at least `least_length` letters, A-Z lower-cased."""
    runs = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"({RUN}{{{least_length},}})"), 1)
    each = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("word"))
    return each.select("id", F.translate("word", string.ascii_uppercase, string.ascii_lowercase).alias("word"))


# ---- hashes and filters ------------------------------------------------------

def powers(length: int) -> np.ndarray:
    up = np.full(length + 1, BASE, np.uint64)
    up[0] = 1
    return np.cumprod(up)


def keys_of(hashes: np.ndarray, length: int) -> np.ndarray:
    return mix(hashes + np.uint64(length * 0x9E3779B97F4A7C15 % 2 ** 64))


def letters_of(words: Sequence[str]) -> np.ndarray:
    """Words of one length as rows of letters."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def by_length(words: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words of each length, and their letters."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, letters_of([words[i] for i in at])


def word_keys(letters: np.ndarray) -> np.ndarray:
    n = letters.shape[1]
    return keys_of((LETTER[letters] * powers(n)[:n]).sum(axis=1, dtype=np.uint64), n)


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def lane_bits(keys: np.ndarray, lane: int) -> np.ndarray:
    return (((keys & np.uint64(0xFFFFFFFF)) * SALT[lane]) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)


def blocks_for(words: int) -> int:
    return max(1, -(-words * BITS_PER_KEY // BLOCK_BITS))


class Filter:
    """Blocks `first` to `first` + len(bits) of a blocked Bloom filter of `blocks` blocks."""

    def __init__(self, blocks: int, first: int, bits: np.ndarray):
        self.blocks, self.first, self.bits = blocks, first, bits

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys that may be in, of those whose block is in this range; lane by lane, as few stay."""
        block = block_of(keys, self.blocks).astype(np.int64) - self.first
        at = np.arange(len(keys)) if len(self.bits) == self.blocks else np.flatnonzero((block >= 0) & (block < len(self.bits)))
        for lane in range(LANES):
            word = self.bits[block[at], lane]
            at = at[(word >> lane_bits(keys[at], lane).astype(np.uint32)) & np.uint32(1) == 1]
        return at


def chunks_of_filters(words: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """shard, chunk, bits: chunks of the filters, each built by one task from the words it holds."""
    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = np.zeros(len(batch), np.uint64)
            shard = np.zeros(len(batch), np.int32)
            chunk = np.zeros(len(batch), np.int64)
            for at, letters in by_length(batch["word"].tolist()):
                keys[at] = word_keys(letters)
                shard[at] = min(letters.shape[1], LAST)
                chunk[at] = block_of(keys[at], blocks[min(letters.shape[1], LAST)]).astype(np.int64) // CHUNK_BLOCKS
            yield pd.DataFrame({"shard": shard, "chunk": chunk, "key": keys.view(np.int64)})

    def build(group: pd.DataFrame) -> pd.DataFrame:
        shard, chunk = int(group["shard"].iloc[0]), int(group["chunk"].iloc[0])
        keys = group["key"].to_numpy().view(np.uint64)
        first = chunk * CHUNK_BLOCKS
        block = block_of(keys, blocks[shard]).astype(np.int64) - first
        bits = np.zeros((min(CHUNK_BLOCKS, blocks[shard] - first), LANES), np.uint32)
        for lane in range(LANES):
            np.bitwise_or.at(bits, (block, lane), np.uint32(1) << lane_bits(keys, lane).astype(np.uint32))
        return pd.DataFrame({"shard": [shard], "chunk": [chunk], "bits": [bits.tobytes()]})

    keyed = words.select("word").mapInPandas(marks, "shard int, chunk bigint, key bigint")
    return keyed.groupBy("shard", "chunk").applyInPandas(build, "shard int, chunk bigint, bits binary")


def rounds_of(blocks: dict[int, int], round_bytes: int) -> list[list[tuple[int, int, int]]]:
    """(shard, first chunk, end) of each round, whole chunks, at most `round_bytes` a round."""
    room = max(1, round_bytes * 8 // BLOCK_BITS // CHUNK_BLOCKS)
    rounds, used = [[]], 0
    for shard, size in sorted(blocks.items()):
        at, end = 0, -(-size // CHUNK_BLOCKS)
        while at < end:
            if used == room:
                rounds.append([])
                used = 0
            take = min(end - at, room - used)
            rounds[-1].append((shard, at, at + take))
            at, used = at + take, used + take
    return rounds


# ---- edits -------------------------------------------------------------------

def deletions(letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """row, place, key of each word's deletions; of a run of one letter the last is deleted."""
    m, n = letters.shape
    value = LETTER[letters] * powers(n)[:n]
    back = np.uint64(pow(BASE, -1, 2 ** 64))
    before = np.cumsum(value, axis=1) - value
    after = (value.sum(axis=1, dtype=np.uint64)[:, None] - before - value) * back
    row, place = np.nonzero(np.concatenate([letters[:, 1:] != letters[:, :-1], np.ones((m, 1), bool)], axis=1))
    yield row, place, keys_of((before + after)[row, place], n - 1)


def replacements(letters: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """row, place, new letter, key of each word's replacements by a greater letter, some places at a time."""
    m, n = letters.shape
    power = powers(n)[:n]
    whole = (LETTER[letters] * power).sum(axis=1, dtype=np.uint64)
    step = max(1, PROBES // max(1, m * len(alphabet)))
    for lo in range(0, n, step):
        part = letters[:, lo:lo + step]
        row, place, new = np.nonzero(alphabet[None, None, :] > part[:, :, None])
        change = (LETTER[alphabet][new] - LETTER[part[row, place]]) * power[lo + place]
        yield row, place + lo, alphabet[new], keys_of(whole[row] + change, n)


def positives(words: DataFrame, filters, alphabet: bytes, least_length: int) -> DataFrame:
    """word, n, candidate: edits of the words (word, n) that the filters may hold. filters: shard to what makes its Filter, broadcast."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards, known = {s: Filter(*f) for s, f in filters.value.items()}, np.frombuffer(alphabet, np.uint8)
        for batch in batches:
            names, counts = batch["word"].to_numpy(), batch["n"].to_numpy()
            for at, letters in by_length(names.tolist()):
                n = letters.shape[1]
                rows = max(1, PROBES // max(1, n * len(known)))
                for lo in range(0, len(at), rows):
                    part, places = letters[lo:lo + rows], at[lo:lo + rows]
                    found = []
                    if n > least_length and min(n - 1, LAST) in shards:
                        for row, place, keys in deletions(part):
                            hit = shards[min(n - 1, LAST)].holds(keys)
                            flat = part[row[hit]]
                            gone = np.arange(n)[None, :] != place[hit][:, None]
                            found.append((places[row[hit]], flat[gone].reshape(len(hit), n - 1)))
                    if min(n, LAST) in shards:
                        for row, place, new, keys in replacements(part, known):
                            hit = shards[min(n, LAST)].holds(keys)
                            flat = part[row[hit]]
                            flat[np.arange(len(hit)), place[hit]] = new[hit]
                            found.append((places[row[hit]], flat))
                    for source, edits in found:
                        if len(source):
                            whole, size = edits.tobytes().decode("latin-1"), edits.shape[1]
                            yield pd.DataFrame({"word": names[source], "n": counts[source],
                                                "candidate": [whole[k:k + size] for k in range(0, len(whole), size)]})

    return words.select("word", "n").mapInPandas(run, "word string, n bigint, candidate string")


# ---- groups ------------------------------------------------------------------

def near_pairs(words: DataFrame, least_length: int = LEAST_LENGTH, round_bytes: int = 32 << 20) -> DataFrame:
    """word, n, other, other_n: each two near words of `words` (word, n) once. `words` is a written table of distinct words."""
    spark = words.sparkSession
    shard = F.least(F.char_length("word"), F.lit(LAST)).alias("shard")
    blocks = {r["shard"]: blocks_for(r["count"]) for r in words.groupBy(shard).count().collect()}  # at most LAST rows
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).filter("letter <> ''").distinct().collect()
    alphabet = bytes(sorted(r["letter"].encode("latin-1")[0] for r in letters))  # at most 90
    chunks = materialize(chunks_of_filters(words, blocks), "spelling-filters")
    found = []
    for part in rounds_of(blocks, round_bytes):
        ranges = {s: (lo, hi) for s, lo, hi in part}
        inside = F.lit(False)
        for s, (lo, hi) in ranges.items():
            inside = inside | ((F.col("shard") == s) & F.col("chunk").between(lo, hi - 1))
        bits: dict[int, np.ndarray] = {s: np.zeros((min(hi * CHUNK_BLOCKS, blocks[s]) - lo * CHUNK_BLOCKS, LANES), np.uint32)
                                       for s, (lo, hi) in ranges.items()}
        for r in chunks.filter(inside).collect():  # at most round_bytes
            at = (r["chunk"] - ranges[r["shard"]][0]) * CHUNK_BLOCKS
            own = np.frombuffer(r["bits"], np.uint32).reshape(-1, LANES)
            bits[r["shard"]][at:at + len(own)] = own
        filters = spark.sparkContext.broadcast({s: (blocks[s], ranges[s][0] * CHUNK_BLOCKS, b) for s, b in bits.items()})
        exact = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
        # a number of its own, as partitions of few bytes hold much work here
        spread = words.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
        hits = positives(spread, filters, alphabet, least_length)
        found.append(materialize(hits.join(exact, F.col("candidate") == F.col("other")).select("word", "n", "other", "other_n"), "spelling-pairs"))
        filters.destroy()
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs


def group_variants(words: DataFrame, least_length: int = LEAST_LENGTH, ratio: int = RATIO, round_bytes: int = 32 << 20) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of `words` (word, n)."""
    words = materialize(words.select("word", "n"), "spelling-words")
    pairs = near_pairs(words, least_length, round_bytes)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"),
                                          F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.max("n").alias("own"), F.count("*").alias("n_near"),
                                    F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    fits = -F.col("best.minus") >= ratio * F.col("own")
    near = materialize(best.select("word", "n_near", F.when(fits, F.col("best.other")).alias("form"),
                                   F.when(fits, -F.col("best.minus")).alias("form_n")), "spelling-forms")
    roots = materialize(near.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        longer = materialize(roots.join(onward, "root", "left"), "spelling-roots")
        roots = longer.select("word", F.coalesce("onward", "root").alias("root"))
        if longer.filter("onward IS NOT NULL").isEmpty():
            break
    joined = words.join(near, "word", "left").join(roots, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                         F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")


def misspelt(runs: DataFrame) -> DataFrame:
    """Runs (id, word) of which every 31st, by a hash of id and word, loses a letter."""
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "word"))
    marked = runs.select("word", h.alias("h"))
    at = (F.col("h") % F.char_length("word")).cast("int")
    shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
    return marked.select(F.when(F.col("h") % 31 == 0, shorter).otherwise(F.col("word")).alias("word"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents, some of them misspelt, with its form and root."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return group_variants(vocabulary(misspelt(word_runs(docs, least_length=LEAST_LENGTH))))


OP13_SQL = r"""
WITH RECURSIVE tbl AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]{7,}')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
d AS (SELECT doc_id, w, count(*) AS n FROM r GROUP BY doc_id, w),
b AS (SELECT w, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
                   ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END)) AS bytes FROM d),
h AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS h FROM b, tbl),
m AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
e AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT DISTINCT e.word, e.n, v.word AS other, v.n AS other_n FROM e JOIN v ON v.word = e.a || e.z
  UNION SELECT x.word, x.n, y.word, y.n FROM e x JOIN e y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word),
q AS (SELECT word, n, other, other_n FROM p UNION SELECT other, other_n, word, n FROM p),
f AS MATERIALIZED (SELECT word, n, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM q GROUP BY word, n),
g AS MATERIALIZED (SELECT word, other AS form, other_n AS form_n FROM f WHERE other_n >= 10 * n),
s(word, root) AS (SELECT word, form FROM g UNION ALL SELECT s.word, g.form FROM s JOIN g ON g.word = s.root),
o AS (SELECT s.word, s.root FROM s LEFT JOIN g ON g.word = s.root WHERE g.word IS NULL)
SELECT v.word, g.form, coalesce(o.root, v.word) AS root, v.n, coalesce(f.n_near, 0) AS n_near, g.form_n
FROM v LEFT JOIN f USING (word) LEFT JOIN g ON g.word = v.word LEFT JOIN o ON o.word = v.word
"""
