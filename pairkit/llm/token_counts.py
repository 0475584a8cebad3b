"""Token counts of whole texts, with huge documents encoded in overlapping chunks.

Texts up to `chunk` characters are encoded where they are read. Longer ones are cut into chunks
that overlap by `overlap` characters and are spread over the tasks. Two neighbours are spliced
at a position where both put a boundary between pre-tokens. That is proven to be a boundary of
the whole text: a chunk sees all that decides its boundaries, but for `margin` characters before
its end, and from a boundary on the split depends only on what follows. By induction from the
first chunk every splice is right. A document with a seam that has no common boundary is done
again with overlaps (and, where needed, chunks) eight times as long, until one chunk holds it.

Only pre-token boundaries serve: a boundary between two tokens of one word may move with its
context. `margin` must exceed the longest added token and the pattern's look-ahead.

Where the tokenizer puts a boundary before each single space between two visible characters, as the
byte-level pattern does, texts are cut there. The library counts a worker's rarer pieces of a text in
one go and those that come again one by one; the latter counts are remembered. A chunk whose zones have
such a place each is then counted from one to the other, so that no zone is encoded twice.

Defined results: a NULL text is empty and has no tokens; rows may repeat, each is counted; an
empty table gives no rows. Columns of the input other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairkit.session import materialize

MARGIN = 64
BATCH_CHARS = 1 << 16
WIDEN = 8
PIECES = 8
# A single space between two visible characters; none of the classes has white space in any alphabet.
WORD_START = re.compile("(?<=[!-~\u00a1-\u167f])(?= [!-~\u00a1-\u167f])")
# Pieces that a worker remembers, and how long one may be.
HELD_PIECES, PIECE_CHARS = 400_000, 32


def load(tokenizer_json: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
    from tokenizers import Tokenizer

    return Tokenizer.from_str(tokenizer_json)


def starts_words_at_spaces(tokenizer_json: str) -> bool:
    """Whether the tokenizer has a pre-token boundary at every `WORD_START`, with nothing before it deciding what follows."""
    parts = json.loads(tokenizer_json)
    pre, model = parts.get("pre_tokenizer") or {}, parts["model"]
    added = parts.get("added_tokens") or []
    return (not any(parts.get(k) for k in ("normalizer", "truncation", "padding")) and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True) and not pre.get("add_prefix_space") and model.get("type") == "BPE" and not model.get("dropout")
            and not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word"))
            and not any(re.search(r"\s", t["content"]) for t in added))


class Counter:
    """Token counts of texts, with the counts of pieces that come again remembered."""

    def __init__(self, tokenizer_json: str) -> None:
        self.tokenizer, self.cuts = load(tokenizer_json), starts_words_at_spaces(tokenizer_json)
        self.known: dict[str, int] = {}  # 0: met once

    def encoded(self, texts: list[str]) -> Iterator[int]:
        return (len(e) for part in batches_of(texts) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False))

    def __call__(self, texts: list[str]) -> list[int]:
        return [n for part in batches_of(texts) for n in self._some(part)] if self.cuts else list(self.encoded(texts))

    def _some(self, texts: list[str]) -> list[int]:
        if len(self.known) >= HELD_PIECES:
            # those that came again stay, unless they alone fill half of the place
            kept = {p: n for p, n in self.known.items() if n}
            self.known = kept if 2 * len(kept) < HELD_PIECES else {}
        known, counts, rest, again = self.known, [], [], set()
        for text in texts:
            pieces = WORD_START.split(text)
            found = list(map(known.get, pieces))
            counts.append(sum(filter(None, found)))
            left = [p for p, n in zip(pieces, found) if not n]
            # boundaries stay where pieces meet, as each but a text's first begins with its space
            rest.append("".join(left))
            for p in left:
                if p in known:
                    again.add(p)
                elif 0 < len(p) <= PIECE_CHARS:
                    known[p] = 0
        known.update(zip(again, self.encoded(list(again))))
        return [n + m for n, m in zip(counts, self.encoded(rest))]


def loaded(sent, name: str) -> Counter:
    """The tokenizer as the worker process has it already, by the name of its content, which is broadcast."""
    kept = sys.modules.setdefault("_tokenizers", types.ModuleType("_tokenizers")).__dict__
    if name not in kept:
        kept[name] = Counter(sent.value)
    return kept[name]


def batches_of(texts: list[str], chars: int = BATCH_CHARS) -> Iterator[list[str]]:
    """The texts in runs of about `chars` characters, as an encoding takes far more memory than its text."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def cut(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """(start, text) of chunks; each begins `overlap` characters before the end of the one before it."""
    starts = [0]
    while starts[-1] + chunk < len(text):
        starts.append(starts[-1] + chunk - overlap)
    return [(s, text[s:s + chunk]) for s in starts]


def boundaries(encoding, start: int, low: int, high: int) -> tuple[list[int], list[int]]:
    """Starts of pre-tokens at low <= position < high, and the tokens before each; positions in the document."""
    at, before, n = [], [], len(encoding)
    i = encoding.char_to_token(low - start) or 0
    last = encoding.token_to_word(i - 1) if 0 < i else None
    while i < n:
        word, (begin, _) = encoding.token_to_word(i), encoding.token_to_chars(i)
        if start + begin >= high:
            break
        if (word is None or word != last) and start + begin >= low:
            at.append(start + begin)
            before.append(i)
        last, i = word, i + 1
    return at, before


def word_start(piece: str, low: int, high: int) -> int | None:
    """The first `WORD_START` at low < position < high; a chunk's neighbour, which has the same zone, finds the same."""
    found = WORD_START.search(piece, low + 1, high + 1)
    return found.start() if found else None


FIRST = "id bigint, text_hash bigint, n_bytes bigint, n_tokens bigint, i int, n_chunks int, start bigint, piece string"
SEAMS = ("id bigint, text_hash bigint, n_bytes bigint, n_chunks int, i int, tokens bigint, "
         "tail_at array<bigint>, tail_before array<bigint>, head_at array<bigint>, head_before array<bigint>")


def encode_or_cut(rows: DataFrame, sent, name: str, chunk: int, overlap: int) -> DataFrame:
    """Short texts with their counts, long ones as chunks."""
    names = [f.split()[0] for f in FIRST.split(", ")]
    schema = pa.schema([(n, pa.string() if n == "piece" else pa.int32() if n in ("i", "n_chunks") else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = loaded(sent, name)
        for batch in batches:
            ids, hashes, sizes, texts = (batch.column(i).to_pylist() for i in range(4))
            short = [k for k, t in enumerate(texts) if len(t) <= chunk]
            counts = count([texts[k] for k in short])
            none = pa.nulls(len(short))
            pick = lambda x: [x[k] for k in short]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) if isinstance(x, list) else none.cast(f.type) for x, f in zip(
                (pick(ids), pick(hashes), pick(sizes), counts, None, None, None, None), schema)], schema=schema)
            for k in set(range(len(texts))) - set(short):
                pieces = cut(texts[k], chunk, overlap)
                yield pa.RecordBatch.from_pylist([
                    {"id": ids[k], "text_hash": hashes[k], "n_bytes": sizes[k], "i": i, "n_chunks": len(pieces), "start": s, "piece": p}
                    for i, (s, p) in enumerate(pieces)], schema)

    return rows.mapInArrow(run, FIRST)


def encode_chunks(chunks: DataFrame, sent, name: str, overlap: int, margin: int) -> DataFrame:
    """Tokens of each chunk and its boundaries in the zones it shares with its neighbours."""
    schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("n_bytes", pa.int64()), ("n_chunks", pa.int32()),
                        ("i", pa.int32()), ("tokens", pa.int64()), *[(n, pa.list_(pa.int64())) for n in (
                            "tail_at", "tail_before", "head_at", "head_before")]])

    def encoded(count, rows):
        """For each row its tokens and (at, before) of its head and of its tail."""
        spans = []
        for r in rows:
            last, size = r["i"] == r["n_chunks"] - 1, len(r["piece"])
            begin = word_start(r["piece"], 0, overlap - margin) if r["i"] > 0 else 0
            end = size if last else word_start(r["piece"], size - overlap, size - margin)
            spans.append((begin, end) if count.cuts and None not in (begin, end) and begin <= end else None)
        counted = iter(count([r["piece"][slice(*s)] for r, s in zip(rows, spans) if s]))
        whole = (e for part in batches_of([r["piece"] for r, s in zip(rows, spans) if not s])
                 for e in count.tokenizer.encode_batch(part, add_special_tokens=False))
        for row, span in zip(rows, spans):
            piece, start = row["piece"], row["start"]
            stop = start + len(piece)
            first, last = row["i"] == 0, row["i"] == row["n_chunks"] - 1
            if span:
                n = next(counted)
                yield row, n, ([], []) if first else ([start + span[0]], [0]), ([], []) if last else ([start + span[1]], [n])
            else:
                e = next(whole)
                yield (row, len(e), ([], []) if first else boundaries(e, start, start, start + overlap - margin),
                       ([], []) if last else boundaries(e, start, stop - overlap, stop - margin))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = loaded(sent, name)
        for batch in batches:
            for lo in range(0, batch.num_rows, PIECES):
                for row, tokens, head, tail in encoded(count, batch.slice(lo, PIECES).to_pylist()):
                    yield pa.RecordBatch.from_pylist([{c: row[c] for c in ("id", "text_hash", "n_bytes", "n_chunks", "i")} | {
                        "tokens": tokens, "tail_at": tail[0], "tail_before": tail[1],
                        "head_at": head[0], "head_before": head[1]}], schema)

    return chunks.mapInArrow(run, SEAMS)


def splice(encoded: DataFrame) -> DataFrame:
    """One row per document: id, text_hash, n_bytes, n_tokens, copies, aligned.

    Each chunk adds its tokens from its first splice to its last; a seam adds what its left chunk
    has before it and takes away what its right chunk has.
    """
    key = ["id", "text_hash", "n_bytes", "n_chunks"]
    # rows that repeat give equal chunks: one of each counts, `copies` of them
    chunks = encoded.groupBy(*key, "i").agg(*[F.first(c).alias(c) for c in (
        "tokens", "tail_at", "tail_before", "head_at", "head_before")], F.count("*").alias("copies"))
    left = F.struct(F.col("i").alias("seam"), F.col("tail_at").alias("at"), F.col("tail_before").alias("before"), F.lit(1).alias("side"))
    right = F.struct((F.col("i") - 1).alias("seam"), F.col("head_at").alias("at"), F.col("head_before").alias("before"), F.lit(-1).alias("side"))
    sides = chunks.select(*key, "i", "tokens", "copies", F.explode(F.array(left, right)).alias("s")).select(
        *key, "i", "tokens", "copies", "s.*")
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    seams = sides.groupBy(*key, "seam").agg(
        *[of(side, c).alias(f"{n}_{c}") for side, n in ((1, "l"), (-1, "r")) for c in ("at", "before")],
        of(1, "tokens").alias("tokens"), F.max("copies").alias("copies"))
    at = F.array_max(F.array_intersect("l_at", "r_at"))
    found = lambda n: F.element_at(F.col(f"{n}_before"), F.array_position(F.col(f"{n}_at"), F.col("at")).cast("int"))
    inner = F.col("seam").between(0, F.col("n_chunks") - 2)
    seams = seams.withColumn("at", F.when(inner, at))
    # the left chunk's tokens from the splice on are not its own: they are the right chunk's
    part = (F.when(F.col("seam") < 0, 0).when(F.col("seam") == F.col("n_chunks") - 1, F.col("tokens"))
            .otherwise(found("l") - found("r")))
    return seams.withColumn("part", part).groupBy(*key).agg(
        F.sum("part").alias("n_tokens"), F.max("copies").alias("copies"),
        F.min(~inner | F.col("at").isNotNull()).alias("aligned")).drop("n_chunks")


def count_tokens(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text",
                 chunk: int = 1 << 14, overlap: int = 512, margin: int = MARGIN) -> DataFrame:
    """id, n_bytes, n_tokens of every row; `tokenizer_json` is the content of the tokenizer's file.

    Added special tokens are not put in, but their strings within a text count as such tokens.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("text_hash"),
                       F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    sent, name = docs.sparkSession.sparkContext.broadcast(tokenizer_json), hashlib.sha256(tokenizer_json.encode()).hexdigest()
    results, todo = [], rows
    while True:
        first = materialize(encode_or_cut(todo, sent, name, chunk, overlap), "token-chunks")
        results.append(first.filter("i IS NULL").select("id", "n_bytes", "n_tokens"))
        long = first.filter("i IS NOT NULL").repartition("id", "text_hash", "i")
        spliced = materialize(splice(encode_chunks(long, sent, name, overlap, margin)), "token-splices")
        results.append(spliced.filter("aligned").select(
            "id", "n_bytes", "n_tokens", F.explode(F.expr("sequence(1L, copies)")).alias("copy")).drop("copy"))
        failed = spliced.filter("NOT aligned").select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"))
        if failed.isEmpty():
            break
        overlap *= WIDEN
        chunk = max(chunk, 4 * overlap)
        same = (F.col("text_hash") == F.col("__hash")) & F.col("id").eqNullSafe(F.col("__id"))
        todo = rows.join(failed, same, "left_semi")
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    return whole


def op2_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """Token counts of every document."""
    import public_tokenizers

    with open(public_tokenizers.path(tokenizer), encoding="utf-8") as f:
        content = f.read()
    counts = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), content)
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
