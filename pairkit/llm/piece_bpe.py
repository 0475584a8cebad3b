"""SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

The encoding of a text is the one sequence of pieces in which every two neighbours are
compatible: merging their joined characters anew gives the same two pieces. So nothing has to
be merged for a whole text. An Aho-Corasick automaton finds the pieces that start at each
position; the longest one compatible with its predecessor is taken, shorter ones are tried when
it is not, and when none fits the position is marked as failed in a bitfield and the last piece
is taken back. Each position fails at most once, so the time is linear in the text.

Between some characters no piece can reach across: before a space sign that follows another
character, around a line break, and between letters or digits and other signs but for the pairs
that stand in some piece (all read off the model's pieces). So texts are encoded by the segments
between such places, and the segments' ids are remembered in a bounded table of the worker. Characters without a piece become byte pieces.

Only models with identity normalisation and without user-defined pieces are accepted, as the
one given is. Defined results: NULL encodes like the empty text, to begin and end only; rows may
repeat; an empty table gives no rows; other columns pass through unless they clash with `ids`,
which is replaced.
"""

from __future__ import annotations

import re
import sys
import types
from array import array
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

SPACE = "▁"
MEMO_ENTRIES = 200_000
MEMO_CHARS = 64
LONG_TEXT = 1 << 22


def merge(text: str, rank: dict[str, float]) -> list[str]:
    """Plain merging: again and again the best-scored pair of neighbours, the leftmost on a tie."""
    parts = list(text)
    while len(parts) > 1:
        scores = [rank.get(a + b) for a, b in zip(parts, parts[1:])]
        known = [s for s in scores if s is not None]
        if not known:
            break
        k = scores.index(max(known))
        parts[k:k + 2] = [parts[k] + parts[k + 1]]
    return parts


class PieceModel:
    """Tables of a model, picklable; workers build their automaton on first use."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], dummy_prefix: bool = True):
        self.pieces, self.kinds, self.dummy_prefix = pieces, kinds, dummy_prefix
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "normal"}
        self.rank = {p: scores[i] for p, i in self.ids.items()}
        self.byte_ids = [None] * 256
        for i, (p, k) in enumerate(zip(pieces, kinds)):
            if k == "byte":
                self.byte_ids[int(p[3:5], 16)] = i
        self.control = {i for i, k in enumerate(kinds) if k == "control"}
        self.unknown, self.begin, self.end = kinds.index("unknown"), pieces.index("<s>"), pieces.index("</s>")
        # pieces that merging never makes can stand in no encoding
        self.usable = [p for p in self.ids if len(p) == 1 or merge(p, self.rank) == [p]]
        self.whole = set(self.usable)
        self.alphabet = {p for p in self.ids if len(p) == 1}
        inner = all(SPACE not in p[1:] or not p.strip(SPACE) for p in self.ids)
        breaks = not any("\n" in p for p in self.ids)
        if not all(c in self.alphabet for p in self.usable for c in p):
            raise ValueError("a piece has a character that is no piece")
        self.pattern = self._pattern() if inner and breaks else r"[ ▁]*[^ ▁]+|[ ▁]+" if inner else r"(?s).+"
        self.fingerprint = hash((tuple(pieces), tuple(scores)))
        self._ready = False

    def _pattern(self) -> str:
        """Spaces and what follows: letters and digits, or other signs, going on from one to the other at joined pairs."""
        crossing = sorted({(a, b) for p in self.ids for a, b in zip(p, p[1:]) if SPACE not in (a, b) and a.isalnum() != b.isalnum()})
        unit = r"(?:[^\W_]+|(?:[^\w ▁\n]|_)+)"
        if len(crossing) > 50:
            return r"[ ▁]*[^ ▁\n]+|[ ▁]+|\n+"
        joins = "|".join(f"(?<={re.escape(a)})(?={re.escape(b)})" for a, b in crossing)
        return rf"[ ▁]*{unit}" + (f"(?:(?:{joins}){unit})*" if joins else "") + r"|[ ▁]+|\n+"

    def here(self) -> PieceModel:
        """This model as the worker process has it already, with its automaton and tables."""
        kept = sys.modules.setdefault("_piece_models", types.ModuleType("_piece_models")).__dict__
        model = kept.setdefault(self.fingerprint, self)
        if not model._ready:
            model._build()
        return model

    @classmethod
    def load(cls, path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        normal = spec.normalizer_spec
        kinds = {1: "normal", 2: "unknown", 3: "control", 6: "byte"}
        if (normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces
                or spec.trainer_spec.treat_whitespace_as_suffix or any(p.type not in kinds for p in spec.pieces)
                or spec.trainer_spec.model_type != 2):
            raise ValueError("only BPE models with identity normalisation and plain pieces are supported")
        return cls([p.piece for p in spec.pieces], [p.score for p in spec.pieces], [kinds[p.type] for p in spec.pieces],
                   normal.add_dummy_prefix)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")} | {"_ready": False}

    def _build(self) -> None:
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        for p in self.usable:
            self._automaton.add_word(p, p)
        self._automaton.make_automaton()
        self._segments = re.compile(self.pattern)
        # the next shorter usable piece that a piece begins with
        self._shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.whole), None) for p in self.usable}
        self._pairs: dict[tuple[str, str], bool] = {}
        model = self

        class Memo(dict):
            def __missing__(self, segment: str) -> bytes:
                value = model._packed(segment)
                if len(segment) <= MEMO_CHARS:
                    if len(self) >= MEMO_ENTRIES:
                        self.clear()
                    self[segment] = value
                return value

        self._memo = Memo()
        self._surface = [p.replace(SPACE, " ").encode() if k == "normal" else bytes([int(p[3:5], 16)]) if k == "byte"
                         else " ⁇ ".encode() if k == "unknown" else b"" for p, k in zip(self.pieces, self.kinds)]
        self._ready = True

    def _compatible(self, a: str, b: str) -> bool:
        if len(self._pairs) >= MEMO_ENTRIES:
            self._pairs.clear()
        fits = self._pairs[a, b] = merge(a + b, self.rank) == [a, b]
        return fits

    def _backtrack(self, text: str) -> list[str]:
        """Pieces of a text whose characters all are pieces."""
        if text in self.whole:  # the longest match is all of it
            return [text]
        longest: list[str | None] = [None] * len(text)
        for end, piece in self._automaton.iter(text):
            longest[end + 1 - len(piece)] = piece  # ends rise, so the longest comes last
        failed = bytearray(len(text) // 8 + 1)  # bitfield of positions from which no encoding goes on
        pairs, shorter, path, last, at, piece = self._pairs, self._shorter, [], None, 0, longest[0]
        while True:
            while piece is not None:
                to = at + len(piece)
                if not failed[to >> 3] >> (to & 7) & 1:
                    fits = last is None or pairs.get((last, piece))
                    if fits is None:
                        fits = self._compatible(last, piece)
                    if fits:
                        break
                piece = shorter.get(piece)
            if piece is None:
                failed[at >> 3] |= 1 << (at & 7)
                piece = path.pop()
                at -= len(piece)
                last = path[-1] if path else None
                piece = shorter.get(piece)
                continue
            path.append(piece)
            if to == len(text):
                return path
            last, at, piece = piece, to, longest[to]

    def _packed(self, segment: str) -> bytes:
        text, out, k = segment.replace(" ", SPACE), array("I"), 0
        if self.alphabet.issuperset(text):
            return np.array([self.ids[p] for p in self._backtrack(text)], "<u4").tobytes()
        while k < len(text):
            j = k
            while j < len(text) and text[j] in self.alphabet:
                j += 1
            if j > k:
                out.extend(map(self.ids.__getitem__, self._backtrack(text[k:j])))
            else:
                j = k + 1
                codes = [self.byte_ids[b] for b in text[k].encode()]
                out.extend(codes if None not in codes else [self.unknown])
            k = j
        return np.frombuffer(out, dtype=np.uintc).astype("<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids with begin and end, as little-endian unsigned 32-bit integers."""
        if not self._ready:
            self._build()
        text = text or ""
        if text and self.dummy_prefix:
            text = " " + text
        if len(text) <= LONG_TEXT:
            inner = b"".join(map(self._memo.__getitem__, self._segments.findall(text)))
        else:  # without a list of all segments
            found, parts = self._segments.finditer(text), []
            while part := b"".join(self._memo[m.group()] for m in islice(found, 1 << 16)):
                parts.append(part)
            inner = b"".join(parts)
        return self.begin.to_bytes(4, "little") + inner + self.end.to_bytes(4, "little")

    def decode(self, ids: bytes | Sequence[int]) -> str:
        """Text of ids: begin and end vanish, the dummy space goes, bytes that are no UTF-8 become U+FFFD each."""
        if not self._ready:
            self._build()
        codes = np.frombuffer(ids, "<u4").tolist() if isinstance(ids, bytes) else list(ids)
        low, high = 0, len(codes)
        while low < high and codes[low] in self.control:
            low += 1
        while high > low and codes[high - 1] in self.control:
            high -= 1
        codes = codes[low:high]
        if not self.control.isdisjoint(codes):  # bytes on either side of one make no character
            runs = [[]]
            for c in codes:
                runs[-1].append(c) if c not in self.control else runs.append([])
            return self._text(runs[0], True) + "".join(self._text(r, False) for r in runs[1:])
        return self._text(codes, True)

    def _text(self, codes: list[int], first: bool) -> str:
        raw = b"".join(map(self._surface.__getitem__, codes))
        if first and self.dummy_prefix and codes and self.kinds[codes[0]] == "normal" and raw.startswith(b" "):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return "".join(_lenient(raw))


def _lenient(raw: bytes) -> Iterator[str]:
    at = 0
    while at < len(raw):
        try:
            yield raw[at:].decode()
            return
        except UnicodeDecodeError as e:
            yield raw[at:at + e.start].decode()
            yield "�"
            at += e.start + 1


def encode(docs: DataFrame, model: PieceModel, text_col: str = "text") -> DataFrame:
    """The columns of docs but the text, and `ids`: begin, the text's ids, end, as packed 32-bit integers."""
    others = [c for c in docs.columns if c not in (text_col, "ids")]
    plain = docs.select(*others, F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = model.here()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = pa.array((here.encode(t.as_py()) for t in part.column(len(others))), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], [*others, "ids"])

    schema = plain.select(*others, F.lit(b"").alias("ids")).schema
    return plain.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: PieceModel, text_col: str = "text") -> DataFrame:
    """Append the text of `ids`; NULL ids decode to NULL."""
    others = [c for c in encoded.columns if c != text_col]
    at = others.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = model.here()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = pa.array((here.decode(i.as_py()) if i.is_valid else None for i in part.column(at)), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*others, text_col])

    rows = encoded.select(*others)
    return rows.mapInArrow(run, rows.select("*", F.lit("").alias(text_col)).schema)


def given_model(name: str = "piece_bpe_32k.model") -> PieceModel:
    import public_tokenizers

    return PieceModel.load(public_tokenizers.path(name))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    model = given_model()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = decode(encode(docs, model), model)
    return texts.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: doc_id, source, n_tokens and the ids of every row."""
    rows = encode(docs.select("doc_id", "source", "text"), given_model())
    return rows.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("bigint"))
