"""Language identification by interpolated Kneser-Ney character models.

A model for each language gives the probability of each character of a word, after up to four
characters before it within the word (which begins and ends with a space). Words are maximal
runs of letters, lower-cased; other characters say nothing about a language. Counts and
contexts are kept as arrays sorted by the n-gram's hash and looked up by binary search, whole
batches of words at a time. A text goes to the language with the lowest cross-entropy per
character, over the whole text; ties go to the smaller name.

Training is fitted on a sample: from the training rows of each language those with the smallest
hashes of id and text, about `rows_per_language` of them, whole texts. Every fifth distinct text of a
language's sample is held back to calibrate rejection: a text is rejected when its cross-entropy
under its best language lies above the mean of held-back texts by more than a number of standard
deviations, with the deviation widened for short texts, as the mean over n characters varies with
1/sqrt(n). The number of deviations follows from `FALSE_REJECTIONS`, the share of the languages' own
texts that may be rejected: it is the distance that only this share of all held-back texts exceeds,
and never more than the one-sided Vysochanskij-Petunin bound gives for any distribution of one peak.
A model of little text is nearly uniform, so noise goes to it and it must not set its own bound: a
language with fewer than `ENOUGH_HELD` held-back texts has the figures of the language that varies
least, or those of all held-back texts where every language has so few.

Defined results: a NULL text, or one without a letter, is `und` with score 0 and is rejected;
without any training row every text is; where no text at all is held back (no language has five),
those are that no model tells better than drawing letters evenly; rows may repeat; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairkit.llm.sampling import bounded_sample

ORDER = 5
WORD = re.compile(r"[^\W\d_]+")
MEMO_WORDS = 200_000
MEMO_CHARS = 4_000_000
LONG_TEXT = 1 << 20
PIECE_CHARS = 1 << 16
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
UNDETERMINED = "und"
HELD_EVERY = 5
ENOUGH_HELD = 10
FALSE_REJECTIONS = 0.002
# no text is taken to vary less than one of so many characters
STEADY_CHARS = 1000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For n = 0..ORDER the hash of the n characters that end at each position (0 where the word has fewer),
    the characters that exist before it, and each position's word. Positions are a word's letters and its end."""
    joined = " " + " ".join(words) + " "
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    space = codes == 32
    word = np.cumsum(space) - 1
    begin = np.flatnonzero(space)[word]  # of each position the space before its word; a space itself begins one
    at = np.arange(len(codes))
    # a space ends the word before it: what it can see reaches back to that word's begin
    seen = np.where(space, 0, at - begin)
    ends = np.flatnonzero(space)[1:]
    seen[ends] = np.diff(np.flatnonzero(space))
    hashes, grown = [], np.zeros(len(codes), np.uint64)
    for n in range(ORDER + 1):
        hashes.append(np.where(seen + 1 >= n, grown, np.uint64(0)))
        if n < ORDER:
            back = np.zeros(len(codes), np.uint64)
            back[n:] = codes[:max(0, len(codes) - n)]
            grown = mix(grown * MULTIPLIER + back + np.uint64(n + 1))
    keep = at > 0
    owner = np.where(space, word - 1, word)
    return [h[keep] for h in hashes], seen[keep], owner[keep]


def one_peak(share: float) -> float:
    """Deviations above the mean that at most this share, up to a sixth, of any distribution of one peak exceeds."""
    return float(np.sqrt(4 / (9 * share) - 1))


def figures(bits: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Mean over characters, and the deviation of a text's mean times the root of its length."""
    mean = np.average(bits, weights=n)
    return float(mean), float(np.sqrt(np.mean((bits - mean) ** 2 * np.minimum(n, STEADY_CHARS))))


@dataclass
class SortedTable:
    """Values by hash, in arrays sorted by the hash."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def counted(cls, hashes: np.ndarray, weights: np.ndarray) -> SortedTable:
        order = np.argsort(hashes, kind="stable")
        keys, first = np.unique(hashes[order], return_index=True)
        return cls(keys, np.add.reduceat(weights[order], first) if len(keys) else np.zeros(0))

    def get(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.values[at], 0.0)


class CharModel:
    """Interpolated Kneser-Ney: the highest order counts grams, lower ones the characters seen before a gram."""

    def __init__(self, words: Counter, alphabet: int):
        names = sorted(words)
        hashes, seen, owner = gram_hashes(names)
        weight = np.array([words[w] for w in names], dtype=np.float64)[owner]
        self.alphabet = alphabet
        self.grams, self.totals, self.kinds, self.discounts = [], [], [], []
        for n in range(1, ORDER + 1):
            full = seen + 1 >= n  # the position has n characters up to it, the begin's space included
            gram = hashes[n][full]
            # a context is the gram without its last character: it ends one position earlier
            context = self.contexts(hashes, n)[full]
            if n == ORDER:
                value = weight[full]
            else:
                longer = seen + 1 > n  # what stands before the gram, once each; at a word's begin nothing does
                pairs, first = np.unique(hashes[n + 1][longer], return_index=True)
                begins = (seen + 1 == n)
                gram = np.concatenate([hashes[n][longer][first], hashes[n][begins]])
                context = np.concatenate([self.contexts(hashes, n)[longer][first], self.contexts(hashes, n)[begins]])
                value = np.concatenate([np.ones(len(first)), weight[begins]])
            table = SortedTable.counted(gram, value)
            once, twice = (table.values == 1).sum(), (table.values == 2).sum()
            self.discounts.append(float(once / (once + 2 * twice)) if once and twice else 0.5)
            self.grams.append(table)
            self.totals.append(SortedTable.counted(context, value))
            heads, at = np.unique(gram, return_index=True)
            self.kinds.append(SortedTable.counted(context[at], np.ones(len(heads))))

    @staticmethod
    def contexts(hashes: list[np.ndarray], n: int) -> np.ndarray:
        """Hash of the n-1 characters before each position; positions follow one another, word by word."""
        return shifted(hashes[n - 1], hashes[1][-1] if n == 2 and len(hashes[1]) else 0)


def shifted(values: np.ndarray, first) -> np.ndarray:
    """Each position's predecessor; before the first word's first letter stands a space, as the last position is one."""
    before = np.empty_like(values)
    before[1:] = values[:-1]
    before[:1] = first
    return before


class LanguageModels:
    """Models of all languages: per order one sorted hash array, with a row of values for all languages, and the calibration.

    A gram's row also says how often it is a context, so one search per order and position serves both.
    """

    def __init__(self, texts: dict[str, list[str]]):
        counts = {lang: Counter(w for t in rows for w in WORD.findall(t.lower())) for lang, rows in texts.items()}
        self.languages = sorted(lang for lang, c in counts.items() if c)
        self.alphabet = len({c for lang in self.languages for w in counts[lang] for c in w}) + 2
        models = [CharModel(counts[lang], self.alphabet) for lang in self.languages]
        column = lambda tables, keys: np.stack([t.get(keys) for t in tables], axis=1)
        zero = lambda m: np.concatenate([m, np.zeros((1, m.shape[1]))]).astype(np.float32)  # noqa: E731  of unknown grams
        self.keys, self.above, self.total, self.rest = [], [], [], []
        for n in range(ORDER if models else 0):
            keys = np.unique(np.concatenate([m.grams[n].keys for m in models]))
            self.keys.append(keys)
            self.above.append(zero(np.maximum(column([m.grams[n] for m in models], keys) - [m.discounts[n] for m in models], 0)))
            # as contexts of the next order; the empty context, of the first, is kept apart
            if n + 1 < ORDER:
                self.total.append(zero(column([m.totals[n + 1] for m in models], keys)))
                self.rest.append(zero(column([m.kinds[n + 1] for m in models], keys) * [m.discounts[n + 1] for m in models]))
        empty = np.zeros(1, np.uint64)
        if models:
            self.first_total = column([m.totals[0] for m in models], empty)
            self.first_rest = column([m.kinds[0] for m in models], empty) * [m.discounts[0] for m in models]
        # until calibrated, and without any held-back text: as good as drawing letters evenly
        self.mean = np.full(len(self.languages), np.log2(max(self.alphabet, 2)))
        self.deviation = np.zeros(len(self.languages))
        self.reject_at = one_peak(FALSE_REJECTIONS)

    def calibrate(self, texts: dict[str, list[str]]) -> None:
        """Mean over characters of held-back texts, the deviation of a text's mean times the root of its
        length, and the deviations above the mean from which on a text is rejected."""
        scorer = Scorer(self)
        found = {}
        for i, lang in enumerate(self.languages):
            scored = [(e[i], n) for e, n in map(scorer.entropies, texts.get(lang, [])) if n]
            if scored:
                found[i] = np.array([s[0] for s in scored]), np.array([s[1] for s in scored], dtype=np.float64)
        if not found:
            return
        own = {i: figures(*f) for i, f in found.items() if len(f[0]) >= ENOUGH_HELD}
        used = {i: found[i] for i in own} or found
        if own:
            self.mean[:], self.deviation[:] = min(own.values(), key=lambda f: f[::-1])
        else:
            self.mean[:], self.deviation[:] = figures(*(np.concatenate(part) for part in zip(*used.values())))
        for i, f in own.items():
            self.mean[i], self.deviation[i] = f
        away = np.sort(np.concatenate([(bits - self.mean[i]) * np.sqrt(np.minimum(n, STEADY_CHARS)) / max(self.deviation[i], 1e-9)
                                       for i, (bits, n) in used.items()]))
        # the next text exceeds the k-th smallest of m with chance 1 - k / (m + 1)
        k = int(np.ceil((len(away) + 1) * (1 - FALSE_REJECTIONS)))
        if k <= len(away):
            self.reject_at = min(self.reject_at, max(float(away[k - 1]), 0.0))

    def position_bits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each position under each language, and each position's word."""
        hashes, seen, owner = gram_hashes(words)
        p, row = None, None
        for n in range(1, ORDER + 1):
            keys, last = self.keys[n - 1], row
            row = np.minimum(np.searchsorted(keys, hashes[n]), len(keys) - 1)
            row = np.where((keys[row] == hashes[n]) & (seen + 1 >= n), row, len(keys))
            above = self.above[n - 1][row]
            if n == 1:
                p = (above + self.first_rest / self.alphabet) / np.maximum(self.first_total, 1)
                continue
            context = shifted(last, last[-1] if n == 2 else len(self.keys[n - 2]))
            if n > 2:  # it must lie in the word, after the begin's space
                context = np.where(seen + 1 >= n, context, len(self.keys[n - 2]))
            total = self.total[n - 2][context]
            finer = (above + self.rest[n - 2][context] * p) / np.maximum(total, 1e-9)
            p = np.where(total > 0, finer, p)
        return -np.log2(np.maximum(p, 1e-12)), owner

    def word_bits(self, words: list[str]) -> np.ndarray:
        bits, owner = self.position_bits(words)
        return np.stack([np.bincount(owner, bits[:, i], len(words)) for i in range(bits.shape[1])], axis=1)


class Scorer:
    """Cross-entropies of texts, with the bits of words it has met in a bounded table."""

    def __init__(self, models: LanguageModels):
        self.models = models
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.bits = np.zeros((0, len(self.models.languages)))
        self.chars = 0

    def _lookup(self, words: list[str]) -> np.ndarray:
        rows = self.rows
        known = list(map(rows.get, words))
        if None in known:
            new = [w for w in dict.fromkeys(words) if w not in rows]
            part, size, found = [], 0, [self.bits]
            for w in new:  # numpy gets a bounded number of characters at once
                part.append(w)
                size += len(w) + 1
                if size > PIECE_CHARS:
                    found.append(self.models.word_bits(part))
                    part, size = [], 0
            if part:
                found.append(self.models.word_bits(part))
            rows.update(zip(new, range(len(rows), len(rows) + len(new))))
            self.chars += sum(map(len, new))
            self.bits = np.concatenate(found)
            known = list(map(rows.__getitem__, words))
        return self.bits[known]

    def prepare(self, texts: list[str]) -> None:
        """Meets the words of many texts at once."""
        if len(self.rows) > MEMO_WORDS or self.chars > MEMO_CHARS:
            self.clear()
        if self.models.languages:
            self._lookup([w for t in texts if len(t) <= LONG_TEXT for w in WORD.findall(t.lower())])

    def entropies(self, text: str) -> tuple[np.ndarray, int]:
        """Bits per character under each language, and the characters: letters and ends of words."""
        total, n, lowered = np.zeros(len(self.models.languages)), 0, text.lower()
        long = len(text) > LONG_TEXT
        found = WORD.finditer(lowered) if long else None
        while words := [m.group() for m in islice(found, 1 << 16)] if long else WORD.findall(lowered):
            if len(self.rows) > MEMO_WORDS or self.chars > MEMO_CHARS:
                self.clear()
            total += self._lookup(words).sum(axis=0)
            n += sum(map(len, words)) + len(words)
            if not long:
                break
        return (total / n if n else total), n

    def judge(self, text: str | None, reject_at: float | None = None) -> tuple[str, float, float | None, bool]:
        """Language, score (its share among all languages, bits per character as exponents), bits per character, rejected.

        `reject_at` deviations in place of those the calibration found.
        """
        models = self.models
        if text is None or not models.languages or not WORD.search(text):
            return UNDETERMINED, 0.0, None, True
        bits, n = self.entropies(text)
        best = int(np.argmin(bits))
        share = np.exp2(-4.0 * (bits - bits[best]))
        slack = (models.reject_at if reject_at is None else reject_at) * models.deviation[best] / np.sqrt(min(n, STEADY_CHARS))
        return models.languages[best], float(1.0 / share.sum()), float(bits[best]), bool(bits[best] > models.mean[best] + slack)


def train(docs: DataFrame, learnable: Column, rows_per_language: int = 1000, text_col: str = "text", lang_col: str = "lang",
          id_col: str = "doc_id") -> LanguageModels:
    rows = docs.filter(learnable & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    chosen = bounded_sample(rows, lang_col, [id_col, text_col], rows_per_language)
    sample = chosen.select(lang_col, text_col, "place").collect()
    sample.sort(key=lambda r: (r["place"], r[text_col]))
    fit: dict[str, list[str]] = {}
    held: dict[str, list[str]] = {}
    sides: dict[str, dict[str, dict]] = {}  # copies of a text are on one side, else they would calibrate on what was learned
    for r in sample:
        side = sides.setdefault(r[lang_col], {})
        part = side.setdefault(r[text_col], held if len(side) % HELD_EVERY == HELD_EVERY - 1 else fit)
        part.setdefault(r[lang_col], []).append(r[text_col])
    models = LanguageModels(fit)
    models.calibrate(held)
    return models


JUDGED = ("lang_pred", "score", "bits_per_char", "lang_rejected")


def judged(docs: DataFrame, models: LanguageModels, text_col: str = "text", reject_at: float | None = None) -> DataFrame:
    """Append the struct `__language` of lang_pred, score, bits_per_char and lang_rejected; of the row only the text is read."""
    spread = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample

    @F.pandas_udf("lang_pred string, score double, bits_per_char double, lang_rejected boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(spread.value)
        for batch in batches:
            rows = []
            for k in range(0, len(batch), 256):
                part = list(batch.iloc[k:k + 256])
                scorer.prepare([t for t in part if t is not None])
                rows += [scorer.judge(t, reject_at) for t in part]
            yield pd.DataFrame(rows, columns=list(JUDGED))

    return docs.withColumn("__language", judge(F.col(text_col)))


def identify(docs: DataFrame, models: LanguageModels, text_col: str = "text", reject_at: float | None = None) -> DataFrame:
    """Append lang_pred, score, bits_per_char and lang_rejected; columns of docs with these names are replaced."""
    rows = judged(docs, models, text_col, reject_at)
    return rows.withColumns({c: F.col(f"__language.{c}") for c in JUDGED}).drop("__language")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from three quarters of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = train(docs, ~held_out())
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, models).select("doc_id", "held_out", "lang_pred", "score", "bits_per_char",
                                         F.col("lang_rejected").alias("rejected"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is rejected go; columns of docs."""
    return judged(docs, train(docs, ~held_out())).filter(~F.col("__language.lang_rejected")).select(*docs.columns)
