"""Tokenizers and per-pair text features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words whose presence at the start of a text becomes an indicator.
STARTERS = (
    "are", "can", "could", "did", "do", "does", "has", "have", "how", "if", "is",
    "what", "when", "where", "which", "who", "whom", "whose", "why", "will", "would",
)
# Characters counted as mathematical symbols.
MATH_SYMBOLS = "+-*/=^%<>"
# Unicode white space, as a set of characters and as a regular expression.
SPACES = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SPACE_RUN = r"[\x09-\x0D\x1C-\x20\x85\p{Z}]+"
# Anything but letters, numbers and the underscore.
NON_WORD_RUN = r"[^\p{L}\p{N}_]+"

MAX_NGRAM = 6


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _non_empty(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t != "")


def whitespace_tokens(text) -> Column:
    """Lower-cased tokens between white space; punctuation stays attached."""
    return _non_empty(F.split(F.lower(_col(text)), SPACE_RUN))


def word_tokens(text) -> Column:
    """Lower-cased runs of letters, numbers and underscores."""
    return _non_empty(F.split(F.lower(_col(text)), NON_WORD_RUN))


def topic_tokens(text) -> Column:
    """Word tokens of at least two characters."""
    return F.filter(F.split(F.lower(_col(text)), NON_WORD_RUN), lambda t: F.length(t) >= 2)


def strip(text) -> Column:
    return F.trim(_col(text), F.lit(SPACES))


def safe_div(a, b) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(_col(a).cast("double"), _col(b).cast("double")), F.lit(0.0))


def _all_groups(line: Column, pattern: str) -> Column:
    """Every capture of a pattern: one compiled pass, without a lambda per element."""
    return F.regexp_extract_all(line, F.lit(pattern), F.lit(1))


def _grams_of_line(line: Column, patterns: list[str], empty: str) -> Column:
    """All captures of all patterns; none for a line equal to `empty`.

    The line is a lambda argument, so it is made once and not once per pattern.
    """
    filled = F.filter(F.array(line), lambda x: x != empty)
    return F.flatten(F.transform(filled, lambda x: F.flatten(F.array(*[_all_groups(x, p) for p in patterns]))))


def joined_tokens(tokens) -> Column:
    """Tokens in one line, the form `line_ngrams` reads."""
    return F.array_join(_col(tokens), " ")


def line_ngrams(line, n: int) -> Column:
    """All runs of n space-separated tokens of a line; empty when there are fewer."""
    run = r"[^ ]+" + r" [^ ]+" * (n - 1)
    # From each token start, look ahead over n tokens, then step over one.
    return _all_groups(_col(line), rf"(?<![^ ])(?=({run})(?![^ ]))[^ ]+")


def word_ngrams(tokens, n: int) -> Column:
    """All runs of n tokens, each joined by one space; empty when there are fewer."""
    return _col(tokens) if n == 1 else line_ngrams(joined_tokens(tokens), n)


def char_word_grams(text, low: int = 1, high: int = 8) -> Column:
    """Character n-grams inside space-padded words.

    A padded word no longer than n is taken whole, once, and larger n are skipped.
    """
    words = whitespace_tokens(text)
    # Each word keeps its own two spaces, so a gram inside one word never has two in a row.
    line = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))

    def pattern(n):
        if n == 1:
            return r"(?s)(.)"
        forms = [rf"[^ ]{{{n}}}", rf" [^ ]{{{n - 1}}}", rf"[^ ]{{{n - 1}}} "]
        if n > 2:
            forms.append(rf" [^ ]{{{n - 2}}} ")
        if n == low and low > 3:
            forms.append(rf" [^ ]{{1,{low - 3}}} ")
        return rf"(?=({'|'.join(forms)}))."

    return _grams_of_line(line, [pattern(n) for n in range(low, high + 1)], empty="  ")


def grams_of_word(word: str, low: int, high: int) -> list[str]:
    """Those of `char_word_grams` that one word gives."""
    padded = f" {word} "
    size = len(padded)
    if size < low:
        return [padded]
    return [padded[i:i + n] for n in range(low, min(high, size) + 1) for i in range(size - n + 1)]


def char_grams(text, low: int = 1, high: int = 8) -> Column:
    """Character n-grams over the whole text, runs of white space made one space."""
    line = F.regexp_replace(F.lower(_col(text)), SPACE_RUN[:-1] + "{2,}", " ")
    return _grams_of_line(line, [rf"(?s)(?=(.{{{n}}}))." for n in range(low, high + 1)], empty="")


def count_matching(text, char_class: str) -> Column:
    """How many characters belong to a regular-expression class."""
    return F.length(F.regexp_replace(_col(text), f"[^{char_class}]+", ""))


def count_any(text, chars: str) -> Column:
    """How many characters are one of `chars`."""
    text = _col(text)
    return F.length(text) - F.length(F.translate(text, chars, ""))


def is_question(text) -> Column:
    """Whether the text, white space at the end aside, ends with a question mark."""
    return F.endswith(F.rtrim(_col(text), F.lit(SPACES)), F.lit("?"))
