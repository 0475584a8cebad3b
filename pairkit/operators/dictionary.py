"""Dictionaries and corpora built from pair tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairkit.functions import text as tx


def sides(pairs: DataFrame) -> DataFrame:
    """Two rows per pair, one per text: (row_no, side, qid, text)."""
    return pairs.selectExpr(
        "row_no", "stack(2, 1, qid1, question1, 2, qid2, question2) as (side, qid, text)")


def question_dictionary(pairs: DataFrame) -> DataFrame:
    """One text per qid: that of its first row, the left side first within a row.

    Copies of an id collapse before the shuffle, so a frequent id stays cheap.
    """
    first = F.min_by("text", F.struct("row_no", "side"))
    return sides(pairs).groupBy("qid").agg(first.alias("text")).orderBy("qid")


def unique_texts(pairs: DataFrame) -> DataFrame:
    """Distinct stripped texts in alphabetical order."""
    both = pairs.selectExpr("stack(2, question1, question2) as text")
    return both.select(tx.strip("text").alias("text")).distinct().orderBy("text")


def corpus(pairs: DataFrame) -> DataFrame:
    """Every text of every pair, with repeats."""
    return pairs.selectExpr("stack(2, question1, question2) as text")


def text_key(text) -> Column:
    """128-bit key of a text: narrow to shuffle, and distinct for distinct texts."""
    return F.md5(tx._col(text))


def distinct_texts(texts: DataFrame) -> DataFrame:
    """(text_id, text, n): each distinct text once, with its number of repeats. A column `n` of
    `texts`, if there is one, says how often each row counts.

    Repeats are combined before the shuffle. The result is partitioned by text_id,
    which later groupings by text_id reuse.
    """
    times = F.col("n") if "n" in texts.columns else F.lit(1).cast("bigint")
    return (texts.select(text_key("text").alias("text_id"), "text", times.alias("n"))
            .groupBy("text_id").agg(F.min("text").alias("text"), F.sum("n").alias("n")))


def new_texts_only(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct requested texts that have no vector yet.

    The join compares text keys, so neither side shuffles whole vectors or texts twice.
    """
    have = known.select(text_key("text").alias("text_id")).distinct()
    return distinct_texts(texts).join(have, "text_id", "left_anti").select("text")
