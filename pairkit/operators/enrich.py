"""Batch enrichment: user-supplied encoders and scorers run inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pairkit.functions import vectors as vx

Encoder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[str], list[str]], tuple[np.ndarray, np.ndarray | None]]


def _chunks(frames: Iterator[pd.DataFrame], batch: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for start in range(0, len(frame), batch):
            yield frame.iloc[start:start + batch]


def hashing_encoder(dim: int = 64) -> Encoder:
    """Offline encoder: signed hashing of word tokens, scaled to unit length."""
    import re
    import zlib

    split, floor = re.compile(r"\W+"), vx.EPS

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, text in enumerate(texts):
            for token in split.split(text.lower()):
                if token:
                    h = zlib.crc32(token.encode())
                    out[i, (h >> 1) % dim] += 1.0 if h & 1 else -1.0
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(lengths, floor)

    return encode


def overlap_scorer(q1: list[str], q2: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Offline scorer: share of common tokens, and (shared, left, right) counts."""
    feats = np.zeros((len(q1), 3), dtype=np.float32)
    for i, (a, b) in enumerate(zip(q1, q2)):
        x, y = set(a.lower().split()), set(b.lower().split())
        feats[i] = len(x & y), len(x), len(y)
    union = feats[:, 1] + feats[:, 2] - feats[:, 0]
    return np.where(union > 0, feats[:, 0] / np.maximum(union, 1), 0.0), feats


def embed_texts(df: DataFrame, encoder: Encoder, key: str = "qid", batch: int = 128) -> DataFrame:
    """(key, text, embedding): one encoder call per `batch` rows, in parallel tasks.

    Give each text once; see `unique_texts` and `question_dictionary`.
    """
    keep = [key] if key == "text" else [key, "text"]
    kinds = dict(df.dtypes)

    def run(frames):
        for chunk in _chunks(frames, batch):
            matrix = np.asarray(encoder(chunk["text"].tolist()), dtype=np.float32)
            yield chunk.assign(embedding=list(matrix))

    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", embedding array<float>"
    return df.select(*keep).mapInPandas(run, schema)


def score_pairs(df: DataFrame, scorer: Scorer, batch: int = 256) -> DataFrame:
    """(index, qid1, qid2, score, features) of (index, qid1, qid2, question1, question2).

    The score is the scorer's first result and NaN where that is None.
    """
    def run(frames):
        for chunk in _chunks(frames, batch):
            score, feats = scorer(chunk["question1"].tolist(), chunk["question2"].tolist())
            size = len(chunk)
            yield chunk[["index", "qid1", "qid2"]].assign(
                score=np.full(size, np.nan, np.float32) if score is None
                else np.asarray(score, dtype=np.float32),
                features=[None] * size if feats is None
                else list(np.asarray(feats, dtype=np.float32)))

    columns = df.select("index", "qid1", "qid2", "question1", "question2")
    scored = columns.mapInPandas(
        run, "index bigint, qid1 bigint, qid2 bigint, score float, features array<float>")
    # Arrow turns NaN into NULL on the way.
    return scored.withColumn("score", F.coalesce("score", F.lit(float("nan")).cast("float")))


def add_norm(vectors: DataFrame) -> DataFrame:
    """Vector table with its lengths: computed once per vector, before any pair join."""
    return vectors.withColumn("norm", vx.norm("embedding"))


def count_rows(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: how many rows there are, and how many meet each condition.

    Only the columns the conditions need are read. (An Observation would count during
    another job, but one in a session keeps Spark from shipping some ML models.)
    """
    return df.agg(F.count(F.lit(1)).alias("done"),
                  *[F.count_if(cond).alias(key) for key, cond in conditions.items()])
