"""Jaccard of the word n-gram sets of two token arrays, by numbers of tokens and runs."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from pairkit.functions import text as tx

NAMES = tuple(f"ngram_{n}_jaccard" for n in range(1, tx.MAX_NGRAM + 1))
# Pairs whose tokens a task numbers at a time.
AT_ONCE = 256


def jaccards(left: np.ndarray, right: np.ndarray) -> list[float]:
    """The values of `NAMES` for two texts given as numbers of their tokens; 0 where neither has a run."""
    tokens = max(left.max(initial=0), right.max(initial=0)) + 1
    runs, out = [left, right], []
    for n in range(1, tx.MAX_NGRAM + 1):
        if n > 1:
            # A run is the run before it and one more token.
            runs = [r[:max(len(t) - n + 1, 0)] * tokens + t[n - 1:] for r, t in zip(runs, (left, right))]
        distinct, numbers = np.unique(np.concatenate(runs), return_inverse=True)
        runs = [numbers[:len(runs[0])], numbers[len(runs[0]):]]
        has = np.zeros((2, len(distinct)), bool)
        for side, found in zip(has, runs):
            side[found] = True
        out.append(float(has.all(axis=0).sum() / len(distinct)) if len(distinct) else 0.0)
    return out


def _numbered(columns: list[pa.Array]) -> list[list[np.ndarray]]:
    """Numbers of the tokens of each text, the same for both columns."""
    flat = [c.flatten() for c in columns]
    numbers = pa.concat_arrays(flat).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    parts = np.split(numbers, [len(flat[0])])
    return [np.split(part, list(accumulate(pc.list_value_length(c).fill_null(0).to_pylist()))[:-1]) for c, part in zip(columns, parts)]


def ngram_struct(tokens1, tokens2) -> Column:
    """One Arrow UDF call that returns the values of `NAMES`, all 0 for a pair with a null array."""
    @F.arrow_udf(", ".join(f"{n} double" for n in NAMES))
    def kernel(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = []
        for at in range(0, len(a), AT_ONCE):
            part = [a.slice(at, AT_ONCE), b.slice(at, AT_ONCE)]
            filled = pc.and_(part[0].is_valid(), part[1].is_valid()).to_pylist()
            rows += [jaccards(x, y) if both else [0.0] * len(NAMES) for x, y, both in zip(*_numbered(part), filled)]
        columns = zip(*rows) if rows else [[] for _ in NAMES]
        return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns], list(NAMES))

    return kernel(tx._col(tokens1), tx._col(tokens2))
