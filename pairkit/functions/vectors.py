"""Similarity functions of two numeric arrays.

Two kernels give the same columns. The native one uses higher-order functions and
stays in the JVM; it visits every element once, whatever the number of prefixes.
The Arrow one hands whole batches to numpy and pays off for long vectors.

Both compare the first min(size, length of u, length of v) elements, so rows may differ in
length. No elements give zeros. A NULL vector, or a NULL among the elements compared, gives
NULLs for that prefix size.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Default prefix sizes, zero guard.
DEFAULT_DIMS = (128, 256, 512, 1024, 1536, 2048, 2560)
EPS = 1e-12

STATS = ("cos_sim", "dot_raw", "euclidean", "manhattan", "abs_diff_mean",
         "abs_diff_max", "abs_diff_std", "prod_mean", "prod_std")
BRIDGE = ("cos_sim", "l2_dist", "dot_raw", "norm_diff", "prod_mean", "diff_mean")

# Above this length numpy batches beat interpreted lambdas.
NATIVE_MAX_DIM = 128


def _dbl(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def total(v) -> Column:
    return F.aggregate(_dbl(v), F.lit(0.0), lambda acc, x: acc + x)


def total_sq(v) -> Column:
    return F.aggregate(_dbl(v), F.lit(0.0),
                       lambda acc, x: acc + x.cast("double") * x.cast("double"))


def products(u, v) -> Column:
    return F.zip_with(_dbl(u), _dbl(v), lambda x, y: x.cast("double") * y.cast("double"))


def abs_diffs(u, v) -> Column:
    return F.zip_with(_dbl(u), _dbl(v), lambda x, y: F.abs(x.cast("double") - y.cast("double")))


def norm(v) -> Column:
    """Euclidean length."""
    return F.sqrt(total_sq(v))


def dot(u, v) -> Column:
    return total(products(u, v))


def cosine(u, v, norm_u=None, norm_v=None) -> Column:
    """Cosine, 0 when a side has no length; pass norms that are already known."""
    nu = norm(u) if norm_u is None else _dbl(norm_u)
    nv = norm(v) if norm_v is None else _dbl(norm_v)
    floor = F.lit(EPS)
    return dot(u, v) / (F.greatest(nu, floor) * F.greatest(nv, floor))


def _population_std(shifted: Column, shifted_sq: Column, n) -> Column:
    """From sums of differences to a value of the same row, so that large means do not cancel digits."""
    mean = shifted / n
    return F.sqrt(F.greatest(shifted_sq / n - mean * mean, F.lit(0.0)))


def hellinger_similarity(p, q) -> Column:
    """1 - Hellinger distance of two non-negative arrays, each scaled to sum 1."""
    p, q = _dbl(p), _dbl(q)
    sp = F.greatest(total(p), F.lit(EPS))
    sq = F.greatest(total(q), F.lit(EPS))
    gaps = F.zip_with(p, q, lambda x, y: F.sqrt(F.greatest(x / sp, F.lit(0.0)))
                      - F.sqrt(F.greatest(y / sq, F.lit(0.0))))
    return F.lit(1.0) - norm(gaps) / F.sqrt(F.lit(2.0))


def resolve_dims(length: int, dims: Sequence[int] | None = None) -> list[int]:
    """Prefix sizes that fit a vector of `length`, its full length included."""
    wanted = DEFAULT_DIMS if dims is None else dims
    fitted = [min(int(d), length) for d in wanted if int(d) > 0]
    return list(dict.fromkeys([*fitted, length]))


# Scratch columns of the native kernel; dropped before a frame is returned.
_MOMENTS = "__moments"


_SUMS = ("uu", "vv", "uv", "l1", "sq", "top", "g1", "g2", "p1", "p2", "missing")


def _segment_moments(u: Column, v: Column, start: int, size: int) -> Column:
    """Sums over one stretch of both vectors that every statistic is made of."""
    gap0 = F.coalesce(F.abs(F.get(u, F.lit(0)).cast("double") - F.get(v, F.lit(0)).cast("double")), F.lit(0.0))
    prod0 = F.coalesce(F.get(u, F.lit(0)).cast("double") * F.get(v, F.lit(0)).cast("double"), F.lit(0.0))

    def step(acc, x):
        gap = F.abs(x.a - x.b)
        prod = x.a * x.b
        g, p = gap - gap0, prod - prod0
        return F.struct(
            (acc.uu + x.a * x.a).alias("uu"), (acc.vv + x.b * x.b).alias("vv"),
            (acc.uv + prod).alias("uv"), (acc.l1 + gap).alias("l1"),
            (acc.sq + gap * gap).alias("sq"), F.greatest(acc.top, gap).alias("top"),
            (acc.g1 + g).alias("g1"), (acc.g2 + g * g).alias("g2"),
            (acc.p1 + p).alias("p1"), (acc.p2 + p * p).alias("p2"), (acc.missing + x.missing).alias("missing"))

    length = F.greatest(F.least(F.lit(size), F.size(u) - start, F.size(v) - start), F.lit(0))
    both = F.zip_with(
        F.slice(u, F.lit(start + 1), length), F.slice(v, F.lit(start + 1), length),
        # the accumulator's fields cannot turn NULL, so missing elements are counted
        lambda x, y: F.struct(F.coalesce(x.cast("double"), F.lit(0.0)).alias("a"), F.coalesce(y.cast("double"), F.lit(0.0)).alias("b"),
                              F.when(x.isNull() | y.isNull(), 1.0).otherwise(0.0).alias("missing")))
    zero = F.struct(*[F.lit(0.0).alias(n) for n in _SUMS])
    return F.aggregate(both, zero, step)


def _stats_from_moments(prefix: str, n: Column, m: dict[str, Column]) -> dict[str, Column]:
    values = {
        "cos_sim": m["uv"] / F.greatest(F.sqrt(m["uu"]) * F.sqrt(m["vv"]), F.lit(EPS)),
        "dot_raw": m["uv"],
        "euclidean": F.sqrt(m["sq"]),
        "manhattan": m["l1"],
        "abs_diff_mean": m["l1"] / n,
        "abs_diff_max": m["top"],
        "abs_diff_std": _population_std(m["g1"], m["g2"], n),
        "prod_mean": m["uv"] / n,
        "prod_std": _population_std(m["p1"], m["p2"], n),
    }
    return {prefix + k: F.when(m["missing"] == 0, c) for k, c in values.items()}


def _native_stats(df: DataFrame, u: str, v: str, sizes: list[int], prefixes: list[str]) -> DataFrame:
    edges = [0, *sorted(sizes)]
    parts = F.array(*[_segment_moments(F.col(u), F.col(v), a, b - a) for a, b in pairwise(edges)])
    staged = df.withColumn(_MOMENTS, parts)
    moments, running = {}, None
    for i, size in enumerate(sorted(sizes)):
        part = {n: F.col(_MOMENTS)[i][n] for n in _SUMS}
        running = part if running is None else {
            n: F.greatest(running[n], c) if n == "top" else running[n] + c for n, c in part.items()}
        moments[size] = running
    cols = {}
    for size, prefix in zip(sizes, prefixes):
        n = F.greatest(F.least(F.lit(size), F.size(u), F.size(v)), F.lit(1))
        cols.update(_stats_from_moments(prefix, n, moments[size]))
    return staged.withColumns(cols).drop(_MOMENTS)


def _padded(a: pa.Array, width: int):
    """Rows filled up with zeros to `width`, their lengths (-1: NULL), and where NULL elements stand."""
    import numpy as np

    offsets = a.offsets.to_numpy()
    lengths = np.diff(offsets)
    kept = np.minimum(lengths, width)
    row = np.repeat(np.arange(len(a)), kept)
    column = np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept)
    at = np.repeat(offsets[:-1], kept) + column
    values = a.values.cast(pa.float64())
    missing = np.zeros((len(a), width), dtype=bool)
    missing[row, column] = values.is_null().to_numpy(zero_copy_only=False)[at]
    full = np.zeros((len(a), width))
    full[row, column] = values.fill_null(0.0).to_numpy(zero_copy_only=False)[at]
    return full, np.where(a.is_valid().to_numpy(zero_copy_only=False), lengths, -1), missing


def _arrow_kernel(sizes: list[int], prefixes: list[str]):
    """Vectorised UDF: two array columns in, one struct of all statistics out."""
    names = [p + s for p in prefixes for s in STATS]

    @F.arrow_udf(", ".join(f"`{n}` double" for n in names))
    def kernel(u: pa.Array, v: pa.Array) -> pa.Array:
        import numpy as np

        width = max(sizes)
        a, len_a, null_a = _padded(u, width)
        b, len_b, null_b = _padded(v, width)
        shorter = np.minimum(len_a, len_b)
        inside = np.arange(width) < shorter[:, None]
        a, b, missing = np.where(inside, a, 0.0), np.where(inside, b, 0.0), (null_a | null_b) & inside
        gap = np.abs(a - b)
        prod = a * b
        out = {}
        for size, prefix in zip(sizes, prefixes):
            n = np.clip(shorter, 1, size)
            g, p, here = gap[:, :size], prod[:, :size], inside[:, :size]
            lengths = np.linalg.norm(a[:, :size], axis=1) * np.linalg.norm(b[:, :size], axis=1)
            d, mean = p.sum(axis=1), g.sum(axis=1) / n

            def spread(x, center):
                return np.sqrt((np.where(here, x - center[:, None], 0.0) ** 2).sum(axis=1) / n)

            values = (d / np.maximum(lengths, EPS), d, np.sqrt((g * g).sum(axis=1)), g.sum(axis=1),
                      mean, g.max(axis=1, initial=0.0), spread(g, mean), d / n, spread(p, d / n))
            unknown = (shorter < 0) | missing[:, :size].any(axis=1)
            out.update({prefix + s: pa.array(x, pa.float64(), mask=unknown) for s, x in zip(STATS, values)})
        return pa.StructArray.from_arrays([out[m] for m in names], names)

    return kernel


def add_vector_stats(df: DataFrame, u: str, v: str, sizes: Sequence[int],
                     prefixes: Sequence[str], kernel: str = "auto") -> DataFrame:
    """Append the nine statistics for every prefix size.

    `kernel` is "native", "arrow" or "auto" (by the longest prefix).
    """
    sizes, prefixes = list(sizes), list(prefixes)
    if kernel == "auto":
        kernel = "native" if max(sizes) <= NATIVE_MAX_DIM else "arrow"
    if kernel == "native":
        return _native_stats(df, u, v, sizes, prefixes)
    packed = df.withColumn(_MOMENTS, _arrow_kernel(sizes, prefixes)(F.col(u), F.col(v)))
    names = [p + s for p in prefixes for s in STATS]
    return packed.withColumns({n: F.col(_MOMENTS)[n] for n in names}).drop(_MOMENTS)


def prefix_stats(df: DataFrame, length: int, dims: Sequence[int] | None = None,
                 u: str = "emb1", v: str = "emb2", kernel: str = "auto") -> DataFrame:
    """Nine statistics per prefix size, named `d{size}_{stat}`."""
    sizes = resolve_dims(length, dims)
    return add_vector_stats(df, u, v, sizes, [f"d{d}_" for d in sizes], kernel)


def prefix_stat_names(length: int, dims: Sequence[int] | None = None) -> list[str]:
    return [f"d{d}_{s}" for d in resolve_dims(length, dims) for s in STATS]


def scalar_bridge(u="emb1", v="emb2", norm1="norm1", norm2="norm2") -> dict[str, Column]:
    """Six summary scalars of a vector pair, in the order of `BRIDGE`."""
    prods, gaps = products(u, v), abs_diffs(u, v)
    size = F.greatest(F.size(prods), F.lit(1))
    floor = F.lit(EPS)
    n1, n2 = F.greatest(_dbl(norm1), floor), F.greatest(_dbl(norm2), floor)
    values = (total(prods) / (n1 * n2), norm(gaps), total(prods),
              F.abs(n1 - n2), total(prods) / size, total(gaps) / size)
    return dict(zip(BRIDGE, values))


def interaction_vector(u="emb1", v="emb2", scalars: Column | None = None) -> Column:
    """[u, v, |u-v|, u*v] followed by optional scalars, as one double array."""
    as_double = [F.transform(_dbl(x), lambda e: e.cast("double")) for x in (u, v)]
    tail = [] if scalars is None else [scalars]
    return F.concat(*as_double, abs_diffs(u, v), products(u, v), *tail)


def pair_concat(u="emb1", v="emb2", scalars: Column | None = None) -> Column:
    """[u, v] followed by optional scalars, as one double array."""
    as_double = [F.transform(_dbl(x), lambda e: e.cast("double")) for x in (u, v)]
    return F.concat(*as_double, *([] if scalars is None else [scalars]))


def pair_concat_names(dim: int, scalar_dim: int = 0, analytic: bool = False) -> list[str]:
    """Column names for the positions of `pair_concat`."""
    names = [f"emb{side}_{i}" for side in (1, 2) for i in range(dim)]
    if analytic:
        names += [f"scalar_{n}" for n in BRIDGE]
    return names + [f"ce_feat_{i}" for i in range(scalar_dim)]
