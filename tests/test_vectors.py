import numpy as np
import pytest
from pyspark.sql import functions as F

from pairkit.functions import vectors as vx
from pairkit.operators import enrich, features

SCHEMA = "id int, emb1 array<float>, emb2 array<float>"


def brute(u, v, d):
    u, v = np.asarray(u[:d], float), np.asarray(v[:d], float)
    g, p = np.abs(u - v), u * v
    return [p.sum() / max(np.linalg.norm(u) * np.linalg.norm(v), 1e-12), p.sum(), np.linalg.norm(u - v),
            g.sum(), g.mean(), g.max(), g.std(), p.mean(), p.std()]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    out = [(0, [0.0] * 12, [1.0] * 12), (1, [2.0] * 12, [2.0] * 12), (2, [1.0, -1.0] * 6, [-1.0, 1.0] * 6)]
    for i in range(3, 12):
        out.append((i, *rng.normal(size=(2, 12)).astype(np.float32).tolist()))
    return out


@pytest.mark.parametrize("kernel", ["native", "arrow"])
def test_prefix_stats_match_numpy(spark, rows, kernel):
    df = vx.prefix_stats(spark.createDataFrame(rows, SCHEMA), 12, (4, 0, 4, 7, 99), kernel=kernel)
    names = vx.prefix_stat_names(12, (4, 0, 4, 7, 99))
    assert len(names) == 27
    for row in df.orderBy("id").collect():
        want = [x for d in (4, 7, 12) for x in brute(row.emb1, row.emb2, d)]
        assert [row[n] for n in names] == pytest.approx(want, abs=1e-6)


def test_resolve_dims():
    assert vx.resolve_dims(64) == [64]
    assert vx.resolve_dims(2560) == list(vx.DEFAULT_DIMS)
    assert vx.resolve_dims(100, (-1, 10, 10, 500, 20)) == [10, 100, 20]


def test_extremes_of_cosine_and_hellinger(spark, rows):
    df = spark.createDataFrame(rows[:3], SCHEMA)
    got = [r.c for r in df.orderBy("id").select(vx.cosine("emb1", "emb2").alias("c")).collect()]
    assert got == pytest.approx([0.0, 1.0, -1.0])
    same = df.filter("id = 1").select(vx.hellinger_similarity("emb1", "emb2").alias("h")).first().h
    assert same == pytest.approx(1.0)


def test_feature_set_sizes(spark, rows):
    df = enrich.add_norm(spark.createDataFrame([(1, [1.0, 2.0])], "qid bigint, embedding array<float>"))
    assert df.first().norm == pytest.approx(5 ** 0.5)
    assert len(features.EMBEDDING) == 12 and len(features.LEXICAL) == 10 and len(features.CLASSICAL) == 79
    assert len(features.all_features(64).names) == 22
    assert len(features.prefix_all_features(2560).names) == 73
    assert len(features.prefix_classical_features(2560).names) == 146
    # matching blocks are added by those who want them
    assert len((features.prefix_classical_features(2560) + features.matching_block_features()).names) == 152


def test_pair_concat_names_follow_values(spark, rows):
    df = spark.createDataFrame(rows[3:4], SCHEMA).withColumns({"norm1": vx.norm("emb1"), "norm2": vx.norm("emb2")})
    scalars = F.array(*vx.scalar_bridge().values())
    row = df.select(vx.pair_concat(scalars=scalars).alias("x"), "emb1", "emb2").first()
    names = vx.pair_concat_names(12, 0, analytic=True)
    assert len(names) == len(row.x) == 30
    assert row.x[:12] == pytest.approx(row.emb1) and row.x[names.index("scalar_cos_sim")] == pytest.approx(
        brute(row.emb1, row.emb2, 12)[0], abs=1e-6)


RAGGED = [(0, [1.0, 2.0, 3.0, 4.0], [2.0, 2.0, 2.0, 2.0]), (1, [1.0, 2.0], [1.0, 2.0, 9.0]), (2, None, [1.0]), (3, [1.0, None, 3.0], [1.0, 1.0, 1.0]),
          (4, [], [1.0]), (5, [1e4, 1e4 + 1e-3, 1e4 + 3e-3], [0.0, 0.0, 0.0]), (6, [0.0] * 300, [1.0] * 300)]


def expected_stats(u, v, size):
    if u is None or v is None:
        return [None] * 9
    u, v = u[:size], v[:size]
    n = min(len(u), len(v))
    if any(x is None for x in u[:n] + v[:n]):
        return [None] * 9
    a, b = np.array(u[:n], dtype=float), np.array(v[:n], dtype=float)
    g, p = np.abs(a - b), a * b
    d = max(n, 1)
    mean = lambda x: x.sum() / d
    std = lambda x: np.sqrt(((x - mean(x)) ** 2).sum() / d)
    return [p.sum() / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12), p.sum(), np.sqrt((g * g).sum()), g.sum(), mean(g),
            g.max(initial=0), std(g), mean(p), std(p)]


@pytest.mark.parametrize("kernel", ["native", "arrow", "auto"])
def test_kernels_agree_on_unequal_and_missing_vectors(spark, kernel):
    df = spark.createDataFrame(RAGGED, "i int, emb1 array<double>, emb2 array<double>").coalesce(1)
    sizes = [2, 1, 256]
    got = vx.add_vector_stats(df, "emb1", "emb2", sizes, [f"d{s}_" for s in sizes], kernel).collect()
    for row, (_, u, v) in zip(sorted(got, key=lambda r: r.i), RAGGED):
        for s in sizes:
            want = expected_stats(u, v, s)
            for name, x in zip(vx.STATS, want):
                y = row[f"d{s}_{name}"]
                assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-6 * max(1, abs(x))), (row.i, s, name, x, y)
