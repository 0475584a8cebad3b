"""Vector lookups and vector similarity features."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.core import COS, DOCS, DP, SCORED, VP, VV, add, r6, rounded, with_
from pairkit.functions import vectors as vx
from pairkit.operators import enrich, features, joins
from pairkit.plans import samples

DIM = 64
DIMS = (8, 16, 32, 64)


def joined(spark, sf_dir):
    vectors = enrich.add_norm(samples.vectors(spark, sf_dir))
    return joins.attach_vectors(samples.vector_pairs(spark, sf_dir), vectors)


def cosine_scores(spark, sf_dir):
    """(qid1, qid2, label, proba) with the cosine, to six places, as the probability."""
    score = F.round(vx.cosine("emb1", "emb2", "norm1", "norm2"), 6)
    return joined(spark, sf_dir).select("qid1", "qid2", "label", score.alias("proba"))


STAT_SQL = {
    "cos_sim": COS, "dot_raw": "list_dot_product(u, v)", "euclidean": "list_distance(u, v)",
    "manhattan": "list_sum(g)", "abs_diff_mean": "list_avg(g)", "abs_diff_max": "list_max(g)",
    "abs_diff_std": "list_stddev_pop(g)", "prod_mean": "list_avg(p)", "prod_std": "list_stddev_pop(p)",
    "norm1": "sqrt(list_dot_product(u, u))", "norm2": "sqrt(list_dot_product(v, v))",
    "norm_diff": "abs(sqrt(list_dot_product(u, u)) - sqrt(list_dot_product(v, v)))",
}
GAPS = """gp AS (
  SELECT *, list_transform(range(1, len(u) + 1), lambda i: abs(u[i] - v[i])) AS g,
         list_transform(range(1, len(u) + 1), lambda i: u[i] * v[i]) AS p FROM vv)"""


def stat_sql(names):
    return with_(VP, VV, GAPS, select="SELECT qid1, qid2, " + ", ".join(
        r6(STAT_SQL[n], n) for n in names) + " FROM gp")


def stat_query(names):
    def query(spark, sf_dir):
        built = features.embedding_features(DIM).apply(joined(spark, sf_dir))
        return rounded(built.select("qid1", "qid2", *names))

    return query


for key, names in {
    "f1_cos_sim": ["cos_sim"], "f2_dot_raw": ["dot_raw"], "f3_euclidean": ["euclidean"],
    "f4_manhattan": ["manhattan"], "f5_abs_diff_mean": ["abs_diff_mean"],
    "f6_abs_diff_max": ["abs_diff_max"], "f7_abs_diff_std": ["abs_diff_std"],
    "f8_prod": ["prod_mean", "prod_std"], "f9_norms": ["norm1", "norm2", "norm_diff"],
    "h1_embedding_features": list(features.EMBEDDING),
}.items():
    add(key, stat_query(names), stat_sql(names))

PREFIX_STAT_SQL = {**STAT_SQL, "cos_sim":
                   "list_dot_product(u, v) / greatest(sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v)), 1e-12)"}


def prefix_exprs(dims):
    out = []
    for d in dims:
        for s in vx.STATS:
            sliced = PREFIX_STAT_SQL[s]
            for name in ("u", "v", "g", "p"):
                sliced = sliced.replace(f"({name})", f"({name}[1:{d}])").replace(
                    f"({name},", f"({name}[1:{d}],").replace(f", {name})", f", {name}[1:{d}])")
            out.append(r6(sliced, f"d{d}_{s}"))
    return out


def prefix_query(dims, kernel):
    return lambda spark, sf_dir: rounded(
        vx.prefix_stats(joined(spark, sf_dir), DIM, dims, kernel=kernel)
        .select("qid1", "qid2", *vx.prefix_stat_names(DIM, dims)))


# Sizes to clamp, drop, deduplicate and complete: (16, 0, 40, 16, 200) resolves to 16, 40, 64.
ODD_DIMS = (16, 0, 40, 16, 200)
add("f10_resolve_prefix_dims", prefix_query(ODD_DIMS, "native"),
    with_(VP, VV, GAPS, select="SELECT qid1, qid2, " + ", ".join(prefix_exprs((16, 40, 64))) + " FROM gp"))
PREFIX_SQL = with_(VP, VV, GAPS, select="SELECT qid1, qid2, " + ", ".join(prefix_exprs(DIMS)) + " FROM gp")
add("f11_prefix_stats", prefix_query(DIMS, "native"), PREFIX_SQL)
add("f11_prefix_stats_arrow", prefix_query(DIMS, "arrow"), PREFIX_SQL)

BRIDGE_SQL = {"cos_sim": COS, "l2_dist": "list_distance(u, v)", "dot_raw": "list_dot_product(u, v)",
              "norm_diff": STAT_SQL["norm_diff"], "prod_mean": "list_avg(p)", "diff_mean": "list_avg(g)"}
add("f12_scalar_bridge",
    lambda spark, sf_dir: rounded(joined(spark, sf_dir).select(
        "qid1", "qid2", *[c.alias(n) for n, c in vx.scalar_bridge().items()])),
    with_(VP, VV, GAPS, select="SELECT qid1, qid2, " + ", ".join(
        r6(BRIDGE_SQL[n], n) for n in vx.BRIDGE) + " FROM gp"))


def digest(array):
    """Length, sum and position-weighted sum of an array column."""
    weighted = F.transform(array, lambda x, i: x * (i + 1))
    return [F.size(array).cast("bigint").alias("n_values"), vx.total(array).alias("total"),
            vx.total(weighted).alias("weighted")]


DIGEST_SQL = ("CAST(len(x) AS BIGINT) AS n_values, " + r6("list_sum(x)", "total") + ", "
              + r6("list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] * i))", "weighted"))
SCALARS_SQL = "[" + ", ".join(BRIDGE_SQL[n] for n in vx.BRIDGE) + "]"


def array_query(build):
    def query(spark, sf_dir):
        scalars = F.array(*vx.scalar_bridge().values())
        rows = joined(spark, sf_dir).withColumn("x", build(scalars=scalars))
        return rounded(rows.select("qid1", "qid2", *digest(F.col("x"))))

    return query


add("f13_interaction_vector", array_query(vx.interaction_vector),
    with_(VP, VV, GAPS, f"iv AS (SELECT qid1, qid2, list_concat(u, v, g, p, {SCALARS_SQL}) AS x FROM gp)",
          select=f"SELECT qid1, qid2, {DIGEST_SQL} FROM iv"))
add("f14_pair_concat", array_query(vx.pair_concat),
    with_(VP, VV, GAPS, f"iv AS (SELECT qid1, qid2, list_concat(u, v, {SCALARS_SQL}) AS x FROM gp)",
          select=f"SELECT qid1, qid2, {DIGEST_SQL} FROM iv"))

# ---- norms and lookups -------------------------------------------------------
add("c3_row_norms",
    lambda spark, sf_dir: rounded(enrich.add_norm(samples.vectors(spark, sf_dir)).select("qid", "norm")),
    "SELECT vec_id AS qid, " + r6(
        "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)))", "norm")
    + " FROM embeddings")


def document_vectors(spark, sf_dir):
    """Document pairs with vectors by id; most documents have none and drop out."""
    links = samples.document_links(spark, sf_dir)
    return joins.attach_vectors(links, samples.vectors(spark, sf_dir))

def totals():
    return [vx.total(F.transform(f"emb{i}", lambda x: x.cast("double"))).alias(f"total{i}") for i in (1, 2)]


TOTAL_SQL = ", ".join(r6(f"list_sum(list_transform({e}.embedding, lambda x: CAST(x AS DOUBLE)))", f"total{i}")
                      for i, e in ((1, "e1"), (2, "e2")))
add("d1_attach_vectors",
    lambda spark, sf_dir: rounded(document_vectors(spark, sf_dir).select("qid1", "qid2", *totals())),
    with_(DOCS, select=f"""SELECT l.qid1, l.qid2, {TOTAL_SQL} FROM links l
JOIN embeddings e1 ON e1.vec_id = l.qid1 JOIN embeddings e2 ON e2.vec_id = l.qid2"""))
add("d1_attach_vectors_salted",
    lambda spark, sf_dir: rounded(joins.attach_vectors(
        samples.document_links(spark, sf_dir), samples.vectors(spark, sf_dir), hot_share=0.01)
        .select("qid1", "qid2", *totals())),
    with_(DOCS, select=f"""SELECT l.qid1, l.qid2, {TOTAL_SQL} FROM links l
JOIN embeddings e1 ON e1.vec_id = l.qid1 JOIN embeddings e2 ON e2.vec_id = l.qid2"""))
add("d1_missing_vectors",
    lambda spark, sf_dir: joins.missing_vectors(
        samples.document_links(spark, sf_dir), samples.vectors(spark, sf_dir)),
    with_(DOCS, select="""SELECT qid1, qid2 FROM links
WHERE qid1 NOT IN (SELECT vec_id FROM embeddings) OR qid2 NOT IN (SELECT vec_id FROM embeddings)"""))


def vectors_by_text(spark, sf_dir):
    """(text, embedding) of the documents that have a vector; of equal texts, the one
    with the lowest id counts."""
    docs = samples.documents(spark, sf_dir)
    both = docs.join(samples.vectors(spark, sf_dir), "qid")
    return both.groupBy("text").agg(F.min_by("embedding", "qid").alias("embedding"))


BY_TEXT = """bt AS (SELECT text, arg_min(embedding, doc_id) AS embedding
  FROM documents JOIN embeddings ON vec_id = doc_id GROUP BY text)"""
add("d2_attach_vectors_by_text",
    lambda spark, sf_dir: rounded(joins.attach_vectors_by_text(
        samples.document_pairs(spark, sf_dir), vectors_by_text(spark, sf_dir), hot_share=0.01)
        .select("qid1", "qid2", *totals())),
    with_(DP, BY_TEXT, select=f"""SELECT dp.qid1, dp.qid2, {TOTAL_SQL} FROM dp
JOIN bt e1 ON e1.text = dp.question1 JOIN bt e2 ON e2.text = dp.question2"""))

# ---- cosine baseline ---------------------------------------------------------
add("n1_cosine_threshold",
    lambda spark, sf_dir: cosine_scores(spark, sf_dir).withColumn(
        "pred", (F.col("proba") >= 0.76).cast("int")),
    with_(SCORED, select="""SELECT qid1, qid2, label, proba,
CAST(CASE WHEN proba >= 0.76 THEN 1 ELSE 0 END AS INTEGER) AS pred FROM scored"""))
