"""Query registry and the SQL text that the statements share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairkit.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"duplicate query {name}")
    QUERIES[name] = lambda spark, sf_dir: query(tune(spark), sf_dir)
    if sql is not None:
        SQL[name] = sql


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Floating columns to a fixed number of decimals; adding 0 turns -0.0 into 0.0."""
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if kind in ("double", "float")
                       else F.col(c) for c, kind in df.dtypes])


def r6(expr: str, name: str) -> str:
    """SQL counterpart of `rounded` for one expression."""
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name}"


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


# ---- pair tables -------------------------------------------------------------
VP = """vp AS (
  SELECT a.vec_id AS qid1, b.vec_id AS qid2,
         CAST(CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS INTEGER) AS label
  FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 5)"""

DOUBLES = "list_transform({}, lambda x: CAST(x AS DOUBLE))"
VV = f"""vv AS (
  SELECT vp.*, {DOUBLES.format('a.embedding')} AS u, {DOUBLES.format('b.embedding')} AS v
  FROM vp JOIN embeddings a ON a.vec_id = vp.qid1 JOIN embeddings b ON b.vec_id = vp.qid2)"""

DOCS = """docs AS (
  SELECT doc_id AS qid, text, lower(trim(split_part(text, chr(10), 1))) AS line FROM documents),
firsts AS (SELECT line, min(qid) AS qid1 FROM docs GROUP BY line),
links AS (
  SELECT f.qid1, d.qid AS qid2 FROM docs d JOIN firsts f ON f.line = d.line WHERE f.qid1 < d.qid
  UNION
  SELECT a.qid, b.qid FROM docs a JOIN docs b ON b.qid = a.qid + 1)"""
DP = DOCS + """,
dp AS (
  SELECT l.qid1, l.qid2, a.text AS question1, b.text AS question2,
         CAST(CASE WHEN lower(trim(a.text)) = lower(trim(b.text)) THEN 1 ELSE 0 END AS INTEGER) AS label
  FROM links l JOIN docs a ON a.qid = l.qid1 JOIN docs b ON b.qid = l.qid2)"""

TP = """turns AS (SELECT conv_id * 100000 + turn AS qid, role, text FROM conversations),
tp AS (
  SELECT a.qid AS qid1, b.qid AS qid2, a.text AS question1, b.text AS question2,
         CAST(CASE WHEN a.role = 'user' AND b.role = 'assistant' THEN 1 ELSE 0 END AS INTEGER) AS label
  FROM turns a JOIN turns b ON b.qid = a.qid + 1)"""

# ---- tokens ------------------------------------------------------------------
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]"


def ws_tokens(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '{SPACE}+'), lambda x: x <> '')"


def word_tokens(text: str) -> str:
    return (rf"list_filter(string_split_regex(lower({text}), '[^\p{{L}}\p{{N}}_]+'), "
            "lambda x: x <> '')")


# Tokens once per document, then per pair.
DT = DP + f""",
dtok AS (SELECT qid, text, {ws_tokens('text')} AS t FROM docs),
tk AS (
  SELECT l.qid1, l.qid2, a.text AS q1, b.text AS q2, a.t AS t1, b.t AS t2,
         list_distinct(a.t) AS s1, list_distinct(b.t) AS s2
  FROM links l JOIN dtok a ON a.qid = l.qid1 JOIN dtok b ON b.qid = l.qid2),
sz AS (SELECT *, len(list_intersect(s1, s2)) AS inter, len(s1) AS n1, len(s2) AS n2 FROM tk)"""


def split_ctes(source: str, seed: int = 42) -> str:
    """Shuffled position per class, split and fold of every pair of `source`."""
    return f"""k AS (
  SELECT *, (qid1 * 2654435761 + qid2 * 40503 + {seed}) % 4294967296 AS k FROM {source}),
o AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY k, qid1, qid2) AS rn,
         row_number() OVER (ORDER BY k, qid1, qid2) AS rn_all,
         count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS n_all FROM k),
sp AS (
  SELECT qid1, qid2, label, CASE WHEN rn <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split,
         CAST((rn - 1) % 5 AS INTEGER) AS fold FROM o)"""


COS = ("list_dot_product(u, v) / (greatest(sqrt(list_dot_product(u, u)), 1e-12) "
       "* greatest(sqrt(list_dot_product(v, v)), 1e-12))")
# Cosine scores as probabilities, rounded so that both engines meet the same thresholds.
SCORED = VP + ",\n" + VV + f""",
scored AS (SELECT qid1, qid2, label, round({COS}, 6) AS proba FROM vv)"""

METRICS = """CASE WHEN tp + fp + tn + fn = 0 THEN 0.0 ELSE (tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE) END AS accuracy,
CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS prec,
CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS recall,
CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1"""
CELLS = """CAST(count(*) FILTER (WHERE label = 1 AND pred = 1) AS BIGINT) AS tp,
CAST(count(*) FILTER (WHERE label = 0 AND pred = 1) AS BIGINT) AS fp,
CAST(count(*) FILTER (WHERE label = 0 AND pred = 0) AS BIGINT) AS tn,
CAST(count(*) FILTER (WHERE label = 1 AND pred = 0) AS BIGINT) AS fn"""
METRIC_SELECT = "tp, fp, tn, fn, " + ", ".join(
    r6("prec" if m == "precision" else m, m) for m in ("accuracy", "precision", "recall", "f1"))
