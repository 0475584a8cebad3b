"""Sources, dictionaries, enrichment, remaining joins, filters and sinks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from checks.core import DOCS, DP, SCORED, TP, VP, add, r6, rounded, split_ctes, with_
from checks.vector_checks import BY_TEXT, cosine_scores, joined, totals, vectors_by_text
from pairkit.functions import text as tx, vectors as vx
from pairkit.operators import dictionary, enrich, evaluate, joins, ranking, splits
from pairkit.plans import jobs, samples
from pairkit.session import scratch_path
from pairkit.sources import pairs as src, stores

ROW_NO = "qid1 * 2147483648 + qid2"


# ---- CSV sources -------------------------------------------------------------
def labelled_rows(spark, sf_dir):
    """Document pairs as labelled CSV rows. Positive pairs come again twice: once with
    an unusable left id and once, under a negative number, with an empty right text."""
    pairs = samples.document_pairs(spark, sf_dir).withColumn("id", F.expr(ROW_NO))
    rows = pairs.select(*[F.col(c).cast("string").alias(c) for c in ("id", "qid1", "qid2")],
                        "question1", "question2", F.col("label").cast("string").alias("is_duplicate"))
    # 1: bad, 2: empty; copies of a row are made in its task.
    copies = F.when(F.col("is_duplicate") == "1", F.array(*map(F.lit, range(3)))).otherwise(F.array(F.lit(0)))
    copied, copy = rows.withColumn("copy", F.explode(copies)), F.col("copy")
    return copied.withColumns({
        "id": F.when(copy == 2, F.concat(F.lit("-"), "id")).otherwise(F.col("id")),
        "qid1": F.when(copy == 1, "n/a").otherwise(F.col("qid1")),
        "question2": F.when(copy != 2, F.col("question2"))}).drop("copy")


LABELLED_SQL = f"""rows_ AS (
  SELECT CAST({ROW_NO} AS VARCHAR) AS id, CAST(qid1 AS VARCHAR) AS qid1, CAST(qid2 AS VARCHAR) AS qid2,
         question1, question2, CAST(label AS VARCHAR) AS is_duplicate FROM dp),
csv AS (
  SELECT * FROM rows_
  UNION ALL SELECT id, 'n/a', qid2, question1, question2, is_duplicate FROM rows_ WHERE is_duplicate = '1'
  UNION ALL SELECT '-' || id, qid1, qid2, question1, NULL, is_duplicate FROM rows_ WHERE is_duplicate = '1')"""


def csv_folder(spark, sf_dir):
    """Scratch folder with a decoy CSV and the labelled pairs."""
    folder = scratch_path(spark, "csv")
    samples.table(spark, sf_dir, "nation").write.csv(f"{folder}/a_decoy.csv", header=True)
    stores.write_csv(labelled_rows(spark, sf_dir), f"{folder}/pairs.csv")
    return folder


add("a1_read_pairs",
    lambda spark, sf_dir: src.read_pairs(spark, csv_folder(spark, sf_dir)).select(
        "id", "qid1", "qid2", F.md5("question1").alias("q1"), F.md5(F.coalesce("question2", F.lit(""))).alias("q2"),
        "is_duplicate"),
    with_(DP, LABELLED_SQL, select="""SELECT id, qid1, qid2, md5(question1) AS q1,
md5(coalesce(question2, '')) AS q2, is_duplicate FROM csv"""))
add("a3_parse_typed",
    lambda spark, sf_dir: src.parse_labelled(src.read_pairs(spark, csv_folder(spark, sf_dir))).select(
        "row_no", "qid1", "qid2", F.length("question1").alias("n1"), F.length("question2").alias("n2"), "label"),
    with_(DP, LABELLED_SQL, select="""SELECT CAST(id AS BIGINT) AS row_no, CAST(qid1 AS BIGINT) AS qid1,
CAST(qid2 AS BIGINT) AS qid2, CAST(length(question1) AS INTEGER) AS n1,
CAST(length(coalesce(question2, '')) AS INTEGER) AS n2, CAST(is_duplicate AS INTEGER) AS label
FROM csv WHERE qid1 <> 'n/a'"""))

add("a3_count_bad", lambda spark, sf_dir: src.count_bad(src.read_pairs(spark, csv_folder(spark, sf_dir))),
    with_(DP, LABELLED_SQL, select="SELECT count(*) AS n_rows, count(*) FILTER (WHERE qid1 = 'n/a') AS n_bad FROM csv"))


def load(part):
    def query(spark, sf_dir):
        vectors = enrich.add_norm(samples.vectors(spark, sf_dir))
        rows, counts = jobs.load_pairs(spark, csv_folder(spark, sf_dir), vectors, limit=50)
        return counts if part == "counts" else rows.select("row_no", "qid1", "qid2", "label", F.size("emb1").alias("dim"))

    return query


LOADED = (DP, LABELLED_SQL, """good AS (SELECT CAST(id AS BIGINT) AS row_no, CAST(qid1 AS BIGINT) AS qid1, CAST(qid2 AS BIGINT) AS qid2,
  CAST(is_duplicate AS INTEGER) AS label FROM csv WHERE qid1 <> 'n/a'),
kept AS (SELECT good.* FROM good JOIN embeddings a ON a.vec_id = qid1 JOIN embeddings b ON b.vec_id = qid2)""")
# The limit is the job's own feature.
add("jobs_load_rows", load("rows"), with_(*LOADED, select="""SELECT row_no, qid1, qid2, label, 64 AS dim FROM kept
ORDER BY row_no LIMIT 50"""))
add("jobs_load_counts", load("counts"), with_(*LOADED, select="""SELECT (SELECT count(*) FROM csv) AS n_rows,
(SELECT count(*) FROM csv WHERE qid1 = 'n/a') AS n_bad, (SELECT count(*) FROM good) - (SELECT count(*) FROM kept) AS n_missing,
least(50, (SELECT count(*) FROM kept)) AS n_kept"""))


def unlabelled(spark, sf_dir):
    """Conversation turns as unlabelled CSV rows with blanks around the texts."""
    folder = scratch_path(spark, "csv")
    rows = samples.turn_pairs(spark, sf_dir).select(
        F.col("qid1").alias("test_id"), F.concat(F.lit(" \t"), "question1").alias("question1"),
        F.concat("question2", F.lit("  ")).alias("question2"))
    stores.write_csv(rows, f"{folder}/test.csv")
    return src.parse_unlabelled(src.read_unlabelled_pairs(spark, folder))


def sql_strip(text):
    return rf"regexp_replace({text}, '^[\x09-\x0D\x1C-\x20\x{{85}}\p{{Z}}]+|[\x09-\x0D\x1C-\x20\x{{85}}\p{{Z}}]+$', '', 'g')"


add("a2_read_unlabelled_pairs", lambda spark, sf_dir: unlabelled(spark, sf_dir).select(
    "test_id", F.md5("question1").alias("q1"), F.md5("question2").alias("q2"), "label"),
    with_(TP, select=f"""SELECT qid1 AS test_id, md5({sql_strip('question1')}) AS q1,
md5({sql_strip('question2')}) AS q2, CAST(NULL AS INTEGER) AS label FROM tp"""))


# ---- vector and score stores -------------------------------------------------
def stored_vectors(spark, sf_dir):
    path = scratch_path(spark, "vectors")
    both = samples.vectors(spark, sf_dir).join(samples.documents(spark, sf_dir), "qid", "left")
    stores.write_vectors(both.select("qid", "text", "embedding"), path)
    return path


def stored_text_vectors(spark, sf_dir):
    path = scratch_path(spark, "text-vectors")
    stores.write_vectors(vectors_by_text(spark, sf_dir), path, "text")
    return path


TOTAL = "list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))"


def total():
    return vx.total(F.transform("embedding", lambda x: x.cast("double"))).alias("total")


add("a4_read_vectors", lambda spark, sf_dir: rounded(
    stores.read_vectors(spark, stored_vectors(spark, sf_dir)).select("qid", total())),
    f"SELECT vec_id AS qid, {r6(TOTAL, 'total')} FROM embeddings")
add("a5_read_vectors_by_text", lambda spark, sf_dir: rounded(
    stores.read_vectors_by_text(spark, stored_text_vectors(spark, sf_dir)).select("text", total())),
    with_(BY_TEXT, select=f"SELECT text, {r6(TOTAL, 'total')} FROM bt"))
add("r1_vector_store", lambda spark, sf_dir: rounded(
    spark.read.parquet(stored_vectors(spark, sf_dir)).select("qid", F.length("text").alias("n_chars"), total())),
    f"""SELECT vec_id AS qid, CAST(length(text) AS INTEGER) AS n_chars, {r6(TOTAL, 'total')}
FROM embeddings LEFT JOIN documents ON doc_id = vec_id""")


def pair_scores(spark, sf_dir):
    """Scores of the vector pairs whose left document has quality labels. Low-quality
    ones are stored in reverse order, toxic ones twice; the second copy has a later
    index, another score and no feature array."""
    labels = samples.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("qid1"), "quality", "toxic")
    s = samples.vector_pairs(spark, sf_dir).join(labels, "qid1").withColumn(
        "score", ((F.col("qid1") * 31 + F.col("qid2") * 17) % 100 / 100.0).cast("float"))
    first = s.withColumns({"index": F.expr("qid1 * 1000 + qid2"), "features": F.array("score")})
    again = s.filter("toxic = 1").withColumns({
        "index": F.expr("qid1 * 1000 + qid2 + 1000000000"), "score": (F.lit(1.0) - F.col("score")).cast("float"),
        "features": F.lit(None).cast("array<float>")})
    low = F.col("quality") == 0
    return first.unionByName(again).select(
        "index", F.when(low, F.col("qid2")).otherwise(F.col("qid1")).alias("qid1"),
        F.when(low, F.col("qid1")).otherwise(F.col("qid2")).alias("qid2"), "score", "features")


SCORES = VP + """,
s0 AS (SELECT vp.*, quality, toxic, CAST((qid1 * 31 + qid2 * 17) % 100 / 100.0 AS FLOAT) AS score
  FROM vp JOIN labels ON labels.doc_id = vp.qid1),
s1 AS (
  SELECT qid1 * 1000 + qid2 AS idx, qid1, qid2, quality, score FROM s0
  UNION ALL
  SELECT qid1 * 1000 + qid2 + 1000000000, qid1, qid2, quality, CAST(1.0 - score AS FLOAT) FROM s0 WHERE toxic = 1),
scores AS (
  SELECT idx, CASE WHEN quality = 0 THEN qid2 ELSE qid1 END AS qid1,
         CASE WHEN quality = 0 THEN qid1 ELSE qid2 END AS qid2, score FROM s1)"""


def stored_scores(spark, sf_dir):
    path = scratch_path(spark, "scores")
    stores.write_pair_scores(pair_scores(spark, sf_dir), path)
    return path


add("a6_read_pair_scores", lambda spark, sf_dir: rounded(
    stores.read_pair_scores(spark, stored_scores(spark, sf_dir)).select(
        "index", "qid1", "qid2", F.col("features")[0].cast("double").alias("feature"))),
    with_(SCORES, select="SELECT idx AS index, qid1, qid2, " + r6("score", "feature") + " FROM scores"))
add("r2_pair_score_store", lambda spark, sf_dir: rounded(
    spark.read.parquet(stored_scores(spark, sf_dir)).select(
        "index", "qid1", "qid2", F.col("score").cast("double").alias("score"),
        F.col("features").isNull().cast("int").alias("scalar_only"))),
    with_(SCORES, select="SELECT idx AS index, qid1, qid2, " + r6("score", "score")
          + ", CAST(CASE WHEN idx >= 1000000000 THEN 1 ELSE 0 END AS INTEGER) AS scalar_only FROM scores"))
add("d3_attach_pair_scores", lambda spark, sf_dir: rounded(joins.attach_pair_scores(
    samples.vector_pairs(spark, sf_dir), stores.pair_score_features(pair_scores(spark, sf_dir)), 1).select(
        "qid1", "qid2", F.col("ce")[0].cast("double").alias("ce"), F.col("ce_missing").cast("int").alias("ce_missing"))),
    with_(SCORES, """last AS (SELECT qid1, qid2, arg_max(score, idx) AS score FROM scores GROUP BY qid1, qid2)""",
          select=f"""SELECT vp.qid1, vp.qid2, {r6('coalesce(a.score, b.score, 0)', 'ce')},
CAST(CASE WHEN a.score IS NULL AND b.score IS NULL THEN 1 ELSE 0 END AS INTEGER) AS ce_missing
FROM vp LEFT JOIN last a ON a.qid1 = vp.qid1 AND a.qid2 = vp.qid2
LEFT JOIN last b ON b.qid1 = vp.qid2 AND b.qid2 = vp.qid1"""))


# ---- dictionaries ------------------------------------------------------------
def dictionary_pairs(spark, sf_dir):
    """Document pairs whose right texts are in lower case, so one id has two texts."""
    return samples.document_pairs(spark, sf_dir).withColumns(
        {"row_no": F.expr(ROW_NO), "question2": F.lower("question2")})


add("b1_question_dictionary", lambda spark, sf_dir: dictionary.question_dictionary(
    dictionary_pairs(spark, sf_dir)).select("qid", F.md5("text").alias("text")),
    with_(DP, f"""s AS (SELECT {ROW_NO} AS row_no, 1 AS side, qid1 AS qid, question1 AS text FROM dp
  UNION ALL SELECT {ROW_NO}, 2, qid2, lower(question2) FROM dp),
f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY row_no, side) AS rn FROM s)""",
          select="SELECT qid, md5(text) AS text FROM f WHERE rn = 1"))
add("b2_unique_texts", lambda spark, sf_dir: dictionary.unique_texts(samples.document_pairs(spark, sf_dir)),
    with_(DP, select=f"""SELECT DISTINCT {sql_strip('t')} AS text
FROM (SELECT question1 AS t FROM dp UNION ALL SELECT question2 FROM dp)"""))
CORPUS = "c AS (SELECT question1 AS text FROM dp UNION ALL SELECT question2 FROM dp)"
add("b3_corpus", lambda spark, sf_dir: dictionary.corpus(samples.document_pairs(spark, sf_dir)).groupBy(
    F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n")),
    with_(DP, CORPUS, select="SELECT md5(text) AS digest, count(*) AS n FROM c GROUP BY 1"))
add("b4_new_texts_only", lambda spark, sf_dir: dictionary.new_texts_only(
    dictionary.corpus(samples.document_pairs(spark, sf_dir)), vectors_by_text(spark, sf_dir)),
    with_(DP, CORPUS, BY_TEXT, select="SELECT DISTINCT text FROM c WHERE text NOT IN (SELECT text FROM bt)"))


# ---- enrichment --------------------------------------------------------------
def embedded(spark, sf_dir):
    texts = dictionary.unique_texts(samples.turn_pairs(spark, sf_dir))
    vectors = enrich.add_norm(enrich.embed_texts(texts, enrich.hashing_encoder(32), key="text"))
    return rounded(vectors.select("text", F.size("embedding").alias("dim"), "norm"), 4)


add("c1_embed_texts", embedded,
    with_(TP, select=f"""SELECT DISTINCT {sql_strip('t')} AS text, CAST(32 AS INTEGER) AS dim, CAST(1.0 AS DOUBLE) AS norm
FROM (SELECT question1 AS t FROM tp UNION ALL SELECT question2 FROM tp)"""))


def token_scores(spark, sf_dir):
    pairs = samples.turn_pairs(spark, sf_dir).withColumn("index", F.col("qid1"))
    scored = enrich.score_pairs(pairs, enrich.overlap_scorer)
    return rounded(scored.select("index", "qid1", "qid2", F.col("score").cast("double").alias("score"),
                                 F.col("features")[0].cast("double").alias("shared")), 4)


from checks.core import ws_tokens  # noqa: E402

add("c2_score_pairs", token_scores,
    with_(TP, f"t AS (SELECT qid1, qid2, list_distinct({ws_tokens('question1')}) AS a, "
          f"list_distinct({ws_tokens('question2')}) AS b FROM tp)",
          "i AS (SELECT *, len(list_intersect(a, b)) AS inter FROM t)",
          select="""SELECT qid1 AS index, qid1, qid2,
round(CAST(CAST(inter AS FLOAT) / (len(a) + len(b) - inter) AS DOUBLE), 4) + 0.0 AS score,
CAST(inter AS DOUBLE) AS shared FROM i"""))


def counters(spark, sf_dir):
    """Pairs, and those whose left document has no vector."""
    known = samples.vectors(spark, sf_dir).select(F.col("qid").alias("qid1"), F.lit(True).alias("known"))
    pairs = samples.document_links(spark, sf_dir).join(known, "qid1", "left")
    return enrich.count_rows(pairs, missing=F.col("known").isNull())


add("c4_job_counters", counters,
    with_(DOCS, select="""SELECT count(*) AS done, count(*) FILTER (WHERE vec_id IS NULL) AS missing
FROM links LEFT JOIN embeddings ON vec_id = qid1"""))

# ---- unions, splits, members -------------------------------------------------
add("d4_union_train_score", lambda spark, sf_dir: joins.union_train_score(
    samples.document_pairs(spark, sf_dir),
    samples.turn_pairs(spark, sf_dir).withColumn("label", F.lit(None).cast("int")))
    .select("qid1", "qid2", "label", "split", F.length("question1").alias("n_chars")),
    with_(DP, TP, select="""SELECT qid1, qid2, label, 'train' AS split, CAST(length(question1) AS INTEGER) AS n_chars FROM dp
UNION ALL SELECT qid1, qid2, NULL, 'score', CAST(length(question1) AS INTEGER) FROM tp"""))


def split_assigned(spark, sf_dir):
    pairs = samples.document_pairs(spark, sf_dir)
    assigned = joins.assign_split(pairs, splits.stratified_split(pairs))
    return assigned.select("qid1", "qid2", "label", "split", F.length("question2").alias("n_chars"))


add("d5_assign_split", split_assigned,
    with_(DP, split_ctes("dp"), select="""SELECT sp.qid1, sp.qid2, sp.label, split,
CAST(length(question2) AS INTEGER) AS n_chars FROM sp JOIN dp ON dp.qid1 = sp.qid1 AND dp.qid2 = sp.qid2"""))

MEMBER_SQL = ("proba", "round((qid1 * 31 + qid2 * 17) % 100 / 100.0, 6)", "round(abs(proba), 6)")


def members(spark, sf_dir):
    """Three deterministic score tables over the vector pairs."""
    base = cosine_scores(spark, sf_dir)
    pseudo = F.round((F.col("qid1") * 31 + F.col("qid2") * 17) % 100 / 100.0, 6)
    return [base, base.withColumn("proba", pseudo), base.withColumn("proba", F.abs("proba"))]


MEMBERS = SCORED + ",\nmem AS (SELECT qid1, qid2, label, " + ", ".join(
    f"{e} AS p{i}" for i, e in enumerate(MEMBER_SQL)) + " FROM scored)"
add("d6_align_members", lambda spark, sf_dir: rounded(joins.align_members(members(spark, sf_dir)).select(
    "qid1", "qid2", "label", "p0", "p1", "p2", F.col("agree").cast("int").alias("agree"))),
    with_(MEMBERS, select="SELECT qid1, qid2, label, p0, CAST(p1 AS DOUBLE) AS p1, p2, CAST(1 AS INTEGER) AS agree FROM mem"))


def conflicts(spark, sf_dir):
    """A member whose labels are flipped wherever its score is high."""
    first, second, _ = members(spark, sf_dir)
    flipped = second.withColumn("label", F.when(F.col("proba") >= 0.9, 1 - F.col("label")).otherwise(F.col("label")))
    return joins.label_conflicts(joins.align_members([first, flipped]))


add("d6_label_conflicts", conflicts,
    with_(MEMBERS, select="SELECT count(*) AS conflicts FROM mem WHERE p1 >= 0.9"))

# ---- limits, filters, submission ---------------------------------------------
add("e1_head_limit", lambda spark, sf_dir: ranking.head_limit(
    samples.document_links(spark, sf_dir).withColumn("row_no", F.expr(ROW_NO)), 100),
    with_(DOCS, select=f"SELECT qid1, qid2, {ROW_NO} AS row_no FROM links ORDER BY row_no LIMIT 100"))
add("e2_threshold_filter", lambda spark, sf_dir: evaluate.decide(cosine_scores(spark, sf_dir), 0.05).filter("pred = 1"),
    with_(SCORED, select="SELECT *, CAST(1 AS INTEGER) AS pred FROM scored WHERE proba >= 0.05"))
add("e3_error_filter", lambda spark, sf_dir: evaluate.errors(evaluate.decide(cosine_scores(spark, sf_dir), 0.05)),
    with_(SCORED, """d AS (SELECT *, CAST(CASE WHEN proba >= 0.05 THEN 1 ELSE 0 END AS INTEGER) AS pred FROM scored)""",
          select="SELECT *, CASE WHEN label = 1 THEN 'FN' ELSE 'FP' END AS error_type FROM d WHERE label <> pred"))


def submitted(spark, sf_dir):
    """Every document pair gets a row; pairs without vectors keep a default score."""
    ids = samples.document_links(spark, sf_dir).withColumn("test_id", F.expr(ROW_NO))
    with_vectors = joins.attach_vectors(ids, samples.vectors(spark, sf_dir))
    scored = with_vectors.select("test_id", F.round(vx.cosine("emb1", "emb2"), 6).alias("proba"))
    path = scratch_path(spark, "submission")
    stores.write_csv(stores.submission(ids, scored, default=0.5), path)
    return spark.read.csv(path, header=True, schema="test_id bigint, is_duplicate string")


from checks.core import COS, DOUBLES  # noqa: E402

add("r3_submission", submitted,
    with_(DOCS, f"""cs AS (SELECT l.qid1, l.qid2, {DOUBLES.format('a.embedding')} AS u, {DOUBLES.format('b.embedding')} AS v
  FROM links l JOIN embeddings a ON a.vec_id = l.qid1 JOIN embeddings b ON b.vec_id = l.qid2),
pr AS (SELECT qid1, qid2, round({COS}, 6) AS proba FROM cs)""",
          select=f"""SELECT links.qid1 * 2147483648 + links.qid2 AS test_id, printf('%.6f', coalesce(proba, 0.5)) AS is_duplicate
FROM links LEFT JOIN pr ON pr.qid1 = links.qid1 AND pr.qid2 = links.qid2"""))


def feature_table(spark, sf_dir):
    """Features written once, by split, and the training part read back."""
    pairs = joined(spark, sf_dir)
    path = scratch_path(spark, "features")
    split = splits.stratified_split(samples.vector_pairs(spark, sf_dir))
    rows = joins.assign_split(pairs, split).withColumn("cos", vx.cosine("emb1", "emb2"))
    stores.write_feature_table(rows.select("qid1", "qid2", "label", "cos", "split"), path)
    return rounded(spark.read.parquet(path).filter("split = 'train'").select("qid1", "qid2", "label", "cos"))


add("r6_feature_table", feature_table,
    with_(SCORED, split_ctes("vp"), select="""SELECT qid1, qid2, scored.label, proba AS cos
FROM scored JOIN sp USING (qid1, qid2) WHERE split = 'train'"""))
