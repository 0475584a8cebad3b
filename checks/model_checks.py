"""Topics, classifiers, stacking and search. Fits are seeded; rows, ranges and coverage
are what the checks can pin down."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from checks.core import DP, SCORED, TP, VP, VV, add, r6, rounded, split_ctes, with_, word_tokens
from checks.term_checks import term_ctes
from checks.text_checks import full
from checks.vector_checks import DIM, DIMS, joined
from pairkit.functions import vectors as vx
from pairkit.operators import (dictionary, enrich, ensemble, joins, models, ranking, search, splits, topics)
from pairkit.plans import jobs, samples
from pairkit.session import materialize, scratch_path

TOPICS = 5


# ---- topics ------------------------------------------------------------------
def corpus(spark, sf_dir):
    return dictionary.corpus(samples.turn_pairs(spark, sf_dir))


def lsi(spark, sf_dir):
    return topics.fit_lsi(corpus(spark, sf_dir), TOPICS)


def lda(spark, sf_dir):
    return topics.fit_lda(corpus(spark, sf_dir), TOPICS, 5)


def texts(spark, sf_dir):
    return dictionary.distinct_texts(corpus(spark, sf_dir))


add("k1_fit_lsi", lambda spark, sf_dir: lsi(spark, sf_dir).transform(texts(spark, sf_dir)).select(
    "text_id", F.size("lsi").alias("k"), F.round(vx.norm("lsi"), 6).alias("length")),
    with_(TP, select="""SELECT DISTINCT md5(t) AS text_id, CAST(5 AS INTEGER) AS k, CAST(1.0 AS DOUBLE) AS length
FROM (SELECT question1 AS t FROM tp UNION ALL SELECT question2 FROM tp)"""))
add("k2_fit_lda", lambda spark, sf_dir: lda(spark, sf_dir).transform(texts(spark, sf_dir)).select(
    "text_id", F.size("lda").alias("k"), F.round(vx.total("lda"), 6).alias("total")),
    with_(TP, select="""SELECT DISTINCT md5(t) AS text_id, CAST(5 AS INTEGER) AS k, CAST(1.0 AS DOUBLE) AS total
FROM (SELECT question1 AS t FROM tp UNION ALL SELECT question2 FROM tp)"""))


def part_pairs(spark, sf_dir):
    """Neighbouring parts by their descriptions, whose few words span few dimensions."""
    parts = samples.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("qid"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    other = parts.select((F.col("qid") - 1).alias("qid"), F.col("text").alias("question2"))
    return parts.withColumnRenamed("text", "question1").join(other, "qid").select(
        F.col("qid").alias("qid1"), (F.col("qid") + 1).alias("qid2"), "question1", "question2")


def full_rank(spark, sf_dir):
    """Cosine of topic vectors with a topic for every dimension, which is the cosine of the term weights."""
    pairs = part_pairs(spark, sf_dir)
    model = topics.fit_lsi(dictionary.corpus(pairs), 128)
    vectors = materialize(model.transform(dictionary.distinct_texts(dictionary.corpus(pairs))), "part-topics")
    for i in (1, 2):
        side = vectors.select(F.col("text_id").alias("__id"), F.col("lsi").alias(f"lsi{i}"))
        pairs = pairs.withColumn("__id", dictionary.text_key(f"question{i}")).join(side, "__id").drop("__id")
    return rounded(pairs.select("qid1", "qid2", topics.lsi_columns()["lsi_cosine_sim"].alias("lsi_cosine_sim")))


PART_TOKENS = f"list_filter({word_tokens('text')}, lambda w: length(w) >= 2)"
PARTS = """pa AS (SELECT p_partkey AS qid, concat_ws(' ', p_name, p_brand, p_type) AS t FROM part),
tp AS (SELECT a.qid AS qid1, b.qid AS qid2, a.t AS question1, b.t AS question2 FROM pa a JOIN pa b ON b.qid = a.qid + 1)"""
add("k4_lsi_full_rank", full_rank,
    with_(term_ctes(PARTS, PART_TOKENS, None), select="SELECT qid1, qid2, " + r6(
        "coalesce(sum(a.w * b.w), 0.0)", "lsi_cosine_sim") + """
FROM tp LEFT JOIN vec a ON a.text_id = md5(question1) LEFT JOIN vec b ON b.text_id = md5(question2) AND b.term = a.term GROUP BY qid1, qid2"""))


def rising(spark, sf_dir):
    """Whether the likelihood of the topic mixture rises, round by round."""
    fits = topics.fit_lda(corpus(spark, sf_dir), TOPICS, 5, tolerance=-1.0).log_likelihoods
    rows = [(i, bool(i == 0 or fits[i] >= fits[i - 1])) for i in range(len(fits))]
    return spark.createDataFrame(rows, "round int, rises boolean")


add("k2_lda_likelihood", rising, "SELECT CAST(i AS INTEGER) AS round, true AS rises FROM range(5) r(i)")


def topic_vectors(spark, sf_dir):
    return topics.attach_topics(samples.turn_pairs(spark, sf_dir), lsi(spark, sf_dir), lda(spark, sf_dir))


def sound_vectors(spark, sf_dir):
    """Sizes, lengths and ranges of the vectors of both texts of every pair."""
    fine = lambda c: F.forall(c, lambda x: (x >= 0) & (x <= 1))
    return topic_vectors(spark, sf_dir).select(
        "qid1", "qid2", *[F.size(f"lsi{i}").alias(f"k_lsi{i}") for i in (1, 2)],
        *[F.round(vx.norm(f"lsi{i}"), 6).alias(f"length{i}") for i in (1, 2)],
        *[F.round(vx.total(f"lda{i}"), 6).alias(f"total{i}") for i in (1, 2)], (fine("lda1") & fine("lda2")).alias("shares"))


add("k3_topic_vectors", sound_vectors,
    with_(TP, select="""SELECT qid1, qid2, CAST(5 AS INTEGER) AS k_lsi1, CAST(5 AS INTEGER) AS k_lsi2, CAST(1.0 AS DOUBLE) AS length1,
CAST(1.0 AS DOUBLE) AS length2, CAST(1.0 AS DOUBLE) AS total1, CAST(1.0 AS DOUBLE) AS total2, true AS shares FROM tp"""))


def within(columns, low, high):
    """Whether all columns lie in a range, give or take rounding."""
    inside = F.lit(True)
    for c in columns:
        inside = inside & c.between(low - 1e-6, high + 1e-6)
    return inside


def lsi_ranges(spark, sf_dir):
    """Cosine in [-1, 1], distances in their ranges, and what equal texts give."""
    c = topics.lsi_columns()
    same = F.col("question1") == F.col("question2")
    alike = within([c["lsi_cosine_sim"]], 1.0, 1.0) & within([c["lsi_l1_diff"], c["lsi_l2_diff"]], 0.0, 0.0)
    # of unit vectors the squared distance is 2 - 2 cos
    law = F.abs(c["lsi_l2_diff"] * c["lsi_l2_diff"] - (2.0 - 2.0 * c["lsi_cosine_sim"])) < 1e-6
    return topic_vectors(spark, sf_dir).select(
        "qid1", "qid2", within([c["lsi_cosine_sim"]], -1.0, 1.0).alias("cosine_fits"), within([c["lsi_l2_diff"]], 0.0, 2.0).alias("distance_fits"),
        law.alias("law_holds"), F.when(same, alike).alias("same_text"))


add("k4_lsi_pair_features", lsi_ranges,
    with_(TP, select="""SELECT qid1, qid2, true AS cosine_fits, true AS distance_fits, true AS law_holds,
CASE WHEN question1 = question2 THEN true END AS same_text FROM tp"""))


def lda_ranges(spark, sf_dir):
    """Similarities in [0, 1], distances in [0, 2], and what equal texts give."""
    c = topics.lda_columns()
    same = F.col("question1") == F.col("question2")
    alike = within([c["lda_cosine_sim"], c["lda_hellinger_sim"]], 1.0, 1.0) & within([c["lda_l1_diff"]], 0.0, 0.0)
    return topic_vectors(spark, sf_dir).select(
        "qid1", "qid2", within([c["lda_cosine_sim"], c["lda_hellinger_sim"]], 0.0, 1.0).alias("similarities_fit"),
        within([c["lda_l1_diff"]], 0.0, 2.0).alias("distance_fits"), F.when(same, alike).alias("same_text"))


add("k5_lda_pair_features", lda_ranges,
    with_(TP, select="""SELECT qid1, qid2, true AS similarities_fit, true AS distance_fits,
CASE WHEN question1 = question2 THEN true END AS same_text FROM tp"""))


def hellinger(spark, sf_dir):
    sizes = {f"emb{i}": F.transform(f"emb{i}", lambda x: F.abs(x.cast("double"))) for i in (1, 2)}
    return rounded(joined(spark, sf_dir).withColumns(sizes).select(
        "qid1", "qid2", vx.hellinger_similarity("emb1", "emb2").alias("hellinger_sim")))


add("k6_hellinger_sim", hellinger,
    with_(VP, VV, """ab AS (SELECT qid1, qid2, list_transform(u, lambda x: abs(x)) AS p, list_transform(v, lambda x: abs(x)) AS q FROM vv),
nm AS (SELECT *, list_sum(p) AS sp, list_sum(q) AS sq FROM ab),
rt AS (SELECT qid1, qid2, list_transform(p, lambda x: sqrt(x / sp)) AS p, list_transform(q, lambda x: sqrt(x / sq)) AS q FROM nm)""",
          select="SELECT qid1, qid2, " + r6("1.0 - list_distance(p, q) / sqrt(2.0)", "hellinger_sim") + " FROM rt"))


def diagnostics(spark, sf_dir):
    perplexity = lda(spark, sf_dir).log_perplexity(corpus(spark, sf_dir))
    kept = lsi(spark, sf_dir).explained_variance(texts(spark, sf_dir))
    return kept.select(F.col("explained_variance").between(0.0, 1.0).alias("share_fits"), (F.lit(perplexity) > 0).alias("perplexity_fits"))


add("k7_fit_diagnostics", diagnostics, "SELECT true AS share_fits, true AS perplexity_fits")


# ---- classifiers -------------------------------------------------------------
SCORES = "proba BETWEEN 0.0 AND 1.0 AS scored"
# Vector pairs whose documents there are, with their split.
FULL_SPLIT = ",\n".join([VP, """fp AS (SELECT * FROM vp WHERE qid1 IN (SELECT doc_id FROM documents) AND qid2 IN (SELECT doc_id FROM documents))""",
                         split_ctes("fp")])
SCORED_TEST = "WITH " + FULL_SPLIT + " SELECT qid1, qid2, label, true AS scored FROM sp WHERE split = 'test'"


def evaluated(model, source=full):
    """Held-out pairs and whether each has a probability, from a model trained on the training split."""
    def query(spark, sf_dir):
        pairs = materialize(source(spark, sf_dir), "pairs")
        split = materialize(splits.stratified_split(pairs.select("qid1", "qid2", "label")).drop("label"), "split")
        made = model()
        train = pairs.join(split.filter("split = 'train'"), ["qid1", "qid2"], "left_semi")
        matrix = materialize(made.build_features(pairs, train if made.needs_training_corpus else None)
                             .join(split, ["qid1", "qid2"]), "matrix")
        fitted = made.fit(matrix.filter("split = 'train'"))
        return fitted.predict_proba(matrix.filter("split = 'test'")).selectExpr("qid1", "qid2", "label", SCORES)

    return query


def embedded_turns(spark, sf_dir):
    """Conversation pairs with vectors made by the offline encoder, looked up by text."""
    pairs = samples.turn_pairs(spark, sf_dir)
    encoded = enrich.embed_texts(texts(spark, sf_dir).select("text"), enrich.hashing_encoder(DIM), key="text")
    return joins.attach_vectors_by_text(pairs, enrich.add_norm(encoded))


SMALL_A = dict(models.SMALL)
# Boosted presets that run as they are end when the loss on held-out training pairs rises.
STOP = models.EarlyStopping()
add("n2_logistic_regression", evaluated(lambda: models.logistic_regression(DIM)), SCORED_TEST)
add("n3_boosted_trees_a", evaluated(lambda: models.boosted_trees_a(DIM, DIMS, **SMALL_A)), SCORED_TEST)
add("n4_boosted_trees_b", evaluated(lambda: models.boosted_trees_b(DIM, DIMS, STOP)), SCORED_TEST)
add("n5_boosted_trees_classical", evaluated(
    lambda: models.boosted_trees_classical(DIM, DIMS, TOPICS, **SMALL_A), embedded_turns),
    with_(TP, split_ctes("tp"), select="SELECT qid1, qid2, label, true AS scored FROM sp WHERE split = 'test'"))
add("n6_random_forest", evaluated(lambda: models.random_forest(DIM, DIMS)), SCORED_TEST)
add("n7_random_forest_topk", evaluated(lambda: models.TopKForest(models.random_forest(DIM, DIMS), k=10)), SCORED_TEST)
add("n8_siamese", evaluated(lambda: models.Siamese()), SCORED_TEST)


def stopped_early(spark, sf_dir):
    """The full preset on the training split with a hold-out to stop on: each pair's part in it, and its score."""
    pairs = materialize(full(spark, sf_dir), "pairs")
    split = materialize(splits.stratified_split(pairs.select("qid1", "qid2", "label")).drop("label"), "split")
    model = models.boosted_trees_a(DIM, DIMS, early_stopping=models.EarlyStopping())
    matrix = materialize(model.build_features(pairs).join(split, ["qid1", "qid2"]), "matrix")
    train = matrix.filter("split = 'train'")
    fitted = model.fit(train)
    held = model.early_stopping.mark(train).select("qid1", "qid2", "is_validation")
    part = F.when(F.col("split") == "test", "test").when(F.col("is_validation"), "validation").otherwise("train")
    parts = matrix.select("qid1", "qid2", "split").join(held, ["qid1", "qid2"], "left").select("qid1", "qid2", part.alias("part"))
    stopped = F.lit(0 < fitted.n_trees < models.BOOSTED_A["n_estimators"])
    return fitted.predict_proba(matrix).join(parts, ["qid1", "qid2"]).selectExpr("qid1", "qid2", "label", "part", SCORES).withColumn("stopped", stopped)


add("n3_early_stopping", stopped_early, "WITH " + FULL_SPLIT + """,
tr AS (SELECT qid1, qid2, row_number() OVER (ORDER BY k, qid1, qid2) AS rn3, count(*) OVER () AS n3 FROM o WHERE rn > round(n * 0.2))
SELECT sp.qid1, sp.qid2, label, CASE WHEN split = 'test' THEN 'test' WHEN rn3 <= greatest(floor(n3 * 0.05), 1) THEN 'validation' ELSE 'train' END AS part,
true AS scored, true AS stopped FROM sp LEFT JOIN tr ON tr.qid1 = sp.qid1 AND tr.qid2 = sp.qid2""")


def forest(spark, sf_dir):
    model = models.random_forest(DIM, DIMS, **SMALL_A)
    matrix = materialize(model.build_features(full(spark, sf_dir)), "matrix")
    return model, matrix, model.fit(matrix)


def importances(spark, sf_dir):
    return forest(spark, sf_dir)[2].feature_importances()


NAMED = ", ".join(f"'{n}'" for n in models.fx.prefix_all_features(DIM, DIMS).names)
add("n9_feature_importances", lambda spark, sf_dir: importances(spark, sf_dir).select(
    "feature", F.col("importance").between(0.0, 1.0).alias("fits"), F.round(F.sum("importance").over(Window.partitionBy()), 6).alias("whole")),
    f"SELECT unnest([{NAMED}]) AS feature, true AS fits, CAST(1.0 AS DOUBLE) AS whole")
add("e4_rank_importances", lambda spark, sf_dir: rounded(ranking.rank_importances(importances(spark, sf_dir))))


def top_features(spark, sf_dir):
    model = models.TopKForest(models.random_forest(DIM, DIMS, **SMALL_A), k=10)
    fitted = model.fit(materialize(model.build_features(full(spark, sf_dir)), "matrix"))
    return rounded(ranking.rank_importances(fitted.feature_importances()))


add("e6_topk_features", top_features)


def tuned(spark, sf_dir):
    """A boosted model with parameters from a document; unknown names are recorded."""
    best = {"n_estimators": 5, "max_depth": 3, "learning_rate": 0.1, "reg_alpha": 0.03}
    model = models.boosted_trees_a(DIM, DIMS).apply_tuned_params(best, source="study", cv_score=0.5)
    matrix = materialize(model.build_features(full(spark, sf_dir)), "matrix")
    trees = model.with_params({"subsample": 1.0}).fit(matrix)
    return rounded(trees.predict_proba(matrix)).withColumn("ignored", F.lit(",".join(model.tuning["ignored"])))


add("n10_apply_tuned_params", tuned)


def full_classical(spark, sf_dir):
    pairs = materialize(embedded_turns(spark, sf_dir), "pairs")
    chosen = models.full_classical_features(pairs, DIM, DIMS, TOPICS)
    return rounded(chosen.apply(pairs).select("qid1", "qid2", *chosen.names))


add("h7_full_classical", full_classical)


# ---- stacking ----------------------------------------------------------------
def stack_parts(spark, sf_dir):
    """A linear and a network member over the vectors, with their feature tables."""
    pairs = joined(spark, sf_dir)
    members = [models.CosineThreshold(), models.Siamese(hidden=4, max_iter=5)]
    made = ensemble.Ensemble(members, "stacking", meta_folds=3, name="stack")
    return made, made.build_features(pairs)


def stacked(spark, sf_dir):
    made, matrices = stack_parts(spark, sf_dir)
    return made.fit(matrices).predict_proba(matrices).selectExpr("qid1", "qid2", "label", SCORES)


def oof_coverage(spark, sf_dir):
    """Key, class and fold of every out-of-fold row, and whether all scores are there."""
    made, matrices = stack_parts(spark, sf_dir)
    folds = splits.stratified_kfold(samples.vector_pairs(spark, sf_dir), 5)
    oof = ensemble.out_of_fold(made.members, matrices, folds, 5)
    complete = (F.col("p0").isNotNull() & F.col("p1").between(0.0, 1.0)).cast("int")
    return oof.select("qid1", "qid2", "label", "fold", complete.alias("complete"))


def stack_report(spark, sf_dir):
    made, matrices = stack_parts(spark, sf_dir)
    return made.fit(matrices).report(made.members).select("position", "member", F.col("coefficient").isNotNull().alias("fitted"))


add("o3_stacking", stacked, with_(VP, select="SELECT qid1, qid2, label, true AS scored FROM vp"))
add("o4_out_of_fold", oof_coverage,
    with_(VP, split_ctes("vp"), select="SELECT qid1, qid2, label, fold, CAST(1 AS INTEGER) AS complete FROM sp"))
add("o5_ensemble_report", stack_report, """SELECT CAST(p AS INTEGER) AS position, m AS member, true AS fitted
FROM (VALUES (0, 'CosineThreshold'), (1, 'Siamese')) v(p, m)""")


def preset_scores(spark, sf_dir):
    made = ensemble.preset("trees_mean", DIM, DIMS, small=True)
    matrices = made.build_features(full(spark, sf_dir))
    return made.fit(matrices).predict_proba(matrices).selectExpr("qid1", "qid2", "label", SCORES)


add("o6_preset_trees_mean", preset_scores, "WITH " + FULL_SPLIT + " SELECT qid1, qid2, label, true AS scored FROM fp")

# ---- search ------------------------------------------------------------------
CANDIDATES = [{"C": 0.01}, {"C": 1.0}, {"C": 100.0}]


def vector_logistic():
    """Logistic regression on the prefix statistics of the vectors alone."""
    from pairkit.operators import features as fx

    return models.PairModel("LogisticRegression", lambda _: fx.prefix_features(DIM, (DIM,)), models._linear,
                            models.LINEAR_NAMES, {"max_iter": 5}, weights="balanced",
                            param_space=models.LINEAR_SPACE)


def searched(spark, sf_dir, prune, candidates=None, n=3, parallelism=3):
    folder = scratch_path(spark, "study")
    jobs.tune(spark, joined(spark, sf_dir), vector_logistic(), "run", f"{folder}/split", folder, n_trials=n, k=3,
              candidates=candidates, prune=prune, parallelism=parallelism)
    return folder


def study_rows(spark, folder, *extra):
    """Trials, with what each must have: a score and a time for every fold, all folds unless it was dropped."""
    found = spark.read.schema(search.TRIAL_SCHEMA).parquet(f"{folder}/run/study")
    folds = F.when(F.col("state") == "COMPLETE", F.col("n_folds") == 3).otherwise(F.col("n_folds") < 3)
    mean = F.abs(F.aggregate("fold_scores", F.lit(0.0), lambda a, x: a + x) / F.size("fold_scores") - F.col("value")) < 1e-9
    sound = (folds & mean & (F.size("fold_seconds") == F.col("n_folds")) & F.col("value").between(0.0, 1.0)
             & F.forall("fold_seconds", lambda x: x > 0))
    return found.select("trial_number", sound.alias("sound"), *extra)


def drawn(spark, sf_dir):
    """Sampled candidates lie in the space they are drawn from and differ."""
    rows = study_rows(spark, searched(spark, sf_dir, False, n=2), "params")
    value = F.get_json_object("params", "$.C").cast("double")
    return rows.select("trial_number", "sound", value.between(0.001, 100.0).alias("in_space"))


STUDY = """SELECT CAST(t AS INTEGER) AS trial_number, true AS sound, p AS params FROM (VALUES (0, '{"C":0.01}'), (1, '{"C":1.0}'), (2, '{"C":100.0}')) v(t, p)"""
add("p1_sample_params", drawn, "SELECT CAST(i AS INTEGER) AS trial_number, true AS sound, true AS in_space FROM range(2) r(i)")
add("p2_cv_search", lambda spark, sf_dir: study_rows(spark, searched(spark, sf_dir, False, CANDIDATES), "state", "params"),
    STUDY.replace("p AS params", "'COMPLETE' AS state, p AS params"))
add("p3_early_elimination", lambda spark, sf_dir: study_rows(spark, searched(spark, sf_dir, True, CANDIDATES), "params"), STUDY)


def resumed(spark, sf_dir):
    """A second call with one more candidate only runs that one."""
    folder = searched(spark, sf_dir, False, CANDIDATES[:1])
    jobs.tune(spark, joined(spark, sf_dir), vector_logistic(), "run", f"{folder}/split", folder, k=3,
              candidates=CANDIDATES[:2], prune=False)
    return study_rows(spark, folder, "state", "params")


add("p4_resumed_study", resumed, STUDY.replace("p AS params", "'COMPLETE' AS state, p AS params") + " WHERE t < 2")


def train_only(spark, sf_dir):
    """Keys a search may see: the training rows of the saved split, with their folds."""
    pairs = samples.vector_pairs(spark, sf_dir)
    split = splits.get_split(spark, scratch_path(spark, "split"), pairs)
    train = split.filter("split = 'train'").select("qid1", "qid2", "label")
    return splits.stratified_kfold(train, 5)


add("p6_train_only_folds", train_only,
    with_(VP, split_ctes("vp"), """tr AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k, qid1, qid2) AS rn2
  FROM o WHERE rn > round(n * 0.2))""",
          select="SELECT qid1, qid2, label, CAST((rn2 - 1) % 5 AS INTEGER) AS fold FROM tr"))


# ---- whole runs --------------------------------------------------------------
def experiment(spark, sf_dir):
    """Evaluate the cosine detector as a job and read its artefacts back."""
    folder = scratch_path(spark, "run")
    jobs.run_experiment(spark, full(spark, sf_dir), models.CosineThreshold(threshold=0.05), "cosine",
                        f"{folder}/split", folder)
    ledger = spark.read.parquet(f"{folder}/all_experiments")
    errors = spark.read.csv(f"{folder}/cosine/errors", header=True, multiLine=True, quote='"', escape='"')
    return ledger.select("model", "test_size", "TP", "FP", "TN", "FN").crossJoin(
        errors.agg(F.count(F.lit(1)).alias("n_errors")))


add("r4_run_artefacts", experiment,
    with_(SCORED, split_ctes("vp"), """t AS (SELECT s.label, CASE WHEN proba >= 0.05 THEN 1 ELSE 0 END AS pred
  FROM scored s JOIN sp ON sp.qid1 = s.qid1 AND sp.qid2 = s.qid2 WHERE split = 'test')""",
          select="""SELECT 'CosineThreshold' AS model, count(*) AS test_size,
count(*) FILTER (WHERE label = 1 AND pred = 1) AS TP, count(*) FILTER (WHERE label = 0 AND pred = 1) AS FP,
count(*) FILTER (WHERE label = 0 AND pred = 0) AS TN, count(*) FILTER (WHERE label = 1 AND pred = 0) AS FN,
count(*) FILTER (WHERE label <> pred) AS n_errors FROM t"""))


class LengthRatio:
    """A user's own model: how close the lengths of both texts are."""

    name, threshold, needs_training_corpus = "LengthRatio", 0.9, False

    def build_features(self, pairs, train=None):
        lengths = [F.length(f"question{i}").cast("double") for i in (1, 2)]
        return pairs.select("qid1", "qid2", "label", (F.least(*lengths) / F.greatest(*lengths, F.lit(1.0))).alias("ratio"))

    def fit(self, matrix):
        return self

    def predict_proba(self, matrix):
        return matrix.select("qid1", "qid2", "label", F.col("ratio").alias("proba"))


def user_model(spark, sf_dir):
    model = LengthRatio()
    matrix = model.build_features(samples.turn_pairs(spark, sf_dir))
    return rounded(model.fit(matrix).predict_proba(matrix))


add("s2_user_model", user_model,
    with_(TP, select="SELECT qid1, qid2, label, " + r6(
        "least(length(question1), length(question2)) / CAST(greatest(length(question1), length(question2), 1) AS DOUBLE)",
        "proba") + " FROM tp"))


def scored_unlabelled(spark, sf_dir):
    """Vector pairs train the cosine detector, document pairs are scored by it."""
    labelled = joined(spark, sf_dir)
    links = samples.document_links(spark, sf_dir).withColumn("test_id", F.expr("qid1 * 2147483648 + qid2"))
    unlabelled = joins.attach_vectors(links, samples.vectors(spark, sf_dir)).select("test_id", "emb1", "emb2")
    return jobs.score_all(labelled.select("qid1", "qid2", "label", "emb1", "emb2"), unlabelled,
                          models.CosineThreshold(), ids=links, default=0.5)


from checks.core import SQL  # noqa: E402
from checks.table_checks import submitted  # noqa: E402,F401

add("d4_score_all", scored_unlabelled, SQL["r3_submission"])


def fitted_featurizer(spark, sf_dir):
    """Word weights fitted on training pairs only, used on the held-out ones."""
    from pairkit.operators import sparse_pairs, weighting

    pairs, docs = samples.document_keys(spark, sf_dir), samples.documents(spark, sf_dir)
    split = materialize(splits.stratified_split(pairs).drop("label"), "split")

    def part(table, name):
        return table.join(split.filter(F.col("split") == name), ["qid1", "qid2"], "left_semi")

    links = samples.document_links(spark, sf_dir)
    train, test = (samples.distinct_texts_of(part(links, name), docs) for name in ("train", "test"))
    model = weighting.fit_tfidf(train)
    return rounded(sparse_pairs.word_features(model, texts=test).apply(part(pairs, "test")).select(
        "qid1", "qid2", "tfidf_cosine_sim", "weighted_word_overlap"))


TRAINED = ",\n".join([DP, split_ctes("dp"), "ro AS (SELECT dp.*, split FROM dp JOIN sp USING (qid1, qid2))"])
add("s3_fitted_featurizer", fitted_featurizer, "WITH " + TRAINED + f""",
txt AS (SELECT md5(text) AS text_id, text, count(*) FILTER (WHERE split = 'train') AS n, bool_or(split = 'test') AS asked
  FROM (SELECT question1 AS text, split FROM ro UNION ALL SELECT question2, split FROM ro) GROUP BY text),
occ AS (SELECT text_id, n, asked, unnest({word_tokens('text')}) AS term FROM txt),
cnt AS (SELECT text_id, n, asked, term, count(*) AS tf FROM occ GROUP BY ALL),
vocab AS (SELECT term, ln((1.0 + (SELECT sum(n) FROM txt)) / (1.0 + sum(n))) + 1.0 AS idf FROM cnt WHERE n > 0 GROUP BY term),
raw AS (SELECT text_id, cnt.term, coalesce(idf, 0.0) AS idf, coalesce((1.0 + ln(CAST(tf AS DOUBLE))) * idf, 0.0) AS w
  FROM cnt LEFT JOIN vocab USING (term) WHERE asked),
nrm AS (SELECT text_id, sqrt(sum(w * w)) AS len_ FROM raw GROUP BY text_id),
al AS (SELECT text_id, term, idf, CASE WHEN len_ > 0 THEN w / len_ ELSE 0.0 END AS w FROM raw JOIN nrm USING (text_id)),
keys AS (SELECT qid1, qid2, md5(question1) AS k1, md5(question2) AS k2 FROM ro WHERE split = 'test'),
sd AS (SELECT qid1, qid2, 1 AS side, term, idf, w FROM keys JOIN al ON text_id = k1
  UNION ALL SELECT qid1, qid2, 2, term, idf, w FROM keys JOIN al ON text_id = k2),
pt AS (SELECT qid1, qid2, term, max(idf) AS idf, count(*) AS sides, coalesce(max(CASE WHEN side = 1 THEN w END), 0.0) AS w1,
  coalesce(max(CASE WHEN side = 2 THEN w END), 0.0) AS w2 FROM sd GROUP BY qid1, qid2, term)
SELECT qid1, qid2, {r6('coalesce(sum(w1 * w2), 0)', 'tfidf_cosine_sim')}, {r6(
    'CASE WHEN sum(idf) > 0 THEN coalesce(sum(idf) FILTER (WHERE sides = 2), 0) / sum(idf) ELSE 0 END', 'weighted_word_overlap')}
FROM keys LEFT JOIN pt USING (qid1, qid2) GROUP BY qid1, qid2""")
