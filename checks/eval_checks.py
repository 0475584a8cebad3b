"""Splits, weights, metrics, ensembling by averages, and search bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.core import (CELLS, DP, METRIC_SELECT, METRICS, SCORED, VP, add, r6, rounded,
                         split_ctes, with_)
from checks.table_checks import MEMBERS, members
from checks.vector_checks import cosine_scores
from pairkit.operators import ensemble, evaluate, ranking, search, splits
from pairkit.plans import samples
from pairkit.session import scratch_path
from pairkit.sources import stores

CUT = 0.05
DECIDED = SCORED + f""",
d AS (SELECT *, CAST(CASE WHEN proba >= {CUT} THEN 1 ELSE 0 END AS INTEGER) AS pred FROM scored)"""


def decided(spark, sf_dir):
    return evaluate.decide(cosine_scores(spark, sf_dir), CUT)


# ---- splits ------------------------------------------------------------------
for suffix, pairs, cte, source in (("", samples.vector_pairs, VP, "vp"), ("_documents", samples.document_pairs, DP, "dp")):
    add(f"l1_stratified_split{suffix}",
        lambda spark, sf_dir, pairs=pairs: splits.stratified_split(pairs(spark, sf_dir)),
        with_(cte, split_ctes(source), select="SELECT qid1, qid2, label, split FROM sp"))
    add(f"l4_stratified_kfold{suffix}",
        lambda spark, sf_dir, pairs=pairs: splits.stratified_kfold(pairs(spark, sf_dir), 5),
        with_(cte, split_ctes(source), select="SELECT qid1, qid2, label, fold FROM sp"))


def persisted_split(spark, sf_dir):
    """The second call finds the split that the first one saved."""
    path = scratch_path(spark, "split")
    pairs = samples.vector_pairs(spark, sf_dir)
    splits.get_split(spark, path, pairs)
    return splits.get_split(spark, path, pairs)


add("l2_persisted_split", persisted_split,
    with_(VP, split_ctes("vp"), select="SELECT qid1, qid2, label, split FROM sp"))
add("l3_split_profile",
    lambda spark, sf_dir: rounded(splits.split_profile(splits.stratified_split(samples.vector_pairs(spark, sf_dir)))),
    with_(VP, split_ctes("vp"), select=f"""SELECT split, count(*) AS n,
{r6('100.0 * count(*) / (SELECT count(*) FROM sp)', 'pct')}, CAST(sum(label) AS BIGINT) AS n_positive,
{r6('avg(label)', 'positive_rate')} FROM sp GROUP BY split"""))
add("l5_validation_holdout",
    lambda spark, sf_dir: splits.validation_holdout(samples.vector_pairs(spark, sf_dir), 0.05).select(
        "qid1", "qid2", F.col("is_validation").cast("int").alias("is_validation")),
    with_(VP, split_ctes("vp"), select="""SELECT qid1, qid2, CAST(CASE WHEN rn_all <= greatest(floor(n_all * 0.05), 1)
THEN 1 ELSE 0 END AS INTEGER) AS is_validation FROM o"""))
add("l6_class_weights",
    lambda spark, sf_dir: rounded(splits.class_weights(samples.vector_pairs(spark, sf_dir))),
    with_(VP, "c AS (SELECT label, count(*) AS n FROM vp GROUP BY label)",
          select=f"""SELECT label, n, {r6('(SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)', 'balanced')},
{r6("CASE WHEN label = 1 THEN least(2.0, (SELECT sum(n) FROM c WHERE label = 0) / (SELECT sum(n) FROM c WHERE label = 1)) ELSE 1 END", 'positive_weight')} FROM c"""))

# ---- metrics -----------------------------------------------------------------
add("q1_confusion", lambda spark, sf_dir: evaluate.confusion(decided(spark, sf_dir)),
    with_(DECIDED, select=f"SELECT {CELLS} FROM d"))
add("q2_metrics", lambda spark, sf_dir: rounded(evaluate.metrics(decided(spark, sf_dir))),
    with_(DECIDED, f"cm AS (SELECT {CELLS} FROM d)", f"m AS (SELECT tp, fp, tn, fn, {METRICS} FROM cm)",
          select=f"SELECT {METRIC_SELECT} FROM m"))
add("q3_classification_report",
    lambda spark, sf_dir: rounded(evaluate.classification_report(decided(spark, sf_dir))),
    with_(DECIDED, """pc AS (
  SELECT c AS cls, count(*) FILTER (WHERE label = c AND pred = c) AS hit,
         count(*) FILTER (WHERE label <> c AND pred = c) AS extra,
         count(*) FILTER (WHERE label = c AND pred <> c) AS miss
  FROM d, (VALUES (0), (1)) classes(c) GROUP BY c),
pm AS (SELECT CAST(cls AS VARCHAR) AS row, coalesce(hit / nullif(CAST(hit + extra AS DOUBLE), 0), 0) AS precision_,
         coalesce(hit / nullif(CAST(hit + miss AS DOUBLE), 0), 0) AS recall_,
         coalesce(2 * hit / nullif(CAST(2 * hit + extra + miss AS DOUBLE), 0), 0) AS f1_, hit + miss AS support FROM pc),
al AS (
  SELECT * FROM pm
  UNION ALL SELECT 'macro avg', avg(precision_), avg(recall_), avg(f1_), sum(support) FROM pm
  UNION ALL SELECT 'weighted avg', sum(precision_ * support) / sum(support), sum(recall_ * support) / sum(support),
                   sum(f1_ * support) / sum(support), sum(support) FROM pm
  UNION ALL SELECT 'accuracy', a, a, a, n FROM (
    SELECT avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS a, count(*) AS n FROM d))""",
          select=f"""SELECT row, {r6('precision_', 'precision')}, {r6('recall_', 'recall')}, {r6('f1_', 'f1')},
CAST(support AS BIGINT) AS support FROM al"""))


def error_rows(spark, sf_dir):
    from pairkit.operators import joins  # noqa: F401

    return evaluate.error_table(samples.with_texts(decided(spark, sf_dir), samples.documents(spark, sf_dir)))


add("q4_error_table", error_rows,
    with_(DECIDED, select="""SELECT qid1, qid2, a.text AS question1, b.text AS question2, d.label AS true_label,
pred AS pred_label, printf('%.6f', proba) AS pred_prob, CASE WHEN d.label = 1 THEN 'FN' ELSE 'FP' END AS error_type
FROM d JOIN documents a ON a.doc_id = qid1 JOIN documents b ON b.doc_id = qid2 WHERE d.label <> pred"""))
add("q5_score_profile", lambda spark, sf_dir: rounded(evaluate.score_profile(cosine_scores(spark, sf_dir))),
    with_(SCORED, select=f"SELECT {r6('min(proba)', 'min_proba')}, {r6('max(proba)', 'max_proba')}, {r6('avg(proba)', 'mean_proba')} FROM scored"))

CUTS = (0.0, 0.05, 0.1)


def ledger(spark, sf_dir):
    """Three runs appended to one ledger, ranked by F1."""
    path = scratch_path(spark, "ledger")
    scored = cosine_scores(spark, sf_dir)
    for cut in CUTS:
        row = evaluate.ledger_row(evaluate.decide(scored, cut), "2024-01-01 00:00:00", f"cut_{cut}", "cosine", 1, cut)
        stores.append_ledger(row, path)
    return evaluate.compare_runs(spark.read.parquet(path))


add("q6_experiment_ledger", ledger,
    with_(SCORED, "cuts AS (SELECT CAST(unnest([0.0, 0.05, 0.1]) AS DOUBLE) AS threshold)",
          "t AS (SELECT threshold, label, CASE WHEN proba >= threshold THEN 1 ELSE 0 END AS pred FROM scored, cuts)",
          f"cm AS (SELECT threshold, {CELLS} FROM t GROUP BY threshold)",
          f"m AS (SELECT threshold, tp, fp, tn, fn, {METRICS} FROM cm)",
          select="""SELECT '2024-01-01 00:00:00' AS run_at, 'cut_' || CAST(threshold AS VARCHAR) AS experiment_name,
'cosine' AS model, CAST(1 AS INTEGER) AS n_features, threshold, tp + fp + tn + fn AS test_size,
round(accuracy, 4) AS accuracy, round(prec, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1,
tp AS TP, fp AS FP, tn AS TN, fn AS FN, CAST(rank() OVER (ORDER BY round(f1, 4) DESC) AS INTEGER) AS rank FROM m"""))
SWEEP = SCORED + f""",
lv AS (SELECT proba AS threshold, count(*) AS n, sum(label) AS pos FROM scored GROUP BY proba),
cu AS (SELECT threshold, sum(n) OVER w AS called, sum(pos) OVER w AS tp, sum(n) OVER () AS n_all, sum(pos) OVER () AS pos_all
  FROM lv WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
cm AS (SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(called - tp AS BIGINT) AS fp,
         CAST(n_all - pos_all - called + tp AS BIGINT) AS tn, CAST(pos_all - tp AS BIGINT) AS fn FROM cu),
m AS (SELECT threshold, tp, fp, tn, fn, {METRICS} FROM cm)"""
add("q8_threshold_sweep", lambda spark, sf_dir: rounded(evaluate.threshold_sweep(cosine_scores(spark, sf_dir))),
    with_(SWEEP, select=f"SELECT threshold, {METRIC_SELECT} FROM m"))
add("q8_best_threshold", lambda spark, sf_dir: rounded(evaluate.best_threshold(cosine_scores(spark, sf_dir))),
    with_(SWEEP, select=f"SELECT threshold, {r6('f1', 'f1')} FROM m ORDER BY f1 DESC, threshold DESC LIMIT 1"))

# ---- averages ----------------------------------------------------------------
for key, weights in {"o1_mean": None, "o2_weighted_mean": (2.0, 2.0, 1.0)}.items():
    w = weights or (1.0, 1.0, 1.0)
    add(key, lambda spark, sf_dir, weights=weights: rounded(
        ensemble.average(members(spark, sf_dir), weights).select("qid1", "qid2", "label", "proba")),
        with_(MEMBERS, select="SELECT qid1, qid2, label, " + r6(
            f"({w[0]} * p0 + {w[1]} * p1 + {w[2]} * p2) / {sum(w)}", "proba") + " FROM mem"))

# ---- trials: the cosine threshold as the searched parameter ---------------------
GRID = (-0.2, -0.1, 0.0, 0.05, 0.1, 0.2, 0.9)


def fold_scores(spark, sf_dir):
    """F1 of every threshold of the grid on every fold of the training rows."""
    scored = cosine_scores(spark, sf_dir)
    folds = splits.stratified_kfold(samples.vector_pairs(spark, sf_dir), 5).drop("label")
    return search.threshold_fold_scores(scored.join(folds, ["qid1", "qid2"]), GRID)


def trials(spark, sf_dir):
    return search.trials_from_folds(fold_scores(spark, sf_dir))


FOLDS = SCORED + ",\n" + split_ctes("vp") + f""",
grid AS (SELECT CAST(generate_subscripts(g, 1) - 1 AS INTEGER) AS trial_number, CAST(unnest(g) AS DOUBLE) AS t
  FROM (SELECT {list(GRID)} AS g)),
pf AS (SELECT trial_number, t, fold, s.label, CASE WHEN proba >= t THEN 1 ELSE 0 END AS pred
  FROM scored s JOIN sp ON sp.qid1 = s.qid1 AND sp.qid2 = s.qid2, grid),
cm AS (SELECT trial_number, t, fold, {CELLS} FROM pf GROUP BY trial_number, t, fold),
fs AS (SELECT trial_number, t, fold, CASE WHEN tp + fp = 0 THEN NULL ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END AS score FROM cm),
tr AS (SELECT trial_number, t, avg(score) AS value, count(score) AS n_folds,
         CASE WHEN count(score) = 5 THEN 'COMPLETE' ELSE 'PRUNED' END AS state FROM fs GROUP BY trial_number, t)"""
PARAMS = "'{\"threshold\":' || CAST(t AS VARCHAR) || '}'"
add("q7_fold_mean", lambda spark, sf_dir: rounded(evaluate.fold_means(
    fold_scores(spark, sf_dir).filter("score is not null"))),
    with_(FOLDS, select=f"SELECT trial_number, {r6('avg(score)', 'value')}, count(*) AS n_folds FROM fs WHERE score IS NOT NULL GROUP BY trial_number"))
add("e5_rank_trials", lambda spark, sf_dir: rounded(ranking.rank_trials(trials(spark, sf_dir)).select(
    "trial_number", "value", "state", "rank")),
    with_(FOLDS, select=f"""SELECT trial_number, {r6('value', 'value')}, state,
CAST(rank() OVER (ORDER BY value DESC NULLS LAST) AS INTEGER) AS rank FROM tr"""))
add("e8_best_trial", lambda spark, sf_dir: rounded(ranking.best_trial(trials(spark, sf_dir))),
    with_(FOLDS, select=f"SELECT trial_number, {r6('value', 'value')}, {PARAMS} AS params FROM tr WHERE value IS NOT NULL AND state = 'COMPLETE' ORDER BY value DESC, trial_number LIMIT 1"))
add("p5_trials_summary", lambda spark, sf_dir: rounded(search.summarize(trials(spark, sf_dir))),
    with_(FOLDS, select=f"""SELECT count(*) AS n_trials, count(*) FILTER (WHERE state = 'COMPLETE') AS n_complete,
count(*) FILTER (WHERE state = 'PRUNED') AS n_pruned, {r6("max(value) FILTER (WHERE state = 'COMPLETE')", 'best_value')}, {r6("avg(value) FILTER (WHERE state = 'COMPLETE')", 'mean_value')},
{r6("stddev_pop(value) FILTER (WHERE state = 'COMPLETE')", 'std_value')} FROM tr"""))


def stored_trials(spark, sf_dir):
    """Trials and best parameters written as documents and read back."""
    folder = scratch_path(spark, "trials")
    found = trials(spark, sf_dir)
    stores.write_trials(spark, folder, found, search.best_document(found, "cosine", "grid"))
    return rounded(spark.read.schema("trial_number int, value double, state string").json(f"{folder}/trials")), folder


add("r5_trials", lambda spark, sf_dir: stored_trials(spark, sf_dir)[0],
    with_(FOLDS, select=f"SELECT trial_number, {r6('value', 'value')}, state FROM tr"))


def best_params(spark, sf_dir):
    doc = stores.read_params(spark, f"{stored_trials(spark, sf_dir)[1]}/best_params", "cosine")
    return rounded(spark.createDataFrame(
        [(doc["model"], doc["matches"], doc["best_score"], doc["best_params"]["threshold"])],
        "model string, matches boolean, best_score double, threshold double"))


add("a7_read_params", best_params,
    with_(FOLDS, select=f"SELECT 'cosine' AS model, true AS matches, {r6('value', 'best_score')}, t AS threshold FROM tr WHERE value IS NOT NULL AND state = 'COMPLETE' ORDER BY value DESC, trial_number LIMIT 1"))
