import dataclasses
import random
import threading
import time

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from checks import model_checks
from pairkit.operators import dictionary, enrich, ensemble, models, networks, search, splits, topics, weighting
from pairkit.plans import jobs
from pairkit.session import scratch_path
from pairkit.sources import stores

DIM = 8


@pytest.fixture(scope="module")
def pairs(spark):
    """Half the pairs are noisy copies of a vector and of a text."""
    rng, rand = np.random.default_rng(1), random.Random(1)
    words = "how what why is are the cat dog tree house river blue green fast slow big small".split()
    rows = []
    for i in range(160):
        u, same = rng.normal(size=DIM), int(i % 2 == 0)
        v = u + 0.2 * rng.normal(size=DIM) if same else rng.normal(size=DIM)
        a = [rand.choice(words) for _ in range(6)]
        b = a[:5] + [rand.choice(words)] if same else [rand.choice(words) for _ in range(6)]
        rows.append((2 * i, 2 * i + 1, " ".join(a), " ".join(b), same, u.tolist(), v.tolist()))
    df = spark.createDataFrame(rows, "qid1 bigint, qid2 bigint, question1 string, question2 string, label int, "
                               "emb1 array<float>, emb2 array<float>")
    from pairkit.functions import vectors as vx
    from pairkit.session import materialize

    return materialize(df.withColumns({"norm1": vx.norm("emb1"), "norm2": vx.norm("emb2")}), "pairs")


def auc(scored):
    return BinaryClassificationEvaluator(rawPredictionCol="proba", labelCol="label").evaluate(scored)


@pytest.mark.parametrize("make", [
    lambda: models.logistic_regression(DIM, max_iter=20), lambda: models.boosted_trees_a(DIM, (4,), **models.SMALL),
    lambda: models.random_forest(DIM, (4,), **models.SMALL), lambda: models.Siamese(hidden=4, max_iter=20),
    lambda: models.TopKForest(models.random_forest(DIM, (4,), **models.SMALL), k=5)])
def test_models_beat_chance_and_give_probabilities(pairs, make):
    model = make()
    matrix = model.build_features(pairs).cache()
    scored = model.fit(matrix).predict_proba(matrix)
    assert scored.columns == ["qid1", "qid2", "label", "proba"] and scored.count() == 160
    assert scored.filter("proba < 0 or proba > 1").count() == 0 and auc(scored) > 0.9


def test_importances_are_named(pairs):
    model = models.TopKForest(models.random_forest(DIM, (4,), **models.SMALL), k=5)
    fitted = model.fit(model.build_features(pairs))
    rows = fitted.feature_importances().collect()
    assert len(rows) == 5 and sum(r.importance for r in rows) == pytest.approx(1.0)
    assert model.get_config()["top_k"] == 5 and len(model.selected) == 5


def test_tuned_params_are_translated():
    model = models.boosted_trees_a(DIM).apply_tuned_params(
        {"n_estimators": 945, "max_depth": 12, "min_child_weight": 6, "learning_rate": 0.03, "reg_alpha": 0.1,
         "colsample_bytree": 0.6, "subsample": 0.7}, source="file", cv_score=0.83)
    known, _ = models.translate(model.params, model.param_names)
    assert known == {"maxIter": 945, "maxDepth": 12, "minInstancesPerNode": 6, "stepSize": 0.03,
                     "featureSubsetStrategy": "0.6", "subsamplingRate": 0.7}
    assert model.tuning["enabled"] and model.tuning["ignored"] == ["reg_alpha"]


def test_average_lies_between_members(pairs):
    base = pairs.select("qid1", "qid2", "label", (F.col("qid1") % 10 / 10.0).alias("proba"))
    other = base.withColumn("proba", F.lit(0.5))
    rows = ensemble.average([base, other], [3.0, 1.0]).collect()
    assert len(rows) == 160
    assert all(r.proba == pytest.approx(0.75 * r.p0 + 0.25 * r.p1) and r.agree for r in rows)
    with pytest.raises(ValueError):
        ensemble.average([base, other], [1.0])


def test_stacking_scores_every_row_once_out_of_fold(pairs):
    made = ensemble.Ensemble([models.CosineThreshold(), models.Siamese(hidden=3, max_iter=5)], "stacking", meta_folds=3)
    matrices = made.build_features(pairs)
    fitted = made.fit(matrices)
    assert made.oof.count() == made.oof.select("qid1", "qid2").distinct().count() == 160
    assert auc(fitted.predict_proba(matrices)) > 0.9
    assert [r.member for r in fitted.report(made.members).orderBy("position").collect()] == ["CosineThreshold", "Siamese"]


def test_presets_are_complete():
    for name, (members, strategy, weights) in ensemble.PRESETS.items():
        made = ensemble.preset(name, DIM, small=True)
        assert len(made.members) == len(members) and made.strategy == strategy
        assert made.needs_training_corpus == ("boosted_classical" in members)


def test_topics(spark, pairs):
    corpus = dictionary.corpus(pairs)
    lsi, lda = topics.fit_lsi(corpus, 3), topics.fit_lda(corpus, 3, 3)
    texts = dictionary.distinct_texts(corpus)
    assert 0.0 < lsi.explained_variance(texts).first()[0] <= 1.0
    rows = topics.topic_features(lsi, lda).apply(pairs).collect()
    assert len(rows) == 160
    assert all(-1.000001 <= r.lsi_cosine_sim <= 1.000001 and 0 <= r.lda_hellinger_sim <= 1.000001 for r in rows)
    same = [r for r in rows if r.question1 == r.question2]
    assert all(r.lsi_l1_diff == pytest.approx(0, abs=1e-9) for r in same)


def weight_matrix(texts):
    """Unit-length sublinear term weights, by hand."""
    words = sorted({w for t in texts for w in t.split()})
    df = {w: sum(w in t.split() for t in texts) for w in words}
    out = np.array([[(1 + np.log(c)) * (np.log((1 + len(texts)) / (1 + df[w])) + 1) if (c := t.split().count(w)) else 0.0
                     for w in words] for t in texts])
    return out / np.linalg.norm(out, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def planted(spark):
    """Texts of three groups of words that no other group has, and one text of a word alone."""
    rng = random.Random(1)
    texts = [" ".join(f"t{i % 3}w{rng.randrange(12)}" for _ in range(25)) for i in range(60)] + ["alone"]
    return texts, spark.createDataFrame([(t,) for t in texts], "text string")


@pytest.mark.parametrize("k", [4, 100])
def test_lsi_finds_the_leading_singular_space(planted, k):
    texts, corpus = planted
    model = topics.fit_lsi(corpus, k)
    weights = weight_matrix(texts)
    values = np.linalg.svd(weights)[1]
    rank = int((values > 1e-9).sum())
    assert model.k == min(k, rank) and model.singular_values == pytest.approx(values[:model.k], abs=1e-5)
    loads = {r.term: r.load for r in model.loadings.collect()}
    assert len(loads) == 37  # every term, however rare
    basis = np.array([loads[w] for w in sorted(loads)])
    assert basis.T @ basis == pytest.approx(np.eye(model.k), abs=1e-8)
    if k == 100:  # at full rank nothing is lost
        distinct = dictionary.distinct_texts(corpus)
        found = {r.text: r.lsi for r in model.transform(distinct).join(distinct, "text_id").collect()}
        vectors = np.array([found[t] for t in texts])
        assert vectors @ vectors.T == pytest.approx(weights @ weights.T, abs=1e-8)
        assert model.explained_variance(distinct).first()[0] == pytest.approx(1.0)


def test_topic_mixture_recovers_planted_topics_with_rising_likelihood(spark, planted):
    texts, corpus = planted
    model = topics.fit_lda(corpus, 3, 15, weights="counts")
    fits = model.log_likelihoods
    assert len(fits) > 2 and all(b >= a - 1e-9 * abs(a) for a, b in zip(fits, fits[1:]))
    distinct = dictionary.distinct_texts(corpus).unionByName(spark.createDataFrame([("none", "unknown words", 1)], "text_id string, text string, n bigint"))
    found = {r.text: r.lda for r in model.transform(distinct).join(distinct, "text_id").collect()}
    assert all(sum(v) == pytest.approx(1.0) for v in found.values()) and found["unknown words"] == pytest.approx([1 / 3] * 3)
    groups = [int(np.argmax(found[t])) for t in texts[:60]]
    assert len(set(groups)) == 3 and groups == [groups[i % 3] for i in range(60)]
    assert model.topics.count() == 37
    assert model.log_perplexity(corpus) < np.log(37)


def test_topics_are_the_same_where_tasks_hold_few_terms(planted, monkeypatch):
    """Terms beyond those that tasks hold are joined to the texts round by round."""
    texts, corpus = planted
    texts = [t if i % 7 else f"{t} rare{i}" for i, t in enumerate(texts)]
    corpus = corpus.sparkSession.createDataFrame([(t,) for t in texts + texts[:9] + [None, ""]], "text string")
    distinct = dictionary.distinct_texts(corpus)

    def found():
        lsi, lda = topics.fit_lsi(corpus, 4, max_rounds=4), topics.fit_lda(corpus, 3, 2)
        raw = {r.text_id: r.raw for r in lsi._raw(distinct).collect()}
        shares = {r.text_id: r.lda for r in lda.transform(distinct).collect()}
        mixed = {r.term: r.load for r in lda.topics.collect()}
        vectors = np.array([raw[i] for i in sorted(raw)])
        return (lsi.loadings.count(), lsi.singular_values, np.abs(vectors), [shares[i] for i in sorted(shares, key=str)],
                [mixed[t] for t in sorted(mixed)], lda.log_likelihoods, lda.log_perplexity(corpus))

    whole = found()
    monkeypatch.setattr(weighting, "HEAD_TERMS", 20)
    for a, b in zip(found(), whole):
        assert np.array(a) == pytest.approx(np.array(b), abs=1e-7)


def test_rounds_of_topics_move_no_text_with_its_terms(planted):
    """The rows of the texts are read where they were written; only sums per term are shuffled."""
    _, corpus = planted
    model = topics.fit_lda(corpus, 3, 1)
    head = topics.Head(model.terms, 3)
    rows = topics._packed(head, dictionary.distinct_texts(corpus))
    for plan in (topics._there(rows, topics._loads(head, model.topics, 3), True), topics._shares(rows, topics._loads(head, model.topics, 3), 1.1)):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_topic_models_of_an_empty_corpus(spark):
    empty = spark.createDataFrame([], "text string")
    lsi, lda = topics.fit_lsi(empty, 3), topics.fit_lda(empty, 3, 3)
    texts = dictionary.distinct_texts(empty)
    assert lsi.k == 0 and lda.log_likelihoods == [] and lda.transform(texts).count() == 0


def test_models_are_saved_and_read_again(spark, planted, pairs, tmp_path):
    _, corpus = planted
    texts = dictionary.distinct_texts(corpus)
    rows = lambda df, c: sorted((r.text_id, str(r[c])) for r in df.collect())
    lsi, lda, chars = topics.fit_lsi(corpus, 3), topics.fit_lda(corpus, 3, 2), weighting.fit_char(corpus, ngram_range=(2, 3))
    for i, (model, column) in enumerate([(lsi, "lsi"), (lda, "lda")]):
        model.save(f"{tmp_path}/{i}")
        again = type(model).load(spark.newSession(), f"{tmp_path}/{i}")
        assert rows(again.transform(texts), column) == rows(model.transform(texts), column)
    chars.save(f"{tmp_path}/chars")
    again = weighting.TermModel.load(spark.newSession(), f"{tmp_path}/chars")
    assert rows(again.vectorize(texts), "terms") == rows(chars.vectorize(texts), "terms") and again.rare_idf == chars.rare_idf
    model = models.boosted_trees_a(DIM, (4,), **models.SMALL)
    matrix = model.build_features(pairs)
    fitted = model.fit(matrix)
    fitted.save(f"{tmp_path}/trees", model.get_config())
    again = models.Fitted.load(spark, f"{tmp_path}/trees")
    order = lambda f: sorted(map(tuple, f.predict_proba(matrix).collect()))
    assert again.names == model.feature_names and order(again) == order(fitted)


def test_early_stopping_keeps_the_best_trees(pairs):
    """A third of the labels are noise, so the loss on held-out pairs soon rises."""
    noisy = pairs.withColumn("label", F.when(F.xxhash64("qid1") % 3 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    stop = models.EarlyStopping(share=0.25)
    model = models.boosted_trees_a(DIM, (4,), early_stopping=stop, n_estimators=60, max_depth=4, learning_rate=0.3)
    matrix = model.build_features(noisy.unionByName(noisy.limit(20)))
    marked = stop.mark(matrix)
    assert marked.groupBy("qid1", "qid2").agg(F.count_distinct("is_validation").alias("n")).filter("n > 1").isEmpty()
    assert marked.filter("is_validation").select("qid1").distinct().count() == 40
    fitted = model.fit(matrix)
    assert 0 < fitted.n_trees < 60 and model.get_config()["early_stopping"]["share"] == 0.25
    assert models.boosted_trees_b(DIM, (4,), iterations=12, depth=3).fit(matrix).n_trees == 12
    with pytest.raises(ValueError):
        dataclasses.replace(models.logistic_regression(DIM), early_stopping=stop).fit(matrix)


def test_network_gradient_is_the_slope_of_its_loss():
    rng = np.random.default_rng(2)
    sizes = (5, 4, 3, 1)
    flat, x, y, w = networks.initial(sizes, 1), rng.normal(size=(20, 5)), rng.integers(0, 2, 20).astype(float), rng.uniform(0, 3, 20)
    loss, slope = networks.loss_and_gradient(flat, sizes, x, y, w)
    for i in range(0, len(flat), 5):
        near = flat.copy()
        near[i] += 1e-6
        assert (networks.loss_and_gradient(near, sizes, x, y, w)[0] - loss) / 1e-6 == pytest.approx(slope[i], abs=1e-3)
    again = networks.loss_and_gradient(flat, sizes, np.repeat(x, 2, axis=0), np.repeat(y, 2), np.repeat(w, 2) / 2)
    assert again[0] == pytest.approx(loss) and again[1] == pytest.approx(slope)


def test_network_weights_count_as_repeated_rows(pairs, spark, tmp_path):
    matrix = models.Siamese().build_features(pairs).withColumn("weight", F.when(F.col("label") == 1, 3.0).otherwise(1.0))
    repeated = matrix.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("weight").cast("int")))).drop("copy", "weight")
    one, two = (networks.fit_network(m, [4], rounds=5) for m in (matrix, repeated))
    assert one.losses == pytest.approx(two.losses) and one.flat == pytest.approx(two.flat)
    assert all(b < a for a, b in zip(one.losses, one.losses[1:]))
    one.save(spark, f"{tmp_path}/network")
    again = networks.FittedNetwork.load(spark, f"{tmp_path}/network")
    assert sorted(again.predict_proba(matrix).collect()) == sorted(one.predict_proba(matrix).collect())
    assert networks.fit_network(matrix.limit(0), [4]).losses == []


def test_network_stops_on_its_hold_out(pairs):
    noise = pairs.withColumn("label", (F.xxhash64("qid1") % 2 == 0).cast("int"))
    model = models.Siamese(hidden=8, max_iter=60, patience=3, rate=0.1, early_stopping=models.EarlyStopping(share=0.3))
    fitted = model.fit(model.build_features(noise))
    assert len(fitted.held_losses) == len(fitted.losses) < 60
    least = int(np.argmin(fitted.held_losses))
    assert len(fitted.losses) - 1 - least <= 5


def test_search_spaces_hold_only_what_spark_can_set():
    spec = models.boosted_trees_a(DIM).get_tuning_spec()
    assert spec["ignored"] == ["reg_alpha"] and "reg_alpha" not in spec["param_space"]
    assert models.random_forest(DIM).get_tuning_spec()["ignored"] == ["min_samples_split"]


class Watched:
    """Fits that take a while, with the most that ran at a time."""

    def __init__(self, fail=None):
        self.lock, self.now, self.most, self.fail, self.groups = threading.Lock(), 0, 0, fail, set()

    def __call__(self, rows, params):
        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)
            self.groups.add(rows.sparkSession.sparkContext.getLocalProperty("spark.jobGroup.id"))
        time.sleep(0.3)
        if self.fail == params["x"]:
            raise RuntimeError("bad candidate")
        with self.lock:
            self.now -= 1
        return rows.filter("NOT is_train").select("label", (F.pmod(F.xxhash64("qid1", F.lit(params["x"])), F.lit(100)) / 100.0).alias("proba"))


def test_parallel_search_gives_the_trials_of_the_serial_one(spark):
    rows = spark.range(200).select(F.col("id").alias("qid1"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 3).cast("int").alias("fold"))
    candidates = [{"x": i} for i in range(5)]
    plain = lambda trials: [{k: v for k, v in t.items() if k not in ("duration_s", "fold_seconds")} for t in trials]
    serial, watched = search.cv_search(rows, candidates, Watched(), k=3), Watched()
    side = search.cv_search(rows, candidates, watched, k=3, parallelism=3)
    assert plain(side) == plain(serial) and watched.most == 3 and None not in watched.groups and len(watched.groups) > 5
    assert all(len(t["fold_scores"]) == len(t["fold_seconds"]) == t["n_folds"] and min(t["fold_seconds"]) >= 0.3 for t in side)
    assert {t["state"] for t in side} == {"COMPLETE", "PRUNED"}
    with pytest.raises(RuntimeError, match="bad candidate"):
        search.cv_search(rows, candidates, Watched(fail=1), k=3, parallelism=2)
    table = spark.createDataFrame([tuple(t.values()) for t in side], search.TRIAL_SCHEMA)
    profile = {r.trial_number: r for r in search.fold_profile(table).collect()}
    for t in side:
        assert profile[t["trial_number"]].mean_score == pytest.approx(t["value"])
        assert profile[t["trial_number"]].std_score == pytest.approx(np.std(t["fold_scores"]))
    assert min(r.rank for r in profile.values() if r.rank) == 1 and all((r.rank is None) == (r.state == "PRUNED") for r in profile.values())


def test_repeated_pairs_do_not_leak(spark, pairs, tmp_path):
    """Each pair on three rows, one of them with the other label and another text."""
    rows = pairs.unionByName(pairs).unionByName(pairs.withColumns({"label": 1 - F.col("label"), "question1": F.lit("other")}))
    seen = []

    class Spy(models.CosineThreshold):
        def fit(self, matrix):
            seen.append({(r.qid1, r.qid2) for r in matrix.select("qid1", "qid2").collect()})
            return self

        def predict_proba(self, matrix):
            seen.append({(r.qid1, r.qid2) for r in matrix.select("qid1", "qid2").collect()})
            return super().predict_proba(matrix)

    result = jobs.run_experiment(spark, rows, Spy(threshold=0.5), "run", f"{tmp_path}/split", f"{tmp_path}/results").first()
    train, test = seen
    assert not train & test and len(train | test) == 160 and len(test) == 32
    ledger = spark.read.parquet(f"{tmp_path}/results/all_experiments").first()
    assert ledger.test_size == 96 and 0 < result.accuracy < 1
    wrong = spark.read.csv(f"{tmp_path}/results/run/errors", header=True, multiLine=True, quote='"', escape='"').count()
    assert wrong == ledger.FP + ledger.FN
    folds = []

    class Folds(models.CosineThreshold):
        def fit(self, matrix):
            folds.append(({(r.qid1, r.qid2) for r in matrix.select("qid1", "qid2").collect()}))
            return self

        def predict_proba(self, matrix):
            folds.append(({(r.qid1, r.qid2) for r in matrix.select("qid1", "qid2").collect()}))
            return super().predict_proba(matrix)

    jobs.tune(spark, rows, Folds(), "tuned", f"{tmp_path}/split", f"{tmp_path}", candidates=[{"threshold": 0.4}], k=2)
    assert len(folds) == 4 and not folds[0] & folds[1] and not folds[2] & folds[3]
    assert all(part <= train for part in folds)


def test_a_split_of_other_pairs_or_labels_is_refused(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "qid1 long, qid2 long, label int")
    splits.get_split(spark, f"{tmp_path}/s", make([(1, 2, 0), (1, 2, 0), (5, 6, 1)]))
    for other in ([(3, 4, 0), (3, 4, 0), (5, 6, 1)], [(1, 2, 1), (1, 2, 0), (5, 6, 1)]):
        with pytest.raises(ValueError):
            splits.get_split(spark, f"{tmp_path}/s", make(other))


def test_registered_topic_queries_take_more_than_the_commonest_terms(spark, tmp_path):
    """2,600 words, the last 300 of them in one conversation each."""
    rows = []
    for c in range(260):
        words = [f"w{10 * c + k}" for k in range(10)]
        for turn, role in enumerate(("user", "assistant")):
            rows.append((c, turn, role, " ".join(words * (1 if c >= 230 else 3))))
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    lsi, lda = model_checks.lsi(spark, str(tmp_path)), model_checks.lda(spark, str(tmp_path))
    assert lsi.terms.size == lsi.loadings.count() == 2600
    assert lda.topics.count() == 2600
    texts = dictionary.distinct_texts(model_checks.corpus(spark, str(tmp_path)))
    assert lsi.terms.vectorize(texts).count() == texts.count() == 260


def test_run_experiment_tune_and_score(spark, pairs):
    folder = scratch_path(spark, "jobs")
    result = jobs.run_experiment(spark, pairs, models.CosineThreshold(), "cosine", f"{folder}/split", folder).first()
    assert result.tp + result.fp + result.tn + result.fn == 32
    model = models.logistic_regression(DIM, max_iter=5)
    best = jobs.tune(spark, pairs, model, "lr", f"{folder}/split", folder, k=2, candidates=[{"C": 0.1}, {"C": 10.0}])
    stored = stores.read_params(spark, f"{folder}/lr/best_params", "LogisticRegression")
    assert stored["matches"] and stored["best_params"] == best["best_params"]
    tuned = model.apply_tuned_params(best["best_params"], source="lr")
    jobs.run_experiment(spark, pairs, tuned, "tuned", f"{folder}/split", folder)
    assert spark.read.parquet(f"{folder}/all_experiments").count() == 2
    extra = pairs.drop("label", "qid2").withColumnRenamed("qid1", "test_id")
    out = jobs.score_all(pairs, extra, tuned)
    assert out.count() == 160 and out.filter("is_duplicate is null").count() == 0


def test_encoder_batches(spark):
    texts = spark.createDataFrame([(i, f"word{i} shared") for i in range(300)], "qid bigint, text string")
    sizes = []

    def encoder(batch):
        assert len(batch) <= 64
        return np.ones((len(batch), 4))

    assert enrich.embed_texts(texts, encoder, batch=64).filter("size(embedding) = 4").count() == 300
    assert sizes == []
    weights = splits.class_weights(spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int"))
    assert {r.label: r.positive_weight for r in weights.collect()} == {0: 1.0, 1: 2.0}


def test_every_model_can_be_tuned():
    for model, params in ((models.Siamese(), {"hidden": 8}), (models.CosineThreshold(), {"threshold": 0.5}),
                          (models.TopKForest(models.random_forest(4)), {"n_estimators": 3})):
        tuned = model.with_params(params)
        assert type(tuned) is type(model) and tuned != model and "param_space" in model.get_tuning_spec()


def test_models_by_name_take_only_their_own_parameters(spark):
    path = scratch_path(spark, "params")
    stores.write_document(spark, {"model": "RandomForest", "best_score": 0.8, "best_params": {"max_depth": 3}}, path, "overwrite")
    assert jobs.configured_model(spark, "RandomForest", DIM, params_path=path).params["max_depth"] == 3
    with pytest.raises(ValueError):
        jobs.configured_model(spark, "BoostedTreesA", DIM, params_path=path)
    assert {models.by_name(n, DIM).name for n in models.MODELS} == set(models.MODELS)
    with pytest.raises(KeyError):
        models.by_name("none", DIM)


def test_shares_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 60, 200)
    loads, weights = rng.random((lengths.sum(), 5)) ** 3, rng.random(lengths.sum())
    ends = np.cumsum(lengths)
    want = [topics.best_shares(loads[e - n:e], weights[e - n:e], 1.1) for e, n in zip(ends, lengths)]
    assert topics.shares_of_texts(loads, weights, lengths, 1.1) == pytest.approx(np.array(want), abs=1e-9)


def test_forests_keep_the_node_of_each_row(pairs):
    """Rows are not walked down every tree again in each pass, and the trees are the same."""
    model = models.random_forest(DIM, (4,), **models.SMALL)
    matrix = model.build_features(pairs)
    kept = models._forest({"numTrees": 10, "maxDepth": 4}, 0)
    assert kept.getCacheNodeIds() and kept.copy().setFeaturesCol("chosen").getCacheNodeIds()
    assert kept.fit(matrix).toDebugString.split("\n", 1)[1] == kept.copy().setCacheNodeIds(False).fit(matrix).toDebugString.split("\n", 1)[1]
