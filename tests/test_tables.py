import random

import pytest
from pyspark.sql import functions as F

from pairkit.operators import dictionary, enrich, evaluate, joins, ranking, search, splits
from pairkit.session import scratch_path
from pairkit.sources import pairs as src, quoted_csv, stores


def test_csv_search_and_bad_rows(spark):
    folder = scratch_path(spark, "csv")
    spark.createDataFrame([("1", "x")], "a string, b string").write.csv(f"{folder}/aa.csv", header=True)
    rows = [("1", "10", "11", 'say "hi", now', "two\nlines", "1"), ("2", "x", "11", "a", "b", "0"),
            ("3", "12", "13", " padded ", None, "0"), ("4", "12", "13", "a", "b", "maybe")]
    raw = spark.createDataFrame(rows, "id string, qid1 string, qid2 string, question1 string, question2 string, is_duplicate string")
    stores.write_csv(raw, f"{folder}/questions.csv")
    found = src.read_pairs(spark, folder)
    got = src.parse_labelled(found).collect()
    assert [(r.question1, r.question2, r.label) for r in sorted(got)] == [('say "hi", now', "two\nlines", 1), (" padded ", "", 0)]
    assert tuple(src.count_bad(found).first()) == (4, 2)
    with pytest.raises(FileNotFoundError):
        src.read_unlabelled_pairs(spark, folder)


@pytest.mark.parametrize("size", [300, 1000, 1 << 20])
def test_quoted_csv_is_split_without_loss(spark, size):
    """Line breaks, quotes and separators in quotes; ranges far shorter than some of the texts."""
    rng = random.Random(size)
    bits = ["plain", "a,b", 'said "so"', "two\nlines", "\n\n", '"', "é", "", None, "cr\r\nlf", "x" * 700 + "\n" + "y" * 700]
    rows = [(str(i), *["".join(rng.choice(bits[:-2] + bits[-1:] * (rng.random() < .1)) or "" for _ in range(rng.randint(1, 3))) for _ in range(2)])
            for i in range(400)]
    raw = spark.createDataFrame(rows, "id string, one string, two string").repartition(3)
    path = scratch_path(spark, "quoted")
    stores.write_csv(raw, path)
    plain = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, enforceSchema=False,
                           ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        lines = quoted_csv._lines(spark, path)
        blocks = lines.select("file", "block").distinct().count()
        assert (len(quoted_csv._open_blocks(lines)) > 20) == (size == 300) and (blocks > 15) == (size < 2000)
        split = quoted_csv.scan(spark, path)
        assert split.columns == plain.columns
        got = sorted(map(str, split.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted(map(str, plain.collect())) and len(got) == 400


def test_quoted_csv_of_no_rows_and_of_open_quotes(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("a,b\n")
    assert quoted_csv.scan(spark, str(tmp_path / "empty.csv")).collect() == []
    (tmp_path / "open.csv").write_bytes(b'a,b\r\n1,"x\r\ny"\r\n\r\n2,"never\nclosed')
    assert sorted(tuple(r) for r in quoted_csv.scan(spark, str(tmp_path / "open.csv")).collect())[0] == ("1", "x\r\ny")


def test_frequent_keys_are_found_in_one_pass(spark):
    """Keys of 30, 10 and 5 % of the rows among many rare ones, spread over the tasks in order and at random."""
    rng = random.Random(5)
    keys = ["a"] * 3000 + ["b"] * 1000 + ["c"] * 500 + [f"k{i}" for i in range(5500)] + [None] * 4000
    for shuffled in (False, True):
        if shuffled:
            rng.shuffle(keys)
        df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(5) if shuffled else spark.createDataFrame([(k,) for k in keys], "k string")
        few = {r.k for r in joins.frequent_candidates(df, "k", 0.08).collect()}
        assert {"a", "b"} <= few and len(few) <= 16
        assert sorted(r.k for r in joins.hot_keys(df, "k", 0.08).collect()) == ["a", "b"]
    assert joins.hot_keys(df.limit(0), "k", 0.1).count() == 0


def test_salted_joins_read_their_input_a_few_times(spark, sf_dir):
    from checks import vector_checks
    from pairkit.plans import samples

    links, vectors = samples.document_links(spark, sf_dir), samples.vectors(spark, sf_dir)
    plan = joins.attach_vectors(links, vectors, hot_share=0.01)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 12
    by_text = joins.attach_vectors_by_text(samples.document_pairs(spark, sf_dir), vector_checks.vectors_by_text(spark, sf_dir), hot_share=0.01)
    assert by_text._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 24


def test_first_text_of_an_id_wins(spark):
    rows = [(2, 1, 2, "later", "x"), (1, 2, 1, "first of 2", "first of 1")]
    pairs = spark.createDataFrame(rows, "row_no bigint, qid1 bigint, qid2 bigint, question1 string, question2 string")
    got = [(r.qid, r.text) for r in dictionary.question_dictionary(pairs).collect()]
    assert got == [(1, "first of 1"), (2, "first of 2")]


def test_salted_lookup_equals_plain_join(spark):
    rng = random.Random(3)
    left = spark.createDataFrame([(i, 0 if rng.random() < 0.4 else rng.randrange(60)) for i in range(3000)], "id int, k int")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(50)], "k int, v string")
    for how in ("inner", "left"):
        plain = {(r.id, r.v) for r in joins.lookup(left, right, "k", how).collect()}
        salted = [(r.id, r.v) for r in joins.lookup(left, right, "k", how, hot_share=0.1, salts=8).collect()]
        assert len(salted) == len(plain) and set(salted) == plain
    assert [r.k for r in joins.hot_keys(left, "k", 0.1).collect()] == [0]


def test_pair_score_fallbacks(spark):
    pairs = spark.createDataFrame([(1, 2), (4, 3), (5, 6), (7, 7)], "qid1 bigint, qid2 bigint")
    scores = spark.createDataFrame(
        [(0, 1, 2, [0.1]), (5, 1, 2, [0.5]), (1, 2, 1, [0.9]), (2, 3, 4, [0.3]), (3, 7, 7, [0.7])],
        "index bigint, qid1 bigint, qid2 bigint, features array<float>")
    got = {r.qid1: (round(r.ce[0], 3), r.ce_missing) for r in joins.attach_pair_scores(pairs, scores, 1).collect()}
    assert got == {1: (0.5, False), 4: (0.3, False), 5: (0.0, True), 7: (0.7, False)}
    assert {r.qid1: round(r.features[0], 3) for r in joins.last_pair_scores(scores).collect()} == {1: 0.5, 2: 0.9, 3: 0.3, 7: 0.7}


def test_split_is_exact_and_bound_to_its_pairs(spark):
    rows = [(i, i + 1, int(i % 4 == 0)) for i in range(1003)]
    pairs = spark.createDataFrame(rows, "qid1 bigint, qid2 bigint, label int")
    split = splits.stratified_split(pairs, 0.2)
    counts = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert counts == {(1, "test"): 50, (1, "train"): 201, (0, "test"): 150, (0, "train"): 602}
    folds = [r["count"] for r in splits.stratified_kfold(pairs, 5).groupBy("label", "fold").count().collect()]
    assert sum(folds) == 1003 and len(folds) == 10
    assert splits.validation_holdout(pairs, 0.05).filter("is_validation").count() == 50
    path = scratch_path(spark, "split")
    first = splits.get_split(spark, path, pairs)
    assert splits.get_split(spark, path, pairs.orderBy(F.desc("qid1"))).exceptAll(first).count() == 0
    with pytest.raises(ValueError):
        splits.load_split(spark, path, pairs.filter("qid1 > 5"))


def test_shuffle_key_takes_any_id(spark):
    big = spark.createDataFrame([(9_000_000_000_000, 9_000_000_000_001, 1)], "qid1 bigint, qid2 bigint, label int")
    assert splits.stratified_kfold(big, 3).first().fold == 0


def test_single_class_metrics(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.2), (1, 0.7)], "label int, proba double")
    got = evaluate.metrics(evaluate.decide(rows, 0.7)).first()
    assert (got.tp, got.fp, got.tn, got.fn) == (2, 0, 0, 1) and got.precision == 1.0
    report = {r.row: r for r in evaluate.classification_report(evaluate.decide(rows, 0.7)).collect()}
    assert report["0"].support == 0 and report["macro avg"].recall == pytest.approx(2 / 3)
    assert splits.class_weights(rows.withColumns({"qid1": F.lit(1), "qid2": F.lit(1)})).first().balanced == 1.0


def test_threshold_sweep_matches_brute_force(spark):
    rng = random.Random(5)
    data = [(int(rng.random() < 0.3), 0.5 if rng.random() < 0.4 else round(rng.random(), 2)) for _ in range(800)]
    df = spark.createDataFrame(data, "label int, proba double")
    rows = evaluate.threshold_sweep(df).collect()
    assert len(rows) == len({p for _, p in data})
    for r in rows:
        assert r.tp == sum(y == 1 and p >= r.threshold for y, p in data)
        assert r.fp == sum(y == 0 and p >= r.threshold for y, p in data)
        assert r.tp + r.fn == sum(y for y, _ in data) and r.tp + r.fp + r.tn + r.fn == 800


def test_submission_keeps_every_id(spark):
    ids = spark.createDataFrame([(1,), (2,)], "test_id bigint")
    scored = spark.createDataFrame([(1, 0.25)], "test_id bigint, proba double")
    assert {r.test_id: r.is_duplicate for r in stores.submission(ids, scored, 0.5).collect()} == {1: "0.250000", 2: "0.500000"}
    assert {r.test_id: r.is_duplicate for r in stores.submission(ids, scored).collect()} == {1: "0.250000", 2: None}


def test_scores_without_a_scalar_are_nan(spark):
    pairs = spark.createDataFrame([(1, 1, 2, "a b", "a")], "index bigint, qid1 bigint, qid2 bigint, question1 string, question2 string")
    row = enrich.score_pairs(pairs, lambda a, b: (None, None)).first()
    assert row.score != row.score and row.features is None


def test_sample_params():
    space = {"d": {"type": "int", "low": 2, "high": 5}, "lr": {"type": "float", "low": 1e-3, "high": 1.0, "log": True},
             "n": {"type": "int", "low": 10, "high": 1000, "log": True}, "c": {"type": "categorical", "choices": ["x", "y"]}}
    drawn = search.sample_params(space, 50, 1)
    assert drawn == search.sample_params(space, 50, 1) != search.sample_params(space, 50, 2)
    assert all(2 <= p["d"] <= 5 and 1e-3 <= p["lr"] <= 1 and 10 <= p["n"] <= 1000 and p["c"] in "xy" for p in drawn)
    with pytest.raises(ValueError):
        search.sample_params({"z": {"type": "other"}}, 1)


def test_study_resumes_and_drops_weak_candidates(spark):
    rows = spark.createDataFrame([(i % 2, i % 3, float(i % 2)) for i in range(60)], "label int, fold int, x double")
    calls = []

    def fit_score(marked, params):
        calls.append(params["keep"])
        good = F.when(F.col("x") > 0.5, F.lit(params["keep"])).otherwise(F.lit(0.1))
        return marked.filter("not is_train").select("label", good.alias("proba"))

    path = scratch_path(spark, "study")
    first = search.run_study(spark, path, rows, [{"keep": 0.9}, {"keep": 0.2}, {"keep": 0.9}], fit_score, k=3)
    assert {(r.params, r.state, r.n_folds) for r in first.collect()} == {('{"keep":0.9}', "COMPLETE", 3), ('{"keep":0.2}', "PRUNED", 1)}
    assert len(calls) == 4
    again = search.run_study(spark, path, rows, [{"keep": 0.9}, {"keep": 0.8}], fit_score, k=3)
    assert len(calls) == 7 and {r.trial_number for r in again.collect()} == {0, 1, 2}
    with pytest.raises(FileExistsError):
        search.run_study(spark, path, rows, [], fit_score, fresh=True)
    assert ranking.best_trial(again).first().trial_number == 0
    assert search.best_document(again, "m", "s")["best_params"] == {"keep": 0.9}


def test_an_eliminated_trial_is_never_the_best(spark):
    trials = spark.createDataFrame([(0, 0.8, "PRUNED", "{}"), (1, 0.4, "COMPLETE", "{}"), (2, 0.3, "COMPLETE", "{}")],
                                   "trial_number int, value double, state string, params string")
    assert ranking.best_trial(trials).first().trial_number == 1
    assert search.summarize(trials).first().best_value == 0.4


def test_repeated_pairs_stay_as_many_as_they_are(spark):
    pairs = spark.createDataFrame([(1, 2, 0), (1, 2, 0), (3, 4, 1), (5, 6, 1)], "qid1 long, qid2 long, label int")
    split = pairs.withColumn("split", F.when(F.rand(3) < 0.5, "test").otherwise("train"))
    assert joins.assign_split(pairs, split).count() == 4
    members = [pairs.withColumn("proba", F.lit(p) + F.col("label")) for p in (0.1, 0.2, 0.3)]
    aligned = joins.align_members(members)
    assert aligned.count() == 4 and aligned.filter("agree").count() == 4
