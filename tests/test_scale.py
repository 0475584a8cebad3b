"""What is read, moved or written once and not once per part."""

import random

import pytest

from pairkit.functions import vectors as vx
from pairkit.operators import dictionary, ensemble, joins, models, splits, topics, weighting
from pairkit.plans import jobs
from pairkit.session import materialize, scratch_path
from pairkit.sources import quoted_csv, stores

DIM = 4


def labelled(spark, n=60, keys=lambda i: (i, i + 1)):
    rng = random.Random(n)
    words = "how what why is the cat dog tree house river blue green fast slow big small".split()
    rows = [(*keys(i), " ".join(rng.choices(words, k=6)), " ".join(rng.choices(words, k=6)), i % 2,
             [rng.gauss(0, 1) for _ in range(DIM)], [rng.gauss(0, 1) for _ in range(DIM)]) for i in range(n)]
    df = spark.createDataFrame(rows, "qid1 bigint, qid2 bigint, question1 string, question2 string, label int, "
                               "emb1 array<float>, emb2 array<float>")
    return df.withColumns({"norm1": vx.norm("emb1"), "norm2": vx.norm("emb2")})


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_hold_out_is_told_by_the_key_alone(spark):
    """As the joined hold-out has it, with repeated pairs and keys that are NULL."""
    df = labelled(spark, 50, lambda i: (i // 2 if i % 7 else None, i // 2 + 3 if i % 5 else None))
    for frac in (0.0, 0.1, 0.5, 1.0):
        pairs = splits.one_per_pair(df)
        joined = df.join(splits.validation_holdout(pairs, frac), ["qid1", "qid2"])
        marked = models.EarlyStopping(frac).mark(df)
        assert "Join" not in plan(marked)
        order = lambda x: sorted(map(tuple, x.select("qid1", "qid2", "label", "is_validation").collect()))
        assert order(marked) == order(joined) and marked.count() < df.count()


def test_fold_rows_meet_their_folds_once(spark):
    """The wide feature rows are not joined again for each fold and each pass of a fit."""
    df, plans = labelled(spark), []

    class Member(models.CosineThreshold):
        def fit(self, matrix):
            plans.append(plan(matrix))
            return super().fit(matrix)

    folds = splits.stratified_kfold(df.select("qid1", "qid2", "label"), 3)
    member = Member()
    oof = ensemble.out_of_fold([member], [member.build_features(df)], folds, 3)
    assert len(plans) == 3 and not any("Join" in p for p in plans)
    want = {(r.qid1, r.qid2): r.fold for r in folds.collect()}
    assert {(r.qid1, r.qid2): r.fold for r in oof.collect()} == want and len(want) == 60


def written_by(monkeypatch, *modules):
    """The tables that `materialize` writes, by name."""
    found = {}

    def keep(df, name):
        found[name] = materialize(df, name)
        return found[name]

    for module in modules:
        monkeypatch.setattr(module, "materialize", keep)
    return found


def test_csv_writes_only_records_that_pass_borders(spark, monkeypatch):
    rows = [(str(i), "a\nb" * 8 if i % 40 else 'x "y"\n' * 300) for i in range(400)]
    path = scratch_path(spark, "quoted")
    stores.write_csv(spark.createDataFrame(rows, "id string, one string").coalesce(1), path)
    tables = written_by(monkeypatch, quoted_csv)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = sorted(tuple(r) for r in quoted_csv.scan(spark, path).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted(rows) and list(tables) == ["csv-borders"]
    assert tables["csv-borders"].filter(f"kind = {quoted_csv.WHOLE}").isEmpty()


@pytest.mark.parametrize("few", [0, 1000])
def test_load_keeps_texts_of_rows_with_vectors_only(spark, monkeypatch, few):
    """Counts are of all rows, with few ids of vectors and with more than tasks are given."""
    rows = [(str(i), str(i) if i % 5 else "n/a", str(i + 1), f"left {i}", f"right\n{i}", str(i % 2)) for i in range(40)]
    folder = scratch_path(spark, "csv")
    stores.write_csv(spark.createDataFrame(rows, "id string, qid1 string, qid2 string, question1 string, question2 string, is_duplicate string"),
                     f"{folder}/questions.csv")
    vectors = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(10)] + [(None, [0.0, 0.0])], "qid bigint, embedding array<float>")
    tables = written_by(monkeypatch, jobs)
    monkeypatch.setattr(joins, "FEW_IDS", few)
    kept, counts = jobs.load_pairs(spark, folder, vectors)
    want = [(i, f"left {i}", f"right\n{i}") for i in range(9) if i % 5]
    assert sorted((r.qid1, r.question1, r.question2) for r in kept.collect()) == want
    assert tuple(counts.first()) == (40, 8, 40 - 8 - len(want), len(want))
    texts = [r.qid1 for r in tables["typed"].filter("question1 IS NOT NULL OR question2 IS NOT NULL").collect()]
    assert sorted(texts) == [i for i in range(9 if few else 40) if i % 5]


def test_classical_features_count_each_corpus_once(spark, monkeypatch):
    """One table of distinct texts for all four fits, and one count of the topics' vocabulary."""
    df = labelled(spark)
    made = {"texts": 0, "counts": 0}

    def counted(name, plain):
        def run(*args, **options):
            made[name] += 1
            return plain(*args, **options)
        return run

    corpus = dictionary.corpus(df)
    words, chars = weighting.fit_tfidf(corpus), weighting.fit_char(corpus)
    lsi, lda = topics.fit_lsi(corpus, 2), topics.fit_lda(corpus, 2)
    apart = models.corpus_features(words, chars, lsi, lda)
    monkeypatch.setattr(dictionary, "distinct_texts", counted("texts", dictionary.distinct_texts))
    monkeypatch.setattr(weighting, "term_statistics", counted("counts", weighting.term_statistics))
    chosen = models.full_classical_features(df, DIM, (2,), 2)
    assert made == {"texts": 1, "counts": 3}
    rows = chosen.apply(df)
    assert made["texts"] == 2  # those of the pairs
    monkeypatch.undo()
    shared = {(r.qid1, r.qid2): r for r in rows.collect()}
    for r in apart.apply(df).collect():
        for n in apart.names:
            assert abs(r[n] - shared[r.qid1, r.qid2][n]) < 1e-6, n
    assert len(shared) == 60 and set(apart.names) <= set(chosen.names)


def test_known_terms_outlast_what_a_task_forgets(monkeypatch):
    """A word of known terms is taken apart once; weights stay those of a task that forgets nothing."""
    monkeypatch.setattr(weighting, "HELD_TERMS", 20)
    asked = []

    def split(word):
        asked.append(word)
        return [word[:2], word]

    known = {"ca": 1.0, "cat": 2.0, "do": 1.5, "dog": 2.5}
    weigh = weighting.Weigher(weighting.Numbers(split, known), True, False)
    whole = weighting.Weigher(weighting.Numbers(lambda w: [w[:2], w], known), True, False)
    for i in range(50):
        weigh.refresh()
        text = ["cat", f"x{i}y", "dog", "cat", f"q{i}"]
        found, want = weigh(text), whole(text)
        by_name = lambda v, w: {w.numbers.names[t]: (x, y) for t, x, y in zip(v.at, v.idf, v.w)}
        assert by_name(found, weigh) == by_name(want, whole) and len(weigh.numbers.names) < 40
    assert asked.count("cat") == asked.count("dog") == 1 and len(asked) == 102
