import math
import re
from collections import Counter

import numpy as np
import pytest

from pairkit.operators import dictionary, sparse_pairs, weighting
from pairkit.plans import samples
from pairkit.session import materialize

PAIRS = [(1, 2, "the cat sat on the mat", "the cat sat"), (3, 4, "dogs and cats", "cats and dogs!"),
         (5, 6, "", "zebra"), (7, 8, "unique words only here", "nothing shared anywhere"),
         (9, 10, "the the the", "the"), (11, 12, "the cat sat", "the cat sat")]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "qid1 bigint, qid2 bigint, question1 string, question2 string")


def tokens(t):
    return [x for x in re.split(r"[\s\W]+", t.lower()) if x]


def brute_fit(corpus, cap):
    tf, df = Counter(), Counter()
    for t in corpus:
        tf.update(tokens(t))
        df.update(set(tokens(t)))
    kept = sorted(tf, key=lambda w: (-tf[w], w.encode()))[:cap]
    return {w: math.log((1 + len(corpus)) / (1 + df[w])) + 1 for w in kept}


def brute_vector(text, idf):
    w = {t: (1 + math.log(c)) * idf[t] for t, c in Counter(tokens(text)).items() if t in idf}
    norm = math.sqrt(sum(x * x for x in w.values()))
    return {t: x / norm for t, x in w.items()}


@pytest.mark.parametrize("cap", [None, 5, 8])
def test_word_features_match_brute_force(spark, pairs, cap):
    corpus = [t for _, _, a, b in PAIRS for t in (a, b)]
    idf = brute_fit(corpus, cap)
    model = weighting.fit_tfidf(dictionary.corpus(pairs), cap)
    assert model.n_docs == 12 and model.size == len(idf)
    assert {r.term: pytest.approx(r.idf) for r in model.vocabulary.collect()} == idf
    rare = np.percentile(list(idf.values()), 75)
    assert model.rare_idf == pytest.approx(rare)
    unseen = spark.createDataFrame([(20, 21, "quite unseen", "unseen too")], pairs.schema)
    rows = sparse_pairs.word_features(model).apply(pairs.unionByName(unseen)).collect()
    assert len(rows) == len(PAIRS) + 1
    for r in rows:
        s1, s2 = set(tokens(r.question1)), set(tokens(r.question2))
        v1, v2 = brute_vector(r.question1, idf), brute_vector(r.question2, idf)
        gaps = [abs(v1.get(t, 0) - v2.get(t, 0)) for t in v1.keys() | v2.keys()]
        either = sum(idf.get(t, 0) for t in s1 | s2)
        odd = [t for t in s1 ^ s2 if idf.get(t, 0) >= rare]
        top = sorted(s1, key=lambda t: (-idf.get(t, 0), t.encode()))[:3]
        want = {"weighted_word_overlap": sum(idf.get(t, 0) for t in s1 & s2) / either if either else 0.0,
                "rare_word_mismatch_count": len(odd), "rare_word_mismatch_weight": sum(idf[t] for t in odd),
                "top1_word_match": bool(top and top[0] in s2), "top3_overlap_count": sum(t in s2 for t in top),
                "tfidf_diff_l1": sum(gaps), "tfidf_diff_l2": math.sqrt(sum(g * g for g in gaps)),
                "tfidf_diff_max": max(gaps, default=0.0), "tfidf_diff_mean": sum(gaps) / len(idf),
                "tfidf_cosine_sim": sum(v1.get(t, 0) * v2.get(t, 0) for t in v1)}
        for name, value in want.items():
            assert r[name] == pytest.approx(float(value), abs=1e-9), (name, r.question1, r.question2)


def test_char_features(pairs):
    model = weighting.fit_char(dictionary.corpus(pairs), 50, (1, 3))
    rows = {r.qid1: r for r in sparse_pairs.char_features(model).apply(pairs).collect()}
    assert rows[11].char_bin_jaccard == 1.0 and rows[11].char_tfidf_cosine_sim == pytest.approx(1.0)
    assert rows[5].char_bin_jaccard == 0.0 and rows[5].char_tfidf_cosine_sim == 0.0
    assert all(r.char_tfidf_l2_diff ** 2 == pytest.approx(2 - 2 * r.char_tfidf_dot, abs=1e-9)
               for q, r in rows.items() if q != 5)


def test_cap_keeps_ties_in_term_order(spark):
    terms = spark.createDataFrame([(f"t{i:03d}", 1 + (i % 3), 1) for i in range(300)], "term string, tf bigint, df bigint")
    got = {r.term for r in weighting.cap_vocabulary(terms, 150).collect()}
    want = sorted(((3 - 0) - (1 + i % 3), f"t{i:03d}") for i in range(300))[:150]
    assert got == {t for _, t in want}


def test_hot_text_is_counted_once_per_repeat(spark):
    rows = [("same words",)] * 500 + [(f"other {i}",) for i in range(50)]
    model = weighting.fit_tfidf(spark.createDataFrame(rows, "text string"))
    found = {r.term: (r.tf, r.df) for r in model.vocabulary.collect()}
    assert found["same"] == (500, 500) and found["other"] == (50, 50) and model.n_docs == 550


@pytest.mark.parametrize("head", [3, 6])
def test_rare_terms_that_tasks_do_not_hold_are_joined(spark, pairs, monkeypatch, head):
    """The vocabulary is larger than what tasks hold: the same vectors, features and top terms."""
    unseen = spark.createDataFrame([(20, 21, "quite unseen cat", "unseen too"), (22, 23, None, "the cat")], pairs.schema)
    asked = pairs.unionByName(unseen)
    corpus = dictionary.corpus(pairs)
    texts = dictionary.distinct_texts(dictionary.corpus(asked))

    def found():
        words, chars = weighting.fit_tfidf(corpus), weighting.fit_char(corpus, ngram_range=(1, 3))
        out = [{r.text_id: [(t.term, round(t.idf, 9), round(t.w, 9)) for t in r.terms] for r in m.vectorize(texts, known).collect()}
               for m in (words, chars) for known in (True, False)]
        for made in (sparse_pairs.word_features(words), sparse_pairs.word_features(words, texts=texts), sparse_pairs.char_features(chars)):
            out.append({r.qid1: [round(r[n], 9) for n in made.names] for r in made.apply(asked).collect()})
        out.append({r.qid1: r.top_terms for r in sparse_pairs.top_terms(words, asked).collect()})
        return out, words

    whole, _ = found()
    monkeypatch.setattr(weighting, "HEAD_TERMS", head)
    parts, words = found()
    assert words.size > head >= len(words.head()[0].value)
    assert parts == whole


def test_terms_of_pairs_shuffle_no_row_per_text_and_term(spark, pairs):
    """Vectors and their features are made in the row: only the sums per term are dealt by term."""
    texts = materialize(dictionary.distinct_texts(dictionary.corpus(pairs)), "texts")
    model = weighting.fit_char(texts, ngram_range=(1, 3))
    for df in (model.vectorize(texts), sparse_pairs.char_features(model, texts).apply(pairs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Exchange" not in plan


def test_grams_made_in_tasks_are_those_of_the_expression(spark):
    texts = ["Plain words here", "a bb  ccc", "", "  ", "x", "ÄÖ \U0001F600y z", "dotted.i İstanbul", None]
    df = spark.createDataFrame([(str(i), t, 1) for i, t in enumerate(texts)], "text_id string, text string, n bigint")
    for low, high in ((1, 8), (2, 3), (4, 6), (5, 5)):
        tokenizer = weighting.char_tokenizer(low, high)
        want = {r.text_id: dict(Counter(r.g or [])) for r in df.select("text_id", tokenizer("text").alias("g")).collect()}
        got = {i: {} for i in want}
        for r in weighting.term_counts(df, tokenizer).collect():
            got[r.text_id][r.term] = r.tf
        assert got == want, (low, high)


def test_distinct_texts_of_links_counts_every_side(spark, tmp_path):
    """Ids that come twice, null texts and copies count as in the pairs themselves."""
    rows = [(1, "a b", "en", "s"), (2, "a b", "en", "s"), (2, "c", "en", "s"), (3, None, "en", "s"), (4, "c", "en", "s"), (5, "a b", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    d = str(tmp_path)
    got = samples.distinct_texts_of(samples.document_links(spark, d), samples.documents(spark, d))
    want = dictionary.distinct_texts(dictionary.corpus(samples.document_pairs(spark, d)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    keys = samples.document_pairs(spark, d).select("qid1", "qid2", dictionary.text_key("question1").alias("text_id1"),
                                                   dictionary.text_key("question2").alias("text_id2"), "label")
    assert sorted(map(str, samples.document_keys(spark, d).collect())) == sorted(map(str, keys.collect()))


def test_distinct_texts_of_links_move_a_text_once(spark, tmp_path, monkeypatch):
    """One shuffle carries texts; null texts are one text, records of no pair and of null id have none."""
    rows = [(1, "x\na"), (2, "x\na"), (2, "x\nb"), (3, None), (4, None), (9, "alone"), (None, "x\nlost")]
    texts = spark.createDataFrame(rows, "qid long, text string")
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "qid1 long, qid2 long")
    plans = []

    def written(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    monkeypatch.setattr(samples, "materialize", written)
    got = {r.text_id: (r.text, r.n) for r in samples.distinct_texts_of(links, texts).collect()}
    both = [t for a, b in links.collect() for i, t in rows for j, u in rows if (i, j) == (a, b) for t in (t, u)]
    assert sorted((t or "", n) for t, n in got.values()) == sorted((t or "", both.count(t)) for t in set(both))
    # texts meet their counts in the grouping by key, not in a join before it
    assert "Union" in plans[0]
