import difflib
import random
import re
import time

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pairkit.functions import sequence, text as tx
from pairkit.operators import features

TEXTS = ["", "a", "a b c", "What is X?", "what is X ?", "naïve_test ÉCOLE ２", "  lead and trail \t\n?", "tab\tsep\x85nel　wide",
         "I have 2+2=4 % of <b>!!", "emoji 😀😀 ok", "a a a a", "How how HOW?\n", "x" * 30]


def brute_char_wb(text, low, high):
    out = []
    for word in text.lower().split():
        w = f" {word} "
        for n in range(low, high + 1):
            out += [w[i:i + n] for i in range(max(len(w) - n + 1, 1))]
            if n >= len(w):
                break
    return sorted(out)


def texts_df(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


@pytest.mark.parametrize("low, high", [(1, 8), (2, 4), (4, 6), (5, 5), (6, 8)])
def test_char_word_grams(spark, low, high):
    for row in texts_df(spark).select("text", tx.char_word_grams("text", low, high).alias("g")).collect():
        assert sorted(row.g) == brute_char_wb(row.text, low, high), row.text


@pytest.mark.parametrize("low, high", [(1, 8), (3, 5)])
def test_char_grams(spark, low, high):
    for row in texts_df(spark).select("text", tx.char_grams("text", low, high).alias("g")).collect():
        line = re.sub(r"\s\s+", " ", row.text.lower())
        want = [line[i:i + n] for n in range(low, high + 1) for i in range(len(line) - n + 1)]
        assert sorted(row.g) == sorted(want), row.text


def test_tokenizers(spark):
    df = texts_df(spark).select("text", tx.whitespace_tokens("text").alias("ws"), tx.word_tokens("text").alias("w"),
                                tx.topic_tokens("text").alias("t"), tx.strip("text").alias("s"),
                                tx.is_question("text").alias("q"))
    for row in df.collect():
        words = [x for x in re.split(r"[\s\W]+", row.text.lower()) if x]
        assert row.ws == row.text.lower().split()
        assert row.w == words and row.t == [x for x in words if len(x) >= 2]
        assert row.s == row.text.strip() and row.q == row.text.rstrip().endswith("?")


@pytest.mark.parametrize("n", [1, 2, 3, 6])
def test_word_ngrams(spark, n):
    df = texts_df(spark).withColumn("t", tx.whitespace_tokens("text")).select("t", tx.word_ngrams("t", n).alias("g"))
    for row in df.collect():
        assert row.g == [" ".join(row.t[i:i + n]) for i in range(len(row.t) - n + 1)]


def brute_classical(q1, q2):
    t1, t2 = q1.lower().split(), q2.lower().split()

    def jac(a, b):
        return len(a & b) / len(a | b) if a | b else 0.0

    def runs(t, n):
        return {tuple(t[i:i + n]) for i in range(len(t) - n + 1)}

    f1, f2 = (t[0] if t else "" for t in (t1, t2))
    start, end = bool(t1 and t2 and f1 == f2), bool(t1 and t2 and t1[-1] == t2[-1])
    out = {f"ngram_{n}_jaccard": jac(runs(t1, n), runs(t2, n)) for n in range(1, 7)}
    common = out["ngram_1_jaccard"]
    out.update(common_word_pct=common, same_start_word=start, same_end_word=end,
               same_start_2gram=len(t1) > 1 and len(t2) > 1 and t1[:2] == t2[:2],
               common_pct_when_same_start=common * start, common_pct_when_same_end=common * end,
               q1q2_same_starter=f1 == f2 and f1 in tx.STARTERS, caps_diff=abs(
                   sum(c.isupper() for c in q1) - sum(c.isupper() for c in q2)),
               char_len_ratio=len(q1) / len(q2) if q2 else 0.0)
    for i, (q, t, f) in enumerate(((q1, t1, f1), (q2, t2, f2)), start=1):
        out.update({f"n_caps_q{i}": sum(c.isupper() for c in q), f"n_digits_q{i}": sum(c.isdigit() for c in q),
                    f"n_math_q{i}": sum(c in tx.MATH_SYMBOLS for c in q), f"n_qmarks_q{i}": q.count("?"),
                    f"n_excl_q{i}": q.count("!"), f"avg_word_len_q{i}": sum(map(len, t)) / len(t) if t else 0.0,
                    f"len_q{i}_unique_words": len(set(t)), f"len_q{i}_words": len(t), f"len_q{i}_chars": len(q),
                    f"q{i}_is_question": q.rstrip().endswith("?")})
        out.update({f"q{i}_starts_{w}": f == w for w in tx.STARTERS})
    return out


def test_classical_features_match_brute_force(spark):
    pairs = [(a, b) for a in TEXTS for b in TEXTS]
    df = spark.createDataFrame(pairs, "question1 string, question2 string")
    for row in features.classical_text_features.apply(df).collect():
        for name, want in brute_classical(row.question1, row.question2).items():
            assert row[name] == pytest.approx(float(want)), (name, row.question1, row.question2)


def test_lexical_guards(spark):
    df = spark.createDataFrame([("", ""), ("", "a"), ("a b c", "a b c")], "question1 string, question2 string")
    rows = features.lexical_features.apply(df).collect()
    assert [(r.jaccard, r.overlap_min) for r in rows] == [(0.0, 0.0), (0.0, 0.0), (1.0, 1.0)]


def test_sequence_features_match_plain_difflib(spark, sf_dir):
    docs = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(12).collect()]
    pairs = list(zip(docs, docs[1:])) + [("", ""), ("", "a"), ("abc", "abc")]
    df = spark.createDataFrame(pairs, "question1 string, question2 string")
    for autojunk in (True, False):
        small = df if autojunk else df.filter("length(question1) < 2000 and length(question2) < 2000")
        got = small.select("*", sequence.sequence_struct("question1", "question2", autojunk).alias("s")).select("*", "s.*")
        for row in got.collect():
            chars = difflib.SequenceMatcher(None, row.question1, row.question2, autojunk)
            words = difflib.SequenceMatcher(None, row.question1.lower().split(), row.question2.lower().split(), autojunk)
            assert row.seq_char_ratio == pytest.approx(chars.ratio())
            assert row.seq_word_ratio == pytest.approx(words.ratio())
            assert row.lcs_len_chars == sum(b.size for b in chars.get_matching_blocks())
            assert row.edit_dist_norm == pytest.approx(1 - chars.ratio())


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40), st.text(max_size=40))
def test_sequence_values_are_bounded(a, b):
    values = dict(zip(sequence.NAMES, sequence.pair_sequence_values(a, b)))
    assert 0.0 <= values["seq_char_ratio"] <= 1.0
    assert values["lcs_len_chars"] <= min(len(a), len(b))
    assert dict(zip(sequence.NAMES, sequence.pair_sequence_values(a, a)))["seq_char_ratio"] == 1.0


def blocks_of_difflib(a, b, autojunk):
    return sum(x.size for x in difflib.SequenceMatcher(None, a, b, autojunk).get_matching_blocks())


@pytest.mark.parametrize("short", [1, 2, 8])
def test_blocks_of_edited_moved_and_repeated_runs_are_those_of_difflib(monkeypatch, short):
    """Few and many letters, below and above the length from which frequent ones start no run."""
    monkeypatch.setattr(sequence, "SHORT", short)
    rnd = random.Random(short)
    for _ in range(200):
        letters, size = rnd.choice([1, 2, 5, 30, 400]), rnd.choice([1, 30, 150, 250, 600])
        draw = lambda n: [chr(0x1F600 + rnd.randrange(letters)) for _ in range(n)]
        a = draw(rnd.randrange(size + 1))
        b = list(a) if rnd.random() < 0.8 else draw(rnd.randrange(size + 1))
        for _ in range(rnd.randrange(10)):
            low = rnd.randrange(len(b) + 1)
            run, to = b[low:low + rnd.randrange(40)], rnd.randrange(len(b) + 1)
            if kind := rnd.randrange(3):
                del b[low:low + len(run)]
            b[to:to] = draw(rnd.randrange(5)) if kind == 2 else run
        for x, y in ((a, b), ("".join(a), "".join(b))):
            for autojunk in (True, False):
                assert sequence._matched(x, y, autojunk) == blocks_of_difflib(x, y, autojunk), (x, y, autojunk)


def test_long_texts_are_matched_without_all_pairs_of_equal_letters():
    """60,000 letters of which none is frequent: 30 million pairs of equal letters, which no step may walk through."""
    rnd = random.Random(5)
    a, b = ("".join(chr(0x4E00 + rnd.randrange(115)) for _ in range(60_000)) for _ in range(2))
    assert sequence._matched(a[:3000], b[:3000], True) == blocks_of_difflib(a[:3000], b[:3000], True)
    began = time.process_time()
    assert sequence._matched(a, b, True) == 554  # as difflib found
    assert time.process_time() - began < 8


def test_user_features(spark):
    own = features.from_columns({"longer": F.length("question1") > F.length("question2")})
    df = spark.createDataFrame([("abc", "a")], "question1 string, question2 string")
    assert (own + features.lexical_features).apply(df).first().longer == 1.0


def test_ngram_ratios_make_no_sets_of_strings(spark):
    """Runs are compared by numbers in a task; empty, null, short and repeated texts keep their values."""
    texts = ["", "a", "a b a b a b a b", "b a b", "x y z é 日 w v", "A B  a\tb", None]
    pairs = [(i, j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)] * 7
    df = spark.createDataFrame(pairs, "qid1 int, qid2 int, question1 string, question2 string")
    made = features.with_ngrams(features.with_tokens(df)).select("qid1", "qid2", "question1", "question2", *[
        c.alias(n) for n, c in features.ngram_columns().items()])
    assert "regexp_extract_all" not in made._jdf.queryExecution().optimizedPlan().toString()
    rows = made.collect()
    assert len(rows) == len(pairs)
    for r in rows:
        t1, t2 = (None if t is None else t.lower().split() for t in (r.question1, r.question2))
        for n in range(1, 7):
            a, b = ({tuple(t[i:i + n]) for i in range(len(t) - n + 1)} if t1 is not None and t2 is not None else set() for t in (t1 or [], t2 or []))
            assert r[f"ngram_{n}_jaccard"] == (len(a & b) / len(a | b) if a | b else 0.0)
