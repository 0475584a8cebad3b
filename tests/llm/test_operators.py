"""The operators against brute force, libraries and held-out labels, and on rows out of the ordinary."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
from pairkit.llm import (components, exact_dedup, language_id, mixing, ngram_join, piece_bpe, token_counts, topk_search,
                         toxicity, url_rules, warc_zstd)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use inside
CLASHES = ["id", "digest", "kept", "size", "start", "score", "rank", "shard", "place", "n", "component", "word", "host", "ids", "pass"]


def docs_of(spark, texts, extra=True):
    rows = [(i, t, "en", f"s{k % 3}" if k % 4 else None, len(t or "")) for k, (i, t) in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if extra else df


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs, empty and long texts, repeated rows and ids."""
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "Same Text here"), (5, "same text HERE"), (5, "same text HERE"), (None, "no id at all"),
             (None, None), (6, "é ü 日本語 😀 ▁ ok"), (7, "word " * 30000), (8, "x" * 50000), (9, "word " * 30000 + "end"), (10, "12 34")]
    return docs_of(spark, texts)


@pytest.fixture(scope="module")
def con(sf_dir):
    return check.connect(sf_dir)


@pytest.mark.parametrize("name", ["op1_topk_search", "op4_url_filters", "op7_ngram_join", "op8_warc", "op10_exact_dedup"])
def test_query_matches_sql(spark, con, sf_dir, name):
    assert check.compare(spark, con, name, sf_dir)[0] == "ok"


# ---- 1 top-k ------------------------------------------------------------------
def brute_topk(rows, k):
    fine = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(
        x is not None and np.isfinite(x) for x in v)}
    out = []
    for q, v in fine.items():
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("shards", [1, 4])
def test_topk_is_exact_with_ties(spark, shards):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-.5, 0.0, .25, .5]) for _ in range(6)]) for i in range(400)]
    rows += [(i, [.25] * 6) for i in range(1000, 1300)]
    rows += [(2000, None), (2001, [None] * 6), (2050, [float("nan")] * 6), (2100, [float("inf")] * 6), (None, [.5] * 6), (7, rows[7][1]),
             (2150, [.5] * 3), (2200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in CLASHES})
    got = topk_search.top_k(df, F.col("id") % 50 == 0, shard_rows=max(1, 700 // shards), least_rows=200)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_topk(rows, 5)
    assert topk_search.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_topk_tells_ids_beyond_2_to_the_53_apart(spark):
    rows = [(2 ** 60 + i, [.5, .25] if i < 3 else [.25, .25]) for i in range(5)] + [(50, [.5, .5]), (2 ** 60 + 1, [.5, .25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for least in (1, 100):
        got = topk_search.top_k(df, F.col("id") == 50, least_rows=least)
        assert [tuple(r) for r in got.select("rank", "vec_id", "score").orderBy("rank").collect()] == [
            (r, i, s) for r, i, s, *_ in [(k + 1, 2 ** 60 + k, 128 * 128 + 64 * 128 if k < 3 else 64 * 128 * 2) for k in range(5)]]


def test_ball_tree_opens_few_nodes_of_clustered_vectors():
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 100, (20, 8))
    vectors = np.floor(np.repeat(centers, 200, axis=0) + rng.normal(0, 2, (4000, 8)))
    tree = topk_search.BallTree(np.arange(4000), vectors)
    opened = []
    scores = tree._scores
    tree._scores = lambda lo, hi, q: opened.append(hi - lo) or scores(lo, hi, q)
    found = list(tree.search(np.array([0]), vectors[:1], [None], 5))
    order = sorted(range(1, 4000), key=lambda i: (-vectors[i] @ vectors[0], i))[:5]
    assert {i for _, i, _ in found} == set(order) and sum(opened) < 1000


# ---- 2 token counts -----------------------------------------------------------
@pytest.fixture(scope="module")
def byte_bpe():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.mark.parametrize("chunk,overlap", [(600, 200), (1 << 14, 512)])
def test_token_counts_equal_the_library(spark, byte_bpe, chunk, overlap):
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "a", "the", " of", "é", "日", "😀", "1", "...", "'re", "n't", "<|endoftext|>", "<|endo", "   ", " x", "-----"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.choice([0, 5, 300, 1500])))) for i in range(20)]
    rows += [(100, None), (101, ""), (102, "a" * 20000), (103, " " * 15000), (104, "ab " * 8000), (104, "ab " * 8000), (None, "ab " * 900),
             (105, "a" * 9000 + " b" * 3000 + "<|endoftext|>" * 200)]
    tokenizer = token_counts.load(byte_bpe)
    got = token_counts.count_tokens(docs_of(spark, rows), byte_bpe, chunk=chunk, overlap=overlap).collect()
    want = [(str(i), len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted((str(r.id), r.n_bytes, r.n_tokens) for r in got) == sorted(want)


def test_token_counts_of_no_rows(spark, byte_bpe):
    assert token_counts.count_tokens(docs_of(spark, [(1, "a")]).limit(0), byte_bpe).count() == 0


def test_pieces_that_come_again_are_remembered(spark, byte_bpe, monkeypatch):
    """Counts of pieces between single spaces add up to the library's, also when the memory overflows, and chunks meet at such a space."""
    rng = random.Random(5)
    bits = ["the", "dog's", "l'été", " ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "日本", "😀", ",", "...", "'s", "12", "<|endoftext|>", "<|endo", "­", "x" * 40]
    texts = ["", " ", " a", "a "] + ["".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.choice([1, 9, 400]))) for _ in range(120)]
    count, tokenizer = token_counts.Counter(byte_bpe), token_counts.load(byte_bpe)
    want = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert count.cuts and count(texts) == want and count(texts) == want and any(count.known.values())
    monkeypatch.setattr(token_counts, "HELD_PIECES", 5)
    assert token_counts.Counter(byte_bpe)(texts * 2) == want * 2
    for other in ('"add_prefix_space":true', '"use_regex":false'):
        assert not token_counts.starts_words_at_spaces(re.sub(r'"%s":\s*\w+' % other.split('"')[1], other, byte_bpe))
    left, right = "ab cd " * 200, "cd " + "ab cd " * 200
    assert token_counts.word_start(left, len(left) - 60, len(left) - 20) == len(left) - 60 + 2
    assert token_counts.word_start("日" * 90 + " " + "日" * 90, 5, 80) is None and token_counts.word_start(right, 0, 40) == 2


def test_chunks_meet_at_a_space(spark, byte_bpe):
    """Documents cut into many chunks, with and without places between words in their zones."""
    rng = random.Random(6)
    words = ["the", " of", "日" * 50, " ", "\n", "don't", " a", " b", "é", "  x", "-----", "<|endoftext|>"]
    rows = [(i, "".join(rng.choice(words[:k]) for _ in range(900))) for i, k in enumerate((2, 3, 6, 8, 12, 12, 12))] + [(50, " a" * 4000), (51, "日本 " * 3000), (52, "a  b" * 2000)]
    tokenizer = token_counts.load(byte_bpe)
    for chunk, overlap, margin in ((600, 200, 64), (300, 280, 64), (512, 128, 100)):
        got = token_counts.count_tokens(docs_of(spark, rows), byte_bpe, chunk=chunk, overlap=overlap, margin=margin).collect()
        assert sorted((r.id, r.n_tokens) for r in got) == [(i, len(tokenizer.encode(t, add_special_tokens=False).ids)) for i, t in rows]


# ---- 3 toxicity ---------------------------------------------------------------
def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    y = np.array(labels) == 1
    return (order[y].mean() - (y.sum() - 1) / 2) / (~y).sum()


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = entry.queries()["op3_toxicity"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = rows.filter("held_out").join(labels.filter("toxic IS NOT NULL"), "doc_id").select("score", "predicted", "toxic").collect()
    assert auc([r.score for r in held], [r.toxic for r in held]) > 0.97
    hits = sum(r.predicted and r.toxic for r in held)
    assert hits > 0.85 * sum(r.toxic for r in held) and hits > 0.75 * sum(r.predicted for r in held)


def test_toxicity_of_misspelled_words_and_odd_rows(spark, odd):
    rng = random.Random(2)
    clean = ["".join(rng.choice("abdefghilnorstu") for _ in range(6)) for _ in range(300)]
    texts = [" ".join(rng.choices(clean, k=60) + ["wretched", "imbecile"] * (k % 2)) for k in range(200)]
    model = toxicity.Classifier.train(texts, [k % 2 for k in range(200)], 0.5)
    base = " ".join(clean[:60])
    scorer = toxicity.Scorer(model)
    assert scorer.score(base + " wretchedd imbeciles") > 0.9 and scorer.score(base) < 0.5
    got = toxicity.score(odd, model).collect()
    assert len(got) == 13 and all(0 <= r.toxicity <= 1 for r in got)
    labels = spark.createDataFrame([(1, 1), (99, None)], "doc_id long, toxic int")
    assert toxicity.train(odd, labels.limit(0), F.lit(True)).bias < 0


# ---- 4 URL rules --------------------------------------------------------------
def test_url_rules(spark):
    rows = [(1, "https://A.Example.NET/en/x?q"), (2, "http://x.net"), (3, "http://x.net/?a"), (4, None), (5, "no scheme casino"), (6, ""),
            (7, "http://my-net/en/"), (8, "https://example.com/de/1"), (9, "https://example.com/deutsch"), (10, "ftp://u.org/fr/#x"),
            (11, "http://casino.example/"), (12, "http://casinos.example/"), (13, "http://example.net:80/en/"), (13, "http://x.net/"),
            (14, "HTTP://x/" + "a" * 100000), (15, "http://spam-farm.example.org/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in (*CLASHES, "rule", "path", "verdict")})
    got = {(r.page_id, r.url): (r.host, r.rule, r.verdict) for r in url_rules.judge(df).collect()}
    at = lambda i: next(v for (k, _), v in got.items() if k == i)
    assert at(1) == ("a.example.net", "example.net/en/", "allow") and at(2) == ("x.net", None, "allow")
    assert at(3)[1:] == ("net/", "block") and at(4) == ("", None, "allow") and at(5) == ("", None, "block")
    assert at(7)[1] is None and at(8)[1:] == ("example.com/de/", "block") and at(9)[1] is None and at(10)[1:] == ("org/fr/", "allow")
    assert at(11)[2] == "block" and at(12)[2] == "allow" and at(15)[2] == "block"
    assert len(got) == 16 and url_rules.judge(df.limit(0)).count() == 0


def test_url_rules_are_filed_under_their_rarest_token():
    rules = [url_rules.SiteRule("example.net", "/en/", "allow"), url_rules.SiteRule("a.b", "/x*tail", "block")]
    assert rules[0].tokens == {"example", "net", "en"} and rules[1].tokens == {"a", "b"}
    assert list(url_rules.build_index(rules[:1], {"example": 9, "net": 4, "en": 5})) == ["net"]
    assert list(url_rules.build_index([url_rules.PatternRule("p", "x.*", "block", frozenset())], {})) == [None]


# ---- 5 language ID ------------------------------------------------------------
def test_languages_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = entry.queries()["op5_language_id"](spark, sf).filter("held_out").join(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert sum(r.lang_pred == r.lang for r in rows) > 0.97 * len(rows) and sum(r.rejected for r in rows) < 0.01 * len(rows)


def test_language_models_sum_to_one_and_reject_noise(spark, odd):
    rng = random.Random(4)
    make = lambda parts: [" ".join("".join(rng.choices(parts, k=3)) for _ in range(80)) for _ in range(60)]
    texts = {"aa": make(["ba", "ne", "mi", "so"]), "bb": make(["tra", "ulk", "eth", "ox"])}
    models = language_id.LanguageModels({k: v[:40] for k, v in texts.items()})
    models.calibrate({k: v[40:50] for k, v in texts.items()})
    letters = sorted({c for v in texts.values() for t in v for c in t if c != " "})
    for context in ("", "ba", "trau"):
        bits = [models.position_bits([context + c])[0][len(context)] for c in letters]
        end = models.position_bits([context])[0][len(context)] if context else np.inf
        assert (np.exp2(-np.array(bits)).sum(axis=0) + np.exp2(-end) < 1 + 1e-3).all()
    scorer = language_id.Scorer(models)
    assert [scorer.judge(texts[k][55])[0] for k in ("aa", "bb")] == ["aa", "bb"]
    assert not scorer.judge(texts["aa"][56])[3] and scorer.judge("zzqx " * 300)[3]
    got = {r.doc_id: r for r in language_id.identify(odd, models).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 10)] == ["und"] * 4 and got[10].score == 0
    empty = language_id.train(odd.limit(0), F.lit(True))
    assert {r.lang_pred for r in language_id.identify(odd, empty).collect()} == {"und"}


@pytest.mark.parametrize("rare", [0, 1, 6])
def test_noise_and_unlearned_languages_are_rejected_beside_a_rare_label(spark, rare):
    """A label of one row, or of six short ones, must not take the noise in."""
    rng = random.Random(6)
    noise = lambda words: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(words))
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    more = [(-1 - k, noise(300 if rare == 1 else 60)[:300], "xx") for k in range(rare)]
    known = docs.filter("lang <> 'es'").union(spark.createDataFrame(more, docs.schema))
    models = language_id.train(known, ~language_id.held_out() | (F.col("lang") == "xx"))
    assert ("xx" in models.languages) == (rare > 0)
    scorer = language_id.Scorer(models)
    for words in (20, 50, 200):
        assert sum(scorer.judge(noise(words))[3] for _ in range(100)) >= 98, words
    unlearned = [r.text for r in docs.filter("lang = 'es' and length(text) > 400").select("text").collect()]
    assert sum(scorer.judge(t)[3] for t in unlearned) > 0.95 * len(unlearned)
    own = [r.text for r in known.filter(language_id.held_out() & (F.col("lang") != "xx")).select("text").collect() if language_id.WORD.search(r.text or "")]
    assert sum(scorer.judge(t)[3] for t in own) < 0.005 * len(own)


def test_tables_too_small_to_hold_back_are_judged_by_chance():
    models = language_id.LanguageModels({"aa": ["bane mine sone bami mina " * 9], "bb": ["traulk ethox uletra oxulk " * 9]})
    models.calibrate({})
    scorer = language_id.Scorer(models)
    assert not scorer.judge("mine bane")[3] and not scorer.judge("ethox traulk")[3] and scorer.judge("zqwy jqv " * 9)[3]


# ---- 6 SentencePiece ----------------------------------------------------------
@pytest.fixture(scope="module")
def piece():
    import public_tokenizers
    import sentencepiece

    return piece_bpe.given_model(), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(piece):
    model, library = piece
    rng = random.Random(1)
    bits = [" ", "  ", "▁", "\n", "a", "e", "the", "ing", " s", "é", "日", "😀", "\t", "0", ".", "'s", "\0", "ﬁ", "x" * 5, "A", "==", "²", "²."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [" " * k + "the" for k in range(70)]
    for t in texts:
        ids = np.frombuffer(model.encode(t), "<u4").tolist()
        assert ids == library.encode(t, add_bos=True, add_eos=True), repr(t)
        assert model.decode(ids) == library.decode(ids)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(260)]) for _ in range(rng.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids), ids


def test_backtracking_equals_merging():
    """A vocabulary in which the longest match is wrong at first."""
    pieces = ["<unk>", "<s>", "</s>", "a", "b", "c", "d", "ab", "bc", "abc", "cd", "bcd"]
    kinds = ["unknown", "control", "control"] + ["normal"] * 9
    scores = [0, 0, 0] + [-100.0] * 4 + [-1, -2, -3, -1.5, -5]
    model = piece_bpe.PieceModel(pieces, scores, kinds, dummy_prefix=False)
    model._build()
    rng = random.Random(0)
    for _ in range(2000):
        t = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))
        assert model._backtrack(t) == piece_bpe.merge(t, model.rank), t


def test_pieces_of_odd_rows(odd, piece):
    model, library = piece
    back = piece_bpe.decode(piece_bpe.encode(odd, model), model)
    for r in back.select("doc_id", "ids", "text").collect():
        assert r.text == library.decode(np.frombuffer(bytes(r.ids), "<u4").tolist())
    assert back.count() == 13 and set(CLASHES) < set(back.columns)
    assert piece_bpe.encode(odd.limit(0), model).count() == 0


# ---- 7 n-gram join ------------------------------------------------------------
def brute_components(rows, words, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    forest = components.Forest()
    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                forest.join(rows[a][0], rows[b][0])
    return sorted((i, len(s), forest.find(i)) for (i, _), s in zip(rows, sets))


@pytest.mark.parametrize("words,percent,block", [(4, 85, 128), (5, 80, 16)])
def test_join_equals_brute_force(spark, words, percent, block):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = []

    def edited(base, n):
        w = list(base)
        for _ in range(n):
            k = rng.randrange(len(w) + 1)
            w[k:k + rng.choice([0, 1])] = rng.choices(vocabulary, k=rng.choice([0, 1]))
        return rng.choice([" ", "\n\t"]).join(w)

    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 8, 12, 20, 40, 63, 64, 75, 90, 300]))
        texts += [edited(base, rng.choice([0, 0, 1, 2])) for _ in range(rng.choice([1, 2, 4]))]
    hot = rng.choices(vocabulary, k=150)
    texts += [edited(hot, rng.choice([0, 1, 2, 3])) for _ in range(60)]
    line = rng.choices(vocabulary, k=12)
    texts += [" ".join(line + rng.choices(vocabulary, k=rng.randrange(4))) for _ in range(30)] + ["", None, " \n"]
    rows = list(enumerate(texts))
    got = ngram_join.JaccardJoin(docs_of(spark, rows), words, percent, block=block).members()
    assert sorted(tuple(r) for r in got.select("id", "n", "component").collect()) == brute_components(rows, words, percent)


def test_signatures_and_bound_lose_no_link():
    """Around the sizes at which levels, and the number of coordinates, change."""
    rng = np.random.default_rng(8)
    lows = set(ngram_join.levels(85)[0][:8].tolist())
    for n in sorted({6, 20, 63, 64, 65, 74, 75, 76, 767, 768, 1535, 1536, 3000} | lows):
        base = np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64) * np.uint64(2))
        for share in (1.0, 0.99, 0.95, 0.9, 0.86):
            keep = rng.permutation(base)[: int(np.ceil(n * share))]
            other = np.unique(np.concatenate([keep, rng.integers(0, 2 ** 63, max(0, int(n * (1 - share) / 8)), dtype=np.uint64)]))
            if not ngram_join.alike(base, other, 85) or np.array_equal(base, other):
                continue
            assert np.intersect1d(ngram_join.signatures(base, 85), ngram_join.signatures(other, 85)).size, (n, share)
            points = ngram_join.unpacked([ngram_join.packed(ngram_join.counts(h, ngram_join.bits_for(len(h)))) for h in (base, other)])
            assert list(ngram_join.passing_pairs([1, 2], points, np.array([len(base), len(other)]), 85)) == [(1, 2)]


def test_bound_parts_unlike_sets_of_any_size():
    rng = np.random.default_rng(9)
    for n in (300, 1000, 5000, 20000):
        sets = [np.unique(rng.integers(0, 2 ** 64, n, dtype=np.uint64)) for _ in range(20)]
        points = np.stack([ngram_join.counts(h, ngram_join.bits_for(n)) for h in sets])
        assert not list(ngram_join.passing_pairs(list(range(20)), points, np.array(list(map(len, sets))), 85)), n


def test_join_of_odd_rows(spark, odd):
    got = sorted((str(r.id), r.n, r.component) for r in ngram_join.JaccardJoin(odd, 4, 85).members().collect())
    assert len(got) == 13 and ("5", 1, 4) in got and ("2", 0, 2) in got and ("None", 1, None) in got
    assert ngram_join.JaccardJoin(odd.limit(0)).members().count() == 0


def test_one_id_on_two_texts(spark):
    """Each text has its own component, and the stage drops a row by its id and text."""
    rng = random.Random(6)
    a, b = ([f"w{rng.randrange(500)}" for _ in range(60)] for _ in range(2))
    near = [*a[:30], "other", *a[31:]]
    rows = [(4, " ".join(a)), (5, " ".join(near)), (5, " ".join(b)), (6, " ".join([*b, "more"])), (7, " ".join(b[:20])), (7, " ".join(near)),
            (8, " ".join(a)), (8, " ".join(near))]
    docs = docs_of(spark, rows)
    got = sorted((r.id, r.n, r.component) for r in ngram_join.JaccardJoin(docs, 5, 70).members().collect())
    assert got == [(4, 56, 4), (5, 56, 4), (5, 56, 5), (6, 57, 5), (7, 16, 7), (7, 56, 4), (8, 56, 4), (8, 56, 4)]
    kept = sorted((r.doc_id, r.text) for r in ngram_join.stage(spark, docs, "").collect())
    assert kept == sorted([rows[0], rows[2], rows[4]])


def test_words_over_part_borders(monkeypatch):
    text = b" ".join(b"word%d" % k for k in range(3000))
    whole = ngram_join.word_hashes(text)
    monkeypatch.setattr(ngram_join, "PART_BYTES", 100)
    assert (ngram_join.word_hashes(text) == whole).all() and len(whole) == 3000


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100)] + [(500, k) for k in range(501, 600)] + [(700, 700)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = dict(map(tuple, components.connected_components(df).collect()))
    assert got == {k: 0 for k in range(1, 101)} | {k: 500 for k in range(501, 600)}


# ---- 8 WARC -------------------------------------------------------------------
def test_warc_of_odd_pages(spark, tmp_path):
    rows = [(1, "http://a/", "x"), (2, "http://b/\r\nX: y", "x"), (3, None, None), (4, "u", ""), (5, "u", "é" * 300000), (5, "u", "é" * 300000),
            (None, "u", "alone"), (6, "u", "a\r\n\r\nb")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in (*CLASHES, "payload", "keep")})
    files = warc_zstd.write_warc(df, str(tmp_path / "w"), archive_bytes=1000)
    got = warc_zstd.read_warc(files).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == sorted([
        ("1", "revisit", 2), ("2", "response", None), ("3", "revisit", 4), ("4", "response", None), ("5", "response", None),
        ("5", "response", None), ("None", "response", None), ("6", "response", None)])
    assert {r.payload.decode() for r in got if r.payload is not None} == {"x", "", "é" * 300000, "alone", "a\r\n\r\nb"}
    assert warc_zstd.read_warc(warc_zstd.write_warc(df.limit(0), str(tmp_path / "e"))).count() == 0
    least = warc_zstd.read_warc(warc_zstd.write_warc(df, str(tmp_path / "l"), least=2)).collect()
    assert {r.record_type for r in least if r.page_id in (1, 2, 3, 4)} == {"response"}


def test_archives_of_another_attempt_are_not_read(spark, tmp_path):
    """A second run into the same folder, with other cuts, overwrites nothing and mixes with nothing."""
    df = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * 50) for i in range(60)], "page_id long, url string, html string").repartition(2)
    first = warc_zstd.write_warc(df, str(tmp_path / "w"), archive_bytes=3000)
    second = warc_zstd.write_warc(df, str(tmp_path / "w"), archive_bytes=1000)
    assert {r.file for r in first.collect()}.isdisjoint({r.file for r in second.collect()})
    for files in (first, second):
        assert sorted(r.page_id for r in warc_zstd.read_warc(files).collect()) == list(range(60))


def test_archives_hold_their_dictionary():
    records = [warc_zstd.record_bytes(k, f"http://h/{k}", b"<html>common words of a page %d</html>" % k * 5, None) for k in range(500)]
    data, used = warc_zstd.write_archive(records, 3, 4096, 1 << 20)
    plain, _ = warc_zstd.write_archive(records[:1], 3, 4096, 1 << 20)
    assert used > 0 and data[:4] == bytes.fromhex("5d2a4d18") and len(data) < 500 * len(plain) / 2
    assert [r for _, r in warc_zstd.read_archive(data)] == records
    with pytest.raises(ValueError):
        list(warc_zstd.read_archive(data[:-3]))


# ---- 9 mixing -----------------------------------------------------------------
def test_targets():
    assert [float(x) for x in mixing.targets([100, 100, 100], (3, 1, 2), 450)] == [200, 250 / 3, 500 / 3]
    assert [float(x) for x in mixing.targets([10, 0, 30], (3, 1, 2), 60)] == [20, 0, 40]
    assert mixing.targets([], (), 0) == []


def test_permutations():
    for n in (1, 2, 3, 17, 1000):
        got = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 5))
        assert sorted(got.tolist()) == list(range(n))


def test_draws_use_up_every_quota():
    slots = [500, 3, 0, 1200]
    rows = mixing.draw(slots, 100, 7)
    assert [sum(n for _, s, _, n in rows if s == i) for i in range(4)] == slots
    assert {sum(n for k, _, _, n in rows if k == shard) for shard in range(17)} == {100} and rows == mixing.draw(slots, 100, 7)


def test_mix_meets_targets(spark, sf_dir):
    rows = entry.queries()["op9_mixing"](spark, sf_dir).collect()
    again = entry.queries()["op9_mixing"](spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts) and all(r.size == len(texts[r.doc_id].encode().split()) and r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for of in by.values():
        assert sum(r.size for r in of) == of[0].source_size and abs(sum(r.taken for r in of) - of[0].target) <= 1


def test_pieces_fill_whole_blocks(spark, odd):
    mix = mixing.Mix(odd, block=50, shard_slots=64)
    pieces = mix.pieces().collect()
    words = {}
    for p in pieces:
        words[p.shard, p.place] = words.get((p.shard, p.place), 0) + p.words
    assert max(words.values()) == 50 and sum(w < 50 for w in words.values()) <= 12
    taken = mix.taken().collect()
    assert len(taken) == 13 and sum(r.taken for r in taken) == sum(p.words for p in pieces)
    assert mixing.Mix(odd.limit(0)).taken().count() == 0


# ---- 10 exact dedup -----------------------------------------------------------
def test_batches_against_one_index(spark, odd):
    index = exact_dedup.fresh_index(spark)
    first = {(str(r.id), r.kept, r.keep_id) for r in exact_dedup.deduplicate(odd, index).collect()}
    assert ("4", False, 5) in first and ("5", True, 5) in first and ("None", True, None) in first and ("1", False, 2) in first
    more = docs_of(spark, [(50, "SAME text here"), (51, "new one"), (52, "NEW one")])
    second = {r.id: (r.kept, r.keep_id) for r in exact_dedup.deduplicate(more, index).collect()}
    assert second == {50: (False, 5), 51: (False, 52), 52: (True, 52)}
    reopened = exact_dedup.DigestIndex(spark, index.path, index.buckets)
    assert reopened.table().count() == index.rows().count() == len({(r.text or "").lower() for r in odd.collect()}) + 1
    assert exact_dedup.deduplicate(odd.limit(0), exact_dedup.fresh_index(spark)).count() == 0


def test_index_side_is_not_shuffled(spark, odd):
    """The anti-join against a filled index is a sort-merge join, though the index is small enough to broadcast."""
    index = exact_dedup.fresh_index(spark)
    exact_dedup.deduplicate(odd, index).count()
    groups = spark.createDataFrame([(bytearray(hashlib.sha256(b"a").digest()),)], "digest binary")
    plan = index.fresh(groups)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_batches_of_one_table_decide_alike(spark, odd, batches):
    rng = random.Random(3)
    more = docs_of(spark, [(rng.choice([None, *range(100)]), rng.choice("abcdefgh")) for _ in range(300)])
    rows = odd.unionByName(more)
    groups = {}
    for r in rows.collect():
        groups.setdefault("".join(c.lower() if c.isascii() else c for c in r.text or ""), []).append(r.doc_id)
    want = sorted(str((i, max((x for x in ids if x is not None), default=None), len(ids), i == max((x for x in ids if x is not None), default=None)))
                  for ids in groups.values() for i in ids)
    index = exact_dedup.fresh_index(spark)
    got = exact_dedup.deduplicate(rows, index, batches=batches).select("id", "keep_id", "group_size", "kept").collect()
    assert sorted(str(tuple(r)) for r in got) == want
    assert index.table().count() == len(groups)
    parts = exact_dedup.falling_batches(rows.select(F.col("doc_id").alias("id")), batches)
    assert sum(p.count() for p in parts) == rows.count()
