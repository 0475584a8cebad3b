"""Per-pair text features and feature sets over whole documents."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks.core import DP, DT, TP, VP, VV, add, r6, rounded, with_, word_tokens, ws_tokens
from checks.vector_checks import DIM, DIMS, GAPS, STAT_SQL, digest, joined, prefix_exprs
from pairkit.functions import sequence, text as tx
from pairkit.operators import features
from pairkit.plans import samples


def token_query(tokenizer):
    return lambda spark, sf_dir: (
        samples.documents(spark, sf_dir).withColumn("t", tokenizer("text"))
        .select("qid", F.size("t").cast("bigint").alias("n_tokens"),
                F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"),
                F.md5(F.array_join("t", "|")).alias("digest")))


def token_sql(expr):
    return f"""SELECT doc_id AS qid, CAST(len(t) AS BIGINT) AS n_tokens,
CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, md5(array_to_string(t, '|')) AS digest
FROM (SELECT doc_id, {expr} AS t FROM documents)"""


add("g1_tokenize_ws", token_query(tx.whitespace_tokens), token_sql(ws_tokens("text")))
add("g2_tokenize_word", token_query(tx.word_tokens), token_sql(word_tokens("text")))
add("g2_tokenize_topic", token_query(tx.topic_tokens),
    token_sql(f"list_filter({word_tokens('text')}, lambda x: length(x) >= 2)"))


def div(a, b):
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / {b} END"


def staged_query(columns, ngrams=False):
    """Query over document pairs whose token arrays are staged."""
    def query(spark, sf_dir):
        df = features.with_tokens(samples.document_pairs(spark, sf_dir))
        if ngrams:
            df = features.with_ngrams(df)
        return rounded(df.select("qid1", "qid2", *[
            c.cast("double").alias(n) for n, c in columns().items()]))

    return query


def staged_sql(exprs, *ctes):
    return with_(DT, *ctes, select="SELECT qid1, qid2, " + ", ".join(
        r6(e, n) for n, e in exprs.items()) + " FROM sz")


def pick(columns, *names):
    return lambda: {n: columns()[n] for n in names}


LENGTH_SQL = {
    "len_q1_chars": "length(q1)", "len_q2_chars": "length(q2)", "char_len_diff": "abs(length(q1) - length(q2))",
    "len_q1_words": "len(t1)", "len_q2_words": "len(t2)", "word_len_diff": "abs(len(t1) - len(t2))"}
OVERLAP_SQL = {
    "token_intersection": "inter", "token_union": "n1 + n2 - inter",
    "jaccard": div("inter", "(n1 + n2 - inter)"), "overlap_min": div("inter", "least(n1, n2)")}

add("g3_safe_div", staged_query(lambda: {"words_per_word": tx.safe_div(F.size("__t1"), F.size("__t2")),
                                         "by_zero": tx.safe_div(F.size("__t1"), F.size("__t2") - F.size("__t2"))}),
    staged_sql({"words_per_word": div("len(t1)", "len(t2)"), "by_zero": "0"}))
for key, names in {"g4_char_lengths": list(LENGTH_SQL)[:3], "g5_word_lengths": list(LENGTH_SQL)[3:]}.items():
    add(key, staged_query(pick(features.length_columns, *names)), staged_sql({n: LENGTH_SQL[n] for n in names}))
for key, names in {"g6_token_sets": ["token_intersection", "token_union"], "g7_jaccard": ["jaccard"],
                   "g8_overlap_min": ["overlap_min"]}.items():
    add(key, staged_query(pick(features.overlap_columns, *names)), staged_sql({n: OVERLAP_SQL[n] for n in names}))

# Matching blocks have no SQL form; tests compare them with a brute-force run.
add("g9_sequence_ratio",
    lambda spark, sf_dir: rounded(features.matching_block_features().apply(samples.document_pairs(spark, sf_dir))
                                  .select("qid1", "qid2", *sequence.NAMES)))


# Word runs by position: token i joined with its followers.
RUNS = DT + """,
pos AS (SELECT qid, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM dtok),
runs AS (
  SELECT qid, i, w AS g1, """ + ", ".join(
    " || ' ' || ".join(["w"] + [f"lead(w, {k}) OVER o" for k in range(1, n)]) + f" AS g{n}" for n in range(2, 7)) + """
  FROM pos WINDOW o AS (PARTITION BY qid ORDER BY i))"""

add("g10_word_ngrams",
    lambda spark, sf_dir: samples.documents(spark, sf_dir)
    .withColumn("t", tx.whitespace_tokens("text"))
    .select("qid", *[F.md5(F.array_join(tx.word_ngrams("t", n), "|")).alias(f"digest_{n}") for n in (2, 3, 6)]),
    with_(RUNS, "dig AS (SELECT qid, " + ", ".join(
        f"string_agg(g{n}, '|' ORDER BY i) AS d{n}" for n in (2, 3, 6)) + " FROM runs GROUP BY qid)",
        select="SELECT docs.qid, " + ", ".join(f"md5(coalesce(d{n}, '')) AS digest_{n}" for n in (2, 3, 6))
        + " FROM docs LEFT JOIN dig ON dig.qid = docs.qid"))

NGRAM_CTES = (
    "gr AS (" + " UNION ALL ".join(
        f"SELECT DISTINCT qid, {n} AS n, g{n} AS gram FROM runs WHERE g{n} IS NOT NULL" for n in range(1, 7)) + ")",
    "gc AS (SELECT qid, n, count(*) AS c FROM gr GROUP BY qid, n)",
    """gi AS (SELECT l.qid1, l.qid2, a.n, count(*) AS inter FROM links l JOIN gr a ON a.qid = l.qid1
      JOIN gr b ON b.qid = l.qid2 AND b.n = a.n AND b.gram = a.gram GROUP BY l.qid1, l.qid2, a.n)""",
    """gj AS (SELECT l.qid1, l.qid2, ns.n, coalesce(gi.inter, 0) AS inter,
      coalesce(c1.c, 0) + coalesce(c2.c, 0) - coalesce(gi.inter, 0) AS either
      FROM links l CROSS JOIN (SELECT unnest(range(1, 7)) AS n) ns
      LEFT JOIN gc c1 ON c1.qid = l.qid1 AND c1.n = ns.n LEFT JOIN gc c2 ON c2.qid = l.qid2 AND c2.n = ns.n
      LEFT JOIN gi ON gi.qid1 = l.qid1 AND gi.qid2 = l.qid2 AND gi.n = ns.n)""")
add("g11_ngram_jaccard", staged_query(features.ngram_columns, ngrams=True),
    with_(RUNS, *NGRAM_CTES, select="SELECT qid1, qid2, " + ", ".join(
        r6(f"max(CASE WHEN n = {n} THEN {div('inter', 'either')} END)", f"ngram_{n}_jaccard")
        for n in range(1, 7)) + " FROM gj GROUP BY qid1, qid2"))
add("g12_common_word_pct",
    lambda spark, sf_dir: rounded(features.classical_text_features.apply(
        samples.document_pairs(spark, sf_dir)).select("qid1", "qid2", "common_word_pct")),
    staged_sql({"common_word_pct": OVERLAP_SQL["jaccard"]}))

BOUNDARY_SQL = {
    "same_start_word": "CASE WHEN t1[1] = t2[1] THEN 1 ELSE 0 END",
    "same_end_word": "CASE WHEN t1[-1] = t2[-1] THEN 1 ELSE 0 END",
    "same_start_2gram": "CASE WHEN len(t1) >= 2 AND len(t2) >= 2 AND t1[1] = t2[1] AND t1[2] = t2[2] THEN 1 ELSE 0 END"}
CONDITIONAL_SQL = {
    f"common_pct_when_same_{end}": f"({BOUNDARY_SQL[f'same_{end}_word']}) * ({OVERLAP_SQL['jaccard']})"
    for end in ("start", "end")}
SHAPE_SQL = {
    "len_q1_unique_words": "n1", "len_q2_unique_words": "n2",
    "avg_word_len_q1": div("list_sum(list_transform(t1, lambda w: length(w)))", "len(t1)"),
    "avg_word_len_q2": div("list_sum(list_transform(t2, lambda w: length(w)))", "len(t2)"),
    "char_len_ratio": div("length(q1)", "length(q2)")}
add("g13_boundary_flags", staged_query(features.boundary_columns), staged_sql(BOUNDARY_SQL))


def conditional(spark, sf_dir):
    df = features.with_tokens(samples.document_pairs(spark, sf_dir)).withColumns(
        {**features.boundary_columns(), "common_word_pct": features.overlap_columns()["jaccard"]})
    return rounded(df.select("qid1", "qid2", *[
        c.cast("double").alias(n) for n, c in features.conditional_columns().items()]))


add("g14_conditional_overlap", conditional, staged_sql(CONDITIONAL_SQL))
for key, names in {"g15_unique_words": ["len_q1_unique_words", "len_q2_unique_words"],
                   "g16_avg_word_len": ["avg_word_len_q1", "avg_word_len_q2"],
                   "g17_char_len_ratio": ["char_len_ratio"]}.items():
    add(key, staged_query(pick(features.word_shape_columns, *names)), staged_sql({n: SHAPE_SQL[n] for n in names}))


def class_count(q, cls):
    return rf"length(regexp_replace({q}, '[^{cls}]+', '', 'g'))"


def char_count(q, chars):
    return f"length({q}) - length(translate({q}, '{chars}', ''))"


COUNTERS = {"caps": lambda q: class_count(q, r"\p{Lu}"), "qmarks": lambda q: char_count(q, "?"),
            "excl": lambda q: char_count(q, "!"), "digits": lambda q: class_count(q, r"\p{Nd}"),
            "math": lambda q: char_count(q, "+-*/=^%<>")}
SURFACE_SQL = {f"n_{k}_q{i}": count(f"q{i}") for k, count in COUNTERS.items() for i in (1, 2)}
SURFACE_SQL["caps_diff"] = f"abs({SURFACE_SQL['n_caps_q1']} - {SURFACE_SQL['n_caps_q2']})"
for key, kinds in {"g18_caps": ("caps",), "g19_marks": ("qmarks", "excl"), "g20_digits": ("digits",),
                   "g21_math": ("math",)}.items():
    names = [n for n in SURFACE_SQL if any(k in n for k in kinds)]
    add(key, staged_query(pick(features.surface_columns, *names)), staged_sql({n: SURFACE_SQL[n] for n in names}))

STARTER_SQL = {f"q{i}_starts_{w}": f"CASE WHEN t{i}[1] = '{w}' THEN 1 ELSE 0 END"
               for w in tx.STARTERS for i in (1, 2)}
LISTED = ", ".join(f"'{w}'" for w in tx.STARTERS)
SAME_STARTER_SQL = {"q1q2_same_starter": f"CASE WHEN t1[1] = t2[1] AND t1[1] IN ({LISTED}) THEN 1 ELSE 0 END"}
QUESTION_SQL = {f"q{i}_is_question": rf"CASE WHEN regexp_matches(q{i}, '\?[\x09-\x0D\x1C-\x20\x{{85}}\p{{Z}}]*\z') THEN 1 ELSE 0 END"
                for i in (1, 2)}
add("g22_starters", staged_query(pick(features.starter_columns, *STARTER_SQL)), staged_sql(STARTER_SQL))
add("g23_same_starter", staged_query(pick(features.starter_columns, *SAME_STARTER_SQL)), staged_sql(SAME_STARTER_SQL))
add("g24_is_question", staged_query(features.question_columns), staged_sql(QUESTION_SQL))

# ---- feature sets ------------------------------------------------------------
add("h2_lexical_features",
    lambda spark, sf_dir: rounded(features.lexical_features.apply(
        samples.document_pairs(spark, sf_dir)).select("qid1", "qid2", *features.LEXICAL)),
    staged_sql({**LENGTH_SQL, **OVERLAP_SQL}))
NGRAM_NAMES = [f"ngram_{n}_jaccard" for n in range(1, 7)]
NGRAM_TABLE = "ng AS (SELECT qid1, qid2, " + ", ".join(
    f"max(CASE WHEN n = {n} THEN {div('inter', 'either')} END) AS {name}" for n, name in enumerate(NGRAM_NAMES, 1)) + " FROM gj GROUP BY qid1, qid2)"
CLASSICAL_SQL = {**{n: n for n in NGRAM_NAMES}, "common_word_pct": OVERLAP_SQL["jaccard"], **BOUNDARY_SQL, **CONDITIONAL_SQL, **LENGTH_SQL,
                 **SHAPE_SQL, **SURFACE_SQL, **STARTER_SQL, **SAME_STARTER_SQL, **QUESTION_SQL}
CLASSICAL_EXPRS = [r6(CLASSICAL_SQL[n], n) for n in features.CLASSICAL]
# the runs of words again, with conversation turns in place of documents
TURN_RUNS = """turns AS (SELECT conv_id * 100000 + turn AS qid, text FROM conversations),
docs AS (SELECT qid, text FROM turns),
links AS (SELECT a.qid AS qid1, b.qid AS qid2 FROM turns a JOIN turns b ON b.qid = a.qid + 1)""" + RUNS.removeprefix(DP)
add("h3_classical_text_features",
    lambda spark, sf_dir: rounded(features.classical_text_features.apply(
        samples.turn_pairs(spark, sf_dir)).select("qid1", "qid2", *features.CLASSICAL)),
    with_(TURN_RUNS, *NGRAM_CTES, NGRAM_TABLE, select="SELECT qid1, qid2, " + ", ".join(CLASSICAL_EXPRS) + " FROM sz JOIN ng USING (qid1, qid2)"))


def full(spark, sf_dir):
    return joined(spark, sf_dir).transform(samples.with_texts, samples.documents(spark, sf_dir))


FULL_CTES = (VP, VV, GAPS, DP, f"""dtok AS (SELECT qid, text, {ws_tokens('text')} AS t FROM docs),
sz AS (
  SELECT gp.*, a.text AS q1, b.text AS q2, a.t AS t1, b.t AS t2, len(list_distinct(a.t)) AS n1,
         len(list_distinct(b.t)) AS n2, len(list_intersect(a.t, b.t)) AS inter
  FROM gp JOIN dtok a ON a.qid = gp.qid1 JOIN dtok b ON b.qid = gp.qid2)""")
LEXICAL_EXPRS = [r6(e, n) for n, e in {**LENGTH_SQL, **OVERLAP_SQL}.items()]
ALL_SQL = with_(*FULL_CTES, select="SELECT qid1, qid2, " + ", ".join(
    [r6(STAT_SQL[n], n) for n in features.EMBEDDING] + LEXICAL_EXPRS) + " FROM sz")


def set_query(build):
    def query(spark, sf_dir):
        chosen = build()
        return rounded(chosen.apply(full(spark, sf_dir)).select("qid1", "qid2", *chosen.names))

    return query


add("h4_all_features", set_query(lambda: features.all_features(DIM)), ALL_SQL)
add("h5_prefix_all_features", set_query(lambda: features.prefix_all_features(DIM, DIMS)),
    with_(*FULL_CTES, select="SELECT qid1, qid2, " + ", ".join(prefix_exprs(DIMS) + LEXICAL_EXPRS) + " FROM sz"))


def prefix_classical(spark, sf_dir):
    """The widest feature set without corpus statistics, for document pairs that have vectors."""
    from pairkit.operators import joins

    pairs = joins.attach_vectors(samples.document_pairs(spark, sf_dir), samples.vectors(spark, sf_dir))
    chosen = features.prefix_classical_features(DIM, DIMS)
    return rounded(chosen.apply(pairs).select("qid1", "qid2", *chosen.names))


add("h6_prefix_classical_features", prefix_classical,
    with_(RUNS, *NGRAM_CTES, NGRAM_TABLE, "vp AS (SELECT qid1, qid2, label FROM dp)", VV, GAPS, select="SELECT qid1, qid2, " + ", ".join(
        prefix_exprs(DIMS) + LEXICAL_EXPRS + [r6(CLASSICAL_SQL[n], n) for n in features.CLASSICAL if n not in features.LEXICAL])
          + " FROM sz JOIN ng USING (qid1, qid2) JOIN gp USING (qid1, qid2)"))


def matrix(spark, sf_dir):
    vectors = features.build_matrix(full(spark, sf_dir), features.all_features(DIM))
    return rounded(vectors.select("qid1", "qid2", "label", *digest(vector_to_array("features"))))


MATRIX_VALUES = ", ".join(f"CAST({e} AS DOUBLE)" for e in [
    *(STAT_SQL[n] for n in features.EMBEDDING), *({**LENGTH_SQL, **OVERLAP_SQL}[n] for n in features.LEXICAL)])
add("h8_build_matrix", matrix,
    with_(*FULL_CTES, f"m AS (SELECT qid1, qid2, label, [{MATRIX_VALUES}] AS x FROM sz)",
          select="SELECT qid1, qid2, label, CAST(len(x) AS BIGINT) AS n_values, "
          + r6("list_sum(x)", "total") + ", "
          + r6("list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] * i))", "weighted") + " FROM m"))


def user_features(spark, sf_dir):
    """A user's own expressions, registered and then used like a built-in set."""
    own = features.register("per_word", features.from_columns({
        "chars_per_word": tx.safe_div(F.length("question1"), F.size(tx.whitespace_tokens("question1"))),
        "same_text": F.col("question1") == F.col("question2")}))
    return rounded(own.apply(samples.turn_pairs(spark, sf_dir)).select("qid1", "qid2", *own.names))


add("s1_user_features", user_features,
    with_(TP, select="SELECT qid1, qid2, " + r6(div("length(question1)", f"len({ws_tokens('question1')})"), "chars_per_word")
          + ", " + r6("CASE WHEN question1 = question2 THEN 1 ELSE 0 END", "same_text") + " FROM tp"))
