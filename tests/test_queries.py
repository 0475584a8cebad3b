"""The registered queries against their SQL at the smallest scale, and the plans they get."""

import re

import pytest

import __spark_entry__ as entry
import check

FAST = [n for n in entry.queries() if n[0] in "abcdefglqo" and n in entry.oracle_sql()
        and n not in ("o4_out_of_fold", "g11_ngram_jaccard") and not re.match(r"op\d", n)]


@pytest.fixture(scope="module")
def con(sf_dir):
    return check.connect(sf_dir)


@pytest.mark.parametrize("name", [*FAST, "i4_weighted_word_overlap", "j5_char_binary", "k6_hellinger_sim"])
def test_query_matches_sql(spark, con, sf_dir, name):
    result, _ = check.compare(spark, con, name, sf_dir)
    assert result == "ok"


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["d1_attach_vectors", "h2_lexical_features", "l1_stratified_split", "q8_threshold_sweep", "d3_attach_pair_scores"])
def test_plans_have_no_nested_loops(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_scans_are_pruned(spark, sf_dir):
    text = plan(entry.queries()["l1_stratified_split"](spark, sf_dir))
    assert "embedding:" not in text and "ReadSchema: struct<vec_id:bigint,label:int>" in text


def test_wide_vector_tables_are_not_broadcast_by_hint(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(entry.queries()["f1_cos_sim"](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in text and text.count("SortMergeJoin") >= 3
