"""The pipeline's stages on ordinary and odd rows."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from pairkit.llm import language_id, piece_bpe
from test_operators import brute_components, docs_of


def test_stages_keep_what_they_should(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, sf_dir)
    assert kept.columns == docs.columns and kept.count() == len(texts)
    single = stages["exact_dedup"](spark, kept, sf_dir)
    lowered = {}
    for i, t in texts.items():
        lowered.setdefault(t.encode().lower(), []).append(i)
    assert sorted(r.doc_id for r in single.collect()) == sorted(max(v) for v in lowered.values())
    rows = sorted((r.doc_id, r.text) for r in single.collect())
    apart = stages["ngram_join"](spark, single, sf_dir)
    assert sorted(r.doc_id for r in apart.collect()) == [i for i, _, c in brute_components(rows, 5, 80) if i == c]
    mixed = stages["mixing"](spark, apart, sf_dir)
    assert mixed.columns == docs.columns
    taken, size = {}, {r.doc_id: len(r.text.split()) for r in apart.collect()}
    for r in mixed.collect():
        assert r.n_chars == len(r.text) and set(r.text.split()) <= set(texts[r.doc_id].split())
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.encode().split())
    assert all(n <= 2 * size[i] for i, n in taken.items()) and 1.3 < sum(taken.values()) / sum(size.values()) < 1.6
    encoded = stages["sentencepiece"](spark, mixed, sf_dir).collect()
    model = piece_bpe.given_model()
    back = sorted((r.doc_id, model.decode(bytes(r.ids))) for r in encoded)
    assert back == sorted((r.doc_id, r.text) for r in mixed.collect())
    assert all(r.n_tokens == len(np.frombuffer(bytes(r.ids), "<u4")) for r in encoded)


def test_odd_rows_pass_all_stages(spark, sf_dir):
    texts = [(k, f"plain words number {k} of a longer text that differs in part {k * 7} and more") for k in range(40)]
    texts += [(1, None), (2, ""), (None, "some words without any id at all"), (None, None), (3, texts[3][1]), (99, "word " * 20000)]
    docs = docs_of(spark, texts)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert {"id", "score", "start", "ids"} <= set(docs.columns) and {r.start for r in docs.collect()} <= {"x"}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count() > 0
    empty = docs_of(spark, texts).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0


def test_rejected_documents_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    noise = docs.limit(2).selectExpr("doc_id + 1000000 AS doc_id", "repeat('zzqx vvkj ', 400) AS text", "CAST(NULL AS STRING) AS lang",
                                     "source", "n_chars")
    got = language_id.stage(spark, docs.unionByName(noise), sf_dir)
    assert got.filter("doc_id >= 1000000").count() == 0 and got.count() == docs.count()


def test_stages_hand_python_workers_few_rows_at_a_time(spark, sf_dir):
    """Whole texts are large, and workers keep what they once took."""
    def sizes(batches):
        yield from (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches)

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for _, stage in corpus_pipeline.STAGES[-1:]:
        stage(spark, docs_of(spark, [(1, "some words")]), sf_dir)
        assert max(r.n for r in spark.range(0, 3000, 1, 1).mapInArrow(sizes, "n bigint").collect()) <= 512
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
