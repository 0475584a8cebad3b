"""Registered queries of the subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from pairkit.llm import (exact_dedup, language_id, mixing, ngram_join, piece_bpe, repeated_windows, spelling_variants, token_counts,
                         topk_search, toxicity, turn_repair, url_rules, warc_zstd)
from pairkit.session import tune

Query = Callable[[SparkSession, str], DataFrame]


def _tuned(query: Query) -> Query:
    return lambda spark, sf_dir: query(tune(spark), sf_dir)


QUERIES: dict[str, Query] = {f.__name__: _tuned(f) for f in (
    topk_search.op1_topk_search, token_counts.op2_token_counts, toxicity.op3_toxicity, url_rules.op4_url_filters,
    language_id.op5_language_id, piece_bpe.op6_sentencepiece, ngram_join.op7_ngram_join, warc_zstd.op8_warc,
    mixing.op9_mixing, exact_dedup.op10_exact_dedup, turn_repair.op11_turn_repair, repeated_windows.op12_repeated_windows,
    spelling_variants.op13_spelling_variants)}
QUERIES["pipeline"] = corpus_pipeline.run

OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS keep FROM p GROUP BY html),
j AS (SELECT p.*, keep FROM p JOIN g USING (html)),
h AS (SELECT *, strlen(html) AS payload_bytes, sha1(html) AS hex,
             page_id IS NOT DISTINCT FROM keep AS first FROM j),
b AS (SELECT *, array_to_string(list_transform(range(32), lambda i: (
        -- 5 bits of the digest for each base32 letter, from at most two of its hex digits
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
          ((((instr('0123456789abcdef', substr(hex, CAST(floor(5 * i / 4) AS INTEGER) + 1, 1)) - 1) * 16
            + (instr('0123456789abcdef', substr(hex || '0', CAST(floor(5 * i / 4) AS INTEGER) + 2, 1)) - 1))
           // CAST(pow(2, 3 - (5 * i) % 4) AS INTEGER)) % 32) AS INTEGER), 1))), '') AS payload_digest FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first THEN NULL ELSE keep END AS refers_to FROM b
"""

SQL: dict[str, str] = {
    "op1_topk_search": topk_search.OP1_SQL, "op4_url_filters": url_rules.OP4_SQL, "op7_ngram_join": ngram_join.OP7_SQL,
    "op8_warc": OP8_SQL, "op10_exact_dedup": exact_dedup.OP10_SQL, "op12_repeated_windows": repeated_windows.OP12_SQL,
    "op13_spelling_variants": spelling_variants.OP13_SQL}
