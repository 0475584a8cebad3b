"""Exact dedup against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, one row for each text ever
added. A new batch is reduced to its distinct digests; a sort-merge anti-join drops those
the index has, and the rest is appended. The index side of that join needs no shuffle. What a
later batch has of known texts is noted in a second table of the same layout, so group sizes
grow over batches.

A table is added in batches of falling ids, so each batch but the first meets a filled index,
and the first row of a text to come in is that with the largest id. Texts are equal when they
agree after lower-casing A-Z only; NULL counts as empty. A text that the index has from before
stays out whatever its id. Rows without an id come last and stay only if no equal text has one.
Rows that repeat an id and its text are one document and share the decision. An empty table
leaves the index as it is. The stage keeps columns of any name; the query reads id and text alone.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairkit.session import materialize, scratch_path

INDEX_SCHEMA = "digest BINARY, keep_id BIGINT, group_size BIGINT"


def normalised(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digest(text: str | Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """Digest tables below `path`, kept across sessions; `buckets` must stay the same for one path."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.texts, self.again = self._table("texts"), self._table("again")

    def _table(self, kind: str) -> str:
        name = f"digest_{kind}_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({INDEX_SCHEMA}) USING parquet "
                       f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{kind}'")
        return name

    def table(self) -> DataFrame:
        return self.spark.table(self.texts)

    def rows(self) -> DataFrame:
        """digest, keep_id, group_size over all batches; read as plain files, a shape whose join partitions AQE can split."""
        read = lambda kind: self.spark.read.schema(INDEX_SCHEMA).parquet(f"{self.path}/{kind}")
        more = read("again").groupBy("digest").agg(F.sum("group_size").alias("more"))
        return read("texts").join(more, "digest", "left").select(
            "digest", "keep_id", (F.col("group_size") + F.coalesce("more", F.lit(0))).alias("group_size"))

    def fresh(self, groups: DataFrame) -> DataFrame:
        """The groups (digest, ...) whose digest the index does not have."""
        return groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")

    def _write(self, rows: DataFrame, kind: str, name: str) -> None:
        (rows.select("digest", "keep_id", "group_size").repartition(self.buckets, "digest")
         .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
         .option("path", f"{self.path}/{kind}").saveAsTable(name))
        self.spark.catalog.refreshTable(name)

    def append(self, groups: DataFrame) -> None:
        """Add a batch's groups (digest, keep_id, group_size), each digest once; a written table."""
        self._write(groups.join(self.table().select("digest").hint("merge"), "digest", "left_semi"), "again", self.again)
        self._write(self.fresh(groups), "texts", self.texts)


def falling_batches(keys: DataFrame, batches: int) -> list[DataFrame]:
    """keys (id, ...) in parts of about equal size and falling ids, those without an id in the last."""
    cuts = keys.agg(F.percentile_approx("id", [k / batches for k in range(batches - 1, 0, -1)])).first()[0] if batches > 1 else []
    parts, below = [], F.lit(True)
    for cut in cuts or []:
        parts.append(keys.filter(below & (F.col("id") > cut)))
        below = F.coalesce(F.col("id") <= cut, F.lit(True))
    return [*parts, keys.filter(below)]


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """Add a table to the index, in `batches`, and decide every row of it.

    Columns: id, digest, keep_id (id that stands for the text), group_size (rows of the text in all
    that was added to the index), kept.
    """
    keys = materialize(docs.select(F.col(id_col).cast("bigint").alias("id"), digest(text_col).alias("digest")), "digests")
    known = materialize(index.table().select("digest").join(keys.select("digest").distinct(), "digest", "left_semi"),
                        "digests-known").withColumn("known", F.lit(True))
    for part in falling_batches(keys, batches):
        index.append(materialize(part.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")), "digests-batch"))
    decided = (keys.join(index.rows(), "digest").join(known, "digest", "left")
               .withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")) & F.col("known").isNull()))
    return decided.select("id", "digest", "keep_id", "group_size", "kept")


def fresh_index(spark: SparkSession) -> DigestIndex:
    return DigestIndex(spark, scratch_path(spark, "digest-index"), int(spark.conf.get("spark.sql.shuffle.partitions")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents against a new index."""
    rows = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_index(spark))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                       F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, t.text_sha256
FROM t JOIN g ON t.text_sha256 = g.text_sha256
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row stays of each text; columns of docs."""
    kept = deduplicate(docs, fresh_index(spark)).filter("kept").select(F.col("id").alias("__id"), F.col("digest").alias("__digest"))
    kept = materialize(kept.distinct(), "digests-kept")
    own = docs.withColumn("__own", digest("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__digest"))
    # an id may repeat with its text
    return own.join(kept, same, "left_semi").dropDuplicates(["doc_id", "__own"]).select(*docs.columns)
