"""Pair tables: header-checked CSV scans and typed rows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairkit.functions import text as tx
from pairkit.sources import quoted_csv

LABELLED = ("qid1", "qid2", "question1", "question2", "is_duplicate")
LABELLED_NUMBERS = ("qid1", "qid2", "label")
UNLABELLED = ("test_id", "question1", "question2")
PREFERRED_LABELLED = "questions.csv"
PREFERRED_UNLABELLED = "test.csv"


def scan_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV as strings, split across tasks. The default reads line breaks in quotes, at the cost of a first
    pass that counts quotes; `multi_line=False` is for files without them."""
    if multi_line:
        return quoted_csv.scan(spark, path)
    return spark.read.csv(path, header=True, quote='"', escape='"', inferSchema=False, ignoreLeadingWhiteSpace=False,
                          ignoreTrailingWhiteSpace=False, enforceSchema=False)


def _list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names directly under a folder, on any file system Spark can reach."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path))


def find_csv(spark: SparkSession, folder: str, required: Iterable[str],
             preferred: str | None = None, multi_line: bool = True) -> DataFrame:
    """The first CSV entry of `folder` whose header holds every required column.

    `preferred` is tried first. Entries may be files or folders of part files.
    """
    names = [n for n in _list_names(spark, folder) if re.fullmatch(r".+\.csv", n)]
    names.sort(key=lambda n: (n != preferred, n))
    required = set(required)
    for name in names:
        path = f"{folder.rstrip('/')}/{name}"
        if required <= set(quoted_csv.header(spark, path)):
            return scan_csv(spark, path, multi_line)
    raise FileNotFoundError(f"no CSV with columns {sorted(required)} in {folder}")


def read_pairs(spark: SparkSession, folder: str, multi_line: bool = True) -> DataFrame:
    """Untyped labelled pairs."""
    return find_csv(spark, folder, LABELLED, PREFERRED_LABELLED, multi_line)


def read_unlabelled_pairs(spark: SparkSession, folder: str, path: str | None = None,
                          multi_line: bool = True) -> DataFrame:
    """Untyped unlabelled pairs; an explicit `path` wins over the folder search."""
    if path is not None:
        if not set(UNLABELLED) <= set(quoted_csv.header(spark, path)):
            raise FileNotFoundError(f"{path} lacks columns {sorted(UNLABELLED)}")
        return scan_csv(spark, path, multi_line)
    return find_csv(spark, folder, UNLABELLED, PREFERRED_UNLABELLED, multi_line)


def _text(name: str, strip: bool) -> Column:
    value = F.coalesce(F.col(name), F.lit(""))
    return (tx.strip(value) if strip else value).alias(name)


def _int(name: str, kind: str = "bigint") -> Column:
    return tx.strip(F.col(name)).try_cast(kind)


def _typed_labelled(raw: DataFrame, strip: bool) -> DataFrame:
    row_no = _int("id") if "id" in raw.columns else F.lit(None).cast("bigint")
    return raw.select(row_no.alias("row_no"), _int("qid1").alias("qid1"), _int("qid2").alias("qid2"),
                      _text("question1", strip), _text("question2", strip),
                      _int("is_duplicate", "int").alias("label"))


def _complete(names: Sequence[str]) -> Column:
    good = F.lit(True)
    for name in names:
        good = good & F.col(name).isNotNull()
    return good


def parse_labelled(raw: DataFrame, strip: bool = False) -> DataFrame:
    """Typed labelled rows; rows whose ids or label are not integers are dropped."""
    return _typed_labelled(raw, strip).filter(_complete(LABELLED_NUMBERS))


def typed_labelled(raw: DataFrame, strip: bool = False) -> DataFrame:
    """All typed rows; `is_good` is false where an id or the label is not a number."""
    return _typed_labelled(raw, strip).withColumn("is_good", _complete(LABELLED_NUMBERS))


def count_bad(raw: DataFrame) -> DataFrame:
    """One row: labelled rows read, and those `parse_labelled` drops."""
    good = _complete(LABELLED_NUMBERS)
    return _typed_labelled(raw, False).agg(F.count(F.lit(1)).alias("n_rows"),
                                           F.count_if(~good).alias("n_bad"))


def parse_unlabelled(raw: DataFrame, strip: bool = True) -> DataFrame:
    """Typed unlabelled rows; the label stays NULL."""
    typed = raw.select(
        _int("test_id").alias("test_id"), _text("question1", strip), _text("question2", strip),
        F.lit(None).cast("int").alias("label"))
    return typed.filter(_complete(["test_id"]))
