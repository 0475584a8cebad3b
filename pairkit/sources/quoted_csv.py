"""CSV with line breaks in quotes, read by many tasks.

A byte range of such a file does not say whether it begins inside a quoted text. But quotes come in
pairs, a quote within quotes being written twice, so the number of quotes before a range decides it. A first pass
counts the quotes of each range, and running sums over the ranges of a file give each one's state. In the
later passes each task cuts its range at the true ends of records. What a range has of a record that
began before it, or goes on after it, is written and put together by a small grouping of such pieces; whole records
are not written, but cut again by whoever reads them.

Quotes must stand around whole values and be doubled inside, as RFC 4180 has it. The driver gets one row
for each range that begins inside quotes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pairkit.session import materialize

WHOLE, HEAD, TAIL, MIDDLE = range(4)


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file or folder; nothing else is read."""
    return spark.read.csv(path, header=True, quote='"', escape='"', inferSchema=False, enforceSchema=False).columns


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where its range begins), value, odd (whether the line has an odd number of quotes)."""
    raw = spark.read.option("lineSep", "\n").text(path)
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      "value", (quotes % 2).cast("tinyint").alias("odd"))


def _open_blocks(lines: DataFrame) -> set[tuple[str, int]]:
    """The ranges that begin inside quotes."""
    counts = lines.groupBy("file", "block").agg((F.sum("odd") % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = counts.withColumn("before", F.sum("odd").over(before)).filter("before % 2 = 1")
    return {(r["file"], r["block"]) for r in found.select("file", "block").collect()}


def _edges(file: pa.Array, block: np.ndarray) -> list[int]:
    """Where the lines of another range begin, and the ends of the batch."""
    names = file.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    new = np.flatnonzero((block[1:] != block[:-1]) | (names[1:] != names[:-1])) + 1
    return [0, *new.tolist(), len(block)] if len(block) else []


def _pieces(lines: DataFrame, opened: set[tuple[str, int]], across: bool) -> DataFrame:
    """file, block, at, kind, text: the records within the ranges, or the pieces of records that pass a range's border."""
    shared = lines.sparkSession.sparkContext.broadcast(opened)
    names, kinds = ["file", "block", "at", "kind", "text"], [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # held: the lines of a record that has not ended; its kind is WHOLE as long as it began in the range
        current, inside, began, held, at = None, 0, False, [], 0

        def of(start: int, kind: int, texts: list[str] | pa.Array) -> pa.RecordBatch:
            file, block = current
            columns = [[file] * len(texts), [block] * len(texts), range(start, start + len(texts)), [kind] * len(texts)]
            return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(columns, kinds)],
                                               texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())], names)

        def left() -> Iterator[pa.RecordBatch]:
            if held and across:  # goes on in the next range, or is what a file that ends in quotes has left
                yield of(at, TAIL if began else MIDDLE, ["\n".join(held)])

        for batch in batches:
            file, block, value, odd = batch.columns
            block, odd = block.to_numpy(), odd.to_numpy()
            edges = _edges(file, block)
            for lo, hi in zip(edges, edges[1:]):
                where = (file[lo].as_py(), int(block[lo]))
                if where != current:
                    yield from left()
                    current, at, held = where, 0, []
                    inside = int(current in shared.value)
                    began = not inside
                state = (inside + np.cumsum(odd[lo:hi])) % 2
                ends = lo + 1 + np.flatnonzero(state == 0)
                start = lo
                if len(ends) and (held or not began):
                    first = ["\n".join([*held, *value[lo:ends[0]].to_pylist()])]
                    if began != across:
                        yield of(at, WHOLE if began else HEAD, first)
                    at, held, began, start, ends = at + 1, [], True, int(ends[0]), ends[1:]
                if len(ends):
                    if not across:
                        cuts = pa.array(np.concatenate([[start], ends]), pa.int32())
                        yield of(at, WHOLE, pc.binary_join(pa.ListArray.from_arrays(cuts, value), "\n"))
                    at, start = at + len(ends), int(ends[-1])
                held += value[start:hi].to_pylist()
                inside = int(state[-1])
        yield from left()

    return lines.mapInArrow(run, "file string, block bigint, at bigint, kind int, text string")


def _across(parts: DataFrame) -> DataFrame:
    """block, at, text of records that pass borders: at most two pieces a range."""
    order = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = parts.withColumn("record", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    joined = numbered.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "at", "text"))).alias("p"))
    return joined.select(F.col("p")[0]["block"].alias("block"), F.col("p")[0]["at"].alias("at"),
                         F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, as Spark's reader gives them in one task."""
    names = header(spark, path)
    lines = _lines(spark, path)
    opened = _open_blocks(lines)
    records = _pieces(lines, opened, False).select("block", "at", "text")
    if opened:
        records = records.unionByName(_across(materialize(_pieces(lines, opened, True), "csv-borders")))
    text = F.regexp_replace("text", r"\r\z", "")
    body = records.filter((F.col("block") > 0) | (F.col("at") > 0)).select(text.alias("text")).filter("text <> ''")
    schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    return body.select(F.from_csv("text", schema, {"quote": '"', "escape": '"'}).alias("r")).select("r.*")
