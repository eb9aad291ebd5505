"""Exact deduplication: a two-pass Bloom filter finds possibly repeated digests, and only those rows shuffle.

Pass one counts, for each bit of a Bloom filter, whether it was set never,
once, or more often.  A digest all of whose bits were set more than once is
possibly repeated; any other is certain to be unique, so its row passes
straight through in pass two.  A repeated digest is never missed.

The filter that reaches the driver and each executor has at most
``max_filter_bits`` bits whatever the input.  Where the rows ask for more, the
digests are written in ranges, and each range has a filter of its own, which
is given up before the next is made.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.bitmap import all_set, bitmap, bits_for
from quillon.llm.common import LOWER, UPPER, shared_dir, string_buffers, without_rows, written

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_TESTED = "sha binary, __id long, __xx long, __row long, maybe boolean"


def _digest_udf(ranges: int):
    def run(batches):
        for batch in batches:
            raw, off = string_buffers(batch.column(1))
            data = memoryview(raw)
            sha = [hashlib.sha256(bytes(data[a:b]).translate(_FOLD)).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            at = [int.from_bytes(x[-2:], "big") * ranges >> 16 for x in sha]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(sha, pa.binary()), pa.array(at, pa.int32())], ["__id", "__xx", "__row", "sha", "range"])

    return run


def _positions(column: pa.Array, bits: int) -> np.ndarray:
    """Two filter positions of each digest."""
    n = len(column)
    if not n:
        return np.zeros((0, 2), np.uint64)
    off = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4)
    words = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]].reshape(n, 32)[:, :16].copy().view("<u8")
    return words & np.uint64(bits - 1)


def _test_udf(bits: int, filter_):
    def run(batches):
        for batch in batches:
            maybe = all_set(filter_.value, _positions(batch.column(0), bits))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], ["sha", "__id", "__xx", "__row", "maybe"])

    return run


def _tested(digests: DataFrame, bits: int, path: str) -> str:
    """Write ``digests`` with ``maybe``, false only where the digest is certain to be unique; the filter goes when that is done."""
    filter_ = digests.sparkSession.sparkContext.broadcast(bitmap(digests.select("sha"), _positions, bits, times=2))
    written(digests.select("sha", "__id", "__xx", "__row").mapInArrow(_test_udf(bits, filter_), _TESTED), path)
    filter_.destroy()
    return path


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_filter_bits: int = 1 << 28) -> DataFrame:
    """One row per document: __id, __xx, keep_id, group_size, kept, first, sha (binary SHA-256).

    Texts are equal when identical after lower-casing A to Z; null counts as
    empty.  The row with the largest id stays (``kept``); null ids rank lowest.
    Repeated rows of that id all have ``kept``, but only one has ``first``.
    """
    path = shared_dir(docs.sparkSession)
    rows = max(1, docs.count())
    bits = bits_for(rows, bits_per_row, max_filter_bits)
    ranges = -(-rows * bits_per_row // bits) if rows * bits_per_row > bits else 1
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").alias("__text"), F.xxhash64(F.col(f"`{text_col}`")).alias("__xx"), F.monotonically_increasing_id().alias("__row"))
    digests = written(src.mapInArrow(_digest_udf(ranges), "__id long, __xx long, __row long, sha binary, range int"), f"{path}/digests", "range" if ranges > 1 else None)
    # one range after the other: one filter lives at a time, and one scan reads what all have written
    paths = [_tested(digests.where(F.col("range") == i) if ranges > 1 else digests, bits, f"{path}/tested-{i}") for i in range(ranges)]
    tested = docs.sparkSession.read.schema(_TESTED).parquet(*paths)

    alone = tested.where("not maybe").select("__id", "__xx", F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lit(True).alias("first"), "sha")
    maybe = tested.where("maybe")
    groups = maybe.groupBy("sha").agg(F.max(F.struct("__id", "__row")).alias("best"), F.count("*").alias("group_size"))
    # an own exchange of this side lets the adaptive join split a hot digest
    groups = groups.select(F.concat("sha", F.lit(b"")).alias("g"), "best", "group_size")
    rest = maybe.join(groups, F.col("sha") == F.col("g")).select(
        "__id", "__xx", F.col("best.__id").alias("keep_id"), "group_size", F.col("__id").eqNullSafe(F.col("best.__id")).alias("kept"), (F.col("__row") == F.col("best.__row")).alias("first"), "sha")
    return alone.unionByName(rest)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with the last row of each group of equal texts; all columns stay as they were.

    Of repeated rows (one id, one text) one stays.
    """
    spark = docs.sparkSession
    found = written(exact_duplicates(docs, id_col, text_col, **how).where("not first").select("__id", "__xx", "kept"), f"{shared_dir(spark)}/gone")
    gone, again = found.where("not kept").select("__id", "__xx").distinct(), found.where("kept").select("__id", "__xx").distinct()
    if again.isEmpty():
        return without_rows(docs, gone, id_col, text_col)
    once = without_rows(docs, gone.unionByName(again), id_col, text_col)
    return once.union(without_rows(docs, again, id_col, text_col, "left_semi").dropDuplicates([id_col, text_col]))
