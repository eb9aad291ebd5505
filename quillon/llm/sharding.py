"""Balanced contiguous shards from global byte-size prefix sums; DataFrame functions only.

Rows are range-partitioned by id and written as small files.  Within a file
the prefix sum is a window over the row number; the files' totals, one row per
file, give each file's offset (a file is numbered by the task that wrote it).  Cutting the global prefix at equal targets
gives shards that are contiguous in id order and near equal in bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import shared_dir


def balanced_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """One row per document: __id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes plus ``overhead`` (null has no bytes); a row
    goes to the shard in which the middle of its bytes falls, so a shard is off
    the target by half its two outer rows at most, and a row longer than the
    target leaves shards empty.  slot counts a shard's rows from 0 without
    gaps in the order of id (nulls first), size, text_crc32; rows that agree in
    all three are alike, and their order is that in which they were read.
    A null text has the checksum of no bytes, 0.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    slim = docs.select(F.col(f"`{id_col}`").alias("__id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("size"), F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"), F.monotonically_increasing_id().alias("tie"))
    order = ["__id", "size", "text_crc32", "tie"]
    path = f"{shared_dir(spark)}/sizes"
    slim.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    rows = spark.read.schema(slim.schema).parquet(path)
    rows = rows.select("__id", "size", "text_crc32", F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long").alias("file"), F.col("_metadata.row_index").alias("at"))

    # one row per file: a window without partitions over as many rows as files
    totals = rows.groupBy("file").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("file").alias("f"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("to", F.sum("size").over(within)).join(offsets, F.col("file") == F.col("f"))
    middle = F.col("bytes_before") + F.col("to") - F.expr("size div 2")
    placed = placed.select("__id", "size", "text_crc32", F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / F.col("total"))).cast("int").alias("shard"), (F.col("rows_before") + F.col("at")).alias("number"))
    first = placed.groupBy("shard").agg(F.min("number").alias("first")).select(F.col("shard").alias("s"), "first")  # a row for each shard
    return placed.join(F.broadcast(first), F.col("shard") == F.col("s")).select("__id", "size", "text_crc32", "shard", (F.col("number") - F.col("first")).alias("slot"))
