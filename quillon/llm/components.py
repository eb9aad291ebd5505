"""Connected components by alternating star contraction, all in DataFrame operations."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import written


def _forest(batches):
    """Union-find over each batch: the same connectivity in fewer edges, each to the smallest node."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.get(top, top)) != top:
                top = up
            while x != top:
                parent[x], x = top, parent.get(x, x)
            return top

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["u", "v"])


def connected_components(edges: DataFrame, path: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long) but for the roots; root is the smallest node reached.

    Each round makes a large star and a small star of every node and is
    written to ``path``; rounds grow with the logarithm of the longest chain.
    No node's neighbours meet in memory: they are only aggregated with min, and
    the join back, whose keys are the aggregate's inverted bits so that each side has an
    exchange of its own, can be split by the adaptive skew join.  Null ends and loops
    are left out; an empty table gives an empty one.
    """
    e = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))
    e = e.where("u is not null and v is not null and u <> v").mapInArrow(_forest, "u long, v long")
    e = written(e.distinct(), f"{path}/cc-{uuid.uuid4().hex}")
    seen = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum("v")).first()
        if now == seen or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.bitwise_not("u").alias("w"), "m")
        large = both.join(low, F.bitwise_not(both["u"]) == low["w"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("w"), "m")
        small = large.join(low, F.bitwise_not(large["u"]) == low["w"])
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        e = written(small.where("u <> v").distinct(), f"{path}/cc-{uuid.uuid4().hex}")
