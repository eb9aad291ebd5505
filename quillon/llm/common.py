"""Helpers shared by the operators: written tables, Arrow columns, id columns."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.arrow import read_texts, string_buffers
from quillon.storage import shared_dir, written

__all__ = ["LOWER", "UPPER", "arrow_uri", "filesystem", "fresh", "kept", "quoted", "read_texts", "shared_dir", "string_buffers", "utf8_array", "without_rows", "written"]

T = TypeVar("T")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def arrow_uri(uri: str) -> str:
    """The name that Arrow has for a folder in Spark's words; what it can't open raises ValueError."""
    scheme, _, rest = uri.partition(":")
    name = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}.get(scheme) if rest else None
    if name is None:
        raise ValueError(f"Arrow can't open the file system of {uri}")
    return f"{name}://{rest.lstrip('/')}" if name != "file" else "file:///" + rest.lstrip("/")


def filesystem(uri: str):
    """(Arrow's file system, path)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(arrow_uri(uri))


_KEPT: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], T]) -> T:
    """What a Python worker has made for its operator before; what it made for another one goes first.

    Workers outlive tasks and stages: tables of one stage are not to stay in
    memory during the next.
    """
    if key not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
        _KEPT[key] = make()
    return _KEPT[key]


def utf8_array(texts: list[bytes | None]) -> pa.Array:
    """Bytes as a string column; what is malformed stays as it is."""
    return pa.array(texts, pa.binary()).view(pa.string())


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that ``df`` doesn't have, in any spelling of its letters."""
    taken, names = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def quoted(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def without_rows(df: DataFrame, gone: DataFrame, id_col: str, text_col: str, how: str = "left_anti") -> DataFrame:
    """``df`` without the rows whose row key is in ``gone`` (id, hash of the text); null ids compare equal.

    A semi or anti join: Spark broadcasts ``gone`` only if its size is known to be
    under spark.sql.autoBroadcastJoinThreshold, else both sides are shuffled.
    """
    own_id, own_xx, gone_id, gone_xx = fresh(df, "own_id", "own_xx", "gone_id", "gone_xx")
    left = df.select("*", quoted(id_col).alias(own_id), F.xxhash64(quoted(text_col)).alias(own_xx))
    cond = F.col(own_id).eqNullSafe(F.col(gone_id)) & (F.col(own_xx) == F.col(gone_xx))
    return left.join(gone.toDF(gone_id, gone_xx), cond, how).select(*map(quoted, df.columns))
