"""DataFrame helpers of the corpus operators: names that can't clash, and joins whose broadcast is checked."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.session import shuffle_partitions

#: What a broadcast side may take, and what its hash relation holds for each row besides the row's own bytes.
BROADCAST_BYTES, _ROW_OVERHEAD = 64 << 20, 64


def every(df: DataFrame) -> list[Column]:
    """All columns, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sized(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcasting if its counted rows are small enough; else a join with it shuffles."""
    return F.broadcast(df) if rows * (row_bytes + _ROW_OVERHEAD) <= BROADCAST_BYTES else df


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def shards(docs: DataFrame, chars: int, size: int | None = None) -> int:
    """Shards for what is made of all texts of ``docs``: one for ``chars`` characters, but no fewer than shuffles have partitions."""
    size = text_bytes(docs) if size is None else size
    return max(shuffle_partitions(docs.sparkSession), -(-size // chars))


def map_rows(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], drop: int = 0) -> DataFrame:
    """``df`` through ``f``, which returns its columns without the last ``drop`` ones; for any column names."""
    names = df.columns
    safe = df.toDF(*[n if n.isidentifier() else f"__column_{i}_" for i, n in enumerate(names)])
    left = len(names) - drop
    return safe.mapInArrow(f, T.StructType(safe.schema.fields[:left])).toDF(*names[:left])
