"""The warehouse's collation as a declared column type.

The warehouse compares text without regard to case and trailing blanks.  A
column declared with :data:`WAREHOUSE` does so in every comparison, join,
group and distinct, without a function around each of them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WAREHOUSE = "UTF8_LCASE_RTRIM"


def collated(df: DataFrame, columns: Iterable[str] | None = None, collation: str = WAREHOUSE) -> DataFrame:
    """``df`` with its string columns, or the named ones, declared with ``collation``; values stay as they are."""
    names = set(columns) if columns is not None else {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.select([F.collate(F.col(c), collation).alias(c) if c in names else F.col(c) for c in df.columns])


def plain(c: Column) -> Column:
    """One spelling for all values that are equal under :data:`WAREHOUSE`, as a plain string."""
    return F.lower(F.rtrim(F.collate(c, "UTF8_BINARY")))
