"""Exact distinct counts that merge: bitmaps of numeric ids.

``count(distinct id)`` cannot be added up: a report by three levels needs three
distinct aggregates over the rows.  Here a group keeps, for each range of
32,768 ids, a bitmap of those it holds.  Bitmaps are combined map-side, and the
states of groups are merged to any coarser group by OR, so one small table of
states answers every level, and new data only adds states to be merged.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

col = F.col
BUCKET, BITS = "_bucket", "_bits"


def distinct_state(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """``keys``, the bucket and its bitmap: the distinct ids of each group.  NULL ids are not counted.

    A state has 4 KB for each 32,768 ids between those it holds, so ids should
    be dense (surrogate keys); ids are whole numbers of any sign.
    """
    i = col(id_col).cast("long")
    return (df.where(i.isNotNull()).groupBy(*keys, F.bitmap_bucket_number(i).alias(BUCKET))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(i)).alias(BITS)))


def merged(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The state of coarser groups (``keys`` is a part of the state's): bitmaps are OR-ed, no id is read again."""
    return state.groupBy(*keys, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS))


def distinct_counts(state: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """``keys`` and the exact number of distinct ids."""
    return merged(state, keys).groupBy(*keys).agg(F.sum(F.bitmap_count(BITS)).alias(out))
