"""Range lookup from a table: which range holds a number, as an equi join by bins.

Each range is listed under the bins it touches, each number has one bin, so
the join is on equal bins and never compares every number with every range.
Ranges are data: a new version of a classification is new rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

col, lit = F.col, F.lit


def overlaps(ranges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The ranges (``lo, hi``, inclusive) that start inside an earlier one of the same ``by``, or end before they start."""
    before = F.max("hi").over(Window.partitionBy(*by).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    return ranges.withColumn("_before", before).where((col("lo") <= col("_before")) | (col("hi") < col("lo"))).drop("_before")


def checked(ranges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``ranges``, or a ValueError that names one that overlaps.  A classification is a small table."""
    bad = overlaps(ranges, by).first()
    if bad is not None:
        raise ValueError(f"range {bad.asDict()} overlaps another or is empty")
    return ranges


def range_lookup(df: DataFrame, number: Column, ranges: DataFrame, label: str, out: str, otherwise: str, width: int = 64) -> DataFrame:
    """``df`` with ``out``: the ``label`` of the range that holds ``number``, ``otherwise`` outside all ranges and for NULL.

    Give ``ranges`` through :func:`checked`, so that a row meets one range at
    most.  A range is listed once for each ``width`` numbers it spans.
    """
    bin_of = lambda c: F.floor(c / lit(width))
    listed = ranges.select(F.explode(F.sequence(bin_of(col("lo")), bin_of(col("hi")))).alias("_bin"),
                           col("lo").alias("_lo"), col("hi").alias("_hi"), col(label).alias("_label"))
    asked = df.withColumn("_number", number).withColumn("_in", bin_of(col("_number")))
    j = asked.join(listed, (col("_in") == col("_bin")) & col("_number").between(col("_lo"), col("_hi")), "left")
    return j.select(*df.columns, F.coalesce("_label", lit(otherwise)).alias(out))
