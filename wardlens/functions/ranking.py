"""Row numbers and previous rows within groups without putting a group in one task.

``row_number() over (partition by g order by o)`` sorts each group inside a
single task.  Here the rows are range-partitioned on (g, o), so a very
large group is spread over several tasks in key order; each row's position
inside its task comes from ``monotonically_increasing_id`` (assigned in
sorted order), and the rows of the same group in earlier tasks are added
from a small (task, group) count table.  The partitioned, sorted rows are
checkpointed first so that every branch of the plan sees the same task
assignment.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

col = F.col


def range_sorted(df: DataFrame, order_cols: Sequence[str], num_partitions: int | None = None) -> DataFrame:
    """``df`` in total order over its tasks: ``_task`` and ``_mid``, which grows in that order.

    Checkpointed, so that every reader sees the same order.  Rows that agree
    in ``order_cols`` may lie in two tasks: any number of ties is spread.
    """
    from wardlens.session import materialize
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    placed = materialize(tied.repartitionByRange(n, *order_cols, "_tie").sortWithinPartitions(*order_cols, "_tie")
                         .drop("_tie").withColumn("_mid", F.monotonically_increasing_id()))
    return placed.withColumn("_task", F.shiftright(col("_mid"), 33))


def previous_row(placed: DataFrame, cols: Sequence[str], out: str = "_prev") -> DataFrame:
    """The struct ``out`` of ``cols`` of the row before, in the order of :func:`range_sorted`; NULL for the first of all.

    Inside a task it is the lag; the last row of each task is handed to the
    next task that has rows (one row a task, so that step is small).
    """
    here = F.struct(*cols)
    last = placed.groupBy("_task").agg(F.max_by(here, "_mid").alias("_last"))
    handed = last.select(col("_task").alias("_t"), F.lag("_last").over(Window.orderBy("_task")).alias("_handed"))
    lagged = placed.withColumn("_lag", F.lag(here).over(Window.partitionBy("_task").orderBy("_mid")))
    return (lagged.join(handed, col("_task") == col("_t")).withColumn(out, F.coalesce("_lag", "_handed"))
            .drop("_t", "_lag", "_handed"))


def group_row_number(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                     out: str = "row_num", num_partitions: int | None = None) -> DataFrame:
    ranked = range_sorted(df, [*group_cols, *order_cols], num_partitions)
    stats = ranked.groupBy("_task", *group_cols).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group_cols).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    s = stats.select(*[col(c).alias("_s_" + c) for c in ("_task", *group_cols)], "_first", "_before")
    cond = reduce(and_, [ranked[c].eqNullSafe(s["_s_" + c]) for c in ("_task", *group_cols)])
    j = ranked.join(s, cond)
    return j.select(*df.columns, (col("_before") + col("_mid") - col("_first") + 1).cast("bigint").alias(out))
