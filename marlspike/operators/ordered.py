"""Places and running sums within groups of any size (DP-6, OR-7).

A window would bring a whole group into one task. Here a range sort cuts hot groups into pieces, windows run inside
the pieces, and what the pieces before hold is added; there are at most as many pieces as partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.session import cut


def running_sum(rows: DataFrame, group: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of their group up to their own, by ``order``.

    ``order`` should tell rows apart; equal ones come in any order. Null values add nothing; null groups are a group.
    """
    spread = cut(rows.withColumn("_v", F.coalesce(value, F.lit(0))).repartitionByRange(*group, *order).withColumn("_pid", F.spark_partition_id()))
    pieces = spread.groupBy(*group, "_pid").agg(F.sum("_v").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*(F.col(g).alias(f"_g_{i}") for i, g in enumerate(group)), F.col("_pid").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    on = [F.col(g).eqNullSafe(F.col(f"_g_{i}")) for i, g in enumerate(group)] + [F.col("_pid") == F.col("_p")]
    inside = Window.partitionBy(*group, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = (F.col("_before") + F.sum("_v").over(inside)).cast("bigint")
    return spread.join(pieces, on).withColumn(out, total).drop("_v", "_pid", "_p", "_before", *(f"_g_{i}" for i in range(len(group))))


def rank_in(rows: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """``rows`` with their place from 1 within ``group`` by ``order``."""
    return running_sum(rows, group, order, F.lit(1), out)
