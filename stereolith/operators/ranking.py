"""Ranks over whole tables without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stereolith.plans.scratch import Scratch


def ranked(rows: DataFrame, order: list[Column], scratch: Scratch, by: str | None = None, name: str = "parted", rank: str = "idx", count: str | None = None) -> DataFrame:
    """``rows`` with ``rank``, their place (from 0) by ``order``, within each value of ``by`` if given, and with the number of rows as ``count``.

    Rows are written in range partitions of (``by``, ``order``), so a large group lies in many of them; those are counted, and a row is
    numbered within its partition from the sum of what stands before. ``order`` must tell rows apart, or equal rows take their places freely.
    """
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    first = [F.col(by)] if by else []
    parted = scratch.table(rows.repartitionByRange(tasks, *first, *order).withColumn("_part", F.spark_partition_id()), name)
    counts = parted.groupBy(*first, "_part").agg(F.count("*").alias("_c"))
    every = W.partitionBy(*first) if by else W.partitionBy(F.lit(0))  # of a row a partition
    before = counts.withColumn("_before", F.sum("_c").over(every.orderBy("_part")) - F.col("_c")).withColumn("_n", F.sum("_c").over(every))
    before = before.select(*([F.col(by).alias("_by")] if by else []), F.col("_part").alias("_p"), "_before", "_n")
    met = parted["_part"] == before["_p"]
    placed = parted.join(before, met & parted[by].eqNullSafe(before["_by"]) if by else met)
    place = F.row_number().over(W.partitionBy("_part", *first).orderBy(*order)) - 1
    out = placed.withColumn(rank, (F.col("_before") + place).cast("long"))
    return (out.withColumn(count, F.col("_n")) if count else out).drop("_part", "_before", "_p", "_n", "_by")


def consecutive(rows: DataFrame, order: str, scratch: Scratch, names: tuple[str, str]) -> DataFrame:
    """(names[0], names[1]): each value of ``order`` with the next one."""
    r = scratch.table(ranked(rows.select(order).distinct(), [F.col(order)], scratch), "ranked")
    a, b = r.select(F.col(order).alias(names[0]), "idx"), r.select(F.col(order).alias(names[1]), (F.col("idx") - 1).alias("idx"))
    return a.join(b, "idx").select(*names)


def with_previous(rows: DataFrame, order: str, columns: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with ``previous_<c>`` of the row before by ``order``, null for the first."""
    r = scratch.table(ranked(rows, [F.col(order)], scratch), "ranked")
    before = r.select((F.col("idx") + 1).alias("idx"), *[F.col(c).alias(f"previous_{c}") for c in columns])
    return r.join(before, "idx", "left").drop("idx")


def nearest_marked(rows: DataFrame, order: str, marked: Column, scratch: Scratch) -> DataFrame:
    """``rows`` with ``low`` and ``high``: the last value of ``order`` among ``marked`` rows up to a row, and the first from it on.

    An as-of join in both directions: within range partitions by a window, across them by what each partition carries on.
    """
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    own = F.when(marked, F.col(order))
    parted = scratch.table(rows.repartitionByRange(tasks, F.col(order)).withColumn("_part", F.spark_partition_id()), "parted")
    every = W.partitionBy(F.lit(0)).orderBy("_part")  # of a row a partition
    ends = parted.groupBy("_part").agg(F.max(own).alias("_last"), F.min(own).alias("_first"))
    ends = ends.select("_part", F.last("_last", True).over(every.rowsBetween(W.unboundedPreceding, -1)).alias("_before"), F.first("_first", True).over(every.rowsBetween(1, W.unboundedFollowing)).alias("_after"))
    w = W.partitionBy("_part").orderBy(order)
    low = F.coalesce(F.last(own, True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.col("_before"))
    high = F.coalesce(F.first(own, True).over(w.rowsBetween(0, W.unboundedFollowing)), F.col("_after"))
    return parted.join(ends, "_part").withColumns({"low": low, "high": high}).drop("_part", "_before", "_after")
