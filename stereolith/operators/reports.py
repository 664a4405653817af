"""Run reports: small aggregates over frames, points and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stereolith.operators.ranking import with_previous
from stereolith.plans.scratch import Scratch


def status_counts(frames: DataFrame) -> DataFrame:
    """(status, n, warn): frames per status; ``warn`` where lost and invalid frames are over 40 % of all."""
    n = frames.groupBy("status").agg(F.count("*").alias("n"))
    bad = n.agg((F.sum(F.when(F.col("status").isin("lost", "invalid"), F.col("n")).otherwise(0)) / F.sum("n") > 0.4).alias("warn"))
    return n.join(F.broadcast(bad))


def registration_funnel(tries: DataFrame) -> DataFrame:
    """One row of (path, ok) tries: successes by path, and failures."""
    return tries.agg(*[F.sum((F.col("ok") & (F.col("path") == p)).cast("long")).alias(f"ok_{p}") for p in ("relative", "resect", "relocate")], F.sum((~F.col("ok")).cast("long")).alias("failed"))


def refine_triggers(log: DataFrame, growth: float = 1.10, keyframes: int = 20) -> DataFrame:
    """``refine`` where frames or points grew by a tenth since the row before, or enough keyframes came (frame_idx order)."""
    names = ["frames", "points", "keyframes"]
    met = with_previous(log, "frame_idx", names, Scratch(log.sparkSession, "triggers"))
    hit = (F.col("frames") >= growth * F.col("previous_frames")) | (F.col("points") >= growth * F.col("previous_points")) | (F.col("keyframes") - F.col("previous_keyframes") >= keyframes)
    return met.withColumn("refine", F.coalesce(hit, F.lit(False))).drop(*[f"previous_{n}" for n in names])


def run_report(poses: DataFrame, points: DataFrame, obs: DataFrame) -> DataFrame:
    """One row: frames, points, observations, observations per point."""
    one = [df.agg(F.count("*").alias(n)) for df, n in ((poses, "frames"), (points, "points"), (obs, "observations"))]
    return one[0].join(F.broadcast(one[1])).join(F.broadcast(one[2])).withColumn("track_length", F.col("observations") / F.col("points"))
