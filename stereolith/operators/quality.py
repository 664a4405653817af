"""Scores, filters and integrity of points and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stereolith.operators.geometry import POSE, Camera, center, project

CAM = Camera()


def residuals(obs: DataFrame, points: DataFrame, poses: DataFrame, cam: Camera = CAM) -> DataFrame:
    """Observations with a pose, with ``depth`` and ``err`` (pixels); ``known`` tells whether the point has coordinates.

    Poses are the small side and points share the key of what follows, so one exchange on point_id serves the aggregate too.
    """
    pts = points.select("point_id", "x", "y", "z")
    met = obs.select("point_id", "frame_idx", "kp_idx", "u", "v").join(poses.dropna(subset=POSE).select("frame_idx", *POSE), "frame_idx").join(pts, "point_id")
    met = met.withColumn("known", ~(F.isnan("x") | F.isnan("y") | F.isnan("z") | F.col("x").isNull()))
    out = project(met, cam)
    return out.withColumn("err", F.sqrt((F.col("pu") - F.col("u")) ** 2 + (F.col("pv") - F.col("v")) ** 2)).select("point_id", "frame_idx", "kp_idx", "u", "v", "x", "y", "z", "known", "depth", "err")


def point_errors(obs: DataFrame, points: DataFrame, poses: DataFrame, cam: Camera = CAM) -> DataFrame:
    """Per point: mean error over observations in front of the camera (infinite if none), their number, share at or behind it."""
    r = residuals(obs, points, poses, cam)
    front = F.col("known") & (F.col("depth") > 0)
    agg = r.groupBy("point_id").agg(F.avg(F.when(front, F.col("err"))).alias("err"), F.sum(front.cast("long")).alias("valid_count"), F.avg(F.when(F.col("known") & (F.col("depth") > 0), 0.0).otherwise(1.0)).alias("neg_ratio"))
    return agg.select("point_id", F.coalesce("err", F.lit(float("inf"))).alias("err"), "valid_count", "neg_ratio")


def rays(obs: DataFrame, points: DataFrame, poses: DataFrame) -> DataFrame:
    """(point_id, frame_idx, dx, dy, dz): unit vectors from the camera centres to the point."""
    cx, cy, cz = center()
    c = poses.dropna(subset=POSE).select("frame_idx", cx.alias("cx"), cy.alias("cy"), cz.alias("cz"))
    met = obs.select("point_id", "frame_idx").join(c, "frame_idx").join(points.select("point_id", "x", "y", "z"), "point_id")
    d = [F.col(a) - F.col(f"c{a}") for a in "xyz"]
    met = met.withColumn("_n", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).where("_n > 1e-12")
    return met.select("point_id", "frame_idx", *[(v / F.col("_n")).alias(f"d{a}") for v, a in zip(d, "xyz", strict=True)])


def ray_angle(a: str, b: str) -> Column:
    dot = F.col(f"{a}dx") * F.col(f"{b}dx") + F.col(f"{a}dy") * F.col(f"{b}dy") + F.col(f"{a}dz") * F.col(f"{b}dz")
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))


def tri_angles(obs: DataFrame, points: DataFrame, poses: DataFrame, mode: str = "max") -> DataFrame:
    """Per point with a pose-bearing observation: the largest (or smallest) angle between two of its rays; 0 (180) without a pair."""
    r = rays(obs, points, poses)
    a, b = r.select("point_id", *[F.col(c).alias("a_" + c) for c in ("frame_idx", "dx", "dy", "dz")]), r.select("point_id", *[F.col(c).alias("b_" + c) for c in ("frame_idx", "dx", "dy", "dz")])
    pairs = a.join(b, "point_id").where("a_frame_idx < b_frame_idx").groupBy("point_id").agg((F.max if mode == "max" else F.min)(ray_angle("a_", "b_")).alias("angle"))
    return r.select("point_id").distinct().join(pairs, "point_id", "left").select("point_id", F.coalesce("angle", F.lit(0.0 if mode == "max" else 180.0)).alias("angle"))


def filter_observations(obs: DataFrame, points: DataFrame, poses: DataFrame, max_err: float, cam: Camera = CAM) -> DataFrame:
    """Observations that have a pose, a known point, a depth over 1e-9 and an error up to ``max_err``, of points that keep two or more."""
    kept = residuals(obs, points, poses, cam).where(F.col("known") & (F.col("depth") > 1e-9) & (F.col("err") <= max_err))
    return kept.withColumn("n_obs", F.count("*").over(Window.partitionBy("point_id"))).where("n_obs >= 2").select("point_id", "frame_idx", "kp_idx", "u", "v", "err", "n_obs")


def prune_points(obs: DataFrame, points: DataFrame, poses: DataFrame, thresh: float = 4.0, min_angle: float = 1.5, cam: Camera = CAM) -> DataFrame:
    """Points that stay, with why the others go (``reason`` null if kept).

    Limit: max(4 thresh, 3 MAD) over finite errors of points with two or more valid observations, if there are more than ten.
    """
    n = obs.groupBy("point_id").agg(F.count("*").alias("n_obs"))
    score = n.join(point_errors(obs, points, poses, cam), "point_id", "left").join(tri_angles(obs, points, poses), "point_id", "left")
    some = score.where("valid_count >= 2 and err < double('infinity')")
    mid = some.agg(F.median("err").alias("mid"))
    mad = some.join(F.broadcast(mid)).agg(F.median(F.abs(F.col("err") - F.col("mid"))).alias("mad"), F.count("*").alias("k"))
    limit = mad.select(F.when(F.col("k") > 10, F.greatest(F.lit(4 * thresh), 3 * F.col("mad"))).otherwise(F.lit(4 * thresh)).alias("limit"))
    reason = F.when(F.col("n_obs") < 2, "few").when(F.coalesce("neg_ratio", F.lit(1.0)) >= 0.5, "behind").when((F.col("valid_count") > 0) & (F.col("err") > F.col("limit")), "error").when(F.coalesce("angle", F.lit(0.0)) < min_angle, "angle")
    return score.join(F.broadcast(limit)).select("point_id", "n_obs", reason.alias("reason"))


def final_cloud_mask(errors: DataFrame, thresh: float = 4.0) -> DataFrame:
    """Points whose error (finite only with two valid views and under half behind) is below max(3 median, 2 thresh)."""
    ok = errors.where("valid_count >= 2 and neg_ratio < 0.5 and err < double('infinity')")
    limit = ok.agg(F.greatest(3 * F.median("err"), F.lit(2 * thresh)).alias("limit"))
    return ok.join(F.broadcast(limit)).where("err < limit").select("point_id", "err")


def accept_retriangulation(obs: DataFrame, points: DataFrame, fresh: DataFrame, poses: DataFrame, gain: float = 0.9, most: int = 8000, cam: Camera = CAM) -> DataFrame:
    """Points with the new coordinates where they cut the mean squared error below ``gain`` times the old.

    Considered: points with three or more posed observations, the ``most`` seen most often; new and old errors must be finite and
    all new depths over 1e-9.
    """

    def squared(pts: DataFrame, name: str) -> DataFrame:
        r = residuals(obs, pts, poses, cam)
        return r.groupBy("point_id").agg(F.avg(F.col("err") ** 2).alias(name), F.min("depth").alias(f"{name}_depth"), F.count("*").alias(f"{name}_n"))

    old, new = squared(points, "old"), squared(fresh, "new")
    top = old.where("old_n >= 3").orderBy(F.desc("old_n"), "point_id").limit(most)
    take = F.coalesce((F.col("new") < gain * F.col("old")) & (F.col("new_depth") > 1e-9), F.lit(False))
    met = top.join(new, "point_id").withColumn("taken", take).select("point_id", "old", "new", "taken")
    f = fresh.select("point_id", *[F.col(c).alias(f"n{c}") for c in "xyz"])
    out = points.join(met, "point_id", "left").join(f, "point_id", "left")
    return out.select("point_id", *[F.when(F.col("taken"), F.col(f"n{c}")).otherwise(F.col(c)).alias(c) for c in "xyz"], F.coalesce("taken", F.lit(False)).alias("taken"))


def angle_gate(new_obs: DataFrame, obs: DataFrame, points: DataFrame, poses: DataFrame, min_angle: float = 1.5) -> DataFrame:
    """New observations whose camera and the point's other cameras make a large enough angle; fewer than two cameras pass."""
    both = obs.select("point_id", "frame_idx").unionByName(new_obs.select("point_id", "frame_idx")).distinct()
    met = tri_angles(both, points, poses)
    n = both.groupBy("point_id").agg(F.count("*").alias("cameras"))
    ok = n.join(met, "point_id", "left").where((F.col("cameras") < 2) | (F.coalesce("angle", F.lit(0.0)) >= min_angle)).select("point_id")
    return new_obs.join(ok, "point_id", "left_semi")


def cap_observations(new_obs: DataFrame, obs: DataFrame, most: int = 10) -> DataFrame:
    """New observations that may be added: their keypoint is free, and the point stays at ``most`` (by frame, keypoint)."""
    have = obs.groupBy("point_id").agg(F.count("*").alias("have"))
    free = new_obs.join(obs.select("frame_idx", "kp_idx"), ["frame_idx", "kp_idx"], "left_anti")
    turn = F.row_number().over(Window.partitionBy("point_id").orderBy("frame_idx", "kp_idx"))
    return free.join(have, "point_id", "left").withColumn("turn", turn).where(F.col("turn") + F.coalesce("have", F.lit(0)) <= most).select(new_obs.columns)


def inlier_weights(res: DataFrame, by: str, rounds: int = 3, prior: float = 0.7) -> DataFrame:
    """Weights of squared residuals ``r2`` per group under a Gaussian and a uniform, after ``rounds`` of expectation and maximisation."""
    w = Window.partitionBy(by)
    now = res.withColumns({"_s": F.greatest(F.median("r2").over(w) / 2, F.lit(1e-6)), "_p": F.lit(prior), "_u": 1 / F.greatest(F.max("r2").over(w), F.lit(1.0))})
    for _ in range(rounds):
        now = now.withColumn("_g", F.col("_p") * F.exp(-F.col("r2") / (2 * F.col("_s"))))
        now = now.withColumn("w", F.col("_g") / (F.col("_g") + (1 - F.col("_p")) * F.col("_u") + 1e-30))
        now = now.withColumns({"_s": F.greatest(F.sum(F.col("w") * F.col("r2")).over(w) / F.greatest(F.sum("w").over(w), F.lit(1e-6)), F.lit(1e-6)), "_p": F.greatest(F.lit(1e-3), F.avg("w").over(w))})
    return now.withColumn("w", F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.col("w")))).drop("_s", "_p", "_u", "_g")


def median_colors(obs: DataFrame, points: DataFrame) -> DataFrame:
    """Per point the median of each channel, truncated; 128 without a coloured observation."""
    m = obs.groupBy("point_id").agg(*[F.median(c).alias(c) for c in "rgb"])
    return points.select("point_id").join(m, "point_id", "left").select("point_id", *[F.coalesce(F.floor(c).cast("int"), F.lit(128)).alias(c) for c in "rgb"])


def observations_per_point(obs: DataFrame) -> DataFrame:
    return obs.groupBy("point_id").agg(F.sort_array(F.collect_list(F.struct("frame_idx", "kp_idx", "u", "v"))).alias("obs"))


def check_integrity(obs: DataFrame, points: DataFrame, poses: DataFrame, keypoints: DataFrame | None = None) -> DataFrame:
    """(rule, n): rows that break each rule; rules without a breach have 0."""
    o = obs.select("point_id", "frame_idx", "kp_idx")
    count = lambda df, rule: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    found = [
        count(o.join(poses.select("frame_idx"), "frame_idx", "left_anti"), "frame missing"),
        count(o.join(points.select("point_id"), "point_id", "left_anti"), "point missing"),
        count(o.groupBy("point_id", "frame_idx", "kp_idx").count().where("count > 1"), "observation repeated"),
        count(o.groupBy("frame_idx", "kp_idx").agg(F.countDistinct("point_id").alias("k")).where("k > 1"), "keypoint of two points"),
    ]
    if keypoints is not None:
        found.append(count(o.join(keypoints.select("frame_idx", "kp_idx"), ["frame_idx", "kp_idx"], "left_anti"), "keypoint missing"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def drop_frames(obs: DataFrame, poses: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations and poses without those of ``frames``."""
    return obs.join(frames.select("frame_idx"), "frame_idx", "left_anti"), poses.join(frames.select("frame_idx"), "frame_idx", "left_anti")


def select_solve_set(obs: DataFrame, frames: DataFrame, max_obs: int = 20_000, max_points: int = 8_000, seed: int = 42) -> DataFrame:
    """Observations of the chosen frames for one solve: at most ``max_obs`` (smallest md5 of seed and key), of points in two
    frames or more, at most ``max_points`` of those seen most often."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "point_id", "frame_idx", "kp_idx"))
    some = obs.join(frames.select("frame_idx"), "frame_idx", "left_semi").select("point_id", "frame_idx", "kp_idx", "u", "v").orderBy(key, "point_id", "frame_idx").limit(max_obs)
    top = some.groupBy("point_id").agg(F.countDistinct("frame_idx").alias("frames"), F.count("*").alias("n")).where("frames >= 2").orderBy(F.desc("n"), "point_id").limit(max_points)
    return some.join(top.select("point_id"), "point_id", "left_semi")


def reference_frames(obs: DataFrame, mode: str = "global") -> DataFrame:
    """The two frames held still: first and last (global), or the two with most observations (local)."""
    if mode == "global":
        return obs.agg(F.min("frame_idx").alias("a"), F.max("frame_idx").alias("b")).select(F.explode(F.array("a", "b")).alias("frame_idx")).distinct()
    return obs.groupBy("frame_idx").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "frame_idx").limit(2).select("frame_idx")


def registered_frames(poses: DataFrame, obs: DataFrame) -> DataFrame:
    return poses.dropna(subset=POSE).join(obs.select("frame_idx").distinct(), "frame_idx", "left_semi").select("frame_idx")


def window_observations(obs: DataFrame, window: DataFrame, most: int = 8_000) -> DataFrame:
    """Observations of the window's points from frames outside it, at most ``most`` (by point, frame)."""
    inside = obs.join(window.select("frame_idx"), "frame_idx", "left_semi").select("point_id").distinct()
    return obs.join(window.select("frame_idx"), "frame_idx", "left_anti").join(inside, "point_id", "left_semi").orderBy("point_id", "frame_idx", "kp_idx").limit(most)
