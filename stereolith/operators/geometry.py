"""Pose and projection columns. Poses are world-to-camera, flat columns r00..r22, t0..t2: Xc = R X + t."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

R = [f"r{i}{j}" for i in range(3) for j in range(3)]
T = ["t0", "t1", "t2"]
POSE = R + T


@dataclass(frozen=True)
class Camera:
    fx: float = 1000.0
    fy: float = 1000.0
    cx: float = 640.0
    cy: float = 360.0
    k1: float = 0.0


def prefixed(df: DataFrame, prefix: str, columns: list[str] = POSE) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) if c in columns else F.col(c) for c in df.columns])


def center(prefix: str = "") -> list[Column]:
    """The camera centre, -R't."""
    c = lambda n: F.col(prefix + n)
    return [-(c(f"r0{j}") * c("t0") + c(f"r1{j}") * c("t1") + c(f"r2{j}") * c("t2")) for j in range(3)]


def camera_center(poses: DataFrame) -> DataFrame:
    x, y, z = center()
    return poses.select("frame_idx", x.alias("cx"), y.alias("cy"), z.alias("cz"))


def rotation_between(a: str, b: str) -> list[list[Column]]:
    """Rb Ra' of two prefixes' rotations."""
    return [[sum((F.col(f"{b}r{i}{k}") * F.col(f"{a}r{j}{k}") for k in range(1, 3)), F.col(f"{b}r{i}0") * F.col(f"{a}r{j}0")) for j in range(3)] for i in range(3)]


def relative(a: str, b: str) -> dict[str, Column]:
    """Pose of b seen from a: R = Rb Ra', t = tb - R ta."""
    m = rotation_between(a, b)
    out = {f"r{i}{j}": m[i][j] for i in range(3) for j in range(3)}
    return out | {f"t{i}": F.col(f"{b}t{i}") - (m[i][0] * F.col(f"{a}t0") + m[i][1] * F.col(f"{a}t1") + m[i][2] * F.col(f"{a}t2")) for i in range(3)}


def composed(rel: str, base: str) -> dict[str, Column]:
    """``rel`` after ``base``: R = Rrel Rbase, t = Rrel tbase + trel."""
    c = F.col
    out = {f"r{i}{j}": c(f"{rel}r{i}0") * c(f"{base}r0{j}") + c(f"{rel}r{i}1") * c(f"{base}r1{j}") + c(f"{rel}r{i}2") * c(f"{base}r2{j}") for i in range(3) for j in range(3)}
    return out | {f"t{i}": c(f"{rel}r{i}0") * c(f"{base}t0") + c(f"{rel}r{i}1") * c(f"{base}t1") + c(f"{rel}r{i}2") * c(f"{base}t2") + c(f"{rel}t{i}") for i in range(3)}


def angle_deg(trace: Column) -> Column:
    """Rotation angle in degrees of a matrix of this trace."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))


def angle_between(a: str, b: str) -> Column:
    m = rotation_between(a, b)
    return angle_deg(m[0][0] + m[1][1] + m[2][2])


def relative_pose(pairs: DataFrame, poses: DataFrame) -> DataFrame:
    """(frame_a, frame_b) and the relative pose; pairs with an end that has no pose are left out."""
    a = prefixed(poses, "a_").withColumnRenamed("frame_idx", "frame_a")
    b = prefixed(poses, "b_").withColumnRenamed("frame_idx", "frame_b")
    return pairs.join(a, "frame_a").join(b, "frame_b").select("frame_a", "frame_b", *[v.alias(k) for k, v in relative("a_", "b_").items()])


def rotation_angles(poses: DataFrame) -> DataFrame:
    return poses.select("frame_idx", angle_deg(F.col("r00") + F.col("r11") + F.col("r22")).alias("angle"))


def quaternions(poses: DataFrame) -> DataFrame:
    """(frame_idx, qx, qy, qz, qw) by the branch of the largest diagonal, normalised."""
    c = F.col
    trace = c("r00") + c("r11") + c("r22")

    def branch(s: Column, x: Column, y: Column, z: Column, w: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"), z.alias("z"), w.alias("w"))

    s0 = F.sqrt(F.greatest(trace + 1, F.lit(0.0))) * 2
    s1 = F.sqrt(F.greatest(1 + c("r00") - c("r11") - c("r22"), F.lit(0.0))) * 2
    s2 = F.sqrt(F.greatest(1 + c("r11") - c("r00") - c("r22"), F.lit(0.0))) * 2
    s3 = F.sqrt(F.greatest(1 + c("r22") - c("r00") - c("r11"), F.lit(0.0))) * 2
    q = (
        F.when(trace > 0, branch(s0, (c("r21") - c("r12")) / s0, (c("r02") - c("r20")) / s0, (c("r10") - c("r01")) / s0, s0 / 4))
        .when((c("r00") > c("r11")) & (c("r00") > c("r22")), branch(s1, s1 / 4, (c("r01") + c("r10")) / s1, (c("r02") + c("r20")) / s1, (c("r21") - c("r12")) / s1))
        .when(c("r11") > c("r22"), branch(s2, (c("r01") + c("r10")) / s2, s2 / 4, (c("r12") + c("r21")) / s2, (c("r02") - c("r20")) / s2))
        .otherwise(branch(s3, (c("r02") + c("r20")) / s3, (c("r12") + c("r21")) / s3, s3 / 4, (c("r10") - c("r01")) / s3))
    )
    norm = F.sqrt(c("q.x") ** 2 + c("q.y") ** 2 + c("q.z") ** 2 + c("q.w") ** 2) + 1e-12
    return poses.select("frame_idx", q.alias("q")).select("frame_idx", *[(c(f"q.{k}") / norm).alias(f"q{k}") for k in "xyzw"])


def rotations(quats: DataFrame) -> DataFrame:
    """(frame_idx, r00..r22) of quaternions xyzw, normalised first."""
    n = F.sqrt(F.col("qx") ** 2 + F.col("qy") ** 2 + F.col("qz") ** 2 + F.col("qw") ** 2) + 1e-12
    q = quats.select("frame_idx", *[(F.col(f"q{k}") / n).alias(k) for k in "xyzw"])
    x, y, z, w = (F.col(k) for k in "xyzw")
    m = [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]
    return q.select("frame_idx", *[v.alias(k) for k, v in zip(R, m, strict=True)])


def in_camera(p: str = "") -> list[Column]:
    """A world point (x, y, z) in the camera of prefix ``p``."""
    c = lambda n: F.col(p + n)
    return [c(f"r{i}0") * F.col("x") + c(f"r{i}1") * F.col("y") + c(f"r{i}2") * F.col("z") + c(f"t{i}") for i in range(3)]


def project(rows: DataFrame, cam: Camera = Camera(), p: str = "") -> DataFrame:
    """``rows`` (a point and a pose each) with depth and pixel; a depth within 1e-9 of zero projects as at 1e-9."""
    xc, yc, zc = in_camera(p)
    rows = rows.withColumns({"_x": xc, "_y": yc, "depth": zc})
    z = F.when(F.abs("depth") < 1e-9, F.lit(1e-9)).otherwise(F.col("depth"))
    rows = rows.withColumns({"_x": F.col("_x") / z, "_y": F.col("_y") / z})
    bend = 1 + cam.k1 * (F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y"))
    return rows.withColumns({"pu": cam.fx * F.col("_x") * bend + cam.cx, "pv": cam.fy * F.col("_y") * bend + cam.cy}).drop("_x", "_y")


def scene_scale(poses: DataFrame) -> DataFrame:
    """One row: the diagonal of the box around the camera centres, 1e-6 at least, 1.0 with fewer than two poses."""
    c = camera_center(poses.dropna(subset=POSE)).agg(F.count("*").alias("n"), *[f(k).alias(f"{g}_{k}") for k in ("cx", "cy", "cz") for g, f in (("lo", F.min), ("hi", F.max))])
    d = F.sqrt(sum(((F.col(f"hi_{k}") - F.col(f"lo_{k}")) ** 2 for k in ("cy", "cz")), (F.col("hi_cx") - F.col("lo_cx")) ** 2))
    return c.select(F.when(F.col("n") < 2, F.lit(1.0)).otherwise(F.greatest(d, F.lit(1e-6))).alias("scale"))


def scene_median_radius(points: DataFrame) -> DataFrame:
    """One row: median distance to the centroid, plus 1e-6."""
    mid = points.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"))
    d = F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2 + (F.col("z") - F.col("mz")) ** 2)
    return points.join(F.broadcast(mid)).agg((F.median(d) + 1e-6).alias("radius"))


def distort_points(points: DataFrame, cam: Camera = Camera(), k: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0), s: tuple[float, float, float, float, float, float] = (0.0,) * 6) -> DataFrame:
    """Pinhole pixels (u, v) to distorted fisheye pixels (du, dv): equidistant angle, radial k, tangential and thin-prism terms s (p1, p2, s1..s4)."""
    a, b = (F.col("u") - cam.cx) / cam.fx, (F.col("v") - cam.cy) / cam.fy
    points = points.withColumns({"_a": a, "_b": b}).withColumn("_r", F.sqrt(F.col("_a") ** 2 + F.col("_b") ** 2))
    scale = F.when(F.col("_r") < 1e-9, F.lit(1.0)).otherwise(F.atan("_r") / F.col("_r"))
    points = points.withColumns({"_a": F.col("_a") * scale, "_b": F.col("_b") * scale})
    x, y = F.col("_a"), F.col("_b")
    points = points.withColumn("_q", x * x + y * y)
    q = F.col("_q")
    radial = 1 + q * (k[0] + q * (k[1] + q * (k[2] + q * k[3])))
    p1, p2, s1, s2, s3, s4 = s
    dx = x * radial + 2 * p1 * x * y + p2 * (q + 2 * x * x) + s1 * q + s2 * q * q
    dy = y * radial + 2 * p2 * x * y + p1 * (q + 2 * y * y) + s3 * q + s4 * q * q
    return points.withColumns({"du": cam.fx * dx + cam.cx, "dv": cam.fy * dy + cam.cy}).drop("_a", "_b", "_r", "_q")


def disparity_range(pairs: DataFrame) -> DataFrame:
    """``min_disparity, num_disparities`` of (focal, baseline, near, far)."""
    d = lambda z: F.col("focal") * F.col("baseline") / F.col(z)
    low = F.greatest(F.lit(0), F.floor(d("far")).cast("int") - 2)
    need = F.greatest(F.ceil(d("near")).cast("double") - low + 2, F.lit(16.0))
    return pairs.withColumn("min_disparity", low).withColumn("num_disparities", F.least(F.lit(256), F.greatest(F.lit(16), (16 * F.ceil(need / 16)).cast("int"))))


def disparity_to_points(disp: DataFrame, calib: DataFrame, min_disp: float = 1.0, min_depth: float = 0.1, max_depth: float = 100.0) -> DataFrame:
    """Rows (pair_id, px, py, disp) to world points by the pair's Q (q0..q15), rectifying rotation (m00..m22) and left pose."""
    met = disp.join(calib, "pair_id")
    q = lambda i: F.col(f"q{4 * i}") * F.col("px") + F.col(f"q{4 * i + 1}") * F.col("py") + F.col(f"q{4 * i + 2}") * F.col("disp") + F.col(f"q{4 * i + 3}")
    met = met.withColumns({f"_h{i}": q(i) for i in range(4)})
    met = met.where((F.abs("_h3") > 1e-12) & (F.col("disp") >= F.greatest(F.col("min_disparity").cast("double"), F.lit(min_disp))))
    met = met.withColumns({f"_p{i}": F.col(f"_h{i}") / F.col("_h3") for i in range(3)}).where((F.col("_p2") > min_depth) & (F.col("_p2") < max_depth))
    # a row vector times R1, then the inverse of the pose
    met = met.withColumns({f"_c{j}": F.col("_p0") * F.col(f"m0{j}") + F.col("_p1") * F.col(f"m1{j}") + F.col("_p2") * F.col(f"m2{j}") - F.col(f"t{j}") for j in range(3)})
    world = [F.col("_c0") * F.col(f"r0{j}") + F.col("_c1") * F.col(f"r1{j}") + F.col("_c2") * F.col(f"r2{j}") for j in range(3)]
    return met.select("pair_id", "px", "py", *[w.alias(n) for w, n in zip(world, "xyz", strict=True)])


def similarity_sums(pairs: DataFrame, by: str) -> DataFrame:
    """Per group: rows, means, source variance and the nine covariances of (sx, sy, sz) -> (dx, dy, dz), by plain aggregates."""
    s, d = ("sx", "sy", "sz"), ("dx", "dy", "dz")
    return pairs.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in s + d], sum((F.var_pop(c) for c in s[1:]), F.var_pop(s[0])).alias("var"), *[F.covar_pop(a, b).alias(f"c_{b}_{a}") for b in d for a in s])


def auto_config(datasets: DataFrame) -> DataFrame:
    """Settings derived from (n_frames, h, w, feature): sizes and limits that follow the image size and the number of frames."""
    n, side, pixels = F.col("n_frames"), F.greatest("h", "w").cast("double"), (F.col("h") * F.col("w")).cast("double")
    clip = lambda x, low, high: F.greatest(F.lit(low), F.least(F.lit(high), x))
    whole = lambda x: x.cast("int")
    orb = F.lower("feature") == "orb"
    base = whole(clip(F.sqrt(pixels) * 1.5, 2000.0, 12000.0))
    features = F.when(orb, whole(base * 1.5)).otherwise(base)
    reproj = F.when(orb, clip(side * 0.0020, 1.0, 4.0)).otherwise(clip(side * 0.0010, 0.5, 2.0))
    by_frames = lambda *steps: F.coalesce(*[F.when(n <= most, v) for most, v in steps[:-1]], steps[-1])
    # fixed values: names, factors, limits and steps of the settings
    columns = {
        "image_size": side,
        "feature_count": features,
        "min_features": F.greatest(F.lit(80), whole(features * 0.01)),
        "reproj_thresh": reproj,
        "ransac_thresh": reproj * 0.8,
        "triang_thresh": reproj,
        "guided_radius_px": clip(side * 0.008, 5.0, 20.0),
        "init_search_ratio": by_frames((50, F.lit(1.0)), (200, F.lit(0.06)), F.lit(0.03)),
        "init_candidate_window": by_frames((20, F.greatest(F.lit(1), n - 1)), (50, n), F.lit(15)),
        "init_max_pairs": by_frames((50, F.floor(n * (n - 1) / 2).cast("int")), clip(n * 3, 100, 500)),
        "init_min_inliers": whole(clip(side * 0.022, 60.0, 120.0)),
        "init_min_parallax_deg": F.lit(16.0),
        "pnp_window": by_frames((50, F.lit(40)), (200, F.lit(30)), F.lit(20)),
        "pnp_min_inliers": whole(clip(side * 0.008, 12.0, 25.0)),
        "pnp_ransac_iters": whole(clip(100 + side * 0.05, 100.0, 300.0)),
        "multiview_trigger_every_kf": by_frames((100, F.lit(5)), (500, F.lit(10)), F.lit(15)),
        "ba_local_covis_neighbors": whole(clip(12 - F.log10(F.greatest(n, F.lit(10)).cast("double")) * 2, 6.0, 12.0)),
        "ba_min_obs": clip(n * 2, 50, 150),
        "ba_local_iters": F.lit(25),
        "ba_local_refinements": F.lit(2),
        "ba_global_iters": whole(clip(40 + F.log2(F.greatest(n, F.lit(2)).cast("double")) * 3, 40.0, 80.0)),
        "ba_global_image_growth": F.lit(1.10),
        "ba_global_point_growth": F.lit(1.10),
        "loop_vocab_size": whole(clip(F.sqrt(n.cast("double")) * 40, 400.0, 1500.0)),
        "loop_min_inliers": whole(clip(side * 0.006, 12.0, 25.0)),
        "loop_max_candidates": F.lit(10),
        "loop_min_gap": F.greatest(F.lit(15), F.floor(n / 8).cast("int")),
        "reloc_min_matches": whole(clip(side * 0.030, 30.0, 80.0)),
        "reloc_min_inliers": whole(clip(side * 0.015, 15.0, 40.0)),
        "reloc_max_candidates": F.lit(8),
        "pgo_iters": F.lit(80),
        "complete_max_transitivity": F.lit(5),
        "continue_max_angle_deg": F.lit(2.0),
        "filter_min_tri_angle_deg": F.lit(1.5),
    }
    return datasets.select("dataset_id", *[v.alias(k) for k, v in columns.items()])
