"""Co-visibility of frames and pose-graph edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stereolith.operators.geometry import POSE, T, angle_between, angle_deg, center, prefixed, relative
from stereolith.operators.graph import connected_components
from stereolith.operators.ranking import consecutive, nearest_marked, ranked
from stereolith.plans.scratch import Scratch


def covisibility(obs: DataFrame) -> DataFrame:
    """(frame_a, frame_b, n) with a < b: points that both frames observe. Tracks are capped, so a point gives few pairs."""
    o = obs.select("point_id", "frame_idx").distinct()
    a, b = o.withColumnRenamed("frame_idx", "frame_a"), o.withColumnRenamed("frame_idx", "frame_b")
    return a.join(b, "point_id").where("frame_a < frame_b").groupBy("frame_a", "frame_b").agg(F.count("*").alias("n"))


def both_ways(covis: DataFrame) -> DataFrame:
    return covis.select("frame_a", "frame_b", "n").unionByName(covis.select(F.col("frame_b").alias("frame_a"), F.col("frame_a").alias("frame_b"), "n"))


def top_neighbours(covis: DataFrame, n: int, exclude: DataFrame | None = None) -> DataFrame:
    """(frame_a, frame_b, n, rank): each frame's most co-visible frames, ties to the lower index."""
    both = both_ways(covis)
    if exclude is not None:
        both = both.join(exclude.select(F.col("frame_idx").alias("frame_b")), "frame_b", "left_anti")
    w = Window.partitionBy("frame_a").orderBy(F.desc("n"), "frame_b")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("frame_a", "frame_b", "n", "rank")


def rank_by_points(obs: DataFrame, n: int, query: int) -> DataFrame:
    """The n frames with most points, without ``query``."""
    return obs.where(F.col("frame_idx") != query).groupBy("frame_idx").agg(F.countDistinct("point_id").alias("points")).orderBy(F.desc("points"), "frame_idx").limit(n)


def covis_ratio(matches: DataFrame, obs: DataFrame, last: DataFrame, least: int = 30, keyframe_obs: DataFrame | None = None) -> DataFrame:
    """Per pair (frame, last keyframe): share of the frame's matched bound keypoints whose point the keyframe sees; 0 below ``least``.

    ``matches``: (frame_a, frame_b, kp_b), frame_a the keyframe. ``last``: (frame_b, frame_a) pairs.
    ``keyframe_obs``: what keyframes see, if that is another table than ``obs``.
    """
    bound = matches.join(last, ["frame_a", "frame_b"]).select("frame_a", "frame_b", F.col("kp_b").alias("kp_idx")).distinct()
    bound = bound.join(obs.select(F.col("frame_idx").alias("frame_b"), "kp_idx", "point_id"), ["frame_b", "kp_idx"])
    seen = (keyframe_obs or obs).select(F.col("frame_idx").alias("frame_a"), "point_id", F.lit(1).alias("seen")).distinct()
    met = bound.join(seen, ["frame_a", "point_id"], "left").groupBy("frame_a", "frame_b").agg(F.count("*").alias("bound"), F.sum(F.coalesce("seen", F.lit(0))).alias("shared"))
    return met.select("frame_a", "frame_b", "bound", F.when(F.col("bound") >= least, F.col("shared") / F.col("bound")).otherwise(0.0).alias("ratio"))


def posed_pairs(pairs: DataFrame, poses: DataFrame) -> DataFrame:
    """Pairs with both poses under a_ and b_, and the way between their centres."""
    a = prefixed(poses.select("frame_idx", *POSE), "a_").withColumnRenamed("frame_idx", "frame_a")
    b = prefixed(poses.select("frame_idx", *POSE), "b_").withColumnRenamed("frame_idx", "frame_b")
    ca, cb = center("a_"), center("b_")
    base = F.sqrt((ca[0] - cb[0]) ** 2 + (ca[1] - cb[1]) ** 2 + (ca[2] - cb[2]) ** 2)
    return pairs.join(a, "frame_a").join(b, "frame_b").withColumn("baseline", base)


def keyframe_decision(pairs: DataFrame, poses: DataFrame, scale: DataFrame, angle: float = 5.0, way: float = 0.15, covis: float = 0.60, gap: int = 2) -> DataFrame:
    """``keyframe`` of (frame_a last keyframe, frame_b, ratio): turned, moved or little in common, and ``gap`` frames later."""
    met = posed_pairs(pairs, poses).join(F.broadcast(scale))
    hit = (angle_between("a_", "b_") > angle) | (F.col("baseline") / F.col("scale") > way) | (F.col("ratio") < covis)
    return met.select("frame_a", "frame_b", (hit & (F.col("frame_b") - F.col("frame_a") >= gap)).alias("keyframe"))


def cull_keyframes(obs: DataFrame, keyframes: DataFrame, share: float = 0.80, recent: int = 10) -> DataFrame:
    """Redundant pairs among the last ``recent`` keyframes but the newest: shared over the smaller count above ``share``; the later goes.

    Nothing with ``recent`` keyframes or fewer.
    """
    k = keyframes.select("frame_idx")
    many = k.agg(F.count("*").alias("_n"), F.max("frame_idx").alias("_newest")).where(F.col("_n") > recent)
    some = k.orderBy(F.desc("frame_idx")).limit(recent).join(F.broadcast(many)).where("frame_idx < _newest").select("frame_idx")  # one row
    o = obs.join(some, "frame_idx", "left_semi").select("point_id", "frame_idx").distinct()
    size = o.groupBy("frame_idx").agg(F.count("*").alias("size"))
    met = covisibility(o).join(size.select(F.col("frame_idx").alias("frame_a"), F.col("size").alias("sa")), "frame_a").join(size.select(F.col("frame_idx").alias("frame_b"), F.col("size").alias("sb")), "frame_b")
    return met.where(F.col("n") / F.least("sa", "sb") > share).select(F.col("frame_b").alias("frame_idx")).distinct()


def rank_view_partners(covis: DataFrame, poses: DataFrame, k: int = 8, least: float = 1e-6) -> DataFrame:
    """(frame_a, frame_b, score, rank) by shared + 0.1 log1p(baseline); pairs closer than ``least`` are left out."""
    met = posed_pairs(both_ways(covis), poses).where(F.col("baseline") >= least).withColumn("score", F.col("n") + 0.1 * F.log1p("baseline"))
    w = Window.partitionBy("frame_a").orderBy(F.desc("score"), "frame_b")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("frame_a", "frame_b", "score", "rank")


def filter_window_by_angle(rays: DataFrame, window: DataFrame, base: int, least: int = 8, wide: float = 6.0, share: float = 0.2, points: int = 10) -> DataFrame:
    """Frames of ``window`` kept beside ``base``: enough shared points, enough of them seen under ``wide`` degrees or more.

    Fewer than three kept, or fewer than ``points`` points in ``base``: the whole window stays. The base itself counts as kept.
    """
    own = rays.where(F.col("frame_idx") == base).select("point_id", *[F.col(c).alias("a_" + c) for c in ("dx", "dy", "dz")])
    other = rays.join(window.select("frame_idx").where(F.col("frame_idx") != base), "frame_idx", "left_semi").select("point_id", "frame_idx", *[F.col(c).alias("b_" + c) for c in ("dx", "dy", "dz")])
    dot = F.col("a_dx") * F.col("b_dx") + F.col("a_dy") * F.col("b_dy") + F.col("a_dz") * F.col("b_dz")
    met = own.join(other, "point_id").groupBy("frame_idx").agg(F.count("*").alias("shared"), F.sum((F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))) >= wide).cast("int")).alias("wide"))
    kept = met.where((F.col("shared") >= least) & (F.col("wide") >= F.greatest(F.lit(least), (share * F.col("shared")).cast("int")))).select("frame_idx").unionByName(window.where(F.col("frame_idx") == base).select("frame_idx"))
    count = kept.agg(F.count("*").alias("k")).join(F.broadcast(own.agg(F.count("*").alias("p"))))
    marked = window.select("frame_idx").join(kept.withColumn("in", F.lit(True)), "frame_idx", "left").join(F.broadcast(count))
    return marked.where(F.col("in") | (F.col("k") < 3) | (F.col("p") < points)).select("frame_idx")


def anomaly_blocks(covis: DataFrame, least: int = 10, share: float = 0.1) -> DataFrame:
    """(frame_idx, component, size, odd): small blocks of frames beside the largest one.

    Odd: not the largest, at least 2 frames, at most max(2, int(share largest)), and fewer than the median of sizes from 2 on.
    """
    comp = connected_components(covis.where(F.col("n") >= least).select(F.col("frame_a").alias("a"), F.col("frame_b").alias("b")))
    size = comp.groupBy("component").agg(F.count("*").alias("size"))
    top = size.orderBy(F.desc("size"), "component").limit(1).select(F.col("component").alias("main"), F.col("size").alias("most"))
    mid = size.where("size >= 2").agg(F.median("size").alias("mid"))
    odd = (F.col("component") != F.col("main")) & (F.col("size") >= 2) & (F.col("size") <= F.greatest(F.lit(2), (share * F.col("most")).cast("int"))) & (F.col("size") < F.col("mid"))
    met = size.join(F.broadcast(top)).join(F.broadcast(mid)).select("component", "size", odd.alias("odd"))
    return comp.join(met, "component").select(F.col("node").cast("int").alias("frame_idx"), "component", "size", "odd")


def edge_angles(edges: DataFrame, poses: DataFrame) -> DataFrame:
    """(frame_a, frame_b, angle): degrees between an edge's measured rotation (r00..r22) and that of the poses."""
    met = posed_pairs(edges.select("frame_a", "frame_b", *[F.col(f"r{i}{j}").alias(f"e_r{i}{j}") for i in range(3) for j in range(3)]), poses)
    rel = relative("a_", "b_")
    met = met.select("frame_a", "frame_b", *[F.col(f"e_r{i}{j}") for i in range(3) for j in range(3)], *[rel[f"r{i}{j}"].alias(f"m_r{i}{j}") for i in range(3) for j in range(3)])
    return met.select("frame_a", "frame_b", angle_between("m_", "e_").alias("angle"))


def pose_outliers(edges: DataFrame, poses: DataFrame, limit: float = 12.0, frames: int = 6, least_edges: int = 2) -> DataFrame:
    """Frames of which ``least_edges`` or more measured rotations exist and even the best differs by more than ``limit`` degrees."""
    a = edge_angles(edges, poses)
    each = a.select(F.col("frame_a").alias("frame_idx"), "angle").unionByName(a.select(F.col("frame_b").alias("frame_idx"), "angle"))
    total = poses.agg(F.count("*").alias("total"))
    return each.groupBy("frame_idx").agg(F.count("*").alias("edges"), F.min("angle").alias("least")).join(F.broadcast(total)).where((F.col("edges") >= least_edges) & (F.col("least") > limit) & (F.col("total") >= frames)).select("frame_idx", "edges", "least")


def rotation_edges(keyframes: DataFrame, gap: int = 6) -> DataFrame:
    """Consecutive keyframes at most ``gap`` apart."""
    nxt = consecutive(keyframes, "frame_idx", Scratch(keyframes.sparkSession, "sequence"), ("frame_a", "frame_b"))
    return nxt.where(F.col("frame_b") - F.col("frame_a") <= gap)


def filter_rotation_edges(edges: DataFrame, poses: DataFrame, limit: float = 10.0) -> DataFrame:
    """Edges within ``limit`` degrees of the poses, of the largest component that is left."""
    ok = edge_angles(edges, poses).where(F.col("angle") <= limit)
    comp = connected_components(ok.select(F.col("frame_a").alias("a"), F.col("frame_b").alias("b")))
    main = comp.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(1)
    inside = comp.join(F.broadcast(main.select("component")), "component", "left_semi").select(F.col("node").cast("int").alias("frame_a"))
    return ok.join(inside, "frame_a", "left_semi").select("frame_a", "frame_b", "angle")


def pose_graph_edges(keyframes: DataFrame, loops: DataFrame, poses: DataFrame, scale: DataFrame) -> DataFrame:
    """(frame_a, frame_b, kind, weight): consecutive keyframes with weight 1, and loops with max(1.5, log1p(max(1, shared or 10))).

    ``loops``: (frame_a, frame_b, shared) with a measured pose. Dropped: neighbours, ends without a pose, translation error over half
    the scale, rotation error over half a radian.
    """
    seq = consecutive(keyframes, "frame_idx", Scratch(keyframes.sparkSession, "sequence"), ("frame_a", "frame_b"))
    err = edge_errors(loops, poses).join(F.broadcast(scale)).where((F.abs(F.col("frame_b") - F.col("frame_a")) > 1) & (F.col("way") <= 0.5 * F.col("scale")) & (F.radians("angle") <= 0.5))
    weight = F.greatest(F.lit(1.5), F.log1p(F.greatest(F.lit(1), F.coalesce("shared", F.lit(10))).cast("double")))
    loop = err.join(loops.select("frame_a", "frame_b", "shared"), ["frame_a", "frame_b"]).select("frame_a", "frame_b", F.lit("loop").alias("kind"), weight.alias("weight"))
    return seq.select("frame_a", "frame_b", F.lit("seq").alias("kind"), F.lit(1.0).alias("weight")).unionByName(loop)


def edge_errors(edges: DataFrame, poses: DataFrame) -> DataFrame:
    """(frame_a, frame_b, angle, way) of the measured pose times the inverse of the current relative pose."""
    met = posed_pairs(edges.select("frame_a", "frame_b", *[F.col(c).alias("e_" + c) for c in POSE]), poses)
    rel = relative("a_", "b_")
    met = met.select("frame_a", "frame_b", *[F.col("e_" + c) for c in POSE], *[rel[c].alias("m_" + c) for c in POSE])
    # E M^-1 has rotation Re Rm' and translation te - Re Rm' tm
    d = [[sum((F.col(f"e_r{i}{k}") * F.col(f"m_r{j}{k}") for k in range(1, 3)), F.col(f"e_r{i}0") * F.col(f"m_r{j}0")) for j in range(3)] for i in range(3)]
    t = [F.col(f"e_{T[i]}") - (d[i][0] * F.col("m_t0") + d[i][1] * F.col("m_t1") + d[i][2] * F.col("m_t2")) for i in range(3)]
    return met.select("frame_a", "frame_b", angle_deg(d[0][0] + d[1][1] + d[2][2]).alias("angle"), F.sqrt(t[0] * t[0] + t[1] * t[1] + t[2] * t[2]).alias("way"))


def prune_loop_edges(edges: DataFrame, poses: DataFrame, scale: DataFrame, angle: float = 10.0, way: float = 0.05) -> DataFrame:
    """Sequence edges, and loop edges within ``angle`` degrees and ``way`` times the scale."""
    met = edges.join(edge_errors(edges, poses), ["frame_a", "frame_b"]).join(F.broadcast(scale))
    return met.where((F.col("kind") == "seq") | ((F.col("angle") <= angle) & (F.col("way") <= way * F.col("scale")))).select("frame_a", "frame_b", "kind")


def visibility_score(keypoints: DataFrame, width: int, height: int, levels: int = 6) -> DataFrame:
    """(frame_idx, score): over grids 2x2 .. 64x64, occupied cells times the grid's cells."""
    dim = F.explode(F.array(*[F.lit(2 ** (k + 1)) for k in range(levels)])).alias("dim")
    cell = lambda c, size: F.greatest(F.lit(0), F.least(F.col("dim") - 1, F.floor(F.col(c) / size * F.col("dim")).cast("int")))
    rows = keypoints.select("frame_idx", "u", "v", dim).select("frame_idx", "dim", cell("u", width).alias("cu"), cell("v", height).alias("cv")).distinct()
    return rows.groupBy("frame_idx", "dim").agg(F.count("*").alias("n")).groupBy("frame_idx").agg(F.sum(F.col("n") * F.col("dim") * F.col("dim")).cast("long").alias("score"))


def next_frames(candidates: DataFrame, registered: DataFrame, visible: DataFrame, width: int, height: int, near: int = 3, seeds: tuple[int, ...] = ()) -> DataFrame:
    """(frame_idx, score, rank): candidates within ``near`` of a registered frame, by the score of their visible keypoints.

    If there is none, all candidates by their distance to the nearest of ``seeds`` (the frames of the first pair), with score 0.
    """
    candidates = candidates.select("frame_idx")
    offsets = registered.select(F.explode(F.sequence(F.col("frame_idx") - near, F.col("frame_idx") + near)).alias("frame_idx")).distinct()
    some = candidates.join(offsets, "frame_idx", "left_semi")
    s = visibility_score(visible.join(some, "frame_idx", "left_semi"), width, height)
    met = some.join(s, "frame_idx", "left").select("frame_idx", F.coalesce("score", F.lit(0)).cast("long").alias("score"), F.lit(0).alias("_way"))
    if seeds:
        none = some.agg(F.count("*").alias("_n")).where("_n = 0")
        way = F.array_min(F.array(*[F.abs(F.col("frame_idx") - s) for s in seeds]))
        met = met.unionByName(candidates.crossJoin(F.broadcast(none)).select("frame_idx", F.lit(0).cast("long").alias("score"), way.cast("int").alias("_way")))
    order = [F.col("_way"), F.desc("score"), F.col("frame_idx")]
    found = ranked(met, order, Scratch(candidates.sparkSession, "next"), rank="rank").drop("_way")
    return found.withColumn("rank", (F.col("rank") + 1).cast("int"))


def nearest_registered(frames: DataFrame) -> DataFrame:
    """(frame_idx, nearest): the registered frame nearest by index of (frame_idx, registered), ties to the lower."""
    f = nearest_marked(frames, "frame_idx", F.col("registered"), Scratch(frames.sparkSession, "nearest"))
    return f.select("frame_idx", F.when(F.col("low").isNull() | (F.col("high") - F.col("frame_idx") < F.col("frame_idx") - F.col("low")), F.col("high")).otherwise(F.col("low")).alias("nearest"))
