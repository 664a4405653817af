"""Dense clouds: pairs, gates, fusion and cleaning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stereolith.operators.geometry import center, scene_scale
from stereolith.operators.ranking import consecutive, ranked
from stereolith.plans.scratch import Scratch
from stereolith.sources.listing import even_subset


def adjacent_pairs(frames: DataFrame, most: int) -> DataFrame:
    """(frame_a, frame_b) of consecutive keyframes (of frames, with fewer than two keyframes), evenly cut to ``most``."""
    marked = frames.agg(F.sum(F.col("is_keyframe").cast("int")).alias("_k"))
    some = frames.join(F.broadcast(marked)).where((F.coalesce("_k", F.lit(0)) < 2) | F.col("is_keyframe")).select("frame_idx")  # one row
    pairs = consecutive(some, "frame_idx", Scratch(frames.sparkSession, "sequence"), ("frame_a", "frame_b"))
    return even_subset(pairs, "frame_a", most, "round")


def gate_pairs(pairs: DataFrame, poses: DataFrame) -> DataFrame:
    """Pairs with status (ok, no pose, baseline), baseline, voxel size and depth range by the scene's scale."""
    x, y, z = center()
    c = poses.select("frame_idx", x.alias("cx"), y.alias("cy"), z.alias("cz"))
    a = c.select(F.col("frame_idx").alias("frame_a"), *[F.col(k).alias("a" + k) for k in ("cx", "cy", "cz")])
    b = c.select(F.col("frame_idx").alias("frame_b"), *[F.col(k).alias("b" + k) for k in ("cx", "cy", "cz")])
    base = F.sqrt((F.col("acx") - F.col("bcx")) ** 2 + (F.col("acy") - F.col("bcy")) ** 2 + (F.col("acz") - F.col("bcz")) ** 2)
    met = pairs.join(a, "frame_a", "left").join(b, "frame_b", "left").join(F.broadcast(scene_scale(poses))).withColumn("baseline", base)
    s = F.col("scale")
    status = F.when(F.col("baseline").isNull(), "no pose").when((F.col("baseline") < 0.005 * s) | (F.col("baseline") > 0.5 * s), "baseline").otherwise("ok")
    return met.select("frame_a", "frame_b", "baseline", status.alias("status"), F.greatest(0.005 * s, F.lit(1e-4)).alias("voxel"), F.greatest(0.02 * s, F.lit(1e-3)).alias("min_depth"), (5 * s).alias("max_depth"))


def merge_clouds(clouds: list[DataFrame]) -> DataFrame:
    out = clouds[0]
    for c in clouds[1:]:
        out = out.unionByName(c)
    return out


def voxel_downsample(cloud: DataFrame, size: float, min_views: int = 1) -> DataFrame:
    """Per cell of the grid mean position, mean colour truncated and number of sources; cells of fewer than ``min_views``
    sources go, unless that would leave none. Sums and sources are combined before the shuffle."""
    key = [F.floor(F.col(c) / size).alias(f"k{c}") for c in "xyz"]
    per_src = cloud.groupBy(*key, "src").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("x", "y", "z", "r", "g", "b")])
    cells = per_src.groupBy("kx", "ky", "kz").agg(F.sum("n").alias("n"), F.count("*").alias("views"), *[F.sum(c).alias(c) for c in ("x", "y", "z", "r", "g", "b")])
    cells = cells.select("kx", "ky", "kz", "n", "views", *[(F.col(c) / F.col("n")).alias(c) for c in "xyz"], *[F.floor(F.col(c) / F.col("n")).cast("int").alias(c) for c in "rgb"])
    if min_views <= 1:
        return cells
    top = cells.agg(F.max("views").alias("top"))
    return cells.join(F.broadcast(top)).where((F.col("views") >= min_views) | (F.col("top") < min_views)).drop("top")


#: Distinct places of a leaf, children of a node, quantiles that scale an axis, and places that ask a leaf at a time.
LEAF, FAN, QUANTILES, ASKED = 512, 16, 256, 16_000


def morton(ranks: np.ndarray) -> np.ndarray:
    """One number for three of 21 bits each: their bits in turn, so that near places have near numbers."""
    code = np.zeros(len(ranks), np.int64)
    for axis in range(3):
        for bit in range(21):
            code |= ((ranks[:, axis] >> bit) & 1) << (3 * bit + axis)
    return code


def _coded(edges: np.ndarray):
    """Places with their ``code``; coordinates are scaled by the quantiles ``edges`` first, so that outliers don't squeeze the rest."""

    def run(batches):
        share = np.linspace(0, 1, QUANTILES + 1)
        for rows in batches:
            p = rows[["x", "y", "z"]].to_numpy(float)
            u = np.stack([np.interp(p[:, i], edges[i], share) for i in range(3)], 1)
            yield rows.assign(code=morton((u * ((1 << 21) - 1)).astype(np.int64)))

    return run


_BOX = [f"{c}{k}" for c in "xyz" for k in (0, 1)]


def _boxes(df: DataFrame, *by) -> DataFrame:
    return df.groupBy(*by).agg(*[f(c).alias(f"{c}{k}") for c in "xyz" for k, f in ((0, F.min), (1, F.max))])


def _leaves_in_reach(first: DataFrame, dealt: DataFrame, scratch: Scratch) -> DataFrame:
    """(x, y, z, reach, leaf): each place with all other leaves that lie nearer than its ``reach``.

    Leaves are the lowest level of a tree of boxes, ``FAN`` children a node. Places go down in groups of one leaf and one power of two of
    their reach, so a far outlier takes nobody along; a group has a box and its largest reach, and only what lies within that is descended.
    Places meet the leaves of their group at the end.
    """
    level = scratch.table(_boxes(dealt, "leaf").withColumnRenamed("leaf", "node"), "leaves")
    levels = [level]
    while (levels[-1].agg(F.max("node")).first()[0] or 0) >= FAN:
        up = levels[-1].select(F.floor(F.col("node") / FAN).cast("long").alias("node"), *_BOX)
        levels.append(scratch.table(up.groupBy("node").agg(*[f(f"{c}{k}").alias(f"{c}{k}") for c in "xyz" for k, f in ((0, F.min), (1, F.max))]), f"level-{len(levels)}"))
    finite = F.when((F.col("reach") > 0) & (F.col("reach") < float("inf")), F.floor(F.log2("reach"))).otherwise(F.when(F.col("reach") > 0, 4000).otherwise(-4000)).cast("int")
    placed = first.withColumn("size", finite)
    groups = placed.groupBy("home", "size").agg(*[f(c).alias(f"q{c}{k}") for c in "xyz" for k, f in ((0, F.min), (1, F.max))], F.max("reach").alias("most"))
    groups = scratch.table(groups, "groups")
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"{c}0") - F.col(f"q{c}1"), F.col(f"q{c}0") - F.col(f"{c}1"))
    near = (gap("x") * gap("x") + gap("y") * gap("y") + gap("z") * gap("z")) <= F.col("most") * F.col("most") * (1 + 1e-9)
    own = groups.columns
    top = levels[-1].select("node", *_BOX).collect()  # FAN rows at most
    alive = groups.withColumn("t", F.explode(F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("node", *_BOX)]) for r in top]))).select(*own, "t.*").where(near).select(*own, "node")
    for lower in reversed(levels[:-1]):
        kids = lower.withColumn("up", F.floor(F.col("node") / FAN).cast("long"))
        alive = alive.withColumnRenamed("node", "up").join(kids, "up").where(near).select(*own, "node")
    pairs = scratch.table(alive.join(level, "node").where(F.col("node") != F.col("home")).select("home", "size", F.col("node").alias("leaf"), *_BOX), "pairs")
    away = lambda c: F.greatest(F.lit(0.0), F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1"))
    close = (away("x") * away("x") + away("y") * away("y") + away("z") * away("z")) <= F.col("reach") * F.col("reach") * (1 + 1e-9)
    return placed.select("x", "y", "z", "reach", "home", "size").join(pairs, ["home", "size"]).where(close).select("x", "y", "z", "reach", "leaf")


def _closest(q: np.ndarray, p: np.ndarray, n: np.ndarray, k: int, own: bool) -> np.ndarray:
    """For each of ``q`` k ascending distances to points at the places ``p``, of which n lie at each (infinite where there are fewer); ``own``: q are these places, and a point is not its own neighbour."""
    out = np.full((len(q), k), np.inf)
    most = min(k + 1, len(p))
    for at in range(0, len(q), 512):
        some = q[at : at + 512]
        d2 = sum((some[:, None, i] - p[None, :, i]) ** 2 for i in range(3))
        near = np.argpartition(d2, most - 1, 1)[:, :most]
        d, times = np.take_along_axis(d2, near, 1), n[near]
        if own:
            times = times - (near == at + np.arange(len(some))[:, None])
        order = np.argsort(d, 1, kind="stable")
        d, upto = np.sqrt(np.take_along_axis(d, order, 1)), np.cumsum(np.take_along_axis(times, order, 1), 1)
        held = (upto[:, :, None] <= np.arange(k)).sum(1)  # the place that holds the first, second, ... neighbour
        out[at : at + 512] = np.where(held < most, np.take_along_axis(d, np.minimum(held, most - 1), 1), np.inf)
    return out


_XYZ = ["x", "y", "z"]


def _lists(rows: np.ndarray, kept: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(kept.sum(1))), pa.int32()), pa.array(rows[kept]))


def _at(rows: pa.Table) -> np.ndarray:
    return np.stack([rows[c].to_numpy() for c in _XYZ], 1)


def _within(k: int):
    def run(rows: pa.Table) -> pa.Table:
        p = _at(rows)
        d = _closest(p, p, rows["n"].to_numpy(), k, True)
        return pa.table({**{c: rows[c] for c in _XYZ}, "home": rows["leaf"], "near": _lists(d, np.isfinite(d)), "reach": pa.array(d[:, -1])})

    return run


def _across(k: int):
    """What a leaf adds to places that ask it: only distances below their reach, and only places that get any."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        d = np.full((len(queries), k), np.inf)
        if len(queries) and len(rows):
            d = _closest(_at(queries), _at(rows), rows["n"].to_numpy(), k, False)
        kept = d < queries["reach"].to_numpy()[:, None] if len(queries) else d < 0
        some = kept.any(1)
        return pa.table({**{c: queries[c].filter(pa.array(some)) for c in _XYZ}, "near": _lists(d[some], kept[some])})

    return run


def knn_mean_distance(cloud: DataFrame, k: int = 8) -> DataFrame:
    """(uid, d): exact mean distance to the k nearest other points of (uid, x, y, z); infinite with k points or fewer.

    Points at one place are one row with a count. Places are ranked by a space-filling curve over quantile-scaled coordinates, in range
    partitions, and cut into leaves of ``LEAF`` places each, so a dense spot falls into many leaves. A place finds k neighbours
    in its leaf and asks only the leaves nearer than the last of these, which a tree of their boxes tells. The cloud is written once: sums
    in it that are worked out anew may end in other bits, and distances come back by the place.
    """
    scratch = Scratch(cloud.sparkSession, "knn")
    xyz = ["x", "y", "z"]
    keyed = scratch.table(cloud.select("uid", *[(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in xyz]), "cloud")
    places = keyed.select(*xyz).where(" and ".join(f"{c} is not null and not isnan({c})" for c in xyz)).groupBy(*xyz).agg(F.count("*").alias("n"))
    places = scratch.table(places, "places")
    cuts = F.array(*[F.lit(i / QUANTILES) for i in range(QUANTILES + 1)])
    found = places.agg(*[F.percentile_approx(c, cuts, 2_000).alias(c) for c in xyz]).first()
    edges = np.array([np.maximum.accumulate(found[c] if found[c] else [0.0] * (QUANTILES + 1)) for c in xyz])
    coded = places.mapInPandas(_coded(edges), "x double, y double, z double, n long, code long")
    dealt = ranked(coded, [F.col(c) for c in ("code", *xyz)], scratch).withColumn("leaf", F.floor(F.col("idx") / LEAF).cast("long")).select(*xyz, "n", "leaf")
    dealt = scratch.table(dealt, "dealt")
    first = scratch.table(dealt.groupBy("leaf").applyInArrow(_within(k), "x double, y double, z double, home long, near array<double>, reach double"), "first")
    near = first.select(*xyz, "near")
    if first.where("home > 0").limit(1).count():
        asked = scratch.table(_leaves_in_reach(first, dealt, scratch), "asked")
        # a leaf that very many ask answers in parts
        parts = asked.groupBy("leaf").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
        asked = asked.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64(*xyz), F.col("parts")).cast("int")).drop("parts")
        answers = dealt.join(parts, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        second = asked.groupBy("leaf", "part").cogroup(answers.groupBy("leaf", "part")).applyInArrow(_across(k), "x double, y double, z double, near array<double>")
        near = near.unionByName(second).groupBy(*xyz).agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    d = near.select(*xyz, F.when(F.size("near") == k, F.aggregate("near", F.lit(0.0), lambda a, v: a + v) / k).otherwise(F.lit(float("inf"))).alias("d"))
    d = scratch.table(d, "d")
    return keyed.join(d, xyz).select("uid", "d")


def statistical_outliers(cloud: DataFrame, k: int = 8, std: float = 2.0) -> DataFrame:
    """Points whose mean distance to k neighbours is below mean + std deviations of all; all of them if there are at most k."""
    scratch = Scratch(cloud.sparkSession, "outliers")
    cloud = scratch.table(cloud, "cloud")
    d = scratch.table(knn_mean_distance(cloud, k), "d")
    finite = d.where("d < double('infinity')")
    limit = finite.agg((F.avg("d") + std * F.stddev_pop("d")).alias("limit"))
    return cloud.join(d, "uid").join(F.broadcast(limit)).where(F.col("limit").isNull() | (F.col("d") < F.col("limit"))).drop("limit")


def cap_points(cloud: DataFrame, n: int, key: list[str], seed: int = 0) -> DataFrame:
    """Exactly n rows (all, if fewer), by md5 of seed and key."""
    return cloud.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *key)), *key).limit(n)


def dense_summary(pairs: DataFrame, cloud: DataFrame, poses: DataFrame) -> DataFrame:
    """One row: pairs total, used, failed; points; scale; voxel."""
    p = pairs.agg(F.count("*").alias("pairs"), F.sum((F.col("status") == "ok").cast("long")).alias("used"), F.sum((F.col("status") != "ok").cast("long")).alias("failed"))
    return p.join(F.broadcast(cloud.agg(F.count("*").alias("points")))).join(F.broadcast(scene_scale(poses))).withColumn("voxel", F.greatest(0.005 * F.col("scale"), F.lit(1e-4)))


