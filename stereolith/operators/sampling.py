"""Choosing frames of many videos: windows and aggregates by video, so that one exchange serves a whole plan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VIDEO = "video_id"


def target_frame_count(videos: DataFrame, low: int, high: int) -> DataFrame:
    """``target`` of (total, fps_orig, fps): int(total fps / fps_orig) clamped to low..high, then to 1..total."""
    want = (F.col("total") * F.col("fps") / F.col("fps_orig")).cast("int")
    return videos.withColumn("target", F.greatest(F.lit(1), F.least(F.greatest(F.lit(low), F.least(F.lit(high), want)), F.col("total").cast("int"))))


def sample_points(totals: DataFrame) -> DataFrame:
    """(video_id, frame_no): every max(1, total // 100)-th frame and the last."""
    step = F.greatest(F.lit(1), F.floor(F.col("total") / 100).cast("int"))
    picked = F.array_distinct(F.concat(F.sequence(F.lit(0), F.col("total").cast("int") - 1, step), F.array(F.col("total").cast("int") - 1)))
    return totals.where("total > 0").select(VIDEO, F.explode(picked).alias("frame_no"))


def linspace_index(i: Column, n: Column, k: Column, how: str = "trunc") -> Column:
    """Element i of k evenly spaced places over 0..n-1: truncated, or rounded half to even."""
    x = i * ((n - 1) / F.greatest(k - 1, F.lit(1)))
    x = x.cast("int") if how == "trunc" else F.bround(x, 0).cast("int")
    return F.when(k == 1, F.lit(0)).when(i == k - 1, (n - 1).cast("int")).otherwise(x)


def uniform_sample(totals: DataFrame) -> DataFrame:
    """(video_id, frame_no) of (total, n): trunc(linspace(0, total - 1, n)), each once."""
    i = F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("i")
    rows = totals.where("n > 0 and total > 0").select(VIDEO, "total", "n", i)
    return rows.select(VIDEO, linspace_index(F.col("i"), F.col("total"), F.col("n")).alias("frame_no")).distinct()


def flow_rate(samples: DataFrame) -> DataFrame:
    """``flow``: magnitude over the gap to the sample before, if that and this were readable, else 0; the first takes the second's."""
    w = Window.partitionBy(VIDEO).orderBy("frame_no")
    gap = F.col("frame_no") - F.lag("frame_no").over(w)
    rate = F.when(F.col("readable") & F.coalesce(F.lag("readable").over(w), F.lit(False)), F.col("magnitude") / gap).otherwise(0.0)
    out = samples.withColumns({"flow": rate, "_n": F.row_number().over(w)})
    return out.withColumn("flow", F.when(F.col("_n") == 1, F.coalesce(F.lead("flow").over(w), F.col("flow"))).otherwise(F.col("flow"))).drop("_n")


def interpolate_to_full(samples: DataFrame, totals: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each frame 0..total-1: linear between samples, flat outside."""
    full = totals.where("total > 0").select(VIDEO, F.explode(F.sequence(F.lit(0), F.col("total").cast("int") - 1)).alias("frame_no"))
    met = full.join(samples.select(VIDEO, "frame_no", F.col("frame_no").alias("_at"), *columns), [VIDEO, "frame_no"], "left")
    back, ahead = Window.partitionBy(VIDEO).orderBy("frame_no").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(VIDEO).orderBy("frame_no").rowsBetween(0, Window.unboundedFollowing)
    met = met.withColumns({"_p": F.last("_at", True).over(back), "_q": F.first("_at", True).over(ahead)} | {f"_p_{c}": F.last(c, True).over(back) for c in columns} | {f"_q_{c}": F.first(c, True).over(ahead) for c in columns})
    share = (F.col("frame_no") - F.col("_p")) / F.greatest(F.col("_q") - F.col("_p"), F.lit(1))
    value = lambda c: F.when(F.col("_p").isNull(), F.col(f"_q_{c}")).when(F.col("_q").isNull() | (F.col("_p") == F.col("_q")), F.col(f"_p_{c}")).otherwise(F.col(f"_p_{c}") + (F.col(f"_q_{c}") - F.col(f"_p_{c}")) * share)
    return met.select(VIDEO, "frame_no", *[F.coalesce(value(c), F.lit(0.0)).alias(c) for c in columns])


def gate_frames(frames: DataFrame, q: float = 0.05, share: float = 0.08) -> DataFrame:
    """``valid``: sharpness and flow each at or over max(5 % quantile, 0.08 median) of the video."""
    w = Window.partitionBy(VIDEO)
    limit = lambda c: F.greatest(F.percentile(c, F.lit(q)).over(w), share * F.percentile(c, F.lit(0.5)).over(w))
    return frames.withColumns({"_s": limit("sharpness"), "_f": limit("flow")}).withColumn("valid", (F.col("sharpness") >= F.col("_s")) & (F.col("flow") >= F.col("_f"))).drop("_s", "_f")


def bin_of(frame: Column, total: Column, bins: Column) -> Column:
    """The bin of a frame: edges are trunc(i total / bins)."""
    step = total / bins
    first = F.greatest(F.lit(0), F.floor(frame / step).cast("int") - 1)
    # the quotient may be off by one from the truncated edges, so the two bins after the first guess are tried
    up = lambda b: b + F.when((b + 1 < bins) & (((b + 1) * step).cast("int") <= frame), 1).otherwise(0)
    return up(up(up(first)))


def enforce_coverage(frames: DataFrame, least: int = 12, bins: int = 20) -> DataFrame:
    """``valid`` with, in each bin of fewer than ``least`` valid frames, the best ``least`` frames by sharpness times flow valid too.

    The best are taken of all frames of the bin, valid before or not, so a bin may end with more; ties go to the higher index.
    """
    w = Window.partitionBy(VIDEO)
    frames = frames.withColumn("_b", bin_of(F.col("frame_no"), F.count("*").over(w), F.lit(bins)))
    inside = Window.partitionBy(VIDEO, "_b")
    turn = F.row_number().over(inside.orderBy(F.desc(F.col("sharpness") * F.col("flow")), F.desc("frame_no")))
    frames = frames.withColumns({"_n": F.sum(F.col("valid").cast("int")).over(inside), "_t": turn})
    return frames.withColumn("valid", F.col("valid") | ((F.col("_n") < least) & (F.col("_t") <= least))).drop("_b", "_n", "_t")


def stratified_select(frames: DataFrame, bins: int = 20) -> DataFrame:
    """Frames (video_id, frame_no) by a quota per bin, of rows with ``valid, weight, target``.

    n = min(target, valid frames), min(bins, n) bins, quota n // bins and one more in the first n % bins. A bin without a
    valid frame gives none; a quota that covers the bin takes all its frames, valid or not; without weight its valid frames are
    taken evenly; else the frames where the running weight passes (i + 0.5) / quota. Weights are summed as whole numbers of 10^-12 of
    the size of the bin's largest, so that a weight that reaches a mark exactly does so in whatever order they are added.
    """
    w = Window.partitionBy(VIDEO)
    f = frames.withColumns({"_total": F.count("*").over(w), "_valid": F.sum(F.col("valid").cast("int")).over(w)})
    f = f.withColumn("_n", F.least(F.col("target"), F.col("_valid"))).where("_n > 0").withColumn("_bins", F.least(F.lit(bins), F.col("_n")))
    f = f.withColumn("_b", bin_of(F.col("frame_no"), F.col("_total"), F.col("_bins")))
    quota = F.floor(F.col("_n") / F.col("_bins")) + (F.col("_b") < F.col("_n") % F.col("_bins")).cast("int")
    inside = Window.partitionBy(VIDEO, "_b")
    run = inside.orderBy("frame_no").rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumn("_w", F.when(F.col("valid"), F.col("weight")).otherwise(0.0))
    top = F.max("_w").over(inside)
    f = f.withColumn("_w", F.when(top > 0, F.coalesce(F.round(F.col("_w") * F.pow(F.lit(10.0), 12 - F.floor(F.log10(top)))).try_cast("decimal(20,0)"), F.lit(0))).otherwise(F.lit(0)).cast("decimal(20,0)"))
    f = f.withColumns({"_size": F.count("*").over(inside), "_ok": F.sum(F.col("valid").cast("int")).over(inside), "_sum": F.sum("_w").over(inside), "_cum": F.sum("_w").over(run), "_rank": F.sum(F.col("valid").cast("int")).over(run) - 1, "_k": quota})
    before = F.col("_cum") - F.col("_w")
    f = f.withColumn("_before", before)
    passed = lambda c: F.expr(f"(2 * {c} * cast(_k as decimal(10,0)) + _sum) div (2 * _sum)")
    even = F.exists(F.sequence(F.lit(0), F.col("_k").cast("int") - 1), lambda i: linspace_index(i, F.col("_ok"), F.col("_k"), "round") == F.col("_rank"))
    take = F.when(F.col("_k") >= F.col("_size"), True).when(F.col("_sum") <= 0, F.col("valid") & even).otherwise((F.col("_w") > 0) & (passed("_cum") > passed("_before")))
    return f.where((F.col("_ok") > 0) & (F.col("_k") > 0)).where(take).select(VIDEO, "frame_no")


def smart_sample(frames: DataFrame, targets: DataFrame, min_frames: int = 10, extra: Column | None = None) -> DataFrame:
    """Gate, coverage and stratified choice; a video with fewer than ``min_frames`` valid frames is sampled evenly.

    ``targets``: (video_id, target). ``extra`` multiplies the weight sharpness * flow.
    """
    w = Window.partitionBy(VIDEO)
    f = enforce_coverage(gate_frames(frames)).join(targets, VIDEO)
    weight = F.col("sharpness") * F.col("flow") * F.col("valid").cast("int")
    f = f.withColumns({"weight": weight * extra if extra is not None else weight, "_ok": F.sum(F.col("valid").cast("int")).over(w), "_total": F.count("*").over(w)})
    f = f.withColumn("weight", F.when(F.sum("weight").over(w) > 0, F.col("weight")).otherwise(F.col("valid").cast("double")))
    few = f.where(F.col("_ok") < min_frames).select(VIDEO, F.col("_total").alias("total"), F.least("target", "_total").alias("n")).distinct()
    return stratified_select(f.where(F.col("_ok") >= min_frames)).unionByName(uniform_sample(few))


def gaussian(sigma: float = 2.0) -> list[float]:
    half = (int(4 * sigma + 1) | 1) // 2
    w = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-half, half + 1)]
    return [x / sum(w) for x in w]


def parallax_scores(coarse: DataFrame, totals: DataFrame, sigma: float = 2.0) -> DataFrame:
    """(video_id, frame_no, parallax) from coarse poses (video_id, frame_no, cx, cy, cz, angle to the posed frame before, in radians).

    Score of a coarse frame: way from the last posed centre plus 0.1 radians(angle); the angle is in radians already and
    converted all the same, as the score is defined. Interpolated, smoothed with mirrored ends, divided by the largest.
    """
    w = Window.partitionBy(VIDEO).orderBy("frame_no")
    posed = coarse.where("cx is not null")
    way = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in ("cy", "cz")), (F.col("cx") - F.lag("cx").over(w)) ** 2))
    scored = posed.select(VIDEO, "frame_no", F.coalesce(way + 0.1 * F.radians("angle"), F.lit(0.0)).alias("score"))
    scored = scored.unionByName(coarse.where("cx is null").select(VIDEO, "frame_no", F.lit(0.0).alias("score")))
    full = interpolate_to_full(scored, totals, ["score"])
    k = gaussian(sigma)
    half = len(k) // 2
    turn = F.pmod(F.col("j"), F.greatest(2 * (F.col("total") - 1), F.lit(1)))
    padded = totals.where("total > 0").select(VIDEO, "total", F.explode(F.sequence(F.lit(-half), F.col("total").cast("int") - 1 + half)).alias("j"))
    padded = padded.select(VIDEO, "total", "j", F.when(turn > F.col("total") - 1, 2 * (F.col("total") - 1) - turn).otherwise(turn).cast("int").alias("frame_no")).join(full, [VIDEO, "frame_no"])
    by_place = Window.partitionBy(VIDEO).orderBy("j")
    smooth = sum((k[half + i] * (F.lead("score", i).over(by_place) if i > 0 else F.lag("score", -i).over(by_place)) for i in range(-half + 1, half + 1)), k[0] * F.lag("score", half).over(by_place))
    out = padded.withColumn("s", F.when(F.col("total") < 3, F.col("score")).otherwise(smooth)).where("j >= 0 and j < total")
    top = F.max("s").over(Window.partitionBy(VIDEO))
    return out.select(VIDEO, F.col("j").alias("frame_no"), F.when(top > 1e-9, F.col("s") / top).otherwise(F.col("s")).alias("parallax"))


def two_stage_sample(frames: DataFrame, targets: DataFrame, parallax: DataFrame, min_frames: int = 10) -> DataFrame:
    """``smart_sample`` with the weight times 0.3 + 0.7 parallax."""
    met = frames.join(parallax, [VIDEO, "frame_no"], "left").withColumn("parallax", F.coalesce("parallax", F.lit(0.0)))
    return smart_sample(met, targets, min_frames, 0.3 + 0.7 * F.col("parallax"))
