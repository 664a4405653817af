"""Trees, score bounds and ranks against plain versions, and what their plans and tables hold."""

import io
from contextlib import redirect_stdout

import numpy as np
from pyspark.sql import functions as F

from stereolith.operators import dense, ranking, register, retrieval, tracks
from stereolith.operators.geometry import POSE, Camera
from stereolith.operators.refine import rodrigues
from stereolith.plans.scratch import Scratch

CAM = Camera(fx=500.0, fy=520.0, cx=320.0, cy=240.0)
SIZE = (640, 480)


def around(n_points=4000, n_frames=30, seed=2):
    """Points around cameras that look everywhere, half of them in one dense spot."""
    r = np.random.default_rng(seed)
    x = np.concatenate([r.uniform(-20, 20, (n_points // 2, 3)), np.array([7.0, 1.0, 3.0]) + r.normal(0, 0.3, (n_points - n_points // 2, 3))])
    turn = rodrigues(r.normal(0, 1.5, (n_frames, 3)))
    t = r.uniform(-3, 3, (n_frames, 3))
    return x, turn, t, r


def projected(x, turn, t):
    c = np.einsum("fij,pj->fpi", turn, x) + t[:, None, :]
    z = np.where(np.abs(c[..., 2]) < 1e-12, 1e-12, c[..., 2])
    return CAM.fx * c[..., 0] / z + CAM.cx, CAM.fy * c[..., 1] / z + CAM.cy, c[..., 2]


def test_guided_search_by_an_octree_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(tracks, "LEAF", 20)
    x, turn, t, r = around()
    u, v, z = projected(x, turn, t)
    inside = (z > 1e-6) & (u >= 0) & (u < SIZE[0]) & (v >= 0) & (v < SIZE[1])
    kps, seen = [], []
    for f in range(len(t)):
        some = np.flatnonzero(inside[f])
        some = some[r.random(len(some)) < 0.2]
        kps += [(f, k, float(u[f, p] + r.uniform(-3, 3)), float(v[f, p] + r.uniform(-3, 3))) for k, p in enumerate(some.tolist())]
        kps += [(f, 5000 + k, float(a), float(b)) for k, (a, b) in enumerate(r.uniform(-6, 650, (20, 2)))]
        seen += [(int(p), f, k) for k, p in enumerate(some.tolist()) if r.random() < 0.3]
    points = spark.createDataFrame([(p, *map(float, q)) for p, q in enumerate(x)] + [(90_000, None, None, None), (90_001, float("nan"), 0.0, 0.0)], "point_id long, x double, y double, z double")
    poses = spark.createDataFrame([(f, *map(float, turn[f].ravel()), *map(float, t[f])) for f in range(len(t))], "frame_idx int, " + ", ".join(f"{c} double" for c in POSE))
    keypoints = spark.createDataFrame(kps, "frame_idx int, kp_idx int, u double, v double")
    obs = spark.createDataFrame(seen, "point_id long, frame_idx int, kp_idx int")
    out = tracks.project_candidates(points, obs, keypoints, poses, 2.5, CAM, SIZE, max_obs=3)
    got = {(a, b, c): d for a, b, c, d in out.collect()}
    count, bound, own = np.bincount([p for p, _, _ in seen], minlength=len(x)), {(f, k) for _, f, k in seen}, {(p, f) for p, f, _ in seen}
    want = {}
    for f, k, a, b in kps:
        if (f, k) in bound:
            continue
        d = np.hypot(u[f] - a, v[f] - b)
        for p in np.flatnonzero(inside[f] & (d <= 2.5) & (count < 3)).tolist():
            if (p, f) not in own:
                want[(f, p, k)] = d[p]
    assert set(got) == set(want) and len(want) > 300 and all(abs(got[k] - d) < 1e-9 for k, d in want.items())
    with redirect_stdout(io.StringIO()) as said:
        out.explain("formatted")
    assert "CartesianProduct" not in said.getvalue() and "BroadcastNestedLoopJoin" not in said.getvalue()
    # what a frame doesn't see is left out by the tree: far fewer pairs meet than points times frames
    leaves, alive = tracks.visible_leaves(points.where("x is not null and not isnan(x)"), poses, Scratch(spark, "test"), CAM, SIZE, 20)
    assert leaves.count() == len(x)
    met = alive.join(leaves, "leaf")
    assert inside.sum() <= met.count() < 0.35 * len(x) * len(t)
    assert leaves.groupBy("leaf").count().agg(F.max("count")).first()[0] < 200
    assert tracks.project_candidates(points.where("false"), obs, keypoints, poses, 2.5, CAM, SIZE).count() == 0
    assert tracks.project_candidates(points, obs, keypoints.where("false"), poses, 2.5, CAM, SIZE).count() == 0


def test_similarity_by_score_bounds_against_all_pairs(spark):
    r = np.random.default_rng(1)
    h = {f: {int(w): float(v) for w, v in zip(r.choice(30, 6, replace=False) + 30 * (f // 40 % 4), r.random(6), strict=True)} for f in range(0, 400, 2)}
    df = spark.createDataFrame([(f, w, v) for f, x in h.items() for w, v in x.items()], "frame_idx int, word int, w double")
    norm = {f: sum(v * v for v in x.values()) ** 0.5 for f, x in h.items()}
    score = {(a, b): sum(v * h[b].get(w, 0) for w, v in h[a].items()) / norm[a] / norm[b] for a in h for b in h if abs(a - b) >= 5}
    for least, block in ((0.6, 16), (0.0, 64), (0.9, 1)):
        got = {(a, b): s for a, b, s in retrieval.similarity(df, df, 5, least, block).collect()}
        want = {k: s for k, s in score.items() if s >= least and s > 0}
        assert set(got) == set(want) and all(abs(got[k] - s) < 1e-12 for k, s in want.items())
    few = retrieval.similarity(df.where("frame_idx = 10"), df, 5, 0.1)
    assert {r["frame_a"] for r in few.collect()} == {10}
    assert retrieval.similarity(df.where("false"), df, 5, 0.1).count() == 0


def test_blocks_join_far_fewer_rows_than_frames(spark):
    from stereolith.plans.graph_queries import histograms

    h = histograms(spark, "/root/testdata/sf0.01")
    frames = h.groupBy("word").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0]
    blocks = h.groupBy("word").agg(F.countDistinct(F.floor(F.col("frame_idx") / retrieval.BLOCK)).alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0]
    assert 100 * blocks < frames


def test_ranks_over_range_partitions(spark):
    r = np.random.default_rng(0)
    rows = [(int(k), ["a", None, "b"][k % 3] if k % 5 else "a", float(r.integers(0, 50))) for k in range(2000)]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(7)
    got = ranking.ranked(df, [F.desc("v"), F.col("id")], Scratch(spark, "test"), by="g", count="n").collect()
    for g in ("a", "b", None):
        own = sorted((x for x in rows if x[1] == g), key=lambda x: (-x[2], x[0]))
        assert sorted((x["idx"], x["id"]) for x in got if x["g"] == g) == list(enumerate(x[0] for x in own))
        assert {x["n"] for x in got if x["g"] == g} == {len(own)}
    whole = ranking.ranked(df, [F.col("id")], Scratch(spark, "test")).collect()
    assert sorted((x["idx"], x["id"]) for x in whole) == [(k, k) for k in range(2000)]


def test_morton_codes_interleave():
    ranks = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1], [3, 0, 0], [2**21 - 1] * 3])
    assert dense.morton(ranks).tolist() == [0, 1, 2, 4, 9, 2**63 - 1]


def test_chains_by_a_prefix_scan_equal_the_fold(spark):
    r = np.random.default_rng(4)
    turn, way = rodrigues(r.normal(0, 0.3, (700, 3))), r.normal(0, 1, (700, 3))
    rows, want = [], {}
    # a long chain, one with a gap, a short one, and edges before the start
    for seq, frames in (("long", range(400)), ("gap", [*range(10), *range(12, 30)]), ("short", range(2)), ("late", range(-5, 9))):
        frames = list(frames)
        a, p, at = turn[0], way[0], max(frames[0], 0)
        want[seq, at] = (a, p)
        for k, (x, y) in enumerate(zip(frames, frames[1:], strict=False)):
            if y - x == 1:
                m, t = turn[k + 1], way[k + 1]
                rows.append((seq, x, y, *map(float, m.ravel()), *map(float, t)))
                if x == at:
                    a, p, at = m @ a, m @ p + t, y
                    want[seq, at] = (a, p)
    rows.append(("long", 7, 99, *[0.0] * 12))
    edges = spark.createDataFrame(rows, "seq_id string, frame_a int, frame_b int, " + ", ".join(f"{c} double" for c in POSE)).repartition(5)
    start = spark.createDataFrame([(s, 0, *map(float, turn[0].ravel()), *map(float, way[0])) for s in ("long", "gap", "short", "late", "none")], "seq_id string, frame_idx int, " + ", ".join(f"{c} double" for c in POSE))
    want["none", 0] = (turn[0], way[0])
    for block in (4096, 7, 3):
        got = {(x["seq_id"], x["frame_idx"]): np.array([x[c] for c in POSE]) for x in register.chain_two_view_pose(edges, start, block).collect()}
        assert set(got) == set(want)
        assert max(np.abs(got[k] - np.concatenate([a.ravel(), t])).max() for k, (a, t) in want.items()) < 1e-6


def test_no_window_holds_a_whole_table():
    import pathlib
    import re

    for p in pathlib.Path(ranking.__file__).parents[1].glob("*/*.py"):
        if p.parent.name in ("operators", "sources", "functions"):
            assert not re.search(r"Window\.orderBy|W\.orderBy", p.read_text()), p


def test_marks_carry_over_partitions(spark):
    rows = [(k, k % 37 == 5 or k in (200, 201)) for k in range(400)]
    df = spark.createDataFrame(rows, "frame_idx int, m boolean").repartition(6)
    on = np.array([k for k, m in rows if m])
    for x in ranking.nearest_marked(df, "frame_idx", F.col("m"), Scratch(spark, "test")).collect():
        assert x["low"] == max(on[on <= x["frame_idx"]], default=None) and x["high"] == min(on[on >= x["frame_idx"]], default=None)
    assert ranking.with_previous(df, "frame_idx", ["m"], Scratch(spark, "test")).where("previous_m is null").count() == 1


def test_outliers_keep_points_whose_coordinates_end_in_other_bits_when_worked_out_anew(spark):
    def jittered(batches):
        for rows in batches:
            yield rows.assign(**{c: rows[c] * (1 + np.random.default_rng().uniform(-1, 1, len(rows)) * 1e-15) for c in "xyz"})

    r = np.random.default_rng(4)
    rows = [(i, *map(float, p)) for i, p in enumerate(r.uniform(1, 9, (1500, 3)))]
    cloud = spark.createDataFrame(rows, "uid long, x double, y double, z double").mapInPandas(jittered, "uid long, x double, y double, z double")
    got = {x["uid"] for x in dense.statistical_outliers(cloud, 8, 50.0).collect()}
    assert got == set(range(1500))
    assert len(dense.knn_mean_distance(cloud, 8).collect()) == 1500
