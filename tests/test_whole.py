"""Queries over whole tables, on the tables of 100 frames (the smallest tables hold 10 only)."""

from collections import Counter

import numpy as np
import pytest
from oracle import connect, same

from stereolith import queries
from stereolith.sources.fixtures import table as t

SF = "/root/testdata/sf0.01"


def joined(pairs):
    """Smallest member of the component of each end of ``pairs``."""
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {x: top(x) for x in up}


def test_tracks_of_all_frames(spark):
    m = t(spark, SF, "fx_matches").select("frame_a", "kp_a", "frame_b", "kp_b").collect()
    comp = joined([((r[0] << 32) + r[1], (r[2] << 32) + r[3]) for r in m])
    twice = {c for (c, _), n in Counter((c, x >> 32) for x, c in comp.items()).items() if n > 1}
    want = sorted((c, x >> 32, x & (1 << 32) - 1) for x, c in comp.items() if c not in twice)
    got = sorted(tuple(r[n] for n in ("point_id", "frame_idx", "kp_idx")) for r in queries.QUERIES["tr1_build_tracks"](spark, SF).collect())
    assert got == want and max(r[1] for r in got) > 12


def test_blocks_of_all_edges(spark):
    edges = queries.QUERIES["cv1_covisibility"](spark, SF).where("n >= 8").collect()
    comp = joined([(r["frame_a"], r["frame_b"]) for r in edges])
    size = Counter(comp.values())
    got = {r["frame_idx"]: (r["component"], r["size"]) for r in queries.QUERIES["cv8_anomaly_blocks"](spark, SF).collect()}
    assert got == {x: (c, size[c]) for x, c in comp.items()}


@pytest.mark.parametrize("name", ["tr1_build_tracks", "tr17_representative_descriptor", "cv5_cull_keyframes", "cv8_anomaly_blocks", "cv9_pose_outliers", "cv10_rotation_edges", "tr10_project_candidates"])
def test_twin_over_all_frames(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.count()
    same(df, queries.SQL[name], connect(SF))


def test_next_frames_go_by_the_seeds_where_none_is_near(spark):
    from stereolith.operators.covis import next_frames

    frames = lambda *ids: spark.createDataFrame([(i,) for i in ids], "frame_idx int")
    seen = spark.createDataFrame([(41, 10.0, 10.0), (42, 10.0, 10.0), (42, 900.0, 500.0)], "frame_idx int, u double, v double")
    order = lambda reg, **k: [(r["frame_idx"], r["score"]) for r in next_frames(frames(41, 42, 70, 95), reg, seen, 1280, 720, **k).orderBy("rank").collect()]
    near = order(frames(40), seeds=(60, 90))
    assert [x[0] for x in near] == [42, 41] and near == order(frames(40))
    assert order(frames(1), seeds=(60, 90)) == [(95, 0), (70, 0), (42, 0), (41, 0)]
    assert order(frames(1)) == []


def test_descriptors_of_bytes_stand_for_points(spark):
    from stereolith.operators.tracks import representative_descriptor

    byte = lambda *ones: bytearray(ones + (0,) * (32 - len(ones)))
    rows = [(7, f, 100 + f, byte(d)) for f, d in enumerate([0, 1, 3, 3, 255, 255, 255])] + [(8, 0, 5, byte(1))]
    got = representative_descriptor(spark.createDataFrame(rows, "point_id long, frame_idx int, kp_idx long, descr binary"), 5.0)
    assert sorted(map(tuple, got.collect())) == [(7, 104), (8, 5)]


def test_free_keypoints_of_all_frames(spark):
    rows = queries.QUERIES["tr10_assign_candidates"](spark, SF).collect()
    offers = sorted(queries.QUERIES["tr10_project_candidates"](spark, SF).collect(), key=lambda r: (r["frame_idx"], r["point_id"], r["distance"], r["kp_idx"]))
    points, kps, want = set(), set(), []
    for r in offers:
        f = r["frame_idx"]
        if (f, r["point_id"]) not in points and (f, r["kp_idx"]) not in kps:
            points.add((f, r["point_id"]))
            kps.add((f, r["kp_idx"]))
            want.append((f, r["point_id"], r["kp_idx"]))
    assert any(r["frame_idx"] % 10 for r in rows)
    assert sorted((r["frame_idx"], r["point_id"], r["kp_idx"]) for r in rows) == sorted(want)


def test_neighbours_of_lost_frames(spark):
    from stereolith.operators import register as X

    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    posed = make([(i,) for i in range(8)], "frame_idx int")
    lost = make([(10,), (11,)], "frame_idx int")
    covis = make([(1, 10, 5), (2, 10, 9), (3, 10, 9), (10, 11, 50), (4, 5, 70)], "frame_a int, frame_b int, n long")
    similar = make([(10, 6, 0.5), (11, 0, 0.4), (11, 1, 0.05)], "frame_a int, frame_b int, score double")
    near = X.choose_neighbours(lost, covis, posed, similar, most=2)
    assert sorted(map(tuple, near.collect())) == [(10, 2), (10, 3), (10, 6), (11, 0), (11, 6), (11, 7)]
    # frame 10 meets three points by way of its neighbour 2; frame 11 none by its own, but two by way of frame 5
    obs = make([(100 + k, 2, k) for k in range(3)] + [(200 + k, 5, k) for k in range(2)], "point_id long, frame_idx int, kp_idx long")
    points = make([(100 + k, 1.0, 2.0, 3.0) for k in range(3)] + [(200 + k, 1.0, 2.0, 3.0) for k in range(2)], "point_id long, x double, y double, z double")
    matches = make([(2, k, 10, 20 + k) for k in range(3)] + [(5, k, 11, 30 + k) for k in range(2)] + [(5, 0, 10, 29)], "frame_a int, kp_a long, frame_b int, kp_b long")
    kps = make([(10, 20 + k, 0.0, 0.0) for k in range(10)] + [(11, 30 + k, 0.0, 0.0) for k in range(2)], "frame_idx int, kp_idx long, u double, v double")
    found = lambda df: sorted((r["frame_idx"], r["kp_idx"], r["point_id"]) for r in df.collect())
    ten, eleven = [(10, 20 + k, 100 + k) for k in range(3)], [(11, 30 + k, 200 + k) for k in range(2)]
    assert found(X.neighbour_correspondences(matches, obs, points, lost, kps, near, posed, enough=3)) == ten + eleven
    # under ``enough`` frame 10 takes the last frames too, as these give it one more
    assert found(X.neighbour_correspondences(matches, obs, points, lost, kps, near, posed, enough=4)) == ten + [(10, 29, 200)] + eleven
    assert found(X.neighbour_correspondences(matches, obs, points, lost, kps, near, posed, enough=3, last=2)) == ten


def test_merged_points_of_one_place(spark):
    from stereolith.operators import tracks as K

    poses = t(spark, SF, "fx_poses").where("frame_idx in (40, 50, 60)")
    p = spark.createDataFrame([(1, 0.0, 0.0, 12.0), (2, 0.001, 0.0, 12.0), (3, 1.0, 1.0, 12.0), (4, 1.05, 1.0, 12.0), (5, -1.0, 0.0, 12.0)], "point_id long, x double, y double, z double")
    from stereolith.operators.geometry import in_camera

    x, y, z = in_camera()
    who = spark.createDataFrame([(1, 40), (1, 50), (2, 60), (3, 40), (4, 50), (4, 60), (5, 40)], "point_id long, frame_idx int")
    obs = who.join(p, "point_id").join(poses, "frame_idx").select("point_id", "frame_idx", "point_id", (1000 * x / z + 640).alias("u"), (1000 * y / z + 360).alias("v"))
    obs = obs.toDF("point_id", "frame_idx", "kp_idx", "u", "v")
    got = {r["point_id"]: (r["into"], round(r["x"], 6)) for r in K.merge_points(p, obs, poses, 0.06).collect()}
    # 1 and 2 are one place; the mean of 3 and 4 lies over 1 pixel off in all frames, so at a tight limit they stay apart
    assert got[1] == got[2] == (1, round(0.001 / 3, 6)) and got[5] == (5, -1.0) and got[3] == got[4] == (4, round((1.0 + 2 * 1.05) / 3, 6))
    tight = {r["point_id"]: (r["into"], round(r["x"], 6)) for r in K.merge_points(p, obs, poses, 0.06, pixels=0.5).collect()}
    assert tight[3] == (3, 1.0) and tight[4] == (4, 1.05) and tight[1] == tight[2] == got[1]


def brute_knn(p, k):
    d = np.sqrt(((p[:, None, :] - p[None, :, :]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return np.sort(d, 1)[:, :k].mean(1)


def test_knn_with_hot_places_and_far_outliers(spark, monkeypatch):
    from stereolith.operators import dense

    monkeypatch.setattr(dense, "LEAF", 100)
    monkeypatch.setattr(dense, "FAN", 3)
    monkeypatch.setattr(dense, "ASKED", 40)
    r = np.random.default_rng(5)
    cloud = [r.uniform(0, 1, (900, 3)), r.normal(0.5, 1e-4, (700, 3)), np.repeat([[0.2, 0.2, 0.2]], 300, 0), np.repeat([[0.8, 0.1, -0.0]], 4, 0), [[1e5, 1e5, 1e5], [-3e6, 0, 0]]]
    p = np.concatenate(cloud)
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "uid long, x double, y double, z double")
    got = dict(map(tuple, dense.knn_mean_distance(df, 8).collect()))
    assert np.allclose([got[i] for i in range(len(p))], brute_knn(p, 8), rtol=1e-9, atol=1e-12)
    few = dense.knn_mean_distance(df.where("uid < 8"), 8).collect()
    assert len(few) == 8 and all(x["d"] == float("inf") for x in few)


def test_outliers_of_all_points(spark):
    at = "/root/testdata/sf0.001"
    rows = sorted({tuple(x) for x in t(spark, at, "fx_dense").select("pt_id", "src", "x", "y", "z").collect()})
    d = brute_knn(np.array([x[2:] for x in rows], float), 8)
    want = sorted((x[0], x[1], round(float(v), 5)) for x, v in zip(rows, d, strict=True) if v < d.mean() + 2 * d.std())
    got = sorted((x["pt_id"], x["src"], round(x["d"], 5)) for x in queries.QUERIES["dn5_statistical_outliers_whole"](spark, at).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], rtol=0, atol=2e-5)
