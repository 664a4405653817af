"""Numeric kernels against geometry whose answer is known."""

import numpy as np

from stereolith.functions import images, lens, solve, twoview
from stereolith.sources import listing

K = (1000.0, 1000.0, 640.0, 360.0)


def scene(n, seed=0, planar=False):
    r = np.random.default_rng(seed)
    x = np.stack([r.uniform(-3, 3, n), r.uniform(-2, 2, n), np.full(n, 8.0) if planar else r.uniform(6, 12, n)], 1)
    return x, solve.rodrigues(np.array([0.02, 0.15, -0.03])), np.array([-1.0, 0.1, 0.2])


def pixels(x, r, t):
    c = x @ r.T + t
    return np.stack([1000 * c[:, 0] / c[:, 2] + 640, 1000 * c[:, 1] / c[:, 2] + 360], 1)


def test_two_view_with_wrong_matches():
    x, r, t = scene(200)
    a, b = pixels(x, np.eye(3), np.zeros(3)), pixels(x, r, t)
    b[:60] += np.random.default_rng(1).uniform(30, 200, (60, 2))
    kind, ok = twoview.verify(a, b, 2.0, 15, 1000, 3)
    assert kind == "F" and ok[60:].mean() > 0.95
    rel = twoview.relative_rotation(a, b, np.array([[1000, 0, 640], [0, 1000, 360], [0, 0, 1.0]]), 2.0, 1000, 3)
    assert rel is not None
    assert np.degrees(np.arccos(np.clip((np.trace(rel[0] @ r.T) - 1) / 2, -1, 1))) < 0.5
    assert rel[1] @ (t / np.linalg.norm(t)) > 0.99


def test_plane_is_a_homography():
    x, r, t = scene(200, planar=True)
    assert twoview.verify(pixels(x, np.eye(3), np.zeros(3)), pixels(x, r, t), 2.0, 15, 300, 1)[0] == "H"


def test_resection_with_wrong_rows():
    x, r, t = scene(100)
    uv = pixels(x, r, t)
    uv[:30] += 80
    got = solve.resect(x, uv, K, 4.0, 300, 1)
    assert got is not None and got[2][30:].all()
    assert np.degrees(np.arccos(np.clip((np.trace(got[0] @ r.T) - 1) / 2, -1, 1))) < 0.1
    assert np.linalg.norm(got[1] - t) < 0.01 * np.linalg.norm(t)


def test_triangulation_with_an_outlier():
    x, _, _ = scene(50)
    rs = [solve.rodrigues(np.array([0, 0.05 * i, 0])) for i in range(5)]
    ts = [np.array([-0.4 * i, 0.02 * i, 0.0]) for i in range(5)]
    uv = np.stack([pixels(x, r, t) for r, t in zip(rs, ts, strict=True)], 1)
    uv[7, 4] += 60
    first = np.arange(0, 251, 5)
    pts, ok = solve.triangulate(first, np.tile(np.array(rs), (50, 1, 1)), np.tile(np.array(ts), (50, 1)), uv.reshape(-1, 2), K, 4.0)
    assert ok.all() and np.abs(pts - x).max() < 1e-2


def test_similarity_and_reflection():
    r = np.random.default_rng(0)
    s = r.normal(size=(50, 3))
    q = solve.rodrigues(np.array([0.3, -0.2, 0.5]))
    for d, exact in ((2.5 * s @ q.T + [1, 2, 3], True), (s * [1, 1, -1], False)):
        c = (d - d.mean(0)).T @ (s - s.mean(0)) / len(s)
        scale, rot, t = solve.umeyama(50, s.mean(0), d.mean(0), float(s.var(0).sum()), c)
        assert abs(np.linalg.det(rot) - 1) < 1e-9
        if exact:
            assert abs(scale - 2.5) < 1e-9 and np.allclose(rot, q) and np.allclose(t, [1, 2, 3])
    assert solve.umeyama(2, s[0], s[0], 1.0, np.eye(3)) is None


def test_lens_round_trip():
    dist = np.array([*K, 0.02, -0.003, 0.001, -0.0005, 0.0004, -0.0001, 0.0003, 0.0002])
    uv = np.stack(np.meshgrid(np.linspace(-300, 1600, 30), np.linspace(-300, 1000, 20)), -1).reshape(-1, 2)
    assert np.abs(lens.undistort(lens.fisheye_distort(uv, K, dist), K, dist) - uv).max() < 1e-3
    other = dist.copy()
    other[0] = 900
    assert (lens.undistort(uv, K, other) == uv).all()


def test_images():
    flat, board = np.full((40, 40), 7.0), np.indices((40, 40)).sum(0) % 2 * 255.0
    assert images.laplacian_variance(flat) == 0 and images.laplacian_variance(board) > 1e5
    assert np.allclose(images.shrink(np.full((960, 1280), 3.0)), 3.0) and images.shrink(np.zeros((960, 1280))).shape == (360, 480)
    bgr = np.zeros((4, 5, 3), np.uint8)
    bgr[3, 4] = (1, 2, 3)
    assert images.colors_at(bgr, np.array([9.0]), np.array([2.5 + 0.6])).tolist() == [[3, 2, 1]]


def test_ply(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 255, 0, 7)], "x double, y double, z double, r int, g int, b int")
    head, body = listing.ply_parts(df)
    assert head.startswith(b"ply\nformat binary_little_endian 1.0\nelement vertex 1\n") and head.endswith(b"end_header\n")
    assert b"".join(bytes(r["body"]) for r in body.collect()) == np.array([1, 2, 3], "<f4").tobytes() + bytes([255, 0, 7])
    assert sum(len(r["body"]) for r in listing.ply_parts(df.select("x", "y", "z"))[1].collect()) == 12


def test_list_images(spark, tmp_path):
    for name in ("b2.JPG", "b10.jpg", "1a.png", "x.txt"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "c.jpg").write_bytes(b"x")
    rows = [r["path"].rsplit("/", 1)[1] for r in listing.list_images(spark, str(tmp_path)).orderBy("frame_idx").collect()]
    assert rows == ["1a.png", "b2.JPG", "b10.jpg"]


def test_suppress_near_is_strict(spark):
    from stereolith.operators.retrieval import suppress_near

    df = spark.createDataFrame([(1, 10, 0.9), (1, 12, 0.8), (1, 15, 0.75), (1, 16, 0.7)], "frame_a int, frame_b int, score double")
    assert sorted(r["frame_b"] for r in suppress_near(df, 5, 3).collect()) == [10, 16]


def test_colors_and_sharpness(spark):
    from stereolith.operators import matching

    data = bytearray(range(60))
    frames = spark.createDataFrame([(0, 4, 5, 3, data)], "frame_idx int, height int, width int, nChannels int, data binary")
    kps = spark.createDataFrame([(0, 1, 1.2, 0.0)], "frame_idx int, kp_idx int, u double, v double")
    assert [tuple(r) for r in matching.sample_colors(kps, frames).collect()] == [(0, 1, 5, 4, 3)]
    assert matching.sharpness(frames).first()["sharpness"] >= 0


def test_partitioning_does_not_matter(spark):
    from stereolith.plans import match_queries as m

    one = sorted(map(str, m.ma9_verify_pairs(spark, "/root/testdata/sf0.001").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sorted(map(str, m.ma9_verify_pairs(spark, "/root/testdata/sf0.001").collect())) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
