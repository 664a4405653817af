"""What larger tables bring, on small ones: large keys, many keypoints, many rows a key."""

import tracemalloc

import numpy as np
import pytest

from stereolith import queries
from stereolith.operators import loops, matching
from stereolith.sources import listing


def test_nearest_registered_of_large_indices(spark, tmp_path):
    ids = [*range(46_330, 46_360), *range(59_990, 60_000)]
    spark.createDataFrame([(i,) for i in ids], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r["frame_idx"]: r["nearest"] for r in queries.QUERIES["cv15_nearest_registered"](spark, str(tmp_path)).collect()}
    known = [i for i in ids if i * i % 7 == 2]
    assert got == {i: min(known, key=lambda k: (abs(k - i), k)) for i in ids}


def nearest(rows, pairs, ratio, most, away, mutual):
    """Ratio matches by all distances."""

    def one_way(p, q):
        out = {}
        for k, x in p:
            near = sorted((away(x, y), o) for o, y in q)
            if near[0][0] < most and (len(near) == 1 or near[0][0] < ratio * near[1][0]):
                out[k] = near[0]
        return out

    found = set()
    for a, b in pairs:
        p, q = ([(k, d) for f, k, d in rows if f == x] for x in (a, b))
        there, back = one_way(p, q), one_way(q, p)
        single = min((away(q[0][1], x), k) for k, x in p)[1] if len(q) == 1 else None
        for k, (d, o) in there.items():
            agreed = k == single if len(q) == 1 else not mutual or len(p) == 1 or o in back and back[o][1] == k
            if agreed:
                found.add((a, k, b, o, round(d, 9)))
    return found


def keypoints(seed=1):
    """Frames of 150, 90, 1 and 40 keypoints; frame 3 has copies of one descriptor."""
    r = np.random.default_rng(seed)
    rows = [(f, k, r.normal(0, 1, 8).astype(np.float32).tolist()) for f, n in enumerate((150, 90, 1, 40)) for k in range(n)]
    return [(f, k, rows[0][2] if f == 3 and k % 4 == 0 else d) for f, k, d in rows]


PAIRS = [(0, 1), (0, 2), (1, 2), (0, 3), (2, 1), (3, 0)]


@pytest.mark.parametrize("block", [2_048, 16])
@pytest.mark.parametrize("mutual", [False, True])
def test_matches_over_blocks_of_large_frames(spark, monkeypatch, block, mutual):
    monkeypatch.setattr(matching, "ROWS", 7)
    rows = keypoints()
    df = spark.createDataFrame(rows, "frame_idx int, kp_idx int, descr array<float>")
    pairs = spark.createDataFrame(PAIRS, "frame_a int, frame_b int")
    l2 = lambda x, y: float(((np.array(x) - np.array(y)) ** 2).sum() ** 0.5)
    got = {(r[0], r[1], r[2], r[3], round(r[4], 9)) for r in matching.match(df, pairs, 0.97, 3.0, mutual, block).collect()}
    assert got == nearest(rows, PAIRS, 0.97, 3.0, l2, mutual) and len(got) > 50


def test_no_matrix_grows_with_a_frame():
    x, y = np.random.default_rng(2).normal(0, 1, (2, matching.BLOCK, 64))
    tracemalloc.start()
    matching._nearest_two(x, y, False)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_scores_count_all_descriptors(spark):
    r = np.random.default_rng(7)
    base = r.normal(0, 1, (700, 8))
    rows = [(f, k, d.tolist()) for f in (0, 1) for k, d in enumerate(base + f * 1e-3)]
    df = spark.createDataFrame(rows, "frame_idx int, kp_idx int, descr array<double>")
    pairs = spark.createDataFrame([(0, 1)], "frame_a int, frame_b int")
    assert matching.pair_scores(df, pairs, 0.97, 1.3).first()["score"] == 700
    assert matching.pair_scores(df, pairs, 0.97, 1.3, first=500).first()["score"] == 500


def test_ply_files_are_read_in_ranges(spark, tmp_path):
    # a sparse file of over 2 GB, with one vertex at its end
    n = 150_000_000
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n".encode()
    last = np.array([(1.5, 2.5, -3.5, 1, 2, 255)], [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1")])
    with open(tmp_path / "large.ply", "wb") as f:
        f.write(head)
        f.seek(len(head) + 15 * (n - 1))
        f.write(last.tobytes())
    v = listing.read_ply(spark, f"file://{tmp_path}/large.ply")
    assert tuple(v.selectExpr("count(*)", "sum(cast(x as double))", "min(z)", "max(b)").first()) == (n, 1.5, -3.5, 255)
    cloud = spark.range(1000).selectExpr("cast(id as float) as x", "cast(id as float) as y", "cast(0 as float) as z")
    listing.write_ply(cloud, f"file://{tmp_path}/plain.ply")
    got = listing.read_ply(spark, f"file://{tmp_path}/plain.ply", rows=7)
    assert sorted(tuple(r) for r in got.collect()) == [(float(i), float(i), 0.0, None, None, None) for i in range(1000)]


def test_equal_paths_stand_in_the_order_of_their_ids(spark):
    rows = [(i * 7919 % 2000, f"https://a.example/{i % 10}") for i in range(2000)]
    df = spark.createDataFrame(rows, "page_id long, path string").repartition(13)
    got = [r["page_id"] for r in listing.natural_order(df).orderBy("frame_idx").collect()]
    assert got == [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))]


def test_the_first_pair_deals_out_its_own_frames_alone(spark, monkeypatch):
    class Seen(Exception):
        pass

    def stop(descriptors, pairs, *_):
        raise Seen(sorted({r["frame_idx"] for r in descriptors.collect()}))

    monkeypatch.setattr(loops.M, "match", stop)
    every = spark.createDataFrame([(f, k, 1.0, 2.0, [float(k), 1.0]) for f in range(40) for k in range(3)], "frame_idx int, kp_idx int, u double, v double, descr array<double>")
    pairs = spark.createDataFrame([(3, 7, 5), (7, 30, 4)], "frame_a int, frame_b int, score int")
    with pytest.raises(Seen, match=r"\[3, 7, 30\]"):
        loops.seed_metrics(pairs, every.select("frame_idx", "kp_idx", "descr"), every)
