"""Binary descriptors, suppression of near frames, PLY files: values against plain versions."""

import random

import numpy as np

from stereolith.operators import matching as M
from stereolith.operators import retrieval as B
from stereolith.sources import listing as L


def descriptors(spark, n=160, frames=4):
    r = random.Random(3)
    base = [r.randbytes(32) for _ in range(40)]
    rows = []
    for i in range(n):
        d = bytearray(base[i // frames % 40])
        for _ in range(r.randint(0, 6)):
            d[r.randrange(32)] ^= 1 << r.randrange(8)
        rows.append((i % frames, i // frames, d))
    return rows, spark.createDataFrame(rows, "frame_idx int, kp_idx int, descr binary")


def differ(a, b):
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def test_matches_of_bytes(spark):
    rows, df = descriptors(spark)
    pairs = spark.createDataFrame([(0, 1), (2, 3)], "frame_a int, frame_b int")
    got = {tuple(x) for x in M.match(df, pairs, 0.8, 90.0).collect()}
    assert got == {tuple(x) for x in M.match_ratio_small(df, pairs, 0.8, 90.0).select("frame_a", "kp_a", "frame_b", "kp_b", "distance").collect()}
    want = set()
    for a, b in ((0, 1), (2, 3)):
        for i, x in [(k, d) for f, k, d in rows if f == a]:
            near = sorted((differ(x, y), k) for f, k, y in rows if f == b)
            if near[0][0] < 0.8 * near[1][0] and near[0][0] < 90:
                want.add((a, i, b, near[0][1], float(near[0][0])))
    assert got == want and got


def test_vocabulary_of_bytes(spark):
    rows, df = descriptors(spark)
    vocab = B.train_vocabulary(df, k=12)
    words = {x["word"]: bytes(x["centroid"]) for x in vocab.collect()}
    assert len(words) == 12 and {len(c) for c in words.values()} == {32}
    got = {(x["frame_idx"], x["kp_idx"]): x["word"] for x in B.assign_words(df, vocab).collect()}
    assert got == {(f, k): min(words, key=lambda w: (differ(words[w], d), w)) for f, k, d in rows}


def test_near_frames_are_suppressed_to_the_end_of_the_ranking(spark):
    r = random.Random(5)
    rows = [(a, b, round(1 - abs(b - 700) / 1000 + r.random() / 50, 3)) for a in (1, 2) for b in range(0, 3000)] + [(3, 7, 0.5), (3, 7, 0.6), (3, 8, 0.55)]
    got = sorted((x["frame_a"], x["frame_b"], x["score"]) for x in B.suppress_near(spark.createDataFrame(rows, "frame_a int, frame_b int, score double"), 600, 5).collect())
    want = []
    for a in (1, 2, 3):
        kept = []
        for _, b, s in sorted((-s, b, s) for x, b, s in rows if x == a):
            if len(kept) < 5 and all(abs(b - k) > 600 for k, _ in kept):
                kept.append((b, s))
        want += [(a, b, s) for b, s in kept]
    assert got == sorted(want)


def test_ply_file(spark, tmp_path):
    cloud = spark.range(500).selectExpr("cast(id as float) as x", "cast(id / 7 as float) as y", "cast(-id as float) as z", "cast(id % 256 as int) as r", "1 as g", "255 as b")
    at = f"file://{tmp_path}/cloud.ply"
    L.write_ply(cloud, at)
    data = (tmp_path / "cloud.ply").read_bytes()
    head, body = data.split(b"end_header\n", 1)
    assert head.startswith(b"ply\nformat binary_little_endian 1.0\nelement vertex 500\n") and len(body) == 500 * 15
    rows = np.frombuffer(body, [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1")])
    assert sorted(rows["x"].tolist()) == list(map(float, range(500))) and set(rows["b"]) == {255}
    assert sorted(map(tuple, L.read_ply(spark, at).collect())) == sorted(map(tuple, cloud.collect()))
