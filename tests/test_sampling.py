"""Stratified choice of frames where running weights end on a mark."""

from stereolith.operators import sampling as S

# weights of a bin, each for a run of frames: a frame's running weight is half of the total
RUNS = [(142.8, 30), (80.15, 60), (91.23800000000001, 60), (273.681, 60), (153.15300000000002, 60), (133.239, 60), (8.638, 60), (358.35999999999996, 60), (223.295, 60), (16.946, 45)]


def test_a_weight_that_reaches_half_of_the_total_takes_its_frame(spark):
    w = [x for x, n in RUNS for _ in range(n)]
    total = sum(round(1000 * x) for x in w)
    want = next(i for i in range(len(w)) if 2 * sum(round(1000 * x) for x in w[: i + 1]) >= total)
    assert 2 * sum(round(1000 * x) for x in w[: want + 1]) == total
    # the same bin in other units, and one whose frames cannot be told from nothing
    rows = [(v, i, True, x * scale, 1) for v, scale in ((1, 1.0), (2, 1e-20), (3, 1e30)) for i, x in enumerate(w)] + [(4, i, True, 0.0, 1) for i in range(5)] + [(5, i, i > 0, 1.0 if i == 3 else 1e-300, 1) for i in range(5)]
    frames = spark.createDataFrame(rows, "video_id long, frame_no int, valid boolean, weight double, target int")
    got = {(r["video_id"], r["frame_no"]) for r in S.stratified_select(frames).collect()}
    assert got == {(1, want), (2, want), (3, want), (4, 0), (5, 3)}
