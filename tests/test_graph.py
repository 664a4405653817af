from stereolith.operators.graph import connected_components


def labels(spark, edges):
    return dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))


def test_chain_star_loops_and_nulls(spark):
    n = 300
    chain = [(i, i + 1) for i in range(1000, 1000 + n)]
    star = [(5000, 5001 + i) for i in range(500)]
    got = labels(spark, chain + star + [(7, 7), (None, 3), (9, 8), (8, 9)])
    assert {got[i] for i in range(1000, 1000 + n + 1)} == {1000}
    assert {got[5000 + i] for i in range(501)} == {5000}
    assert got[7] == 7 and got[9] == 8 and got[8] == 8 and 3 not in got


def test_no_edges(spark):
    assert labels(spark, []) == {}
