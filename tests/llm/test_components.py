import random

from unievents.llm.components import connected_components


def test_paths_stars_and_nulls(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(900 + k, 500) for k in range(80)] + [(3, 3), (None, 4), (7, None), (2, 1), (1, 2)]
    random.Random(1).shuffle(edges)
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    want = {k: 100 for k in range(100, 161)} | {900 + k: 500 for k in range(80)} | {500: 500, 1: 1, 2: 1}
    assert got == want


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
