from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.operators import treemap


def overlap(a, b):
    return max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))


def test_the_classic_example():
    tiles = treemap.layout([6, 6, 4, 3, 2, 2, 1], 600, 400)
    assert abs(sum(w * h for _, _, w, h in tiles) - 600 * 400) < 1e-6
    assert all(overlap(a, b) < 1e-6 for k, a in enumerate(tiles) for b in tiles[:k])
    assert abs(tiles[0][2] * tiles[0][3] / (tiles[6][2] * tiles[6][3]) - 6) < 1e-9


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 10**9), min_size=1, max_size=30))
def test_areas_follow_sizes(sizes):
    sizes.sort(reverse=True)
    tiles = treemap.layout(sizes)
    scale = treemap.WIDTH * treemap.HEIGHT / sum(sizes)
    assert all(abs(w * h - s * scale) <= 1e-6 * s * scale + 1e-9 for s, (_, _, w, h) in zip(sizes, tiles))
    assert all(x >= -1e-6 and y >= -1e-6 and x + w <= treemap.WIDTH + 1e-6 and y + h <= treemap.HEIGHT + 1e-6 for x, y, w, h in tiles)


def test_layout_of_nothing_and_per_root(spark):
    assert treemap.layout([]) == [] and treemap.layout([0, 0]) == []
    rows = spark.createDataFrame([("r1", "a", 5), ("r1", "b", 5), ("r2", "c", 1), ("r2", "d", 0), ("r3", "e", 0)], "root string, path string, size long")
    got = treemap.treemap(rows).groupBy("root").agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("h")).alias("area")).collect()
    assert {(r.root, r.n, round(r.area)) for r in got} == {("r1", 2, 240_000), ("r2", 1, 240_000)}
