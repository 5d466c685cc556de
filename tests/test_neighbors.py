import numpy as np
import pytest
from conftest import brute_force
from pyspark.sql import functions as F

from counterpoise.operators import neighbors
from counterpoise.operators.neighbors import knn_join


def frame(spark, points, keys=None, parts=5):
    keys = list(range(len(points))) if keys is None else keys
    kind = "string" if isinstance(keys[0], str) else "bigint"
    cols = ", ".join(f"x{i} double" for i in range(len(points[0])))
    rows = [(key, *map(float, p)) for key, p in zip(keys, points)]
    return spark.createDataFrame(rows, f"id {kind}, {cols}").repartition(parts)


def names(points):
    return [f"x{i}" for i in range(len(points[0]))]


def collected(found):
    out = {}
    for row in sorted(found.collect(), key=lambda r: (str(r["qid"]), r["rank"])):
        out.setdefault(row["qid"], []).append((row["nid"], row["dist"]))
        assert row["rank"] == len(out[row["qid"]])
    return out


def expected(points, k, metric="euclidean", keys=None):
    keys = list(range(len(points))) if keys is None else keys
    rows = list(zip(keys, points))
    return brute_force(rows, rows, k, metric)


def run(df, points, k, **options):
    return collected(knn_join(df, df, k=k, key="id", features=names(points), **options))


@pytest.fixture
def small_limits(spark, monkeypatch):
    """Make every size bound bite on small data, and join by shuffle only."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(neighbors, "CELL_ROWS", 40)
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbors, "QUERY_BLOCK_ROWS", 8)
    monkeypatch.setattr(neighbors, "ROUTE_ROWS", 50)
    monkeypatch.setattr(neighbors, "SENT_ROWS", 70)
    monkeypatch.setattr(neighbors, "BROADCAST_BYTES", 0)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("strategy", ["broadcast", "cells"])
@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_strategies_match_brute_force(spark, strategy, metric):
    points = np.random.default_rng(0).normal(size=(250, 2)).round(1)
    df = frame(spark, points)
    assert run(df, points, 4, metric=metric, strategy=strategy) == expected(points, 4, metric)


@pytest.mark.parametrize("k", [1, 6])
def test_cells_with_shuffled_blocks(spark, small_limits, k):
    points = np.random.default_rng(1).normal(size=(400, 2)).round(1)
    df = frame(spark, points)
    found = knn_join(df, df, k=k, key="id", features=names(points), strategy="cells")
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert collected(found) == expected(points, k)


def test_wide_vectors_use_a_grid(spark, small_limits):
    points = np.random.default_rng(2).normal(size=(200, 12))
    df = frame(spark, points)
    found = knn_join(df, df, k=3, key="id", features=names(points), strategy="cells")
    assert "salt" in found._jdf.queryExecution().optimizedPlan().toString()
    assert collected(found) == expected(points, 3)


def test_hot_point_holds_a_third_of_all_rows(spark, small_limits):
    rng = np.random.default_rng(3)
    points = np.concatenate([np.tile([[1.0, 1.0]], (200, 1)), rng.normal(size=(400, 2)).round(1)])
    rng.shuffle(points)
    assert run(frame(spark, points), points, 3, strategy="cells") == expected(points, 3)
    assert run(frame(spark, points), points, 3, strategy="cells", metric="manhattan") == expected(
        points, 3, "manhattan")


def test_dense_spot_holds_a_third_of_all_rows(spark, small_limits):
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(size=(200, 2)) * 1e-6, rng.normal(size=(400, 2))])
    assert run(frame(spark, points), points, 2, strategy="cells") == expected(points, 2)


def test_result_does_not_depend_on_partitions(spark):
    points = np.random.default_rng(5).normal(size=(150, 2)).round(1)
    results = [run(frame(spark, points, parts=p), points, 3, strategy=s)
               for p in (1, 7) for s in ("broadcast", "cells")]
    assert all(r == results[0] for r in results)


def test_string_keys_break_ties_in_byte_order(spark):
    points = np.array([[0.0], [1.0], [-1.0], [1.0], [2.0]])
    keys = ["q", "é", "Z", "a", "b"]
    for strategy in ("broadcast", "cells"):
        got = run(frame(spark, points, keys), points, 2, strategy=strategy)
        assert got == expected(points, 2, keys=keys)
        assert [n for n, _ in got["q"]] == ["Z", "a"]


def test_copies_are_no_neighbours_and_few_candidates_are_fine(spark):
    points = np.array([[0.0, 0.0], [0.0, 0.0], [3.0, 4.0]])
    for strategy in ("broadcast", "cells"):
        got = run(frame(spark, points), points, 5, strategy=strategy)
        assert got == {0: [(2, 5.0)], 1: [(2, 5.0)], 2: [(0, 5.0), (1, 5.0)]}
        got = run(frame(spark, points), points, 5, strategy=strategy, metric="manhattan")
        assert got[0] == [(2, 7.0)]


def test_single_row_and_no_rows(spark):
    one = frame(spark, [[1.0]])
    for strategy in ("broadcast", "cells"):
        assert run(one, [[1.0]], 2, strategy=strategy) == {}
        none = one.where("id < 0")
        assert knn_join(one, none, k=1, key="id", features=["x0"], strategy=strategy).count() == 0
        assert knn_join(none, one, k=1, key="id", features=["x0"], strategy=strategy).count() == 0


def test_nan_and_missing_rows_take_no_part(spark):
    rows = [(0, 0.0), (1, 1.0), (2, float("nan")), (3, None), (4, 5.0)]
    df = spark.createDataFrame(rows, "id bigint, x0 double")
    for strategy in ("broadcast", "cells"):
        got = run(df, [[0.0]], 2, strategy=strategy)
        assert got == {0: [(1, 1.0), (4, 5.0)], 1: [(0, 1.0), (4, 4.0)], 4: [(1, 4.0), (0, 5.0)]}


def test_carried_columns_and_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], "a"), (2, [3.0, 4.0], "b")],
                               "id bigint, v array<float>, name string")
    for strategy in ("broadcast", "cells"):
        found = knn_join(df, df, k=1, key="id", features="v", query_columns=["name"],
                         candidate_columns=["name"], vectors=True, strategy=strategy)
        row = found.where("qid = 1").first()
        assert (row["q_name"], row["n_name"]) == ("a", "b")
        assert (row["qvec"], row["nvec"]) == ([0.0, 0.0], [3.0, 4.0])


def test_wrong_arguments(spark):
    df = frame(spark, [[1.0]])
    with pytest.raises(ValueError):
        knn_join(df, df, k=0, key="id", features=["x0"])
    with pytest.raises(ValueError):
        knn_join(df, df, k=1, key="id", features=["x0"], metric="cosine")
    with pytest.raises(ValueError):
        knn_join(df, df, k=1, key="id", features=["x0"], strategy="magic")


def test_broadcast_is_refused_beyond_its_bound(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BROADCAST_BYTES", 100)
    points = np.random.default_rng(6).normal(size=(30, 1))
    df = frame(spark, points)
    with pytest.raises(ValueError):
        knn_join(df, df, k=1, key="id", features=["x0"], strategy="broadcast")
    assert run(df, points, 2) == expected(points, 2)


def test_k_1_agrees_with_the_smallest_distance(spark):
    points = np.random.default_rng(7).normal(size=(120, 3))
    df = frame(spark, points)
    found = knn_join(df, df, k=1, key="id", features=names(points), strategy="cells")
    assert found.count() == found.select("qid").distinct().count() == 120
    assert found.agg(F.min("dist")).first()[0] > 0


SIGNED_ZEROS = np.array([[0.0, 1.0], [-0.0, 1.0], [3.0, 5.0], [-0.0, -0.0], [0.0, 0.0]])


def test_signed_zeros_are_one_point(spark):
    got = run(frame(spark, SIGNED_ZEROS), SIGNED_ZEROS, 4, strategy="broadcast")
    assert got == expected(SIGNED_ZEROS, 4)


def test_signed_zeros_in_cells(spark, small_limits):
    got = run(frame(spark, SIGNED_ZEROS), SIGNED_ZEROS, 4, strategy="cells")
    assert got == expected(SIGNED_ZEROS, 4)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_broadcast_candidates_laid_out_in_cells(spark, monkeypatch, metric):
    monkeypatch.setattr(neighbors, "CELL_ROWS", 40)
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.normal(size=(500, 2)).round(1), np.ones((100, 2))])
    keys = [f"k{i}" for i in rng.permutation(600)]
    got = run(frame(spark, points, keys), points, 3, metric=metric, strategy="broadcast")
    assert got == expected(points, 3, metric, keys)


@pytest.mark.parametrize("strategy", ["broadcast", "cells"])
@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_distances_that_round_to_zero_crowd_nobody_out(spark, strategy, metric):
    points = [(0, 0.0), (1, 1e-60), (2, 2e-60), (3, 1.0)]
    points += [(10 + k, 5.0 + k * 1e-50) for k in range(6)] + [(30, 5.5), (31, 6.0)]
    df = spark.createDataFrame(points, "id long, x double")
    for k in (1, 3):
        found = knn_join(df, df, k=k, key="id", features=["x"], metric=metric, strategy=strategy)
        got = {}
        for r in found.orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append((r["nid"], r["dist"]))
        pairs = [(i, [x]) for i, x in points]
        assert got == brute_force(pairs, pairs, k, metric)


def counted(spark, points, k, **options):
    """The neighbours found, and the share of all pairs that was looked at."""
    seen = spark.sparkContext.accumulator(0)
    got = run(frame(spark, points), points, k, strategy="cells", compared=seen, **options)
    return got, seen.value / len(points) ** 2


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("k", [1, 4])
def test_pivots_leave_out_most_pairs_of_wide_clusters(spark, monkeypatch, metric, k):
    monkeypatch.setattr(neighbors, "CELL_ROWS", 30)
    monkeypatch.setattr(neighbors, "PIVOT_ROWS", 16)
    monkeypatch.setattr(neighbors, "QUERY_BLOCK_ROWS", 16)
    rng = np.random.default_rng(11)
    centre = rng.normal(size=(12, 20)) * 10
    points = np.repeat(centre, 40, axis=0) + rng.normal(size=(480, 20)) * 0.5
    points[::37] = points[5]  # copies
    points[3, 4] = np.inf
    got, share = counted(spark, points, k, metric=metric)
    assert got == expected(points, k, metric)
    assert share < 0.5


@pytest.mark.parametrize("points", [
    np.zeros((30, 10)), np.full((5, 9), np.inf), np.eye(12), np.arange(12.0)[None] * 1e300,
    np.repeat(np.random.default_rng(3).normal(size=(50, 9)), 3, axis=0)])
def test_odd_wide_points(spark, points):
    assert run(frame(spark, points), points, 3, strategy="cells") == expected(points, 3)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_cells_inside_cells(spark, monkeypatch, metric):
    rng = np.random.default_rng(12)
    points = np.concatenate([rng.normal(size=(900, 2)), rng.normal(size=(300, 2)) * 0.01 + 3,
                             np.full((100, 2), 7.0)]).round(4)
    monkeypatch.setattr(neighbors, "CELL_ROWS", 40)
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 100_000)
    monkeypatch.setattr(neighbors, "MAX_CELLS", 2)
    got, finer = counted(spark, points, 3, metric=metric)
    assert got == expected(points, 3, metric)
    monkeypatch.setattr(neighbors, "_finer_cells", lambda housed, k, metric: spark.createDataFrame(
        [], "cell long, grid binary"))
    got, coarse = counted(spark, points, 3, metric=metric)
    assert got == expected(points, 3, metric)
    assert finer < coarse / 4  # each row meets its finer cells, not its whole cell


@pytest.mark.parametrize("width", [2, 11])
def test_a_stored_index_serves_many_joins(spark, monkeypatch, tmp_path, width):
    monkeypatch.setattr(neighbors, "CELL_ROWS", 40)
    monkeypatch.setattr(neighbors, "MAX_CELLS", 4)
    rng = np.random.default_rng(13)
    points = rng.normal(size=(400, width)).round(1)
    points[:60] = points[0]
    path = str(tmp_path / "candidates")
    frame(spark, points).withColumn("tag", F.col("id") * 2).write.parquet(path)
    table = spark.read.parquet(path)
    made = neighbors.knn_index(table, k=5, key="id", features=names(points), candidate_columns=["tag"])
    index = made.write(str(tmp_path / "index"))
    for k in (1, 5):
        found = knn_join(frame(spark, points), index, k=k, key="id", features=names(points))
        assert path not in found._jdf.queryExecution().optimizedPlan().toString()
        assert all(r["n_tag"] == 2 * r["nid"] for r in found.collect())
        assert collected(found) == expected(points, k)
    with pytest.raises(ValueError):
        knn_join(table, index, k=6, key="id", features=names(points))
    with pytest.raises(ValueError):
        knn_join(table, index, k=1, key="id", features=names(points), metric="manhattan")
    with pytest.raises(ValueError):
        neighbors.knn_index(table.where("id < 0"), k=1, key="id", features=names(points))


def test_copies_of_wide_points_do_not_follow_the_shuffle_partitions(spark):
    points = np.random.default_rng(5).normal(size=(600, 12))
    slots = spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    try:
        index = neighbors.knn_index(frame(spark, points), k=2, key="id", features=names(points))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # a query is copied once per cell, a candidate once per salt
    cells = len(np.unique(index.cells.cell))
    assert cells * index.salts >= neighbors.TASKS_PER_SLOT * slots
    assert cells + index.salts <= 2 * neighbors.TASKS_PER_SLOT * slots // 3 + 2
    found = knn_join(frame(spark, points), index, k=2, key="id", features=names(points))
    assert collected(found) == expected(points, 2)
