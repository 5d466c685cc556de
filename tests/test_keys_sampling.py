import math

import pytest
from pyspark.sql import functions as F

from counterpoise.functions import keys
from counterpoise.functions.distance import distance
from counterpoise.operators import sampling as S
from counterpoise.operators.classes import (
    class_counts, class_distribution, majority_rows, minority_rows, sampling_plan)


def test_row_keys_are_unique_and_stable(spark, monkeypatch):
    monkeypatch.setattr(keys, "COPIES_PER_SLICE", 7)
    rows = [("hot", 1)] * 40 + [("warm", 2)] * 7 + [("cold", None), (None, 3)]
    df = spark.createDataFrame(rows, "a string, b int")
    one = sorted(keys.with_row_key(df.repartition(3)).collect())
    two = sorted(keys.with_row_key(df.repartition(5)).collect())
    assert one == two
    assert len({r["id"] for r in one}) == len(rows)
    assert sorted((str(r["a"]), str(r["b"])) for r in one) == sorted(
        (str(a), str(b)) for a, b in rows)


def test_own_key_is_rendered_as_text(spark):
    df = keys.with_row_key(spark.range(3), "key", F.col("id"))
    assert [r["key"] for r in df.orderBy("id").collect()] == ["0", "1", "2"]


def test_copies_of_few_rows_are_dealt_to_many_tasks(spark):
    rows = spark.range(300_000).select((F.col("id") % 3).alias("a"), F.lit(None).alias("b"))
    rows = rows.unionAll(spark.createDataFrame([(7, None)] * 2 + [(8, None)] * 17, "a long, b void"))
    keyed = keys.with_row_key(rows)
    seen = keyed.groupBy("a").agg(F.count("*").alias("n"), F.count_distinct("id").alias("k"))
    assert sorted(tuple(r) for r in seen.collect()) == [
        (0, 100_000, 100_000), (1, 100_000, 100_000), (2, 100_000, 100_000), (7, 2, 2), (8, 17, 17)]
    of_task = [r["count"] for r in keyed.groupBy(F.spark_partition_id()).count().collect()]
    assert max(of_task) < 60_000


def test_uniform_draws(spark):
    df = spark.range(20_000).select(keys.hash_uniform(1, "t", "id").alias("u"))
    low, mean, high = df.agg(F.min("u"), F.avg("u"), F.max("u")).first()
    assert 0 <= low and high < 1 and abs(mean - 0.5) < 0.01


@pytest.mark.parametrize("pct, n, fraction", [
    (10, 1, 0.5), (20, 1, 1.0), (100, 1, 5.0), (250, 2, 25 / 3)])
def test_sampling_plan(spark, pct, n, fraction):
    df = spark.range(1100).select(
        "id", F.when(F.col("id") < 100, "positive").otherwise("other").alias("label"))
    plan = sampling_plan(df, "label", "positive", pct)
    assert (plan.n_pos, plan.n_neg, plan.n) == (100, 1000, n)
    assert math.isclose(plan.fraction, fraction)


def test_plan_without_minority(spark):
    with pytest.raises(ValueError):
        sampling_plan(spark.range(3).withColumn("label", F.lit("a")), "label", "b", 10)


def test_split_covers_every_row_once(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("A",)], "label string")
    assert class_counts(df, "label", "a").first() == (1, 3)
    assert minority_rows(df, "label", "a").count() == 1
    assert majority_rows(df, "label", "a").count() == 3
    assert {r["label"]: r["n"] for r in class_distribution(df, "label").collect()} == {
        "a": 1, "b": 1, "A": 1, None: 1}


def test_sample_is_partition_independent(spark):
    df = spark.range(2000)
    one = {r["id"] for r in S.sample_rows(df.repartition(2), "id", 0.3).collect()}
    two = {r["id"] for r in S.sample_rows(df.repartition(9), "id", 0.3).collect()}
    assert one == two and 500 < len(one) < 700
    assert S.sample_rows(df, "id", 1.0).count() == 2000


@pytest.mark.parametrize("mean", [1.5, 8.3, 45.7])
def test_copies_have_the_wanted_mean(spark, mean):
    df = S.replicate_rows(spark.range(4000), "id", mean)
    assert abs(df.count() / 4000 - mean) < 0.15
    first = df.groupBy("id").agg(F.min("copy").alias("lo"), F.max("copy").alias("hi"),
                                 F.count("*").alias("n"))
    assert first.where("lo <> 1 or hi <> n").count() == 0


def test_ladder():
    ladder = S.poisson_ladder(2.0)
    assert math.isclose(ladder[0], math.exp(-2)) and math.isclose(ladder[1], 3 * math.exp(-2))
    assert 1 - ladder[-1] < 1e-11


def test_choices(spark):
    rows = [(q, c, r, 100 * q + r) for q in range(5) for c in (1, 2) for r in range(1, 6)]
    df = spark.createDataFrame(rows, "qid int, copy int, rank int, nid int")
    assert {r["rank"] for r in S.choose_nearest(df, 2).collect()} == {1, 2}
    picked = S.choose_random(df, 2).collect()
    assert len(picked) == 20
    assert picked == S.choose_random(df.repartition(3), 2).orderBy(
        "qid", "copy").collect() or sorted(picked) == sorted(
        S.choose_random(df.repartition(3), 2).collect())
    assert {r["rank"] for r in picked} - {1, 2}


def test_distances(spark):
    df = spark.createDataFrame([(0.0, 0.0, 3.0, 4.0), (0.0, 0.0, 2.0, 4.0)],
                               "a double, b double, c double, d double")
    xs, ys = [F.col("a"), F.col("b")], [F.col("c"), F.col("d")]
    rows = df.select(distance(xs, ys), distance(xs, ys, "manhattan")).collect()
    assert rows[0] == (5.0, 7.0)
    assert abs(rows[1][0] - 4.472136) < 1e-6 and rows[1][1] == 6.0
    with pytest.raises(ValueError):
        distance(xs, ys[:1])
    with pytest.raises(ValueError):
        distance(xs, ys, "cosine")


def test_poisson_above_the_ladder(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("id"))
    for mean in (29.5, 30.5, 95.0):
        drawn = S.with_copies(rows, "id", mean).agg(
            F.avg("copies").alias("m"), F.var_samp("copies").alias("v")).first()
        assert abs(drawn["m"] / mean - 1) < 0.02 and abs(drawn["v"] / mean - 1) < 0.06


def test_rows_a_microsecond_apart_have_two_keys(spark):
    rows = spark.sql("""SELECT * FROM VALUES (timestamp'2024-01-01 00:00:00.000001', 1),
        (timestamp'2024-01-01 00:00:00.000002', 1), (NULL, 1), (NULL, NULL) AS t(at, x)""")
    assert keys.with_row_key(rows).select("id").distinct().count() == 4


@pytest.mark.parametrize("mean", [3_500.0, 2e6, 1e11])
def test_copies_of_any_mean(spark, mean):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("id"))
    drawn = S.with_copies(rows, "id", mean)
    got = drawn.agg(F.avg("copies").alias("m"), F.var_samp("copies").alias("v"),
                    F.skewness("copies").alias("s"), F.count_distinct("copies").alias("n")).first()
    assert abs(got["m"] / mean - 1) < 5 / math.sqrt(4000 * mean)
    assert abs(got["v"] / mean - 1) < 0.1 and abs(got["s"]) < 0.15 and got["n"] > 300
    assert drawn.repartition(7).orderBy("id").collect() == drawn.orderBy("id").collect()


def test_rejection_follows_the_distribution(spark):
    mean, n = 400.0, 200_000
    drawn = spark.range(n).select(S.poisson_rejection("id", mean, 3).alias("k"))
    got = {r["k"]: r["count"] for r in drawn.groupBy("k").count().collect()}
    chance = {k: math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(300, 501)}
    chi = sum((got.get(k, 0) - n * p) ** 2 / (n * p) for k, p in chance.items() if n * p > 20)
    freedom = sum(n * p > 20 for p in chance.values())
    assert chi < freedom + 5 * math.sqrt(2 * freedom)


def test_few_rows_with_many_copies_are_dealt_to_all_tasks(spark):
    base = spark.createDataFrame([("a", 1.0), ("b", None)], "id string, x double")
    made = S.replicate_rows(base, "id", 50_000.0)
    parts = made.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) == S.task_count(made) and max(r["count"] for r in parts) < 60_000
    each = made.groupBy("id").agg(F.min("copy").alias("lo"), F.max("copy").alias("hi"),
                                  F.count_distinct("copy").alias("n")).collect()
    assert len(each) == 2 and all(r["lo"] == 1 and r["hi"] == r["n"] > 49_000 for r in each)
