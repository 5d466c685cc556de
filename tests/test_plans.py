import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise import link_clean, oversample, oversample_then_clean
from counterpoise.operators import links as L
from counterpoise.operators import neighbors
from counterpoise.plans import oversample as O
from counterpoise.plans.clean import link_clean_report
from counterpoise.plans.files import clean_files, oversample_files
from test_spec_encode import HEADER


@pytest.fixture(scope="module")
def imbalanced(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(x), float(y), "positive" if i < 60 else "negative")
            for i, (x, y) in enumerate(rng.normal(size=(400, 2)))]
    return spark.createDataFrame(rows, "id bigint, x double, y double, label string").repartition(3)


def counts(balanced):
    return {r["origin"]: r["n"] for r in O.oversample_report(balanced).collect()}


def test_plain_oversampling(spark, imbalanced):
    made = oversample(imbalanced, "id", ["x", "y"], "label", "positive", 25).cache()
    n = counts(made)
    assert n["majority"] == 340 and n["synthetic"] == n["sampled"]
    assert abs(n["sampled"] - 340 * 0.25 / 2) < 15
    assert made.select("id").distinct().count() == made.count()
    # Majority rows are unchanged, sampled rows are rows of the minority.
    kept = made.where("origin <> 'synthetic'").select(
        F.element_at(F.split("id", ":"), 2).cast("bigint").alias("id"), "x", "y", "label")
    assert kept.exceptAll(imbalanced).count() == 0


def test_synthetic_rows_lie_between_their_parents(spark, imbalanced):
    plan = O.sampling_plan(imbalanced, "label", "positive", 250)
    rare = imbalanced.where("label = 'positive'")
    partners = O.chosen_partners(rare, "id", ["x", "y"], plan, k=5, choose="random")
    made = O.synthetic_rows(rare, "id", ["x", "y"], plan, k=5, choose="random")
    parents = partners.select(
        F.concat_ws(":", F.lit("syn"), "qid", "copy", "rank").alias("id"), "qvec", "nvec")
    rows = made.join(parents, "id").collect()
    assert len(rows) == made.count() == partners.count() > 500
    for r in rows:
        step = np.array([r["x"], r["y"]]) - np.array(r["qvec"])
        whole = np.array(r["nvec"]) - np.array(r["qvec"])
        u = step @ whole / (whole @ whole)
        assert -1e-9 <= u <= 1 + 1e-9 and np.allclose(step, u * whole)
    per_row = partners.groupBy("qid", "copy").agg(F.count_distinct("nid").alias("n"))
    assert per_row.where("n <> 2").count() == 0


@pytest.mark.parametrize("pct", [25, 250])
def test_strategies_and_partitions_agree(spark, imbalanced, pct):
    results = [
        sorted(oversample(df, "id", ["x", "y"], "label", "positive", pct, strategy=s).collect())
        for df in (imbalanced, imbalanced.repartition(7)) for s in ("broadcast", "cells")]
    assert all(r == results[0] for r in results)


def test_large_minority_is_cut_into_cells(spark, imbalanced, monkeypatch):
    whole = sorted(oversample(imbalanced, "id", ["x", "y"], "label", "positive", 25).collect())
    monkeypatch.setattr(neighbors, "BROADCAST_BYTES", 100)
    monkeypatch.setattr(neighbors, "CELL_ROWS", 20)
    cut = oversample(imbalanced, "id", ["x", "y"], "label", "positive", 25)
    assert sorted(cut.collect()) == whole


def test_array_features(spark, imbalanced):
    packed = imbalanced.select("id", F.array("x", "y").alias("v"), "label")
    one = oversample(packed, "id", "v", "label", "positive", 25).select(
        "id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), "label", "origin")
    two = oversample(imbalanced, "id", ["x", "y"], "label", "positive", 25)
    assert sorted(one.collect()) == sorted(two.collect())


def test_keyless(spark, imbalanced):
    bare = imbalanced.drop("id")
    made = O.oversample_keyless(bare, ["x", "y"], "label", "positive", 25)
    n = counts(made)
    assert n["majority"] == 340 and n["synthetic"] == n["sampled"] > 20
    again = O.oversample_keyless(bare.repartition(6), ["x", "y"], "label", "positive", 25)
    assert sorted(made.collect()) == sorted(again.collect())


def test_edge_cases(spark, imbalanced):
    with pytest.raises(ValueError, match="k is 5"):
        oversample(imbalanced, "id", ["x", "y"], "label", "positive", 600)
    with pytest.raises(ValueError, match="no row"):
        oversample(imbalanced, "id", ["x", "y"], "label", "nowhere", 25)
    with pytest.raises(ValueError):
        oversample(imbalanced, "id", ["x", "y"], "label", "positive", 25, choose="best")
    single = imbalanced.where("id = 0 or label = 'negative'")
    made = oversample(single, "id", ["x", "y"], "label", "positive", 10)
    assert counts(made).get("synthetic", 0) == 0
    assert counts(made)["majority"] == 340


LINKS = [("a", 0.0, "neg"), ("b", 1.0, "pos"), ("c", 3.0, "neg"), ("d", 10.0, "neg"),
         ("e", 11.0, "neg")]


@pytest.fixture(scope="module")
def chain(spark):
    return spark.createDataFrame(LINKS, "id string, x double, label string")


@pytest.mark.parametrize("strategy", ["broadcast", "cells"])
def test_links_by_hand(spark, chain, strategy):
    near = L.nearest_labels(chain, "id", ["x"], "label", strategy=strategy)
    assert {(r["id"], r["nid"]) for r in near.collect()} == {
        ("a", "b"), ("b", "a"), ("c", "b"), ("d", "e"), ("e", "d")}
    links = L.opposite_links(near)
    assert {r["id"] for r in links.collect()} == {"a", "b", "c"}
    assert [tuple(r) for r in L.mutual_pairs(links).collect()] == [("a", "b")]
    one = link_clean(chain, "id", ["x"], "label", strategy=strategy)
    assert {r["id"] for r in one.collect()} == {"d", "e"}
    two = link_clean(chain, "id", ["x"], "label", mode="mutual", strategy=strategy)
    assert {r["id"] for r in two.collect()} == {"c", "d", "e"}


def test_link_report(spark, chain):
    assert link_clean_report(chain, "id", ["x"], "label").first() == (5, 3, 1, 3, 2)
    assert link_clean_report(chain, "id", ["x"], "label", mode="mutual").first() == (
        5, 3, 1, 2, 3)
    with pytest.raises(ValueError):
        link_clean(chain, "id", ["x"], "label", mode="both")


def test_mutual_removes_no_more_than_one_sided(spark, imbalanced):
    links = L.opposite_links(L.nearest_labels(imbalanced, "id", ["x", "y"], "label"))
    one = {r["id"] for r in L.removed_ids(links).collect()}
    two = {r["id"] for r in L.removed_ids(links, "mutual").collect()}
    assert two < one


def test_chain(spark, imbalanced):
    made = oversample_then_clean(imbalanced, "id", ["x", "y"], "label", "positive", 25)
    before = oversample(imbalanced, "id", ["x", "y"], "label", "positive", 25)
    assert 0 < made.count() < before.count()
    assert made.join(before, "id", "left_anti").count() == 0


def test_file_jobs(spark, tmp_path):
    rng = np.random.default_rng(1)
    header, data = tmp_path / "toy.header", tmp_path / "toy.data"
    header.write_text(HEADER)
    lines = [f"{rng.random() * 10:.3f}, {rng.integers(0, 5)}, {rng.choice(['red', 'blue'])}, "
             f"{'positive' if i % 10 == 0 else 'negative'}" for i in range(200)]
    data.write_text("\n".join(lines) + "\n")
    oversample_files(spark, str(header), str(data), str(tmp_path / "out"), "positive", 50)
    out = spark.read.csv(str(tmp_path / "out"))
    n = {r["_c3"]: r["count"] for r in out.groupBy("_c3").count().collect()}
    assert n["negative"] == 180 and 50 < n["positive"] < 130
    numeric = tmp_path / "numeric.data"
    numeric.write_text("".join(f"{x},{0 if y == 'neg' else 1}\n" for _, x, y in LINKS))
    clean_files(spark, str(numeric), str(tmp_path / "clean"), 1)
    assert sorted(float(r["_c0"]) for r in spark.read.csv(str(tmp_path / "clean")).collect()) == [
        10.0, 11.0]


def test_a_local_warehouse_is_no_shared_folder(spark):
    from types import SimpleNamespace

    from counterpoise.materialize import shared_folder

    def session(master, warehouse, folder=""):
        conf = {"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": warehouse}
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k) or d), sparkContext=context)

    assert shared_folder(session("local[4]", "/tmp/w")) == "/tmp/w/_checkpoints"
    assert shared_folder(session("yarn", "hdfs://a/w/")) == "hdfs://a/w/_checkpoints"
    assert shared_folder(session("yarn", "/tmp/w", "hdfs://a/c")) == "hdfs://a/c"
    for warehouse in ("/tmp/w", "file:/tmp/w"):
        with pytest.raises(RuntimeError, match="checkpoint.dir"):
            shared_folder(session("spark://host:7077", warehouse))
