"""Neighbour joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from counterpoise.materialize import shared_folder
from counterpoise.operators.neighbors import knn_index, knn_join
from counterpoise.queries import views as V

K = 5


def _plain(found):
    return found.select("qid", "rank", "nid", F.col("dist").cast("double").alias("dist"))


def _part(spark, folder, **options):
    rows = V.part_types(spark, folder)
    return _plain(knn_join(rows, rows, key="id", features=V.TYPE_FEATURES, **options))


def q_knn_euclidean(spark, folder):
    return _part(spark, folder, k=K)


def q_knn_manhattan(spark, folder):
    return _part(spark, folder, k=K, metric="manhattan")


def q_knn_cells(spark, folder):
    return _part(spark, folder, k=K, strategy="cells")


def q_knn_cells_manhattan(spark, folder):
    return _part(spark, folder, k=K, metric="manhattan", strategy="cells")


def q_nn1(spark, folder):
    return _part(spark, folder, k=1).drop("rank")


def q_knn_embeddings(spark, folder):
    rows = V.embeddings(spark, folder)
    return _plain(knn_join(rows, rows, k=K, key="id", features="embedding"))


def q_knn_embeddings_cells(spark, folder):
    """Wide vectors, cells around pivots."""
    rows = V.embeddings(spark, folder)
    return _plain(knn_join(rows, rows, k=K, key="id", features="embedding", strategy="cells"))


def q_knn_stored_index(spark, folder):
    """The parts against an index of them that was stored and opened again."""
    rows = V.part_types(spark, folder)
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    index = knn_index(rows, k=K, key="id", features=V.TYPE_FEATURES).write(path)
    return _plain(knn_join(rows, index, k=K, key="id", features=V.TYPE_FEATURES))


def q_knn_customer_supplier(spark, folder):
    """Two different tables: suppliers with the balance nearest to each customer's."""
    return _customer_supplier(spark, folder)


def q_knn_customer_supplier_cells(spark, folder):
    return _customer_supplier(spark, folder, strategy="cells")


def _customer_supplier(spark, folder, **options):
    customer = V.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"),
        F.col("c_nationkey").alias("nation"))
    supplier = V.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"),
        F.col("s_nationkey").alias("nation"))
    return _plain(knn_join(customer, supplier, k=K, key="id", features=["bal", "nation"], **options))


QUERIES = {
    name: query for name, query in list(globals().items()) if name.startswith("q_")}


def _part_sql(metric: str) -> str:
    return (f"WITH {V.PART_TYPES}, {V.knn('part_types', 'part_types', V.TYPE_FEATURES, K, metric)} "
            "SELECT qid, rank, nid, dist::DOUBLE AS dist FROM nn")


ORACLE = {
    "q_knn_euclidean": _part_sql("euclidean"),
    "q_knn_manhattan": _part_sql("manhattan"),
    "q_knn_cells": _part_sql("euclidean"),
    "q_knn_cells_manhattan": _part_sql("manhattan"),
    "q_nn1": f"""WITH {V.PART_TYPES}, {V.nn1('part_types', V.TYPE_FEATURES)}
        SELECT qid, nid, dist::DOUBLE AS dist FROM nn""",
    "q_knn_embeddings": f"""SELECT qid, rank, nid, dist::DOUBLE AS dist FROM (
        SELECT qid, nid, dist,
               row_number() OVER (PARTITION BY qid ORDER BY dist, nid)::INTEGER AS rank
        FROM (SELECT q.vec_id AS qid, c.vec_id AS nid,
                     {V.gap('euclidean', V.embedding_terms())} AS dist
              FROM embeddings q, embeddings c)
        WHERE dist > 0 AND NOT isnan(dist)) WHERE rank <= {K}""",
    "q_knn_customer_supplier": f"""WITH
        cust AS (SELECT c_custkey AS id, c_acctbal AS bal, c_nationkey::DOUBLE AS nation
                 FROM customer),
        supp AS (SELECT s_suppkey AS id, s_acctbal AS bal, s_nationkey::DOUBLE AS nation
                 FROM supplier), {V.knn('cust', 'supp', ['bal', 'nation'], K)}
        SELECT qid, rank, nid, dist::DOUBLE AS dist FROM nn""",
}
ORACLE["q_knn_embeddings_cells"] = ORACLE["q_knn_embeddings"]
ORACLE["q_knn_customer_supplier_cells"] = ORACLE["q_knn_customer_supplier"]
ORACLE["q_knn_stored_index"] = ORACLE["q_knn_euclidean"]
