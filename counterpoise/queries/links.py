"""Opposite-label links and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterpoise.operators import links as L
from counterpoise.plans.clean import link_clean, link_clean_report, oversample_then_clean
from counterpoise.queries import views as V
from counterpoise.queries.oversampling import PART, smote_sql

PCT = 10


def _labelled(spark, folder):
    return L.nearest_labels(V.part_types(spark, folder), "id", V.TYPE_FEATURES, "label")


def _clean(spark, folder, mode):
    return link_clean(V.part_types(spark, folder), "id", V.TYPE_FEATURES, "label", mode=mode)


def q_nn_labels(spark, folder):
    return _labelled(spark, folder).withColumn("dist", F.col("dist").cast("double"))


def q_tomek_links(spark, folder):
    links = L.opposite_links(_labelled(spark, folder))
    return links.withColumn("dist", F.col("dist").cast("double"))


def q_tomek_mutual(spark, folder):
    return L.mutual_pairs(L.opposite_links(_labelled(spark, folder)))


def q_tomek_removed(spark, folder):
    return L.removed_ids(L.opposite_links(_labelled(spark, folder)))


def q_tomek_clean(spark, folder):
    return _clean(spark, folder, "one_sided")


def q_tomek_clean_mutual(spark, folder):
    return _clean(spark, folder, "mutual")


def q_tomek_report(spark, folder):
    return link_clean_report(V.part_types(spark, folder), "id", V.TYPE_FEATURES, "label")


def q_tomek_orders(spark, folder):
    return link_clean(V.orders_status(spark, folder), "id", V.ORDER_FEATURES, "label")


def q_tomek_cells(spark, folder):
    return link_clean(V.orders_status(spark, folder), "id", V.ORDER_FEATURES, "label",
                      mode="mutual", strategy="cells")


def q_smote_tomek(spark, folder):
    return oversample_then_clean(V.part_imb(spark, folder), "id", V.PART_FEATURES, "label",
                                 V.MINORITY, PCT)


QUERIES = {
    name: query for name, query in list(globals().items()) if name.startswith("q_")}


def links_sql(view: str, features: list[str]) -> str:
    """CTEs from a view with id and label to ``removed`` and ``mutual``."""
    return f"""{V.nn1(view, features)},
labelled AS (SELECT qid AS id, a.label AS label, nid, b.label AS nlabel, dist::DOUBLE AS dist
             FROM nn JOIN {view} a ON a.id = qid JOIN {view} b ON b.id = nid),
links AS (SELECT * FROM labelled WHERE label <> nlabel),
mutual AS (SELECT least(id, nid) AS low, greatest(id, nid) AS high FROM links
           GROUP BY ALL HAVING count(*) = 2),
removed AS (SELECT id FROM links UNION SELECT nid FROM links)"""


_PART = f"{V.PART_TYPES}, {links_sql('part_types', V.TYPE_FEATURES)}"

ORACLE = {
    "q_nn_labels": f"WITH {_PART} SELECT * FROM labelled",
    "q_tomek_links": f"WITH {_PART} SELECT * FROM links",
    "q_tomek_mutual": f"WITH {_PART} SELECT * FROM mutual",
    "q_tomek_removed": f"WITH {_PART} SELECT * FROM removed",
    "q_tomek_clean": f"""WITH {_PART} SELECT id, p_size, p_retailprice, label FROM part_types
        WHERE id NOT IN (SELECT id FROM removed)""",
    "q_tomek_clean_mutual": f"""WITH {_PART} SELECT id, p_size, p_retailprice, label
        FROM part_types WHERE id NOT IN (SELECT low FROM mutual UNION SELECT high FROM mutual)""",
    "q_tomek_report": f"""WITH {_PART}, c AS (
        SELECT (SELECT count(*) FROM part_types) AS n_rows,
               (SELECT count(*) FROM links) AS n_directed,
               (SELECT count(*) FROM mutual) AS n_mutual_pairs,
               (SELECT count(*) FROM removed) AS n_removed)
        SELECT *, n_rows - n_removed AS n_kept FROM c""",
    "q_tomek_orders": f"""WITH {V.ORDERS_STATUS}, {links_sql('orders_status', V.ORDER_FEATURES)}
        SELECT id, o_totalprice, o_custkey::BIGINT AS o_custkey, label FROM orders_status
        WHERE id NOT IN (SELECT id FROM removed)""",
    "q_tomek_cells": f"""WITH {V.ORDERS_STATUS}, {links_sql('orders_status', V.ORDER_FEATURES)}
        SELECT id, o_totalprice, o_custkey::BIGINT AS o_custkey, label FROM orders_status
        WHERE id NOT IN (SELECT low FROM mutual UNION SELECT high FROM mutual)""",
    "q_smote_tomek": f"""WITH {smote_sql(*PART, PCT)},
        {links_sql('balanced', V.PART_FEATURES).replace('nn AS', 'near AS', 1)
         .replace('FROM nn JOIN', 'FROM near JOIN')}
        SELECT * FROM balanced WHERE id NOT IN (SELECT id FROM removed)""",
}
