"""Oversampling, stage by stage and end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterpoise.operators.classes import minority_rows, sampling_plan
from counterpoise.operators.synthesis import synthesize
from counterpoise.plans.oversample import (
    chosen_partners, oversample, oversample_keyless, oversample_report)
from counterpoise.queries import views as V
from counterpoise.sources.delimited import delimited_line

K = 5
PLAIN_PCT = 10
COPIES_PCT = 250


def _partners(spark, folder, pct, **options):
    rows = V.part_imb(spark, folder)
    plan = sampling_plan(rows, "label", V.MINORITY, pct)
    rare = minority_rows(rows, "label", V.MINORITY)
    return chosen_partners(rare, "id", V.PART_FEATURES, plan, k=K, **options)


def _flat(partners):
    names = V.PART_FEATURES
    return partners.select(
        "qid", "copy", "rank", "nid", F.col("dist").cast("double").alias("dist"),
        *[F.col("qvec")[i].alias(f"q_{n}") for i, n in enumerate(names)],
        *[F.col("nvec")[i].alias(f"n_{n}") for i, n in enumerate(names)])


def _smote(spark, folder, pct, **options):
    return oversample(V.part_imb(spark, folder), "id", V.PART_FEATURES, "label", V.MINORITY,
                      pct, k=K, **options)


def q_sample_neighbors(spark, folder):
    return _flat(_partners(spark, folder, PLAIN_PCT))


def q_choose_nearest(spark, folder):
    return _flat(_partners(spark, folder, COPIES_PCT))


def q_choose_random(spark, folder):
    return _flat(_partners(spark, folder, COPIES_PCT, choose="random"))


def q_synthetic(spark, folder):
    made = synthesize(_partners(spark, folder, PLAIN_PCT), len(V.PART_FEATURES))
    return made.select("id", *[F.col(f"f{i}").alias(n) for i, n in enumerate(V.PART_FEATURES)])


def q_smote(spark, folder):
    return _smote(spark, folder, PLAIN_PCT)


def q_smote_over100(spark, folder):
    return _smote(spark, folder, COPIES_PCT)


def q_smote_random(spark, folder):
    return _smote(spark, folder, COPIES_PCT, choose="random")


def q_smote_manhattan(spark, folder):
    return _smote(spark, folder, PLAIN_PCT, metric="manhattan")


def q_smote_lineitem(spark, folder):
    return oversample(V.lineitem_imb(spark, folder), "id", V.LINE_FEATURES, "label", V.MINORITY,
                      2, k=K)


def q_smote_keyless(spark, folder):
    lines = V.lineitem_imb(spark, folder).drop("id")
    return oversample_keyless(lines, V.LINE_FEATURES, "label", V.MINORITY, 2, k=K)


def q_smote_multiclass(spark, folder):
    made = oversample(V.embeddings(spark, folder), "id", "embedding", "label",
                      V.EMBEDDING_MINORITY, PLAIN_PCT, k=K)
    return made.select("id", "label", "origin", *[
        F.col("embedding")[i].alias(f"e{i}") for i in range(V.EMBEDDING_WIDTH)])


def q_smote_csv(spark, folder):
    made = _smote(spark, folder, PLAIN_PCT)
    return made.select(delimited_line([*V.PART_FEATURES, "label"], decimals=6).alias("line"))


def q_smote_report(spark, folder):
    return oversample_report(_smote(spark, folder, COPIES_PCT))


QUERIES = {
    name: query for name, query in list(globals().items()) if name.startswith("q_")}


def partners_sql(view: str, view_sql: str, features: list[str], minority: str, pct: float,
                 choose: str = "nearest", metric: str = "euclidean") -> str:
    """CTEs up to ``chosen``: sampled base rows joined to their n chosen neighbours."""
    n = max(1, int(pct / 100))
    bases = "bases AS (SELECT DISTINCT * EXCLUDE (copy) FROM sampled)"
    pick = "rank"
    if choose == "random":
        draw = V.uniform("choose", "qid", "copy", "nid")
        pick = f"row_number() OVER (PARTITION BY qid, copy ORDER BY {draw}, nid)"
    values = ", ".join([f"q.{f} AS q_{f}, c.{f} AS n_{f}" for f in features])
    return f"""{view_sql}, {V.plan(view, minority, pct)}, {V.SAMPLED}, {bases},
{V.knn('bases', 'rare', features, K if choose == 'random' else n, metric)},
joined AS (SELECT qid, q.copy AS copy, rank, nid, dist, {values}
           FROM nn JOIN sampled q ON q.id = qid JOIN rare c ON c.id = nid),
chosen AS (SELECT * EXCLUDE (pick) FROM (SELECT *, {pick} AS pick FROM joined)
           WHERE pick <= {n})"""


def smote_sql(view: str, view_sql: str, features: list[str], minority: str, pct: float,
              **options) -> str:
    """CTEs up to ``balanced``(id, features…, label, origin)."""
    u = V.uniform("gap", "qid", "copy", "rank")
    made = ", ".join(f"q_{f} + (n_{f} - q_{f}) * u AS {f}" for f in features)
    names = ", ".join(features)
    return f"""{partners_sql(view, view_sql, features, minority, pct, **options)},
made AS (SELECT concat_ws(':', 'syn', qid, copy, rank) AS id, {made}
         FROM (SELECT *, {u} AS u FROM chosen)),
balanced AS (
  SELECT id, {names}, {minority} AS label, 'synthetic' AS origin FROM made
  UNION ALL
  SELECT concat_ws(':', 'orig', id, copy), {names}, label, 'sampled' FROM sampled
  UNION ALL
  SELECT concat_ws(':', 'maj', id), {names}, label, 'majority' FROM {view}
  WHERE label <> {minority})"""


POSITIVE = repr(V.MINORITY)
PART = ("part_imb", V.PART_IMB, V.PART_FEATURES, POSITIVE)
_FLAT = ("SELECT qid, copy, rank, nid, dist::DOUBLE AS dist, "
         + ", ".join(f"{p}_{f}" for p in "qn" for f in V.PART_FEATURES) + " FROM chosen")

_EMB_FEATURES = [f"e{i}" for i in range(V.EMBEDDING_WIDTH)]
_EMB_VIEW = "emb AS (SELECT vec_id AS id, label, " + ", ".join(
    f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(V.EMBEDDING_WIDTH)) + " FROM embeddings)"

# The content key of a minority line: hash of its JSON text and a copy number.
_LINE_JSON = " || ',' || ".join(f"""'"{f}":' || {f}::VARCHAR""" for f in V.LINE_FEATURES)
_KEYLESS_VIEW = f"""
plain AS (SELECT {', '.join(f'CASE WHEN {f} = 0 THEN 0.0::DOUBLE ELSE {f} END AS {f}'
                            for f in V.LINE_FEATURES)},
                 CASE WHEN l_linenumber = 7 AND l_quantity >= 45 THEN 'positive'
                      ELSE 'negative' END AS label FROM lineitem),
keyless AS (SELECT sha256('{{' || {_LINE_JSON} || '}}') || ':' || row_number() OVER (
                     PARTITION BY label, {', '.join(V.LINE_FEATURES)})::VARCHAR AS id, *
            FROM plain)"""

ORACLE = {
    "q_sample_neighbors": f"WITH {partners_sql(*PART, PLAIN_PCT)} {_FLAT}",
    "q_choose_nearest": f"WITH {partners_sql(*PART, COPIES_PCT)} {_FLAT}",
    "q_choose_random": f"WITH {partners_sql(*PART, COPIES_PCT, choose='random')} {_FLAT}",
    "q_synthetic": f"WITH {smote_sql(*PART, PLAIN_PCT)} SELECT * FROM made",
    "q_smote": f"WITH {smote_sql(*PART, PLAIN_PCT)} SELECT * FROM balanced",
    "q_smote_over100": f"WITH {smote_sql(*PART, COPIES_PCT)} SELECT * FROM balanced",
    "q_smote_random":
        f"WITH {smote_sql(*PART, COPIES_PCT, choose='random')} SELECT * FROM balanced",
    "q_smote_manhattan":
        f"WITH {smote_sql(*PART, PLAIN_PCT, metric='manhattan')} SELECT * FROM balanced",
    "q_smote_lineitem": "WITH " + smote_sql(
        "lineitem_imb", V.LINEITEM_IMB, V.LINE_FEATURES, POSITIVE, 2) + " SELECT * FROM balanced",
    "q_smote_keyless": "WITH " + smote_sql(
        "keyless", _KEYLESS_VIEW, V.LINE_FEATURES, POSITIVE, 2
    ) + " SELECT * EXCLUDE (id) FROM balanced",
    "q_smote_multiclass": "WITH " + smote_sql(
        "emb", _EMB_VIEW, _EMB_FEATURES, str(V.EMBEDDING_MINORITY), PLAIN_PCT
    ) + " SELECT * FROM balanced",
    "q_smote_csv": f"""WITH {smote_sql(*PART, PLAIN_PCT)} SELECT concat_ws(',', {', '.join(
        f"printf('%.6f', {f})" for f in V.PART_FEATURES)}, label) AS line FROM balanced""",
    "q_smote_report": f"""WITH {smote_sql(*PART, COPIES_PCT)}
        SELECT origin, count(*) AS n FROM balanced GROUP BY origin""",
}
