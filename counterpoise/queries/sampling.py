"""Class counts, sampling plans, sampling, distances of joined rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from counterpoise.functions.distance import distance
from counterpoise.operators import classes as C
from counterpoise.operators.sampling import (
    HALF_STEP,
    LADDER_MEAN,
    TRIES,
    Rejection,
    poisson_ladder,
    replicate_rows,
    sample_rows,
    with_copies,
)
from counterpoise.queries import views as V

PLAIN_PCT = 10
COPIES_PCT = 250
HEAVY = 70.5
REJECTED = 123_456.75


def q_class_counts(spark, folder):
    return C.class_counts(V.lineitem_imb(spark, folder), "label", V.MINORITY)


def q_class_distribution(spark, folder):
    return C.class_distribution(V.embeddings(spark, folder), "label")


def q_sampling_plan(spark, folder):
    return C.sampling_plan_table(V.lineitem_imb(spark, folder), "label", V.MINORITY, COPIES_PCT)


def q_sample(spark, folder):
    lines = V.lineitem_imb(spark, folder)
    plan = C.sampling_plan(lines, "label", V.MINORITY, 2)
    return sample_rows(C.minority_rows(lines, "label", V.MINORITY), "id", plan.fraction)


def q_sample_replicate(spark, folder):
    lines = V.lineitem_imb(spark, folder)
    plan = C.sampling_plan(lines, "label", V.MINORITY, PLAIN_PCT)
    return replicate_rows(C.minority_rows(lines, "label", V.MINORITY), "id", plan.fraction)


def q_sample_heavy(spark, folder):
    """More copies than one table of probabilities covers: their sum and spread."""
    lines = V.lineitem_imb(spark, folder)
    drawn = with_copies(C.minority_rows(lines, "label", V.MINORITY), "id", HEAVY)
    return drawn.select("id", F.col("copies").cast("long").alias("copies"))


def q_sample_rejection(spark, folder):
    """Very many copies: counts by transformed rejection."""
    lines = V.lineitem_imb(spark, folder)
    drawn = with_copies(C.minority_rows(lines, "label", V.MINORITY), "id", REJECTED)
    return drawn.select("id", F.col("copies").cast("long").alias("copies"))


def _line_part(spark, folder, metric):
    """Each line compared with its own part: one pair per line."""
    line = V.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    part = V.table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    dist = distance([F.col("l_quantity"), F.col("l_extendedprice")],
                    [F.col("p_size"), F.col("p_retailprice")], metric)
    return joined.select("l_orderkey", "l_linenumber", "l_partkey",
                         dist.cast("double").alias("dist"))


def q_dist_euclidean(spark, folder):
    return _line_part(spark, folder, "euclidean")


def q_dist_manhattan(spark, folder):
    return _line_part(spark, folder, "manhattan")


def q_dist_embeddings(spark, folder):
    """Each vector compared with the one of the next id."""
    one = V.embeddings(spark, folder).select("id", F.col("embedding").alias("x"))
    two = V.embeddings(spark, folder).select((F.col("id") - 1).alias("id"),
                                             F.col("embedding").alias("y"))
    width = range(V.EMBEDDING_WIDTH)
    dist = distance([F.col("x")[i] for i in width], [F.col("y")[i] for i in width])
    return one.join(two, "id").select("id", dist.cast("double").alias("dist"))


QUERIES = {
    name: query for name, query in list(globals().items()) if name.startswith("q_")}


def _line_part_sql(metric: str) -> str:
    dist = V.gap(metric, [("l_quantity", "p_size::DOUBLE"), ("l_extendedprice", "p_retailprice")])
    return (f"SELECT l_orderkey, l_linenumber, l_partkey, {dist}::DOUBLE AS dist "
            "FROM lineitem JOIN part ON l_partkey = p_partkey")


def _plan(pct: float) -> str:
    return f"{V.LINEITEM_IMB}, {V.plan('lineitem_imb', repr(V.MINORITY), pct)}"


def _heavy() -> str:
    draws = math.ceil(HEAVY / LADDER_MEAN)
    total = " + ".join(
        f"len(list_filter(ladder, lambda b: b <= {V.uniform('copies', 'id', repr(str(k + 1)))}))"
        for k in range(draws))
    ladder = ", ".join(f"{b!r}::DOUBLE" for b in poisson_ladder(HEAVY / draws))
    return f"""WITH {V.LINEITEM_IMB},
        drawn AS (SELECT id, {total} AS copies
                  FROM (SELECT *, [{ladder}] AS ladder FROM lineitem_imb
                        WHERE label = {V.MINORITY!r}))
        SELECT id, copies::BIGINT AS copies FROM drawn WHERE copies > 0"""


def _rejected() -> str:
    r = Rejection.of(REJECTED)
    u, v = (f"{V.uniform(tag, 'id', 'i::VARCHAR')} + {HALF_STEP!r}::DOUBLE" for tag in ("reject", "accept"))
    mean = f"{REJECTED!r}::DOUBLE"
    return f"""WITH {V.LINEITEM_IMB},
        draws AS (SELECT id, i, {u} - 0.5::DOUBLE AS u, {v} AS v
                  FROM lineitem_imb, range(1, {TRIES + 1}) AS t(i) WHERE label = {V.MINORITY!r}),
        tries AS (SELECT id, i, v, 0.5::DOUBLE - abs(u) AS edge,
                         floor(({2 * r.bend!r}::DOUBLE / (0.5::DOUBLE - abs(u)) + {r.scale!r}::DOUBLE) * u
                               + {REJECTED + 0.43!r}::DOUBLE) AS n FROM draws)
        SELECT id, arg_min(n, i)::BIGINT AS copies FROM tries
        WHERE (edge >= 0.07 AND v <= {r.inner!r}::DOUBLE) OR (n >= 1 AND NOT (edge < 0.013 AND v > edge)
          AND ln(v) + {r.log_alpha!r}::DOUBLE - ln({r.bend!r}::DOUBLE / (edge * edge) + {r.scale!r}::DOUBLE)
            <= n - {mean} - n * ln(n / {mean}) - 0.5 * ln(n * {2 * math.pi!r}::DOUBLE) - 1 / (12 * n))
        GROUP BY id"""


ORACLE = {
    "q_sample_heavy": _heavy(),
    "q_sample_rejection": _rejected(),
    "q_class_counts": f"WITH {_plan(PLAIN_PCT)} SELECT n_pos, n_neg FROM counts",
    "q_class_distribution": "SELECT label, count(*) AS n FROM embeddings GROUP BY label",
    "q_sampling_plan": f"WITH {_plan(COPIES_PCT)} SELECT n_pos, n_neg, n, fraction FROM plan",
    "q_sample": f"""WITH {_plan(2)}, {V.SAMPLED} SELECT id, l_quantity, l_extendedprice,
        l_discount, l_tax, label FROM sampled""",
    "q_sample_replicate": f"""WITH {_plan(PLAIN_PCT)}, {V.SAMPLED} SELECT id, l_quantity,
        l_extendedprice, l_discount, l_tax, label, copy FROM sampled""",
    "q_dist_euclidean": _line_part_sql("euclidean"),
    "q_dist_manhattan": _line_part_sql("manhattan"),
    "q_dist_embeddings": f"""SELECT q.vec_id AS id,
        {V.gap('euclidean', V.embedding_terms())}::DOUBLE AS dist
        FROM embeddings q JOIN embeddings c ON c.vec_id = q.vec_id + 1""",
}
