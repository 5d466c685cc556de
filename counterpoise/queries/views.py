"""Labelled views over the test tables, in Spark and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpoise.operators.encode import encode_features
from counterpoise.sources.spec import Spec

MINORITY = "positive"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def either(condition) -> F.Column:
    return F.when(condition, MINORITY).otherwise("negative")


PART_FEATURES = ["p_size", "p_retailprice", "p_type"]


def part_imb(spark: SparkSession, folder: str) -> DataFrame:
    """id, three features, label: large parts are the minority.

    The spec is read off the data once; encoding then needs no join.
    """
    part = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), *PART_FEATURES,
        either(F.col("p_size") >= 46).alias("label"))
    spec = Spec.of_data(part, PART_FEATURES[:2], PART_FEATURES[2:], "label")
    return encode_features(part, spec, keep=["id"])


PART_IMB = """
codes AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS code
          FROM (SELECT DISTINCT p_type FROM part)),
part_imb AS (SELECT p_partkey AS id, p_size::DOUBLE AS p_size, p_retailprice,
                    code::DOUBLE AS p_type,
                    CASE WHEN p_size >= 46 THEN 'positive' ELSE 'negative' END AS label
             FROM part JOIN codes USING (p_type))"""

TYPE_FEATURES = ["p_size", "p_retailprice"]


def part_types(spark: SparkSession, folder: str) -> DataFrame:
    """id, two features, six balanced classes."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("p_size"),
        "p_retailprice", F.col("p_type").alias("label"))


PART_TYPES = """
part_types AS (SELECT p_partkey AS id, p_size::DOUBLE AS p_size, p_retailprice,
                      p_type AS label FROM part)"""

ORDER_FEATURES = ["o_totalprice", "o_custkey"]


def orders_status(spark: SparkSession, folder: str) -> DataFrame:
    """id, two features, order status as the class."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), *ORDER_FEATURES, F.col("o_orderstatus").alias("label"))


ORDERS_STATUS = """
orders_status AS (SELECT o_orderkey AS id, o_totalprice, o_custkey::DOUBLE AS o_custkey,
                         o_orderstatus AS label FROM orders)"""

LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lineitem_imb(spark: SparkSession, folder: str) -> DataFrame:
    """id, four features, label; the four key columns together are unique."""
    line = table(spark, folder, "lineitem")
    rare = (F.col("l_linenumber") == 7) & (F.col("l_quantity") >= 45)
    return line.select(F.concat_ws("-", *LINE_KEY).alias("id"), *LINE_FEATURES,
                       either(rare).alias("label"))


LINEITEM_IMB = """
lineitem_imb AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS id,
                        l_quantity, l_extendedprice, l_discount, l_tax,
                        CASE WHEN l_linenumber = 7 AND l_quantity >= 45 THEN 'positive'
                             ELSE 'negative' END AS label FROM lineitem)"""

EMBEDDING_MINORITY = 3
EMBEDDING_WIDTH = 64


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """id, one array feature, ten classes."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", "label")


EMBEDDINGS = """
emb AS (SELECT vec_id AS id, embedding, label FROM embeddings)"""


def docs_quality(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, one numeric and two nominal columns, quality as the class token."""
    docs = table(spark, folder, "documents").select("doc_id", "n_chars", "lang", "source")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(
        "doc_id", "n_chars", "lang", "source", F.col("quality").cast("string").alias("class"))


DOCS_QUALITY = """
docs_quality AS (SELECT doc_id, n_chars, lang, source, quality::VARCHAR AS class
                 FROM documents JOIN labels USING (doc_id))"""


# --- SQL fragments -------------------------------------------------------------------

def uniform(tag: str, *ids: str, seed: int = 1234) -> str:
    parts = ", ".join([f"'{seed}'", f"'{tag}'", *ids])
    return (f"(('0x' || substr(md5(concat_ws(':', {parts})), 1, 8))::BIGINT::DOUBLE"
            " / 4294967296::DOUBLE)")


def plan(view: str, minority: str, pct: float) -> str:
    n = max(1, int(pct / 100))
    return f"""
counts AS (SELECT count(*) FILTER (WHERE label = {minority}) AS n_pos,
                  count(*) FILTER (WHERE label <> {minority}) AS n_neg FROM {view}),
plan AS (SELECT n_pos, n_neg, {n} AS n,
                n_neg::DOUBLE * {float(pct)!r}::DOUBLE / 100::DOUBLE / n_pos::DOUBLE
                / {n + 1}::DOUBLE AS fraction FROM counts),
rare AS (SELECT * FROM {view} WHERE label = {minority})"""


# Base rows with a copy number: Bernoulli up to fraction 1, Poisson copies beyond.
SAMPLED = f"""
ladder AS (SELECT j, sum(exp(-fraction) * pow(fraction, j) / gamma(j + 1))
                     OVER (ORDER BY j) AS cum
           FROM plan, (SELECT unnest(range(0, 120)) AS j)),
draws AS (SELECT rare.*, {uniform('sample', 'id')} AS u_sample,
                 {uniform('copies', 'id')} AS u_copies FROM rare),
sampled AS (
  SELECT draws.* EXCLUDE (u_sample, u_copies), 1 AS copy FROM draws, plan
  WHERE fraction <= 1 AND u_sample < fraction
  UNION ALL
  SELECT * EXCLUDE (c), unnest(range(1, c + 1))::INTEGER AS copy FROM (
    SELECT draws.* EXCLUDE (u_sample, u_copies),
           (SELECT count(*) FROM ladder WHERE cum <= u_copies) AS c
    FROM draws, plan WHERE fraction > 1))"""


def gap(metric: str, pairs: list[tuple[str, str]]) -> str:
    if metric == "manhattan":
        return "(" + " + ".join(f"abs({a} - {b})" for a, b in pairs) + ")::FLOAT"
    return "sqrt(" + " + ".join(f"({a} - {b}) * ({a} - {b})" for a, b in pairs) + ")::FLOAT"


def knn(queries: str, candidates: str, features: list[str], k: int,
        metric: str = "euclidean", name: str = "nn") -> str:
    """``name``(qid, rank, nid, dist) by brute force."""
    pairs = [(f"q.{f}", f"c.{f}") for f in features]
    return f"""
{name} AS (SELECT * FROM (
  SELECT qid, nid, dist,
         row_number() OVER (PARTITION BY qid ORDER BY dist, nid)::INTEGER AS rank
  FROM (SELECT q.id AS qid, c.id AS nid, {gap(metric, pairs)} AS dist
        FROM {queries} q, {candidates} c)
  WHERE dist > 0 AND NOT isnan(dist)) WHERE rank <= {k})"""


def nn1(view: str, features: list[str], metric: str = "euclidean") -> str:
    """``nn``(qid, nid, dist) for k = 1, as an aggregate instead of a sort."""
    pairs = [(f"q.{f}", f"c.{f}") for f in features]
    return f"""
nn AS (SELECT qid, best.nid AS nid, best.dist AS dist FROM (
  SELECT qid, min({{'dist': dist, 'nid': nid}}) AS best
  FROM (SELECT q.id AS qid, c.id AS nid, {gap(metric, pairs)} AS dist FROM {view} q, {view} c)
  WHERE dist > 0 AND NOT isnan(dist) GROUP BY qid))"""


def embedding_terms(a: str = "q", b: str = "c") -> list[tuple[str, str]]:
    return [(f"{a}.embedding[{i}]::DOUBLE", f"{b}.embedding[{i}]::DOUBLE")
            for i in range(1, EMBEDDING_WIDTH + 1)]
