"""Specs, encoders, filters, parsing, row keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpoise.functions.keys import with_row_key
from counterpoise.operators import encode as E
from counterpoise.operators.classes import majority_rows, minority_rows
from counterpoise.queries import views as V
from counterpoise.sources import delimited as D
from counterpoise.sources import spec as S

NAMES = ["p_size", "p_retailprice", "p_type", "class"]


def part_header(spark: SparkSession, folder: str) -> DataFrame:
    """Header text of the part table, derived from its ranges and categories."""
    part = V.table(spark, folder, "part")
    facts = part.agg(
        F.min("p_size").alias("s0"), F.max("p_size").alias("s1"),
        F.min("p_retailprice").alias("r0"), F.max("p_retailprice").alias("r1"),
        F.array_join(F.sort_array(F.collect_set("p_type")), ", ").alias("types"))
    return facts.select(F.concat_ws(
        "\n", F.lit("@relation part"),
        F.concat(F.lit("@attribute p_size integer ["), "s0", F.lit(", "), "s1", F.lit("]")),
        F.concat(F.lit("@attribute p_retailprice real ["), "r0", F.lit(", "), "r1", F.lit("]")),
        F.concat(F.lit("@attribute p_type {"), "types", F.lit("}")),
        F.lit("@attribute class {negative, positive}"),
        F.lit("@inputs p_size, p_retailprice, p_type"),
        F.lit("@outputs class"), F.lit("@data")).alias("value"))


def part_spec(spark: SparkSession, folder: str) -> S.Spec:
    return S.Spec.from_table(S.header_spec(part_header(spark, folder)))


def part_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The part table as raw delimited lines, with blanks after the delimiter."""
    part = V.table(spark, folder, "part")
    return part.select(
        F.col("p_partkey").alias("id"),
        F.concat_ws(", ", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"),
                    "p_type", V.either(F.col("p_size") >= 46)).alias("line"))


def part_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return D.parse_lines(part_lines(spark, folder), "line", NAMES, keep=["id"])


def q_header_spec(spark, folder):
    return S.header_spec(part_header(spark, folder))


def q_num_classes(spark, folder):
    return S.class_number(S.header_spec(part_header(spark, folder)))


def q_numeric_columns(spark, folder):
    return S.numeric_positions(S.header_spec(part_header(spark, folder)))


def q_infer_ranges(spark, folder):
    return S.infer_ranges(V.table(spark, folder, "lineitem"), V.LINE_FEATURES)


def q_infer_codes(spark, folder):
    return S.infer_codes(V.docs_quality(spark, folder), ["lang", "source", "class"])


def q_infer_spec(spark, folder):
    return S.infer_spec(V.docs_quality(spark, folder), ["n_chars"], ["lang", "source"], "class")


def q_encode(spark, folder):
    return E.encode(part_tokens(spark, folder), part_spec(spark, folder), keep=["id"])


def q_encode_lenient(spark, folder):
    """Every tenth part has a number where the list of categories is expected."""
    tokens = part_tokens(spark, folder).withColumn(
        "p_type", F.when(F.col("id") % 10 == 0, F.col("p_size")).otherwise(F.col("p_type")))
    return E.encode(tokens, part_spec(spark, folder), "lenient", keep=["id"])


def q_encode_wide(spark, folder):
    """A column with a category per row, in all three modes."""
    customer = V.table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_name",
                                                         "c_mktsegment")
    spec = S.Spec.of_data(customer, ["c_acctbal"], ["c_name"], "c_mktsegment")
    coded = [E.encode(customer, spec, mode, keep=["c_custkey"]).withColumn("mode", F.lit(mode))
             for mode in ("lenient", "strict", "minmax")]
    return coded[0].unionByName(coded[1]).unionByName(coded[2])


def q_empty_tokens(spark, folder):
    """Lines whose first, numeric token is empty keep it."""
    tokens = part_tokens(spark, folder).withColumn(
        "p_size", F.when(F.col("id") % 2 == 0, F.col("p_size")))
    return E.encode_strict_line(tokens, part_spec(spark, folder), keep=["id"])


def _document_lines(spark, folder):
    """The lines of the documents' texts, numbered from 1."""
    text = V.table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias(
        "pos", "line"))
    return text.select("doc_id", (F.col("pos") + 1).alias("number"), "line")


def q_arity_wrong(spark, folder):
    """How many lines of the documents' text are not of two tokens."""
    fault = D.width_fault(D.line_tokens("line"), 2)
    return _document_lines(spark, folder).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(fault.isNotNull()).alias("n_wrong"))


def q_arity_rejects(spark, folder):
    """Every line that is not of two tokens, with its place and what is wrong."""
    _, bad = D.parse_or_reject(_document_lines(spark, folder), "line", ["left", "right"],
                               keep=["doc_id", "number"])
    return bad


def q_arity_kept(spark, folder):
    """The lines of two tokens, parsed in the pass that rejects the others."""
    good, _ = D.parse_or_reject(_document_lines(spark, folder), "line", ["left", "right"],
                                keep=["doc_id", "number"], trim=False)
    return good


def _odd_tokens(spark, folder):
    """Parts, some with an unknown category, some without a price, some with a bad size."""
    return part_tokens(spark, folder).withColumns({
        "p_type": F.when(F.col("id") % 10 == 0, "UNHEARD OF").otherwise(F.col("p_type")),
        "p_retailprice": F.when(F.col("id") % 7 != 0, F.col("p_retailprice")),
        "p_size": F.when(F.col("id") % 13 == 0, "large").otherwise(F.col("p_size"))})


def q_encode_rejects(spark, folder):
    """Rows that strict encoding refuses, each with its reason."""
    _, bad = E.encode_or_reject(_odd_tokens(spark, folder), part_spec(spark, folder), "strict", ["id"])
    return bad


def q_encode_kept(spark, folder):
    good, _ = E.encode_or_reject(_odd_tokens(spark, folder), part_spec(spark, folder), "strict", ["id"])
    return good


def q_numeric_inferred(spark, folder):
    """Which columns of the customers hold numbers only, as their tokens tell."""
    customer = V.table(spark, folder, "customer")
    return S.numeric_columns(customer, customer.columns)


def q_class_number(spark, folder):
    """Number of classes of a spec whose class is taken from the data."""
    orders = V.table(spark, folder, "orders")
    return S.class_number(S.infer_spec(orders, ["o_totalprice"], ["o_orderpriority"],
                                       "o_orderstatus"))


def q_encode_docs(spark, folder):
    docs = V.docs_quality(spark, folder)
    spec = S.Spec.of_data(docs, ["n_chars"], ["lang", "source"], "class")
    return E.encode(docs, spec, "strict", keep=["doc_id"])


def q_attach_codes(spark, folder):
    customer = V.table(spark, folder, "customer")
    columns = ["c_mktsegment", "c_name"]
    coded = E.attach_codes(customer, S.infer_codes(customer, columns), columns)
    return coded.select("c_custkey", "c_mktsegment_code", "c_name_code")


def q_encode_strict(spark, folder):
    return E.encode(part_tokens(spark, folder), part_spec(spark, folder), "strict", keep=["id"])


def q_minmax(spark, folder):
    return E.encode(part_tokens(spark, folder), part_spec(spark, folder), "minmax", keep=["id"])


def q_minmax_docs(spark, folder):
    docs = V.docs_quality(spark, folder)
    spec = S.Spec.of_data(docs, ["n_chars"], ["lang", "source"], "class")
    return E.encode(docs, spec, "minmax", keep=["doc_id"])


def q_encode_csv(spark, folder):
    return E.encode_line(part_tokens(spark, folder), part_spec(spark, folder), keep=["id"])


def q_encode_strict_csv(spark, folder):
    return E.encode_strict_line(part_tokens(spark, folder), part_spec(spark, folder), keep=["id"])


def q_numeric_projection(spark, folder):
    return E.numeric_projection(part_tokens(spark, folder), part_spec(spark, folder),
                                V.MINORITY, keep=["id"])


def q_numeric_load(spark, folder):
    line = V.table(spark, folder, "lineitem")
    lines = line.select(F.concat_ws(
        ",", *[F.col(c).cast("string") for c in V.LINE_FEATURES],
        F.col("l_linenumber").cast("string")).alias("line"))
    return D.parse_numeric_lines(lines, "line", [*V.LINE_FEATURES, "label"])


def q_arity_check(spark, folder):
    return part_tokens(spark, folder)


def q_minority_rows(spark, folder):
    spec = part_spec(spark, folder)
    encoded = E.encode(part_tokens(spark, folder), spec, keep=["id"])
    return minority_rows(encoded, "label", float(spec.label.categories.index(V.MINORITY)))


def q_majority_rows(spark, folder):
    rows = E.encode_features(part_tokens(spark, folder), part_spec(spark, folder), keep=["id"])
    return majority_rows(rows, "label", V.MINORITY)


def q_row_key_total(spark, folder):
    """Keys over all columns of a table with timestamps."""
    keyed = with_row_key(V.table(spark, folder, "events"))
    return keyed.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_keys"))


def q_row_key(spark, folder):
    columns = ["l_returnflag", "l_linestatus", "l_linenumber"]
    keyed = with_row_key(V.table(spark, folder, "lineitem").select(*columns))
    return keyed.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows"),
                                       F.count_distinct("id").alias("n_keys"))


QUERIES = {
    name: query for name, query in list(globals().items()) if name.startswith("q_")}

_CODES = """
codes AS (SELECT p_type, (row_number() OVER (ORDER BY p_type) - 1)::DOUBLE AS code
          FROM (SELECT DISTINCT p_type FROM part)),
enc AS (SELECT p_partkey AS id, p_size::DOUBLE AS p_size, p_retailprice, code AS p_type,
               CASE WHEN p_size >= 46 THEN 1 ELSE 0 END::DOUBLE AS label,
               p_size AS raw_size, p_retailprice AS raw_price
        FROM part JOIN codes USING (p_type))"""

_SPEC = """
spec AS (
  SELECT 0 AS pos, 'p_size' AS name, 'numeric' AS kind, min(p_size)::DOUBLE AS min,
         max(p_size)::DOUBLE AS max, NULL::VARCHAR AS category, NULL::DOUBLE AS code FROM part
  UNION ALL
  SELECT 1, 'p_retailprice', 'numeric', min(p_retailprice), max(p_retailprice), NULL, NULL
  FROM part
  UNION ALL
  SELECT 2, 'p_type', 'nominal', NULL, NULL, p_type,
         (row_number() OVER (ORDER BY p_type) - 1)::DOUBLE
  FROM (SELECT DISTINCT p_type FROM part)
  UNION ALL SELECT 3, 'class', 'class', NULL, NULL, 'negative', 0.0::DOUBLE
  UNION ALL SELECT 3, 'class', 'class', NULL, NULL, 'positive', 1.0::DOUBLE)"""

_DOC_CODES = """
doc_codes AS (
  SELECT name, category, (row_number() OVER (PARTITION BY name ORDER BY category) - 1)::DOUBLE
         AS code
  FROM (SELECT 'lang' AS name, lang AS category FROM docs_quality
        UNION SELECT 'source', source FROM docs_quality
        UNION SELECT 'class', class FROM docs_quality))"""

_DOC_ENC = f"""WITH {V.DOCS_QUALITY}, {_DOC_CODES}
SELECT d.doc_id, {{chars}} AS n_chars, l.code AS lang, s.code AS source, c.code AS label
FROM docs_quality d
JOIN doc_codes l ON l.name = 'lang' AND l.category = d.lang
JOIN doc_codes s ON s.name = 'source' AND s.category = d.source
JOIN doc_codes c ON c.name = 'class' AND c.category = d.class,
(SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi FROM docs_quality)"""

ORACLE = {
    "q_header_spec": f"WITH {_SPEC} SELECT * FROM spec",
    "q_num_classes": f"WITH {_SPEC} SELECT count(*) AS n_classes FROM spec WHERE kind = 'class'",
    "q_numeric_columns": f"""WITH {_SPEC}
        SELECT DISTINCT pos, name FROM spec WHERE kind IN ('numeric', 'class')""",
    "q_infer_ranges": " UNION ALL ".join(
        f"""SELECT '{c}' AS name, CASE WHEN min({c}) = 0 THEN 0.0::DOUBLE ELSE min({c}) END AS min,
            CASE WHEN max({c}) = 0 THEN 0.0::DOUBLE ELSE max({c}) END AS max FROM lineitem"""
        for c in V.LINE_FEATURES),
    "q_infer_codes": f"WITH {V.DOCS_QUALITY}, {_DOC_CODES} SELECT * FROM doc_codes",
    "q_infer_spec": f"""WITH {V.DOCS_QUALITY}, {_DOC_CODES}
        SELECT 0 AS pos, 'n_chars' AS name, 'numeric' AS kind, min(n_chars)::DOUBLE AS min,
               max(n_chars)::DOUBLE AS max, NULL::VARCHAR AS category, NULL::DOUBLE AS code
        FROM docs_quality
        UNION ALL
        SELECT CASE name WHEN 'lang' THEN 1 WHEN 'source' THEN 2 ELSE 3 END, name,
               CASE name WHEN 'class' THEN 'class' ELSE 'nominal' END, NULL, NULL, category, code
        FROM doc_codes""",
    "q_encode": f"WITH {_CODES} SELECT id, p_size, p_retailprice, p_type, label FROM enc",
    "q_encode_strict": f"WITH {_CODES} SELECT id, p_size, p_retailprice, p_type, label FROM enc",
    "q_encode_docs": _DOC_ENC.format(chars="d.n_chars::DOUBLE"),
    "q_minmax_docs": _DOC_ENC.format(chars="(d.n_chars::DOUBLE - lo) / (hi - lo)"),
    "q_attach_codes": """
        WITH seg AS (SELECT c_mktsegment, (row_number() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE
                            AS c_mktsegment_code FROM (SELECT DISTINCT c_mktsegment FROM customer)),
             nam AS (SELECT c_name, (row_number() OVER (ORDER BY c_name) - 1)::DOUBLE
                            AS c_name_code FROM (SELECT DISTINCT c_name FROM customer))
        SELECT c_custkey, c_mktsegment_code, c_name_code
        FROM customer JOIN seg USING (c_mktsegment) JOIN nam USING (c_name)""",
    "q_minmax": f"""WITH {_CODES}, r AS (
            SELECT min(p_size)::DOUBLE AS s0, max(p_size)::DOUBLE AS s1,
                   min(p_retailprice) AS r0, max(p_retailprice) AS r1 FROM part)
        SELECT id, (p_size - s0) / (s1 - s0) AS p_size,
               (p_retailprice - r0) / (r1 - r0) AS p_retailprice, p_type, label FROM enc, r""",
    "q_encode_csv": f"""WITH {_CODES}
        SELECT id, concat_ws(',', p_size::VARCHAR, p_retailprice::VARCHAR, p_type::VARCHAR,
                             label::VARCHAR) AS line FROM enc""",
    "q_encode_strict_csv": f"""WITH {_CODES}
        SELECT id, concat_ws(',', raw_size::VARCHAR, raw_price::VARCHAR, p_type::VARCHAR,
                             label::VARCHAR) AS line FROM enc""",
    "q_numeric_projection": f"WITH {_CODES} SELECT id, p_size, p_retailprice, label FROM enc",
    "q_numeric_load": """SELECT l_quantity, l_extendedprice, l_discount, l_tax,
        l_linenumber::DOUBLE AS label FROM lineitem""",
    "q_arity_check": """
        WITH lines AS (SELECT p_partkey AS id, string_split(concat_ws(', ', p_size, p_retailprice,
            p_type, CASE WHEN p_size >= 46 THEN 'positive' ELSE 'negative' END), ',') AS t FROM part)
        SELECT id, trim(t[1]) AS p_size, trim(t[2]) AS p_retailprice, trim(t[3]) AS p_type,
               trim(t[4]) AS class FROM lines WHERE len(t) = 4""",
    "q_minority_rows": f"""WITH {_CODES}
        SELECT id, p_size, p_retailprice, p_type, label FROM enc WHERE label = 1""",
    "q_majority_rows": f"""WITH {_CODES}
        SELECT id, p_size, p_retailprice, p_type, 'negative' AS label FROM enc WHERE label = 0""",
    "q_row_key_total": "SELECT count(*) AS n_rows, count(*) AS n_keys FROM events",
    "q_encode_lenient": f"""WITH {_CODES} SELECT id, p_size, p_retailprice,
        CASE WHEN id % 10 = 0 THEN p_size ELSE p_type END AS p_type, label FROM enc""",
    "q_encode_wide": """
        WITH nam AS (SELECT c_name, (row_number() OVER (ORDER BY c_name) - 1)::DOUBLE AS code
                     FROM (SELECT DISTINCT c_name FROM customer)),
             seg AS (SELECT c_mktsegment, (row_number() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE
                            AS label FROM (SELECT DISTINCT c_mktsegment FROM customer)),
             b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
        SELECT c_custkey, CASE WHEN mode = 'minmax' THEN (c_acctbal - lo) / (hi - lo)
                               ELSE c_acctbal END AS c_acctbal,
               code AS c_name, label, mode
        FROM customer JOIN nam USING (c_name) JOIN seg USING (c_mktsegment), b,
             (VALUES ('lenient'), ('strict'), ('minmax')) AS m(mode)""",
    "q_empty_tokens": f"""WITH {_CODES}
        SELECT id, CASE WHEN id % 2 = 0 THEN raw_size::VARCHAR ELSE '' END || ',' ||
               concat_ws(',', raw_price::VARCHAR, p_type::VARCHAR, label::VARCHAR) AS line
        FROM enc""",
    "q_arity_wrong": r"""SELECT count(*) AS n_lines,
        count(*) FILTER (len(string_split(line, ',')) <> 2) AS n_wrong
        FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)""",
    "q_arity_rejects": r"""SELECT doc_id, number::INTEGER AS number, line,
        'expected 2 tokens, found ' || len(string_split(line, ',')) AS reason
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                     generate_subscripts(string_split(text, chr(10)), 1) AS number FROM documents)
        WHERE len(string_split(line, ',')) <> 2""",
    "q_arity_kept": r"""SELECT doc_id, number::INTEGER AS number,
        string_split(line, ',')[1] AS left, string_split(line, ',')[2] AS right
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                     generate_subscripts(string_split(text, chr(10)), 1) AS number FROM documents)
        WHERE len(string_split(line, ',')) = 2""",
    "q_encode_rejects": """SELECT p_partkey AS id, CASE
          WHEN p_partkey % 13 = 0 THEN 'cannot encode p_size: large'
          WHEN p_partkey % 7 = 0 THEN 'cannot encode p_retailprice: missing value'
          ELSE 'cannot encode p_type: UNHEARD OF' END AS reason
        FROM part WHERE p_partkey % 13 = 0 OR p_partkey % 7 = 0 OR p_partkey % 10 = 0""",
    "q_encode_kept": f"""WITH {_CODES} SELECT id, p_size, p_retailprice, p_type, label FROM enc
        WHERE id % 13 <> 0 AND id % 7 <> 0 AND id % 10 <> 0""",
    "q_numeric_inferred": " UNION ALL ".join(
        f"""SELECT {i}::INTEGER AS pos, '{c}' AS name FROM customer HAVING count({c}) > 0 AND count(*)
            FILTER ({c} IS NOT NULL AND try_cast(trim({c}::VARCHAR) AS DOUBLE) IS NULL) = 0"""
        for i, c in enumerate(["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])),
    "q_class_number": "SELECT count(DISTINCT o_orderstatus) AS n_classes FROM orders",
    "q_row_key": """SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n_rows,
        count(*) AS n_keys FROM lineitem GROUP BY ALL""",
}
