import pytest
from pyspark.sql import functions as F

from counterpoise.operators import encode as E
from counterpoise.sources import delimited as D
from counterpoise.sources import spec as S

HEADER = """@relation toy
@attribute len real [0.0, 10.0]
@attribute wt integer [0, 4]
@attribute color {red, green, blue}
@attribute class {negative, positive}
@inputs len, wt, color
@outputs class
@data
"""
NAMES = ["len", "wt", "color", "class"]


def table(spark, text):
    return spark.createDataFrame([(text,)], "value string")


@pytest.fixture(scope="module")
def spec(spark):
    return S.Spec.from_table(S.header_spec(table(spark, HEADER)))


def tokens(spark, *lines):
    rows = spark.createDataFrame([(line,) for line in lines], "line string")
    return D.parse_lines(rows, "line", NAMES)


def test_header(spark, spec, tmp_path):
    assert spec.names == NAMES
    assert [a.kind for a in spec.attributes] == ["numeric", "numeric", "nominal", "class"]
    assert (spec.attributes[0].low, spec.attributes[0].high) == (0.0, 10.0)
    assert spec.attributes[2].categories == ("red", "green", "blue")
    assert spec.label.categories == ("negative", "positive")
    path = tmp_path / "toy.header"
    path.write_text(HEADER.replace("\n", "\r\n"))
    read = S.header_spec(S.read_header(spark, str(path)))
    assert S.Spec.from_table(read) == spec
    assert S.class_number(read).first()[0] == 2
    assert [r["pos"] for r in S.numeric_positions(read).orderBy("pos").collect()] == [0, 1, 3]


def test_header_variants(spark):
    text = ("@RELATION r\n@ATTRIBUTE   Class {no way, yes}\n@attribute a{x y ,z}\n"
            "@Attribute b REAL[-1e3,2.5]\n")
    spec = S.Spec.from_table(S.header_spec(table(spark, text)))
    assert spec.names == ["a", "b", "Class"]  # the class goes last
    assert spec.attributes[0].categories == ("x y", "z")
    assert (spec.attributes[1].low, spec.attributes[1].high) == (-1000.0, 2.5)
    named = S.header_spec(table(spark, "@attribute y {a,b}\n@attribute x real [0,1]\n@outputs y"))
    assert S.Spec.from_table(named).label.name == "y"


def test_header_errors(spark):
    with pytest.raises(Exception, match="without a .* range: len"):
        S.header_spec(table(spark, HEADER.replace(" [0.0, 10.0]", ""))).collect()
    with pytest.raises(Exception, match="header lists 2 inputs"):
        S.header_spec(table(spark, HEADER.replace("len, wt, color", "len, wt"))).collect()


def test_lenient(spark, spec):
    df = tokens(spark, "5.0,2,green,positive", "10.0, 1, blue, negative", "1,2,7,negative")
    rows = [tuple(r) for r in E.encode(df, spec).collect()]
    assert sorted(rows) == [(1.0, 2.0, 7.0, 0.0), (5.0, 2.0, 1.0, 1.0), (10.0, 1.0, 2.0, 0.0)]
    kept = E.encode_features(df, spec).where("color = 1").first()
    assert kept["label"] == "positive"
    with pytest.raises(Exception, match="cannot encode color: pink"):
        E.encode(tokens(spark, "1,2,pink,negative"), spec).collect()
    with pytest.raises(Exception, match="cannot encode len: "):
        E.encode(tokens(spark, "?,2,red,negative"), spec).collect()


def test_strict_and_minmax(spark, spec):
    df = tokens(spark, "5.0,2,green,positive", "10.0, 1, blue, negative")
    rows = sorted(tuple(r) for r in E.encode(df, spec, "minmax").collect())
    assert rows == [(0.5, 0.5, 1.0, 1.0), (1.0, 0.25, 2.0, 0.0)]
    with pytest.raises(Exception, match="cannot encode color: 7"):
        E.encode(tokens(spark, "1,2,7,negative"), spec, "strict").collect()
    flat = S.Spec((S.Attribute("len", "numeric", 3.0, 3.0), spec.label))
    one = spark.createDataFrame([("3", "positive")], "len string, class string")
    assert E.encode(one, flat, "minmax").first()["len"] == 0.0
    with pytest.raises(ValueError):
        E.encode(df, spec, "other")


def test_lines(spark, spec):
    df = tokens(spark, "5,2,green,positive")
    assert E.encode_line(df, spec).first()["line"] == "5.0,2.0,1.0,1.0"
    assert E.encode_strict_line(df, spec, delimiter=";").first()["line"] == "5;2;1.0;1.0"


def test_numeric_projection(spark, spec):
    df = tokens(spark, "5.0,2,green,positive", "10.0, 1, blue, negative", "1,2,pink,negative")
    rows = sorted(tuple(r) for r in E.numeric_projection(df, spec, "positive").collect())
    assert rows == [(1.0, 2.0, 0.0), (5.0, 2.0, 1.0), (10.0, 1.0, 0.0)]


def test_arity(spark):
    with pytest.raises(Exception, match="expected 4 tokens"):
        tokens(spark, "1,2,red").collect()
    with pytest.raises(Exception, match="expected 4 tokens"):
        tokens(spark, "1,2,red,positive,").select("class").collect()


def test_spec_from_data(spark, spec):
    df = spark.createDataFrame(
        [(1.0, "b", "n"), (4.0, " a", "p"), (2.0, "b", "n")], "x double, c string, y string")
    inferred = S.Spec.from_table(S.infer_spec(df, ["x"], ["c"], "y"))
    assert inferred.names == ["x", "c", "y"]
    assert (inferred.attributes[0].low, inferred.attributes[0].high) == (1.0, 4.0)
    assert inferred.attributes[1].categories == ("a", "b")
    coded = E.attach_codes(df, S.infer_codes(df, ["c"]), ["c"])
    assert sorted(r["c_code"] for r in coded.collect()) == [0.0, 1.0, 1.0]


def test_long_lists_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([(k, float(k), f"c{k % 40}", "ny"[k % 2]) for k in range(90)],
                               "id long, x double, c string, y string")
    table = S.infer_spec(df, ["x"], ["c"], "y")
    listed = S.Spec.from_table(table)
    monkeypatch.setattr(S, "LISTED", 5)
    joined = S.Spec.from_table(table)
    assert listed.attributes[1].codes is None and joined.attributes[1].codes is not None
    for mode in ("lenient", "strict", "minmax"):
        both = [sorted(map(tuple, E.encode(df, s, mode, keep=["id"]).collect()))
                for s in (listed, joined)]
        assert both[0] == both[1] and len(both[0]) == 90
    odd = df.withColumn("c", F.when(F.col("id") == 3, "12.5").otherwise(F.col("c")))
    assert E.encode(odd, joined).where("c = 12.5").count() == 1
    with pytest.raises(Exception, match="cannot encode c"):
        E.encode(odd, joined, "strict").collect()


def test_codes_do_not_depend_on_the_plan(spark):
    df = spark.range(6000).select(F.md5(F.col("id").cast("string")).alias("a"))
    expected = {c: float(i) for i, c in enumerate(sorted(r["a"] for r in df.collect()))}
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        codes = {r["category"]: r["code"] for r in S.infer_codes(df, ["a"]).collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert codes == expected


def test_empty_tokens_are_kept(spark, spec):
    df = spark.createDataFrame([("5.0", None, "green", "positive")], ", ".join(
        f"{n} string" for n in NAMES))
    assert E.encode_strict_line(df, spec).first()["line"] == "5.0,,1.0,1.0"
    fixed = D.delimited_line(["a", "b"], ";", decimals=1)
    null = spark.createDataFrame([(None, "x")], "a double, b string")
    assert null.select(fixed).first()[0] == ";x"


def test_codes_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(3000).select((F.col("id") % 1000).cast("string").alias("a"),
                                      (F.col("id") % 7).cast("string").alias("b"))
        codes = S.infer_codes(df, ["a", "b"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for name, n in (("a", 1000), ("b", 7)):
        expected = {c: float(i) for i, c in enumerate(sorted(str(x) for x in range(n)))}
        assert {r["category"]: r["code"] for r in codes if r["name"] == name} == expected


def test_encoding_a_stream(spark, spec, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("5.0,2,green,positive\n1,2,red,negative\n")
    stream = spark.readStream.schema(", ".join(f"{n} string" for n in NAMES)).csv(
        str(tmp_path / "in"))
    query = (E.encode(stream, spec).writeStream.format("memory").queryName("encoded")
             .option("checkpointLocation", str(tmp_path / "state"))
             .trigger(availableNow=True).start())
    query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("encoded").collect()) == [
        (1.0, 2.0, 0.0, 0.0), (5.0, 2.0, 1.0, 1.0)]


def test_files(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('5.0, 2,"green,positive\n1,2,red,negative\n')
    rows = D.read_delimited(spark, str(path), NAMES).collect()
    assert rows[0]["color"] == '"green' and rows[0]["wt"] == "2"
    short = tmp_path / "short.csv"
    short.write_text("1,2,red,negative\n1,2,red\n")
    with pytest.raises(Exception):
        D.read_delimited(spark, str(short), NAMES).select("len").collect()
    numeric = tmp_path / "numeric.csv"
    numeric.write_text("1,2.5,0\n3, 4e1,1\n")
    got = D.read_numeric(spark, str(numeric), ["a", "b", "label"])
    assert sorted(tuple(r) for r in got.collect()) == [(1.0, 2.5, 0.0), (3.0, 40.0, 1.0)]
    bad = tmp_path / "bad.csv"
    bad.write_text("1,x,0\n")
    with pytest.raises(Exception):
        D.read_numeric(spark, str(bad), ["a", "b", "label"]).collect()
    D.write_delimited(got.repartition(2), str(tmp_path / "out"), ";")
    back = D.read_numeric(spark, str(tmp_path / "out"), ["a", "b", "label"], ";")
    assert sorted(back.collect()) == sorted(got.collect())
    D.write_parquet(got, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2


def test_fixed_decimals(spark):
    line = D.delimited_line(["a", "b"], ";", decimals=2)
    df = spark.createDataFrame([(1.234, "x")], "a double, b string")
    assert df.select(line).first()[0] == "1.23;x"
    assert df.select(F.length(D.delimited_line(["a", "b"]))).first()[0] == len("1.234,x")


def test_spec_of_data_reads_the_table_once(spark, monkeypatch):
    df = spark.createDataFrame([(k, float(k), f"c{k % 40:02d}", "ny"[k % 2]) for k in range(90)] + [
        (90, -0.0, None, None)], "id long, x double, c string, y string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("of_data", "")
    whole = S.Spec.of_data(df, ["x"], ["c"], "y")
    table = S.infer_spec(df, ["x"], ["c"], "y")
    assert len(tracker.getJobIdsForGroup("of_data")) <= 4  # two for each of both aggregates
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert whole.attributes == S.Spec.from_table(table).attributes
    assert whole.attributes[1].categories == tuple(f"c{k:02d}" for k in range(40))
    for listed in (5, 20, 39):
        monkeypatch.setattr(S, "LISTED", listed)
        short = S.Spec.of_data(df, ["x"], ["c"], "y")
        assert short.attributes[1].codes is not None and short.label.categories == ("n", "y")
        assert sorted(map(tuple, S.infer_codes(df, ["c", "y"]).collect())) == sorted(
            [("c", f"c{k:02d}", float(k)) for k in range(40)] + [("y", "n", 0.0), ("y", "y", 1.0)])
        assert sorted(map(str, S.infer_spec(df, ["x"], ["c"], "y").collect())) == sorted(
            map(str, table.collect()))


def test_spec_of_an_empty_table(spark):
    df = spark.createDataFrame([], "x double, c string, y string")
    spec = S.Spec.of_data(df, ["x"], ["c"], "y")
    assert (spec.attributes[0].low, spec.attributes[1].categories) == (None, ())
    assert [r["name"] for r in S.infer_spec(df, ["x"], ["c"], "y").collect()] == ["x"]


def test_lines_know_their_file_and_number(spark, tmp_path):
    want = set()
    for name, n in (("a.txt", 4000), ("b.txt", 1), ("c.txt", 0), ("d.txt", 700)):
        lines = [f"{name},{k}" + (",extra" if k % 500 == 7 else "") for k in range(n)]
        (tmp_path / name).write_text("".join(f"{x}\n" for x in lines))
        want |= {(name, k + 1, x) for k, x in enumerate(lines)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = D.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() >= 1
        found = {(r["file"].rsplit("/", 1)[1], r["number"], r["line"]) for r in lines.collect()}
        assert found == want
        good, bad = D.parse_or_reject(lines, "line", ["name", "k"], keep=["file", "number"])
        rows = {(r["file"].rsplit("/", 1)[1], r["number"], r["reason"]) for r in bad.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert rows == {(f, n, "expected 2 tokens, found 3") for f, n, x in want if x.endswith("extra")}
    assert good.count() == len(want) - len(rows) and good.columns == ["file", "number", "name", "k"]


def test_rejects_have_the_first_reason(spark, spec):
    rows = [("5.0", "2", "green", "positive"), ("x", "2", "blue", "positive"), ("1", None, "red", "n"),
            ("1", "3", "mauve", "positive"), ("1", "3", "red", "odd")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], ", ".join(
        ["id long", *(f"{n} string" for n in NAMES)]))
    for mode in ("strict", "minmax"):
        good, bad = E.encode_or_reject(df, spec, mode, keep=["id"])
        assert [r["id"] for r in good.collect()] == [0]
        assert sorted(r["reason"] for r in bad.collect()) == sorted([
            f"cannot encode {NAMES[0]}: x", f"cannot encode {NAMES[1]}: missing value",
            f"cannot encode {NAMES[2]}: mauve", f"cannot encode {NAMES[3]}: odd"])
    with pytest.raises(ValueError):
        E.encode_or_reject(df, spec, "loose")


def test_null_lines_are_rejected(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a,b")], "id long, line string")
    good, bad = D.parse_or_reject(df, "line", ["x", "y"], keep=["id"])
    assert [tuple(r) for r in good.collect()] == [(3, "a", "b")]
    assert sorted((r["id"], r["reason"]) for r in bad.collect()) == [
        (1, "expected 2 tokens, found 0"), (2, "expected 2 tokens, found 1")]


def test_numeric_columns(spark):
    df = spark.createDataFrame([("1", "a", None, " 2.5 "), ("-3e4", "1", None, None)],
                               "a string, b string, c string, d string")
    assert [tuple(r) for r in S.numeric_columns(df, df.columns).collect()] == [(0, "a"), (3, "d")]
