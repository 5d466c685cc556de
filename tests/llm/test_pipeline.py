"""The pipeline's stages, each against a plain Python version on its own input."""

import collections
import os
import re
import zlib

import pytest

import __spark_entry__ as driver
import corpus_pipeline
from counterpoise.llm import packing, suffix, tokens, toxicity
from counterpoise.llm.common import table
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_simhash import print_of, smallest
from tests.llm.test_tokens import check_packing

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def word_runs(text, n=51):
    words = text.split()
    return [tuple(words[k:k + n]) for k in range(len(words) - n + 1)]


def passages_of(rows, doc_id, runs, n=51):
    """Byte ranges of the runs of n words of a text that occur several times in all."""
    text = rows[doc_id].text
    places = [m.span() for m in re.finditer(r"\S+", text)]
    for k, run in enumerate(word_runs(text, n)):
        if runs[run] > 1:
            yield len(text[:places[k][0]].encode()), len(text[:places[k + n - 1][1]].encode())


def test_stages(spark, tmp_path):
    docs = table(spark, FOLDER, "documents")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / name))
        kept.append((docs, spark.read.parquet(str(tmp_path / name))))
        docs = kept[-1][1]
        assert name == "packing" or docs.columns == columns

    before, after = map(rows_of, kept[0])
    model = toxicity.default_model(kept[0][0], table(spark, FOLDER, "labels"))
    scores = model.scores([r.text for r in before.values()])
    assert set(after) == {i for i, s in zip(before, scores) if s < 0.5}

    before, after = map(rows_of, kept[1])
    ids = list(before)
    groups = smallest([print_of(before[i].text) for i in ids], ids)
    assert set(after) == {i for i, g in zip(ids, groups) if i == g}
    assert all(after[i] == before[i] for i in after)

    before, after = map(rows_of, kept[2])
    assert set(before) == set(after)
    raws = {i: r.text.encode() for i, r in before.items()}
    count = collections.Counter(r[k:k + suffix.WINDOW] for r in raws.values()
                                for k in range(len(r) - suffix.WINDOW + 1))
    runs = collections.Counter(w for r in before.values() for w in word_runs(r.text))
    for i, r in raws.items():
        gone = bytearray(len(r))
        for k in range(len(r) - suffix.WINDOW + 1):
            if count[r[k:k + suffix.WINDOW]] > 1:
                gone[k:k + suffix.WINDOW] = b"\x01" * suffix.WINDOW
        for a, b in passages_of(before, i, runs):
            gone[a:b] = b"\x01" * (b - a)
        want = bytes(x for x, g in zip(r, gone) if not g).decode(errors="ignore")
        assert after[i].text == want
        assert after[i].n_chars == (len(want) if any(gone) else before[i].n_chars)

    before, after = map(rows_of, kept[3])
    items = [tuple(r) for r in table(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
    found = contamination([(i, r.text) for i, r in before.items()], items)
    assert set(after) == {x[0] for x in found if not x[-1]}

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    want = {i: t.encode(r.text, add_special_tokens=False).ids + [1] for i, r in after.items()}
    found = [r for r in packing.pack(kept[4][0]).collect()]
    check_packing(found, want, packing.Limits())
    assert collections.Counter(tuple(r)[:7] for r in found) == collections.Counter(
        tuple(r) for r in kept[4][1].collect())


def test_run_is_registered_and_gives_pieces(spark):
    found = driver.queries()["pipeline"](spark, FOLDER)
    rows = found.collect()
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens",
                             "sequence_id", "offset"]
    assert rows and len({r.sequence_id for r in rows}) < len(rows)
    assert zlib.crc32(b"") == 0 and all(0 <= r.ids_crc32 < 1 << 32 for r in rows)


def test_all_operators_are_registered():
    names = [n for n in driver.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_odd_rows_through_all_stages(spark):
    """Nulls, empty and repeated rows, one id for several texts, extra and clashing columns."""
    lone = [" ".join(f"{a}{k}" for k in range(80)) for a in "abcdef"]
    rows = [(1, None, None, None, None), (1, "", "en", "s", 0), (2, "", "en", "s", 0),
            (3, lone[0], "en", "s", 1), (3, lone[0], "en", "s", 1), (3, lone[1], "de", None, 2),
            (None, lone[2], "en", "s", 3), (None, lone[3], "en", "s", 4), (4, lone[4] + " " + lone[5][:40], "en", "s", 5),
            (5, lone[5], None, "s", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "'x' AS print", "1 AS root", "2 AS row", "3 AS txt", "4 AS `a.b`", "5 AS _id")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, FOLDER)
        if name != "packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), before.schema)
    left = collections.Counter(r.doc_id for r in docs.collect() if r.start == 0)
    assert left == {1: 1, 3: 2, 4: 1, 5: 1, None: 2}
    empty = before.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0
