"""Benchmark decontamination against plain Python and SQL."""

import collections
import hashlib
import os
import re

import duckdb
import pytest

from counterpoise.llm import decontaminate
from tests.llm.conftest import documents

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(rows, items, window=10):
    known = collections.defaultdict(set)
    for item, text in items:
        words = words_of(text)
        n = min(len(words), window)
        for k in range(len(words) - n + 1 if n else 0):
            known[tuple(words[k:k + n])].add(item)
    sizes = {len(k) for k in known}
    out = []
    for i, text in rows:
        words, hit, found = words_of(text), set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                own = known.get(tuple(words[k:k + n]))
                if own is not None:
                    hit.update(range(k, k + n))
                    found |= own
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(words), len(hit), len(ids),
                    hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(3, "one two three four five six seven eight nine ten eleven twelve"),
         (20, "ONE two, three four five six seven eight nine ten"), (4, "short item"), (5, ""),
         (6, None), (7, "Éé ñ"), (None, "no id here"), (8, "short item"), (9, "solo"),
         (10, "x x x x x x x x x x x x")]
TEXTS = ["", None, "nothing at all", "zero one two three four five six seven eight nine ten end",
         "SHORT! item short item", "éé ñ", "Éé Ñ Éé ñ", "a no id here b", "so solo solo", "x " * 40,
         "two three four five six seven eight nine ten eleven twelve", "pad " * 9000 + "short item",
         "one two three four five six seven eight nine", "short\x00item"]


def check(spark, ids, items, bound, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_GRAMS", bound)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, TEXTS, ids).selectExpr("*", "1 AS item_id", "2 AS hits", "3 AS words")
    found = decontaminate.contamination(docs, benchmark)
    assert sorted(map(tuple, found.collect()), key=str) == brute(list(zip(ids, TEXTS)), items)


@pytest.mark.parametrize("bound", [50_000, 3])
def test_cases(spark, monkeypatch, bound):
    check(spark, list(range(len(TEXTS))), ITEMS, bound, monkeypatch)
    check(spark, [None, 4, 4, None, *range(10)], ITEMS[2:7], bound, monkeypatch)


def test_repeated_rows_and_no_items(spark, monkeypatch):
    monkeypatch.setitem(globals(), "TEXTS", ["short item", "short item", "short item", None])
    check(spark, [1, 1, None, 1], ITEMS, 50_000, monkeypatch)
    check(spark, [1, 1, None, 1], [], 50_000, monkeypatch)
    empty = spark.createDataFrame([], "doc_id long, text string")
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contamination(empty, benchmark).count() == 0


def test_contaminated_rows_go(spark):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    ids = [None, *range(len(TEXTS) - 1)]
    docs = documents(spark, TEXTS, ids).selectExpr("*", "1 AS _id", "2 AS _t", "3 AS item_id")
    kept = decontaminate.remove_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    want = [x[0] for x in brute(list(zip(ids, TEXTS)), ITEMS) if not x[-1]]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    found = decontaminate.op9_decontaminate(spark, folder)
    want = con.execute(decontaminate.SQL)
    assert [d[0] for d in want.description] == found.columns
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(want.fetchall())
