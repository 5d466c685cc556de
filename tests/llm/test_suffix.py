"""Repeated strings against brute force."""

import collections
import hashlib
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from counterpoise.llm import suffix
from tests.llm.conftest import documents


def brute(rows, window):
    """(doc_id, n_bytes, n_removed, n_spans, sha) of (doc_id, text) rows."""
    raws = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(r[k:k + window] for _, r in raws
                                for k in range(len(r) - window + 1))
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - window + 1):
            if count[r[k:k + window]] > 1:
                gone[k:k + window] = b"\x01" * window
        runs = bytes(gone).replace(b"\x00", b" ").split()
        kept = bytes(x for x, g in zip(r, gone) if not g)
        out.append((i, len(r), sum(gone), len(runs), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(rows, n):
    """(doc_id, words in runs of n words that come again, maximal runs)."""
    lists = [(i, (t or "").split()) for i, t in rows]
    count = collections.Counter(tuple(w[k:k + n]) for _, w in lists for k in range(len(w) - n + 1))
    out = []
    for i, w in lists:
        hit = [k for k in range(len(w) - n + 1) if count[tuple(w[k:k + n])] > 1]
        inside = {k + j for k in hit for j in range(n)}
        out.append((i, len(inside), sum(k - 1 not in inside for k in inside)))
    return sorted(out, key=str)


def check(spark, rows, window, gram, partitions=3):
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows], partitions)
    out = suffix.digests(docs, window, gram, 6, 3).collect()
    found = sorted((tuple(r)[:5] for r in out), key=str)
    assert found == brute(rows, window)
    assert sorted(((r.doc_id, r.n_passage_words, r.n_passages) for r in out), key=str) == passages(rows, 6)
    return found


@pytest.mark.parametrize("text", [
    b"", b"a", b"aaaaaaaaaaaaaaaaaaaaaaaaa", b"banana" * 9, b"\x00\x00ab\x00ab\x00", bytes(range(256)),
    b"abc\x00", b"ab\x00\x00\x00\x00\x00\x00\x00xab", np.random.default_rng(0).integers(
        0, 3, 3000, dtype=np.uint8).tobytes(), np.random.default_rng(1).bytes(2000) * 2])
def test_suffix_arrays_and_prefixes(text):
    data = np.frombuffer(text, np.uint8)
    order = suffix.suffix_array(data)
    want = sorted(range(len(text)), key=lambda k: text[k:])
    assert order.tolist() == want
    common = suffix.common_prefixes(data, order)
    for r, (a, b) in enumerate(zip(want, want[1:]), 1):
        assert common[r] == len(os.path.commonprefix([text[a:], text[b:]]))


def texts_with_repeats(seed, window):
    rng = np.random.default_rng(seed)

    def word():
        return "".join(rng.choice(list("abcdé"), rng.integers(1, 5)))

    passages = [" ".join(word() for _ in range(window)) for _ in range(4)]
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(rng.integers(1, 6)):
            if rng.random() < 0.5:
                own = passages[rng.integers(4)]
                a = rng.integers(0, len(own))
                parts.append(own[a:a + rng.integers(1, 4 * window)])
            else:
                parts.append(" ".join(word() for _ in range(rng.integers(1, window))))
        texts.append(" ".join(parts))
    texts += [texts[0], texts[1], "x" * 3 * window, "ab" * 2 * window, "", None, "z" * (window - 1),
              "q" * window, "q" * window]
    return texts


@pytest.mark.parametrize("window,gram", [(12, 4), (20, 8), (9, 9), (30, 1)])
@pytest.mark.parametrize("shard,contexts", [(1 << 20, 1500), (300, 2), (2000, 1)])
def test_removed_strings(spark, monkeypatch, window, gram, shard, contexts):
    monkeypatch.setattr(suffix, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix, "SHARD_CONTEXTS", contexts)
    texts = texts_with_repeats(window, window)
    found = check(spark, list(enumerate(texts)), window, gram)
    assert 0 < sum(r[2] for r in found) < sum(r[1] for r in found)


def test_rows_that_repeat_and_null_ids(spark):
    text = "one long enough text that comes again"
    rows = [(1, text), (1, text), (None, "another text that has no id at all"), (4, "short"),
            (None, "and a third one, alone as well, without"), (2, None), (2, None)]
    check(spark, rows, 12, 4)
    check(spark, rows[2:], 12, 4, partitions=1)
    assert suffix.digests(documents(spark, [])).count() == 0


def test_production_window(spark):
    rng = np.random.default_rng(5)
    fill = ["".join(rng.choice(list("abcdefgh "), 700)) for _ in range(12)]
    shared = "".join(rng.choice(list("stuvwxyz "), 900))
    texts = [*fill, fill[0] + shared[:400], shared[:399] + fill[1][:300], fill[2][:350] + shared[100:],
             "é" * 700, "be " * 500, shared[450:860]]
    found = check(spark, list(enumerate(texts)), suffix.WINDOW, suffix.GRAM)
    assert sum(r[3] > 0 for r in found) > 4


def test_whole_documents(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = suffix.digests(docs).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == brute(rows, 400)
    assert sorted(((r.doc_id, r.n_passage_words, r.n_passages) for r in found), key=str) == passages(rows, 51)


def test_texts_without_repeats_stay(spark):
    shared = "".join(np.random.default_rng(9).choice(list("stuvwxyzé"), 30))
    texts = ["only here, nothing else", "head " + shared + " tail", "start " + shared, None, ""]
    docs = documents(spark, texts)
    kept = suffix.without_repeats(docs, 12, 4)
    assert kept.columns == docs.columns
    rows = {r.doc_id: r for r in kept.collect()}
    assert rows[0].text == texts[0] and rows[3].text is None and rows[4].text == ""
    assert shared[5:20] not in rows[1].text and rows[1].text.startswith("head")
    assert rows[2].text.startswith("start") and rows[2].n_chars == len(rows[2].text)


def test_extra_columns_with_clashing_names(spark):
    text = "one long enough text that comes again"
    docs = documents(spark, [text, text, None, "other"]).selectExpr(
        "*", "1 AS row", "'z' AS txt", "2.5 AS found", "array(1) AS h", "doc_id AS n_chars2")
    kept = suffix.without_repeats(docs, 12, 4)
    assert kept.columns == docs.columns
    rows = {r.doc_id: r for r in kept.collect()}
    assert [rows[k].text for k in range(4)] == ["", "", None, "other"]
    assert all(r.row == 1 and r.txt == "z" and r.h == [1] for r in rows.values())
    assert suffix.digests(docs, 12, 4).count() == 4


def without_passages(texts, window, passage):
    """The texts without repeated strings of ``window`` bytes and ``passage`` words."""
    word = re.compile(r"\S+")
    raws = [t.encode() for t in texts]
    places = [[(len(t[:m.start()].encode()), len(t[:m.end()].encode())) for m in word.finditer(t)]
              for t in texts]
    lists = [t.split() for t in texts]
    strings = collections.Counter(r[k:k + window] for r in raws for k in range(len(r) - window + 1))
    runs = collections.Counter(tuple(w[k:k + passage]) for w in lists
                               for k in range(len(w) - passage + 1))
    out = []
    for raw, at, w in zip(raws, places, lists):
        gone = bytearray(len(raw))
        spans = [(k, k + window) for k in range(len(raw) - window + 1)
                 if strings[raw[k:k + window]] > 1]
        spans += [(at[k][0], at[k + passage - 1][1]) for k in range(len(w) - passage + 1)
                  if runs[tuple(w[k:k + passage])] > 1]
        for a, b in spans:
            gone[a:b] = b"\x01" * (b - a)
        out.append(bytes(x for x, g in zip(raw, gone) if not g).decode(errors="ignore"))
    return out


@pytest.mark.parametrize("shard,contexts", [(1 << 20, 1500), (300, 2)])
@pytest.mark.parametrize("window,passage,gram", [(400, 5, 2), (20, 4, 4), (30, 9, 1)])
def test_repeated_passages(spark, monkeypatch, window, passage, gram, shard, contexts):
    monkeypatch.setattr(suffix, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix, "SHARD_CONTEXTS", contexts)
    texts = [t or "" for t in texts_with_repeats(passage, 12)]
    texts += [texts[5].replace(" ", "\u2003\n"), texts[6].replace(" ", "\u00a0"), " ".join("a" * 40)]
    kept = suffix.without_repeats(documents(spark, texts), window, 8, passage, gram).collect()
    want = without_passages(texts, window, passage)
    assert [r.text for r in sorted(kept, key=lambda r: r.doc_id)] == want
    assert sum(map(len, want)) < sum(map(len, texts))


def test_the_stage_cuts_short_passages(spark):
    rng = np.random.default_rng(4)

    def words(n):
        return " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))

    short, long, under = words(51), "x" * 500, words(50)
    assert len(short) < 400
    texts = [words(80) + " " + short + " " + words(9), short.replace(" ", "\n") + " " + words(60),
             words(30) + " " + under, under + " " + words(30), words(5) + " " + long, long + "y"]
    rows = corpus_pipeline.cut_repeats(spark, documents(spark, texts), "").collect()
    kept = [r.text for r in sorted(rows, key=lambda r: r.doc_id)]
    assert kept[0].split() == (texts[0][:480] + texts[0][-53:]).split()
    assert kept[1].split() == texts[1].split()[51:]
    assert kept[2:4] == texts[2:4]
    assert "x" not in kept[4] and kept[5] == "y"
    assert kept == without_passages(texts, suffix.WINDOW, 51)
    assert all(r.n_chars == len(r.text) for r in rows)


def test_many_equal_rows_and_a_long_text(spark):
    text = " ".join(f"w{k}" for k in range(900))
    rows = [(7, text)] * 300
    found = suffix.digests(documents(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    assert {tuple(r)[1:4] + tuple(r)[5:] for r in found} == {(len(text), len(text), 1, 900, 1)}
    long = " ".join(f"t{k * 7919 % 1_000_003}" for k in range(600_000))
    part = long[2_000_000:2_000_700]
    texts = [long, "head " + part + " tail", "alone"]
    by_id = {r.doc_id: r for r in suffix.digests(documents(spark, texts)).collect()}
    assert [by_id[k].n_removed for k in range(3)] == [700, 700, 0]
    assert by_id[0].n_spans == by_id[0].n_passages == by_id[1].n_passages == 1


def test_dotted_column_names(spark):
    docs = documents(spark, ["a b c d e f"] * 2).withColumn("a.b", F.lit(3)).withColumn("row", F.lit(1))
    kept = suffix.without_repeats(docs, 5, 2, 3, 2)
    assert kept.columns == docs.columns and [r.text for r in kept.collect()] == ["", ""]
