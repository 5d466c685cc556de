"""Token ids, separator scan and packing against the tokenizer itself."""

import collections
import os
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from counterpoise.llm import packing, separators, tokens  # noqa: E402
from tests.llm.conftest import DOC_SCHEMA, documents  # noqa: E402

TEXTS = [
    "", None, " \n\t ", "Plain words, and more. Don't stop!", "É été Ñoco ción, straße: ÄÖÜ?",
    "a<|endoftext|>b <|startoftext|> x|y <tag>", "1234 3.14 a1b2 v2.0 $$$ ### end.", "İstanbul İ K",
    "é ñ. H̱ ẖ, x̸", "日本語 のテキスト。 ok", "x" * 5000, "tab\there\x0bva\x1cfs",
    "word " * 3000, "it's we'll 'quoted' o'clock's.", " nbsp em space\u0085nel", "à. é, ×. ÷, ñ!",
]


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    return [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]


def test_ids_equal_the_tokenizers():
    raw = [(x or "").encode() for x in TEXTS]
    offsets = np.cumsum([0] + [len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    for _ in range(2):  # the second time from memory
        ids, lengths = tokens.pieces(tokens.vocabulary_path()).encode(data, offsets)
        ends = np.cumsum(lengths)
        for want, a, n in zip(reference(), ends - lengths, lengths):
            assert ids[a:a + n].tolist() == want


def test_ids_equal_on_documents(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    raw = [(r.text or "").encode() for r in rows]
    ids, lengths = tokens.pieces(tokens.vocabulary_path()).encode(
        np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    want = [e.ids for e in t.encode_batch([r.text or "" for r in rows], add_special_tokens=False)]
    assert lengths.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_separator_scan_counts_every_document(spark):
    special = [sum(i == separators.END for i in x) for x in reference()]
    want = collections.Counter(
        (k, len(x) - s) for k, (x, s) in enumerate(zip(reference(), special)))
    found = separators.document_token_counts(documents(spark, TEXTS))
    assert collections.Counter(map(tuple, found.collect())) == want
    assert separators.document_token_counts(documents(spark, [])).count() == 0


def test_spelled_special_tokens_count_as_the_tokenizer_has_them(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    texts = ["<|endoftext|>", "a <|ENDOFTEXT|> b", "A<|EndOfText|>B<|endoftext|>C", "<|", "X<",
             "|Y", "<|STARTOFTEXT|>", "no special token", "<|endoftext|><|endoftext|>"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert separators.END >= t.get_vocab_size()
    found = separators.document_token_counts(documents(spark, texts)).collect()
    assert sorted(map(tuple, found)) == [(k, len(x)) for k, x in enumerate(want)]
    check_packing(packing.pack(documents(spark, texts)).collect(),
                  {k: x + [packing.END] for k, x in enumerate(want)}, packing.Limits())
    with pytest.raises(ValueError):
        separators.document_token_counts(documents(spark, texts), end=49407)


@pytest.mark.parametrize("block,run", [(1, 2), (3, 2), (7, 3), (1000, 2)])
def test_blocks_are_stitched(spark, monkeypatch, block, run):
    monkeypatch.setattr(separators, "RUN", run)
    rng = np.random.default_rng(block)
    want, rows = [], []
    for file in range(3):
        lengths = rng.integers(0, 9, 12).tolist() + [40, 0, 0]
        ids = np.concatenate([np.append(rng.integers(0, 100, n), 500) for n in lengths])
        ids = np.append(ids, [7] * file).astype("<u2")  # ids without an end
        want += [(file, k, n) for k, n in enumerate(lengths)]
        rows += [(file, k, ids[a:a + block].tobytes())
                 for k, a in enumerate(range(0, len(ids), block))]
    blocks = spark.createDataFrame(rows, "file int, block long, data binary")
    found = separators.token_counts(blocks, 500)
    assert sorted(map(tuple, found.collect())) == want


def check_packing(rows, want, limits):
    """Every id in one piece, sequences gapless and within the limits."""
    pieces = collections.defaultdict(list)
    places = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for key, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want[key])
            ids = np.array(want[key][at:at + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(ids.tobytes())
            at += r.length
        assert at == len(want[key])
    for own in places.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and len(own) <= limits.segments
        assert sum(r.loss_tokens for r in own) <= limits.loss
    return [sum(r.length for r in own) for own in places.values()]


def test_packing_places_every_id(spark):
    want = {k: x + [1] for k, x in enumerate(reference())}
    limits = packing.Limits(tokens=64, segments=4, loss=64, block=8)
    sizes = check_packing(packing.pack(documents(spark, TEXTS), limits=limits).collect(),
                          want, limits)
    assert sum(s != 64 and s & (s - 1) > 0 for s in sizes) <= 6, sizes
    assert packing.pack(documents(spark, [])).count() == 0


def test_packing_with_loss_column(spark):
    docs = documents(spark, TEXTS).selectExpr("doc_id", "text", "doc_id * 3 AS prompt", "1 AS start")
    limits = packing.Limits(tokens=64, segments=4, loss=40, block=8)
    want = {k: x + [1] for k, x in enumerate(reference())}
    check_packing(packing.pack(docs, limits=limits, loss_from="prompt").collect(), want, limits)


def test_repeated_rows_and_null_ids(spark):
    rows = [(5, "same text", "en", "s", 9)] * 3 + [(None, "no id", None, None, None)]
    found = packing.pack(spark.createDataFrame(rows, DOC_SCHEMA)).collect()
    assert collections.Counter(r.doc_id for r in found if r.start == 0) == {5: 3, None: 1}
    counts = separators.document_token_counts(spark.createDataFrame(rows, DOC_SCHEMA)).collect()
    assert collections.Counter(r.doc_id for r in counts) == {5: 3, None: 1}


def test_uncut_examples_respect_all_limits():
    rng = np.random.default_rng(0)
    length = rng.integers(1, 50, 200)
    loss_from = rng.integers(0, 50, 200)
    limits = packing.Limits(tokens=64, segments=3, loss=30)
    length = np.minimum(length, loss_from + 30)
    made = packing.pack_block(length, loss_from, np.zeros(200, np.int64), limits, cut=False)
    assert sorted(i for parts in made for i, _, _ in parts) == list(range(200))
    for parts in made:
        assert sum(n for _, _, n in parts) <= 64 and len(parts) <= 3
        assert sum(max(0, n - loss_from[i]) for i, _, n in parts) <= 30
    with pytest.raises(ValueError):
        packing.pack_block(np.array([65]), np.array([0]), np.array([0]), limits, cut=False)
