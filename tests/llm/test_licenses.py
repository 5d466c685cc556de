"""License scan against a plain Python version and against texts made from its patterns."""

import random
import re

import pytest
from hypothesis import HealthCheck, Phase, given, seed, settings
from hypothesis import strategies as st

from counterpoise.llm import licenses
from counterpoise.llm.license_rules import BASE, CONFIDENCE, rules
from tests.llm.conftest import documents

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text):
    words = words_of(text)
    base = sorted((k, label) for phrase, label in BASE for k in range(len(words))
                  if words[k:k + len(phrase.split())] == phrase.split())
    line = "".join(f" {w.lower()}" for w in words) + " "
    spans = []
    for number, (section, label, keyword, pattern) in enumerate(rules()):
        if keyword in line:
            for m in re.finditer(f" (?:{pattern})(?= )", line):
                first = line[:m.start()].count(" ")
                spans.append((first, -(first + m[0].count(" ")), section, number, label))
    kept = []
    for k, x in enumerate(sorted(spans)):
        if not any(y[2] <= x[2] and -y[1] >= -x[1] for y in sorted(spans)[:k]):
            kept.append(x)
    score = max([0.8] * bool(base) + [CONFIDENCE[x[2]] for x in kept] + [0.0])
    return (len(words), len(base), min(base)[0] if base else None, max(base)[0] if base else None,
            ",".join(sorted({b for _, b in base})),
            ",".join(sorted({b for _, b in base} | {x[4] for x in kept})), score)


def check(spark, texts):
    found = {r.doc_id: tuple(r)[1:] for r in licenses.scan(documents(spark, texts)).collect()}
    for k, text in enumerate(texts):
        assert found[k] == brute(text), text


def test_edge_cases(spark):
    check(spark, [
        None, "", " . ", "cc", "CC-BY cc by CC  by", "cc by cc", "all rights reserved.\nAll Rights",
        "ALL RIGHTS RESERVED", "GNU General Public License, version 3", "the general public license",
        "KC BY İ LİCENSE cc by", "Éé cc by Ñ", "cc by nc", "x" * 100_000 + " cc by",
        "Licensed under the Apache License, Version 2.0. Released under the MIT License.",
        "plain words " * 5000 + "all rights reserved " * 300, "cc\x00by", "İ licensed under"])
    assert licenses.scan(documents(spark, [])).count() == 0


def test_rows_that_repeat_and_other_columns(spark):
    docs = documents(spark, ["cc by"] * 3, [1, 1, None]).selectExpr("*", "1 AS _line", "2 AS base")
    assert sorted((r.doc_id, r.n_base) for r in licenses.scan(docs).collect() if r.doc_id) == [
        (1, 1), (1, 1)]


def test_there_are_hundreds_of_rules():
    assert len(rules()) > 200 and len(set(rules())) == len(rules())


def test_every_rule_is_reached_through_gate_and_keyword():
    known = set(licenses.gate_words())
    for _, _, keyword, pattern in rules():
        @seed(1)
        @settings(max_examples=15, database=None, deadline=None, phases=[Phase.generate],
                  suppress_health_check=list(HealthCheck))
        @given(st.from_regex(pattern.replace("[^ ]", "[a-z]"), fullmatch=True))
        def reached(text):
            assert keyword in text, (keyword, text)
            assert known & set(text.split()), (keyword, text)
        reached()


@pytest.mark.parametrize("start", [0, 1])
def test_generated_texts(spark, start):
    rng = random.Random(start)
    fill = "the of public license under version 2 0 3 cc by nc all rights reserved gpl".split()
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            _, _, _, pattern = rng.choice(rules())
            sample = re.sub(r"\(\?:([^()|]*)[^()]*\)[*?+]?(\{\d+,\d+\})?", r"\1", pattern)
            parts.append(re.sub(r"[?*\[\]()]|\{.*?\}", "", sample))
            parts += rng.choices(fill, k=rng.randrange(4))
        texts.append(rng.choice([" ", ", ", "\n"]).join(parts))
    check(spark, texts)
