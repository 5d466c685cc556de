"""License scan by ordered signature rules, in DataFrame functions only.

A text is reduced to its words, lower-cased and joined by blanks. Texts without any of the
words that keywords need are done; in the others each rule whose keyword
occurs gives the spans of words that its pattern matches. A span inside the span of a rule
that comes earlier in the order is suppressed; base phrases never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.llm.common import table
from counterpoise.llm.decontaminate import SEPARATORS
from counterpoise.llm.license_rules import BASE, BASE_CONFIDENCE, CONFIDENCE, rules

SPAN = "struct<first:int,beyond:int,section:int,rule:int,label:string>"
SECTIONS = len(CONFIDENCE)


def word_line(text: Column) -> Column:
    """The words of a text with one blank before and after each (null: a blank only).

    Letters are lower-cased as a whole, which for what patterns and word borders can tell
    is lower-casing A-Z, once the two characters that become ASCII letters are put aside.
    """
    kept = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("¶")),
                     F.lit("İ"), F.lit("¶"))
    inner = F.trim(F.regexp_replace(F.lower(kept), SEPARATORS, " "))
    return F.when(inner == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def word_count(line: Column) -> Column:
    return F.when(F.trim(line) == "", F.lit(0)).otherwise(_blanks(line) - 1).cast("long")


def _spans(line: Column, pattern: Column) -> Column:
    """(first, beyond) word numbers of the matches of ``pattern`` (blank, words, blank ahead)."""
    pieces = F.transform(F.split(line, pattern, -1), _blanks)
    found = F.transform(F.regexp_extract_all(line, pattern, F.lit(0)), _blanks)
    return F.aggregate(
        F.arrays_zip(pieces.alias("gap"), found.alias("size")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,beyond:int>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.coalesce(x["size"], F.lit(0))).alias("at"),
            F.when(x["size"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + x["gap"]).alias("first"),
                (acc["at"] + x["gap"] + x["size"]).alias("beyond"))))).alias("out")))["out"]


def _rule_table() -> Column:
    return F.array(*(F.struct(
        F.lit(section).alias("section"), F.lit(k).alias("rule"), F.lit(label).alias("label"),
        F.lit(keyword).alias("keyword"), F.lit(f" (?:{pattern})(?= )").alias("pattern"))
        for k, (section, label, keyword, pattern) in enumerate(rules())))


#: Whole words in which a keyword that ends inside a word can occur.
_GROWN = {
    "licen": ["license", "licence", "licensed", "licenced", "licenses", "licences", "licensing"],
    "unauthori": ["unauthorized", "unauthorised"], "gpl": ["gpl", "gpl2", "gpl3", "gplv2", "gplv3"],
    "lgpl": ["lgpl", "lgpl2", "lgpl3", "lgplv2", "lgplv3"], "agpl": ["agpl", "agpl3", "agplv3"],
    "trademark": ["trademark", "trademarks"], "patent": ["patent", "patents"],
    "openrail": ["openrail", "openrailm"],
}


def gate_words() -> list[str]:
    """Words of which every text has one that holds any keyword or base phrase."""
    found = set()
    for keyword in {k for _, _, k, _ in rules()} | {p for p, _ in BASE}:
        words = keyword.split()
        whole = [w for w in words if w not in _GROWN]
        found.update([max(whole, key=len)] if whole else _GROWN[words[0]])
    return sorted(found)


def _no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def rule_spans(line: Column) -> Column:
    """Spans of the rules' matches that no earlier rule's span contains, by place."""
    tried = F.filter(_rule_table(), lambda r: F.contains(line, r["keyword"]))
    found = F.flatten(F.transform(tried, lambda r: F.transform(
        _spans(line, r["pattern"]), lambda s: F.struct(
            s["first"].alias("first"), (-s["beyond"]).alias("beyond"),
            r["section"].alias("section"), r["rule"].alias("rule"), r["label"].alias("label")))))
    # by start, longest first: what may contain a span stands before it; ``reach[s]`` is
    # the furthest end among the spans of sections up to s so far
    kept = F.aggregate(
        F.array_sort(found),
        F.struct(F.array_repeat(F.lit(0), SECTIONS).alias("reach"), _no_spans().alias("out")),
        lambda acc, x: F.struct(
            F.transform(acc["reach"], lambda r, s: F.when(
                s >= x["section"], F.greatest(r, -x["beyond"])).otherwise(r)).alias("reach"),
            F.when(F.get(acc["reach"], x["section"]) >= -x["beyond"], acc["out"]).otherwise(
                F.concat(acc["out"], F.array(F.struct(
                    x["first"].alias("first"), (-x["beyond"]).alias("beyond"),
                    x["section"].alias("section"), x["rule"].alias("rule"),
                    x["label"].alias("label"))))).alias("out")))["out"]
    return kept


def base_spans(line: Column) -> Column:
    """Every place where a base phrase's words stand consecutively."""
    return F.concat(*(
        F.when(F.contains(line, F.lit(f" {phrase} ")), _labelled(line, phrase, label, k))
        .otherwise(_no_spans()) for k, (phrase, label) in enumerate(BASE)))


def _labelled(line: Column, phrase: str, label: str, k: int) -> Column:
    return F.transform(_spans(line, F.lit(f" {phrase}(?= )")), lambda s: F.struct(
        s["first"].alias("first"), s["beyond"].alias("beyond"), F.lit(-1).alias("section"),
        F.lit(k - len(BASE)).alias("rule"), F.lit(label).alias("label")))


def license_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base and found (arrays of spans: first word, word beyond the last,
    section, rule, label) of every row; a null text has no words."""
    line = F.col("_line")
    known = gate_words()
    gate = F.exists(F.split(line, " "), lambda w: w.isin(known))
    rows = docs.select("doc_id", word_line(F.col("text")).alias("_line"))
    return rows.select(
        "doc_id", word_count(line).alias("n_words"),
        F.when(gate, base_spans(line)).otherwise(_no_spans()).alias("base"),
        F.when(gate, rule_spans(line)).otherwise(_no_spans()).alias("found"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    A null or wordless text has no matches; rows that repeat come back each; a null doc_id
    is kept; other columns are not read; an empty table gives no rows. The score is the
    confidence of the best match, 0 without one. Everything happens inside a row.
    """
    def labels(spans: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(
            spans, lambda s: s["label"]))), ",")

    starts = F.transform("base", lambda s: s["first"].cast("long"))
    best = F.array_max(F.transform("found", lambda s: F.get(
        F.array(*map(F.lit, CONFIDENCE)), s["section"])))
    base = F.when(F.size("base") > 0, F.lit(BASE_CONFIDENCE)).otherwise(F.lit(0.0))
    return license_spans(docs).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(F.col("base")).alias("base_labels"),
        labels(F.concat("base", "found")).alias("labels"),
        F.greatest(base, F.coalesce(best, F.lit(0.0))).alias("score"))


def op5_license_scan(spark, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents"))


QUERIES = {"op5_license_scan": op5_license_scan}
ORACLE: dict[str, str] = {}
