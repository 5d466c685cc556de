"""Document fingerprints by spot signatures, in DataFrame functions only.

A spot is a common word; its signature is the spot and the chain of content words that
follow it, common words skipped. A text's fingerprint is the set of its signatures,
written as a string; the likeness of two texts is the Jaccard similarity of the sets.
Texts without a signature have one that stands for all their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.llm.common import stored, table
from counterpoise.llm.decontaminate import SEPARATORS

#: Content words in a chain.
CHAIN = 3

#: Common words of four languages; they are the spots and no content.
COMMON = (
    "the of and to in is a that for on with as was by this be are or it from at not he she they "
    "der die das und den von ist mit zu ein eine auf für im dem nicht des sich als auch "
    "el la los las de que y en un una por con del se lo su para al como "
    "le les et du dans est sur au pas qui une aux ce il elle").split()

#: Rows of a range of ids in which neighbours are found together, and the most ranges.
RANGE_ROWS, MOST_RANGES = 512, 16_384

THRESHOLD = 0.8

#: Classes under one signature and length part that are compared in one task.
GROUP_ROWS = 2048


def signatures(words: str) -> Column:
    """Distinct signatures (32 bits each), sorted, from the array column named ``words``."""
    def spot(k: Column) -> Column:
        here, before = F.get("_content", k), F.when(k == 0, F.lit(-1)).otherwise(
            F.get("_content", k - 1))
        return here - before > 1

    def chain(k: Column) -> Column:
        first = F.get("_content", k)
        return F.hash(F.get(words, first - 1), F.get(words, first), *(
            F.get(words, F.get("_content", k + n)) for n in range(1, CHAIN)))

    last = F.size("_content") - CHAIN
    heads = F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), spot))
    found = F.array_sort(F.array_distinct(F.transform(heads, chain)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.hash(F.lit("whole"), words)))


def with_signatures(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the array column ``name`` of the signatures of column ``text`` (null: empty)."""
    common = sorted(set(COMMON))
    rows = docs.withColumn("_words", F.filter(
        F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SEPARATORS), lambda w: w != ""))
    rows = rows.withColumn("_content", F.filter(
        F.transform("_words", lambda w, k: F.when(~w.isin(common), k)), lambda k: k.isNotNull()))
    return rows.withColumn(name, signatures("_words")).drop("_words", "_content")


def written(found: Column) -> Column:
    """Signatures as a string of eight hex digits each; equal sets, equal strings."""
    return F.lower(F.array_join(F.transform(found, lambda s: F.lpad(F.hex(
        s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""))


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two columns of distinct signatures."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _ranges(docs: DataFrame) -> tuple[list[int], int]:
    """Borders that cut the ids into ranges of about RANGE_ROWS rows."""
    rows = docs.agg(F.count("*")).first()[0]
    n = max(1, min(MOST_RANGES, rows // RANGE_ROWS))
    if n == 1:
        return [], rows
    borders = docs.agg(F.percentile_approx(
        "doc_id", [k / n for k in range(1, n)], max(10_000, 4 * n))).first()[0] or []
    return sorted(set(borders)), rows


def _place(doc_id: Column, borders: list[int]) -> Column:
    """The number of ``borders`` up to ``doc_id``, found in two steps; null: 0."""
    if not borders:
        return F.lit(0)
    step = max(1, int(len(borders) ** 0.5))
    coarse, whole = (F.array(*map(F.lit, b)) for b in (borders[::step], borders))
    block = F.size(F.filter(coarse, lambda b: b <= doc_id))
    inner = F.size(F.filter(F.slice(whole, (block - 1) * step + 1, step), lambda b: b <= doc_id))
    return F.when(block == 0, 0).otherwise((block - 1) * step + inner)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sigs, next_text, next_sigs): every row and the next one by doc_id.

    After the last row comes the first. Nulls come first, equal ids by text. Rows are
    dealt to ranges of ids; the first rows of a range are also dealt, as guests, to the
    range before it, so that each row meets its successor without a global order.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    borders, _ = _ranges(rows)
    rows = rows.withColumn("_place", F.coalesce(_place(F.col("doc_id"), borders), F.lit(0)))
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id"))
    firsts = sorted((r["_place"], r["first"]["known"], r["first"]["doc_id"]) for r in
                    rows.groupBy("_place").agg(least.alias("first")).collect())
    if not firsts:
        firsts = [(0, False, None)]
    places = [p for p, _, _ in firsts]
    before = dict(zip(places, [places[-1], *places]))
    home = F.create_map(*(F.lit(x) for p, _, i in firsts if i is not None for x in (i, before[p])))
    guest_of = home[F.col("doc_id")] if any(i is not None for _, _, i in firsts) else F.lit(None)
    if firsts[0][2] is None:  # null ids come first of all
        guest_of = F.when(F.col("doc_id").isNull(), F.lit(before[places[0]])).otherwise(guest_of)
    around = (F.col("_place") == places[0]).alias("around")
    dealt = rows.withColumn("_deal", F.array_compact(F.array(
        F.struct(F.col("_place").alias("at"), F.lit(0).alias("guest")),
        F.when(guest_of.isNotNull(), F.struct(guest_of.cast("int").alias("at"), F.when(
            around, 2).otherwise(1).alias("guest"))))))
    dealt = dealt.select("doc_id", "text", F.explode("_deal").alias("_deal"))
    dealt = dealt.select("doc_id", "text", "_deal.at", "_deal.guest").repartition("at")
    dealt = with_signatures(dealt, "text", "sigs")
    order = Window.partitionBy("at").orderBy("guest", "doc_id", "text")
    return (dealt.withColumn("next_text", F.lead("text").over(order))
            .withColumn("next_sigs", F.lead("sigs").over(order))
            .filter("guest = 0").drop("at", "guest"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with their likeness.

    Edited: the last floor(n/2) of n code points replaced by as many (or all) of the next
    row's, by doc_id, from its start. A null text is empty; rows that repeat are each
    other's successors; a single row follows itself; other columns are not read; an empty
    table gives no rows.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("_edited", F.concat(
        F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")),
        F.substring("next_text", F.lit(1), half)))
    rows = with_signatures(rows, "_edited", "_edited_sigs")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("sigs")).alias("fingerprint"),
        written(F.col("_edited_sigs")).alias("edited_fingerprint"),
        likeness("sigs", "_edited_sigs").alias("near_edited"),
        likeness("sigs", "next_sigs").alias("near_next"))


def _least(x: Column) -> Column:
    """The smallest whole number from ``x`` on, rounding errors of ``x`` aside."""
    return F.ceil(x - 1e-9)


def _dealt(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``a`` and ``b``: of groups of one (spot, part) with more than
    GROUP_ROWS rows, every part of the left side meets every part of the right one."""
    def parts(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("spot", "part").agg(
            F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias(name))

    cut = parts(left, "ka").join(parts(right, "kb"), ["spot", "part"]).filter("ka > 1 OR kb > 1")
    cut = F.broadcast(cut)  # a row per GROUP_ROWS rows at most

    def side(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        rows = rows.join(cut, ["spot", "part"], "left").fillna(1, ["ka", "kb"])
        return (rows.withColumn(own, F.pmod(F.xxhash64(key), f"k{own}").cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"k{other}") - 1)))
                .drop("ka", "kb"))

    return side(left, "x", "a", "b"), side(right, "y", "b", "a")


def candidates(sized: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b) of classes that may be alike, some of them several times.

    ``sized`` has class_id, size, part and sigs. The signatures of a class are in order,
    the rarest first. With x the smaller of two alike classes, the first signature that
    both have lies so early in x, and in y, that enough can follow in both.
    """
    spots = sized.select("class_id", "size", "part", F.explode("sigs").alias("spot"))
    held = spots.groupBy("spot").agg(F.count("*").alias("held"))
    rank = F.row_number().over(Window.partitionBy("class_id").orderBy("held", "spot"))
    rare = (spots.join(held, "spot").withColumn("rank", rank)
            .filter(F.col("rank") <= F.col("size") - _least(F.col("size") * threshold) + 1)
            .select("class_id", "size", "part", "spot", "rank"))
    both = threshold / (1 + threshold)  # alike: as much of both sizes together is shared
    left = (rare.filter(F.col("rank") <= F.col("size") - _least(F.col("size") * (2 * both)) + 1)
            .select(F.col("class_id").alias("x"), F.col("size").alias("n"), "spot",
                    F.col("rank").alias("i"), F.explode(F.array("part", F.col("part") + 1)).alias("part")))
    right = rare.select(F.col("class_id").alias("y"), F.col("size").alias("m"), "spot",
                        F.col("rank").alias("j"), "part")
    left, right = _dealt(left, right)
    most = 1 + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    return (left.join(right, ["spot", "part", "a", "b"])
            .filter((F.col("x") != F.col("y")) & (F.col("n") <= F.col("m"))
                    & (F.col("n") >= F.col("m") * threshold - 1e-9)
                    & (most >= _least((F.col("n") + F.col("m")) * both)))
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Classes of equal fingerprints and the pairs of classes that are alike.

    Returns (doc_id, class_id) of every row and (a, b, similarity) of every pair of classes
    a < b whose Jaccard similarity is at least ``threshold``; a class is named by the hash
    of its fingerprint. Sets are partitioned by length: with sizes l <= m alike means
    l >= threshold * m, so a set only meets its own part and the next. Inside, two sets
    meet under a signature among the rarest of both (enough of each that alike sets share
    one), and only if their lengths and the signature's places still allow the threshold.
    """
    sets = with_signatures(docs.select("doc_id", "text"), "text", "sigs")
    rows = stored(sets.select("doc_id", "sigs", F.xxhash64("sigs").alias("class_id")), "spots")
    classes = rows.groupBy("class_id").agg(F.any_value("sigs").alias("sigs"))
    sized = classes.withColumn("size", F.size("sigs")).withColumn("part", F.floor(
        F.log(F.col("size").cast("double")) / F.lit(-1.0) / F.log(F.lit(threshold))).cast("int"))
    met = candidates(sized, threshold).distinct()
    a, b = (classes.select(F.col("class_id").alias(k), F.col("sigs").alias(f"_{k}")) for k in "ab")
    pairs = (met.join(a, "a").join(b, "b").withColumn("similarity", likeness("_a", "_b"))
             .filter(F.col("similarity") >= threshold).select("a", "b", "similarity"))
    return rows.select("doc_id", "class_id"), pairs


def op4_fingerprints(spark, folder: str) -> DataFrame:
    return fingerprint_edits(table(spark, folder, "documents"))


QUERIES = {"op4_fingerprints": op4_fingerprints}
ORACLE: dict[str, str] = {}
