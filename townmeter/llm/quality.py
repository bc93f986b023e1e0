"""Quality rules whose thresholds come from the corpus: quantile sketches per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townmeter.llm.common import Scratch, checked, words

#: Fixed cutoffs of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Measures held against adaptive thresholds, in thousandths: (name, numerator, denominator, whether the numerator counts rare events).
MEASURES = (("symbols", "n_symbols", "word_chars", False), ("dup_lines", "n_dup_lines", "n_lines", True), ("repeats", "n_repeat_words", "n_words", True), ("word_length", "word_chars", "n_words", False))
#: A group's own threshold is q90 + fence * (q90 - q50) + LEAST. Counts of rare events have long tails and so a wider fence;
#: LEAST is about what rounding to thousandths and cells can hide.
FENCE, RARE_FENCE, LEAST = 5, 25, 10
#: Weight, in documents, of the language's threshold in a group's, and of the overall one in a language's.
PRIOR = 500


def _windows(w: Column) -> Column:
    """64-bit hashes of the 3-word windows of a text, in order."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) >= 4, hashes).otherwise(F.array().cast("array<bigint>"))


def measured(docs: DataFrame, text: Column, **kept: Column) -> DataFrame:
    """The kept columns and a struct `m` of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, for each row of docs.

    Whole texts; a null text has no words. Sorting windows takes n log n for n words.
    """
    names = list(kept)
    first = docs.select(*[c.alias(k) for k, c in kept.items()], F.coalesce(text, F.lit("")).alias("t"), words(text).alias("w"))
    second = first.select("*", _windows(F.col("w")).alias("windows"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    # Only where some windows are equal are they sorted with their places; those equal to a neighbour repeat.
    placed = F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
    third = second.withColumn("sorted", F.when(F.size("windows") > F.size(F.array_distinct("windows")), placed))
    s = F.col("sorted")
    twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
    fourth = third.withColumn("places", F.when(s.isNotNull(), F.sort_array(F.transform(twice, lambda x: x["at"]))))
    covered = F.aggregate(
        F.col("places"), F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"],
    )
    return fourth.select(*names, F.struct(
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
    ).alias("m"))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def _thousandths(over: str, under: str, rare: bool) -> Column:
    """m's count per thousand of another; of rare events, only those beyond the square root of their number, the noise of a count, are taken."""
    n = F.col(f"m.{over}")
    evident = (n - F.ceil(F.sqrt(n.cast("double"))).cast("long")) if rare else n
    return F.when(F.col(f"m.{under}") > 0, F.call_function("div", 1000 * evident, F.col(f"m.{under}"))).otherwise(F.lit(0)).cast("long")


def _cell(v: Column) -> Column:
    """Cell of the quantile sketch: exact to 63, then the 6 leading bits. Sketches merge by adding counts; a quantile is off by under 1/32."""
    bits = F.length(F.bin(v)).cast("int")
    return F.when(v < 64, v).otherwise(F.call_function("shiftleft", F.call_function("shiftright", v, bits - 6), bits - 6)).cast("long")


def thresholds(scored: DataFrame, scratch: Scratch) -> DataFrame:
    """(g_lang, g_source, docs, limits): the upper limit of each measure for each language and source of scored (lang, source, m).

    Documents that passed the base rules count. A measure's values fall into the cells of a
    sketch, whose counts are summed per group before the shuffle; quantiles are read off running
    sums. Half of the documents lie at or under q50 and nine tenths at or under q90, so a tenth of
    outliers doesn't move a limit. Limits shrink to those of the language, and these to the
    overall ones: (docs * own + PRIOR * parent) / (docs + PRIOR), in whole numbers.
    """
    values = F.array(*[F.struct(F.lit(name).alias("measure"), _cell(_thousandths(a, b, rare)).alias("cell")) for name, a, b, rare in MEASURES])
    sketches = scratch.put(
        scored.filter(~base_failed(F.col("m"))).select("lang", "source", F.explode(values).alias("v"))
        .groupBy("lang", "source", "v.measure", "v.cell").agg(F.count("*").alias("n"))
    )
    no = F.lit(None).cast("string")
    level = lambda k, a, b: F.struct(F.lit(k).alias("level"), a.alias("lang"), b.alias("source"))
    merged = (
        sketches.select(F.explode(F.array(level(0, F.col("lang"), F.col("source")), level(1, F.col("lang"), no), level(2, no, no))).alias("g"), "measure", "cell", "n")
        .groupBy("g.level", "g.lang", "g.source", "measure", "cell").agg(F.sum("n").alias("n"))
    )
    group = Window.partitionBy("level", "lang", "source", "measure")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))).withColumn("docs", F.sum("n").over(group))
    at = lambda percent: F.min(F.when(100 * F.col("upto") >= percent * F.col("docs"), F.col("cell")))
    limits = scratch.put(
        ranked.groupBy("level", "lang", "source", "measure").agg(at(50).alias("q50"), at(90).alias("q90"), F.max("docs").alias("docs"))
        .withColumn("limit", F.col("q90") + F.when(F.col("measure").isin([k for k, _, _, rare in MEASURES if rare]), RARE_FENCE).otherwise(FENCE) * (F.col("q90") - F.col("q50")) + LEAST)
        .groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), *[F.max(F.when(F.col("measure") == k[0], F.col("limit"))).alias(k[0]) for k in MEASURES])
    )
    of = lambda k, name: limits.filter(F.col("level") == k).select(*[F.col(c).alias(f"{name}_{c}") for c in ("lang", "source", "docs", *[m[0] for m in MEASURES])])
    blend = lambda docs, own, parent: F.call_function("div", docs * own + PRIOR * parent, docs + PRIOR)
    names = [m[0] for m in MEASURES]
    langs = of(1, "l").crossJoin(of(2, "o")).select("l_lang", *[blend(F.col("l_docs"), F.col(f"l_{k}"), F.col(f"o_{k}")).alias(f"l_{k}") for k in names])  # one overall row
    return of(0, "g").join(langs, F.col("g_lang").eqNullSafe(F.col("l_lang"))).select(
        "g_lang", "g_source", F.col("g_docs").alias("docs"), F.struct(*[blend(F.col("g_docs"), F.col(f"g_{k}"), F.col(f"l_{k}")).alias(k) for k in names]).alias("limits")
    )


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", **kept: Column) -> DataFrame:
    """The kept columns, m (the counts), failed and good of each row of docs.

    failed: the base rules failed; good: they passed and no measure is over its group's limit. A
    null or empty text fails. Null languages and sources are groups of their own. Repeated rows
    get equal verdicts and count as often as they are there; an empty table gives an empty one.
    Whatever names docs has, only the kept columns are carried. The counts are written to the
    shared folder once and read for sketches and verdicts.
    """
    scratch = Scratch(docs.sparkSession)
    scored = scratch.put(measured(docs, F.col(text), lang=F.col(lang).cast("string"), source=F.col(source).cast("string"), **kept))
    limits = checked(scratch.put(thresholds(scored, scratch)))
    over = F.lit(False)
    for name, a, b, rare in MEASURES:
        over = over | (_thousandths(a, b, rare) > F.col("limits")[name])
    failed = base_failed(F.col("m"))
    return (
        scored.join(limits, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
        .select(*kept, "m", failed.alias("failed"), (~failed & ~F.coalesce(over, F.lit(False))).alias("good"))
    )


def quality_report(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per row of docs: key, the counts, base_failed, kept. Cases are defined as in judged(); the key may be null and of any type."""
    counts = [F.col("m")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged(docs, text, lang, source, id=F.col(key)).select(F.col("id").alias(key), *counts, F.col("failed").alias("base_failed"), F.col("good").alias("kept"))


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, whatever their names.

    Null and empty texts fail and go. Repeated rows stay or go together. An empty table gives an
    empty one. Very long texts are judged whole.
    """
    rows = judged(docs, text, lang, source, row=F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    return rows.filter("good").select("row.*")
