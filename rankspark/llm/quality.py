"""Quality rules with thresholds learnt per language and source.

Every document is measured once with array functions. Each measure is turned into an integer and
counted in a quantile sketch: a histogram whose buckets keep the leading six bits of a value, so the
relative error of a quantile is below 1/32 and two sketches merge by adding counts. Sketches are
built per (lang, source) from the documents that pass the base rules, and merged into one per language
and one overall. A limit is the median of the group's sketch plus ``reach`` times the distance from there
to an upper quantile (to a lower one, where low values are rejected too). The quantiles of a group of n
documents are drawn towards those of its language by n : ``weight``, and those of a language towards the
whole in the same way, so a small group moves to its own limits as it grows and nothing switches over.
Only where a group has no tail at all does the distance become a stated least one.

Cases: a null text has no words (all counts 0, base_failed); null lang or source form groups of
their own; repeated rows are judged alike, each on its own; an empty table gives no rows; other
columns of the input are left alone whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.llm.common import WORD_CHAR, let, stored, with_row, words

WINDOW = 8  # words in a repeated window
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
SYMBOLS = "[#*$%&|<>]"

#: measure -> (quantile of the tail per 1000, reach, least distance taken, whether low values are rejected too)
MEASURES = {
    "word_len": (950, 3, 10, True),  # mean word length, in hundredths of a character
    "symbols": (900, 3, 10, False),  # symbols per 1000 characters in words
    "dup_lines": (990, 2, 60, False),  # repeated lines per 1000 lines
    "repeats": (990, 2, 30, False),  # words in repeated windows per 1000 words
}
WEIGHT = 200  # documents that the wider sketch counts for
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated_words(hashes: Column, n: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more in the text, by their hashes."""

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def twins(s: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(s, j)["x"] == e["x"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["i"]))

        def union(p: Column) -> Column:
            new = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
            return F.aggregate(new, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(ranked, lambda s: let(twins(s), union)))

    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))
    return F.when(n < WINDOW, 0).otherwise(let(windows, covered))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (the whole input row) with the counts of its text and the integer measures."""
    body = F.coalesce(F.col(text), F.lit(""))
    d = with_row(docs, body.alias("t"))
    d = d.select("row", "t", words(F.col("t")).alias("ws"),
                 F.filter(F.split("t", "\n"), lambda line: line.rlike(WORD_CHAR)).alias("lines"))
    d = d.select("*", F.transform("ws", lambda w: F.xxhash64(w)).alias("hashes"))
    d = d.select(
        "row",
        F.size("ws").cast("long").alias("n_words"),
        F.char_length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        F.size(F.regexp_extract_all("t", F.lit(SYMBOLS), F.lit(0))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("hashes"), F.size("ws")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )
    share = lambda part, whole, by: F.expr(f"{part} * {by} div greatest({whole}, 1)")
    return d.select(
        "*",
        share("word_chars", "n_words", 100).alias("word_len"),
        share("n_symbols", "word_chars", 1000).alias("symbols"),
        share("n_dup_lines", "n_lines", 1000).alias("dup_lines"),
        share("n_repeat_words", "n_words", 1000).alias("repeats"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))).alias("base_failed"),
    )


def sketch(measured: DataFrame, lang: Column, source: Column) -> DataFrame:
    """One row per (lang, source, measure, bucket) with its count of documents."""
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES)))
    return (
        measured.where(~F.col("base_failed"))
        .select(lang.alias("lang"), source.alias("source"), values.alias("m"))
        .select("lang", "source", "m.measure", F.expr("greatest(length(bin(m.v)) - 6, 0)").alias("shift"), "m.v")
        .groupBy("lang", "source", "measure", F.expr("shiftleft(shiftright(v, shift), shift)").alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def _quantiles(buckets: DataFrame, keys: list[str]) -> DataFrame:
    """Lower tail, median and upper tail of each merged sketch: one row per ``keys`` and measure."""
    merged = buckets.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")  # at most a few hundred buckets
    tail = F.create_map(*(F.lit(x) for m, (per_mille, *_) in MEASURES.items() for x in (m, per_mille)))[F.col("measure")]
    ranked = merged.select(
        "*",
        F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("up_to"),
        F.sum("n").over(group).alias("docs"),
        tail.alias("tail"),
    )
    at = lambda part: F.min(F.when(1000 * F.col("up_to") >= part * F.col("docs"), F.col("bucket")))
    return ranked.groupBy(*keys, "measure").agg(
        F.max("docs").alias("docs"), at(1000 - F.col("tail")).alias("low"), at(F.lit(500)).alias("mid"), at(F.col("tail")).alias("high"))


def thresholds(buckets: DataFrame, weight: int = WEIGHT) -> DataFrame:
    """Lowest and highest accepted value of each measure, one row per (lang, source)."""
    own, by_lang, overall = (_quantiles(buckets, k) for k in (["lang", "source"], ["lang"], []))
    by_lang = by_lang.select(F.col("lang").alias("l"), F.col("measure").alias("ml"), *(F.col(c).alias(f"lang_{c}") for c in ("docs", "low", "mid", "high")))
    overall = overall.select(F.col("measure").alias("mo"), *(F.col(c).alias(f"all_{c}") for c in ("low", "mid", "high")))
    drawn = lambda docs, q, wider: F.expr(f"({docs} * {q} + {weight} * {wider}) div ({docs} + {weight})")
    joined = (
        own.join(by_lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("ml")))
        .join(overall, F.col("measure") == F.col("mo"))
        .withColumns({f"lang_{q}": drawn("lang_docs", f"lang_{q}", f"all_{q}") for q in ("low", "mid", "high")})
        .withColumns({q: drawn("docs", q, f"lang_{q}") for q in ("low", "mid", "high")})
    )
    columns = []
    for m, (_, reach, least, both) in MEASURES.items():
        pick = lambda v, m=m: F.max(F.when(F.col("measure") == m, v))
        columns.append(pick(F.col("mid") + reach * F.greatest(F.col("high") - F.col("mid"), F.lit(least))).alias(f"{m}_most"))
        if both:
            columns.append(pick(F.col("mid") - reach * F.greatest(F.col("mid") - F.col("low"), F.lit(least))).alias(f"{m}_least"))
    return joined.groupBy("lang", "source").agg(*columns)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          weight: int = WEIGHT) -> DataFrame:
    """``row`` (the input row), the counts, ``base_failed`` and ``kept``, one row per document."""
    m = stored(measure(docs, text), "quality-measures")
    limits = stored(thresholds(sketch(m, F.col("row")[lang], F.col("row")[source]), weight), "quality-limits")
    limits = limits.withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    ok = F.lit(True)
    for name, (*_, both) in MEASURES.items():
        ok = ok & F.coalesce(F.col(name) <= F.col(f"{name}_most"), F.lit(True))
        if both:
            ok = ok & F.coalesce(F.col(name) >= F.col(f"{name}_least"), F.lit(True))
    on = F.col("row")[lang].eqNullSafe(F.col("of_lang")) & F.col("row")[source].eqNullSafe(F.col("of_source"))
    return m.join(limits, on, "left").select("row", *COUNTS, "base_failed", (~F.col("base_failed") & ok).alias("kept"))
