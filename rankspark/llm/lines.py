"""Line dedup over overlapping windows of three consecutive lines.

Lines with a word are numbered in order; each run of three is hashed (128 bits in two halves). A
window found more than once, in any documents, is kept where it occurs first, by document id and
place, and its lines are removed everywhere else; overlapping windows merge into one covered range.
Hashes are counted with partial aggregation, so a window shared by a third of all documents reaches
its reducer as one row per task.

Cases: lines without a word are never counted nor removed; a text with fewer than three lines with
words has no window and stays; a null text stays null; rows that agree in id and text are one document
and are treated alike; rows without id come first in the order; other columns keep names and values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import WORD_CHAR, let, stored, with_row

LINES = 3


def _numbered(lines: Column) -> Column:
    """Lines with a word and their places in the text."""
    placed = F.transform(lines, lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    return F.filter(placed, lambda x: x["line"].rlike(WORD_CHAR))


def windows(docs: DataFrame) -> DataFrame:
    """(doc, version, p, h1, h2): every run of LINES lines of the texts ``t``, p its first line's number."""
    d = docs.select("doc", "version", _numbered(F.split("t", "\n")).alias("ln")).where(F.size("ln") >= LINES)

    def window(i: Column) -> Column:
        own = [F.col("ln")[i + k]["line"] for k in range(LINES)]
        return F.struct(i.alias("p"), F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit("second"), *reversed(own)).alias("h2"))

    starts = F.sequence(F.lit(0), F.size("ln") - LINES)
    return d.select("doc", "version", F.inline(F.transform(starts, window)))


def later_windows(w: DataFrame) -> DataFrame:
    """The windows that occur earlier too: (doc, version, p)."""
    w = w.select("h1", "h2", F.struct("doc", "version", "p").alias("at"))
    seen = w.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    seen = seen.where(~F.col("first").eqNullSafe(F.col("last"))).select("h1", "h2", "first")
    return w.join(seen, ["h1", "h2"]).where(~F.col("at").eqNullSafe(F.col("first"))).select("at.*")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (the input row), its text without repeated passages, n_lines and n_removed."""
    keyed = with_row(docs, F.col(doc_id).alias("doc"), F.xxhash64(F.col(text)).alias("version"), F.col(text).alias("t"))
    found = stored(windows(keyed), "line-windows")
    covered = later_windows(found).groupBy("doc", "version").agg(F.collect_set("p").alias("starts"))
    covered = covered.withColumnsRenamed({"doc": "of_doc", "version": "of_version"})
    on = F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("version") == F.col("of_version"))
    d = keyed.drop("t").join(covered, on, "left")  # the text travels once, inside the row
    d = d.select("row", "starts", F.split(F.col("row")[text], "\n").alias("lines"), F.col("row")[text].alias("t"))

    def places(ln: Column) -> Column:
        numbers = F.array_distinct(F.flatten(F.transform(F.col("starts"), lambda p: F.sequence(p, p + (LINES - 1)))))
        return F.transform(numbers, lambda k: ln[k]["i"])

    gone = F.when(F.col("starts").isNotNull(), let(_numbered(F.col("lines")), places))
    d = d.select("row", "lines", "t", gone.alias("gone"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return d.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("t")).otherwise(
            F.array_join(F.transform(left, lambda i: F.col("lines")[i]), "\n")).alias("kept_text"),
        F.when(F.col("t").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
