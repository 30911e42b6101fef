"""Benchmark decontamination: item-sized windows by SimHash, verified by weighted shingles.

Words are runs of letters and digits in lower case; shingles take five of them (an item with fewer
words is one shingle of all its words). A window that reaches the similarity shares a certain number of
shingles with its item, in whatever order, so windows as long as the item are laid at every place where
that many of their shingles occur in items of this length: no other window can match. They are
fingerprinted, and the fingerprints looked up in a multi-index: eight blocks of eight bits, the items'
side holding every value within ``RADIUS // 8`` bits of its block. Two fingerprints within RADIUS bits
must agree that closely in one block, so none is missed. Candidates are verified by the exact weighted
Jaccard similarity of their shingles (counts matter).

Cases: null or wordless texts and items match nothing; a text shorter than the item is one window;
windows are moved inside the text at its ends; rows that agree in id and text are one document; a null
id is an id of its own; repeated items are reported under each of their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import let, stored, with_row

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS = 8
BLOCK_BITS = 8
RADIUS = 23  # similarity 0.8 differs in 10 bits on average, deviation 3
BROADCAST_SHINGLES = 1_000_000  # of 24 bytes each


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def _shingles(hashes: Column, k: Column) -> Column:
    """Hashes of the runs of ``k`` words, at most SHINGLE, from the words' hashes; none if there are fewer."""
    run = lambda i: F.xxhash64(*(F.when(k > j, F.get(hashes, i + j)) for j in range(SHINGLE)))  # noqa: E731  nulls add nothing
    starts = F.sequence(F.lit(0), F.size(hashes) - k)
    return F.when(F.size(hashes) >= k, F.transform(starts, run)).otherwise(F.array().cast("array<bigint>"))


def _simhash(h: Column) -> Column:
    bit = lambda x, b: F.call_function("shiftright", x, b).bitwiseAND(F.lit(1))

    def add(fp: Column, b: Column) -> Column:
        ones = F.aggregate(h, F.lit(0).cast("bigint"), lambda a, x: a + bit(x, b))
        return fp.bitwiseOR(F.when(2 * ones > F.size(h), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), add)


def _tagged(h: Column) -> Column:
    """Each hash with the number of its occurrence, so that sets of them are multisets of hashes."""
    return let(F.sort_array(h), lambda s: F.transform(s, lambda x, i: F.xxhash64(x, i + 1 - F.array_position(s, x))))


def _block(fp: Column, b: Column) -> Column:
    return F.call_function("shiftright", fp, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def items_of(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, m, k, h, fp): words, shingle length, shingle hashes and fingerprint of each item."""
    i = benchmark.select(F.col(item_id).alias("item_id"), _hashes(_words(F.col(text))).alias("ws")).where(F.size("ws") > 0)
    i = i.select("item_id", F.size("ws").alias("m"), F.least(F.size("ws"), F.lit(SHINGLE)).alias("k"), "ws")
    i = i.select("item_id", "m", "k", _shingles(F.col("ws"), F.col("k")).alias("h"))
    return i.select("*", _simhash(F.col("h")).alias("fp"))


def _ranges(ps: Column, similarity: float) -> Column:
    """Ranges (m, k, first, last) of the starts of windows that hold enough of the places ``ps`` (sorted, distinct)
    of shingles of items with ``m`` words; no start is in two of them.

    Equal places count once and each for any item, so this is never less than what the window shares with one item.
    """
    width = F.least("n", "m")
    own, of_item = width - F.col("k") + 1, F.col("m") - F.col("k") + 1
    need = F.greatest(F.ceil(F.lit(similarity / (1 + similarity)) * (own + of_item) - 1e-6).cast("int"), F.lit(1))

    def laid(ps: Column, need: Column) -> Column:
        def of(i: Column) -> Column:  # the windows whose first place is the i-th, and that hold need - 1 more
            after = F.coalesce(F.get(ps, i - 1) + 1, F.lit(0))
            first = F.greatest(F.get(ps, i + need - 1) - own + 1, after)
            last = F.least(F.get(ps, i), F.col("n") - width)
            return F.struct(F.col("m").alias("m"), F.col("k").alias("k"), first.alias("first"), last.alias("last"))

        firsts = F.when(F.size(ps) >= need, F.sequence(F.lit(0), F.size(ps) - need)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(firsts, of), lambda r: r["first"] <= r["last"])

    return let(ps, lambda ps: let(need, lambda need: laid(ps, need)))


def windows(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame | None:
    """(doc, version, laid): ranges of the windows of ``docs`` (doc, version, t) that can reach the similarity to an item."""
    places = items.select("m", "k", F.explode("h").alias("h")).distinct()
    places = stored(places, "decontam-shingles")
    if places.count() <= BROADCAST_SHINGLES:
        places = F.broadcast(places)
    laid = None
    for (k,) in items.select("k").distinct().collect():  # at most SHINGLE values
        d = docs.select("doc", "version", _hashes(_words(F.col("t"))).alias("ws"))
        d = d.select("doc", "version", F.size("ws").alias("n"), F.posexplode(_shingles(F.col("ws"), F.lit(k))).alias("p", "h"))
        d = d.join(places.where(F.col("k") == k), "h").groupBy("doc", "version", "n", "m", "k").agg(F.collect_set("p").alias("ps"))
        d = d.select("doc", "version", _ranges(F.sort_array("ps"), similarity).alias("laid")).where(F.size("laid") > 0)
        laid = d if laid is None else laid.unionByName(d)
    return None if laid is None else laid.groupBy("doc", "version").agg(F.flatten(F.collect_list("laid")).alias("laid"))


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc, version, item_id, start, n_words, similarity): the best window of each document for each item
    that it holds; version is the hash of the text."""
    d = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("version"), F.col(text).alias("t"))
    items = stored(items_of(benchmark, item_id, item_text), "decontam-items")
    laid = windows(d, items, similarity)
    if laid is None:
        of = lambda df, c: df.schema[c].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc {of(d, 'doc')}, version long, item_id {of(items, 'item_id')}, start int, n_words int, similarity double")
    laid = stored(laid.withColumnsRenamed({"doc": "of_doc", "version": "of_version"}), "decontam-windows")
    on = F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("version") == F.col("of_version"))
    w = d.join(laid, on).select("doc", "version", _hashes(_words(F.col("t"))).alias("ws"), "laid").dropDuplicates(["doc", "version"])
    cut = lambda x: F.struct(*(x[c].alias(c) for c in ("m", "k", "first", "last")),
                             F.slice("ws", x["first"] + 1, x["last"] - x["first"] + x["m"]).alias("ws"))
    w = w.select("doc", "version", F.inline(F.transform("laid", cut)))  # the whole text stays out of the windows' rows
    w = w.select("doc", "version", "m", "k", "first", "ws", F.explode(F.sequence("first", "last")).alias("start"))
    w = w.select("doc", "version", "m", "k", "start", F.slice("ws", F.col("start") - F.col("first") + 1, F.col("m")).alias("own"))
    w = w.select("doc", "version", "m", "start", F.size("own").alias("n_words"), _shingles(F.col("own"), F.col("k")).alias("h"))
    w = stored(w.where(F.size("h") > 0).select("*", _simhash(F.col("h")).alias("fp")), "decontam-prints")

    masks = [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= RADIUS // BLOCKS]
    block = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    index = items.select("item_id", F.col("m").alias("im"), F.col("h").alias("ih"), F.col("fp").alias("ifp"), block.alias("ib"))
    index = index.select("*", F.explode(F.array(*map(F.lit, masks))).alias("mask"))
    index = index.select("item_id", "im", "ih", "ifp", "ib", _block(F.col("ifp"), F.col("ib")).bitwiseXOR(F.col("mask")).alias("iv"))
    probe = w.select("*", block.alias("b")).select("*", _block(F.col("fp"), F.col("b")).alias("v"))
    differ = F.col("fp").bitwiseXOR(F.col("ifp"))
    close = lambda b: F.bit_count(_block(differ, F.lit(b))) <= RADIUS // BLOCKS
    first = F.coalesce(*(F.when(close(b), F.lit(b)) for b in range(BLOCKS)))  # a pair counts in its first block only
    pairs = probe.join(index, (F.col("m") == F.col("im")) & (F.col("b") == F.col("ib")) & (F.col("v") == F.col("iv")))
    pairs = pairs.where((F.bit_count(differ) <= RADIUS) & (F.col("b") == first))
    pairs = pairs.select("doc", "version", "item_id", "start", "n_words", F.size("h").alias("na"), F.size("ih").alias("nb"),
                         F.size(F.array_intersect(_tagged(F.col("h")), _tagged(F.col("ih")))).alias("both"))
    pairs = pairs.select("doc", "version", "item_id", "start", "n_words", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("similarity"))
    best = pairs.where(F.col("similarity") >= similarity).groupBy("doc", "version", "item_id").agg(
        F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("back"), "n_words")).alias("best"))
    return best.select("doc", "version", "item_id", (-F.col("best.back")).alias("start"), "best.n_words", "best.similarity")


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    bad = contaminated(docs, benchmark, doc_id, text, item_id, item_text, similarity).select("doc", "version").distinct()
    bad = stored(bad.withColumnsRenamed({"doc": "of_doc", "version": "of_version"}), "decontam-found")
    rows = with_row(docs, F.col(doc_id).alias("doc"), F.xxhash64(text).alias("version"))
    on = F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("version") == F.col("of_version"))
    return rows.join(bad, on, "left_anti").select("row.*")
