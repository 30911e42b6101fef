"""Ranked lexical search: Block-Max MaxScore over shards of an inverted index.

``build`` reads every text once and cuts the documents of each task into shards of SHARD terms. A shard
holds a list per term: its postings (document, occurrences) in blocks of BLOCK, packed to the least byte
width, beside each block's last document and its maximum impact, the largest score part that any of its
postings can give per unit of weight. The index is a table in the shared folder.

``search`` takes the items in lots, counts each query term's documents over all shards, and sends a lot to
every shard. In a shard an item's lists are ordered by global bound (repeats x weight x greatest impact).
With the k-th best score so far as threshold, the lists whose bounds together stay below it are not
essential: a document found only in them cannot enter. The others are read in full, window by window, and
their documents scored in part. A candidate is then given up if its part and the maxima of the blocks
that would hold it in the remaining lists stay below the threshold, before those blocks are
unpacked; the rest take the remaining lists one by one, the largest bound first, and are tested again after each.
Every shard returns its k best; they are merged by rank.

The index may be built for the terms of given items only: ``filter_of`` marks their hashes in a bitmap of
fixed size, and other terms (but for a few that share a hash) are left out. Results are the same.

Cases: a null or empty text has no terms and never scores, nor do items without a known term; equal scores
go by ascending key, null keys last; repeated rows of documents are documents of their own, repeated rows of
items get results of their own; other columns are not read; with no documents or no items the result is
empty. A long text makes a shard of its own, in memory in proportion to it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankspark.llm.common import stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+").findall  # the same in UTF-8, once A-Z are lower-cased
SHARD = 1 << 21  # terms of a shard, repeats included
BLOCK = 128  # postings of a block
WINDOW = 4096  # documents scored at a time
FILTER = 1 << 20  # bits of the term filter
LOT = 1 << 16  # terms of the items that are sent out at once
TASKS = 20_000  # of the search stage, at most; a task takes one shard after the other

INDEX = "shard string, term string, df long, top long, lasts binary, tops binary, cuts binary, data binary"


class Terms(dict):
    """Numbers terms in the order they are first seen; -1 for those that the filter leaves out."""

    def __init__(self, wanted: np.ndarray | None):
        self.wanted, self.kept = wanted, []

    def __missing__(self, term: bytes) -> int:
        out = -1
        if self.wanted is None or self.wanted[zlib.crc32(term) % FILTER]:
            out = len(self.kept)
            self.kept.append(term)
        self[term] = out
        return out


def terms_of(text: str) -> list[bytes]:
    return TERM_BYTES(text.encode("utf-8").lower())


def statistics(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """N, the documents with a term, and L, all their terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [len(terms_of(t.as_py())) for t in b.column(0)]
            yield pa.RecordBatch.from_pydict({"n": [sum(map(bool, sizes))], "l": [sum(sizes)]})

    got = docs.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return got[0] or 0, got[1] or 0


def mass(n, total: tuple[int, int]):
    """A document's m: its length against the mean one."""
    return 75 + 25 * n * total[0] // max(total[1], 1)


def impact(tf, m):
    return 1000000000 * tf // (1000 * tf + 12 * m)


def filter_of(items: DataFrame, text: str = "text") -> np.ndarray:
    """A bit for the hash of each term of the items; of fixed size."""
    terms = items.select(F.explode(_terms(F.col(text))).alias("term"))
    marked = terms.select((F.crc32(F.encode("term", "utf-8")) % FILTER).alias("at")).distinct()
    out = np.zeros(FILTER, bool)
    out[[r.at for r in marked.collect()]] = True  # FILTER rows at most
    return out


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(_lower(F.coalesce(text, F.lit(""))), F.lit(f"({TERM})"))


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- index ---------------------------------------------------------------------

def _pack(docs: np.ndarray, tfs: np.ndarray) -> bytes:
    """A block: byte widths, gaps between documents, occurrences."""
    gaps = np.diff(docs, prepend=docs[:1])
    gaps[0] = docs[0]
    wide = [np.min_scalar_type(int(x.max())) for x in (gaps, tfs)]
    return bytes(w.itemsize for w in wide) + gaps.astype(wide[0]).tobytes() + tfs.astype(wide[1]).tobytes()


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    a, b = block[0], block[1]
    n = (len(block) - 2) // (a + b)
    gaps = np.frombuffer(block, f"u{a}", n, 2)
    return np.cumsum(gaps, dtype=np.int64), np.frombuffer(block, f"u{b}", n, 2 + n * a).astype(np.int64)


def _lists(shard: str, terms: Terms, ids: np.ndarray, docs: np.ndarray, lengths: np.ndarray, total: tuple[int, int]) -> Iterator[dict]:
    """A row per term of a shard: ``ids`` and ``docs`` are the term and the document of every occurrence."""
    key, tf = np.unique(ids.astype(np.int64) << 32 | docs, return_counts=True)
    term, doc = key >> 32, key & 0xFFFFFFFF
    part = impact(tf.astype(np.int64), mass(lengths[doc], total))
    edges = np.append(np.flatnonzero(np.diff(term, prepend=-1)), len(term))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        starts = range(a, b, BLOCK)
        blocks = [_pack(doc[i : min(i + BLOCK, b)], tf[i : min(i + BLOCK, b)]) for i in starts]
        tops = np.maximum.reduceat(part[a:b], np.arange(0, b - a, BLOCK))
        lasts = np.append(doc[a + BLOCK - 1 : b - 1 : BLOCK], doc[b - 1])
        yield {
            "shard": shard, "term": terms.kept[int(term[a])].decode("utf-8"), "df": b - a, "top": int(tops.max()),
            "lasts": lasts.astype(np.int64).tobytes(), "tops": tops.astype(np.int64).tobytes(),
            "cuts": np.cumsum([0, *map(len, blocks)]).astype(np.int64).tobytes(), "data": b"".join(blocks)}


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", wanted: np.ndarray | None = None) -> tuple[DataFrame, tuple[int, int]]:
    """The stored index of all documents, and its N and L. A row with a null term holds a shard's keys and lengths."""
    total = statistics(docs, text)
    kind = docs.schema[key].dataType.simpleString()
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((wanted, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        wanted, total = shared.value
        task, number = TaskContext.get().partitionId(), 0
        terms, ids, docs, keys, lengths, room = Terms(wanted), [], [], [], [], SHARD

        def close(schema) -> Iterator[pa.RecordBatch]:
            shard = f"{task}-{number}"
            size = np.array(lengths, np.int64)
            head = dict.fromkeys(schema.names) | {"shard": shard, "df": len(keys), "lengths": lengths, "keys": keys}
            yield pa.RecordBatch.from_pylist([head], schema)
            if ids:
                rows = []
                for r in _lists(shard, terms, np.concatenate(ids), np.concatenate(docs), size, total):
                    rows.append(r)
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

        for b in batches:
            schema = pa.schema([("shard", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("top", pa.int64()), ("lasts", pa.binary()), ("tops", pa.binary()),
                                ("cuts", pa.binary()), ("data", pa.binary()), ("lengths", pa.list_(pa.int64())), ("keys", pa.list_(b.schema.field(0).type))])
            for k, t in zip(b.column(0), b.column(1), strict=True):
                found = terms_of(t.as_py() or "")
                if not found:
                    continue
                if lengths and len(found) > room:
                    yield from close(schema)
                    terms, ids, docs, keys, lengths, room, number = Terms(wanted), [], [], [], [], SHARD, number + 1
                here = np.fromiter(map(terms.__getitem__, found), np.int64, len(found))
                here = here[here >= 0]
                ids.append(here)
                docs.append(np.full(len(here), len(keys), np.int64))
                keys.append(k.as_py())
                lengths.append(len(found))
                room -= len(found)
        if lengths:
            yield from close(schema)

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    made = rows.mapInArrow(run, f"{INDEX}, lengths array<long>, keys array<{kind}>")
    return stored(made, "search-index"), total


# -- search --------------------------------------------------------------------

class Postings:
    """One term's list in a shard."""

    def __init__(self, row: dict, part):
        self.lasts, self.tops, self.cuts = (np.frombuffer(row[c], np.int64) for c in ("lasts", "tops", "cuts"))
        self.data, self.top, self.part, self.held = row["data"], row["top"], part, {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and their impacts; unpacked once in a shard."""
        if i not in self.held:
            docs, tfs = unpack(self.data[self.cuts[i] : self.cuts[i + 1]])
            self.held[i] = docs, impact(tfs, self.part[docs])
        return self.held[i]

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        first, last = np.searchsorted(self.lasts, (low, high - 1))
        got = [self.block(i) for i in range(first, min(last + 1, len(self.lasts)))]
        if not got:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        docs, parts = (np.concatenate(x) for x in zip(*got, strict=True))
        a, b = np.searchsorted(docs, (low, high))
        return docs[a:b], parts[a:b]

    def places(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block that would hold each document, and its maximum (0 past the last block)."""
        at = np.searchsorted(self.lasts, docs)
        return at, np.where(at < len(self.tops), self.tops[np.minimum(at, len(self.tops) - 1)], 0)

    def impacts(self, docs: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The impact on each of the ascending documents, found in its block ``at``."""
        out = np.zeros(len(docs), np.int64)
        for i in np.unique(at[at < len(self.tops)]).tolist():
            a, b = np.searchsorted(at, (i, i + 1))
            held, parts = self.block(i)
            j = np.minimum(np.searchsorted(held, docs[a:b]), len(held) - 1)
            out[a:b] = np.where(held[j] == docs[a:b], parts[j], 0)
        return out


class Best:
    """The k best (score, document); the threshold is the k-th score, 0 while there are fewer."""

    def __init__(self, k: int, order: np.ndarray):
        self.k, self.order = k, order  # order: rank of each document by key
        self.docs, self.scores, self.least = np.empty(0, np.int64), np.empty(0, np.int64), 0

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        fit = (scores >= max(self.least, 1)) & ~np.isin(docs, self.docs)
        docs, scores = np.append(self.docs, docs[fit]), np.append(self.scores, scores[fit])
        top = np.lexsort((self.order[docs], -scores))[: self.k]
        self.docs, self.scores = docs[top], scores[top]
        self.least = int(self.scores[-1]) if len(top) == self.k else 0


def best_of(lists: list[tuple[int, Postings]], n_docs: int, best: Best, counter: dict | None = None) -> Best:
    """Block-Max MaxScore: ``lists`` are (repeats x weight, postings) of an item's terms in a shard."""
    lists = sorted(((w, p) for w, p in lists if w > 0), key=lambda x: -x[0] * x[1].top)
    rest = np.append(np.cumsum([w * p.top for w, p in lists][::-1])[::-1], 0)  # bound of the lists from each one on
    if lists:  # some documents that hold the strongest term, so that there is a threshold
        weight, first = lists[0]
        i = int(np.argmax(first.tops))
        docs, parts = first.block(i)
        _finish(lists[1:], docs, weight * parts, best)
    for low in range(0, n_docs, WINDOW):
        high = min(low + WINDOW, n_docs)
        essential = int(np.count_nonzero(rest[:-1] >= max(best.least, 1)))
        acc = np.zeros(high - low, np.int64)
        for w, p in lists[:essential]:
            docs, parts = p.between(low, high)
            acc[docs - low] += w * parts
        docs = np.flatnonzero(acc)
        docs = docs[acc[docs] + rest[essential] >= best.least]
        if len(docs):
            _finish(lists[essential:], docs + low, acc[docs], best)
    return best


def _finish(lists: list[tuple[int, Postings]], docs: np.ndarray, scores: np.ndarray, best: Best) -> None:
    """Add the remaining lists to the candidates' scores, dropping those whose block maxima cannot reach the threshold."""
    at, most = [], []
    for w, p in lists:
        a, m = p.places(docs)
        at.append(a)
        most.append(w * m)
    left = sum(most, np.zeros(len(docs), np.int64))
    live = np.flatnonzero(scores + left >= best.least)
    for (w, p), a, m in zip(lists, at, most, strict=True):
        if not len(live):
            return
        scores[live] += w * p.impacts(docs[live], a[live])
        left[live] -= m[live]
        live = live[scores[live] + left[live] >= best.least]
    best.add(docs[live], scores[live])


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _lots(items: DataFrame) -> Iterator[list[tuple[int, dict[str, int]]]]:
    """The items in lots of LOT terms: (number, repeats of each term). One partition of items is held at a time."""
    lot, size = [], 0
    for number, terms in items.toLocalIterator():
        repeats: dict[str, int] = {}
        for t in terms:
            repeats[t] = repeats.get(t, 0) + 1
        if lot and size + len(repeats) > LOT:
            yield lot
            lot, size = [], 0
        lot.append((number, repeats))
        size += len(repeats)
    if lot:
        yield lot


def search(index: DataFrame, total: tuple[int, int], items: DataFrame, k: int = 20, item: str = "item_id", text: str = "text") -> DataFrame:
    """``item``, rank, key and score of the k best documents of every item row with a score above 0."""
    spark = index.sparkSession
    kind = index.schema["keys"].dataType.elementType.simpleString()
    numbered = stored(items.select(
        F.monotonically_increasing_id().alias("number"), F.col(item).alias("item"), _terms(F.col(text)).alias("terms")), "search-items")
    heads = index.where("term IS NULL")
    tasks = max(1, min(heads.count(), TASKS))  # said in so many words, as small inputs with much work would be put together
    hits = None
    for lot in _lots(numbered.select("number", "terms")):
        names = spark.createDataFrame(pa.table({"term": pa.array(sorted({t for _, r in lot for t in r}), pa.string())}))
        lists = index.where("term IS NOT NULL").join(F.broadcast(names), "term", "left_semi")  # LOT terms at most
        dfs = dict(lists.groupBy("term").agg(F.sum("df")).collect())
        terms = {t: weight(total[0], df) for t, df in dfs.items()}
        queries = [(n, [(t, c * terms[t]) for t, c in r.items() if t in terms]) for n, r in lot]
        found = _search_lot(lists.unionByName(heads).repartition(tasks, "shard"), total, [q for q in queries if q[1]], k, kind)
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = spark.createDataFrame([], f"number long, doc {kind}, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    top = stored(hits, "search-hits").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(numbered.select("number", "item"), "number").select(F.col("item").alias(item), "rank", F.col("doc"), "score")


def _search_lot(lists: DataFrame, total: tuple[int, int], queries: list, k: int, kind: str) -> DataFrame:
    shared = lists.sparkSession.sparkContext.broadcast(queries)

    def run(rows: pa.Table) -> pa.Table:
        held: dict[str, dict] = {}
        head = None
        for b in rows.to_batches():
            for r in b.to_pylist():
                if r["term"] is None:
                    head = r
                else:
                    held[r["term"]] = r
        part = mass(np.array(head["lengths"], np.int64), total)
        keys = head["keys"]
        order = np.empty(len(keys), np.int64)
        order[sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] if keys[i] is not None else 0))] = np.arange(len(keys))
        lists = {t: Postings(r, part) for t, r in held.items()}
        number, docs, scores = [], [], []
        for n, weights in shared.value:
            got = best_of([(w, lists[t]) for t, w in weights if t in lists], len(keys), Best(k, order))
            number += [n] * len(got.docs)
            docs += [keys[d] for d in got.docs.tolist()]
            scores += got.scores.tolist()
        return pa.table({"number": pa.array(number, pa.int64()), "doc": pa.array(docs, rows.schema.field("keys").type.value_type), "score": pa.array(scores, pa.int64())})

    return lists.groupBy("shard").applyInArrow(run, f"number long, doc {kind}, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text",
         item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item``, rank, ``key`` and score: index the documents for the items' terms, then search."""
    index, total = build(docs, key, text, filter_of(items, item_text))
    return search(index, total, items, k, item, item_text).withColumnRenamed("doc", key)
