"""Suffix-array dedup over a logarithmic family of indexes.

Texts are bytes. Every stretch of ``length`` bytes chooses one anchor inside it, the place of its
smallest rolling hash, so equal stretches choose equal anchors, and neighbouring stretches mostly the
same one. The suffixes that start at anchors form a sparse suffix array: a table sorted by the first
``KEY`` bytes of the suffix, with one row for all places that share them: their number, and the least
and greatest hash of the surroundings (all bytes that the stretches of an anchor cover).

The index is a family of such arrays. A new batch is sorted into an array, merge-scanned against every
level for suffixes that others share, and becomes a level of its own; two levels of one size are merged
into one of twice the size, so a corpus of n batches has log n levels and an entry is rewritten log n
times. Of a shared suffix, either all surroundings are equal (all its stretches repeat) or they differ.

Differing ones are resolved once, after all batches: one holder of each different surrounding brings
its bytes, and stretches are compared by hash at equal distance from the anchor. Groups of up to
``GROUP_LIMIT`` surroundings are compared inside a task, a bounded number at a time; larger ones become
one row per stretch that Spark counts with partial aggregation. Copies never multiply: equal
surroundings are one row from the first aggregate on.

Cases: a null text is empty; texts shorter than ``length`` have nothing to remove; rows that agree in
id and text are counted as separate places, so both lose their long stretches; a null id is an id of
its own; equal texts are removed everywhere, the first place included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import stored

LENGTH = 400
KEY = 24  # bytes of a suffix that the arrays are sorted by
BATCHES = 4
GROUP_LIMIT = 4096  # different surroundings of one anchor compared inside a task
BROADCAST_IDS = 2_000_000  # of 8 bytes each
CHUNK = 1 << 20  # bytes worked on at once; must fit PLACE_BITS
PLACE_BITS = 21
ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _key_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the KEY bytes that start at each place."""
    n = len(data) - KEY + 1
    eight = np.empty(len(data) - 7, np.uint64)
    raw = data.tobytes()
    for k in range(8):
        part = np.frombuffer(raw, "<u8", (len(raw) - k) // 8, k)
        eight[k::8] = part
    h = eight[:n] * ODD
    for k in range(8, KEY, 8):
        h ^= h >> np.uint64(29)
        h += eight[k : k + n]
        h *= ODD
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    forth = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], forth[width - 1 : width - 1 + n])


def anchors(text: bytes, length: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """(anchor, first start, last start): the stretches of ``text`` by the anchor they choose, in order."""
    n_starts = len(text) - length + 1
    held = None
    for at in range(0, max(n_starts, 0), CHUNK):
        data = np.frombuffer(text, np.uint8, min(len(text) - at, CHUNK + length - 1), at)
        h = _key_hashes(data)
        place = np.arange(len(h), dtype=np.uint64)
        low = _sliding_minimum((h >> np.uint64(PLACE_BITS)) << np.uint64(PLACE_BITS) | place, length - KEY + 1)
        chosen = (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(chosen[1:] != chosen[:-1]) + 1, [len(chosen)]])
        for a, b, c in zip(chosen[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            a, b, c = a + at, b + at, c + at - 1
            if held and held[0] == a:  # one range across two chunks
                held = (a, held[1], c)
                continue
            if held:
                yield held
            held = (a, b, c)
    if held:
        yield held


def entries(docs: DataFrame, length: int) -> DataFrame:
    """(doc, version, first, n, off, key, u): the sparse suffix array of texts (doc, version, t), unsorted.

    ``n`` stretches start at ``first``; the anchor lies ``off`` bytes after; ``u`` hashes all they cover.
    """
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_64_intdigest
        columns = ["doc", "version", "first", "n", "off", "key", "u"]
        for b in batches:
            rows: list[tuple] = []
            for doc, version, t in zip(b["doc"], b["version"], b["t"], strict=True):
                data = t.encode("utf-8")
                rows.extend((doc, version, lo, hi - lo + 1, a - lo, data[a : a + KEY], digest(data[lo : hi + length]) - (1 << 63)) for a, lo, hi in anchors(data, length))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    long_enough = docs.where(F.octet_length("t") >= length).select("doc", "version", "t")
    return long_enough.mapInPandas(run, f"doc {kind}, version long, first long, n int, off int, key binary, u long")


class Family:
    """The levels of the index, each (batches in it, array), and what their scans have found.

    An array has one row per suffix key: (key, places, low, high), the least and greatest ``u``.
    """

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []
        self.found: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        """Merge-scan the entries of a batch against all levels, then merge levels of one size."""
        new = batch.select("key", F.lit(1).cast("long").alias("places"), F.col("u").alias("low"), F.col("u").alias("high"))
        merging, size = [], 1
        while self.levels and self.levels[-1][0] == size:
            merging.append(self.levels.pop())
            size *= 2
        merged = _merged([new.withColumn("fresh", F.lit(True)), *(level.withColumn("fresh", F.lit(False)) for _, level in merging)])
        merged = stored(merged, "suffix-level")
        scanned = merged
        if self.levels:
            scanned = _merged([merged, *(level.withColumn("fresh", F.lit(False)) for _, level in self.levels)])
        found = scanned.where((F.col("places") > 1) & F.col("fresh")).select("key", "low", "high")
        self.found.append(stored(found, "suffix-found"))
        self.levels.append((size, merged.drop("fresh")))

    def shared(self) -> DataFrame:
        """(key, mixed): the suffixes that several places share; mixed if their surroundings differ."""
        out = self.found[0]
        for f in self.found[1:]:
            out = out.unionByName(f)
        return out.groupBy("key").agg((F.min("low") != F.max("high")).alias("mixed"))


def _merged(arrays: list[DataFrame]) -> DataFrame:
    out = arrays[0]
    for a in arrays[1:]:
        out = out.unionByName(a)
    out = out.groupBy("key").agg(F.sum("places").alias("places"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("fresh").alias("fresh"))
    return out.sortWithinPartitions("key")


def _window_hashes(buffer: bytes, length: int) -> np.ndarray:
    """A 64-bit polynomial hash of every stretch of ``buffer``, independent of its place."""
    data = np.frombuffer(buffer, np.uint8).astype(np.uint64) + np.uint64(1)
    data = (data * np.uint64(0xD6E8FEB86659FD93)) ^ (data << np.uint64(17))
    power = np.full(len(data), ODD, np.uint64)
    power[0] = 1
    back = np.full(len(data) - length + 1, INVERSE, np.uint64)
    back[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * np.cumprod(power))])
    h = (sums[length:] - sums[:-length]) * np.cumprod(back)
    h ^= h >> np.uint64(31)
    return h * np.uint64(0xD6E8FEB86659FD93)


def _stretches(b: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index of the start in the row's bytes, hash) of every stretch of the rows' surroundings.

    The hash also covers the key's group and the distance of the start from the anchor.
    """
    n = b["n"].to_numpy(np.int64)
    row = np.repeat(np.arange(len(b)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    size = n + length - 1
    h = _window_hashes(b"".join(b["bytes"]), length)[np.repeat(np.cumsum(size) - size, n) + k]
    to_anchor = (b["off"].to_numpy(np.int64)[row] - k).astype(np.uint64)
    h = (h + to_anchor * ODD) * np.uint64(0xD6E8FEB86659FD93)
    return row, k, h ^ (h >> np.uint64(33))


def _runs(row: np.ndarray, k: np.ndarray, hit: np.ndarray) -> pd.DataFrame:
    """(row, a, b): maximal runs of consecutive hit starts, half open."""
    row, k = row[hit], k[hit]
    first = np.concatenate([[True], (row[1:] != row[:-1]) | (k[1:] != k[:-1] + 1)]) if len(row) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(row)) - 1 if len(starts) else starts
    return pd.DataFrame({"row": row[starts], "a": k[starts].astype(np.int32), "b": (k[ends] + 1).astype(np.int32)})


def _resolve_small(open_: DataFrame, length: int) -> DataFrame:
    """(key, u, a, b): runs of repeated stretch starts within the surroundings (key, u, n, off, bytes) of small groups."""

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        row, k, h = _stretches(b, length)
        group = (b["key"] != b["key"].shift()).cumsum().to_numpy(np.uint64)
        h = (h + group[row] * ODD) * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        hit = np.zeros(len(h), bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        out = _runs(row, k, hit)
        return pd.DataFrame({"key": b["key"].to_numpy()[out["row"]], "u": b["u"].to_numpy()[out["row"]], "a": out["a"], "b": out["b"]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None  # the last group may go on in the next batch; it holds GROUP_LIMIT rows at most
        for b in batches:
            b = b if waiting is None else pd.concat([waiting, b], ignore_index=True)
            while len(b) > GROUP_LIMIT:  # whole groups, a bounded number of rows at a time
                cut = int((b["key"] != b["key"].iloc[GROUP_LIMIT]).iloc[:GROUP_LIMIT].sum())
                cut = cut or int((b["key"] == b["key"].iloc[0]).sum())
                yield compare(b.iloc[:cut])
                b = b.iloc[cut:].reset_index(drop=True)
            waiting = b
        if waiting is not None and len(waiting):
            yield compare(waiting)

    return open_.repartition("key").sortWithinPartitions("key").mapInPandas(run, "key binary, u long, a int, b int")


def _resolve_large(open_: DataFrame, length: int) -> DataFrame:
    """The same for groups of any size: one row per stretch, counted by Spark."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), GROUP_LIMIT):
                part = b.iloc[at : at + GROUP_LIMIT]
                row, k, h = _stretches(part, length)
                yield pd.DataFrame({"key": part["key"].to_numpy()[row], "u": part["u"].to_numpy()[row], "k": k.astype(np.int32), "h": h.view(np.int64)})

    each = stored(open_.mapInPandas(explode, "key binary, u long, k int, h long"), "suffix-stretches")
    again = each.groupBy("key", "h").agg(F.count("*").alias("places")).where("places > 1").select("key", "h")
    return each.join(again, ["key", "h"]).select("key", "u", F.col("k").alias("a"), (F.col("k") + 1).alias("b"))


def _surroundings(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(key, u, n, off, bytes) of the entries ``wanted`` (doc, version, items of key, u, first, n, off)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, items in zip(b["t"], b["items"], strict=True):
                data = t.encode("utf-8")
                for x in items:
                    rows.append((bytes(x["key"]), x["u"], x["n"], x["off"], data[x["first"] : x["first"] + x["n"] + length - 1]))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=["key", "u", "n", "off", "bytes"])
                    rows = []
            yield pd.DataFrame(rows, columns=["key", "u", "n", "off", "bytes"])

    on = docs["doc"].eqNullSafe(wanted["doc"]) & (docs["version"] == wanted["version"])
    return docs.join(wanted, on).select("t", "items").mapInPandas(run, "key binary, u long, n int, off int, bytes binary")


def _only(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc, version) is in ``wanted``, found without a shuffle of the texts while the
    list of wanted ids is short; the joins that follow are right without this."""
    ids = stored(wanted.select(F.xxhash64("doc", "version").alias("id")).distinct(), "suffix-ids")
    if ids.count() > BROADCAST_IDS:
        return docs
    return docs.join(F.broadcast(ids), F.xxhash64("doc", "version") == F.col("id"), "left_semi")


def repeated_spans(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc, version, spans): the byte ranges (a, b) of texts (doc, version, t) that repeated stretches cover;
    ranges may touch or overlap."""
    index = entries(docs, length).withColumn("batch", F.pmod(F.xxhash64("doc", "version"), F.lit(batches)).cast("int"))
    index = stored(index, "suffix-entries")
    family = Family()
    for k in range(batches):
        family.add(index.where(F.col("batch") == k))
    shared = stored(family.shared(), "suffix-shared")
    places = stored(index.drop("batch").join(shared, "key"), "suffix-places")

    # One holder of each surrounding of a key that has several.
    one = F.min(F.struct("doc", "version", "first", "n", "off")).alias("x")
    holders = places.where("mixed").groupBy("key", "u").agg(F.count("*").alias("places"), one)
    holders = stored(holders.select("key", "u", "places", "x.*"), "suffix-holders")
    large = stored(holders.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > group_limit).select("key"), "suffix-large")
    lists = holders.groupBy("doc", "version").agg(F.collect_list(F.struct("key", "u", "first", "n", "off")).alias("items"))
    open_ = stored(_surroundings(_only(docs, holders), lists, length), "suffix-surroundings")
    small = _resolve_small(open_.join(large, "key", "left_anti"), length)
    big = _resolve_large(open_.join(large, "key", "left_semi"), length)
    runs = small.unionByName(big).groupBy("key", "u").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    verdict = holders.select("key", "u", (F.col("places") > 1).alias("settled")).join(runs, ["key", "u"], "left")
    verdict = stored(verdict.where("settled or runs is not null"), "suffix-verdicts")

    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))
    mixed = places.where("mixed").join(verdict, ["key", "u"]).select("doc", "version", "first", F.when(F.col("settled"), whole).otherwise(F.col("runs")).alias("runs"))
    plain = places.where("not mixed").select("doc", "version", "first", whole.alias("runs"))
    hits = plain.unionByName(mixed).select("doc", "version", F.transform(
        "runs", lambda r: F.struct((F.col("first") + r["a"]).alias("a"), (F.col("first") + r["b"] + (length - 1)).alias("b"))).alias("spans"))
    return hits.groupBy("doc", "version").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                    batches: int = BATCHES, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the remaining bytes ``kept``, one row per document."""
    return _cut(docs, doc_id, text, length, batches, group_limit, "kept binary", bytes)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
            batches: int = BATCHES, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """As ``remove_repeated``, with kept_sha256 in place of the bytes."""
    return _cut(docs, doc_id, text, length, batches, group_limit, "kept_sha256 string", lambda kept: hashlib.sha256(kept).hexdigest())


def _cut(docs: DataFrame, doc_id: str, text: str, length: int, batches: int, group_limit: int, column: str, made) -> DataFrame:
    kind = docs.schema[doc_id].dataType.simpleString()
    name = column.split()[0]
    d = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("version"), F.coalesce(text, F.lit("")).alias("t"))
    spans = repeated_spans(d, length, batches, group_limit)
    spans = stored(spans.withColumnsRenamed({"doc": "of_doc", "version": "of_version"}), "suffix-spans")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            rows = []
            for doc, t, found in zip(b["doc"], b["t"], b["spans"], strict=True):
                data = t.encode("utf-8")
                kept, removed, n, at = [], 0, 0, 0
                end = -1
                for x in sorted((x["a"], x["b"]) for x in found) if found is not None else ():
                    if x[0] > end:
                        n += 1
                        kept.append(data[at : x[0]])
                        removed += x[1] - x[0]
                        end = at = x[1]
                    elif x[1] > end:
                        removed += x[1] - end
                        end = at = x[1]
                kept.append(data[at:])
                rows.append((doc, len(data), removed, n, made(b"".join(kept))))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", name])

    on = F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("version") == F.col("of_version"))
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, {column}"
    ids = stored(spans.select(F.xxhash64("of_doc", "of_version").alias("id")).distinct(), "suffix-ids")
    if ids.count() > BROADCAST_IDS:
        return d.join(spans, on, "left").select("doc", "t", "spans").mapInPandas(run, schema)
    own = F.xxhash64("doc", "version") == F.col("id")  # texts without spans need no shuffle
    cut = d.join(F.broadcast(ids), own, "left_semi").join(spans, on, "left").select("doc", "t", "spans")
    rest = d.join(F.broadcast(ids), own, "left_anti").select("doc", "t", F.lit(None).cast(cut.schema["spans"].dataType).alias("spans"))
    return cut.unionByName(rest).mapInPandas(run, schema)
