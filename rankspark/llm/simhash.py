"""SimHash near-dedup by a self-join of the binary trie of fingerprints.

Texts are hashed to 64-bit fingerprints in Arrow batches. Distinct fingerprints are then joined with
themselves: two nodes of the trie of equal depth are visited together, the bits on their paths that
differ are counted, and the pair is dropped once the count exceeds the allowed distance.

Spark does the upper levels of that walk. Two fingerprints within ``distance`` bits agree in at least
one of ``distance + 1`` segments, so for each segment there is a trie that starts with its bits; there
only equal nodes have budget left and a node is a partition key. Fingerprints below one node are split
further, over all node pairs within the budget, as long as a node holds more than ``node_limit`` of
them; the lower levels are walked inside tasks over sorted arrays, a bounded stretch at a time. Each
node emits a spanning forest of its links, not all pairs.

Cases: a text without words (or null) has fingerprint zero and links like any other; one with fewer
words than the shingle is one shingle; equal fingerprints link; rows without id keep a place and take
the smallest id of their component, null if it has none; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import stored, with_row
from rankspark.llm.graph import components

BITS = 64
SEED = 42
SHINGLE = 3
DISTANCE = 2
NODE_LIMIT = 20_000  # distinct fingerprints walked in one task at a time
SPLIT_BITS = 8
SPLITS = 5  # windows of SPLIT_BITS outside the segment; below them a node holds a few fingerprints only
CHUNK = 1 << 16
LEAF = 16  # fingerprint pairs compared at once


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is one if it is set in over half the shingle hashes."""
    ws = (text or "").encode("utf-8").lower().split()  # bytes: A-Z only, ASCII white space only
    if not ws:
        return 0
    if len(ws) < shingle:
        shingle = len(ws)
    n = len(ws) - shingle + 1
    ones = np.zeros(BITS, np.int64)
    hashed, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, CHUNK):
        h = np.fromiter((hashed(join(ws[i : i + shingle]), SEED) for i in range(at, min(n, at + CHUNK))), ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The columns ``keys`` and fp, the fingerprint's 64 bits as a signed long, one row per document."""
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.pop("t__")], np.uint64)
            yield b.assign(fp=fp.view(np.int64))

    return docs.select(*keys, F.col(text).alias("t__")).mapInPandas(run, f"{kinds}, fp long")


def _segments(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of distance + 1 segments that cover the 64 bits."""
    cuts = [BITS * k // (distance + 1) for k in range(distance + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _near(width: int, budget: int) -> list[int]:
    """All masks of ``width`` bits with at most ``budget`` ones."""
    return [sum(1 << i for i in on) for k in range(min(width, budget) + 1) for on in combinations(range(width), k)]


def _walk(fps: np.ndarray, nodes: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints within ``budget`` bits, below pairs of trie nodes.

    A row of ``nodes`` is (first, end, first, end, differing bits): two stretches of ``fps``, each
    sorted, either the same one twice or the first before the second.
    """
    stack = [(BITS, nodes)]
    while stack:
        depth, nodes = stack.pop()
        if len(nodes) > CHUNK:  # the later ones wait
            stack.append((depth, nodes[CHUNK:]))
            nodes = nodes[:CHUNK]
        small = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2]) <= LEAF
        for i, j in _below(nodes[small]):
            near = (i < j) & (np.bitwise_count(fps[i] ^ fps[j]) <= budget)
            yield i[near], j[near]
        nodes = nodes[~small]
        if not len(nodes) or not depth:
            continue
        depth -= 1
        ones = np.concatenate([[0], np.cumsum((fps >> np.uint64(depth)) & np.uint64(1)).astype(np.int64)])
        a, b, c, d, used = nodes.T
        mid, mid2 = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
        nodes = np.concatenate([
            np.stack([a, mid, c, mid2, used], 1),
            np.stack([mid, b, mid2, d, used], 1),
            np.stack([a, mid, mid2, d, used + 1], 1),
            np.stack([mid, b, c, mid2, used + 1], 1),
        ])
        alive = (nodes[:, 1] > nodes[:, 0]) & (nodes[:, 3] > nodes[:, 2]) & (nodes[:, 4] <= budget) & (nodes[:, 0] <= nodes[:, 2])
        if alive.any():
            stack.append((depth, nodes[alive]))


def _below(nodes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs below small node pairs, a bounded number at a time."""
    for at in range(0, len(nodes), CHUNK // LEAF):
        n = nodes[at : at + CHUNK // LEAF]
        height = n[:, 3] - n[:, 2]
        pairs = (n[:, 1] - n[:, 0]) * height
        own = np.repeat(np.arange(len(n)), pairs)
        k = np.arange(len(own)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        yield n[own, 0] + k // height[own], n[own, 2] + k % height[own]


def _roots(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index each of ``n`` indices is linked to, over any number of links."""
    root = np.arange(n)
    for i, j in links:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not ((up := root[root]) == root).all():
                root = up
    return root


def _nodes(fps: DataFrame, distance: int, node_limit: int) -> DataFrame:
    """(fp, seg, path, side): fingerprints by the node (pair) of the trie whose subtrees a task walks.

    side 0: the node meets itself; 1 and 2: the two nodes of a pair.
    """
    cuts = F.array(*(F.struct(F.lit(k).alias("seg"), F.lit(shift).alias("shift"), F.lit((1 << width) - 1).alias("mask"))
                     for k, (shift, width) in enumerate(_segments(distance))))
    rows = fps.select("fp", F.inline(cuts)).select(
        "fp", "seg", "shift", F.expr("cast(shiftrightunsigned(fp, shift) & mask as string)").alias("path"),
        F.lit(0).alias("side"), F.lit(0).alias("used"))
    done = None
    for depth in range(SPLITS):
        crowded = rows.groupBy("seg", "path").agg(F.count("*").alias("n")).where(F.col("n") > node_limit).select("seg", "path")
        crowded = stored(crowded, "simhash-crowded")
        if crowded.isEmpty():
            break
        rest = rows.join(crowded, ["seg", "path"], "left_anti").select("fp", "seg", "path", "side")
        done = rest if done is None else done.unionByName(rest)
        masks = F.array(*map(F.lit, _near(SPLIT_BITS, distance)))
        top = rows.join(crowded, ["seg", "path"], "left_semi").select(
            "*", F.expr(f"cast(shiftrightunsigned(fp, pmod(shift - {SPLIT_BITS * (depth + 1)}, {BITS - SPLIT_BITS + 1})) & {(1 << SPLIT_BITS) - 1} as int)").alias("p"),
            F.explode(masks).alias("m"))
        top = top.select("*", (F.col("used") + F.bit_count("m")).alias("now"), F.col("p").bitwiseXOR(F.col("m")).alias("q")).where(F.col("now") <= distance)
        side = F.when((F.col("side") != 0) | (F.col("m") == 0), F.col("side")).when(F.col("p") < F.col("q"), 1).otherwise(2)
        top = top.withColumn("s", side)
        mine_first = F.col("s") != 2
        step = F.concat_ws(".", F.when(mine_first, F.col("p")).otherwise(F.col("q")), F.when(mine_first, F.col("q")).otherwise(F.col("p")))
        rows = stored(top.select("fp", "seg", "shift", F.concat_ws("/", "path", step).alias("path"), F.col("s").alias("side"), F.col("now").alias("used")), "simhash-nodes")
    rows = rows.select("fp", "seg", "path", "side")
    return rows if done is None else done.unionByName(rows)


def links(fps: DataFrame, distance: int = DISTANCE, node_limit: int = NODE_LIMIT) -> DataFrame:
    """(a, b): links that span the components of distinct fingerprints ``fp`` within ``distance`` bits."""

    def join(b: pd.DataFrame) -> pd.DataFrame:
        fp = b["fp"].to_numpy(np.int64).view(np.uint64)
        node = ((b["seg"] != b["seg"].shift()) | (b["path"] != b["path"].shift())).to_numpy()
        first = np.flatnonzero(node)
        end = np.append(first[1:], len(fp))
        right = np.concatenate([[0], np.cumsum(b["side"].to_numpy() == 2)])
        mid = end - (right[end] - right[first])
        cross = b["side"].to_numpy()[first] != 0
        pairs = np.stack([first, np.where(cross, mid, end), np.where(cross, mid, first), end, np.zeros_like(first)], 1)
        pairs = pairs[(pairs[:, 1] > pairs[:, 0]) & (pairs[:, 3] > pairs[:, 2]) & (end - first > 1)]
        root = _roots(len(fp), _walk(fp, pairs, distance))
        linked = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"a": fp[linked].view(np.int64), "b": fp[root[linked]].view(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None  # the last node may go on in the next batch; it holds node_limit rows at most
        for b in batches:
            b = b if waiting is None else pd.concat([waiting, b], ignore_index=True)
            last = b.iloc[-1]
            whole = int(((b["seg"] != last["seg"]) | (b["path"] != last["path"])).sum())
            waiting = b.iloc[whole:]
            if whole:
                yield join(b.iloc[:whole])
        if waiting is not None:
            yield join(waiting.reset_index(drop=True))

    # Adding the smallest long orders signed values as unsigned ones.
    nodes = _nodes(fps, distance, node_limit).repartition("seg", "path")
    nodes = nodes.sortWithinPartitions("seg", "path", "side", F.col("fp").bitwiseXOR(F.lit(-(1 << 63))))
    return nodes.mapInPandas(run, "a long, b long")


def classes(fps: DataFrame, distance: int = DISTANCE, node_limit: int = NODE_LIMIT) -> DataFrame:
    """(fp, root): the class of every distinct fingerprint of ``fps``."""
    distinct = stored(fps.select("fp").distinct(), "simhash-distinct")
    found = components(links(distinct, distance, node_limit))
    return distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE, node_limit: int = NODE_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id): the class of every row, named by its smallest doc_id."""
    f = stored(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")), ["doc_id"], "t", shingle), "simhash-fingerprints")
    by_fp = f.groupBy("fp").agg(F.min("doc_id").alias("low"))
    c = stored(classes(f, distance, node_limit), "simhash-classes")
    low = c.join(by_fp, "fp").groupBy("root").agg(F.min("low").alias("component_id"))
    named = stored(c.join(low, "root").select("fp", "component_id"), "simhash-named")
    return f.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
             distance: int = DISTANCE, node_limit: int = NODE_LIMIT) -> DataFrame:
    """The rows of ``docs`` that stand for their component: one each, that of the smallest doc_id (rows
    without id come last; among rows of one id the smaller hash of the text, among equal rows any)."""
    keyed = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("version"), F.col(text).alias("t"))
    f = stored(fingerprints(keyed, ["id", "version"], "t", shingle), "simhash-fingerprints")
    by_fp = f.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "version")).alias("k"))
    c = stored(classes(f, distance, node_limit), "simhash-classes")
    kept = stored(c.join(by_fp, "fp").groupBy("root").agg(F.min("k").alias("k")).select("k.id", "k.version"), "simhash-kept")
    rows = with_row(docs, F.col(doc_id).alias("rid"), F.xxhash64(text).alias("rv"))
    rows = rows.join(kept, F.col("rid").eqNullSafe(F.col("id")) & (F.col("rv") == F.col("version")), "left_semi")
    if f.groupBy("id", "version").count().where("count > 1").isEmpty():
        return rows.select("row.*")
    return rows.dropDuplicates(["rid", "rv"]).select("row.*")
