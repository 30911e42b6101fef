"""Language-model scoring by cross-entropy difference.

Two bigram models, one of labelled target documents and one of the whole corpus (the background),
share one vocabulary, one list of explicit bigrams and one smoothing. A document's score is its mean
loss per token under the target model less that under the background model: the lower, the more it
looks like the target.

Every word and every bigram of every document is counted exactly and is part of both models (words and bigrams
are told apart by 64-bit hashes). No model is held in one place: texts are put together in lots of about a million
tokens and stored with their words numbered; each lot sends its different words and bigrams with its own counts to
the part of the hashes they belong to, a part adds up what all lots sent and answers each lot with the
totals of what it asked for, in the order asked, and the lot's texts are scored with these. A word or bigram is sent once
a lot, however frequent it is, and the number of parts grows with the corpus, so no task holds more than a part or a lot.

``score`` may be given ``word_share`` and ``pair_share`` to prune the models instead: a word then belongs to the
vocabulary if it makes up at least one in ``word_share`` of the corpus's tokens or of the target's, the others being one
unknown class, and a bigram over that vocabulary is explicit if it makes up at least one in ``pair_share`` of
either; the mass of the others goes to the unigram model, so that both models add up to one in each context. Pruned
models are small enough (twice ``word_share`` words, twice ``pair_share`` bigrams) to be sent to every task.

Cases: a null text or one without words has no tokens and null losses; labels that repeat an id count
once, as target if any row says so; ids without label are background; no labelled target leaves a flat
target model; repeated rows count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import stored

WORD_SHARE = 1 << 20  # shares that keep pruned models small
PAIR_SHARE = 1 << 21
PRIOR = 4.0  # pseudo-counts given to the unigram model in each context
FLOOR = 0.5  # pseudo-count of each word
HELD_WORDS = 500_000  # different words a task holds before it hands on their counts
LOT = 1 << 20  # tokens worked on at once, or one text if that has more
PART = 1 << 21  # tokens of the corpus for each part of the words' and of the bigrams' hashes
BROADCAST_IDS = 2_000_000  # labelled targets, of 8 bytes each


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()  # bytes: A-Z only, ASCII white space only


def _hashes(words: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64).view(np.int64)


def _lots(texts: Iterable[str | None]) -> Iterator[list[list[bytes]]]:
    """The words of the texts, about LOT tokens at a time."""
    lot: list[list[bytes]] = []
    size = 0
    for t in texts:
        lot.append(_words(t))
        size += len(lot[-1])
        if size >= LOT:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot


def _places(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key lies in ``sorted_keys``; their number for those that do not."""
    at = np.searchsorted(sorted_keys, keys)
    known = at < len(sorted_keys)
    known[known] = sorted_keys[at[known]] == keys[known]
    return np.where(known, at, len(sorted_keys))


def _numbered(lot: list[list[bytes]], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, text number) of every token; unknown words have the number after the last."""
    different = list(set(chain.from_iterable(lot)))
    number = dict(zip(different, _places(vocabulary, _hashes(different)).tolist(), strict=True))
    w = np.fromiter(map(number.__getitem__, chain.from_iterable(lot)), np.int64)
    return w, np.repeat(np.arange(len(lot)), [len(ws) for ws in lot])


def _pairs(w: np.ndarray, own: np.ndarray, size: int) -> np.ndarray:
    """One number for each two neighbouring words of a text."""
    return (w[:-1] * size + w[1:])[own[1:] == own[:-1]]


def _summed(counts: DataFrame, key: str) -> DataFrame:
    return counts.groupBy(key).agg(F.sum("target").alias("target"), F.sum("corpus").alias("corpus"))


def marked(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, t, is_target): the texts, and whether their id is among ``targets`` (doc_id)."""
    chosen = stored(targets.select(F.col("doc_id").alias("target_id")).where("target_id is not null").distinct(), "lm-targets")
    if chosen.count() <= BROADCAST_IDS:  # the texts need no shuffle; beyond that Spark picks the join
        chosen = F.broadcast(chosen)
    d = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    return d.join(chosen, F.col("id") == F.col("target_id"), "left").select("id", "t", F.col("target_id").isNotNull().alias("is_target"))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, target, corpus): how often each word (by its hash) occurs in texts (t, is_target)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {True: Counter(), False: Counter()}

        def counted() -> Iterator[pd.DataFrame]:
            for of, c in sums.items():
                n = np.fromiter(c.values(), np.int64)
                yield pd.DataFrame({"word": _hashes(c), "target": n * of, "corpus": n})
                c.clear()

        for b in batches:
            for t, of in zip(b["t"], b["is_target"], strict=True):
                sums[bool(of)].update(_words(t))
                if sum(map(len, sums.values())) >= HELD_WORDS:
                    yield from counted()
        yield from counted()

    return _summed(texts.mapInPandas(run, "word long, target long, corpus long"), "word")


def count_pairs(texts: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(pair, target, corpus): how often each two words of ``vocabulary`` (and its unknown class) follow each other."""
    sent = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for b in batches:
            for of in (True, False):
                for lot in _lots(b["t"][b["is_target"] == of]):
                    pair, n = np.unique(_pairs(*_numbered(lot, known), len(known) + 1), return_counts=True)
                    yield pd.DataFrame({"pair": pair, "target": n * of, "corpus": n})

    return _summed(texts.mapInPandas(run, "pair long, target long, corpus long"), "pair")


def _at_least(counts: DataFrame, key: str, totals: list[int], share: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys with one in ``share`` or more of the target's or the corpus's tokens (``totals``), sorted, and their
    (target, corpus) counts: twice ``share`` rows at most."""
    enough = [F.col(c) >= F.lit(max(1, -(-total // share))) for c, total in zip(("target", "corpus"), totals, strict=True)]
    rows = counts.where(enough[0] | enough[1]).select(key, "target", "corpus").toArrow()
    keys, *n = (rows[c].to_numpy() for c in (key, "target", "corpus"))
    order = np.argsort(keys)
    return keys[order], np.stack(n)[:, order]


def _loss(told: np.ndarray, unigram: np.ndarray, left: np.ndarray, context: np.ndarray, w: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each token ``w``, in nats. ``told``: the count of the pair that each token but the first of a text ends; of
    each word its unigram probability, the pseudo-count that it leaves to the unigram model, and its count as a context."""
    p = unigram[w]
    before = w[:-1][~first[1:]]
    p[~first] = (told + left[before] * p[~first]) / context[before]
    return -np.log(p)


def _firsts(own: np.ndarray) -> np.ndarray:
    """Which tokens are the first of their text."""
    first = np.ones(len(own), bool)
    first[1:] = own[1:] != own[:-1]
    return first


def _means(losses: Iterable[np.ndarray], own: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    with np.errstate(invalid="ignore"):  # texts without words: 0 / 0, stored as null
        return [np.bincount(own, x, len(n)) / n for x in losses]


SCORED = "n_tokens long, target_loss double, corpus_loss double, score double"


def score(docs: DataFrame, targets: DataFrame, word_share: int | None = None, pair_share: int | None = None,
          doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_loss, corpus_loss (per token) and score, their difference. With both shares, by pruned models."""
    if word_share is None and pair_share is None:
        return _score_whole(marked(docs, targets, doc_id, text))
    if word_share is None or pair_share is None:
        raise ValueError("give both shares, or neither")
    return _score_pruned(docs, marked(docs, targets, doc_id, text), word_share, pair_share, doc_id, text)


# The whole models: lots of texts ask the parts of the hashes for totals.

KEYS = "part int, lot long, n int, keys binary, counts binary"
TOTALS = "part int, lot long, n int, counts binary, n_different long"


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers (0 or more) in as few bytes each as the largest needs."""
    return numbers.astype(np.min_scalar_type(numbers.max(initial=0))).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}") if n else np.empty(0, np.uint8)


def _pair_keys(hashes: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of each two neighbouring words (uint64)."""
    x = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _lots_of(texts: DataFrame) -> DataFrame:
    """A row per lot of texts (id, t, is_target): the ids, their numbers of words, which are targets, the hashes of the
    lot's different words in order, and every token as a place among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = TaskContext.get().partitionId() << 32
        for b in batches:
            at = 0
            for ws in _lots(b.column("t").to_pylist()):
                rows = b.slice(at, len(ws))
                at += len(ws)
                different = list(set(chain.from_iterable(ws)))
                words, place = np.unique(_hashes(different).view(np.uint64), return_inverse=True)
                number = dict(zip(different, place.tolist(), strict=True))
                size = [len(x) for x in ws]
                tokens = np.fromiter(map(number.__getitem__, chain.from_iterable(ws)), np.int64, sum(size))
                of = rows.column("is_target")
                n_target = sum(n for n, t in zip(size, of.to_pylist(), strict=True) if t)
                one = lambda x: pa.ListArray.from_arrays([0, len(x)], x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lot]), one(rows.column("id")), one(pa.array(size, pa.int32())), one(of), pa.array([words.tobytes()]),
                     pa.array([_packed(tokens)]), pa.array([n_target]), pa.array([len(tokens)])],
                    ["lot", "ids", "size", "is_target", "words", "tokens", "target", "corpus"])
                lot += 1

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"lot long, ids array<{kind}>, size array<int>, is_target array<boolean>, words binary, tokens binary, target long, corpus long")


def _opened(lot: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a stored lot: the hashes of its words; of every token its word and its text; its pairs' keys in order, and
    of every token but the first of a text the place of the pair that it ends."""
    size = np.asarray(lot["size"], np.int64)
    words = np.frombuffer(lot["words"], np.uint64)
    w = _unpacked(lot["tokens"], size.sum()).astype(np.int64)
    own = np.repeat(np.arange(len(size)), size)
    pairs, at = np.unique(_pair_keys(words[w])[own[1:] == own[:-1]], return_inverse=True)
    return words, w, own, pairs, at


def _keys_of(lots: DataFrame, bits: int) -> DataFrame:
    """What each lot asks for, in ``1 << bits`` parts of the words (their counts, and as last word of a text, for target and
    corpus) and as many of the pairs (their counts, for target and corpus), numbered after those of the words."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in chain.from_iterable(b.slice(i, 1).to_pylist() for b in batches for i in range(b.num_rows)):
            words, w, own, pairs, at = _opened(lot)
            target = np.asarray(lot["is_target"], bool)[own]
            first = _firsts(own)
            last = np.append(first[1:], True)[:len(w)]
            count = lambda x, n: np.bincount(x, minlength=n)
            of_words = np.stack([count(w[m], len(words)) for m in (target, slice(None), target & last, last)])
            of_pairs = np.stack([count(at[target[~first]], len(pairs)), count(at, len(pairs))])
            out = []
            for start, keys, counts in ((0, words, of_words), (len(edges), pairs, of_pairs)):
                cuts = np.append(np.searchsorted(keys, edges), len(keys)).tolist()
                out += [(start + i, lot["lot"], b - a, keys[a:b].tobytes(), _packed(counts[:, a:b]))
                        for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "lot", "n", "keys", "counts"])

    return lots.select("lot", "size", "is_target", "words", "tokens").mapInArrow(run, KEYS)


def _totals(asked: DataFrame, n_parts: int) -> DataFrame:
    """The totals of all that was asked for, lot by lot in the order asked; in one row of a part its number of different keys."""

    def run(part: pa.Table) -> pa.Table:
        n = part["n"].to_pylist()
        kinds = 4 if part["part"][0].as_py() < n_parts else 2
        keys = np.frombuffer(b"".join(part["keys"].to_pylist()), np.uint64)
        own = [_unpacked(c, kinds * k).reshape(kinds, k) for c, k in zip(part["counts"].to_pylist(), n, strict=True)]
        different, which = np.unique(keys, return_inverse=True)
        total = np.zeros((kinds, len(different)), np.int64)
        at = 0
        for c in own:
            total[:, which[at:at + c.shape[1]]] += c.astype(np.int64)  # a lot asks for a key once
            at += c.shape[1]
        ends = np.cumsum(n)
        counts = [_packed(total[:, which[e - k:e]]) for k, e in zip(n, ends, strict=True)]
        return pa.table({"part": part["part"], "lot": part["lot"], "n": part["n"], "counts": pa.array(counts, pa.binary()),
                         "n_different": pa.array([len(different)] + [0] * (len(n) - 1), pa.int64())})

    return asked.groupBy("part").applyInArrow(run, TOTALS)


def _score_whole(texts: DataFrame) -> DataFrame:
    kind = texts.schema["id"].dataType.simpleString()
    lots = stored(_lots_of(texts), "lm-lots", compression="zstd")
    totals = [n or 0 for n in lots.agg(F.sum("target"), F.sum("corpus")).first()]
    bits = (totals[1] // PART).bit_length()
    n_parts = 1 << bits
    told = stored(_totals(_keys_of(lots, bits), n_parts), "lm-totals", compression="zstd")
    size = (told.where(F.col("part") < n_parts).agg(F.sum("n_different")).first()[0] or 0) + 1  # and a class of unknown words

    def run(lot: pa.Table, told: pa.Table) -> pa.Table:
        ids = lot["ids"].combine_chunks().flatten()
        lot = lot.drop_columns(["ids"]).to_pylist()[0]
        _, w, own, _, at = _opened(lot)
        first = _firsts(own)
        answers = told.sort_by("part").select(["part", "n", "counts"]).to_pylist()
        of_words, of_pairs = (np.concatenate([np.empty((kinds, 0))] + [
            _unpacked(a["counts"], kinds * a["n"]).reshape(kinds, -1) for a in answers if (a["part"] < n_parts) == (kinds == 4)], axis=1) for kinds in (4, 2))
        n = np.asarray(lot["size"], np.float64)
        target, corpus = _means((
            _loss(pairs[at], (words + FLOOR) / (total + FLOOR * size), ending + PRIOR, words + PRIOR, w, first)
            for words, ending, pairs, total in zip(of_words[:2], of_words[2:], of_pairs, totals, strict=True)), own, n)
        null = n == 0
        return pa.table({"doc_id": ids, "n_tokens": pa.array(lot["size"], pa.int64()), "target_loss": pa.array(target, mask=null),
                         "corpus_loss": pa.array(corpus, mask=null), "score": pa.array(target - corpus, mask=null)})

    asking = lots.select("lot", "ids", "size", "words", "tokens").groupBy("lot")
    return asking.cogroup(told.select("part", "lot", "n", "counts").groupBy("lot")).applyInArrow(run, f"doc_id {kind}, {SCORED}")


# Pruned models, sent to every task.


class _Model:
    """One bigram model: counts of the words and of the explicit pairs, ``total`` tokens in all."""

    def __init__(self, words: np.ndarray, total: int, pairs: np.ndarray, counts: np.ndarray):
        words = np.append(words, total - words.sum()).astype(np.float64)  # the last is the unknown class
        size = len(words)
        self.counts = np.append(counts, 0).astype(np.float64)
        explicit = np.bincount(pairs // size, counts, size)
        self.of_words = (words + FLOOR) / (total + FLOOR * size), words - explicit + PRIOR, words + PRIOR

    def loss(self, w: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each token, in nats; ``at``: the place of the pair that each token but the first of a text ends."""
        return _loss(self.counts[at], *self.of_words, w, first)


def _score_pruned(docs: DataFrame, texts: DataFrame, word_share: int, pair_share: int, doc_id: str, text: str) -> DataFrame:
    kind = docs.schema[doc_id].dataType.simpleString()
    words = stored(count_words(texts), "lm-words")
    totals = [n or 0 for n in words.agg(F.sum("target"), F.sum("corpus")).first()]
    vocabulary, of_words = _at_least(words, "word", totals, word_share)
    pairs, of_pairs = _at_least(count_pairs(texts, vocabulary), "pair", totals, pair_share)
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, of_words, pairs, of_pairs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, of_words, pairs, of_pairs = sent.value
        models = [_Model(a, n, pairs, b) for a, n, b in zip(of_words, totals, of_pairs, strict=True)]
        for b in batches:
            done = [np.empty((3, 0))]
            for lot in _lots(b["t"]):
                w, own = _numbered(lot, known)
                first = _firsts(own)
                different, which = np.unique(_pairs(w, own, len(known) + 1), return_inverse=True)
                at = _places(pairs, different)[which]
                n = np.bincount(own, minlength=len(lot)).astype(np.float64)
                done.append(np.stack([n, *_means((m.loss(w, first, at) for m in models), own, n)]))
            n, target, corpus = np.concatenate(done, axis=1)
            yield pd.DataFrame({"k": b["k"], "n_tokens": n.astype(np.int64), "target_loss": target, "corpus_loss": corpus, "score": target - corpus})

    rows = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("t"))
    return rows.mapInPandas(run, f"k {kind}, {SCORED}").withColumnRenamed("k", "doc_id")
