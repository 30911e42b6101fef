"""Language identification with error-correcting output codes.

Every language gets a codeword of bits; a bit splits the languages into two sides, and one binary
classifier per bit tells the sides apart by character n-grams. Up to EXHAUSTIVE languages the code has
every split there is; beyond, it is the best of some random codes by the least distance of two codewords.

A classifier is a naive Bayes log-odds weight per hashed n-gram. All texts of the training table are
counted, each task adding up its own counts before Spark adds those of all tasks, so the model is exact
for the whole table and bounded by languages x BUCKETS. A text's margin for a bit is the
mean weight of its n-grams, times SHARP and drawn towards 0 where there are few.

Decoding is loss-weighted: the logistic loss of each margin against a language's bit counts with the
share of that language's training texts which the bit's classifier gets right, normalised per language.
The language of the least weighted loss wins (ties: the smallest name); ``score`` is its share of
exp(-loss), and a text is ``ambiguous`` where the runner-up comes within AMBIGUOUS of that score.

Cases: a null text, or one without a letter, is ``und`` with score 0 and not ambiguous; so is every text
if nothing was learnt. Training rows with a null text or language are passed over. One language only:
every text with a letter gets it, score 1. Null keys are kept, repeated rows give repeated results, other
columns are not read. Long texts are read whole, in pieces. More than LANGUAGES languages raise an error:
that many labels are not a list of languages.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 16  # hashed n-grams
ORDERS = (1, 2, 3)  # characters in an n-gram
PRIOR = 0.5  # added to each count
EXHAUSTIVE = 7  # languages up to which the code holds all splits
AMBIGUOUS = 0.5
SHARP, FEW = 3.0, 30  # margin of a text: SHARP * sum of weights / (number of n-grams + FEW)
LANGUAGES = 200
PIECE = 1 << 20  # characters read at once
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> Iterator[np.ndarray]:
    """The hashed n-grams of a text: lower-cased words of letters, parted by one space, with one before and after."""
    tail = np.array([32], np.uint32)
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "replace"), np.uint32)
        codes = np.where(_letters()[codes], codes, 32)
        if at + PIECE >= len(text):
            codes = np.append(codes, np.uint32(32))
        codes = np.concatenate([tail, codes])
        gap = codes == 32
        codes = codes[~(gap & np.append(False, gap[:-1]))]
        yield _hashed(codes, len(tail) if at else 0)
        tail = codes[-2:]


def _hashed(codes: np.ndarray, seen: int) -> np.ndarray:
    """Buckets of all n-grams that end after the first ``seen`` characters."""
    c = codes.astype(np.uint64)
    out = []
    for n in ORDERS:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (c[k : len(c) - n + 1 + k] * np.uint64(0xC2B2AE3D27D4EB4F))
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 16)
        out.append(h[max(0, seen - n + 1) :].astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def codewords(n: int) -> np.ndarray:
    """``n`` codewords as rows of +1 and -1; no column is all alike, none is another's negative while all splits fit."""
    if n <= 1:
        return np.ones((n, 0), np.int8)
    if n <= EXHAUSTIVE:
        splits = range(1, 1 << (n - 1))  # the last language is always on the negative side
        return np.array([[1 if s >> i & 1 else -1 for s in splits] for i in range(n)], np.int8)
    bits, rng, best, reach = math.ceil(10 * math.log2(n)), np.random.default_rng(n), None, -1
    for _ in range(100):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        mixed = (code.min(0) < 0).all() and (code.max(0) > 0).all()
        agree = code.astype(np.int32) @ code.T
        np.fill_diagonal(agree, -bits)
        least = (bits - int(agree.max())) // 2  # distance of the closest two
        if mixed and least > reach:
            best, reach = code, least
    return best


@dataclass(frozen=True)
class Model:
    """Languages in name order, their codewords, the weight of each n-gram per bit, and of each bit per language."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.code.shape[1]), 0
        for g in grams(text):
            if len(g):
                total += self.weights[g].sum(0, dtype=np.float64)
                n += len(g)
        return SHARP * total / (n + FEW)

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        """Language, score and ambiguity of one text's margins."""
        loss = (self.trust * np.logaddexp(0, -self.code * margins)).sum(1)
        share = np.exp(loss.min() - loss)
        share /= share.sum()
        best = int(loss.argmin())
        rest = np.delete(share, best)
        return self.languages[best], float(share[best]), bool(len(rest) and share[best] - rest.max() < AMBIGUOUS)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, False
        return self.decode(self.margins(text))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counts(train: DataFrame, text: str = "text", label: str = "lang") -> DataFrame:
    """(lang, bucket, n): n-grams of all texts per language; lang with bucket null: its n texts with a letter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        total: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}

        def fold(lang: str) -> None:
            got = np.bincount(np.concatenate(held.pop(lang)), minlength=BUCKETS)
            total[lang] = total[lang] + got if lang in total else got

        sizes: dict[str, int] = {}
        for b in batches:
            for lang, t in zip(b["lang"], b["t"], strict=True):
                if not has_letter(t):
                    continue
                texts[lang] = texts.get(lang, 0) + 1
                for g in grams(t):
                    held.setdefault(lang, []).append(g)
                    sizes[lang] = sizes.get(lang, 0) + len(g)
                    if sizes[lang] > PIECE:
                        fold(lang)
                        sizes[lang] = 0
        for lang in list(held):
            fold(lang)
        for lang, got in total.items():
            at = np.flatnonzero(got)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype("int32"), "n": got[at].astype("int64")})
        if texts:
            yield pd.DataFrame({"lang": list(texts), "bucket": np.int32(-1), "n": list(texts.values())})

    rows = train.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(label).alias("lang"), F.col(text).alias("t"))
    return rows.mapInPandas(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(train: DataFrame, text: str = "text", label: str = "lang") -> Model:
    """Learn from every row of ``train``: one pass counts n-grams, a second measures the bits per language."""
    found = counts(train, text, label).select("lang", "bucket", "n").toArrow().to_pandas()  # languages x BUCKETS at most
    languages = sorted(found["lang"].unique())
    if len(languages) > LANGUAGES:
        raise ValueError(f"{len(languages)} labels are more than {LANGUAGES}: not a list of languages")
    code = codewords(len(languages))
    seen = np.zeros((len(languages), BUCKETS))
    found = found[found["bucket"] >= 0]
    row = {lang: i for i, lang in enumerate(languages)}
    seen[found["lang"].map(row).to_numpy(int), found["bucket"].to_numpy(int)] = found["n"].to_numpy(float)
    side = lambda s: _log_share(s.astype(float).T @ seen)  # noqa: E731  bits x BUCKETS
    weights = np.ascontiguousarray((side(code > 0) - side(code < 0)).T, np.float32)
    model = Model(languages, code, weights, np.ones(code.shape))
    return Model(languages, code, weights, _trust(train, model, text, label))


def _log_share(counted: np.ndarray) -> np.ndarray:
    return np.log((counted + PRIOR) / (counted + PRIOR).sum(1, keepdims=True))


def _trust(train: DataFrame, model: Model, text: str, label: str) -> np.ndarray:
    """Per language, the share of its texts that each bit gets right, normalised to a mean of one."""
    n, bits = model.code.shape
    if not bits:
        return np.ones((n, bits))
    shared = train.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        row = {lang: i for i, lang in enumerate(m.languages)}
        right, texts = np.zeros((n, bits), np.int64), np.zeros(n, np.int64)
        for b in batches:
            for lang, t in zip(b["lang"], b["t"], strict=True):
                if has_letter(t):
                    i = row[lang]
                    right[i] += m.code[i] * m.margins(t) > 0
                    texts[i] += 1
        lang, bit = np.divmod(np.arange(n * bits), bits)
        yield pd.DataFrame({"lang": lang, "bit": bit, "n_right": right.ravel(), "n": texts[lang]})

    rows = train.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(label).alias("lang"), F.col(text).alias("t"))
    got = rows.mapInPandas(run, "lang long, bit long, n_right long, n long").groupBy("lang", "bit").agg(F.sum("n_right").alias("n_right"), F.sum("n").alias("n"))
    trust = np.zeros((n, bits))
    for r in got.collect():  # a row per language and bit
        trust[r.lang, r.bit] = r.n_right / max(r.n, 1)
    mean = trust.mean(1, keepdims=True)
    return np.where(mean > 0, trust / np.where(mean > 0, mean, 1), 1.0)


PREDICTION = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])


def predict(spark: SparkSession, docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, lang_pred, score and ambiguous of every text."""
    kind = docs.schema[key].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [shared.value.predict(t.as_py()) for t in b.column(1)]
            lang, score, unsure = zip(*said, strict=True) if said else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                names=["k", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"k {kind}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("k", key)
