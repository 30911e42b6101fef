"""Periodic runs in word sequences, by online dyadic square catching.

Words are appended one at a time. Level k looks for squares of period 2^(k+1)-1 .. 2^(k+2)-2: the first
half of such a square holds a whole aligned block of 2^k words, so a *catcher* is kept for every completed
block of 2^k words while a second copy can still end within those periods. That is two live catchers a
level. Each appended word is compared with them as the suffix of 2^k words that it ends; suffixes carry
exact names (the place where the same words stood first, found from the names of their halves), so a
comparison is one look-up, and a suffix that has not stood before ends the climb through the levels.

A catch gives a period. Names also tell how far the agreement at that distance reaches back, hence at
which word its square would be complete; there it is compared again, and a square that is new and not a
repetition of a shorter one opens a run. Squares of the same period that overlap belong to one run: it
stays open until a word breaks the period. The work is n log^2 n at most for n words, whatever they are.

Cases: a null or empty text has no words, no runs and an empty kept text; a null key is kept; repeated
rows give repeated results; other columns are not read, so their names cannot clash; an empty table
gives an empty result. Memory is in proportion to the longest text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12  # words in a run, at least (and two periods)
WORDS = re.compile(r"[^ \t-\r]+").findall


class SquareCatcher:
    """Maximal runs of an appended sequence: stretches of two smallest periods or more, ``least`` words or more."""

    def __init__(self, least: int = LEAST, room: int = 64):
        self.least, self.n, self.room = least, 0, max(room, 1)
        self.first: dict = {}  # word -> its first place
        self.names = [array("q", range(self.room))]  # by level: place -> first end of the same 2^k words
        self.pairs: list[dict[tuple[int, int], int]] = [{}]  # by level: names of the halves -> that first end
        self.due: dict[int, list[tuple[int, int]]] = {}  # place -> (period, start) of squares complete there
        self.open: dict[int, int] = {}  # period -> start of the runs that still go on
        self.runs: list[tuple[int, int, int]] = []

    def extend(self, words: Iterable) -> SquareCatcher:
        for w in words:
            self.append(w)
        return self

    def append(self, word) -> None:
        n = self.n
        self.n = n + 1
        if n == self.room:
            self.room *= 2
            for level in self.names:
                level.extend(range(n, self.room))
        name = self.first.setdefault(word, n)
        words = self.names[0]
        words[n] = name
        if self.open:
            for p in [p for p in self.open if words[n - p] != name]:
                self._close(p, n)
        if name != n:
            self._climb(n, name)
        if n in self.due:
            for p, start in sorted(set(self.due.pop(n))):
                if p not in self.open and not self._inside(p, start) and self._common(n, n - p) >= p:
                    self.open[p] = start

    def result(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs so far, by start and period; those still open end with the last word."""
        now = [(s, self.n - s, p) for p, s in self.open.items() if self.n - s >= self.least]
        return sorted(self.runs + now, key=lambda r: (r[0], r[2]))

    def _climb(self, n: int, name: int) -> None:
        """Compare the suffix that ends at ``n`` with the live catchers, level by level while it stood before."""
        size, k = 1, 0
        while True:
            level = self.names[k]
            end = (n - 2 * size + 2) // size * size - 1
            if end >= size - 1:
                if level[end] == name:
                    self._caught(n, end, size)
                end -= size
                if end >= size - 1 and level[end] == name:
                    self._caught(n, end, size)
            if n + 1 < 2 * size:
                return
            left, k = level[n - size], k + 1
            if k == len(self.names):
                self.names.append(array("q", range(self.room)))
                self.pairs.append({})
            if not (name + 1 >= 2 * size and level[name - size] == left):  # else the longer words stood there first, too
                name = self.pairs[k].setdefault((left, name), n)
                if name == n:
                    return
            self.names[k][n] = name
            size *= 2

    def _caught(self, n: int, end: int, size: int) -> None:
        p = n - end
        if p in self.open or self._inside(p, end - size + 1):
            return
        start = end - self._common(n, end) + 1
        self.due.setdefault(max(n, start + 2 * p - 1), []).append((p, start))

    def _inside(self, p: int, start: int) -> bool:
        """Whether the words from ``start`` on lie in an open run of which ``p`` is a multiple."""
        return any(p % q == 0 and s <= start for q, s in self.open.items())

    def _common(self, a: int, b: int) -> int:
        """Number of equal words up to the places ``a`` > ``b``, going back."""
        total = 0
        for k in range(min(len(self.names), (b + 1).bit_length()) - 1, -1, -1):
            size, level = 1 << k, self.names[k]
            while b + 1 >= size and level[a] == level[b]:
                total, a, b = total + size, a - size, b - size
        return total

    def _close(self, p: int, n: int) -> None:
        start = self.open.pop(p)
        if n - start >= self.least:
            self.runs.append((start, n - start, p))


def runs_of(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    return SquareCatcher(least, len(words)).extend(words).result()


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    keep, upto = [], 0
    for a, b in sorted((s + p, s + n) for s, n, p in runs):
        if a > upto:
            keep += words[upto:a]
        upto = max(upto, b)
    return keep + words[upto:]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``key``, n_words, ``runs`` (start, length, period) and ``kept``, the words left joined by one space."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                n, found, kept = [], [], []
                for t in part.column(1):
                    words = WORDS(t.as_py() or "")
                    rs = runs_of(words, least)
                    n.append(len(words))
                    found.append([{"start": s, "length": m, "period": p} for s, m, p in rs])
                    kept.append(" ".join(collapsed(words, rs)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(found, pa.list_(RUN)), pa.array(kept, pa.string())],
                    names=["k", "n_words", "runs", "kept"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = rows.mapInArrow(run, f"k {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, kept string")
    return out.withColumnRenamed("k", key)
