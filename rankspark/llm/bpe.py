"""Byte-level BPE by backtracking over longest matches.

The bytes of a piece are read as Latin-1 so that an Aho-Corasick automaton over the vocabulary finds
all tokens in them. Encoding takes the longest token at each place, and gives it up for the next
shorter one (or goes back one token) when it cannot stand beside its left neighbour in a true merge
sequence, or leads to a place already found to be a dead end. Two adjacent tokens are compatible if
no merge of lower rank joins parts of them across their border; that answer is memoised. A place is
given up once at most, so the work is linear in the piece.

Cases: a null text is empty; any text round-trips byte for byte; long texts and long pieces need
memory in proportion to themselves; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO_PIECES = 300_000  # remembered pieces and pairs per task; beyond that the memo starts anew
MEMO_PAIRS = 1_000_000
MEMO_LEN = 40


class Pieces(dict):
    """Remembered encodings of short pieces."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.codec.encode_piece(piece.encode("utf-8"))
        if len(piece) <= MEMO_LEN:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder for one rank file (``base64(token) rank`` a line)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).findall
        self.token = {r: t for t, r in self.rank.items()}
        self.text = {r: str(r) for r in self.token}
        self.automaton = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), r))
        self.automaton.make_automaton()
        self.pieces = Pieces(self)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int | None] = {}  # token -> its longest proper prefix that is a token
        self.merged: dict[tuple[int, int], int] = {}  # the last merge that makes a token, by its parts
        self.parts: dict[int, tuple[int, int]] = {}
        for t, r in sorted(self.rank.items(), key=lambda x: x[1]):
            self._learn(t, r)

    def _learn(self, t: bytes, r: int) -> None:
        """Find the two tokens whose merge makes ``t``: the only split that is itself compatible."""
        cuts = [n for n in range(len(t) - 1, 0, -1) if t[:n] in self.rank]
        self.shorter[r] = self.rank[t[: cuts[0]]] if cuts else None
        for n in cuts:
            a, b = self.rank[t[:n]], self.rank.get(t[n:], r)
            if a < r and b < r and self._compatible(a, b):
                self.merged[a, b], self.parts[r] = r, (a, b)
                return

    def _compatible(self, a: int, b: int) -> bool:
        """Whether BPE can leave ``a`` and ``b`` side by side.

        Undo merges on either side of the border, the latest first; if the two parts that then touch
        have a merge that ranks before the one undone, BPE would have joined them.
        """
        undone = len(self.rank) + 1
        while True:
            if self.merged.get((a, b), undone) < undone:
                return False
            undo_left = a > b if a in self.parts and b in self.parts else a in self.parts
            if undo_left:
                undone, a = a, self.parts[a][1]
            elif b in self.parts:  # a merge of equal rank happens further left first
                undone, b = b + 1, self.parts[b][0]
            else:
                return True

    def _fits(self, a: int, b: int) -> bool:
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            ok = self.pairs[a, b] = self._compatible(a, b)
        return ok

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        if data in self.rank:
            return (self.rank[data],)
        longest: list[int | None] = [None] * (len(data) + 1)
        for end, (n, r) in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - n] = r  # later ends are longer
        size = self.token
        alive = bytearray(b"\1") * (len(data) + 1)
        out: list[int] = []
        at, tok = 0, longest[0]
        while at < len(data):
            end = at + len(size[tok])
            if alive[end] and (not out or self._fits(out[-1], tok)):
                out.append(tok)
                at, tok = end, longest[end]
                continue
            tok = self.shorter[tok]
            while tok is None:  # nothing shorter: this place is a dead end, go back a token
                alive[at] = 0
                last = out.pop()
                at -= len(size[last])
                tok = self.shorter[last]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.find(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per Python worker."""
    return Codec(path, pattern)


def encode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the token ``ids`` and the ``decoded`` bytes of every text, one row per document."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(ranks, pattern)
        for b in batches:
            ids = [c.encode(t or "") for t in b["t"]]
            yield pd.DataFrame({"k": b["k"], "ids": ids, "decoded": [c.decode(x) for x in ids]})

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInPandas(run, f"k {kind}, ids array<int>, decoded binary").withColumnRenamed("k", key)


def digests(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text",
            with_ids: bool = False) -> DataFrame:
    """``key``, n_tokens and digests of the ids and of the decoded bytes; the ``ids`` too or they stay in the task."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(ranks, pattern)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for b in batches:
            n, ids_sha, decoded_sha, kept = [], [], [], []
            for t in b["t"]:
                ids = c.encode(t or "")
                n.append(len(ids))
                if with_ids:
                    kept.append(ids)
                ids_sha.append(sha(" ".join(map(c.text.__getitem__, ids)).encode()))
                decoded_sha.append(sha(c.decode(ids)))
            yield pd.DataFrame({"k": b["k"], "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha} | ({"ids": kept} if with_ids else {}))

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return rows.mapInPandas(run, schema).withColumnRenamed("k", key)
