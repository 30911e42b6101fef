"""Secret scan over a text and everything encoded inside it.

A worklist starts with the text itself. Every layer is scanned, then unwrapped: percent escapes and
Unicode escapes are undone over the whole layer, each run of base64 (over line ends, if it is wrapped)
gives a layer for each of the four places where its groups can start, since what stands before it may be
of the same letters, each run of hexadecimal digits one for each of its two, and compressed streams are
unfolded wherever a layer holds them, so also inside what another stream unfolded to. Bytes are read as one
character each, text or not, as secrets and escapes are ASCII. New layers join the worklist until none
is left; a layer equal to one that it came from is a cycle and is left out, and one that was reached
before from the same stretch of the text (escapes undone in another order) is not scanned again, so the
work does not double with each kind of escape. Spans found in a layer are mapped back through the
layers above it to code points of the text.

Cases: a null text is empty; equal spans of one kind count once; a compressed stream that unfolds to more
than ``MAX_UNFOLDED`` bytes is read in blocks of that size, each with the last ``OVERLAP`` bytes of the one
before, which bounds a task's memory; one that breaks off gives what it holds; streams written one after
the other are all read; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("passw", "secret", "token", "api")  # one of them is in every assignment
MIN_VALUE, MIN_ACCESS = 6, 20

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|%u([0-9A-Fa-f]{4})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}")  # 16 characters hold 12 bytes, the shortest assignment
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)+")
HEXED = re.compile(r"[0-9A-Fa-f]{24,}")  # 24 digits hold 12 bytes
LINE = re.compile(r"[^ \t\r\n]+")
URL_SAFE = str.maketrans("-_", "+/")
PACKED = (b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda")
MAGIC = re.compile(b"|".join(map(re.escape, PACKED)))
MAGIC_TEXT = re.compile(MAGIC.pattern.decode("latin-1"))
MAX_UNFOLDED = 64 << 20
OVERLAP = PIECE = 1 << 20

Span = tuple[int, int]


class _Layer:
    """A text with, for stretches of it, the place in the layer above that each came from."""

    def __init__(self, text: str, above: _Layer | None = None, stretches: list[tuple[int, int, int, int, int]] | None = None):
        self.text, self.above = text, above
        self.stretches = stretches or []  # (start here, start above, end above, units here, characters above a unit set)
        self.starts = [s[0] for s in self.stretches]

    def cyclic(self) -> bool:
        a = self.above
        while a is not None:
            if a.text == self.text:
                return True
            a = a.above
        return False

    def _place(self, at: int, last: bool) -> int:
        start, first, end, per, width = self.stretches[bisect_right(self.starts, at) - 1]
        if not per:  # taken as a whole
            return end if last else first
        done = (at - start) * width
        return min(end, first + -(-(done + width) // per)) if last else first + done // per

    def origin(self, span: Span) -> Span:
        layer, (a, b) = self, span
        while layer.above is not None:
            a, b = layer._place(a, False), layer._place(b - 1, True)
            layer = layer.above
        return a, b


def scan(text: str) -> Iterator[tuple[str, int, int]]:
    """Secrets written plainly in ``text``, leftmost and without overlap for each kind."""
    low = text.lower()
    if any(name in low for name in NAMES):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= MIN_VALUE:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= MIN_ACCESS:
                yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


def _pieces(data: bytes, at: int, ends: list[int]) -> Iterator[bytes]:
    """What the compressed stream at ``at`` and those right behind it unfold to, piece by piece, until they break off;
    if they do not, ``ends`` gets the place behind them."""
    try:
        while data.startswith(PACKED, at):
            if data.startswith(b"\x28\xb5\x2f\xfd", at):
                import zstandard

                with zstandard.ZstdDecompressor().stream_reader(memoryview(data)[at:], read_across_frames=True) as r:
                    while piece := r.read(PIECE):
                        yield piece
                return
            if data.startswith(b"BZh", at):
                d = bz2.BZ2Decompressor()
            elif data.startswith(b"\xfd7zX", at):
                d = lzma.LZMADecompressor()
            else:
                d = zlib.decompressobj(31 if data.startswith(b"\x1f\x8b", at) else 15)
            rest = b""
            while not d.eof:
                if not rest and getattr(d, "needs_input", True):
                    rest = data[at : at + PIECE]
                    at += len(rest)
                    if not rest:
                        break
                piece = d.decompress(rest, PIECE)
                rest = getattr(d, "unconsumed_tail", b"")  # of zlib; the others keep what they have not used
                if piece:
                    yield piece
            if isinstance(d, (bz2.BZ2Decompressor, lzma.LZMADecompressor)) or d.eof:
                at -= len(d.unused_data)
            if not d.eof:  # broken off: zlib may hold back the last bytes
                if hasattr(d, "flush"):
                    yield d.flush()
                return
        ends.append(at)
    except Exception:  # noqa: BLE001  each library has its own error for bytes that only look packed
        return


def _blocks(data: bytes, at: int = 0, ends: list[int] | None = None) -> Iterator[bytes]:
    """What the streams at ``at`` unfold to: whole, or in overlapping blocks if it is large."""
    held, new = bytearray(), False
    for piece in _pieces(data, at, [] if ends is None else ends):
        held += piece
        new = True
        if len(held) >= MAX_UNFOLDED:
            yield bytes(held)
            held, new = held[-OVERLAP:], False
    if new and held:
        yield bytes(held)


def _unfold(data: bytes) -> bytes | None:
    """The bytes of a compressed stream, or None if it is none or takes several blocks."""
    blocks = list(islice(_blocks(data), 2))
    return blocks[0] if len(blocks) == 1 else None


def _packed(data: bytes, layer: _Layer, a: int, b: int) -> Iterator[_Layer]:
    """The layers of the compressed streams anywhere in ``data``, which stands in ``layer`` from a to b."""
    for m in MAGIC.finditer(data):
        for raw in _blocks(data, m.start()):
            yield _Layer(raw.decode("latin-1"), layer, [(0, a, b, 0, 0)])


def _unpacked(layer: _Layer) -> Iterator[_Layer]:
    """The layers of the compressed streams among the characters of ``layer``, read as bytes."""
    if MAGIC_TEXT.search(layer.text) is None:
        return
    data = layer.text.encode("latin-1", "replace")
    for m in MAGIC.finditer(data):
        ends: list[int] = []
        for raw in _blocks(data, m.start(), ends):
            yield _Layer(raw.decode("latin-1"), layer, [(0, m.start(), ends[-1] if ends else len(data), 0, 0)])


def _rewritten(layer: _Layer, pattern: re.Pattern, decode) -> _Layer | None:
    """The layer with every match of ``pattern`` replaced; decode gives the new text and whether its characters align."""
    parts: list[str] = []
    stretches, at, size = [], 0, 0

    def add(text: str, a: int, b: int, per: int, width: int) -> None:
        nonlocal size
        if text:
            parts.append(text)
            stretches.append((size, a, b, per, width))
            size += len(text)

    for m in pattern.finditer(layer.text):
        new = decode(m)
        if new is None:
            continue
        add(layer.text[at : m.start()], at, m.start(), 1, 1)
        width = (m.end() - m.start()) // len(new) if new and (m.end() - m.start()) % len(new) == 0 else 0
        add(new, m.start(), m.end(), 1 if width else 0, width)
        at = m.end()
    if not at:
        return None
    add(layer.text[at:], at, len(layer.text), 1, 1)
    return _Layer("".join(parts), layer, stretches)


def _percent(m: re.Match) -> str | None:
    return bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace")


def _escape(m: re.Match) -> str | None:
    *in_hex, decimal = m.groups()
    code = int(decimal) if decimal else int(next(g for g in in_hex if g), 16)
    return chr(code) if 0 <= code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _unwrapped(layer: _Layer) -> Iterator[_Layer]:
    text = layer.text
    yield from _unpacked(layer)
    if "%" in text:
        for m in PERCENT.finditer(text):
            yield from _packed(bytes.fromhex(m[0].replace("%", "")), layer, m.start(), m.end())
        if new := _rewritten(layer, PERCENT, _percent):
            yield new
    if ("\\" in text or "&#" in text or "%u" in text) and (new := _rewritten(layer, ESCAPE, _escape)):
        yield new
    for m in HEXED.finditer(text):
        for a in (m.start(), m.start() + 1):
            b = m.end() - (m.end() - a) % 2
            yield _Layer(bytes.fromhex(text[a:b]).decode("latin-1"), layer, [(0, a, b, 1, 2)])
    for m in BASE64.finditer(text):
        yield from _decoded(layer, m.start(), m.end())
    for m in WRAPPED.finditer(text):
        lines = [(x.start(), x.end()) for x in LINE.finditer(text, m.start(), m.end())]
        starts = accumulate((b - a for a, b in lines), initial=0)
        joined = _Layer("".join(text[a:b] for a, b in lines), layer, [(at, a, b, 1, 1) for at, (a, b) in zip(starts, lines)])
        yield from _decoded(joined, 0, len(joined.text))


def _decoded(layer: _Layer, a: int, b: int) -> Iterator[_Layer]:
    """The layers of the base64 from a to b, for each place where its groups of four characters can start."""
    for first in range(a, min(a + 4, b - 15)):
        last = b - ((b - first) % 4 == 1)
        data = base64.b64decode(layer.text[first:last].translate(URL_SAFE) + "=" * (-(last - first) % 4))
        yield _Layer(data.decode("latin-1"), layer, [(0, first, last, 3, 4)])  # three bytes are four characters


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(spans of the text itself, all spans), each (kind, start, end), sorted by start, kind as listed, end."""
    order = {k: i for i, k in enumerate(KINDS)}
    root = _Layer(text or "")
    base = list(scan(root.text))
    found = set(base)
    work = [_unwrapped(root)]  # layers are made one at a time, so those of a large stream are not held together
    seen: set[tuple[bytes, int, int]] = set()
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        digest = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        known = (digest, *layer.origin((0, len(layer.text))))
        if known in seen or layer.cyclic():
            continue
        seen.add(known)
        for kind, a, b in scan(layer.text):
            found.add((kind, *layer.origin((a, b))))
        work.append(_unwrapped(layer))
    by = lambda s: (s[1], order[s[0]], s[2])
    return sorted(base, key=by), sorted(found, key=by)


def scan_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of the plain spans by kind, their digest, and all spans, one row per document."""
    kind = docs.schema[doc_id].dataType.simpleString()
    written = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["t"]:
                base, every = find(t)
                kinds = [s[0] for s in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            yield pd.concat([b[["k"]].reset_index(drop=True), out], axis=1)

    rows = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("t"))
    schema = f"k {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return rows.mapInPandas(run, schema).withColumnRenamed("k", "doc_id")
