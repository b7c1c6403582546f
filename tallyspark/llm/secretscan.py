"""Secret scans through encoded layers (operator 12).

Three kinds of secret are looked for: an *assign*ment of a password or token, an
*access* key and a long *hex* string.  A text is scanned as it stands, which
gives its base spans, and then a worklist unwraps what is encoded in it:

* URL (``%41``) and Unicode (``\\u0041 \\x41 \\U00000041 &#65; &#x41;``) escapes,
  fullwidth letters and zero-width characters.  One linear pass reduces them
  innermost first on a stack, so an escape that is itself escaped, however
  deep, ends as its plain character (``%2541`` and ``%4%31`` as ``A``);
* base64 (also URL-safe, unpadded or wrapped in lines) of printable UTF-8 or
  UTF-16 text or of a compressed stream;
* gzip, zlib, bzip2, xz and zstandard streams.

Every layer that comes out is scanned again and put on the worklist, until none
is left (the fixpoint).  A layer that holds the same characters for the same
span of the text as one before is not taken again, which ends streams that
unpack to themselves.  A layer keeps, for each of its characters, the span of
the text that it came from, so a finding in any layer maps to code points of
the text.  Escapes are unwrapped in windows: the run of characters around them
that a match could reach.

Bounds.  Base64 shrinks a layer by a quarter and escapes end in one pass, so the
work is linear in the text; only compressed streams grow.  What the streams of
one base64 string may unpack to is ``MAX_UNPACKED`` bytes together; a stream that
would pass it is not read, and counted in ``n_unread``.

Defined cases: a null or empty text has no spans, and the digest is that of the
empty string; ties are ordered by start, kind as listed, end; the same span
found in several layers counts once; repeated rows are scanned each on its own;
texts are scanned whole, however long; an empty table gives no rows; other
columns are ignored by ``scan`` and carried through by ``masked_documents``.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import numbered

#: Fixed patterns, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Bytes that the compressed streams of one encoded string may unpack to.
MAX_UNPACKED = 64 << 20
#: Letters from which on a run counts as base64, and decoded characters from which on it is a layer.
MIN_BASE64, MIN_LAYER = 16, 8
MASK = "*"

_WIDE = "\uff01-\uff5e"
_GONE = "\u00ad\u200b-\u200d\u2060\ufeff"
_WINDOW = re.compile(rf"""[A-Za-z0-9+/_.=\-"':\x20%\\&#;{{}}{_WIDE}{_GONE}]+""")
_ODD = re.compile(rf"[{_WIDE}{_GONE}]")
_RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_BASE64},}}(?:\r?\n[A-Za-z0-9+/_-]{{4,}})*")
_BYTES = re.compile("[\udc80-\udcff]+")
_ESCAPE = (r"%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}"
           r"|\\U([0-9A-Fa-f]{8})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_LEAD, _TAIL = re.compile(rf"{_ESCAPE}|[{_WIDE}{_GONE}]"), re.compile(rf"(?:{_ESCAPE})\Z")
_LONGEST = 11
_LAST = frozenset("0123456789abcdefABCDEF;}")
_PRINTABLE = re.compile("[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ud800-\udfff\ufffd-\uffff]+")


def matches(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of the leftmost non-overlapping matches of each kind.

    Runs of access keys and hex digits that are too short are passed over by the count in
    the pattern; an assignment's value is measured afterwards, as a short one uses up its text.
    Cheaper tests come first: a keyword in lower letters, and a run of ``MIN_BASE64`` letters, which both other kinds hold."""
    small = text.lower()
    if any(x in small for x in _NAMES):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                yield m.start(), 0, m.end()
    if _RUN.search(text):
        for kind, pattern in ((1, _ACCESS), (2, _HEX)):
            for m in pattern.finditer(text):
                yield m.start(), kind, m.end()


class Layer:
    """Characters and, for each, the span of the text it came from."""

    __slots__ = ("text", "lo", "hi", "left")

    def __init__(self, text: str, lo: np.ndarray, hi: np.ndarray, left: list[int]):
        self.text, self.lo, self.hi, self.left = text, lo, hi, left

    def key(self) -> bytes:
        return hashlib.sha256(f"{self.lo[0]}:{self.hi[-1]}:".encode() + self.text.encode("utf-8", "surrogatepass")).digest()


def _joined_bytes(chars: list[str], lo: list[int], hi: list[int]):
    """UTF-8 sequences that came out of escapes byte by byte, as characters."""
    text = "".join(chars)
    if not _BYTES.search(text):
        return text, np.array(lo, np.int64), np.array(hi, np.int64)
    parts, first, last, at = [], [], [], 0
    for m in _BYTES.finditer(text):
        a, b = m.span()
        raw = bytes(ord(c) - 0xDC00 for c in m.group())
        part = raw.decode("utf-8", "replace")
        sizes = [len(c.encode()) for c in part] if "\ufffd" not in part else None
        if sizes is None:
            part, sizes = "\ufffd" * len(raw), [1] * len(raw)
        ends = np.cumsum(sizes)
        parts += [text[at:a], part]
        first += [lo[at:a], [lo[a + e - s] for e, s in zip(ends, sizes)]]
        last += [hi[at:a], [hi[a + e - 1] for e in ends]]
        at = b
    parts.append(text[at:])
    first.append(lo[at:])
    last.append(hi[at:])
    return "".join(parts), np.concatenate([np.array(x, np.int64) for x in first]), np.concatenate([np.array(x, np.int64) for x in last])


def _escapes(text: str) -> bool:
    return ("%" in text or "\\" in text or "&" in text or not text.isascii()) and _LEAD.search(text) is not None


def unescaped(layer: Layer) -> Layer | None:
    """The layer with escapes reduced until none is left, or None where there is none."""
    chars: list[str] = []
    lo: list[int] = []
    hi: list[int] = []
    changed = False
    for c, a, b in zip(layer.text, layer.lo.tolist(), layer.hi.tolist()):
        if _ODD.match(c):
            changed = True
            if not "\uff01" <= c <= "\uff5e":
                continue
            c = chr(ord(c) - 0xFEE0)
        chars.append(c)
        lo.append(a)
        hi.append(b)
        while chars[-1] in _LAST:
            tail = "".join(chars[-_LONGEST:])
            m = _TAIL.search(tail)
            if not m:
                break
            value = int(m.group(m.lastindex), 10 if m.lastindex == 7 else 16)
            n = len(tail) - m.start()
            if m.lastindex <= 2 and value >= 128:
                c = chr(0xDC00 + value)
            elif value > 0x10FFFF or 0xD800 <= value < 0xE000:
                c = "\ufffd"
            else:
                c = chr(value)
            first, last = lo[-n], hi[-1]
            del chars[-n:], lo[-n:], hi[-n:]
            changed = True
            if _ODD.match(c):
                if not "\uff01" <= c <= "\uff5e":
                    if not chars:
                        break
                    continue
                c = chr(ord(c) - 0xFEE0)
            chars.append(c)
            lo.append(first)
            hi.append(last)
    if not changed or not chars:
        return None
    return Layer(*_joined_bytes(chars, lo, hi), layer.left)


def _unpacked(raw: bytes, left: list[int]) -> tuple[str, bytes | None] | None:
    """What a compressed stream holds; None if it is none.  ``left`` holds the bytes still allowed, and the streams not read."""
    try:
        if raw[:2] == b"\x1f\x8b":
            name, d = "gzip", zlib.decompressobj(31)
            out = d.decompress(raw, left[0] + 1)
        elif raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] * 256 + raw[1]) % 31 == 0:
            name, d = "zlib", zlib.decompressobj()
            out = d.decompress(raw, left[0] + 1)
        elif raw[:3] == b"BZh":
            name, out = "bzip2", bz2.BZ2Decompressor().decompress(raw, left[0] + 1)
        elif raw[:6] == b"\xfd7zXZ\x00":
            name, out = "xz", lzma.LZMADecompressor().decompress(raw, left[0] + 1)
        elif raw[:4] == b"\x28\xb5\x2f\xfd":
            with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(raw) as r:
                name, out = "zstd", r.read(left[0] + 1)
        else:
            return None
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
        return None
    if len(out) > left[0]:
        left[1] += 1
        return name, None
    left[0] -= len(out)
    return name, out


def _as_text(raw: bytes) -> tuple[str, np.ndarray] | None:
    """Printable text of the bytes and the byte at which each character starts, with one more for the end."""
    for codec, width in (("utf-8", 0), ("utf-16-le", 2), ("utf-16-be", 2)):
        if width and (len(raw) % 2 or raw.count(0) * 4 < len(raw)):
            continue
        try:
            text = raw.decode(codec)
        except UnicodeDecodeError:
            continue
        if len(text) < MIN_LAYER or not _PRINTABLE.fullmatch(text):
            continue
        if text.isascii() and not width:
            return text, np.arange(len(text) + 1)
        sizes = [len(c.encode(codec)) for c in text]
        return text, np.concatenate(([0], np.cumsum(sizes)))
    return None


def _decoded(run: str) -> bytes | None:
    if len(run) < MIN_BASE64 or len(run) % 4 == 1:
        return None
    return base64.b64decode(run.translate({45: 43, 95: 47}) + "=" * (-len(run) % 4))


def _layers_of(raw: bytes, lo: np.ndarray, hi: np.ndarray, left: list[int], whole: bool, names: set[bytes]) -> Iterator[Layer]:
    """The text in the bytes, through any number of compressed streams.  ``lo`` and ``hi`` hold a span for each
    byte; what comes out of a stream belongs to the whole of it."""
    while True:
        if found := _as_text(raw):
            text, at = found
            if whole:
                first, last = np.full(len(text), lo[0]), np.full(len(text), hi[-1])
            else:
                first, last = lo[at[:-1]], hi[at[1:] - 1]
            yield Layer(text, first, last, left)
            return
        name = hashlib.sha256(raw).digest()
        if name in names:
            return
        names.add(name)
        out = _unpacked(raw, left)
        if out is None or out[1] is None:
            return
        raw, whole = out[1], True


def base64_layers(layer: Layer, root: bool, limit: int, unread: list[int]) -> Iterator[Layer]:
    """The layers in base64 runs: a run as a whole, or else its lines, or else what stands between its signs."""
    for m in _RUN.finditer(layer.text):
        todo = deque([(m.start(), m.end(), 0)])
        while todo:
            a, b, depth = todo.popleft()
            piece = layer.text[a:b]
            where = np.array([i for i, c in enumerate(piece) if c not in "\r\n"]) + a if depth == 0 and "\n" in piece else np.arange(a, b)
            raw = _decoded("".join(piece.split()) if depth == 0 else piece)
            found = False
            if raw:
                bit = np.arange(len(raw)) * 8
                lo, hi = layer.lo[where[bit // 6]], layer.hi[where[(bit + 7) // 6]]
                left = [limit, 0] if root else layer.left
                before = left[1]
                for out in _layers_of(raw, lo, hi, left, False, set()):
                    found = True
                    yield out
                unread[0] += left[1] - before
                found |= left[1] > before
            if not found and depth < 2:
                split = re.compile(r"[^\r\n]+" if depth == 0 else r"[A-Za-z0-9]+")
                todo.extend((a + x.start(), a + x.end(), depth + 1) for x in split.finditer(piece)
                            if x.end() - x.start() >= MIN_BASE64 and (depth == 0 or x.end() - x.start() < b - a))


def find(text: str | None, limit: int = MAX_UNPACKED):
    """(base spans, all spans, layers read, streams not read) of a text; spans are sorted (start, kind, end)."""
    if not text:
        return [], [], 0, 0
    base = sorted(matches(text))
    spans, unread, n = set(base), [0], 0
    work: deque[tuple[Layer, bool]] = deque()
    if _escapes(text):
        for m in _WINDOW.finditer(text):
            if _LEAD.search(text, m.start(), m.end()):
                where = np.arange(m.start(), m.end())
                if (out := unescaped(Layer(m.group(), where, where + 1, [limit, 0]))) is not None:
                    work.append((out, True))
    if _RUN.search(text):
        where = np.arange(len(text))
        work.extend((x, False) for x in base64_layers(Layer(text, where, where + 1, [limit, 0]), True, limit, unread))
    seen: set[bytes] = set()
    while work:
        layer, root = work.popleft()
        key = layer.key()
        if key in seen:
            continue
        seen.add(key)
        n += 1
        lo, hi = layer.lo, layer.hi
        spans.update((int(lo[s]), kind, int(hi[e - 1])) for s, kind, e in matches(layer.text))
        if _escapes(layer.text) and (out := unescaped(layer)) is not None:
            work.append((out, root))
        work.extend((x, False) for x in base64_layers(layer, root, limit, unread))
    return base, sorted(spans), n, unread[0]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_COLUMNS = ("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long, n_layers long, n_unread long")


def scan(docs: DataFrame, limit: int = MAX_UNPACKED) -> DataFrame:
    """One row a document: counts of base spans, their digest, all spans, layers read, streams not read."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base, spans, layers, unread = find(text, limit)
                n = [sum(k == x for _, x, _ in base) for k in range(3)]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans), layers, unread))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in _COLUMNS.split(", ")])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _nullable(docs.select("doc_id", "text"), run, kind)


def _nullable(docs: DataFrame, run, kind: str) -> DataFrame:
    """Applies ``run`` with ids as strings, so that null ids of any type come through pandas unchanged."""
    out = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, f"doc_id string, {_COLUMNS}")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def masked_documents(docs: DataFrame, limit: int = MAX_UNPACKED) -> DataFrame:
    """The documents, all columns kept, with every code point of every span replaced by ``MASK``."""
    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        def one(text):
            spans = find(text, limit)[1]
            if not spans:
                return text
            parts, at = [], 0
            for a, _, b in spans:
                if b > at:
                    parts += [text[at:max(a, at)], MASK * (b - max(a, at))]
                    at = b
            return "".join(parts) + text[at:]
        return texts.map(one, na_action="ignore")

    plain, (text,) = numbered(docs, "text")
    return plain.withColumn(text, masked(text)).toDF(*docs.columns)
