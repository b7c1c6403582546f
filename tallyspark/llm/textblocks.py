"""Text as flat byte buffers for the Arrow-batch operators, and hash-dealt blocks of documents.

An Arrow string column is one byte buffer plus row offsets; words, n-grams and
byte windows of a whole batch are then found with numpy over that buffer, with
no Python object per word.  Hashes are 64-bit: a word is the wrapping sum of
``T[byte] * B**position`` (random odd ``B``, random table ``T``) finalised
with splitmix64.  Two different words of a corpus of n distinct ones share a
hash with probability about n*n / 2**65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
#: Bytes that separate words: space and \\t \\n \\v \\f \\r.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_B = U(0x9E3779B97F4A7C15)
_B_INV = U(pow(int(_B), -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
#: The same table with A-Z read as a-z.
_TABLE_FOLDED = _TABLE.copy()
_TABLE_FOLDED[65:91] = _TABLE[97:123]
_CHUNK = 1 << 18


def _powers(base: U, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_POW, _POW_INV = _powers(_B, _CHUNK), _powers(_B_INV, _CHUNK)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser of an array of 64-bit words."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word of the buffer; words never cross rows."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~_IS_SPACE[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offs[:-1] < offs[1:]
    first[offs[:-1][full]] = inside[offs[:-1][full]]
    last[offs[1:][full] - 1] = inside[offs[1:][full] - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offs, start, "right") - 1


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """Hash of each byte span (ascending, not overlapping); ``fold`` reads A-Z as a-z.

    Works through the buffer in chunks, so the 8-byte prefix sums stay small;
    a span longer than a chunk gets a chunk of its own length."""
    out = np.empty(len(start), np.uint64)
    table, i = _TABLE_FOLDED if fold else _TABLE, 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + _CHUNK, "right")))
        n = int(end[j - 1] - base)
        up, down = (_POW, _POW_INV) if n <= _CHUNK else (_powers(_B, n), _powers(_B_INV, n))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[buf[base:base + n]] * up[:n], out=sums[1:])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of ordered pairs of hashes."""
    return mix64(left * U(0xD6E8FEB86659FD93) + (right ^ (right >> U(32))) * U(0xA0761D6478BD642F))


def grouped_blocks(docs: DataFrame, n_blocks: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(block, doc_id, text): every row, dealt to ``n_blocks`` by a hash of its id.  A null id has a block too."""
    block = F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_blocks)).cast("int")
    return docs.select(block.alias("block"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def block_count(docs: DataFrame, block_bytes: int, text_col: str = "text") -> int:
    """So many blocks that one holds about ``block_bytes`` of text (one pass that only sums lengths)."""
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return max(1, -(-total // block_bytes))


def crc_remainder(id_col: str, mod: int):
    """crc32 of the id's decimal text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def row_slices(offs: np.ndarray, step: int):
    """(first row, past last row) of consecutive slices of about ``step`` bytes; a longer row is a slice of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + step, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def take_rows(buf: np.ndarray, offs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buffer and offsets of some rows (ascending)."""
    size = offs[rows + 1] - offs[rows]
    new = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(new[-1]) + np.repeat(offs[rows] - new[:-1], size)
    return buf[at], new


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key stands more than once among ``keys`` (uint64)."""
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys
