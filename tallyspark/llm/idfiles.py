"""Token ids in checksummed, context-mixed, range-coded files (operator 2).

Model.  Three predictions of the next id are mixed, ``P = m2 [id = p2] + m1 [id = p1] + m0 P0(id)``:

* order 2 and order 1 predict the id that last followed the two ids, or the one id, before;
* order 0 counts ids in ``GROUPS`` groups (id modulo GROUPS); within a group the id seen last
  there has a learned share, the others a fixed one that falls with the id.

The masses are learned while coding: each order keeps, by the confidence of its
prediction, the running share of predictions that came true.  The mixture
drives a 48-bit range coder with 16-bit output words.

File.  ``MAGIC``, then the document index (ids, lengths), then blocks of ``BLOCK_IDS`` ids.  A
block starts from an empty model and carries its length and the crc32 of its
ids and of its bytes, the index its own crc32: any block can be read, and checked, alone.  Because
blocks are independent, coder and decoder step through all blocks of a file side
by side, one id of each at a time, so a step is a few numpy operations on a vector.

Spark range-partitions the documents by id, so files follow one another in
ascending order of doc_id; a task holds one file, of about ``FILE_BYTES`` of text.
The files are rows (file, data) of a table in the shared folder.

Encoding is the tokenizers library's.  A text is cut only before a single space between two
non-space characters, where the byte-level pattern always starts a new word, and a
piece that came before in the batch is not encoded twice.

Defined cases: a null text is empty, its document holds the end id alone; null
ids come first; rows with one id keep their own entries, in any order; an empty
table gives no file and no rows; other columns are ignored.  Ids are at most 2**16 - 1.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import read_spec
from .shared import written

MAGIC, END = b"TIDS\x01", 0
BLOCK_IDS, GROUPS, FILE_BYTES = 1024, 1024, 8 << 20
#: Entries of the order-1 and order-2 tables of a block, steps between sums of the order-0 counts, and its count step.
ENTRIES, RENEW, COUNT_STEP = 512, 64, 32
REMEMBERED_PIECES = 900_000
_TOP, _LEAST = np.uint64(1 << 48), np.uint64(1 << 32)
_ONE = 1 << 16
#: Learned shares move between these two, of 2**16, so that no outcome has a share of 0.
_FLOOR, _RANGE = 64, 60_000 - 64


def _fixed_shares(members: int) -> np.ndarray:
    """Cumulative shares, of 2**16, of a group's members: they fall as 1 / (rank + 1/2), none is below 64."""
    p = 1 / (np.arange(members) + 0.5)
    f = np.maximum(64, (p / p.sum() * (_ONE - 64 * members)).astype(np.int64) + 64)
    f[0] += _ONE - f.sum()
    return np.concatenate(([0], np.cumsum(f))).astype(np.int64)


class _Model:
    """State of the blocks that are coded side by side."""

    def __init__(self, blocks: int, vocabulary: int):
        self.n = blocks
        self.shares = _fixed_shares(-(-vocabulary // GROUPS))
        self.seen2 = np.zeros(blocks * ENTRIES, np.int64)
        self.seen1 = np.zeros(blocks * ENTRIES, np.int64)
        self.right2 = np.full(blocks * 4, _ONE // 4, np.int64)
        self.right1 = np.full(blocks * 4, _ONE // 8, np.int64)
        self.right0 = np.full(blocks, _ONE // 2, np.int64)
        self.counts = np.ones(blocks * GROUPS, np.int32)
        self.last = np.zeros(blocks * GROUPS, np.int64)
        self.sums = np.zeros(blocks * (GROUPS + 1), np.int32)
        self.lane = np.arange(blocks)
        self.of_entry, self.of_share = self.lane * ENTRIES, self.lane * 4
        self.of_group, self.of_sum = self.lane * GROUPS, self.lane * (GROUPS + 1)
        self.one, self.two = np.zeros(blocks, np.int64), np.zeros(blocks, np.int64)

    def renew(self, a: int) -> None:
        np.cumsum(self.counts.reshape(-1, GROUPS)[:a], axis=1, out=self.sums.reshape(-1, GROUPS + 1)[:a, 1:])

    def predict(self, a: int):
        """(predicted id + 1 and mass) of order 2 and order 1 for the first ``a`` blocks."""
        h = self.one[:a] * 40503
        self.at1 = self.of_entry[:a] + (h >> 4 & ENTRIES - 1)
        self.at2 = self.of_entry[:a] + (self.two[:a] * 30011 + h >> 3 & ENTRIES - 1)
        self.e2, self.e1 = self.seen2[self.at2], self.seen1[self.at1]
        self.k2, self.k1 = self.of_share[:a] + (self.e2 & 3), self.of_share[:a] + (self.e1 & 3)
        p2, p1 = self.e2 >> 2, self.e1 >> 2
        m2 = self.right2[self.k2] * (p2 > 0)
        m1 = (self.right1[self.k1] * (_ONE - m2) >> 16) * ((p1 > 0) & (p1 != p2))
        return p2, p1, m2, m1

    def learn(self, a: int, x: np.ndarray, p2, p1, rest: np.ndarray) -> None:
        """Takes in the ids ``x``; ``rest`` are the blocks where orders 2 and 1 failed."""
        ids = x + 1
        for seen, at, e, p, right, k in ((self.seen2, self.at2, self.e2, p2, self.right2, self.k2),
                                         (self.seen1, self.at1, self.e1, p1, self.right1, self.k1)):
            hit, c = p == ids, e & 3
            was = right[k]
            right[k] = was + ((hit * _RANGE + _FLOOR - was) * (p > 0) >> 5)
            seen[at] = np.where(hit, e + (c < 3), np.where(c > 0, e - 1, ids << 2))
        of = x[rest]
        at = self.of_group[rest] + (of & GROUPS - 1)
        self.counts[at] += COUNT_STEP
        self.last[at] = (of >> 10) + 1
        self.two[:a] = self.one[:a]
        self.one[:a] = ids


def encode_blocks(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """Coded bytes of each block, all coded side by side."""
    order = np.argsort([-len(b) for b in blocks], kind="stable")
    size = np.array([len(blocks[i]) for i in order])
    m, n = _Model(len(blocks), vocabulary), int(size[0])
    ids = np.zeros((n, len(blocks)), np.int64)
    for k, i in enumerate(order):
        ids[:size[k], k] = blocks[i]
    low, rng = np.zeros(len(blocks), np.uint64), np.full(len(blocks), _TOP)
    out, used = np.zeros((len(blocks), 4 * n + 8), np.uint16), np.zeros(len(blocks), np.int64)

    def put(lanes):
        word = low[lanes] >> np.uint64(32)
        carry = lanes[word > 0xFFFF]
        at = used[carry] - 1
        while len(carry):  # a carry runs back over words that are full
            out[carry, at] += np.uint16(1)
            full = out[carry, at] == 0
            carry, at = carry[full], at[full] - 1
        out[lanes, used[lanes]] = word & np.uint64(0xFFFF)
        used[lanes] += 1
        low[lanes] = (low[lanes] & np.uint64(0xFFFFFFFF)) << np.uint64(16)
        rng[lanes] <<= np.uint64(16)

    def fill(lanes):
        while True:
            lanes = lanes[rng[lanes] < _LEAST]
            if not len(lanes):
                break
            put(lanes)

    u64 = np.uint64
    active = np.searchsorted(-size, -np.arange(1, n + 1), "right")
    for t in range(n):
        a = int(active[t])
        if t % RENEW == 0:
            m.renew(a)
        x = ids[t, :a]
        p2, p1, m2, m1 = m.predict(a)
        hit2 = p2 == x + 1
        hit1 = (p1 == x + 1) & ~hit2
        rest = np.flatnonzero(~(hit2 | hit1))
        start = np.where(hit2, 0, np.where(hit1, m2, m2 + m1))
        freq = np.where(hit2, m2, np.where(hit1, m1, _ONE - m2 - m1))
        r = rng[:a] >> u64(16)
        low[:a] += r * start.astype(u64)
        rng[:a] = r * freq.astype(u64)
        if len(rest):
            of = x[rest]
            g, j = of & GROUPS - 1, of >> 10
            at = m.of_sum[rest] + g
            begin = m.sums[at]
            f, total = m.sums[at + 1] - begin, m.sums[m.of_sum[rest] + GROUPS]
            r = rng[rest] // total.astype(u64)
            low[rest] += r * begin.astype(u64)
            rng[rest] = r * f.astype(u64)
            fill(rest)
            before, share = m.last[m.of_group[rest] + g], m.right0[rest]
            mass = share * (before > 0)
            hit = before == j + 1
            lo, hi = (mass + ((_ONE - mass) * m.shares[j + d] >> 16) for d in (0, 1))
            start, freq = np.where(hit, 0, lo), np.where(hit, mass, hi - lo)
            r = rng[rest] >> u64(16)
            low[rest] += r * start.astype(u64)
            rng[rest] = r * freq.astype(u64)
            m.right0[rest] = share + ((hit * _RANGE + _FLOOR - share) * (before > 0) >> 5)
        fill(m.lane[:a])
        m.learn(a, x, p2, p1, rest)
    for _ in range(3):
        put(m.lane)
    done = [b""] * len(blocks)
    for k, i in enumerate(order):
        done[i] = out[k, :used[k]].astype("<u2").tobytes()
    return done


def decode_blocks(coded: list[bytes], lengths: list[int], vocabulary: int) -> list[np.ndarray]:
    """Ids of each block, all decoded side by side."""
    order = np.argsort([-x for x in lengths], kind="stable")
    size = np.array([lengths[i] for i in order])
    m, n, blocks = _Model(len(coded), vocabulary), int(size[0]), len(coded)
    words = np.zeros((blocks, max(map(len, coded)) // 2 + 8), np.uint64)
    for k, i in enumerate(order):
        w = np.frombuffer(coded[i], "<u2")
        words[k, :len(w)] = w
    used = np.full(blocks, 3)
    code = words[:, 0] << np.uint64(32) | words[:, 1] << np.uint64(16) | words[:, 2]
    rng = np.full(blocks, _TOP)
    ids = np.zeros((n, blocks), np.int64)

    def fill(lanes):
        while True:
            lanes = lanes[rng[lanes] < _LEAST]
            if not len(lanes):
                break
            code[lanes] = code[lanes] << np.uint64(16) | words[lanes, used[lanes]]
            used[lanes] += 1
            rng[lanes] <<= np.uint64(16)

    u64 = np.uint64
    active = np.searchsorted(-size, -np.arange(1, n + 1), "right")
    for t in range(n):
        a = int(active[t])
        if t % RENEW == 0:
            m.renew(a)
        p2, p1, m2, m1 = m.predict(a)
        r = rng[:a] >> u64(16)
        v = np.minimum(code[:a] // r, u64(_ONE - 1)).astype(np.int64)
        hit2 = v < m2
        hit1 = (v < m2 + m1) & ~hit2
        start = np.where(hit2, 0, np.where(hit1, m2, m2 + m1))
        freq = np.where(hit2, m2, np.where(hit1, m1, _ONE - m2 - m1))
        code[:a] -= r * start.astype(u64)
        rng[:a] = r * freq.astype(u64)
        x = np.where(hit2, p2, p1) - 1
        rest = np.flatnonzero(~(hit2 | hit1))
        if len(rest):
            first = m.of_sum[rest]
            total = m.sums[first + GROUPS]
            r = rng[rest] // total.astype(u64)
            v = np.minimum((code[rest] // r).astype(np.int32), total - 1)
            at, step = first.copy(), GROUPS >> 1
            while step:  # the last group whose sum of those before is at most v
                at += (m.sums[at + step] <= v) * step
                step >>= 1
            g, begin = at - first, m.sums[at]
            code[rest] -= r * begin.astype(u64)
            rng[rest] = r * (m.sums[at + 1] - begin).astype(u64)
            fill(rest)
            before, share = m.last[m.of_group[rest] + g], m.right0[rest]
            mass = share * (before > 0)
            r = rng[rest] >> u64(16)
            v = np.minimum(code[rest] // r, u64(_ONE - 1)).astype(np.int64)
            hit = v < mass
            left = _ONE - mass
            j = np.searchsorted(m.shares, (((v - mass + 1) << 16) - 1) // left, "right") - 1
            j = np.where(hit, before - 1, j)
            lo, hi = (mass + (left * m.shares[j + d] >> 16) for d in (0, 1))
            start, freq = np.where(hit, 0, lo), np.where(hit, mass, hi - lo)
            code[rest] -= r * start.astype(u64)
            rng[rest] = r * freq.astype(u64)
            m.right0[rest] = share + ((hit * _RANGE + _FLOOR - share) * (before > 0) >> 5)
            x[rest] = j * GROUPS + g
        fill(m.lane[:a])
        ids[t, :a] = x
        m.learn(a, x, p2, p1, rest)
    done: list = [None] * blocks
    for k, i in enumerate(order):
        done[i] = ids[:size[k], k].astype(np.uint16)
    return done


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


# ---- ids of texts -------------------------------------------------------------------------------------------------

#: White space beside a space: there a cut could part a run that the pattern reads as one.
_RUN = re.compile(r" \s|\s ")


class Pieces:
    """The tokenizers library's ids of texts, with the pieces that came before remembered."""

    def __init__(self, spec: str):
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocabulary = self.tokenizer.get_vocab_size()
        if self.vocabulary > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.spaced: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint16).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 16-bit numbers."""
        parts = [[t] if _RUN.search(t) else t.split(" ") for t in texts]
        if len(self.spaced) + len(self.plain) > REMEMBERED_PIECES:
            self.spaced.clear()
            self.plain.clear()
        for known, lead, used in ((self.plain, "", {p[0] for p in parts}), (self.spaced, " ", {x for p in parts for x in p[1:]})):
            new = list(used.difference(known))
            known.update(zip(new, self._ids([lead + x for x in new])))
        out = []
        for p in parts:
            out.append(self.plain[p[0]] + b"".join(map(self.spaced.__getitem__, p[1:])))
        return out


@lru_cache(maxsize=1)
def pieces(spec: str) -> Pieces:
    return Pieces(spec)


# ---- files --------------------------------------------------------------------------------------------------------

_HEAD, _BLOCK = struct.Struct("<IQIII"), struct.Struct("<IIII")


def file_image(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, vocabulary: int) -> bytes:
    """A file: documents by id (signed 64 bits) and length, and all their ids."""
    index = doc_ids.astype("<i8").tobytes() + lengths.astype("<u4").tobytes()
    packed = zlib.compress(index, 1)
    out = [MAGIC, _HEAD.pack(len(doc_ids), len(ids), vocabulary, len(packed), zlib.crc32(index)), packed]
    blocks = [ids[i:i + BLOCK_IDS] for i in range(0, len(ids), BLOCK_IDS)]
    for block, coded in zip(blocks, encode_blocks(blocks, vocabulary) if blocks else []):
        out += [_BLOCK.pack(len(block), _crc(block), zlib.crc32(coded), len(coded)), coded]
    return b"".join(out)


def read_image(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, lengths, ids) of a file; a wrong checksum is an error that names the block."""
    if data[:len(MAGIC)] != MAGIC:
        raise ValueError("not a file of token ids")
    n_docs, n_ids, vocabulary, size, crc = _HEAD.unpack_from(data, len(MAGIC))
    at = len(MAGIC) + _HEAD.size
    index = zlib.decompress(data[at:at + size])
    if zlib.crc32(index) != crc:
        raise ValueError("the document index is damaged")
    at, coded, lengths, crcs = at + size, [], [], []
    while at < len(data):
        n, crc, coded_crc, size = _BLOCK.unpack_from(data, at)
        at += _BLOCK.size
        coded.append(data[at:at + size])
        if zlib.crc32(coded[-1]) != coded_crc:
            raise ValueError(f"block {len(coded) - 1} is damaged")
        lengths.append(n)
        crcs.append(crc)
        at += size
    ids = decode_blocks(coded, lengths, vocabulary) if coded else []
    for i, (block, crc) in enumerate(zip(ids, crcs)):
        if _crc(block) != crc:
            raise ValueError(f"block {i} is damaged")
    return (np.frombuffer(index, "<i8", n_docs), np.frombuffer(index, "<u4", n_docs, n_docs * 8),
            np.concatenate(ids) if ids else np.zeros(0, np.uint16))


def write_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                file_bytes: int = FILE_BYTES) -> DataFrame:
    """The written files: (file, n_ids, null_docs, data), ``file`` ascending with doc_id."""
    spec = read_spec(path)
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    n_files = max(1, -(-total // file_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(n_files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())

    def run(batches):
        import os

        from pyspark import TaskContext
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        p, doc_ids, parts, nulls = pieces(spec), [], [], 0
        end = np.array([END], np.uint16).tobytes()
        for batch in batches:
            nulls += batch.column(0).null_count
            doc_ids.append(batch.column(0).fill_null(0).to_numpy())
            texts = batch.column(1).to_pylist()
            for i in range(0, len(texts), 1000):
                parts += [x + end for x in p.encode([t or "" for t in texts[i:i + 1000]])]
        if parts:
            lengths, ids = np.array([len(x) // 2 for x in parts]), np.frombuffer(b"".join(parts), np.uint16)
            del parts
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([len(ids)], pa.int64()),
                                   pa.array([nulls], pa.int64()),
                                   pa.array([file_image(np.concatenate(doc_ids), lengths, ids, p.vocabulary)], pa.binary())],
                                  names=["file", "n_ids", "null_docs", "data"])

    return written(rows.mapInArrow(run, "file int, n_ids long, null_docs long, data binary"), "id-files")


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in the files."""
    def run(batches):
        for batch in batches:
            for file, nulls, data in zip(*(batch.column(c).to_pylist() for c in range(3))):
                doc_ids, lengths, ids = read_image(data)
                stop = np.cumsum(lengths.astype(np.int64))
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[b - n:b]) for b, n in zip(stop.tolist(), lengths.tolist())]
                yield pa.record_batch([pa.array([file] * len(stop), pa.int32()),
                                       pa.array(doc_ids, pa.int64(), mask=np.arange(len(stop)) < nulls),
                                       pa.array(stop - lengths), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                                      names=["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = files.select("file", "null_docs", "data").mapInArrow(run, "file int, doc_id long, at long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    first = files.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))
    return found.join(first, "file").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
