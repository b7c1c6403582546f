"""Exact top-k inner products from an impact-ordered, score-at-a-time index (operator 7).

Index.  A block of vectors holds posting segments: one for each dimension and
quantised impact, the bit length l of |x|, with the vectors that have it there
and their signed components.  Components of 0 have no posting.

Search.  A query's component of bit length m meets a segment of impact l with
contributions below 2^(m + l), so its segments are processed by descending m + l,
a score class at a time.  After the classes down to c, a vector's unread postings
come to at most B = sum over dimensions d of |q_d| times the greatest component of the
segments of d with impact up to c - 1 - m_d -- nothing about a vector is known before its postings
are read.  With accumulators a, every score lies in [a - B, a + B]: vectors with
a + B below the k-th best a - B are out.  Processing stops as soon as that proof
leaves at most ``STOP_AT`` x k vectors a query, or all segments are read; the
possible members are rescored exactly from the integers.  Queries of a piece go
through their classes together, each segment as one product of the queries' components of
a bit length with the segment's postings.

Spark deals vectors to blocks by hash, and queries to groups; each pair of
(query group, vector block) is one piece of work that returns k rows a query,
which a window by query, limited to k rows before its shuffle, brings together.  The blocks' bytes are
sent once a query group, in binary rows (16-bit integers where they fit), so no pair of single rows is formed.

Defined cases: vectors that are null or hold a null, NaN or infinite component
take no part; vectors of another length than the query get no score (the inner
product is undefined); equal scores go to the smaller id; a repeated id is a row
of its own, but a query never meets a row with its own id; null ids take no part; fewer
than k others give fewer rows; an empty table gives none.  Scores have to fit a
signed 64-bit integer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STOP_AT = 8
#: Vectors in a block and queries in a group, about; queries of a group that are searched together.
BLOCK_ROWS, GROUP_ROWS, TOGETHER = 8_192, 2_048, 256


def bit_lengths(x: np.ndarray) -> np.ndarray:
    """Bits of |x|: 0 for 0, l where 2^(l - 1) <= |x| < 2^l."""
    size = np.abs(x.astype(np.int64))
    length = np.frexp(size.astype(np.float64))[1]
    # beyond 2^53 the double may have been rounded up to the next power of two
    return length - ((length > 53) & (size < np.left_shift(np.int64(1), np.maximum(length - 1, 0)))).astype(length.dtype)


class Segments:
    """A block's postings by impact: for each bit length that occurs, the components that have it (others 0), and their number."""

    def __init__(self, x: np.ndarray):
        self.x, level = x, bit_lengths(x)
        self.parts = {int(l): np.where(level == l, x, 0) for l in np.unique(level) if l > 0}
        self.postings = {l: int((level == l).sum()) for l in self.parts}
        size = np.abs(x.astype(np.int64))
        #: By impact l and dimension: the greatest component of the segments up to l.
        self.tops = np.array([np.where(level <= l, size, 0).max(axis=0, initial=0) for l in range(int(level.max(initial=0)) + 1)])


def _dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products; floats are used where every partial sum is exact in them."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * q.shape[1]
    kind = np.float32 if bound < 2 ** 24 else np.float64 if bound < 2 ** 53 else np.int64
    return (q.astype(kind) @ x.astype(kind).T).astype(np.int64)


def search(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, index: Segments, k: int):
    """(query position, vector position, score, share of the postings read) of each query's k best in a block."""
    score = np.zeros((len(q_ids), len(ids)), np.int64)
    alive = q_ids[:, None] != ids[None, :]
    levels, size, read, total = bit_lengths(q), np.abs(q), 0, 0
    q_parts = {int(m): np.where(levels == m, q, 0) for m in np.unique(levels) if m > 0}
    q_dims = {m: int((levels == m).any(axis=0).sum()) for m in q_parts}
    segments = sorted(((m + l, m, l) for m in q_parts for l in index.parts), reverse=True)
    classes = sorted({c for c, *_ in segments}, reverse=True)
    total = sum(q_dims[m] * index.postings[l] for _, m, l in segments)
    for c in classes:
        for _, m, l in (s for s in segments if s[0] == c):
            score += _dot(q_parts[m], index.parts[l])
            read += q_dims[m] * index.postings[l]
        # postings not read: of impact at most c - 1 - m in a dimension of bit length m
        unread = np.clip(c - 1 - levels, 0, len(index.tops) - 1)
        bound = (size * index.tops[unread, np.arange(q.shape[1])]).sum(axis=1)
        low = np.where(alive, score - bound[:, None], np.iinfo(np.int64).min)
        if len(ids) > k:
            kth = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k]
            alive &= score + bound[:, None] >= kth[:, None]
        if alive.sum() <= STOP_AT * k * len(q_ids):
            break
    row, at = np.nonzero(alive)
    exact = np.einsum("ij,ij->i", q[row], index.x[at].astype(np.int64))
    order = np.lexsort((ids[at], -exact, row))
    row, at, exact = row[order], at[order], exact[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    keep = nth < k
    return row[keep], at[keep], exact[keep], read / total if total else 0.0


def _packed(id_col: str, vec_col: str, key: str, rows: DataFrame) -> DataFrame:
    """(key, dim, ids, data, small): vectors of a key as two binary columns, one row per Arrow batch and length; components have
    16 bits where they fit."""
    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            ids, vec = batch.column(1).to_numpy(), batch.column(2)
            offs = np.diff(vec.offsets.to_numpy())
            for dim in np.unique(offs):
                pick = np.flatnonzero(offs == dim)
                x = vec.take(pa.array(pick)).flatten().to_numpy().reshape(len(pick), dim)
                for one in np.unique(keys[pick]):
                    of = keys[pick] == one
                    mine = x[of]
                    small = bool(mine.min(initial=0) >= -1 << 15 and mine.max(initial=0) < 1 << 15)
                    yield pa.record_batch([pa.array([one], pa.int32()), pa.array([dim], pa.int32()),
                                           pa.array([ids[pick][of].astype(np.int64).tobytes()], pa.binary()),
                                           pa.array([mine.astype(np.int16 if small else np.int64).tobytes()], pa.binary()), pa.array([small])],
                                          names=[key, "dim", "ids", "data", "small"])

    # Rows of a key come together, so that a batch holds few keys.
    dealt = rows.select(F.col(key).cast("int").alias(key), F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    return dealt.repartition(key).sortWithinPartitions(key).mapInArrow(run, f"{key} int, dim int, ids binary, data binary, small boolean")


def _unpack(frame: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By vector length: (ids, matrix)."""
    out = {}
    for dim, rows in frame.groupby("dim"):
        ids = np.concatenate([np.frombuffer(b, np.int64) for b in rows["ids"]])
        data = [np.frombuffer(b, np.int16 if small else np.int64) for b, small in zip(rows["data"], rows["small"])]
        out[int(dim)] = ids, np.concatenate(data).reshape(len(ids), int(dim))
    return out


def integer_vectors(rows: DataFrame, vec_col: str, scale: float) -> DataFrame:
    """The rows whose vector is whole and finite, the vector as floor(scale * x) in longs."""
    v = F.col(vec_col).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.coalesce(fine, F.lit(False))).withColumn(vec_col, F.transform(v, lambda x: F.floor(x * F.lit(scale))))


def top_k(rows: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors with the highest inner product, for each row where ``is_query``."""
    whole = integer_vectors(rows.where(F.col(id_col).isNotNull()).select(id_col, vec_col, is_query.alias("__query")), vec_col, scale)
    n, n_queries = whole.agg(F.count(F.lit(1)), F.sum(F.col("__query").cast("long"))).first()
    n_blocks, n_groups = -(-max(n, 1) // BLOCK_ROWS), -(-max(n_queries or 0, 1) // GROUP_ROWS)
    h = F.xxhash64(F.col(id_col))
    blocks = _packed(id_col, vec_col, "block", whole.withColumn("block", F.pmod(h, F.lit(n_blocks))))
    groups = _packed(id_col, vec_col, "grp", whole.where("__query").withColumn("grp", F.pmod(F.shiftright(h, 20), F.lit(n_groups))))
    # Every group meets every block: blocks go to the groups as whole binary rows.
    left = blocks.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).groupBy("block", "grp")
    right = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).groupBy("block", "grp")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out, vectors = [], _unpack(a)
        for dim, (q_ids, q) in _unpack(b).items():
            if dim in vectors:
                ids, x = vectors[dim]
                index = Segments(x)
                q = q.astype(np.int64)
                for i in range(0, len(q_ids), TOGETHER):
                    row, at, score, _ = search(q_ids[i:i + TOGETHER], q[i:i + TOGETHER], ids, index, k)
                    # The query's position tells repeated query ids apart.
                    out.append(pd.DataFrame({"query_id": q_ids[i:i + TOGETHER][row], "copy": (i + row).astype(np.int64),
                                             "dim": dim, "vec_id": ids[at], "score": score}))
        names = {"query_id": "int64", "copy": "int64", "dim": "int64", "vec_id": "int64", "score": "int64"}
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype=t) for c, t in names.items()})

    found = left.cogroup(right).applyInPandas(meet, "query_id long, copy long, dim long, vec_id long, score long")
    w = Window.partitionBy("query_id", "copy", "dim").orderBy(F.desc("score"), "vec_id")
    # k rows a query and block come together here, not the vectors; a task passes on k rows a query.
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
