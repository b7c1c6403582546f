"""Ranked lexical search by presence-mask grouping (operator 13).

Every document is ranked for every item by a sum over the item's terms of an
integer weight (from the term's document frequency) times an integer impact
(from its count in the document and the document's length).

Index.  One pass over the documents counts their terms and writes blocks of
about ``BLOCK_DOCS`` documents of similar length: each document's length, and
for each term that some item holds its documents and counts.  Corpus counts
(documents, terms, document frequencies) come from all blocks.

Search.  In a block each term has a bitmap of its documents and an upper bound,
weight times its greatest impact there.  An item's documents are grouped by
their mask of matched terms by bitmap operations: starting from all documents, a
group is split into those that hold the next term (AND) and the rest (AND NOT),
terms in falling bound.  A group's maximum score is the sum of the bounds of the
terms it holds and of those not yet decided; the group with the greatest maximum
comes next, and one that is down to a single mask, or to ``SMALL`` documents, is
scored exactly.  It is safely finished when that maximum is below the k-th best
score known.  Two rounds share the index: the first takes only the k first
documents of every block, which gives each item a score that k documents reach; the
second runs to the proof, starting from that score, so that most blocks close at
once.  A task keeps k documents an item; a window by item brings the tasks together.

Items come in chunks of about ``ITEM_CHARS`` characters, so the terms that tasks
hold are bounded however many items there are; each chunk passes over all documents.

Defined cases: a null or empty text has no terms: such a document is never ranked and
such an item gets no rows; a document or item that repeats, or has no id, is one of its own
(equal items give their rows once each); equal scores go by ascending id, no id last; terms
that repeat in an item count each time; documents that score 0 are left out, so an item may
get fewer than k rows; an empty table on either side gives none; texts are read whole,
however long; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import pack, unpack, written

#: Fixed values of the score.
B, IMPACT = 75, 1_000_000_000
#: Documents of a block, and blocks whose documents are laid out by length together.
BLOCK_DOCS, LAID_BLOCKS = 4_096, 4
#: Groups of at most so many documents are scored without splitting them further.
SMALL = 16
ITEM_CHARS = 4 << 20

#: Letters of a term stay, A-Z in small; every other ASCII character parts terms.  All bytes of other characters stay.
_TERMS = bytes(b + 32 if 65 <= b < 91 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_TERMS).split() if text else []


# ---------------------------------------------------------------- index

def blocks(docs: DataFrame, id_column: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """One row a block; postings of the vocabulary's terms only, lengths of all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.col("text").cast("binary").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def laid(ids, lengths, at, term, arrow_kind):
        """Blocks of the documents gathered so far, in order of length."""
        lengths = np.array(lengths, np.int64)
        order = np.argsort(lengths, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at, term = place[np.concatenate(at)] if at else np.zeros(0, np.int64), np.concatenate(term) if term else np.zeros(0, np.int64)
        for first in range(0, len(order), BLOCK_DOCS):
            mine = order[first:first + BLOCK_DOCS]
            here = (at >= first) & (at < first + len(mine))
            key, tf = np.unique(term[here] * BLOCK_DOCS + at[here] - first, return_counts=True)
            found, df = np.unique(key // BLOCK_DOCS, return_counts=True)
            n = lengths[mine]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64()),
                 pa.array([[ids[i] for i in mine]], pa.list_(arrow_kind)), pa.array([pack(n)], pa.binary()),
                 pa.array([found], pa.list_(pa.int32())), pa.array([df], pa.list_(pa.int32())),
                 pa.array([pack(key % BLOCK_DOCS)], pa.binary()), pa.array([pack(tf)], pa.binary())],
                ["n_docs", "n_terms", "ids", "lengths", "terms", "dfs", "at", "tfs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        ids, lengths, at, term, arrow_kind = [], [], [], [], None
        for batch in batches:
            arrow_kind = batch.schema.field("id").type
            for doc_id, text in zip(batch.column(batch.schema.get_field_index("id")).to_pylist(),
                                    batch.column(batch.schema.get_field_index("text"))):
                all_terms = terms(text.as_py())
                known = np.array([i for i in map(number, all_terms) if i is not None], np.int64)
                at.append(np.full(len(known), len(ids), np.int64))
                term.append(known)
                ids.append(doc_id)
                lengths.append(len(all_terms))
                if len(ids) == BLOCK_DOCS * LAID_BLOCKS:
                    yield from laid(ids, lengths, at, term, arrow_kind)
                    ids, lengths, at, term = [], [], [], []
        if ids:
            yield from laid(ids, lengths, at, term, arrow_kind)

    return source.mapInArrow(run, f"n_docs long, n_terms long, ids array<{kind}>, lengths binary, terms array<int>, dfs array<int>, "
                                  "at binary, tfs binary")


# ---------------------------------------------------------------- search in a block

class Block:
    """A block's postings by term (bitmaps, bounds) and by document (terms, impacts)."""

    def __init__(self, ids: list, lengths: np.ndarray, found: np.ndarray, dfs: np.ndarray, at: np.ndarray, tfs: np.ndarray,
                 n_docs: int, n_terms: int):
        self.ids, self.size = ids, len(ids)
        m = np.array([100 - B + B * int(x) * n_docs // n_terms for x in lengths], np.int64)
        impact = (IMPACT * tfs) // (1000 * tfs + 8 * m[at])
        self.ends = np.cumsum(dfs)
        self.greatest = np.maximum.reduceat(impact, self.ends - dfs) if len(dfs) else np.zeros(0, np.int64)
        self.dfs, self.at, self._bitmaps = dfs, at, {}
        order = np.argsort(at, kind="stable")
        self.doc_term, self.doc_impact = np.repeat(found, dfs)[order], impact[order]
        self.doc_start = np.searchsorted(at[order], np.arange(self.size + 1))

    def bitmap(self, i: int) -> int:
        if (got := self._bitmaps.get(i)) is None:
            flags = np.zeros(self.size, bool)
            flags[self.at[self.ends[i] - self.dfs[i]:self.ends[i]]] = True
            got = self._bitmaps[i] = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
        return got

    def members(self, bitmap: int) -> list[int]:
        raw = np.frombuffer(bitmap.to_bytes(self.size // 8 + 1, "little"), np.uint8)
        return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()

    def score(self, weights: np.ndarray, doc: int) -> int:
        a, b = self.doc_start[doc], self.doc_start[doc + 1]
        return int(weights[self.doc_term[a:b]] @ self.doc_impact[a:b])


class Best:
    """An item's k best documents so far: (-score, has no id, id), ascending."""

    __slots__ = ("k", "rows")

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def least(self) -> int:
        """The score below which no document can come in any more."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def offer(self, score: int, doc_id) -> None:
        row = (-score, doc_id is None, doc_id)
        if len(self.rows) < self.k or row[:2] < self.rows[-1][:2] or (row[:2] == self.rows[-1][:2] and doc_id is not None and row < self.rows[-1]):
            at = 0
            while at < len(self.rows) and (self.rows[at][:2] < row[:2] or (self.rows[at][:2] == row[:2] and (doc_id is None or self.rows[at][2] <= doc_id))):
                at += 1
            self.rows.insert(at, row)
            del self.rows[self.k:]


def search(block: Block, places: np.ndarray, item_weights: np.ndarray, weights: np.ndarray, best: Best, floor: int, first_only: bool) -> tuple[int, int]:
    """Offers a block's documents to an item's best by falling maximum score of their masks, until that is below what
    k documents reach.  ``places`` are the block's places of the item's terms.  Gives (documents scored, groups made)."""
    bounds = item_weights * block.greatest[places]
    order = np.argsort(-bounds, kind="stable")
    places, bounds = places[order].tolist(), bounds[order].tolist()
    rest = [0] * (len(bounds) + 1)
    for i in range(len(bounds) - 1, -1, -1):
        rest[i] = rest[i + 1] + bounds[i]
    scored = groups = 0
    todo = [(-rest[0], 0, 0, (1 << block.size) - 1, 0)]
    while todo:
        maximum, _, depth, group, held = heapq.heappop(todo)
        if -maximum < max(floor, best.least()) or (first_only and scored >= best.k):
            break
        if depth == len(places) or group.bit_count() <= SMALL:
            for doc in block.members(group):
                if (s := block.score(weights, doc)) > 0 and s >= floor:
                    best.offer(s, block.ids[doc])
                scored += 1
            continue
        having = group & block.bitmap(places[depth])
        groups += 2
        for part, value in ((having, held + bounds[depth]), (group ^ having, held)):
            if part and value + rest[depth + 1] > 0:
                heapq.heappush(todo, (-value - rest[depth + 1], -groups - (part is having), depth + 1, part, value))
    return scored, groups


# ---------------------------------------------------------------- the whole search

def _rounds(index: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], size: int, n_docs: int, n_terms: int, k: int, floors: np.ndarray,
            first_only: bool) -> DataFrame:
    """(item, id, score): the k best documents of every item in each task."""
    sent = index.sparkSession.sparkContext.broadcast((items, floors))
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, floors = sent.value
        best: dict[int, Best] = {}
        weights, where, arrow_kind = np.zeros(size, np.int64), np.full(size, -1, np.int64), None
        for batch in batches:
            arrow_kind = batch.schema.field("ids").type.value_type
            for row in batch.select(["ids", "lengths", "terms", "dfs", "at", "tfs"]).to_pylist():
                found = np.array(row["terms"], np.int64)
                block = Block(row["ids"], unpack(row["lengths"]).astype(np.int64), found, np.array(row["dfs"], np.int64),
                              unpack(row["at"]).astype(np.int64), unpack(row["tfs"]).astype(np.int64), n_docs, n_terms)
                where[found] = np.arange(len(found))
                for i, (mine, w) in enumerate(items):
                    at = where[mine]
                    here = at >= 0
                    if (w[here] * block.greatest[at[here]]).sum() < max(1, floors[i]):
                        continue
                    weights[mine] = w
                    search(block, at[here], w[here], weights, best.setdefault(i, Best(k)), int(floors[i]), first_only)
                    weights[mine] = 0
                where[found] = -1
        rows = [(i, doc, -s) for i, b in best.items() for s, _, doc in b.rows]
        if rows:
            item, ids, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, arrow_kind), pa.array(scores, pa.int64())], ["item", "id", "score"])

    return index.select("ids", "lengths", "terms", "dfs", "at", "tfs").mapInArrow(run, f"item int, id {kind}, score long")


def _best(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _chunk(docs: DataFrame, doc_id: str, items: list, item_schema: str, k: int) -> DataFrame | None:
    """Ranks all documents for the collected items: (item id, copies of the item, text); None if no document has a term."""
    spark = docs.sparkSession
    counted = [(key, copies, Counter(terms(text.encode()) if text else ())) for key, copies, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted({t for *_, c in counted for t in c}))}
    index = written(blocks(docs, doc_id, vocabulary), "ranking-index")
    total = index.agg(F.sum("n_docs").alias("d"), F.sum("n_terms").alias("t")).first()
    n_docs, n_terms = int(total["d"] or 0), int(total["t"] or 0)
    if not n_terms:
        return None
    df = dict(index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("p")).groupBy(F.col("p.terms").alias("t"))
              .agg(F.sum("p.dfs").alias("df")).collect())  # as many rows as the chunk has terms
    weight = {i: int(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1)))) for i, f in df.items()}
    asked = []
    for _, _, counts in counted:
        pairs = sorted((vocabulary[t], c * weight.get(vocabulary[t], 0)) for t, c in counts.items())
        pairs = [p for p in pairs if p[1] > 0]
        asked.append((np.array([t for t, _ in pairs], np.int64), np.array([w for _, w in pairs], np.int64)))
    floors = np.zeros(len(asked), np.int64)
    first = _best(_rounds(index, asked, len(vocabulary), n_docs, n_terms, k, floors, True), k)
    for item, score in first.where(F.col("rank") == k).select("item", "score").collect():
        floors[item] = score
    found = _best(_rounds(index, asked, len(vocabulary), n_docs, n_terms, k, floors, False), k)
    names = spark.createDataFrame([(i, key, copies) for i, (key, copies, _) in enumerate(counted)], item_schema)
    return (found.join(F.broadcast(names), "item")  # as many rows as the chunk has items
            .select("key", F.col("rank").cast("int").alias("rank"), "id", "score", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy"))


def rank(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", k: int = 10) -> DataFrame:
    """(item id, rank, document id, score) of each item's k best documents; both frames have a column ``text``."""
    distinct = items.select(F.col(f"`{item_id}`").alias("key"), "text").groupBy("key", "text").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    key_kind, doc_kind = items.schema[item_id].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString()
    chars = distinct.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = max(1, -(-int(chars) // ITEM_CHARS))
    out = None
    for c in range(chunks if chars else 0):
        rows = distinct.where(F.pmod(F.xxhash64("key", "text"), F.lit(chunks)) == c).where(F.length("text") > 0)
        mine = [(r["key"], r["copies"], r["text"]) for r in rows.collect()]  # about ITEM_CHARS characters
        part = _chunk(docs, doc_id, mine, f"item int, key {key_kind}, copies int", k) if mine else None
        if part is not None:
            out = part if out is None else out.unionAll(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"key {key_kind}, rank int, id {doc_kind}, score long")
    return out.select(F.col("key").alias(item_id), "rank", F.col("id").alias(doc_id), "score")
