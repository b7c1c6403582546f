"""Near-duplicate documents by ProbMinHash (operator 10).

A text is a weighted set: its five-word shingles with their counts.  ProbMinHash
lets every shingle start a Poisson process whose rate is its weight; each
arrival falls into one of ``m`` slots, and a slot keeps the shingle of its
earliest arrival.  Two texts agree in a slot with probability equal to their
probability Jaccard

    J_P = sum over common k of 1 / sum_j max(a_j / a_k, b_j / b_k)

(the plain Jaccard where all counts are 1).  A shingle stops as soon as its next
arrival is later than the latest slot of its text, so most shingles need one or
two draws.  A second signature takes every count as 1, so its slots agree with
probability equal to the plain Jaccard; where no shingle repeats both are one.
``BANDS`` bands of ``ROWS`` slots of either signature give candidate buckets; a pair at
0.8 by either measure shares none with probability below 1e-5.

Only distinct texts take part (copies share the 128-bit digest of the whole text).  In a
bucket not all pairs are formed: every member is verified against one pivot,
the member whose buckets are fullest, usually the common original.  Members of
buckets that still hold several classes then leave a bucket where they cannot have a
partner.  Of the n shingles of a text let s stand in any other such text, and let u be the share of its counts (w in all) that stands
nowhere else.  Two texts share at most min(s, s') shingles, so their plain Jaccard reaches t only if n + n' <= min(s, s')
(1 + t) / t.  The share of the counts outside the other text is a >= max(u, (n - s') / w), and a' likewise; the probability
Jaccard is at most (1 - a) (1 - a') / (1 - a a'), as its terms are at most p q / (q + a' p), a concave function that adds up over the
common shingles.  Both are tested against the extremes of the bucket, ``CLOSING`` times as texts that left no longer count, and then
for each pair.  For a pair, s is also bounded by the two texts themselves: shingles fall into ``BINS`` hash bins, and in each bin two texts
share at most the lesser of their numbers of shingles there.  The pairs between
different classes that pass and were not tested yet are verified too.  So a
link can be skipped only where both ends are in one class already, or where it
is proved not to exist.  Before texts are compared a pair passes a check of its whole signatures: the larger of the two agreements
is at most five standard errors below the threshold.  Verification is exact: a pair is linked if its probability Jaccard
or the plain Jaccard of its shingle sets reaches the threshold.

Classes are the connected components of the links.  Result: doc_id, class_id
(smallest doc_id of the class), class_size.

Defined cases: null text counts as empty; a text of one to four words is one
shingle of them all; texts without a word are linked only to equal texts;
repeated rows are members of one class; null ids are members, a class of only
null ids has a null class_id; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import numbered, written
from .textblocks import U, mix64, pair_hash, row_slices, span_hashes, text_buffer, word_spans

SHINGLE_WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch of texts or pairs.
BATCH_ROWS = 1000
#: Times that texts without a possible partner are taken out of buckets before pairs are formed.
CLOSING = 2
#: Hash bins by which the shingles common to two texts are bounded before the pair is formed (a power of two), and the number of
#: shingles up to which a bin counts them.
BINS, PLANES = 512, 2


def shingles(buf: np.ndarray, offs: np.ndarray, words: int = SHINGLE_WORDS):
    """(row, hash, count) of the distinct shingles of each row, rows ascending."""
    start, end, row = word_spans(buf, offs)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, U), z
    h = span_hashes(buf, start, end)
    n, size = len(offs) - 1, np.bincount(row, minlength=len(offs) - 1)
    first = np.concatenate(([0], np.cumsum(size)))[:-1]
    rows, keys, run = [], [], h.copy()
    for k in range(1, words + 1):
        if k > 1:  # run[i] covers the words i .. i + k - 1
            run = pair_hash(run[:len(h) - k + 1], h[k - 1:]) if len(h) >= k else run[:0]
        if k < words:  # short texts: one shingle of all words
            short = np.flatnonzero(size == k)
            rows.append(short)
            keys.append(run[first[short]])
        elif len(run):
            at = np.flatnonzero(row[:len(run)] == row[words - 1:])
            rows.append(row[at])
            keys.append(run[at])
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    _, pos, count = np.unique(pair_hash(rows.astype(U), keys), return_index=True, return_counts=True)
    order = np.argsort(rows[pos], kind="stable")
    return rows[pos][order], keys[pos][order], count[order]


def signatures(row: np.ndarray, key: np.ndarray, weight: np.ndarray, n_rows: int, m: int = BANDS * ROWS) -> np.ndarray:
    """Slot by slot the shingle of the earliest arrival: (n_rows, m) hashes; rows without shingles are 0."""
    best = np.full(n_rows * m, np.inf)
    owner = np.zeros(n_rows * m, U)
    time, at, elem, w = np.zeros(len(row)), row.astype(np.int64), key, weight.astype(np.float64)
    turn = 0
    while len(at):
        u = mix64(elem + U((0x632BE59BD9B4E019 * (turn + 1)) & (2 ** 64 - 1)))
        time = time - np.log(((u >> U(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / w
        slot = at * m + ((mix64(u) >> U(33)) % U(m)).astype(np.int64)
        early = time < best[slot]
        np.minimum.at(best, slot[early], time[early])
        won = early & (time == best[slot])
        owner[slot[won]] = elem[won]
        latest = best.reshape(n_rows, m).max(1)
        on = time < latest[at]
        time, at, elem, w, turn = time[on], at[on], elem[on], w[on], turn + 1
    return owner.reshape(n_rows, m)


def plain_signatures(row: np.ndarray, key: np.ndarray, weight: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """The signatures where every count is 1, given those of the counts: rows without a repeated shingle keep theirs."""
    again = np.zeros(len(sig), bool)
    again[row[weight > 1]] = True
    on = again[row]
    plain = sig.copy()
    plain[again] = signatures((np.cumsum(again) - 1)[row[on]], key[on], np.ones(int(on.sum())), int(again.sum()), sig.shape[1])
    return plain


def similarity(a, b, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(probability Jaccard, plain Jaccard) by row of two weighted sets (row, key, count)."""
    ka, kb = pair_hash(a[0].astype(U), a[1]), pair_hash(b[0].astype(U), b[1])
    keys, which = np.unique(np.concatenate((ka, kb)), return_inverse=True)
    x, y, row = np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(len(keys), np.int64)
    x[which[:len(ka)]], y[which[len(ka):]] = a[2], b[2]
    row[which] = np.concatenate((a[0], b[0]))
    both = (x > 0) & (y > 0)
    plain = np.bincount(row[both], minlength=n_rows) / np.maximum(np.bincount(row, minlength=n_rows), 1)
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.lexsort((ratio, row))
    x, y, row, ratio, both = x[order], y[order], row[order], ratio[order], both[order]
    # Sums within a row: of a where the ratio is at least k's, of b where it is less.
    begin = np.searchsorted(row, np.arange(n_rows + 1))
    cx, cy = np.concatenate(([0], np.cumsum(x))), np.concatenate(([0], np.cumsum(y)))
    group = np.ones(len(row), bool)
    group[1:] = (row[1:] != row[:-1]) | (ratio[1:] != ratio[:-1])
    low = np.maximum.accumulate(np.where(group, np.arange(len(row)), 0)) if len(row) else np.zeros(0, np.int64)
    k = np.flatnonzero(both)
    r = row[k]
    total = (cx[begin[r + 1]] - cx[low[k]]) / x[k] + (cy[low[k]] - cy[begin[r]]) / y[k]
    return np.bincount(r, 1 / total, n_rows), plain


def _digest(text):
    return F.unhex(F.md5(text.cast("binary")))


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, node, bands array<long>, sketch binary): the digest of the text, the distinct band hashes and one byte a slot,
    of the signature by counts and of the plain one.

    Both signatures have the same salts: a text without repeats has the same bands in both, and meets the plain ones of others."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), _digest(text).alias("node"), text.alias("text"))

    def run(batches):
        salt = mix64(np.arange(BANDS, dtype=U))
        for batch in batches:
            buf, offs = text_buffer(batch.column(2))
            for i, j in row_slices(offs, SLICE_BYTES):
                row, key, count = shingles(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                sig = signatures(row, key, count, j - i)
                both = np.concatenate((sig, plain_signatures(row, key, count, sig)), axis=1)
                parts = both.reshape(j - i, 2 * BANDS, ROWS)
                band = np.broadcast_to(np.concatenate((salt, salt)), (j - i, 2 * BANDS))
                for k in range(ROWS):
                    band = pair_hash(band, parts[:, :, k])
                solid = np.bincount(row, minlength=j - i) > 0
                bands = pa.array([np.unique(b) if s else None for b, s in zip(band.view(np.int64), solid)], pa.list_(pa.int64()))
                sketch = (both >> U(40)).astype(np.uint8)
                yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), bands,
                                       pa.array([s.tobytes() for s in sketch], pa.binary())],
                                      names=["doc_id", "node", "bands", "sketch"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, node binary, bands array<long>, sketch binary")


def _texts(used: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of the nodes in ``used``, once each: the text of the node's smallest id, or of a row without id if none is known."""
    where = used.join(nodes.select("node", F.col("first_id").alias("__first")), "node").withColumnRenamed("node", "__node")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__id"), _digest(text).alias("node"), text.alias("text"))
    rows = rows.join(where, (F.col("node") == F.col("__node")) & F.col("__id").eqNullSafe(F.col("__first")))
    return rows.groupBy("node").agg(F.first("text").alias("text"))  # rows may repeat


def bin_planes(row: np.ndarray, key: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's distinct shingles by hash bin: bit planes (n_rows, PLANES * BINS / 64), where plane k marks the bins that hold
    more than k of them, and how many are beyond the planes."""
    planes, rest = np.zeros((n_rows, PLANES * BINS // 64), np.int64), np.zeros(n_rows, np.int64)
    at = (key & U(BINS - 1)).astype(np.int64)
    for i in range(0, n_rows, 2000):
        j = min(i + 2000, n_rows)
        a, b = np.searchsorted(row, (i, j))
        count = np.bincount((row[a:b] - i) * BINS + at[a:b], minlength=(j - i) * BINS).reshape(-1, BINS)
        planes[i:j] = np.concatenate([np.packbits(count > k, axis=1, bitorder="little") for k in range(PLANES)], axis=1).view(np.int64)
        rest[i:j] = np.maximum(count - PLANES, 0).sum(axis=1)
    return planes, rest


def _grams(open_rows: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, keys, counts, n, w, bins, rest) of the open texts: the distinct shingles and their counts, totals, and ``bin_planes``."""
    texts = _texts(open_rows.select("node").distinct(), nodes, docs, id_col, text_col)

    def count(batches):
        for batch in batches:
            buf, offs = text_buffer(batch.column(1))
            for i, j in row_slices(offs, SLICE_BYTES):
                row, key, weight = shingles(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                n, w = np.bincount(row, minlength=j - i), np.bincount(row, weight, j - i).astype(np.int64)
                at = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
                planes, rest = bin_planes(row, key, j - i)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(at, pa.array(key.view(np.int64))),
                                       pa.ListArray.from_arrays(at, pa.array(weight.astype(np.int64))), pa.array(n.astype(np.int64)), pa.array(w),
                                       pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * planes.shape[1]), pa.array(planes.ravel())),
                                       pa.array(rest)], names=["node", "keys", "counts", "n", "w", "bins", "rest"])

    return texts.mapInArrow(count, "node binary, keys array<long>, counts array<long>, n long, w long, bins array<long>, rest long")


#: What ``_may_meet`` needs of a text: shingles, those that others have, counts, share of the counts that stands alone, and
#: whether a shingle repeats (else both measures are one); and of a bucket, the extremes that bound all its texts.
_REACH = {"n": F.min, "s": F.max, "w": F.max, "u": F.min, "again": F.max}


def _each(grams: DataFrame) -> DataFrame:
    """(node, key, w, n, w_all): a row for each distinct shingle of a text."""
    rows = grams.select("node", "n", F.col("w").alias("w_all"), F.explode(F.arrays_zip("keys", "counts")).alias("k"))
    return rows.select("node", F.col("k.keys").alias("key"), F.col("k.counts").alias("w"), "n", "w_all")


def _reach(grams: DataFrame) -> DataFrame:
    """(node, n, s, w, u, again) of the open texts."""
    alone = (grams.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node"), F.min("w").alias("w")).where("c = 1")
             .groupBy("node").agg(F.count(F.lit(1)).alias("alone_n"), F.sum("w").alias("alone_w")))
    rows = grams.groupBy("node").agg(F.first("n").alias("n"), F.first("w_all").alias("w")).join(alone, "node", "left")
    return rows.select("node", "n", (F.col("n") - F.coalesce("alone_n", F.lit(0))).alias("s"), "w",
                       (F.coalesce("alone_w", F.lit(0)) / F.col("w")).alias("u"), (F.col("w") > F.col("n")).alias("again"))


def _may_meet(x: dict, y: dict, threshold: float):
    """Whether two texts (or a text and any of a bucket, given its extremes) can reach the threshold by either measure."""
    plain = x["n"] + y["n"] <= F.least(x["s"], y["s"]) * F.lit((1 + threshold) / threshold * (1 + 1e-9))
    a, b = (F.greatest(p["u"], (p["n"] - q["s"]) / p["w"]) for p, q in ((x, y), (y, x)))
    counts = (1 - a) * (1 - b) >= (1 - a * b) * F.lit(threshold - 1e-9)
    return plain | ((x["again"] | y["again"]) & counts)


def _share_enough(x: dict, y: dict, threshold: float, x_bins, y_bins):
    """Whether the most shingles that two texts can share, by ``bin_planes``, leave the threshold in reach.

    In each hash bin they share at most the lesser of their numbers there.  The plain Jaccard asks for (n + n') t / (1 + t) common
    shingles; the probability Jaccard is at most the share of a text's counts on the common ones, of which the others take 1 each."""
    planes = [F.bit_count(x_bins[i].bitwiseAND(y_bins[i])) for i in range(PLANES * BINS // 64)]
    most = sum(planes, F.least(x["rest"], y["rest"]))
    plain = (x["n"] + y["n"]) * F.lit(threshold / (1 + threshold))
    counts = F.greatest(*[p["n"] - p["w"] * F.lit(1 - threshold) for p in (x, y)])
    return most >= F.when(x["again"] | y["again"], F.least(plain, counts)).otherwise(plain) - F.lit(1e-6)


def _links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts reach the threshold."""
    m = BANDS * ROWS
    least = threshold - 5 * (threshold * (1 - threshold) / m) ** 0.5

    def agree(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 2, m) for c in (2, 3))
                near = pa.array((x == y).mean(2).max(1) >= least)
                yield batch.select([0, 1]).filter(near)

    s = nodes.select("node", "sketch")
    near = (pairs.join(s.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
            .join(s.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b").select("a", "b", "sa", "sb")
            .mapInArrow(agree, "a binary, b binary"))
    near = written(near, "near-pairs", BATCH_ROWS)
    texts = _texts(near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct(),
                   nodes, docs, id_col, text_col)

    def verify(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                a, b = (shingles(*text_buffer(part.column(c))) for c in (2, 3))
                weighted, plain = similarity(a, b, part.num_rows)
                yield part.select([0, 1]).filter(pa.array(np.maximum(weighted, plain) >= threshold - 1e-9))

    both = (near.join(texts.withColumnsRenamed({"node": "a", "text": "ta"}), "a")
            .join(texts.withColumnsRenamed({"node": "b", "text": "tb"}), "b").select("a", "b", "ta", "tb"))
    return written(both.mapInArrow(verify, "a binary, b binary").distinct(), "links", BATCH_ROWS)


def components(links: DataFrame) -> DataFrame:
    """(node, label) of the nodes that have links (a, b): the smallest node that links lead to.

    Each round every node follows its smallest neighbour, and that one's, and the links
    are drawn anew between the nodes arrived at, until no link is left.  Nodes are digests, so their order is
    random along any chain: a fixed share of the nodes goes each round, and rounds are few."""
    steps = []
    edges = links.where("a <> b").select("a", "b")
    while True:
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        low = low.select("node", F.least("node", "to").alias("to"))
        step = low.join(low.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to"))
        step = written(step, "step")
        steps.append(step)
        for end in ("a", "b"):
            edges = edges.join(step.withColumnsRenamed({"node": end, "to": f"n{end}"}), end).drop(end)
        edges = written(edges.where("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            break
    label = steps[0]
    for step in steps[1:]:
        label = (label.join(step.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left")
                 .select("node", F.coalesce("next", "to").alias("to")))
    return written(label.withColumnRenamed("to", "label"), "labels")


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    return rows.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _several(labelled: DataFrame, more: list[str] = []) -> DataFrame:
    """The rows of the buckets that hold more than one class."""
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    return labelled.join(mixed.select("bucket"), "bucket").select("bucket", "node", "score", "label", *more)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, class_size, node, is_first) per document; ``is_first`` holds for the rows of the smallest id."""
    signed = written(_signed(docs, id_col, text_col), "signatures", BATCH_ROWS)
    nodes = written(signed.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_docs"),
                                               F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    rows = nodes.where("bands IS NOT NULL").select("node", F.explode("bands").alias("bucket"))
    full = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = rows.join(full, "bucket")
    score = rows.groupBy("node").agg(F.sum("size").alias("score"))
    rows = written(rows.join(score, "node").select("bucket", "node", "score"), "buckets")
    # The pivot is the fullest member of a bucket.
    pivot = rows.groupBy("bucket").agg(F.max(F.struct("score", "node")).alias("p"))
    met = rows.join(pivot, "bucket").where(F.col("node") != F.col("p.node"))
    tested = written(met.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct(), "pairs")
    label = components(_links(tested, nodes, docs, id_col, text_col, threshold))
    open_rows = written(_several(_labelled(rows, label)), "open")
    grams = written(_grams(open_rows, nodes, docs, id_col, text_col), "open-grams", BATCH_ROWS)
    names = list(_REACH)
    for turn in range(CLOSING):
        left = grams if turn == 0 else grams.join(open_rows.select("node").distinct(), "node", "left_semi")
        met = open_rows.select("bucket", "node", "score", "label").join(_reach(_each(left)), "node")
        ends = met.groupBy("bucket").agg(*[extreme(c).alias("b_" + c) for c, extreme in _REACH.items()])
        met = met.join(ends, "bucket").where(_may_meet({c: F.col(c) for c in names}, {c: F.col("b_" + c) for c in names}, threshold))
        open_rows = written(_several(met.select("bucket", "node", "score", "label", *names), names), "open")
    # A pair is formed in the least of the buckets that it still shares (a text has at most 2 BANDS).
    shared = open_rows.groupBy("node").agg(F.collect_set("bucket").alias("all"))
    open_rows = open_rows.join(shared, "node").join(grams.select("node", "bins", "rest"), "node")
    x, y = (open_rows.select("bucket", F.col("node").alias(e), F.col("label").alias("l" + e), *[F.col(c).alias(e + "_" + c) for c in ("all", "bins", "rest", *names)]) for e in "xy")
    ends = [{c: F.col(f"{e}_{c}") for c in ("rest", *names)} for e in "xy"]
    pairs = x.join(y, (x["bucket"] == y["bucket"]) & (F.col("lx") < F.col("ly")) & _may_meet(*ends, threshold)
                   & _share_enough(*ends, threshold, F.col("x_bins"), F.col("y_bins"))
                   & (F.array_min(F.array_intersect("x_all", "y_all")) == x["bucket"]))
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    pairs = written(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():  # the new links join classes
        new = _links(pairs, nodes, docs, id_col, text_col, threshold)
        for end in ("a", "b"):
            new = new.join(label.withColumnsRenamed({"node": end, "label": f"l{end}"}), end, "left")
        new = new.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        joined = components(new)
        both = label.join(joined.select(F.col("node").alias("label"), F.col("label").alias("joined")), "label", "full")
        label = both.select(F.coalesce("node", "label").alias("node"), F.coalesce("joined", "label").alias("label"))
    member = nodes.select("node", "first_id", "n_docs")
    member = member.join(label, "node", "left").withColumn("component", F.coalesce("label", "node")).drop("label")
    first = F.min(F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id"), F.col("node"))).alias("f")
    by_class = member.groupBy("component").agg(first, F.sum("n_docs").alias("class_size"))
    member = member.join(by_class, "component").select("node", "f", "class_size")
    return (signed.select("doc_id", "node").join(member, "node")
            .select("doc_id", F.col("f.first_id").alias("class_id"), "class_size", "node",
                    ((F.col("node") == F.col("f.node")) & F.col("doc_id").eqNullSafe(F.col("f.first_id"))).alias("is_first")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents without near-duplicates: of each class the one with the smallest id, one row of it."""
    kept = (classes(docs, id_col, text_col, threshold).where("is_first")
            .groupBy(F.col("doc_id").alias("id"), "node").agg((F.count(F.lit(1)) > 1).alias("twice")))
    rows, (own_id, text) = numbered(docs, id_col, text_col)
    columns = rows.columns
    rows = rows.withColumn("hash", _digest(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.join(kept, (F.col("hash") == F.col("node")) & F.col(own_id).eqNullSafe(F.col("id")))
    # Only rows of an id and text that stand more than once are grouped.
    return (rows.where("NOT twice").unionByName(rows.where("twice").dropDuplicates(["node", "id"]))
            .select(*columns).toDF(*docs.columns))
