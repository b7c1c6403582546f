"""Language-model scores by deleted interpolation (operator 3).

The model mixes maximum-likelihood n-gram estimates of orders 1 to ``order``,

    P_k(w | h) = lambda_k[b] * c(hw) / c(h) + (1 - lambda_k[b]) * P_(k-1)(w | h'),   P_0 = 1 / (V + 1),

with b the bucket of the context's frequency (its bit length).  The weights come from
expectation-maximisation on held-out counts: one tenth of the training documents
(``TUNE`` by crc32) is set aside, the counts of the others give the estimates, and each
round moves a weight to the share of its bucket's held-out tokens that its order
explains; then all training counts are used.

Counting and looking up are one exchange.  Documents are dealt to blocks by a hash
of their id; a block asks for its distinct n-gram hashes, sorted and cut by their
leading bits into key ranges, each with its own counts; the range's task sums
them over all blocks and answers each block in the order of its question.  A
frequent n-gram is one key in a block, so no key weighs more than the number of
blocks; nothing is collected but weights and totals.

Defined cases: a null text is empty (one token, the end); a null id counts as
the empty text in the crc; repeated rows count and are scored each; without training text
every token is unknown (P_0 = 1, N = 0); an empty table gives no rows; other
columns are ignored.  Texts are whole; a very long one makes its block longer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pack, unpack, written
from .textblocks import U, crc_remainder, mix64, pair_hash, span_hashes, text_buffer, word_spans

ORDER = 2
BLOCK_BYTES, RANGE_KEYS = 12 << 20, 4 << 20
#: Remainders of crc32(doc_id) modulo FOLDS: HELD_OUT is never learned from, TUNE sets the weights.
FOLDS, HELD_OUT, TUNE = 10, 0, 1
#: Learning stops when a round gains less than TOLERANCE in log10 probability a held-out token.
MAX_ROUNDS, TOLERANCE = 1000, 1e-6
_BEGIN, _END = mix64(np.array([11, 13], U))
_BUCKETS = 65


def padded_tokens(buf: np.ndarray, offs: np.ndarray, order: int):
    """(hash, row, is a token) of each row's begin marks, words and end."""
    start, end, row = word_spans(buf, offs)
    h, n, pad = span_hashes(buf, start, end, fold=True), len(offs) - 1, order - 1
    size = np.bincount(row, minlength=n) + pad + 1
    stop = np.cumsum(size)
    out = np.full(int(size.sum()), _BEGIN, U)
    out[np.arange(len(h)) + (row + 1) * pad + row] = h
    out[stop - 1] = _END
    rows = np.repeat(np.arange(n), size)
    return out, rows, np.arange(len(out)) - (stop - size)[rows] >= pad


def gram_keys(tokens: np.ndarray, rows: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1 .. order the key of the k-gram that ends at each position; keys of words are odd, all others even."""
    out, run = [np.where(tokens == _BEGIN, tokens & ~U(1), tokens | U(1))], tokens
    for k in range(2, order + 1):
        prev = np.full(len(tokens), _BEGIN, U)
        prev[k - 1:] = np.where(rows[k - 1:] == rows[:len(rows) - k + 1], tokens[:len(tokens) - k + 1], _BEGIN)
        run = pair_hash(prev, run)
        out.append(run & ~U(1))
    return out


def _question(table: pa.Table, order: int):
    buf, offs = text_buffer(table.column("text"))
    tokens, rows, real = padded_tokens(buf, offs, order)
    keys = gram_keys(tokens, rows, order)
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    return rows, real, distinct, which.reshape(order, -1)


def _cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2**bits key ranges begins."""
    edges = np.arange(1, 1 << bits, dtype=U) << U(64 - bits) if bits else np.zeros(0, U)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def _ask(order: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        fold = table.column("fold").to_numpy()
        rows, _, distinct, which = _question(table, order)
        kind = fold[rows]
        base, tune = ((kind != HELD_OUT) & (kind != TUNE)).astype(float), (kind == TUNE).astype(float)
        c_base = sum(np.bincount(w, base, len(distinct)) for w in which)
        c_tune = sum(np.bincount(w, tune, len(distinct)) for w in which)
        cut = _cuts(distinct, bits)
        full = np.flatnonzero(cut[:-1] < cut[1:])
        block = table.column("block")[0].as_py()
        parts = [slice(cut[i], cut[i + 1]) for i in full]
        return pa.table({"range": pa.array(full, pa.int32()), "block": pa.array([block] * len(full), pa.int32()),
                         "keys": pa.array([pack(distinct[p], True) for p in parts], pa.binary()),
                         "base": pa.array([pack(c_base[p]) for p in parts], pa.binary()),
                         "tune": pa.array([pack(c_tune[p]) for p in parts], pa.binary())})
    return run


def _answer(table: pa.Table) -> pa.Table:
    """The sums over all blocks, for each block in the order it asked; words counts the range's trained words."""
    each = [unpack(b, True) for b in table.column("keys").to_pylist()]
    keys, which = np.unique(np.concatenate(each), return_inverse=True)
    base, tune = (np.bincount(which, np.concatenate([unpack(b) for b in table.column(c).to_pylist()]).astype(float), len(keys))
                  for c in ("base", "tune"))
    words = int((((keys & U(1)) == 1) & (base + tune > 0)).sum())
    at = np.cumsum([0, *map(len, each)])
    own = [which[at[i]:at[i + 1]] for i in range(len(each))]
    return pa.table({"block": table.column("block"), "range": table.column("range"),
                     "base": pa.array([pack(base[w]) for w in own], pa.binary()),
                     "tune": pa.array([pack(tune[w]) for w in own], pa.binary()),
                     "words": pa.array([words] + [0] * (len(own) - 1), pa.int64())})


def _counts(replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(replies.column("range").to_numpy())
    base, tune = (replies.column(c).to_pylist() for c in ("base", "tune"))
    return (np.concatenate([unpack(base[i]) for i in order]).astype(np.float64),
            np.concatenate([unpack(tune[i]) for i in order]).astype(np.float64))


def _parts(which: np.ndarray, count: np.ndarray, rows: np.ndarray, order: int):
    """Per position, for k = 2 .. order: count of the k-gram and of its context; then the count of the word itself."""
    c = [count[w] for w in which]
    out = []
    for k in range(order, 1, -1):
        ctx = np.zeros(len(rows))
        ctx[1:] = c[k - 2][:-1]  # the (k-1)-gram that ends one position before
        out += [c[k - 1], ctx]
    return [*out, c[0]]


def _bits(x: np.ndarray) -> np.ndarray:
    return np.frexp(x)[1]


def mixed(parts: list[np.ndarray], weights: np.ndarray, n: float, v: float, order: int) -> np.ndarray:
    """P of each token; ``weights[k - 1, bucket]``."""
    p = np.full(len(parts[-1]), 1.0 / (v + 1))
    p = weights[0, 0] * parts[-1] / max(n, 1.0) + (1 - weights[0, 0]) * p
    for k in range(2, order + 1):
        c, ctx = parts[2 * (order - k)], parts[2 * (order - k) + 1]
        lam = np.where(ctx > 0, weights[k - 1, _bits(ctx)], 0.0)
        p = lam * c / np.maximum(ctx, 1.0) + (1 - lam) * p
    return p


def learn_weights(held: DataFrame, n: float, v: float, order: int) -> np.ndarray:
    """EM over the held-out counts (columns c<k>, x<k>, times): a few sums per order and bucket reach the driver each round."""
    lam, before = np.full((order, _BUCKETS), 0.5), -np.inf
    if n <= 0 or held.isEmpty():
        lam[:] = 0.5 if n > 0 else 0.0
        return lam
    for _ in range(MAX_ROUNDS):
        def weight(k):
            return F.lit(float(lam[0, 0])) if k == 1 else F.element_at(F.array(*[F.lit(float(x)) for x in lam[k - 1]]), F.col(f"b{k}") + 1)

        d = held.withColumn("p", F.lit(1.0 / (v + 1)))
        for k in range(1, order + 1):
            ml = F.col("c1") / F.lit(n) if k == 1 else F.when(F.col(f"x{k}") > 0, F.col(f"c{k}") / F.col(f"x{k}")).otherwise(0.0)
            own = ml * weight(k) if k == 1 else F.when(F.col(f"x{k}") > 0, ml * weight(k)).otherwise(0.0)
            rest = 1 - (weight(k) if k == 1 else F.when(F.col(f"x{k}") > 0, weight(k)).otherwise(0.0))
            d = d.withColumn("q", own + rest * F.col("p")).withColumn(f"r{k}", own / F.col("q")).withColumn("p", F.col("q"))
        d = d.withColumn("reach", F.col("times").cast("double"))
        for k in range(order, 0, -1):
            d = d.withColumn(f"n{k}", F.col("reach")).withColumn(f"g{k}", F.col("reach") * F.col(f"r{k}"))
            d = d.withColumn("reach", F.col("reach") * (1 - F.col(f"r{k}")))
        stats = d.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"b{k}") if k > 1 else F.lit(0)).alias("b"),
                                                      F.col(f"g{k}").alias("g"), F.col(f"n{k}").alias("n"),
                                                      (F.col("times") * F.log10("p")).alias("fit"))
                                             for k in range(1, order + 1)])).alias("s")).select("s.*")
        new, fit, tokens = lam.copy(), 0.0, 0.0
        for r in stats.groupBy("k", "b").agg(F.sum("g").alias("g"), F.sum("n").alias("n"), F.sum("fit").alias("fit")).collect():
            if r["k"] == order:
                fit, tokens = fit + r["fit"], tokens + r["n"]
            if r["n"] > 0 and (r["k"] == 1 or r["b"] > 0):
                new[r["k"] - 1, r["b"]] = min(max(r["g"] / r["n"], 1e-6), 1 - 1e-6)
        lam, gain, before = new, fit / tokens - before, fit / tokens
        if gain < TOLERANCE:
            return lam
    raise RuntimeError(f"the weights still gain {gain:.2g} a token after {MAX_ROUNDS} rounds")


def score(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per document."""
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    n_blocks = max(1, -(-total // BLOCK_BYTES))
    bits = max(0, int(total // 6 * order // RANGE_KEYS).bit_length())
    h, fold = F.xxhash64(F.col(id_col)), crc_remainder(id_col, FOLDS).cast("int")
    # Documents that tune the weights have blocks of their own, so that tuning reads only them.
    block = F.when(fold == TUNE, F.lit(n_blocks) + F.pmod(h, F.lit(-(-n_blocks // FOLDS)))).otherwise(F.pmod(h, F.lit(n_blocks)))
    rows = docs.select(block.cast("int").alias("block"), F.col(id_col).alias("doc_id"), fold.alias("fold"), F.col(text_col).alias("text"))

    asked = rows.groupBy("block").applyInArrow(_ask(order, bits), "range int, block int, keys binary, base binary, tune binary")
    replies = written(asked.groupBy("range").applyInArrow(
        _answer, "block int, range int, base binary, tune binary, words long"), "counts")
    v = float(replies.agg(F.sum("words")).first()[0] or 0)

    def tune(texts: pa.Table, got: pa.Table) -> pa.Table:
        columns = [f"{c}{k}" for k in range(order, 1, -1) for c in "cx"] + ["c1"]
        names = [*columns, *(f"b{k}" for k in range(2, order + 1)), "times"]
        if not texts.num_rows:
            return pa.table({n: pa.array([], pa.int32() if n[0] == "b" else pa.int64()) for n in names})
        place, real, distinct, which = _question(texts, order)
        parts = np.stack(_parts(which, _counts(got)[0], place, order))[:, real].astype(np.int64)
        key = np.zeros(parts.shape[1], U)
        for p in parts:
            key = pair_hash(key, p.astype(U))
        _, pos, times = np.unique(key, return_index=True, return_counts=True)
        out = dict(zip(columns, parts[:, pos]))
        out |= {f"b{k}": _bits(out[f"x{k}"].astype(float)).astype(np.int32) for k in range(2, order + 1)}
        return pa.table({n: out[n] if n != "times" else times.astype(np.int64) for n in names})

    held_schema = ", ".join([f"{c}{k} long" for k in range(order, 1, -1) for c in "cx"] + ["c1 long"]
                            + [f"b{k} int" for k in range(2, order + 1)] + ["times long"])
    held = written(rows.where(F.col("fold") == TUNE).groupBy("block")
                   .cogroup(replies.where(F.col("block") >= n_blocks).groupBy("block")).applyInArrow(tune, held_schema), "held-out")

    def sizes(batches):
        for batch in batches:
            n = len(word_spans(*text_buffer(batch.column(1)))[0]) + batch.num_rows
            yield pa.record_batch([pa.array([n if batch.num_rows else 0], pa.int64()),
                                   pa.array([int(_tokens_where(batch, TUNE))], pa.int64()),
                                   pa.array([int(_tokens_where(batch, HELD_OUT))], pa.int64())], names=["n", "tune", "held"])

    n_all, n_tune, n_held = rows.select("fold", "text").mapInArrow(sizes, "n long, tune long, held long").agg(
        F.sum("n"), F.sum("tune"), F.sum("held")).first()
    n_train = float((n_all or 0) - (n_held or 0))
    weights = learn_weights(held, n_train - (n_tune or 0), v, order)

    def give(texts: pa.Table, got: pa.Table) -> pa.Table:
        n = texts.num_rows
        place, real, distinct, which = _question(texts, order)
        base, tuned = _counts(got)
        parts = [p[real] for p in _parts(which, base + tuned, place, order)]
        at, c = place[real], parts[-1]
        logp = np.log10(mixed(parts, weights, n_train, v, order))
        plain = np.log10((c + 0.1) / (n_train + 0.1 * (v + 1)))
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": pa.array(texts.column("fold").to_numpy() == HELD_OUT),
                         "n_tokens": np.bincount(at, minlength=n).astype(np.int64),
                         "n_known": np.bincount(at, c > 0, n).astype(np.int64),
                         "train_tokens": np.full(n, int(n_train), np.int64),
                         "base_score": np.bincount(at, plain, n), "score": np.bincount(at, logp, n)})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        give, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _tokens_where(batch: pa.RecordBatch, fold: int) -> int:
    part = batch.filter(pa.array(batch.column(0).to_numpy() == fold))
    return len(word_spans(*text_buffer(part.column(1)))[0]) + part.num_rows
