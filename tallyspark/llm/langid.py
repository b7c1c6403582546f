"""Language identification with interpolated Kneser-Ney character models (operator 8).

Training takes at most about ``TRAIN_DOCS`` documents a language (a documented
bound, drawn by a hash of the id, whole texts).  Spark counts the character
n-grams of the sample up to ``ORDER``; per language, modified counts give the
interpolated Kneser-Ney probability

    p_k(c | h) = max(n(hc) - D_k, 0) / n(h*) + D_k * t(h*) / n(h*) * p_(k-1)(c | h')

with raw counts at the top order and continuation counts (distinct left
neighbours) below, ending in a uniform share for unseen characters.  All
languages share one sorted array of n-gram hashes an order, with a row of log
probabilities and back-off weights: a look-up is one binary search.

A text's score under a language is its summed log probability over runs of
letters (each framed by word marks) divided by their length; the lowest
cross-entropy wins.  Two calibrations come from a fifth of the sample that the
counts leave out: a temperature that turns entropies into a probability, and,
per language, the entropy beyond which a text is ``rejected`` as foreign.

Prediction works on a batch's distinct words, so a word is scored once a batch.

Defined cases: null text, empty text and text without a letter give ``und``,
score 0 and are rejected; repeated rows each give a row; an empty table gives no
rows; with nothing to learn from every text is ``und``; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import U, mix64, row_slices, span_hashes, text_buffer, word_spans

ORDER = 5
#: Documents a language that are drawn for training, about; the model's size follows from it, not from the corpus.
TRAIN_DOCS = 1_000
#: Bytes of text that a task works on at a time.
SLICE_BYTES = 8 << 20
#: Share of a language's calibration texts that its threshold lets pass.
PASS_SHARE = 0.995
MARK = 0x20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: its lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def distinct_words(buf, offs):
    """(text of the distinct space-parted words, joined by newlines; index of each word's distinct word; row of each word)."""
    start, end, row = word_spans(buf, offs)
    _, pos, which = np.unique(span_hashes(buf, start, end), return_index=True, return_inverse=True)
    order = np.argsort(pos)  # spans have to ascend
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    s, n = start[pos[order]], end[pos[order]] - start[pos[order]]
    at = np.concatenate(([0], np.cumsum(n + 1)))
    joined = np.full(at[-1], 10, np.uint8)
    to = np.arange(at[-1] - len(n)) + np.repeat(np.arange(len(n)), n)
    joined[to] = buf[np.arange(n.sum()) + np.repeat(s - np.concatenate(([0], np.cumsum(n)))[:-1], n)] if len(n) else 0
    return joined.tobytes().decode("utf-8", "replace"), rank[which], row


def framed(text: str, n_words: int):
    """(symbols, word) of newline-parted words: runs of letters in lower case with one mark before and after each run."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    word = np.zeros(len(code), np.int64)
    cut = code == 10
    word[1:] = np.cumsum(cut)[:-1]
    sym = _letters()[code]
    run = sym > 0
    first, last = run.copy(), run.copy()
    first[1:] &= ~run[:-1]
    last[:-1] &= ~run[1:]
    last_before = np.zeros(len(run), bool)
    last_before[1:] = last[:-1]
    # Each run gets a mark before it and one after it; words end in a newline, so a mark after has a place.
    size = run + first.astype(np.int64) + last_before
    at = np.cumsum(size) - size
    out, owner = np.full(int(size.sum()), MARK, np.uint32), np.repeat(word, size)
    out[at[run] + first[run] + last_before[run]] = sym[run]
    return out, owner


def gram_hashes(sym: np.ndarray, order: int):
    """Yields (k, positions, hash of the k-gram ending there) for k = 1 .. order; grams stay within one framed run."""
    n = len(sym)
    mark = sym == MARK
    # A run is <mark letters mark>: the opening mark is the one before a letter.
    begin = np.zeros(n, bool)
    begin[:-1] = mark[:-1] & ~mark[1:]
    age = np.arange(n) - np.maximum.accumulate(np.where(begin, np.arange(n), 0))
    s = mix64(sym.astype(np.uint64))
    h = s.copy()
    for k in range(1, order + 1):
        at = np.flatnonzero(age >= max(k - 1, 1))  # nothing ends at an opening mark
        if k > 1:
            prev = np.zeros(n, U)
            if k <= n:
                prev[k - 1:] = s[:n - k + 1]
            h = mix64(h * U(0x9FB21C651E98DF25) + prev * U(2 * k + 1))
        yield k, at, h[at]


class Model:
    """Back-off tables of all languages: per order a sorted array of n-gram hashes, log10 p and back-off by language."""

    def __init__(self, langs: list[str], tables, floor: np.ndarray):
        self.langs, self.tables, self.floor = langs, tables, floor
        self.temperature, self.limits = 1.0, np.full(len(langs), np.inf)

    def score_words(self, text: str, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(summed log10 p by word and language, symbols by word)."""
        sym, owner = framed(text, n_words)
        total = np.zeros((len(sym), len(self.langs)), np.float32)
        done, any_at = np.zeros((len(sym), len(self.langs)), bool), np.zeros(len(sym), bool)
        by_order = list(gram_hashes(sym, ORDER))
        any_at[by_order[0][1]] = True
        found = {}
        for k, at, h in by_order:
            keys = self.tables[k][0]
            i = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            row = np.full(len(sym), -1, np.int64)
            if len(keys):
                hit = keys[i] == h
                row[at[hit]] = i[hit]
            found[k] = row
        for k in range(ORDER, 0, -1):
            _, logp, _ = self.tables[k]
            hit = np.flatnonzero((found[k] >= 0) & any_at)
            p = logp[found[k][hit]]
            new = ~np.isnan(p) & ~done[hit]
            total[hit] += np.where(new, p, 0)
            done[hit] |= new
            if k > 1:  # not seen at this order: the context's back-off weight; the context ends one symbol before
                _, _, back = self.tables[k - 1]
                ctx = np.full(len(sym), -1, np.int64)
                ctx[1:] = found[k - 1][:-1]
                hit = np.flatnonzero((ctx >= 0) & any_at)
                total[hit] += np.where(done[hit], 0, back[ctx[hit]])
        total += np.where(done, 0, self.floor[None, :])
        total[~any_at] = 0
        sums = np.stack([np.bincount(owner, total[:, j], n_words) for j in range(len(self.langs))], 1)
        return sums, np.bincount(owner[any_at], minlength=n_words)

    def entropies(self, buf, offs) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy in log10 a symbol by row and language, symbols by row)."""
        text, which, row = distinct_words(buf, offs)
        n = int(which.max()) + 1 if len(which) else 0
        if not n:
            return np.zeros((len(offs) - 1, len(self.langs))), np.zeros(len(offs) - 1, np.int64)
        sums, size = self.score_words(text, n)
        rows = len(offs) - 1
        count = np.bincount(row, size[which], rows)
        each = np.stack([np.bincount(row, sums[which, j], rows) for j in range(len(self.langs))], 1)
        return -each / np.maximum(count, 1)[:, None], count.astype(np.int64)

    def predict(self, buf, offs):
        """(index of the language or -1, score, rejected) by row."""
        h, n = self.entropies(buf, offs)
        best = h.argmin(1)
        low = h[np.arange(len(h)), best]
        with np.errstate(over="ignore"):
            score = 1 / np.exp((low[:, None] - h) * self.temperature).sum(1)
        rejected = (low > self.limits[best]) | (n == 0)
        return np.where(n > 0, best, -1), np.where(n > 0, score, 0.0), rejected


def kneser_ney(grams, langs: list[str]) -> Model:
    """Model of counted n-grams: (lang index, order, hash, context hash, shorter gram's hash, begins, count) columns.

    ``context`` drops the last symbol, ``shorter`` the first; ``begins`` tells
    grams that start at an opening mark and so can have no left neighbour."""
    tables, lower, floor = {}, None, None
    n_langs = len(langs)
    by_order = {k: {c: v[grams["k"] == k] for c, v in grams.items()} for k in range(1, ORDER + 1)}
    counts = {}
    for k in range(1, ORDER + 1):
        g = by_order[k]
        if k == ORDER:
            counts[k] = g["n"].astype(np.float64)
            continue
        # Distinct left neighbours: rows of the next order that shorten to this gram; raw where none can stand left of it.
        up = by_order[k + 1]
        key = mix64(up["shorter"] + up["lang"].astype(np.uint64))
        keys, cont = np.unique(key, return_counts=True)
        own = mix64(g["hash"] + g["lang"].astype(np.uint64))
        i = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
        c = np.where(keys[i] == own, cont[i], 0) if len(keys) else np.zeros(len(own))
        counts[k] = np.where(g["begins"] | (c == 0), g["n"], c).astype(np.float64)
    alphabet = max(1, len(np.unique(by_order[1]["hash"])))
    for k in range(1, ORDER + 1):
        g, c = by_order[k], counts[k]
        lang = g["lang"]
        p, discount = np.zeros(len(c)), np.zeros(n_langs)
        for j in range(n_langs):
            n1, n2 = (c[lang == j] == 1).sum(), (c[lang == j] == 2).sum()
            discount[j] = n1 / (n1 + 2 * n2) if n1 else 0.5
        ctx = mix64(g["context"] + lang.astype(np.uint64)) if k > 1 else lang.astype(np.uint64)
        contexts, which = np.unique(ctx, return_inverse=True)
        total = np.bincount(which, c, len(contexts))
        kinds = np.bincount(which, minlength=len(contexts))
        d = np.minimum(discount[lang], c)
        held = np.bincount(which, d, len(contexts))
        gamma = held / np.maximum(total, 1e-300)
        if k == 1:
            below = np.full(len(c), 1.0 / (alphabet + 1))
            floor = np.full(n_langs, -9.0)
            for i, x in enumerate(contexts):
                floor[int(x)] = np.log10(max(gamma[i], 1e-9) / (alphabet + 1))
        else:
            i = np.minimum(np.searchsorted(lower[0], own_key := mix64(g["shorter"] + lang.astype(np.uint64))), len(lower[0]) - 1)
            below = np.where(lower[0][i] == own_key, lower[1][i], 1.0 / (alphabet + 1))
        p = (c - d) / total[which] + gamma[which] * below
        own = mix64(g["hash"] + lang.astype(np.uint64))
        order = np.argsort(own)
        lower = own[order], p[order]
        keys, row = np.unique(g["hash"], return_inverse=True)
        logp = np.full((max(len(keys), 1), n_langs), np.nan, np.float32)
        logp[row, lang] = np.log10(p)
        tables[k] = [keys, logp, np.zeros((max(len(keys), 1), n_langs), np.float32)]
        if k > 1:  # back-off weights sit with the context, one order down
            keys1, _, back = tables[k - 1]
            pos = np.unique(ctx, return_index=True)[1]
            at = np.searchsorted(keys1, g["context"][pos])
            ok = (at < len(keys1)) & (keys1[np.minimum(at, len(keys1) - 1)] == g["context"][pos])
            back[at[ok], lang[pos[ok]]] = np.log10(gamma[ok])
    return Model(langs, {k: tuple(v) for k, v in tables.items()}, floor.astype(np.float32))


_GRAMS = "lang int, k int, hash long, context long, shorter long, begins boolean, n long"


def _count_grams(lang_index: dict[str, int]):
    def run(batches):
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for name in set(langs):
                rows = np.flatnonzero([x == name for x in langs])
                buf, offs = text_buffer(batch.column(0).take(pa.array(rows)))
                for i, j in row_slices(offs, SLICE_BYTES):
                    text, which, _ = distinct_words(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                    if not len(which):
                        continue
                    times = np.bincount(which)
                    sym, owner = framed(text, len(times))
                    grams = {k: (at, h) for k, at, h in gram_hashes(sym, ORDER)}
                    ends = {}
                    for k, (at, h) in grams.items():
                        ends[k] = np.zeros(len(sym), U)
                        ends[k][at] = h
                    for k, (at, h) in grams.items():
                        # The opening mark alone is no gram, but it is a context: its hash is that of the mark.
                        mark = mix64(np.array([MARK], U))[0]
                        ctx = np.zeros(len(at), U) if k == 1 else ends[k - 1][at - 1]
                        if k == 2:
                            ctx = np.where(ctx == 0, mark, ctx)
                        short = np.zeros(len(at), U) if k == 1 else ends[k - 1][at]
                        begins = sym[at - (k - 1)] == MARK if k > 1 else np.zeros(len(at), bool)
                        _, pos, inv = np.unique(h, return_index=True, return_inverse=True)
                        n = np.bincount(inv, times[owner[at]])
                        yield pa.record_batch([
                            pa.array(np.full(len(pos), lang_index[name], np.int32)), pa.array(np.full(len(pos), k, np.int32)),
                            *(pa.array(x[pos].view(np.int64)) for x in (h, ctx, short)), pa.array(begins[pos]),
                            pa.array(n.astype(np.int64))], names=["lang", "k", "hash", "context", "shorter", "begins", "n"])
    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          train_docs: int = TRAIN_DOCS) -> Model:
    """Model of the rows with a text and a language; at most about ``train_docs`` rows a language reach it."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # one row a language
    langs = sorted(counts)
    if not langs:
        return Model([], {}, np.zeros(0))
    h = F.pmod(F.xxhash64(F.col(id_col), F.lit(29)), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for name in langs for x in (name, min(1 << 30, train_docs * (1 << 30) // counts[name]))])
    sample = rows.where(h < share[F.col(lang_col)]).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
                                                           (F.pmod(h, F.lit(5)) == 0).alias("aside"))
    fit, aside = sample.where("NOT aside").select("text", "lang"), sample.where("aside").select("text", "lang")
    got = (fit.mapInArrow(_count_grams({x: i for i, x in enumerate(langs)}), _GRAMS)
           .groupBy("lang", "k", "hash").agg(F.min("context").alias("context"), F.min("shorter").alias("shorter"),
                                             F.min("begins").alias("begins"), F.sum("n").alias("n")).toArrow())
    grams = {c: got.column(c).to_numpy() for c in got.column_names}
    for c in ("hash", "context", "shorter"):
        grams[c] = grams[c].view(np.uint64)
    model = kneser_ney(grams, langs)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def measure(batches):
        for batch in batches:
            m = sent.value
            e, n = m.entropies(*text_buffer(batch.column(0)))
            yield pa.record_batch([batch.column(1), pa.array(list(e), pa.list_(pa.float64())), pa.array(n)], names=["lang", "e", "n"])

    kept = aside.mapInArrow(measure, "lang string, e array<double>, n long").where("n >= 20").toPandas()
    if len(kept):
        e, y = np.stack(kept["e"]), kept["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
        loss = {t: np.mean(np.log(np.exp((e[np.arange(len(y)), y][:, None] - e) * t).sum(1).clip(1e-300, 1e300)))
                for t in (1, 2, 4, 8, 16, 32, 64, 128, 256)}
        model.temperature = float(min(loss, key=loss.get))
        for j in range(len(langs)):
            own = e[y == j, j]
            if len(own):
                model.limits[j] = np.quantile(own, PASS_SHARE) * 1.25
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """(doc_id, *keep, lang_pred, score, rejected) per document."""
    rows = docs.select(docs[id_col].alias("doc_id"), *keep, docs[text_col].alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    names = [*rows.columns[:-1], "lang_pred", "score", "rejected"]

    def run(batches):
        m = sent.value
        names_of = np.array([*m.langs, "und"], dtype=object)
        for batch in batches:
            buf, offs = text_buffer(batch.column(batch.num_columns - 1))
            for i, j in row_slices(offs, SLICE_BYTES):
                if m.langs:
                    best, score, rejected = m.predict(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                else:
                    best, score, rejected = np.full(j - i, -1), np.zeros(j - i), np.ones(j - i, bool)
                yield pa.record_batch([*(c.slice(i, j - i) for c in batch.columns[:-1]), pa.array(names_of[best], pa.string()),
                                       pa.array(score), pa.array(rejected)], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")
