"""Quality rules as a short-circuit cascade (operator 6).

A rule is a vectorised test of a batch of texts that says which to reject.  On
a sample of about ``SAMPLE_ROWS`` documents, spread over the corpus by a hash
of the id, every rule's cost (seconds a byte) and rejection rate are measured
inside the tasks; rules then run in descending rejection per cost, and each
sees only the texts that all rules before it let pass.  The order decides cost
alone: a document is kept if no rule rejects it, whatever the order.

The rules know the corpus only through its text, so they are language-neutral.

Defined cases: a null text has no words; repeated rows are judged each on its
own; an empty table gives no rows; other columns are ignored by ``measures``
and ``verdicts`` and carried through by ``kept_documents``.  Very long texts are
whole slices of their own.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import numbered
from .textblocks import _IS_SPACE, pair_hash, repeated, row_slices, span_hashes, take_rows, text_buffer, word_spans

SAMPLE_ROWS = 2_000
#: Bytes of text that a task works on at a time.
SLICE_BYTES = 4 << 20
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_SHARE = 50, 0.5


def _byte_set(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_IS_SYMBOL = _byte_set(SYMBOLS)
_IS_UPPER = _byte_set(bytes(range(65, 91)))
_IS_LETTER = _byte_set(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_STARTS_CHAR = np.array([b & 0xC0 != 0x80 for b in range(256)])


def _count(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Set flags per row."""
    at = np.flatnonzero(flags)
    return np.diff(np.searchsorted(at, offs))


def words_per_row(buf, offs):
    return np.bincount(word_spans(buf, offs)[2], minlength=len(offs) - 1)


def lines(buf: np.ndarray, offs: np.ndarray):
    """(start, end, row) of the lines that hold a word."""
    cut = np.zeros(len(buf) + 1, bool)
    cut[np.flatnonzero(buf == 10) + 1] = True
    cut[offs] = True
    start = np.flatnonzero(cut[:-1]) if len(buf) else np.zeros(0, np.int64)
    end = np.append(start[1:], len(buf))
    end = end - (buf[end - 1] == 10) if len(start) else end
    solid = np.concatenate(([0], np.cumsum(~_IS_SPACE[buf])))
    full = solid[end] > solid[start]
    start, end = start[full], end[full]
    return start, end, np.searchsorted(offs, start, "right") - 1


def duplicate_lines(buf, offs) -> tuple[np.ndarray, np.ndarray]:
    """Per row: lines equal to an earlier one, and all lines, of those with a word."""
    start, end, row = lines(buf, offs)
    n = len(offs) - 1
    if not len(start):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    pos = np.unique(pair_hash(row.astype(np.uint64), span_hashes(buf, start, end)), return_index=True)[1]
    every = np.bincount(row, minlength=n)
    return every - np.bincount(row[pos], minlength=n), every


def repeat_words(buf, offs) -> tuple[np.ndarray, np.ndarray]:
    """Per row: words inside 3-word windows that stand twice or more in the row, and all words."""
    start, end, row = word_spans(buf, offs)
    n = len(offs) - 1
    if len(start) < 3:
        return np.zeros(n, np.int64), np.bincount(row, minlength=n)
    h = span_hashes(buf, start, end)
    key = pair_hash(pair_hash(pair_hash(row[:-2].astype(np.uint64), h[:-2]), h[1:-1]), h[2:])
    whole = np.flatnonzero(row[:-2] == row[2:])
    at = whole[repeated(key[whole])]
    inside = np.zeros(len(start), bool)
    for k in range(3):
        inside[at + k] = True
    return np.bincount(row[inside], minlength=n), np.bincount(row, minlength=n)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[np.ndarray, np.ndarray], np.ndarray]


def _too_few_words(buf, offs):
    return words_per_row(buf, offs) < MIN_WORDS


def _repeats_itself(buf, offs):
    inside, every = repeat_words(buf, offs)
    return inside > MAX_REPEAT_SHARE * every


def _odd_word_length(buf, offs):
    chars = _count(_STARTS_CHAR[buf] & ~_IS_SPACE[buf], offs)
    words = np.maximum(words_per_row(buf, offs), 1)
    return (chars > 15 * words) | (chars < 2 * words)


def _many_symbols(buf, offs):
    return _count(_IS_SYMBOL[buf], offs) * 10 > np.maximum(words_per_row(buf, offs), 1)


def _many_duplicate_lines(buf, offs):
    twice, every = duplicate_lines(buf, offs)
    return twice * 10 > every * 3


def _shouts(buf, offs):
    return _count(_IS_UPPER[buf], offs) * 2 > _count(_IS_LETTER[buf], offs)


def _few_letters(buf, offs):
    return _count(_IS_LETTER[buf], offs) * 2 < _count(~_IS_SPACE[buf], offs)


#: The base rules are those that a text must pass in any case; the others are the method's own.
BASE_RULES = (Rule("too_few_words", _too_few_words), Rule("repeats_itself", _repeats_itself))
RULES = (Rule("odd_word_length", _odd_word_length), Rule("many_symbols", _many_symbols),
         Rule("many_duplicate_lines", _many_duplicate_lines), Rule("shouts", _shouts), Rule("few_letters", _few_letters))


def rule_order(docs: DataFrame, rules: tuple, id_col: str, text_col: str, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules by descending rejection per cost, measured on a sample; two counts a rule reach the driver."""
    rows = docs.count()
    share = min(1.0, sample_rows / max(1, rows))
    at = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 20))
    sample = docs.where(at <= F.lit(int(share * (1 << 20)))).select(text_col)

    def measure(batches):
        seen, spent, bytes_, rejected = 0, [0.0] * len(rules), 0, [0] * len(rules)
        for batch in batches:
            buf, offs = text_buffer(batch.column(0))
            seen, bytes_ = seen + batch.num_rows, bytes_ + len(buf)
            for k, rule in enumerate(rules):
                t = time.thread_time()
                rejected[k] += int(rule.rejects(buf, offs).sum())
                spent[k] += time.thread_time() - t
        yield pa.record_batch([pa.array([r.name for r in rules]), pa.array(spent, pa.float64()), pa.array(rejected, pa.int64()),
                               pa.array([bytes_] * len(rules), pa.int64()), pa.array([seen] * len(rules), pa.int64())],
                              names=["rule", "spent", "rejected", "bytes", "seen"])

    got = (sample.mapInArrow(measure, "rule string, spent double, rejected long, bytes long, seen long").groupBy("rule")
           .agg((F.sum("spent") / F.greatest(F.sum("bytes"), F.lit(1))).alias("cost"),
                (F.sum("rejected") / F.greatest(F.sum("seen"), F.lit(1))).alias("rate")).collect())
    gain = {r["rule"]: (r["rate"] or 0.0) / max(r["cost"] or 0.0, 1e-12) for r in got}
    return sorted((r.name for r in rules), key=lambda name: (-gain.get(name, 0.0), name))


def passes(buf: np.ndarray, offs: np.ndarray, rules: list[Rule]) -> np.ndarray:
    """Whether each row passes all rules; a rule sees only what those before it let pass."""
    alive = np.arange(len(offs) - 1)
    for rule in rules:
        if not len(alive):
            break
        part = (buf, offs) if len(alive) == len(offs) - 1 else take_rows(buf, offs, alive)
        alive = alive[~rule.rejects(*part)]
    out = np.zeros(len(offs) - 1, bool)
    out[alive] = True
    return out


def _ordered(docs, rules, id_col, text_col) -> list[Rule]:
    by_name = {r.name: r for r in rules}
    return [by_name[n] for n in rule_order(docs, rules, id_col, text_col)]


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) per document."""
    rules = _ordered(docs, RULES, id_col, text_col)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches):
        for batch in batches:
            buf, offs = text_buffer(batch.column(1))
            for i, j in row_slices(offs, SLICE_BYTES):
                b, o = buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
                inside, words = repeat_words(b, o)
                failed = (words < MIN_WORDS) | (inside * 100 > MAX_REPEAT_SHARE * 100 * words)
                kept, alive = np.zeros(j - i, bool), np.flatnonzero(~failed)
                kept[alive] = passes(*take_rows(b, o, alive), rules)
                cols = (words, _count(_STARTS_CHAR[b] & ~_IS_SPACE[b], o), _count(_IS_SYMBOL[b], o),
                        duplicate_lines(b, o)[0], inside)
                yield pa.record_batch([batch.column(0).slice(i, j - i), *(pa.array(c.astype(np.int64)) for c in cols),
                                       pa.array(failed), pa.array(kept)],
                                      names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                             "n_repeat_words", "base_failed", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                "n_repeat_words long, base_failed boolean, kept boolean")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that no rule, base rules included, rejects, with all their columns."""
    rules, at = _ordered(docs, BASE_RULES + RULES, id_col, text_col), docs.columns.index(text_col)
    rows, _ = numbered(docs)

    def run(batches):
        for batch in batches:
            buf, offs = text_buffer(batch.column(at))
            kept = [passes(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], rules) for i, j in row_slices(offs, SLICE_BYTES)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
