"""BPE encoding and decoding as a bounded-lookahead streaming transducer (operator 1).

Sufficient lookahead.  Whether the boundary left of a token ``v`` survives can
depend on text to its right only through rules applied earlier: rule r = (u, v)
fires at a place unless a rule r' < r first takes, from the right, ``v`` or a
piece on the right spine of ``v``; r' = (u', v') looks |v'| symbols further,
and so on along strictly falling ranks.  So over the merge list in rank order

    reach(r) = |v| + max{ reach(r') : r' < r, u' on the right spine of v }

and ``lookahead = max reach(r)`` symbols past a boundary settle it.  A settled
boundary splits the merging into two independent halves, hence the transducer
keeps only the symbols since the last emitted token: it merges its window, emits
every token that ends at least ``lookahead`` symbols before the window's end,
and goes on with the rest.  Memory is constant however long a word is.  (For a
merge list that uses a symbol before the rule that builds it the argument does
not hold; such a list gets no bound and words are held whole.)

Decoding turns ids into bytes and bytes into text with an incremental UTF-8
state machine, block by block; ill-formed bytes become U+FFFD as usual.

Defined cases: a null text counts as empty and gives no ids; repeated rows each
give a row; an empty table gives no rows; other columns are ignored; a null id
column value is passed through.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Words that a worker remembers; past it the memory is emptied, which only costs time.
REMEMBERED_WORDS = 400_000
#: Texts whose ids are held as Python numbers at a time.
BATCH_ROWS = 500
#: Characters of a text that are held at a time; cut at white space only.
TEXT_STEP = 1 << 20
#: Ids that are decoded at a time.
ID_STEP = 1 << 16
_NONE = 1 << 40
_CUT = re.compile(r"[ \t\n\r]")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if it is printable, else 256 + its rank."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def merge_lookahead(merges: list[tuple[int, int, int]], length: dict[int, int]) -> int | None:
    """Sufficient lookahead, in symbols, of rules (left, right, product) in rank order; None without a bound."""
    built: dict[int, tuple[int, int]] = {}
    products = {p for _, _, p in merges}
    reach_from: dict[int, int] = {}
    most = 1
    for left, right, product in merges:
        if (left in products and left not in built) or (right in products and right not in built):
            return None
        reach, piece = 0, right
        while True:
            reach = max(reach, reach_from.get(piece, 0))
            if piece not in built:
                break
            piece = built[piece][1]
        reach += length[right]
        reach_from[left] = max(reach_from.get(left, 0), reach)
        built.setdefault(product, (left, right))
        most = max(most, reach)
    return most


class Transducer:
    """Symbols of one word in, ids out as soon as they cannot change."""

    def __init__(self, ranks: dict[int, int], products: list[int], length: dict[int, int], lookahead: int | None):
        self.ranks, self.products, self.length, self.lookahead = ranks, products, length, lookahead
        self.window = None if lookahead is None else 4 * (lookahead + max(length.values()))

    def merged(self, ids: list[int]) -> list[int]:
        """The lowest-ranked pair first, the leftmost of equals, until no pair has a rule."""
        if len(ids) < 2:
            return ids
        get = self.ranks.get
        ranks = [get(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            ids[i:i + 2] = [new := self.products[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | new, _NONE)
            if i < len(ranks):
                ranks[i] = get(new << 32 | ids[i + 1], _NONE)
        return ids

    def stream(self, symbols):
        """Yields lists of final ids; holds at most ``window`` symbols."""
        held: list[int] = []
        for s in symbols:
            held.append(s)
            if self.window and len(held) >= self.window:
                ids, end, settled = self.merged(held[:]), 0, []
                for t in ids:
                    end += self.length[t]
                    if end > len(held) - self.lookahead:
                        break
                    settled.append(t)
                yield settled
                held = held[sum(self.length[t] for t in settled):]
        yield self.merged(held)

    def word(self, symbols: list[int]) -> list[int]:
        if self.window is None or len(symbols) < self.window:
            return self.merged(symbols)
        return list(chain.from_iterable(self.stream(symbols)))


#: str.split() also cuts at these, which the tokenizer files' \s doesn't match.
_NOT_SPACE = re.compile("[\x1c-\x1f]")


class WordBpe:
    """A tokenizers file of a BPE model with word ends, lower-casing and byte-level symbols."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        steps = {n["type"]: n for n in (spec["normalizer"] or {}).get("normalizers", [])}
        if set(steps) - {"NFC", "Replace", "Lowercase"} or spec.get("decoder") or model.get("byte_fallback"):
            raise ValueError("this tokenizer file uses steps that are not built here")
        self.nfc, self.lower = "NFC" in steps, "Lowercase" in steps
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")).findall
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + self.suffix] for c in alphabet]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        length = dict.fromkeys(chain(self.inner, self.last), 1)
        for a, b, c in merges:
            length.setdefault(c, length[a] + length[b])
        self.transducer = Transducer({a << 32 | b: r for r, (a, b, _) in reversed(list(enumerate(merges)))},
                                     [c for *_, c in merges], length, merge_lookahead(merges, length))
        strings = {**{i: s for s, i in vocab.items()}, **{i: s for s, i in self.added.items()}}
        #: Bytes of each id, as the file's (missing) decoder has them: the symbol itself.
        self.pieces = [strings.get(i, "").encode() for i in range(max(strings) + 1)]
        self.decimal = [str(i) for i in range(len(self.pieces))]
        self.known = _Remembered(self.encode_word)
        self.known_chunks = _Remembered(self._encode_chunk)

    def encode_word(self, word: str) -> tuple[int, ...]:
        b = word.encode("utf-8", "surrogatepass")
        inner = self.inner
        symbols = [inner[x] for x in b]
        symbols[-1] = self.last[b[-1]]
        return tuple(self.transducer.word(symbols))

    def _encode_chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of what stands between white space; words never cross it."""
        return tuple(chain.from_iterable(map(self.known.__getitem__, self.words(chunk))))

    def _plain(self, text: str):
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:  # letter by letter, so no rule for the last sigma of a word
            text = (text if text.isascii() else text.replace("Σ", "σ")).lower()
        if _NOT_SPACE.search(text):
            return self._encode_chunk(text)
        return chain.from_iterable(map(self.known_chunks.__getitem__, text.split()))

    def encode(self, text: str):
        """Yields lists of ids; no list is of more than one step of the text."""
        for part in self.special.split(text) if "<|" in text else (text,):
            if part in self.added:
                yield [self.added[part]]
                continue
            at = 0
            while at < len(part):
                end = len(part)
                if end - at > TEXT_STEP and (cut := _CUT.search(part, at + TEXT_STEP)):
                    end = cut.end()
                yield list(self._plain(part[at:end]))
                at = end

    def decode(self, blocks):
        """Yields text of lists of ids: bytes of the pieces, a space between any two, through the UTF-8 machine."""
        machine, first = codecs.getincrementaldecoder("utf-8")("replace"), True
        for ids in blocks:
            for k in range(0, len(ids), ID_STEP):
                piece = b" ".join(map(self.pieces.__getitem__, ids[k:k + ID_STEP]))
                yield machine.decode(piece if first else b" " + piece)
                first = False
        yield machine.decode(b"", True)

    def forget(self) -> None:
        """Drops the words that came before: a worker outlives its task and goes on with other operators."""
        self.known.clear()
        self.known_chunks.clear()


class _Remembered(dict):
    """Ids of words that came before, in this worker."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str):
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        ids = self.encode(word)
        if len(word) <= 40:
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def load(text: str) -> WordBpe:
    """The tables of a tokenizer file's content, built once a worker."""
    return WordBpe(text)


def read_spec(path: str) -> str:
    """Content of a tokenizer file, read on the driver and sent with the tasks (a fixed 1.7 MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) per document."""
    spec, rows = read_spec(path), docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches):
        bpe = load(spec)
        for batch in batches:
            ids = [list(chain.from_iterable(bpe.encode(t or ""))) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) per document: its ids, and the digest of the text that they decode to."""
    spec, rows = read_spec(path), docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches):
        bpe = load(spec)
        for batch in (b.slice(i, BATCH_ROWS) for b in batches for i in range(0, b.num_rows, BATCH_ROWS)):
            ids = [list(chain.from_iterable(bpe.encode(t or ""))) for t in batch.column(1).to_pylist()]
            digests = []
            for x in ids:
                h = hashlib.sha256()
                for part in bpe.decode([x]):
                    h.update(part.encode())
                digests.append(h.hexdigest())
            yield pa.record_batch([batch.column(0), pa.array([len(x) for x in ids], pa.int32()), pa.array(ids, pa.list_(pa.int32())),
                                   pa.array(digests, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded_sha256"])
        bpe.forget()

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens int, ids array<int>, decoded_sha256 string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    spec, rows = read_spec(path), encoded.select("doc_id", "ids")

    def run(batches):
        bpe = load(spec)
        for batch in batches:
            texts = ["".join(bpe.decode([x or []])) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded and decoded block by block, nothing whole is held."""
    spec, rows = read_spec(path), docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def digests(bpe: WordBpe, text: str):
        n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()

        def blocks():
            nonlocal n
            for ids in bpe.encode(text):
                if ids:
                    of_ids.update(((" " if n else "") + " ".join(map(bpe.decimal.__getitem__, ids))).encode())
                    n += len(ids)
                    yield ids

        for part in bpe.decode(blocks()):
            of_text.update(part.encode())
        return n, of_ids.hexdigest(), of_text.hexdigest()

    def run(batches):
        bpe = load(spec)
        for batch in batches:
            n, ids, text = zip(*(digests(bpe, t.as_py() or "") for t in batch.column(1))) if batch.num_rows else ((),) * 3
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                                   pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
