"""Encoders, coders, quality rules, language identification: brute force, the tokenizers library, exact round trips."""

import hashlib
import random
import re
import zlib

import llm_brute as brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspark.llm import bpe, idfiles, langid, quality
from tallyspark.llm.textblocks import span_hashes, text_buffer, word_spans

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- words -------------------------------------------------------------------------------------------------------

def test_words_and_hashes_match_python():
    texts = ["", " a  b\n", "x y z", None, "é" * 40, "\x0b\x0c", "one two one"]
    buf, offs = text_buffer(pa.array(texts))
    start, end, row = word_spans(buf, offs)
    got = [(r, bytes(buf[s:e]).decode()) for s, e, r in zip(start, end, row)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in brute.words(t)]
    h = dict(zip(got, span_hashes(buf, start, end)))
    assert h[6, "one"] == span_hashes(*(np.frombuffer(b"one", np.uint8), np.array([0]), np.array([3])))[0]
    assert len(set(h.values())) == len({w for _, w in got})
    folded = span_hashes(np.frombuffer(b"OnE", np.uint8), np.array([0]), np.array([3]), fold=True)
    assert folded[0] == h[6, "one"]


def test_span_hashes_of_long_spans():
    b = np.frombuffer((b"ab" * 400_000) + b" " + (b"ab" * 400_000), np.uint8)
    h = span_hashes(b, np.array([0, 800_001]), np.array([800_000, 1_600_001]))
    assert h[0] == h[1]


# ---- operator 1 --------------------------------------------------------------------------------------------------

def word_digest(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_matches_the_library(odd, odd_rows, clashing):
    t = Tokenizer.from_file(WORD)
    want = sorted(((i, *word_digest(t, x)) for i, x, *_ in odd_rows), key=repr)
    assert rows_of(bpe.round_trip(odd, WORD)) == want
    assert rows_of(bpe.round_trip(clashing, WORD)) == want


def test_bpe_of_any_text_matches_the_library():
    t, own = Tokenizer.from_file(WORD), bpe.load(bpe.read_spec(WORD))
    rng = random.Random(5)
    bits = ["a", "B", "Σ", "İ", "\x1c", "\x85", "​", " ", "́", "e", "\U0001f600", "5", "٣", "_", "'s", "'LL", "<|endoftext|>",
            "<|", "Å", " ", "ß", "ﬁ", "中", "\n", "the", "ing"]
    for x in ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(1500)]:
        assert [i for part in own.encode(x) for i in part] == t.encode(x, add_special_tokens=False).ids, ascii(x)


def test_lookahead_suffices_for_long_words():
    """A word far longer than the window comes out as if it were merged whole, whatever the cuts."""
    own = bpe.load(bpe.read_spec(WORD))
    tr, rng = own.transducer, random.Random(2)
    assert tr.lookahead and tr.window < 10_000
    for _ in range(4):
        word = "".join(rng.choices(["a", "aa", "th", "e", "in", "ing", "sh", "é"], k=4000)).encode()
        symbols = [own.inner[b] for b in word[:-1]] + [own.last[word[-1]]]
        assert tr.word(symbols[:]) == tr.merged(symbols[:])
    # The bound itself: text beyond the lookahead never changes what came before it.
    small = bpe.Transducer(tr.ranks, tr.products, tr.length, tr.lookahead)
    symbols = [own.inner[b] for b in ("tion" * 700).encode()]
    whole, part = small.merged(symbols[:]), small.merged(symbols[:2000])
    ends = lambda ids: set(np.cumsum([tr.length[i] for i in ids]))
    settled = 2000 - tr.lookahead
    assert {e for e in ends(whole) if e <= settled} == {e for e in ends(part) if e <= settled}


def test_lookahead_of_a_small_merge_list():
    # Symbols 0..2, rules 01 -> 3, 12 -> 4, 32 -> 5: the end of "0 1" waits for a "2" after it.
    length = {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 3}
    assert bpe.merge_lookahead([(0, 1, 3), (1, 2, 4), (3, 2, 5)], length) >= 1
    assert bpe.merge_lookahead([(3, 2, 5), (0, 1, 3)], length) is None


def test_encode_then_decode(odd, odd_rows):
    t = Tokenizer.from_file(WORD)
    got = rows_of(bpe.decode(bpe.encode(odd, WORD), WORD))
    want = [(i, t.decode(t.encode(x or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, x, *_ in odd_rows]
    assert got == sorted(want, key=repr)


def test_utf8_machine_over_blocks():
    own = bpe.load(bpe.read_spec(WORD))
    ids = [i for part in own.encode("größe " * 50) for i in part]
    assert "".join(own.decode([ids])) == "".join(own.decode([ids[i:i + 1] for i in range(len(ids))]))


# ---- operator 2 --------------------------------------------------------------------------------------------------

def test_files_hold_the_library_ids(odd, odd_rows, clashing):
    t = Tokenizer.from_file(BYTE)
    for docs in (odd, clashing):
        got = idfiles.read_files(idfiles.write_files(docs, BYTE, file_bytes=60_000)).collect()
        ids = {id(r): t.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in odd_rows}
        crc = {k: zlib.crc32(np.array(v, "<u4").tobytes()) for k, v in ids.items()}
        assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in got) == \
            sorted((r[0] or -1, len(ids[id(r)]), crc[id(r)]) for r in odd_rows)
        at = 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
        known = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
        assert known == sorted(known, key=lambda x: (x is not None, x or 0))


def test_pieces_match_the_library_on_any_white_space():
    t, own = Tokenizer.from_file(BYTE), idfiles.Pieces(bpe.read_spec(BYTE))
    rng = random.Random(3)
    bits = ["a", "b", " ", "  ", "\n", " \n", "\t", "'s", "12", "!", "é", " ", "\x1c", "<|endoftext|>", "\x85", "Z"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(4000)]
    assert [np.frombuffer(x, np.uint16).tolist() for x in own.encode(texts)] == \
        [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("n", [1, 2, 4095, 4096, 4097, 20_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50257, n), np.zeros(n, int), np.arange(n) % 7, rng.zipf(1.3, n) % 50257, np.full(n, 50256)):
        ids = ids.astype(np.uint16)
        image = idfiles.file_image(np.array([3]), np.array([n]), ids, 50257)
        assert (idfiles.read_image(image)[2] == ids).all()
    assert len(idfiles.file_image(np.array([3]), np.array([n]), np.zeros(n, np.uint16), 50257)) < 200 + n / 2


def test_damage_is_found():
    ids = np.random.default_rng(1).integers(0, 500, 9000).astype(np.uint16)
    image = bytearray(idfiles.file_image(np.array([3, 5]), np.array([4000, 5000]), ids, 50257))
    image[-5000] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        idfiles.read_image(bytes(image))


# ---- operator 6 --------------------------------------------------------------------------------------------------

def test_quality_matches_python(odd, odd_rows, clashing):
    want = sorted(((i, *brute.quality(t)) for i, t, *_ in odd_rows), key=repr)
    assert rows_of(quality.measures(odd)) == want
    assert rows_of(quality.measures(clashing)) == want


def test_kept_documents(odd, odd_rows, clashing):
    want = sorted((r for r in odd_rows if brute.quality(r[1])[-1]), key=repr)
    assert rows_of(quality.kept_documents(odd)) == want
    assert quality.kept_documents(clashing).columns == clashing.columns
    assert quality.kept_documents(clashing).count() == len(want)


def test_order_changes_cost_only():
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["a", "bb", "CCC", "###", "it", "was", "x|y"], k=rng.randint(0, 90))) for _ in range(300)]
    buf, offs = text_buffer(pa.array(texts))
    rules, want = list(quality.BASE_RULES + quality.RULES), [brute.quality(t)[-1] for t in texts]
    for _ in range(5):
        rng.shuffle(rules)
        assert quality.passes(buf, offs, rules).tolist() == want


def test_cheap_rejecting_rules_run_first(spark):
    docs = spark.createDataFrame([(i, "a b " * 40) for i in range(50)], "doc_id long, text string")

    def slow(buf, offs):
        for _ in range(200):
            np.sort(buf)
        return np.zeros(len(offs) - 1, bool)

    def all_go(buf, offs):
        return np.ones(len(offs) - 1, bool)

    rules = (quality.Rule("slow", slow), quality.Rule("all_go", all_go))
    assert quality.rule_order(docs, rules, "doc_id", "text") == ["all_go", "slow"]


# ---- operator 8 --------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def two_languages(spark):
    rng = random.Random(9)
    syllables = {"aa": ["ka", "to", "mi", "ra", "no"], "bb": ["schl", "eit", "ung", "ver", "ö"]}
    rows = []
    for i in range(300):
        lang = "aa" if i % 2 else "bb"
        w = ["".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(w), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_are_told_apart(two_languages):
    held = two_languages.where("doc_id % 4 = 2 OR doc_id % 4 = 1")
    model = langid.train(two_languages.where("doc_id % 4 <> 2 AND doc_id % 4 <> 1"))
    got = langid.predict(held, model, keep=("lang",)).collect()
    assert all(r["lang_pred"] == r["lang"] and 0.5 < r["score"] <= 1 for r in got)
    other = held.sparkSession.createDataFrame([(1, "zzxq wwpf yyjj zqzq xxww")], "doc_id long, text string")
    assert langid.predict(other, model).first()["rejected"]


def test_probabilities_sum_to_one(two_languages):
    """Interpolated Kneser-Ney of a seen context: all symbols and the share of unseen ones add up to one."""
    model = langid.train(two_languages)
    lang, context = model.langs.index("aa"), "k"
    letters = "abcdefghijklmnopqrstuvwxyzöé"

    def p(after):  # probability of the last symbol, by the difference of two scores
        long, _ = model.score_words(context + after + "\n", 1)
        return long[0, lang]

    whole = sum(10 ** (p(c) - _closing(model, context + c, lang) - _opening(model, context, lang)) for c in letters)
    assert 0.5 < whole < 1.0001


def _symbols(model, word):
    sym, owner = langid.framed(word + "\n", 1)
    return sym


def _closing(model, word, lang):
    return _suffix_sum(model, word, lang, 1)


def _opening(model, word, lang):
    return _suffix_sum(model, word, lang, 0)


def _suffix_sum(model, word, lang, part):
    """log10 p of the closing mark after ``word`` (part 1), or of the letters of ``word`` (part 0)."""
    import types
    probe = types.SimpleNamespace(**vars(model))
    sym, owner = langid.framed(word + "\n", 1)
    marks = np.where(np.arange(len(sym)) == len(sym) - 1, 1, 0)
    saved = langid.framed
    try:
        langid.framed = lambda text, n: (sym, marks)
        sums, _ = langid.Model.score_words(probe, word + "\n", 2)
    finally:
        langid.framed = saved
    return sums[part, lang]


def test_language_of_odd_texts(odd, odd_rows, none, clashing):
    model = langid.train(odd)
    got = langid.predict(odd, model).collect()
    assert len(got) == len(odd_rows)
    letters = {t for _, t, *_ in odd_rows if t and re.search(r"[^\W\d_]", t)}
    want = sorted((r[0], r[1] in letters) for r in odd_rows if r[0] is not None)
    assert sorted((r["doc_id"], r["lang_pred"] != "und") for r in got if r["doc_id"] is not None) == want
    assert all(r["score"] == 0 and r["rejected"] for r in got if r["lang_pred"] == "und")
    assert langid.predict(clashing, langid.train(clashing)).count() == len(odd_rows)
    untrained = langid.train(none)
    assert {r["lang_pred"] for r in langid.predict(odd, untrained).collect()} == {"und"}


# ---- empty tables ------------------------------------------------------------------------------------------------

def test_empty_tables(none):
    assert bpe.round_trip(none, WORD).count() == 0
    assert idfiles.read_files(idfiles.write_files(none, BYTE)).count() == 0
    assert quality.measures(none).count() == 0
    assert quality.kept_documents(none).count() == 0
    assert langid.predict(none, langid.train(none)).count() == 0
    assert bpe.decode(bpe.encode(none, WORD), WORD).count() == 0


def test_all_nulls(spark):
    docs = spark.createDataFrame([(None, None, None, None, None)] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    assert [tuple(r)[:2] for r in bpe.round_trip(docs, WORD).collect()] == [(None, 0)] * 3
    assert sorted(r["start"] for r in idfiles.read_files(idfiles.write_files(docs, BYTE)).collect()) == [0, 1, 2]
    assert quality.measures(docs).where(~F.col("kept")).count() == 3
    assert langid.predict(docs, langid.train(docs)).where("lang_pred = 'und'").count() == 3
