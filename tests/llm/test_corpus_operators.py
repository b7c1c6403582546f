"""Operators over the whole corpus: counts, duplicates, repeats, shards, mixtures, search."""

import math
import random
from collections import Counter

import llm_brute as brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import lm, mixing, neardup, sharding, suffixes, topk
from tallyspark.llm.shared import pack, unpack
from tallyspark.llm.textblocks import text_buffer


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def test_packed_numbers_round_trip():
    rng = np.random.default_rng(0)
    for x in (np.zeros(0, np.uint64), np.array([2 ** 64 - 1, 0], np.uint64), rng.integers(0, 2 ** 63, 1000, dtype=np.uint64)):
        assert (unpack(pack(x)) == x).all()
        assert (unpack(pack(np.sort(x), True), True) == np.sort(x)).all()


# ---- operator 3 --------------------------------------------------------------------------------------------------

def test_scores_match_a_model_in_python(odd, odd_rows, clashing, monkeypatch):
    want = sorted(brute.deleted_interpolation(pairs(odd_rows)), key=repr)
    for docs, block, keys in ((odd, lm.BLOCK_BYTES, lm.RANGE_KEYS), (clashing, 20_000, 3_000)):
        monkeypatch.setattr(lm, "BLOCK_BYTES", block)
        monkeypatch.setattr(lm, "RANGE_KEYS", keys)
        got = rows_of(lm.score(docs))
        for g, w in zip(got, want, strict=True):
            assert g[:5] == w[:5]
            assert math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-6)


def test_higher_orders_run_and_help(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["a b c d", "e f g h", "a f c h"][rng.randrange(3)] for _ in range(30))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    two, three = (lm.score(docs, order=k).where("held_out").agg(F.sum("score")).first()[0] for k in (2, 3))
    assert two < three < 0


def test_no_training_text(spark, none):
    assert lm.score(none).count() == 0
    one = next(i for i in range(1000) if brute.fold(i, 10) == 0)
    r = lm.score(spark.createDataFrame([(one, "x y")], "doc_id long, text string")).first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) == (True, 3, 0, 0, 0.0)


# ---- operator 4 --------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("letters,n", [(1, 300), (2, 2000), (3, 5000), (26, 4000)])
def test_suffixes_are_in_order(letters, n):
    t = np.random.default_rng(n).integers(97, 97 + letters, n).astype(np.uint8)
    t[n // 2:n // 2 + n // 4] = t[:n // 4]
    sa, b = suffixes.suffix_order(t), t.tobytes()
    assert sorted(sa) == list(range(n))
    assert all(b[i:i + suffixes.DEPTH] <= b[j:j + suffixes.DEPTH] for i, j in zip(sa, sa[1:]))


def test_repeats_match_python(odd, odd_rows, clashing):
    want = sorted(brute.repeat_digest(pairs(odd_rows)), key=repr)
    assert rows_of(suffixes.digests(odd)) == want
    assert rows_of(suffixes.digests(clashing)) == want


@pytest.mark.parametrize("shared", [1, 64])
def test_repeats_over_many_blocks_and_ranges(spark, monkeypatch, shared):
    """Phrases with many continuations, runs of one letter, copies: in several blocks, ranges and arrays."""
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 4_000)
    monkeypatch.setattr(suffixes, "RANGE_ITEMS", 200)
    monkeypatch.setattr(suffixes, "SHARED", shared)
    monkeypatch.setattr(suffixes, "ARRAY_BYTES", 500)
    rng = random.Random(3)
    phrase = "".join(rng.choices("abcdefgh ", k=90))
    rows = []
    for i in range(120):
        t = "".join(rng.choices("abcdefgh ", k=rng.randint(0, 80)))
        rows.append((i, t + phrase[:rng.randint(20, 90)] + "".join(rng.choices("xyz", k=rng.randint(0, 60))) + "é" * rng.randint(0, 40)))
    rows += [(200 + i, "ab" * 60) for i in range(4)] + [(300, "z" * 400), (301, "z" * 49), (302, "z" * 50), (None, phrase)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(suffixes.digests(docs)) == sorted(brute.repeat_digest(rows), key=repr)


def test_cut_documents_keep_their_columns(odd, odd_rows, clashing):
    want = []
    for r, (b, gone) in zip(odd_rows, brute.repeats(pairs(odd_rows))):
        text = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore") if any(gone) else r[1]
        want.append((r[0], text, *r[2:]))
    assert rows_of(suffixes.cut_documents(odd)) == sorted(want, key=repr)
    got = suffixes.cut_documents(clashing)
    assert got.columns == clashing.columns
    assert rows_of(got.select("doc_id", "text", "lang", "source", "n_chars")) == sorted(want, key=repr)


# ---- operator 5 --------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("limit", [500, 3_000, 50_000, 10_000_000])
def test_shards_match_python(odd, odd_rows, clashing, limit):
    want = sorted(brute.shards(pairs(odd_rows), limit), key=repr)
    for docs in (odd, clashing):
        got = sharding.shard(docs, limit)
        assert rows_of(got.select("doc_id", "n_bytes", "shard", "shard_bytes", "shard_docs")) == want
        assert got.where(F.col("over_limit") != (F.col("shard_bytes") > limit)).count() == 0


def test_shards_are_written(odd, odd_rows, tmp_path):
    sharding.write_shards(odd, sharding.shard(odd, 3_000), str(tmp_path / "out"))
    back = odd.sparkSession.read.parquet(str(tmp_path / "out"))
    assert rows_of(back.select("doc_id", "text", "lang", "source", "n_chars")) == sorted(odd_rows, key=repr)


# ---- operator 7 --------------------------------------------------------------------------------------------------

def top_brute(rows, k, is_query):
    def fine(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and fine(v)]
    out = []
    for i, q in whole:
        if is_query(i):
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])]
    return sorted(out)


def test_top_k_matches_python(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "GROUP_ROWS", 4)
    rng = random.Random(2)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(8)]) for i in range(300)]
    rows += [(400, None), (401, [None] * 8), (402, [math.nan] * 8), (403, [math.inf] * 8), (404, [1.0] * 3), (405, [1.0] * 3),
             (450, [0.5] * 8), (450, [0.5] * 8), (None, [9.0] * 8), (500, []), (406, [0.5] * 8), (407, [0.5] * 8), (550, [1000.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit("x")).withColumn("grp", F.lit(1))
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == top_brute(rows, 5, lambda i: i % 50 == 0)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bit_lengths_are_exact():
    x = np.array([0, 1, -1, 2, 3, 4, -7, 8, 255, 256, 2 ** 53 - 1, 2 ** 53, 2 ** 60 - 1, -(2 ** 62) + 1])
    assert topk.bit_lengths(x).tolist() == [int(v).bit_length() for v in np.abs(x)]


@pytest.mark.parametrize("seed", range(3))
def test_search_stops_on_proof_on_ordinary_vectors(seed):
    """Normal vectors: the k best are exact, and the proof comes before all postings are read."""
    rng = np.random.default_rng(seed)
    x = np.floor(256 * rng.standard_normal((3000, 48)) / 7).astype(np.int16)
    x[5], x[7] = x[6], x[6]  # ties
    ids, pick = rng.permutation(3000), np.arange(0, 3000, 40)
    q = x[pick].astype(np.int64)
    row, at, score, share = topk.search(ids[pick], q, ids, topk.Segments(x), 5)
    full = q @ x.astype(np.int64).T
    full[np.arange(len(pick)), pick] = np.iinfo(np.int64).min
    for i in range(len(pick)):
        want = sorted(range(3000), key=lambda j: (-int(full[i, j]), ids[j]))[:5]
        assert at[row == i].tolist() == want and (score[row == i] == full[i, want]).all()
    assert 0.3 < share < 0.95


def test_search_stops_early_where_few_stand_out():
    x = np.random.default_rng(0).integers(-20, 20, (500, 16))
    x[:5] += 4000
    row, at, score, share = topk.search(np.array([-1]), np.full((1, 16), 50), np.arange(500), topk.Segments(x), 5)
    assert sorted(at) == [0, 1, 2, 3, 4] and share < 0.1
    assert (score == (x[at] * 50).sum(1)).all()


# ---- operator 9 --------------------------------------------------------------------------------------------------

def test_mixture_matches_python(odd, odd_rows, clashing, monkeypatch):
    want = sorted((r[:6] for r in brute.mixture([(i, t, s) for i, t, _, s, _ in odd_rows])), key=repr)
    columns = ["doc_id", "size", "source", "source_size", "target", "taken"]
    assert rows_of(mixing.mix(odd).select(*columns)) == want
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)  # several buckets a stratum
    assert rows_of(mixing.mix(clashing).select(*columns)) == want


def test_mixture_is_near_its_targets(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 200), "s0" if i % 3 else f"s{i % 7}") for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("m")).collect():
        assert abs(r["taken"] - r["target"]) <= 2 * r["m"]
    assert got.where("taken > 2 * size").count() == 0


def test_mixed_documents(odd, odd_rows, clashing):
    got = mixing.mixed_documents(odd)
    n = {x[6]: x[7] for x in brute.mixture([(i, t, s) for i, t, _, s, _ in odd_rows])}
    assert rows_of(got) == sorted((r for k, r in enumerate(odd_rows) for _ in range(n[k])), key=repr)
    assert mixing.mixed_documents(clashing).columns == clashing.columns


# ---- operator 10 -------------------------------------------------------------------------------------------------

def test_signatures_estimate_the_probability_jaccard():
    rng = random.Random(0)
    a = [" ".join(rng.choices("abcdefgh", k=300)) for _ in range(40)]
    b = []
    for t in a:
        w = t.split()
        for _ in range(rng.randrange(40)):
            w[rng.randrange(len(w))] = "z"
        b.append(" ".join(w))
    x, y = (neardup.shingles(*text_buffer(pa.array(t))) for t in (a, b))
    weighted, plain = neardup.similarity(x, y, 40)
    want = [brute.jaccards(brute.shingle_counts(p), brute.shingle_counts(q)) for p, q in zip(a, b)]
    assert np.allclose(weighted, [w for w, _ in want]) and np.allclose(plain, [p for _, p in want])
    slots = [neardup.signatures(*s, 40, m=2000) for s in (x, y)]
    assert abs((slots[0] == slots[1]).mean(1) - weighted).max() < 0.05


def test_classes_match_all_pairs(odd, odd_rows, clashing):
    want = sorted(brute.near_duplicate_classes(pairs(odd_rows)), key=repr)
    assert rows_of(neardup.classes(odd).select("doc_id", "class_id", "class_size")) == want
    assert rows_of(neardup.classes(clashing).select("doc_id", "class_id", "class_size")) == want


def test_chains_and_stars(spark):
    """Copies near a common original but not near each other, and a chain: one class each, whichever pivots are met."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, n = [], 0
    for _ in range(3):
        base = rng.choices(vocabulary, k=200)
        for _ in range(25):  # each with 2 or 3 words of its own: near the original, often not near each other
            w = base[:]
            for _ in range(rng.randint(2, 3)):
                w[rng.randrange(200)] = rng.choice(vocabulary)
            rows.append((n := n + 1, " ".join(w)))
        rows.append((n := n + 1, " ".join(base)))
        w = rng.choices(vocabulary, k=200)
        for _ in range(12):
            rows.append((n := n + 1, " ".join(w)))
            w = w[4:] + rng.choices(vocabulary, k=4)
    rows += [(n + i + 1, " ".join(rng.choices(vocabulary, k=150))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(neardup.classes(docs).select("doc_id", "class_id", "class_size"))
    assert got == sorted(brute.near_duplicate_classes(rows), key=repr)


def test_one_text_repeats_a_passage(spark):
    """Plain Jaccard about 0.97, probability Jaccard about 0.5: linked, though the counts share hardly a slot."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows = []
    for k in range(8):
        w = rng.choices(vocabulary, k=600)
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w + w[-10:] * 50))]
    counts = [brute.shingle_counts(t) for _, t in rows]
    for a, b in zip(counts[::2], counts[1::2]):
        weighted, plain = brute.jaccards(a, b)
        assert weighted < 0.7 and plain > 0.95
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute.near_duplicate_classes(rows), key=repr)
    assert sorted({(c, n) for _, c, n in want}) == [(2 * k, 2) for k in range(8)]
    assert rows_of(neardup.classes(docs).select("doc_id", "class_id", "class_size")) == want
    assert neardup.one_of_each(docs).count() == 8


def test_one_of_each(odd, odd_rows, clashing):
    got = rows_of(neardup.one_of_each(odd))
    classes = brute.near_duplicate_classes(pairs(odd_rows))
    known = {c for _, c, _ in classes if c is not None}
    assert sorted(r[0] for r in got if r[0] is not None) == sorted(known)
    assert sum(r[0] is None for r in got) == sum(c is None for _, c, _ in classes)
    assert set(got) <= set(odd_rows)
    assert neardup.one_of_each(clashing).columns == clashing.columns


def test_empty_and_null_tables(spark, none):
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3, none.schema)
    for docs, n in ((none, 0), (nulls, 3)):
        assert suffixes.digests(docs).count() == n
        assert suffixes.cut_documents(docs).count() == n
        assert sharding.shard(docs, 100).count() == n
        assert mixing.mix(docs).count() == n
        assert mixing.mixed_documents(docs).count() == 0
        assert neardup.classes(docs).count() == n
        assert neardup.one_of_each(docs).count() == min(n, 1)
        assert lm.score(docs).count() == n


def test_near_duplicates_of_many_repeated_rows(spark):
    """Two near texts of 400 equal rows each are one pair to verify, not 160,000."""
    rng = random.Random(31)
    words = [f"w{i}" for i in range(300)]
    a = rng.choices(words, k=120)
    b = a[:60] + ["x"] + a[61:]
    rows = [(1, " ".join(a))] * 400 + [(2, " ".join(b))] * 400 + [(None, " ".join(b))] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    nodes = df.groupBy(neardup._digest(F.col("text")).alias("node")).agg(F.min("doc_id").alias("first_id"))
    assert neardup._texts(nodes.select("node"), nodes, df, "doc_id", "text").count() == 2
    got = neardup.classes(df).select("doc_id", "class_id", "class_size").distinct().collect()
    assert {(r[0], r[1], r[2]) for r in got} == {(1, 1, 830), (2, 1, 830), (None, 1, 830)}


def test_near_duplicates_in_a_group_of_mixed_similarity(spark):
    """Copies of one text with few to many changed words, of which some repeat changes of others."""
    rng = random.Random(37)
    words = [f"w{i}" for i in range(500)]
    base, rows = rng.choices(words, k=150), []
    for i in range(130):
        t = list(base) if i % 3 or not rows else rows[rng.randrange(len(rows))][1].split()
        for _ in range(rng.choice([0, 1, 2, 4, 6, 9, 14])):
            t[rng.randrange(len(t))] = rng.choice(words)
        t = t[:len(t) - rng.choice([0, 0, 0, 10, 25])] + (t[:30] if rng.random() < 0.1 else [])
        rows.append((i, " ".join(t)))
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: c for i, c, _ in brute.near_duplicate_classes(rows)}


def test_texts_that_may_not_meet_are_below_the_threshold(spark):
    """The bound that closes texts holds for every pair of random weighted sets, pairwise and against a bucket's extremes."""
    rng = random.Random(41)
    sets = []
    for i in range(60):
        base = sets[rng.randrange(len(sets))] if sets and rng.random() < 0.8 else {f"k{i}_{j}": 1 for j in range(rng.randint(10, 30))}
        t = {k: c for k, c in base.items() if rng.random() > rng.choice([0.0, 0.05, 0.15, 0.3])}
        t |= {f"n{i}_{j}": 1 for j in range(rng.choice([0, 1, 2, 5]))}
        sets.append({k: rng.choice([c, c, c, c + 1]) if rng.random() < 0.2 else c for k, c in t.items()} or {"x": 1})
    grams = spark.createDataFrame([(i, hash(k), c, len(t), sum(t.values())) for i, t in enumerate(sets) for k, c in t.items()],
                                  "node long, key long, w long, n long, w_all long")
    reach = neardup._reach(grams).collect()
    names = list(neardup._REACH)
    rows = {r["node"]: {c: r[c] for c in names} for r in reach}
    ends = {"n": min(r["n"] for r in rows.values()), "s": max(r["s"] for r in rows.values()), "w": max(r["w"] for r in rows.values()),
            "u": min(r["u"] for r in rows.values()), "again": True}
    pairs = [(i, j) for i in range(60) for j in range(i)]
    df = spark.createDataFrame([(i, j, *[rows[i][c] for c in names], *[rows[j][c] for c in names], *[ends[c] for c in names]) for i, j in pairs],
                               ["i", "j", *["x_" + c for c in names], *["y_" + c for c in names], *["b_" + c for c in names]])
    side = lambda p: {c: F.col(p + c) for c in names}
    got = df.select("i", "j", neardup._may_meet(side("x_"), side("y_"), 0.8).alias("pair"), neardup._may_meet(side("x_"), side("b_"), 0.8).alias("bucket")).collect()
    links = 0
    for r in got:
        if max(brute.jaccards(Counter(sets[r["i"]]), Counter(sets[r["j"]]))) >= 0.8:
            links += 1
            assert r["pair"] and r["bucket"]
    assert links > 20 and sum(not r["pair"] for r in got) > 500


def test_pairs_are_formed_only_where_enough_shingles_can_be_shared(spark):
    """The bound by hash bins never rejects a pair at the threshold, and rejects nearly all others of a group of near copies."""
    rng = random.Random(43)
    base, sets = [rng.getrandbits(64) for _ in range(50)], []
    for i in range(50):
        keys = [k for k in base if rng.random() > rng.choice([0.02, 0.1, 0.2])] + [rng.getrandbits(64) for _ in range(rng.choice([0, 1, 6]))]
        sets.append({k: rng.choice([2, 5]) if i % 4 == 0 and rng.random() < 0.1 else 1 for k in keys})
    row = np.repeat(np.arange(50), [len(t) for t in sets])
    planes, rest = neardup.bin_planes(row, np.array([k for t in sets for k in t], np.uint64), 50)
    side = [(p.tolist(), int(r), len(t), sum(t.values()), sum(t.values()) > len(t)) for p, r, t in zip(planes, rest, sets)]
    names = ["bins", "rest", "n", "w", "again"]
    schema = "i int, j int, " + ", ".join(f"{e}_bins array<long>, {e}_rest long, {e}_n long, {e}_w long, {e}_again boolean" for e in "xy")
    df = spark.createDataFrame([(i, j, *side[i], *side[j]) for i in range(50) for j in range(i)], schema)
    x, y = ({c: F.col(f"{e}_{c}") for c in names} for e in "xy")
    got = df.select("i", "j", neardup._share_enough(x, y, 0.8, x["bins"], y["bins"]).alias("formed")).collect()
    links = [max(brute.jaccards(Counter(sets[r["i"]]), Counter(sets[r["j"]]))) >= 0.8 for r in got]
    assert all(r["formed"] for r, linked in zip(got, links) if linked)
    plain = [r["formed"] for r, linked in zip(got, links) if not linked and r["i"] % 4 and r["j"] % 4]
    assert sum(links) > 50 and len(plain) > 200 and sum(plain) < len(plain) / 4


def test_written_jobs_hold_small_arrow_batches(spark):
    """A task of a written job gets its rows in batches of the size asked for, and the session's own setting stays."""
    from tallyspark.llm.shared import written
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    sizes = spark.range(5000, numPartitions=1).mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows])], ["n"]) for b in batches), "n long")
    assert written(sizes, "sizes", 1000).agg(F.max("n"), F.sum("n")).first() == (1000, 5000)
    assert spark.conf.get(name) == before


def test_a_worker_forgets_words_when_its_tokens_are_made():
    import public_tokenizers
    from tallyspark.llm import bpe
    spec = bpe.read_spec(public_tokenizers.path("word_bpe_49k.json"))
    made = bpe.load(spec)
    ids = [list(x) for x in made.encode("some words and some words")]
    assert made.known_chunks and ids
    made.forget()
    assert not made.known and not made.known_chunks
    assert [list(x) for x in made.encode("some words and some words")] == ids
