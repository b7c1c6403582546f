"""Plain-Python models of the training-data operators, for small tables. Documents are dicts or (doc_id, text) pairs."""

import collections
import hashlib
import math
import re
import zlib

SPACE = r"[\x20\x09-\x0D]+"


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def digest(rows):
    return sorted(map(repr, rows))


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)"""
    t = text or ""
    w = words(t)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    inside = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    dup = len(lines) - len(set(lines))
    symbols, chars = len(re.findall(r"[#*$%&|<>]", t)), sum(map(len, w))
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    letters = [b for b in t.encode() if b >= 128 or chr(b).isalpha()]
    upper = sum(65 <= b < 91 for b in letters)
    solid = sum(len(x.encode()) for x in w)
    n = max(len(w), 1)
    rejected = (chars > 15 * n or chars < 2 * n or symbols * 10 > n or dup * 10 > 3 * len(lines)
                or upper * 2 > len(letters) or len(letters) * 2 < solid)
    return len(w), chars, symbols, dup, len(inside), failed, not failed and not rejected


def shingle_counts(text):
    w = words(text)
    if 0 < len(w) < 5:
        return collections.Counter([tuple(w)])
    return collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def jaccards(p, q):
    keys = set(p) | set(q)
    if not keys:
        return 0.0, 0.0
    weighted = sum(1 / sum(max(p[j] / p[k], q[j] / q[k]) for j in keys) for k in keys if p[k] and q[k])
    return weighted, len(set(p) & set(q)) / len(keys)


def near_duplicate_classes(rows):
    """Class (smallest id, size) of each (doc_id, text), by comparing all pairs of distinct texts."""
    texts = sorted({t or "" for _, t in rows})
    sets = {t: shingle_counts(t) for t in texts}
    parent = {t: t for t in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if set(sets[a]) & set(sets[b]) and max(jaccards(sets[a], sets[b])) >= 0.8 - 1e-9:
                parent[find(a)] = find(b)
    members = collections.defaultdict(list)
    for i, t in rows:
        members[find(t or "")].append(i)
    return [(i, min((x for x in members[find(t or "")] if x is not None), default=None), len(members[find(t or "")])) for i, t in rows]


def repeats(rows, n=50):
    """Flags of the removed bytes of each (doc_id, text); a null id is larger than any."""
    rank = [math.inf if i is None else i for i, _ in rows]
    first = {}
    for r, (_, t) in zip(rank, rows):
        b = (t or "").encode()
        for s in range(len(b) - n + 1):
            first[b[s:s + n]] = min(r, first.get(b[s:s + n], math.inf))
    out = []
    for r, (_, t) in zip(rank, rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if first[b[s:s + n]] < r:
                gone[s:s + n] = b"\1" * n
        out.append((b, gone))
    return out


def repeat_digest(rows):
    out = []
    for (i, _), (b, gone) in zip(rows, repeats(rows)):
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def hash60(doc_id):
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16)


def mixture(rows):
    """(doc_id, size, source, source_size, target, taken, row position) of (doc_id, text, source) rows."""
    size = [len(words(t)) for _, t, _ in rows]
    of = collections.defaultdict(int)
    for s, (*_, source) in zip(size, rows):
        of[source] += s
    names = sorted((x for x in of if x is not None), key=lambda x: x.encode()) + [None] * (None in of)
    weight = {x: (3.0, 1.0, 2.0)[i % 3] for i, x in enumerate(names)}
    level, closed, total = 0.0, -1, sum(size)
    while True:
        shut = [x for x in names if weight[x] * level > 2.0 * of[x]]
        open_w = sum(weight[x] for x in names if x not in shut)
        if len(shut) == closed or not open_w:
            break
        closed, level = len(shut), (1.5 * total - sum(2.0 * of[x] for x in shut)) / open_w
    out = []
    for x in names:
        target = min(weight[x] * level, 2.0 * of[x])
        u = int(hashlib.md5(("mix:" + ("\0" if x is None else x)).encode()).hexdigest()[:12], 16) / 2 ** 48
        rate = target / of[x] if of[x] else 0.0
        own = sorted((i for i, r in enumerate(rows) if r[2] == x),
                     key=lambda i: (size[i], hash60(rows[i][0]), -1 if rows[i][0] is None else rows[i][0]))
        for k, i in enumerate(own, 1):
            n = math.floor(k * rate + u) - math.floor((k - 1) * rate + u)
            out.append((rows[i][0], size[i], x, of[x], target, n * size[i], i, n))
    return out


def shards(rows, limit):
    """(doc_id, bytes, shard bits, shard bytes, shard docs) by splitting bucket after bucket."""
    items = [(i, len((t or "").encode()), hash60(i)) for i, t in rows]
    out, todo = [], [("", items)]
    while todo:
        bits, own = todo.pop()
        total = sum(b for _, b, _ in own)
        if total <= limit or len({h for *_, h in own}) == 1 or len(bits) == 60:
            out += [(i, b, bits, total, len(own)) for i, b, _ in own]
            continue
        for bit in "01":
            part = [x for x in own if format(x[2], "060b")[len(bits)] == bit]
            if part:
                todo.append((bits + bit, part))
    return out


def fold(doc_id, mod):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def deleted_interpolation(rows, tolerance=1e-6):
    """(doc_id, held_out, n_tokens, n_known, N, base, score) of (doc_id, text) rows with a bigram model."""
    docs = [(i, fold(i, 10), words(lower_ascii(t)) + [None]) for i, t in rows]

    def count(which):
        uni, bi, ctx = collections.Counter(), collections.Counter(), collections.Counter()
        for _, f, w in docs:
            if which(f):
                uni.update(w)
                bi.update(zip(["<begin>", *w], w))
                ctx.update(["<begin>", *w[:-1]])
        return uni, bi, ctx

    full = count(lambda f: f != 0)
    n, v = sum(full[0].values()), len(full[0])
    base = count(lambda f: f not in (0, 1))
    nb = sum(base[0].values())
    lam, before = [0.5, [0.5] * 65], -math.inf

    def prob(c, total, a, b, weights):
        p1 = weights[0] * (c[0][b] / total if total else 0) + (1 - weights[0]) / (v + 1)
        x = c[2][a]
        lam2 = weights[1][x.bit_length()] if x else 0.0
        p2 = lam2 * (c[1][a, b] / x if x else 0) + (1 - lam2) * p1
        return p2, p1, x, lam2

    held = [(a, b) for _, f, w in docs if f == 1 for a, b in zip(["<begin>", *w], w)]
    if nb and held:
        while True:
            g, m, g1, m1, fit = collections.Counter(), collections.Counter(), 0.0, 0.0, 0.0
            for a, b in held:
                p2, p1, x, lam2 = prob(base, nb, a, b, lam)
                fit += math.log10(p2)
                r = lam2 * (base[1][a, b] / x) / p2 if x else 0.0
                if x:
                    g[x.bit_length()] += r
                    m[x.bit_length()] += 1
                g1 += (1 - r) * (lam[0] * base[0][b] / nb / p1)
                m1 += 1 - r
            new = [min(max(g1 / m1, 1e-6), 1 - 1e-6), [min(max(g[k] / m[k], 1e-6), 1 - 1e-6) if m[k] else lam[1][k] for k in range(65)]]
            lam, gain, before = new, fit / len(held) - before, fit / len(held)
            if gain < tolerance:
                break
    elif not nb:
        lam = [0.0, [0.0] * 65]
    out = []
    for i, f, w in docs:
        s = sum(math.log10(prob(full, n, a, b, lam)[0]) for a, b in zip(["<begin>", *w], w))
        b = sum(math.log10((full[0][x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        out.append((i, f == 0, len(w), sum(full[0][x] > 0 for x in w), n, b, s))
    return out
