"""Text features as built-in expressions (SF1-SF3, SF6, SF11-SF14, SF18, SF19).

Whole texts are always processed; no function looks at a prefix.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import IMG_LINK_PATTERN


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Python's ``str.split()`` / ``str.strip()`` whitespace set, built by rule so the
# JVM regex agrees with the study's Python on every code point it can meet.
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
WS_CLASS = "[" + PY_WHITESPACE + "]"


def _blank(t: Column) -> Column:
    return F.coalesce(t, F.lit(""))


def has_image_or_link(text, pattern: str = IMG_LINK_PATTERN) -> Column:
    return _blank(_c(text)).rlike(pattern)


def count_image_or_links(text, pattern: str = IMG_LINK_PATTERN) -> Column:
    return F.size(F.regexp_extract_all(_blank(_c(text)), F.lit(pattern), 0))


def internal_link_ids(text, pattern: str) -> Column:
    """Array of linked ids (group 1 of ``pattern``) in order of appearance."""
    return F.transform(F.regexp_extract_all(_blank(_c(text)), F.lit(pattern), 1),
                       lambda x: x.cast("bigint"))


def tokens(text) -> Column:
    """Whitespace tokens as ``str.split()`` gives them (no empty strings)."""
    return F.filter(F.split(_blank(_c(text)), WS_CLASS + "+"), lambda x: x != "")


def word_count(text) -> Column:
    return F.size(tokens(text))


def is_blank(text) -> Column:
    return _blank(_c(text)).rlike("^" + WS_CLASS + "*$")


def is_link_post(url) -> Column:
    u = _c(url)
    return u.isNotNull() & (u != "")


def link_only(url, text) -> Column:
    return is_link_post(url) & is_blank(text)


def sha256_hex(text) -> Column:
    return F.sha2(_c(text), 256)


# FIXED VALUE: RFC 4122 DNS namespace for name-based ids.
NAMESPACE_DNS_HEX = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5_dns(text) -> Column:
    """Name-based UUID (version 5, DNS namespace) from built-ins: sha1 + bit patch."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_DNS_HEX)), F.encode(_c(text), "UTF-8")))
    variant = F.lower(F.conv(
        (F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8).cast("string"),
        10, 16))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4),
                       F.concat(F.lit("5"), F.substring(h, 14, 3)),
                       F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


@F.pandas_udf(T.StringType())
def sanitize(s):
    """NFKD, drop combining marks, keep ``[A-Za-z0-9_]`` (Arrow-batched; NFKD has no built-in)."""
    return s.str.normalize("NFKD").str.replace(r"[^A-Za-z0-9_]", "", regex=True)


# Pluggable tokenizer for chunking: words and single punctuation marks.
DEFAULT_TOKEN_PATTERN = r"\w+|[^\w\s]"


def token_array(text, pattern: str = DEFAULT_TOKEN_PATTERN) -> Column:
    return F.regexp_extract_all(_blank(_c(text)), F.lit(pattern), 0)


def chunk_tokens(token_arr, max_tokens: int) -> Column:
    """Array of token-array chunks of at most ``max_tokens``; an empty text gives one empty chunk."""
    t = _c(token_arr)
    n_chunks = F.greatest(F.lit(1), F.ceil(F.size(t) / F.lit(float(max_tokens))).cast("int"))
    return F.transform(F.sequence(F.lit(0), n_chunks - 1),
                       lambda i: F.slice(t, i * max_tokens + 1, max_tokens))


def quality_flags(num_words, num_img_or_links, is_link, hi_words: int = 50) -> dict[str, Column]:
    """SF18 boolean columns: has_img_or_links, no/lo/hi_words and hi_quality."""
    nw, ni, il = _c(num_words), _c(num_img_or_links), _c(is_link)
    has_img = ni > 0
    hi = nw > hi_words
    return {
        "has_img_or_links": has_img,
        "no_words": nw == 0,
        "lo_words": (nw > 0) & (nw <= hi_words),
        "hi_words": hi,
        "hi_quality": (hi & ~il) | (il & hi & has_img),
    }


def post_type(num_words, num_img_or_links, median_words) -> Column:
    """SF19: 0 link/empty, 1-2 at or below the median (without/with links), 3-4 above."""
    nw, ni, m = _c(num_words), _c(num_img_or_links), _c(median_words)
    return (F.when((nw > 0) & (nw <= m) & (ni == 0), 1)
            .when((nw > 0) & (nw <= m) & (ni > 0), 2)
            .when((nw > 0) & (nw > m) & (ni == 0), 3)
            .when((nw > 0) & (nw > m) & (ni > 0), 4)
            .otherwise(0))
