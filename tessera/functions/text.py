"""Column expressions for text: word pieces, shingles, whitespace words, strip.

All are JVM-side expressions (whole-stage codegen / interpreted higher-order
functions); no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's ``\W`` under UNICODE: anything but a letter, a digit or ``_``.
# Java's ``\W`` is ASCII-only, so the class is spelled out.
NON_WORD = r"[^\p{L}\p{N}_]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def word_pieces(col) -> Column:
    """Lower-case, split on every single non-word char; empty pieces kept (-1)."""
    return F.split(F.lower(_c(col)), NON_WORD, -1)


def spaced_pieces(col) -> Column:
    """The pieces of ``word_pieces`` as one string, a blank between two."""
    return F.regexp_replace(F.lower(_c(col)), NON_WORD, " ")


def n_word_pieces(col) -> Column:
    return F.size(word_pieces(col))


def strip(col) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace."""
    return F.regexp_replace(F.regexp_replace(_c(col), r"^\s+", ""), r"\s+$", "")


def whitespace_words(col) -> Column:
    """Number of items of Python ``str.split()``; the empty string has 0."""
    t = F.trim(F.regexp_replace(_c(col), r"\s+", " "))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " ")))


def word_ngrams(pieces, n: int, min_length: int) -> Column:
    """Distinct space-joined word n-grams of a piece array.

    Fewer than ``min_length`` pieces -> no n-gram; fewer than ``n`` pieces ->
    one gram of the whole sequence; else every window of ``n``.
    """
    w = _c(pieces)
    windows = F.transform(
        F.sequence(F.lit(1), F.size(w) - F.lit(n - 1)),
        lambda i: F.array_join(F.slice(w, i, n), " "),
    )
    return (
        F.when(F.size(w) < F.lit(min_length), F.array().cast("array<string>"))
        .when(F.size(w) < F.lit(n), F.array(F.array_join(w, " ")))
        .otherwise(F.array_distinct(windows))
    )


def shingle_hash(col, func: str = "md5", bits: int = 32) -> Column:
    """Shingle hash of 16, 32 or 64 bits: the first hex digits of md5 or sha1
    (a 64-bit value as a signed long)."""
    if func not in ("md5", "sha1") or bits not in (16, 32, 64):
        raise ValueError(f"{func}, {bits} bits")
    hexed = F.md5(_c(col).cast("binary")) if func == "md5" else F.sha1(_c(col).cast("binary"))
    part = lambda at, n: F.conv(F.substring(hexed, at, n), 16, 10).cast("bigint")
    if bits < 64:
        return part(1, bits // 4)
    return F.shiftleft(part(1, 8), 32).bitwiseOR(part(9, 8))


def hash28(col) -> Column:
    """Shingle hash: first 7 hex digits of md5 -> [0, 2^28)."""
    return F.conv(F.substring(F.md5(_c(col)), 1, 7), 16, 10).cast("bigint")


def length_between(col, lo: int | None, hi: int | None) -> Column:
    """``lo < len(text) < hi`` in code points, bounds exclusive, either optional."""
    n = F.length(_c(col))
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (n > F.lit(lo))
    if hi is not None:
        cond = cond & (n < F.lit(hi))
    return cond


def category_prefixes(col) -> Column:
    """``"cs.CL math.ST"`` -> ``"cs; math"``: distinct prefixes before '.', sorted."""
    parts = F.split(_c(col), " ")
    heads = F.transform(parts, lambda p: F.substring_index(p, ".", 1))
    return F.array_join(F.sort_array(F.array_distinct(heads)), "; ")
