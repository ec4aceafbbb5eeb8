"""Column expressions over text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x), na_action="ignore")


def squeeze(text: Column) -> Column:
    """Every run of Unicode white space becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column) -> Column:
    """NFC, then squeezed white space. The normal form needs Python, as Spark has no function for it."""
    return squeeze(_nfc(text))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def hash16(raw: Column) -> Column:
    """First 16 hexadecimal digits over the raw text: the key of labels and overrides."""
    return F.substring(F.sha2(raw, 256), 1, 16)


def hash12(normalized: Column) -> Column:
    """First 12 hexadecimal digits over the normalized text: the id of leakage reports."""
    return F.substring(F.sha2(normalized, 256), 1, 12)


def word_list(text: Column) -> Column:
    """Lower-case words; null or blank text has none (splitting an empty text would give one)."""
    return F.filter(F.split(F.lower(squeeze(F.coalesce(text, F.lit("")))), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"), F.lit(0)))


def shingles(text: Column, n: int = 5) -> Column:
    """n-word shingles in order; 1 to n-1 words give the whole text as one, none give none."""

    def cut(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < n, F.array(F.array_join(w, " "))).otherwise(windows)

    # the words are bound once; inside the lambda they would be made again for every window
    return F.transform(F.array(word_list(text)), cut)[0]


def shingle_hashes(text: Column, n: int = 5) -> Column:
    """A number for each of ``shingles``, of 64 bits: equal ones have equal numbers. No shingle is written out, so it takes much less time."""

    def cut(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*(h[i + k] for k in range(n))))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < n, F.array(F.xxhash64(h))).otherwise(windows)

    return F.transform(F.array(F.transform(word_list(text), lambda w: F.xxhash64(w))), cut)[0]


def tokens(text: Column) -> Column:
    return F.array_distinct(word_list(text))


def mostly_caps(text: Column, share: float = 0.8, least: int = 10) -> Column:
    """At least ``least`` letters, more than ``share`` of them upper case."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.coalesce((letters >= least) & (F.regexp_count(text, F.lit(r"\p{Lu}")) > letters * share), F.lit(False))


def keyword_pattern(keywords: list[str]) -> str:
    """Whole words, any case; the first keyword of the list that fits at a place wins there."""
    import re

    return r"(?iU)\b(" + "|".join(re.escape(k) for k in keywords) + r")\b"


def confidence(text: Column, keywords: list[str]) -> Column:
    """min(1, matches / (1 + log10(length))); null or blank text has 0."""
    hits = F.regexp_count(text, F.lit(keyword_pattern(keywords)))
    blank = text.isNull() | (squeeze(text) == "")
    return F.when(blank, 0.0).otherwise(F.least(F.lit(1.0), hits / (1 + F.log10(F.length(text)))))


def display(text: Column, limit: int = 100) -> Column:
    """For a table cell: invisible characters go, other control characters become spaces, at most ``limit`` characters and ``...``, then HTML escapes."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[​-‏‪-‮⁠-⁯]", "")
    t = F.regexp_replace(t, r"[\p{C}\p{Z}&&[^ ]]", " ")
    t = F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def hash_rank_key(*parts: Column | str | int) -> Column:
    """The sort key of a reproducible shuffle: SHA-256 of the parts joined by colons."""
    return F.sha2(F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)), 256)
