"""A deterministic language tag from frequent short words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.text import word_list

#: Frequent words by language, none in two lists.
FREQUENT = {
    "de": ["der", "die", "das", "und", "ist", "nicht", "mit", "ein", "eine", "auf", "für", "von", "den", "dem", "zu", "auch", "als", "ich"],
    "en": ["the", "and", "of", "to", "is", "that", "was", "for", "with", "this", "are", "from", "have", "you", "not", "be", "by", "it"],
    "es": ["el", "los", "las", "y", "una", "por", "para", "que", "del", "se", "como", "pero", "más", "está", "al"],
    "fr": ["le", "les", "et", "est", "une", "dans", "pour", "qui", "sur", "avec", "pas", "vous", "au", "ce", "je"],
}


def detect(text: Column) -> Column:
    """The language with most frequent words, the first by name on ties; ``unknown`` without any."""
    words = word_list(text)

    def among(known: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*known)))

    hits = [among(FREQUENT[k]) for k in sorted(FREQUENT)]
    best = F.greatest(*hits)
    out = F.when(best == 0, "unknown")
    for k, h in zip(sorted(FREQUENT), hits, strict=True):
        out = out.when(h == best, k)
    return out.otherwise("unknown")
