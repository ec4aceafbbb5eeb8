"""Language identification by character trigrams, learned from a labelled table.

A language's profile is the share of each of its most frequent trigrams among those of all profiles; a text gets the
language under which its trigrams are likeliest. Only the counts of distinct trigrams are shuffled, and only profiles of a
fixed size are sent out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text as T

UNKNOWN = "unknown"
_BITS = 21


def prepared(text: Column) -> Column:
    """Lower case, single spaces, a space at both ends; a null or blank text is empty."""
    t = T.squeeze(F.lower(F.coalesce(text, F.lit(""))))
    return F.when(t == "", "").otherwise(F.concat(F.lit(" "), t, F.lit(" ")))


def trigrams(text: str) -> np.ndarray:
    """Three code points each, as one number."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return (c[:-2] << 2 * _BITS) | (c[1:-1] << _BITS) | c[2:] if len(c) > 2 else np.zeros(0, np.int64)


@dataclass
class Profiles:
    """Languages in order of name, the trigrams of their profiles in order, and log shares (trigrams x languages)."""

    languages: list[str]
    grams: np.ndarray
    logs: np.ndarray

    def identify(self, text: str, margin: float) -> str:
        """``unknown`` without any known trigram, or if the best language is ahead by less than ``margin`` a trigram."""
        g = trigrams(text)
        if not len(g) or not len(self.grams):
            return UNKNOWN
        at = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
        count = np.bincount(at[self.grams[at] == g], minlength=len(self.grams))
        n = int(count.sum())
        if not n:
            return UNKNOWN
        score = count @ self.logs
        best = int(score.argmax())
        if len(score) > 1 and score[best] - np.partition(score, -2)[-2] < margin * n:
            return UNKNOWN
        return self.languages[best]


def learn(df: DataFrame, text_col: str = "text", language_col: str = "language", top: int = 1000) -> Profiles:
    """Profiles of every language of a labelled table (rows without a text or language are left out), from all of its text.

    A profile has the ``top`` most frequent trigrams of a language, ties by code points; shares are of counts plus one
    among the trigrams of all profiles.
    """
    rows = df.where(F.col(text_col).isNotNull() & F.col(language_col).isNotNull()).select(F.col(language_col).cast("string").alias("language"), prepared(F.col(text_col)).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            language = np.array(b.column(0).to_pylist(), object)
            texts = b.column(1)
            for name in sorted(set(language.tolist())):
                parts = [trigrams(texts[int(i)].as_py()) for i in np.flatnonzero(language == name)]
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram), pa.array(n)], names=["language", "gram", "n"])

    n = rows.mapInArrow(count, "language string, gram bigint, n bigint").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    from sievework.operators.storage import materialize

    n = materialize(n, "trigrams")
    first = n.withColumn("_r", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "gram"))).where(F.col("_r") <= top)
    known = first.select("gram").distinct()
    table = n.join(F.broadcast(known), "gram").toPandas()  # at most top * languages * languages rows
    languages, grams = sorted(table["language"].unique()), np.unique(table["gram"].to_numpy())
    count_of = np.zeros((len(grams), len(languages)))
    count_of[np.searchsorted(grams, table["gram"].to_numpy()), np.searchsorted(languages, table["language"].to_numpy()) if languages else []] = table["n"].to_numpy()
    return Profiles(list(languages), grams, np.log((count_of + 1) / (count_of.sum(0) + len(grams))))


def identified(df: DataFrame, profiles: Profiles, text_col: str = "text", out: str = "language", margin: float = 0.02) -> DataFrame:
    """Adds (or replaces) a column with the language of each text; null and blank texts are ``unknown``."""

    @F.pandas_udf("string")
    def identify(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: profiles.identify(t, margin))

    return df.withColumn(out, identify(prepared(F.col(text_col))))
