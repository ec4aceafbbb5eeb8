"""Keyword confidence, the source-quality filter, and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text as T

# The default keywords, in their order.
DEFAULT_KEYWORDS = [
    "ignore", "disregard", "override", "prompt injection", "jailbreak", "bypass", "system prompt", "instructions", "pretend", "roleplay", "act as", "new instruction",
    "ignore previous", "disregard above", "forget everything", "new task", "actually", "instead", "however", "but really", "translate to", "execute", "run code", "eval",
]


def from_source(name: str, col: str = "source"):
    """Rows whose source contains ``name`` in any case; a null source does not."""
    return F.coalesce(F.lower(F.col(col)).contains(name.lower()), F.lit(False))


def with_confidence(df: DataFrame, keywords: list[str] | None = None, text_col: str = "text", out: str = "confidence_score") -> DataFrame:
    return df.withColumn(out, T.confidence(F.col(text_col), keywords or DEFAULT_KEYWORDS))


def filter_source(df: DataFrame, source: str, threshold: float = 0.4, max_samples: int = 5000, keywords: list[str] | None = None, id_col: str = "sample_id") -> DataFrame:
    """Rows of other sources pass. Rows of ``source`` need the threshold; beyond ``max_samples`` the best by score, then id, stay."""
    scored = with_confidence(df, keywords, out="_score").withColumn("_own", from_source(source))
    good = scored.where("_own").where(F.col("_score") >= threshold)
    top = good.select(id_col, "_score").orderBy(F.desc("_score"), id_col).limit(max_samples)
    own = good.join(top.select(id_col), id_col, "left_semi")
    return scored.where("not _own").unionByName(own).select(*df.columns)


def bands(df: DataFrame, source: str, keywords: list[str] | None = None) -> DataFrame:
    """Counts below 0.3, from 0.3 to below 0.7, and from 0.7; mean and median; which rules speak."""
    s = with_confidence(df.where(from_source(source)), keywords)
    c = F.col("confidence_score")
    out = s.agg(F.count("*").alias("total"), F.count_if(c < 0.3).alias("low"), F.count_if((c >= 0.3) & (c < 0.7)).alias("medium"), F.count_if(c >= 0.7).alias("high"), F.avg(c).alias("mean_score"), F.median(c).alias("median_score"))
    out = out.withColumn("low_share", F.col("low") / F.nullif("total", F.lit(0)))
    return out.withColumn("issues", issues(F.col("total"), F.col("low_share"), F.col("mean_score")))


def issues(total: Column, low_share: Column, mean_score: Column, many: int = 10_000) -> Column:
    """What the rules say of a source: most rows of low confidence, a low mean, too many rows; or that nothing is wrong, or that it has no rows."""
    rules = [
        F.when(low_share > 0.5, F.concat(F.format_string("%.1f", low_share * 100), F.lit("% of the rows have a confidence below 0.3: they may have no injection in them"))),
        F.when(mean_score < 0.4, F.concat(F.lit("the mean confidence is only "), F.format_string("%.2f", mean_score), F.lit(": filter or review the source"))),
        F.when(total > many, F.concat(total.cast("string"), F.lit(" rows: cap the source to keep the corpus balanced"))),
    ]
    said = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return F.when(total == 0, F.array(F.lit("no rows of this source"))).when(F.size(said) == 0, F.array(F.lit("nothing critical"))).otherwise(said)


def recommend_filter(df: DataFrame, source: str, threshold: float = 0.4, max_samples: int = 5000, keywords: list[str] | None = None) -> DataFrame:
    """original, at_threshold and recommended (capped) row counts of the source."""
    s = with_confidence(df.where(from_source(source)), keywords)
    out = s.agg(F.count("*").alias("original"), F.count_if(F.col("confidence_score") >= threshold).alias("at_threshold"))
    return out.withColumn("recommended", F.least("at_threshold", F.lit(max_samples).cast("bigint")))


def integrity(df: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """One row (check, n) for each integrity check, all from one pass and one for repeated ids. A missing column counts as one finding."""
    missing = [c for c in ("text", "label", "source") if c not in df.columns]
    checks = {"rows": F.count("*")}
    if "text" in df.columns:
        t = F.col("text")
        checks |= {"blank_text": F.count_if(t.isNull() | (T.squeeze(t) == "")), "null_text": F.count_if(t.isNull()), "over_10k_chars": F.count_if(F.length(t) > 10000), "mostly_caps": F.count_if(T.mostly_caps(t))}
    if "label" in df.columns:
        checks |= {"invalid_label": F.count_if(~F.coalesce(F.col("label").isin(0, 1), F.lit(False))), "null_label": F.count_if(F.col("label").isNull())}
    if "source" in df.columns:
        checks["null_source"] = F.count_if(F.col("source").isNull())
    one = df.agg(*(c.alias(k) for k, c in checks.items()))
    wide = one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("n")) for k in checks), *(F.struct(F.lit(f"missing_{m}").alias("check"), F.lit(1).cast("bigint").alias("n")) for m in missing))).alias("x")).select("x.*")
    repeated = df.groupBy(id_col).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("n")).select(F.lit("duplicate_id").alias("check"), "n")
    return wide.unionByName(repeated)


def check_table(df: DataFrame, required: dict[str, tuple[str, ...]], max_rows: int = 1_000_000) -> DataFrame:
    """Raises ValueError on a missing column, a wrong type, or too many rows; else returns the table."""
    kinds = dict(df.dtypes)
    for c, ok in required.items():
        if c not in kinds:
            raise ValueError(f"missing column: {c}")
        if ok and kinds[c] not in ok:
            raise ValueError(f"column {c} has type {kinds[c]}, not one of {ok}")
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    return df


def top_by_score(df: DataFrame, n: int, score: str, id_col: str = "sample_id") -> DataFrame:
    w = Window.orderBy(F.desc(score), id_col)
    return df.orderBy(F.desc(score), id_col).limit(n).withColumn("place", F.row_number().over(w))
