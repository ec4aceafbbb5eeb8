"""Descriptive statistics of a labelled table. Every function returns a table and runs no action itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T

#: Edges of the length histogram; the last bin has its right edge too.
LENGTH_EDGES = [0, 50, 100, 200, 500, 1000, 2000, 5000]


def statistics(df: DataFrame) -> DataFrame:
    """One row: rows, distinct labels, sources, languages and categories (nulls not counted), indirect rows, share of rows with a category in percent (0 of an empty table)."""
    d = lambda c: F.count_distinct(F.col(c))
    return df.agg(
        F.count("*").alias("n_rows"), d("label").alias("n_labels"), d("source").alias("n_sources"), d("language").alias("n_languages"), d("attack_category").alias("n_categories"),
        F.count_if(F.coalesce("is_indirect", F.lit(False))).alias("n_indirect"),
        F.coalesce(F.count("attack_category") * 100.0 / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("category_percent"),
    )


def text_properties(df: DataFrame) -> DataFrame:
    """Minimum, maximum, mean, median and population deviation of characters and words; how many texts are short (<10), long (>5000), blank."""
    t = F.coalesce(F.col("text"), F.lit(""))
    d = df.select(F.length(t).alias("chars"), T.word_count(t).alias("words"), (T.squeeze(t) == "").alias("blank"))
    parts = [f(c).cast(k).alias(f"{c}_{n}") for c in ("chars", "words") for n, f, k in (("min", F.min, "bigint"), ("max", F.max, "bigint"), ("mean", F.avg, "double"), ("median", F.median, "double"), ("std", F.stddev_pop, "double"))]
    return d.agg(*parts, F.count_if(F.col("chars") < 10).alias("short"), F.count_if(F.col("chars") > 5000).alias("long"), F.count_if("blank").alias("blank"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and percent of each value; nulls are not a value, and percents are of all rows."""
    total = df.agg(F.count("*").alias("total"))
    n = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"))


def balance(df: DataFrame) -> DataFrame:
    """Rows of the smallest label over those of the largest: 1 with one label, 0 without rows."""
    n = df.where("label is not null").groupBy("label").count()
    return n.agg(F.coalesce(F.min("count") / F.max("count"), F.lit(0.0)).alias("balance"))


def language_summary(df: DataFrame, home: str = "en") -> DataFrame:
    """n_languages, n_home, n_other (with unknown ones), home_percent."""
    own = F.count_if(F.col("language").eqNullSafe(F.lit(home)))
    return df.agg(F.count_distinct("language").alias("n_languages"), own.alias("n_home"), (F.count("*") - own).alias("n_other"), F.coalesce(own * 100.0 / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("home_percent"))


def crosstab(df: DataFrame, rows: str, columns: str, values: list, top: int | None = None) -> DataFrame:
    """Counts by two columns, one column for each of ``values``; the ``top`` rows by total."""
    p = df.where(F.col(rows).isNotNull()).groupBy(rows).pivot(columns, values).count().na.fill(0)
    p = p.withColumn("total", sum((F.col(str(v)) for v in values), F.lit(0)).cast("bigint"))
    p = p.select(rows, *(F.col(str(v)).alias(f"{columns}_{v}") for v in values), "total")
    return p.orderBy(F.desc("total"), rows).limit(top) if top else p


def length_histogram(df: DataFrame, edges: list[int] | None = None, by: str | None = None) -> DataFrame:
    """Texts by length; those beyond the last edge are in no bin."""
    e = edges or LENGTH_EDGES
    n = F.length(F.coalesce(F.col("text"), F.lit("")))
    lower: Column = F.lit(None).cast("int")
    for i in range(len(e) - 1):
        inside = (n >= e[i]) & ((n <= e[i + 1]) if i == len(e) - 2 else (n < e[i + 1]))
        lower = F.when(inside, e[i]).otherwise(lower)
    keys = [by, "lower"] if by else ["lower"]
    return df.withColumn("lower", lower).where("lower is not null").groupBy(*keys).agg(F.count("*").alias("n"))


def describe_by(df: DataFrame, key: str, value: Column) -> DataFrame:
    """count, mean, sample deviation, minimum, quartiles and maximum of a number by key."""
    d = df.select(key, value.cast("double").alias("v"))
    q = lambda p: F.percentile("v", F.lit(p))
    return d.groupBy(key).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max("v").alias("max"))


def split_feasibility(df: DataFrame, categories: int = 200, indirect: int = 500, language: int = 300) -> DataFrame:
    """(check, key, n, enough): categories by size, indirect injections, languages other than English."""
    cat = df.where("label = 1 and attack_category is not null").groupBy(F.col("attack_category").alias("key")).agg(F.count("*").alias("n")).select(F.lit("category").alias("check"), "key", "n", (F.col("n") >= categories).alias("enough"))
    ind = df.agg(F.count_if(F.coalesce("is_indirect", F.lit(False)) & (F.col("label") == 1)).alias("n")).select(F.lit("indirect").alias("check"), F.lit("all").alias("key"), "n", (F.col("n") >= indirect).alias("enough"))
    lang = df.where("language is not null and language <> 'en'").groupBy(F.col("language").alias("key")).agg(F.count("*").alias("n")).select(F.lit("language").alias("check"), "key", "n", (F.col("n") >= language).alias("enough"))
    return cat.unionByName(ind).unionByName(lang)


def feasibility_matrix(before: DataFrame, after: DataFrame, least: int = 200) -> DataFrame:
    """For each category of the injections: rows before and after deduplication, and whether enough are left (never for ``other``)."""
    n = lambda d, name: d.where("label = 1 and attack_category is not null").groupBy("attack_category").agg(F.count("*").alias(name))
    j = n(before, "pre").join(n(after, "post"), "attack_category", "left").na.fill(0, ["post"])
    post = F.when(F.col("attack_category") == "other", F.col("pre")).otherwise(F.col("post"))
    return j.select("attack_category", "pre", post.alias("post"), ((post >= least) & (F.col("attack_category") != "other")).alias("viable"))


def outcome(matrix: DataFrame) -> DataFrame:
    """n_viable and A (5 or more), B (3 or more) or C."""
    n = F.count_if("viable")
    return matrix.agg(n.alias("n_viable"), F.when(n >= 5, "A").when(n >= 3, "B").otherwise("C").alias("outcome"))


def content_hash(df: DataFrame, text_col: str = "text") -> DataFrame:
    """A hash of the bag of texts that depends on no order and gathers nothing: count and sum of the rows' hashes."""
    return df.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), 1, 12), 16, 10).cast("decimal(38,0)")).alias("hash_sum"))
