"""Category labels: patterns, coverage, merges, migration, and answers of a language model."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators.storage import materialize

# Categories with their patterns, in order of evaluation.
PATTERNS = {
    "instruction_override": [r"ignore\s+(all\s+)?(previous|above|prior)", r"disregard\s+(all\s+)?(previous|above|prior)", r"forget\s+(all\s+)?(previous|above|prior)"],
    "jailbreak_roleplay": [r"pretend\s+(you\s+are|to\s+be)", r"act\s+as\s+(if|a|an)", r"you\s+are\s+now", r"DAN", r"developer\s+mode"],
    "obfuscation_encoding": [r"base64", r"rot13", r"hex\s+encoded"],
    "context_manipulation": [r"system\s+prompt", r"repeat\s+(the|your)\s+(instructions|prompt)", r"what\s+(are|were)\s+your\s+instructions"],
    "payload_splitting": [],
    "information_extraction": [r"reveal\s+(your|the)\s+(secret|password|key)", r"what\s+is\s+the\s+(secret|password|key)"],
    "indirect_injection": [],
    "social_engineering": [r"emergency", r"urgent", r"as\s+(your|the)\s+(creator|developer|admin)"],
}

# Slugs by category id, and where slugs of the first scheme went.
SLUG_OF = {"C1": "instruction_override", "C2": "jailbreak_roleplay", "C3": "obfuscation_encoding", "C4": "information_extraction", "C5": "social_engineering", "C6": "context_manipulation", "C7": "other"}
NEW_SLUG_OF = {
    "instruction_override": "instruction_override", "jailbreak_roleplay": "jailbreak_roleplay", "obfuscation_encoding": "obfuscation_encoding", "social_engineering": "social_engineering",
    "information_extraction": "information_extraction", "context_manipulation": "information_extraction", "indirect_injection": "context_manipulation", "payload_splitting": "other",
}
DEFAULT_MERGES = {"obfuscation_encoding": "instruction_override", "context_manipulation": "instruction_override", "information_extraction": "instruction_override"}


def slug_for(category_id: str) -> str:
    """KeyError for an unknown id."""
    return SLUG_OF[category_id]


def spec_table(spark) -> DataFrame:
    return spark.createDataFrame([(k, v, v != "other") for k, v in SLUG_OF.items()], "category_id string, slug string, eligible boolean")


def map_sources(df: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Tier 1. Without a mapping (source, original_category, attack_category) the table stays as it is."""
    if mapping is None:
        return df
    m = mapping.select("source", "original_category", F.col("attack_category").alias("_mapped"))
    return df.join(F.broadcast(m) if m.count() <= 10_000 else m, ["source", "original_category"], "left").withColumn("attack_category", F.coalesce("attack_category", "_mapped")).select(*df.columns)


#: A word boundary of ASCII letters, digits and ``_`` (Java's own takes other letters in even without its Unicode classes).
_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def match_category(text: Column, patterns: dict[str, list[str]], ascii: bool = False) -> Column:
    """The first category one of whose patterns is found anywhere, in any case; null if none is.

    With ``ascii``, the classes and word boundaries of the patterns know ASCII only, as those of RE2 (SQL) do; case is
    that of Unicode, without the Turkish i.
    """
    out = F.lit(None).cast("string")
    if ascii:
        text = F.translate(text, "\u0130\u0131", "\ufffd\ufffd")
    for slug, found in reversed(patterns.items()):
        if found:
            p = "|".join(f"(?:{p})" for p in found)
            p = "(?iu)(?:" + re.sub(r"\\(.)", lambda m: _EDGE if m[1] == "b" else m[0], p, flags=re.S) + ")" if ascii else f"(?iU)(?:{p})"
            out = F.when(text.rlike(p), slug).otherwise(out)
    return out


def match_patterns(df: DataFrame, patterns: dict[str, list[str]] | None = None, ascii: bool = False) -> DataFrame:
    """Tier 2. Only rows without a category that are injections (all rows, if there is no label) are matched."""
    due = F.col("attack_category").isNull()
    if "label" in df.columns:
        due &= F.coalesce(F.col("label") == 1, F.lit(False))
    return df.withColumn("attack_category", F.when(due, match_category(F.col("text"), patterns or PATTERNS, ascii)).otherwise(F.col("attack_category")))


def injections(df: DataFrame) -> DataFrame:
    return df.where("label = 1") if "label" in df.columns else df


def coverage(df: DataFrame) -> DataFrame:
    """For each category (null: unmapped) of the injections: n, and its share in percent."""
    n = injections(df).groupBy("attack_category").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("attack_category", "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"))


def recommend_merges(df: DataFrame, least: int = 50) -> DataFrame:
    """Categories of the injections by size, with whether they are too small to stand alone."""
    n = injections(df).where("attack_category is not null").groupBy("attack_category").agg(F.count("*").alias("n"))
    return n.withColumn("merge", F.col("n") < least)


def merge_categories(df: DataFrame, merges: dict[str, str] | None = None) -> DataFrame:
    """Merges one after the other, so that a chain cascades; an empty map changes nothing."""
    c = F.col("attack_category")
    for source, target in (DEFAULT_MERGES if merges is None else merges).items():
        c = F.when(c == source, target).otherwise(c)
    return df.withColumn("attack_category", c)


def migrate_slugs(df: DataFrame, renamed: dict[str, str] | None = None) -> DataFrame:
    """Maps each slug once; unknown slugs stay."""
    m = F.create_map(*(F.lit(x) for pair in (renamed or NEW_SLUG_OF).items() for x in pair))
    return df.withColumn("attack_category", F.coalesce(F.try_element_at(m, F.col("attack_category")), "attack_category"))


# ---- answers of a language model ----

_ANSWER = "category string, category_id string, label string, confidence string"


def parse_category(raw: Column) -> Column:
    """struct(slug, confidence) of a JSON answer; both null unless the category is known and the confidence lies in [0, 1]."""
    a = F.from_json(raw, _ANSWER)
    slug = F.try_element_at(F.create_map(*(F.lit(x) for pair in SLUG_OF.items() for x in pair)), F.coalesce(a["category"], a["category_id"]))
    confidence = a["confidence"].try_cast("double")
    ok = slug.isNotNull() & F.coalesce(confidence.between(0, 1), F.lit(False))
    return F.struct(F.when(ok, slug).alias("slug"), F.when(ok, confidence).alias("confidence"))


def parse_label(raw: Column) -> Column:
    """struct(label, confidence): injection or benign in any case, else null; a missing or bad confidence is 0.5."""
    a = F.from_json(raw, _ANSWER)
    label = F.lower(F.trim(a["label"]))
    known = label.isin("injection", "benign")
    return F.struct(F.when(known, label).alias("label"), F.when(known, F.coalesce(a["confidence"].try_cast("double"), F.lit(0.5))).alias("confidence"))


def zero_shot(raw: Column) -> Column:
    """struct(pred, prob) of a model's answer: the confidence is the probability of an injection, or one less of it for a benign text; an answer that cannot be parsed is benign with 0.5."""
    a = parse_label(raw)
    yes = a["label"] == "injection"
    return F.struct(F.coalesce(yes, F.lit(False)).cast("int").alias("pred"), F.coalesce(F.when(yes, a["confidence"]).otherwise(1 - a["confidence"]), F.lit(0.5)).alias("prob"))


def parse_name(raw: Column, names: list[str]) -> Column:
    """The answer, trimmed and in lower case, if it is one of the names."""
    cleaned = F.lower(T.squeeze(raw))
    return F.when(cleaned.isin(*names), cleaned)


def last_answers(log: DataFrame, order: str = "line_no") -> DataFrame:
    """The last line of each hash in a log; lines without a hash are left out."""
    rest = [c for c in log.columns if c not in ("sample_hash", order)]
    best = log.where("sample_hash is not null").groupBy("sample_hash").agg(F.max_by(F.struct(*rest), order).alias("_a"))
    return best.select("sample_hash", "_a.*")


def replay(df: DataFrame, log: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Applies logged answers to injections without a category.

    Rows that have a category already are tagged ``tier1_2``. A logged slug with enough confidence is the category
    (label_source ``llm``); with too little, the row is ``uncertain``. A logged answer that could not be parsed leaves
    the row as it is.
    """
    a = last_answers(log).select(F.col("sample_hash").alias("_h"), F.col("category_slug").alias("_slug"), F.col("confidence").alias("_conf"))
    d = df.withColumn("_h", T.hash16(F.col("text"))).join(a, "_h", "left")
    due = F.col("attack_category").isNull() & F.coalesce(F.col("label") == 1, F.lit(False))
    sure, unsure = due & F.coalesce(F.col("_conf") >= threshold, F.lit(False)) & F.col("_slug").isNotNull(), due & F.coalesce(F.col("_conf") < threshold, F.lit(False))
    source = F.when(F.col("attack_category").isNotNull(), "tier1_2").when(sure, "llm").when(unsure, "uncertain")
    return d.select(*[c for c in df.columns if c not in ("attack_category", "label_source", "confidence")], F.when(sure, F.col("_slug")).otherwise(F.col("attack_category")).alias("attack_category"), source.alias("label_source"), F.when(sure | unsure, F.col("_conf")).alias("confidence"))


def pending(df: DataFrame, log: DataFrame, max_calls: int | None = None, id_col: str = "sample_id", retry_failed: bool = False) -> DataFrame:
    """Injections without a category whose hash the log does not have, in order of id, at most ``max_calls``. With ``retry_failed`` an answer without a slug does not count."""
    done = (log.where("category_slug is not null") if retry_failed else log).where("sample_hash is not null").select("sample_hash").distinct()
    todo = df.where("attack_category is null and label = 1").withColumn("sample_hash", T.hash16(F.col("text"))).join(done, "sample_hash", "left_anti")
    return todo.orderBy(id_col).limit(max_calls) if max_calls else todo


def ask(df: DataFrame, provider: Callable[[list[str]], list[str]], text_col: str = "text") -> DataFrame:
    """Adds the raw answers of a provider (texts to answers, in order), by batches on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(raw=provider(batch[text_col].tolist()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{schema}, raw string")


def model_tag(model: str) -> str:
    """The label source that answers of a model get: its name with ``_`` for ``-`` and ``.``."""
    return model.translate(str.maketrans("-.", "__"))


def prompt(text: Column, slugs: list[str] | None = None) -> Column:
    """A question to a language model: the categories, one on each line, then the text; asks for one slug."""
    names = slugs or list(SLUG_OF.values())
    return F.concat(F.lit("Choose the one category that fits the text best. Categories:\n" + "\n".join(f"- {n}" for n in names) + "\n\nText:\n"), text, F.lit("\n\nAnswer with the name of the category only."))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Known answers (sample_hash, category_slug); empty if the file is missing. Lines that are not JSON objects of this form are left out."""
    from sievework.sources.lines import read_json_lines

    schema = "sample_hash string, category_slug string"
    try:
        return read_json_lines(spark, path, schema).where("sample_hash is not null")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, line_no bigint")


def write_cache(cache: DataFrame, path: str) -> None:
    """Adds answers to a cache; of several answers to a hash ``tier3`` takes that of the last line."""
    cache.select("sample_hash", "category_slug").write.mode("append").json(path)


def tier3(df: DataFrame, cache: DataFrame, provider: Callable[[list[str]], list[str]] | None = None, budget: int | None = None, slugs: list[str] | None = None, id_col: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """Asks a language model for injections without a category; returns the table and the new answers, for the cache.

    Texts whose hash the cache has take its answer and cost no call. Of the other distinct texts, in order of their
    smallest id, the first ``budget`` (None: all) are asked, once each. Answers that name no category leave a row as it
    is and are not cached. Without a provider only the cache is used.
    """
    names = slugs or list(SLUG_OF.values())
    d = df.withColumn("_due", F.col("attack_category").isNull() & F.coalesce(F.col("label") == 1, F.lit(False)) & F.col("text").isNotNull()).withColumn("_h", T.hash16(F.col("text")))
    last = F.max_by("category_slug", "line_no") if "line_no" in cache.columns else F.last("category_slug")
    known = cache.groupBy(F.col("sample_hash").alias("_h")).agg(last.alias("_slug"))
    new = known.limit(0)
    if provider is not None:
        todo = d.where("_due").join(known, "_h", "left_anti").groupBy("_h").agg(F.min(id_col).alias("_id"), F.min("text").alias("text"))
        if budget is not None:
            todo = todo.orderBy("_id").limit(budget)
        asked = ask(todo.select("_h", prompt(F.col("text"), names).alias("text")), provider)
        new = materialize(asked.select("_h", parse_name(F.col("raw"), names).alias("_slug")).where("_slug is not null"), "answers")
    out = d.join(known.unionByName(new), "_h", "left").withColumn("attack_category", F.when(F.col("_due"), F.col("_slug")).otherwise(F.col("attack_category")))
    return out.select(*df.columns), new.select(F.col("_h").alias("sample_hash"), F.col("_slug").alias("category_slug"))


def apply_tiers(df: DataFrame, mapping: DataFrame | None = None, patterns: dict[str, list[str]] | None = None, cache: DataFrame | None = None, provider: Callable[[list[str]], list[str]] | None = None, budget: int | None = None) -> DataFrame:
    """The categories by source, then by pattern, then (with a cache) by a language model: each tier sees what the ones before left open."""
    out = match_patterns(map_sources(df, mapping), patterns)
    return out if cache is None else tier3(out, cache, provider, budget)[0]


def batch_requests(df: DataFrame, log: DataFrame, model: str, id_col: str = "sample_id") -> DataFrame:
    """One JSON request (custom_id, model, text) for each pending text."""
    p = pending(df, log, id_col=id_col).select("sample_hash", "text").groupBy("sample_hash").agg(F.min("text").alias("text"))
    return p.select("sample_hash", F.to_json(F.struct(F.col("sample_hash").alias("custom_id"), F.lit(model).alias("model"), F.col("text"))).alias("request"))


def relabel_uncertain(df: DataFrame, answers: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Uncertain rows take a confident answer's slug, else ``other``."""
    a = last_answers(answers).select(F.col("sample_hash").alias("_h"), F.col("category_slug").alias("_slug"), F.col("confidence").alias("_c"))
    d = df.withColumn("_h", T.hash16(F.col("text"))).join(a, "_h", "left")
    new = F.when(F.coalesce(F.col("_c") >= threshold, F.lit(False)), F.coalesce("_slug", F.lit("other"))).otherwise("other")
    return d.withColumn("attack_category", F.when(F.col("label_source") == "uncertain", new).otherwise(F.col("attack_category"))).select(*df.columns)


# ---- review ----

EXPORTED = ["sample_hash", "text", "source", "attack_category", "confidence", "label_source"]
CONFIDENT = ("llm", "gpt_4_1_mini")


def apply_overrides(df: DataFrame, overrides: DataFrame, order: str | None = "line_no") -> DataFrame:
    """Manual categories (sample_hash, correct_category) by the hash of the raw text; ids become slugs, blanks are left out.

    The last of several overrides of a hash wins; every row of a text changes. ValueError for unknown categories.
    """
    c = F.trim("correct_category")
    ids = F.create_map(*(F.lit(x) for pair in SLUG_OF.items() for x in pair))
    o = overrides.where(F.coalesce(c != "", F.lit(False)) & F.col("sample_hash").isNotNull()).select("sample_hash", F.coalesce(F.try_element_at(ids, c), c).alias("_slug"), *([order] if order else []))
    unknown = [r[0] for r in o.where(~F.col("_slug").isin(*SLUG_OF.values())).select("_slug").distinct().limit(20).collect()]
    if unknown:
        raise ValueError(f"unknown categories: {sorted(unknown)}")
    o = o.groupBy("sample_hash").agg((F.max_by("_slug", order) if order else F.max("_slug")).alias("_slug")).withColumnRenamed("sample_hash", "_h")
    d = df.withColumn("_h", T.hash16(F.col("text"))).join(o, "_h", "left")
    for name, kind in (("label_source", "string"), ("confidence", "double")):
        if name not in d.columns:
            d = d.withColumn(name, F.lit(None).cast(kind))
    hit = F.col("_slug").isNotNull()
    return d.withColumn("attack_category", F.coalesce("_slug", "attack_category")).withColumn("label_source", F.when(hit, "manual").otherwise(F.col("label_source"))).withColumn("confidence", F.when(hit, 1.0).otherwise(F.col("confidence"))).drop("_h", "_slug")


def spot_check(df: DataFrame, n: int = 50, seed: int = 42, id_col: str = "sample_id") -> DataFrame:
    """Up to n confident labels of each category (not of none), drawn by hash; texts cut to 500 characters, with an empty column for the reviewer."""
    d = df.where(F.col("label_source").isin(*CONFIDENT) & F.col("attack_category").isNotNull())
    w = Window.partitionBy("attack_category").orderBy(T.hash_rank_key(seed, F.col(id_col)), id_col)
    d = d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).withColumn("sample_hash", T.hash16(F.col("text"))).withColumn("text", F.substring("text", 1, 500))
    return d.select(*EXPORTED, F.lit(None).cast("string").alias("correct_category"))


def uncertain(df: DataFrame) -> DataFrame:
    d = df if "confidence" in df.columns else df.withColumn("confidence", F.lit(None).cast("double"))
    return d.where("label_source = 'uncertain'").withColumn("sample_hash", T.hash16(F.col("text"))).withColumn("text", F.substring("text", 1, 500)).select(*EXPORTED)


def error_rates(reviewed: DataFrame, limit: float = 0.20) -> DataFrame:
    """For each category and overall (null): reviewed, errors, error_rate (4 places), flagged. Rows without a review are left out."""
    r = reviewed.where(F.coalesce(F.trim("correct_category") != "", F.lit(False)))
    errors = F.count_if(F.col("attack_category") != F.trim("correct_category"))
    agg = [F.count("*").alias("reviewed"), errors.alias("errors")]
    out = r.groupBy("attack_category").agg(*agg).unionByName(r.agg(*agg).withColumn("attack_category", F.lit(None).cast("string")).select("attack_category", "reviewed", "errors"))
    rate = F.bround(F.col("errors") / F.nullif("reviewed", F.lit(0)), 4)
    return out.withColumn("error_rate", rate).withColumn("flagged", F.coalesce(rate > limit, F.lit(False)))


def label_distribution_check(df: DataFrame, limit: float = 0.60) -> DataFrame:
    """Share of each category among labels a model gave; dominant above the limit."""
    d = df.where(F.col("label_source").isNotNull() & ~F.col("label_source").isin("tier1_2", "uncertain") & F.col("attack_category").isNotNull())
    n = d.groupBy("attack_category").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("attack_category", "n", (F.col("n") / F.col("total")).alias("share"), (F.col("n") / F.col("total") > limit).alias("dominant"))


def coverage_by_source(df: DataFrame) -> DataFrame:
    """For each label source (null: none) of the injections: rows, with a category; overall (source ``all``) with coverage in percent and whether it reaches 90."""
    i = injections(df)
    agg = [F.count("*").alias("n"), F.count("attack_category").alias("mapped")]
    per = i.groupBy("label_source").agg(*agg)
    out = per.unionByName(i.agg(*agg).withColumn("label_source", F.lit("all")).select("label_source", "n", "mapped"))
    share = F.col("mapped") * 100.0 / F.nullif("n", F.lit(0))
    return out.withColumn("coverage_percent", F.coalesce(F.bround(share, 2), F.lit(0.0))).withColumn("complete", F.coalesce(share >= 90, F.lit(False)))
