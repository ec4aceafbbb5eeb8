"""Queries on loaders, files, logs and models of embeddings over the given tables, with their SQL.

The raw tables of the loaders are made from the bundled ones; files are written below the shared folder and read again.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import embeddings, labelling, splits, taxonomy
from sievework.operators.storage import new_folder
from sievework.plans.model_plans import LEAVE_OUT_V
from sievework.plans.text_plans import six
from sievework.plans.views import LOG, R, U, V, W, documents, labelled, log, results, reviewed, table, vectors
from sievework.sources import loaders, sinks
from sievework.sources.versioned import VersionedTable

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- loaders ----

J = "j as (select doc_id, text, lang, source, toxic, quality from documents join labels using (doc_id))"
STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


def _hashed() -> Column:
    return F.sha2("text", 256).alias("h")


def _joined(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumnRenamed("doc_id", "row")


@query(f"with {J} select sha256(text) as h, toxic::int as label, 'deepset' as source, case when doc_id % 5 = 0 then 'test' else 'train' end as split from j")
def load_deepset(spark: SparkSession, sf: str) -> DataFrame:
    j = _joined(spark, sf).select("row", "text", F.col("toxic").alias("label"))
    d = loaders.deepset(loaders.with_splits({"train": j.where("row % 5 <> 0"), "test": j.where("row % 5 = 0")}))
    return d.select(_hashed(), "label", "source", F.col("metadata")["split"].alias("split"))


@query(f"with {J} select sha256(text) as h, 1 as label from (select text, min(doc_id) as o from j where (toxic = 1 or quality = 0) and not coalesce(case when doc_id % 10 = 0 then null else doc_id % 9 = 0 end, false) group by 1 order by o limit 50)")
def load_hackaprompt(spark: SparkSession, sf: str) -> DataFrame:
    error = F.when(F.col("row") % 10 != 0, F.col("row") % 9 == 0)
    j = _joined(spark, sf).select("row", F.col("text").alias("user_input"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("correct"), error.alias("error"))
    return loaders.hackaprompt(j, 50).select(_hashed(), "label")


@query(f"with {J} select sha256(text) as h, toxic::int as label, case when toxic = 1 then source end as original_category from (select * from j order by doc_id limit 60)")
def load_gentel(spark: SparkSession, sf: str) -> DataFrame:
    j = _joined(spark, sf).select("row", "text", F.col("toxic").alias("label"), F.col("source").alias("subdomain"))
    return loaders.gentel(j, 60).select(_hashed(), "label", "original_category")


@query("select sha256(text) as h, 1 as label, item_id / 8.0::double as similarity from benchmark")
def load_pint(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("row"), "text", (F.col("item_id") / 8.0).alias("similarity"))
    return loaders.pint(b).select(_hashed(), "label", F.col("metadata")["similarity"].cast("double").alias("similarity"))


PAIRS = "pr as (select conv_id * 1000 + turn as o, text as attack, next as normal from (select *, lead(role) over w as nr, lead(text) over w as next from conversations window w as (partition by conv_id order by turn)) where role = 'user' and nr = 'assistant')"


@query(f"with {PAIRS} select sha256(attack) as h, 1 as label, true as is_indirect from pr union all select sha256(normal), 0, false from (select distinct normal from pr)")
def load_open_prompt(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").select("*", F.lead("role").over(w).alias("nr"), F.lead("text").over(w).alias("normal_input")).where("role = 'user' and nr = 'assistant'")
    raw = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row"), F.col("text").alias("attack_input"), "normal_input", F.lit("x").alias("attack_type"))
    return loaders.open_prompt(raw).select(_hashed(), "label", "is_indirect")


@query(f"select sha256(t) as h, lang as category, has::varchar as has_context from (select {STRIP} as t, arg_min(lang, doc_id) as lang, arg_min(case when doc_id % 3 = 0 then false else true end, doc_id) as has, min(doc_id) as o from documents where {STRIP} <> '' group by 1 order by o limit 15000)")
def load_dolly(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "documents").select(F.col("doc_id").alias("row"), F.col("text").alias("instruction"), F.col("lang").alias("category"), F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("source")).alias("context"))
    m = F.col("metadata")
    return loaders.dolly(raw).select(_hashed(), m["category"].alias("category"), m["has_context"].alias("has_context"))


@query(rf"select sha256(t) as h, 0 as label from (select {STRIP} || case when doc_id % 2 = 0 then chr(10) || lang else '' end as t, min(doc_id) as o from documents where {STRIP} <> '' group by 1 order by o limit 8000)")
def load_alpaca(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "documents").where(loaders._strip(F.col("text")) != "").select(F.col("doc_id").alias("row"), F.col("text").alias("instruction"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.col("lang"))).alias("input"))
    return loaders.alpaca(raw).select(_hashed(), "label")


@query(f"select sha256(t) as h, 0 as label from (select {STRIP} as t, min(conv_id * 1000 + turn) as o from conversations where role = 'user' and conv_id % 2 = 0 and {STRIP} <> '' group by 1 order by o limit 8000)")
def load_oasst(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row"), "text", F.when(F.col("role") == "user", "prompter").otherwise(F.col("role")).alias("role"), F.when(F.col("conv_id") % 2 == 0, "en").otherwise("de").alias("lang"))
    return loaders.oasst(raw).select(_hashed(), "label")


@query(f"select sha256(t) as h, 0 as label from (select {STRIP} as t, min(conv_id) as o from (select conv_id, arg_min(text, turn) as text from conversations where role = 'user' and conv_id % 3 <> 0 group by 1) where {STRIP} <> '' group by 1 order by o limit 8000)")
def load_wildchat(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    raw = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("row")).agg(F.array_sort(F.collect_list(turn)).alias("conversation"))
    raw = raw.withColumn("language", F.when(F.col("row") % 3 != 0, "English").otherwise("German"))
    return loaders.wildchat(raw).select(_hashed(), "label")


@query("select 'pint' as source, count(*) as n from benchmark union all select 'oasst', count(distinct text) from conversations where role = 'user' and conv_id % 2 = 0")
def load_union(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("row"), "text")
    c = table(spark, sf, "conversations").where("role = 'user' and conv_id % 2 = 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row"), "text", F.lit("prompter").alias("role"), F.lit("en").alias("lang"))
    u = loaders.union([loaders.LOADERS["pint"](b), loaders.LOADERS["oasst"](c, None)], spark)
    return loaders.drop_metadata(u).groupBy("source").agg(F.count("*").alias("n"))


# ---- files ----


@query(f"with {R} select experiment, embedding, classifier, fold, held_out, round(f1, 6) as f1 from r")
def result_files(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows as a JSON file for each run, read again."""
    folder = new_folder(spark, "results")
    sinks.write_results(results(spark, sf), folder)
    names = lambda c: [r[0] for r in found.select(c).distinct().collect()]
    found = loaders.read_results(spark, folder)
    grid = loaders.result_grid(found, ["standard_cv", "leave_out"], names("classifier"), names("embedding"))
    return grid.select("experiment", "embedding", "classifier", "fold", "held_out", *six("f1"))


@query(f"with {V}, {LEAVE_OUT_V} select 'fold_' || fold as name, count(*) filter (role = 'train') as n_train, count(*) filter (role = 'test') as n_test from lo group by 1")
def split_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Train and test tables of each fold, found again by their folders."""
    v, folder = vectors(spark, sf), new_folder(spark, "splits")
    sinks.write_pairs(v, splits.leave_one_out(v, 47).select("fold", "sample_id", "role"), folder)
    out = None
    for pair in loaders.discover_split_pairs(spark, folder):
        n = [spark.read.parquet(f"{pair}/{r}.parquet").agg(F.count("*").alias(f"n_{r}")) for r in ("train", "test")]
        one = n[0].crossJoin(F.broadcast(n[1])).select(F.lit(pair.rsplit("/", 1)[-1]).alias("name"), "n_train", "n_test")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"with {V}, {LEAVE_OUT_V} select fold, role, sample_id, label from lo join v using (sample_id)")
def split_tables(spark: SparkSession, sf: str) -> DataFrame:
    v, folder = vectors(spark, sf), new_folder(spark, "split")
    sinks.write_split(v.select("sample_id", "label"), splits.leave_one_out(v, 47).select("fold", "sample_id", "role"), folder)
    return spark.read.parquet(folder).select("fold", "role", "sample_id", "label")


@query(f"""with {U}, t as (select text, bool_or(sample_id % 4 = 0) as b, bool_or(sample_id % 2 = 0) as a from u where label = 1 and sample_id % 2 = 0 group by 1)
select sample_id, case when b then 'social_engineering' when a then 'other' else attack_category end as attack_category, case when a then 'manual' end as label_source from u left join t using (text) where label = 1""")
def override_files(spark: SparkSession, sf: str) -> DataFrame:
    """Overrides from two CSV files, of which the later one counts."""
    u, folder = labelled(spark, sf).where("label = 1"), new_folder(spark, "overrides")
    for name, n, slug in (("a", 2, "other"), ("b", 4, "C5")):
        sinks.write_csv(u.where(F.col("sample_id") % n == 0).select(T.hash16(F.col("text")).alias("sample_hash"), F.lit(slug).alias("correct_category")), f"{folder}/{name}")
    o = loaders.read_overrides(spark, [f"{folder}/b", f"{folder}/a"])
    return taxonomy.apply_overrides(u, o).select("sample_id", "attack_category", "label_source")


@query("select substr(sha256(text), 1, 16) as sample_hash, case when bool_or(doc_id % 3 = 0) then 'jailbreak_roleplay' else 'other' end as category_slug from documents group by 1")
def upserted_cache(spark: SparkSession, sf: str) -> DataFrame:
    """A cache of answers by hash, filled and then changed in part."""
    d = documents(spark, sf).select(T.hash16(F.col("text")).alias("sample_hash"), "sample_id")
    t = VersionedTable(spark, new_folder(spark, "cache"), "sample_hash", "sample_hash string, category_slug string")
    t.upsert(d.withColumn("category_slug", F.lit("other")))
    t.upsert(d.where("sample_id % 3 = 0").withColumn("category_slug", F.lit("jailbreak_roleplay")))
    return t.read()


@query("select substr(sha256(text), 1, 16) as sample_hash, case when bool_or(doc_id % 3 = 0) then 'jailbreak_roleplay' else 'other' end as category_slug from documents group by 1")
def cache_files(spark: SparkSession, sf: str) -> DataFrame:
    """A cache that is appended to: the last line of a hash counts, whatever the files are called."""
    d, path = documents(spark, sf).select(T.hash16(F.col("text")).alias("sample_hash"), "sample_id"), new_folder(spark, "cache-log")
    taxonomy.write_cache(d.withColumn("category_slug", F.lit("other")), path)
    taxonomy.write_cache(d.where("sample_id % 3 = 0").withColumn("category_slug", F.lit("jailbreak_roleplay")), path)
    return taxonomy.last_answers(taxonomy.read_cache(spark, path))


@query(f"with {R} select experiment, embedding, classifier, fold, round(f1, 6) as f1 from r where experiment = 'leave_out' or classifier = 'svm'")
def run_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Runs in folders of their names: a second write replaces its own runs only."""
    r, folder = results(spark, sf), new_folder(spark, "runs")
    sinks.write_run(r.where("experiment = 'leave_out'").withColumn("f1", F.lit(0.0)), folder)
    sinks.write_run(r.where("classifier = 'svm'"), folder)
    sinks.write_run(r.where("experiment = 'leave_out'"), folder)
    return spark.read.parquet(folder).select("experiment", "embedding", "classifier", "fold", *six("f1"))


@query(f"with {V}, {LEAVE_OUT_V} select fold, role, count(*) as n, sum(('0x' || substr(sha256(sample_id::varchar), 1, 12))::bigint)::varchar as hash_sum from lo group by 1, 2")
def split_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.manifest(splits.leave_one_out(vectors(spark, sf), 47)).withColumn("hash_sum", F.col("hash_sum").cast("string"))


@query(f"with {W} select sample_id, label_source <> 'uncertain' as applied from w where label_source in ('llm', 'gpt_4_1_mini', 'uncertain')")
def processed_labels(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.processed_labels(reviewed(spark, sf)).select("sample_id", "applied")


# ---- answers and embeddings ----

SLUGS = list(taxonomy.SLUG_OF.values())
LIST = "[" + ", ".join(f"'{s}'" for s in SLUGS) + "]"


def by_length(texts: list[str]) -> list[str]:
    """A provider that answers by a text's length."""
    return [json.dumps({"category_id": f"C{1 + len(t) % 7}", "confidence": (len(t) % 10) / 10}) for t in texts]


@query(f"""with {U}, a as (select sample_id, case when attack_category is null and label = 1 then (length(text) % 10) / 10.0::double end as c, {LIST}[(1 + length(text) % 7)::int] as slug, attack_category from u)
select sample_id, case when c >= 0.6 then slug else attack_category end as attack_category, case when attack_category is not null then 'tier1_2' when c >= 0.6 then 'llm' when c < 0.6 then 'uncertain' end as label_source, c as confidence from a""")
def label_run(spark: SparkSession, sf: str) -> DataFrame:
    """The whole labelling run with a provider that answers by rule, logged and replayed."""
    out = labelling.label_samples(labelled(spark, sf), new_folder(spark, "answers"), by_length, batch=8)
    return out.select("sample_id", "attack_category", "label_source", "confidence")


@query(f"with {W}, {LOG} select sample_id, case when label_source = 'uncertain' then case when coalesce(a.p >= 0.6, false) then coalesce(a.c, 'other') else 'other' end else attack_category end as attack_category from w left join gl on gl.sample_hash = substr(sha256(text), 1, 16)")
def relabelled(spark: SparkSession, sf: str) -> DataFrame:
    return taxonomy.relabel_uncertain(reviewed(spark, sf), log(spark, sf)).select("sample_id", "attack_category")


_FRAME = "Choose the one category that fits the text best. Categories:\n" + "\n".join(f"- {n}" for n in SLUGS) + "\n\nText:\n\n\nAnswer with the name of the category only."


def name_by_length(prompts: list[str]) -> list[str]:
    return [f" {SLUGS[len(p) % 7].upper()} " if len(p) % 5 else "none of them" for p in prompts]


@query(f"with {U} select sample_id, case when attack_category is null and label = 1 and (length(text) + {len(_FRAME)}) % 5 <> 0 then {LIST}[((length(text) + {len(_FRAME)}) % 7 + 1)::int] else attack_category end as attack_category from u")
def tier3_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Categories by a model that is asked with a prompt, each text once."""
    u = labelled(spark, sf)
    cache = spark.createDataFrame([], "sample_hash string, category_slug string")
    return taxonomy.tier3(u, cache, name_by_length)[0].select("sample_id", "attack_category")


@query(f"with {U} select distinct substr(sha256(text), 1, 16) as sample_hash, 'm-1' as model, text from u where attack_category is null and label = 1")
def batch_requests(spark: SparkSession, sf: str) -> DataFrame:
    u = labelled(spark, sf)
    empty = spark.createDataFrame([], "sample_hash string, category_slug string")
    r = F.from_json("request", "custom_id string, model string, text string")
    return taxonomy.batch_requests(u, empty, "m-1").select(r.alias("r")).select(F.col("r.custom_id").alias("sample_hash"), "r.model", "r.text")


def counts_of(texts: list[str]) -> list[list[float]]:
    """A model of embeddings by rule."""
    return [[float(len(t)), float(sum(c in "aeiou" for c in t)), float(t.count(" "))] for t in texts]


@query("select doc_id as sample_id, length(text)::double as a, len(regexp_extract_all(text, '[aeiou]'))::double as b, (length(text) - length(replace(text, ' ', '')))::double as c from documents where text is not null")
def embedded_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of distinct texts by a registered model, saved and loaded by their fingerprint."""
    embeddings.register("counts", lambda: counts_of)
    d, path = documents(spark, sf).where("text is not null"), new_folder(spark, "vectors")
    embeddings.save_embeddings(embeddings.embedded(d, "counts"), path, "1")
    v = embeddings.load_embeddings(d, path, "1")
    return v.select("sample_id", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("abc")))


@query("select d.doc_id as sample_id, round(e.embedding[1]::double, 6) as first, coalesce(len(e.embedding), 0)::bigint as width from documents d join (select text, min(doc_id) as of_id from documents group by 1) k using (text) left join embeddings e on e.vec_id = k.of_id")
def vector_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of distinct texts from a table, once for each text."""
    t = documents(spark, sf).select("sample_id", "text")
    v = vectors(spark, sf).select(F.col("sample_id").alias("of_id"), "embedding")
    known = t.groupBy("text").agg(F.min("sample_id").alias("of_id")).join(v, "of_id", "left").select("text", "embedding")
    got = embeddings.by_text(t, lambda texts: texts.join(known, "text"))
    return got.select("sample_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).otherwise(0).cast("bigint").alias("width"))
