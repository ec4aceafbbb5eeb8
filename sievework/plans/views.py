"""Labelled views over the bundled tables, for the queries and for their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import centroids
from sievework.operators.storage import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), "text", "lang", "source")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels; toxic or junk is label 1, in four categories of which every seventh is unknown."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "left").withColumn("bad", F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False)))
    return j.select(
        F.col("doc_id").alias("sample_id"), "text", F.col("bad").cast("int").alias("label"), "source",
        F.when(F.col("bad") & (F.col("doc_id") % 7 != 0), F.concat(F.lit("cat_"), (F.col("doc_id") % 4).cast("string"))).alias("attack_category"),
        F.col("lang").alias("language"), F.col("text").contains("License").alias("is_indirect"),
    )


U = """u as (select d.doc_id as sample_id, d.text, coalesce(l.toxic = 1 or l.quality = 0, false)::int as label, d.source,
  case when coalesce(l.toxic = 1 or l.quality = 0, false) and d.doc_id % 7 <> 0 then 'cat_' || (d.doc_id % 4) end as attack_category,
  d.lang as language, contains(d.text, 'License') as is_indirect from documents d left join labels l using (doc_id))"""


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled view with label sources, confidences and a reviewer's answers, all from the id."""
    u = labelled(spark, sf_dir).where("label = 1")
    i = F.col("sample_id")
    return u.select(
        "*",
        F.when(F.col("attack_category").isNull(), "uncertain").when(i % 3 == 0, "tier1_2").otherwise("llm").alias("label_source"),
        (0.5 + (i % 50) / 100.0).alias("confidence"),
        F.when(i % 2 == 0, F.when(i % 10 == 0, "cat_0").otherwise(F.col("attack_category"))).alias("correct_category"),
    )


W = (
    U
    + """, w as (select *, case when attack_category is null then 'uncertain' when sample_id % 3 = 0 then 'tier1_2' else 'llm' end as label_source,
  0.5 + (sample_id % 50) / 100.0 as confidence,
  case when sample_id % 2 = 0 then case when sample_id % 10 = 0 then 'cat_0' else attack_category end end as correct_category from u where label = 1)"""
)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings; labels below 5 are injections of that category."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), "embedding", (F.col("label") < 5).cast("int").alias("label"), F.when(F.col("label") < 5, F.concat(F.lit("cat_"), F.col("label").cast("string"))).alias("attack_category"))


V = """v as (select vec_id as sample_id, embedding, (label < 5)::int as label, case when label < 5 then 'cat_' || label end as attack_category from embeddings)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors with a score from a hash, in steps of a hundredth so that there are ties, and a prediction."""
    v = vectors(spark, sf_dir)
    h = F.conv(F.substring(F.sha2(F.col("sample_id").cast("string"), 256), 1, 8), 16, 10).cast("bigint")
    return v.select("sample_id", "label", "attack_category", ((h % 70 + F.col("label") * 30) / 100.0).alias("prob")).withColumn("pred", (F.col("prob") >= 0.5).cast("int"))


S = (
    V
    + """, s as (select sample_id, label, attack_category, prob, (prob >= 0.5)::int as pred from
  (select sample_id, label, attack_category, ((('0x' || substr(sha256(sample_id::varchar), 1, 8))::bigint % 70) + label * 30) / 100.0 as prob from v))"""
)


#: Parts of the vectors that stand for five embeddings.
PARTS = {n: (12 * i + 1, 12 * i + 12) for i, n in enumerate(("minilm", "bge_large", "instructor", "openai_small", "e5_mistral"))}


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold results of 20 combinations over the vectors: 5 folds, and one category left out at a time."""
    return materialize(centroids.experiment(vectors(spark, sf_dir), PARTS), "results")


_SUMS = ", ".join(f"sum((x - c{c}) * (x - c{c})) as e{c}, sum(abs(x - c{c})) as l{c}, sum(x * c{c}) as d{c}, sum(c{c} * c{c}) as n{c}" for c in (0, 1))
_MEANS = ", ".join(f"sum(s) filter (label = {c}) / sum(n) filter (label = {c}) as c{c}" for c in (0, 1))
R = (
    V
    + f""", vd as (select sample_id, label, attack_category, sample_id % 5 as m, unnest(generate_series(1, 64)) as k, unnest(embedding)::double as x from v),
  ef as (select 'standard_cv' as experiment, f::int as fold, null::varchar as held_out from range(5) t(f) union all select 'leave_out', (row_number() over (order by c) - 1)::int, c from (select distinct attack_category as c from v where label = 1 and attack_category is not null)),
  te as (select experiment, fold, held_out, sample_id, label from v, ef where case when experiment = 'standard_cv' then sample_id % 5 = fold else attack_category = held_out or (label = 0 and sample_id % 5 = fold) end),
  gs as (select label, attack_category, m, k, sum(x) as s, count(*) as n from vd group by 1, 2, 3, 4),
  ce as (select experiment, fold, k, {_MEANS} from gs, ef where case when experiment = 'standard_cv' then m <> fold when label = 0 then m <> fold else attack_category is distinct from held_out end group by 1, 2, 3),
  sc as (select experiment, [{', '.join(repr(n) for n in PARTS)}][((k - 1) // 12 + 1)::int] as embedding, fold, held_out, te.sample_id, te.label, {_SUMS} from te join vd using (sample_id) join ce using (experiment, fold, k) where k <= 60 group by 1, 2, 3, 4, 5, 6),
  pd as (select experiment, embedding, fold, held_out, label, unnest([{', '.join(repr(n) for n in centroids.RULES)}]) as classifier, unnest([{', '.join(centroids.RULES.values())}]) as yes from sc),
  pc as (select experiment, embedding, classifier, fold, held_out, count(*) filter (label = 1 and yes) as tp, count(*) filter (label = 0 and yes) as fp, count(*) filter (label = 1 and not yes) as fn, count(*) filter (label = 0 and not yes) as tn from pd group by 1, 2, 3, 4, 5),
  r as (select experiment, embedding, classifier, fold, held_out, (coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2.0::double * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2 as f1 from pc)"""
)

#: Normalized text in SQL; the bundled texts are in normal form already.
NORM = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
#: A hash rank in SQL.
HASH = "sha256('{seed}:' || {parts}sample_id)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged answers for two thirds of the injections without a category: line numbers, two answers for some, some unparsed."""
    u = labelled(spark, sf_dir).where("label = 1 and attack_category is null and sample_id % 3 <> 0")
    i = F.col("sample_id")
    one = u.select(T.hash16(F.col("text")).alias("sample_hash"), i.alias("line_no"), F.when(i % 5 != 0, "other").alias("category_slug"), F.when(i % 5 != 0, (i % 10) / 10.0).alias("confidence"))
    again = u.where("sample_id % 2 = 0").select(T.hash16(F.col("text")).alias("sample_hash"), (i + 1_000_000_000).alias("line_no"), F.lit("social_engineering").alias("category_slug"), F.lit(0.9).alias("confidence"))
    return one.unionByName(again)


LOG = r"""g as (select substr(sha256(text), 1, 16) as sample_hash, sample_id as line_no, case when sample_id % 5 <> 0 then 'other' end as category_slug, case when sample_id % 5 <> 0 then (sample_id % 10) / 10.0 end::double as confidence
  from u where label = 1 and attack_category is null and sample_id % 3 <> 0
  union all select substr(sha256(text), 1, 16), sample_id + 1000000000, 'social_engineering', 0.9::double from u where label = 1 and attack_category is null and sample_id % 3 <> 0 and sample_id % 2 = 0),
gl as (select sample_hash, arg_max({'c': category_slug, 'p': confidence}, line_no) as a from g group by 1)"""
