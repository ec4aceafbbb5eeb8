"""Queries on languages, labelling, locked splits and fitted classifiers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import profiles
from sievework.operators import dedup, eda, quality, reports, splits, taxonomy, trainers
from sievework.plans.model_plans import BENIGN, DELTA, KFOLD, LEAVE_OUT, MASTER, STRATUM
from sievework.plans.text_plans import CONF, GREEDY, SHINGLED, WORDS, six
from sievework.plans.views import NORM, R, S, U, labelled, results, scored, table, vectors

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _languages(rows: str, train: str) -> str:
    """CTEs that end in b (doc_id, best, top: scores from the highest, n: known trigrams) for rows (doc_id, lang, text)."""
    return rf"""t as (select doc_id, lang, ' ' || lower({NORM}) || ' ' as s from {rows} where {NORM} <> ''),
  g as (select doc_id, lang, substr(s, i, 3) as g from (select doc_id, lang, s, unnest(generate_series(1, length(s) - 2)) as i from t)),
  c as (select lang, g, count(*) as n from g where {train} and lang is not null group by 1, 2),
  k as (select distinct g from (select g, row_number() over (partition by lang order by n desc, g) as r from c) where r <= 1000),
  m as (select lang, sum(n) + (select count(*) from k) as total from c join k using (g) group by 1),
  p as (select m.lang, k.g, ln((coalesce(c.n, 0) + 1) / total::double) as w from m cross join k left join c on c.lang = m.lang and c.g = k.g),
  d as (select doc_id, g, count(*) as n from g join k using (g) group by 1, 2),
  s as (select doc_id, lang, sum(n * w) as score, sum(n) as n from d join p using (g) group by 1, 2),
  b as (select doc_id, arg_max(lang, score) as best, list_reverse_sort(list(score)) as top, any_value(n) as n from s group by 1)"""


SQL["harmonize"] = f"""with recursive {SHINGLED}{GREEDY.replace('jaccard >= 0.5', 'jaccard >= 0.9')},
  hk as (select sample_id as doc_id, lang, text from dd where not list_contains((select arg_max(dropped, k) from run), sample_id)), {_languages('hk', 'true')}
select doc_id as sample_id, case when top[1] - top[2] >= 0.02 * n then best else lang end as language, substr(sha256({NORM}), 1, 12) as norm12 from hk left join b using (doc_id)"""


@query(f"with {_languages('documents', 'doc_id % 4 <> 0')} select doc_id as sample_id, case when top[1] - top[2] >= 0.02 * n then best else 'unknown' end as detected from documents left join b using (doc_id)")
def language_detection(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles from three quarters of the documents, languages of all."""
    d = table(spark, sf, "documents")
    known = profiles.learn(d.where("doc_id % 4 <> 0"), language_col="lang")
    return profiles.identified(d, known, out="detected").select(F.col("doc_id").alias("sample_id"), "detected")


@query(f"with {S} select sample_id, case when sample_id % 11 = 0 or sample_id % 13 = 0 then 0 else pred end as pred, round(case when sample_id % 11 = 0 or sample_id % 13 = 0 then 0.5 else prob end, 6)::double as prob from s")
def zero_shot_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """A model's answers made from scores: most are JSON, some are not, some name no label."""
    i = F.col("sample_id")
    confidence = F.when(F.col("pred") == 1, F.col("prob")).otherwise(1 - F.col("prob"))
    label = F.when(i % 13 == 0, "maybe").when(F.col("pred") == 1, " Injection ").otherwise("BENIGN")
    raw = F.when(i % 11 == 0, "I cannot say").otherwise(F.to_json(F.struct(label.alias("label"), confidence.cast("string").alias("confidence"))))
    a = scored(spark, sf).select(i, taxonomy.zero_shot(raw).alias("a"))
    return a.select("sample_id", "a.pred", F.round("a.prob", 6).alias("prob"))


NEAR_WITHIN = rf"""inj as (select sample_id, attack_category, text, string_split(lower({NORM}), ' ') as w from u where label = 1 and attack_category is not null),
  sh as (select distinct sample_id, attack_category, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as g from (select *, unnest(generate_series(1, greatest(1, len(w) - 4))) as i from inj)),
  sc as (select sample_id, count(*) as n from sh group by 1),
  sp as (select x.sample_id as a, y.sample_id as b, count(*) as m from sh x join sh y on x.g = y.g and x.attack_category = y.attack_category and x.sample_id < y.sample_id group by 1, 2),
  e as (select a, b from sp join sc p on p.sample_id = a join sc q on q.sample_id = b where m / (p.n + q.n - m)::double >= 0.9),
  nodes as (select b as v, list(a order by a) as lower, row_number() over (order by b) as k from e group by b),
  run as (select 0::bigint as k, []::bigint[] as dropped union all
    select n.k, case when len(list_filter(n.lower, lambda x: not list_contains(run.dropped, x))) > 0 then list_append(run.dropped, n.v) else run.dropped end from run join nodes n on n.k = run.k + 1),
  kept as (select attack_category, text from inj where not list_contains((select arg_max(dropped, k) from run), sample_id)),
  mx as (select attack_category, count(*) as pre, count(*) filter ((attack_category, text) in (select (attack_category, text) from kept)) as post from inj group by 1)"""


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    u = labelled(spark, sf)
    return eda.feasibility_matrix(u, dedup.near_dedup_within(u.where("label = 1"), "attack_category"), 12)


@query(f"with recursive {U}, {NEAR_WITHIN} select attack_category, pre, post, post >= 12 as viable from mx")
def feasibility_near(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix(spark, sf)


@query(f"with recursive {U}, {NEAR_WITHIN} select count(*) filter (post >= 12) as n_viable, case when count(*) filter (post >= 12) >= 5 then 'A' when count(*) filter (post >= 12) >= 3 then 'B' else 'C' end as outcome from mx")
def feasibility_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return eda.outcome(_matrix(spark, sf))


LOCKED = f"""{U.replace('u as (', 'u0 as (', 1)}, u as (select * from u0 where label = 0 or attack_category is distinct from 'cat_0'), {KFOLD.replace(STRATUM, 'label')},
  {LEAVE_OUT.format(v='u', n=18).replace('where label = 1 and attack_category is not null', "where label = 1 and attack_category <> 'cat_3'")},
  roles as (select 'standard_cv' as experiment, f as fold, sample_id, case when fold = f then 'test' else 'train' end as role from kf, range(5) t(f)
    union all select 'leave_out', fold, sample_id, role from lo
    union all select 'direct_indirect', 0, sample_id, role from (select sample_id, case when coalesce(is_indirect, false) then 'test' else 'train' end as role from u where label = 1 union all {BENIGN})
    union all select 'crosslingual', 0, sample_id, role from (select sample_id, 'test' as role from u where language is distinct from 'en' union all select sample_id, 'train' from u where language = 'en' and label = 1 union all {BENIGN} and language = 'en'))"""


@query(f"with {LOCKED} select experiment, fold::int as fold, role, count(*) as n, count(*) filter (label = 1) as n_injections from roles join u using (sample_id) group by 1, 2, 3")
def locked_split_counts(spark: SparkSession, sf: str) -> DataFrame:
    u = labelled(spark, sf)
    return splits.split_counts(splits.locked_splits(u, 18, ("cat_0",), ("cat_3",)), u)


@query(f"""with {U}, c as (select source, {CONF} as c from u where source is not null), q as (select source, count(*) as total, count(*) filter (c < 0.3) / count(*)::double as low, avg(c) as mean from c group by 1)
select source, list_filter([case when low > 0.5 then 'low' end, case when mean < 0.4 then 'mean' end, case when total > 20 then 'many' end], lambda x: x is not null)::varchar as rules from q""")
def quality_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Which rules speak of each source."""
    c = F.col("confidence_score")
    per = quality.with_confidence(labelled(spark, sf).where("source is not null"), WORDS).groupBy("source").agg(F.count("*").alias("total"), (F.count_if(c < 0.3) / F.count("*")).alias("low"), F.avg(c).alias("mean"))
    said = F.concat_ws("|", quality.issues(F.col("total"), F.col("low"), F.col("mean"), 20))
    rules = F.filter(F.array(F.when(said.contains("confidence below"), "low"), F.when(said.contains("mean confidence"), "mean"), F.when(said.contains("cap the source"), "many")), lambda x: x.isNotNull())
    return per.select("source", F.concat(F.lit("["), F.array_join(rules, ", "), F.lit("]")).alias("rules"))


# ---- studies and fitted classifiers (these without SQL) ----


@query()
def run_experiment(spark: SparkSession, sf: str) -> DataFrame:
    """Logistic regression over the leave-one-out folds of the vectors, with all metrics."""
    out = trainers.leave_out(vectors(spark, sf), [("logreg", {})], 47)
    return out.select("fold", "held_out", *six("accuracy", "precision", "recall", "f1", "auc_roc", "auc_pr"))


@query(f"""with {R}, {MASTER}, {DELTA}, x as (select embedding || '/' || classifier as name, * from mt),
  p as (select embedding, classifier, a.f1 - b.f1 as d from (select * from r where experiment = 'standard_cv') a join (select * from r where experiment = 'leave_out') b using (embedding, classifier, fold)),
  t as (select embedding, classifier, avg(d) / (stddev_samp(d) / sqrt(count(*))) as t from p group by 1, 2), w as (select abs(t) / sqrt(4 + t * t) as w from t)
select count(*) as n_combinations, round(avg(cv_f1), 6) as mean_cv, round(avg(leave_out_f1), 6) as mean_leave_out, round(avg(delta_f1), 6) as mean_delta,
  (select name from x order by round(delta_f1, 9) desc, name desc limit 1) as largest_drop, (select name from x order by round(delta_f1, 9), name limit 1) as smallest_drop, (select held_out from dl order by round(mean_f1, 9), 1 limit 1) as hardest,
  (select count(*) from w where 1 - 1.5::double * w + 0.5::double * w * w * w < 0.05) as n_significant, (select count(*) from w) as n_tested from x""")
def study_findings(spark: SparkSession, sf: str) -> DataFrame:
    f = reports.findings(results(spark, sf))
    return f.select("n_combinations", *six("mean_cv", "mean_leave_out", "mean_delta"), "largest_drop", "smallest_drop", "hardest", "n_significant", "n_tested")


GRID = [("logreg", {}), ("logreg", {"c": 0.1}), ("svm", {}), ("xgboost", {}), ("mlp", {})]


@query()
def classifier_runs(spark: SparkSession, sf: str) -> DataFrame:
    """All classifiers and settings over the folds with a category left out and over five folds, fitted together."""
    v = vectors(spark, sf)
    named = {"leave_out": splits.leave_one_out(v, 47), "standard_cv": splits.fold_roles(splits.stratified_kfold(v, 5), 5)}
    out = trainers.run_experiments(v, named, GRID, embedding="bundled")
    return out.select("experiment", "classifier", "settings", "fold", "held_out", *six("accuracy", "precision", "recall", "f1", "auc_roc", "auc_pr"))


@query()
def generalization_gap(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    grid = [("logreg", {}), ("svm", {})]
    gap = trainers.generalization_gap(trainers.standard_cv(v, grid), trainers.leave_out(v, grid, 47))
    return gap.select("classifier", *six("cv_f1", "other_f1", "gap"))


@query()
def threshold_fit(spark: SparkSession, sf: str) -> DataFrame:
    """A classifier fitted on one side of a split, with its threshold metrics on the other."""
    v = vectors(spark, sf)
    split = v.select("sample_id", F.when(F.pmod("sample_id", F.lit(5)) == 0, "test").otherwise("train").alias("role"))
    return trainers.threshold_report(v, split, "logreg", "bundled")
