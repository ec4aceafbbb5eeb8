"""Queries on splits, samples, vectors, metrics and results, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import contamination, embeddings, metrics, results, splits
from sievework.plans.text_plans import six
from sievework.plans.views import HASH, R, S, U, V, labelled, scored, table, vectors
from sievework.plans.views import results as result_rows

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- splits and samples ----

STRATUM = "label || '_' || coalesce(attack_category, '_unknown')"
KFOLD = f"kf as (select sample_id, ((row_number() over (partition by {STRATUM} order by {HASH.format(seed=42, parts='')}, sample_id) - 1) % 5)::int as fold from u)"


@query(f"with {U}, {KFOLD} select sample_id, fold from kf")
def stratified_kfold(spark: SparkSession, sf: str) -> DataFrame:
    return splits.stratified_kfold(labelled(spark, sf))


LEAVE_OUT = """big as (select attack_category as c from {v} where label = 1 and attack_category is not null group by 1 having count(*) >= {n}),
  folds as (select (row_number() over (order by c) - 1)::int as fold, c as held_out from big),
  lo as (select fold, held_out, sample_id, case when attack_category is not distinct from held_out then 'test' else 'train' end as role from {v}, folds where label = 1
    union all select fold, held_out, sample_id, case when row_number() over (partition by fold order by sha256('42:' || fold || ':' || sample_id), sample_id) <= greatest(1, floor((select count(*) from {v} where label = 0) * 0.2)) then 'test' else 'train' end from {v}, folds where label = 0)"""
LEAVE_OUT_U, LEAVE_OUT_V = LEAVE_OUT.format(v="u", n=18), LEAVE_OUT.format(v="v", n=47)


@query(f"with {U}, {LEAVE_OUT_U} select fold, held_out, sample_id, role from lo")
def leave_one_category_out(spark: SparkSession, sf: str) -> DataFrame:
    return splits.leave_one_out(labelled(spark, sf), 18)


@query(f"with {V}, {LEAVE_OUT_V} select fold, held_out, sample_id, role from lo")
def leave_one_category_out_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return splits.leave_one_out(vectors(spark, sf), 47)


BENIGN = "select sample_id, case when row_number() over (order by sha256('42:' || sample_id), sample_id) <= greatest(1, floor(count(*) over () * 0.2)) then 'test' else 'train' end as role from u where label = 0"


@query(f"with {U} select sample_id, case when coalesce(is_indirect, false) then 'test' else 'train' end as role from u where label = 1 union all {BENIGN}")
def direct_indirect_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.direct_indirect(labelled(spark, sf))


@query(f"with {U} select sample_id, 'test' as role from u where language is distinct from 'en' union all select sample_id, 'train' from u where language = 'en' and label = 1 union all {BENIGN} and language = 'en'")
def crosslingual_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.crosslingual(labelled(spark, sf))


@query(f"with {U}, {LEAVE_OUT_U} select fold, count(*) filter (role = 'train') as n_train, count(*) filter (role = 'test') as n_test, 0::bigint as in_both from lo group by 1")
def split_disjointness(spark: SparkSession, sf: str) -> DataFrame:
    return splits.overlap(splits.leave_one_out(labelled(spark, sf), 18))


@query("select doc_id as sample_id from documents")
def cv_test_union(spark: SparkSession, sf: str) -> DataFrame:
    return splits.test_union(splits.fold_roles(splits.stratified_kfold(labelled(spark, sf)), 5))


@query(f"with {U}, {KFOLD}, {LEAVE_OUT_U} select 'standard_cv' as experiment, fold, 'test' as role, count(*) as n from kf group by 2 union all select 'standard_cv', fold, 'train', (select count(*) from kf) - count(*) from kf group by 2 union all select 'leave_out', fold, role, count(*) from lo group by 2, 3"
       f" union all select 'direct_indirect', 0, role, count(*) from (select case when coalesce(is_indirect, false) then 'test' else 'train' end as role from u where label = 1 union all select role from ({BENIGN})) group by 3"
       f" union all select 'crosslingual', 0, role, count(*) from (select 'test' as role from u where language is distinct from 'en' union all select 'train' from u where language = 'en' and label = 1 union all select role from ({BENIGN} and language = 'en')) group by 3")  # fmt: skip
def all_splits(spark: SparkSession, sf: str) -> DataFrame:
    return splits.all_splits(labelled(spark, sf), 18).groupBy("experiment", "fold", "role").agg(F.count("*").alias("n"))


@query(f"""with {U}, d as (select sample_id, {STRATUM} as stratum, row_number() over (partition by {STRATUM} order by {HASH.format(seed=42, parts='')}, sample_id) as r, count(*) over (partition by {STRATUM}) as size, count(*) over () as pool from u)
select sample_id, stratum from d order by case when r <= least(size, greatest(1, round_even(size * 100.0::double / pool, 0))) then 0 else 1 end, {HASH.format(seed=42, parts='')}, sample_id limit 100""")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return splits.stratified_sample(labelled(spark, sf), 100)


# ---- vectors ----

NEAR = """near as (select * from (select a.sample_id as test_id, b.sample_id as train_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as similarity from v a join v b on a.sample_id % 5 = 0 and b.sample_id % 5 <> 0)
  qualify row_number() over (partition by test_id order by round(similarity, 12) desc, train_id) = 1)"""


@query(f"with {V}, {NEAR} select test_id, train_id, round(similarity, 6) as similarity from near where similarity >= 0.4")
def knn_semantic_flags(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return contamination.semantic(v.where("sample_id % 5 <> 0"), v.where("sample_id % 5 = 0"), 0.4).select("test_id", "train_id", *six("similarity"))


@query(f"with {V}, s as (select a.attack_category as held_out, a.sample_id, max(list_cosine_similarity(a.embedding::double[], b.embedding::double[])) as m from v a join v b on a.attack_category is not null and b.attack_category is distinct from a.attack_category group by 1, 2) select held_out, round(avg(m), 6) as homogeneity from s group by 1")
def template_homogeneity(spark: SparkSession, sf: str) -> DataFrame:
    """Each category against all other rows, in one job."""
    v = vectors(spark, sf)
    held = v.where("attack_category is not null").select(F.col("attack_category").alias("held_out"))
    test = v.where("attack_category is not null").withColumn("held_out", F.col("attack_category"))
    train = v.join(F.broadcast(held.distinct()), ~F.col("attack_category").eqNullSafe(F.col("held_out")))
    return contamination.nearest(train, test, by="held_out").groupBy("held_out").agg(F.avg("similarity").alias("homogeneity")).select("held_out", *six("homogeneity"))


CENTRE = "p as (select attack_category, unnest(generate_series(1, 64)) as k, unnest(embedding)::double as x from v where label = 1), m as (select attack_category, k, avg(x) as x from p group by 1, 2), c as (select attack_category, list(x order by k) as x from m group by 1)"


@query(f"with {V}, {CENTRE} select a.attack_category as a, b.attack_category as b, round(case when a.attack_category = b.attack_category then 0 else 1 - list_cosine_similarity(a.x, b.x) end, 6)::double as distance from c a, c b")
def centroid_distance(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.centroid_distances(vectors(spark, sf)).select("a", "b", *six("distance"))


# ---- metrics ----

CELLS = "count(*) filter (label = 1 and pred = 1) as tp, count(*) filter (label = 0 and pred = 1) as fp, count(*) filter (label = 1 and pred = 0) as fn, count(*) filter (label = 0 and pred = 0) as tn"
F1 = "(coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2.0::double * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2"
BUNDLE = f"round((tp + tn) / (tp + fp + fn + tn)::double, 6) as accuracy, round(coalesce(tp / nullif(tp + fp, 0)::double, 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0)::double, 0), 6) as recall, round({F1}, 6) as f1"
AUC = "(select round((sum(case when a.prob > b.prob then 1.0 when a.prob = b.prob then 0.5 else 0 end) / count(*))::double, 6) from s a, s b where a.label = 1 and b.label = 0)"
PR = "cum as (select prob, p, sum(p) over w as tp, sum(n) over w as fp, sum(p) over () as pos, sum(n) over () as neg from (select prob, count(*) filter (label = 1) as p, count(*) filter (label = 0) as n from s group by 1) window w as (order by prob desc rows unbounded preceding))"
AP = "(select round(sum(p / pos::double * tp / (tp + fp)), 6) from cum)"


@query(f"with {S}, c as (select {CELLS} from s), {PR} select {BUNDLE}, {AUC} as auc_roc, {AP} as auc_pr from c")
def classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.evaluate(scored(spark, sf)).select(*six("accuracy", "precision", "recall", "f1", "auc_roc", "auc_pr"))


@query(f"with {S}, f as (select *, sample_id % 3 as part from s), c as (select part, {CELLS} from f group by 1) select part, {BUNDLE} from c")
def metrics_by_group(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.evaluate(scored(spark, sf).withColumn("part", F.col("sample_id") % 3), ["part"])
    return m.select("part", *six("accuracy", "precision", "recall", "f1"))


@query(f"with {S} select {AUC} as auc_roc")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.auc_roc(scored(spark, sf)).select(*six("auc_roc"))


@query(f"with {S}, {PR} select {AP} as auc_pr")
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.average_precision(scored(spark, sf)).select(*six("auc_pr"))


@query(f"with {S}, {PR} select round(prob, 6)::double as prob, tp::bigint as tp, fp::bigint as fp, round(tp / pos::double, 6) as recall, round(fp / neg::double, 6) as fpr, round(tp / (tp + fp)::double, 6) as precision from cum")
def roc_pr_curve(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.curve(scored(spark, sf)).select(*six("prob"), "tp", "fp", *six("recall", "fpr", "precision"))


@query(f"with {S} select label, pred, count(*) as n, round(count(*) * 100.0 / (select count(*) from s), 6)::double as percent from s group by 1, 2")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(scored(spark, sf)).select("label", "pred", "n", *six("percent"))


def _best(rows: str) -> str:
    return f"""t as (select i * (0.98::double / 199) + 0.01::double as threshold from range(200) r(i)),
  x as (select threshold, count(*) filter (label = 1 and prob::double >= threshold) as tp, count(*) filter (label = 0 and prob::double >= threshold) as fp, count(*) filter (label = 1 and prob::double < threshold) as fn, count(*) filter (label = 0 and prob::double < threshold) as tn from t, {rows} group by 1),
  best as (select threshold, {F1} as f1 from x order by f1 desc, threshold limit 1)"""


@query(f"with {S}, {_best('s')} select round(threshold, 6) as threshold, round(f1, 6) as f1 from best")
def oracle_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.best_threshold(scored(spark, sf)).select(*six("threshold", "f1"))


CAL = "h as (select *, row_number() over (order by sha256('42:' || sample_id), sample_id) <= greatest(floor(count(*) over () * 0.1), 10) as calibration from s)"


@query(f"with {S}, {CAL}, {_best('(select * from h where calibration)')}, c as (select count(*) filter (label = 1 and y) as tp, count(*) filter (label = 0 and y) as fp, count(*) filter (label = 1 and not y) as fn, count(*) filter (label = 0 and not y) as tn from (select label, prob::double >= (select threshold from best) as y from h where not calibration)) select (select round(threshold, 6) from best) as threshold, {BUNDLE} from c")
def calibrated_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.calibrated(scored(spark, sf)).select(*six("threshold", "accuracy", "precision", "recall", "f1"))


@query(f"with {S} select round(avg(prob) filter (sample_id % 5 <> 0), 6)::double as train_mean, round(avg(prob) filter (sample_id % 5 = 0), 6)::double as test_mean, round(avg(prob) filter (sample_id % 5 = 0) - avg(prob) filter (sample_id % 5 <> 0), 6)::double as shift from s where label = 1")
def score_shift(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    return metrics.score_shift(s.where("sample_id % 5 <> 0"), s.where("sample_id % 5 = 0")).select(*six("train_mean", "test_mean", "shift"))


@query()
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.bootstrap(scored(spark, sf)).select(*six(*(f"{m}{s}" for m in metrics.SIX for s in ("", "_lower", "_upper"))))


@query(f"with {U}, n as (select attack_category, count(*) as n from u where label = 1 and attack_category is not null group by 1) select attack_category, n from n where n < 1000 and attack_category <> 'cat_0'")
def training_only_categories(spark: SparkSession, sf: str) -> DataFrame:
    return splits.categories_left(labelled(spark, sf), 1000, ("cat_0",))


@query(f"with {U}, p as (select sample_id, row_number() over (order by {HASH.format(seed=42, parts='')}, sample_id) as r from u) select sample_id, label, attack_category from u join p using (sample_id) where r <= 500")
def plot_points(spark: SparkSession, sf: str) -> DataFrame:
    return splits.plot_sample(labelled(spark, sf), 500).select("sample_id", "label", "attack_category")


TEST = "st as (select * from s where sample_id % 5 = 0)"
TEST_CAL = CAL.replace("from s)", "from st)")


@query(f"""with {S}, {TEST}, {TEST_CAL}, {_best('st')}, {_best('(select * from h where calibration)').replace('t as (', 't2 as (').replace('x as (', 'x2 as (').replace('best as (', 'best2 as (').replace('from t,', 'from t2,').replace('from x ', 'from x2 ')},
  c as (select count(*) filter (label = 1 and y) as tp, count(*) filter (label = 0 and y) as fp, count(*) filter (label = 1 and not y) as fn, count(*) filter (label = 0 and not y) as tn from (select label, prob::double >= (select threshold from best2) as y from h where not calibration)),
  u as (select {CELLS} from st), {PR.replace('from s group', 'from st group')}
select 'minilm' as embedding, 'logreg' as classifier, (select round({F1}, 6) from u) as uncalibrated_f1, (select round(f1, 6) from best) as oracle_f1, (select round(threshold, 6) from best) as oracle_threshold, (select round({F1}, 6) from c) as calibrated_f1,
  {AUC.replace('from s a, s b', 'from st a, st b')} as auc_roc, {AP} as auc_pr, (select round(avg(prob) filter (sample_id % 5 = 0) - avg(prob) filter (sample_id % 5 <> 0), 6)::double from s where label = 1) as score_shift""")
def threshold_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    one = results.threshold_analysis(s.where("sample_id % 5 <> 0"), s.where("sample_id % 5 = 0")).select(F.lit("minilm").alias("embedding"), F.lit("logreg").alias("classifier"), "*")
    return results.threshold_summary(one).select("embedding", "classifier", *six("uncalibrated_f1", "oracle_f1", "oracle_threshold", "calibrated_f1", "auc_roc", "auc_pr", "score_shift"))


@query("with t as (select doc_id as sample_id, text from documents), k as (select text, min(sample_id) as of_id, count(*) as n from t group by 1) select sample_id, of_id, n from t join k using (text)")
def embedding_lookup(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), "text")
    k = t.groupBy("text").agg(F.min("sample_id").alias("of_id"), F.count("*").alias("n"))
    return embeddings.by_text(t, lambda texts: texts.join(k, "text")).select("sample_id", "of_id", "n")


@query("select doc_id, 'Represent this: ' || text as prefixed, 'Instruct: ' || text || ' End' as templated from documents where text is not null")
def embedding_prompts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", embeddings.prefixed(F.col("text"), "Represent this: ").alias("prefixed"), embeddings.templated(F.col("text"), "Instruct: {text} End").alias("templated"))


# ---- results ----

MASTER = """ms as (select experiment, embedding, classifier, avg(f1) as f, stddev_pop(f1) as sd from r group by 1, 2, 3),
  mt as (select embedding, classifier, c.f as cv_f1, c.sd as cv_std, l.f as leave_out_f1, l.sd as leave_out_std, c.f - l.f as delta_f1 from (select * from ms where experiment = 'standard_cv') c full join (select * from ms where experiment = 'leave_out') l using (embedding, classifier))"""


@query(f"with {R}, {MASTER} select embedding, classifier, round(cv_f1, 6) as cv_f1, round(cv_std, 6) as cv_std, round(leave_out_f1, 6) as leave_out_f1, round(leave_out_std, 6) as leave_out_std, round(delta_f1, 6) as delta_f1 from mt")
def master_table(spark: SparkSession, sf: str) -> DataFrame:
    return results.enumerated(results.master_table(result_rows(spark, sf))).select("embedding", "classifier", *six("cv_f1", "cv_std", "leave_out_f1", "leave_out_std", "delta_f1"))


CATS = [f"cat_{i}" for i in range(5)]


@query(f"with {R} select embedding, classifier, {', '.join(f'round(max(f1) filter (held_out = {c!r}), 6) as {c}' for c in CATS)}, round(avg(f1), 6) as mean from r where experiment = 'leave_out' group by 1, 2")
def per_fold_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return results.per_fold(result_rows(spark, sf), CATS).select("embedding", "classifier", *six(*CATS, "mean"))


@query(f"with {R}, {MASTER} select embedding, {', '.join(f'round(max(delta_f1) filter (classifier = {c!r}), 6) as {c}' for c in results.CLASSIFIERS)} from mt group by 1")
def delta_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return results.heatmap(result_rows(spark, sf), results.CLASSIFIERS).select("embedding", *six(*results.CLASSIFIERS))


@query(f"with {R}, {MASTER} select embedding, classifier, 'cv_f1' as experiment, round(cv_f1, 6) as f1 from mt union all select embedding, classifier, 'leave_out_f1', round(leave_out_f1, 6) from mt")
def melted_results(spark: SparkSession, sf: str) -> DataFrame:
    return results.melted(result_rows(spark, sf)).select("embedding", "classifier", "experiment", *six("f1"))


DELTA = "dl as (select held_out, avg(cv.f - r.f1) as delta_f1, avg(r.f1) as mean_f1, count(*) as n from r join ms cv on cv.experiment = 'standard_cv' and cv.embedding = r.embedding and cv.classifier = r.classifier where r.experiment = 'leave_out' group by 1)"


@query(f"with {R}, {MASTER}, {DELTA} select held_out, round(delta_f1, 6) as delta_f1, round(mean_f1, 6) as mean_f1, n from dl")
def delta_f1(spark: SparkSession, sf: str) -> DataFrame:
    return results.delta_by_category(result_rows(spark, sf)).select("held_out", *six("delta_f1", "mean_f1"), "n")


@query(f"""with {R}, {MASTER}, {DELTA} select (select round(avg(cv_f1), 6) from mt) as mean_cv, (select round(avg(leave_out_f1), 6) from mt) as mean_leave_out, (select round(avg(delta_f1), 6) from mt) as mean_delta,
  (select embedding || '/' || classifier from mt order by round(leave_out_f1, 9) desc, 1 desc limit 1) as best, (select embedding || '/' || classifier from mt order by round(leave_out_f1, 9), 1 limit 1) as worst,
  (select held_out from dl order by round(mean_f1, 9), 1 limit 1) as hardest, (select held_out from dl order by round(mean_f1, 9) desc, 1 desc limit 1) as easiest""")
def hardest_category(spark: SparkSession, sf: str) -> DataFrame:
    return results.extremes(result_rows(spark, sf)).select(*six("mean_cv", "mean_leave_out", "mean_delta"), "best", "worst", "hardest", "easiest")


@query(f"""with {R}, p as (select embedding, classifier, a.f1 - b.f1 as d from (select * from r where experiment = 'standard_cv') a join (select * from r where experiment = 'leave_out') b using (embedding, classifier, fold))
select embedding, classifier, count(*) as n, round(avg(d), 6) as mean_difference, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) as t from p group by 1, 2""")
def paired_t(spark: SparkSession, sf: str) -> DataFrame:
    return results.paired(result_rows(spark, sf)).select("embedding", "classifier", "n", *six("mean_difference", "t"))


@query(f"""with {R}, p as (select embedding, classifier, a.f1 - b.f1 as d from (select * from r where experiment = 'standard_cv') a join (select * from r where experiment = 'leave_out') b using (embedding, classifier, fold)),
  t as (select embedding, classifier, count(*) as n, avg(d) / (stddev_samp(d) / sqrt(count(*))) as t from p group by 1, 2),
  w as (select *, abs(t) / sqrt(4 + t * t) as w from t)
select embedding, classifier, n, round(t, 6) as statistic, round(1 - 1.5::double * w + 0.5::double * w * w * w, 6) as p_value, 'paired_t' as test, 1 - 1.5::double * w + 0.5::double * w * w * w < 0.05 as significant from w""")
def significance_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Five pairs have four degrees of freedom, for which the p value has a closed form in SQL."""
    return results.significance(result_rows(spark, sf)).select("embedding", "classifier", "n", *six("statistic", "p_value"), "test", "significant")


@query(f"with {R}, {MASTER} select round(regr_slope(delta_f1, cv_f1), 6) as slope, round(regr_intercept(delta_f1, cv_f1), 6) as intercept, round(corr(delta_f1, cv_f1), 6) as r, round(regr_r2(delta_f1, cv_f1), 6) as r2, regr_count(delta_f1, cv_f1)::bigint as n from mt")
def linear_regression(spark: SparkSession, sf: str) -> DataFrame:
    return results.regression(results.master_table(result_rows(spark, sf)), "cv_f1", "delta_f1").select(*six("slope", "intercept", "r", "r2"), "n")


#: The scored predictions stand for a language model's, on all rows and on every fifth.
LLM = f"""la as (select 'standard_cv' as test_pool, {F1} as f1 from (select {CELLS} from s) union all select 'direct_indirect', {F1} from (select {CELLS} from s where sample_id % 5 = 0))"""
POOLS = f"""{S[len(V) + 2:]}, {LLM}, cl as (select case when experiment = 'standard_cv' then 'standard_cv' else 'direct_indirect' end as test_pool, embedding, classifier, avg(f1) as f1 from r group by 1, 2, 3),
  bc as (select test_pool, embedding || '/' || classifier as system, f1 from cl qualify row_number() over (partition by test_pool order by round(f1, 12) desc, embedding || '/' || classifier desc) = 1),
  bj as (select bc.test_pool, bc.system, bc.f1 as own, la.f1 as llm from bc join la using (test_pool))"""


def _pools(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    pool = F.when(F.col("experiment") == "standard_cv", "standard_cv").otherwise("direct_indirect").alias("test_pool")
    own = result_rows(spark, sf).groupBy(pool, "embedding", "classifier").agg(F.avg("f1").alias("f1"))
    s = scored(spark, sf)
    llm = [metrics.evaluate(d).select(F.lit(n).alias("test_pool"), "f1") for n, d in (("standard_cv", s), ("direct_indirect", s.where("sample_id % 5 = 0")))]
    return own, llm[0].unionByName(llm[1])


@query(f"""with {R}, {POOLS} select test_pool, system, round(own, 6) as f1, 0.000001::double as cost_per_query, case when own > llm then 'classifier' else 'llm' end as winner, round(abs(own - llm), 6) as f1_gap from bj
  union all select test_pool, 'llm', round(llm, 6), 0.0008::double, case when own > llm then 'classifier' else 'llm' end, round(abs(own - llm), 6) from bj""")
def comparison_table(spark: SparkSession, sf: str) -> DataFrame:
    return results.comparison(*_pools(spark, sf)).select("test_pool", "system", *six("f1"), "cost_per_query", "winner", *six("f1_gap"))


@query(f"""with {R}, {POOLS}, {CAL}, {_best('(select * from h where calibration)')}, c as (select count(*) filter (label = 1 and y) as tp, count(*) filter (label = 0 and y) as fp, count(*) filter (label = 1 and not y) as fn, count(*) filter (label = 0 and not y) as tn from (select label, prob::double >= (select threshold from best) as y from h where not calibration))
select case when test_pool = 'standard_cv' then 'known' else 'novel' end as regime, case when test_pool = 'standard_cv' then 0 else 1 end as place, round(own, 6) as classifier_f1, round(llm, 6) as llm_f1 from bj
  union all select 'novel, calibrated', 2, (select round({F1}, 6) from c), (select round(f1, 6) from la where test_pool = 'direct_indirect')""")
def regime_data(spark: SparkSession, sf: str) -> DataFrame:
    cal = metrics.calibrated(scored(spark, sf)).select(F.col("f1").alias("calibrated_f1"))
    return results.regimes(*_pools(spark, sf), cal).select("regime", "place", *six("classifier_f1", "llm_f1"))


CURVE = f"{POOLS}, le as (select own, llm from bj where test_pool = 'direct_indirect'), cu as (select i / 49.0::double as rate, 0.000001::double + i / 49.0::double * 0.0008::double as cost, (1 - i / 49.0::double) * own + i / 49.0::double * llm as f1 from range(50) t(i), le)"


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    return results.regimes(*_pools(spark, sf)).where("regime = 'novel'")


@query(f"with {R}, {CURVE} select round(rate, 6) as rate, round(cost, 9) as cost, round(f1, 6) as f1 from cu")
def defense_curve(spark: SparkSession, sf: str) -> DataFrame:
    return results.defense_curve(_levels(spark, sf)).select(*six("rate"), F.round("cost", 9).alias("cost"), *six("f1"))


@query(f"with {R}, {CURVE} select target::double as target, round(max(rate), 6) as rate, round(arg_max(cost, rate), 9) as cost, round(arg_max(f1, rate), 6) as f1 from cu, (values (0.1), (0.25), (0.5), (1.0)) t(target) where abs(rate - target) < 0.02 group by 1")
def escalation_points(spark: SparkSession, sf: str) -> DataFrame:
    return results.escalation_points(results.defense_curve(_levels(spark, sf))).select("target", *six("rate"), F.round("cost", 9).alias("cost"), *six("f1"))


@query(f"with {S}, c as (select {CELLS} from s) select round_even(1 - tp / (tp + fp)::double, 4) as false_discovery, round_even(1 - tp / (tp + fn)::double, 4) as miss_rate from c")
def error_interpretation(spark: SparkSession, sf: str) -> DataFrame:
    return results.interpretation(metrics.evaluate(scored(spark, sf))).select("false_discovery", "miss_rate")


@query("select count(*) as n_calls, sum(length(text))::bigint as input_tokens, sum(turn)::bigint as output_tokens, round(sum(length(text)) * 2.5::double / 1e6 + sum(turn) * 10.0::double / 1e6, 9) as cost from conversations")
def usage_cost(spark: SparkSession, sf: str) -> DataFrame:
    calls = spark.read.parquet(f"{sf}/conversations.parquet").select(F.length("text").cast("bigint").alias("input_tokens"), F.col("turn").alias("output_tokens"))
    return results.usage_cost(calls, 2.5, 10.0).select("n_calls", "input_tokens", "output_tokens", F.round("cost", 9).alias("cost"))


@query(f"with {R} select embedding, classifier, fold, round(f1 + case when fold = 2 then 0.002 else 0.0001 end::double, 6) as now, round(f1, 6) as was, fold = 2 as differs from r where experiment = 'leave_out'")
def replay_check(spark: SparkSession, sf: str) -> DataFrame:
    r = result_rows(spark, sf).where("experiment = 'leave_out'")
    again = r.withColumn("f1", F.col("f1") + F.when(F.col("fold") == 2, 0.002).otherwise(0.0001))
    return results.replay_check(again, r).select("embedding", "classifier", "fold", *six("now", "was"), "differs")
