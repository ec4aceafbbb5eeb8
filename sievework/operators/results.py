"""Tables derived from experiment results: rows (experiment, embedding, classifier, fold, held_out, f1, …)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators import metrics
from sievework.operators.metrics import t_p_value, wilcoxon_p_value

# The order of rows in result tables, and costs of a query.
EMBEDDINGS = ["minilm", "bge_large", "instructor", "openai_small", "e5_mistral"]
CLASSIFIERS = ["logreg", "svm", "xgboost", "mlp"]
CLASSIFIER_COST = 0.000001
LLM_COST = 0.0008
KEY = ["embedding", "classifier"]


def enumerated(df: DataFrame) -> DataFrame:
    """Rows in the order of the two lists; unlisted names come last, by name."""
    place = lambda names, c: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col(c)), F.lit(0)), F.lit(len(names) + 1))
    return df.orderBy(place(EMBEDDINGS, "embedding"), place(CLASSIFIERS, "classifier"), *KEY)


def summaries(folds: DataFrame) -> DataFrame:
    """Mean and population deviation of the folds' F1, for each experiment and combination."""
    return folds.groupBy("experiment", *KEY).agg(F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1"), F.count("*").alias("n_folds"))


def master_table(folds: DataFrame, left: str = "standard_cv", right: str = "leave_out") -> DataFrame:
    """Both experiments side by side and the drop; a missing side is null."""
    s = summaries(folds)
    one = lambda e, n: s.where(F.col("experiment") == e).select(*KEY, F.col("mean_f1").alias(f"{n}_f1"), F.col("std_f1").alias(f"{n}_std"))
    return one(left, "cv").join(one(right, "leave_out"), KEY, "full_outer").withColumn("delta_f1", F.col("cv_f1") - F.col("leave_out_f1"))


def per_fold(folds: DataFrame, categories: list[str], experiment: str = "leave_out") -> DataFrame:
    """One column for each held-out category, and their mean."""
    p = folds.where(F.col("experiment") == experiment).groupBy(*KEY).pivot("held_out", categories).agg(F.first("f1"))
    m = folds.where(F.col("experiment") == experiment).groupBy(*KEY).agg(F.avg("f1").alias("mean"))
    return p.join(m, KEY)


def heatmap(folds: DataFrame, classifiers: list[str], left: str = "standard_cv", right: str = "leave_out") -> DataFrame:
    return master_table(folds, left, right).groupBy("embedding").pivot("classifier", classifiers).agg(F.first("delta_f1"))


def melted(folds: DataFrame, left: str = "standard_cv", right: str = "leave_out") -> DataFrame:
    m = master_table(folds, left, right)
    return m.unpivot(KEY, ["cv_f1", "leave_out_f1"], "experiment", "f1")


def delta_by_category(folds: DataFrame, left: str = "standard_cv", right: str = "leave_out") -> DataFrame:
    """For each category held out: the mean over combinations of the CV mean less that fold's F1."""
    cv = folds.where(F.col("experiment") == left).groupBy(*KEY).agg(F.avg("f1").alias("cv"))
    return folds.where(F.col("experiment") == right).join(cv, KEY).groupBy("held_out").agg(F.avg(F.col("cv") - F.col("f1")).alias("delta_f1"), F.avg("f1").alias("mean_f1"), F.count("*").alias("n"))


def extremes(folds: DataFrame, left: str = "standard_cv", right: str = "leave_out") -> DataFrame:
    """Overall means; best and worst combination; hardest and easiest category (first by name on ties)."""
    m, d = master_table(folds, left, right), delta_by_category(folds, left, right)
    name = F.concat_ws("/", *KEY)
    top = lambda d, what, by, up: (F.min_by if up else F.max_by)(what, F.struct(by, what) if up else F.struct(by, what))
    a = m.agg(F.avg("cv_f1").alias("mean_cv"), F.avg("leave_out_f1").alias("mean_leave_out"), F.avg("delta_f1").alias("mean_delta"), top(m, name, F.col("leave_out_f1"), False).alias("best"), top(m, name, F.col("leave_out_f1"), True).alias("worst"))
    return a.crossJoin(d.agg(top(d, F.col("held_out"), F.col("mean_f1"), True).alias("hardest"), top(d, F.col("held_out"), F.col("mean_f1"), False).alias("easiest")))


def paired(folds: DataFrame, left: str = "standard_cv", right: str = "leave_out") -> DataFrame:
    """CV and LEAVE_OUT folds of a combination paired by place, up to the shorter: n, mean difference, t statistic of the paired test (null below two pairs or without variance)."""
    arr = lambda e, n: folds.where(F.col("experiment") == e).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("fold", "f1"))).alias(n))
    j = arr(left, "a").join(arr(right, "b"), KEY)
    d = j.select(*KEY, F.posexplode(F.expr("transform(sequence(0, least(size(a), size(b)) - 1), i -> a[i].f1 - b[i].f1)")).alias("place", "d"))
    s = d.groupBy(*KEY).agg(F.count("*").alias("n"), F.avg("d").alias("mean_difference"), F.stddev_samp("d").alias("sd"), F.array_sort(F.collect_list(F.struct("place", "d"))).alias("pairs"))
    return s.withColumn("t", F.when(F.col("n") >= 2, F.col("mean_difference") / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0))))


def significance(folds: DataFrame, level: float = 0.05, left: str = "standard_cv", right: str = "leave_out") -> DataFrame:
    """p values over the (few) combinations: signed ranks from six pairs on, else the paired t test; fewer than two pairs are left out."""
    rows = []
    for r in paired(folds, left, right).where("n >= 2").collect():
        if r.n >= 6:
            stat, p, test = *wilcoxon_p_value([x.d for x in r.pairs]), "wilcoxon"
        elif r.t is None:
            stat, p, test = 0.0, 1.0, "paired_t"
        else:
            stat, p, test = r.t, t_p_value(r.t, r.n - 1), "paired_t"
        rows.append((r.embedding, r.classifier, r.n, float(stat), float(p), test, bool(p < level)))
    return folds.sparkSession.createDataFrame(rows, "embedding string, classifier string, n bigint, statistic double, p_value double, test string, significant boolean")


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares of y on x: slope, intercept, r, r2, n."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def regression_p_value(r: float, n: int) -> float:
    """Two-sided p value of a slope with correlation r over n points."""
    if n < 3 or abs(r) >= 1:
        return 0.0 if n >= 3 else 1.0
    return t_p_value(r * ((n - 2) / (1 - r * r)) ** 0.5, n - 2)


def comparison(classifiers: DataFrame, llm: DataFrame) -> DataFrame:
    """The best classifier of each pool beside the language model: winner (the classifier only if it is ahead) and gap."""
    best = classifiers.groupBy("test_pool").agg(F.max_by(F.struct(F.concat_ws("/", *KEY).alias("system"), "f1"), F.struct(F.col("f1"), F.concat_ws("/", *KEY))).alias("b")).select("test_pool", "b.*", F.lit(CLASSIFIER_COST).alias("cost_per_query"), F.lit(True).alias("own"))
    both = best.unionByName(llm.select("test_pool", F.lit("llm").alias("system"), "f1", F.lit(LLM_COST).alias("cost_per_query"), F.lit(False).alias("own")))
    w = Window.partitionBy("test_pool")
    gap = F.max(F.when(F.col("own"), F.col("f1"))).over(w) - F.max(F.when(~F.col("own"), F.col("f1"))).over(w)
    return both.select("test_pool", "system", "f1", "cost_per_query", F.when(gap > 0, "classifier").otherwise("llm").alias("winner"), F.abs(gap).alias("f1_gap"))


def regimes(classifiers: DataFrame, llm: DataFrame, calibrated: DataFrame | None = None) -> DataFrame:
    """Best classifier and language model on known and novel inputs, and with calibrated thresholds where there are any."""
    best = classifiers.groupBy("test_pool").agg(F.max("f1").alias("classifier_f1")).join(llm.select("test_pool", F.col("f1").alias("llm_f1")), "test_pool")
    order: Column = F.when(F.col("test_pool") == "standard_cv", 0).otherwise(1)
    out = best.select(F.when(order == 0, "known").otherwise("novel").alias("regime"), order.alias("place"), "classifier_f1", "llm_f1")
    if calibrated is not None:
        novel = llm.where("test_pool = 'direct_indirect'").select(F.col("f1").alias("llm_f1"))
        cal = calibrated.agg(F.max("calibrated_f1").alias("classifier_f1")).where("classifier_f1 is not null").crossJoin(novel)
        out = out.unionByName(cal.select(F.lit("novel, calibrated").alias("regime"), F.lit(2).alias("place"), "classifier_f1", "llm_f1"))
    return out


def defense_curve(levels: DataFrame, points: int = 50) -> DataFrame:
    """Cost and F1 when a share of inputs goes on to the language model, from one row (classifier_f1, llm_f1)."""
    e = F.col("id") / float(points - 1)
    f1 = (1 - e) * F.col("classifier_f1") + e * F.col("llm_f1")
    return levels.sparkSession.range(points).crossJoin(F.broadcast(levels.select("classifier_f1", "llm_f1").limit(1))).select(e.alias("rate"), (F.lit(CLASSIFIER_COST) + e * LLM_COST).alias("cost"), f1.alias("f1"))


def escalation_points(curve: DataFrame, rates: tuple[float, ...] = (0.1, 0.25, 0.5, 1.0), within: float = 0.02) -> DataFrame:
    """The last point of the curve near each rate."""
    targets = F.explode(F.array(*map(F.lit, rates))).alias("target")
    near = curve.select("*", targets).where(F.abs(F.col("rate") - F.col("target")) < within)
    return near.groupBy("target").agg(F.max_by(F.struct("rate", "cost", "f1"), "rate").alias("p")).select("target", "p.*")


def interpretation(m: DataFrame) -> DataFrame:
    """False-discovery share (1 - precision, which some reports call the false positive rate) and miss rate, 4 places."""
    return m.select("*", F.bround(1 - F.col("precision"), 4).alias("false_discovery"), F.bround(1 - F.col("recall"), 4).alias("miss_rate"))


def usage_cost(calls: DataFrame, input_price: float, output_price: float) -> DataFrame:
    """Token totals and cost, prices for a million tokens."""
    i, o = F.coalesce(F.sum("input_tokens"), F.lit(0)), F.coalesce(F.sum("output_tokens"), F.lit(0))
    return calls.agg(F.count("*").alias("n_calls"), i.alias("input_tokens"), o.alias("output_tokens"), (i * input_price / 1e6 + o * output_price / 1e6).alias("cost"))


def replay_check(recomputed: DataFrame, stored: DataFrame, limit: float = 1e-3) -> DataFrame:
    """Folds whose recomputed F1 is off the stored one, with both."""
    key = [*KEY, "fold"]
    j = recomputed.select(*key, F.col("f1").alias("now")).join(stored.select(*key, F.col("f1").alias("was")), key)
    return j.withColumn("differs", F.abs(F.col("now") - F.col("was")) > limit)


# ---- thresholds and rendered comparisons ----


def threshold_analysis(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row for scored predictions on train and test: F1 as predicted, with the best and with the calibrated threshold, both areas, and the shift of scores."""
    parts = (
        metrics.evaluate(test).select(F.col("f1").alias("uncalibrated_f1"), "auc_roc", "auc_pr"),
        metrics.best_threshold(test).select(F.col("f1").alias("oracle_f1"), F.col("threshold").alias("oracle_threshold")),
        metrics.calibrated(test).select(F.col("f1").alias("calibrated_f1")),
        metrics.score_shift(train, test).select(F.col("shift").alias("score_shift")),
    )
    out = parts[0]
    for p in parts[1:]:  # a row each
        out = out.crossJoin(F.broadcast(p))
    return out


def threshold_summary(analyses: DataFrame) -> DataFrame:
    """Analyses of combinations (embedding, classifier) in the fixed order of both, with the columns of the report."""
    return enumerated(analyses).select("embedding", "classifier", "uncalibrated_f1", "oracle_f1", "oracle_threshold", "calibrated_f1", "auc_roc", "auc_pr", "score_shift")


def cost_text(cost: Column) -> Column:
    """A cost in dollars with four places; below 0.0001 it is about nothing."""
    return F.when(cost >= 0.0001, F.format_string("$%.4f", cost)).otherwise("~$0")


def comparison_markdown(comparison: DataFrame) -> str:
    """A small comparison table (test_pool, system, f1, precision, recall, cost_per_query, winner) as Markdown; the F1 of winners is bold."""
    four = lambda c: F.format_string("%.4f", F.col(c))
    f1 = F.when(F.col("winner") != "—", F.concat(F.lit("**"), four("f1"), F.lit("**"))).otherwise(four("f1"))
    rows = comparison.select("test_pool", "system", f1, four("precision"), four("recall"), cost_text(F.col("cost_per_query"))).collect()
    lines = [["Test pool", "System", "F1", "Precision", "Recall", "Cost a query"], ["-"] * 6, *map(list, rows)]
    return "\n".join("| " + " | ".join(r) + " |" for r in lines)
