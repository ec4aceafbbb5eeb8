"""Classification metrics over (sample_id, label, pred, prob), as one row or one row for each group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.storage import materialize


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(2.0 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0))


def _bundle(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    ratio = lambda a, b: F.coalesce(a * 1.0 / F.nullif(b, F.lit(0)), F.lit(0.0))
    return [ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ((_f1(tp, fp, fn) + _f1(tn, fn, fp)) / 2).alias("f1")]


def cells(df: DataFrame, by: list[str] | None = None, pred: Column | None = None) -> DataFrame:
    """tp, fp, fn, tn."""
    y, p = F.col("label") == 1, (F.col("pred") == 1) if pred is None else pred
    agg = [F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")]
    return df.groupBy(*by).agg(*agg) if by else df.agg(*agg)


def confusion(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cells of the confusion matrix with percent of all rows."""
    keys = by or []
    n = df.groupBy(*keys, "label", "pred").agg(F.count("*").alias("n"))
    total = n.groupBy(*keys).agg(F.sum("n").alias("total"))
    out = n.join(total, keys) if keys else n.crossJoin(F.broadcast(total))
    return out.select(*keys, "label", "pred", "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"))


def _by_score(df: DataFrame, by: list[str]) -> DataFrame:
    """Positives and negatives at each distinct score: sorting these instead of rows keeps ties together."""
    return df.groupBy(*by, "prob").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("n"))


#: Ranges of scores within which prefix sums are made apart.
RANGES = 256


def score_ranges(df: DataFrame, ranges: int = RANGES) -> Column:
    """The number of the range of ``prob`` in which a row lies, by about equally many rows: what was learned of the scores in one pass, as nested comparisons."""
    if ranges < 2:
        return F.lit(0)
    at = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(df.agg(F.percentile_approx("prob", at, 10 * ranges)).first()[0] or []))

    def choose(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("prob") <= float(bounds[mid]), choose(low, mid)).otherwise(choose(mid + 1, high))

    return choose(0, len(bounds))


def _running(s: DataFrame, keys: list[str], ranges: Column, down: bool) -> DataFrame:
    """Adds p_to and n_to, the sums of p and n over all rows before in order of score, without the row's own.

    In two levels: sums within a range of scores, and the totals of the ranges before (a row for each range), so no task
    sorts all scores.
    """
    s = s.withColumn("_range", ranges)
    order = F.desc if down else F.asc
    within = Window.partitionBy(*keys, "_range").orderBy(order("prob")).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy(order("_range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = s.groupBy(*keys, "_range").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    at = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_range").alias("__range"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}0") for c in "pn"))
    same = F.col("_range") == F.col("__range")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = s.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_{c}") for c in "pn"))
    return inside.join(F.broadcast(at), same).select(*keys, "prob", "p", "n", *((F.col(f"_{c}") + F.col(f"_{c}0")).alias(f"{c}_to") for c in "pn"))


def curve(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """At each distinct score from the highest: true and false positives so far, their rates, precision and recall."""
    keys = by or []
    s = _running(_by_score(df, keys), keys, score_ranges(df), True)
    tp, fp = F.col("p_to") + F.col("p"), F.col("n_to") + F.col("n")
    whole = s.groupBy(*keys).agg(F.sum("p").alias("_p"), F.sum("n").alias("_n")).select(*(F.col(k).alias(f"_{k}") for k in keys), "_p", "_n")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    s = s.join(F.broadcast(whole), same)
    all_p, all_n = F.nullif("_p", F.lit(0)), F.nullif("_n", F.lit(0))
    return s.select(*keys, "prob", tp.alias("tp"), fp.alias("fp"), (tp / all_p).alias("recall"), (fp / all_n).alias("fpr"), (tp / (tp + fp)).alias("precision"), (F.col("p") / all_p).alias("gain"))


def auc_roc(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The share of (positive, negative) pairs in order, ties half; 0 with a single class or without scores."""
    keys = by or []
    df = df.where("prob is not null")
    s = _running(_by_score(df, keys), keys, score_ranges(df), False)
    good = F.sum(F.col("p") * (F.col("n_to") + F.col("n") / 2.0))
    auc = F.coalesce(good / F.nullif(F.sum("p").cast("double") * F.sum("n"), F.lit(0.0)), F.lit(0.0)).alias("auc_roc")
    return s.groupBy(*keys).agg(auc) if keys else s.agg(auc)


def average_precision(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The sum over distinct scores of recall gained times precision; 0 with a single class."""
    keys = by or []
    c = curve(df.where("prob is not null"), keys)
    ap = F.when((F.max("tp") > 0) & (F.max("fp") > 0), F.sum(F.col("gain") * F.col("precision")))
    ap = F.coalesce(ap, F.lit(0.0)).alias("auc_pr")
    return c.groupBy(*keys).agg(ap) if keys else c.agg(ap)


def evaluate(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All metrics: accuracy, precision and recall of the positive class, macro F1, auc_roc, auc_pr."""
    c = cells(df, by)
    m = c.select(*(by or []), *_bundle(*(F.col(x) for x in ("tp", "fp", "fn", "tn"))))
    for extra in (auc_roc(df, by), average_precision(df, by)):
        m = m.join(extra, by, "left") if by else m.crossJoin(F.broadcast(extra))
    return m.na.fill(0.0, ["auc_roc", "auc_pr"])


def thresholds(spark, n: int = 200, low: float = 0.01, high: float = 0.99) -> DataFrame:
    return spark.range(n).select((F.lit(low) + F.col("id") * (high - low) / (n - 1)).alias("threshold"))


def sweep(df: DataFrame, n: int = 200) -> DataFrame:
    """Metrics at each of n thresholds. Rows are reduced to counts by the number of thresholds they reach, so nothing is multiplied by n."""
    low, step = 0.01, 0.98 / (n - 1)
    at = lambda i: i * step + F.lit(low)
    i = F.floor((F.col("prob").cast("double") - low) / step)
    # rounding may put a score on the wrong side of a threshold: the neighbours are compared as they are
    i = F.when(F.col("prob") >= at(i + 1), i + 1).when(F.col("prob") < at(i), i - 1).otherwise(i)
    reach = F.greatest(F.lit(0), F.least(F.lit(n), i + 1))
    c = df.where("prob is not null").groupBy(reach.cast("int").alias("reach")).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("n"))
    t = df.sparkSession.range(n).select(F.col("id").cast("int").alias("i"))
    j = t.crossJoin(F.broadcast(c)).groupBy("i").agg(*(F.sum(F.when((F.col("reach") > F.col("i")) == hit, F.col(k)).otherwise(0)).alias(a) for a, k, hit in (("tp", "p", True), ("fp", "n", True), ("fn", "p", False), ("tn", "n", False))))
    return j.select(at(F.col("i")).alias("threshold"), *_bundle(*(F.col(x) for x in ("tp", "fp", "fn", "tn"))))


def best_threshold(df: DataFrame, n: int = 200) -> DataFrame:
    """The lowest threshold of the best macro F1; 0.5 with an F1 of 0 if none is above 0."""
    s = sweep(df, n).agg(F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("threshold"))).alias("b")).select("b.*")
    return s.select(F.when(F.col("f1") > 0, F.col("threshold")).otherwise(0.5).alias("threshold"), F.greatest("f1", F.lit(0.0)).alias("f1"))


def calibrated(df: DataFrame, share: float = 0.1, seed: int = 42) -> DataFrame:
    """The threshold found on a held-out tenth, and the metrics with it on the rest. No curve is fitted."""
    from sievework.operators.splits import holdout

    d = holdout(df, share, seed=seed)
    t = best_threshold(d.where("calibration")).select("threshold")
    rest = d.where("not calibration").crossJoin(F.broadcast(t))
    c = cells(rest, pred=F.col("prob") >= F.col("threshold"))
    return t.crossJoin(c.select(*_bundle(*(F.col(x) for x in ("tp", "fp", "fn", "tn")))))


def score_shift(train: DataFrame, test: DataFrame) -> DataFrame:
    """Mean score of the positive class in train and test, and the difference."""
    m = lambda d, n: d.where("label = 1").agg(F.avg("prob").alias(n))
    return m(train, "train_mean").crossJoin(m(test, "test_mean")).withColumn("shift", F.col("test_mean") - F.col("train_mean"))


SIX = ("accuracy", "precision", "recall", "f1", "auc_roc", "auc_pr")
#: Distinct (label, prediction, score) of a range of scores, about, and replicates that one task draws for it.
KINDS, DRAWS = 50_000, 500


def _draws(seed: int, cell: int, first: int, count: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """How often each kind comes in each replicate of a block: Poisson numbers of a generator of seed, replicate and range. Replicate -1 is the rows as they are."""
    if first < 0:
        yield -1, count.astype(float)
        return
    for r in range(first, first + DRAWS):
        yield r, np.random.default_rng([seed, r, cell]).poisson(count).astype(float)


def bootstrap(df: DataFrame, replicates: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile intervals of the six metrics by resampling rows: one row with each metric, its _lower and its _upper.

    Each row comes a Poisson(1) number of times in a replicate, so rows of the same label, prediction and score together
    come a Poisson number of times with their count as mean: the work follows the distinct scores, not the rows. Scores
    are cut into ranges; a task draws a block of replicates for a range, in two passes with the same draws: the first
    gives the totals of each range, the second the areas under the curves given what lies in the ranges above. Nothing
    is gathered, and there is no bound on scores. Rows without a score are left out; without rows all metrics are null.
    """
    spark = df.sparkSession
    names = [f"{m}{s}" for m in SIX for s in ("", "_lower", "_upper")]
    kinds = df.where("prob is not null").groupBy(F.col("label").cast("int").alias("label"), F.col("pred").cast("int").alias("pred"), F.col("prob").cast("double").alias("prob")).agg(F.count("*").alias("n"))
    kinds = materialize(kinds, "kinds")
    many = kinds.count()
    if not many:
        return spark.createDataFrame([(None,) * len(names)], ", ".join(f"{x} double" for x in names))
    cell = score_ranges(kinds, max(1, min(RANGES, -(-many // KINDS))))
    blocks = [-1, *range(0, replicates, DRAWS)]
    dealt = kinds.select(cell.cast("int").alias("cell"), "label", "pred", "prob", "n", F.explode(F.array(*map(F.lit, blocks))).alias("block"))
    sums = ["tp", "fp", "fn", "tn"]
    schema = "cell int, replicate int, " + ", ".join(f"{c} double" for c in sums)

    def totals(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["prob", "label", "pred"])
        which = [((t["label"] == a) & (t["pred"] == b)).to_numpy(float) for a, b in ((1, 1), (0, 1), (1, 0), (0, 0))]
        return pd.DataFrame([(key[0], r, *(float(w @ x) for x in which)) for r, w in _draws(seed, key[0], key[1], t["n"].to_numpy())], columns=["cell", "replicate", *sums])

    first = materialize(dealt.groupBy("cell", "block").applyInPandas(totals, schema).where(F.col("replicate") < replicates), "replicate-sums")
    above = Window.partitionBy("replicate").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    p, n = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    block = F.when(F.col("replicate") < 0, -1).otherwise(F.floor(F.col("replicate") / DRAWS) * DRAWS).cast("int")
    offsets = first.select("cell", "replicate", block.alias("block"), F.coalesce(F.sum(p).over(above), F.lit(0.0)).alias("p0"), F.coalesce(F.sum(n).over(above), F.lit(0.0)).alias("n0"))

    def areas(key: tuple, t: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["prob", "label", "pred"])
        prob, label = t["prob"].to_numpy()[::-1], t["label"].to_numpy()[::-1]
        head = np.flatnonzero(np.diff(prob, prepend=np.nan) != 0)
        at = before.set_index("replicate")
        out = []
        for r, w in _draws(seed, key[0], key[1], t["n"].to_numpy()):
            if r not in at.index:
                continue
            w = w[::-1]
            p, n = (np.add.reduceat(w * (label == k), head) for k in (1, 0))
            hits, false = at.at[r, "p0"] + np.cumsum(p), at.at[r, "n0"] + np.cumsum(n)
            out.append((r, float((n * (hits - p / 2)).sum()), float((p * hits / np.maximum(hits + false, 1)).sum())))
        return pd.DataFrame(out, columns=["replicate", "roc", "pr"]).astype({"replicate": int, "roc": float, "pr": float})

    second = dealt.groupBy("cell", "block").cogroup(offsets.groupBy("cell", "block")).applyInPandas(areas, "replicate int, roc double, pr double")
    a = second.groupBy("replicate").agg(F.sum("roc").alias("roc"), F.sum("pr").alias("pr"))
    s = first.groupBy("replicate").agg(*(F.sum(c).alias(c) for c in sums)).join(a, "replicate")
    one = F.nullif((F.col("tp") + F.col("fn")) * (F.col("fp") + F.col("tn")), F.lit(0.0))
    roc = F.coalesce(F.col("roc") / one, F.lit(0.0)).alias("auc_roc")
    pr = F.coalesce(F.when(one.isNotNull(), F.col("pr") / (F.col("tp") + F.col("fn"))), F.lit(0.0)).alias("auc_pr")
    each = materialize(s.select("replicate", *_bundle(*(F.col(c) for c in sums)), roc, pr), "replicates")
    bounds = each.where("replicate >= 0").agg(*(F.percentile(m, F.lit(q)).alias(f"{m}{s}") for m in SIX for s, q in (("_lower", (1 - level) / 2), ("_upper", (1 + level) / 2))))
    return each.where("replicate < 0").select(*SIX).crossJoin(F.broadcast(bounds)).select(*names)


# ---- tests over small tables of results ----


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    tiny, c, d, h = 1e-300, 1.0, 1 - (a + b) * x / (a + 1), 0.0
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + k * d) or tiny)
            c = (1 + k / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) * h / a


def t_p_value(t: float, degrees: float) -> float:
    """Two-sided."""
    return incomplete_beta(degrees / 2, 0.5, degrees / (degrees + t * t))


def wilcoxon_p_value(differences: list[float]) -> tuple[float, float]:
    """Signed-rank statistic and exact two-sided p value (zeros are left out; midranks on ties)."""
    d = [x for x in differences if x]
    size = sorted(abs(x) for x in d)
    ranks = {v: (size.index(v) + 1 + len(size) - size[::-1].index(v)) for v in set(size)}  # twice the midrank
    plus = sum(ranks[abs(x)] for x in d if x > 0)
    total = sum(ranks[abs(x)] for x in d)
    ways = {0: 1}
    for x in d:
        new: dict[int, int] = {}
        for s, k in ways.items():
            new[s] = new.get(s, 0) + k
            new[s + ranks[abs(x)]] = new.get(s + ranks[abs(x)], 0) + k
        ways = new
    least = min(plus, total - plus)
    p = 2 * sum(k for s, k in ways.items() if s <= least) / 2 ** len(d) if d else 1.0
    return least / 2, min(1.0, p)
