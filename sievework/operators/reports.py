"""Whole reports: the tables of a study from its fold results, written to a folder, and a summary in words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators import results
from sievework.operators.storage import materialize
from sievework.sources import sinks


def findings(folds: DataFrame, level: float = 0.05, left: str = "standard_cv", right: str = "leave_out") -> DataFrame:
    """One row: combinations, overall means, best, largest and smallest drop, hardest and easiest category, and how many combinations drop significantly of how many that can be tested."""
    folds = materialize(folds, "folds")
    m = results.master_table(folds, left, right)
    name = F.concat_ws("/", *results.KEY)
    ends = m.agg(F.count("*").alias("n_combinations"), F.max_by(name, F.struct("delta_f1", name)).alias("largest_drop"), F.min_by(name, F.struct("delta_f1", name)).alias("smallest_drop"))
    s = results.significance(folds, level, left, right).agg(F.count_if("significant").alias("n_significant"), F.count("*").alias("n_tested"))
    return ends.crossJoin(F.broadcast(results.extremes(folds, left, right))).crossJoin(F.broadcast(s))


def summary(folds: DataFrame, level: float = 0.05, left: str = "standard_cv", right: str = "leave_out") -> str:
    """The findings in words; without a combination it says so."""
    r = findings(folds, level, left, right).first()
    if not r.n_combinations:
        return "There are no results."
    lines = [
        f"Over {r.n_combinations} combinations the mean F1 is {r.mean_cv:.4f} with {left} and {r.mean_leave_out:.4f} with {right}, a drop of {r.mean_delta:.4f}.",
        f"The best with {right} is {r.best}, the worst {r.worst}; {r.largest_drop} drops most and {r.smallest_drop} least.",
        f"The drop is significant (p < {level}) for {r.n_significant} of {r.n_tested} combinations.",
    ]
    if r.hardest is not None:
        lines.append(f"The category that is hardest to detect when it is held out is {r.hardest}, the easiest {r.easiest}.")
    return "\n".join(lines)


def tables(folds: DataFrame, left: str = "standard_cv", right: str = "leave_out") -> dict[str, DataFrame]:
    """Every table of the study by name: small tables, made from the fold rows."""
    folds = materialize(folds, "folds")
    categories = sorted(r[0] for r in folds.where((F.col("experiment") == right) & F.col("held_out").isNotNull()).select("held_out").distinct().collect())
    classifiers = sorted(r[0] for r in folds.select("classifier").distinct().collect())
    master = results.master_table(folds, left, right)
    return {
        "master": results.enumerated(master), "per_fold": results.enumerated(results.per_fold(folds, categories, right)), "heatmap": results.heatmap(folds, classifiers, left, right),
        "melted": results.melted(folds, left, right), "delta_by_category": results.delta_by_category(folds, left, right), "significance": results.significance(folds, left=left, right=right),
        "regression": results.regression(master, "cv_f1", "delta_f1"), "findings": findings(folds, left=left, right=right),
    }


def write_report(folds: DataFrame, folder: str, left: str = "standard_cv", right: str = "leave_out") -> list[str]:
    """All tables as CSV in folders of their names, and the summary as text; returns the names."""
    found = tables(folds, left, right)
    for name, t in found.items():
        sinks.write_csv(t, f"{folder.rstrip('/')}/{name}")
    text = folds.sparkSession.createDataFrame([(summary(folds, left=left, right=right),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{folder.rstrip('/')}/summary")
    return [*found, "summary"]
