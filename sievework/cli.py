"""Commands over tables in files: ``python -m sievework.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _harmonize(spark: SparkSession, a: argparse.Namespace) -> None:
    from sievework.operators.dedup import harmonize

    harmonize(spark.read.parquet(a.input), a.threshold).write.mode("overwrite").parquet(a.output)


def _split(spark: SparkSession, a: argparse.Namespace) -> None:
    from sievework.operators.splits import locked_splits

    locked_splits(spark.read.parquet(a.input), a.min_samples, tuple(a.exclude), tuple(a.train_only)).write.mode("overwrite").parquet(a.output)


def _check(spark: SparkSession, a: argparse.Namespace) -> None:
    from sievework.operators.contamination import check_all
    from sievework.sources.sinks import write_json

    write_json(check_all(spark.read.parquet(a.input), spark.read.parquet(a.splits), a.jaccard, a.cosine), a.output)


def _train(spark: SparkSession, a: argparse.Namespace) -> None:
    from sievework.operators import trainers

    df, grid = spark.read.parquet(a.input), [(c, json.loads(a.settings)) for c in a.classifier]
    runs = {"standard_cv": trainers.standard_cv, "direct_indirect": trainers.direct_indirect, "leave_out": lambda d, g, **k: trainers.leave_out(d, g, a.min_samples, **k)}
    runs[a.experiment](df, grid, embedding=a.embedding).write.mode("append").parquet(a.output)


def _report(spark: SparkSession, a: argparse.Namespace) -> None:
    from sievework.operators.reports import summary, write_report

    folds = spark.read.parquet(a.input)
    write_report(folds, a.output)
    print(summary(folds))


def _review(spark: SparkSession, a: argparse.Namespace) -> None:
    from sievework.operators import taxonomy
    from sievework.sources import loaders, sinks

    df = spark.read.parquet(a.input)
    if a.overrides:
        taxonomy.apply_overrides(df, loaders.read_overrides(spark, a.overrides)).write.mode("overwrite").parquet(a.output)
    else:
        sinks.write_csv(taxonomy.spot_check(df, a.n), f"{a.output.rstrip('/')}/spot_check")
        sinks.write_csv(taxonomy.uncertain(df), f"{a.output.rstrip('/')}/uncertain")


def _query(spark: SparkSession, a: argparse.Namespace) -> None:
    from sievework.plans import catalogue

    out: DataFrame = catalogue.queries()[a.name](spark, a.input)
    out.withColumn("created_at", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")).write.mode("overwrite").parquet(a.output)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sievework")
    sub = p.add_subparsers(required=True)

    def command(name: str, run, says: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=says)
        c.add_argument("input")
        c.add_argument("output")
        c.set_defaults(run=run)
        return c

    command("harmonize", _harmonize, "normal form, exact and near deduplication, languages").add_argument("--threshold", type=float, default=0.9)
    c = command("split", _split, "all experiments, locked")
    c.add_argument("--min-samples", type=int, default=150)
    c.add_argument("--exclude", nargs="*", default=["other"])
    c.add_argument("--train-only", nargs="*", default=[])
    c = command("check-contamination", _check, "leakage of every split, in one job")
    c.add_argument("splits")
    c.add_argument("--jaccard", type=float, default=0.8)
    c.add_argument("--cosine", type=float, default=0.95)
    c = command("train", _train, "classifiers over the folds of an experiment")
    c.add_argument("--experiment", choices=["standard_cv", "leave_out", "direct_indirect"], default="standard_cv")
    c.add_argument("--classifier", nargs="+", default=["logreg", "svm", "xgboost", "mlp"])
    c.add_argument("--settings", default="{}")
    c.add_argument("--embedding", default="")
    c.add_argument("--min-samples", type=int, default=200)
    command("report", _report, "the tables of a study, and a summary")
    c = command("review", _review, "export labels for review, or apply overrides")
    c.add_argument("--overrides")
    c.add_argument("--n", type=int, default=50)
    command("query", _query, "a query of the catalogue over a folder of tables, with the time in UTC").add_argument("--name", required=True)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    a.run(spark or SparkSession.builder.appName("sievework").getOrCreate(), a)


if __name__ == "__main__":
    main()
