"""Sinks: tables, splits, logs and rendered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_split(df: DataFrame, split: DataFrame, path: str) -> None:
    """Rows with their roles, in folders by fold and role; readers of one fold read only that."""
    df.join(split, "sample_id").write.mode("overwrite").partitionBy("fold", "role").parquet(path)


def split_json(split: DataFrame) -> DataFrame:
    """One JSON line for each fold and role, ids in order: for exchange of small splits."""
    return split.groupBy("fold", "role").agg(F.sort_array(F.collect_list("sample_id")).alias("ids")).select(F.to_json(F.struct("fold", "role", "ids")).alias("value"))


def manifest(split: DataFrame) -> DataFrame:
    """Rows and an order-independent hash of each fold and role."""
    h = F.conv(F.substring(F.sha2(F.col("sample_id").cast("string"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return split.groupBy("fold", "role").agg(F.count("*").alias("n"), F.sum(h).alias("hash_sum"))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def processed_labels(df: DataFrame) -> DataFrame:
    """Rows that a model or nobody was sure about, with whether the label was applied."""
    return df.where(F.coalesce(F.col("label_source").isin("llm", "gpt_4_1_mini", "uncertain"), F.lit(False))).withColumn("applied", F.col("label_source") != "uncertain")


def write_json(report: DataFrame, path: str) -> None:
    """A small report as JSON lines with null fields, in one file."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_run(folds: DataFrame, folder: str) -> None:
    """Fold rows of runs (experiment, embedding, classifier, …) in folders of these names; runs that are there already stay, those written again are replaced."""
    folds.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment", "embedding", "classifier").parquet(folder)


def write_results(folds: DataFrame, folder: str) -> None:
    """A JSON file for each run (experiment, embedding, classifier), as result readers have them, with means over its folds.

    Runs are few; their documents are made on the executors and written one by one.
    """
    names = [c for c in ("f1", "accuracy", "precision", "recall", "auc_roc", "auc_pr") if c in folds.columns]
    values = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.struct(F.col(c).alias("value")) for c in names)))
    one = F.struct(F.col("fold").alias("fold_id"), F.col("held_out").alias("held_out_category"), values.alias("metrics"))
    runs = folds.groupBy("experiment", "embedding", "classifier").agg(F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1"), F.array_sort(F.collect_list(one), lambda a, b: a["fold_id"] - b["fold_id"]).alias("folds"))
    spark = folds.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in runs.select("experiment", "embedding", "classifier", F.to_json(F.struct("*")).alias("value")).toLocalIterator():
        out = fs.create(path(f"{folder.rstrip('/')}/{r.experiment}_{r.embedding}_{r.classifier}.json"), True)
        out.write(bytearray(r.value.encode()))
        out.close()


def write_pairs(df: DataFrame, split: DataFrame, folder: str) -> None:
    """A train and a test table for each fold of a split, in a folder of its own."""
    rows = df.join(split, "sample_id")
    for f in split.select("fold").distinct().orderBy("fold").collect():
        for role in ("train", "test"):
            rows.where((F.col("fold") == f.fold) & (F.col("role") == role)).drop("fold", "role").write.parquet(f"{folder.rstrip('/')}/fold_{f.fold}/{role}.parquet")


def _cell(v, none: str) -> str:
    return none if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)


def to_markdown(df: DataFrame) -> str:
    """A small table; numbers with four places, null as a dash."""
    rows = [[_cell(v, "—") for v in r] for r in df.collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows])


def to_latex(df: DataFrame) -> str:
    safe = lambda s: s.replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    lines = [" & ".join(map(safe, df.columns)) + r" \\", r"\midrule"] + [" & ".join(safe(_cell(v, "---")) for v in r) + r" \\" for r in df.collect()]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", r"\toprule", *lines, r"\bottomrule", r"\end{tabular}"])
