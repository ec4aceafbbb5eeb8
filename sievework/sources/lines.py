"""Lines of text files in their true order, read in parallel.

Files are split as Spark splits them; a line's place is (time of the file, file, start of its split, its place in the split),
which needs no second pass and does not depend on how splits are dealt to tasks or in which order files are listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The column that orders lines.
PLACE = "line_no"


def place(name: str = PLACE) -> Column:
    """The place of a row of a text source: a struct that compares in order. Files come as they were last written, those of the same time by path."""
    return F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")).alias(name)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, line_no) of all lines of a file, a folder or a list of them."""
    return spark.read.text(path).select("value", place())


def read_json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """The columns of ``schema`` and line_no; a line that is no JSON object gives nulls."""
    lines = read_lines(spark, path)
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("x"), PLACE).select("x.*", PLACE)


def read_csv_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The columns of CSV files with a header, and line_no."""
    d = spark.read.option("header", True).csv(path)
    return d.select(*(F.col(f"`{c}`") for c in d.columns), place())
