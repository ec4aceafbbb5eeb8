"""Folders on storage that every executor sees, and small helpers for tables there."""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, as the session or its context has it.

    Where it is unset, a temporary folder is set if the master is local, as in tests; on a cluster that would be
    another folder on each machine, so it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isDefined():
            base = context.getCheckpointDir().get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            base = "file://" + tempfile.mkdtemp(prefix="sievework-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


_scratch = threading.local()


def _open() -> list[list[str]]:
    """The lists of tables of the scratch contexts that are open in this thread."""
    if not hasattr(_scratch, "paths"):
        _scratch.paths = []
    return _scratch.paths


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes the table to the shared folder and reads it again: this cuts the lineage, and a lost executor loses nothing.

    Within a ``Scratch`` the shuffle files of the jobs before are let go first: Spark deletes those of finished jobs when
    the driver's heap is collected, which small drivers of large jobs seldom do by themselves.
    """
    spark = df.sparkSession
    path = shared_dir(spark, what)
    if _open():
        _open()[-1].append(path)
        release(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs."""
    gc.collect()
    spark._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Deletes a table of ``written`` that is not needed any more."""
    delete(df.sparkSession, df._written)


#: Numbers, such as ids or lines, up to which a table is broadcast to the texts that it is joined with.
SENT = 1_000_000


def sent(df: DataFrame, numbers: int) -> DataFrame:
    """A table that holds so many numbers, for a join with whole texts: as a broadcast up to ``SENT`` of them, whatever the session's threshold, so that no text is shuffled; beyond, as it is."""
    return F.broadcast(df) if numbers <= SENT else df


class Scratch:
    """A context whose ``written`` tables are deleted at its end, but for those of ``keep``, which go to the context around it, if any."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> Scratch:
        _open().append([])
        return self

    def keep(self, df: DataFrame, what: str) -> DataFrame:
        out = written(df, what)
        path = _open()[-1].pop()
        if len(_open()) > 1:
            _open()[-2].append(path)
        return out

    def __exit__(self, *_) -> None:
        for path in _open().pop():
            delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _places(stored: DataFrame, name: str) -> DataFrame:
    """Replaces ``_at``, the monotonically increasing id of the rows of a written table, by their place from 1.

    A row for each partition tells how many stand before it.
    """
    spark = stored.sparkSession
    part = F.shiftright("_at", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = stored.groupBy(part).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    offset = F.broadcast(spark.createDataFrame(offset.collect(), "_part bigint, _before bigint"))  # a row for each partition
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.withColumn("_part", part).join(offset, "_part").withColumn(name, F.col("_before") + within + 1).drop("_part", "_before", "_at")


def numbered(df: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """Adds the place of each row, from 1, in the given order over the whole table (a table of ``written``: it is read twice).

    Rows are dealt by ranges and sorted within them, so that no task gets more than its range, not even of rows that are
    alike, which stand in the order in which they are stored.
    """
    stored = df.withColumn("_stored", F.monotonically_increasing_id())
    by = [*order, F.col("_stored").asc()]
    ranged = stored.repartitionByRange(*by).sortWithinPartitions(*by).drop("_stored")
    return _places(written(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranges"), name)


def dense_names(keys: DataFrame, name: str = "name") -> DataFrame:
    """The distinct rows, numbered from 1 without gaps in no particular order."""
    return _places(written(keys.distinct().withColumn("_at", F.monotonically_increasing_id()), "names"), name)


#: CRC-32 by halves of a byte: the polynomial's remainders.
_NIBBLES = [0] * 16
for _i in range(16):
    _c = _i
    for _ in range(4):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _NIBBLES[_i] = _c


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes in DuckDB's SQL."""
    step = f"xor(([{', '.join(map(str, _NIBBLES))}]::ubigint[])[((xor(c, {{n}}) & 15) + 1)::int], c >> 4)"
    low, high = "(x & 15)", "(x >> 4)"
    once = step.format(n=low)
    twice = f"list_reduce([{once}, {high}], lambda c, x: {step.format(n='x')})"
    each = f"list_transform(generate_series(1, strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::ubigint)"
    return f"xor(list_reduce(list_prepend(4294967295::ubigint, {each}), lambda c, x: {twice}), 4294967295::ubigint)"


def distinct_names(id_col: str, *added: str) -> None:
    """ValueError if the id column has the name of a column that an operator adds."""
    if id_col in added:
        raise ValueError(f"the id column has the name of a column of the result: {id_col}")


def filesystem(uri: str):
    """A pyarrow file system and the path in it, for executors; a path without scheme is a mounted folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def partitions(spark: SparkSession) -> int:
    """How many parts a shuffle has, as the session sets it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
