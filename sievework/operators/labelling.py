"""Labelling by a language model that can be killed at any time and loses or repeats no answer.

The answers are written by a data source: a task logs each answer to a file of its own as soon as it has it, and the files
of all tasks become one batch of the log when the job commits. A task that starts again, and a run that starts again, first
reads what earlier attempts have logged and asks only for the rest. The log is read by its commits and by what was never
committed alike, so an answer that was paid for counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from sievework.functions import text as T
from sievework.operators import taxonomy
from sievework.sources.lines import PLACE, read_json_lines

ANSWER = "sample_hash string, raw string, run string, attempt string"
#: The state of a log that is empty is a folder without files.
Provider = Callable[[list[str]], list[str]]


def _filesystem(uri: str):
    import os

    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def _logged(folder: str, part: int | None = None) -> Iterator[dict]:
    """The answers in the files of a log; a last line that was cut off is no answer."""
    from pyarrow import fs

    system, path = _filesystem(folder)
    selector = fs.FileSelector(path, allow_not_found=True)
    for info in sorted(system.get_file_info(selector), key=lambda i: i.path):
        name = info.path.rsplit("/", 1)[-1]
        if not name.endswith(".jsonl") or (part is not None and not name.startswith(f"{part:06d}-")):
            continue
        with system.open_input_stream(info.path) as f:
            for line in f.read().split(b"\n")[:-1]:
                yield json.loads(line)


@dataclass
class Done(WriterCommitMessage):
    files: list[str]
    asked: int


class AnswerWriter(DataSourceWriter):
    """Asks for the rows of a task and logs each answer at once."""

    def __init__(self, options: dict):
        self.folder, self.run, self.batch = options["path"], options["run"], int(options["batch"])
        self.provider = bytes.fromhex(options["provider"])

    def write(self, rows: Iterator) -> Done:
        context = TaskContext.get()
        part, attempt = context.partitionId(), f"{self.run}-{context.taskAttemptId()}"
        known = {a["sample_hash"] for a in _logged(self.folder, part) if a["run"] == self.run}
        provider: Provider = cloudpickle.loads(self.provider)
        system, path = _filesystem(self.folder)
        system.create_dir(path, recursive=True)
        asked = 0
        todo = [(r.sample_hash, r.text) for r in rows if r.sample_hash not in known]
        files = []
        for at in range(0, len(todo), self.batch):
            some = todo[at : at + self.batch]
            # a file for each batch: it is closed, and so safe, before the next question
            name = f"{path}/{part:06d}-{attempt}-{at // self.batch:06d}.jsonl"
            answers = provider([t for _, t in some])
            with system.open_output_stream(name) as out:
                for (h, _), raw in zip(some, answers, strict=True):
                    out.write(json.dumps({"sample_hash": h, "raw": raw, "run": self.run, "attempt": attempt}).encode() + b"\n")
            files.append(name)
            asked += len(some)
        return Done(files, asked)

    def commit(self, messages: list[Done]) -> None:
        system, path = _filesystem(self.folder)
        with system.open_output_stream(f"{path}/_commit-{self.run}.json") as out:
            out.write(json.dumps({"run": self.run, "asked": sum(m.asked for m in messages if m)}).encode())

    def abort(self, messages: list) -> None:
        """What was logged stays: the next run reads it."""


class AnswerLog(DataSource):
    """The sink of answers: options path, run, batch, provider (pickled, hexadecimal)."""

    @classmethod
    def name(cls) -> str:
        return "answer_log"

    def schema(self) -> str:
        return "sample_hash string, text string"

    def writer(self, schema, overwrite: bool) -> AnswerWriter:
        return AnswerWriter(dict(self.options))


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """The answers of a log, one for each hash (the last): sample_hash, raw, category_slug, confidence, line_no."""
    system, path = _filesystem(folder)
    from pyarrow import fs

    files = [i.path for i in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if i.path.endswith(".jsonl")]
    if not files:
        return spark.createDataFrame([], "sample_hash string, raw string, category_slug string, confidence double, line_no bigint")
    log = read_json_lines(spark, f"{folder.rstrip('/')}/*.jsonl", ANSWER).where("sample_hash is not null")
    last = log.groupBy("sample_hash").agg(F.max_by("raw", PLACE).alias("raw"))
    parsed = taxonomy.parse_category(F.col("raw"))
    return last.select("sample_hash", "raw", parsed["slug"].alias("category_slug"), parsed["confidence"].alias("confidence"), F.lit(0).cast("bigint").alias(PLACE))


def ask_pending(df: DataFrame, folder: str, provider: Provider, max_calls: int | None = None, batch: int = 1, retry_failed: bool = False, tasks: int | None = None, run: str | None = None) -> str:
    """Asks for every distinct text that needs a category and has no answer in the log; returns the run's name.

    At most ``max_calls`` questions, in order of id. ``batch`` texts go to the provider at once, and are logged at once.
    With ``retry_failed`` a logged answer without a category does not count. A run that is given the name of an earlier
    one goes on with it.
    """
    spark = df.sparkSession
    spark.dataSource.register(AnswerLog)
    todo = taxonomy.pending(df, read_log(spark, folder), None, retry_failed=retry_failed)
    todo = todo.groupBy("sample_hash").agg(F.min("text").alias("text"), F.min("sample_id").alias("_id"))
    if max_calls is not None:
        todo = todo.orderBy("_id").limit(max_calls)
    run = run or uuid.uuid4().hex
    todo = todo.select("sample_hash", "text")
    todo = todo.repartition(tasks, "sample_hash") if tasks else todo
    options = {"path": folder, "run": run, "batch": str(batch), "provider": cloudpickle.dumps(provider).hex()}
    todo.write.format("answer_log").options(**options).mode("append").save()
    return run


def label_samples(df: DataFrame, folder: str, provider: Provider | None = None, threshold: float = 0.6, **more) -> DataFrame:
    """The whole run: injections without a category are asked for (without a provider only the log counts), then answers are applied.

    Rows with a category are tagged ``tier1_2``; an answer of at least ``threshold`` is the category, below it the row is
    ``uncertain``; an answer that cannot be parsed leaves the row as it is.
    """
    if provider is not None:
        ask_pending(df, folder, provider, **more)
    return taxonomy.replay(df, read_log(df.sparkSession, folder), threshold)


def text_hash(df: DataFrame) -> DataFrame:
    """Adds the hash under which the log has a text."""
    return df.withColumn("sample_hash", T.hash16(F.col("text")))
