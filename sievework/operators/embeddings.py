"""Embeddings of texts: prompts, a registry of models, each distinct text once, and a table of them that is checked before use.

A model is a callable from a list of texts to their vectors, which runs on the executors in batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Model = Callable[[list[str]], list[list[float]]]
_MODELS: dict[str, Callable[[], Model]] = {}


def prefixed(text: Column, prefix: str) -> Column:
    """The text behind a model's prefix; null stays null."""
    return F.concat(F.lit(prefix), text)


def templated(text: Column, template: str) -> Column:
    """The text at the place ``{text}`` of a model's template; null stays null."""
    return F.concat(*(F.lit(p) if i == 0 else F.concat(text, F.lit(p)) for i, p in enumerate(template.split("{text}"))))


def instructed(text: Column, instruction: str) -> Column:
    """The pair (instruction, text) for models that take both."""
    return F.array(F.lit(instruction), text)


def register(name: str, make: Callable[[], Model]) -> None:
    """Makes a model known by name; it is made on each executor when it is used."""
    _MODELS[name] = make


def model(name: str) -> Callable[[], Model]:
    """ValueError for an unknown name."""
    if name not in _MODELS:
        raise ValueError(f"unknown model {name!r}; known: {sorted(_MODELS)}")
    return _MODELS[name]


def embed(texts: DataFrame, name: str) -> DataFrame:
    """(text, embedding) of a table of texts; a model's vectors are all of one width."""
    made = model(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = made()
        for b in batches:
            if not len(b):
                continue
            v = np.asarray(encode(b.column(0).to_pylist()), np.float32)
            offsets = pa.array(np.arange(len(b) + 1, dtype=np.int32) * v.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(v.ravel()))], names=["text", "embedding"])

    return texts.select("text").mapInArrow(run, "text string, embedding array<float>")


def by_text(df: DataFrame, lookup: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds to each row what ``lookup`` gives for its text; each distinct text is looked up once. Null texts get nulls."""
    found = lookup(df.where("text is not null").select("text").distinct())
    return df.join(found, "text", "left")


def embedded(df: DataFrame, name: str) -> DataFrame:
    """Adds ``embedding`` to each row, computed once for each distinct text."""
    return by_text(df, lambda texts: embed(texts, name))


def fingerprint(df: DataFrame) -> dict:
    """What the texts of a table are, whatever their order: rows and the sum of hashes of ids and texts."""
    h = F.xxhash64("sample_id", "text").cast("decimal(38,0)")
    n, total = df.agg(F.count("*"), F.sum(h)).first()
    return {"rows": n, "hash": str(total)}


def _meta(spark: SparkSession, path: str, value: dict | None = None) -> dict | None:
    at = f"{path.rstrip('/')}-meta"
    if value is not None:
        spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(at)
        return value
    try:
        return json.loads("".join(r[0] for r in spark.read.text(at).collect()))
    except Exception as e:  # a missing or unreadable note is no valid one
        if "PATH_NOT_FOUND" in str(e) or isinstance(e, ValueError):
            return None
        raise


def save_embeddings(df: DataFrame, path: str, version: str) -> None:
    """Writes (sample_id, embedding); the note beside it, which makes it valid, is written last. A failed write leaves none that is valid."""
    _meta(df.sparkSession, path, {"version": None})
    df.select("sample_id", "embedding").write.mode("overwrite").parquet(path)
    _meta(df.sparkSession, path, {"version": version, **fingerprint(df)})


def load_embeddings(df: DataFrame, path: str, version: str) -> DataFrame | None:
    """The saved embeddings if they are of this version and of exactly these ids and texts; otherwise None."""
    spark = df.sparkSession
    note = _meta(spark, path)
    return spark.read.parquet(path) if note and note == {"version": version, **fingerprint(df)} else None


def clear_embeddings(spark: SparkSession, path: str) -> None:
    """Makes a saved table invalid; its files are overwritten by the next save."""
    _meta(spark, path, {"version": None})
