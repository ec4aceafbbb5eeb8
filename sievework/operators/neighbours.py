"""The nearest vector of another table, for every vector: an exact join of two large sides.

Vectors are dealt to pivots (some of the train vectors). A test vector first meets its nearest pivot's cell, which bounds
how far its nearest neighbour can be. Then it meets those other cells that can have a nearer one: by the triangle
inequality the distance to a vector of a cell is at least the difference of the distances to the pivot. Cells of many
vectors are cut into blocks on both sides, and a task compares one block with another, so neither a cell nor a side
ever stands in one task. What is broadcast is the pivots and a row for each split and pivot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.storage import materialize

#: Vectors of a block, and the most pivots.
BLOCK, PIVOTS = 4096, 1024
#: Test vectors that are compared with a block at once.
_ROWS = 512
#: Rows that are sent to cells at once.
_SENT = 8192
_FOUND = "split_id string, test_id bigint, train_id bigint, similarity double"


def _unit(column) -> np.ndarray:
    """Vectors of a list column as rows of length 1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in pieces, so that their distances to all pivots stay small."""
    for b in batches:
        for at in range(0, len(b), _ROWS):
            yield b.slice(at, _ROWS)


def _distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (m @ pivots.T)))


def _side(df: DataFrame, vector: str, by: str | None) -> DataFrame:
    split = F.col(f"`{by}`").cast("string") if by else F.lit("")
    v = F.col(f"`{vector}`")
    some = F.exists(v, lambda x: x != 0)
    return df.where(some).select(split.alias("split_id"), F.col("sample_id").cast("bigint").alias("id"), v.alias("v"))


def _pivots(train: DataFrame, block: int) -> np.ndarray:
    """Directions of train vectors: as many as there are blocks of them, at most PIVOTS, by hash."""
    n = min(PIVOTS, -(-train.count() // block))
    rows = train.orderBy(F.xxhash64("v"), "id").select("v").limit(4 * n).collect() if n > 1 else train.select("v").limit(1).collect()
    m = np.array([r.v for r in rows], np.float64)
    m = np.unique(m / np.linalg.norm(m, axis=1, keepdims=True), axis=0) if len(m) else np.zeros((0, 1))
    return m[np.random.default_rng(0).permutation(len(m))[:n]]


def _best(left: pa.Table, right: pa.Table) -> pa.Table:
    """For each vector of the right block the most similar one of the left, the smallest id on ties."""
    names = ["split_id", "test_id", "train_id", "similarity"]
    if not left.num_rows or not right.num_rows:
        return pa.table([pa.array([], k) for k in (pa.string(), pa.int64(), pa.int64(), pa.float64())], names=names)
    train, ids = _unit(left["v"]), left["id"].to_numpy()
    test = _unit(right["v"])
    order = np.argsort(ids, kind="stable")
    train, ids = train[order], ids[order]
    similarity, who = np.zeros(len(test)), np.zeros(len(test), np.int64)
    for i in range(0, len(test), _ROWS):
        s = np.round(test[i : i + _ROWS] @ train.T, 12)
        at = s.argmax(1)  # the first of the largest
        similarity[i : i + _ROWS], who[i : i + _ROWS] = s[np.arange(len(s)), at], ids[at]
    return pa.table([right["split_id"], right["id"], pa.array(who), pa.array(similarity)], names=names)


def _meet(train: DataFrame, test: DataFrame, cells: DataFrame, block: int) -> DataFrame:
    """The best of each test vector over the cells it is sent to (``test``: split_id, id, v, cell)."""
    pair = ["split_id", "cell"]
    many = test.groupBy(*pair).agg(F.count("*").alias("n_test")).join(F.broadcast(cells.select(*pair, "n")), pair)
    many = F.broadcast(many.select(*pair, F.ceil(F.col("n") / block).alias("a"), F.ceil(F.col("n_test") / block).alias("b")))
    of = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    key = [*pair, "i", "j"]
    left = train.join(many, pair).select(*pair, "id", "v", of("a").alias("i"), every("b").alias("j"))
    right = test.join(many, pair).select(*pair, "id", "v", every("a").alias("i"), of("b").alias("j"))
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_best, _FOUND)


def nearest(train: DataFrame, test: DataFrame, vector: str = "embedding", by: str | None = None, block: int = BLOCK) -> DataFrame:
    """For each test vector the most similar train vector by cosine: ([by,] test_id, train_id, similarity).

    With ``by``, a column of both sides (a split), rows meet only rows of the same value, all in one job; null values
    meet nothing. Similarities are compared with 12 digits, ties go to the smallest train id. Null vectors and vectors of
    zeros match nothing; equal train vectors are compared once. Exact, whatever the pivots.
    """
    spark = train.sparkSession
    named = F.col("split_id").alias(by) if by else None
    result = lambda d: d.select(*([named] if by else []), "test_id", "train_id", "similarity")
    train = materialize(_side(train, vector, by).groupBy("split_id", "v").agg(F.min("id").alias("id")), "train-vectors")
    pivots = _pivots(train, block)
    if not len(pivots):
        return result(spark.createDataFrame([], _FOUND))
    kind = train.schema["v"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            d = _distances(_unit(b.column(2)), pivots)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["split_id", "id", "v", "cell", "r"])

    train = materialize(train.select("split_id", "id", "v").mapInArrow(deal, f"split_id string, id bigint, v {kind}, cell int, r double"), "train-cells")
    cells = materialize(train.groupBy("split_id", "cell").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")), "cells")
    filled: dict[str, np.ndarray] = {}  # a row for each split and pivot
    for c in cells.where("split_id is not null").collect():
        filled.setdefault(c.split_id, np.full((len(pivots), 2), np.nan))[c.cell] = c.low, c.high

    def send(batches: Iterator[pa.RecordBatch], bounded: bool) -> Iterator[pa.RecordBatch]:
        """Test vectors with the cell of the nearest pivot that has vectors or, with a similarity found, with the other cells that may have a nearer one."""
        for b in _slices(batches):
            splits = np.array(b.column(0).to_pylist(), object)
            rows, to = [], []
            if len(b):
                d = _distances(_unit(b.column(2)), pivots)
            for s in set(splits.tolist()) & filled.keys():
                at = np.flatnonzero(splits == s)
                low, high = filled[s].T
                near = np.where(np.isnan(low), np.inf, d[at])
                home = near.argmin(1)
                if not bounded:
                    rows.append(at)
                    to.append(home)
                    continue
                most = np.sqrt(np.maximum(0, 2 - 2 * b.column(3).to_numpy()[at]) + 1e-11) + 1e-7
                least = np.maximum(d[at] - high, low - d[at])
                least[:, np.isnan(low)] = np.inf
                least[np.arange(len(at)), home] = np.inf
                i, cell = np.nonzero(least <= most[:, None])
                rows.append(at[i])
                to.append(cell)
            if rows:
                take, cells_of = np.concatenate(rows), np.concatenate(to).astype(np.int32)
                for p in range(0, len(take), _SENT):
                    some = pa.array(take[p : p + _SENT])
                    yield pa.RecordBatch.from_arrays([*(c.take(some) for c in b.columns[:3]), pa.array(cells_of[p : p + _SENT])], names=["split_id", "id", "v", "cell"])

    sent = f"split_id string, id bigint, v {kind}, cell int"
    test = materialize(_side(test, vector, by).where("split_id is not null").select("split_id", "id", F.col("v").cast(kind).alias("v")), "test-vectors")
    home = materialize(test.mapInArrow(lambda batches: send(batches, False), sent), "home-cells")
    found = materialize(_meet(train, home, cells, block).groupBy("split_id", "test_id").agg(_top()).select("split_id", "test_id", "b.*"), "home-best")
    if len(pivots) > 1:
        open_ = test.join(found.select("split_id", F.col("test_id").alias("id"), "similarity"), ["split_id", "id"]).select("split_id", "id", "v", "similarity")
        other = materialize(open_.mapInArrow(lambda batches: send(batches, True), sent), "other-cells")
        found = found.unionByName(_meet(train, other, cells, block)).groupBy("split_id", "test_id").agg(_top()).select("split_id", "test_id", "b.*")
    return result(found)


def _top():
    return F.min_by(F.struct("train_id", "similarity"), F.struct(-F.col("similarity"), F.col("train_id"))).alias("b")
