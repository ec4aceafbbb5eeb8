"""Quality classifier by attention-based multiple-instance learning (operator 3).

A document is a bag of passages of 64 words. Every passage is encoded by a small layer over statistics of its
characters and words; gated attention, learned from document labels alone, weighs the passages, and the weighted sum
of their encodings gives the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import arrays
from sievework.llm.shared import distinct_names

PASSAGE_WORDS = 64
#: Classes of bytes: lower case, upper case, digits, symbols, sentence marks, other marks, beyond ASCII, line ends, other white space.
CLASSES = 9
_CLASS = np.full(256, 5, np.uint8)
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b"#*$%&|<>", b".,;:!?")):
    _CLASS[list(_bytes)] = _k
_CLASS[128:] = 6
_CLASS[10] = 7
_CLASS[[9, 11, 12, 13, 32]] = 8
FEATURES = CLASSES + 9


def passages(block: arrays.Block) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage, and the bounds of each text's passages (a text without words has one, of zeros)."""
    w = arrays.words(block)
    n_words = np.diff(w.bounds)
    many = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    bounds = np.concatenate([[0], np.cumsum(many)])
    total = int(bounds[-1])
    x = np.zeros((total, FEATURES), np.float32)
    if not len(w.start):
        return x, bounds
    at = np.arange(len(w.start)) - w.bounds[w.doc]
    part = bounds[w.doc] + at // PASSAGE_WORDS
    count = np.bincount(part, minlength=total).astype(np.float64)
    filled = np.maximum(count, 1)
    # characters: from the passage's first word to the next passage's first word
    head = np.flatnonzero(np.diff(part, prepend=-1))
    edges = np.append(w.start[head], len(block.data))
    lead = int(edges[0])
    owner = np.repeat(part[head], np.diff(edges))
    kinds = np.bincount(owner * CLASSES + _CLASS[block.data[lead:]], minlength=total * CLASSES).reshape(total, CLASSES)
    x[:, :CLASSES] = kinds / np.maximum(kinds.sum(1, keepdims=True), 1)
    h = arrays.span_hashes(block.data, w.start, w.end)
    size = (w.end - w.start).astype(np.float64)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (part[1:] == part[:-1])
    first, last = block.data[w.start], block.data[w.end - 1]
    mean = np.bincount(part, size, total) / filled
    pair = arrays.mix(h * np.uint64(3) + np.concatenate([h[1:], h[:1]]))
    for k, v in enumerate(
        (
            mean / 10,
            np.sqrt(np.maximum(np.bincount(part, size * size, total) / filled - mean * mean, 0)) / 10,
            np.bincount(part, same, total) / filled,
            _distinct(part, h, total) / filled,
            _distinct(part, pair, total) / filled,
            np.bincount(part, (_CLASS[first] == 1), total) / filled,
            np.bincount(part, (_CLASS[last] == 3), total) / filled,
            np.bincount(part, (_CLASS[last] == 4), total) / filled,
            np.log1p(count) / 4,
        )
    ):
        x[:, CLASSES + k] = v
    return x, bounds


def _distinct(part: np.ndarray, value: np.ndarray, total: int) -> np.ndarray:
    """How many distinct values each passage has."""
    order = np.lexsort((value, part))
    p, v = part[order], value[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (v[1:] != v[:-1])
    return np.bincount(p[new], minlength=total)


@dataclass
class Attention:
    """The network. Without labels of both kinds it scores 0.5 throughout."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] | None

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        p, starts = self.weights, bounds[:-1]
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        bag = np.repeat(np.arange(len(starts)), np.diff(bounds))
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "bag": bag, "s": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -40, 40)))}

    def score(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return self.forward(x, bounds)["s"] if self.weights else np.full(len(bounds) - 1, 0.5)


def fit(x: np.ndarray, bounds: np.ndarray, y: np.ndarray, hidden: int = 16, gate: int = 8, steps: int = 400, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Attention:
    """Learns encoder, attention and output from bag labels (0 or 1) by Adam on the cross-entropy."""
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    if len(set(y.tolist())) < 2:
        return Attention(mean, scale, None)
    rng = np.random.default_rng(seed)
    f = x.shape[1]
    p = {"W": rng.normal(0, f**-0.5, (f, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, gate)), "U": rng.normal(0, hidden**-0.5, (hidden, gate)), "w": rng.normal(0, gate**-0.5, gate), "c": rng.normal(0, hidden**-0.5, hidden), "d": np.zeros(())}
    net = Attention(mean, scale, p)
    m, v = ({k: np.zeros_like(q) for k, q in p.items()} for _ in range(2))
    starts = bounds[:-1]
    rare = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for step in range(1, steps + 1):
        r = net.forward(x, bounds)
        h, t, g, a, bag = r["h"], r["t"], r["g"], r["a"], r["bag"]
        ds = (r["s"] - y) * rare / len(y)
        dz = (ds[:, None] * p["c"])[bag]
        da = (dz * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, starts)[bag])
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        grad = {"W": r["x"].T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": r["z"].T @ ds, "d": ds.sum()}
        for k in p:
            grad[k] = grad[k] + decay * p[k]
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def _bags(docs: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in arrays.blocks(batch.column(1)):
                x, bounds = passages(block)
                bags = pa.array([x[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(block))], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), bags, batch.column(2).slice(block.first, len(block))], names=["id", "bag", "label"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"), F.col(f"`{label_col}`").cast("int")).mapInArrow(run, f"id {kind}, bag binary, label int").toArrow()
    found = sorted(zip(rows["id"].to_pylist(), rows["bag"].to_pylist(), rows["label"].to_pylist(), strict=True))
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for _, b, _ in found]
    bounds = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    return (np.concatenate(bags) if bags else np.zeros((0, FEATURES), np.float32)), bounds, np.array([y for *_, y in found], np.float64)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_bags: int = 3000, held_out_mod: int = 4, held_out: int = 2) -> Attention:
    """Fits on at most ``max_bags`` labelled documents whose crc32(id as text) mod 4 is not 2.

    ``max_bags`` bounds what the driver holds; the labels with the smallest hash of the id are taken, so the sample
    does not depend on the partitioning. Null labels and ids are no labels; labels other than 1 count as 0.
    """
    spare = F.crc32(F.col("_id").cast("string")) % held_out_mod != held_out
    chosen = (
        labels.select(F.col(f"`{id_col}`").alias("_id"), (F.col(f"`{label_col}`") == 1).cast("int").alias("_label"))
        .where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & spare)
        .groupBy("_id").agg(F.min("_label").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_bags)
    )
    bags = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).join(F.broadcast(chosen), "_id")
    return fit(*_bags(bags, "_id", "_text", "_label"))


def classify(docs: DataFrame, model: Attention, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, held_out_mod: int = 4, held_out: int = 2, keep: list[str] | None = None) -> DataFrame:
    """Scores every whole text: the id column (or the columns in ``keep``), held_out, score (0 to 1) and predicted (1 if score >= threshold).

    Columns named like those three in ``keep`` are replaced. Only the text is used for the score. A null or empty text is one passage of zeros. Rows are independent; repeated
    rows get the same score; an empty table gives no rows; texts of any length are scored by all of their passages. An id
    column named like one of the three is an error without ``keep``.
    """
    added = ("held_out", "score", "predicted")
    if not keep:
        distinct_names(id_col, *added)
    keep = [c for c in keep or [id_col] if c not in added]
    kept = [F.col(f"`{c}`") for c in keep]
    schema = docs.select(*kept).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in arrays.blocks(batch.column(batch.num_columns - 1)):
                score = model.score(*passages(block))
                rest = [batch.column(i).slice(block.first, len(block)) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(score, pa.float64())], names=[*keep, "held_out", "score"])
            arrays.trim()

    mod = F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % held_out_mod == held_out, F.lit(False))
    out = docs.select(*kept, mod.alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("_scored_text")).mapInArrow(run, f"{fields}{', ' if keep else ''}held_out boolean, score double")
    return out.select(*kept, "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
