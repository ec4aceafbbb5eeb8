"""Line deduplication by an exact set-similarity join (operator 7).

The tokens of a line are put in order of rarity; two lines of at least 80 % similarity share a token among the first
s - ceil(0.8 s) + 1 of each. Lines that share such a token are compared by length, by the places of the token in both
(what can still overlap behind it), and by a 128-bit parity sketch (each differing token flips one bit), before their
Jaccard similarity is verified on the tokens themselves. A line goes if an earlier one is similar. Lines of up to
three tokens are similar to equal sets only, which are found by their hash.

Whether any earlier similar line exists is all that is asked, so a line is first verified against its nearest candidate
if that looks near. Where none looks so, or the nearest is not confirmed and there are others, the line is open: a second
join compares open lines with all lines that have any candidate, by sketches of 320 bits. Again the nearest is verified
where one looks near, and all candidates elsewhere; a third join of what is open still verifies all. Few lines are open
then: of the others, it is sent only the entries of tokens that are in the prefix of an open line too.

Entries (token, line) are dealt by token into buckets whose number follows from the counted tokens, so that a task holds
a bucket of bounded size. A token of more than ``HOT`` occurrences is dealt by pairs of blocks of its lines. Among many
lines of a token, each is compared with the earliest ones first and leaves the comparison if one of them is near.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm import arrays
from sievework.llm.shared import SENT, Scratch, discard, partitions, sent, written

#: Cells of the table of token frequencies that orders tokens; its size does not depend on the corpus.
CELLS = 1 << 18
WIDTH = 4096
_CELL_SHIFT, _WITHIN = np.uint64(46), np.uint64((1 << 46) - 1)
#: Occurrences of a token up to which its lines are in one bucket.
HOT = 20_000
#: Entries of a bucket, about.
BUCKET = 400_000
#: Bytes of text whose entries are sent together.
CHUNK_BYTES = 16 << 20
#: Lines of one token from which on the earliest ``LEADERS`` are compared with all others first.
MANY, LEADERS = 1024, 64
#: Words of the sketch that open lines have besides that of 64 bits.
WIDE = 4
#: Cells of the table of tokens in the prefixes of lines that are still open; its size does not depend on the corpus.
SEEN = 1 << 22
#: Pairs that are compared at once.
PAIRS_AT_ONCE = 1 << 20

_LINE = "id bigint, line bigint, mark bigint"
_FOUND = "x_id bigint, x_line bigint, x_mark bigint, y_id bigint, y_line bigint, y_mark bigint, bits bigint, near boolean, more boolean"
X, Y = ["x_id", "x_line", "x_mark"], ["y_id", "y_line", "y_mark"]


class Lines:
    """The lines of a block that have words, in order, as sets of distinct tokens: by rarity if ``rank`` orders the cells, else by hash."""

    def __init__(self, block: arrays.Block, rank: np.ndarray | None = None):
        low = block.lowered()
        w = arrays.words(low)
        feeds = np.flatnonzero(low.data == 10)
        head = np.unique(np.concatenate([np.searchsorted(w.start, feeds), w.bounds[:-1]]))
        head = head[head < len(w.start)]
        self.doc = np.searchsorted(w.bounds, head, "right") - 1
        self.number = np.searchsorted(feeds, w.start[head]) - np.searchsorted(feeds, low.offsets[:-1])[self.doc]
        h = arrays.span_hashes(low.data, w.start, w.end)
        line = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(w.start))))
        by = h if rank is None else (rank[(h >> _CELL_SHIFT).astype(np.int64)] << _CELL_SHIFT) | (h & _WITHIN)
        order = arrays.by_group(line, by, len(head))
        h, line = h[order], line[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        self.token, self.line = h[new], line[new]
        self.start = np.flatnonzero(np.diff(self.line, prepend=-1))
        self.size = np.diff(np.append(self.start, len(self.line)))
        self.set = self.sketch = self.half = np.zeros(0, np.uint64)
        if len(self.start):
            mixed = arrays.mix(self.token)
            self.set = arrays.mix(np.add.reduceat(mixed, self.start) + self.size.astype(np.uint64))
            flip = np.left_shift(np.uint64(1), mixed & np.uint64(63))
            self.sketch = np.bitwise_xor.reduceat(flip, self.start)
            # of every second token: with the sketch of all it makes one of 128 bits
            self.half = np.bitwise_xor.reduceat(flip * (mixed >> np.uint64(63)), self.start)
        self.mark = (self.set & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def wide(self) -> np.ndarray:
        """A parity sketch of 256 more bits for each line."""
        if not len(self.start):
            return np.zeros((0, WIDE), np.uint64)
        bit = arrays.mix(self.token) >> np.uint64(6)
        flip, word = np.left_shift(np.uint64(1), bit & np.uint64(63)), (bit >> np.uint64(6)) % np.uint64(WIDE)
        return np.stack([np.bitwise_xor.reduceat(np.where(word == w, flip, np.uint64(0)), self.start) for w in range(WIDE)], 1)

    def find(self, doc: np.ndarray, line: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the lines asked for stand, and which of those asked for are there."""
        have, want = self.doc << 40 | self.number, doc << 40 | line
        at = np.searchsorted(have, want)
        use = at < len(have)
        use[use] = (have[at[use]] == want[use]) & (self.mark[at[use]] == mark[use])
        return at[use], use


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(id, text) with a bigint id in the order of the ids; for ids that are no integers their ranks, also as (given, id)."""
    given, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text")
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        return docs.select(given.cast("bigint").alias("id"), text).where("id is not null"), None
    ranks = docs.select(given.alias("given")).where("given is not null").distinct().orderBy("given")
    ranks = written(ranks.select("given", F.monotonically_increasing_id().alias("id")), "line-ids")
    return docs.select(given.alias("given"), text).join(ranks, "given").select("id", "text"), ranks


def _frequencies(texts: DataFrame) -> np.ndarray:
    """How often the tokens of each cell occur in all texts; tasks add up, then each part of the cells over all tasks, in a stream."""
    names = ["part", "counts"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for block in arrays.blocks(batch.column(0)):
                low = block.lowered()
                w = arrays.words(low)
                total += np.bincount((arrays.span_hashes(low.data, w.start, w.end) >> _CELL_SHIFT).astype(np.int64), minlength=CELLS)
            arrays.trim()
        parts = CELLS // WIDTH
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), pa.array([x.tobytes() for x in total.reshape(parts, WIDTH)], pa.binary())], names=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(counts.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=names)

    out = np.zeros(CELLS, np.int64)
    counted = texts.select("text").mapInArrow(count, "part int, counts binary").repartition("part").mapInArrow(add, "part int, counts binary")
    for r in counted.toArrow().to_pylist():
        out[r["part"] * WIDTH : (r["part"] + 1) * WIDTH] += np.frombuffer(r["counts"], np.int64)
    return out


def _pack(f: dict[str, np.ndarray]) -> bytes:
    """Entries as bytes: what is random as it is, what is small or grows slowly compressed."""
    n = len(f["token"])
    plain = b"".join(f[c].tobytes() for c in ("token", "mark", "sketch"))
    small = b"".join(f[c].astype(np.uint32).tobytes() for c in ("size", "place", "line")) + np.diff(f["id"], prepend=0).tobytes()
    if "wide" in f:
        small += f["open"].tobytes() + f["wide"].tobytes()
    else:
        small += f["half"].tobytes()
    return n.to_bytes(8, "little") + plain + zlib.compress(small, 1)


def _unpack(raw: bytes) -> dict[str, np.ndarray]:
    n = int.from_bytes(raw[:8], "little")
    small = zlib.decompress(raw[8 + 16 * n :])
    get = lambda kind, at, data=raw, count=n: np.frombuffer(data, kind, count, at)
    out = {"token": get(np.uint32, 8), "mark": get(np.uint32, 8 + 4 * n), "sketch": get(np.uint64, 8 + 8 * n)}
    out |= {c: get(np.uint32, 4 * n * k, small) for k, c in enumerate(("size", "place", "line"))}
    out["id"] = np.cumsum(get(np.int64, 12 * n, small))
    if len(small) > 28 * n:
        return out | {"open": get(bool, 20 * n, small), "wide": get(np.uint64, 21 * n, small, n * WIDE).reshape(n, WIDE)}
    return out | {"half": get(np.uint64, 20 * n, small)}


def _spread(token: np.ndarray, mark: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries go on, and their tokens: for a token of g > 1 blocks, g copies, one for each other block that its own meets."""
    copies = blocks
    at = np.repeat(np.arange(len(token)), copies)
    out = token[at]
    some = np.flatnonzero(copies[at] > 1)
    if len(some):
        g = copies[at][some].astype(np.uint64)
        other = (np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies))[some].astype(np.uint64)
        own = arrays.mix(mark[at][some].astype(np.uint64)) % g
        pair = np.minimum(own, other) * g + np.maximum(own, other)
        out[some] = arrays.mix(out[some] + (pair + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return at, out


def _cell(token: np.ndarray) -> np.ndarray:
    return (token & np.uint64(SEEN - 1)).astype(np.int64)


@dataclass
class Dealer:
    """Gathers the prefix entries of lines and sends them to buckets."""

    rank: np.ndarray
    blocks: np.ndarray  # of lines, for the tokens of each cell
    buckets: int

    def entries(self, x: Lines, ids: np.ndarray, lines: np.ndarray | None = None, seen: np.ndarray | None = None, **more: np.ndarray) -> dict[str, np.ndarray]:
        """Of all lines, or of those at the given places with further fields; all entries, or those whose token's cell was seen."""
        wanted, of = np.ones(len(x.size), bool), np.arange(len(x.size))
        if lines is not None:
            wanted[:] = False
            wanted[lines] = True
            of[lines] = np.arange(len(lines))
        place = np.arange(len(x.line)) - x.start[x.line]
        use = (place < (x.size - (4 * x.size + 4) // 5 + 1)[x.line]) & (wanted & (x.size > 3))[x.line]
        if seen is not None:
            use &= seen[_cell(x.token)]
        at = slice(None) if lines is None else lines
        return {"of": of[x.line[use]], "token": x.token[use], "place": place[use], "set": x.set[at], "mark": x.mark[at], "sketch": x.sketch[at], "half": x.half[at], "size": x.size[at], "line": x.number[at], "id": ids[at], **more}

    def send(self, kept: list[dict[str, np.ndarray]]) -> tuple[pa.Array, pa.Array]:
        """Buckets and their packed entries."""
        f = {c: np.concatenate([k[c] for k in kept]) for c in kept[0]}
        # a set is sent for its first line in the chunk only
        first = np.zeros(len(f["set"]), bool)
        first[np.unique(f["set"], return_index=True)[1]] = True
        line = f.pop("of") + np.repeat(np.cumsum([0] + [len(k["set"]) for k in kept[:-1]]), [len(k["of"]) for k in kept])
        use = first[line]
        line, token, place = line[use], f["token"][use], f["place"][use]
        at, token = _spread(token, f["mark"][line], self.blocks[(token >> _CELL_SHIFT).astype(np.int64)])
        line, place = line[at], place[at]
        bucket = ((token >> np.uint64(13)) % np.uint64(self.buckets)).astype(np.uint32)
        order = np.argsort(bucket.astype(np.uint16) if self.buckets < 1 << 16 else bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        some = np.flatnonzero(np.diff(edge))
        rows = []
        for b in some.tolist():
            k = order[edge[b] : edge[b + 1]]
            m = line[k]
            rows.append(_pack({"token": token[k].astype(np.uint32), "place": place[k], **{c: f[c][m] for c in f if c not in ("token", "place", "mark", "set")}, "mark": f["mark"][m].astype(np.uint32)}))
        return pa.array(some, pa.int32()), pa.array(rows, pa.binary())


def _dealer(texts: DataFrame, counts: np.ndarray, entries: int):
    """Makes, on an executor, a dealer for about so many entries; its tables are broadcast and of bounded size."""
    rank = np.empty(CELLS, np.uint64)
    rank[np.argsort(counts, kind="stable")] = np.arange(CELLS, dtype=np.uint64)
    spark = texts.sparkSession
    tables, buckets = spark.sparkContext.broadcast((rank, np.maximum(1, -(-counts // HOT)))), max(partitions(spark), -(-entries // BUCKET))
    return lambda: Dealer(*tables.value, buckets)


def _entries(texts: DataFrame, counts: np.ndarray) -> DataFrame:
    """Rows of two kinds from one pass: (id, line, set) of each line, and (bucket, entries), the prefix entries of some MB of text that belong to a bucket."""
    dealer = _dealer(texts, counts, int(counts.sum()) // 5)
    names = ["id", "line", "set", "bucket", "entries"]

    def send(to: Dealer, kept: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        sent = to.send(kept)
        none = pa.nulls(len(sent[0]), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, *sent], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, kept, held = dealer(), [], 0
        for batch in batches:
            for block in arrays.blocks(batch.column(1)):
                x = Lines(block, to.rank)
                ids = batch.column(0).slice(block.first, len(block)).to_numpy()[x.doc]
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(x.number), pa.array(x.set.view(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
                kept.append(to.entries(x, ids))
                held += len(block.data)
                if held > CHUNK_BYTES:
                    yield send(to, kept)
                    kept, held = [], 0
                    arrays.trim()
        if kept:
            yield send(to, kept)

    return texts.mapInArrow(run, "id bigint, line bigint, set bigint, bucket int, entries binary")


def _seen(texts: DataFrame, counts: np.ndarray, lines: DataFrame) -> np.ndarray:
    """Which cells have a token of the prefixes of the given lines (id, line, mark, open)."""
    dealer = _dealer(texts, counts, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, out = dealer(), np.zeros(SEEN, bool)
        for batch in batches:
            for block, doc, line, mark, _ in _asked(batch):
                x = Lines(block, to.rank)
                out[_cell(to.entries(x, x.doc, x.find(doc, line, mark)[0])["token"])] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(out))], names=["cell"])

    out = np.zeros(SEEN, bool)
    out[_picked(texts, lines)[0].mapInArrow(run, "cell bigint").distinct().toArrow()["cell"].to_numpy()] = True
    return out


def _wide_entries(texts: DataFrame, counts: np.ndarray, lines: DataFrame, seen: np.ndarray | None = None) -> DataFrame:
    """(bucket, entries) of the given lines (id, line, mark, open), with long sketches and whether the line is open; of all tokens, or those that were seen."""
    picked, n = _picked(texts, lines)
    dealer = _dealer(texts, counts, 16 * n)
    cells = None if seen is None else texts.sparkSession.sparkContext.broadcast(np.packbits(seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, kept, held = dealer(), [], 0
        some = None if cells is None else np.unpackbits(cells.value).astype(bool)
        for batch in batches:
            for block, doc, line, mark, given in _asked(batch):
                x = Lines(block, to.rank)
                at, use = x.find(doc, line, mark)
                ids = batch.column(0).slice(block.first, len(block)).to_numpy()[x.doc]
                kept.append(to.entries(x, ids, at, some, open=given[use], wide=x.wide()[at]))
                held += len(block.data)
                if held > CHUNK_BYTES:
                    yield pa.RecordBatch.from_arrays([*to.send(kept)], names=["bucket", "entries"])
                    kept, held = [], 0
                    arrays.trim()
        if kept:
            yield pa.RecordBatch.from_arrays([*to.send(kept)], names=["bucket", "entries"])

    return picked.mapInArrow(run, "bucket int, entries binary")


def _picked(texts: DataFrame, lines: DataFrame) -> tuple[DataFrame, int]:
    """(id, text, lines) of the texts that have wanted lines (id, line, mark, open), with those; and how many lines."""
    wanted = written(lines.groupBy("id").agg(F.collect_set(F.struct("line", "mark", "open")).alias("lines")), "wanted-lines")
    docs, n = wanted.agg(F.count("*"), F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()
    return texts.join(F.broadcast(wanted) if docs <= SENT else wanted, "id").select("id", "text", "lines"), n


def _asked(batch: pa.RecordBatch) -> Iterator[tuple[arrays.Block, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of text with the lines asked for in them: text, line number, mark, and whether they are open; each line once, in order."""
    for block in arrays.blocks(batch.column(1)):
        mine = batch.column(2).slice(block.first, len(block))
        doc = np.repeat(np.arange(len(block)), mine.value_lengths().to_numpy())
        line, mark, given = (mine.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(3))
        order = np.lexsort((mark, line, doc))
        yield block, doc[order], line[order], mark[order], given[order]


class Bucket:
    """Entries of a bucket, each set once for a token, at its first place; in order of token and size."""

    def __init__(self, rows: list[bytes]):
        parts = [_unpack(r) for r in rows]
        f = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
        key = (f["token"].astype(np.uint64) << np.uint64(32)) | f["mark"]
        order = np.argsort(key)
        key = key[order]
        again = np.flatnonzero(key[1:] == key[:-1])
        if len(again):  # the lines of a repeated set in order
            at = np.unique(np.concatenate([again, again + 1]))
            k = order[at]
            order[at] = k[np.lexsort((f["line"][k], f["id"][k], f["sketch"][k], key[at]))]
        sketch = f["sketch"][order]
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (sketch[1:] != sketch[:-1])
        order = order[keep]
        self.size = f["size"][order].astype(np.int64)
        key = (f["token"][order].astype(np.uint64) << np.uint64(32)) | self.size.astype(np.uint64)
        again = np.argsort(key, kind="stable")
        order, self.key, self.size = order[again], key[again], self.size[again]
        self.left = self.size - f["place"][order]  # from the shared token on
        self.id, self.line, self.mark, self.sketch = (f[c][order] for c in ("id", "line", "mark", "sketch"))
        self.open, self.wide, self.half = (f[c][order] if c in f else None for c in ("open", "wide", "half"))
        token = self.key >> np.uint64(32)
        self.head = np.flatnonzero(np.diff(token, prepend=~token[:1]) != 0)
        first = token << np.uint64(32)
        self.low = np.searchsorted(self.key, first | ((4 * self.size + 4) // 5).astype(np.uint64))
        self.high = np.searchsorted(self.key, first | (self.size * 5 // 4).astype(np.uint64), "right")

    def able(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs, those that can be similar: the later entry, the earlier one, and how many bits of their sketches differ."""
        total = self.size[i] + self.size[j]
        use = np.minimum(self.left[i], self.left[j]) * 9 >= total * 4
        i, j, total = i[use], j[use], total[use]
        other = self.sketch[i] ^ self.sketch[j]
        bits = np.bitwise_count(other).astype(np.int64)
        use = bits * 9 <= total
        i, j, total, bits, other = i[use], j[use], total[use], bits[use], other[use]
        if self.wide is not None:
            bits = np.maximum(bits, np.bitwise_count(self.wide[i] ^ self.wide[j]).astype(np.int64).sum(1))
        else:
            half = self.half[i] ^ self.half[j]
            bits = np.bitwise_count(half).astype(np.int64) + np.bitwise_count(half ^ other)
        use = (bits * 9 <= total) & ((self.id[i] != self.id[j]) | (self.line[i] != self.line[j]))
        i, j, bits = i[use], j[use], bits[use]
        later = (self.id[i] > self.id[j]) | ((self.id[i] == self.id[j]) & (self.line[i] > self.line[j]))
        return np.where(later, i, j), np.where(later, j, i), bits

    def ranges(self, i: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of each i with low .. high - 1, some at a time."""
        to = np.cumsum(high - low)
        done = at = 0
        while at < len(i):
            end = max(at + 1, int(np.searchsorted(to, done + PAIRS_AT_ONCE, "right")))
            if end == at + 1 and to[at] - done > PAIRS_AT_ONCE:  # one with many
                for k in range(int(low[at]), int(high[at]), PAIRS_AT_ONCE):
                    j = np.arange(k, min(k + PAIRS_AT_ONCE, int(high[at])))
                    yield np.full(len(j), i[at]), j
            else:
                n = (high - low)[at:end]
                yield np.repeat(i[at:end], n), np.arange(int(n.sum())) + np.repeat(low[at:end] - (np.cumsum(n) - n), n)
            done, at = int(to[end - 1]), end

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines of a token of many that look near one of the earliest lines: those, the nearest, and how many bits differ."""
        out = []
        edge = np.append(self.head, len(self.key))
        for k in np.flatnonzero(np.diff(edge) > MANY).tolist():
            member = np.arange(edge[k], edge[k + 1])
            lead = member[np.lexsort((self.line[member], self.id[member]))[:LEADERS]]
            for part in range(0, len(member), PAIRS_AT_ONCE // LEADERS):
                m = member[part : part + PAIRS_AT_ONCE // LEADERS]
                x, y, bits = self.able(np.repeat(m, len(lead)), np.tile(lead, len(m)))
                near = bits * 18 <= self.size[x] + self.size[y]
                out.append(_least(x[near], y[near], bits[near])[:3])
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return _least(*(np.concatenate(c) for c in zip(*out, strict=True)))[:3]


def _least(x: np.ndarray, y: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each x the y of the fewest bits, and how many it has."""
    order = np.lexsort((y, bits, x))
    x, y, bits = x[order], y[order], bits[order]
    head = np.flatnonzero(np.diff(x, prepend=-1))
    return x[head], y[head], bits[head], np.diff(np.append(head, len(x)))


def _candidates(rows: list[bytes], every: bool) -> Iterator[pa.RecordBatch]:
    """For each line of a bucket with candidates that which differs least, whether it looks near, and whether there may be others; and the lines that are candidates (without x).

    Of entries with long sketches, for each open line the nearest candidate if that looks near, else, or with ``every``, all.
    """
    b = Bucket(rows)

    def batch(x: np.ndarray, y: np.ndarray, bits: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
        of = lambda k: [pa.array(v[k].astype(np.int64), mask=k < 0) for v in (b.id, b.line, b.mark)]
        near = bits * 18 <= b.size[x] + b.size[y]
        return pa.RecordBatch.from_arrays([*of(x), *of(y), pa.array(bits), pa.array(near), pa.array(more)], names=[c.split()[0] for c in _FOUND.split(", ")])

    if b.open is not None:
        i = np.flatnonzero(b.open)
        best, nearest = np.full(len(b.key), -1), np.full(len(b.key), 1 << 40)
        far: list[tuple[np.ndarray, np.ndarray]] = []

        def others() -> pa.RecordBatch:
            x, y = (np.concatenate(c) for c in zip(*far, strict=True))
            use = best[x] < 0
            return batch(x[use], y[use], np.zeros(int(use.sum()), np.int64), np.zeros(int(use.sum()), bool))

        for p in b.ranges(i, b.low[i], b.high[i]):
            x, y, bits = b.able(*p)
            near = b.open[x] & (bits * 12 <= b.size[x] + b.size[y]) & (not every)
            use = b.open[x] & ~near & (best[x] < 0)
            far.append((x[use], y[use]))
            k, other, least, _ = _least(x[near], y[near], bits[near])
            use = least < nearest[k]
            best[k[use]], nearest[k[use]] = other[use], least[use]
            if sum(len(f[0]) for f in far) > PAIRS_AT_ONCE:
                yield others()
                far.clear()
        if far:
            yield others()
        x = np.flatnonzero(best >= 0)
        yield batch(x, best[x], nearest[x], np.ones(len(x), bool))
        return
    settled = b.settle()
    done = np.zeros(len(b.key), bool)
    done[settled[0]] = True
    size = np.diff(np.append(b.head, len(b.key)))
    many = np.repeat(size > MANY, size)
    best, nearest, found = np.full(len(b.key), -1), np.full(len(b.key), 1 << 40), np.zeros(len(b.key), np.int64)
    candidate = np.zeros(len(b.key), bool)
    one, rest = np.flatnonzero(~many), np.flatnonzero(many & ~done)
    # of two lines the one behind in the bucket looks for the other; where many are settled, those that are not look both ways
    for i, low, high, both in ((one, b.low[one], one, False), (rest, b.low[rest], b.high[rest], True)):
        for p in b.ranges(i, low, high):
            x, y, bits = b.able(*p)
            candidate[y] = True  # of a settled line too: the line near which it settled may turn out not to be similar
            if both:
                use = ~done[x]
                x, y, bits = x[use], y[use], bits[use]
            x, y, bits, n = _least(x, y, bits)
            found[x] += n
            use = bits < nearest[x]
            best[x[use]], nearest[x[use]] = y[use], bits[use]
    x, settled_x = np.flatnonzero(best >= 0), settled[0]
    candidate[settled[1]] = True
    candidate[x] = candidate[settled_x] = False
    yield batch(np.concatenate([x, settled_x]), np.concatenate([best[x], settled[1]]), np.concatenate([nearest[x], settled[2]]), np.concatenate([found[x] > 1, np.ones(len(settled_x), bool)]))
    y = np.flatnonzero(candidate)
    yield batch(np.full(len(y), -1), y, np.zeros(len(y), np.int64), np.zeros(len(y), bool))


def _compared(entries: DataFrame, every: bool = False) -> DataFrame:
    """The candidates in all buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[bytes] = []
        for b in batches:
            rows += b.column("entries").to_pylist()
        yield from _candidates(rows, every)
        arrays.trim()

    return entries.groupBy("bucket").applyInArrow(run, _FOUND)


def _token_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Token sets (id, line, mark, items) of the wanted lines, taken again from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, doc, line, mark, _ in _asked(batch):
                x = Lines(block)
                at, use = x.find(doc, line, mark)
                size = x.size[at]
                to = np.cumsum(size)
                items = x.token[np.arange(int(size.sum())) + np.repeat(x.start[at] - (to - size), size)]
                ids = batch.column(0).slice(block.first, len(block)).to_numpy()
                items = pa.ListArray.from_arrays(pa.array(np.append(0, to).astype(np.int32)), pa.array(items.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc[use]]), pa.array(line[use]), pa.array(mark[use]), items], names=["id", "line", "mark", "items"])
            arrays.trim()

    picked, _ = _picked(texts, wanted.withColumn("open", F.lit(False)))
    return picked.mapInArrow(run, f"{_LINE}, items array<bigint>").dropDuplicates(["id", "line", "mark"])


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The x of the pairs with 100 * intersection >= 80 * union."""
    ends = [pairs.select(*(F.col(c).alias(c[2:]) for c in side)) for side in (X, Y)]
    sets = _token_sets(texts, ends[0].union(ends[1]).distinct())
    side = lambda s: sets.select(*(F.col(c).alias(f"{s}_{c}") for c in ("id", "line", "mark", "items")))
    both = pairs.select(*X, *Y).join(side("y"), Y).join(side("x"), X)
    n = F.size(F.array_intersect("x_items", "y_items"))
    return both.where(n * 100 >= (F.size("x_items") + F.size("y_items") - n) * 80).select(*X).distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lines that go, as (id, removed: line numbers from 0 in ascending order), for the documents that lose any.

    A line is a part between line feeds that has words. Words are runs of characters other than white space, A-Z
    lower-cased; a line is the set of its distinct words. Lines are in order of document id, then line number; a line
    goes if any earlier line (whether or not that goes too) has 100 * intersection >= 80 * union. Ids may be of any
    type that can be ordered. Lines at the same place of rows that repeat an id are not earlier than each other, and
    what goes from one of these rows goes from all. Documents with a null id are left out and lose nothing; null and
    empty texts have no lines; an empty table gives no rows. Texts and lines of any length are read whole, other
    columns of ``docs`` are not read, and nothing is capped: see the second pass above. Words are compared by 64-bit
    hashes, sets by hashes of 96 bits and their place.
    """
    with Scratch(docs.sparkSession) as scratch:
        return scratch.keep(_repeated_lines(docs, id_col, text_col), "repeated-lines")


def _repeated_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts, ranks = _texts(docs, id_col, text_col)
    counts = _frequencies(texts)
    base = written(_entries(texts, counts), "lines")
    found = written(_compared(base.where("bucket is not null").select("bucket", "entries")), "line-pairs")

    lines = base.where("bucket is null").select("id", "line", "set")
    place = F.struct("id", "line")
    repeated = lines.groupBy("set").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("set", "first")
    repeated = written(lines.join(repeated, "set").where(place > F.col("first")).select("id", "line"), "equal-lines")
    discard(base)

    order = F.struct(~F.col("near"), "bits", *Y)
    near = found.where("x_id is not null").groupBy(*X).agg(F.min_by(F.struct(*Y, "near"), order).alias("y"), (F.bool_or("more") | (F.min(F.struct(*Y)) != F.max(F.struct(*Y)))).alias("more"))
    near = written(near.select(*X, "y.*", "more"), "nearest-lines")
    done = near.where("near").select(*X, *Y)
    similar = written(_verified(texts, done), "similar-lines")
    rest = written(near.where("more or not near").select(*X).join(similar, X, "left_anti"), "open-lines")
    line = lambda side: [F.col(c).alias(c[2:]) for c in side]
    known = near.select(*line(X)).union(found.select(*line(Y))).distinct()
    for every in (False, True):
        if rest.isEmpty():
            break
        lines = known.join(rest.select(*line(X), F.lit(True).alias("open")), ["id", "line", "mark"], "left").na.fill(False, ["open"])
        seen = _seen(texts, counts, lines.where("open")) if every else None
        pairs = written(_compared(_wide_entries(texts, counts, lines, seen), every).groupBy(*X, *Y).agg(F.bool_or("more").alias("more")), "more-pairs")
        found_now = written(_verified(texts, pairs.select(*X, *Y).join(done, [*X, *Y], "left_anti")), "similar-lines")
        similar = similar.union(found_now)
        rest = written(pairs.where("more").select(*X).distinct().join(found_now, X, "left_anti"), "open-lines")
    goes = repeated.union(similar.select("x_id", "x_line"))
    goes = goes.groupBy("id").agg(F.sort_array(F.collect_set("line")).alias("removed"))
    return goes if ranks is None else goes.join(ranks, "id").select(F.col("given").alias("id"), "removed")


def _with_removed(docs: DataFrame, id_col: str, text_col: str, columns: list[F.Column], texts: bool = False) -> tuple[DataFrame, str]:
    """The given columns of all rows of ``docs`` and, under a name that is not taken, the line numbers that go (null: none). With ``texts`` among the columns, these are shuffled only for very many such lines."""
    name = "_removed"
    while name in docs.columns:
        name += "_"
    gone = repeated_lines(docs, id_col, text_col).select(F.col("id").alias(f"{name}id"), F.col("removed").alias(name))
    if texts:
        gone = sent(gone, gone.agg(F.coalesce(F.sum(F.size(name)), F.lit(0))).first()[0])
    rows = docs.select(*columns, F.col(f"`{id_col}`").alias(f"{name}key"))
    return rows.join(gone, F.col(f"{name}key") == F.col(f"{name}id"), "left").drop(f"{name}id", f"{name}key"), name


def summarize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: the id column, n_lines (parts between line feeds; null or empty text: 0), n_removed, removed (line numbers)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    n = F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    rows, removed = _with_removed(docs, id_col, text_col, [F.col(f"`{id_col}`"), n.cast("bigint").alias("n_lines")])
    gone = F.coalesce(removed, F.array().cast("array<bigint>"))
    return rows.select(f"`{id_col}`", "n_lines", F.size(gone).cast("bigint").alias("n_removed"), gone.alias("removed"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds cleaned_text, the text without the lines that go, to every row of ``docs`` (a column of that name is replaced; a null text stays null)."""
    keep = [f"`{c}`" for c in docs.columns if c != "cleaned_text"]
    rows, removed = _with_removed(docs, id_col, text_col, [F.col(c) for c in keep], texts=True)
    left = F.array_join(F.filter(F.split(F.col(f"`{text_col}`"), "\n"), lambda _, i: ~F.array_contains(F.col(removed), i.cast("bigint"))), "\n")
    return rows.select(*keep, F.when(F.col(removed).isNull(), F.col(f"`{text_col}`")).otherwise(left).alias("cleaned_text"))
