"""Language-model scoring by a hierarchical Pitman-Yor model (operator 5).

Three linked levels. Each word has a restaurant for what follows it, which seats the training tokens behind that word
(the token at the end of a text is also the context of a first word). All of these share one parent, the restaurant of
words without context: a table of a context sends one customer there. The base of its tables is a spelling model: a
hierarchy of restaurants whose contexts are the last two, one and no bytes of a word, each context restaurant sharing
the parent that drops its oldest byte. A table of the word restaurant sends one customer per byte of its word to the
spelling restaurants. Seating is sampled by Gibbs, a dish's customers at once: the tables of each bigram, of each word and
of each spelling dish are drawn given its customers and its probability in the parent, by generalized Stirling numbers,
and each table is a customer of the parent. Probabilities are averaged over samples.

Nothing is joined token by token. Texts become chunks: the distinct words of some MB of text, and its tokens as places
among them. Only distinct words and distinct bigrams are sent to the part that owns them, which answers every chunk in
the order of its question. Bigrams are dealt by the hash of both words, so the successors of a frequent word lie in all
parts; a frequent word or bigram costs one entry a chunk, and no key is hot. The first chunk that asks for a bigram
seats it and sends the sums over its bigrams to the parts of the vocabulary. Random numbers come from a bigram's hash,
so every other chunk draws the same tables again when it scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache, reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import arrays
from sievework.llm.shared import Scratch, delete, discard, release, shared_dir, written

#: Bytes of text in a chunk.
CHUNK_BYTES = 8 << 20
#: Symbols of a spelling: bytes, then the end of a word; as context, 256 also stands for the start.
SYMBOLS = 257
END = 256
#: The hash of the token at the end of a text.
END_TOKEN = np.uint64(0x9B1C5D3E7F2A4861)
#: Customers of a dish up to which its tables are drawn by exact Stirling numbers; beyond, by their limit for large counts.
STIRLING = 512
#: Numbers that are drawn from at once, for the tables of some dishes.
SEAT_CELLS = 1 << 17
#: Bytes of text for each part of the vocabulary and of the bigrams, and the most parts.
PART_BYTES, PARTS = 16 << 20, 100_000
#: Rounds in which the chunks meet all their replies, so that the shuffle of only one round lies on disk.
ROUNDS = 4


@dataclass(frozen=True)
class Settings:
    pair_discount: float | None = None  # None: n1 / (n1 + 2 n2) of the bigrams seen once and twice
    pair_strength: float = 1.0
    word_discount: float | None = None  # None: the same of the words that one and two tables of bigrams have
    word_strength: float = 10.0
    spell_discount: float = 0.5
    spell_strength: float = 1.0
    sweeps: int = 3  # passes over bigrams and vocabulary; the first starts with one table for each dish
    samples: int = 3  # of the spelling restaurants, after each pass
    burn_in: int = 4  # passes over the spelling restaurants before their first sample
    seed: int = 5


def thrifty(run):
    """A function of groups that leaves little memory behind: a worker sees one group after another, and idle ones wait."""

    def kept(out: pa.Table) -> pa.Table:
        arrays.trim()
        return out

    if run.__code__.co_argcount == 1:
        return lambda table: kept(run(table))
    return lambda left, right: kept(run(left, right))


def pack(a: np.ndarray) -> bytes:
    """An array's bytes, compressed, behind their number."""
    data = np.ascontiguousarray(a).tobytes()
    return len(data).to_bytes(8, "little") + (pa.compress(data, codec="zstd", asbytes=True) if data else b"")


def unpack(b: bytes, dtype) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return np.frombuffer(pa.decompress(b[8:], n, codec="zstd", asbytes=True) if n else b"", dtype)


def by_owner(owner: np.ndarray, buckets: int) -> np.ndarray:
    """The order by part, else as they stand."""
    return np.argsort(owner.astype(np.uint16) if buckets <= 1 << 16 else owner, kind="stable")


def distinct_places(key: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of 0 to ``end`` - 1, ascending, and where each stands among them. Where number and place fit 63 bits, they are sorted as one."""
    bits = len(key).bit_length()
    if end << bits >= 1 << 63:
        return np.unique(key, return_inverse=True)
    both = np.sort((key << bits) | np.arange(len(key)))
    key, place = both >> bits, both & ((1 << bits) - 1)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    out = np.empty(len(key), np.int64)
    out[place] = np.cumsum(new) - 1
    return key[new], out


# ---- seating ----


@lru_cache(maxsize=8)
def log_stirling(d: float, most: int = STIRLING) -> np.ndarray:
    """log of the generalized Stirling numbers S(c, t) for 0 <= t <= c <= most."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[0, 0] = 0
    t = np.arange(most + 1)
    for c in range(1, most + 1):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = s[c - 1] + np.log(np.maximum(c - 1 - d * t, 0))
        s[c] = np.logaddexp(np.where(np.isfinite(s[c - 1]), stay, -np.inf), np.concatenate([[-np.inf], s[c - 1, :-1]]))
    return s


def discount(once: int, twice: int) -> float:
    return min(0.9, max(0.05, once / (once + 2 * twice))) if once else 0.5


def seat(hashes: np.ndarray, count: np.ndarray, log_a: np.ndarray, discount: float, sweep: int, s: Settings) -> np.ndarray:
    """Samples the number of tables of each dish from its conditional; ``log_a`` is the logarithm of the weight of a new table. Random numbers come from the dish's hash, so any task draws the same."""
    u = (arrays.mix(hashes + np.uint64(1 + sweep + 1000 * s.seed)) >> np.uint64(11)) * 2.0**-53
    out = np.minimum(count, 1).astype(np.int64)
    stirling = log_stirling(discount)
    for low in (2**i for i in range(STIRLING.bit_length() - 1)):
        high = 2 * low
        few, t = np.flatnonzero((count > low) & (count <= high)), np.arange(high + 1)
        # numbers of tables by rows, dishes by columns: sums over few numbers run along many dishes
        by_count = np.ascontiguousarray(stirling[: high + 1, : high + 1].T)
        step = max(1, SEAT_CELLS // high)
        for i in range(0, len(few), step):
            k = few[i : i + step]
            w = by_count[:, count[k]] + t[:, None] * log_a[k]
            w -= w.max(0)
            edge = np.cumsum(np.exp(w, out=w), 0, out=w)
            out[k] = np.maximum(1, (edge < u[k] * edge[-1]).sum(0))
    many = np.flatnonzero(count > STIRLING)
    # for large counts S(c, t + 1) / S(c, t) is 1 / (t d): one table and a Poisson number of others, fewer than customers
    mean = np.exp(np.minimum(log_a[many], 40)) / discount
    out[many] = np.minimum(count[many], 1 + poisson(mean, u[many]))
    return out


def poisson(mean: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Quantiles of Poisson numbers: by their sum up to a mean of 64, above by the normal quantile and its first correction."""
    k = np.zeros(len(mean), np.int64)
    few = np.flatnonzero(mean <= 64)
    if len(few):
        p = np.exp(-mean[few])
        total, i = p.copy(), 0
        while (more := u[few] > total).any() and i < 300:
            i += 1
            k[few] += more
            p = p * mean[few] / i
            total += p
    many = np.flatnonzero(mean > 64)
    normal = NormalDist()
    z = np.array([normal.inv_cdf(min(max(x, 1e-15), 1 - 1e-15)) for x in u[many].tolist()])
    k[many] = np.maximum(0, np.floor(mean[many] + z * np.sqrt(mean[many]) + (z * z - 1) / 6 + 0.5)).astype(np.int64)
    return k


class Restaurants:
    """Seating of the spelling model: customers and tables of the dishes of contexts of 2, 1 and 0 bytes.

    Dishes of two bytes of context are those that occur; the others are all that can be (their number has a bound).
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, s: Settings):
        self.s, self.passes = s, 0
        order = np.argsort(keys)
        self.keys, two = keys[order].astype(np.int64), counts[order].astype(np.int64)
        self.customers = [np.zeros(SYMBOLS, np.int64), np.zeros(SYMBOLS**2, np.int64), two]
        self.tables = [c.copy() for c in self.customers]
        self._seat(lambda level: np.minimum(self.customers[level], 1))

    def _seat(self, draw) -> None:
        """Draws the tables of each level from the longest contexts on; they are the customers of the level above."""
        for level in (2, 1, 0):
            self.tables[level] = draw(level)
            if level:
                parent = self.keys % SYMBOLS**2 if level == 2 else np.arange(SYMBOLS**2) % SYMBOLS
                self.customers[level - 1] = np.bincount(parent, self.tables[level], SYMBOLS**level).astype(np.int64)

    def _back(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the dishes of a level: own weight by the context's customers, and by context the weight of the parent and that of a new table there."""
        d, a = self.s.spell_discount, self.s.spell_strength
        context = self.keys // SYMBOLS if level == 2 else np.arange(SYMBOLS ** (level + 1)) // SYMBOLS
        c, t = (np.bincount(context, x[level], SYMBOLS**level) for x in (self.customers, self.tables))
        own = (self.customers[level] - d * self.tables[level]) / (c[context] + a)
        return own, np.where(c > 0, (a + d * t) / (c + a), 1.0), a + d * t

    def table(self) -> Spelling:
        """Predictive probabilities of the present seating."""
        own, back, _ = self._back(0)
        base = own + back / SYMBOLS
        own, back, _ = self._back(1)
        first = own.reshape(SYMBOLS, SYMBOLS) + back[:, None] * base
        own, back, _ = self._back(2)
        return Spelling(self.keys, own, back, first)

    def sweep(self) -> None:
        """Draws the tables of all dishes anew, given the probabilities of the seating before."""
        self.passes += 1
        p = self.table()
        parents = [np.full(SYMBOLS, 1 / SYMBOLS), np.tile((self._back(0)[0] + self._back(0)[1] / SYMBOLS), SYMBOLS), p.first[self.keys // SYMBOLS % SYMBOLS, self.keys % SYMBOLS]]
        new = [self._back(level)[2] for level in range(3)]

        def draw(level: int) -> np.ndarray:
            at = self.keys if level == 2 else np.arange(SYMBOLS ** (level + 1))
            weight = np.log(new[level][at // SYMBOLS]) + np.log(parents[level])
            return seat(arrays.mix(at.astype(np.uint64) + np.uint64(level + 1)), self.customers[level], weight, self.s.spell_discount, self.passes, self.s)

        self._seat(draw)


@dataclass
class Spelling:
    """P(byte | two bytes before); its size is bounded by the number of contexts of two bytes, whatever the corpus."""

    keys: np.ndarray
    own: np.ndarray
    back: np.ndarray
    first: np.ndarray

    def words(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The natural logarithm of the probability of each word (its bytes and END), without a floor."""
        keys, _ = trigrams(symbols, lengths)
        p = self.back[keys // SYMBOLS] * self.first[keys // SYMBOLS % SYMBOLS, keys % SYMBOLS]
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            p = p + np.where(self.keys[at] == keys, self.own[at], 0)
        ends = np.cumsum(lengths + 1)
        return np.add.reduceat(np.log(p), ends - lengths - 1) if len(lengths) else np.zeros(0)


def trigrams(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of each symbol of each word with the two before it, and the word that it belongs to."""
    size = lengths.astype(np.int64) + 1
    to = np.cumsum(size)
    total = int(to[-1]) if len(to) else 0
    x = np.full(total, END, np.int64)
    word = np.repeat(np.arange(len(size)), size)
    at = np.arange(total) - np.repeat(to - size, size)
    x[at < size[word] - 1] = symbols
    one = np.where(at >= 1, np.concatenate([[END], x[:-1]]), END)
    two = np.where(at >= 2, np.concatenate([[END, END], x[:-2]])[:total], END)
    return (two * SYMBOLS + one) * SYMBOLS + x, word


# ---- chunks ----


def chunks(docs: DataFrame, id_col: str, text_col: str, held: F.Column, buckets: int) -> DataFrame:
    """One row for each chunk: its tokens as places among its distinct words, and those words by the part that owns them."""
    key = docs.schema[id_col].dataType.simpleString()
    ask = pa.struct([("bucket", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary()), ("bytes", pa.binary()), ("lengths", pa.binary())])

    def chunk(number: int, kind: pa.DataType, parts: list) -> pa.RecordBatch:
        ids = pa.concat_arrays([p[0] for p in parts])
        held = np.concatenate([p[1] for p in parts])
        doc_words = np.concatenate([p[2] for p in parts])
        h = np.concatenate([p[3] for p in parts])
        data = np.concatenate([p[4] for p in parts])
        shift = np.cumsum([0] + [len(p[4]) for p in parts])
        start = np.concatenate([p[5] + b for p, b in zip(parts, shift, strict=False)])
        length = np.concatenate([p[6] for p in parts])
        doc = np.repeat(np.arange(len(doc_words)), doc_words)
        # a token at the end of each text, with an empty spelling
        n = len(doc_words)
        h, doc = np.concatenate([h, np.full(n, END_TOKEN, np.uint64)]), np.concatenate([doc, np.arange(n)])
        start, length = np.concatenate([start, np.zeros(n, np.int64)]), np.concatenate([length, np.zeros(n, np.int64)])
        distinct, first, place = np.unique(h, return_index=True, return_inverse=True)
        owner = (distinct >> np.uint64(33)) % np.uint64(buckets)
        order = by_owner(owner, buckets)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        distinct, first, owner, place = distinct[order], first[order], owner[order], rank[place]
        train = np.bincount(place, ~held[doc], len(distinct)).astype(np.uint32)
        ends = np.cumsum(doc_words + 1) - 1
        tokens = np.empty(len(place), np.uint32)
        tokens[np.arange(len(place) - n) + doc[: len(place) - n]] = place[: len(place) - n]
        tokens[ends] = place[len(place) - n :]
        edge = np.searchsorted(owner, np.arange(buckets + 1))
        size = length[first]
        asks = []
        for b in range(buckets):
            i, j = edge[b], edge[b + 1]
            if i < j:
                spot = np.repeat(start[first[i:j]] - (np.cumsum(size[i:j]) - size[i:j]), size[i:j]) + np.arange(int(size[i:j].sum()))
                asks.append({"bucket": b, "hashes": distinct[i:j].tobytes(), "counts": pack(train[i:j]), "bytes": pack(data[spot]), "lengths": pack(size[i:j].astype(np.uint32))})
        columns = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([pack(held)]), pa.array([pack((doc_words + 1).astype(np.uint32))]), pa.array([pack(tokens)]), pa.array([asks], pa.list_(ask))]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "held", "n_tokens", "tokens", "asks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        parts, held_bytes, kind = [], 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for block in arrays.blocks(batch.column(1)):
                low = block.lowered()
                w = arrays.words(low)
                h = arrays.span_hashes(low.data, w.start, w.end)
                parts.append((batch.column(0).slice(block.first, len(block)), np.asarray(batch.column(2).slice(block.first, len(block)).to_numpy(zero_copy_only=False), bool), np.diff(w.bounds), h, low.data, w.start, w.end - w.start))
                held_bytes += len(low.data)
                if held_bytes >= CHUNK_BYTES:
                    yield chunk(number, kind, parts)
                    number, parts, held_bytes = number + 1, [], 0
        if parts:
            yield chunk(number, kind, parts)

    schema = f"chunk bigint, ids array<{key}>, held binary, n_tokens binary, tokens binary, asks array<struct<bucket int, hashes binary, counts binary, bytes binary, lengths binary>>"
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"), held.alias("_held")).mapInArrow(run, schema)


@dataclass
class Pairs:
    """The distinct bigrams of a chunk: places of both words, hash, training count, the part that owns each, and for each token its bigram."""

    first: np.ndarray
    second: np.ndarray
    hash: np.ndarray
    train: np.ndarray
    order: np.ndarray  # by part
    edge: np.ndarray
    of_token: np.ndarray

    @staticmethod
    def of(hashes: list[bytes], tokens: bytes, n_tokens: bytes, held: bytes, buckets: int) -> Pairs:
        h, x = np.frombuffer(b"".join(hashes), np.uint64), unpack(tokens, np.uint32).astype(np.int64)
        # before a text stands the end of another, which is one token for all
        key, of_token = distinct_places(np.roll(x, 1) * len(h) + x, len(h) ** 2)
        first, second = key // len(h), key % len(h)
        both = arrays.mix(arrays.mix(h[first]) + h[second])
        owner = (both >> np.uint64(33)) % np.uint64(buckets)
        order = by_owner(owner, buckets)
        train = np.bincount(of_token, np.repeat(~unpack(held, bool), unpack(n_tokens, np.uint32)), len(key)).astype(np.uint32)
        return Pairs(first, second, both, train, order, np.searchsorted(owner[order], np.arange(buckets + 1)), of_token)

    def back(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of all training texts from the replies in order of parts, and whether this chunk seats the bigram."""
        x = np.empty(len(self.order), np.int64)
        x[self.order] = np.concatenate([unpack(f, np.int64) for f in found])
        return x >> 1, (x & 1).astype(bool)


#: The columns of a chunk that its bigrams are made of.
CHUNK = ["chunk", "held", "n_tokens", "tokens", "hashes", "buckets"]


def pair_counts(cut: DataFrame, buckets: int) -> DataFrame:
    """For each chunk and part of the bigrams: training counts, times two, plus one where the chunk is the first to ask; once and twice: how many of the part's bigrams have these counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                chunk, held, n_tokens, tokens, hashes, _ = (batch.column(i)[r].as_py() for i in range(6))
                p = Pairs.of(hashes, tokens, n_tokens, held, buckets)
                parts = [(b, p.order[p.edge[b] : p.edge[b + 1]]) for b in range(buckets) if p.edge[b] < p.edge[b + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([chunk] * len(parts), pa.int64()), pa.array([p.hash[k].tobytes() for _, k in parts], pa.binary()), pa.array([pack(p.train[k]) for _, k in parts], pa.binary())], names=["bucket", "chunk", "hashes", "counts"])

    def own(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x.as_py(), np.uint64) for x in table["hashes"]]
        bounds = np.cumsum([0] + [len(x) for x in hashes])
        distinct, first, place = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        counts = np.zeros(len(distinct), np.int64)
        for k, x in enumerate(table["counts"]):
            counts[place[bounds[k] : bounds[k + 1]]] += unpack(x.as_py(), np.uint32)
        found = counts[place] * 2
        found[first] += 1
        n = len(hashes)
        once, twice = ([int((counts == c).sum())] + [0] * (n - 1) for c in (1, 2))
        return pa.table([table["chunk"], table["bucket"], pa.array([pack(found[bounds[k] : bounds[k + 1]]) for k in range(n)], pa.binary()), pa.array(once, pa.int64()), pa.array(twice, pa.int64())], names=["chunk", "bucket", "found", "once", "twice"])

    asked = cut.select(*CHUNK).mapInArrow(ask, "bucket int, chunk bigint, hashes binary, counts binary")
    return asked.groupBy("bucket").applyInArrow(thrifty(own), "chunk bigint, bucket int, found binary, once bigint, twice bigint")


def to_seat(cut: DataFrame, counted: DataFrame, buckets: int) -> DataFrame:
    """For each chunk the bigrams that it seats: those of one customer as sums over second and first words, the others one by one."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk, held, n_tokens, tokens, hashes, parts = (left[c][0].as_py() for c in CHUNK)
        p = Pairs.of(hashes, tokens, n_tokens, held, buckets)
        count, mine = p.back(in_order(right, "found"))
        n = sum(map(len, hashes)) // 8
        one, k = mine & (count == 1), np.flatnonzero(mine & (count > 1))
        fields = [np.bincount(p.second[one], minlength=n), np.bincount(p.first[one], minlength=n), p.first[k], p.second[k], count[k]]
        packed = [pa.array([pack(f.astype(np.int64))], pa.binary()) for f in fields]
        return pa.table([left["chunk"], pa.array([parts], pa.list_(pa.int32())), pa.array([[len(h) // 8 for h in hashes]], pa.list_(pa.int32())), *packed, pa.array([p.hash[k].tobytes()], pa.binary())], names=["chunk", "buckets", "sizes", "second_once", "first_once", "first", "second", "count", "hashes"])

    schema = "chunk bigint, buckets array<int>, sizes array<int>, second_once binary, first_once binary, first binary, second binary, count binary, hashes binary"
    return cut.select(*CHUNK).groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(thrifty(run), schema)


def in_order(table: pa.Table, column: str) -> list:
    """A column of the replies to a chunk, in order of the parts that sent them."""
    some = table.filter(pa.compute.is_valid(table[column]))
    order = np.argsort(some["bucket"].to_numpy(), kind="stable").tolist()
    return [some[column][i].as_py() for i in order]


def pair_tables(hashes: np.ndarray, count: np.ndarray, value: np.ndarray, tables: np.ndarray, sweep: int, s: Settings) -> np.ndarray:
    """Tables of bigrams in a sweep, given the second word's log10 probability without context and the tables of the first word's restaurant before."""
    return seat(hashes, count, np.log(s.pair_strength + s.pair_discount * tables) + value * math.log(10), s.pair_discount, sweep, s)


def sent(seats: DataFrame, replies: DataFrame | None, sweep: int, s: Settings) -> DataFrame:
    """Seats all bigrams, given the replies of the sweep before (none: one table each); for each chunk and part of the vocabulary, the tables of its words as second and as first word."""
    names = ["chunk", "bucket", "customers", "tables"]
    schema = "chunk bigint, bucket int, customers binary, tables binary"

    def sums(r: dict, right: pa.Table | None) -> pa.Table:
        first, second, count = (unpack(r[c], np.int64) for c in ("first", "second", "count"))
        if right is None:
            t = np.ones(len(count), np.int64)
        else:
            value, tables = (np.concatenate([unpack(x, kind) for x in in_order(right, c)]) for c, kind in (("value", np.float64), ("tables", np.int64)))
            t = pair_tables(np.frombuffer(r["hashes"], np.uint64), count, value[second], tables[first], sweep, s)
        two, one = unpack(r["second_once"], np.int64).copy(), unpack(r["first_once"], np.int64).copy()
        two += np.bincount(second, t, len(two)).astype(np.int64)
        one += np.bincount(first, t, len(one)).astype(np.int64)
        edge = np.cumsum([0, *r["sizes"]])
        cuts = [slice(edge[k], edge[k + 1]) for k in range(len(r["buckets"]))]
        return pa.table([pa.array([r["chunk"]] * len(cuts), pa.int64()), pa.array(r["buckets"], pa.int32()), pa.array([pack(two[c]) for c in cuts], pa.binary()), pa.array([pack(one[c]) for c in cuts], pa.binary())], names=names)

    if replies is None:
        return seats.mapInArrow(lambda batches: (x for b in batches for r in range(b.num_rows) for x in sums(b.slice(r, 1).to_pylist()[0], None).to_batches()), schema)
    return seats.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(thrifty(lambda left, right: sums(left.to_pylist()[0], right)), schema)


def received(words: DataFrame, sums: DataFrame) -> DataFrame:
    """One row for each part of the vocabulary: customers of its words from tables of bigrams, and tables of the restaurants of which they are the context; once and twice: words with that many customers."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        customers, tables = (np.zeros(left["size"][0].as_py() // 8, np.int64) for _ in range(2))
        places = {a["chunk"]: a["places"] for a in left["asks"][0].as_py()}
        for chunk, c, t in zip(right["chunk"].to_pylist(), right["customers"], right["tables"], strict=True):
            at = unpack(places[chunk], np.uint32)
            customers[at] += unpack(c.as_py(), np.int64)
            tables[at] += unpack(t.as_py(), np.int64)
        return pa.table([left["bucket"], pa.array([pack(customers)], pa.binary()), pa.array([pack(tables)], pa.binary()), pa.array([int(customers.sum())]), pa.array([int((customers == 1).sum())]), pa.array([int((customers == 2).sum())])], names=["bucket", "customers", "tables", "n", "once", "twice"])

    asks = words.select("bucket", F.octet_length("hashes").alias("size"), "asks")
    return asks.groupBy("bucket").cogroup(sums.groupBy("bucket")).applyInArrow(thrifty(run), "bucket int, customers binary, tables binary, n bigint, once bigint, twice bigint")


def vocabulary(asked: DataFrame) -> DataFrame:
    """One row for each part of the vocabulary: its words once, with training counts, and for each chunk the places of the words it asked for."""

    def own(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x.as_py(), np.uint64) for x in table["hashes"]]
        bounds = np.cumsum([0] + [len(x) for x in hashes])
        distinct, first, place = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        counts = np.zeros(len(distinct), np.int64)
        for k, x in enumerate(table["counts"]):
            counts[place[bounds[k] : bounds[k + 1]]] += unpack(x.as_py(), np.uint32)
        lengths = np.zeros(len(distinct), np.uint32)
        pieces: list[np.ndarray] = []
        order = np.argsort(first, kind="stable")
        source = np.searchsorted(bounds, first[order], "right") - 1
        for k in range(len(hashes)):
            mine = order[source == k]
            if not len(mine):
                continue
            size = unpack(table["lengths"][k].as_py(), np.uint32).astype(np.int64)
            data = unpack(table["bytes"][k].as_py(), np.uint8)
            begin = np.cumsum(size) - size
            i = first[mine] - bounds[k]
            lengths[mine] = size[i]
            take = size[i]
            pieces.append(data[np.repeat(begin[i] - (np.cumsum(take) - take), take) + np.arange(int(take.sum()))])
        # pieces follow the order of first places; put them into the order of the hashes
        data = np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)
        size = lengths[order].astype(np.int64)
        begin = np.empty(len(order), np.int64)
        begin[order] = np.cumsum(size) - size
        size = lengths.astype(np.int64)
        data = data[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        asks = [{"chunk": c.as_py(), "places": pack(place[bounds[k] : bounds[k + 1]].astype(np.uint32))} for k, c in enumerate(table["chunk"])]
        return pa.table([pa.array([table["bucket"][0].as_py()], pa.int32()), pa.array([distinct.tobytes()]), pa.array([pack(counts)]), pa.array([pack(data)]), pa.array([pack(lengths)]), pa.array([int(counts.sum())], pa.int64()), pa.array([int((counts > 0).sum())], pa.int64()), pa.array([asks], pa.list_(pa.struct([("chunk", pa.int64()), ("places", pa.binary())])))], names=["bucket", "hashes", "counts", "bytes", "lengths", "n", "v", "asks"])

    return asked.groupBy("bucket").applyInArrow(thrifty(own), "bucket int, hashes binary, counts binary, bytes binary, lengths binary, n bigint, v bigint, asks array<struct<chunk bigint, places binary>>")


@dataclass
class Sample:
    spelling: Spelling
    tables: float  # of the word restaurant
    sweep: int  # of its seating; 0: one table for each word


def word_tables(hashes: np.ndarray, customers: np.ndarray, data: np.ndarray, size: np.ndarray, before: Sample | None, sweep: int, s: Settings) -> np.ndarray:
    """Tables of words in a sweep, given the last sample of the sweep before."""
    if before is None:
        return np.minimum(customers, 1)
    return seat(hashes, customers, math.log(s.word_strength + s.word_discount * before.tables) + before.spelling.words(data, size), s.word_discount, sweep, s)


def seated(words: DataFrame, before: Sample | None, sweep: int, s: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """One pass over the vocabulary: seats the words given the last sample; returns spelling keys, customers, and tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task adds up the keys of all its parts, so that rows depend on tasks and keys, not on parts
        all_keys, all_customers, tables = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for batch in batches:
            for h, c, b, n in zip(*(batch.column(i) for i in range(4)), strict=True):
                count, size, data = unpack(c.as_py(), np.int64), unpack(n.as_py(), np.uint32).astype(np.int64), unpack(b.as_py(), np.uint8)
                t = word_tables(np.frombuffer(h.as_py(), np.uint64), count, data, size, before, sweep, s)
                keys, word = trigrams(data, size)
                all_keys, place = np.unique(np.concatenate([all_keys, keys]), return_inverse=True)
                given = np.concatenate([all_customers, t[word].astype(np.int64)])
                all_customers = np.zeros(len(all_keys), np.int64)
                np.add.at(all_customers, place, given)
                tables += int(t.sum())
        some = all_customers > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.append(all_keys[some], -1)), pa.array(np.append(all_customers[some], tables))], names=["key", "customers"])

    rows = words.select("hashes", "customers", "bytes", "lengths").mapInArrow(run, "key bigint, customers bigint").groupBy("key").agg(F.sum("customers").alias("customers")).toArrow()
    keys, customers = rows["key"].to_numpy(), rows["customers"].to_numpy()
    real = keys >= 0
    return keys[real], customers[real], float(customers[~real].sum())


def answers(words: DataFrame, before: Sample | None, samples: list[Sample], n_customers: int, counts: bool, s: Settings) -> DataFrame:
    """For each chunk and part of the vocabulary, in order of its question: log10 probabilities without context, training counts (null unless ``counts``), and tables of the restaurants of which the words are the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            bucket, h, c, b, n, asks, customers, tables = (row.column(i)[0].as_py() for i in range(8))
            size, data = unpack(n, np.uint32).astype(np.int64), unpack(b, np.uint8)
            count, customers, tables = (unpack(y, np.int64) for y in (c, customers, tables))
            t = word_tables(np.frombuffer(h, np.uint64), customers, data, size, before, samples[0].sweep, s)
            d, a = s.word_discount, s.word_strength
            with np.errstate(divide="ignore"):
                own = np.log(np.maximum(customers - d * t, 0))
            p = np.logaddexp.reduce([np.logaddexp(own, math.log(a + d * y.tables) + y.spelling.words(data, size)) for y in samples], axis=0)
            value = (p - math.log(len(samples) * (n_customers + a))) / math.log(10)
            for ask in asks:
                at = unpack(ask["places"], np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([ask["chunk"]], pa.int64()), pa.array([bucket], pa.int32()), pa.array([pack(value[at])]), pa.array([pack(count[at]) if counts else None], pa.binary()), pa.array([pack(tables[at])])], names=["chunk", "bucket", "value", "count", "tables"])

    return words.select("bucket", "hashes", "counts", "bytes", "lengths", "asks", "customers", "tables").mapInArrow(run, "chunk bigint, bucket int, value binary, count binary, tables binary")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_mod: int = 7, held_out: int = 2, settings: Settings = Settings()) -> DataFrame:
    """Scores every whole text by a model of those whose crc32(id as text) mod 7 is not 2.

    Returns the id column, held_out, n_tokens (words and one end), n_known (tokens seen in training), train_tokens,
    base_score (add-one unigram, log10), score (log10 probability by the model), perplexity (10 ** (-score / n_tokens)).
    A null text is empty: its end alone. A null id counts as training. Other columns are not read, whatever their names;
    a text of any length lies whole in one chunk. Repeated rows count each. An empty table gives
    no rows. Counts cover all training texts. The driver holds spelling counts only, whose number is bounded by the
    contexts of two bytes. ``n_tokens`` and all counts are exact but for collisions of 64-bit word hashes.
    """
    with Scratch(docs.sparkSession) as scratch:
        rounds = [scratch.keep(r, "lm-scores") for r in _rounds(docs, id_col, text_col, held_out_mod, held_out, settings)]
    return reduce(DataFrame.union, rounds)


def _rounds(docs: DataFrame, id_col: str, text_col: str, held_out_mod: int, held_out: int, settings: Settings) -> Iterator[DataFrame]:
    """Scores of a part of the chunks each. A part must be written before the next is taken."""
    spark = docs.sparkSession
    key = docs.schema[id_col].dataType.simpleString()
    held = F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % held_out_mod == held_out, F.lit(False))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string"))), F.lit(0))).first()[0]
    buckets = min(PARTS, 1 + int(size) // PART_BYTES)
    whole = chunks(docs, id_col, text_col, held, buckets)
    path = shared_dir(spark, "lm-chunks")
    whole.write.option("compression", "zstd").parquet(path)
    whole = spark.read.schema(whole.schema).parquet(path)
    words = written(vocabulary(whole.select("chunk", F.explode("asks").alias("a")).select("chunk", "a.*")), "lm-words")
    # the spellings are with the words now
    cut = written(whole.select("chunk", "ids", "held", "n_tokens", "tokens", F.col("asks.hashes").alias("hashes"), F.col("asks.bucket").alias("buckets")), "lm-tokens")
    delete(spark, path)
    n_train, v_train = (int(x) for x in words.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v"))).first())
    counted = written(pair_counts(cut, buckets), "lm-pairs")
    if settings.pair_discount is None:
        once, twice = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("once", "twice"))).first()
        settings = replace(settings, pair_discount=discount(once, twice))
    seats = written(to_seat(cut, counted, buckets), "lm-seats")

    replies: list[DataFrame] = []
    last = None
    for sweep in range(settings.sweeps):
        state = written(received(words, sent(seats, replies[-1] if replies else None, sweep, settings)), "lm-customers")
        n_customers, once, twice = (int(x) for x in state.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "once", "twice"))).first())
        if settings.word_discount is None:
            settings = replace(settings, word_discount=discount(once, twice))
        release(spark)
        here = words.select("bucket", "hashes", "counts", "bytes", "lengths", "asks").join(state.select("bucket", "customers", "tables"), "bucket")
        keys, customers, tables = seated(here, last, sweep, settings)
        rest = Restaurants(keys, customers, settings)
        samples = []
        for _ in range(settings.burn_in):
            rest.sweep()
        for _ in range(settings.samples):
            rest.sweep()
            samples.append(Sample(rest.table(), tables, sweep))
        replies.append(written(answers(here, last, samples, n_customers, sweep + 1 == settings.sweeps, settings), "lm-replies"))
        del here
        discard(state)
        last = samples[-1]
    discard(seats)
    discard(words)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        get = lambda c, kind: unpack(left[c][0].as_py(), kind)
        held, n_tokens = get("held", bool), get("n_tokens", np.uint32)
        p = Pairs.of(*(left[c][0].as_py() for c in ("hashes", "tokens", "n_tokens", "held")), buckets)
        pair_count, _ = p.back(in_order(right, "found"))
        d, a = settings.pair_discount, settings.pair_strength
        count = np.concatenate([unpack(x, np.int64) for x in in_order(right, "count")])
        chance = []
        for sweep in range(settings.sweeps):
            mine = right.filter(pa.compute.equal(right["sweep"], sweep))
            value, tables = (np.concatenate([unpack(x, kind) for x in in_order(mine, c)]) for c, kind in (("value", np.float64), ("tables", np.int64)))
            if sweep or settings.sweeps == 1:  # the start is no sample
                t = np.minimum(pair_count, 1) if not sweep else pair_tables(p.hash, pair_count, before[0][p.second], before[1][p.first], sweep, settings)
                with np.errstate(divide="ignore"):
                    chance.append(np.logaddexp(np.log(np.maximum(pair_count - d * t, 0)), np.log(a + d * tables[p.first]) + value[p.second] * math.log(10)) - np.log(count[p.first] + a))
            before = value, tables
        chance = (np.logaddexp.reduce(chance, axis=0) - math.log(len(chance))) / math.log(10)
        doc = np.repeat(np.arange(len(n_tokens)), n_tokens)
        total = lambda w: np.bincount(doc, w, len(n_tokens))
        known = count[get("tokens", np.uint32)]
        base = np.log10((known + 1.0) / (n_train + 1.0 * (v_train + 1)))
        ids = left["ids"].combine_chunks().flatten()
        scored = total(chance[p.of_token])
        return pa.table([ids, pa.array(held), pa.array(n_tokens.astype(np.int64)), pa.array(total(known > 0).astype(np.int64)), pa.array(np.full(len(held), n_train, np.int64)), pa.array(total(base)), pa.array(scored), pa.array(np.exp(np.minimum(709.0, -scored / n_tokens * math.log(10))))], names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    out = f"`{id_col}` {key}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
    heard = counted.select("chunk", "bucket", "found")
    for sweep, r in enumerate(replies):
        heard = heard.unionByName(r.withColumn("sweep", F.lit(sweep)), allowMissingColumns=True)
    for k in range(ROUNDS):
        mine = F.pmod(F.xxhash64("chunk"), F.lit(ROUNDS)) == k
        yield cut.drop("buckets").where(mine).groupBy("chunk").cogroup(heard.where(mine).groupBy("chunk")).applyInArrow(thrifty(finish), out)
