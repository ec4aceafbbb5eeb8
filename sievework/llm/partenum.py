"""N-gram Jaccard join by PartEnum signatures (operator 2).

Sets of shingles of at least 80 % similarity differ in at most k elements, k = (a + b) / 9 for sizes a and b. Sizes are
dealt into bands, each a factor 1.4 wide; a pair meets in the band of its smaller set, so a set near the lower end of its
band also signs in the band below. A band cuts the domain of shingles into n1 partitions of first level, each of them
into n2 = 3 of second level. Of the first k // 2 + 1 + m partitions of first level, m + 1 have at most k2 = 1 difference each, so
two sets agree there on a subset of n2 - k2 = 2 partitions of second level: all three such subsets of each of these first
partitions are enumerated, and a signature is a subset with the elements that a set has in it. n1 is that number for the
largest k of the band. A subset without elements is no signature, as all sets without elements there would share it. A
set that has such subsets in at most m partitions has none in one of the m + 1 where it agrees, which is enough for the
pair. The spare partitions, m = a quarter of k // 2 + 1 (none below 4), make this the rule; a set with more signs its
k + 1 smallest elements as well, and of two similar sets that both do so some of these are shared.

Equal sets are one. Of the sets that share a signature, each is first compared with the one that looks nearest, at first in
a few of the buckets only: near copies share many signatures, so most of them meet there, and each pair would otherwise be
found in every bucket again. Then signatures whose sets are all in one component of the links found so far are left out,
and what is left of several buckets is brought together, so that a pair that shares many signatures is found in a few
parts only; all pairs between components that can still be similar are compared at last, but for those compared before. Parity sketches discard pairs: each differing element flips one bit, so more differing bits
than k are too many. Signatures are dealt into buckets whose number follows from the counted shingles, so that a task
holds a bucket of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import arrays
from sievework.llm.shared import Scratch, distinct_names, partitions, written
from sievework.llm.similar import components, popcount, verified

#: First sizes of the bands. A set of three elements or fewer is similar to equal sets only.
EDGES = [4]
while EDGES[-1] < 1 << 40:
    EDGES.append(max(EDGES[-1] + 1, -(-EDGES[-1] * 7 // 5)))
_EDGES = np.array(EDGES)
_LAST = _EDGES[1:] - 1  # largest size of each band


def _firsts(k: np.ndarray) -> np.ndarray:
    """Partitions of first level that sets sign for up to k differences: those that the differences need, and spare ones."""
    return k // 2 + 1 + _spare(k)


def _spare(k: np.ndarray) -> np.ndarray:
    need = k // 2 + 1
    return np.where(need >= 4, -(-need // 4), 0)


_N1 = _firsts((_LAST + _LAST * 5 // 4) // 9)
N2 = 3
_SEED = arrays.mix(np.arange(1, len(EDGES), dtype=np.uint64))
_TAG, _SMALL = np.uint64(0xD1342543DE82EF95), np.uint64(0x5851F42D4C957F2D)
_PAIR = np.uint64(0x2545F4914F6CDD1D)
#: Words of the parity sketch that goes with a set when pairs are looked for; a longer one is in the table of sets.
SHORT = 8
#: Ids up to which the documents of candidate pairs are picked by a broadcast, not by a shuffle of all texts.
SENT = 1_000_000
#: Signatures of a bucket, about; and signatures a shingle, about.
BUCKET, SHARE = 3_000_000, 0.75
#: Buckets, about, in which the first links are looked for; their number does not grow with the input.
FIRST = 8
#: Signatures with several sets that later passes compare in one part, about.
TOGETHER = 1_000_000
#: Bytes of text whose signatures are sent together.
CHUNK_BYTES = 16 << 20


class Sets:
    """The shingle sets of the texts of a block that have words: sorted distinct hashes, one set after the other."""

    def __init__(self, items: np.ndarray, owner: np.ndarray, texts: np.ndarray):
        self.items, self.owner, self.text = items, owner, texts
        self.size = np.bincount(owner, minlength=len(texts))
        self.start = np.cumsum(self.size) - self.size

    @staticmethod
    def of(block: arrays.Block, n: int) -> Sets:
        low = block.lowered()
        w = arrays.words(low)
        shingles, to = arrays.runs(arrays.span_hashes(low.data, w.start, w.end), w.bounds, n)
        text = np.repeat(np.arange(len(block)), np.diff(to))
        # sorted by the whole hash: a set's smallest elements must be the same wherever it is
        order = arrays.by_group(text, shingles, len(block))
        shingles, text = shingles[order], text[order]
        back = (text[1:] == text[:-1]) & (shingles[1:] < shingles[:-1])
        if back.any():
            order = np.lexsort((shingles, text))
            shingles, text = shingles[order], text[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (shingles[1:] != shingles[:-1])
        shingles, text = shingles[new], text[new]
        have = np.flatnonzero(np.diff(to))
        return Sets(shingles, np.searchsorted(have, text), have)

    def hashes(self) -> np.ndarray:
        """A number for each set; two sets share one with a probability of about 2**-63."""
        if not len(self.size):
            return np.zeros(0, np.int64)
        return (arrays.mix(np.add.reduceat(arrays.mix(self.items), self.start) + self.size.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)

    def sketches(self, words: np.ndarray) -> np.ndarray:
        """The parity of the elements of each set that fall on each of its 64 * words bits (a power of two), as one array of words."""
        bits = (arrays.mix(self.items) & (64 * words[self.owner] - 1).astype(np.uint64)).astype(np.int64)
        base = 64 * (np.cumsum(words) - words)
        count = np.bincount(bits + base[self.owner], minlength=int(64 * words.sum())) & 1
        return np.packbits(count.astype(np.uint8)).view(np.int64)

    def pick(self, some: np.ndarray) -> Sets:
        """The sets at the given places, ascending."""
        to = np.full(len(self.size), -1)
        to[some] = np.arange(len(some))
        use = to[self.owner] >= 0
        return Sets(self.items[use], to[self.owner[use]], self.text[some])

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        """All signatures, and the set that each belongs to."""
        band = np.searchsorted(_EDGES, self.size, "right") - 1
        own = np.flatnonzero(band >= 0)
        least = -(-self.size * 4 // 5)
        below = np.flatnonzero((band > 0) & (least <= _LAST[np.maximum(band, 1) - 1]))
        out = []
        for some, at, largest in ((own, band[own], self.size[own] * 5 // 4), (below, band[below] - 1, _LAST[band[below] - 1])):
            x = self.pick(some)
            sig, of = x._signed(at, (x.size + largest) // 9)
            out.append((sig, some[of]))
        return np.concatenate([s for s, _ in out]), np.concatenate([o for _, o in out])

    def _signed(self, band: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of every set in a band each, for up to k differences."""
        first = _firsts(k)
        base = np.cumsum(first) - first
        x = arrays.mix(self.items + _SEED[band][self.owner])
        part = ((x >> np.uint64(32)) * _N1[band][self.owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        use = part < first[self.owner]
        x, at = x[use], (base[self.owner[use]] + part[use]) * N2 + ((x[use] & np.uint64(0xFFFFFFFF)) % np.uint64(N2)).astype(np.int64)
        total = int(first.sum())
        sums, count = np.zeros(total * N2, np.uint64), np.bincount(at, minlength=total * N2)
        np.add.at(sums, at, x)
        sums, count = sums.reshape(-1, N2), count.reshape(-1, N2)
        owner = np.repeat(np.arange(len(k)), first)
        tag = arrays.mix(_SEED[band][owner] + (np.arange(total) - base[owner]).astype(np.uint64) * _TAG)
        sig, of = [], []
        for i, j in ((0, 1), (0, 2), (1, 2)):
            some = count[:, i] + count[:, j] > 0
            sig.append(arrays.mix(arrays.mix(sums[some, i] + tag[some] + np.uint64(i)) * _PAIR + sums[some, j] + np.uint64(j)))
            of.append(owner[some])
        empty = np.bincount(owner[(count > 0).sum(1) < N2 - 1], minlength=len(k)) > _spare(k)
        number = np.arange(len(self.owner)) - self.start[self.owner]
        use = empty[self.owner] & (number <= k[self.owner])
        sig.append(arrays.mix(self.items[use] * _SMALL + _SEED[band][self.owner[use]]))
        of.append(self.owner[use])
        return np.concatenate(sig), np.concatenate(of)


def all_signatures(items: np.ndarray) -> np.ndarray:
    """The signatures of one set of sorted element hashes."""
    return Sets(items, np.zeros(len(items), np.int64), np.zeros(1, np.int64)).signatures()[0]


def long_words(size: np.ndarray) -> np.ndarray:
    """Words of a set's long sketch: about a bit for each element."""
    return np.left_shift(1, np.maximum(0, np.frexp(size // 64)[1])).astype(np.int64)


def _documents(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, n_shingles, set, long, short) of each document; the last three are null without words."""
    key = docs.schema[id_col].dataType.simpleString()

    def lists(words: np.ndarray, each: np.ndarray, text: np.ndarray, n_texts: int) -> pa.Array:
        size = np.zeros(n_texts, np.int64)
        size[text] = each
        offsets = pa.array(np.append(0, np.cumsum(size)).astype(np.int32), mask=np.append(size == 0, False))
        return pa.ListArray.from_arrays(offsets, pa.array(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in arrays.blocks(batch.column(1)):
                x, m = Sets.of(block, n), len(block)
                size, key_of, none = np.zeros(m, np.int64), np.zeros(m, np.int64), np.ones(m, bool)
                size[x.text], key_of[x.text], none[x.text] = x.size, x.hashes(), False
                long, short = long_words(x.size), np.full(len(x.size), SHORT)
                columns = [pa.array(size), pa.array(key_of, mask=none), lists(x.sketches(long), long, x.text, m), lists(x.sketches(short), short, x.text, m)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, m), *columns], names=["id", "n_shingles", "set", "long", "short"])
            arrays.trim()

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, f"id {key}, n_shingles bigint, set bigint, `long` array<bigint>, `short` array<bigint>")


def _signed(docs: DataFrame, text_col: str, n: int, buckets: int) -> DataFrame:
    """(bucket, signatures, owners, sets): packed signatures of some MB of text, by the part that compares them."""
    names = ["bucket", "signatures", "owners", "sets"]

    def send(kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sig, ids = np.concatenate([k[0] for k in kept]), np.concatenate([k[2] for k in kept])
        owner = np.concatenate([k[1] + at for k, at in zip(kept, np.cumsum([0] + [len(k[2]) for k in kept[:-1]]), strict=True)])
        first = np.zeros(len(ids), bool)  # a set signs once
        first[np.unique(ids, return_index=True)[1]] = True
        sig, owner = sig[first[owner]], owner[first[owner]]
        bucket = ((sig >> np.uint64(33)) % np.uint64(buckets)).astype(np.uint32)
        order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(edge))
        cols: list[list[bytes]] = [[], [], []]
        for b in some.tolist():
            mine = order[edge[b] : edge[b + 1]]
            used, local = np.unique(owner[mine], return_inverse=True)
            # half of a hash is enough within a bucket: unequal signatures only make more candidates
            for c, x in zip(cols, (sig[mine].astype(np.uint32), local.astype(np.uint16 if len(used) < 65536 else np.uint32), ids[used]), strict=True):
                c.append(x.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            for block in arrays.blocks(batch.column(0)):
                x = Sets.of(block, n)
                kept.append((*x.signatures(), x.hashes()))
                held += len(block.data)
                if held >= CHUNK_BYTES:
                    yield send(kept)
                    kept, held = [], 0
                    arrays.trim()
        if kept:
            yield send(kept)

    return docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "bucket int, signatures binary, owners binary, sets binary")


def _again(key: np.ndarray) -> np.ndarray:
    """Which entries of a sorted array have an equal neighbour."""
    same = key[1:] == key[:-1]
    return np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(key) else np.zeros(0, bool)


def _collisions(packed: DataFrame) -> DataFrame:
    """For each bucket the signatures that more than one set has, with those sets (ascending)."""

    def meet(table: pa.Table) -> pa.Table:
        sig, sets = [], []
        for s, o, f in zip(table["signatures"], table["owners"], table["sets"], strict=True):
            sig.append(np.frombuffer(s.as_py(), np.uint32))
            raw = o.as_py()
            sets.append(np.frombuffer(f.as_py(), np.int64)[np.frombuffer(raw, np.uint16 if len(raw) == 2 * len(sig[-1]) else np.uint32)])
        sig, sets = np.concatenate(sig), np.concatenate(sets)
        order = np.argsort(sig)
        sig, sets = sig[order], sets[order]
        some = _again(sig)
        sig, sets = sig[some], sets[some]
        order = np.lexsort((sets, sig))
        sig, sets = sig[order], sets[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (sets[1:] != sets[:-1])
        sig, sets = sig[new], sets[new]
        some = _again(sig)
        sig, sets = sig[some], sets[some]
        used, local = np.unique(sets, return_inverse=True)
        return pa.table([pa.array([table["bucket"][0].as_py()], pa.int32()), pa.array([sig.tobytes()]), pa.array([local.astype(np.uint32).tobytes()]), pa.array([used.tobytes()])], names=["bucket", "signatures", "owners", "sets"])

    return packed.groupBy("bucket").applyInArrow(meet, "bucket int, signatures binary, owners binary, sets binary")


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, owners, sets, and where each signature begins."""
    sig, owner, sets = np.frombuffer(row["signatures"], np.uint32), np.frombuffer(row["owners"], np.uint32).astype(np.int64), np.frombuffer(row["sets"], np.int64)
    return sig, owner, sets, np.flatnonzero(np.diff(sig, prepend=sig[0] ^ np.uint32(1)) != 0) if len(sig) else np.zeros(0, np.int64)


#: Members of a signature among which the nearest is looked for, before the pass over all.
NEAR = 4096
#: Pairs of sketches that are compared at once.
AT_ONCE = 1 << 16


def _members(met: DataFrame) -> DataFrame:
    """(bucket, set): the sets of each bucket; one of several rows may come more than once."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: dict[int, list[np.ndarray]] = {}
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kept.setdefault(b, []).append(np.frombuffer(raw, np.int64))
            for b, parts in kept.items():
                ids = np.unique(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), b, np.int32)), pa.array(ids)], names=["bucket", "set"])

    return met.select("bucket", "sets").mapInArrow(sets_of, "bucket int, set bigint")


def _parts(met: DataFrame, buckets: int) -> int:
    """Into how many parts the buckets of the collisions are brought together after the first links."""
    return min(buckets, max(FIRST, -(-met.agg(F.coalesce(F.sum(F.octet_length("signatures")), F.lit(0))).first()[0] // (4 * TOGETHER))))


def _unsettled(met: DataFrame, labels: DataFrame, parts: int) -> DataFrame:
    """The collisions without the signatures whose sets are all in one component, their buckets brought together in so many parts. Sent are the labels of sets, not their sketches."""
    met = met.withColumn("bucket", (F.col("bucket") % parts).cast("int"))
    known = _members(met).join(labels.select(F.col("vertex").alias("set"), "label"), "set")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        known_sets, first = np.unique(right["set"].to_numpy(), return_index=True)
        known_labels = right["label"].to_numpy()[first]
        for row in left.to_pylist():
            sig, owner, sets, head = _read(row)
            if not len(sig):
                continue
            label = sets.copy()
            own = arrays.among(sets, known_sets)
            label[own] = known_labels[np.searchsorted(known_sets, sets[own])]
            low, high = np.minimum.reduceat(label[owner], head), np.maximum.reduceat(label[owner], head)
            some = np.repeat(low != high, np.diff(np.append(head, len(sig))))
            if some.any():
                used, local = np.unique(owner[some], return_inverse=True)
                out.append((row["bucket"], sig[some].tobytes(), local.astype(np.uint32).tobytes(), sets[used].tobytes()))
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.table([pa.array(list(c), kind) for c, kind in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "signatures", "owners", "sets"])

    return met.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(run, "bucket int, signatures binary, owners binary, sets binary")


def _pairs(met: DataFrame, labels: DataFrame | None, facts: DataFrame, nearest: bool) -> DataFrame:
    """Pairs of sets (x < y) that share a signature, can be similar by size and short sketch, and are not in one component; once for each bucket.

    All of them, or with ``nearest`` for each set of a signature the one whose sketch differs least.
    """
    about = facts.select("set", "n", "short")
    about = about.join(labels.select(F.col("vertex").alias("set"), "label"), "set", "left") if labels is not None else about.withColumn("label", F.lit(None).cast("bigint"))
    known = _members(met).join(about, "set")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sets, first = np.unique(right["set"].to_numpy(), return_index=True)
        size, label = right["n"].to_numpy()[first], sets.copy()
        bits = right["short"].combine_chunks().flatten().to_numpy().astype(np.int64).view(np.uint64).reshape(-1, SHORT)[first]
        given = right["label"].to_pandas().iloc[first]
        own = given.notna().to_numpy()
        label[own] = given[own].astype("int64").to_numpy()
        found = [np.zeros(0, np.int64)]

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            found.append(np.unique(np.minimum(i, j) * len(sets) + np.maximum(i, j)))

        def differ(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Differing bits, or -1 if the two need no comparison."""
            a, b = size[i], size[j]
            d = popcount(bits[i] ^ bits[j]).sum(-1)
            return np.where((label[i] != label[j]) & (np.minimum(a, b) * 5 >= np.maximum(a, b) * 4) & (d * 9 <= a + b), d, -1)

        for row in left.to_pylist():
            sig, owner, here, head = _read(row)
            if not len(sig):
                continue
            owner = np.searchsorted(sets, here)[owner]
            out_i, out_j = [], []
            edge = np.append(head, len(sig))
            two = head[np.diff(edge) == 2]
            i, j = owner[two], owner[two + 1]
            use = differ(i, j) >= 0
            out_i.append(i[use])
            out_j.append(j[use])
            low, high = np.minimum.reduceat(label[owner], head), np.maximum.reduceat(label[owner], head)
            for k in np.flatnonzero((low != high) & (np.diff(edge) > 2)).tolist():
                members = owner[edge[k] : edge[k + 1]]
                if nearest:
                    few, other = members, members[:: -(-len(members) // NEAR)]
                else:
                    ls = label[members]
                    values, counts = np.unique(ls, return_counts=True)
                    common = ls == values[counts.argmax()]
                    few = members[~common]
                    other = np.concatenate([members[common], few])
                step = max(1, AT_ONCE // len(other))
                for part in (few[p : p + step] for p in range(0, len(few), step)):
                    d = differ(part[:, None], other[None])
                    if nearest:
                        best = np.where(d < 0, 1 << 40, d).argmin(1)
                        some = d[np.arange(len(part)), best] >= 0
                        out_i.append(part[some])
                        out_j.append(other[best[some]])
                    else:
                        i, j = np.nonzero(d >= 0)
                        out_i.append(part[i])
                        out_j.append(other[j])
            keep(np.concatenate(out_i), np.concatenate(out_j))
        both = np.unique(np.concatenate(found))
        return pa.table([pa.array(sets[both // max(1, len(sets))]), pa.array(sets[both % max(1, len(sets))])], names=["x", "y"])

    return met.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(run, "x bigint, y bigint")


def _possible(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """The pairs whose sizes and long sketches allow the similarity. The longer of two sketches folds to the shorter."""
    x, y = (facts.select(F.col("set").alias(c), F.col("n").alias(f"{c}_n"), F.col("long").alias(f"{c}_bits")) for c in "xy")
    both = pairs.join(y, "y").join(x, "x").where("least(x_n, y_n) * 5 >= greatest(x_n, y_n) * 4")
    fold = "case when size({a}) > size({b}) then zip_with(slice({a}, 1, size({b})), slice({a}, size({b}) + 1, size({b})), (p, q) -> p ^ q) else {a} end"
    differ = f"aggregate(zip_with({fold.format(a='x_bits', b='y_bits')}, {fold.format(a='y_bits', b='x_bits')}, (p, q) -> bit_count(p ^ q)), 0, (s, c) -> s + c)"
    return both.where(f"{differ} * 9 <= x_n + y_n").select("x", "y")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """The shingle sets (set, items) of the documents named in ``wanted`` (id, set), taken again from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in arrays.blocks(batch.column(0)):
                x = Sets.of(block, n)
                items = pa.ListArray.from_arrays(pa.array(np.append(x.start, len(x.items)).astype(np.int32)), pa.array(x.items.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(x.hashes()), items], names=["set", "items"])
            arrays.trim()

    wanted = written(wanted, "wanted")
    ids = wanted.select("id").distinct()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(ids) if wanted.count() <= SENT else ids, "id", "left_semi")
    return written(rows.select("text").mapInArrow(run, "set bigint, items array<bigint>").join(wanted.select("set").distinct(), "set", "left_semi").dropDuplicates(["set"]), "sets")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5) -> DataFrame:
    """Links documents whose sets of n-word shingles have a Jaccard similarity of 0.8 or more; exact, with no cap.

    Returns one row for each row of ``docs``: the id column, n_shingles and component_id, the smallest id that links
    lead to, itself included. A document without words, or null, links with nothing; with fewer than n words its whole
    sequence is its one shingle. A null id takes part but names no component unless all ids of it are null. Repeated
    rows are documents with equal sets. An empty table gives no rows. Shingles and sets are compared by 64-bit hashes.
    """
    distinct_names(id_col, "n_shingles", "component_id")
    with Scratch(docs.sparkSession) as scratch:
        return scratch.keep(_near_duplicates(docs, id_col, text_col, n), "near-duplicates")


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    spark = docs.sparkSession
    rows = written(_documents(docs, id_col, text_col, n), "shingles")
    total = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = max(partitions(spark), -(-int(total * SHARE) // BUCKET))
    met = written(_collisions(_signed(docs, text_col, n, buckets)), "collisions")
    reps = written(rows.where("set is not null").groupBy("set").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("long").alias("long"), F.first("short").alias("short")), "sets-first")

    def possible(pairs: DataFrame) -> DataFrame:
        return written(_possible(pairs.distinct(), reps), "pairs")

    def check(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("x").alias("set")).union(pairs.select(F.col("y").alias("set"))).distinct()
        return written(verified(pairs, _sets(docs, reps.join(ids, "set", "left_semi").select("id", "set"), id_col, text_col, n)), "links")

    tried = possible(_pairs(met.where(F.col("bucket") % max(1, buckets // FIRST) == 0), None, reps, True))
    links = check(tried)
    labels, new, parts = components(links), True, _parts(met, buckets)
    for nearest in (True, False):
        if new:
            met = written(_unsettled(met, labels, parts), "collisions")
        more = possible(_pairs(met, labels, reps, nearest).distinct().join(tried, ["x", "y"], "left_anti"))
        found = None if more.isEmpty() else check(more)
        new = found is not None and not found.isEmpty()
        if new:
            links = written(links.union(found), "links")
            labels = components(links)
        tried = tried.union(more)
    owner = reps.join(labels.withColumnRenamed("vertex", "set"), "set", "left").select("set", "id", F.coalesce("label", "set").alias("label"))
    named = owner.groupBy("label").agg(F.min("id").alias("component_id"))
    by_set = owner.where("label <> set or id is null").select("set", "label").union(labels.where("vertex = label").select(F.col("vertex").alias("set"), "label")).distinct().join(named, "label").select("set", "component_id")
    by_set = reps.join(by_set, "set", "left").select("set", F.coalesce("component_id", "id").alias("component_id"))
    return rows.select("id", "n_shingles", "set").join(by_set, "set", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def oracle() -> str:
    """All pairs of documents that share a shingle, counted, and their closure."""
    return r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] end as g
      from (select doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) as i from d where len(w) > 0)),
c as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as m from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select x, y from p join c cx on cx.doc_id = x join c cy on cy.doc_id = y where 100 * m >= 80 * (cx.n + cy.n - m)),
r as (select doc_id, doc_id as reached from d union select r.doc_id, e.y from r join e on e.x = r.reached)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id
from d left join c using (doc_id) join (select doc_id, min(reached) as component_id from r group by doc_id) using (doc_id)"""
