"""Line dedup where a token has very many lines, against brute force."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest


def removed_lines(data):
    """Brute force: line numbers that go, by id."""
    seen, want = [], {}
    for i, t in sorted(data):
        for k, x in enumerate(t.split("\n")):
            if s := frozenset(x.split()):
                if any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                    want.setdefault(i, []).append(k)
                seen.append(s)
    return want


def bits_of(words):
    """The bit of the short sketch that each word flips."""
    from sievework.llm import arrays

    block = next(arrays.blocks(pa.array([" ".join(words)])))
    w = arrays.words(block)
    return (arrays.mix(arrays.span_hashes(block.data, w.start, w.end)) & np.uint64(63)).astype(int).tolist()


def test_candidate_of_a_line_that_settled_elsewhere(spark):
    """A line looks near one of the earliest lines of its token, which is not similar; the line that is similar is found all the same."""
    from sievework.llm.line_dedup import MANY, summarize

    pool = [f"p{k}" for k in range(400)]
    by_bit = defaultdict(list)
    for w, b in zip(pool, bits_of(pool), strict=True):
        by_bit[b].append(w)
    twins = [v[:2] for v in by_bit.values() if len(v) >= 2]
    a, c = [t[0] for t in twins[:17]], [t[1] for t in twins[:17]]
    others = [v[2] for v in by_bit.values() if len(v) >= 3]
    b1, b2 = (next(w for w in others if bits_of([w])[0] not in bits_of(a[13:]) + extra) for extra in ([], bits_of(others[:1])))
    x, y, leader = ["hot", *a], ["hot", *a[:15], b1, b2], ["hot", *a[:13], *c[13:17]]
    r = random.Random(3)
    data = [(0, " ".join(pool * 4))] + [(1, " ".join(leader))]
    data += [(2 + i, " ".join(["hot", *r.sample(pool, 17)])) for i in range(MANY + 76)]
    data += [(2000, " ".join(y)), (2001, " ".join(x))]
    data += [(3000 + i, " ".join(r.sample(pool, 400))) for i in range(1200)]  # words of the pool are more frequent than the shared token
    want = removed_lines(data[: MANY + 80])
    assert 2001 in want and 2000 not in want
    got = {q.doc_id: list(q.removed) for q in summarize(spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)).where("n_removed > 0 and doc_id < 3000").collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_fuzz_of_long_lines(spark, monkeypatch, seed):
    """Long lines of few words, so that sketches collide, with small bounds drawn at random."""
    from sievework.llm import line_dedup

    r = random.Random(seed)
    for name, values in (("MANY", (6, 20, 60)), ("LEADERS", (1, 2, 8)), ("HOT", (10, 50, 20_000)), ("PAIRS_AT_ONCE", (32, 1 << 20)), ("BUCKET", (100, 400_000))):
        monkeypatch.setattr(line_dedup, name, r.choice(values))
    pool = [f"w{k}" for k in range(90)]
    data = []
    for i in range(160):
        n = r.randint(15, 60)
        base = data[r.randrange(len(data))][1].split() if data and r.random() < 0.7 else r.sample(pool, n)
        words = [w if r.random() > 0.08 else r.choice(pool) for w in base] + (["rare"] if r.random() < 0.6 else [])
        data.append((i, " ".join(words)))
    got = {q.doc_id: list(q.removed) for q in line_dedup.summarize(spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)).where("n_removed > 0").collect()}
    assert got == removed_lines(data)


def test_first_sketch_has_128_bits():
    """Two lines that differ in four tokens, two of which fall on each bit of 64: the sketch of 64 bits sees no difference, that of 128 sees four."""
    from sievework.llm import arrays
    from sievework.llm.line_dedup import Bucket, Dealer, Lines

    def lines(*texts):
        raw = [t.encode() for t in texts]
        return Lines(arrays.Block(0, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(t) for t in raw]), np.zeros(len(raw), bool)), np.arange(1 << 18, dtype=np.uint64))

    words = [f"w{i}" for i in range(4000)]
    single = lines(*words)
    by: dict[tuple[int, int], list[str]] = {}
    for w, sketch, half in zip(words, single.sketch.tolist(), single.half.tolist(), strict=True):
        by.setdefault((sketch, half), []).append(w)
    bits = sorted({s for s, _ in by})[:2]
    differ = [[by[s, h][0] for s in bits for h in (0, s)], []]  # each bit twice: once in the half, once not
    common = [w for w in words if w not in differ[0]][:10]
    a, b = " ".join(common + differ[0]), " ".join(common)
    x = lines(a, b)
    assert x.sketch[0] == x.sketch[1] and np.bitwise_count(x.half[0] ^ x.half[1]) == 2
    to = Dealer(np.arange(1 << 18, dtype=np.uint64), np.ones(1 << 18, np.int64), 1)
    bucket = Bucket(to.send([to.entries(x, np.array([1, 2]))])[1].to_pylist())
    i, j = (k.ravel() for k in np.meshgrid(np.arange(len(bucket.key)), np.arange(len(bucket.key))))
    assert not len(bucket.able(i, j)[0])


def test_last_join_sends_entries_that_can_meet_an_open_line(spark):
    """Of 200 lines one is open: of the others only entries with a token of its prefix go, and its candidates stay."""
    from sievework.llm import line_dedup as ld
    from sievework.llm.line_dedup import _unpack

    same = " ".join(f"s{k}" for k in range(10))
    texts = spark.createDataFrame([(i, same + f" x{i}" if i < 5 else " ".join(f"{i}a{k}" for k in range(10))) for i in range(200)], "id bigint, text string")
    counts = ld._frequencies(texts)
    blocks = [r.asDict() for r in texts.collect()]
    rows = []
    for r in blocks:
        raw = r["text"].encode()
        x = ld.Lines(ld.arrays.Block(0, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), np.zeros(1, bool)))
        rows.append((r["id"], 0, int(x.mark[0]), r["id"] == 0))
    lines = spark.createDataFrame(rows, "id bigint, line bigint, mark bigint, open boolean")
    seen = ld._seen(texts, counts, lines.where("open"))
    sent = lambda df: [i for r in df.collect() for i in _unpack(r["entries"])["id"].tolist()]
    whole, part = ld._wide_entries(texts, counts, lines), ld._wide_entries(texts, counts, lines, seen)
    assert len(set(sent(whole))) == 200 and set(sent(part)) <= {0, 1, 2, 3, 4} and 0 in sent(part)
    found = lambda df: {tuple(r) for r in ld._compared(df, True).select("x_id", "y_id").distinct().collect()}
    assert found(part) == found(whole)
