"""The prefix trie of conversations against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest()), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    paths = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        paths[c] = own.get(base, [])[:h] + x[h:]
    members = defaultdict(list)
    for c, x in paths.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    out = {}
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaf = lambda q: not any(len(o) == len(q) + 1 and o[:-1] == q for o in members)
        ends = sorted(c for c in m if len(paths[c]) == len(p))
        out[min(m), len(p)] = (
            min(members[p[:-1]]) if p else None, len(m), sum(len(o) == len(p) + 1 for o in below), sum(map(leaf, below)),
            sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def found(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


def conversations(seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(-3, 12), *range(100, 130), 205, 207, 1003, 10**12 + 1]:
        for t in range(r.choice((1, 2, 3, 5, 9, 17))):
            rows.append((c, t if r.random() < 0.9 else r.choice((None, 0, 1)), r.choice(("user", "user", None)), r.choice(("a", "b", "é🙂", "", None))))
    rows += [(7, 0, "user", "a")] * 3 + [(None, 0, "user", "lost")]
    return rows


@pytest.mark.parametrize("seed", [1])
def test_trie(spark, seed):
    from sievework.llm.trie import conversation_trie

    rows = conversations(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("conv", F.lit("x")).withColumn("d", F.lit(1)).withColumn("name", F.lit(None).cast("int"))
    assert found(conversation_trie(df.repartition(5))) == brute(rows)


def test_one_long_conversation_and_many_copies(spark):
    """A conversation that is most of the table, of a length that is no power of two, and one that very many equal."""
    from sievework.llm.trie import conversation_trie

    rows = [(100, t, "user", f"t{t % 7}") for t in range(45)] + [(c, t, "user", f"x{t}") for c in range(10_000, 10_300) for t in range(2)]
    got = found(conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    want = brute(rows)
    assert got == want


def test_empty_table_and_renamed_columns(spark):
    from sievework.llm.trie import conversation_trie

    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
    df = spark.createDataFrame([(5, 0, "user", "x")], "`a.b` int, number int, place string, node string")
    got = found(conversation_trie(df, "a.b", "number", "place", "node"))
    h = zlib.crc32(b"5") % 6
    assert got == brute([(5, 0, "user", "x")]) and len(got) == 1 + (h == 0)


def test_general_trie_of_given_sequences(spark):
    """Without the rebuilding: any numbered symbols."""
    from sievework.llm.trie import trie

    seq = {1: "abcab", 2: "abc", 3: "abd", 4: "", 5: "abc"}
    t = spark.createDataFrame([(c, i + 1, x, 2) for c, s in seq.items() for i, x in enumerate(s)], "conv bigint, d bigint, symbol string, chars bigint")
    lengths = spark.createDataFrame([(c, len(s)) for c, s in seq.items()], "conv bigint, length bigint")
    got = {k: v[:5] for k, v in found(trie(t, lengths)).items()}
    assert got == {(1, 0): (None, 5, 1, 2, 16), (1, 1): (1, 4, 1, 2, 16), (1, 2): (1, 4, 2, 2, 10), (1, 3): (1, 3, 1, 1, 4), (1, 4): (1, 1, 1, 1, 0), (1, 5): (1, 1, 0, 1, 0), (3, 3): (1, 1, 0, 1, 0)}
