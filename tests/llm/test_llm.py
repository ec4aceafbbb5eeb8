"""The operators for training data against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import base64
import gzip
import hashlib
import math
import os
import random
import re
import tarfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def texts():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdeàß") for _ in range(r.randint(1, 6))) for _ in range(60)]
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)).capitalize() + "."
    out = [None, "", " \t\n\x0b ", "One.", "a b c d", "a  b\tc\nd", "A b c d e", "a b c d e", "Don't <|endoftext|> 'tis  x\n\n y ", "½² 🙂 é İΣ ſ　 z \x1c"]
    out += ["\n".join(line(r.randint(1, 30)) for _ in range(r.randint(1, 6))) for _ in range(40)]
    base = [line(40) for _ in range(5)]
    for b in base:
        w = b.split(" ")
        for k in range(6):
            v = list(w)
            for _ in range(k // 2):
                v[r.randrange(len(v))] = r.choice(vocabulary)
            out.append(" ".join(v))
    out += [base[0]] * 5 + [" ".join([line(60)] * 40), "\n".join([line(400), base[1], base[1]])]
    return out


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    data = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts())]
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    spark.createDataFrame(data, DOC).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def plain():
    return dict(enumerate(texts()))


def words(t, lower=False):
    return WORD.findall((t or "").translate(LOWER) if lower else (t or ""))


def clashing(df):
    """Extra columns with names that operators use inside."""
    return df.withColumn("id", F.lit("x")).withColumn("set", F.lit(1)).withColumn("_text", F.lit(None).cast("int")).withColumn("score", F.lit("s")).withColumn("bucket", F.lit(2))


# 1


def test_quality_rules(spark, docs, plain):
    from sievework.llm.quality_rules import apply_rules

    for r in apply_rules(clashing(docs)).collect():
        t, w = plain[r.doc_id] or "", words(plain[r.doc_id])
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.kept and r.base_failed)
    assert apply_rules(docs.limit(0)).count() == 0
    bad = spark.createDataFrame([(1, "Home | About | Help | Login | Shop | Cart | News"), (2, "This is a good line of words that ends as a sentence should."), (3, "BUY NOW ALL CAPS IS NEVER GOOD STYLE HERE!!")], "doc_id bigint, text string")
    assert {r.doc_id: r.kept for r in apply_rules(bad).collect()} == {1: False, 2: True, 3: False}
    assert {r.doc_id: r.n_failed_lines for r in apply_rules(bad).collect()} == {1: 1, 2: 0, 3: 1}


# 2


def brute_components(plain):
    sets = {}
    for i, t in plain.items():
        w = words(t, True)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_ngram_join(spark, docs, plain):
    from sievework.llm.partenum import near_duplicates

    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(clashing(docs)).collect()}
    assert got == brute_components(plain)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_pairs_do_not_grow_with_the_buckets(spark, monkeypatch):
    """Near copies share signatures in nearly all buckets; the rows of the joins of pairs follow the copies, not the buckets."""
    from sievework.llm import partenum

    r, data = random.Random(8), []
    for n in range(30):
        w = [f"w{r.randrange(10**6)}" for _ in range(300)]
        data += [(2 * n, " ".join(w)), (2 * n + 1, " ".join([*w[:150], "other", *w[151:]]))]
    docs = spark.createDataFrame([*data, (60, "too few"), (61, "too few"), (62, "some other words here at last")], "doc_id bigint, text string")
    made, pairs = [], partenum._pairs

    def counted(*given):
        out = pairs(*given)
        made.append(out.count())
        return out

    monkeypatch.setattr(partenum, "_pairs", counted)
    monkeypatch.setattr(partenum, "partitions", lambda spark: 64)
    got = {r.doc_id: r.component_id for r in partenum.near_duplicates(docs).collect()}
    assert got == {i: 60 if i == 61 else i if i > 60 else i - i % 2 for i in range(63)}
    assert 30 <= sum(made) <= 30 * 10


def test_partenum_signatures_meet():
    """Random pairs of sets at every allowed distance share a signature."""
    from sievework.llm.partenum import all_signatures

    r = np.random.default_rng(1)
    for n in range(1500):
        a = int(r.integers(1, 60 if n % 2 else 900))
        items = np.unique(r.integers(0, 2**63, a, dtype=np.uint64))
        a = len(items)
        b = int(r.integers(a, a * 5 // 4 + 1))
        k = (a + b) // 9
        gone = (k - (b - a)) // 2
        if gone < 0:
            continue
        other = np.sort(np.concatenate([r.permutation(items)[: a - gone], r.integers(0, 2**63, b - a + gone, dtype=np.uint64)]))
        assert 100 * len(np.intersect1d(items, other)) >= 80 * len(np.union1d(items, other))
        assert np.array_equal(items, other) or len(np.intersect1d(all_signatures(items), all_signatures(other)))


# 3


def test_classifier(spark):
    from sievework.llm.mil import classify, train

    r = random.Random(2)
    good = lambda: "\n".join(" ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(r.randint(8, 30))).capitalize() + "." for _ in range(4))
    junk = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(4)).upper() + "!!" for _ in range(60)) if r.random() < 0.5 else "*** ".join("ab" for _ in range(80))
    data = [(i, good() if i % 3 else junk()) for i in range(400)]
    d = spark.createDataFrame([*data, (400, None), (401, ""), (401, "")], "doc_id bigint, text string")
    lab = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(5, None), (None, 1)], "doc_id bigint, quality int")
    out = classify(clashing(d).drop("score"), train(d, lab)).collect()
    assert len(out) == 403 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in out)
    held = [x for x in out if x.held_out and x.doc_id < 400]
    assert all(zlib.crc32(str(x.doc_id).encode()) % 4 == 2 for x in held) and held
    assert sum(x.predicted == int(x.doc_id % 3 > 0) for x in held) / len(held) > 0.95
    none = classify(d, train(d, lab.limit(0))).collect()
    assert {x.score for x in none} == {0.5} and classify(d.limit(0), train(d, lab)).count() == 0


# 4


def test_media(spark, docs, plain):
    from sievework.llm.media import from_png, payload_of, store, with_features, with_metadata

    index = store(clashing(docs).drop("score"))
    rows = with_features(with_metadata(index)).collect()
    assert len(rows) == len(plain)
    by_text = {}
    for r in rows:
        b = (plain[r.doc_id] or "").encode()
        p = payload_of(b)
        assert len(p) % 64 == 0 and len(p) >= 64 and p[: len(b)] == b and not p[len(b) :].strip(b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.width * r.height == len(p) and r.bit_depth == 8
        with open(r.shard.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            png = f.read(r.length)
        assert from_png(png) == p and (len(png), hashlib.sha256(png).hexdigest()) == (r.media_bytes, r.media_sha256)
        assert by_text.setdefault(b, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    with tarfile.open(rows[0].shard.removeprefix("file://")) as t:
        assert all(len(m.name) == 68 for m in t.getmembers())
    assert store(docs.limit(0)).count() == 0


# 5


def test_language_model(spark, docs, plain):
    from sievework.llm.pitman_yor import score

    rows = {r.doc_id: r for r in score(clashing(docs).drop("score")).collect()}
    assert len(rows) == len(plain)
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in plain}
    c = Counter(w for i, t in plain.items() if not held[i] for w in [*words(t, True), None])
    n, v = sum(c.values()), len(c)
    for i, t in plain.items():
        r, tokens = rows[i], [*words(t, True), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    assert score(docs.limit(0)).count() == 0


def test_language_model_prefers_its_language(spark):
    """Held-out texts score above texts of the same letters in random order."""
    from sievework.llm.pitman_yor import score

    r = random.Random(8)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
    data = [(i, " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 5))) for _ in range(60))) for i in range(200)]
    held = [(i, t) for i, t in data if zlib.crc32(str(i).encode()) % 7 == 2]
    mixed = [(1000 + k, " ".join("".join(r.sample(w, len(w))) for w in t.split())) for k, (_, t) in enumerate(held)]
    rows = {x.doc_id: x for x in score(spark.createDataFrame(data + [(j + 0, t) for j, t in mixed if zlib.crc32(str(j).encode()) % 7 == 2], "doc_id bigint, text string")).collect()}
    rate = lambda ids: sum(rows[i].score for i in ids) / sum(rows[i].n_tokens for i in ids)
    others = [i for i in rows if i >= 1000]
    assert others and rate([i for i, _ in held]) > rate(others) + 0.3


def test_language_model_hears_word_order(spark):
    """Held-out texts score above the same words shuffled; the scores without context are equal."""
    from sievework.llm.pitman_yor import score

    r = random.Random(4)
    after = {f"w{i}": [f"w{r.randrange(40)}" for _ in range(2)] for i in range(40)}
    data = []
    for i in range(200):
        w = ["w0"]
        while len(w) < 60:
            w.append(r.choice(after[w[-1]]))
        data.append((i, w))
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    mixed = [(1000 + i, r.sample(w, len(w))) for i, w in data if held(i) and held(1000 + i)]
    assert mixed
    rows = {x.doc_id: x for x in score(spark.createDataFrame([(i, " ".join(w)) for i, w in data + mixed], "doc_id bigint, text string").repartition(3)).collect()}
    for i, _ in mixed:
        assert math.isclose(rows[i].base_score, rows[i - 1000].base_score, rel_tol=1e-9)
        assert rows[i - 1000].score > rows[i].score + 20
        assert rows[i - 1000].perplexity < 4


def test_long_unseen_words_have_no_floor(spark):
    """Each further byte of an unseen word costs."""
    from sievework.llm.pitman_yor import score

    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    long_ = dict(zip(held, (500, 5000, 50_000), strict=True))
    data = [(i, "zq" * (long_[i] // 2) if i in long_ else "some words of a text") for i in range(100)]
    rows = {x.doc_id: x.score for x in score(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    a, b, c = (rows[i] for i in held)
    assert a < -500 and 9 < b / a < 11 and 9 < c / b < 11


def test_spelling_is_a_distribution():
    from sievework.llm.pitman_yor import Restaurants, Settings, SYMBOLS, trigrams

    words_ = [b"abc", b"abd", b"b", b"caab", b""]
    keys, _ = trigrams(np.frombuffer(b"".join(words_), np.uint8), np.array([len(w) for w in words_]))
    found, counts = np.unique(keys, return_counts=True)
    r = Restaurants(found, counts, Settings())
    for _ in range(3):
        r.sweep()
        assert (r.tables[2] >= 1).all() and (r.tables[2] <= r.customers[2]).all()
        for level in (1, 2):  # a table is a customer of the parent
            sent = Counter()
            for k, t in zip(r.keys if level == 2 else range(SYMBOLS**2), r.tables[level], strict=True):
                sent[int(k) % SYMBOLS**level] += int(t)
            assert {k: s for k, s in sent.items() if s} == {k: int(x) for k, x in enumerate(r.customers[level - 1]) if x}
    t = r.table()
    for context in {int(k) // SYMBOLS for k in found}:
        keys = context * SYMBOLS + np.arange(SYMBOLS)
        p = t.back[context] * t.first[context % SYMBOLS] + np.array([t.own[np.searchsorted(t.keys, k)] if k in t.keys else 0 for k in keys])
        assert math.isclose(p.sum(), 1, rel_tol=1e-9)


def partitions_of(n):
    """All ways of seating n customers, as lists of table sizes (one list for each set partition)."""
    if not n:
        yield []
        return
    for rest in partitions_of(n - 1):
        yield [*rest, 1]
        for i in range(len(rest)):
            yield [*rest[:i], rest[i] + 1, *rest[i + 1 :]]


@pytest.mark.parametrize("c, d, a", [(5, 0.5, 0.7), (7, 0.2, 3.0), (9, 0.8, 0.05), (8, 0.4, 40.0)])
def test_seating_against_all_seatings(c, d, a):
    """Numbers of tables, and the predictive probability that they give, against the sum over all seatings of a dish."""
    from sievework.llm.pitman_yor import Settings, log_stirling, seat

    weight = Counter()
    for sizes in partitions_of(c):
        w = a ** len(sizes)
        for n in sizes:
            w *= math.prod(k - d for k in range(1, n))
        weight[len(sizes)] += w
    total = sum(weight.values())
    stirling = log_stirling(d)
    assert all(math.isclose(math.exp(stirling[c, t]) * a**t, w, rel_tol=1e-9) for t, w in weight.items())
    n = 60_000
    t = seat(np.arange(n, dtype=np.uint64), np.full(n, c), np.full(n, math.log(a)), d, 1, Settings())
    for k in range(1, c + 1):
        assert abs((t == k).mean() - weight[k] / total) < 0.01
    chance = lambda k: (c - d * k + (1 + d * k) * 0.1) / (c + 1)
    assert abs(chance(t).mean() - sum(w * chance(k) for k, w in weight.items()) / total) < 0.003


def test_tables_are_drawn_as_by_plain_sums():
    """Each dish by itself: the first number of tables whose share of the sum reaches the random number."""
    from sievework.llm import arrays, pitman_yor

    r, s = np.random.default_rng(5), pitman_yor.Settings()
    count = np.concatenate([np.arange(pitman_yor.STIRLING + 1), r.integers(1, 40, 3000)])
    h, log_a = r.integers(0, 2**63, len(count), dtype=np.uint64), r.normal(size=len(count)) * 3
    got, u = pitman_yor.seat(h, count, log_a, 0.6, 1, s), (arrays.mix(h + np.uint64(2 + 1000 * s.seed)) >> np.uint64(11)) * 2.0**-53
    for c, a, x, n in zip(count.tolist(), log_a, u, got.tolist(), strict=True):
        w = pitman_yor.log_stirling(0.6)[c, : c + 1] + np.arange(c + 1) * a
        edge = np.cumsum(np.exp(w - w.max()))
        assert n == (max(1, int((edge < x * edge[-1]).sum())) if c > 1 else c)


def test_places_among_distinct_numbers():
    from sievework.llm.pitman_yor import by_owner, distinct_places

    r = np.random.default_rng(6)
    for n, end in ((0, 9), (1, 1), (5000, 90), (5000, 1 << 40), (5000, 1 << 60)):
        key = r.integers(0, end, n)
        key[: n // 2] = key[n - n // 2 :]
        for got, want in zip(distinct_places(key, end), np.unique(key, return_inverse=True), strict=True):
            assert np.array_equal(got, want)
    for parts in (3, 1 << 16, (1 << 16) + 5):
        owner = r.integers(0, parts, 5000).astype(np.uint64)
        assert np.array_equal(by_owner(owner, parts), np.argsort(owner, kind="stable"))


def test_seating_of_large_dishes():
    """No cap on tables: up to the bound of the exact numbers by enumeration of their table, beyond it by Poisson numbers."""
    from sievework.llm.pitman_yor import STIRLING, Settings, log_stirling, poisson, seat

    r = np.random.default_rng(1)
    d, n = 0.5, 4000
    for c, a in ((60, 100.0), (STIRLING, 20.0)):
        w = log_stirling(d)[c, : c + 1] + np.arange(c + 1) * math.log(a)
        p = np.exp(w - w.max())
        t = seat(r.integers(0, 2**63, n).astype(np.uint64), np.full(n, c), np.full(n, math.log(a)), d, 1, Settings())
        assert abs(t.mean() - (p * np.arange(c + 1)).sum() / p.sum()) < 0.5 and t.max() > 16
    for mean in (0.3, 5.0, 63.0, 65.0, 1e4):
        k = poisson(np.full(n, mean), r.random(n))
        assert abs(k.mean() - mean) < 4 * math.sqrt(mean / n) + 0.02 and abs(k.var() / mean - 1) < 0.15
    t = seat(np.arange(n, dtype=np.uint64), np.full(n, 10**6), np.full(n, math.log(100.0)), d, 1, Settings())
    assert abs(t.mean() - 201) < 2


# 6


def test_packing(spark, docs, plain):
    import public_tokenizers
    from tokenizers import Tokenizer

    from sievework.llm.packing import pack

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = pack(clashing(docs), path, with_ids=True, capacity=256).collect()
    ids, sequences = {}, {}
    for r in rows:
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        ids.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, t in plain.items():
        pieces = sorted(ids[i], key=lambda r: r.start)
        want = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert [x for r in pieces for x in r.ids] == want and all(r.doc_tokens == len(want) for r in pieces)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert pack(docs.limit(0), path).count() == 0


def test_cuts():
    from sievework.llm.packing import cuts

    for n in range(1, 5000):
        c = cuts(n, 2048)
        assert sum(s for _, s in c) == n and all(1 <= s <= 2048 // k for k, s in c)


# 7


def test_line_dedup(spark, docs, plain):
    from sievework.llm.line_dedup import clean, summarize

    lines, want = [], {}
    for i, t in sorted(plain.items()):
        for k, x in enumerate((t or "").split("\n")):
            w = words(x, True)
            if w:
                s = frozenset(w)
                if any(100 * len(s & o) >= 80 * len(s | o) for o in lines):
                    want.setdefault(i, []).append(k)
                lines.append(s)
    got = {r.doc_id: r for r in summarize(clashing(docs)).collect()}
    assert {i: list(r.removed) for i, r in got.items() if r.n_removed} == want and len(got) == len(plain)
    for r in clean(docs).collect():
        t = plain[r.doc_id]
        assert r.cleaned_text == (t if r.doc_id not in want else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[r.doc_id]))
    assert summarize(docs.limit(0)).count() == 0


def removed_lines(data):
    """Brute force: line numbers that go, by id."""
    lines, want = [], {}
    for i, t in sorted(data):
        for k, x in enumerate((t or "").split("\n")):
            if s := frozenset(words(x, True)):
                if any(100 * len(s & o) >= 80 * len(s | o) for o in lines):
                    want.setdefault(i, []).append(k)
                lines.append(s)
    return want


@pytest.mark.parametrize("settings", [{}, {"HOT": 3}, {"MANY": 8, "LEADERS": 2, "PAIRS_AT_ONCE": 64}, {"SENT": 0, "BUCKET": 50, "CHUNK_BYTES": 100}])
def test_line_dedup_second_pass(spark, monkeypatch, settings):
    """Many candidates, none confirmed, then one that is; also with tokens dealt by blocks, few leaders and many small buckets."""
    from sievework.llm import line_dedup

    for k, v in settings.items():
        monkeypatch.setattr(line_dedup, k, v)
    r = random.Random(9)
    core = [f"w{i}" for i in range(14)]
    data = []
    for i in range(80):
        w = core + [f"x{i}_{k}" for k in range(r.randint(2, 4))]
        r.shuffle(w)
        data.append((i, " ".join(w)))
    for i in range(80, 200):
        w = core[:6] + [f"y{k}" for k in range(12)]
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"z{i}"
        data.append((i, " ".join(w) + "\n" + " ".join(r.choice(core) for _ in range(5))))
    want = removed_lines(data)
    d = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    assert {r.doc_id: list(r.removed) for r in line_dedup.summarize(d).collect() if r.n_removed} == want


def test_line_dedup_edges(spark):
    """Ids that are text, null and repeated ids, columns of names that are used inside."""
    from sievework.llm.line_dedup import clean, summarize

    data = [("b", "one two three four\n\nfive six"), ("a", "one two three four"), (None, "one two three four"), ("c", None), ("d", ""), ("e", "x y z"), ("e", "x y z")]
    d = spark.createDataFrame(data, "doc_id string, text string").selectExpr("*", "1 as _removed", "2 as _key", "'k' as id", "3 as line")
    assert sorted((r.doc_id or "", r.n_lines, list(r.removed)) for r in summarize(d).collect()) == [("", 1, []), ("a", 1, []), ("b", 3, [0]), ("c", 0, []), ("d", 0, []), ("e", 1, []), ("e", 1, [])]
    got = clean(d)
    assert got.columns == [*d.columns, "cleaned_text"]
    assert {(r.doc_id, r.cleaned_text) for r in got.collect()} == {("b", "\nfive six"), ("a", "one two three four"), (None, "one two three four"), ("c", None), ("d", ""), ("e", "x y z")}


def test_line_dedup_takes_short_lines(spark, tmp_path):
    """The query, on lines of one to six words, against brute force."""
    from sievework.llm.queries import op7_line_dedup

    r = random.Random(12)
    data = [(i, "\n".join(" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 6))) for _ in range(r.randint(1, 4)))) for i in range(120)]
    lines, want = [], {}
    for i, t in data:
        for k, x in enumerate(t.split("\n")):
            if s := frozenset(x.split()):
                if any(100 * len(s & o) >= 80 * len(s | o) for o in lines):
                    want.setdefault(i, []).append(k)
                lines.append(s)
    spark.createDataFrame(data, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert {x.doc_id: list(x.removed) for x in op7_line_dedup(spark, str(tmp_path)).collect() if x.n_removed} == want


# 8


def test_secrets(spark):
    from sievework.llm.secret_scan import labelled_findings, scan, train

    model = train(labelled_findings(spark))
    key = "AKIA" + "D62HKU6VBLCCCCE9"
    data = [(1, f"so the {key} of it {key}"), (2, 'x token = "8d5e425dbdaa383537b4fea24b37ed72645ac62d"'), (3, "y password=7602ad27cf5550de1c z"), (4, "commit 8d5e425dbdaa383537b4fea24b37ed72645ac62d"), (5, None), (6, ""), (7, "nothing here " * 5000), (8, "number 4465758382889437 and 550e8400-e29b-41d4-a716-446655440000")]
    d = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("findings", F.lit("clash"))
    got = {r.doc_id: r for r in scan(d, model).collect()}
    assert {i: r.n_secrets for i, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0}
    assert got[1].redacted_text == "so the <SECRET> of it <SECRET>" and got[1].findings[0].start == 7
    assert got[5].redacted_text is None and got[6].redacted_text == ""
    assert scan(d.limit(0), model).count() == 0


def test_secrets_of_other_shapes(spark):
    """Short, dotted and all-letter values, odd characters, and a value whose second place only tells it; then text that has none."""
    from sievework.llm.secret_scan import labelled_findings, scan, train

    a, b = "Qk3vZ8mWx1LpT5yRb7Nc2D", "hJ4sXw9GfK2qVt6ZnB8mLc3RyP5dAe7UoT1iWxHkFgS"
    secrets = ["hunter2Xy9", "Tr0ub4dor&3-xK!p9_zz", "qzjwvkxgfhtrbpmndlcysqzjwvkxgfht", f"SG.{a}.{b}", f"eyJhbGciOiJIUzI1NiJ9.eyJ{b}.{a}{b}", f"//hooks.slack.com/services/T0A1B2C3D/B4E5F6G7H/{a}x9"]
    said = ['password = "{}"', 'secret="{}"', "api_key = {}", "use {} now", "got {} back", "post to https:{} then"]
    data = [(i, p.format(v)) for i, (p, v) in enumerate(zip(said, secrets, strict=True))]
    hexa = "8d5e425dbdaa383537b4fea24b37ed72645ac62d"
    data.append((6, f"é🙂 commit {hexa} but token = \"{hexa}\""))
    data.append((7, 'He said "wonderful" of the incomprehensibilities in https://www.garden.com/about/flowers.html and the secret ingredient.'))
    got = {r.doc_id: r for r in scan(spark.createDataFrame(data, "doc_id bigint, text string"), train(labelled_findings(spark))).collect()}
    for i, v in enumerate(secrets):
        assert v not in got[i].redacted_text and got[i].n_secrets == 1 and data[i][1][got[i].findings[0].start :].startswith(v), data[i]
    assert got[6].n_secrets == 1 and hexa not in got[6].redacted_text and got[6].findings[0].start == data[6][1].rindex(hexa)
    assert got[7].n_secrets == 0 and got[7].n_candidates >= 3 and got[7].redacted_text == data[7][1]


# 9


@pytest.fixture(scope="module")
def pages(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "<p>é" + "x" * 200_000 + "</p>", "<p>a</p>", "b"]
    return spark.createDataFrame([(i, f"http://h/{i}\r\nX: y", h) for i, h in enumerate(html)], "page_id bigint, url string, html string").withColumn("payload", F.lit(1)).repartition(3), html


def test_warc_round_trip(spark, pages):
    from sievework.llm.warc import archive_and_read

    d, html = pages
    got = {r.page_id: r for r in archive_and_read(d).collect()}
    last = {}
    for i, h in enumerate(html):
        last[h or ""] = i
    for i, h in enumerate(html):
        b, r = (h or "").encode(), got[i]
        own = last[h or ""] == i
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if own else ("revisit", last[h or ""]))
        assert r.stored_sha1 == (hashlib.sha1(b).hexdigest() if own else None)
    assert archive_and_read(d.limit(0)).count() == 0


def test_warc_pushdown_and_skipping(spark, pages, tmp_path):
    from sievework.llm.warc import EqualTo, Records, Wanted, read_warc, write_pages

    d, _ = pages
    path = str(tmp_path / "w")
    write_pages(d.repartition(1), path)
    some = read_warc(spark, path).where("record_type = 'revisit' and target_uri like 'http://h/%'")
    assert some.count() == 3 and "payload" in some.columns
    assert read_warc(spark, path, payload=False).where("payload is not null").count() == 0
    file = next(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".gz") and os.path.getsize(os.path.join(path, f)))
    size = len(gzip.open(file).read())
    wanted = Wanted()
    assert wanted.take(EqualTo(("record_type",), "revisit")) and not wanted.take(EqualTo(("payload_bytes",), 1))
    records = Records(file, wanted, True)
    assert len(list(records)) == 3 and records.inflated < size / 4
    text = gzip.open(file).read()
    open(tmp_path / "plain.warc", "wb").write(text)
    open(tmp_path / "other.warc.gz", "wb").write(gzip.compress(text[: text.index(b"WARC/1.1", 10)]))
    assert read_warc(spark, str(tmp_path / "plain.warc")).count() == 7
    assert read_warc(spark, str(tmp_path / "other.warc.gz")).count() == 1


# 10


def test_bpe(spark, docs, plain):
    import public_tokenizers
    from tokenizers import Tokenizer

    from sievework.llm.bpe import encode_decode

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for r in encode_decode(clashing(docs), path).collect():
        ids = library.encode(plain[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == " ".join(map(str, ids)) and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert encode_decode(docs.limit(0), path, with_texts=False).count() == 0


# pipeline


def test_pipeline_stages(spark, docs, plain, tmp_path):
    import corpus_pipeline as P

    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(60)], "doc_id bigint, quality int").withColumn("toxic", F.lit(0)).write.parquet(f"{sf}/labels.parquet")
    assert [f(spark, docs.limit(0), sf).count() for _, f in P.STAGES[1:]] == [0, 0, 0, 0]
    kept = P.near_copies(spark, docs, sf)
    want = {i for i, (_, c) in brute_components(plain).items() if i == c}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == P.COLUMNS
    cleaned = {r.doc_id: r.text for r in P.lines(spark, docs, sf).collect()}
    assert set(cleaned) <= set(plain) and 0 in cleaned and cleaned[10] == plain[10]
    assert P.secrets(spark, docs, sf).count() == len(plain) and P.secrets(spark, docs, sf).columns == P.COLUMNS


def test_names_that_clash(spark):
    """Columns with the names that the classifier and the secret scan use inside or add."""
    from sievework.llm.mil import classify, train
    from sievework.llm.secret_scan import labelled_findings, scan, train as fit

    d = spark.createDataFrame([(1, "token = 'a8f5f167f44f4964e6c998dee827110c'"), (2, None)], "doc_id bigint, text string").selectExpr("*", "'x' as _t", "7 as _v", "'s' as score", "1 as _row", "true as held_out")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = classify(d, train(d, labels), keep=["doc_id", "score", "_t"])
    assert got.columns == ["doc_id", "_t", "held_out", "score", "predicted"] and all(isinstance(r.score, float) for r in got.collect())
    found = scan(d, fit(labelled_findings(spark, 400)))
    assert found.columns == [*d.columns, "n_candidates", "n_secrets", "findings", "redacted_text"]
    assert [(r._t, r._v, r.redacted_text is None) for r in found.orderBy("doc_id").collect()] == [("x", 7, False), ("x", 7, True)]


def test_warc_keeps_ids_that_are_text(spark, tmp_path):
    from sievework.llm.warc import archive_and_read

    d = spark.createDataFrame([("p-1", "u", "<a>"), ("p-2", "u", "<a>"), ("q", None, None)], "page_id string, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in archive_and_read(d, f"file://{tmp_path}/w").collect()}
    assert got == {"p-1": ("revisit", "p-2"), "p-2": ("response", None), "q": ("response", None)}
