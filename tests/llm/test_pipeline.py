"""The pipeline from end to end, each stage against brute force on what the stage before kept."""

import random
import re
from collections import Counter

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SECRET = "8d5e425dbdaa383537b4fea24b37ed72645ac62d"


def documents():
    r = random.Random(12)
    vocabulary = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(300)]
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)).capitalize() + "."
    good = ["\n".join(line(r.randint(12, 25)) for _ in range(r.randint(2, 5))) for _ in range(50)]
    junk = ["### $$$ %%% " * r.randint(5, 20) + line(3).upper() for _ in range(25)]
    near = [g.replace(" ", "  ", 1) for g in good[:4]] + [good[5], good[5], good[6] + " tail"]
    secret = [good[8].split("\n")[0] + f' with token = "{SECRET}" ' + line(30)]
    shared = line(20)
    boiler = [line(15) + "\n" + shared + "\n" + line(18) for _ in range(4)] + [shared]
    texts = good + near + secret + boiler
    rows = [(i, t) for i, t in enumerate(texts)] + [(200 + i, t) for i, t in enumerate(junk)]
    rows += [(2, line(40)), (2, good[1]), (None, line(35)), (None, good[0]), (300, None), (301, ""), (302, " \n ")]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows]


def shingles(t):
    w = WORD.findall((t or "").lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def near_kept(rows):
    """Of each component of linked rows the one of the smallest id stays (rows in order of id, null last)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return [r for i, r in enumerate(rows) if label[i] == i]


def without_repeated_lines(rows):
    """Lines that are similar to an earlier line (by id, then line number) go; rows without an id keep theirs."""
    lines, gone = [], {}
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for k, x in enumerate((t or "").split("\n")):
            s = frozenset(WORD.findall(x.lower()))
            if s:
                if any((j, m) < (i, k) and 100 * len(s & o) >= 80 * len(s | o) for j, m, o in lines):
                    gone.setdefault(i, set()).add(k)
                lines.append((i, k, s))
    out = []
    for r in rows:
        t = r[1]
        if t is not None and r[0] in gone:
            t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[r[0]])
        n = lambda x: len(re.sub(r"[\x20\x09-\x0D]+", "", x or ""))
        if n(t) == n(r[1]) or n(t) * 100 >= n(r[1]) * 20:
            out.append((r[0], t, r[2], r[3], len(t or "")))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(documents(), DOC).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(200 + i, 0, 0) for i in range(25)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_and_run(spark, folder):
    import corpus_pipeline as P
    import public_tokenizers
    from tokenizers import Tokenizer

    from sievework.llm import mil

    bag = lambda rows: Counter(tuple(r) for r in rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    stage = dict(P.STAGES)
    kept = {}
    at = docs
    for name, f in P.STAGES:
        kept[name] = f(spark, at, folder).collect()
        if name != "packing":
            at = spark.createDataFrame(kept[name], DOC).repartition(2)
    assert list(stage) == ["quality classifier", "line dedup", "n-gram Jaccard join", "secret scans", "packing"]

    predicted = mil.classify(docs, mil.train(docs, labels), keep=P.COLUMNS).where("predicted = 1").select(*P.COLUMNS).collect()
    assert bag(kept["quality classifier"]) == bag(predicted)
    ids = {r.doc_id for r in predicted}
    assert sum(i in ids for i in range(50)) >= 45 and sum(200 + i in ids for i in range(25)) <= 2
    assert bag(kept["line dedup"]) == bag(without_repeated_lines([tuple(r) for r in kept["quality classifier"]]))
    assert bag(kept["n-gram Jaccard join"]) == bag(near_kept([tuple(r) for r in kept["line dedup"]]))
    assert len(kept["n-gram Jaccard join"]) < len(kept["line dedup"])
    before = {(r.doc_id, (r.text or "").replace(f'"{SECRET}"', '"<SECRET>"')) for r in kept["n-gram Jaccard join"]}
    assert {(r.doc_id, r.text or "") for r in kept["secret scans"]} == before
    assert any("<SECRET>" in (r.text or "") for r in kept["secret scans"]) and all(r.n_chars == len(r.text or "") for r in kept["secret scans"])

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    want = Counter((r.doc_id, len(encode(r.text or "", add_special_tokens=False).ids) + 1) for r in kept["secret scans"])
    pieces = kept["packing"]
    whole = Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0)
    assert whole == want and sum(r.length for r in pieces) == sum(n * c for (_, n), c in want.items())
    ran = P.run(spark, folder).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in ran if r.start == 0) == want and sum(r.length for r in ran) == sum(r.length for r in pieces)


def test_repeated_ids_are_judged_by_their_own_texts(spark):
    """Of two rows of one id, one like another document and one not, only the first goes."""
    import corpus_pipeline as P

    r = random.Random(1)
    text = lambda: " ".join(f"w{r.randrange(1000)}" for _ in range(30))
    one, own = text(), text()
    rows = [(1, one), (2, one), (2, own), (None, one), (None, own + " more"), (7, None), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC).repartition(3)
    got = [(x.doc_id, x.text) for x in P.near_copies(spark, docs, "").collect()]
    assert Counter(got) == Counter([(1, one), (2, own), (7, None), (7, None), (8, "")])
    clean = spark.createDataFrame([(i, text(), "en", "s", 0) for i in range(5)], DOC)
    assert P.near_copies(spark, clean, "").count() == 5 and P.near_copies(spark, docs.limit(0), "").count() == 0


def test_texts_are_not_shuffled_for_the_joins_with_what_goes(spark):
    """Whatever the session's threshold, the lines and copies that go are broadcast while they are few; beyond, the result is the same."""
    import corpus_pipeline as P
    from sievework.llm import shared

    docs = spark.createDataFrame(documents(), DOC).where("doc_id is not null").dropDuplicates(["doc_id"]).repartition(3)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    limit = shared.SENT
    try:
        for stage in (P.lines, P.near_copies):
            shared.SENT = limit
            df = stage(spark, docs, "")
            plan, few = df._jdf.queryExecution().executedPlan().toString(), Counter(map(tuple, df.collect()))
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
            shared.SENT = 0
            df = stage(spark, docs, "")
            assert "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()
            assert Counter(map(tuple, df.collect())) == few
    finally:
        shared.SENT = limit
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
