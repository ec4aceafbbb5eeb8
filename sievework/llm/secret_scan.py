"""Secret scan with a random forest (operator 8), in DataFrame expressions only.

Candidates are found in the row, their features are SQL expressions, and the forest, fitted by MLlib on labelled
findings, is applied as a SQL expression too. What is natural is learned from the corpus: its frequent words are the
dictionary, and which letters follow each other in its words gives the transitions. A text never leaves its row, so nothing
is shuffled but the counts of words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words behind which a secret or something else may stand, and paths of samples.
SECRET_WORDS = r"(?:password|passwd|passphrase|passwort|kennwort|contrase\u00f1a|mot de passe|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private)"
AGAINST_WORDS = r"(?i)(?:commit|sha-?(?:1|256)?|md5|checksum|digest|hash|uuid|guid|etag|revision|build|version|isbn|order|invoice|phone|card|serial|id)[\x22\x27]?\s*[:=]?\s*[\x22\x27]?$"
FOR_WORDS = rf"(?i){SECRET_WORDS}[A-Za-z0-9_\-]{{0,24}}[\x22\x27]?\s*(?:is\s|[:=]=?>?)?\s*[\x22\x27]?$"
PATHS = r"(?i)(?:test|example|sample|fixture|docs?|mock)"
_RUN = r"[A-Za-z0-9+/_\-]"
#: A value behind a secret word and a sign, in quotes (there it may have spaces) or not; a password in an address; a value in
#: quotes; a run of 16 characters or more in which dots join parts, if it is no name that gets a value. Each alternative is
#: what stands before, the value, and what stands behind.
CANDIDATE = (
    rf"((?i:{SECRET_WORDS})[A-Za-z0-9_\-]{{0,24}}+[\x22\x27]?\s{{0,3}}(?:is\s{{1,3}}|[:=]=?>?\s{{0,3}}))(?:([\x22\x27])((?:(?!\2)[^\r\n]){{4,200}})(\2)|([^\s\x22\x27<>]{{4,200}}[^\s\x22\x27<>.,;:)\]}}]))"
    r"|(://[^\s:/@]{0,64}:)([^\s@/]{3,200})(@)"
    r"|(\x22)([^\s\x22]{8,})(\x22)|(\x27)([^\s\x27]{8,})(\x27)"
    rf"|((?<!{_RUN})(?=[A-Za-z0-9+/_.\-]{{16}}){_RUN}++(?:\.{_RUN}++)*+(?:={{1,2}}+(?![A-Za-z0-9\x22\x27]))?+(?!\s{{0,2}}[:=][^/]))"
)
#: Puts a mark before and behind each value.
_MARKED = "$1$2$6$9$12\u0001$3$5$7$10$13$15\u0001$4$8$11$14"
#: Characters before a candidate that count as its neighbouring words.
NEIGHBOURS = 48
DICTIONARY = ["about", "chapter", "class", "config", "content", "data", "default", "docs", "document", "example", "factory", "file", "function", "here", "image", "index", "introduction", "java", "main", "message", "model", "module", "name", "number", "page", "path", "provider", "python", "release", "resource", "sample", "section", "some", "source", "static", "test", "token", "user", "version", "words"]
LETTERS = "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Language:
    """Frequent words of a corpus, and the logarithm of the probability of each letter (0: any other character) behind each."""

    words: list[str]
    transitions: list[float]


def _transitions(pairs: dict[tuple[int, int], int]) -> list[float]:
    out = []
    for a in range(27):
        total = sum(pairs.get((a, b), 0) for b in range(27))
        out += [round(math.log((pairs.get((a, b), 0) + 0.5) / (total + 13.5)), 4) for b in range(27)]
    return out


def language_of(words: dict[str, int]) -> Language:
    """From counted words; common words of programs are always in the dictionary."""
    pairs: dict[tuple[int, int], int] = {}
    for w, n in words.items():
        at = [LETTERS.find(c) + 1 for c in w.lower()]
        for x in zip([0, *at], [*at, 0], strict=True):
            pairs[x] = pairs.get(x, 0) + n
    return Language(sorted({w for w in words if len(w) > 2} | set(DICTIONARY)), _transitions(pairs))


def learn_language(docs: DataFrame, text_col: str = "text", most: int = 2000) -> Language:
    """The ``most`` frequent words of 3 letters or more in all texts, as a dictionary and for the transitions between letters."""
    words = F.explode(F.regexp_extract_all(F.lower(F.col(f"`{text_col}`").cast("string")), F.lit(r"\p{L}{3,30}"), F.lit(0))).alias("w")
    counts = docs.select(words).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(most)
    return language_of({r.w: r.n for r in counts.collect()})


def features(v: str, before: str, path: str, language: Language) -> str:
    """One array of all features, as SQL over the three given expressions, each evaluated once."""
    table = "array(" + ", ".join(f"{x}D" for x in language.transitions) + ")"
    known = "(" + ", ".join("'" + w.replace("\\", "").replace("'", "") + "'" for w in language.words) + ")"
    letter = "locate(substr(lower(v), {i}, 1), 'abcdefghijklmnopqrstuvwxyz')"
    inner = ", ".join(x.format(table=table, known=known, a=letter.format(i="i"), b=letter.format(i="i + 1")) if "{table}" in x or "{known}" in x else x for x in FEATURES.values())
    return f"transform(array(named_struct('v', {v}, 'before', {before}, 'path', {path})), q -> transform(array(q.v), v -> transform(array(q.before), before -> transform(array(q.path), path -> array({inner}))[0])[0])[0])[0]"


#: Feature name and SQL over v (the candidate), before (the text in front of it) and path.
FEATURES = {
    "length": "cast(length(v) as double)",
    "digit_share": "cast(length(regexp_replace(v, '[^0-9]', '')) as double) / length(v)",
    "upper_share": "cast(length(regexp_replace(v, '[^A-Z]', '')) as double) / length(v)",
    "lower_share": "cast(length(regexp_replace(v, '[^a-z]', '')) as double) / length(v)",
    "class_changes": "cast(length(regexp_replace(regexp_replace(regexp_replace(v, '[0-9]+', '0'), '[A-Z]+', 'A'), '[a-z]+', 'a')) as double) / length(v)",
    "transitions": "aggregate(sequence(1, greatest(1, length(v) - 1)), 0D, (t, i) -> t + element_at({table}, cast({a} * 27 + {b} + 1 as int))) / greatest(1, length(v) - 1)",
    "distinct_share": "cast(size(array_distinct(split(v, ''))) as double) / length(v)",
    "hexadecimal": "case when regexp_like(v, '^[0-9a-f]+$') then 1D else 0D end",
    "separators": "cast(length(regexp_replace(v, '[^/_+-]', '')) as double) / length(v)",
    "spaces": "cast(length(v) - length(replace(v, ' ', '')) as double) / length(v)",
    "dictionary": "aggregate(filter(split(lower(regexp_replace(v, '([a-z])([A-Z])', '$1 $2')), '[^\\\\p{{L}}]+'), w -> w in {known}), 0D, (t, w) -> t + length(w)) / length(v)",
    "path": f"case when regexp_like(path, r'{PATHS}') then 1D else 0D end",
    "said_secret": f"case when regexp_like(before, r'{FOR_WORDS}') then 1D else 0D end",
    "said_other": f"case when regexp_like(before, r'{AGAINST_WORDS}') then 1D else 0D end",
    "assigned": r"case when regexp_like(before, r'[:=]\s*[\x22\x27]?$') then 1D else 0D end",
    "address": r"case when regexp_like(before, r'://[^\s:/@]{0,64}:$') then 1D else 0D end",
    "access_key": r"case when regexp_like(v, r'(?:^|[^A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])') or regexp_like(v, r'(?:^|[^A-Za-z0-9])(?:gh[pousr]_|sk_live_|xox[abp]-)') or regexp_like(v, r'(?:^|[^A-Za-z0-9])(?:SG\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+|eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.|hooks\.slack\.com/services/)') then 1D else 0D end",
}


@dataclass
class Detector:
    forest: RandomForestClassificationModel
    language: Language


def labelled_findings(spark: SparkSession, n: int = 4000, words: list[str] | None = None) -> DataFrame:
    """Labelled findings (value, before, path, label), made by rule from a row number: keys, passwords and tokens against commit
    ids, checksums, uuids, numbers, names, addresses and words of the language. Any table of these columns can be used instead."""
    known = [w for w in (words or DICTIONARY) if w.isascii() and w.isalpha()] or DICTIONARY
    known = known[:: max(1, len(known) // 400)]
    hexa = "sha2(cast(id as string), 256)"
    mixed = "translate(base64(unhex(sha2(cast(id + 7 as string), 256))), '+/=', 'xYz')"
    other = "translate(base64(unhex(sha2(cast(id + 8 as string), 256))), '+/=', 'xYz')"
    pick = lambda k: f"element_at(array({', '.join(repr(w) for w in known)}), cast(1 + pmod(xxhash64(id, {k}), {len(known)}) as int))"
    word, word2, word3 = (f"w{k}" for k in (1, 2, 3))
    letters = f"translate({hexa}, '0123456789', 'ghijklmnop')"
    length = lambda low, high: f"({low} + cast(pmod(xxhash64(id, 9), {high - low + 1}) as int))"
    sign = "element_at(array('=', ' = ', ': ', ':', '=\"', ': \"', ' = \"'), cast(1 + pmod(xxhash64(id, 5), 7) as int))"
    name = "element_at(array('password', 'passwd', 'secret', 'api_key', 'token', 'pwd', 'auth_token', 'db_password', 'client_secret', 'mot de passe ', 'Passwort'), cast(1 + pmod(xxhash64(id, 6), 11) as int))"
    cases = [
        (1, f"concat('AKIA', upper(substring({mixed}, 1, 16)))", "'the key is '"),
        (1, f"concat('AKIA', upper(substring({mixed}, 5, 16)))", f"concat({word}, ' ', {word2}, ' ')"),
        (1, f"substring({hexa}, 1, {length(16, 40)})", f"concat({name}, {sign})"),
        (1, f"substring({mixed}, 1, {length(12, 40)})", f"concat({name}, {sign})"),
        (1, f"concat('ghp_', substring({mixed}, 1, 36))", "'use '"),
        (1, f"substring({mixed}, 1, {length(7, 11)})", f"concat({name}, {sign})"),
        (1, f"concat({word}, cast(id % 1000 as string), substring('!@#$%&', 1 + cast(id % 6 as int), 1))", f"concat({name}, {sign})"),
        (1, f"concat({word}, ' ', {word2}, cast(10 + id % 90 as string))", "'pwd: \"'"),
        (1, f"concat({word}, ' ', {word2}, if(id % 2 = 0, concat(' ', {word3}), ''))", "'pwd: \"'"),
        (1, f"concat(substring({mixed}, 1, 1 + cast(id % 4 as int)), {word}, substring({other}, 1, 2 + cast(id % 3 as int)))", f"concat({word2}, '://', {word3}, ':')"),
        (1, f"substring({mixed}, 1, {length(8, 20)})", f"concat({word2}, '://', {word3}, ':')"),
        (1, f"concat(substring({letters}, 1, 6), cast(id % 10 as string), substring({mixed}, 1, 2), cast(id % 7 as string))", f"concat({name}, {sign})"),
        (1, f"concat(substring({mixed}, 1, 6), '&', substring({mixed}, 7, 3), '-', substring({mixed}, 10, 2), '!', substring({mixed}, 13, 6))", "'secret=\"'"),
        (1, f"concat(substring({mixed}, 1, 5), '$', substring({mixed}, 7, 5))", "'pwd: '"),
        (1, f"substring({letters}, 1, {length(20, 40)})", f"concat({name}, {sign})"),
        (1, f"concat('SG.', substring({mixed}, 1, 22), '.', substring({other}, 1, 43))", "'use '"),
        (1, f"concat('eyJ', substring({mixed}, 1, 20), '.eyJ', substring({other}, 1, 40), '.', {mixed})", "'got '"),
        (1, f"concat('//hooks.slack.com/services/T', upper(substring({mixed}, 1, 8)), '/B', upper(substring({other}, 1, 8)), '/', substring({mixed}, 9, 24))", "'post to https:'"),
        (1, f"substring({letters}, 1, {length(10, 18)})", "'password=\"'"),
        (1, f"substring({hexa}, 1, 40)", f"concat({word}, ' token = \"')"),
        (0, f"substring({hexa}, 1, 40)", "'commit '"),
        (0, hexa, "'sha256: '"),
        (0, f"concat_ws('-', substring({hexa}, 1, 8), substring({hexa}, 9, 4), substring({hexa}, 13, 4), substring({hexa}, 17, 4), substring({hexa}, 21, 12))", "'see '"),
        (0, f"substring(translate({hexa}, 'abcdef', '123456'), 1, {length(16, 24)})", f"concat({word}, ' ')"),
        (0, f"concat('src/', {word}, '/', {word2}, cast(id % 97 as string), '/index')", "'in '"),
        (0, f"concat({word}, '_', {word2}, '_', {word3}, cast(id % 10 as string))", "'call '"),
        (0, f"concat(repeat('x', 12 + cast(id % 9 as int)), cast(1000 + id % 1000 as string))", "'password='"),
        (0, f"substring({hexa}, 1, 32)", "'md5 '"),
        (0, f"substring({letters}, 1, {length(16, 27)})", "'of the '"),
        (0, f"concat({word}, {word2}, {word3})", f"concat({word}, ' ')"),
        (0, f"concat('org.', {word}, '.', substring({letters}, 1, 7), '.', {word2})", "'import '"),
        (0, f"concat('//www.', {word}, '.com/', {word2}, '/', substring({letters}, 9, 6), '.html')", "'see https:'"),
        (0, f"concat({word}, initcap({word2}), initcap({word3}), if(id % 2 = 0, 'Factory', ''))", f"concat({name}, {sign})"),
        (0, f"concat(initcap({word}), initcap({word2}), 'NameHere')", "'private = \"'"),
        (0, f"concat({word}, substring('.,-/', 1 + cast(id % 4 as int), 1), {word2})", "'password: '"),
        (0, f"concat({word}, '_', {word2})", f"concat({name}, {sign})"),
        (0, word, f"concat({name}, {sign})"),
        (0, f"concat({word}, ' ', {word2}, ' ', {word3}, ' ', {word}, ' ', {word2})", "'the token: \"'"),
        (0, f"substring({letters}, 1, {length(8, 16)})", "'he said \"'"),
        (0, f"concat({word}, '/', substring({letters}, 1, 6), '.', substring({letters}, 7, 2))", "'open \"'"),
        (0, f"concat({word}, {word2})", "'he said \"'"),
        (0, f"concat({word}, '/', {word2}, '-', {word3})", "'an '"),
        (0, f"upper(concat({word}, '_', {word2}, '_', {word3}))", "'export '"),
        (0, f"concat({word}, '.', {word2}, '.', {word3})", f"concat({name}, {sign})"),
    ]
    case = lambda k: f"case id % {len(cases)} " + " ".join(f"when {i} then {c[k]}" for i, c in enumerate(cases)) + " end"
    rows = spark.range(n).selectExpr("id", *(f"{pick(k)} as w{k}" for k in (1, 2, 3)))
    path = f"case id div {len(cases)} % 5 when 0 then 'tests/fixtures' else 'web' end as path"
    return rows.selectExpr(f"{case(1)} as value", f"{case(2)} as before", path, f"cast({case(0)} as int) as label")


def _with_features(findings: DataFrame, language: Language) -> DataFrame:
    x = findings.where("value is not null and label is not null").selectExpr("cast(label as double) as label", f"{features('value', "coalesce(before, '')", "coalesce(path, '')", language)} as f")
    x = x.select("label", *(F.col("f")[i].alias(n) for i, n in enumerate(FEATURES)))
    return VectorAssembler(inputCols=[*FEATURES], outputCol="features").transform(x).select("label", "features")


def train(findings: DataFrame, language: Language | None = None, trees: int = 20, depth: int = 9, seed: int = 11) -> Detector:
    """A random forest on labelled findings (value, before, path, label; rows with a null value or label are left out) in a language (default: words of programs alone)."""
    language = language or language_of({w: 1 for w in DICTIONARY})
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(_with_features(findings, language))
    return Detector(forest, language)


def measured(findings: DataFrame, detector: Detector) -> dict[str, float]:
    """Precision, recall and the share of false findings that are removed, on labelled findings."""
    p = detector.forest.transform(_with_features(findings, detector.language)).select("label", F.col("prediction").alias("p"))
    c = {(r.label, r.p): r["count"] for r in p.groupBy("label", "p").count().collect()}
    hit, false, miss = c.get((1.0, 1.0), 0), c.get((0.0, 1.0), 0), c.get((1.0, 0.0), 0)
    return {"precision": hit / max(1, hit + false), "recall": hit / max(1, hit + miss), "removed": c.get((0.0, 0.0), 0) / max(1, c.get((0.0, 0.0), 0) + false)}


def trained(docs: DataFrame, text_col: str = "text") -> Detector:
    """A detector in the language of the documents, on findings made by rule with their words."""
    language = learn_language(docs, text_col)
    return train(labelled_findings(docs.sparkSession, words=language.words), language)


def forest_sql(model: RandomForestClassificationModel, f: str = "f") -> str:
    """The forest as SQL over the array ``f``: the mean of its trees' shares of secrets among the findings in a leaf.

    The nodes of all trees stand in arrays that are constants, and a row walks from each root; as nested conditions they
    would be thousands of expressions in each copy of the plan that the driver makes. A leaf leads to itself.
    """
    feature, threshold, left, right, share, roots = [], [], [], [], [], []

    def node(n, depth: int) -> tuple[int, int]:
        """The number of the node, and how many steps lead to its farthest leaf."""
        at = len(feature)
        for x, start in ((feature, 0), (threshold, "Infinity"), (left, at), (right, at), (share, 0)):
            x.append(start)
        if n.getClass().getSimpleName() == "LeafNode":
            stats = list(n.impurityStats().stats())
            share[at] = f"{stats[1] / max(sum(stats), 1e-9):.6f}"
            return at, depth
        split = n.split()
        feature[at], threshold[at] = split.featureIndex(), repr(split.threshold())
        (left[at], a), (right[at], b) = node(n.leftChild(), depth + 1), node(n.rightChild(), depth + 1)
        return at, max(a, b)

    steps = 1
    for t in model.trees:
        root, depth = node(t._call_java("rootNode"), 0)
        roots.append(root)
        steps = max(steps, depth)
    array = lambda x, kind: f"cast(split('{' '.join(map(str, x))}', ' ') as array<{kind}>)"
    step = f"if({f}[{array(feature, 'int')}[k]] <= {array(threshold, 'double')}[k], {array(left, 'int')}[k], {array(right, 'int')}[k])"
    leaf = f"aggregate(sequence(1, {steps}), r, (k, _) -> {step})"
    return f"aggregate({array(roots, 'int')}, 0D, (s, r) -> s + {array(share, 'double')}[{leaf}]) / {len(roots)}"


def scan(docs: DataFrame, detector: Detector, text_col: str = "text", path_col: str | None = None, threshold: float = 0.5) -> DataFrame:
    """Adds to every row: n_candidates, n_secrets, findings and redacted_text.

    Candidates are values behind a secret word and a sign, passwords in addresses, values of 8 characters or more in
    quotes, and runs of 16 or more of which dots join the parts. Each occurrence is judged with its own neighbouring
    words; a value is a secret if any is. ``n_candidates`` counts distinct values. ``findings`` lists the secrets: start
    (0-based, in characters, of the first occurrence judged so), length, value_sha256, score (the highest).
    ``redacted_text`` has every occurrence of a secret that is no part of a longer word or number replaced by
    ``<SECRET>``; a null text stays null and has no findings. Columns of these names that ``docs`` has already are
    replaced; other columns stay, whatever their names. Whole texts of any length are read; repeated rows are scanned
    each; an empty table gives no rows.
    """
    text = f"`{text_col}`"
    path = f"coalesce(cast(`{path_col}` as string), '')" if path_col else "''"
    before = f"substring(_t, greatest(1, o.start + 1 - {NEIGHBOURS}), least(o.start, {NEIGHBOURS}))"
    keep = [c for c in docs.columns if c not in ("n_candidates", "n_secrets", "findings", "redacted_text")]
    # the columns of the row stand in one struct, so that none clashes with a name used here
    t = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row"), F.expr(f"cast({text} as string)").alias("_t"), F.expr(path).alias("_path"))
    # one pass of the pattern marks the values; what stands between the marks gives their places
    marked = F.regexp_replace(F.translate(F.coalesce("_t", F.lit("")), "\u0001", " "), F.lit(CANDIDATE), F.lit(_MARKED))
    t = t.withColumn("_p", F.split(marked, "\u0001"))
    t = t.withColumn("_o", F.expr("filter(aggregate(_p, named_struct('at', 0L, 'k', 0, 'o', cast(array() as array<struct<value: string, start: bigint>>)), (a, x) -> named_struct('at', a.at + length(x), 'k', a.k + 1, 'o', if(a.k % 2 = 1, concat(a.o, array(named_struct('value', x, 'start', a.at))), a.o)), a -> a.o), o -> o.value <> '')"))
    t = t.withColumn("_f", F.expr(f"transform(_o, o -> named_struct('value', o.value, 'start', o.start, 'f', {features('o.value', before, '_path', detector.language)}))"))
    t = t.withColumn("_s", F.expr(f"transform(_f, x -> named_struct('value', x.value, 'start', x.start, 'score', transform(array(x.f), f -> {forest_sql(detector.forest)})[0]))"))
    t = t.withColumn("_s", F.expr(f"filter(_s, x -> x.score >= {threshold}D)"))
    t = t.withColumn("_s", F.expr("transform(array_distinct(transform(_s, x -> x.value)), v -> transform(array(filter(_s, x -> x.value = v)), a -> named_struct('value', v, 'start', a[0].start, 'score', array_max(transform(a, x -> x.score))))[0])"))
    quoted = r"concat(if(regexp_like(v, r'^[A-Za-z0-9]'), r'(?<![A-Za-z0-9])', ''), r'\Q', replace(v, r'\E', r'\E\\E\Q'), r'\E', if(regexp_like(v, r'[A-Za-z0-9]$'), r'(?![A-Za-z0-9])', ''))"
    return t.select(
        *(F.col(f"_row.`{c}`") for c in keep),
        F.size(F.array_distinct(F.transform("_o", lambda o: o["value"]))).cast("bigint").alias("n_candidates"),
        F.size("_s").cast("bigint").alias("n_secrets"),
        F.expr("transform(_s, x -> named_struct('start', x.start, 'length', cast(length(x.value) as bigint), 'value_sha256', sha2(x.value, 256), 'score', round(x.score, 6)))").alias("findings"),
        # longer values first, so that a value inside another is not cut out of it
        F.expr(f"case when _t is null or size(_s) = 0 then _t else aggregate(array_sort(transform(_s, x -> x.value), (a, b) -> length(b) - length(a)), _t, (acc, v) -> regexp_replace(acc, {quoted}, '<SECRET>')) end").alias("redacted_text"),
    )
