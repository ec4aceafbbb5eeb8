"""Leakage between train and test: lexical (token sets) and by vectors, and what depends on nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions.vector import cosine
from sievework.operators.neighbours import nearest
from sievework.operators.similar import class_pairs, classes, similar_pairs
from sievework.operators.storage import materialize


def _both(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.select("sample_id", "text", F.lit(False).alias("is_test")).unionByName(test.select("sample_id", "text", F.lit(True).alias("is_test")))


def lexical(train: DataFrame, test: DataFrame, threshold: float = 0.8) -> DataFrame:
    """All pairs (test_id, train_id, jaccard) of token sets at or above the threshold; texts without tokens match nothing."""
    p = similar_pairs(_both(train, test), T.tokens(F.col("text")), threshold, across="is_test")
    return p.select(F.col("b").alias("test_id"), F.col("a").alias("train_id"), "jaccard")


def lexical_best(train: DataFrame, test: DataFrame, threshold: float = 0.8) -> DataFrame:
    """best_match of lexical, without its pairs of copies."""
    return best_match(_sided_best(train, test, threshold, ""), "jaccard")


def best_match(pairs: DataFrame, score: str) -> DataFrame:
    """The best train row of each test row; the smallest train id on ties."""
    best = F.min_by(F.struct("train_id", score), F.struct(-F.col(score), F.col("train_id"))).alias("b")
    return pairs.groupBy("test_id").agg(best).select("test_id", "b.train_id", f"b.{score}")


def semantic(train: DataFrame, test: DataFrame, threshold: float = 0.95, vector: str = "embedding") -> DataFrame:
    return nearest(train, test, vector).where(F.col("similarity") >= threshold)


def homogeneity(train: DataFrame, test: DataFrame, vector: str = "embedding") -> DataFrame:
    """The mean, over test rows, of the best similarity to train."""
    return nearest(train, test, vector).agg(F.avg("similarity").alias("homogeneity"))


def _lexical_best(known: DataFrame, links: DataFrame) -> DataFrame:
    """(split_id, test_id, train_id, jaccard): the best train row of each test row (``known``: split_id, role, sample_id, key), within its split.

    Distinct token sets are joined once for all splits (``links``: key, other, jaccard); a split then asks only which
    similar sets train in it, so neither copies of a text nor splits are multiplied into pairs.
    """
    train = known.where("role = 'train'").groupBy("split_id", F.col("key").alias("other")).agg(F.min("sample_id").alias("train_id"))
    test = known.where("role = 'test'").select("split_id", "key").distinct()
    best = F.min_by(F.struct("train_id", "jaccard"), F.struct(-F.col("jaccard"), F.col("train_id"))).alias("b")
    best = test.join(links, "key").join(train, ["split_id", "other"]).groupBy("split_id", "key").agg(best).select("split_id", "key", "b.*")
    return known.where("role = 'test'").join(best, ["split_id", "key"]).select("split_id", F.col("sample_id").alias("test_id"), "train_id", "jaccard")


def _link(pairs: DataFrame, key: str, other: str) -> DataFrame:
    return pairs.select(F.col(key).alias("key"), F.col(other).alias("other"), "jaccard")


def _sided_best(train: DataFrame, test: DataFrame, threshold: float, split_id: str) -> DataFrame:
    """The best train row of each test row of one split: only sets of different sides are compared."""
    sets = classes(_both(train, test), T.tokens(F.col("text")), "sample_id", across="is_test")
    known = sets.select(F.lit(split_id).alias("split_id"), F.when(F.col("_side"), "test").otherwise("train").alias("role"), F.col("_id").alias("sample_id"), F.col("_key").alias("key"))
    return _lexical_best(known, _link(class_pairs(sets, threshold, across=True), "y", "x"))


def _folds_best(df: DataFrame, split: DataFrame, threshold: float) -> DataFrame:
    """The best train row of each test row of every split (split_id, role, sample_id) of the rows."""
    sets = classes(df, T.tokens(F.col("text")), "sample_id")
    pairs = class_pairs(sets, threshold)
    own = sets.select(F.col("_key").alias("key")).distinct().select("key", F.col("key").alias("other"), F.lit(1.0).alias("jaccard"))
    known = sets.select(F.col("_id").alias("sample_id"), F.col("_key").alias("key")).join(split, "sample_id")
    return _lexical_best(known, own.unionByName(_link(pairs, "x", "y")).unionByName(_link(pairs, "y", "x")))


def _reports(rows: DataFrame, lex: DataFrame, cosine_at: float) -> DataFrame:
    """The report of each split of ``rows`` (split_id, role, sample_id, embedding) with its best lexical matches, all in one plan."""
    lex = materialize(lex, "lexical")
    side = lambda r: rows.where(F.col("role") == r)
    near = materialize(nearest(side("train"), side("test"), by="split_id"), "nearest")
    sem = near.where(F.col("similarity") >= cosine_at)
    flagged = lex.select("split_id", "test_id").union(sem.select("split_id", "test_id")).distinct()

    def worst(d: DataFrame, score: str) -> DataFrame:
        first = d.withColumn("_r", F.row_number().over(Window.partitionBy("split_id").orderBy(F.desc(score), "test_id"))).where("_r <= 3")
        three = F.array_sort(F.collect_list(F.struct("_r", "test_id", "train_id", F.col(score).alias("score"))))
        return first.groupBy("split_id").agg(F.transform(three, lambda x: x.dropFields("_r")).alias(f"worst_{score}"))

    out = rows.groupBy("split_id").agg(F.count_if(F.col("role") == "test").alias("n_test"), F.count_if(F.col("role") == "train").alias("n_train"))
    of = lambda d, *c: d.groupBy("split_id").agg(*c)
    n = F.count("*")
    parts = (of(lex, n.alias("lexical_flagged")), of(sem, n.alias("semantic_flagged")), of(flagged, n.alias("total_flagged")), of(near, F.avg("similarity").alias("homogeneity")), worst(lex, "jaccard"), worst(sem, "similarity"))
    for part in parts:  # a row for each split
        out = out.join(part, "split_id", "left")
    out = out.na.fill(0, ["lexical_flagged", "semantic_flagged", "total_flagged"])
    rate = F.coalesce(F.col("total_flagged") / F.nullif("n_test", F.lit(0)), F.lit(0.0))
    return out.select("*", (rate * 100).alias("flagged_rate_pct"), (rate <= 0.01).alias("passed"))


def _with_vectors(d: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """The rows with the vectors of another table (sample_id, embedding), if that is given: texts don't travel with them."""
    return d if vectors is None else d.select("sample_id").join(vectors.select("sample_id", "embedding"), "sample_id", "left")


def report(train: DataFrame, test: DataFrame, jaccard: float = 0.8, cosine_at: float = 0.95, split_id: str = "split", vectors: DataFrame | None = None) -> DataFrame:
    """One row: sizes, rows flagged by either check, their rate in percent, whether at most 1 % are flagged, homogeneity, the three worst of each kind. No row without any rows."""
    part = lambda d, role: d.select(F.lit(split_id).alias("split_id"), F.lit(role).alias("role"), "sample_id", "embedding")
    return _reports(materialize(part(_with_vectors(train, vectors), "train").unionByName(part(_with_vectors(test, vectors), "test")), "both-sides"), _sided_best(train, test, jaccard, split_id), cosine_at)


def check_all(df: DataFrame, split: DataFrame, jaccard: float = 0.8, cosine_at: float = 0.95, vectors: DataFrame | None = None) -> DataFrame:
    """The report of each experiment and fold of a split (experiment, fold, sample_id, role), one row each, from one plan; ids as ``<experiment>_<fold>``.

    Folds without train or test rows are left out; ValueError if none is left. The rows have their vectors before, so no
    text is embedded twice.
    """
    s = split.select(F.concat_ws("_", "experiment", F.col("fold").cast("string")).alias("split_id"), "role", "sample_id")
    sides = s.groupBy("split_id").agg(F.count_if(F.col("role") == "train").alias("a"), F.count_if(F.col("role") == "test").alias("b")).where("a > 0 and b > 0")
    s = materialize(s.join(sides.select("split_id"), "split_id", "left_semi"), "splits")
    rows = materialize(_with_vectors(df, vectors).select("sample_id", "embedding").join(s, "sample_id"), "split-rows")
    if rows.isEmpty():
        raise ValueError("no fold has both train and test rows")
    return _reports(rows, _folds_best(df, s, jaccard), cosine_at)


def flags(train: DataFrame, test: DataFrame, jaccard: float = 0.8, cosine_at: float = 0.95, split_id: str = "split", vectors: DataFrame | None = None) -> DataFrame:
    """One record for each flagged test row and check, with the 12-digit ids of both texts."""
    lex = lexical_best(train, test, jaccard).select("test_id", "train_id", F.lit("lexical").alias("check_type"), F.col("jaccard").alias("score"))
    found = lex.unionByName(semantic(_with_vectors(train, vectors), _with_vectors(test, vectors), cosine_at).select("test_id", "train_id", F.lit("semantic").alias("check_type"), F.col("similarity").alias("score"))) if vectors is not None or "embedding" in test.columns else lex
    key = lambda d, a, b: d.select(F.col("sample_id").alias(a), T.hash12(T.normalize(F.col("text"))).alias(b))
    return found.join(key(test, "test_id", "sample_hash"), "test_id").join(key(train, "train_id", "neighbour_hash"), "train_id").select(F.lit(split_id).alias("split_id"), "test_id", "sample_hash", "check_type", "score", "train_id", "neighbour_hash")


def centroids(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The mean vector of each category of the injections (attack_category, centroid); no, empty and ``nan`` categories are left out."""
    d = df.where("label = 1").where(F.col("attack_category").isNotNull() & ~F.lower("attack_category").isin("", "nan", "none"))
    m = d.select("attack_category", F.posexplode(vector)).groupBy("attack_category", "pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
    return m.groupBy("attack_category").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("v")).select("attack_category", F.col("v.m").alias("centroid"))


def centroid_distances(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Cosine distance of every two categories (a few); 0 on the diagonal."""
    c = centroids(df, vector)
    a, b = (c.select(F.col("attack_category").alias(n), F.col("centroid").alias(f"c{n}")) for n in "ab")
    return a.crossJoin(F.broadcast(b)).select("a", "b", F.when(F.col("a") == F.col("b"), 0.0).otherwise(1 - cosine(F.col("ca"), F.col("cb"))).alias("distance"))
