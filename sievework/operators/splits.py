"""Reproducible splits and samples.

A split is a long table (experiment, fold, held_out, sample_id, role). The order of a shuffle is the SHA-256 of seed,
fold and id, so a split depends neither on partitioning nor on row order, and SQL can make the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text as T


def stratum(columns: list[str]) -> Column:
    """The columns joined by ``_``; null is ``_unknown``."""
    return F.concat_ws("_", *(F.coalesce(F.col(c).cast("string"), F.lit("_unknown")) for c in columns))


#: Hexadecimal digits of the hash by which rows are counted before they are numbered: at most 16 ** DIGITS parts.
DIGITS = 3


def _numbered(df: DataFrame, partition: list[str], seed: int | str, *more: Column) -> DataFrame:
    """Adds _r, the number of a row (from 1) within its partition by the seeded hash, then id.

    A partition is cut into ranges of the hash, which are counted and numbered apart: a few large strata or folds are
    sorted by many tasks. The offsets are 16 ** DIGITS rows for each partition.
    """
    key = T.hash_rank_key(seed, *more, F.col("sample_id"))
    d = df.withColumn("_key", key).withColumn("_part", F.substring("_key", 1, DIGITS))
    n = d.groupBy(*partition, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*partition).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = n.select(*partition, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*partition, "_part").orderBy("_key", "sample_id"))
    return d.withColumn("_i", within).join(offset, [*partition, "_part"]).withColumn("_r", F.col("_before") + F.col("_i")).drop("_key", "_part", "_i", "_before")


def _first(df: DataFrame, n: int, seed: int) -> DataFrame:
    """The ids of the first n rows by the seeded hash: all of the ranges of the hash before the one in which the n-th lies, and the first of that range."""
    d = df.select("sample_id", T.hash_rank_key(seed, F.col("sample_id")).alias("_key")).withColumn("_part", F.substring("_key", 1, DIGITS))
    below = 0
    for part, size in sorted(tuple(r) for r in d.groupBy("_part").agg(F.count("*")).collect()):  # at most 16 ** DIGITS rows
        if below + size >= n:
            last = d.where(F.col("_part") == part).orderBy("_key", "sample_id").limit(n - below)
            return d.where(F.col("_part") < part).select("sample_id").unionByName(last.select("sample_id"))
        below += size
    return d.select("sample_id")


def without_categories(df: DataFrame, excluded: list[str] | None) -> DataFrame:
    """Drops injections of the categories; benign rows and rows without a category stay."""
    return df.where((F.col("label") == 0) | ~F.coalesce(F.col("attack_category").isin(*excluded), F.lit(False))) if excluded else df


def stratified_kfold(df: DataFrame, n_folds: int = 5, stratify_by: list[str] | None = None, seed: int = 42, excluded: list[str] | None = None) -> DataFrame:
    """Each row tests in one fold and trains in the others; strata are dealt evenly. Returns only test rows (sample_id, fold): train is the rest.

    ValueError for fewer rows than folds or fewer than two labels.
    """
    d = without_categories(df, excluded)
    facts = d.agg(F.count("*"), F.count_distinct("label")).first()
    if facts[0] < n_folds:
        raise ValueError(f"{facts[0]} rows for {n_folds} folds")
    if facts[1] < 2:
        raise ValueError("stratified folds need two classes")
    key = stratum(stratify_by or ["label", "attack_category"]).alias("stratum")
    return _numbered(d.select("sample_id", key), ["stratum"], seed).select("sample_id", ((F.col("_r") - 1) % n_folds).cast("int").alias("fold"))


def leave_one_out(df: DataFrame, min_samples: int = 200, benign_share: float = 0.2, seed: int = 42, train_only: tuple[str, ...] = ()) -> DataFrame:
    """A fold for each category of at least ``min_samples`` injections, in order of name.

    Test: the category's injections and a share of the benign rows, shuffled anew for each fold (at least one). Train:
    every other injection, with those of no category, and the rest of the benign rows. ValueError without such a category.
    """
    big = df.where("label = 1 and attack_category is not null").groupBy("attack_category").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples)
    names = sorted(r[0] for r in big.select("attack_category").collect() if r[0] not in train_only)
    if not names:
        raise ValueError("no category is large enough")
    folds = F.explode(F.array(*(F.struct(F.lit(i).alias("fold"), F.lit(c).alias("held_out")) for i, c in enumerate(names))))
    n_benign = df.where("label = 0").count()
    n_test = max(1, int(n_benign * benign_share))
    d = df.select("sample_id", "label", "attack_category", folds.alias("f")).select("sample_id", "label", "attack_category", "f.*")
    benign = _first_of_each(d.where("label = 0").select("fold", "held_out", "sample_id"), "fold", n_test, seed)
    inj = d.where("label = 1").select("fold", "held_out", "sample_id", F.when(F.col("attack_category").eqNullSafe(F.col("held_out")), "test").otherwise("train").alias("role"))
    return inj.unionByName(benign.select("fold", "held_out", "sample_id", F.when(F.col("_first"), "test").otherwise("train").alias("role")))


def _first_of_each(df: DataFrame, by: str, n: int, seed: int) -> DataFrame:
    """Adds _first: whether a row is among the first n of its group by the hash of seed, group and id.

    Counts by ranges of the hash tell in which range the n-th row of a group lies; only the rows of that range are
    sorted, and the other rows stay where they are.
    """
    key = T.hash_rank_key(seed, F.col(by), F.col("sample_id"))
    d = df.withColumn("_key", key).withColumn("_part", F.substring("_key", 1, DIGITS))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    cut = counts.where(F.col("_before") < n).groupBy(by).agg(F.max_by(F.struct(F.col("_part").alias("_cut"), (F.lit(n) - F.col("_before")).alias("_left")), "_part").alias("_c")).select(by, "_c.*")
    d = d.join(F.broadcast(cut), by)  # a row for each group
    last = d.where(F.col("_part") == F.col("_cut")).withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy("_key", "sample_id")))
    rest = d.where(F.col("_part") != F.col("_cut")).withColumn("_first", F.col("_part") < F.col("_cut"))
    both = rest.unionByName(last.withColumn("_first", F.col("_i") <= F.col("_left")).drop("_i"))
    return both.drop("_key", "_part", "_cut", "_left")


def _benign(df: DataFrame, share: float, seed: int) -> DataFrame:
    """Roles of benign rows: the first by hash test, found by counts of ranges of the hash."""
    n = df.count()
    if not n:
        return df.select("sample_id", F.lit("train").alias("role"))
    test = _first(df, max(1, int(n * share)), seed).withColumn("_t", F.lit(True))
    return df.select("sample_id").join(test, "sample_id", "left").select("sample_id", F.when(F.col("_t"), "test").otherwise("train").alias("role"))


def direct_indirect(df: DataFrame, benign_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Test: indirect injections and a share of the benign rows. An unknown is_indirect is direct. ValueError without indirect injections."""
    inj = df.where("label = 1").select("sample_id", F.when(F.coalesce("is_indirect", F.lit(False)), "test").otherwise("train").alias("role"))
    if inj.where("role = 'test'").isEmpty():
        raise ValueError("no indirect injections")
    return inj.unionByName(_benign(df.where("label = 0"), benign_share, seed))


def crosslingual(df: DataFrame, benign_share: float = 0.2, seed: int = 42, home: str = "en") -> DataFrame:
    """Test: all rows of other or no language, and a share of the benign rows of the home language. ValueError without other languages."""
    is_home = F.col("language").eqNullSafe(F.lit(home))
    away = df.where(~is_home)
    if away.isEmpty():
        raise ValueError("no other language")
    out = away.select("sample_id", F.lit("test").alias("role")).unionByName(df.where(is_home & (F.col("label") == 1)).select("sample_id", F.lit("train").alias("role")))
    return out.unionByName(_benign(df.where(is_home & (F.col("label") == 0)), benign_share, seed))


def categories_left(df: DataFrame, least: int = 200, excluded: tuple[str, ...] = ("other",)) -> DataFrame:
    """Categories of the injections that are neither excluded nor large enough to be held out: they only train."""
    n = df.where("label = 1 and attack_category is not null").groupBy("attack_category").agg(F.count("*").alias("n"))
    return n.where((F.col("n") < least) & ~F.col("attack_category").isin(*excluded))


def locked_splits(df: DataFrame, least: int = 200, excluded: tuple[str, ...] = ("other",), train_only: tuple[str, ...] = ()) -> DataFrame:
    """All four experiments without the excluded categories, each row with a SHA-256 over the number and the hashes of its fold's and role's ids, which locks the split.

    The folds of the cross-validation are stratified by label alone; categories of ``train_only`` are never held out.
    ValueError if a row both trains and tests in a fold.
    """
    s = all_splits(without_categories(df, list(excluded)), least, ["label"], train_only)
    both = overlap(s.withColumn("fold", F.concat_ws("_", "experiment", "fold"))).where("in_both > 0")
    if not both.isEmpty():
        raise ValueError("train and test are not disjoint")
    keys = ["experiment", "fold", "role"]
    one = F.conv(F.substring(F.sha2(F.col("sample_id").cast("string"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    lock = s.groupBy(*keys).agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum(one).cast("string")), 256).alias("lock"))
    return s.join(lock, keys).select("experiment", "fold", "held_out", "sample_id", "role", "lock")


def plot_sample(df: DataFrame, most: int = 8000, seed: int = 42) -> DataFrame:
    """At most ``most`` rows without replacement, by hash: enough points for a plot."""
    return df.join(_first(df, most, seed), "sample_id", "left_semi")


def fold_roles(test_folds: DataFrame, n_folds: int) -> DataFrame:
    """Long form (fold, sample_id, role) of k-fold test rows."""
    each = F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))
    return test_folds.select("sample_id", F.col("fold").alias("_own"), each.alias("fold")).select("fold", "sample_id", F.when(F.col("fold") == F.col("_own"), "test").otherwise("train").alias("role"))


def overlap(split: DataFrame) -> DataFrame:
    """For each fold: train and test sizes, and how many ids are in both (0 for a sound split)."""
    per = split.groupBy("fold", "sample_id").agg(F.count_if(F.col("role") == "train").alias("a"), F.count_if(F.col("role") == "test").alias("b"))
    return per.groupBy("fold").agg(F.count_if(F.col("a") > 0).alias("n_train"), F.count_if(F.col("b") > 0).alias("n_test"), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("in_both"))


def test_union(split: DataFrame) -> DataFrame:
    """Ids that test in any fold, once each."""
    return split.where("role = 'test'").select("sample_id").distinct()


def split_counts(split: DataFrame, df: DataFrame) -> DataFrame:
    """For each experiment, fold and role: rows, and how many are injections."""
    return split.join(df.select("sample_id", "label"), "sample_id").groupBy("experiment", "fold", "role").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_injections"))


def all_splits(df: DataFrame, min_samples: int = 150, stratify_by: list[str] | None = None, train_only: tuple[str, ...] = ()) -> DataFrame:
    """All four experiments in one table; those a table cannot support are left out, except the folds."""
    out = fold_roles(stratified_kfold(df, stratify_by=stratify_by), 5).select(F.lit("standard_cv").alias("experiment"), "fold", F.lit(None).cast("string").alias("held_out"), "sample_id", "role")
    for name, make in (("leave_out", lambda: leave_one_out(df, min_samples, train_only=train_only)), ("direct_indirect", lambda: direct_indirect(df)), ("crosslingual", lambda: crosslingual(df))):
        try:
            part = make()
        except ValueError:
            continue
        fold = F.col("fold") if "fold" in part.columns else F.lit(0)
        held = F.col("held_out") if "held_out" in part.columns else F.lit(None).cast("string")
        out = out.unionByName(part.select(F.lit(name).alias("experiment"), fold.cast("int").alias("fold"), held.alias("held_out"), "sample_id", "role"))
    return out


def stratified_sample(df: DataFrame, n: int, seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """Exactly min(n, rows) ids: each stratum gives its rounded share (half to even, at least one), then the sample is cut or filled by hash."""
    d = df.select("sample_id", stratum(keys or ["label", "attack_category"]).alias("stratum"))
    sizes = d.groupBy("stratum").agg(F.count("*").alias("size"))
    pool = sizes.agg(F.sum("size").alias("pool"))
    quota = sizes.crossJoin(F.broadcast(pool)).select("stratum", F.least("size", F.greatest(F.lit(1).cast("bigint"), F.bround(F.col("size") * float(n) / F.col("pool")).cast("bigint"))).alias("quota"))
    r = _numbered(d, ["stratum"], seed).join(quota, "stratum")
    first = F.when(F.col("_r") <= F.col("quota"), 0).otherwise(1)
    return r.orderBy(first, T.hash_rank_key(seed, F.col("sample_id")), "sample_id").limit(n).select("sample_id", "stratum")


def holdout(df: DataFrame, share: float = 0.1, least: int = 10, seed: int = 42) -> DataFrame:
    """The first max(share, least) rows of a seeded shuffle are for calibration."""
    n = max(int(df.count() * share), least)
    cal = _first(df, n, seed).withColumn("_c", F.lit(True))
    return df.join(cal, "sample_id", "left").withColumn("calibration", F.coalesce("_c", F.lit(False))).drop("_c")
