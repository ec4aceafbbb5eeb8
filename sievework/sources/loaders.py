"""Loaders: raw tables of public corpora to one schema (text, label, source, attack_category, original_category, language, is_indirect).

``order`` names the column that gives the input order, which Spark tables do not have by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.operators.dedup import keep_first
from sievework.operators.quality import check_table
from sievework.sources.lines import read_csv_lines, read_json_lines

SCHEMA = "text string, label int, source string, attack_category string, original_category string, language string, is_indirect boolean, metadata map<string,string>"


def with_splits(frames: dict[str, DataFrame], order: str = "row") -> DataFrame:
    """The splits of a corpus as one table, in the order given, with the split's name; ``order`` is then the place over all splits."""
    out = None
    for i, (name, df) in enumerate(frames.items()):
        d = df.withColumn(order, F.struct(F.lit(i).alias("split"), F.col(order).alias("row"))).withColumn("split", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def drop_metadata(df: DataFrame) -> DataFrame:
    """Later steps have no use for what only a loader knows."""
    return df.drop("metadata")


def unified(df: DataFrame, source: str, text: Column, label: Column | int, order: str, original: Column | None = None, indirect: bool = False, **metadata: Column) -> DataFrame:
    """The unified columns; ``metadata`` (the split among it, if there is one) goes into a map of texts, without nulls."""
    none = F.lit(None).cast("string")
    if "split" in df.columns:
        metadata["split"] = F.col("split")
    pairs = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in sorted(metadata.items())]
    known = F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["value"].isNotNull())) if pairs else F.create_map().cast("map<string,string>")
    return df.select(F.col(order).alias("_order"), known.alias("metadata"), text.alias("text"), (label if isinstance(label, Column) else F.lit(label)).cast("int").alias("label"), F.lit(source).alias("source"), none.alias("attack_category"), (none if original is None else original).alias("original_category"), F.lit("en").alias("language"), F.lit(indirect).alias("is_indirect"))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def _first(df: DataFrame, n: int | None) -> DataFrame:
    out = df.orderBy("_order").limit(n) if n else df
    return out.select(*COLUMNS)


def _distinct(df: DataFrame, n: int | None) -> DataFrame:
    return _first(keep_first(df, F.col("text"), "_order"), n)


def deepset(df: DataFrame, order: str = "row") -> DataFrame:
    """All rows; nothing is deduplicated."""
    return unified(df, "deepset", F.col("text"), F.col("label"), order).select(*COLUMNS)


def hackaprompt(df: DataFrame, max_samples: int | None = 5000, order: str = "row") -> DataFrame:
    """Correct prompts without an error (unknown is neither), distinct; label 1."""
    good = F.coalesce("correct", F.lit(False)) & ~F.coalesce("error", F.lit(False))
    return _distinct(unified(df.where(good), "hackaprompt", F.col("user_input"), 1, order), max_samples)


def gentel(df: DataFrame, max_samples: int | None = None, order: str = "row") -> DataFrame:
    """The cap comes first; only injections keep their subdomain."""
    d = df.orderBy(order).limit(max_samples) if max_samples else df
    return unified(d, "gentel", F.col("text"), F.col("label"), order, F.when(F.col("label") == 1, F.col("subdomain"))).select(*COLUMNS)


def pint(df: DataFrame, order: str = "row") -> DataFrame:
    """All rows are injections; the similarity, where there is one, and the split are metadata."""
    more = {"similarity": F.col("similarity").cast("double")} if "similarity" in df.columns else {}
    return unified(df, "pint", F.col("text"), 1, order, **more).select(*COLUMNS)


def open_prompt(df: DataFrame, max_samples: int | None = None, order: str = "row") -> DataFrame:
    """Each row gives an indirect injection; benign inputs are distinct. Injections come first."""
    d = df.orderBy(order).limit(max_samples) if max_samples else df
    attack = unified(d, "open_prompt", F.col("attack_input"), 1, order, F.col("attack_type"), True)
    benign = keep_first(unified(d, "open_prompt", F.col("normal_input"), 0, order), F.col("text"), "_order")
    return attack.select(*COLUMNS).unionByName(benign.select(*COLUMNS))


def dolly(df: DataFrame, max_samples: int | None = 15_000, order: str = "row") -> DataFrame:
    d = df.withColumn("_text", _strip(F.col("instruction"))).where("_text <> ''")
    context = F.coalesce(_strip(F.col("context")) != "", F.lit(False)) if "context" in df.columns else F.lit(False)
    return _distinct(unified(d, "dolly", F.col("_text"), 0, order, F.col("category"), category=F.col("category"), has_context=context), max_samples)


def alpaca(df: DataFrame, max_samples: int | None = 8000, order: str = "row") -> DataFrame:
    """Instruction, and the input on a new line where there is one."""
    ins, inp = _strip(F.coalesce("instruction", F.lit(""))), _strip(F.coalesce("input", F.lit("")))
    d = df.withColumn("_text", F.when(inp != "", F.concat_ws("\n", ins, inp)).otherwise(ins)).where("_text <> ''")
    return _distinct(unified(d, "alpaca", F.col("_text"), 0, order), max_samples)


def oasst(df: DataFrame, max_samples: int | None = 8000, order: str = "row") -> DataFrame:
    d = df.where("role = 'prompter' and lang = 'en'").withColumn("_text", _strip(F.col("text"))).where("_text <> ''")
    return _distinct(unified(d, "oasst", F.col("_text"), 0, order), max_samples)


def wildchat(df: DataFrame, max_samples: int | None = 8000, order: str = "row") -> DataFrame:
    """The first user turn of English conversations; a blank first user turn drops the conversation."""
    turn = F.try_element_at(F.filter("conversation", lambda x: x["role"] == "user"), F.lit(1))["content"]
    d = df.where("language = 'English'").withColumn("_text", _strip(turn)).where("_text <> ''")
    return _distinct(unified(d, "wildchat", F.col("_text"), 0, order), max_samples)


LOADERS = {f.__name__: f for f in (deepset, hackaprompt, gentel, pint, open_prompt, dolly, alpaca, oasst, wildchat)}


def union(frames: list[DataFrame], spark: SparkSession) -> DataFrame:
    """A bag union in the unified schema; without frames an empty table."""
    out = spark.createDataFrame([], SCHEMA)
    for f in frames:
        out = out.unionByName(f)
    return out


# ---- the same steps over a table of turns (conv_id, turn, role, text) ----


def first_turn(turns: DataFrame, role: str = "user") -> DataFrame:
    return turns.where(F.col("role") == role).groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))


def by_role(turns: DataFrame, role: str) -> DataFrame:
    """Distinct texts that are not blank, each at its first place."""
    t = turns.where(F.col("role") == role).select(F.struct("conv_id", "turn").alias("_at"), _strip(F.col("text")).alias("text")).where("text <> ''")
    return t.groupBy("text").agg(F.min("_at").alias("_at")).select("_at.*", "text")


def unpivot(turns: DataFrame) -> DataFrame:
    """Each answered user turn as label 1, and the distinct answers as label 0 at their first place."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = turns.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next"), F.lead("text").over(w).alias("answer")).where("role = 'user' and next = 'assistant'")
    first = p.groupBy(F.col("answer").alias("text")).agg(F.min(F.struct("conv_id", "turn")).alias("_at")).select("_at.*", F.lit(0).alias("label"), "text")
    return p.select("conv_id", "turn", F.lit(1).alias("label"), "text").unionByName(first)


# ---- files ----

#: Columns that a unified table must have, and their types where these matter.
REQUIRED = {"text": ("string",), "label": ("tinyint", "smallint", "int", "bigint"), "source": (), "attack_category": (), "original_category": (), "language": (), "is_indirect": ()}


def read_safely(spark: SparkSession, path: str, root: str, max_mb: int = 500, max_rows: int = 1_000_000, required: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """A Parquet table below ``root``, checked before and after it is read.

    ValueError for a path that leads out of ``root`` (by whole names of folders, after ``..`` is resolved), more than
    ``max_mb`` of files, an unreadable table, too many rows, missing columns or wrong types; FileNotFoundError if there is none.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def resolved(p: str):
        at = jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(conf)
        whole = fs.makeQualified(at)
        return fs, jvm.org.apache.hadoop.fs.Path(whole.toUri().normalize())

    (fs, at), (_, top) = resolved(path), resolved(root)
    here, inside = at, False
    while here is not None and not inside:
        inside = here.equals(top)
        here = here.getParent()
    if not inside:
        raise ValueError(f"{path} is not below {root}")
    if not fs.exists(at):
        raise FileNotFoundError(path)
    size = fs.getContentSummary(at).getLength()
    if size > max_mb * 1024 * 1024:
        raise ValueError(f"{size / 1024 / 1024:.1f} MB, more than {max_mb}")
    try:
        df = spark.read.parquet(at.toString())
    except Exception as e:
        raise ValueError(f"cannot be read: {path}") from e
    return check_table(df, REQUIRED if required is None else required, max_rows)


#: Where the unified table lies if nothing else is said.
UNIFIED = "data/processed/unified_dataset.parquet"


def read_unified(spark: SparkSession, path: str | None = None, root: str = "data") -> DataFrame:
    """The unified table, by default the one below the data folder."""
    return read_safely(spark, path or UNIFIED, root)


def read_config(path: str) -> dict:
    """A settings file, JSON or (where PyYAML is installed) YAML; an empty one has no settings."""
    import json
    from pathlib import Path

    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML settings need PyYAML") from e
        return yaml.safe_load(text) or {}
    return json.loads(text) if text.strip() else {}



def read_jsonl_log(spark: SparkSession, path: str) -> DataFrame:
    """A log of answers (sample_hash, category_slug, confidence); corrupt lines and lines without a hash are left out."""
    return read_json_lines(spark, path, "sample_hash string, category_slug string, confidence double").where("sample_hash is not null")


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of (sample_hash, correct_category); ValueError without these columns."""
    d = read_csv_lines(spark, path)
    if missing := {"sample_hash", "correct_category"} - set(d.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    return d.where(F.coalesce(_strip(F.col("correct_category")) != "", F.lit(False)))


RESULT = "experiment string, embedding string, classifier string, mean_f1 double, std_f1 double, folds array<struct<fold_id:int,held_out_category:string,train_size:bigint,test_size:bigint,metrics:map<string,struct<value:double,ci_lower:double,ci_upper:double>>>>"


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """Result files of single runs as fold rows; combined files (``all_results`` in the name) and unreadable ones are left out."""
    d = spark.read.schema(RESULT).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(folder)
    d = d.where(~F.col("_metadata.file_name").contains("all_results") & F.col("experiment").isNotNull())
    f = d.select("experiment", "embedding", "classifier", F.explode("folds").alias("x"))
    m = lambda n: F.col("x.metrics")[n]["value"].alias(n)
    return f.select("experiment", "embedding", "classifier", F.col("x.fold_id").alias("fold"), F.col("x.held_out_category").alias("held_out"), *map(m, ("f1", "accuracy", "precision", "recall", "auc_roc", "auc_pr")))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """A split file, of folds or flat, as (experiment, fold, held_out, sample_id, role)."""
    s = "experiment string, folds array<struct<train_indices:array<bigint>,test_indices:array<bigint>,held_out_category:string>>, train_indices array<bigint>, test_indices array<bigint>"
    d = spark.read.schema(s).option("multiLine", True).json(path)
    flat = F.array(F.struct("train_indices", "test_indices", F.lit(None).cast("string").alias("held_out_category")))
    d = d.select("experiment", F.posexplode(F.coalesce("folds", flat)).alias("fold", "x"))
    one = lambda c, r: d.select("experiment", "fold", F.col("x.held_out_category").alias("held_out"), F.explode(f"x.{c}").alias("sample_id"), F.lit(r).alias("role"))
    return one("train_indices", "train").unionByName(one("test_indices", "test"))


def result_grid(results: DataFrame, experiments: list[str], classifiers: list[str], embeddings: list[str]) -> DataFrame:
    """The fold rows of the given experiments, classifiers and embeddings; combinations that are missing are simply not there."""
    return results.where(F.col("experiment").isin(*experiments) & F.col("classifier").isin(*classifiers) & F.col("embedding").isin(*embeddings))


LLM_RESULT = "test_pool string, model string, metrics map<string,struct<value:double>>, cost struct<total_cost_usd:double,total_queries:bigint>"


def read_llm_results(spark: SparkSession, path: str) -> DataFrame:
    """Result files of language models as flat rows: test_pool, model, the metrics, total cost and cost a query (null without queries)."""
    d = spark.read.schema(LLM_RESULT).option("multiLine", True).json(path)
    m = lambda n: F.col("metrics")[n]["value"].alias(n)
    return d.select("test_pool", "model", *map(m, ("f1", "accuracy", "precision", "recall")), F.col("cost.total_cost_usd").alias("total_cost"), (F.col("cost.total_cost_usd") / F.nullif(F.col("cost.total_queries"), F.lit(0))).alias("cost_per_query"))


def discover_split_pairs(spark: SparkSession, folder: str) -> list[str]:
    """Folders below ``folder``, sorted, that have both a train and a test table (``train.parquet`` and ``test.parquet``)."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, todo = [], [root]
    while todo:
        here = todo.pop()
        names = {}
        for status in fs.listStatus(here):
            names[status.getPath().getName()] = status.getPath()
            if status.isDirectory() and not status.getPath().getName().endswith(".parquet"):
                todo.append(status.getPath())
        if {"train.parquet", "test.parquet"} <= set(names):
            found.append(here.toString())  # with scheme and host
    return sorted(found)
