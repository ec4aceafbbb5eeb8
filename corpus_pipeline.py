"""A corpus pipeline of five stages over ``documents``.

quality classifier -> line deduplication -> n-gram Jaccard join -> secret scan -> packing. Each stage reads what the
one before kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import line_dedup, mil, packing, partenum, secret_scan
from sievework.llm.queries import table, tokenizer_path
from sievework.llm.shared import Scratch, numbered, sent, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document that line deduplication leaves with a smaller share of its word characters (in percent) is a copy and goes.
MIN_LEFT_PCT = 20


def _word_chars(column: str) -> F.Column:
    return F.length(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"[\x20\x09-\x0D]+", ""))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good stay; it learns from ``labels`` and the documents it is given. A null or empty text is one passage of no words and is judged as such; rows that repeat a doc_id are judged each."""
    model = mil.train(docs, table(spark, sf_dir, "labels"))
    return mil.classify(docs, model, keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; a document that loses more than 80 % of its word characters goes too. n_chars is counted anew.

    A null or empty text has no lines and stays as it is (n_chars 0). Of rows that repeat a doc_id, lines at the same
    place go from all or none; an empty table gives no rows.
    """
    cleaned = line_dedup.clean(docs)
    was, left = _word_chars("text"), _word_chars("cleaned_text")
    return cleaned.where((left == was) | (left * 100 >= was * MIN_LEFT_PCT)).select("doc_id", F.col("cleaned_text").alias("text"), "lang", "source", F.coalesce(F.length("cleaned_text"), F.lit(0)).cast("bigint").alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest doc_id.

    Rows are documents: of rows that repeat a doc_id, or have none, each is judged by its own text, and stands behind
    smaller ids and earlier rows. Null and empty texts are like nothing and stay.
    """
    key = "doc_id"
    if not docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        key = "_row"
        docs = numbered(written(docs.select(*COLUMNS), "rows"), F.col("doc_id").asc_nulls_last(), name=key)
    copies = partenum.near_duplicates(docs, key).where(F.col(key) != F.col("component_id")).select(key)
    return docs.join(sent(copies, copies.count()), key, "left_anti").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a placeholder; every document stays, null and empty texts as they are (n_chars 0). n_chars is counted anew."""
    found = secret_scan.scan(docs, secret_scan.trained(docs), path_col="source")
    return found.select("doc_id", F.col("redacted_text").alias("text"), "lang", "source", F.coalesce(F.length("redacted_text"), F.lit(0)).cast("bigint").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents, see sievework.llm.packing."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("secret scans", secrets), ("packing", pack)]

#: No SQL: the classifier, the forest and the tokenizer have no SQL form. tests/llm has brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again; all but the last are deleted at the end."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), "stage")
        return scratch.keep(STAGES[-1][1](spark, docs, sf_dir), "packed")
