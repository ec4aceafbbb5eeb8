"""The queries of this subpackage, by name: thin calls of its operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import importance, partenum, quality_rules, trie, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.quality_rules import apply_rules

    return apply_rules(table(spark, sf_dir, "documents"), with_text=False)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.partenum import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.mil import classify, train

    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.media import store, with_features, with_metadata

    stored = with_features(with_metadata(store(table(spark, sf_dir, "documents"))))
    return stored.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.pitman_yor import score

    return score(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.line_dedup import summarize

    return summarize(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.secret_scan import scan, trained

    docs = table(spark, sf_dir, "documents")
    found = scan(docs, trained(docs), path_col="source")
    return found.select("doc_id", "n_candidates", "n_secrets", "findings")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.warc import archive_and_read

    return archive_and_read(table(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), with_texts=False)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.pii import find, train

    docs = table(spark, sf_dir, "documents")
    return find(docs, train(docs))


OPERATORS = (
    op1_quality_rules, op2_ngram_join, op3_quality_classifier, op4_media, op5_lm_scoring, op6_packing, op7_line_dedup, op8_secrets, op9_warc, op10_bpe,
    op11_prefix_trie, op12_importance_resampling, op13_pii,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.oracle(), "op2_ngram_join": partenum.oracle(), "op9_warc": warc.oracle(),
    "op11_prefix_trie": trie.oracle(), "op12_importance_resampling": importance.oracle(),
}
