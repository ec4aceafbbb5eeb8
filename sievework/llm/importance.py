"""Target-distribution importance resampling (operator 12).

Documents are drawn in proportion to how much likelier a target's bag of hashed word runs is than the corpus's own
(Gumbel top-k over log importance weights). Texts are worked on by blocks of words. Each block has a dictionary that
maps its distinct words to integer ids; a run of words is a tuple of ids, itself named by an integer; the bytes of each
distinct tuple are hashed once, as the continuation of the hash of the tuple before its last word; and the counts of
the tuples are joined back to buckets, or the buckets to the texts. Nothing but 10,000 counts for each task is shuffled:
one dictionary for the whole corpus would send every word and every run of words over the network.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import arrays
from sievework.llm.shared import Scratch, crc32_sql, distinct_names, numbered, written

BUCKETS = 10_000
#: Words of the longest runs.
LONGEST = 3
#: Words whose dictionary is made at once; longer texts go through several.
CHUNK_WORDS = 1 << 18


def _words(block: arrays.Block) -> tuple[arrays.Block, arrays.Words]:
    low = block.lowered()
    d = low.data
    return low, arrays.words(low, (d >= 0x80) | ((d - np.uint8(48)) < 10) | ((d - np.uint8(97)) < 26))


def tuples(low: arrays.Block, w: arrays.Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For chunks of words and each length of runs: the text of each run that starts in the chunk, its tuple's number, and the bucket of each tuple."""
    h = arrays.span_hashes(low.data, w.start, w.end)
    raw = memoryview(low.data)
    for a in range(0, len(h), CHUNK_WORDS):
        n, to = min(CHUNK_WORDS, len(h) - a), min(a + CHUNK_WORDS + LONGEST - 1, len(h))
        doc = w.doc[a:to]
        _, first, ids = np.unique(h[a:to], return_index=True, return_inverse=True)
        spelled = [bytes(raw[s:e]) for s, e in zip(w.start[a + first].tolist(), w.end[a + first].tolist(), strict=True)]
        tails = [b" " + s for s in spelled]
        start, name, crc = np.arange(n), ids[:n], np.fromiter(map(crc32, spelled), np.int64, len(spelled))
        yield doc[start], name, crc % BUCKETS
        for k in range(1, LONGEST):
            run = start + k < len(ids)
            run[run] = doc[start[run]] == doc[start[run] + k]
            start, name = start[run], name[run]
            pairs, name = np.unique(name * len(spelled) + ids[start + k], return_inverse=True)
            head, last = np.divmod(pairs, len(spelled))
            crc = np.fromiter(map(crc32, map(tails.__getitem__, last.tolist()), crc[head].tolist()), np.int64, len(pairs))
            yield doc[start], name, crc % BUCKETS


def bucket_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; buckets without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for block in arrays.blocks(batch.column(0)):
                for _, name, bucket in tuples(*_words(block)):
                    count = np.bincount(name, minlength=len(bucket))
                    total += np.bincount(bucket, weights=count, minlength=BUCKETS).astype(np.int64)
            arrays.trim()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    each = texts.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> np.ndarray:
    """What a feature of each bucket adds to a weight, in thousandths, from the ``bucket_counts`` of both sides.

    floor(1000 * ln((t + 1) * (S + BUCKETS) / ((s + 1) * (T + BUCKETS)))) in doubles.
    """
    s, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for counts, side in ((source, s), (target, t)):
        for r in counts.collect():  # at most BUCKETS rows
            side[r.bucket] = r.n
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) for every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = (np.zeros(len(batch), np.int64) for _ in range(3))
            for block in arrays.blocks(batch.column(1)):
                here = slice(block.first, block.first + len(block))
                low, w = _words(block)
                n_words[here] = np.diff(w.bounds)
                for doc, name, bucket in tuples(low, w):
                    if not len(doc):
                        continue
                    # runs are in the order of their texts
                    head = np.flatnonzero(np.diff(doc, prepend=-1))
                    weight[block.first + doc[head]] += np.add.reduceat(gain[bucket][name], head)
                    n_features[block.first + doc[head]] += np.diff(np.append(head, len(doc)))
            arrays.trim()
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, weight))], names=["id", "n_words", "n_features", "weight"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Every row's id, n_words, n_features, weight, score, and its rank (from 1) if it is drawn, else null.

    Words are runs of ASCII digits, letters (A-Z lower-cased) and all characters beyond ASCII; features are all runs of
    1 to 3 words, repeats counted. The weight is the sum of ``gains`` over a row's features, the score adds Gumbel noise
    from the SHA-256 of ``seed:id``. Of the N rows with ``least_words`` words or more, floor(percent * N / 100) of the
    highest scores are drawn, ties to the smaller id.

    Null and empty texts have no features and a weight of 0; a null id is hashed as an empty text and stands behind others
    in ties; rows that repeat an id are drawn each for itself, in any order among rows of one id and score. An empty table gives no rows,
    an empty target gains from its added counts alone. Texts of any length are read whole, in chunks of words; other
    columns are not read. An id column of the name of another column of the result is an error. Words of a chunk are told apart by 64-bit hashes.
    """
    distinct_names(id_col, "n_words", "n_features", "weight", "score", "rank")
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
        h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
        noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
        weighed = written(weigh(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + noise), "weighed")
        n = weighed.where(F.col("n_words") >= least_words).count()
        drawn = percent * n // 100
        able = F.when(F.col("n_words") >= least_words, 0).otherwise(1)
        places = numbered(weighed, able.asc(), F.col("score").desc(), F.col("id").asc_nulls_last())
        rank = F.when((F.col("n_words") >= least_words) & (F.col("number") <= drawn), F.col("number"))
        return scratch.keep(places.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", rank.cast("bigint").alias("rank")), "resampled")


def oracle(percent: int = 5, least_words: int = 20, seed: int = 42) -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    runs = "unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]), list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))"
    return f"""with d as (select doc_id, {words} as w from documents), t as (select {words} as w from benchmark),
  df as (select doc_id, f, count(*) as n from (select doc_id, {runs} as f from d) group by 1, 2),
  tf as (select f, count(*) as n from (select {runs} as f from t) group by 1),
  b as (select f, ({crc32_sql('f')} % {BUCKETS})::bigint as bucket from (select f from df union select f from tf)),
  s as (select bucket, sum(n) as n from df join b using (f) group by 1),
  g as (select k.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select sum(n) from df) + {BUCKETS})::double / ((coalesce(s.n, 0) + 1)::double * ((select sum(n) from tf) + {BUCKETS})::double)))::bigint as gain
    from (select unnest(range({BUCKETS})) as bucket) k left join s using (bucket) left join (select bucket, sum(n) as n from tf join b using (f) group by 1) t using (bucket)),
  x as (select doc_id, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from df join b using (f) join g using (bucket) group by 1),
  y as (select doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::bigint as h from d left join x using (doc_id)),
  z as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from y),
  r as (select doc_id, row_number() over (order by score desc, doc_id) as place from z where n_words >= {least_words})
select doc_id, n_words, n_features, weight, score, case when place <= (select count(*) * {percent} // 100 from r) then place end as rank from z left join r using (doc_id)"""
