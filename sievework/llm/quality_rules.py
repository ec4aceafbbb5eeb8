"""Line-first quality rules (operator 1), in DataFrame expressions only.

Each line is judged first: by its closing punctuation, as navigation, and as boilerplate. Failing lines go. A document
is rejected if the lines that stay hold too small a part of its text, or by the rules on whole documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the rules, as regular expressions that Java and RE2 read alike.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOL = r"[^#*$%&|<>]"
CLOSED = r"""[.!?…:;"')\]»”’][\x20\x09-\x0D]*$"""
SEPARATOR = r"(?:^|[\x20\x09-\x0D])[|›»>•·](?:[\x20\x09-\x0D]|$)"
PHRASES = r"(?i)(?:accept (?:all )?cookies|privacy policy|terms of (?:use|service)|all rights reserved|enable javascript|sign up for our newsletter|lorem ipsum)"


def _sql(pattern: str) -> str:
    """A pattern as a raw string literal of Spark SQL."""
    return "r'" + pattern + "'" if "'" not in pattern else 'r"' + pattern + '"' if '"' not in pattern else "concat(" + ", \"'\", ".join("r'" + p + "'" for p in pattern.split("'")) + ")"


def line_fails(line: str, separators_pct: int = 20, symbols_pct: int = 10, capitals_pct: int = 70, capitals_least: int = 10) -> str:
    """SQL condition: the line (an SQL expression) breaks a rule."""
    count = lambda kept: f"length(regexp_replace({line}, {_sql(kept)}, ''))"
    chars, upper, lower = count(SPACES), count(r"[^\p{Lu}]"), count(r"[^\p{Ll}]")
    words = f"size(filter(split({line}, {_sql(SPACES)}), w -> w <> ''))"
    return f"""not regexp_like({line}, {_sql(CLOSED)})
        or (instr({line}, '|') + instr({line}, '›') + instr({line}, '»') + instr({line}, '>') + instr({line}, '•') + instr({line}, '·') > 0
            and 100 * regexp_count({line}, {_sql(SEPARATOR)}) >= {separators_pct} * {words})
        or 100 * {count(SYMBOL)} >= {symbols_pct} * {chars}
        or ({upper} >= {capitals_least} and 100 * {upper} > {capitals_pct} * ({upper} + {lower}))
        or regexp_like({line}, {_sql(PHRASES)})"""


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10, max_repeat_pct: int = 20, min_left_pct: int = 50, with_text: bool = True) -> DataFrame:
    """Judges every whole text; returns one row for each row of ``docs``, with the id column and

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines (lines with a word),
    n_failed_lines, left_chars (word characters in lines that stay) and, with ``with_text``, cleaned_text (the lines
    that stay). ``kept`` is false if base_failed or if 100 * left_chars < min_left_pct * word_chars. A null text counts
    as empty: zero counts, base_failed. Repeated rows are judged each; other columns are not read, whatever their names; an
    empty table gives no rows; texts of any length are judged whole, in one expression. Rows are
    independent, so nothing is shuffled; repeated 5-word windows are found by sorting 64-bit hashes within the row.
    """
    t = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    t = t.select("_id", "_text", F.expr(f"filter(split(_text, {_sql(SPACES)}), w -> w <> '')").alias("_words"), F.expr(f"filter(split(_text, '\\n'), l -> regexp_like(l, {_sql(r'[^\x20\x09-\x0D]')}))").alias("_lines"))
    t = t.withColumn("_n", F.size("_words").cast("bigint"))
    t = t.withColumn("_windows", F.expr("case when _n >= 5 then transform(sequence(0, cast(_n as int) - 5), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2], _words[i + 3], _words[i + 4])) else array() end"))
    repeated = """case when size(array_distinct(_windows)) = size(_windows) then 0L else
        transform(array(sort_array(transform(_windows, (h, i) -> struct(h as h, i as i)))), s ->
            aggregate(
                array_sort(transform(filter(s, (x, i) -> (i > 0 and s[i - 1].h = x.h) or (i + 1 < size(s) and s[i + 1].h = x.h)), x -> x.i)),
                struct(0L as total, 0 as upto),
                (a, p) -> struct(a.total + cast(p + 5 - greatest(p, a.upto) as bigint) as total, p + 5 as upto),
                a -> a.total))[0] end"""
    t = t.select(
        "_id",
        F.col("_n").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.expr(f"cast(length(regexp_replace(_text, {_sql(SYMBOL)}, '')) as bigint)").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.expr(repeated).alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.expr(f"filter(_lines, l -> not ({line_fails('l')}))").alias("_good"),
    )
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_pct)
    left = F.expr(f"cast(coalesce(length(regexp_replace(array_join(_good, ''), {_sql(SPACES)}, '')), 0) as bigint)")
    t = t.withColumn("base_failed", failed).withColumn("left_chars", left)
    return t.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("left_chars") * 100 >= F.col("word_chars") * min_left_pct)).alias("kept"),
        "n_lines", (F.col("n_lines") - F.size("_good")).alias("n_failed_lines"), "left_chars", *([F.array_join("_good", "\n").alias("cleaned_text")] if with_text else []),
    )


def oracle() -> str:
    """The same query in DuckDB's SQL, from the same fixed values."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    count = lambda kept: f"length(regexp_replace(l, {q(kept)}, '', 'g'))"
    upper, lower = count(r"[^\p{Lu}]"), count(r"[^\p{Ll}]")
    fails = f"""not regexp_matches(l, {q(CLOSED)})
        or 100 * len(regexp_extract_all(l, {q(SEPARATOR)})) >= 20 * len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+'))
        or 100 * {count(SYMBOL)} >= 10 * {count(SPACES)}
        or ({upper} >= 10 and 100 * {upper} > 70 * ({upper} + {lower}))
        or regexp_matches(l, {q(PHRASES)})"""
    return rf"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
grams as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] as g
          from (select doc_id, w, unnest(generate_series(1, len(w) - 4)) as i from d where len(w) >= 5)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from grams) where c > 1),
covered as (select doc_id, count(distinct i + k) as n from twice, (select unnest(generate_series(0, 4)) as k) group by doc_id),
lines as (select doc_id, l, {count(SPACES)} as chars, ({fails}) as fails
          from (select doc_id, unnest(string_split(text, chr(10))) as l from d) where regexp_matches(l, '[^\x20\x09-\x0D]')),
per_doc as (select doc_id, count(*) as n_lines, count(distinct l) as n_distinct, count(*) filter (fails) as n_failed, coalesce(sum(chars) filter (not fails), 0) as left_chars
            from lines group by doc_id),
counts as (select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
                  length(regexp_replace(text, {q(SYMBOL)}, '', 'g'))::bigint as n_symbols,
                  coalesce(n_lines - n_distinct, 0)::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words,
                  coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_failed, 0)::bigint as n_failed_lines, coalesce(left_chars, 0)::bigint as left_chars
           from d left join per_doc using (doc_id) left join covered using (doc_id))
select doc_id, n_words, coalesce(word_chars, 0) as word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
       (not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * left_chars >= 50 * coalesce(word_chars, 0)) as kept,
       n_lines, n_failed_lines, left_chars
from counts"""
