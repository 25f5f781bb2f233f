"""Quality rules: per-text base rules, and cross-document line frequency per host.

All of it is built-in functions. Lines are normalised (A-Z lower-cased, white space collapsed)
and hashed; a line is boilerplate on a host if more than `ratio` of the host's distinct documents,
and at least `least` of them, carry it. Documents are distinct by their texts, so that copies
alone never turn prose into boilerplate; with `copies` each row is a document of its own. A null
text is no document. Boilerplate lines are removed; a document that keeps
less than `left` of its line characters is depleted and rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_col, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["doc_id", "source", "digest"]


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row, however often later expressions use them."""
    made = F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items()))))
    return df.withColumn("_made", made).select(*(c for c in df.columns if c not in columns), *(F.col(f"_made.{k}").alias(k) for k in columns))


def _lines(text: Column) -> Column:
    """The lines with a word, as they stand."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(F.translate(line, _UPPER, _LOWER), r"[\x20\x09-\x0D]+", " ")))


def base_rules(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, the counts of the base rules, and base_failed, for each row of `docs`.

    A null text has no words and no lines, so it fails. A word is in a repeated window if its
    3-word window is found twice or more in the text; windows are told apart by a 64-bit hash.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*keep, t.alias("_t"))
    df = _once(df, _w=words_col(F.col("_t")), _l=_lines(F.col("_t")), n_symbols=F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long"))
    n = F.size("_w")
    windows = F.when(n < 3, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
        F.transform(F.slice("_w", F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i"))))
    df = _once(
        df,
        _s=F.sort_array(windows),
        n_words=n.cast("long"),
        word_chars=F.length(F.array_join("_w", "")).cast("long"),
        n_dup_lines=(F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
    )
    again = F.filter("_s", lambda x, k: (x.h == F.get("_s", k + 1).h) | ((k > 0) & (x.h == F.get("_s", F.greatest(k - 1, F.lit(0))).h)))
    spots = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x.i, x.i + 1, x.i + 2))))
    df = _once(df, n_repeat_words=F.size(spots).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("digest"), "text")


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, source, digest, line, size): the hash and length of every line with a word, written down once; a null line for a document without any."""
    lines = F.transform(_lines(F.coalesce("text", F.lit(""))), lambda x: F.struct(_line_hash(x).alias("line"), F.length(x).alias("size")))
    return written(_keyed(docs).select(*_KEY, F.explode_outer(lines).alias("l")).select(*_KEY, "l.line", "l.size"), "lines")


def boilerplate(lines: DataFrame, ratio: float = 0.05, least: int = 20, copies: bool = False) -> DataFrame:
    """(source, line, n): hashes of the lines of line_table() above the limit of their host, and the distinct documents that carry them."""
    one = ["source", "digest", "doc_id"] if copies else ["source", "digest"]
    known = lines.where("digest is not null")
    texts = known.select(*one).distinct().groupBy("source").agg(F.count(F.lit(1)).alias("of"))
    found = known.where("line is not null").select(*one, "line").distinct().groupBy("source", "line").agg(F.count(F.lit(1)).alias("n"))
    found = found.where(F.col("n") >= least)
    host = texts.withColumnRenamed("source", "host")
    return found.join(host, found.source.eqNullSafe(F.col("host"))).where(F.col("n") > ratio * F.col("of")).select("source", "line", "n")


def line_verdicts(docs: DataFrame, ratio: float = 0.05, least: int = 20, copies: bool = False) -> DataFrame:
    """(doc_id, source, digest, cut, share): for documents with boilerplate, its line hashes and share of line characters."""
    lines = line_table(docs)
    often = boilerplate(lines, ratio, least, copies).select(F.col("source").alias("host"), F.col("line").alias("often"))
    hit = lines.join(often, lines.source.eqNullSafe(F.col("host")) & (lines.line == F.col("often")), "left")
    by = hit.groupBy(*_KEY).agg(F.collect_set("often").alias("cut"), (F.sum(F.when(F.col("often").isNotNull(), F.col("size"))) / F.sum("size")).alias("share"))
    return by.where(F.size("cut") > 0)


def _same(left: DataFrame, right: DataFrame):
    return left.doc_id.eqNullSafe(right.doc_id) & left.source.eqNullSafe(right.source) & (left.digest == right.digest)


def judge(docs: DataFrame, ratio: float = 0.05, least: int = 20, left: float = 0.5, copies: bool = False) -> DataFrame:
    """One row for each row of `docs` (doc_id, text, source; others ignored): base counts, base_failed, kept, removed_share.

    Null ids and hosts are values of their own; repeated rows get the same verdict; an empty
    table gives no rows.
    """
    base = base_rules(_keyed(docs), keep=("doc_id", "source", "digest"))
    lines = line_verdicts(docs, ratio, least, copies).select("doc_id", "source", "digest", "share")
    out = base.join(lines, _same(base, lines), "left").select(base["*"], F.coalesce("share", F.lit(0.0)).alias("removed_share"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("removed_share") <= 1 - left)).drop("source", "digest")


def filtered(docs: DataFrame, ratio: float = 0.05, least: int = 20, left: float = 0.5, copies: bool = False) -> DataFrame:
    """The rows of `docs` that all rules keep, all columns, with boilerplate lines cut from their texts.

    Null and empty texts fail and go. Null ids and hosts are values of their own; repeated rows stay or
    go together; texts without boilerplate stay as they are; an empty table gives no rows.
    """
    lines = line_verdicts(docs, ratio, least, copies)
    named = docs.select(F.struct("*").alias("_row"), "doc_id", "source", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("digest"), "text")
    good = base_rules(named, keep=("_row", "doc_id", "source", "digest")).where("not base_failed").select("_row", "doc_id", "source", "digest")
    kept = good.join(lines, _same(good, lines), "left").where(F.coalesce("share", F.lit(0.0)) <= 1 - left)
    rest = F.filter(F.split("_row.text", "\n"), lambda x: ~F.coalesce(F.array_contains("cut", _line_hash(x)), F.lit(False)))
    text = F.when(F.col("cut").isNull(), F.col("_row.text")).otherwise(F.array_join(rest, "\n"))
    return kept.select(*(text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def query(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same in DuckDB, with lines and windows compared as texts.
ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, text AS whole, coalesce(text, '') AS t FROM documents),
words AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
wins AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
again AS (SELECT r, k FROM wins GROUP BY r, k HAVING count(*) > 1),
repeats AS (SELECT r, count(DISTINCT q) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 3)) AS q FROM wins JOIN again USING (r, k)) GROUP BY r),
lines AS (SELECT r, line FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY r),
normed AS (SELECT r, source, whole, length(line) AS size,
    trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM lines JOIN docs USING (r)),
hosts AS (SELECT source, count(DISTINCT whole) AS n_texts FROM docs GROUP BY source),
often AS (SELECT source, line FROM (SELECT source, line, count(DISTINCT whole) AS n FROM normed GROUP BY source, line) JOIN hosts USING (source)
  WHERE n >= 20 AND n > 0.05 * n_texts),
shares AS (SELECT r, sum(CASE WHEN often.line IS NOT NULL THEN size ELSE 0 END) / sum(size) AS share
  FROM normed LEFT JOIN often ON normed.source = often.source AND normed.line = often.line GROUP BY r),
base AS (SELECT doc_id, r, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(share, 0) AS share
  FROM docs JOIN words USING (r) LEFT JOIN repeats USING (r) LEFT JOIN dups USING (r) LEFT JOIN shares USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND share <= 0.5 AS kept FROM judged
"""
