"""Quality rules: text statistics of a document, and the frequency of its lines across documents of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, WORD_GAP, hub_join, marked, written

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def repeated_words(w: Column) -> Column:
    """Words, of an array of them, in a window of three that the array holds twice or more.

    Windows, hashed, are sorted with their places; equal neighbours repeat.  A place covers the
    words up to the next one, three at most.  O(n log n) in the words of one text.
    """
    n = F.size(w)
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))
    return F.when(n < 4, F.lit(0)).otherwise(covered(windows))


def covered(windows: Column) -> Column:
    def places(s: Column) -> Column:
        again = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        return F.array_sort(F.transform(again, lambda x: x["i"]))

    def cover(p: Column) -> Column:
        return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    return bind(windows, lambda s: bind(places(s), cover))


def bind(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, and the lines that hold a word in _lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.withColumn("_words", words(F.col(text_col)))
        .withColumn("_lines", worded_lines(text))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace(text, WORD_GAP, "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", repeated_words(F.col("_words")).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
        .drop("_words")
    )


def host_key(host_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("h"), F.col(host_col)), F.lit("-"))


def line_key(host: Column, line: Column) -> Column:
    """A 64-bit key of a line in its host: case and the width of white space don't count."""
    return F.xxhash64(host, F.lower(F.btrim(F.regexp_replace(line, WORD_GAP, " "))))


def judged_rows(rows: DataFrame) -> DataFrame:
    """Written: the statistics of (row, doc_id, host, text), and the key and words of each line that holds a word."""
    lines = F.transform("_lines", lambda x: F.struct(line_key(F.col("host"), x).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    return written(statistics(rows.withColumns({"host": host_key("host"), "row": F.monotonically_increasing_id()})).withColumn("lines", lines).drop("_lines", "text"), "quality")


def frequent_lines(table: DataFrame, min_docs: int, max_share: float, max_docs: int) -> DataFrame:
    """(line, n_docs), written: lines that too many documents of their host have."""
    doc = F.coalesce("doc_id", F.lit(-(2**63))).alias("doc")
    per_host = table.select("host", doc).distinct().groupBy("host").agg(F.count("*").alias("docs"))
    once = table.select("host", doc, F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line")).distinct()
    counts = written(once.groupBy("host", "line").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > min_docs), "line-counts")
    hosts = counts.groupBy("host").agg(F.count("*").alias("n")).join(per_host, "host")
    frequent = hub_join(counts, written(hosts, "line-hosts"), "host", "n").filter((F.col("n_docs") > F.col("docs") * max_share) | (F.col("n_docs") > max_docs))
    return written(frequent.select("line", "n_docs"), "frequent-lines")


def removed_lines(table: DataFrame, frequent: DataFrame) -> DataFrame:
    """(row, line_words, gone): words in the frequent lines of each row that has any, and the lines' keys."""
    lines = table.select("row", F.explode("lines").alias("x")).select("row", "x.*")
    return hub_join(lines, frequent, "line", "n_docs").groupBy("row").agg(F.sum("n").cast("long").alias("line_words"), F.collect_set("line").alias("gone"))


def verdict(max_removed: float) -> Column:
    return ~F.col("base_failed") & (F.col("line_words") <= F.col("n_words") * max_removed)


def remove_frequent_lines(docs: DataFrame, host_col: str = "source", min_docs: int = 20, max_share: float = 0.05, max_docs: int = 1000, max_removed: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the lines that are frequent in the host, and with line_words and kept.

    line_words are the words that went; kept is quality's verdict, on the text as it was.  Lines
    without a word stay, and a null text stays null.  Each row loses its own lines, also where rows
    repeat a doc_id; columns named line_words and kept are replaced; an empty table gives no rows.
    Only rows that lose a line move.
    """
    own = [c for c in docs.columns if c not in ("line_words", "kept")]
    rows = docs.select(F.struct(*own).alias("whole"), F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    table = judged_rows(rows)
    removed = written(removed_lines(table, frequent_lines(table, min_docs, max_share, max_docs)), "removed-lines")
    text = F.col("whole")[text_col]
    gone = lambda x: x.rlike(WORD) & F.array_contains("gone", line_key(F.col("host"), x))
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~gone(x)), "\n")
    cut = marked(table, removed, "row").join(removed, "row", "left")
    every = cut.unionByName(marked(table, removed, "row", yes=False), allowMissingColumns=True).withColumn("line_words", F.coalesce("line_words", F.lit(0).cast("long")))
    new = F.when(F.col("gone").isNotNull(), left).otherwise(text).alias(text_col)
    return every.select(*[new if c == text_col else F.col("whole")[c].alias(c) for c in own], "line_words", verdict(max_removed).alias("kept"))


def quality(docs: DataFrame, host_col: str = "source", min_docs: int = 20, max_share: float = 0.05, max_docs: int = 1000, max_removed: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, line_words, kept).

    A line is frequent if more than min_docs documents of its host have it, and more than max_share
    of them or more than max_docs.  kept: false if base_failed, or if frequent lines hold over
    max_removed of the words.  A document counts once, however often it repeats the line and in
    however many rows; rows without an id are one document.

    Null texts are empty and fail; documents without a host are a host of their own; each row has
    its own line_words; other columns are left out; an empty table gives no rows.  Texts are read
    and split once; what is counted are 64-bit keys of lines, and hot lines combine before the
    shuffle.
    """
    table = judged_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text")))
    removed = removed_lines(table, frequent_lines(table, min_docs, max_share, max_docs)).drop("gone")
    joined = table.drop("lines", "host").join(removed, "row", "left").drop("row")
    return joined.withColumn("line_words", F.coalesce("line_words", F.lit(0)).cast("long")).withColumn("kept", verdict(max_removed))


#: DuckDB SQL for the op8 query.
SQL = r"""
with d as (select row_number() over () rid, doc_id, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
ln as (select rid, doc_id, source, unnest(string_split(t, chr(10))) line from d),
lw as (select rid, doc_id, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))::bigint n,
              lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) k from ln where regexp_matches(line, '[^\x20\x09-\x0D]')),
dl as (select rid, (count(*) - count(distinct line))::bigint n_dup_lines from lw group by 1),
ho as (select source, count(distinct coalesce(doc_id, -9223372036854775808)) n_docs from d group by 1),
co as (select source, k, count(distinct coalesce(doc_id, -9223372036854775808)) c from lw group by 1, 2 having c > 20),
fr as (select co.* from co join ho on co.source is not distinct from ho.source where c > 0.05::double * n_docs or c > 1000),
rm as (select rid, sum(n)::bigint line_words from lw join fr on lw.k = fr.k and lw.source is not distinct from fr.source group by 1),
wi as (select rid, unnest(range(1, len(w) - 1)) i, w from d),
sh as (select rid, i, (w[i], w[i + 1], w[i + 2]) s from wi),
rp as (select rid, i from sh qualify count(*) over (partition by rid, s) > 1),
cv as (select rid, count(distinct p)::bigint n_repeat_words from (select rid, unnest([i, i + 1, i + 2]) p from rp) group by 1),
b as (select doc_id, len(w)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, coalesce(n_dup_lines, 0) n_dup_lines,
             coalesce(n_repeat_words, 0) n_repeat_words, coalesce(line_words, 0) line_words
      from d left join dl using (rid) left join cv using (rid) left join rm using (rid)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from b)
select *, not base_failed and line_words <= n_words * 0.5::double kept from f
"""
