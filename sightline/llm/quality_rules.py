"""Quality rules in DataFrame functions alone: per-document counts and cross-document line frequency.

A host's documents count once each in a line's frequency however often they are copied: exact copies are one document
here, as else every group of more than LINE_TEXTS copies would lose all of its lines, the clean original with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SPACE = r"[\x20\x09-\x0D]"
#: A line, of any length, that stands in more than so many different documents of a host is boilerplate.
LINE_TEXTS = 25
#: A document is depleted if boilerplate holds over this share of its words, in per cent.
DEPLETED = 80
#: Hashes of boilerplate lines that are broadcast; more of them are joined, and split by salt.
BROADCAST_ROWS, SALTS = 1_000_000, 32


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def repeat_words(wins: Column) -> Column:
    """Words in windows of three that stand twice or more, from the windows' hashes in order."""
    tagged = F.array_sort(F.transform(wins, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    pairs = F.zip_with(tagged, F.slice(tagged, 2, F.greatest(F.size(wins) - 1, F.lit(1))), lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])))
    at = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
    held = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    total = F.aggregate(at, held, lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"])
    return F.when(F.size(F.array_distinct(wins)) == F.size(wins), 0).otherwise(total)


def base_counts(text: Column) -> list[tuple[str, Column]]:
    """Steps of columns, each named, that end in the base counts of a whole text."""
    n, h = F.size("_words"), F.col("_hashes")
    wins = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    return [
        ("_words", words_of(text)), ("_hashes", F.transform("_words", lambda w: F.xxhash64(w))), ("_wins", wins),
        ("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))),
        ("n_words", n.cast("long")), ("word_chars", F.char_length(F.array_join("_words", "")).cast("long")),
        ("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")),
        ("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")),
        ("n_repeat_words", repeat_words(F.col("_wins")).cast("long")),
    ]


def keyed(docs: DataFrame) -> DataFrame:
    """_row (all columns of docs), _id, _text and _host without nulls, _key of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), text.alias("_text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_host"), F.xxhash64(text).alias("_key"))


def removed_lines(docs: DataFrame, line_texts: int = LINE_TEXTS) -> DataFrame:
    """g_doc, g_host, g_key, removed_at, removed_words: the places (from 0) and words of the boilerplate lines of every
    text that has any. Lines are lower-cased, white space is one space, digits are one zero. The host is the source
    (null: one host of its own)."""
    d = keyed(docs).select("_id", "_host", "_key", F.posexplode(F.split("_text", "\n")).alias("pos", "raw"))
    d = d.withColumn("plain", F.trim(F.regexp_replace(F.lower("raw"), SPACE + "+", " "))).where("plain <> ''")
    words = F.char_length("plain") - F.char_length(F.replace("plain", F.lit(" "), F.lit(""))) + 1
    lines = written(d.select("_id", "_host", "_key", "pos", F.xxhash64("_host", F.regexp_replace("plain", "[0-9]+", "0")).alias("line"), words.alias("n")))
    often = written(lines.select("line", "_key").distinct().groupBy("line").agg(F.count("*").alias("texts")).where(F.col("texts") > line_texts).select("line"))
    if often.count() <= BROADCAST_ROWS:
        gone = lines.join(F.broadcast(often), "line")
    else:
        often = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        gone = lines.withColumn("salt", F.pmod(F.xxhash64("_id", "_key", "pos"), F.lit(SALTS)).cast("int")).join(often, ["line", "salt"])
    gone = gone.select("_id", "_host", "_key", "pos", "n").distinct()
    return gone.groupBy(F.col("_id").alias("g_doc"), F.col("_host").alias("g_host"), F.col("_key").alias("g_key")).agg(F.collect_list("pos").alias("removed_at"), F.sum("n").alias("removed_words"))


def rated(docs: DataFrame, gone: DataFrame, depleted: int = DEPLETED, whole: bool = True) -> DataFrame:
    """_row (the row of docs, or its doc_id alone), the base counts, base_failed, kept, removed_words and removed_at (null:
    no line) of each row."""
    d = keyed(docs)
    for name, column in base_counts(F.col("_text")):
        d = d.withColumn(name, column)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    d = d.select("_row" if whole else F.struct(F.col("_id").alias("doc_id")).alias("_row"), "_id", "_host", "_key", *counts)
    d = d.join(gone, F.col("_id").eqNullSafe(F.col("g_doc")) & (F.col("_host") == F.col("g_host")) & (F.col("_key") == F.col("g_key")), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    removed = F.coalesce("removed_words", F.lit(0)).cast("long")
    d = d.select("_row", *counts, failed.alias("base_failed"), removed.alias("removed_words"), "removed_at")
    # one condition over both sides of the join: a part of it alone would be pushed below and compute the counts again
    return d.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(100 * F.col("removed_words") <= depleted * F.col("n_words")))


def quality_rules(docs: DataFrame, line_texts: int = LINE_TEXTS, depleted: int = DEPLETED) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, the base counts, base_failed, kept and removed_words, a row each.

    Null and empty texts have no words and fail. Repeated rows give equal rows; a null doc_id stays null; other columns
    of docs don't matter, whatever their names; an empty table gives no rows."""
    d = rated(docs, removed_lines(docs, line_texts), depleted, whole=False)
    return d.select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def cleaned(docs: DataFrame, line_texts: int = LINE_TEXTS, depleted: int = DEPLETED) -> DataFrame:
    """The rows of docs that the rules keep, with their columns; boilerplate lines are cut from the texts and n_chars, if
    there is one, counts anew. Each row is judged by itself, also where its doc_id is null or repeated."""
    d = rated(docs, removed_lines(docs, line_texts), depleted).where("kept")
    lines = F.split("_row.text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "removed_at")
    text = F.when(F.col("removed_at").isNull(), F.col("_row.text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    d = d.withColumn("_rebuilt", text)
    own = {"text": F.col("_rebuilt"), "n_chars": F.char_length("_rebuilt")}
    kinds = docs.schema
    return d.select([(own[c].cast(kinds[c].dataType) if c in own else F.col("_row").getField(c)).alias(c) for c in docs.columns])


QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
v AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM v) WHERE c > 1),
t AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (SELECT unnest([0, 1, 2]) AS j) GROUP BY 1),
l AS (SELECT doc_id, source, text, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS x FROM d)),
k AS (SELECT doc_id, source, text, len(string_split(line, ' ')) AS n, regexp_replace(line, '[0-9]+', '0', 'g') AS line FROM l WHERE line <> ''),
o AS (SELECT source, line FROM k GROUP BY 1, 2 HAVING count(DISTINCT text) > {LINE_TEXTS}),
g AS (SELECT doc_id, sum(n) AS n FROM k JOIN o USING (source, line) GROUP BY 1),
b AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars,
  (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
  coalesce(t.n, 0)::BIGINT AS n_repeat_words, coalesce(g.n, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN t USING (doc_id) LEFT JOIN g USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * removed_words <= {DEPLETED} * n_words AS kept FROM b
"""
