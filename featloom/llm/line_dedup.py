"""Line dedup by winnowing over line hashes.

A text's units are its lines that have a word, without the space around them.  Of each
window of ``window`` unit hashes the least is selected, the last of equal ones, so that
any run of that many lines which repeats anywhere has a selected line in common with its
repeat; a line of ``long_words`` words or more is always selected.  Only selected lines
become rows, each with the windows that chose it.  A hash that stands at one place only
ends there, with its windows.  The others' windows are joined by content to their first
place in the corpus, and every line of a window that has an earlier one goes.  Windows
of a longer run overlap, which extends a match in both directions as far as it holds.

A line is deleted if it lies in ``window`` consecutive units, or is a long line, that
also stand at an earlier place: of a smaller doc_id, or further up in the same text.
Both are judged on the input.  Lines without a word stay.

Defined cases: a null text has no lines and stays null; a null doc_id comes before all
others; rows equal in doc_id and text are one document to this rule, so neither is
judged a repeat of the other; an empty table gives no rows.  A hot line is one row per
task in counts, and its rows are a left side that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.llm.common import WORDS, bind, fresh, text_key
from featloom.session import materialize

WINDOW = 3
LONG_WORDS = 50

_AROUND = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def units(text: Column) -> Column:
    """The lines with a word, trimmed, in order."""
    trimmed = F.transform(F.split(text, "\n"), lambda line: F.regexp_replace(line, _AROUND, ""))
    return F.coalesce(F.filter(trimmed, lambda line: line != ""), F.array().cast("array<string>"))


def _selected(window: int) -> Column:
    """(mark, at, windows) of the selected units, from the columns h, g and is_long.

    A window is (at, length, k1, k2): where it starts, its units, and 128 bits of them.
    """
    kind = "array<struct<at:int,length:int,k1:bigint,k2:bigint>>"
    n = F.size("h")
    starts = F.when(n >= window, F.sequence(F.lit(0), n - window)).otherwise(F.array().cast("array<int>"))

    def chosen(i: Column) -> Column:
        """The window at i, and its least hash's last place."""
        least = F.least(*[
            F.struct(F.get(F.col("h"), i + j).alias("h"), (-(i + j)).alias("at")) for j in range(window)
        ])
        return F.struct(
            (-least["at"]).alias("by"),
            F.struct(
                i.alias("at"), F.lit(window).alias("length"),
                F.xxhash64(*[F.get(F.col("h"), i + j) for j in range(window)]).alias("k1"),
                F.xxhash64(F.lit(1), *[F.get(F.col("g"), i + j) for j in range(window)]).alias("k2"),
            ).alias("window"),
        )

    def mark(h: Column, p: Column, spans: Column, long: Column) -> Column:
        around = F.slice(spans, F.greatest(p - window + 1, F.lit(0)) + 1, F.lit(window))
        own = F.transform(F.filter(around, lambda s: s["by"] == p), lambda s: s["window"])
        single = F.array(F.struct(
            p.alias("at"), F.lit(1).alias("length"), h.alias("k1"), F.get(F.col("g"), p).alias("k2")
        ))
        alone = F.when(F.get(long, p), single).otherwise(F.array().cast(kind))
        return F.struct(h.alias("mark"), p.alias("at"), F.concat(own, alone).cast(kind).alias("windows"))

    if window == 1:
        spans, long = F.array().cast(f"array<struct<by:int,window:{kind[6:-1]}>>"), F.transform("h", lambda h: F.lit(True))
    else:
        spans, long = F.transform(starts, chosen), F.col("is_long")
    marks = bind(spans, lambda s: bind(long, lambda l: F.transform("h", lambda h, p: mark(h, p, s, l))))
    return F.filter(marks, lambda m: F.size(m["windows"]) > 0)


def repeats(documents: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, text_key, removed): numbers, from 0, of the units to delete."""
    lines = documents.select("doc_id", text_key(F.col("text")).alias("text_key"), units(F.col("text")).alias("u"))
    lines = lines.where(F.size("u") > 0)
    hashed = lines.select(
        "doc_id", "text_key",
        F.transform("u", lambda x: F.xxhash64(x)).alias("h"),
        F.transform("u", lambda x: F.xxhash64(x, F.lit(1))).alias("g"),
        F.transform("u", lambda x: (F.length(x) >= 2 * long_words - 1) & (F.regexp_count(x, F.lit(WORDS)) >= long_words)).alias("is_long"),
    )
    marked = hashed.select("doc_id", "text_key", F.inline(_selected(window)))
    marked = materialize(marked, "line-marks")

    # Selected lines that stand at more than one place: the windows of any other are nowhere else.
    position = F.struct("doc_id", "text_key", "at")
    common = marked.groupBy("mark").agg(F.min(position).alias("a"), F.max(position).alias("b"))
    common = common.where(F.col("a") != F.col("b")).select("mark")
    likely = marked.join(common, "mark", "left_semi").select("doc_id", "text_key", F.inline("windows"))

    place = F.struct("doc_id", "text_key", "at")
    first = likely.groupBy("length", "k1", "k2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = first.where(F.col("first") != F.col("last")).drop("last")
    later = likely.join(first, ["length", "k1", "k2"]).where(place > F.col("first"))
    gone = later.select(
        "doc_id", "text_key", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1)).alias("line")
    )
    # At most the lines of one document.
    return gone.groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("removed"))


def _kept_text(text: Column, removed: Column) -> Column:
    """The text without the units of those numbers; other lines as they stand."""
    def left(lines: Column) -> Column:
        numbers = F.transform(lines, lambda x, i: F.when(F.regexp_replace(x, _AROUND, "") != "", i))
        units_at = F.filter(numbers, lambda i: i.isNotNull())
        gone = bind(units_at, lambda at: F.transform(removed, lambda r: F.get(at, r)))
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    return bind(F.split(text, "\n"), left)


def dedup(documents: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """The documents with the text that is left; all other columns as they are."""
    gone = materialize(repeats(documents, window, long_words), "line-repeats")
    return _apply(documents, gone)


def _apply(documents: DataFrame, gone: DataFrame, counts: bool = False) -> DataFrame:
    d, t, r = fresh(documents, "doc", "text", "removed")
    marks = gone.select(F.col("doc_id").alias(d), F.col("text_key").alias(t), F.col("removed").alias(r))
    # A sort-merge join at any size, so that disk and time grow evenly with the input.
    joined = documents.join(
        marks.hint("merge"), F.col("doc_id").eqNullSafe(F.col(d)) & (text_key(F.col("text")) == F.col(t)), "left"
    )
    kept = F.when(F.col(r).isNull(), F.col("text")).otherwise(_kept_text(F.col("text"), F.col(r)))
    if counts:
        return joined.select(
            "doc_id", F.size(units(F.col("text"))).cast("long").alias("n_lines"),
            F.coalesce(F.size(r), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept_text"),
        )
    return joined.select(*[kept.alias(c) if c == "text" else F.col(c) for c in documents.columns])


def summary(documents: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_text), one row per document."""
    gone = materialize(repeats(documents, window, long_words), "line-repeats")
    return _apply(documents, gone, counts=True)


LINE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS raw FROM documents),
l AS (SELECT r, doc_id, generate_subscripts(raw, 1) AS i, unnest(raw) AS line FROM d),
u AS (
  SELECT r, doc_id, i, line, unit, row_number() OVER (PARTITION BY r ORDER BY i) AS n
  FROM (SELECT *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS unit FROM l)
  WHERE unit <> ''),
w AS (
  SELECT r, doc_id, n, 3 AS length, unit || chr(10) || lead(unit) OVER o || chr(10) || lead(unit, 2) OVER o AS span
  FROM u WINDOW o AS (PARTITION BY r ORDER BY n)
  UNION ALL
  SELECT r, doc_id, n, 1, unit FROM u WHERE len(regexp_extract_all(unit, '[^\x20\x09-\x0D]+')) >= 50),
f AS (
  SELECT r, n, length, row_number() OVER (PARTITION BY length, span ORDER BY doc_id NULLS FIRST, n) AS turn
  FROM w WHERE span IS NOT NULL),
g AS (SELECT DISTINCT r, unnest(range(n, n + length)) AS n FROM f WHERE turn > 1),
k AS (
  SELECT l.r, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.n IS NULL) AS kept_text, count(u.n) AS n_lines,
         count(g.n) AS n_removed
  FROM l LEFT JOIN u ON l.r = u.r AND l.i = u.i LEFT JOIN g ON u.r = g.r AND u.n = g.n GROUP BY l.r)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  CASE WHEN text IS NOT NULL THEN coalesce(kept_text, '') END AS kept_text
FROM d LEFT JOIN k USING (r)
"""
