"""Benchmark decontamination by winnowing.

Hashes of ``k`` consecutive words are taken at every place of a text, and of each
window of ``w`` such hashes the least is kept.  A span of ``k + w - 1`` words always
holds a whole window, and equal spans keep equal hashes, so joining the kept hashes of
documents and items finds every document that shares a span.  Around the places where
a kept hash of an item occurs the 13-word windows are then spelled out and joined with
the windows of the items, which extends each hit over all of its words exactly.

Items of fewer words are one window each.  They form classes by length, each with its
own ``k`` and ``w`` so that the guarantee holds at that length.

Defined cases: a null text has no words; an item without words has no window; repeated
rows of documents are judged alike, repeated items count once by item_id; a null
item_id has windows but no name in the digest; an empty benchmark leaves all documents
clean.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.llm.common import fresh, lower_ascii, text_key
from featloom.session import materialize

# Words of the contract: anything but ASCII controls, signs and (lowered) capitals.
ITEM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
GRAM = 5
# A document is contaminated from this share of hit words on: one in 20.
SHARE = 20


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(
        lower_ascii(F.coalesce(text, F.lit(""))), F.lit(ITEM_WORDS), F.lit(0)
    )


def _count_words(text: Column) -> Column:
    return F.regexp_count(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(ITEM_WORDS))


def gram_hashes(words: Column, k: int) -> Column:
    """Hash of the ``k`` words from each place on, empty if there are fewer."""
    n = F.size(words)
    return F.when(
        n >= k,
        F.transform(
            F.sequence(F.lit(0), n - k),
            lambda i: F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def winnow(hashes: Column, w: int) -> Column:
    """The least hash of each window of ``w``, each once."""
    if w == 1:
        return F.array_distinct(hashes)
    n = F.size(hashes)
    return F.when(
        n >= w,
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(0), n - w),
                lambda i: F.least(*[F.get(hashes, i + j) for j in range(w)]),
            )
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _with_grams(worded: DataFrame, lengths: list[int]) -> DataFrame:
    """``worded`` and a column of hashes for each ``k`` that the lengths ask for.

    Words, hashes and minima are columns of their own: an expression used inside a lambda
    would be worked out again for every element.
    """
    grams = {f"g{k}": gram_hashes(F.col("w"), k) for k in sorted({gram_and_window(n)[0] for n in lengths})}
    return worded.select("*", *[g.alias(name) for name, g in grams.items()])


def _kept_hashes(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """The columns of ``texts`` but its words ``w``, and each (length, hash) that is kept.

    The words are taken apart once for all lengths.
    """
    kept = []
    for length in lengths:
        k, w = gram_and_window(length)
        named = F.lit(length).alias("length")
        kept.append(F.transform(winnow(F.col(f"g{k}"), w), lambda h: F.struct(named, h.alias("hash"))))
    others = [c for c in texts.columns if c != "w"]
    return (
        _with_grams(texts, lengths)
        .select(*others, F.explode(F.flatten(F.array(*kept))).alias("kept"))
        .select(*others, "kept.length", "kept.hash")
    )


def gram_and_window(length: int, gram: int = GRAM) -> tuple[int, int]:
    """``k`` and ``w`` with which a span of ``length`` words is sure to be found."""
    k = min(gram, length)
    return k, length - k + 1


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, length, span): the windows of each item, as words joined by a space."""
    words = items.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.lit(window), F.size("w"))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    return (
        words.select("item_id", "w", length.alias("length"), F.explode(starts).alias("at"))
        .select("item_id", "length", F.array_join(F.slice("w", F.col("at"), F.col("length")), " ").alias("span"))
        .distinct()
    )


def _hashes(length: int) -> Column:
    """The kept hashes of that length among a document's seeds."""
    return F.transform(F.filter("seeds", lambda s: s["length"] == length), lambda s: s["hash"])


def _starts(length: int) -> Column:
    """Where windows of the length start that hold a place with one of its hashes, each once."""
    k, w = gram_and_window(length)
    grams, hashes, last = F.col(f"g{k}"), F.col(f"h{length}"), F.size("w") - length
    places = F.when(
        (F.size(grams) > 0) & (F.size(hashes) > 0),
        F.filter(
            F.sequence(F.lit(0), F.size(grams) - 1),
            lambda i: F.array_contains(hashes, F.get(grams, i)),
        ),
    ).otherwise(F.array().cast("array<int>"))
    around = lambda p: F.when(
        F.greatest(p - (w - 1), F.lit(0)) <= F.least(p, last),
        F.sequence(F.greatest(p - (w - 1), F.lit(0)), F.least(p, last)),
    ).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(places, around)))


def _windows(length: int) -> Column:
    """The windows at the starts, with their words."""
    return F.transform(
        F.col(f"s{length}"),
        lambda i: F.struct(
            F.lit(length).alias("length"), i.alias("at"),
            F.array_join(F.slice("w", i + 1, F.lit(length)), " ").alias("span"),
        ),
    )


def find_hits(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, n_hit, item_ids) of documents with a word inside a window."""
    spans = materialize(item_windows(items, window), "item-windows")
    lengths = sorted(r.length for r in spans.select("length").distinct().collect())
    if not lengths:
        return documents.sparkSession.createDataFrame(
            [], "doc_id bigint, text_key bigint, n_hit bigint, item_ids array<string>"
        )
    docs = documents.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))

    wanted = None
    for length in lengths:
        own = spans.where(F.col("length") == length).select(F.split("span", " ").alias("w"))
        own = _kept_hashes(own, [length])
        wanted = own if wanted is None else wanted.unionByName(own)
    kept = _kept_hashes(docs.select("doc_id", "text_key", words_of(F.col("text")).alias("w")), lengths)
    # At most the kept hashes of one document, and those that some item has.
    seeds = materialize(
        kept.join(wanted.distinct(), ["length", "hash"], "left_semi")
        .groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("length", "hash")).alias("seeds")),
        "benchmark-seeds",
    )

    # Repeated rows of a document give the same windows again, which count once below; so
    # no text is moved to tell them apart.
    near = docs.join(
        seeds.withColumnRenamed("doc_id", "d").withColumnRenamed("text_key", "t"),
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")),
    )
    near = near.select(
        "doc_id", "text_key", words_of(F.col("text")).alias("w"), *[_hashes(n).alias(f"h{n}") for n in lengths]
    )
    near = _with_grams(near, lengths)
    near = near.select("*", *[_starts(n).alias(f"s{n}") for n in lengths])
    # A window leaves with its own words only, not with all of the text's.
    windows = F.flatten(F.array(*[_windows(n) for n in lengths]))
    candidates = near.select(
        "doc_id", "text_key", F.explode(windows).alias("window")
    ).select("doc_id", "text_key", "window.length", "window.at", "window.span")

    hits = materialize(
        candidates.join(spans.select("length", "span").distinct(), ["length", "span"], "left_semi"),
        "benchmark-windows",
    )
    covered = F.explode(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1))
    words = (
        hits.select("doc_id", "text_key", covered.alias("word")).distinct()
        .groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n_hit"))
    )
    # One row per span: how often it is used does not multiply the documents' rows.
    known = spans.groupBy("span").agg(F.collect_set(F.col("item_id").cast("string")).alias("item_ids"))
    named = (
        hits.select("doc_id", "text_key", "span").distinct().join(known, "span")
        .select("doc_id", "text_key", F.explode("item_ids").alias("item")).distinct()
        .groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
        .select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "item_ids")
    )
    return words.join(
        named, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left"
    ).select(
        "doc_id", "text_key", "n_hit",
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def judge(documents: DataFrame, items: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row per document."""
    hits = materialize(find_hits(documents, items, window), "benchmark-hits").select(
        F.col("doc_id").alias("d"), F.col("text_key").alias("t"),
        F.col("n_hit").alias("hit"), "item_ids",
    )
    counted = documents.select(
        "doc_id", text_key(F.col("text")).alias("k"), _count_words(F.col("text")).cast("long").alias("n_words")
    )
    joined = counted.join(
        hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k") == F.col("t")), "left"
    )
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    names = F.coalesce("item_ids", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, items: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    d, t, hit = fresh(documents, "doc", "text", "hit")
    hits = materialize(find_hits(documents, items, window), "benchmark-hits").select(
        F.col("doc_id").alias(d), F.col("text_key").alias(t), F.col("n_hit").alias(hit)
    )
    return documents.join(
        hits,
        F.col("doc_id").eqNullSafe(F.col(d))
        & (text_key(F.col("text")) == F.col(t))
        & (F.col(hit) * share >= _count_words(F.col("text"))),
        "left_anti",
    )


DECONTAMINATION_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
iw AS (
  SELECT item_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
spans AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n,
    array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS span
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
        FROM iw WHERE len(w) > 0)),
occ AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS span
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM dw, (SELECT DISTINCT n FROM spans) WHERE len(w) >= n)),
hits AS (SELECT DISTINCT r, occ.n, i, item_id FROM occ JOIN spans USING (span, n)),
words AS (
  SELECT r, count(DISTINCT word) AS n_hit
  FROM (SELECT r, unnest(range(i, i + n)) AS word FROM hits) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM dw LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""
