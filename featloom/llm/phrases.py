"""Phrases whose words come together more often than their parts would by chance.

Phrases of 2 to 5 words, counted per language inside the pieces between punctuation.

Counting by marginalisation of the top order: each word of a piece begins one window of
itself and the four words that lead on from it, padded where the piece ends.  Only these
longest windows are counted.  A ROLLUP over (lang, w1, ..., w5) then sums them to every
shorter prefix: a phrase of k words begins exactly those windows whose first k words it
is, so its count is one row of the roll-up, and the count by language is the number of
words.  No n-grams of other lengths are ever made.

Most windows are rare to the point of being unique, and a phrase is wanted only if it
occurs ``least`` times.  So a first pass counts the hashes of two to five words in slots,
added up over all of the corpus and cut off at ``least``.  A slot below ``least`` holds no
frequent phrase, and a window is padded from the first word on that would make it hold one
of those: every longer phrase through it is rare as well.  What is padded away is never a
phrase that is kept, so the counts are exact, at any size of the corpus.  There are as many
slots as keep the rare phrases of one well below ``least`` together: few slots would all
reach it in a large corpus and leave its windows whole.  Their number is bounded; beyond,
more windows stay whole.  The slots that reach ``least`` are bits and go to every task.

Tasks add up equal windows of their documents, in bounded tables, before the shuffle.

Scores are exact: products are decimals of 38 digits, the division is integral.

Defined cases: a null text is empty, a null lang is ``und``; repeated rows count each;
ties are settled by count, then by phrase in the order of bytes; an empty table gives no
rows; columns other than ``text`` and ``lang`` are not read.  Whole texts of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featloom.session import materialize

LEAST = 100
LONGEST = 5
TOP = 2000
UNKNOWN = "und"
SLOTS = 1 << 22  # at least; with more words than they are made for, twice as many, and so on
MOST_SLOTS = 1 << 25  # a byte of memory in a task for each order
SHARE = 8  # of ``least``: occurrences a slot is made for
WORD_BYTES = 8  # of text, a word and what parts it from the next
ORDERS = (2, 3, 4, 5)  # lengths of phrases that are counted by hash first
_CHUNK = 1 << 20  # words looked at together in a task
_PART = 1 << 16  # slots in a row
_MOST_WORDS = 1 << 20  # numbered in a task before the numbering begins again
_MOST_WINDOWS = 1 << 21  # held in a task before they are passed on
_ROWS = 1 << 16  # in a batch
_PARTS = 64  # of slots, in a batch
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]

# Ends of pieces become a byte that no text has; then a space on both sides makes it a word.
_END = b"\xff"
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _END * 10)


class _Numbers(dict):
    """Word to number from 1 on; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({_END: 0})
        self.names, self.hashes = [b""], [0]

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.names)
        self.names.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word, 13))
        return number


def _chunks(batches):
    """(languages, language of each word, word numbers, numbering, last) of some documents.

    Numbers of words and languages go on until ``last``, so that chunks can be added up.
    """

    def chunk(last):
        sizes = [len(p) for p in parts]
        return list(langs), np.repeat(np.array(codes), sizes), np.concatenate(parts), words, last

    words, langs, parts, codes, held = _Numbers(), {}, [], [], 0
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1)):
            data = text.as_py().encode().lower().translate(_ENDS)
            tokens = data.replace(_END, b" \xff ").split()
            tokens.append(_END)
            parts.append(np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens)))
            codes.append(langs.setdefault(lang.as_py(), len(langs)))
            held += len(tokens)
            if held >= _CHUNK:
                full = len(words) > _MOST_WORDS
                yield chunk(full)
                parts, codes, held = [], [], 0
                if full:
                    words, langs = _Numbers(), {}
    if len(words) > 1:
        if not parts:
            parts, codes = [np.zeros(1, np.int64)], [0]
        yield chunk(True)


def _slots(langs: list[str], code: np.ndarray, number: np.ndarray, words: _Numbers, slots: int):
    """For each order: the places where that many words go on, and their slots."""
    seeds = np.array([xxhash.xxh64_intdigest(lang.encode(), 17) for lang in langs], np.uint64)
    own = np.array(words.hashes, np.uint64)[number]
    h, fits = seeds[code], np.ones(len(number), bool)
    shift = np.uint64(64 - (slots.bit_length() - 1))
    for more in range(max(ORDERS)):
        fits = fits & (np.roll(number, -more) > 0)
        if more:
            fits[-more:] = False
        h = (h ^ np.roll(own, -more)) * _P
        h = (h ^ (h >> np.uint64(32))) * _Q
        h = h ^ (h >> np.uint64(29))
        if more + 1 in ORDERS:
            at = np.flatnonzero(fits)
            yield at, (h[at] >> shift).astype(np.int64)


def _kind(least: int):
    return np.uint8 if least < 256 else np.uint32


def _sketcher(least: int, slots: int):
    kind = _kind(least)

    def work(batches):
        totals = np.zeros((len(ORDERS), slots), kind)
        for *chunk, _ in _chunks(batches):
            for order, (_, slot) in enumerate(_slots(*chunk, slots)):
                at, more = np.unique(slot, return_counts=True)
                totals[order, at] = np.minimum(totals[order, at] + more, least)
        parts = totals.reshape(-1, _PART)
        for start in range(0, len(parts), _PARTS):
            numbers = [i for i in range(start, min(start + _PARTS, len(parts))) if parts[i].any()]
            # Most slots of a task are empty.
            counts = [pa.compress(parts[i].tobytes(), "zstd", asbytes=True) for i in numbers]
            yield pa.record_batch([pa.array(numbers, pa.int32()), pa.array(counts, pa.binary())], ["part", "counts"])

    return work


def _adder(least: int):
    kind = _kind(least)

    def work(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                whole = pa.decompress(counts.as_py(), _PART * np.dtype(kind).itemsize, "zstd", asbytes=True)
                more = np.frombuffer(whole, kind)
                totals[part] = np.minimum(totals[part].astype(np.int64) + more, least).astype(kind) if part in totals else more
        bits = [np.packbits(t >= least).tobytes() for t in totals.values()]
        yield pa.record_batch([pa.array(list(totals), pa.int32()), pa.array(bits, pa.binary())], ["part", "bits"])

    return work


def frequent_slots(texts: DataFrame, least: int, slots: int) -> np.ndarray:
    """For each order, which slots may hold a phrase that occurs ``least`` times."""
    sketched = texts.mapInArrow(_sketcher(least, slots), "part int, counts binary")
    added = sketched.repartition("part").mapInArrow(_adder(least), "part int, bits binary")
    out = np.zeros((len(ORDERS) * (slots // _PART), _PART // 8), np.uint8)
    for row in added.collect():  # slots / 2 bytes at most
        out[row.part] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(len(ORDERS), -1)


def _window_maker(bits: np.ndarray, slots: int):
    names = ["lang", *_WORDS, "n"]

    def windows(langs, code, number, words):
        size = len(number)
        # A single word is never padded away: all of them count towards the size.
        frequent = [np.concatenate([number > 0, np.zeros(LONGEST, bool)])]
        for order, (at, slot) in enumerate(_slots(langs, code, number, words, slots)):
            keep = np.zeros(size + LONGEST, bool)
            keep[at] = (bits[order][slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1
            frequent.append(keep)
        padded = np.concatenate([number, np.zeros(LONGEST, np.int64)])
        lead, on = [], np.ones(size, bool)
        for i in range(LONGEST):
            order = min(i, len(ORDERS))
            on = on & frequent[order][i - order : i - order + size]
            lead.append(np.where(on, padded[i : i + size], 0))
        real = np.flatnonzero(number > 0)
        # Numbers are below 2^31, so two make a key.
        return added([a[real] << 32 | b[real] for a, b in ((code, lead[0]), lead[1:3], lead[3:5])], np.ones(len(real), np.int64))

    def added(keys, counts):
        """Equal windows once, with the sum of their counts."""
        order = np.lexsort(keys)
        keys = [key[order] for key in keys]
        new = np.ones(len(order), bool)
        new[1:] = False
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(counts[order], starts) if len(starts) else counts
        return [key[starts] for key in keys], sums

    def rows(langs, words, parts):
        keys, counts = added([np.concatenate([p[0][i] for p in parts]) for i in range(3)], np.concatenate([p[1] for p in parts]))
        labels = pa.array(words.names, pa.binary()).cast(pa.string())
        low = (1 << 32) - 1
        numbers = [keys[0] & low, keys[1] >> 32, keys[1] & low, keys[2] >> 32, keys[2] & low]
        for at in range(0, len(counts), _ROWS):
            cut = slice(at, at + _ROWS)
            columns = [pa.array(langs, pa.string()).take(pa.array(keys[0][cut] >> 32))]
            columns += [labels.take(pa.array(number[cut])) for number in numbers]
            yield pa.record_batch([*columns, pa.array(counts[cut])], names)

    def work(batches):
        parts = []
        for langs, code, number, words, last in _chunks(batches):
            parts.append(windows(langs, code, number, words))
            if last or sum(len(p[1]) for p in parts) > _MOST_WINDOWS:
                yield from rows(langs, words, parts)
                parts = []

    return work


def enough_slots(texts: DataFrame, least: int) -> int:
    """So many that the occurrences in one, mostly of rare phrases, stay well below ``least``."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = size // WORD_BYTES * SHARE // max(1, least)
    return min(MOST_SLOTS // np.dtype(_kind(least)).itemsize, max(SLOTS, 1 << max(0, wanted - 1).bit_length()))


def phrase_counts(texts: DataFrame, least: int = LEAST, slots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases that occur ``least`` times, and (lang, n).

    ``texts`` has columns text and lang, without nulls; None takes :func:`enough_slots`.
    """
    if slots is None:
        slots = enough_slots(texts, least)
    if slots & (slots - 1) or slots < _PART:
        raise ValueError(f"slots must be a power of two, {_PART} at least")
    bits = frequent_slots(texts, least, slots)
    schema = f"lang string, {', '.join(f'{w} string' for w in _WORDS)}, n bigint"
    longest = (
        texts.mapInArrow(_window_maker(bits, slots), schema)
        .groupBy("lang", *_WORDS).agg(F.sum("n").alias("n"))
    )
    rolled = materialize(
        longest.rollup("lang", *_WORDS).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
        # Two sums at the ends of the roll-up are not phrases: of all, and of a language.
        .where((F.col("f") >= least) | (F.col("level") == (1 << LONGEST) - 1)),
        "phrase-counts",
    )
    words = F.lit(LONGEST) - F.length(F.regexp_replace(F.bin("level"), "0", ""))
    last = F.element_at(F.array(*_WORDS), words.cast("int"))
    phrases = (
        rolled.where(F.col("level") < (1 << LONGEST) - 1).where(last != "")
        .select("lang", F.concat_ws(" ", *_WORDS).alias("phrase"), words.alias("words"), "f")
    )
    sizes = rolled.where(F.col("level") == (1 << LONGEST) - 1).select("lang", F.col("f").alias("n"))
    return phrases, sizes


def _cut(start, size) -> F.Column:
    return F.array_join(F.slice("parts", start, size), " ")


def scored(phrases: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of phrases of two words and more.

    The lowest-scoring cut counts, of equal ones the one after the fewest words.
    """
    whole = phrases.where("words > 1").withColumn("parts", F.split("phrase", " "))
    cuts = whole.select(
        "lang", "phrase", "words", F.col("f").alias("a"), "parts",
        F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"),
    ).select(
        "lang", "phrase", "words", "a", "k", _cut(F.lit(1), F.col("k")).alias("head"),
        _cut(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"),
    )
    of = lambda name, count: phrases.select(
        F.col("lang").alias("lang_"), F.col("phrase").alias(name + "_"), F.col("f").alias(count)
    )
    for name, count in (("head", "l"), ("tail", "r")):
        side = of(name, count)
        cuts = cuts.join(side, (F.col("lang") == F.col("lang_")) & (F.col(name) == F.col(name + "_"))).drop(
            "lang_", name + "_"
        )
    cuts = cuts.join(sizes.withColumnRenamed("lang", "of"), F.col("lang") == F.col("of")).withColumn(
        "score",
        F.expr(
            "cast(1000 as decimal(4, 0)) * cast(a as decimal(19, 0)) * cast(n as decimal(19, 0))"
            " div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"
        ),
    )
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "words", "a", "n").agg(best).select(
        "lang", "phrase", "words", "a", "best.l", "best.r", "n", "best.score"
    )


def uncovered(phrases: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates that no longer phrase holds as often as they occur."""
    places = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("words") - 1),
        lambda size: F.transform(
            F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: F.array_join(F.slice("parts", at, size), " ")
        ),
    ))
    inside = (
        phrases.where("words > 2").withColumn("parts", F.split("phrase", " "))
        .select("lang", "f", F.explode(F.array_distinct(places)).alias("part"))
        .groupBy(F.col("lang").alias("lang_"), "part").agg(F.max("f").alias("most"))
    )
    return candidates.join(
        inside, (F.col("lang") == F.col("lang_")) & (F.col("phrase") == F.col("part")) & (F.col("most") >= F.col("a")),
        "left_anti",
    )


def _first(df: DataFrame, top: int) -> DataFrame:
    """The first of each language; of every share of a language first, so no task ranks all."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    few = df.withColumn("share", share).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))
    ).where(F.col("rank") <= top)
    return few.withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    ).where(F.col("rank") <= top)


def mine(documents: DataFrame, least: int = LEAST, top: int = TOP, slots: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's strongest phrases."""
    texts = documents.where(F.col("text").isNotNull()).select(
        "text", F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang")
    )
    phrases, sizes = phrase_counts(texts, least, slots)
    left = uncovered(phrases, scored(phrases, sizes))
    return _first(left, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _sql() -> str:
    """The same counts by one explosion for each length, in SQL."""
    grams = "\n  UNION ALL\n  ".join(
        f"SELECT lang, {k} AS words, unnest(list_transform(range(1, len(ws) - {k} + 2), "
        f"lambda i: array_to_string(ws[i : i + {k - 1}], ' '))) AS phrase FROM pieces WHERE len(ws) >= {k}"
        for k in range(1, LONGEST + 1)
    )
    cuts = "\n  UNION ALL\n  ".join(
        f"SELECT *, {k} AS k, array_to_string(p[1 : {k}], ' ') AS head, "
        f"array_to_string(p[{k + 1} : words], ' ') AS tail FROM whole WHERE words > {k}"
        for k in range(1, LONGEST)
    )
    inside = "\n  UNION ALL\n  ".join(
        f"SELECT lang, a, array_to_string(p[{i} : {i + k - 1}], ' ') AS part FROM whole WHERE words > {k} AND words >= {i + k - 1}"
        for k in range(2, LONGEST) for i in range(1, LONGEST - k + 2)
    )
    return rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL)),
sizes AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM pieces GROUP BY lang),
counts AS MATERIALIZED (
  SELECT lang, words, phrase, count(*) AS a FROM (
  {grams})
  GROUP BY ALL HAVING count(*) >= {LEAST}),
whole AS MATERIALIZED (
  SELECT lang, words, phrase, a, string_split(phrase, ' ') AS p FROM counts WHERE words > 1),
cuts AS (
  {cuts}),
scores AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.a AS l, r.a AS r, s.n,
    CAST(1000::HUGEINT * c.a * s.n // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.head
  JOIN counts r ON r.lang = c.lang AND r.phrase = c.tail JOIN sizes s ON s.lang = c.lang),
best AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, part, max(a) AS most FROM (
  {inside})
  GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.part = b.phrase
  WHERE o.most IS NULL OR o.most < b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, score
FROM kept QUALIFY rank <= {TOP}
"""


PHRASES_SQL = _sql()
