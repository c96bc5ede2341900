"""URL filter: rules first, then exact membership in a block list by a Bloom cascade.

Level 0 encodes the listed keys.  Level 1 encodes the keys of the corpus that level 0
takes for listed although they are not, level 2 the listed keys that level 1 takes in,
and so on until nothing is mistaken.  As every key of the corpus was tried while
building, the first level that misses a key decides it exactly, and pages are judged
by looking at bits alone: no page is joined or shuffled.

Defined cases: a url that is null or has no ``://`` has an empty host and path; the
empty host is a key like any other; repeated rows are judged alike; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.llm.common import lower_ascii
from featloom.session import materialize

BITS_PER_KEY = 10
HASHES = 6
# Bit arrays reach every task; above this size in total the keys are joined instead.
MOST_BYTES = 64 << 20

# Fixed values of the contract: (verdict, rule), a host followed by the start of a path.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """(verdict, rule) of the longest rule that fits the host, or a parent, and the path."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at = rule.index("/")
        name, start = rule[:at], rule[at:]
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        found = F.when(
            fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        ).otherwise(found)
    return found


def under_domain(host: Column, domains: Sequence[str]) -> Column:
    """Whether the host is one of the domains or below one."""
    found = F.lit(False)
    for name in domains:
        found = found | (host == name) | F.endswith(host, F.lit(f".{name}"))
    return found


@dataclass(frozen=True)
class Cascade:
    """Bit arrays by level, as one-row tables that a scalar subquery reads."""

    levels: tuple[tuple[DataFrame, int], ...]

    def contains(self, key: Column) -> Column:
        """Exact for the keys it was built over."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels) - 1, -1, -1):
            words, bits = self.levels[level]
            inside = _all_set(words.scalar(), key, level, bits)
            answer = F.when(inside, answer).otherwise(F.lit(level % 2 == 1))
        return answer


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    return [
        F.pmod(F.xxhash64(F.lit(level * HASHES + i), key), F.lit(bits)) for i in range(HASHES)
    ]


def _all_set(words: Column, key: Column, level: int, bits: int) -> Column:
    inside = F.lit(True)
    for at in _positions(key, level, bits):
        word = F.get(words, F.shiftright(at, 6).cast("int"))
        inside = inside & (F.getbit(word, (at % 64).cast("int")) == 1)
    return inside


def _bit_array(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One row with the array of words; bits are joined on the map side."""
    at = F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("at")
    set_words = (
        keys.select(at)
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    )
    every = keys.sparkSession.range(bits // 64).join(
        set_words, F.col("id") == F.col("word"), "left"
    )
    pairs = F.sort_array(
        F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))
    )
    return every.agg(F.transform(pairs, lambda p: p["bits"]).alias("words"))


def fit_cascade(
    keys: DataFrame, bits_per_key: int = BITS_PER_KEY, most_bytes: int = MOST_BYTES
) -> Cascade | None:
    """From (key, listed) with each key once; None if the bits would exceed ``most_bytes``.

    Each level holds a small share of the one before, so levels end soon; hashes differ
    by level, so two keys cannot be mistaken for each other for ever.
    """
    keys = materialize(keys, "cascade-keys")
    encoded = keys.where("listed").select("key")
    others = keys.where(~F.col("listed")).select("key")
    levels: list[tuple[DataFrame, int]] = []
    size = encoded.count()
    used = 0
    while size or not levels:
        bits = max(64, 64 * math.ceil(size * bits_per_key / 64))
        used += bits // 8
        if used > most_bytes:
            return None
        words = materialize(_bit_array(encoded, len(levels), bits), "cascade-level")
        mistaken = materialize(
            others.where(_all_set(words.scalar(), F.col("key"), len(levels), bits)),
            "cascade-mistaken",
        )
        levels.append((words, bits))
        encoded, others = mistaken, encoded
        size = encoded.count()
    return Cascade(tuple(levels))


def may_contain(
    keys: DataFrame, key: Column, bits_per_key: int = BITS_PER_KEY, most_bytes: int = MOST_BYTES
) -> Column:
    """True for every one of ``keys`` and for few others; always true where the bits would
    exceed ``most_bytes``.  Only to leave rows out early that an exact join drops anyway."""
    bits = max(64, 64 * math.ceil(keys.count() * bits_per_key / 64))
    if bits // 8 > most_bytes:
        return F.lit(True)
    words = materialize(_bit_array(keys, 0, bits), "bloom-bits")
    return _all_set(words.scalar(), key, 0, bits)


def filter_urls(
    pages: DataFrame,
    listed: Column,
    rules: Sequence[tuple[str, str]] = RULES,
    bits_per_key: int = BITS_PER_KEY,
    most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """(page_id, host, path, rule, verdict); ``listed`` tells of column ``key``, a host,
    whether the block list has it."""
    url = F.col("url")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    parsed = parsed.select(
        "page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path")
    )
    keys = parsed.select(F.col("host").alias("key")).distinct()
    keys = keys.select("key", F.coalesce(listed, F.lit(False)).alias("listed"))
    cascade = fit_cascade(keys, bits_per_key, most_bytes)
    if cascade is None:
        # The list is too long to send to every task: the same answer by an equi-join.
        blocked = keys.where("listed").select("key")
        judged = parsed.join(blocked, F.col("host") == F.col("key"), "left")
        inside = F.col("key").isNotNull()
    else:
        judged, inside = parsed, cascade.contains(F.col("host"))
    found = rule_for(F.col("host"), F.col("path"), rules)
    return judged.select("page_id", "host", "path", found.alias("found"), inside.alias("inside")).select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(
            F.col("found.verdict"), F.when(F.col("inside"), F.lit("block")).otherwise(F.lit("allow"))
        ).alias("verdict"),
    )


# Domains of the block list used by the query; hosts below them are listed as well.
BLOCKED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_DOMAINS = tuple(
    f"{name}.example.{top}" for name in BLOCKED_NAMES for top in ("com", "net", "org")
)

_LISTED_SQL = "\n     OR ".join(
    f"host = '{d}' OR ends_with(host, '.{d}')" for d in BLOCKED_DOMAINS
)
URL_SQL = rf"""
WITH a AS (
  SELECT page_id,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
b AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM a),
c AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1')
      THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/')
      THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
    END AS rule
  FROM b)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN {_LISTED_SQL} THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""
