"""Language identification by rank-order profiles of character n-grams.

A language's profile is its most frequent n-grams of one to three characters, in order
of count.  A document's own most frequent n-grams are compared with each profile: each
n-gram adds the number of places it is out of its place there, or the profile's length
if it is not in it.  The language with the least sum is predicted; the score is one
minus that sum over the largest possible.

Profiles are learned from a sample of at most ``sample`` labelled documents of each
language (those with the least hash of their id); every document is scored, over its
whole text.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is any
text if nothing could be learned; ties go to the language first in order; repeated rows
are scored alike; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PROFILE = 300
SAMPLE = 1000
FOLDS = 5
# Ranges of 64-bit hashes, 4096 of them.
RANGE_SHIFT = 52
UNKNOWN = "und"
# Texts scored below this are of no language that was learned.
LEAST_SCORE = 0.05

_WORDS = re.compile(r"[^\W\d_]+")


def letter_words(text: str) -> list[str]:
    """Runs of letters; other signs that count as parts of words (as in x\u00b2) are left out."""
    words = _WORDS.findall(text.lower())
    if not "".join(words).isalpha():
        words = ["".join(filter(str.isalpha, w)) for w in words]
    return [w for w in words if w]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the text's words as numbers, ascending, and their counts.

    Words are runs of letters in lower case with a space on either side.  Code points
    take 21 bits each, so n-grams of different lengths cannot be equal.
    """
    words = letter_words(text) if text else []
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    spaced = f" {' '.join(words)} "
    one = np.frombuffer(spaced.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    two = one[:-1] << 21 | one[1:]
    three = (two[:-1] << 21 | one[2:])[one[1:-1] != 32]
    return np.unique(np.concatenate([one[one != 32], two, three]), return_counts=True)


def most_frequent(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The ``size`` n-grams counted most, ties by n-gram."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


@dataclass(frozen=True)
class Profiles:
    """Profiles of all languages side by side: an n-gram's place in each."""

    languages: tuple[str, ...]
    keys: np.ndarray
    places: np.ndarray
    size: int

    @classmethod
    def of(cls, rows: list[tuple[str, int, int]], size: int = PROFILE) -> Profiles:
        """From (language, n-gram, place) rows."""
        languages = tuple(sorted({r[0] for r in rows}))
        keys = np.array(sorted({r[1] for r in rows}), np.int64)
        places = np.full((len(keys), len(languages)), -1, np.int64)
        for language, key, place in rows:
            places[np.searchsorted(keys, key), languages.index(language)] = place
        return cls(languages, keys, places, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        own = most_frequent(*ngrams(text), self.size)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        places = np.where((self.keys[at] == own)[:, None], self.places[at], -1)
        out = np.abs(places - np.arange(len(own))[:, None])
        distance = np.where(places < 0, self.size, out).sum(axis=0)
        best = int(distance.argmin())
        return self.languages[best], 1.0 - float(distance[best]) / (self.size * len(own))


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """The documents whose id's checksum is divisible by ``folds``; a null id is not."""
    remainder = F.crc32(doc_id.cast("string").cast("binary")) % folds
    return F.coalesce(remainder == 0, F.lit(False))


def learn(
    documents: DataFrame, size: int = PROFILE, sample: int = SAMPLE, folds: int = FOLDS
) -> Profiles:
    labelled = documents.select("doc_id", "lang").where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds)
    )
    # At most ``sample`` ids of a language, those of the least hashes.  Counts of hash ranges
    # tell which ranges hold them, so no task sees more of a language than it needs.
    hashed = labelled.select("*", F.xxhash64("doc_id").alias("hash"))
    hashed = hashed.withColumn("range", F.shiftright("hash", RANGE_SHIFT))
    counts = hashed.groupBy("lang", "range").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("range"))
    reach = counts.withColumn("before", upto - F.col("n")).where(F.col("before") < sample)
    reach = reach.select(F.col("lang").alias("l"), F.col("range").alias("r"))
    near = hashed.join(reach, (F.col("lang") == F.col("l")) & (F.col("range") == F.col("r")), "left_semi")
    turn = Window.partitionBy("lang").orderBy("hash", "doc_id")
    chosen = near.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= sample)
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("id"), F.col("lang").alias("l")).distinct())
    texts = documents.select("doc_id", "lang", "text").join(
        chosen, (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("l"))
    ).select("lang", "text")

    def count(batches):
        totals: dict[str, Counter] = {}
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, counts = ngrams(text.as_py())
                totals.setdefault(language, Counter()).update(dict(zip(keys.tolist(), counts.tolist())))
        for language, counter in totals.items():
            keys, counts = list(counter), list(counter.values())
            for at in range(0, len(keys), 10_000):
                part = keys[at : at + 10_000]
                yield pa.record_batch(
                    [pa.array([language] * len(part), pa.string()), pa.array(part, pa.int64()),
                     pa.array(counts[at : at + 10_000], pa.int64())], ["lang", "key", "n"],
                )

    totals = (
        texts.mapInArrow(count, "lang string, key bigint, n bigint")
        .groupBy("lang", "key").agg(F.sum("n").alias("n"))
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
    top = totals.withColumn("place", place - 1).where(F.col("place") < size)
    # ``size`` rows of each language.
    return Profiles.of([(r.lang, r.key, r.place) for r in top.select("lang", "key", "place").collect()], size)


def predict(documents: DataFrame, profiles: Profiles, folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per document."""
    narrow = documents.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "text")

    def work(batches):
        for batch in batches:
            guesses = [profiles.predict(t.as_py()) for t in batch.column(2)]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([g[0] for g in guesses], pa.string()),
                 pa.array([g[1] for g in guesses], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    doc_id = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(
        work, f"doc_id {doc_id}, held_out boolean, lang_pred string, score double"
    )


def keep_known(
    documents: DataFrame, profiles: Profiles, least_score: float = LEAST_SCORE
) -> DataFrame:
    """The documents, all columns, whose language is known with at least that score."""
    at = documents.columns.index("text")

    def work(batches):
        for batch in batches:
            guesses = (profiles.predict(t.as_py()) for t in batch.column(at))
            keep = [g[0] != UNKNOWN and g[1] >= least_score for g in guesses]
            yield pc.filter(batch, pa.array(keep, pa.bool_()))

    return documents.mapInArrow(work, documents.schema)
