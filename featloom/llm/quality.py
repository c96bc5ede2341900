"""Quality rules: counted base rules, and a hashed n-gram classifier with calibration.

Base counts per text: characters of words, symbols, lines equal to an earlier one, and
words inside 8-word windows that occur twice.  The classifier is a logistic regression
on hashed words and hashed character 4-grams (log counts, each text scaled to length
one), fitted to labelled rows; a part of them that the fit does not see calibrates its
score to a probability (Platt's two parameters).  Texts are scored in Arrow batches and
kept from a fixed probability on.

The fit uses at most ``sample`` labelled documents, those with the least hash of their
id; counts and scores are taken of every whole text.

Defined cases: null and empty texts have zero counts and fail the base rule; without
labels of both kinds the classifier keeps everything the base rule keeps; a document
labelled more than once has its highest label; repeated rows are judged alike; an empty
table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

SAMPLE = 4000
BUCKETS = 1 << 15
THRESHOLD = 0.5

_SYMBOL = re.compile(f"[{re.escape(SYMBOLS)}]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    spaces = len(_SPACE.findall(text))
    seen: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        if not line or not line.strip(" \t\n\x0b\x0c\r"):
            continue
        if line in seen:
            repeated += 1
        else:
            seen.add(line)
    return len(words), len(text) - spaces, len(_SYMBOL.findall(text)), repeated, repeat_words(words)


def repeat_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words inside windows of eight that occur twice or more, compared exactly.

    Windows are numbered by doubling: a window of 2n words is a pair of numbers of
    windows of n words.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    span = 1
    while span < window:
        pairs = ids[:-span] * (int(ids.max()) + 1) + ids[span:]
        ids = np.unique(pairs, return_inverse=True)[1]
        span *= 2
    starts = np.bincount(ids)[ids] > 1
    if not starts.any():
        return 0
    marks = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(starts)
    marks[at] += 1
    np.subtract.at(marks, at + window, 1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def features(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's words and character 4-grams, and their scaled log counts.

    The first half of the buckets are words, the second half 4-grams of bytes.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return np.empty(0, np.int64), np.empty(0)
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    half, shift = buckets // 2, np.uint64(64 - (buckets // 2).bit_length() + 1)
    mix = np.uint64(0x9E3779B97F4A7C15)
    found = []
    if len(b) >= 4:
        grams = b[:-3] | b[1:-2] << np.uint64(8) | b[2:-1] << np.uint64(16) | b[3:] << np.uint64(24)
        found.append((((grams + np.uint64(1)) * mix) >> shift).astype(np.int64) + half)
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if len(starts):
        # A word's hash is the wrapped sum of its bytes, each mixed with its place in the word.
        place = np.arange(len(b), dtype=np.int64)
        word = np.repeat(starts, ends - starts)
        own = b[inside] + np.uint64(256) * (place[inside] - word).astype(np.uint64) + np.uint64(7)
        own *= mix
        own ^= own >> np.uint64(29)
        own *= np.uint64(0xBF58476D1CE4E5B9)
        sums = np.add.reduceat(own, np.concatenate([[0], np.cumsum(ends - starts)[:-1]]))
        found.append(((sums * mix) >> shift).astype(np.int64))
    counts = np.bincount(np.concatenate(found), minlength=buckets) if found else np.zeros(buckets)
    at = np.flatnonzero(counts)
    values = np.log1p(counts[at])
    return at, values / np.sqrt((values * values).sum()) if len(at) else values


@dataclass(frozen=True)
class Classifier:
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def raw(self, at: np.ndarray, values: np.ndarray) -> float:
        return float(self.weights[at] @ values) + self.bias

    def probability(self, text: str | None) -> float:
        raw = self.raw(*features(text, len(self.weights)))
        return float(1.0 / (1.0 + np.exp(-np.clip(self.scale * raw + self.shift, -50, 50))))


def _fit_rows(rows: list[tuple[int, np.ndarray, np.ndarray]], buckets: int) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps, both labels weighing alike."""
    y = np.array([r[0] for r in rows], float)
    lengths = np.array([len(r[1]) for r in rows])
    row = np.repeat(np.arange(len(rows)), lengths)
    at, values = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, bias, step, penalty = np.zeros(buckets), 0.0, 4.0, 1e-5
    last_w, last_b = w, bias
    for turn in range(1, 301):
        ahead = (turn - 1) / (turn + 2)
        vw, vb = w + ahead * (w - last_w), bias + ahead * (bias - last_b)
        z = np.bincount(row, values * vw[at], minlength=len(rows)) + vb
        gap = weight * (1.0 / (1.0 + np.exp(-np.clip(z, -50, 50))) - y)
        slope = np.bincount(at, values * gap[row], minlength=buckets) + penalty * vw
        last_w, last_b = w, bias
        w, bias = vw - step * slope, vb - step * gap.sum()
    return w, bias


def _platt(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that turn scores into probabilities, by Newton's method."""
    good, bad = y.sum(), (1 - y).sum()
    goal = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([scores, np.ones_like(scores)], 1)

    def loss(ab):
        z = x @ ab
        return (np.logaddexp(0, z) - goal * z).sum()

    ab = np.array([0.0, np.log((good + 1) / (bad + 1))])
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ ab, -50, 50)))
        slope = x.T @ (p - goal)
        curve = x.T @ (x * (p * (1 - p))[:, None]) + 1e-9 * np.eye(2)
        step, size = np.linalg.solve(curve, slope), 1.0
        while loss(ab - size * step) > loss(ab) and size > 1e-9:
            size /= 2
        ab = ab - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(ab[0]), float(ab[1])


def fit(
    documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS
) -> Classifier | None:
    """From (doc_id, quality) labels; None unless both labels are there.

    Features are made in parallel; the bounded sample of them is fitted in one task, and
    only the weights come to the driver.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("id"), "y"))
    # Rows that repeat an id are one labelled row, so that the bound holds.
    rows = documents.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("id"))

    def featurize(batches):
        for batch in batches:
            made = [features(t.as_py(), buckets) for t in batch.column(1)]
            yield pa.record_batch(
                [batch.column(0), batch.column(2),
                 pa.array([m[0].astype(np.int32) for m in made], pa.list_(pa.int32())),
                 pa.array([m[1].astype(np.float32) for m in made], pa.list_(pa.float32()))],
                ["doc_id", "y", "at", "v"],
            )

    made = (
        rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "y")
        .mapInArrow(featurize, "doc_id bigint, y int, at array<int>, v array<float>")
        .groupBy("doc_id").agg(F.max(F.struct("y", "at", "v")).alias("r"))
        .select("doc_id", "r.*")
    )

    def train(batches):
        rows = []
        for batch in batches:
            for i, y, at, v in zip(*(batch.column(k) for k in range(4))):
                rows.append((i.as_py(), (y.as_py(), at.values.to_numpy(), v.values.to_numpy().astype(float))))
        rows = [r for _, r in sorted(rows, key=lambda r: r[0])]
        if {0, 1} <= {r[0] for r in rows}:
            held = [r for i, r in enumerate(rows) if i % 4 == 0]
            fitted = [r for i, r in enumerate(rows) if i % 4 != 0]
            if not ({0, 1} <= {r[0] for r in held} and {0, 1} <= {r[0] for r in fitted}):
                held = fitted = rows
            w, bias = _fit_rows(fitted, buckets)
            scores = np.array([w[at] @ v + bias for _, at, v in held])
            scale, shift = _platt(scores, np.array([y for y, _, _ in held], float))
            yield pa.record_batch(
                [pa.array([w], pa.list_(pa.float64())), pa.array([bias]), pa.array([scale]), pa.array([shift])],
                ["w", "bias", "scale", "shift"],
            )

    found = made.repartition(1).mapInArrow(
        train, "w array<double>, bias double, scale double, shift double"
    ).collect()
    return Classifier(np.array(found[0].w), found[0].bias, found[0].scale, found[0].shift) if found else None


def judge(
    documents: DataFrame, classifier: Classifier | None, threshold: float = THRESHOLD
) -> DataFrame:
    """Base counts, base_failed, kept and the probability of each document."""
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def work(batches):
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            counts = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
            good = np.array([classifier.probability(t) if classifier else 1.0 for t in texts], float)
            failed = (counts[:, 0] < LEAST_WORDS) | (
                100 * counts[:, 4] > MOST_REPEATED_PERCENT * counts[:, 0]
            )
            yield pa.record_batch(
                [batch.column(0), *[pa.array(counts[:, i]) for i in range(5)],
                 pa.array(failed), pa.array(~failed & (good >= threshold)), pa.array(good)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 "base_failed", "kept", "probability"],
            )

    return narrow.mapInArrow(
        work,
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, base_failed boolean, kept boolean, probability double",
    )
