"""Runs of a text's words: stretches that repeat a short piece four times or more.

A run is a stretch of consecutive words with smallest period ``q`` and a length of at
least ``max(min_length, min_exponent * q)`` that no neighbouring word extends.

Common extensions (how far two places of a text go on alike) come from a difference
cover: residues modulo ``V`` of which every difference modulo ``V`` is a difference of two.
Only the suffixes that start at covered places are sorted, by blocks of ``V`` words and
then by doubling the number of blocks.  Two places are compared word by word for the few
words until both are covered; from there the least common prefix of neighbours between
their ranks, held in a sparse table, gives the rest.  The sorted samples are only made for
texts in which some comparison gets that far.

Runs of period ``q`` match themselves ``q`` words on over a stretch of at least
``(min_exponent - 1) * q`` words, so each contains a place of the grid with that step: all
grids together have about ``n ln n / (min_exponent - 1)`` places, and each is extended to
both sides.  Of the stretches found with several periods the smallest period is the run's.

Work goes on inside a document and needs no shuffle; memory is bounded by the words of the
longest text.

Defined cases: a null or empty text has no words and no runs; repeated rows are treated
alike; ties for the strongest run go to the smallest start, then the smallest period; an
empty table gives no rows; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 6
MIN_EXPONENT = 4
# A perfect difference cover, every residue but 0 is one difference of two.
V = 13
COVER = (0, 1, 3, 9)
GRID = 1 << 20  # places of the grids looked at together

Rewrite = Callable[[object, list], list]


def _shifts() -> np.ndarray:
    """By both places modulo V: the words to go until both are covered."""
    table = np.zeros((V, V), np.int64)
    for i in range(V):
        for j in range(V):
            table[i, j] = next(d for d in range(V) if (i + d) % V in COVER and (j + d) % V in COVER)
    return table


_SHIFT = _shifts()
_SLOT = np.full(V, -1, np.int64)
_SLOT[list(COVER)] = np.arange(len(COVER))


class CommonExtensions:
    """How many words from two places on are alike, for many pairs of places at once."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        # No word is 0, so a comparison that reaches the end stops there.
        self.words = np.concatenate([words + 1, np.zeros(2 * V, np.int64)])
        self.samples: tuple[np.ndarray, list[np.ndarray]] | None = None

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For places ``i < j``, ``j`` at most the number of words."""
        out = np.zeros(len(i), np.int64)
        need = _SHIFT[i % V, j % V]
        live = np.arange(len(i))
        for step in range(V):
            live = live[need[live] > step]
            if not len(live):
                break
            live = live[self.words[i[live] + step] == self.words[j[live] + step]]
            out[live] = step + 1
        # Those that were alike all the way to covered places go on from there.
        on = np.flatnonzero((out == need) & (j + need < self.n))
        on = on[self.words[i[on] + need[on]] == self.words[j[on] + need[on]]]
        if len(on):
            out[on] += self._sampled(i[on] + need[on], j[on] + need[on])
        return out

    def _sampled(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if self.samples is None:
            self.samples = self._sort()
        rank, table = self.samples
        a, b = rank[i // V, _SLOT[i % V]], rank[j // V, _SLOT[j % V]]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b)
        power = np.frexp(b - a + 1)[1] - 1
        out = np.empty(len(a), np.int64)
        for level in np.unique(power).tolist():
            own = power == level
            row = table[level]
            out[own] = np.minimum(row[a[own]], row[b[own] - (1 << level) + 1])
        return out

    def _sort(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Ranks of the covered suffixes, and the sparse table over their common prefixes."""
        blocks = -(-self.n // V)
        place = np.arange(blocks)[:, None] * V + np.array(COVER)[None, :]
        padded = np.concatenate([self.words, np.zeros(V, np.int64)])
        real = place < self.n
        rank = padded[place]
        for step in range(1, V):
            rank = _renumber(rank, padded[place + step])
        levels = [rank]  # equal at level k: the next 2^k blocks are alike
        size = 1
        while size < blocks and len(np.unique(rank[real])) < real.sum():
            later = np.zeros_like(rank)
            later[:-size] = rank[size:] + 1
            rank = _renumber(rank, later)
            levels.append(rank)
            size *= 2
        order = np.argsort(rank[real], kind="stable")
        at = place[real][order]
        numbers = np.zeros_like(rank)
        numbers[real] = np.argsort(order, kind="stable")
        x, y = at[:-1], at[1:]
        shared = np.zeros(len(x), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = (x + shared < self.n) & (y + shared < self.n)
            a, b = np.where(inside, x + shared, 0), np.where(inside, y + shared, 0)
            same = inside & (levels[k][a // V, _SLOT[a % V]] == levels[k][b // V, _SLOT[b % V]])
            shared[same] += V << k
        live = np.flatnonzero((x + shared < self.n) & (y + shared < self.n))
        for _ in range(V):
            live = live[padded[x[live] + shared[live]] == padded[y[live] + shared[live]]]
            if not len(live):
                break
            shared[live] += 1
        row = np.concatenate([[0], shared])
        table, size = [row], 1
        while 2 * size <= len(shared) + 1:
            row = np.minimum(row[:-size], row[size:])
            table.append(row)
            size *= 2
        return numbers, table


def _renumber(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Numbers in the order of the pairs, equal for equal pairs."""
    pair = first.astype(np.int64) * (int(second.max()) + 1) + second
    return np.unique(pair, return_inverse=True)[1].reshape(first.shape)


def _grids(n: int, last: int, step: int):
    """(places, periods) of the grids of all periods up to ``last``, some periods at a time."""
    period = 1
    while period <= last:
        # Places are never more than for the first period of the part.
        most = -(-n // (step * period))
        stop = min(last + 1, period + max(1, GRID // most))
        periods = np.arange(period, stop)
        counts = -(-(n - periods) // (step * periods))
        each = np.repeat(periods, counts)
        within = np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
        yield within * step * each, each
        period = stop


def find_runs(
    words: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period."""
    n = len(words)
    if min_exponent < 2:
        raise ValueError("runs repeat at least twice")
    none = np.zeros((0, 3), np.int64)
    if n < max(min_length, min_exponent):
        return none
    step = min_exponent - 1
    ahead, behind = CommonExtensions(words), CommonExtensions(words[::-1])
    found = [none]
    for at, period in _grids(n, n // min_exponent, step):
        same = words[at] == words[at + period]
        at, period = at[same], period[same]
        if not len(at):
            continue
        right = ahead(at, at + period)
        left = behind(n - at - period, n - at)
        length = left + right + period
        good = length >= np.maximum(min_length, min_exponent * period)
        rows = np.stack([(at - left)[good], length[good], period[good]], 1)
        if len(rows):
            found.append(np.unique(rows, axis=0))
    rows = np.concatenate(found)
    if not len(rows):
        return none
    # One stretch found with several periods: the smallest is the run's.
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay: all but those a run holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


def numbered(words: list) -> np.ndarray:
    """A number for each word, equal for equal words."""
    seen: dict = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


SCHEMA = (
    "doc_id string, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, "
    "collapsed string"
)


def collapse(
    documents: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT,
    rewrite: Rewrite | None = None,
) -> DataFrame:
    """(doc_id, n_words, runs, collapsed), one row per document.

    ``runs`` are by start, then period; ``collapsed`` are the words left when each run
    keeps its first period, joined by one space.  ``rewrite(doc_id as text, words)`` may
    give other words than those of the text.
    """
    kind = documents.schema["doc_id"].dataType
    narrow = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")

    def work(batches):
        for batch in batches:
            sizes, offsets, spans, texts = [], [0], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                # bytes.split parts at the same characters as the contract's words
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                if rewrite is not None:
                    words = rewrite(doc_id, words)
                runs = find_runs(numbered(words), min_length, min_exponent)
                if len(runs):
                    kept = kept_words(len(words), runs)
                    left = [w for w, k in zip(words, kept.tolist()) if k]
                else:
                    left = words
                sizes.append(len(words))
                spans.append(runs)
                offsets.append(offsets[-1] + len(runs))
                texts.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            every = np.concatenate(spans) if spans else np.zeros((0, 3), np.int64)
            rows = pa.StructArray.from_arrays(
                [pa.array(every[:, i]) for i in range(3)], names=["start", "length", "period"]
            )
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows), pa.array(texts, pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    return narrow.mapInArrow(work, SCHEMA).withColumn("doc_id", F.col("doc_id").cast(kind))


def strongest(runs: Column) -> Column:
    """The run of greatest length over period, compared without rounding; null without any.

    Runs come by start, then period, so the first of equals stays.
    """
    more = lambda best, run: (
        run["length"] * best["period"] > best["length"] * run["period"]
    )
    first = F.get(runs, 0)
    return F.reduce(runs, first, lambda best, run: F.when(more(best, run), run).otherwise(best))


def loop_tenth(doc_id: str | None, words: list) -> list:
    """Every tenth document, by its id's checksum, repeats a piece of itself to its end."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(doc_id.encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    again = -(-(n - a) // p)
    return words[:a] + (piece * again)[: n - a]


def digests(collapsed: DataFrame) -> DataFrame:
    """The runs and texts of :func:`collapse` as counts, the strongest run and checksums."""
    best = F.col("best")
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return collapsed.withColumn("best", strongest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
