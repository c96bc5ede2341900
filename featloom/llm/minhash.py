"""MinHash near-duplicates: banded candidates, sequential Bayesian verification, exact check.

A document's set is its distinct shingles as 64-bit hashes; documents with equal sets are
one class from the start.  A signature holds the least value of the set under each of
``HASHES`` hash functions; ``ROWS`` of them make a band, and two sets that agree in a band
are a candidate.  At similarity 0.8 a pair misses all 32 bands with a chance of 3e-6.

A candidate's signatures are compared batch by batch.  After ``n`` places with ``m``
matches the similarity has, from a flat prior, a Beta(m + 1, n - m + 1) posterior; a
candidate goes as soon as the posterior chance of reaching the threshold is below
``MISS``.  Survivors are checked exactly on their full sets.

A group of ``k`` near copies has ``k * k / 2`` candidates, but only components are asked
for, so they are not all looked at:

1. Every set is compared with the hub of each of its bands: the member that shares most
   bands with others.  Hub and set are one comparison, however many bands they share.
   The links found make components.
2. Around each hub, sets outside its largest component are compared with all sets around
   it of other components, block against block, if they agree in a band.  A candidate of
   two components is in one band, so both its sets are around that band's hub: after this
   step no candidate between components is left unseen.

Both steps work on tasks of two bounded blocks of texts (at most ``BLOCK_SETS`` sets and
about ``BLOCK_WEIGHT`` shingles each), dealt by task, so a hot group is many tasks.
Results of steps are written to the shared folder.

Defined cases: a null text, or one without words, has an empty set, is linked with nothing
and is its own component; repeated rows are members of their own; a null doc_id takes part
but never names a component, which has a null id if no member has one; ties for a hub go to
the greater set key and change no result; an empty table gives no rows; columns other than
``doc_id`` and ``text`` are not read.  Whole texts of any length are used.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.llm.common import text_key
from featloom.llm.simhash import components
from featloom.llm.url_filter import may_contain
from featloom.session import materialize

SHINGLE = 2
PERCENT = 80  # least similarity
HASHES = 160
ROWS = 5  # signature places in a band
BATCH = 32  # signature places compared at once
MISS = 1e-6  # chance of a good pair to be pruned
BLOCK_SETS = 128
BLOCK_WEIGHT = 1 << 18  # shingles

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 16  # shingles signed at once
_MULTIPLIERS = (
    np.random.default_rng(20).integers(0, 1 << 63, HASHES, dtype=np.uint64) << np.uint64(1)
) | np.uint64(1)


# ---- sets and signatures


class _WordHashes(dict):
    """Word to hash, computed once while it is remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 20:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _Q
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, shingle: int, words: _WordHashes) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; of all words if they are fewer."""
    # bytes.lower and bytes.split know ASCII only, as the contract's words do
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    size = min(shingle, len(parts))
    count = len(parts) - size + 1
    h = np.full(count, size, np.uint64)
    for i in range(size):
        h = _mixed(h * _P + hashes[i : i + count])
    return np.unique(h)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``HASHES`` least values for each set; none may be empty."""
    out = np.empty((len(sets), HASHES), np.uint32)
    at = 0
    while at < len(sets):
        stop, size = at, 0
        while stop < len(sets) and (stop == at or size + len(sets[stop]) <= _CHUNK):
            size += len(sets[stop])
            stop += 1
        every = sets[at] if stop == at + 1 else np.concatenate(sets[at:stop])
        starts = np.cumsum([0, *map(len, sets[at : stop - 1])])
        room = np.empty_like(every)
        for k in range(HASHES):
            np.multiply(every, _MULTIPLIERS[k], out=room)
            out[at:stop, k] = np.minimum.reduceat(room, starts) >> np.uint64(32)
        at = stop
    return out


def band_keys(signed: np.ndarray) -> np.ndarray:
    """A hash of each band of each row; it holds the band's number."""
    bands = HASHES // ROWS
    parts = signed.reshape(len(signed), bands, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        h = _mixed(h * _P + parts[:, :, i])
    return h.view(np.int64)


_PRINTS = "doc_id string, text_key bigint, n bigint, set_key binary, bands array<bigint>"


def _printer(shingle: int):
    def work(batches):
        words = _WordHashes()
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle, words) for t in batch.column(2)]
            sizes = [len(s) for s in sets]
            full = [s for s in sets if len(s)]
            bands = band_keys(signatures(full)) if full else np.empty((0, HASHES // ROWS), np.int64)
            ends = np.cumsum([0, *[bands.shape[1] * (n > 0) for n in sizes]])
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bands.ravel()))],
                ["doc_id", "text_key", "n", "set_key", "bands"],
            )

    return work


# ---- verification


def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """For each batch, the matches so far below which a candidate goes.

    The posterior chance of a similarity of ``t`` or more, after ``m`` of ``n`` matches, is
    the chance of at most ``m`` successes in ``n + 1`` trials of chance ``t``.
    """
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append(m)
    return out


def similar(
    one: np.ndarray, signed: np.ndarray, others: list[np.ndarray], other_signed: np.ndarray,
    least: list[int], percent: int, banded: bool,
) -> np.ndarray:
    """Places of the others at ``percent`` or more; ``banded`` keeps to those with a band in common."""
    alive = np.arange(len(others))
    if banded:
        same = (other_signed == signed).reshape(len(others), -1, ROWS)
        alive = np.flatnonzero(same.all(axis=2).any(axis=1))
    matches = np.zeros(len(others), np.int64)
    for i, enough in enumerate(least):
        part = slice(i * BATCH, (i + 1) * BATCH)
        matches[alive] += (other_signed[alive, part] == signed[part]).sum(axis=1)
        alive = alive[matches[alive] >= enough]
    if not len(alive):
        return alive
    sizes = np.array([len(others[i]) for i in alive])
    every = np.concatenate([others[i] for i in alive])
    at = np.minimum(np.searchsorted(one, every), len(one) - 1)
    shared = np.add.reduceat((one[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)
    return alive[100 * shared >= percent * (len(one) + sizes - shared)]


_TASK = "task_hub binary, task_row int, task_column int, side int, id binary, root binary, text string"
_LINKS = "a binary, b binary"


def _comparer(shingle: int, percent: int, miss: float, banded: bool):
    least = least_matches(percent, miss)

    def links(left: list[tuple], right: list[tuple], words) -> list[tuple]:
        sets = [shingle_set(r[2], shingle, words) for r in left + right]
        signed = signatures(sets)
        others, other_signed = sets[len(left):], signed[len(left):]
        out = []
        for i, (id_, root, _) in enumerate(left):
            wanted = np.flatnonzero([r[1] != root for r in right])
            if not len(wanted):
                continue
            found = similar(
                sets[i], signed[i], [others[j] for j in wanted], other_signed[wanted], least, percent, banded
            )
            out += [(id_, right[j][0]) for j in wanted[found]]
        return out

    def work(batches):
        """Rows come sorted by task, the left side first; one task is held at a time."""
        words, task, sides = _WordHashes(), None, ([], [])
        for batch in batches:
            for *key, side, id_, root, text in zip(*(batch.column(i) for i in range(7))):
                key = tuple(k.as_py() for k in key)
                if key != task:
                    if sides[0] and sides[1]:
                        yield _pairs(links(*sides, words))
                    task, sides = key, ([], [])
                sides[side.as_py()].append((id_.as_py(), root.as_py(), text.as_py()))
        if sides[0] and sides[1]:
            yield _pairs(links(*sides, words))

    return work


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], ["a", "b"])


def _compare(
    tasks: DataFrame, texts: DataFrame, shingle: int, percent: int, miss: float, banded: bool
) -> DataFrame:
    """Links found by tasks (task_hub, task_row, task_column, side, id, root)."""
    wanted = tasks.select("id").distinct()
    filled = tasks.join(_texts_of(texts, wanted), "id").select([c.split()[0] for c in _TASK.split(", ")])
    key = ["task_hub", "task_row", "task_column"]
    dealt = filled.repartition(*key).sortWithinPartitions(*key, "side")
    return dealt.mapInArrow(_comparer(shingle, percent, miss, banded), _LINKS)


def _texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text) of the wanted classes; most other texts are left out before the exchange."""
    documents, holders = texts
    held = holders.join(wanted, "id", "left_semi")
    keys = held.select(F.col("at.text_key").cast("string").alias("key"))
    likely = documents.where(may_contain(keys, F.col("text_key").cast("string")))
    return likely.join(
        held.select("id", F.col("at.doc_id").alias("d"), F.col("at.text_key").alias("t")),
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")),
    ).select("id", "text").dropDuplicates(["id"])


# ---- candidates


def hub_pairs(classes: DataFrame) -> DataFrame:
    """(hub, id): each class of (id, bands) with the hubs of its bands."""
    rows = classes.select("id", F.explode("bands").alias("band"))
    several = (
        rows.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        .withColumnRenamed("band", "key")
    )
    shared = materialize(
        rows.join(several, F.col("band") == F.col("key")).select("id", "band", "members"), "minhash-bands"
    )
    central = shared.groupBy("id").agg(F.sum("members").alias("shares")).withColumnRenamed("id", "i")
    scored = materialize(
        shared.join(central, F.col("id") == F.col("i")).select("id", "band", "shares"), "minhash-shares"
    )
    hubs = scored.groupBy("band").agg(F.max(F.struct("shares", "id")).alias("best")).select(
        F.col("band").alias("key"), F.col("best.id").alias("hub")
    )
    pairs = scored.join(hubs, F.col("band") == F.col("key")).where("hub <> id")
    return pairs.select("hub", "id").distinct()


def _blocks(rows: F.Column, weight: F.Column) -> F.Column:
    return F.greatest(
        F.ceil(rows / BLOCK_SETS), F.ceil(weight / BLOCK_WEIGHT)
    ).cast("int")


def _own_block(count: str) -> F.Column:
    return F.pmod(F.xxhash64("id", F.lit(5)), F.col(count)).cast("int")


def _hub_tasks(pairs: DataFrame) -> DataFrame:
    """Each hub against the blocks of its sets."""
    sizes = pairs.groupBy("hub").agg(
        _blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks")
    ).withColumnRenamed("hub", "h")
    rights = pairs.join(sizes, F.col("hub") == F.col("h")).select(
        "hub", _own_block("blocks").alias("task_column"), F.lit(1).alias("side"), "id"
    )
    lefts = rights.select("hub", "task_column").distinct().select(
        "hub", "task_column", F.lit(0).alias("side"), F.col("hub").alias("id")
    )
    return lefts.unionByName(rights).select(
        F.col("hub").alias("task_hub"), F.lit(0).alias("task_row"), "task_column", "side", "id",
        F.col("id").alias("root"),
    )


def _rest_tasks(around: DataFrame) -> DataFrame:
    """Around each hub, blocks of the sets outside its largest component against all blocks."""
    by_root = around.groupBy("hub", "root").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("weight")
    )
    largest = F.max(F.struct("rows", "weight", "root"))
    sizes = by_root.groupBy("hub").agg(
        largest.alias("main"), F.sum("rows").alias("rows"), F.sum("weight").alias("weight"),
        F.count(F.lit(1)).alias("roots"),
    ).where("roots > 1").select(
        F.col("hub").alias("h"), F.col("main.root").alias("main"),
        _blocks(F.col("rows"), F.col("weight")).alias("columns"),
        _blocks(F.col("rows") - F.col("main.rows"), F.col("weight") - F.col("main.weight")).alias("lines"),
    )
    open_ = around.join(sizes, F.col("hub") == F.col("h"))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    rights = open_.select(
        F.col("hub").alias("task_hub"), every("lines").alias("task_row"),
        _own_block("columns").alias("task_column"), F.lit(1).alias("side"), "id", "root",
    )
    lefts = open_.where(F.col("root") != F.col("main")).select(
        F.col("hub").alias("task_hub"), _own_block("lines").alias("task_row"),
        every("columns").alias("task_column"), F.lit(0).alias("side"), "id", "root",
    )
    return lefts.unionByName(rights)


# ---- groups


def group(
    documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, miss: float = MISS
) -> DataFrame:
    """(doc_id, n_shingles, set_key, component_id, kept), one row per document."""
    if not 0 < percent <= 100 or shingle < 1:
        raise ValueError("percent must be from 1 to 100, shingle at least 1")
    kind = documents.schema["doc_id"].dataType
    docs = documents.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    narrow = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text_key", "text")
    prints = materialize(
        narrow.mapInArrow(_printer(shingle), _PRINTS).withColumn("doc_id", F.col("doc_id").cast(kind)),
        "minhash-prints",
    )
    # Counted with partial results, so that a hot set is one row per task.
    classes = materialize(
        prints.where("n > 0").groupBy(F.col("set_key").alias("id")).agg(
            F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_key")).alias("at"),
            F.first("n").alias("n"), F.first("bands").alias("bands"),
        ),
        "minhash-classes",
    )
    sizes = classes.select(F.col("id").alias("i"), "n")
    pairs = materialize(
        hub_pairs(classes.select("id", "bands")).join(sizes, F.col("id") == F.col("i")).select("hub", "id", "n"),
        "minhash-pairs",
    )
    texts = (docs, classes.select("id", "at"))
    near = materialize(_compare(_hub_tasks(pairs), texts, shingle, percent, miss, False), "minhash-near")
    members = pairs.select("id").union(pairs.select("hub")).distinct().withColumnRenamed("id", "fp")
    roots = materialize(components(members, near), "minhash-roots")

    hubs = pairs.select("hub").distinct().join(sizes, F.col("hub") == F.col("i"))
    around = pairs.unionByName(hubs.select("hub", F.col("hub").alias("id"), "n"))
    around = around.join(roots, F.col("id") == F.col("fp")).select("hub", "id", "n", "root")
    tasks = materialize(_rest_tasks(around), "minhash-tasks")
    if not tasks.isEmpty():
        rest = _compare(tasks, texts, shingle, percent, miss, True)
        of = lambda side: roots.select(F.col("fp").alias(side), F.col("root").alias(f"root_{side}"))
        merged = materialize(
            rest.join(of("a"), "a").join(of("b"), "b").select(
                F.col("root_a").alias("a"), F.col("root_b").alias("b")
            ).distinct(),
            "minhash-rest",
        )
        joined = components(roots.select(F.col("root").alias("fp")).distinct(), merged)
        roots = materialize(
            roots.join(joined.select(F.col("fp").alias("r"), F.col("root").alias("last")), F.col("root") == F.col("r"))
            .select("fp", F.col("last").alias("root")),
            "minhash-roots",
        )

    labelled = classes.join(roots, F.col("id") == F.col("fp"), "left").select(
        "id", "least", F.coalesce("root", "id").alias("root")
    )
    named = labelled.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    by_set = labelled.join(named, F.col("root") == F.col("r")).select("id", "component_id")
    found = prints.join(by_set, F.col("set_key") == F.col("id"), "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), "set_key", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
