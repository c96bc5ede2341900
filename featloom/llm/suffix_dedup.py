"""Exact substring dedup by column-wise construction over a collection of strings.

The question: which bytes are covered by a string of ``length`` bytes that also starts
in a document with a smaller doc_id.  The method inserts one symbol per string each
round, from the last column to the first, and keeps the order of the collection's
suffixes (its Burrows-Wheeler order) and the common prefixes of neighbours up to date.
A round sorts the order stably by the new symbol; two neighbours that share it share one
symbol more than the least common prefix between their old places, any others none.
Neighbours sharing ``length`` symbols are one repeated string, and the least doc_id
among them is its first holder.

Whole documents would take as many rounds as the longest has bytes.  They are cut into
short pieces instead, so that equal strings meet and rounds are few:

1. Of the hashes of 16 bytes at each place, the least of every ``length``-byte string is
   an anchor.  It depends on that string alone, so equal strings have equal anchors at
   equal offsets.  Anchors go to a bucket by hash, packed, each with a hash of the piece
   around it (every ``length``-byte string that holds the anchor).
2. A bucket keeps anchors of two documents or more.  If all pieces around an anchor are
   alike, all but the first holder's are repeats through and through.
3. Pieces of the other anchors are sent, by anchor, to the column-wise construction.
   The tables between rounds of work (anchors, repeats, pieces, marks) are Spark's
   shuffle files and tables in the shared folder, written and read in sequence; only the
   order of one bucket of pieces is in a task's memory.

The number of buckets follows the bytes of the input, so a bucket stays small.  Text is
moved only for documents that have something to compare or remove.  Alike is: 96 bits of
hashes in step 2, the bytes themselves in step 3.

Defined cases: a null text is empty; a null doc_id is neither smaller nor larger than
another, so its bytes stay and no others go because of them; rows with one doc_id are no
repeats of each other; texts shorter than ``length`` bytes stay; an empty table gives no
rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.llm.common import text_key
from featloom.llm.url_filter import may_contain
from featloom.session import materialize

LENGTH = 50
GRAM = 16
BUCKET_BYTES = 32 << 20  # of text for each bucket
CHUNK = 1 << 20  # bytes of text hashed at once in a task
PIECES = 1 << 20  # pieces ordered at once in a task

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


# ---- bytes to anchors


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 16 bytes from each place on, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _P
    size = 1
    while size < GRAM:
        h ^= h >> np.uint64(29)
        h = (h[:-size] * _Q ^ h[size:]) * _P
        size *= 2
    return h ^ (h >> np.uint64(32))


def _slide(a: np.ndarray, width: int, best) -> np.ndarray:
    """Least or greatest of each window, by doubling."""
    cur, size = a, 1
    while size * 2 <= width:
        cur = best(cur[:-size], cur[size:])
        size *= 2
    n = len(a) - width + 1
    return best(cur[:n], cur[width - size :][:n])


def _between(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """True at the places of the half-open ranges."""
    marks = np.zeros(size + 1, np.int32)
    some = ends > starts
    np.add.at(marks, starts[some], 1)
    np.add.at(marks, ends[some], -1)
    return np.cumsum(marks[:-1]) > 0


def _piece_hash(pieces: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(pieces), -(-pieces.shape[1] // 8) * 8), np.uint8)
    wide[:, : pieces.shape[1]] = pieces
    h = (left.astype(np.uint64) << np.uint64(16) | right.astype(np.uint64)) * _P
    for word in wide.view(np.uint64).T:
        h = (h ^ word) * _Q
        h ^= h >> np.uint64(31)
        h *= _P
    return h ^ (h >> np.uint64(32))


def anchors(parts: list[tuple[int, bytes, int, int, int]], length: int):
    """Anchors of document parts (document number, bytes, place of the first byte, and
    the range of places whose anchors count).

    Returns the document number, the place in the document, the anchor's hash, and
    buffer places and the padded buffer for cutting pieces.
    """
    reach = length - GRAM
    gap = length + reach
    sizes = np.array([len(p[1]) for p in parts], np.int64)
    starts = np.cumsum(sizes + gap) - sizes
    ends = starts + sizes
    data = np.zeros(int(ends[-1]) + gap, np.uint8)
    for (_, part, _, _, _), at in zip(parts, starts.tolist()):
        data[at : at + len(part)] = np.frombuffer(part, np.uint8)
    hashes = gram_hashes(data)
    order = (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = _slide(order, reach + 1, np.minimum)
    least[~_between(starts, ends - length + 1, len(least))] = 0
    pad = np.zeros(reach, np.uint32)
    most = _slide(np.concatenate([pad, least, pad]), reach + 1, np.maximum)[: len(order)]
    core = np.array([(p[3] - p[2], p[4] - p[2]) for p in parts], np.int64)
    counts = _between(starts + core[:, 0], starts + core[:, 1], len(order))
    at = np.flatnonzero((most == order) & counts)
    part = np.searchsorted(starts, at, "right") - 1
    number = np.array([p[0] for p in parts], np.int64)[part]
    place = at - starts[part] + np.array([p[2] for p in parts], np.int64)[part]
    return number, place, hashes[at], at, data


def cut(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The bytes around each anchor that some ``length``-byte string with it can hold."""
    reach = length - GRAM
    return np.lib.stride_tricks.sliding_window_view(data, length + reach)[at - reach]


def _parts(text: bytes, length: int) -> list[tuple[bytes, int, int, int]]:
    """A document, or overlapping parts of a long one that see the same anchors: bytes,
    place of the first, and the range of places whose anchors count."""
    if len(text) <= CHUNK:
        return [(text, 0, 0, len(text))]
    side = 2 * length
    return [
        (text[max(0, a - side) : a + CHUNK + side], max(0, a - side), a, min(a + CHUNK, len(text)))
        for a in range(0, len(text), CHUNK)
    ]


def _six(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _by_bucket(bucket: np.ndarray):
    """(bucket, places) of each bucket that occurs, places in order."""
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    return zip(found.tolist(), np.split(order, first[1:]))


_PACKED = "bucket int, ids binary, keys binary, number binary, place binary, anchor binary, piece binary"


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _packer(length: int, buckets: int):
    """Documents to packed anchors, in rows of one bucket."""
    reach = length - GRAM
    names = [c.split()[0] for c in _PACKED.split(", ")]
    kinds = [pa.int32(), *[pa.binary()] * 6]

    def flush(docs, parts):
        number, place, h, at, data = anchors(parts, length)
        sizes = np.array([d[2] for d in docs], np.int64)[number]
        left, right = np.minimum(place, reach), np.minimum(sizes - place, length)
        pieces = _piece_hash(cut(data, at, length), left, right)
        ids, keys = np.array([d[0] for d in docs], np.int64), np.array([d[1] for d in docs], np.int64)
        rows = []
        for bucket, own in _by_bucket((h >> np.uint64(40)).astype(np.int64) % buckets):
            docs_here, local = np.unique(number[own], return_inverse=True)
            rows.append((
                bucket, ids[docs_here].tobytes(), keys[docs_here].tobytes(),
                local.astype("<u2").tobytes(), place[own].astype("<u4").tobytes(), _six(h[own]), _six(pieces[own]),
            ))
        return _batch(rows, names, kinds)

    def work(batches):
        docs, parts, held = [], [], 0
        for batch in batches:
            for doc_id, key, text in zip(*(batch.column(i) for i in range(3))):
                text = text.as_py()
                doc = (doc_id.as_py(), key.as_py(), len(text))
                for part in _parts(text, length):
                    if not docs or docs[-1] is not doc:
                        docs.append(doc)
                    parts.append((len(docs) - 1, *part))
                    held += len(part[0])
                    if held >= CHUNK:
                        yield flush(docs, parts)
                        docs, parts, held = [], [], 0
        if parts:
            yield flush(docs, parts)

    return work


# ---- anchors to repeats


# Entries of documents on the way home: a place and a mark each.  Packed by the document's
# own bucket, so that their rows follow the buckets and not documents times buckets.
_HOME = "bucket int, ids binary, keys binary, number binary, place binary, mark binary"
_FOUND = "doc_id bigint, text_key bigint, places array<int>, marks array<bigint>"
WHOLE, OPEN = -1, 0  # every string around the place goes; not known yet


def _send_home(ids, keys, doc, place, mark, buckets: int) -> pa.RecordBatch:
    names = [c.split()[0] for c in _HOME.split(", ")]
    h = (ids.astype(np.uint64) * _P ^ keys.astype(np.uint64)) * _Q
    home = ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)[doc]
    rows = []
    for bucket, own in _by_bucket(home):
        docs_here, local = np.unique(doc[own], return_inverse=True)
        rows.append((
            bucket, ids[docs_here].tobytes(), keys[docs_here].tobytes(), local.astype("<u4").tobytes(),
            place[own].astype("<u4").tobytes(), mark[own].astype("<i8").tobytes(),
        ))
    return _batch(rows, names, [pa.int32(), *[pa.binary()] * 5])


def _at_home(rows: list[list]):
    """One row per document of a home bucket, with all its entries."""
    ids, keys, doc, place, mark = _join_rows(rows, [_i8, _i8, _u4, _u4, _i8])
    same = np.lexsort((keys, ids))
    new = np.concatenate([[True], (ids[same][1:] != ids[same][:-1]) | (keys[same][1:] != keys[same][:-1])])
    one = np.empty(len(ids), np.int64)
    one[same] = np.cumsum(new) - 1
    order = np.argsort(one[doc], kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(one[doc], minlength=int(new.sum())))])
    offsets = pa.array(offsets.astype(np.int32))
    yield pa.record_batch(
        [pa.array(ids[same][new]), pa.array(keys[same][new]),
         pa.ListArray.from_arrays(offsets, pa.array(place[order].astype(np.int32))),
         pa.ListArray.from_arrays(offsets, pa.array(mark[order]))],
        ["doc_id", "text_key", "places", "marks"],
    )


def _join_rows(rows: list[list], fields: list) -> list[np.ndarray]:
    """Columns of the rows put together; document numbers go on from row to row."""
    base, out = 0, [[] for _ in fields]
    for row in rows:
        for i, read in enumerate(fields):
            values = read(row[i])
            out[i].append(values + base if i == 2 else values)
        base += len(out[0][-1])
    return [np.concatenate(c) for c in out]


def _i8(data):
    return np.frombuffer(data, np.int64)


def _u4(data):
    return np.frombuffer(data, "<u4").astype(np.int64)


def _repeats(rows: list[list], buckets: int):
    """Entries of one bucket of packed anchors that two documents or more have."""
    ids, keys, doc, place, anchor, piece = _join_rows(rows, [
        _i8, _i8, lambda d: np.frombuffer(d, "<u2").astype(np.int64),
        _u4, _from_six, _from_six,
    ])
    order = np.argsort(anchor, kind="stable")
    ordered = anchor[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(ordered)]]))
    holder, around = ids[doc[order]], piece[order]
    least = np.minimum.reduceat(holder, first)
    several = least < np.maximum.reduceat(holder, first)
    alike = np.minimum.reduceat(around, first) == np.maximum.reduceat(around, first)
    full = order[np.repeat(several & alike, sizes) & (holder > np.repeat(least, sizes))]
    unclear = order[np.repeat(several & ~alike, sizes)]
    entries = np.concatenate([full, unclear])
    mark = np.repeat([WHOLE, OPEN], [len(full), len(unclear)])
    yield _send_home(ids, keys, doc[entries], place[entries], mark, buckets)


def _per_bucket(handle):
    """Runs ``handle`` on all rows of each bucket that a task was dealt."""

    def work(batches):
        held: dict[int, list] = {}
        for batch in batches:
            columns = [batch.column(i) for i in range(1, batch.num_columns)]
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                held.setdefault(bucket, []).append([c[i].as_py() for c in columns])
        for bucket in sorted(held):
            yield from handle(held.pop(bucket))

    return work


# ---- pieces to marks


def column_order(pieces: np.ndarray, length: int):
    """Inserts a column a round, from the last; yields each column with the order of the
    suffixes that begin there and the common prefix of each with the one before it, cut
    off at ``length``."""
    m, width = pieces.shape
    columns = np.ascontiguousarray(pieces.T)
    order = np.arange(m)
    shared = np.full(m, 0, np.uint8)  # empty suffixes share nothing yet
    for column in range(width - 1, -1, -1):
        symbols = columns[column][order]
        moved = np.argsort(symbols, kind="stable")
        symbols = symbols[moved]
        before, after = moved[:-1], moved[1:]
        same = symbols[1:] == symbols[:-1]
        now = np.zeros(m, np.uint8)
        a, b = before[same] + 1, after[same]
        now[1:][same] = np.minimum(_range_least(shared, a, b), length - 1) + 1
        order, shared = order[moved], now
        yield column, order, shared


def _range_least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of ``values[a..b]``, both ends included, for each pair."""
    out = np.empty(len(a), values.dtype)
    span = b - a + 1
    power = np.frexp(span)[1] - 1
    table, size = values, 1
    top = int(power.max()) if len(power) else -1
    for level in range(top + 1):
        own = np.flatnonzero(power == level)
        if len(own):
            out[own] = np.minimum(table[a[own]], table[b[own] - size + 1])
        if level < top:
            table = np.minimum(table[:-size], table[size:])
            size *= 2
    return out


def mark_repeats(
    pieces: np.ndarray, holder: np.ndarray, left: np.ndarray, right: np.ndarray, length: int
) -> np.ndarray:
    """For each piece, a bit per string in it that a smaller holder has as well.

    Bit ``c`` is the string that begins at column ``c``; strings that would reach over
    an end of the document are none.
    """
    reach = length - GRAM
    marks = np.zeros(len(pieces), np.int64)
    nobody = np.iinfo(np.int64).max
    for column, order, shared in column_order(pieces, length):
        if column > reach:
            continue
        real = (column >= reach - left) & (column + length <= reach + right)
        first = np.flatnonzero(shared < length)
        sizes = np.diff(np.concatenate([first, [len(order)]]))
        owner = np.where(real, holder, nobody)[order]
        least = np.repeat(np.minimum.reduceat(owner, first), sizes)
        later = order[real[order] & (owner > least)]
        marks[later] |= np.int64(1) << np.int64(column)
    return marks


_PIECES = "bucket int, ids binary, keys binary, number binary, place binary, sides binary, bodies binary"


def _cutter(length: int, buckets: int):
    """Documents and places of anchors to packed pieces, in rows of one bucket."""
    reach, width = length - GRAM, 2 * length - GRAM
    names = [c.split()[0] for c in _PIECES.split(", ")]
    kinds = [pa.int32(), *[pa.binary()] * 6]

    def flush(docs, number, place, sides, bodies):
        number, place = np.concatenate(number), np.concatenate(place)
        sides, bodies = np.concatenate(sides), np.concatenate(bodies)
        ids, keys = np.array([d[0] for d in docs], np.int64), np.array([d[1] for d in docs], np.int64)
        grams = np.ascontiguousarray(bodies[:, reach : reach + GRAM]).view(np.uint64)
        h = (grams[:, 0] * _P ^ (grams[:, 1] >> np.uint64(7))) * _Q ^ grams[:, 1] * _P
        rows = []
        for bucket, own in _by_bucket(((h ^ (h >> np.uint64(33))) % np.uint64(buckets)).astype(np.int64)):
            docs_here, local = np.unique(number[own], return_inverse=True)
            rows.append((
                bucket, ids[docs_here].tobytes(), keys[docs_here].tobytes(), local.astype("<u4").tobytes(),
                place[own].astype("<u4").tobytes(), sides[own].tobytes(), bodies[own].tobytes(),
            ))
        return _batch(rows, names, kinds)

    def work(batches):
        held, count = ([], [], [], [], []), 0
        for batch in batches:
            for doc_id, key, text, places, marks in zip(*(batch.column(i) for i in range(5))):
                data = np.frombuffer(text.as_py(), np.uint8)
                at = np.unique(_numbers(places)[_numbers(marks) == OPEN]).astype(np.int64)
                padded = np.concatenate([np.zeros(reach, np.uint8), data, np.zeros(length, np.uint8)])
                # parts of the places, so that a very long text needs no matrix of its own
                for a in range(0, len(at), 1 << 15):
                    part = at[a : a + (1 << 15)]
                    held[0].append((doc_id.as_py(), key.as_py()))
                    held[1].append(np.full(len(part), len(held[0]) - 1))
                    held[2].append(part)
                    held[3].append(np.stack(
                        [np.minimum(part, reach), np.minimum(len(data) - part, length)], 1
                    ).astype(np.uint8))
                    held[4].append(np.lib.stride_tricks.sliding_window_view(padded, width)[part])
                    count += len(part)
                    if count >= 1 << 16:
                        yield flush(*held)
                        held, count = ([], [], [], [], []), 0
        if count:
            yield flush(*held)

    return work


def _marker(length: int, buckets: int):
    width = 2 * length - GRAM
    reach = length - GRAM

    def handle(rows):
        ids, keys, doc, place, sides, bodies = _join_rows(rows, [
            _i8, _i8, _u4,
            _u4,
            lambda d: np.frombuffer(d, np.uint8).reshape(-1, 2).astype(np.int64),
            lambda d: np.frombuffer(d, np.uint8).reshape(-1, width),
        ])
        marks = np.zeros(len(doc), np.int64)
        turns = -(-len(doc) // PIECES)
        # Pieces of one anchor stay together; each turn orders some of the anchors.
        grams = np.ascontiguousarray(bodies[:, reach : reach + GRAM]).view(np.uint64)
        share = (((grams[:, 0] ^ grams[:, 1] * _P) * _Q) >> np.uint64(20)) % np.uint64(turns)
        for turn in range(turns):
            own = np.flatnonzero(share == turn)
            if len(own) > 1:
                marks[own] = mark_repeats(bodies[own], ids[doc[own]], sides[own, 0], sides[own, 1], length)
        hit = np.flatnonzero(marks)
        yield _send_home(ids, keys, doc[hit], place[hit], marks[hit], buckets)

    return handle


def removed_bytes(size: int, full, at, marks, length: int) -> np.ndarray:
    """Which bytes of a document go: around full anchors, and of each marked string."""
    reach = length - GRAM
    edges = np.zeros(size + 1, np.int32)
    full = np.asarray(full, np.int64)
    np.add.at(edges, np.maximum(full - reach, 0), 1)
    np.add.at(edges, np.minimum(full + length, size), -1)
    at, marks = np.asarray(at, np.int64), np.asarray(marks, np.int64)
    if len(at):
        piece, column = np.nonzero((marks[:, None] >> np.arange(reach + 1)) & 1)
        start = np.unique(at[piece] - reach + column)
        edges[start] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) > 0


def _numbers(cell) -> np.ndarray:
    return cell.values.to_numpy() if cell.is_valid else np.empty(0, np.int64)


def dedup(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per document."""
    if not GRAM <= length <= 16 + 62:
        raise ValueError(f"length must be from {GRAM} to {GRAM + 62}")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), body.alias("body")
    )
    size = F.octet_length("body")
    total = docs.agg(F.sum(size.cast("long"))).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))
    long_enough = docs.where(F.col("doc_id").isNotNull() & (size >= length))

    def by_bucket(packed: DataFrame, handle, schema: str) -> DataFrame:
        dealt = packed.repartitionById(buckets, F.col("bucket"))
        return dealt.mapInArrow(_per_bucket(handle), schema)

    packed = long_enough.mapInArrow(_packer(length, buckets), _PACKED)
    sent = by_bucket(packed, lambda rows: _repeats(rows, buckets), _HOME)
    found = materialize(by_bucket(sent, _at_home, _FOUND), "substring-anchors")

    key = ["doc_id", "text_key"]
    unclear = found.where(F.array_contains("marks", F.lit(OPEN).cast("long")))
    pieces = _with_text(long_enough, unclear).select(*key, "body", "places", "marks")
    pieces = pieces.dropDuplicates(key).mapInArrow(_cutter(length, buckets), _PIECES)
    marked = by_bucket(by_bucket(pieces, _marker(length, buckets), _HOME), _at_home, _FOUND)
    marked = marked.select(*key, F.col("places").alias("at"), F.col("marks").alias("bits"))
    whole = found.where(F.array_contains("marks", F.lit(WHOLE).cast("long")))
    gone = materialize(whole.join(marked, key, "full_outer"), "substring-marks")

    def remove(batches):
        for batch in batches:
            rows = []
            for body, places, marks, at, bits in zip(*(batch.column(i) for i in range(2, 7))):
                data = np.frombuffer(body.as_py(), np.uint8)
                full = _numbers(places)[_numbers(marks) == WHOLE]
                off = removed_bytes(len(data), full, _numbers(at), _numbers(bits), length)
                runs = int(np.diff(np.concatenate([[0], off.astype(np.int8)])).clip(0).sum())
                rows.append((int(off.sum()), runs, hashlib.sha256(data[~off].tobytes()).hexdigest()))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], k)
                 for i, k in enumerate((pa.int64(), pa.int64(), pa.string())))],
                ["d", "t", "removed", "spans", "sha"],
            )

    cleaned = _with_text(long_enough, gone).select(*key, "body", "places", "marks", "at", "bits")
    cleaned = materialize(
        cleaned.dropDuplicates(key).mapInArrow(remove, "d bigint, t bigint, removed bigint, spans bigint, sha string"),
        "substring-kept",
    )
    every = docs.select(*key, size.cast("long").alias("n_bytes"), F.sha2("body", 256).alias("whole"))
    zero = F.lit(0).cast("long")
    return every.join(
        cleaned, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left"
    ).select(
        "doc_id", "n_bytes", F.coalesce("removed", zero).alias("n_removed"),
        F.coalesce("spans", zero).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"),
    )


def _with_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of the wanted rows; most others are left out before the exchange."""
    ids = wanted.select(F.col("doc_id").cast("string").alias("key")).distinct()
    likely = docs.where(may_contain(ids, F.col("doc_id").cast("string")))
    return likely.join(wanted, ["doc_id", "text_key"])
