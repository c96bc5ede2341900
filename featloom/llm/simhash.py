"""SimHash near-duplicates through an inverted index of the fingerprint's bytes.

A fingerprint has eight positional bytes.  Two that differ in at most ``d`` bits differ
in at most ``d`` bytes, so they share at least ``8 - d`` of them: the guaranteed
minimum of matches.  An index entry is a choice of that many positions with their
bytes, so every pair below an entry has already reached the minimum; it is counted
under each choice it shares, kept once (under the first choice), and verified bit by
bit.  What is left open under an entry is ``d`` bytes, so an entry has few distinct
fingerprints however large a group of near copies is; exact copies are one fingerprint.

Links make components by passing on the least label, with labels of labels followed at
each round; every round is written to the shared folder.

Defined cases: null and empty texts have fingerprint zero, linked like any other;
repeated rows are members of their own; a null doc_id takes part but never names a
component, which has a null id if no member has one; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.llm.common import fresh, text_key
from featloom.llm.url_filter import may_contain
from featloom.session import materialize

SHINGLE = 3
BITS = 2
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each set if it is in over half of the shingles' hashes."""
    if not text:
        return 0
    # bytes.lower and bytes.split know ASCII only, as the contract's words do
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    stops = ends[shingle - 1:].tolist()
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(stops)
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, fp) in Arrow batches; the fingerprint as a signed 64-bit number."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    narrow = documents.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))

    def work(batches):
        for batch in batches:
            texts = batch.column(1)
            prints = np.fromiter(
                (fingerprint(t.as_py(), shingle, seed) for t in texts), np.uint64, len(texts)
            )
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(prints.view(np.int64))], ["doc_id", "text_key", "fp"]
            )

    return narrow.mapInArrow(work, f"doc_id {kind}, text_key bigint, fp bigint")


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(0xFF))


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b), a < b: distinct fingerprints of column ``fp`` at ``bits`` or fewer bits."""
    if not 0 < bits < 8:
        raise ValueError("bits must be from 1 to 7")
    choices = list(combinations(range(8), 8 - bits))
    masks = [sum(0xFF << (8 * p) for p in choice) for choice in choices]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    entry = F.explode(
        F.array(*[
            F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bytes"))
            for i, m in enumerate(signed)
        ])
    )
    index = prints.select("fp", entry.alias("entry")).select("fp", "entry.choice", "entry.bytes")
    a = index.withColumnRenamed("fp", "a")
    b = index.withColumnRenamed("fp", "b")
    # Spark sizes the index as the prints it is exploded from, though it has a row for each
    # choice: without the hint it sends out a table that is many times as large as it takes it for.
    pairs = a.join(b.hint("merge"), ["choice", "bytes"]).where(F.col("a") < F.col("b"))
    same = [(_byte(F.col("a"), p) == _byte(F.col("b"), p)) for p in range(8)]
    shared = sum((s.cast("int") for s in same[1:]), same[0].cast("int"))
    first = F.lit(len(choices))
    for i in range(len(choices) - 1, -1, -1):
        fits = F.lit(True)
        for p in choices[i]:
            fits = fits & same[p]
        first = F.when(fits, F.lit(i)).otherwise(first)
    return pairs.where(
        (shared >= 8 - bits)
        & (first == F.col("choice"))
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    ).select("a", "b")


def components(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, root): the least fingerprint that each can reach over the links."""
    both = materialize(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))),
        "simhash-links",
    )
    labels = materialize(
        both.groupBy("a").agg(F.min("b").alias("near"))
        .select(F.col("a").alias("fp"), F.least("a", "near").alias("root")),
        "simhash-labels",
    )
    while True:
        near = (
            both.join(labels.select(F.col("fp").alias("b"), F.col("root").alias("r")), "b")
            .groupBy("a").agg(F.min("r").alias("near"))
        )
        lower = labels.join(near, F.col("fp") == F.col("a")).select(
            "fp", F.col("root").alias("old"), F.least("root", "near").alias("mid")
        )
        # The label of the label halves the way that is left.
        jump = labels.select(F.col("fp").alias("at"), F.col("root").alias("up"))
        new = materialize(
            lower.join(jump, F.col("mid") == F.col("at"), "left").select(
                "fp", "old", F.coalesce(F.least("mid", "up"), "mid").alias("root")
            ),
            "simhash-labels",
        )
        labels = new.select("fp", "root")
        if new.where(F.col("old") != F.col("root")).isEmpty():
            break
    return prints.join(labels.withColumnRenamed("fp", "f"), F.col("fp") == F.col("f"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def group(
    documents: DataFrame, shingle: int = SHINGLE, bits: int = BITS, seed: int = SEED
) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id), one row per document."""
    members = materialize(fingerprints(documents, shingle, seed), "simhash-prints")
    # Counted with a partial sum, so that a hot fingerprint is one row per task.
    distinct = materialize(
        members.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct"
    )
    edges = materialize(links(distinct.select("fp"), bits), "simhash-pairs")
    roots = materialize(components(distinct, edges), "simhash-roots")
    named = (
        distinct.join(roots.withColumnRenamed("fp", "f"), F.col("fp") == F.col("f"))
        .groupBy("root").agg(F.min("least").alias("component_id"))
    )
    by_print = roots.join(named, "root")
    return members.join(by_print, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def keep_first(
    documents: DataFrame, shingle: int = SHINGLE, bits: int = BITS, seed: int = SEED
) -> DataFrame:
    """Of each group one row, with all columns: the least id, of rows that share it the one
    of least text key.  Rows alike in both are one document.  Rows without an id stay as
    they are, but a group keeps a row with an id if it has one.

    Only rows of groups of two or more are moved: a bounded Bloom test tells which they may
    be, and the others stay where they are.
    """
    named = group(documents, shingle, bits, seed).where(F.col("doc_id").isNotNull())
    at = F.struct("doc_id", "text_key")
    groups = named.groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.min(at).alias("first"))
    several = groups.where("rows > 1").withColumnRenamed("root", "r")
    marks = materialize(
        named.join(several, F.col("root") == F.col("r"))
        .select("doc_id", "text_key", (F.col("first") == at).alias("kept")).distinct(),
        "simhash-marks",
    )
    key, mark, i, t = fresh(documents, "text_key", "kept", "mark_id", "mark_key")
    label = lambda a, b: F.concat_ws(":", F.col(a).cast("string"), F.col(b).cast("string"))
    keyed = documents.withColumn(key, text_key(F.col("text")))
    marked = F.coalesce(may_contain(marks.select(label("doc_id", "text_key").alias("key")), label("doc_id", key)), F.lit(False))
    marked = marked & F.col("doc_id").isNotNull()
    marks = marks.select(F.col("doc_id").alias(i), F.col("text_key").alias(t), F.col("kept").alias(mark))
    judged = keyed.where(marked).join(marks, (F.col("doc_id") == F.col(i)) & (F.col(key) == F.col(t)), "left")
    rest = judged.where(F.col(mark).isNull())
    first = judged.where(F.col(mark)).dropDuplicates(["doc_id", key])
    whole = [F.col(f"`{c}`") for c in documents.columns]
    return keyed.where(~marked).select(*whole).union(rest.select(*whole)).union(first.select(*whole))
