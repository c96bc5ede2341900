"""Mixing sources to target weights: exact budgets cut from a hash-random order.

Every document gets a random key from its id.  Rows are range-sorted by source and
key, so that a source of any size is dealt over many tasks; token counts are summed
within each part, and part totals are carried forward per source.  A source's budget
then cuts the order at one place: documents before it are taken whole, the one across
it in part, and a budget above the source's size takes whole epochs first.

Defined cases: a null text has size 0; a null source is one source, last in order;
repeated rows are documents of their own; sources without a word have target 0; an
empty table gives an empty mix.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from featloom.llm.common import WORDS, global_rank, range_sorted
from featloom.session import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2


def words_of(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most_epochs: int = MOST_EPOCHS,
) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Weights repeat over the sources in code point order, null last.  Targets share
    ``share`` of all sizes by weight; what is above ``most_epochs`` times a source's
    size goes to the others by weight until none is above.  One row of sums comes to
    the driver each time round; at least one more source reaches its limit each time.
    """
    totals = materialize(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes"
    )
    order = [F.col("source").isNull(), F.col("source")]
    ranked = global_rank(totals, order, "source-order", "rank")
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")
    )
    limits = materialize(
        ranked.select(
            "source", "source_size", weight.alias("weight"),
            (F.col("source_size") * most_epochs).alias("limit"),
        ),
        "source-limits",
    )
    total = limits.agg(F.sum("source_size")).first()[0] or 0
    left, shared = share * total, None
    full = F.lit(False)
    while True:
        row = limits.agg(
            F.sum(F.when(full, F.col("limit"))).alias("limited"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
        ).first()
        new = (share * total - (row.limited or 0), row.weight or 1)
        if new == (left, shared):
            break
        left, shared = new
        full = F.col("limit") < F.lit(left) * F.col("weight") / F.lit(shared)
    target = F.when(full, F.col("limit").cast("double")).otherwise(
        F.lit(float(left)) * F.col("weight") / F.lit(shared)
    )
    return limits.select("source", "source_size", target.alias("target"))


def mix(
    documents: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most_epochs: int = MOST_EPOCHS,
    seed: str = "mix",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), one row per document."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    rows = documents.select(
        "doc_id", "source", words_of(F.col("text")).alias("size"), key.alias("key")
    )
    order = [F.col("source"), F.col("key"), F.col("doc_id"), F.col("size")]
    parts = range_sorted(rows, order, "mix-order")
    targets = source_targets(parts.select("source", "size"), weights, share, most_epochs)

    # Totals of a source in each part, then what lies before the part.
    totals = parts.groupBy("source", "__part").agg(F.sum("size").alias("part_size"))
    earlier = (
        Window.partitionBy("source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = totals.select(
        F.col("source").alias("s"), F.col("__part").alias("p"),
        F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("before_part"),
    )
    budgets = before.join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    inside = (
        Window.partitionBy("source", "__part").orderBy("__at")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    summed = parts.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = summed.join(
        budgets, F.col("source").eqNullSafe(F.col("s")) & (F.col("__part") == F.col("p"))
    )
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col("before_part") - F.col("inside")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken")
    )


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws(':', 'mix', doc_id::VARCHAR)) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, 2 * source_size AS lim, 1.5::DOUBLE * sum(source_size) OVER () AS goal,
         coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w::DOUBLE, source
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(w) OVER (ORDER BY 2 * source_size / w::DOUBLE, source
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM s),
f AS (SELECT *, lim::DOUBLE < (goal - filled) * w / open_w AS is_full FROM o),
r AS (SELECT *, goal - coalesce(sum(lim) FILTER (is_full) OVER (), 0) AS left_over,
             sum(w) FILTER (NOT is_full) OVER () AS left_w FROM f),
t AS (SELECT source, source_size,
             CASE WHEN is_full THEN lim::DOUBLE ELSE left_over::DOUBLE * w / left_w END AS target
      FROM r),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, p.size, source_size, target,
  (CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) * p.size
     + greatest(0, least(p.size, floor(target)
         - floor(floor(target) / source_size) * source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
