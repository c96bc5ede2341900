"""Small helpers the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from featloom.session import materialize

# Words of a text: runs of anything but space and the controls from tab to return.
WORDS = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` does not have, for columns added on the way."""
    taken = {c.lower() for c in df.columns}
    names = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def text_key(text: Column) -> Column:
    """With the id it names a row; rows alike in id and text share their decisions."""
    return F.xxhash64(text, F.length(text))


def range_sorted(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows in global order, written out, with ``__part`` and ``__at`` in its part.

    Parts follow each other in the order; inside one, ``__at`` ascends.  Range bounds
    are sampled from the order itself, so equal leading keys are dealt over parts.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(
        parts.select(
            "*",
            F.spark_partition_id().alias("__part"),
            F.monotonically_increasing_id().alias("__at"),
        ),
        name,
    )


def global_rank(df: DataFrame, order: list[Column], name: str, output: str) -> DataFrame:
    """Rank from 0 over all rows; the only window without a key is over part totals."""
    parts = range_sorted(df, order, name)
    totals = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    row = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        parts.join(offsets, F.col("__part") == F.col("__p"))
        .withColumn(output, F.col("__before") + row)
        .drop("__part", "__at", "__p", "__before")
    )
