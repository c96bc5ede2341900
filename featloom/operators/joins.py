"""Equi-joins that hold when one key owns a large share of the rows.

Right sides have one row per key here (roll-ups, dimensions).  The physical
join is left to Catalyst and AQE, which broadcast by measured size only; no
broadcast of them is forced.  For large inputs the hot keys of the left side are
looked up first, and each key's rows are spread over as many salts as it has
multiples of a task's rows.  Hot keys stay a table, (hash, salts): neither the plan
nor the driver holds a list of them, and there is no limit to their number.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.functions.columns import as_list, by_name, require_unique
from featloom.session import materialize

# Left sides that read fewer bytes than this are joined without looking for hot keys.
SKEW_MIN_BYTES_CONF = "featloom.skew.minBytes"
SKEW_MIN_BYTES = 64 << 30
# A key is hot from this many rows on, about what one task should sort.
HOT_ROWS_CONF = "featloom.skew.hotRows"
HOT_ROWS = 5_000_000
# Rows with a null key match nothing and are spread over this many salts.
SALTS_CONF = "featloom.skew.salts"
SALTS = 64
INTEGRAL = {"tinyint", "smallint", "int", "bigint"}
# From so many columns on, a right side goes through the join as one struct: a join writes each
# column of a row anew, but copies a struct in one piece.
PACKED_COLUMNS = 16


def input_bytes(df: DataFrame) -> int | None:
    """Bytes the plan reads, summed over its sources; None where the session hides them.

    Catalyst multiplies the sizes of joined sides, so its estimate for a whole
    plan says little; that of a source is its size on disk.
    """
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except AttributeError:
        return None


def reads_much(df: DataFrame) -> bool:
    """Whether the plan reads enough to look for hot keys first."""
    least = int(df.sparkSession.conf.get(SKEW_MIN_BYTES_CONF, str(SKEW_MIN_BYTES)))
    read = input_bytes(df)
    return read is None or read >= least


def _worth_salting(left: DataFrame, right: DataFrame) -> bool:
    """A large left side, and a right side Spark would not simply broadcast."""
    if not reads_much(left):
        return False
    conf = left.sparkSession.conf
    threshold = conf.get("spark.sql.autoBroadcastJoinThreshold")
    # Spark reports it with a unit, as 10485760b.
    limit = int(threshold.rstrip("bB")) if threshold.rstrip("bB").lstrip("-").isdigit() else 0
    size = input_bytes(right)
    return size is None or size > limit


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(hash, salts) of the keys with at least so many rows that a task should not sort more.

    The job reads the key columns; counting combines on the map side, so a hot key costs
    one row per task.  A table of ``n`` rows has at most ``n / HOT_ROWS`` hot keys.
    """
    least = int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(HOT_ROWS)))
    known = df.select(_key_hash(keys).alias("__hot")).where(F.col("__hot").isNotNull())
    counts = known.groupBy("__hot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    # Twice as many salts as tasks' worth of rows, as hashes do not deal evenly.
    return counts.select("__hot", F.ceil(2 * F.col("n") / least).cast("int").alias("__salts"))


def packed_columns(columns: Iterable[str], name: str) -> Column:
    """Columns as one struct; its fields are numbered, as columns may have any name."""
    return F.struct(*[by_name(c).alias(f"f{i}") for i, c in enumerate(columns)]).alias(name)


def packed_field(name: str, i: int) -> Column:
    """A column of :func:`packed_columns`; null where the struct is."""
    return F.col(name).getField(f"f{i}")


def _key_hash(keys: list[str]) -> Column:
    """Null if a key is.  Text, so that an int and a bigint hash alike."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | by_name(k).isNull()
    return F.when(~missing, F.xxhash64(*[by_name(k).cast("string") for k in keys]))


def _salted(
    left: DataFrame, right: DataFrame, keys: list[str], right_keys: list[str], hot: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt; rows with a null key match nothing and are spread as well.

    The table of hot keys has a row for every ``HOT_ROWS`` rows of the left side at most,
    12 bytes each, so it goes to every task: a shuffle by key is what has to be avoided.
    """
    salts = int(left.sparkSession.conf.get(SALTS_CONF, str(SALTS)))
    columns, right_columns = left.columns, right.columns
    with_hash = left.select("*", _key_hash(keys).alias("__hash"))
    marked = with_hash.join(F.broadcast(hot), F.col("__hash") == F.col("__hot"), "left")
    # Equal rows hash alike, so the input partition is mixed in to part exact copies too.
    spread = F.xxhash64(F.spark_partition_id(), *[by_name(c) for c in columns])
    parts = F.when(F.col("__hash").isNull(), F.lit(salts)).otherwise(F.coalesce("__salts", F.lit(1)))
    named = right.select("*", _key_hash(right_keys).alias("__hash"))
    copied = named.join(F.broadcast(hot), F.col("__hash") == F.col("__hot"), "left")
    copies = F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)
    return (
        marked.select(*[by_name(c) for c in columns], F.pmod(spread, parts).cast("int").alias("__salt")),
        copied.select(*[by_name(c) for c in right_columns], F.explode(copies).alias("__right_salt")),
    )


def _alike(left: DataFrame, right: DataFrame, keys: list[str], right_keys: list[str]) -> bool:
    """Whether the key types compare as their texts do."""
    a, b = dict(left.dtypes), dict(right.dtypes)
    return all(
        a[k] == b[r] or {a[k], b[r]} <= INTEGRAL for k, r in zip(keys, right_keys)
    )


def attach(
    left: DataFrame,
    right: DataFrame,
    key: str | Iterable[str],
    right_key: str | Iterable[str] | None = None,
    how: str = "left",
    skew: bool | None = None,
    hot_from: DataFrame | None = None,
) -> DataFrame:
    """Join ``right`` to ``left``: left columns, then the right ones but its key.

    ``how`` is ``left`` or ``inner``.  ``skew=True`` looks for hot keys and salts
    them, ``False`` does not (say so where the left side is unique by key); by
    default the sizes of the inputs decide.  ``hot_from`` is a cheaper table with
    the left keys to look in.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    keys = as_list(key)
    right_keys = keys if right_key is None else as_list(right_key)
    if len(keys) != len(right_keys):
        raise ValueError("key lists differ in length")
    added = [c for c in right.columns if c not in right_keys]
    output = [*left.columns, *added]
    require_unique(output)

    inner_keys = [f"__key_{i}" for i in range(len(keys))]
    packed = len(added) >= PACKED_COLUMNS
    right = right.select(
        *[by_name(k).alias(inner) for k, inner in zip(right_keys, inner_keys)],
        *([packed_columns(added, "__right")] if packed else [by_name(c) for c in added]),
    )
    condition = [by_name(k) == F.col(inner) for k, inner in zip(keys, inner_keys)]
    salting = _worth_salting(left, right) if skew is None else skew
    if salting and _alike(left, right, keys, inner_keys):
        # hot_from must hold the same keys; a narrower source spares running the left plan.
        hot = materialize(hot_keys(left if hot_from is None else hot_from, keys), "hot-keys")
        if not hot.isEmpty():
            left, right = _salted(left, right, keys, inner_keys, hot)
            condition.append(F.col("__salt") == F.col("__right_salt"))
    joined = left.join(right, condition, how)
    if not packed:
        return joined.select(*[by_name(c) for c in output])
    fields = [packed_field("__right", i).alias(c) for i, c in enumerate(added)]
    return joined.select(*[by_name(c) for c in left.columns], *fields)


def attach_roles(
    df: DataFrame,
    lookup: DataFrame,
    lookup_key: str,
    roles: Mapping[str, Mapping[str, str]],
) -> DataFrame:
    """Join one lookup once per role: ``{fact key: {lookup column: output name}}``."""
    for fact_key, names in roles.items():
        view = lookup.select(
            by_name(lookup_key).alias("__role_key"),
            *[by_name(column).alias(name) for column, name in names.items()],
        )
        df = attach(df, view, fact_key, "__role_key")
    return df


def keep_listed(df: DataFrame, key: str, listed: DataFrame, listed_key: str | None = None) -> DataFrame:
    """Rows whose key is on the list (a left semi join)."""
    names = listed.select(by_name(listed_key or key).alias("__listed"))
    return df.join(names, by_name(key) == F.col("__listed"), "left_semi")
