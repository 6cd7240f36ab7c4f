"""Attaching one row per key to a table whose keys may be very uneven."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is handled apart from the shuffle ...
HOT_ROWS = 1_000_000
# ... for at most this many keys, the most frequent ones. This is the proven bound of the
# broadcast; every key beyond it takes the ordinary shuffled join, so no row is lost.
HOT_KEYS = 10_000


def _spread_key(key: Column, spread_by: Column) -> Column:
    """Join key that never meets another one where ``key`` is null."""
    return F.coalesce(
        F.concat(F.lit("k"), key.cast("string")),
        F.concat(F.lit("\u0000"), spread_by.cast("string")),
    )


def lookup(left: DataFrame, right: DataFrame, key: str, *, spread_by: str) -> DataFrame:
    """Left join on a key that is often null; rows without one spread over all tasks."""
    values = [c for c in right.columns if c != key]
    keyed = right.select(_spread_key(F.col(key), F.lit("")).alias("_join_key"), *values)
    return (
        left.withColumn("_join_key", _spread_key(F.col(key), F.col(spread_by)))
        .join(keyed, "_join_key", "left")
        .drop("_join_key")
    )


def attach(
    left: DataFrame,
    right: DataFrame,
    key: str,
    *,
    spread_by: str,
    group_size: str | None = None,
    hot_rows: int = HOT_ROWS,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Left join ``right`` (exactly one row per ``key``) to ``left``.

    Rows of a hot key get their columns from a broadcast of at most ``hot_keys`` rows. In the
    shuffled join they carry a key made of ``spread_by`` that matches nothing, so they spread
    over all tasks instead of meeting in one. ``group_size`` names a column of ``right`` with the
    number of left rows per key; without it the keys of ``left`` are counted first.
    """
    values = [c for c in right.columns if c not in (key, group_size)]
    if group_size:
        sized = right.withColumn("_n", F.col(group_size))
    else:
        counted = (
            left.groupBy(key)
            .agg(F.count("*").alias("_n"))
            .filter(F.col("_n") > hot_rows)
            .orderBy(F.desc("_n"), key)
            .limit(hot_keys)
        )
        sized = right.join(F.broadcast(counted), key)
    hot = (
        sized.filter((F.col("_n") > hot_rows) & F.col(key).isNotNull())
        .orderBy(F.desc("_n"), key)
        .limit(hot_keys)
        .select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    )
    marked = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    # Hot rows need no match here, so they are keyed like null keys.
    shuffled = F.when(F.col("_hot_key").isNull(), F.col(key))
    joined_key = _spread_key(shuffled, F.col(spread_by))
    cold = right.select(
        _spread_key(F.col(key), F.lit("")).alias("_join_key"), F.struct(*values).alias("_cold")
    )
    out = marked.withColumn("_join_key", joined_key).join(cold, "_join_key", "left")
    # A cold match is a non-null struct even when all its fields are null.
    picked = F.when(F.col("_hot_key").isNotNull(), F.col("_hot")).otherwise(F.col("_cold"))
    return out.select(*[F.col(c) for c in left.columns], *[picked[c].alias(c) for c in values])
