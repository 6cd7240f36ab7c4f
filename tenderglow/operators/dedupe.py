"""Duplicate groups and their master records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderglow import rules as R
from tenderglow.functions.text import filled, strip
from tenderglow.operators import joins

BUCKET = 50_000


def dedup_key(
    cig: Column, buyer: Column, subject: Column, amount: Column, bucket: int = BUCKET
) -> Column:
    """``cig:…`` when there is a CIG, else buyer, subject and amount bucket (half to even)."""
    code = filled(F.upper(strip(cig)))
    nearest = F.bround(amount.cast("double") / F.lit(float(bucket)), 0) * F.lit(bucket)
    near = F.coalesce(nearest.cast("bigint").cast("string"), F.lit("x"))

    def head(c: Column, n: int) -> Column:
        return F.substring(F.lower(strip(F.coalesce(c, F.lit("")))), 1, n)

    loose = F.concat(F.lit("eo:"), head(buyer, 28), F.lit("|"), head(subject, 38), F.lit("|"), near)
    return F.coalesce(F.concat(F.lit("cig:"), code), loose)


def with_dedup_key(records: DataFrame, bucket: int = BUCKET) -> DataFrame:
    return records.withColumn(
        "dedup_key",
        dedup_key(F.col("cig"), F.col("ente"), F.col("descrizione"), F.col("importo"), bucket),
    )


def elect_master(
    records: DataFrame,
    hot_rows: int = joins.HOT_ROWS,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Set ``master_record_id``: null on masters, the master's id on duplicates.

    The master of a key is the row of lowest source rank (0 or none counts as last), then the
    earliest seen, then the lowest id. Groups are formed on four narrow columns (which ``keep``
    may store): an aggregate that combines map-side elects, and a join that keeps frequent keys
    (say, notices without a buyer) out of single tasks attaches. What comes back to the records
    is one row per duplicate, by id, so whole records move only if there are too many duplicates
    to broadcast.
    """
    rank = F.coalesce(
        F.when(F.col("source_priority_rank") != 0, F.col("source_priority_rank")),
        F.lit(R.UNKNOWN_RANK),
    )
    narrow = keep(
        records.filter(F.col("dedup_key").isNotNull()).select(
            "id", "dedup_key", rank.alias("rank"), "first_seen_at"
        )
    )
    groups = (
        narrow.groupBy("dedup_key")
        .agg(
            F.min_by("id", F.struct("rank", "first_seen_at", "id")).alias("master_record_id"),
            F.count("*").alias("n"),
        )
        .filter("n > 1")
    )
    members = joins.attach(
        narrow.select("id", "dedup_key"), groups, "dedup_key", group_size="n", spread_by="id",
        hot_rows=hot_rows,
    )
    duplicates = members.filter(F.col("master_record_id") != F.col("id")).drop("dedup_key")
    return (
        records.drop("master_record_id")
        .join(duplicates, "id", "left")
        .select(*dict.fromkeys([*records.columns, "master_record_id"]))
    )


def duplicate_counts(records: DataFrame) -> DataFrame:
    """Per key: members and how many of them point to a master."""
    return records.groupBy("dedup_key").agg(
        F.count("*").alias("member_count"),
        F.count_if(F.col("master_record_id").isNotNull()).alias("duplicates"),
    )


def masters(records: DataFrame) -> DataFrame:
    return records.filter(F.col("master_record_id").isNull())
