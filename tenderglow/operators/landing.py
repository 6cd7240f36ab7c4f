"""Drafts to raw records: checksum, scope gate, duplicate removal, counts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderglow import rules as R
from tenderglow.functions import text as T
from tenderglow.functions import values as V

LANDED = (
    "id", "source_id", "entity_id", "raw_title", "raw_body", "raw_html", "raw_url", "raw_date",
    "extracted_json", "checksum", "fetched_at", "normalized_at",
)


def draft_text(title: str = "raw_title", body: str = "raw_body") -> Column:
    return T.join_filled(" ", F.col(title), F.col(body))


def checksum(url: Column, title: Column, date: Column) -> Column:
    """SHA-256 of url, title and date, each empty when missing."""
    empty = F.lit("")
    payload = F.concat_ws(
        "|", url, F.coalesce(title, empty), F.coalesce(V.plain_timestamp(date), empty)
    )
    return F.sha2(payload, 256)


def with_checksum(drafts: DataFrame) -> DataFrame:
    """Adds ``checksum`` unless the drafts bring their own."""
    if "checksum" in drafts.columns:
        return drafts
    return drafts.withColumn(
        "checksum", checksum(F.col("raw_url"), F.col("raw_title"), F.col("raw_date"))
    )


def gate(drafts: DataFrame, scope: R.ScopeRules = R.ScopeRules()) -> DataFrame:
    """Only drafts whose title and body score in scope."""
    return drafts.filter(T.in_scope(draft_text(), scope))


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key plus ``copies``, the number of rows it stands for.

    An aggregate rather than a ranked window: copies collapse before the shuffle, so a text
    repeated a billion times reaches its task as one row per map task.
    """
    rest = [c for c in df.columns if c not in key]
    ranked = F.struct(*[F.col(c) for c in order])
    return (
        df.groupBy(*key)
        .agg(F.min_by(F.struct(*rest), ranked).alias("_row"), F.count("*").alias("copies"))
        .select(
            *[F.col(c) if c in key else F.col("_row")[c].alias(c) for c in df.columns], "copies"
        )
    )


def land(
    drafts: DataFrame,
    now: datetime,
    *,
    scoped: bool = True,
    scope: R.ScopeRules = R.ScopeRules(),
    order: Sequence[str] = ("pos",),
    existing: DataFrame | None = None,
) -> DataFrame:
    """Raw records of one run.

    ``scoped=False`` is for feeds that scope themselves. Within a source the first draft of a
    checksum is kept. ``existing`` (earlier raw records) also removes what earlier runs landed;
    by default a notice seen daily lands daily.
    """
    kept = gate(drafts, scope) if scoped else drafts
    if "source_id" not in kept.columns:
        kept = kept.withColumn("source_id", F.lit(None).cast("string"))
    unique = first_per_key(with_checksum(kept), ["source_id", "checksum"], order).drop("copies")
    if existing is not None:
        unique = unique.join(existing.select("checksum").distinct(), "checksum", "left_anti")
    fetched = V.at(now)
    missing = F.lit(None).cast("string")
    have = set(unique.columns)
    optional = {c: F.col(c) if c in have else missing for c in ("entity_id", "raw_html")}
    return unique.select(
        F.sha2(
            F.concat_ws("|", F.lit("raw"), "source_id", "checksum", V.iso(fetched)), 256
        ).alias("id"),
        "source_id",
        optional["entity_id"].alias("entity_id"),
        "raw_title",
        "raw_body",
        optional["raw_html"].alias("raw_html"),
        "raw_url",
        F.coalesce("raw_date", fetched).alias("raw_date"),
        F.when(~F.col("extracted_json").isin("", "{}", "null"), F.col("extracted_json")).alias(
            "extracted_json"
        ),
        "checksum",
        fetched.alias("fetched_at"),
        F.lit(None).cast("timestamp").alias("normalized_at"),
    )


def collect_metrics(
    drafts: DataFrame, *, scoped: bool = True, scope: R.ScopeRules = R.ScopeRules()
) -> DataFrame:
    """Per source: found, valid, weak, duplicates removed and the run status.

    Drafts out of scope are found but neither valid nor duplicates.
    """
    keep = T.in_scope(draft_text(), scope) if scoped else F.lit(True)
    per_checksum = (
        with_checksum(drafts)
        .withColumn("_keep", keep)
        .groupBy("source_id", "checksum", "_keep")
        .agg(F.count("*").alias("n"))
    )
    valid = F.count_if("_keep")
    return per_checksum.groupBy("source_id").agg(
        F.sum("n").cast("int").alias("records_found"),
        valid.cast("int").alias("records_valid"),
        F.lit(0).alias("records_weak"),
        F.coalesce(F.sum(F.when(F.col("_keep"), F.col("n") - 1)), F.lit(0))
        .cast("int")
        .alias("duplicates_removed"),
        F.when(valid == 0, "partial").otherwise("success").alias("status"),
    )


def touch_sources(sources: DataFrame, metrics: DataFrame, now: datetime) -> DataFrame:
    """Set ``last_checked_at`` on the sources whose run did not fail."""
    done = metrics.filter("status != 'failed'").select(F.col("source_id").alias("id")).distinct()
    checked = done.withColumn("_done", F.lit(True))
    return (
        sources.join(checked, "id", "left")
        .withColumn(
            "last_checked_at", F.when(F.col("_done"), V.at(now)).otherwise(F.col("last_checked_at"))
        )
        .select(*sources.columns)
    )


def since_window(drafts: DataFrame, days: int, now: datetime) -> DataFrame:
    """Drafts dated within the last 7, 14 or 30 days; any other window is an error."""
    if days not in (7, 14, 30):
        raise ValueError(f"days must be 7, 14 or 30, got {days}")
    return drafts.filter(F.col("raw_date") >= V.at(now) - F.expr(f"INTERVAL {days} DAYS"))
