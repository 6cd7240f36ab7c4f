"""Structured extraction rows (made elsewhere from page texts) to drafts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderglow.functions import text as T
from tenderglow.functions import urls as U
from tenderglow.functions import values as V
from tenderglow.operators.landing import checksum

# kind -> (fragment that tells entries of one page apart, columns tried for it,
#          extracted keys with the columns they come from)
KINDS = {
    "record": (
        "record",
        ("cig", "title"),
        (("importo", "importo_eur"), ("cig", "cig"), ("scadenza", "scadenza"), ("ente", "ente"),
         ("regione", "regione"), ("provincia", "provincia")),
    ),
    "act": (
        "atto",
        ("title",),
        (("ente", "ente"), ("scadenza", "scadenza"), ("atto_tipo", "atto_tipo")),
    ),
}


def iso_only(c: Column) -> Column:
    """Timestamp of an ISO text as its local reading in UTC; anything else is null."""
    naive = F.regexp_replace(c, r"(Z|[+-]\d{2}:?\d{2})$", "")
    return V.precise_timestamp(F.when(F.length(c) == 10, c).otherwise(naive))


def drafts_from_extractions(
    extractions: DataFrame, kind: str, now: datetime, extracted_by: str
) -> DataFrame:
    """Drafts of extraction rows (``page_url``, ``title``, ``url``, ``date``, ``body``, …).

    An entry without a link of its own gets the page's, told apart by its CIG or title. Undated
    acts are dated ``now``; their checksum still sees no date, so a later run recognises them.
    """
    fragment, by, fields = KINDS[kind]
    have = set(extractions.columns)
    missing = F.lit(None).cast("string")

    def column(name: str) -> Column:
        return F.col(name) if name in have else missing

    page = F.col("page_url")
    apart = F.coalesce(*[T.filled(column(c)) for c in by])
    own = T.filled(F.col("url"))
    if kind == "act":
        own = U.resolve(page, own)
    url = F.coalesce(own, F.concat(page, F.lit(f"#{fragment}="), U.quote(apart)), page)
    dated = iso_only(T.filled(F.col("date")))
    drafts = extractions.select(
        column("source_id").alias("source_id"),
        column("entity_id").alias("entity_id"),
        url.alias("raw_url"),
        F.col("title").alias("raw_title"),
        F.col("body").alias("raw_body"),
        dated.alias("raw_date"),
        F.to_json(
            F.struct(
                *[column(c).alias(key) for key, c in fields],
                F.lit(extracted_by).alias("extracted_by"),
                F.lit(True).alias("perimeter_prevalidated"),
            )
        ).alias("extracted_json"),
        F.monotonically_increasing_id().alias("pos"),
    ).withColumn("checksum", checksum(F.col("raw_url"), F.col("raw_title"), F.col("raw_date")))
    if kind == "act":
        drafts = drafts.withColumn("raw_date", F.coalesce("raw_date", V.at(now)))
    return drafts


def merge_details(records: DataFrame, details: DataFrame, key: str = "url") -> DataFrame:
    """Fill buyer and deadline from the detail page; its body, when any, replaces the snippet.

    ``details`` has one row per ``key``; of several the first by text is taken.
    """
    one = details.groupBy(key).agg(
        F.min_by(
            F.struct("ente", "scadenza", "body"), F.struct("body", "ente", "scadenza")
        ).alias("_d")
    )

    def gap(name: str) -> Column:
        return F.coalesce(T.filled(F.col(name)), T.filled(F.col(f"_d.{name}")), F.col(name))

    changed = {
        "ente": gap("ente"),
        "scadenza": gap("scadenza"),
        "body": F.coalesce(T.filled(F.col("_d.body")), F.col("body")),
    }
    return records.join(one, key, "left").select(
        *[changed.get(c, F.col(c)).alias(c) for c in records.columns]
    )


def watchlist_urls(items: DataFrame) -> DataFrame:
    """One row per active item and page to scan: notice board and transparency section."""
    pages = items.filter("active").select(
        F.col("id").alias("item_id"), "entity_id", "source_id",
        F.col("url_albo").alias("albo"), F.col("url_trasparenza").alias("trasparenza"),
    )
    return pages.unpivot(
        ["item_id", "entity_id", "source_id"], ["albo", "trasparenza"], "kind", "url"
    ).filter(T.filled(F.col("url")).isNotNull())


def mark_scanned(items: DataFrame, scanned: DataFrame, now: datetime) -> DataFrame:
    """Set ``last_scan_at`` on the items listed by ``item_id``."""
    done = scanned.select(F.col("item_id").alias("id"), F.lit(True).alias("_done")).distinct()
    return (
        items.join(done, "id", "left")
        .withColumn("last_scan_at", F.when(F.col("_done"), V.at(now)).otherwise(F.col("last_scan_at")))
        .select(*items.columns)
    )
