"""Filtered listings of records and dimensions."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tenderglow.functions import values as V

MAX_PAGE = 1000


@dataclass(frozen=True)
class RecordFilters:
    """Optional predicates, combined with AND. Empty texts count as not given."""

    regione: str | None = None
    provincia: str | None = None
    ente: str | None = None
    stato_procedurale: str | None = None
    tipo_novita: str | None = None
    flag_ppp_doppio_oggetto: str | None = None
    flag_om: str | None = None
    flag_pre_gara: str | None = None
    min_importo: Decimal | float | None = None
    max_importo: Decimal | float | None = None
    q: str | None = None
    date_from: datetime | None = None
    date_to: datetime | None = None
    priorita: str | None = None
    only_masters: bool = False

    def predicates(self) -> list[Column]:
        # Plain column-literal comparisons, so all but the text searches reach the file scan.
        equal = {
            "regione": self.regione,
            "provincia": self.provincia,
            "stato_procedurale": self.stato_procedurale,
            "tipo_novita": self.tipo_novita,
            "flag_ppp_doppio_oggetto": self.flag_ppp_doppio_oggetto,
            "flag_om": self.flag_om,
            "flag_pre_gara": self.flag_pre_gara,
            "priorita_commerciale": self.priorita,
        }
        out = [F.col(c) == F.lit(v) for c, v in equal.items() if v]
        if self.ente:
            out.append(F.col("ente").ilike(f"%{self.ente}%"))
        if self.min_importo is not None:
            out.append(F.col("importo") >= _money(self.min_importo))
        if self.max_importo is not None:
            out.append(F.col("importo") <= _money(self.max_importo))
        if self.date_from is not None:
            out.append(F.col("data_pubblicazione") >= V.at(self.date_from))
        if self.date_to is not None:
            out.append(F.col("data_pubblicazione") <= V.at(self.date_to))
        if self.q:
            wanted = f"%{self.q}%"
            fields = [F.col(c).ilike(wanted) for c in ("ente", "descrizione", "cig")]
            out.append(reduce(lambda a, b: a | b, fields))
        if self.only_masters:
            out.append(F.col("master_record_id").isNull())
        return out


def _money(value: Decimal | float) -> Column:
    return F.lit(Decimal(str(value)))


def matching(records: DataFrame, filters: RecordFilters) -> DataFrame:
    """All matching records, unordered: what an export or a further job starts from."""
    return reduce(lambda df, p: df.filter(p), filters.predicates(), records)


def search_records(
    records: DataFrame, filters: RecordFilters, limit: int = 100, offset: int = 0
) -> DataFrame:
    """One page: newest publication first, missing dates last, then newest seen, then id."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE}, got {limit}")
    ordered = matching(records, filters).orderBy(*listing_order())
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


def listing_order() -> list[Column]:
    return [F.col("data_pubblicazione").desc_nulls_last(), F.desc("first_seen_at"), F.col("id")]


def search_after(
    records: DataFrame, filters: RecordFilters, last: Row | None, limit: int = 100
) -> DataFrame:
    """The page after the row ``last`` (null: the first page), in the order of ``search_records``.

    Rows before it are filtered out in the scan, so a late page costs no more than the first.
    """
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE}, got {limit}")
    found = matching(records, filters)
    if last is not None:
        day, seen = F.col("data_pubblicazione"), F.col("first_seen_at")
        same_day = day.eqNullSafe(F.lit(last.data_pubblicazione).cast("timestamp"))
        first, then = F.lit(last.first_seen_at), F.lit(last.id)
        later = same_day & ((seen < first) | ((seen == first) & (F.col("id") > then)))
        if last.data_pubblicazione is not None:
            later = later | day.isNull() | (day < F.lit(last.data_pubblicazione))
        found = found.filter(later)
    return found.orderBy(*listing_order()).limit(limit)


def get_record(records: DataFrame, record_id: str) -> DataFrame:
    return records.filter(F.col("id") == F.lit(record_id))


def weak_evidence(records: DataFrame, limit: int | None = None) -> DataFrame:
    """Weak records in listing order, all of them unless a page size is given."""
    ordered = matching(records, RecordFilters()).filter("is_weak_evidence").orderBy(*listing_order())
    return ordered if limit is None else ordered.limit(limit)


def top_p1(records: DataFrame, n: int = 10) -> DataFrame:
    return search_records(records, RecordFilters(priorita="P1", only_masters=True), n)


def active_sources(sources: DataFrame, source_type: str) -> DataFrame:
    """Active sources of a type in collection order."""
    return list_sources(sources.filter(F.col("source_type") == F.lit(source_type)), active=True)


def active_source(sources: DataFrame, source_id: str) -> DataFrame:
    """The one source, if it is active."""
    return sources.filter((F.col("id") == F.lit(source_id)) & F.col("active"))


def list_sources(sources: DataFrame, active: bool | None = None) -> DataFrame:
    out = sources if active is None else sources.filter(F.col("active") == F.lit(active))
    return out.orderBy("source_priority_rank", "name")


def list_entities(entities: DataFrame, region: str | None = None) -> DataFrame:
    out = entities.filter(F.col("region") == F.lit(region)) if region else entities
    return out.orderBy("name", "id")


def list_watchlist(items: DataFrame, active: bool | None = None) -> DataFrame:
    out = items if active is None else items.filter(F.col("active") == F.lit(active))
    return out.orderBy("priority", "created_at", "id")


def list_documents(documents: DataFrame, record_id: str) -> DataFrame:
    return documents.filter(F.col("procurement_record_id") == F.lit(record_id)).orderBy(
        F.desc("created_at"), "id"
    )
