"""Structured feeds: framework lots, notices (two layouts), open-data records, RSS."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderglow import rules as R
from tenderglow import schemas
from tenderglow.functions import jsonvals as J
from tenderglow.functions import text as T
from tenderglow.functions import values as V
from tenderglow.operators.landing import gate

# ---- fixed values: addresses used when a feed row has no link of its own ------------------------
LOT_PAGE = "https://www.consip.it/bandi/aq-servizio-luce"
NOTICE_PAGE = "https://ted.europa.eu/en/notice/{}/html"
NOTICE_SEARCH = "https://api.ted.europa.eu/v3/notices/search"
OLD_NOTICE_PAGE = "https://ted.europa.eu/udl?uri=TED:NOTICE:{}"
UNTITLED_NOTICE = "Bando TED senza titolo"

_DRAFT = ("raw_url", "raw_title", "raw_body", "raw_date", "extracted_json", "pos")


def _empty_for_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _position() -> Column:
    """Order of the rows within a run: file by file, as read."""
    return F.monotonically_increasing_id()


def _since(drafts: DataFrame, since: datetime | None) -> DataFrame:
    """Drafts from ``since`` on; a draft without a date may be new and stays."""
    date = F.col("raw_date")
    return drafts if since is None else drafts.filter(date.isNull() | (date >= V.at(since)))


def _answers(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Files of one JSON value each, whatever lines it has.

    A zero character cannot stand in JSON, so with it as line end a file is one line. The ``multiLine`` reader opens the file
    again for each number that is read as text, to copy its digits; here they are copied from the line.
    """
    return spark.read.schema(schema).option("lineSep", "\0").json(path)


# ---- framework lots ---------------------------------------------------------------------------------


def read_lot_feed(
    spark: SparkSession, path: str | list[str], keywords: Sequence[str] = R.LOT_KEYWORDS
) -> DataFrame:
    """Drafts of the yearly lot files (one JSON array each)."""
    return lot_drafts(_answers(spark, path, schemas.LOT_FEED), keywords)


def lot_drafts(rows: DataFrame, keywords: Sequence[str] = R.LOT_KEYWORDS) -> DataFrame:
    """Lots whose names hold a keyword; every lot gets a link of its own."""
    tender = _empty_for_null(F.col("`#Denominazione_Bando`"))
    lot = _empty_for_null(F.col("Denominazione_Lotto"))
    lot_id = T.filled(F.col("Identificativo_Lotto"))
    base = T.filled(F.col("Base_Asta"))

    def labelled(label: str, c: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), c)

    kept = rows.filter(T.contains_any(F.lower(F.concat(tender, F.lit(" "), lot)), keywords))
    return kept.select(
        F.concat(
            F.lit(LOT_PAGE), _empty_for_null(F.concat(F.lit("#lotto="), lot_id))
        ).alias("raw_url"),
        F.concat(tender, F.when(lot != "", F.concat(F.lit(" — "), lot)).otherwise(""))
        .alias("raw_title"),
        F.concat_ws(
            "; ",
            labelled("Categoria", _empty_for_null(F.col("Categoria_Merceologica"))),
            labelled("Tipo strumento", _empty_for_null(F.col("Tipo_Strumento"))),
            labelled("Tipo procedura", _empty_for_null(F.col("Tipo_Procedura"))),
            labelled("Base asta", base),
        ).alias("raw_body"),
        V.dashed_date(F.col("Data_Pubblicazione")).alias("raw_date"),
        F.to_json(
            F.struct(
                F.col("Identificativo_Lotto").alias("identificativo_lotto"),
                F.col("Categoria_Merceologica").alias("categoria_merceologica"),
                F.col("Tipo_Strumento").alias("tipo_strumento"),
                F.col("Tipo_Procedura").alias("procedura"),
                F.col("Base_Asta").alias("importo"),
                F.col("Data_Attivazione").alias("data_attivazione"),
                F.col("Data_Termine").alias("data_termine"),
                F.lit("consip-opendata-direct").alias("extracted_by"),
                F.lit(True).alias("perimeter_prevalidated"),
            )
        ).alias("extracted_json"),
        _position().alias("pos"),
    )


# ---- notices, current layout ------------------------------------------------------------------------


def _items(c: Column) -> Column:
    """Items of a JSON list, or the text itself as the only item; null for null."""
    return F.coalesce(F.from_json(F.when(c.startswith("["), c), "array<string>"), F.array_compact(F.array(c)))


def _asked_for(stated: Column, wanted: Sequence[str], width: int) -> Column:
    """Whether one of the stated items starts with a wanted one of ``width`` characters; rows that state none pass."""
    if not wanted:
        return F.lit(True)
    heads = F.transform(stated, lambda c: F.substring(c, 1, width))
    return stated.isNull() | (F.size(stated) == 0) | F.arrays_overlap(heads, F.array(*[F.lit(w) for w in wanted]))


def look_back(now: datetime, days: int) -> datetime:
    """Start of the UTC day ``days`` before ``now``: the service is asked by days."""
    day = now.replace(tzinfo=timezone.utc) if now.tzinfo is None else now.astimezone(timezone.utc)
    return (day - timedelta(days=days)).replace(hour=0, minute=0, second=0, microsecond=0)


def _head(c: Column) -> Column:
    """First item when the text is a JSON list, else the text itself."""
    items = F.from_json(F.when(c.startswith("["), c), "array<string>")
    return F.coalesce(F.get(items, F.lit(0)), F.when(items.isNull(), c))


def pick_language(m: Column, prefer: Sequence[str] = ("ita", "eng")) -> Column:
    """Value of the first preferred language present, else of the first language listed."""
    chosen = F.get(F.map_values(m), F.lit(0))
    for lang in reversed(prefer):
        chosen = F.when(F.map_contains_key(m, lang), F.element_at(m, lang)).otherwise(chosen)
    return _head(chosen)


def read_notice_feed(
    spark: SparkSession,
    path: str | list[str],
    *,
    codes: Sequence[str] | None = None,
    country: str | None = None,
    since: datetime | None = None,
    now: datetime | None = None,
    layout: str = "current",
) -> DataFrame:
    """Drafts of saved notice-search answers; ``layout='v3.0'`` reads the older format.

    ``codes`` and ``country`` are those of the layout by default; empty ones ask for all. Without ``since`` notices
    are kept from 14 days (7 in the older layout) before ``now``; with neither, all are. Both count whole days.
    """
    if layout not in ("current", "v3.0"):
        raise ValueError(f"unknown notice layout {layout!r}")
    asked = {k: v for k, v in (("codes", codes), ("country", country)) if v is not None}
    if since is not None:
        since = look_back(since, 0)
    elif now is not None:
        since = look_back(now, R.NOTICE_DAYS if layout == "current" else R.OLD_NOTICE_DAYS)
    if layout == "v3.0":
        pages = spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"))
        return _since(old_notice_drafts(pages, **asked), since)
    answers = _answers(spark, path, f"notices array<{schemas.NOTICE}>")
    notices = answers.select(F.explode("notices").alias("n")).select("n.*")
    return _since(notice_drafts(notices, **asked), since)


def notice_drafts(
    notices: DataFrame, codes: Sequence[str] = R.NOTICE_CODES, country: str = R.NOTICE_COUNTRY
) -> DataFrame:
    """Drafts of notice rows. Rows that state their codes or countries are held to ``codes`` and ``country``."""
    stated = _items(F.col("`buyer-country`")) if "buyer-country" in notices.columns else F.lit(None).cast("array<string>")
    notices = notices.filter(
        _asked_for(F.col("`classification-cpv`"), codes, 8)
        & _asked_for(stated, [country] if country else [], 3)
    )
    number = _empty_for_null(F.col("`publication-number`"))
    buyer = T.filled(pick_language(F.col("`buyer-name`")))
    links = F.col("links.htmlDirect")
    own_link = F.coalesce(
        T.filled(F.element_at(links, "ITA")), T.filled(F.element_at(links, "ENG"))
    )
    before, after = NOTICE_PAGE.split("{}")
    deadline = F.substring(T.filled(_head(F.col("`deadline-receipt-tender-date-lot`"))), 1, 10)
    value = F.coalesce(F.col("`total-value`"), _head(F.col("`estimated-value-lot`")))
    return notices.select(
        F.coalesce(
            own_link,
            F.when(number != "", F.concat(F.lit(before), number, F.lit(after))),
            F.lit(NOTICE_SEARCH),
        ).alias("raw_url"),
        F.coalesce(
            T.filled(pick_language(F.col("`notice-title`"))), F.lit(UNTITLED_NOTICE)
        ).alias("raw_title"),
        F.concat_ws(
            "; ",
            F.concat(F.lit("Ente: "), buyer),
            F.concat(F.lit("Numero pubblicazione TED: "), number),
        ).alias("raw_body"),
        V.iso_timestamp(F.substring(F.col("`publication-date`"), 1, 10)).alias("raw_date"),
        F.to_json(
            F.struct(
                buyer.alias("ente"),
                number.alias("publication_number"),
                F.col("`procedure-type`").alias("procedura"),
                value.alias("importo"),
                deadline.alias("scadenza"),
                F.lit("ted-api-direct").alias("extracted_by"),
                F.lit(True).alias("perimeter_prevalidated"),
            )
        ).alias("extracted_json"),
        _position().alias("pos"),
    )


# ---- notices, older layout --------------------------------------------------------------------------

_SUMMARY_KEYS = (
    "TI", "title", "notice-type", "procurement-method", "buyer-name-1", "buyer-city-1",
    "total-value", "CY",
)


def _objects(doc: Column, *paths: str) -> Column:
    """First path that is a list, as an array of variants."""
    lists = [
        F.when(
            F.schema_of_variant(F.try_variant_get(doc, p, "variant")).startswith("ARRAY"),
            F.try_variant_get(doc, p, "array<variant>"),
        )
        for p in paths
    ]
    return F.coalesce(*lists)


def old_notice_drafts(
    pages: DataFrame, codes: Sequence[str] = R.SCOPE_CODES, country: str = R.OLD_NOTICE_COUNTRY
) -> DataFrame:
    """Drafts of ``payload`` rows holding whole answers of the older service.

    Notices that state their codes (``CPV``) or countries (``CY``), as one text or a list, are held to those asked for.
    """
    doc = J.parsed(F.col("payload"))
    n = F.col("n")

    def stated(key: str) -> Column:
        value = J.item(n, key)
        listed = F.transform(F.try_variant_get(value, "$", "array<variant>"), J.scalar_text)
        return F.array_compact(F.coalesce(listed, F.array(J.scalar_text(value))))

    notices = pages.select(F.explode(_objects(doc, "$.notices", "$.results")).alias("n")).filter(
        _asked_for(stated("CPV"), codes, 8) & _asked_for(stated("CY"), [country] if country else [], 2)
    )

    def link_of(entry: Column) -> Column:
        kind = F.schema_of_variant(entry)
        return F.when(
            kind.startswith("OBJECT"),
            F.coalesce(
                T.filled(J.scalar_text(J.item(entry, "href"))),
                T.filled(J.scalar_text(J.item(entry, "url"))),
            ),
        ).when(kind == "STRING", F.try_variant_get(entry, "$", "string"))

    links = F.array_compact(F.transform(F.try_variant_get(n, "$.links", "array<variant>"), link_of))
    number = T.filled(J.scalar_text(J.item(n, "ND")))
    link = F.coalesce(
        T.filled(F.get(links, F.lit(0))),
        F.concat(F.lit(OLD_NOTICE_PAGE.format("")), number),
    )
    published = J.item(n, "PD")
    first_published = F.coalesce(J.first_text_in_list(published), J.scalar_text(published))

    def labelled(key: str) -> Column:
        return F.concat(F.lit(f"{key}: "), T.filled(J.first_value(J.item(n, key))))

    return notices.select(
        link.alias("raw_url"),
        F.coalesce(
            T.filled(J.first_value(J.item(n, "TI"))), J.scalar_text(J.item(n, "title"))
        ).alias("raw_title"),
        F.concat_ws(" | ", *[labelled(k) for k in _SUMMARY_KEYS]).alias("raw_body"),
        V.compact_date(first_published).alias("raw_date"),
        F.concat(
            F.lit('{"notice":'), F.to_json(n), F.lit(',"source":"ted"}')
        ).alias("extracted_json"),
        _position().alias("pos"),
    ).filter(F.col("raw_url").isNotNull())


# ---- open-data records --------------------------------------------------------------------------------

# Each record as its own JSON text, so that numbers, nested objects and nulls stay what they were.
_RECORDS = "array<string>"


def read_open_data_feed(
    spark: SparkSession, path: str | list[str], since: datetime | None = None,
    body_chars: int | None = None,
) -> DataFrame:
    """Drafts of saved open-data answers, one answer per file."""
    pages = spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"))
    return _since(open_data_drafts(pages, body_chars), since)


def open_data_drafts(pages: DataFrame, body_chars: int | None = None) -> DataFrame:
    """Drafts of ``payload`` rows; records may sit at several places of an answer.

    ``body_chars`` cuts the flattened body, which is whole otherwise. Maps keep the field order of the document, which the flattened body shows.
    """
    payload = F.col("payload")
    top = F.from_json(F.when(F.ltrim(payload).startswith("["), payload), _RECORDS)
    nested = [
        F.from_json(F.get_json_object(payload, p), _RECORDS)
        for p in ("$.records", "$.results", "$.data", "$.result.records", "$.result.results")
    ]
    records = pages.select(F.explode(F.coalesce(top, *nested)).alias("record")).filter(
        F.ltrim("record").startswith("{")
    )
    rows = records.withColumn("m", F.from_json("record", "map<string,string>")).filter("m IS NOT NULL")
    m = F.col("m")

    def pick(*keys: str) -> Column:
        return F.coalesce(*[T.filled(F.element_at(m, k)) for k in keys])

    fields = F.filter(F.map_entries(m), lambda e: e.value.isNotNull() & (e.value != ""))
    body = F.array_join(
        F.transform(fields, lambda e: F.concat(e.key, F.lit(": "), e.value)), " | "
    )
    drafts = rows.select(
        pick("link_bando", "url", "link", "url_bando").alias("raw_url"),
        pick("oggetto", "oggetto_principale_contratto", "titolo").alias("raw_title"),
        (body if body_chars is None else F.substring(body, 1, body_chars)).alias("raw_body"),
        V.precise_timestamp(pick("data_pubblicazione", "data_pubb", "data_inizio")).alias("raw_date"),
        F.concat(F.lit('{"record":'), "record", F.lit(',"source":"anac"}')).alias("extracted_json"),
        _position().alias("pos"),
    )
    return drafts.filter(F.col("raw_url").isNotNull())


# ---- RSS ------------------------------------------------------------------------------------------------


def read_rss_feed(
    spark: SparkSession, path: str, scope: R.ScopeRules = R.ScopeRules(), feed_url: str = ""
) -> DataFrame:
    """In-scope drafts of RSS files; large files are split at item borders by the XML reader."""
    items = spark.read.format("xml").option("rowTag", "item").schema(schemas.RSS_ITEM).load(path)
    return rss_drafts(items, scope, feed_url)


def rss_drafts(
    items: DataFrame, scope: R.ScopeRules = R.ScopeRules(), feed_url: str = ""
) -> DataFrame:
    drafts = items.select(
        T.filled_stripped(F.col("link")).alias("raw_url"),
        F.col("title").alias("raw_title"),
        F.coalesce(T.filled(F.col("summary")), F.col("description")).alias("raw_body"),
        F.coalesce(
            V.rss_date(F.coalesce("pubDate", "published")), V.rss_date(F.col("updated"))
        ).alias("raw_date"),
        F.to_json(
            F.struct(
                F.lit(feed_url).alias("feed_url"),
                F.col("guid").alias("entry_id"),
                F.lit("guri").alias("source"),
            )
        ).alias("extracted_json"),
        _position().alias("pos"),
    )
    return gate(drafts.filter(F.col("raw_url").isNotNull()), scope)
