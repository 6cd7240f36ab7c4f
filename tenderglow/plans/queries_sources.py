"""Queries over feeds, pages, files, dimensions and landing."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tenderglow import rules as R
from tenderglow import schemas
from tenderglow.functions import urls as U
from tenderglow.operators import landing, search
from tenderglow.plans import adapters as A
from tenderglow.plans import oracle_tables as O
from tenderglow.plans.registry import query
from tenderglow.session import scratch_path
from tenderglow.sources import dimensions, documents, extractions, feeds, listings, pages

NOW = A.RECORDS_NOW
# Scope rules for the given pages and documents, whose prose is invented.
PAGE_SCOPE = R.ScopeRules(include=("the", "ent"), exclude=("sch",), codes=())
LINK_TEXTS = ("sch", "tion", "and")


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def _field(key: str) -> Column:
    return F.get_json_object("extracted_json", f"$.{key}")


# ---- landing ------------------------------------------------------------------------------------


def _document_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as drafts; equal texts of a source are the same notice met again."""
    docs = A.load(spark, sf_dir, "documents", busy=True)
    return docs.select(
        F.col("source").alias("source_id"),
        F.lit(None).cast("string").alias("raw_title"),
        F.col("text").alias("raw_body"),
        F.concat(F.lit("https://d.example.com/"), F.md5(F.col("text").cast("binary"))).alias("raw_url"),
        F.lit(None).cast("timestamp").alias("raw_date"),
        F.lit(None).cast("string").alias("extracted_json"),
        F.col("doc_id").alias("pos"),
    )


_DRAFTS = f"""
drafts AS (
  SELECT doc_id, source, text, sha256('https://d.example.com/' || md5(text) || '||') AS checksum,
    {O.points('text', PAGE_SCOPE)} >= 1 AS keep
  FROM documents
)"""


@query("""
SELECT o_orderkey AS id, sha256('https://n.example.com/' || o_orderkey || '|'
  || CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority ELSE '' END || '|'
  || CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '+00:00'
     ELSE '' END) AS checksum
FROM orders
""")
def checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return A.load(spark, sf_dir, "orders").select(
        k.alias("id"),
        landing.checksum(
            F.concat(F.lit("https://n.example.com/"), _text(k)),
            F.when(k % 3 != 0, F.col("o_orderpriority")),
            F.when(k % 4 != 0, F.col("o_orderdate").cast("timestamp")),
        ).alias("checksum"),
    )


@query(f"""
WITH {_DRAFTS}
SELECT source AS source_id, checksum, min(doc_id) AS first_doc FROM drafts
WHERE keep GROUP BY source, checksum
""")
def land_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = _document_drafts(spark, sf_dir).withColumn("entity_id", _text("pos"))
    landed = landing.land(drafts, NOW, scope=PAGE_SCOPE)
    return landed.select("source_id", "checksum", F.col("entity_id").cast("bigint").alias("first_doc"))


@query(f"""
WITH {_DRAFTS}
SELECT source AS source_id, checksum FROM drafts GROUP BY source, checksum
HAVING checksum NOT IN (SELECT checksum FROM drafts WHERE doc_id % 2 = 0)
""")
def land_across_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prevalidated drafts without those an earlier run landed."""
    drafts = _document_drafts(spark, sf_dir)
    earlier = landing.land(drafts.filter(F.col("pos") % 2 == 0), NOW, scoped=False)
    landed = landing.land(drafts, NOW, scoped=False, existing=earlier)
    return landed.select("source_id", "checksum")


@query(f"""
WITH {_DRAFTS}
SELECT source AS source_id, count(*) AS records_found,
  count(DISTINCT checksum) FILTER (keep) AS records_valid, 0 AS records_weak,
  count(*) FILTER (keep) - count(DISTINCT checksum) FILTER (keep) AS duplicates_removed,
  CASE WHEN count(*) FILTER (keep) = 0 THEN 'partial' ELSE 'success' END AS status
FROM drafts GROUP BY source
""")
def collect_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.collect_metrics(_document_drafts(spark, sf_dir), scope=PAGE_SCOPE)


@query(f"""
WITH {O.SOURCES}
SELECT id, CASE WHEN id IN (SELECT user_id FROM events WHERE event_type <> 'view')
  THEN '2001-07-15' END AS checked FROM sources
""")
def touch_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "failed").otherwise("success")
    metrics = A.load(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), status.alias("status"))
    touched = landing.touch_sources(A.sources(spark, sf_dir), metrics, NOW)
    return touched.select("id", _day("last_checked_at").alias("checked"))


@query("""
SELECT o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01 12:00:00'
""")
def since_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = A.load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("raw_date")
    )
    return landing.since_window(drafts, 14, NOW).select("id")


# ---- feeds --------------------------------------------------------------------------------------


def _lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.load(spark, sf_dir, "orders", busy=True)
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("timestamp")
    return o.select(
        k.alias("k"),
        F.when(k % 13 != 0, A.pick(A.TITLES, k)).alias("#Denominazione_Bando"),
        F.when(k % 3 != 0, F.concat(F.lit("Lotto "), F.col("o_orderpriority"))).alias(
            "Denominazione_Lotto"
        ),
        F.when(k % 7 != 0, F.lit("Strade")).alias("Categoria_Merceologica"),
        F.when(k % 5 != 0, F.date_format(day, "dd-MM-yyyy")).otherwise("31-02-2001").alias(
            "Data_Pubblicazione"
        ),
        F.lit("Aperta").alias("Tipo_Procedura"),
        A.pick(A.INSTRUMENTS, k).alias("Tipo_Strumento"),
        F.when(k % 2 == 0, _text(F.col("o_totalprice").cast("decimal(18,2)"))).alias("Base_Asta"),
        F.when(k % 11 != 0, _text(k)).alias("Identificativo_Lotto"),
        F.lit(None).cast("string").alias("Data_Attivazione"),
        F.lit(None).cast("string").alias("Data_Termine"),
    )


_LOTS_SQL = f"""
WITH lots AS (
  SELECT *, CASE WHEN o_orderkey % 13 <> 0 THEN {O.listed(A.TITLES, 'o_orderkey')} ELSE '' END AS t,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'Lotto ' || o_orderpriority ELSE '' END AS l
  FROM orders
)
SELECT 'https://www.consip.it/bandi/aq-servizio-luce' || CASE WHEN o_orderkey % 11 <> 0
    THEN '#lotto=' || o_orderkey ELSE '' END AS raw_url,
  CASE WHEN l <> '' THEN t || ' — ' || l ELSE t END AS raw_title,
  'Categoria: ' || CASE WHEN o_orderkey % 7 <> 0 THEN 'Strade' ELSE '' END || '; Tipo strumento: '
    || {O.listed(A.INSTRUMENTS, 'o_orderkey')} || '; Tipo procedura: Aperta' || CASE
    WHEN o_orderkey % 2 = 0 THEN '; Base asta: ' || CAST(o_totalprice AS DECIMAL(18,2)) ELSE '' END
    AS raw_body,
  CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS published,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS importo,
  'true' AS prevalidated
FROM lots WHERE regexp_matches(lower(t || ' ' || l),
  'illuminazione|servizio luce|efficientamento energetico degli impianti')
"""


def _lot_columns(drafts: DataFrame) -> DataFrame:
    return drafts.select(
        "raw_url", "raw_title", "raw_body", _day("raw_date").alias("published"),
        _field("importo").alias("importo"), _field("perimeter_prevalidated").alias("prevalidated"),
    )


@query(_LOTS_SQL)
def lot_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lot_columns(feeds.lot_drafts(_lots(spark, sf_dir)))


@query(_LOTS_SQL)
def lot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots written to files of one JSON array each and read back."""
    lots = _lots(spark, sf_dir)
    rows = lots.select("k", F.to_json(F.struct(*[F.col(f"`{c}`") for c in lots.columns if c != "k"])).alias("notice"))
    path = _saved_answers(rows, "[", "]", "lots")
    return _lot_columns(feeds.read_lot_feed(spark, path))


def _notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.load(spark, sf_dir, "orders", busy=True)
    k, key = F.col("o_orderkey"), _text("o_orderkey")
    day = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd")
    title = F.concat(F.lit("Notice "), key)
    none = F.lit(None).cast("map<string,string>")
    doc = F.struct(
        F.when(k % 17 != 0, key).alias("publication-number"),
        F.when(k % 3 == 0, F.create_map(F.lit("eng"), title, F.lit("ita"), F.concat(title, F.lit(" it"))))
        .when(k % 3 == 1, F.create_map(F.lit("deu"), F.concat(title, F.lit(" de")), F.lit("eng"), title))
        .otherwise(none).alias("notice-title"),
        F.when(k % 4 != 0, F.create_map(F.lit("fra"), F.array(F.concat(F.lit("Ville "), key))))
        .alias("buyer-name"),
        F.concat(day, F.lit("+01:00")).alias("publication-date"),
        F.struct(
            F.when(k % 5 == 0, F.create_map(F.lit("ITA"), F.concat(F.lit("https://i/"), key)))
            .when(k % 5 == 1, F.create_map(F.lit("ENG"), F.concat(F.lit("https://e/"), key)))
            .alias("htmlDirect")
        ).alias("links"),
        F.lit("open").alias("procedure-type"),
        F.when(k % 2 == 0, F.col("o_totalprice").cast("decimal(18,2)")).alias("total-value"),
        F.array(F.lit("5634419.40")).alias("estimated-value-lot"),
        F.when(k % 6 != 0, F.array(F.concat(day, F.lit("+02:00"))))
        .alias("deadline-receipt-tender-date-lot"),
        F.when(k % 7 < 4, F.array(A.pick(R.NOTICE_CODES, k)))
        .when(k % 7 == 4, F.array(F.lit("99999999"))).alias("classification-cpv"),
        F.when(k % 10 < 5, F.to_json(F.array(F.lit("FRA"), F.lit("ITA")))).when(k % 10 == 5, "ITA")
        .when(k % 10 == 6, F.to_json(F.array(F.lit("DEU")))).when(k % 10 == 7, "FRA").alias("buyer-country"),
    )
    return o.select(k.alias("k"), F.to_json(doc).alias("notice"))


def _saved_answers(rows: DataFrame, opening: str, closing: str, name: str) -> str:
    """Folder of answer files: the ``notice`` texts of a run of 1,000 keys each, so no answer is longer than that.

    All files lie in one folder, so that writing and listing them takes no folder for each.
    """
    path = scratch_path(rows.sparkSession, name)
    answers = rows.groupBy(F.floor(F.col("k") / 1000).alias("answer")).agg(
        F.concat(F.lit(opening), F.array_join(F.collect_list("notice"), ","), F.lit(closing)).alias("value")
    )
    answers.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


_NOTICE_ROWS_SQL = """
SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'https://i/' || key WHEN o_orderkey % 5 = 1 THEN 'https://e/'
    || key WHEN o_orderkey % 17 <> 0 THEN 'https://ted.europa.eu/en/notice/' || key || '/html'
    ELSE 'https://api.ted.europa.eu/v3/notices/search' END AS raw_url,
  CASE o_orderkey % 3 WHEN 0 THEN 'Notice ' || key || ' it' WHEN 1 THEN 'Notice ' || key
    ELSE 'Bando TED senza titolo' END AS raw_title,
  CASE WHEN o_orderkey % 4 <> 0 THEN 'Ente: Ville ' || key || '; ' ELSE '' END
    || 'Numero pubblicazione TED: ' || CASE WHEN o_orderkey % 17 <> 0 THEN key ELSE '' END AS raw_body,
  strftime(o_orderdate, '%Y-%m-%d') AS published,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)
    ELSE 5634419.4 END AS importo,
  CASE WHEN o_orderkey % 6 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS scadenza
FROM n
"""
_NOTICES_SQL = f"""
WITH n AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS key FROM orders
  WHERE o_orderkey % 7 <> 4 AND o_orderkey % 10 NOT IN (6, 7)){_NOTICE_ROWS_SQL}"""


def _notice_columns(drafts: DataFrame) -> DataFrame:
    return drafts.select(
        "raw_url", "raw_title", "raw_body", _day("raw_date").alias("published"),
        _field("importo").cast("double").alias("importo"), _field("scadenza").alias("scadenza"),
    )


@query(f"""
WITH n AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS key FROM orders
  WHERE o_orderkey % 7 <> 4){_NOTICE_ROWS_SQL}""")
def notice_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of the notices of all countries (``notice_files`` asks for one)."""
    # Through JSON text, so the query reads notices the way a saved answer holds them.
    notices = _notices(spark, sf_dir).select(F.from_json("notice", schemas.NOTICE).alias("n")).select("n.*")
    return _notice_columns(feeds.notice_drafts(notices, country=""))


@query(f"{_NOTICES_SQL} WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def notice_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers written to files and read back, with the look-back counted from a moment in the day."""
    path = _saved_answers(_notices(spark, sf_dir), '{"notices":[', "]}", "notices")
    now = datetime(1998, 1, 15, 13, 30, tzinfo=timezone.utc)
    return _notice_columns(feeds.read_notice_feed(spark, path, now=now))


def _old_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notices in the older layout's many spellings: the texts before and after, and the notice."""
    o = A.load(spark, sf_dir, "orders", busy=True)
    k, key = F.col("o_orderkey"), _text("o_orderkey")
    day = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyyMMdd")
    title = F.to_json(F.struct(F.concat(F.lit("T"), key).alias("text")))
    # The title is an object, a list of objects, or a plain text.
    shown = (
        F.when(k % 3 == 0, title)
        .when(k % 3 == 1, F.concat(F.lit("["), title, F.lit("]")))
        .otherwise(F.concat(F.lit('"T'), key, F.lit('"')))
    )
    links = (
        F.when(k % 4 == 0, F.concat(F.lit('[{"href":"https://h/'), key, F.lit('"}]')))
        .when(k % 4 == 1, F.concat(F.lit('["https://s/'), key, F.lit('"]')))
        .otherwise("[]")
    )
    number = F.when(k % 8 != 7, F.concat(F.lit(',"ND":"'), key, F.lit('"'))).otherwise("")
    fields = F.concat(
        F.lit('{"TI":'), shown, F.lit(',"links":'), links, number, F.lit(',"PD":"'), day,
        F.lit('","CY":'), A.pick(('"IT"', '["DE","IT"]', '"FR"', "null"), F.floor(k / 8)),
        A.pick((",\"CPV\":[\"34928510\",\"71000000\"]", ",\"CPV\":\"71000000-8\"", ""), F.floor(k / 32)),
        F.lit(',"total-value":'), key, F.lit("}"),
    )
    return o.select(k.alias("k"), fields.alias("notice"))


_OLD_NOTICES_SQL = """
SELECT CASE o_orderkey % 4 WHEN 0 THEN 'https://h/' || o_orderkey WHEN 1 THEN 'https://s/' || o_orderkey
    ELSE 'https://ted.europa.eu/udl?uri=TED:NOTICE:' || o_orderkey END AS raw_url,
  'T' || o_orderkey AS raw_title,
  'TI: T' || o_orderkey || ' | total-value: ' || o_orderkey || CASE o_orderkey // 8 % 4 WHEN 0 THEN ' | CY: IT'
    WHEN 1 THEN ' | CY: DE' ELSE '' END AS raw_body,
  strftime(o_orderdate, '%Y-%m-%d') AS published, CAST(o_orderkey AS VARCHAR) AS kept_value
FROM orders WHERE NOT (o_orderkey % 4 > 1 AND o_orderkey % 8 = 7)
  AND o_orderkey // 8 % 4 <> 2 AND o_orderkey // 32 % 3 <> 1
"""


def _old_notice_columns(drafts: DataFrame) -> DataFrame:
    return drafts.select(
        "raw_url", "raw_title", "raw_body", _day("raw_date").alias("published"),
        F.get_json_object("extracted_json", "$.notice['total-value']").alias("kept_value"),
    )


@query(_OLD_NOTICES_SQL)
def old_notice_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapper = F.when(F.col("k") % 2 == 0, F.lit('{"notices":[')).otherwise('{"results":[')
    pages = _old_notices(spark, sf_dir).select(F.concat(wrapper, "notice", F.lit("]}")).alias("payload"))
    return _old_notice_columns(feeds.old_notice_drafts(pages))


@query(f"{_OLD_NOTICES_SQL} AND o_orderdate >= TIMESTAMP '1998-01-01'")
def old_notice_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _saved_answers(_old_notices(spark, sf_dir), '{"results":[', "]}", "old-notices")
    now = datetime(1998, 1, 8, 13, 30, tzinfo=timezone.utc)
    return _old_notice_columns(feeds.read_notice_feed(spark, path, now=now, layout="v3.0"))


@query("""
SELECT 'https://a.example.com/' || o_orderkey AS raw_url, o_orderpriority AS raw_title,
  CASE WHEN o_orderkey % 2 = 0 THEN 'url: https://a.example.com/' ELSE 'link_bando: https://a.example.com/' END
    || o_orderkey || ' | oggetto: ' || o_orderpriority || ' | data_pubb: '
    || strftime(o_orderdate, '%Y-%m-%d') || ' | n: ' || o_orderkey AS raw_body,
  strftime(o_orderdate, '%Y-%m-%d') AS published
FROM orders WHERE o_orderkey % 9 <> 0
""")
def open_data_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.load(spark, sf_dir, "orders", busy=True)
    k, key = F.col("o_orderkey"), _text("o_orderkey")
    link = F.when(k % 9 != 0, F.concat(F.lit("https://a.example.com/"), key))
    record = F.to_json(
        F.struct(
            F.when(k % 2 == 1, link).alias("link_bando"),
            F.when(k % 2 == 0, link).alias("url"),
            F.col("o_orderpriority").alias("oggetto"),
            F.lit("").alias("vuoto"),
            F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd").alias("data_pubb"),
            k.alias("n"),
        )
    )
    openings = ("[", '{"records":[', '{"results":[', '{"data":[', '{"result":{"records":[',
                '{"result":{"results":[')
    closings = ("]", "]}", "]}", "]}", "]}}", "]}}")
    payload = F.concat(A.pick(openings, k), record, A.pick(closings, k))
    drafts = feeds.open_data_drafts(o.select(payload.alias("payload")))
    return drafts.select("raw_url", "raw_title", "raw_body", _day("raw_date").alias("published"))


@query("""
SELECT 'https://a.example.com/' || o_orderkey AS raw_url,
  '{"record":{"url":"https://a.example.com/' || o_orderkey || '","n":' || o_orderkey || ',"aperto":'
    || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || ',"lotti":[{"cig":null,"anno":'
    || year(o_orderdate) || '}],"note":null},"source":"anac"}' AS extracted_json
FROM orders
""")
def open_data_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written to answer files and read back: numbers, flags, nested objects and nulls keep their types."""
    o = A.load(spark, sf_dir, "orders", busy=True)
    k, key = F.col("o_orderkey"), _text("o_orderkey")
    record = F.concat(
        F.lit('{"url":"https://a.example.com/'), key, F.lit('","n":'), key, F.lit(',"aperto":'),
        F.when(k % 2 == 0, "true").otherwise("false"), F.lit(',"lotti":[{"cig":null,"anno":'),
        _text(F.year(F.col("o_orderdate").cast("timestamp"))), F.lit('}],"note":null}'),
    )
    rows = o.select(k.alias("k"), record.alias("notice"))
    path = _saved_answers(rows, '{"result":{"records":[', "]}}", "open-data")
    return feeds.read_open_data_feed(spark, path).select("raw_url", "extracted_json")


@query(f"""
SELECT 'https://r.example.com/' || doc_id AS raw_url, 'Titolo ' || doc_id AS raw_title,
  md5(text) AS body_md5, '2026-04-15 08:00:00' AS published
FROM documents WHERE {O.points("('Titolo ' || doc_id || ' ' || text)", PAGE_SCOPE)} >= 1 AND doc_id % 6 <> 0
""")
def rss_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.load(spark, sf_dir, "documents", busy=True)
    k, key = F.col("doc_id"), _text("doc_id")
    none = F.lit(None).cast("string")
    items = docs.select(
        F.concat(F.lit("Titolo "), key).alias("title"),
        F.when(k % 6 != 0, F.concat(F.lit("https://r.example.com/"), key)).alias("link"),
        key.alias("guid"),
        F.when(k % 2 == 0, F.col("text")).alias("description"),
        F.when(k % 2 == 1, F.col("text")).alias("summary"),
        F.when(k % 2 == 0, "Wed, 15 Apr 2026 10:00:00 +0200").alias("pubDate"),
        none.alias("published"),
        F.when(k % 2 == 1, "2026-04-15T08:00:00Z").alias("updated"),
    )
    return feeds.rss_drafts(items, PAGE_SCOPE).select(
        "raw_url", "raw_title", F.md5(F.col("raw_body").cast("binary")).alias("body_md5"),
        F.date_format("raw_date", "yyyy-MM-dd HH:mm:ss").alias("published"),
    )


# ---- pages --------------------------------------------------------------------------------------


_CLEAN = """
cleaned AS (
  SELECT url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'),
    '<!--.*?-->', ' ', 'gs'), '[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]+', ' ', 'g') AS h
  FROM pages
)"""


@query(f"""
WITH {_CLEAN}
SELECT url, md5(CASE WHEN length(h) > 5000 THEN substr(h, 1, 5000) || '...[TRONCATO]' ELSE h END)
  AS html_md5, md5(h) AS whole_md5
FROM cleaned
""")
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = A.load(spark, sf_dir, "pages", busy=True)
    cleaned = given.select(
        "url", pages.cleaned(F.col("html"), 5000).alias("cut"),
        pages.cleaned(F.col("html"), None).alias("whole"),
    )
    return cleaned.select(
        "url", F.md5(F.col("cut").cast("binary")).alias("html_md5"),
        F.md5(F.col("whole").cast("binary")).alias("whole_md5"),
    )


@query(f"WITH {_CLEAN} SELECT url, length(h) AS n FROM cleaned WHERE length(h) < 3000")
def needs_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = A.load(spark, sf_dir, "pages", busy=True).select("url", "html")
    thin = pages.needs_render(pages.clean_pages(given, None))
    return thin.select("url", F.length("html").alias("n"))


@query(f"""
WITH {_CLEAN}, second AS (
  SELECT p.url, '<div>' || p.html || '</div>' AS s FROM pages p)
SELECT c.url, CASE WHEN length(h) < 3000 AND length(s) > length(h) THEN length(s) ELSE length(h) END AS n
FROM cleaned c JOIN second USING (url)
""")
def rendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = A.load(spark, sf_dir, "pages", busy=True).select("url", "html")
    again = given.select("url", F.concat(F.lit("<div>"), "html", F.lit("</div>")).alias("html"))
    both = pages.with_rendered(pages.clean_pages(given, None), again)
    return both.select("url", F.length("html").alias("n"))


@query("""
SELECT url, len(regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'),
  '<a\\s[^>]*href\\s*=[^>]*>.*?</a\\s*>', 0, 'is')) AS n_links
FROM pages
""")
def page_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = A.load(spark, sf_dir, "pages", busy=True)
    return given.select("url", F.size(pages.anchors(F.col("html"))).cast("bigint").alias("n_links"))


# Links of the given pages are plain <a href="…">text</a>, so they can be cut apart with one pattern.
_ANCHORS = """
anchors AS (
  SELECT url, i AS pos, regexp_extract(a, '<a\\s[^>]*href="([^"]*)"', 1) AS href,
    trim(regexp_replace(regexp_replace(replace(regexp_extract(a, '>(.*)</a', 1, 's'), '&amp;', '&'),
      '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS txt
  FROM (SELECT url, unnest(l) AS a, unnest(range(len(l))) AS i FROM (
    SELECT url, regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'),
      '<a\\s[^>]*href\\s*=[^>]*>.*?</a\\s*>', 0, 'is') AS l FROM pages))
)"""



def _resolved(href: str, url: str) -> str:
    return f"""CASE WHEN regexp_matches({href}, '^[a-zA-Z]+:') THEN {href}
      WHEN {href} LIKE '//%' THEN 'http:' || {href}
      WHEN {href} LIKE '/%' THEN regexp_extract({url}, '^([a-z]+://[^/]*)', 1) || {href}
      WHEN {href} LIKE '?%' THEN regexp_extract({url}, '^([^?#]*)', 1) || {href}
      WHEN {href} LIKE '#%' THEN regexp_extract({url}, '^([^#]*)', 1) || {href}
      WHEN {href} = '' THEN {url}
      ELSE regexp_extract({url}, '^([a-z]+://[^?#]*/)', 1) || {href} END"""


@query(f"""
WITH {_ANCHORS}, firsts AS (
  SELECT url, arg_min(href, pos) AS href FROM anchors
  WHERE href <> '' AND href NOT LIKE '#%' AND lower(href) NOT LIKE 'javascript:%'
    AND ({' OR '.join(f"contains(lower(txt), '{p}')" for p in LINK_TEXTS)})
  GROUP BY url)
SELECT url, {_resolved('href', 'url')} AS link FROM firsts
""")
def find_section_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.find_section_link(A.load(spark, sf_dir, "pages", busy=True), LINK_TEXTS)


@query(f"WITH {_ANCHORS} SELECT url, pos, txt AS text, {_resolved('href', 'url')} AS link FROM anchors")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_links(A.load(spark, sf_dir, "pages", busy=True))


@query(f"""
WITH {_ANCHORS}, loose AS (
  SELECT regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) AS source_id, url, txt,
    {_resolved('href', 'url')} AS link, pos
  FROM anchors WHERE href <> '' AND {O.points('txt', PAGE_SCOPE)} >= 1)
SELECT source_id, link AS raw_url, arg_min(txt, url || '#' || lpad(CAST(pos AS VARCHAR), 6, '0')) AS raw_title
FROM loose GROUP BY source_id, link
""")
def listing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the given pages by the generic profile: no selector fits, so links are scanned."""
    given = A.load(spark, sf_dir, "pages", busy=True).select(
        F.parse_url("url", F.lit("HOST")).alias("source"), "url", "html"
    )
    found = listings.extract_listing_rows(given, NOW, scope=PAGE_SCOPE)
    return found.select("source_id", "raw_url", "raw_title")


def _order_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as portal pages: table, card grid or item list by portal.

    A page holds the orders of one customer within a run of 1,000 order keys, so however many
    orders a customer has, no page has more rows than that.
    """
    o = A.load(spark, sf_dir, "orders")
    k, key = F.col("o_orderkey"), _text("o_orderkey")
    portal = A.pick(("asmecomm", "traspare", "sater"), F.col("o_custkey"))
    shown = F.date_format(F.col("o_orderdate").cast("timestamp"), "dd/MM/yyyy")
    money = F.concat(
        F.lit("€ "),
        F.translate(F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2), ",.", ".,"),
    )
    link = F.concat(F.lit('<a href="/b/'), key, F.lit('">'), A.pick(A.TITLES, k), F.lit("</a>"))
    row = F.when(
        F.col("o_custkey") % 3 == 0,
        F.concat(
            F.lit('<tr class="gara"><td class="oggetto">'), link,
            F.lit('</td><td class="data">'), shown, F.lit('</td><td class="importo">'), money,
            F.lit("</td></tr>"),
        ),
    ).when(
        F.col("o_custkey") % 3 == 1,
        F.concat(
            F.lit('<div class="card gara"><h3>'), link, F.lit('</h3><span class="data">'), shown,
            F.lit('</span><span class="importo">'), money, F.lit("</span></div>"),
        ),
    ).otherwise(
        F.concat(
            F.lit('<div class="bando-item"><h2>'), link, F.lit('</h2><time class="pub-date" datetime="'),
            F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd"),
            F.lit('">x</time><span class="importo-gara">'), money, F.lit("</span></div>"),
        )
    )
    part = F.floor(k / 1000)
    rows = o.select(
        "o_custkey", portal.alias("source"), part.alias("part"),
        F.struct(k.alias("k"), row.alias("r")).alias("x"),
    )
    gathered = rows.groupBy("o_custkey", "source", "part").agg(
        F.sort_array(F.collect_list("x")).alias("xs")
    )
    return gathered.select(
        "source",
        F.concat(
            F.lit("https://"), F.col("source"), F.lit(".example.com/l/"), _text("o_custkey"),
            F.lit("?p="), _text("part"),
        ).alias("url"),
        F.concat(
            F.lit("<html><body><table class='gare'>"), F.array_join("xs.r", "\n"),
            F.lit("</table></body></html>"),
        ).alias("html"),
    )


@query(f"""
WITH l AS (
  SELECT *, {O.listed(('asmecomm', 'traspare', 'sater'), 'o_custkey')} AS portal,
    {O.listed(A.TITLES, 'o_orderkey')} AS title,
    CAST(o_totalprice AS DECIMAL(18,2)) AS money FROM orders)
SELECT portal AS source_id, 'https://' || portal || '.example.com/b/' || o_orderkey AS raw_url,
  title AS raw_title, strftime(o_orderdate, '%Y-%m-%d') AS published,
  CAST(money AS DOUBLE) AS importo,
  date_diff('day', DATE '2001-07-15', CAST(o_orderdate AS DATE)) AS days_until
FROM l WHERE {O.points('title')} >= 1
""")
def listing_portals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = listings.extract_listing_rows(_order_listings(spark, sf_dir), NOW, max_rows=None)
    return found.select(
        "source_id", "raw_url", "raw_title", _day("raw_date").alias("published"),
        _field("importo_raw").cast("double").alias("importo"),
        _field("days_until").cast("int").alias("days_until"),
    )


@query("""
SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'https://x.example.com/' || o_orderkey
  WHEN 1 THEN 'https://p.example.com/r' || o_orderkey || '?q=1'
  WHEN 2 THEN 'https://p.example.com/a/c/r' || o_orderkey
  WHEN 3 THEN 'https://p.example.com/a/b/index.html?p=' || o_orderkey
  ELSE 'http://y.example.com/' || o_orderkey END AS link,
  'Lotto%20%2A' || o_orderkey || '/~%C3%A8%2B' AS quoted
FROM orders
""")
def resolve_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, key = F.col("o_orderkey"), _text("o_orderkey")
    base = F.when(k % 5 == 4, F.lit("http://p.example.com/a")).otherwise(
        "https://p.example.com/a/b/index.html?z=1#top"
    )
    ref = (
        F.when(k % 5 == 0, F.concat(F.lit("https://x.example.com/"), key))
        .when(k % 5 == 1, F.concat(F.lit("/r"), key, F.lit("?q=1")))
        .when(k % 5 == 2, F.concat(F.lit("../c/./r"), key))
        .when(k % 5 == 3, F.concat(F.lit("?p="), key))
        .otherwise(F.concat(F.lit("//y.example.com/"), key))
    )
    return A.load(spark, sf_dir, "orders", busy=True).select(
        k.alias("id"), U.resolve(base, ref).alias("link"),
        U.quote(F.concat(F.lit("Lotto *"), key, F.lit("/~è+"))).alias("quoted"),
    )


# ---- extractions, watchlist, documents, dimensions ----------------------------------------------


def _extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.load(spark, sf_dir, "orders", busy=True)
    k, key = F.col("o_orderkey"), _text("o_orderkey")
    day = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd")
    return o.select(
        F.lit("https://albo.example.com/lista").alias("page_url"),
        F.when(k % 5 != 0, F.concat(F.lit("Atto n. "), key)).alias("title"),
        F.when(k % 3 == 0, F.concat(F.lit("dettaglio/"), key)).alias("url"),
        F.when(k % 4 != 0, day).otherwise("presto").alias("date"),
        F.col("o_orderpriority").alias("body"),
        F.when(k % 2 == 0, F.concat(F.lit("CIG"), key)).alias("cig"),
        F.when(k % 6 == 0, F.lit("")).otherwise("Comune").alias("ente"),
        F.when(k % 7 == 0, day).alias("scadenza"),
        F.lit("determina").alias("atto_tipo"),
        F.lit(None).cast("string").alias("regione"),
        F.lit(None).cast("string").alias("provincia"),
        F.col("o_totalprice").alias("importo_eur"),
    )


@query("""
SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'dettaglio/' || o_orderkey
    WHEN o_orderkey % 2 = 0 THEN 'https://albo.example.com/lista#record=CIG' || o_orderkey
    WHEN o_orderkey % 5 <> 0 THEN 'https://albo.example.com/lista#record=Atto%20n.%20' || o_orderkey
    ELSE 'https://albo.example.com/lista' END AS raw_url,
  CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS published,
  CASE WHEN o_orderkey % 2 = 0 THEN 'CIG' || o_orderkey END AS cig, o_totalprice AS importo
FROM orders
""")
def extraction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = extractions.drafts_from_extractions(
        _extractions(spark, sf_dir), "record", NOW, "page-extraction"
    )
    return drafts.select(
        "raw_url", _day("raw_date").alias("published"), _field("cig").alias("cig"),
        _field("importo").cast("double").alias("importo"),
    )


@query("""
WITH a AS (
  SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'https://albo.example.com/dettaglio/' || o_orderkey
    WHEN o_orderkey % 5 <> 0 THEN 'https://albo.example.com/lista#atto=Atto%20n.%20' || o_orderkey
    ELSE 'https://albo.example.com/lista' END AS raw_url FROM orders)
SELECT raw_url, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d')
  ELSE '2001-07-15' END AS published, 'determina' AS atto_tipo,
  sha256(raw_url || '|' || CASE WHEN o_orderkey % 5 <> 0 THEN 'Atto n. ' || o_orderkey ELSE '' END
    || '|' || CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00+00:00'
    ELSE '' END) AS checksum
FROM a
""")
def extraction_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = extractions.drafts_from_extractions(
        _extractions(spark, sf_dir), "act", NOW, "page-extraction"
    )
    return drafts.select(
        "raw_url", _day("raw_date").alias("published"), _field("atto_tipo").alias("atto_tipo"),
        "checksum",
    )


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'Ente ' || o_custkey ELSE 'Comune' END AS ente,
  CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '2001-12-31' END AS scadenza,
  CASE WHEN o_custkey % 3 = 0 THEN 'corpo ' || o_custkey
    ELSE o_orderpriority END AS body
FROM orders
""")
def merge_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    records = o.select(
        k.alias("id"), F.col("o_custkey").alias("url"),
        F.when(k % 6 == 0, "").otherwise("Comune").alias("ente"),
        F.when(k % 7 == 0, F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd"))
        .alias("scadenza"),
        F.col("o_orderpriority").alias("body"),
    )
    c = F.col("c_custkey")
    details = A.load(spark, sf_dir, "customer").select(
        c.alias("url"), F.concat(F.lit("Ente "), _text(c)).alias("ente"),
        F.lit("2001-12-31").alias("scadenza"),
        F.when(c % 3 == 0, F.concat(F.lit("corpo "), _text(c))).otherwise("").alias("body"),
    )
    return extractions.merge_details(records, details).select("id", "ente", "scadenza", "body")


def _watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return A.load(spark, sf_dir, "customer").select(
        c.alias("id"), (c % 100).alias("entity_id"), (c % 10).alias("source_id"),
        F.when(c % 3 != 0, F.concat(F.lit("https://albo/"), _text(c))).alias("url_albo"),
        F.when(c % 4 != 0, F.concat(F.lit("https://tras/"), _text(c))).alias("url_trasparenza"),
        (c % 5 != 0).alias("active"), F.lit(None).cast("timestamp").alias("last_scan_at"),
        A.pick(("A", "B", "C"), c).alias("priority"),
        F.timestamp_add("DAY", c.cast("int"), F.lit(datetime(2020, 1, 1, tzinfo=timezone.utc)))
        .alias("created_at"),
    )


@query("""
SELECT c_custkey AS item_id, 'albo' AS kind, 'https://albo/' || c_custkey AS url FROM customer
WHERE c_custkey % 5 <> 0 AND c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, 'trasparenza', 'https://tras/' || c_custkey FROM customer
WHERE c_custkey % 5 <> 0 AND c_custkey % 4 <> 0
""")
def watchlist_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extractions.watchlist_urls(_watchlist(spark, sf_dir)).select("item_id", "kind", "url")


@query("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 AND NOT (c_custkey % 12 = 0)
  THEN '2001-07-15' END AS scanned FROM customer
""")
def mark_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _watchlist(spark, sf_dir)
    done = extractions.mark_scanned(items, extractions.watchlist_urls(items), NOW)
    return done.select("id", _day("last_scan_at").alias("scanned"))


@query("""
WITH f AS (
  SELECT doc_id % 50 AS record_id, doc_id, sha256(text) AS checksum,
    CASE WHEN doc_id % 3 = 0 THEN 'documento' || doc_id || '.pdf' ELSE 'file_' || doc_id || '.txt' END AS n,
    'https://d.example.com/x/file_' || doc_id AS u
  FROM documents),
g AS (
  SELECT record_id, checksum, arg_min(n, u) AS n FROM f
  GROUP BY record_id, checksum)
SELECT CAST(record_id AS VARCHAR) AS procurement_record_id, checksum, n AS filename,
  'records/' || record_id || '/2001/07/15/' || n AS storage_url
FROM g WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id % 9 = 0 AND f.checksum = g.checksum
  AND f.record_id = g.record_id)
""")
def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.load(spark, sf_dir, "documents", busy=True)
    k, key = F.col("doc_id"), _text("doc_id")
    files = docs.select(
        (k % 50).alias("record_id"),
        F.concat(F.lit("https://d.example.com/x/file_"), key, F.lit(".txt?v=1")).alias("url"),
        F.when(k % 3 == 0, F.concat(F.lit("documento"), key, F.lit(".pdf"))).alias("filename"),
        F.col("text").cast("binary").alias("content"),
        (k % 9 == 0).alias("known"),
    )
    existing = files.filter("known").select(
        _text("record_id").alias("procurement_record_id"), F.sha2("content", 256).alias("checksum")
    )
    stored = documents.ingest_documents(files, existing, NOW)
    return stored.select("procurement_record_id", "checksum", "filename", "storage_url")


def _source_seed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = A.load(spark, sf_dir, "supplier")
    k, key = F.col("s_suppkey"), _text("s_suppkey")
    current = s.filter(k % 3 != 0).select(
        *[
            {
                "id": key, "name": F.col("s_name"), "source_type": F.lit("official"),
                "platform_type": F.lit("old"), "base_url": F.lit("https://old"),
                "priority": F.lit("C"), "source_priority_rank": k, "active": F.lit(False),
            }.get(name, F.lit(None)).cast(kind).alias(name)
            for name, kind in _fields(schemas.SOURCE)
        ]
    )
    seed = s.select(
        F.col("s_name").alias("name"), F.lit("eproc_portal").alias("source_type"),
        F.lit("new").alias("platform_type"), F.concat(F.lit("https://new/"), key).alias("base_url"),
        F.when(k % 2 == 1, 2).alias("source_priority_rank"),
    )
    return current, seed


def _fields(schema: str) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in S.StructType.fromDDL(schema)]


@query("""
SELECT s_name AS name, CASE WHEN s_suppkey % 3 <> 0 THEN 'official' ELSE 'eproc_portal' END AS source_type,
  'new' AS platform_type, 'https://new/' || s_suppkey AS base_url,
  CASE WHEN s_suppkey % 3 <> 0 THEN 'C' ELSE 'B' END AS priority,
  CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey WHEN s_suppkey % 2 = 1 THEN 2 ELSE 999 END AS source_priority_rank,
  s_suppkey % 3 = 0 AS active
FROM supplier
""")
def seed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, seed = _source_seed(spark, sf_dir)
    return dimensions.seed_sources(current, seed, NOW).select(
        "name", "source_type", "platform_type", "base_url", "priority", "source_priority_rank", "active"
    )


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entities; every seventh has no region."""
    c = F.col("c_custkey")
    return A.load(spark, sf_dir, "customer").select(
        c.alias("k"), F.col("c_name").alias("name"),
        F.when(c % 7 != 0, F.col("c_mktsegment")).alias("region"),
        F.concat(F.lit("https://albo/"), _text(c)).alias("url_albo"),
        F.lit("comune").alias("entity_type"),
    )


def _entity_seed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All customers as seed, two thirds of them stored before."""
    rows = _entities(spark, sf_dir)
    current = rows.filter("k % 3 <> 0").select(
        *[
            {"id": _text("k"), "name": F.col("name"), "region": F.col("region")}
            .get(name, F.lit(None)).cast(kind).alias(name)
            for name, kind in _fields(schemas.ENTITY)
        ]
    )
    return current, rows


@query("""
SELECT c_name AS name, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS region,
  c_custkey % 3 = 0 AS inserted
FROM customer
""")
def seed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, seed = _entity_seed(spark, sf_dir)
    seeded = dimensions.seed_entities(current, seed, NOW)
    return seeded.select("name", "region", (F.length("id") == 64).alias("inserted"))


@query("""
SELECT c_name AS name, 'https://albo/' || c_custkey AS url_albo, c_custkey % 5 <> 0 AS inserted
FROM customer
""")
def seed_watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, seed = _entity_seed(spark, sf_dir)
    entities = dimensions.seed_entities(current, seed, NOW)
    empty = spark.createDataFrame([], schemas.WATCHLIST_ITEM)
    first = dimensions.seed_watchlist(empty, entities, seed.filter("k % 5 = 0"), "s1", NOW)
    later = NOW + timedelta(days=1)
    items = dimensions.seed_watchlist(first, entities, seed, "s1", later)
    names = entities.select(F.col("id").alias("entity_id"), "name")
    return items.join(names, "entity_id").select(
        "name", "url_albo", (_day("created_at") == "2001-07-16").alias("inserted")
    )


# ---- listings of dimensions -----------------------------------------------------------------------


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 <> 0")
def list_watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.list_watchlist(_watchlist(spark, sf_dir), active=True).select("id")


@query(f"WITH {O.SOURCES} SELECT id, name, active FROM sources")
def list_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.list_sources(A.sources(spark, sf_dir)).select("id", "name", "active")


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer
WHERE c_custkey % 7 <> 0 AND c_mktsegment = 'MACHINERY'
""")
def list_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = _entities(spark, sf_dir).withColumn("id", _text("k"))
    return search.list_entities(entities, region="MACHINERY").select("id", "name")


@query("""
SELECT doc_id FROM documents WHERE doc_id % 20 = 3
""")
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    stored = A.load(spark, sf_dir, "documents").select(
        "doc_id", k.alias("id"), _text(k % 20).alias("procurement_record_id"),
        F.lit(NOW).alias("created_at"),
    )
    return search.list_documents(stored, "3").select("doc_id")
