"""Feeds, pages, listings, extractions, documents and seeding on written files and literal rows."""

from __future__ import annotations

import hashlib
import json
from datetime import date

import pytest
from conftest import utc
from pyspark.sql import functions as F

from tenderglow import schemas
from tenderglow.operators import landing
from tenderglow.sources import dimensions, documents, extractions, feeds, listings, pages

NOW = utc(2026, 4, 22, 9, 30)


def write(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


def rows(df):
    return [r.asDict() | {"x": json.loads(r.extracted_json)} for r in df.orderBy("pos").collect()]


def test_lot_feed(spark, tmp_path):
    lots = [
        {"#Denominazione_Bando": "AQ SERVIZIO LUCE", "Denominazione_Lotto": "Lotto 3", "Categoria_Merceologica": "Strade",
         "Data_Pubblicazione": "15-04-2026", "Tipo_Procedura": "Aperta", "Tipo_Strumento": "Accordo quadro",
         "Base_Asta": "1000000", "Identificativo_Lotto": "L3"},
        {"#Denominazione_Bando": "Arredi"},
    ]
    (r,) = rows(feeds.read_lot_feed(spark, write(tmp_path / "2026.json", lots)))
    assert r["raw_title"] == "AQ SERVIZIO LUCE — Lotto 3" and r["raw_url"].endswith("#lotto=L3")
    assert r["raw_body"] == "Categoria: Strade; Tipo strumento: Accordo quadro; Tipo procedura: Aperta; Base asta: 1000000"
    assert r["raw_date"].date() == date(2026, 4, 15)
    assert r["x"]["importo"] == "1000000" and r["x"]["perimeter_prevalidated"] is True


def test_notice_feed(spark, tmp_path):
    notices = {
        "notices": [
            {"publication-number": "1-2026", "notice-title": {"eng": "Lights", "ita": "Luci"},
             "buyer-name": {"ita": ["Comune di A"]}, "publication-date": "2026-02-20+01:00",
             "links": {"htmlDirect": {"ENG": "https://e/1", "ITA": "https://i/1"}}, "procedure-type": "open",
             "total-value": 5493558.9, "deadline-receipt-tender-date-lot": ["2026-02-24+01:00"]},
            {"publication-number": "2-2026", "notice-title": {"deu": "Licht", "fra": "Lum"},
             "publication-date": "bad", "estimated-value-lot": ["5634419.40"]},
            {},
        ]
    }
    path = write(tmp_path / "n.json", notices)
    a, b, c = rows(feeds.read_notice_feed(spark, path))
    assert (a["raw_title"], a["raw_url"]) == ("Luci", "https://i/1")
    assert a["raw_body"] == "Ente: Comune di A; Numero pubblicazione TED: 1-2026"
    assert float(a["x"]["importo"]) == 5493558.9 and a["x"]["scadenza"] == "2026-02-24"
    assert (b["raw_title"], b["raw_date"]) == ("Licht", None)
    assert b["raw_url"] == "https://ted.europa.eu/en/notice/2-2026/html" and b["x"]["importo"] == "5634419.40"
    assert c["raw_title"] == "Bando TED senza titolo" and c["raw_url"].endswith("/v3/notices/search")
    # Notices without a date may be new, so no date of the run leaves them out.
    dated = lambda since: [r["raw_date"] is not None for r in rows(feeds.read_notice_feed(spark, path, since=since))]
    assert sorted(dated(utc(2026, 2, 1))) == [False, False, True]
    assert dated(utc(2026, 3, 1)) == [False, False]


def test_scanned_pages_do_not_depend_on_earlier_ones():
    """What a task keeps of tags leaves every page's rows as they are when it is scanned alone."""
    pages_ = [
        '<table class="gare"><tr><td class="oggetto"><a href="/1">Uno</a><td class=data>1/2/2026</table>',
        '<script>"<td class=\\"data\\">"</script><tr class="gara"><td class="oggetto"><a title="a>b" href="2">Due</a></td></tr>',
        '<style><tr class="gara"></style><TR CLASS="gara x"><td class="oggetto"><a href="2">D</a></tr><p/>< td>',
        '<tr class="gara"/><td class="oggetto"><a href="3">Tre</a></td></td ></tr a="x"><!-- <td class="data"> --><td class="data',
        "", "<a href='4'>Quattro", '<textarea><td class="data"></textarea><article class="bando"><h2><a href="5">V</a></h2></article>',
    ] * 2
    for profile in listings.PROFILES.values():
        kept = listings._Asked(profile)
        together = [listings.scan_page(p, "https://x/l/", kept) for p in pages_]
        assert together == [listings.scan_page(p, "https://x/l/", profile) for p in pages_]
        assert len(kept.read) > 5


def test_notice_numbers_are_read_with_their_file(spark, tmp_path):
    """Digits stay as written, over lines and files, and no file is read again for a number."""
    values = ["5493558.90", "12345678901234567890.123456789", "0.1e-3", "7"]
    size = 0
    for i in range(2):
        notices = ",\n".join(f'{{"publication-number": "{i}-{k}",\n "total-value": {v}}}' for k, v in enumerate(values * 100))
        size += (tmp_path / write(tmp_path / f"n{i}.json", '{"notices": [\n' + notices + "\n]}\n")).stat().st_size
    statistics = spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics
    before = sum(s.getBytesRead() for s in statistics())
    found = feeds.read_notice_feed(spark, str(tmp_path)).collect()
    assert sum(s.getBytesRead() for s in statistics()) - before < 3 * size
    assert sorted(json.loads(r.extracted_json)["importo"] for r in found) == sorted(values * 200)


def test_notice_feed_query_keeps_all_countries(spark, tmp_path):
    from datetime import datetime

    from tenderglow.plans.queries_sources import notice_feed

    orders = [(k, 1.5, datetime(1998, 1, 2)) for k in range(70)]
    frame = spark.createDataFrame(orders, "o_orderkey LONG, o_totalprice DOUBLE, o_orderdate TIMESTAMP")
    frame.write.parquet(str(tmp_path / "orders.parquet"))
    assert notice_feed(spark, str(tmp_path)).count() == 60  # all but those whose only code is not asked for


def test_old_notice_feed(spark, tmp_path):
    doc = {
        "results": [
            {"links": [{"x": 1}, {"url": "https://u/1"}], "TI": [{"value": "Titolo"}], "PD": ["20260401"], "CY": "IT"},
            {"links": [], "ND": "77", "title": "Altro", "PD": "2026"},
            {"TI": "senza link"},
        ]
    }
    a, b = rows(feeds.read_notice_feed(spark, write(tmp_path / "o.json", doc), layout="v3.0"))
    assert (a["raw_url"], a["raw_title"], a["raw_body"]) == ("https://u/1", "Titolo", "TI: Titolo | CY: IT")
    assert a["raw_date"].date() == date(2026, 4, 1) and a["x"]["notice"]["CY"] == "IT"
    assert (b["raw_url"], b["raw_title"], b["raw_date"]) == ("https://ted.europa.eu/udl?uri=TED:NOTICE:77", "Altro", None)
    with pytest.raises(ValueError):
        feeds.read_notice_feed(spark, str(tmp_path), layout="v9")


@pytest.mark.parametrize("wrap", [
    lambda r: r, lambda r: {"records": r}, lambda r: {"results": r}, lambda r: {"data": r},
    lambda r: {"result": {"records": r}}, lambda r: {"result": {"results": r}},
])
def test_open_data_feed(spark, tmp_path, wrap):
    records = [
        {"url": "https://a/1", "titolo": "T", "vuoto": "", "nullo": None, "zero": 0, "data_pubb": "2026-04-01T10:00:00Z"},
        {"oggetto": "senza link"},
    ]
    (r,) = rows(feeds.read_open_data_feed(spark, write(tmp_path / "a.json", wrap(records))))
    assert (r["raw_url"], r["raw_title"]) == ("https://a/1", "T")
    assert r["raw_body"] == "url: https://a/1 | titolo: T | zero: 0 | data_pubb: 2026-04-01T10:00:00Z"
    assert r["raw_date"].hour == 10 and r["x"]["record"]["titolo"] == "T"


def test_rss_feed(spark, tmp_path):
    item = "<item><title>{}</title><link>{}</link><description>{}</description><pubDate>{}</pubDate></item>"
    xml = "<rss><channel>" + "".join([
        item.format("Illuminazione pubblica", "https://g/1", "Gara", "Wed, 15 Apr 2026 10:00:00 +0200"),
        item.format("Relamping", "", "x", ""),
        item.format("Mensa", "https://g/3", "x", ""),
    ]) + "</channel></rss>"
    (r,) = rows(feeds.read_rss_feed(spark, write(tmp_path / "f.xml", xml), feed_url="https://g/rss"))
    assert (r["raw_url"], r["raw_date"].hour, r["x"]["source"]) == ("https://g/1", 8, "guri")


# ---- pages ----------------------------------------------------------------------------------------


def test_clean_pages(spark):
    html = "<p>a</p><SCRIPT x>\nvar b</SCRIPT><style>c{}</style><!-- d\n --> e  f"
    df = spark.createDataFrame([("u", html)], "url STRING, html STRING")
    assert pages.clean_pages(df).first().html == "<p>a</p> e f"
    long = spark.createDataFrame([("u", "x" * 100)], "url STRING, html STRING")
    assert pages.clean_pages(long, 10).first().html == "x" * 10 + "...[TRONCATO]"
    assert pages.needs_render(long, 101).count() == 1 and pages.needs_render(long, 100).count() == 0
    again = spark.createDataFrame([("u", "y" * 120), ("u", "z")], "url STRING, html STRING")
    assert pages.with_rendered(long, again, 101).first().html == "y" * 120
    assert pages.with_rendered(long, again, 50).first().html == "x" * 100


@pytest.mark.parametrize("html, link", [
    ('<a href="/b">Bandi di gara e contratti</a>', "https://h/b"),
    ("<a class=x href='c/d'> BANDI <b>di gara</b> </a>", "https://h/s/c/d"),
    ('<a href="#x">Bandi di gara</a><a href="JavaScript:y">Bandi di gara</a><a href="z">bandi di gara</a>', "https://h/s/z"),
    ('<!-- <a href="/no">bandi di gara</a> --><a href="/p?a=1&amp;b=2">bandi di gara</a>', "https://h/p?a=1&b=2"),
    ('<a href="/b">Contatti</a>', None),
    ("<p>niente</p>", None),
])
def test_section_link(spark, html, link):
    df = spark.createDataFrame([("https://h/s/", html)], "url STRING, html STRING")
    assert [r.link for r in pages.find_section_link(df).collect()] == ([link] if link else [])


TABLE = """<html><body><table class="gare"><thead><tr><th>Oggetto<th>Data</tr></thead><tbody>
<tr class=gara><td class="oggetto"><a href="/b/1">Relamping  LED illuminazione pubblica</a>
  <td class="data-pubblicazione">15/04/2026<td class="importo">&euro; 1.250.000,00</tr>
<tr class=gara><td class="oggetto"><a href="/b/2">Pulizia uffici</a><td class="importo">n.d.</tr>
<tr class=gara><td class="oggetto"><a href="/b/1">Relamping di nuovo</a></tr>
</tbody></table></body></html>"""
CARDS = """<section><div class="card gara"><h3><a href="x/9">Illuminazione stradale</a></h3>
<span class="data">oggi</span><time datetime="2026-04-12">ieri</time><span class="importo">€ 890.000</span></div>
<div class="card"><h3><a href="x/10">relamping</a></h3></div></section>"""
LOOSE = '<p>Annunci</p><a href="/l/1">Riqualificazione illuminazione</a><a href="/l/2">Arredo</a><a>relamping</a>'


def listing(spark, source, html, url="https://p/list", **options):
    df = spark.createDataFrame([(source, url, html)], schemas.PAGE)
    return listings.extract_listing_rows(df, NOW, **options)


def test_listing_table(spark):
    df = spark.createDataFrame([("asmecomm", "https://p/list", TABLE)], schemas.PAGE)
    page = listings.listing_pages(df).first()
    assert not page.loose and [r.raw_url for r in page.rows] == [None, "https://p/b/1", "https://p/b/2", "https://p/b/1"]
    (r,) = rows(listing(spark, "asmecomm", TABLE))
    assert r["raw_title"] == "Relamping LED illuminazione pubblica" and r["raw_date"].date() == date(2026, 4, 15)
    assert r["x"] == {"platform": "asmecomm", "listing_url": "https://p/list", "importo_raw": 1250000.0, "days_until": -7}
    assert r["raw_body"] == "Relamping LED illuminazione pubblica 15/04/2026 € 1.250.000,00"


def test_listing_cards_and_value_fallback(spark):
    (r,) = rows(listing(spark, "traspare", CARDS, "https://p/a/"))
    # The first date selector that exists does not parse, so the next one is tried.
    assert (r["raw_url"], r["raw_date"].date()) == ("https://p/a/x/9", date(2026, 4, 12))
    assert r["x"]["importo_raw"] == 890000.0


def test_listing_loose_links_and_row_limit(spark):
    (r,) = rows(listing(spark, "sconosciuto", LOOSE))
    assert r["raw_url"] == "https://p/l/1"
    many = "".join(f'<li class="bando"><a href="/{i}">relamping {i}</a></li>' for i in range(120))
    assert listing(spark, "generic_html", f"<ul>{many}</ul>", max_rows=100).count() == 100
    assert listing(spark, "generic_html", f"<ul>{many}</ul>").count() == 120


def test_links_met_on_two_pages_count_once(spark):
    df = spark.createDataFrame(
        [("asmecomm", f"https://p/{n}", TABLE) for n in "ab"] + [("tuttogare", "https://p/a", LOOSE)], schemas.PAGE
    )
    got = {(r.source_id, r.raw_url) for r in listings.extract_listing_rows(df, NOW).collect()}
    assert got == {("asmecomm", "https://p/b/1"), ("tuttogare", "https://p/l/1")}


# ---- landing --------------------------------------------------------------------------------------


def test_checksum_text(spark):
    df = spark.createDataFrame([("u", "t", utc(2026, 4, 15)), ("u", None, None)], "u STRING, t STRING, d TIMESTAMP")
    got = [r.c for r in df.select(landing.checksum(F.col("u"), F.col("t"), F.col("d")).alias("c")).collect()]
    assert got == [hashlib.sha256(x.encode()).hexdigest() for x in ("u|t|2026-04-15 00:00:00+00:00", "u||")]


def test_landing(spark):
    drafts = spark.createDataFrame(
        [("s", "relamping", "primo", "a", 2, "{}"), ("s", "relamping", "secondo", "a", 1, None),
         ("s", "mensa", None, "b", 3, None), ("t", "relamping", None, "a", 4, '{"k":1}')],
        "source_id STRING, raw_title STRING, raw_body STRING, raw_url STRING, pos BIGINT, extracted_json STRING",
    ).withColumn("raw_date", F.lit(None).cast("timestamp"))
    landed = {(r.source_id, r.raw_url): r for r in landing.land(drafts, NOW).collect()}
    assert set(landed) == {("s", "a"), ("t", "a")}
    first = landed["s", "a"]
    assert first.raw_body == "secondo" and first.extracted_json is None and first.normalized_at is None
    assert first.raw_date == first.fetched_at and len(first.id) == 64
    assert landing.land(drafts, NOW, scoped=False).count() == 3
    again = landing.land(drafts, NOW, existing=landing.land(drafts, NOW))
    assert again.count() == 0
    with pytest.raises(ValueError):
        landing.since_window(drafts, 8, NOW)


# ---- extractions, documents, dimensions ---------------------------------------------------------------

EXTRACTED = (
    "page_url STRING, title STRING, url STRING, date STRING, body STRING, cig STRING, ente STRING, scadenza STRING, "
    "atto_tipo STRING, source_id STRING, entity_id STRING"
)


def extracted(spark, *given):
    empty = spark.createDataFrame([], EXTRACTED)
    return spark.createDataFrame([tuple(g.get(c) for c in empty.columns) for g in given], EXTRACTED)


def test_acts(spark):
    page = {"page_url": "https://h/albo", "source_id": "s", "entity_id": "e"}
    df = extracted(
        spark, page | {"title": "Atto à/1", "date": "2026-04-01"}, page | {"title": "Atto 2", "date": "presto"},
        page | {"title": "Atto 3", "url": "d/3", "date": "2026-04-01T10:00:00+02:00"}, page,
    )
    a, b, c, d = rows(extractions.drafts_from_extractions(df, "act", NOW, "x"))
    assert a["raw_url"] == "https://h/albo#atto=Atto%20%C3%A0/1" and a["raw_date"].date() == date(2026, 4, 1)
    assert b["raw_date"].hour == 9 and b["checksum"] != a["checksum"]
    assert b["checksum"] == hashlib.sha256("https://h/albo#atto=Atto%202|Atto 2|".encode()).hexdigest()
    assert (c["raw_url"], c["raw_date"].hour) == ("https://h/d/3", 10)
    assert d["raw_url"] == "https://h/albo" and (d["source_id"], d["entity_id"]) == ("s", "e")
    landed = landing.land(extractions.drafts_from_extractions(df, "act", NOW, "x"), NOW, scoped=False)
    assert {r.checksum for r in landed.collect()} == {x["checksum"] for x in (a, b, c, d)}


def test_records_keep_their_own_links(spark):
    df = extracted(spark, {"page_url": "p", "title": "t", "cig": "C 1"}, {"page_url": "p", "url": "rel/1"})
    a, b = rows(extractions.drafts_from_extractions(df, "record", NOW, "x"))
    assert (a["raw_url"], b["raw_url"]) == ("p#record=C%201", "rel/1") and a["raw_date"] is None


def test_merge_details(spark):
    df = extracted(
        spark, {"url": "1", "ente": "", "body": "breve"}, {"url": "2", "ente": "A", "body": "breve"}, {"url": "3"},
    )
    details = spark.createDataFrame(
        [("1", "B", "2026-05-01", "lungo"), ("2", "B", "", "")], "url STRING, ente STRING, scadenza STRING, body STRING"
    )
    got = {r.url: (r.ente, r.scadenza, r.body) for r in extractions.merge_details(df, details).collect()}
    assert got == {"1": ("B", "2026-05-01", "lungo"), "2": ("A", None, "breve"), "3": (None, None, None)}


def test_documents(spark, tmp_path):
    write(tmp_path / "a.pdf", "uno")
    write(tmp_path / "b.pdf", "x" * 50)
    files = documents.read_files(spark, str(tmp_path), max_bytes=20).withColumn("record_id", F.lit("r1"))
    assert files.count() == 1 and documents.read_files(spark, str(tmp_path)).count() == 2
    (left_out,) = documents.rejected_files(spark, str(tmp_path), max_bytes=20).collect()
    assert left_out.url.endswith("b.pdf") and left_out.length == 50 and "20 bytes" in left_out.reason
    none = spark.createDataFrame([], schemas.DOCUMENT)
    twice = files.unionByName(files.withColumn("url", F.lit("https://h/p/z.pdf?x=1")))
    (d,) = documents.ingest_documents(twice, none, NOW).collect()
    assert d.filename == "a.pdf" and d.storage_url == "records/r1/2026/04/22/a.pdf"
    assert d.checksum == hashlib.sha256(b"uno").hexdigest()
    stored = documents.ingest_documents(twice, none, NOW)
    assert documents.ingest_documents(files, stored, NOW).count() == 0
    other = files.withColumn("record_id", F.lit("r2")).withColumn("filename", F.lit("c/d\\e.txt"))
    assert documents.ingest_documents(other, stored, NOW).first().storage_url.endswith("/c_d_e.txt")


def test_seeding_is_idempotent(spark):
    seed = spark.createDataFrame(
        [("A", "official", "p2", "https://a2"), ("B", "eproc_portal", "q", "https://b")],
        "name STRING, source_type STRING, platform_type STRING, base_url STRING",
    )
    none = spark.createDataFrame([], schemas.SOURCE)
    known = dimensions.seed_sources(none, seed.filter("name = 'A'").withColumn("base_url", F.lit("old")), NOW)
    once = dimensions.seed_sources(known.withColumn("active", F.lit(False)), seed, NOW)
    got = {r.name: (r.base_url, r.active, r.source_priority_rank, r.priority) for r in once.collect()}
    assert got == {"A": ("https://a2", False, 999, "B"), "B": ("https://b", True, 999, "B")}
    assert dimensions.seed_sources(once, seed, NOW).count() == 2
    places = spark.createDataFrame(
        [("C", "Lazio", "u1"), ("C", None, "u2"), ("C", "Lazio", "u3")], "name STRING, region STRING, url_albo STRING"
    )
    entities = dimensions.seed_entities(spark.createDataFrame([], schemas.ENTITY), places, NOW)
    assert entities.count() == 2 and dimensions.seed_entities(entities, places, NOW).count() == 2
    items = dimensions.seed_watchlist(spark.createDataFrame([], schemas.WATCHLIST_ITEM), entities, places, "s", NOW)
    assert items.count() == 3 and items.filter("entity_id IS NULL").count() == 0
    assert dimensions.seed_watchlist(items, entities, places, "s", NOW).count() == 3
    urls = extractions.watchlist_urls(items)
    assert {(r.kind, r.url) for r in urls.collect()} == {("albo", u) for u in ("u1", "u2", "u3")}
