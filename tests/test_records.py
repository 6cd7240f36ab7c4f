"""Normalise, deduplicate, score, anomalies, report, search and export on literal rows."""

from __future__ import annotations

import csv
import io
import json
import re
from datetime import date, timedelta
from decimal import Decimal

import pytest
from conftest import utc
from pyspark.sql import functions as F

from tenderglow import rules as R
from tenderglow import schemas
from tenderglow.operators import (
    anomalies, dedupe, export, joins, kpi, landing, listing_index, normalise, report, scoring, search,
)

NOW = utc(2026, 4, 22, 10)


def frame(spark, rows, schema):
    """Rows given as dicts; absent columns are null."""
    empty = spark.createDataFrame([], schema)
    return spark.createDataFrame([tuple(r.get(c) for c in empty.columns) for r in rows], schema)


def record(**values):
    base = {
        "id": "1", "ente": "Comune", "descrizione": "Servizio", "link_bando": "u", "cig": None,
        "stato_procedurale": R.PUBLISHED, "tipo_novita": R.NEW_TODAY, "source_priority_rank": 1,
        "is_weak_evidence": False, "macrosettore": R.SECTOR, "first_seen_at": utc(2026, 4, 22),
        "last_seen_at": utc(2026, 4, 22), **{f: R.NO for f in R.FLAGS},
    }
    return base | values


# ---- normalise --------------------------------------------------------------------------------


def normalised(spark, doc, title="Relamping LED illuminazione pubblica", body=None, rank=2, url="https://x/1",
               raw_date=None, **hints):
    raw = frame(
        spark,
        [{"id": "1", "source_id": "s", "raw_title": title, "raw_body": body, "raw_url": url,
          "raw_date": raw_date, "extracted_json": json.dumps(doc) if doc is not None else None,
          "fetched_at": NOW}],
        schemas.RAW_RECORD,
    )
    sources = frame(spark, [{"id": "s", "name": "S", "source_priority_rank": rank}], schemas.SOURCE)
    waiting = normalise.pending(raw, sources)
    for name, value in hints.items():
        waiting = waiting.withColumn(f"{name}_hint", F.lit(value))
    return normalise.normalise(waiting).collect()


def test_full_record(spark):
    (r,) = normalised(
        spark,
        {"ente": "Comune di A", "cig": "abcdef1234", "importo": "€ 1.250.000,00", "scadenza": "20/05/2026",
         "procedura": "Aperta", "regione": "Lazio"},
        body="telegestione",
    )
    assert (r.validation_level, r.reliability_index, r.is_weak_evidence) == ("L3", "Alta", False)
    assert (r.importo, r.cig, r.ente, r.regione) == (Decimal("1250000.00"), "ABCDEF1234", "Comune di A", "Lazio")
    # The LED and remote-control tags, and upkeep by the word "gestione" inside it.
    assert r.tag_tecnico == ["LED", "telegestione", "manutenzione"]


def test_scope_gate_and_prevalidated(spark):
    assert normalised(spark, {}, title="Pulizia uffici") == []
    assert len(normalised(spark, {"perimeter_prevalidated": True}, title="Pulizia uffici")) == 1
    assert normalised(spark, {"perimeter_prevalidated": False}, title="Pulizia uffici") == []


def test_weak_without_identifiers_and_rank(spark):
    (r,) = normalised(spark, None, rank=7)
    assert (r.is_weak_evidence, r.validation_level, r.reliability_index, r.ente) == (True, "L1", "Bassa", "n.d.")
    (r,) = normalised(spark, {"cig": "not-a-cig", "ente": "E"}, rank=4)
    assert (r.cig, r.reliability_index, r.is_weak_evidence) == (None, "Media", True)


def test_frameworks_need_no_buyer(spark):
    (r,) = normalised(spark, {"tipo_strumento": " Accordo Quadro ", "importo": "10"})
    assert (r.is_weak_evidence, r.ente) == (False, "Strumento quadro multi-ente (Accordo Quadro)")
    (r,) = normalised(spark, {"tipo_strumento": "Appalto", "importo": "10"})
    assert (r.is_weak_evidence, r.ente) == (True, "n.d.")


def test_late_buyer_hint_zero_amount_and_dates(spark):
    (r,) = normalised(spark, {"buyer_name_1": "B", "importo": "0", "cig": "ABCDEFGH12", "pub_date": "1/2/2026"})
    # A late buyer is shown but does not lift the weak mark; amount 0 is no identifier of level 3.
    assert (r.ente, r.is_weak_evidence, r.validation_level, r.importo) == ("B", True, "L2", Decimal("0.00"))
    assert r.data_pubblicazione.date() == date(2026, 2, 1)
    (r,) = normalised(spark, {"ente": "E", "importo": 1234.567}, ente="Hint", raw_date=utc(2026, 1, 2))
    assert (r.ente, r.importo, r.data_pubblicazione.date()) == ("Hint", Decimal("1234567.00"), date(2026, 1, 2))


def test_description_falls_back_and_flags_see_procedure(spark):
    (r,) = normalised(
        spark, {"oggetto": "Servizio luce", "procedura": "in concessione", "perimeter_prevalidated": 1}, title=None
    )
    assert r.descrizione == "Servizio luce"
    assert (r.flag_ppp_doppio_oggetto, r.flag_concessione_ambito) == ("Yes", "Yes")


def test_act_type_decides_state(spark):
    (r,) = normalised(spark, {"atto_tipo": "determina"})
    assert r.stato_procedurale == R.PRE_TENDER


def test_novelty(spark, column):
    def kind(state, existing, seen, published):
        return lambda c: normalise.novelty(F.lit(state), F.lit(existing), F.lit(seen), F.lit(published), NOW)

    today, before = utc(2026, 4, 22), utc(2026, 4, 12)
    assert column(["x"], kind(R.PRE_TENDER, True, today, before)) == [R.PRE_TENDER_SIGNAL]
    assert column(["x"], kind(R.PUBLISHED, True, today, before)) == [R.KNOWN_UPDATE]
    assert column(["x"], kind(R.PUBLISHED, False, today, before)) == [R.SURFACED_TODAY]
    assert column(["x"], kind(R.PUBLISHED, False, today, today)) == [R.NEW_TODAY]
    assert column(["x"], kind(R.PUBLISHED, False, before, before)) == [R.NEW_TODAY]


# ---- deduplicate and score ----------------------------------------------------------------------


def test_dedup_key(spark):
    rows = [
        record(id="1", cig=" abc123defg ", importo=Decimal("10")),
        record(id="2", ente="Ente", descrizione="Ogg", importo=Decimal("1240000")),
        record(id="3", ente="ENTE ", descrizione=" ogg", importo=Decimal("1260000")),
        record(id="4", ente="e" * 40, descrizione=None),
        record(id="5", ente="e", descrizione="o", importo=Decimal("25000")),
        record(id="6", ente="e", descrizione="o", importo=Decimal("75000")),
    ]
    keys = {r.id: r.dedup_key for r in dedupe.with_dedup_key(frame(spark, rows, schemas.RECORD)).collect()}
    assert keys["1"] == "cig:ABC123DEFG"
    assert keys["2"] == keys["3"] == "eo:ente|ogg|1250000"
    assert keys["4"] == f"eo:{'e' * 28}||x"
    # Halves go to the even bucket: 0.5 to 0, 1.5 to 2.
    assert keys["5"].endswith("|0") and keys["6"].endswith("|100000")


@pytest.mark.parametrize("hot_rows", [1_000_000, 1])
def test_elect_master(spark, hot_rows):
    rows = [
        record(id="a", dedup_key="k", source_priority_rank=4),
        record(id="b", dedup_key="k", source_priority_rank=1, first_seen_at=utc(2026, 4, 21)),
        record(id="c", dedup_key="k", source_priority_rank=1),
        record(id="d", dedup_key="k", source_priority_rank=0, first_seen_at=utc(2020, 1, 1)),
        record(id="e", dedup_key="single", master_record_id="stale"),
        record(id="f", dedup_key=None), record(id="g", dedup_key=None),
    ]
    out = dedupe.elect_master(frame(spark, rows, schemas.RECORD), hot_rows=hot_rows).collect()
    got = {r.id: r.master_record_id for r in out}
    assert got == {"a": "b", "b": None, "c": "b", "d": "b", "e": None, "f": None, "g": None}


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_attach_keeps_every_row_of_a_hot_key(spark, hot_rows):
    left = spark.range(1000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, None)
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 100).cast("string"))).alias("key"),
    )
    right = left.filter("key IS NOT NULL AND key != 'k7'").select("key").distinct().select(
        "key", F.upper("key").alias("v"), F.lit(None).cast("string").alias("nothing")
    )
    out = joins.attach(left, right, "key", spread_by="id", hot_rows=hot_rows, hot_keys=2)
    assert out.columns == ["id", "key", "v", "nothing"]
    rows = out.collect()
    assert len(rows) == 1000 and len({r.id for r in rows}) == 1000
    for r in rows:
        assert r.v == (None if r.key in (None, "k7") else r.key.upper())


def scored(spark, **values):
    (r,) = scoring.score(frame(spark, [record(**values)], schemas.RECORD), NOW).collect()
    return r.score_commerciale, r.priorita_commerciale


def test_amount_bands(spark):
    wanted = {"12000000": 35, "6000000": 28, "3000000": 20, "1500000": 14, "700000": 8, "100000": 3, None: 3}
    rows = [record(id=str(i), importo=Decimal(a) if a else None) for i, a in enumerate(wanted)]
    out = scoring.score(frame(spark, rows, schemas.RECORD), NOW).collect()
    assert [r.score_commerciale - 25 for r in sorted(out, key=lambda r: int(r.id))] == list(wanted.values())


def test_states_deadlines_bonuses(spark):
    assert scored(spark, stato_procedurale=R.PRE_TENDER, descrizione="Delibera di giunta")[0] == 23
    assert scored(spark, stato_procedurale=R.PRE_TENDER)[0] == 11
    assert scored(spark, stato_procedurale=R.AMENDED)[0] == 23
    assert scored(spark, stato_procedurale=R.OUTCOME)[0] == 13
    for days, points in {2: 20, 5: 15, 10: 10, 20: 5, 45: 0, -9: 20}.items():
        assert scored(spark, scadenza=NOW + timedelta(days=days))[0] == 28 + points
    assert scored(spark, flag_ppp_doppio_oggetto="Yes", tag_tecnico="PNRR, sopra soglia UE")[0] == 28 + 18
    assert scored(spark, tag_tecnico="Accordo quadro,global service")[0] == 31


def test_priorities(spark):
    assert scored(
        spark, importo=Decimal(8_000_000), scadenza=NOW + timedelta(days=4), flag_ppp_doppio_oggetto="Yes",
        tag_tecnico="PNRR,sopra soglia UE,accordo quadro",
    ) == (89, "P1")
    assert scored(spark, importo=Decimal(6_000_000))[1] == "P1"
    assert scored(spark, stato_procedurale=R.OUTCOME, scadenza=NOW + timedelta(days=1))[1] == "P1"
    # A past deadline scores but does not force the first tier.
    assert scored(spark, stato_procedurale=R.OUTCOME, scadenza=NOW - timedelta(days=1)) == (33, "P3")
    assert scored(spark, scadenza=NOW + timedelta(days=3), flag_ppp_doppio_oggetto="Yes") == (56, "P2")
    assert scored(spark, stato_procedurale=R.OUTCOME)[1] == "P4"


# ---- anomalies ----------------------------------------------------------------------------------


def alerts_for(spark, records, events=(), alerts=()):
    out = anomalies.detect(
        frame(spark, records, schemas.RECORD),
        frame(spark, [{"id": str(i), "procurement_record_id": "1", **e} for i, e in enumerate(events)],
              schemas.RECORD_EVENT),
        frame(spark, list(alerts), schemas.ALERT),
        NOW,
    ).collect()
    return {r.alert_type: (r.severity, r.description) for r in out}


def ev(kind, days_ago, description=None):
    return {"event_type": kind, "event_date": NOW - timedelta(days=days_ago), "description": description}


def test_repeated_extension(spark):
    found = alerts_for(spark, [record()], [ev("Proroga", 20), ev("proroga", 5), ev("proroga", 31)])
    assert found == {
        "proroga_multipla": ("high", "[key:proroga_multipla:1] 2 proroghe registrate negli ultimi 30 giorni")
    }
    assert alerts_for(spark, [record()], [ev("proroga", 5), ev("proroga", 40)]) == {}


def test_revocation_after_publication(spark):
    published = record(data_pubblicazione=NOW - timedelta(days=10))
    found = alerts_for(spark, [published], [ev("revoca", 12), ev("revoca", 3), ev("revoca", 2)])
    assert found["revoca_post_pubblicazione"][1].endswith(
        "Revoca rilevata il 2026-04-19 dopo pubblicazione del 2026-04-12"
    )
    assert alerts_for(spark, [published], [ev("revoca", 12)]) == {}
    assert alerts_for(spark, [record()], [ev("revoca", 3)]) == {}


def test_appeals(spark):
    found = alerts_for(spark, [record()], [ev("nota", 2, "Ricorso depositato"), ev("ricorso_tar", 5)])
    # The earlier event has no text, so the default is used.
    assert found["ricorso_tar"][1].endswith("] Ricorso/TAR registrato il 2026-04-17")
    assert "ricorso_tar" in alerts_for(spark, [record()], [ev("nota", 2, "sentenza TAR Lazio")])
    assert "ricorso_tar" in alerts_for(spark, [record()], [ev("startato", 2)])
    assert alerts_for(spark, [record()], [ev("nota", 2, "ore TAR")]) == {}


def test_bridge_and_stalled(spark):
    assert "procedura_ponte" in alerts_for(spark, [record(descrizione="Gara PONTE")])
    assert alerts_for(spark, [record(descrizione="gara ponte", stato_procedurale=R.OUTCOME)]) == {}
    amended = {"stato_procedurale": R.AMENDED}
    found = alerts_for(spark, [record(**amended, first_seen_at=NOW - timedelta(days=20, hours=1))])
    assert found["stato_stallo"] == ("low", "[key:stato_stallo:1] Gara in stato RETTIFICA da 20 giorni")
    assert alerts_for(spark, [record(**amended, first_seen_at=NOW - timedelta(days=5))]) == {}
    # The earliest event of any type counts, not the first sight.
    seen_long_ago = record(**amended, first_seen_at=NOW - timedelta(days=50))
    assert alerts_for(spark, [seen_long_ago], [ev("nota", 3)]) == {}


def test_open_keys_are_suppressed(spark):
    alert = {"id": "x", "alert_type": "procedura_ponte", "description": "[key:procedura_ponte:1] t"}
    bridge = [record(descrizione="ponte")]
    assert alerts_for(spark, bridge, alerts=[alert | {"is_open": True}]) == {}
    assert "procedura_ponte" in alerts_for(spark, bridge, alerts=[alert | {"is_open": False}])
    table = frame(spark, [alert | {"is_open": True}], schemas.ALERT)
    (closed,) = anomalies.close_alerts(table, table.select("id"), NOW).collect()
    assert closed.is_open is False and closed.closed_at is not None


# ---- report, KPI ----------------------------------------------------------------------------------


def report_of(spark, records, runs=(), alerts=()):
    row = report.report_row(
        frame(spark, records, schemas.RECORD),
        frame(spark, list(runs), schemas.JOB_RUN),
        frame(spark, [{"id": "s1", "name": "Portale"}], schemas.SOURCE),
        frame(spark, list(alerts), schemas.ALERT),
        NOW.date(), NOW,
    )
    (r,) = row.collect()
    return r, json.loads(r.report_json)


def test_empty_report(spark):
    row, doc = report_of(spark, [])
    assert set(doc["kpi"].values()) == {0} and len(doc["kpi"]) == 9
    assert doc["nuove_gare"] == [] and doc["generated_at"] == "2026-04-22T10:00:00+00:00"
    assert "Nessuna gara pubblicata oggi." in row.markdown
    assert row.markdown.startswith("# Report · Illuminazione pubblica · 22 April 2026\n")
    assert "0 fonti · 0 ok · 0 errori · 0 parziali" in row.markdown


def test_report_sections_and_kpi(spark):
    rows = [
        record(id="1", importo=Decimal(8_000_000), score_commerciale=80, priorita_commerciale="P1",
               scadenza=utc(2026, 5, 2)),
        record(id="2", tipo_novita=R.KNOWN_UPDATE, stato_procedurale=R.AMENDED, score_commerciale=10),
        record(id="3", tipo_novita=R.PRE_TENDER_SIGNAL, stato_procedurale=R.PRE_TENDER),
        record(id="4", tipo_novita=R.KNOWN_UPDATE, stato_procedurale=R.OUTCOME, is_weak_evidence=True,
               master_record_id="1"),
        record(id="5", master_record_id="1", importo=Decimal(1)),
    ]
    runs = [
        {"id": "r1", "source_id": "s1", "status": "failed", "started_at": NOW - timedelta(hours=3)},
        {"id": "r2", "source_id": "s1", "status": "success", "started_at": NOW - timedelta(hours=1),
         "records_found": 3},
        {"id": "r3", "source_id": "s2", "status": "partial", "started_at": NOW - timedelta(hours=2)},
        {"id": "r4", "source_id": "s3", "status": "failed", "started_at": NOW - timedelta(days=2)},
    ]
    alerts = [{"id": "a", "description": "d", "is_open": True}, {"id": "b", "description": "d", "is_open": False}]
    row, doc = report_of(spark, rows, runs, alerts)
    assert doc["kpi"] == {
        "total_new": 1, "total_updates": 1, "total_pregara": 1, "total_weak": 1, "total_p1": 1,
        "valore_totale_eur": 8000000.0, "total_sources_ok": 1, "total_sources_failed": 0,
        "total_anomalie_aperte": 1,
    }
    assert [i["id"] for i in doc["nuove_gare"]] == ["1"] and doc["nuove_gare"][0]["cig"] is None
    assert doc["nuove_gare"][0]["scadenza"] == "2026-05-02T00:00:00+00:00"
    assert "- **[P1]** Comune — Servizio — €8.000.000 — scad 02/05/2026" in row.markdown
    assert "2 fonti · 1 ok · 0 errori · 1 parziali" in row.markdown
    assert "| Nuove gare | 1 |" in row.markdown
    latest = report.latest_run_per_source(
        frame(spark, runs, schemas.JOB_RUN), frame(spark, [{"id": "s1", "name": "P"}], schemas.SOURCE), NOW.date()
    ).collect()
    assert {(r.source_id, r.source_name, r.status) for r in latest} == {
        ("s1", "P", "success"), ("s2", "(unknown)", "partial"),
    }


def test_sections_order_and_cut(spark):
    rows = [record(id=f"{i:03}", score_commerciale=i % 7, ente=f"E{i % 3}") for i in range(60)]
    got = report.section(frame(spark, rows, schemas.RECORD), "nuove_gare", 30).collect()
    wanted = sorted(rows, key=lambda r: (-r["score_commerciale"], r["ente"], r["id"]))[:30]
    assert [r.id for r in sorted(got, key=lambda r: r.position)] == [r["id"] for r in wanted]


def test_report_is_replaced_by_date(spark, tmp_path):
    row, _ = report_of(spark, [record()])
    path = str(tmp_path / "reports")
    for day, n in ((date(2026, 4, 21), 5), (date(2026, 4, 22), 6), (date(2026, 4, 22), 7)):
        one = frame(spark, [{"report_date": day, "total_new": n, "report_json": "{}"}], schemas.DAILY_REPORT)
        report.write_report(one, path)
    stored = spark.read.schema(schemas.DAILY_REPORT).parquet(path)
    assert [(r.report_date.day, r.total_new) for r in report.report_history(stored).collect()] == [(22, 7), (21, 5)]
    assert report.latest_report(stored).first().total_new == 7
    assert report.report_by_date(stored, date(2026, 4, 21)).first().total_new == 5
    assert report.upsert_report(stored, stored.filter("total_new = 7")).count() == 2


def test_dashboard(spark):
    rows = [
        record(id="1", importo=Decimal("10.5"), priorita_commerciale="P1", scadenza=NOW + timedelta(days=7), regione="L"),
        record(id="2", scadenza=NOW - timedelta(hours=1), regione="L", is_weak_evidence=True),
        record(id="3", stato_procedurale=R.PRE_TENDER, regione="", master_record_id="1"),
    ]
    records = frame(spark, rows, schemas.RECORD)
    reports = frame(spark, [{"report_date": date(2026, 4, 21), "report_json": '{"kpi":{"a":1}}'}], schemas.DAILY_REPORT)
    (k,) = kpi.dashboard_kpi(records, frame(spark, [], schemas.ALERT), reports, NOW).collect()
    assert (k.total_records, k.total_masters, k.gare_pubblicate, k.pre_gara, k.weak_evidence) == (3, 2, 2, 0, 1)
    assert (k.priority_p1, k.valore_totale_eur, k.scadenze_imminenti, k.alerts_open) == (1, 10.5, 1, 0)
    assert (k.latest_report_date, k.latest_report_kpi) == ("2026-04-21", '{"a":1}')
    assert [(r.regione, r.n) for r in kpi.count_by(records, "regione", 10).collect()] == [("L", 2)]


# ---- search, export, runs ---------------------------------------------------------------------------


def test_search_wildcards_and_bounds(spark):
    rows = [
        record(id="1", ente="Comune di Roma", importo=Decimal("100"), data_pubblicazione=utc(2026, 1, 1)),
        record(id="2", ente="ACEA", descrizione="lavori ROMA nord", importo=Decimal("200")),
        record(id="3", ente="Altro", cig="ROMA000001", importo=Decimal("300"), data_pubblicazione=utc(2026, 2, 1)),
    ]
    records = frame(spark, rows, schemas.RECORD)

    def ids(limit=100, offset=0, **f):
        return [r.id for r in search.search_records(records, search.RecordFilters(**f), limit, offset).collect()]

    assert ids(q="roma") == ["3", "1", "2"]
    assert ids(q="r_ma n%d") == ["2"]
    assert ids(ente="roma") == ["1"]
    assert ids(min_importo=200, max_importo=Decimal("300")) == ["3", "2"]
    assert ids(limit=1, offset=1) == ["1"]
    assert ids(regione="") == ["3", "1", "2"]
    with pytest.raises(ValueError):
        ids(limit=1001)


def test_postings_find_what_the_scan_finds(spark, tmp_path):
    texts = ["Comune di Roma", "ACEA", None, "", "ro", "ROMA", "omaR roma", "È città di ROMÀ", "50% sconto_x", "a\\b roma", "İstanbul"]
    rows = [record(id=f"{i}{k}", **{field: t}) for k, field in enumerate(("ente", "descrizione", "cig")) for i, t in enumerate(texts)]
    records = frame(spark, rows, schemas.RECORD)
    path = str(tmp_path / "postings")
    listing_index.write_postings(records, path, 4)
    postings = listing_index.read_postings(spark, path)
    terms = ["roma", "r_ma", "ro", "ma r%m", "comune%roma", "%", "città", "ROMÀ", "conto_x", "50%", "nowhere", "a\\\\b", "i̇st", "İSTAN"]
    for filters in [search.RecordFilters(q=t) for t in terms] + [search.RecordFilters(ente=t) for t in terms] + [
            search.RecordFilters(ente="comune", q="roma"), search.RecordFilters()]:
        wanted = [r.id for r in search.search_records(records, filters).collect()]
        assert [r.id for r in listing_index.indexed_search(records, postings, filters).collect()] == wanted, filters
    left = listing_index.candidates(records, postings, search.RecordFilters(ente="comune di"))
    assert [r.id for r in left.collect()] == ["00"]
    listing_index.write_postings(records.limit(0), path, 4)
    assert listing_index.candidates(records, postings.sparkSession.read.parquet(path), search.RecordFilters(q="roma")).isEmpty()


def test_postings_of_odd_texts_lie_in_even_files(spark, tmp_path):
    texts = ["a\U0001F600bc\nd", "\U0001F600\U0001F601", "aaaa", "ab", "", None, "è di\r\nÙ"] + [f"ente {i}" for i in range(200)]
    records = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], "id INT, ente STRING, descrizione STRING, cig STRING")
    path = str(tmp_path / "postings")
    listing_index.write_postings(records.coalesce(1), path, 2)
    stored = listing_index.read_postings(spark, path, "INT").collect()
    wanted = {("ente", t.lower()[k:k + 3], i) for i, t in enumerate(texts) if t for k in range(len(t.lower()) - 2)}
    assert {tuple(r) for r in stored} == wanted and len(stored) == len(wanted)
    # As many files as the session's shuffles have partitions, not the two asked for.
    assert len(list((tmp_path / "postings").glob("part-*.parquet"))) == 4


def test_stored_listing_pages(spark, tmp_path):
    days = [utc(2026, 1, 1 + i % 5) if i % 4 else None for i in range(60)]
    records = frame(spark, [record(id=f"{i:02}", data_pubblicazione=d) for i, d in enumerate(days)], schemas.RECORD)
    rows, path = records.select("id", "data_pubblicazione", "first_seen_at"), str(tmp_path / "listing")
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    listing_index.write_listing(rows, path, 7)
    whole = [r.id for r in search.search_records(records, search.RecordFilters()).collect()]
    assert len(list((tmp_path / "listing" / "rows").glob("range=*"))) > 3
    for size, start in [(7, 0), (7, 53), (1, 30), (25, 10), (100, 0), (5, 58), (5, 60), (5, 1000)]:
        page = listing_index.listing_page(spark, path, schema, size, start)
        assert [r.id for r in page.collect()] == whole[start:start + size]
    plan = listing_index.listing_page(spark, path, schema, 2, 58)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*range#\d+ = \d", plan)  # one folder read
    listing_index.write_listing(rows.limit(0), path, 7)
    assert listing_index.listing_page(spark, path, schema, 5).collect() == []


def test_pages_go_on_after_a_row(spark):
    rows = [
        record(id=str(i), first_seen_at=utc(2026, 4, 1 + i % 2), data_pubblicazione=utc(2026, 1, 1 + i % 3) if i % 4 else None)
        for i in range(12)
    ]
    records = frame(spark, rows, schemas.RECORD)
    whole = [r.id for r in search.search_records(records, search.RecordFilters()).collect()]
    seen, last = [], None
    while page := search.search_after(records, search.RecordFilters(), last, 5).collect():
        seen += [r.id for r in page]
        last = page[-1]
    assert seen == whole and len(seen) == 12


def test_sections_and_listings_are_whole_without_a_limit(spark):
    rows = [record(id=f"{i:03}", is_weak_evidence=True) for i in range(60)]
    records = frame(spark, rows, schemas.RECORD)
    assert report.section(records, "evidenze_deboli").count() == 60
    assert report.section(records, "evidenze_deboli", 0).count() == 0
    assert report.section(records, "evidenze_deboli", 5).agg({"position": "max"}).first()[0] == 5
    assert search.weak_evidence(records).count() == 60 and search.weak_evidence(records, 7).count() == 7


def test_search_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "records")
    frame(spark, [record()], schemas.RECORD).write.parquet(path)
    wanted = search.RecordFilters(regione="Lazio", min_importo=Decimal(5), only_masters=True)
    page = search.search_records(spark.read.schema(schemas.RECORD).parquet(path), wanted).select("id")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(regione,Lazio)" in plan and "GreaterThanOrEqual(importo,5" in plan
    assert "IsNull(master_record_id)" in plan and "TakeOrderedAndProject" in plan
    assert "tag_tecnico" not in plan.split("ReadSchema")[1]


def test_csv_and_json_exports(spark, tmp_path):
    rows = [
        record(id="1", ente='Ente "A", B', importo=Decimal("1500000.00"), descrizione=" due\nrighe "),
        record(id="2", importo=Decimal("25000000.25"), is_weak_evidence=True),
        record(id="3", master_record_id="1"),
    ]
    records = export.export_rows(frame(spark, rows, schemas.RECORD))
    export.export_csv(records.coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_text(encoding="utf-8")
    header, first, second = csv.reader(io.StringIO(text))
    assert header == [h for h, _ in export.COLUMNS] and len(header) == 31
    assert first[:3] == ['Ente "A", B', " due\nrighe ", "1500000.0"] and second[2] == "25000000.25"
    assert first[24] == "False" and second[24] == "True" and "None" not in text and "null" not in text
    export.export_json(records, str(tmp_path / "json"), NOW)
    (envelope,) = spark.read.json(str(tmp_path / "json" / "envelope")).collect()
    assert (envelope.schema_version, envelope.record_count) == ("4.0", 2)
    lines = [json.loads(x) for f in (tmp_path / "json" / "records").glob("part-*") for x in f.read_text().splitlines()]
    one = next(x for x in lines if x["record_id"] == "1")
    assert one["importo"] == 1500000.0 and one["cig"] is None and len(one) == 31
    assert one["first_seen_at"] == "2026-04-22T00:00:00+00:00"


def test_runs(spark):
    drafts = frame(
        spark,
        [{"source_id": "s", "raw_title": t, "raw_url": u, "pos": i}
         for i, (t, u) in enumerate([("relamping", "a"), ("relamping", "a"), ("pulizia", "b")])]
        + [{"source_id": "t", "raw_title": "pulizia", "raw_url": "c", "pos": 9}],
        schemas.DRAFT,
    )
    runs = export.job_run(landing.collect_metrics(drafts), "collect", NOW, NOW)
    got = {r.source_id: (r.records_found, r.records_valid, r.duplicates_removed, r.status) for r in runs.collect()}
    assert got == {"s": (3, 1, 1, "success"), "t": (1, 0, 0, "partial")}
    (total,) = export.run_metrics(runs.filter("source_id = 's'")).collect()
    assert (total.job_name, total.runs, total.records_valid) == ("collect", 1, 1)
