"""Streams against their batch forms over several batches, and the daily run on stored tables."""

from __future__ import annotations

import hashlib
import json
from datetime import timedelta

import pytest
from conftest import utc
from pyspark.sql import functions as F

from tenderglow import rules as R
from tenderglow import schemas
from tenderglow.operators import normalise
from tenderglow.operators.upsert import upsert
from tenderglow.plans import daily, queries_streams
from tenderglow.session import cut_lineage, is_local, shared_dir
from tenderglow.streaming import jobs

NOW = utc(2026, 4, 22, 9, 30)
SCHEMA = f"{schemas.DRAFT}, fetched_at TIMESTAMP"


def frame(spark, rows, schema):
    empty = spark.createDataFrame([], schema)
    return spark.createDataFrame([tuple(r.get(c) for c in empty.columns) for r in rows], schema)


def draft(i, title="relamping", hours=0, **more):
    return {"source_id": "s", "raw_title": title, "raw_url": f"https://x/{i}", "pos": i,
            "fetched_at": NOW + timedelta(hours=hours), **more}


def test_stream_land_over_two_arrivals(spark, tmp_path):
    src, table, log = (str(tmp_path / n) for n in ("in", "raw", "log"))
    first = [draft(i % 5) for i in range(20)] + [draft(99, "mensa")]
    frame(spark, first, SCHEMA).write.parquet(src)
    for _ in range(2):
        stream = jobs.read_table_stream(spark, src, SCHEMA)
        jobs.stream_land(stream, table, log).awaitTermination()
        assert spark.read.parquet(table).count() in (5, 7)
        # A day later: three known notices and two new ones.
        later = [draft(i, hours=24) for i in (0, 1, 2, 5, 6)]
        frame(spark, later, SCHEMA).write.mode("append").parquet(src)
    landed = spark.read.schema(schemas.RAW_RECORD).parquet(table)
    assert landed.count() == 7 and landed.select("checksum").distinct().count() == 7
    assert landed.filter("raw_date IS NULL").count() == 0


def test_stream_land_query_reads_a_table_of_several_files(spark, tmp_path):
    rows = [(i, f"the tender, entry {i % 7}", "s") for i in range(20)] + [(20, "mensa", "s"), (21, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING")
    docs.repartition(3).write.parquet(str(tmp_path / "many/documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "parts"))
    (part,) = (tmp_path / "parts").glob("*.parquet")
    (tmp_path / "one").mkdir()
    (tmp_path / "one/documents.parquet").write_bytes(part.read_bytes())
    many, one = (sorted(queries_streams.stream_land(spark, str(tmp_path / n)).collect()) for n in ("many", "one"))
    assert len(many) == 7 and many == one


def raw(i, link, doc, hours=0):
    return {"id": str(i), "source_id": "s", "raw_title": "relamping", "raw_url": link,
            "extracted_json": json.dumps(doc), "fetched_at": NOW + timedelta(hours=hours)}


BATCHES = [
    [raw(1, "a", {"ente": "A"}), raw(2, "b", {"ente": "B", "cig": "CIG0000001"})],
    [raw(3, "a", {"importo": "10"}), raw(4, "c", {"cig": "CIG0000001", "regione": "Lazio"})],
    [raw(5, "d", {"ente": "D"})],
]


def sources(spark):
    return frame(spark, [{"id": "s", "name": "S", "source_priority_rank": 2}], schemas.SOURCE)


def test_stream_upsert_over_batches_and_replay(spark, tmp_path):
    src, table, log = (str(tmp_path / n) for n in ("in", "records", "log"))
    times = [NOW + timedelta(days=n) for n in range(9)]
    for batch in BATCHES:
        frame(spark, batch, schemas.RAW_RECORD).coalesce(1).write.mode("append").parquet(src)
        stream = jobs.read_table_stream(spark, src, schemas.RAW_RECORD)
        jobs.stream_upsert(stream, table, sources(spark), log, times.__getitem__).awaitTermination()

    current = frame(spark, [], schemas.RECORD)
    # Chained merges would nest their plans, hence the cuts.
    for n, batch in enumerate(BATCHES):
        waiting = normalise.pending(frame(spark, batch, schemas.RAW_RECORD), sources(spark))
        current = upsert(normalise.normalise(waiting), current, times[n], keep=cut_lineage)

    def view(df):
        return sorted(
            (r.link_bando, r.ente, r.cig, r.importo, r.regione, r.tipo_novita, r.last_seen_at) for r in df.collect()
        )

    last = jobs.read_records(spark, table)
    assert view(last) == view(current) and last.count() == 3
    # A replayed batch gives the same rows, also when the first attempt was lost after it had rewritten its buckets.
    again = jobs.upsert_batch(table, sources(spark), times.__getitem__)
    again(frame(spark, BATCHES[2], schemas.RAW_RECORD), 2)
    assert view(jobs.read_records(spark, table)) == view(current)


def test_stream_upsert_touches_only_its_buckets(spark, tmp_path):
    table, buckets = str(tmp_path / "records"), 32
    seed = frame(spark, [{"id": f"r{i}", "link_bando": f"l{i}", "cig": f"CIG{i:07d}", "first_seen_at": NOW} for i in range(200)], schemas.RECORD)
    write = jobs.upsert_batch(table, sources(spark), lambda n: NOW + timedelta(days=n), seed=seed, buckets=buckets)
    batches = [[raw(1, "l7", {"ente": "A", "importo": "10"})], [raw(2, "new", {"cig": "CIG0000009"})], [raw(3, "other", {"ente": "B"}), raw(4, "l7", {"regione": "Lazio"})]]

    def files():
        root = tmp_path / "records" / "records"
        return {p.parent.name: p.name for p in root.glob("bucket=*/*.parquet")}

    write(frame(spark, [], schemas.RAW_RECORD), 0)
    held, current = files(), seed
    for n, batch in enumerate(batches, 1):
        for _ in range(2):  # the second time is a replay
            write(frame(spark, batch, schemas.RAW_RECORD), n)
        now, before = files(), held
        changed = {b for b in now if now[b] != before.get(b)}
        waiting = normalise.pending(frame(spark, batch, schemas.RAW_RECORD), sources(spark))
        current = upsert(normalise.normalise(waiting), current, NOW + timedelta(days=n))
        hit = {r.id for r in current.filter(F.col("last_seen_at") == F.lit(NOW + timedelta(days=n))).collect()}
        asked = hit | {hashlib.sha256(f"record|{r['raw_url']}".encode()).hexdigest() for r in batch}
        ids = spark.createDataFrame([(i,) for i in asked], "id STRING").select(jobs.bucket_of(F.col("id"), buckets).alias("b"))
        assert changed and changed <= {f"bucket={r.b}" for r in ids.collect()}
        held = now
    columns = ["id", "link_bando", "cig", "ente", "importo", "regione", "tipo_novita", "last_seen_at"]
    got, want = (sorted(map(repr, df.select(columns).collect())) for df in (jobs.read_records(spark, table), current))
    assert got == want and len(got) == 201


def test_repeated_windows_stream_equals_batch(spark, tmp_path):
    src, table, log = (str(tmp_path / n) for n in ("in", "windows", "log"))
    rows = [
        {"id": str(i), "procurement_record_id": str(i % 3), "event_type": kind,
         "event_date": utc(2026, 1, 1) + timedelta(days=i * (1 + i % 3))}
        for i, kind in enumerate(["proroga", "Proroga", "nota"] * 8)
    ]
    # The watermark passes every window once an event of much later arrives.
    closing = {"id": "z", "procurement_record_id": "z", "event_type": "proroga", "event_date": utc(2027, 1, 1)}
    events = frame(spark, rows + [closing], schemas.RECORD_EVENT)
    events.coalesce(1).write.parquet(src)
    jobs.stream_repeated_events(
        jobs.read_table_stream(spark, src, schemas.RECORD_EVENT), table, log
    ).awaitTermination()
    columns = ["procurement_record_id", "window_start", "window_end", "n_events"]
    got = sorted(map(tuple, spark.read.parquet(table).select(columns).collect()))
    wanted = sorted(map(tuple, jobs.repeated_event_windows(events).select(columns).collect()))
    assert got == wanted and got


def test_late_rows_of_a_later_batch_are_kept(spark, tmp_path):
    drafts, raw_table, events, table, log, log2 = (str(tmp_path / n) for n in ("in", "raw", "ev", "windows", "log", "log2"))
    given = []
    for batch in ([draft(1), draft(2, hours=240)], [draft(3, hours=480)], [draft(4, hours=-48), draft(1, hours=24)]):
        frame(spark, batch, SCHEMA).coalesce(1).write.mode("append").parquet(drafts)
        jobs.stream_land(jobs.read_table_stream(spark, drafts, SCHEMA), raw_table, log).awaitTermination()
    assert sorted(r.raw_url[-1] for r in spark.read.parquet(raw_table).collect()) == ["1", "2", "3", "4"]

    def event(i, day):
        return {"id": str(i), "procurement_record_id": "r", "event_type": "proroga", "event_date": utc(2026, 1, 1) + timedelta(days=day)}

    for batch in ([event(1, 0), event(2, 5), event(3, 200)], [event(4, 400)], [event(5, 6), event(6, 40)], [event(7, 600)]):
        given += batch
        frame(spark, batch, schemas.RECORD_EVENT).coalesce(1).write.mode("append").parquet(events)
        jobs.stream_repeated_events(jobs.read_table_stream(spark, events, schemas.RECORD_EVENT), table, log2).awaitTermination()
    columns = ["procurement_record_id", "window_start", "window_end", "n_events"]
    got = sorted(map(tuple, spark.read.parquet(table).select(columns).collect()))
    wanted = jobs.repeated_event_windows(frame(spark, given, schemas.RECORD_EVENT)).select(columns).collect()
    assert got == sorted(map(tuple, wanted)) and max(g[3] for g in got) == 3


def test_daily_runs_on_stored_tables(spark, tmp_path):
    first, second, third, fourth, facts = (str(tmp_path / n) for n in ("d0", "d1", "d2", "d3", "facts"))
    sources(spark).write.parquet(f"{first}/sources")
    spark.createDataFrame([("e1",)], "id STRING").write.parquet(f"{first}/entities")

    doc = json.dumps({"ente": "Comune di A", "importo": "6.000.000", "scadenza": "30/04/2026"})
    drafts = [
        draft(1, "Gara ponte relamping", extracted_json=doc),
        draft(1, "Gara ponte relamping", extracted_json=doc),
        draft(2, "Gara ponte relamping", extracted_json=doc),
        draft(3, "mensa"),
    ]
    given = frame(spark, drafts, schemas.DRAFT)
    for _ in range(2):
        # Started twice: the second start overwrites the first one's output with the same.
        daily.run_daily(spark, first, second, facts, given, NOW)
    records = daily.table(spark, second, "procurement_records", schemas.RECORD)
    got = {r.link_bando: r for r in records.collect()}
    assert set(got) == {"https://x/1", "https://x/2"}
    assert {r.tipo_novita for r in got.values()} == {R.NEW_TODAY}
    assert sum(r.master_record_id is None for r in got.values()) == 1
    assert {r.priorita_commerciale for r in got.values()} == {"P1"}
    (report,) = spark.read.parquet(f"{facts}/daily_reports").collect()
    # Alerts open after the report, so it lists none yet.
    assert (report.total_new, json.loads(report.report_json)["kpi"]["total_anomalie_aperte"]) == (1, 0)
    assert daily.table(spark, second, "alerts", schemas.ALERT).count() == 2
    runs = {r.job_name: r for r in daily.table(spark, facts, "job_runs", schemas.JOB_RUN).collect()}
    assert set(runs) == set(daily.STAGES) and {r.status for r in runs.values()} == {"success"}
    run = runs["collect"]
    assert (run.records_found, run.records_valid, run.duplicates_removed) == (4, 2, 1)
    assert (runs["normalise"].records_found, runs["normalise"].records_valid) == (2, 2)
    assert daily.raw_history(spark, facts).filter("normalized_at IS NULL").count() == 0

    daily.run_daily(spark, second, third, facts, given, NOW + timedelta(days=1))
    later = daily.table(spark, third, "procurement_records", schemas.RECORD)
    assert {r.tipo_novita for r in later.collect()} == {R.KNOWN_UPDATE}
    assert daily.table(spark, third, "alerts", schemas.ALERT).count() == 2
    reports = {r.report_date.day: json.loads(r.report_json) for r in spark.read.parquet(f"{facts}/daily_reports").collect()}
    assert [reports[d]["kpi"]["total_anomalie_aperte"] for d in (22, 23)] == [0, 2]
    assert spark.read.parquet(f"{facts}/report_alerts").count() == 2
    assert daily.table(spark, third, "sources", schemas.SOURCE).filter(F.col("last_checked_at").isNull()).count() == 0

    # A day whose run fails after landing is taken up by the next run.
    new = frame(spark, [draft(7, "Gara ponte relamping", extracted_json=doc)], schemas.DRAFT)
    broken = daily.merge_notices

    def fails(*_):
        raise RuntimeError("lost")

    daily.merge_notices = fails
    try:
        with pytest.raises(RuntimeError):
            daily.run_daily(spark, third, str(tmp_path / "lost"), facts, new, NOW + timedelta(days=2))
    finally:
        daily.merge_notices = broken
    lost = daily.table(spark, facts, "job_runs", f"{schemas.JOB_RUN}, day DATE").filter("status = 'failed'").collect()
    assert [(r.job_name, r.error_message) for r in lost] == [("score", "lost")]
    daily.run_daily(spark, third, fourth, facts, frame(spark, [], schemas.DRAFT), NOW + timedelta(days=3))
    links = {r.link_bando for r in daily.table(spark, fourth, "procurement_records", schemas.RECORD).collect()}
    assert "https://x/7" in links
    assert spark.read.parquet(f"{facts}/daily_reports").count() == 3
    assert spark.read.parquet(f"{fourth}/entities").count() == 1


def test_a_cluster_without_a_shared_folder_is_an_error():
    assert is_local("local[4]") and is_local("local") and not is_local("local-cluster[3,2,1024]") and not is_local("yarn")

    class Context:
        master = "spark://m:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session())


def test_stream_upsert_stores_no_second_copy_of_the_records(spark, tmp_path, monkeypatch):
    table, kept = str(tmp_path / "records"), []
    monkeypatch.setattr(jobs, "cut_lineage", lambda df: kept.append(cut_lineage(df)) or kept[-1])
    seed = frame(spark, [{"id": f"r{i}", "link_bando": f"l{i}", "cig": "" if i == 7 else None, "first_seen_at": NOW} for i in range(50)], schemas.RECORD)
    write = jobs.upsert_batch(table, sources(spark), lambda n: NOW + timedelta(days=n), seed=seed, buckets=1)
    write(frame(spark, [raw(1, "l7", {"cig": "CIG0000007"}), raw(2, "new", {"cig": "CIG0000002"}), raw(3, "l8", {"ente": "A"})], schemas.RAW_RECORD), 0)
    assert kept and max(df.count() for df in kept) < 50 and jobs.read_records(spark, table).count() == 51
    new = hashlib.sha256(b"record|new").hexdigest()
    keys = spark.read.parquet(f"{table}/keys").filter("batch = 0").select("kind", "key", "id").collect()
    assert sorted(map(tuple, keys)) == [("cig", "CIG0000002", new), ("cig", "CIG0000007", "r7"), ("link_bando", "new", new)]
