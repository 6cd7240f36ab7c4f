"""Queries over records: normalise, merge, deduplicate, score, anomalies, report, search, export."""

from __future__ import annotations

from datetime import date, datetime, timezone
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenderglow import rules as R
from tenderglow import schemas
from tenderglow.functions import text as T
from tenderglow.functions import values as V
from tenderglow.operators import (
    anomalies, dedupe, export, kpi, listing_index, normalise, report, scoring, search, upsert,
)
from tenderglow.plans import adapters as A
from tenderglow.plans import daily
from tenderglow.plans import oracle_tables as O
from tenderglow.plans.registry import ORACLES, query
from tenderglow.session import cut_lineage, scratch_path

NOW, EVENTS_NOW = A.RECORDS_NOW, A.EVENTS_NOW
REPORT_DAY = date(2024, 1, 15)


def _day(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    elected = dedupe.elect_master(dedupe.with_dedup_key(A.records(spark, sf_dir)), keep=cut_lineage)
    return scoring.score(elected, NOW)


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stored table, which is what reports read: they go over it several times."""
    return cut_lineage(_scored(spark, sf_dir))


# ---- normalise ----------------------------------------------------------------------------------


@query(f"""
WITH {O.RAW}, {O.SOURCES}
SELECT raw.id, coalesce(sources.source_priority_rank, 999) AS source_priority_rank
FROM raw LEFT JOIN sources ON raw.source_id = sources.id WHERE raw.id % 6 <> 0
""")
def pending_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.when(F.col("id") % 6 == 0, V.at(NOW))
    raw = A.raw_records(spark, sf_dir).withColumn("normalized_at", done)
    return normalise.pending(raw, A.sources(spark, sf_dir)).select("id", "source_priority_rank")


_NOTICE_FIELDS = (
    "raw_id, link_bando, descrizione, cig, CAST(importo AS DOUBLE) AS importo, "
    "strftime(data_pubblicazione, '%Y-%m-%d') AS data_pubblicazione, "
    "strftime(scadenza, '%Y-%m-%d') AS scadenza, procedura AS tipologia_gara_procedura, "
    "strumento AS tipo_strumento, regione, ente, tags, "
    f"{', '.join(R.FLAGS)}, stato_procedurale, reliability_index, validation_level, is_weak_evidence"
)


@query(f"WITH {O.NOTICES} SELECT {_NOTICE_FIELDS} FROM typed")
def normalise_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = normalise.pending(A.raw_records(spark, sf_dir), A.sources(spark, sf_dir))
    return normalise.normalise(waiting).select(
        "raw_id", "link_bando", "descrizione", "cig", F.col("importo").cast("double").alias("importo"),
        _day("data_pubblicazione").alias("data_pubblicazione"), _day("scadenza").alias("scadenza"),
        "tipologia_gara_procedura", "tipo_strumento", "regione", "ente",
        F.array_join("tag_tecnico", ",").alias("tags"), *R.FLAGS, "stato_procedurale",
        "reliability_index", "validation_level", "is_weak_evidence",
    )


@query(f"""
WITH {O.NOTICES}
SELECT validation_level, is_weak_evidence, stato_procedurale, count(*) AS n FROM typed GROUP BY ALL
""")
def evidence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = normalise.pending(A.raw_records(spark, sf_dir), A.sources(spark, sf_dir))
    return (
        normalise.normalise(waiting)
        .groupBy("validation_level", "is_weak_evidence", "stato_procedurale")
        .agg(F.count("*").alias("n"))
    )


@query(f"""
WITH {O.NOTICES}
SELECT (SELECT count(*) FROM raw) AS records_found,
  count(*) FILTER (NOT is_weak_evidence) AS records_valid,
  count(*) FILTER (is_weak_evidence) AS records_weak FROM typed
""")
def normalise_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = normalise.pending(A.raw_records(spark, sf_dir), A.sources(spark, sf_dir))
    return normalise.normalise_metrics(waiting, normalise.normalise(waiting))


# ---- merge ----------------------------------------------------------------------------------------


@query(f"""
WITH {O.BATCH}
SELECT b.link_bando, b.cig, count(*) AS n, CAST(max(l.id) AS VARCHAR) AS id_by_link,
  CAST(max(c.id) AS VARCHAR) AS id_by_cig
FROM batch b LEFT JOIN current l ON b.link_bando = l.link_bando
  LEFT JOIN cig_current c ON b.cig = c.cig
GROUP BY b.link_bando, b.cig
""")
def match_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = upsert.match_existing(A.notice_batch(spark, sf_dir), A.current_records(spark, sf_dir))
    return found.select("link_bando", "cig", "n", "id_by_link", "id_by_cig")


@query(f"WITH {O.BATCH} SELECT raw_id, target_id, length(target_id) = 64 AS opened FROM placed")
def upsert_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = upsert.assign_targets(A.notice_batch(spark, sf_dir), A.current_records(spark, sf_dir))
    return placed.select("raw_id", "target_id", "opened")


_TWO_CIGS = """
WITH notices AS (
  SELECT l_suppkey AS g, concat_ws('-', l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT), CAST(l_tax > 0 AS INT)) AS raw_id, l_shipdate AS t,
    l_suppkey || '/' || (l_partkey % 13) AS link,
    CASE WHEN l_tax > 0 THEN l_suppkey || ':' || (CAST(l_quantity AS BIGINT) % 29) END AS cig FROM lineitem),
folds AS (
  SELECT list_reduce(list({'raw_id': raw_id, 'link': link, 'cig': cig} ORDER BY t, raw_id), lambda acc, x: {
    'opened': CASE WHEN list_contains(acc.opened, x.link) OR list_contains(acc.cigs, x.cig) THEN acc.opened ELSE list_append(acc.opened, x.link) END,
    'holding': CASE WHEN x.cig IS NULL OR list_contains(acc.holding, x.link) OR (NOT list_contains(acc.opened, x.link) AND list_contains(acc.cigs, x.cig))
      THEN acc.holding ELSE list_append(acc.holding, x.link) END,
    'holders': CASE WHEN x.cig IS NULL OR list_contains(acc.cigs, x.cig) OR list_contains(acc.holding, x.link) THEN acc.holders ELSE list_append(acc.holders, x.link) END,
    'cigs': CASE WHEN x.cig IS NULL OR list_contains(acc.cigs, x.cig) OR list_contains(acc.holding, x.link) THEN acc.cigs ELSE list_append(acc.cigs, x.cig) END,
    'went': list_append(acc.went, {'raw_id': x.raw_id, 'target': CASE WHEN list_contains(acc.opened, x.link) THEN x.link
      ELSE coalesce(acc.holders[list_position(acc.cigs, x.cig)], x.link) END})
  }, {'opened': CAST([] AS VARCHAR[]), 'holding': CAST([] AS VARCHAR[]), 'holders': CAST([] AS VARCHAR[]), 'cigs': CAST([] AS VARCHAR[]),
    'went': CAST([] AS STRUCT(raw_id VARCHAR, target VARCHAR)[])}) AS f
  FROM notices GROUP BY g),
went AS (SELECT unnest(f.went, max_depth := 2) FROM folds)
SELECT raw_id, sha256('record|' || target) AS target_id FROM went
"""


@query(_TWO_CIGS)
def upsert_two_cigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where notices go when links bring several CIGs and CIGs several links; nothing is stored yet."""
    of = F.col("l_suppkey").cast("string")
    notices = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long"), (F.col("l_tax") > 0).cast("int")).alias("raw_id"),
        F.col("l_shipdate").alias("fetched_at"),
        F.concat(of, F.lit("/"), (F.col("l_partkey") % 13).cast("string")).alias("link_bando"),
        F.when(F.col("l_tax") > 0, F.concat(of, F.lit(":"), (F.col("l_quantity").cast("long") % 29).cast("string"))).alias("cig"))
    # A few columns of a stored table: reading them again costs less than a copy.
    placed = upsert.assign_targets(notices, spark.createDataFrame([], schemas.RECORD))
    return placed.select("raw_id", "target_id")


@query(f"""
WITH {O.BATCH}
SELECT 'cig' AS key_kind, cig AS key_value, count(*) AS candidates FROM current
WHERE cig IS NOT NULL GROUP BY cig HAVING count(*) > 1
""")
def upsert_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = upsert.key_collisions(A.current_records(spark, sf_dir))
    return found.select("key_kind", "key_value", "candidates")


def _record_view(records: DataFrame) -> DataFrame:
    return records.select(
        "id", "descrizione", "cig", F.col("importo").cast("double").alias("importo"),
        _day("data_pubblicazione").alias("published"), _day("scadenza").alias("scadenza"),
        "tipologia_gara_procedura", "tipo_strumento", "comune", "ente", "link_bando",
        "source_priority_rank", "is_weak_evidence", *R.FLAGS, "stato_procedurale", "tipo_novita",
        "tag_tecnico", "validation_level", "reliability_index", _day("first_seen_at").alias("first_seen"),
        _day("last_seen_at").alias("last_seen"),
    )


_MERGED_TAGS = """array_to_string(list_sort(list_distinct(list_concat(
      coalesce(string_split(c.tag_tecnico, ','), []),
      list_filter([CASE WHEN ppp THEN 'PPP' END, CASE WHEN led THEN 'LED' END,
        CASE WHEN pnrr THEN 'PNRR' END], lambda t: t IS NOT NULL)))), ',')"""


@query(f"""
WITH {O.BATCH}
SELECT CAST(c.id AS VARCHAR) AS id, coalesce(c.descrizione, f.descrizione) AS descrizione,
  coalesce(c.cig, f.cig) AS cig, CAST(coalesce(c.importo, f.importo) AS DOUBLE) AS importo,
  strftime(coalesce(c.data_pubblicazione, f.data_pubblicazione), '%Y-%m-%d') AS published,
  strftime(coalesce(c.scadenza, f.scadenza), '%Y-%m-%d') AS scadenza,
  coalesce(c.tipologia_gara_procedura, f.procedura) AS tipologia_gara_procedura,
  f.strumento AS tipo_strumento, f.comune AS comune, c.ente, c.link_bando, c.source_priority_rank,
  c.is_weak_evidence, {', '.join(f'greatest(c.{x}, coalesce(f.{x}, c.{x})) AS {x}' for x in R.FLAGS)},
  coalesce(f.stato_procedurale, c.stato_procedurale) AS stato_procedurale,
  CASE WHEN f.target_id IS NULL THEN c.tipo_novita WHEN f.stato_procedurale = 'PRE-GARA'
    THEN 'Segnale pre-gara' ELSE 'Aggiornamento gara nota' END AS tipo_novita,
  CASE WHEN f.n_tagged > 0 THEN {_MERGED_TAGS} ELSE c.tag_tecnico END AS tag_tecnico,
  greatest('L2', coalesce(f.validation_level, 'L2')) AS validation_level,
  coalesce(f.reliability_index, 'Alta') AS reliability_index,
  strftime(c.first_seen_at, '%Y-%m-%d') AS first_seen,
  CASE WHEN f.target_id IS NULL THEN strftime(c.last_seen_at, '%Y-%m-%d') ELSE '2001-07-15' END
    AS last_seen
FROM current c LEFT JOIN folded f ON CAST(c.id AS VARCHAR) = f.target_id
""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = A.current_records(spark, sf_dir)
    merged = upsert.upsert(A.notice_batch(spark, sf_dir), current, NOW, keep=cut_lineage)
    return _record_view(merged.filter(F.length("id") < 64))


@query(f"""
WITH {O.BATCH}
SELECT target_id AS id, descrizione, cig, CAST(coalesce(first_importo, importo) AS DOUBLE) AS importo,
  strftime(data_pubblicazione, '%Y-%m-%d') AS published, strftime(scadenza, '%Y-%m-%d') AS scadenza,
  procedura AS tipologia_gara_procedura, strumento AS tipo_strumento, comune, ente,
  link AS link_bando, rank AS source_priority_rank, weak AS is_weak_evidence, {', '.join(R.FLAGS)},
  stato_procedurale,
  CASE WHEN stato_procedurale = 'PRE-GARA' THEN 'Segnale pre-gara'
    WHEN n > 1 THEN 'Aggiornamento gara nota'
    WHEN first_published < DATE '2001-07-15' THEN 'Nuovo emerso oggi ma pubblicato prima'
    ELSE 'Nuovo oggi' END AS tipo_novita,
  nullif(CASE WHEN n_tagged - CASE WHEN first_tags <> '' THEN 1 ELSE 0 END > 0
    THEN concat_ws(',', CASE WHEN led THEN 'LED' END, CASE WHEN pnrr THEN 'PNRR' END,
      CASE WHEN ppp THEN 'PPP' END) ELSE first_tags END, '') AS tag_tecnico,
  validation_level, reliability_index, '2001-07-15' AS first_seen, '2001-07-15' AS last_seen
FROM folded WHERE length(target_id) = 64
""")
def upsert_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = A.current_records(spark, sf_dir)
    merged = upsert.upsert(A.notice_batch(spark, sf_dir), current, NOW, keep=cut_lineage)
    return _record_view(merged.filter(F.length("id") == 64))


_KEYED_RAW = O.PLACED_RAW + """,
keyed AS (
  SELECT *, sha256('record|' || link_bando) AS id, CASE WHEN cig IS NOT NULL THEN 'cig:' || cig
    ELSE 'eo:' || substr(lower(ente), 1, 28) || '|' || substr(lower(coalesce(descrizione, '')), 1, 38)
      || '|' || coalesce(CAST(CAST(round_even(CAST(importo AS DOUBLE) / 50000, 0) * 50000 AS BIGINT)
        AS VARCHAR), 'x') END AS dedup_key
  FROM merged),
best AS (SELECT dedup_key, arg_min(id, lpad(CAST(rank AS VARCHAR), 4, '0') || id) AS best
  FROM keyed GROUP BY dedup_key)"""


@query(f"""
WITH {_KEYED_RAW}
SELECT id, link_bando, ente, cig, stato_procedurale, tipo_novita, k.dedup_key,
  CASE WHEN id <> best THEN best END AS master_record_id
FROM keyed k JOIN best b ON k.dedup_key = b.dedup_key
""")
def daily_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records through normalise, merge, deduplicate and score; no stored records yet."""
    empty = spark.createDataFrame([], schemas.RECORD)
    out = daily.refresh_records(
        A.raw_records(spark, sf_dir), A.sources(spark, sf_dir), empty, NOW, store=True
    )
    return out.select(
        "id", "link_bando", "ente", "cig", "stato_procedurale", "tipo_novita", "dedup_key",
        "master_record_id",
    )


# ---- deduplicate and score ------------------------------------------------------------------------


@query(f"WITH {O.KEYED} SELECT id, dedup_key FROM keyed")
def dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.with_dedup_key(A.records(spark, sf_dir)).select("id", "dedup_key")


@query(f"WITH {O.ELECTED} SELECT id, dedup_key, master_record_id FROM elected")
def elect_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    elected = dedupe.elect_master(dedupe.with_dedup_key(A.records(spark, sf_dir)))
    return elected.select("id", "dedup_key", "master_record_id")


@query(f"WITH {O.ELECTED} SELECT id, dedup_key, master_record_id FROM elected")
def elect_master_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same result when nearly every group counts as hot."""
    keyed = dedupe.with_dedup_key(A.records(spark, sf_dir))
    return dedupe.elect_master(keyed, hot_rows=1).select("id", "dedup_key", "master_record_id")


@query(f"""
WITH {O.ELECTED}
SELECT dedup_key, count(*) AS member_count, count(master_record_id) AS duplicates
FROM elected GROUP BY dedup_key
""")
def dup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    elected = dedupe.elect_master(dedupe.with_dedup_key(A.records(spark, sf_dir)))
    return dedupe.duplicate_counts(elected)


@query(f"""
WITH {O.SCORED}
SELECT id, amount_points, state_points, deadline_points, bonus_points FROM scored
""")
def score_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.col("stato_procedurale")
    strength = scoring.pre_tender_strength(state, F.col("descrizione"))
    return A.records(spark, sf_dir).select(
        "id",
        scoring.amount_points(F.col("importo").cast("double")).alias("amount_points"),
        scoring.state_points(state, strength).alias("state_points"),
        scoring.deadline_points(V.days_until(F.col("scadenza"), NOW)).alias("deadline_points"),
        scoring.bonus_points(
            F.col("flag_ppp_doppio_oggetto"), T.tag_list(F.col("tag_tecnico"))
        ).alias("bonus_points"),
    )


@query(f"WITH {O.SCORED} SELECT id, score_commerciale, priorita_commerciale FROM scored")
def score_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.score(A.records(spark, sf_dir), NOW)
    return scored.select("id", "score_commerciale", "priorita_commerciale")


@query(f"""
WITH {O.SCORED}
SELECT priorita_commerciale, count(*) AS n,
  CAST(sum(importo) FILTER (stato_procedurale = 'GARA PUBBLICATA') AS DOUBLE) AS live_value
FROM scored WHERE master_record_id IS NULL GROUP BY priorita_commerciale
""")
def priority_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = F.when(F.col("stato_procedurale") == R.PUBLISHED, F.col("importo"))
    return (
        dedupe.masters(_scored(spark, sf_dir))
        .groupBy("priorita_commerciale")
        .agg(F.count("*").alias("n"), F.sum(live).cast("double").alias("live_value"))
    )


# ---- anomalies --------------------------------------------------------------------------------------


def _rule(spark: SparkSession, sf_dir: str, name: str, hot_rows: int = 1_000_000) -> DataFrame:
    found = anomalies.candidates(
        A.anomaly_records(spark, sf_dir), A.record_events(spark, sf_dir), EVENTS_NOW, only=(name,),
        hot_rows=hot_rows,
    )
    return found.select("alert_key", "severity", "description")


_REPEATED = f"""
  SELECT 'proroga_multipla:' || r.id AS alert_key, 'high' AS severity,
    count(*) || ' proroghe registrate negli ultimi 30 giorni' AS description
  FROM arecords r JOIN rec_events e ON r.id = e.procurement_record_id
  WHERE lower(event_type) = 'proroga' AND event_date >= {O.EVENTS_NOW} - INTERVAL 30 DAY
  GROUP BY r.id HAVING count(*) >= 2"""
_REVOKED = """
  SELECT 'revoca_post_pubblicazione:' || r.id AS alert_key, 'critical' AS severity,
    'Revoca rilevata il ' || strftime(min(event_date), '%Y-%m-%d') || ' dopo pubblicazione del '
      || strftime(max(data_pubblicazione), '%Y-%m-%d') AS description
  FROM arecords r JOIN rec_events e ON r.id = e.procurement_record_id
  WHERE lower(event_type) = 'revoca' AND event_date > data_pubblicazione GROUP BY r.id"""
_APPEAL = """
  SELECT 'ricorso_tar:' || r.id AS alert_key, 'high' AS severity,
    arg_min(description, event_date) AS description
  FROM arecords r JOIN rec_events e ON r.id = e.procurement_record_id
  WHERE event_type LIKE '%ricorso%' OR event_type LIKE '%tar%' GROUP BY r.id"""
_BRIDGE = """
  SELECT 'procedura_ponte:' || id AS alert_key, 'medium' AS severity,
    'Possibile procedura ponte dopo gara deserta/annullata' AS description
  FROM arecords WHERE stato_procedurale = 'GARA PUBBLICATA'
    AND regexp_matches(lower(descrizione), 'ponte|deserta|a seguito di revoca')"""
_STALLED = f"""
  SELECT 'stato_stallo:' || r.id AS alert_key, 'low' AS severity, 'Gara in stato RETTIFICA da '
    || CAST(floor((epoch_us({O.EVENTS_NOW}) - epoch_us(coalesce(first_event, first_seen_at)))
      / 86400000000.0) AS BIGINT) || ' giorni' AS description
  FROM arecords r LEFT JOIN (SELECT procurement_record_id, min(event_date) AS first_event
    FROM rec_events GROUP BY 1) e ON r.id = e.procurement_record_id
  WHERE stato_procedurale = 'RETTIFICA-PROROGA-CHIARIMENTI'
    AND coalesce(first_event, first_seen_at) <= {O.EVENTS_NOW} - INTERVAL 14 DAY"""
_ANOMALY = f"WITH {O.ANOMALY_RECORDS}, {O.EVENTS}"
_ALL_RULES = " UNION ALL ".join((_REPEATED, _REVOKED, _APPEAL, _BRIDGE, _STALLED))


@query(_ANOMALY + _REPEATED)
def repeated_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule(spark, sf_dir, "proroga_multipla")


@query(_ANOMALY + _REVOKED)
def event_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule(spark, sf_dir, "revoca_post_pubblicazione")


@query(_ANOMALY + _REVOKED)
def event_after_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same result when records with many revocations count as hot."""
    return _rule(spark, sf_dir, "revoca_post_pubblicazione", hot_rows=5)


@query(_ANOMALY + _APPEAL)
def event_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule(spark, sf_dir, "ricorso_tar")


@query(_ANOMALY + _BRIDGE)
def keyword_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule(spark, sf_dir, "procedura_ponte")


@query(_ANOMALY + _STALLED)
def stalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule(spark, sf_dir, "stato_stallo")


@query(f"{_ANOMALY} SELECT * FROM ({_ALL_RULES})")
def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = anomalies.candidates(
        A.anomaly_records(spark, sf_dir), A.record_events(spark, sf_dir), EVENTS_NOW
    )
    return found.select("alert_key", "severity", "description")


@query(f"""
{_ANOMALY}, {O.ALERTS}
SELECT '[key:' || alert_key || '] ' || description AS description, severity, true AS is_open,
  '2024-01-31' AS opened
FROM ({_ALL_RULES}) WHERE alert_key NOT IN (SELECT alert_key FROM alert_keys WHERE is_open)
""")
def suppress_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = anomalies.detect(
        A.anomaly_records(spark, sf_dir), A.record_events(spark, sf_dir), A.alerts(spark, sf_dir),
        EVENTS_NOW,
    )
    return opened.select("description", "severity", "is_open", _day("opened_at").alias("opened"))


@query(f"""
WITH {O.ALERTS}
SELECT id, is_open AND id % 2 <> 0 AS is_open,
  CASE WHEN id % 2 = 0 THEN '2024-01-31' END AS closed FROM alerts
""")
def close_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = A.alerts(spark, sf_dir)
    closed = anomalies.close_alerts(alerts, alerts.filter(F.col("id") % 2 == 0), EVENTS_NOW)
    return closed.select("id", "is_open", _day("closed_at").alias("closed"))


@query(f"""
WITH {O.ALERTS}
SELECT id, severity, procurement_record_id FROM alerts WHERE is_open AND severity = 'high'
ORDER BY opened_at DESC, id LIMIT 50
""")
def list_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = anomalies.list_alerts(A.alerts(spark, sf_dir), True, "high", 50)
    return listed.select("id", "severity", "procurement_record_id")


# ---- report and KPI -----------------------------------------------------------------------------------

_SECTIONS = {
    "nuove_gare": "master_record_id IS NULL AND tipo_novita IN ('Nuovo oggi', "
                  "'Nuovo emerso oggi ma pubblicato prima') AND NOT is_weak_evidence",
    "aggiornamenti": "master_record_id IS NULL AND tipo_novita = 'Aggiornamento gara nota'",
    "pre_gara": "master_record_id IS NULL AND stato_procedurale = 'PRE-GARA'",
    "evidenze_deboli": "is_weak_evidence",
}


def _section_query(name: str, section: str, order: str) -> None:
    limit = report.SECTION_ROWS[section]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = report.section(_scored(spark, sf_dir), section, report.SECTION_ROWS[section])
        return rows.select("position", "id", "ente", "score", "priorita", "importo")

    run.__doc__ = f"Top rows of the report section {section}."
    query(
        f"""WITH {O.SCORED}
        SELECT row_number() OVER (ORDER BY {order}) AS position, id, ente, score_commerciale AS score,
          priorita_commerciale AS priorita, CAST(importo AS DOUBLE) AS importo
        FROM scored WHERE {_SECTIONS[section]} ORDER BY {order} LIMIT {limit}""",
        name,
    )(run)


_BEST = "score_commerciale DESC, ente, id"
_section_query("section_new", "nuove_gare", _BEST)
_section_query("section_updates", "aggiornamenti", _BEST)
_section_query("section_pretender", "pre_gara", _BEST)
_section_query("section_weak", "evidenze_deboli", "first_seen_at, id")

_LATEST = """
latest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id) AS rn
    FROM runs WHERE CAST(started_at AS DATE) = DATE '2024-01-15' AND source_id IS NOT NULL)
  WHERE rn = 1
)"""


@query(f"""
WITH {O.RUNS}, {O.SOURCES}, {_LATEST}
SELECT source_id, coalesce(name, '(unknown)') AS source_name, status, records_found, records_valid,
  records_weak, error_message
FROM latest LEFT JOIN sources ON source_id = sources.id
""")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.latest_run_per_source(
        A.runs(spark, sf_dir), A.sources(spark, sf_dir), REPORT_DAY
    )


_KPI = f"""
  (SELECT count(*) FROM scored WHERE {_SECTIONS['nuove_gare']}) AS total_new,
  (SELECT count(*) FROM scored WHERE {_SECTIONS['aggiornamenti']}) AS total_updates,
  (SELECT count(*) FROM scored WHERE {_SECTIONS['pre_gara']}) AS total_pregara,
  (SELECT count(*) FROM scored WHERE is_weak_evidence) AS total_weak,
  (SELECT count(*) FROM scored WHERE master_record_id IS NULL AND priorita_commerciale = 'P1')
    AS total_p1,
  (SELECT CAST(coalesce(sum(importo), 0) AS DOUBLE) FROM scored WHERE master_record_id IS NULL
    AND stato_procedurale = 'GARA PUBBLICATA') AS valore_totale_eur,
  (SELECT count(*) FROM latest WHERE status = 'success') AS total_sources_ok,
  (SELECT count(*) FROM latest WHERE status = 'failed') AS total_sources_failed,
  (SELECT count(*) FROM alerts WHERE is_open) AS total_anomalie_aperte"""
_KPI_TABLES = f"{O.SCORED}, {O.RUNS}, {O.ALERTS}, {_LATEST}"


@query(f"WITH {_KPI_TABLES} SELECT {_KPI}")
def report_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs_today = report.latest_run_per_source(
        A.runs(spark, sf_dir), A.sources(spark, sf_dir), REPORT_DAY
    )
    return report.report_kpi(_scored(spark, sf_dir), runs_today, A.alerts(spark, sf_dir))


@query(f"WITH {O.ALERTS} SELECT id, alert_type, severity, strftime(opened_at, '%Y-%m-%dT%H:%M:%S.%f') "
       "|| '+00:00' AS opened_at FROM alerts WHERE is_open")
def open_alert_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = report.open_alert_items(A.alerts(spark, sf_dir))
    return items.select("id", "alert_type", "severity", "opened_at")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_row(
        _stored(spark, sf_dir), A.runs(spark, sf_dir), A.sources(spark, sf_dir),
        A.alerts(spark, sf_dir), REPORT_DAY, EVENTS_NOW,
    )


def _markdown_lines(section: str, line: str, empty: str) -> str:
    return f"""coalesce((SELECT string_agg({line}, chr(10) ORDER BY {_BEST}) FROM (
      SELECT * FROM scored WHERE {_SECTIONS[section]} ORDER BY {_BEST} LIMIT 10)), '{empty}')"""


def _sql_eur(value: str) -> str:
    return (f"'€' || replace(format('{{:,}}', CAST(round_even({value}, 0) AS BIGINT)), ',', '.')")


_SHORT = "substr(descrizione, 1, 80)"
_NEW_LINE = (
    f"'- **[' || priorita_commerciale || ']** ' || ente || ' — ' || {_SHORT} || ' — ' || "
    f"coalesce({_sql_eur('importo')}, 'n.d.') || ' — scad ' || strftime(scadenza, '%d/%m/%Y')"
)


@query(f"""
WITH {_KPI_TABLES}, kpi AS (SELECT {_KPI})
SELECT total_new, total_updates, total_pregara, total_sources_ok AS total_new_sources,
  concat_ws(chr(10), '# Report · Illuminazione pubblica · 15 January 2024', '', '## A. Nuove gare',
  {_markdown_lines('nuove_gare', _NEW_LINE, 'Nessuna gara pubblicata oggi.')}, '', '## B. Aggiornamenti',
  {_markdown_lines('aggiornamenti', f"'- ' || ente || ' — ' || {_SHORT} || ' — ' || stato_procedurale",
                   'Nessun aggiornamento su gare note.')}, '', '## C. Segnali pre-gara',
  {_markdown_lines('pre_gara', f"'- ' || ente || ' — ' || {_SHORT}", 'Nessun segnale pre-gara nuovo.')},
  '', '## D. Fonti interrogate',
  (SELECT count(*) || ' fonti · ' || count(*) FILTER (status = 'success') || ' ok · '
    || count(*) FILTER (status = 'failed') || ' errori · '
    || count(*) FILTER (status = 'partial') || ' parziali' FROM latest),
  '', '## Cruscotto', '| KPI | Valore |', '|---|---|', '| Nuove gare | ' || total_new || ' |',
  '| Aggiornamenti | ' || total_updates || ' |', '| Pre-gara | ' || total_pregara || ' |',
  '| Evidenze deboli | ' || total_weak || ' |', '| Priorità P1 | ' || total_p1 || ' |',
  '| Valore gare attive | ' || {_sql_eur('valore_totale_eur')} || ' |',
  '| Anomalie aperte | ' || total_anomalie_aperte || ' |') || chr(10) AS markdown
FROM kpi
""")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).select(
        "total_new", "total_updates", "total_pregara", "total_new_sources", "markdown"
    )


@query(f"""
WITH {_KPI_TABLES}, kpi AS (SELECT {_KPI})
SELECT '2024-01-15' AS report_date, '2024-01-31T00:00:00+00:00' AS generated_at, total_new AS n_new,
  valore_totale_eur AS total_value, least(30, total_new) AS shown_new,
  least(30, total_updates) AS shown_updates, least(20, total_pregara) AS shown_signals,
  least(30, total_weak) AS shown_weak,
  (SELECT id FROM scored WHERE {_SECTIONS['nuove_gare']} ORDER BY {_BEST} LIMIT 1) AS best_new
FROM kpi
""")
def report_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.parse_json("report_json")

    def value(path: str, kind: str) -> Column:
        return F.variant_get("doc", path, kind)

    return _report(spark, sf_dir).select(doc.alias("doc")).select(
        value("$.report_date", "string").alias("report_date"),
        value("$.generated_at", "string").alias("generated_at"),
        value("$.kpi.total_new", "bigint").alias("n_new"),
        value("$.kpi.valore_totale_eur", "double").alias("total_value"),
        *[
            F.size(value(f"$.{s}", "array<variant>")).alias(n)
            for s, n in (("nuove_gare", "shown_new"), ("aggiornamenti", "shown_updates"),
                         ("pre_gara", "shown_signals"), ("evidenze_deboli", "shown_weak"))
        ],
        value("$.nuove_gare[0].id", "bigint").alias("best_new"),
    )


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily totals of the events as stored reports."""
    return (
        A.load(spark, sf_dir, "events")
        .groupBy(F.to_date("ts").alias("report_date"))
        .agg(
            F.count_if(F.col("event_type") == "view").cast("int").alias("total_new"),
            F.count_if(F.col("event_type") == "click").cast("int").alias("total_updates"),
            F.count("*").cast("int").alias("n"),
        )
        .select(
            "report_date", "total_new", "total_updates", F.lit(0).alias("total_pregara"),
            F.lit(0).alias("total_new_sources"),
            F.concat(F.lit('{"kpi":{"n":'), F.col("n").cast("string"), F.lit("}}")).alias("report_json"),
            F.col("report_date").cast("timestamp").alias("generated_at"),
        )
    )


_REPORTS = """
reports AS (
  SELECT CAST(ts AS DATE) AS report_date, count(*) FILTER (event_type = 'view') AS total_new,
    count(*) FILTER (event_type = 'click') AS total_updates, count(*) AS n
  FROM events GROUP BY 1
)"""


@query(f"""
WITH {_KPI_TABLES}, {_REPORTS}, kpi AS (SELECT {_KPI})
SELECT strftime(report_date, '%Y-%m-%d') AS day, total_new, total_updates FROM reports
WHERE report_date <> DATE '2024-01-15'
UNION ALL SELECT '2024-01-15', total_new, total_updates FROM kpi
""")
def report_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = report.upsert_report(_reports(spark, sf_dir), _report(spark, sf_dir))
    return stored.select(_day("report_date").alias("day"), "total_new", "total_updates")


@query(f"""
WITH {_REPORTS}
SELECT strftime(report_date, '%Y-%m-%d') AS day, total_new FROM reports
ORDER BY report_date DESC LIMIT 7
""")
def report_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = report.report_history(_reports(spark, sf_dir), 7)
    return history.select(_day("report_date").alias("day"), "total_new")


@query(f"""
WITH {_REPORTS}
SELECT strftime(report_date, '%Y-%m-%d') AS day, total_new FROM reports
WHERE report_date = DATE '2024-01-10'
""")
def report_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = report.report_by_date(_reports(spark, sf_dir), date(2024, 1, 10))
    return one.select(_day("report_date").alias("day"), "total_new")


@query(f"""
WITH {O.SCORED}, {O.ALERTS}, {_REPORTS}, m AS (SELECT * FROM scored WHERE master_record_id IS NULL)
SELECT (SELECT count(*) FROM scored) AS total_records, count(*) AS total_masters,
  count(*) FILTER (stato_procedurale = 'GARA PUBBLICATA') AS gare_pubblicate,
  count(*) FILTER (stato_procedurale = 'PRE-GARA') AS pre_gara,
  count(*) FILTER (stato_procedurale LIKE 'ESITO%') AS esito,
  count(*) FILTER (stato_procedurale LIKE 'RETTIFICA%') AS rettifica,
  (SELECT count(*) FROM scored WHERE is_weak_evidence) AS weak_evidence,
  count(*) FILTER (priorita_commerciale = 'P1') AS priority_p1,
  count(*) FILTER (priorita_commerciale = 'P2') AS priority_p2,
  count(*) FILTER (priorita_commerciale = 'P3') AS priority_p3,
  count(*) FILTER (priorita_commerciale = 'P4') AS priority_p4,
  (SELECT count(*) FROM alerts WHERE is_open) AS alerts_open,
  CAST(coalesce(sum(importo) FILTER (stato_procedurale = 'GARA PUBBLICATA'), 0) AS DOUBLE)
    AS valore_totale_eur,
  count(*) FILTER (stato_procedurale = 'GARA PUBBLICATA' AND scadenza >= {O.NOW}
    AND scadenza <= {O.NOW} + INTERVAL 7 DAY) AS scadenze_imminenti,
  (SELECT strftime(max(report_date), '%Y-%m-%d') FROM reports) AS latest_report_date,
  (SELECT '{{"n":' || arg_max(n, report_date) || '}}' FROM reports) AS latest_report_kpi
FROM m
""")
def dashboard_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.dashboard_kpi(
        _scored(spark, sf_dir), A.alerts(spark, sf_dir), _reports(spark, sf_dir), NOW
    )


@query(f"""
WITH {O.ELECTED}
SELECT provincia, count(*) AS n FROM elected WHERE master_record_id IS NULL
GROUP BY provincia ORDER BY n DESC, provincia LIMIT 10
""")
def by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    elected = dedupe.elect_master(dedupe.with_dedup_key(A.records(spark, sf_dir)))
    return kpi.count_by(elected, "provincia", kpi.TOP_REGIONS)


@query(f"""
WITH {O.ELECTED}
SELECT stato_procedurale, count(*) AS n FROM elected WHERE master_record_id IS NULL GROUP BY 1
""")
def by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    elected = dedupe.elect_master(dedupe.with_dedup_key(A.records(spark, sf_dir)))
    return kpi.count_by(elected, "stato_procedurale")


# ---- search -------------------------------------------------------------------------------------------

_LISTING = "ORDER BY data_pubblicazione DESC NULLS LAST, first_seen_at DESC, id"


@query(f"""
WITH {O.RECORDS}
SELECT id, ente, cig FROM records
WHERE ente ILIKE '%mer#0000%' AND (ente ILIKE '%c0000_1%' OR descrizione ILIKE '%c0000_1%'
  OR cig ILIKE '%c0000_1%') {_LISTING} LIMIT 100
""")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = search.RecordFilters(ente="MER#0000", q="c0000_1")
    return search.search_records(A.records(spark, sf_dir), wanted).select("id", "ente", "cig")


@query(f"""
WITH {O.RECORDS}
SELECT id, regione, CAST(importo AS DOUBLE) AS importo FROM records
WHERE regione = 'ASIA' AND stato_procedurale = 'GARA PUBBLICATA' AND flag_om = 'No'
  AND importo >= 1000000 AND importo <= 9000000.5
  AND data_pubblicazione >= TIMESTAMP '1997-01-01' AND data_pubblicazione <= TIMESTAMP '2000-06-30'
{_LISTING} LIMIT 1000
""")
def search_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = search.RecordFilters(
        regione="ASIA", stato_procedurale=R.PUBLISHED, flag_om="No",
        min_importo=Decimal(1_000_000), max_importo=Decimal("9000000.5"),
        date_from=datetime(1997, 1, 1, tzinfo=timezone.utc),
        date_to=datetime(2000, 6, 30, tzinfo=timezone.utc),
    )
    page = search.search_records(A.records(spark, sf_dir), wanted, 1000)
    return page.select("id", "regione", F.col("importo").cast("double").alias("importo"))


@query(f"""
WITH {O.RECORDS}
SELECT id, tipo_novita FROM records
WHERE tipo_novita = 'Nuovo oggi' AND flag_ppp_doppio_oggetto = 'Yes' {_LISTING} LIMIT 50 OFFSET 25
""")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = search.RecordFilters(tipo_novita=R.NEW_TODAY, flag_ppp_doppio_oggetto="Yes")
    page = search.search_records(A.records(spark, sf_dir), wanted, 50, 25)
    return page.select("id", "tipo_novita")


@query(ORACLES["search_text"], name="search_postings")
def search_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, path = A.records(spark, sf_dir), scratch_path(spark, "postings")
    listing_index.write_postings(records, path, 16)
    wanted = search.RecordFilters(ente="MER#0000", q="c0000_1")
    postings = listing_index.read_postings(spark, path, dict(records.dtypes)["id"])
    found = listing_index.indexed_search(records, postings, wanted)
    return found.select("id", "ente", "cig")


@query(f"""
WITH {O.RECORDS}
SELECT id, regione, row_number() OVER ({_LISTING}) AS place FROM records {_LISTING} LIMIT 200 OFFSET 1000
""")
def search_late_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.records(spark, sf_dir).select("id", "regione", "data_pubblicazione", "first_seen_at")
    path = scratch_path(spark, "listing")
    listing_index.write_listing(rows, path, 16)
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    page = listing_index.listing_page(spark, path, schema, 200, 1000)
    # Places within a page of 200 rows.
    place = F.row_number().over(Window.orderBy(*search.listing_order())).cast("long") + 1000
    return page.select("id", "regione", place.alias("place"))


@query(f"""
WITH {O.RECORDS}
SELECT id, tipo_novita FROM records WHERE tipo_novita = 'Nuovo oggi' {_LISTING} LIMIT 50 OFFSET 50
""")
def search_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, wanted = A.records(spark, sf_dir), search.RecordFilters(tipo_novita=R.NEW_TODAY)
    first = search.search_records(records, wanted, 50).collect()
    return search.search_after(records, wanted, first[-1], 50).select("id", "tipo_novita")


@query(f"WITH {O.RECORDS} SELECT id, ente, regione, provincia FROM records WHERE id = 42")
def get_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.get_record(A.records(spark, sf_dir), 42)
    return found.select("id", "ente", "regione", "provincia")


@query(f"WITH {O.RECORDS} SELECT id, ente FROM records WHERE is_weak_evidence {_LISTING}")
def weak_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.weak_evidence(A.records(spark, sf_dir)).select("id", "ente")


@query(f"""
WITH {O.SCORED}
SELECT id, score_commerciale FROM scored
WHERE priorita_commerciale = 'P1' AND master_record_id IS NULL {_LISTING} LIMIT 10
""")
def top_p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_p1(_scored(spark, sf_dir)).select("id", "score_commerciale")


@query(f"""
WITH {O.SOURCES}
SELECT id, name, source_priority_rank FROM sources WHERE active AND source_type = 'official'
""")
def active_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.active_sources(A.sources(spark, sf_dir), "official")
    return found.select("id", "name", "source_priority_rank")


# ---- export -------------------------------------------------------------------------------------------

_EXPORTED = f"""
  ente, descrizione, CAST(importo AS DOUBLE) AS importo, cig, stato_procedurale, tipo_novita,
  strftime(data_pubblicazione, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS data_pubblicazione,
  strftime(scadenza, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS scadenza, tipologia_gara_procedura,
  CAST(NULL AS VARCHAR) AS criterio, regione, provincia, CAST(NULL AS VARCHAR) AS comune,
  'Illuminazione pubblica' AS macrosettore, {', '.join(R.FLAGS)}, tag_tecnico,
  'L2' AS validation_level, 'Alta' AS reliability_index, score_commerciale, priorita_commerciale,
  is_weak_evidence, master_record_id, link_bando, source_priority_rank,
  strftime(first_seen_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS first_seen_at,
  strftime(last_seen_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS last_seen_at, id AS record_id"""


@query(f"WITH {O.SCORED} SELECT {_EXPORTED} FROM scored WHERE master_record_id IS NULL")
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.export_columns(export.export_rows(_scored(spark, sf_dir)))


@query(f"""
WITH {O.SCORED}
SELECT CAST(id AS VARCHAR) AS record_id, ente, regexp_replace(CAST(importo AS VARCHAR), '(\\.\\d)0$',
  '\\1') AS importo, CASE WHEN is_weak_evidence THEN 'True' ELSE 'False' END AS weak
FROM scored
""")
def export_csv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export.csv_rows(_scored(spark, sf_dir))
    return rows.select(
        F.col("`Record id`").alias("record_id"), F.col("Ente").alias("ente"),
        F.col("`Importo (IVA escl.)`").alias("importo"), F.col("`Weak evidence`").alias("weak"),
    )


@query(f"""
WITH {O.ELECTED}
SELECT '4.0' AS schema_version, '2001-07-15T12:00:00+00:00' AS generated_at, count(*) AS record_count
FROM elected WHERE master_record_id IS NULL
""")
def export_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    elected = dedupe.elect_master(dedupe.with_dedup_key(A.records(spark, sf_dir)))
    return export.export_envelope(export.export_rows(elected), NOW)


@query(f"""
WITH {O.RUNS}
SELECT job_name, status, count(*) AS runs, CAST(sum(records_found) AS BIGINT) AS records_found,
  CAST(sum(records_valid) AS BIGINT) AS records_valid,
  CAST(sum(records_weak) AS BIGINT) AS records_weak,
  CAST(sum(duplicates_removed) AS BIGINT) AS duplicates_removed
FROM runs GROUP BY job_name, status
""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.run_metrics(A.runs(spark, sf_dir))
