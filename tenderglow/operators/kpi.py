"""Dashboard numbers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderglow import rules as R
from tenderglow.functions import values as V
from tenderglow.operators.anomalies import open_alerts
from tenderglow.operators.report import latest_report, one_row

IMMINENT_DAYS = 7
TOP_REGIONS = 10


def dashboard_kpi(
    records: DataFrame, alerts: DataFrame, reports: DataFrame, now: datetime
) -> DataFrame:
    """All single numbers of the dashboard in one row; records are aggregated once.

    The two breakdowns are :func:`count_by` tables.
    """
    master = F.col("master_record_id").isNull()
    state, level = F.col("stato_procedurale"), F.col("priorita_commerciale")
    published = master & (state == R.PUBLISHED)
    soon = F.col("scadenza").between(V.at(now), V.at(now) + F.expr(f"INTERVAL {IMMINENT_DAYS} DAYS"))
    numbers = records.agg(
        F.count("*").alias("total_records"),
        F.count_if(master).alias("total_masters"),
        F.count_if(published).alias("gare_pubblicate"),
        F.count_if(master & (state == R.PRE_TENDER)).alias("pre_gara"),
        F.count_if(master & (state == R.OUTCOME)).alias("esito"),
        F.count_if(master & (state == R.AMENDED)).alias("rettifica"),
        F.count_if("is_weak_evidence").alias("weak_evidence"),
        *[F.count_if(master & (level == p)).alias(f"priority_{p.lower()}")
          for p in ("P1", "P2", "P3", "P4")],
        F.coalesce(
            F.round(F.sum(F.when(published, F.col("importo"))).cast("double"), 2), F.lit(0.0)
        ).alias("valore_totale_eur"),
        F.count_if(published & soon).alias("scadenze_imminenti"),
    )
    alert_count = open_alerts(alerts).agg(F.count("*").alias("alerts_open"))
    newest = latest_report(reports).agg(
        F.date_format(F.max("report_date"), "yyyy-MM-dd").alias("latest_report_date"),
        F.max(F.get_json_object("report_json", "$.kpi")).alias("latest_report_kpi"),
    )
    return one_row([numbers, alert_count, newest])


def count_by(records: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Masters per value of a column, most frequent first; null and empty values left out."""
    value = F.col(column)
    counts = (
        records.filter(
            F.col("master_record_id").isNull() & value.isNotNull() & (value != F.lit(""))
        )
        .groupBy(column)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), column)
    )
    return counts.limit(top) if top else counts
