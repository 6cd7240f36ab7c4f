"""The daily chain: land, normalise, merge, deduplicate, score, report, anomalies."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tenderglow import rules as R
from tenderglow import schemas
from tenderglow.functions import values as V
from tenderglow.operators import anomalies, dedupe, export, landing, normalise, report, scoring
from tenderglow.operators.upsert import Keep, upsert
from tenderglow.session import cut_lineage


@dataclass(frozen=True)
class Rules:
    normalise: R.NormaliseRules = R.NormaliseRules()
    score: R.ScoreRules = R.ScoreRules()
    anomaly: R.AnomalyRules = R.AnomalyRules()


def refresh_records(
    raw: DataFrame, sources: DataFrame, current: DataFrame, now: datetime, rules: Rules = Rules(),
    store: bool = False,
) -> DataFrame:
    """Pending raw records merged into the record table, deduplicated and scored.

    With ``store`` intermediates that are read twice are stored as tables.
    """
    notices = normalise.normalise(normalise.pending(raw, sources), rules.normalise)
    return merge_notices(notices, current, now, rules, cut_lineage if store else lambda df: df)


def merge_notices(notices: DataFrame, current: DataFrame, now: datetime, rules: Rules, keep: Keep) -> DataFrame:
    """The record table with the notices merged in, deduplicated and scored."""
    merged = upsert(notices, current, now, tag_rules=rules.normalise.tags, keep=keep)
    elected = dedupe.elect_master(dedupe.with_dedup_key(merged), keep=keep)
    return scoring.score(elected, now, rules.score)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, on whatever file system its path names."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A stored table under its declared schema; a table not stored yet is empty."""
    path = f"{root}/{name}"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def append_day(rows: DataFrame, facts: str, name: str, day: date) -> None:
    """Writes one day of an append-only table; the same day again replaces itself, other days stay untouched."""
    (
        rows.withColumn("day", F.lit(day))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(f"{facts}/{name}")
    )


_BOOKMARK = "fetch_day DATE, normalized_at TIMESTAMP, day DATE"


def open_days(spark: SparkSession, facts: str, day: date) -> DataFrame:
    """Raw records of the days that no earlier run has normalised: today's, and those of runs that failed.

    A day is bookmarked as a whole, so the filter prunes folders.
    """
    raw = table(spark, facts, "raw_records", f"{schemas.RAW_RECORD}, day DATE")
    done = table(spark, facts, "normalised_days", _BOOKMARK).filter(F.col("day") < F.lit(day))
    return raw.join(F.broadcast(done.select(F.col("fetch_day").alias("day")).distinct()), "day", "left_anti")


def raw_history(spark: SparkSession, facts: str) -> DataFrame:
    """All raw records with ``normalized_at`` as the bookmarks have it."""
    raw = table(spark, facts, "raw_records", f"{schemas.RAW_RECORD}, day DATE").drop("normalized_at")
    marks = table(spark, facts, "normalised_days", _BOOKMARK).groupBy(F.col("fetch_day").alias("day")).agg(
        F.min("normalized_at").alias("normalized_at")
    )
    return raw.join(F.broadcast(marks), "day", "left").select(*S.StructType.fromDDL(schemas.RAW_RECORD).names)


STATE = ("sources", "procurement_records", "alerts")
CARRIED = ("entities", "watchlist_items", "documents")
STAGES = ("collect", "normalise", "score", "report", "anomalies")


def run_daily(
    spark: SparkSession,
    previous: str,
    target: str,
    facts: str,
    drafts: DataFrame,
    now: datetime,
    *,
    scoped: bool = True,
    rules: Rules = Rules(),
) -> None:
    """One run over stored tables: reads the folder ``previous``, writes the folder ``target``.

    ``target`` is the state after the run and the ``previous`` of the next one: the tables of ``STATE``, and copies of
    those of ``CARRIED``. Tables that only grow (raw records, run rows, reports with their sources and open alerts) are
    kept under ``facts`` by day and are never rewritten; record events are read there. Nothing under ``previous``
    changes, so a failed run is simply started again; its run row tells which stage failed. The report comes before
    anomaly detection, so it lists the alerts opened by earlier runs.
    """
    day, stage = now.date(), STAGES[0]
    rows: list[DataFrame] = []
    try:
        sources = table(spark, previous, "sources", schemas.SOURCE)
        alerts = table(spark, previous, "alerts", schemas.ALERT)
        events = table(spark, facts, "record_events", f"{schemas.RECORD_EVENT}, day DATE").drop("day")

        append_day(landing.land(drafts, now, scoped=scoped, scope=rules.normalise.scope), facts, "raw_records", day)
        collected = cut_lineage(landing.collect_metrics(drafts, scoped=scoped, scope=rules.normalise.scope))
        rows.append(export.job_run(collected, stage, now, now))
        landing.touch_sources(sources, collected, now).write.mode("overwrite").parquet(f"{target}/sources")
        for name in CARRIED:
            if exists(spark, f"{previous}/{name}"):
                spark.read.parquet(f"{previous}/{name}").write.mode("overwrite").parquet(f"{target}/{name}")

        stage = STAGES[1]
        waiting = open_days(spark, facts, day)
        notices = cut_lineage(normalise.normalise(normalise.pending(waiting.drop("day"), sources), rules.normalise))
        rows.append(export.job_run(cut_lineage(normalise.normalise_metrics(waiting, notices)), stage, now, now))

        stage = STAGES[2]
        current = table(spark, previous, "procurement_records", schemas.RECORD)
        merge_notices(notices, current, now, rules, cut_lineage).write.mode("overwrite").parquet(
            f"{target}/procurement_records"
        )
        records = table(spark, target, "procurement_records", schemas.RECORD)
        rows.append(export.job_run(records.agg(F.count("*").alias("records_found")), stage, now, now))
        done = waiting.select(F.col("day").alias("fetch_day")).distinct().withColumn("normalized_at", V.at(now))
        append_day(cut_lineage(done), facts, "normalised_days", day)

        stage = STAGES[3]
        append_day(_together(rows), facts, "job_runs", day)
        runs = table(spark, facts, "job_runs", f"{schemas.JOB_RUN}, day DATE").drop("day")
        row = cut_lineage(report.report_row(records, runs, sources, alerts, day, now))
        report.write_report(row, f"{facts}/daily_reports")
        append_day(report.latest_run_per_source(runs, sources, day), facts, "report_sources", day)
        append_day(report.open_alert_items(alerts), facts, "report_alerts", day)
        rows.append(export.job_run(row.select(F.lit(1).alias("records_found")), stage, now, now))

        stage = STAGES[4]
        opened = cut_lineage(anomalies.detect(records, events, alerts, now, rules.anomaly))
        alerts.unionByName(opened).write.mode("overwrite").parquet(f"{target}/alerts")
        rows.append(export.job_run(opened.agg(F.count("*").alias("records_found")), stage, now, now))
    except Exception as error:
        text = str(error).splitlines()[0][:500] if str(error) else type(error).__name__
        failed = spark.createDataFrame([(text,)], "error_message STRING")
        rows.append(export.job_run(failed, stage, now, now, status="failed"))
        append_day(_together(rows), facts, "job_runs", day)
        raise
    append_day(_together(rows), facts, "job_runs", day)


def _together(rows: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), rows)
