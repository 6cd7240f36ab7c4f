"""Queries that run a streaming job over the given tables and return the table it wrote.

Each drains what is there (``availableNow``); the SQL is that of the batch form, which the stream
must reach. Sinks and checkpoints are fresh folders under the cluster's shared one.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderglow import rules as R
from tenderglow import schemas
from tenderglow.plans import adapters as A
from tenderglow.plans import oracle_tables as O
from tenderglow.plans.queries_sources import PAGE_SCOPE
from tenderglow.plans.registry import query
from tenderglow.session import ensure_utc, scratch_path
from tenderglow.streaming import jobs


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, one file or a folder of them, as a file stream under its stored schema."""
    path = f"{sf_dir}/{name}.parquet"
    files = spark.readStream.schema(ensure_utc(spark).read.parquet(path).schema)
    if jobs.is_folder(spark, path):
        return files.parquet(path)
    # Spark takes no single file as a stream's path, so its folder is listed for it.
    return files.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


_LANDED = f"""
drafts AS (
  SELECT source AS source_id, sha256('https://d.example.com/' || md5(text) || '||') AS checksum
  FROM documents WHERE {O.points('text', PAGE_SCOPE)} >= 1
)"""


@query(f"WITH {_LANDED} SELECT DISTINCT source_id, checksum, '2001-07-15' AS fetched FROM drafts")
def stream_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    drafts = _stream(spark, sf_dir, "documents").select(
        F.col("source").alias("source_id"), none.alias("entity_id"), none.alias("raw_title"),
        F.col("text").alias("raw_body"), none.alias("raw_html"),
        F.concat(F.lit("https://d.example.com/"), F.md5(F.col("text").cast("binary"))).alias("raw_url"),
        F.lit(None).cast("timestamp").alias("raw_date"), none.alias("extracted_json"),
        F.col("doc_id").alias("pos"), F.lit(A.RECORDS_NOW).alias("fetched_at"),
    )
    table = scratch_path(spark, "landed")
    jobs.stream_land(
        drafts, table, scratch_path(spark, "landed-log"), scope=PAGE_SCOPE
    ).awaitTermination()
    landed = spark.read.schema(schemas.RAW_RECORD).parquet(table)
    return landed.select(
        "source_id", "checksum", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched")
    )


def _now_of(batch_id: int) -> datetime:
    return A.RECORDS_NOW + timedelta(days=batch_id)


@query(f"""
WITH {O.PLACED_RAW}
SELECT link_bando, ente, descrizione, cig, CAST(importo AS DOUBLE) AS importo, validation_level,
  flag_om, stato_procedurale, tipo_novita FROM merged
""")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records normalised and merged by a stream that starts without a record table."""
    raw = A.raw_records_of(_stream(spark, sf_dir, "orders"))
    table = scratch_path(spark, "records")
    jobs.stream_upsert(
        raw, table, A.sources(spark, sf_dir), scratch_path(spark, "records-log"), _now_of
    ).awaitTermination()
    records = jobs.read_records(spark, table)
    return records.select(
        "link_bando", "ente", "descrizione", "cig", F.col("importo").cast("double").alias("importo"),
        "validation_level", "flag_om", "stato_procedurale", "tipo_novita",
    )


# Without CIGs the link alone tells the record, whatever the cut into batches.
_BY_LINK = O.PLACED_RAW.replace("ordered AS (\n  SELECT *,", "ordered AS (\n  SELECT * REPLACE (CAST(NULL AS VARCHAR) AS cig),")


@query(f"""
WITH {_BY_LINK}
SELECT link_bando, ente, descrizione, CAST(importo AS DOUBLE) AS importo, flag_om FROM merged
""")
def stream_upsert_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by link when they arrive in four batches, oldest first, each merged into the buckets that it touches."""
    cig = '(?<=\\{)"cig":"[^"]*",?|,"cig":"[^"]*"'
    raw = A.raw_records(spark, sf_dir).withColumn("extracted_json", F.regexp_replace("extracted_json", cig, ""))
    first, last = raw.select(F.min("fetched_at"), F.max("fetched_at")).first()
    source, table, log = (scratch_path(spark, f"arrivals-{n}") for n in ("raw", "records", "log"))
    for i in range(4):
        begin, end = first + (last - first) * i / 4, first + (last - first) * (i + 1) / 4
        arrived = raw.filter((F.col("fetched_at") >= begin) & ((F.col("fetched_at") < end) | F.lit(i == 3)))
        arrived.write.mode("append").parquet(source)
        stream = spark.readStream.schema(raw.schema).parquet(source)
        jobs.stream_upsert(stream, table, A.sources(spark, sf_dir), log, _now_of, buckets=16).awaitTermination()
    return jobs.read_records(spark, table).select(
        "link_bando", "ente", "descrizione", F.col("importo").cast("double").alias("importo"), "flag_om"
    )


@query("""
WITH days AS (
  SELECT user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'purchase'),
starts AS (SELECT user_id, d - CAST(i AS INT) AS s FROM days, range(30) t(i)),
windows AS (SELECT user_id, s, count(*) AS n FROM starts GROUP BY user_id, s HAVING count(*) >= 2)
SELECT user_id AS procurement_record_id, strftime(s, '%Y-%m-%d') AS window_start, n AS n_events FROM windows
""")
def repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window form of the repeated-event rule as a batch."""
    found = jobs.repeated_event_windows(A.record_events(spark, sf_dir))
    return _windows(found)


def _windows(found: DataFrame) -> DataFrame:
    day: Column = F.date_format("window_start", "yyyy-MM-dd")
    return found.select("procurement_record_id", day.alias("window_start"), "n_events")


@query("""
WITH days AS (
  SELECT user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'purchase'),
starts AS (SELECT user_id, d - CAST(i AS INT) AS s FROM days, range(30) t(i)),
windows AS (SELECT user_id, s, count(*) AS n FROM starts GROUP BY user_id, s HAVING count(*) >= 2)
SELECT user_id AS procurement_record_id, strftime(s, '%Y-%m-%d') AS window_start, n AS n_events
FROM windows
WHERE s + 30 <= (SELECT max(ts) FROM events WHERE event_type = 'purchase') - INTERVAL 2 DAY
""")
def stream_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream: only windows the watermark has closed are written."""
    kind = F.when(F.col("event_type") == "purchase", "Proroga").otherwise("altro")
    events = _stream(spark, sf_dir, "events").select(
        F.col("user_id").alias("procurement_record_id"), kind.alias("event_type"),
        F.col("ts").cast("timestamp").alias("event_date"),
    )
    table = scratch_path(spark, "windows")
    jobs.stream_repeated_events(
        events, table, scratch_path(spark, "windows-log"), rules=R.AnomalyRules()
    ).awaitTermination()
    return _windows(spark.read.parquet(table))
