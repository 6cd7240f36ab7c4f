"""Streaming landing, upsert and repeated-event detection.

All three start from files arriving in a folder and can run continuously or, with
``available_now``, drain what is there and stop (the daily schedule).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tenderglow import rules as R
from tenderglow import schemas
from tenderglow.functions import values as V
from tenderglow.operators import landing, upsert
from tenderglow.operators.normalise import normalise
from tenderglow.session import cut_lineage


def read_table_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).load(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isDirectory()


def unique_drafts(
    drafts: DataFrame,
    landed: DataFrame | None = None,
    keep_for: str = "7 days",
    *,
    scoped: bool = True,
    scope: R.ScopeRules = R.ScopeRules(),
) -> DataFrame:
    """In-scope drafts of one batch, the first of each source's checksum.

    Those already ``landed`` within ``keep_for`` are left out, whichever came first; none is left out for being late.
    """
    rows = landing.with_checksum(landing.gate(drafts, scope) if scoped else drafts)
    if landed is not None:
        keep = F.expr(f"INTERVAL {keep_for}")
        near = F.col("_at").between(F.col("fetched_at") - keep, F.col("fetched_at") + keep)
        old = landed.select(F.col("source_id").alias("_source"), F.col("checksum").alias("_sum"), F.col("fetched_at").alias("_at"))
        same = F.col("source_id").eqNullSafe(F.col("_source")) & F.col("checksum").eqNullSafe(F.col("_sum"))
        rows = rows.join(old, same & F.coalesce(near, F.lit(True)), "left_anti")
    order = [c for c in ("fetched_at", "pos") if c in rows.columns]
    return landing.first_per_key(rows, ["source_id", "checksum"], order).drop("copies")


def _start(stream, checkpoint: str, available_now: bool) -> StreamingQuery:
    stream = stream.option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()


def stream_land(
    drafts: DataFrame,
    table: str,
    checkpoint: str,
    *,
    keep_for: str = "7 days",
    scoped: bool = True,
    scope: R.ScopeRules = R.ScopeRules(),
    available_now: bool = True,
) -> StreamingQuery:
    """Append new drafts (a stream with ``fetched_at``) to the raw table, a folder per day, however late they are.

    A replayed batch finds its own rows landed. ``table`` must not be one of a streaming file sink, whose log hides other files.
    """
    writer = drafts.writeStream.foreachBatch(land_batch(table, keep_for, scoped, scope))
    return _start(writer, checkpoint, available_now)


def land_batch(table: str, keep_for: str, scoped: bool, scope: R.ScopeRules) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        landed = None
        if _exists(spark, table):
            # Only the day folders within ``keep_for`` of the batch are listed and read, and of them three narrow columns.
            stored = spark.read.schema(f"{schemas.RAW_RECORD}, fetch_day DATE").parquet(table)
            span = batch.agg(F.min("fetched_at").alias("first"), F.max("fetched_at").alias("last"))
            keep = F.expr(f"INTERVAL {keep_for}")
            days = span.select(F.to_date(F.col("first") - keep).alias("first_day"), F.to_date(F.col("last") + keep).alias("last_day")).first()
            near = F.col("fetch_day").between(F.lit(days.first_day), F.lit(days.last_day)) | F.col("fetch_day").isNull()
            landed = stored.filter(near)
        rows = unique_drafts(batch, landed, keep_for, scoped=scoped, scope=scope)
        _raw(rows).write.mode("append").partitionBy("fetch_day").parquet(table)

    return write


def _raw(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.sha2(
            F.concat_ws("|", F.lit("raw"), "source_id", "checksum", V.iso(F.col("fetched_at"))), 256
        ).alias("id"),
        "source_id", "entity_id", "raw_title", "raw_body", "raw_html", "raw_url",
        F.coalesce("raw_date", "fetched_at").alias("raw_date"),
        "extracted_json", "checksum", "fetched_at",
        F.lit(None).cast("timestamp").alias("normalized_at"),
        F.to_date("fetched_at").alias("fetch_day"),
    )


#: Folders of the record table; a batch rewrites only those that its records fall into. More of them make a rewrite smaller.
BUCKETS = 64
_KEYS = "kind STRING, key STRING, id STRING, batch INT"


def bucket_of(record_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(record_id), F.lit(buckets)).cast("int")


def read_records(spark: SparkSession, table: str) -> DataFrame:
    """The record table of ``stream_upsert``."""
    if not _exists(spark, f"{table}/records"):
        return spark.createDataFrame([], schemas.RECORD)
    return spark.read.schema(f"{schemas.RECORD}, bucket INT").parquet(f"{table}/records").drop("bucket")


def _keys_of(records: DataFrame) -> DataFrame:
    """Links and CIGs of records, ``kind, key, id``. A record's link never changes and its CIG is set once."""
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("key")) for c in ("link_bando", "cig")]))
    return records.select(pair.alias("k"), "id").select("k.kind", "k.key", "id").filter(F.col("key").isNotNull())


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def upsert_batch(
    table: str, sources: DataFrame, now_of: Callable[[int], datetime],
    rules: R.NormaliseRules = R.NormaliseRules(), seed: DataFrame | None = None, buckets: int = BUCKETS,
) -> Callable[[DataFrame, int], None]:
    """Writer for ``foreachBatch``: merges batch n into the record table, whose folders are hash buckets of the record's id.

    A narrow table of keys beside it (link or CIG and the record's id, a folder per batch) tells which buckets a batch can
    touch; only those are read and overwritten. They are copied first, and a batch that is replayed starts from that copy and from
    the keys of earlier batches, so losing an executor or the driver half-way leaves no trace. ``now_of`` must give the
    same moment for the same batch.
    """

    def store(records: DataFrame, fresh: DataFrame, batch_id: int) -> None:
        held = records.withColumn("bucket", bucket_of(F.col("id"), buckets)).repartition("bucket")
        held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{table}/records")
        fresh.write.mode("overwrite").parquet(f"{table}/keys/batch={batch_id}")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if seed is not None and not _exists(spark, f"{table}/keys/batch=-1/_SUCCESS"):
            store(seed, _keys_of(seed), -1)
        ranks = sources.select(F.col("id").alias("source_id"), "source_priority_rank")
        ranked = batch.join(ranks, "source_id", "left").withColumn(
            "source_priority_rank", F.coalesce("source_priority_rank", F.lit(R.UNKNOWN_RANK))
        )
        notices = cut_lineage(normalise(ranked, rules))
        before = f"{table}/before/batch={batch_id}"
        if not _exists(spark, f"{before}/_SUCCESS"):
            own = notices.select(bucket_of(upsert.record_id(F.col("link_bando")), buckets).alias("b"))
            if _exists(spark, f"{table}/keys"):
                asked = _keys_of(notices.select("link_bando", "cig", F.lit("").alias("id"))).select("kind", "key").distinct()
                known = spark.read.schema(_KEYS).parquet(f"{table}/keys").filter(F.col("batch") < batch_id)
                known = known.select("kind", "key", bucket_of(F.col("id"), buckets).alias("b"))
                own = own.unionByName(known.join(asked, ["kind", "key"], "left_semi").select("b"))
            # At most as many numbers as there are buckets; Spark reads only their folders.
            touched = [r.b for r in own.distinct().collect()]
            held = spark.createDataFrame([], schemas.RECORD)
            if _exists(spark, f"{table}/records"):
                stored = spark.read.schema(f"{schemas.RECORD}, bucket INT").parquet(f"{table}/records")
                held = stored.filter(F.col("bucket").isin(touched)).drop("bucket")
            held.write.mode("overwrite").parquet(before)
        current = spark.read.schema(schemas.RECORD).parquet(before)
        now = now_of(batch_id)
        folded = upsert.folded(notices, current, tag_rules=rules.tags, keep=cut_lineage)
        opened, given = upsert.new_keys(current, folded, now)
        fresh = _keys_of(opened).unionByName(given.select(F.lit("cig").alias("kind"), F.col("cig").alias("key"), "id"))
        store(upsert.merge(current, folded, now), fresh, batch_id)
        _remove(spark, f"{table}/before/batch={batch_id - 1}")  # the stream will not return to it

    return write


def stream_upsert(
    raw: DataFrame,
    table: str,
    sources: DataFrame,
    checkpoint: str,
    now_of: Callable[[int], datetime],
    *,
    rules: R.NormaliseRules = R.NormaliseRules(),
    seed: DataFrame | None = None,
    buckets: int = BUCKETS,
    available_now: bool = True,
) -> StreamingQuery:
    """Normalise and merge raw records (a stream) as they land; ``read_records`` reads the table.

    The stream's checkpoint remembers what was read, so raw rows need no bookmark column.
    """
    writer = raw.writeStream.foreachBatch(upsert_batch(table, sources, now_of, rules, seed, buckets))
    return _start(writer, checkpoint, available_now)


def repeated_event_windows(
    events: DataFrame,
    rules: R.AnomalyRules = R.AnomalyRules(),
    slide: str = "1 day",
    late: str = "2 days",
) -> DataFrame:
    """Records with repeated events inside a sliding window, as a stream or as a batch.

    Windows are aligned to midnight and move by ``slide``. This is not the batch rule "within the
    last 30 days from now"; it says in which 30-day windows that held.
    """
    kind = F.lower(F.col("event_type")) == rules.repeated_type
    stream = events.filter(kind)
    if events.isStreaming:
        stream = stream.withWatermark("event_date", late)
    frame = F.window("event_date", f"{rules.repeated_days} days", slide)
    return (
        stream.groupBy("procurement_record_id", frame.alias("w"))
        .agg(F.count("*").alias("n_events"))
        .filter(F.col("n_events") >= rules.repeated_min)
        .select(
            "procurement_record_id", F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"), "n_events",
        )
    )


def stream_repeated_events(
    events: DataFrame,
    table: str,
    checkpoint: str,
    *,
    rules: R.AnomalyRules = R.AnomalyRules(),
    late: str = "2 days",
    available_now: bool = True,
) -> StreamingQuery:
    """Windows whose end the latest event has passed by ``late``, a folder per day; later events correct them.

    Counts per record and day are kept beside the table, in ``{table}-days``, so that nothing is dropped.
    """
    writer = events.writeStream.foreachBatch(repeated_batch(table, rules, late))
    return _start(writer, checkpoint, available_now)


def repeated_batch(table: str, rules: R.AnomalyRules, late: str) -> Callable[[DataFrame, int], None]:
    """A replayed batch overwrites its own counts and the same windows.

    Counts per record and day lie in a folder per day and batch, the latest event of each batch in a small table beside them. A batch reads
    the days of the windows that close with it and of the closed ones that its own days touch, not the whole past.
    """
    days, times, span = f"{table}-days", f"{table}-times", rules.repeated_days

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kind = (F.lower(F.col("event_type")) == rules.repeated_type) & F.col("event_date").isNotNull()
        own = cut_lineage(batch.filter(kind).groupBy("procurement_record_id", F.to_date("event_date").alias("day")).agg(
            F.count("*").alias("n"), F.max(F.unix_micros(F.col("event_date").cast("timestamp"))).alias("last")))
        if own.isEmpty():
            return
        held = own.select("procurement_record_id", "n", "day", F.lit(batch_id).alias("batch"))
        held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(days)
        own.agg(F.max("last").alias("last")).write.mode("overwrite").parquet(f"{times}/batch={batch_id}")

        # A window is closed when its last day is over by ``late``; these are the first days of the latest such windows.
        moment = spark.read.schema("last LONG, batch INT").parquet(times).filter(F.col("batch") <= batch_id)
        edge = lambda last: F.date_sub(F.to_date(F.timestamp_micros(last) - F.expr(f"INTERVAL {late}")), span)
        seen = moment.agg(edge(F.max("last")).alias("now"), edge(F.max(F.when(F.col("batch") < batch_id, F.col("last")))).alias("before")).first()

        # As many dates as the batch has days, whatever the number of events.
        touched = [r.day for r in own.select("day").distinct().collect()]
        fresh = (F.col("start") <= F.lit(seen.now)) & (F.lit(seen.before is None) | (F.col("start") > F.lit(seen.before)))
        closed = {d - timedelta(i) for d in touched for i in range(span)} if seen.before is not None else set()
        again = sorted(d for d in closed if d <= seen.before)
        needed = sorted({d + timedelta(i) for d in again for i in range(span)})
        state = spark.read.schema(held.schema).parquet(days).filter(F.col("batch") <= batch_id)
        if seen.before is not None:
            state = state.filter(F.col("day").between(F.lit(seen.before), F.date_add(F.lit(seen.now), span)) | F.col("day").isin(needed))
        starts = F.explode(F.sequence(F.date_sub("day", span - 1), F.col("day"))).alias("start")
        found = state.select("procurement_record_id", "n", starts).filter(fresh | F.col("start").isin(again))
        found.groupBy("procurement_record_id", "start").agg(F.sum("n").alias("n_events")).filter(F.col("n_events") >= rules.repeated_min).select(
            "procurement_record_id", F.col("start").cast("timestamp").alias("window_start"),
            F.date_add("start", span).cast("timestamp").alias("window_end"), "n_events", F.col("start").alias("window_day"),
        ).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window_day").parquet(table)

    return write
