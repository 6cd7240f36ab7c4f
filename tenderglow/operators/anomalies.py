"""Anomaly rules over records and their event histories, and the alerts they open."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderglow import rules as R
from tenderglow.functions import text as T
from tenderglow.functions import values as V
from tenderglow.operators import joins


def _no_later_than(now: datetime, days: int) -> Column:
    return V.at(now) - F.expr(f"INTERVAL {days} DAYS")


def _type(events_type: str = "event_type") -> Column:
    return F.lower(F.coalesce(F.col(events_type), F.lit("")))


def _mentions(rules: R.AnomalyRules) -> Column:
    text = F.lower(F.coalesce("description", F.lit("")))
    return T.contains_any(_type(), rules.appeal_type_words) | T.contains_any(
        text, rules.appeal_text_words
    )


def event_facts(
    events: DataFrame, now: datetime, rules: R.AnomalyRules = R.AnomalyRules()
) -> DataFrame:
    """Per record, in one aggregate, all that the rules need from its history.

    Everything here combines map-side, so a record with very many events is no hot spot.
    Events of equal time are taken by id.
    """
    recent = F.col("event_date") >= _no_later_than(now, rules.repeated_days)
    moment = F.struct("event_date", "id")
    return events.groupBy("procurement_record_id").agg(
        F.count_if((_type() == rules.repeated_type) & recent).alias("n_repeated"),
        F.min("event_date").alias("first_event"),
        F.min_by(
            F.struct("event_date", "description"), F.when(_mentions(rules), moment)
        ).alias("appeal"),
    )


def revocations(
    records: DataFrame,
    events: DataFrame,
    rules: R.AnomalyRules = R.AnomalyRules(),
    hot_rows: int = joins.HOT_ROWS,
) -> DataFrame:
    """First revocation strictly after publication, per record that has one."""
    revoked = events.filter(_type() == rules.revoked_type).select(
        F.col("id").alias("event_id"), "procurement_record_id", "event_date"
    )
    published = records.filter(F.col("data_pubblicazione").isNotNull()).select(
        F.col("id").alias("procurement_record_id"), "data_pubblicazione"
    )
    dated = joins.attach(
        revoked, published, "procurement_record_id", spread_by="event_id", hot_rows=hot_rows
    )
    return (
        dated.filter(F.col("event_date") > F.col("data_pubblicazione"))
        .groupBy("procurement_record_id")
        .agg(F.min("event_date").alias("revoked_at"))
    )


def _candidate(record: Column, kind: str, severity: str, text: Column) -> Column:
    return F.struct(
        F.concat(F.lit(f"{kind}:"), record.cast("string")).alias("alert_key"),
        record.alias("procurement_record_id"),
        F.lit(kind).alias("alert_type"),
        F.lit(severity).alias("severity"),
        text.alias("description"),
    )


def _day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def _rule_columns(now: datetime, rules: R.AnomalyRules) -> dict[str, Column]:
    """One nullable candidate per rule, over records joined with their facts."""
    rid, state = F.col("id"), F.col("stato_procedurale")
    description = F.lower(F.coalesce("descrizione", F.lit("")))
    since = F.coalesce("first_event", "first_seen_at")
    days = V.whole_days_since(since, now)
    return {
        "proroga_multipla": F.when(
            F.col("n_repeated") >= rules.repeated_min,
            _candidate(
                rid, "proroga_multipla", "high",
                F.concat(
                    F.col("n_repeated").cast("string"),
                    F.lit(f" proroghe registrate negli ultimi {rules.repeated_days} giorni"),
                ),
            ),
        ),
        "revoca_post_pubblicazione": F.when(
            F.col("revoked_at").isNotNull(),
            _candidate(
                rid, "revoca_post_pubblicazione", "critical",
                F.concat(
                    F.lit("Revoca rilevata il "), _day(F.col("revoked_at")),
                    F.lit(" dopo pubblicazione del "), _day(F.col("data_pubblicazione")),
                ),
            ),
        ),
        "ricorso_tar": F.when(
            F.col("appeal").isNotNull(),
            _candidate(
                rid, "ricorso_tar", "high",
                F.coalesce(
                    T.filled(F.col("appeal.description")),
                    F.concat(
                        F.lit("Ricorso/TAR registrato il "), _day(F.col("appeal.event_date"))
                    ),
                ),
            ),
        ),
        "procedura_ponte": F.when(
            (state == R.PUBLISHED) & T.contains_any(description, rules.bridge_words),
            _candidate(
                rid, "procedura_ponte", "medium",
                F.lit("Possibile procedura ponte dopo gara deserta/annullata"),
            ),
        ),
        "stato_stallo": F.when(
            (state == R.AMENDED) & (since <= _no_later_than(now, rules.stalled_days)),
            _candidate(
                rid, "stato_stallo", "low",
                F.concat(
                    F.lit("Gara in stato RETTIFICA da "), days.cast("string"), F.lit(" giorni")
                ),
            ),
        ),
    }


def candidates(
    records: DataFrame,
    events: DataFrame,
    now: datetime,
    rules: R.AnomalyRules = R.AnomalyRules(),
    only: tuple[str, ...] | None = None,
    hot_rows: int = joins.HOT_ROWS,
) -> DataFrame:
    """All rule hits, before looking at alerts that are open already.

    Records are read once; each carries an array of its hits that is unfolded at the end.
    ``only`` restricts the rules, and inputs no rule needs are not read.
    """
    wanted = [r for r in _rule_columns(now, rules) if only is None or r in only]
    base = records.select(
        "id", "descrizione", "stato_procedurale", "data_pubblicazione", "first_seen_at"
    )
    if {"proroga_multipla", "ricorso_tar", "stato_stallo"} & set(wanted):
        facts = event_facts(events, now, rules).withColumnRenamed("procurement_record_id", "id")
        base = base.join(facts, "id", "left")
    if "revoca_post_pubblicazione" in wanted:
        revoked = revocations(records, events, rules, hot_rows).withColumnRenamed(
            "procurement_record_id", "id"
        )
        base = base.join(revoked, "id", "left")
    columns = _rule_columns(now, rules)
    hits = F.array_compact(F.array(*[columns[r] for r in wanted]))
    return base.select(F.explode(hits).alias("hit")).select("hit.*")


def suppress_open(found: DataFrame, alerts: DataFrame) -> DataFrame:
    """Drop candidates whose key is on an open alert."""
    keys = open_alerts(alerts).select(T.alert_key(F.col("description")).alias("alert_key"))
    return found.join(keys.filter(F.col("alert_key").isNotNull()), "alert_key", "left_anti")


def detect(
    records: DataFrame,
    events: DataFrame,
    alerts: DataFrame,
    now: datetime,
    rules: R.AnomalyRules = R.AnomalyRules(),
) -> DataFrame:
    """Alerts to append: candidates not open yet, key in front of the text."""
    opened = V.at(now)
    return suppress_open(candidates(records, events, now, rules), alerts).select(
        F.sha2(F.concat_ws("|", F.lit("alert"), "alert_key", V.iso(opened)), 256).alias("id"),
        "procurement_record_id",
        "alert_type",
        "severity",
        T.alert_text(F.col("alert_key"), F.col("description")).alias("description"),
        F.lit(True).alias("is_open"),
        opened.alias("opened_at"),
        F.lit(None).cast("timestamp").alias("closed_at"),
    )


def open_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.filter("is_open")


def close_alerts(alerts: DataFrame, ids: DataFrame, now: datetime) -> DataFrame:
    """Close the alerts whose ``id`` is in ``ids``."""
    closing = ids.select("id").distinct().withColumn("_close", F.lit(True))
    hit = F.col("_close").isNotNull()
    return alerts.join(closing, "id", "left").select(
        *[
            {
                "is_open": F.when(hit, F.lit(False)).otherwise(F.col("is_open")),
                "closed_at": F.when(hit, V.at(now)).otherwise(F.col("closed_at")),
            }.get(c, F.col(c)).alias(c)
            for c in alerts.columns
        ]
    )


def list_alerts(
    alerts: DataFrame, is_open: bool | None = None, severity: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Newest alerts first, all of them unless a page size is given."""
    out = alerts
    if is_open is not None:
        out = out.filter(F.col("is_open") == is_open)
    if severity:
        out = out.filter(F.col("severity") == severity)
    ordered = out.orderBy(F.desc("opened_at"), "id")
    return ordered if limit is None else ordered.limit(limit)
