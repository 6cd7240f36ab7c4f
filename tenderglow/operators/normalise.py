"""Raw records to typed, classified notices."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderglow import rules as R
from tenderglow.functions import jsonvals as J
from tenderglow.functions import text as T
from tenderglow.functions import values as V

PREVALIDATED = "perimeter_prevalidated"
# Amounts keep this precision until the threshold and zero tests are done.
_EXACT = "decimal(38,10)"


def pending(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """Raw records not normalised yet, with the rank of their source.

    The source table is a dimension; whether it is broadcast is left to Spark's size check.
    """
    ranks = sources.select(F.col("id").alias("source_id"), "source_priority_rank")
    return (
        raw.filter(F.col("normalized_at").isNull())
        .join(ranks, "source_id", "left")
        .withColumn(
            "source_priority_rank", F.coalesce("source_priority_rank", F.lit(R.UNKNOWN_RANK))
        )
    )


def _hint(df: DataFrame, name: str) -> Column:
    """A caller-supplied value that wins over the extracted one."""
    column = f"{name}_hint"
    return T.filled(F.col(column)) if column in df.columns else F.lit(None).cast("string")


def with_scope(df: DataFrame, scope: R.ScopeRules = R.ScopeRules()) -> DataFrame:
    """Add the parsed document and ``in_scope`` (prevalidated, or scored in scope)."""
    combined = T.join_filled(" ", F.col("raw_title"), F.col("raw_body"))
    # The document is parsed for this only where the key occurs in it at all.
    named = F.coalesce(F.col("extracted_json").contains(PREVALIDATED), F.lit(False))
    return (
        df.withColumn("_doc", J.parsed(F.col("extracted_json")))
        .withColumn("_text", combined)
        .withColumn(
            "in_scope",
            (named & J.truthy(F.col("_doc"), PREVALIDATED)) | T.in_scope(F.col("_text"), scope),
        )
    )


def normalise(df: DataFrame, rules: R.NormaliseRules = R.NormaliseRules()) -> DataFrame:
    """Typed notices of the raw records in scope, one row per raw record.

    Keeps ``id`` and ``fetched_at`` of the raw record as ``raw_id`` and ``fetched_at``; the
    pair is the order in which notices of one tender are merged.
    """
    doc = F.col("_texts")
    kept = with_scope(df, rules.scope).filter("in_scope").withColumn(
        "_texts", J.usable_texts(F.col("_doc"))
    )

    fields = kept.select(
        F.col("id").alias("raw_id"),
        "fetched_at",
        "source_priority_rank",
        "raw_body",
        F.col("raw_url").alias("link_bando"),
        F.col("_text"),
        F.coalesce(T.filled(F.col("raw_title")), J.first_str(doc, *R.DESCRIPTION_KEYS)).alias(
            "descrizione"
        ),
        F.coalesce(_hint(df, "ente"), J.first_str(doc, *R.BUYER_KEYS)).alias("_buyer"),
        J.first_str(doc, *R.LATE_BUYER_KEYS).alias("_late_buyer"),
        F.upper(J.first_str(doc, *R.CIG_KEYS)).alias("_cig"),
        V.amount(J.first_str(doc, *R.AMOUNT_KEYS), _EXACT).alias("_amount"),
        F.coalesce(
            F.col("raw_date"), V.it_date(J.first_str(doc, *R.PUBLISHED_KEYS))
        ).alias("data_pubblicazione"),
        V.it_date(J.first_str(doc, *R.DEADLINE_KEYS)).alias("scadenza"),
        J.first_str(doc, *R.PROCEDURE_KEYS).alias("tipologia_gara_procedura"),
        J.first_str(doc, "tipo_strumento").alias("tipo_strumento"),
        *[
            F.coalesce(_hint(df, k), J.first_str(doc, k)).alias(k)
            for k in ("regione", "provincia", "comune")
        ],
        J.first_str(doc, "atto_tipo").alias("atto_tipo"),
    )

    procedure = F.col("tipologia_gara_procedura")
    flag_text = F.concat(F.col("_text"), F.lit(" "), F.coalesce(procedure, F.lit("")))
    typed = fields.select(
        "*",
        F.when(T.valid_cig(F.col("_cig")), F.col("_cig")).alias("cig"),
        F.col("_amount").cast("decimal(18,2)").alias("importo"),
        F.coalesce(F.lower(T.strip(F.col("tipo_strumento"))).isin(*rules.frameworks), F.lit(False))
        .alias("_framework"),
        T.tags(F.col("_text"), F.col("_amount"), rules.tags).alias("tag_tecnico"),
        *[c.alias(name) for name, c in T.flags(flag_text, rules.flags).items()],
        T.state(
            T.join_filled(" ", F.col("descrizione"), F.col("raw_body"), F.col("atto_tipo")),
            F.col("atto_tipo"),
            rules.state,
        ).alias("stato_procedurale"),
        T.reliability(F.col("source_priority_rank")).alias("reliability_index"),
        F.lit(rules.sector).alias("macrosettore"),
    )
    return evidence(typed).drop(
        "_text", "_buyer", "_late_buyer", "_cig", "_amount", "_framework", "raw_body", "atto_tipo"
    )


def evidence(typed: DataFrame) -> DataFrame:
    """Final buyer, ``validation_level`` and ``is_weak_evidence``.

    A notice is weak without buyer (frameworks have none by nature), description, link, or any
    of amount, CIG, deadline and procedure.
    """
    identified = (
        F.col("_amount").isNotNull()
        | F.col("cig").isNotNull()
        | F.col("scadenza").isNotNull()
        | F.col("tipologia_gara_procedura").isNotNull()
    )
    core = (
        (F.col("_buyer").isNotNull() | F.col("_framework"))
        & F.col("descrizione").isNotNull()
        & T.filled(F.col("link_bando")).isNotNull()
    )
    framework_name = F.when(
        F.col("_framework"),
        F.concat(F.lit("Strumento quadro multi-ente ("), F.col("tipo_strumento"), F.lit(")")),
    )
    level = (
        F.when(F.col("cig").isNotNull() & (F.col("_amount") != 0), "L3")
        .when(identified, "L2")
        .otherwise("L1")
    )
    buyer = F.coalesce(F.col("_buyer"), F.col("_late_buyer"), framework_name)
    return typed.select(
        "*",
        level.alias("validation_level"),
        (~(core & identified) | buyer.isNull()).alias("is_weak_evidence"),
        F.coalesce(buyer, F.lit(R.NO_BUYER)).alias("ente"),
    )


def novelty(
    state: Column, existing: Column, first_seen: Column, published: Column, now: datetime
) -> Column:
    """Pre-tender signal, update of a known record, surfaced late, or new today."""
    today = F.to_date(V.at(now))
    surfaced = (F.to_date(first_seen) == today) & (F.to_date(published) < today)
    return (
        F.when(state == R.PRE_TENDER, R.PRE_TENDER_SIGNAL)
        .when(existing, R.KNOWN_UPDATE)
        .when(surfaced, R.SURFACED_TODAY)
        .otherwise(R.NEW_TODAY)
    )


def mark_normalised(raw: DataFrame, now: datetime) -> DataFrame:
    """Bookmark: every pending raw record, in scope or not, counts as done."""
    return raw.withColumn("normalized_at", F.coalesce("normalized_at", V.at(now)))


def normalise_metrics(waiting: DataFrame, notices: DataFrame) -> DataFrame:
    """One row: raw records looked at, and valid and weak notices among them."""
    found = waiting.agg(F.count("*").cast("int").alias("records_found"))
    split = notices.agg(
        F.count_if(~F.col("is_weak_evidence")).cast("int").alias("records_valid"),
        F.count_if("is_weak_evidence").cast("int").alias("records_weak"),
    )
    return found.unionByName(split, allowMissingColumns=True).agg(
        F.max("records_found").alias("records_found"),
        F.max("records_valid").alias("records_valid"),
        F.max("records_weak").alias("records_weak"),
    )
