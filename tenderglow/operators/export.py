"""Exports of records, and run metrics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderglow.functions import values as V
from tenderglow.operators.search import RecordFilters, matching

SCHEMA_VERSION = "4.0"

# Fixed values: (header of the CSV, key of the JSON), in export order.
COLUMNS = (
    ("Ente", "ente"),
    ("Oggetto", "descrizione"),
    ("Importo (IVA escl.)", "importo"),
    ("CIG", "cig"),
    ("Stato procedurale", "stato_procedurale"),
    ("Tipo novità", "tipo_novita"),
    ("Data pubblicazione", "data_pubblicazione"),
    ("Scadenza", "scadenza"),
    ("Procedura", "tipologia_gara_procedura"),
    ("Criterio", "criterio"),
    ("Regione", "regione"),
    ("Provincia", "provincia"),
    ("Comune", "comune"),
    ("Macrosettore", "macrosettore"),
    ("Flag PPP", "flag_ppp_doppio_oggetto"),
    ("Flag concessione", "flag_concessione_ambito"),
    ("Flag in-house", "flag_in_house_ambito"),
    ("Flag O&M", "flag_om"),
    ("Flag pre-gara", "flag_pre_gara"),
    ("Tag tecnico", "tag_tecnico"),
    ("Validation level", "validation_level"),
    ("Reliability", "reliability_index"),
    ("Score", "score_commerciale"),
    ("Priorità", "priorita_commerciale"),
    ("Weak evidence", "is_weak_evidence"),
    ("Master record id", "master_record_id"),
    ("Link bando", "link_bando"),
    ("Source priority rank", "source_priority_rank"),
    ("First seen", "first_seen_at"),
    ("Last seen", "last_seen_at"),
    ("Record id", "record_id"),
)
_TIMESTAMPS = ("data_pubblicazione", "scadenza", "first_seen_at", "last_seen_at")


def _value(key: str) -> Column:
    if key in _TIMESTAMPS:
        return V.iso(F.col(key))
    if key == "record_id":
        return F.col("id")
    if key == "importo":
        return F.col(key).cast("double")
    if key == "is_weak_evidence":
        return F.coalesce(F.col(key), F.lit(False))
    return F.col(key)


def export_columns(records: DataFrame) -> DataFrame:
    """The 31 export columns under their JSON keys: amounts as doubles, times as ISO text."""
    return records.select(*[_value(key).alias(key) for _, key in COLUMNS])


def _csv_text(key: str) -> Column:
    """Text as a spreadsheet user expects it: ``1250000.0`` and ``True``/``False``."""
    if key == "importo":
        # From the decimal: a double would turn to scientific notation from ten million on.
        return F.regexp_replace(F.col("importo").cast("string"), r"(\.\d)0$", "$1")
    if key == "is_weak_evidence":
        return F.initcap(_value(key).cast("string"))
    return _value(key).cast("string")


def csv_rows(records: DataFrame) -> DataFrame:
    return records.select(*[_csv_text(key).alias(header) for header, key in COLUMNS])


def export_rows(
    records: DataFrame, filters: RecordFilters = RecordFilters(only_masters=True),
    limit: int | None = None,
) -> DataFrame:
    """Records an export covers: masters unless told otherwise, all of them without a limit."""
    chosen = matching(records, filters)
    if limit is None:
        return chosen
    return chosen.orderBy(
        F.col("data_pubblicazione").desc_nulls_last(), F.desc("first_seen_at"), "id"
    ).limit(limit)


def export_csv(records: DataFrame, path: str) -> None:
    """CSV part files, each with the header: null as nothing, quotes doubled, ``\\n`` line ends."""
    csv_rows(records).write.mode("overwrite").csv(
        path, header=True, nullValue="", emptyValue="", escape='"', lineSep="\n",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def export_envelope(records: DataFrame, generated_at: datetime) -> DataFrame:
    """The metadata row beside the JSON records."""
    return records.agg(F.count("*").alias("record_count")).select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        V.iso(V.at(generated_at)).alias("generated_at"),
        "record_count",
    )


def export_json(records: DataFrame, path: str, generated_at: datetime) -> None:
    """``records/`` as JSON lines with every key present, ``envelope/`` with the metadata."""
    export_columns(records).write.mode("overwrite").json(
        f"{path}/records", ignoreNullFields=False
    )
    export_envelope(records, generated_at).write.mode("overwrite").json(f"{path}/envelope")


# ---- run metrics ----------------------------------------------------------------------------------


def job_run(
    metrics: DataFrame,
    job_name: str,
    started_at: datetime,
    ended_at: datetime,
    status: str | None = None,
) -> DataFrame:
    """Rows for the run table from a metrics frame; counters it lacks are zero."""
    have = set(metrics.columns)

    def counter(name: str) -> Column:
        return (F.col(name) if name in have else F.lit(0)).cast("int").alias(name)

    source = F.col("source_id") if "source_id" in have else F.lit(None)
    outcome = F.lit(status) if status else (
        F.col("status") if "status" in have else F.lit("success")
    )
    error = F.col("error_message") if "error_message" in have else F.lit(None)
    source_text = source.cast("string")
    return metrics.select(
        F.sha2(
            F.concat_ws("|", F.lit("run"), F.lit(job_name), source_text, V.iso(V.at(started_at))),
            256,
        ).alias("id"),
        F.lit(job_name).alias("job_name"),
        source_text.alias("source_id"),
        outcome.alias("status"),
        V.at(started_at).alias("started_at"),
        V.at(ended_at).alias("ended_at"),
        counter("records_found"),
        counter("records_valid"),
        counter("records_weak"),
        counter("duplicates_removed"),
        error.cast("string").alias("error_message"),
    )


def run_metrics(runs: DataFrame) -> DataFrame:
    """Runs and their counters per job and status."""
    return runs.groupBy("job_name", "status").agg(
        F.count("*").alias("runs"),
        *[
            F.sum(c).alias(c)
            for c in ("records_found", "records_valid", "records_weak", "duplicates_removed")
        ],
    )
