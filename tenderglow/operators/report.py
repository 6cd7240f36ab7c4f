"""The daily report: sections, KPI, source runs, markdown, stored row."""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderglow import rules as R
from tenderglow.functions import values as V
from tenderglow.operators.anomalies import open_alerts

# Section -> rows shown in the stored report.
SECTION_ROWS = {"nuove_gare": 30, "aggiornamenti": 30, "pre_gara": 20, "evidenze_deboli": 30}
MARKDOWN_ROWS = 10
ITEM = (
    "id", "ente", "descrizione", "importo", "cig", "link_bando", "regione", "scadenza",
    "stato_procedurale", "tipo_novita", "score", "priorita", "is_weak_evidence",
)


# Columns that a section shows or is ordered by.
_SHOWN = (
    "id", "ente", "descrizione", "importo", "cig", "link_bando", "regione", "scadenza",
    "stato_procedurale", "tipo_novita", "score_commerciale", "priorita_commerciale",
    "is_weak_evidence", "first_seen_at",
)


def _new() -> Column:
    return F.col("tipo_novita").isin(R.NEW_TODAY, R.SURFACED_TODAY) & ~F.col("is_weak_evidence")


def section_filters() -> dict[str, Column]:
    """What belongs to each section; sections overlap, and only masters count but for weak rows."""
    master = F.col("master_record_id").isNull()
    return {
        "nuove_gare": master & _new(),
        "aggiornamenti": master & (F.col("tipo_novita") == R.KNOWN_UPDATE),
        "pre_gara": master & (F.col("stato_procedurale") == R.PRE_TENDER),
        "evidenze_deboli": F.col("is_weak_evidence"),
    }


def section(records: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """Top rows of one section, numbered by ``position``; without a limit the whole section, unnumbered.

    Best score first, then buyer; weak rows in order of arrival. A limit over a sort keeps only
    the best rows of every partition, so no section is ever gathered whole; the numbering sees
    just the rows that are left.
    """
    score = F.coalesce("score_commerciale", F.lit(0))
    order = (
        [F.col("first_seen_at"), F.col("id")]
        if name == "evidenze_deboli"
        else [score.desc(), F.col("ente"), F.col("id")]
    )
    top = records.filter(section_filters()[name]).select(*_SHOWN).orderBy(*order)
    if limit is not None:
        top = top.limit(limit)
    number = F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(*order))
    position = number if limit is not None else F.lit(None).cast("int")
    return _items(top.withColumns({"section": F.lit(name), "position": position}))


def _items(rows: DataFrame) -> DataFrame:
    return rows.select(
        "section",
        "position",
        "id",
        "ente",
        "descrizione",
        F.col("importo").cast("double").alias("importo"),
        "cig",
        "link_bando",
        "regione",
        "scadenza",
        "stato_procedurale",
        "tipo_novita",
        F.col("score_commerciale").alias("score"),
        F.col("priorita_commerciale").alias("priorita"),
        "is_weak_evidence",
    )


def report_kpi(records: DataFrame, runs_today: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row of nine numbers.

    ``runs_today`` is the output of :func:`latest_run_per_source`.
    """
    belongs = section_filters()
    master = F.col("master_record_id").isNull()
    live_value = F.sum(F.when(master & (F.col("stato_procedurale") == R.PUBLISHED), F.col("importo")))
    parts = [
        records.agg(
            F.count_if(belongs["nuove_gare"]).alias("total_new"),
            F.count_if(belongs["aggiornamenti"]).alias("total_updates"),
            F.count_if(belongs["pre_gara"]).alias("total_pregara"),
            F.count_if(belongs["evidenze_deboli"]).alias("total_weak"),
            F.count_if(master & (F.col("priorita_commerciale") == "P1")).alias("total_p1"),
            F.coalesce(live_value.cast("double"), F.lit(0.0)).alias("valore_totale_eur"),
        ),
        runs_today.agg(
            F.count_if(F.col("status") == "success").alias("total_sources_ok"),
            F.count_if(F.col("status") == "failed").alias("total_sources_failed"),
        ),
        open_alerts(alerts).agg(F.count("*").alias("total_anomalie_aperte")),
    ]
    return one_row(parts)


def one_row(parts: list[DataFrame]) -> DataFrame:
    """Side by side: one-row frames with different columns become one row, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def latest_run_per_source(runs: DataFrame, sources: DataFrame, today: date) -> DataFrame:
    """Latest run of each source started on ``today``, the earlier-listed one on a tie."""
    started = F.col("started_at")
    day = F.lit(today)
    # A range on the stored column, so the scan can skip files of other days.
    on_day = (started >= day.cast("timestamp")) & (
        started < F.date_add(day, 1).cast("timestamp")
    )
    kept = ("status", "records_found", "records_valid", "records_weak", "error_message")
    latest = (
        runs.filter(on_day & F.col("source_id").isNotNull())
        .groupBy("source_id")
        .agg(
            F.min_by(
                F.struct(*kept), F.struct(F.lit(0) - F.unix_micros(started), F.col("id"))
            ).alias("r")
        )
    )
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return latest.join(names, "source_id", "left").select(
        "source_id", F.coalesce("source_name", F.lit("(unknown)")).alias("source_name"), "r.*"
    )


def open_alert_items(alerts: DataFrame) -> DataFrame:
    return open_alerts(alerts).select(
        "id", "alert_type", "severity", "description", V.iso(F.col("opened_at")).alias("opened_at"),
        "procurement_record_id",
    )


def sections(records: DataFrame) -> DataFrame:
    """All four sections, cut to what the report shows (at most 110 rows), in one scan and one shuffle.

    The bound on the rank is applied in every partition before the shuffle, so at most 30 rows of a section
    leave one.
    """
    names = F.array_compact(F.array(*[F.when(belongs, F.lit(n)) for n, belongs in section_filters().items()]))
    rows = records.select(*_SHOWN, F.explode(names).alias("section"))
    weak = F.col("section") == "evidenze_deboli"
    # Columns that do not order a section are null all over it.
    order = [
        F.when(~weak, F.coalesce("score_commerciale", F.lit(0))).desc(),
        F.when(~weak, F.col("ente")),
        F.when(weak, F.col("first_seen_at")),
        F.col("id"),
    ]
    ranked = rows.withColumn("position", F.row_number().over(Window.partitionBy("section").orderBy(*order)))
    own = reduce(lambda rest, x: F.when(F.col("section") == x[0], x[1]).otherwise(rest), SECTION_ROWS.items(), F.lit(0))
    return _items(ranked.filter((F.col("position") <= max(SECTION_ROWS.values())) & (F.col("position") <= own)))


def _section_arrays(cut: DataFrame) -> DataFrame:
    """One row with one sorted array per section; the input is cut already."""

    def gathered(name: str) -> Column:
        rows = F.collect_list(
            F.when(F.col("section") == name, F.struct("position", F.struct(*ITEM).alias("row")))
        )
        return F.transform(F.array_sort(rows), lambda x: x.row)

    return cut.agg(*[gathered(n).alias(n) for n in SECTION_ROWS])


def _lines(items: Column, render, empty: str) -> Column:
    shown = F.slice(items, 1, MARKDOWN_ROWS)
    return F.when(F.size(items) == 0, F.array(F.lit(empty))).otherwise(F.transform(shown, render))


def _markdown(today: date) -> Column:
    """Fixed layout A-D plus the KPI table, over the one-row report frame."""

    def text(c: Column) -> Column:
        return F.coalesce(F.substring(c, 1, 80), F.lit(""))

    dash = F.lit(" — ")

    def new_line(r: Column) -> Column:
        return F.concat(
            F.lit("- **["), F.coalesce(r.priorita, F.lit("?")), F.lit("]** "), r.ente, dash,
            text(r.descrizione), dash, V.eur(r.importo), F.lit(" — scad "),
            F.coalesce(F.date_format(r.scadenza, "dd/MM/yyyy"), F.lit("n.d.")),
        )

    def update_line(r: Column) -> Column:
        return F.concat(F.lit("- "), r.ente, dash, text(r.descrizione), dash, r.stato_procedurale)

    def signal_line(r: Column) -> Column:
        return F.concat(F.lit("- "), r.ente, dash, text(r.descrizione))

    def kpi_line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"| {label} | "), value.cast("string"), F.lit(" |"))

    def number(name: str) -> Column:
        return F.col(name).cast("string")

    title = F.concat(
        F.lit("# Report · Illuminazione pubblica · "), F.date_format(F.lit(today), "dd MMMM yyyy")
    )
    sources_line = F.concat(
        number("n_sources"), F.lit(" fonti · "),
        number("total_sources_ok"), F.lit(" ok · "),
        number("total_sources_failed"), F.lit(" errori · "),
        number("total_sources_partial"), F.lit(" parziali"),
    )
    blank = F.lit("")
    blocks = [
        F.array(title, blank, F.lit("## A. Nuove gare")),
        _lines(F.col("nuove_gare"), new_line, "Nessuna gara pubblicata oggi."),
        F.array(blank, F.lit("## B. Aggiornamenti")),
        _lines(F.col("aggiornamenti"), update_line, "Nessun aggiornamento su gare note."),
        F.array(blank, F.lit("## C. Segnali pre-gara")),
        _lines(F.col("pre_gara"), signal_line, "Nessun segnale pre-gara nuovo."),
        F.array(
            blank, F.lit("## D. Fonti interrogate"), sources_line, blank, F.lit("## Cruscotto"),
            F.lit("| KPI | Valore |"), F.lit("|---|---|"),
            kpi_line("Nuove gare", F.col("total_new")),
            kpi_line("Aggiornamenti", F.col("total_updates")),
            kpi_line("Pre-gara", F.col("total_pregara")),
            kpi_line("Evidenze deboli", F.col("total_weak")),
            kpi_line("Priorità P1", F.col("total_p1")),
            kpi_line("Valore gare attive", V.eur(F.col("valore_totale_eur"))),
            kpi_line("Anomalie aperte", F.col("total_anomalie_aperte")),
        ),
    ]
    return F.concat(F.array_join(F.concat(*blocks), "\n"), F.lit("\n"))


def report_row(
    records: DataFrame,
    runs: DataFrame,
    sources: DataFrame,
    alerts: DataFrame,
    today: date,
    now: datetime,
) -> DataFrame:
    """The report of one day as one row: four totals, JSON payload and markdown.

    The JSON holds the KPI, the cut sections and the markdown. The lists without an upper bound,
    source runs and open alerts, are tables of their own (:func:`latest_run_per_source`,
    :func:`open_alert_items`) instead of arrays in one row.
    """
    runs_today = latest_run_per_source(runs, sources, today)
    run_totals = runs_today.agg(
        F.count("*").alias("n_sources"),
        F.count_if(F.col("status") == "partial").alias("total_sources_partial"),
    )
    kpi = report_kpi(records, runs_today, alerts)
    names = kpi.columns
    # The array frame has one row; so have the others, hence max picks the only value there is.
    arrays = _section_arrays(sections(records))
    flat = one_row([kpi, run_totals]).select(F.struct("*").alias("n"))
    joined = (
        arrays.select(F.struct("*").alias("s"))
        .unionByName(flat, allowMissingColumns=True)
        .agg(F.first("s", ignorenulls=True).alias("s"), F.first("n", ignorenulls=True).alias("n"))
        .select("s.*", "n.*")
    )
    item = {n: F.transform(F.col(n), _json_item) for n in SECTION_ROWS}
    return joined.withColumn("markdown", _markdown(today)).select(
        F.lit(today).alias("report_date"),
        F.col("total_new").cast("int").alias("total_new"),
        F.col("total_updates").cast("int").alias("total_updates"),
        F.col("total_pregara").cast("int").alias("total_pregara"),
        F.col("total_sources_ok").cast("int").alias("total_new_sources"),
        F.to_json(
            F.struct(
                F.lit(today.isoformat()).alias("report_date"),
                V.iso(V.at(now)).alias("generated_at"),
                F.struct(
                    *[
                        F.round(c, 2).alias(c) if c == "valore_totale_eur" else F.col(c)
                        for c in names
                    ]
                ).alias("kpi"),
                *[c.alias(n) for n, c in item.items()],
                F.col("markdown"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("report_json"),
        "markdown",
        V.at(now).alias("generated_at"),
    )


def _json_item(r: Column) -> Column:
    return F.struct(*[
        V.iso(r.scadenza).alias("scadenza") if c == "scadenza" else r[c].alias(c) for c in ITEM
    ])


def upsert_report(reports: DataFrame, row: DataFrame) -> DataFrame:
    """Replace the reports of the dates in ``row``, keep the others."""
    kept = reports.join(row.select("report_date"), "report_date", "left_anti")
    return kept.unionByName(row.select(*reports.columns))


def write_report(row: DataFrame, path: str) -> None:
    """The same on files: only the partitions of the dates in ``row`` are rewritten."""
    (
        row.drop("markdown")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("report_date")
        .parquet(path)
    )


def report_history(reports: DataFrame, limit: int = 30) -> DataFrame:
    """Newest reports first."""
    return reports.orderBy(F.desc("report_date")).limit(limit)


def latest_report(reports: DataFrame) -> DataFrame:
    return report_history(reports, 1)


def report_by_date(reports: DataFrame, day: date) -> DataFrame:
    """One day's report; on the partitioned table this reads a single folder."""
    return reports.filter(F.col("report_date") == F.lit(day))
