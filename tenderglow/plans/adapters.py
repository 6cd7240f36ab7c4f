"""The engine's table shapes derived from a star schema of orders and events.

Used by the registered queries, the bench and the tests: plain selects, so the work of every
query grows with the given tables.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tenderglow import rules as R
from tenderglow import schemas
from tenderglow.session import ensure_utc, spread

RECORDS_NOW = datetime(2001, 7, 15, 12, 0, tzinfo=timezone.utc)
EVENTS_NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)

TITLES = (
    "Servizio di illuminazione pubblica e gestione impianti",
    "Accordo quadro illuminazione e relamping LED",
    "Determina a contrarre per telegestione e telecontrollo",
    "Manutenzione edifici comunali",
    "PROROGA termini: smart lighting e pali di illuminazione",
    "Aggiudicazione servizio luce con project financing",
    "Fornitura arredi scolastici",
    "Avviso preinformazione concessione illuminazione stradale",
    "Gara ponte per impianti semaforici, codice 34928510-8",
    "Facility management immobili e climatizzazione",
    "Global service illuminazione in house, fondi PNRR",
)
BODIES = (
    "Lavori finanziati con fondi react-eu.",
    "Affidamento PPP, riqualificazione illuminazione di piazza",
    "Chiarimenti sul capitolato",
    "Procedura aperta",
    "Servizio di pubblica illuminazione, O & M degli impianti",
    "Indagine di mercato per illuminazione interna",
    "Gara deserta",
)
INSTRUMENTS = ("Convenzione", " Accordo Quadro ", "Appalto", "SDA")


def load(spark: SparkSession, sf_dir: str, name: str, busy: bool = False) -> DataFrame:
    """A given table; ``busy`` is for jobs with much work per row (see ``session.spread``)."""
    df = ensure_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if busy else df


def pick(values: tuple[str, ...], index: Column) -> Column:
    """Value number ``index`` modulo the list length."""
    listed = F.array(*[F.lit(v) for v in values])
    return F.get(listed, (index % len(values)).cast("int"))


def _utc(c: str) -> Column:
    return F.col(c).cast("timestamp")


def _day_shift(c: Column, days: Column) -> Column:
    return F.timestamp_add("DAY", days, c)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers in regions as procurement records."""
    orders = load(spark, sf_dir, "orders")
    customer = load(spark, sf_dir, "customer")
    nation = load(spark, sf_dir, "nation")
    region = load(spark, sf_dir, "region")
    k = F.col("o_orderkey")
    states = (R.PUBLISHED, R.AMENDED, R.PRE_TENDER, R.OUTCOME)
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            k.alias("id"),
            (k % 8).cast("int").alias("source_priority_rank"),
            _utc("o_orderdate").alias("data_pubblicazione"),
            F.concat(pick(TITLES, k), F.lit(" "), F.col("o_orderpriority")).alias("descrizione"),
            F.col("c_name").alias("ente"),
            F.when(
                k % 11 != 0, F.col("o_totalprice").cast("decimal(18,2)") * 20
            ).cast("decimal(18,2)").alias("importo"),
            F.col("n_name").alias("provincia"),
            F.col("r_name").alias("regione"),
            F.lit(None).cast("string").alias("comune"),
            F.lit(None).cast("string").alias("criterio"),
            pick(("aperta", "negoziata", "ristretta"), k).alias("tipologia_gara_procedura"),
            _day_shift(_utc("o_orderdate"), (k % 60).cast("int")).alias("scadenza"),
            F.when(
                k % 5 == 0, F.concat(F.lit("C"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
            ).alias("cig"),
            F.concat(F.lit("https://notices.example.com/t/"), k.cast("string")).alias("link_bando"),
            F.lit(R.SECTOR).alias("macrosettore"),
            F.when(F.col("o_orderstatus") == "P", pick((R.PRE_TENDER, R.AMENDED), k))
            .when(F.col("o_orderstatus") == "F", pick((R.OUTCOME, R.PUBLISHED), k))
            .otherwise(pick(states, k)).alias("stato_procedurale"),
            pick(R.NOVELTIES, k).alias("tipo_novita"),
            *[
                F.when(k % (n + 2) == 0, R.YES).otherwise(R.NO).alias(flag)
                for n, flag in enumerate(R.FLAGS)
            ],
            F.when(k % 4 == 0, "LED,PNRR").when(k % 4 == 1, "accordo quadro,sopra soglia UE")
            .when(k % 4 == 2, "PPP").alias("tag_tecnico"),
            F.lit("L2").alias("validation_level"),
            F.lit("Alta").alias("reliability_index"),
            (k % 10 == 0).alias("is_weak_evidence"),
            F.lit(None).cast("string").alias("master_record_id"),
            _utc("o_orderdate").alias("first_seen_at"),
            _utc("o_orderdate").alias("last_seen_at"),
        )
    )


_EVENT_TYPES = {
    "purchase": "Proroga",
    "error": "revoca",
    "signup": "ricorso_tar",
    "click": "chiarimento",
    "view": "avviso",
}


def record_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the history of the record numbered like their user."""
    e = load(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(v) for pair in _EVENT_TYPES.items() for v in pair])
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("procurement_record_id"),
        F.element_at(kind, F.col("event_type")).alias("event_type"),
        _utc("ts").alias("event_date"),
        F.when(
            F.col("event_type") == "signup",
            F.concat(F.lit("Ricorso n. "), F.col("event_id").cast("string")),
        ).alias("description"),
        F.lit(None).cast("string").alias("source_url"),
        _utc("ts").alias("created_at"),
    )


def anomaly_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records, moved by 23 years so that they overlap the event histories."""
    shift = [
        F.add_months(F.col(c), 12 * 23).cast("timestamp").alias(c)
        for c in ("data_pubblicazione", "first_seen_at")
    ]
    return records(spark, sf_dir).select(
        "id", "ente", "descrizione", "stato_procedurale", *shift
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sources."""
    s = load(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("id"),
        F.col("s_name").alias("name"),
        pick(("official", "eproc_portal"), k).alias("source_type"),
        pick(("anac", "ted", "asmecomm"), k).alias("platform_type"),
        F.concat(F.lit("https://s"), k.cast("string"), F.lit(".example.com")).alias("base_url"),
        (k % 9 + 1).cast("int").alias("source_priority_rank"),
        (k % 6 != 0).alias("active"),
        F.lit(None).cast("timestamp").alias("last_checked_at"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs of the source numbered like their user."""
    e = load(spark, sf_dir, "events")
    k = F.col("event_id")
    status = {"error": "failed", "view": "success", "click": "success", "purchase": "partial"}
    named = F.create_map(*[F.lit(v) for pair in status.items() for v in pair])
    return e.select(
        k.alias("id"),
        F.concat(F.lit("collect_"), F.col("event_type")).alias("job_name"),
        F.when(k % 50 != 0, F.col("user_id")).alias("source_id"),
        F.coalesce(F.try_element_at(named, F.col("event_type")), F.lit("running")).alias("status"),
        _utc("ts").alias("started_at"),
        (k % 40).cast("int").alias("records_found"),
        (k % 7).cast("int").alias("records_valid"),
        (k % 3).cast("int").alias("records_weak"),
        (k % 5).cast("int").alias("duplicates_removed"),
        F.when(F.col("event_type") == "error", F.lit("Timeout")).alias("error_message"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier alerts: every event opened one for its record."""
    e = load(spark, sf_dir, "events")
    k = F.col("event_id")
    kind = pick(
        ("proroga_multipla", "ricorso_tar", "stato_stallo", "revoca_post_pubblicazione"),
        F.col("user_id"),
    )
    key = F.concat(kind, F.lit(":"), F.col("user_id").cast("string"))
    return e.select(
        k.alias("id"),
        F.col("user_id").alias("procurement_record_id"),
        kind.alias("alert_type"),
        pick(("low", "medium", "high", "critical"), k).alias("severity"),
        F.concat(F.lit("[key:"), key, F.lit("] testo")).alias("description"),
        (k % 15 == 0).alias("is_open"),
        _utc("ts").alias("opened_at"),
        F.lit(None).cast("timestamp").alias("closed_at"),
    )


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_records_of(load(spark, sf_dir, "orders", busy=True))


def raw_records_of(o: DataFrame) -> DataFrame:
    """Orders as raw records: repeated links, shared CIGs, gaps, several spellings of a value.

    Works on a stream of orders too.
    """
    k = F.col("o_orderkey")
    cust = F.col("o_custkey").cast("string")
    money = F.col("o_totalprice").cast("decimal(18,2)") * 20
    italian = F.concat(
        F.lit("€ "), F.translate(F.format_number(money, 2), ",.", ".,")
    )
    deadline = _day_shift(_utc("o_orderdate"), (k % 60).cast("int"))
    doc = F.to_json(
        F.struct(
            F.when(k % 3 == 0, F.concat(F.lit("Comune n. "), cust)).alias("ente"),
            F.when(k % 3 == 1, F.array(F.lit(" "), F.concat(F.lit(" Ente "), cust))).alias("buyer"),
            F.when(k % 7 == 0, F.lit("Provincia")).alias("amministrazione_titolare"),
            F.when(k % 5 == 0, F.concat(F.lit(" c"), F.lpad(cust, 9, "0")))
            .when(k % 5 == 1, F.lit("not-a-cig")).alias("cig"),
            F.when(k % 4 == 0, italian).when(k % 4 == 1, F.lit("n.d.")).alias("importo"),
            F.when(k % 4 == 2, money.cast("string")).alias("valore"),
            F.when(k % 6 < 4, F.date_format(deadline, "d/M/yyyy"))
            .when(k % 6 == 4, F.date_format(deadline, "yyyy-MM-dd")).alias("scadenza"),
            F.when(k % 9 == 0, F.lit("Procedura in concessione")).alias("procedura"),
            F.when(k % 8 < 4, pick(INSTRUMENTS, k)).alias("tipo_strumento"),
            F.when(k % 10 == 3, pick(("determina", "notizia"), F.floor(k / 10))).alias("atto_tipo"),
            F.when(k % 2 == 0, F.concat(F.lit("Regione "), (k % 20).cast("string"))).alias("regione"),
            F.when(k % 12 == 6, F.lit(True)).alias("perimeter_prevalidated"),
        )
    )
    return o.select(
        k.alias("id"),
        (k % 130).alias("source_id"),
        F.when(k % 17 != 0, pick(TITLES, k)).alias("raw_title"),
        F.when(k % 13 != 0, pick(BODIES, F.floor(k / 11))).alias("raw_body"),
        F.concat(
            F.lit("https://notices.example.com/"), cust, F.lit("/"), (k % 3).cast("string")
        ).alias("raw_url"),
        _utc("o_orderdate").alias("raw_date"),
        doc.alias("extracted_json"),
        _utc("o_orderdate").alias("fetched_at"),
        F.lit(None).cast("timestamp").alias("normalized_at"),
    )


# ---- a record table and a batch that meets it in every way ---------------------------------------


def current_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third record as the stored table."""
    third = records(spark, sf_dir).filter(F.col("id") % 3 == 0)
    have = set(third.columns)
    return third.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in S.StructType.fromDDL(schemas.RECORD)
        ]
    )


def notice_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other records as notices: known links, links shared by three, shared CIGs."""
    k = F.col("id")
    customer_cig = F.concat(F.lit("C"), F.lpad(F.substring("ente", 10, 9), 9, "0"))
    known, lone = k % 3 == 1, (k % 3 == 2) & (k % 7 == 0)
    text = k.cast("string")
    site = F.lit("https://notices.example.com/")
    group = F.floor(k / 9).cast("string")
    return records(spark, sf_dir).filter(k % 3 != 0).select(
        k.alias("raw_id"),
        F.col("data_pubblicazione").alias("fetched_at"),
        "source_priority_rank",
        F.when(known, F.concat(site, F.lit("t/"), (k - 1).cast("string")))
        .when(lone, F.concat(site, F.lit("u/"), text))
        .otherwise(F.concat(site, F.lit("n/"), group)).alias("link_bando"),
        F.when(k % 2 == 0, F.col("descrizione")).alias("descrizione"),
        F.when(k % 4 != 1, F.col("data_pubblicazione")).alias("data_pubblicazione"),
        F.when(k % 5 != 4, F.col("scadenza")).alias("scadenza"),
        F.when(k % 8 < 4, F.lit("aperta")).alias("tipologia_gara_procedura"),
        F.when(k % 5 == 1, pick(INSTRUMENTS, k)).alias("tipo_strumento"),
        "regione",
        "provincia",
        F.when(k % 2 == 1, F.concat(F.lit("Comune "), text)).alias("comune"),
        F.when(known & (k % 5 == 2), F.concat(F.lit("X"), F.lpad(text, 9, "0")))
        .when(lone, customer_cig)
        .when((k % 3 == 2) & (k % 5 == 3), F.concat(F.lit("Y"), F.lpad(group, 9, "0")))
        .alias("cig"),
        F.when(k % 6 == 1, F.lit(0).cast("decimal(18,2)"))
        .when(k % 6 != 2, F.col("importo")).alias("importo"),
        F.array_compact(
            F.array(
                F.when(k % 4 == 0, "PPP"), F.when(k % 5 == 0, "LED"), F.when(k % 6 == 1, "PNRR")
            )
        ).alias("tag_tecnico"),
        *R.FLAGS,
        "stato_procedurale",
        pick(("Alta", "Media", "Bassa"), k).alias("reliability_index"),
        "macrosettore",
        pick(("L1", "L2", "L3"), F.floor(k / 3)).alias("validation_level"),
        "is_weak_evidence",
        "ente",
    )
