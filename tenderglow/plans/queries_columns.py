"""Queries over single columns: scope, tags, flags, state, amounts, dates, identifiers, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderglow import rules as R
from tenderglow.functions import jsonvals as J
from tenderglow.functions import text as T
from tenderglow.functions import values as V
from tenderglow.operators.landing import draft_text
from tenderglow.operators.normalise import novelty
from tenderglow.plans import adapters as A
from tenderglow.plans import oracle_tables as O
from tenderglow.plans.registry import query

# The given documents are invented prose, so their rules use syllables that occur in it.
DOC_SCOPE = R.ScopeRules(
    include=("ent", "tion", "der", "que ", "ß", "é"), exclude=("sch", "ouz"), codes=("12345678",)
)
DOC_TAGS = R.TagRules(
    patterns=(("nt", r"[aeiou]nt"), ("es", r"é[a-z]|ss"), ("the", r"the\s+th"), ("und", r"und|et ")),
    threshold_tag="lungo",
    threshold=2000,
)
DOC_FLAGS = (("flag_a", r"ation"), ("flag_b", r"\d{3}"), ("flag_c", r"qu[ei]\s"))
DOC_STATE = R.StateRules(outcome="schw|ungen", amended="ouo|eau", pre_tender="ther")


@query(f"""
SELECT doc_id, {O.points('text', DOC_SCOPE)} AS score, {O.code('text', DOC_SCOPE.codes)} AS code_match,
  {O.points('text', DOC_SCOPE)} >= 1 AS in_scope
FROM documents
""")
def scope_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.load(spark, sf_dir, "documents", busy=True)
    s = T.scope_detail(F.col("text"), DOC_SCOPE)
    return docs.select("doc_id", s.alias("s")).select(
        "doc_id", "s.score", "s.code_match", "s.in_scope"
    )


_INCLUDE_HITS = "concat_ws(';', " + ", ".join(
    f"CASE WHEN contains(lower(x), {O.text(p)}) THEN {O.text(p)} END" for p in R.SCOPE_INCLUDE
) + ")"


@query(f"""
WITH {O.RAW}
SELECT id, {O.points('x')} AS score, {_INCLUDE_HITS} AS include_hits, {O.code('x')} AS code_match,
  {O.points('x')} >= 1 AS in_scope
FROM texts
""")
def scope_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = A.raw_records(spark, sf_dir).select("id", T.scope_detail(draft_text()).alias("s"))
    return raw.select(
        "id", "s.score", F.array_join("s.include_hits", ";").alias("include_hits"),
        "s.code_match", "s.in_scope",
    )


@query(f"SELECT doc_id, {O.tag_list('text', 'n_chars', DOC_TAGS)} AS tags FROM documents")
def tag_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.load(spark, sf_dir, "documents", busy=True)
    tags = T.tags(F.col("text"), F.col("n_chars"), DOC_TAGS)
    return docs.select("doc_id", F.array_join(tags, ",").alias("tags"))


@query(f"WITH {O.RAW} SELECT id, {O.tag_list('x', 'money')} AS tags FROM texts")
def tag_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = A.raw_records(spark, sf_dir)
    orders = A.load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_totalprice").cast("decimal(18,2)") * 20).alias("m")
    )
    tags = T.tags(draft_text(), F.col("m"))
    return raw.join(orders, "id").select("id", F.array_join(tags, ",").alias("tags"))


@query(f"SELECT doc_id, {O.flag_columns('text', DOC_FLAGS)} FROM documents")
def flag_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.load(spark, sf_dir, "documents", busy=True)
    flags = T.flags(F.col("text"), DOC_FLAGS)
    return docs.select("doc_id", *[c.alias(n) for n, c in flags.items()])


@query(f"WITH {O.RAW} SELECT id, {O.flag_columns('x')} FROM texts")
def flag_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = A.raw_records(spark, sf_dir)
    return raw.select("id", *[c.alias(n) for n, c in T.flags(draft_text()).items()])


@query(f"""
SELECT doc_id, {O.state_case('text', "CASE WHEN doc_id % 9 = 0 THEN 'notizia' END", DOC_STATE)} AS state
FROM documents
""")
def state_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.load(spark, sf_dir, "documents", busy=True)
    act = F.when(F.col("doc_id") % 9 == 0, "notizia")
    return docs.select("doc_id", T.state(F.col("text"), act, DOC_STATE).alias("state"))


@query(f"""
WITH {O.RAW}
SELECT id, {O.state_case('x', "CASE id % 10 WHEN 3 THEN 'determina' WHEN 4 THEN 'notizia' END")} AS state
FROM texts
""")
def state_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    act = F.when(F.col("id") % 10 == 3, "determina").when(F.col("id") % 10 == 4, "notizia")
    return A.raw_records(spark, sf_dir).select("id", T.state(draft_text(), act).alias("state"))


@query(f"""
WITH {O.RECORDS}
SELECT id, CASE WHEN stato_procedurale = 'PRE-GARA' THEN 'Segnale pre-gara'
  WHEN id % 3 = 0 THEN 'Aggiornamento gara nota'
  WHEN id % 2 = 0 AND data_pubblicazione < DATE '2001-07-15'
    THEN 'Nuovo emerso oggi ma pubblicato prima'
  ELSE 'Nuovo oggi' END AS novelty
FROM records
""")
def novelty_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    seen = F.when(k % 2 == 0, V.at(A.RECORDS_NOW)).otherwise(F.col("first_seen_at"))
    return A.records(spark, sf_dir).select(
        "id",
        novelty(
            F.col("stato_procedurale"), k % 3 == 0, seen, F.col("data_pubblicazione"), A.RECORDS_NOW
        ).alias("novelty"),
    )


@query("""
SELECT o_orderkey AS id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS from_italian,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS from_plain,
  CAST(floor(o_totalprice) AS DOUBLE) AS from_grouped,
  CAST(NULL AS DOUBLE) AS from_negative,
  -CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS from_number,
  CAST(NULL AS DOUBLE) AS from_words
FROM orders
""")
def amount_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = A.load(spark, sf_dir, "orders", busy=True)
    price = F.col("o_totalprice").cast("decimal(18,2)")
    shown = F.translate(F.format_number(price, 2), ",.", ".,")
    whole = F.translate(F.format_number(F.floor(price), 0), ",", ".")
    words = F.when(F.col("o_orderkey") % 3 == 0, " N.D. ").when(
        F.col("o_orderkey") % 3 == 1, "abc"
    ).otherwise("")

    def parsed(c) -> Column:
        return V.amount(c).cast("double")

    return orders.select(
        F.col("o_orderkey").alias("id"),
        parsed(F.concat(F.lit(" € "), shown)).alias("from_italian"),
        parsed(price.cast("string")).alias("from_plain"),
        parsed(whole).alias("from_grouped"),
        parsed(F.concat(F.lit("-"), shown)).alias("from_negative"),
        V.numeric_amount(-price).cast("double").alias("from_number"),
        parsed(words).alias("from_words"),
    )


@query("""
SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS italian,
  strftime(o_orderdate, '%Y-%m-%d') AS iso_day,
  strftime(o_orderdate + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS iso_zoned,
  CASE WHEN day(o_orderdate) <= 12 THEN strftime(make_date(year(o_orderdate),
    CAST(day(o_orderdate) AS INT), 1), '%Y-%m-%d') END AS swapped,
  strftime(o_orderdate, '%Y-%m-%d') AS dashed, strftime(o_orderdate, '%Y-%m-%d') AS compact,
  strftime(o_orderdate + INTERVAL 10 HOUR, '%Y-%m-%d %H:%M:%S') AS rss
FROM orders
""")
def date_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = A.load(spark, sf_dir, "orders", busy=True)
    day = F.col("o_orderdate").cast("timestamp")

    def shown(fmt: str) -> Column:
        return F.date_format(day, fmt)

    def date(c) -> Column:
        return F.date_format(c, "yyyy-MM-dd")

    def moment(c) -> Column:
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")

    return orders.select(
        F.col("o_orderkey").alias("id"),
        date(V.it_date(F.concat(F.lit(" scade il "), shown("d/M/yyyy"), F.lit(" ore 12")))).alias(
            "italian"
        ),
        date(V.it_date(shown("yyyy-MM-dd"))).alias("iso_day"),
        moment(V.it_date(F.concat(shown("yyyy-MM-dd"), F.lit("T10:00:00+0200")))).alias("iso_zoned"),
        # Day and month exchanged: impossible for days after the 12th.
        date(V.it_date(F.concat(F.lit("1/"), shown("d/yyyy")))).alias("swapped"),
        date(V.dashed_date(shown("dd-MM-yyyy"))).alias("dashed"),
        date(V.compact_date(shown("yyyyMMdd"))).alias("compact"),
        moment(
            V.rss_date(F.concat(F.lit("Wed, "), shown("d MMM yyyy"), F.lit(" 12:00:00 +0200")))
        ).alias("rss"),
    )


@query(f"""
SELECT event_id, date_diff('day', DATE '2024-01-20', CAST(ts AS DATE)) AS calendar_days,
  CAST(ceil((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-20 15:30:00')) / 86400000000.0) AS BIGINT)
    AS days_left,
  CAST(floor((epoch_us(TIMESTAMP '2024-01-20 15:30:00') - epoch_us(ts)) / 86400000000.0) AS BIGINT)
    AS whole_days
FROM events
""")
def days_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = A.EVENTS_NOW.replace(day=20, hour=15, minute=30)
    ts = F.col("ts").cast("timestamp")
    return A.load(spark, sf_dir, "events").select(
        "event_id",
        V.days_until(ts, now).alias("calendar_days"),
        V.days_left_rounded_up(ts, now).alias("days_left"),
        V.whole_days_since(ts, now).alias("whole_days"),
    )


@query("""
SELECT c_custkey, regexp_matches(upper(trim(code)), '^[A-Z0-9]{8,10}$') AS is_cig,
  regexp_matches('A' || lpad(CAST(c_custkey AS VARCHAR), 14, '0') || c_mktsegment[1],
    '^[A-Z][0-9]{14}[A-Z0-9]$') AS is_cup
FROM (SELECT *, CASE c_custkey % 4 WHEN 0 THEN ' c' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || ' '
  WHEN 1 THEN c_name WHEN 2 THEN CAST(c_custkey AS VARCHAR)
  ELSE 'ab' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') END AS code FROM customer)
""")
def cig_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, key = F.col("c_custkey"), F.col("c_custkey").cast("string")
    code = (
        F.when(k % 4 == 0, F.concat(F.lit(" c"), F.lpad(key, 8, "0"), F.lit(" ")))
        .when(k % 4 == 1, F.col("c_name"))
        .when(k % 4 == 2, key)
        .otherwise(F.concat(F.lit("ab"), F.lpad(key, 6, "0")))
    )
    cup = F.concat(F.lit("A"), F.lpad(key, 14, "0"), F.substring("c_mktsegment", 1, 1))
    return A.load(spark, sf_dir, "customer").select(
        "c_custkey", T.valid_cig(code).alias("is_cig"), T.cup_match(cup).alias("is_cup")
    )


@query("""
SELECT event_id, json_extract_string(props, '$.k') AS k,
  coalesce(CASE WHEN event_id % 2 = 0 THEN 'testo ' || event_id END,
    CASE WHEN event_id % 3 = 0 THEN 'primo' END, CAST(event_id AS VARCHAR)) AS picked,
  event_id % 4 <> 0 AS truthy
FROM events
""")
def first_str_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    doc = F.to_json(
        F.struct(
            F.when(k % 2 == 0, F.concat(F.lit("  testo "), k.cast("string"), F.lit(" ")))
            .otherwise(" ").alias("a"),
            F.when(k % 3 == 0, F.array(F.lit(""), F.lit(" primo "))).otherwise(
                F.array(F.lit(" "))
            ).alias("b"),
            k.alias("c"),
            F.when(k % 4 == 1, "false").when(k % 4 == 2, "x").when(k % 4 == 3, "0").otherwise("")
            .alias("d"),
        )
    )
    events = A.load(spark, sf_dir, "events", busy=True).select(
        "event_id", J.parsed(doc).alias("doc"), J.parsed(F.col("props")).alias("props")
    )
    return events.select(
        "event_id",
        J.first_str(J.usable_texts(F.col("props")), "absent", "k").alias("k"),
        J.first_str(J.usable_texts(F.col("doc")), "a", "b", "c").alias("picked"),
        J.truthy(F.col("doc"), "d").alias("truthy"),
    )


@query("""
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 9 = 0 THEN 'n.d.' ELSE '€' || replace(format('{:,}',
    CAST(round_even(CAST(o_totalprice AS DECIMAL(18,2)) * 20, 0) AS BIGINT)), ',', '.') END AS eur,
  '€' || replace(format('{:,}', CAST(round(CAST(o_totalprice AS DECIMAL(18,2)), 0) AS BIGINT)),
    ',', '.') AS eur_card,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso
FROM orders
""")
def format_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    return A.load(spark, sf_dir, "orders").select(
        k.alias("id"),
        V.eur(F.when(k % 9 != 0, price * 20)).alias("eur"),
        V.eur_card(price).alias("eur_card"),
        V.iso(F.col("o_orderdate").cast("timestamp")).alias("iso"),
    )


@query(f"""
WITH {O.ALERTS}
SELECT id, '[key:' || alert_key || '] testo' AS description, alert_key FROM alert_keys
""")
def alert_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws(":", "alert_type", F.col("procurement_record_id").cast("string"))
    written = A.alerts(spark, sf_dir).select(
        "id", T.alert_text(key, F.lit("testo")).alias("description")
    )
    return written.withColumn("alert_key", T.alert_key(F.col("description")))


@query("""
SELECT doc_id, md5(cleaned) AS cleaned_md5, length(cleaned) AS n
FROM (SELECT doc_id, nullif(trim(regexp_replace(text, '[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]+',
  ' ', 'g')), '') AS cleaned FROM documents)
""")
def clean_text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.load(spark, sf_dir, "documents", busy=True)
    cleaned = docs.select("doc_id", T.clean_text(F.col("text")).alias("c"))
    return cleaned.select(
        "doc_id", F.md5(F.col("c").cast("binary")).alias("cleaned_md5"), F.length("c").alias("n")
    )


@query(f"""
WITH {O.SOURCES}
SELECT id, CASE WHEN source_priority_rank <= 3 THEN 'Alta' WHEN source_priority_rank <= 5
  THEN 'Media' ELSE 'Bassa' END AS reliability FROM sources
""")
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sources(spark, sf_dir).select(
        "id", T.reliability(F.col("source_priority_rank")).alias("reliability")
    )
