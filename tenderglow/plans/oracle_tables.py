"""The adapter tables once more, as SQL common table expressions."""

from __future__ import annotations

from collections.abc import Sequence

from tenderglow import rules as R
from tenderglow.plans import adapters as A


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values: Sequence[str], index: str) -> str:
    """Value number ``index`` modulo the list length."""
    return f"([{', '.join(text(v) for v in values)}])[({index}) % {len(values)} + 1]"


def hit(column: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({column}, {text(pattern)}, 'i'), false)"


def points(column: str, scope: R.ScopeRules = R.ScopeRules()) -> str:
    parts = [
        f"CASE WHEN contains(lower({column}), {text(p)}) THEN {w} ELSE 0 END"
        for phrases, w in ((scope.include, scope.include_points), (scope.exclude, scope.exclude_points))
        for p in phrases
    ]
    if scope.codes:
        parts.append(f"CASE WHEN {code(column, scope.codes)} THEN {scope.code_points} ELSE 0 END")
    return "(" + " + ".join(parts) + ")"


def code(column: str, codes: Sequence[str] = R.SCOPE_CODES) -> str:
    """Any 8-digit token of the text is in the list."""
    tokens = f"regexp_extract_all({column}, '\\b(\\d{{8}})(?:-\\d)?\\b', 1)"
    wanted = ", ".join(text(c) for c in codes)
    return f"coalesce(list_has_any({tokens}, [{wanted}]), false)"


def tag_list(column: str, amount: str, rules: R.TagRules = R.TagRules()) -> str:
    """Tags in rule order, comma-joined; empty text when none."""
    parts = [f"CASE WHEN {hit(column, p)} THEN {text(l)} END" for l, p in rules.patterns]
    parts.append(f"CASE WHEN {amount} > {rules.threshold} THEN {text(rules.threshold_tag)} END")
    return f"concat_ws(',', {', '.join(parts)})"


def flag_columns(column: str, patterns=R.FLAG_PATTERNS) -> str:
    return ", ".join(
        f"CASE WHEN {hit(column, p)} THEN 'Yes' ELSE 'No' END AS {name}" for name, p in patterns
    )


def state_case(column: str, act: str, rules: R.StateRules = R.StateRules()) -> str:
    return (
        f"CASE WHEN {act} <> {text(rules.news_act)} AND {act} <> '' THEN {text(R.PRE_TENDER)} "
        f"WHEN {hit(column, rules.outcome)} THEN {text(R.OUTCOME)} "
        f"WHEN {hit(column, rules.amended)} THEN {text(R.AMENDED)} "
        f"WHEN {hit(column, rules.pre_tender)} THEN {text(R.PRE_TENDER)} "
        f"ELSE {text(R.PUBLISHED)} END"
    )


NOW = "TIMESTAMP '2001-07-15 12:00:00'"
EVENTS_NOW = "TIMESTAMP '2024-01-31 00:00:00'"

_STATES = (R.PUBLISHED, R.AMENDED, R.PRE_TENDER, R.OUTCOME)
_FLAGS = ", ".join(
    f"CASE WHEN o_orderkey % {n + 2} = 0 THEN 'Yes' ELSE 'No' END AS {flag}"
    for n, flag in enumerate(R.FLAGS)
)

RECORDS = f"""
records AS (
  SELECT o_orderkey AS id, CAST(o_orderkey % 8 AS INT) AS source_priority_rank,
    o_orderdate AS data_pubblicazione,
    {listed(A.TITLES, 'o_orderkey')} || ' ' || o_orderpriority AS descrizione,
    c_name AS ente,
    CASE WHEN o_orderkey % 11 <> 0
      THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 20 AS DECIMAL(18,2)) END AS importo,
    n_name AS provincia, r_name AS regione,
    {listed(('aperta', 'negoziata', 'ristretta'), 'o_orderkey')} AS tipologia_gara_procedura,
    o_orderdate + to_days(CAST(o_orderkey % 60 AS INT)) AS scadenza,
    CASE WHEN o_orderkey % 5 = 0
      THEN 'C' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS cig,
    'https://notices.example.com/t/' || o_orderkey AS link_bando,
    CASE o_orderstatus
      WHEN 'P' THEN {listed((R.PRE_TENDER, R.AMENDED), 'o_orderkey')}
      WHEN 'F' THEN {listed((R.OUTCOME, R.PUBLISHED), 'o_orderkey')}
      ELSE {listed(_STATES, 'o_orderkey')} END AS stato_procedurale,
    {listed(R.NOVELTIES, 'o_orderkey')} AS tipo_novita,
    {_FLAGS},
    CASE o_orderkey % 4 WHEN 0 THEN 'LED,PNRR' WHEN 1 THEN 'accordo quadro,sopra soglia UE'
      WHEN 2 THEN 'PPP' END AS tag_tecnico,
    o_orderkey % 10 = 0 AS is_weak_evidence,
    o_orderdate AS first_seen_at, o_orderdate AS last_seen_at
  FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

KEYED = RECORDS + """,
keyed AS (
  SELECT *, CASE WHEN cig IS NOT NULL AND cig <> '' THEN 'cig:' || upper(cig)
    ELSE 'eo:' || substr(lower(trim(ente)), 1, 28) || '|' || substr(lower(trim(descrizione)), 1, 38)
      || '|' || coalesce(
        CAST(CAST(round_even(CAST(importo AS DOUBLE) / 50000, 0) * 50000 AS BIGINT) AS VARCHAR), 'x')
    END AS dedup_key
  FROM records
)"""

ELECTED = KEYED + """,
elected AS (
  SELECT *, CASE WHEN rn > 1 THEN best END AS master_record_id FROM (
    SELECT *,
      row_number() OVER w AS rn, first_value(id) OVER w AS best
    FROM keyed
    WINDOW w AS (PARTITION BY dedup_key ORDER BY
      CASE WHEN source_priority_rank = 0 THEN 999 ELSE source_priority_rank END,
      first_seen_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
)"""

SCORED = ELECTED + f""",
parts AS (
  SELECT *,
    date_diff('day', CAST({NOW} AS DATE), CAST(scadenza AS DATE)) AS days,
    CASE WHEN importo > 10000000 THEN 35 WHEN importo > 5000000 THEN 28
      WHEN importo > 2000000 THEN 20 WHEN importo > 1000000 THEN 14
      WHEN importo > 500000 THEN 8 ELSE 3 END AS amount_points,
    CASE WHEN stato_procedurale = 'GARA PUBBLICATA' THEN 25
      WHEN stato_procedurale LIKE 'RETTIFICA%' THEN 20
      WHEN stato_procedurale = 'PRE-GARA' THEN
        CASE WHEN regexp_matches(lower(descrizione), 'delibera|determina|avviso preinformazione')
          THEN 20 ELSE 8 END
      WHEN stato_procedurale LIKE 'ESITO%' THEN 10 ELSE 0 END AS state_points,
    CASE WHEN flag_ppp_doppio_oggetto = 'Yes' THEN 8 ELSE 0 END
      + CASE WHEN list_contains(string_split(tag_tecnico, ','), 'PNRR') THEN 6 ELSE 0 END
      + CASE WHEN list_contains(string_split(tag_tecnico, ','), 'sopra soglia UE') THEN 4 ELSE 0 END
      + CASE WHEN tag_tecnico LIKE '%accordo%' OR tag_tecnico LIKE '%global%' THEN 3 ELSE 0 END
      AS bonus_points
  FROM elected
),
summed AS (
  SELECT *,
    CASE WHEN days <= 3 THEN 20 WHEN days <= 7 THEN 15 WHEN days <= 15 THEN 10
      WHEN days <= 30 THEN 5 ELSE 0 END AS deadline_points
  FROM parts
),
scored AS (
  SELECT *, amount_points + state_points + deadline_points + bonus_points AS score_commerciale,
    CASE WHEN amount_points + state_points + deadline_points + bonus_points >= 70
        OR (importo > 5000000 AND stato_procedurale = 'GARA PUBBLICATA')
        OR days BETWEEN 0 AND 2 THEN 'P1'
      WHEN amount_points + state_points + deadline_points + bonus_points >= 50 THEN 'P2'
      WHEN amount_points + state_points + deadline_points + bonus_points >= 30 THEN 'P3'
      ELSE 'P4' END AS priorita_commerciale
  FROM summed
)"""

EVENTS = """
rec_events AS (
  SELECT event_id AS id, user_id AS procurement_record_id,
    CASE event_type WHEN 'purchase' THEN 'Proroga' WHEN 'error' THEN 'revoca'
      WHEN 'signup' THEN 'ricorso_tar' WHEN 'click' THEN 'chiarimento' ELSE 'avviso' END AS event_type,
    ts AS event_date,
    CASE WHEN event_type = 'signup' THEN 'Ricorso n. ' || event_id END AS description
  FROM events
)"""

ANOMALY_RECORDS = RECORDS + """,
arecords AS (
  SELECT id, ente, descrizione, stato_procedurale,
    data_pubblicazione + INTERVAL 276 MONTH AS data_pubblicazione,
    first_seen_at + INTERVAL 276 MONTH AS first_seen_at
  FROM records
)"""

SOURCES = f"""
sources AS (
  SELECT s_suppkey AS id, s_name AS name,
    {listed(('official', 'eproc_portal'), 's_suppkey')} AS source_type,
    {listed(('anac', 'ted', 'asmecomm'), 's_suppkey')} AS platform_type,
    'https://s' || s_suppkey || '.example.com' AS base_url,
    CAST(s_suppkey % 9 + 1 AS INT) AS source_priority_rank, s_suppkey % 6 <> 0 AS active
  FROM supplier
)"""

RUNS = """
runs AS (
  SELECT event_id AS id, 'collect_' || event_type AS job_name,
    CASE WHEN event_id % 50 <> 0 THEN user_id END AS source_id,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'success'
      WHEN 'click' THEN 'success' WHEN 'purchase' THEN 'partial' ELSE 'running' END AS status,
    ts AS started_at,
    CAST(event_id % 40 AS INT) AS records_found, CAST(event_id % 7 AS INT) AS records_valid,
    CAST(event_id % 3 AS INT) AS records_weak, CAST(event_id % 5 AS INT) AS duplicates_removed,
    CASE WHEN event_type = 'error' THEN 'Timeout' END AS error_message
  FROM events
)"""

ALERTS = f"""
alerts AS (
  SELECT event_id AS id, user_id AS procurement_record_id,
    {listed(('proroga_multipla', 'ricorso_tar', 'stato_stallo', 'revoca_post_pubblicazione'), 'user_id')}
      AS alert_type,
    {listed(('low', 'medium', 'high', 'critical'), 'event_id')} AS severity,
    event_id % 15 = 0 AS is_open, ts AS opened_at
  FROM events
),
alert_keys AS (SELECT *, alert_type || ':' || procurement_record_id AS alert_key FROM alerts)"""

RAW = f"""
raw AS (
  SELECT o_orderkey AS id, o_custkey, o_orderkey % 130 AS source_id,
    CASE WHEN o_orderkey % 17 <> 0 THEN {listed(A.TITLES, 'o_orderkey')} END AS raw_title,
    CASE WHEN o_orderkey % 13 <> 0 THEN {listed(A.BODIES, 'o_orderkey // 11')} END AS raw_body,
    'https://notices.example.com/' || o_custkey || '/' || (o_orderkey % 3) AS raw_url,
    o_orderdate AS raw_date, o_orderdate AS fetched_at,
    o_orderdate + to_days(CAST(o_orderkey % 60 AS INT)) AS deadline,
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 20 AS DECIMAL(18,2)) AS money
  FROM orders
),
texts AS (SELECT *, concat_ws(' ', raw_title, raw_body) AS x FROM raw)"""

NOTICES = RAW + "," + SOURCES + f""",
fields AS (
  SELECT t.id AS raw_id, fetched_at, x, raw_body, raw_title AS descrizione, raw_url AS link_bando,
    CASE id % 3 WHEN 0 THEN 'Comune n. ' || o_custkey WHEN 1 THEN 'Ente ' || o_custkey END AS buyer,
    CASE WHEN id % 7 = 0 THEN 'Provincia' END AS late_buyer,
    CASE WHEN id % 5 = 0 THEN 'C' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS cig,
    CASE WHEN id % 4 IN (0, 2) THEN money END AS importo,
    raw_date AS data_pubblicazione,
    CASE WHEN id % 6 < 5 THEN deadline END AS scadenza,
    CASE WHEN id % 9 = 0 THEN 'Procedura in concessione' END AS procedura,
    CASE WHEN id % 8 < 4 THEN trim({listed(A.INSTRUMENTS, 'id')}) END AS strumento,
    CASE WHEN id % 10 = 3 THEN {listed(('determina', 'notizia'), 'id // 10')} END AS atto,
    CASE WHEN id % 2 = 0 THEN 'Regione ' || (id % 20) END AS regione,
    coalesce((SELECT max(s.source_priority_rank) FROM sources s WHERE s.id = t.source_id), 999) AS rank
  FROM texts t
  WHERE id % 12 = 6 OR {points('x')} >= 1
),
notices AS (
  SELECT *,
    coalesce(lower(strumento) IN ('accordo quadro', 'convenzione',
      'sistema dinamico di acquisizione', 'sda'), false) AS framework,
    importo IS NOT NULL OR cig IS NOT NULL OR scadenza IS NOT NULL OR procedura IS NOT NULL AS known,
    {tag_list('x', 'importo')} AS tags,
    {flag_columns("(x || ' ' || coalesce(procedura, ''))")},
    {state_case("concat_ws(' ', descrizione, raw_body, atto)", 'atto')} AS stato_procedurale,
    CASE WHEN rank <= 3 THEN 'Alta' WHEN rank <= 5 THEN 'Media' ELSE 'Bassa' END AS reliability_index
  FROM fields
),
typed AS (
  SELECT *,
    CASE WHEN cig IS NOT NULL AND importo <> 0 THEN 'L3' WHEN known THEN 'L2' ELSE 'L1' END
      AS validation_level,
    coalesce(buyer, late_buyer,
      CASE WHEN framework THEN 'Strumento quadro multi-ente (' || strumento || ')' END, 'n.d.') AS ente,
    NOT ((buyer IS NOT NULL OR framework) AND descrizione IS NOT NULL AND known)
      OR (buyer IS NULL AND late_buyer IS NULL AND NOT framework) AS is_weak_evidence
  FROM notices
)"""

_BATCH_FLAGS = ", ".join(R.FLAGS)

BATCH = RECORDS + f""",
current AS (SELECT * FROM records WHERE id % 3 = 0),
batch AS (
  SELECT id AS raw_id, strftime(data_pubblicazione, '%Y%m%d') || lpad(CAST(id AS VARCHAR), 12, '0') AS seq,
    source_priority_rank,
    'https://notices.example.com/' || CASE WHEN id % 3 = 1 THEN 't/' || (id - 1)
      WHEN id % 7 = 0 THEN 'u/' || id ELSE 'n/' || (id // 9) END AS link_bando,
    CASE WHEN id % 2 = 0 THEN descrizione END AS descrizione,
    CASE WHEN id % 4 <> 1 THEN data_pubblicazione END AS data_pubblicazione,
    CASE WHEN id % 5 <> 4 THEN scadenza END AS scadenza,
    CASE WHEN id % 8 < 4 THEN 'aperta' END AS procedura,
    CASE WHEN id % 5 = 1 THEN {listed(A.INSTRUMENTS, 'id')} END AS strumento,
    regione, provincia, CASE WHEN id % 2 = 1 THEN 'Comune ' || id END AS comune,
    CASE WHEN id % 3 = 1 AND id % 5 = 2 THEN 'X' || lpad(CAST(id AS VARCHAR), 9, '0')
      WHEN id % 3 = 2 AND id % 7 = 0 THEN 'C' || lpad(substr(ente, 10, 9), 9, '0')
      WHEN id % 3 = 2 AND id % 5 = 3 THEN 'Y' || lpad(CAST(id // 9 AS VARCHAR), 9, '0') END AS cig,
    CASE WHEN id % 6 = 1 THEN 0 WHEN id % 6 <> 2 THEN importo END AS importo,
    id % 4 = 0 AS ppp, id % 5 = 0 AS led, id % 6 = 1 AS pnrr,
    {_BATCH_FLAGS}, stato_procedurale,
    {listed(('Alta', 'Media', 'Bassa'), 'id')} AS reliability_index,
    {listed(('L1', 'L2', 'L3'), 'id // 3')} AS validation_level, is_weak_evidence, ente
  FROM records WHERE id % 3 <> 0
),
-- A lone link joins the oldest current record of its CIG, else the first lone link of that CIG.
cig_current AS (
  SELECT cig, id FROM (
    SELECT cig, id, row_number() OVER (PARTITION BY cig ORDER BY first_seen_at, id) AS rn
    FROM current WHERE cig IS NOT NULL) WHERE rn = 1
),
cig_first AS (
  SELECT cig, arg_min(link_bando, seq) AS link FROM batch WHERE cig LIKE 'C%' GROUP BY cig
),
placed AS (
  SELECT b.*, CASE WHEN raw_id % 3 = 1 THEN CAST(raw_id - 1 AS VARCHAR)
    WHEN c.id IS NOT NULL THEN CAST(c.id AS VARCHAR)
    WHEN f.link IS NOT NULL THEN sha256('record|' || f.link)
    ELSE sha256('record|' || b.link_bando) END AS target_id
  FROM batch b LEFT JOIN cig_current c ON b.cig = c.cig AND b.cig LIKE 'C%'
    LEFT JOIN cig_first f ON b.cig = f.cig
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY seq) AS rn,
    count(*) OVER (PARTITION BY target_id) AS n,
    row_number() OVER (PARTITION BY target_id ORDER BY seq DESC) AS from_end
  FROM placed
),
folded AS (
  SELECT target_id, max(n) AS n,
    arg_min(descrizione, seq) AS descrizione, arg_min(cig, seq) AS cig,
    arg_min(data_pubblicazione, seq) AS data_pubblicazione, arg_min(scadenza, seq) AS scadenza,
    arg_min(procedura, seq) AS procedura, arg_min(strumento, seq) AS strumento,
    arg_min(comune, seq) AS comune, arg_min(CASE WHEN importo <> 0 THEN importo END, seq) AS importo,
    max(CASE WHEN rn = 1 THEN importo END) AS first_importo,
    max(CASE WHEN rn = 1 THEN data_pubblicazione END) AS first_published,
    max(CASE WHEN rn = 1 THEN ente END) AS ente, max(CASE WHEN rn = 1 THEN link_bando END) AS link,
    max(CASE WHEN rn = 1 THEN source_priority_rank END) AS rank,
    bool_or(rn = 1 AND is_weak_evidence) AS weak,
    max(CASE WHEN from_end = 1 THEN stato_procedurale END) AS stato_procedurale,
    max(CASE WHEN from_end = 1 THEN reliability_index END) AS reliability_index,
    max(validation_level) AS validation_level,
    {', '.join(f'max({f}) AS {f}' for f in R.FLAGS)},
    bool_or(ppp) AS ppp, bool_or(led) AS led, bool_or(pnrr) AS pnrr,
    sum(CASE WHEN ppp OR led OR pnrr THEN 1 ELSE 0 END) AS n_tagged,
    max(CASE WHEN rn = 1 THEN concat_ws(',', CASE WHEN ppp THEN 'PPP' END,
      CASE WHEN led THEN 'LED' END, CASE WHEN pnrr THEN 'PNRR' END) END) AS first_tags
  FROM numbered GROUP BY target_id
)"""

# Where the notices of RAW go when no record is stored yet. A CIG belongs to one customer here: its
# first notice holds it, later ones with that CIG join unless their own link is open by then.
PLACED_RAW = NOTICES + """,
ordered AS (
  SELECT *, strftime(fetched_at, '%Y%m%d') || lpad(CAST(raw_id AS VARCHAR), 12, '0') AS seq FROM typed
),
held AS (
  SELECT cig, min(seq) AS held_from, arg_min(link_bando, seq) AS held_link
  FROM ordered WHERE cig IS NOT NULL GROUP BY cig
),
joined AS (
  SELECT o.*, held_link, coalesce(seq > held_from, false) AS joins
  FROM ordered o LEFT JOIN held h ON o.cig = h.cig
),
opened AS (SELECT link_bando, min(seq) AS opened_at FROM joined WHERE NOT joins GROUP BY link_bando),
goes AS (
  SELECT j.*, CASE WHEN seq >= opened_at THEN j.link_bando ELSE held_link END AS target_link
  FROM joined j LEFT JOIN opened o ON j.link_bando = o.link_bando
),
counted AS (
  SELECT *, row_number() OVER (PARTITION BY target_link ORDER BY seq) AS rn,
    row_number() OVER (PARTITION BY target_link ORDER BY seq DESC) AS from_end,
    count(*) OVER (PARTITION BY target_link) AS n
  FROM goes
),
merged AS (
  SELECT target_link AS link_bando, max(CASE WHEN rn = 1 THEN ente END) AS ente,
    arg_min(descrizione, seq) AS descrizione, arg_min(cig, seq) AS cig,
    coalesce(max(CASE WHEN rn = 1 THEN importo END),
      arg_min(CASE WHEN importo <> 0 THEN importo END, seq)) AS importo,
    max(CASE WHEN rn = 1 THEN rank END) AS rank, max(validation_level) AS validation_level,
    max(flag_om) AS flag_om, max(CASE WHEN from_end = 1 THEN stato_procedurale END) AS stato_procedurale,
    CASE WHEN max(CASE WHEN from_end = 1 THEN stato_procedurale END) = 'PRE-GARA'
        THEN 'Segnale pre-gara'
      WHEN max(n) > 1 THEN 'Aggiornamento gara nota'
      WHEN max(CASE WHEN rn = 1 THEN data_pubblicazione END) < DATE '2001-07-15'
        THEN 'Nuovo emerso oggi ma pubblicato prima' ELSE 'Nuovo oggi' END AS tipo_novita
  FROM counted GROUP BY target_link
)"""
