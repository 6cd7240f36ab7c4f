"""The batch fold against a notice-by-notice model."""

from __future__ import annotations

import hashlib
from datetime import timedelta
from decimal import Decimal

from conftest import utc
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tenderglow import rules as R
from tenderglow import schemas
from tenderglow.operators import upsert as U
from tenderglow.session import cut_lineage

NOW = utc(2026, 4, 22, 9, 30)
GAPS = (*U.GAP_TEXTS, *U.GAP_DATES, "importo")

BATCH = (
    "raw_id INT, fetched_at TIMESTAMP, link_bando STRING, cig STRING, importo DECIMAL(18,2), "
    "descrizione STRING, regione STRING, provincia STRING, comune STRING, "
    "tipologia_gara_procedura STRING, tipo_strumento STRING, data_pubblicazione TIMESTAMP, "
    "scadenza TIMESTAMP, flag_concessione_ambito STRING, flag_ppp_doppio_oggetto STRING, "
    "flag_in_house_ambito STRING, flag_om STRING, flag_pre_gara STRING, tag_tecnico ARRAY<STRING>, "
    "stato_procedurale STRING, reliability_index STRING, validation_level STRING, "
    "is_weak_evidence BOOLEAN, ente STRING, source_priority_rank INT, macrosettore STRING"
)
BATCH_COLUMNS = [c.strip().split(" ")[0] for c in BATCH.replace("DECIMAL(18,2)", "D").split(",")]
RECORD_COLUMNS = [
    c.strip().split(" ")[0] for c in schemas.RECORD.replace("DECIMAL(18,2)", "D").split(",")
]


def record_id(link: str) -> str:
    return hashlib.sha256(f"record|{link}".encode()).hexdigest()


def targets_one_by_one(current: list[dict], batch: list[dict]) -> dict[str, list[dict]]:
    """The notices of each record, in order; only links and CIGs decide."""
    held = {r["id"]: (-1, r["first_seen_at"], r["id"], r["link_bando"], r["cig"] or None) for r in current}
    went: dict[str, list[dict]] = {}
    for step, n in enumerate(sorted(batch, key=lambda n: (n["fetched_at"], n["raw_id"]))):
        hits = [h for h in held.values() if h[3] == n["link_bando"]]
        hits = hits or [h for h in held.values() if n["cig"] and h[4] == n["cig"]]
        if hits:
            since, seen, key, link, cig = min(hits, key=lambda h: h[:3])
            if cig is None and n["cig"]:
                held[key] = (step, seen, key, link, n["cig"])
        else:
            key = record_id(n["link_bando"])
            held[key] = (step, NOW, key, n["link_bando"], n["cig"])
        went.setdefault(key, []).append(n)
    return went


def expected(old: dict | None, notices: list[dict]) -> dict:
    """A record after its notices, each column from the whole ordered list of values."""
    first, last = notices[0], notices[-1]
    said = [old, *notices] if old else notices
    # A first value stays even if it is zero; only later values must say something.
    usable = lambda c: next((x[c] for i, x in enumerate(said) if x[c] not in (None, "") and (i == 0 or x[c])), said[0][c])
    row = dict(old) if old else {c: first.get(c) for c in RECORD_COLUMNS}
    row |= {c: usable(c) for c in GAPS}
    row |= {f: R.YES if any(x[f] == R.YES for x in said) else said[0][f] for f in R.FLAGS}
    row |= {c: last[c] for c in ("stato_procedurale", "reliability_index")}
    row["validation_level"] = max(x["validation_level"] or "L1" for x in said)
    lists = [n["tag_tecnico"] for n in notices if n["tag_tecnico"]]
    kept = [t for t in ((old or {}).get("tag_tecnico") or "").split(",") if t]
    if old is None and first["tag_tecnico"] and len(lists) == 1:
        row["tag_tecnico"] = ",".join(lists[0])
    elif lists:
        row["tag_tecnico"] = ",".join(sorted({t for tags in lists for t in tags} | set(kept)))
    else:
        row["tag_tecnico"] = old["tag_tecnico"] if old else None
    published = first["data_pubblicazione"]
    row["tipo_novita"] = (
        R.PRE_TENDER_SIGNAL if last["stato_procedurale"] == R.PRE_TENDER
        else R.KNOWN_UPDATE if old or len(notices) > 1
        else R.SURFACED_TODAY if published is not None and published.date() < NOW.date()
        else R.NEW_TODAY
    )
    row["last_seen_at"] = NOW
    if old is None:
        row |= {"id": record_id(first["link_bando"]), "first_seen_at": NOW}
    return row


def apply_one_by_one(current: list[dict], batch: list[dict]) -> dict[str, dict]:
    """What should happen: who goes where is told notice by notice, the values follow from the lists."""
    stored = {r["id"]: r for r in current}
    went = targets_one_by_one(current, batch)
    return stored | {key: expected(stored.get(key), notices) for key, notices in went.items()}


words = st.sampled_from([None, "x", "y"])
days = st.sampled_from([None, utc(2026, 4, 22), utc(2026, 3, 1)])
yes_no = st.sampled_from([R.YES, R.NO])
amounts = st.sampled_from([None, Decimal("0.00"), Decimal("5.00"), Decimal("7.50")])
tag_lists = st.sampled_from([[], ["LED"], ["PPP"], ["telegestione", "PNRR"], ["manutenzione", "PPP"]])


@st.composite
def notices(draw):
    # Few links and CIGs, any CIG with any link.
    out = []
    for raw_id in range(draw(st.integers(1, 10))):
        link = draw(st.sampled_from("abcdef"))
        out.append(
            {
                "raw_id": raw_id,
                "fetched_at": utc(2026, 4, 1) + timedelta(hours=draw(st.integers(0, 3))),
                "link_bando": link,
                "cig": draw(st.sampled_from([None, "C1", "C2", "C3", "C4"])),
                "importo": draw(amounts),
                **{c: draw(words) for c in U.GAP_TEXTS if c != "cig"},
                **{c: draw(days) for c in U.GAP_DATES},
                **{f: draw(yes_no) for f in R.FLAGS},
                "tag_tecnico": draw(tag_lists),
                "stato_procedurale": draw(st.sampled_from(R.STATES)),
                "reliability_index": draw(st.sampled_from(["Alta", "Media", "Bassa"])),
                "validation_level": draw(st.sampled_from(["L1", "L2", "L3"])),
                "is_weak_evidence": draw(st.booleans()),
                "ente": draw(st.sampled_from(["E1", "E2"])),
                "source_priority_rank": draw(st.integers(1, 7)),
                "macrosettore": R.SECTOR,
            }
        )
    return out


@st.composite
def stored(draw):
    out = []
    for link in draw(st.sets(st.sampled_from("abgh"))):
        row = {c: None for c in RECORD_COLUMNS}
        row |= {
            "id": f"r{link}", "link_bando": link, "ente": "S", "cig": draw(st.sampled_from([None, "", "C1", "C4"])),
            "importo": draw(amounts), "tag_tecnico": draw(st.sampled_from([None, "LED", "zeta,PPP"])),
            "stato_procedurale": R.PUBLISHED, "tipo_novita": R.NEW_TODAY, "validation_level": "L2",
            "reliability_index": "Alta", "is_weak_evidence": False, "source_priority_rank": 1,
            "first_seen_at": utc(2026, 1, draw(st.integers(1, 3))), "last_seen_at": utc(2026, 1, 5),
            "macrosettore": R.SECTOR, **{f: R.NO for f in R.FLAGS},
            **{c: draw(st.sampled_from([None, "", "z"])) for c in U.GAP_TEXTS if c != "cig"},
            "scadenza": draw(days),
        }
        out.append(row)
    return out


def frames(spark, current, batch, partitions=2):
    left = spark.createDataFrame([tuple(n[c] for c in BATCH_COLUMNS) for n in batch], BATCH)
    right = spark.createDataFrame([tuple(r[c] for c in RECORD_COLUMNS) for r in current], schemas.RECORD)
    return left.repartition(partitions), right


def merged(spark, current, batch, **options):
    left, right = frames(spark, current, batch, options.pop("partitions", 2))
    rows = U.upsert(left, right, NOW, keep=cut_lineage, **options).collect()
    return {r.id: r.asDict() for r in rows}


def comparable(record: dict) -> dict:
    out = {}
    for name in RECORD_COLUMNS:
        value = record[name]
        if name in ("created_at", "updated_at"):
            continue
        if hasattr(value, "strftime"):
            value = value.strftime("%Y-%m-%d %H:%M:%S")
        out[name] = value
    return out


def assert_same(got: dict, wanted: dict) -> None:
    assert set(got) == set(wanted)
    for key in wanted:
        assert comparable(got[key]) == comparable(wanted[key]), key


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(stored(), notices())
def test_fold_equals_one_by_one(spark, current, batch):
    assert_same(merged(spark, current, batch), apply_one_by_one(current, batch))


def _many(seed: int, groups: int) -> tuple[list[dict], list[dict]]:
    """Several independent cases in one batch: links, CIGs and ids get the group's prefix."""
    import random

    rng = random.Random(seed)
    current, batch = [], []
    for g in range(groups):
        for link in rng.sample("abgh", rng.randint(0, 3)):
            row = {c: None for c in RECORD_COLUMNS}
            row |= {
                "id": f"{g}-r{link}", "link_bando": f"{g}-{link}", "ente": "S",
                "cig": rng.choice([None, "", f"{g}-C1", f"{g}-C4"]), "importo": rng.choice([None, Decimal("0.00")]),
                "tag_tecnico": rng.choice([None, "zeta,PPP"]), "stato_procedurale": R.PUBLISHED,
                "tipo_novita": R.NEW_TODAY, "validation_level": rng.choice([None, "L2"]),
                "reliability_index": "Alta", "is_weak_evidence": False, "source_priority_rank": 1,
                "first_seen_at": utc(2026, 1, rng.randint(1, 3)), "last_seen_at": utc(2026, 1, 5),
                "macrosettore": R.SECTOR, **{f: R.NO for f in R.FLAGS},
            }
            current.append(row)
        size = rng.choice([2, 3, 6])
        for _ in range(rng.randint(1, 16)):
            link = rng.choice("abcdef"[:size])
            batch.append(
                {
                    "raw_id": len(batch), "fetched_at": utc(2026, 4, 1, rng.randint(0, 3)),
                    "link_bando": f"{g}-{link}", "cig": rng.choice([None, *(f"{g}-C{i}" for i in range(1, rng.choice([2, 5, 7])))]),
                    "importo": rng.choice([None, Decimal("0.00"), Decimal("5.00")]),
                    **{c: rng.choice([None, "x", "y"]) for c in U.GAP_TEXTS if c != "cig"},
                    **{c: rng.choice([None, utc(2026, 4, 22), utc(2026, 3, 1)]) for c in U.GAP_DATES},
                    **{f: rng.choice([R.YES, R.NO]) for f in R.FLAGS},
                    "tag_tecnico": rng.choice([[], ["LED"], ["telegestione", "PNRR"], ["PPP"]]),
                    "stato_procedurale": rng.choice(R.STATES),
                    "reliability_index": rng.choice(["Alta", "Media", "Bassa"]),
                    "validation_level": rng.choice(["L1", "L2", "L3"]),
                    "is_weak_evidence": rng.random() < 0.5, "ente": rng.choice(["E1", "E2"]),
                    "source_priority_rank": rng.randint(1, 7), "macrosettore": R.SECTOR,
                }
            )
    return current, batch


def test_many_cases_at_once(spark):
    current, batch = _many(7, 250)
    assert_same(merged(spark, current, batch), apply_one_by_one(current, batch))


def test_hot_pairs_and_partitioning_change_nothing(spark):
    current, batch = _many(11, 40)
    plain = merged(spark, current, batch)
    assert_same(merged(spark, current, batch, hot_rows=1), plain)
    assert_same(merged(spark, current, batch[::-1], partitions=7), plain)


def test_same_batch_again_opens_nothing(spark):
    current, batch = _many(3, 20)
    once = merged(spark, current, batch)
    left, _ = frames(spark, current, batch)
    first = cut_lineage(U.upsert(left, frames(spark, current, batch)[1], NOW, keep=cut_lineage))
    again = U.upsert(left, first, NOW, keep=cut_lineage)
    assert {r.id for r in again.select("id").collect()} == set(once)


def _bare(raw_id, link, cig, hour=0):
    row = {c: None for c in BATCH_COLUMNS}
    return row | {"raw_id": raw_id, "fetched_at": utc(2026, 4, 1, hour), "link_bando": link, "cig": cig, "tag_tecnico": [],
                  **{f: R.NO for f in R.FLAGS}, "validation_level": "L1", "stato_procedurale": R.PUBLISHED}


def test_two_cigs_on_one_link(spark):
    batch = [_bare(i, *x) for i, x in enumerate([("b", "C1"), ("a", "C1"), ("a", "C2"), ("c", "C2")])]
    assert {r["link_bando"] for r in merged(spark, [], batch).values()} == {"b", "a"}
    # A notice without CIG opens the record; the CIG it had asked for before returns and is taken, so the next one is not.
    batch = [_bare(i, *x) for i, x in enumerate([("b", "C1"), ("a", "C1"), ("a", None), ("a", "C1"), ("a", "C2"), ("c", "C2")])]
    assert {r["link_bando"]: r["cig"] for r in merged(spark, [], batch).values()} == {"b": "C1", "a": "C1", "c": "C2"}


def test_long_chains_and_hot_keys(spark):
    """A chain in which each notice waits for the one before, longer than the rounds, beside links and CIGs of many notices."""
    chain = [x for i in range(40) for x in ((f"l{i}", f"k{i}"), (f"l{i + 1}", f"k{i}"))]
    wide = [("hub", f"h{i}") for i in range(50)] + [(f"w{i}", "shared") for i in range(50)]
    batch = [_bare(i, *x) for i, x in enumerate([*chain, *wide])]
    want = {key: len(v) for key, v in targets_one_by_one([], batch).items()}
    for rounds in (1, 12, 100):
        left, _ = frames(spark, [], batch)
        pairs = left.select("link_bando", "cig", U._order().alias("t"))
        taken = {(r.link_bando, r.cig) for r in U.first_come(pairs, rounds=rounds).collect()}
        links, cigs, greedy = set(), set(), set()
        for n in batch:
            if n["link_bando"] not in links and n["cig"] not in cigs:
                greedy.add((n["link_bando"], n["cig"]))
                links.add(n["link_bando"])
                cigs.add(n["cig"])
        assert taken == greedy
    placed = U.assign_targets(*frames(spark, [], batch), hot_rows=20).groupBy("target_id").count().collect()
    assert {r["target_id"]: r["count"] for r in placed} == want


def test_collisions_are_reported(spark):
    rows = [
        {**{c: None for c in RECORD_COLUMNS}, "id": i, "link_bando": "same", "first_seen_at": utc(2026, 1, d)}
        for i, d in (("b", 2), ("a", 3))
    ]
    _, current = frames(spark, rows, [])
    found = U.key_collisions(current).collect()
    assert [(r.key_kind, r.key_value, r.id, r.candidates) for r in found] == [("link_bando", "same", "b", 2)]


def test_no_current_rows_and_no_batch(spark):
    left, right = frames(spark, [], [])
    assert U.upsert(left, right, NOW).filter(F.lit(True)).collect() == []


def test_only_the_pairs_are_kept_a_row_per_pair(spark):
    """What decides about notices is kept per link and per CIG, not again per pair, and the notices are shuffled by link once."""
    batch = [_bare(i, f"l{i % 40}", f"k{i % 37}" if i % 3 else None, i % 5) for i in range(3000)]
    pairs, kept = len({(n["link_bando"], n["cig"]) for n in batch}), []

    def keep(df):
        out = cut_lineage(df)
        kept.append((out.count(), out.columns))
        return out

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = U.assign_targets(*frames(spark, [], batch), keep=keep)
        rows = placed.select("raw_id", "target_id").collect()
        plan = placed.select("raw_id", "target_id")
        plan.collect()
        assert "ReusedExchange" in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Besides the pairs only the candidates of the matching, which lose a row per link and CIG in each round.
    assert [c for n, c in kept if n >= pairs and "id_by_cig" in c] and sum(n >= pairs for n, _ in kept) == 1
    want = {n["raw_id"]: key for key, v in targets_one_by_one([], batch).items() for n in v}
    assert {r.raw_id: r.target_id for r in rows} == want
