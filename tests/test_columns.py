"""Literal cases of the column builders."""

from __future__ import annotations

from decimal import Decimal
from urllib.parse import quote, urljoin

from conftest import utc
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tenderglow import rules as R
from tenderglow.functions import jsonvals as J
from tenderglow.functions import text as T
from tenderglow.functions import urls as U
from tenderglow.functions import values as V


def test_amount(column):
    cases = {
        "€ 1.234.567,89": "1234567.89", "1.234.567,89": "1234567.89", "1234567.89": "1234567.89",
        "5000000": "5000000.00", "1.234": "1234.00", "99,5": "99.50", " £ 10 ": "10.00",
        "1.250.000": "1250000.00", "0": "0.00", "1e3": "1000.00",
    }
    assert column(cases, V.amount) == [Decimal(v) for v in cases.values()]
    unreadable = [None, "", "  ", "n.d.", "N/A", "abc", "-5", "NaN", "Infinity", "1_000", "1,2,3"]
    assert column(unreadable, V.amount) == [None] * len(unreadable)


def test_numeric_amount_keeps_sign(column):
    assert column([1500.5, -2.0], V.numeric_amount, "double") == [Decimal("1500.50"), Decimal("-2.00")]


def test_fractions_of_a_second(column):
    def shown(c):
        return F.date_format(V.precise_timestamp(c), "yyyy-MM-dd HH:mm:ss")

    cases = {
        "2026-04-15T10:00:00.000": "2026-04-15 10:00:00", "2026-04-15T10:00:00.123456Z": "2026-04-15 10:00:00",
        "2026-04-15T10:00:00.5+02:00": "2026-04-15 08:00:00", "2026-04-15": "2026-04-15 00:00:00", "x.5": None,
    }
    assert column(cases, shown) == list(cases.values())


def test_dates(column):
    def shown(c):
        return F.date_format(V.it_date(c), "yyyy-MM-dd HH:mm:ss")

    cases = {
        "15/03/2026": "2026-03-15 00:00:00",
        "pubblicato il 5/3/2026 alle 12": "2026-03-05 00:00:00",
        "2026-03-15": "2026-03-15 00:00:00",
        "2026-03-15T10:30:00Z": "2026-03-15 10:30:00",
        "2026-03-15 10:30": "2026-03-15 10:30:00",
        "2026-03-15T10:30:00+0200": "2026-03-15 08:30:00",
        "2026-03-15T10:30:00-01:30": "2026-03-15 12:00:00",
        "31/02/2026": None, "2026-02-31": None, "2026": None, "n.d.": None, "garbage": None,
        "": None, "31/02/2026 2026-01-01": None, "01/01/0000": None,
    }
    assert column(cases, shown) == list(cases.values())


def test_day_counts(column):
    now = utc(2026, 3, 15, 12)
    assert column(["20/03/2026", "10/03/2026", None], lambda c: V.days_until(V.it_date(c), now)) == [
        5, -5, None,
    ]
    # 14 and a half days ago: the calendar says 15, elapsed whole days are 14.
    then = F.lit(utc(2026, 3, 1, 0))
    assert column(["x"], lambda c: V.whole_days_since(then, now)) == [14]
    assert column(["x"], lambda c: V.days_left_rounded_up(F.lit(utc(2026, 3, 16, 13)), now)) == [2]


def test_cig(column):
    valid = ["ABCDEFGH12", "9A1234567B", "12345678", " abcd1234ef "]
    invalid = [None, "", "abc", "abcdefghij1234", "ABCDEFG!"]
    assert column(valid + invalid, T.valid_cig) == [True] * 4 + [False] * 5


def test_scope(column):
    texts = [
        "Gara per illuminazione pubblica del Comune",
        "facility management e climatizzazione edifici",
        "RELAMPING della rete",
        "fornitura CPV 34928510-8",
        "codice 349285100", "", None,
    ]
    assert column(texts, T.scope_points) == [2, -9, 2, 2, 0, 0, 0]
    detail = column(["Telegestione e telecontrollo con smart lighting"], T.scope_detail)[0]
    assert detail.include_hits == ["telegestione", "telecontrollo", "smart lighting"]
    assert detail.in_scope and not detail.code_match and detail.score == 6


def test_codes(column):
    assert column(["34928510-8", "72000000", "x34928510", "45316110, 1", None], T.has_code) == [
        True, False, False, True, False,
    ]


def test_tags(column):
    def tags(c):
        return T.tags(c)

    cases = {
        "Lampade LED": ["LED"],
        "relamping": [],
        "telegestione e telecontrollo": ["telegestione", "telecontrollo", "manutenzione"],
        "PPP con fondi PNRR": ["PNRR", "PPP"],
        "Accordo-quadro": ["accordo quadro"],
        "impianti  semaforici": ["semafori accorpati"],
        "": [],
    }
    assert column(cases, tags) == list(cases.values())
    assert column([6_000_000, 500_000, 5_538_000], lambda c: T.tags(F.lit(""), c), "bigint") == [
        ["sopra soglia UE"], [], [],
    ]


def test_flags(column):
    def flag(name):
        return lambda c: T.flags(c)[name]

    assert column(["project financing", "no"], flag("flag_ppp_doppio_oggetto")) == ["Yes", "No"]
    assert column(["CONCESSIONE"], flag("flag_concessione_ambito")) == ["Yes"]
    assert column(["gestione in house"], flag("flag_in_house_ambito")) == ["Yes"]
    assert column(["Global  Service", "o & m"], flag("flag_om")) == ["Yes", "Yes"]
    assert column(["manifestazione d’interesse"], flag("flag_pre_gara")) == ["Yes"]


def test_state(column):
    def state(act):
        return lambda c: T.state(c, F.lit(act).cast("string"))

    texts = ["avviso di aggiudicazione", "proroga termini", "delibera di giunta", "procedura aperta"]
    assert column(texts, state(None)) == [R.OUTCOME, R.AMENDED, R.PRE_TENDER, R.PUBLISHED]
    assert column(["aggiudicazione"], state("determina")) == [R.PRE_TENDER]
    assert column(["aggiudicazione"], state("notizia")) == [R.OUTCOME]


def test_formats(column):
    assert column([1234567.5, 0.5, 1.5, None], V.eur, "double") == ["€1.234.568", "€0", "€2", "n.d."]
    assert column([0.5, float("nan")], V.eur_card, "double") == ["€1", "n.d."]
    assert column([utc(2026, 4, 22, 7)], V.iso, "timestamp") == ["2026-04-22T07:00:00+00:00"]
    assert column([utc(2026, 4, 22, 7, 0, 1, 500)], V.iso, "timestamp") == [
        "2026-04-22T07:00:01.000500+00:00"
    ]


def test_alert_keys(column):
    assert column(["[key:a:1] testo", "[key:] x", "testo", None], T.alert_key) == [
        "a:1", None, None, None,
    ]


def test_first_str(column):
    docs = [
        '{"a": null, "b": " x "}', '{"a": "  ", "b": 7}', '{"a": ["", " y "]}', '{"a": [], "b": true}',
        '{"a": 1234.567}', "{}", None, "not json",
    ]
    out = column(docs, lambda c: J.first_str(J.usable_texts(J.parsed(c)), "a", "b"))
    assert out == ["x", "7", "y", "True", "1234.567", None, None, None]


def test_truthy(column):
    docs = ['{"p": %s}' % v for v in ("true", "false", "0", "1", '""', '"false"', "[]", "[0]", "null")]
    assert column(docs + ["{}"], lambda c: J.truthy(J.parsed(c), "p")) == [
        True, False, False, True, False, True, False, True, False, False,
    ]


PATHS = st.text(st.sampled_from("abc/.?#="), max_size=8)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(PATHS, min_size=1, max_size=30))
def test_url_resolution_agrees_with_the_standard_library(column, refs):
    base = "https://h.example.com/a/b/page.html?x=1"
    # Empty components ("?" or "#" alone) and double slashes are spelled differently by the library.
    refs = [r for r in refs if "//" not in r and "?" not in r and "#" not in r]
    out = column(refs, lambda c: U.resolve(F.lit(base), c))
    assert out == [urljoin(base, r) for r in refs]


def test_url_resolution_cases(column):
    base = "https://h.example.com/a/b/page.html?x=1#top"
    refs = ["https://o.example.com/x", "//o.example.com/x", "/r/s", "c/d?q=1", "../e", "../../../f",
            "?y=2", "#z", "", "./g/../h", "mailto:x@example.com", "i/."]
    out = column(refs, lambda c: U.resolve(F.lit(base), c))
    assert out == [urljoin(base, r) if r else base for r in refs]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=("Cs", "Cc")), max_size=12), min_size=1, max_size=20))
def test_quote_agrees_with_the_standard_library(column, texts):
    assert column(texts, U.quote) == [quote(t) for t in texts]
