"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Defined cases: a null text is read as empty and has no span; a null ``doc_id`` is kept as null; repeated rows each give
a row; an empty table gives an empty table; other columns are ignored by ``find_pii`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderglow.llm import spans
from tenderglow.llm.common import texts

# The base patterns. Possessive repeats and the look-behinds change no match; they bound the work on long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Patterns of the method, after the base.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL_PHONE = r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
IPV6 = r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"

CARD_WORDS = "card|visa|master|amex|credit|debit|karte|tarjeta|carte|pay"
PHONE_WORDS = "phone|tel|call|fax|mobile|cell|ruf|appel"
SSN_WORDS = "ssn|social|security|tax|id"
ACCOUNT_WORDS = "iban|account|bank|konto|cuenta|compte"

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "short_card", "ssn", "local_phone", "ipv6")


def _digits(span: Column) -> Column:
    return F.regexp_replace(span["value"], "[^0-9]", "")


def _kept(text: Column, found: Column, confirmed, score, least: float) -> Column:
    """Spans that their checksum confirms and whose score, context included, reaches the threshold."""
    return F.filter(found, lambda s: confirmed(s) & (score(s) >= F.lit(least)))


def base_spans(text: Column) -> dict[str, Column]:
    """The four base kinds; a match that fails its test is dropped."""
    digit = text.rlike("[0-9]")
    cards = F.filter(spans.find(text, CARD, digit), lambda s: (
        F.length(_digits(s)).between(16, 19) & spans.luhn(_digits(s))))
    phones = F.filter(spans.find(text, PHONE, F.contains(text, F.lit("+"))), lambda s: F.length(_digits(s)).between(8, 15))
    ips = F.filter(spans.find(text, IP, digit), lambda s: s["value"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
    return {"email": spans.find(text, EMAIL, F.contains(text, F.lit("@"))), "ip": ips, "card": cards, "phone": phones}


def added_spans(text: Column, least: float, window: int) -> dict[str, Column]:
    """Spans that the method adds to the base: confirmed by checksum or form, scored with their context."""
    digit = text.rlike("[0-9]")

    def near(words: str, first: float, more: float):
        return lambda s: F.lit(first) + F.when(spans.within(text, s, window, words, 8), more).otherwise(0.0)

    iban = _kept(text, spans.find(text, IBAN, digit & text.rlike("[A-Z]{2}[0-9]{2}")),
                 lambda s: F.length(F.replace(s["value"], F.lit(" "), F.lit(""))).between(15, 34)
                 & spans.mod97(F.replace(s["value"], F.lit(" "), F.lit(""))),
                 near(ACCOUNT_WORDS, 0.8, 0.2), least)
    short = _kept(text, spans.find(text, CARD, digit),
                  lambda s: F.length(_digits(s)).between(13, 15) & spans.luhn(_digits(s)),
                  near(CARD_WORDS, 0.3, 0.4), least)
    ssn = _kept(text, spans.find(text, SSN, digit & F.contains(text, F.lit("-"))),
                lambda s: ~s["value"].rlike("^(?:000|666|9)|-00-|-0000$"), near(SSN_WORDS, 0.5, 0.3), least)
    phone = _kept(text, spans.find(text, LOCAL_PHONE, digit), lambda s: F.lit(True), near(PHONE_WORDS, 0.3, 0.4), least)
    six = _kept(text, spans.find(text, IPV6, digit & F.contains(text, F.lit(":"))), lambda s: F.lit(True),
                near("ip|address|host", 0.6, 0.2), least)
    return {"iban": iban, "short_card": short, "ssn": ssn, "local_phone": phone, "ipv6": six}


def with_pii(df: DataFrame, text: str = "text", into: str = "pii", least: float = 0.5, window: int = 40) -> DataFrame:
    """Adds the array of all spans (rank, start, end, kind, base, value), by kind and start; none that a base span covers is added.

    ``least`` is the score below which spans added by the method are dropped; ``window`` the code points of context
    before a span. Base spans never depend on either.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    order = [*BASE, *ADDED]

    def named(found: dict[str, Column], is_base: bool) -> Column:
        return F.concat(*(spans.named(v, k, order.index(k), is_base) for k, v in found.items()))

    def joined(both: Column) -> Column:
        """The base, and what the method adds outside of it: a place is not reported twice."""
        free = F.filter(both["added"], lambda s: ~F.exists(both["base"], lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
        return F.concat(both["base"], free)

    pair = F.struct(named(base_spans(source), True).alias("base"), named(added_spans(source, least, window), False).alias("added"))
    # The one-element array binds the pair, so that it is computed once.
    return df.withColumn(into, F.transform(F.array(pair), joined)[0])


def find_pii(docs: DataFrame, least: float = 0.5, window: int = 40) -> DataFrame:
    """One row per document: ``doc_id`` and its array of spans."""
    return with_pii(texts(docs), least=least, window=window).select("doc_id", "pii")


def redact(docs: DataFrame, least: float = 0.5, window: int = 40) -> DataFrame:
    """The documents with every span replaced by ``<KIND>``; all columns stay, ``n_chars`` follows the text if present.

    A null text stays null.
    """
    own = next(f"pii{'_' * i}" for i in range(len(docs.columns) + 2) if f"pii{'_' * i}" not in docs.columns)
    marked = with_pii(docs, into=own, least=least, window=window)
    text = spans.masked(F.col("text"), F.col(own), lambda kind: F.concat(F.lit("<"), F.upper(kind), F.lit(">")))
    out = marked.withColumn("text", F.when(F.col("text").isNotNull(), text)).drop(own)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def digest(found: DataFrame) -> DataFrame:
    """Counts and the hash of the base spans, and the list of all spans."""
    base = F.filter("pii", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(spans.listed(base), 256).alias("base_sha256"),
                        spans.listed(F.col("pii")).alias("spans"))
