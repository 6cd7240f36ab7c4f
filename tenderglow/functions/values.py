"""Amount, date and formatting columns."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderglow import rules as R
from tenderglow.functions.text import bound, strip

ITALIAN_DATE = r"(\d{1,2})/(\d{1,2})/(\d{4})"
ISO_DATE = (
    r"^\d{4}-\d{2}-\d{2}(?:[T\s]\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:?\d{2})?)?$"
)
THOUSANDS_DOT = r"\.(?=\d{3}(?:\D|$))"


def at(now: datetime) -> Column:
    """A fixed moment as a timestamp column; a naive value counts as UTC."""
    if now.tzinfo is None:
        now = now.replace(tzinfo=timezone.utc)
    return F.lit(now)


def _disclosed(c: Column) -> Column:
    """Stripped text; null for empty texts and the usual stand-ins for a missing value."""
    return bound(
        strip(c),
        lambda text: F.when((text != F.lit("")) & ~F.lower(text).isin(*R.NOT_DISCLOSED), text),
    )


def amount(c: Column, dtype: str = "decimal(18,2)") -> Column:
    """Italian or plain money text to a decimal; negative or unreadable gives null."""
    text = F.regexp_replace(_disclosed(c), r"(?U)[€£$\s]", "")
    # A dot before exactly three digits separates thousands, with or without a comma present.
    plain = F.replace(F.regexp_replace(text, THOUSANDS_DOT, ""), F.lit(","), F.lit("."))
    return bound(plain.try_cast(dtype), lambda value: F.when(value >= 0, value))


def numeric_amount(c: Column, dtype: str = "decimal(18,2)") -> Column:
    """Amount of a column that is a number already: no text rules, sign kept."""
    return c.try_cast(dtype)


def _from_parts(c: Column, pattern: str, day: int, month: int, year: int) -> Column:
    """Midnight UTC of the first match of ``pattern``; null for an impossible day."""
    part = {i: F.regexp_extract(c, pattern, i).try_cast("int") for i in (day, month, year)}
    made = F.try_make_timestamp(
        F.nullif(part[year], F.lit(0)), part[month], part[day],
        F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"),
    )
    return made


def iso_timestamp(c: Column) -> Column:
    """Whole-text ISO date or date-time, naive values as UTC."""


    def parsed(text: Column) -> Column:
        # An offset without a colon follows a time of day; a plain date ends in "-dd".
        zoned = F.regexp_replace(text, r"(:\d{2}[+-]\d{2})(\d{2})$", "$1:$2")
        joined = F.regexp_replace(zoned, r"^(\d{4}-\d{2}-\d{2})\s", "$1T")
        return F.when(text.rlike("(?U)" + ISO_DATE), joined.try_cast("timestamp"))

    return bound(c, parsed)


def precise_timestamp(c: Column) -> Column:
    """Like ``iso_timestamp``, fractions of a second allowed; they are dropped."""
    return bound(c, lambda text: iso_timestamp(
        F.regexp_replace(text, r"(\d{2}:\d{2}:\d{2})[.,]\d+", "$1")
    ))


def it_date(c: Column) -> Column:
    """First d/m/yyyy anywhere in the text, else a whole ISO date or date-time."""


    def parsed(text: Column) -> Column:
        italian = _from_parts(text, ITALIAN_DATE, 1, 2, 3)
        return F.when(text.rlike(ITALIAN_DATE), italian).otherwise(iso_timestamp(text))

    return bound(_disclosed(c), parsed)


def dashed_date(c: Column) -> Column:
    """``dd-mm-yyyy`` of the framework-lot feed."""
    return _from_parts(c, r"^(\d{1,2})-(\d{1,2})-(\d{4})$", 1, 2, 3)


def compact_date(c: Column) -> Column:
    """``yyyymmdd`` of the older notice layout."""
    return _from_parts(c, r"^(\d{4})(\d{2})(\d{2})$", 3, 2, 1)


def rss_date(c: Column) -> Column:
    """RFC 822 date of a feed entry, else ISO."""
    text = F.regexp_replace(strip(c), r"^[A-Za-z]{3},\s*", "")
    text = F.regexp_replace(text, r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss xx")), iso_timestamp(strip(c))
    )


def days_until(c: Column, now: datetime) -> Column:
    """UTC calendar days from ``now`` to the timestamp; negative when past."""
    return F.datediff(F.to_date(c), F.to_date(at(now)))


def days_left_rounded_up(c: Column, now: datetime) -> Column:
    """Elapsed-time days rounded up, the number a notice card shows."""
    return F.ceil((F.unix_micros(c) - F.unix_micros(at(now))) / F.lit(86_400_000_000.0))


def whole_days_since(c: Column, now: datetime) -> Column:
    """Complete 24-hour periods elapsed; not the same as a calendar difference."""
    elapsed = (F.unix_micros(at(now)) - F.unix_micros(c)) / F.lit(86_400_000_000.0)
    return F.floor(elapsed).cast("bigint")


def eur(c: Column) -> Column:
    """``€1.234.567``: whole euros, half to even, dots between thousands."""
    shown = F.concat(F.lit("€"), F.translate(F.format_number(c, 0), ",", "."))
    return F.coalesce(shown, F.lit("n.d."))


def eur_card(c: Column) -> Column:
    """The same for display cards: halves away from zero, NaN shown as missing."""
    number = F.when(~F.isnan(c.cast("double")), c)
    return eur(F.round(number, 0))


def iso(c: Column) -> Column:
    """``2026-04-22T07:00:00+00:00``; microseconds only when there are any."""
    micros = F.when(F.unix_micros(c) % F.lit(1_000_000) != 0, F.date_format(c, ".SSSSSS"))
    return F.concat(
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.coalesce(micros, F.lit("")), F.lit("+00:00")
    )


def plain_timestamp(c: Column) -> Column:
    """``2026-04-15 00:00:00+00:00``, the rendering inside checksums."""
    return F.replace(iso(c), F.lit("T"), F.lit(" "))
