"""Places of pattern matches as columns, without Python: arrays of (start, end, value) in code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string>"
_CHUNK = 256


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def find(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """All leftmost non-overlapping matches with their places; the end is exclusive.

    Splitting by a pattern gives the gaps between the matches that ``regexp_extract_all`` lists, so the places are
    running sums over both. The sums are folded in chunks, which keeps a text of very many matches cheap.
    ``guard`` is a cheap test that every text with a match passes.
    """
    gaps, found = F.split(text, F.lit(pattern), -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), found.alias("value"))
    pairs = F.filter(pairs, lambda p: p["value"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), none().alias("out"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["gap"]
        end = begin + F.length(p["value"])
        span = F.struct(begin.alias("start"), end.alias("end"), p["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def chunk(acc: Column, part: Column) -> Column:
        first = F.struct(acc["at"].alias("at"), none().alias("out"))
        return F.aggregate(part, first, step, lambda r: F.struct(
            r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def folded(all_pairs: Column) -> Column:
        count = F.size(all_pairs)
        parts = F.transform(F.sequence(F.lit(0), count - 1, F.lit(_CHUNK)), lambda i: F.slice(all_pairs, i + 1, _CHUNK))
        nested = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
        few = F.aggregate(all_pairs, start, step, lambda r: r["out"])
        many = F.aggregate(parts, nested, chunk, lambda r: F.flatten(r["out"]))
        return F.when(count == 0, none()).when(count <= _CHUNK, few).otherwise(many)

    # The one-element array binds the pairs, so that they are computed once.
    whole = F.transform(F.array(pairs), folded)[0]
    return F.when(guard, whole).otherwise(none()) if guard is not None else whole


def within(text: Column, span: Column, before: int, words: str, after: int = 0) -> Column:
    """Whether one of the words stands in the given number of code points around the span."""
    begin = F.greatest(span["start"] - before, F.lit(0))
    near = F.substring(text, begin + 1, span["start"] - begin)
    if after:
        near = F.concat(near, F.lit(" "), F.substring(text, span["end"] + 1, F.lit(after)))
    return near.rlike(f"(?i)(?<![A-Za-z])(?:{words})")


def luhn(digits: Column) -> Column:
    """The check of card numbers, on a string of digits."""
    turned = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        digit = F.ascii(F.substring(turned, i, F.lit(1))) - 48
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return acc + F.when(i % 2 == 1, digit).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)
    return (F.length(digits) > 0) & (total % 10 == 0)


def mod97(account: Column) -> Column:
    """The check of account numbers: the first four signs go to the end, letters count from 10, remainder 1."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def add(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(code < 65, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def named(spans: Column, kind: str, rank: int, base: bool) -> Column:
    """Spans with kind, place of the kind in the list, and whether the kind belongs to the base."""
    return F.transform(spans, lambda s: F.struct(
        F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"),
        F.lit(kind).alias("kind"), F.lit(base).alias("base"), s["value"].alias("value")))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def covered(spans: Column) -> Column:
    """Spans ordered by start, overlapping ones merged into one that takes the first one's kind."""
    parts = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        apart = F.concat(acc, F.array(s))
        return (F.when(F.size(acc) == 0, F.array(s))
                .when(s["start"] < last["end"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined)))
                .otherwise(apart))

    return F.aggregate(parts, F.array().cast("array<struct<start:int,end:int,kind:string>>"), merge)


def masked(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """The text with every covered place replaced by ``mark(kind)``."""
    def build(places: Column) -> Column:
        before = F.transform(places, lambda s, i: F.concat(
            F.substring(text, F.when(i == 0, F.lit(0)).otherwise(F.get(places, i - 1)["end"]) + 1,
                        s["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get(places, i - 1)["end"])),
            mark(s["kind"])))
        tail = F.substring(text, F.element_at(places, -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(before, ""), tail)

    return F.when(F.size(spans) == 0, text).otherwise(F.transform(F.array(covered(spans)), build)[0])
