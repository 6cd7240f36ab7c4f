"""Reading loosely typed values out of a VARIANT document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderglow.functions.text import bound, filled_stripped


def parsed(json_text: Column) -> Column:
    """VARIANT of a JSON text; null for null or broken input."""
    return F.try_parse_json(json_text)


def item(doc: Column, key: str) -> Column:
    return F.try_variant_get(doc, f"$['{key}']", "variant")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def scalar_text(value: Column) -> Column:
    """Text of a string, number or boolean; JSON text of an object; null for JSON null."""
    kind = _kind(value)
    text = F.try_variant_get(value, "$", "string")
    return F.when(kind == "VOID", F.lit(None).cast("string")).otherwise(
        F.when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)
    )


def first_text_in_list(value: Column) -> Column:
    """First item of a list that is a string with something in it."""
    items = F.try_variant_get(value, "$", "array<variant>")
    texts = F.transform(
        items,
        lambda x: F.when(_kind(x) == "STRING", filled_stripped(F.try_variant_get(x, "$", "string"))),
    )
    return F.get(F.array_compact(texts), F.lit(0))


def usable_texts(doc: Column) -> Column:
    """Map of the top-level keys to their usable text, null where there is none.

    A text counts stripped and only if something is left, a list stands for its first such text,
    other scalars for their text. Built once per document: lookups by alias are then cheap.
    """

    def usable(key: Column, value: Column) -> Column:
        kind = _kind(value)
        return (
            F.when(kind == "STRING", filled_stripped(F.try_variant_get(value, "$", "string")))
            .when(kind.startswith("ARRAY"), first_text_in_list(value))
            .otherwise(scalar_text(value))
        )

    return F.transform_values(F.try_variant_get(doc, "$", "map<string,variant>"), usable)


def first_str(texts: Column, *keys: str) -> Column:
    """First of the keys with a usable text in a :func:`usable_texts` map."""
    return F.coalesce(*[F.element_at(texts, k) for k in keys])


def truthy(doc: Column, key: str) -> Column:
    """False for a missing key, null, false, zero, empty text, empty list or empty object."""

    def verdict(value: Column) -> Column:
        kind = _kind(value)
        text = F.try_variant_get(value, "$", "string")
        return (
            F.when(kind == "VOID", F.lit(False))
            .when(kind == "BOOLEAN", text == "true")
            .when(kind == "STRING", text != "")
            .when(kind.startswith("ARRAY"), text != "[]")
            .when(kind.startswith("OBJECT"), text != "{}")
            .otherwise(text.try_cast("double") != 0)
        )

    return F.coalesce(bound(item(doc, key), verdict), F.lit(False))


def first_value(value: Column) -> Column:
    """Text of a value that may be wrapped: in a list, or in an object under a text key."""

    def unwrapped(v: Column) -> Column:
        return F.coalesce(*[scalar_text(item(v, k)) for k in ("text", "value", "content")])

    kind = _kind(value)
    listed = F.transform(
        F.try_variant_get(value, "$", "array<variant>"),
        lambda x: F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(
            F.when(_kind(x).startswith("OBJECT"), unwrapped(x))
        ),
    )
    return (
        F.when(kind.startswith("ARRAY"), F.get(F.array_compact(listed), F.lit(0)))
        .when(kind.startswith("OBJECT"), unwrapped(value))
        .otherwise(scalar_text(value))
    )
