"""URL columns: percent-encoding and reference resolution (RFC 3986)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def quote(c: Column) -> Column:
    """Percent-encode as in a path: blanks as %20, ``/`` and ``~`` kept, ``*`` encoded."""
    out = F.url_encode(c)
    for found, wanted in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return out


def _group(c: Column, i: int) -> Column:
    return F.regexp_extract(c, _PARTS, i)


def _without_dots(path: Column) -> Column:
    """Drop ``.`` segments and resolve ``..`` ones."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(
            s == "..",
            # The leading empty segment (root) is never removed.
            F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc),
        )
        .otherwise(F.concat(acc, F.array(s))),
    )
    # A trailing dot segment names a folder, so the slash stays.
    folder = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    plain = F.array_join(folder, "/")
    return F.when(path.contains("."), plain).otherwise(path)


def resolve(base: Column, ref: Column) -> Column:
    """Absolute form of a reference found on page ``base``."""
    scheme, host, path, query = (_group(base, i) for i in (1, 2, 3, 4))
    r_scheme, r_path, r_query, r_fragment = (_group(ref, i) for i in (1, 3, 4, 5))
    root = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_extract(path, r"^(.*/)[^/]*$", 1)
    merged = F.when(folder == "", F.concat(F.lit("/"), r_path)).otherwise(F.concat(folder, r_path))
    tail = F.concat(r_query, r_fragment)
    return (
        F.when(ref == "", base)
        .when(r_scheme != "", ref)
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(r_path.startswith("/"), F.concat(root, _without_dots(r_path), tail))
        .when(r_path != "", F.concat(root, _without_dots(merged), tail))
        .when(r_query != "", F.concat(root, path, tail))
        .otherwise(F.concat(root, path, query, r_fragment))
    )


def file_name(url: Column) -> Column:
    """Last path segment, ``document`` when there is none."""
    name = F.regexp_extract(_group(url, 3), r"([^/]*)$", 1)
    return F.when(name == "", "document").otherwise(name)
