"""Fetched web pages as a table: cleaning, re-fetch choice, section links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderglow import rules as R
from tenderglow.functions import text as T
from tenderglow.functions import urls as U

# ---- fixed values -----------------------------------------------------------------------------------
PAGE_CHARS = 80_000
THIN_PAGE_CHARS = 3_000
CUT_MARK = "...[TRONCATO]"

_ANCHOR = r"(?is)<a\s[^>]*href\s*=[^>]*>.*?</a\s*>"
_HREF = r"(?is)^<a\s[^>]*?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))"


def cleaned(html: Column, max_chars: int | None = None) -> Column:
    """Page without scripts, styles and comments, whitespace collapsed.

    With ``max_chars`` it is cut to that budget; a consumer with one passes ``PAGE_CHARS``.
    """
    out = html
    for pattern in (
        r"(?is)<script[^>]*>.*?</script>",
        r"(?is)<style[^>]*>.*?</style>",
        r"(?s)<!--.*?-->",
        r"(?U)\s+",
    ):
        out = F.regexp_replace(out, pattern, " ")
    if max_chars is None:
        return out
    cut = F.concat(F.substring(out, 1, max_chars), F.lit(CUT_MARK))
    return F.when(F.length(out) > max_chars, cut).otherwise(out)


def clean_pages(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """All pages cleaned, whole unless a budget is given."""
    return pages.withColumn("html", cleaned(F.col("html"), max_chars))


def needs_render(pages: DataFrame, min_chars: int = THIN_PAGE_CHARS) -> DataFrame:
    """Cleaned pages too thin to hold a listing."""
    return pages.filter(F.length(F.coalesce("html", F.lit(""))) < min_chars)


def with_rendered(
    pages: DataFrame, rendered: DataFrame, min_chars: int = THIN_PAGE_CHARS
) -> DataFrame:
    """Thin pages replaced by their second fetch where that one is longer."""
    second = rendered.groupBy("url").agg(F.max_by("html", F.length("html")).alias("_second"))
    own = F.coalesce("html", F.lit(""))
    better = (F.length(own) < min_chars) & (F.length("_second") > F.length(own))
    return (
        pages.join(second, "url", "left")
        .withColumn("html", F.when(better, F.col("_second")).otherwise(F.col("html")))
        .select(*pages.columns)
    )


def _decoded(c: Column) -> Column:
    for entity, char in (
        ("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"),
        ("&amp;", "&"),
    ):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def anchor_text(anchor: Column) -> Column:
    """Text pieces inside an anchor, each stripped, joined by blanks."""
    inner = F.regexp_replace(anchor, r"(?is)^<a\s[^>]*>|</a\s*>$", "")
    pieces = F.transform(
        F.split(inner, r"(?s)<!--.*?-->|<[^>]*>"), lambda p: T.strip(_decoded(p))
    )
    return F.array_join(F.filter(pieces, lambda p: p != ""), " ")


def anchor_href(anchor: Column) -> Column:
    groups = [F.regexp_extract(anchor, _HREF, i) for i in (1, 2, 3)]
    return _decoded(T.strip(F.concat(*groups)))


def anchors(html: Column) -> Column:
    """Array of (text, href) of a page's links in page order."""
    found = F.regexp_extract_all(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), F.lit(_ANCHOR), F.lit(0))
    return F.transform(
        found, lambda a: F.struct(anchor_text(a).alias("text"), anchor_href(a).alias("href"))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """One row per link of every page, resolved against the page."""
    return pages.select(
        "url", F.posexplode(anchors(F.col("html"))).alias("pos", "a")
    ).select(
        "url", "pos", F.col("a.text").alias("text"),
        U.resolve(F.col("url"), F.col("a.href")).alias("link"),
    )


def find_section_link(
    pages: DataFrame, patterns: Sequence[str] = R.SECTION_LINK_TEXTS
) -> DataFrame:
    """Per page the first followable link whose text holds a pattern.

    The choice is made inside the row's own array, so pages are not shuffled.
    """

    def follow(a: Column) -> Column:
        href = F.lower(a.href)
        return (
            T.contains_any(F.lower(a.text), patterns)
            & (href != "")
            & ~href.startswith("#")
            & ~href.startswith("javascript:")
        )

    first = F.get(F.filter(anchors(F.col("html")), follow), F.lit(0))
    return (
        pages.select("url", first.alias("a"))
        .filter(F.col("a").isNotNull())
        .select("url", U.resolve(F.col("url"), F.col("a.href")).alias("link"))
    )
