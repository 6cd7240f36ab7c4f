"""Tender rows out of HTML listing pages.

The only job with Python in the executors: picking elements by selector has no built-in
counterpart. The Python part turns one page into the texts of its rows and nothing else; amounts,
dates, scope and duplicates are columns.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderglow import rules as R
from tenderglow.functions import text as T
from tenderglow.functions import values as V
from tenderglow.operators.landing import first_per_key, gate

# Executors need not have this package installed: the page parser travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Profile:
    """Selectors of a portal, each list in order of preference."""

    rows: tuple[str, ...]
    titles: tuple[str, ...]
    dates: tuple[str, ...]
    amounts: tuple[str, ...]


# Selectors per portal.
PROFILES = {
    "generic_html": Profile(
        rows=("table.listing tr", "tr.tender-row", "article.bando", "li.bando", "div.bando",
              "div.tender-row"),
        titles=("a.tender-title", "td.oggetto a", "h2 a", "h3 a", "a"),
        dates=("td.data", "td.data-pubblicazione", "span.date", "time"),
        amounts=("td.importo", "span.importo", "td.valore"),
    ),
    "asmecomm": Profile(
        rows=("table.gare tr", "tr.gara", "article.bando", "div.tender-row"),
        titles=("td.oggetto a", "a.tender-title", "h2 a", "a"),
        dates=("td.data-pubblicazione", "td.data", "span.date"),
        amounts=("td.importo", "td.valore"),
    ),
    "traspare": Profile(
        rows=("div.card.gara", "div.procedura", "article.procedura", "li.gara"),
        titles=("h3 a", "h2 a", "a.titolo", "a"),
        dates=("span.data-pubblicazione", "span.data", "time"),
        amounts=("span.importo", "div.importo"),
    ),
    "tuttogare": Profile(
        rows=("table#tabellaGare tr", "tr.riga-gara", "div.gara-box", "article.gara"),
        titles=("td.oggetto a", "a.oggetto-gara", "h3 a", "a"),
        dates=("td.data-pubblicazione", "td.dataPubblicazione", "span.data"),
        amounts=("td.importo", "td.importoBase"),
    ),
    "sater": Profile(
        rows=("div.bando-item", "article.bando", "tr.gara", "li.bando"),
        titles=("h3.titolo-bando a", "a.titolo-bando", "h2 a", "a"),
        dates=("span.data-pubblicazione", "time.pub-date", "span.data"),
        amounts=("span.importo-gara", "div.importo"),
    ),
    "start_toscana": Profile(
        rows=("table.listing tr", "tr.tender-row", "div.tender-card", "article.gara"),
        titles=("td.title a", "a.tender-title", "h3 a", "a"),
        dates=("td.pub-date", "td.data", "span.date"),
        amounts=("td.amount", "td.importo"),
    ),
}

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Opening one of these ends an open one of the same name within the nearest container.
_SELF_CLOSING = {"tr": "table", "td": "tr", "th": "tr", "li": "ul", "p": "body", "option": "select"}
_MUTE = frozenset(("script", "style"))


def _simple(selector: str) -> tuple[frozenset[str], ...]:
    """Parts of a descendant selector, each the set of marks (``tag``, ``.class``, ``#id``) it asks for."""
    return tuple(
        frozenset(part.replace(".", " .").replace("#", " #").split()) for part in selector.split()
    )


class _Spot:
    """An element that some selector asks for: its text so far, its link, and for rows the fields met inside."""

    __slots__ = ("field", "rank", "pieces", "href", "fields", "stamp", "linked")

    def __init__(self, field: str, rank: int, href: str | None, stamp: str | None):
        self.field, self.rank, self.href, self.stamp = field, rank, href, stamp
        self.pieces: list[str] = []
        self.fields: dict[tuple[str, int], _Spot] = {}
        self.linked = href is not None


class _Asked:
    """What a profile asks for, and for the elements met so far which selectors may end at them."""

    #: Elements (tag, class, id) and short tags kept; many rows share them, and what is lost is only found again.
    KEPT, SHORT = 4_096, 200

    def __init__(self, profile: Profile):
        self.selectors = [
            (field, rank, _simple(selector))
            for field, selectors in (("row", profile.rows), ("title", profile.titles),
                                     ("date", profile.dates), ("amount", profile.amounts))
            for rank, selector in enumerate(selectors)
        ]
        self.met: dict[tuple[str, str, str], tuple[frozenset[str], list[tuple]]] = {}
        self.read: dict[str, tuple] = {}  # text of a tag as written, and the call it leads to

    def of(self, tag: str, classes: str, own_id: str) -> tuple[frozenset[str], list[tuple]]:
        """Marks of an element, and the selectors whose last part asks for no others."""
        key = (tag, classes, own_id)
        found = self.met.get(key)
        if found is None:
            marks = frozenset((tag, *("." + c for c in classes.split()), *(("#" + own_id,) if own_id else ())))
            if len(self.met) >= self.KEPT:
                self.met.clear()
            found = self.met[key] = marks, [s for s in self.selectors if s[2][-1] <= marks]
        return found


class _Scanner(HTMLParser):
    """Reads a page once and notes every row and field that a profile may want.

    No tree is kept. Each open element carries its marks and the spots it opened; text goes to the spots that
    are open. Which row selector counts is known only at the end, so the rows of all are noted, and all links.
    """

    def __init__(self, asked: _Asked):
        super().__init__(convert_charrefs=True)
        self.asked = asked
        self.stack: list[tuple[str, frozenset[str], list[_Spot]]] = []
        self.spots: list[_Spot] = []  # open ones, outer first
        self.rows: list[_Spot] = []

    def updatepos(self, i, j):
        return j  # nobody asks for lines

    def _repeated(self, i: int, parse: Callable[[int], int]) -> int:
        """Parses the tag at ``i``, or repeats the call that the same text led to before.

        A tag that ended at the first ``>`` after it depends on nothing that follows.
        """
        end = self.rawdata.find(">", i) + 1
        plain = self.cdata_elem is None and 0 < end - i <= self.asked.SHORT
        text = self.rawdata[i:end] if plain else None
        known = self.asked.read.get(text)
        if known is not None:
            getattr(self, known[0])(*known[1:])
            return end
        self.call = None
        after = parse(i)
        if plain and after == end and self.call is not None and self.cdata_elem is None:
            if len(self.asked.read) >= self.asked.KEPT:
                self.asked.read.clear()
            self.asked.read[text] = self.call
        return after

    def parse_starttag(self, i):
        return self._repeated(i, super().parse_starttag)

    def parse_endtag(self, i):
        return self._repeated(i, super().parse_endtag)

    def _wanted(self, ending: list[tuple]) -> Iterator[tuple[str, int]]:
        for field, rank, parts in ending:
            left = len(parts) - 1
            if left:
                for _, above, _ in reversed(self.stack):
                    if left and parts[left - 1] <= above:
                        left -= 1
            if not left:
                yield field, rank

    def _enter(self, tag: str, attrs: list, closed: bool) -> None:
        given = {k: v or "" for k, v in reversed(attrs)}
        marks, ending = self.asked.of(tag, given.get("class", ""), given.get("id", ""))
        href = given.get("href") if tag == "a" else None
        if tag == "a":
            for spot in self.spots:
                if spot.field == "title" and not spot.linked:
                    spot.href, spot.linked = href, True
        opened = [_Spot(f, r, href or None, given.get("datetime")) for f, r in self._wanted(ending)]
        if href:
            opened.append(_Spot("row", LOOSE, href, None))
        for spot in opened:
            if spot.field == "row":
                self.rows.append(spot)
            else:
                for row in self.spots:
                    if row.field == "row":
                        row.fields.setdefault((spot.field, spot.rank), spot)
        if not closed:
            self.stack.append((tag, marks, opened))
            self.spots += opened

    def _leave(self, depth: int) -> None:
        """Closes open elements down to ``depth``."""
        gone = sum(len(spots) for _, _, spots in self.stack[depth:])
        del self.stack[depth:]
        if gone:
            del self.spots[-gone:]

    def handle_starttag(self, tag, attrs):
        self.call = ("handle_starttag", tag, attrs)
        limit = _SELF_CLOSING.get(tag)
        if limit:
            for depth in range(len(self.stack) - 1, -1, -1):
                name = self.stack[depth][0]
                if name == tag and name != limit:
                    self._leave(depth)
                if name in (tag, limit):
                    break
        self._enter(tag, attrs, tag in _VOID)

    def handle_startendtag(self, tag, attrs):
        self.call = ("handle_startendtag", tag, attrs)
        self._enter(tag, attrs, True)

    def handle_endtag(self, tag):
        self.call = ("handle_endtag", tag)
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                self._leave(depth)
                return

    def handle_data(self, data):
        if self.spots and not any(tag in _MUTE for tag, _, _ in self.stack):
            for spot in self.spots:
                spot.pieces.append(data)


# Rank of links, which are rows where no row selector fits.
LOOSE = 1_000


def scan_page(html: str, page_url: str, profile: Profile | _Asked) -> tuple[int, list[tuple]]:
    """The best rank with rows, and its rows: text, own link, fields (name, rank, text, stamp, link)."""
    page = _Scanner(_Asked(profile) if isinstance(profile, Profile) else profile)
    page.feed(html)
    page.close()
    best = min((row.rank for row in page.rows), default=LOOSE)

    links: dict[str, str] = {}

    def link(spot: _Spot) -> str | None:
        if not spot.href:
            return None
        if spot.href not in links:
            links[spot.href] = urljoin(page_url, spot.href)
        return links[spot.href]

    return best, [
        (
            " ".join(row.pieces), link(row),
            [(field, rank, "".join(f.pieces), f.stamp, link(f)) for (field, rank), f in sorted(row.fields.items())],
        )
        for row in page.rows if row.rank == best
    ]


_FIELDS = "ARRAY<STRUCT<field: STRING, rank: INT, text: STRING, stamp: STRING, link: STRING>>"
_PAGE_SCHEMA = (
    "source STRING, listing_url STRING, rank INT, "
    f"found ARRAY<STRUCT<text: STRING, link: STRING, fields: {_FIELDS}>>"
)


def _one_line(c: Column) -> Column:
    """Runs of white space as one space; null for a text without ink."""
    return F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def _row(r: Column) -> Column:
    """A scanned row as title, link, body and the values to try, all by rank."""
    def of(field: str) -> Column:
        return F.filter(r["fields"], lambda f: f["field"] == field)

    named = F.transform(of("title"), lambda f: F.struct(_one_line(f["text"]).alias("title"), f["link"].alias("link")))
    title = F.get(F.filter(named, lambda t: t["title"].isNotNull() | t["link"].isNotNull()), F.lit(0))
    own = F.when(r["link"].isNotNull(), F.struct(_one_line(r["text"]).alias("title"), r["link"].alias("link")))
    chosen = F.coalesce(title, own)
    return F.struct(
        chosen["title"].alias("raw_title"), chosen["link"].alias("raw_url"), _one_line(r["text"]).alias("raw_body"),
        F.transform(of("date"), lambda f: F.coalesce(F.nullif(f["stamp"], F.lit("")), f["text"])).alias("dates"),
        F.transform(of("amount"), lambda f: f["text"]).alias("amounts"),
    )


def listing_pages(
    pages: DataFrame, profiles: dict[str, Profile] = PROFILES, platform: str = "source"
) -> DataFrame:
    """Every page with its rows as texts; a platform without a profile gets the generic one.

    Without a hit of a row selector all links are rows, and the page is *loose*.
    """
    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        texts = [pa.field(c, pa.string()) for c in ("text", "stamp", "link")]
        field = pa.struct([pa.field("field", pa.string()), pa.field("rank", pa.int32()), *texts])
        row = pa.struct([pa.field("text", pa.string()), pa.field("link", pa.string()), pa.field("fields", pa.list_(field))])
        kinds = [pa.int32(), pa.list_(row)]
        asked = {name: _Asked(profile) for name, profile in profiles.items()}
        generic = asked["generic_html"]
        for batch in batches:
            source, name, url, html = (batch.column(i) for i in range(4))
            found = [scan_page(h or "", u, asked.get(n, generic)) for n, u, h in zip(*(c.to_pylist() for c in (name, url, html)), strict=True)]
            made = [pa.array([page[i] for page in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([source, url, *made], ["source", "listing_url", "rank", "found"])

    scanned = pages.select("source", F.col(platform).alias("platform"), "url", "html").mapInArrow(
        parse, _PAGE_SCHEMA
    )
    return scanned.select(
        "source", "listing_url", (F.col("rank") == LOOSE).alias("loose"), F.transform("found", _row).alias("rows")
    )


def extract_listing_rows(
    pages: DataFrame,
    now: datetime,
    profiles: dict[str, Profile] = PROFILES,
    scope: R.ScopeRules = R.ScopeRules(),
    max_rows: int | None = None,
) -> DataFrame:
    """In-scope drafts of listing pages (``source``, ``url``, ``html``).

    With ``max_rows`` only the first rows of a page count. A link met again within a source does not
    count; the page first by address keeps it. Rows stay in their page's array until both is decided,
    so only the link comparison shuffles.
    """
    # Loose links are rows only when their own text is in scope.
    kept = F.filter("rows", lambda r: ~F.col("loose") | T.in_scope(r.raw_body, scope))
    if max_rows is not None:
        kept = F.slice(kept, 1, max_rows)
    found = (
        listing_pages(pages, profiles)
        .select("source", "listing_url", F.posexplode(kept).alias("position", "r"))
        .select(F.col("source").alias("source_id"), "listing_url", "position", "r.*")
        .filter(T.filled(F.col("raw_url")).isNotNull())
    )

    def first_parsed(column: str, parse: Callable[[Column], Column]) -> Column:
        return F.get(F.array_compact(F.transform(F.col(column), parse)), F.lit(0))

    dated = found.select(
        "source_id", "listing_url", "position", "raw_url", "raw_title", "raw_body",
        first_parsed("dates", lambda c: V.it_date(c)).alias("raw_date"),
        first_parsed("amounts", lambda c: V.amount(c)).alias("_amount"),
    )
    unique = first_per_key(dated, ["source_id", "raw_url"], ["listing_url", "position"])
    drafts = unique.select(
        "source_id",
        "raw_url",
        "raw_title",
        "raw_body",
        "raw_date",
        F.to_json(
            F.struct(
                F.col("source_id").alias("platform"),
                "listing_url",
                F.col("_amount").alias("importo_raw"),
                V.days_until(F.col("raw_date"), now).alias("days_until"),
            )
        ).alias("extracted_json"),
        F.col("position").cast("bigint").alias("pos"),
    )
    return gate(drafts, scope)
