"""Merging a batch of notices into the record table.

The rows of one tender are meant to be applied one after another, in ``(fetched_at, raw_id)``
order: the first opens the record, later ones fill its gaps. Here that fold is one aggregate of
order-aware minima and maxima, so it combines map-side and needs no per-tender loop.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tenderglow import rules as R
from tenderglow import schemas
from tenderglow.functions import text as T
from tenderglow.functions import values as V
from tenderglow.operators import joins
from tenderglow.operators.normalise import novelty
from tenderglow.session import cut_lineage

# Filled once, from the first notice that has a value.
GAP_TEXTS = (
    "descrizione", "cig", "regione", "provincia", "comune", "tipologia_gara_procedura",
    "tipo_strumento",
)
GAP_DATES = ("data_pubblicazione", "scadenza")
# Taken from the notice that opened the record and never changed.
OPENING = ("ente", "link_bando", "source_priority_rank", "is_weak_evidence", "macrosettore")

_ORDER = ("fetched_at", "raw_id")

# What to do with an intermediate table that is read more than once.
Keep = Callable[[DataFrame], DataFrame]


def record_id(link: Column) -> Column:
    """Deterministic id of a record opened for a link, equal across retries and re-runs."""
    return F.sha2(F.concat(F.lit("record|"), link), 256)


def _order() -> Column:
    return F.struct(*_ORDER)


def _oldest_per(current: DataFrame, key: str, *extra: str) -> DataFrame:
    """One current record per key value, the oldest, whatever the number of candidates."""
    row = F.min_by(F.struct("id", *extra), F.struct("first_seen_at", "id"))
    return (
        current.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(row.alias("_r"), F.count("*").alias("candidates"))
        .select(key, F.col("_r.id").alias("id"), *[F.col(f"_r.{e}").alias(e) for e in extra],
                "candidates")
    )


def key_collisions(current: DataFrame) -> DataFrame:
    """Links and CIGs held by several current records, where the oldest one is merged into."""
    parts = [
        _oldest_per(current, key).filter("candidates > 1").select(
            F.lit(key).alias("key_kind"), F.col(key).alias("key_value"), "id", "candidates"
        )
        for key in ("link_bando", "cig")
    ]
    return parts[0].unionByName(parts[1])


def match_existing(batch: DataFrame, current: DataFrame) -> DataFrame:
    """Distinct (link, cig) pairs of the batch with the current record each one hits.

    Link first, CIG second. Works on pairs, so repeats of a notice cost nothing in the joins, and
    on the current records whose key is in the batch at all: for a batch small enough to
    broadcast the record table is filtered in the scan and not shuffled.
    """
    pairs = batch.groupBy("link_bando", "cig").agg(
        F.min(_order()).alias("t"), F.count("*").alias("n")
    )

    def asked(key: str) -> DataFrame:
        keys = pairs.select(key).filter(F.col(key).isNotNull()).distinct()
        return current.join(keys, key, "left_semi")

    by_link = _oldest_per(asked("link_bando"), "link_bando", "cig").select(
        "link_bando", F.col("id").alias("id_by_link"), T.filled(F.col("cig")).alias("held_cig")
    )
    by_cig = _oldest_per(asked("cig"), "cig").select("cig", F.col("id").alias("id_by_cig"))
    linked = pairs.join(by_link, "link_bando", "left")
    return joins.lookup(linked, by_cig, "cig", spread_by="link_bando")


def _links(pairs: DataFrame) -> DataFrame:
    """One row per link of ``pairs``: its notices ``n``, its first one without CIG at ``z``, the first that names one, and its record."""
    named = F.col("cig").isNotNull()
    return pairs.groupBy("link_bando").agg(
        F.sum("n").alias("n"), F.min(F.when(~named, F.col("t"))).alias("z"), F.min(F.when(named, F.struct("t", "cig"))).alias("named"),
        F.max("id_by_link").alias("id_by_link"), F.max("held_cig").alias("held_cig"))


def _brought(pairs: DataFrame, links: DataFrame, batch: DataFrame) -> DataFrame:
    """When which link could take which CIG, ``link_bando, cig, t, z, id_by_link``: at most one row per link and CIG.

    A link without a record opens one with the first notice whose CIG nobody holds, or with its first notice without a CIG, at
    ``z``; in that case its record takes the CIG of the next notice that has one. A stored record without CIG takes the first.
    CIGs that a stored record holds are out of the question.
    """
    bare = links.filter(F.col("id_by_link").isNull() & F.col("z").isNotNull()).select("link_bando", "z")
    new = pairs.filter(F.col("cig").isNotNull() & F.col("id_by_link").isNull()).select("link_bando", "cig", "t")
    early = new.join(bare, "link_bando", "left").filter(F.col("z").isNull() | (F.col("t") < F.col("z")))
    # What comes after z: the link's first CIG tells it, unless that was there before z and may return.
    open_links = links.filter(F.col("link_bando").isNotNull() & F.col("named").isNotNull())
    bare_named = open_links.filter(F.col("id_by_link").isNull() & F.col("z").isNotNull())
    returning = bare_named.filter(F.col("named.t") < F.col("z")).select("link_bando", "z")
    seen = batch.filter(F.col("cig").isNotNull()).select("link_bando", "cig", _order().alias("t"))
    seen = seen.join(returning, "link_bando").filter(F.col("t") > F.col("z"))
    seen = seen.groupBy("link_bando").agg(F.min(F.struct("t", "cig")).alias("named"), F.first("z").alias("z"))
    plain = bare_named.filter(F.col("named.t") > F.col("z"))
    stored = open_links.filter(F.col("id_by_link").isNotNull() & F.col("held_cig").isNull())
    no_id, no_time = F.lit(None).cast("string"), F.lit(None).cast(pairs.schema["t"].dataType)

    def rows(of: DataFrame, z: Column, record: Column, at: str = "named.") -> DataFrame:
        return of.select("link_bando", F.col(f"{at}cig").alias("cig"), F.col(f"{at}t").alias("t"), z.alias("z"), record.alias("id_by_link"))

    z = F.col("z")
    out = rows(early, z, no_id, "").unionByName(rows(seen, z, no_id)).unionByName(rows(plain, z, no_id))
    out = out.unionByName(rows(stored, no_time, F.col("id_by_link")))
    free = pairs.filter(F.col("cig").isNotNull() & F.col("id_by_cig").isNotNull()).select("cig").distinct()
    return out.join(free, "cig", "left_anti")


def first_come(pairs: DataFrame, keep: Keep = cut_lineage, rounds: int = 12) -> DataFrame:
    """The rows of ``pairs`` (link_bando, cig, t, …) that are taken when each, in the order of ``t``, is taken if neither its link nor its CIG is.

    A row that is the first one both of its link and of its CIG is certain; it rules out the others of either. Rounds of this decide
    almost all rows at once, whatever the size of a component. What is left after them are long chains, each row waiting
    for the one before; those are replayed in order, a component after the other, over rows that come sorted.
    """
    left, taken = keep(pairs), []
    for _ in range(rounds):
        by_link = left.groupBy("link_bando").agg(F.min_by(F.struct(*[c for c in left.columns if c != "link_bando"]), "t").alias("r"))
        by_cig = left.groupBy("cig").agg(F.min_by("link_bando", "t").alias("link_bando"))
        won = keep(by_link.select("link_bando", "r.*").join(by_cig, ["link_bando", "cig"]).select(*left.columns))
        taken.append(won)
        left = keep(left.join(won.select("link_bando"), "link_bando", "left_anti").join(won.select("cig"), "cig", "left_anti").select(*left.columns))
        if left.isEmpty():
            break
    else:
        taken.append(keep(_replayed(left, keep)))
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out


def _replayed(left: DataFrame, keep: Keep) -> DataFrame:
    """``first_come`` by going through the rows of each component of links and CIGs in order."""
    edges = keep(left.select(F.xxhash64(F.lit("l"), "link_bando").alias("a"), F.xxhash64(F.lit("c"), "cig").alias("b")).distinct())
    both = keep(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    while True:
        # The least label among the neighbours, then the label of one's label: the way is halved each time.
        near = both.join(label.select(F.col("a").alias("b"), "m"), "b").groupBy("a").agg(F.min("m").alias("n"))
        low = keep(label.join(near, "a").select("a", F.least("m", "n").alias("m"), F.col("m").alias("was")))
        jump = low.select(F.col("a").alias("m"), F.col("m").alias("up"))
        low = keep(low.join(jump, "m").select("a", F.least("m", "up").alias("m"), "was"))
        label = low.select("a", "m")
        if low.filter(F.col("m") != F.col("was")).isEmpty():
            break
    rows = left.withColumn("a", F.xxhash64(F.lit("l"), "link_bando")).join(label, "a").drop("a")
    ordered = rows.repartition("m").sortWithinPartitions("m", "t")
    kept = [c for c in ordered.columns if c != "m"]

    def run(batches):
        import pyarrow as pa

        own, links, cigs = None, set(), set()
        for batch in batches:
            free = []
            for m, link, cig in zip(*(batch.column(c).to_pylist() for c in ("m", "link_bando", "cig")), strict=True):
                if m != own:
                    own, links, cigs = m, set(), set()
                free.append(link not in links and cig not in cigs)
                if free[-1]:
                    links.add(link)
                    cigs.add(cig)
            yield batch.select(kept).filter(pa.array(free, pa.bool_()))

    return ordered.mapInArrow(run, left.select(*kept).schema).select(*left.columns)


def resolve_targets(batch: DataFrame, current: DataFrame, keep: Keep = cut_lineage) -> tuple[DataFrame, DataFrame]:
    """What decides where notices go: a row per link (``link_bando, n, id_by_link, opened_at``) and one per held CIG (``cig, holder_id, holder``).

    Besides the current records this follows what the batch itself opens. A CIG is *held* by the first record that takes it; a
    notice without a record for its link joins the holder of its CIG when that came earlier, and opens a record otherwise. Once
    opened, at ``opened_at``, a link takes all its later notices. A holder is a stored record's id or the link that opens one.

    Each link opens at most one record and each CIG has one first holder, so this is a matching of links and CIGs by order of
    arrival (``first_come``), and equal to applying the notices one by one, whatever CIGs a link brings.
    """
    pairs = keep(match_existing(batch, current))
    links = keep(_links(pairs))
    taken = keep(first_come(_brought(pairs, links, batch), keep))
    new = F.col("id_by_link").isNull()
    none = F.lit(None).cast("string")
    stored = pairs.filter(F.col("cig").isNotNull() & F.col("id_by_cig").isNotNull()).select("cig", F.col("id_by_cig").alias("holder_id"), none.alias("holder"))
    holders = taken.select("cig", F.col("id_by_link").alias("holder_id"), F.when(new, F.col("link_bando")).alias("holder"))
    # A link without a record opens one with the CIG it takes before z, or at z.
    opening = taken.filter(new & (F.col("z").isNull() | (F.col("t") < F.col("z")))).select("link_bando", F.col("t").alias("o"))
    opened = F.when(new, F.coalesce("o", "z")).alias("opened_at")
    return links.join(opening, "link_bando", "left").select("link_bando", "n", "id_by_link", opened), holders.unionByName(stored.distinct())


def _placed(batch: DataFrame, current: DataFrame, hot_rows: int, keep: Keep) -> DataFrame:
    """The batch with ``_id``, the stored record that takes a notice, or else ``_link``, the link whose record the batch opens.

    A link's own row settles its notices unless they come before it has a record; only those look up who holds their CIG.
    Both parts start from the same join, whose shuffle Spark runs once. Links of very many notices do not meet in one task.
    """
    links, holders = (keep(df) for df in resolve_targets(batch, current, keep))
    out = joins.attach(batch, links, "link_bando", group_size="n", spread_by="raw_id", hot_rows=hot_rows)
    # One expression, so that neither part is filtered ahead of the join.
    settled = F.when(F.col("id_by_link").isNotNull(), True).when(_order() >= F.col("opened_at"), True).otherwise(F.col("cig").isNull())
    opener = F.when(F.col("opened_at").isNotNull(), F.col("link_bando"))
    by_link = out.filter(settled).select(
        *batch.columns, F.col("id_by_link").alias("_id"), F.when(F.col("id_by_link").isNull(), opener).alias("_link"))
    rest = joins.lookup(out.filter(~settled), holders, "cig", spread_by="raw_id")
    by_cig = rest.select(
        *batch.columns, F.col("holder_id").alias("_id"), F.when(F.col("holder_id").isNull(), F.coalesce("holder", opener)).alias("_link"))
    return by_link.unionByName(by_cig)


def assign_targets(
    batch: DataFrame, current: DataFrame, hot_rows: int = joins.HOT_ROWS, keep: Keep = cut_lineage
) -> DataFrame:
    """The batch with ``target_id`` and whether that record is ``opened`` by the batch."""
    out = _placed(batch, current, hot_rows, keep)
    opened = F.when(F.col("_id").isNotNull(), False).when(F.col("_link").isNotNull(), True)
    return out.select(*batch.columns, F.coalesce("_id", record_id(F.col("_link"))).alias("target_id"), opened.alias("opened"))


def _tag_mask(tags: Column, vocabulary: tuple[str, ...]) -> Column:
    mask = F.lit(0)
    for i, label in enumerate(vocabulary):
        mask = mask + F.when(F.array_contains(tags, label), 1 << i).otherwise(0)
    return mask


def _tags_of(mask: Column, vocabulary: tuple[str, ...]) -> Column:
    return F.array_compact(
        F.array(*[
            F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, label) for i, label in enumerate(vocabulary)
        ])
    )


def fold_batch(batch: DataFrame, tag_rules: R.TagRules = R.TagRules()) -> DataFrame:
    """One row per target: first, first usable, largest and last values of its notices.

    A record that the batch opens is grouped by its link (``_link``) and gets its longer id afterwards.
    """
    order = _order()
    tagged = F.size("tag_tecnico") > 0
    aggregates = [
        F.count("*").alias("n_rows"),
        F.min_by(
            F.struct(
                *OPENING, "importo", "tag_tecnico", F.col("data_pubblicazione").alias("published")
            ),
            order,
        ).alias("first"),
        F.max_by(F.struct("stato_procedurale", "reliability_index"), order).alias("last"),
        *[F.max(f).alias(f) for f in R.FLAGS],
        F.max("validation_level").alias("validation_level"),
        F.min_by("importo", F.when(F.col("importo") != 0, order)).alias("importo"),
        F.bit_or(_tag_mask(F.col("tag_tecnico"), tag_rules.vocabulary)).alias("tag_mask"),
        F.count_if(tagged).alias("n_tagged"),
    ]
    aggregates += [
        F.min_by(c, F.when(F.col(c) != "", order)).alias(c) for c in GAP_TEXTS
    ]
    aggregates += [
        F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in GAP_DATES
    ]
    return (
        batch.groupBy("_id", "_link")
        .agg(*aggregates)
        .withColumn("batch_tags", _tags_of(F.col("tag_mask"), tag_rules.vocabulary))
        .withColumn("opened", F.when(F.col("_id").isNotNull(), False).when(F.col("_link").isNotNull(), True))
        .drop("tag_mask")
    )


def merge(current: DataFrame, folded: DataFrame, now: datetime) -> DataFrame:
    """Current records with the batch merged in, plus the records it opens.

    The updated part is a left join from the record table, so a batch that Spark finds small
    enough is broadcast and the table is not shuffled. New records are known as such since their
    target was resolved, so finding them takes no second look at the table.
    """
    updated = _updated(current, folded.filter(~F.col("opened")), now)
    return updated.unionByName(insert_new(folded.filter("opened"), now))


def _updated(current: DataFrame, folded: DataFrame, now: datetime) -> DataFrame:
    f = folded.select(F.col("_id").alias("target_id"), F.struct(*folded.columns).alias("f"))
    hit = F.col("target_id").isNotNull()
    now_col = V.at(now)

    def gap(name: str) -> Column:
        own = F.col(name)
        if name in GAP_TEXTS:
            own = T.filled(own)
        return F.coalesce(own, F.col(f"f.{name}"), F.col(name))

    state = F.coalesce("f.last.stato_procedurale", "stato_procedurale")
    union_tags = F.array_sort(F.array_union(T.tag_list(F.col("tag_tecnico")), F.col("f.batch_tags")))
    changed: dict[str, Column] = {c: gap(c) for c in (*GAP_TEXTS, *GAP_DATES, "importo")}
    changed |= {
        flag: F.when(F.col(f"f.{flag}") == R.YES, R.YES).otherwise(F.col(flag)) for flag in R.FLAGS
    }
    changed |= {
        "stato_procedurale": state,
        "tipo_novita": F.when(
            hit, F.when(state == R.PRE_TENDER, R.PRE_TENDER_SIGNAL).otherwise(R.KNOWN_UPDATE)
        ).otherwise(F.col("tipo_novita")),
        "tag_tecnico": F.when(F.col("f.n_tagged") > 0, T.tag_text(union_tags)).otherwise(
            F.col("tag_tecnico")
        ),
        "validation_level": F.when(
            hit, F.greatest(F.coalesce("validation_level", F.lit("L1")), "f.validation_level")
        ).otherwise(F.col("validation_level")),
        "reliability_index": F.coalesce("f.last.reliability_index", "reliability_index"),
        "last_seen_at": F.when(hit, now_col).otherwise(F.col("last_seen_at")),
        "updated_at": F.when(hit, now_col).otherwise(F.col("updated_at")),
    }
    return current.join(f, current["id"] == f["target_id"], "left").select(
        *[changed.get(c, F.col(c)).alias(c) for c in current.columns]
    )


def insert_new(folded: DataFrame, now: datetime) -> DataFrame:
    """Folded batch rows as new records."""
    now_col = V.at(now)
    state = F.col("last.stato_procedurale")
    merges = F.col("n_tagged") - F.when(F.size("first.tag_tecnico") > 0, 1).otherwise(0)
    tags = F.when(merges > 0, F.array_sort("batch_tags")).otherwise(F.col("first.tag_tecnico"))
    made: dict[str, Column] = {c: F.col(c) for c in (*GAP_TEXTS, *GAP_DATES, *R.FLAGS)}
    made |= {c: F.col(f"first.{c}") for c in OPENING}
    made |= {
        "id": record_id(F.col("_link")),
        "importo": F.coalesce("first.importo", "importo"),
        "stato_procedurale": state,
        "tipo_novita": novelty(
            state, F.col("n_rows") > 1, now_col, F.col("first.published"), now
        ),
        "tag_tecnico": T.tag_text(tags),
        "validation_level": F.col("validation_level"),
        "reliability_index": F.col("last.reliability_index"),
        "first_seen_at": now_col,
        "last_seen_at": now_col,
        "created_at": now_col,
        "updated_at": now_col,
    }
    wanted = S.StructType.fromDDL(schemas.RECORD)
    return folded.select(
        *[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]
    )


def new_keys(current: DataFrame, folded: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """What a folded batch adds to the keys of the records: the records it opens, and the CIGs (``id, cig``) that stored ones take."""
    bare = current.filter(T.filled(F.col("cig")).isNull()).select("id")
    given = folded.filter(~F.col("opened") & F.col("cig").isNotNull()).select(F.col("_id").alias("id"), "cig")
    return insert_new(folded.filter("opened"), now), given.join(bare, "id")


def folded(
    batch: DataFrame,
    current: DataFrame,
    *,
    tag_rules: R.TagRules = R.TagRules(),
    hot_rows: int = joins.HOT_ROWS,
    keep: Keep = cut_lineage,
) -> DataFrame:
    """The batch, a stored table, as one kept row per record that it opens or goes to."""
    return keep(fold_batch(_placed(batch, current, hot_rows, keep), tag_rules))


def upsert(
    batch: DataFrame,
    current: DataFrame,
    now: datetime,
    *,
    tag_rules: R.TagRules = R.TagRules(),
    hot_rows: int = joins.HOT_ROWS,
    keep: Keep = cut_lineage,
) -> DataFrame:
    """Whole step: resolve, fold, merge.

    Notices, key pairs, targets and the folded batch are each read several times; ``keep`` stores them, so that each is
    computed once and the record table is scanned three times (by link, by CIG, for the merge).
    """
    return merge(current, folded(keep(batch), current, tag_rules=tag_rules, hot_rows=hot_rows, keep=keep), now)
