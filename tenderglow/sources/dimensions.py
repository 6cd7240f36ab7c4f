"""Idempotent seeding of sources, entities and watchlist."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tenderglow import rules as R
from tenderglow import schemas
from tenderglow.functions import values as V

_SOURCE_DEFAULTS = {
    "sector_scope": "illuminazione_pubblica",
    "priority": "B",
    "frequency": "daily",
    "reliability_score": 0,
    "productivity_score": 0,
    "source_priority_rank": R.UNKNOWN_RANK,
}
_WATCHLIST_DEFAULTS = {
    "frequency": "daily",
    "priority": "B",
    "reliability_score": 0.70,
    "productivity_score": 0,
    "publication_model": "html_scraping",
}


def _shaped(rows: DataFrame, schema: str, given: dict) -> DataFrame:
    """Rows under a table schema: ``given`` first, then own columns, then null."""
    have = set(rows.columns)
    return rows.select(
        *[
            given.get(f.name, F.col(f.name) if f.name in have else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in S.StructType.fromDDL(schema)
        ]
    )


def seed_sources(current: DataFrame, seed: DataFrame, now: datetime) -> DataFrame:
    """Insert sources with a new name; on known ones refresh only platform and address."""
    have = set(seed.columns)
    filled = {
        name: F.coalesce(F.col(name) if name in have else F.lit(None), F.lit(value))
        for name, value in _SOURCE_DEFAULTS.items()
    }
    made = {
        "id": F.sha2(F.concat(F.lit("source|"), F.col("name")), 256),
        "active": F.lit(True),
        "created_at": V.at(now),
        "updated_at": V.at(now),
    }
    incoming = _shaped(seed, schemas.SOURCE, filled | made)
    wanted = [f.name for f in S.StructType.fromDDL(schemas.SOURCE)]
    known = current.select("name", F.struct(*wanted).alias("cur"))
    both = known.join(incoming.select("name", F.struct(*wanted).alias("new")), "name", "full_outer")
    found, seeded = F.col("cur").isNotNull(), F.col("new").isNotNull()

    def chosen(c: str) -> Column:
        if c in ("platform_type", "base_url"):
            return F.when(seeded, F.col(f"new.{c}")).otherwise(F.col(f"cur.{c}"))
        return F.when(found, F.col(f"cur.{c}")).otherwise(F.col(f"new.{c}"))

    return both.select(*[chosen(c).alias(c) for c in wanted])


def seed_entities(current: DataFrame, seed: DataFrame, now: datetime) -> DataFrame:
    """Insert entities whose (name, region) is new; a null region equals a null region."""
    made = {
        "id": F.sha2(
            F.concat_ws("|", F.lit("entity"), "name", F.coalesce("region", F.lit("\u0000"))), 256
        ),
        "created_at": V.at(now),
        "updated_at": V.at(now),
    }
    incoming = _shaped(seed.dropDuplicates(["name", "region"]), schemas.ENTITY, made).alias("n")
    keys = current.select(F.col("name").alias("k_name"), F.col("region").alias("k_region"))
    same = (F.col("name") == F.col("k_name")) & F.col("region").eqNullSafe(F.col("k_region"))
    return current.unionByName(incoming.join(keys, same, "left_anti"))


def seed_watchlist(
    current: DataFrame, entities: DataFrame, seed: DataFrame, source_id: str | None, now: datetime
) -> DataFrame:
    """Insert a watchlist item per seed row (``name``, ``region``, ``url_albo``) that is new.

    The entity is looked up by name and region, so entities are seeded first.
    """
    by_name = entities.groupBy(F.col("name").alias("e_name"), F.col("region").alias("e_region")).agg(
        F.min("id").alias("entity_id")
    )
    same = (F.col("name") == F.col("e_name")) & F.col("region").eqNullSafe(F.col("e_region"))
    rows = seed.select("name", "region", "url_albo").join(by_name, same, "left")
    made = {
        "id": F.sha2(F.concat_ws("|", F.lit("watch"), "entity_id", "url_albo"), 256),
        "source_id": F.lit(source_id),
        "active": F.lit(True),
        "created_at": V.at(now),
        "updated_at": V.at(now),
        **{k: F.lit(v) for k, v in _WATCHLIST_DEFAULTS.items()},
    }
    incoming = _shaped(
        rows.dropDuplicates(["entity_id", "url_albo"]), schemas.WATCHLIST_ITEM, made
    )
    keys = current.select(F.col("entity_id").alias("k_entity"), F.col("url_albo").alias("k_url"))
    known = F.col("entity_id").eqNullSafe(F.col("k_entity")) & F.col("url_albo").eqNullSafe(
        F.col("k_url")
    )
    return current.unionByName(incoming.join(keys, known, "left_anti"))
