"""Stored helpers of searches: trigram postings for text terms, and listings in ranges for paging.

Both are written beside the records, by the job that writes those, and hold ids or rows of that version of the table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderglow.operators import search
from tenderglow.operators.search import RecordFilters

#: Fields that text terms are looked for in: ``ente`` in the first only, ``q`` in any.
FIELDS = ("ente", "descrizione", "cig")
GRAM = 3
_FENCE = "range INT, rows LONG"


def grams(text: Column, size: int = GRAM) -> Column:
    """Distinct runs of ``size`` characters of a lowered text; none if it is null or shorter."""
    places = F.sequence(F.lit(1), F.length(text) - size + 1)
    # A cut at a place counts the characters before it; one pass of a pattern doesn't, but would stop inside a surrogate pair.
    cuts = F.transform(places, lambda i: F.substring(text, i, F.lit(size)))
    runs = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))
    found = F.when(text.rlike("[^\\x{0}-\\x{FFFF}]"), cuts).otherwise(runs)
    return F.when(F.length(text) >= size, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def write_postings(records: DataFrame, path: str, ranges: int = 200) -> None:
    """One row per (field, gram, id), in files by ranges of the gram, so that a search reads few row groups.

    There are ``ranges`` files, or as many as the session's shuffles have partitions if those are more. The records are dealt out
    before their grams are made, as few files may give fewer splits than there are cores; in order, as that sorts faster.
    """
    spark = records.sparkSession
    ranges = max(ranges, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = max(ranges, spark.sparkContext.defaultParallelism)
    records = records.select("id", *FIELDS).repartitionByRange(dealt, "id").sortWithinPartitions("id")
    lists = F.array(*(F.struct(F.lit(f).alias("field"), grams(F.lower(f)).alias("grams")) for f in FIELDS))
    each = records.select("id", F.explode(lists).alias("f")).select("f.field", F.explode("f.grams").alias("gram"), "id")
    # The id in the key lets a gram that very many records have span several files.
    sorted_rows = each.repartitionByRange(ranges, "gram", "field", "id").sortWithinPartitions("gram", "field", "id")
    sorted_rows.write.mode("overwrite").parquet(path)


def term_grams(spark: SparkSession, term: str) -> list[str] | None:
    """Grams that every text matching the term has; None if it has too few plain characters in a row to have any.

    ``%`` and ``_`` in a term stand for other characters. A term with an escape is left to the scan.
    """
    if "\\" in term:
        return None
    runs = [r for r in re.split("[%_]", term) if len(r) >= GRAM]
    if not runs:
        return None
    # Lowered by Spark, as the stored texts were.
    row = spark.range(1).select(F.array_distinct(F.flatten(F.array(*(grams(F.lower(F.lit(r))) for r in runs)))).alias("g")).first()
    return row.g or None


def _holders(postings: DataFrame, fields: tuple[str, ...], wanted: list[str], rarest: int) -> DataFrame:
    """Ids of records with a field that has the rarest of the wanted grams, ``rarest`` of them at most."""
    near = postings.filter(F.col("gram").isin(wanted) & F.col("field").isin(*fields))
    counts = near.groupBy("field", "gram").count().collect()  # at most a row per field and gram of the term
    any_of = None
    for field in fields:
        sizes = {r.gram: r["count"] for r in counts if r.field == field}
        if len(sizes) < len(wanted):
            continue  # some gram stands in no record's field
        chosen = sorted(wanted, key=lambda g: (sizes[g], g))[:rarest]
        hits = near.filter((F.col("field") == field) & F.col("gram").isin(chosen))
        ids = hits.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(chosen)).select("id")
        any_of = ids if any_of is None else any_of.unionByName(ids)
    return postings.select("id").limit(0) if any_of is None else any_of.distinct()


def candidates(records: DataFrame, postings: DataFrame, filters: RecordFilters, rarest: int = 3) -> DataFrame:
    """The records that the postings leave for the text terms; all of them if the terms are too short to tell.

    ``id`` is unique in ``records``. Any subset of a term's grams gives a superset of the matches, so the filters still
    have to be applied.
    """
    out = records
    for term, fields in ((filters.ente, FIELDS[:1]), (filters.q, FIELDS)):
        wanted = term_grams(records.sparkSession, term) if term else None
        if wanted is not None:
            out = out.join(_holders(postings, fields, wanted, rarest), "id", "left_semi")
    return out


def indexed_search(records: DataFrame, postings: DataFrame, filters: RecordFilters, limit: int = 100) -> DataFrame:
    """The first page of ``search_records``, its text terms looked up in the postings."""
    return search.search_records(candidates(records, postings, filters), filters, limit).select(*records.columns)


def read_postings(spark: SparkSession, path: str, id_type: str = "STRING") -> DataFrame:
    """Stored postings; ``id_type`` is the type of the records' ids."""
    return spark.read.schema(f"field STRING, gram STRING, id {id_type}").parquet(path)


def write_listing(rows: DataFrame, path: str, ranges: int = 200) -> None:
    """Rows in listing order as at most ``ranges`` folders that follow each other, and a fence table of their sizes."""
    ordered = rows.repartitionByRange(ranges, *search.listing_order())
    ordered.withColumn("range", F.spark_partition_id()).write.mode("overwrite").partitionBy("range").parquet(f"{path}/rows")
    stored = rows.sparkSession.read.schema(_stored_schema(rows)).parquet(f"{path}/rows")
    sizes = stored.groupBy("range").agg(F.count("*").alias("rows"))
    sizes.coalesce(1).write.mode("overwrite").parquet(f"{path}/fence")


def _stored_schema(rows: DataFrame) -> str:
    return ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes), "range INT"])


def listing_page(spark: SparkSession, path: str, schema: str, limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a stored listing whose rows have ``schema``.

    The fence, one row per range, tells which folders hold them; no other is read, so a late page costs no more than an
    early one. A page beyond the end is empty.
    """
    fence = sorted(spark.read.schema(_FENCE).parquet(f"{path}/fence").collect())
    wanted, skip, passed = [], 0, 0
    for row in fence:
        if passed + row.rows > offset and passed < offset + limit:
            if not wanted:
                skip = offset - passed
            wanted.append(row.range)
        passed += row.rows
    rows = spark.read.schema(f"{schema}, range INT").parquet(f"{path}/rows")
    near = rows.filter(F.col("range").isin(wanted) if wanted else F.lit(False)).drop("range")
    ordered = near.orderBy(*search.listing_order())
    return ordered.offset(skip).limit(limit) if skip else ordered.limit(limit)
