"""Helpers that the text operators share: input columns, held-out rows, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only when its counted rows times its row width stay below this.
BROADCAST_BYTES = 32 << 20

#: Bytes of one Arrow batch sent to a Python worker; bounds a worker's memory whatever the length of the texts.
BATCH_BYTES = "8m"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` alone, a null text read as empty; other columns, whatever their names, are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def text_session(spark: SparkSession, batch_bytes: str = BATCH_BYTES) -> SparkSession:
    """Settings for operators that move texts: Arrow batches bounded in bytes, and shuffle files removed with their job.

    Whatever is read twice is a stored table, so no later job needs an earlier one's shuffle files.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch_bytes)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold; a null id falls into none."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def fits(df: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> bool:
    """Whether the counted rows of ``df``, a stored table, stay below the bound; counts at most one row beyond it."""
    rows = most // row_bytes
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it fits, else as it is (a shuffled join then)."""
    return F.broadcast(df) if fits(df, row_bytes, most) else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_row(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """A semi or anti join of documents with stored ``rows`` of (doc_id, text_hash); ids may be null, other columns stay."""
    own_id, own_hash = free_name(docs, "row_id"), free_name(docs, "row_hash")
    rows = maybe_broadcast(rows.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)), 32)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(own_hash))
    return docs.join(rows, same, how)


def lower_az(text: Column) -> Column:
    """Only A-Z are lowered; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
