"""Attached files: size limit, checksum, what is stored already."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderglow.functions import text as T
from tenderglow.functions import urls as U
from tenderglow.functions import values as V
from tenderglow.operators.landing import first_per_key

MAX_BYTES = 25 * 1024 * 1024


def _listed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def read_files(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Binary files under a folder.

    With ``max_bytes`` larger ones are left out by their listed length, unread; ``rejected_files``
    lists them.
    """
    files = _listed(spark, path)
    if max_bytes is not None:
        files = files.filter(F.col("length") <= max_bytes)
    return files.select(F.col("path").alias("url"), "content")


def rejected_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files that ``read_files`` leaves out at this limit, with size and reason; none is read."""
    return _listed(spark, path).filter(F.col("length") > max_bytes).select(
        F.col("path").alias("url"), "length",
        F.lit(f"larger than {max_bytes} bytes").alias("reason"),
    )


def object_key(record_id: Column, filename: Column, now: datetime) -> Column:
    """``records/<id>/<yyyy/mm/dd>/<name>`` with slashes taken out of the name."""
    safe = F.translate(F.coalesce(T.filled(filename), F.lit("document")), "/\\", "__")
    return F.concat_ws(
        "/", F.lit("records"), record_id.cast("string"),
        F.date_format(V.at(now), "yyyy/MM/dd"), safe,
    )


def ingest_documents(
    files: DataFrame, existing: DataFrame, now: datetime, max_bytes: int | None = None
) -> DataFrame:
    """New document rows of ``files`` (``record_id``, ``url``, ``content``, optional ``filename``,
    ``mime_type``).

    A content is stored once per record. ``max_bytes`` leaves larger contents out. Contents are hashed in the scan and do not shuffle.
    """
    have = set(files.columns)
    missing = F.lit(None).cast("string")
    mime = F.col("mime_type") if "mime_type" in have else missing
    given = T.filled(F.col("filename")) if "filename" in have else missing
    content = F.col("content").cast("binary")
    if max_bytes is not None:
        files = files.filter(F.octet_length(content) <= max_bytes)
    hashed = files.select(
        F.col("record_id").cast("string").alias("procurement_record_id"),
        F.coalesce(given, U.file_name(F.col("url"))).alias("filename"),
        mime.alias("mime_type"),
        "url",
        F.sha2(content, 256).alias("checksum"),
    )
    key = ["procurement_record_id", "checksum"]
    new = first_per_key(hashed, key, ["url", "filename"]).join(
        existing.select(*key).distinct(), key, "left_anti"
    )
    record, name = F.col("procurement_record_id"), F.col("filename")
    return new.select(
        F.sha2(F.concat_ws("|", F.lit("document"), record, "checksum"), 256).alias("id"),
        missing.alias("source_id"),
        record,
        name,
        "mime_type",
        object_key(record, name, now).alias("storage_url"),
        missing.alias("text_content"),
        "checksum",
        V.at(now).alias("created_at"),
    )
