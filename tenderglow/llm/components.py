"""Connected components of links, by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderglow.session import cut_lineage


def _least(edges: DataFrame) -> DataFrame:
    """Edges ``u, v`` in both directions with ``m``, the least of ``u`` and its neighbours. Minima combine before the shuffle."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(low, "u")


def connect(spark: SparkSession, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``doc_id, component_id`` (least id reachable) for every document of ``links`` (a, b).

    Each round is stored in the shared folder, and only one truth value reaches the driver: the rounds end when each
    document is linked to a document that is itself linked to no smaller one.
    """
    edges = cut_lineage(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct())
    for _ in range(most_rounds):
        # Every larger neighbour is linked to the least one; then the smaller neighbours of each document, and itself, are
        # linked to the least of them.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        down = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        small = _least(down)
        joined = small.select(F.col("v").alias("v"), F.col("m").alias("u")).unionByName(small.select(F.col("u").alias("v"), F.col("m").alias("u")))
        edges = cut_lineage(joined.where("u < v").distinct())
        if edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("doc_id")).distinct().withColumn("component_id", F.col("doc_id"))
    return cut_lineage(edges.select(F.col("v").alias("doc_id"), F.col("u").alias("component_id")).unionByName(roots))


def extend(spark: SparkSession, labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after more links: the components are the documents of a smaller graph."""
    def named(df: DataFrame, column: str) -> DataFrame:
        own = labels.select(F.col("doc_id").alias(column), F.col("component_id").alias(f"_{column}"))
        return df.join(own, column, "left").withColumn(f"_{column}", F.coalesce(f"_{column}", column))

    mapped = cut_lineage(named(named(links, "a"), "b"))
    top = connect(spark, mapped.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).toDF("component_id", "top")
    fresh = mapped.select(F.explode(F.array(F.struct(F.col("a").alias("doc_id"), F.col("_a").alias("component_id")),
                                            F.struct(F.col("b").alias("doc_id"), F.col("_b").alias("component_id")))).alias("x"))
    every = labels.unionByName(fresh.select("x.*")).distinct()
    return cut_lineage(every.join(top, "component_id", "left").select("doc_id", F.coalesce("top", "component_id").alias("component_id")))
