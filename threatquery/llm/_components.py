"""Connected components by large-star / small-star rounds; nothing reaches the driver but checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatquery.llm._store import Tables


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(u, v): every vertex u of ``links`` (u, v) that isn't the least of its component, with that least one v.

    A round takes the least neighbour by a partial aggregate and joins it back,
    so that a vertex with very many links is summed before the shuffle, and its
    side of the join can be split.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    edges = tables.write(edges, f"{name}-0")
    before, k = _sum(edges), 0
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = tables.write(small.where("u > v").distinct(), f"{name}-{k + 1}")
        tables.drop(f"{name}-{k}")
        after, k = _sum(edges), k + 1
        if after == before:
            break
        before = after
    return edges
