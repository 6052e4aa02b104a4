"""Connected components by alternating large-star and small-star rounds.

Edges are rows of two longs. A round moves every node's larger neighbours to
its smallest one, then its smaller neighbours likewise, until nothing changes;
minima are aggregated before they are shuffled, and the join back to a hub's
edges is one that adaptive execution may split. Each round is written to the
shared folder, in files that follow its edges and not the shuffle's partitions.
Nothing is collected but two numbers a round and the edges' number at first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, in_few_files, stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """(node, root) for every node of an edge (u, v), root the smallest node of
    its component, roots themselves left out; and the written tables behind it."""
    spark = edges.sparkSession
    n = edges.count()
    held, path = stash(in_few_files(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), n), "edges")
    state = None
    while True:
        held, new = stash(in_few_files(_star(_star(held, True), False), n), "edges")
        discard(spark, path)
        path = new
        now = held.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return held.select(F.col("u").alias("node"), F.col("v").alias("root")), [path]
        state = now
