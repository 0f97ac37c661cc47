"""Connected components by alternating large-star and small-star passes over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every larger neighbour of u is linked to the least of u and its neighbours. Also the table of the minima."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """u and its smaller neighbours are linked to the least of them. Also the table of the minima."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stored(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    told = down.join(least, "u")
    return told.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))), least


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, component), stored: every node that an edge names, with the smallest node reachable from it.

    edges: two columns of one orderable type; loops, repeats, either direction and nulls are allowed (a row with
    a null names no edge). The minima combine before they are shuffled, and a hub's rows join against one row, so
    no task needs a hub's whole neighbourhood in memory. The minima are written before the join, whose two sides
    then are plain shuffles, which Spark can split at a hub. Each pass is written to the shared folder and replaces the
    one before it; passes go on until a pair of them changes nothing.
    """
    named = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    given = stored(named.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")  # once: what makes the edges may be costly
    loops = given.where("u = v").select(F.col("u").alias("node"))
    table, now = given, given.where("u <> v")
    sign = None
    while True:
        tell = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(tell) == sign or not tell.n:
            break
        sign = tuple(tell)
        large, minima = _large_star(now)
        small, minima2 = _small_star(large)
        now = stored(small.where("u <> v").distinct(), "edges")
        dropped(minima, minima2, *[table] * (table is not given))
        table = now
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    alone = loops.unionAll(now.select(F.col("v").alias("node")))
    out = stored(found.unionAll(alone.distinct().join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))), "components")
    dropped(given, *[table] * (table is not given))
    return out
