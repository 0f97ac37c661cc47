"""Mixing sources to target weights by entropy balancing; DataFrame operations only.

Rates solve  min sum(b * kl(rate))  under one token constraint for each source, sum(size * rate) = target, and
0 <= rate <= cap. The dual is convex with one multiplier for each source, and its solution tilts exponentially:
rate = min(cap, exp(lambda * size / mean size)). Since a rate depends on source and size only, the Newton iterations
run over the table of (source, size) counts, all sources at once, with bisection wherever a step leaves its bracket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, dropped, stored

UNIT = 1_000_000  # rates are whole millionths, so that prefix sums are exact and reruns agree
ROWS_A_BUCKET = 2_000
BUCKETS_A_GROUP = 4_000


def words(text: str = "text"):
    return F.when(F.col(text).isNull(), 0).otherwise(F.regexp_count(F.col(text), F.lit(WORD))).cast("long")


def targets(cells: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target): `share` of all words by weight, none above cap * source_size, the excess reshared.

    Weights repeat over the sources by code point, null last. Resharing until no source is above its limit is water
    filling: with sources by limit/weight, the first k are at their limits and the rest at a common level.
    One row a source reaches these windows.
    """
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    at = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int"))
    s = sources.withColumn("w", weight).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    every = Window.partitionBy(F.lit(0))
    up = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # the level holds from the first source that it leaves below its limit
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.struct(F.col("limit") / F.col("w"), "level"))).over(every)["level"]
    return s.select("source", "source_size", F.least(F.coalesce(level * F.col("w"), F.col("limit")), F.col("limit")).alias("target"))


def rates(cells: DataFrame, goals: DataFrame, cap: float = 2.0, rounds: int = 60, close: float = 1e-9) -> DataFrame:
    """(source, size, n, source_size, target, rate): whole millionths for each cell, from the dual's solution."""
    mean = Window.partitionBy("source")
    x = F.try_divide(F.col("size") * F.sum("n").over(mean), F.sum(F.col("size") * F.col("n")).over(mean))
    base = stored(cells.join(goals, F.col("cells.source").eqNullSafe(F.col("goals.source"))).select("cells.source", "size", "n", "source_size", "target").withColumn("x", x).withColumn("x", F.coalesce("x", F.lit(0.0))), "cells")
    # at rate cap everywhere the total is cap * size; a target there, or at 0, needs no finite multiplier
    state = stored(goals.select("source", "target", "source_size", F.lit(0.0).alias("lam"), F.lit(-64.0).alias("lo"), F.lit(4096.0).alias("hi"), F.lit(False).alias("done")), "multipliers")
    top = F.log(F.lit(float(cap)))
    for _ in range(rounds):
        tilted = base.join(state.select(F.col("source").alias("s"), "lam"), F.col("source").eqNullSafe(F.col("s")))
        e = F.col("lam") * F.col("x")
        mass = F.col("n") * F.col("size")
        sums = tilted.groupBy("source").agg(
            F.sum(mass * F.exp(F.least(e, top))).alias("total"),
            F.sum(F.when(e < top, mass * F.col("x") * F.exp(e)).otherwise(0.0)).alias("slope"),
        ).withColumnRenamed("source", "s")
        off = F.col("total") - F.col("target")
        done = (F.abs(off) <= close * F.greatest(F.col("source_size"), F.lit(1))) | (F.col("hi") - F.col("lo") < 1e-13 * F.greatest(F.lit(1.0), F.abs("lam")))
        lo = F.when(off < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - F.try_divide(off, F.col("slope"))
        new = F.when(F.col("slope") > 0, F.when((step > lo) & (step < hi), step)).otherwise(None)
        moved = state.join(sums, F.col("source").eqNullSafe(F.col("s"))).withColumn("done", done).withColumn("lo2", lo).withColumn("hi2", hi).withColumn("new", F.coalesce(new, (F.col("lo2") + F.col("hi2")) / 2))
        before = state
        state = stored(moved.select("source", "target", "source_size", F.when(F.col("done"), F.col("lam")).otherwise(F.col("new")).alias("lam"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), "done"), "multipliers")
        dropped(before)
        if state.where("NOT done").isEmpty():
            break
    fixed = base.join(state.select(F.col("source").alias("s"), F.round("lam", 7).alias("lam")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.floor(F.exp(F.least(F.col("lam") * F.col("x"), top)) * UNIT + 0.5).cast("long")
    return fixed.select("source", "size", "n", "source_size", "target", rate.alias("rate"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of docs (doc_id, text, source).

    size counts runs of bytes other than ASCII white space (null or blank text: 0). A null source is a source. Rates
    become copies by systematic rounding: within a source, documents stand by size, then by a hash of the id, and a
    document takes one more copy wherever the running sum of its rate's fraction passes a whole number. So a source's
    words miss its target by about one document, however few it has. Running sums are built in four levels (sizes of a
    source, groups of hash buckets of a size, buckets of a group, documents of a bucket), so no window holds more rows than
    a source has sizes, a size has groups (documents / 8,000,000), a group has buckets, or a bucket has documents. Rows that agree in id, source and size share one bucket, in any order.
    """
    d = stored(docs.select("doc_id", "source", words().alias("size")), "sizes")
    cells = stored(d.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    tilted = stored(rates(cells.alias("cells"), targets(cells, weights, share, cap).alias("goals"), cap), "rates")
    total = tilted.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, total // ROWS_A_BUCKET)
    d = d.withColumn("h", F.xxhash64("doc_id")).withColumn("b", F.pmod("h", F.lit(buckets)))
    part = F.col("rate") % UNIT
    up = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    starts = tilted.withColumn("part", part).withColumn("before", F.coalesce(F.sum(F.col("part") * F.col("n")).over(up), F.lit(0)))
    counted = d.groupBy("source", "size", "b").agg(F.count("*").alias("k")).withColumn("g", F.floor(F.col("b") / BUCKETS_A_GROUP))
    over_groups = Window.partitionBy("source", "size").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = counted.groupBy("source", "size", "g").agg(F.sum("k").alias("k")).withColumn("base", F.coalesce(F.sum("k").over(over_groups), F.lit(0))).drop("k").alias("g")
    within = Window.partitionBy("source", "size", "g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    inside = counted.withColumn("inside", F.coalesce(F.sum("k").over(within), F.lit(0))).alias("c")
    c = inside.join(groups, F.col("c.source").eqNullSafe(F.col("g.source")) & (F.col("c.size") == F.col("g.size")) & (F.col("c.g") == F.col("g.g")))
    c, s = c.select("c.source", "c.size", "b", (F.col("inside") + F.col("base")).alias("ahead")).alias("c"), starts.alias("s")
    at = c.join(s, F.col("c.source").eqNullSafe(F.col("s.source")) & (F.col("c.size") == F.col("s.size"))).select("c.source", "c.size", "c.b", "ahead", "before", "rate", "part", "source_size", "target")
    ranked = d.withColumn("at", F.row_number().over(Window.partitionBy("source", "size", "b").orderBy("h", "doc_id"))).alias("d")
    at = at.alias("a")
    joined = ranked.join(at, F.col("d.source").eqNullSafe(F.col("a.source")) & (F.col("d.size") == F.col("a.size")) & (F.col("d.b") == F.col("a.b")))
    end = F.col("before") + (F.col("ahead") + F.col("at")) * F.col("part") + UNIT // 2
    more = F.floor(end / F.lit(UNIT)) - F.floor((end - F.col("part")) / F.lit(UNIT))
    copies = F.expr(f"rate div {UNIT}") + more
    return joined.select("doc_id", "d.source", "d.size", "source_size", "target", copies.cast("long").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, with all its columns. Rows that agree in id, source and size are taken alike."""
    per = mixed(docs).groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).where("copies > 0")
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.col("source").alias("own_source"), words().alias("own_size"))
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & F.col("own_source").eqNullSafe(F.col("source")) & (F.col("own_size") == F.col("size"))
    return packed.join(per, same).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
