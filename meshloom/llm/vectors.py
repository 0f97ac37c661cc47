"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells, one representative a group.

Equal vectors collapse first. Each vector has a home cell, that of its nearest centroid, and visits every other cell in
which a link may await it; a cell's homes are compared with each other and with its visitors. Let `near` be a vector's
angle to its home's centroid. Of two linked vectors x and y with near(x) <= near(y), the angle between y and x's centroid
is at most near(x) + margin, where the margin is the angle that links span, acos(least). So y visits the cells whose
centroid is no farther than margin + the lesser of near(y) and the greatest near of the cell's homes, and no link is
lost, whatever the cells are. A pair counts where y visits x, and there only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, gathered, mapped, runs, stored
from .components import components

CELL = 4096
MOST_CELLS = 4096
SAMPLE = 20_000
HOMES, VISITORS = 4096, 8192
SLACK = 1e-6  # of angles, for rounding


def _fit(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means: unit centroids by largest cosine; an empty cell keeps its centroid."""
    rng = np.random.Generator(np.random.PCG64(10))
    c = x[np.sort(rng.permutation(len(x))[:k])].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[at : at + 4096] @ c.T).argmax(axis=1) for at in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of doubles, shorter ones followed by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = column.offsets.to_numpy().astype(np.int64)
    size = np.diff(ends)
    out = np.zeros((len(size), dims))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(size.sum()) - np.repeat(ends[:-1] - ends[0], size)] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of very large or small components leave the range of doubles
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: str = "embedding"):
    v = F.col(vector)
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _deal():
    """Block pairs that a row of a cell goes to, as (pair, side): side 0 left and right, 1 left, 2 right."""
    own = F.pmod(F.xxhash64("vec_id"), F.when(F.col("home") == F.col("cell"), F.col("nh")).otherwise(F.col("nv")))
    base = lambda i, j: i * (F.col("nh") + F.col("nv")) + j
    of_home = F.concat(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("nh") - 1), lambda j: F.struct(base(F.least(own, j), F.greatest(own, j)).alias("pair"), F.when(own == j, 0).when(own < j, 1).otherwise(2).alias("side"))),
        F.when(F.col("nv") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("nv") - 1, F.lit(0))), lambda j: F.struct(base(own, F.col("nh") + j).alias("pair"), F.lit(1).alias("side")))).otherwise(F.array()),
    )
    of_visitor = F.transform(F.sequence(F.lit(0).cast("long"), F.col("nh") - 1), lambda i: F.struct(base(i, F.col("nh") + own).alias("pair"), F.lit(2).alias("side")))
    return F.when(F.col("home") == F.col("cell"), of_home).otherwise(of_visitor)


def _compare(least: float, dims: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["cell", "pair"]):
            side = t.column("side").to_numpy()
            same = bool((side == 0).all())
            left, right = (np.arange(len(side)),) * 2 if same else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
            if not len(left) or not len(right):
                continue
            ids, mult, near = (t.column(k).to_numpy() for k in ("vec_id", "mult", "near"))
            guest = t.column("guest").to_numpy(zero_copy_only=False)
            x = _unit(_matrix(t.column("v"), dims))
            label = np.empty(len(ids), np.int64)  # of the least id, by rank
            by_rank = np.argsort(ids, kind="stable")
            label[by_rank] = np.arange(len(ids))
            count = np.zeros(len(ids), np.int64)
            y = np.ascontiguousarray(x[right].T)
            for at in range(0, len(left), 256):
                rows, first = left[at : at + 256], at + 1 if same else 0
                m = x[rows] @ y[:, first:] >= least
                on, cols = np.flatnonzero(m.any(axis=1)), np.flatnonzero(m.any(axis=0))
                if not len(on):
                    continue
                m, r, c = m[np.ix_(on, cols)], rows[on], right[first:][cols]
                if same:
                    m &= c[None, :] > r[:, None]
                else:
                    m &= ~guest[c][None, :] | (near[r][:, None] < near[c][None, :]) | ((near[r][:, None] == near[c][None, :]) & (ids[r][:, None] < ids[c][None, :]))
                count[r] += m @ mult[c]
                count[c] += mult[r] @ m
                for k in np.flatnonzero(m.any(axis=1)).tolist():
                    met = np.unique(np.append(label[c[m[k]]], label[r[k]]))
                    if len(met) > 1:
                        label[np.isin(label, met[1:])] = met[0]
            on = np.flatnonzero(count)
            if len(on):
                yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(ids[by_rank[label[on]]]), pa.array(count[on])], names=["u", "v", "n"])

    return kernel


def near_vectors(vectors: DataFrame, least: float = 0.9, margin: float | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding).

    Vectors are linked where their cosine, in double precision, is `least` or more; n_links counts the other rows a row
    is linked with, component_id is the smallest vec_id reachable. Vectors that are null or zero, or hold null or
    non-finite components, are linked with nothing, nor is a row without an id (its component is null). Shorter
    vectors compare as if zeros followed. Repeated rows are copies like others. k-means is fitted to SAMPLE vectors at
    most; all are assigned. Centroids (one for CELL vectors, MOST_CELLS at most) are broadcast. A cell of more vectors
    than a block is compared in block pairs, from which counts and a spanning forest of links leave, not links. All links
    are found; a margin (in radians) of less than acos(least) visits fewer cells and may lose some.
    """
    margin = float(np.arccos(np.clip(least, -1, 1))) + SLACK if margin is None else margin
    spark = vectors.sparkSession
    v = F.col("embedding") if vectors.schema["embedding"].dataType.simpleString() in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v"))
    good = F.coalesce(usable("v") & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = stored(rows.select("vec_id", F.when(good, F.col("v")).alias("v")), "vectors")
    classes = stored(rows.where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("mult"), F.min("vec_id").alias("vec_id")), "classes")
    n, dims = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        alone = F.when(F.col("vec_id").isNotNull(), F.col("vec_id"))
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), alone.alias("component_id"), (F.col("vec_id") == alone).alias("kept"))
    share = F.pmod(F.xxhash64("vec_id", F.lit(10)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE / n)))
    sample = classes.where(share).select("vec_id", "v").toArrow().sort_by("vec_id")
    if not sample.num_rows:
        sample = classes.select("vec_id", "v").limit(1).toArrow()
    centroids = spark.sparkContext.broadcast(_fit(_unit(_matrix(sample.column("v"), dims)), max(1, min(MOST_CELLS, n // CELL, sample.num_rows))))
    seen = pa.list_(pa.struct([("cell", pa.int64()), ("angle", pa.float64())]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                angle = np.arccos(np.clip(_unit(_matrix(part.column("v"), dims)) @ c.T, -1, 1))
                home, near = angle.argmin(axis=1), angle.min(axis=1)
                reach = angle <= near[:, None] + margin
                reach[np.arange(len(home)), home] = False
                row, cell = np.nonzero(reach)
                upto = np.searchsorted(row, np.arange(len(home) + 1)).astype(np.int32)
                visits = pa.ListArray.from_arrays(pa.array(upto), pa.StructArray.from_arrays([pa.array(cell), pa.array(angle[row, cell])], names=["cell", "angle"]))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("mult"), part.column("v"), pa.array(home), pa.array(near), visits.cast(seen)], names=["vec_id", "mult", "v", "home", "near", "visits"])

    kind = rows.schema["v"].dataType.simpleString()
    placed = stored(mapped(classes.select("vec_id", "mult", "v"), assign, f"vec_id long, mult long, v {kind}, home long, near double, visits array<struct<cell: long, angle: double>>"), "cells")
    sizes = stored(placed.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count("*") / HOMES).alias("nh"), F.max("near").alias("radius")), "sizes")
    # one row for a cell, MOST_CELLS at most, so these are broadcast
    guests = placed.select(F.explode("visits").alias("g")).select("g.*").join(F.broadcast(sizes), "cell").where(F.col("angle") <= F.col("radius") + F.lit(margin))
    shape = stored(sizes.join(guests.groupBy("cell").agg(F.ceil(F.count("*") / VISITORS).alias("nv")), "cell", "left").na.fill(0, ["nv"]), "shape")
    own = placed.withColumn("g", F.explode(F.concat(F.array(F.struct(F.col("home").alias("cell"), F.lit(0.0).alias("angle"))), F.col("visits"))))
    in_cells = own.select("vec_id", "mult", "near", "home", "v", "g.*").join(F.broadcast(shape), "cell").where((F.col("home") == F.col("cell")) | (F.col("angle") <= F.col("radius") + F.lit(margin)))
    dealt = in_cells.withColumn("d", F.explode(_deal())).select("cell", "d.pair", "d.side", (F.col("home") != F.col("cell")).alias("guest"), "vec_id", "mult", "near", "v")
    found = stored(mapped(gathered(dealt, ["cell", "pair"]), _compare(least, dims), "u long, v long, n long"), "links")
    dropped(placed, sizes, shape)
    comps = components(found)
    counts = found.groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    named = classes.withColumnRenamed("vec_id", "node").join(comps, "node", "left").join(counts, "node", "left").select(
        "v", F.coalesce("component", "node").alias("c"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n")
    )
    named = stored(named, "named")
    own = F.coalesce("c", "vec_id")
    out = rows.join(named, "v", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (F.col("vec_id") == own).alias("kept"))
    out = stored(out, "near")
    dropped(rows, classes, found, comps, named)
    return out


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
