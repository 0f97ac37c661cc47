"""Exact top-k search by inner product with Fagin's threshold algorithm over sorted lists of each dimension.

Candidates are dealt to blocks, and a stored table has each candidate's place in its block's sorted list of every
dimension. A query goes down all lists of a block in step, each from the end where its own weight makes the contribution
largest; what it meets is scored in full (random access). The bound, the score of a row that stood at the current depth of
every list, limits what is still unseen; a query leaves a block when the bound is below its k-th score, and strictly so,
since an unseen row could win a tie by its smaller id, or when it has met every row. The k-th score is carried from block
to block along a lane of blocks, so that later blocks are left sooner. The lanes' k best then meet in one ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, gathered, mapped, runs, stored
from .vectors import _matrix, usable

CANDIDATES, QUERIES = 8192, 1024
LANE = 16  # blocks


def places(v: np.ndarray) -> np.ndarray:
    """Each row's place in the ascending list of every dimension."""
    place = np.empty(v.shape, np.int32)
    np.put_along_axis(place, np.argsort(v, axis=0, kind="stable"), np.arange(len(v), dtype=np.int32)[:, None], axis=0)
    return place


def threshold_search(v: np.ndarray, ids: np.ndarray, place: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query number, candidate number, score, rows scored for each query): candidates of the k best scores, ties at the
    k-th included, of those that reach the query's `floor`, the k-th score that it has from elsewhere.

    v, q: integers as doubles (rows, dims). A candidate whose id is the query's own takes no part."""
    m, dims = v.shape
    order = np.empty((m, dims), np.int64)
    np.put_along_axis(order, place.astype(np.int64), np.arange(m)[:, None], axis=0)
    ascending = np.take_along_axis(v, order, axis=0)
    scored = np.zeros(len(q), np.int64)
    out_q, out_c, out_s = [], [], []
    for at in range(0, len(q), 128):
        live = np.arange(at, min(at + 128, len(q)))
        up, down = np.maximum(q[live], 0), np.minimum(q[live], 0)
        bound = lambda d: up @ ascending[m - d] + down @ ascending[d - 1]  # noqa: B023, E731
        seen = np.zeros((len(live), m), bool)
        scores = np.full((len(live), m), -np.inf)
        at_depth, depth = 0, min(32, m)
        while len(live):
            before = seen.copy()
            for d in range(dims):
                for rows, part in ((np.flatnonzero(q[live, d] > 0), order[m - depth : m - at_depth, d]), (np.flatnonzero(q[live, d] < 0), order[at_depth:depth, d])):
                    if len(rows):
                        seen[rows[:, None], part[None, :]] = True
            if depth == m:
                seen[:] = True  # of a query without weights, every row has the same score
            met = np.flatnonzero((seen & ~before).any(axis=0))
            scores[:, met] = np.where(seen[:, met], q[live] @ v[met].T, -np.inf)
            scores[own[live][:, None] == ids[None, :]] = -np.inf
            kth = np.maximum(floor[live], np.partition(scores, m - k, axis=1)[:, m - k] if m >= k else -np.inf)
            done = (bound(depth) < kth) | seen.all(axis=1)
            for r in np.flatnonzero(done):
                s = scores[r]
                found = np.flatnonzero((s >= kth[r]) & np.isfinite(s))
                out_q.append(np.full(len(found), live[r]))
                out_c.append(found)
                out_s.append(s[found])
                scored[live[r]] = seen[r].sum()
            live, seen, scores, up, down, kth = (x[~done] for x in (live, seen, scores, up, down, kth))
            # the next depth is where every query left stops at the latest, since k-th scores only grow
            at_depth, depth = depth, min(2 * depth, m)
            while depth < m and depth < 4 * at_depth and not (bound(depth) < kth).all():
                depth = min(2 * depth, m)
    whole = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return whole(out_q, np.int64), whole(out_c, np.int64), whole(out_s, np.int64), scored


class Best:
    """The k best candidates so far of a block of queries."""

    def __init__(self, own: np.ndarray, q: np.ndarray, k: int) -> None:
        self.own, self.q, self.k = own, q, k
        self.scores, self.ids = np.full((len(own), k), -np.inf), np.full((len(own), k), np.iinfo(np.int64).max)
        self.scored = np.zeros(len(own), np.int64)

    def go_through(self, v: np.ndarray, ids: np.ndarray, place: np.ndarray) -> None:
        a, b, s, scored = threshold_search(v, ids, place, self.q, self.own, self.k, self.scores[:, -1])
        self.scored += scored
        query = np.concatenate([np.repeat(np.arange(len(self.own)), self.k), a])
        score, of = np.concatenate([self.scores.ravel(), s]), np.concatenate([self.ids.ravel(), ids[b]])
        by = np.lexsort((of, -score, query))
        rank = np.arange(len(by)) - np.searchsorted(query[by], query[by])
        by = by[rank < self.k]
        self.scores, self.ids = score[by].reshape(-1, self.k), of[by].reshape(-1, self.k)

    def table(self) -> pa.RecordBatch:
        r, c = np.nonzero(np.isfinite(self.scores))
        return pa.RecordBatch.from_arrays([pa.array(self.own[r]), pa.array(self.ids[r, c]), pa.array(self.scores[r, c].astype(np.int64))], names=["query_id", "vec_id", "score"])


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates of the largest integer inner product, all if there are fewer.

    candidates, queries: (vec_id, v), v an array of whole numbers, shorter ones followed by zeros. Ties go to the smaller
    vec_id. A candidate with the query's own vec_id takes no part; neither do rows with a null id or v, or a v that holds
    a null or a non-finite number. Repeated candidates are found as often as they stand there; of queries that repeat an
    id the least v counts.
    """
    whole = lambda df: df.where(F.col("vec_id").isNotNull() & F.coalesce(usable("v"), F.lit(False))).select(F.col("vec_id").cast("long"), F.col("v").cast("array<double>"))
    c, q = whole(candidates), whole(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, wide = c.agg(F.count("*"), F.max(F.size("v"))).first()
    asked, wide2 = q.agg(F.count("*"), F.max(F.size("v"))).first()
    dims = max(wide or 0, wide2 or 0, 1)
    nb, qb = max(1, -(-n // CANDIDATES)), max(1, -(-asked // QUERIES))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["block"]):
            place = places(_matrix(t.column("v"), dims))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(place) + 1, dtype=np.int32) * dims), pa.array(place.ravel()))
            t = t.combine_chunks()
            yield pa.RecordBatch.from_arrays([*(t.column(c).chunk(0) for c in ("block", "vec_id", "v")), flat], names=["block", "vec_id", "v", "place"])

    block = F.pmod(F.xxhash64("vec_id"), F.lit(nb)).cast("int")
    lists = stored(mapped(gathered(c.withColumn("block", block).select("block", "vec_id", "v"), ["block"]), listed, "block int, vec_id long, v array<double>, place array<int>"), "lists")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, lane = None, None
        for t in runs(batches, ["query_block", "lane", "block"]):
            ids, x, now = t.column("vec_id").to_numpy(), _matrix(t.column("v"), dims), (t.column("query_block")[0].as_py(), t.column("lane")[0].as_py())
            if best is not None and now != lane:
                yield best.table()
                best = None
            lane = now
            if t.column("block")[0].as_py() < 0:  # the queries come before the blocks
                best = Best(ids, x, k)
            elif best is not None:
                best.go_through(x, ids, _matrix(t.column("place"), dims).astype(np.int32))
        if best is not None:
            yield best.table()

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = lists.select(every(qb).alias("query_block"), F.floor(F.col("block") / LANE).cast("int").alias("lane"), "block", "vec_id", "v", "place")
    asks = q.select(F.pmod(F.xxhash64("vec_id"), F.lit(qb)).cast("int").alias("query_block"), every(-(-nb // LANE)).alias("lane"), F.lit(-1).alias("block"), "vec_id", "v", F.lit(None).cast("array<int>").alias("place"))
    found = stored(mapped(gathered(rows.unionAll(asks), ["query_block", "lane", "block"], ["query_block", "lane"]), kernel, "query_id long, vec_id long, score long"), "best")
    dropped(lists)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantized(vectors: DataFrame, scale: Column | float = 64.0) -> DataFrame:
    """(vec_id, v): each component as floor(scale * x), x as double; rows with a null or non-finite component are dropped."""
    good = vectors.where(F.coalesce(usable("embedding"), F.lit(False)))
    return good.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("v"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(v, v.where("vec_id % 20 = 0"))
