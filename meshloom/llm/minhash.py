"""Near-duplicate documents: universal hash minima, banding, signature checks, full-set checks, components.

The flow, with what crosses the network at each step:

1. each document becomes a set fingerprint, 126 minima cut to a byte each, and 21 band keys;
2. documents with one and the same set collapse to a class, so that copies cost no more than one text;
3. band keys bring class representatives together; within a bucket, signatures are compared in square blocks, and only
   a spanning forest of the pairs that agree in seven tenths of the minima leaves the worker;
4. components of that forest are candidate groups, and each candidate's full set travels once, to its group (or, for a
   large group, to the block pairs of its chunk); every pair of a group that is not yet connected is held against the
   exact inequality on full sets, and again only a forest leaves the worker;
5. components of the confirmed links, carried back to every copy.

At a similarity of 0.85 a pair shares no band with probability 5e-5 and falls below the signature threshold with 1e-6.
The pipeline's stage links from 0.80 on; with 25 bands of 5 and a threshold of 0.62 these are 5e-5 and 8e-7 there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, gathered, mapped, mix, records, runs, slices, stored, text_bytes, word_hashes
from .components import components

BANDS, ROWS = 21, 6
MINIMA = BANDS * ROWS
BLOCK = 512
BLOCK_SHINGLES = 2_000_000

_rng = np.random.Generator(np.random.PCG64(20))
_A = (_rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_C = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64)[:, None]
_BAND = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(raw: np.ndarray, ends: np.ndarray, size: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its word n-grams; the whole sequence where it is shorter."""
    words, first = word_hashes(raw, ends)
    weight = np.array([pow(0xD1342543DE82EF95, j + 1, 1 << 64) for j in range(size)], np.uint64)
    grams = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for j in range(size):
        grams += words[j : len(words) - size + 1 + j] * weight[j]
    grams = mix(grams)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(mix(np.array([(words[a:b] * weight[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(words[:0])
    return out


def minima(values: np.ndarray) -> np.ndarray:
    """The least value of each of the universal functions (a*x + c mod 2**64) >> 32 of 32-bit x."""
    low = values & np.uint64(0xFFFFFFFF)
    least = np.full(MINIMA, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(low), 1024):
        part = low[at : at + 1024]
        hashed = _A * part if len(part) < 1024 else np.multiply(_A, part, out=_scratch())
        hashed += _C
        np.minimum(least, hashed.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _scratch(held: list[np.ndarray] = []) -> np.ndarray:  # noqa: B006  one buffer for each worker
    if not held:
        held.append(np.empty((MINIMA, 1024), np.uint64))
    return held[0]


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])


def _sign(size: int, bands: int, rows: int):
    weight = _BAND.ravel()[: bands * rows].reshape(bands, rows)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(*text_bytes(batch.column("text")), size)
            out: dict[str, list] = {f.name: [] for f in _SIGNED}
            for s in sets:
                out["n_shingles"].append(len(s))
                if not len(s):
                    for k in ("fp1", "fp2", "bands", "sig"):
                        out[k].append(None)
                    continue
                m = minima(s)
                order = np.arange(1, len(s) + 1, dtype=np.uint64)
                out["fp1"].append((mix(s + order)).sum().astype(np.int64))
                out["fp2"].append((mix(s * np.uint64(0x9E3779B97F4A7C15) ^ order)).sum().astype(np.int64))
                keys = mix((m[: bands * rows].reshape(bands, rows).astype(np.uint64) * weight).sum(axis=1) + np.arange(bands, dtype=np.uint64))
                out["bands"].append(keys.view(np.int64))
                out["sig"].append(mix(m.astype(np.uint64)).astype(np.uint8).tobytes())
            out["doc_id"] = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays([out["doc_id"], *[pa.array(out[f.name], f.type) for f in list(_SIGNED)[1:]]], schema=_SIGNED)

    return kernel


class Forest:
    """Union-find over a block; keeps the pairs that joined two trees."""

    def __init__(self, n: int) -> None:
        self.up, self.kept = list(range(n)), []

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.kept.append((x, y))


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a block pair's two sides; the same rows twice for a chunk against itself."""
    side = t.column("side").to_numpy()
    if (side == 0).all():
        return np.arange(len(side)), np.arange(len(side))
    return np.flatnonzero(side == 1), np.flatnonzero(side == 2)


def _agreeing(least: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["key", "pair"]):
            ids = t.column("doc_id").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(ids), MINIMA)
            left, right = _sides(t)
            forest = Forest(len(ids))
            for x in left.tolist():
                others = right[right > x] if left is right or len(left) == len(ids) else right
                if len(others):
                    for y in others[(sig[others] == sig[x]).sum(axis=1) >= least].tolist():
                        forest.join(x, y)
            if forest.kept:
                a, b = np.array(forest.kept).T
                yield records(_EDGE, {"u": ids[a], "v": ids[b]})

    return kernel


def _bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    on = np.zeros(bits, np.uint8)
    on[(s >> np.uint64(20)) & np.uint64(bits - 1)] = 1
    return np.packbits(on).view(np.uint64)


def _linked(percent: int):
    """Links between full sets. A bit map gives a lower bound of the symmetric difference, so what it rejects is no link."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["key", "pair"]):
            ids = t.column("doc_id").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
            size = np.array([len(s) for s in sets])
            bits = 1 << int(min(15, max(9, np.ceil(np.log2(8 * max(1, np.median(size)))))))
            maps = np.stack([_bitmap(s, bits) for s in sets])
            left, right = _sides(t)
            forest = Forest(len(ids))
            for x in left.tolist():
                others = right[right > x] if len(left) == len(ids) else right
                if not len(others):
                    continue
                total = size[others] + size[x]
                # 100*i >= p*u, i + u = total, u - i = difference  <=>  (100+p)*difference <= (100-p)*total
                apart = np.bitwise_count(maps[others] ^ maps[x]).sum(axis=1, dtype=np.int64)
                apart = np.maximum(apart, np.abs(size[others] - size[x]))
                for y in others[(100 + percent) * apart <= (100 - percent) * total].tolist():
                    if forest.root(x) != forest.root(y):
                        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                        if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                            forest.join(x, y)
            if forest.kept:
                a, b = np.array(forest.kept).T
                yield records(_EDGE, {"u": ids[a], "v": ids[b]})

    return kernel


_SET = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("chunks", pa.int64()), ("shingles", pa.binary())])


def _sets(size: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = shingle_sets(*text_bytes(batch.column("text")), size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), batch.column("chunks"), pa.array([s.tobytes() for s in found], pa.binary())], schema=_SET)

    return kernel


def paired(df: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Deals a group's rows (columns key, chunks) to the block pairs of its chunks: pair, and the side within it
    (0 for a chunk against itself). A group of one chunk stays one block."""
    chunk = F.pmod(F.xxhash64(doc, "key"), F.col("chunks"))
    other = F.col("other")
    spread = df.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    return spread.withColumns({
        "pair": low * F.col("chunks") + high,
        "side": F.when(F.col("chunk") == other, 0).when(F.col("chunk") < other, 1).otherwise(2),
    }).drop("chunk", "other", "chunks")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 85, bands: int = BANDS, rows: int = ROWS, agree: float = 0.70) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text; other columns are ignored).

    Words are runs of bytes other than ASCII white space, A-Z in lower case. Documents are linked where
    100 * |intersection| >= percent * |union| of their sets of distinct word n-grams (the whole sequence as one n-gram
    where a text is shorter). Texts that are null, empty or blank have no n-gram and are linked with nothing. A
    component carries its smallest doc_id; `kept` marks the row that has it. Repeated rows are copies like any others
    (both have the smallest id, so both are marked). A null doc_id belongs to nothing: component_id and kept are null.
    Candidates share one of `bands` bands of `rows` minima (MINIMA in all at most) and the share `agree` of all minima; a
    lower percent needs shorter rows and a lower share, or links are missed.
    """
    signed = stored(mapped(docs.select(F.col("doc_id").cast("long"), F.col("text")), _sign(shingle, bands, rows), "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, sig binary"), "minhash")
    classes = stored(
        signed.where("fp1 IS NOT NULL AND doc_id IS NOT NULL").groupBy("fp1", "fp2", "n_shingles").agg(F.min(F.struct("doc_id", "bands", "sig")).alias("r")).select("fp1", "fp2", "n_shingles", "r.*"),
        "classes",
    )
    # tables that are joined on a key that can be hot are written first: Spark splits joins of two plain shuffles only
    buckets = stored(
        classes.select("doc_id", F.explode("bands").alias("key"))
        .groupBy("key")
        .agg(F.count("*").alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("who"))
        .where("n > 1")
        .groupBy("n", "who")  # buckets of the same members, under whichever band, count once
        .agg(F.min("key").alias("key"))
        .select("key", F.ceil(F.col("n") / BLOCK).alias("chunks")),
        "buckets",
    )
    members = classes.select("doc_id", "sig", F.explode("bands").alias("key")).join(buckets, "key")
    agreeing = mapped(gathered(paired(members), ["key", "pair"]), _agreeing(int(agree * MINIMA)), "u long, v long")
    candidates = components(agreeing)
    groups = candidates.withColumnRenamed("component", "key")
    sizes = groups.join(classes.select(F.col("doc_id").alias("node"), "n_shingles"), "node").groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    chunks = stored(sizes.select("key", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).alias("chunks")), "chunks")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text")).join(groups.join(chunks, "key").withColumnRenamed("node", "doc_id"), "doc_id")
    sets = mapped(texts, _sets(shingle), "doc_id long, key long, chunks long, shingles binary")
    links = mapped(gathered(paired(sets), ["key", "pair"]), _linked(percent), "u long, v long")
    found = components(links)
    named = classes.select("fp1", "fp2", "n_shingles", F.col("doc_id").alias("node")).join(found, "node", "left").select("fp1", "fp2", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    named = stored(named, "named")
    each = signed.select("doc_id", "n_shingles", "fp1", "fp2").join(named, ["fp1", "fp2", "n_shingles"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = stored(each.select("doc_id", "n_shingles", own.alias("component_id"), (F.col("doc_id") == own).alias("kept")), "near")
    dropped(signed, classes, buckets, candidates, chunks, found, named)
    return out


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 0.80 and more stays, with all its columns; texts without a word all stay.

    Rows that have no id, or share one, are told apart by their texts: each different text of such rows is a document of
    its own (with a number above all ids, so it stays only where its group has no other), and of rows that agree in id
    and text one stays."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    again = stored(ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"), "again")
    limits = dict(percent=80, bands=25, rows=5, agree=0.62)
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("node"))
    if again.isEmpty():
        keep = near_duplicates(docs, **limits).where("kept").select(F.col("doc_id").alias("node"))
        return packed.join(keep, "node", "left_semi").select("row.*")
    above = ids.agg(F.max("doc_id")).first()[0] or 0
    shared = F.col("node").eqNullSafe(F.col("doc_id"))
    odd = packed.join(again, shared, "left_semi").select("row", "node", F.col("row")["text"].alias("text"))
    first = odd.groupBy("node", "text").agg(F.first("row").alias("row"))
    first = stored(first.select("row", "text", (F.monotonically_increasing_id() + F.lit(above + 1)).alias("node")), "odd")
    plain = packed.join(again, shared, "left_anti")
    nodes = plain.select("node", F.col("row")["text"].alias("text")).unionAll(first.select("node", "text"))
    keep = near_duplicates(nodes.withColumnRenamed("node", "doc_id"), **limits).where("kept").select(F.col("doc_id").alias("node"))
    return plain.unionAll(first.select("row", "node")).join(keep, "node", "left_semi").select("row.*")
