"""What the corpus operators share: durable intermediate tables, Arrow slices and byte-level words."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Words of the contracts: runs of bytes other than space and the five ASCII white-space controls.
WORD = "[^\\x20\\x09-\\x0D]+"
SLICE_BYTES = 1 << 20
#: Of a batch that crosses to a Python worker. Spark's own 64 MB stand in direct memory of the JVM and again in the worker, for each core.
BATCH_BYTES = 4 << 20
#: Of Parquet that are decoded at once. The texts of Spark's own 4,096 rows stand on the heap in one array, which grows by doubling, for each core.
READ_ROWS = 512
_LIMITS = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES, "spark.sql.parquet.columnarReaderBatchSize": READ_ROWS}


# -- durable intermediates ----------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. One of our own only where none is named and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    own = getattr(spark.sparkContext, "_meshloom_dir", None)
    if own is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="meshloom-")
        atexit.register(shutil.rmtree, folder, True)
        own = spark.sparkContext._meshloom_dir = "file://" + folder
        spark.sparkContext.setCheckpointDir(own)
    return own


_PATHS: dict[str, SparkSession] = {}  # folders of ours that are still there


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; it goes when the driver ends, if it wasn't dropped before."""
    if not _PATHS:
        atexit.register(_drop_all)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS[path] = spark
    return path


def _drop_all() -> None:
    for path, spark in list(_PATHS.items()):
        with contextlib.suppress(Exception):
            drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _PATHS.pop(path, None)


def paths() -> set[str]:
    """The folders that are there now, for one who drops later what is made from here on."""
    return set(_PATHS)


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go as soon as it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def limited(spark: SparkSession) -> None:
    """A session that has no limits of its own for batches keeps ours: frames may be planned after their operator returns."""
    for key, most in _LIMITS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, most)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    limited(spark)
    path = new_path(spark, name)
    with _shuffles_go(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._meshloom_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables that stored() made, once what was made of them is stored itself."""
    for t in tables:
        drop_path(t.sparkSession, t._meshloom_path)


# -- Arrow --------------------------------------------------------------------------------------


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of a text column, one row at least, so that scratch arrays stay small."""
    for batch in batches:
        ends = text_offsets(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def text_offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32) if column.buffers()[1] else np.zeros(1, np.int32)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each row starts (one more at the end); a null row is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    ends = text_offsets(column)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def mapped(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df through a kernel. A worker process that goes over to another operator first gives back what the last one held."""
    owner = kernel.__module__
    limited(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _enter(owner)
        yield from kernel(batches)

    return df.mapInArrow(run, schema)


_HELD: dict[tuple, object] = {}
_OWNER = [""]


def held(kind: type, *args: object) -> object:
    """kind(*args), once for a worker process, until another operator's kernel runs there."""
    if (kind, args) not in _HELD:
        _HELD[kind, args] = kind(*args)
    return _HELD[kind, args]


def _enter(owner: str) -> None:
    if _OWNER[0] == owner:
        return
    _OWNER[0] = owner
    _HELD.clear()
    Spans._up, Spans._down = [], []
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


# -- hashing ------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


P31 = (1 << 31) - 1
_BASES = (0x5A17_3C2D, 0x3B9F_64E7)  # of two lanes


def mod31(x: np.ndarray) -> np.ndarray:
    """x modulo the prime 2**31 - 1."""
    x = (x & np.uint64(P31)) + (x >> np.uint64(31))
    x = (x & np.uint64(P31)) + (x >> np.uint64(31))
    x[x == P31] = 0
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**31 - 1."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = mod31(out[:take] * np.uint64(pow(base, have, P31)))
        have += take
    return out[:n]


class Spans:
    """Hashes of spans of one buffer, the same wherever equal bytes stand: two polynomials modulo 2**31 - 1, so that two
    different spans of n bytes agree with a chance of about (n / 2**31)**2, however they are built."""

    _up: list[np.ndarray] = []
    _down: list[np.ndarray] = []

    def __init__(self, raw: np.ndarray) -> None:
        n = len(raw)
        if not Spans._up or len(Spans._up[0]) < n + 1:
            Spans._up = [powers(b, n + 1 + n // 4) for b in _BASES]
            Spans._down = [powers(pow(b, -1, P31), n + 1 + n // 4) for b in _BASES]
        table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(34)
        terms = table[raw]
        self.sums = []
        for up in Spans._up:
            s = np.zeros(n + 1, np.uint64)
            np.cumsum(mod31(terms * up[:n]), out=s[1:])  # no sum of fewer than 2**33 terms overflows
            self.sums.append(s)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        one, two = (mod31(mod31(s[ends] - s[starts]) * down[starts]) for s, down in zip(self.sums, Spans._down, strict=True))
        return mix((one << np.uint64(31) | two) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_LANES = 32
_KEEP = np.array([0xFFFFFFFFFFFFFFFF >> (64 - 8 * k) if k else 0 for k in range(9)], np.uint64)


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number; zeros follow the end."""
    n = len(raw) + 1
    padded = np.zeros(n + 16, np.uint8)
    padded[: len(raw)] = raw
    out = np.empty(n + 7, np.uint64)
    for k in range(8):
        own = out[k::8]
        own[:] = np.frombuffer(padded, "<u8", len(own), k)
    return out[:n]


def piece_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each piece raw[start:stop], eight bytes at a step, each step mixed; pieces beyond 256 bytes by xxh3."""
    size = stops - starts
    out = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    if not len(size):
        return out
    lane = eights(raw)
    live, at, left = np.arange(len(size)), starts, size
    for _ in range(_LANES):
        on = left > 0
        if not on.all():
            live, at, left = live[on], at[on], left[on]
        if not len(live):
            return out
        out[live] = mix((out[live] ^ (lane[at] & _KEEP[np.minimum(left, 8)])) * np.uint64(0xC2B2AE3D27D4EB4F))
        at, left = at + 8, left - 8
    data = memoryview(np.ascontiguousarray(raw))
    for k in live[left > 0].tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : stops[k]])
    return out


def alike(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, one: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Whether each piece has the very bytes of the piece that stands for its class (one[inverse])."""
    size, first = stops - starts, one[inverse]
    same = size == size[first]
    lane = eights(raw)
    live = np.flatnonzero(same & (first != np.arange(len(first))))
    a, b, left = starts[live], starts[first[live]], size[live]
    for _ in range(_LANES):
        differ = ((lane[a] ^ lane[b]) & _KEEP[np.minimum(left, 8)]) != 0
        same[live[differ]] = False
        on = ~differ & (left > 8)
        live, a, b, left = live[on], a[on] + 8, b[on] + 8, left[on] - 8
        if not len(live):
            return same
    for k, i, j, n in zip(live.tolist(), a.tolist(), b.tolist(), left.tolist(), strict=True):
        same[k] = np.array_equal(raw[i : i + n], raw[j : j + n])
    return same


def classes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a piece that stands for each class of pieces with the same bytes, each piece's class). Pieces meet by hash and are then compared."""
    hashes = piece_hashes(raw, starts, stops)
    order = np.argsort(hashes)
    new = np.ones(len(order), bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    one, inverse = order[new], np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    odd = np.flatnonzero(~alike(raw, starts, stops, one, inverse))
    inverse[odd] = len(one) + np.arange(len(odd))
    return np.concatenate([one, odd]), inverse


def joined(flat: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[start[k] : start[k] + size[k]] for k in which, one after another, and where each begins (one more at the end)."""
    n = size[which]
    upto = np.zeros(len(which) + 1, np.int64)
    np.cumsum(n, out=upto[1:])
    index = np.repeat(start[which] - upto[:-1], n)
    index += np.arange(upto[-1])
    return flat[index], upto


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True


def word_bounds(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of rows of bytes start and stop."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[raw]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    edges = ends[:-1][ends[:-1] < len(raw)]
    before[edges] = False
    after[edges[edges > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word (ASCII letters in lower case) of rows of bytes, and each row's first word (one more at the end)."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    starts, stops = word_bounds(raw, ends)
    return piece_hashes(_LOWER[raw], starts, stops), np.searchsorted(starts, ends)


# -- groups in sorted Arrow streams ---------------------------------------------------------------


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for each run of equal keys in a stream that is sorted by them, whatever batches it comes in."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def gathered(df: DataFrame, keys: list[str], dealt: list[str] | None = None) -> DataFrame:
    """Rows of equal keys next to each other in one partition, for runs(); dealt by the first few of them, if given."""
    return df.repartition(*(dealt or keys)).sortWithinPartitions(*keys)


def records(schema: pa.Schema, rows: dict[str, list | np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)
