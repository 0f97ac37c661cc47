"""Token ids in length-delimited binary files with masked checksums, and a separate offset index for shuffled reads.

A file is a run of frames; all integers are little-endian.

    length      u64   of the payload
    check       u32   masked crc32 of the eight length bytes
    payload     has_id u8, doc_id i64, width u8 (2 or 4), n u32, then n ids of that width
    check       u32   masked crc32 of the payload
    end         u8    0x0A

A masked checksum is the crc rotated right by 15 bits plus 0xA282EAD8, so that a crc over data that holds crcs stays
sound. The frames leave through Spark's own file writer (whose record separator is the end byte): on any file system
that Spark writes, by its commit protocol, so that a lost or repeated task leaves no part of a file. Files are named by
range in ascending order of doc_id (null first). The index (Parquet) has file, offset, length and n_tokens of each record.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import _LOWER, classes, held, joined, mapped, new_path, slices, text_bytes

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
CACHED_WORDS = 200_000
CACHED_LENGTH = 200
_HEAD = struct.Struct("<QI")
_PAYLOAD = struct.Struct("<BqBI")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    payload = _PAYLOAD.pack(doc_id is not None, doc_id or 0, width, len(ids)) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def frames(data: bytes | memoryview) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length with the end byte, doc_id, ids) of each record; a ValueError where a checksum is wrong."""
    at = 0
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError(f"a record is cut off at byte {at}")
        n, check = _HEAD.unpack_from(data, at)
        if check != masked(bytes(data[at : at + 8])):
            raise ValueError(f"wrong checksum of a length at byte {at}")
        payload = bytes(data[at + 12 : at + 12 + n])
        if len(payload) < n or at + 17 + n > len(data) or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
            raise ValueError(f"wrong checksum of a record at byte {at}")
        has, doc, width, count = _PAYLOAD.unpack_from(payload)
        yield at, 17 + n, doc if has else None, np.frombuffer(payload, f"<u{width}", count, _PAYLOAD.size)
        at += 17 + n


_ODD = np.ones(256, bool)
_ODD[9:14] = _ODD[32:127] = _ODD[0x80:0xC0] = _ODD[0xC3] = False
_ODD[ord("'")] = True
_KIND = np.full(256, 3, np.int8)  # white space, letters, digits, other marks
_KIND[9:14] = _KIND[32] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2


class WordEncoder:
    """Ids of whole texts by a tokenizer that lowers case, drops white space and keeps runs of letters, single digits and
    runs of other marks apart. Special tokens' strings in a text are ordinary text.

    Texts of ASCII and Latin-1 letters without an apostrophe (which can split letters) are cut into these pieces here, on
    the bytes of a whole slice; each different piece is encoded once for a worker, new runs of letters as one text in which
    each is a word of the tokenizer's. Any other text goes to the tokenizer whole. Pieces are remembered by their bytes in
    two generations, so that a full memory forgets the older half."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _batch(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: list[bytes]) -> None:
        pieces = [k.decode() for k in keys]
        words = [k for k, p in enumerate(pieces) if p.isalpha() and len(p) <= CACHED_LENGTH]
        rest = sorted({*range(len(pieces))}.difference(words))
        if words:
            e = self.tok.encode(" ".join([pieces[k] for k in words]), add_special_tokens=False)
            ids = np.array(e.ids, np.uint32)
            ends = (np.append(np.flatnonzero(np.diff(np.array(e.word_ids))) + 1, len(ids)) * 4).tolist()
            if len(ends) != len(words):
                rest, words, ends = list(range(len(pieces))), [], []
            raw, at = ids.tobytes(), 0
            for k, end in zip(words, ends, strict=True):
                self.known[keys[k]] = raw[at:end]
                at = end
        self.known.update(zip([keys[k] for k in rest], self._batch([pieces[k] for k in rest]), strict=True))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, where each row's begin and one more at the end)."""
        raw, ends = text_bytes(column)
        rows = len(ends) - 1
        high = np.flatnonzero(raw >= 0x80)
        lead = raw[high] == 0xC3
        second = high[lead] + 1
        second = second[second < len(raw)]
        after = raw[second]
        follow = high[(raw[high] < 0xC0) & (high > 0)]
        # a continuation byte follows its lead, and U+00D7 and U+00F7 are no letters
        wrong = (after < 0x80) | (after >= 0xC0) | (after == 0x97) | (after == 0xB7)
        odd = np.concatenate([np.flatnonzero(_ODD[raw]), second[wrong], follow[raw[follow - 1] != 0xC3]])
        whole = np.unique(np.searchsorted(ends, odd, side="right") - 1)
        low = _LOWER[raw]
        low[second[after < 0x9F]] += 32
        kind = _KIND[raw]
        for k in whole.tolist():
            kind[ends[k] : ends[k + 1]] = 0
        new = kind == 2
        new[1:] |= kind[1:] != kind[:-1]
        new[ends[:-1][ends[:-1] < len(raw)]] = True
        if len(new):
            new[0] = True
        cuts = np.append(np.flatnonzero(new), len(raw))
        on = kind[cuts[:-1]] > 0
        starts, stops = cuts[:-1][on], cuts[1:][on]
        one, inverse = classes(low, starts, stops)
        data = low.tobytes()
        keys = [data[a:b] for a, b in zip(starts[one].tolist(), stops[one].tolist(), strict=True)]
        if len(self.known) > CACHED_WORDS:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        parts = list(map(known.get, keys))
        if None in parts:
            missing = [k for k, p in enumerate(parts) if p is None]
            ask = []
            for k in dict.fromkeys([keys[k] for k in missing]):
                if k in old:
                    known[k] = old[k]
                else:
                    ask.append(k)
            if ask:
                self._learn(ask)
            for k in missing:
                parts[k] = known[keys[k]]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        ids, upto = joined(np.frombuffer(b"".join(parts), np.uint32), np.cumsum(size) - size, size, inverse)
        row = upto[np.searchsorted(starts, ends)]
        if len(whole):
            text = column.take(pa.array(whole)).to_pylist()
            extra = dict(zip(whole.tolist(), self._batch([t or "" for t in text]), strict=True))
            pieces = [np.frombuffer(extra[k], np.uint32) if k in extra else ids[row[k] : row[k + 1]] for k in range(rows)]
            ids, row = np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        return ids, row


def write_records(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, files: int | None = None) -> None:
    """Writes docs (doc_id, text; a null text is empty) to `path`/data in ascending doc_id order and `path`/index.

    Texts are dealt by ranges of doc_id and sorted within them before they are encoded, so the larger ids are never
    shuffled. Repeated rows are records of their own. files: how many ranges, twice the input's partitions if not given.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = held(WordEncoder, tokenizer)
        end = np.array([end_id], np.uint32)
        for batch in slices(batches, "text"):
            ids, row = encode(batch.column("text"))
            row = row.tolist()
            out = [frame(d, np.concatenate([ids[a:b], end])) for d, a, b in zip(batch.column("doc_id").to_pylist(), row, row[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    d = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    n = files or max(1, 2 * d.rdd.getNumPartitions())
    # a hash of the text within doc_id, so that an id which many rows share makes no file of its own
    sorted_docs = d.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    mapped(sorted_docs, kernel, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/data")
    index(docs.sparkSession, path).write.parquet(f"{path}/index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """file (its name), file_no (its rank in doc_id order) and content, one row a file."""
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data").select(name.alias("file"), F.regexp_extract(name, r"part-(\d+)", 1).cast("long").alias("file_no"), "content")


def index(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_no, at, doc_id, offset, length, n_tokens) of each record, from the files' frames."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, no, content in zip(batch.column("file").to_pylist(), batch.column("file_no").to_pylist(), batch.column("content"), strict=True):
                rows = [(name, no, k, doc, at, n, len(ids)) for k, (at, n, doc, ids) in enumerate(frames(memoryview(content.as_buffer())))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = ["file", "file_no", "at", "doc_id", "offset", "length", "n_tokens"]
    kinds = [pa.string(), *[pa.int64()] * 6]
    return mapped(_files(spark, path), kernel, "file string, file_no long, at long, doc_id long, offset long, length long, n_tokens long")


def read_records(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(file_no, at, doc_id, n_tokens, ids_crc32[, ids]) of each record; checksums are verified."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, content in zip(batch.column("file_no").to_pylist(), batch.column("content"), strict=True):
                rows: list[tuple] = []
                for k, (_, _, doc, got) in enumerate(frames(memoryview(content.as_buffer()))):
                    wide = got.astype("<u4")
                    rows.append((no, k, doc, len(wide), zlib.crc32(wide.tobytes()), *([wide] if ids else [])))
                    if len(rows) == 256:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * ids
        cols = list(zip(*rows, strict=True))
        if ids:
            cols[5] = [x.view(np.int32) for x in cols[5]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["file_no", "at", "doc_id", "n_tokens", "ids_crc32", "ids"][: len(kinds)])

    return mapped(_files(spark, path), kernel, "file_no long, at long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def positions(spark: SparkSession, path: str) -> DataFrame:
    """(file_no, at, start): the ids in all records before each record, from the index. One row a file reaches the running sum over files."""
    i = spark.read.parquet(f"{path}/index").select("file_no", "at", "n_tokens")
    up = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = i.groupBy("file_no").agg(F.sum("n_tokens").alias("s")).select("file_no", F.coalesce(F.sum("s").over(up), F.lit(0)).alias("before"))
    within = Window.partitionBy("file_no").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return i.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(files, "file_no").select("file_no", "at", (F.col("before") + F.col("inside")).alias("start"))


def fetched(spark: SparkSession, path: str, addresses: DataFrame) -> DataFrame:
    """The records at addresses (rows of the index, with any other columns), each with doc_id and ids read anew from its
    bytes, checksums verified. A file's addresses meet its content in one row; only their byte ranges are read."""
    extra = [c for c in addresses.columns if c not in ("file", "offset", "length", "doc_id", "ids")]
    per = addresses.groupBy("file").agg(F.collect_list(F.struct("offset", "length", *extra)).alias("wanted"))
    kinds = addresses.select(*extra).schema
    row = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                content, wanted = memoryview(batch.column("content")[k].as_buffer()), batch.column("wanted").slice(k, 1).flatten()
                for at in range(0, len(wanted), 256):
                    part = wanted.slice(at, 256)
                    got = [next(frames(content[o : o + n])) for o, n in zip(part.field("offset").to_pylist(), part.field("length").to_pylist(), strict=True)]
                    cols = [pa.array([g[2] for g in got], row.field(0).type), pa.array([g[3].astype("<u4").view(np.int32) for g in got], row.field(1).type)]
                    yield pa.RecordBatch.from_arrays([*cols, *(part.field(c) for c in extra)], names=["doc_id", "ids", *extra])

    files = _files(spark, path).select("file", "content").join(per, "file")
    return mapped(files, kernel, StructType([StructField("doc_id", LongType()), StructField("ids", ArrayType(IntegerType())), *kinds.fields]))


def shuffled(spark: SparkSession, path: str, seed: int, shards: int = 8, only: int | None = None) -> DataFrame:
    """(shard, place, doc_id, ids): all records, or those of one shard, in an order that `seed` fixes. The index is
    shuffled and dealt evenly to shards, and records are fetched by file, offset and length."""
    key = F.xxhash64(F.lit(seed), "file_no", "at")
    at = spark.read.parquet(f"{path}/index").withColumn("place", key).withColumn("shard", F.pmod("place", F.lit(shards)).cast("int"))
    got = fetched(spark, path, (at if only is None else at.where(F.col("shard") == only)).select("file", "offset", "length", "shard", "place"))
    return got.repartition(shards, "shard").sortWithinPartitions("shard", "place").select("shard", "place", "doc_id", "ids")


def op4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "records")
    write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_records(spark, path, ids=False).join(positions(spark, path), ["file_no", "at"]).select("doc_id", "start", "n_tokens", "ids_crc32")
