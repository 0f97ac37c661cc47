"""Removal of long byte strings that occur more than once, by suffix arrays over shards.

1. In every window of `length` bytes the least hashed 32-byte gram, the leftmost of equals, is the window's anchor. The
   windows of one anchor position follow each other and make a cell. Equal windows have equal anchors at equal
   offsets, and lie in different cells, so only cells whose anchor gram occurs again matter.
2. Anchors are counted, with the least and the greatest hash (xxh3) of their cells' bytes. Where these agree, all cells of
   the anchor are copies, and all their windows repeat. Copies are settled there, by counts that combine before the shuffle.
3. Of the other repeated anchors, one cell of each distinct content goes to the anchor's shard, where a suffix array
   with common prefixes (`suffixes`) finds the windows that share `length` bytes with a neighbour. Each window holds its
   anchor with half of the remaining bytes to the left or to the right of it, so a cell whose two such strings (hashed
   to 32 bits; a chance collision only sends a cell too many) are in no other content is left out. A shard holds many
   anchors; an anchor with many contents is split by blocks of offsets, between which no two windows can be equal. As
   each piece has `length` bytes at least, that does not bound a group: an anchor with more contents than SHARD holds
   windows (SHARD // length) sends a hash for each window instead, which Spark counts by anchor, offset and hash in
   aggregates that spill, and no group of it is ever in one worker's memory.
4. Intervals go back to their documents, which are cut once.

Texts are shuffled twice, to the cells that shards ask for and to their intervals, and never stored.

Repeated passages are found in the same way: kernels put a 64-bit hash in the place of each word, so that a passage of n words
is a string of 8n bytes, whatever white space and case it is written in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import Spans, dropped, eights, gathered, mapped, mix, runs, slices, stored, text_bytes, word_bounds, word_hashes
from .suffixes import suffix_array

LENGTH, GRAM = 400, 32
CODE = 8  # bytes that stand for a word where passages are sought
BLOCK = 4 << 20
SHARD = 2 << 20
MEMORY = 64 << 20
CONTENTS = 256  # of one anchor in one shard, about
SLICE = 1 << 18  # of texts whose cells are found at once, which takes some 150 bytes for each


def cells(raw: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, anchor position, anchor hash, content hash, left hash, right hash) of each cell of
    rows of bytes. A side's hash is 0 where no window of the cell reaches so far."""
    n = len(raw)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int32),) * 2
    if n < length:
        return none
    eight = eights(np.append(raw, np.zeros(GRAM - 8, np.uint8)))
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    for j, k in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
        m = min(n, len(eight) - j)
        h[:m] += eight[j : j + m] * np.uint64(k)
    h = mix(h)
    key = h & np.uint64(0xFFFFFFFF00000000) | np.arange(n, dtype=np.uint64)
    width = length - GRAM + 1
    least, have = key, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if width > have:
        least = np.minimum(least[: n - width + 1], least[width - have : width - have + n - width + 1])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(ends)
    long = size >= length
    begin, count = ends[:-1][long], size[long] - length + 1
    if not len(begin):
        return none
    window = np.arange(count.sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    at = anchor[window]
    new = np.ones(len(window), bool)
    new[1:] = (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(window)))
    start, at = window[first], at[first]
    spans, half = Spans(raw), (length - GRAM) // 2
    left, right = at - half, at + GRAM + half
    wide = (start <= left, start + many - 1 + length >= right)
    side = lambda a, b, ok: np.where(ok, spans.of(np.where(ok, a, 0), np.where(ok, b, 0)) | np.uint64(1), np.uint64(0)).astype(np.uint32).view(np.int32)
    data = memoryview(np.ascontiguousarray(raw))
    content = np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(start.tolist(), (start + many + length - 1).tolist(), strict=True)], np.uint64)
    return start, many, at, h[at], content, side(left, at + GRAM, wide[0]), side(at, right, wide[1])


def _codes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes with each word's hash in its place."""
    hashes, first = word_hashes(raw, ends)
    return hashes.view(np.uint8), first * CODE


def _blocks(raw: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Rows as they come; a row beyond BLOCK bytes in blocks that overlap by length - 1 bytes, with each block's place."""
    if len(ends) != 2 or len(raw) <= BLOCK:
        yield raw, ends, 0
        return
    for at in range(0, len(raw) - length + 1, BLOCK):
        part = raw[at : at + BLOCK + length - 1]
        yield part, np.array([0, len(part)]), at


def _find(length: int, words: bool = False):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            raw, ends = text_bytes(batch.column("text"))
            if words:
                raw, ends = _codes(raw, ends)
            found = []
            for part, bounds, at in _blocks(raw, ends, length):
                s, m, a, *hashes = cells(part, bounds, length)
                found.append((s + at, m, a - s, *hashes))
            s, m, a, h, c, left, right = (np.concatenate(x) for x in zip(*found, strict=True))
            of = np.searchsorted(ends, s, side="right") - 1
            upto = np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32)
            # what a shuffled row holds is packed: start, windows and the anchor's offset in one number, both sides in another
            place = (s - ends[of]) << 32 | m << 16 | a
            sides = left.astype(np.int64) << 32 | right.view(np.uint32).astype(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(upto), pa.array(x)) for x in (place, h.view(np.int64), c.view(np.int64), sides)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("fp"), *lists], names=["id", "fp", "place", "anchor", "content", "sides"])

    return kernel


def _union(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of half-open intervals (n, 2)."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], axis=1)


def _cut(data: bytes, spans: np.ndarray) -> tuple[list[int], bytes]:
    """Maximal runs of spans, flat, and what they leave."""
    flat = _union(spans).ravel().tolist()
    bounds = [0, *flat, len(data)]
    return flat, b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))


def _passages(data: bytes, spans: np.ndarray, words: int) -> np.ndarray:
    """Half-open intervals of a text's codes as intervals of its bytes: the words that stand whole in one, from `words` on, and
    the white space that follows them."""
    raw = np.frombuffer(data, np.uint8)
    starts, _ = word_bounds(raw, np.array([0, len(raw)]))
    spans = _union(spans)
    a, b = -(-spans[:, 0] // CODE), spans[:, 1] // CODE
    long = b - a >= words  # a byte or two of a neighbour's hash may agree by chance
    return np.stack([starts[a[long]], np.append(starts, len(raw))[b[long]]], axis=1)


_PIECE = pa.struct([("anchor", pa.int64()), ("block", pa.int32()), ("start", pa.int32()), ("many", pa.int32()), ("need", pa.bool_()), ("bytes", pa.binary())])
_HOT = pa.struct([("anchor", pa.int64()), ("start", pa.int32()), ("at", pa.int32()), ("need", pa.bool_()), ("hashes", pa.list_(pa.int64()))])
_HALF = (
    "id long, fp long, pieces array<struct<anchor: long, block: int, start: int, many: int, need: boolean, bytes: binary>>, "
    "hot array<struct<anchor: long, start: int, at: int, need: boolean, hashes: array<long>>>"
)


def _pieces(length: int, words: bool = False):
    """Cuts the cells that shards ask for out of their documents: (start, many, at, anchor, split, need) in, with bytes out.
    A split of 0 asks for a hash of each window."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out, hot = [], []
            for text, asked in zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                data, own, hashed = (text or "").encode(), [], []
                if words:
                    data = _codes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tobytes()
                for x in asked or ():
                    if not x["split"]:
                        k = np.arange(x["many"])
                        spans = Spans(np.frombuffer(data, np.uint8)[x["start"] : x["start"] + x["many"] + length - 1])
                        hashed.append({"anchor": x["anchor"], "start": x["start"], "at": x["at"], "need": x["need"], "hashes": spans.of(k, k + length).view(np.int64)})
                        continue
                    step = -(-length // x["split"])
                    a, to = x["start"], x["start"] + x["many"]
                    while a < to:
                        # windows by their anchor's offset, which equal windows share
                        block = (x["start"] + x["at"] - a) // step
                        b = min(to, x["start"] + x["at"] - block * step + 1)
                        own.append({"anchor": x["anchor"], "block": block, "start": a, "many": b - a, "need": x["need"], "bytes": data[a : b + length - 1]})
                        a = b
                out.append(own)
                hot.append(hashed)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("fp"), pa.array(out, pa.list_(_PIECE)), pa.array(hot, pa.list_(_HOT))], names=["id", "fp", "pieces", "hot"])

    return kernel


def _sorted_shards(length: int, memory: int):
    def judged(held: list[pa.Table]) -> pa.RecordBatch | None:
        t = pa.concat_tables(held).combine_chunks()
        data = t.column("bytes").chunk(0)
        raw, ends = text_bytes(data)
        size = np.diff(ends)
        text = np.zeros(len(raw) + len(size), np.uint16)  # 0 ends each piece
        text[np.arange(len(raw)) + np.repeat(np.arange(len(size)), size)] = raw.astype(np.uint16) + 1
        sa, shared = suffix_array(text, length, memory)
        again = shared >= length
        again[:-1] |= again[1:]
        hit = np.zeros(len(text), bool)
        hit[sa[again]] = True
        first = ends[:-1] + np.arange(len(size))
        many, start = t.column("many").to_numpy(), t.column("start").to_numpy()
        need = t.column("need").to_numpy(zero_copy_only=False)
        windows = np.arange(many.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
        row = np.repeat(np.arange(len(size)), many)
        on = np.flatnonzero(hit[windows] & need[row])
        if not len(on):
            return None
        new = np.ones(len(on), bool)
        new[1:] = (on[1:] != on[:-1] + 1) | (row[on[1:]] != row[on[:-1]])
        a, b = on[new], on[np.append(np.flatnonzero(new)[1:], len(on)) - 1]
        r = row[a]
        lo = start[r] + windows[a] - first[r]
        hi = start[r] + windows[b] - first[r] + length
        return pa.RecordBatch.from_arrays([t.column("id").chunk(0).take(pa.array(r)), t.column("fp").chunk(0).take(pa.array(r)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["id", "fp", "lo", "hi"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n = 0
        for t in runs(batches, ["anchor", "block"]):
            if t.num_rows < 2:
                continue
            held.append(t)
            n += t.nbytes
            if n > SHARD:
                if (out := judged(held)) is not None:
                    yield out
                held, n = [], 0
        if held and (out := judged(held)) is not None:
            yield out

    return kernel


def _key() -> tuple[Column, Column]:
    """(id, fp), fp a hash of the text whose last bit tells a null id; rows that agree in both are repeats of one another."""
    fp = F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("doc_id").isNull().cast("long"))
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), fp.alias("fp")


def repeated_spans(docs: DataFrame, length: int = LENGTH, memory: int = MEMORY, words: bool = False) -> DataFrame:
    """(id, fp, spans), stored, for each row of docs (doc_id, text) that holds a string of `length` bytes which starts anywhere
    else too. spans: start and end of such strings, one after another, which may overlap or repeat. Rows are named by _key().
    With words, strings and spans are of the texts' codes, CODE bytes a word (see _passages)."""
    rows = docs.select(*_key(), F.coalesce("text", F.lit("")).alias("text"))
    found = stored(mapped(rows, _find(length, words), "id long, fp long, place array<long>, anchor array<long>, content array<long>, sides array<long>"), "cells")
    each = found.select("id", "fp", F.explode(F.arrays_zip("place", "anchor", "content", "sides")).alias("c")).select("id", "fp", "c.*")
    # written before the join, so that its two sides are plain shuffles, which Spark can split at a hot anchor
    repeated = stored(each.groupBy("anchor").agg(F.count("*").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi")).where("n > 1").select("anchor", (F.col("lo") == F.col("hi")).alias("copies")), "anchors")
    live = stored(each.join(repeated, "anchor"), "repeated")
    dropped(found, repeated)
    mixed_ = live.where("NOT copies")
    contents = stored(mixed_.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("id", "fp", "place")).alias("one"), F.min("sides").alias("sides")), "contents")
    sides = contents.select("anchor", "content", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.shiftright("sides", 32).alias("h")), F.struct(F.lit(1).alias("side"), F.col("sides").bitwiseAND(F.lit(0xFFFFFFFF)).alias("h")))).alias("s")).select("anchor", "content", "s.*").where("h <> 0")
    shared = sides.groupBy("anchor", "side", "h").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    wanted = sides.join(shared, ["anchor", "side", "h"], "left_semi").select("anchor", "content").distinct()
    wanted = contents.join(wanted, ["anchor", "content"])
    split = wanted.groupBy("anchor").agg(F.when(F.count("*") > max(1, SHARD // length), 0).otherwise(F.ceil(F.count("*") / CONTENTS)).cast("int").alias("split"))
    start, many, at = F.shiftright("place", 32).cast("int").alias("start"), F.shiftright("place", 16).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("many"), F.col("place").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("at")
    settled = live.where("copies").select("id", "fp", start, many).unionAll(
        mixed_.join(contents.where("n > 1").select("anchor", "content"), ["anchor", "content"], "left_semi").select("id", "fp", start, many)
    )
    a = wanted.join(split, "anchor").select("anchor", "content", "n", "split", F.col("one.id").alias("id"), F.col("one.fp").alias("fp"), F.col("one.place").alias("place"))
    asked = mixed_.join(a, ["anchor", "content", "id", "fp", "place"]).select("id", "fp", F.struct(start, many, at, "anchor", "split", (F.col("n") == 1).alias("need")).alias("x"))
    asked = stored(asked.groupBy("id", "fp").agg(F.array_distinct(F.collect_list("x")).alias("asked")), "asked")
    half = stored(mapped(rows.join(asked, ["id", "fp"]), _pieces(length, words), _HALF), "pieces")
    dropped(asked)
    pieces = half.select("id", "fp", F.explode("pieces").alias("p")).select("id", "fp", "p.*").dropDuplicates(["anchor", "block", "id", "fp", "start"])
    hits = mapped(gathered(pieces, ["anchor", "block"]), _sorted_shards(length, memory), "id long, fp long, lo int, hi int")
    hot = half.select("id", "fp", F.explode("hot").alias("c")).select("id", "fp", "c.*").dropDuplicates(["anchor", "id", "fp", "start"])
    hot = hot.select("id", "fp", "anchor", "need", "start", "at", F.posexplode("hashes").alias("k", "h")).select("id", "fp", "anchor", "need", (F.col("start") + F.col("k")).alias("lo"), (F.col("at") - F.col("k")).alias("offset"), "h")
    again = hot.groupBy("anchor", "offset", "h").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    hits = hits.unionAll(hot.where("need").join(again, ["anchor", "offset", "h"], "left_semi").select("id", "fp", "lo", (F.col("lo") + F.lit(length)).cast("int").alias("hi")))
    hits = stored(hits, "hits")
    dropped(half)
    every = settled.select("id", "fp", F.col("start").alias("lo"), (F.col("start") + F.col("many") + F.lit(length - 1)).alias("hi")).unionAll(hits)
    spans = stored(every.distinct().groupBy("id", "fp").agg(F.flatten(F.collect_list(F.array("lo", "hi"))).alias("spans")), "spans")
    dropped(live, contents, hits)
    return spans


def without_repeats(docs: DataFrame, length: int = LENGTH, memory: int = MEMORY) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept) for each row of docs (doc_id, text).

    Each byte goes that is covered by a string of `length` bytes that starts anywhere else too, in the same document or
    another; a repeated row is another document. Texts are their UTF-8 bytes (null: empty), strings never cross texts,
    and all are judged on the input. spans: start and end of each maximal removed run, one after another. kept: the
    bytes that are left, in one. memory bounds what a shard's sorting queues hold before they go to disk.
    """
    spans = repeated_spans(docs, length, memory)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_key(), F.coalesce("text", F.lit("")).alias("text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = [_cut(t, np.array(s or [], np.int64).reshape(-1, 2)) for t, s in zip(_raw(batch.column("text")), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s for s, _ in out], pa.list_(pa.int64())), pa.array([k for _, k in out], pa.binary())], names=["doc_id", "spans", "kept"])

    done = mapped(rows.join(spans, ["id", "fp"], "left").select("doc_id", "text", "spans"), kernel, "doc_id long, spans array<long>, kept binary")
    # each removed run's end less its start
    removed = F.aggregate(F.transform("spans", lambda x, k: F.when(k % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    done = done.withColumn("n_removed", removed)
    return done.select("doc_id", (F.octet_length("kept").cast("long") + F.col("n_removed")).alias("n_bytes"), "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), "spans", "kept")


def _raw(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, words: int = 0) -> DataFrame:
    """Texts without their repeated strings, as characters (a cut one becomes U+FFFD), with n_chars anew. A row of which
    nothing is left goes; rows that lose nothing, those without a text among them, stay as they are, whatever ids they
    share and whatever other columns they have. With words, passages of so many words that also start anywhere else go
    too, however short; they are judged on the input as well."""
    spans = repeated_spans(docs)
    if words:
        spans = spans.join(repeated_spans(docs, CODE * words, words=True).withColumnRenamed("spans", "passages"), ["id", "fp"], "full")
    else:
        spans = spans.withColumn("passages", F.lit(None).cast("array<int>"))
    row = docs.schema
    of = {f.name: k for k, f in enumerate(row.fields)}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            cut, passages = batch.column("spans"), batch.column("passages")
            touched = pc.or_(cut.is_valid(), passages.is_valid())
            if not touched.true_count:
                yield batch.select(["row"])  # the same field as below, so that all batches have one schema
                continue
            texts = batch.column("text").to_pylist()
            lost = np.zeros(len(texts), bool)
            for k in np.flatnonzero(touched.to_numpy(zero_copy_only=False)).tolist():
                data = texts[k].encode()
                gone = np.array(cut[k].as_py() or [], np.int64).reshape(-1, 2)
                if passages[k].is_valid:
                    gone = np.concatenate([gone, _passages(data, np.array(passages[k].as_py(), np.int64).reshape(-1, 2), words)])
                if len(gone):
                    texts[k], lost[k] = _cut(data, gone)[1].decode("utf-8", "replace"), True
            whole = batch.column("row")
            fields = whole.flatten()
            fields[of["text"]] = pa.array(texts, whole.type.field(of["text"]).type)
            if "n_chars" in of:
                kind = whole.type.field(of["n_chars"]).type
                now = pa.array([len(t) if t is not None else None for t in texts]).cast(kind)
                fields[of["n_chars"]] = pc.if_else(pa.array(lost), now, fields[of["n_chars"]])
            new = pa.StructArray.from_arrays(fields, fields=list(whole.type))
            yield pa.RecordBatch.from_arrays([new.filter(pa.array([bool(t) or not x for t, x in zip(texts, lost.tolist(), strict=True)]))], schema=pa.schema([batch.schema.field("row")]))

    joined = docs.select(F.struct("*").alias("row"), *_key()).join(spans, ["id", "fp"], "left").select("row", F.col("row")["text"].alias("text"), "spans", "passages")
    return mapped(joined, kernel, StructType([StructField("row", row)])).select("row.*")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.octet_length("kept").cast("long").alias("n_kept"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
