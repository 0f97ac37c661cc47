"""Byte-level BPE over Arrow batches with the tokenizers library: ids, offsets, and decoding with split characters."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import classes, held, joined, mapped, slices, text_bytes

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CACHED_UNITS = 250_000
CACHED_LENGTH = 200
SLICE = 1 << 19


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable in Latin-1, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def build(ranks: dict[bytes, int]):
    """A tokenizer of the tokenizers library with the merges that the ranks imply: any two tokens whose joined bytes
    are a token may merge, the lowest joined rank first."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    char = byte_characters()
    shown = {t: "".join(char[b] for b in t) for t in ranks}
    merges = [(shown[t[:i]], shown[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    tok = Tokenizer(models.BPE(vocab={s: ranks[t] for t, s in shown.items()}, merges=merges, ignore_merges=True))
    split = pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated")
    tok.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    tok.decoder = decoders.ByteLevel()
    return tok


_SPACE = np.zeros(256, bool)  # also the separators 0x1C to 0x1F, which some call white space
_SPACE[[0x20, *range(9, 14), *range(0x1C, 0x20)]] = True


def _white(raw: np.ndarray) -> np.ndarray:
    """Bytes of white space, in ASCII or beyond; E2 80 xx counts as a whole, which only keeps more text together."""
    white = _SPACE[raw]
    if len(raw) > 1 and (raw > 0xC1).any():
        two = ((raw[:-1] == 0xC2) & ((raw[1:] == 0x85) | (raw[1:] == 0xA0))) | ((raw[:-1] == 0xE1) & (raw[1:] == 0x9A)) | ((raw[:-1] == 0xE2) & ((raw[1:] == 0x80) | (raw[1:] == 0x81))) | ((raw[:-1] == 0xE3) & (raw[1:] == 0x80))
        at = np.flatnonzero(two)
        for k in range(3):
            white[np.minimum(at + k, len(raw) - 1)] = True
    return white


def units(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, whether it follows and holds no white space but a first blank) of pieces of rows of bytes that the
    pattern always keeps apart: a lone blank between other characters begins a match, a lone line end is one."""
    white = _white(raw)
    edge = np.zeros(len(raw) + 1, bool)
    edge[ends] = True
    lone = np.zeros(len(raw), bool)
    lone[1:-1] = white[1:-1] & _SPACE[raw[1:-1]] & ~white[:-2] & ~white[2:] & ~edge[1:-2] & ~edge[2:-1]
    # a separator of 0x1C to 0x1F is no white space to the pattern, so nothing is cut there
    lone &= (raw < 0x1C) | (raw == 0x20)
    cut = edge.copy()
    cut[:-1] |= lone
    cut[1:] |= lone & (raw != 0x20)
    cut[-1] = len(raw) > 0
    at = np.flatnonzero(cut)
    starts, stops = at[:-1], at[1:]
    count = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(white, out=count[1:])
    plain = (raw[starts] == 0x20) & lone[starts] & (count[stops] - count[starts] == 1) if len(starts) else np.zeros(0, bool)
    return starts, stops, plain


class Encoder:
    """Encodes a column by units that the pattern always keeps apart, each different unit once. New units that are a
    blank and what follows up to the next are encoded together, as the one text they make; token sizes tell them apart.
    Units are remembered by their bytes, in two generations, so that a full memory forgets the older half."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.ranks = read_ranks(path)
        self.tok = build(self.ranks)
        self.size = np.zeros(max(self.ranks.values(), default=0) + 1, np.int64)
        self.size[list(self.ranks.values())] = [len(t) for t in self.ranks]
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.int32).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: list[bytes], plain: list[bool]) -> dict[bytes, bytes]:
        together = [k for k, p in zip(keys, plain, strict=True) if p]
        apart = [k for k, p in zip(keys, plain, strict=True) if not p]
        found = dict(zip(apart, self._ids([k.decode() for k in apart]), strict=True))
        if together:
            ids = self._ids([b"".join(together).decode()])[0]
            ends = np.cumsum(self.size[np.frombuffer(ids, np.int32)])
            at = (4 * (np.searchsorted(ends, np.cumsum([len(k) for k in together])) + 1)).tolist()
            found.update((k, ids[a:b]) for k, a, b in zip(together, [0, *at], at, strict=False))
        return found

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, where each row's begin and one more at the end)."""
        raw, ends = text_bytes(column)
        starts, stops, plain = units(raw, ends)
        one, inverse = classes(raw, starts, stops)
        data = raw.tobytes()
        keys = [data[a:b] for a, b in zip(starts[one].tolist(), stops[one].tolist(), strict=True)]
        if len(self.known) > CACHED_UNITS:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        for k in keys:
            if k not in known and k in old:
                known[k] = old[k]
        ask = {k: p for k, p in zip(keys, plain[one].tolist(), strict=True) if k not in known}
        new = self._learn(list(ask), list(ask.values())) if ask else {}
        parts = [known[k] if k in known else new[k] for k in keys]
        known.update((k, v) for k, v in new.items() if len(k) <= CACHED_LENGTH)
        size = np.array([len(p) >> 2 for p in parts], np.int64)
        ids, upto = joined(np.frombuffer(b"".join(parts), np.int32), np.cumsum(size) - size, size, inverse)
        return ids, upto[np.searchsorted(starts, ends)]


class Decoder:
    """Bytes of ids, through the byte table in reverse."""

    def __init__(self, path: str) -> None:
        ranks = read_ranks(path)
        back = {c: b for b, c in enumerate(byte_characters())}
        shown = {i: "".join(byte_characters()[b] for b in t) for t, i in ranks.items()}
        table = [bytes(back[c] for c in shown.get(i, "")) for i in range(max(shown, default=-1) + 1)]
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.size = np.array([len(t) for t in table], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def __call__(self, ids: np.ndarray, row: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of rows of ids, and where each row's begin and one more at the end."""
        raw, upto = joined(self.flat, self.start, self.size, ids)
        return raw.tobytes(), upto[row]


class Decimals:
    """Ids in decimal, each followed by a comma."""

    def __init__(self, most: int) -> None:
        table = [b"%d," % i for i in range(most + 1)]
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.size = np.array([len(t) for t in table], np.int64)
        self.start = np.cumsum(self.size) - self.size

    __call__ = Decoder.__call__


def _lists(flat: np.ndarray, row: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(row.astype(np.int32)), pa.array(flat.astype(np.int32, copy=False)))


def _encode(path: str, offsets: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = held(Encoder, path)
        for batch in slices(batches, "text", SLICE):
            ids, row = encode(batch.column("text"))
            cols = [batch.column("doc_id"), _lists(ids, row)]
            if offsets:
                raw, at = text_bytes(batch.column("text"))
                ends = np.cumsum(encode.size[ids])
                starts = ends - encode.size[ids]
                char = np.append(np.cumsum((raw & 0xC0) != 0x80) - 1, 0)
                byte0 = np.repeat(at[:-1], np.diff(row))
                char0 = char[byte0]
                cols += [_lists(x, row) for x in (starts - byte0, ends - byte0, char[starts] - char0, char[ends - 1] + 1 - char0)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "byte_start", "byte_end", "char_start", "char_end"][: len(cols)])

    return kernel


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows of a list column and where each row's begin; a null row has none."""
    size = np.array([0 if n is None else n for n in pc.list_value_length(column).to_pylist()], np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])


def _decode(path: str):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = held(Decoder, path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column("ids")
                data, upto = decode(*_flat(ids))
                raw = [data[a:b] if ok else None for a, b, ok in zip(upto.tolist(), upto[1:].tolist(), ids.is_valid().to_pylist(), strict=False)]
                text = [None if r is None else r.decode("utf-8", "replace") for r in raw]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(raw, pa.binary()), pa.array(text, pa.string())], names=["doc_id", "ids", "raw", "text"])

    return kernel


def _texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))


def encoded(docs: DataFrame, path: str = RANKS, id_column: str = "doc_id", text_column: str = "text", offsets: bool = False) -> DataFrame:
    """(doc_id, ids) for each row, ids an array of int; a null text has none.

    With offsets also, for each token: byte_start, byte_end, and char_start, char_end, the characters it has bytes of. A
    character that is split over tokens belongs to each of them.
    """
    schema = "doc_id long, ids array<int>" + ", byte_start array<int>, byte_end array<int>, char_start array<int>, char_end array<int>" * offsets
    return mapped(_texts(docs, id_column, text_column), _encode(path, offsets), schema)


def decoded(tokens: DataFrame, path: str = RANKS) -> DataFrame:
    """tokens (doc_id, ids) with raw, the bytes of the ids, and text, the same as characters.

    Bytes are joined before they are read as UTF-8, so characters that tokens split come whole; ids that end within a
    character leave U+FFFD in text, and raw keeps their bytes. Null ids give null.
    """
    return mapped(tokens.select("doc_id", "ids"), _decode(path), "doc_id long, ids array<int>, raw binary, text string")


def round_trip(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row: encoded, and decoded again from the ids, in one pass of
    one worker, from which only digests leave. ids_sha256 is of the decimal ids joined by commas."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = held(Encoder, path), held(Decoder, path)
        decimal = held(Decimals, len(decode.size) - 1)
        for batch in slices(batches, "text", SLICE):
            ids, row = encode(batch.column("text"))
            shown, a = decimal(ids, row)
            raw, b = decode(ids, row)
            of_ids = [hashlib.sha256(shown[x : max(x, y - 1)]).hexdigest() for x, y in zip(a.tolist(), a[1:].tolist(), strict=False)]
            of_raw = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(b.tolist(), b[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(row)), pa.array(of_ids, pa.string()), pa.array(of_raw, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(_texts(docs), kernel, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document; the last stage, so its columns are its own."""
    return round_trip(docs)
