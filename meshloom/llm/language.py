"""Language identification of words in code-switched text: a linear-chain conditional random field.

A word's potential for each language sums learned weights of its byte n-grams with word boundaries (which also are its
short affixes), longer affixes, the word itself, and the lexicons it stands in; learned transitions tie neighbours.
Forward-backward over the whole document gives each word's distribution; a document's languages are their mean.

Training is on the driver over a bounded sample (a parameter), spliced into sequences that switch languages. Prediction
runs in the workers, over whole texts: words of a slice are scored once each, and chains are cut into segments whose
transfer matrices are multiplied in step for all segments at once, which is the same sum as going word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import Spans, mapped, piece_hashes, slices, text_bytes

BUCKETS = 1 << 16
AFFIXES = (1, 2, 3, 4, 5)
SEGMENT = 32
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


@dataclass
class Model:
    """langs; weights (buckets + one row for each lexicon + a bias row, langs); transitions; start; the lexicons' words and whose they are."""

    langs: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    lexicon: np.ndarray
    owner: np.ndarray


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the lower-cased texts, starts and ends of runs of letters (ASCII letters, any character beyond ASCII), and each row's first run."""
    raw, ends = text_bytes(pc.utf8_lower(column.cast(pa.string())))
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = _LETTER[raw]
    before = np.zeros(len(raw) + 1, bool)
    before[1:] = inside[:-1]
    cut = np.zeros(len(raw) + 1, bool)
    cut[ends] = True
    starts = np.flatnonzero(inside & (~before | cut))
    stops = np.flatnonzero(before & (~inside | cut))
    return raw, starts, stops, np.searchsorted(starts, ends)


def features(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, hashes: np.ndarray, lexicon: np.ndarray, owner: np.ndarray, langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the weight table for each word, one word after another, and where each word's rows start."""
    size = stops - starts
    # each word between two boundary bytes
    at = np.concatenate([[0], np.cumsum(size + 2)])
    flat = np.zeros(at[-1] + 2, np.uint32)
    where = np.arange(at[-1]) - np.repeat(at[:-1], size + 2)
    body = (where > 0) & (where <= np.repeat(size, size + 2))
    flat[:-2][body] = raw[(np.repeat(starts, size + 2) + where - 1)[body]]
    two = flat[:-2] | flat[1:-1] << np.uint32(8)
    three = two | flat[2:] << np.uint32(16)
    bucket = lambda x, kind: ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind * 0x632BE59BD9B4E019 % (1 << 64))) >> np.uint64(40)).astype(np.int64) % BUCKETS
    spans = Spans(raw)
    cols = [bucket(hashes, 3)]
    for n in AFFIXES:
        take = np.minimum(size, n)
        cols += [bucket(spans.of(starts, starts + take), 10 + n), bucket(spans.of(stops - take, stops), 20 + n)]
    place = np.searchsorted(lexicon, hashes)
    place[place == len(lexicon)] = 0
    known = lexicon[place] == hashes if len(lexicon) else np.zeros(len(hashes), bool)
    bias = BUCKETS + langs
    cols += [np.where(known, BUCKETS + owner[place], bias) if len(lexicon) else np.full(len(hashes), bias), np.full(len(hashes), bias)]
    fixed = len(cols)
    bigrams, trigrams = size + 1, size
    per = bigrams + trigrams + fixed
    first = np.concatenate([[0], np.cumsum(per)])
    out = np.empty(first[-1], np.int64)
    for k, c in enumerate(cols):
        out[first[:-1] + k] = c
    word = np.repeat(np.arange(len(size)), size + 2)
    has2, has3 = where < size[word] + 1, where < size[word]
    out[(first[:-1][word] + fixed + where)[has2]] = bucket(two, 1)[has2]
    out[(first[:-1][word] + fixed + bigrams[word] + where)[has3]] = bucket(three, 2)[has3]
    return out, first[:-1]


def potentials(model: Model, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one row for each different word, each word's row)."""
    hashes = piece_hashes(raw, starts, stops)
    _, one, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    rows, first = features(raw, starts[one], stops[one], hashes[one], model.lexicon, model.owner, len(model.langs))
    return np.add.reduceat(model.weights[rows], first, axis=0), inverse


def marginals(e: np.ndarray, first: np.ndarray, a: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Each word's distribution by forward-backward. e: exponentiated potentials of all words (n, L); first: each chain's
    first word (one more at the end), no chain empty; a, start: exponentiated transitions and start."""
    n, many = e.shape
    length = np.diff(first)
    parts = -(-length // SEGMENT)
    lane0 = np.concatenate([[0], np.cumsum(parts)])
    lanes = lane0[-1]
    chain = np.repeat(np.arange(len(length)), parts)
    nth = np.arange(lanes) - lane0[chain]
    begin = first[chain] + nth * SEGMENT
    steps = np.minimum(SEGMENT, first[chain + 1] - begin)
    longest = int(steps.max())
    head = nth == 0
    index = np.minimum(begin[None, :] + np.arange(longest)[:, None], n - 1)
    live = np.arange(longest)[:, None] < steps[None, :]
    es = np.where(live[:, :, None], e[index], 1.0)
    p = np.broadcast_to(np.eye(many), (lanes, many, many)).copy()
    for t in range(longest):
        q = p @ a
        if t == 0:
            q[head] = np.eye(many)
        q *= es[t][:, None, :]
        q /= q.sum(axis=(1, 2), keepdims=True)
        p = np.where(live[t][:, None, None], q, p)
    into, out = np.empty((lanes, many)), np.ones((lanes, many)) / many
    order = np.argsort(-parts, kind="stable")
    counts = parts[order]
    for k in range(int(parts.max())):
        on = lane0[order[: np.searchsorted(-counts, -k)]] + k
        if k == 0:
            into[on] = start
        else:
            v = np.einsum("nl,nlm->nm", into[on - 1], p[on - 1])
            into[on] = v / v.sum(axis=1, keepdims=True)
    for k in range(int(parts.max()) - 2, -1, -1):
        on = lane0[order[: np.searchsorted(-counts, -(k + 1))]] + k
        v = np.einsum("nlm,nm->nl", p[on + 1], out[on + 1])
        out[on] = v / v.sum(axis=1, keepdims=True)
    alpha = np.empty((longest, lanes, many))
    v = into
    for t in range(longest):
        w = v @ a
        if t == 0:
            w[head] = v[head]
        w = w * es[t]
        w /= w.sum(axis=1, keepdims=True)
        v = np.where(live[t][:, None], w, v)
        alpha[t] = v
    beta = out
    for t in range(longest - 1, -1, -1):
        alpha[t] *= beta
        w = (es[t] * beta) @ a.T
        w /= w.sum(axis=1, keepdims=True)
        beta = np.where(live[t][:, None], w, beta)
    alpha /= alpha.sum(axis=2, keepdims=True)
    gamma = np.empty((n, many))
    gamma[index[live]] = alpha[live]
    return gamma


def _exp(x: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(x - x.max(axis=-1, keepdims=True), -60, 0))


def fit(texts: list[str], labels: list[str], epochs: int = 3, run: int = 16, length: int = 64, rate: float = 0.3, seed: int = 8) -> Model:
    """Learns from labelled texts. Words of all texts are dealt into runs of geometric length (mean `run`), and runs
    of different texts are spliced into sequences of `length` words, each word labelled by its text."""
    langs = sorted(set(labels))
    many = len(langs)
    raw, starts, stops, first = tokens(pa.array(texts, pa.string()))
    y = np.repeat(np.array([langs.index(x) for x in labels], np.int64), np.diff(first)) if len(texts) else np.zeros(0, np.int64)
    model = Model(langs, np.zeros((BUCKETS + many + 1, many)), np.zeros((many, many)), np.zeros(many), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if not len(starts) or many < 2:
        return model
    rng = np.random.Generator(np.random.PCG64(seed))
    hashes = piece_hashes(raw, starts, stops)
    words, one, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    seen = np.bincount(inverse * many + y, minlength=len(words) * many).reshape(-1, many)
    sure = (seen.sum(axis=1) >= 3) & (seen.max(axis=1) >= 0.9 * seen.sum(axis=1))
    model.lexicon, model.owner = words[sure], seen[sure].argmax(axis=1)
    rows, at = features(raw, starts[one], stops[one], words, model.lexicon, model.owner, many)
    width = np.diff(np.append(at, len(rows)))
    square, tsquare = np.full(model.weights.shape[0], 1e-3), np.full((many, many), 1e-3)
    for _ in range(epochs):
        cuts = np.unique(np.concatenate([first[:-1], np.flatnonzero(rng.random(len(y)) < 1 / run)]))
        bounds = np.append(cuts, len(y))
        order = rng.permutation(len(cuts))
        stream = np.concatenate([np.arange(bounds[k], bounds[k + 1]) for k in order])
        for b in range(0, len(stream), 16384):
            batch = stream[b : b + 16384]
            part = np.append(np.arange(0, len(batch), length), len(batch))
            w, inv = np.unique(inverse[batch], return_inverse=True)
            take = np.repeat(at[w] - np.concatenate([[0], np.cumsum(width[w])[:-1]]), width[w]) + np.arange(width[w].sum())
            own = rows[take]
            of = np.repeat(np.arange(len(w)), width[w])
            u = np.add.reduceat(model.weights[own], np.concatenate([[0], np.cumsum(width[w])[:-1]]), axis=0)
            e, a, s = _exp(u)[inv], np.exp(model.transitions), np.exp(model.start)
            gamma = marginals(e, part, a, s)
            truth = np.eye(many)[y[batch]]
            g = np.zeros((len(w), many))
            np.add.at(g, inv, gamma - truth)
            grad = np.stack([np.bincount(own, g[of, k], minlength=len(model.weights)) for k in range(many)], axis=1) / length
            # neighbours: expected less observed, the expectation from both marginals and the transition
            pair = np.ones(len(batch) - 1, bool)
            pair[part[1:-1] - 1] = False
            left, right = np.flatnonzero(pair), np.flatnonzero(pair) + 1
            joint = gamma[left][:, :, None] * a[None] * gamma[right][:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            tgrad = joint.sum(axis=0) - truth[left].T @ truth[right]
            square += (grad**2).sum(axis=1)
            model.weights -= rate * grad / np.sqrt(square)[:, None]
            tgrad /= len(part)
            tsquare += tgrad**2
            model.transitions -= rate * tgrad / np.sqrt(tsquare)
    model.weights = model.weights.astype(np.float32)
    return model


def words_of(model: Model, texts: list[str | None]) -> list[list[tuple[str, str, float]]]:
    """Each text's words, in lower case, with their language and its probability."""
    column = pa.array(texts, pa.string())
    raw, starts, stops, first = tokens(column)
    if not len(starts):
        return [[] for _ in texts]
    u, inverse = potentials(model, raw, starts, stops)
    full = np.unique(first)
    gamma = marginals(_exp(u)[inverse], full, np.exp(model.transitions), np.exp(model.start))
    data = raw.tobytes()
    return [[(data[starts[i] : stops[i]].decode("utf-8", "replace"), model.langs[gamma[i].argmax()], float(gamma[i].max())) for i in range(first[k], first[k + 1])] for k in range(len(texts))]


def documents(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Each text's language and the mean probability of it over its words."""
    raw, starts, stops, first = tokens(column)
    count = np.diff(first)
    score = np.zeros((len(count), max(1, len(model.langs))))
    if len(starts) and model.langs:
        u, inverse = potentials(model, raw, starts, stops)
        gamma = marginals(_exp(u)[inverse], np.unique(first), np.exp(model.transitions), np.exp(model.start))
        full = np.flatnonzero(count)
        score[full] = np.add.reduceat(gamma, first[full], axis=0) / count[full, None]
    lang = np.array([*model.langs, UNKNOWN], object)[np.where(count > 0, score.argmax(axis=1), -1)] if model.langs else np.full(len(count), UNKNOWN, object)
    best = score.max(axis=1)
    # runs beyond ASCII need not hold a letter
    data, ends = text_bytes(column.cast(pa.string()))
    plain = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))])
    for k in np.flatnonzero((plain[ends[1:]] == plain[ends[:-1]]) & (count > 0)):
        if not any(c.isalpha() for c in data[ends[k] : ends[k + 1]].tobytes().decode()):
            lang[k], best[k] = UNKNOWN, 0.0
    return lang.tolist(), np.clip(best, 0, 1)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, rows_a_language: int = 150, most_bytes: int = 1 << 16) -> Model:
    """fit() on about `rows_a_language` rows of each language (all, if fewer), chosen by a hash of doc_id: rows with a
    language, an id and a text of `most_bytes` bytes at most that are not held out. Every language that has such a row is
    learned. The sample is bounded by both parameters for each language; counts cover the whole corpus, and rows are
    picked in the scan, without a shuffle."""
    labelled = docs.select("doc_id", "lang", "text").where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.octet_length("text") <= most_bytes))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    if not counts:
        return fit([], [])
    below = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1 << 30, (rows_a_language << 30) // r["n"]))])
    pick = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)) < F.try_element_at(below, F.col("lang"))
    sample = labelled.where(pick).toPandas().sort_values(["doc_id", "lang", "text"])
    return fit(sample["text"].tolist(), sample["lang"].tolist())


def identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs (doc_id, text, lang).

    lang_pred is a language that the model has learned, or und where the text is null or has no letter (score 0). score
    is the mean over words of the language's probability. Without any labelled row every text is und. The model, which
    has a fixed number of weights for each language, is broadcast.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model or train(docs))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            lang, score = documents(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return mapped(docs.select("doc_id", held_out().alias("held_out"), "text").withColumn("doc_id", F.col("doc_id").cast("long")), kernel, "doc_id long, held_out boolean, lang_pred string, score double")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.3) -> DataFrame:
    """Rejects rows whose text has no language (und), or whose words lean to none (a mean probability under `least`). Each
    row is judged by its own text, whatever ids are missing or shared, and leaves with all its columns."""
    shared = spark.sparkContext.broadcast(train(docs))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            lang, score = documents(shared.value, batch.column("text"))
            yield batch.select(["row"]).filter(pa.array((np.array(lang, object) != UNKNOWN) & (score >= least)))

    return mapped(docs.select(F.struct("*").alias("row"), "text"), kernel, StructType([StructField("row", docs.schema)])).select("row.*")
