"""Suffix arrays with common prefixes by induced sorting, through queues that go to disk.

The induction is that of SA-IS with LCP values, one bucket (first symbol) at a time: a bucket's suffixes, in order,
induce the order of the suffixes one symbol longer. Each induced suffix is put as a tuple (position, prefix shared with
the tuple put before it) in the queue of its first symbol; a queue is read once, in the order in which it was filled,
when the scan reaches its bucket. So all buckets' queues together are a monotone priority queue, and a queue whose
tuples outgrow the memory given to them is kept in a file and read back in sequence. Scans go by blocks, so that the
work is done on arrays.

The sorted order of the leftmost-S substrings comes from a first induction. Neighbours are compared symbol by symbol and
named; where names repeat, they form a shorter string, which is sorted in the same way, by recursion, if its tuples
outgrow the memory, and in memory otherwise (each round doubles the compared length and touches unresolved ranks only).
The recursion's common prefixes, counted in names, carry over: names that agree stand for symbols that agree, so only
what follows them is compared. No hash decides anything here.
"""

from __future__ import annotations

import tempfile

import numpy as np

NAME_BYTES = 24  # of a name and its tuple in memory


class Queues:
    """A first-in first-out queue of integer tuples for each symbol, in files beyond `memory` bytes in all."""

    def __init__(self, symbols: int, memory: int) -> None:
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.memory, self.held, self.file = memory, 0, None
        self.spilled = 0

    def put(self, symbol: int, *columns: np.ndarray) -> None:
        block = np.stack(columns)
        self.parts[symbol].append(block)
        self.held += block.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for parts in self.parts:
            for i, p in enumerate(parts):
                if isinstance(p, np.ndarray):
                    parts[i] = (self.file.tell(), p.shape, p.dtype)
                    p.tofile(self.file)
                    self.spilled += p.nbytes
        self.held = 0

    def take(self, symbol: int, columns: int) -> list[np.ndarray]:
        """All tuples of a symbol, as columns; the queue is then empty."""
        got = []
        for p in self.parts[symbol]:
            if not isinstance(p, np.ndarray):
                at, shape, kind = p
                self.file.seek(at)
                p = np.fromfile(self.file, kind, int(np.prod(shape))).reshape(shape)
            else:
                self.held -= p.nbytes
            got.append(p)
        self.parts[symbol] = []
        return list(np.concatenate(got, axis=1)) if got else [np.zeros(0, np.int32)] * columns

    def close(self) -> None:
        if self.file:
            self.file.close()


def types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is less than the next (type S); the last is not."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = (t[1:] > t[:-1]).astype(np.int8) - (t[1:] < t[:-1]).astype(np.int8)
    step[-1] = -1
    # a run of equal symbols takes the type of what ends it
    known = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(known[::-1])[::-1]] > 0


def _dispatch(q: Queues, pred: np.ndarray, symbol: np.ndarray, ok: np.ndarray, ell: np.ndarray, carry: np.ndarray, own: int, cap: int, lcp: bool) -> list[np.ndarray]:
    """Puts the predecessors of a scanned block in their queues; those of the bucket being scanned come back.

    ell[k] is what scanned item k shares with the one before it; carry[d] is the least of these since d last got a tuple."""
    back = [np.zeros(0, np.int32)] * (1 + lcp)
    where = np.flatnonzero(ok)
    sym = symbol[where]
    order = np.argsort(sym, kind="stable")
    where, sym = where[order], sym[order]
    cuts = np.flatnonzero(np.diff(sym)) + 1
    firsts, lasts = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(sym)]])
    got = set()
    if lcp:
        tail = np.append(ell, cap)
        least = int(ell.min())
    for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True):
        if a == b:
            continue
        k = where[a:b]
        d = int(sym[a])
        cols = [pred[k]]
        if lcp:
            bounds = np.empty(2 * len(k) + 1, np.int64)
            bounds[0], bounds[2:-1:2] = 0, k[:-1] + 1
            bounds[1::2] = k + 1
            bounds[-1] = len(ell)
            m = np.minimum.reduceat(tail, bounds[:-1])[::2]
            m[0] = min(int(m[0]), int(carry[d]))
            cols.append(np.minimum(m + 1, cap).astype(np.int32))
            rest = tail[k[-1] + 1 :]
            carry[d] = rest.min()
            got.add(d)
        if d == own:
            back = cols
        else:
            q.put(d, *cols)
    if lcp:
        keep = [carry[d] for d in got]
        np.minimum(carry, least, out=carry)
        for d, v in zip(got, keep, strict=True):
            carry[d] = v
    return back


def _shared(t: np.ndarray, a: int, b: int, cap: int) -> int:
    most = min(cap, len(t) - max(a, b))
    differ = np.flatnonzero(t[a : a + most] != t[b : b + most])
    return int(differ[0]) if len(differ) else most


def induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, shared: np.ndarray | None, cap: int, memory: int) -> tuple[np.ndarray, np.ndarray | None]:
    """(suffix array, common prefixes up to cap) from leftmost-S suffixes in order (and what neighbours of them share)."""
    n, lcp = len(t), shared is not None
    symbols = int(t.max()) + 1
    cols = 1 + lcp
    none = np.zeros(0, np.int32)
    first = t[lms]
    at = np.searchsorted(first, np.arange(symbols + 1))
    q = Queues(symbols, memory)
    done: list[list[np.ndarray]] = []
    q.put(int(t[-1]), *([np.array([n - 1], np.int32)] + [np.array([0], np.int32)] * lcp))
    for c in range(symbols):
        scanned: list[list[np.ndarray]] = []
        carry = np.zeros(symbols, np.int32)
        now = q.take(c, cols)
        if lcp and len(now[0]):
            now[1] = now[1].copy()
            now[1][0] = 0
        while len(now[0]):
            scanned.append(now)
            pred = now[0] - 1
            ok = pred >= 0
            ok &= ~is_s[pred]
            now = _dispatch(q, pred, t[pred], ok, now[1] if lcp else none, carry, c, cap, lcp)
        done.append([np.concatenate([s[k] for s in scanned]) if scanned else none for k in range(cols)])
        seeds = lms[at[c] : at[c + 1]]
        if len(seeds):
            ell = none
            if lcp:
                ell = shared[at[c] : at[c + 1]].copy()
                ell[0] = _shared(t, int(done[c][0][-1]), int(seeds[0]), cap) if len(done[c][0]) else 0
            pred = seeds - 1
            _dispatch(q, pred, t[pred], pred >= 0, ell, carry, -1, cap, lcp)
    q.close()
    q = Queues(symbols, memory)
    sa: list[np.ndarray] = []
    ells: list[np.ndarray] = []
    for c in range(symbols - 1, -1, -1):
        scanned = []
        carry = np.zeros(symbols, np.int32)
        now = q.take(c, cols)
        if lcp and len(now[0]):
            now[1] = now[1].copy()
            now[1][0] = 0
        while len(now[0]):
            scanned.append(now)
            pred = now[0] - 1
            ok = pred >= 0
            ok &= is_s[pred]
            now = _dispatch(q, pred, t[pred], ok, now[1] if lcp else none, carry, c, cap, lcp)
        down = [np.concatenate([s[k] for s in scanned]) if scanned else none for k in range(cols)]
        low = done[c]
        if len(low[0]):
            ell = none
            if lcp:
                ell = np.append(0, low[1][:0:-1]).astype(np.int32)
                ell[0] = _shared(t, int(down[0][-1]), int(low[0][-1]), cap) if len(down[0]) else 0
            pred = low[0][::-1] - 1
            ok = pred >= 0
            ok &= is_s[pred] & (t[pred] < c)
            if ok.any():
                _dispatch(q, pred, t[pred], ok, ell, carry, -1, cap, lcp)
        sa.append(np.concatenate([low[0], down[0][::-1]]))
        if lcp:
            high = np.append(0, down[1][:0:-1]).astype(np.int32) if len(down[0]) else none
            if len(high) and len(low[0]):
                high[0] = _shared(t, int(down[0][-1]), int(low[0][-1]), cap)
            ells.append(np.concatenate([low[1], high]))
    q.close()
    return np.concatenate(sa[::-1]), np.concatenate(ells[::-1]) if lcp else None


def _lanes(t: np.ndarray) -> tuple[np.ndarray, int]:
    """Several symbols from each position on as one number, and how many; zeros follow the end."""
    most = int(t.max()) + 2
    per = 4 if most < 1 << 16 else 2 if most < 1 << 32 else 1
    padded = np.zeros(len(t) + per, np.uint64)
    padded[: len(t)] = t.astype(np.uint64) + np.uint64(1)
    out = np.zeros(len(t) + 1, np.uint64)
    for k in range(per):
        out |= padded[k : k + len(out)] << np.uint64(64 // per * k)
    return out, per


def common_prefixes(lanes: tuple[np.ndarray, int], n: int, a: np.ndarray, b: np.ndarray, known: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at a and b (a != b) share, up to `most`, of which `known` are known to agree."""
    lane, per = lanes
    shift = 64 // per
    out = np.minimum(known, most)
    live = np.flatnonzero(out < most)
    at = out[live]
    while len(live):
        x = lane[a[live] + at] ^ lane[b[live] + at]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, per, np.bitwise_count(low - np.uint64(1)) // shift).astype(np.int64)
        at = at + same
        on = (same == per) & (at < most[live])
        out[live] = at
        live, at = live[on], at[on]
    return np.minimum(out, most)


def ranked(names: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a string of names in order, by at least the first `depth` names, and how many names each surely shares
    with the one before it (half of what it does share, at least, or `depth`)."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    sorted_names = names[order]
    new = np.ones(n, bool)
    new[1:] = sorted_names[1:] != sorted_names[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = start, -1
    agree = np.where(new, 0, depth)
    h = 1
    open_ = np.flatnonzero(~new | np.append(~new[1:], False))
    while len(open_) and h < depth:
        item = order[open_]
        group, second = rank[item], rank[np.minimum(item + h, n)]
        by = np.lexsort((second, group))
        item, group, second = item[by], group[by], second[by]
        order[open_] = item
        head = np.ones(len(item), bool)
        head[1:] = group[1:] != group[:-1]
        new = head.copy()
        new[1:] |= second[1:] != second[:-1]
        agree[open_[new & ~head]] = h
        rank[item] = open_[np.maximum.accumulate(np.where(new, np.arange(len(item)), 0))]
        open_ = open_[~new | np.append(~new[1:], False)]
        h *= 2
    return order, agree


def _in_memory(names: np.ndarray, depth: int, memory: int) -> tuple[np.ndarray, np.ndarray]:
    return ranked(names, depth)


def suffix_array(t: np.ndarray, cap: int, memory: int = 64 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, what each suffix shares with the one before it, up to cap) of a string of small integers.

    Suffixes that share cap symbols or more are in either order; all others are in lexicographic order. memory bounds
    the tuples that the queues hold; the string itself, its types and the result are plain arrays."""
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    is_s = types(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]).astype(np.int32) + 1
    if len(lms):
        by_first = lms[np.argsort(t[lms], kind="stable")]
        order, _ = induce(t, is_s, by_first, None, cap, memory)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        sorted_lms = order[is_lms[order]]
        place = np.empty(n, np.int32)
        place[lms] = np.arange(len(lms), dtype=np.int32)
        size = np.append(np.diff(lms) + 1, n - lms[-1]).astype(np.int64)  # each ends with the next one's first symbol
        which = place[sorted_lms]
        lanes = _lanes(t)
        a, b = sorted_lms[:-1].astype(np.int64), sorted_lms[1:].astype(np.int64)
        both = np.minimum(size[which[:-1]], size[which[1:]])
        same = (size[which[:-1]] == size[which[1:]]) & (which[:-1] != len(lms) - 1) & (which[1:] != len(lms) - 1)  # the last one ends with the string
        on = np.flatnonzero(same)
        same[on] = common_prefixes(lanes, n, a[on], b[on], np.zeros(len(on), np.int64), both[on]) == both[on]
        known = np.zeros(len(a), np.int64)
        if same.any():
            names = np.empty(len(lms), np.int64)
            names[which] = np.cumsum(np.append(0, ~same))
            which, agree = (suffix_array if len(names) * NAME_BYTES > memory else _in_memory)(names, cap // 2 + 2, memory)
            known = lms[np.minimum(which[:-1] + agree[1:], len(lms) - 1)] - lms[which[:-1]].astype(np.int64)
            lms = lms[which]
        else:
            lms = sorted_lms
        a, b = lms[:-1].astype(np.int64), lms[1:].astype(np.int64)
        shared = np.append(0, common_prefixes(lanes, n, a, b, known, np.minimum(cap, n - np.maximum(a, b)))).astype(np.int32)
    else:
        shared = np.zeros(0, np.int32)
    return induce(t, is_s, lms, shared, cap, memory)
