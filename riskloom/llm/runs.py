"""Runs of repeated words, found on a grammar of each text.

A run is a stretch of words with smallest period q, at least ``max(24, 3 q)`` words long, that no
neighbouring word extends keeping that period. Texts are compressed by Re-Pair (the commonest pair of
adjacent symbols becomes a new symbol, again and again). A run crosses the boundary of exactly one node
of the derivation, the lowest that holds it whole. So each symbol is asked once for the runs that cross
the boundary between its two parts; what it answers holds wherever the symbol stands in the text, and of
the stretches so placed those of one period that overlap by a period or more are pieces of one run.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, per_batch, windows, words

LEAST_WORDS = 24
LEAST_PERIODS = 3
# Every window of so many words within a run stands once more in it, one period away: of a run of
# L >= 24 and 3 q words, a window of k words fits neither before nor behind itself only if k > L - 2 q >= 8.
WINDOW = LEAST_WORDS // LEAST_PERIODS


def re_pair(seq: list[int], first: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Grammar of a sequence: the start sequence and, for the symbols from ``first`` on, their two parts.

    Negative symbols end a stretch and pair with nothing. Of equally frequent pairs the one met first
    is taken, which keeps derivations of periodic words flat.
    """
    n = len(seq)
    sym = list(seq)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    where: dict[tuple[int, int], set[int]] = {}
    age: dict[tuple[int, int], int] = {}

    def add(i: int) -> tuple[int, int] | None:
        j = nxt[i]
        if j >= n or sym[i] < 0 or sym[j] < 0:
            return None
        pair = (sym[i], sym[j])
        if pair[0] == pair[1]:  # of three equal symbols, overlapping pairs count once
            h = prv[i]
            if h >= 0 and h in where.get(pair, ()):
                return None
        where.setdefault(pair, set()).add(i)
        age.setdefault(pair, len(age))
        return pair

    def drop(i: int) -> None:
        j = nxt[i]
        if 0 <= i and j < n:
            found = where.get((sym[i], sym[j]))
            if found:
                found.discard(i)

    for i in range(n):
        add(i)
    heap = [(-len(at), age[p], p) for p, at in where.items() if len(at) > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        count, old, pair = heapq.heappop(heap)
        at = where.get(pair)
        if not at or len(at) < 2:
            continue
        if len(at) != -count:  # its number has changed since it was put here
            heapq.heappush(heap, (-len(at), old, pair))
            continue
        new = first + len(rules)
        rules.append(pair)
        del where[pair]
        touched = set()
        for i in sorted(at):
            j = nxt[i]
            if j >= n or (sym[i], sym[j]) != pair:
                continue
            h, k = prv[i], nxt[j]
            if h >= 0:
                drop(h)
            drop(j)
            sym[i], sym[j] = new, -1
            nxt[i] = k
            if k < n:
                prv[k] = i
            if h >= 0 and (p := add(h)):
                touched.add(p)
            if p := add(i):
                touched.add(p)
        for p in touched:
            if len(where[p]) > 1:
                heapq.heappush(heap, (-len(where[p]), age[p], p))
    start, i = [], 0
    while i < n:
        start.append(sym[i])
        i = nxt[i]
    return start, rules


class _Text:
    """Word ids of one text, and for each window of words the distances to its next and previous recurrence."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.windows = w = windows(ids.astype(np.uint64) + np.uint64(1), WINDOW)
        order = np.argsort(w, kind="stable")
        gap = np.where(w[order[1:]] == w[order[:-1]], order[1:] - order[:-1], 0)
        self.after, self.before = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
        self.after[order[:-1]], self.before[order[1:]] = gap, gap

    def crossing(self, left: int, mid: int, right: int) -> list[tuple[int, int, int]]:
        """Stretches (start, end, period) within [left, right) that hold the words mid - 1 and mid, as long as a run must be."""
        most = (right - left) // LEAST_PERIODS
        periods: set[int] = set()
        for at in (mid, mid - WINDOW):  # a run of 24 words across mid holds the window behind mid or the one before it
            if at < left or at + WINDOW > right:
                continue
            a, b = self.after[at], self.before[at]
            if (0 < a <= most and at + a + WINDOW <= right) or (0 < b <= most and at - b >= left):
                lo, hi = max(left, at - most), min(right - WINDOW, at + most) + 1
                periods.update(np.abs(np.flatnonzero(self.windows[lo:hi] == self.windows[at]) + (lo - at)).tolist())
        periods.discard(0)
        found: dict[tuple[int, int], int] = {}
        for q in sorted(periods):
            # words i and i + q are equal within a run; one across mid has such an i at mid - 1 or at mid - q
            for i in {mid - 1, mid - q}:
                if i < left or i + q >= right or self.ids[i] != self.ids[i + q]:
                    continue
                if any(q % p == 0 and s <= i and i + q < e and e - s >= p + q for (s, e), p in found.items()):
                    continue  # by a divisor of q the same stretch was found
                s, e = self._back(i, left, q), self._forth(i, right - q, q) + q
                if mid < e and e - s >= max(LEAST_WORDS, LEAST_PERIODS * q):
                    found.setdefault((s, e), q)
        return [(s, e, q) for (s, e), q in found.items()]

    def _back(self, i: int, left: int, q: int) -> int:
        """The least s from which on all words up to i equal those q further on."""
        x, step = self.ids, 32
        while i > left:
            j = max(left, i - step)
            bad = np.flatnonzero(x[j:i] != x[j + q:i + q])
            if len(bad):
                return j + int(bad[-1]) + 1
            i, step = j, 2 * step
        return i

    def _forth(self, i: int, top: int, q: int) -> int:
        """The first word from i on, or top, that differs from the one q further on."""
        x, step = self.ids, 32
        while i < top:
            j = min(top, i + step)
            bad = np.flatnonzero(x[i:j] != x[i + q:j + q])
            if len(bad):
                return i + int(bad[0])
            i, step = j, 2 * step
        return i


def find_runs(tokens: list[bytes]) -> list[tuple[int, int, int]]:
    """All runs of a text as (start, length, period), by start, then period."""
    n = len(tokens)
    if n < LEAST_WORDS:
        return []
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(t, len(number)) for t in tokens), np.int64, n)
    text = _Text(ids)
    again = (text.after > 0) | (text.before > 0)
    # Stretches whose windows all recur; no run reaches beyond one, see WINDOW.
    edges = np.flatnonzero(np.diff(np.concatenate([[False], again, [False]]).astype(np.int8)))
    parts = [(int(a), int(b) + WINDOW - 1) for a, b in edges.reshape(-1, 2)]
    parts = [(a, b) for a, b in parts if b - a >= LEAST_WORDS]
    if not parts:
        return []
    seq: list[int] = []
    place: list[int] = []
    for a, b in parts:
        seq += ids[a:b].tolist() + [-1]
        place.append(a)
    start, rules = re_pair(seq, len(number))
    return _merge(_derive(text, start, rules, len(number), place))


def _derive(text: _Text, start: list[int], rules: list[tuple[int, int]], first: int, place: list[int]) -> dict[int, list[tuple[int, int]]]:
    """Stretches (start, end) by period: those of each symbol's boundary, moved to all places it stands at."""
    size = [1] * first
    for a, b in rules:
        size.append(size[a] + size[b])
    stands: dict[int, list[int]] = defaultdict(list)
    out: dict[int, list[tuple[int, int]]] = defaultdict(list)
    level: list[tuple[int, int]] = []
    stretch = iter(place)
    at = None

    def join() -> None:
        # the start sequence of a stretch as a balanced tree of pairs; each pair stands once
        nodes = level[:]
        while len(nodes) > 1:
            up = []
            for k in range(0, len(nodes) - 1, 2):
                (a, m), (_, b) = nodes[k], nodes[k + 1]
                if b - a >= LEAST_WORDS:
                    for s, e, q in text.crossing(a, m, b):
                        out[q].append((s, e))
                up.append((a, b))
            if len(nodes) % 2:
                up.append(nodes[-1])
            nodes = up

    for x in start:
        if at is None:
            at = next(stretch)
        if x < 0:
            join()
            level, at = [], None
            continue
        if size[x] >= LEAST_WORDS:
            stands[x].append(at)
        level.append((at, at + size[x]))
        at += size[x]
    for x in range(first + len(rules) - 1, first - 1, -1):
        places = stands.pop(x, None)
        if not places:
            continue
        a, b = rules[x - first]
        if size[a] >= LEAST_WORDS:
            stands[a] += places
        if size[b] >= LEAST_WORDS:
            stands[b] += [p + size[a] for p in places]
        one = places[0]
        for s, e, q in text.crossing(one, one + size[a], one + size[x]):
            out[q] += [(p + s - one, p + e - one) for p in places]
    return out


def _merge(found: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
    """Maximal intervals: stretches of one period that share a period or more are one."""
    runs = []
    for q, spans in found.items():
        spans = sorted(set(spans))
        s, e = spans[0]
        for a, b in spans[1:]:
            if a + q <= e:
                e = max(e, b)
            else:
                runs.append((s, e - s, q))
                s, e = a, b
        runs.append((s, e - s, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(tokens: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return tokens
    gone = np.zeros(len(tokens) + 1, np.int64)
    for s, length, q in runs:
        gone[s + q] += 1
        gone[s + length] -= 1
    return [t for t, g in zip(tokens, np.cumsum(gone[:-1]).tolist()) if not g]


RUN = T.ArrayType(T.StructType([T.StructField(f, T.LongType(), False) for f in ("start", "length", "period")]), False)
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_words, runs (start, length, period by start, then period) and collapsed, the kept words joined by a space.

    One row for each row given, so repeated rows and ids stay. A null or empty text has no word, no run
    and the collapsed text "". Further columns are left out. A text is handled whole by one task, in
    memory that grows with its length alone.
    """
    schema = T.StructType(
        [docs.schema[k] for k in keep]
        + [T.StructField("n_words", T.LongType()), T.StructField("runs", RUN), T.StructField("collapsed", T.StringType())])
    source = docs.select(*[F.col(k) for k in keep], as_bytes(text))

    def make():
        def of(batch: pa.RecordBatch) -> dict[str, object]:
            out: dict[str, object] = {k: batch.column(i) for i, k in enumerate(keep)}
            sizes, runs, left = [], [], []
            for t in batch.column(len(keep)).to_pylist():
                tokens = words(t)
                found = find_runs(tokens)
                sizes.append(len(tokens))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                left.append(b" ".join(collapse(tokens, found)))
            out |= {"n_words": pa.array(sizes, pa.int64()), "runs": pa.array(runs, _RUN),
                    "collapsed": pa.array(left, pa.binary()).cast(pa.string())}
            return out
        return of

    return per_batch(source, schema, make)
