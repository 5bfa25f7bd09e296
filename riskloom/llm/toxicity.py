"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as the sum of its own vector and the mean vector of its character n-grams. Two
gated recurrent layers read each window of words in either direction, attention pools their
states, and a text scores as its highest-scoring window. Training is plain numpy on the driver,
over a bounded sample. Scoring covers every word of every text by windows of WINDOW words that start
every STRIDE words: each word but those near a text's ends lies in two windows, and a phrase of up to
WINDOW - STRIDE + 1 words lies whole in one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import per_batch, windows

WINDOW, STRIDE = 32, 16
DIM, HIDDEN = 16, 8
BUCKETS = 1 << 15  # of hashed character n-grams
GRAMS = (3, 4, 5)
MISSED = 3  # cost of a toxic text passed over, that of a clean one flagged being 1
LEAST_STEPS = 150  # of training in each round, however few the texts
SAMPLE_ROWS = 3_000  # of each class, at most
SAMPLE_CHARS = 20_000  # longer texts are not learned from
LEAST_DOCS = 3  # documents in which a word must occur to have a vector
EPOCHS, ROUNDS, BATCH, RATE, VECTOR_RATE = 4, 2, 256, 0.01, 0.05
LIMIT = 250_000  # words whose inputs a task keeps
CHUNK = 2_048  # windows run at once
_TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def grams(many: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of words between marks, one word after the other, and how many each word has."""
    marked = [f"<{w}>" for w in many]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    word = np.repeat(np.arange(len(many)), lengths)
    place = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left = np.repeat(lengths, lengths) - place  # characters from here to the word's end
    found, owners = [], []
    for n in GRAMS:
        if n <= len(points):
            runs = (windows(points, n) % np.uint64(BUCKETS)).astype(np.int64)
            own = left[: len(runs)] >= n
            found.append(runs[own])
            owners.append(word[: len(runs)][own])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order], np.bincount(owner, minlength=len(many))


def starts(n: int) -> list[int]:
    """Window starts over n words; the last window ends with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


@dataclass
class Model:
    vocab: dict[str, int]
    words: np.ndarray
    chars: np.ndarray
    wx: np.ndarray  # DIM x 6 HIDDEN: update, reset and candidate of either direction
    bx: np.ndarray
    uh: np.ndarray  # 2 x HIDDEN x 3 HIDDEN
    wa: np.ndarray
    va: np.ndarray
    wo: np.ndarray
    bo: np.ndarray

    def inputs(self, many: list[str]) -> np.ndarray:
        flat, sizes = grams(many)
        x = _sums(self.chars[flat], np.cumsum(sizes) - sizes) / sizes[:, None].astype(np.float32)
        own = np.fromiter((self.vocab.get(w, -1) for w in many), np.int64, len(many))
        x[own >= 0] += self.words[own[own >= 0]]
        return x


def _sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def forward(m: Model, px: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows. px: windows x words x 6 HIDDEN projected inputs; mask: windows x words."""
    n, steps, _ = px.shape
    states = np.zeros((n, steps, 2 * HIDDEN), px.dtype)
    trace = []
    for d in range(2):
        h = np.zeros((n, HIDDEN), px.dtype)
        u, off = m.uh[d], 3 * HIDDEN * d
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            x = px[:, t, off : off + 3 * HIDDEN]
            zr = _sigmoid(x[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
            k = mask[:, t, None]
            new = h + k * z * (c - h)
            if keep:
                trace.append((d, t, h, z, r, c, k))
            h = new
            states[:, t, d * HIDDEN : (d + 1) * HIDDEN] = h
    key = np.tanh(states @ m.wa)
    a = key @ m.va + np.where(mask > 0, 0.0, -1e9).astype(px.dtype)
    a = np.exp(a - a.max(axis=1, keepdims=True))
    a /= a.sum(axis=1, keepdims=True)
    pooled = (a[:, :, None] * states).sum(axis=1)
    logit = pooled @ m.wo + m.bo[0]
    return (logit, (states, key, a, pooled, trace)) if keep else logit


def gradients(m: Model, px, mask, kept, dlogit):
    """Gradients of the network's weights and of px, for d loss / d logit."""
    states, key, a, pooled, trace = kept
    g = {"wo": pooled.T @ dlogit, "bo": np.array([dlogit.sum()], px.dtype), "uh": np.zeros_like(m.uh)}
    dpool = dlogit[:, None] * m.wo
    da = (dpool[:, None, :] * states).sum(axis=2)
    dscore = a * (da - (a * da).sum(axis=1, keepdims=True))
    dstates = a[:, :, None] * dpool[:, None, :]
    dkey = dscore[:, :, None] * m.va * (1 - key**2)
    g["va"] = (key * dscore[:, :, None]).sum(axis=(0, 1))
    g["wa"] = states.reshape(-1, 2 * HIDDEN).T @ dkey.reshape(-1, dkey.shape[2])
    dstates = dstates + dkey @ m.wa.T
    dpx = np.zeros_like(px)
    dh = [np.zeros((len(px), HIDDEN), px.dtype) for _ in range(2)]
    for d, t, h, z, r, c, k in reversed(trace):
        u, off = m.uh[d], 3 * HIDDEN * d
        e = dh[d] + dstates[:, t, d * HIDDEN : (d + 1) * HIDDEN]
        dz, dc = e * k * (c - h), e * k * z
        dpre_c = dc * (1 - c**2)
        drh = dpre_c @ u[:, 2 * HIDDEN :].T
        dpre_z, dpre_r = dz * z * (1 - z), drh * h * r * (1 - r)
        pre = np.concatenate([dpre_z, dpre_r], axis=1)
        g["uh"][d][:, : 2 * HIDDEN] += h.T @ pre
        g["uh"][d][:, 2 * HIDDEN :] += (r * h).T @ dpre_c
        dpx[:, t, off : off + 2 * HIDDEN] = pre
        dpx[:, t, off + 2 * HIDDEN : off + 3 * HIDDEN] = dpre_c
        dh[d] = e * (1 - k * z) + drh * r + pre @ u[:, : 2 * HIDDEN].T
    return g, dpx


def _sums(rows: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(rows, firsts, axis=0) if len(firsts) else rows


def _grouped(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of the rows of each."""
    order = np.argsort(keys, kind="stable")
    found, firsts = np.unique(keys[order], return_index=True)
    return found, _sums(rows[order], firsts)


def train(texts: list[tuple[list[str], int]], seed: int = 7) -> Model:
    """Fit on (words, label) pairs. A text teaches by its strongest windows under the model so far."""
    rng = np.random.default_rng(seed)
    texts = [(w, y) for w, y in texts if w]
    order = rng.permutation(len(texts))
    part = len(texts) // 5 if min(sum(1 for _, y in texts if y == k) for k in (0, 1)) >= 50 else 0
    kept_back, texts = [texts[i] for i in order[:part]], [texts[i] for i in order[part:]]
    n_docs = [sum(1 for _, y in texts if y == k) for k in (0, 1)]
    seen: dict[str, list[int]] = {}
    for w, y in texts:
        for x in set(w):
            seen.setdefault(x, [0, 0])[y] += 1
    vocab = {w: i for i, w in enumerate(sorted(w for w, c in seen.items() if sum(c) >= LEAST_DOCS))}
    odds = lambda c: np.log((c[1] + 0.5) / (n_docs[1] + 1)) - np.log((c[0] + 0.5) / (n_docs[0] + 1))
    names = sorted(seen)
    place = {w: i for i, w in enumerate(names)}
    flat, sizes = grams(names)
    ends = np.cumsum(sizes) - sizes
    own = np.array([vocab.get(w, -1) for w in names])
    coded = [(np.array([place[x] for x in w]), y) for w, y in texts]

    def spans(ids: np.ndarray) -> np.ndarray:
        """Places in ``flat`` of the n-grams of words, one word after the other."""
        firsts = np.cumsum(sizes[ids]) - sizes[ids]
        return np.arange(sizes[ids].sum()) + np.repeat(ends[ids] - firsts, sizes[ids])

    gram_docs = np.zeros((BUCKETS, 2))
    for ids, y in coded:
        gram_docs[np.unique(flat[spans(np.unique(ids))]), y] += 1
    sure = np.minimum(1.0, gram_docs.sum(axis=1) / 10)
    f32 = np.float32
    glorot = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2] if len(s) > 1 else s[0])).astype(f32)
    m = Model(
        vocab, (0.01 * rng.standard_normal((max(1, len(vocab)), DIM))).astype(f32), (0.01 * rng.standard_normal((BUCKETS, DIM))).astype(f32),
        glorot(DIM, 6 * HIDDEN), np.zeros(6 * HIDDEN, f32), 0.5 * glorot(2, HIDDEN, 3 * HIDDEN),
        glorot(2 * HIDDEN, HIDDEN), glorot(HIDDEN), glorot(2 * HIDDEN), np.zeros(1, f32))
    # The first coordinate starts as the log odds of documents with the unit being of class 1.
    m.chars[:, 0] = np.clip(np.log((gram_docs[:, 1] + 0.5) / (n_docs[1] + 1)) - np.log((gram_docs[:, 0] + 0.5) / (n_docs[0] + 1)), -4, 4) * sure
    for w, i in vocab.items():
        m.words[i, 0] = np.clip(odds(seen[w]), -4, 4) * min(1.0, sum(seen[w]) / 10)

    def embed(ids: np.ndarray) -> np.ndarray:
        x = np.concatenate([_sums(m.chars[flat[spans(p)]], np.cumsum(sizes[p]) - sizes[p]) / sizes[p, None].astype(f32)
                            for p in (ids[i : i + 20_000] for i in range(0, len(ids), 20_000))])
        has = own[ids] >= 0
        x[has] += m.words[own[ids][has]]
        return x

    def cut(ids: np.ndarray, start: int) -> np.ndarray:
        out = np.full(WINDOW, -1)
        part = ids[start : start + WINDOW]
        out[: len(part)] = part
        return out

    every = [(cut(ids, s), y, d) for d, (ids, y) in enumerate(coded) for s in starts(len(ids))]
    rows = np.stack([w for w, _, _ in every])
    label, doc = np.array([y for _, y, _ in every]), np.array([d for _, _, d in every])

    def strength() -> np.ndarray:
        table = np.concatenate([embed(np.arange(len(names))) @ m.wx + m.bx, np.zeros((1, 6 * HIDDEN), f32)])
        return np.concatenate([forward(m, table[rows[i : i + CHUNK]], (rows[i : i + CHUNK] >= 0).astype(f32)) for i in range(0, len(rows), CHUNK)])

    first = np.append(embed(np.arange(len(names)))[:, 0], 0.0)
    moments = {k: [np.zeros_like(getattr(m, k)), np.zeros_like(getattr(m, k))] for k in ("wx", "bx", "uh", "wa", "va", "wo", "bo")}
    step = 0
    for turn in range(ROUNDS):
        by = np.sort(first[rows], axis=1)[:, -3:].sum(axis=1) if turn == 0 else strength()
        order = np.lexsort((-by, doc))
        rank = np.empty(len(doc), int)
        new = np.r_[True, doc[order][1:] != doc[order][:-1]]
        rank[order] = np.arange(len(doc)) - np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
        chosen = np.flatnonzero((rank == 0) | (rank == 1) & (label == 0))
        extra = np.flatnonzero((rank > 1) & (label == 0))
        chosen = np.concatenate([chosen, rng.choice(extra, min(len(extra), len(coded)), replace=False)])
        for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(chosen)))):
            rng.shuffle(chosen)
            for i in range(0, len(chosen), BATCH):
                at = chosen[i : i + BATCH]
                ids, back = np.unique(rows[at], return_inverse=True)
                back = back.reshape(rows[at].shape)
                shift = int(ids[0] == -1)
                x = np.zeros((len(ids), DIM), f32)
                if len(ids) > shift:
                    x[shift:] = embed(ids[shift:])
                mask = (rows[at] >= 0).astype(f32)
                px = (x @ m.wx + m.bx)[back]
                logit, kept = forward(m, px, mask, keep=True)
                dlogit = ((_sigmoid(logit) - label[at]) / len(at)).astype(f32)
                g, dpx = gradients(m, px, mask, kept, dlogit)
                per_word = _grouped((dpx * mask[:, :, None]).reshape(-1, 6 * HIDDEN), back.ravel())[1]
                g["wx"], g["bx"] = x.T @ per_word, per_word.sum(axis=0)
                dx = per_word @ m.wx.T
                step += 1
                for k, v in g.items():
                    a, b = moments[k]
                    a *= 0.9
                    a += 0.1 * v
                    b *= 0.999
                    b += 0.001 * v * v
                    getattr(m, k)[...] -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
                real = ids[shift:]
                if not len(real):
                    continue
                spread = np.repeat(dx[shift:] / sizes[real, None].astype(f32), sizes[real], axis=0)
                touched, moved = _grouped(spread, flat[spans(real)])
                m.chars[touched] -= VECTOR_RATE * moved
                has = own[real] >= 0
                m.words[own[real][has]] -= VECTOR_RATE * dx[shift:][has]
    # The decision point comes from texts that taught nothing: midway in the gap with the least cost of errors.
    best = scorer(m)([w for w, _ in kept_back or texts])
    truth = np.array([y for _, y in kept_back or texts])[np.argsort(best, kind="stable")]
    best = np.sort(best)
    errors = np.r_[0, MISSED * np.cumsum(truth)] + np.r_[np.cumsum((truth == 0)[::-1])[::-1], 0]
    where = np.flatnonzero(errors == errors.min())
    lo, hi = best[max(where[0] - 1, 0)], best[min(where[-1], len(best) - 1)]
    m.bo -= np.float32((lo + hi) / 2)
    return m


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """Model of docs (doc_id, text) and labels (doc_id, toxic), toxic being 0 or 1; None if a class has no text with a word.

    Of each class, the labels with the smallest hashes of their ids are taken by a top-k: 2 x ``rows`` are looked up, so
    that at most 4 x ``rows`` ids are broadcast, and at most ``rows`` texts of up to SAMPLE_CHARS characters come to the
    driver, however often an id repeats among the documents.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("h")).distinct()
    least = [known.filter(F.col("toxic") == k).orderBy("h", "doc_id").limit(2 * rows) for k in (0, 1)]
    usable = docs.select("doc_id", "text").filter(F.col("text").rlike(r"\w") & (F.length("text") <= SAMPLE_CHARS))
    found = settle(usable.join(F.broadcast(least[0].unionByName(least[1])), "doc_id"), "labelled")
    texts: list[tuple[list[str], int]] = []
    for k in (0, 1):
        taken = found.filter(F.col("toxic") == k).orderBy("h", "doc_id", "text").select("text").limit(rows).collect()
        if not taken:
            return None
        texts += [(tokens(row.text), k) for row in taken]
    return train(texts)


def scorer(m: Model):
    """Function from lists of words to the highest window logit of each; -inf for no word."""
    place: dict[str, int] = {}
    table = np.zeros((1024, 6 * HIDDEN), np.float32)  # row 0 pads

    def of(texts: list[list[str]]) -> np.ndarray:
        nonlocal table
        if len(place) > LIMIT:
            place.clear()
        new = [w for w in dict.fromkeys(x for t in texts for x in t) if w not in place]
        if new:
            x = np.concatenate([m.inputs(new[i : i + 20_000]) @ m.wx for i in range(0, len(new), 20_000)]) + m.bx
            top = len(place) + 1 + len(new)
            if top > len(table):
                table = np.concatenate([table, np.zeros((top, 6 * HIDDEN), np.float32)])
            table[len(place) + 1 : top] = x
            place.update(zip(new, range(len(place) + 1, top)))
        best = np.full(len(texts), -np.inf, np.float32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = np.fromiter((place[w] for t in texts for w in t), np.int64, int(lengths.sum()))
        flat = np.concatenate([flat, np.zeros(WINDOW, np.int64)])
        firsts = np.cumsum(lengths) - lengths
        cuts = [starts(n) if n else [] for n in lengths.tolist()]
        doc = np.repeat(np.arange(len(texts)), list(map(len, cuts)))
        begin = np.fromiter((s for c in cuts for s in c), np.int64, len(doc))
        for i in range(0, len(doc), CHUNK):
            d, b = doc[i : i + CHUNK], begin[i : i + CHUNK]
            inside = b[:, None] + np.arange(WINDOW) < lengths[d][:, None]
            rows = np.where(inside, flat[(firsts[d] + b)[:, None] + np.arange(WINDOW)], 0)
            np.maximum.at(best, d, forward(m, table[rows], inside.astype(np.float32)))
        return best

    return of


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs`` (doc_id, text; other columns are ignored).

    Texts without a word, null ones included, and all texts without a model, score 0. Rows repeat as they come.
    """

    def make():
        best = scorer(model) if model else None

        def of(batch):
            texts = [tokens(t) for t in batch.column("text").to_pylist()]
            p = _sigmoid(best(texts).astype(np.float64)) if best else np.zeros(len(texts))
            return {"doc_id": batch.column("doc_id"), "score": pa.array(p, pa.float64()), "predicted": pa.array((p >= 0.5).astype(np.int32), pa.int32())}

        return of

    return per_batch(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        "doc_id long, score double, predicted int", make)
