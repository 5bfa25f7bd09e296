"""Large groups of near copies around the threshold: the classes of brute force, by few pairs."""

from collections import Counter

import numpy as np
import pytest
from test_text_operators import _brute, docs

from riskloom.llm import minhash
from riskloom.llm.common import shingle_set


def group(n, edits, length=220, places=None, seed=0):
    """Copies of one text with ``edits`` words changed each; where ``places`` is given, at that many places with few new words."""
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 5_000, length)]
    rows = []
    for i in range(n):
        w = list(base)
        at = rng.choice(places or length, size=edits, replace=False)
        for j in at:
            w[j] = f"n{rng.integers(0, 3 if places else 10**6)}"
        rows.append((seed * 10_000 + i, " ".join(w)))
    return rows


@pytest.mark.parametrize("edits, places", [(11, None), (7, None), (9, 40), (14, 60)], ids=["below", "around", "shared edits", "shared edits, far"])
def test_groups_at_the_threshold(spark, edits, places, monkeypatch):
    """No link is lost, and the pairs formed are far fewer than those of the group, whose nodes mostly lie apart."""
    formed = Counter()
    likely, settle = minhash.likely, minhash.settle

    def counted(pairs, *rest):
        formed["bands"] += pairs.count()
        return likely(pairs, *rest)

    def kept(df, name="state"):
        out = settle(df, name)
        if name == "pairs":
            formed["differences"] += out.count()
        return out

    monkeypatch.setattr(minhash, "likely", counted)
    monkeypatch.setattr(minhash, "settle", kept)
    rows = group(250, edits, places=places, seed=edits)
    got = minhash.near_duplicates(docs(spark, rows), 3, 85)
    assert Counter(map(tuple, got.collect())) == _brute(rows, 3, 85)
    if edits == 11 and not places:
        assert sum(formed.values()) < 250 * 249 / 2 / 5, formed


def test_nine_hundred_copies_just_below_the_threshold(spark, monkeypatch):
    """Links next to an intersection of all sets by matrix product, and the pairs formed."""
    formed = Counter()
    settle = minhash.settle

    def kept(df, name="state"):
        out = settle(df, name)
        if name == "pairs":
            formed["differences"] += out.count()
        return out

    likely = minhash.likely

    def counted(pairs, *rest):
        formed["bands"] += pairs.count()
        return likely(pairs, *rest)

    monkeypatch.setattr(minhash, "settle", kept)
    monkeypatch.setattr(minhash, "likely", counted)
    rows = group(900, 6, seed=4)
    sets = [shingle_set(t.encode(), 3) for _, t in rows]
    items = np.unique(np.concatenate(sets))
    x = np.zeros((len(sets), len(items)), np.float32)
    for i, s in enumerate(sets):
        x[i, np.searchsorted(items, s)] = 1
    inner, size = x @ x.T, x.sum(axis=1)
    linked = 100 * inner >= 85 * (size[:, None] + size[None, :] - inner)
    group_of = np.arange(len(sets))
    while True:
        near = np.where(linked, group_of[None, :], len(sets)).min(axis=1)
        if (near == group_of).all():
            break
        group_of = near
    ids = np.array([d for d, _ in rows])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows), 3, 85).collect()}
    assert got == {int(d): int(ids[g]) for d, g in zip(ids, group_of)}
    assert sum(formed.values()) < 900 * 899 / 2 / 10, formed
