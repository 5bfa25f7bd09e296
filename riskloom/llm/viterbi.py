"""Number of unigram tokens of a text, without making them.

An Aho-Corasick automaton of the vocabulary lists the pieces that end at each character, longest
first. Dynamic programming keeps the best score and its piece count per position. Ties go as in
the tokenizers library: the first candidate found, which starts earliest, stays unless beaten.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, as_bytes, per_batch, words

MARK = "▁"  # stands for the blank before a word
UNKNOWN_PENALTY = 10.0
_LEAST = -math.inf
_PARTS = re.compile(f"{MARK}[^{MARK}]*")


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """(piece, log probability) in id order. The file ranks its pieces; Zipf's law turns a rank into a probability."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or piece_path())
    n = model.get_piece_size()
    norm = math.log(sum(1 / (i + 1) for i in range(n)))
    return [(model.id_to_piece(i), -math.log(i + 1) - norm) for i in range(n)]


class Counter:
    """Pieces of single words under a unigram vocabulary."""

    def __init__(self, vocab: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.found.add_word(piece, (len(piece), score))
        self.found.make_automaton()
        self.single = {p for p, _ in vocab if len(p) == 1}
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in self.found for b in range(256))

    def __call__(self, word: str) -> int:
        if not self.single.issuperset(word):
            return self._with_unknown(word)
        best, count = [0.0] + [_LEAST] * len(word), [0] * (len(word) + 1)
        for end, (size, score) in self.found.iter(word):
            end += 1
            score += best[end - size]
            if score > best[end]:
                best[end], count[end] = score, count[end - size] + 1
        return count[-1]

    def _with_unknown(self, word: str) -> int:
        n, single, unknown = len(word), self.single, self.unknown
        best: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        lost = [False] * (n + 1)  # the last piece is an unknown character
        best[0], at = 0.0, 0

        def settle_until(end: int) -> None:
            """Characters that are no piece of their own may be unknown ones; tried after all longer pieces."""
            nonlocal at
            while at < end:
                if at and word[at - 1] not in single:
                    score = best[at - 1] + unknown
                    if best[at] is None or score > best[at]:
                        best[at] = score
                        lost[at] = True
                        if self.bytes:
                            count[at] = count[at - 1] + len(word[at - 1].encode())
                        else:
                            count[at] = count[at - 1] + (not lost[at - 1])
                at += 1

        for end, (size, score) in self.found.iter(word):
            end += 1
            settle_until(end)
            score += best[end - size]
            if best[end] is None or score > best[end]:
                best[end], count[end], lost[end] = score, count[end - size] + 1, False
        settle_until(n + 1)
        return count[n]


@lru_cache(maxsize=2)
def _word_counts(path: str) -> Memo:
    """Counts by word; the automaton is built once a worker."""
    pieces = Counter(vocabulary(path))
    return Memo(lambda w: sum(map(pieces, _PARTS.findall(MARK + w.decode()))))


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens for every row of ``docs`` (doc_id, text; other columns are ignored).

    Runs of white space (20, 09 to 0D hex) end words, each word is led by a blank mark, and
    characters outside the vocabulary count as their UTF-8 bytes. Null, empty and blank texts
    have no token. Repeated rows return one each.
    """
    place = path or piece_path()

    def make():
        of_word = _word_counts(place).__getitem__

        def of(batch):
            split = [words(t) for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "n_words": pa.array(map(len, split), pa.int64()),
                    "n_tokens": pa.array([sum(map(of_word, w)) for w in split], pa.int64())}

        return of

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text")), "doc_id long, n_words long, n_tokens long", make)
