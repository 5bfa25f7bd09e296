"""Language identification by cross-parsing.

Each language's sample is held as a suffix automaton. A text is cut, greedily and from left to
right, into the longest phrases that occur in the sample; a language in which the text falls
into few bits is a good model of it. A phrase takes as many as name a place of the sample, so that a
short sample, whose matches are short, is no drawback, but no more than its characters one by one. Words are parsed one by one, with the blanks around
them, so that the phrases of a word are counted once for all its occurrences.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, per_batch

UND = "und"
# Bounds of the fitting sample: rows per language, and the length of the texts preferred for it.
SAMPLE_ROWS = 40
SAMPLE_CHARS = (200, 4_000)
LONGEST_SAMPLE = 100_000  # characters per language; whole texts are left out beyond it, and one is cut if no other is left
SHARPNESS = 2.5  # per bit
LITERAL = 5.0  # bits of a character that no phrase covers: about those of a letter of an alphabet
_UNIT = 256  # costs are whole numbers of this part of a bit, so that sums are exact
_DIGIT = 48  # bits of a count
_MASK = (1 << _DIGIT) - 1
_WORDS = re.compile(r"[^\W\d_]+")


class SuffixAutomaton:
    """All substrings of a text; ``phrases`` counts the greedy longest matches that cover a string, ``cost`` their bits."""

    def __init__(self, text: str):
        moves: list[dict[str, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in text:
            cur = len(moves)
            moves.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p != -1 and c not in moves[p]:
                moves[p][c] = cur
                p = link[p]
            if p != -1:
                q = moves[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    twin = len(moves)
                    moves.append(dict(moves[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p != -1 and moves[p].get(c) == q:
                        moves[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        self.moves = moves
        self.place = round(_UNIT * math.log2(max(2, len(text))))

    def cost(self, text: str) -> int:
        """What the greedy phrases of a text take: the place in the sample, or its characters if that is less."""
        moves, root, place = self.moves, self.moves[0], self.place
        literal = round(_UNIT * LITERAL)
        total = run = 0
        state = root
        for c in text:
            to = state.get(c)
            if to is not None:
                state = moves[to]
                run += 1
                continue
            if run:
                total += literal if run == 1 else min(place, run * literal)
            to = root.get(c)
            if to is None:
                total += literal
                run, state = 0, root
            else:
                run, state = 1, moves[to]
        return total + (0 if not run else literal if run == 1 else min(place, run * literal))

    def phrases(self, text: str) -> int:
        """A character that the sample lacks is a phrase of its own."""
        moves, root = self.moves, self.moves[0]
        n, state = 0, root
        for c in text:
            to = state.get(c)
            if to is not None:
                state = moves[to]
                continue
            if state is not root:
                n += 1
            to = root.get(c)
            if to is None:
                n += 1
                state = root
            else:
                state = moves[to]
        return n + (state is not root)


def letters(text: str) -> list[str]:
    """Lower-case words of letters; none where superscripts, fractions and the like are all that looks like one."""
    found = _WORDS.findall(text.lower())
    return found if any(c.isalpha() for word in found for c in word) else []


def packer(parsers) -> Callable[[str], int]:
    """Function from a word to its length and its costs, as digits of one integer, so that texts are plain sums."""
    def of(word: str) -> int:
        blank = f" {word} "
        out = len(blank)
        for i, cost in enumerate(parsers, 1):
            out += cost(blank) << (_DIGIT * i)
        return out

    return of


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS, chars: int = LONGEST_SAMPLE) -> dict[str, str]:
    """Sample text per language from (doc_id, text, lang); rows with a null or empty value are not used.

    A sample is ``rows`` rows at most, chosen by a hash of the row, those of SAMPLE_CHARS first,
    and ``chars`` characters at most; where not one row fits whole, the first is cut. The languages are taken to number a few hundred at most.
    """
    size = F.length("text")
    usable = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND text RLIKE '\\\\p{L}'")
    order = W.partitionBy("lang").orderBy(~size.between(*SAMPLE_CHARS), F.xxhash64("doc_id", "text"), "text")
    # Of a text that is too long only a head comes to the driver, from its first letter on.
    head = F.when(size <= chars, F.col("text")).otherwise(F.substring(F.regexp_replace("text", r"^\P{L}++", ""), 1, chars))
    picked = usable.select("lang", head.alias("text"), (size <= chars).alias("fits"), F.row_number().over(order).alias("r")).filter(F.col("r") <= rows)
    samples: dict[str, list[str]] = {}
    taken: dict[str, int] = {}
    heads: dict[str, list[str]] = {}
    for row in picked.orderBy("lang", "r").toLocalIterator():
        if not row.fits and row.lang in heads:
            continue
        words = letters(row.text)
        n = sum(map(len, words)) + len(words)
        if not row.fits or n > chars:
            heads.setdefault(row.lang, " ".join(words)[:chars].split())
        elif taken.get(row.lang, 0) + n <= chars:
            samples.setdefault(row.lang, []).extend(words)
            taken[row.lang] = taken.get(row.lang, 0) + n
    return {k: f" {' '.join(v)} " for k, v in sorted((heads | samples).items()) if v}


_BUILT: dict[int, dict[str, SuffixAutomaton]] = {}


def _automata(samples: dict[str, str]) -> dict[str, SuffixAutomaton]:
    key = hash(tuple(samples.items()))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = {lang: SuffixAutomaton(text) for lang, text in samples.items()}
    return _BUILT[key]


def classify(packed: int, languages: int) -> tuple[int, float]:
    """Index of the language with the lowest cost (the first of equals), and how clear that is.

    The score is the winner's share when each language weighs exp(-SHARPNESS x bits per character): 1/2 is
    a tie of two.
    """
    size = packed & _MASK
    totals = [(packed >> (_DIGIT * i)) & _MASK for i in range(1, languages + 1)]
    best = min(range(languages), key=totals.__getitem__)
    return best, 1.0 / sum(math.exp(-min(700.0, SHARPNESS * (t - totals[best]) / (_UNIT * size))) for t in totals)


def labelled(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """``docs`` (text and any other columns but lang_pred and score) with lang_pred and score for every row.

    A null text, or one without a letter, and every text if no language was learned, gives ``und``
    and 0. Equal costs go to the language first in code order. Rows repeat as they come.
    """
    return _mapped(docs, docs.columns, samples)


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs`` (doc_id, text; other columns are ignored); see ``labelled``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _mapped(rows, ["doc_id"], samples)


def _mapped(docs: DataFrame, keep: list[str], samples: dict[str, str]) -> DataFrame:
    names = sorted(samples)

    def make():
        counts = Memo(packer([_automata(samples)[n].cost for n in names])).__getitem__

        def of(batch):
            langs, scores = [], []
            for text in batch.column("text").to_pylist():
                found = letters(text) if text and names else []
                best, score = classify(sum(map(counts, found)), len(names)) if found else (-1, 0.0)
                langs.append(names[best] if found else UND)
                scores.append(score)
            return {c: batch.column(c) for c in keep} | {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}

        return of

    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return per_batch(docs, schema, make)


def held_out(doc_id) -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
