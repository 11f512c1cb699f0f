"""Segmentation of text by a dictionary: a prefix trie, the best path by dynamic programming, and a user's words first.

A stretch of letters and digits is cut so that the sum of the log frequencies of its words is greatest; of equal cuts
the one with the longer word first counts. A character that no word begins at stands alone, with the frequency of a word
used less than once. Words of a user's dictionary go before: wherever one begins, the longest that does is a term, from
left to right, and only what lies between is cut by frequencies. Neighbouring characters without a word become one term
unless they are Han, which stay apart.

The dictionary goes to all tasks, so its size is checked: MOST_WORDS words and MOST_CHARS characters at most. A larger
one is refused; ``frequent_words`` makes one within bounds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import STOP_WORDS

MOST_WORDS = 1_000_000
MOST_CHARS = 16 << 20
#: Sums that differ by less are equal.
TIE = 1e-9
_RUN = re.compile(r"[^\W_]+")
_HAN = re.compile(r"[⺀-⿟々-〇〡-〩〸-〻㐀-䶿一-鿿豈-﫿\U00020000-\U000323af]")
#: The key of a trie's node that says that a word ends there, and holds its value.
_END = ""


def trie(words: Iterable[tuple[str, float]]) -> dict:
    root: dict = {}
    for word, value in words:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[_END] = value
    return root


class Dictionary:
    """Words with how often they are used, and a user's own words."""

    def __init__(self, words: dict[str, float], own: Iterable[str] = ()):
        words = {w: n for w, n in words.items() if w and n > 0}
        self.total = math.log(sum(words.values()) or 1.0)
        self.words = trie((w, math.log(n) - self.total) for w, n in words.items())
        self.unknown = -self.total - math.log(2.0)
        self.own = trie((w, 0.0) for w in own if w)

    def _matches(self, root: dict, text: str, at: int) -> Iterable[tuple[int, float]]:
        """Ends and values of the words that begin at a place."""
        node = root
        for end in range(at, len(text)):
            node = node.get(text[end])
            if node is None:
                return
            if _END in node:
                yield end + 1, node[_END]

    def _best(self, text: str) -> list[tuple[str, bool]]:
        """The words of the best cut, and whether each is one of the dictionary."""
        n = len(text)
        score, step = [0.0] * (n + 1), [(0, False)] * (n + 1)
        for i in range(n - 1, -1, -1):
            score[i], step[i] = self.unknown + score[i + 1], (i + 1, False)
            for end, value in self._matches(self.words, text, i):
                if value + score[end] >= score[i] - TIE:  # ends come in order, so the longest of equals stays
                    score[i], step[i] = value + score[end], (end, True)
        out, i = [], 0
        while i < n:
            end, known = step[i]
            out.append((text[i:end], known))
            i = end
        return out

    def _stretch(self, text: str) -> list[tuple[str, bool]]:
        out, start, i = [], 0, 0
        while i < len(text) and self.own:
            longest = max((end for end, _ in self._matches(self.own, text, i)), default=0)
            if longest:
                out += [*self._best(text[start:i]), (text[i:longest], True)]
                start = i = longest
            else:
                i += 1
        return out + self._best(text[start:])

    def cut(self, text: str | None) -> list[str]:
        """All terms of a text in order."""
        out: list[str] = []
        for run in _RUN.findall(text or ""):
            alone = ""
            for word, known in self._stretch(run):
                if not known and not _HAN.match(word):
                    alone += word
                    continue
                if alone:
                    out.append(alone)
                    alone = ""
                out.append(word)
            if alone:
                out.append(alone)
        return out


def frequent_words(texts: DataFrame, most: int, text: str = "text") -> DataFrame:
    """word, n: the ``most`` frequent words, lower-cased, of two characters or more."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word"))
    counts = words.where("length(word) > 1").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(most)


def dictionary(words: DataFrame, own: Iterable[str] = ()) -> Dictionary:
    """A dictionary of ``words`` (word, n), whose size is checked before they are collected."""
    size = words.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("word")).alias("chars")).first()
    if size.n > MOST_WORDS or (size.chars or 0) > MOST_CHARS:
        raise ValueError(f"a dictionary has {MOST_WORDS} words and {MOST_CHARS} characters at most")
    return Dictionary({r.word: float(r.n) for r in words.select("word", "n").collect() if r.word}, own)


def segmenter(known: Dictionary, stop_words: Iterable[str] = tuple(STOP_WORDS)) -> Callable[[Column], Column]:
    """A function from a text column to its terms, longer than one character and no stop words, for ``retrieval.Segmenter``."""
    from pyspark.sql import SparkSession

    shared, stops = SparkSession.active().sparkContext.broadcast(known), frozenset(stop_words)

    @F.arrow_udf("array<string>")
    def terms(texts: pa.Array) -> pa.Array:
        cut = shared.value.cut
        return pa.array([[w for w in cut(t) if len(w) > 1 and w not in stops] for t in texts.to_pylist()], pa.list_(pa.string()))

    return lambda text: terms(text)
