"""The words of folded texts as numbers, in numpy.

What `text.word_tokens` and `text.with_bigrams` make of a text is found here for many texts at a time: Spark deals out the
texts and sums up what is counted, and a few array passes replace the strings of every word and word pair. Texts are taken
in slices, so the arrays do not grow with a batch.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import SparkSession, functions as F

from .text import WORD_CLASS

# Ship the functions by value: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_CHARS = 1 << 20  # texts are taken together up to this length; a longer one is a slice of its own
_POINTS = 0x110000
COUNTED = "_hash bigint, df bigint, tf bigint"
NAMED = "_hash bigint, term string"


@lru_cache(maxsize=1)
def word_points(spark: SparkSession) -> bytes:
    """A bit for every code point: whether the JVM counts it as part of a word, by the class that `text.word_tokens` uses."""
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, _POINTS)]))
    runs = spark.createDataFrame([(points,)], "points string").select(F.regexp_extract_all("points", F.lit(f"({WORD_CLASS}+)"), 1))
    inside = np.zeros(_POINTS, bool)
    inside[np.frombuffer("".join(runs.collect()[0][0]).encode("utf-32-le"), np.uint32)] = True
    return np.packbits(inside).tobytes()


def unpacked(points: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(points, np.uint8)).view(bool)


def slices(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in order, some at a time; a null is an empty text."""
    taken, chars = [], 0
    for text in texts:
        value = text.as_py() or ""
        if taken and chars + len(value) > SLICE_CHARS:
            yield taken
            taken, chars = [], 0
        taken.append(value)
        chars += len(value)
    if taken:
        yield taken


def coded_tokens(texts: list[str], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The position of the text and the code of every token, in order, and the token of every code.

    Codes are given by the tokens themselves, so equal codes are equal tokens.
    """
    points = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)  # a line break is in no word
    member = inside[points]
    edges = np.flatnonzero(np.diff(member.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    single = ends - starts < 2
    member[starts[single]] = False
    starts, ends = starts[~single], ends[~single]
    offsets = np.concatenate([[0], np.cumsum(ends - starts, dtype=np.int64)]) * 4
    tokens = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(points[member])])
    coded = tokens.dictionary_encode()
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    return np.searchsorted(text_ends, starts, "right"), coded.indices.to_numpy().astype(np.int64), _strings(coded.dictionary)


def _strings(words: pa.Array) -> list[str]:
    """The strings of a dictionary in UTF-32; all are decoded at once."""
    ends = [0, *np.cumsum(pc.binary_length(words).to_numpy() // 4).tolist()]
    text = words.buffers()[2].to_pybytes()[: 4 * ends[-1]].decode("utf-32-le") if ends[-1] else ""
    return [text[a:b] for a, b in zip(ends, ends[1:])]


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of every word."""
    return pd.util.hash_array(np.array(words, object), categorize=False) if words else np.empty(0, np.uint64)


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two words in order from theirs."""
    mixed = left * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) + right
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(31))


class _Terms:
    """The words and word pairs of a slice; a term is the code of its first word times ``width`` and that of its second plus one."""

    def __init__(self, texts: list[str], inside: np.ndarray):
        owners, codes, self.words = coded_tokens(texts, inside)
        self.width = len(self.words) + 1
        near = owners[1:] == owners[:-1]
        self.owners = np.concatenate([owners, owners[1:][near]])
        self.terms = np.concatenate([codes * self.width, codes[:-1][near] * self.width + codes[1:][near] + 1])

    def parts(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the first and, or -1, the second word."""
        return terms // self.width, terms % self.width - 1

    def hashes(self, terms: np.ndarray) -> np.ndarray:
        first, second = self.parts(terms)
        words = word_hashes(self.words)
        hashes = words[first]
        paired = second >= 0
        hashes[paired] = pair_hashes(hashes[paired], words[second[paired]])
        return hashes.view(np.int64)

    def names(self, terms: np.ndarray) -> list[str]:
        first, second = self.parts(terms)
        return [self.words[a] if b < 0 else f"{self.words[a]} {self.words[b]}" for a, b in zip(first.tolist(), second.tolist())]


def counter(points: bytes):
    """For `mapInArrow` over one column of folded texts: how many texts have a term and how often, by the term's hash.

    The rows of a slice are sums already; a hash has a row for every slice it is in.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = unpacked(points)
        for batch in batches:
            for texts in slices(batch.column(0)):
                found = _Terms(texts, inside)
                if not len(found.terms):
                    continue
                cells, counts = np.unique(found.terms * len(texts) + found.owners, return_counts=True)
                cells //= len(texts)
                starts = np.flatnonzero(np.diff(cells, prepend=-1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.hashes(cells[starts])),
                        pa.array(np.diff(starts, append=len(cells))),
                        pa.array(np.add.reduceat(counts, starts)),
                    ],
                    names=["_hash", "df", "tf"],
                )

    return count


def namer(points: bytes, wanted: np.ndarray):
    """For `mapInArrow` over one column of folded texts: the terms whose hash is in the sorted ``wanted``, once a slice."""

    def name(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = unpacked(points)
        for batch in batches if len(wanted) else ():
            for texts in slices(batch.column(0)):
                found = _Terms(texts, inside)
                terms = np.unique(found.terms)
                hashes = found.hashes(terms)
                hit = wanted[np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)] == hashes
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[hit]), pa.array(found.names(terms[hit]), pa.string())], names=["_hash", "term"]
                )

    return name


class KnownTerms:
    """A vocabulary that finds its terms in texts."""

    def __init__(self, terms: list[str]):
        split = [tuple(t.split(" ")) for t in terms]
        # What is not one or two words is a term of no text.
        split = [t if len(t) < 3 else () for t in split]
        words = sorted({w for t in split for w in t})
        self.words = {w: i for i, w in enumerate(words)}
        self.unigrams = np.full(len(words) + 1, -1, np.int64)  # the last one stands for an unknown word
        pairs = sorted((self.words[t[0]] * len(words) + self.words[t[1]], i) for i, t in enumerate(split) if len(t) == 2)
        for i, t in enumerate(split):
            if len(t) == 1:
                self.unigrams[self.words[t[0]]] = i
        self.pairs, self.pair_terms = np.array(pairs, np.int64).reshape(-1, 2).T.copy()
        self.size = len(terms)

    def counts(self, texts: list[str], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and count of every known term of a text, by text and term."""
        owners, codes, tokens = coded_tokens(texts, inside)
        get = self.words.get
        known = np.array([get(t, -1) for t in tokens], np.int64)[codes]
        terms = [self.unigrams[known]]
        of = [owners]
        if len(self.pairs):
            both = np.flatnonzero((known[:-1] >= 0) & (known[1:] >= 0) & (owners[1:] == owners[:-1]))
            keys = known[both] * len(self.words) + known[both + 1]
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            terms.append(np.where(self.pairs[at] == keys, self.pair_terms[at], -1))
            of.append(owners[both])
        term, owner = np.concatenate(terms), np.concatenate(of)
        width = max(self.size, 1)
        cells, counts = np.unique((owner * width + term)[term >= 0], return_counts=True)
        return cells // width, cells % width, counts
