"""Hashed text features in numpy blocks, and a linear model fitted by FTRL-proximal over them.

A feature is the bucket of a 64-bit hash. All hashing is done on whole arrays of bytes: a word's hash is a difference
of one running sum, so a text costs a few array passes and no Python loop over its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

SLICE_BYTES = 4 << 20  # texts are taken together up to this size; a longer text is a slice of its own
CHUNK_BYTES = 1 << 20  # the running sums of a slice are built in chunks of this size
PREFIXES = (4, 5, 6, 7, 8)  # bytes of a word's beginning that count as a feature, for inflected words

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_POWERS = np.cumprod(np.full(CHUNK_BYTES + 1, _BASE, np.uint64))
_INVERSES = np.cumprod(np.full(CHUNK_BYTES + 1, pow(_BASE, -1, 1 << 64), np.uint64))
# A sum modulo 2^64 is the same for some different words (those of Thue and Morse) whatever the base, so words that must be
# told apart get a second one modulo a prime. A chunk's sum of bytes times residues stays below 2^60.
_PRIME, _ROOT = (1 << 31) - 1, 16807


def _residues(factor: int) -> np.ndarray:
    """factor^1 .. factor^(CHUNK_BYTES + 1) modulo the prime, by doubling."""
    out = np.array([factor], np.uint64)
    while len(out) <= CHUNK_BYTES:
        out = np.append(out, out * np.uint64(pow(factor, len(out), _PRIME)) % np.uint64(_PRIME))
    return out[: CHUNK_BYTES + 1]


_PRIME_POWERS, _PRIME_INVERSES = _residues(_ROOT), _residues(pow(_ROOT, -1, _PRIME))

_IN_WORD = np.zeros(256, bool)
_IN_WORD[128:] = True
for _low, _high in ((48, 58), (65, 91), (97, 123)):
    _IN_WORD[_low:_high] = True


def mix(values: np.ndarray, salt: int) -> np.ndarray:
    """Spread the bits of hashes; features of different kinds use different salts."""
    values = (values + np.uint64(salt)) * _ODD
    values ^= values >> np.uint64(29)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), offsets


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of consecutive texts of at most SLICE_BYTES together, or of one text."""
    first, count = 0, len(offsets) - 1
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
        last = min(max(last, first + 1), count)
        yield first, last
        first = last


def _word_keys(hashes: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64 bits of a word from its two sums and its length."""
    return mix(hashes ^ mix(second | (lengths.astype(np.uint64) << np.uint64(31)), 5), 6)


class Words:
    """The words of a slice of texts: hash, hashes of proper prefixes, and the text each word is in.

    Words are runs of ASCII letters, ASCII digits and all bytes of other characters, of any length; they end with their
    text. Chunks end between words, so a word's hash does not depend on what is around it. With ``exact``, ``keys`` tells
    words apart by two sums and their length. ``inside`` says of each byte whether it belongs to a word; ``starts`` are
    places in the slice.
    """

    def __init__(
        self,
        data: np.ndarray,
        offsets: np.ndarray,
        prefixes: tuple[int, ...] = (),
        exact: bool = False,
        inside: np.ndarray = _IN_WORD,
    ):
        begin, end = int(offsets[0]), int(offsets[-1])
        self._breaks = offsets - begin
        self._data = data[begin:end]
        self.prefixes = prefixes
        self._exact = exact
        self._inside = inside
        hashes, keys, starts_at = [], [], []
        heads: list[list[np.ndarray]] = [[] for _ in prefixes]
        at = 0
        while at < len(self._data):
            stop = self._cut(at)
            if stop - at > CHUNK_BYTES:
                found = self._long_word(at, stop)
            else:
                found = self._chunk(at, stop)
            for parts, values in zip((hashes, keys, starts_at, *heads), found):
                parts.append(values)
            at = stop
        joined = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.uint64)
        self.hashes, self.keys = joined(hashes), joined(keys)
        self.heads = [joined(head) for head in heads]
        self.starts = np.concatenate(starts_at) if starts_at else np.empty(0, np.int64)
        self.text = np.searchsorted(self._breaks, self.starts, "right") - 1

    def _cut(self, at: int) -> int:
        """Where the chunk from ``at`` ends: after the last separator or text of CHUNK_BYTES, else where its only word ends."""
        stop = at + CHUNK_BYTES
        if stop >= len(self._data):
            return len(self._data)
        gaps = np.flatnonzero(~self._inside[self._data[at:stop]])
        border = int(self._breaks[np.searchsorted(self._breaks, stop, "right") - 1])
        last = max(at + int(gaps[-1]) + 1 if len(gaps) else at, border)
        if last > at:
            return last
        border = int(self._breaks[np.searchsorted(self._breaks, stop, "right")])
        while stop < border:
            gaps = np.flatnonzero(~self._inside[self._data[stop : min(stop + CHUNK_BYTES, border)]])
            if len(gaps):
                return stop + int(gaps[0])
            stop = min(stop + CHUNK_BYTES, border)
        return border

    def _chunk(self, at: int, stop: int) -> tuple[np.ndarray, ...]:
        part = self._data[at:stop]
        inside = self._inside[part]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        edges = self._breaks[np.searchsorted(self._breaks, at) : np.searchsorted(self._breaks, stop)] - at
        before[edges] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        after[edges[edges > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        values = part.astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values * _POWERS[: len(part)], out=sums[1:])
        first, scale = sums[starts], _INVERSES[starts]
        hashes = (sums[ends] - first) * scale
        heads = []
        for k in self.prefixes:
            value = (sums[np.minimum(starts + k, ends)] - first) * scale
            value[ends - starts <= k] = 0
            heads.append(value)
        keys = np.empty(0, np.uint64)
        if self._exact:
            np.cumsum(values * _PRIME_POWERS[: len(part)], out=sums[1:])
            second = (sums[ends] - sums[starts]) % np.uint64(_PRIME) * _PRIME_INVERSES[starts] % np.uint64(_PRIME)
            keys = _word_keys(hashes, second, ends - starts)
        return hashes, keys, starts + at, *heads

    def _long_word(self, at: int, stop: int) -> tuple[np.ndarray, ...]:
        """A word of more than CHUNK_BYTES, summed piece by piece; its bytes stand from ``at`` to ``stop``."""
        whole = second = 0
        for piece in range(at, stop, CHUNK_BYTES):
            values = self._data[piece : min(piece + CHUNK_BYTES, stop)].astype(np.uint64) + np.uint64(1)
            whole += int((values * _POWERS[: len(values)]).sum()) * pow(_BASE, piece - at, 1 << 64)
            second += int((values * _PRIME_POWERS[: len(values)]).sum()) * pow(_ROOT, piece - at, _PRIME)
        base, root = pow(_BASE, -1, 1 << 64), pow(_ROOT, -1, _PRIME)
        hashes = np.array([whole * base % (1 << 64)], np.uint64)
        second = np.array([second * root % _PRIME], np.uint64)
        keys = _word_keys(hashes, second, np.array([stop - at])) if self._exact else np.empty(0, np.uint64)
        sums = (self._data[at : at + max(self.prefixes, default=0)].astype(np.uint64) + np.uint64(1)) * _POWERS[: max(self.prefixes, default=0)]
        heads = [np.array([int(sums[:k].sum()) * base % (1 << 64)], np.uint64) for k in self.prefixes]
        return hashes, keys, np.array([at]), *heads

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text) of words, word pairs, pairs around one skipped word, and word beginnings."""
        words, text = self.hashes, self.text
        kinds, owners = [mix(words, 1)], [text]
        for salt, distance in ((2, 1), (3, 2)):
            together = text[distance:] == text[:-distance] if len(text) > distance else np.empty(0, bool)
            left, right = words[: len(together)][together], words[distance : distance + len(together)][together]
            kinds.append(mix(mix(left, salt) ^ right, salt))
            owners.append(text[: len(together)][together])
        for k, head in zip(self.prefixes, self.heads):
            longer = head != 0
            kinds.append(mix(head[longer], 10 + k))
            owners.append(text[longer])
        return np.concatenate(kinds), np.concatenate(owners)


def buckets(features: tuple[np.ndarray, np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) pairs of hashed features."""
    hashes, text = features
    return (hashes >> np.uint64(64 - bits)).astype(np.int64), text


def distinct_rows(bucket: np.ndarray, text: np.ndarray, texts: int, bits: int) -> list[np.ndarray]:
    """For each text its distinct buckets, in ascending order."""
    keys = np.sort((text.astype(np.int64) << bits) | bucket)
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    cuts = np.searchsorted(keys, np.arange(texts + 1, dtype=np.int64) << bits)
    keys &= (1 << bits) - 1
    return [keys[cuts[i] : cuts[i + 1]] for i in range(texts)]


def ftrl(
    rows: list[np.ndarray], targets: np.ndarray, bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int
) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression by FTRL-proximal; targets may be probabilities.

    Every coordinate has its own rate alpha / (beta + sqrt(sum of its squared gradients)); a coordinate whose
    accumulated gradient stays within l1 has weight zero. The bias is a coordinate without the l1 term.
    """
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zs = z[at]
        return -np.sign(zs) * np.maximum(np.abs(zs) - l1, 0) / ((beta + np.sqrt(n[at])) / alpha + l2)

    def bias() -> float:
        return -z[size] / ((beta + np.sqrt(n[size])) / alpha)

    for _ in range(epochs):
        for at, target in zip(rows, targets):
            current, constant = weights(at), bias()
            margin = min(max(float(current.sum()) + constant, -35.0), 35.0)
            gradient = 1 / (1 + np.exp(-margin)) - target
            square = gradient * gradient
            root = np.sqrt(n[at])
            z[at] += gradient - (np.sqrt(n[at] + square) - root) / alpha * current
            n[at] += square
            z[size] += gradient - (np.sqrt(n[size] + square) - np.sqrt(n[size])) / alpha * constant
            n[size] += square
    return weights(slice(0, size)), bias()


def bounded_sample(rows: DataFrame, order: Column, limit: int) -> DataFrame:
    """About ``limit`` rows at most, chosen by the hash ``order``: all rows if there are no more than that."""
    total = rows.count()
    if total <= limit:
        return rows
    return rows.filter(F.pmod(order, F.lit(1 << 40)) < int((1 << 40) * (limit / total)))
