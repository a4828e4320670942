"""Literals found in folded texts, in numpy.

Literals are kept in a trie whose steps are eight bytes. All places of many texts are looked up in its first step at once,
a filter of bits first; the few places left go on through the further steps. Bytes are compared, so what is found is there.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import functions as F

# Ship the functions by value: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEP = 8  # bytes of a step
SLICE_BYTES = 1 << 20  # texts are taken together up to this length; a longer one is a slice of its own
PLACES = 1 << 20  # places looked up at a time
FOUND = "array<struct<rule:bigint,window:string>>"
_GOES_ON = STEP + 1
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(STEP + 1)] + [(1 << 64) - 1], np.uint64)
_ASCII_WORD = np.array([chr(b).isascii() and (chr(b).isalnum() or chr(b) == "_") for b in range(256)])


def _steps_at(padded: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on; ``padded`` has as many more at its end."""
    return np.ndarray(len(padded) - STEP, "<u8", padded, strides=(1,))


def _mixed(node: np.ndarray | int, step: np.ndarray, salt: int) -> np.ndarray:
    """A hash that is one-to-one in the step."""
    key = (step ^ (np.uint64(salt) + np.uint64(0x9E3779B97F4A7C15) * np.asarray(node, np.uint64))) * np.uint64(0xFF51AFD7ED558CCD)
    return (key ^ (key >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)


class _Table:
    """Distinct pairs of a node and a step, in the order of a hash that tells them apart."""

    def __init__(self, node: np.ndarray, step: np.ndarray):
        order = np.lexsort((step, node))
        fresh = np.append(True, (np.diff(node[order]) != 0) | (step[order][1:] != step[order][:-1]))
        node_of, step_of = node[order][fresh], step[order][fresh]
        for self.salt in count():
            keys = _mixed(node_of, step_of, self.salt)
            by_key = np.argsort(keys)
            if not (keys[by_key][1:] == keys[by_key][:-1]).any():
                break
        self.keys, self.node, self.step = keys[by_key], node_of[by_key], step_of[by_key]
        place = np.empty(len(by_key), np.int64)
        place[by_key] = np.arange(len(by_key))
        self.entry = np.empty(len(order), np.int64)  # of every pair given
        self.entry[order] = place[np.cumsum(fresh) - 1]
        bits = min(max(10, int(len(keys) * 8).bit_length()), 24)
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[self._slots(self.keys)] = True

    @classmethod
    def of(cls, held: dict) -> _Table:
        found = cls.__new__(cls)
        vars(found).update(held)
        return found

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> self.shift).view(np.int64)

    def find(self, node: np.ndarray | int, step: np.ndarray, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Which of the given pairs are here, and their entries."""
        keys = _mixed(node, step, self.salt) if keys is None else keys
        maybe = np.flatnonzero(self.filter[self._slots(keys)])
        entry = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        nodes = node if np.ndim(node) == 0 else node[maybe]
        same = (self.step[entry] == step[maybe]) & (self.node[entry] == nodes)
        return maybe[same], entry[same]


class Literals:
    """Literals, each the property of a rule; a rule may have several, and several rules the same."""

    def __init__(self, literals: pa.Array, rules: np.ndarray):
        data, offsets = _bytes_of(literals)
        left, steps = np.diff(offsets), _steps_at(np.append(data, np.zeros(STEP, np.uint8)))
        self.everywhere = np.unique(rules[left == 0])
        at, rules, left = offsets[:-1][left > 0], rules[left > 0], left[left > 0]
        node = np.zeros(len(at), np.int64)
        self.levels = []  # by the bytes that a literal has in the step: their table, where rules of its entries begin, rules
        while len(at):
            step, size = steps[at], np.minimum(left, _GOES_ON)
            level, further = {}, []
            for n in np.unique(size).tolist():
                of = np.flatnonzero(size == n)
                table = _Table(node[of], step[of] & _MASKS[n])
                if n < _GOES_ON:
                    order = np.argsort(table.entry, kind="stable")
                    cuts = np.searchsorted(table.entry[order], np.arange(len(table.keys) + 1))
                    level[n] = (table, cuts, rules[of][order])
                else:
                    level[n] = (table, None, None)
                    further, node = of, table.entry.copy()
                del table.entry
            self.levels.append(level)
            at, rules, left = (a[further] if len(further) else a[:0] for a in (at + STEP, rules, left - STEP))
            node = node if len(further) else node[:0]

    def plain(self) -> tuple:
        """What a broadcast can carry to workers that do not have this module."""
        return self.everywhere, [{n: (vars(table), *rest) for n, (table, *rest) in level.items()} for level in self.levels]

    @classmethod
    def of(cls, plain: tuple) -> Literals:
        """The literals of `plain`."""
        found = cls.__new__(cls)
        found.everywhere, levels = plain
        found.levels = [{n: (_Table.of(table), *rest) for n, (table, *rest) in level.items()} for level in levels]
        return found

    def occurrences(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, rule, first byte and end of every place of a text where a literal stands."""
        steps = _steps_at(np.append(data, np.zeros(STEP * (len(self.levels) + 1), np.uint8)))
        first, size, rule = [], [], []
        for start in range(0, len(data), PLACES):
            place, node, step = None, 0, steps[start : min(start + PLACES, len(data))].copy()
            for depth, level in enumerate(self.levels):
                keys, further = {}, None
                for n, (table, cuts, rules) in level.items():
                    part = step if n >= STEP else step & _MASKS[n]
                    shared = (min(n, STEP), table.salt)
                    if shared not in keys:
                        keys[shared] = _mixed(node, part, table.salt)
                    which, entry = table.find(node, part, keys[shared])
                    here = which + start if place is None else place[which]
                    if n == _GOES_ON:
                        further = here, entry
                        continue
                    many = cuts[entry + 1] - cuts[entry]
                    first.append(np.repeat(here, many))
                    size.append(np.full(many.sum(), depth * STEP + n))
                    rule.append(rules[np.repeat(cuts[entry] - np.cumsum(many) + many, many) + np.arange(many.sum())])
                if further is None or not len(further[0]):
                    break
                place, node = further
                step = steps[place + (depth + 1) * STEP]
        first, size, rule = (np.concatenate(a) if a else np.empty(0, np.int64) for a in (first, size, rule))
        text = np.searchsorted(offsets, first, "right") - 1
        inside = first + size <= offsets[text + 1] if len(text) else np.empty(0, bool)
        return text[inside], rule[inside], first[inside], (first + size)[inside]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, a null being empty, and where each begins and ends."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and offsets[-1] else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def _text_slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    first, texts = 0, len(offsets) - 1
    while first < texts:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        yield first, last
        first = last


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.append(True, np.any([a[1:] != a[:-1] for a in columns], axis=0)))


def _raw_places(raw, raw_offsets, data, offsets, text, first, end):
    """Places of folded texts in the texts as they are. Folding keeps the number of characters but not that of their bytes.

    A text with another number of characters is taken whole, as is told by the flags.
    """
    whole = np.zeros(len(first), bool)
    begins, raw_begins = (data & 0xC0) != 0x80, (raw & 0xC0) != 0x80
    if np.array_equal(offsets, raw_offsets) and np.array_equal(begins, raw_begins):
        return first, end, whole
    low, high = first.copy(), end.copy()
    cuts = np.append(_firsts(text), len(text))
    for a, b in zip(cuts, cuts[1:]):  # occurrences are in the order of texts
        t = text[a]
        number = np.cumsum(begins[offsets[t] : offsets[t + 1]], dtype=np.int64) - 1
        places = np.append(np.flatnonzero(raw_begins[raw_offsets[t] : raw_offsets[t + 1]]), raw_offsets[t + 1] - raw_offsets[t])
        if number[-1] + 2 != len(places):
            whole[a:b], low[a:b], high[a:b] = True, raw_offsets[t], raw_offsets[t + 1]
            continue
        start = number[first[a:b] - offsets[t]]
        chars = number[end[a:b] - 1 - offsets[t]] + 1 - start
        low[a:b], high[a:b] = places[start] + raw_offsets[t], places[start + chars] + raw_offsets[t]
    return low, high, whole


def _windows(raw, raw_offsets, data, offsets, text, rule, first, end) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Text, rule and, one line each, the literal's places with a character on either side, in order.

    Places beside an ASCII letter, digit or underscore hold no whole word and are left out. The first place between other
    ASCII characters or edges surely holds one, so later places are.
    """
    order = np.argsort(text, kind="stable")
    text, rule, first, end = text[order], rule[order], first[order], end[order]
    size = end - first
    low, high, whole = _raw_places(raw, raw_offsets, data, offsets, text, first, end)
    padded = np.append(raw, np.zeros(1, np.uint8))
    begin, close = raw_offsets[text], raw_offsets[text + 1]
    before = np.where(low > begin, padded[low - 1], 0)
    after = np.where(high < close, padded[high], 0)
    good = whole | ~(_ASCII_WORD[before] | _ASCII_WORD[after])
    sure = good & ~whole & (before < 0x80) & (after < 0x80) & (high - low == size)
    text, rule, low, high, before, after, sure = (a[good] for a in (text, rule, low, high, before, after, sure))
    begin, close = begin[good], close[good]
    order = np.lexsort((low, rule, text))
    text, rule, low, high, after, sure, begin, close = (a[order] for a in (text, rule, low, high, after, sure, begin, close))
    earlier = np.cumsum(sure) - sure
    starts = _firsts(text, rule)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(text))))
    wanted = earlier == earlier[starts][group]
    text, rule, low, high, after, begin, close = (a[wanted] for a in (text, rule, low, high, after, begin, close))
    low = np.where(low > begin, low - 1, low)
    for _ in range(3):
        low = low - ((low > begin) & ((padded[low] & 0xC0) == 0x80))
    high = np.minimum(high + 1 + (after >= 0xC0) + (after >= 0xE0) + (after >= 0xF0), close)
    size = high - low + 1
    ends = np.cumsum(size)
    lines = padded[np.repeat(low - ends + size, size) + np.arange(size.sum())] if len(size) else np.empty(0, np.uint8)
    lines[ends - 1] = ord("\n")
    starts = _firsts(text, rule)
    bounds = np.append((ends - size)[starts], len(lines)).astype(np.int64)
    windows = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(lines)])
    return text[starts], rule[starts], windows.cast(pa.string())


def _rules_of(known: Literals, texts: pa.Array, folded: pa.Array, windows: bool) -> pa.Array:
    """For every text its rules, each once, with their windows if wanted."""
    data, offsets = _bytes_of(folded)
    raw, raw_offsets = _bytes_of(texts) if windows else (data, offsets)
    texts_of, rules, cut = [], [], []
    for a, b in _text_slices(offsets):
        here, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        text, rule, first, end = known.occurrences(here, at)
        if windows:
            raw_at = raw_offsets[a : b + 1] - raw_offsets[a]
            text, rule, lines = _windows(raw[raw_offsets[a] : raw_offsets[b]], raw_at, here, at, text, rule, first, end)
            cut.append(lines)
        else:
            text = np.append(text, np.repeat(np.arange(b - a), len(known.everywhere)))
            rule = np.append(rule, np.tile(known.everywhere, b - a))
            order = np.lexsort((rule, text))
            text, rule = text[order], rule[order]
            starts = _firsts(text, rule)
            text, rule = text[starts], rule[starts]
        texts_of.append(text + a)
        rules.append(rule)
    text, rule = (np.concatenate(a) if a else np.empty(0, np.int64) for a in (texts_of, rules))
    lines = pa.concat_arrays(cut) if cut else pa.nulls(len(rule), pa.string())
    pairs = pa.StructArray.from_arrays([pa.array(rule, pa.int64()), lines], ["rule", "window"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(offsets))), pa.int32()), pairs)


def finder(sent: Broadcast, windows: bool):
    """A function of texts and folded texts: the rules whose literals a folded text holds, with windows if wanted.

    ``sent`` has the plain form of the literals.
    """

    def find(texts: pa.Array, folded: pa.Array) -> pa.Array:
        return _rules_of(Literals.of(sent.value), texts, folded, windows)

    return F.arrow_udf(find, FOUND)
