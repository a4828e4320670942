"""How filters interact: what each removes, alone and after others, in every order of application.

One pass over the UTF-8 bytes of a text drives a finite-state transducer: a table maps a byte to its class, the state is
whether the last byte was inside a word, and the outputs are counts of words, capitals, symbols and code points (bytes that
start one). The state depends on the class of a single byte, so numpy runs the machine over a megabyte at a time. The span of
every word goes into a hash table whose hits are verified byte by byte, which counts distinct words exactly.

What is left of a document is a set of failed filters. Those sets are counted by part and label, and all orders are then
evaluated on the counts, at most 2^filters of them a part. No row meets another one: a document repeats a smaller id's text
if its (digest, id) is not the first one of the digest, a test by an equi-join on both.

Defined results: a null text is empty; a null part is the empty string. Empty texts have no words and fail A, and are copies
of each other. A null id is neither smaller nor larger than another, so its document never fails E; repeated rows of one id
are not copies of each other, but are all copies of a smaller id with that text. A document without a label counts as
neither good nor toxic; of several label rows of an id any that says so counts. Texts of any length are read whole, by
pieces that end between words. An empty table gives no row. Other columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import materialize
from .hashed import mix, text_buffers

PIECE_BYTES = 1 << 20  # bytes that the transducer walks at a time
LONG_WORD = 256  # words of more bytes go through a table of byte strings
FILTERS = "ABCDE"

SEPARATOR, CAPITAL, SYMBOL, INNER = 1, 2, 4, 8
#: The class of every byte; INNER continues a code point.
CLASSES = np.zeros(256, np.uint8)
CLASSES[[0x20, *range(0x09, 0x0E)]] = SEPARATOR
CLASSES[ord("A") : ord("Z") + 1] = CAPITAL
CLASSES[[ord(c) for c in "#$%&*|"]] = SYMBOL
CLASSES[0x80:0xC0] = INNER
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

COUNTS = ["words", "distinct", "capitals", "symbols", "points"]


class Spans:
    """Words of a run of bytes: start, length, and the number of the text that owns them."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, owner: np.ndarray):
        self.data, self.start, self.length, self.owner = data, start, length, owner
        padded = np.zeros(len(data) + 16, np.uint8)
        padded[: len(data)] = data
        #: The eight bytes from every position on.
        self.lanes = np.ndarray((len(data) + 8,), np.dtype("<u8"), padded, strides=(1,))

    def lane(self, words: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k+7 of words that reach there; bytes past the word are zero."""
        return self.lanes[self.start[words] + 8 * k] & _MASKS[np.minimum(self.length[words] - 8 * k, 8)]

    def hashes(self, words: np.ndarray) -> np.ndarray:
        found = mix(self.owner[words].astype(np.uint64), 1) ^ self.length[words].astype(np.uint64)
        at, k = np.arange(len(words)), 0
        while len(at):
            found[at] = mix(found[at] ^ self.lane(words[at], k), 2)
            k += 1
            at = at[self.length[words[at]] > 8 * k]
        return found

    def same(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether pairs of words have one owner and the same bytes."""
        equal = (self.owner[left] == self.owner[right]) & (self.length[left] == self.length[right])
        at, k = np.flatnonzero(equal), 0
        while len(at):
            differ = self.lane(left[at], k) != self.lane(right[at], k)
            equal[at[differ]] = False
            k += 1
            at = at[~differ & (self.length[left[at]] > 8 * k)]
        return equal

    def firsts(self) -> np.ndarray:
        """Numbers of words such that every distinct word of an owner is there once.

        Open addressing: all words knock at their slot, one moves in where it is free, and those that hold the same word
        as the slot are done; the others go on by a step that depends on their hash, so equal words stay together.
        """
        todo = np.flatnonzero(self.length <= LONG_WORD)
        found = self.hashes(todo)
        size = 1 << max(4, int(2 * len(todo)).bit_length())
        slot, step = found & np.uint64(size - 1), (found >> np.uint64(32)) | np.uint64(1)
        table, first = np.full(size, -1, np.int64), []
        while len(todo):
            free = table[slot] < 0
            table[slot[free]] = todo[free]
            holder = table[slot]
            first.append(todo[holder == todo])
            left = ~self.same(todo, holder)
            todo, slot, step = todo[left], (slot[left] + step[left]) & np.uint64(size - 1), step[left]
        seen: set[tuple[int, bytes]] = set()
        for word in np.flatnonzero(self.length > LONG_WORD):
            at = self.start[word]
            key = (int(self.owner[word]), self.data[at : at + self.length[word]].tobytes())
            if key not in seen:
                seen.add(key)
                first.append(np.array([word]))
        return np.concatenate(first) if first else np.empty(0, np.int64)


def walk(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Spans]:
    """Run the transducer over consecutive texts: their (words, capitals, symbols, points), and their words' spans."""
    texts, begin = len(offsets) - 1, offsets[0]
    part, breaks = data[begin : offsets[-1]], offsets - begin
    kind = CLASSES[part]
    inside = kind != SEPARATOR
    before = np.zeros(len(part) + 1, bool)  # the state before every byte
    before[1:] = inside
    after = np.zeros(len(part) + 1, bool)
    after[:-1] = inside
    edges = breaks[1:-1]
    before[edges] = False
    after[edges] = False
    start = np.flatnonzero(inside & ~before[:-1])
    end = np.flatnonzero(inside & ~after[1:]) + 1

    def count(at: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(at, breaks))

    inner = count(np.flatnonzero(kind == INNER))
    counts = [count(start), count(np.flatnonzero(kind == CAPITAL)), count(np.flatnonzero(kind == SYMBOL)), np.diff(breaks) - inner]
    owner = np.repeat(np.arange(texts), counts[0])
    return np.stack(counts, 1), Spans(part, start, end - start, owner)


def _runs(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most PIECE_BYTES together, or of one text."""
    first, texts = 0, len(offsets) - 1
    while first < texts:
        last = int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, "right")) - 1
        last = min(max(last, first + 1), texts)
        yield first, last
        first = last


def _pieces(data: np.ndarray, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """A long text in pieces that end after a separator, or where a word that is longer than a piece ends."""
    while begin < end:
        stop = min(begin + PIECE_BYTES, end)
        gaps = np.flatnonzero(CLASSES[data[begin:stop]] == SEPARATOR) if stop < end else []
        if stop < end and len(gaps):
            stop = begin + int(gaps[-1]) + 1
        while stop < end and CLASSES[data[stop - 1]] != SEPARATOR:
            ahead = np.flatnonzero(CLASSES[data[stop : min(stop + PIECE_BYTES, end)]] == SEPARATOR)
            stop = stop + int(ahead[0]) + 1 if len(ahead) else min(stop + PIECE_BYTES, end)
        yield begin, stop
        begin = stop


def _long_text(data: np.ndarray, begin: int, end: int) -> np.ndarray:
    """(words, distinct, capitals, symbols, points) of one text, holding a piece and the distinct words at a time."""
    total, starts, lengths = np.zeros(4, np.int64), [], []
    for at, stop in _pieces(data, begin, end):
        counts, spans = walk(data, np.array([at, stop]))
        first = spans.firsts()
        total += counts[0]
        starts.append(spans.start[first] + (at - begin))
        lengths.append(spans.length[first])
    start, length = np.concatenate(starts), np.concatenate(lengths)
    everywhere = Spans(data[begin:end], start, length, np.zeros(len(start), np.int64))
    return np.insert(total, 1, len(everywhere.firsts()))


def text_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(words, distinct, capitals, symbols, points) of every text."""
    found = [np.empty((0, 5), np.int64)]
    for first, last in _runs(offsets):
        if offsets[last] - offsets[first] > PIECE_BYTES:
            found.append(_long_text(data, int(offsets[first]), int(offsets[last]))[None])
            continue
        counts, spans = walk(data, offsets[first : last + 1])
        distinct = np.bincount(spans.owner[spans.firsts()], minlength=last - first)
        found.append(np.insert(counts, 1, distinct, axis=1))
    return np.concatenate(found)


@F.arrow_udf(T.StructType([T.StructField(name, T.LongType()) for name in COUNTS]))
def counted(column: pa.Array) -> pa.Array:
    """Counts of whole texts, as a struct."""
    found = text_counts(*text_buffers(column))
    return pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(len(COUNTS))], COUNTS)


def failed_by_text(counts: Column) -> Column:
    """The letters of the filters A to D that a text fails."""
    conditions = {
        "A": counts["words"] < 200,
        "B": 100 * counts["distinct"] < 50 * counts["words"],
        "C": 100 * counts["capitals"] > 3 * counts["points"],
        "D": counts["symbols"] > 0,
    }
    return F.concat(*[F.when(condition, letter).otherwise("") for letter, condition in conditions.items()])


def failures(documents: DataFrame) -> DataFrame:
    """doc_id, part, failed (letters of the failed filters in order) of documents (doc_id, text, lang)."""
    shown = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("lang", F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    facts = shown.select("doc_id", "part", F.sha2("text", 256).alias("digest"), counted("text").alias("counts"))
    facts = facts.select("doc_id", "part", "digest", failed_by_text(F.col("counts")).alias("failed"))
    facts = materialize(facts, "filter-facts")
    named = facts.filter(F.col("doc_id").isNotNull())
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    told = named.join(first, ["digest", "doc_id"], "left")
    copy = F.when(F.col("is_first"), "").otherwise("E")
    told = told.select("doc_id", "part", F.concat("failed", copy).alias("failed"))
    return told.unionByName(facts.filter(F.col("doc_id").isNull()).select("doc_id", "part", "failed"))


def with_labels(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Add good and toxic (0 or 1) from labels (doc_id, quality, toxic)."""
    said = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    )
    named = failed.filter(F.col("doc_id").isNotNull()).join(said, "doc_id", "left").fillna(0, ["good", "toxic"])
    nameless = failed.filter(F.col("doc_id").isNull()).withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    return named.unionByName(nameless)


def audit(failed: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every part, order of the filters and step, from rows (part, failed, good, toxic).

    Returns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    cells = failed.groupBy("part", "failed").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic")
    )
    # The counts feed one row an order and step, so they are written: at most 2^filters rows a part.
    cells = materialize(cells, "filter-cells")
    orders = F.array(*[F.lit("".join(order)) for order in permutations(filters)])
    steps = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    steps = steps.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    # Removed earlier: one of the letters before the step is among the failed ones.
    gone = F.expr("length(translate(substring(filter_order, 1, step - 1), failed, '')) < step - 1")
    fails = F.expr("contains(failed, letter)")

    def total(condition: Column, of: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(of)).otherwise(0)).cast("long")

    found = steps.groupBy("part", "filter_order", "step", "letter").agg(
        total(~gone & ~fails).alias("kept"),
        total(~gone & fails).alias("removed"),
        total(gone & fails).alias("redundant"),
        total(F.col("failed") == F.col("letter")).alias("unique_fails"),
        total(~gone & fails, "good").alias("good_lost"),
        total(~gone & fails, "toxic").alias("toxic_lost"),
    )
    shares = found.groupBy("part", "letter").agg(F.sum("removed").cast("long").alias("shapley"))
    return found.join(shares, ["part", "letter"]).drop("letter")
