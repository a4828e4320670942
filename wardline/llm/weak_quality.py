"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. There are at most 3 ** 7 patterns of votes,
so their counts over the whole corpus are a small table, whatever the input; expectation-maximisation on these counts
estimates, without any given label, how often documents are good and how each labeller, if it votes, votes on good and on bad ones. The
posterior of a document's pattern is its weak label. A linear scorer over hashed words, token shapes and repetition is then
fitted by FTRL to the posteriors of a bounded sample (``sample_rows``), in shards whose weights are averaged, and scores
every whole text.

Defined results: a null or empty text gets no votes and the posterior and score of such documents; if all documents have
one pattern, all posteriors are equal; without any document there is no row. Repeated rows count each time. A very long
text is a slice of its own. A share on a labeller's limit is no vote against or for. Other columns are not returned.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .hashed import Words, bounded_sample, buckets, distinct_rows, ftrl, mix, slices, text_buffers

LABELLERS = ("symbols", "word_length", "lines", "words", "capitals", "letters", "endings")
GOOD, BAD, NOTHING = 2, 0, 1


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 2.0
    l2: float = 0.0
    epochs: int = 3
    sample_rows: int = 20_000  # documents that the scorer is fitted to at most
    shard_rows: int = 5_000
    rounds: int = 200  # of expectation-maximisation at most
    threshold: float = 0.6


_IS_GAP = np.zeros(256, bool)
_IS_GAP[[32, *range(9, 14)]] = True
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False
_ASCII = np.arange(256) < 128
_CONTINUES = (np.arange(256) & 0xC0) == 0x80
_SYMBOL, _ENDS_LINE = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = _ENDS_LINE[list(b'.!?:;")')] = True
_CAPITAL, _LETTER = 1, 2


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a capital, a letter, or both."""
    kinds = (unicodedata.category(chr(point)) for point in range(sys.maxunicode + 1))
    return np.fromiter(((_CAPITAL if k == "Lu" else 0) | (_LETTER if k[0] == "L" else 0) for k in kinds), np.uint8)


def _wide(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points beyond ASCII whose first bytes stand at ``at``."""
    follow = [data[np.minimum(at + k, len(data) - 1)].astype(np.int64) & 0x3F for k in (1, 2, 3)]
    first = data[at].astype(np.int64)
    two, three = (first & 0x1F) << 6 | follow[0], (first & 0x0F) << 12 | follow[0] << 6 | follow[1]
    four = (first & 0x07) << 18 | follow[0] << 12 | follow[1] << 6 | follow[2]
    return np.minimum(np.select([first < 0xE0, first < 0xF0], [two, three], four), sys.maxunicode)


def _distinct(keys: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """For each text the number of different keys, which are told apart by 64 bits less those that number the texts."""
    low = np.uint64(64 - texts.bit_length())
    both = np.sort((text.astype(np.uint64) << low) | (keys >> np.uint64(texts.bit_length())))
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return np.diff(np.searchsorted(both, np.arange(texts + 1, dtype=np.uint64) << low))


def _line_votes(data: np.ndarray, offsets: np.ndarray, spaces: np.ndarray, word_ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each text its lines that are more than spaces, the different ones of them, and those that end like a sentence."""
    texts, breaks, part = len(offsets) - 1, offsets - offsets[0], data[offsets[0] : offsets[-1]]
    lines = Words(data, offsets, exact=True, inside=_NOT_NEWLINE)
    newlines = np.append(np.flatnonzero(~_NOT_NEWLINE[part]), len(part))
    ends = np.minimum(newlines[np.searchsorted(newlines, lines.starts)], breaks[lines.text + 1])
    used = np.searchsorted(spaces, ends) - np.searchsorted(spaces, lines.starts) < ends - lines.starts
    last = word_ends[np.searchsorted(word_ends, ends[used]) - 1] if len(word_ends) else np.empty(0, np.int64)
    starts, text = lines.starts[used], lines.text[used]
    if not len(word_ends):
        return np.bincount(text, minlength=texts), _distinct(lines.keys[used], text, texts), np.zeros(texts, np.int64)
    one, two, three = (part[np.maximum(last - back, 0)] for back in (0, 1, 2))
    closing = _ENDS_LINE[one] | (one == 0xBB) & (two == 0xC2) | (one == 0x9D) & (two == 0x80) & (three == 0xE2)  # », ”
    ended = closing & (last >= starts) & (last < ends[used])
    return np.bincount(text, minlength=texts), _distinct(lines.keys[used], text, texts), np.bincount(text[ended], minlength=texts)


def _patterns(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The labellers' votes on each text of a slice as one number, in base three."""
    texts, breaks, part = len(offsets) - 1, offsets - offsets[0], data[offsets[0] : offsets[-1]]

    def count(places: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(places, breaks))

    gaps, beyond = np.flatnonzero(_IS_GAP[part]), np.flatnonzero(~_ASCII[part])
    first = beyond[~_CONTINUES[part[beyond]]]
    kinds = _letters()[_wide(part, first)] if len(first) else np.empty(0, np.uint8)
    narrow = _letters()[:256] * _ASCII.astype(np.uint8)
    capitals = count(np.flatnonzero((narrow & _CAPITAL).astype(bool)[part])) + count(first[(kinds & _CAPITAL) > 0])
    others = count(np.flatnonzero((_ASCII & ~(narrow & _LETTER).astype(bool))[part])) + count(first[(kinds & _LETTER) == 0])
    characters = np.diff(breaks) - count(beyond) + count(first)

    words = Words(data, offsets, exact=True, inside=~_IS_GAP)
    size = np.bincount(words.text, minlength=texts)
    inside = ~_IS_GAP[part]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    borders = breaks[(breaks > 0) & (breaks <= len(part))] - 1
    ends[borders] = inside[borders]
    spaces = gaps[part[gaps] == 32]
    lines, distinct_lines, ended = _line_votes(data, offsets, spaces, np.flatnonzero(ends))

    def vote(defined: np.ndarray, top: np.ndarray, under: np.ndarray, bad, good) -> np.ndarray:
        value = top / np.maximum(under, 1)
        return np.where(~defined, NOTHING, np.where(bad(value), BAD, np.where(good(value), GOOD, NOTHING)))

    some = size > 0
    ballots = [
        vote(some, count(np.flatnonzero(_SYMBOL[part])), size, lambda v: v > 0.2, lambda v: v < 0.05),
        vote(some, characters - count(gaps), size, lambda v: (v < 2.5) | (v > 12), lambda v: (v >= 3.5) & (v <= 9)),
        vote(lines > 1, lines - distinct_lines, lines, lambda v: v > 0.3, lambda v: v < 0.05),
        vote(size >= 30, _distinct(words.keys, words.text, texts), size, lambda v: v < 0.15, lambda v: v > 0.3),
        vote(size >= 5, capitals, characters, lambda v: v > 0.3, lambda v: v < 0.1),
        vote(some, characters - others, characters, lambda v: v < 0.6, lambda v: v > 0.75),
        vote(lines > 0, ended, lines, lambda v: v < 0.2, lambda v: v > 0.6),
    ]
    return sum(ballot * 3**k for k, ballot in enumerate(ballots))


def _all_patterns(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    parts = [_patterns(data, offsets[first : last + 1]) for first, last in slices(offsets)]
    return np.concatenate([np.empty(0, np.int64), *parts])


def votes(text: Column) -> Column:
    """The labellers' votes on a text as one number, in base three."""

    @F.arrow_udf("int")
    def voted(column: pa.Array) -> pa.Array:
        return pa.array(_all_patterns(*text_buffers(column)), pa.int32())

    return voted(text)


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and for every labeller the chances of its votes on bad and on good documents, if it votes."""

    good: float
    chances: np.ndarray  # labeller, class (bad, good), vote

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for each pattern of votes."""
        ballots = _ballots(patterns)
        logs = np.tile(np.log([1 - self.good, self.good]), (len(patterns), 1))
        for k in range(len(LABELLERS)):
            logs += np.log(self.chances[k][:, ballots[:, k]]).T
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))


def _ballots(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns // 3**k % 3 for k in range(len(LABELLERS))], axis=1)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns.

    It starts from the number of bad votes: these are rare, and so say more than good votes, which most labellers give to
    most documents.
    """
    ballots = _ballots(patterns)
    belief = np.array([0.95, 0.3, 0.05])[np.minimum((ballots == BAD).sum(axis=1), 2)]
    model = LabelModel(0.5, np.ones((len(LABELLERS), 2, 3)))
    for _ in range(rounds if len(patterns) else 0):
        weight = np.stack([counts * (1 - belief), counts * belief])
        good = (weight[1].sum() + 1) / (weight.sum() + 2)
        chances = np.empty((len(LABELLERS), 2, 3))
        for k in range(len(LABELLERS)):
            for vote in (BAD, GOOD):
                chances[k, :, vote] = weight[:, ballots[:, k] == vote].sum(axis=1) + 0.5
        chances[:, :, NOTHING] = 0
        chances /= chances.sum(axis=2, keepdims=True)
        chances[:, :, NOTHING] = 1  # a labeller that does not vote says nothing
        model = LabelModel(float(good), chances)
        updated = model.posterior(patterns)
        if np.abs(updated - belief).max() < 1e-9:
            break
        belief = updated
    return model


def _features(data: np.ndarray, offsets: np.ndarray, bits: int) -> list[np.ndarray]:
    """Distinct buckets of each text of a slice: words and pairs, the shapes of token ends, and repetition."""
    texts = len(offsets) - 1
    words = Words(data, offsets)
    hashes, owners = words.features()
    shape, shape_owner = _shapes(data, offsets)
    total = np.bincount(words.text, minlength=texts)
    distinct = _distinct(mix(words.hashes, 1), words.text, texts)
    richness = np.floor(8 * distinct / np.maximum(total, 1)).astype(np.uint64)
    size = np.floor(np.log2(total + 1)).astype(np.uint64)
    every = np.arange(texts)
    repetition = mix(richness * np.uint64(64) + size, 31)
    bucket, text = buckets((np.concatenate([hashes, shape, repetition]), np.concatenate([owners, shape_owner, every])), bits)
    return distinct_rows(bucket, text, texts, bits)


_CLASSES = np.arange(256, dtype=np.uint64)
_CLASSES[128:] = _CLASSES[97:123] = ord("a")
_CLASSES[65:91] = ord("A")
_CLASSES[48:58] = ord("0")


def _shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the last three character classes of every token."""
    part = data[offsets[0] : offsets[-1]]
    if not len(part):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    breaks = offsets - offsets[0]
    ends_text = np.zeros(len(part), bool)
    ends_text[breaks[1:][breaks[1:] > 0] - 1] = True
    gap = _IS_GAP[part]
    last = np.flatnonzero(~gap & (np.append(gap[1:], True) | ends_text))
    classes = _CLASSES[part]
    value = classes[last]
    open_end = ~ends_text  # a class of the text before is no part of a token
    reach = np.ones(len(last), bool)
    for back in (1, 2):
        at = last - back
        reach &= (at >= 0) & open_end[np.maximum(at, 0)] & ~gap[np.maximum(at, 0)]
        value = value * np.uint64(256) + np.where(reach, classes[np.maximum(at, 0)], np.uint64(0))
    return mix(value, 30), np.searchsorted(breaks, last, "right") - 1


@dataclass(frozen=True)
class Scorer:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int


def fit_scorer(documents: DataFrame, beliefs: DataFrame, settings: Settings = Settings()) -> Scorer:
    """A linear scorer for the weak labels of texts: ``beliefs`` has the (pattern, belief) of every pattern of votes.

    At most ``sample_rows`` texts are used.
    """
    s = settings
    order = F.xxhash64("text", F.lit(s.bits))
    # The texts are sampled before anything is joined to them or voted on.
    rows = bounded_sample(documents.select("text"), order, s.sample_rows)
    rows = rows.withColumn("pattern", votes(F.col("text"))).join(F.broadcast(beliefs), "pattern")
    rows = materialize(rows.groupBy("text").agg(F.avg("belief").alias("belief")), "quality-sample")
    shards = max(1, -(-rows.count() // s.shard_rows))
    dealt = rows.withColumn("order", F.xxhash64("text")).withColumn("shard", F.pmod(F.shiftright("order", 20), F.lit(shards)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("order")
        data, offsets = text_buffers(pa.array(frame["text"], pa.large_string()))
        features: list[np.ndarray] = []
        for first, last in slices(offsets):
            features += _features(data, offsets[first : last + 1], s.bits)
        weights, bias = ftrl(features, frame["belief"].to_numpy(), s.bits, s.alpha, s.beta, s.l1, s.l2, s.epochs)
        kept, share = np.flatnonzero(weights), len(frame)
        return pd.DataFrame(
            {"bucket": np.append(kept, [-1, -2]), "weight": np.append(weights[kept] * share, [bias * share, share])}
        )

    parts = dealt.groupBy("shard").applyInPandas(run, "bucket long, weight double")
    merged = parts.groupBy("bucket").agg(F.sum("weight").alias("weight")).toPandas().sort_values("bucket")
    named = dict(zip(merged["bucket"], merged["weight"]))
    total = named.get(-2, 1.0)
    merged = merged[merged["bucket"] >= 0]
    weights = np.round(merged["weight"].to_numpy(float) / total, 9)
    return Scorer(merged["bucket"].to_numpy(np.int64), weights, round(named.get(-1, 0.0) / total, 9), s.bits)


def score(text: Column, scorer: Scorer) -> Column:
    """struct(pattern, score) of whole texts: the labellers' votes, and the probability that the text is good."""

    @F.arrow_udf("pattern int, score double")
    def scored(column: pa.Array) -> pa.Array:
        table = np.zeros(1 << scorer.bits)
        table[scorer.buckets] = scorer.weights
        data, offsets = text_buffers(column)
        margins = np.full(len(column), scorer.bias)
        for first, last in slices(offsets):
            for i, row in enumerate(_features(data, offsets[first : last + 1], scorer.bits), first):
                margins[i] += table[row].sum()
        scores = pa.array(1 / (1 + np.exp(-np.clip(margins, -35, 35))))
        return pa.StructArray.from_arrays([pa.array(_all_patterns(data, offsets), pa.int32()), scores], ["pattern", "score"])

    return scored(text)


def classify(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, weak_label (posterior of good), score, kept of documents (doc_id, text)."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    patterns = rows.groupBy(votes(F.col("text")).alias("pattern")).count().toPandas().sort_values("pattern")  # at most 3 ** 7 rows
    model = estimate(patterns["pattern"].to_numpy(np.int64), patterns["count"].to_numpy(float), settings.rounds)
    belief = np.round(model.posterior(patterns["pattern"].to_numpy(np.int64)), 9)
    table = rows.sparkSession.createDataFrame(
        [(int(p), float(b)) for p, b in zip(patterns["pattern"], belief)], "pattern int, belief double"
    )
    scorer = fit_scorer(rows, table, settings)
    # One pass of the texts gives votes and score; the posteriors join to the pattern.
    scored = rows.select("doc_id", score(F.col("text"), scorer).alias("_scored")).select("doc_id", "_scored.*")
    labelled = scored.join(F.broadcast(table), "pattern").select("doc_id", F.col("belief").alias("weak_label"), "score")
    return labelled.withColumn("kept", F.col("score") >= settings.threshold)
