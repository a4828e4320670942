"""Token counts without tokens: a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each position; the dynamic programme carries, for
each position, the best score and the number of pieces, nothing else. Ties go to the piece that starts first, as in the
tokenizer. A character outside the vocabulary scores ten below the least piece and counts its UTF-8 bytes.

A blank is written as U+2581 and one is put in front of the text. No piece of such a vocabulary continues past the start
of the next word or across a character that no piece has, so the programme runs over the stretches between, and the counts
of stretches are remembered in a bounded table of the Python worker.

The file that the query is given holds a BPE model, whose scores are minus the ranks of its merges: the counts are those of
the best-scoring pieces under these scores, not of the file's own encoder, which merges (figures in the README).

Defined results: a null or empty text has 0 tokens, whatever its length a text is counted whole, and only doc_id and the
count are returned.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from sentencepiece import SentencePieceProcessor

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 400_000  # stretches remembered by a worker
SHORT = 64  # characters of a stretch that is remembered


class Counter:
    """Counts the pieces of the best segmentation; pieces are (text, score) pairs."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.scores = dict(pieces)
        self.unknown = min(self.scores.values()) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        inner = any(SPACE in piece.lstrip(SPACE) for piece in self.scores)
        alone = "" if any("\n" in piece for piece in self.scores) else "\n"
        #: Stretches that no piece crosses; without them (a piece runs past a word's start) the whole text is one.
        self.stretch = None if inner else re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|\n")
        self.known = _Known(self)

    def viterbi(self, text: str) -> int:
        """Number of tokens of the best segmentation of a stretch.

        The automaton gives the pieces that end at a character from the longest to the shortest, so the first of equal
        scores is the one that starts first. A piece of one character makes the unknown character no choice there.
        """
        size = len(text)
        best, count = [0.0] * (size + 1), [0] * (size + 1)
        done = 0  # positions up to here are final
        top, pieces, alone = None, 0, False
        for last, (length, score) in self.automaton.iter(text):
            while done < last:
                if not alone:
                    top, pieces = self._unknown(text[done], best[done], count[done], top, pieces)
                done += 1
                best[done], count[done] = top, pieces
                top, alone = None, False
            start = last + 1 - length
            score += best[start]
            if top is None or score > top:
                top, pieces = score, count[start] + 1
            if length == 1:
                alone = True
        while done < size:
            if not alone:
                top, pieces = self._unknown(text[done], best[done], count[done], top, pieces)
            done += 1
            best[done], count[done] = top, pieces
            top, alone = None, False
        return count[size]

    def _unknown(self, character: str, best: float, count: int, top: float | None, pieces: int) -> tuple[float, int]:
        """The better of the pieces that end at a character and the character as an unknown one."""
        score = best + self.unknown
        return (score, count + len(character.encode())) if top is None or score > top else (top, pieces)

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if self.stretch is None:
            return self.viterbi(text)
        return sum(map(self.known.__getitem__, self.stretch.findall(text)))


class _Known(dict):
    """Stretch to count; filled on demand, emptied when full."""

    def __init__(self, counter: Counter):
        super().__init__()
        self.counter = counter

    def __missing__(self, stretch: str) -> int:
        found = self.counter.viterbi(stretch)
        if len(stretch) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[stretch] = found
        return found


def vocabulary_of(model: bytes) -> list[tuple[str, float]]:
    """Ordinary pieces of a SentencePiece file with their scores."""
    processor = SentencePieceProcessor(model_proto=model)
    ids = range(processor.get_piece_size())
    special = [processor.is_control, processor.is_unknown, processor.is_byte, processor.is_unused]
    return [(processor.id_to_piece(i), processor.get_score(i)) for i in ids if not any(is_one(i) for is_one in special)]


@lru_cache(maxsize=2)
def counter_of(model: bytes) -> Counter:
    """One counter for each vocabulary and Python worker."""
    return Counter(vocabulary_of(model))


def token_count(text: Column, vocabulary: str) -> Column:
    """Tokens of whole texts; ``vocabulary`` is the path of a SentencePiece file."""
    with open(vocabulary, "rb") as file:
        model = file.read()

    @F.arrow_udf("long")
    def counted(column: pa.Array) -> pa.Array:
        counter = counter_of(model)
        return pa.array([counter.count(value.as_py() or "") for value in column], pa.int64())

    return counted(text)


def count_tokens(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens of documents (doc_id, text)."""
    return documents.select("doc_id", token_count(F.col("text"), vocabulary).alias("n_tokens"))
