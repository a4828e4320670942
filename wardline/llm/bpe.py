"""Byte-level BPE encoding by a bounded-lookahead transducer, and decoding by an incremental byte-to-text machine.

Encoding: a text is cut into pieces by the tokenizer's pattern, and every piece runs through a transducer that reads
token after token. Its state is the open end of the encoding of the bytes so far: tokens of which every two neighbours stay
as they are when encoded together, which only one sequence does. Tokens farther back than the merge list's sufficient
lookahead cannot change any more and are emitted, so the state stays bounded. Results of short pieces are remembered in a
bounded table of the Python worker.

Decoding: ids are turned to bytes block by block as they are emitted, and an incremental UTF-8 decoder keeps the unfinished
character between blocks; invalid bytes become U+FFFD. A block holds the pieces of CHUNK characters, so that digests never
hold all ids of a text.

Defined results: a null text is empty; an empty text has no tokens; the text of a special token is that token.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: how byte-level BPE cuts a text; white space is Unicode's White_Space.
PIECES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
#: The same for texts below U+0100, where the classes are short enough to be spelled out.
_LETTERS, _NUMBERS, _BLANKS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r\x20\x85\xa0"
NARROW_PIECES = re.compile(
    rf" ?[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{_NUMBERS}]+| ?[^{_BLANKS}{_LETTERS}{_NUMBERS}]+|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+"
)
WIDE = re.compile(r"[^\x00-\xff]")
#: A piece always ends before white space that follows something else.
SEAM = regex.compile(rf"[^{WHITE}](?=[{WHITE}])")
CHUNK = 1 << 16  # characters of a text that are cut into pieces together
SHORT = 64  # bytes of a piece whose encoding is remembered
REMEMBERED = 400_000  # pieces remembered by a worker
PAIRS = 1_000_000  # token pairs remembered by a worker


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in the vocabulary file: printable bytes for themselves, others from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Coder:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, letters = spec["model"], byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.ids = {as_bytes(token): number for token, number in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.texts = {number: token for token, number in self.ids.items()}
        self.texts |= {number: text.encode() for text, number in self.special.items()}
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        merges = [(as_bytes(left), as_bytes(right)) for left, right in pairs]
        self.ranks = {(self.ids[a], self.ids[b]): (r, self.ids[a + b]) for r, (a, b) in enumerate(merges)}
        self.packed = {number: number.to_bytes(4, "little") for number in self.texts}
        self.made = {joined: (r, pair) for pair, (r, joined) in self.ranks.items()}
        self.spines: tuple[dict, dict] = ({}, {})
        self.longest = max(map(len, self.ids))
        self.lookahead = sufficient_lookahead(merges)
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        usable = {token: number for token, number in self.ids.items() if self.merged(token) == [number]}
        #: Beginnings of tokens, with the token if the beginning is one and else -1: a walk from a position stops where no
        #: token can end.
        self.beginnings = dict.fromkeys((token[:k] for token in usable for k in range(1, len(token))), -1) | usable
        self.valid: dict[int, bool] = {}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known = _Known(self)

    def merged(self, data: bytes) -> list[int]:
        """Tokens of a few bytes by applying merges in the order of their ranks."""
        tokens = [self.byte_ids[b] for b in data]
        ranks = self.ranks
        while len(tokens) > 1:
            best = min(((ranks.get(pair), at) for at, pair in enumerate(zip(tokens, tokens[1:])) if pair in ranks), default=None)
            if best is None:
                break
            (_, joined), at = best
            tokens[at : at + 2] = [joined]
        return tokens

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at a token's right (side 1) or left (side 0) end while it is merged: (token, rank that ends it)."""
        known = self.spines[side].get(token)
        if known is None:
            known, until = [], len(self.ranks)
            at: int | None = token
            while at is not None:
                known.append((at, until))
                rank, parts = self.made.get(at, (0, None))
                at, until = (parts[side], rank) if parts else (None, 0)
            known = self.spines[side][token] = known[::-1]
        return known

    def is_pair(self, left: int, right: int) -> bool:
        """Do two tokens stay as they are when their bytes are encoded together?

        Merges happen in the order of their ranks, and of equal ranks from left to right. So the tokens stay unless, at
        some time, what stands on both sides of the seam merges before either side's own next merge.
        """
        key = left << 20 | right
        known = self.valid.get(key)
        if known is None:
            ends, starts, ranks = self.spine(left, 1), self.spine(right, 0), self.ranks
            i = j = 0
            known = True
            while known:
                (a, a_until), (b, b_until) = ends[i], starts[j]
                across = ranks.get((a, b))
                if across is not None and across[0] < a_until and across[0] <= b_until:
                    known = False
                elif a_until <= b_until and i + 1 < len(ends):
                    i += 1
                elif j + 1 < len(starts):
                    j += 1
                else:
                    break
            if len(self.valid) >= PAIRS:
                self.valid.clear()
            self.valid[key] = known
        return known

    def candidates(self, data: bytes, at: int) -> list[tuple[int, int]]:
        """(end, token) of the tokens that stand in the data from ``at`` on, the longest last."""
        beginnings, found, size = self.beginnings, [], len(data)
        end = at + 1
        while end <= size:
            token = beginnings.get(data[at:end])
            if token is None:
                break
            if token >= 0:
                found.append((end, token))
            end += 1
        return found

    def transduce(self, data: bytes) -> Iterator[int]:
        """The tokens of one piece, each yielded once no later byte can change it.

        The open tokens are the encoding of the bytes read so far, as all their neighbours are valid pairs. A token goes
        on from the last one, long ones first; where none makes a valid pair, the last one is taken back and its end is
        not tried again, since only one encoding leads there. Were a token emitted too early, no sequence would go on from
        it, and the search would fail instead of yielding another encoding.
        """
        size, valid, window = len(data), self.valid, self.lookahead + self.longest
        tokens, ends, untried = [-1], [0], [self.candidates(data, 0)]  # the first of each stands for what is emitted
        closed: set[int] = set()
        while ends[-1] < size:
            before, options = tokens[-1], untried[-1]
            while options:
                end, token = options.pop()
                if end in closed:
                    continue
                if before >= 0:
                    pair = valid.get(before << 20 | token)
                    if pair is None:
                        pair = self.is_pair(before, token)
                    if not pair:
                        continue
                tokens.append(token)
                ends.append(end)
                untried.append(self.candidates(data, end))
                break
            else:
                tokens.pop()
                untried.pop()
                closed.add(ends.pop())
                continue
            if ends[-1] - ends[0] >= window:
                stable = bisect_right(ends, ends[-1] - self.lookahead) - 1
                yield from tokens[1 : stable + 1]
                del tokens[:stable], ends[:stable], untried[:stable]
                closed = {place for place in closed if place > ends[0]}
        yield from tokens[1:]

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, chunk by chunk; chunks end at seams."""
        find = (PIECES if WIDE.search(text) else NARROW_PIECES).findall
        at = 0
        while at < len(text):
            end = at + CHUNK
            if end < len(text):
                seam = SEAM.search(text, end - 1)
                end = seam.end() if seam else len(text)
            yield find(text[at:end])
            at = end

    def encode(self, text: str) -> Iterator[bytes]:
        """Token ids of a text as little-endian unsigned 32-bit integers, block by block."""
        known = self.known
        parts = self.split.split(text) if self.split is not None and any(s in text for s in self.special) else [text]
        for part in parts:
            if part in self.special:
                yield self.packed[self.special[part]]
            else:
                for pieces in self.pieces(part):
                    yield b"".join(map(known.__getitem__, pieces))

    def decode(self, blocks: Iterable[bytes]) -> Iterator[str]:
        """The text of token ids, block by block."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        of_token = self.texts.__getitem__
        for block in blocks:
            yield machine.decode(b"".join(map(of_token, np.frombuffer(block, "<u4").tolist())))
        yield machine.decode(b"", True)


class _Known(dict):
    """Piece to packed token ids; filled on demand, emptied when full."""

    def __init__(self, coder: Coder):
        super().__init__()
        self.coder = coder

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        packed = b"".join(map(self.coder.packed.__getitem__, self.coder.transduce(data)))
        if len(data) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = packed
        return packed


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes before the end of the input beyond which later bytes cannot change a token.

    A merge takes away the left neighbour of what follows only if it ranks before the merge that the neighbour would
    have taken part in; so a change travels left along merges (u, v), (x, u), (y, x), ... of growing rank. The longest
    such chain, in bytes, bounds how far it gets.
    """
    furthest: dict[bytes, int] = {}  # by right part: the longest chain among merges of higher rank
    longest = 0
    for left, right in reversed(merges):
        chain = len(left) + furthest.get(left, 0)
        furthest[right] = max(furthest.get(right, 0), chain)
        longest = max(longest, chain + len(right))
    return longest


@lru_cache(maxsize=2)
def coder_of(content: str) -> Coder:
    """One coder for each vocabulary and Python worker."""
    return Coder(content)


def round_trip(text: Column, vocabulary: str) -> Column:
    """struct(ids, decoded) of whole texts: packed token ids, and the text decoded from them; ``vocabulary`` is a path."""
    content = _content(vocabulary)

    @F.arrow_udf("ids binary, decoded string")
    def coded(column: pa.Array) -> pa.Array:
        coder = coder_of(content)
        ids = [b"".join(coder.encode(x.as_py() or "")) for x in column]
        texts = ["".join(coder.decode([x])) for x in ids]
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["ids", "decoded"])

    return coded(text)


def digests(text: Column, vocabulary: str) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256) of whole texts; neither ids nor text leave the worker."""
    content = _content(vocabulary)

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def coded(column: pa.Array) -> pa.Array:
        coder = coder_of(content)
        counts, of_ids, of_texts = [], [], []
        for value in column:
            encoded, decoded, size = hashlib.sha256(), hashlib.sha256(), 0

            def emitted() -> Iterator[bytes]:
                nonlocal size
                for block in coder.encode(value.as_py() or ""):
                    encoded.update(block)
                    size += len(block)
                    yield block

            for part in coder.decode(emitted()):
                decoded.update(part.encode())
            counts.append(size // 4)
            of_ids.append(encoded.hexdigest())
            of_texts.append(decoded.hexdigest())
        columns = [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())]
        return pa.StructArray.from_arrays(columns, ["n_tokens", "ids_sha256", "decoded_sha256"])

    return coded(text)


def _content(vocabulary: str) -> str:
    with open(vocabulary, encoding="utf-8") as file:
        return file.read()


def encode(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (packed), decoded text of documents (doc_id, text)."""
    return documents.select("doc_id", round_trip(F.col("text"), vocabulary).alias("_coded")).select("doc_id", "_coded.*")
