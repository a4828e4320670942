import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer, models, normalizers

from wardline.llm import bpe, queries, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Coder(file.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(coder, library, text):
    ids = b"".join(coder.encode(text))
    expected = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == expected, text[:200]
    assert "".join(coder.decode([ids])) == library.decode(expected, skip_special_tokens=False)


@given(text=st.text(max_size=80))
@settings(max_examples=400, deadline=None)
def test_any_text(coder, library, text):
    same(coder, library, text)


def test_single_characters_in_context(coder, library):
    for point in [*range(0x3100), *range(0xF900, 0xFFFF, 7), *range(0x10000, 0x20000, 97)]:
        if not 0xD800 <= point < 0xE000:
            same(coder, library, f"a{chr(point)}1 {chr(point)}! {chr(point)}{chr(point)}")


@pytest.mark.parametrize("letters", ["ab", "abc \n", "etaoin shrdlu'", "= \t", "0123 ", "aA éß", "st'sre "])
def test_random_strings(coder, library, letters):
    rng = random.Random(letters)
    for size in (4, 60, 700, 5000):
        for _ in range(15):
            same(coder, library, "".join(rng.choice(letters) for _ in range(size)))


def test_long_pieces_and_special_tokens(coder, library):
    rng = random.Random(7)
    same(coder, library, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)))
    for text in ("a" * 70_000, " " * 70_000 + "x", "<|endoftext|>", "x<|endoftext|>y <|endoftext|>", "<|endof", ""):
        same(coder, library, text)


def test_tokens_leave_the_transducer_early(coder):
    read = []

    class Watched(bytes):
        def __getitem__(self, key):
            read.append(key.stop)
            return bytes.__getitem__(self, key)

    stream = coder.transduce(Watched(b"abcdefghij" * 2000))
    next(stream)
    assert max(read) <= 2 * (coder.lookahead + coder.longest)


def test_pairs_are_those_of_merging(coder):
    rng = random.Random(1)
    tokens = list(coder.ids.values())
    short = [t for t in tokens if len(coder.texts[t]) <= 3]
    for k in range(30_000):
        a, b = (rng.choice(short), rng.choice(short)) if k % 2 else (rng.choice(tokens), rng.choice(tokens))
        assert coder.is_pair(a, b) == (coder.merged(coder.texts[a] + coder.texts[b]) == [a, b])


def test_invalid_bytes_are_replaced_as_in_the_library(coder, library):
    for ids in ([coder.byte_ids[0xE2], coder.byte_ids[0x82]], [coder.byte_ids[0xFF]] * 3, [coder.byte_ids[0xF0], 1000]):
        assert "".join(coder.decode([np.array(ids, "<u4").tobytes()])) == library.decode(ids, skip_special_tokens=False)


def test_blocks_do_not_cut_characters(coder):
    ids = b"".join(coder.encode("é𝒳€ text"))
    assert "".join(coder.decode(ids[k : k + 4] for k in range(0, len(ids), 4))) == "é𝒳€ text"


def test_ids_leave_the_encoder_block_by_block(coder, library):
    text = "word " * (2 * bpe.CHUNK)
    blocks = list(coder.encode(text))
    assert len(blocks) > 5 and max(map(len, blocks)) < 8 * bpe.CHUNK
    assert "".join(coder.decode(blocks)) == text
    assert np.frombuffer(b"".join(blocks), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_query(spark, small, library):
    rows = {r.doc_id: r for r in queries.op7_bpe(spark, small).collect()}
    for doc_id, text in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(text or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        decoded = library.decode(ids, skip_special_tokens=False)
        expected = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert tuple(rows[doc_id])[1:] == expected


def test_odd_rows(odd, nothing):
    coded = bpe.encode(odd, PATH).toPandas()
    texts = odd.select("text").toPandas().text
    assert coded.decoded.tolist() == [t or "" for t in texts] and bpe.encode(nothing, PATH).count() == 0
    piece = public_tokenizers.path("piece_bpe_32k.model")
    counts = token_counts.count_tokens(odd, piece).toPandas()
    assert (counts.n_tokens == 0).tolist() == [not t for t in texts]
    assert token_counts.count_tokens(nothing, piece).count() == 0


def unigram(pieces, **options):
    model = Tokenizer(models.Unigram(pieces, unk_id=0, **options))
    model.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return lambda text: len(model.encode(text, add_special_tokens=False).ids)


@given(text=st.text("ab ", max_size=40))
@settings(max_examples=300, deadline=None)
def test_ties_are_the_tokenizers(text):
    pieces = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aa", -2.0), ("aba", -3.0), ("▁", -1.0), ("▁a", -2.0), ("ba", -2.0), ("baa", -2.5)]
    assert token_counts.Counter(pieces).count(text) == unigram([("<unk>", 0.0), *pieces])(text)


def test_a_piece_across_words_makes_the_text_one_stretch():
    pieces = [("a", -1.0), ("▁", -1.0), ("a▁a", -0.5), ("▁a", -3.0)]
    counter = token_counts.Counter(pieces)
    expected = unigram([("<unk>", 0.0), *pieces])
    assert counter.stretch is None and all(counter.count(t) == expected(t) for t in ("a a", "a a a", " a  a", "aa a"))


def test_counts_over_the_file_equal_the_library(spark, small):
    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as file:
        content = file.read()
    processor = token_counts.SentencePieceProcessor(model_proto=content)
    pieces = [(processor.id_to_piece(i), processor.get_score(i)) for i in range(processor.get_piece_size())]
    expected = unigram(pieces, byte_fallback=True)
    rows = {r.doc_id: r.n_tokens for r in queries.op3_token_counts(spark, small).collect()}
    for doc_id, text in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect():
        assert rows[doc_id] == expected(text), doc_id
    rng = random.Random(2)
    counter = token_counts.Counter(token_counts.vocabulary_of(content))
    for letters in ("the  re\n", "éß𝒳a \t", "▁ a", "0123 "):
        for _ in range(100):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))
            assert counter.count(text) == expected(text), text
