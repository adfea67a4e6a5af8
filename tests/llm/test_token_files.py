"""Simple-8b words, ids of word vocabularies and the files that hold them."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from millrace.llm import simple8b, token_files
from millrace.llm.queries import QUERIES
from millrace.llm.wordpair import WordTokenizer, word_tokenizer
from millrace.session import fresh_path
from tests.conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Library.from_file(PATH)
LARGEST = 2**64 - 1


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


# Words of 64 bits


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(2**20 - 3, 2**20 + 3), st.integers(0, LARGEST)), max_size=400))
def test_round_trip(numbers):
    coded = simple8b.encode(np.array(numbers, np.uint64))
    assert simple8b.decode(coded).tolist() == numbers
    assert coded.size == len(numbers) and coded.escapes.tolist() == [n for n in numbers if n >= simple8b.ESCAPED]


@pytest.mark.parametrize("size", [0, 1, 1023, 1024, 1025, 1024 * 256 + 1])
@pytest.mark.parametrize("most", [1, 2, 4, 255, 32_767, 2**19, 2**63])
def test_sizes(size, most):
    numbers = np.random.default_rng(size).integers(0, most, size, dtype=np.uint64)
    coded = simple8b.encode(numbers)
    assert (simple8b.decode(coded) == numbers).all()
    assert len(coded.offsets) == -(-size // simple8b.BLOCK) + 1 and coded.offsets[-1] == len(coded.words)


def brute_words(numbers):
    """Greedy packing of one block, number by number."""
    out, at = [], 0
    width = lambda v: 1 if v >= simple8b.ESCAPED else 0 if v == 0 else (v + 1).bit_length()
    while at < len(numbers):
        for selector, (count, bits) in enumerate(zip(simple8b.COUNTS.tolist(), simple8b.BITS.tolist())):
            taken = numbers[at : at + count]
            if all(width(v) <= bits for v in taken):
                word = selector
                for i, v in enumerate(taken):
                    word |= ((1 << bits) - 1 if v >= simple8b.ESCAPED else v) << (4 + i * bits)
                out.append(word)
                at += count
                break
    return out


@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 70_000), st.just(LARGEST)), max_size=500))
def test_words_are_packed_greedily(numbers):
    assert simple8b.encode(np.array(numbers, np.uint64)).words.tolist() == brute_words(numbers)


# Ids

ODD = [
    "", " ", "It's the END, isn't it?!", "été ÀÉ straße ǅ İstanbul ΣΊΣΥΦΟΣ", "a\xa0b　c\x1cd\x85e", "<|endoftext|> x<|endoftext|>y <|start", "123 4.5", "éa ́ x",
    "你好，世界 。。", "💥💥 a💥", "'s 't'll '", "q" * 4000, "!" * 300, "w " * 900, "    ", "mañana... (ok)", "\x00 \x01a",
]


def test_what_is_new_in_many_texts_is_learnt_together(monkeypatch):
    """Texts of a batch take few calls of the library, and give the ids that each gives alone."""
    many = [*ODD, *(f"new{i}word X{i}y. n{i}, THE the" for i in range(300)), "z" * 3000, " ".join(f"far{i}" for i in range(400)), *ODD]
    for segment in (50, 2000, 1 << 20):
        monkeypatch.setattr("millrace.llm.wordpair.SEGMENT_BYTES", segment)
        found = [np.frombuffer(i, "<u4").tolist() for i in WordTokenizer(PATH).encode_all(many)]
        assert found == [ids(text) for text in many]
    tokenizer, calls = WordTokenizer(PATH), []

    class Counted:
        def encode(self, text, **more):
            calls.append(text)
            return LIBRARY.encode(text, **more)

    tokenizer._library = Counted()
    assert len([*tokenizer.encode_all(many)]) == len(many) and len(calls) < 10


@pytest.mark.parametrize("text", ODD)
def test_ids_of_odd_texts(text):
    assert np.frombuffer(word_tokenizer(PATH).encode(text), "<u4").tolist() == ids(text)


letters = st.sampled_from(list(" \t\n\x0b\x1c\x85\xa0'stdLLaZ1!.,é́ÉΣ你<|> ") + ["<|endoftext|>", "'ll", " the "])


@settings(max_examples=300, deadline=None)
@given(st.lists(letters, max_size=50).map("".join))
def test_ids_of_any_text(text):
    assert np.frombuffer(word_tokenizer(PATH).encode(text), "<u4").tolist() == ids(text)


def test_memory_starts_afresh(monkeypatch):
    from millrace.llm import wordpair

    monkeypatch.setattr(wordpair, "KNOWN_RUNS", 3)
    monkeypatch.setattr(wordpair, "KNOWN_PARTS", 3)
    monkeypatch.setattr(wordpair, "SEGMENT_BYTES", 10)
    small = WordTokenizer(PATH)
    for text in [*ODD, "one two three four five, six. " * 4, "z" * 60 + " " + "z" * 60]:
        assert np.frombuffer(small.encode(text), "<u4").tolist() == ids(text)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="white space"):
        WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


# Files


def expected(rows):
    at, out = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        whole = np.array([*ids(text), 2], "<u4")
        out.append((key, at, len(whole), zlib.crc32(whole.tobytes())))
        at += len(whole)
    return out


@pytest.mark.parametrize("record_ids", [1 << 17, 20])
def test_files(spark, record_ids):
    rows = [(i * 7 % 101, t, 1) for i, t in enumerate(ODD * 3)] + [(None, "no key", 1), (500, None, 1)]
    docs = spark.createDataFrame(list({r[0]: r for r in rows}.values()), "doc_id bigint, text string, part int")
    path = fresh_path(spark, "tokens")
    token_files.write_token_files(docs.repartition(5), path, PATH, record_ids=record_ids)
    wanted = expected([(r.doc_id, r.text) for r in docs.collect()])
    found = sorted(map(tuple, token_files.token_digests(spark, path).collect()), key=lambda r: r[1])
    assert found == wanted
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in token_files.read_token_files(spark, path).collect():
        assert r.ids == [*ids(texts[r.doc_id]), 2]


def test_repeated_keys_and_rows(spark):
    rows = [(5, f"text {i % 3}") for i in range(60)] + [(4, "before"), (6, "after"), (None, "first")]
    path = fresh_path(spark, "tokens")
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id bigint, text string"), path, PATH, record_ids=30)
    found = sorted(map(tuple, token_files.token_digests(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [None, 4, *[5] * 60, 6]
    assert all(a[1] + a[2] == b[1] for a, b in zip(found, found[1:]))
    assert sorted((k, n, c) for k, _, n, c in found[1:]) == sorted((k, n, c) for k, _, n, c in expected(rows)[1:])


def test_text_keys_and_no_rows(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "z")], "name string, body string")
    path = fresh_path(spark, "tokens")
    token_files.write_token_files(docs, path, PATH, key="name", text="body", end_id=7)
    found = token_files.read_token_files(spark, path, "name", "string").orderBy("start").collect()
    assert [(r.name, r.ids) for r in found] == [("a", [*ids("z"), 7]), ("b", [*ids("x y"), 7])]
    path = fresh_path(spark, "tokens")
    token_files.write_token_files(docs.where("false"), path, PATH, key="name", text="body")
    assert token_files.read_token_files(spark, path, "name", "string").count() == 0


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = sorted(map(tuple, QUERIES["op13_token_files"](spark, SF).collect()))
    assert found == expected(rows)
