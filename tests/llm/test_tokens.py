"""Token counts and packing against the tokenizer library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from millrace.llm.bytepair import segments, tokenizer
from millrace.llm.packing import balanced, pack
from millrace.llm.token_counts import count_tokens, spliced_count
from tests.conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Library.from_file(PATH)

ODD = [
    "", " ", "\n\n  \n", "a\xa0 b\xa0  c", "x　 y 　z", "a  b   c\t\t\n d ", "it's 'tis we'll!!'s",
    "<|endoftext|>", "a <|endoftext|>  b<|endoftext|>c  <|endoftext|>", "été​ 你好，世界 12abc34", "\x1c a\x1d  b", "z" * 3000,
    "💥💥 💥\r\n\r\n💥", "trailing   ", "\x85\x85 x \x85 y",
]


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def words(encoded):
    return np.frombuffer(encoded, "<u4").tolist()


@pytest.mark.parametrize("text", ODD)
def test_pieces_give_the_ids_of_the_whole(text):
    assert words(tokenizer(PATH).encode([text])[0]) == ids(text)


letters = st.sampled_from(list(" \t\n\r\xa0 　\x1c\x85'sab1!é你<|>") + ["<|endoftext|>", "  ", "\n\n", " the"])


@settings(max_examples=300, deadline=None)
@given(st.lists(letters, max_size=60).map("".join))
def test_any_text(text):
    assert words(tokenizer(PATH).encode([text])[0]) == ids(text)
    assert spliced_count(text, tokenizer(PATH), 7, 2) == len(ids(text))
    assert "".join(segments(text, 5)) == text
    assert sum((words(tokenizer(PATH).encode([s])[0]) for s in segments(text, 5)), []) == ids(text)


@pytest.mark.parametrize("text", ["word " * 5000, "z" * 4000 + " tail " + "q" * 500, "é你 " * 900, " " * 2000, "a\n" * 999])
@pytest.mark.parametrize("chunk, overlap", [(64, 1), (100, 8), (1000, 300)])
def test_splices_widen_until_they_align(text, chunk, overlap):
    assert spliced_count(text, tokenizer(PATH), chunk, overlap) == len(ids(text))


def test_counts(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(7, None, "x"), (None, "null key", None), (3, ODD[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    found = count_tokens(docs, PATH, chunk_chars=1000, limit=10).collect()
    texts = [t or "" for _, t, _ in rows]
    wanted = sorted(
        (str(k), len(t.encode()), len(ids(t)), len(ids(t)) > 10) for (k, _, _), t in zip(rows, texts)
    )
    assert sorted((str(r[0]), *r[1:]) for r in found) == wanted
    assert count_tokens(docs.where("false"), PATH).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: r.n_tokens for r in count_tokens(docs, PATH).collect()}
    assert found == {r.doc_id: len(ids(r.text)) for r in docs.collect()}


def check_packed(rows, texts, capacity):
    """Pieces cover each document once; sequences are gapless and within capacity."""
    documents, sequences = {}, {}
    for r in rows:
        documents.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for key, text in texts.items():
        whole, at = np.array([*ids(text or ""), 0], "<u4"), 0
        for r in sorted(documents.pop(key), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(whole) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(whole[at : at + r.length].tobytes())
            at += r.length
        assert at == len(whole)
    assert not documents
    used = []
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        used.append(at)
    return used


def test_packed_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    used = check_packed(pack(docs, PATH).collect(), {r.doc_id: r.text for r in docs.collect()}, 1024)
    assert len(used) - sum(used) / 1024 < docs.rdd.getNumPartitions()


def test_packed_corners(spark):
    texts = {1: None, 2: "", 3: "word " * 63, 4: "word " * 5000, 5: "z" * 300, 6: "a"}
    docs = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id bigint, text string, start int")
    used = check_packed(pack(docs.coalesce(1), PATH, capacity=64, block_tokens=100).collect(), texts, 64)
    assert max(used) == 64
    assert pack(docs.where("false"), PATH).count() == 0
    twice = pack(docs.union(docs).coalesce(1), PATH, capacity=64).collect()
    assert sum(r.length for r in twice) == 2 * sum(used)


@given(st.lists(st.integers(1, 31), max_size=200))
def test_no_sequence_more_than_needed(lengths):
    left = [0] * 200
    taken = {}
    for piece, start, length, sequence, offset in balanced(lengths, 32):
        assert left[sequence] == offset and start == taken.get(piece, 0)
        left[sequence] += length
        taken[piece] = start + length
        assert left[sequence] <= 32
    assert taken == dict(enumerate(lengths))
    assert sum(n > 0 for n in left) == -(-sum(lengths) // 32)


def test_costs_are_balanced():
    """Sequences of equal load end with about equal cost."""
    lengths = list(np.random.default_rng(1).integers(1, 700, 4000))
    cost = {}
    for _, _, length, sequence, _ in balanced([int(n) for n in lengths], 1024):
        cost[sequence] = cost.get(sequence, 0) + length + length**2 / 1e3
    found = np.array(list(cost.values()))
    assert found.std() / found.mean() < 0.1


RUNS = {
    "cjk": lambda rng, n: "".join(rng.choice("的一是在不了有和人这，。、1") for _ in range(n)),
    "base64": lambda rng, n: "".join(rng.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(n)),
    "leads": lambda rng, n: ("token=" * (n // 6 + 1))[:n],
    "contractions": lambda rng, n: "".join(rng.choice(["it's", "we'll", "'", "don't", "''s", "x"]) for _ in range(n // 3)),
    "specials": lambda rng, n: "".join(rng.choice(["<|endoftext|>", "<|endof", "text|>", "a1", "|"]) for _ in range(n // 6)),
    "letters": lambda rng, n: "".join(rng.choice("abcdefgh") for _ in range(n)),
    "mixed": lambda rng, n: "".join(rng.choice(["é", "日本", "😀", "\u0301", "12", "...", " ", "\u3000", "'re"]) for _ in range(n // 2)),
}


@pytest.mark.parametrize("kind", RUNS)
def test_unbroken_runs(kind):
    """Counts are the library's, and what is encoded grows with the text."""
    encoder = tokenizer(PATH)
    given = []

    class Counting:
        def boundaries(self, text):
            given.append(len(text))
            return encoder.boundaries(text)

    for size in (3_000, 24_000):
        text = RUNS[kind](random.Random(size), size)
        given.clear()
        assert spliced_count(text, Counting(), 1_000, 16) == len(ids(text))
        assert sum(given) <= 5 * len(text)
