"""Fingerprints, links and components against plain Python."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.graph import components
from millrace.llm.simhash import fingerprint, links, near_duplicates, spanning
from tests.conftest import SF


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def close_pairs(prints):
    return [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 3]


@given(st.text(st.sampled_from(list("aAbBé \t\n\x0b\x1f\xa0İK.")), max_size=80))
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


def test_long_text_is_hashed_in_blocks(monkeypatch):
    text = " ".join(str(i % 97) for i in range(5000))
    whole = fingerprint(text)
    monkeypatch.setattr("millrace.llm.simhash.SHINGLES_AT_ONCE", 17)
    assert fingerprint(text) == whole == plain_fingerprint(text)


def expected(rows):
    prints = [fingerprint(t) for _, t in rows]
    roots = plain_components(set(prints), close_pairs(sorted(set(prints))))
    smallest = {}
    for (key, _), p in zip(rows, prints):
        if key is not None:
            smallest[roots[p]] = min(smallest.get(roots[p], key), key)
    return sorted((str(k), f"{p:016x}", smallest.get(roots[p])) for (k, _), p in zip(rows, prints))


def shown(df):
    return sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in df.collect())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = shown(near_duplicates(docs))
    assert found == expected(rows)
    assert len({c for _, _, c in found}) < len(rows)


def test_corners(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (None, "a"), (None, "null key"), (7, "one two"), (7, "ONE  two"), (1, "z" * 9000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, fingerprint int, component_id string")
    assert shown(near_duplicates(docs)) == expected(rows)
    assert near_duplicates(docs.where("false")).count() == 0


@pytest.mark.parametrize("hot_variant, block", [(1000, 100), (4, 6), (1, 2)])
def test_links_of_dense_groups(spark, hot_variant, block):
    """Whatever is joined or dealt into blocks, what is connected stays connected."""
    rng = random.Random(7)
    centres = [rng.getrandbits(64) for _ in range(12)]
    prints = {0, *centres}
    for c in centres[:3]:
        prints |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(60)}
    # A chain of steps of three bits, across both halves.
    at = centres[4]
    for i in range(0, 60, 3):
        at ^= 0b111 << i
        prints.add(at)
    prints = sorted(prints)
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    found = links(spark.createDataFrame(signed, "fingerprint bigint"), hot_variant, block).collect()
    pairs = [(r.a % 2**64, r.b % 2**64) for r in found]
    assert all((a ^ b).bit_count() <= 3 and a != b for a, b in pairs)
    assert plain_components(prints, pairs) == plain_components(prints, close_pairs(prints))
    if hot_variant == 1000:
        assert {tuple(sorted(p)) for p in pairs} == {tuple(sorted(p)) for p in close_pairs(prints)}


def test_blocks_emit_fewer_links_than_members():
    prints = np.array([1 << i for i in range(60)], np.int64)  # all pairs are two bits apart
    assert len(spanning(prints)) == 59


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10**6))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(500 + i, 501 + i) for i in range(40)]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    wanted = plain_components({n for p in pairs for n in p}, pairs)
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert found == {n: wanted[n] for n in linked}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
