"""Sketches against plain sets, and edited versions against plain slices."""

import hashlib
import random

import numpy as np
import pytest

from millrace.llm import fingerprints as fp
from millrace.llm.fingerprints import Digests, differing, fingerprint_versions, likeness, paragraphs
from tests.conftest import SF


def texts(seed, count, most=400):
    rng = random.Random(seed)
    words = ["ab", "the", "Straße", "x", "été", "line\n", "word", "of", "sea."]
    return [" ".join(rng.choices(words, k=rng.randrange(most))) for _ in range(count)]


def plain_difference(a, b):
    from collections import Counter

    x, y = Counter(paragraphs(a)), Counter(paragraphs(b))
    return sum(((x - y) + (y - x)).values())


@pytest.mark.parametrize("cells", [1, 2, 12])
def test_peeling_recovers_the_difference(cells):
    a = texts(1, 60)
    b = [t if i % 3 == 0 else t[: len(t) * 3 // 4] + u[:40] for i, (t, u) in enumerate(zip(a, texts(2, 60)))]
    found = differing(Digests(a), Digests(b), cells)
    assert found.tolist() == [plain_difference(x, y) for x, y in zip(a, b)]


def test_small_sketches_fail_and_are_built_anew(monkeypatch):
    a, b = texts(3, 5), texts(4, 5)
    seen = []
    sketch = Digests.sketch
    monkeypatch.setattr(Digests, "sketch", lambda self, cells, seed: seen.append(cells.max()) or sketch(self, cells, seed))
    differing(Digests(a), Digests(b))
    assert len(seen) > 2 and max(seen) > fp.CELLS


def test_directly_when_attempts_end(monkeypatch):
    monkeypatch.setattr(fp, "ATTEMPTS", 0)
    a, b = texts(5, 9), texts(6, 9)
    assert differing(Digests(a), Digests(b)).tolist() == [plain_difference(x, y) for x, y in zip(a, b)]


def test_cut_by_content():
    """An insertion leaves the paragraphs after it as they were."""
    text = texts(7, 1, 4000)[0]
    changed = text[:100] + " inserted here " + text[100:]
    assert likeness(Digests([text]), Digests([changed]))[0] > 0.97
    assert b" ".join(paragraphs(text)).split() == text.encode().split()


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (key, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        quarter = len(text) // 4
        new = text[: len(text) - quarter] + after[:quarter]
        size = lambda x, y: len(paragraphs(x)) + len(paragraphs(y))
        near = [1 - plain_difference(text, o) / size(text, o) if size(text, o) else 1.0 for o in (new, after)]
        out.append((str(key), len(text), hashlib.sha256(new.encode()).hexdigest(), *near))
    return sorted(out)


def shown(df):
    return sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in df.collect())


def assert_same(found, wanted):
    assert [r[:3] for r in found] == [r[:3] for r in wanted]
    assert np.allclose([r[3:] for r in found], [r[3:] for r in wanted])


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = fingerprint_versions(docs)
    assert_same(shown(found), expected([(r.doc_id, r.text) for r in docs.collect()]))
    rows = docs.join(found, "doc_id").collect()
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text, set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len({r.fingerprint for r in rows}) == len(by_text)
    assert np.mean([r.near_edited for r in rows]) > 0.5 > 0.1 > np.mean([r.near_next for r in rows])


@pytest.mark.parametrize(
    "rows",
    [
        [(4, "only one")],
        [(4, "a b c d"), (4, "a b c d"), (None, None), (9, ""), (None, "x"), (-3, "word " * 5000), (2**60, "été 💥 été")],
        [(7, t) for t in texts(8, 30)],
    ],
)
def test_corners(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, fingerprint string, _key int")
    assert_same(shown(fingerprint_versions(docs)), expected(rows))
    assert fingerprint_versions(docs.where("false")).count() == 0
