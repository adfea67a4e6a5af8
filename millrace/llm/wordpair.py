"""Ids of a word-level byte-pair vocabulary, with a memory for words and their parts.

Such a tokenizer drops white space, and none of its steps looks across it: no match of its pattern holds
any, and neither composition nor case mapping reaches over a blank. So a text's ids are those of
its runs between ASCII white space. Most runs are letters followed by punctuation, which the
pattern separates; their ids are those of the letters in lower case, then of the punctuation.
Everything else is encoded by the library as it stands.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np

from .common import by_size

ID_BYTES = 4
#: Runs and parts kept per worker process; beyond that the memory starts afresh.
KNOWN_RUNS, KNOWN_PARTS = 700_000, 700_000
#: Longer runs rarely repeat.
KNOWN_RUN_BYTES = 48
PARTS_PER_CALL = 400
#: Bytes of a text cut into runs at a time.
SEGMENT_BYTES = 1 << 20

# Letters of Basic Latin and Latin-1 are single code points with a simple lower case.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)?([!-/:-@\\[-`{-~]+)?")
_SPACE = re.compile(rb"[\t-\r ]")


class WordTokenizer:
    """Ids by the ``tokenizers`` library, without added special tokens.

    Special strings inside a text become their ids, as the library does by default.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer as Library

        with open(path, encoding="utf-8") as file:
            content = file.read()
        self._check(content, path)
        self._library = Library.from_str(content)
        self._library.no_truncation()
        self._library.no_padding()
        self._runs: dict[bytes, bytes] = {}
        self._parts: dict[str, bytes] = {"": b""}

    @staticmethod
    def _check(content: str, path: str) -> None:
        """Refuses files for which white space is no border, or whose pattern is another."""
        form = json.loads(content)
        steps = [s.get("type") for s in (form.get("normalizer") or {}).get("normalizers", [])]
        cuts = (form.get("pre_tokenizer") or {}).get("pretokenizers", [])
        split = cuts[0] if cuts else {}
        words = split.get("behavior") == "Removed" and split.get("invert") is True
        pattern = split.get("pattern", {}).get("Regex", "")
        apart = pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        special = form.get("added_tokens") or []
        odd = any(
            re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")
            for t in special
        )
        if not (words and apart) or steps != ["NFC", "Replace", "Lowercase"] or odd or form.get("post_processor"):
            raise ValueError(f"{path} is no vocabulary of words: white space may not be a border there")

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        out = []
        for segment in _segments(text.encode("utf-8", "surrogatepass")):
            out += self._found([segment.split()])[0]
        return b"".join(out)

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """``encode`` of every text; what is new in about a segment of them is learnt together."""
        for some in by_size(enumerate(texts), SEGMENT_BYTES):
            if len(some[-1][1]) >= SEGMENT_BYTES:
                yield from (self.encode(text) for _, text in some)
            else:
                yield from map(b"".join, self._found([text.encode("utf-8", "surrogatepass").split() for _, text in some]))

    def _found(self, texts: list[list[bytes]]) -> list[list[bytes]]:
        """The ids of each run of each text."""
        known = self._runs
        found = [[*map(known.get, runs)] for runs in texts]
        holes = [(runs, ids, [at for at, i in enumerate(ids) if i is None]) for runs, ids in zip(texts, found) if None in ids]
        longer = self._learn({runs[at] for runs, _, places in holes for at in places}) if holes else ()
        for runs, ids, places in holes:
            for at in places:
                ids[at] = known[runs[at]]
        for run in longer:
            del known[run]
        if len(known) > KNOWN_RUNS:
            known.clear()
        return found

    def _learn(self, new: set[bytes]) -> list[bytes]:
        """Ids of new runs; those that are too long to keep are returned."""
        known, ids, plain = self._runs, self._parts, _PLAIN.fullmatch
        waiting, unknown = [], set()
        for run in new:
            first, then = run.decode("utf-8", "surrogatepass"), ""
            found = plain(first)
            if found:
                first, then = found.groups("")
                first = first.lower()
            one, two = ids.get(first), ids.get(then)
            if one is None or two is None:
                waiting.append((run, first, then))
                unknown.update((first, then))
            else:
                known[run] = one + two
        if waiting:
            unknown = [part for part in unknown if part not in ids]
            self._learn_parts(unknown)
            for run, first, then in waiting:
                known[run] = ids[first] + ids[then]
            if len(ids) > KNOWN_PARTS:
                ids.clear()
                ids[""] = b""
            else:
                for part in unknown:
                    if len(part) > KNOWN_RUN_BYTES:
                        del ids[part]
        return [r for r in new if len(r) > KNOWN_RUN_BYTES]

    def _learn_parts(self, parts: list[str]) -> None:
        """Many parts in one call, told apart by where the library found each token."""
        for at in range(0, len(parts), PARTS_PER_CALL):
            run = parts[at : at + PARTS_PER_CALL]
            found = self._library.encode(" ".join(run), add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            begins = np.array([begin for begin, _ in found.offsets], np.int64)
            first = np.fromiter(accumulate((len(p) + 1 for p in run[:-1]), initial=0), np.int64, len(run))
            cuts = [*(ID_BYTES * np.searchsorted(begins, first)).tolist(), len(ids)]
            self._parts.update(zip(run, (ids[a:b] for a, b in zip(cuts, cuts[1:]))))


def _segments(raw: bytes) -> Iterator[bytes]:
    """``raw`` cut at white space into parts of about ``SEGMENT_BYTES``."""
    at = 0
    while len(raw) - at > SEGMENT_BYTES:
        found = _SPACE.search(raw, at + SEGMENT_BYTES)
        if found is None:
            break
        yield raw[at : found.start()]
        at = found.end()
    yield raw[at:]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process and file."""
    return WordTokenizer(path)
