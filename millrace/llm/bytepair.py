"""Byte-pair ids of whole texts, with a memory for pieces seen before.

A byte-level tokenizer first cuts a text by a pattern whose matches never hold a
non-space character followed by white space; merges never cross a match. So a place
between a non-space character and ASCII white space is a boundary of every encoding,
whatever stands around it, and a text's ids are those of its pieces between such places.
Pieces repeat, so most of them are looked up instead of being encoded again.

A long piece, as in scripts without blanks or in encoded data, has further boundaries: matches
are runs of letters, of digits or of other characters, so their borders are places where matches end, but
for an apostrophe before a letter (a contraction) and for what lies within a special string.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np

ID_BYTES = 4
#: Pieces kept per worker process; beyond that the memory starts afresh.
KNOWN_PIECES = 500_000
#: New pieces encoded in one call.
PIECES_PER_CALL = 200
#: Longer pieces rarely repeat.
KNOWN_PIECE_CHARS = 48
#: Longer pieces are encoded by themselves, and their inner boundaries found.
LONG_PIECE_CHARS = 512

_SPACE = r"\t-\r "
_ASCII_SPACE = "\t\n\x0b\x0c\r "
_PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_BOUNDARY = re.compile(rf"(?<=\S)(?=[{_SPACE}])")
# White space beyond the ASCII white space that _PIECE cuts at.
_WIDE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

# Characters that every version of Unicode has as letters, digits, and neither (without the apostrophe).
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_DIGIT = "0-9"
_OTHER = r"!-&(-/:-@\[-`{-~" + "\u2010-\u2027\u3001-\u3003\u3008-\u3011\uff01-\uff0f\uff1a-\uff20"
_BORDER = re.compile(
    f"(?<=[{_LETTER}])(?=[{_DIGIT}{_OTHER}])|(?<=[{_DIGIT}])(?=[{_LETTER}{_OTHER}])|(?<=[{_OTHER}])(?=[{_LETTER}{_DIGIT}])"
)


def pieces(text: str) -> list[str]:
    """The text cut at all its proven boundaries."""
    if _WIDE_SPACE.search(text):
        return [p for p in _BOUNDARY.split(text) if p]
    return _PIECE.findall(text)


def segments(text: str, chars: int) -> Iterator[str]:
    """The text cut at proven boundaries into parts of about ``chars``, whatever its length."""
    at = 0
    while len(text) - at > chars:
        found = _BOUNDARY.search(text, at + chars)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class Tokenizer:
    """Ids by the ``tokenizers`` library, without added special tokens.

    Special strings inside a text become their ids, as the library does by default.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer as Library

        with open(path, encoding="utf-8") as file:
            content = file.read()
        self._special = self._check(content, path)
        self._library = Library.from_str(content)
        self._library.no_truncation()
        self._library.no_padding()
        self._known: dict[str, bytes] = {}
        self._long: list[str] = []

    @staticmethod
    def _check(content: str, path: str) -> list[str]:
        """The special strings; refuses files for which the boundaries above are not proven."""
        import json

        form = json.loads(content)
        cut = form.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        special = form.get("added_tokens") or []
        odd = any(
            re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word")
            for t in special
        )
        if not plain or form.get("normalizer") or odd:
            raise ValueError(f"{path} is not a plain byte-level vocabulary: its boundaries are not proven")
        return [t["content"] for t in special]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        cut = [pieces(t) for t in texts]
        self._learn(set(chain.from_iterable(cut)))
        out = [b"".join(map(self._known.__getitem__, parts)) for parts in cut]
        self._forget()
        return out

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ends, tokens): where each piece ends, in characters, and the tokens up to there; of a long piece
        also its inner boundaries."""
        parts = pieces(text)
        self._learn({p for p in parts if len(p) <= LONG_PIECE_CHARS})
        ends = np.fromiter(accumulate(map(len, parts)), np.int64, len(parts))
        inner = {at: self._inside(p) for at, p in enumerate(parts) if len(p) > LONG_PIECE_CHARS}
        own = (int(inner[at][1][-1]) if at in inner else len(self._known[p]) // ID_BYTES for at, p in enumerate(parts))
        tokens = np.fromiter(own, np.int64, len(parts)).cumsum()
        self._forget()
        more = []
        for at, (places, counts) in inner.items():
            before = (ends[at - 1], tokens[at - 1]) if at else (0, 0)
            more.append((places[:-1] + before[0], counts[:-1] + before[1]))
        all_ends = np.concatenate([ends, *[e for e, _ in more]])
        order = np.argsort(all_ends, kind="stable")
        return all_ends[order], np.concatenate([tokens, *[t for _, t in more]])[order]

    def _inside(self, piece: str) -> tuple[np.ndarray, np.ndarray]:
        """The boundaries within a long piece and its end, and the tokens up to each, by the offsets of one encoding."""
        token_ends = np.array([end for _, end in self._library.encode(piece, add_special_tokens=False).offsets], np.int64)
        # A special string may be cut by the ends of what was given.
        edge = max(map(len, self._special), default=0)
        proven = np.zeros(len(piece) + 1, bool)
        proven[np.fromiter((m.start() for m in _BORDER.finditer(piece)), np.int64)] = True
        proven[:edge] = proven[len(piece) - edge + 1 :] = False
        for text in self._special:
            at = piece.find(text)
            while at >= 0:
                proven[at + 1 : at + len(text)] = False
                at = piece.find(text, at + 1)
        places = np.append(np.flatnonzero(proven[: len(piece)]), len(piece))
        return places, np.append(np.searchsorted(token_ends, places[:-1], side="right"), len(token_ends))

    def _learn(self, parts: set[str]) -> None:
        new = [p for p in parts if p not in self._known]
        # Pieces that start and end as boundaries ask can follow one another in one text.
        led = [p for p in new if p[0] in _ASCII_SPACE and not p[-1].isspace()]
        for at in range(0, len(led), PIECES_PER_CALL):
            run = led[at : at + PIECES_PER_CALL]
            found = self._library.encode("".join(run), add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            token_ends = np.array([end for _, end in found.offsets], np.int64)
            piece_ends = np.fromiter(accumulate(map(len, run)), np.int64, len(run))
            cuts = (ID_BYTES * np.searchsorted(token_ends, piece_ends, side="right")).tolist()
            self._known.update(zip(run, (ids[a:b] for a, b in zip([0, *cuts], cuts))))
        for piece in new if len(led) < len(new) else ():
            if piece not in self._known:
                ids = self._library.encode(piece, add_special_tokens=False).ids
                self._known[piece] = np.array(ids, "<u4").tobytes()
        self._long = [p for p in new if len(p) > KNOWN_PIECE_CHARS]

    def _forget(self) -> None:
        if len(self._known) > KNOWN_PIECES:
            self._known.clear()
        for piece in self._long:
            self._known.pop(piece, None)
        self._long = []


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One per worker process and file."""
    return Tokenizer(path)
