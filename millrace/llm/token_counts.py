"""Exact token counts, by overlap resynchronisation for huge texts.

A text of ordinary length is encoded as it is. A huge one is encoded chunk by chunk, each
chunk reaching back into the one before. The encodings of two neighbours agree from the
first proven boundary on that both have (see ``bytepair``): there they are spliced. Where
the overlap holds no such place, it is doubled until it does, or until it takes in the
whole chunk before, which is then encoded together with as much again: a run without any boundary, which
the library as well takes as one word, costs a few encodings of itself, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytepair import ID_BYTES, Tokenizer, tokenizer
from .common import by_size

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 8
#: Characters encoded at a time, which bounds a worker's memory.
CALL_CHARS = 1 << 21


def spliced_count(text: str, encoder: Tokenizer, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of ``text``, of which at most a few chunks are encoded at a time."""
    total, start, end = 0, 0, min(chunk, len(text))
    ends, tokens = _encoded(encoder, text, start, end)
    while end < len(text):
        upto, wide = min(end + chunk, len(text)), overlap
        # What the chunk before has no boundary in cannot hold a common one.
        last = int(ends[ends < end].max(initial=start))
        while True:
            while start < end - wide and last <= end - wide:
                wide *= 2
            back = max(end - wide, start)
            if back == start:
                upto = min(max(upto, 2 * end - start), len(text))
            more_ends, more_tokens = _encoded(encoder, text, back, upto)
            if back == start:
                break  # no common boundary anywhere: both chunks are one now
            # A chunk's own border is none of the text's; the rest of its ends are proven.
            common = np.intersect1d(ends[ends < end], more_ends[more_ends < end], assume_unique=True)
            common = common[common > back]
            if common.size:
                splice = common[common.size // 2]
                total += int(tokens[np.searchsorted(ends, splice)])
                total -= int(more_tokens[np.searchsorted(more_ends, splice)])
                break
            wide *= 2
        start, end, ends, tokens = back, upto, more_ends, more_tokens
    return total + (int(tokens[-1]) if tokens.size else 0)


def _encoded(encoder: Tokenizer, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    ends, tokens = encoder.boundaries(text[start:end])
    return ends + start, tokens


def count_tokens(
    docs: DataFrame,
    vocabulary: str,
    key: str = "doc_id",
    text: str = "text",
    limit: int = 512,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """``key``, n_bytes, n_tokens and over_limit (more than ``limit`` tokens), a row per row.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null keys stay, one
    result each. Other columns are not read, whatever their names. An empty table gives
    an empty result. ``vocabulary`` is the path of a byte-level ``tokenizers`` file that
    every executor can open. The work is one pass without a shuffle.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(vocabulary)
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            found = np.zeros(len(texts), np.int64)
            ordinary = []
            for row, value in enumerate(texts.to_pylist()):
                if len(value) > chunk_chars:
                    found[row] = spliced_count(value, encoder, chunk_chars, overlap_chars)
                else:
                    ordinary.append((row, value))
            for run in by_size(ordinary, CALL_CHARS):
                for (row, _), ids in zip(run, encoder.encode([t for _, t in run])):
                    found[row] = len(ids) // ID_BYTES
            sizes = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(found), pa.array(found > limit)],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(
        counts, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
