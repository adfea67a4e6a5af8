"""Cost-balanced packing of tokenized documents into sequences of bounded length.

The cost of a piece of n tokens is ``linear * n + quadratic * n**2``: attention stays
within a document. Whole sequences cut from long documents stand alone. What is left of
the documents is taken in descending length, each piece by the cheapest sequence that
still has room for it; where none has, the piece fills the roomiest sequence and its rest
goes on. A block of documents opens no more sequences than its tokens fill, so at most
one sequence of a block is padded.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytepair import ID_BYTES, Tokenizer, segments, tokenizer
from .common import by_size

CAPACITY = 1024
#: Tokens packed together; a task holds the ids of one block.
BLOCK_TOKENS = 1 << 22
#: Attention over n tokens costs as much as the rest of a layer of width d at n = 6 d.
LINEAR, QUADRATIC = 1.0, 1.0 / (6 * 2048)
CALL_CHARS = 1 << 21
END = (0).to_bytes(ID_BYTES, "little")

PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def balanced(
    lengths: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC
) -> Iterator[tuple[int, int, int, int, int]]:
    """(piece, start in it, length, sequence, offset there) for pieces shorter than ``capacity``."""
    waiting: list[list[tuple[int, int]]] = [[] for _ in range(capacity)]
    for piece in reversed(range(len(lengths))):  # popped from the end: the first comes first
        waiting[lengths[piece]].append((piece, 0))
    count = -(-sum(lengths) // capacity)
    # The sequences by the room they have; ``cheapest`` is the least cost at each room.
    by_room: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    by_room[capacity] = [(0.0, s) for s in range(count)]
    cheapest = np.full(capacity + 1, math.inf)
    if count:
        cheapest[capacity] = 0.0
    for length in range(capacity - 1, 0, -1):
        while waiting[length]:
            piece, start = waiting[length].pop()
            room = length + int(cheapest[length:].argmin())
            taken = length
            if cheapest[room] == math.inf:
                room = taken = int(np.flatnonzero(cheapest[: length + 1] < math.inf)[-1])
                waiting[length - taken].append((piece, start + taken))
            cost, sequence = heapq.heappop(by_room[room])
            cheapest[room] = by_room[room][0][0] if by_room[room] else math.inf
            yield piece, start, taken, sequence, capacity - room
            if room > taken:
                left = by_room[room - taken]
                heapq.heappush(left, (cost + linear * taken + quadratic * taken * taken, sequence))
                cheapest[room - taken] = left[0][0]


class _Block:
    """Documents of a task until they are packed."""

    def __init__(self, first_sequence: int, capacity: int, linear: float, quadratic: float):
        self.next, self.capacity, self.linear, self.quadratic = first_sequence, capacity, linear, quadratic
        self.rows: list[tuple] = []
        self.rests: list[tuple] = []
        self.tokens = 0

    def add(self, key, ids: bytes) -> None:
        total = len(ids) // ID_BYTES
        full = total - total % self.capacity
        for start in range(0, full, self.capacity):
            self._emit(key, ids, start, self.capacity, total, self.next, 0)
            self.next += 1
        if full < total:
            self.rests.append((key, full, total, ids[full * ID_BYTES :]))
            self.tokens += total - full

    def _emit(self, key, ids: bytes, start: int, length: int, total: int, sequence: int, offset: int, cut: int = 0) -> None:
        at = (start - cut) * ID_BYTES
        crc = zlib.crc32(ids[at : at + length * ID_BYTES])
        self.rows.append((key, start, length, crc, total, sequence, offset))

    def pack(self) -> None:
        lengths = [total - cut for _, cut, total, _ in self.rests]
        last = self.next
        for piece, start, length, sequence, offset in balanced(lengths, self.capacity, self.linear, self.quadratic):
            key, cut, total, ids = self.rests[piece]
            self._emit(key, ids, cut + start, length, total, self.next + sequence, offset, cut)
            last = max(last, self.next + sequence + 1)
        self.next, self.rests, self.tokens = last, [], 0

    def flush(self, schema: pa.Schema) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = zip(*rows) if rows else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _ids(encoder: Tokenizer, texts: list[tuple[object, str]]) -> Iterator[tuple[object, bytes]]:
    ordinary = []
    for key, text in texts:
        if len(text) <= CALL_CHARS:
            ordinary.append((key, text))
        else:
            yield key, b"".join(encoder.encode([s])[0] for s in segments(text, CALL_CHARS)) + END
    for run in by_size(ordinary, CALL_CHARS):
        for (key, _), ids in zip(run, encoder.encode([t for _, t in run])):
            yield key, ids + END


def pack(
    docs: DataFrame,
    vocabulary: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    block_tokens: int = BLOCK_TOKENS,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
) -> DataFrame:
    """A row per piece: ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids followed by id 0; a null text is empty, so it is that id alone.
    Every id lies in one piece. Repeated rows and null keys are documents like any other.
    Other columns are not read. An empty table gives no sequence. Blocks are cut along
    the input partitions, so there is no shuffle and a task's memory does not grow with
    the table; a rerun task builds the same sequences from the same rows.
    """
    kind = docs.schema[key].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, block, schema = tokenizer(vocabulary), None, None
        for batch in batches:
            if block is None:
                block = _Block(TaskContext.get().partitionId() << 40, capacity, linear, quadratic)
                names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                schema = pa.schema([(key, batch.schema.field(0).type), *[(n, pa.int64()) for n in names]])
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for name, ids in _ids(encoder, list(zip(batch.column(0).to_pylist(), texts))):
                block.add(name, ids)
                if block.tokens >= block_tokens:
                    block.pack()
            yield block.flush(schema)
        if block is not None:
            block.pack()
            yield block.flush(schema)

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(packed, f"`{key}` {kind}, {PIECE}")
