"""Simple-8b: varying counts of whole numbers in 64-bit words, on flat arrays.

The low four bits of a word are its selector: how many numbers follow and of how many bits each.
Numbers are coded in blocks of a fixed count, every block from a word of its own, whose place
is kept, so that all blocks are coded and decoded side by side. The last word of a block may have
slots to spare. A slot whose bits are all set is an escape: its number stands in a list
beside, in order. Numbers from ``ESCAPED`` on are escapes, so any 64-bit number has a code and a rare
large one does not widen its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Numbers in a word and bits of each, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

SELECTOR_BITS = 4
BLOCK = 1024
ESCAPED = (1 << 20) - 1
#: Blocks coded together, which bounds the memory.
TOGETHER = 256

_U = np.uint64


@dataclass(frozen=True)
class Coded:
    """``words``; ``offsets``, the first word of every block and their number; ``escapes``."""

    size: int
    words: np.ndarray
    offsets: np.ndarray
    escapes: np.ndarray


def _widths(numbers: np.ndarray) -> np.ndarray:
    """Bits that a slot needs: its largest value is the escape, and an escape fits every slot."""
    wide = np.where(numbers >= _U(ESCAPED), _U(0), numbers).astype(np.int64) + 1
    widths = np.frexp(wide.astype(np.float64))[1].astype(np.int8)
    widths[numbers == 0] = 0
    widths[numbers >= _U(ESCAPED)] = 1
    return widths


def _selectors(widths: np.ndarray) -> np.ndarray:
    """At every place of every block, the selector that takes the most numbers from there.

    The widest of the next n numbers is that of two shorter windows that cover them.
    """
    windows = {1: widths}
    best = np.full(widths.shape, len(COUNTS) - 1, np.int8)
    for selector in range(len(COUNTS) - 2, -1, -1):
        count, half = int(COUNTS[selector]), max(windows)
        while half < count:
            wider = min(count, 2 * half)
            windows[wider] = windows[half].copy()
            np.maximum(windows[half][:, : half - wider], windows[half][:, wider - half :], out=windows[wider][:, : half - wider])
            windows.pop(half)
            half = wider
        best = np.where(windows[count] <= BITS[selector], np.int8(selector), best)
    return best


def _coded(numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of all blocks in order, words of each block); a row of ``numbers`` is a block."""
    spare = np.zeros((len(numbers), int(COUNTS[0])), _U)
    padded = np.concatenate([numbers, spare], axis=1)
    best = _selectors(_widths(padded))
    at, live, steps = np.zeros(len(numbers), np.int64), np.flatnonzero(sizes > 0), []
    while live.size:
        selector = best[live, at[live]]
        steps.append((live, at[live], selector))
        at[live] += COUNTS[selector]
        live = live[at[live] < sizes[live]]
    if not steps:
        return np.zeros(0, _U), np.zeros(len(numbers), np.int64)
    block, place, selector = (np.concatenate(x) for x in zip(*steps))
    order = np.lexsort((place, block))
    block, place, selector = block[order], place[order], selector[order]
    words = selector.astype(_U)
    for s in np.unique(selector):
        if BITS[s]:
            mine = np.flatnonzero(selector == s)
            slots = padded[block[mine, None], place[mine, None] + np.arange(COUNTS[s])]
            slots = np.where(slots >= _U(ESCAPED), _U((1 << int(BITS[s])) - 1), slots)
            shifts = (SELECTOR_BITS + np.arange(COUNTS[s]) * BITS[s]).astype(_U)
            words[mine] |= np.bitwise_or.reduce(slots << shifts, axis=1)
    return words, np.bincount(block, minlength=len(numbers))


def encode(numbers: np.ndarray) -> Coded:
    numbers = np.ascontiguousarray(numbers, _U)
    words, per_block = [], []
    for at in range(0, len(numbers), BLOCK * TOGETHER):
        some = numbers[at : at + BLOCK * TOGETHER]
        blocks = -(-len(some) // BLOCK)
        rows = np.zeros(blocks * BLOCK, _U)
        rows[: len(some)] = some
        sizes = np.full(blocks, BLOCK)
        sizes[-1] = len(some) - BLOCK * (blocks - 1)
        coded, counts = _coded(rows.reshape(blocks, BLOCK), sizes)
        words.append(coded)
        per_block.append(counts)
    ends = np.cumsum(np.concatenate([[0], *per_block]).astype(np.int64))
    return Coded(len(numbers), np.concatenate([np.zeros(0, _U), *words]), ends, numbers[numbers >= _U(ESCAPED)])


def decode(coded: Coded) -> np.ndarray:
    return np.concatenate([np.zeros(0, _U), *decoded_parts(coded)])


def decoded_parts(coded: Coded) -> Iterator[np.ndarray]:
    """The numbers, some blocks at a time."""
    taken = 0
    for first in range(0, len(coded.offsets) - 1, TOGETHER):
        last = min(first + TOGETHER, len(coded.offsets) - 1)
        size = min(coded.size - first * BLOCK, (last - first) * BLOCK)
        words = coded.words[coded.offsets[first] : coded.offsets[last]]
        numbers, escaped = _decoded(words, coded.offsets[first : last + 1] - coded.offsets[first], size)
        places = np.flatnonzero(escaped)
        numbers[places] = coded.escapes[taken : taken + len(places)]
        taken += len(places)
        yield numbers


def _decoded(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    selector = (words & _U((1 << SELECTOR_BITS) - 1)).astype(np.int64)
    block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    before = np.cumsum(COUNTS[selector]) - COUNTS[selector]
    place = before - before[offsets[:-1]][block]  # within its block
    # A block's last word may reach beyond it: those slots fall into a margin.
    numbers = np.zeros((len(offsets) - 1, BLOCK + int(COUNTS[0])), _U)
    escaped = np.zeros(numbers.shape, bool)
    for s in np.unique(selector):
        if BITS[s]:
            mine = np.flatnonzero(selector == s)
            shifts = (SELECTOR_BITS + np.arange(COUNTS[s]) * BITS[s]).astype(_U)
            full = _U((1 << int(BITS[s])) - 1)
            slots = (words[mine, None] >> shifts) & full
            to = block[mine, None], place[mine, None] + np.arange(COUNTS[s])
            numbers[to] = slots
            escaped[to] = slots == full
    return numbers[:, :BLOCK].reshape(-1)[:size], escaped[:, :BLOCK].reshape(-1)[:size]
