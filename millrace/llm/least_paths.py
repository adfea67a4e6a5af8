"""Cheapest edits of a run of turns, on flat arrays, and the least of equally cheap ones.

A node is a place between turns and a state: nothing said yet, or whose turn it was last. Edits are
arcs: delete, insert, keep and rerole. A cost DP from the end gives what every node still has to
pay; arcs that keep to it are optimal. Among those, arcs are ranked by the audits that begin with
them, first by one initial, then by two, four, eight ...: a rank of twice the length is a
pair of ranks, the arc's own and that of the best arc where the first half ends. With the last
ranks every node has its next node, and pointers to it, doubled the same way, give the whole path.

Where a run is cut, its border states stand for the rest: ``matrix`` is what a run costs from
each state before it to each state after it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# What an edit costs, and what a turn without an end costs that is not deleted.
DELETE_COST, INSERT_COST, KEEP_COST, REROLE_COST, TRUNCATED_COST = 2, 5, 0, 1, 5

#: Initials of the edits in ASCII order.
LABELS = b"DIKR"
DELETE, INSERT, KEEP, REROLE = range(4)

#: States, which are also the classes of roles: none (or another), system, user, assistant.
STATES = 4
FRESH, SYSTEM, USER, ASSISTANT = range(STATES)
#: Faults of a turn; a code is a fault and a class.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: The state that a rerole or an insert leads to, by state.
ONWARD = np.array([USER, USER, ASSISTANT, USER])
#: The state that a kept turn leads to, by its class and the state; -1 where it may not stand.
KEPT = np.full((STATES, STATES), -1)
KEPT[SYSTEM, FRESH] = SYSTEM
KEPT[USER, [FRESH, SYSTEM, ASSISTANT]] = USER
KEPT[ASSISTANT, USER] = ASSISTANT
#: What inserts still cost at the end of a conversation, by state.
CLOSING = np.array([0, 2 * INSERT_COST, INSERT_COST, 0])

FAR = 1 << 40


@dataclass(frozen=True)
class Runs:
    """Codes of many runs one after the other, and how many each has."""

    codes: np.ndarray
    sizes: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    @property
    def nodes(self) -> np.ndarray:
        """The number of the first place of every run; a place has ``STATES`` nodes."""
        return np.cumsum(self.sizes + 1) - self.sizes - 1

    def arcs(self) -> tuple[np.ndarray, np.ndarray]:
        """(target state, cost) of keeping each turn, by state; far where it may not be kept."""
        fault, kind = self.codes // STATES, self.codes % STATES
        to = KEPT[kind]
        late = np.where(fault == TRUNCATED, TRUNCATED_COST, 0)[:, None]
        gone = ((fault == BLANK) | (fault == DUPLICATE))[:, None]
        return np.maximum(to, 0), np.where((to < 0) | gone, FAR, KEEP_COST + late)

    def reroling(self) -> np.ndarray:
        fault = self.codes // STATES
        late = np.where(fault == TRUNCATED, TRUNCATED_COST, 0)
        return np.where((fault == BLANK) | (fault == DUPLICATE), FAR, REROLE_COST + late)


def to_pay(runs: Runs, ends: np.ndarray) -> np.ndarray:
    """(place, state, column): the least cost from every node to its run's end, where ``ends``
    (run, state, column) has to be paid."""
    cost = np.empty((int((runs.sizes + 1).sum()), STATES, ends.shape[2]), np.int64)
    nodes, first = runs.nodes, runs.first
    cost[nodes + runs.sizes] = ends
    (kept_to, kept), rerole = runs.arcs(), runs.reroling()
    order = np.argsort(-runs.sizes, kind="stable")
    by_size = -runs.sizes[order]
    for back in range(int(runs.sizes.max(initial=0)) - 1, -1, -1):
        live = order[: np.searchsorted(by_size, -back)]
        turn, place = first[live] + back, nodes[live] + back
        after = cost[place + 1]
        least = after + DELETE_COST
        by_keep = np.take_along_axis(after, kept_to[turn][:, :, None], 1) + kept[turn][:, :, None]
        np.minimum(least, by_keep, out=least)
        np.minimum(least, after[:, ONWARD] + rerole[turn][:, None, None], out=least)
        # Two inserts come back to the state they began in: none is followed by a third.
        user, assistant = least[:, USER].copy(), least[:, ASSISTANT].copy()
        least[:, USER] = np.minimum(user, assistant + INSERT_COST)
        least[:, ASSISTANT] = np.minimum(assistant, user + INSERT_COST)
        for state in (FRESH, SYSTEM):
            np.minimum(least[:, state], least[:, USER] + INSERT_COST, out=least[:, state])
        cost[place] = np.minimum(least, FAR)
    return cost


def matrix(runs: Runs) -> np.ndarray:
    """(run, state before, state after): the least cost of each run."""
    ends = np.where(np.eye(STATES, dtype=bool), 0, FAR)
    return to_pay(runs, np.broadcast_to(ends, (len(runs.sizes), STATES, STATES)))[runs.nodes]


@dataclass(frozen=True)
class Paths:
    """For every node the next on its least path, by doubled pointers, and the initial on the way."""

    runs: Runs
    label: np.ndarray
    doubled: list[np.ndarray]
    length: np.ndarray
    cost: np.ndarray

    def start(self, states: np.ndarray) -> np.ndarray:
        return self.runs.nodes * STATES + states

    def leaves(self, states: np.ndarray) -> np.ndarray:
        """The state after each run, begun in ``states``."""
        return self.doubled[-1][self.start(states)] % STATES

    def audits(self, states: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """(initials, cost to the end) of each run, begun in ``states``."""
        start = self.start(states)
        sizes = self.length[start]
        ends = np.cumsum(sizes)
        step = np.arange(int(sizes.sum())) - np.repeat(ends - sizes, sizes)
        at = np.repeat(start, sizes)
        for power, pointer in enumerate(self.doubled):
            at = np.where((step >> power) & 1, pointer[at], at)
        text = np.frombuffer(LABELS, np.uint8)[self.label[at]].tobytes()
        return [text[b - n : b] for b, n in zip(ends.tolist(), sizes.tolist())], self.cost[start]


def least_paths(runs: Runs, ends: np.ndarray, last: np.ndarray) -> Paths:
    """``ends`` (run, state) has to be paid after each run; where it is the ``last`` of its
    conversation, that is for inserts, which belong to its path."""
    cost = to_pay(runs, ends[:, :, None])[:, :, 0].ravel()
    source, label, target = _optimal(runs, cost, last)
    # Nodes that end a path go nowhere, under an initial below all others.
    over = np.setdiff1d(np.arange(len(cost)), source)
    source, target = np.concatenate([source, over]), np.concatenate([target, over])
    label = np.concatenate([label, np.full(len(over), -1)])
    order = np.lexsort((label, source))
    source, label, target = source[order], label[order], target[order]
    starts = np.flatnonzero(np.r_[True, source[1:] != source[:-1]]) if len(source) else source

    ends_here = np.zeros(len(cost), bool)
    ends_here[over] = True
    rank, reached = label + 1, target
    while True:
        best = _best(rank, starts)
        if ends_here[reached[best]].all():
            break
        follows = best[reached]
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + rank[follows], return_inverse=True)[1]
        reached = reached[follows]
    pointer = target[best]
    doubled, length = [pointer], (~ends_here).astype(np.int64)
    while not ends_here[pointer].all():
        length = length + length[pointer]
        pointer = pointer[pointer]
        doubled.append(pointer)
    length = length + length[pointer]
    return Paths(runs, label[best], doubled, length, cost)


def _best(rank: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For every node the arc of the least rank; its arcs begin at ``starts``."""
    if not len(starts):
        return starts
    return np.minimum.reduceat(rank.astype(np.int64) * len(rank) + np.arange(len(rank)), starts) % len(rank)


def _optimal(runs: Runs, cost: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source, label, target) of the arcs that keep to the least cost."""
    turns, states = int(runs.sizes.sum()), np.arange(STATES)
    place = np.arange(turns) + np.repeat(np.arange(len(runs.sizes)), runs.sizes)
    here, after = place[:, None] * STATES + states, (place[:, None] + 1) * STATES
    (kept_to, kept), rerole = runs.arcs(), runs.reroling()
    closing = (runs.nodes + runs.sizes)[last]
    open_places = np.concatenate([place, closing])[:, None] * STATES
    arcs = [
        (DELETE, here, after + states, np.full(here.shape, DELETE_COST)),
        (INSERT, open_places + states, open_places + ONWARD, np.full((len(open_places), STATES), INSERT_COST)),
        (KEEP, here, after + kept_to, kept),
        (REROLE, here, after + ONWARD, np.broadcast_to(rerole[:, None], here.shape)),
    ]
    found = []
    for label, source, target, price in arcs:
        takes = (price < FAR) & (cost[source] == price + cost[target])
        found.append((source[takes], np.full(int(takes.sum()), label), target[takes]))
    return tuple(np.concatenate(x) for x in zip(*found))


def legal(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Whether a turn of class ``after`` may follow one of class ``before``."""
    allowed = np.zeros((STATES, STATES), bool)
    allowed[SYSTEM, USER] = allowed[USER, ASSISTANT] = allowed[ASSISTANT, USER] = True
    return allowed[before, after]
