"""Conversation structure repair: the cheapest edits that make roles take turns.

A repaired conversation has role initials ``(s?(ua)+)?``. Turns may be kept, reroled or deleted, and
empty ones inserted; ``least_paths`` has the cost DP and, by prefix-doubling ranks, the
least audit among equally cheap ones.

Conversations are cut into runs of bounded length, so that none is worked on whole. A run is summed up by
its costs between border states; those fold over a tree of bounded fan-in, down which
every run gets what follows it costs, and then the state in which the least path comes to it.
Then each run finds its own part of the audit.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.groups import Heat, join_on
from ..operators.windows import running
from ..session import materialize
from . import least_paths as lp

#: Turns of a run, runs (or nodes) under a node of the tree, and turns worked on together.
RUN_TURNS, FAN_IN, TURNS_TOGETHER = 1024, 1024, 1 << 16

# The white space that fills no turn.
BLANKS = " \t\n\x0b\x0c\r"

ROLES = {lp.USER: "user", lp.ASSISTANT: "assistant"}
_INITIALS = {"s": lp.SYSTEM, "u": lp.USER, "a": lp.ASSISTANT}
COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
_CONV = ["_conv"]
_ORDER = ["_turn", "_role", "_text", "_spread"]


def damaged(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(``conversation``, ``turn``, ``role``, ``text``) with damage decided by a checksum of
    conversation and turn, modulo 20: 0 drops the row, 1 empties its text, 2 removes its marks of a
    sentence's end, 3 repeats it, 4 makes its role user. Nulls count as one space."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled(conversation), F.lit(":"), filled(turn)).cast("binary")) % 20
    rows = turns.select(
        F.col(conversation).alias("_conv"), F.col(turn).alias("_turn"),
        filled(role).alias("_role"), filled(text).alias("_text"), kind.alias("_kind"),
    ).where("_kind <> 0")
    cut = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("_text", "[.!?]", ""))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return rows.select(
        F.col("_conv").alias(conversation), F.col("_turn").alias(turn),
        F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role")).alias(role),
        F.coalesce(cut, F.col("_text")).alias(text), copies.alias("_copy"),
    ).drop("_copy")



def _placed(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows with their place (from 1), the class of their role and the fault that shows in their own text."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(
        F.col(conversation).alias("_conv"), F.col(turn).alias("_turn"), filled(role).alias("_role"), filled(text).alias("_text")
    ).withColumn("_spread", F.monotonically_increasing_id())
    placed = running(rows, _CONV, _ORDER, {"_place": F.lit(1).cast("bigint")}, Heat.found(rows, _CONV))
    said = F.rtrim("_text", F.lit(BLANKS))
    fault = F.when(said == "", lp.BLANK).when(~F.right(said, F.lit(1)).isin(".", "!", "?"), lp.TRUNCATED).otherwise(lp.SOUND)
    kind = F.lit(lp.FRESH)
    for initial, number in _INITIALS.items():
        kind = F.when(F.col("_role").startswith(initial), number).otherwise(kind)
    return materialize(placed.select("_conv", "_place", "_turn", "_role", "_text", fault.alias("_fault"), kind.alias("_kind")), "placed")


def _runs(placed: DataFrame, run_turns: int) -> DataFrame:
    """(_conv, _run, _before, _codes, _last): codes of each run, the one before it, and the number of the last.

    Turns that were said before fold to their first place, however often they recur.
    """
    said = placed.groupBy("_conv", "_role", F.sha2("_text", 256).alias("_said")).agg(F.min("_place").alias("_place"))
    first = said.select("_conv", "_place", F.lit(True).alias("_first"))
    turns = join_on(placed.select("_conv", "_place", "_fault", "_kind"), first, ["_conv", "_place"])
    again = F.col("_first").isNull() & (F.col("_fault") != lp.BLANK)
    code = F.when(again, lp.DUPLICATE).otherwise(F.col("_fault")) * lp.STATES + F.col("_kind")
    run = F.expr(f"(_place - 1) div {run_turns}")
    # The last turn of a run is also seen by the next.
    runs = F.when(F.col("_place") % run_turns == 0, F.array(run, run + 1)).otherwise(F.array(run))
    coded = turns.select("_conv", "_place", code.cast("int").alias("_code"), F.explode(runs).alias("_run"))
    grouped = coded.groupBy("_conv", "_run").agg(F.sort_array(F.collect_list(F.struct("_place", "_code"))).alias("_all"))
    begins = F.col("_run") * run_turns
    grouped = grouped.where(F.get("_all", F.size("_all") - 1)["_place"] > begins)
    carried = F.get("_all", F.lit(0))["_place"] <= begins
    codes = F.transform(F.filter("_all", lambda x: x["_place"] > begins), lambda x: x["_code"])
    grouped = grouped.select(
        "_conv", "_run", F.when(carried, F.get("_all", F.lit(0))["_code"]).otherwise(-1).alias("_before"), codes.alias("_codes")
    )
    grouped = materialize(grouped, "runs")
    return join_on(grouped, grouped.groupBy("_conv").agg(F.max("_run").alias("_last")), _CONV)


def _several(rows: list, sizes: list[int]) -> Iterator[list]:
    """Runs of ``rows`` of about ``TURNS_TOGETHER`` turns in all."""
    some, held = [], 0
    for row, size in zip(rows, sizes):
        some.append(row)
        held += size
        if held >= TURNS_TOGETHER:
            yield some
            some, held = [], 0
    if some:
        yield some


def _as_runs(codes: list[list[int]]) -> lp.Runs:
    sizes = np.fromiter(map(len, codes), np.int64, len(codes))
    return lp.Runs(np.fromiter((c for run in codes for c in run), np.int64, int(sizes.sum())), sizes)


def _chunks(batches: Iterator[pa.RecordBatch], codes: str) -> Iterator[dict[str, list]]:
    for batch in batches:
        rows = batch.to_pylist()
        for some in _several(rows, [len(r[codes]) for r in rows]):
            yield {name: [r[name] for r in some] for name in batch.schema.names}


def _table(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns.values()], names=list(columns))


def _matrices(runs: DataFrame, kind: str) -> DataFrame:
    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.schema.field("_conv").type
            for some in _chunks(iter([batch]), "_codes"):
                found = lp.matrix(_as_runs(some["_codes"])).reshape(len(some["_run"]), -1)
                yield _table({"_conv": (some["_conv"], key), "_node": (some["_run"], pa.int64()), "_m": (found.tolist(), pa.list_(pa.int64()))})

    return runs.select("_conv", "_run", "_codes").mapInArrow(computed, f"_conv {kind}, _node bigint, _m array<bigint>")


def _exits(runs: DataFrame, kind: str) -> DataFrame:
    """Of every run, the state after it for each state before it, as a matrix that is 0 there and far elsewhere."""

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.schema.field("_conv").type
            for some in _chunks(iter([batch]), "_codes"):
                paths = _paths(some)
                found = np.full((len(some["_run"]), lp.STATES, lp.STATES), lp.FAR)
                for state in range(lp.STATES):
                    found[np.arange(len(found)), state, paths.leaves(np.full(len(found), state))] = 0
                cells = found.reshape(len(found), -1).tolist()
                yield _table({"_conv": (some["_conv"], key), "_node": (some["_run"], pa.int64()), "_m": (cells, pa.list_(pa.int64()))})

    return runs.select("_conv", "_run", "_last", "_codes", "_ends").mapInArrow(computed, f"_conv {kind}, _node bigint, _m array<bigint>")


def _paths(some: dict[str, list]) -> lp.Paths:
    last = np.array(some["_run"]) == np.array(some["_last"])
    return lp.least_paths(_as_runs(some["_codes"]), np.array(some["_ends"], np.int64).reshape(-1, lp.STATES), last)


def _along(vector: np.ndarray, cells: list[int], back: bool) -> np.ndarray:
    m = np.array(cells, np.int64).reshape(lp.STATES, lp.STATES)
    return np.minimum((m + vector).min(1) if back else (vector[:, None] + m).min(0), lp.FAR)


def _product(matrices: list[list[int]]) -> list[int]:
    out = np.array(matrices[0], np.int64).reshape(lp.STATES, lp.STATES)
    for cells in matrices[1:]:
        m = np.array(cells, np.int64).reshape(lp.STATES, lp.STATES)
        out = np.minimum((out[:, :, None] + m[None]).min(1), lp.FAR)
    return out.ravel().tolist()


def _scan(nodes: DataFrame, start: list[int], back: bool, fan_in: int, kind: str) -> DataFrame:
    """(_conv, _node, _v): ``start`` carried over the matrices of all nodes before each, or, ``back``, after it.

    Up a tree, nodes fold ``fan_in`` at a time; down it, every node hands its children what comes
    to them. No group is larger than ``fan_in``.
    """
    levels = [materialize(nodes, "level")]
    parent = F.expr(f"_node div {fan_in}").alias("_parent")
    gathered = lambda level: level.groupBy("_conv", parent).agg(F.sort_array(F.collect_list(F.struct("_node", "_m"))).alias("_nodes"))
    while (levels[-1].agg(F.max("_node")).first()[0] or 0) > 0:

        def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [_product([n["_m"] for n in nodes]) for nodes in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int64()))], names=["_conv", "_node", "_m"])

        levels.append(materialize(gathered(levels[-1]).mapInArrow(folded, f"_conv {kind}, _node bigint, _m array<bigint>"), "level"))
    carried = levels.pop().select("_conv", "_node", F.array(*map(F.lit, start)).cast("array<bigint>").alias("_v"))
    for level in reversed(levels):

        def handed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, out = batch.column(0).to_pylist(), ([], [], [])
                for conv, vector, nodes in zip(keys, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    v = np.array(vector, np.int64)
                    for node in reversed(nodes) if back else nodes:
                        for column, value in zip(out, (conv, node["_node"], v.tolist())):
                            column.append(value)
                        v = _along(v, node["_m"], back)
                yield _table({"_conv": (out[0], batch.schema.field(0).type), "_node": (out[1], pa.int64()), "_v": (out[2], pa.list_(pa.int64()))})

        above = carried.withColumnRenamed("_node", "_parent")
        families = join_on(gathered(level), above, ["_conv", "_parent"]).select("_conv", "_v", "_nodes")
        carried = materialize(families.mapInArrow(handed, f"_conv {kind}, _node bigint, _v array<bigint>"), "level")
    return carried


def _solved(runs: DataFrame, kind: str) -> DataFrame:
    """(_conv, _run, _audit, counts) of runs with what follows them and the state they begin in."""

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.schema.field("_conv").type
            for some in _chunks(iter([batch]), "_codes"):
                paths, states = _paths(some), np.array(some["_state"], np.int64)
                audits, cost = paths.audits(states)
                leaves = paths.leaves(states)
                last = np.array(some["_run"]) == np.array(some["_last"])
                ends = np.array(some["_ends"], np.int64).reshape(-1, lp.STATES)
                # What is still to pay after a run is not its own; the inserts that close the last are.
                cost = np.where(last, cost, cost - ends[np.arange(len(ends)), leaves])
                counts = _counted(paths.runs, np.array(some["_before"], np.int64))
                columns = {"_conv": (some["_conv"], key), "_run": (some["_run"], pa.int64()), "_audit": ([a.decode() for a in audits], pa.string())}
                yield _table(columns | {n: (v, pa.int64()) for n, v in zip(COUNTS, [*counts, cost])})

    shape = f"_conv {kind}, _run bigint, _audit string, " + ", ".join(f"{n} bigint" for n in COUNTS)
    return runs.select("_conv", "_run", "_last", "_before", "_codes", "_ends", "_state").mapInArrow(computed, shape)


def _counted(runs: lp.Runs, before: np.ndarray) -> list[np.ndarray]:
    """Blank, duplicate, truncated turns of every run, and those that may not follow the one before."""
    owner = np.repeat(np.arange(len(runs.sizes)), runs.sizes)
    fault, kind = runs.codes // lp.STATES, runs.codes % lp.STATES
    previous = np.r_[0, kind[:-1]] if len(kind) else kind
    previous[runs.first] = np.maximum(before, 0) % lp.STATES
    wrong = ~lp.legal(previous, kind)
    wrong[runs.first] &= before >= 0
    each = [fault == f for f in (lp.BLANK, lp.DUPLICATE, lp.TRUNCATED)]
    return [np.bincount(owner, weights=w, minlength=len(runs.sizes)).astype(np.int64) for w in (*each, wrong)]


def audits(placed: DataFrame, run_turns: int = RUN_TURNS, fan_in: int = FAN_IN) -> DataFrame:
    """(_conv, _run, _audit, counts): the audit of every conversation in runs of turns."""
    kind = placed.schema["_conv"].dataType.simpleString()
    runs = _runs(placed, run_turns)
    closing = F.array(*[F.lit(int(c)) for c in lp.CLOSING]).cast("array<bigint>")
    whole = runs.where("_last = 0").select("*", closing.alias("_ends"), F.lit(lp.FRESH).alias("_state"))
    solved = _solved(whole, kind)
    cut = runs.where("_last > 0")
    if not cut.isEmpty():
        named = lambda vectors, name: vectors.select("_conv", F.col("_node").alias("_run"), F.col("_v").alias(name))
        ends = _scan(_matrices(cut, kind), lp.CLOSING.tolist(), True, fan_in, kind)
        cut = materialize(join_on(cut, named(ends, "_ends"), ["_conv", "_run"]), "cut-runs")
        begun = [0 if s == lp.FRESH else lp.FAR for s in range(lp.STATES)]
        entered = _scan(_exits(cut, kind), begun, False, fan_in, kind)
        cut = join_on(cut, named(entered, "_entered"), ["_conv", "_run"])
        state = F.expr("cast(array_position(_entered, 0L) - 1 AS int)")
        solved = solved.unionByName(_solved(cut.withColumn("_state", state), kind))
    return materialize(solved, "audits")


# -- replay -------------------------------------------------------------------------


def _lined_up(placed: DataFrame, solved: DataFrame, run_turns: int) -> DataFrame:
    """Turns in order, each run of them after its audit; a conversation is in one partition.

    Partitions are streamed, so a conversation of any length passes through in batches.
    """
    said = placed.select("_conv", "_place", F.lit(0).alias("_step"), "_turn", "_role", "_text", F.lit(None).cast("string").alias("_audit"))
    nothing = [F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in ("_turn", "_role", "_text")]
    told = solved.select("_conv", (F.col("_run") * run_turns).alias("_place"), F.lit(1).alias("_step"), *nothing, "_audit")
    order = [F.col("_conv").asc_nulls_first(), "_place", "_step"]
    return said.unionByName(told).repartition("_conv").sortWithinPartitions(*order).select("_conv", "_turn", "_role", "_text", "_audit")


class _Replay:
    """One conversation as its audit is followed."""

    def __init__(self, conv) -> None:
        self.conv, self.state, self.audit = conv, lp.FRESH, []
        self.waiting: deque[int] = deque()

    def tell(self, audit: str) -> Iterator[tuple]:
        yield from self._inserts()
        self.audit.append(audit)
        self.waiting.extend(lp.LABELS.index(c) for c in audit.encode())

    def _inserts(self) -> Iterator[tuple]:
        while self.waiting and self.waiting[0] == lp.INSERT:
            self.waiting.popleft()
            self.state = int(lp.ONWARD[self.state])
            yield None, ROLES[self.state], ""

    def turn(self, turn, role: str, text: str) -> Iterator[tuple]:
        yield from self._inserts()
        edit = self.waiting.popleft()
        if edit == lp.KEEP:
            self.state = int(lp.KEPT[_INITIALS[role[:1]], self.state])
            yield turn, role, text
        elif edit == lp.REROLE:
            self.state = int(lp.ONWARD[self.state])
            yield turn, ROLES[self.state], text

    close = _inserts


def _replays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Replay, Iterator[tuple]]]:
    """Every conversation with its repaired turns (turn, role, text), some at a time."""
    now = None
    for batch in batches:
        for conv, turn, role, text, audit in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now.conv != conv:
                if now is not None:
                    yield now, now.close()
                now = _Replay(conv)
            yield now, now.turn(turn, role, text) if audit is None else now.tell(audit)
    if now is not None:
        yield now, now.close()


def _digests(lined: DataFrame, kind: str) -> DataFrame:
    """(_conv, audit, repaired_sha256)."""

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, digest, lines, key = [], None, None, 0, None

        def keyed():
            nonlocal key
            for batch in batches:
                key = batch.schema.field(0).type
                yield batch

        def shown():
            columns = zip(*out)
            return _table({n: (list(c), k) for n, c, k in zip(("_conv", "audit", "repaired_sha256"), columns, (key, pa.string(), pa.string()))})

        for replay, turns in _replays(keyed()):
            if replay is not now:
                if now is not None:
                    out.append((now.conv, "".join(now.audit), digest.hexdigest()))
                now, digest, lines = replay, hashlib.sha256(), 0
                if len(out) >= 512:
                    yield shown()
                    out.clear()
            for _, role, text in turns:
                digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1
        if now is not None:
            out.append((now.conv, "".join(now.audit), digest.hexdigest()))
            yield shown()

    return lined.mapInArrow(computed, f"_conv {kind}, audit string, repaired_sha256 string")


def repaired_turns(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    run_turns: int = RUN_TURNS, fan_in: int = FAN_IN,
) -> DataFrame:
    """(``conversation``, place, ``turn``, ``role``, ``text``): the turns of the repaired conversations.

    ``place`` counts from 0; an inserted turn has a null ``turn`` and an empty text.
    """
    placed = _placed(turns, conversation, turn, role, text)
    lined = _lined_up(placed, audits(placed, run_turns, fan_in), run_turns)
    kinds = [placed.schema[c].dataType.simpleString() for c in ("_conv", "_turn")]

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, out, now, place = [], [], None, 0

        def typed():
            for batch in batches:
                types[:] = [batch.schema.field(0).type, pa.int64(), batch.schema.field(1).type, pa.string(), pa.string()]
                yield batch

        def shown():
            return _table({n: (list(c), k) for n, c, k in zip((conversation, "place", turn, role, text), zip(*out), types)})

        for replay, found in _replays(typed()):
            if replay is not now:
                now, place = replay, 0
            for number, who, said in found:
                out.append((replay.conv, place, number, who, said))
                place += 1
            if len(out) >= 512:
                yield shown()
                out.clear()
        if out:
            yield shown()

    return lined.mapInArrow(computed, f"`{conversation}` {kinds[0]}, place bigint, `{turn}` {kinds[1]}, `{role}` string, `{text}` string")


def repair(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    ids: DataFrame | None = None, run_turns: int = RUN_TURNS, fan_in: int = FAN_IN,
) -> DataFrame:
    """(``conversation``, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    A conversation's turns are ordered by turn, nulls first, then by role and text. Null roles and
    texts count as one space. Rows of a null conversation are one conversation. Repeated rows are
    duplicates; a null turn belongs to no gap. ``ids`` has the conversations to report, also those
    without turns: zeros, an empty audit, the hash of an empty text. Other columns are not read. An
    empty table gives an empty result.

    No conversation is gathered anywhere, but its hash and its audit are one value each: they are taken
    by one task, in a stream.
    """
    placed = _placed(turns, conversation, turn, role, text)
    kind = placed.schema["_conv"].dataType.simpleString()
    solved = audits(placed, run_turns, fan_in)
    span = F.max("_turn") - F.min("_turn") + 1 - F.count_distinct("_turn")
    gaps = placed.groupBy("_conv").agg(F.coalesce(span, F.lit(0)).cast("bigint").alias("gaps"))
    counts = solved.groupBy("_conv").agg(*[F.sum(n).alias(n) for n in COUNTS])
    told = _digests(_lined_up(placed, solved, run_turns), kind)
    found = join_on(join_on(gaps, counts, _CONV), told, _CONV)
    if ids is not None:
        found = join_on(ids.select(F.col(conversation).alias("_conv")).distinct(), found, _CONV)
    return found.select(
        F.col("_conv").alias(conversation), *[F.coalesce(n, F.lit(0)).alias(n) for n in ("gaps", *COUNTS)],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
