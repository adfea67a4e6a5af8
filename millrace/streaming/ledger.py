"""The count ledger of a streaming job: one row per stage and batch, written when the batch commits.

Counts are taken where the rows pass: a query observes them as it writes a batch, and tells them when the
batch has ended. A round puts the batches that are new into the ledger and reads nothing else. Counts
that were lost with a process are taken anew from the files that the batch had committed, of those
batches alone. The ledger is a folder beside the checkpoint; a restarted run goes on from it.

The rows that have been passed on are marked, so that a sink gets each once; a crash between the two
sends a row again, under the same run, stage, source and batch.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from . import commit_log

COUNTS = ("read", "rejected", "transformed", "written", "late")
SCHEMA = "stage string, source string, batch bigint, at_ms bigint, files bigint, " + ", ".join(f"`{c}` bigint" for c in COUNTS)
#: What a query observes has this name.
OBSERVED = "millrace"


@dataclass(frozen=True)
class Entry:
    """Counts of one batch of a stage; ``files`` numbers the files of its sink so far."""

    stage: str
    source: str
    batch: int
    at_ms: int
    files: int = 0
    counts: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        named = {"stage": self.stage, "source": self.source, "batch": self.batch, "at_ms": self.at_ms, "files": self.files}
        return json.dumps(named | self.counts)


@dataclass
class Totals:
    """Counts of many batches, and apart from them those of batches whose target holds fewer or more rows than it was given."""

    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTS, 0))
    lag: tuple[int, int] = (0, 0)
    extra: tuple[int, int] = (0, 0)
    first_ms: int | None = None
    last_ms: int | None = None

    def add(self, entry: Entry) -> None:
        for name, value in entry.counts.items():
            self.counts[name] += value
        given, held = entry.counts.get("transformed", 0), entry.counts.get("written", 0)
        if given > held:
            self.lag = (self.lag[0] + given, self.lag[1] + held)
        elif given < held:
            self.extra = (self.extra[0] + given, self.extra[1] + held)
        self.first_ms = entry.at_ms if self.first_ms is None else min(self.first_ms, entry.at_ms)
        self.last_ms = entry.at_ms if self.last_ms is None else max(self.last_ms, entry.at_ms)


def totals_of(entries: Iterable[Entry]) -> Totals:
    out = Totals()
    for entry in entries:
        out.add(entry)
    return out


def by_window(entries: Iterable[Entry], width_ms: int) -> dict[int, Totals]:
    """Totals by the start of the window that a batch's time falls into."""
    out: dict[int, Totals] = {}
    for entry in entries:
        out.setdefault(entry.at_ms // width_ms * width_ms, Totals()).add(entry)
    return out


# -- what queries observe -----------------------------------------------------------


class Observations(StreamingQueryListener):
    """Counts of batches that have ended, until a ledger takes them."""

    def __init__(self) -> None:
        self.news = threading.Condition()
        self.counts: dict[str, dict[int, dict[str, int]]] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        observed = progress.observedMetrics.get(OBSERVED)
        if observed is not None:
            late = sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)
            with self.news:
                batches = self.counts.setdefault(str(progress.runId), {})
                # An idle trigger reports its last batch once more, without rows.
                batches.setdefault(progress.batchId, {**observed.asDict(), "late": late})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.news:
            self.ended.add(str(event.runId))
            self.news.notify_all()

    def of(self, query: StreamingQuery, patience: float) -> dict[int, dict[str, int]]:
        """What is known of the query's batches; of a query that has ended, all it told."""
        run = str(query.runId)
        with self.news:
            if not query.isActive:
                self.news.wait_for(lambda: run in self.ended, patience)
            return dict(self.counts.get(run, {}))

    def forget(self, query: StreamingQuery, batches: Iterable[int]) -> None:
        with self.news:
            known = self.counts.get(str(query.runId), {})
            for batch in batches:
                known.pop(batch, None)


OBSERVATIONS = Observations()
_WATCHED = "_millrace_observations"
#: Seconds to wait for the last records of a query that has ended.
PATIENCE = 10


def watch(spark: SparkSession) -> None:
    """Has the counts of the queries recorded that start in the session from now on."""
    if not getattr(spark, _WATCHED, False):
        spark.streams.addListener(OBSERVATIONS)
        setattr(spark, _WATCHED, True)


def observed(rows: DataFrame, **counts: Column) -> DataFrame:
    """``rows`` that tell these counts whenever a batch of them has been written."""
    return rows.observe(OBSERVED, *[c.cast("bigint").alias(name) for name, c in counts.items()])


# -- stages -------------------------------------------------------------------------

Recount = Callable[[list[str]], DataFrame]


@dataclass
class FileStage:
    """A query that writes files: its sink's folder and its checkpoint.

    ``recount`` gives (file, counts) of files for batches whose counts were lost; ``measure`` gives
    those counts that always come from the files, such as what a target holds.
    """

    stage: str
    source: str
    folder: str
    checkpoint: str
    recount: Recount
    measure: Recount | None = None
    query: StreamingQuery | None = None

    def news(self, spark: SparkSession, last: Entry | None) -> list[Entry]:
        """Entries of the batches after ``last`` whose counts are known."""
        committed = commit_log.sink_batches(spark, self.folder, last.batch if last else -1, last.files if last else 0)
        # Entries that the log has but the query has not committed yet belong to a batch in flight.
        done = commit_log.committed_upto(spark, self.checkpoint)
        committed = [c for c in committed if c.batch <= done]
        told = OBSERVATIONS.of(self.query, PATIENCE) if self.query is not None and committed else {}
        lost = [c for c in committed if c.batch not in told]
        if lost and self.query is not None and self.query.isActive and lost[-1].batch == committed[-1].batch:
            # The newest batch has not reported yet: it is for the next round.
            committed, lost = committed[:-1], lost[:-1]
        found = _by_batch(self.recount, lost)
        held = _by_batch(self.measure, committed) if self.measure else {}
        entries = []
        for c in committed:
            at = commit_log.batch_time(spark, self.checkpoint, c.batch)
            counts = {**told.get(c.batch, found.get(c.batch, {})), **held.get(c.batch, {})}
            entries.append(Entry(self.stage, self.source, c.batch, at if at is not None else (last.at_ms if last else 0), c.upto, counts))
        if self.query is not None:
            OBSERVATIONS.forget(self.query, [e.batch for e in entries])
        return entries


def _by_batch(count: Recount, batches: list[commit_log.Committed]) -> dict[int, dict[str, int]]:
    """Counts per batch: one job over the files of all ``batches``."""
    owner = {f.rsplit("/", 1)[-1]: c.batch for c in batches for f in c.files}
    out: dict[int, dict[str, int]] = {}
    if not owner:
        return out
    for row in count([f for c in batches for f in c.files]).toLocalIterator():
        counts = row.asDict()
        batch = owner.get(counts.pop("file"))
        for name, value in counts.items() if batch is not None else ():
            own = out.setdefault(batch, {})
            own[name] = own.get(name, 0) + value
    return out


# -- the ledger ---------------------------------------------------------------------


class Ledger:
    """Rows of all stages under a folder, and which of them have been passed on."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.stages = spark, folder, []
        self.last: dict[tuple[str, str], Entry] = {}
        self.untold: list[Entry] = []
        #: Entries of windows that may not have been reported yet.
        self.open: list[Entry] = []
        self.reported: int | None = None
        #: Of the whole run, so that a report reads nothing.
        self.totals = Totals()
        self._lock = threading.RLock()
        self._recover()

    def _read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).json(f"{self.folder}/rows")

    def _recover(self) -> None:
        """Reads the ledger once, when a run starts or restarts."""
        marks = self._marks()
        if not commit_log.names(self.spark, f"{self.folder}/rows"):
            return
        told, self.reported = marks.get("told"), marks.get("reported")
        for row in self.rows().orderBy("batch").toLocalIterator():
            values = row.asDict()
            counts = {c: values[c] for c in COUNTS if values[c] is not None}
            entry = Entry(row["stage"], row["source"], row["batch"], row["at_ms"], row["files"], counts)
            self.last[entry.stage, entry.source] = entry
            self.totals.add(entry)
            if told is None or entry.batch > told.get(f"{entry.stage}/{entry.source}", -1):
                self.untold.append(entry)
            if self.reported is None or entry.at_ms >= self.reported:
                self.open.append(entry)

    def rows(self) -> DataFrame:
        """All rows, a repeated batch once."""
        keys = ["stage", "source", "batch"]
        rest = [c.split()[0].strip("`") for c in SCHEMA.split(", ") if c.split()[0] not in keys]
        folded = self._read().groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("files", "at_ms")).alias("_r"))
        return folded.select(*keys, "_r.*")

    def empty(self) -> bool:
        return not self.last

    def append(self, entries: list[Entry]) -> None:
        """Writes rows in one file, then counts them as known."""
        with self._lock:
            if entries:
                lines = "".join(e.text() + "\n" for e in entries)
                commit_log.write_text(self.spark, f"{self.folder}/rows/{uuid.uuid4().hex}.json", lines)
                self.untold += entries
                self.open += entries
                for e in entries:
                    self.last[e.stage, e.source] = e
                    self.totals.add(e)

    def catch_up(self) -> list[Entry]:
        """One round: enters the batches that stages have committed since the last."""
        with self._lock:
            found = []
            for stage in self.stages:
                found += stage.news(self.spark, self.last.get((stage.stage, stage.source)))
            self.append(found)
            return found

    def told(self, entries: list[Entry]) -> None:
        """Marks entries as passed on."""
        with self._lock:
            gone = {id(e) for e in entries}
            self.untold = [e for e in self.untold if id(e) not in gone]
            self._mark()

    def report_upto(self, at_ms: int) -> None:
        """Marks windows up to a moment as reported."""
        with self._lock:
            self.reported = at_ms
            self.open = [e for e in self.open if e.at_ms >= at_ms]
            self._mark()

    def _mark(self) -> None:
        waiting: dict[str, int] = {}
        for e in self.untold:
            name = f"{e.stage}/{e.source}"
            waiting[name] = min(e.batch, waiting.get(name, e.batch))
        upto = {f"{s}/{t}": waiting.get(f"{s}/{t}", e.batch + 1) - 1 for (s, t), e in self.last.items()}
        number = max(self._numbers(), default=-1) + 1
        commit_log.write_text(self.spark, f"{self.folder}/marks/{number}", json.dumps({"told": upto, "reported": self.reported}))
        # Only the newest mark counts.
        commit_log.delete(self.spark, f"{self.folder}/marks/{number - 1}")

    def _numbers(self) -> list[int]:
        return [int(n) for n in commit_log.names(self.spark, f"{self.folder}/marks") if n.isdigit()]

    def _marks(self) -> dict:
        number = max(self._numbers(), default=None)
        return {} if number is None else json.loads(commit_log.read_text(self.spark, f"{self.folder}/marks/{number}"))
