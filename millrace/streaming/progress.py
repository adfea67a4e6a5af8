"""What a query's progress tells of late rows."""

from __future__ import annotations

import threading

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: Seconds to wait for the last records of a query that has ended.
PATIENCE = 60


class LateRows(StreamingQueryListener):
    """Sums what the batches of a run dropped, as each ends."""

    def __init__(self) -> None:
        self.news = threading.Condition()
        #: By run: rows dropped so far, the last batch that reported, and its own rows.
        self.dropped: dict[str, tuple[int, int, int]] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        with self.news:
            self.dropped.setdefault(str(event.runId), (0, -1, 0))

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        rows = sum(state.numRowsDroppedByWatermark for state in progress.stateOperators)
        with self.news:
            run = str(progress.runId)
            if run in self.dropped:
                total, last, own = self.dropped[run]
                # An idle trigger may report its last batch once more, without rows.
                more = rows if progress.batchId != last else max(rows - own, 0)
                self.dropped[run] = (total + more, progress.batchId, max(rows, own) if progress.batchId == last else rows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.news:
            self.ended.add(str(event.runId))
            self.news.notify_all()


#: One for all sessions: a run is known by its id.
LATE_ROWS = LateRows()
_WATCHED = "_millrace_late_rows"


def watch(spark: SparkSession) -> None:
    """Has the drops of the queries recorded that start in the session from now on."""
    if not getattr(spark, _WATCHED, False):
        spark.streams.addListener(LATE_ROWS)
        setattr(spark, _WATCHED, True)


def dropped_late(query: StreamingQuery) -> int:
    """Rows behind the watermark that event-time operators dropped, over all batches of this run.

    ``event_time.with_watermark`` has the session watched; a query that was not heard to start raises.
    Of a query that still runs, the batches heard of so far count.
    """
    run, late = str(query.runId), LATE_ROWS
    with late.news:
        if run not in late.dropped:
            raise ValueError(f"nobody watched run {run}: call progress.watch before the query starts")
        if not query.isActive and not late.news.wait_for(lambda: run in late.ended, PATIENCE):
            raise TimeoutError(f"the records of run {run} are not complete")
        return late.dropped[run][0]
