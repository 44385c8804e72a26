"""Session logs as streams, folded with state: whatever order operations arrive in, each session ends as its log says.

A session's operations are numbered without gaps. One that comes early is held in a map, by number, until those before
it have come; then all that are due are applied to the list of live pages. With an event time a timer gives a missing
operation up once the watermark has passed by ``patience``: the held ones go on without it, and if it does come, it is
late: it changes nothing, is counted, and is told in a row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docraster.operators.session import Fold

#: ``version`` is the number of the last operation that is applied; a session without pages is one row without an entry.
PAGES = "session_id long, version long, entry_id string, pos long, name string, selected boolean, held long, late long, late_op_seq long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Session(StatefulProcessor):
    def __init__(self, first: int, patience_ms: int | None):
        self.first, self.patience = first, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.about = handle.getValueState("about", "next long, late long, timer long")
        self.held = handle.getMapState("held", "op_seq long", "op string, arg int")
        self.live = handle.getListState("live", "entry_id string, name string, selected boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        due, late, timer = self.about.get() if self.about.exists() else (self.first, 0, 0)
        passed = []
        for row in rows:
            if row.op_seq < due:
                passed.append(row.op_seq)
            else:  # the same operation once more replaces itself
                self.held.updateValue((row.op_seq,), (row.op, row.arg))
        late += len(passed)
        now = self.apply(key[0], due, False)
        due = now[1]
        waiting = self.held.exists()
        if timer and not waiting:
            self.handle.deleteTimer(timer)
            timer = 0
        if waiting and not timer and self.patience is not None:
            timer = max(1, timerValues.getCurrentWatermarkInMs() + self.patience)
            self.handle.registerTimer(timer)
        self.about.update((due, late, timer))
        yield from self.shown(key[0], *now, late)
        for seq in passed:
            yield Row(session_id=key[0], version=due - 1, entry_id=None, pos=None, name=None, selected=None, held=None, late=late, late_op_seq=seq)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due, late, _ = self.about.get()
        now = self.apply(key[0], due, True)
        self.about.update((now[1], late, 0))
        yield from self.shown(key[0], *now, late)

    def apply(self, session_id: int, due: int, skip: bool) -> tuple[Fold, int, int]:
        """Applies what is held and due, or with ``skip`` all that is held; the pages, the next number due, and what is left."""
        pages = Fold(session_id, [list(p) for p in self.live.get()] if self.live.exists() else [])
        waiting = sorted(k[0] for k in self.held.keys()) if self.held.exists() else []
        left = len(waiting)
        for seq in waiting:
            if seq > due and not skip:
                break
            op, arg = self.held.getValue((seq,))
            pages.apply(seq, op, arg)
            self.held.removeKey((seq,))
            due, left = seq + 1, left - 1
        if left < len(waiting):
            self.live.put([(e, n, bool(s)) for e, n, s in pages.rows]) if pages.rows else self.live.clear()
        return pages, due, left

    def shown(self, session_id: int, pages: Fold, due: int, left: int, late: int) -> Iterator[Row]:
        rows = [p[1:] for p in pages.pages()] or [(None, None, None, None)]
        for entry, pos, name, selected in rows:
            yield Row(session_id=session_id, version=due - 1, entry_id=entry, pos=pos, name=name, selected=selected, held=left, late=late, late_op_seq=None)

    def close(self) -> None:
        pass


def session_stream(log: DataFrame, first: int = 0, at: str | None = None, patience: str = "10 minutes") -> DataFrame:
    """Each session's pages after every batch of its log (session_id, op_seq, op, arg), whose numbers start at ``first``.

    With ``at``, a column of event times, a gap is given up ``patience`` after the watermark at which it was seen.
    """
    spark = log.sparkSession
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    columns = ["session_id", "op_seq", "op", "arg"]
    if at is None:
        return log.select(*columns).groupBy("session_id").transformWithState(Session(first, None), PAGES, "Update", "None")
    wait = spark.sql(f"SELECT unix_millis(timestamp'1970-01-01 00:00:00Z' + INTERVAL {patience}) AS ms").first()["ms"]
    timed = log.select(*columns, at).withWatermark(at, "0 seconds")
    return timed.groupBy("session_id").transformWithState(Session(first, wait), PAGES, "Update", "EventTime")
