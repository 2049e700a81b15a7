"""Documents that complete as their pages stream in: state by document, timers for pages that never come.

A page's outcome is an entry of the document's map state, so repeated pages count once and a document of many pages is never one
value. A document ends with its last page, or when the watermark passes ``timeout`` after the event time of its first page; what
comes later finds it ended and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = "doc_id long, status string, n_ok long, n_failed long, n_expected long, errors array<struct<component_type:string,module_name:string,error_message:string>>"


class DocumentAssembler(StatefulProcessor):
    """Counts a document's pages; one result row when it ends."""

    def __init__(self, timeout: timedelta):
        self.wait = int(timeout.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page_no int", "ok boolean, error string")
        self.facts = handle.getValueState("facts", "expected int, n_ok long, n_failed long, due long, ended boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        expected, n_ok, n_failed, due, ended = self.facts.get() or (None, 0, 0, None, False)
        if ended:
            return
        first = None
        for row in rows:
            expected = max(expected or 0, row.page_count) if row.page_count is not None else expected
            at = int(row.ts.timestamp() * 1000) if row.ts is not None else None
            first = at if first is None or at is not None and at < first else first
            if row.page_no is None or self.pages.containsKey((row.page_no,)):
                continue
            ok = bool(row.ok)
            self.pages.updateValue((row.page_no,), (ok, None if ok else row.error))
            n_ok, n_failed = n_ok + ok, n_failed + (not ok)
        if expected is not None and n_ok + n_failed >= expected:
            yield self._result(key, expected, n_ok, n_failed, False)
            self._end(expected, n_ok, n_failed, due)
            return
        if first is not None and (due is None or first + self.wait < due):
            if due is not None:
                self.handle.deleteTimer(due)
            due = first + self.wait
            self.handle.registerTimer(due)
        self.facts.update((expected, n_ok, n_failed, due, False))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        expected, n_ok, n_failed, _, ended = self.facts.get() or (None, 0, 0, None, False)
        if not ended:
            yield self._result(key, expected, n_ok, n_failed, True)
            self._end(expected, n_ok, n_failed, None)

    def _end(self, expected: int | None, n_ok: int, n_failed: int, due: int | None) -> None:
        """Pages go; that the document has ended stays known."""
        if due is not None:
            self.handle.deleteTimer(due)
        self.pages.clear()
        self.facts.update((expected, n_ok, n_failed, None, True))

    def _result(self, key: tuple, expected: int | None, n_ok: int, n_failed: int, timed_out: bool) -> Row:
        bad = {page: error for (page,), (ok, error) in self.pages.iterator() if not ok}
        if timed_out:
            seen = {page for (page,) in self.pages.keys()}
            bad |= {page: "document timeout exceeded" for page in range(1, (expected or 0) + 1) if page not in seen}
        status = "partial_success" if timed_out else "failure" if not n_ok and n_failed else "partial_success" if n_ok < expected else "success"
        errors = [Row(component_type="pipeline", module_name="page", error_message=(f"Page {p}: " if p > 0 else "Unknown page: ") + (bad[p] or "unknown error")) for p in sorted(bad)]
        return Row(doc_id=key[0], status=status, n_ok=n_ok, n_failed=n_failed + (len(bad) - n_failed if timed_out else 0), n_expected=expected or n_ok + n_failed, errors=errors)


def completed_documents(pages: DataFrame, timeout: timedelta, lateness: str = "0 seconds") -> DataFrame:
    """Results of a stream of page outcomes ``(doc_id, page_no, page_count, ok, error, ts)``, one row when a document ends.

    Rows without an id are dropped, and those that are over ``lateness`` older than the newest. Needs the RocksDB state store (``PROVIDER``), which keeps state on disk.
    """
    own = pages.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("page_no").cast("int"), F.col("page_count").cast("int"), "ok", "error", "ts").withWatermark("ts", lateness)
    return own.groupBy("doc_id").transformWithState(DocumentAssembler(timeout), RESULT, "append", "eventTime")
