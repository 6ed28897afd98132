"""Requests: a query that runs beside its caller, with status, waiting, cancelling and a completion callback."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor, TimeoutError

import pyarrow as pa
from pyspark.sql import DataFrame

PENDING, COMPLETED, CANCELED, FAILED = "pending", "completed", "canceled", "failed"

_pool = ThreadPoolExecutor(16, thread_name_prefix="lattica-request")


class Request:
    """Runs df to an Arrow table under a tag of its own, so that cancelling interrupts its jobs only."""

    def __init__(self, df: DataFrame, on_done: Callable[[Request], None] | None = None):
        self.tag, self._session, self._canceled = f"lattica-{uuid.uuid4().hex}", df.sparkSession, threading.Event()
        self._future: Future[pa.Table] = _pool.submit(self._run, df)
        if on_done:
            self._future.add_done_callback(lambda _: on_done(self))

    def _run(self, df: DataFrame) -> pa.Table:
        if self._canceled.is_set():
            raise RuntimeError("canceled")
        context = self._session.sparkContext
        context.addJobTag(self.tag)
        try:
            return df.toArrow()
        finally:
            context.removeJobTag(self.tag)

    @property
    def status(self) -> str:
        if self._canceled.is_set():
            return CANCELED
        if not self._future.done():
            return PENDING
        return FAILED if self._future.exception() else COMPLETED

    @property
    def completion(self) -> int:
        """0 or 1."""
        return int(self.status == COMPLETED)

    def wait(self, timeout: float | None = None) -> str:
        try:
            self._future.exception(timeout)
        except TimeoutError:
            pass
        return self.status

    def cancel(self) -> None:
        if not self._future.done():
            self._canceled.set()
            self._session.sparkContext.cancelJobsWithTag(self.tag)

    @property
    def error(self) -> str | None:
        return str(self._future.exception()) if self.status == FAILED else None

    def result(self) -> pa.Table:
        if self._canceled.is_set():
            raise RuntimeError("the request was canceled")
        return self._future.result()

    def copy_into(self, column: str, buffer: memoryview) -> int:
        """A column's values as bytes into a buffer, which must be long enough; returns their number."""
        data = self.result().column(column).to_numpy().tobytes()
        if len(buffer) < len(data):
            raise ValueError(f"{column} has {len(data)} bytes, the buffer {len(buffer)}")
        buffer[: len(data)] = data
        return len(data)
