"""Runs that can be watched and stopped: jobs by tag, their progress, and the progress of streams."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


@dataclass(frozen=True)
class Progress:
    """Tasks of a run so far: those known, done and failed, and whether any of its jobs is running."""

    tasks: int = 0
    done: int = 0
    failed: int = 0
    running: bool = False

    @property
    def share(self) -> float:
        return self.done / self.tasks if self.tasks else 0.0


class Cancelled(Exception):
    """The run was stopped."""


class Run:
    """A function's Spark jobs under a tag of their own, in a thread: ``progress``, ``cancel``, ``result``.

    A run is stopped by its tag, so other jobs of the session go on. What it was writing is not left behind if it writes by
    ``store.VersionedTable.publish``.
    """

    def __init__(self, spark: SparkSession, work: Callable[[], object]):
        self.spark, self.tag = spark, f"voxloom-{uuid.uuid4().hex}"
        self._work, self._stop = work, threading.Event()
        self._value: object = None
        self._error: BaseException | None = None
        self._thread = InheritableThread(target=self._run, session=spark)

    def start(self) -> Run:
        self._thread.start()
        return self

    def _run(self) -> None:
        sc = self.spark.sparkContext
        sc.addJobTag(self.tag)
        try:
            self._value = self._work()
        except BaseException as e:  # noqa: BLE001  handed to whoever asks for the result
            self._error = e
        finally:
            sc.removeJobTag(self.tag)

    def progress(self) -> Progress:
        """Counts of the tasks of all jobs of the run that Spark still knows."""
        tracker = self.spark.sparkContext._jsc.sc().statusTracker()
        tasks = done = failed = 0
        running = False
        for job in tracker.getJobIdsForTag(self.tag):
            info = tracker.getJobInfo(job)
            if not info.isDefined():
                continue
            running |= info.get().status().toString() == "RUNNING"
            for stage in info.get().stageIds():
                s = tracker.getStageInfo(stage)
                if s.isDefined():
                    tasks, done, failed = tasks + s.get().numTasks(), done + s.get().numCompletedTasks(), failed + s.get().numFailedTasks()
        return Progress(tasks, done, failed, running)

    def cancel(self) -> None:
        """Stop the run's jobs, those that it has not begun too."""
        self._stop.set()
        while self._thread.is_alive():
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
            self._thread.join(0.2)

    def result(self, timeout: float | None = None):
        """What the function gave; ``Cancelled`` if the run was stopped, else the error that it ended with."""
        self._thread.join(timeout)
        if self._thread.is_alive():
            raise TimeoutError("the run has not ended")
        if self._error is not None:
            if self._stop.is_set():
                raise Cancelled(self.tag) from self._error
            raise self._error
        return self._value


class StreamWatch(StreamingQueryListener):
    """The last progress of each stream of a session, by its name, and how it ended."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.ended: dict[str, str | None] = {}
        self._names: dict[str, str] = {}

    def onQueryStarted(self, event):
        self._names[str(event.runId)] = event.name or str(event.id)

    def onQueryProgress(self, event):
        p = event.progress
        name = p.name or str(p.id)
        self.rows[name] = self.rows.get(name, 0) + p.numInputRows
        self.batches[name] = p.batchId

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended[self._names.get(str(event.runId), str(event.id))] = event.exception
