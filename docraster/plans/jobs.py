"""One background job at a time: started beside the caller, told about, and cancelled by its Spark job tag.

A job is a list of steps. What a finished step has written stays; cancelling stops the running step's Spark jobs and no
further step begins. Progress is the finished steps, and of the running one the finished tasks among all that Spark knows
of by now.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class Busy(RuntimeError):
    pass


class Jobs:
    """state: idle, running, done, cancelled or failed; results are those of the steps that are through."""

    def __init__(self, spark: SparkSession):
        self.spark, self.sc = spark, spark.sparkContext
        self.name = self.error = None
        self.state, self.results, self.steps = "idle", [], []
        self._thread = self._tag = None
        self._stop = False

    def start(self, name: str, steps: Sequence[tuple[str, Callable[[], object]]]) -> None:
        """Refused while another job runs."""
        if self._thread is not None and self._thread.is_alive():
            raise Busy("Another background job is already running.")
        self.name, self.steps, self.results, self.error = name, list(steps), [], None
        self.state, self._stop, self._tag = "running", False, f"docraster-{uuid.uuid4().hex}"
        self._thread = InheritableThread(target=self._run, session=self.spark)
        self._thread.daemon = True
        self._thread.start()

    def _run(self) -> None:
        self.sc.setJobGroup(self._tag, self.name, interruptOnCancel=True)  # the tracker knows jobs by group
        self.sc.addJobTag(self._tag)
        try:
            for _, step in self.steps:
                if self._stop:
                    break
                self.results.append(step())
            self.state = "cancelled" if self._stop and len(self.results) < len(self.steps) else "done"
        except Exception as why:  # whatever a step raises is what the job has to tell
            self.state, self.error = ("cancelled", None) if self._stop else ("failed", str(why))
        finally:
            self.sc.removeJobTag(self._tag)

    def cancel(self) -> bool:
        """Asks the running job to stop; False if there is none."""
        if self._thread is None or not self._thread.is_alive():
            return False
        self._stop = True
        self.sc.cancelJobsWithTag(self._tag)
        return True

    def wait(self, seconds: float | None = None) -> str:
        if self._thread is not None:
            self._thread.join(seconds)
        return self.state

    def percent(self) -> int:
        if not self.steps:
            return 0
        tracker, done, tasks = self.sc.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(self._tag):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info and info.status == "RUNNING" else ():
                if s := tracker.getStageInfo(stage):
                    done, tasks = done + s.numCompletedTasks, tasks + s.numTasks
        part = done / tasks if self.state == "running" and tasks else 0.0
        return min(100, int(100 * (len(self.results) + part) / len(self.steps)))

    def status(self) -> str:
        """One line: the job, its step and how far it is."""
        if self.state == "idle":
            return "No running job."
        if self.state == "running":
            step = self.steps[min(len(self.results), len(self.steps) - 1)][0]
            return " | ".join((self.name, "Cancellation requested..." if self._stop else step, f"{self.percent()}%"))
        return f"{self.name}: {self.state}" + (f" | {self.error}" if self.error else "")
