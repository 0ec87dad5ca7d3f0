"""Several runs in one Spark session, each with a name: started side by side, watched, cancelled alone."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class Run:
    """A function that works in its own thread; all jobs it starts carry its tag."""

    def __init__(self, spark: SparkSession, name: str, work: Callable[[], Any]):
        self.spark, self.name, self.tag = spark, name, f"run-{name}"
        self.result: Any = None
        self.error: BaseException | None = None
        self.cancelled = False

        def target() -> None:
            spark.sparkContext.addJobTag(self.tag)
            try:
                self.result = work()
            except BaseException as e:  # told by the run's state, not by its thread
                self.error = e
            finally:
                spark.sparkContext.removeJobTag(self.tag)

        self.thread = InheritableThread(target=target, daemon=True)
        self.thread.start()

    @property
    def state(self) -> str:
        """'running', 'cancelled', 'failed' or 'done'."""
        if self.thread.is_alive():
            return "running"
        return ("cancelled" if self.cancelled else "failed") if self.error else "done"

    def progress(self) -> dict[str, int]:
        """Jobs, tasks and tasks done of all that the run has started and Spark still knows."""
        tracker = self.spark.sparkContext.statusTracker()
        jobs = list(self.spark.sparkContext._jsc.sc().statusTracker().getJobIdsForTag(self.tag))
        stages = {s for j in jobs if (info := tracker.getJobInfo(j)) for s in info.stageIds}
        known = [x for s in stages if (x := tracker.getStageInfo(s))]
        return {"jobs": len(jobs), "tasks": sum(x.numTasks for x in known), "done": sum(x.numCompletedTasks for x in known)}

    def cancel(self) -> None:
        """Ends the run's jobs, and no other's; jobs that it would start later fail as well, as its work has been broken off."""
        self.cancelled = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def join(self, seconds: float | None = None) -> str:
        self.thread.join(seconds)
        return self.state
