"""Job control on Spark's own scheduler: submit, status, cancel, priorities, cluster status.

A job is a function of a session, run in a thread under a Spark tag; its pool gives it a share of the cluster by
priority (the session's builder installs the pools). A check runs before the job is accepted; listing the input is a state of its own.
With a folder the states are also written to files, so that other processes can read them and ask for a cancel. Retries, speculation, locality and lost-output recovery are Spark's (see tessera.session).
"""

from __future__ import annotations

import json
import time
import traceback
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from pathlib import Path
from threading import Lock
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from tessera.session import PRIORITIES

DEFAULT_PRIORITY = 3


class Status(Enum):
    UNKNOWN = "UNKNOWN"
    SPLITTING_INPUT = "SPLITTING_INPUT"
    IN_QUEUE = "IN_QUEUE"
    IN_PROGRESS = "IN_PROGRESS"
    DONE = "DONE"
    FAILED = "FAILED"
    CANCELLED = "CANCELLED"


FINAL = (Status.DONE, Status.FAILED, Status.CANCELLED)


@dataclass
class Job:
    """One submitted job; times are epoch seconds, None until reached."""

    name: str
    client: str
    priority: int
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    status: Status = Status.IN_QUEUE
    queued: float = field(default_factory=time.time)
    started: float | None = None
    done: float | None = None
    result: Any = None
    error: str = ""


class Jobs:
    """The jobs of one session."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = Path(folder) if folder else None
        self.jobs: dict[str, Job] = {}
        self.threads: dict[str, InheritableThread] = {}
        self.lock = Lock()

    def submit(self, name: str, run: Callable[[SparkSession], Any], client: str = "", priority: int = DEFAULT_PRIORITY, check: Callable[[], Any] | None = None) -> str:
        """Starts a job and returns its id at once. What ``check`` raises refuses the job."""
        if priority not in PRIORITIES:
            raise ValueError("priorities go from 1 to 10")
        job = Job(name, client, priority)
        if check:
            job.status = Status.SPLITTING_INPUT
            check()
            job.status = Status.IN_QUEUE
        thread = InheritableThread(target=self._run, args=(job, run), daemon=True)
        with self.lock:
            self.jobs[job.id] = job
            self.threads[job.id] = thread
        self._note(job)
        thread.start()
        return job.id

    def _note(self, job: Job) -> None:
        """Writes a job's state for other processes."""
        if self.folder:
            self.folder.mkdir(parents=True, exist_ok=True)
            state = {k: getattr(job, k) for k in ("id", "name", "client", "priority", "queued", "started", "done", "error")} | {"status": job.status.value}
            part = self.folder / f"{job.id}.part"
            part.write_text(json.dumps(state))
            part.replace(self.folder / f"{job.id}.json")

    def _run(self, job: Job, run: Callable[[SparkSession], Any]) -> None:
        # tagged before the state says so: a cancel then finds what it has to stop
        self.spark.sparkContext.addJobTag(job.id)
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"priority-{job.priority}")
        with self.lock:
            if job.status is Status.CANCELLED:
                return
            job.status, job.started = Status.IN_PROGRESS, time.time()
        self._note(job)
        try:
            result, status, error = run(self.spark), Status.DONE, ""
        except Exception:
            result, status, error = None, Status.FAILED, traceback.format_exc()
        finally:
            self.spark.sparkContext.removeJobTag(job.id)
        with self.lock:
            job.done = time.time()
            if job.status is not Status.CANCELLED:
                job.status, job.result, job.error = status, result, error
        self._note(job)

    def status(self, job_id: str) -> Status:
        with self.lock:
            return self.jobs[job_id].status if job_id in self.jobs else Status.UNKNOWN

    def of_client(self, client: str) -> list[Job]:
        """A client's jobs, the latest first."""
        with self.lock:
            return sorted((j for j in self.jobs.values() if j.client == client), key=lambda j: -j.queued)

    def cancel(self, job_id: str | None = None, client: str | None = None) -> bool:
        """Cancels a job, or a client's latest one; False when it has ended or is not known."""
        if job_id is None:
            own = self.of_client(client or "")
            if not own:
                return False
            job_id = own[0].id
        with self.lock:
            job = self.jobs.get(job_id)
            if job is None or job.status in FINAL:
                return False
            job.status = Status.CANCELLED
        self._note(job)
        self.spark.sparkContext.cancelJobsWithTag(job_id)
        return True

    def wait(self, job_id: str, timeout: float | None = None) -> Status:
        """Waits for a job; a cancel that another process asked for is carried out meanwhile."""
        until = time.time() + timeout if timeout is not None else None
        while self.threads[job_id].is_alive() and (until is None or time.time() < until):
            self.threads[job_id].join(0.2)
            if self.folder and (self.folder / f"{job_id}.cancel").exists():
                self.cancel(job_id)
        return self.status(job_id)

    def cluster(self) -> dict[str, int]:
        """Executors besides the driver, running stages and waiting jobs."""
        sc = self.spark.sparkContext
        tracker = sc.statusTracker()
        with self.lock:
            waiting = sum(j.status is Status.IN_QUEUE for j in self.jobs.values())
        return {
            "executors": max(0, sc._jsc.sc().getExecutorMemoryStatus().size() - 1),
            "running_stages": len(tracker.getActiveStageIds()),
            "waiting_jobs": waiting,
        }


def noted(folder: str, client: str | None = None) -> list[dict[str, Any]]:
    """The states that job processes wrote into a folder, the latest first."""
    found = [json.loads(p.read_text()) for p in Path(folder).glob("*.json")]
    return sorted((j for j in found if client is None or j["client"] == client), key=lambda j: -j["queued"])


def ask_cancel(folder: str, job_id: str | None = None, client: str | None = None) -> str | None:
    """Asks the process of a job, or of a client's latest one, to cancel it; returns the id, None when it has ended."""
    for j in noted(folder, client):
        if job_id in (None, j["id"]):
            if Status(j["status"]) in FINAL:
                return None
            (Path(folder) / f"{j['id']}.cancel").touch()
            return j["id"]
    return None
