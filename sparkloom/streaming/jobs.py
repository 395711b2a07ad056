"""Jobs with priorities, retries and cancellation, and events; a small control table on the driver."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from dataclasses import dataclass, field

PRIORITIES = {"process_document": 5, "reembed": 4, "train_semantic": 3, "delete_document": 1}


@dataclass
class Job:
    id: int
    kind: str
    payload: str
    priority: int
    status: str = "pending"
    attempts: int = 0
    max_attempts: int = 3
    run_at: float = 0.0
    progress: int = 0
    last_error: str | None = None


@dataclass
class Jobs:
    """Lower priorities first, then older jobs. The clock is given."""

    clock: Callable[[], float]
    base: int = 2
    most: int = 300
    rows: dict[int, Job] = field(default_factory=dict)
    lock: threading.Lock = field(default_factory=threading.Lock)

    def enqueue(self, kind: str, **payload) -> int:
        with self.lock:
            i = max(self.rows, default=0) + 1
            self.rows[i] = Job(i, kind, json.dumps(payload, sort_keys=True), PRIORITIES[kind])
            return i

    def claim(self) -> Job | None:
        with self.lock:
            ready = [j for j in self.rows.values() if j.status == "pending" and j.run_at <= self.clock()]
            if not ready:
                return None
            job = min(ready, key=lambda j: (j.priority, j.id))
            job.status = "running"
            return job

    def complete(self, job: Job) -> None:
        job.attempts += 1
        job.status, job.progress = "done", 100

    def fail(self, job: Job, error: str) -> bool:
        """Whether the job will be tried again: after base * 2**(attempt - 1) seconds, at most ``most``, until attempts run out."""
        job.attempts += 1
        job.last_error = error
        if job.status == "cancelled":
            return False
        if job.attempts >= job.max_attempts:
            job.status = "failed"
            return False
        job.status, job.run_at = "pending", self.clock() + min(self.base * 2 ** (job.attempts - 1), self.most)
        return True

    def set_progress(self, job_id: int, percent: int) -> None:
        self.rows[job_id].progress = min(max(percent, 0), 100)

    def cancel(self, job_id: int) -> bool:
        job = self.rows.get(job_id)
        if job is None or job.status not in ("pending", "running"):
            return False
        job.status = "cancelled"
        return True

    def cancel_pending(self) -> int:
        return sum(self.cancel(j.id) for j in list(self.rows.values()) if j.status == "pending")

    def cancelled(self, job_id: int) -> bool:
        return self.rows[job_id].status == "cancelled"

    def recover(self) -> int:
        """Running jobs of a process that ended are pending again."""
        lost = [j for j in self.rows.values() if j.status == "running"]
        for j in lost:
            j.status = "pending"
        return len(lost)

    def work(self, handlers: dict[str, Callable[[dict], None]]) -> int:
        """Runs all jobs that are ready; how many it ran."""
        n = 0
        while job := self.claim():
            n += 1
            try:
                handlers[job.kind](json.loads(job.payload))
            except Exception as e:  # noqa: BLE001 - any failure of a handler is a failed attempt
                self.fail(job, f"{type(e).__name__}: {e}")
            else:
                if job.status == "running":
                    self.complete(job)
        return n


class Events:
    """Calls every subscriber with (name, subject, payload); one that raises is dropped."""

    def __init__(self) -> None:
        self.subscribers: list[Callable[[str, int, str], None]] = []

    def subscribe(self, f: Callable[[str, int, str], None]) -> None:
        self.subscribers.append(f)

    def publish(self, name: str, subject: int, payload: str = "") -> None:
        for f in list(self.subscribers):
            try:
                f(name, subject, payload)
            except Exception:  # noqa: BLE001
                self.subscribers.remove(f)
