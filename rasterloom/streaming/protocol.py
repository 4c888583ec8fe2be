"""A worker that takes commands as JSON lines and answers with events: one job at a time.

What a command does is a pure function of the worker's state (``step``), so a log of commands can be
replayed; the ``Worker`` runs what the function asks for. A conversion is refused while anything
runs; a new inspection takes the place of a running one, and of those that wait only the latest
counts. Cancelling interrupts the job's Spark work by its tag and sets a flag that drivers' loops check.
"""

from __future__ import annotations

import json
import os
import resource
import sys
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from datetime import datetime

INSPECT, CONVERT = "inspection", "conversion"
#: Seconds between progress events of a job, and between samples of its performance. Fixed values.
PROGRESS_EVERY, SAMPLE_EVERY = 0.25, 1.0


@dataclass(frozen=True)
class Slot:
    """What runs, and which inspection waits."""

    job: str | None = None
    kind: str | None = None
    stopping: bool = False
    pending: dict | None = None


@dataclass
class Outcome:
    slot: Slot
    events: list[dict] = field(default_factory=list)
    run: dict | None = None  # a command to carry out now
    stop: bool = False  # the running job must end


def event(kind: str, job: str | None = None, **more) -> dict:
    return {"type": kind, **({"job_id": job} if job else {}), **more}


def step(slot: Slot, message: dict) -> Outcome:
    """The worker's next state. ``finished`` is what a job says of itself when it ends."""
    kind, job = message.get("type"), str(message.get("job_id") or "")
    if kind == "ping":
        return Outcome(slot, [event("ready")])
    if kind == "start":
        if slot.job is not None:
            return Outcome(slot, [event("error", slot.job, message="conversion already running")])
        return Outcome(Slot(job, CONVERT), [event("started", job)], message)
    if kind == "inspect":
        if slot.kind == INSPECT:
            return Outcome(replace(slot, stopping=True, pending=message), stop=True)
        if slot.job is not None:
            return Outcome(slot, [event("inspection_error", job, message="worker is busy")])
        return Outcome(Slot(job, INSPECT), [event("inspection_started", job)], message)
    if kind == "cancel":
        if slot.job is None:
            return Outcome(slot, [event("log", job, message="nothing runs")])
        if job and job != slot.job:
            return Outcome(slot, [event("error", job, message="job_id does not match running task")])
        return Outcome(replace(slot, stopping=True), [event("log", slot.job, message="cancel requested")], stop=True)
    if kind == "finished":
        if slot.pending is None:
            return Outcome(Slot())
        return step(Slot(), slot.pending)
    raise ValueError(f"unknown message type: {kind}")


def replayed(messages: Iterable[dict]) -> Iterator[dict]:
    """Events of a log of commands, without running anything."""
    slot = Slot()
    for m in messages:
        try:
            out = step(slot, m)
        except ValueError as e:
            yield event("error", message=str(e))
            continue
        slot = out.slot
        yield from out.events


class Cancelled(Exception):
    """A job noticed that it must end."""


class Throttle:
    """Lets an event pass if enough time went by since the last, or if it is the final one."""

    def __init__(self, every: float = PROGRESS_EVERY, clock: Callable[[], float] = time.monotonic):
        self.every, self.clock, self.last = every, clock, None

    def __call__(self, done: int, total: int) -> bool:
        now = self.clock()
        if done < total and self.last is not None and now - self.last < self.every:
            return False
        self.last = now
        return True


@dataclass(frozen=True)
class Units:
    """Weighted units of a file's work: segments of each level, associated pages, and the tail of writing."""

    segments: tuple[int, ...]
    associated: int = 0
    finalise: bool = False
    validate: bool = False

    @property
    def tail(self) -> int:
        return 1 + self.finalise + self.validate

    @property
    def total(self) -> int:
        return sum(self.segments) + self.associated + self.tail

    def done(self, level: int, segments: int) -> int:
        return sum(self.segments[:level]) + segments


class Job:
    """What a running job is given: its command, and how it reports."""

    def __init__(self, worker: "Worker", message: dict):
        self.worker, self.message, self.id = worker, message, str(message.get("job_id") or "")
        self.payload = message.get("payload", message)
        self.stop = threading.Event()
        self.log_path: str | None = None
        self._pass = Throttle()

    def check(self) -> None:
        if self.stop.is_set():
            raise Cancelled(self.id)

    def emit(self, kind: str, **more) -> None:
        self.worker.emit(event(kind, self.id, **more))

    def progress(self, done: int, total: int, **more) -> None:
        self.check()
        if self._pass(done, total):
            self.emit("progress", done=done, total=total, **more)

    def log_to(self, folder: str) -> None:
        os.makedirs(folder, exist_ok=True)
        self.log_path = os.path.join(folder, f"slides_{datetime.now():%Y%m%d_%H%M%S}.log")

    def log(self, text: str) -> None:
        line = f"[{datetime.now():%H:%M:%S}] {text}"
        if self.log_path:
            with open(self.log_path, "a", encoding="utf-8") as f:
                f.write(line + "\n")
        self.emit("log", message=line)


class Worker:
    """Runs jobs of two kinds, one at a time, each in a thread of its own."""

    def __init__(self, inspect: Callable[[Job], dict], convert: Callable[[Job], dict], *, out=None, spark=None, sample_every: float = SAMPLE_EVERY):
        self.work = {INSPECT: inspect, CONVERT: convert}
        self.out, self.spark, self.sample_every = out or sys.stdout, spark, sample_every
        self.slot, self.job, self.thread = Slot(), None, None
        self.lock, self.writing = threading.RLock(), threading.Lock()

    def emit(self, what: dict) -> None:
        with self.writing:
            print(json.dumps(what, ensure_ascii=False, default=str), file=self.out, flush=True)

    def handle(self, message: dict) -> None:
        with self.lock:
            out = step(self.slot, message)
            self.slot = out.slot
            for e in out.events:
                self.emit(e)
            if out.stop and self.job is not None:
                self.job.stop.set()
                if self.spark is not None:
                    self.spark.interruptTag(f"job-{self.job.id}")
            if out.run is not None:
                self.job = Job(self, out.run)
                self.thread = threading.Thread(target=self._run, args=(self.job, self.slot.kind), daemon=True)
                self.thread.start()

    def _samples(self, job: Job, ended: threading.Event) -> None:
        before, at = resource.getrusage(resource.RUSAGE_SELF), time.monotonic()
        while not ended.wait(self.sample_every):
            now, t = resource.getrusage(resource.RUSAGE_SELF), time.monotonic()
            busy = now.ru_utime + now.ru_stime - before.ru_utime - before.ru_stime
            job.emit("performance", memory_mb=round(now.ru_maxrss / 1024, 1), cpu_percent=round(100 * busy / (t - at), 1))
            before, at = now, t

    def _run(self, job: Job, kind: str) -> None:
        ended = threading.Event()
        sampler = threading.Thread(target=self._samples, args=(job, ended), daemon=True)
        sampler.start()
        tag = f"job-{job.id}"
        done, failed = ("inspection_done", "inspection_error") if kind == INSPECT else ("done", "error")
        try:
            if self.spark is not None:
                self.spark.addTag(tag)
            last = event(done, job.id, **self.work[kind](job))
        except Exception as e:
            stopped = isinstance(e, Cancelled) or job.stop.is_set()
            last = event("cancelled", job.id) if stopped else event(failed, job.id, message=str(e), code=getattr(e, "code", None), stage=getattr(e, "stage", None))
        finally:
            if self.spark is not None:
                self.spark.removeTag(tag)
            ended.set()
            sampler.join(timeout=2)
        with self.lock:
            # a replaced inspection says nothing more
            if not (last["type"] == "cancelled" and self.slot.pending is not None):
                self.emit(last)
            self.job = None
            self.handle({"type": "finished"})

    def serve(self, lines: Iterable[str]) -> None:
        self.emit(event("ready"))
        for line in lines:
            if not line.strip():
                continue
            message = {}
            try:
                parsed = json.loads(line)
                if not isinstance(parsed, dict):
                    raise ValueError("a message must be a JSON object")
                message = parsed
                self.handle(message)
            except Exception as e:
                self.emit(event("inspection_error" if message.get("type") == "inspect" else "error", message.get("job_id"), message=str(e)))
        while (t := self.thread) is not None and t.is_alive():
            t.join()


def spark_worker(spark, **more) -> Worker:
    """A worker whose inspections run on Spark; conversions take a converter by name from the command."""
    from ..plans.batch import inspect_inputs, output_subfolder

    def inspect(job: Job) -> dict:
        folder = job.payload.get("input_dir", "")
        if not os.path.isdir(folder):
            raise ValueError(f"invalid input_dir: {folder}")
        rows = inspect_inputs(spark, folder, recursive=bool(job.payload.get("recursive", True))).orderBy("idx").collect()  # a row for each file of one folder
        for i, r in enumerate(rows, 1):
            job.progress(i, len(rows), current=r["path"])
        return {"files": [r.asDict() for r in rows]}

    def convert(job: Job) -> dict:
        from ..plans.convert import convert_slides

        folder, out = job.payload.get("input_dir", ""), job.payload.get("output_dir", "")
        if not os.path.isdir(folder):
            raise ValueError(f"invalid input_dir: {folder}")
        out = output_subfolder(out) if job.payload.get("output_to_new_subfolder") else out
        job.log_to(out)
        job.emit("output_dir", path=out)
        results = convert_slides(spark, folder, out, job.payload.get("output_format", "ome_tiff"), check=job.check, log=job.log)
        return {"results": [r.asDict() for r in results.collect()]}

    return Worker(inspect, convert, spark=spark, **more)
