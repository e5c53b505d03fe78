"""Running analyses: dependency graphs, a job queue and a tree of steps with staleness."""

from __future__ import annotations

import itertools
import threading
from collections import deque
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Task:
    run: Callable[[dict], object]
    after: tuple[str, ...] = ()
    enabled: bool = True


def order(tasks: dict[str, Task]) -> list[str]:
    """Names so that each follows what it depends on; raises on cycles and unknown names."""
    for name, t in tasks.items():
        for a in t.after:
            if a not in tasks:
                raise KeyError(f"{name} depends on {a}, which doesn't exist")
    left = {n: set(t.after) for n, t in tasks.items()}
    out: list[str] = []
    while left:
        free = [n for n, a in left.items() if not a]
        if not free:
            raise ValueError(f"a cycle among {', '.join(sorted(left))}")
        for n in free:
            del left[n]
            out.append(n)
        for a in left.values():
            a.difference_update(free)
    return out


def run_graph(tasks: dict[str, Task], spark: SparkSession | None = None, group: str = "graph", workers: int = 4, cancelled: threading.Event | None = None) -> dict[str, object]:
    """Results by name; independent tasks run at the same time as jobs of one group, disabled ones give None, the first failure cancels the rest."""
    names, done, running = order(tasks), {}, {}

    def call(name: str) -> object:
        if spark is not None:
            spark.sparkContext.setJobGroup(group, name, interruptOnCancel=True)
        return tasks[name].run({a: done[a] for a in tasks[name].after})

    with ThreadPoolExecutor(workers) as pool:
        waiting = deque(names)
        try:
            while waiting or running:
                if cancelled is not None and cancelled.is_set():
                    raise InterruptedError(f"{group} was cancelled")
                for name in list(waiting):
                    if all(a in done for a in tasks[name].after):
                        waiting.remove(name)
                        if tasks[name].enabled:
                            running[pool.submit(call, name)] = name
                        else:
                            done[name] = None
                if running:
                    for f in wait(running, timeout=0.2, return_when=FIRST_COMPLETED).done:
                        done[running.pop(f)] = f.result()
        except BaseException:
            if spark is not None:
                spark.sparkContext.cancelJobGroup(group)
            for f in running:
                f.cancel()
            raise
    return done


@dataclass
class Job:
    number: int
    label: str
    work: Callable[[Callable[[float], None]], object]
    step: int | None = None
    status: str = "queued"
    progress: float = 0.0
    result: object = None
    error: str | None = None


class Queue:
    """Jobs one at a time, in the order they came; statuses queued, running, done, failed, cancelled."""

    def __init__(self, tree: Tree | None = None):
        self.jobs: list[Job] = []
        self.tree = tree
        self._count = itertools.count(1)

    def add(self, label: str, work: Callable, step: int | None = None) -> Job:
        job = Job(next(self._count), label, work, step)
        self.jobs.append(job)
        self._tell(job, "queued")
        return job

    def cancel(self, number: int) -> bool:
        for job in self.jobs:
            if job.number == number and job.status == "queued":
                self._tell(job, "cancelled")
                return True
        return False

    def run_next(self) -> Job | None:
        job = next((j for j in self.jobs if j.status == "queued"), None)
        if job is None:
            return None
        self._tell(job, "running")
        try:
            job.result = job.work(lambda p: setattr(job, "progress", min(1.0, max(job.progress, p))))
            job.progress = 1.0
            self._tell(job, "done")
        except Exception as e:  # a failed job mustn't stop those behind it
            job.error = str(e)
            self._tell(job, "failed")
        return job

    def run_all(self) -> None:
        while self.run_next():
            pass

    def _tell(self, job: Job, status: str) -> None:
        job.status = status
        if self.tree is not None and job.step is not None:
            step = self.tree.steps[job.step]
            step.status, step.error = status, job.error
            if status == "done":
                self.tree.set_result(job.step, job.result)


@dataclass
class Step:
    id: int
    kind: str
    label: str
    params: dict
    parent: int | None
    status: str = "draft"
    result: object = None
    error: str | None = None
    revision: int = 0
    seen: int | None = None  # the parent's revision when the result was made
    made_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))


class Tree:
    """Steps of an analysis; a step is stale if its parent has a newer result than the one it was made from, or is stale itself."""

    def __init__(self):
        self.steps: dict[int, Step] = {}
        self._count = itertools.count(1)

    def create(self, kind: str, label: str = "", params: dict | None = None, parent: int | None = None) -> Step:
        if parent is not None and parent not in self.steps:
            raise KeyError(f"no step {parent}")
        s = Step(next(self._count), kind, label or kind, dict(params or {}), parent)
        self.steps[s.id] = s
        return s

    def set_result(self, step: int, result: object) -> None:
        s = self.steps[step]
        s.result, s.status, s.error = result, "done", None
        s.revision += 1
        s.seen = self.steps[s.parent].revision if s.parent is not None else None

    def is_stale(self, step: int) -> bool:
        s = self.steps[step]
        if s.parent is None:
            return False
        return s.revision > 0 and s.seen != self.steps[s.parent].revision or self.is_stale(s.parent)

    def rearm(self, step: int) -> None:
        s = self.steps[step]
        s.status, s.error = "draft", None

    def children(self, step: int) -> list[int]:
        return [s.id for s in self.steps.values() if s.parent == step]

    def descendants(self, step: int) -> list[int]:
        out = []
        for c in self.children(step):
            out += [c, *self.descendants(c)]
        return out

    def ancestors(self, step: int) -> list[int]:
        out, at = [], self.steps[step].parent
        while at is not None:
            out.append(at)
            at = self.steps[at].parent
        return out

    def delete(self, step: int) -> list[int]:
        gone = [step, *self.descendants(step)]
        for s in gone:
            del self.steps[s]
        return gone

    def nearest(self, step: int, kind: str) -> Step | None:
        """The step itself or the next above of a kind that has a result."""
        return next((self.steps[s] for s in [step, *self.ancestors(step)] if self.steps[s].kind == kind and self.steps[s].result is not None), None)

    def inputs(self, step: int) -> dict[str, object]:
        """For each kind the result of the nearest step above."""
        out: dict[str, object] = {}
        for s in [step, *self.ancestors(step)]:
            if self.steps[s].result is not None:
                out.setdefault(self.steps[s].kind, self.steps[s].result)
        return out

    def lineage(self, step: int) -> str:
        return " › ".join(self.steps[s].label for s in [*reversed(self.ancestors(step)), step])

    def comparable(self, kind: str = "clustering") -> list[int]:
        return [s.id for s in self.steps.values() if s.kind == kind and s.result is not None]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(s.id, s.kind, s.label, s.parent, s.status, s.revision, self.is_stale(s.id)) for s in self.steps.values()]
        return spark.createDataFrame(rows, "id int, kind string, label string, parent int, status string, revision int, stale boolean")


#: What may follow a step of each kind.
NEXT = {
    "source": ("reduction",),
    "reduction": ("clustering", "levels", "dimension-sweep", "displacement"),
    "clustering": ("bridges", "labels", "flow", "bootstrap", "comparison"),
    "levels": ("layer-pick",),
    "layer-pick": ("bridges", "labels", "flow", "bootstrap"),
    "labels": ("scores",),
    "scores": ("export",),
}


def next_steps(tree: Tree, step: int) -> tuple[str, ...]:
    s = tree.steps[step]
    return NEXT.get(s.kind, ()) if s.result is not None and not tree.is_stale(step) else ()
