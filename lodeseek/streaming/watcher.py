"""Watching a source tree: snapshots of its listing are compared, and what changed becomes debounced events.

Stores that Spark reads send no notices of changes, so the tree is listed again and again (names, sizes and times; no
contents). A change is reported once its file has kept still for a while, the first listing only if asked for."""

from __future__ import annotations

import threading
import time
from collections import defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lodeseek.sources import ignore
from lodeseek.sources.scan import walk
from lodeseek.streaming.changes import WATCH_IGNORES

EVENTS = ("added", "changed", "deleted")


@dataclass(frozen=True)
class WatchOptions:
    ignores: Sequence[str] = WATCH_IGNORES
    debounce_s: float = 0.5
    stable_s: float = 0.1
    poll_s: float = 0.1
    ready_s: float = 10.0
    events: Sequence[str] = EVENTS
    ignore_initial: bool = True


def snapshot(spark: SparkSession, root: str, ignores: Sequence[str] = WATCH_IGNORES) -> dict[str, str]:
    """Relative path -> digest of size and time, of the files that no pattern ignores."""
    excluded, pruned = ignore.matcher(ignores, defaults=()), ignore.pruner(ignores, defaults=())
    rows = walk(spark, root, lambda folder: not pruned(folder), [])
    return {rel: f"{size}:{modified}" for _, rel, is_dir, size, modified in rows if not is_dir and not excluded(rel)}


def as_table(spark: SparkSession, found: dict[str, str]) -> DataFrame:
    """(path, digest), as change_set() takes them."""
    return spark.createDataFrame(sorted(found.items()), "path string, digest string")


def differences(before: dict[str, str], after: dict[str, str]) -> list[tuple[str, str]]:
    """(event, path) in order of paths; change_set() says the same of tables."""
    out = [("deleted", p) for p in before if p not in after]
    out += [("added" if p not in before else "changed", p) for p, d in after.items() if before.get(p) != d]
    return sorted(out, key=lambda x: (x[1], x[0]))


@dataclass
class Debouncer:
    """Trailing edge: an event is due once nothing was heard of it for a while."""

    wait_s: float
    last: dict[tuple[str, str], float] = field(default_factory=dict)

    def heard(self, event: str, path: str, now: float) -> None:
        self.last[(event, path)] = now

    def due(self, now: float) -> list[tuple[str, str]]:
        out = [key for key, at in self.last.items() if now - at >= self.wait_s]
        for key in out:
            del self.last[key]
        return out


class Watcher:
    """Calls listeners with (path) for added, changed and deleted, with nothing for ready and with the error for error.

    poll() does one round and may be called by hand; start() does rounds in a thread until stop()."""

    def __init__(self, spark: SparkSession, root: str, options: WatchOptions = WatchOptions(), clock: Callable[[], float] = time.monotonic):
        if not root or not root.strip():
            raise ValueError("a root is required")
        self.spark, self.root, self.options, self._clock = spark, root, options, clock
        self._listeners: dict[str, list[tuple[Callable, bool]]] = defaultdict(list)
        self._seen: dict[str, str] | None = None
        self._moving: dict[str, tuple[str, float]] = {}
        self._debounce = Debouncer(options.debounce_s)
        self._thread: threading.Thread | None = None
        self._stop = threading.Event()

    def on(self, event: str, listener: Callable, once: bool = False) -> Watcher:
        self._listeners[event].append((listener, once))
        return self

    def once(self, event: str, listener: Callable) -> Watcher:
        return self.on(event, listener, True)

    def off(self, event: str, listener: Callable) -> Watcher:
        self._listeners[event] = [x for x in self._listeners[event] if x[0] is not listener]
        return self

    def _emit(self, event: str, *args) -> None:
        for entry in list(self._listeners[event]):
            if entry[1]:
                self._listeners[event].remove(entry)
            entry[0](*args)

    def poll(self) -> list[tuple[str, str]]:
        """Lists the tree, tells the listeners what is due and returns it."""
        now, found = self._clock(), snapshot(self.spark, self.root, self.options.ignores)
        if self._seen is None:
            self._seen = dict(found) if self.options.ignore_initial else {}
            self._emit("ready")
        settled = dict(found)
        for path, digest in found.items():  # a file that is still being written waits
            if self._seen.get(path) == digest:
                self._moving.pop(path, None)
                continue
            known, since = self._moving.get(path, (None, now))
            since = since if known == digest else now
            self._moving[path] = (digest, since)
            if now - since < self.options.stable_s:
                if path in self._seen:
                    settled[path] = self._seen[path]
                else:
                    del settled[path]
            else:
                del self._moving[path]
        for event, path in differences(self._seen, settled):
            if event in self.options.events:
                self._debounce.heard(event, path, now)
        self._seen = settled
        due = self._debounce.due(now)
        for event, path in due:
            self._emit(event, path)
        return due

    def is_watching(self) -> bool:
        return self._thread is not None

    def start(self) -> None:
        """Returns once the first listing is there; raises if that takes too long or fails. Nothing happens if it runs already."""
        if self.is_watching():
            return
        ready, failed = threading.Event(), []
        self._stop.clear()

        def run() -> None:
            while not self._stop.is_set():
                try:
                    self.poll()
                    ready.set()
                except Exception as error:  # noqa: BLE001  the listeners are told; the next round may succeed
                    if not ready.is_set():
                        failed.append(error)
                        ready.set()
                        return
                    self._emit("error", error)
                self._stop.wait(self.options.poll_s)

        thread = threading.Thread(target=run, daemon=True, name="lodeseek-watcher")
        thread.start()
        if not ready.wait(self.options.ready_s):
            self._stop.set()
            raise TimeoutError(f"the first listing of {self.root} took over {self.options.ready_s} s")
        if failed:
            raise failed[0]
        self._thread = thread

    def stop(self) -> None:
        """Ends the rounds; what was not due yet is forgotten."""
        if self._thread is None:
            return
        self._stop.set()
        self._thread.join(self.options.ready_s)
        self._thread = None
        self._debounce.last.clear()
        self._moving.clear()
        self._seen = None
