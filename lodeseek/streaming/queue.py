"""The update queue as a running thing: requests by path, the best first, one at a time with a pause between.

queue_items() and drain() in changes.py say the same of tables; this class is for the few changes of a watched tree."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Item:
    file_path: str
    project_id: str
    priority: float
    timestamp: float


class UpdateQueue:
    """update(file_path, project_id) is called for each item. An item that fails counts as processed; its error is kept."""

    def __init__(self, update: Callable[[str, str], None], interval_s: float = 0.1, clock: Callable[[], float] = time.time, keep_errors: int = 100):
        self._update, self.interval_s, self._clock, self._keep = update, interval_s, clock, keep_errors
        self._items: dict[str, Item] = {}
        self._lock, self._stop = threading.Lock(), threading.Event()
        self._thread: threading.Thread | None = None
        self.processed = 0
        self.failed: list[tuple[str, str]] = []

    def enqueue(self, file_path: str, project_id: str, priority: float | None = None) -> None:
        """A path that waits already is replaced. Without a priority newer requests come first."""
        now = self._clock()
        with self._lock:
            self._items.pop(file_path, None)
            self._items[file_path] = Item(file_path, project_id, now if priority is None else priority, now)

    def next(self) -> Item | None:
        """The waiting item of the highest priority, of equal ones the newest; it is taken off."""
        with self._lock:
            if not self._items:
                return None
            best = max(self._items.values(), key=lambda x: (x.priority, x.timestamp))
            return self._items.pop(best.file_path)

    def step(self) -> bool:
        """Handles one item; whether there was one."""
        item = self.next()
        if item is None:
            return False
        try:
            self._update(item.file_path, item.project_id)
        except Exception as error:  # noqa: BLE001  one bad file must not end the queue
            self.failed = [*self.failed, (item.file_path, str(error))][-self._keep :]
        self.processed += 1
        return True

    def start(self) -> None:
        """Nothing happens if it runs already."""
        if self._thread is not None:
            return
        self._stop.clear()

        def run() -> None:
            while not self._stop.is_set():
                self.step()
                self._stop.wait(self.interval_s)

        self._thread = threading.Thread(target=run, daemon=True, name="lodeseek-queue")
        self._thread.start()

    def stop(self, wait_s: float = 60.0) -> None:
        """Returns once the item at hand is done; what waits stays."""
        if self._thread is not None:
            self._stop.set()
            self._thread.join(wait_s)
            self._thread = None

    def clear(self) -> None:
        with self._lock:
            self._items.clear()

    def stats(self) -> dict:
        with self._lock:
            return {"queueSize": len(self._items), "isProcessing": self._thread is not None, "processedCount": self.processed, "failedCount": len(self.failed)}
