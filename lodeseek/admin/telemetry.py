"""Tracing, metrics and logs. All are off unless configured; an off tracer costs one attribute test per call."""

from __future__ import annotations

import functools
import json
import logging
import os
import random
import time
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field
from logging.handlers import RotatingFileHandler

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Parts of key names (in any case) whose values are never logged.
SENSITIVE = ("apiKey", "api_key", "token", "password", "secret", "credentials", "authorization")
_span: ContextVar[Span | None] = ContextVar("span", default=None)


@dataclass
class Span:
    name: str
    trace_id: str
    span_id: str
    attributes: dict = field(default_factory=dict)
    seconds: float = 0.0
    error: str | None = None


@dataclass
class Telemetry:
    enabled: bool = False
    sampling: float = 0.1
    export: Callable[[Span], None] | None = None
    counts: Counter = field(default_factory=Counter)
    values: dict = field(default_factory=lambda: defaultdict(list))
    gauges: dict = field(default_factory=dict)

    @classmethod
    def from_config(cls, config: Mapping, environ: Mapping[str, str] | None = None) -> Telemetry:
        """The environment wins over the file, the file over the defaults."""
        env, section = os.environ if environ is None else environ, config.get("telemetry", {})
        enabled = env.get("LODESEEK_TELEMETRY_ENABLED", str(section.get("enabled", False))).lower() == "true"
        sampling = float(env.get("LODESEEK_TELEMETRY_SAMPLING", section.get("samplingRate", 0.1)))
        if not 0 <= sampling <= 1:
            raise ValueError("the sampling rate must be between 0 and 1")
        kind = env.get("LODESEEK_TELEMETRY_TRACES", (section.get("exporters") or {}).get("traces", "none"))
        return cls(enabled, sampling, exporter(kind))

    @contextmanager
    def span(self, name: str, spark: SparkSession | None = None, **attributes):
        """A traced step; with a session, its Spark jobs carry the step's name and trace id."""
        if not self.enabled or (_span.get() is None and random.random() >= self.sampling):
            yield None
            return
        outer = _span.get()
        own = Span(name, outer.trace_id if outer else uuid.uuid4().hex, uuid.uuid4().hex[:16], {k: truncated(v) for k, v in attributes.items()})
        mark, began = _span.set(own), time.perf_counter()
        if spark is not None:
            spark.sparkContext.setJobDescription(name)
            spark.sparkContext.setLocalProperty("traceparent", traceparent(own))
        try:
            yield own
        except Exception as error:
            own.error = f"{type(error).__name__}: {error}"
            raise
        finally:
            own.seconds = time.perf_counter() - began
            _span.reset(mark)
            if self.export is not None:
                self.export(own)

    def traced(self, name: str, attributes: Callable[..., dict] | None = None):
        def wrap(fn):
            @functools.wraps(fn)
            def run(*args, **kwargs):
                if not self.enabled:
                    return fn(*args, **kwargs)
                with self.span(name, **(attributes(*args, **kwargs) if attributes else {})):
                    return fn(*args, **kwargs)

            return run

        return wrap

    def count(self, name: str, n: int = 1, **labels) -> None:
        if self.enabled:
            self.counts[(name, *sorted(labels.items()))] += n

    def record(self, name: str, value: float) -> None:
        if self.enabled:
            self.values[name].append(value)

    def gauge(self, name: str, value: float) -> None:
        if self.enabled:
            self.gauges[name] = value

    def read(self) -> dict:
        """Counters, histograms (count, sum, least, most) and gauges as they stand."""
        values = {n: {"count": len(v), "sum": sum(v), "min": min(v), "max": max(v)} for n, v in self.values.items() if v}
        return {"counters": {(n if not labels else (n, *labels)): c for (n, *labels), c in self.counts.items()}, "histograms": values, "gauges": dict(self.gauges)}


@dataclass
class Measured:
    df: DataFrame
    values: dict = field(default_factory=dict)


class Metrics:
    """The engine's instruments: three counters, two histograms and three gauges. Without telemetry each call does nothing."""

    REQUESTS, ERRORS, STORE = "lodeseek.requests.total", "lodeseek.requests.errors", "lodeseek.vectordb.operations"
    DURATION, RESULTS = "lodeseek.requests.duration", "lodeseek.search.results"
    FILES, SYMBOLS, MEMORY = "lodeseek.index.files", "lodeseek.index.symbols", "lodeseek.memory.usage"

    def __init__(self, telemetry: Telemetry | None = None, clock: Callable[[], float] = time.monotonic, keep_s: float = 1.0):
        self.telemetry, self._clock, self._keep, self._memory = telemetry, clock, keep_s, (0.0, None)

    @property
    def on(self) -> bool:
        return self.telemetry is not None and self.telemetry.enabled

    def request(self, tool: str) -> None:
        if self.on:
            self.telemetry.count(self.REQUESTS, tool=tool)

    def error(self, tool: str, kind: str) -> None:
        if self.on:
            self.telemetry.count(self.ERRORS, tool=tool, type=kind)

    def store_operation(self, kind: str) -> None:
        if self.on:
            self.telemetry.count(self.STORE, type=kind)

    @contextmanager
    def measured(self, df: DataFrame, name: str, **counts: Column) -> Iterator[Measured]:
        """Counts that executors make while the block runs one action on ``.df``: no pass of their own. They are in ``.values`` at the
        end, and in telemetry as name.<count>. The plan must hold no range exchange above df, since its sampling runs df as well.
        If the block fails nothing is counted."""
        seen = Observation()
        out = Measured(df.observe(seen, *(c.alias(n) for n, c in counts.items())))
        yield out
        out.values = {n: seen.get.get(n) for n in counts}
        for key, value in out.values.items():
            if self.on and value is not None:
                self.telemetry.count(f"{name}.{key}", value)

    def duration(self, ms: float) -> None:
        if self.on:
            self.telemetry.record(self.DURATION, ms)

    def results(self, n: int) -> None:
        if self.on:
            self.telemetry.record(self.RESULTS, n)

    def index(self, files: int, symbols: int) -> None:
        if self.on:
            self.telemetry.gauge(self.FILES, files)
            self.telemetry.gauge(self.SYMBOLS, symbols)

    def memory_mb(self) -> float | None:
        """Of this process; measured anew at most once in keep_s."""
        if not self.on:
            return None
        import resource

        at, value = self._memory
        if value is None or self._clock() - at >= self._keep:
            value = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
            self._memory = (self._clock(), value)
            self.telemetry.gauge(self.MEMORY, value)
        return value


#: The instruments that module-level code uses; they do nothing until setup().
_metrics = Metrics()


def setup(telemetry: Telemetry | None) -> Metrics:
    global _metrics
    _metrics = Metrics(telemetry)
    return _metrics


def metrics() -> Metrics:
    return _metrics


def exporter(kind: str, send: Callable[[dict], None] | None = None) -> Callable[[Span], None] | None:
    """Where finished spans go: none, console (a JSON line to standard error), or otlp through the caller's transport."""
    if kind == "none":
        return None
    if kind == "console":
        import sys

        return lambda span: print(json.dumps(as_dict(span), default=str), file=sys.stderr)
    if kind == "otlp":
        return None if send is None else lambda span: send(as_dict(span))
    raise ValueError(f"exporters are none, console and otlp, not {kind!r}")


def as_dict(span: Span) -> dict:
    return {"name": span.name, "traceId": span.trace_id, "spanId": span.span_id, "seconds": span.seconds, "error": span.error, "attributes": redacted(span.attributes)}


def traceparent(span: Span) -> str:
    return f"00-{span.trace_id}-{span.span_id}-01"


def inject(headers: Mapping[str, str] | None = None) -> dict[str, str]:
    """Headers with the current trace's context, if there is one."""
    own = _span.get()
    return dict(headers or {}) | ({"traceparent": traceparent(own)} if own else {})


def extract(headers: Mapping[str, str]) -> tuple[str, str] | None:
    """(trace id, span id) of a traceparent header; None if there is none or it is malformed."""
    parts = headers.get("traceparent", "").split("-")
    return (parts[1], parts[2]) if len(parts) == 4 and len(parts[1]) == 32 and len(parts[2]) == 16 else None


def truncated(value: object, most: int = 1024) -> str:
    text = value if isinstance(value, str) else json.dumps(redacted(value), default=str)
    return text if len(text) <= most else text[:most] + "..."


def short_stack(text: str, lines: int = 10) -> str:
    return "\n".join(text.splitlines()[:lines])


def redacted(value: object) -> object:
    """A copy in which values of sensitive keys are '***'."""
    if isinstance(value, Mapping):
        return {k: "***" if any(s.lower() in str(k).lower() for s in SENSITIVE) else redacted(v) for k, v in value.items()}
    return [redacted(v) for v in value] if isinstance(value, (list, tuple)) else value


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        row = {"time": self.formatTime(record, "%Y-%m-%dT%H:%M:%S"), "level": record.levelname, "message": record.getMessage()}
        if getattr(record, "data", None) is not None:
            row["data"] = redacted(record.data)
        own = _span.get()
        return json.dumps(row | ({"trace_id": own.trace_id} if own else {}), default=str)


def logger(name: str = "lodeseek", level: int | str = logging.INFO, path: str | None = None, max_bytes: int = 10_000_000, files: int = 5) -> logging.Logger:
    """JSON lines to standard error, and to a file that rotates if a path is given."""
    log = logging.getLogger(name)
    log.setLevel(level)
    log.handlers.clear()
    for handler in [logging.StreamHandler(), *([RotatingFileHandler(path, maxBytes=max_bytes, backupCount=files)] if path else [])]:
        handler.setFormatter(JsonLines())
        log.addHandler(handler)
    log.propagate = False
    return log
