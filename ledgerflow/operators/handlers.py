"""Running job handlers over a claimed batch, with middleware and lifecycle hooks."""

from __future__ import annotations

import functools
import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Handler = Callable[[dict], object]


class Registry:
    """Handlers by name and version; registering a version again replaces it, and version 0 means the newest."""

    def __init__(self):
        self._handlers: dict[str, dict[int, Handler]] = {}

    def register(self, name: str, version: int = 1) -> Callable[[Handler], Handler]:
        def add(f: Handler) -> Handler:
            self._handlers.setdefault(name, {})[version] = f
            return f

        return add

    def get(self, name: str, version: int = 0) -> Handler:
        versions = self._handlers[name]
        return versions[version if version > 0 else max(versions)]

    def names(self) -> list[str]:
        return sorted(self._handlers)

    def newest(self) -> dict[str, Handler]:
        return {name: self.get(name) for name in self._handlers}


def compose(handler: Handler, *middleware: Callable[[Handler], Handler]) -> Handler:
    """The first middleware is outermost."""
    return functools.reduce(lambda inner, wrap: wrap(inner), reversed(middleware), handler)


def recover(name: str) -> Callable[[Handler], Handler]:
    """An exception becomes an error that names the job."""

    def wrap(inner: Handler) -> Handler:
        def run(payload: dict) -> object:
            try:
                return inner(payload)
            except Exception as e:
                raise RuntimeError(f"panic in job {name}: {e}") from e

        return run

    return wrap


def execute(claimed: DataFrame, handlers: dict[str, Handler], *middleware: Callable[[str], Callable[[Handler], Handler]]) -> DataFrame:
    """(id, name, ok, error, elapsed_ms, result) of each claimed job (id, name, payload as JSON).

    A job without a handler fails with an error that says so; the engine this follows left such jobs
    running for the reaper, forever."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = {name: compose(f, *(m(name) for m in middleware)) for name, f in handlers.items()}
        for pdf in batches:
            rows = []
            for id_, name, payload in zip(pdf["id"], pdf["name"], pdf["payload"], strict=True):
                began, error, result = time.perf_counter(), None, None
                try:
                    if name not in ready:
                        raise LookupError(f"no handler for {name}")
                    result = json.dumps(ready[name](json.loads(payload or "{}")))
                except Exception as e:  # noqa: BLE001  a handler may raise anything
                    error = str(e)
                rows.append((id_, name, error is None, error, int((time.perf_counter() - began) * 1000), result))
            yield pd.DataFrame(rows, columns=["id", "name", "ok", "error", "elapsed_ms", "result"])

    return claimed.select("id", "name", "payload").mapInPandas(run, "id string, name string, ok boolean, error string, elapsed_ms bigint, result string")


class Hooks:
    """Callbacks by event type, in order of registration. Their errors are kept, never passed on."""

    def __init__(self):
        self._hooks: list[tuple[str, Callable]] = []
        self.errors: list[tuple[str, Exception]] = []

    def on(self, kind: str, f: Callable) -> None:
        self._hooks.append((kind, f))

    def emit(self, kind: str, *args) -> None:
        for wanted, f in self._hooks:
            if wanted in (kind, "*"):
                try:
                    f(*args)
                except Exception as e:  # noqa: BLE001
                    self.errors.append((kind, e))

    def for_each_batch(self) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch: every hook gets its type's rows as a DataFrame, on the driver's schedule."""

        def run(batch: DataFrame, number: int) -> None:
            for kind in dict.fromkeys(k for k, _ in self._hooks):
                rows = batch if kind == "*" else batch.where(batch["type"] == kind)
                self.emit(kind, rows, number)

        return run


def new_id(prefix: str) -> str:
    """prefix_ and a time-ordered unique suffix, so ids sort by creation."""
    stamp = int(time.time() * 1000)
    return f"{prefix}_{stamp:012x}{uuid.uuid4().hex[:20]}"


def parse_id(text: str, prefix: str | None = None) -> tuple[str, str]:
    """(prefix, suffix); ValueError if it isn't an id, or one of another prefix."""
    found, _, suffix = text.rpartition("_")
    if not found or not suffix or prefix is not None and found != prefix:
        raise ValueError(f"not an id of {prefix or 'any kind'}: {text!r}")
    return found, suffix


def pretty_json(text: str) -> str:
    """Indented JSON; text that isn't JSON as it is."""
    try:
        return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    except ValueError:
        return text
