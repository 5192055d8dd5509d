"""Sinks by name. A sink applies one batch at a time, in one transaction, and then runs the hook that stages progress."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame

from ..errors import UnsupportedError

Hook = Callable[[], None]


class Sink(Protocol):
    dialect: str
    takes_events: bool

    def write(self, batch: DataFrame, batch_id: int, hook: Hook | None = None) -> None: ...

    def close(self) -> None: ...


_made: dict[str, Callable[..., Sink]] = {}


def register_sink(name: str, make: Callable[..., Sink]) -> None:
    """make gives a new sink each time it is called."""
    _made[name.lower()] = make


def create_sink(name: str, *args, **settings) -> Sink:
    if (make := _made.get(name.lower())) is None:
        raise UnsupportedError(f"no such sink: {name}")
    return make(*args, **settings)


def for_each_batch(sink: Sink, hook: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """What writeStream.foreachBatch takes."""
    return lambda batch, batch_id: sink.write(batch, batch_id, None if hook is None else lambda: hook(batch_id))
