"""The end of a stream, in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sinks.registry import Sink
from ..sinks.spool import save_position


def stop(spark: SparkSession, query: StreamingQuery | None, sink: Sink, folder: str, acknowledge: Callable[[int], None] | None = None) -> int:
    """Stop taking rows, wait for the batch that runs, acknowledge what is applied, keep the position on disk, close the sink. Each step runs
    even if one before it failed, and the first failure is raised at the end. Gives the position."""
    failures: list[BaseException] = []
    position = 0

    def step(run: Callable[[], None]) -> None:
        try:
            run()
        except Exception as error:
            failures.append(error)

    if query is not None:
        step(query.stop)
        step(lambda: query.awaitTermination() and None)
    applied = getattr(sink, "applied", None)
    if applied is not None:

        def look() -> None:
            nonlocal position
            position = applied()[1]

        step(look)
    if position:  # nothing applied is nothing to say
        if acknowledge is not None:
            step(lambda: acknowledge(position))
        step(lambda: save_position(spark, folder, position))
    step(sink.close)
    if failures:
        raise failures[0]
    return position
