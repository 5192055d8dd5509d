"""Streams that start again after errors that may pass."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql.streaming import StreamingQuery

from ..errors import backoff_seconds, is_transient

log = logging.getLogger(__name__)
#: Words in a stream's error that tell of a connection. Fixed values.
SIGNS = ("ConnectionLost", "ConnectionError", "TimeoutError", "Connection refused", "Connection reset")


def may_pass(error: BaseException) -> bool:
    return is_transient(error) or (isinstance(error, StreamingQueryException) and any(s in str(error) for s in SIGNS))


def run(start: Callable[[], StreamingQuery], most: int = 10, wait: Callable[[float], None] = time.sleep) -> None:
    """Start a stream and wait for its end; on an error that may pass, start again from its checkpoint after a wait that
    doubles. Other errors, and the last try's, are raised."""
    for attempt in range(most + 1):
        try:
            start().awaitTermination()
            return
        except Exception as error:
            if attempt == most or not may_pass(error):
                raise
            log.warning("trying again after %s", error)
            wait(backoff_seconds(attempt))
