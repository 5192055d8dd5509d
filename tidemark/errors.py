"""What can go wrong, and whether trying again may help."""

from __future__ import annotations

from pyspark.sql import Column


class ChangelogError(Exception):
    """Base of all errors; permanent unless a subclass says otherwise."""

    transient = False


class ConfigError(ChangelogError):
    """Settings that can't work."""


class UnsupportedError(ChangelogError):
    """An operation or sink that isn't there."""


class DataError(ChangelogError):
    """A row or file that can't be read as it should."""


class SinkError(ChangelogError):
    """A write that failed."""


class ConnectionLost(SinkError):
    """A connection that failed; worth another try."""

    transient = True


class Cancelled(ChangelogError):
    """Work that was stopped on request; neither a failure nor worth a retry by itself."""


def is_transient(error: BaseException) -> bool:
    return getattr(error, "transient", False) or isinstance(error, (ConnectionError, TimeoutError))


def backoff(attempt: Column) -> Column:
    """backoff_seconds for a column of attempts."""
    from pyspark.sql import functions as F

    return F.least(F.pow(F.lit(2.0), attempt), F.lit(30.0))


def backoff_seconds(attempt: int) -> float:
    """Doubling waits, half a minute at most."""
    return float(min(2**attempt, 30))
