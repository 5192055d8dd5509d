"""Settings: from code or from the environment, checked before anything runs."""

from __future__ import annotations

import logging
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from .errors import ConfigError

log = logging.getLogger(__name__)
DESTINATIONS = ("mysql", "sqlserver", "sqlite", "kafka")
SLOT_NAME = re.compile(r"[a-z0-9_]+")


@dataclass
class Config:
    source: str = ""
    destination: str = ""
    destination_type: str = "mysql"
    slot: str = "cdc_slot"
    publication: str = "cdc_pub"
    protocol_version: int = 2
    streaming: bool = True
    two_phase: bool = False
    binary_format: bool = False
    connection_timeout: int = 30
    query_timeout: int = 10
    schema_mappings: dict[str, str] = field(default_factory=dict)
    key_columns: dict[str, list[str]] = field(default_factory=dict)
    buffer_size: int = 1000
    batch_size: int = 1000
    segment_bytes: int = 64 << 20
    bulk_threshold: int = 500
    max_rows_per_insert: int = 0
    spool_path: str = "."
    origin: str | None = None

    def validate(self) -> Config:
        problems = (
            (not self.source, "no source to read from"),
            (not self.destination, "no destination to write to"),
            (not valid_slot_name(self.slot), f"a slot's name has a-z, 0-9 and _ only, not {self.slot!r}"),
            (not self.publication, "no publication named"),
            (not 1 <= self.protocol_version <= 4, f"there are protocols 1 to 4, not {self.protocol_version}"),
            (self.streaming and self.protocol_version < 2, "transactions are streamed from protocol 2 on"),
            (self.two_phase and self.protocol_version < 3, "two phases are there from protocol 3 on"),
            (self.buffer_size <= 0, "the buffer must hold a row at least"),
        )
        for wrong, what in problems:
            if wrong:
                raise ConfigError(what)
        return self

    def __repr__(self) -> str:
        return f"Config({self.destination_type}, {mask(self.source)} -> {mask(self.destination)}, slot {self.slot})"


def valid_slot_name(name: str) -> bool:
    return SLOT_NAME.fullmatch(name) is not None


def parse_bool(text: str) -> bool:
    low = text.strip().lower()
    if low in ("true", "1", "yes", "on"):
        return True
    if low in ("false", "0", "no", "off"):
        return False
    raise ConfigError(f"not a boolean: {text!r}")


def parse_int(text: str, most: int = 2**64 - 1) -> int:
    if not re.fullmatch(r"\+?[0-9]+", text.strip()) or int(text) > most:
        raise ConfigError(f"not a number from 0 to {most}: {text!r}")
    return int(text)


def parse_schema_mappings(text: str) -> dict[str, str]:
    """a:b,c:d"""
    out = {}
    for pair in filter(None, (p.strip() for p in text.split(","))):
        source, colon, target = (x.strip() for x in pair.partition(":"))
        if not colon or not source or not target:
            raise ConfigError(f"{pair!r} doesn't map a schema to a schema (from:to)")
        out[source] = target
    return out


def parse_key_columns(text: str) -> dict[str, list[str]]:
    """schema.table:column,column;..."""
    out = {}
    for entry in filter(None, (e.strip() for e in text.split(";"))):
        table, _, columns = entry.partition(":")
        found = [c for c in (c.strip() for c in columns.split(",")) if c]
        if table.strip() and found:
            out[table.strip()] = found
    return out


def mask(connection: str) -> str:
    """The connection string with its password hidden, whether it is a URI or key=value pairs (quotes may hold semicolons)."""
    uri = re.match(r"(?s)(.*?://)([^/?#]*)@(.*)\Z", connection)
    if "://" in connection:
        if uri and ":" in uri[2]:
            return f"{uri[1]}{uri[2].partition(':')[0]}:********@{uri[3]}"
        return connection
    pair = re.compile(r"""(?is)(?:\A|(?<=;))(\s*(?:password|pwd)\s*)=(?:"[^"]*"?|'[^']*'?|[^;"'])*""")
    # Pairs are told apart outside quotes first, so that text inside a quoted value is never taken for a pair.
    parts = re.findall(r"""(?s)((?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^;"'])*)(;|\Z)""", connection)
    return "".join((f"{p.partition('=')[0]}=********" if pair.fullmatch(p) else p) + end for p, end in parts)


#: Environment variables -> settings. Fixed values.
NUMBERS = {
    "CDC_PROTOCOL_VERSION": "protocol_version", "CDC_CONNECTION_TIMEOUT": "connection_timeout", "CDC_QUERY_TIMEOUT": "query_timeout",
    "CDC_BUFFER_SIZE": "buffer_size", "CDC_CHANNEL_CAPACITY": "buffer_size", "CDC_COMMIT_BATCH_SIZE": "batch_size", "CDC_BATCH_SIZE": "batch_size",
    "CDC_BULK_INSERT_THRESHOLD": "bulk_threshold", "CDC_MAX_ROWS_PER_INSERT": "max_rows_per_insert",
}
BOOLEANS = {"CDC_BINARY_FORMAT": "binary_format", "CDC_STREAMING": "streaming"}
TEXTS = {
    "CDC_SOURCE_CONNECTION_STRING": "source", "CDC_DEST_URI": "destination", "CDC_REPLICATION_SLOT": "slot",
    "CDC_PUBLICATION": "publication", "CDC_TRANSACTION_FILE_BASE_PATH": "spool_path",
}


def load_config(environment: Mapping[str, str] | None = None) -> Config:
    """Settings from the environment. Of two names for one setting, the later listed wins; an unknown destination is MySQL."""
    env, out = os.environ if environment is None else environment, {}
    for names, parse in ((NUMBERS, parse_int), (BOOLEANS, parse_bool), (TEXTS, str)):
        out |= {setting: parse(env[name]) for name, setting in names.items() if name in env}
    kind = env.get("CDC_DEST_TYPE", "mysql").lower()
    if kind not in DESTINATIONS:
        log.warning("no destination is called %r; taking mysql", kind)
        kind = "mysql"
    if "CDC_TRANSACTION_SEGMENT_SIZE_MB" in env:
        out["segment_bytes"] = parse_int(env["CDC_TRANSACTION_SEGMENT_SIZE_MB"]) << 20
    out["schema_mappings"] = parse_schema_mappings(env.get("CDC_SCHEMA_MAPPING", ""))
    out["key_columns"] = parse_key_columns(env.get("KAFKA_KEY_COLUMNS", ""))
    return Config(destination_type=kind, **out).validate()
