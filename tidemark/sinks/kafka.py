"""Messages for Kafka: the frame that its connector writes, its settings, and how delivery is tried again. The connector itself comes with
the cluster."""

from __future__ import annotations

import logging
import os
import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from ..config import parse_key_columns
from ..errors import ConnectionLost, SinkError, UnsupportedError
from ..operators.envelope import envelope
from .registry import Hook, register_sink

log = logging.getLogger(__name__)
#: Environment variable -> (setting of the producer, its default). Fixed values.
SETTINGS = {
    "CDC_KAFKA_SECURITY_PROTOCOL": ("security.protocol", "PLAINTEXT"), "CDC_KAFKA_COMPRESSION": ("compression.type", "lz4"), "CDC_KAFKA_BATCH_SIZE": ("batch.size", "16384"),
    "CDC_KAFKA_LINGER_MS": ("linger.ms", "5"), "CDC_KAFKA_ACKS": ("acks", "all"), "CDC_KAFKA_MESSAGE_MAX_BYTES": ("max.request.size", "1048576"), "CDC_KAFKA_RETRIES": ("retries", "3"),
    "CDC_KAFKA_MESSAGE_TIMEOUT_MS": ("delivery.timeout.ms", "30000"), "CDC_KAFKA_RETRY_BACKOFF_MS": ("retry.backoff.ms", "200"), "CDC_KAFKA_METADATA_REFRESH_INTERVAL_MS": ("metadata.max.age.ms", "5000"),
}
#: Errors of a broker that pass: a topic that is being made, a queue that is full. Fixed values.
PASSING = ("UNKNOWN_TOPIC_OR_PARTITION", "UnknownTopicOrPartition", "BufferExhausted", "QueueFull", "TimeoutException", "NetworkException")
TRIES, FIRST_WAIT, LONGEST_WAIT = 5, 0.1, 3.0


def settings(servers: str, environment: Mapping[str, str] | None = None) -> dict[str, str]:
    """The connector's options, from the environment where it names them."""
    env = os.environ if environment is None else environment
    out = {"kafka.bootstrap.servers": servers} | {f"kafka.{name}": env.get(variable, default) for variable, (name, default) in SETTINGS.items()}
    # The time that a message may take covers a request and the wait for others.
    out["kafka.request.timeout.ms"] = str(max(1, int(out["kafka.delivery.timeout.ms"]) - int(out["kafka.linger.ms"])))
    out["kafka.security.protocol"] = out["kafka.security.protocol"].upper()
    if mechanism := env.get("CDC_KAFKA_SASL_MECHANISM"):
        module = "scram.ScramLoginModule" if mechanism.upper().startswith("SCRAM") else "plain.PlainLoginModule"
        quoted = lambda x: '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'
        user, password = quoted(env.get("CDC_KAFKA_SASL_USERNAME", "")), quoted(env.get("CDC_KAFKA_SASL_PASSWORD", ""))
        out["kafka.sasl.mechanism"] = mechanism
        out["kafka.sasl.jaas.config"] = f"org.apache.kafka.common.security.{module} required username={user} password={password};"
    return out


def _connector(messages: DataFrame, options: dict[str, str]) -> None:
    try:
        messages.write.format("kafka").options(**options).save()
    except Exception as error:
        raise (ConnectionLost if any(p in str(error) for p in PASSING) else SinkError)(str(error)) from error


class KafkaSink:
    """Takes events. A batch counts as delivered once every broker has acknowledged every message; then the hook runs."""

    dialect, takes_events = "kafka", True

    def __init__(
        self, servers: str, prefix: str | None = None, db: str | None = None, mappings: dict[str, str] | None = None, keys: dict[str, list[str]] | None = None,
        deliver: Callable[[DataFrame, dict[str, str]], None] = _connector, wait: Callable[[float], None] = time.sleep, environment: Mapping[str, str] | None = None, **more: str,
    ):
        env = os.environ if environment is None else environment
        self.prefix, self.db = prefix or env.get("CDC_KAFKA_TOPIC_PREFIX", "cdc"), db or env.get("CDC_KAFKA_SOURCE_DB_NAME", "postgres")
        self.mappings, self.keys = mappings, keys or parse_key_columns(env.get("CDC_KAFKA_KEY_COLUMNS", "")) or None
        self.settings, self.deliver, self.wait = settings(servers, env) | more, deliver, wait

    def messages(self, batch: DataFrame) -> DataFrame:
        """(topic, key, value), in the order of the log within a partition."""
        return envelope(batch, self.prefix, self.db, self.mappings, self.keys).sortWithinPartitions("lsn", "seq").select("topic", "key", "value")

    def write(self, batch: DataFrame, batch_id: int, hook: Hook | None = None) -> None:
        """Deliver a batch; errors that may pass are tried again after waits that double."""
        messages = self.messages(batch)
        for attempt in range(TRIES):
            try:
                self.deliver(messages, self.settings)
                break
            except ConnectionLost as error:
                if attempt == TRIES - 1:
                    raise
                log.warning("delivering again after %s", error)
                self.wait(min(FIRST_WAIT * 2**attempt, LONGEST_WAIT))
        if hook is not None:
            hook()

    def write_sql(self, *_: object) -> None:
        raise UnsupportedError("this sink takes events, not SQL")

    def close(self) -> None:
        pass


register_sink("kafka", KafkaSink)
