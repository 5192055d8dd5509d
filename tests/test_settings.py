"""Settings, errors and sinks by name."""

import pytest

from tidemark import errors
from tidemark.config import Config, load_config, mask, parse_bool, parse_int, parse_key_columns, parse_schema_mappings
from tidemark.sinks import registry

ENV = {"CDC_SOURCE_CONNECTION_STRING": "postgresql://u:p@h/db", "CDC_DEST_URI": "x.db"}


def test_environment():
    c = load_config(ENV | {"CDC_DEST_TYPE": "SQLite", "CDC_BATCH_SIZE": "7", "CDC_COMMIT_BATCH_SIZE": "9", "CDC_STREAMING": "off", "CDC_TRANSACTION_SEGMENT_SIZE_MB": "2", "CDC_SCHEMA_MAPPING": "a:b, c:d"})
    assert (c.destination_type, c.batch_size, c.streaming, c.segment_bytes, c.schema_mappings) == ("sqlite", 7, False, 2 << 20, {"a": "b", "c": "d"})
    assert load_config(ENV | {"CDC_DEST_TYPE": "oracle"}).destination_type == "mysql"
    assert load_config(ENV).protocol_version == 2
    assert "p@" not in repr(load_config(ENV))


@pytest.mark.parametrize("wrong", [{"source": ""}, {"destination": ""}, {"slot": "Bad-Name"}, {"publication": ""}, {"protocol_version": 5}, {"protocol_version": 1}, {"two_phase": True}, {"buffer_size": 0}])
def test_validation(wrong):
    with pytest.raises(errors.ConfigError):
        Config(**({"source": "s", "destination": "d"} | wrong)).validate()


@pytest.mark.parametrize(("secret", "shown"), [
    ("mysql://u:p@w@h:1/db?x=a@b", "mysql://u:********@h:1/db?x=a@b"), ("mysql://u@h/db", "mysql://u@h/db"), ("mysql://h/db?a=b:c@d", "mysql://h/db?a=b:c@d"),
    ("Server=h;Password=abc;Db=x", "Server=h;Password=********;Db=x"), ('PWD="my;pwd";a=1', "PWD=********;a=1"), ("plain.db", "plain.db"), ("a=1;pwd=", "a=1;pwd=********"),
])
def test_masking(secret, shown):
    assert mask(secret) == shown


def test_parsers():
    assert parse_bool("YES") and not parse_bool("0") and parse_int("12") == 12
    for f, x in ((parse_bool, "maybe"), (parse_int, "-1"), (parse_int, "x"), (parse_schema_mappings, "a"), (parse_schema_mappings, "a:")):
        with pytest.raises(errors.ConfigError):
            f(x)
    assert parse_schema_mappings("") == {} and parse_key_columns("s.t:a,b; s.u:c;bad") == {"s.t": ["a", "b"], "s.u": ["c"]}


def test_errors():
    assert [errors.backoff_seconds(n) for n in (0, 1, 4, 5, 60)] == [1, 2, 16, 30, 30]
    assert errors.is_transient(errors.ConnectionLost()) and errors.is_transient(TimeoutError()) and not errors.is_transient(errors.ConfigError())


def test_registry():
    made = []
    registry.register_sink("mine", lambda *a: made.append(a) or object())
    first, second = registry.create_sink("Mine", 1), registry.create_sink("mine", 2)
    assert first is not second and made == [(1,), (2,)]
    with pytest.raises(errors.UnsupportedError):
        registry.create_sink("none such")
