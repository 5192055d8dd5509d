"""A log that is kept as lines of JSON, behind the interface of a live one: for tests and for replays from a file."""

from __future__ import annotations

import json
from base64 import b64decode
from collections.abc import Iterator
from datetime import datetime

from pyarrow import fs

from ..schema import CHANGELOG


#: Endings by which a file is taken to be compressed; only the others can be read from their end.
COMPRESSED = (".gz", ".bz2", ".lz4", ".zst")


class JsonTransport:
    """options: path (a file of lines, in order of position, or a folder of such files, whose ranges follow each other), acks (a file that takes
    the last position acknowledged)."""

    def __init__(self, options: dict[str, str]):
        self.store, self.path = fs.FileSystem.from_uri(options["path"])
        self.acks = options.get("acks")
        self.known: dict[str, tuple[int, int | None, int | None]] = {}

    def _lines(self, path: str) -> Iterator[dict]:
        with self.store.open_input_stream(path) as lines:
            rest = b""
            while chunk := lines.read(1 << 20):
                *whole, rest = (rest + chunk).split(b"\n")
                yield from (json.loads(x) for x in whole if x.strip())
            if rest.strip():
                yield json.loads(rest)

    def _last(self, path: str, size: int) -> int:
        """The position of the last line of a file that has one, read from its end."""
        if path.endswith(COMPRESSED):
            return max(r["lsn"] for r in self._lines(path))
        with self.store.open_input_file(path) as file:
            length = 1 << 16
            while True:
                start = max(0, size - length)
                file.seek(start)
                lines = file.read(size - start).split(b"\n")
                if found := [x for x in lines[start > 0 :] if x.strip()]:  # the first may be cut off
                    return json.loads(found[-1])["lsn"]
                length *= 4

    def files(self) -> list[tuple[int, int, str]]:
        """(first position, last position, path) of each file with lines, in order. A file is looked into again once its size changes."""
        kind = self.store.get_file_info(self.path)
        if kind.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        there = self.store.get_file_info(fs.FileSelector(self.path)) if kind.type == fs.FileType.Directory else [kind]
        out = []
        for info in there:
            if not info.is_file or (info.path != kind.path and info.base_name.startswith(("_", "."))):
                continue
            if self.known.get(info.path, (None,))[0] != info.size:
                first = next(self._lines(info.path), None)
                self.known[info.path] = (info.size, None, None) if first is None else (info.size, first["lsn"], self._last(info.path, info.size))
            _, low, high = self.known[info.path]
            if low is not None:
                out.append((low, high, info.path))
        return sorted(out)

    def confirmed(self) -> int:
        if self.acks is None:
            return 0
        store, path = fs.FileSystem.from_uri(self.acks)
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return 0
        with store.open_input_stream(path) as f:
            return int(f.read() or b"0")

    def latest(self) -> int:
        return max((high for _, high, _ in self.files()), default=0)

    def cuts(self, after: int, upto: int) -> list[int]:
        """The last positions of files inside the range, so that each file can be a task's."""
        return sorted({high for _, high, _ in self.files() if after < high < upto})

    def records(self, after: int, upto: int) -> Iterator[tuple]:
        for low, high, path in self.files():
            if low <= upto and high > after:
                for row in self._lines(path):
                    if after < row["lsn"] <= upto:
                        yield tuple(_value(f.name, row.get(f.name)) for f in CHANGELOG.fields)

    def acknowledge(self, upto: int) -> None:
        if self.acks is not None:
            store, path = fs.FileSystem.from_uri(self.acks)
            with store.open_output_stream(path) as f:
                f.write(str(upto).encode())


def _value(name: str, x):
    if x is None:
        return None
    if name == "commit_ts":
        return datetime.fromisoformat(x)
    if name in ("before", "after"):
        return [(v["name"], v["kind"], b64decode(v["bytes"]) if v.get("bytes") is not None else None) for v in x]
    return x
