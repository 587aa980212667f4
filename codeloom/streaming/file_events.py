"""A stream of file changes below a folder, found by listing it again and again.

After ``spark.dataSource.register(FileEvents)``,
``spark.readStream.format("codeloom-files").option("path", folder).option("state", folder).load()``
gives ``ts``, ``path`` relative to the folder, and ``kind``: ``created``, ``changed``, ``deleted``, or one
row ``overflow`` where a listing has more changes than ``most``. A renamed file is two rows, its old path
deleted and its new one created. Each listing is kept in the ``state`` folder under the number that is the
stream's offset, so that a batch that is run again gives the same rows.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

FORMAT = "codeloom-files"
SCHEMA = "ts timestamp, path string, kind string"
MOST_EVENTS = 8192
KEPT = 100


def listing(root: str) -> dict[str, tuple[int, int]]:
    """Time of change and size of every file, by path."""
    out = {}
    for folder, _, names in os.walk(root):
        for name in names:
            full = os.path.join(folder, name)
            try:
                found = os.stat(full)
            except OSError:
                continue
            out[os.path.relpath(full, root).replace(os.sep, "/")] = (found.st_mtime_ns, found.st_size)
    return out


def changes(before: dict, after: dict, most: int) -> list[tuple[str, str]]:
    """(path, kind) of what differs, by path; one overflow beyond ``most``."""
    out = [(p, "deleted") for p in before.keys() - after.keys()] + [(p, "created") for p in after.keys() - before.keys()]
    out += [(p, "changed") for p in before.keys() & after.keys() if tuple(before[p]) != tuple(after[p])]
    return [("", "overflow")] if len(out) > most else sorted(out)


class FileEventReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.state = options["path"], options["state"]
        self.most = int(options.get("most", MOST_EVENTS))
        os.makedirs(self.state, exist_ok=True)

    def _at(self, n: int) -> str:
        return os.path.join(self.state, f"listing-{n}.json")

    def _load(self, n: int) -> dict:
        try:
            with open(self._at(n), encoding="utf-8") as f:
                return json.load(f)
        except (OSError, ValueError):
            return {"ts": 0.0, "files": None}

    def initialOffset(self) -> dict:
        self._save(0)
        return {"n": 0}

    def _save(self, n: int) -> None:
        with open(self._at(n) + ".new", "w", encoding="utf-8") as f:
            json.dump({"ts": time.time(), "files": listing(self.root)}, f)
        os.replace(self._at(n) + ".new", self._at(n))

    def _rows(self, start: int, end: int) -> Iterator[tuple]:
        from datetime import datetime, timezone

        old, new = self._load(start), self._load(end)
        ts = datetime.fromtimestamp(new["ts"], timezone.utc)
        if old["files"] is None or new["files"] is None:
            # A listing is gone: what changed can't be told.
            return iter([(ts, "", "overflow")])
        return iter([(ts, p, k) for p, k in changes(old["files"], new["files"], self.most)])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        n = start["n"]
        self._save(n + 1)
        rows = list(self._rows(n, n + 1))
        return iter(rows), {"n": n + 1 if rows else n}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._rows(start["n"], end["n"])

    def commit(self, end: dict) -> None:
        gone = self._at(end["n"] - KEPT)
        if os.path.exists(gone):
            os.unlink(gone)


class FileEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: StructType) -> FileEventReader:
        return FileEventReader(dict(self.options))
