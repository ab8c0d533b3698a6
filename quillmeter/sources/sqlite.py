"""SQLite files that Spark has read as bytes, read-only.

A store of a running agent has its newest rows in the log beside it; the log's
bytes come with the file's, and the two are opened from a private copy in the
task's own temporary folder.  A store without a log is opened in memory.
"""

from __future__ import annotations

import os
import sqlite3
import tempfile
from collections.abc import Iterator
from contextlib import closing
from typing import Any

from .kit import Loaded

#: Fixed value: how the name of a store's write-ahead log ends
LOG = "-wal"


class Database:
    def __init__(self, f: Loaded):
        if f.data[:16] != b"SQLite format 3\x00":
            raise sqlite3.DatabaseError("not a database")
        self.folder = None
        if f.log:
            self.folder = tempfile.TemporaryDirectory(prefix="quillmeter-")
            copy = os.path.join(self.folder.name, "store.db")
            for path, data in ((copy, f.data), (copy + LOG, f.log)):
                with open(path, "wb") as out:
                    out.write(data)
            self.connection = sqlite3.connect(copy)
        else:
            raw = bytearray(f.data)
            raw[18:20] = b"\x01\x01"  # as if in rollback mode: there is no log
            self.connection = sqlite3.connect(":memory:")
            self.connection.deserialize(bytes(raw))
        self.connection.text_factory = lambda b: b.decode("utf-8", "replace")
        self.connection.execute("PRAGMA query_only = 1")

    def close(self) -> None:
        self.connection.close()
        if self.folder is not None:
            self.folder.cleanup()

    def rows(self, sql: str) -> Iterator[dict[str, Any]]:
        with closing(self.connection.execute(sql)) as c:
            names = [d[0] for d in c.description]
            for r in c:
                yield dict(zip(names, r))

    def columns(self, table: str) -> set[str]:
        return {r["name"] for r in self.rows(f"PRAGMA table_info('{table}')")}

    def pragma(self, name: str) -> int:
        return next(iter(self.rows(f"PRAGMA {name}")))[name]
