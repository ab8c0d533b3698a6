"""SQLite stores as a Spark data source and sink: ``spark.read.format("sqlite")``.

Reading.  Stores are opened by path, read-only and with their logs, never loaded
whole, so size is no limit.  A store is split by rowid into ranges of about
``rowsPerTask`` rows; each range is a task that streams Arrow batches.  Columns
that a query needs and filters that SQLite can judge become the statement of every
task.  Executors must see the path, as with any file source that is mounted.

Writing.  Each task writes one store below ``path`` under a name of its attempt;
the commit gives finished stores their names, an abort removes what was written.

Options: ``path`` (a store, a folder of stores, or several separated by commas),
``table``, ``rowsPerTask``.  Cells that are not of a column's type are null; text
that is no UTF-8 has U+FFFD.
"""

from __future__ import annotations

import os
import shutil
import sqlite3
import tempfile
from collections.abc import Iterator, Sequence
from contextlib import closing, contextmanager
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

NAME, ROWS_PER_TASK, BATCH_ROWS = "sqlite", 250_000, 8192
#: How stores are named, and what stands beside them
STORES, LOG = (".db", ".sqlite", ".sqlite3"), "-wal"
#: SQLite's rules of affinity, in the order in which they apply
AFFINITY = (("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"))
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
_DECLARED = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "string": "TEXT", "binary": "BLOB", "boolean": "INTEGER"}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def affinity(declared: str) -> str:
    if not declared:
        return "binary"
    return next((kind for part, kind in AFFINITY if part in declared.upper()), "double")


def stores_at(path: str) -> list[str]:
    """The stores that a path option names, in order."""
    found = []
    for one in filter(None, (p.strip() for p in path.split(","))):
        one = one.removeprefix("file://") if one.startswith("file:///") else one.removeprefix("file:")
        if os.path.isdir(one):
            found += sorted(os.path.join(one, n) for n in os.listdir(one) if n.endswith(STORES) and not n.startswith((".", "_")))
        else:
            found.append(one)
    return found


@contextmanager
def opened(path: str) -> Iterator[sqlite3.Connection]:
    """A store with its log, read-only; where its folder does not let SQLite read the log, a copy of both."""
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    uri = "file:" + quote(os.path.abspath(path))
    copy = None
    try:
        connection = sqlite3.connect(uri + "?mode=ro", uri=True)
        try:
            connection.execute("SELECT 1 FROM sqlite_master LIMIT 1").fetchall()
        except sqlite3.OperationalError:
            connection.close()
            if os.path.isfile(path + LOG) and os.path.getsize(path + LOG):
                copy = tempfile.TemporaryDirectory(prefix="quillmeter-")
                for name in (path, path + LOG):
                    shutil.copyfile(name, os.path.join(copy.name, "store.db" + name[len(path) :]))
                connection = sqlite3.connect(os.path.join(copy.name, "store.db"))
            else:
                connection = sqlite3.connect(uri + "?immutable=1", uri=True)
        connection.text_factory = lambda b: b.decode("utf-8", "replace")
        with closing(connection):
            yield connection
    finally:
        if copy is not None:
            copy.cleanup()


def _cells(values: Sequence, kind: str) -> pa.Array:
    """A column of SQLite's values; what does not fit its type is null."""
    plain = {"bigint": int, "int": int, "boolean": int, "double": (int, float), "string": str, "binary": bytes}[kind]
    fits = [v if isinstance(v, plain) else None for v in values]
    if kind == "boolean":
        fits = [None if v is None else bool(v) for v in fits]
    elif kind == "double":
        fits = [None if v is None else float(v) for v in fits]
    elif kind == "int":
        fits = [v if v is not None and -(1 << 31) <= v < 1 << 31 else None for v in fits]
    return pa.array(fits, _ARROW[kind])


@dataclass
class Range(D.InputPartition):
    """Rows of a store with low <= rowid < high; both None: all of them."""

    path: str
    low: int | None = None
    high: int | None = None

    def __post_init__(self) -> None:
        super().__init__((self.path, self.low, self.high))


class Reader(D.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.stores, self.table = stores_at(options["path"]), options["table"]
        self.rows_per_task = max(1, int(options.get("rowsPerTask", ROWS_PER_TASK)))
        self.fields = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        self.kinds = dict(self.fields)
        unknown = [f"{n} {k}" for n, k in self.fields if k not in _ARROW]
        if unknown:
            raise ValueError(f"no SQLite column can be read as {', '.join(unknown)}")
        self.conditions: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:  # noqa: N802  Spark's name
        """Comparisons of numbers and of text with values go to SQLite; the rest stays with Spark."""
        for f in filters:
            found = self._condition(f)
            if found is None:
                yield f
            else:
                self.conditions.append(found)

    def _condition(self, f: D.Filter) -> tuple[str, list] | None:
        if isinstance(f, D.Not):
            inner = self._condition(f.child)
            return None if inner is None or isinstance(f.child, (D.IsNull, D.IsNotNull)) else (f"NOT ({inner[0]})", inner[1])
        column = getattr(f, "attribute", ())
        if len(column) != 1 or column[0] not in self.kinds:
            return None
        name, kind = quoted(column[0]), self.kinds[column[0]]
        # a cell of another type than its column's is null to Spark, so SQLite must not compare it
        types = {"bigint": ("integer",), "double": ("integer", "real"), "string": ("text",)}.get(kind)
        if types is None:
            return None
        own = f"typeof({name}) IN ({', '.join(repr(t) for t in types)})"
        if isinstance(f, D.IsNotNull):
            return own, []
        if isinstance(f, D.IsNull):
            return f"NOT ({own})", []
        if isinstance(f, D.In):
            values = [v for v in f.value if v is not None]
            return (f"({own} AND {name} IN ({', '.join('?' * len(values))}))", values) if values and len(values) < 500 else None
        sign = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}.get(type(f))
        if sign is None or f.value is None or not isinstance(f.value, (int, float, str)) or isinstance(f.value, bool) or (isinstance(f.value, float) and f.value != f.value):
            return None
        return f"({own} AND {name} {sign} ?)", [f.value]

    def statement(self, part: Range) -> tuple[str, list]:
        """What a task asks its store."""
        where, values = [c for c, _ in self.conditions], [v for _, vs in self.conditions for v in vs]
        if part.low is not None:
            where.append("rowid >= ? AND rowid < ?")
            values += [part.low, part.high]
        columns = ", ".join(quoted(n) for n, _ in self.fields) or "1"
        return f"SELECT {columns} FROM {quoted(self.table)}" + (" WHERE " + " AND ".join(where) if where else ""), values

    def partitions(self) -> list[Range]:
        out = []
        for path in self.stores:
            with opened(path) as c:
                try:
                    low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
                except sqlite3.OperationalError:  # a table without rowid, or a view: one task
                    out.append(Range(path))
                    continue
            if low is not None:
                out += [Range(path, a, min(a + self.rows_per_task, high + 1)) for a in range(low, high + 1, self.rows_per_task)]
        return out or [Range("")]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        sql, values = self.statement(partition)
        with opened(partition.path) as c:
            cursor = c.execute(sql, values)
            while rows := cursor.fetchmany(BATCH_ROWS):
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([_cells(v, k) for v, (_, k) in zip(columns, self.fields)], names=[n for n, _ in self.fields])


@dataclass
class Written(D.WriterCommitMessage):
    path: str | None


class Writer(D.DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.folder = stores_at_folder(options["path"])
        self.table, self.overwrite = options["table"], overwrite
        self.fields = [(f.name, f.dataType.simpleString()) for f in schema.fields]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        os.makedirs(self.folder, exist_ok=True)
        path, store = os.path.join(self.folder, f"_{task.partitionId()}-{task.taskAttemptId()}.part"), None
        try:
            for batch in iterator:
                if store is None:
                    store = sqlite3.connect(path)
                    store.execute(f"CREATE TABLE {quoted(self.table)} ({', '.join(f'{quoted(n)} {_DECLARED[k]}' for n, k in self.fields)})")
                columns = [batch.column(k).to_pylist() for k in range(len(self.fields))]
                store.executemany(f"INSERT INTO {quoted(self.table)} VALUES ({', '.join('?' * len(columns))})", zip(*columns))
        finally:
            if store is not None:
                store.commit()
                store.close()
        return Written(path if store is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m.path for m in messages if m is not None and m.path]
        if self.overwrite and os.path.isdir(self.folder):
            for old in stores_at(self.folder):
                os.remove(old)
        for path in done:
            os.replace(path, os.path.join(self.folder, os.path.basename(path)[1:].removesuffix(".part") + ".db"))

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and m.path and os.path.exists(m.path):
                os.remove(m.path)


def stores_at_folder(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")


class SqliteSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _options(self) -> dict[str, str]:
        given = dict(self.options)
        for name in ("path", "table"):
            if not given.get(name):
                raise ValueError(f"option {name} is missing")
        return given | {"rowsPerTask": given.get("rowsPerTask") or given.get("rowspertask") or str(ROWS_PER_TASK)}

    def schema(self) -> str:
        """The columns of the table in the first store that has it, by their affinity."""
        options = self._options()
        for path in stores_at(options["path"]):
            with opened(path) as c:
                columns = c.execute(f"PRAGMA table_info({quoted(options['table'])})").fetchall()
            if columns:
                return ", ".join(f"`{name.replace('`', '``')}` {affinity(kind)}" for _, name, kind, *_ in columns)
        raise ValueError(f"no store at {options['path']} has a table {options['table']}")

    def reader(self, schema: StructType) -> Reader:
        return Reader(self._options(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self._options(), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``sqlite`` a format of the session, with filters pushed into the stores."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
