"""SQLite stores as a Spark data source: tables read in ranges of rows, filters handed to SQLite where asked (``pushdown``).

``spark.read.format("sqlite_rows").option("path", …).option("table", "spans").schema("span_id string, …").load()`` reads the columns of the
schema from every store below the path that has the table; ``file`` is the store and ``rowid`` the row, where the schema asks
for them. A store is opened where it lies and read page by page, so it need not fit into memory; it has to lie where the driver and all executors
see it. A column that a store's table lacks is NULL, a store without the table gives no rows, and so does a file that is no store.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import DoubleType, IntegralType, StructType

from loglattice.sources.log_source import listing

#: Rows that one task reads of a store, and hands on at once.
TASK_ROWS, BATCH_ROWS = 200_000, 5_000
SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class Range(InputPartition):
    def __init__(self, file: str, low: int, high: int):
        super().__init__((file, low, high))


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(file: str) -> sqlite3.Connection:
    """A store for reading alone; one whose journal cannot be shared is read as it stands."""
    try:
        con = sqlite3.connect(f"file:{file}?mode=ro", uri=True)
        con.execute("SELECT 1 FROM sqlite_master").fetchone()
    except sqlite3.OperationalError:
        con = sqlite3.connect(f"file:{file}?mode=ro&immutable=1", uri=True)
    con.text_factory = lambda raw: raw.decode("utf-8", "replace")
    return con


class SqliteRows(DataSource):
    """Options: ``path``, ``glob`` (*.db), ``table``, ``taskRows``, ``pushdown`` (false)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def reader(self, schema: StructType) -> DataSourceReader:
        return (FilteringSqliteReader if self.options.get("pushdown") == "true" else SqliteReader)(self.options, schema)


def register(spark) -> None:
    """Make the source known to a session, and let it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteRows)


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.glob, self.table = options["path"], options.get("glob", "*.db"), options["table"]
        self.rows, self.schema = int(options.get("taskRows", TASK_ROWS)), schema
        self.asked: list[tuple[str, list]] = []

    def partitions(self) -> list[Range]:
        out = []
        for file, _, _ in listing(self.path, self.glob):
            try:
                con = opened(file)
                try:
                    low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
                finally:
                    con.close()
            except sqlite3.DatabaseError:
                continue
            if low is not None:
                out += [Range(file, k, min(k + self.rows, high + 1)) for k in range(low, high + 1, self.rows)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        file, low, high = partition.value
        con = opened(file)
        try:
            have = {row[1] for row in con.execute(f"PRAGMA table_info({quoted(self.table)})")} | {"rowid"}
            columns = ", ".join("?" if n == "file" else ("rowid" if n == "rowid" else quoted(n)) if n in have else "NULL" for n in self.schema.names)
            # A comparison of a column that the table lacks holds for no row.
            parts = [sql if values[0] in have else "0" for sql, values in self.asked]
            bound = [v for _, values in self.asked if values[0] in have for v in values[1:]]
            where = "".join(f" AND {p}" for p in parts)
            got = con.execute(f"SELECT {columns} FROM {quoted(self.table)} WHERE rowid >= ? AND rowid < ?{where}", [*([file] if "file" in self.schema.names else []), low, high, *bound])
            while some := got.fetchmany(BATCH_ROWS):
                arrays = [pa.array([_typed(v, f.dataType) for v in column], _arrow(f.dataType)) for column, f in zip(zip(*some, strict=True), self.schema.fields, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=self.schema.names)
        finally:
            con.close()


class FilteringSqliteReader(SqliteReader):
    """Spark keeps what a reader was asked for with the load, so a load with filters serves one question; ``pushdown`` asks for it."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of a column with numbers or texts of its own type are SQLite's; Spark applies the others."""
        for f in filters:
            told = self._told(f)
            if told is None:
                yield f
            else:
                self.asked.append(told)

    def _told(self, f: Filter) -> tuple[str, list] | None:
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
        if name not in self.schema.names or name == "file":
            return None
        column = "rowid" if name == "rowid" else quoted(name)
        values = list(f.value) if isinstance(f, In) else [getattr(f, "value", None)]
        kind = int if isinstance(self.schema[name].dataType, IntegralType) else float if isinstance(self.schema[name].dataType, DoubleType) else str
        if any(type(v) is not kind for v in values):
            return None
        # Only values of the column's type are compared: SQLite keeps any type in any column, and Spark reads the others as NULL.
        stored = {int: "typeof({0}) = 'integer'", float: "typeof({0}) IN ('real', 'integer')", str: "typeof({0}) IN ('text', 'blob')"}[kind].format(column)
        column = f"CAST({column} AS TEXT)" if kind is str else column
        if isinstance(f, In):
            return f"({stored} AND {column} IN ({', '.join('?' * len(values))}))", [name, *values]
        if type(f) in SIGNS:
            return f"({stored} AND {column} {SIGNS[type(f)]} ?)", [name, *values]
        return None


def _typed(value, kind):
    """A stored value as the schema has it; one of another type is NULL."""
    if isinstance(kind, IntegralType):
        return value if isinstance(value, int) else None
    if isinstance(kind, DoubleType):
        return float(value) if isinstance(value, (int, float)) else None
    return value.decode("utf-8", "replace") if isinstance(value, bytes) else value if isinstance(value, str) else None


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
