"""A Spark data source over SQLite files, read only.

``spark.dataSource.register(SqliteSource)``, then ``spark.read.format("sqlite").option("table", "page_tokens").load(path)``.
Rows are read in ranges of rowid, ``partitions`` of them; a table without rowids is one partition. The option ``book_id``, one
id or several with commas between, leaves the choice of books to SQLite, where the primary key serves it. (Spark's own filters
are not pushed down: what one query of a DataFrame pushes would stay with the source for the next.)
"""

from __future__ import annotations

import sqlite3

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from vellum.errors import CorpusError

_TYPES = {"INT": "bigint", "CHAR": "string", "TEXT": "string", "CLOB": "string", "BLOB": "binary", "REAL": "double", "FLOA": "double", "DOUB": "double"}


def _connect(path: str):
    try:
        return sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    except sqlite3.Error as e:
        raise CorpusError(f"can't open {path}: {e}") from e


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, partitions: int, book: list[int] | None):
        self.path, self.table, self.schema, self.n, self.book = path, table, schema, partitions, book

    def partitions(self):
        with _connect(self.path) as db:
            try:
                low, high = db.execute(f"select min(rowid), max(rowid) from {_name(self.table)}").fetchone()
            except sqlite3.OperationalError:
                return [_Range(None, None)]
        if low is None:
            return [_Range(0, -1)]
        step = -(-(high - low + 1) // self.n)
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition):
        columns = ", ".join(_name(f.name) for f in self.schema.fields)
        where, values = ("rowid between ? and ?", [partition.low, partition.high]) if partition.high is not None else ("true", [])
        if self.book is not None:
            where, values = f"{where} and book_id in ({', '.join('?' * len(self.book))})", [*values, *self.book]
        with _connect(self.path) as db:
            yield from db.execute(f"select {columns} from {_name(self.table)} where {where}", values)


class SqliteSource(DataSource):
    @classmethod
    def name(cls):
        return "sqlite"

    def schema(self):
        with _connect(self.options["path"]) as db:
            info = db.execute(f"pragma table_info({_name(self.options['table'])})").fetchall()
        if not info:
            raise CorpusError(f"no table {self.options['table']} in {self.options['path']}")
        kind = lambda t: next((v for k, v in _TYPES.items() if k in t.upper()), "string")
        return ", ".join(f"`{c[1]}` {kind(c[2])}" for c in info)

    def reader(self, schema):
        return SqliteReader(self.options["path"], self.options["table"], schema, int(self.options.get("partitions", 8)), [int(x) for x in self.options["book_id"].split(",")] if "book_id" in self.options else None)


def read_table(spark, path: str, table: str, partitions: int = 8, book_id: int | list[int] | None = None):
    spark.dataSource.register(SqliteSource)
    read = spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", partitions)
    return (read if book_id is None else read.option("book_id", ",".join(map(str, book_id)) if isinstance(book_id, list) else book_id)).load()
