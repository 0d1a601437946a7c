"""SQLite, through a Python data source.

SQLite has one writer, so a table is written by one task, in one transaction, into a table of that
attempt's own; the commit moves its rows into the target, so a task that is tried again cannot insert
twice. Lists become JSON texts, flags 0 or 1. The database file must be reachable where tasks run.
What SQLite sorts for an index or keeps to undo a statement goes to files in the temp folder: in memory
it would grow with the table, in the driver's process.
"""

from __future__ import annotations

import contextlib
import json
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans import ddl
from ..plans.entities import EntitySpec
from .base import OutputExists

PRAGMAS = ("PRAGMA journal_mode=WAL", "PRAGMA synchronous=OFF", "PRAGMA cache_size=-64000", "PRAGMA temp_store=FILE")
BATCH = 10_000


def connect(path: str) -> sqlite3.Connection:
    db = sqlite3.connect(path, timeout=600)
    for p in PRAGMAS:
        db.execute(p)
    return db


def cell(value):
    """A column's value as SQLite holds it."""
    if isinstance(value, (list, tuple)):
        return json.dumps(list(value))
    return int(value) if isinstance(value, bool) else value


@dataclass
class Staged(WriterCommitMessage):
    table: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, table: str, schema: T.StructType) -> None:
        self.path, self.table, self.schema = path, table, schema

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        own = f"_stage_{self.table}_{uuid.uuid4().hex}"
        n = 0
        with contextlib.closing(connect(self.path)) as db:
            db.execute(ddl.sqlite_table(own, T.StructType([T.StructField(f.name, f.dataType) for f in self.schema.fields])))
            insert = f"INSERT INTO {ddl.quoted(own)} VALUES ({','.join('?' * len(self.schema.fields))})"
            plain = [not isinstance(f.dataType, (T.ArrayType, T.BooleanType)) for f in self.schema.fields]
            for b in batches:
                columns = [x.to_pylist() if p else map(cell, x.to_pylist()) for x, p in zip(b.columns, plain, strict=True)]
                db.executemany(insert, zip(*columns, strict=True))
                n += b.num_rows
            db.commit()
        return Staged(own, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        names = ", ".join(ddl.quoted(f.name) for f in self.schema.fields)
        with contextlib.closing(connect(self.path)) as db:
            for m in messages:
                if m is not None:
                    db.execute(f"INSERT INTO {ddl.quoted(self.table)} ({names}) SELECT {names} FROM {ddl.quoted(m.table)}")
            self._drop(db, messages)
            db.commit()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        with contextlib.closing(connect(self.path)) as db:
            self._drop(db, messages)
            db.commit()

    def _drop(self, db: sqlite3.Connection, messages) -> None:
        """Tables of this write's attempts, also of those that did not report."""
        like = f"_stage_{self.table}_" + "_" * 32
        for (name,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name LIKE ? ", (like,)).fetchall():
            if name.startswith(f"_stage_{self.table}_"):
                db.execute(f"DROP TABLE {ddl.quoted(name)}")


@dataclass
class Span(InputPartition):
    """Rows by their row number, from `first` up to and without `last`."""

    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType, spans: int) -> None:
        self.path, self.table, self.schema, self.spans = path, table, schema, spans

    def partitions(self) -> list[Span]:
        with contextlib.closing(sqlite3.connect(self.path)) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {ddl.quoted(self.table)}").fetchone()
        if low is None:
            return [Span(0, 0)]
        step = max(1, -(-(high + 1 - low) // self.spans))
        return [Span(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        names = ", ".join(ddl.quoted(f.name) for f in self.schema.fields)
        lists = [isinstance(f.dataType, T.ArrayType) for f in self.schema.fields]
        flags = [isinstance(f.dataType, T.BooleanType) for f in self.schema.fields]
        types = to_arrow_schema(self.schema)
        with contextlib.closing(sqlite3.connect(self.path)) as db:
            rows = db.execute(f"SELECT {names} FROM {ddl.quoted(self.table)} WHERE rowid >= ? AND rowid < ?", (partition.first, partition.last))
            while some := rows.fetchmany(BATCH):
                columns = [[x if x is None else json.loads(x) if a else bool(x) for x in c] if a or b else c for c, a, b in zip(zip(*some, strict=True), lists, flags, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)


class SqliteSource(DataSource):
    """Options: path, dbtable; for reading also numPartitions. Reading needs the table's schema."""

    @classmethod
    def name(cls) -> str:
        return "lodestrata_sqlite"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["dbtable"], schema, int(self.options.get("numPartitions", "8")))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options["dbtable"], schema)


class SqliteSink:
    concurrent = False

    def __init__(self, dsn: str, overwrite: bool = False, fk: bool = False, **_ignored) -> None:
        self.path, self.overwrite, self.fk = dsn.removeprefix("sqlite:///"), overwrite, fk

    def prepare(self, spark: SparkSession, spec: EntitySpec) -> None:
        spark.dataSource.register(SqliteSource)
        with contextlib.closing(connect(self.path)) as db:
            there = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")} & set(spec.table_names)
            if there and not self.overwrite:
                raise OutputExists(f"{self.path} already holds {', '.join(sorted(there))}; use overwrite to replace them")
            for t in reversed(spec.tables):
                db.execute(f"DROP TABLE IF EXISTS {ddl.quoted(t.name)}")
            for statement in ddl.sqlite_entity(spec, fk=self.fk):
                db.execute(statement)
            db.commit()

    def write(self, table: str, df: DataFrame, spec: EntitySpec) -> None:
        # One task inserts; the projection before it keeps its own.
        df.repartition(1).write.format("lodestrata_sqlite").mode("append").option("path", self.path).option("dbtable", table).save()

    def finalize(self, spark: SparkSession, spec: EntitySpec) -> list[str]:
        out = []
        with contextlib.closing(connect(self.path)) as db:
            for statement in ddl.sqlite_indexes(spec):
                db.execute(statement)
            if self.fk:
                bad = db.execute('SELECT "table", count(*) FROM pragma_foreign_key_check GROUP BY 1 ORDER BY 1')
                out += [f"{t}: {n} rows refer to no {spec.root.name}" for t, n in bad]
            db.commit()
        return out

    def close(self) -> None:
        pass
