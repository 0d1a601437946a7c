"""PostgreSQL over JDBC: tables are created bare, filled by all tasks, then given keys and indexes.

Statements run through the JVM's own connection, so nothing but the JDBC driver's jar is needed.
"""

from __future__ import annotations

import threading
import warnings
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

from ..plans import ddl
from ..plans.entities import EntitySpec
from .base import OutputExists


CLOSE_SECONDS = 30


def jdbc_target(dsn: str) -> tuple[str, dict[str, str]]:
    """(JDBC URL, properties) of a postgresql:// DSN."""
    parts = urlsplit(dsn)
    url = f"jdbc:postgresql://{parts.hostname or 'localhost'}:{parts.port or 5432}{parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")
    found = {"driver": "org.postgresql.Driver", "reWriteBatchedInserts": "true", "stringtype": "unspecified"}
    if parts.username:
        found["user"] = unquote(parts.username)
    if parts.password:
        found["password"] = unquote(parts.password)
    return url, found


class PostgresSink:
    concurrent = True

    def __init__(self, dsn: str, overwrite: bool = False, unlogged: bool = False, tune: bool = False, fk: bool = False, batch: int = 10_000, writers: int | None = None, index_workers: int = 2, **_ignored) -> None:
        self.url, self.properties = jdbc_target(dsn)
        self.overwrite, self.unlogged, self.tune, self.fk, self.batch, self.writers, self.index_workers = overwrite, unlogged, tune, fk, batch, writers, index_workers
        self._spark: SparkSession | None = None
        self._tuned: list[str] = []
        self._prepared = False

    def statements(self, spec: EntitySpec) -> ddl.PostgresStatements:
        return ddl.PostgresStatements(spec, unlogged=self.unlogged, fk=self.fk, tune=self.tune)

    def _execute(self, statements: list[str]) -> list[str]:
        """Run statements, each committed; the first columns of queries come back."""
        jvm = self._spark.sparkContext._jvm
        properties = jvm.java.util.Properties()
        for k, v in self.properties.items():
            properties.setProperty(k, v)
        jvm.java.lang.Class.forName(self.properties["driver"])
        connection, out = jvm.java.sql.DriverManager.getConnection(self.url, properties), []
        try:
            for s in statements:
                statement = connection.createStatement()
                if statement.execute(s):
                    rows = statement.getResultSet()
                    while rows.next():
                        out.append(rows.getString(1))
                statement.close()
        finally:
            connection.close()
        return out

    def prepare(self, spark: SparkSession, spec: EntitySpec) -> None:
        self._spark = spark
        plan = self.statements(spec)
        there = set(self._execute([plan.existing()])) & set(spec.table_names)
        if there and not self.overwrite:
            raise OutputExists(f"The database already holds {', '.join(sorted(there))}; use overwrite to replace them")
        self._execute(plan.tuning())
        self._tuned = plan.untuning()
        self._execute([*plan.drop(), *plan.create()])
        self._prepared = True

    def write(self, table: str, df: DataFrame, spec: EntitySpec) -> None:
        if self.writers:
            df = df.coalesce(self.writers)
        df.write.format("jdbc").mode("append").options(url=self.url, dbtable=ddl.quoted(table), batchsize=str(self.batch), **self.properties).save()

    def finalize(self, spark: SparkSession, spec: EntitySpec) -> list[str]:
        """Keys after the load. Without a prepare before, those of an earlier run are dropped first."""
        from concurrent.futures import ThreadPoolExecutor

        self._spark = spark
        plan = self.statements(spec)
        if not self._prepared:
            self._execute(plan.reset_keys())
        self._execute(plan.primary_key())
        with ThreadPoolExecutor(max(1, self.index_workers)) as pool:
            list(pool.map(lambda s: self._execute([s]), plan.indexes()))
        self._execute(plan.foreign_keys())
        return []

    def close(self) -> None:
        """Put the server's settings back; a server that does not answer is waited for CLOSE_SECONDS at most."""
        if self._tuned and self._spark is not None:
            todo, self._tuned = self._tuned, []
            last = threading.Thread(target=self._execute, args=(todo,), daemon=True)
            last.start()
            last.join(CLOSE_SECONDS)
            if last.is_alive():
                warnings.warn(f"the server has not put its settings back after {CLOSE_SECONDS} s: {'; '.join(todo)}", stacklevel=2)
