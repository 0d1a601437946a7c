"""CREATE TABLE and the statements around a load, made from the table schemas, for two dialects.

Every identifier is quoted: `join`, `text`, `type` and `value` are keywords somewhere.
"""

from __future__ import annotations

from pyspark.sql import types as T

from .entities import EntitySpec

_POSTGRES = {T.BooleanType(): ("BOOLEAN", "false"), T.IntegerType(): ("INTEGER", "0"), T.LongType(): ("BIGINT", "0"), T.StringType(): ("TEXT", "''")}
_SQLITE = {T.BooleanType(): ("INTEGER", "0"), T.IntegerType(): ("INTEGER", "0"), T.LongType(): ("INTEGER", "0"), T.StringType(): ("TEXT", "''")}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def postgres_type(kind: T.DataType) -> tuple[str, str]:
    """(type, default) of a column."""
    if isinstance(kind, T.ArrayType):
        if kind.elementType not in _POSTGRES:
            raise ValueError(f"Unsupported list value type: {kind.elementType.simpleString()}")
        return _POSTGRES[kind.elementType][0] + "[]", "'{}'"
    if kind not in _POSTGRES:
        raise ValueError(f"Unsupported type: {kind.simpleString()}")
    return _POSTGRES[kind]


def sqlite_type(kind: T.DataType) -> tuple[str, str]:
    if isinstance(kind, T.ArrayType):
        return "TEXT", "'[]'"  # a JSON array
    if kind not in _SQLITE:
        raise ValueError(f"Unsupported type: {kind.simpleString()}")
    return _SQLITE[kind]


def postgres_table(name: str, schema: T.StructType, *, unlogged: bool = False) -> str:
    lines = []
    for f in schema.fields:
        kind, default = postgres_type(f.dataType)
        rule = "" if f.nullable else " NOT NULL" + ("" if f.name == "id" else f" DEFAULT {default}")
        lines.append(f"    {quoted(f.name)} {kind}{rule}")
    return f"CREATE {'UNLOGGED ' if unlogged else ''}TABLE {quoted(name)} (\n" + ",\n".join(lines) + "\n)"


def sqlite_table(name: str, schema: T.StructType, *, pk: str | None = None, fk: str | None = None, fk_table: str | None = None) -> str:
    """The key is declared inline, as SQLite cannot add it later."""
    lines = []
    for f in schema.fields:
        kind, default = sqlite_type(f.dataType)
        rule = " PRIMARY KEY" if f.name == pk else "" if f.nullable else f" NOT NULL DEFAULT {default}"
        refers = f" REFERENCES {quoted(fk_table)}({quoted(pk or 'id')})" if fk_table and f.name == fk else ""
        lines.append(f"    {quoted(f.name)} {kind}{rule}{refers}")
    return f"CREATE TABLE {quoted(name)} (\n" + ",\n".join(lines) + "\n)"


def sqlite_entity(spec: EntitySpec, *, fk: bool = False) -> list[str]:
    """CREATE TABLE of all tables: the root with its key, children with a reference if wanted."""
    root = spec.root.name
    return [sqlite_table(t.name, t.schema, pk=spec.pk if t.name == root else None, fk=spec.fk if t.name != root else None, fk_table=root if fk and t.name != root else None) for t in spec.tables]


def sqlite_indexes(spec: EntitySpec) -> list[str]:
    return [f"CREATE INDEX {quoted(f'{t.name}_{spec.fk}_idx')} ON {quoted(t.name)} ({quoted(spec.fk)})" for t in spec.tables[1:]]


class PostgresStatements:
    """The statements around a load of one entity."""

    def __init__(self, spec: EntitySpec, *, unlogged: bool = False, fk: bool = False, tune: bool = False) -> None:
        self.spec, self.unlogged, self.fk, self.tune = spec, unlogged, fk, tune

    def existing(self) -> str:
        return "SELECT table_name FROM information_schema.tables WHERE table_schema = 'public' AND table_type = 'BASE TABLE'"

    def tuning(self) -> list[str]:
        return ["ALTER SYSTEM SET max_wal_size = '4GB'", "ALTER SYSTEM SET checkpoint_completion_target = '0.9'", "SELECT pg_reload_conf()"] if self.tune else []

    def untuning(self) -> list[str]:
        return ["ALTER SYSTEM RESET max_wal_size", "ALTER SYSTEM RESET checkpoint_completion_target", "SELECT pg_reload_conf()"] if self.tune else []

    def drop(self) -> list[str]:
        return [f"DROP TABLE IF EXISTS {quoted(t.name)} CASCADE" for t in reversed(self.spec.tables)]

    def create(self) -> list[str]:
        return [postgres_table(t.name, t.schema, unlogged=self.unlogged) for t in self.spec.tables]

    def reset_keys(self) -> list[str]:
        """Before keys are built anew on loaded tables: what an earlier run left goes first."""
        root, children = self.spec.root.name, self.spec.tables[1:]
        out = [f"ALTER TABLE {quoted(t.name)} DROP CONSTRAINT IF EXISTS {quoted(f'{t.name}_{self.spec.fk}_fkey')}" for t in children]
        out.append(f"ALTER TABLE {quoted(root)} DROP CONSTRAINT IF EXISTS {quoted(f'{root}_pkey')}")
        return out + [f"DROP INDEX IF EXISTS {quoted(f'{t.name}_{self.spec.fk}_idx')}" for t in children]

    def primary_key(self) -> list[str]:
        return [f"ALTER TABLE {quoted(self.spec.root.name)} ADD PRIMARY KEY ({quoted(self.spec.pk)})"]

    def indexes(self) -> list[str]:
        return [f"CREATE INDEX ON {quoted(t.name)} ({quoted(self.spec.fk)})" for t in self.spec.tables[1:]]

    def foreign_keys(self) -> list[str]:
        if not self.fk:
            return []
        return [f"ALTER TABLE {quoted(t.name)} ADD FOREIGN KEY ({quoted(self.spec.fk)}) REFERENCES {quoted(self.spec.root.name)}({quoted(self.spec.pk)})" for t in self.spec.tables[1:]]
