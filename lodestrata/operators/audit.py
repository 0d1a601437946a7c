"""Audits of shredded tables and of the records they come from."""

from __future__ import annotations

from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import present
from ..plans.entities import EntitySpec


def duplicate_keys(root: DataFrame, pk: str = "id") -> DataFrame:
    """(key, n): keys that more than one row holds."""
    return root.groupBy(F.col(pk).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, root: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """Child rows whose key no root row has."""
    return child.join(root.select(F.col(pk).alias("_root")), F.col(fk) == F.col("_root"), "left_anti")


def orphan_counts(tables: dict[str, DataFrame], spec: EntitySpec) -> DataFrame:
    """(table_name, orphans) of the child tables that have any. They are reported, never an error."""
    root = tables[spec.root.name]
    parts = [orphans(tables[t.name], root, spec.fk, spec.pk).agg(F.count("*").alias("orphans")).select(F.lit(t.name).alias("table_name"), "orphans") for t in spec.tables[1:]]
    return reduce(DataFrame.unionByName, parts).where("orphans > 0")


def observed(staged: DataFrame, name: str = "shred") -> tuple[DataFrame, Observation]:
    """The staged table, counting as it is written: records with an id, and those skipped for want of one."""
    seen = Observation(name)
    has = present(F.col("record_id"))
    extra = [F.coalesce(F.sum(F.col("closed").cast("int")), F.lit(0)).alias("closed")] if "closed" in staged.columns else []
    return staged.observe(seen, F.count(F.when(has, 1)).alias("records"), F.count(F.when(~has, 1)).alias("skipped"), *extra), seen


# ---------------------------------------------------------------- strict mode


def _paths(kind: T.DataType, prefix: str = "") -> set[str]:
    """Paths of all declared elements and attributes."""
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    if not isinstance(kind, T.StructType):
        return set()
    out: set[str] = set()
    for f in kind.fields:
        if f.name != "_VALUE":
            path = f"{prefix}/{f.name}" if prefix else f.name
            out |= {path} | _paths(f.dataType, path)
    return out


def unknown_in(xml: str, declared: set[str]) -> set[str]:
    """Paths of one record that are not declared; what lies below an unknown element is not looked at."""
    out: set[str] = set()
    todo = [(ElementTree.fromstring(xml), "")]
    while todo:
        element, prefix = todo.pop()
        for name in element.attrib:
            if f"{prefix}_{name}" not in declared:
                out.add(f"{prefix}_{name}")
        for child in element:
            path = prefix + child.tag
            if path in declared:
                todo.append((child, path + "/"))
            else:
                out.add(path)
    return out


def with_unknown(records: DataFrame, spec: EntitySpec, column: str = "xml") -> DataFrame:
    """The records with `unknown`, the paths of each that its task has not yet met in another."""
    declared = _paths(spec.record)

    def run(batches):
        met: set[str] = set()
        for b in batches:
            fresh = []
            for x in b.column(column).to_pylist():
                new = unknown_in(x, declared) - met if x is not None else set()
                met.update(new)
                fresh.append(sorted(new))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fresh, pa.list_(pa.string()))], names=[*b.schema.names, "unknown"])

    return records.mapInArrow(run, T.StructType([*records.schema.fields, T.StructField("unknown", T.ArrayType(T.StringType()))]))


def unknown_names(table: DataFrame) -> list[str]:
    """All paths of the column `unknown`, sorted, each once: as many as there are different names, whatever the size of the dumps."""
    return [r["path"] for r in table.select(F.explode("unknown").alias("path")).distinct().orderBy("path").collect()]


def unknown_paths(records: DataFrame, spec: EntitySpec, column: str = "xml") -> list[str]:
    """Elements and attributes (with a leading _) that the records hold and the entity does not declare, sorted, each once."""
    return unknown_names(with_unknown(records.select(column), spec, column))
