"""The life of a sink: prepare, write each table, finalize, close."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from ..plans.entities import EntitySpec


class OutputExists(Exception):
    """The target holds output already and overwriting was not asked for."""


class Sink(Protocol):
    def prepare(self, spark: SparkSession, spec: EntitySpec) -> None:
        """Check the target before the first write and make it ready."""

    def write(self, table: str, df: DataFrame, spec: EntitySpec) -> None:
        """Write one table; several may be written at a time if `concurrent`."""

    def finalize(self, spark: SparkSession, spec: EntitySpec) -> list[str]:
        """Keys, indexes, checks, after all tables; returns what there is to report."""

    def close(self) -> None:
        """Release what is held. Safe at any time, more than once."""

    concurrent: bool
