"""A whole run: read, stage, project, write, finalize, with counts and timings."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .operators import audit, shred
from .plans.entities import EntitySpec, get, table_groups
from .sinks.base import Sink
from .sources.dumps import EmptyDump, Job, MalformedDump, named_error, read_records


@dataclass
class Config:
    job: Job
    sink: Sink
    #: Where the staged table goes: a folder that all tasks share.
    stage_dir: str
    chunk_mb: int = 256
    parse_partitions: int | None = None
    write_threads: int = 3
    strict: bool = False
    profile: bool = False
    keep_stage: bool = False


@dataclass
class Result:
    records: int = 0
    skipped: int = 0
    t_stage: float = 0.0
    t_write: float = 0.0
    t_finalize: float = 0.0
    unknown: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    #: Seconds that each table took to write, and that it waited for its turn.
    tables: dict[str, float] = field(default_factory=dict)
    waits: dict[str, float] = field(default_factory=dict)

    @property
    def t_total(self) -> float:
        return self.t_stage + self.t_write + self.t_finalize


def stage_dump(spark: SparkSession, config: Config, spec: EntitySpec) -> tuple[DataFrame, dict, list[str]]:
    """Parse the dump once into the staged table; in strict mode the same pass looks for what is not known."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", f"{config.chunk_mb}m")
    path = f"{config.stage_dir.rstrip('/')}/{spec.name}"
    try:
        records = read_records(spark, config.job.path, spec, partitions=config.parse_partitions)
        keep = ["closed"]
        if config.strict:
            records, keep = audit.with_unknown(records, spec), ["closed", "unknown"]
        counted, seen = audit.observed(shred.stage(records, spec, "xml", None, *keep))
        counted.write.mode("overwrite").parquet(path)
    except Exception as e:
        raise named_error(config.job.path, e) from e
    counts = seen.get
    if not counts["records"] + counts["skipped"]:
        raise EmptyDump(f"{config.job.path}: no <{spec.row_tag}> found")
    if not counts["closed"]:
        raise MalformedDump(f"{config.job.path}: does not end with </{spec.row_tag}>")
    staged = spark.read.schema(counted.schema).parquet(path)
    return staged.drop(*keep), counts, audit.unknown_names(staged) if config.strict else []


def run(spark: SparkSession, config: Config) -> Result:
    spec = get(config.job.entity)
    result = Result()
    case, split = spark.conf.get("spark.sql.caseSensitive"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.caseSensitive", "true")  # names of elements are
    try:
        config.sink.prepare(spark, spec)
        began = time.perf_counter()
        staged, counts, result.unknown = stage_dump(spark, config, spec)
        result.records, result.skipped = counts["records"], counts["skipped"]
        result.t_stage = time.perf_counter() - began

        began = time.perf_counter()

        def write(names: list[str]) -> None:
            for name in names:
                at = time.perf_counter()
                result.waits[name] = at - began
                config.sink.write(name, shred.project(staged, spec, name), spec)
                result.tables[name] = time.perf_counter() - at

        # Groups of tables of about equal weight are written side by side.
        groups = table_groups(config.write_threads if config.sink.concurrent else 1, spec)
        if len(groups) > 1:
            with ThreadPoolExecutor(len(groups)) as pool:
                list(pool.map(write, groups))
        else:
            write(groups[0])
        result.t_write = time.perf_counter() - began
        began = time.perf_counter()
        result.notes = config.sink.finalize(spark, spec)
        result.t_finalize = time.perf_counter() - began
        return result
    finally:
        spark.conf.set("spark.sql.caseSensitive", case)
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        if not config.keep_stage:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{config.stage_dir.rstrip('/')}/{spec.name}")
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
