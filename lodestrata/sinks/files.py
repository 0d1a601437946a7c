"""Files: one folder per table under <output>/<entity>/, written by all tasks at once.

An empty table still gets its folder and, in Parquet, its schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.entities import EntitySpec
from .base import OutputExists

# Codecs by format.
PARQUET_CODECS = ("zstd", "snappy", "gzip", "none")
JSONL_CODECS = {"none": "", "gzip": ".gz", "bzip2": ".bz2"}


class _FileSink:
    concurrent = True

    def __init__(self, output: str, compression: str, overwrite: bool = False) -> None:
        self.output, self.compression, self.overwrite = str(output).rstrip("/"), compression, overwrite

    def suffix(self) -> str:
        raise NotImplementedError

    def path(self, spec: EntitySpec, table: str) -> str:
        return f"{self.output}/{spec.name}/{table}{self.suffix()}"

    def prepare(self, spark: SparkSession, spec: EntitySpec) -> None:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.output}/{spec.name}")
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not self.overwrite and fs.exists(folder):
            there = sorted(n for n in (s.getPath().getName() for s in fs.listStatus(folder)) if n.endswith(self.suffix()))
            if there:
                raise OutputExists(f"{self.output}/{spec.name} already holds {', '.join(there)}; use overwrite to replace it")

    def writer(self, df: DataFrame):
        return df.write.mode("overwrite" if self.overwrite else "errorifexists").option("compression", self.compression)

    def finalize(self, spark: SparkSession, spec: EntitySpec) -> list[str]:
        out = []
        for t in spec.tables:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(spec, t.name))
            size = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
            out.append(f"{self.path(spec, t.name)}: {size} bytes")
        return out

    def close(self) -> None:
        pass


class ParquetSink(_FileSink):
    def __init__(self, output: str, compression: str = "zstd", overwrite: bool = False) -> None:
        if compression not in PARQUET_CODECS:
            raise ValueError(f"Unsupported Parquet compression: {compression}; use {', '.join(PARQUET_CODECS)}")
        super().__init__(output, compression, overwrite)

    def suffix(self) -> str:
        return ".parquet"

    def write(self, table: str, df: DataFrame, spec: EntitySpec) -> None:
        self.writer(df).parquet(self.path(spec, table))


class JsonLinesSink(_FileSink):
    """A JSON object per row; nulls are written, text is not escaped to ASCII."""

    def __init__(self, output: str, compression: str = "none", overwrite: bool = False) -> None:
        if compression not in JSONL_CODECS:
            raise ValueError(f"Unsupported JSON Lines compression: {compression}; use {', '.join(JSONL_CODECS)}")
        super().__init__(output, compression, overwrite)

    def suffix(self) -> str:
        return ".jsonl" + JSONL_CODECS[self.compression]

    def write(self, table: str, df: DataFrame, spec: EntitySpec) -> None:
        self.writer(df).option("ignoreNullFields", "false").json(self.path(spec, table))
