"""A landing folder: every new file of records is shredded and appended to the tables.

An addition of this engine: batch dumps are the rule. Each line of a landed file is one record's XML;
a micro-batch is staged once and appended to all tables, exactly once per batch number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import shred
from ..plans.entities import EntitySpec


def shred_stream(spark: SparkSession, landing: str, spec: EntitySpec, output: str, checkpoint: str) -> StreamingQuery:
    """Process what has landed, then stop. Tables are written to <output>/<table>/batch=<n>, so a repeated batch replaces its own rows."""
    records = spark.readStream.format("text").load(landing).where(F.col("value").rlike(r"\S")).select(F.col("value").alias("xml"))

    def append(batch: DataFrame, number: int) -> None:
        path = f"{checkpoint.rstrip('/')}/stage/{number}"
        shred.stage(batch, spec).write.mode("overwrite").parquet(path)
        staged = spark.read.parquet(path)
        for t in spec.tables:
            shred.project(staged, spec, t.name).write.mode("overwrite").parquet(f"{output.rstrip('/')}/{t.name}/batch={number}")

    return records.writeStream.foreachBatch(append).option("checkpointLocation", f"{checkpoint.rstrip('/')}/log").trigger(availableNow=True).start()
