"""The shared scratch folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schema import quoted


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a fresh local one only where none is set (tests)."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back from there: survives a lost executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The table as Parquet in the shared folder, read back column by column; ``by`` makes a folder per value."""
    path = scratch_path(df.sparkSession, name)
    # Parquet has no type for columns of nulls only.
    plain = df.select(*[F.col(quoted(f.name)).cast("string").alias(f.name) if isinstance(f.dataType, T.NullType) else F.col(quoted(f.name))
                        for f in df.schema.fields])
    writer = plain.write if by is None else plain.write.partitionBy(by)
    writer.parquet(path)
    return df.sparkSession.read.schema(plain.schema).parquet(path)
