"""Writing audit results."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ..schema import col


def to_plain(value: Any) -> Any:
    """Rows and arrays as plain JSON values; anything else unknown as text."""
    if isinstance(value, Row):
        return {k: to_plain(v) for k, v in value.asDict().items()}
    if isinstance(value, Mapping):
        return {str(k): to_plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [to_plain(v) for v in value]
    if hasattr(value, "item") and callable(value.item):
        return value.item()
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def report_text(report: Mapping[str, Any]) -> str:
    return json.dumps(to_plain(report), indent=4, ensure_ascii=False)


def write_report(spark: SparkSession, report: Mapping[str, Any], path: str) -> None:
    """One JSON document through the Hadoop file system of the path, replacing an older one."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(target, True)
    try:
        out.write(bytearray(report_text(report).encode("utf-8")))
    finally:
        out.close()


def write_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Every result table below one folder, written in parallel by the executors."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{folder.rstrip('/')}/{name}")


def report_rows(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(section, row): all result rows as JSON text, for one appendable report table."""
    out = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("section"), F.to_json(F.struct(*[col(c) for c in df.columns]))
                         .alias("row"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no tables to report")
    return out
