"""Column classes, result schemas and small column helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

ISSUE_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("metric", T.DoubleType()),
])
ISSUE_COLUMNS = [f.name for f in ISSUE_SCHEMA]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact name, also when the name holds dots, spaces or backticks."""
    return F.col(quoted(name))


def _fields(df: DataFrame, exclude: Iterable[str]) -> list[T.StructField]:
    skip = set(exclude)
    return [f for f in df.schema.fields if f.name not in skip]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Integer, float and decimal columns; booleans are not numeric."""
    return [f.name for f in _fields(df, exclude) if isinstance(f.dataType, T.NumericType)]


def nested_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Array, map, struct and variant columns: the checks report them as unsupported."""
    kinds = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    return [f.name for f in _fields(df, exclude) if isinstance(f.dataType, kinds)]


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Every flat column that is not numeric: text, boolean, date, timestamp."""
    nested = set(nested_columns(df))
    numeric = set(numeric_columns(df))
    return [f.name for f in _fields(df, exclude) if f.name not in nested and f.name not in numeric]


def text_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return [f.name for f in _fields(df, exclude) if isinstance(f.dataType, T.StringType)]


def model_categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Columns a model one-hot encodes: text and boolean; dates are dropped."""
    kinds = (T.StringType, T.BooleanType)
    return [f.name for f in _fields(df, exclude) if isinstance(f.dataType, kinds)]


def flat_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    nested = set(nested_columns(df))
    return [f.name for f in _fields(df, exclude) if f.name not in nested]


def value(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing; negative zero equals zero."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col(name)), col(name) + F.lit(0.0))
    return col(name)


def comparable(df: DataFrame, name: str) -> Column:
    """As ``value``, with bytes as hex text, for counting and naming values."""
    x = value(df, name)
    return F.hex(x) if isinstance(df.schema[name].dataType, T.BinaryType) else x


def number(df: DataFrame, name: str) -> Column:
    """The column as a double with NaN read as missing."""
    return value(df, name).cast("double")


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"column(s) {missing} not found; available columns: {df.columns}")


def local_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small driver-made table (one row per column of an audited table); it becomes a local relation."""
    struct = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)
    columns = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), struct)


def materialise(small: DataFrame) -> DataFrame:
    """Runs a result of a few rows (one per column, band or bin) once, so that later uses do not rescan."""
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in small.schema])
    return small.sparkSession.createDataFrame(small.toArrow(), nullable)


def run_together(tasks: Mapping[str, Callable[[], DataFrame]], threads: int = 4) -> dict[str, DataFrame]:
    """Materialises independent small results; their jobs are submitted side by side to fill the cluster."""
    def run(make: Callable[[], DataFrame]) -> DataFrame:
        return materialise(make())

    if not tasks:
        return {}
    bound = inheritable_thread_target(SparkSession.active())
    with ThreadPool(min(threads, len(tasks))) as pool:
        done = {name: pool.apply_async(bound(run), (make,)) for name, make in tasks.items()}
        return {name: result.get() for name, result in done.items()}


def banded(metric: Column, bands: Sequence[tuple[float, str]], otherwise: str | None) -> Column:
    """The first label whose strict lower bound the metric exceeds."""
    out = None
    for bound, label in bands:
        cond = metric > F.lit(float(bound))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out if otherwise is None else out.otherwise(F.lit(otherwise))
