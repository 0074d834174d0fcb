"""CSV reading with stable names, missing tokens and inferred types."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from ..config import MISSING_TOKENS, PANDAS_MISSING_TOKENS
from ..schema import col, require_columns, text_columns

SUPPORTED = (".csv",)
# Text that pandas reads as a whole or a real number, and as a boolean.
INTEGER = r"^[+-]?[0-9]+$"
REAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?([iI]nf(inity)?)$"
REPLACED = "\ufffd"  # what a byte that is no UTF-8 decodes to
BOOLEAN = ("True", "TRUE", "true", "False", "FALSE", "false")


def normalize_header(names: Sequence[str]) -> list[str]:
    """Trimmed names; the k-th repeat of a name becomes ``<name>__duplicate_<k>``."""
    seen: dict[str, int] = {}
    out = []
    for raw in names:
        name = str(raw).lstrip("﻿").strip()
        if name in seen:
            seen[name] += 1
            out.append(f"{name}__duplicate_{seen[name]}")
        else:
            seen[name] = 0
            out.append(name)
    return out


def rename_all(df: DataFrame) -> DataFrame:
    return df.toDF(*normalize_header(df.columns))


def _clean_text(c: Column, tokens: Sequence[str]) -> Column:
    trimmed = F.btrim(c, F.lit(" \t\n\r\f\v"))
    return F.when(~trimmed.isin(*tokens), trimmed)


def normalize_strings(df: DataFrame, cols: Sequence[str] | None = None,
                      tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """Trims text columns and turns missing tokens into nulls, in one projection."""
    cols = set(text_columns(df) if cols is None else cols)
    return df.select(*[_clean_text(col(c), tokens).alias(c) if c in cols else col(c) for c in df.columns])


def scan_text(df: DataFrame, cols: Sequence[str]) -> list[Row]:
    """One pass over text columns: per column, how many cells read as which type or hold broken text."""
    v = F.col("v")
    return (df.select(*[col(c) for c in cols]).unpivot([], [col(c) for c in cols], "feature", "v").groupBy("feature")
            .agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("present"), F.count_if(v.rlike(INTEGER) & v.try_cast("bigint").isNotNull()).alias("whole"),
                 F.count_if(v.rlike(REAL)).alias("real"), F.count_if(v.isin(*BOOLEAN)).alias("flag"),
                 F.count_if(v.contains(REPLACED)).alias("broken"))).collect()


def types_from(scan: Sequence[Row]) -> dict[str, str]:
    """Type per column: bigint, double, boolean or string.

    Whole numbers with gaps become double, and so does a column without any value.
    """
    found = {}
    for r in scan:
        present = r["present"]
        if present == r["whole"]:
            found[r["feature"]] = "bigint" if present == r["n"] and present else "double"
        elif present == r["real"]:
            found[r["feature"]] = "double"
        else:
            found[r["feature"]] = "boolean" if present == r["flag"] else "string"
    return found


def infer_types(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, str]:
    """Type per text column from one pass over the data."""
    cols = list(text_columns(df) if cols is None else cols)
    found = types_from(scan_text(df, cols)) if cols else {}
    return {c: found[c] for c in cols if c in found}


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.select(*[col(c).try_cast(types[c]).alias(c) if c in types and types[c] != "string" else col(c)
                       for c in df.columns])


def _exists(spark: SparkSession, path: str) -> bool:
    """Existence on whatever file system the path names; globs count when they match."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def check_file(spark: SparkSession, path: str) -> None:
    """The path must exist and be a CSV file, a folder of them, or a glob."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"file does not exist: {path}")
    last = path.rstrip("/").rsplit("/", 1)[-1]
    if "." in last and not last.lower().endswith(SUPPORTED):
        raise ValueError(f"unsupported file type {last!r}; supported: {list(SUPPORTED)}")


# A column behind the header's: what a row with too many fields leaves there.
SURPLUS = "__surplus_fields"


def _headers(spark: SparkSession, path: str, options: dict[str, str]) -> dict[tuple[str, ...], list[str]]:
    """The files under a path by their header line; only the beginning of each file is read."""
    files = sorted(spark.read.options(**options).csv(path).inputFiles()) or [path]
    with ThreadPool(min(16, len(files))) as pool:
        first = pool.map(lambda f: spark.read.options(**options).csv(f).first(), files)
    found: dict[tuple[str, ...], list[str]] = {}
    for file, row in zip(files, first):
        if row is not None:
            found.setdefault(tuple(normalize_header(["" if v is None else v for v in row])), []).append(file)
    return found


def _raw(spark: SparkSession, path: str, encoding: str, multiline: bool) -> DataFrame:
    """Cells as text.  Files whose columns stand in another order are matched by name."""
    options = {"header": "false", "encoding": encoding, "nullValue": "\u0000", "emptyValue": "", "quote": '"', "escape": '"',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "multiLine": str(multiline).lower()}
    groups = _headers(spark, path, options)
    if not groups:
        raise ValueError("the dataset has no rows or columns")
    names = next(iter(groups))
    out = None
    for header, files in groups.items():
        if sorted(header) != sorted(names):
            raise ValueError(f"{files[0]} has other columns than the first file: {sorted(set(header) ^ set(names))}")
        schema = T.StructType([T.StructField(n, T.StringType()) for n in (*header, SURPLUS)])
        part = spark.read.options(**{**options, "header": "true", "enforceSchema": "true"}).schema(schema).csv(files)
        out = part if out is None else out.unionByName(part)
    return out


def _clean(spark: SparkSession, path: str, encoding: str, multiline: bool) -> DataFrame:
    tokens = tuple(dict.fromkeys(MISSING_TOKENS + PANDAS_MISSING_TOKENS))
    raw = _raw(spark, path, encoding, multiline)
    return normalize_strings(raw, [c for c in raw.columns if c != SURPLUS], tokens)


def load_csv(spark: SparkSession, path: str, target: str | None = None, multiline: bool = True) -> DataFrame:
    """A typed table from a CSV file, folder or glob.

    Quoted cells may hold separators, doubled quotes and line ends.  Files with line ends in cells cannot be split, so
    each is one task's work; ``multiline=False`` splits large files whose rows are lines.  A row with fewer fields ends
    in missing cells, one with more is an error, as are files with different column names.

    Types come from one pass over the text, as tokens such as ``?`` would turn Spark's own inference to
    text.  The same pass sees cells whose bytes are no UTF-8; only then are the lines checked, and files
    that are really not UTF-8 are read as ISO-8859-1.
    """
    check_file(spark, path)
    clean = _clean(spark, path, "UTF-8", multiline)
    scan = scan_text(clean, clean.columns)
    if any(r["broken"] for r in scan) or any(REPLACED in c for c in clean.columns):
        if spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1).count() > 0:
            clean = _clean(spark, path, "ISO-8859-1", multiline)
            scan = scan_text(clean, clean.columns)
    if any(r["feature"] == SURPLUS and r["present"] for r in scan):
        raise ValueError(f"malformed rows: some hold more fields than the header's {len(clean.columns) - 1}")
    clean, scan = clean.drop(SURPLUS), [r for r in scan if r["feature"] != SURPLUS]
    if target is not None:
        require_columns(clean, [target])
    if not scan:
        raise ValueError("the dataset has no rows")
    return apply_types(clean, types_from(scan))


def require_rows(df: DataFrame) -> None:
    """An empty table is an error."""
    if not df.columns:
        raise ValueError("the dataset has no columns")
    if df.isEmpty():
        raise ValueError("the dataset has no rows")
