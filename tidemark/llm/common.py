"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schema import col, quoted
from ..sources.scratch import checkpointed, scratch_path
from ..sources.tables import table

__all__ = ["appended", "ascii_lower", "byte_table", "checkpointed", "col", "documents", "hashed_words", "quoted",
           "replaced", "row_chunks", "rolled", "scratch_path", "spans", "table", "texts", "unused"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Bytes of text handled at once inside a task: bounds the arrays a task holds, whatever the size of an Arrow batch.
CHUNK_BYTES = 1 << 20


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; letters outside ASCII stay as they are."""
    return F.translate(text, UPPER, LOWER)


def byte_table(keep: Callable[[int], bool], lower: bool) -> bytes:
    """A table for ``bytes.translate``: bytes that are not kept become blanks."""
    out = bytearray(b" " * 256)
    for b in range(256):
        if keep(b):
            out[b] = b + 32 if lower and 65 <= b <= 90 else b
    return bytes(out)


def texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A text column as UTF-8 bytes; null stays None."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def row_chunks(items: list[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Slices of a batch of at most ``limit`` bytes of text (a longer text stands alone)."""
    start = size = 0
    for i, x in enumerate(items):
        length = len(x or b"")
        if i > start and size + length > limit:
            yield slice(start, i)
            start, size = i, 0
        size += length
    if start < len(items):
        yield slice(start, len(items))


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that the table does not hold yet, whatever it calls its own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        free = next(n for n in itertools.chain([name], (f"{name}_{i}" for i in itertools.count(1))) if n.lower() not in taken)
        taken.add(free.lower())
        out.append(free)
    return out


def appended(df: DataFrame, fields: str) -> T.StructType:
    """The schema of the table with further columns at its end."""
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(fields).fields])


def replaced(batch: pa.RecordBatch, name: str, values: list) -> pa.RecordBatch:
    """The batch with one text column written anew."""
    i = batch.schema.get_field_index(name)
    columns = list(batch.columns)
    columns[i] = pa.array([None if v is None else v.decode("utf-8", "replace") for v in values], pa.string())
    schema = batch.schema.set(i, pa.field(name, pa.string()))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


# --- word hashes ---------------------------------------------------------------------------------
# A word's hash is a polynomial over random 64-bit values of its bytes; all words of a chunk come from one running sum.

BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
STEP = np.uint64(0xD6E8FEB86659FD93)
BYTES = np.random.Generator(np.random.PCG64(20240531)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
LETTER = np.ones(256, bool)
LETTER[[9, 10, 11, 12, 13, 32]] = False


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def hashed_words(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the blank-separated words of several texts, and each text's word count."""
    data = np.frombuffer(b" ".join(items) + b" ", np.uint8)
    letter = LETTER[data]
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    if letter[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    ends_of_text = np.cumsum([len(x) + 1 for x in items])
    counts = np.diff(np.searchsorted(starts, ends_of_text), prepend=0)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * _powers(BASE, len(data)), out=running[1:])
    back = _powers(UNBASE, len(data))
    words = (running[ends] - running[starts]) * back[starts] + (ends - starts).astype(np.uint64)
    return _mixed(words), counts


def rolled(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive word hashes."""
    size = len(words) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    # Doubling: the hash of a run of 2k words is made of those of two runs of k.
    runs, steps, done = {1: words}, {1: int(STEP)}, 1
    while done * 2 <= n:
        runs[done * 2] = runs[done][:len(words) - 2 * done + 1] * np.uint64(steps[done]) + runs[done][done:]
        steps[done * 2] = steps[done] ** 2 % 2 ** 64
        done *= 2
    total, at = np.zeros(size, np.uint64), 0
    while at < n:
        part = 1 << ((n - at).bit_length() - 1)
        total = total * np.uint64(steps[part]) + runs[part][at:at + size]
        at += part
    return _mixed(total)


def spans(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs ``words[start:end]``, of any lengths; they share nothing with those of ``rolled``."""
    running = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(_mixed(words) * _powers(BASE, len(words)), out=running[1:])
    back = _powers(UNBASE, len(words) + 1)
    return _mixed((running[ends] - running[starts]) * back[starts] + (ends - starts).astype(np.uint64))
