"""Benchmark decontamination: exact n-gram hits of test items in training text.

The words of the benchmark become integers; its n-grams become a set of integer runs, broadcast in blocks of a stated
size.  Each task reads its documents once per block, looks up whole windows whose words all occur in the benchmark and
so verifies every hit by the words themselves.  Nothing but the documents' own rows leaves a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import appended, byte_table, checkpointed, col, replaced, texts, unused

WORD = byte_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128, lower=True)
WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
WINDOW = 10
# Words of benchmark text in one broadcast block, about 100 MB of sets; a larger benchmark is scanned in several blocks.
BLOCK_WORDS = 500_000


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges merged where they touch or overlap, ascending."""
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


class Windows:
    """The n-grams of one block of items, as runs of word numbers, by length."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.by_length: dict[int, dict[bytes, set[str]]] = {}
        for item, text in items:
            words = text.encode().translate(WORD).split()
            if not words:
                continue
            ids = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words), np.int32, len(words))
            size = min(n, len(words))
            found = self.by_length.setdefault(size, {})
            for i in range(len(words) - size + 1):
                found.setdefault(ids[i:i + size].tobytes(), set()).add(item)

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """The number of words, the hit word ranges (merged, ascending) and the items hit."""
        words = (text or b"").translate(WORD).split()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))
        known = np.zeros(len(words) + 1, np.int32)
        np.cumsum(ids > 0, out=known[1:])
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for size, found in self.by_length.items():
            if len(words) < size:
                continue
            for i in np.flatnonzero(known[size:] - known[:-size] == size).tolist():
                if hit := found.get(ids[i:i + size].tobytes()):
                    items |= hit
                    spans.append((i, i + size))
        return len(words), union(spans), sorted(items)


def _blocks(items: DataFrame, id_col: str, text_col: str, n: int, block_words: int) -> Iterator[Windows]:
    """The benchmark in blocks of at most ``block_words`` words (a longer item stands alone)."""
    block, size = [], 0
    rows = items.select(col(id_col).cast("string"), col(text_col).cast("string")).dropna()
    for item, text in rows.toLocalIterator():
        length = len(text.encode().translate(WORD).split())
        if block and size + length > block_words:
            yield Windows(block, n)
            block, size = [], 0
        block.append((item, text))
        size += length
    yield Windows(block, n)


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", n: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with ``words`` (count), ``hits`` (word ranges inside any benchmark window) and ``items`` (ids, as text).

    Words are lower-cased (A-Z) runs of ASCII letters, digits and bytes outside ASCII.  A window is ``n`` words of an
    item; an item with fewer words is one window; one without words (or null) has none.  Null or empty texts have no
    words and no hits.  Repeated rows are judged alike.  No documents or no items give no rows or no hits.  The added
    columns take other names where the table has such ones (see ``unused``); the other columns pass through.
    """
    names = unused(docs, "words", "hits", "items")
    fields = f"`{names[0]}` bigint, `{names[1]}` array<struct<start:int,end:int>>, `{names[2]}` array<string>"
    ranges = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    first, out = True, docs
    for windows in _blocks(items, item_col, item_text, n, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(windows)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, first=first) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                found = [index.scan(x) for x in texts(batch, text_col)]
                if not first:
                    known = zip(batch.column(names[1]).to_pylist(), batch.column(names[2]).to_pylist())
                    found = [(f[0], union([*f[1], *((h["start"], h["end"]) for h in hits)]), sorted({*f[2], *old}))
                             for f, (hits, old) in zip(found, known)]
                own = [c for c in batch.schema.names if first or c not in names]
                extra = [pa.array([f[0] for f in found], pa.int64()),
                         pa.array([[{"start": a, "end": b} for a, b in f[1]] for f in found], ranges),
                         pa.array([f[2] for f in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*map(batch.column, own), *extra], names=[*own, *names])

        # One block at a time in a worker's memory: a further block reads what the one before has written.
        out = (out if first else checkpointed(out)).mapInArrow(scan, appended(docs, fields))
        first = False
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", n: int = WINDOW,
                  drop_share: float = 1.0) -> DataFrame:
    """The documents without the words of benchmark windows; other characters stay as they are.

    A removed word range takes the blanks and signs between its words with it.  Documents without hits pass unchanged.
    Documents whose share of hit words reaches ``drop_share`` go.  Columns are those of the documents; ``n_chars``,
    where there is one, is counted anew for changed texts.
    """
    found = contamination(docs, items, text_col, n=n)
    words, hits, _ = found.columns[-3:]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [without(x, [(h["start"], h["end"]) for h in ranges]) if ranges else x
                   for x, ranges in zip(texts(batch, text_col), batch.column(hits).to_pylist())]
            yield replaced(batch, text_col, out)

    n_hit = F.aggregate(col(hits), F.lit(0), lambda n, h: n + h["end"] - h["start"])
    kept = found.filter((n_hit == 0) | (n_hit < F.lit(drop_share) * col(words)))
    out = kept.mapInArrow(cut, kept.schema)
    if "n_chars" in docs.columns:
        counted = F.when(F.size(col(hits)) > 0, F.length(col(text_col)).cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", counted.otherwise(col("n_chars")))
    return out.select(*map(col, docs.columns))


def without(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The text without the words of the ranges, from the first letter of the first to the last of the last."""
    at = [m.span() for m in WORDS.finditer(text)]
    out, last = [], 0
    for a, b in ranges:
        out.append(text[last:at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])
