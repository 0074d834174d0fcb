"""Repeated passages by windows grouped by a run of words inside them.

This stands in for prefix-partitioned suffix trees: no tree is built, and neither deeper nodes nor maximal repeats are
found.  A window is 50 consecutive words.  Every window is filed under one run of ``PREFIX`` words within it, chosen by
hash, so that equal windows are filed alike; runs that only one document holds are dropped at once.  Consecutive windows
with one run travel as one segment: its place and a hash of its words.  Windows of equal segments are equal; only where
the segments of a run differ are the words of each different one fetched, once, and within such a group equal windows are
found by sorting, and each knows the smallest document that holds it.  A run with more windows than fit in memory is
grouped by the hash of the whole window instead.  The texts themselves are shuffled once, for the words and for the cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import CHUNK_BYTES, checkpointed, col, hashed_words, rolled, row_chunks, spans, texts

WINDOW = 50
PREFIX = 20
# Suffixes of a group that are sorted together: 200 bytes each.
GROUP_SUFFIXES = 100_000
BATCH_SUFFIXES = 50_000


def _words(items: list[bytes | None]) -> Iterator[np.ndarray]:
    """Word hashes of each text."""
    for part in row_chunks(items):
        words, counts = hashed_words([x or b"" for x in items[part]])
        yield from np.split(words, np.cumsum(counts)[:-1])


def _chosen(words: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each window's prefix (the leftmost smallest hash), and the prefix hashes by place."""
    grams = rolled(words, prefix)
    span = window - prefix + 1
    if len(grams) < span:
        return np.zeros(0, np.int64), grams
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    return np.arange(len(view)) + view.argmin(axis=1), grams


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(col(id_col).cast("bigint").alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))


def _document_prefixes(plain: DataFrame, window: int, prefix: int) -> DataFrame:
    """(gram, id): the prefixes that file some window of a document."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(grams[np.unique(at)]) for at, grams in (_chosen(w, window, prefix) for w in _words(texts(batch, "text")))]
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            grams = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            ids = batch.column(0).take(pa.array(owner, pa.int64()))
            for i in range(0, len(grams), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(grams[i:i + 50_000]), ids[i:i + 50_000]], names=["gram", "id"])

    return plain.filter("id is not null").mapInArrow(emit, "gram bigint, id bigint")


def _segments(plain: DataFrame, window: int, prefix: int) -> DataFrame:
    """The runs of a document's windows under one prefix, at most ``window - prefix + 1`` windows each.

    ``key`` is a hash of all words of the run: under one prefix, runs with equal keys have equal words.  Where a text goes
    in circles, a run follows itself: it is one row with ``times``.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            empty = np.zeros(0, np.int64)
            owner, rows = [], [(empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty)]
            for words in _words(texts(batch, "text")):
                at, grams = _chosen(words, window, prefix)
                start = np.flatnonzero(np.concatenate([[len(at) > 0], at[1:] != at[:-1]]))
                n = np.diff(np.append(start, len(at)))
                gram, key = grams[at[start]], spans(words, start, start + n + window - 1)
                first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])])[:len(start)])
                owner.append(len(first))
                rows.append((gram[first], key[first], start[first], n[first], np.diff(np.append(first, len(start)))))
            gram, key, start, n, times = (np.concatenate(x) for x in zip(*rows))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(owner)), owner), pa.int64()))
            for i in range(0, len(gram), 50_000):
                part = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[part].view(np.int64)), pa.array(key[part].view(np.int64)), ids[part],
                     pa.array(start[part], pa.int32()), pa.array(n[part], pa.int32()), pa.array(times[part], pa.int32())],
                    names=["gram", "key", "id", "start", "n", "times"])

    return plain.filter("id is not null").mapInArrow(emit, "gram bigint, key bigint, id bigint, start int, n int, times int")


def _spelled(plain: DataFrame, keys: DataFrame, window: int) -> DataFrame:
    """(gram, key, low, words): one run for each key, with 32-bit hashes of its words, read where the key stands first.

    Rows of one id may hold different texts; the run comes from those that have it.
    """
    asked = keys.groupBy(F.col("least.id").alias("id")).agg(F.collect_list(F.struct("gram", "key", "least.start", "n")).alias("asked"))
    schema = pa.schema([("gram", pa.int64()), ("key", pa.int64()), ("low", pa.int64()), ("words", pa.binary())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())
            rows, size = [], 0
            for low, wanted, words in zip(batch.column(0).to_pylist(), batch.column(2), _words(texts(batch, "text"))):
                gram, key, start, n = (wanted.values.field(i).to_numpy() for i in range(4))
                end = start + n + window - 1
                here = np.flatnonzero(end <= len(words))
                here = here[spans(words, start[here], end[here]).view(np.int64) == key[here]]
                short = words.astype(np.uint32)
                for r in here.tolist():
                    rows.append((int(gram[r]), int(key[r]), low, short[start[r]:end[r]].tobytes()))
                    size += len(rows[-1][-1])
                if size > CHUNK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    # The outer form keeps the texts' exchange equal to the one that the cut reads, so that Spark makes it once.
    return plain.join(asked, "id", "left").select("id", "text", "asked").mapInArrow(emit, "gram bigint, key bigint, low bigint, words binary")


def _suffixes(segments: list[tuple], window: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the segments (low, words) as fixed-length byte strings, and each one's smallest document."""
    words = [np.frombuffer(s[-1], np.uint32) for s in segments]
    base, starts = 0, []
    for w in words:
        starts.append(base + np.arange(len(w) - window + 1))
        base += len(w)
    low = np.repeat(np.array([s[-2] for s in segments], np.int64), [len(x) for x in starts])
    rows = np.concatenate(words)[np.concatenate(starts)[:, None] + np.arange(window)]
    return np.ascontiguousarray(rows).view(f"S{4 * window}").ravel(), low


def _smallest(segments: list[tuple], window: int) -> list[np.ndarray]:
    """For each window of each segment the smallest document below its node of the suffix tree."""
    suffixes, low = _suffixes(segments, window)
    order = np.argsort(suffixes, kind="stable")
    ranked = suffixes[order]
    # Neighbours whose common prefix spans the window hang below one node.
    node = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    best = np.repeat(np.minimum.reduceat(low[order], node), np.diff(np.append(node, len(order))))
    out = np.empty(len(low), np.int64)
    out[order] = best
    return np.split(out, np.cumsum([len(s[-1]) // 4 - window + 1 for s in segments])[:-1])


def _subtrees(groups: DataFrame, window: int) -> DataFrame:
    """From runs sorted by prefix and key: per run, the smallest document that holds each of its windows."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ready: list[tuple]) -> pa.RecordBatch:
            found = _smallest(ready, window)
            return pa.RecordBatch.from_arrays([pa.array([s[0] for s in ready], pa.int64()), pa.array([s[1] for s in ready], pa.int64()),
                                               pa.array(found, pa.list_(pa.int64()))], names=["gram", "key", "lows"])

        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:2] == held[-1][:2]:
                    continue
                if size >= BATCH_SUFFIXES and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[-1]) // 4 - window + 1
        if held:
            yield flush(held)

    return groups.mapInArrow(build, "gram bigint, key bigint, lows array<bigint>")


def _whole_windows(large: DataFrame, window: int) -> DataFrame:
    """As ``_subtrees`` for groups of any size: equal windows meet by their 128-bit hash, combined by each task."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, key, place, h1, h2, low = [], [], [], [], [], []
            for a, b, doc, data in zip(*(c.to_pylist() for c in batch.columns)):
                words = np.frombuffer(data, np.uint32).astype(np.uint64)
                h = rolled(words + np.uint64(1), window)
                g = rolled(words * words + np.uint64(0x9E3779B9), window)
                gram += [a] * len(h)
                key += [b] * len(h)
                place += range(len(h))
                low += [doc] * len(h)
                h1.append(h.view(np.int64))
                h2.append(g.view(np.int64))
            empty = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(key, pa.int64()), pa.array(place, pa.int32()),
                                              pa.array(np.concatenate(h1 or empty)), pa.array(np.concatenate(h2 or empty)), pa.array(low, pa.int64())],
                                             names=["gram", "key", "place", "h1", "h2", "low"])

    rows = large.mapInArrow(emit, "gram bigint, key bigint, place int, h1 bigint, h2 bigint, low bigint")
    nodes = rows.groupBy("h1", "h2").agg(F.min("low").alias("least"))
    found = rows.join(nodes, ["h1", "h2"]).groupBy("gram", "key").agg(F.sort_array(F.collect_set(F.struct("place", "least"))).alias("p"))
    return found.select("gram", "key", F.col("p.least").alias("lows"))


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefix: int = PREFIX,
                   group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """(id, starts): the documents with the starts of windows that a document with a smaller id also holds.

    Words are what stands between blanks, unchanged.  Windows are compared by word hashes.  Texts with fewer words than
    a window (also null and empty ones) have none, nor have rows with null ids.  Rows with equal ids are one document
    here.  Documents without repeated windows do not appear.
    """
    plain = _plain(docs, id_col, text_col)
    filed = _document_prefixes(plain, window, prefix)
    shared = filed.groupBy("gram").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("gram")
    segments = checkpointed(_segments(plain, window, prefix).join(shared, "gram"))
    distinct = segments.groupBy("gram", "key").agg(F.min(F.struct("id", "start")).alias("least"), F.max("n").alias("n"))
    sizes = distinct.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum("n").alias("suffixes"))
    keys = checkpointed(distinct.join(sizes, "gram"))
    # Equal runs have equal windows: only where the runs of a prefix differ are words compared.
    lows = keys.filter("kinds = 1").select("gram", "key", F.array_repeat("least.id", F.col("n")).alias("lows"))
    several, fits = keys.filter("kinds > 1"), F.col("suffixes") <= group_suffixes
    fitting = _spelled(plain, several.filter(fits), window)
    lows = lows.union(_subtrees(fitting.repartition("gram").sortWithinPartitions("gram", "key"), window))
    large = several.filter(~fits)
    if not large.isEmpty():
        lows = lows.union(_whole_windows(_spelled(plain, large, window), window))
    places = lambda i: F.sequence(F.col("start") + i, F.col("start") + i + F.col("n") * (F.col("times") - 1), F.col("n"))
    older = F.flatten(F.filter(F.transform("lows", lambda low, i: F.when(low < F.col("id"), places(i))), lambda s: s.isNotNull()))
    hits = segments.join(lows, ["gram", "key"]).select("id", older.alias("starts")).filter(F.size("starts") > 0)
    return hits.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, text, n_words, n_removed): every document with the words outside repeated windows, joined by blanks.

    A word goes where any window that covers it also starts in a document with a smaller id; windows are judged on the
    whole input.  Null texts read as empty.  Documents with null ids keep their words.
    """
    plain = _plain(docs, id_col, text_col)
    marked = plain.join(repeated_words(docs, id_col, text_col, window), "id", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts, removed = [], [], []
            for text, starts in zip(texts(batch, "text"), batch.column(2).to_pylist()):
                words = text.split()
                if starts:
                    edge = np.zeros(len(words) + 1, np.int32)
                    at = np.array(starts)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed.append(int(gone.sum()))
                    counts.append(len(words))
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    removed.append(0)
                    counts.append(len(words))
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())],
                                             names=["id", "text", "n_words", "n_removed"])

    return marked.select("id", "text", "starts").mapInArrow(cut, "id bigint, text string, n_words bigint, n_removed bigint")
