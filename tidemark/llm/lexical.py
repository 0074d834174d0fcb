"""Ranked lexical search over all documents: accumulator-limited, term at a time.

One pass over the texts writes, for each document, its length and the frequencies of the terms that any query holds; the
corpus counts come from that table.  Each task then answers every query over its own documents: terms are taken rarest
first, and as soon as the bounds of the remaining terms cannot lift a new document over the kth partial score, no more
accumulators are made, and those that exist are completed exactly.  A first wave over a thirty-second of the documents
gives every query a score that its kth result is known to reach, from which all tasks start.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import byte_table, checkpointed, col, row_chunks, texts, unused

K = 20
# Distinct query terms that are looked up at once: bounds what is broadcast.
BLOCK_TERMS = 200_000
# One document in so many, chosen by the hash of its id, takes part in the first wave.
FIRST_WAVE = 32
# Documents scored at once inside a task.
CHUNK_ROWS = 8_192
# Saturation and length normalisation of the score, in whole numbers.
SCALE, SATURATION, LENGTH_FREE, LENGTH_SHARE = 1_000_000_000, 12, 75, 25

_LETTERS = byte_table(lambda b: b >= 128 or chr(b).isalnum(), lower=True)


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased."""
    return (text or b"").translate(_LETTERS).split()


@dataclass
class Query:
    """Its terms as numbers in the block's vocabulary, and how often it holds each."""

    terms: np.ndarray
    times: np.ndarray


@dataclass
class Statistics:
    """Counts over all documents: those with terms, their terms, and documents and weight of each query term."""

    documents: int
    length: int
    frequency: np.ndarray
    weight: np.ndarray
    most: np.ndarray


def _blocks(items: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[tuple[list, dict[bytes, int], list[Query]]]:
    """Items in blocks of at most ``limit`` distinct terms (an item with more stands alone)."""
    ids: list = []
    queries: list[Query] = []
    known: dict[bytes, int] = {}
    rows = items.select(col(id_col).alias("i"), col(text_col).cast("string").alias("t")).orderBy("i", "t")
    for row in rows.toLocalIterator():
        own: dict[bytes, int] = {}
        for t in terms(row["t"].encode() if row["t"] else None):
            own[t] = own.get(t, 0) + 1
        if not own:
            continue
        if known and len(known) + sum(t not in known for t in own) > limit:
            yield ids, known, queries
            ids, queries, known = [], [], {}
        numbers = np.array([known.setdefault(t, len(known)) for t in own], np.int64)
        ids.append(row["i"])
        queries.append(Query(numbers, np.fromiter(own.values(), np.int64, len(own))))
    if ids:
        yield ids, known, queries


def postings(docs: DataFrame, known: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, times): all documents with their lengths and the query terms that they hold."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        size = len(known)
        for batch in batches:
            items = texts(batch, text_col)
            for part in row_chunks(items):
                found = [terms(x) for x in items[part]]
                lengths = np.array([len(x) for x in found], np.int64)
                numbers = np.array([t for x in found for t in map(known.get, x, itertools.repeat(-1))], np.int64)
                rows = np.repeat(np.arange(len(found)), lengths)[numbers >= 0]
                cells, times = np.unique(rows * size + numbers[numbers >= 0], return_counts=True)
                offsets = pa.array(np.searchsorted(cells, np.arange(len(found) + 1) * size).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part.start:part.stop], pa.array(lengths), pa.ListArray.from_arrays(offsets, pa.array((cells % size).astype(np.int32))),
                     pa.ListArray.from_arrays(offsets, pa.array(times))], names=["id", "n", "terms", "times"])

    return docs.select(col(id_col).cast("bigint").alias("id"), col(text_col).cast("string").alias(text_col)).mapInArrow(
        count, "id bigint, n bigint, terms array<int>, times array<bigint>")


def _cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and frequency of each cell of a batch of postings."""
    lists, times = batch.column(2), batch.column(3)
    rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    return rows, lists.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy()


def _length_part(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    return LENGTH_FREE + (LENGTH_SHARE * n * documents) // max(length, 1)


def _gain(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (SCALE * times) // (1000 * times + SATURATION * m)


def statistics(index: DataFrame, size: int) -> Statistics:
    """Sums over all documents (each task sends its own), and the most that a term adds to any document."""
    whole = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    documents, length = int(whole[0]), int(whole[1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, most = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            rows, numbers, times = _cells(batch)
            frequency += np.bincount(numbers, minlength=size)
            np.maximum.at(most, numbers, _gain(times, _length_part(batch.column(1).to_numpy()[rows], documents, length)))
        held = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(frequency[held]), pa.array(most[held])], names=["term", "df", "most"])

    found = (index.mapInArrow(count, "term bigint, df bigint, most bigint").groupBy("term")
             .agg(F.sum("df").alias("df"), F.max("most").alias("most")).toArrow())
    frequency, most = np.zeros(size, np.int64), np.zeros(size, np.int64)
    at = found["term"].to_numpy()
    frequency[at], most[at] = found["df"].to_numpy(), found["most"].to_numpy()
    weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * frequency + 1))).astype(np.int64)
    return Statistics(documents, length, frequency, weight, most)


def search_part(query: Query, stats: Statistics, own: dict[int, tuple[np.ndarray, np.ndarray]], rows: int, k: int,
                least: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of one part that may be among the k best, with exact scores.

    ``own`` gives rows and gains of each term within the part; ``least`` is a score that the kth result reaches.
    """
    order = np.lexsort((query.terms, stats.frequency[query.terms]))
    numbers, times = query.terms[order], query.times[order]
    factor = times * stats.weight[numbers]
    ahead = np.append(np.cumsum((factor * stats.most[numbers])[::-1])[::-1], 0)
    score = np.zeros(rows, np.int64)
    alive = np.zeros(rows, bool)
    survivors = None
    for i, number in enumerate(numbers.tolist()):
        if survivors is None:
            held = int(alive.sum())
            kth = max(least, int(np.partition(score[alive], held - k)[held - k]) if held >= k else 0)
            if ahead[i] < kth:
                # What is still to come cannot lift a document without accumulator; those behind for good go too.
                survivors = np.flatnonzero(alive & (score + ahead[i] >= kth))
        if survivors is not None and not len(survivors):
            break
        if number not in own or not factor[i]:
            continue
        at, gain = own[number]
        if survivors is None:
            score[at] += factor[i] * gain
            alive[at] = True
        else:
            place = np.minimum(np.searchsorted(at, survivors), len(at) - 1)
            hit = at[place] == survivors
            score[survivors[hit]] += factor[i] * gain[place[hit]]
    if survivors is None:
        survivors = np.flatnonzero(alive)
    survivors = survivors[(score[survivors] >= least) & (score[survivors] > 0)]
    return survivors, score[survivors]


def _scored(index: DataFrame, queries: Sequence[Query], stats: Statistics, least: np.ndarray, k: int) -> DataFrame:
    """(query, id, score): of each chunk of documents the k best of each query, ties to the smaller id."""
    shared = index.sparkSession.sparkContext.broadcast((list(queries), stats, least))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, stats, least = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK_ROWS):
                batch = whole.slice(start, CHUNK_ROWS)
                rows, numbers, times = _cells(batch)
                ids = batch.column(0).to_numpy()
                gains = _gain(times, _length_part(batch.column(1).to_numpy()[rows], stats.documents, stats.length))
                order = np.argsort(numbers, kind="stable")
                rows, gains = rows[order], gains[order]
                held, first = np.unique(numbers[order], return_index=True)
                ends = np.append(first[1:], len(rows))
                own = {t: (rows[a:b], gains[a:b]) for t, a, b in zip(held.tolist(), first.tolist(), ends.tolist())}
                out: list[tuple[np.ndarray, ...]] = []
                for q, query in enumerate(queries):
                    found, points = search_part(query, stats, own, batch.num_rows, k, int(least[q]))
                    best = np.lexsort((ids[found], -points))[:k]
                    out.append((np.full(len(best), q), ids[found[best]], points[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query", "id", "score"])

    return index.filter("id is not null and n > 0").mapInArrow(score, "query bigint, id bigint, score bigint")


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; tasks keep no more than k of a query before the rows are moved."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank, id, score): the k documents of highest score above 0 for each item, ties to the smaller id.

    All documents are ranked by whole texts.  Null and empty texts have no terms; an item without terms or hits has no
    rows, repeated items have their rows each.  Repeated document rows are documents of their own.  Ids are whole
    numbers; a document without one counts in the statistics but cannot be named.  Items come in blocks of
    ``block_terms`` distinct terms, one pass over the texts each.
    """
    spark = docs.sparkSession
    name, rank, doc, points = item_col, *unused(items.select(col(item_col)), "rank", id_col, "score")
    kind = items.schema[item_col].dataType
    out = None
    for ids, known, queries in _blocks(items, item_col, item_text, block_terms):
        index = checkpointed(postings(docs, known, id_col, text_col))
        stats = statistics(index, len(known))
        least = np.zeros(len(queries), np.int64)
        first = index.filter(F.pmod(F.xxhash64("id"), F.lit(FIRST_WAVE)) == 0)
        # k rows of each query of a block
        for r in _best(_scored(first, queries, stats, least, k), k).filter(F.col("rank") == k).collect():
            least[r["query"]] = r["score"]
        named = spark.createDataFrame([(q, i) for q, i in enumerate(ids)], f"query bigint, item {kind.simpleString()}")
        found = (_best(_scored(index, queries, stats, least, k), k).join(F.broadcast(named), "query")  # one row an item of the block
                 .select(F.col("item").alias(name), F.col("rank").alias(rank), F.col("id").alias(doc), F.col("score").alias(points)))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"`{name}` {kind.simpleString()}, `{rank}` int, `{doc}` bigint, `{points}` bigint")
    return out
