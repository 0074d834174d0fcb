"""Packing tokenised documents into fixed sequences by cutting-stock column generation.

Documents are cut into pieces of at most one sequence.  The histogram of piece lengths, in classes of ``GRAIN`` tokens,
is all that the plan needs: a linear program over filling patterns, whose columns are priced by a knapsack dynamic
program, decides how often each pattern is used.  Rounded patterns own intervals of ranks within each class, so every
piece finds its sequence from its own rank.  The driver holds the histogram and the patterns: their sizes depend on
the number of classes, never on the number of documents.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import checkpointed, col, texts

CAPACITY = 4096
GRAIN = 8
END = 2
# Words whose ids a task remembers; a full table is emptied and filled again.
CACHE_WORDS = 400_000
# The linear program ends when its value is proven to be this near to the optimum.
GAP = 5e-4
# Columns taken from one table of the pricing program.
BATCH_COLUMNS = 12
# Pricings between two fresh inversions of the basis.
REFRESH = 16


# Words whose tokens follow from the model alone: Latin letters (all in composed form) are one piece for the tokenizer, the
# signs behind them another.
PLAIN = re.compile(r"([a-z\u00DF-\u00F6\u00F8-\u024F]+)([.,!?;:]*)")
ASCII = re.compile(rb"([a-z]+)([.,!?;:]*)")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte outside ASCII in a byte-level vocabulary.

    Fixed rule of such vocabularies: printable Latin-1 bytes stand for themselves, the others for 256 and upwards.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordIds:
    """Token ids of blank-separated words.  The tokenizer never joins text across blanks, so words can be remembered."""

    def __init__(self, path: str):
        self.path = path
        self.tokenizer = None
        self.known: dict[bytes, bytes] = {}

    def __reduce__(self):
        # As a broadcast variable the tokenizer is loaded once in each Python worker.
        return WordIds, (self.path,)

    def load(self) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(self.path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()

    def encode(self, text: bytes) -> bytes:
        if self.tokenizer is None:
            self.load()
        words = text.lower().split()
        found = list(map(self.known.get, words))
        if None in found:
            for i, known in enumerate(found):
                if known is None:
                    found[i] = self.learn(words[i])
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        return b"".join(found)

    def learn(self, word: bytes) -> bytes:
        plain = ASCII.fullmatch(word)
        if plain:
            letters, signs = plain[1].decode(), plain[2]
        else:
            text = word.decode("utf-8", "replace")
            match = PLAIN.fullmatch(text.lower())
            if not match:
                out = self.known[word] = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
                return out
            letters, signs = match[1].encode().decode("latin-1").translate(self.letters), match[2].encode()
        if signs:
            base = word[:-len(signs)]
            out = (self.known.get(base) or self.learn(base)) + (self.known.get(signs) or self.learn(signs))
        else:
            out = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        self.known[word] = out
        return out


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32`` and ``doc_tokens``.

    A document is the ids of its text and the end token; a null or empty text is the end token alone.  Long documents
    are cut every ``capacity`` tokens.  Repeated rows give their pieces again; no rows give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(WordIds(tokenizer))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        mark = np.array([end], "<u4").tobytes()
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(texts(batch, text_col)):
                ids = words.encode(text or b"") + mark
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    part = ids[4 * start:4 * (start + capacity)]
                    at.append(i)
                    rows.append((start, len(part) // 4, zlib.crc32(part), total))
            columns = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)],
                                             names=[id_col, "start", "length", "ids_crc32", "doc_tokens"])
        # The words go with the task: an idle worker keeps no more than the tokenizer.
        words.known.clear()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(col(id_col), col(text_col).cast("string").alias(text_col)).mapInArrow(
        cut, f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def _priced(value: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The value of the best filling of a sequence, and good fillings, best first.

    ``value[c]`` is that of a piece of c + 1 units; the capacity is len(value).  One table of the knapsack program gives
    for each piece the best filling that holds it.
    """
    units = len(value)
    best, last = np.zeros(units + 1), np.full(units + 1, -1)
    for w in range(1, units + 1):
        gain = value[:w] + best[w - 1::-1][:w]
        c = int(np.argmax(gain))
        if gain[c] > best[w - 1] + 1e-12:
            best[w], last[w] = gain[c], c
        else:
            best[w], last[w] = best[w - 1], -1
    holding = value + best[units - 1::-1]
    patterns: dict[bytes, np.ndarray] = {}
    for first in np.argsort(-holding, kind="stable")[:4 * BATCH_COLUMNS].tolist():
        if holding[first] <= 1 + 1e-7 or len(patterns) == BATCH_COLUMNS:
            break
        pattern, w = np.zeros(units, np.int64), units - first - 1
        pattern[first] = 1
        while w > 0:
            if last[w] < 0:
                w -= 1
            else:
                pattern[last[w]] += 1
                w -= int(last[w]) + 1
        patterns.setdefault(pattern.tobytes(), pattern)
    return float(best[units]), list(patterns.values())


def plan_patterns(counts: np.ndarray, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """Filling patterns and how often each is used, for ``counts[c]`` pieces of c + 1 units and capacity len(counts).

    Column generation solves the linear program until the dual bound (prices scaled down by the best filling's value)
    proves it within ``gap`` of the optimum, or the same number of whole sequences.  Its basis is rounded down, and what is
    left is filled with the largest piece that still fits.  Every piece has a place.
    """
    units = len(counts)
    used = np.flatnonzero(counts)
    if not len(used):
        return []
    demand = counts[used].astype(float)
    columns = np.zeros((units, len(used)), np.int64)
    columns[used, np.arange(len(used))] = units // (used + 1)
    inverse = np.diag(1.0 / columns[used, np.arange(len(used))])
    x = inverse @ demand
    bound, centre, dual = 0.0, None, np.full(units, -1.0)
    for priced in itertools.count(1):
        if priced % REFRESH == 0:  # rounding errors of many exchanges
            inverse = np.linalg.inv(columns[used].astype(float))
            x = np.maximum(inverse @ demand, 0)
        total, prices = x.sum(), inverse.sum(axis=0)
        # Prices jump between degenerate bases, so they are held near those of the best bound.
        near = prices if centre is None else 0.7 * centre + 0.3 * prices
        for dual[used] in (near, prices):
            value, patterns = _priced(dual)
            feasible = dual[used] / max(value, 1.0)
            if demand @ feasible > bound:
                bound, centre = demand @ feasible, feasible
            if any(prices @ p[used] > 1 + 1e-7 for p in patterns):
                break
        else:
            break
        if total - bound <= gap * total or np.ceil(bound - 1e-6) >= np.ceil(total - 1e-6):
            break
        for pattern in patterns:
            # Earlier columns of the batch have moved the prices.
            if inverse.sum(axis=0) @ pattern[used] <= 1 + 1e-7:
                continue
            direction = inverse @ pattern[used]
            rows = np.flatnonzero(direction > 1e-7)
            ratio = x[rows] / direction[rows]
            tied = rows[ratio <= ratio.min() + 1e-9]
            leave = tied[np.argmax(direction[tied])]
            step = x[leave] / direction[leave]
            x -= step * direction
            x[leave] = step
            inverse[leave] /= direction[leave]
            others = np.flatnonzero((np.abs(direction) > 1e-12) & (np.arange(len(used)) != leave))
            inverse[others] -= np.outer(direction[others], inverse[leave])
            columns[:, leave] = pattern
    times = np.floor(np.maximum(x, 0) + 1e-7).astype(np.int64)
    plan = [(columns[:, i], int(t)) for i, t in enumerate(times) if t > 0]
    rest = np.maximum(counts - columns @ times, 0)
    while rest.any():
        room, pattern = units, np.zeros(units, np.int64)
        for c in np.flatnonzero(rest)[::-1]:
            n = min(room // (int(c) + 1), int(rest[c]))
            pattern[c] = n
            room -= n * (int(c) + 1)
            if not room:
                break
        n = int((rest[pattern > 0] // pattern[pattern > 0]).min())
        plan.append((pattern, n))
        rest -= n * pattern
    return plan


class Places:
    """Which ranks of a class each pattern takes."""

    def __init__(self, plan: list[tuple[np.ndarray, int]]):
        self.by_class: dict[int, tuple[np.ndarray, ...]] = {}
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        ranks: dict[int, int] = {}
        sequence = 0
        for pattern, times in plan:
            slot = 0
            for c in np.flatnonzero(pattern)[::-1].tolist():
                rows.setdefault(c, []).append((ranks.get(c, 0), sequence, int(pattern[c]), slot))
                ranks[c] = ranks.get(c, 0) + times * int(pattern[c])
                slot += int(pattern[c])
            sequence += times
        for c, own in rows.items():
            self.by_class[c] = tuple(np.array(x, np.int64) for x in zip(*own))

    def of(self, classes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and slot of each (class, rank)."""
        sequence, slot = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for c in np.unique(classes).tolist():
            at = np.flatnonzero(classes == c)
            first, base, copies, offset = self.by_class[c]
            i = np.searchsorted(first, ranks[at], side="right") - 1
            within = ranks[at] - first[i]
            sequence[at] = base[i] + within // copies[i]
            slot[at] = offset[i] + within % copies[i]
        return sequence, slot


def pack(pieces: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """The pieces (any table with ``start`` and ``length``) with ``sequence_id`` and ``offset``.

    Pieces of a sequence follow each other without gaps from offset 0 and hold at most ``capacity`` tokens.  Lengths
    are from 1 to ``capacity``, a multiple of ``grain``.  Ranks within a length class come from counts per salt and row
    numbers within one salt, so that a class with most of the rows is no single task's work.  The table is written once
    to the shared folder.
    """
    spark = pieces.sparkSession
    salts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = checkpointed(pieces.withColumns({
        "_class": F.ceil(F.col("length") / grain).cast("int") - 1,
        "_order": F.xxhash64(*map(col, pieces.columns))}).withColumn("_salt", F.pmod("_order", F.lit(salts)).cast("int")))
    sizes = sized.groupBy("_class", "_salt").count()
    counts = np.zeros(capacity // grain, np.int64)
    for row in sizes.groupBy("_class").agg(F.sum("count").alias("n")).collect():
        counts[row["_class"]] = row["n"]
    places = spark.sparkContext.broadcast(Places(plan_patterns(counts)))
    before = Window.partitionBy("_class").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_class", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy("_class", "_salt").orderBy("_order")
    ranked = (sized.withColumn("_rank", F.row_number().over(own) - 1).join(first, ["_class", "_salt"])
              .select(*map(col, pieces.columns), "_class", (F.col("_rank") + F.col("_first")).alias("_rank")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, classes, ranks = batch.columns
            found = places.value.of(classes.to_numpy(), ranks.to_numpy())
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, found)], names=[*batch.schema.names[:-2], "sequence_id", "_slot"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields]
    placed = ranked.mapInArrow(place, ", ".join([*fields, "sequence_id bigint", "_slot bigint"]))
    ahead = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).drop("_slot")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY) -> DataFrame:
    """Tokenises, cuts and packs whole documents: one row per piece."""
    return pack(token_pieces(docs, tokenizer, id_col, text_col, capacity), capacity)
