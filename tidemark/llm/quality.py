"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes counts of character pairs (hashed) and of a few pseudo-terms for repetition, case, signs and word
length.  Inverse document frequencies come from every document.  A bounded sample of labelled documents gives the
latent directions (singular vectors) and the labelled vectors, which are broadcast; every document is compared with all
of them in blocks, and its nearest neighbours vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import appended, col, hashed_words, row_chunks, texts, unused

# The classifier is fitted on at most so many labelled rows, chosen by the hash of their id: 2 MB of vectors.
MAX_LABELLED = 8_000
DIMENSIONS = 64
NEIGHBOURS = 15
SHARPNESS = 6
BLOCK = 512
PAIRS, BINS, SHARES = 1024, 12, 5
TERMS = PAIRS + BINS * SHARES


def _classes() -> np.ndarray:
    """A class per byte: letters and ASCII signs by themselves; upper case, digits and bytes outside ASCII together."""
    out = np.arange(256, dtype=np.uint32)
    out[65:91], out[48:58], out[128:192], out[192:] = 65, 48, 128, 192
    return out


CLASSES = _classes()
SIGN = np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,'" for b in range(256)])
UPPER = np.array([65 <= b <= 90 for b in range(256)])
EDGES = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 0.95])


def term_matrix(items: list[bytes]) -> np.ndarray:
    """Weights of the terms of each text: 1 + log of the count, and 6 for the bins of its shares."""
    out = np.zeros((len(items), TERMS), np.float32)
    words, counts = hashed_words(items)
    ends = np.cumsum(counts)
    for i, item in enumerate(items):
        data = np.frombuffer(item, np.uint8)
        if len(data) > 1:
            kinds = CLASSES[data]
            pairs = (((kinds[:-1] << np.uint32(8)) | kinds[1:]) * np.uint32(2_654_435_761)) >> np.uint32(22)
            found = np.bincount(pairs, minlength=PAIRS)
            at = np.flatnonzero(found)
            out[i, at] = 1 + np.log(found[at])
        own = words[ends[i] - counts[i]:ends[i]]
        if len(own):
            shares = (len(np.unique(own)) / len(own), np.mean(own[1:] == own[:-1]) if len(own) > 1 else 0.0,
                      UPPER[data].mean(), SIGN[data].mean(), min(1.0, len(data) / len(own) / 20))
            out[i, PAIRS + BINS * np.arange(SHARES) + np.searchsorted(EDGES, shares)] = 6
    return out


@dataclass
class QualityModel:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray

    def latent(self, items: list[bytes]) -> np.ndarray:
        z = (term_matrix(items) * self.idf) @ self.axes
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        return z / np.where(norm > 0, norm, 1)

    def scores(self, items: list[bytes], k: int = NEIGHBOURS) -> np.ndarray:
        """Similarity-weighted share of good neighbours; texts without terms get the share of good labels."""
        prior = float(self.votes.mean()) if len(self.votes) else 0.5
        if not len(self.votes):
            return np.full(len(items), prior)
        z = self.latent(items)
        close = z @ self.vectors.T
        k = min(k, close.shape[1])
        near = np.argpartition(close, close.shape[1] - k, axis=1)[:, -k:]
        weight = np.maximum(np.take_along_axis(close, near, axis=1), 0).astype(float) ** SHARPNESS
        score = ((weight * self.votes[near]).sum(axis=1) + 1e-3 * prior) / (weight.sum(axis=1) + 1e-3)
        return np.where(np.abs(z).sum(axis=1) > 0, score, prior)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """How many documents hold each term, and the number of documents; each task sends its sums."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            items = [x or b"" for x in texts(batch, text_col)]
            for part in row_chunks(items):
                found += (term_matrix(items[part]) > 0).sum(axis=0)
            n += len(items)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, TERMS)), pa.array(np.concatenate([[n], found]))], names=["term", "n"])

    rows = docs.select(col(text_col)).mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    by = {r["term"]: r["n"] for r in rows}
    return np.array([by.get(i, 0) for i in range(TERMS)]), by.get(-1, 0)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, id_col: str = "doc_id",
                limit: int = MAX_LABELLED, dimensions: int = DIMENSIONS) -> QualityModel:
    """Frequencies over all documents; axes and voters from at most ``limit`` labelled rows that are not held out."""
    df, n = document_frequencies(docs)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(0.1)
    known = (labels.filter(~held_out).select(col(id_col).alias("_id"), col(label).cast("int").alias("y")).dropna()
             .groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(limit))
    train = docs.select(col(id_col).alias("_id"), col("text")).join(F.broadcast(known), "_id").select("_id", "text", "y")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [x or b"" for x in texts(batch, "text")]
            for part in row_chunks(items):
                rows = term_matrix(items[part]) * idf
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array([r.tobytes() for r in rows], pa.binary()), batch.column(2)[part]],
                                                 names=["_id", "x", "y"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = train.mapInArrow(vectors, f"_id {kind}, x binary, y int").toArrow().sort_by([("_id", "ascending"), ("x", "ascending")])
    if not len(rows):
        return QualityModel(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(len(rows), TERMS)
    values, axes = np.linalg.eigh((x.T @ x).astype(float))
    axes = axes[:, np.argsort(values)[::-1][:dimensions]].astype(np.float32)
    z = x @ axes
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    return QualityModel(idf, axes, z / np.where(norm > 0, norm, 1), rows["y"].to_numpy().astype(float))


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The documents with ``score`` (0 to 1, higher is better) as last column, under a free name.

    Every row is scored by its whole text; null and empty texts have the share of good labels, equal texts equal
    scores.  Without labelled rows every score is 0.5.
    """
    name, = unused(docs, "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [x or b"" for x in texts(batch, text_col)]
            parts = [items[p.start:p.stop][i:i + BLOCK] for p in row_chunks(items) for i in range(0, p.stop - p.start, BLOCK)]
            found = np.concatenate([shared.value.scores(p) for p in parts]) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(score, appended(docs, f"`{name}` double"))
