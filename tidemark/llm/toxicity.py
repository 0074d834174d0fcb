"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, drops accents, maps Greek, Cyrillic and full-width look-alikes to Latin letters and reads digits
and signs inside words as the letters they stand for.  The lexicon holds words and word beginnings whose presence in
labelled documents speaks for toxicity; exception phrases cancel the matches inside them.  Matches are weighted, related
to the length of the text, and turned into a score by a logistic curve fitted on the same labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import appended, col, texts, unused

# The classifier is fitted on at most so many labelled rows, chosen by the hash of their id.
MAX_LABELLED = 20_000
MAX_TERMS = 2_000
LEAST_DOCS = 4
STEM = range(4, 9)
# Harmless phrases that hold a lexicon word.
EXCEPTIONS = ("clown fish", "clown shoes", "idiot proof", "trash can", "trash bin", "trash bag", "pathetic fallacy",
              "pond scum", "sore loser board game", "moron test")

GREEK = dict(zip("αβεικνοπρτυχωηγ", "abeiknoprtyxwny"))
CYRILLIC = dict(zip("авеіјкмнорсѕтухԁһ", "abeijkmhopcstyxdh"))
SIGNS = dict(zip("013457@$!|", "oieastasil"))
IN_WORD = re.compile(r"(?<=[a-z])[013457@$!|]+(?=[a-z])|(?<![^\s])[013457@$](?=[a-z]{2})|(?<=[a-z]{2})[0134570@]+(?![^\s.,;:?])")
WORD = re.compile(r"[^\W\d_]+")


def _letters() -> dict[int, str]:
    """Accented and full-width letters by their plain form, and look-alikes of other scripts."""
    out = {}
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c)).lower()
        if plain != chr(point) and plain:
            out[point] = plain
    out |= {ord(c): x for c, x in (GREEK | CYRILLIC).items()}
    out |= dict.fromkeys(range(0x300, 0x370), "")
    return out | dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF), "")


LETTERS = _letters()


def folded(text: str) -> str:
    """Lower case, one blank between words, look-alikes and digits inside words as letters."""
    low = text.lower()
    if not low.isascii():
        low = low.translate(LETTERS)
    low = " ".join(low.split())
    return IN_WORD.sub(lambda m: "".join(SIGNS[c] for c in m[0]), low)


def terms(text: str) -> set[str]:
    """The distinct words of a text and, with a star, their beginnings."""
    words = set(WORD.findall(folded(text)))
    return words | {w[:n] + "*" for w in words for n in STEM if len(w) > n}


class Matcher:
    """The lexicon as an automaton; built in each worker."""

    def __init__(self, weights: dict[str, float], exceptions: Sequence[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term, weight in weights.items():
            plain = term.rstrip("*")
            # A word and the same word as a beginning share one entry: the beginning fits wherever the word does.
            old = self.automaton.get(plain, (0, 0.0, 0.0, False))
            whole, start = (old[1], weight) if term.endswith("*") else (weight, old[2])
            self.automaton.add_word(plain, (len(plain), whole, start, False))
        for phrase in exceptions:
            plain = folded(phrase)
            self.automaton.add_word(plain, (len(plain), 0.0, 0.0, True))
        self.automaton.make_automaton()

    def total(self, text: str | None) -> tuple[float, int, int]:
        """Weighted matches (the heaviest per word), their number, and the number of words."""
        plain = folded(text or "")
        best: dict[int, tuple[float, int]] = {}
        safe: list[tuple[int, int]] = []
        for end, (size, whole, start, exception) in self.automaton.iter(plain):
            first = end - size + 1
            if first and plain[first - 1].isalpha():
                continue
            ends = end + 1 == len(plain) or not plain[end + 1].isalpha()
            if exception:
                if ends:
                    safe.append((first, end))
                continue
            weight = max(start, whole) if ends else start
            if weight > best.get(first, (0.0, 0))[0]:
                best[first] = (weight, end)
        kept = [w for first, (w, end) in best.items() if not any(a <= first and end <= b for a, b in safe)]
        return math.fsum(kept), len(kept), plain.count(" ") + 1 if plain else 0


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]

    def features(self, found: tuple[float, int, int]) -> tuple[float, float, float]:
        """Bias, the summed weight, and the summed weight in relation to the length."""
        total, _, words = found
        return 1.0, math.log1p(total), math.log1p(1000 * total / (words + 50))

    def score(self, found: tuple[float, int, int]) -> float:
        z = sum(a * b for a, b in zip(self.curve, self.features(found)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def labelled(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, id_col: str = "doc_id",
             limit: int = MAX_LABELLED) -> DataFrame:
    """At most ``limit`` labelled documents outside the held-out rows, as (text, y); the labels' side is broadcast."""
    known = (labels.filter(~held_out).select(col(id_col).alias("_id"), col(label).cast("int").alias("y")).dropna()
             .groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(limit))
    return (docs.select(col(id_col).alias("_id"), "text").join(F.broadcast(known), "_id")
            .select(F.coalesce("text", F.lit("")).alias("text"), "y"))


def _term_counts(train: DataFrame) -> DataFrame:
    """Documents that hold a term, by label; counted within each task first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (toxic if y else clean).update(terms(text))
            every = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([toxic[t] for t in every], pa.int64()),
                                              pa.array([clean[t] for t in every], pa.int64())], names=["term", "toxic", "clean"])

    return (train.mapInArrow(count, "term string, toxic bigint, clean bigint")
            .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def _pruned(rows: list) -> dict[str, float]:
    """Beginnings that nearly always stand for one longer entry go: "path*" adds nothing to "pathetic" but false alarms."""
    counts = {r["term"]: r["toxic"] for r in rows}
    longer: dict[str, int] = {}
    for term, n in counts.items():
        plain = term.rstrip("*")
        for size in STEM:
            if size < len(plain):
                longer[plain[:size] + "*"] = max(longer.get(plain[:size] + "*", 0), n)
    return {r["term"]: float(r["w"]) for r in rows if longer.get(r["term"], 0) < 0.8 * r["toxic"]}


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge (none on the bias)."""
    beta, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def fit_toxicity(train: DataFrame, exceptions: Sequence[str] = EXCEPTIONS) -> ToxicityModel:
    """Learns terms, weights and curve from (text, y) rows; their number is the caller's bound (see ``labelled``).

    A term's weight is its smoothed log-odds; kept are those found in ``LEAST_DOCS`` toxic documents with odds of ten
    to one, the strongest ``MAX_TERMS``.  Without rows, or with one label only, the lexicon is empty and the score is
    the share of that label, smoothed.
    """
    train = train.persist()
    try:
        n = dict(train.groupBy("y").count().collect())
        n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
        odds = F.log((F.col("toxic") + 0.1) / (n_toxic + 1)) - F.log((F.col("clean") + 0.1) / (n_clean + 1))
        rows = (_term_counts(train).filter(F.col("toxic") >= LEAST_DOCS).withColumn("w", odds).filter(F.col("w") > math.log(10))
                .orderBy(F.col("toxic") * F.col("w"), "term", ascending=False).limit(MAX_TERMS).collect()) if n_toxic and n_clean else []
        model = ToxicityModel(_pruned(rows), tuple(exceptions), (0.0, 0.0, 0.0))
        found = train.mapInArrow(lambda batches: _matched(batches, model), "total double, n bigint, words bigint, y int").collect()
        x = np.array([model.features((r["total"], r["n"], r["words"])) for r in found]).reshape(-1, 3)
        y = np.array([r["y"] for r in found], float)
        share = math.log((n_toxic + 0.5) / (n_clean + 0.5))
        model.curve = _curve(x, y) if rows else (share, 0.0, 0.0)
        return model
    finally:
        train.unpersist()


def _matched(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    matcher = Matcher(model.weights, model.exceptions)
    for batch in batches:
        found = [matcher.total(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64()),
                                          pa.array([f[2] for f in found], pa.int64()), batch.column(1).cast(pa.int32())],
                                         names=["total", "n", "words", "y"])


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The documents with ``score`` (0 to 1) and ``matches`` (number of lexicon words) as last columns.

    Null and empty texts have no matches and the score of that.  Each row is scored by its whole text alone, so repeated
    rows score alike; added columns take other names where the table has such ones.
    """
    names = unused(docs, "score", "matches")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        matcher = Matcher(judge.weights, judge.exceptions)
        for batch in batches:
            found = [matcher.total(x.decode("utf-8", "replace") if x else "") for x in texts(batch, text_col)]
            extra = [pa.array([judge.score(f) for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *names])

    return docs.mapInArrow(score, appended(docs, f"`{names[0]}` double, `{names[1]}` bigint"))


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    scored = score_toxicity(docs, model, text_col)
    return scored.filter(col(scored.columns[-2]) < threshold).select(*map(col, docs.columns))
