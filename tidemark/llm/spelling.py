"""Spelling variants by a frequency-vector trie.

A word becomes a vector: its length, then how often it holds each letter group.  A trie arranges words by successive
counts of that vector.  Two words that differ by one inserted, deleted or replaced letter differ by at most one surplus
and one deficit, so a depth-first search spends a budget of one each, and the words of a leaf are verified letter by letter.

The vocabulary is spread over shards, the subtrees under prefixes of variable length: a prefix with too many words is
lengthened by the next letter groups.  A word is sent to the shards that its budget reaches (found by the same search in
the trie of the prefixes) and looks there for words of its own length or one letter shorter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, col, unused

MIN_LETTERS, MIN_COUNT = 7, 2
# A variant's form is at least so many times as frequent.
DOMINANCE = 10
# Words of a shard's own; a prefix with more is lengthened.
SHARD_WORDS = 20_000
# Words below a node that are verified without going deeper.
LEAF_WORDS = 8
# Letter counts that lengthen a prefix at once.
STEP_LEVELS = 4
# Distinct words that a counting task holds before it passes them on.
HELD_WORDS = 300_000
# Pairs verified at once, and words of a shard's visitors handled at once.
VERIFIED_PAIRS, VISITORS = 200_000, 100_000

# Letter groups: one for each of a-z, the likeliest first, so that the first levels part most words; one for the others.
ORDER = "etaoinsrhldcumfpgwybvkxjqz"
GROUPS = len(ORDER) + 1
_GROUP = np.full(256, len(ORDER), np.int64)
_GROUP[[ord(c) for c in ORDER]] = np.arange(len(ORDER))


def _letters() -> bytes:
    """Latin-1 letters (as the code points C0 to FF, signs there included) with A-Z lower-cased; blanks for the rest."""
    out = bytearray(b" " * 256)
    for b in range(256):
        if 97 <= b <= 122 or b >= 0xC0:
            out[b] = b
        elif 65 <= b <= 90:
            out[b] = b + 32
    return bytes(out)


_LETTERS = _letters()


def runs(text: str | None) -> list[bytes]:
    """Maximal runs of letters as Latin-1 bytes: one byte a code point."""
    return (text or "").encode("latin-1", "replace").translate(_LETTERS).split()


def noisy(word: bytes, prefix_crc: int) -> bytes:
    """One occurrence in 31, chosen by the checksum of ``<id>:<word>``, loses a letter."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), prefix_crc)
    if h % 31:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of at least seven letters with at least ``least`` occurrences over all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()),
                                              pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for i in range(batch.num_rows):
                own = Counter([w for w in runs(batch.column(1)[i].as_py()) if len(w) >= MIN_LETTERS])
                prefix = zlib.crc32(f"{batch.column(0)[i].as_py()}:".encode()) if own else 0
                for word, n in own.items():
                    held[noisy(word, prefix)] += n
                if len(held) > HELD_WORDS:
                    yield passed_on()
        yield passed_on()

    told = docs.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("id"), col(text_col).cast("string").alias("text"))
    return (told.mapInArrow(count, "word string, n bigint").filter(F.length("word") >= MIN_LETTERS)
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))


# --- the trie -------------------------------------------------------------------------------------------------------------

class Words:
    """Words in one buffer, with their vectors: the length, then the letter groups' counts.

    Counts end at 255: longer words differ less in their vectors than they do, so that no pair is lost.
    """

    def __init__(self, words: list[bytes]):
        self.words = words
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.length) - self.length
        self.letters = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        cells = np.repeat(np.arange(len(words)), self.length) * GROUPS + _GROUP[self.letters[:-1]]
        counts = np.bincount(cells, minlength=len(words) * GROUPS).reshape(len(words), GROUPS)
        self.vectors = np.minimum(np.column_stack([self.length, counts]), 255).astype(np.int16)
        self.head, self.tail = self._triple(self.start), self._triple(self.start + np.maximum(self.length - 3, 0))

    def _triple(self, at: np.ndarray) -> np.ndarray:
        """Three letters from each place as one number."""
        wide = np.append(self.letters, [0, 0, 0]).astype(np.int32)
        return wide[at] << 16 | wide[at + 1] << 8 | wide[at + 2]

    def padded(self, which: np.ndarray, width: int) -> np.ndarray:
        """The letters of some words as rows, zeros behind the last letter."""
        places = np.arange(width)
        inside = places < self.length[which][:, None]
        return np.where(inside, self.letters[np.where(inside, self.start[which][:, None] + places, 0)], 0)


@dataclass
class Node:
    """An inner node parts its words by ranges of one count; a leaf carries what its owner put there."""

    level: int = 0
    ranges: list[tuple[int, int]] = field(default_factory=list)
    below: list[Node] = field(default_factory=list)
    leaf: object = None


def visit(root: Node, words: Words, which: np.ndarray) -> Iterator[tuple[object, np.ndarray]]:
    """Depth-first: (leaf, words that reach it) within one surplus and one deficit.

    Words look for members of their own length or one letter shorter; the shorter ones have no surplus, so that
    their way starts with it spent.
    """
    stack = [(root, which, np.zeros(len(which), np.int8), np.zeros(len(which), np.int8))]
    while stack:
        node, own, surplus, deficit = stack.pop()
        if node.leaf is not None:
            yield node.leaf, own
            continue
        counts = words.vectors[own, node.level]
        for (low, high), child in zip(node.ranges, node.below):
            if node.level == 0:
                # Lengths: the same one, or one less.
                equal, less = (counts >= low) & (counts <= high), (counts - 1 >= low) & (counts - 1 <= high)
                kept = equal | less
                more, fewer = np.where(equal, 0, 1).astype(np.int8), deficit
            else:
                more = surplus + np.maximum(low - counts, 0).clip(0, 2).astype(np.int8)
                fewer = deficit + np.maximum(counts - high, 0).clip(0, 2).astype(np.int8)
                kept = (more <= 1) & (fewer <= 1)
            if kept.any():
                stack.append((child, own[kept], more[kept], fewer[kept]))


def word_trie(words: Words, leaf_words: int = LEAF_WORDS) -> Node:
    """The trie of some words; a leaf is an array of their numbers."""
    order = np.lexsort(words.vectors.T[::-1])
    vectors = words.vectors[order]
    root = Node()
    stack = [(root, 0, 0, len(order))]
    while stack:
        node, level, a, b = stack.pop()
        if b - a <= leaf_words or level > GROUPS:
            node.leaf = order[a:b]
            continue
        node.level = level
        counts = vectors[a:b, level]
        edges = [a, *(np.flatnonzero(np.diff(counts)) + a + 1).tolist(), b]
        for x, y in zip(edges, edges[1:]):
            child = Node()
            node.ranges.append((int(vectors[x, level]),) * 2)
            node.below.append(child)
            stack.append((child, level + 1, x, y))
    return root


def verified(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether words of ``a`` become those of ``b`` (as long, or one letter shorter) by one replacement or deletion."""
    out = np.zeros(len(i), bool)
    order = np.argsort(a.length[i], kind="stable")
    start = 0
    while start < len(order):
        # So many pairs at once that the padded letters stay small, however long a word is.
        width = int(a.length[i[order[start]]])
        end = start + 1
        while end < len(order) and (end - start) < max(1, (4 << 20) // max(1, int(a.length[i[order[min(end + 4095, len(order) - 1)]]]))):
            end = min(end + 4096, len(order))
        at = order[start:end]
        width = int(a.length[i[at[-1]]])
        x, y = a.padded(i[at], width), b.padded(j[at], width)
        differs = x != y
        same_length = a.length[i[at]] == b.length[j[at]]
        replaced = same_length & (differs.sum(axis=1) == 1)
        # Behind the first difference the shorter word follows one letter later.
        behind = np.arange(width)[None, :] > differs.argmax(axis=1)[:, None]
        later = x[:, 1:] != y[:, :-1]
        deleted = (a.length[i[at]] == b.length[j[at]] + 1) & ~(later & behind[:, 1:]).any(axis=1)
        out[at] = replaced | deleted
        start = end
    return out


def near_words(members: Words, visitors: Words, leaf_words: int = LEAF_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(visitor, member): pairs one edit apart; of two words of one length only the greater looks for the smaller."""
    trie = word_trie(members, leaf_words)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def check() -> None:
        i, j = (np.concatenate(x) for x in zip(*waiting))
        near = verified(visitors, i, members, j)
        found.append((i[near], j[near]))
        waiting.clear()

    for start in range(0, len(visitors.words), VISITORS):
        for leaf, own in visit(trie, visitors, np.arange(start, min(start + VISITORS, len(visitors.words)))):
            # One edit leaves the first or the last three letters as they are.
            q, m = np.nonzero((visitors.head[own][:, None] == members.head[leaf]) | (visitors.tail[own][:, None] == members.tail[leaf]))
            if len(q):
                waiting.append((own[q], leaf[m]))
                held += len(q)
            if held > VERIFIED_PAIRS:
                check()
                held = 0
    if waiting:
        check()
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j = (np.concatenate(x) for x in zip(*found))
    once = np.array([len(visitors.words[p]) > len(members.words[q]) or visitors.words[p] > members.words[q] for p, q in zip(i.tolist(), j.tolist())], bool)
    return i[once], j[once]


# --- shards ---------------------------------------------------------------------------------------------------------------

def _vectors(words: DataFrame) -> DataFrame:
    """The words with their vectors as bytes, one byte a count."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Words([w.encode("latin-1") for w in batch.column(0).to_pylist()])
            rows = own.vectors.astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in rows], pa.binary())], names=["word", "n", "vector"])

    return words.select("word", "n").mapInArrow(add, "word string, n bigint, vector binary")


@dataclass
class Shard:
    """A subtree: its number, and into how many parts its words are dealt where no count parts them further."""

    first: int
    parts: int


def shard_trie(vectors: DataFrame, limit: int = SHARD_WORDS) -> tuple[Node, int]:
    """The trie of prefixes, lengthened until each shard has at most ``limit`` words; also the number of shards.

    The driver holds counts per prefix: those of heavy prefixes only are counted further down, so that their number
    follows that of the shards.
    """
    counts: dict[bytes, int] = {b"": vectors.count()}
    below: dict[bytes, dict[int, int]] = {}
    depth, heavy = 0, [b""] if counts[b""] > limit else []
    while heavy and depth <= GROUPS:
        further = min(depth + STEP_LEVELS, GROUPS + 1)
        part = vectors
        if depth:
            wanted = vectors.sparkSession.createDataFrame([(bytearray(h),) for h in heavy], "above binary")
            # At most one heavy prefix in ``limit`` words.
            part = vectors.join(F.broadcast(wanted), F.substring("vector", 1, depth) == F.col("above"))
        rows = part.groupBy(F.substring("vector", 1, further).alias("p")).count().collect()
        for r in rows:
            p = bytes(r["p"])
            for level in range(depth, further):
                own = below.setdefault(p[:level], {})
                own[p[level]] = own.get(p[level], 0) + r["count"]
                counts[p[:level + 1]] = counts.get(p[:level + 1], 0) + r["count"]
        heavy = [bytes(r["p"]) for r in rows if r["count"] > limit]
        depth = further
    shards = 0

    def leaf(n: int) -> Node:
        nonlocal shards
        parts = max(1, -(-n // limit))
        shards += parts
        return Node(leaf=Shard(shards - parts, parts))

    def build(prefix: bytes) -> Node:
        if counts[prefix] <= limit or prefix not in below:
            return leaf(counts[prefix])
        node, light, held = Node(level=len(prefix)), [], 0
        for count, n in [*sorted(below[prefix].items()), (None, 0)]:
            # Small neighbours share a shard.
            if light and (count is None or held + n > limit):
                node.ranges.append((light[0], light[-1]))
                node.below.append(leaf(held))
                light, held = [], 0
            if count is None:
                break
            if n > limit:
                node.ranges.append((count, count))
                node.below.append(build(prefix + bytes([count])))
            else:
                light.append(count)
                held += n
        return node

    return build(b""), shards


def _home(root: Node, words: Words) -> np.ndarray:
    """The shard that holds each word."""
    out = np.zeros(len(words.words), np.int64)
    stack = [(root, np.arange(len(words.words)))]
    while stack:
        node, own = stack.pop()
        if node.leaf is not None:
            part = np.array([zlib.crc32(words.words[i]) % node.leaf.parts for i in own.tolist()], np.int64) if node.leaf.parts > 1 else 0
            out[own] = node.leaf.first + part
            continue
        counts = words.vectors[own, node.level]
        for (low, high), child in zip(node.ranges, node.below):
            stack.append((child, own[(counts >= low) & (counts <= high)]))
    return out


def _sent(words: DataFrame, root: Node, visiting: bool) -> DataFrame:
    """(shard, word, n): each word under its own shard, or under all shards that it has to visit."""
    shared = words.sparkSession.sparkContext.broadcast(root)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Words([w.encode("latin-1") for w in batch.column(0).to_pylist()])
            if not visiting:
                yield pa.RecordBatch.from_arrays([pa.array(_home(shared.value, own)), *batch.columns], names=["shard", "word", "n"])
                continue
            for shard, which in visit(shared.value, own, np.arange(len(own.words))):
                for part in range(shard.parts):
                    kept = batch.take(pa.array(which))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), shard.first + part)), *kept.columns], names=["shard", "word", "n"])

    return words.select("word", "n").mapInArrow(send, "shard bigint, word string, n bigint")


PAIRS = "word string, n bigint, other string, other_n bigint"


def _meet(members: pa.Table, visitors: pa.Table) -> pa.Table:
    a, b = ([w.encode("latin-1") for w in t["word"].to_pylist()] for t in (visitors, members))
    i, j = near_words(Words(b), Words(a)) if a and b else (np.empty(0, np.int64),) * 2
    own, other = visitors.take(pa.array(i)), members.take(pa.array(j))
    return pa.table({"word": own["word"], "n": own["n"], "other": other["word"], "other_n": other["n"]})


def near_pairs(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, n, other, other_n): all pairs of words one edit apart, each once."""
    root, _ = shard_trie(checkpointed(_vectors(words)), shard_words)
    members, visitors = _sent(words, root, False), _sent(words, root, True)
    return members.groupBy("shard").cogroup(visitors.groupBy("shard")).applyInArrow(_meet, PAIRS)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word of each chain of forms, by doubling; each step is ten times as frequent, so chains are short."""
    reached = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = checkpointed(reached.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"))
        if after.filter("further is not null").isEmpty():
            return after.select("word", "root")
        reached = after.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS,
                      dominance: int = DOMINANCE) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of whole texts with their likely right spellings.

    A word's form is its most frequent word one edit apart, the first in code-point order among equals, if it is
    ``dominance`` times as frequent; the root is where the chain of forms ends.  Null and empty texts have no words, a
    null id counts as empty text, repeated rows count again, and no words give no rows.
    """
    words = checkpointed(word_counts(docs, id_col, text_col))
    pairs = checkpointed(near_pairs(words, shard_words))
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"),
                                          F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("rank"), "other")).alias("best"))
    joined = checkpointed(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.rank") >= dominance * F.col("n"), F.col("best.other")).alias("form"),
        F.when(-F.col("best.rank") >= dominance * F.col("n"), -F.col("best.rank")).alias("form_n")))
    ends = roots(joined.filter("form is not null"))
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
