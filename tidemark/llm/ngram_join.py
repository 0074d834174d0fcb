"""Set-similarity self-join of documents on word n-grams, by prefixes under several global token orders.

Two sets of sizes m and n with Jaccard similarity of at least 3/4 share 3/7 (m + n) tokens, so under any total order of
all tokens they share one among the first n/4 + 1 tokens of each.  The first order puts frequent tokens last and finds
candidates by a shuffle on prefix tokens; positions and sizes bound the possible overlap.  Small sketches then bound from
below how many tokens two candidates do not share; those left must share a prefix token under two further orders, and
only the sets of the rest are moved and compared in full.  Equal sets are one node from the start.

A token shared by many nodes does not produce all their pairs: its nodes are compared with the few whose sets hold
hardly anything rarer.  What these links leave in different components is then joined within the token.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, col, hashed_words, rolled, row_chunks, texts
from .components import components

WORDS = 5
# Links need MATCH[0] * union <= MATCH[1] * intersection.
MATCH = (75, 100)
# Frequency classes are kept for token hashes modulo this number: one byte each, whatever the size of the corpus.
SLOTS = 1 << 20
# Bytes of text whose tokens a task counts at once.
COUNTED_BYTES = 32 << 20
# Nodes of one token that are all compared with each other; of more, LEADERS are compared with the others.
SMALL, LEADERS = 12, 4
# Ids of candidates that are broadcast: 16 bytes each.
BROADCAST_NODES = 1_000_000
# A prefix row holds the upper bits of its token and, in as many lower bits, its place.
PLACE_BITS = 24
ORDERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def token_sets(items: list[bytes | None], n: int = WORDS) -> Iterator[np.ndarray]:
    """The distinct n-gram hashes of each text (A-Z lower-cased), ascending; shorter texts are one n-gram."""
    for part in row_chunks(items):
        words, counts = hashed_words([(x or b"").lower() for x in items[part]])
        end = 0
        for count in counts.tolist():
            own = words[end:end + count]
            end += count
            yield np.unique(rolled(own, min(n, count))) if count else own


def prefix_size(n: int) -> int:
    part, whole = MATCH
    return n - -(-part * n // whole) + 1


def under(order: int, tokens: np.ndarray) -> np.ndarray:
    """Sort keys of a token order."""
    h = (tokens ^ (tokens >> np.uint64(31))) * ORDERS[order]
    return h ^ (h >> np.uint64(29))


def _node(data: bytes) -> int:
    """The first 64 bits of a set's digest."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=16).digest()[:8], "little", signed=True)


def set_sizes(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, n, d1, d2): size and 128-bit digest of each document's set; empty sets have digest 0."""
    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            for s in token_sets(texts(batch, text_col), n):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else bytes(16))
            pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1])],
                                             names=["id", "n", "d1", "d2"])

    plain = docs.select(col(id_col).cast("bigint").alias(id_col), col(text_col).cast("string").alias(text_col))
    return plain.mapInArrow(size, "id bigint, n bigint, d1 bigint, d2 bigint")


def frequency_classes(docs: DataFrame, text_col: str, n: int) -> np.ndarray:
    """A byte per slot of token hashes: the logarithm of how many documents share its tokens, as the tasks see them.

    A task counts tokens that two of its different sets hold.  The classes only order tokens, so they need not be exact.
    """
    def counted(items: list[bytes | None]) -> pa.RecordBatch:
        every = np.sort(np.concatenate([np.zeros(0, np.uint64), *token_sets(list(dict.fromkeys(items)), n)]))
        edge = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1], [True]]))
        times = np.diff(edge)
        again = times > 1
        slots = (every[edge[:-1][again]] % np.uint64(SLOTS)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(slots), pa.array(times[again])], names=["slot", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in texts(batch, text_col):
                held.append(text)
                size += len(text or b"")
                if size >= COUNTED_BYTES:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    rows = docs.select(col(text_col).cast("string").alias(text_col)).mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.uint8)
    out[rows["slot"].to_numpy()] = np.log2(rows["n"].to_numpy()).astype(np.uint8)
    return out


def _prefixes(docs: DataFrame, text_col: str, n: int, classes) -> DataFrame:
    """(key, node, n) rows of the first order's prefixes; a task gives equal sets once.

    A key is the upper 40 bits of a token and the token's place in the prefix.  Tokens that meet by these bits alone are
    candidates like others; places beyond the last one that fits count as it, which only loosens their bound.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = classes.value, set()
        for batch in batches:
            keys, nodes, sizes = [], [], []
            # Only spares repeated rows, so it may forget.
            if len(seen) > 500_000:
                seen.clear()
            for s in token_sets(texts(batch, text_col), n):
                if not len(s):
                    continue
                node = _node(s.tobytes())
                if node in seen:
                    continue
                seen.add(node)
                level = levels[(s % np.uint64(SLOTS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)
                # Stable: tokens with equal keys keep the order of their hashes, the same in every set.
                first = np.argsort(level | (under(0, s) >> np.uint64(8)), kind="stable")[:prefix_size(len(s))]
                places = np.minimum(np.arange(len(first), dtype=np.uint64), np.uint64((1 << PLACE_BITS) - 1))
                keys.append(s[first] >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | places)
                nodes.append(np.full(len(first), node))
                sizes.append(np.full(len(first), len(s), np.int32))
            if keys:
                arrays = [np.concatenate(keys).view(np.int64), *map(np.concatenate, (nodes, sizes))]
                for at in range(0, len(arrays[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(a[at:at + 100_000]) for a in arrays], names=["key", "node", "n"])

    return docs.select(col(text_col).cast("string").alias(text_col)).mapInArrow(emit, "key bigint, node bigint, n int")


def _possible(n1, place1, n2, place2, smaller, larger):
    """Whether sets whose first common token stands at these places may be linked; for arrays and for columns."""
    part, whole = MATCH
    overlap = whole * smaller(n1, n2) >= part * larger(n1, n2)
    return overlap & ((part + whole) * smaller(n1 - place1, n2 - place2) >= part * (n1 + n2))


class _Buckets:
    """Reads prefix rows sorted by key; gives candidate pairs, and the rows of tokens with many nodes.

    Whole runs of a token are handled at once; a run longer than ``HELD`` rows is handled in parts, each compared with
    the leaders of the first part.
    """

    HELD = 50_000
    NAMES = ("x", "y", "token", "node", "n", "place")

    def __init__(self):
        self.hot = None
        self.leaders = None

    def read(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            key, node, n = (c.to_numpy() for c in batch.columns)
            rows = [key >> PLACE_BITS, node, n, (key & ((1 << PLACE_BITS) - 1)).astype(np.int32)]
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            if not cut and len(rows[0]) >= self.HELD:
                yield from self.runs(rows, part=True)
                held = None
                continue
            if cut:
                yield from self.runs([r[:cut] for r in rows], part=False)
            held = [r[cut:] for r in rows]
        if held is not None and len(held[0]):
            yield from self.runs(held, part=False)

    def runs(self, rows: list[np.ndarray], part: bool) -> Iterator[pa.RecordBatch]:
        token, node, n, place = rows
        edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
        size = np.diff(edge)
        small = (size > 1) & (size <= SMALL)
        if part or (self.hot is not None and token[0] == self.hot):
            small[0] = False
        large = (size > SMALL) | ~(small | (size == 1))
        owner = np.repeat(small, size)
        firsts, seconds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(1, SMALL):
            i = np.flatnonzero(owner[:-k] & (token[k:] == token[:-k])) if k < len(token) else np.zeros(0, np.int64)
            if not len(i):
                break
            firsts.append(i)
            seconds.append(i + k)
        yield from self.pairs(rows, np.concatenate(firsts), rows, np.concatenate(seconds))
        continued = self.hot is not None and token[0] == self.hot
        for r in np.flatnonzero(large | (np.arange(len(size)) == 0) & continued):
            own = [x[edge[r]:edge[r + 1]] for x in rows]
            if not (r == 0 and continued):
                self.leaders = [x[:LEADERS] for x in own]
            for i in range(len(self.leaders[0])):
                yield from self.pairs(self.leaders, np.full(len(own[0]), i), own, np.arange(len(own[0])))
            none = pa.nulls(len(own[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, *map(pa.array, own)], names=self.NAMES)
        self.hot = token[-1] if part else None

    def pairs(self, a: list[np.ndarray], i: np.ndarray, b: list[np.ndarray], j: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y = a[1][i], b[1][j]
        fits = (x != y) & _possible(*(v.astype(np.int64) for v in (a[2][i], a[3][i], b[2][j], b[3][j])), np.minimum, np.maximum)
        if fits.any():
            pair = np.unique(np.stack([np.minimum(x, y)[fits], np.maximum(x, y)[fits]]), axis=1)
            long, short = pa.nulls(pair.shape[1], pa.int64()), pa.nulls(pair.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), long, long, short, short], names=self.NAMES)


def _packed(tokens: np.ndarray, width: int = 5) -> bytes:
    """Tokens by their upper bits, ``width`` bytes each: what the comparison of two sets moves and reads."""
    return np.ascontiguousarray((tokens >> np.uint64(64 - 8 * width)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(data: bytes, width: int = 5) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _sketch(tokens: np.ndarray) -> bytes:
    """A set's size and the parities of its tokens per slot; there are two to four slots for each token."""
    slots = 1 << max(6, (2 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return len(tokens).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _near(x: bytes, y: bytes) -> bool:
    """Whether two sketches leave room for a link: slots whose parities differ hold a token of one set only."""
    part, whole = MATCH
    n = sum(int.from_bytes(s[:8], "little") for s in (x, y))
    a, b = (np.frombuffer(s, np.uint8, offset=8) for s in sorted((x, y), key=len))
    while len(b) > len(a):
        # Half as many slots: those that fall together add up.
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return (part + whole) * int(np.bitwise_count(a ^ b).sum()) <= (whole - part) * n


def _further_prefixes(tokens: np.ndarray) -> bytes:
    """The prefixes of a set under the second and the third order, one after the other, three bytes a token."""
    size = prefix_size(len(tokens))
    return b"".join(_packed(tokens[np.argpartition(under(order, tokens), size - 1)[:size]], 3) for order in (1, 2))


def _meet(x: bytes, y: bytes) -> bool:
    """Whether two sets share a prefix token under both further orders."""
    halves = zip(_unpacked(x, 3).reshape(2, -1), _unpacked(y, 3).reshape(2, -1))
    return all(len(np.intersect1d(a, b)) for a, b in halves)


def _similar(x: bytes, y: bytes) -> bool:
    """Whether two sets share enough tokens."""
    part, whole = MATCH
    a, b = _unpacked(x), _unpacked(y)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return whole * both >= part * (len(a) + len(b) - both)


def _where(pairs: DataFrame, sets: DataFrame, data: str, keep) -> DataFrame:
    """The pairs (x, y, rx, ry) whose sets' ``data`` fit; each side's data are fetched by a join."""
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [keep(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            yield batch.select(["x", "y", "rx", "ry"]).filter(pa.array(fits, pa.bool_()))

    left = sets.select(F.col("node").alias("x"), F.col("rep").alias("rx"), F.col(data).alias("tx"))
    right = sets.select(F.col("node").alias("y"), F.col("rep").alias("ry"), F.col(data).alias("ty"))
    joined = pairs.join(left, "x").join(right, "y").select("x", "y", "rx", "ry", "tx", "ty")
    return joined.mapInArrow(test, "x bigint, y bigint, rx bigint, ry bigint")


def _built(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, **parts) -> DataFrame:
    """(rep, node, and a column for each of ``parts``, a function of a set) of the nodes of ``pairs``, from their texts."""
    nodes = pairs.select(F.col("x").alias("d1")).union(pairs.select("y")).distinct()
    wanted = checkpointed(classes.join(nodes, "d1").select(F.col("rep").alias("id"), F.col("d1").alias("node")))
    plain = docs.select(col(id_col).cast("bigint").alias("id"), col(text_col).cast("string").alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Another text under the same id is no part of the node.
            same, made = [], [[] for _ in parts]
            for s, node in zip(token_sets(texts(batch, "text"), n), batch.column(1).to_pylist()):
                same.append(_node(s.tobytes()) == node)
                if same[-1]:
                    for out, part in zip(made, parts.values()):
                        out.append(part(s))
            kept = batch.select([0, 1]).filter(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(x, pa.binary()) for x in made)], names=["rep", "node", *parts])

    # A checked number of ids goes to the texts; more are shuffled with them.
    few = wanted.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    chosen = plain.join(F.broadcast(wanted) if few else wanted, "id").select("id", "node", "text")
    return checkpointed(chosen.mapInArrow(build, ", ".join(["rep bigint", "node bigint", *(f"{x} binary" for x in parts)])))


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Links (x, y) between representatives, of candidate pairs of nodes.

    Sketches of all candidates are moved first; prefixes and whole sets are built for the nodes of pairs that they leave.
    """
    sketches = _built(pairs, classes, docs, id_col, text_col, n, sketch=_sketch)
    near = checkpointed(_where(pairs, sketches, "sketch", _near).select("x", "y").distinct())
    sets = _built(near, classes, docs, id_col, text_col, n, prefixes=_further_prefixes, tokens=_packed)
    close = _where(near, sets, "prefixes", _meet).select("x", "y").distinct()
    return _where(close, sets, "tokens", _similar).select(F.col("rx").alias("x"), F.col("ry").alias("y"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS) -> DataFrame:
    """(id, n, rep, component) per document: size of its set, the smallest id with an equal set, and the smallest id
    reachable by links.

    Words are split at blanks, A-Z lower-cased; sets hold distinct ``n``-word shingles, or the whole text where it has
    fewer words.  Documents without words have an empty set, no links and themselves as group; so have null ids, which
    stay null.  Equal rows share a group.  Sets are compared by 40 bits of their shingles' hashes, nodes by 64 of the 128
    bits of their digest.  Ids are whole numbers and name one text each.
    """
    sizes = checkpointed(set_sizes(docs, id_col, text_col, n))
    classes = checkpointed(sizes.filter("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("rep")))
    levels = docs.sparkSession.sparkContext.broadcast(frequency_classes(docs, text_col, n))
    rows = _prefixes(docs, text_col, n, levels).repartition(F.shiftright("key", PLACE_BITS)).sortWithinPartitions("key", "node")
    found = checkpointed(rows.mapInArrow(lambda b: _Buckets().read(b), "x bigint, y bigint, token bigint, node bigint, n int, place int"))
    pairs = checkpointed(found.filter("x is not null").select("x", "y").distinct())
    links = checkpointed(_verified(pairs, classes, docs, id_col, text_col, n))
    labels = components(links)
    # Tokens with many nodes whose components still differ: their nodes are joined across components.
    node_labels = classes.join(labels, F.col("rep") == F.col("node"), "left").select(
        F.col("d1").alias("node"), F.coalesce("component", "rep").alias("component"))
    members = found.filter("x is null").select("token", "node", "n", "place").distinct().join(node_labels, "node")
    open_tokens = members.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b").select("token")
    open_rows = checkpointed(members.join(open_tokens, "token"))
    a, b = open_rows.alias("a"), open_rows.alias("b")
    fits = _possible(F.col("a.n"), F.col("a.place"), F.col("b.n"), F.col("b.place"), F.least, F.greatest)
    across = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.component") < F.col("b.component")) & fits)
    across = across.select(F.least("a.node", "b.node").alias("x"), F.greatest("a.node", "b.node").alias("y")).distinct()
    rest = checkpointed(across.join(pairs, ["x", "y"], "left_anti"))
    if not rest.isEmpty():
        links = checkpointed(links.union(_verified(rest, classes, docs, id_col, text_col, n)))
        labels = components(links)
    owned = sizes.join(classes, ["d1", "d2"], "left")
    return owned.join(labels, F.col("rep") == F.col("node"), "left").select(
        "id", "n", F.coalesce("rep", "id").alias("rep"), F.coalesce("component", "rep", "id").alias("component"))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS) -> DataFrame:
    """The documents that are the smallest id of their group, once each, with their own columns."""
    groups = similar_groups(docs, id_col, text_col, n)
    gone = groups.filter("component <> id").select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, col(id_col) == F.col("_gone"), "left_anti")
