"""Exact top-k search by inner product with a KD-tree per shard.

The median splits of a bounded sample cut space into regions; a region's rows are one or more shards.  A task builds the
KD-tree of its shard: median splits down to small leaves, each node with the tight box of its rows.  The product of a query
with any row of a box is at most the sum of the larger products with the two ends of each side.  The visitors of a shard walk
its tree together, best bound first: each node is left by the queries whose kth score its bound does not reach, and a leaf's
rows are multiplied at once with all queries that are left.  Queries search the shard of their own region first; the kth score
found there goes along to the other shards, and only those whose whole box can reach it are visited at all.

In many dimensions without a low-dimensional structure boxes rule out next to nothing; the exact search then multiplies
nearly every query with every row.

Equal vectors have equal scores, so of each distinct vector only the k + 1 smallest ids can be results: the trees hold no
more, and equal queries are searched once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import checkpointed, col, unused

K = 20
SHARD_ROWS = 8_192
# From so many shards on they hold more rows, up to so many times as many: each shard that a query reaches is sent its vector.
MANY_SHARDS, LARGER = 32, 8
LEAF_ROWS = 64
# Vectors whose medians cut the regions (by the hash of the vector), and regions at most.
SAMPLE_ROWS, MAX_REGIONS = 16_384, 1_024
# Boxes of shards that are broadcast at once, and queries that meet a shard in one task.
BOXES, VISITORS = 4_096, 16_384
# Queries that walk a tree together.
TOGETHER = 1_024
# Whole numbers up to here are exact as doubles, as single floats.
EXACT, EXACT_SINGLE = float(2 ** 53), float(2 ** 24)
MOST = 2 ** 63 - 1
# Below every score.
NONE = -MOST - 1


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v, own): floor(scale * x) of each component as the bytes of doubles, and the vector's product with itself.

    Null or non-finite vectors go.
    """
    def floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            start = vectors.offsets.to_numpy().astype(np.int64)
            length = np.diff(start)
            # Null components become NaN here.
            x = np.floor(vectors.values.to_numpy(zero_copy_only=False).astype(float) * scale) + 0.0
            gaps = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            whole = vectors.is_valid().to_numpy(zero_copy_only=False) & (gaps[start[1:]] == gaps[start[:-1]])
            for n in np.unique(length[whole]).tolist():
                at = np.flatnonzero(whole & (length == n))
                own = x[start[at][:, None] + np.arange(n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), _binary(own), pa.array(squares(own))], names=["id", "v", "own"])

    return df.select(col(id_col).cast("bigint").alias("id"), col(vector_col).cast("array<double>").alias("v")).mapInArrow(
        floor, "id bigint, v binary, own bigint")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), float).reshape(len(rows), len(rows[0]) // 8 if rows else 0)


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row as the bytes of its doubles."""
    return pa.array([row.tobytes() for row in rows], pa.binary())


def dots(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as 64-bit integers; larger ones end at the bounds of the type."""
    if x.size and np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * x.shape[1] < EXACT:
        return (x @ q).astype(np.int64)
    whole = [int(v) for v in q]
    return np.array([max(-MOST, min(MOST, sum(int(a) * b for a, b in zip(row, whole)))) for row in x], np.int64)


def squares(x: np.ndarray) -> np.ndarray:
    """Inner products of each row with itself, like ``dots``."""
    small = np.abs(x).max(axis=1, initial=0) < (EXACT / max(x.shape[1], 1)) ** 0.5 / 2
    out = np.empty(len(x), np.int64)
    out[small] = np.einsum("ij,ij->i", x[small], x[small]).astype(np.int64)
    out[~small] = [dots(row[None, :], row)[0] for row in x[~small]]
    return out


# --- one tree -------------------------------------------------------------------------------------------------------------

@dataclass
class Tree:
    """Rows in leaf order; node n spans rows first[n] to last[n], its box is low[n] to high[n], its children are at below[n]."""

    rows: np.ndarray
    ids: np.ndarray
    first: list[int]
    last: list[int]
    below: list[int]
    low: np.ndarray
    high: np.ndarray


def build_tree(rows: np.ndarray, ids: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
    """Splits at the median of the widest side until a node has few rows or all of them are equal."""
    order = np.arange(len(rows))
    first, last, below, low, high = [0], [len(rows)], [-1], [], []
    node = 0
    while node < len(first):
        a, b = first[node], last[node]
        own = rows[order[a:b]]
        lo, hi = own.min(axis=0), own.max(axis=0)
        low.append(lo)
        high.append(hi)
        if b - a > leaf_rows and (hi > lo).any():
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, np.argmax(hi - lo)], middle)]
            below[node] = len(first)
            first += [a, a + middle]
            last += [a + middle, b]
            below += [-1, -1]
        node += 1
    return Tree(rows[order], ids[order], first, last, below, np.array(low), np.array(high))


def bounds(low: np.ndarray, high: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """The most that a query's product with a row of each box can be: (query, box), rounded upwards where not exact."""
    out = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    largest = np.abs(queries).max(initial=0) * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) * queries.shape[1]
    return out if largest < EXACT else np.maximum(out + largest * 1e-12, -float(MOST))


def best_hits(asker: np.ndarray, score: np.ndarray, id_: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best hits of each query in order, ties to the smaller id, and each one's place from 0."""
    order = np.lexsort((id_, -score, asker))
    asker = asker[order]
    place = np.arange(len(asker)) - np.searchsorted(asker, asker)
    kept = place < k
    order = order[kept]
    return asker[kept], score[order], id_[order], place[kept]


def search_trees(tree: Tree, queries: np.ndarray, bound: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hits (query, score, id) of many queries, the k best rows of each in order, ties to the smaller id.

    Rows under ``least``, a score known to be reached (NONE: not known), may miss.  ``bound`` is (query, node).  Each query
    begins at its leaf of largest bound; from there the queries walk together, the node first that has the largest bound, and
    a leaf's rows are multiplied at once with all queries whose bound there reaches their kth score.
    """
    limits = np.ascontiguousarray(bound.T)
    largest = max(np.abs(tree.low[0]).max(initial=0), np.abs(tree.high[0]).max(initial=0)) * np.abs(queries).max(initial=0) * max(queries.shape[1], 1)
    # Sums of whole numbers below these sizes are exact in either type; any kth score beyond them rounds to no less.
    kind = np.float32 if largest < EXACT_SINGLE else np.float64
    rows, askers = tree.rows.astype(kind, copy=False), queries.astype(kind, copy=False)
    kth = least.copy()
    # Hits in order first, then those that wait to be ranked.
    hits = [(np.empty(0, np.int64),) * 3]
    ranked = waiting = 0

    def rank() -> None:
        nonlocal hits, ranked, waiting
        asker, score, id_, place = best_hits(*(np.concatenate(part) for part in zip(*hits)), k)
        last = place == k - 1
        kth[asker[last]] = np.maximum(kth[asker[last]], score[last])
        hits, ranked, waiting = [(asker, score, id_)], len(asker), 0

    def visit(leaf: int, asking: np.ndarray) -> None:
        nonlocal waiting
        a, b = tree.first[leaf], tree.last[leaf]
        own = askers if len(asking) == len(askers) else askers[asking]
        if largest < EXACT:
            found = own @ rows[a:b].T
            reached = found >= kth[asking].astype(kind)[:, None]
        else:
            found = np.array([dots(rows[a:b], q) for q in own])
            reached = found >= kth[asking][:, None]
        flat = np.flatnonzero(reached)  # much faster than ``nonzero`` of a matrix
        if len(flat):
            at, row = np.divmod(flat, b - a)
            hits.append((asking[at], found[at, row].astype(np.int64), tree.ids[a:b][row]))
            waiting += len(flat)
            if waiting > max(ranked, len(queries)):
                rank()

    leaves = np.flatnonzero(np.array(tree.below) < 0)
    begin = leaves[np.argmax(limits[leaves], axis=0)]
    for leaf in np.unique(begin).tolist():
        asking = np.flatnonzero((begin == leaf) & (limits[leaf] >= kth))
        if len(asking):
            visit(leaf, asking)
            limits[leaf, asking] = -np.inf
    rank()
    heap = [(-limits[0].max(initial=-np.inf), 0)]
    while heap:
        _, node = heapq.heappop(heap)
        # Equal scores may still have smaller ids.
        asking = np.flatnonzero(limits[node] >= kth)
        if not len(asking):
            continue
        child = tree.below[node]
        if child < 0:
            visit(node, asking)
            continue
        for c in (child, child + 1):
            heapq.heappush(heap, (-limits[c, asking].max(), c))
    rank()
    return hits[0]


def search_tree(tree: Tree, query: np.ndarray, bound: list[float], k: int, least: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The (scores, ids) of one query's k best rows; see ``search_trees``."""
    _, scores, ids = search_trees(tree, query[None, :], np.array([bound]), k, np.array([NONE if least is None else least]))
    return scores, ids


# --- regions and shards ---------------------------------------------------------------------------------------------------

@dataclass
class Region:
    """A split at a median (rows below it go to ``under``), or the number of a region."""

    number: int = -1
    side: int = 0
    at: float = 0.0
    under: Region | None = None
    over: Region | None = None


def cut_regions(sample: np.ndarray, wanted: int) -> Region:
    """Median splits of a sample into ``wanted`` regions or fewer."""
    count = 0

    def cut(rows: np.ndarray, parts: int) -> Region:
        nonlocal count
        wide = rows.max(axis=0) - rows.min(axis=0) if rows.size else np.zeros(0)
        if parts > 1 and wide.max(initial=0) > 0:
            side = int(np.argmax(wide))
            at = float(np.median(rows[:, side]))
            under = rows[:, side] < at
            if not under.any():  # half of the rows and more hold the least value
                at = float(rows[rows[:, side] > at, side].min())
                under = rows[:, side] < at
            return Region(side=side, at=at, under=cut(rows[under], parts // 2), over=cut(rows[~under], parts - parts // 2))
        count += 1
        return Region(number=count - 1)

    return cut(sample, wanted)


def region_of(root: Region, rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.int64)
    stack = [(root, np.arange(len(rows)))]
    while stack:
        region, own = stack.pop()
        if region.number >= 0:
            out[own] = region.number
            continue
        under = rows[own, region.side] < region.at
        stack += [(region.under, own[under]), (region.over, own[~under])]
    return out


def _with_region(df: DataFrame, root: Region) -> DataFrame:
    """The rows (id, v) with their region."""
    shared = df.sparkSession.sparkContext.broadcast(root)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regions = region_of(shared.value, _matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(regions)], names=["id", "v", "region"])

    return df.select("id", "v").mapInArrow(find, "id bigint, v binary, region bigint")


HITS = "query bigint, shard bigint, low binary, high binary, scores array<bigint>, ids array<bigint>"


def _meeting(k: int, leaf_rows: int):
    """Searches the tree of one shard for its visitors; the first row tells the box of the shard."""
    kinds = pa.schema([("query", pa.int64()), ("shard", pa.int64()), ("low", pa.binary()), ("high", pa.binary()),
                       ("scores", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64()))])

    def meet(rows: pa.Table, visitors: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return kinds.empty_table()
        tree = build_tree(_matrix(rows["v"]), rows["id"].to_numpy(), leaf_rows)
        shard = rows["shard"][0].as_py()
        out = [pa.Table.from_arrays([pa.array(x, kind.type) for x, kind in zip(
            ([None], [shard], [tree.low[0].tobytes()], [tree.high[0].tobytes()], [None], [None]), kinds)], schema=kinds)]
        for start in range(0, visitors.num_rows, TOGETHER):
            part = visitors.slice(start, TOGETHER)
            queries = _matrix(part["v"])
            least = part["least"].combine_chunks().fill_null(NONE).to_numpy()
            at, scores, ids = search_trees(tree, queries, bounds(tree.low, tree.high, queries), k, least)
            asker, first = np.unique(at, return_index=True)
            ends = pa.array(np.append(first, len(at)).astype(np.int32))
            nothing = pa.nulls(len(asker), pa.binary())
            out.append(pa.Table.from_arrays([part["id"].take(pa.array(asker)).combine_chunks(), pa.array(np.full(len(asker), shard)), nothing, nothing,
                                             pa.ListArray.from_arrays(ends, pa.array(scores)), pa.ListArray.from_arrays(ends, pa.array(ids))], schema=kinds))
        return pa.concat_tables(out)

    return meet


def _search(points: DataFrame, visitors: DataFrame, k: int, leaf_rows: int) -> DataFrame:
    """Hits of the visitors (id, v, shard, least) in their shards; a shard with many of them is built in several tasks."""
    parts = visitors.groupBy("shard").count().select("shard", F.ceil(F.col("count") / VISITORS).alias("parts"))
    sent = points.join(parts, "shard", "left").select(
        "id", "v", "shard", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)).alias("part"))
    dealt = visitors.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).select("id", "v", "shard", "least", "part")
    return sent.groupBy("shard", "part").cogroup(dealt.groupBy("shard", "part")).applyInArrow(_meeting(k, leaf_rows), HITS)


def _reaching(queries: DataFrame, shards: list, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """The queries (id, v, least, home) under every other shard whose box they can reach with their least score."""
    shared = queries.sparkSession.sparkContext.broadcast((np.array(shards), low, high))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, low, high = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                least = np.array([-np.inf if x is None else float(x) for x in batch.column(2).to_pylist()])
                reached = bounds(low, high, _matrix(batch.column(1))) >= least[:, None]
                q, s = np.nonzero(reached & (shards[None, :] != batch.column(3).to_numpy()[:, None]))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(q)) for c in batch.columns[:3]), pa.array(shards[s])], names=["id", "v", "least", "shard"])

    return queries.select("id", "v", "least", "home").mapInArrow(send, "id bigint, v binary, least bigint, shard bigint")


def _nearest(points: DataFrame, queries: DataFrame, k: int, shard_rows: int, leaf_rows: int) -> DataFrame:
    """(query, score, id): the k best points of each query; points and queries (id, v) have one length."""
    n = points.count()
    shard_rows = min(max(shard_rows, -(-n // MANY_SHARDS)), LARGER * shard_rows)
    wanted = max(1, min(MAX_REGIONS, -(-n // shard_rows)))
    # At most SAMPLE_ROWS vectors come to the driver.
    sample = _matrix(points.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE_ROWS).toArrow()["v"])
    root = cut_regions(sample, wanted)
    placed = checkpointed(_with_region(points, root))
    # One row a region: a region with more rows than a shard holds is dealt over several.
    sizes = {r["region"]: -(-r["count"] // shard_rows) for r in placed.groupBy("region").count().collect()}
    first, total = {}, 0
    for region in sorted(sizes):
        first[region], total = total, total + sizes[region]
    table = F.broadcast(points.sparkSession.createDataFrame([(r, first[r], sizes[r]) for r in sizes], "region bigint, first bigint, parts bigint"))

    def in_shard(df: DataFrame) -> Column:
        return F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))

    shards = placed.join(table, "region").select("id", "v", in_shard(placed).alias("shard"))
    # A query of a region without rows begins anywhere.
    at_home = checkpointed(_with_region(queries, root).join(table, "region", "left").select(
        "id", "v", F.coalesce(in_shard(queries), F.lit(0)).alias("shard"), F.lit(None).cast("bigint").alias("least")))
    begun = checkpointed(_search(shards, at_home, k, leaf_rows))
    hits = begun.filter("query is not null").select("query", "scores", "ids")
    if total > 1:
        known = hits.select(F.col("query").alias("id"), F.when(F.size("scores") == k, F.element_at("scores", -1)).alias("least"))
        ready = checkpointed(at_home.drop("least").join(known, "id", "left").select("id", "v", "least", F.col("shard").alias("home")))
        boxes = begun.filter("query is null").select("shard", "low", "high").dropDuplicates(["shard"])
        sent = None
        for start in range(0, total, BOXES):
            # A bounded number of boxes at a time, one pass over the queries each.
            part = boxes.filter(F.col("shard").between(start, start + BOXES - 1)).toArrow()
            if part.num_rows:
                more = _reaching(ready, part["shard"].to_pylist(), _matrix(part["low"]), _matrix(part["high"]))
                sent = more if sent is None else sent.unionByName(more)
        further = _search(shards, checkpointed(sent), k, leaf_rows)
        hits = hits.unionByName(further.filter("query is not null").select("query", "scores", "ids"))
    flat = hits.select("query", F.explode(F.arrays_zip("scores", "ids")).alias("h")).select("query", F.col("h.scores").alias("score"), F.col("h.ids").alias("id"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return flat.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def exact_top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
                scale: int = 64, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(query_id, rank, id, score): for each row that ``is_query`` marks the k other rows of largest inner product.

    Components become floor(scale * x); equal scores are ranked by ascending id.  Vectors that are null or hold null or
    non-finite components take no part; vectors of different lengths are not compared; repeated rows (id and vector)
    count once, and a row without id takes no part.  Products beyond 64 bits end at the bounds of the type.  A query with
    fewer than k other rows has them all; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = checkpointed(quantised(vectors.filter(col(id_col).isNotNull()), id_col, vector_col, scale).distinct())
    asked = checkpointed(quantised(vectors.filter(is_query & col(id_col).isNotNull()), id_col, vector_col, scale).distinct())
    name, rank, score = unused(vectors.select(col(id_col)), "query_id", "rank", "score")
    out = None
    for r in asked.select(F.length("v").alias("n")).distinct().orderBy("n").collect():  # one row a length of vectors
        same = F.length("v") == r["n"]
        own = asked.filter(same)
        # Tasks keep k + 1 ids of a vector before rows are moved, however often it is repeated.
        place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
        points = checkpointed(rows.filter(same).withColumn("place", place).filter(F.col("place") <= k + 1).select("id", "v"))
        # One id may stand for two vectors, so queries are numbered by their vectors.
        numbered = checkpointed(own.groupBy("v").agg(F.first("own").alias("own")).withColumn("q", F.monotonically_increasing_id()))
        best = _nearest(points, numbered.select(F.col("q").alias("id"), "v"), k + 1, shard_rows, leaf_rows)
        # At most k + 1 hits a query.
        lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))).alias("hits"))
        hits = numbered.join(lists, F.col("q") == F.col("query")).select("v", "hits")
        found = own.join(hits, "v").withColumn("at", F.array_position("hits", F.struct((-F.col("own")).alias("minus"), F.col("id"))))
        # The query's own row is among its hits, unless k + 1 others come first.
        others = F.when(F.col("at") > 0, F.concat(F.slice("hits", F.lit(1), F.col("at") - 1), F.slice("hits", F.col("at") + 1, F.lit(k + 1)))
                        ).otherwise(F.col("hits"))
        flat = (found.select(F.col("id").alias("asker"), F.posexplode(F.slice(others, 1, k)).alias("pos", "hit"))
                .select(F.col("asker").alias(name), (F.col("pos") + 1).alias(rank), F.col("hit.id").alias(id_col), (-F.col("hit.minus")).alias(score)))
        out = flat if out is None else out.unionByName(flat)
    if out is None:
        return spark.createDataFrame([], f"`{name}` bigint, `{rank}` int, `{id_col}` bigint, `{score}` bigint")
    return out
