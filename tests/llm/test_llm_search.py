"""Top-k search, spelling variants and lexical search against brute force."""

import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lexical, spelling, topk


# --- top-k ------------------------------------------------------------------------------------------

def top_k_by_force(rows, is_query, k):
    """Over distinct (id, vector) rows of vectors without gaps."""
    own = sorted({(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows
                  if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for q in own:
        if is_query(q[0]):
            found = sorted((-sum(a * b for a, b in zip(q[1], c[1])), c[0]) for c in own if c != q and len(c[1]) == len(q[1]))
            out += [(q[0], n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_top_k_is_that_of_brute_force(spark, monkeypatch, spread):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=5) * spread).round(2).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5, 0.25, 0.0, -0.5, 1.0]) for i in range(120)]  # a third is one vector
    rows += [(2000, None), (2001, [0.1, None, 0.1, 0.1, 0.1]), (2002, [math.nan] * 5), (2010, [math.inf] * 5), (None, [1.0] * 5),
             (2004, [0.5, 0.5]), (2010, [0.25, 0.5]), (2006, []), (2020, []), (10, rows[10][1]), (20, [9.0, 0.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, score string")
    monkeypatch.setattr(topk, "VISITORS", 7)
    monkeypatch.setattr(topk, "BOXES", 3)
    found = topk.exact_top_k(frame, F.col("vec_id") % 10 == 0, k=6, shard_rows=40, leaf_rows=5)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    assert sorted(map(tuple, found.collect())) == top_k_by_force(rows, lambda i: i % 10 == 0, 6)


def test_top_k_of_large_numbers_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, [2.0 ** 40, 1.0]), (2, [2.0 ** 40, -1.0]), (3, [-(2.0 ** 40), 0.0])], "vec_id int, embedding array<double>")
    got = [tuple(r) for r in topk.exact_top_k(frame, F.col("vec_id") == 1, k=2).orderBy("rank").collect()]
    assert got == [(1, 1, 2, topk.MOST), (1, 2, 3, -topk.MOST)]
    assert topk.exact_top_k(frame.filter("false"), F.col("vec_id") == 1).count() == 0
    assert topk.exact_top_k(frame, F.lit(False)).count() == 0


def test_best_first_search_of_one_tree():
    rng = np.random.default_rng(1)
    rows = rng.integers(-20, 20, (700, 6)).astype(float)
    tree = topk.build_tree(rows, np.arange(700), 8)
    assert all((tree.rows[a:b] >= lo).all() and (tree.rows[a:b] <= hi).all() for a, b, lo, hi in zip(tree.first, tree.last, tree.low, tree.high))
    for q in rng.integers(-20, 20, (20, 6)).astype(float):
        scores, ids = topk.search_tree(tree, q, topk.bounds(tree.low, tree.high, q[None])[0].tolist(), 9, None)
        assert list(zip(scores, ids)) == sorted(zip((rows @ q).astype(int), range(700)), key=lambda x: (-x[0], x[1]))[:9]
        again = topk.search_tree(tree, q, topk.bounds(tree.low, tree.high, q[None])[0].tolist(), 9, int(scores[4]))
        assert list(zip(*again))[:5] == list(zip(scores, ids))[:5]


def test_visitors_of_a_shard_walk_its_tree_together(monkeypatch):
    rng = np.random.default_rng(5)
    rows = rng.integers(-40, 40, (1500, 64)).astype(float)  # no box rules out a leaf
    queries = rows[::6]
    vectors = pa.array([r.tobytes() for r in rows], pa.binary())
    points = pa.table({"id": np.arange(1500), "v": vectors, "shard": np.zeros(1500, np.int64)})
    visitors = pa.table({"id": np.arange(0, 1500, 6), "v": vectors.take(pa.array(np.arange(0, 1500, 6))), "least": pa.nulls(250, pa.int64())})
    taken, pop = [], heapq.heappop
    monkeypatch.setattr(heapq, "heappop", lambda heap: taken.append(1) or pop(heap))
    hits = topk._meeting(21, 64)(points, visitors).slice(1)
    assert len(taken) < 250  # a query that walked alone took a node or more
    got = {q: list(zip(scores, ids)) for q, scores, ids in zip(*(hits[c].to_pylist() for c in ("query", "scores", "ids")))}
    for q, own in zip(range(0, 1500, 6), queries):
        assert got.pop(q) == sorted(zip((rows @ own).astype(int).tolist(), range(1500)), key=lambda x: (-x[0], x[1]))[:21]
    assert not got


@pytest.mark.parametrize("largest", [5, 3_000, 2 ** 22, 2 ** 40])  # single floats, doubles, beyond both
def test_queries_of_one_tree_with_known_scores_and_without(largest):
    rng = np.random.default_rng(3)
    rows = (rng.integers(-5, 6, (300, 4)) * (largest // 5)).astype(float)
    queries = (rng.integers(-5, 6, (30, 4)) * (largest // 5)).astype(float)
    tree = topk.build_tree(rows, np.arange(300), 8)
    want = [sorted(zip(topk.dots(rows, q).tolist(), range(300)), key=lambda x: (-x[0], x[1]))[:9] for q in queries]
    least = np.array([(topk.NONE, w[8][0], w[2][0], topk.MOST)[i % 4] for i, w in enumerate(want)])
    at, scores, ids = topk.search_trees(tree, queries, topk.bounds(tree.low, tree.high, queries), 9, least)
    for i, w in enumerate(want):
        own = at == i
        sure = [x for x in w if x[0] >= least[i]]
        assert list(zip(scores[own].tolist(), ids[own].tolist()))[:len(sure)] == sure
    assert topk.squares(rows).tolist() == [topk.dots(r[None], r)[0] for r in rows]


def test_larger_shards_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(200)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(topk, "MANY_SHARDS", 3)
    found = topk.exact_top_k(frame, F.col("vec_id") % 10 == 0, k=6, shard_rows=10, leaf_rows=5)
    assert sorted(map(tuple, found.collect())) == top_k_by_force(rows, lambda i: i % 10 == 0, 6)


# --- spelling variants ------------------------------------------------------------------------------

def variants_by_force(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 31 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: set() for w in counts}
    for w in counts:
        cut = [w[:i] + w[i + 1:] for i in range(len(w))]
        for v in counts:
            same = len(v) == len(w) and sum(a != b for a, b in zip(v, w)) == 1
            if same or len(v) == len(w) - 1 and v in cut:
                near[w].add(v)
                near[v].add(w)
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 10 * counts[w]:
            form[w] = best
    def root(w):
        return root(form[w]) if w in form else w
    return sorted((w, form.get(w, ""), root(w), n, len(near[w]), counts[form[w]] if w in form else -1) for w, n in counts.items())


def test_variants_are_those_of_brute_force(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abeé") for _ in range(rng.randrange(7, 10))) for _ in range(60)]
    words = [w for i, w in enumerate(base) for _ in range(1 + 200 // (i + 1))] + ["x" * 300, "x" * 300, "x" * 299 + "y"] * 2
    docs = []
    for i in range(60):
        own = []
        for w in rng.choices(words, k=80):
            at = rng.randrange(len(w))
            own.append(rng.choice([w, w, w.upper(), w[:at] + w[at + 1:], w[:at] + "b" + w[at:], w[:at] + "c" + w[at + 1:]]))
        docs.append((i, rng.choice([" ", "\n", "-1-", "ł"]).join(own)))
    docs += [(200 + i, "chainaaa") for i in range(600)] + [(900 + i, "chainaab") for i in range(45)] + [(960 + i, "chainabb") for i in range(3)]
    docs += [(100, None), (101, ""), (None, base[0]), (102, "日本 " + base[0]), (5, docs[5][1])]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, n int")
    want = variants_by_force(docs)
    assert sum(r[1] != "" for r in want) > 20 and any(r[1] not in ("", r[2]) for r in want)
    for limit in (20, 100_000):
        found = spelling.spelling_variants(frame, shard_words=limit)
        got = sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in found.collect())
        assert got == want
    assert spelling.spelling_variants(frame.filter("false")).count() == 0


def test_shards_of_words_that_no_count_parts(spark):
    rng = random.Random(4)
    words = {"".join(rng.sample("abcdefgh", 8)) for _ in range(80)}  # all have the same letters
    words |= {w[:3] + "z" + w[4:] for w in words}
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n bigint")
    pairs = {frozenset((r["word"], r["other"])) for r in spelling.near_pairs(frame, 10).collect()}
    assert pairs == {frozenset((a, b)) for a in words for b in words if sum(x != y for x, y in zip(a, b)) == 1}


# --- lexical search ---------------------------------------------------------------------------------

def ranking_by_force(docs, items, k=20):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    bags = [(i, Counter(split(t))) for i, t in docs]
    size = [sum(b.values()) for _, b in bags]
    n, total = sum(s > 0 for s in size), sum(size)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for (i, bag), length in zip(bags, size):
            m = 75 + (25 * length * n) // total if total else 75
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * bag[t]) // (1000 * bag[t] + 12 * m))
                        for t in split(text) if bag[t])
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [3, 1000])
def test_ranking_is_that_of_brute_force(spark, monkeypatch, block):
    rng = np.random.default_rng(3)
    words = [f"W{i}" for i in range(40)]
    share = 1 / np.arange(1, 41) ** 1.3
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 60), p=share / share.sum()))) for i in range(400)]
    docs += [(400, None), (401, ""), (402, "... \n"), (None, "w39 w38"), (403, "ÉCOLE w39 " * 20_000), (7, docs[7][1]), (404, docs[9][1]), (405, docs[9][1])]
    items = [(1, "w0 w1 w2 w39"), (2, "W39 w39 w38 w0!"), (3, None), (4, ""), (5, "nowhere"), (6, " ".join(words)), (7, "ÉCOLE"), (8, "w0"), (2, "w5 w6")]
    items += [(10 + i, " ".join(rng.choice(words, 6))) for i in range(20)]
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, score int").repartition(5)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id int, text string, rank int")
    monkeypatch.setattr(lexical, "CHUNK_ROWS", 64)
    found = lexical.ranked_search(frame, asked, block_terms=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect())) == ranking_by_force(docs, items)
    assert lexical.ranked_search(frame.filter("false"), asked).count() == 0
    assert lexical.ranked_search(frame, asked.filter("false")).count() == 0


def test_no_accumulators_beyond_the_bounds():
    rng = np.random.default_rng(8)
    rows, size = 500, 12
    own = {t: (np.flatnonzero(rng.random(rows) < 0.02 * (t + 1)), None) for t in range(size)}
    own = {t: (at, rng.integers(1, 1000, len(at))) for t, (at, _) in own.items() if len(at)}
    frequency = np.array([len(own[t][0]) if t in own else 0 for t in range(size)])
    stats = lexical.Statistics(rows, 1, frequency, rng.integers(0, 3000, size), np.array([own[t][1].max() if t in own else 0 for t in range(size)]))
    for _ in range(50):
        terms = rng.choice(size, 5, replace=False)
        query = lexical.Query(terms, rng.integers(1, 3, 5))
        want = np.zeros(rows, np.int64)
        for t, n in zip(query.terms, query.times):
            if t in own:
                want[own[t][0]] += n * stats.weight[t] * own[t][1]
        for least in (0, int(np.sort(want)[-20]), int(np.sort(want)[-3])):
            found, points = lexical.search_part(query, stats, own, rows, 20, least)
            assert (want[found] == points).all()
            best = np.lexsort((np.arange(rows), -want))[:20]
            assert set(best[(want[best] >= least) & (want[best] > 0)]) <= set(found.tolist())
