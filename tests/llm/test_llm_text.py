"""Deduplication, joins, fingerprints and decontamination against brute force on small hard cases."""

import hashlib
import pathlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, fingerprint, line_dedup, ngram_join, substring_dedup
from tidemark.llm.common import hashed_words, rolled
from tidemark.llm.components import components

SCHEMA = "doc_id bigint, text string, lang string, words string, _text string, n_chars bigint"
LOWER = {i: i + 32 for i in range(65, 91)}


def frame(spark, texts, start=0):
    rows = [(start + i, t, "en", "own", "mine", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


@pytest.fixture(scope="module")
def corpus():
    """Nulls, blanks, short and long texts, copies, near copies and shared passages."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    lines = lambda w: "\n".join(" ".join(w[i:i + 9]) for i in range(0, len(w), 9))
    passage, base = draw(70), draw(160)
    out = [None, "", "  \n\t ", "one", "One two three", "ONE two three", lines(draw(6000)), "x" * 30_000, "\n" * 300]
    out += [lines(draw(rng.randint(5, 200))) for _ in range(15)]
    out += [lines(draw(40) + passage + draw(rng.randint(0, 40))) for _ in range(8)]
    for _ in range(25):
        near = list(base)
        for _ in range(rng.randint(0, 3)):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        out.append(lines(near))
    return out + [lines(base)] * 6 + [out[9]]


def test_word_hashes_do_not_depend_on_their_batch():
    alone = [hashed_words([x])[0] for x in (b"a bb ccc", b"", b" ccc ")]
    together, counts = hashed_words([b"a bb ccc", b"", b" ccc "])
    assert counts.tolist() == [3, 0, 1]
    assert together.tolist() == np.concatenate(alone).tolist() and together[2] == together[3]
    assert rolled(together, 3)[0] == rolled(together[:3], 3)[0] and len(rolled(together, 5)) == 0


# --- n-gram join ------------------------------------------------------------------------------------

def shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(texts):
    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    return {i: (len(s), g) for i, (s, g) in enumerate(zip(sets, group))}


def test_similar_groups(spark, corpus):
    found = {r["id"]: (r["n"], r["component"]) for r in ngram_join.similar_groups(frame(spark, corpus)).collect()}
    assert found == brute_groups(corpus)


def test_similar_groups_when_every_token_is_common(spark, corpus, monkeypatch):
    """The way for tokens of many nodes: leaders first, then a join across components."""
    monkeypatch.setattr(ngram_join, "SMALL", 2)
    monkeypatch.setattr(ngram_join, "LEADERS", 1)
    monkeypatch.setattr(ngram_join._Buckets, "HELD", 5)
    monkeypatch.setattr(ngram_join, "BROADCAST_NODES", 0)
    found = {r["id"]: (r["n"], r["component"]) for r in ngram_join.similar_groups(frame(spark, corpus)).collect()}
    assert found == brute_groups(corpus)


def test_one_per_group_keeps_columns_and_clean_rows(spark, corpus):
    docs = frame(spark, corpus)
    kept = ngram_join.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, g) in brute_groups(corpus).items() if g == i)
    assert ngram_join.similar_groups(docs.filter("false")).count() == 0


def test_sets_are_moved_only_for_pairs_that_sketches_leave(spark, monkeypatch):
    """Documents that share half of their words are candidates, but neither their prefixes nor their sets are moved."""
    rng = random.Random(8)
    draw = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    base = draw(200)
    corpus = [base, base[:90] + ["other"] + base[91:], base[:150] + ["other"] + base[151:]]
    for _ in range(30):
        half = draw(120)
        corpus += [half + draw(80), half + draw(80)]
    corpus = [" ".join(w) for w in corpus]
    moved, where = {}, ngram_join._where

    def noted(pairs, sets, data, keep):
        moved.setdefault(data, set()).update(r["rep"] for r in sets.collect())
        return where(pairs, sets, data, keep)

    monkeypatch.setattr(ngram_join, "_where", noted)
    found = {r["id"]: (r["n"], r["component"]) for r in ngram_join.similar_groups(frame(spark, corpus)).collect()}
    assert found == brute_groups(corpus) and [found[i][1] for i in range(3)] == [0, 0, 0]
    assert moved["tokens"] == moved["prefixes"] == {0, 1, 2}
    assert len(moved["sketch"]) > 20


def test_filters_of_pairs_lose_no_link():
    rng = np.random.default_rng(8)
    links = near = 0
    for size in [1, 2, 7, 30, 33, 100, 250, 511, 513] * 40:
        base = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
        kept = base[rng.random(size) < rng.choice([0.5, 0.8, 0.9, 0.95, 1.0])]
        other = np.union1d(kept, rng.integers(0, 1 << 64, rng.integers(0, size // 5 + 1), dtype=np.uint64))
        if not len(other):
            continue
        both = len(np.intersect1d(base, other))
        link = 100 * both >= 75 * (len(base) + len(other) - both)
        fits = ngram_join._near(ngram_join._sketch(base), ngram_join._sketch(other))
        assert ngram_join._similar(ngram_join._packed(base), ngram_join._packed(other)) == link
        if link:
            assert fits and ngram_join._meet(ngram_join._further_prefixes(base), ngram_join._further_prefixes(other))
        links, near = links + link, near + fits
    assert 50 < links <= near < 1.3 * links


def test_sketches_at_the_limit_of_a_link():
    """Six of eight tokens in common are a link, five of eight are none; of equal slots, none may be lost by folding."""
    tokens = np.arange(100, dtype=np.uint64)
    assert ngram_join._near(ngram_join._sketch(tokens[:7]), ngram_join._sketch(tokens[1:8]))
    assert not ngram_join._near(ngram_join._sketch(tokens[:6]), ngram_join._sketch(tokens[1:8]))
    small, large = ngram_join._sketch(tokens[:30]), ngram_join._sketch(tokens[:40])
    assert len(small) < len(large) and ngram_join._near(small, large) and ngram_join._near(large, small)
    assert not ngram_join._near(small, ngram_join._sketch(tokens[:41]))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "x bigint, y bigint")
    assert {tuple(r) for r in components(links).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    assert components(links.filter("false")).count() == 0


# --- repeated passages ------------------------------------------------------------------------------

def brute_repeats(texts):
    own = [words(t) for t in texts]
    first = {}
    for i, w in enumerate(own):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k:k + 50]), i)
    out = {}
    for i, w in enumerate(own):
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k:k + 50])] < i:
                gone |= set(range(k, k + 50))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("group", [substring_dedup.GROUP_SUFFIXES, 3])
def test_repeated_windows(spark, corpus, group, monkeypatch):
    whole = substring_dedup.repeated_words
    monkeypatch.setattr(substring_dedup, "repeated_words", lambda *a: whole(*a, group_suffixes=group))
    found = substring_dedup.without_repeats(frame(spark, corpus)).collect()
    assert {r["id"]: (r["n_words"], r["n_removed"], r["text"]) for r in found} == brute_repeats(corpus)


def test_no_documents_have_no_repeats(spark, corpus):
    assert substring_dedup.without_repeats(frame(spark, corpus).filter("false")).count() == 0


@pytest.mark.parametrize("group", [substring_dedup.GROUP_SUFFIXES, 3])
def test_repeated_windows_of_texts_that_go_in_circles(spark, group, monkeypatch):
    """Also rows that come twice: they are one document and keep what they hold."""
    whole = substring_dedup.repeated_words
    monkeypatch.setattr(substring_dedup, "repeated_words", lambda *a: whole(*a, group_suffixes=group))
    rng = random.Random(8)
    circle = lambda period, n, skip=0: " ".join(f"p{period}w{(i + skip) % period}" for i in range(n))
    ends = [" ".join(rng.choice("uvwxyz") * 3 for _ in range(60)) for _ in range(12)]
    corpus = [circle(p, n, skip) + " " + rng.choice(ends) for p in (1, 2, 3, 19, 20, 31, 33) for n, skip in ((49, 0), (300, 1), (170, 5), (171, 5))]
    corpus += [circle(2, 90) + " " + ends[0] + " " + circle(2, 400), ends[0] + " " + circle(3, 130) + " " + circle(2, 130)]
    docs = frame(spark, corpus)
    found = substring_dedup.without_repeats(docs.union(docs)).collect()
    assert len(found) == 2 * len(corpus)
    assert {r["id"]: (r["n_words"], r["n_removed"], r["text"]) for r in found} == brute_repeats(corpus)
    assert substring_dedup._segments(substring_dedup._plain(frame(spark, [circle(2, 20_000)]), "doc_id", "text"), 50, 20).count() < 5


def test_repeated_windows_keep_little_on_disk(spark):
    """Texts are shuffled once, and of segments that are equal everywhere no words."""
    rng = random.Random(9)
    draw = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n))
    passages = [draw(400) for _ in range(40)]
    corpus = [f"{draw(200)} {passages[i % 40]} {draw(200)}" for i in range(400)]
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {x: x.stat().st_size for f in folders for x in pathlib.Path(f).rglob("shuffle_*.data")}
    before, names = files(), ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for name in names:
            spark.conf.set(name, -1)
        found = substring_dedup.without_repeats(frame(spark, corpus)).agg(F.sum("n_removed")).first()[0]
    finally:
        for name in names:
            spark.conf.unset(name)
    assert found == 360 * 400
    written = sum(size for x, size in files().items() if x not in before)
    # frame() deals the texts out once itself.
    assert written < 3.5 * sum(map(len, corpus))


# --- lines ------------------------------------------------------------------------------------------

def line_chunks(rows):
    """(first, last) of the chunks of a text's lines."""
    h = [int(hashlib.md5(r.encode()).hexdigest()[:8], 16) for r in rows]
    n = lambda a, e: sum(len(words(r)) for r in rows[a:e + 1])
    full = [i for i in range(len(rows)) if words(rows[i])]
    out = {(a, e) for a, e in zip(full, full[1:]) if n(a, e) >= 10 and (h[a] * 31 + h[e]) % 2147483647 % 8}
    for k, a in enumerate(full):
        last = next((e for e in full[k + 1:] if h[e] % 2 == h[a] % 2 and n(a, e) >= 10), None)
        out |= {(a, last)} if last is not None else set()
    return out


def brute_lines(texts):
    """The smallest place of each chunk first, then every text without the chunks that have an earlier place."""
    first, out = {}, {}
    split = {i: t.split("\n") for i, t in enumerate(texts) if t is not None}
    for i, rows in split.items():
        for a, e in sorted(line_chunks(rows)):
            first.setdefault(tuple(rows[a:e + 1]), (i, a))
    for i, text in enumerate(texts):
        rows = split.get(i, [])
        gone = {k for a, e in line_chunks(rows) if first[tuple(rows[a:e + 1])] < (i, a - (e - a)) for k in range(a, e + 1)}
        out[i] = (None if text is None else "\n".join(r for k, r in enumerate(rows) if k not in gone), len(rows), len(gone))
    return out


def test_lines(spark, corpus):
    docs = frame(spark, corpus)
    found = line_dedup.dedup_lines(docs)
    assert found.columns[:len(docs.columns)] == docs.columns
    assert {r["doc_id"]: (r["text"], r["_lines"], r["_removed"]) for r in found.collect()} == brute_lines(corpus)
    kept = line_dedup.keep_deduplicated(docs)
    want = {i for i, (_, n, gone) in brute_lines(corpus).items() if not gone or gone < n}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == docs.columns
    assert kept.filter("n_chars <> length(text)").isEmpty()
    assert line_dedup.dedup_lines(docs.filter("false")).count() == 0


def test_equal_rows_stay_alike(spark):
    text = "\n".join(f"line {i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id bigint, text string")
    found = [(r["doc_id"], r["_removed"] > 0) for r in line_dedup.dedup_lines(docs).collect()]
    assert sorted(found, key=str) == sorted([(1, True), (1, True), (2, True), (None, False)], key=str)


def test_passages_inside_different_documents(spark, corpus):
    # One passage in the midst of ten different texts, at different places, with short lines and a blank one among them.
    passage = [f"passage line {i} of the shared kind" for i in range(4)] + ["", "in", "short", "lines"] + ["and its long last line at the end"]
    texts = ["\n".join([f"own {d} {i}" for i in range(3 + d)] + passage + [f"end {d} {i}" for i in range(5)]) for d in range(10)]
    found = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    assert [found[d]["_removed"] for d in range(10)] == [0] + [9] * 9
    assert all("passage" not in found[d]["text"] for d in range(1, 10)) and found[0]["text"] == texts[0]
    kept = line_dedup.keep_deduplicated(frame(spark, texts))
    assert kept.filter("n_chars <> length(text)").isEmpty() and kept.count() == 10
    # No line is lost for good, and neither blank lines nor closing brackets are passages.
    found = line_dedup.dedup_lines(frame(spark, corpus))
    left = {row for r in found.collect() for row in (r["text"] or "").split("\n")}
    assert left >= {row for t in corpus for row in (t or "").split("\n")}
    layout = ["other text\n\n\nwith its own end", "a text\n\n\nwith another end", "if a:\n    }\n\n    }\n\n    }\n", "if b:\n    }\n\n    }\n\n    }\n"]
    assert [r["_removed"] for r in line_dedup.dedup_lines(frame(spark, layout)).collect()] == [0] * 4


def test_line_counts_beside_columns_of_the_same_names(spark):
    text = "\n".join(f"a line with five words {i}" for i in range(6))
    docs = spark.createDataFrame([(1, text, "x", 7, 8), (2, text, None, 7, 8), (3, None, "y", 7, 8)],
                                 "doc_id bigint, text string, _text string, _lines int, _Removed int")
    found = line_dedup.dedup_lines(docs)
    assert found.columns == [*docs.columns, "_lines_1", "_removed_1"]
    assert sorted(tuple(r)[3:] for r in found.collect()) == [(7, 8, 0, 0), (7, 8, 6, 0), (7, 8, 6, 6)]
    assert sorted(r["doc_id"] for r in line_dedup.keep_deduplicated(docs).collect()) == [1, 3]


# --- fingerprints -----------------------------------------------------------------------------------

def brute_prints(text):
    pieces = re.findall(r"[^ \t\n\x0b\f\r]{1,4}", (text or "").translate(LOWER))
    if not pieces:
        return []
    p, step = fingerprint.PRIME, fingerprint.STEP
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    h = [signed(xxhash.xxh64(x.encode(), seed=42).intdigest()) % p for x in pieces]
    n, h = len(h), h + [0] * 4
    two = [(h[i] * step + h[i + 1]) % p for i in range(n)] + [0] * 4
    grams = [(two[i] * (step * step % p) + two[i + 2]) % p for i in range(max(1, n - 3))]
    out = []
    for s in range(max(1, len(grams) - 7)):
        window = range(s, min(len(grams), s + 8))
        low = min(grams[i] for i in window)
        pick = (low, max(i for i in window if grams[i] == low))
        if pick not in out[-9:]:
            out.append(pick)
    return out


def test_fingerprints(spark, corpus):
    some = [t for t in corpus if t is None or len(t) < 5000]
    pairs = fingerprint.neighbours(frame(spark, some), rows=7)
    pairs = fingerprint.with_prints(pairs.withColumn("edited", fingerprint.edited(F.col("text"), F.col("next_text"))), {"e": "edited"})
    rows = pairs.select("id", "text", "next_text", "edited", fingerprint.print_text("prints").alias("p"),
                        fingerprint.likeness("prints", "e").alias("near"), fingerprint.print_text("next_prints").alias("np")).collect()
    shown = lambda t: " ".join(f"{m:x}:{i}" for m, i in brute_prints(t))
    assert len(rows) == len(some)
    for r in rows:
        text, following = some[r["id"]] or "", some[(r["id"] + 1) % len(some)] or ""
        half = len(text) // 2
        edit = text[:len(text) - half] + following[:half]
        a, b = ({m for m, _ in brute_prints(t)} for t in (text, edit))
        assert (r["text"], r["next_text"], r["edited"]) == (text, following, edit)
        assert (r["p"], r["np"]) == (shown(text), shown(following))
        assert r["near"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_fingerprints_of_few_rows(spark):
    one = frame(spark, ["alone here"])
    assert fingerprint.neighbours(one).first()["next_text"] == "alone here"
    assert fingerprint.neighbours(one.filter("false")).count() == 0
    same = spark.createDataFrame([(None, "n"), (7, "a"), (7, "a"), (10 ** 12, None)], "doc_id bigint, text string")
    assert sorted((str(r["id"]), r["next_text"]) for r in fingerprint.neighbours(same, rows=1).collect()) == [
        ("1000000000000", "n"), ("7", ""), ("7", "a"), ("None", "a")]


def test_fingerprints_of_texts_without_blanks(spark):
    rng = random.Random(6)
    draw = lambda n: "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(n))
    text, part = draw(4000), "".join(rng.choice("abcdefgh0123😀\u2028") for _ in range(fingerprint.LONG + 1))
    rows = [(text, draw(1) + text), (text, draw(2) + text), (draw(50) + part + draw(91), draw(33) + part), ("a b " + part, draw(7) + part + " c d"), (text, draw(4000))]
    df = fingerprint.with_prints(spark.createDataFrame(rows, "a string, b string"), {"x": "a", "y": "b"})
    near = [r[0] for r in df.select(fingerprint.likeness("x", "y")).collect()]
    assert near[0] > 0.99 and near[1] > 0.99 and 0 < near[2] < 1 and 0 < near[3] < 1 and near[4] < 0.01
    # A piece from every code point: the winnowed minimum over all of a short run.
    tokens = [part[i:i + 4] for i in range(len(part) - 3)]
    joined = fingerprint.with_prints(spark.createDataFrame([(part, " ".join(tokens))], "a string, b string"), {"x": "a", "y": "b"})
    assert joined.filter("x = y and size(x) > 0").count() == 1


def test_ranges_of_unevenly_spread_ids(spark):
    ids = [*range(3_000), *range(10 ** 15, 10 ** 15 + 2_000), 2 ** 62] + [10 ** 9 * 2 ** k for k in range(30)]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, "none")], "doc_id bigint, text string")
    dealt, ranges = fingerprint._ranged(docs.select(F.col("doc_id").alias("offset")), 20)
    sizes = dealt.groupBy("range").agg(F.count("*").alias("n"), F.min("offset").alias("a"), F.max("offset").alias("b")).orderBy("range").collect()
    assert max(r["n"] for r in sizes) <= 80 and {r["range"] for r in sizes} == {r["key"] for r in ranges.collect()}
    assert all(x["b"] < y["a"] for x, y in zip(sizes[1:], sizes[2:])) and sizes[0]["a"] is None
    order = sorted(set(ids))
    got = {r["text"]: r["next_text"] for r in fingerprint.neighbours(docs, rows=20).collect()}
    assert got == {**{f"t{a}": f"t{b}" for a, b in zip(order, order[1:])}, f"t{order[-1]}": "none", "none": "t0"}


def test_successors_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "SORTED_RANGES", 5)
    keys = sorted({x * x % 9973 for x in range(120)})
    found = fingerprint._successors(spark.createDataFrame([(k,) for k in keys], "key bigint"), 4).collect()
    assert {r["key"]: r["next"] for r in found} == dict(zip(keys, keys[1:] + [None]))


# --- decontamination --------------------------------------------------------------------------------

ITEMS = [(1, "a b c d e f g h i j k l"), (2, "short item"), (3, None), (4, "..."), (5, "a b c d e f g h i j"), (6, "ÉTÉ x")]


@pytest.mark.parametrize("block", [500_000, 5])
def test_contamination(spark, block):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = frame(spark, ["z A-B c,d e f G h i j K z", "a short item, short item.", None, "", "a b c d e f g h i", "ÉTÉ x été x", "été X"])
    found = decontaminate.contamination(docs, items, block_words=block)
    assert found.columns[:6] == docs.columns and found.columns[6:] == ["words_1", "hits", "items"]
    got = {r["doc_id"]: (r["words_1"], [tuple(h) for h in r["hits"]], r["items"]) for r in found.collect()}
    assert got == {0: (13, [(1, 12)], ["1", "5"]), 1: (5, [(1, 5)], ["2"]), 2: (0, [], []), 3: (0, [], []), 4: (9, [], []),
                   5: (4, [(0, 2)], ["6"]), 6: (2, [], [])}
    assert decontaminate.contamination(docs.filter("false"), items).count() == 0
    assert decontaminate.contamination(docs, items.filter("false")).filter("size(hits) > 0").isEmpty()


def test_decontaminate_cuts_spans(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = frame(spark, ["Keep (short, ITEM) this.", "short item", "clean", None])
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()} == {0: ("Keep () this.", 13), 2: ("clean", 5), 3: (None, None)}
