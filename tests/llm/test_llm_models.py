"""URL rules, secrets, quality, toxicity, packing and the pipeline."""

import functools
import pickle
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import DATA
from tidemark.llm import packing, quality, queries, secrets, toxicity, url_filter
from tidemark.llm.url_filter import SiteRule


# --- urls -------------------------------------------------------------------------------------------

def test_urls(spark):
    urls = [None, "", "no scheme", "https://Example.ORG/es/1", "http://a.example.org/en/12?x#y", "http://example.org/EN/1", "x://xample.org",
            "https://b.com/de/", "https://b.com/fr", "https://com/fr/x", "http://u@c.com:80/fr/", "https://m.casino-win.net/en/1", "http://a.net/login",
            "http://a.net/s?utm_source=ads&b", "http://a.net/s?utm_source=adsx", "https://" + "a" * 50_000 + ".org/x"]
    frame = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)] * 2, "page_id int, url string, host string")
    found = url_filter.judge_urls(frame, queries.SITE_RULES)
    assert found.columns == ["page_id", "url", "host", "host_1", "path", "rule", "verdict", "patterns"] and found.count() == 2 * len(urls)
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in found.collect()}
    rules = [(None, "allow")] * 3 + [("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), (None, "allow"),
             ("com/de/", "block"), (None, "allow"), ("com/fr/", "allow"), (None, "allow"), (None, "block"), (None, "block"), (None, "block"),
             (None, "allow"), ("org/", "allow")]
    assert got == dict(enumerate(rules))
    assert url_filter.keep_allowed(frame, queries.SITE_RULES).count() == 2 * sum(v == "allow" for _, v in rules)
    assert url_filter.judge_urls(frame.filter("false"), queries.SITE_RULES).count() == 0


def test_many_rules_by_join(spark, monkeypatch):
    frame = spark.createDataFrame([(1, "http://h7.org/p")], "page_id int, url string")
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 1)
    found = url_filter.judge_urls(frame, [SiteRule("block", f"h{i}.org", "/") for i in range(20)]).first()
    assert (found["rule"], found["verdict"]) == ("h7.org/", "block")


# --- secrets ----------------------------------------------------------------------------------------

def test_secrets(spark):
    rng = random.Random(3)
    draw = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    card = lambda: "".join(rng.choice("0123456789") for _ in range(16))
    texts = [f'word here token = "{draw()}" more of it' for _ in range(60)] + [f"pay to {card()} and then" for _ in range(60)]
    texts += [None, "", "nothing", "y" * 100_000, f'secret = "{draw()}"']
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = secrets.scan_secrets(docs)
    got = {r["id"]: r["secret"] for r in found.collect()}
    assert got == {**{i: i < 60 for i in range(120)}, len(texts) - 1: True}
    clean = secrets.redact_secrets(docs, found)
    assert clean.filter("text like '%[secret]%'").count() == 61 and clean.filter("text is null").count() == 1
    assert secrets.scan_secrets(docs.filter("false")).count() == 0
    assert secrets.scan_secrets(docs.filter("doc_id >= 60 and doc_id < 120")).filter("secret").isEmpty()


def test_secrets_of_the_tables(spark):
    found = queries.QUERIES["op7_secrets"](spark, DATA)
    assert found.count() and set(found.columns) >= {"doc_id", "candidate_sha256", "score", "secret"}


def test_every_secret_of_a_word(spark):
    rng = random.Random(4)
    draw = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    a, b, c, d = (draw() for _ in range(4))
    texts = ['{"id":"550e8400e29b41d4a716","token":"%s","x":"%s"}' % (a, b), '{"aws_secret_access_key":"%s"}' % c, "?u=1&api_key:%s&%s" % (d, d),
             ",".join(f"{i:020d}" for i in range(3_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = secrets.candidates(docs)
    got = {(r["id"], r["run"]): r for r in found.filter("id < 3").collect()}
    assert {k: r["candidate"] for k, r in got.items()} == {
        (0, 0): "550e8400e29b41d4a716", (0, 1): a, (0, 2): b, (1, 1): c, (2, 0): d, (2, 1): d}
    assert [got[k]["before"] for k in ((0, 1), (0, 2), (1, 1))] == ["token", "x", "aws_secret_access_key"]
    labels = {(r["id"], r["run"]): r["secret"] for r in secrets.rule_labels(found).collect()}
    assert [labels[k] for k in ((0, 0), (0, 1), (0, 2), (2, 0))] == [0, 1, 0, 1]
    assert found.filter("id = 3").count() == 3_000 and found.filter("id = 3").agg(F.max(F.length("word"))).first()[0] < 100
    clean = secrets.redact_secrets(docs, found.withColumn("secret", F.lit(True)))
    assert {r["doc_id"]: r["text"] for r in clean.filter("doc_id < 3").collect()} == {
        0: '{"id":"[secret]","token":"[secret]","x":"[secret]"}', 1: '{"aws_secret_access_key":"[secret]"}', 2: "?u=1&api_key:[secret]&[secret]"}
    nested = spark.createDataFrame([(9, "0123456789abcdef0123456789abcdefXY 0123456789abcdef0123456789abcdef")], "doc_id bigint, text string")
    part = secrets.candidates(nested).withColumn("secret", F.lit(True))
    assert secrets.redact_secrets(nested, part).first()["text"] == "[secret] [secret]"


# --- quality and toxicity ---------------------------------------------------------------------------

@pytest.mark.parametrize("name, label", [("op6_quality", "quality"), ("op10_toxicity", "toxic")])
def test_scores_of_held_out_documents(spark, name, label):
    folder = DATA.replace("sf0.001", "sf0.01")
    found = queries.QUERIES[name](spark, folder)
    assert found.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert found.filter("score < 0 or score > 1 or score is null or predicted <> cast(score >= 0.5 as int)").isEmpty()
    held = found.filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    assert (held["predicted"] == held[label]).mean() > 0.9


def test_quality_of_odd_rows(spark):
    good, bad = "plain words make a fair text here", "SHOUT!! SHOUT!! SHOUT!! $$$ SHOUT!!"
    rows = [(i, good if i % 2 else bad) for i in range(40)] + [(40, None), (41, ""), (42, " "), (43, "é" * 50_000)]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 30)] + [(None, 1)], "doc_id bigint, quality int")
    model = quality.fit_quality(docs, labels, "quality", F.lit(False))
    found = quality.score_quality(docs, model)
    assert found.columns == ["doc_id", "text", "score", "score_1"]
    got = {r["doc_id"]: r["score_1"] for r in found.collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 1) for i in range(40)) and all(0 <= s <= 1 for s in got.values())
    none = quality.fit_quality(docs, labels.filter("false"), "quality", F.lit(False))
    assert {r["score_1"] for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.score_quality(docs.filter("false"), model).count() == 0


def test_folding():
    assert toxicity.folded("ІD1ОT  Lоser\u200b") == "idiot loser"
    assert toxicity.folded("m0r0n cl0wn 1diot 2024 a1") == "moron clown idiot 2024 a1"
    assert toxicity.folded("ＣＬＯＷＮ réeux") == "clown reeux"


def test_matches_words_beginnings_and_exceptions():
    matcher = toxicity.Matcher({"clown": 2.0, "reeux*": 1.5, "idiot": 1.0, "idiot*": 0.5}, ["clown fish"])
    assert matcher.total("A CLOWN, réeuxan! clowns") == (3.5, 2, 4)
    assert matcher.total("clown fish clown fishes cl0wn") == (4.0, 2, 5)
    assert matcher.total("idiot idiotic xidiot") == (1.5, 2, 3)
    assert matcher.total(None) == (0, 0, 0)


def test_toxicity_of_odd_rows(spark):
    rows = [(i, f"words {'wretchling' if i % 4 == 0 else 'other'} number w{i}") for i in range(80)] + [(80, None), (81, ""), (82, "wretchl1ng " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(toxicity.labelled(docs, labels, "toxic", F.col("doc_id") > 70))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(80)) and got[82] >= 0.5 and got[80] == got[81] < 0.5
    assert toxicity.keep_clean(docs, model).count() == 62
    assert toxicity.score_toxicity(docs.filter("false"), model).count() == 0
    one_sided = toxicity.fit_toxicity(toxicity.labelled(docs, labels.filter("toxic = 0"), "toxic", F.lit(False)))
    assert toxicity.keep_clean(docs, one_sided).count() == 83


# --- packing ----------------------------------------------------------------------------------------

def checked(pieces):
    """Sequences are gapless and bounded; gives the filled and the padded tokens."""
    filled = padded = 0
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist()
        total = int(own.length.sum())
        assert total <= packing.CAPACITY
        filled, padded = filled + total, padded + (0 if total & (total - 1) == 0 else packing.CAPACITY - total)
    return filled, padded


def test_token_pieces_are_those_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    texts = [None, "", " \n", "It's a Test!! ok...", "İstanbul ΣΑΣ naïve éé 12ab <|endoftext|>x", "word, " * 9000, "z" * 3000, "a\u0301 \u00a0b"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    pieces = packing.pack_documents(docs, queries.tokenizer_path()).toPandas()
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = pieces[pieces.doc_id == i].sort_values("start")
        assert own.start.tolist() == list(range(0, len(ids), 4096)) and set(own.doc_tokens) == {len(ids)}
        assert [zlib.crc32(ids[a:a + n].tobytes()) for a, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    checked(pieces)
    assert packing.pack_documents(docs.filter("false"), queries.tokenizer_path()).count() == 0


def test_little_padding(spark):
    rng = np.random.default_rng(1)
    lengths = np.minimum(4096, rng.geometric(1 / 900, 4000)).tolist() + [4096] * 500
    pieces = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id bigint, start bigint, length bigint")
    packed = packing.pack(pieces).toPandas()
    assert sorted(packed.length) == sorted(lengths)
    filled, padded = checked(packed)
    assert padded < 0.015 * filled


def test_patterns_hold_every_piece():
    counts = np.zeros(64, np.int64)
    counts[[0, 20, 21, 31, 33, 63]] = [7, 50, 3, 11, 1000, 2]
    plan = packing.plan_patterns(counts)
    assert (sum(p * t for p, t in plan) >= counts).all()
    assert all((p * np.arange(1, 65)).sum() <= 64 for p, _ in plan)
    assert packing.plan_patterns(np.zeros(8, np.int64)) == []


def fewest_sequences(counts):
    """Brute force over all fillings of a small capacity."""
    units = len(counts)

    @functools.cache
    def fewest(left):
        if not any(left):
            return 0
        first = max(i for i, n in enumerate(left) if n)
        best = sum(left)

        def fill(room, c, rest):
            nonlocal best
            best = min(best, 1 + fewest(tuple(rest)))
            for k in range(c, -1, -1):
                if rest[k] and k + 1 <= room:
                    fill(room - k - 1, k, [n - (i == k) for i, n in enumerate(rest)])

        fill(units - first - 1, first, [n - (i == first) for i, n in enumerate(left)])
        return best

    return fewest(tuple(counts))


def test_plans_are_near_the_fewest_sequences():
    rng = np.random.default_rng(5)
    for _ in range(20):
        counts = rng.integers(0, 3, 7)
        used = sum(n for _, n in packing.plan_patterns(counts))
        # rounding down costs less than one sequence a class
        assert fewest_sequences(counts.tolist()) <= used <= fewest_sequences(counts.tolist()) + np.count_nonzero(counts)
    counts = rng.integers(0, 40_000, 64) * (np.arange(64) < 24)
    used = sum(n for _, n in packing.plan_patterns(counts))
    assert used <= 1.001 * np.ceil((counts * np.arange(1, 65)).sum() / 64) + 64


def test_partitions_without_rows_in_fresh_workers(spark):
    # the workers of an earlier session hold nothing of this broadcast
    docs = spark.createDataFrame([(1, "one text")], "doc_id bigint, text string").repartition(4)
    pieces = packing.pack_documents(docs, queries.tokenizer_path()).collect()
    assert [(r["doc_id"], r["start"], r["offset"]) for r in pieces] == [(1, 0, 0)]
    words = pickle.loads(pickle.dumps(packing.WordIds(queries.tokenizer_path())))
    words.known.clear()
    assert len(words.encode(b"one text")) % 4 == 0


# --- pipeline ---------------------------------------------------------------------------------------

def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, DATA)
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.toArrow(), docs.schema)
        assert kept.join(before, "doc_id", "left_anti").isEmpty() and kept.count() <= before.count()
    pieces = corpus_pipeline.run(spark, DATA)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in kept.select("doc_id").collect()}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").filter("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
