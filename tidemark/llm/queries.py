"""The registered corpus queries and their SQL twins: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import documents, table
from .decontaminate import contamination
from .fingerprint import edited, likeness, neighbours, print_text, with_prints
from .lexical import ranked_search
from .line_dedup import dedup_lines
from .ngram_join import similar_groups
from .packing import pack_documents
from .quality import fit_quality, score_quality
from .secrets import scan_secrets
from .spelling import spelling_variants
from .substring_dedup import without_repeats
from .topk import exact_top_k
from .toxicity import fit_toxicity, labelled, score_toxicity
from .url_filter import SiteRule, judge_urls

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_decontamination(spark, d):
    found = contamination(documents(spark, d).select("doc_id", "text"), table(spark, d, "benchmark"))
    ids = F.array_join(F.array_sort("items"), ",")
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, h: n + h["end"] - h["start"])
    return found.select("doc_id", F.col("words").alias("n_words"), n_hit.alias("n_hit"),
                        F.size("items").cast("bigint").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"),
                        (n_hit > 0).alias("contaminated"))


ORACLES["op2_decontamination"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {A_TO_Z}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
           FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, {A_TO_Z}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(10, len(w)) n, unnest([w[i:i + least(10, len(w)) - 1]
             FOR i IN range(1, len(w) - least(10, len(w)) + 2)]) k FROM b WHERE len(w) > 0),
s AS (SELECT doc_id, n, i, w[i:i + n - 1] k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i
      FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT s.doc_id, s.i, s.n, g.item_id FROM s JOIN g USING (n, k)),
c AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) ids
      FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

SITE_RULES = [SiteRule("allow", "org", "/"), SiteRule("block", "example.org", "/es/"),
              SiteRule("block", "example.org", "/en/1"), SiteRule("allow", "com", "/fr/"),
              SiteRule("block", "com", "/de/")]


@query
def op4_url_filters(spark, d):
    judged = judge_urls(table(spark, d, "pages").select("page_id", "url"), SITE_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


ORACLES["op4_url_filters"] = rf"""
WITH u AS (SELECT page_id, url, CASE WHEN contains(coalesce(url, ''), '://')
                  THEN substr(url, instr(url, '://') + 3) ELSE '' END rest FROM pages),
p AS (SELECT page_id, translate(url, {A_TO_Z}) low, translate(regexp_extract(rest, '^[^/?#]*'), {A_TO_Z}) host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path FROM u),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                             ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT page_id, host, path, low, (SELECT max_by({{'n': rhost || rpath, 'v': r.verdict}}, length(rhost || rpath)) FROM r
             WHERE (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath)) best FROM p)
SELECT page_id, host, path, best.n AS rule, coalesce(best.v, CASE WHEN coalesce(
    regexp_matches(low, '^[^:]*://[^/?#]*\b(casino|poker|betting|xxx)\b')
    OR regexp_matches(low, '^[^:]*://[^/?#]*/(login|signin)([/?#]|$)')
    OR regexp_matches(low, '[?&]utm_source=ads([&#]|$)'), false) THEN 'block' ELSE 'allow' END) AS verdict
FROM f
"""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op9_packing(spark, d):
    return pack_documents(documents(spark, d), tokenizer_path())


def held_out(modulus: int, remainder: int, id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus)) == remainder


def toxicity_model(spark: SparkSession, d: str):
    """Fitted on labelled rows outside the held-out fifth."""
    train = labelled(documents(spark, d), table(spark, d, "labels"), "toxic", held_out(5, 0))
    return fit_toxicity(train)


@query
def op10_toxicity(spark, d):
    scored = score_toxicity(documents(spark, d).select("doc_id", "text"), toxicity_model(spark, d))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op1_line_dedup(spark, d):
    found = dedup_lines(documents(spark, d).select("doc_id", "text"))
    return found.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"),
                        F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op1_line_dedup"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) line,
                  generate_subscripts(string_split(text, chr(10)), 1) - 1 i FROM documents),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT h, len(regexp_extract_all(line, '[^\x09-\x0D\x20]+')) w FROM l),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) upto FROM h),
p AS (SELECT doc_id, i, h, upto, upto - w before, row_number() OVER (PARTITION BY doc_id ORDER BY i) m,
             row_number() OVER (PARTITION BY doc_id, h % 2 ORDER BY i) k FROM c WHERE w > 0),
k AS (SELECT a.doc_id, a.i first, min(b.i) last FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.h % 2 = b.h % 2
      AND b.k BETWEEN a.k + 1 AND a.k + 11 AND b.upto - a.before >= 10 GROUP BY ALL
      UNION SELECT a.doc_id, a.i, b.i FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.m = a.m + 1
      WHERE b.upto - a.before >= 10 AND (a.h * 31 + b.h) % 2147483647 % 8 <> 0),
b AS (SELECT doc_id, first, last, array_to_string(string_split(text, chr(10))[first + 1:last + 1], chr(10)) body
      FROM k JOIN documents USING (doc_id)),
f AS (SELECT *, min((doc_id, first)) OVER (PARTITION BY body) < (doc_id, first - (last - first)) gone FROM b),
g AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) i, 1 gone FROM f WHERE gone)
SELECT doc_id, count(*)::BIGINT n_lines, count(gone)::BIGINT n_removed,
       length(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (gone IS NULL), '')) n_chars,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (gone IS NULL), '')) kept_sha256
FROM l LEFT JOIN g USING (doc_id, i) GROUP BY doc_id
"""


@query
def op8_fingerprints(spark, d):
    pairs = neighbours(documents(spark, d))
    pairs = with_prints(pairs.withColumn("edited", edited(F.col("text"), F.col("next_text"))), {"edited_prints": "edited"})
    return pairs.select(
        F.col("id").alias("doc_id"), F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        print_text("prints").alias("fingerprint"), print_text("edited_prints").alias("edited_fingerprint"),
        likeness("prints", "edited_prints").alias("near_edited"), likeness("prints", "next_prints").alias("near_next"))


@query
def op6_quality(spark, d):
    docs = documents(spark, d)
    model = fit_quality(docs, table(spark, d, "labels"), "quality", held_out(3, 1))
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op3_ngram_join(spark, d):
    groups = similar_groups(documents(spark, d))
    return groups.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@query
def op5_substring_dedup(spark, d):
    kept = without_repeats(documents(spark, d))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op7_secrets(spark, d):
    found = scan_secrets(documents(spark, d).select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "place", "run", F.length("candidate").alias("length"),
                        F.sha2("candidate", 256).alias("candidate_sha256"), F.round("score", 6).alias("score"), "secret")


ORACLES["op3_ngram_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {A_TO_Z}), '[^\x20\x09-\x0D]+') w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') k FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) i
      FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id WHERE r.c < e.y)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, coalesce(m.c, w.doc_id) component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(c) c FROM r GROUP BY doc_id) m USING (doc_id)
"""

ORACLES["op5_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) i FROM w WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) first FROM k GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) p FROM k JOIN f USING (h) WHERE first < doc_id),
o AS (SELECT doc_id, generate_subscripts(w, 1) p, unnest(w) word FROM w),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) kept FROM o ANTI JOIN g USING (doc_id, p) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) n FROM g GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT n_words, coalesce(c.n, 0)::BIGINT n_removed, sha256(coalesce(t.kept, '')) kept_sha256
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query
def op13_lexical_search(spark, d):
    found = ranked_search(documents(spark, d), table(spark, d, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


ORACLES["op13_lexical_search"] = rf"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {A_TO_Z}),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t FROM documents),
l AS (SELECT doc_id, count(*) n FROM w GROUP BY doc_id),
s AS (SELECT count(*) nn, sum(n)::BIGINT ll FROM l),
q AS (SELECT item_id, t, count(*) qtf FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, {A_TO_Z}),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t FROM benchmark) GROUP BY ALL),
p AS MATERIALIZED (SELECT doc_id, t, count(*) tf FROM w SEMI JOIN q USING (t) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT wt FROM p, s GROUP BY t, nn),
g AS MATERIALIZED (SELECT doc_id, t, wt * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))) v
      FROM p JOIN f USING (t) JOIN l USING (doc_id), s),
r AS (SELECT item_id, doc_id, sum(qtf * v)::BIGINT score FROM q JOIN g USING (t) GROUP BY ALL HAVING sum(qtf * v) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM r QUALIFY rank <= 20
"""


@query
def op12_spelling_variants(spark, d):
    found = spelling_variants(documents(spark, d))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


# The checksum of ``<id>:<run>`` bit by bit over its UTF-8 bytes, lowest bit first.
ORACLES["op12_spelling_variants"] = rf"""
WITH RECURSIVE o AS (SELECT doc_id, w, count(*) n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, {A_TO_Z}),
              '[A-Za-z\x{{C0}}-\x{{FF}}]+')) w FROM documents) WHERE length(w) >= 7 GROUP BY ALL),
b AS (SELECT *, hex(encode(doc_id::VARCHAR || ':' || w)) x FROM o),
y AS (SELECT doc_id, w, n, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) l FROM b),
c AS (SELECT doc_id, w, n, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(0, 8 * len(l)),
             lambda i: (l[i // 8 + 1] >> (i % 8)) & 1), lambda h, e: xor(h >> 1, 3988292384 * (xor(h, e) & 1)))) h FROM y),
v AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END word, n FROM c),
t AS MATERIALIZED (SELECT word, sum(n)::BIGINT n FROM v WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) k FROM (SELECT word, n, unnest(range(1, length(word) + 1)) i FROM t)),
p AS (SELECT d.word a, t.word b FROM d JOIN t ON d.k = t.word),
e AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT a, b FROM p UNION ALL SELECT b, a FROM p UNION ALL
      SELECT x.word, z.word FROM d x JOIN d z ON x.k = z.k AND x.i = z.i AND x.word <> z.word)),
g AS (SELECT a word, count(*) n_near, min({{'n': -t.n, 'w': t.word}}) best FROM e JOIN t ON t.word = e.b GROUP BY a),
f AS MATERIALIZED (SELECT t.word, t.n, coalesce(n_near, 0) n_near, CASE WHEN -best.n >= 10 * t.n THEN best.w END form,
      CASE WHEN -best.n >= 10 * t.n THEN -best.n END form_n FROM t LEFT JOIN g USING (word)),
r(word, root) AS (SELECT word, word FROM f WHERE form IS NULL UNION ALL SELECT f.word, r.root FROM f JOIN r ON f.form = r.word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN r USING (word)
"""


@query
def op11_top_k(spark, d):
    return exact_top_k(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLES["op11_top_k"] = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) e FROM embeddings
           WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
                 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
