"""Secret scans: long mixed tokens judged by a random forest, in DataFrame functions and JVM models only.

Candidates are runs of sixteen or more key characters with a digit, every such run of a word.  The forest sees their length,
their transitions between character classes and between letters, how much of them a dictionary of the corpus covers,
whether they stand in a path, and the words around them.  It is trained from labelled findings and removes false
alarms such as card numbers, identifiers and addresses.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import checkpointed, col

LEAST = 16
KEY = r"[A-Za-z0-9+/_=-]{16,}"
# Dictionary of the commonest words, and labelled findings that the forest is fitted on: bounds of what is broadcast
# and of what one fit reads.
DICTIONARY_WORDS = 5_000
MAX_FINDINGS = 20_000
CONTEXT_WORDS = 64
NUMBERS = ["length", "entropy", "digits", "upper", "changes", "digit_changes", "likely", "covered", "in_path", "assigned"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, place, run, candidate, word, before, before2, after): every candidate with the words around it.

    Words stand between blanks; ``place`` counts them from 0, ``run`` the runs of key characters in a word.  ``word`` is
    the run with what stands between it and the run before, and with that run where no name stands between; the last run
    has the rest of the word too.  For later runs ``before`` is the name before them in the same word.  Null and empty
    texts have no candidates.  Repeated rows give their candidates again.
    """
    plain = docs.select(col(id_col).alias("id"), F.split(F.coalesce(col(text_col).cast("string"), F.lit("")), r"\s+").alias("w"))
    long = plain.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.length(F.get("w", i)) >= LEAST))
    # The outer form: a plain explode would have its emptiness tested below the split, once for every word.
    rows = long.select("id", "w", F.explode_outer("at").alias("place")).filter("place is not null")
    near = lambda k: F.coalesce(F.get("w", F.col("place") + k), F.lit(""))
    found = rows.select("id", "place", near(0).alias("whole"), near(-1).alias("before"), near(-2).alias("before2"), near(1).alias("after"))
    found = found.withColumns({"runs": _parts(F.col("whole"), KEY), "gaps": F.split("whole", KEY)})
    # A run has its own surroundings only, so that a text without blanks is not copied for each of its runs.
    gap, first, last = lambda i: F.get("gaps", i), lambda i: i == 0, lambda i: i == F.size("runs") - 1
    lead = lambda i: F.when(first(i) | gap(i).rlike("[A-Za-z0-9]"), gap(i)).otherwise(F.concat(F.get("runs", i - 1), gap(i)))
    name = lambda i: F.regexp_extract(F.substring(lead(i), -64, 64), r"([A-Za-z0-9_]+)[^A-Za-z0-9_]*$", 1)
    each = F.transform("runs", lambda c, i: F.struct(
        i.alias("run"), c.alias("candidate"), F.concat(lead(i), c, F.when(last(i), gap(i + 1)).otherwise("")).alias("word"),
        F.when(first(i), F.col("before")).otherwise(name(i)).alias("before"), F.when(first(i), F.col("before2")).otherwise("").alias("before2"),
        F.when(last(i), F.col("after")).otherwise("").alias("after")))
    out = found.select("id", "place", F.explode_outer(F.filter(each, lambda c: c["candidate"].rlike("[0-9]"))).alias("c")).filter("c is not null")
    return out.select("id", "place", "c.run", "c.candidate", "c.word", "c.before", "c.before2", "c.after")


def dictionary(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY_WORDS) -> DataFrame:
    """(entry, n): the commonest words of three to eight small letters, counted over all documents."""
    words = F.regexp_extract_all(F.lower(F.coalesce(col(text_col).cast("string"), F.lit(""))), F.lit(r"(?<![^\s])([a-z]{3,8})(?![a-z0-9])"))
    counts = docs.select(F.explode_outer(words).alias("entry")).dropna().groupBy("entry").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "entry").limit(size)


def _parts(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"))


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """The candidates with the numbers in ``NUMBERS`` and hashed context words."""
    keyed = found.withColumn("_low", F.lower("candidate"))
    length = F.length("candidate")
    # Of letter pairs: how likely the dictionary makes the second after the first.
    pairs = (words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("entry") - 1), lambda i: F.substring("entry", i, F.lit(2)))).alias("pair"), "n")
             .groupBy("pair").agg(F.sum("n").alias("n")))
    given = Window.partitionBy(F.substring("pair", 1, 1))
    likely = pairs.select("pair", F.log(F.col("n") / F.sum("n").over(given)).alias("p"))
    distinct = keyed.select("candidate", "_low").distinct()
    seen = distinct.withColumn("pair", F.explode_outer(F.transform(F.sequence(F.lit(1), F.length("_low") - 1), lambda i: F.substring("_low", i, F.lit(2)))))
    by_pair = seen.join(F.broadcast(likely), "pair", "left").groupBy("candidate").agg(F.avg(F.coalesce("p", F.lit(-8.0))).alias("likely"))
    runs = distinct.withColumn("entry", F.explode_outer(_parts(F.col("_low"), "[a-z]{3,}")))
    by_word = (runs.join(F.broadcast(words.select("entry", F.length("entry").alias("known"))), "entry", "left")
               .groupBy("candidate").agg((F.coalesce(F.sum("known"), F.lit(0)) / F.first(F.length("candidate"))).alias("covered")))
    chars = F.split("candidate", "")
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / length)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace("candidate", "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    changes = lambda pattern: F.regexp_count(kinds, F.lit(pattern)) / length
    named = F.lower(F.concat_ws(" ", "before2", "before", "word"))
    out = keyed.join(by_pair, "candidate", "left").join(by_word, "candidate", "left")
    context = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z]+", ""))
    return out.select(
        *found.columns, length.cast("double").alias("length"), (-F.aggregate(shares, F.lit(0.0), lambda s, p: s + p * F.log2(p))).alias("entropy"),
        (F.regexp_count("candidate", F.lit("[0-9]")) / length).alias("digits"), (F.regexp_count("candidate", F.lit("[A-Z]")) / length).alias("upper"),
        changes("(?<=a)A|(?<=A)a").alias("changes"), changes("(?<=0)[aA]|(?<=[aA])0").alias("digit_changes"),
        F.coalesce("likely", F.lit(-8.0)).alias("likely"), F.coalesce("covered", F.lit(0.0)).alias("covered"),
        F.col("word").rlike(r"[\\/].*[\\/]|://|\.[a-z]{2,4}$").cast("double").alias("in_path"), named.rlike("[=:]").cast("double").alias("assigned"),
        context("before").alias("before_word"), context("before2").alias("before2_word"), context("after").alias("after_word"))


def forest(trees: int = 40, depth: int = 6) -> Pipeline:
    hasher = FeatureHasher(inputCols=["before_word", "before2_word", "after_word"], outputCol="context", numFeatures=CONTEXT_WORDS)
    return Pipeline(stages=[hasher, VectorAssembler(inputCols=[*NUMBERS, "context"], outputCol="features"),
                            RandomForestClassifier(featuresCol="features", labelCol="secret", numTrees=trees, maxDepth=depth, seed=7)])


def fit_forest(findings: DataFrame, limit: int = MAX_FINDINGS) -> PipelineModel:
    """Fits the forest on at most ``limit`` described findings with a 0/1 column ``secret``, chosen by their hash."""
    chosen = findings.orderBy(F.xxhash64("id", "place", "candidate"), "id", "place", "run").limit(limit)
    return forest().fit(chosen.withColumn("secret", F.col("secret").cast("double")))


def judged(found: DataFrame, model: PipelineModel) -> DataFrame:
    """(id, place, run, candidate, score): the share of trees that call the candidate a secret."""
    scored = model.transform(found)
    return scored.select("id", "place", "run", "candidate", vector_to_array("probability")[1].alias("score"))


def rule_labels(found: DataFrame) -> DataFrame:
    """Findings labelled by their surroundings: an assignment to a name of a credential marks a secret.

    Stands in for a reviewers' table: 1 where a credential's name and an assignment precede a token of mixed letters and
    digits, 0 for other tokens.
    """
    named = F.lower(F.concat_ws(" ", "before2", "before", "word")).rlike(r"(token|secret|passw|api.?key|credential)\w*\W*[=:]")
    mixed = F.col("candidate").rlike("[A-Za-z].*[0-9]|[0-9].*[A-Za-z]")
    return found.withColumn("secret", (named & mixed).cast("int"))


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = 0.5) -> DataFrame:
    """(id, place, run, candidate, score, secret) for every candidate of every document.

    ``findings`` are labelled candidates (columns of ``candidates`` and ``secret``); without them the documents' own are
    labelled by ``rule_labels``.  Where all labels agree, that label is every score.  Documents without candidates do
    not appear; an empty table gives no rows.
    """
    found = checkpointed(described(candidates(docs, id_col, text_col), dictionary(docs, text_col)))
    known = rule_labels(found) if findings is None else described(findings, dictionary(docs, text_col)).join(
        findings.select("id", "place", "run", "candidate", "secret"), ["id", "place", "run", "candidate"])
    counts = [r["secret"] for r in known.select("secret").distinct().collect()]
    if len(counts) < 2:
        out = found.select("id", "place", "run", "candidate", F.lit(float(counts[0]) if counts else 0.0).alias("score"))
    else:
        out = judged(found, fit_forest(known))
    return out.withColumn("secret", F.col("score") >= threshold)


def redact_secrets(docs: DataFrame, scanned: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The documents with the found secrets replaced by ``mark``; other columns and texts stay."""
    hits = scanned.filter("secret").groupBy(F.col("id").alias("_id")).agg(F.collect_set("candidate").alias("_secrets"))
    # Longer ones first: one secret may be a part of another.
    longest = F.transform(F.sort_array(F.transform("_secrets", lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))), asc=False), lambda x: x["s"])
    text = F.aggregate(longest, col(text_col), lambda t, s: F.replace(t, s, F.lit(mark)))
    joined = docs.join(hits, col(id_col) == F.col("_id"), "left")
    return joined.select(*[F.when(F.col("_secrets").isNull(), col(c)).otherwise(text).alias(c) if c == text_col else col(c) for c in docs.columns])
