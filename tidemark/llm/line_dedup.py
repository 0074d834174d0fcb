"""Line deduplication over content-defined chunks of lines, in DataFrame functions only.

Rolling hashes over the line hashes of a text choose where chunks begin and end, so that a passage is cut in the same way
wherever it stands.  A boundary reads no line outside its chunk: under the hash of one line a chunk runs from a line to
the next of the same parity, so of any three lines two bound a chunk, and chunks overlap; under the hash of two lines
seven of eight pairs of neighbours are chunks of their own.  Blank lines bound nothing, and a chunk has a least number of words.
Chunks that occur again anywhere in the corpus are removed but for their first occurrence.  Hashes only propose: removal
needs equal bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import col, unused

DIVISOR = 8
PRIME, STEP = 2_147_483_647, 31
# A shorter chunk says too little to be a repetition: closing brackets, blank lines, single names.
MIN_WORDS = 10
# A chunk travels as one number: first line * SPAN + last line.
SPAN = 1 << 31


def _first(code: Column) -> Column:
    return F.shiftright(code, 31).cast("int")


def _last(code: Column) -> Column:
    return F.pmod(code, F.lit(SPAN)).cast("int")


def _with_chunks(docs: DataFrame, min_words: int, divisor: int) -> DataFrame:
    """Adds ``_lines`` and ``_codes``, the chunks of ``_text``; null for a null text."""
    def line_hash(line: Column) -> Column:
        return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("bigint")

    def words(first: Column, last: Column) -> Column:
        return F.aggregate(F.slice("_words", first + 1, last - first + 1), F.lit(0), lambda n, w: n + w)

    def code(first: Column, last: Column) -> Column:
        return first.cast("bigint") * F.lit(SPAN) + last

    def of_one(places: str) -> Column:
        """From each line to the next of its parity with which the chunk has words enough."""
        def chunk(first: Column, m: Column) -> Column:
            near = F.get(places, m + 1)
            # Every place holds a word, so no chunk needs more than ``min_words`` of them.
            later = F.filter(F.slice(places, m + 3, min_words), lambda e: words(first, e) >= min_words)
            return code(first, F.when(words(first, near) >= min_words, near).otherwise(F.get(later, 0)))
        return F.transform(places, chunk)

    def of_two(first: Column, m: Column) -> Column:
        last = F.get("_places", m + 1)
        rolled = F.pmod(F.get("_hashes", first) * STEP + F.get("_hashes", last), F.lit(PRIME))
        return F.when((rolled % divisor != 0) & (words(first, last) >= min_words), code(first, last))

    odd = lambda i: F.get("_hashes", i) % 2 == 1
    return (docs.withColumn("_lines", F.split("_text", "\n"))
            .withColumns({"_words": F.transform("_lines", lambda x: F.regexp_count(x, F.lit(r"[^\x09-\x0D\x20]+"))),
                          "_hashes": F.transform("_lines", line_hash)})
            .withColumn("_places", F.filter(F.transform("_words", lambda n, i: F.when(n > 0, i)), lambda i: i.isNotNull()))
            .withColumns({"_odd": F.filter("_places", odd), "_even": F.filter("_places", lambda i: ~odd(i))})
            .withColumn("_codes", F.array_distinct(F.filter(
                F.concat(of_one("_odd"), of_one("_even"), F.transform("_places", of_two)), lambda c: c.isNotNull())))
            .drop("_words", "_hashes", "_places", "_odd", "_even"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                divisor: int = DIVISOR) -> DataFrame:
    """The documents without repeated chunks, and ``_lines`` and ``_removed``: line counts.

    The two counts stand last and get a number behind their name where the table has such a column.  Lines end at
    newlines, words are what stands between blanks.  Of equal chunks the first place keeps its lines, that with the
    smallest (id, hash of the text, line number), null ids first; elsewhere all lines of the chunk go, unless it overlaps
    its first place.  So of each line one copy stays.  Passages of three or more lines and ``min_words`` always hold a
    chunk, those of two lines in fifteen of sixteen cases.  Equal rows (id and text) count as one document and stay alike.
    Null texts stay null with 0 lines; an empty text is one empty line.  A text that loses all lines becomes empty.

    A chunk that a third of all documents hold is one hot key of the joins below: its rows are small (no text) and the
    adaptive join splits them; the byte comparison is a grouping that each task combines first.
    """
    n_lines, n_removed = unused(docs, "_lines", "_removed")
    # The row's identity for the decisions, never null itself; its own columns may have any names.
    text_of = col(text_col).cast("string")
    at = F.struct(col(id_col).alias("id"), F.xxhash64(text_of).alias("mark")).alias("_at")
    # Texts go through one exchange, which both joins with them share: it holds the same columns for both.
    plain = docs.select(at, text_of.alias("_text"))
    place = lambda back: F.struct("_at", (_first(F.col("_code")) - back).alias("_start"))
    lines_of = lambda c: F.slice("_lines", _first(c) + 1, _last(c) - _first(c) + 1)
    cut = _with_chunks(plain, min_words, divisor)
    # The outer form: a plain explode would have its emptiness tested below, on chunks made twice.
    seen = (cut.select("_at", F.explode_outer(F.transform("_codes", lambda c: F.struct(
        c.alias("code"), F.xxhash64(lines_of(c)).alias("key")))).alias("c")).filter("c is not null")
        .select("_at", F.col("c.code").alias("_code"), F.col("c.key").alias("_key")))
    again = seen.groupBy("_key").agg(F.count("*").alias("n")).filter("n > 1").select("_key")
    found = seen.join(again, "_key").groupBy("_at").agg(F.collect_set("_code").alias("_codes"))
    # Only chunks whose hash occurs again are compared as bytes.
    bodies = (plain.join(found, "_at").select("_at", F.split("_text", "\n").alias("_lines"), "_codes")
              .select("_at", F.explode_outer(F.transform("_codes", lambda c: F.struct(
                  c.alias("code"), F.array_join(lines_of(c), "\n").alias("body")))).alias("c"))
              .select("_at", F.col("c.code").alias("_code"), F.col("c.body").alias("_body"),
                      F.unhex(F.md5(F.col("c.body").cast("binary"))).alias("_digest")))
    equal = bodies.groupBy("_digest", "_body").agg(F.min(place(0)).alias("_least"), F.max(place(0)).alias("_most"))
    # The digest leads back to the rows and stands for one body only, else nothing is removed by it.
    firsts = (equal.groupBy("_digest").agg(F.count("*").alias("n"), F.min("_least").alias("_least"), F.max("_most").alias("_most"))
              .filter("n = 1 and _least < _most").select("_digest", "_least"))
    length = _last(F.col("_code")) - _first(F.col("_code"))
    out = (bodies.select("_at", "_code", "_digest").join(firsts, "_digest").filter(F.col("_least") < place(length))
           .groupBy("_at").agg(F.collect_set("_code").alias("_gone")))
    rows = docs.select(at, F.struct(F.lit(0).alias("_"), *[col(c) for c in docs.columns if c != text_col]).alias("_row"))
    joined = rows.join(plain.join(out, "_at", "left").dropDuplicates(["_at"]), "_at").select("_row", "_text", "_gone")
    # Set functions, as a lookup for each line would grow with the square of a text's lines.
    lost = F.flatten(F.transform("_gone", lambda c: F.sequence(_first(c), _last(c))))
    whole = joined.withColumn("_lines", F.split("_text", "\n")).withColumn(
        "_kept", F.when(F.col("_gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), lost)))
    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(
        F.array_join(F.transform("_kept", lambda i: F.get("_lines", i)), "\n"))
    n = F.when(F.col("_text").isNull(), 0).otherwise(F.size("_lines")).cast("bigint")
    made = F.struct(*[(text if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns], n.alias(n_lines),
                    F.when(F.col("_gone").isNull(), 0).otherwise(n - F.size("_kept")).cast("bigint").alias(n_removed))
    # As a generated row: a filter on plain columns would be pushed below the lines and cut them again for every line.
    return whole.select(F.inline_outer(F.array(made)))


def keep_deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without what ``dedup_lines`` removes and with their own columns; those that lose every line go.

    ``n_chars``, where there is one, is counted anew for shortened texts.
    """
    out = dedup_lines(docs, id_col, text_col)
    lines, removed = map(col, out.columns[-2:])
    out = out.filter((removed == 0) | (removed < lines))
    if "n_chars" in docs.columns:
        counted = F.when(removed > 0, F.length(col(text_col)).cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", counted.otherwise(col("n_chars")))
    return out.select(*map(col, docs.columns))
