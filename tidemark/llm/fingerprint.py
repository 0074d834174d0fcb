"""Document fingerprints by winnowing, in DataFrame functions only.

A text (A-Z lower-cased) is read as pieces of up to four characters that begin anew after blanks; in a run of more than
``LONG`` characters without blanks a piece begins at every character, so that no place of a run decides.  Rolling hashes of
``GRAM`` pieces are winnowed: of each window of ``WINDOW`` hashes the smallest is kept, the rightmost of equal ones, with
its position.  Two texts that share a run of GRAM + WINDOW - 1 pieces share a kept hash: any passage with LONG + 1
characters in a row without blanks, and any other with so many pieces between its first and last blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ascii_lower, checkpointed, col

GRAM, WINDOW = 4, 8
LONG = 16
PRIME = 2_147_483_647
STEP = 1_000_003
# Documents per range of ids; neighbours within a range meet in one task.
RANGE_ROWS = 2_048
# Ranges whose order one task may find; more are ordered range by range again.
SORTED_RANGES = 100_000


def _shifted(df: DataFrame, names: list[str], by: int, join) -> DataFrame:
    """Joins each array with itself moved on by some places; beyond the end the first operand stands alone."""
    return df.withColumns({n: F.zip_with(n, F.slice(n, by + 1, F.greatest(F.size(n), F.lit(0))), join) for n in names})


def with_prints(df: DataFrame, sources: dict[str, str]) -> DataFrame:
    """Adds a winnowed print array under each key of ``sources``, read from the text column it names.

    A print is hash * 2^32 + 2^32 - 1 - position.  Null and blank texts have none; a text with fewer pieces than a gram
    has one gram, one with fewer grams than a window has one window.
    """
    names = list(sources)
    counts = {f"{n}_n": F.greatest(F.size(n), F.lit(0)) for n in names}
    # A long run comes whole, and then a piece from each of its characters but the last three.
    pieces = F.lit(rf"(\S{{{LONG + 1},}}|\S{{1,4}})")
    df = df.withColumns({n: F.regexp_extract_all(ascii_lower(F.coalesce(col(t), F.lit(""))), pieces) for n, t in sources.items()})
    each = lambda p: F.when(F.length(p) > 4, F.regexp_extract_all(p, F.lit("(?s)(?=(.{4}))."))).otherwise(F.array(p))
    df = df.withColumns({n: F.when(F.exists(n, lambda p: F.length(p) > 4), F.flatten(F.transform(n, each))).otherwise(F.col(n)) for n in names})
    df = df.withColumns(counts)
    df = df.withColumns({n: F.transform(n, lambda p: F.pmod(F.xxhash64(p), F.lit(PRIME))) for n in names})
    for by, step in ((1, STEP), (2, STEP * STEP % PRIME)):
        df = _shifted(df, names, by, lambda x, y: F.pmod(x * step + F.coalesce(y, F.lit(0)), F.lit(PRIME)))
    grams = lambda n, less: F.slice(n, 1, F.when(F.col(f"{n}_n") > 0, F.greatest(F.lit(1), F.col(f"{n}_n") - less)).otherwise(0))
    df = df.withColumns({n: F.transform(grams(n, GRAM - 1), lambda h, i: F.shiftleft(h, 32) + F.lit(2 ** 32 - 1) - i) for n in names})
    for by in (1, 2, 4):
        df = _shifted(df, names, by, lambda x, y: F.least(x, y))
    df = df.withColumns({n: F.array_distinct(grams(n, GRAM + WINDOW - 2)) for n in names})
    return df.drop(*counts)


def print_text(prints: str) -> Column:
    """hash:position pairs, in the order of the text."""
    return F.array_join(F.transform(prints, lambda p: F.concat_ws(":", F.lower(F.hex(F.shiftright(p, 32))),
                                                                  F.lit(2 ** 32 - 1) - p.bitwiseAND(F.lit(2 ** 32 - 1)))), " ")


def likeness(a: str, b: str) -> Column:
    """Shared share of the distinct kept hashes, wherever they stand; 1 for two empty fingerprints."""
    hashes = lambda n: F.transform(n, lambda p: F.shiftright(p, 32))
    every = F.size(F.array_union(hashes(a), hashes(b)))
    return F.when(every == 0, 1.0).otherwise(F.size(F.array_intersect(hashes(a), hashes(b))) / every)


def _successors(keys: DataFrame, rows: int) -> DataFrame:
    """(key, next): the next larger of distinct whole numbers; null after the last."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if n <= SORTED_RANGES:
        return keys.withColumn("next", F.lead("key").over(Window.orderBy("key")))
    width = max(1, (high - low + 1) * rows // n)
    ranged = keys.withColumn("range", F.expr(f"(key - {low}) div {width}"))
    edges = ranged.groupBy("range").agg(F.min("key").alias("first"))
    after = _successors(edges.select(F.col("range").alias("key")), rows).select(F.col("key").alias("range"), F.col("next").alias("after"))
    following = after.join(edges.select(F.col("range").alias("after"), "first"), "after", "left").select("range", "first")
    inner = ranged.withColumn("inner", F.lead("key").over(Window.partitionBy("range").orderBy("key")))
    return inner.join(following, "range", "left").select("key", F.coalesce("inner", "first").alias("next"))


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "prints") -> DataFrame:
    """The documents with their print array (see ``with_prints``); rows keep their columns."""
    return with_prints(docs, {out: text_col})


def _ranged(plain: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``plain`` (offset, ...) with their ``range``, and the ranges (key); a range's key is its least offset.

    Ranges are equal slices of the offsets, and a slice with more than four times ``rows`` is sliced again between its
    own least and largest offset, until none is left; rows with equal offsets stay together and null ones come first.
    Only slices that are cut again are broadcast, at most one for each ``4 * rows`` rows.
    """
    def counted(df: DataFrame) -> DataFrame:
        return checkpointed(df.groupBy("range").agg(F.count("*").alias("n"), F.min("offset").alias("base"), F.max("offset").alias("top")))

    least, top, n = plain.agg(F.min("offset"), F.max("offset"), F.count("*")).first()
    span = (top or 0) - (least or 0) + 1
    width = max(1, min(span, span * rows // max(n, 1)))
    # Whole-number division: quotients of doubles would misplace large ids.
    out = plain.withColumn("range", F.coalesce(F.expr(f"(offset div {width}) * {width}"), F.lit(-1)))
    while True:
        counts = counted(out.select("range", "offset"))
        full = (counts.filter((F.col("n") > 4 * rows) & (F.col("base") < F.col("top")))
                .select("range", "base", F.greatest(F.lit(1), F.floor((F.col("top") - F.col("base") + 1) / F.col("n") * rows)).cast("bigint").alias("width")))
        if full.isEmpty():
            return out, counts.select(F.col("range").alias("key"))
        inner = F.expr("base + ((offset - base) div width) * width")
        out = out.join(F.broadcast(full), "range", "left").withColumn("range", F.coalesce(inner, "range")).drop("base", "width")


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = RANGE_ROWS) -> DataFrame:
    """(id, text, prints, next_text, next_prints): each document with the next by ascending id, the last with the first.

    Null texts read as empty, null ids come first, rows with equal ids are ordered by text.  Ids are whole numbers; they
    are dealt out in ranges of values that hold a bounded number of rows wherever the ids lie, and the texts are moved once.
    """
    ids = col(id_col).cast("bigint")
    low = docs.agg(F.min(ids)).first()[0] or 0
    plain = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
                        (ids - F.lit(low)).alias("offset"))
    plain, ranges = _ranged(plain, rows)
    plain = plain.drop("offset")
    start = ranges.agg(F.min("key").alias("key")).first()["key"]
    after = _successors(ranges, rows).select(F.col("key").alias("range"), F.coalesce("next", F.lit(start)).alias("after"))
    dealt = with_prints(plain.repartition("range"), {"prints": "text"})
    order = Window.partitionBy("range").orderBy("id", "text")
    own = dealt.withColumns({"next_text": F.lead("text").over(order), "next_prints": F.lead("prints").over(order),
                             "place": F.row_number().over(order)})
    firsts = (plain.repartition("range").withColumn("place", F.row_number().over(order)).filter("place = 1")
              .select(F.col("range").alias("after"), F.col("text").alias("first_text"))
              .join(after, "after").drop("after"))
    firsts = with_prints(firsts, {"first_prints": "first_text"}).alias("f")
    last = (F.col("d.range") == F.col("f.range")) & F.col("next_text").isNull()
    return own.alias("d").join(firsts, last, "left").select(
        "id", "text", "prints", F.coalesce("next_text", "first_text").alias("next_text"),
        F.coalesce("next_prints", "first_prints").alias("next_prints"))


def edited(text: Column, following: Column) -> Column:
    """The text whose last half (rounded down) gives way to as many first characters of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))
