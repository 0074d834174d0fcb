"""Issues to recommendations: normalise, group, rank and word them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import (CRITICAL_PREFIX, RECOMMENDATION_FALLBACK, RECOMMENDATION_TEXT, SEVERITY_ALIASES,
                      SEVERITY_PRIORITY)
from ..functions.selection import SORT_ROWS, group_numbers
from ..schema import col

BLANKS = " \t\n\r\f\v"


def _lowered(c: Column) -> Column:
    return F.lower(F.btrim(c, F.lit(BLANKS)))


def severity_normalize(severity: Column, danger: bool = True) -> Column:
    """One of the five severities; unknown or missing text is medium.

    ``danger`` says whether that word counts as critical; the deployability score reads it as unknown.
    """
    known = {s: s for s in SEVERITY_PRIORITY} | SEVERITY_ALIASES
    if not danger:
        known.pop("danger")
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, _lowered(severity)), F.lit("medium"))


def severity_rank(severity: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SEVERITY_PRIORITY.items() for x in pair])
    return F.element_at(table, severity)


def issue_normalize(issues: DataFrame) -> DataFrame:
    """Machine-safe type, named column, known severity and a description for every issue row."""
    kind = F.translate(_lowered(F.coalesce("type", F.lit("unknown_issue"))), " -/", "___")
    made = {
        "type": kind, "column": F.coalesce("column", F.lit("unknown")),
        "severity": severity_normalize(F.col("severity")),
        "description": F.coalesce("description", F.lit("No description provided.")),
    }
    return issues.select(*[made[c].alias(c) if c in made else col(c) for c in issues.columns])


def _text(kind: Column, severity: Column, columns: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in RECOMMENDATION_TEXT.items() for x in pair])
    wording = F.coalesce(F.try_element_at(table, kind), F.lit(RECOMMENDATION_FALLBACK))
    listed = F.replace(wording, F.lit("{columns}"), F.concat_ws(", ", F.slice(columns, 1, 5)))
    return F.concat(F.when(severity == "critical", F.lit(CRITICAL_PREFIX)).otherwise(F.lit("")), listed)


def recommendations(issues: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One recommendation per issue type (and per ``by`` group), ranked by severity, count and id.

    Takes normalised issues.  Per type only the highest severity, the count and the distinct column
    names are kept while grouping, so a type with most of the rows is combined before the shuffle; the
    issue rows themselves stay in their table and join back on ``recommendation_id``.
    """
    keys = [col(b) for b in by]
    names = {v: k for k, v in SEVERITY_PRIORITY.items()}
    label = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    grouped = issues.groupBy(*keys, "type").agg(
        F.max(severity_rank(F.col("severity"))).alias("__p"),
        F.array_sort(F.collect_set("column")).alias("affected_columns"),
        F.count(F.lit(1)).alias("issue_count"))
    rows = grouped.withColumn("severity", F.element_at(label, F.col("__p")))
    order = Window.partitionBy(*keys).orderBy(F.desc("__p"), F.desc("issue_count"), F.asc("recommendation_id"))
    return (rows.withColumn("recommendation_id", F.concat(F.lit("rec_"), F.col("type")))
            .withColumn("recommendation", _text(F.col("type"), F.col("severity"), F.col("affected_columns")))
            .withColumn("rank", F.row_number().over(order).cast("bigint"))
            .select(*keys, "recommendation_id", "severity", "affected_columns", "issue_count", "recommendation",
                    "rank"))


def with_issues(recs: DataFrame, issues: DataFrame) -> DataFrame:
    """Adds the issue list of each recommendation.

    For the issues of one audit: a check gives at most one issue per column or column pair, so a list
    is bounded by the width of the audited table.
    """
    lists = issues.groupBy(F.concat(F.lit("rec_"), F.col("type")).alias("recommendation_id")).agg(
        F.array_sort(F.collect_list(F.struct("type", "column", "severity", "description"))).alias("issues"))
    return recs.join(lists, "recommendation_id", "left")


def critical_issues(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count_if(F.col("severity") == "critical").alias("critical_issues"))


def severity_distribution(issues: DataFrame) -> DataFrame:
    """(severity, cnt) over normalised severities."""
    return issues.groupBy("severity").agg(F.count(F.lit(1)).alias("cnt"))


def severity_filter(rows: DataFrame, wanted: str) -> DataFrame:
    """Rows of one severity after normalisation; ``All`` keeps every row."""
    if wanted == "All":
        return rows
    return rows.filter(severity_normalize(F.col("severity"), danger=False) == wanted.lower())


def issues_by_type(issues: DataFrame, key: str, small: int = SORT_ROWS) -> DataFrame:
    """Adds ``number``: the position of an issue inside its type, by a unique numeric key."""
    return group_numbers(issues, "type", key, "number", small)
