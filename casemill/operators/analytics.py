"""Fixed analytics over complaints. Every grouping is pre-aggregated before it is shuffled."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions.exprs import half_even, sqlite_float

#: Days of a trend, at most.
MOST_DAYS = 60


def top_groups(df: DataFrame, key: str, limit: int, count: str = "count", null_group: bool = False, drop_empty: bool = True) -> DataFrame:
    """The most frequent values, most frequent first and equal ones by name.

    Values are counted without nulls unless wanted. The empty value takes its place among the
    top and is dropped afterwards, so fewer rows than the limit may remain.
    """
    rows = df if null_group else df.where(F.col(key).isNotNull())
    top = rows.groupBy(key).agg(F.count(F.lit(1)).alias(count)).orderBy(F.desc(count), F.asc(key)).limit(limit)
    return top.where(F.col(key) != "") if drop_empty else top


def counts(df: DataFrame) -> DataFrame:
    """All totals of the summary in one pass and one row."""
    return df.agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(F.col("status") == "open").alias("open_cases"),
        F.count_if(F.col("status") == "resolved").alias("resolved_cases"),
        half_even(F.coalesce(F.avg(F.col("severity").cast("double")), F.lit(0.0)), 2).alias("avg_severity"),
        half_even(F.coalesce(F.sum(sqlite_float(F.col("amount"))), F.lit(0.0)), 2).alias("total_amount_at_risk"),
        F.count_if(F.col("severity") >= 8).alias("high_severity_count"),
    )


def summary(df: DataFrame, generated_at: Column | None = None, top: int = 6) -> DataFrame:
    """One row: the totals, the top crimes as an array, and when it was made."""
    crimes = top_groups(df, "crime_type", top, null_group=True, drop_empty=False)
    ranked = crimes.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("_order"), "crime_type", "count"))), lambda x: F.struct(x["crime_type"].alias("crime_type"), x["count"].alias("count"))).alias("top_crimes"))
    return counts(df).crossJoin(ranked).withColumn("generated_at", generated_at if generated_at is not None else F.current_timestamp())


def period(as_of: dt.date, days: int) -> tuple[dt.date, dt.date, int]:
    """(first day, last day, days): days from 1 to MOST_DAYS, both ends included."""
    days = max(1, min(int(days), MOST_DAYS))
    return as_of - dt.timedelta(days=days - 1), as_of, days


def trends(df: DataFrame, as_of: dt.date, days: int = 14) -> DataFrame:
    """A row for each day of the period with its number of complaints, zero included."""
    first, last, days = period(as_of, days)
    since = df.where(F.col("created_at") >= F.lit(first).cast("timestamp"))
    per_day = since.groupBy(F.to_date("created_at").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    calendar = df.sparkSession.range(days).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("date"))
    return calendar.join(per_day, "date", "left").select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.coalesce("n", F.lit(0).cast("long")).alias("total")).orderBy("date")


def period_top_crimes(df: DataFrame, as_of: dt.date, days: int = 14, top: int = 5) -> DataFrame:
    first, _, _ = period(as_of, days)
    return top_groups(df.where(F.col("created_at") >= F.lit(first).cast("timestamp")), "crime_type", top, null_group=True)


def recent(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first, equal times by id. Without a limit this sorts everything, by range partitions."""
    ordered = df.orderBy(F.desc("created_at"), F.asc("id"))
    return ordered if limit is None else ordered.limit(limit)


def case_audit(audit: DataFrame, case_id: int | None = None, complaints: DataFrame | None = None, limit: int = 50) -> DataFrame:
    """The newest audit rows of a case; with `complaints`, those of each of them, ranked by row number within the case.

    A single case is a pushed-down filter. For many, the ranking is limited per case before
    the shuffle (window group limit), so a case with many rows is cut on the map side.
    """
    if complaints is None:
        return audit.where(F.col("complaint_id") == case_id).orderBy(F.desc("request_received_at"), F.asc("id")).limit(limit)
    from pyspark.sql.window import Window

    nth = F.row_number().over(Window.partitionBy("complaint_id").orderBy(F.desc("request_received_at"), F.asc("id")))
    latest = audit.withColumn("nth", nth).where(F.col("nth") <= limit)
    return complaints.select(F.col("id").alias("complaint_id")).join(latest, "complaint_id")
