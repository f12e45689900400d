"""Weighted similarity of one case to all others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions.exprs import strip, truthy

#: Columns that the score reads.
COLUMNS = ("id", "crime_type", "bank", "domain", "transaction_id", "upi_id", "amount", "crypto_wallet", "ip_address", "district")
#: Results asked for, at least and at most.
FEWEST, MOST = 1, 20


def score(base: str, other: str) -> Column:
    """Points of two aliased rows, 18 at most; the amount's tolerance is a tenth of the base's."""

    def pair(name: str) -> tuple[Column, Column]:
        return F.col(f"{base}.{name}"), F.col(f"{other}.{name}")

    def same(name: str, points: int, shape=lambda c: c, need=truthy) -> Column:
        a, b = pair(name)
        return F.when(need(a) & need(b) & (shape(a) == shape(b)), points).otherwise(0)

    present = lambda c: c.isNotNull()
    loose = lambda c: F.lower(strip(c))
    crime_a, crime_b = pair("crime_type")
    amount_a, amount_b = (strip(c).try_cast("double") for c in pair("amount"))
    near = F.when((amount_a != 0) & (F.abs(amount_a - amount_b) / F.abs(amount_a) <= 0.1), 1).otherwise(0)
    parts = [F.when(crime_a.eqNullSafe(crime_b), 2).otherwise(0), near, same("transaction_id", 3, strip), same("upi_id", 3, loose), same("district", 1)]
    parts += [same(name, 2, loose, present) for name in ("bank", "domain", "crypto_wallet", "ip_address")]
    return reduce(Column.__add__, parts)


def similar_cases(complaints: DataFrame, case_id: int, limit: int = 5) -> DataFrame:
    """The most similar other cases: case_id, similarity_score and the case, best first, equal ones by id.

    One scan: the base case is a pushed-down lookup of one row, which is broadcast; the others
    are scored where they lie and cut to the top on each task. Unknown ids give no row.
    """
    wanted = max(FEWEST, min(int(limit), MOST))
    base = complaints.where(F.col("id") == case_id).select(*COLUMNS).limit(1).alias("base")
    others = complaints.where(F.col("id") != case_id).alias("other")
    scored = others.crossJoin(F.broadcast(base)).select(F.col("other.id").alias("case_id"), score("base", "other").alias("similarity_score"), F.struct("other.*").alias("case"))
    return scored.orderBy(F.desc("similarity_score"), F.asc("case_id")).limit(wanted)
