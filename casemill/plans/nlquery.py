"""Questions in words, compiled to filters: parsed without Spark, applied as columns."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.functions import vocab as V
from casemill.functions.exprs import sqlite_float
from casemill.operators.analytics import top_groups

_CURRENCY = r"(?:₹|rs\.?|rupees?)"
_THRESHOLD = re.compile(rf"(?:above|over|more than|greater than)\s*{_CURRENCY}?\s*([0-9][0-9,]*)", re.IGNORECASE)
_PRICE = re.compile(rf"{_CURRENCY}\s*([0-9][0-9,]*)", re.IGNORECASE)
_DAYS = tuple(re.compile(rf"{word}\s+(\d+)\s+day", re.IGNORECASE) for word in ("last", "past"))
DEFAULT_LIMIT, MOST = 50, 200


@dataclass(frozen=True)
class NLPlan:
    """What a question asks for. `fraud` says whether the amount counts."""

    crime_type: str | None
    bank: str | None
    district: str | None
    min_amount: float | None
    since: dt.datetime | None
    fraud: bool
    district_wise: bool
    limit: int

    def explain(self) -> str:
        """The filters as SQL, for people; shows the amount and district even where they are not applied."""
        shown = (
            (self.crime_type, f"crime_type = '{self.crime_type}'"),
            (self.bank, f"bank ILIKE '%{self.bank}%'"),
            (self.district, f"district = '{self.district}'"),
            (self.min_amount, f"CAST(amount AS FLOAT) >= {self.min_amount}"),
            (self.since, f"created_at >= '{self.since.isoformat() if self.since else ''}'"),
        )
        where = " AND ".join(text for value, text in shown if value is not None)
        return "SELECT * FROM complaints" + (f" WHERE {where}" if where else "")


def _first(question: str, pairs) -> str | None:
    return next((value for word, value in pairs if word in question), None)


def parse(question: str, now: dt.datetime, limit: int | None = None) -> NLPlan:
    question = question.strip()
    if not question:
        raise ValueError("missing query")
    low = question.lower()
    price = _THRESHOLD.search(question) or _PRICE.search(question)
    days = next((m for p in _DAYS if (m := p.search(question))), None)
    return NLPlan(
        crime_type=_first(low, V.QUERY_CRIMES),
        bank=_first(low, V.QUERY_BANKS),
        district=_first(low, [(d.lower(), d) for d in V.QUERY_DISTRICTS]),
        min_amount=float(price[1].replace(",", "")) if price else None,
        since=now - dt.timedelta(days=int(days[1])) if days else None,
        fraud="fraud" in low,
        district_wise="district-wise" in low or "district wise" in low,
        limit=max(1, min(int(limit or DEFAULT_LIMIT), MOST)),
    )


def filtered(complaints: DataFrame, plan: NLPlan) -> DataFrame:
    """The rows a plan asks for; equalities and ranges reach the scan."""
    out = complaints
    if plan.crime_type:
        out = out.where(F.col("crime_type") == plan.crime_type)
    if plan.bank:
        out = out.where(F.col("bank").ilike(f"%{plan.bank}%"))
    if plan.district and not plan.district_wise:
        out = out.where(F.col("district") == plan.district)
    if plan.min_amount is not None and plan.fraud:
        out = out.where(sqlite_float(F.col("amount")) >= plan.min_amount)
    if plan.since is not None:
        out = out.where(F.col("created_at") >= F.lit(plan.since))
    return out


def answer(complaints: DataFrame, plan: NLPlan) -> DataFrame:
    """District counts (top 20), or the gravest cases, equal ones by id."""
    rows = filtered(complaints, plan)
    if plan.district_wise:
        return top_groups(rows, "district", 20)
    return rows.orderBy(F.desc("severity"), F.asc("id")).limit(plan.limit)
