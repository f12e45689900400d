"""Coercion of stored, loosely typed rows to the read schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions.exprs import strip
from casemill.functions.schemas import COMPLAINTS


def to_double(value: Column, default: float | None = 0.0) -> Column:
    number = value.cast("string").try_cast("double")
    return number if default is None else F.coalesce(number, F.lit(default))


def severity(value: Column) -> Column:
    """Truncated, 1 to 10; 4 where there is no number."""
    number = strip(value.cast("string")).try_cast("double").try_cast("int")
    return F.when(number.isNull(), 4).otherwise(F.least(F.lit(10), F.greatest(F.lit(1), number)))


def text_or(value: Column, default: str) -> Column:
    plain = strip(value)
    return F.when(plain != "", plain).otherwise(F.lit(default))


def flag(value: Column) -> Column:
    return F.coalesce(F.lower(strip(value.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def _array_ddl(name: str) -> str:
    return COMPLAINTS[name].dataType.simpleString()


def json_array(value: Column, ddl: str) -> Column:
    return F.coalesce(F.from_json(value, ddl), F.from_json(F.lit("[]"), ddl))


def json_strings(value: Column) -> Column:
    return json_array(value, "array<string>")


def json_map(value: Column) -> Column:
    return F.coalesce(F.from_json(value, "map<string,double>"), F.from_json(F.lit("{}"), "map<string,double>"))


def unit(value: Column, default: float | None) -> Column:
    """Clamped to 0..1."""
    number = to_double(value, default)
    return F.when(number.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), number)))


RULES = {
    "confidence_score": to_double,
    "severity": severity,
    "crime_type": lambda c: text_or(c, "Unknown"),
    "summary": lambda c: text_or(c, "No summary generated"),
    "status": lambda c: text_or(c, "open"),
    "suspicious_domain": flag,
    "suspicious_ip": flag,
    "phones": lambda c: json_array(c, _array_ddl("phones")),
    "accounts": lambda c: json_array(c, _array_ddl("accounts")),
    "transactions": lambda c: json_array(c, _array_ddl("transactions")),
    "urls": lambda c: json_array(c, _array_ddl("urls")),
    "upi_ids": json_strings,
    "ifsc_codes": json_strings,
    "taxonomy_confidence": lambda c: unit(c, 0.0),
    "ocr_confidence": lambda c: unit(c, None),
    "field_confidence": json_map,
}


def coerce(df: DataFrame) -> DataFrame:
    """Applies the rule of every column that has one; the others pass."""
    return df.withColumns({k: rule(F.col(k)) for k, rule in RULES.items() if k in df.columns})
