"""First-match extraction of fields from a complaint's text, as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions import vocab as V
from casemill.functions.exprs import blank_to_null, contains_any, first_match, let, longest_contained, strip, truthy, without_commas


def phone(text: Column) -> Column:
    return first_match(text, V.PHONE)


def transaction_id(text: Column) -> Column:
    return first_match(text, V.TRANSACTION)


def account_number(text: Column) -> Column:
    return first_match(text, V.ACCOUNT)


def amount(text: Column) -> Column:
    """The number beside the first currency mark, before or after it; commas go, decimals stay."""
    return without_commas(F.coalesce(first_match(text, V.AMOUNT, 1), first_match(text, V.AMOUNT, 2)))


def _bank_shown(name: str) -> str:
    return name.upper() if name.upper() in V.UPPER_BANKS else name.title()


def bank(text: Column) -> Column:
    return let(F.lower(text), lambda low: longest_contained(low, V.BANKS, _bank_shown))


def district(text: Column) -> Column:
    return let(F.lower(text), lambda low: longest_contained(low, V.DISTRICTS))


def upi_id(text: Column) -> Column:
    return first_match(text, V.UPI)


def ifsc(text: Column) -> Column:
    return first_match(text, V.IFSC)


def normal_url(url: Column) -> Column:
    return let(url, lambda u: F.when(F.lower(u).startswith("www."), F.concat(F.lit("https://"), u)).otherwise(u))


def url(text: Column) -> Column:
    return normal_url(strip(first_match(text, V.URL)))


def domain(normalised_url: Column) -> Column:
    return F.lower(strip(first_match(normalised_url, V.DOMAIN)))


def crypto_wallet(text: Column) -> Column:
    return F.coalesce(*(first_match(text, p) for p in (V.ETH_WALLET, V.BECH32_WALLET, V.LEGACY_WALLET)))


def ip_address(text: Column) -> Column:
    return first_match(text, V.IP, 0)


def _iso(day: Column, month: Column, year: Column) -> Column:
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return F.concat(F.lpad(full, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))


def numeric_date(text: Column) -> Column:
    """Day, month and year with separators as yyyy-mm-dd; any numbers pass."""
    parts = F.split(first_match(text, V.NUMERIC_DATE, 0), r"[\/\-.]")
    return let(parts, lambda p: F.when(p.isNotNull(), _iso(p[0], p[1], p[2])))


def named_date(text: Column) -> Column:
    months = F.create_map(*(F.lit(x) for pair in V.MONTHS for x in pair))

    def shown(found: Column) -> Column:
        day, month, year = (F.regexp_extract(found, V.NAMED_DATE, i) for i in (1, 2, 3))
        return F.when(found != "", _iso(day, F.element_at(months, F.lower(month)), year))

    return let(F.regexp_extract(text, V.NAMED_DATE, 0), shown)


def date(text: Column) -> Column:
    return F.coalesce(numeric_date(text), named_date(text))


def time(text: Column) -> Column:
    """The first clock time as 24-hour HH:MM; null if it is out of range."""

    def shown(found: Column) -> Column:
        half = F.lower(F.regexp_extract(found, V.CLOCK, 2))
        return let(F.split(F.regexp_extract(found, V.CLOCK, 1), ":"), lambda p: let(_day_hour(p[0].try_cast("int"), half), lambda h: _clock(h, F.get(p, F.lit(1)).try_cast("int"))))

    return let(F.regexp_extract(text, V.CLOCK, 0), shown)


def _day_hour(hour: Column, half: Column) -> Column:
    return F.when((half == "pm") & (hour >= 1) & (hour < 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)


def _clock(hour: Column, minute: Column) -> Column:
    return F.when((hour <= 23) & (minute <= 59), F.format_string("%02d:%02d", hour, minute))


def suspicious_domain(name: Column) -> Column:

    def bad(d: Column) -> Column:
        tld = reduce(Column.__or__, (d.endswith(t) for t in V.SUSPICIOUS_TLDS))
        return (d != "") & (tld | contains_any(d, V.SUSPICIOUS_DOMAIN_WORDS) | ((F.length(d) >= V.LONG_DOMAIN) & d.contains("-")))

    return F.coalesce(let(F.lower(strip(name)), bad), F.lit(False))


#: Address blocks that are not public (private, loopback, link-local, multicast, reserved, documentation),
#: as first address and prefix length, and two public addresses within them.
_NOT_PUBLIC = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
_PUBLIC_WITHIN = ("192.0.0.9", "192.0.0.10")


def _ip_number(address: str) -> int:
    return reduce(lambda n, part: n * 256 + int(part), address.split("."), 0)


def suspicious_ip(address: Column) -> Column:
    """A public address. Parts with a leading zero make no address."""

    def public(number: Column) -> Column:
        closed = reduce(Column.__or__, (F.shiftright(number, 32 - bits) == _ip_number(base) >> (32 - bits) for base, bits in _NOT_PUBLIC))
        return ~closed | number.isin(*map(_ip_number, _PUBLIC_WITHIN))

    parts = F.transform(F.split(address, r"\."), lambda x: x.try_cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda n, x: n * 256 + x)
    return F.coalesce(truthy(address) & ~address.rlike(r"(^|\.)0[0-9]") & let(number, public), F.lit(False))


def field_confidence(prefix: str = "") -> Column:
    """0.95 for each field that has a value, 0.7 for each suspicion, else 0, from the columns of these names."""
    pairs = [(k, F.when(truthy(F.col(prefix + k)), 0.95).otherwise(0.0)) for k in V.CONFIDENCE_KEYS]
    pairs += [(k, F.when(F.col(prefix + k), 0.7).otherwise(0.0)) for k in ("suspicious_domain", "suspicious_ip")]
    return F.map_from_arrays(F.array(*(F.lit(k) for k, _ in pairs)), F.array(*(v for _, v in pairs)))


#: Fields that come straight from the text, in the order of the record.
FIELDS = {
    "phone": phone,
    "district": district,
    "amount": amount,
    "transaction_id": transaction_id,
    "account_number": account_number,
    "bank": bank,
    "upi_id": upi_id,
    "ifsc": ifsc,
    "url": url,
    "crypto_wallet": crypto_wallet,
    "ip_address": ip_address,
    "date": date,
    "time": time,
}
#: Those that come from other fields.
DERIVED = ("location", "domain", "suspicious_domain", "suspicious_ip")


def extract_fields(df: DataFrame, text_col: str = "text", prefix: str = "", fields=None) -> DataFrame:
    """Adds the extracted fields (all, or the named ones) under a prefix. A null text has none.

    Two projections: fields from the text, then fields from fields. No shuffle, no UDF.
    """
    wanted = set(fields or [*FIELDS, *DERIVED])
    needed = wanted | ({"url"} if wanted & {"domain", "suspicious_domain"} else set()) | ({"ip_address"} if "suspicious_ip" in wanted else set()) | ({"district"} if "location" in wanted else set())
    text = F.col(text_col)
    out = df.withColumns({prefix + k: f(text) for k, f in FIELDS.items() if k in needed})
    later = {}
    if "location" in wanted:
        later[prefix + "location"] = F.col(prefix + "district")
    if wanted & {"domain", "suspicious_domain"}:
        out = out.withColumn(prefix + "domain", domain(F.col(prefix + "url")))
    if "suspicious_domain" in wanted:
        later[prefix + "suspicious_domain"] = suspicious_domain(F.col(prefix + "domain"))
    if "suspicious_ip" in wanted:
        later[prefix + "suspicious_ip"] = suspicious_ip(F.col(prefix + "ip_address"))
    return out.withColumns(later) if later else out


def first_group(text: Column, pattern: str) -> Column:
    """First match of a pattern with or without a group, stripped."""
    import re

    return blank_to_null(strip(F.regexp_extract(text, pattern, 1 if re.compile(pattern.replace("(?iU)", "(?i)").replace("(?U)", "")).groups else 0)))
