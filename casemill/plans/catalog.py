"""Every query by name, and the same as SQL for DuckDB where SQL can say it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions import vocab as V
from casemill.functions.exprs import half_even, sqlite_float
from casemill.operators import analytics as A
from casemill.operators import classify as K
from casemill.operators import evaluate as E
from casemill.operators import extract as X
from casemill.operators import language as L
from casemill.operators import layout as Y
from casemill.operators import quality as Q
from casemill.operators.coerce import coerce
from casemill.operators.entities import extract_entities
from casemill.operators.similarity import similar_cases
from casemill.plans import ingest, nlquery, reconstruct
from casemill.sources import adapters as S

#: The day that trends end on and that questions are asked on: the last of the data.
AS_OF = dt.date(2001, 8, 1)
NOW = dt.datetime(2001, 8, 1)
CASE = 320
QUESTION = "Show fraud above Rs 50,000 in SBI bank in last 2000 days"
DISTRICT_QUESTION = "district-wise phishing cases in past 1500 days"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.strip()
        return f

    return register


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_FLOAT = r"(CASE WHEN amount IS NULL THEN NULL ELSE coalesce(TRY_CAST(nullif(regexp_extract(amount, '^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)', 1), '') AS DOUBLE), 0) END)"
_C = _with(S.COMPLAINTS_SQL)


# --- totals, top lists, trends ---


@query(
    _C
    + f"""SELECT count(*) AS total_cases, count(*) FILTER (status = 'open') AS open_cases, count(*) FILTER (status = 'resolved') AS resolved_cases,
  round_even(avg(CAST(severity AS DOUBLE)), 2) AS avg_severity, round_even(sum(CAST({_FLOAT} AS DECIMAL(18, 2)))::DOUBLE, 0) AS total_amount_at_risk,
  count(*) FILTER (severity >= 8) AS high_severity_count,
  (SELECT string_agg(crime_type || ':' || n, ',' ORDER BY n DESC, crime_type) FROM (SELECT crime_type, count(*) AS n FROM complaints GROUP BY 1 ORDER BY n DESC, crime_type LIMIT 6)) AS top_crimes FROM complaints"""
)
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals in whole rupees: sums of doubles differ in their last digits with the order of addition."""
    rows = A.summary(S.complaints(spark, sf_dir), F.lit(NOW))
    crimes = F.array_join(F.transform("top_crimes", lambda c: F.concat_ws(":", c["crime_type"], c["count"].cast("string"))), ",")
    return rows.drop("generated_at").withColumn("top_crimes", crimes).withColumn("total_amount_at_risk", half_even(F.col("total_amount_at_risk"), 0))


@query(_C + "SELECT crime_type, count(*) AS count FROM complaints GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def top_crimes(spark, sf_dir):
    return A.top_groups(S.complaints(spark, sf_dir), "crime_type", 6, null_group=True, drop_empty=False)


@query(_C + "SELECT * FROM (SELECT bank, count(*) AS count FROM complaints WHERE bank IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) WHERE bank <> ''")
def top_banks(spark, sf_dir):
    return A.top_groups(S.complaints(spark, sf_dir), "bank", 10)


@query(_C + "SELECT * FROM (SELECT district, count(*) AS count FROM complaints WHERE district IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) WHERE district <> ''")
def top_districts(spark, sf_dir):
    return A.top_groups(S.complaints(spark, sf_dir), "district", 10)


@query(
    _C
    + f"""SELECT strftime(d, '%Y-%m-%d') AS date, coalesce(n, 0) AS total FROM (SELECT unnest(generate_series(DATE '{AS_OF}' - 13, DATE '{AS_OF}', INTERVAL 1 DAY))::DATE AS d)
LEFT JOIN (SELECT created_at::DATE AS d, count(*) AS n FROM complaints WHERE created_at >= DATE '{AS_OF}' - 13 GROUP BY 1) USING (d)"""
)
def trends(spark, sf_dir):
    return A.trends(S.complaints(spark, sf_dir), AS_OF, 14)


@query(_C + f"SELECT crime_type, count(*) AS count FROM complaints WHERE created_at >= DATE '{AS_OF}' - 59 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def period_top_crimes(spark, sf_dir):
    return A.period_top_crimes(S.complaints(spark, sf_dir), AS_OF, 60)


@query(_C + f"SELECT id, amount, {_FLOAT} AS number FROM complaints")
def amount_cast(spark, sf_dir):
    return S.complaints(spark, sf_dir).select("id", "amount", sqlite_float(F.col("amount")).alias("number"))


# --- questions, single cases ---

_CASE_COLUMNS = ("id", "crime_type", "severity", "bank", "district", "amount", "status", "created_at")
_CASES = ", ".join(_CASE_COLUMNS)


@query(
    _C
    + f"""SELECT {_CASES} FROM complaints WHERE crime_type = 'Financial Fraud' AND bank ILIKE '%SBI%' AND {_FLOAT} >= 50000 AND created_at >= TIMESTAMP '{NOW}' - INTERVAL 2000 DAY
ORDER BY severity DESC, id LIMIT 50"""
)
def nl_cases(spark, sf_dir):
    return nlquery.answer(S.complaints(spark, sf_dir), nlquery.parse(QUESTION, NOW)).select(*_CASE_COLUMNS)


@query(
    _C
    + f"""SELECT * FROM (SELECT district, count(*) AS count FROM complaints WHERE crime_type = 'Phishing' AND created_at >= TIMESTAMP '{NOW}' - INTERVAL 1500 DAY AND district IS NOT NULL
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) WHERE district <> ''"""
)
def nl_district_counts(spark, sf_dir):
    return nlquery.answer(S.complaints(spark, sf_dir), nlquery.parse(DISTRICT_QUESTION, NOW))


@query(_C + f"SELECT {_CASES} FROM complaints ORDER BY created_at DESC, id")
def cases_recent(spark, sf_dir):
    return A.recent(S.complaints(spark, sf_dir)).select(*_CASE_COLUMNS)


@query(_C + f"SELECT {_CASES} FROM complaints WHERE id = {CASE}")
def case_lookup(spark, sf_dir):
    from casemill.sources.tables import lookup

    return lookup(S.complaints(spark, sf_dir), CASE).select(*_CASE_COLUMNS)


@query(
    _with(S.COMPLAINTS_SQL, S.AUDIT_SQL)
    + """SELECT complaint_id, id, event_type, request_received_at, details, CAST(nth AS INT) AS nth FROM
(SELECT a.*, row_number() OVER (PARTITION BY complaint_id ORDER BY request_received_at DESC, a.id) AS nth FROM audit a) JOIN (SELECT id AS cid FROM complaints) ON cid = complaint_id WHERE nth <= 50"""
)
def case_audit(spark, sf_dir):
    """The newest 50 audit rows of every case."""
    return A.case_audit(S.audit(spark, sf_dir), complaints=S.complaints(spark, sf_dir))


def _same(column: str, points: int, shape: str = "{}", need: str = "{} <> ''") -> str:
    a, b = f"b.{column}", f"o.{column}"
    return f"CASE WHEN {need.format(a)} AND {need.format(b)} AND {shape.format(a)} = {shape.format(b)} THEN {points} ELSE 0 END"


_LOOSE, _PRESENT = "lower(trim({}))", "{} IS NOT NULL"
_SCORE = " + ".join(
    [
        "CASE WHEN b.crime_type IS NOT DISTINCT FROM o.crime_type THEN 2 ELSE 0 END",
        "CASE WHEN TRY_CAST(b.amount AS DOUBLE) <> 0 AND abs(TRY_CAST(b.amount AS DOUBLE) - TRY_CAST(o.amount AS DOUBLE)) / abs(TRY_CAST(b.amount AS DOUBLE)) <= 0.1 THEN 1 ELSE 0 END",
        _same("transaction_id", 3, "trim({})"),
        _same("upi_id", 3, _LOOSE),
        _same("district", 1),
        *(_same(c, 2, _LOOSE, _PRESENT) for c in ("bank", "domain", "crypto_wallet", "ip_address")),
    ]
)


@query(_C + f"SELECT o.id AS case_id, CAST({_SCORE} AS INT) AS similarity_score, o.crime_type, o.bank FROM complaints o CROSS JOIN (SELECT * FROM complaints WHERE id = {CASE}) b WHERE o.id <> {CASE} ORDER BY 2 DESC, 1 LIMIT 20")
def similar(spark, sf_dir):
    return similar_cases(S.complaints(spark, sf_dir), CASE, 20).select("case_id", "similarity_score", F.col("case.crime_type"), F.col("case.bank"))


# --- extraction: the SQL derives what has to be found from the columns a text was made of ---

_P = _with(S.PARTS_SQL)


def _texts(spark, sf_dir) -> DataFrame:
    return S.complaint_texts(spark, sf_dir)


@query(
    _P
    + """SELECT key AS id, phone_digits AS phone, CASE WHEN variant IN (0, 2) THEN txn_digits END AS transaction_id, CASE WHEN variant = 2 THEN account_digits END AS account_number,
CASE variant WHEN 0 THEN rupees || '.50' WHEN 2 THEN rupees END AS amount FROM p"""
)
def extract_core(spark, sf_dir):
    return X.extract_fields(_texts(spark, sf_dir), fields=("phone", "transaction_id", "account_number", "amount")).select("id", "phone", "transaction_id", "account_number", "amount")


@query(
    _P
    + """SELECT key AS id, CASE WHEN variant = 0 THEN user || '@okhdfcbank' END AS upi_id, CASE WHEN variant = 2 THEN ifsc_code END AS ifsc,
CASE WHEN variant = 1 THEN 'https://secure-login' || site || '.xyz/kyc' END AS url, CASE WHEN variant = 1 THEN 'secure-login' || site || '.xyz' END AS domain,
variant = 1 AS suspicious_domain, CASE WHEN variant = 3 THEN '0x' || wallet_tail END AS crypto_wallet FROM p"""
)
def extract_ids(spark, sf_dir):
    wanted = ("upi_id", "ifsc", "url", "domain", "suspicious_domain", "crypto_wallet")
    return X.extract_fields(_texts(spark, sf_dir), fields=wanted).select("id", *wanted)


@query(
    _P
    + """SELECT key AS id, CASE variant WHEN 0 THEN '2026-' || lpad(month, 2, '0') || '-' || lpad(day, 2, '0') WHEN 1 THEN '2026-' || lpad(month, 2, '0') || '-' || lpad(day, 2, '0') WHEN 2 THEN '2025-09-' || lpad(day, 2, '0') END AS date,
CASE variant WHEN 0 THEN lpad(CAST(CASE WHEN hour < 12 THEN hour + 12 ELSE hour END AS VARCHAR), 2, '0') || ':' || minute WHEN 1 THEN '00:05' END AS time FROM p"""
)
def extract_datetime(spark, sf_dir):
    return X.extract_fields(_texts(spark, sf_dir), fields=("date", "time")).select("id", "date", "time")


@query(
    _P
    + "SELECT key AS id, CASE WHEN variant = 1 THEN (CASE WHEN private THEN '10.0.0.' ELSE '8.8.4.' END) || octet END AS ip_address, variant = 1 AND NOT private AS suspicious_ip FROM p"
)
def extract_ip(spark, sf_dir):
    return X.extract_fields(_texts(spark, sf_dir), fields=("ip_address", "suspicious_ip")).select("id", "ip_address", "suspicious_ip")


@query(
    r"""SELECT doc_id, nullif(regexp_extract(text, '\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b', 0), '') AS ip_address FROM documents"""
)
def document_ips(spark, sf_dir):
    docs = S.documents(spark, sf_dir)
    return docs.select("doc_id", X.ip_address(F.col("text")).alias("ip_address"))


@query(_P + "SELECT key AS id, CASE variant WHEN 0 THEN 'Hdfc Bank' WHEN 1 THEN 'Canara Bank' WHEN 2 THEN 'State Bank Of India' END AS bank, place AS district, place AS location FROM p")
def gazetteer_match(spark, sf_dir):
    return X.extract_fields(_texts(spark, sf_dir), fields=("bank", "district", "location")).select("id", "bank", "district", "location")


@query(
    _P
    + """SELECT key AS id, CASE variant WHEN 0 THEN second_digits || ':whatsapp_contact' || CASE WHEN phone_digits <> second_digits THEN ',' || phone_digits || ':' || 'phone' ELSE '' END
  WHEN 1 THEN phone_digits || ':suspect_phone' WHEN 2 THEN phone_digits || ':phone'
  ELSE phone_digits || ':suspect_phone' || CASE WHEN phone_digits <> second_digits THEN ',' || second_digits || ':whatsapp_contact' ELSE '' END END AS phones,
CASE variant WHEN 2 THEN account_digits || ':account_number,77' || account_digits || ':transfer_account' ELSE '' END AS accounts,
CASE WHEN variant IN (0, 2) THEN txn_digits ELSE '' END AS transactions,
CASE variant WHEN 1 THEN 'https://secure-login' || site || '.xyz/kyc,https://www.help' || site || '.com' ELSE '' END AS urls,
CASE variant WHEN 0 THEN user || '@okhdfcbank' ELSE '' END AS upi_ids, CASE variant WHEN 2 THEN ifsc_code ELSE '' END AS ifsc_codes,
CASE WHEN variant IN (0, 2, 3) THEN rupees END AS amount FROM p"""
)
def multi_entity(spark, sf_dir):
    rows = extract_entities(_texts(spark, sf_dir))
    typed = lambda c, k: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[k], x["type"])), ",").alias(c)
    plain = lambda c, k: F.array_join(F.transform(c, lambda x: x[k]), ",").alias(c)
    return rows.select("id", typed("phones", "number"), typed("accounts", "number"), plain("transactions", "id"), plain("urls", "url"), F.array_join("upi_ids", ",").alias("upi_ids"), F.array_join("ifsc_codes", ",").alias("ifsc_codes"), F.col("ctx_amount").alias("amount"))


# --- the whole ingest: classification, scores, fingerprints ---


@query(_P + "SELECT key AS id, CASE variant WHEN 0 THEN 0.44 WHEN 1 THEN CASE WHEN private THEN 0.5 ELSE 0.56 END WHEN 2 THEN 0.5 ELSE 0.31 END AS confidence_score FROM p")
def completeness(spark, sf_dir):
    return ingest.extract(_texts(spark, sf_dir)).select("id", "confidence_score")


@query(
    _P
    + """SELECT key AS id, sha256(CASE variant
 WHEN 0 THEN concat_ws('|', 'Financial Fraud', rupees, 'Hdfc Bank', '', txn_digits, '', user || '@okhdfcbank', '', '', place)
 WHEN 1 THEN concat_ws('|', 'Phishing', '', 'Canara Bank', 'secure-login' || site || '.xyz', '', '', '', '', (CASE WHEN private THEN '10.0.0.' ELSE '8.8.4.' END) || octet, place)
 WHEN 2 THEN concat_ws('|', 'Financial Fraud', rupees, 'State Bank Of India', '', txn_digits, account_digits, '', '', '', place)
 ELSE concat_ws('|', 'Harassment', rupees, '', '', '', '', '', '0x' || wallet_tail, '', place) END) AS fingerprint FROM p"""
)
def fingerprint(spark, sf_dir):
    return ingest.extract(_texts(spark, sf_dir)).select("id", "fingerprint")


@query(
    _P
    + """SELECT key AS id, CASE variant WHEN 0 THEN 'UPI Fraud' WHEN 1 THEN 'Phishing' WHEN 2 THEN 'Unknown' ELSE 'Sextortion' END AS label,
CASE variant WHEN 0 THEN 0.8 WHEN 1 THEN 0.95 WHEN 2 THEN 0.0 ELSE 0.8 END AS confidence, CASE variant WHEN 0 THEN 8 WHEN 1 THEN 6 WHEN 2 THEN 4 ELSE 7 END AS severity,
CASE variant WHEN 0 THEN 'upi,@ok' WHEN 1 THEN 'phishing,https://,www.' WHEN 2 THEN '' ELSE 'private photo,blackmail' END AS keywords FROM p"""
)
def taxonomy(spark, sf_dir):
    rows = K.with_taxonomy(_texts(spark, sf_dir), F.col("text"), "t")
    return rows.select("id", "t.label", "t.confidence", "t.severity", F.array_join("t.keywords", ",").alias("keywords"))


@query(_P + "SELECT key AS id, CASE variant WHEN 1 THEN 'Phishing' WHEN 3 THEN 'Harassment' ELSE 'Financial Fraud' END AS crime_type, CASE WHEN variant IN (0, 2) THEN 7 ELSE 5 END AS severity FROM p")
def heuristic_class(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", K.heuristic(F.col("text")).alias("h")).select("id", "h.crime_type", "h.severity")


@query(
    _P
    + """SELECT key AS id, CASE variant WHEN 0 THEN 'UPI Fraud' WHEN 1 THEN 'Phishing' WHEN 2 THEN 'Financial Fraud' ELSE 'Sextortion' END AS crime_type,
CASE variant WHEN 0 THEN 8 WHEN 1 THEN 6 ELSE 7 END AS severity FROM p"""
)
def hybrid_class(spark, sf_dir):
    return ingest.extract(_texts(spark, sf_dir)).select("id", "crime_type", "severity")


@query(_P + "SELECT key AS id, CASE WHEN variant = 2 THEN 'banking_fraud' ELSE 'cybercrime_complaint' END AS domain FROM p")
def domain_detect(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", K.domain_of(F.col("text")).alias("domain"))


def _sql_hits(words) -> str:
    return "(" + " + ".join(f"CAST(contains(t, '{w}') AS INT)" for w in words) + ")"


@query(
    "WITH l AS (SELECT doc_id, lower(text) AS t FROM documents), h AS (SELECT doc_id, "
    + ", ".join(f"{_sql_hits(words)} AS h{i}" for i, (_, words) in enumerate(V.DOMAINS))
    + " FROM l) SELECT doc_id, CASE WHEN greatest(h0, h1, h2, h3) = 0 THEN 'notes_documentation' "
    + " ".join(f"WHEN h{i} = greatest(h0, h1, h2, h3) THEN '{name}'" for i, (name, _) in enumerate(V.DOMAINS))
    + " END AS domain FROM h"
)
def document_domains(spark, sf_dir):
    return S.documents(spark, sf_dir).select("doc_id", K.domain_of(F.col("text")).alias("domain"))


@query(
    _P
    + """SELECT key AS id, 'open' AS status, 'Jaipur Cyber Cell' AS station_name, CASE WHEN variant IN (0, 2) THEN txn_digits END AS transaction_id,
CASE variant WHEN 0 THEN second_digits ELSE phone_digits END AS phone, CASE WHEN variant IN (0, 2, 3) THEN rupees END AS amount,
CASE variant WHEN 0 THEN 0.95 WHEN 1 THEN 0.0 ELSE CASE WHEN variant = 3 THEN 0.9 ELSE 0.95 END END AS amount_confidence FROM p"""
)
def ingest_rows(spark, sf_dir):
    """Complaint rows as stored."""
    rows = ingest.complaint_rows(_texts(spark, sf_dir), F.lit(NOW))
    return rows.select("id", "status", "station_name", "transaction_id", "phone", "amount", F.col("field_confidence")["amount"].alias("amount_confidence"))


@query(_P + "SELECT key AS complaint_id, 'EXTRACTED' AS event_type, 'Jaipur Cyber Cell' AS station_name FROM p")
def ingest_audit(spark, sf_dir):
    rows = ingest.complaint_rows(_texts(spark, sf_dir), F.lit(NOW))
    return ingest.audit_rows(rows).select("complaint_id", "event_type", "station_name")


# --- language ---


@query(
    """SELECT doc_id, length(regexp_replace(text, '[^ऀ-ॿ]', '', 'g')) AS devanagari, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits FROM documents"""
)
def script_counts(spark, sf_dir):
    counts = S.documents(spark, sf_dir).select("doc_id", L.script_counts(F.col("text")).alias("s"))
    return counts.select("doc_id", *(F.col(f"s.{c}").cast("long").alias(c) for c in ("devanagari", "latin", "digits")))


def _sql_language() -> str:
    """The decision tree for texts without Devanagari, which is all that the documents are."""
    dialects = ", ".join(f"{_sql_hits(words)} AS s_{name}" for name, words in V.DIALECTS)
    tokens = lambda words: f"len(list_intersect(k, [{', '.join(repr(w) for w in dict.fromkeys(words))}]))"
    pick = lambda names, top: "CASE " + " ".join(f"WHEN s_{n} = {top} THEN '{n}'" for n in names) + " END"
    names = [n for n, _ in V.DIALECTS]
    return f"""WITH l AS (SELECT doc_id, lower(text) AS t, text, regexp_extract_all(lower(text), '[ऀ-ॿA-Za-z]+') AS k FROM documents),
f AS (SELECT doc_id, text, {dialects}, {tokens(V.ENGLISH_WORDS)} AS e, {tokens(V.HINDI_ROMAN_WORDS)} AS h, {_sql_hits(V.REGIONAL_WORDS)} AS r,
  length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin FROM l),
g AS (SELECT *, greatest(s_marwari, s_mewari, s_shekhawati, s_braj) AS reg, CASE WHEN r >= 3 THEN 0.95 WHEN r >= 1 THEN 0.70 ELSE 0.0 END::DOUBLE AS prior FROM f),
d AS (SELECT *, CASE WHEN reg >= 2 THEN {pick(names[:4], 'reg')} ELSE {pick(names, 'greatest(reg, s_hinglish)')} END AS dialect,
  CASE WHEN reg >= 2 THEN reg ELSE greatest(reg, s_hinglish) END AS score FROM g),
v AS (SELECT doc_id, CASE
  WHEN trim(text) = '' THEN {{'l': 'unknown', 'd': 'unknown', 'c': 0.0::DOUBLE}}
  WHEN latin > 0 AND e >= 5 AND h <= 1 AND reg = 0 THEN {{'l': 'English', 'd': 'Standard English', 'c': 0.96::DOUBLE}}
  WHEN latin > 0 AND e >= 3 AND h <= 1 AND reg = 0 THEN {{'l': 'English', 'd': 'Standard English', 'c': 0.88::DOUBLE}}
  WHEN score > 0 AND dialect = 'hinglish' THEN {{'l': 'Hinglish', 'd': 'Hinglish', 'c': least(0.50::DOUBLE + score * 0.15::DOUBLE, 0.98::DOUBLE)}}
  WHEN score > 0 THEN {{'l': 'Hinglish', 'd': 'Romanized ' || upper(dialect[1]) || dialect[2:], 'c': least(0.50::DOUBLE + score * 0.15::DOUBLE, 0.98::DOUBLE)}}
  WHEN e >= 3 AND h = 0 THEN {{'l': 'English', 'd': 'Standard English', 'c': 0.95::DOUBLE}}
  WHEN h >= 2 AND prior > 0.5 THEN {{'l': 'Hinglish', 'd': 'Marwari-influenced Hinglish', 'c': greatest(least(0.70::DOUBLE + h * 0.05::DOUBLE, 0.90::DOUBLE), prior * 0.8::DOUBLE)}}
  WHEN h >= 2 THEN {{'l': 'Hinglish', 'd': 'Hinglish', 'c': least(0.70::DOUBLE + h * 0.05::DOUBLE, 0.90::DOUBLE)}}
  WHEN prior > 0.3 THEN {{'l': 'Hindi', 'd': 'Hindi (regional priors)', 'c': prior * 0.7::DOUBLE}}
  WHEN length(trim(text)) > 10 THEN {{'l': 'Mixed', 'd': 'Mixed Dialect', 'c': 0.65::DOUBLE}}
  ELSE {{'l': 'unknown', 'd': 'unknown', 'c': 0.30::DOUBLE}} END AS x FROM d)
SELECT doc_id, x.l AS language, x.d AS dialect, round(x.c, 6) AS language_confidence,
  CASE WHEN x.l = 'English' THEN 'english_structuring_only' WHEN x.l = 'Hindi' OR regexp_matches(lower(x.d), 'marwari|mewari|shekhawati|braj') THEN 'regional_normalize_translate'
       WHEN x.l IN ('Hinglish', 'Mixed') THEN 'selective_regional_translation' ELSE 'officer_review_required' END AS route FROM v"""


@query(_sql_language())
def language_route(spark, sf_dir):
    rows = L.detect_language(S.documents(spark, sf_dir))
    return rows.select("doc_id", "language", "dialect", F.round("language_confidence", 6).alias("language_confidence"), L.route(F.col("language"), F.col("dialect")).alias("route"))


_DIALECT_TEXT = "concat('Mharo paisa kat gayo, ', user, ' ko koni milyo. ', rupees, ' rupiya konya! (thane) pucho')"


@query(_P + "SELECT key AS id, 'Mera paisa kat gaya, ' || user || ' ko nahi milyo. ' || rupees || ' rupaye nahi! tujhee) pucho' AS normalized FROM p")
def dialect_normalize(spark, sf_dir):
    rows = S.text_parts(spark, sf_dir)
    return rows.select(F.col("key").alias("id"), L.normalise_dialect(F.expr(_DIALECT_TEXT)).alias("normalized"))


@query(_P + "SELECT key AS id, user || ' said: opened the link. THEN fraud; money was deducted ' || rupees || ' rupees' AS translated, CASE WHEN key % 2 = 0 THEN 'Shared the UPI PIN' ELSE 'not a phrase' END AS cached, CASE WHEN key % 2 = 0 THEN 0.99 ELSE 0.5 END AS cached_confidence FROM p")
def phrase_translate(spark, sf_dir):
    rows = S.text_parts(spark, sf_dir)
    text = F.expr("concat(user, ' said: LINK open kiya. THEN dhokha; Paise kat gaye ', rupees, ' rupiya')")
    cached = L.translate_cached(F.expr("if(key % 2 = 0, ' UPI pin share kiya!', 'not a phrase')"))
    out = rows.select(F.col("key").alias("id"), L.translate_phrases(text).alias("translated"), cached.alias("c"))
    return out.select("id", "translated", F.col("c.text").alias("cached"), F.col("c.confidence").alias("cached_confidence"))


@query(r"""SELECT doc_id, sha256(coalesce(list_aggregate(list_filter(list_transform(regexp_split_to_array(text, '\n'), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> ''), 'string_agg', chr(10)), '')) AS formatted FROM documents""")
def english_format(spark, sf_dir):
    return S.documents(spark, sf_dir).select("doc_id", F.sha2(L.format_english(F.col("text")), 256).alias("formatted"))


@query(
    _P
    + """SELECT key AS id, CASE variant WHEN 0 THEN 'repaired' WHEN 1 THEN 'repaired' WHEN 2 THEN 'repaired' ELSE 'passed' END AS guardrail_status,
CASE WHEN variant IN (0, 3) THEN 'cybercrime_complaint' WHEN variant = 2 THEN 'banking_fraud' ELSE 'cybercrime_complaint' END AS detected_domain, 1.0 AS entity_preservation_rate, 0.0 AS hallucination_rate FROM p"""
)
def reconstruct_text(spark, sf_dir):
    rows = reconstruct.reconstruct(_texts(spark, sf_dir).withColumn("ocr_confidence", F.lit(0.9)))
    return rows.select("id", "guardrail_status", "detected_domain", "entity_preservation_rate", "hallucination_rate")


# --- guardrails and quality ---


@query(
    _P
    + """SELECT key AS id, variant IN (0, 1) AS valid, CASE WHEN variant IN (0, 1) THEN '' WHEN variant = 2 THEN 'Modified validated phone: ' || phone_digits || ' -> 9000000001' ELSE 'Lost validated amount: ' || rupees END AS reason FROM p"""
)
def guardrail_validate(spark, sf_dir):
    rows = S.text_parts(spark, sf_dir)
    raw = F.expr("concat('Phone ', phone_digits, ' amount Rs ', rupees, ' in HDFC')")
    new = F.expr("CASE variant WHEN 0 THEN concat('HDFC ', rupees, ' Rs, call ', phone_digits) WHEN 1 THEN concat('Phone ', phone_digits, ' amount Rs ', rupees, ' in HDFC utr ', txn_digits) WHEN 2 THEN concat('Phone 9000000001 amount Rs ', rupees, ' in HDFC') ELSE concat('Phone ', phone_digits, ' in HDFC') END")
    both = X.extract_fields(X.extract_fields(rows.withColumns({"raw": raw, "new": new}), "raw", "raw_", V.STRICT_KEYS), "new", "new_", V.STRICT_KEYS)
    return both.select(F.col("key").alias("id"), Q.correction_verdict("raw_", "new_").alias("v")).select("id", "v.valid", "v.reason")


@query(
    _P
    + """SELECT key AS id, CASE WHEN variant = 0 THEN 'passed' ELSE 'failed' END AS status, 2 AS total_entities, CASE WHEN variant = 0 THEN 2 ELSE 1 END AS preserved_entities,
CASE WHEN variant = 0 THEN 1.0 ELSE 0.5 END AS preservation_rate, CASE WHEN variant = 0 THEN 'Rs ' || rupees || ', ' ELSE '' END || 'Phone ' || phone_digits || CASE WHEN variant = 0 THEN '' ELSE chr(10) || chr(10) || '--- Verified Ingestion Telemetry ---' || chr(10) || '- [Verified Financial Amount]: ' || rupees END AS restored FROM p"""
)
def entity_audit(spark, sf_dir):
    rows = S.text_parts(spark, sf_dir).withColumn("raw", F.expr("concat('Rs ', rupees, ', Phone ', phone_digits)"))
    rows = X.extract_fields(rows, "raw").withColumn("out", F.expr("if(variant = 0, raw, concat('Phone ', phone_digits))"))
    rows = rows.withColumn("a", Q.entity_audit(F.col("out"))).withColumn("restored", Q.restore_entities(F.col("out"), F.col("a")))
    return rows.select(F.col("key").alias("id"), "a.status", "a.total_entities", "a.preserved_entities", "a.preservation_rate", "restored")


@query(
    _P
    + """SELECT key AS id, CASE WHEN variant = 0 THEN 0.0 WHEN variant = 1 THEN 50.0 ELSE 25.0 END AS word_recovery_rate, CASE WHEN variant = 3 THEN 20.0 ELSE 0.0 END AS hallucination_rate,
CASE WHEN variant = 2 THEN 0.0 ELSE 100.0 END AS field_preservation_rate FROM p"""
)
def quality_metrics(spark, sf_dir):
    rows = S.text_parts(spark, sf_dir).withColumn("raw", F.expr("concat('Phone ', phone_digits, ' polce')"))
    rows = rows.withColumn("final", F.expr("CASE variant WHEN 0 THEN raw WHEN 1 THEN concat('police complaint. Phone ', phone_digits) WHEN 2 THEN 'police has no phone' ELSE concat('Rs 500 police ', phone_digits) END"))
    rows = X.extract_fields(X.extract_fields(rows, "raw", "raw_", V.MONITORED), "final", "final_", V.MONITORED)
    b = rows.select(F.col("key").alias("id"), Q.benchmarks(F.col("raw"), F.col("final"), "raw_", "final_").alias("b"))
    return b.select("id", "b.word_recovery_rate", "b.hallucination_rate", "b.field_preservation_rate")


@query(
    """WITH t AS (SELECT doc_id, greatest(1, length(replace(text, ' ', '')))::DOUBLE AS n, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin,
  length(regexp_replace(text, '[^A-Za-z0-9ऀ-ॿ]', '', 'g')) AS solid, (doc_id % 10) / 10.0::DOUBLE AS c FROM documents)
SELECT doc_id, round_even(c * 0.2::DOUBLE, 4) AS recovery, round_even(latin / n, 4) AS latin_ratio, round_even(c * 0.8::DOUBLE + solid / n * 0.2::DOUBLE, 6) AS line_score,
  concat_ws(',', CASE WHEN c * 0.2::DOUBLE < 0.15 THEN 'devanagari_recovery_too_low_for_translation' END, CASE WHEN doc_id % 2 = 0 THEN 'expected_devanagari_but_ocr_produced_latin_garbage' END, CASE WHEN c < 0.6 THEN 'low_ocr_confidence' END, CASE WHEN doc_id % 3 = 0 THEN 'unstable_script_detection' END) AS reasons FROM t"""
)
def review_gate(spark, sf_dir):
    docs = S.documents(spark, sf_dir).withColumn("c", (F.col("doc_id") % 10) / F.lit(10.0))
    rows = docs.withColumn("r", Q.devanagari_recovery(F.col("text"), F.col("c")))
    gate = Q.review_gate(F.col("r"), F.when(F.col("doc_id") % 2 == 0, "devanagari").otherwise("mixed"), F.when(F.col("doc_id") % 3 == 0, 0.2).otherwise(0.9), F.col("c"))
    return rows.select("doc_id", F.col("r.devanagari_recovery_score").alias("recovery"), "r.latin_ratio", half_even(Q.line_score(F.col("text"), F.col("c")), 6).alias("line_score"), F.array_join(gate["review_reasons"], ",").alias("reasons"))


# --- evaluation and pages ---


@query(
    _with(S.OCR_LOGS_SQL)
    + """, top AS (SELECT *, (has_phone::INT + has_amount::INT + has_bank::INT) / 7.0::DOUBLE AS coverage FROM ocr_logs ORDER BY created_at DESC, id LIMIT 100)
SELECT (SELECT count(*) FROM ocr_logs) AS total_samples, (SELECT count(*) FROM ocr_logs WHERE was_rejected) AS rejected_corrections, round_even(avg(coverage), 4) AS extraction_accuracy,
count(*) FILTER (NOT has_phone) AS missing_phone, count(*) AS missing_account_number, count(*) FILTER (NOT has_bank) AS missing_bank, count(*) FILTER (NOT has_amount) AS missing_amount,
count(*) AS missing_transaction_id, count(*) AS missing_upi_id, count(*) AS missing_ifsc,
(SELECT round_even(avg(((conv_id + turn) % 11) / 10.0::DOUBLE), 4) FROM conversations) AS confidence,
(SELECT round_even(count(*) FILTER (NOT was_rejected) / count(*)::DOUBLE, 4) FROM ocr_logs) AS correction_acceptance_rate FROM top"""
)
def ocr_eval_report(spark, sf_dir):
    return E.evaluation_report(S.ocr_logs(spark, sf_dir), S.pages(spark, sf_dir))


@query(
    """SELECT count(*) AS total_requests, count(*) FILTER (value > 90) AS lightweight_runs, count(*) FILTER (event_type = 'error') AS timeout_runs, count(*) FILTER (event_id % 2 = 0) AS fallback_runs,
count(*) FILTER (event_id % 5 = 0) AS rejected_runs, round_even(avg(value), 2) AS avg_ocr_runtime_ms, 0.0 AS avg_correction_runtime_ms, 0.0 AS avg_extraction_runtime_ms, round_even(avg(value), 2) AS avg_total_pipeline_runtime_ms,
arg_max(event_id, {'a': ts, 'b': event_id}) AS last_run_id, arg_max(CASE WHEN event_id % 5 = 0 THEN 'rejected_by_guardrails' ELSE 'accepted' END, {'a': ts, 'b': event_id}) AS last_correction_status FROM events"""
)
def runtime_metrics(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    status = F.when(F.col("event_id") % 5 == 0, "rejected_by_guardrails").otherwise("accepted")
    runs = events.select(F.col("event_id").alias("run_id"), "ts", (F.col("value") > 90).alias("lightweight_mode"), (F.col("event_type") == "error").alias("timeout_detected"), (F.col("event_id") % 2 == 0).alias("fallback_used"), status.alias("correction_status"), F.col("value").alias("ocr_runtime_ms"), F.lit(None).cast("double").alias("correction_runtime_ms"), F.lit(0.0).alias("extraction_runtime_ms"), F.col("value").alias("total_pipeline_runtime_ms"))
    return E.runtime_metrics(runs)


@query(
    """WITH pages AS (SELECT CAST(conv_id AS VARCHAR) AS document, turn, text, ((conv_id + turn) % 11) / 10.0::DOUBLE AS c, turn * 10.0::DOUBLE AS ms, CASE WHEN role = 'user' THEN 'tesseract' ELSE 'paddle' END AS engine FROM conversations),
u AS (SELECT document, engine, count(*) AS n, min(turn) AS f FROM pages GROUP BY 1, 2), b AS (SELECT document, arg_max(engine, {'n': n, 'f': -f, 'e': engine}) AS active FROM u GROUP BY 1)
SELECT document, sha256(string_agg(text, chr(10) ORDER BY turn, text) FILTER (text <> '')) AS text_sha, round_even(avg(c), 4) AS ocr_confidence, count(*) AS pages, round(sum(ms), 3) AS processing_time_ms, any_value(active) AS active_ocr_engine
FROM pages JOIN b USING (document) GROUP BY 1"""
)
def page_aggregate(spark, sf_dir):
    rows = E.document_pages(S.pages(spark, sf_dir))
    return rows.select("document", F.sha2("text", 256).alias("text_sha"), "ocr_confidence", "pages", F.round("processing_time_ms", 3).alias("processing_time_ms"), "active_ocr_engine")


@query("SELECT CAST(o_custkey AS BIGINT) AS sample, arg_max(o_orderpriority, {'s': o_totalprice, 't': o_orderkey}) AS profile, max(o_totalprice) AS score FROM orders GROUP BY 1")
def best_profiles(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return E.best_profiles(orders.select(F.col("o_custkey").alias("sample"), F.col("o_orderpriority").alias("profile"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("tried")))


@query()
def reading_order(spark, sf_dir):
    """Blocks of pages made from order lines; the running row mean is not for SQL."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    y, x = F.pmod(F.col("l_partkey"), F.lit(200)).cast("double"), F.pmod(F.col("l_suppkey") * 7, F.lit(500)).cast("double")
    blocks = lines.select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").cast("long").alias("block_id"), x.alias("x0"), y.alias("y0"), (x + 50).alias("x1"), (y + 10 + F.col("l_linenumber")).alias("y1"))
    return E.reading_order(blocks)


@query(
    """SELECT event_id, CASE WHEN d > l * 1.3 AND d > 0.25 THEN 'devanagari' WHEN l > d * 1.3 AND l > 0.25 THEN CASE WHEN n > 0.6 AND l < 0.5 THEN 'mixed' ELSE 'latin' END
WHEN abs(d - l) < 0.15 AND greatest(d, l) > 0.3 THEN 'mixed' WHEN n > 0.5 AND greatest(d, l) < 0.3 THEN 'numeric_heavy' WHEN n > 0.6 AND greatest(0.3, l) < 0.5 THEN 'mixed' ELSE 'latin' END AS script FROM
(SELECT event_id, (event_id % 10) / 10.0::DOUBLE AS l, ((event_id // 10) % 10) / 10.0::DOUBLE AS d0, 0.0::DOUBLE AS n, ((event_id // 10) % 10) / 10.0::DOUBLE AS d FROM events)"""
)
def script_decision(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    score = lambda c: c.cast("double") / F.lit(10.0)
    decided = Y.script_decision(score(F.expr("(event_id div 10) % 10")), score(F.col("event_id") % 10), F.lit(0.0))
    return events.select("event_id", decided["script"].alias("script"))


@query(
    """SELECT event_id, 1 + event_id % 10 AS severity, CASE WHEN event_id % 4 = 0 THEN 'Unknown' ELSE event_type END AS crime_type, event_id % 4 IN (1, 2) AS suspicious_ip,
CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE least(1.0, value / 100) END AS taxonomy_confidence, CASE WHEN event_id % 3 = 0 THEN NULL ELSE least(1.0, value / 100) END AS ocr_confidence,
CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS n_upi, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE NULL END AS first_upi FROM events"""
)
def coerce_fields(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    number = F.when(F.col("event_id") % 3 == 0, F.lit("n/a")).otherwise((F.col("value") / 100).cast("string"))
    flags = F.element_at(F.array(*map(F.lit, ("no", " YES ", "1", "maybe"))), F.pmod("event_id", F.lit(4)).cast("int") + 1)
    rows = events.select(
        "event_id",
        F.format_string(" %d.7 ", 1 + F.col("event_id") % 10).alias("severity"),
        F.when(F.col("event_id") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("event_type"))).alias("crime_type"),
        flags.alias("suspicious_ip"),
        number.alias("taxonomy_confidence"),
        number.alias("ocr_confidence"),
        F.when(F.col("event_id") % 2 == 0, F.format_string('["%d"]', "user_id")).otherwise(F.lit("not json")).alias("upi_ids"),
    )
    out = coerce(rows)
    return out.select("event_id", F.col("severity").cast("long").alias("severity"), "crime_type", "suspicious_ip", "taxonomy_confidence", "ocr_confidence", F.size("upi_ids").alias("n_upi"), F.get("upi_ids", F.lit(0)).alias("first_upi"))


# --- thresholds, gates and small transforms ---


def _events(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query("SELECT event_id, CASE WHEN value / 100 < 0.70 THEN 'LOW' WHEN value / 100 >= 0.85 THEN 'HIGH' ELSE 'BALANCED' END AS band FROM events")
def confidence_bands(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", K.confidence_band(F.col("value") / 100).alias("band"))


@query("SELECT event_id, CASE WHEN value * 20 < 50 THEN 'denoise-heavy' WHEN event_id % 100 < 35 THEN 'contrast-heavy' WHEN event_id % 100 > 70 AND value * 20 > 1000 THEN 'otsu' ELSE 'adaptive' END AS profile FROM events")
def recommended_profiles(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", Y.recommended_profile(F.col("value") * 20, F.col("event_id") % 100).alias("profile"))


@query(
    """SELECT event_id, (event_id % 5) * 1048576 >= 3 * 1048576 OR value * 300 >= 15000 OR user_id % 100 >= 85 AS enabled,
concat_ws('; ', CASE WHEN event_id % 5 >= 3 THEN 'large_file=' || (event_id % 5) || '.00MB' END, CASE WHEN value * 300 >= 15000 THEN 'slow_ocr' END, CASE WHEN user_id % 100 >= 85 THEN 'high_memory_pressure=' || (user_id % 100) || '.0%' END) AS reason FROM events"""
)
def lightweight_mode(spark, sf_dir):
    mode = Q.lightweight_mode((F.col("event_id") % 5) * 1048576, F.col("value") * 300, (F.col("user_id") % 100).cast("double"), F.lit(8.0))
    rows = _events(spark, sf_dir).select("event_id", mode.alias("m"))
    return rows.select("event_id", "m.enabled", F.regexp_replace("m.reason", r"slow_ocr=\d+ms", "slow_ocr").alias("reason"))


@query(
    """SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'paragraph' WHEN value / 100 > 0.7 AND (user_id % 10 = 1 OR user_id % 10 = 0 AND event_id % 4 <> 1) AND event_id % 17 < 15 THEN 'signature'
WHEN user_id % 10 >= 4 AND event_id % 4 = 1 THEN 'stamp' WHEN value / 100 < 0.15 AND event_id % 3 = 0 THEN 'header' ELSE 'paragraph' END AS type FROM events"""
)
def region_types(spark, sf_dir):
    """Density a tenth of the user's last digit; regions are square in one of four rows, else three times as wide as high."""
    aspect = F.when(F.col("event_id") % 4 == 1, 1.0).otherwise(3.0)
    wide = F.when(F.col("user_id") % 10 == 1, 3.0).otherwise(aspect)
    found = Y.region_type(F.col("value") / 100, (F.col("user_id") % 10) / F.lit(10.0), wide, F.col("event_id") % 17, F.lit(200), F.when(F.col("event_id") % 3 == 0, 0.05).otherwise(0.5))
    return _events(spark, sf_dir).select("event_id", found["type"].alias("type"))


@query(
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'Hacking' WHEN 'click' THEN 'Phishing' ELSE 'Unknown' END AS crime_type,
CASE WHEN event_id % 3 = 0 THEN 4 ELSE CAST(greatest(1, least(10, event_id % 13)) AS INT) END AS severity, CASE WHEN event_id % 2 = 0 THEN 'No summary generated' ELSE 'seen ' || user_id END AS summary FROM events"""
)
def model_answers(spark, sf_dir):
    """Answers as a model gives them: fenced, wrapped in prose, with words in the place of numbers."""
    kind = F.when(F.col("event_type") == "error", "hacking").when(F.col("event_type") == "click", " PHISHING ").otherwise("alien")
    severity = F.when(F.col("event_id") % 3 == 0, F.lit("high")).otherwise(F.concat((F.col("event_id") % 13).cast("string"), F.lit(".9")))
    summary = F.when(F.col("event_id") % 2 == 0, F.lit("N/A")).otherwise(F.concat(F.lit("seen "), F.col("user_id").cast("string")))
    body = F.to_json(F.struct(kind.alias("crime_type"), severity.alias("severity"), summary.alias("summary")))
    answer = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("event_id") % 5 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" Done."))).otherwise(body)
    rows = _events(spark, sf_dir).select("event_id", K.normalise_model(K.parse_model_json(answer)).alias("n"))
    return rows.select("event_id", "n.crime_type", "n.severity", "n.summary")


@query(
    """WITH t AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents)
SELECT doc_id, round_even((contains(t, 'the')::INT + contains(t, 'de la')::INT + contains(t, 'und')::INT) / 3.0::DOUBLE, 4) AS rate FROM t""".replace("\\\\", "\\")
)
def token_recovery(spark, sf_dir):
    expected = F.array(F.lit("THE"), F.lit("de  la"), F.lit("und "))
    return S.documents(spark, sf_dir).select("doc_id", Q.token_recovery(F.col("text"), expected)["rate"].alias("rate"))


@query(
    """SELECT key AS id, concat_ws(',', CASE WHEN key % 2 = 0 THEN 'language_misclassification' END, CASE WHEN key % 3 = 0 THEN 'dialect_misclassification' END,
CASE WHEN key % 5 = 0 THEN 'routing_misclassification' END, CASE WHEN key % 7 = 0 THEN 'entity_loss:' || phone_digits END, CASE WHEN key % 11 = 0 THEN 'hallucination_threshold_exceeded' END, CASE WHEN key % 13 = 0 THEN 'rejected:Lost validated phone: ' || phone_digits END) AS reasons FROM """
    + S.PARTS_SQL.replace("p AS ", "", 1)
)
def case_failures(spark, sf_dir):
    rows = S.text_parts(spark, sf_dir)
    off = lambda n, bad, good: F.when(F.col("key") % n == 0, bad).otherwise(good)
    meta = {"language": off(2, "English", "Hinglish"), "dialect": off(3, "Standard English", "Romanized Marwari"), "route": off(5, "x", "y"), "text": off(7, F.lit(""), F.col("phone_digits")), "hallucination_rate": off(11, 20.0, 0.0), "was_rejected": F.col("key") % 13 == 0, "rejection_reason": F.concat(F.lit("Lost validated phone: "), "phone_digits")}
    expected = {"language": F.lit("Hinglish"), "dialect_contains": F.lit("Marwari"), "route": F.lit("y"), "must_preserve": F.array("phone_digits")}
    return rows.select(F.col("key").alias("id"), F.array_join(Q.case_failures(meta, expected), ",").alias("reasons"))


@query(
    """SELECT trace_id, string_agg(stage || '=' || CAST(CAST(ms AS DECIMAL(12, 2)) AS VARCHAR), ',' ORDER BY stage) AS stages
FROM (SELECT user_id AS trace_id, event_type AS stage, round_even(max(value), 2) AS ms FROM events GROUP BY 1, 2) GROUP BY 1"""
)
def stage_profile(spark, sf_dir):
    rows = _events(spark, sf_dir).groupBy(F.col("user_id").alias("trace_id"), F.col("event_type").alias("stage")).agg(F.max("value").alias("duration_ms"))
    entries = F.sort_array(F.map_entries("stage_timings"))
    shown = F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("decimal(12,2)").cast("string")))
    return E.stage_profile(rows).select("trace_id", F.array_join(shown, ",").alias("stages"))


@query(_with(S.AUDIT_SQL) + "SELECT id, event_type, request_received_at, details FROM audit WHERE complaint_id = 8 ORDER BY request_received_at DESC, id LIMIT 50")
def one_case_audit(spark, sf_dir):
    return A.case_audit(S.audit(spark, sf_dir), 8).select("id", "event_type", "request_received_at", "details")


@query(
    _P
    + """SELECT key AS id, round(CASE variant WHEN 1 THEN CASE WHEN private THEN (8 * 0.95::DOUBLE + 0.7::DOUBLE) / 9 ELSE (8 * 0.95::DOUBLE + 2 * 0.7::DOUBLE) / 10 END WHEN 3 THEN 0.9375::DOUBLE ELSE 0.95::DOUBLE END, 6) AS confidence FROM p"""
)
def populated_confidence(spark, sf_dir):
    rows = ingest.extract(_texts(spark, sf_dir))
    return rows.select("id", F.round(Q.populated_confidence(F.col("field_confidence"), F.lit(0.0)), 6).alias("confidence"))


@query(
    """SELECT l_orderkey, l_linenumber, concat_ws(' ', CAST(l_partkey // 2 AS VARCHAR), CAST(l_suppkey // 2 AS VARCHAR), CAST((l_partkey + 40) // 2 AS VARCHAR), CAST((l_suppkey + 20) // 2 AS VARCHAR)) AS corners,
CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 1 END AS blocks FROM lineitem"""
)
def recognised_blocks(spark, sf_dir):
    """Boxes given as corners, brought back to the page's scale; blank texts make no block."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    box = F.array(*(c.cast("double") for c in (F.col("l_partkey"), F.col("l_suppkey"), F.col("l_partkey") + 40, F.col("l_suppkey") + 20)))
    found = Y.parse_blocks(F.array(F.when(F.col("l_linenumber") % 3 == 0, " ").otherwise("word")), F.array(F.lit(0.5)), F.array(box), F.lit(2.0))
    first = Y.scaled_box(box, F.lit(2.0))
    corners = F.concat_ws(" ", *(first[i][j].cast("string") for i, j in ((0, 0), (0, 1), (2, 0), (2, 1))))
    return lines.select("l_orderkey", "l_linenumber", corners.alias("corners"), F.size(found).alias("blocks"))


@query(
    """SELECT event_id, value / 100 < 0.6 AS uncertain, value / 100 < 0.75 AS officer_review, event_id % 3 < 2 AND value / 100 < 0.15 AS blocked FROM events"""
)
def line_gates(spark, sf_dir):
    share = F.col("value") / 100
    script = F.when(F.col("event_id") % 3 == 0, "devanagari").when(F.col("event_id") % 3 == 1, "mixed").otherwise("latin")
    blocked = Q.translation_blocked(script, F.struct(share.alias("devanagari_recovery_score")))
    return _events(spark, sf_dir).select("event_id", Q.line_gate(share).alias("g"), blocked.alias("blocked")).select("event_id", "g.uncertain", "g.officer_review", "blocked")


@query(
    "SELECT 'SELECT * FROM complaints WHERE crime_type = ''Financial Fraud'' AND bank ILIKE ''%SBI%'' AND CAST(amount AS FLOAT) >= 50000.0 AND created_at >= ''1996-02-09T00:00:00''' AS explained, 50 AS row_limit, false AS district_wise"
)
def nl_explain(spark, sf_dir):
    plan = nlquery.parse(QUESTION, NOW)
    return spark.range(1).select(F.lit(plan.explain()).alias("explained"), F.lit(plan.limit).alias("row_limit"), F.lit(plan.district_wise).alias("district_wise"))


@query(_P + "SELECT key AS id, CASE variant WHEN 0 THEN '0.0,0.9,0.9' WHEN 1 THEN '0.9,0.0,0.9' WHEN 2 THEN '0.0,0.9,0.0' ELSE '0.0,0.9,0.0' END AS confidences FROM p")
def context_confidence(spark, sf_dir):
    """Confidences of URLs, amount and date of the contextual pass."""
    from casemill.operators.entities import context_confidence as found

    rows = extract_entities(_texts(spark, sf_dir)).select("id", found().alias("c"))
    return rows.select("id", F.concat_ws(",", *(F.col("c")[k].cast("string") for k in ("urls", "amount", "date"))).alias("confidences"))


@query("SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13), chr(10)), '[ \\t]+', ' ', 'g'), '\\n{2,}', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS cleaned FROM documents")
def clean_texts(spark, sf_dir):
    return S.documents(spark, sf_dir).select("doc_id", F.sha2(L.clean_ocr_text(F.col("text")), 256).alias("cleaned"))


@query(
    """WITH f AS (SELECT event_id, value / 100 AS a, (event_id % 100) / 100.0::DOUBLE AS b, (user_id % 10) / 10.0::DOUBLE AS c FROM events),
s AS (SELECT event_id, a * 0.35::DOUBLE + least(1, b * 2) * 0.15::DOUBLE + least(1, c * 1.5) * 0.1::DOUBLE + (1 - least(1, a * 2)) * 0.1::DOUBLE + least(1, b * 40 / 20) * 0.1::DOUBLE - least(1, c) * 0.05::DOUBLE + least(1, a * 0.5) * 0.1::DOUBLE + b * 0.05::DOUBLE AS d,
  least(1, c * 2) * 0.2::DOUBLE + a * 0.2::DOUBLE + (1 - a) * 0.2::DOUBLE + (1 - c) * 0.1::DOUBLE + least(1, b * 0.5) * 0.15::DOUBLE + least(1, a * 40 / 30) * 0.15::DOUBLE AS l FROM f)
SELECT event_id, round(greatest(0, least(1, d)), 6) AS devanagari, round(greatest(0, least(1, l)), 6) AS latin FROM s"""
)
def script_scores(spark, sf_dir):
    a, b, c = F.col("value") / 100, (F.col("event_id") % 100) / F.lit(100.0), (F.col("user_id") % 10) / F.lit(10.0)
    measures = {"headline": a, "valley_depth": b, "mid_density": c, "circularity": a, "height_std": b * 40, "tall_ratio": c, "aspect_mean": a, "grid_density": b, "complexity": b, "width_std": a * 40, "numeric_density": c}
    devanagari, latin, _ = Y.script_scores(measures)
    return _events(spark, sf_dir).select("event_id", F.round(devanagari, 6).alias("devanagari"), F.round(latin, 6).alias("latin"))


@query(
    """SELECT event_id, CASE event_id % 8 WHEN 5 THEN '' WHEN 6 THEN 'no json' ELSE 'user ' || user_id END AS text, CASE event_id % 8 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 3 THEN 0.25 ELSE 0.0 END AS confidence FROM events"""
)
def model_responses(spark, sf_dir):
    """Answers of services in eight shapes."""
    shapes = (
        '{"confidence": 0.5, "output": " user %d\\r\\n"}', '{"score": 7, "response": "", "text": "user %d"}', '{"confidence": "high", "predictions": [{"content": "user %d"}]}', '{"certainty": 0.25, "predictions": ["user %d"]}',
        '{"choices": [{"message": {"role": "x"}, "content": "user %d"}]}', '{"output": 7, "x": %d}', "no json", '"user %d"',
    )
    body = F.element_at(F.array(*(F.format_string(x, F.col("user_id")) if "%d" in x else F.lit(x) for x in shapes)), (F.col("event_id") % 8 + 1).cast("int"))
    return _events(spark, sf_dir).select("event_id", reconstruct.response_text(body).alias("r")).select("event_id", "r.text", "r.confidence")


@query(
    _P
    + """SELECT key AS id, CASE WHEN key % 3 = 0 THEN 'Mharo ' || user WHEN key % 3 = 1 THEN 'Mera ' || user ELSE 'model' END AS text, CASE WHEN key % 3 = 0 THEN 1.0 WHEN key % 3 = 1 THEN 0.65 ELSE 0.9 END AS confidence FROM p"""
)
def dialect_with_model(spark, sf_dir):
    """English passes, and a model that answers some of the rest."""
    rows = S.text_parts(spark, sf_dir)
    dialect = F.when(F.col("key") % 3 == 0, "Standard English").otherwise("Romanized Marwari")
    answer = lambda prompt: F.when((F.col("key") % 3 == 2) & prompt.contains("Mera"), " model ")
    found = reconstruct.normalise_with_model(F.concat(F.lit("Mharo "), "user"), dialect, answer)
    return rows.select(F.col("key").alias("id"), found.alias("f")).select("id", "f.text", "f.confidence")


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN sha256(text) ELSE sha256('from text') END AS text_sha, CASE turn % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 0.25 END AS confidence, 0 AS n_lines FROM conversations"""
)
def normal_pages(spark, sf_dir):
    """Page results as engines leave them: either name of the text and the confidence, no lists."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    odd = F.col("turn") % 3
    rows = turns.select(
        "conv_id", "turn", F.col("conv_id").alias("document"), F.col("turn").alias("page"), F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("").alias("raw_text"), F.lit("from text").alias("text"),
        F.when(odd == 1, "0.5").when(odd == 0, "bad").alias("confidence"), F.when(odd == 2, "0.25").alias("ocr_confidence"),
    )
    out = Y.normal_pages(rows)
    return out.select(F.col("document").cast("long").alias("conv_id"), F.col("page").cast("long").alias("turn"), F.sha2("raw_text", 256).alias("text_sha"), "confidence", F.size("line_results").alias("n_lines"))


@query(_P + """SELECT key AS id, '{"model":"m","prompt":"' || user || '","stream":false,"options":{"temperature":0.0,"num_predict":1024}}' AS request FROM p""")
def model_requests(spark, sf_dir):
    return S.text_parts(spark, sf_dir).select(F.col("key").alias("id"), reconstruct.model_request("m", F.col("user")).alias("request"))
