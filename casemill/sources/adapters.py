"""Complaints, audit rows, texts and pages made from the driver's tables, in Spark and as SQL for DuckDB.

The two forms are written from the same description: the SQL derives what an extraction has to find
from the columns that a text was made of, not from the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions.vocab import QUERY_DISTRICTS
from casemill.sources.tables import spread

BANKS = (None, "", "State Bank Of India", "HDFC", "Canara Bank", "SBI", "ICICI", "Axis Bank")
CRIMES = (("1-URGENT", "Financial Fraud"), ("2-HIGH", "Phishing"), ("3-MEDIUM", "Hacking"), ("4-NOT SPECIFIED", "Harassment"), ("5-LOW", "Identity Theft"))
DISTRICTS = (*QUERY_DISTRICTS[:23], None, "")


def _sql_text(value: str | None) -> str:
    return "NULL" if value is None else f"'{value}'"


def _pick(key: str, values) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {_sql_text(v)}" for i, v in enumerate(values)) + " END"


#: Columns of a complaint as expressions that Spark and DuckDB share.
_SHARED = {
    "id": "o_orderkey",
    "status": "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'resolved' ELSE 'pending' END",
    "severity": "CAST(1 + o_orderkey % 10 AS INT)",
    "crime_type": "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CRIMES) + " ELSE 'Other' END",
    "amount": "CASE o_orderkey % 20 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'abc' WHEN 3 THEN '12abc' ELSE CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS {text}) END",
    "bank": _pick("c_nationkey % 8", BANKS),
    "district": _pick("n_nationkey", DISTRICTS),
    "created_at": "o_orderdate",
    "domain": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('Site', CAST(c_custkey % 50 AS {text}), '.xyz') END",
    "upi_id": "CASE WHEN o_orderkey % 3 = 0 THEN concat('user', CAST(c_custkey % 100 AS {text}), '@ok') END",
    "transaction_id": "CASE WHEN o_orderkey % 4 = 0 THEN lpad(CAST(c_custkey AS {text}), 12, '7') END",
    "crypto_wallet": "CASE WHEN o_orderkey % 9 = 0 THEN concat('0x', lpad(CAST(c_custkey % 30 AS {text}), 40, 'a')) END",
    "ip_address": "CASE WHEN o_orderkey % 6 = 0 THEN concat('8.8.', CAST(c_custkey % 7 AS {text}), '.', CAST(o_orderkey % 50 AS {text})) END",
}
COMPLAINTS_SQL = "complaints AS (SELECT " + ", ".join(f"{v.format(text='VARCHAR')} AS {k}" for k, v in _SHARED.items()) + " FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


def complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as complaints. Amounts include null, empty and non-numeric text; banks and districts include null and empty."""
    orders, customer, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(*(F.expr(v.format(text="STRING")).alias(k) for k, v in _SHARED.items()))


AUDIT_SQL = "audit AS (SELECT event_id AS id, user_id AS complaint_id, upper(event_type) AS event_type, ts AS request_received_at, props AS details FROM events)"


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audit rows of the complaint with the user's number."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.col("user_id").alias("complaint_id"), F.upper("event_type").alias("event_type"), F.col("ts").alias("request_received_at"), F.col("props").alias("details"))


#: Parts of a complaint's text as shared expressions of an order.
_PARTS = {
    "key": "o_orderkey",
    "variant": "CAST(o_orderkey % 4 AS INT)",
    "phone_digits": "concat(CAST(6 + o_orderkey % 4 AS {text}), lpad(CAST(o_custkey AS {text}), 9, '0'))",
    "second_digits": "concat('9', lpad(CAST(o_orderkey AS {text}), 9, '1'))",
    "txn_digits": "lpad(CAST(o_orderkey AS {text}), 12, '7')",
    "account_digits": "lpad(CAST(o_orderkey AS {text}), 11, '1')",
    "rupees": "CAST(CAST(1000 + o_orderkey % 900000 AS BIGINT) AS {text})",
    "user": "concat('user.', CAST(o_custkey AS {text}))",
    "ifsc_code": "concat('HDFC0B', lpad(CAST(o_orderkey % 100000 AS {text}), 5, '0'))",
    "octet": "CAST(o_orderkey % 256 AS {text})",
    "private": "o_orderkey % 8 = 1",
    "day": "CAST(1 + o_orderkey % 28 AS {text})",
    "month": "CAST(1 + o_orderkey % 12 AS {text})",
    "hour": "CAST(1 + o_orderkey % 12 AS INT)",
    "minute": "lpad(CAST(o_orderkey % 60 AS {text}), 2, '0')",
    "wallet_tail": "lpad(CAST(o_orderkey AS {text}), 40, 'a')",
    "site": "CAST(o_custkey % 10 AS {text})",
    "place": "element_at({districts}, CAST(1 + o_orderkey % 20 AS INT))",
}
_PLACES = QUERY_DISTRICTS[:20]


def _parts(text: str, districts: str) -> dict[str, str]:
    return {k: v.format(text=text, districts=districts) for k, v in _PARTS.items()}


PARTS_SQL = "p AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _parts("VARCHAR", "[" + ", ".join(f"'{d}'" for d in _PLACES) + "]").items() if k != "place") + ", [" + ", ".join(f"'{d}'" for d in _PLACES) + "][CAST(1 + o_orderkey % 20 AS INT)] AS place FROM orders)"

#: The text of each variant, as a Spark expression over the parts. Each holds decoys: digit runs that are no phone, impossible times.
_TEXTS = (
    "concat('Mere UPI se paisa kat gaya. UPI ID ', user, '@okhdfcbank. Transaction id-', txn_digits, '. Amount ₹', rupees, '.50. District ', place, '. Bank HDFC Bank. Phone +91-', phone_digits, '. Ref 1234567890123. Time ', cast(hour as string), ':', minute, ' PM Date ', day, '/', month, '/2026. WhatsApp number: ', second_digits, '.')",
    "concat('Victim received phishing SMS link https://secure-login', site, '.xyz/kyc to update bank KYC. Mobile number ', phone_digits, '. District ', place, '. Bank Canara Bank. Date ', day, '-', month, '-26. Time 12:05 am. IP ', if(private, '10.0.0.', '8.8.4.'), octet, '. See www.help', site, '.com too')",
    "concat('Bank transfer fraud. IFSC: ', ifsc_code, '. Account number - ', account_digits, '. Transaction ID: ', txn_digits, '. Amount Rs ', rupees, '. Phone ', phone_digits, '. District ', place, '. Time 25:61. On ', day, ' Sept 2025 State Bank of India, later SBI. Decoy 5123456789. transfer account: 77', account_digits, ' utr ', txn_digits)",
    "concat('Crypto scam: asked to send ETH to wallet 0x', wallet_tail, '. Amount lost: ', rupees, '. Fraud call number: ', phone_digits, ' and later ', second_digits, ' by whatsapp. District ', place, '. Victim blackmail and private photo. Contact ', phone_digits)",
)


def text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the texts are made of, a row for each order."""
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"), "o_orderkey")
    places = "array(" + ", ".join(f"'{d}'" for d in _PLACES) + ")"
    return orders.select(*(F.expr(v).alias(k) for k, v in _parts("STRING", places).items()))


def complaint_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as complaint texts in four variants that embed known values: id, text, station_name."""
    text = F.expr("CASE variant " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_TEXTS)) + " END")
    return text_parts(spark, sf_dir).select(F.col("key").alias("id"), "variant", text.alias("text"), F.lit(None).cast("string").alias("station_name"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' ids and texts."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")


#: Recognition logs: conversations stand in for pages of a document, events for runs.
def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as pages of a document, with confidences and engines made from their numbers."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    line = "array<struct<line:int,text:string,confidence:double,engine:string,profile:string,retries:int,y_coords:array<int>,x_coords:array<int>,box:array<array<int>>,region_type:string>>"
    return turns.select(
        F.col("conv_id").cast("string").alias("document"),
        F.col("turn").cast("int").alias("page"),
        F.col("text").alias("raw_text"),
        (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(11)) / 10.0).alias("confidence"),
        (F.col("turn") * 10.0).alias("processing_time_ms"),
        F.when(F.col("role") == "user", "tesseract").otherwise("paddle").alias("source_engine"),
        F.create_map().cast("map<string,int>").alias("engine_usage"),
        F.array().cast(line).alias("line_results"),
        F.array().cast(line).alias("uncertain_regions"),
    )


OCR_LOGS_SQL = """ocr_logs AS (SELECT event_id AS id, ts AS created_at, event_id % 3 = 0 AS was_rejected,
  user_id % 2 = 0 AS has_phone, value > 50 AS has_amount, event_type = 'purchase' AS has_bank FROM events)"""


def ocr_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as correction logs, with entities as JSON made from their columns."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    entities = F.to_json(F.struct(F.when(F.col("user_id") % 2 == 0, F.lit("9876543210")).alias("phone"), F.when(F.col("value") > 50, F.lit("5000")).alias("amount"), F.when(F.col("event_type") == "purchase", F.lit("SBI")).alias("bank")))
    return events.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), (F.col("event_id") % 3 == 0).alias("was_rejected"), F.lit(None).cast("string").alias("rejection_reason"), entities.alias("corrected_entities_json"))
