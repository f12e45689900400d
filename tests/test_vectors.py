"""Vectors for single operators: recorded complaints, edge values, semantic traps."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from casemill.functions import exprs as E
from casemill.functions import vocab as V
from casemill.functions.schemas import COMPLAINTS, conform
from casemill.operators import classify as K
from casemill.operators import coerce as C
from casemill.operators import entities as N
from casemill.operators import evaluate as A
from casemill.operators import extract as X
from casemill.operators import language as L
from casemill.operators import layout as Y
from casemill.operators import quality as Q
from casemill.operators.similarity import similar_cases
from casemill.plans import ingest, nlquery, reconstruct

COMPLAINTS_TEXT = {
    1: "Mere UPI se paisa kat gaya. UPI ID ravi@okhdfcbank. Transaction id-987654321098. Amount ₹5000. District Jaipur. Bank HDFC Bank. Phone 9876543210. Time 4:30 PM Date 05/05/2026.",
    2: "Victim received phishing SMS link https://secure-login.xyz/kyc to update bank KYC. Mobile 9123456789. District Jaipur. Bank Canara Bank. IP 8.8.8.8.",
    3: "Bank transfer fraud. IFSC: HDFC0B00123. Account number - 12345678901. Transaction ID: 123456789012. Amount Rs 25000. Phone 9988776655. District Kota.",
    4: "Crypto scam: asked to send ETH to wallet 0x0123456789abcdef0123456789abcdef01234567. Amount ₹80000. District Jodhpur. Phone 9876501234.",
    5: "Victim being blackmailed on WhatsApp by unknown person threatening to leak photos. Phone 9001122334. District Jaipur. No payment made yet.",
}


@pytest.fixture(scope="module")
def cases(spark):
    df = spark.createDataFrame([(i, t) for i, t in COMPLAINTS_TEXT.items()], "id bigint, text string").withColumn("station_name", F.lit(None).cast("string"))
    return {r.id: r for r in ingest.complaint_rows(df, F.lit(dt.datetime(2026, 5, 5))).collect()}


def values(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in sorted(df.select("i", f(F.col("x")).alias("y")).collect(), key=lambda r: r.i)]


def test_recorded_complaints(cases):
    expected = {
        1: dict(phone="9876543210", district="Jaipur", location="Jaipur", amount="5000", transaction_id="987654321098", bank="Hdfc Bank", upi_id="ravi@okhdfcbank", date="2026-05-05", time="16:30", confidence_score=0.44, crime_type="UPI Fraud", severity=8, taxonomy_confidence=0.8),
        2: dict(phone="9123456789", district="Jaipur", amount=None, bank="Canara Bank", url="https://secure-login.xyz/kyc", domain="secure-login.xyz", ip_address="8.8.8.8", suspicious_domain=True, suspicious_ip=True, confidence_score=0.56, crime_type="Phishing", severity=6),
        3: dict(phone="9988776655", district="Kota", amount="25000", transaction_id="123456789012", account_number="12345678901", bank="HDFC", ifsc="HDFC0B00123", confidence_score=0.5, crime_type="Financial Fraud", severity=7, crime_type_rule="Unknown"),
        4: dict(phone="9876501234", district="Jodhpur", amount="80000", bank=None, crypto_wallet="0x0123456789abcdef0123456789abcdef01234567", confidence_score=0.31, crime_type="Unknown", severity=5),
        5: dict(phone="9001122334", district="Jaipur", amount=None, bank=None, confidence_score=0.19, crime_type="Harassment", severity=5, crime_type_rule="Sextortion", taxonomy_confidence=0.6),
    }
    for i, fields in expected.items():
        assert {k: cases[i][k] for k in fields} == fields
    assert cases[1].fingerprint.startswith("3282adcb4bd9564d") and cases[2].fingerprint.startswith("96cecc12cf91463b")
    assert cases[1].station_name == "Jaipur Cyber Cell" and cases[1].status == "open" and cases[1].suspicious_ip is False


def test_fingerprint_vectors(spark):
    rows = [
        ("Financial Fraud|25000|Hdfc||123456789012|12345678901||||Kota", "ba7bba0705165e61"),
        ("Financial Fraud|80000||||||0x0123456789abcdef0123456789abcdef01234567||Jodhpur", "937389f92329a253"),
        ("Social Media Crime|||||||||Jaipur", "cccc5032d8ed022b"),
    ]
    for joined, prefix in rows:
        fields = [x or None for x in joined.split("|")]
        df = spark.createDataFrame([tuple(fields)], ", ".join(f"{k} string" for k in V.FINGERPRINT_KEYS))
        assert df.select(K.fingerprint().alias("f")).first().f.startswith(prefix)


def test_sqlite_float(spark):
    pairs = [("12abc", 12.0), ("abc", 0.0), ("", 0.0), ("1e3", 1000.0), (" 7", 7.0), ("-3.5x", -3.5), (".5", 0.5), ("5.", 5.0), ("1e", 1.0), ("+4", 4.0), ("0x10", 0.0), ("1,200", 1.0), (None, None)]
    assert values(spark, E.sqlite_float, [a for a, _ in pairs]) == [b for _, b in pairs]


def test_half_even(spark):
    assert values(spark, lambda c: E.half_even(c / F.lit(16.0), 2), [2, 10], "int") == [0.12, 0.62]


@pytest.mark.parametrize(
    ("field", "pairs"),
    [
        ("phone", [("+91-9876543210", "9876543210"), ("call 129876543210", None), ("x9876543210", "9876543210"), ("5123456789", None), (None, None), ("", None)]),
        ("time", [("12:05 am", "00:05"), ("12:05 pm", "12:05"), ("13:00 pm", "13:00"), ("25:61", None), ("at 9:07", "09:07")]),
        ("date", [("5/6/26", "2026-06-05"), ("99/99/2026", "2026-99-99"), ("3 Sept 2025", "2025-09-03"), ("3 dec 25", "2025-12-03"), ("none", None)]),
        ("bank", [("State Bank of India", "State Bank Of India"), ("sbi or pnb", "SBI"), ("pnb only", "PNB"), ("kotak mahindra bank", "Kotak Mahindra Bank")]),
        ("amount", [("Rs 1,234.50", "1234.50"), ("1,000 rupees", "1000"), ("₹ 7", "7"), ("7", None)]),
        ("url", [("see www.a.b/c?d now", "https://www.a.b/c?d"), ("HTTP://X.y", "HTTP://X.y")]),
        ("crypto_wallet", [("1" + "a" * 26 + " 0x" + "f" * 40, "0x" + "f" * 40), ("bc1" + "q" * 30, "bc1" + "q" * 30), ("1" + "a" * 26, "1" + "a" * 26)]),
        ("upi_id", [("pay a.b@ok now", "a.b@ok"), ("x.54@mail5.example.com", None)]),
        ("ifsc", [("HDFC0B00123", "HDFC0B00123"), ("HDFC1B00123", None)]),
        ("ip_address", [("1.2.3.4", "1.2.3.4"), ("256.1.1.1", None)]),
    ],
)
def test_fields(spark, field, pairs):
    assert values(spark, X.FIELDS[field], [a for a, _ in pairs]) == [b for _, b in pairs]


def test_suspicions(spark):
    import ipaddress
    import random

    assert values(spark, X.suspicious_domain, ["a.xyz", "mybank.com", "x" * 20 + "-y.com", "example.com", "", None]) == [True, True, True, False, False, False]
    random.seed(5)
    near = ["9.255.255.255", "10.0.0.0", "11.0.0.0", "100.64.0.1", "127.1.1.1", "169.254.0.1", "172.15.0.1", "172.31.9.9", "172.32.0.1", "192.0.0.8", "192.0.0.9", "192.0.2.1", "198.17.1.1", "198.19.1.1", "223.1.1.1", "224.0.0.1", "255.255.255.255", "0.1.2.3", "203.0.113.9"]
    ips = near + [".".join(str(random.randrange(256)) for _ in range(4)) for _ in range(200)]
    shown = lambda a: not (a.is_private or a.is_loopback or a.is_multicast or a.is_reserved or a.is_link_local)
    assert values(spark, X.suspicious_ip, ips) == [shown(ipaddress.ip_address(x)) for x in ips]
    assert values(spark, X.suspicious_ip, ["01.2.3.4", "", None]) == [False, False, False]


def test_entities(spark):
    text = "WhatsApp number: 9000000001, caller number 9000000002. Ph 9000000003" + "." * 60 + "9000000004 then" + " " * 60 + "fraud 9000000005 and 9000000001. transfer account 12345678 account number 87654321 a/c 12345678. www.a.com www.a.com http://b.c u1@ok b2@ok u1@ok hdfc0abc123 amount lost: 1,500 Rs 9"
    df = spark.createDataFrame([(text,), (None,)], "text string")
    r, none = N.extract_entities(df).collect()
    assert [(p.number[-1], p.type) for p in r.phones] == [("2", "suspect_phone"), ("1", "whatsapp_contact"), ("3", "suspect_phone"), ("4", "phone"), ("5", "suspect_phone")]
    assert [(a.number, a.type) for a in r.accounts] == [("12345678", "transfer_account"), ("87654321", "account_number")] and r.ctx_account_number == "87654321"
    assert [u.url for u in r.urls] == ["https://www.a.com", "http://b.c"] and r.upi_ids == ["b2@ok", "u1@ok"] and r.ifsc_codes == ["HDFC0ABC123"]
    assert r.ctx_amount == "1500" and none.phones == [] and none.ctx_phone is None


def test_amount_loses_its_decimals_when_merged(spark):
    df = spark.createDataFrame([(1, "Paid Rs 1,234.50 by upi")], "id bigint, text string")
    assert ingest.extract(df).first().amount == "1234"


def test_classifiers(spark):
    df = spark.createDataFrame([("update kyc",), ("otp and upi",), ("",), (None,), ("APK",)], "text string")
    rows = [r.rule for r in K.with_taxonomy(df, F.col("text")).collect()]
    assert [(r.label, r.confidence, r.severity, r.keywords) for r in rows] == [("KYC Fraud", 0.8, 6, ["kyc", "update kyc"]), ("OTP Fraud", 0.6, 8, ["otp"]), ("Unknown", 0.0, 4, []), ("Unknown", 0.0, 4, []), ("APK Scam", 0.6, 6, ["apk"])]
    assert [x.crime_type for x in values(spark, K.heuristic, ["a link", "hacked", "aadhaar", "ransom", "nothing", None])] == ["Phishing", "Hacking", "Identity Theft", "Ransomware", "Unknown", "Unknown"]
    vectors = {
        "I received a link on WhatsApp and lost money in a UPI transaction fraud": "cybercrime_complaint",
        "My account passbook and cheque ATM debit card transfer has issue at branch": "banking_fraud",
        "Shriman sho prarthna patra police complaint station theft": "legal_complaint",
        "Mauryan architecture sanchi stupas ashoka emperor history notes": "educational_content",
        "hello world some random handwriting text notes": "educational_content",
        "": "notes_documentation",
    }
    assert values(spark, K.domain_of, list(vectors)) == list(vectors.values())


def test_model_answers(spark):
    answers = ['```json\n{"crime_type": "phishing", "severity": "12.7", "summary": " ok "}\n```', 'Sure: {"crime_type": "Aliens", "severity": "high", "summary": "n/a"} bye', "no json", None]
    found = values(spark, lambda c: K.normalise_model(K.parse_model_json(c)), answers)
    assert [(x.crime_type, x.severity, x.summary) for x in found] == [("Phishing", 10, "ok"), ("Unknown", 4, "No summary generated"), ("Unknown", 4, "No summary generated"), ("Unknown", 4, "No summary generated")]


def test_coercion(spark):
    assert values(spark, C.severity, ["3.9", " 11 ", "x", None, "-4"]) == [3, 10, 4, 4, 1]
    assert values(spark, C.flag, ["YES", " y ", "1", "on", None]) == [True, True, True, False, False]
    assert values(spark, lambda c: C.unit(c, None), ["1.5", "-1", "x", None, "0.25"]) == [1.0, 0.0, None, None, 0.25]
    assert values(spark, C.json_map, ['{"a": 0.5}', "x", None]) == [{"a": 0.5}, {}, {}]
    assert [len(x) for x in values(spark, lambda c: C.RULES["phones"](c), ['[{"number": "1", "type": "phone"}]', "{", None])] == [1, 0, 0]


def test_conform_adds_columns(spark):
    row = conform(spark.createDataFrame([(1, "x")], "id int, raw_text string"), COMPLAINTS).first()
    assert len(row) == len(COMPLAINTS) and row.severity == 4 and row.crime_type == "Unknown" and row.phone is None


def test_similarity(spark):
    ddl = "id bigint, crime_type string, bank string, domain string, transaction_id string, upi_id string, amount string, crypto_wallet string, ip_address string, district string"
    rows = [
        (1, "A", "SBI", "d", "T", "u@x", "100", "w", "1.1.1.1", "K"),
        (2, "A", " sbi ", "D", " T ", "U@X", "110", "W", "1.1.1.1", "K"),
        (3, "a", None, None, None, "", "111", None, None, "k"),
        (4, "A", None, "", "", None, "abc", None, None, None),
        (5, "A", "", "x", "t", None, "0", None, None, ""),
    ]
    df = spark.createDataFrame(rows, ddl)
    top = similar_cases(df, 1, 9).collect()
    assert [(r.case_id, r.similarity_score) for r in top] == [(2, 18), (4, 2), (5, 2), (3, 0)]
    assert [r.similarity_score for r in similar_cases(df, 5, 1).collect()] == [2] and similar_cases(df, 99).collect() == []


def test_questions():
    now = dt.datetime(2026, 1, 10)
    plan = nlquery.parse("Show phishing above ₹50,000 in Jaipur from hdfc in last 7 days", now, 500)
    assert (plan.crime_type, plan.district, plan.bank, plan.min_amount, plan.since, plan.limit, plan.fraud) == ("Phishing", "Jaipur", "HDFC", 50000.0, dt.datetime(2026, 1, 3), 200, False)
    assert plan.explain() == "SELECT * FROM complaints WHERE crime_type = 'Phishing' AND bank ILIKE '%HDFC%' AND district = 'Jaipur' AND CAST(amount AS FLOAT) >= 50000.0 AND created_at >= '2026-01-03T00:00:00'"
    assert nlquery.parse("financial fraud", now).crime_type == "Financial Fraud" and nlquery.parse("district wise", now, 0).limit == 50
    assert nlquery.parse("cases", now).explain() == "SELECT * FROM complaints"
    with pytest.raises(ValueError):
        nlquery.parse("  ", now)


def test_language_tree(spark):
    pairs = [
        ("mharo bank account se 50000 kat gayo, bank account number 123456789012, upi pin konya diyo. please help.", ("Hinglish", "Romanized Marwari", 0.98, "regional_normalize_translate")),
        ("Please investigate the fraud, amount was debited from the bank", ("English", "Standard English", 0.96, "english_structuring_only")),
        ("मेरे खाते से पैसे निकल गए", ("Hindi", "Standard Hindi", 0.92, "regional_normalize_translate")),
        ("मेरे bank खाते से fraud ने पैसे money निकाल लिए", ("Hindi", "Standard Hindi", 0.85, "regional_normalize_translate")),
        ("xyzzy plugh qwerty", ("Mixed", "Mixed Dialect", 0.65, "selective_regional_translation")),
        ("zz", ("unknown", "unknown", 0.30, "officer_review_required")),
        (" \n", ("unknown", "unknown", 0.0, "officer_review_required")),
        (None, ("unknown", "unknown", 0.0, "officer_review_required")),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(pairs)], "i int, text string")
    for r in L.detect_language(df).withColumn("route", L.route(F.col("language"), F.col("dialect"))).collect():
        language, dialect, confidence, route = pairs[r.i][1]
        assert (r.language, r.dialect, r.route) == (language, dialect, route) and r.language_confidence == pytest.approx(confidence)
    seen = L.detect_language(df.where("i = 6"), visual_script="devanagari", script_confidence=0.5).first()
    assert (seen.language, seen.language_confidence) == ("Hindi", 0.3)


def test_repeated_and_partial_words_score(spark):
    df = spark.createDataFrame([("mharo xx yy zz",), ("that",)], "text string")
    repeated, partial = L.detect_language(df).collect()
    assert repeated.dialect == "Romanized Marwari" and repeated.language_confidence == pytest.approx(0.80)  # counted twice
    assert (partial.language, partial.language_confidence) == ("Hinglish", 0.65)  # `tha` within `that`


def test_rewriting(spark):
    assert values(spark, L.normalise_dialect, ["Mharo  paisa\nkatgyo.", '"mharo"', "kat gayo", None, "Konya!"]) == ["Mera paisa kat gaya.", 'merao"', "kat gaya", "", "Nahi!"]
    assert values(spark, L.translate_phrases, ["Paise cut gaye!", "x PAISE kat gaya y"]) == ["Money was deducted", "x money was deducted y"]
    assert [tuple(x) for x in values(spark, L.translate_cached, ["link open kiya.", "so link open kiya x", "other", " "])] == [("Opened the phishing link", 0.99), ("Opened the phishing link", 0.95), ("other", 0.5), ("", 1.0)]
    assert values(spark, L.format_english, ["a  b \r\n\n\t c", "", " x"]) == ["a b\nc", "", "x"]
    assert values(spark, L.clean_ocr_text, ["a \t b\r\n\r\nc  "]) == ["a b\nc"]
    assert values(spark, lambda c: L.structure_score(c), ["abc", "कि", ""]) == [0.0, 1.0, 0.0]


def test_guards(spark):
    df = spark.createDataFrame([("Rs 1,000 on 05/05/2026, call 9876543210",)], "text string")
    r = reconstruct.reconstruct(df.withColumn("ocr_confidence", F.lit(0.5))).first()
    assert r.guardrail_status == "repaired" and r.entity_preservation_rate == 1.0 and V.FOOTER in r.reconstructed_text
    assert "low_ocr_confidence_officer_review_required" in r.language_warnings and r.was_rejected is False
    assert "- [Verified Date of Event]: 2026-05-05" in r.reconstructed_text and "- [Verified Financial Amount]: 1000" in r.reconstructed_text
    modes = {m: reconstruct.reconstruct(spark.createDataFrame([("mharo paisa kat gayo bhai",)], "text string").withColumn("ocr_confidence", F.lit(0.9)), mode=m).first() for m in reconstruct.MODES}
    assert [modes[m].reconstructed_text for m in reconstruct.MODES] == ["mera paisa kat gaya bhai".replace("kat gaya", "was deducted"), "mharo paisa kat gayo bhai", "mera paisa kat gaya bhai"]
    assert {m.status for m in modes.values()} == {"deterministic_language_fallback"}
    model = reconstruct.reconstruct(spark.createDataFrame([("mharo paisa kat gayo bhai",)], "text string").withColumn("ocr_confidence", F.lit(0.9)), rewriter=lambda p: F.when(p.contains("mharo"), F.lit(" My money went. "))).first()
    assert (model.reconstructed_text, model.status, model.fallback_used, model.reconstruction_confidence_score) == ("My money went.", "language_route_accepted", False, 0.85)
    with pytest.raises(ValueError):
        reconstruct.reconstruct(df, mode="other")


def test_corrections(spark):
    df = spark.createDataFrame([("call 9876543210 now",)], "text string").withColumn("ocr_confidence", F.lit(0.9))
    answers = {"call 9876543210 today": "accepted", "call 9876543211 now": "rejected_by_guardrails", "": "fallback_raw_empty_response", None: "error_fallback_raw"}
    for answer, status in answers.items():
        r = reconstruct.correction(df, lambda _, a=answer: F.lit(a).cast("string")).first()
        assert r.correction_status == status and r.corrected_text == (answer if status == "accepted" else "call 9876543210 now")
    long = "\n\n".join(["p" * 700] * 5)
    assert [len(x) for x in values(spark, reconstruct.chunks, [long])[0]] == [1402, 1402, 700] and values(spark, reconstruct.chunks, ["short"]) == [["short"]]


def test_metrics(spark):
    assert values(spark, lambda c: Q.token_recovery(c, F.array(F.lit("UPI  pin"), F.lit("x"))), ["my upi PIN"])[0].rate == 0.5
    assert values(spark, Q.gibberish_density, ["ab 12 - transaction", "", "qzzzzzzzzzz"]) == [0.25, 1.0, 1.0]
    assert values(spark, lambda c: Q.sequence_ratio(c, F.lit("abcd")), ["bcde", None]) == [0.75, 0.0]
    assert values(spark, lambda c: Q.line_score(c, F.lit(0.5)), ["ab ..", "", None]) == [0.5, 0.0, 0.0]
    assert values(spark, Q.mean_confidence, [[0.5, None, 1.0], []], "array<double>") == [0.75, 0.0]
    recovery = values(spark, lambda c: Q.devanagari_recovery(c, F.lit(1.0)), ["कखग abc", "", "…"])
    assert (recovery[0].devanagari_ratio, recovery[0].devanagari_token_ratio, recovery[0].hindi_token_readability) == (0.5, 0.5, 0.5) and recovery[1].devanagari_recovery_score == 0.0
    light = values(spark, lambda c: Q.lightweight_mode(c, F.lit(16000.0), F.lit(50.0), F.lit(8.0)), [4 * 1048576], "bigint")[0]
    assert (light.enabled, light.reason) == (True, "large_file=4.00MB; slow_ocr=16000ms")
    assert values(spark, lambda c: K.confidence_band(c), [0.6, 0.7, 0.85], "double") == ["LOW", "BALANCED", "HIGH"]


def test_pages_and_layout(spark):
    import numpy as np

    usage = values(spark, A.active_engine, [{"b": 2, "a": 2}, {}, None], "map<string,int>")
    assert usage[1:] == ["unknown", "unknown"] and usage[0] in ("a", "b")
    page = np.zeros((100, 60), dtype=np.uint8)
    page[20:40, 5:50] = page[60:66, 5:50] = page[70:95, 10:40] = 255
    assert Y.line_bands(page) == [(10, 50), (60, 100)] and Y.line_bands(page * 0) == [(0, 100)]
    assert Y.row_profile(page * 0)["mid_density"] == 0.0 and 0 < Y.row_profile(page)["valley_depth"] <= 1
    assert Y.grid_density(page * 0) == 0.0 and 0 < Y.grid_density(page) < 1 and Y.headline_score(page, 2, 10.0) == 0.0 and 0 < Y.headline_score(page, 9, 10.0) <= 1
    assert Y.column_profile(page)["column_std"] > 0
    decided = values(spark, lambda c: Y.script_decision(c, F.lit(0.2), F.lit(0.0)), [0.9, 0.2, 0.25], "double")
    assert [(x.script, x.confidence) for x in decided] == [("devanagari", 0.9), ("latin", 0.3), ("latin", 0.3)]
    boxes = values(spark, lambda c: Y.scaled_box(c, F.lit(2.0)), [[2.0, 4.0, 6.0, 8.0]], "array<double>")
    assert boxes == [[[1, 2], [3, 2], [3, 4], [1, 4]]]
    with pytest.raises(RuntimeError):
        Y.recognise_pages(spark.createDataFrame([("a", b"")], "path string, content binary"), None)
    engines = Y.Engines(lambda content, path: iter([np.zeros((2, 2))] * len(content)), lambda image: ("text", 0.5, []))
    pages = Y.recognise_pages(spark.createDataFrame([("a", b"xy")], "path string, content binary"), engines)
    whole = A.document_pages(pages).first()
    assert (whole.pages, whole.text, whole.ocr_confidence, whole.active_ocr_engine, whole.engine_usage) == (2, "text\ntext", 0.5, "engine", {"engine": 2})


def brute_reading_order(blocks):
    heights = [b[4] - b[2] for b in blocks]
    tolerance = max(12.0, sum(heights) / len(heights) * 0.65)
    rows = []
    for b in sorted(blocks, key=lambda b: ((b[2] + b[4]) / 2, b[0])):
        cy = (b[2] + b[4]) / 2
        if rows and abs(cy - sum((x[2] + x[4]) / 2 for x in rows[-1]) / len(rows[-1])) <= tolerance:
            rows[-1].append(b)
        else:
            rows.append([b])
    return [b[0] for row in rows for b in sorted(row, key=lambda b: ((b[1] + b[3]) / 2, b[0]))]


def test_reading_order(spark):
    import random

    random.seed(2)
    pages = {p: [(i, float(x), float(y), x + 30.0, y + 10.0 + i % 5) for i in range(40) for x, y in [(random.randrange(300), random.randrange(200))]] for p in range(5)}
    df = spark.createDataFrame([(p, *b) for p, bs in pages.items() for b in bs], "page_id bigint, block_id bigint, x0 double, y0 double, x1 double, y1 double")
    rows = A.reading_order(df).collect()
    for p, blocks in pages.items():
        assert [r.block_id for r in sorted((r for r in rows if r.page_id == p), key=lambda r: r.position)] == brute_reading_order(blocks)


def test_json_round_trip(cases):
    assert json.loads(json.dumps([p.asDict() for p in cases[1].phones])) == [{"number": "9876543210", "type": "phone"}]


def test_audit_takes_no_amount_for_preserved_within_a_longer_number(spark):
    outs = ["Phone 9000078834", "Phone 9000078834, 900007.", "Rs 900007.50", "9000078834 900007", "x900007", "Phone 7000190000"]
    raws = ["Rs 900007, Phone 9000078834"] * 5 + ["Rs 70001, Phone 7000190000"]
    rows = X.extract_fields(spark.createDataFrame(list(zip(raws, outs)), "raw string, out string"), "raw").withColumn("a", Q.entity_audit(F.col("out")))
    lost = {r.out: [e.value for e in r.a.missing_entities if e.field == "amount"] for r in rows.select("out", "a").collect()}
    assert [lost[o] for o in outs] == [["900007"], [], [], [], [], ["70001"]]
    raw = "Rs 500.125 paid from +919876543210"
    row = X.extract_fields(spark.createDataFrame([(raw,)], "raw string"), "raw").select(Q.entity_audit(F.col("raw")).alias("a")).first()
    assert row.a.status == "passed" and row.a.total_entities == 2
