"""Personal data by anchor expansion.

One Aho-Corasick pass finds at-signs, schemes, plus signs, dots between digits and identifier cues. From each hit
a deterministic parser walks outwards over a fixed class of characters and validates what it
has walked over. Card numbers have no anchor of their own: the contract's base wants every group of digits judged, so runs of
digits are walked from each one's first digit. No parser backtracks or walks over a place twice for the
same kind, so time is linear in the text.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import documents, small_batches, spread

#: Kinds in the order that breaks ties of a start; the last two are what the method adds.
KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
#: Identifier cues, lower case; a value follows after spaces, a separator or quotes.
CUES = ("token", "password", "passwd", "secret", "api_key", "api key", "apikey", "access_key", "account", "acct", "iban", "passport", "ssn", "konto", "cuenta", "compte")
#: What a cue's value is: of the forms below the longest that fits, with this many characters at least and one of them a digit. Shorter
#: words and words without a digit ("password: forgotten") are prose far more often than values.
VALUE_LENGTH = 6

DIGITS = frozenset("0123456789")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
AUTHORITY = re.compile(r"[^\x00-\x20\"<>\\^`{|}]++")
#: From a cue to its value: the rest of its word; then a closing quote, any separators and blanks, an opening quote.
WORD_REST = re.compile(r"[A-Za-z0-9_]*+")
LEAD = re.compile(r"[\"']?(?:[ \t]*+(?:[:=#]|(?:no|nr|num|number|is)(?![A-Za-z])\.?))*+[ \t]*+[\"']?", re.IGNORECASE)
VALUE = re.compile(r"[A-Za-z0-9][A-Za-z0-9_/+-]*+")
#: Values of SECRETS behind a colon, an equals sign or a quote may hold symbols.
SECRETS = frozenset(CUES[:8])
SECRET = re.compile(r"[^\x00-\x20\"'<>,;]++")
#: Values of the other cues may be written in groups: an IBAN, or groups of two to four digits.
GROUPED = re.compile(
    r"[A-Z]{2}[0-9]{2}(?:[ -](?:(?=[A-Z]{0,3}[0-9])[A-Z0-9]{1,4}|[A-Z]{4}(?=[ -][A-Z]{0,3}[0-9]))(?![A-Za-z0-9]))++"
    r"|[0-9]{2,4}(?:[ -][0-9]{2,4}(?![A-Za-z0-9]))++"
)


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


_automaton = None


def automaton():
    """One automaton for each Python worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for kind, words in (("at", ("@",)), ("scheme", ("://",)), ("plus", ("+",)), ("dot", tuple(f".{d}" for d in sorted(DIGITS))), ("cue", CUES)):
            for w in words:
                _automaton.add_word(w, (kind, len(w)))
        _automaton.make_automaton()
    return _automaton


def lowered(text: str) -> str:
    """Lower case that keeps every character's place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def value(text: str, secret: bool, word_end: int, start: int) -> tuple[int, int] | None:
    """Place of a cue's value: the longest of the forms that the cue allows (`secret`: it is one of SECRETS). The cue's word
    ends at `word_end`, the lead to its value at `start`."""
    ends = []
    if m := VALUE.match(text, start):
        ends.append(m.end())
    if secret:
        if any(c in ":=\"'" for c in text[word_end:start]) and (m := SECRET.match(text, start)):
            ends.append(start + len(m[0].rstrip(".:!?)]}")))
    elif m := GROUPED.match(text, start):
        ends.append(m.end())
    return (start, max(ends)) if ends else None


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind's rank, end) in order; kinds are KINDS, places are code points, ends exclusive.

    Within a kind, spans do not overlap and the leftmost goes first. A match that fails its
    validation is dropped and the search goes on after it.
    """
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    past_email = past_phone = past_url = past_value = past_ip = 0
    word_end, lead_end, values = -1, -1, {}  # of the last cue's word: cues of one word share its lead and values
    low = lowered(text)
    for last, (kind, length) in automaton().iter(low):
        at = last - length + 1
        if kind == "at":
            start = at
            while start > past_email and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                found.append((start, 0, past_email := m.end()))
        elif kind == "plus":
            if at >= past_phone and (m := PHONE.match(text, at)):
                past_phone = m.end()
                if 9 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15:
                    found.append((at, 3, m.end()))
        elif kind == "scheme":
            start = at
            while start > past_url and text[start - 1] in SCHEME:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            if start < at and (m := AUTHORITY.match(text, at + 3)):
                end = m.end()
                while end > at + 3 and text[end - 1] in ".,;:!?)'":
                    end -= 1
                if end > at + 3:
                    found.append((start, 4, past_url := end))
        elif kind == "dot":
            start = at
            while start > past_ip and text[start - 1] in DIGITS:
                start -= 1
            if start < at and (m := IP.match(text, start)):
                past_ip = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    found.append((start, 1, past_ip))
        elif at >= past_value and (at == 0 or not text[at - 1].isalnum()):
            if at + length > word_end:
                word_end = WORD_REST.match(text, at + length).end()
                lead_end, values = LEAD.match(text, word_end).end(), {}
            secret = low[at : at + length] in SECRETS
            if secret not in values:
                values[secret] = value(text, secret, word_end, lead_end)
            m = values[secret]
            if m and m[1] - m[0] >= VALUE_LENGTH and any(c.isdigit() for c in text[m[0] : m[1]]):
                found.append((m[0], 5, past_value := m[1]))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    return sorted(found)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col and spans, an array of (kind, start, end) in order.

    Null and empty texts have an empty array; long texts are read whole; repeated rows are repeated; an empty table gives
    an empty result; other columns are not read, so their names may clash.
    """
    small_batches(docs.sparkSession)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, span)], names=[id_col, "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:int,end:int>>")


def _shown(spans_col):
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _counted(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spread(documents(spark, sf_dir)))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *(_counted(k) for k in BASE), F.sha2(_shown(base), 256).alias("base_sha256"), _shown(F.col("spans")).alias("spans"))


QUERIES = {"op5_pii": op5_pii}
ORACLE: dict[str, str] = {}
