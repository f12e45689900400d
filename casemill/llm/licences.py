"""Licence scans by canonical digest lookup, in DataFrame operations only.

A text is brought to a canonical form (case, punctuation, copyright lines and equivalent
spellings normalised) whose SHA-256 is looked up among the digests of known licence texts,
brought to the same form by the same expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm.common import compact, documents
from casemill.llm.licence_texts import KNOWN

#: Up to this many known texts are broadcast (a digest and a name each); more are joined by shuffling digests.
MOST_BROADCAST = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (pattern, replacement) in the order of use, on text whose A-Z are lower-cased. Copyright
#: lines (a sign, a year, a placeholder or `by` follows the word) go first; then runs of ASCII characters other than letters and digits become a space; then spellings.
STEPS = (
    (r"(?m)^[ \t#*/>-]*(copyright[ \t:,]*(\(c\)|©|[0-9]|[\[<{]|by )|\(c\)[ \t]*(copyright|[0-9]|[\[<{])|©|all rights reserved)[^\n]*$", " "),
    (r"[\x01-/:-`{-\x7F]+", " "),
    (r"licence", "license"),
    (r"non commercial", "noncommercial"),
    (r"sub license", "sublicense"),
    (r"version (?:\b)", "v"),
    (r"favour", "favor"),
)
#: A line is looked up only if it has one of these; every known text has one (checked when it is loaded).
CUE = "(?i)licen[cs]e|permi(t|ssion)|warrant|(distributed|released) under"


def canonical(text: Column) -> Column:
    """Canonical form; null gives the empty one."""
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    for pattern, replacement in STEPS:
        out = F.regexp_replace(out, pattern, replacement)
    return F.trim(out)


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, licence) of the known texts, one row per digest (the least name)."""
    import json
    import re

    if without := [name for name, text in known if not re.search(CUE, text)]:
        raise ValueError(f"known texts without a cue: {without}")
    # a literal that the JVM parses: no Python worker has a part in it
    listed = F.from_json(F.lit(json.dumps([{"licence": a, "text": b} for a, b in known])), "array<struct<licence:string,text:string>>")
    table = spark.range(1).select(F.inline(listed))
    return table.groupBy(F.sha2(canonical(F.col("text")), 256).alias("digest")).agg(F.min("licence").alias("licence"))


def scan(texts: DataFrame, known: DataFrame, known_rows: int, text_col: str = "text") -> DataFrame:
    """Adds digest and licence to every row: the licence whose entire text this is, else null.

    Null and empty texts have the digest of the empty form and no licence. Rows are neither
    multiplied nor dropped. Columns of `texts` with one of these names are replaced.
    """
    rest = [c for c in texts.columns if c not in ("digest", "licence")]
    marked = texts.select(*rest, F.sha2(canonical(F.col(text_col)), 256).alias("digest"))
    return marked.join(F.broadcast(known) if known_rows <= MOST_BROADCAST else known, "digest", "left")


def scan_documents(docs: DataFrame, known: DataFrame, known_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, digest, licence (of the whole text), n_notices, notices.

    Lines are looked up as entire texts too: n_notices counts those that are a known text, and
    notices has their licences, distinct, sorted, comma-joined (empty if none). A null text
    has no lines; repeated rows are rows of their own; texts and lines of any length are looked up whole; an empty table gives an
    empty result; other columns are not read, so their names may clash.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).cast("string").alias("_text"))
    whole = scan(texts, known, known_rows, "_text").select("_id", "_hash", "digest", "licence")
    cued = F.filter(F.split("_text", "\n"), lambda line: line.rlike(CUE))
    lines = texts.where(F.col("_text").rlike(CUE)).select("_id", "_hash", F.posexplode(cued).alias("_at", "_line"))
    hits = scan(lines, known, known_rows, "_line").where("licence is not null").select("_id", "_hash", "_at", "licence").distinct()
    notices = hits.groupBy("_id", "_hash").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("notices"))
    joined = whole.join(notices.withColumnsRenamed({"_id": "_id2", "_hash": "_hash2"}), F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2")), "left")
    return joined.select(F.col("_id").alias(id_col), "digest", "licence", F.coalesce("n", F.lit(0).cast("long")).alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def op10_licences(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return compact(scan_documents(docs, known_digests(spark), len(KNOWN)), docs.count())


def _sql_canonical(text: str) -> str:
    out = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    for pattern, replacement in STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    return f"trim({out})"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE = {
    "op10_licences": f"""
WITH k AS (SELECT min(licence) AS licence, sha256({_sql_canonical('text')}) AS digest FROM (VALUES {', '.join(f'({_quoted(a)}, {_quoted(b)})' for a, b in KNOWN)}) v(licence, text) GROUP BY 2),
w AS (SELECT doc_id, sha256({_sql_canonical('text')}) AS digest FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE regexp_matches(text, '{CUE}')),
h AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM (SELECT doc_id, sha256({_sql_canonical('line')}) AS digest FROM l) JOIN k USING (digest) GROUP BY 1)
SELECT w.doc_id, w.digest, k.licence, coalesce(h.n, 0) AS n_notices, coalesce(h.notices, '') AS notices
FROM w LEFT JOIN k USING (digest) LEFT JOIN h ON h.doc_id = w.doc_id
"""
}
QUERIES = {"op10_licences": op10_licences}
