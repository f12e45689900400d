"""Language identification by rank-order profiles (Cavnar and Trenkle 1994).

A language's profile is the ranking of its most frequent letter n-grams. A document's own
ranking is compared with each profile by the out-of-place distance: the sum over the
document's n-grams of how far their ranks differ, at most the profile's length each. The
least distance wins; the score is one minus its share of the largest possible distance.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casemill.llm.common import documents, small_batches, spread

#: n-grams of a profile and of a document's ranking; longest n-gram.
PROFILE, RANKING, LONGEST = 400, 300, 3
#: Profiles are learnt from about this many documents of each language, drawn by a hash of their ids.
SAMPLE = 1000
UNKNOWN = "und"
#: Stands for what isn't a letter; past the last code point, so that n-grams of different lengths have different keys.
EDGE = 0x110000
#: The sampling shares are broadcast up to this many languages, joined by shuffle beyond.
MOST_LANGUAGES = 10_000
#: In the pipeline, documents that score less are rejected: hardly an n-gram of theirs is in any profile.
LEAST_SCORE = 0.02

_letters: np.ndarray | None = None


def _table() -> np.ndarray:
    """For each code point its lower-case letter, or EDGE for all that isn't a letter. One for each worker."""
    global _letters
    if _letters is None:
        table = np.full(sys.maxunicode + 1, EDGE, dtype=np.int64)
        for i in range(sys.maxunicode + 1):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _letters = table
    return _letters


def letters_of(text: str | None) -> np.ndarray:
    """Lower-case letters, runs of anything else as one EDGE, with one at either end; empty if no letter."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = _table()[codes]
    if not (letters != EDGE).any():
        return letters[:0]
    letters = np.concatenate(([EDGE], letters, [EDGE]))
    keep = np.ones(len(letters), dtype=bool)
    keep[1:] = (letters[1:] != EDGE) | (letters[:-1] != EDGE)
    return letters[keep]


def ngram_counts(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of n-grams of 1 to LONGEST characters; an EDGE only begins or ends one."""
    grams = []
    for n in range(1, LONGEST + 1):
        parts = [letters[k : len(letters) - n + 1 + k] for k in range(n)]
        key = np.zeros(max(0, len(letters) - n + 1), dtype=np.int64)
        for part in parts:
            key = (key << 21) | part
        inner = parts if n == 1 else parts[1:-1]
        for part in inner:
            key = np.where(part == EDGE, -1, key)
        grams.append(key[key >= 0])
    keys = np.sort(np.concatenate(grams))
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def ranking(letters: np.ndarray, most: int = RANKING) -> np.ndarray:
    """Keys of the most frequent n-grams, most frequent first, ties by key."""
    keys, counts = ngram_counts(letters)
    return keys[np.lexsort((keys, -counts))[:most]]


class Profiles:
    """languages: their rankings of n-gram keys."""

    def __init__(self, rankings: dict[str, list[int]]):
        self.languages = sorted(rankings)
        self.sorted, self.ranks = [], []
        for name in self.languages:
            keys = np.array(rankings[name], dtype=np.int64)
            order = np.argsort(keys)
            self.sorted.append(keys[order])
            self.ranks.append(order)

    def predict(self, text: str | None) -> tuple[str, float]:
        letters = letters_of(text)
        if not len(letters) or not self.languages:
            return UNKNOWN, 0.0
        own = ranking(letters)
        places = np.arange(len(own))
        distances = []
        for keys, ranks in zip(self.sorted, self.ranks):
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            out = np.where(keys[at] == own, np.minimum(np.abs(ranks[at] - places), PROFILE), PROFILE)
            distances.append(int(out.sum()))
        best = int(np.argmin(distances))
        return self.languages[best], 1.0 - distances[best] / (PROFILE * len(own))


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> Profiles:
    """Profiles from about `sample` documents of each language (all of them where there are fewer).

    A language's share is drawn by comparing a hash of the id with a threshold from its row
    count, so nothing is sorted and no text reaches the driver. What is collected are the
    profiles: PROFILE n-grams for each language. Rows without a language or text teach nothing.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    share = rows.groupBy("lang").agg((F.lit(float(sample)) / F.count(F.lit(1))).alias("share"))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit("profile"), "id"), 11).cast("double") * F.lit(2.0**-53)
    few = share.count() <= MOST_LANGUAGES
    drawn = rows.join(F.broadcast(share) if few else share, "lang").where(unit < F.col("share")).select("lang", "text")

    def run(batches):
        for batch in batches:
            found: dict[str, dict[int, int]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                letters = letters_of(text)
                if len(letters):
                    counts = found.setdefault(lang, {})
                    for key, n in zip(*(x.tolist() for x in ngram_counts(letters))):
                        counts[key] = counts.get(key, 0) + n
            out = [(lang, key, n) for lang, counts in found.items() for key, n in counts.items()]
            langs, keys, ns = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.int64()), pa.array(ns, pa.int64())], names=["lang", "gram", "n"])

    counted = drawn.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= PROFILE)
    rankings: dict[str, list[int]] = {}
    for lang, gram, _ in sorted(((r["lang"], r["gram"], r["rank"]) for r in ranked.collect()), key=lambda r: (r[0], r[2])):
        rankings.setdefault(lang, []).append(gram)
    return Profiles(rankings)


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that may be learnt from: three quarters, by the checksum of the id."""
    return docs.where(~held_out(id_col))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, lang_pred, score (0 to 1).

    Null texts and texts without a letter are `und` with score 0, and so is everything if no
    profile was learnt. Equal distances go to the language that sorts first. Only the text is read.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = [profiles.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, profiles: Profiles, text_col: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows whose language is known with at least that score, with their columns."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            found = [profiles.predict(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = spread(documents(spark, sf_dir))
    found = identify(docs, learn(training_rows(docs), "doc_id", "text", "lang"))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language": op6_language}
ORACLE: dict[str, str] = {}
