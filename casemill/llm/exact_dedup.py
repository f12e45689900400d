"""Exact duplicates by progressive refinement, in DataFrame operations only.

Level one groups by the length of the normalised text, level two by a hash of its
beginning, level three by the digest of all of it. A row goes on to the next level only
while another row shares its group. Texts are never shuffled: levels work on narrow rows, each
level's shared groups are stored and counted, and are broadcast if they are few.

`exact_dedup` has to report every row's digest, so it hashes all texts in its one scan. `keep_first`
reads the full content of survivors only: a second scan hashes the texts whose length and
beginning are shared, and a third leaves out the rows found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import BROADCAST_ROWS, SPACE_RUN, compact, documents, join_groups, keep, nested, small, stash

#: Code points of the normalised text that the second level hashes.
PREFIX = 64


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def _digest(norm: str) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _beginning(norm: str) -> tuple[Column, Column]:
    return F.length(norm).alias("length"), F.xxhash64(F.substring(norm, 1, PREFIX)).alias("prefix")


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = True) -> DataFrame:
    """(id, length, prefix hash and, if wanted, digest) of every row, without the text."""
    lean = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    return lean.select("id", *_beginning("norm"), *([_digest("norm").alias("digest")] if digest else []))


def _shared(level: DataFrame, *key: str) -> DataFrame:
    """Groups of two or more rows: the key and n, counted with map-side aggregation."""
    return level.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def beginnings(sigs: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Levels one and two: (rows whose length is shared, the (length, prefix, n) that two or more rows share)."""
    level_two = join_groups(sigs, _shared(sigs, "length"), ["length"], "n", rows, "left_semi", "id")
    return level_two, _shared(level_two, "length", "prefix")


def groups_of(survivors: DataFrame) -> DataFrame:
    """Level three: (digest, keep_id, group_size, again) of each digest that two or more rows share.

    keep_id is the least id, nulls last; `again` is how many rows have it.
    """
    by_id = survivors.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n"))
    found = by_id.groupBy("digest").agg(first.alias("first"), F.sum("n").alias("group_size")).where("group_size > 1")
    return found.select("digest", F.col("first.id").alias("keep_id"), "group_size", F.col("first.n").alias("again"))


def refine(sigs: DataFrame, rows: int) -> DataFrame:
    """(digest, keep_id, group_size, again) of each group of two or more equal rows."""
    level_two, shared = beginnings(sigs, rows)
    return groups_of(join_groups(level_two, shared, ["length", "prefix"], "n", rows, "left_semi", "id"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Null texts equal empty ones. Of equal texts the smallest id stays (null ids last); rows
    that repeat both text and id are one document, and one of them stays. An empty table
    gives an empty result; other columns are not read.
    """
    sigs = keep(signatures(docs, id_col, text_col))
    rows = sigs.count()
    groups = keep(refine(sigs, rows))
    repeated = not groups.where("again > 1").isEmpty()
    marked = join_groups(sigs, groups.withColumn("n", F.col("group_size")), ["digest"], "n", rows, "left", "id").select(
        "id",
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        "digest",
        F.coalesce("again", F.lit(1).cast("long")).alias("again"),
    )
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    nth = F.lit(1)
    if repeated:  # rows alike in text and id are made anew from their number, one of them kept
        alike = groups.where("again > 1").select(F.col("keep_id").alias("id"), "keep_id", "group_size", "digest", "again", F.explode(F.expr("sequence(1L, again)")).alias("nth"))
        marked, nth = marked.where(~kept | (F.col("again") == 1)).withColumn("nth", F.lit(1).cast("long")).unionByName(alike), F.col("nth")
    out = marked.select(F.col("id").alias(id_col), "keep_id", "group_size", (kept & (nth == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    return compact(out, rows)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `exact_dedup` keeps, with their columns.

    Null texts equal empty ones, of whatever length; null ids come last, and of rows that repeat text and id one stays.
    An empty table gives an empty result. No column name can clash with a helper's.
    """
    narrow = keep(signatures(docs, id_col, text_col, digest=False))
    rows = narrow.count()
    shared = stash(beginnings(narrow, rows)[1])
    suspects = shared.count()
    text = normalised(F.col(text_col))
    marked = nested(docs, id=F.col(id_col), norm=text).select("row", "id", "norm", *_beginning("norm"))
    if suspects <= BROADCAST_ROWS:
        marked = marked.join(F.broadcast(shared.select("length", "prefix", F.lit(True).alias("suspect"))), ["length", "prefix"], "left")
    else:  # too many to send to every task: hashing all costs less than shuffling texts to the groups
        marked = marked.withColumn("suspect", F.lit(True))
    digest = F.when(F.col("suspect"), _digest("norm"))  # evaluated for survivors only
    survivors = keep(marked.where("suspect").select("id", digest.alias("digest")))
    groups = keep(groups_of(survivors))
    pairs = survivors.select("digest", "id").distinct()
    first = groups.select(F.col("digest").alias("_digest"), "keep_id")
    dropped = pairs.join(first, (F.col("digest") == F.col("_digest")) & ~F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("digest").alias("_digest"), F.col("id").alias("_id"))
    dropped = stash(dropped)
    hashed = marked.select("row", "id", digest.alias("digest"))
    kept = hashed.join(small(dropped, dropped.count()), (F.col("digest") == F.col("_digest")) & F.col("id").eqNullSafe(F.col("_id")), "left_anti")
    if not groups.where("again > 1").isEmpty():
        twice = groups.where("again > 1").select(F.col("digest").alias("_digest"), F.col("keep_id").alias("_id"))
        here = (F.col("digest") == F.col("_digest")) & F.col("id").eqNullSafe(F.col("_id"))
        alike = kept.join(twice, here, "left_semi").groupBy("digest", "id").agg(F.first("row").alias("row"))
        kept = kept.join(twice, here, "left_anti").unionByName(alike.select("row", "id", "digest"))
    return kept.select("row.*")


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE = {
    "op7_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, sha256(t) AS text_sha256, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
}
QUERIES = {"op7_exact_dedup": op7_exact_dedup}
