"""Near duplicates by SimHash, linked by meet-in-the-middle ball hashing.

Two fingerprints at most two bits apart have a common value within one bit of each. So
every distinct fingerprint emits the 65 values within one bit of it, the values are
shuffled, and fingerprints that meet at a value are linked once their distance is verified.
A value is met by at most 65 distinct fingerprints, all within two bits of each other, so
linking each to the least one of them loses no connection and emits no pairs within a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casemill.llm.common import compact, documents, join_groups, keep, small_batches, spread, stash
from casemill.llm.components import components
from casemill.llm.minhash import keep_one  # noqa: F401

#: Bits of a fingerprint, words of a shingle, seed of XXH64, radius of a link.
BITS, SHINGLE, SEED, RADIUS = 64, 3, 42, 2
#: Shingles whose bits are counted at once; bounds memory for very long texts.
BLOCK = 1 << 14
#: Fingerprints whose balls a task makes, about.
EXPANDED = 20_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned SimHash: a bit is set if it is set in over half the shingles' hashes. No word: 0."""
    from xxhash import xxh64_intdigest

    # bytes.lower() and bytes.split() know ASCII only: A-Z, and space with \t to \r
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], 0
    for w in words:
        at += len(w)
        ends.append(at)
        at += 1
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[shingle - 1 :] or ends[-1:]
    hashes = np.fromiter((xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts, last)), dtype="<u8", count=len(last))
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Unsigned; each bit is set if it is set in over half the 64-bit hashes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint's 64 bits as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def links(values: DataFrame, rows: int | None = None) -> DataFrame:
    """(a, b): edges that connect what lies within RADIUS bits; `values` has distinct fp, at most `rows` if given."""
    if rows:  # a row of 8 bytes becomes 65: dealt out by rows, as bytes say nothing about that
        values = values.repartition(max(values.sparkSession.sparkContext.defaultParallelism, -(-rows // EXPANDED)), "fp")
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(BITS)))
    balls = values.select("fp", F.explode(flips).alias("_flip")).select("fp", F.col("fp").bitwiseXOR(F.col("_flip")).alias("variant"))
    met = balls.withColumn("least", F.min("fp").over(Window.partitionBy("variant")))
    pairs = met.where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits), component_id.

    Very long texts count whole, in blocks; other columns are not read. component_id is the smallest id reachable over links, the row's own included. Texts
    without a word (null, empty, blank) have fingerprint zero and are linked with it like any
    other. Repeated ids are repeated in the result; null ids never become a component_id
    while the component has another. An empty table gives an empty result.
    """
    marked = stash(fingerprints(docs, id_col, text_col, shingle))
    rows = marked.count()
    values = keep(marked.groupBy("fp").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    roots = components(links(values.select("fp"), values.count()))
    placed = values.join(roots, values["fp"] == roots["node"], "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("values"))
    named = join_groups(placed, least, ["root"], "values", rows, "inner", "fp").select("fp", "n", "component_id")
    out = join_groups(marked, named, ["fp"], "n", rows, "inner", "id").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return compact(out, rows)


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(spread(documents(spark, sf_dir)))


QUERIES = {"op8_simhash": op8_simhash}
ORACLE: dict[str, str] = {}
