"""Near copies by their share of common shingles: SimHash balls and MinHash candidates, exact check, one row of each group.

Texts are compared as sets of five-word shingles. First come the candidates of ball hashing (`simhash.links`): texts whose fingerprints, of
these shingles, are equal or linked at two bits. They are the closest copies. For pairs at 0.8 that differ in more bits each distinct text gets BANDS keys, each
made of DEPTH minima; texts that share a key are candidates, and a candidate pair is linked only if
its exact Jaccard similarity is SIMILAR or more. A pair at 0.8 shares a key with probability
1 - (1 - 0.8**5)**24 = 0.9999.

Not all pairs of a key are made. First each text is compared with the key's least one. What is linked
by then, over whatever keys, is one group already. Where a key's texts are still in several groups, they are mostly unlike
texts that share a passage. These open texts are joined exactly, by prefixes (Bayardo et al. 2007, Xiao et al. 2008): with all shingles in one
order, frequent ones last, a pair at 0.8 has a common shingle among the first fifth of each text's, so early that what follows can
still make up the 0.8. A passage that many texts share comes last in each and makes no pair unless it is nearly all of both texts.
Texts outside of a prefix shingle's main group become leaders in rounds (few, then more) and are compared with the shingle's texts in other groups,
until every pair has been compared, been ruled out, or is in one group. Sizes and places rule pairs out, and bitmaps of parities (Sandes et al.
2020), which can't differ in more bits than two texts in shingles; all three before a row is made of a pair. So no link between groups is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casemill.llm.common import discard, forget, join_groups, keep, nested, scratch, small, small_batches, stash
from casemill.llm.components import components

#: Words of a shingle, least similarity of a link, keys of a text, minima of a key, seed of XXH64.
SHINGLE, SIMILAR, BANDS, DEPTH, SEED = 5, 0.8, 24, 5, 42
#: Open texts that a shingle is in at least, to come late in the order; rarer ones are in the order of their hashes.
FREQUENT = 16
#: Leaders of a prefix shingle in the first round, and at most in a later one; each round has GROWTH times as many.
LEADERS, MOST_LEADERS, GROWTH = 16, 4096, 8
#: Words of 64 bits in a text's bitmap, a power of 2.
BITMAP = 8
#: Allowance for rounding where sizes and places rule a pair out.
ROUNDING = 1e-6
#: Shingles whose minima are taken at once (a block of minima stays in a core's cache), and sets of shingles that a task remembers.
BLOCK, REMEMBERED = 512, 32
#: Pairs that a task compares, about.
TASK_PAIRS = 2000
#: Multiplier of the polynomial that makes a shingle's hash of its words' hashes, odd; and of the step to 32 bits.
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

def _permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and shifts: each pair permutes the 32-bit numbers."""
    random = np.random.default_rng(seed)
    return (random.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None], random.integers(0, 1 << 32, count, dtype=np.uint32)[:, None]


_PERMUTATIONS = _permutations(BANDS * DEPTH, SEED)


def shingles(text: str | None) -> set[bytes]:
    """Shingles of the lower-cased words (ASCII); a text with fewer words is one shingle, one without a word has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    joined, ends, at = b" ".join(words), [], 0
    for w in words:
        at += len(w)
        ends.append(at)
        at += 1
    starts = [0, *(e + 1 for e in ends[:-1])]
    return {joined[i:j] for i, j in zip(starts, ends[SHINGLE - 1 :] or ends[-1:])}


def similar(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return both >= SIMILAR * (len(a) + len(b) - both)


def hashed_shingles(words: list[bytes]) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, ascending."""
    from xxhash import xxh64_intdigest

    hashed = np.fromiter((xxh64_intdigest(w, SEED) for w in words), dtype=np.uint64, count=len(words))
    length = min(SHINGLE, len(words))
    whole = hashed[: len(words) - length + 1].copy()
    for k in range(1, length):
        whole = whole * BASE + hashed[k : len(words) - length + 1 + k]
    return np.unique(whole)


def sketch(text: str | None) -> tuple[int, int, list[int], int]:
    """(node, number of distinct shingles, band keys, signed SimHash fingerprint of the distinct shingles) of a text.

    The node is a signed hash of the lower-cased words, so equal for texts that differ in case and spacing only. A text
    without a word has no key and fingerprint 0. Shingles are told apart by 64-bit hashes here; the exact check reads them themselves.
    """
    from xxhash import xxh64_intdigest

    from casemill.llm.simhash import majority

    words = (text or "").encode().lower().split()
    node = xxh64_intdigest(b" ".join(words), SEED)
    node -= (node >> 63) << 64
    if not words:
        return node, 0, [], 0
    whole = hashed_shingles(words)
    hashes = ((whole * MIX) >> np.uint64(32)).astype(np.uint32)
    factors, shifts = _PERMUTATIONS
    least = np.full(len(factors), np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(hashes), BLOCK):
        np.minimum(least, (factors * hashes[i : i + BLOCK] + shifts).min(axis=1), out=least)
    minima = least.reshape(BANDS, -1)
    fingerprint = majority(whole)
    return node, len(whole), [xxh64_intdigest(minima[k].tobytes(), k) - (1 << 63) for k in range(BANDS)], fingerprint - (fingerprint >> 63 << 64)


def prefix(whole: np.ndarray, frequent: dict[int, int]) -> np.ndarray:
    """The first shingles of a text in the common order, as many as a pair at SIMILAR may need to meet.

    A common shingle of such a pair has at least SIMILAR of the text's shingles from its place on.
    """
    often = np.fromiter((frequent.get(t, 0) for t in whole.tolist()), dtype=np.int64, count=len(whole)) if frequent else np.zeros(len(whole), np.int64)
    length = int(len(whole) * (1 - SIMILAR) + ROUNDING) + 1
    return whole[np.lexsort((whole, often))[:length]]


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hash, node, size, keys, fp) of every row: a hash of its text, and its sketch."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = [sketch(t) for t in batch.column(2).to_pylist()]
            columns = ([f[k] for f in found] for k in range(4))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["id", "hash", "node", "size", "keys", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return told_apart(docs, id_col, text_col).mapInArrow(run, f"id {kind}, hash bigint, node bigint, size bigint, keys array<bigint>, fp bigint")


def told_apart(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hash, text): a row is told by its id and a hash of its text."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))


def verified(pairs: DataFrame, pool: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar; `pool` has (node, text). Only texts of these pairs move."""
    with scratch(pairs.sparkSession):
        return _verified(pairs, pool)


def _verified(pairs: DataFrame, pool: DataFrame) -> DataFrame:
    rows = pairs.count()
    if not rows:
        return pairs.select("a", "b")
    tasks = max(pairs.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_PAIRS))

    def with_text(left: DataFrame, end: str, other: str) -> DataFrame:
        sizes = keep(pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n")))
        wanted = pool.toDF(end, f"text_{end}").join(small(sizes, rows), end)
        return join_groups(left, wanted, [end], "n", rows, "inner", other, narrow=False, tasks=tasks)

    both = with_text(with_text(pairs, "b", "a"), "a", "b")

    def run(batches):
        memory: dict[int, set[bytes]] = {}  # a leader's rows follow each other
        for batch in batches:
            a, b, left, right = (c.to_pylist() for c in batch.columns)
            hold = []
            for n, x, y in zip(a, left, right):
                if n not in memory:
                    if len(memory) == REMEMBERED:
                        memory.pop(next(iter(memory)))
                    memory[n] = shingles(x)
                hold.append(similar(memory[n], shingles(y)))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, h in zip(a, hold) if h], pa.int64()), pa.array([x for x, h in zip(b, hold) if h], pa.int64())], names=["a", "b"])

    return stash(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint"))


def bitmap(whole: np.ndarray) -> np.ndarray:
    """BITMAP words: each bit is the parity of the shingles that hash to it."""
    bits = 64 * BITMAP
    at = ((whole * MIX) >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & np.uint8(1)).view(np.int64)


def tokens(open_texts: DataFrame) -> DataFrame:
    """(node, token): the hashes of the distinct shingles of texts (node, text)."""

    def run(batches):
        for batch in batches:
            found = [hashed_shingles((t or "").encode().lower().split()).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "tokens"])

    return open_texts.select("node", "text").mapInArrow(run, "node bigint, tokens array<bigint>").select("node", F.explode("tokens").alias("token"))


def prefixes(open_texts: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, m, root) of the prefix shingles of texts (node, text) that are in texts of several groups, and (node, bits) of all these texts.

    m is (node, size, at), at being the shingle's place in the text's order; bits is the text's bitmap. `roots` is (node, root),
    for texts that are linked with another.
    """
    spark = open_texts.sparkSession
    counts = stash(tokens(open_texts).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT))
    rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def run(batches):
        for batch in batches:
            node, root, text, often = (batch.column(k) for k in range(4))
            size, keys, bits = [], [], []
            for t, f in zip(text.to_pylist(), often.to_pylist()):
                whole = hashed_shingles((t or "").encode().lower().split())
                size.append(len(whole))
                bits.append(bitmap(whole))
                keys.append(prefix(whole, {e["token"] & 0xFFFFFFFFFFFFFFFF: e["often"] for e in f or ()}).view(np.int64))
            yield pa.RecordBatch.from_arrays([node, root, pa.array(size, pa.int64()), *(pa.array(c, pa.list_(pa.int64())) for c in (keys, bits))], names=["node", "root", "size", "keys", "bits"])

    with scratch(spark):
        hits = join_groups(tokens(open_texts), counts.withColumn("often", F.col("n")), ["token"], "n", max(rows, counts.count() * FREQUENT), "inner", "node")
        by_text = hits.groupBy("node").agg(F.collect_list(F.struct("token", "often")).alias("often"))
        grouped = open_texts.join(by_text, "node", "left").join(roots, "node", "left")
        kinds = "node bigint, root bigint, size bigint, keys array<bigint>, bits array<bigint>"
        found = stash(grouped.select("node", F.coalesce("root", "node").alias("root"), "text", "often").mapInArrow(run, kinds))
        members = found.select("node", "root", "size", F.posexplode("keys").alias("at", "key"))
        count = found.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
        shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("key", "n")
        out = stash(join_groups(members.select("key", F.struct("node", "size", "at").alias("m"), "root", "node"), shared, ["key"], "n", count, "inner", "node").drop("node"))
        discard(counts)
        return out, found.select("node", "bits")


def in_reach(x: Column, y: Column) -> Column:
    """Whether members x and y (structs m, bits) of a prefix shingle can still be similar, if it is their first common one."""
    a, b = x["m"], y["m"]
    both = a["size"] + b["size"]
    left = F.least(a["size"] - a["at"], b["size"] - b["at"])
    differ = sum((F.bit_count(x["bits"][k].bitwiseXOR(y["bits"][k])) for k in range(BITMAP)), F.lit(0))
    needed = SIMILAR * both - ROUNDING
    return (left * (1 + SIMILAR) >= needed) & ((both - differ) * (1 + SIMILAR) >= 2 * needed)


def meet(sketched: DataFrame, count: int) -> DataFrame:
    """(key, m, node, least) of every text and key of its that another text has too: m is (node, size), least the least m
    of the key. `count` is the number of keys, repeated ones included."""
    members = sketched.select(F.explode("keys").alias("key"), "node", "size")
    # nearly all keys are of one text, so nothing but a count is carried for them
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    with scratch(sketched.sparkSession):
        shared = stash(join_groups(members, buckets, ["key"], "n", count, "inner", "node"))
        least = shared.groupBy("key").agg(F.min(F.struct("node", "size")).alias("least"), F.count(F.lit(1)).alias("n"))
        out = stash(join_groups(shared.select("key", F.struct("node", "size").alias("m"), "node"), least, ["key"], "n", shared.count(), "inner", "node"))
        discard(shared)
        return out


def unsettled(shared: DataFrame, roots: DataFrame, keys: int, count: int) -> DataFrame:
    """(key, m, root, main, shared) of the texts of keys whose texts are in several groups; main is the key's largest group, shared
    the number of the key's texts. A text is in `keys` rows of `shared` (key, m) or so."""
    with scratch(shared.sparkSession):
        degrees = roots.withColumn("n", F.lit(keys))
        named = join_groups(shared.select("key", "m", F.col("m.node").alias("node")), degrees, ["node"], "n", count, "left", "key")
        named = stash(named.select("key", "m", F.coalesce("root", "node").alias("root")))
        parts = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
        main = parts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        out = stash(join_groups(named, main.select("key", F.col("main.root").alias("main"), "n", F.col("n").alias("shared")), ["key"], "n", count, "inner", "root"))
        discard(named)
        return out


def candidates(pairs: DataFrame) -> DataFrame:
    """Pairs of members x and y as (a, b), the lesser node first, each pair once, without those whose sizes rule a link out."""
    x, y = F.col("x.node"), F.col("y.node")
    fit = F.least("x.size", "y.size") >= SIMILAR * F.greatest("x.size", "y.size")
    return pairs.where(fit & (x != y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def by_balls(values: DataFrame, count: int) -> DataFrame:
    """Candidates of ball hashing among `count` texts (node, size, fp): each text with the least one of its fingerprint, and these with
    those of the fingerprints that theirs are linked to."""
    from casemill.llm.simhash import links

    with scratch(values.sparkSession):
        least = keep(values.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("x"), F.count(F.lit(1)).alias("n")))
        same = join_groups(values.select("fp", "node", F.struct("node", "size").alias("y")), least.where("n > 1"), ["fp"], "n", count, "inner", "node")
        linked = stash(links(least.select("fp"), least.count()))
        many = linked.count()
        ends = [linked.select(F.col(end).alias("fp")) for end in ("a", "b")]
        wanted = keep(ends[0].unionByName(ends[1]).distinct())
        heads = keep(least.join(small(wanted, 2 * many), "fp", "left_semi").select("fp", "x"))
        apart = linked.join(small(heads.toDF("a", "x"), 2 * many), "a").join(small(heads.toDF("b", "y"), 2 * many), "b")
        out = stash(candidates(same.select("x", "y").unionByName(apart.select("x", "y"))))
        discard(linked)
    forget(values.sparkSession)
    return out


def groups(values: DataFrame, texts: DataFrame, repeated: bool = True) -> DataFrame:
    """(node, root) of the nodes that are linked with another, root being the least node of the group;
    `values` has distinct (node, id, hash, size, keys, fp), `texts` is as `told_apart` makes it, `repeated` says whether it may have rows
    alike in id and hash."""
    spark = values.sparkSession
    count = values.count() * BANDS
    close = by_balls(values.select("node", "size", "fp"), count // BANDS)
    shared = meet(values, count)
    # the one text of each node that shares a key or is in a close pair; what is compared is read from here
    with scratch(spark):
        wanted = shared.select(F.col("node").alias("_node")).unionByName(close.select(F.explode(F.array("a", "b")).alias("_node"))).distinct()
        meeting = keep(values.join(wanted, F.col("node") == F.col("_node"), "left_semi").select("node", F.col("id").alias("_id"), F.col("hash").alias("_hash")))
        here = (F.col("hash") == F.col("_hash")) & F.col("id").eqNullSafe(F.col("_id"))
        pool = texts.join(small(meeting, meeting.count()), here).select("node", "text")
        pool = stash(pool.groupBy("node").agg(F.first("text").alias("text")) if repeated else pool)
    fresh = stash(candidates(shared.select(F.col("least").alias("x"), F.col("m").alias("y"))).join(close, ["a", "b"], "left_anti"))
    roots = components(verified(close, pool).unionByName(verified(fresh, pool)))
    tried = close.unionByName(fresh)
    open_ = unsettled(shared, roots, BANDS, count)
    discard(shared)
    if open_.isEmpty():
        return roots
    with scratch(spark):
        nodes = keep(open_.select(F.col("m.node").alias("_node")).distinct())
        open_texts = stash(pool.join(small(nodes, nodes.count()), F.col("node") == F.col("_node"), "left_semi"))
    discard(open_)
    shared, bits = prefixes(open_texts, roots)
    count = shared.count()
    keys = -(-count // max(1, open_texts.count()))

    def with_bits(members: DataFrame) -> DataFrame:
        return join_groups(members, bits.withColumn("n", F.lit(keys)), ["node"], "n", count, "inner", "key")

    open_, led, leaders = unsettled(shared, roots, keys, count), None, LEADERS
    while True:
        outside = open_.where("root <> main")
        if led is not None:
            outside = outside.join(led.select(F.col("key").alias("_key"), F.col("node").alias("_node")), (F.col("key") == F.col("_key")) & (F.col("m.node") == F.col("_node")), "left_anti")
        # at most `leaders` rows of a key leave a task, by a partial top list before the shuffle; a text leads under all its keys at once or nearly
        order = Window.partitionBy("key").orderBy(F.xxhash64("m.node"), "m.node")
        chosen = stash(outside.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= leaders).select("key", "m", "root", "shared"))
        if chosen.isEmpty():
            return roots
        # a key is done if all of its texts outside of the main group lead by now
        more = outside.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > leaders).select(F.col("key").alias("_key"))
        rest = stash(open_.select("key", "m").join(more, F.col("key") == F.col("_key"), "left_semi"))
        now = chosen.select("key", F.col("m.node").alias("node"))
        led = now if led is None else led.unionByName(now)
        with scratch(spark):
            heads = with_bits(chosen.withColumn("node", F.col("m.node"))).groupBy("key").agg(F.collect_list(F.struct("m", "root", "bits")).alias("heads"), F.first("shared").alias("n"))
            members = with_bits(open_.select("key", "m", "root", F.col("m.node").alias("node")))
            dealt = join_groups(members, heads, ["key"], "n", count, "inner", "node", narrow=False)
            # what can't be a link is left out before rows are made of pairs
            y = F.struct("m", "root", "bits")
            met = dealt.select("m", F.explode(F.filter("heads", lambda h: (h["root"] != F.col("root")) & in_reach(h, y))).alias("h"))
            fresh = stash(candidates(met.select(F.col("h.m").alias("x"), F.col("m").alias("y"))).join(tried, ["a", "b"], "left_anti"))
        tried = tried.unionByName(fresh)
        found = verified(fresh, pool)
        if not found.isEmpty():
            roots = components(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))
        discard(open_)
        discard(shared)
        shared = rest
        count = shared.count()
        open_ = unsettled(shared, roots, keys, count)
        leaders = min(GROWTH * leaders, MOST_LEADERS)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, the one with the least id; rows without an id come last.

    A row is told by its id and text, so rows that share an id (null included) are judged each by
    its own text, and of rows with the same id and text in a group one stays. Texts without a word
    (null, empty, blank) are one group; very long texts are compared whole. An empty table gives an empty
    result, and no column name can clash with a helper's.
    """
    marked = stash(signatures(docs, id_col, text_col))
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("one")
    values = marked.groupBy("node").agg(one, F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("fp").alias("fp"))
    values = stash(values.select("node", "one", "one.id", "one.hash", "size", "keys", "fp"))
    twice = stash(marked.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("_id"), F.col("hash").alias("_hash")))
    repeated = not twice.isEmpty()
    roots = groups(values, told_apart(docs, id_col, text_col), repeated).withColumnRenamed("node", "_node")
    placed = values.join(roots, F.col("node") == F.col("_node"), "left").select("one", F.coalesce("root", "node").alias("root"))
    keepers = placed.groupBy("root").agg(F.min("one").alias("k")).select(F.col("k.id").alias("_id"), F.col("k.hash").alias("_hash"))
    here = F.col("id").eqNullSafe(F.col("_id")) & F.col("hash").eqNullSafe(F.col("_hash"))
    dropped = stash(marked.select("id", "hash").join(keepers, here, "left_anti").distinct().toDF("_id", "_hash"))
    kept = nested(docs, id=F.col(id_col), hash=F.xxhash64(F.col(text_col).cast("string"))).join(small(dropped, dropped.count()), here, "left_anti")
    if repeated:
        alike = kept.join(twice, here, "left_semi").groupBy("id", "hash").agg(F.first("row").alias("row"))
        kept = kept.join(twice, here, "left_anti").unionByName(alike.select("row", "id", "hash"))
    return kept.select("row.*")
