"""Mixing sources to target weights, in DataFrame operations only.

The words of each source form one stream (documents in hash order), which is cut into blocks
of fixed length. Each source's total of words is its target; the slots that take them are
spread over output shards by unit draws, so that a shard's counts by source are multinomial
given the totals, and the totals are met to the word. A source's slots are numbered shard by
shard (in hash order); a slot's number gives a pass over the source and a place in it, the place is mapped by
a pseudorandom permutation of that source and pass to a block index, and slots join blocks by
(source, index). A pass takes no block twice, and a target of at most twice the size needs at
most two passes, so no document is taken more than twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casemill.llm.common import WORD, compact, documents, join_groups, keep, nested, running_start, small, source_key, word_count

#: Words of a block, slots of an output shard, unit draws that one generated row expands to.
BLOCK, SHARD_SLOTS, CHUNK = 128, 4096, 8192
#: Slots that a task permutes, about.
TASK_SLOTS = 50_000
#: Weights by the rank of a source; words of the mix in proportion to all words; most passes over a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Rounds of the swap-or-not permutation.
ROUNDS = 32


def targets(sizes: DataFrame) -> DataFrame:
    """Adds weight and target to (skey, source_size, ...): water-filling with caps of MOST times the size.

    A source stops at its cap as soon as the common level (words for one unit of weight)
    exceeds cap / weight; sources are taken by that ratio, and the level is the first that
    holds for all that remain. One row per source: few enough for one window frame.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy("skey")))
    weighed = ranked.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), F.pmod(F.col("_rank") - 1, F.lit(len(WEIGHTS))) + 1))
    weighed = weighed.withColumn("_cap", F.col("source_size") * F.lit(float(MOST))).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    everything = Window.partitionBy()
    below = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0.0)
    levels = weighed.withColumn("_total", F.sum("source_size").over(everything) * F.lit(SHARE)).withColumn(
        "_level",
        (F.col("_total") - F.coalesce(F.sum("_cap").over(below), nothing)) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), nothing)),
    )
    found = levels.withColumn("_found", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_level"))).over(everything)["_level"])
    return found.withColumn("target", F.when(F.col("_found").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_found") * F.col("weight")))).drop("_rank", "_cap", "_ratio", "_total", "_level", "_found")


def _permuted(index: str, size: str, key: str, forward: bool = True) -> str:
    """SQL of a swap-or-not permutation of 0 .. size - 1 (Hoang, Morris, Rogaway 2012).

    In each round an index and its mirror image in a keyed point change places if a hash bit
    of the greater one says so. Rounds undo themselves, so the inverse runs them backwards.
    """
    mirror = f"pmod(pmod(xxhash64({key}, r), {size}) + {size} - x, {size})"
    order = f"sequence(0, {ROUNDS - 1})" if forward else f"sequence({ROUNDS - 1}, 0, -1)"
    return f"aggregate({order}, cast({index} as bigint), (x, r) -> if(xxhash64({key}, r, greatest(x, {mirror})) & 1 = 1, {mirror}, x))"


def plan(sized: DataFrame) -> DataFrame:
    """One row per source with words: blocks, whole passes, words and slots of the partial pass."""
    sizes = sized.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    out = targets(sizes).withColumn("words", F.least(F.round("target").cast("long"), MOST * F.col("source_size")))

    def worded(df: DataFrame, **columns: str) -> DataFrame:
        """Adds columns that are null for a source without words."""
        return df.withColumns({name: F.expr(f"if(source_size > 0, {sql}, null)") for name, sql in columns.items()})

    out = worded(out, blocks=f"(source_size + {BLOCK - 1}) div {BLOCK}", full="words div source_size")
    out = worded(out, short=f"source_size - (blocks - 1) * {BLOCK}", rest="words - full * source_size", last_at=_permuted("blocks - 1", "blocks", "skey, full", forward=False))
    part = f"if(rest <= last_at * {BLOCK}, (rest + {BLOCK - 1}) div {BLOCK}, last_at + 1 + greatest(0, (rest - last_at * {BLOCK} - short + {BLOCK - 1}) div {BLOCK}))"
    return worded(out, slots=f"full * blocks + {part}")


def slots(planned: DataFrame) -> DataFrame:
    """One row per slot of the mix: skey, shard, slot, pass, index (of the block), take (its words)."""
    live = planned.where("slots > 0")
    total = live.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_SLOTS))
    tasks = max(live.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_SLOTS))
    # three levels of at most CHUNK rows each, dealt out in between: no row makes a long array, however large its source
    heaps = live.select("skey", "slots", F.explode(F.expr(f"sequence(0L, (slots - 1) div {CHUNK * CHUNK})")).alias("_heap"))
    if total > CHUNK * CHUNK:
        heaps = heaps.repartition(tasks, "skey", "_heap")
    chunks = heaps.select("skey", "slots", F.explode(F.expr(f"sequence(_heap * {CHUNK}, least((slots - 1) div {CHUNK}, (_heap + 1) * {CHUNK} - 1))")).alias("_chunk"))
    units = chunks.repartition(tasks, "skey", "_chunk").select("skey", F.explode(F.expr(f"sequence(_chunk * {CHUNK}, least(slots, (_chunk + 1) * {CHUNK}) - 1)")).alias("_unit"))
    drawn = keep(units.groupBy("skey", F.expr(f"pmod(xxhash64('shard', skey, _unit), {shards})").alias("shard")).agg(F.count(F.lit(1)).alias("n")))
    firsts = running_start(drawn, "skey", ["shard"], "n", drawn.count()).withColumnRenamed("start", "_first")
    # a row holds a shard's slots of a source; dealt out before they are expanded, as bytes say nothing about that
    numbered = firsts.join(small(live, live.count()), "skey").repartition(tasks, "skey", "shard").withColumn("q", F.explode(F.expr("sequence(_first, _first + n - 1)")))
    placed = numbered.withColumn("pass", F.expr("q div blocks")).withColumn("at", F.expr("q % blocks"))
    placed = placed.withColumn("index", F.expr(_permuted("at", "blocks", "skey, pass")))
    length = f"if(index = blocks - 1, short, {BLOCK})"
    before = f"at * {BLOCK} - if(at > last_at, {BLOCK} - short, 0)"
    take = placed.withColumn("take", F.expr(f"if(pass < full, {length}, least({length}, rest - ({before})))"))
    return take.select("skey", "shard", F.col("q").alias("slot"), "pass", "index", "take")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, int]:
    """(rows, pieces, number of rows): what the mix takes of each document.

    rows: one per input row, with id, source, hashed text, size, source_size, target and its
    place (skey, start) in the source's stream. pieces: (skey, start, shard, slot, pass, from, length), the
    run of words `from` .. `from + length - 1` of the document at (skey, start) that a slot takes.
    A null source is a source of its own, ranked last; null and blank texts have no words and
    no pieces; rows that repeat others are rows of their own; an empty table gives empty results.
    """
    sized = keep(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), source_key(F.col(source_col)).alias("skey"), F.xxhash64(F.col(text_col)).alias("hashed"), word_count(F.col(text_col)).alias("size")))
    planned = keep(plan(sized))
    count = sized.count()
    placed = keep(running_start(sized, "skey", ["id", "hashed", "size"], "size", count))
    cut = placed.where("size > 0").select("skey", "start", "size", F.explode(F.expr(f"sequence(start div {BLOCK}, (start + size - 1) div {BLOCK})")).alias("index"))
    cut = cut.select("skey", "start", "index", F.expr(f"greatest(start, index * {BLOCK})").alias("_from"), F.expr(f"least(start + size, (index + 1) * {BLOCK})").alias("_to"))
    # both sides are rows made of few: Spark sizes them by those few and would send all slots to the driver for a broadcast
    taken = slots(planned).hint("merge").join(cut, ["skey", "index"]).withColumn("_end", F.expr(f"least(_to, index * {BLOCK} + take)")).where("_end > _from")
    pieces = taken.select("skey", "start", "shard", "slot", "pass", F.expr("_from - start").alias("from"), F.expr("_end - _from").alias("length"))
    rows = join_groups(placed, planned.select("skey", "source_size", "target", "source_rows"), ["skey"], "source_rows", count, "inner", "start")
    return rows, pieces, count


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    rows, pieces, count = mix(documents(spark, sf_dir))
    taken = pieces.groupBy("skey", "start").agg(F.sum("length").alias("taken"))
    worded = rows.where("size > 0").join(taken, ["skey", "start"], "left")
    empty = rows.where("size = 0").withColumn("taken", F.lit(None).cast("long"))
    out = worded.unionByName(empty).select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    return compact(out, count)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The mix as documents: for each pass that takes words of a document a row with those words.

    A document taken whole keeps its text; of one taken in part, the words taken are joined by
    spaces in their order. Columns stay those of `docs`; `chars_col`, if there, follows the text. Null, empty and
    blank texts have no words and give no row; a null source is a source; rows alike in id, source and text are rows of
    their own; a text is split once, however long; an empty table gives an empty result. No column name can clash with a helper's.
    """
    rows, pieces, _ = mix(docs, id_col, text_col, source_col)
    runs = pieces.groupBy("skey", "start", "pass").agg(F.sum("length").alias("words"), F.sort_array(F.collect_list(F.struct("from", "length"))).alias("runs"))
    wanted = rows.where("size > 0").join(runs, ["skey", "start"]).select(F.col("id").alias("id1"), F.col("skey").alias("skey1"), F.col("hashed").alias("hashed1"), "start", "words", "runs", "size")
    keyed = nested(docs, id=F.col(id_col), skey=source_key(F.col(source_col)), hashed=F.xxhash64(text_col))
    whole = F.col("row").getField(text_col)
    same = (F.col("skey") == F.col("skey1")) & (F.col("hashed") == F.col("hashed1")) & F.col("id").eqNullSafe(F.col("id1"))
    repeated = rows.where("size > 0").groupBy("skey", "hashed", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():  # rows alike in id, source and text are told apart by number
        keyed = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("skey", "hashed", "id").orderBy("id")))
        wanted = wanted.withColumn("nth1", F.dense_rank().over(Window.partitionBy("skey1", "hashed1", "id1").orderBy("start")))
        same = same & (F.col("nth") == F.col("nth1"))
    split = F.array(F.regexp_extract_all(whole, F.lit(f"({WORD})"), F.lit(1)))  # bound by the outer lambda: once for a text
    chosen = F.transform(split, lambda words: F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(words, (r["from"] + 1).cast("int"), r["length"].cast("int")))), " "))[0]
    made = keyed.join(wanted, same).select("row", F.when(F.col("words") == F.col("size"), whole).otherwise(chosen).alias("text"))
    new = {text_col: F.col("text"), **({chars_col: F.length("text").cast(docs.schema[chars_col].dataType)} if chars_col in docs.columns else {})}
    return made.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


QUERIES = {"op9_mixing": op9_mixing}
ORACLE: dict[str, str] = {}
