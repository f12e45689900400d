"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path
from urllib.parse import unquote
from weakref import WeakKeyDictionary

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space, the only word separator these operators know.
SPACE = "\\x20\\x09-\\x0D"
SPACE_RUN = f"[{SPACE}]+"
WORD = f"[^{SPACE}]+"
#: Rows and bytes of an Arrow batch, at most (a single longer text is a batch of its own).
ARROW_ROWS, ARROW_BYTES = 512, 16 << 20
#: Frames of `running_start`: rows of one on large inputs, and how many there are at least (with 64 rows each) on smaller ones.
FRAME_ROWS, FRAMES = 4096, 4096
#: A key is hot if it holds more than this share of all rows, so at most so many keys are; parts that a hot key is dealt to.
HOT_KEYS, SALTS = 1000, 64

#: Rows (a few numbers or one digest each) of a side that may be broadcast, once they are counted: at most some 20 MB.
BROADCAST_ROWS = 100_000
#: Rows of a table that `spread` may shuffle.
SPREAD_ROWS = 200_000
#: Rows with texts that one task may take, whatever their keys.
FEW_ROWS = 10_000
#: Rows of a partition that a narrow result is written from, about.
FILE_ROWS = 250_000

#: What `keep` and `stash` hold, by session.
_kept: WeakKeyDictionary[SparkSession, list[DataFrame]] = WeakKeyDictionary()
_stashed: WeakKeyDictionary[SparkSession, list[DataFrame]] = WeakKeyDictionary()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals a table of few files and rows to all cores, ahead of costly work on each row; leaves any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = len(df.inputFiles()) < cores and df.count() <= SPREAD_ROWS
    return df.repartition(cores) if few else df


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once, and lets workers import this package from where the driver has it.

    On a cluster whose executors don't see that folder the package has to be installed there, as any library. Both are settings
    of the session: Spark reads them when the frame runs, so they cannot be taken back here.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, environment.get("PYTHONPATH"))))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one only where none is set (tests)."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="casemill-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder and reads them back.

    The copy lives on shared storage, so it survives lost executors. `discard` removes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash/{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._stash_path = path  # type: ignore[attr-defined]
    _stashed.setdefault(spark, []).append(kept)
    return kept


def keep(df: DataFrame) -> DataFrame:
    """Keeps the rows of a frame that several steps read on the executors' disks.

    Lineage stays: what a lost executor held is computed again from the input. For narrow
    frames that are cheap to compute again; loops and stages use `stash`.
    """
    _kept.setdefault(df.sparkSession, []).append(df.persist(StorageLevel.DISK_ONLY))
    return df


def release(spark: SparkSession | None = None) -> None:
    """Gives back what `keep` holds for a session (the active one). Results that still need a frame compute it again."""
    spark = spark or SparkSession.getActiveSession()
    for df in _kept.pop(spark, []) if spark else []:
        df.unpersist()


def settle(spark: SparkSession, docs: DataFrame) -> None:
    """Gives back what earlier steps kept and the copies that `docs` doesn't read, and lets Spark delete the shuffle files of frames that nobody holds any more.

    Spark does so once the driver's garbage collector meets such frames, which may be long after. For the beginning of a
    stage whose input is stored.
    """
    release(spark)
    folders = {unquote(file.rsplit("/", 1)[0]) for file in docs.inputFiles()}
    for df in _stashed.pop(spark, []):
        if any(folder.endswith(df._stash_path.rsplit("/", 1)[1]) for folder in folders):
            _stashed.setdefault(spark, []).append(df)
        else:
            discard(df)
    forget(spark)


def forget(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nobody holds any more."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession):
    """Gives back at the end what is kept within: for steps whose result is stored by then."""
    mark = len(_kept.setdefault(spark, []))
    yield
    for df in _kept.get(spark, [])[mark:]:
        df.unpersist()
    del _kept.get(spark, [])[mark:]


def sweep(spark: SparkSession, but: DataFrame | None = None) -> None:
    """Removes all copies that `stash` wrote in this session, but one. For when results that read them are stored."""
    for df in _stashed.pop(spark, []):
        if df is but:
            _stashed.setdefault(spark, []).append(df)
        else:
            discard(df)


def nested(df: DataFrame, **keys: Column) -> DataFrame:
    """The row as one struct `row`, beside keys made of its columns. No name that an operator adds
    can clash with a column of the caller's then; `select("row.*")` gives the columns back."""
    return df.select(F.struct("*").alias("row"), *(value.alias(name) for name, value in keys.items()))


def compact(df: DataFrame, rows: int) -> DataFrame:
    """Fewer and larger partitions for a narrow result: about FILE_ROWS rows each, but one for each core at least.

    Without effect where there are no more partitions than that, as on large inputs.
    """
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))
    return df.coalesce(wanted)


def discard(df: DataFrame) -> None:
    """Deletes what `stash` wrote, once nothing needs it any more."""
    path = getattr(df, "_stash_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def word_count(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_key(source: Column) -> Column:
    """A never-null key that keeps null apart from every string, and sorts null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def running_start(df: DataFrame, key: str, order: list[str], value: str, rows: int) -> DataFrame:
    """Adds `start`: for each row of a key, the sum of `value` over the rows before it.

    The order is by a hash of `order` and then by `order`. A key may hold most rows, so
    frames are (key, hash bucket) pairs of at most about FRAME_ROWS rows; bucket totals are summed
    in groups of buckets and then over groups, which leaves one row for each four million rows
    to the last window. `df` is read twice: pass a narrow kept table.
    """
    buckets = max(1, -(-rows // FRAME_ROWS), min(FRAMES, -(-rows // 64)))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("long"))
    before = (Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")

    def summed(window):
        return F.coalesce(F.sum("_v").over(window.rowsBetween(*before)), zero)

    local = dealt.withColumn("_v", F.col(value).cast("long")).withColumn("_local", summed(Window.partitionBy(key, "_bucket").orderBy(*order))).drop("_v")
    sums = dealt.groupBy(key, "_bucket").agg(F.sum(F.col(value).cast("long")).alias("_v")).withColumn("_group", F.floor(F.col("_bucket") / 1024))
    groups = sums.groupBy(key, "_group").agg(F.sum("_v").alias("_v"))
    groups = groups.withColumn("_far", summed(Window.partitionBy(key).orderBy("_group"))).drop("_v")
    offsets = sums.withColumn("_near", summed(Window.partitionBy(key, "_group").orderBy("_bucket"))).join(groups, [key, "_group"]).select(key, "_bucket", (F.col("_near") + F.col("_far")).alias("_offset"))
    return local.join(offsets, [key, "_bucket"]).withColumn("start", F.col("_local") + F.col("_offset")).drop("_bucket", "_local", "_offset")


def join_groups(left: DataFrame, groups: DataFrame, on: list[str], count: str, rows: int, how: str, spread: str, narrow: bool = True, tasks: int | None = None) -> DataFrame:
    """Joins rows with a table that has one row for each key and the number of left rows of that key.

    Where there are many rows, the table is kept and counted first. If it is small (and `narrow`: numbers and digests only) it is broadcast and `left` is not shuffled at all. Else a key may hold much of
    the left side: keys with more than a HOT_KEYS-th of all `rows` (at most HOT_KEYS, so their list is broadcast) are dealt to
    SALTS parts by a hash of `spread`, and their one row is repeated for each part. `count` is not in the result. `tasks` sets
    the number of tasks of a shuffled join, for rows that cost more than their bytes tell.
    """
    dealt = (lambda df, *key: df.repartition(tasks, *key)) if tasks else (lambda df, *key: df)
    if narrow and rows <= BROADCAST_ROWS:  # as are the keys then
        return left.join(F.broadcast(groups.drop(count)), on, how)
    if not narrow and rows <= FEW_ROWS:  # a task can take them all
        return dealt(left, *on).join(groups.drop(count), on, how)
    groups, bound = keep(groups), max(1, rows // HOT_KEYS)
    many, top = groups.agg(F.count(F.lit(1)), F.max(count)).first()
    plain = groups.drop(count)
    if narrow and many <= BROADCAST_ROWS:
        return left.join(F.broadcast(plain), on, how)
    if not many or top <= bound:
        return dealt(left, *on).join(plain, on, how)
    hot = groups.where(F.col(count) > bound).select(*on, F.lit(True).alias("_hot"))
    same = [f"_{c}" for c in on]
    marked = left.join(F.broadcast(hot.toDF(*same, "_hot")), [F.col(a) == F.col(b) for a, b in zip(on, same)], "left").drop(*same)
    salted = marked.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    parts = F.when(F.col(count) > bound, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = groups.withColumn("_salt", F.explode(parts)).drop(count)
    return dealt(salted, *on, "_salt").join(repeated, [*on, "_salt"], how).drop("_salt")


def small(df: DataFrame, rows: int) -> DataFrame:
    """`df` marked for broadcast if its counted rows allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
