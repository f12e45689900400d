"""Sharding by a hierarchical weighted hash tree.

Shards are laid out in regions that double (shard 0; 1; 2 and 3; 4 to 7; ...), regions in racks. A document
descends region, rack and shard levels; at each, every child draws -ln(u) / weight from a hash of the document's
key and the child, and the least draw wins, so a child is chosen in proportion to its weight and a changed weight
moves documents only into or out of the subtrees that changed.

The newest region may have room for shards that do not exist yet. Its draws are a sequence of arrivals, spaced like a Poisson
process of the whole region's weight, and each arrival descends to a shard; the first one at a shard that exists is
the region's draw (thinning, so the existing shards' weight is its rate). One more shard can only turn arrivals that were
passed over into wins of its own: at every shard count, growing by one takes rows only into the new shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import compact, documents, keep, running_start

#: Shards of the query.
SHARDS = 40
#: Arrivals of the newest region that are looked at. Of equal weights, one document in 2 ** ARRIVALS may lie elsewhere than by an endless
#: sequence; growth keeps its promise whatever the number.
ARRIVALS = 32
#: In the place of a shard: the next arrival is looked at; the region's draw loses.
OPEN, LATE = -1, -2


@dataclass(frozen=True)
class Region:
    """Shards `first` .. `first + len(weights) - 1`, in racks of `rack` shards (both powers of two)."""

    number: int
    first: int
    weights: tuple[float, ...]

    @property
    def rack(self) -> int:
        return 1 << (len(self.weights).bit_length() // 2)

    @property
    def weight(self) -> float:
        return sum(self.weights)

    def racks(self) -> list[tuple[int, float, list[tuple[int, float]]]]:
        """(first shard, weight, (shard, weight) of each shard) of each rack; what has no weight is never taken and left out."""
        cut = [[(self.first + i, w) for i, w in list(enumerate(self.weights))[k : k + self.rack]] for k in range(0, len(self.weights), self.rack)]
        return [(rack[0][0], sum(w for _, w in rack), [x for x in rack if x[1] > 0]) for rack in cut if any(w > 0 for _, w in rack)]


@dataclass(frozen=True)
class Tree:
    """Regions that hold the first `shards` shards; the last one may have room for more."""

    shards: int
    regions: tuple[Region, ...]

    @property
    def newest(self) -> Region | None:
        last = self.regions[-1]
        return last if last.first + len(last.weights) > self.shards else None

    @property
    def complete(self) -> tuple[Region, ...]:
        return self.regions[:-1] if self.newest else self.regions


def tree(shards: int, weights: dict[int, float] | None = None) -> Tree:
    """The same layout at every count. Weights are 1 unless given."""
    if shards < 1:
        raise ValueError("a tree needs a shard")
    regions, first = [], 0
    while first < shards:
        size = max(1, first)
        regions.append(Region(len(regions), first, tuple(float((weights or {}).get(i, 1.0)) for i in range(first, first + size))))
        first += size
    if not any(w > 0 for r in regions for i, w in enumerate(r.weights) if r.first + i < shards):
        raise ValueError("no shard has a weight")
    return Tree(shards, tuple(regions))


def _let(value: Column, body) -> Column:
    """`body` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _draw(*parts: Column) -> Column:
    """Exponential with rate 1 from a hash of the parts."""
    unit = (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.ln(unit)


def _least(children: Column, drawn) -> Column:
    """The child with the least draw, nulls aside; width grows with the children of one node, not with the tree."""
    return F.array_min(F.transform(children, lambda c: F.struct(drawn(c).alias("draw"), c.alias("child"))))["child"]


def _reached(key: Column, racks: Column, arrival: Column) -> Column:
    """The shard that an arrival at a region reaches: rack, then shard."""
    rack = _least(racks, lambda r: _draw(key, F.lit("rack"), r["first"], arrival) / r["weight"])
    return _let(rack, lambda r: _least(r["shards"], lambda s: _draw(key, F.lit("shard"), s["shard"], arrival) / s["weight"])["shard"])


def _literal(region: Region) -> Column:
    """A region as a struct of its number, weight and racks with shards."""
    leaf = "named_struct('shard', {}, 'weight', {}D)"
    racks = [f"named_struct('first', {first}, 'weight', {weight}D, 'shards', array({', '.join(leaf.format(*x) for x in shards)}))" for first, weight, shards in region.racks()]
    return F.expr(f"named_struct('number', {region.number}, 'weight', {region.weight}D, 'racks', array({', '.join(racks)}))")


def shard_of(key: Column, of: Tree) -> Column:
    """The shard that `key` reaches; what has no weight is never taken."""
    open_ = [r for r in of.complete if r.weight > 0]
    nobody = F.struct(F.lit(float("inf")).alias("at"), F.lit(-1).alias("shard"))
    if open_:
        region = _least(F.array(*map(_literal, open_)), lambda r: _draw(key, F.lit("region"), r["number"], F.lit(1)) / r["weight"])
        old = _let(region, lambda r: F.struct((_draw(key, F.lit("region"), r["number"], F.lit(1)) / r["weight"]).alias("at"), _reached(key, r["racks"], F.lit(1)).alias("shard")))
    else:
        old = nobody
    newest = of.newest
    if newest is None or newest.weight <= 0:
        return old["shard"]

    def taken(region: Column, rival: Column) -> Column:
        """The shard of the first arrival at an existing shard, if it comes before the rival's draw; else a negative number."""

        def arrive(state: Column, n: Column) -> Column:
            at = state["at"] + _draw(key, F.lit("region"), region["number"], n) / region["weight"]
            here = lambda t: F.when(t >= rival, F.lit(LATE)).otherwise(_let(_reached(key, region["racks"], n), lambda s: F.when(s < of.shards, s).otherwise(F.lit(OPEN))))
            return F.when(state["shard"] == OPEN, _let(at, lambda t: F.struct(t.alias("at"), here(t).alias("shard")))).otherwise(state)

        start = F.struct(F.lit(0.0).alias("at"), F.lit(OPEN).alias("shard"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ARRIVALS)), start, arrive)["shard"]

    first = newest.first if not open_ else None  # where no other region is open, the first shard takes what no arrival has settled
    won = lambda o: _let(_let(_literal(newest), lambda r: taken(r, o["at"])), lambda s: F.when(s >= 0, s).otherwise(o["shard"] if first is None else F.lit(first)))
    return _let(old, won)


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", weights: dict[int, float] | None = None) -> DataFrame:
    """One row per input row: id_col, size, text_crc32, law, shard, slot, grown_shard.

    The id alone decides the shard (a null id is a key like any other; repeated ids share a
    shard). Size is the text's UTF-8 bytes plus 16; a null text has none and the checksum of
    the empty one. Slots number a shard's rows without a gap, in an order of hashed ids.
    An empty table gives an empty result; other columns are not read, so their names may clash.
    """
    text, key = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    narrow = docs.select(F.col(id_col).alias("id"), key.alias("key"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = narrow.withColumns({"shard": shard_of(F.col("key"), tree(shards, weights)), "grown_shard": shard_of(F.col("key"), tree(shards + 1, weights))})
    placed = keep(placed.drop("key"))
    rows = placed.count()
    numbered = running_start(placed.withColumn("_one", F.lit(1).cast("long")), "shard", ["id", "text_crc32", "size"], "_one", rows)
    return compact(numbered.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("start").alias("slot"), "grown_shard"), rows)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))


QUERIES = {"op2_sharding": op2_sharding}
ORACLE: dict[str, str] = {}
