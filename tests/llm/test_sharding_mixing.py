import re
import zlib
from collections import Counter, defaultdict

import pytest

from casemill.llm import mixing, sharding
from casemill.llm.registry import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def check_shards(rows, texts):
    slots = defaultdict(list)
    for r in rows:
        text = (texts(r) or "").encode()
        assert r.size == len(text) + 16 and r.text_crc32 == zlib.crc32(text) and r.law == "key"
        assert r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_shards_of_documents(spark, sf, docs):
    rows = QUERIES["op2_sharding"](spark, sf).collect()
    by_id = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(by_id)
    check_shards(rows, lambda r: by_id[r.doc_id])
    again = {r.doc_id: (r.shard, r.slot) for r in QUERIES["op2_sharding"](spark, sf).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}


def test_odd_rows(odd, empty):
    rows = sharding.shard(odd).collect()
    assert len(rows) == 10 and len({r.shard for r in rows if r.doc_id == 6}) == 1
    assert {r.size for r in rows if r.doc_id == 2} == {16}
    assert sharding.shard(empty).collect() == []


def test_tree_balance_weights_and_movement(spark):
    from pyspark.sql import functions as F

    n = 40_000
    at = lambda node: sharding.shard_of(F.col("id").cast("string"), node)
    heavy = sharding.tree(40, {7: 3.0})
    df = spark.range(n).select("id", at(sharding.tree(40)).alias("a"), at(sharding.tree(41)).alias("b"), at(sharding.tree(42)).alias("c"), at(heavy).alias("h"))
    rows = df.collect()
    sizes = Counter(r.a for r in rows)
    assert len(sizes) == 40 and max(sizes.values()) < 1.2 * n / 40 and min(sizes.values()) > 0.8 * n / 40
    assert all(r.b in (r.a, 40) for r in rows) and all(r.c in (r.b, 41) for r in rows)
    assert 0.7 * n / 41 < sum(r.b == 40 for r in rows) < 1.3 * n / 41
    share = sum(r.h == 7 for r in rows) / n
    assert 0.05 < share < 0.09  # 3 of 42
    moved = [r for r in rows if r.h != r.a]
    assert all(r.h // 10 == 0 for r in moved)  # only into region 0, whose weight grew
    with pytest.raises(ValueError):
        sharding.tree(0)


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s] + 1e-9]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
        if not open_:
            return target


def check_mix(rows, docs):
    words = lambda t: len(WORD.findall(t or ""))
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += words(r.text)
    targets = brute_targets(sizes)
    source = {r.doc_id: r.source for r in docs}
    taken = defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 1


def test_mix_of_documents(spark, sf, docs):
    rows = QUERIES["op9_mixing"](spark, sf).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    assert {r.doc_id: r.size for r in rows} == {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    check_mix(rows, docs.collect())
    assert sorted(map(tuple, QUERIES["op9_mixing"](spark, sf).collect())) == sorted(map(tuple, rows))


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, "c": 5000}, {"a": 3, None: 400, "": 7}, {"a": 100}, {"a": 0, "b": 129}, {"a": 640, "b": 128, "c": 127, "d": 4000, "e": 1}])
def test_targets_and_totals(spark, sf, sizes, tmp_path):
    from pyspark.sql import functions as F

    parts, i = [], 0
    for source, size in sizes.items():
        while True:
            n = min(size, 37 + i % 90)
            parts.append((i, "w " * n, source))
            i, size = i + 1, size - n
            if size <= 0:
                break
    df = spark.createDataFrame(parts, "doc_id bigint, text string, source string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rows = mixing.op9_mixing(spark, str(tmp_path)).collect()
    check_mix(rows, df.collect())
    _, pieces, _ = mixing.mix(df)
    found = pieces.select("skey", "start", "pass", F.explode(F.expr("sequence(`from`, `from` + length - 1)")).alias("word")).collect()
    assert len(found) == len(set(found))  # no word twice in a pass
    assert len(found) == sum(r.taken for r in rows)


def test_permutation_is_one(spark):
    for size in (1, 2, 3, 97, 128, 1000):
        df = spark.range(size).selectExpr("id", f"{mixing._permuted('id', str(size), chr(39) + 'k' + chr(39))} AS p")
        rows = df.selectExpr("id", "p", f"{mixing._permuted('p', str(size), chr(39) + 'k' + chr(39), forward=False)} AS back").collect()
        assert sorted(r.p for r in rows) == list(range(size)) and all(r.back == r.id for r in rows)
        assert size < 97 or sum(r.p != r.id for r in rows) > size / 2


def test_mix_odd_rows(odd, empty):
    rows, pieces, n = mixing.mix(odd)
    assert n == rows.count() == 10
    assert mixing.mix(empty)[0].collect() == [] and mixing.mix(empty)[1].collect() == []
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    sizes = {r.text: len(WORD.findall(r.text or "")) for r in odd.collect()}
    assert all(0 < len(WORD.findall(r.text)) <= max(sizes.values()) for r in mixed.collect())
    assert mixing.mixed_documents(empty).collect() == []
    taken = Counter()
    for r in mixed.collect():
        taken[r.source] += len(WORD.findall(r.text))
    rows = rows.dropDuplicates(["skey"]).collect()
    assert all(abs(taken[r.source] - r.target) <= 1 for r in rows)


def test_native(spark, sf):
    plan = QUERIES["op9_mixing"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_slots_of_the_mix_are_not_broadcast(spark):
    text = "word " * 3000
    docs = spark.createDataFrame([(d, text, f"s{d % 3}") for d in range(60)], "doc_id bigint, text string, source string")
    _, pieces, _ = mixing.mix(docs)
    assert pieces.count() > 2000
    counted = pieces.groupBy().count()
    counted.collect()
    joins = [x for x in counted._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines() if "Join" in x and "index" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)
