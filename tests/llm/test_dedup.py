import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from oracle import compare

from casemill.llm import exact_dedup, simhash
from casemill.llm.common import running_start
from casemill.llm.components import components
from casemill.llm.registry import ORACLE, QUERIES

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[SPACE.sub(" ", text or "")].append(doc_id)
    return {(d, min((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for d in ids}


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    values = sorted(set(fps.values()))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, v in fps.items():
        least[find(v)] = min(least.get(find(v), d), d)
    return {d: least[find(v)] for d, v in fps.items()}


def test_exact_against_sql(spark, sf):
    assert compare(QUERIES["op7_exact_dedup"](spark, sf), ORACLE["op7_exact_dedup"], sf) == ""


def test_exact_odd_rows(odd, empty):
    rows = exact_dedup.exact_dedup(odd).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows} == brute_exact([(r.doc_id, r.text) for r in odd.collect()])
    assert sorted(r.doc_id for r in rows if r.kept and r.doc_id is not None) == [1, 2, 4, 6, 7, 9]
    assert sum(r.kept for r in rows) == 7  # the row without an id is alone in its group
    assert exact_dedup.exact_dedup(empty).collect() == []
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == 7


def test_progressive_levels_separate(spark):
    texts = ["a" * 80, "b" * 80, "x" * 70 + "1", "x" * 70 + "2", "x" * 70 + "2", "short"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = exact_dedup.refine(exact_dedup.signatures(df), len(texts)).collect()
    assert [(r.keep_id, r.group_size) for r in found] == [(3, 2)]


def test_native(spark, sf):
    plan = QUERIES["op7_exact_dedup"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("text", [None, "", "One", "one two", "A b C d E f", "x y z " * 5000, "ñ Ñ ß\u00a0x İ i"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_simhash_on_documents(spark, docs):
    rows = simhash.simhash_groups(docs).collect()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    assert {r.doc_id: r.fingerprint for r in rows} == {d: f"{v:016x}" for d, v in fps.items()}
    assert {r.doc_id: r.component_id for r in rows} == brute_components(fps)


def test_links_by_planted_distances(spark):
    random = np.random.default_rng(3)
    values = [int(v) for v in random.integers(0, 1 << 63, 40)]
    for v in values[:10]:
        one, two, three = (v ^ sum(1 << int(b) for b in random.choice(64, k, replace=False)) for k in (1, 2, 3))
        values += [one, two, three, two ^ 3]
    fps = {i: v & ((1 << 64) - 1) for i, v in enumerate(values)}
    signed = [(i, v - (1 << 64) if v >> 63 else v) for i, v in fps.items()]
    df = spark.createDataFrame(signed, "id bigint, fp bigint")
    roots = components(simhash.links(df.select("fp").distinct()))
    named = {r.node & ((1 << 64) - 1): r.root for r in roots.collect()}
    by_root = defaultdict(list)
    for i, v in fps.items():
        by_root[named.get(v, ("alone", v))].append(i)
    assert {i: min(ids) for ids in by_root.values() for i in ids} == brute_components(fps)


def test_simhash_odd_rows(odd, empty):
    rows = simhash.simhash_groups(odd).collect()
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == {1: 1, 2: 2, 3: 2, 4: 2, 5: 1, 6: 1, 7: 7, 9: 9}
    assert len(rows) == 10
    assert simhash.simhash_groups(empty).collect() == []
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 7, 9]


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(1, 200)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    mixed = [(3000 + i * 7919 % 101, 3000 + (i + 1) * 7919 % 101) for i in range(100)]
    df = spark.createDataFrame(path + star + mixed + [(5, 5), (2, 1)], "a bigint, b bigint")
    rows = components(df).collect()
    assert len(rows) == len({r.node for r in rows})
    assert {r.root for r in rows if r.node <= 200} == {1} and {r.root for r in rows if 1000 <= r.node < 1200} == {1000} and {r.root for r in rows if r.node >= 3000} == {3000}
    assert components(df.limit(0)).collect() == []


def test_running_start(spark):
    rows = [(("hot" if i % 3 else "cold"), i, i % 7) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    out = running_start(df, "k", ["i"], "v", 50_000).collect()
    for key in ("hot", "cold"):
        at = 0
        for r in sorted((r for r in out if r.k == key), key=lambda r: (r.start, r.v)):
            assert r.start == at
            at += r.v


def test_join_groups_with_hot_keys(spark):
    from pyspark.sql import functions as F

    from casemill.llm.common import join_groups

    left = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).cast("long").alias("k"))
    groups = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).where("k < 10000 or k is null")
    out = join_groups(left, groups, ["k"], "n", 20_000, "left", "id").collect()
    assert len(out) == 20_000 and all((r.top is None) == (r.k >= 10000) for r in out)
    assert {r.top for r in out if r.k == 1} == {19_998}
    assert join_groups(left, groups, ["k"], "n", 20_000, "left_semi", "id").count() == sum(r.k < 10000 for r in out)


def test_results_outlive_released_frames(spark, docs):
    from casemill.llm.common import release

    out = exact_dedup.exact_dedup(docs)
    release()
    assert out.count() == docs.count()


def test_lost_blocks_are_computed_again(spark, docs):
    out = simhash.simhash_groups(docs)
    spark.catalog.clearCache()
    assert out.count() == docs.count()
