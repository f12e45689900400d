"""Columns with helpers' names come back unchanged; methods' verdicts against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from casemill.llm import exact_dedup, language_id, minhash, mixing, pii, quality, sharding, url_filter

HELPERS = ("row", "id", "node", "hash", "norm", "digest", "suspect", "length", "prefix", "_id", "_digest", "_hash", "_node", "skey", "hashed", "start", "words", "runs", "size", "nth", "block", "w0", "on_list", "matched", "may", "spread", "n", "keys", "key")


def with_helpers(df):
    return df.select("*", *(F.lit(f"mine-{h}").alias(h) for h in HELPERS))


def test_no_helper_clashes(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(40)) for _ in range(6)]
    rows = [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate([*texts, texts[0], None, ""])]
    docs = with_helpers(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    for stage in (exact_dedup.keep_first, minhash.keep_one, mixing.mixed_documents):
        out = stage(docs)
        assert out.columns == docs.columns
        found = out.collect()
        assert found and all(r[h] == f"mine-{h}" for r in found for h in HELPERS), stage
    pages = with_helpers(spark.createDataFrame([(1, "http://a.com/x"), (2, None)], "page_id bigint, url string"))
    listed = spark.createDataFrame([("http://a.com/x",)], "url string")
    found = url_filter.filter_urls(pages, listed).collect()
    assert {r.page_id: r.verdict for r in found} == {1: "block", 2: "allow"}
    assert all(r[h] == f"mine-{h}" for r in found for h in HELPERS)


def spark_hash(*parts):
    seed = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else int(p).to_bytes(4, "little", signed=True)
        seed = xxhash.xxh64(data, seed).intdigest()
    return seed


def plain_descent(key, tree):
    """The first arrival of each region that reaches an existing shard; the earliest of them wins."""

    def draw(*parts):
        return -math.log(((spark_hash(key, *parts) >> 11) + 0.5) * 2.0**-53)

    def reached(region, n):
        _, _, shards = min((draw("rack", first, n) / weight, first, shards) for first, weight, shards in region.racks())
        return min((draw("shard", s, n) / w, s) for s, w in shards)[1]

    best = []
    for region in tree.regions:
        at = 0.0
        for n in range(1, sharding.ARRIVALS + 1):
            at += draw("region", region.number, n) / region.weight
            shard = reached(region, n)
            if shard < tree.shards:
                best.append((at, shard))
                break
    return min(best)[1]


@pytest.mark.parametrize("shards", [1, 2, 7, 13, 39, 40, 41, 1000])
def test_shards_by_plain_descent_and_law(spark, shards):
    now, grown = sharding.tree(shards), sharding.tree(shards + 1)
    rows = spark.range(300).select("id", *(sharding.shard_of(F.col("id").cast("string"), t).alias(a) for t, a in ((now, "a"), (grown, "b")))).collect()
    assert all(r.b in (r.a, shards) for r in rows)
    assert [r.a for r in rows] == [plain_descent(str(r.id), now) for r in rows]


def test_forest_by_plain_walks():
    rng = np.random.default_rng(4)
    rows = rng.random((300, 6))
    forest = quality.Forest(rows, rows.min(axis=0), rows.max(axis=0), trees=9)
    probe = rng.random((40, 6)) * 1.3

    def path(x, tree):
        feature, split, left, right, length = tree
        at = 0
        while feature[at] >= 0:
            at = left[at] if x[feature[at]] < split[at] else right[at]
        return length[at]

    expected = [2 ** -(sum(path(x, t) for t in forest.trees) / (len(forest.trees) * forest.norm)) for x in probe]
    assert np.allclose(forest.score(probe), expected)


def test_repeated_words_by_hashes_and_texts():
    rng = random.Random(5)
    for spread in (2, 9, 400):
        words = [f"w{rng.randrange(spread)}".encode() for _ in range(500)]
        assert list(quality._repeated_hashes(words, 8)) == list(quality._repeated_views(words, 8))


def test_language_by_plain_distance():
    texts = {"en": "the cat and the dog sat on the mat with the hat", "de": "der hund und die katze und das haus sind auf dem berg"}
    rankings = {k: language_id.ranking(language_id.letters_of(t), language_id.PROFILE).tolist() for k, t in texts.items()}
    profiles = language_id.Profiles(rankings)
    for text in ("the hat and the mat", "das haus und der hund", "xyz"):
        padded = "".join(c if c.isalpha() else " " for c in f" {text} ")
        grams = Counter()
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if " " not in (g if n == 1 else g[1:-1]):
                    grams[g] += 1
        key = lambda g: int("".join(f"{language_id.EDGE if c == ' ' else ord(c):021b}" for c in g), 2)
        own = sorted((-n, key(g)) for g, n in grams.items())[: language_id.RANKING]
        distance = {k: sum(min(abs(r.index(g) - i), language_id.PROFILE) if g in r else language_id.PROFILE for i, (_, g) in enumerate(own)) for k, r in rankings.items()}
        lang = min(sorted(distance), key=distance.get)
        assert profiles.predict(text) == (lang, 1 - distance[lang] / (language_id.PROFILE * len(own)))


def test_schemes_and_blanks_of_any_length():
    scheme, blanks = "a" * 40, " " * 50
    assert [(pii.KINDS[k], a) for a, k, _ in pii.spans(f"{scheme}://host/x")] == [("url", 0)]
    text = f"password:{blanks}hunter22"
    assert [text[a:b] for a, k, b in pii.spans(text) if pii.KINDS[k] == "account"] == ["hunter22"]


@pytest.mark.parametrize("c", [" ", "\t", "\n", "a", "7", "."])
def test_encoder_takes_long_runs(c):
    import public_tokenizers

    from casemill.llm import packing

    encode = packing.encoder(public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.RANKS))
    text = c * 1_000_000 + "x"
    assert encode(text) == encode.exact.encode(text, add_special_tokens=False).ids
