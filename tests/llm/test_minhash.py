import random

from casemill.llm import minhash, simhash


def brute_kept(rows):
    """Rows that stay, by all pairs of exact similarities."""
    sets = [minhash.shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or minhash.similar(sets[i], sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(find(i), []).append((d is None, d or 0, t or ""))
    return sorted(min(g)[:2] for g in groups.values())


def near(words, n, rng):
    out = list(words)
    for k in rng.sample(range(len(words)), n):
        out[k] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_pairs_beyond_two_bits_are_one_group(spark):
    rng = random.Random(5)
    rows, far = [], 0
    for g in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        copy = near(words, 2, rng)
        rows += [(2 * g, " ".join(words)), (2 * g + 1, copy)]
        far += (simhash.fingerprint(rows[-1][1]) ^ simhash.fingerprint(rows[-2][1])).bit_count() > 2
    assert far > 20  # what links of two bits leave
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 80, 2))


def test_large_group_and_unlike_texts_of_one_passage(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, near(words, 4, rng)) for i in range(60)]
    rows += [(100 + i, " ".join(words[:200]) + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(120))) for i in range(40)]
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((False, r.doc_id) for r in kept) == brute_kept(rows)


def test_null_and_repeated_ids(spark):
    words = [[f"{g}{i}" for i in range(100)] for g in "abcd"]
    copy = lambda g: " ".join(words[g][:99] + ["end"])
    rows = [
        (1, " ".join(words[0])), (None, copy(0)), (None, " ".join(words[1])),  # the second goes, the unrelated third stays
        (7, " ".join(words[2])), (7, copy(0)),  # of one id only the copy goes
        (None, " ".join(words[3])), (None, copy(3)),  # a group without ids keeps one
        (9, "same words"), (9, "same words"), (9, "Same  WORDS"),
    ]
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert kept.columns == ["doc_id", "text"]
    kept = kept.collect()
    firsts = sorted((r.doc_id or 0, r.text.split()[0].lower()) for r in kept)
    assert firsts == [(0, "b0"), (0, "d0"), (1, "a0"), (7, "c0"), (9, "same")]


def test_prefixes_and_bitmaps_lose_no_pair():
    rng = random.Random(8)
    linked = 0
    for _ in range(300):
        n = rng.randrange(1, 200)
        words = [f"w{rng.randrange(3000)}" for _ in range(n)]
        other = near(words, rng.randrange(1 + n // 20), rng).split() + [f"y{k}" for k in range(rng.randrange(1 + n // 10))]
        sets = [minhash.hashed_shingles(" ".join(w).encode().split()) for w in (words, other)]
        both = len(set(sets[0].tolist()) & set(sets[1].tolist()))
        assert sum((int(x) ^ int(y)).bit_count() for x, y in zip(*(minhash.bitmap(s).view("uint64") for s in sets))) <= len(sets[0]) + len(sets[1]) - 2 * both
        if both < minhash.SIMILAR * (len(sets[0]) + len(sets[1]) - both):
            continue
        linked += 1
        frequent = {t: rng.randrange(16, 40) for s in sets for t in s.tolist() if t % 3}
        x, y = (minhash.prefix(s, frequent).tolist() for s in sets)
        first = min((x.index(t), y.index(t)) for t in x if t in y)
        needed = minhash.SIMILAR * (len(sets[0]) + len(sets[1])) - minhash.ROUNDING
        assert all((len(s) - at) * (1 + minhash.SIMILAR) >= needed for s, at in zip(sets, first))
    assert linked > 100


def test_long_passage_over_many_texts_of_several_groups(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(150):  # the passage is 70 to 100 % of a text, so some pairs are just similar and others just not
        tail = [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 70))]
        rows.append((i, " ".join(words + tail)))
        if i % 5 == 0:
            rows.append((1000 + i, near(words + tail, 3, rng)))
    rows = [(d, t) for k, (d, t) in enumerate(rows) if len(t.split()) > 180 or k % 4 == 0]
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((False, r.doc_id) for r in kept) == brute_kept(rows)


def test_ball_hashing_gives_candidates(spark):
    rng = random.Random(10)
    words = [[f"w{rng.randrange(5000)}" for _ in range(1500)] for _ in range(12)]
    texts = [" ".join(w) for w in words] + [" ".join([*w[:-1], "end"]) for w in words] + ["", "one two", "one two three four five six"]
    marked = minhash.signatures(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "doc_id", "text")
    rows = marked.collect()
    assert rows[-3].fp == 0 and len({r.node for r in rows}) == len(texts)
    close = {frozenset(p) for p in minhash.by_balls(marked.select("node", "size", "fp"), len(texts)).collect()}
    fits = lambda x, y: min(x.size, y.size) >= minhash.SIMILAR * max(x.size, y.size)
    bits = lambda x, y: ((x.fp ^ y.fp) & (2**64 - 1)).bit_count()
    near_bits = [(x, y) for i, x in enumerate(rows) for y in rows[:i] if bits(x, y) <= simhash.RADIUS and fits(x, y)]
    assert len(near_bits) >= 6 and close <= {frozenset((x.node, y.node)) for x, y in near_bits}
    root = {r.node: r.node for r in rows}
    for _ in rows:  # what is near in bits is connected
        for a, b in map(tuple, close):
            root[a] = root[b] = min(root[a], root[b])
    assert all(root[x.node] == root[y.node] for x, y in near_bits)
