import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from casemill.llm import packing
from casemill.llm.registry import QUERIES


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def check_packing(rows, ids_of, sequence=2048):
    """Every document's ids come back from its pieces, and sequences are filled without a gap."""
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= sequence
    for doc_id, found in pieces.items():
        ids = np.array([*ids_of(doc_id), 0], dtype="<u4")
        found.sort(key=lambda r: r.piece)
        at = 0
        for n, r in enumerate(found):
            assert (r.piece, r.start) == (n, at) and (n == 0 or r.length == sequence)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids) and (len(ids) > sequence or len(found) == 1)
    return len(places)


def test_packing_of_documents(spark, sf, docs, tokenizer):
    rows = QUERIES["op4_best_fit"](spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r.doc_id for r in rows} == set(texts)
    used = check_packing(rows, lambda d: tokenizer.encode(texts[d], add_special_tokens=False).ids)
    least = -(-sum(r.length for r in rows) // 2048)
    assert used <= 1.05 * least + 2


def test_packing_odd_rows(spark, odd, empty, tokenizer):
    rows = packing.packed_rows(odd).collect()
    once = [r for r in rows if r.doc_id != 6]
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert {r.doc_id for r in once} == set(texts) - {6} and sum(r.doc_id == 6 for r in rows) == 2
    pieces = {d: [r for r in once if r.doc_id == d] for d in texts}
    for d, found in pieces.items():
        if d != 6:
            assert sum(r.length for r in found) == len(tokenizer.encode(texts[d], add_special_tokens=False).ids) + 1
    assert packing.packed_rows(empty).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aÉñ \n\t1'.|<endoftxt> ", max_size=60))
def test_fast_ids_equal_those_of_the_tokenizer(text):
    encode = packing.encoder(public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.RANKS))
    assert encode(text) == encode.exact.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 8))
def test_bins_against_a_plain_search(lengths, most_open):
    bins, open_, opened = packing.Bins(64, most_open), {}, 0
    for n in lengths:
        number, offset = bins.put(n)
        fitting = [f for f in open_.values() if f >= n]
        if fitting:
            assert open_[number] == min(fitting)
        else:
            if len(open_) == most_open:
                closing = min(open_.values())
                if number == opened and bins.open <= most_open:
                    fullest = [k for k, f in open_.items() if f == closing]
                    gone = [k for k in fullest if k not in {x for v in bins.by_free.values() for x in v}]
                    del open_[gone[0]]
            assert number == opened
            opened += 1
            open_[number] = 64
        assert offset == 64 - open_[number]
        open_[number] -= n
        if not open_[number]:
            del open_[number]
        assert bins.open == len(open_) <= most_open


def test_pipeline(spark, sf, docs, tokenizer):
    from test_dedup import brute_exact
    from test_minhash import brute_kept

    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mixing", "packing"]
    current = docs
    first = stages["language"](spark, current, sf).cache()
    assert first.columns == docs.columns and first.count() == docs.count()  # all these documents are in a known language
    second = stages["exact_dedup"](spark, first, sf).cache()
    keep = {k for _, k, _, _ in brute_exact([(r.doc_id, r.text) for r in first.collect()])}
    assert second.columns == docs.columns and sorted(r.doc_id for r in second.collect()) == sorted(keep)
    third = stages["near_dedup"](spark, second, sf).cache()
    alike = [d for _, d in brute_kept([(r.doc_id, r.text) for r in second.collect()])]  # five-word shingles, 0.8 or more, all pairs
    assert third.columns == docs.columns and sorted(r.doc_id for r in third.collect()) == alike
    fourth = stages["mixing"](spark, third, sf).cache()
    assert fourth.columns == docs.columns
    texts, before = defaultdict(list), {r.doc_id: r for r in third.collect()}
    for r in fourth.collect():
        texts[r.doc_id].append(r.text)
        assert r.n_chars == len(r.text) and r.source == before[r.doc_id].source
    total = sum(len(t.split()) for ts in texts.values() for t in ts)
    assert abs(total - 1.5 * sum(len(r.text.split()) for r in before.values())) <= 25
    for d, ts in texts.items():
        have = before[d].text.split()
        assert len(ts) <= 2 and all(t == before[d].text or set(t.split()) <= set(have) for t in ts)
    fifth = stages["packing"](spark, fourth, sf).collect()
    assert sum(r.length for r in fifth) == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for ts in texts.values() for t in ts)


def test_pipeline_odd_rows(spark, odd, empty):
    for start in (odd, empty):
        current = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, current, "")
            assert out.columns == start.columns or name == "packing"
            if name != "language":
                current = out
        assert (current.count() > 0) == (start is odd)


def test_run_gives_the_stages_result(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 0
