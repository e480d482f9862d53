import bisect
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallymart.llm import packing
from tallymart.llm.common import Cut, table
from tallymart.llm.queries import QUERIES


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [1]


HARD = ["", None, " ", "It's  a\tDOG's\n\x0b life\x0c!!", "été É É", "İstanbul ΣΣΣ ﬁn", "a\x00b \x1c\x1d c\x7f", " x y　z", "12345 ١٢ ½", "<|endoftext|> x<|startoftext|>", "'s't'RE 'LLama we'll", "\U0001f600\U0001f600 \U00020000", "x" * 5000, "don’t ẞ ß", "a​b ﻿", "ÀÉÖ×÷Øßÿ naïve,ÅNGSTRÖM'S", "Ça!va?3×4÷2"]


def test_ids_are_those_of_the_library(reference):
    own = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for text in HARD:
        assert np.frombuffer(own.encode(text), "<u4").tolist() + [1] == reference(text), text


def check(rows, docs, reference, limit=4096):
    ids = {i: reference(t) for i, t in docs}
    seen, places = defaultdict(int), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == limit * r.piece == seen[r.doc_id] and r.length == len(part) <= limit
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        seen[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert seen == {i: len(x) for i, x in ids.items()}
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= limit
    return len(places), -(-sum(seen.values()) // limit)


def test_query_against_the_library(spark, sf, reference):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    used, least = check(QUERIES["op11_best_fit_packing"](spark, sf).collect(), docs, reference)
    assert used <= least * 1.01 + 2


def test_nulls_repeats_clashes_and_long_texts(spark, reference):
    rows = [(k, t, "x", 1) for k, t in enumerate(HARD)] + [(100, "word " * 9000, "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, `a.b` int")
    check(packing.pack(packing.pieces(docs)).collect(), [r[:2] for r in rows], reference)
    twice = packing.pack(packing.pieces(docs.unionByName(docs))).collect()
    assert len(twice) == 2 * packing.pieces(docs).count()
    assert packing.pack(packing.pieces(docs.filter("false"))).collect() == []
    assert [r.length for r in packing.pack(packing.pieces(docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), "text"))).collect()] == [1]


def test_sequences_hold_the_ids(spark, reference):
    rows = [(1, "some words here"), (2, "w " * 50), (3, None)]
    found = packing.pieces(spark.createDataFrame(rows, "doc_id long, text string"), limit=16, keep_ids=True)
    packed = packing.pack(found, 16).cache()
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert sum(map(len, whole.values())) == sum(len(reference(t)) for _, t in rows)


def test_sweep_is_best_fit_with_the_largest_first():
    rng = np.random.default_rng(5)
    for _ in range(200):
        items, gaps = rng.integers(1, 12, rng.integers(0, 12)), rng.integers(1, 12, rng.integers(0, 12))
        size, kind = np.r_[items, gaps], np.r_[np.zeros(len(items), int), np.ones(len(gaps), int)]
        order = np.lexsort((kind, size))
        a, b = packing.sweep(size[order], kind[order])
        free, want = Counter(gaps.tolist()), Counter()
        for s in sorted(items.tolist(), reverse=True):
            fits = [g for g in sorted(free) if g >= s and free[g]]
            if fits:
                free[fits[0]] -= 1
                want[s, fits[0]] += 1
        assert Counter(zip(size[order][a].tolist(), size[order][b].tolist())) == want


def test_bridges_join_what_one_sweep_would():
    rng = np.random.default_rng(6)
    for _ in range(200):
        size, kind = rng.integers(1, 30, 40), rng.integers(0, 2, 40)
        order = np.lexsort((kind, size))
        size, kind = size[order], kind[order]
        whole = set(zip(*(x.tolist() for x in packing.sweep(size, kind))))
        cuts = [0, *sorted(rng.integers(0, 41, 4)), 40]
        got, left, ranks = set(), [], {}
        for part, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            a, b = packing.sweep(size[lo:hi], kind[lo:hi])
            got |= set(zip((a + lo).tolist(), (b + lo).tolist()))
            free = [i for i in range(lo, hi) if i - lo not in set(a) | set(b)]
            for k in (0, 1):
                ranks[part, k] = [i for i in free if kind[i] == k]
            left.append((part, len(ranks[part, 1]), len(ranks[part, 0])))
        for part, lo, hi, to, both in packing.bridges(left):
            got |= {(ranks[part, 0][r], ranks[to, 1][both - r]) for r in range(lo, hi + 1)}
        assert got == whole


@pytest.mark.parametrize("sizes, most", [([10] * 3000, 74), ([2048] * 50 + [2049] * 3, 28), ([4095] * 20 + [1] * 20, 20), ([1365] * 300, 100), ([], 0)])
def test_hot_sizes(spark, sizes, most):
    items = spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "id long, size int")
    found, bins = packing.best_fit(items, 4096 if sizes[:1] != [10] else 410, Cut(spark, "t"))
    assert found.count() == len(sizes) and bins == most


def test_ranges_of_few_rows_give_the_same_packing(spark, monkeypatch):
    sizes = np.random.default_rng(7).integers(1, 4000, 1500).tolist()
    items = spark.createDataFrame(list(enumerate(sizes)), "id long, size int")
    one = packing.best_fit(items, 4096, Cut(spark, "t"))
    monkeypatch.setattr(packing, "RANGE_ROWS", 100)
    many = packing.best_fit(items, 4096, Cut(spark, "t"))
    loads = []
    for found, bins in (one, many):
        rows = found.collect()
        load = Counter()
        for r in rows:
            load[r.bin] += sizes[r.id]
        assert len(rows) == len(sizes) and max(load.values()) <= 4096
        loads.append(bins)
    one_by_one = []  # best fit with the largest first, an item at a time
    for size in sorted(sizes, reverse=True):
        at = bisect.bisect_left(one_by_one, size)
        room = one_by_one.pop(at) if at < len(one_by_one) else 4096
        bisect.insort(one_by_one, room - size)
    assert loads[0] == loads[1] <= len(one_by_one) * 1.01 + 1
