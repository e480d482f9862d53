import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallymart.llm import simhash
from tallymart.llm.common import Cut, table


def brute_fingerprint(text):
    import re

    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=3):
    """fps: {id: fingerprint}."""
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(ids, 2):
        if (fps[a] ^ fps[b]).bit_count() <= radius:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


def test_fingerprint_and_hash_function(spark):
    for t in [None, "", " ", "One", "a b", "A b C", "é Ñ x y z ß", "a b c d " * 50, "\x0b a \x0c b\rc"]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    got = spark.range(1).select(F.xxhash64(F.lit("a b ñ")).alias("h")).first().h
    assert got & (2**64 - 1) == xxhash.xxh64_intdigest("a b ñ".encode(), 42)


def test_query_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(fps)
    rows = simhash.op8_simhash_near_dedup(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == want[r.doc_id]
    assert len(set(want.values())) < len(want)


def random_fps(seed, clusters, size):
    """Skewed bits, chains of near fingerprints, and dense clouds."""
    r = random.Random(seed)
    out = []
    for _ in range(clusters):
        x = r.getrandbits(64) & r.getrandbits(64)
        for _ in range(r.randint(1, size)):
            out.append(x)
            y = x
            for _ in range(r.randint(0, 5)):
                y ^= 1 << r.randrange(64)
            x = y if r.random() < 0.5 else x
            out.append(y)
    return out


def test_search_for_any_partition_and_thresholds(spark):
    fps = random_fps(3, 60, 6) + random_fps(4, 1, 120) + [0, 2**64 - 1, 7]
    want = brute_components(dict(enumerate(fps)))
    df = spark.createDataFrame([(i, simhash._signed(x)) for i, x in enumerate(fps)], "doc_id long, fp long").repartition(3)
    for parts in (1, 2, 3, 4):
        got = {r.doc_id: r.component_id for r in df.join(simhash.near_duplicates(df, parts=(parts,)), "fp").collect()}
        assert got == want, parts


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {b" ".join(w)} if w else set()


def brute_groups(texts):
    """Smallest id of each group, by all pairs: fingerprints of the distinct words within the radius, AGREE equal bytes of
    the sketches, and a Jaccard similarity of 0.8 or more."""
    sigs, sets = {}, {i: shingle_set(t) for i, t in texts.items()}
    for i, t in texts.items():
        ones = [xxhash.xxh64_intdigest(w, 42) for w in set((t or "").encode().lower().split())]
        fp = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in ones) > len(ones))
        sigs[i] = fp, bytes(min((xxhash.xxh64_intdigest(x, 42) * int(f) % 2**64 for x in sets[i]), default=0) % 256 for f in simhash.FACTORS)
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(texts, 2):
        near = (sigs[a][0] ^ sigs[b][0]).bit_count() <= simhash.STAGE_RADIUS and sum(map(int.__eq__, sigs[a][1], sigs[b][1])) >= simhash.AGREE
        both = len(sets[a] & sets[b])
        if near and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in texts}


def test_links_are_verified(spark):
    """Families of texts with few and many edits, so that candidates below 0.8 stand between those above it."""
    r = random.Random(6)
    base = [[f"w{r.randrange(3000)}" for _ in range(r.randint(4, 120))] for _ in range(25)]
    texts = {}
    for i in range(300):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"v{r.randrange(50)}"
        texts[i] = " ".join(w)
    texts |= {300: None, 301: " ", 302: "w " * 9, 303: "w", 304: "W", 305: texts[0].upper()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = set(brute_groups(texts).values())
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == want and 30 <= len(want) < 250


def test_texts_of_the_same_words_are_not_joined(spark):
    """A third of the table has one fingerprint, and none of it is a near copy."""
    r = random.Random(2)
    words = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(r.sample(words, 40)) if i % 3 else f"other{i} " * 3 + f"text{i}") for i in range(600)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 600


def test_forest_proposes_around_what_is_refuted():
    fp, bucket = np.array([1, 1, 1, 1, 7], np.uint64), np.array([0, 0, 0, 0, 1])
    bad = {(0, 1), (1, 2)}
    refuted = lambda i, j: (min(i, j), max(i, j)) in bad
    pairs = simhash.forest(bucket, fp, refuted=refuted)
    assert not bad & set(pairs) and len(pairs) == 3
    assert simhash.forest(bucket, fp, joined=np.array([5, 5, 5, 5, 5])) == []
    assert len(simhash.forest(bucket, fp, joined=np.array([5, 5, 6, 6, 5]))) == 1
    assert len(simhash.forest(bucket, fp, joined=np.array([5, 5, 6, 6, 5]), tries=4)) == 4
    apart = np.array([[k, k | 2**40 - 1 << 20] for k in range(100)], np.uint64).T.ravel()  # two trees of one size, joined by nothing
    assert len(simhash.forest(np.zeros(200, int), apart, radius=8)) == 198
    late = np.array([2**k - 1 << 1 for k in range(0, 40, 5)] * 9 + [1], np.uint64)
    assert len(simhash.forest(np.zeros(73, int), late, radius=5)) == 72
    assert len(simhash.forest(np.zeros(3000, int), np.array([0] * 2999 + [2**60 - 1], np.uint64))) == 2998


def test_keys_of_probes(spark):
    fp = 0b1011 | 1 << 63
    groups = [list(range(0, 32)), list(range(32, 64))]
    rows = simhash.probes(spark.createDataFrame([(simhash._signed(fp),)], "fp long"), groups, [1, 0]).collect()
    keys = {(r.part, r.key & (2**64 - 1)) for r in rows}
    assert keys == {(0, 0b1011), (1, 1 << 63)} | {(0, 0b1011 ^ 1 << b) for b in range(32)} and len(rows) == 34


def test_forest_spans_what_is_linked():
    r = np.random.default_rng(1)
    fp = np.array(random_fps(9, 4, 60), np.uint64)
    bucket = np.sort(r.integers(0, 5, len(fp)))
    pairs = simhash.forest(bucket, fp)
    for b in range(5):
        at = np.flatnonzero(bucket == b).tolist()
        want = brute_components({i: int(fp[i]) for i in at})
        root = {i: i for i in at}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for x, y in pairs:
            if x in root:
                assert find(x) != find(y)
                root[max(find(x), find(y))] = min(find(x), find(y))
        assert len({find(i) for i in at}) == len(set(want.values()))


def test_allocation_meets_the_pigeonhole_sum():
    both = np.full((64, 64), 250)
    np.fill_diagonal(both, 500)
    for parts in (1, 2, 3, 4):
        groups = simhash.partition_bits(1000, both, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        for n in (10, 10**6, 10**10):
            assert sum(t + 1 for t in simhash.allocate(n, both, groups)) == simhash.RADIUS + 1


def test_components_of_a_path_and_a_star(spark, tmp_path):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long"), Cut(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}} or got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}


def test_nulls_repeats_and_empty_tables(spark):
    text = "the quick brown fox jumps over the lazy dog again and again " * 4
    rows = [(3, text, 1), (2, text, 2), (None, text, 3), (2, text, 2), (9, None, 4), (8, "", 5), (None, "alone here", 6), (5, "entirely different words stand in this one", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.fp) for r in kept.collect() if r.doc_id is not None) == [(2, 2), (5, 7), (8, 5)]
    assert [r.fp for r in kept.collect() if r.doc_id is None] == [6]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_sketches_tell_somewhat_alike_texts_from_near_copies():
    """Of pairs of a Jaccard similarity of 0.5 few are candidates, of those of 0.8 nearly all."""
    r = np.random.default_rng(8)

    def share(alike):
        both = round(400 * alike)
        hits = 0
        for _ in range(400):
            h = r.integers(0, 2**64, 400, np.uint64)
            own = both + (400 - both) // 2
            hits += int((simhash.sketch(h[:own]) == simhash.sketch(np.r_[h[:both], h[own:]])).sum() >= simhash.AGREE)
        return hits / 400

    assert share(0.8) > 0.98 and share(0.5) < 0.1


def test_a_candidate_comes_from_one_of_its_buckets(spark, monkeypatch):
    """Near copies meet in most of their buckets; what the buckets propose stays near the number of texts."""
    r, made, real = random.Random(12), [], simhash.buckets

    def counted(*args):
        made.append(real(*args).count())
        return real(*args)

    monkeypatch.setattr(simhash, "buckets", counted)
    base = [f"w{r.randrange(3000)}" for _ in range(200)]
    texts = []
    for i in range(300):
        w = list(base)
        w[r.randrange(200)] = f"v{i}"
        texts.append((i, " ".join(w)))
    kept = simhash.keep_one(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert [k.doc_id for k in kept] == [0] and sum(made) < 600


def test_each_pair_has_one_owner_among_the_keys_of_both():
    r = random.Random(13)
    groups, limits = [list(range(k * 16, k * 16 + 16)) for k in range(4)], [2, 1, -1, 2]
    masks = [sum(1 << b for b in g) for g in groups]
    for _ in range(500):
        a = r.getrandbits(64)
        b = a
        for _ in range(r.randint(0, 6)):
            b ^= 1 << r.randrange(64)
        if all(t < 0 or ((a ^ b) & m).bit_count() > 2 * t for m, t in zip(masks, limits)):
            continue
        pair = np.array([a], np.uint64), np.array([b], np.uint64)
        part, key = (x[0] for x in simhash.owner(*pair, groups, limits))
        assert (part, key) == tuple(x[0] for x in simhash.owner(*pair[::-1], groups, limits))
        assert all(((x & masks[part]) ^ (int(key) & (2**64 - 1))).bit_count() <= limits[part] for x in (a, b))


def test_shapes_never_refute_a_link():
    """And refute most pairs of a similarity of 0.7."""
    r, refuted = np.random.default_rng(14), 0
    for k in range(400):
        n = int(r.integers(1, 600))
        h = np.unique(r.integers(0, 2**32, 3 * n, np.uint64).astype("<u4"))
        r.shuffle(h)
        both, rest = h[:n], h[n:]
        more = int(n * r.random() * (0.3 if k % 2 else 0.5))
        own = int(r.integers(0, more + 1))
        a, b = (np.unique(np.r_[both, x]).astype("<u4") for x in (rest[:own], rest[own:more]))
        alike = n / (n + more)
        may = simhash.may_be_similar(simhash.shape(a), simhash.shape(b))
        assert may or alike < 0.8
        refuted += alike < 0.72 and not may
    assert refuted > 30
    nothing = simhash.shape(np.zeros(0, "<u4"))
    assert simhash.may_be_similar(nothing, nothing) and not simhash.may_be_similar(nothing, simhash.shape(np.array([5], "<u4")))


def test_coarse_rows_are_dealt_to_all_keys():
    r = np.random.default_rng(15)
    groups, limits = [list(range(0, 20)), list(range(20, 41)), list(range(41, 64))], [1, 2, -1]
    coarse = [[1, 5, 19], [20, 33], [50]]
    fps = r.integers(0, 2**64, 12, np.uint64)

    def keys(bits, fp, t):
        own = int(fp) & sum(1 << b for b in bits)
        return {own ^ sum(1 << b for b in c) for k in range(t + 1) for c in combinations(bits, k)}

    rows = sorted((k, key, i) for i, fp in enumerate(fps) for k in (0, 1) for key in keys(coarse[k], fp, limits[k])) + [(-1, 77, 0), (4, 5, 1)]
    part, key, who = (np.array(x) for x in zip(*rows))
    at, got = simhash.dealt(part, key.astype(np.uint64), fps[who], groups, limits, coarse)
    have = list(zip(part[at].tolist(), got.tolist(), who[at].tolist()))
    want = [(k, key, i) for i, fp in enumerate(fps) for k in (0, 1) for key in keys(groups[k], fp, limits[k])] + [(-1, 77, 0), (4, 5, 1)]
    assert have == sorted(want)


def test_what_is_shuffled_for_a_text_stays_small(spark, monkeypatch):
    """Few rows a text in the first round, one in later rounds, and no text at all for the rows that stay."""
    r, sent, real = random.Random(16), [], simhash.buckets

    def counted(keyed, *args):
        sent.append((keyed.count(), keyed.select("node").distinct().count()))
        return real(keyed, *args)

    monkeypatch.setattr(simhash, "buckets", counted)
    base = [[f"w{r.randrange(3000)}" for _ in range(200)] for _ in range(30)]
    texts = []
    for i in range(600):
        w = list(base[i % 30])
        for _ in range(r.choice((1, 7, 8, 9))):
            w[r.randrange(200)] = f"v{r.randrange(900)}"
        texts.append((i, " ".join(w)))
    out = simhash.keep_one(spark.createDataFrame(texts, "doc_id long, text string"))
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().toString() and "Exchange SinglePartition" not in out._jdf.queryExecution().toString()
    assert out.count() == len(set(brute_groups(dict(texts)).values()))
    assert len(sent) > 1 and sent[0][0] <= 24 * sent[0][1] and all(n == nodes for n, nodes in sent[1:])


@pytest.mark.parametrize("together", [2, 2048])
def test_groups_of_large_components(spark, monkeypatch, together):
    """Coarse keys of a few bits; components that meet by keys again, and those that meet in one bucket."""
    monkeypatch.setattr(simhash, "COARSE_ROWS", 16)
    monkeypatch.setattr(simhash, "TOGETHER", together)
    r = random.Random(17)
    base = [[f"w{r.randrange(3000)}" for _ in range(r.randint(20, 200))] for _ in range(12)]
    texts = {}
    for i in range(300):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"v{r.randrange(50)}"
        texts[i] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {x.doc_id for x in simhash.keep_one(docs).collect()} == set(brute_groups(texts).values())


def test_rows_that_repeat_and_many_that_go(spark, monkeypatch):
    """Rows that stay are found by broadcasts or by a shuffle, and once each."""
    rows = [(i % 40, f"text number {i % 25} of words", "x" if i % 3 else None) for i in range(120)] + [(None, f"another {i % 3}", None) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more string")
    got = sorted(simhash.keep_one(docs).collect(), key=str)
    texts = {r[1] for r in rows}
    assert len(got) == len(texts) == len({g.text for g in got}) and all(tuple(g) in rows for g in got)
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 5)
    assert sorted(simhash.keep_one(docs).collect(), key=str) == got
