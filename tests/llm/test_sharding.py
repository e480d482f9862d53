import random
import zlib
from collections import Counter, defaultdict

import pytest

from tallymart.llm import sharding
from tallymart.llm.common import table


def check(rows, texts, shards):
    """The law, gapless slots, sizes; returns how many groups are cut although they would fit into a shard."""
    assert len(rows) == len(texts)
    counts = Counter(r.shard for r in rows)
    assert set(counts) <= set(range(shards))
    assert max(counts.values(), default=0) - min((counts[s] for s in range(shards)), default=0) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    groups = defaultdict(Counter)
    for r in rows:
        groups[r.text_crc32, r.size][r.shard] += 1
    limit = len(rows) // shards
    return sum(len(g) > 1 for g in groups.values() if sum(g.values()) <= limit), groups


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    rows = sharding.op5_balanced_shards(spark, sf).collect()
    cut, _ = check(rows, texts, 24)
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    assert cut <= 3


@pytest.mark.parametrize("kind", ["mixed", "hot", "all_linked", "one_group"])
def test_kinds_of_groups(spark, kind):
    r = random.Random(kind)
    if kind == "mixed":
        texts = [f"t{r.randrange(60)}" for _ in range(150)] + [f"alone {i}" for i in range(250)]
    elif kind == "hot":
        texts = ["hot"] * 150 + [f"u{i}" for i in range(250)] + ["pair"] * 2
    elif kind == "all_linked":
        texts = [f"t{i // 3}" for i in range(240)]
    else:
        texts = ["same"] * 101
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = sharding.balanced_shards(docs, shards=8, bits=3).collect()
    cut, groups = check(rows, texts, 8)
    if kind == "mixed":
        assert cut <= 2
    if kind == "hot":
        assert cut == 0 and len(groups[zlib.crc32(b"hot"), 11]) <= 4
    if kind == "all_linked":
        assert cut < 60


def test_pairs_alone_come_together(spark):
    texts = [f"t{i // 2}" for i in range(4000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    cut, _ = check(sharding.balanced_shards(docs, shards=8, bits=3).collect(), texts, 8)
    assert cut <= 24


def test_grants_go_around_rings():
    assert sharding.grant({(0, 1): 3, (1, 2): 2, (2, 0): 4}, [0, 0, 0]) == {(0, 1): 2, (1, 2): 2, (2, 0): 2}


def test_grants_stay_within_free_places_and_swaps():
    given = sharding.grant({(0, 1): 10, (1, 0): 4, (2, 1): 5}, [0, 6, 3])
    into = Counter()
    for (s, t), n in given.items():
        into[t] += n
        into[s] -= n
    assert into[1] <= 6 and into[0] <= 0 and all(n > 0 for n in given.values())


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "", 6), (2, "é" * 9, None), (3, "x" * 90000, 1)], "doc_id long, text string, shard int")
    rows = sharding.balanced_shards(docs, shards=3).collect()
    check(rows, [0] * 5, 3)
    assert sorted(r.size for r in rows) == [8, 8, 8, 26, 90008]
    assert sharding.balanced_shards(docs.limit(0)).count() == 0
