from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallymart.llm import mixing
from tallymart.llm.common import table


def brute_cycle(quota, cycle):
    """Earliest deadline first, one slot after the other; ties to the first name."""
    done, out = {s: 0 for s in quota}, []
    for slot in range(cycle):
        ready = [(-(-(done[s] + 1) * cycle // q), s) for s, q in sorted(quota.items()) if done[s] < q and done[s] * cycle // q <= slot]
        s = min(ready)[1]
        out.append((s, done[s], slot))
        done[s] += 1
    return out


@pytest.mark.parametrize("weights", [{"a": 1.0}, {"a": 0.5, "b": 0.3, "c": 0.2}, {f"s{i}": 1.0 + i * i for i in range(9)}, {"x": 1e-6, "y": 1.0}])
def test_cycle_against_brute_force(spark, weights):
    quota = mixing.quotas(spark.createDataFrame(list(weights.items()), "mix_source string, weight double"), 64)
    by = {r.mix_source: r.quota for r in quota.collect()}
    assert sum(by.values()) == 64 and min(by.values()) >= 1
    got = sorted(((r.mix_source, r.nth, r.offset) for r in mixing.one_cycle(quota, 64).collect()), key=lambda x: x[2])
    assert got == brute_cycle(by, 64)
    ran = Counter()
    for slot, (s, _, _) in enumerate(got, 1):
        ran[s] += 1
        assert all(abs(ran[x] - Fraction(q * slot, 64)) < 1 for x, q in by.items())


def test_query(spark, sf):
    given = {r.doc_id: r.source for r in table(spark, sf, "documents").collect()}
    rows = mixing.op7_mixing(spark, sf).collect()
    assert {r.doc_id: r.source for r in rows} == given and len(rows) == len(given)
    assert all(r.release <= r.slot < r.deadline for r in rows)
    quota = {r.source: r.quota for r in rows}
    cycle = {(s, nth): slot for s, nth, slot in brute_cycle(quota, mixing.CYCLE)}
    blocks = defaultdict(list)
    for r in rows:
        assert r.slot == r.block // r.quota * mixing.CYCLE + cycle[r.source, r.block % r.quota]
        blocks[r.source, r.block].append(r.place)
    for (s, b), places in blocks.items():
        assert sorted(places) == list(range(len(places)))
        assert len(places) == mixing.BLOCK or (s, b + 1) not in blocks


def test_order_does_not_depend_on_ranges(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    one = {r.doc_id: r.mix_rank for r in mixing.ranked(docs, bits=1).collect()}
    many = {r.doc_id: r.mix_rank for r in mixing.ranked(docs, bits=12).collect()}
    assert one == many


def test_given_targets_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(i, "x", None if i % 5 == 0 else f"s{i % 3}", i) for i in range(60)] + [(None, None, "s1", 0), (7, "x", "s1", 7), (7, "x", "s1", 7)], "doc_id long, text string, source string, slot long")
    targets = spark.createDataFrame([("", 1.0), ("s0", 2.0), ("s1", 1.0)], "mix_source string, weight double")
    mixed = mixing.mix(docs, targets, cycle=8, block=2)
    assert mixed.count() == 63
    assert mixed.filter(F.col("mix_slot").isNull()).select("source").distinct().collect()[0].source == "s2"
    assert {(r.mix_source, r.mix_quota) for r in mixed.filter("mix_slot is not null").collect()} == {("", 1), ("s0", 2), ("s1", 1)}
    ordered = mixing.in_mixed_order(docs, targets, cycle=8, block=2)
    assert ordered.columns == docs.columns and ordered.count() == 63
    assert sorted(map(str, ordered.collect())) == sorted(map(str, docs.collect()))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs, cycle=3).filter("mix_slot is null").count() == 0


def test_whole_weights_are_exact_and_many_sources_fit(spark):
    docs = spark.createDataFrame([(i, f"s{i % 30:02}") for i in range(900)], "doc_id long, source string")
    targets = spark.createDataFrame([(f"s{i:02}", float(1 + i)) for i in range(30)], "mix_source string, weight double")
    rows = mixing.mix(docs, targets, cycle=64, block=1).collect()
    assert {r.mix_quota for r in rows} == set(range(1, 31)) and mixing.cycle_of(targets, 64) == 465
    slots = sorted((r.mix_slot, r.mix_source) for r in rows)
    done, last = Counter(), min(max(r.mix_slot for r in rows if r.mix_source == s) for s in {r.mix_source for r in rows})
    assert [s for s, _ in slots[: last + 1]] == list(range(last + 1))
    for slot, s in slots[: last + 1]:
        done[s] += 1
        assert all(abs(done[f"s{i:02}"] - Fraction((1 + i) * (slot + 1), 465)) < 1 for i in range(30))
    uneven = targets.withColumn("weight", F.col("weight") + 0.5)
    assert mixing.cycle_of(uneven, 16) == 64 and mixing.mix(docs, uneven, cycle=16).filter("mix_slot is null").count() == 0


def test_taken_names_stay(spark):
    docs = spark.createDataFrame([(i, "s", i, -i, "m", 2 * i, i) for i in range(40)], "doc_id long, source string, nth int, offset int, mix_source string, mix_slot int, id int")
    got = mixing.mix(docs)
    assert got.columns[:7] == docs.columns and {"mix_source_", "mix_slot_", "mix_rank"} <= set(got.columns)
    assert sorted(got.select(*docs.columns).collect()) == sorted(docs.collect())
    ordered = mixing.in_mixed_order(docs)
    assert ordered.columns == docs.columns and sorted(ordered.collect()) == sorted(docs.collect())
