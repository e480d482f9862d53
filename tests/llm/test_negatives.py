import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymart.llm import negatives
from tallymart.llm.common import Cut
from tallymart.llm.queries import ORACLE_SQL, QUERIES

NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every=50):
    """All pairs of (id, label, integer vector)."""
    wide = max((len(v) for _, _, v in rows), default=0)
    x = np.array([list(v) + [0] * (wide - len(v)) for _, _, v in rows], object).reshape(len(rows), wide)
    out = []
    for a, (anchor, label, _) in enumerate(rows):
        if anchor % every:
            continue
        scores = [sum(p * q for p, q in zip(x[a], y)) for y in x]
        order = sorted((b for b in range(len(rows)) if b != a), key=lambda b: (-scores[b], rows[b][0]))
        for p in [b for b in order if rows[b][1] == label][:5]:
            hits = [b for b in order if rows[b][1] != label and 50 * scores[p] <= 100 * scores[b] <= 95 * scores[p]][:3]
            out += [(anchor, rows[p][0], k, rows[b][0], scores[p], scores[b]) for k, b in enumerate(hits, 1)]
    return Counter(out)


def got(df):
    return Counter(tuple(r[c] for c in NAMES) for r in df.collect())


def test_query_against_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    want = c.execute(ORACLE_SQL["op12_hard_negatives"])
    names = [d[0] for d in want.description]
    rows = Counter(tuple(dict(zip(names, r))[k] for k in NAMES) for r in want.fetchall())
    assert got(QUERIES["op12_hard_negatives"](spark, sf)) == rows and len(rows) > 10


@pytest.mark.parametrize("block", [16, 100, 4096])
def test_clusters_and_copies(spark, block):
    """Clusters, one vector that a third of all rows hold, equal scores, zero and long vectors."""
    rng = np.random.default_rng(block)
    centres = rng.integers(-40, 41, (6, 8))
    rows = []
    for k in range(400):
        v = np.zeros(8, int) if k % 50 == 7 else centres[0] if k % 3 == 0 else centres[k % 6] + rng.integers(-6, 7, 8)
        rows.append((k % 350, int(rng.integers(0, 4)), [int(z) for z in v * (1 + k % 2)]))
    frame = spark.createDataFrame(rows, "id long, label long, vec array<int>").repartition(3)
    assert got(negatives.mine(frame, F.col("id") % 10 == 0, block=block)) == brute(rows, 10)


def test_nulls_repeats_odd_components_and_clashes(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [0.5, 0.25], 1), (0, [0.5, 0.25], 1), (50, [0.5], 1), (7, [0.4, 0.2], 0), (8, [0.4, 0.1], 2), (9, [0.3, 0.1], 1), (10, [0.3, None], 2), (11, [nan, 0.1], 2), (12, [inf, 0.1], 2), (13, None, 2), (14, [0.1], None), (None, [0.1, 0.2], 2), (15, [], 2), (16, [-0.5, -0.25], 1), (17, [900000.0, 1.0], 3), (18, [1e30, 1.0], 3)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, vec string, `a.b` int")
    sound = negatives.quantized(frame)
    held = [(r.id, r.label, r.vec) for r in sound.collect()]
    assert sorted(i for i, _, _ in held) == [0, 0, 7, 8, 9, 15, 16, 17, 50]
    assert got(negatives.mine(sound, F.col("id") % 50 == 0)) == brute(held)
    for none in ("false", "id = 0", "label = 77"):
        some = sound.filter(none)
        assert got(negatives.mine(some, F.col("id") % 50 == 0)) == brute([(r.id, r.label, r.vec) for r in some.collect()])
    assert negatives.mine(sound.filter("false"), F.col("id") == 0).columns == NAMES


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(k, k % 3, [int(z) for z in rng.integers(1 << 26, 1 << 28, 4)]) for k in range(60)]
    frame = spark.createDataFrame(rows, "id long, label long, vec array<int>")
    assert got(negatives.mine(frame, F.col("id") % 50 == 0)) == brute(rows)


def test_cover_tree_covers():
    rng = np.random.default_rng(3)
    x = np.unique(np.r_[rng.normal(size=(150, 3)), np.repeat(rng.normal(size=(4, 3)), 20, 0) + rng.normal(size=(80, 3)) * 1e-3], axis=0)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    t = negatives.cover_tree(unit)
    assert sorted(t["centre"][t["new"]]) == list(range(len(x)))

    def below(e):
        return {int(t["centre"][e])}.union(*(below(c) for c in range(t["first"][e], t["first"][e] + t["many"][e])))

    assert below(0) == set(range(len(x)))
    for e in range(len(t["centre"])):
        assert negatives.angles(unit[list(below(e))], unit[[t["centre"][e]]]).max() <= t["radius"][e] + 1e-7
        for c in range(t["first"][e], t["first"][e] + t["many"][e]):
            assert t["radius"][c] <= t["radius"][e] / 2 + 1e-7 or t["radius"][e] < 1e-5


def test_descent_skips_what_lies_outside():
    """On clustered vectors most nodes stay closed, and what is found is what all pairs give."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = np.rint((centres[rng.integers(0, 40, 4000)] + 0.05 * rng.normal(size=(4000, 16))) * 100).astype(int)
    x = np.unique(x, axis=0)
    largest = float(np.sqrt((x**2).sum(axis=1)).max())
    n = len(x)
    block = negatives.Block(np.arange(n), np.arange(n) % 10, np.arange(n), x, largest, negatives.cover_tree(negatives.on_sphere(x, largest)))
    q = x[:1]
    who, _, row, score = block.search(q, np.array([3]), np.array([[-(1 << 62)]]), np.array([[1 << 62]]), True, 5)
    want = sorted((q @ x.T)[0][np.arange(n) % 10 == 3])[-5:]
    assert sorted(score)[-5:] == want and (q @ x[row].T == score).all()
    assert block.opened < 0.4 * (block.tree["many"] > 0).sum()


def test_cut_tables_are_read_again(spark):
    rows = [(k, k % 2, [k, 1]) for k in range(20)]
    cut = Cut(spark, "negatives-test")
    assert got(negatives.mine(spark.createDataFrame(rows, "id long, label long, vec array<int>"), F.col("id") == 0, cut=cut)) == brute(rows)
