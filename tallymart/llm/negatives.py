"""Operator 12: mines hard negatives by cover trees over norm-augmented candidates.

A coordinate sqrt(M^2 - |x|^2) puts every candidate on a sphere of radius M (the largest norm) and leaves inner products
with queries as they are. If all vectors below a node lie within the angle r of its centre, their products with a query q
lie between |q| M cos(angle + r) and |q| M cos(angle - r). That is the bound of every search here.

1. Of equal vectors with one label only the rows of the smallest ids can be returned; the others leave before anything
   is gathered, so a vector may be held by any share of all rows.
2. The top of the tree: pivots far from each other, chosen in a bounded sample, and every candidate goes to the nearest
   one. Its radius is taken over all candidates. A pivot's candidates are cut into blocks of about ``BLOCK`` rows.
3. Below it each block has a cover tree of its own: an angle halves from level to level, a node covers what lies within
   it, and keeps the exact radius of what it covers.
4. Anchors meet the blocks twice, first for their positives, then for the negatives in the window of each positive. The
   second time, blocks whose pivot lies outside every window of an anchor are left out. In a block a best-first descent
   opens the nodes of the highest bounds, drops those outside an anchor's windows or below its best finds so far, and
   takes scores from exact integer products.
5. The best of all blocks are ranked together.

Sample and pivots decide how much is skipped, never what is found. An anchor visits every block in the worst case, as
a stated set of queries against all rows may; anchors stream through a block and are never gathered.

Defined results: rows take no part if id, label or vector is null, or a component is null, not finite or beyond 2^20 in
size (scores would leave 64 bits); shorter vectors count as filled up with zeros; repeated rows are rows of their own;
an anchor without positives or without negatives in a window has no rows there; an empty table gives none; columns
other than these three are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Cut, hashed_sample, one_blas_thread, quoted, table

POSITIVES, NEGATIVES = 5, 3
#: Candidates of a block, pivots, rows of the sample they are chosen in, anchors that descend together, and nodes that a
#: step of the descent opens. None of them changes a result.
BLOCK, PIVOTS, SAMPLE, TOGETHER, OPEN, ANCHORS = 4096, 256, 4096, 256, 128, 65536
BIGGEST = 1 << 20
LOWEST = np.iinfo(np.int64).min

ORACLE_SQL = {
    "op12_hard_negatives": """WITH v AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
        FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.uid AS au, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v AS a JOIN v AS b ON a.uid <> b.uid WHERE a.vec_id % 50 = 0),
    p AS (SELECT *, row_number() OVER (PARTITION BY au ORDER BY score DESC, vec_id) AS pr FROM s WHERE same QUALIFY pr <= 5),
    n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.au, p.pr ORDER BY s.score DESC, s.vec_id) AS rk
        FROM p JOIN s ON p.au = s.au WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rk <= 3)
    SELECT anchor_id, positive_id, CAST(rk AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n""",
}


def quantized(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: Column | None = None, step: int = 256) -> DataFrame:
    """(id, label, vec): the rows that take part, components as floor(step * x)."""
    held = embeddings.select(quoted(vec_id).cast("bigint").alias("id"), (quoted("label") if label is None else label).cast("bigint").alias("label"), quoted(vector).alias("vec"))
    sound = held.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < BIGGEST)))
    return sound.select("id", "label", F.transform("vec", lambda x: F.floor(x.cast("double") * step).cast("int")).alias("vec"))


# ---------------------------------------------------------------- trees


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    size = column.value_lengths().to_numpy()
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy()
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where these hold them, else in 64-bit numbers."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if most < 2**53 else a @ b.T


def on_sphere(x: np.ndarray, largest: float) -> np.ndarray:
    """Unit vectors of the candidates with the added coordinate."""
    return np.c_[x, np.sqrt(np.maximum(largest**2 - (x.astype(float) ** 2).sum(axis=1), 0))] / largest


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def cover_tree(unit: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes of a cover tree in the order of their levels: centre (a row), radius (largest angle to what lies below),
    first child, number of children, and whether the centre is met here for the first time."""
    centre, radius, first, many, new = [0], [0.0], [0], [0], [True]
    rest = np.arange(1, len(unit))
    waiting = [(0, rest, angles(unit[rest], unit[:1])[:, 0])]
    for node, rows, away in waiting:  # grows on the way
        if not len(rows):
            continue
        radius[node] = float(away.max())
        scale, at = radius[node] / 2, len(centre)
        far = away > scale
        children = [(centre[node], rows[~far], away[~far], False)] if not far.all() else []
        rows = rows[far]
        while len(rows):
            gap = angles(unit[rows[1:]], unit[rows[:1]])[:, 0]
            near = gap <= scale
            children.append((rows[0], rows[1:][near], gap[near], True))
            rows = rows[1:][~near]
        if scale < 1e-6:  # nothing to tell apart any more
            children = [(r, np.zeros(0, int), np.zeros(0), True) for r in np.r_[[c[0] for c in children if c[3]], *(c[1] for c in children)].astype(int)]
        first[node], many[node] = at, len(children)
        for c, below, gap, fresh in children:
            waiting.append((len(centre), below, gap))
            for values, value in ((centre, int(c)), (radius, 0.0), (first, 0), (many, 0), (new, fresh)):
                values.append(value)
    return {"centre": np.array(centre, np.int32), "radius": np.array(radius), "first": np.array(first, np.int32), "many": np.array(many, np.int32), "new": np.array(new)}


def bounds(score: np.ndarray, length: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest product of queries of (length = |q| M) with what lies within radii of centres of known scores."""
    cos = np.clip(score / length[:, None], -1, 1)
    sin = np.sqrt(1 - cos * cos)
    slack = 1e-6 * length[:, None] + 1e-3
    up = np.where(cos >= np.cos(radius), 1, cos * np.cos(radius) + sin * np.sin(radius)) * length[:, None] + slack
    down = np.where(-cos >= np.cos(radius), -1, cos * np.cos(radius) - sin * np.sin(radius)) * length[:, None] - slack
    return down, up


class Block:
    """Candidates of a block with their tree."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, of: np.ndarray, vectors: np.ndarray, largest: float, tree: dict[str, np.ndarray]):
        order = np.argsort(of, kind="stable")
        self.ids, self.labels, self.of = ids[order], labels[order], of[order]
        self.start = np.searchsorted(self.of, np.arange(len(vectors) + 1))
        self.vectors, self.largest, self.tree = vectors, largest, tree
        self.opened = 0

    def search(self, q: np.ndarray, label: np.ndarray, lo: np.ndarray, hi: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, ...]:
        """(query, window, row, score): for every query and window [lo, hi] the k best rows of its label (``same``) or of
        other labels, more where scores are equal. Windows with lo > hi are empty."""
        t = self.tree
        n, windows = lo.shape
        length = np.maximum(np.sqrt((q.astype(float) ** 2).sum(axis=1)) * self.largest, 1e-9)
        floor = np.where(lo > hi, np.iinfo(np.int64).max, lo)  # what a score must reach
        best = np.full((n, windows, k), LOWEST)
        found: list[tuple[np.ndarray, ...]] = []
        nodes, score = np.zeros(1, int), products(q, self.vectors[:1])
        self._meet(nodes, score, label, floor, hi, same, best, found)
        down, up = bounds(score, length, t["radius"][nodes])
        while len(nodes):
            alive = np.zeros(up.shape, bool)
            for w in range(windows):
                alive |= (up >= np.maximum(floor[:, w], best[:, w, 0])[:, None]) & (down <= hi[:, w : w + 1])
            some = alive.any(axis=0) & (t["many"][nodes] > 0)
            nodes, score, down, up, alive = nodes[some], score[:, some], down[:, some], up[:, some], alive[:, some]
            if not len(nodes):
                break
            first = np.argsort(-np.where(alive, up, -np.inf).max(axis=0), kind="stable")
            now, later = first[:OPEN], first[OPEN:]
            self.opened += len(now)
            children = np.concatenate([np.arange(t["first"][e], t["first"][e] + t["many"][e]) for e in nodes[now]])
            parent = np.repeat(now, t["many"][nodes[now]])
            fresh = t["new"][children]
            met = score[:, parent].copy()  # a node's first child may be its own centre
            met[:, fresh] = products(q, self.vectors[t["centre"][children[fresh]]])
            self._meet(children[fresh], met[:, fresh], label, floor, hi, same, best, found)
            lower, upper = bounds(met, length, t["radius"][children])
            nodes, score, down, up = np.r_[nodes[later], children], np.c_[score[:, later], met], np.c_[down[:, later], lower], np.c_[up[:, later], upper]
        who, window, row, value = (np.concatenate(x) if found else np.zeros(0, int) for x in (zip(*found) if found else [()] * 4))
        keep = value >= best[who, window, 0]
        return who[keep], window[keep], row[keep], value[keep]

    def _meet(self, nodes: np.ndarray, score: np.ndarray, label: np.ndarray, floor: np.ndarray, hi: np.ndarray, same: bool, best: np.ndarray, found: list) -> None:
        """Takes the rows of the nodes' centres into account."""
        centre = self.tree["centre"][nodes]
        sizes = self.start[centre + 1] - self.start[centre]
        rows = np.repeat(self.start[centre] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        value = np.repeat(score, sizes, axis=1)
        fits = (self.labels[rows] == label[:, None]) == same
        for w in range(floor.shape[1]):
            ok = fits & (value >= np.maximum(floor[:, w], best[:, w, 0])[:, None]) & (value <= hi[:, w : w + 1])
            who, at = np.nonzero(ok)
            if not len(who):
                continue
            found.append((who, np.full(len(who), w), rows[at], value[who, at]))
            k = best.shape[2]
            both = np.c_[best[:, w], np.where(ok, value, LOWEST)]
            best[:, w] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            best[:, w].sort(axis=1)


# ---------------------------------------------------------------- the top of the tree, and blocks


def choose_pivots(sample: np.ndarray, largest: float, k: int) -> np.ndarray:
    """Rows of the sample, each the farthest from those before it."""
    unit = on_sphere(sample, largest)
    chosen = [0]
    gap = angles(unit, unit[:1])[:, 0]
    while len(chosen) < min(k, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, angles(unit, unit[chosen[-1:]])[:, 0])
    return sample[chosen]


class Index:
    """Blocks of candidates as a table (block, cell, ids, labels, of, vectors, tree as bytes) and the cells above them.

    cells: {cell: (pivot, radius, first block, blocks)}, at most PIVOTS of them.
    """

    def __init__(self, candidates: DataFrame, most: int, cut: Cut, block: int = BLOCK):
        spark = candidates.sparkSession
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        squares = F.aggregate("vec", F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint") * x.cast("bigint"))
        alike = Window.partitionBy("vec", "label").orderBy("id")
        kept = cut(candidates.withColumn("nth", F.row_number().over(alike)).filter(F.col("nth") <= most).drop("nth"))
        n, self.width, square = kept.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.max(squares)).first()
        self.n, self.width, self.largest = n, max(self.width or 0, 1), max(float(square or 0) ** 0.5, 1.0)
        self.cells: dict[int, tuple] = {}
        self.blocks, self.block_count = None, 0
        if not n:
            return
        rows = hashed_sample(kept, "id", "pivots", SAMPLE).select("vec").limit(2 * SAMPLE).toArrow()
        if not rows.num_rows:  # a sample may be empty
            rows = kept.select("vec").limit(1).toArrow()
        sample = matrix(rows.column(0).combine_chunks(), self.width)
        pivots = choose_pivots(sample, self.largest, min(PIVOTS, -(-n // block)))
        largest, wide = self.largest, self.width
        unit = on_sphere(pivots, largest)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one_blas_thread()
            for batch in batches:
                away = angles(on_sphere(matrix(batch.column(2), wide), largest), unit)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(away.argmin(axis=1).astype(np.int32)), pa.array(away.min(axis=1))], names=["id", "label", "vec", "cell", "away"])

        placed = cut(kept.mapInArrow(place, "id bigint, label bigint, vec array<int>, cell int, away double"))
        for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).orderBy("cell").collect():
            blocks = -(-r.n // block)
            self.cells[r.cell] = pivots[r.cell], r.radius, self.block_count, blocks
            self.block_count += blocks
        at = spark.createDataFrame([(c, x[2], x[3]) for c, x in self.cells.items()], "cell int, first bigint, blocks bigint")
        number = F.col("first") + F.pmod(F.xxhash64("id", "vec"), F.col("blocks"))
        dealt = placed.join(F.broadcast(at), "cell").select(number.alias("block"), "id", "label", "vec").repartition(width, "block").sortWithinPartitions("block", "id")

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one_blas_thread()

            def finish(rows: pa.Table) -> pa.RecordBatch:
                vectors, of = np.unique(matrix(rows.column("vec").combine_chunks(), wide), axis=0, return_inverse=True)
                tree = cover_tree(on_sphere(vectors, largest))
                parts = {"ids": rows.column("id").to_numpy(), "labels": rows.column("label").to_numpy(), "of": of.ravel().astype(np.int32), "vectors": vectors.astype(np.int32), **tree}
                return pa.record_batch({"block": pa.array([rows.column("block")[0].as_py()], pa.int64()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in parts.items()}})

            held: pa.Table | None = None
            for batch in batches:
                rows = pa.Table.from_batches([batch])
                rows = rows if held is None else pa.concat_tables([held, rows])
                number = rows.column("block").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(number)) + 1), len(number)]
                for a, b in zip(cuts[:-2], cuts[1:-1]):
                    yield finish(rows.slice(a, b - a))
                held = rows.slice(cuts[-2])
            if held is not None and held.num_rows:
                yield finish(held)

        self.blocks = cut(dealt.mapInArrow(build, "block bigint, " + ", ".join(f"{c} binary" for c in COLUMNS)))

    def search(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """(uid, nth, id, score, own) for anchors (uid, id, label, vec, lo, hi): what each block finds for each window,
        the k best and those equal to the last. ``own``: a row that is all that the anchor's row is."""
        spark = anchors.sparkSession
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        cells, largest, wide = self.cells, self.largest, self.width
        pivots, radius = np.array([c[0] for c in cells.values()]), np.array([c[1] for c in cells.values()])
        spans = [np.arange(c[2], c[2] + c[3]) for c in cells.values()]
        chunks = max(1, -(-anchors.count() // ANCHORS))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one_blas_thread()
            for batch in batches:
                q = matrix(batch.column(3), wide)
                lo, hi = _windows(batch)
                length = np.maximum(np.sqrt((q.astype(float) ** 2).sum(axis=1)) * largest, 1e-9)
                down, up = bounds(products(q, pivots), length, radius)
                meets = ((up[:, :, None] >= lo[:, None]) & (down[:, :, None] <= hi[:, None]) & (lo <= hi)[:, None]).any(axis=2)
                to = [np.concatenate([spans[c] for c in np.flatnonzero(row)]) if row.any() else np.zeros(0, int) for row in meets]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to, pa.list_(pa.int64()))], names=[*batch.schema.names, "to"])

        fields = "uid bigint, id bigint, label bigint, vec array<int>, lo array<bigint>, hi array<bigint>"
        routed = anchors.select("uid", "id", "label", "vec", "lo", "hi").mapInArrow(route, f"{fields}, to array<bigint>")
        asking = routed.select(F.explode("to").alias("block"), F.pmod("uid", F.lit(chunks)).alias("chunk"), F.lit(1).alias("kind"), "uid", "id", "label", "vec", "lo", "hi", *(F.lit(None).cast("binary").alias(c) for c in COLUMNS))
        none = [F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in fields.split(", "))]
        trees = self.blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint")))).select("block", "chunk", F.lit(0).alias("kind"), *none, *COLUMNS)
        met = trees.unionByName(asking).repartition(width, "block", "chunk").sortWithinPartitions("block", "chunk", "kind")

        def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one_blas_thread()
            block = None
            for whole in batches:
                kind, number, chunk = (whole.column(c).to_numpy() for c in ("kind", "block", "chunk"))
                cuts = np.flatnonzero((np.diff(kind) != 0) | (np.diff(number) != 0) | (np.diff(chunk) != 0)) + 1
                for a, b in zip([0, *cuts], [*cuts, whole.num_rows]):
                    if a == b:
                        continue
                    if kind[a] == 0:
                        block = _load(whole.slice(b - 1, 1), wide, largest)
                        continue
                    for at in range(a, b, TOGETHER):
                        rows = whole.slice(at, min(TOGETHER, b - at))
                        q, label, ids = matrix(rows.column("vec"), wide), rows.column("label").to_numpy(), rows.column("id").to_numpy()
                        who, window, row, score = block.search(q, label, *_windows(rows), same, k)
                        own = same & (block.ids[row] == ids[who]) & (block.labels[row] == label[who]) & (block.vectors[block.of[row]] == q[who]).all(axis=1)
                        yield pa.record_batch({"uid": rows.column("uid").take(pa.array(who)), "nth": pa.array(window.astype(np.int32)), "id": pa.array(block.ids[row]), "score": pa.array(score), "own": pa.array(own)})

        return met.mapInArrow(descend, "uid bigint, nth int, id bigint, score bigint, own boolean")


COLUMNS = ["ids", "labels", "of", "vectors", "centre", "radius", "first", "many", "new"]
KINDS = dict(zip(COLUMNS, (np.int64, np.int64, np.int32, np.int32, np.int32, float, np.int32, np.int32, bool)))


def _windows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """lo and hi of each row; rows with fewer windows than others get empty ones."""
    size = batch.column("lo").value_lengths().to_numpy()
    shape = len(size), int(size.max(initial=1))
    there = np.arange(shape[1]) < size[:, None]
    out = np.ones(shape, np.int64), np.zeros(shape, np.int64)
    for x, c in zip(out, ("lo", "hi")):
        x[there] = batch.column(c).flatten().to_numpy()
    return out


def _load(row: pa.RecordBatch, wide: int, largest: float) -> Block:
    x = {c: np.frombuffer(row.column(c)[0].as_py(), KINDS[c]) for c in COLUMNS}
    return Block(x["ids"], x["labels"], x["of"], x["vectors"].reshape(-1, wide).astype(np.int64), largest, {c: x[c] for c in ("centre", "radius", "first", "many", "new")})


# ---------------------------------------------------------------- mining


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = 50, most: int = 95, block: int = BLOCK, cut: Cut | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over rows (id, label, vec).

    The positives of an anchor are its best rows of the same label; the negatives of a positive are the best rows of
    other labels with least * positive_score <= 100 * score <= most * positive_score.
    """
    cut = cut or Cut(vectors.sparkSession, "negatives")
    index = Index(vectors, positives + 1, cut, block)
    asking = cut(vectors.filter(is_anchor).withColumn("uid", F.monotonically_increasing_id()))
    if not index.n:
        return asking.select(F.col("id").alias("anchor_id"), F.col("id").alias("positive_id"), F.lit(1).alias("rank"), F.col("id").alias("negative_id"), F.col("id").alias("positive_score"), F.col("id").alias("negative_score")).filter(F.lit(False))
    everything = asking.withColumns({"lo": F.array(F.lit(-(1 << 62)).cast("bigint")), "hi": F.array(F.lit(1 << 62).cast("bigint"))})
    first = Window.partitionBy("uid", "own").orderBy(F.desc("score"), "id")
    ranked = Window.partitionBy("uid").orderBy(F.desc("score"), "id")
    others = index.search(everything, True, positives + 1).withColumn("nth_own", F.row_number().over(first)).filter("NOT own OR nth_own > 1")
    best = cut(others.withColumn("nth", (F.row_number().over(ranked) - 1).cast("int")).filter(F.col("nth") < positives).select("uid", "nth", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    exact = F.col("positive_score").cast("decimal(20,0)")
    window = F.struct("nth", F.ceil(exact * least / 100).cast("bigint").alias("lo"), F.floor(exact * most / 100).cast("bigint").alias("hi"))
    per_anchor = best.groupBy("uid").agg(F.array_sort(F.collect_list(window)).alias("w"))  # at most ``positives`` rows
    narrowed = asking.join(per_anchor, "uid").select("uid", "id", "label", "vec", F.transform("w", lambda x: x["lo"]).alias("lo"), F.transform("w", lambda x: x["hi"]).alias("hi"))
    hard = Window.partitionBy("uid", "nth").orderBy(F.desc("score"), "id")
    found = index.search(cut(narrowed), False, negatives).withColumn("rank", F.row_number().over(hard)).filter(F.col("rank") <= negatives)
    named = found.select("uid", "nth", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(best, ["uid", "nth"])
    return named.join(asking.select("uid", F.col("id").alias("anchor_id")), "uid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.col("label").cast("bigint")
    label = F.when(F.col("vec_id") % 7 == 0, (given + 1) % 10).otherwise(given)
    return mine(quantized(table(spark, sf_dir, "embeddings"), label=label), F.col("id") % 50 == 0)
