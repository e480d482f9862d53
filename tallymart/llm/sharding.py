"""Operator 5: balanced label propagation of documents over shards.

Law ``rows``: counts of shards differ by at most one. Documents with equal texts are linked; cut links are few because
linked documents move, round by round, to the shard that holds most of their neighbours, as far as quotas allow.

Documents of one text are alike, so the labels of a group are counts: (group, shard, n), at most as many rows as
shards for each group, however large it is. A round joins every part of a group with the group's other parts, proposes
to move it to the fullest one (of all, and in every other round of those whose shards have free places; ties by a hash
that changes with the round), sums the proposals for each pair of shards (at most shards squared numbers, which reach
the driver), grants free places and exchanges around rings of shards, and applies the grants by running sums, larger
gains first. Every move adds to the squared sizes of parts, so rounds end; they go on until nothing moves. Documents without a link fill what is left. A group that is larger than a shard fills one after the other.

Running sums and ranks are exact without gathering a shard or a group in one task: rows are dealt into ranges by the
top bits of a hash, ranges are summed first, and only the rows of a range are numbered together.

Defined results: a null text has no bytes and counts as the empty text; null ids are placed like others; rows that
repeat another are placed each; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Cut, table

#: Rounds are a guard only: propagation ends when IDLE rounds in a row have moved nothing.
SHARDS, ROUNDS, IDLE, BITS = 24, 1000, 6, 10
KEY = ["g", "text_crc32", "size"]


def running(rows: DataFrame, within: list[str], coarse: Column, order: list[Column], weight: Column, target: str) -> DataFrame:
    """Adds the sum of ``weight`` over the earlier rows of the same ``within``, in the order (coarse, *order).

    ``coarse`` cuts each ``within`` into ranges that are small enough for one task.
    """
    rows = rows.withColumns({"__coarse": coarse, "__w": weight})
    sums = rows.groupBy(*within, "__coarse").agg(F.sum("__w").alias("__sum"))
    earlier = Window.partitionBy(*within).orderBy("__coarse").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(F.col(c).alias(f"__{c}") for c in within), F.col("__coarse").alias("__at"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    local = Window.partitionBy(*within, "__coarse").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__here", F.coalesce(F.sum("__w").over(local), F.lit(0)))
    same = F.col("__coarse") == F.col("__at")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = rows.join(sums, same)
    return joined.withColumn(target, (F.col("__before") + F.col("__here")).cast("long")).drop("__coarse", "__w", "__here", "__at", "__before", *(f"__{c}" for c in within))


def quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def grant(demand: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """How many documents may move from shard s to t: into free places, those that moves leave behind included, and
    then around rings of shards, the shortest first."""
    left, free, given = dict(demand), list(free), dict.fromkeys(demand, 0)

    def move(edges: list[tuple[int, int]], n: int) -> None:
        for e in edges:
            given[e] += n
            left[e] -= n

    moved = True
    while moved:
        moved = False
        for s, t in sorted(left, key=lambda e: (-left[e], e)):
            n = min(left[s, t], free[t])
            if n > 0:
                move([(s, t)], n)
                free[t] -= n
                free[s] += n
                moved = True
    for length in range(2, len(free) + 1):
        for start in range(len(free)):
            while ring := _ring(left, start, length):
                move(ring, min(left[e] for e in ring))
    return {k: v for k, v in given.items() if v > 0}


def _ring(left: dict[tuple[int, int], int], start: int, most: int) -> list[tuple[int, int]]:
    """The shortest way along what is left from a shard back to it, of at most so many steps."""
    came, front = {}, [start]
    for _ in range(most):
        after = []
        for s, t in sorted(e for e, n in left.items() if n > 0 and e[0] in front):
            if t == start:
                ring = [(s, t)]
                while s != start:
                    ring.append((came[s], s))
                    s = came[s]
                return ring
            if t not in came:
                came[t] = s
                after.append(t)
        front = after
    return []


def propagate(parts: DataFrame, quota: list[int], cut: Cut, rounds: int = ROUNDS, bits: int = BITS) -> tuple[DataFrame, list[int]]:
    """Moves parts (key, shard, n) of groups until nothing moves; returns them and the load of each shard."""

    def loads(p: DataFrame) -> list[int]:
        by = {r.shard: r.n for r in p.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        return [by.get(s, 0) for s in range(len(quota))]

    parts = cut(parts)
    load = loads(parts)
    idle = 0
    for k in range(rounds):
        free = [max(q - n, 0) for q, n in zip(quota, load)]
        if not sum(load) or idle == IDLE:
            break
        # All parts of a group side by side (one for each shard at most), the fullest first.
        tie = F.xxhash64(*KEY, "shard", F.lit(k))
        whole = parts.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), tie.alias("tie"), "shard"))).alias("all")).filter(F.size("all") > 1)
        # One part of a group takes in the smaller ones, and stays itself.
        is_open = F.array(*(F.lit(f > 0 or k % 2 == 0) for f in free))
        head = F.get(F.filter("all", lambda x: is_open[x["shard"]]), F.lit(0))
        each = whole.withColumn("head", head).select(*KEY, "head", F.explode("all").alias("own")).filter("own > head")
        asks = each.select(*KEY, F.col("own.shard").alias("s"), F.col("head.shard").alias("t"), (-F.col("own.m")).alias("n"), (F.col("own.m") - F.col("head.m")).alias("gain"))
        demand = {(r.s, r.t): r.n for r in asks.groupBy("s", "t").agg(F.sum("n").alias("n")).collect()}
        given = grant(demand, free)
        idle = 0 if given else idle + 1
        if not given:
            continue
        table_ = F.create_map(*(x for (s, t), n in sorted(given.items()) for x in (F.lit(s * len(quota) + t), F.lit(n).cast("long"))))
        asks = asks.withColumn("most", F.coalesce(table_[F.col("s") * len(quota) + F.col("t")], F.lit(0).cast("long"))).filter("most > 0")
        h = F.xxhash64(*KEY)
        coarse = (63 - F.floor(F.log2(F.col("gain") + 1))).cast("long") * (1 << bits) + F.shiftrightunsigned(h, 64 - bits)
        asks = running(asks, ["s", "t"], coarse, [F.col("gain").desc(), h, *(F.col(k) for k in KEY)], F.col("n"), "before")
        moves = asks.withColumn("k", F.least("n", F.col("most") - F.col("before"))).filter("k > 0")
        leaves = moves.select(*KEY, F.col("s").alias("shard"), (-F.col("k")).alias("n"))
        comes = moves.select(*KEY, F.col("t").alias("shard"), F.col("k").alias("n"))
        after = cut(parts.unionByName(leaves).unionByName(comes).groupBy(*KEY, "shard").agg(F.sum("n").alias("n")).filter("n > 0"))
        cut.drop(parts)
        parts, load = after, loads(after)
    return parts, load


def balanced_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS, bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row."""
    cut = Cut(docs.sparkSession, "shards")
    t = F.coalesce(F.col(text), F.lit(""))
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("g")))
    quota = quotas(rows.count(), shards)

    first = rows.groupBy(*KEY, F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    linked = first.withColumn("all", F.sum("n").over(Window.partitionBy(*KEY))).filter("all > 1").drop("all")
    parts, load = propagate(linked, quota, cut, rounds, bits)
    load, parts = _within_quota(parts, load, quota, cut, bits)

    # Where each part begins in its shard and in its group; then one row for each group.
    h = F.xxhash64(*KEY)
    parts = running(parts, ["shard"], F.shiftrightunsigned(h, 64 - bits), [h, *(F.col(k) for k in KEY)], F.col("n"), "start")
    groups = parts.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("shard", "n", "start"))).alias("pieces"))
    rest = F.array(*(F.struct(F.lit(s).alias("shard"), F.lit(quota[s] - load[s]).cast("long").alias("n"), F.lit(load[s]).cast("long").alias("start")) for s in range(shards)))
    of = groups.select(*(F.col(k).alias(f"_{k}") for k in KEY), "pieces")
    placed = rows.join(of, (F.col("g") == F.col("_g")) & (F.col("text_crc32") == F.col("_text_crc32")) & (F.col("size") == F.col("_size")), "left")
    own = F.xxhash64("doc_id", "g", F.lit("slot"))
    placed = running(placed, ["_g", "_text_crc32", "_size"], F.shiftrightunsigned(own, 64 - bits), [own, F.col("doc_id")], F.lit(1), "rank")
    # The piece in whose range of ranks a row falls, and what the pieces before it hold.
    pieces = F.coalesce("pieces", rest)
    state = F.struct(F.col("rank").alias("left"), F.lit(-1).alias("shard"), F.lit(-1).cast("long").alias("slot"))

    def walk(s: Column, p: Column) -> Column:
        here = (s["shard"] < 0) & (s["left"] < p["n"])
        return F.struct((s["left"] - p["n"]).alias("left"), F.when(here, p["shard"]).otherwise(s["shard"]).alias("shard"), F.when(here, p["start"] + s["left"]).otherwise(s["slot"]).alias("slot"))

    return placed.withColumn("at", F.aggregate(pieces, state, walk)).select("doc_id", "size", "text_crc32", F.col("at.shard").alias("shard"), F.col("at.slot").alias("slot"))


def _within_quota(parts: DataFrame, load: list[int], quota: list[int], cut: Cut, bits: int) -> tuple[list[int], DataFrame]:
    """Takes what stands over a quota at the start (shards that linked documents alone overfill) to free places."""
    over = [max(n - q, 0) for n, q in zip(load, quota)]
    if not sum(over):
        return load, parts
    free = [max(q - n, 0) for n, q in zip(load, quota)]
    h = F.xxhash64(*KEY)
    ranked = running(parts, ["shard"], F.shiftrightunsigned(h, 64 - bits), [h, *(F.col(k) for k in KEY)], F.col("n"), "before")
    base, starts = 0, []
    for o in over:
        starts.append(base)
        base += o
    extra = F.array(*(F.lit(o).cast("long") for o in over))[F.col("shard")]
    first = F.array(*(F.lit(s).cast("long") for s in starts))[F.col("shard")]
    lo, hi = first + F.least("before", extra), first + F.least(F.col("before") + F.col("n"), extra)
    bounds, at = [], 0
    for s, f in enumerate(free):
        bounds.append(F.struct(F.lit(s).alias("shard"), F.lit(at).cast("long").alias("a"), F.lit(at + f).cast("long").alias("b")))
        at += f
    cutting = ranked.withColumns({"lo": lo, "hi": hi})
    stays = cutting.select(*KEY, "shard", (F.col("n") - (F.col("hi") - F.col("lo"))).alias("n"))
    goes = cutting.filter("hi > lo").select(*KEY, "lo", "hi", F.explode(F.array(*bounds)).alias("x")).select(*KEY, F.col("x.shard").alias("shard"), (F.least("hi", "x.b") - F.greatest("lo", "x.a")).alias("n"))
    new = cut(stays.unionByName(goes.filter("n > 0")).groupBy(*KEY, "shard").agg(F.sum("n").alias("n")).filter("n > 0"))
    by = {r.shard: r.n for r in new.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [by.get(s, 0) for s in range(len(quota))], new


def op5_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = balanced_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
