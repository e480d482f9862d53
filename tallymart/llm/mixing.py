"""Operator 7: mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Documents of a source are dealt into blocks in a hashed order. A source of weight w has a release time floor(i / w)
and a deadline ceil((i + 1) / w) for its block i; earliest deadline first among the released blocks fills one slot
after the other and, as the weights sum to one, keeps each source less than one block from its ideal share at every
slot. The schedule repeats after a cycle of slots: it is worked out once for one cycle, in a table of that many rows
whatever the size of the input, and joined to all blocks.

Whole weights whose sum is at most ``EXACT`` are kept as they are, their sum being the cycle: no deviation from the
targets ever adds up. Other weights are rounded to multiples of 1 / ``cycle``, at least one each; the bound of one block
then holds for the rounded weights, and each of these is less than one block a cycle from its target (sources that had
to be raised to one take what they need from the larger ones in proportion). With more than ``cycle`` / 2 sources the
cycle grows to twice their number, so none is refused.

Every document comes out once. A source that has run out leaves its later slots empty; the others keep their windows,
so within the slots each block holds the bound, and up to the first slot of an exhausted source the order of the rows
does too.

Ranks within a source are exact without gathering it: the top bits of the hash deal a source into ranges, ranges are
counted first, and only rows of one range are numbered together. A source with a third of all rows is so split into
``2 ** bits`` pieces. The order does not depend on ``bits``.

Defined results: a null source is a queue of its own under the empty name; null ids and texts are rows like others;
rows that repeat another take places next to each other; ties of deadlines go by source name; an empty table gives no
rows; the columns of the input pass through unchanged, whatever their names, and a new column whose name is taken comes
under the first free one of name_, name__ and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import beside, free_name, quoted, table

CYCLE, BLOCK, BITS, TEMPER = 2048, 16, 10, 0.5
#: The largest sum of whole weights that makes a cycle of its own.
EXACT = 8192


def tempered_targets(counts: DataFrame, temper: float = TEMPER) -> DataFrame:
    """Target weights in proportion to rows ** temper: (mix_source, weight) from (mix_source, n)."""
    return counts.select("mix_source", F.round(F.pow(F.col("n").cast("double"), F.lit(temper)), 6).alias("weight"))


def quotas(targets: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """(mix_source, quota): blocks of each source in a cycle, at least one, by largest remainders; ties by name.

    ``cycle`` is the sum of the weights (which are then the quotas) or at least the number of sources.
    """
    every = Window.partitionBy()  # one row for each source
    n, total = F.count(F.lit(1)).over(every), F.sum("weight").over(every)
    ideal = F.round(F.col("weight") / total * (F.lit(cycle) - n), 9)
    floors = targets.filter("weight > 0").select("mix_source", "weight", ideal.alias("ideal"), F.floor(ideal).alias("whole"), n.alias("n"), total.alias("total"), F.every(F.col("weight") == F.floor("weight")).over(every).alias("exact"))
    left = F.lit(cycle) - F.col("n") - F.sum("whole").over(every)
    rank = F.row_number().over(Window.partitionBy().orderBy((F.col("ideal") - F.col("whole")).desc(), "mix_source"))
    given = F.col("exact") & (F.col("total") == cycle)
    return floors.select("mix_source", F.when(given, F.col("weight").cast("long")).otherwise(F.col("whole") + 1 + (rank <= left).cast("long")).alias("quota"))


def cycle_of(targets: DataFrame, cycle: int = CYCLE) -> int:
    """Slots of a cycle: one number of sources and one sum reach the driver."""
    w = F.col("weight")
    r = targets.filter(w > 0).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("total"), F.every(w == F.floor(w)).alias("exact")).first()
    if r.exact and r.total <= EXACT:
        return int(r.total)
    while cycle < 2 * r.n:
        cycle *= 2
    return cycle


def ceil_div(a: Column, b: Column) -> Column:
    return F.floor((a + b - 1) / b).cast("long")


def one_cycle(quota: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """(mix_source, quota, nth, offset): the slot of each source's nth block in a cycle, earliest deadline first.

    All quotas are gathered into one row (at most ``cycle`` of them) and folded over the slots of the cycle.
    """
    row = quota.agg(F.sort_array(F.collect_list(F.struct("mix_source", "quota"))).alias("s"))

    def step(state: Column, slot: Column) -> Column:
        def bid(done: Column, k: Column) -> Column:
            q = F.element_at("s", k.cast("int") + 1)["quota"]
            released = F.floor(done * cycle / q) <= slot
            return F.when(released & (done < q), F.struct(ceil_div((done + 1) * cycle, q).alias("deadline"), k.cast("int").alias("k")))

        best = F.array_min(F.filter(F.transform(state["done"], bid), lambda x: x.isNotNull()))["k"]
        return F.struct(
            F.transform(state["done"], lambda done, k: done + (k == best).cast("long")).alias("done"),
            F.concat(state["out"], F.array(best)).alias("out"),
        )

    start = F.struct(F.transform("s", lambda x: F.lit(0).cast("long")).alias("done"), F.array().cast("array<int>").alias("out"))
    slots = F.sequence(F.lit(0).cast("long"), F.lit(cycle - 1).cast("long"))
    folded = row.filter(F.size("s") > 0).select("s", F.aggregate(slots, start, step)["out"].alias("out"))
    each = folded.select("s", F.posexplode("out").alias("offset", "k")).select(F.element_at("s", F.col("k") + 1).alias("x"), F.col("offset").cast("long").alias("offset"))
    nth = F.row_number().over(Window.partitionBy("x.mix_source").orderBy("offset")) - 1
    return each.select("x.mix_source", "x.quota", nth.cast("long").alias("nth"), "offset")


def ranked(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", bits: int = BITS) -> DataFrame:
    """Adds mix_source and mix_rank: the row's place in its source in hashed order, from 0."""
    h = F.xxhash64(F.col(doc_id), F.coalesce(F.col(source), F.lit("")), F.lit("mix"))
    # Shifting the sign bit makes unsigned order of the hash signed order.
    keyed = docs.withColumns({"mix_source": F.coalesce(F.col(source), F.lit("")), "mix_hash": h, "mix_range": F.shiftrightunsigned(h, 64 - bits)})
    counts = keyed.groupBy("mix_source", "mix_range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("mix_source").orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("mix_source", "mix_range", F.coalesce(before, F.lit(0)).alias("mix_before"))
    within = Window.partitionBy("mix_source", "mix_range").orderBy(F.col("mix_hash").bitwiseXOR(F.lit(-(1 << 63))), doc_id)
    numbered = keyed.withColumn("mix_row", F.row_number().over(within))
    return numbered.join(offsets, ["mix_source", "mix_range"]).withColumn("mix_rank", F.col("mix_before") + F.col("mix_row") - 1).drop("mix_range", "mix_hash", "mix_row", "mix_before")


def mix(docs: DataFrame, targets: DataFrame | None = None, doc_id: str = "doc_id", source: str = "source", cycle: int = CYCLE, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """Adds mix_source, mix_rank, mix_block, mix_place, mix_quota, mix_release, mix_deadline and mix_slot.

    ``targets``: (mix_source, weight), of the caller; without it weights are tempered row counts. Sources without a
    positive target get none of the slots and come last (slot null). Order rows by mix_slot, mix_place.
    """
    return beside(docs, {"id": doc_id, "from": source}, lambda d: _mix(d, targets, cycle, block, bits))


def _mix(docs: DataFrame, targets: DataFrame | None, cycle: int, block: int, bits: int) -> DataFrame:
    rows = ranked(docs, "id", "from", bits)
    if targets is None:
        targets = tempered_targets(docs.groupBy(F.coalesce("from", F.lit("")).alias("mix_source")).agg(F.count(F.lit(1)).alias("n")))
    cycle = cycle_of(targets, cycle)
    plan = one_cycle(quotas(targets, cycle), cycle).withColumnRenamed("quota", "mix_quota")
    size = plan.groupBy("mix_source").agg(F.first("mix_quota").alias("mix_quota"))
    at = F.col("mix_block")
    rows = rows.withColumns({"mix_block": F.floor(F.col("mix_rank") / block).cast("long"), "mix_place": F.col("mix_rank") % block})
    # Both tables have at most ``cycle`` rows, whatever the input.
    rows = rows.join(F.broadcast(size), "mix_source", "left").withColumn("nth", at % F.col("mix_quota"))
    rows = rows.join(F.broadcast(plan.drop("mix_quota")), ["mix_source", "nth"], "left")
    start = F.floor(at / F.col("mix_quota")).cast("long") * cycle
    return rows.withColumns(
        {
            "mix_release": F.floor(at * cycle / F.col("mix_quota")).cast("long"),
            "mix_deadline": ceil_div((at + 1) * cycle, F.col("mix_quota")),
            "mix_slot": start + F.col("offset"),
        }
    ).drop("nth", "offset")


def in_mixed_order(docs: DataFrame, targets: DataFrame | None = None, **more) -> DataFrame:
    """All rows of ``docs``, its columns only, in the mixed order (which Parquet files keep)."""
    at = {c: free_name(docs, c) for c in ("mix_slot", "mix_source", "mix_place")}
    mixed = mix(docs, targets, **more)
    return mixed.orderBy(F.col(at["mix_slot"]).asc_nulls_last(), at["mix_source"], at["mix_place"]).select(*map(quoted, docs.columns))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return rows.select(
        "doc_id",
        F.col("mix_source").alias("source"),
        F.col("mix_block").alias("block"),
        F.col("mix_place").alias("place"),
        F.col("mix_quota").alias("quota"),
        F.col("mix_release").alias("release"),
        F.col("mix_deadline").alias("deadline"),
        F.col("mix_slot").alias("slot"),
    )
