"""Operator 11: packs token sequences by bulk-synchronous best fit.

Each document becomes the ids of its text and one end id. Documents longer than a sequence are cut into full pieces and
a rest; full pieces fill a sequence of their own, all other pieces share. Rounds place them until none is left:

1. The sizes of pieces and the rooms of gaps are counted (at most ``limit`` different numbers each). As many new gaps
   are opened as any solution must add to those there are: what is left over, divided by a sequence, or the pieces of
   over half a sequence. No gap is opened while open ones have room for everything.
2. A gap shows itself once for every largest piece it can hold, at least once. Pieces and these openings are sorted
   together by size over ranges of rows. Within a range a sweep joins each opening to the largest free piece below it,
   which is best fit with the largest piece first; what it can't join it ranks.
3. Ranges exchange only how many pieces and openings they have left. From these counts the conflicts are resolved by
   rank: runs of ranked pieces meet runs of ranked openings of a later range, and one join brings them together.
4. Gaps shrink by what they got; gaps smaller than every piece left are closed.

Rows that are alike differ in their number only, so one size may hold any share of all rows: ranges are cut by size and
number. Every table between rounds is written to the shared folder.

Defined results: null and empty texts are the end id alone; a null id is kept; repeated rows are packed each; an empty
table gives no rows; columns other than id and text are not read, whatever their names. Strings of special tokens in a
text are ordinary text.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Cut, quoted, table

LIMIT, END = 4096, 1
#: Entries of the memo in one worker; a full memo starts anew, which costs time but changes no result.
MAX_CHUNKS, MAX_CHUNK_BYTES = 600_000, 64
#: Rows that a range of a sweep should have, and those it may have at most.
RANGE_ROWS, MOST_ROWS = 20_000, 1_000_000
#: Printable ASCII without a space, and Latin letters up to U+00FF: they have no other normal form.
PLAIN = re.compile(rb"(?:[!-~]|\xc3[\x80-\xbf])+").fullmatch


class Memo(dict):
    """bytes -> bytes; the older half goes when it is full."""

    def __init__(self, work):
        super().__init__()
        self.work, self.older = work, {}

    def __missing__(self, key: bytes) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.work(key)
        if len(key) <= MAX_CHUNK_BYTES:
            if len(self) >= MAX_CHUNKS:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class WordTokenizer:
    """Ids of texts by a tokenizer file that lower-cases and drops white space, as 4 bytes each.

    No token spans white space, so the stretches between are encoded on their own, each once while the memo holds it.
    Stretches of ASCII and Latin letters are cut into words here, all others by the library's own steps; the library
    merges what the memo does not have.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one task
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.normal, self.words, self.merge = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str, whole.model.tokenize
        self.id = [np.array([k], "<u4").tobytes() for k in range(whole.get_vocab_size())]
        self.sign = {ord(c): self.words(c)[0][0] for c in map(chr, range(0xC0, 0x100))}  # how the vocabulary writes its bytes
        self.plain_words = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+").findall  # fixed: the file's words, for PLAIN
        self.memo = Memo(self.chunk)

    def piece(self, word: str) -> bytes:
        return b"".join([self.id[x.id] for x in self.merge(word)])

    def chunk(self, raw: bytes) -> bytes:
        if not PLAIN(raw):
            return b"".join([self.piece(word) for word, _ in self.words(self.normal(raw.decode()))])
        text = raw.decode().lower()
        words = self.plain_words(text)
        if len(words) == 1:
            return self.piece(text if text.isascii() else text.translate(self.sign))
        return b"".join([self.memo[w.encode()] for w in words])

    def encode(self, text: str | None) -> bytes:
        raw = (text or "").encode("utf-8", "replace").lower()  # bytes: A-Z only, the rest is the normal form's
        return b"".join(map(self.memo.__getitem__, raw.split()))


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of each document; with ``keep_ids`` also their ids."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    held = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    kind = held.schema["doc_id"].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordTokenizer(path).encode
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                of, number, raw = [], [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    ids = encode(text) + last
                    cuts = [ids[a : a + 4 * limit] for a in range(0, len(ids), 4 * limit)]
                    of += [k] * len(cuts)
                    number += range(len(cuts))
                    raw += cuts
                out = {"doc_id": batch.column(0).take(pa.array(of, pa.int64())), "piece": pa.array(number, pa.int32())}
                out |= {"start": pa.array([limit * n for n in number], pa.int64()), "length": pa.array([len(r) // 4 for r in raw], pa.int64()), "ids_crc32": pa.array(map(zlib.crc32, raw), pa.int64())}
                if keep_ids:
                    out["ids"] = pa.array([np.frombuffer(r, "<u4").astype("<i4") for r in raw], pa.list_(pa.int32()))
                yield pa.record_batch(out)

    return held.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids)


def sweep(size: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, openings) by position: what best fit joins if the largest piece goes first and every opening takes one.

    Rows are in order of size, pieces (0) before openings (1) of one size. Pieces open brackets and openings close
    them: a pair of brackets that match is a piece and the smallest opening that no larger piece needs.
    """
    depth = np.cumsum(np.where(kind == 0, 1, -1))
    level = np.where(kind == 0, depth, depth + 1)
    order = np.argsort(level, kind="stable")
    a, b = order[:-1], order[1:]
    match = (level[a] == level[b]) & (kind[a] == 0) & (kind[b] == 1)
    return a[match], b[match]


def bridges(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Joins across ranges from (range, openings left, pieces left) in order: (range of the pieces, first and last rank,
    range of the openings, sum of the ranks that belong together). At most two rows a range."""
    stack: list[list[int]] = []
    out = []
    for at, openings, waiting in left:
        used = 0
        while used < openings and stack:
            part, ranks = stack[-1]
            n = min(openings - used, ranks)
            out.append((part, ranks - n, ranks - 1, at, used + ranks - 1))
            used += n
            stack[-1][1] -= n
            if not stack[-1][1]:
                stack.pop()
        if waiting:
            stack.append([at, waiting])
    return out


def _swept(elements: DataFrame, ranges: int) -> DataFrame:
    """(part, kind, rank, size, id, mate, mate_size): openings with the piece they got, and ranked rows left over."""
    schema = "part int, kind int, rank bigint, size int, id bigint, mate bigint, mate_size int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not rows:
            return
        part = TaskContext.get().partitionId()
        size, kind, ident = (np.concatenate([b.column(k).to_numpy() for b in rows]) for k in range(3))
        a, b = sweep(size, kind)
        free = np.ones(len(size), bool)
        free[a] = free[b] = False
        for k in (0, 1):
            at = np.flatnonzero(free & (kind == k))
            n = len(at)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(np.arange(n)), pa.array(size[at]), pa.array(ident[at]), none, none.cast(pa.int32())], names=schema.replace(",", "").split()[::2])
        n = len(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), pa.array(size[b]), pa.array(ident[b]), pa.array(ident[a]), pa.array(size[a])], names=schema.replace(",", "").split()[::2])

    dealt = elements.repartitionByRange(ranges, "size", "kind", "id").sortWithinPartitions("size", "kind", "id")
    return dealt.select("size", "kind", "id").mapInArrow(run, schema)


def best_fit(items: DataFrame, limit: int, cut: Cut) -> tuple[DataFrame, int]:
    """(id, bin) for items (id, size) of 1 to ``limit``, and the number of bins. Bins are numbered from 0."""
    spark = items.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    state = cut(items.select(F.lit(0).alias("kind"), "id", F.col("size").cast("int").alias("amount"), F.lit(None).cast("bigint").alias("bin")))
    placed, bins = [], 0
    while True:
        counts = np.zeros((2, limit + 1), np.int64)  # at most limit rows of either kind reach the driver
        for r in state.filter("kind < 2").groupBy("kind", "amount").count().collect():
            counts[r.kind, r.amount] = r["count"]
        sizes, rooms = counts
        n = int(sizes.sum())
        if not n:
            break
        amounts = np.arange(limit + 1)
        largest, least, volume = int(amounts[sizes > 0].max()), int(amounts[sizes > 0].min()), int(sizes @ amounts)
        rooms[:least] = 0
        room, halves = int(rooms @ amounts), int(sizes[limit // 2 + 1 :].sum())
        new = max(-(-(volume - room) // limit), 0 if rooms.any() else halves)
        gaps = int(rooms.sum()) + new
        shown = F.greatest(F.lit(1), F.least(F.floor(F.col("amount") / largest), F.lit(-(-2 * n // gaps)))).cast("int")
        fresh = spark.range(bins, bins + new, 1, max(1, min(width, new // RANGE_ROWS))).select("id", F.lit(limit).cast("int").alias("amount"))
        bins += new
        opened = state.filter(f"kind = 1 AND amount >= {least}").select("id", "amount").unionByName(fresh)
        openings = opened.withColumn("times", shown).select(F.floor(F.col("amount") / F.col("times")).cast("int").alias("size"), F.lit(1).alias("kind"), "id", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth"))
        elements = state.filter("kind = 0").select(F.col("amount").alias("size"), "kind", "id").unionByName(openings.drop("nth"))
        rows = n + min(gaps * (limit // largest), 2 * n + gaps)
        swept = cut(_swept(elements, max(min(width, rows // RANGE_ROWS + 1), rows // MOST_ROWS + 1)))
        left: dict[int, list[int]] = {}
        for r in swept.filter("mate IS NULL").groupBy("part", "kind").count().collect():  # two rows a range
            left.setdefault(r.part, [0, 0])[1 - r.kind] = r["count"]
        across = bridges([(part, *left[part]) for part in sorted(left)])
        spans = spark.createDataFrame(across, "at_part int, lo bigint, hi bigint, to_part int, both bigint")
        waiting = swept.filter("kind = 0").join(F.broadcast(spans), (F.col("part") == F.col("at_part")) & F.col("rank").between(F.col("lo"), F.col("hi")), "left")
        waiting = waiting.select("id", "size", "to_part", (F.col("both") - F.col("rank")).alias("to_rank"))
        free = swept.filter("kind = 1 AND mate IS NULL").select(F.col("part").alias("to_part"), F.col("rank").alias("to_rank"), F.col("id").alias("bin"))
        got = swept.filter("mate IS NOT NULL").select(F.col("mate").alias("id"), F.col("mate_size").alias("amount"), F.col("id").alias("bin"))
        got = got.unionByName(waiting.filter("to_part IS NOT NULL").join(free, ["to_part", "to_rank"]).select("id", F.col("size").alias("amount"), "bin"))
        used = got.groupBy("bin").agg(F.sum("amount").alias("used"))
        smaller = opened.join(used, opened["id"] == used["bin"], "left").select(F.lit(1).alias("kind"), "id", (F.col("amount") - F.coalesce("used", F.lit(0))).cast("int").alias("amount"), F.lit(None).cast("bigint").alias("bin")).filter("amount > 0")
        still = waiting.filter("to_part IS NULL").select(F.lit(0).alias("kind"), "id", F.col("size").alias("amount"), F.lit(None).cast("bigint").alias("bin"))
        after = still.unionByName(smaller).unionByName(got.select(F.lit(2).alias("kind"), "id", "amount", "bin"))
        state = cut(after.coalesce(max(min(width, rows // RANGE_ROWS + 1), rows // MOST_ROWS + 1)))
        cut.drop(swept)
        placed.append(state.filter("kind = 2").select("id", "bin"))
    out = spark.createDataFrame([], "id bigint, bin bigint")
    for p in placed:
        out = out.unionByName(p)
    return out, bins


def pack(found: DataFrame, limit: int = LIMIT, cut: Cut | None = None) -> DataFrame:
    """Pieces (a column ``length``, others pass through) with (sequence_id, offset): where each one stands. Sequences of
    one full piece have odd numbers, shared ones even numbers; the offset counts ids."""
    cut = cut or Cut(found.sparkSession, "packing")
    held = cut(found.withColumn("uid", F.monotonically_increasing_id()))
    full = held.filter(F.col("length") >= limit).withColumn("sequence_id", F.col("uid") * 2 + 1)
    rest = held.filter(F.col("length") < limit)
    where, _ = best_fit(rest.select(F.col("uid").alias("id"), F.col("length").alias("size")), limit, cut)
    shared = rest.join(where, rest["uid"] == where["id"]).drop("id").withColumn("sequence_id", F.col("bin") * 2).drop("bin")
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "uid").rowsBetween(Window.unboundedPreceding, -1)  # at most ``limit`` rows
    placed = full.withColumn("offset", F.lit(0).cast("bigint")).unionByName(shared.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint")))
    return placed.drop("uid")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces that carry their ids; at most ``limit`` ids meet in a row."""
    together = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return together.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
