"""Operator 13: groups spelling variants of the words of a corpus by Bloom-guided neighbourhoods.

1. Words are counted: each task counts what it reads, counts of a word are added by Spark.
2. Each word that is frequent enough gets a 64-bit key, a polynomial of its code points, so that the keys of all words
   one edit away follow from its own without building them.
3. The keys go into blocked Bloom filters, one or more for each word length (256-bit blocks, 8 bits a key). Filters
   are broadcast, ``PASS_BYTES`` at a time: more words mean more passes, not a larger broadcast or a fuller filter.
4. Each word probes its deletions and replacements (an insertion is a deletion of the other word). Only positives are
   shuffled, as numbers: the key of the word, the edit and the key it leads to. A join with the vocabulary by key
   removes false positives, and comparing the edited word with the found one removes equal keys of different words.
5. Of the near words of a word the most frequent is its form if it is frequent enough; forms are followed to their roots
   by doubling the distance in each round. Counts at least double on the way, so a handful of rounds end it.

Defined results: null texts have no words; a null id counts as an empty one; repeated rows count each; an empty table or
one without frequent words gives no rows; columns other than id and text are not read, whatever their names. Words may
be of any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cut, quoted, table

MIN_LETTERS, MIN_COUNT, RATIO, TYPO = 5, 3, 2, 97
RUN = re.compile("[A-Za-zÀ-ÿ]+").findall
#: Distinct words that a task holds before it hands their counts on.
HELD = 300_000
#: Lengths from this one on share filters. Bytes of filters in one broadcast; bytes a word; blocks of one filter chunk.
LONG, PASS_BYTES, WORD_BYTES, CHUNK_BLOCKS = 64, 32 << 20, 2, 2048
#: Edits that are probed at once.
PROBES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: The odd multipliers that pick the 8 bits of a block in the public split-block Bloom filter.
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)
U32 = np.uint64(0xFFFFFFFF)


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", typo: int = TYPO, least: int = MIN_LETTERS) -> DataFrame:
    """(word, n): every word of at least ``least`` letters with its occurrences.

    A run is lower-cased (A-Z only). Where ``typo`` divides the CRC-32 of "id:run" the run loses the letter at that
    number modulo its length, in that document.
    """
    held = docs.select(quoted(doc_id).cast("string").alias("doc_id"), quoted(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})

        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = zlib.crc32(f"{ident or ''}:".encode())
                for word, n in Counter(RUN((text or "").encode("utf-8", "replace").lower().decode())).items():
                    if len(word) < least:
                        continue
                    h = zlib.crc32(word.encode(), start)
                    if not h % typo:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    total[word] += n
                if len(total) > HELD:
                    yield out()
                    total.clear()
        yield out()

    return held.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def mixed(h: np.ndarray, length: int) -> np.ndarray:
    """Keys from polynomials: every bit of the result depends on every bit of the polynomial and on the length."""
    x = h + np.uint64(length * 0xD1342543DE82EF95 % (1 << 64))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(length: int) -> np.ndarray:
    out = np.full(length, BASE, np.uint64)
    if length:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def letters(group: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(group).encode("utf-32-le"), "<u4").reshape(len(group), length).astype(np.uint64)


def keys_of(group: list[str], length: int) -> np.ndarray:
    """Keys of words of one length."""
    return mixed((letters(group, length) * powers(length)).sum(axis=1, dtype=np.uint64), length)


def by_length(batch: list[str]) -> dict[int, np.ndarray]:
    size = np.fromiter(map(len, batch), np.int64, len(batch))
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    return {int(size[part[0]]): part for part in np.split(order, cuts) if len(part)}


def vocabulary(counted: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """(word, n, key) of the words that occur at least ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            key = np.zeros(len(found), np.uint64)
            for length, at in by_length(found).items():
                key[at] = keys_of([found[k] for k in at], length)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.view(np.int64))], names=["word", "n", "key"])

    return counted.filter(F.col("n") >= least).select("word", "n").mapInArrow(run, "word string, n bigint, key bigint")


class Filters:
    """Where keys lie in the filters: each length class has ``slices`` filters of ``blocks`` blocks of 8 words of 32
    bits. ``parts`` {(class, slice): number} names those of one pass."""

    def __init__(self, counts: dict[int, int], pass_bytes: int = PASS_BYTES):
        self.shape = {}
        for kind, n in counts.items():
            slices = max(1, -(-n * WORD_BYTES * 4 // pass_bytes))
            self.shape[kind] = slices, max(1, -(-n * WORD_BYTES // (32 * slices)))
        self.passes: list[dict[tuple[int, int], int]] = []
        room = 0
        for kind, (slices, blocks) in sorted(self.shape.items()):
            for s in range(slices):
                if blocks * 32 > room:
                    self.passes.append({})
                    room = pass_bytes
                self.passes[-1][kind, s] = len(self.passes[-1])
                room -= blocks * 32

    def place(self, kind: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slice, block) of keys."""
        slices, blocks = self.shape[kind]
        high = key >> np.uint64(32)
        return (high % np.uint64(slices)).astype(np.int64), (((high // np.uint64(slices)) * np.uint64(blocks)) // np.uint64((1 << 32) // slices + 1)).astype(np.int64)


def bit(key: np.ndarray, k: int) -> np.ndarray:
    return np.uint32(1) << ((((key & U32) * SALTS[k]) & U32) >> np.uint64(27)).astype(np.uint32)


def build(vocab: DataFrame, filters: Filters, which: dict[tuple[int, int], int], width: int) -> dict[tuple[int, int], np.ndarray]:
    """The filters of one pass. Keys are dealt by the stretch of a filter that they set; each stretch is made in one
    task, and only finished stretches, PASS_BYTES in all, reach the driver."""
    shape, place = filters.shape, filters.place

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, key = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for kind in {k for k, _ in which}:
                own = key[np.minimum(size, LONG) == kind]
                part, block = place(kind, own)
                for (k, s), number in which.items():
                    if k == kind and (mine := part == s).any():
                        yield pa.record_batch({"number": pa.array(np.full(mine.sum(), number, np.int32)), "chunk": pa.array(block[mine] // CHUNK_BLOCKS), "block": pa.array(block[mine] % CHUNK_BLOCKS), "key": pa.array(own[mine].view(np.int64))})

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            number, chunk, block, key = (c.to_numpy() for c in batch.columns)
            for n, c in set(zip(number.tolist(), chunk.tolist())):
                at = (number == n) & (chunk == c)
                words = made.setdefault((n, c), np.zeros((CHUNK_BLOCKS, 8), np.uint32))
                for k in range(8):
                    np.bitwise_or.at(words, (block[at], k), bit(key[at].view(np.uint64), k))
        yield pa.record_batch({"number": pa.array([n for n, _ in made], pa.int32()), "chunk": pa.array([c for _, c in made], pa.int64()), "bits": pa.array([w.tobytes() for w in made.values()], pa.binary())})

    dealt = vocab.select(F.length("word").alias("size"), "key").mapInArrow(deal, "number int, chunk bigint, block bigint, key bigint").repartition(width, "number", "chunk")
    blocks = {number: shape[kind][1] for (kind, _), number in which.items()}
    whole = {number: np.zeros((-(-n // CHUNK_BLOCKS) * CHUNK_BLOCKS, 8), np.uint32) for number, n in blocks.items()}
    for r in dealt.mapInArrow(make, "number int, chunk bigint, bits binary").toLocalIterator():
        whole[r.number][r.chunk * CHUNK_BLOCKS : (r.chunk + 1) * CHUNK_BLOCKS] = np.frombuffer(r.bits, np.uint32).reshape(-1, 8)
    return {of: whole[number][: blocks[number]] for of, number in which.items()}


def probe(vocab: DataFrame, filters: Filters, made: dict[tuple[int, int], np.ndarray], alphabet: list[int]) -> DataFrame:
    """(source, target, at, put): the edits of each word whose key the filters know; ``put`` is the letter that replaces
    the one at ``at``, empty for a deletion."""
    shared = vocab.sparkSession.sparkContext.broadcast(made)
    shape, place = filters.shape, filters.place
    signs, names = np.array(alphabet, np.uint64), np.array([*map(chr, alphabet), ""])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        kinds = {kind for kind, _ in bits}

        def known(kind: int, key: np.ndarray) -> np.ndarray:
            part, block = place(kind, key)
            at = []
            for (k, s), words in bits.items():
                if k != kind:
                    continue
                left = np.flatnonzero(part == s) if shape[kind][0] > 1 else np.arange(len(key))
                for j in range(8):
                    left = left[(words[block[left], j] & bit(key[left], j)) > 0]
                at.append(left)
            return np.concatenate(at)

        def rows(source: np.ndarray, key: np.ndarray, at: np.ndarray, put: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch({"source": pa.array(source.view(np.int64)), "target": pa.array(key.view(np.int64)), "at": pa.array(at.astype(np.int32)), "put": pa.array(names[put].tolist(), pa.string())})

        for batch in batches:
            found, own = batch.column(0).to_pylist(), batch.column(1).to_numpy().view(np.uint64)
            for length, members in by_length(found).items():
                power, same, shorter = powers(length), min(length, LONG), min(length - 1, LONG)
                for lo in range(0, len(members), max(1, PROBES // (length * len(signs)))):
                    group = members[lo : lo + max(1, PROBES // (length * len(signs)))]
                    c, source = letters([found[k] for k in group], length), own[group]
                    term = c * power
                    total = term.sum(axis=1, dtype=np.uint64)
                    if shorter in kinds:
                        upto = np.cumsum(term, axis=1, dtype=np.uint64)
                        h = upto - term + (total[:, None] - upto) * INVERSE
                        again = np.zeros(c.shape, bool)
                        again[:, 1:] = c[:, 1:] == c[:, :-1]  # the same word as without the letter before
                        who, at = np.nonzero(~again)
                        key = mixed(h[who, at], length - 1)
                        hit = known(shorter, key)
                        yield rows(source[who[hit]], key[hit], at[hit], np.full(len(hit), len(signs)))
                    if same in kinds:
                        step = max(1, PROBES // (len(group) * len(signs)))
                        for first in range(0, length, step):
                            old = c[:, first : first + step, None]
                            h = total[:, None, None] + (signs - old) * power[first : first + step, None]
                            who, at, put = np.nonzero(old != signs)
                            key = mixed(h[who, at, put], length)
                            hit = known(same, key)
                            yield rows(source[who[hit]], key[hit], at[hit] + first, put[hit])

    return vocab.select("word", "key").mapInArrow(run, "source bigint, target bigint, at int, put string")


def alphabet_of(vocab: DataFrame) -> list[int]:
    """Code points of all letters: each task hands on the distinct ones of what it has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            seen.update("".join(batch.column(0).to_pylist()))
        yield pa.record_batch({"c": pa.array(sorted(map(ord, seen)), pa.int32())})

    return sorted(r.c for r in vocab.select("word").mapInArrow(run, "c int").distinct().collect())


def near_words(vocab: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(word, n, near, near_n): all pairs of words that differ by one inserted, deleted or replaced code point, in both
    directions."""
    spark = vocab.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = {r.kind: r["count"] for r in vocab.groupBy(F.least(F.length("word"), F.lit(LONG)).alias("kind")).count().collect()}
    filters, alphabet = Filters(counts, pass_bytes), alphabet_of(vocab)
    found = spark.createDataFrame([], "source bigint, target bigint, at int, put string")
    for which in filters.passes:
        found = found.unionByName(probe(vocab, filters, build(vocab, filters, which, width), alphabet))
    target = vocab.select(F.col("key").alias("target"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    source = vocab.select(F.col("key").alias("source"), "word", "n")
    met = found.join(target, "target").join(source, "source")
    met = met.filter(F.concat(F.substring("word", F.lit(1), F.col("at")), F.col("put"), F.substring("word", F.col("at") + 2, F.length("word"))) == F.col("near"))
    there = F.struct("word", "n", "near", "near_n")
    back = F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return met.select(F.explode(F.when(F.col("put") == "", F.array(there, back)).otherwise(F.array(there))).alias("p")).select("p.*")


def roots(forms: DataFrame, cut: Cut) -> DataFrame:
    """(word, root) for (word, form) where every word has a form: the last form on the way."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("at"), F.col("root").alias("further"))
        after = cut(now.join(on, now["root"] == on["at"], "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        cut.drop(now)
        now = after.select("word", "root")
        now.cut_path = after.cut_path
        if after.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ratio: int = RATIO, pass_bytes: int = PASS_BYTES, cut: Cut | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all frequent words. ``form`` is the most frequent near word (the first
    in code-point order of equals) if it occurs at least ``ratio`` times as often."""
    cut = cut or Cut(docs.sparkSession, "spelling")
    vocab = cut(vocabulary(words(docs, doc_id, text)))
    near = near_words(vocab, pass_bytes).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    likely = near.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    whole = vocab.join(likely, "word", "left").withColumn("ok", F.coalesce(F.col("near_n") >= ratio * F.col("n"), F.lit(False)))
    formed = cut(whole.select("word", F.when(F.col("ok"), F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("ok"), F.col("near_n")).alias("form_n")))
    last = roots(formed.filter("form IS NOT NULL"), cut)
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
