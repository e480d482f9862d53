"""Operator 8: SimHash near-duplicate groups by a generalised pigeonhole search.

Each text gets a 64-bit fingerprint. Texts link where fingerprints differ in at most ``RADIUS`` bits, and groups are
the connected components. The search runs on distinct fingerprints only, so exact copies cost nothing more:

1. Over all fingerprints, count each bit and each pair of bits. Correlated bits go into the same partition of the 64.
2. By the general pigeonhole principle two linked fingerprints are close in some partition: within t_i bits of
   partition i for some i, whenever the sum of (t_i + 1) is RADIUS + 1. Dynamic programming chooses the t_i (-1: the
   partition is not searched) with the least sum of probes and estimated candidates.
3. Every fingerprint goes to the buckets of all keys within half of t_i bits (rounded up) of its own in partition i: two
   that are within t_i bits meet halfway. A bucket verifies its pairs on all 64 bits and returns a spanning forest of its
   links, at most one row for each member: no pair lists, and no link between components is lost.
4. Components by alternating star contraction over the forests.

The stage ``keep_one`` links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Its
fingerprints are of the distinct words, which an edit changes less than shingles (texts that share 0.8 of their shingles
differ in about 4 of 64 bits, in 8 to 14 bits by shingles), and are searched within ``STAGE_RADIUS``. Next to its
fingerprint each text carries a sketch of ``SKETCH`` bytes, each from the shingle of the smallest value under one hash
function; pairs with ``AGREE`` equal bytes are candidates. Every link is verified on the shingles themselves. A bucket
proposes a spanning forest of its candidates, more of them where links were refuted before, until it has none left, so
the groups are those of all links, and no list of all pairs is made. A pair that meets in many buckets is proposed by one
of them only, and from the second round on bitmaps of the shingles tell most of the pairs that cannot be links. A row of
this stage goes to coarse buckets, of a few bits of each partition, and is dealt to all keys of a coarse bucket where it
arrives. Later rounds need no keys: what they look at again lies within the components of the first round's candidates.

Defined results: null and word-less texts have fingerprint zero and link like any other; null ids are grouped like
others but never name a group (a group of nothing but null ids has a null component_id); repeated rows come out each;
an empty table gives no rows; columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import Cut, give_back, map_column, quoted, table

#: Words of a shingle, bits that may differ, and similarity of the shingle sets in keep_one(), the stage that removes near
#: copies.
STAGE_SHINGLE, STAGE_RADIUS, JACCARD = 5, 8, 0.8
BITS, RADIUS, SHINGLE, PARTS = 64, 3, 3, (2, 3, 4, 5, 6)
#: Bytes of a sketch and how many must agree. Texts of a Jaccard similarity of 0.8 miss 41 of 64 once in 1,164 pairs; those
#: of 0.5 meet it once in 56 pairs (8 of 16: four in five), so families of texts that are only somewhat alike do not meet
#: pair by pair.
SKETCH, AGREE = 64, 41
FACTORS = np.array([xxhash.xxh64_intdigest(bytes([k])) | 1 for k in range(SKETCH)], np.uint64)
MARKS = ["fp", *(f"sketch{k}" for k in range(SKETCH // 8))]
#: Rows of two numbers that are broadcast at most (about 40 MB); more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
#: Cost of one candidate pair in probes; only the plan depends on it, never the result.
PAIR_COST = 0.05
#: Texts for each coarse bucket of a partition, about; and the largest components whose texts meet in one bucket.
COARSE_ROWS, TOGETHER = 2048, 512


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; of the whole sequence if there are fewer words, of nothing if none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(words) - size + 1)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    n, ones = len(hashes), np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def sketch(hashes: np.ndarray) -> np.ndarray:
    """For each factor the last byte of the smallest product; zeros if there are no hashes."""
    if not len(hashes):
        return np.zeros(SKETCH, np.uint8)
    return np.array([(hashes * f).min() for f in FACTORS]).astype(np.uint8)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, size))


def fingerprints(docs: DataFrame, text: str = "text", target: str = "fp", size: int = SHINGLE) -> DataFrame:
    """Adds the fingerprint as a signed 64-bit number."""

    def make():
        return lambda texts: np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)

    return map_column(docs, text, target, pa.int64(), "bigint", make)


def word_fingerprint(text: str | None) -> int:
    """The fingerprint of the distinct words."""
    words = set((text or "").encode("utf-8", "surrogatepass").lower().split())
    return majority(np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words)))


def signatures(docs: DataFrame, text: str = "text", target: str = "signature", size: int = STAGE_SHINGLE) -> DataFrame:
    """Adds an array of MARKS: the fingerprint of the words, and the sketch of the shingles, eight bytes a number."""

    def one(text: str | None) -> np.ndarray:
        return np.concatenate([np.array([word_fingerprint(text)], "<u8").view("<i8"), sketch(shingle_hashes(text, size)).view("<i8")])

    return map_column(docs, text, target, pa.list_(pa.int64()), "array<bigint>", lambda: lambda texts: [one(t) for t in texts])


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and a 64 x 64 matrix: how many have both bits. Each task sums its own; 4,096 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            raw = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).astype("<i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        yield pa.record_batch({"at": pa.array(range(BITS * BITS), pa.int32()), "n": pa.array(total.ravel())})

    rows = fps.mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(BITS * BITS, np.int64)
    for r in rows:
        both[r.at] = r.n
    return fps.count(), both.reshape(BITS, BITS)


def partition_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Equal parts of the bits, each grown from the bit that is most correlated with all by the next most correlated."""
    n = max(n, 1)
    p = np.diag(both) / n
    cov = both / n - np.outer(p, p)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(dev, dev))
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: (corr[b, group].sum(), -b)))
            left.remove(group[-1])
        out.append(sorted(group))
    return out


def plan(n: int, both: np.ndarray, parts: tuple[int, ...] = PARTS, radius: int = RADIUS) -> tuple[list[list[int]], list[int]]:
    """Partitions, and how far their keys lie from a fingerprint, of the number of parts that is estimated to cost least."""
    found = {k: partition_bits(n, both, k) for k in parts}
    _, k, limits = min((cost, k, limits) for k in parts for cost, limits in [_allocate(n, both, found[k], radius)])
    return found[k], [halfway(t) for t in limits]


def halfway(t: int) -> int:
    """How far keys reach on either side so that all that differ in ``t`` bits meet."""
    return (t + 1) // 2 if t >= 0 else -1


def shared_keys(size: int, d: int, reach: int) -> int:
    """How many keys of ``size`` bits lie within ``reach`` of both of two that differ in ``d`` bits."""
    return sum(comb(d, a) * comb(size - d, b) for a in range(d + 1) for b in range(reach + 1) if max(a, d - a) + b <= reach)


def allocate(n: int, both: np.ndarray, groups: list[list[int]], radius: int = RADIUS) -> list[int]:
    return _allocate(n, both, groups, radius)[1]


def _allocate(n: int, both: np.ndarray, groups: list[list[int]], radius: int) -> tuple[float, list[int]]:
    """Thresholds with the least estimated cost under sum(t + 1) = radius + 1, and that cost.

    Two fingerprints differ in bit b with chance 2p(1 - p); the number of differing bits of a partition then has a
    Poisson-binomial distribution, which gives the share of pairs that meet, and in how many buckets.
    """
    p = np.diag(both) / max(n, 1)
    costs = []
    for g in groups:
        near = np.zeros(radius + 2)
        near[0] = 1
        for b in g:
            q = 2 * p[b] * (1 - p[b])
            near[1:] = near[1:] * (1 - q) + near[:-1] * q
            near[0] *= 1 - q
        cost = [0.0]
        for t in range(radius + 1):
            reach = halfway(t)
            ball = sum(comb(len(g), k) for k in range(reach + 1))
            met = sum(near[d] * shared_keys(len(g), d, reach) for d in range(min(2 * reach, len(g)) + 1))
            cost.append(max(n, 1) * ball + PAIR_COST * met * n * n / 2)  # keys cost something on an empty table, too
        costs.append(cost)
    best = {0: (0.0, [])}
    for cost in costs:
        best = {
            total: min((best[total - u][0] + cost[u], best[total - u][1] + [u - 1]) for u in range(radius + 2) if total - u in best)
            for total in range(radius + 2)
        }
    return best[radius + 1]


def probes(fps: DataFrame, groups: list[list[int]], limits: list[int]) -> DataFrame:
    """Rows (part, key, fp, sketch): each fingerprint at every key within its partition's limit."""
    out = []
    for part, (bits, t) in enumerate(zip(groups, limits)):
        if t < 0:
            continue
        flips = [_signed(sum(1 << b for b in c)) for k in range(t + 1) for c in combinations(bits, k)]
        keys = _keys(F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits)))), flips)
        out.append(F.struct(F.lit(part).alias("part"), keys.alias("keys")))
    each = fps.select("*", F.explode(F.array(*out)).alias("p"))
    return each.select(F.col("p.part").alias("part"), F.explode("p.keys").alias("key"), *fps.columns)


def coarse_bits(n: int, both: np.ndarray, groups: list[list[int]]) -> list[list[int]]:
    """The bits of each partition that make its coarse keys: those set most nearly in half of the texts."""
    many = (n // COARSE_ROWS).bit_length()
    return [sorted(sorted(g, key=lambda b: abs(2 * int(both[b, b]) - n))[:many]) for g in groups]


def dealt(part: np.ndarray, key: np.ndarray, fp: np.ndarray, groups: list[list[int]], limits: list[int], coarse: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """From rows at coarse keys: which row, and its key, for every key of ``probes`` over all bits; in order of part, key
    and row. Rows of part -1, and of parts from ``len(groups)`` on, whose keys have all bits already, keep their key."""
    whole = (part < 0) | (part >= len(groups))
    at, keys = [np.flatnonzero(whole)], [key[whole]]
    for k, (bits, t) in enumerate(zip(groups, limits)):
        rows = np.flatnonzero(part == k)
        if t < 0 or not len(rows):
            continue
        fine = sorted(set(bits) - set(coarse[k]))
        spent = np.bitwise_count((fp[rows] & _mask(coarse[k])) ^ key[rows])
        own = key[rows] | (fp[rows] & _mask(fine))
        for gone in range(t + 1):
            some = spent == gone
            flips = np.array([_mask(c) for more in range(t - gone + 1) for c in combinations(fine, more)], np.uint64)
            at.append(np.repeat(rows[some], len(flips)))
            keys.append((own[some][:, None] ^ flips).ravel())
    at, keys = np.concatenate(at), np.concatenate(keys)
    order = np.lexsort((at, keys, part[at]))
    return at[order], keys[order]


def _mask(bits) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def _keys(own: Column, flips: list[int]) -> Column:
    return F.transform(F.lit(np.array(flips, np.int64)), lambda x: own.bitwiseXOR(x))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(bucket: np.ndarray, fp: np.ndarray, radius: int = RADIUS, sketches: np.ndarray | None = None, joined: np.ndarray | None = None, refuted: Callable[[int, int], bool] | None = None, tries: int = 1, owned: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, join_others: bool = True) -> list[tuple[int, int]]:
    """Spanning forests of the links inside buckets; ``bucket`` is sorted. Pairs are taken in order: the first row of each
    bucket with all behind it, then the second, all buckets at once; pairs that are joined already, and buckets that are one
    tree, drop out. With ``sketches`` (bytes, one row a text) a link also needs AGREE equal bytes. Rows of one ``joined``
    number in a bucket are joined from the start; pairs that are ``refuted`` are passed over; two trees count as joined
    after ``tries`` links between them. Links that are not ``owned`` join, but are not returned: if the rows of all buckets
    stand in one order and each link is owned by one of its buckets, a link that is passed over is spanned by earlier ones,
    and so in the end by returned ones. Without ``join_others`` they are passed over, so that each pair is judged in one bucket."""
    n = len(fp)
    root = np.arange(n)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[starts, n])
    end = np.repeat(starts + size, size)
    trees = np.repeat(size, size)  # at a bucket's first row: trees left in it
    first = np.repeat(starts, size)
    if joined is not None and n:
        order = np.lexsort((joined, bucket))
        new = np.r_[True, (bucket[order][1:] != bucket[order][:-1]) | (joined[order][1:] != joined[order][:-1])]
        root[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]  # lexsort is stable: the first row of each number
        np.subtract.at(trees, first[order][~new], 1)
    out: list[tuple[int, int]] = []
    tried: Counter = Counter()

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    heads, minor, major, d = starts, np.arange(n), np.zeros(n, bool), 0
    while True:
        heads = heads[(trees[heads] > 1) & (heads + d + 1 < end[heads])]
        if not len(heads):
            return out
        if d & (d - 1) == 0 and d >= 16:  # now and then: rows of a bucket's largest tree need not be compared with each other
            flat, sizes = np.unique(root, return_counts=True)
            order = np.lexsort((sizes, first[flat]))
            last = order[np.r_[first[flat][order][1:] != first[flat][order][:-1], True]]  # one tree of each bucket
            major = np.zeros(n, bool)
            major[flat[last]] = True
            major = major[root]
            minor = np.flatnonzero(~major)
        whole = heads[~major[heads + d]]  # these meet all rows behind them, those of a largest tree only the others
        length = end[whole] - whole - d - 1
        right = np.repeat(whole + d + 1 - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum()) if len(whole) else whole
        if len(whole) < len(heads):
            minor = minor[(trees[first[minor]] > 1) & (minor > first[minor] + d)]
            right = np.concatenate([right, minor[major[first[minor] + d]]])
        left = first[right] + d
        open_ = root[left] != root[right]
        left, right = left[open_], right[open_]
        near = np.bitwise_count(fp[left] ^ fp[right]) <= radius
        left, right = left[near], right[near]
        if sketches is not None:
            near = (sketches[left] == sketches[right]).sum(axis=1) >= AGREE
            left, right = left[near], right[near]
        kept = np.ones(len(left), bool) if owned is None else owned(left, right)
        if not join_others:
            left, right, kept = left[kept], right[kept], kept[kept]
        for i, j, own in zip(left.tolist(), right.tolist(), kept.tolist()):
            a, b = find(i), find(j)
            if a == b or (refuted is not None and refuted(i, j)):
                continue
            if own:
                out.append((i, j))
            pair = min(a, b), max(a, b)
            tried[pair] += 1
            if tried[pair] >= tries:
                root[pair[1]] = pair[0]
                trees[first[i]] -= 1
        if len(left):
            while not np.array_equal(up := root[root], root):
                root[:] = up
        d += 1


def owner(one: np.ndarray, other: np.ndarray, groups: list[list[int]], limits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(part, key) of the one bucket that answers for each pair of fingerprints: of the partition in which they differ
    least (the first of these), and halfway between them there. Both have it among their keys if they meet at all."""
    differ, low = one ^ other, np.minimum(one, other)
    parts = [(k, np.uint64(sum(1 << b for b in bits)), t) for k, (bits, t) in enumerate(zip(groups, limits)) if t >= 0]
    weights = np.stack([np.where((w := np.bitwise_count(differ & mask).astype(np.int64)) <= 2 * t, w, BITS + 1) for _, mask, t in parts])
    at = weights.argmin(axis=0)
    masks = np.array([mask for _, mask, _ in parts])[at]
    rest, steps, key = differ & masks, (weights.min(axis=0) + 1) // 2, low & masks
    for k in range(max(t for _, _, t in parts)):
        lowest = rest & (~rest + np.uint64(1))
        key ^= np.where(k < steps, lowest, np.uint64(0))
        rest ^= lowest
    return np.array([k for k, _, _ in parts])[at], key.view(np.int64)


def buckets(keyed: DataFrame, parallel: int, columns: int, forests: Callable[[np.ndarray, list], np.ndarray], schema: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Runs ``forests`` on whole buckets of (part, key, ...): it takes the bucket, part, key and the numbers of the first
    ``columns`` columns behind the key, and the lists of what follows, rows in order of their bucket, then of ``order``."""
    names = schema.replace(" bigint", "").split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, list]] = []

        def flush(parts: list[tuple[np.ndarray, list]]) -> pa.RecordBatch:
            rows, lists = np.concatenate([p[0] for p in parts]), [x for p in parts for x in p[1]]
            change = np.r_[False, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])]
            bucket = np.cumsum(change)
            many = np.bincount(bucket)[bucket] > 1
            found = forests(np.c_[bucket[many], rows[many]], [lists[k] for k in np.flatnonzero(many)] if lists else [])
            return pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(len(names))], names=names)

        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2 + columns)], axis=1)
            lists = batch.column(2 + columns).to_pylist() if batch.num_columns > 2 + columns else []
            if not len(rows):
                continue
            # The last bucket may go on in the next batch; parts of it wait side by side.
            last = held[-1][0][-1] if held else rows[0]
            same = (rows[:, 0] == last[0]) & (rows[:, 1] == last[1])
            if held and not same[0]:
                yield flush(held)
                held = []
            cut = int(np.argmax((rows[:, 0] == rows[-1, 0]) & (rows[:, 1] == rows[-1, 1])))
            if cut:
                yield flush([*held, (rows[:cut], lists[:cut])])
                held = []
            held.append((rows[cut:], lists[cut:]))
        if held:
            yield flush(held)
        held.clear()
        give_back()

    return keyed.repartition(parallel, "part", "key").sortWithinPartitions("part", "key", *order).mapInArrow(run, schema)


def links(keyed: DataFrame, parallel: int, radius: int = RADIUS) -> DataFrame:
    """Distinct links (a, b) of fingerprints that connect all that buckets connect."""

    def forests(rows: np.ndarray, _: list) -> np.ndarray:
        pairs = np.array(forest(rows[:, 0], np.ascontiguousarray(rows[:, 3]).view(np.uint64), radius), np.int64).reshape(-1, 2)
        return np.stack([rows[pairs[:, side], 3] for side in (0, 1)], axis=1)

    return buckets(keyed, parallel, 1, forests, "a bigint, b bigint").distinct()


def shape(shingles: np.ndarray) -> bytes:
    """How many distinct shingles there are, and a bitmap of them, eight bits or more for each."""
    bits = np.zeros(64 << max(0, (len(shingles) * 8 - 1).bit_length() - 6) if len(shingles) else 64, bool)
    bits[shingles & np.uint32(len(bits) - 1)] = True
    return np.array([len(shingles)], "<u8").tobytes() + np.packbits(bits, bitorder="little").tobytes()


def may_be_similar(one: bytes, other: bytes, least: float = JACCARD) -> bool:
    """Whether two shapes leave it open that the Jaccard similarity is ``least``; never false where it is. Each bit that
    differs is a shingle that one of the two sets lacks."""
    x, y = sorted((np.frombuffer(one, "<u8"), np.frombuffer(other, "<u8")), key=len)
    most = float(x[0] + y[0]) * (1 - least) / (1 + least) + 1e-6
    if abs(float(x[0]) - float(y[0])) > most:
        return False
    folded = np.bitwise_or.reduce(y[1:].reshape(-1, len(x) - 1), axis=0)
    return int(np.bitwise_count(x[1:] ^ folded).sum()) <= most


def candidates(keyed: DataFrame, parallel: int, radius: int, tries: int, groups: list[list[int]], limits: list[int], coarse: list[list[int]]) -> DataFrame:
    """Different candidates (a, b), a < b, from rows (part, key, node, *MARKS, root) at coarse keys: between nodes of
    different roots. With a further column ``known`` the pair is not refuted yet, and not by the shapes either. Two texts
    meet in many buckets; the pair comes from its owner alone. Buckets of part -1 are whole components and own their pairs."""
    last, judged = 4 + len(MARKS), "known" in keyed.columns

    def forests(rows: np.ndarray, known: list) -> np.ndarray:
        at, key = dealt(rows[:, 1], rows[:, 2].astype(np.uint64), rows[:, 4].astype(np.uint64), groups, limits, coarse)
        bucket = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (rows[at[1:], 1] != rows[at[:-1], 1])][: len(at)])
        many = np.bincount(bucket, minlength=1)[bucket] > 1
        at, key, bucket = at[many], key[many].view(np.int64), bucket[many]
        part, node, root, fp = rows[at, 1], rows[at, 3], rows[at, last], rows[at, 4].astype(np.uint64)
        gone = [frozenset(k["refuted"] or ()) for k in known]

        def refuted(i: int, j: int) -> bool:
            one, other = at[i], at[j]
            return int(node[j]) in gone[one] or not may_be_similar(known[one]["shape"], known[other]["shape"])

        def owned(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            own_part, own_key = owner(fp[i], fp[j], groups, limits)
            return (part[i] < 0) | ((part[i] % len(groups) == own_part) & (key[i] == own_key))

        pairs = forest(bucket, fp, radius, np.ascontiguousarray(rows[at, 5:last]).view(np.uint8), root, refuted if judged else None, tries, owned, not judged)
        return np.sort(node[np.array(pairs, np.int64).reshape(-1, 2)], axis=1)

    return buckets(keyed, parallel, last - 2, forests, "a bigint, b bigint", ("node",))


def watched(cut: Cut, df: DataFrame, *figures: Column) -> tuple[DataFrame, dict]:
    """``cut`` of a table, and figures over its rows that Spark observes while it writes them: no second query."""
    seen = Observation()
    return cut(df.observe(seen, *figures)), seen.get


def components(edges: DataFrame, cut: Cut) -> DataFrame:
    """(node, root) for every node of the edges (a, b) but the roots: root is the smallest node reachable.

    Alternating star contraction: large stars move the larger neighbours of a node to its smallest one, small stars
    the smaller ones; each needs a minimum and a join. It ends when a round changes nothing.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        u, v = ("u", "v") if large else ("hi", "lo")
        around = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo"))
        low = around.groupBy(F.col(u).alias("k")).agg(F.min(v).alias("m")).withColumn("m", F.least("k", "m"))
        joined = around.join(low, around[u] == low["k"])
        if large:
            return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        return joined.select(F.col("lo").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()

    state = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit(0xFFFFFFFF))).alias("s")]
    e, before = watched(cut, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), *state)
    while before["n"]:
        new, after = watched(cut, star(star(e, True), False).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), *state)
        cut.drop(e)
        e = new
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", fp: str = "fp", radius: int = RADIUS, parts: tuple[int, ...] = PARTS) -> DataFrame:
    """(fp, component_id, root) for every distinct fingerprint of a table that holds ids and fingerprints; ``root`` names a
    component even if all its ids are null."""
    spark = docs.sparkSession
    cut = Cut(spark, "simhash")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = cut(docs.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("first_id")))
    n, both = bit_statistics(each.select("fp"))
    groups, limits = plan(n, both, parts, radius)
    tree = components(links(probes(each.select("fp"), groups, limits), width, radius), cut)
    rooted = each.join(tree, each["fp"] == tree["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(named, "root").select("fp", "component_id", "root")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fp")
    docs = Cut(spark, "fingerprints")(docs)
    return docs.join(near_duplicates(docs), "fp").select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique((shingle_hashes(text, size) >> np.uint64(32)).astype("<u4"))


def shapes_of(texts: DataFrame, size: int) -> DataFrame:
    """(node, shape), one row a node, from (node, text)."""
    each = map_column(texts, "text", "shape", pa.binary(), "binary", lambda: lambda ts: [shape(shingle_set(t, size)) for t in ts])
    return each.groupBy("node").agg(F.first("shape").alias("shape"))


def similar(edges: DataFrame, n: int, texts: DataFrame, cut: Cut, size: int = STAGE_SHINGLE, least: float = JACCARD) -> tuple[DataFrame, int]:
    """(a, b, ok) for n edges (a, b) of nodes, and how many are not ok: whether the shingle sets of their texts (node, text) have a Jaccard similarity
    of ``least`` or more; two texts without words are similar. Shingles are compared as 32-bit hashes.

    Each text that an edge needs becomes its shingle set once; the set goes to its edges, where two sets meet at a time.
    """
    width = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = edges.select(F.col("a").alias("node"), "a", "b").unionByName(edges.select(F.col("b").alias("node"), "a", "b"))
    sides = F.broadcast(sides) if n * 2 <= BROADCAST_ROWS else sides

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [shingle_set(t, size).tobytes() for t in batch.column(1).to_pylist()]
                yield pa.record_batch({"node": batch.column(0), "shingles": pa.array(sets, pa.binary())})
        give_back()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the side of an edge that came last
        for batch in batches:
            out = []
            for a, b, node, raw in (row for at in range(0, batch.num_rows, 256) for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns))):
                if before is None or before[:2] != (a, b):
                    before = a, b, node, raw
                    continue
                if before[2] == node:  # the same text once more, or an edge that is judged
                    continue
                x, y = np.frombuffer(before[3], "<u4"), np.frombuffer(raw, "<u4")
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append((a, b, both >= least * (len(x) + len(y) - both)))
                before = a, b, node, raw
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "ok"])
        give_back()

    sets = texts.mapInArrow(shingles, "node bigint, shingles binary")
    met = sets.join(sides, "node").select("a", "b", "node", "shingles").repartition(width, "a", "b").sortWithinPartitions("a", "b", "node")
    judged, seen = watched(cut, met.mapInArrow(compare, "a bigint, b bigint, ok boolean"), F.count_if(~F.col("ok")).alias("bad"))
    return judged, seen["bad"] or 0


def _of_rows(packed: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The rows that ``wanted`` (id, hash, ...) names; its further columns come along. Broadcast if they are few."""
    named = wanted.select(F.col("id").alias("__id"), F.col("hash").alias("__hash"), *(c for c in wanted.columns if c not in ("id", "hash")))
    return packed.join(F.broadcast(named) if n <= BROADCAST_ROWS else named, F.col("id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash"))).drop("__id", "__hash")


def groups(nodes: DataFrame, texts_of: Callable[[DataFrame, int], DataFrame], cut: Cut, radius: int = STAGE_RADIUS, size: int = STAGE_SHINGLE, parts: tuple[int, ...] = PARTS) -> DataFrame:
    """(node, root) of all nodes (node, *MARKS), different texts: the groups that verified links make.

    ``texts_of(nodes, n)`` gives (node, text) of n nodes, a node more than once if its row repeats. Each round verifies the candidates that buckets propose. A round after the
    first looks again at groups in which a candidate was refuted, passes over what is refuted, and proposes 16 times as
    many links between two trees, until nothing is proposed. Proposed links span all candidates, so what is left to find lies
    within the components of the first round's: the texts of one meet in a bucket, one row each; those of components of more
    than TOGETHER texts meet by keys of all bits again, so that no task has all pairs of one.
    """
    spark = nodes.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, both = bit_statistics(nodes.select("fp"))
    bits, limits = plan(n, both, parts, radius)
    coarse = coarse_bits(n, both, bits)
    keyed = probes(nodes.select("node", *MARKS, F.col("node").alias("root")), coarse, limits).select("part", "key", "node", *MARKS, "root")
    refuted, tries, tree, shapes = None, 1, None, None
    while True:
        edges, seen = watched(cut, candidates(keyed, width, radius, tries, bits, limits, coarse), F.count(F.lit(1)).alias("n"))
        if not seen["n"]:
            break
        ends, some = watched(cut, edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), F.count(F.lit(1)).alias("n"))
        judged, wrong = similar(edges, seen["n"], texts_of(ends, some["n"]), cut, size)
        cut.drop(ends)
        good = judged.filter("ok").select("a", "b")
        tree = components(good if tree is None else tree.toDF("a", "b").unionByName(good), cut)
        if not wrong:
            break
        bad = judged.filter("NOT ok").select("a", "b")
        refuted = bad if refuted is None else refuted.unionByName(bad)
        # A round proposes links between all that hangs together, so groups have candidates left only where a refuted one
        # stands between two of them: these groups are looked at again.
        roots = [tree.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in ("a", "b")]
        between = bad.join(roots[0], "a", "left").join(roots[1], "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).filter("a <> b")
        hit = between.select(F.explode(F.array("a", "b")).alias("root")).distinct()
        lost = refuted.unionByName(refuted.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("refuted"))
        rooted = nodes.join(tree, "node", "left").withColumn("root", F.coalesce("root", "node")).join(hit, "root", "left_semi")
        rooted, seen = watched(cut, rooted.join(lost, "node", "left").select("node", *MARKS, "root", "refuted"), F.count(F.lit(1)).alias("n"))
        if not seen["n"]:
            break
        if shapes is None:  # later rounds look at fewer of these nodes
            shapes = cut(shapes_of(texts_of(rooted.select("node"), seen["n"]), size))
            within = components(edges, cut).select("node", F.col("root").alias("within"))
            # The smallest node of a component is not among its rows.
            large = cut(within.groupBy("within").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= TOGETHER).select("within", F.lit(True).alias("large")))
        active = rooted.join(shapes, "node").join(within, "node", "left").withColumn("within", F.coalesce("within", "node")).join(large, "within", "left")
        active = active.select("node", *MARKS, "root", F.struct("refuted", "shape").alias("known"), "within", "large")
        met = active.filter("large IS NULL").select(F.lit(-1).alias("part"), F.col("within").alias("key"), "node", *MARKS, "root", "known")
        spread = probes(active.filter("large"), bits, limits).withColumn("part", F.col("part") + len(bits))
        keyed = met.unionByName(spread.select(*met.columns))
        tries *= 16
    if tree is None:
        return nodes.select("node", F.col("node").alias("root"))
    return nodes.select("node").join(tree, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = STAGE_SHINGLE, radius: int = STAGE_RADIUS, cut: Cut | None = None) -> DataFrame:
    """One row of each group of near-duplicates: the one of the smallest id (nulls last), of equal ids the one whose
    row hash is smallest. Returns the columns of ``docs``, whatever their names, with unchanged values.

    Equal texts are one node (by 128 bits of their hashes); nodes link as ``groups`` says, each link verified on the
    sets of ``size``-word shingles. Texts stay where they are but for those that a candidate link needs.
    """
    columns = docs.columns
    cut = cut or Cut(docs.sparkSession, "near-dedup")
    hashed = [quoted(c) for c, kind in docs.dtypes if "map<" not in kind]
    packed = docs.select(F.struct(*(quoted(c).alias(f"c{k}") for k, c in enumerate(columns))).alias("row"), quoted(doc_id).alias("id"), quoted(text).alias("text"), F.xxhash64(*hashed).alias("hash"))
    told = packed.select("id", "text", "hash", F.xxhash64("text").alias("d0"), F.xxhash64(F.lit("text"), "text").alias("d1"))
    narrow = cut(signatures(told, size=size).select("id", "hash", "d0", "d1", *(F.col("signature")[k].alias(c) for k, c in enumerate(MARKS))))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("best")
    each = narrow.groupBy("d0", "d1").agg(best, *(F.first(c).alias(c) for c in MARKS))
    nodes = cut(each.select(F.monotonically_increasing_id().alias("node"), "best", *MARKS))

    def texts_of(wanted: DataFrame, n: int) -> DataFrame:
        rows = _of_rows(packed.select("id", "hash", "text"), nodes.join(wanted, "node", "left_semi").select("best.id", "best.hash", "node"), n)
        return rows.select("node", "text")

    rooted = groups(nodes.select("node", *MARKS), texts_of, cut, radius, size)
    best = nodes.join(rooted, "node").groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.id").alias("b_id"), F.col("best.hash").alias("b_hash"))
    rows = narrow.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("n"))
    named = rows.join(best, F.col("id").eqNullSafe(F.col("b_id")) & (F.col("hash") == F.col("b_hash")), "left")
    kept, once = F.col("b_hash").isNotNull(), F.col("n") == 1
    named, seen = watched(cut, named.select("id", "hash", (kept & once).alias("once"), (kept & ~once).alias("again")), *(F.count_if(c).alias(k) for k, c in (("once", F.col("once")), ("again", F.col("again")), ("rest", ~F.col("once")))))
    # Texts are shuffled only if neither the rows that go nor those that stay are few enough to be broadcast.
    if (seen["rest"] or 0) <= BROADCAST_ROWS:
        rest = named.filter("NOT once").select(F.col("id").alias("__id"), F.col("hash").alias("__hash"))
        found = packed.join(F.broadcast(rest), F.col("id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash")), "left_anti").select("row")
    else:
        found = _of_rows(packed, named.filter("once").select("id", "hash"), seen["once"]).select("row")
    if seen["again"]:  # rows that repeat one in every column
        again = _of_rows(packed, named.filter("again").select("id", "hash"), seen["again"])
        found = found.unionByName(again.groupBy("id", "hash").agg(F.first("row").alias("row")).select("row"))
    return found.select(*(F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(columns)))
