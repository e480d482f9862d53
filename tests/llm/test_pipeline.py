from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tallymart.llm import bpe, mixing, pii, quality, simhash
from tallymart.llm.common import Cut, table
from test_simhash import brute_groups, shingle_set

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain(rows):
    """The pipeline without Spark, all pairs compared; {doc_id: ids}. No span is added beyond the patterns here."""
    rows = [r for r in rows if not any(eval(x.fails, {}, dict(zip(quality.MEASURES, quality.measure(r.text)))) for x in quality.RULES)]
    group = brute_groups({i: r.text for i, r in enumerate(rows)})
    kept = {}
    for i, r in enumerate(rows):
        best = kept.get(group[i])
        if best is None or r.doc_id < best.doc_id:
            kept[group[i]] = r
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(bpe.vocabulary_of()), special_tokens={})
    out = {}
    for r in kept.values():
        text, at, parts = r.text, 0, []
        for a, b, k in pii.base_spans(text):
            if a >= at:
                parts += [text[at:a], f"<{pii.KINDS[k].upper()}>"]
            at = max(at, b)
        out[r.doc_id] = e.encode_ordinary("".join(parts) + text[at:])
    return out


def test_against_plain_version(spark, sf):
    rows = table(spark, sf, "documents").collect()
    got = corpus_pipeline.run(spark, sf).collect()
    want = plain(rows)
    assert {r.doc_id: r.ids for r in got} == want and len(got) == len(want)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "PII", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == COLUMNS
    mixed = corpus_pipeline.mix_sources(spark, docs, sf)
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in docs.collect())


@pytest.mark.parametrize("empty", [True, False])
def test_nulls_repeats_and_empty(spark, empty):
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)) + " a.b@c.de"
    rows = [(1, text, "en", None, 1), (1, text, "en", None, 1), (None, text, None, "s", None), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (None, text.replace("word", "other"), "en", "s", 5)]
    docs = spark.createDataFrame([] if empty else rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, None)
    got = docs.collect()
    assert len(got) == (0 if empty else 2)
    assert empty or {r.doc_id for r in got} == {1, None}


CLASHES = ["quality", "pii", "ids", "decoded", "mix_source", "mix_slot", "nth", "offset", "__fp", "__row", "_row", "fp", "hash", "id", "c0", "row", "group", "from", "IDS_", "both"]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_columns_of_any_name_pass_unchanged(spark, sf, name, stage):
    docs = table(spark, sf, "documents")
    wide = docs.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHES), F.lit(1).alias("a.b"))
    got = stage(spark, wide, sf)
    assert got.columns == wide.columns
    rows = got.collect()
    assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHES)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in stage(spark, docs, sf).collect())
    assert corpus_pipeline.encode(spark, wide, sf).count() == docs.count()


def test_mixed_order_reaches_the_result(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    corpus_pipeline.mix_sources(spark, docs, sf).write.parquet(f"{tmp_path}/m")
    got = corpus_pipeline.encode(spark, spark.read.parquet(f"{tmp_path}/m"), sf).orderBy("mix_file", "mix_row").collect()
    at = {r.doc_id: (r.mix_slot, r.mix_place) for r in mixing.mix(docs).collect()}
    placed = [at[r.doc_id] for r in got]
    assert placed == sorted(placed) and len(placed) == docs.count()


def test_recall_of_near_copies(spark):
    """Different texts that pass the rules: of the pairs with a Jaccard similarity of 0.8 or more on five words, found by
    shared shingles, nine in ten end in one group, and no group holds what such pairs do not connect."""
    docs = corpus_pipeline.quality_rules(spark, table(spark, "/root/testdata/sf0.1", "documents"), None).dropDuplicates(["text"]).select("doc_id", "text")
    docs = Cut(spark, "recall")(docs)
    sets = {r.doc_id: frozenset(shingle_set(r.text)) for r in docs.collect()}
    holders, pairs = {}, set()
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in holders[x] if j > i).items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                pairs.add((i, j))
    cut = Cut(spark, "recall")
    nodes = cut(simhash.signatures(docs).select(F.col("doc_id").alias("node"), *(F.col("signature")[k].alias(c) for k, c in enumerate(simhash.MARKS))))
    texts = docs.select(F.col("doc_id").alias("node"), "text")
    group = {r.node: r.root for r in simhash.groups(nodes, lambda wanted, n: texts.join(wanted, "node", "left_semi"), cut).collect()}
    found = sum(group[i] == group[j] for i, j in pairs)
    print("near pairs", len(pairs), "found", found)
    assert len(pairs) > 40 and found >= 0.9 * len(pairs)
    linked = {i: {i} for i in sets}
    for i, j in pairs:
        if group[i] == group[j] and linked[i] is not linked[j]:
            small, large = sorted((linked[i], linked[j]), key=len)
            large |= small
            for k in small:
                linked[k] = large
    members = Counter(group.values())
    assert all(len(linked[i]) == members[g] for i, g in group.items())


def test_files_of_any_name(spark):
    got = corpus_pipeline.encode(spark, table(spark, "/root/testdata/sf0.001", "documents"), None).collect()
    assert got and all(r.mix_file is None and r.mix_row is not None for r in got)
