import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallymart.llm import quality


def brute(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words the long way."""
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit))


TEXTS = [None, "", " \n\t", "one", "a b c a b c", "x\nx\n\nx \n x", "é#$ ñ ñ 日本", "a a a a a", "w " * 2000, "\x0b\x0cq\rz", "a b c"]


@pytest.mark.parametrize("text", TEXTS)
def test_measures(text):
    assert quality.measure(text)[:5] == brute(text)


def test_ledger_policies_and_ablations(spark):
    clean = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    docs = [(1, clean, 5), (2, clean + " ### $$$ ***" * 9, 6), (3, "short", 7), (4, None, None), (5, "la la la " * 40, 1), (5, "la la la " * 40, 1)]
    rows = quality.ledger(spark.createDataFrame(docs, "doc_id long, text string, n_words int")).cache()
    assert rows.count() == 6 and {"doc_id", "text", "n_words", "quality"} == set(rows.columns)
    kept = {r.doc_id for r in rows.filter(quality.passes("prose-1")).collect()}
    assert kept == {1}
    assert {r.doc_id for r in rows.filter(quality.passes("base-1")).collect()} == {1, 2}
    got = {r.rule: r for r in quality.ablations(rows, "prose-1").collect()}
    bits = [r.b for r in rows.select(F.col("quality.fail_bits").alias("b")).collect()]
    for rule in quality.RULES:
        bit = 1 << rule.bit
        assert got[rule.name].n_failed == sum(bool(b & bit) for b in bits)
        assert got[rule.name].n_failed_alone == sum(b == bit for b in bits)
        assert got[rule.name].n_kept_without == sum(not b & ~bit for b in bits)
    by = quality.failures_by(rows, "doc_id").collect()
    assert len(by) == 5
    assert quality.ledger(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf):
    from tallymart.llm.common import table

    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    rows = quality.op1_quality_rules(spark, sf).collect()
    assert len(rows) == len(texts)
    short = {k: v for k, v in texts.items() if len(v) < 3000}
    for r in rows:
        if r.doc_id in short:
            b = brute(short[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
            assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0])
            assert not (r.base_failed and r.kept)


def test_clean_documents_stay(spark, sf):
    from tallymart.llm.common import table

    rows = quality.op1_quality_rules(spark, sf).join(table(spark, sf, "labels"), "doc_id").filter(~F.col("base_failed"))
    assert rows.filter((F.col("quality") == 1) & ~F.col("kept")).count() == 0
    assert rows.filter((F.col("quality") == 0) & F.col("kept")).count() == 0
