import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tallymart.llm import pii
from tallymart.llm.common import table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = True
            if kind == "ip":
                ok = all(int(x) <= 255 for x in m[0].split("."))
            if kind == "card":
                double = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
                ok = 12 <= len(digits) <= 19 and sum(double) % 10 == 0
            if kind == "phone":
                ok = 9 <= len(digits) <= 15
            if ok:
                out.append((m.start(), k, m.end()))
    return [(a, b, k) for a, k, b in sorted(out)]


def test_base_against_the_patterns():
    r = random.Random(1)
    for alphabet in ("a@.-b", "01.9", "12 -()+.", "a1@.+ -(5"):
        for _ in range(4000):
            text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
            assert pii.base_spans(text) == brute(text), text
    for text in ["", "é a@b.c", "x@y@z.co", "a@b.c.d@e.f", "4111 1111-1111 1111", "+1 (017) 555-7713.", "1.2.3.4.5.6.7.8", "999.1.1.1", "0001.0255.3.4"]:
        assert pii.base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ["a" * 300_000 + "@", "9" * 300_000, "1." * 150_000, "+1" * 100_000, "a@" * 100_000, "@" * 200_000, "+1(" + "(" * 200_000]:
        pii.added_spans(text, pii.base_spans(text), np.zeros((pii.WIDTH, 5)))


def weights():
    """As trained where all 16-digit numbers are unsure, and numbers in brackets are phones."""
    w = np.zeros((pii.WIDTH, 5))
    w[0, 0] = 1.0
    return w


def test_repeated_and_similar_mentions_agree():
    text = "Call +1 (017) 555-7713 now. " + "Words in between. " * 200 + "Or dial 017 555 7713 again, not 999 888 1234."
    base = pii.base_spans(text)
    added = pii.added_spans(text, base, weights())
    assert [text[a:b] for a, b, _ in added] == ["017 555 7713"] and added[0][2] == 3
    assert pii.added_spans("dial 017 555 7713 again", [], weights()) == []


def test_dozens_of_repeats_agree():
    for n in (2, 9, 19, 39):
        text = "Call +1 (017) 555-7713 now. " + ("Words in between. " * 9 + "Or dial 1 017 555 7713 again. ") * n
        w = np.zeros((pii.WIDTH, 5))
        added = pii.added_spans(text, pii.base_spans(text), w)
        assert len(added) == n and {k for _, _, k in added} == {3}
    w[0, 0] = 0.3
    text = "Call +1 (017) 555-7713 now. " + ("Words in between. " * 9 + "Or dial 1 017 555 7713 again. ") * 9
    assert len(pii.added_spans(text, pii.base_spans(text), w)) == 9


def test_beliefs_on_a_tree_are_exact():
    r = np.random.default_rng(2)
    unary = r.normal(size=(4, 5))
    pairs, w = np.array([[0, 1], [1, 2], [1, 3]]), np.array([1.0, 0.5, 2.0])
    want = np.zeros((4, 5))
    for labels in np.ndindex(5, 5, 5, 5):
        p = np.exp(sum(unary[i, x] for i, x in enumerate(labels)) + sum(v for (a, b), v in zip(pairs, w) if labels[a] == labels[b]))
        for i, x in enumerate(labels):
            want[i, x] += p
    want /= want.sum(axis=1, keepdims=True)
    assert np.abs(pii.propagate(unary, pairs, w, rounds=60) - want).max() < 1e-6


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    rows = pii.op4_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id])
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[2] == k for s in base) for k in range(4))
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))


def test_redaction_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "é a.b@c.de, 1.2.3.4 and +1 (017) 555-7713!", "z"), (3, "é a.b@c.de, 1.2.3.4 and +1 (017) 555-7713!", "z"), (None, "no data here", None)], "doc_id long, text string, kind string")
    found = pii.find(docs)
    assert found.columns == ["doc_id", "text", "kind", "pii"]
    clean = pii.redact(found)
    assert clean.columns == docs.columns
    assert sorted(map(str, (r.text for r in clean.collect()))) == sorted(["None", "", "no data here", *["é <EMAIL>, <IP> and <PHONE>!"] * 2])
    assert pii.find(docs.limit(0)).count() == 0


def test_clean_documents_stay(spark, sf):
    rows = pii.op4_pii(spark, sf).join(table(spark, sf, "documents"), "doc_id")
    assert rows.filter(~F.col("text").rlike("[0-9@]") & (F.col("spans") != "")).count() == 0


def test_the_model_does_not_depend_on_the_layout(spark, sf):
    docs = table(spark, sf, "documents")
    one, other = pii.train(docs.coalesce(1)), pii.train(docs.repartition(5))
    assert np.array_equal(one, other)


def test_long_addresses_are_candidates():
    text = "write to " + "a" * 90 + "@" + ".".join(["host"] * 80) + " now"
    assert pii.LOOSE_MAIL.search(text)[0] == text[9:-4] and pii.LOOSE_MAIL.search("x" * 200_000) is None
