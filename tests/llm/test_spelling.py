import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallymart.llm import spelling
from tallymart.llm.common import table
from tallymart.llm.queries import QUERIES


def brute(docs):
    """Words, near words by shared patterns with a gap, forms and roots, without Spark."""
    count = Counter()
    for ident, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    near = {w: set() for w in n}
    gaps = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            gaps[w[:i], w[i + 1 :]].add(w)
            short = w[:i] + w[i + 1 :]
            if short in n:
                near[w].add(short)
                near[short].add(w)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-n[o], [*map(ord, o)]))
            if n[best] >= 2 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def got(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_query_against_brute_force(spark, sf):
    want = brute([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()])
    assert got(QUERIES["op13_spelling_variants"](spark, sf)) == want and len(want) > 100 and any(v[0] for v in want.values())


@pytest.mark.parametrize("pass_bytes", [spelling.PASS_BYTES, 2048])
def test_dense_words_in_one_pass_and_many(spark, pass_bytes):
    rng = np.random.default_rng(3)
    said = ["".join(rng.choice(list("abcé"), rng.integers(5, 8))) for _ in range(4000)]
    docs = [(k, " ".join(said[k * 40 : k * 40 + 40])) for k in range(100)]
    docs += [(k, w) for k, w in enumerate(["xyxyx"] * 4 + ["xyxyxy"] * 10 + ["xyxyxyx"] * 25)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert got(spelling.variants(frame, pass_bytes=pass_bytes)) == want
    assert any(v[0] and v[0] != v[1] for v in want.values())  # a form that has a form


def test_nulls_repeats_clashes_and_long_words(spark):
    long = "ab" * 3000
    docs = [(1, f"{long} {long} {long} {long}"), (2, f"{long}x {long}x {long}x {long[:-1]}c {long[:-1]}c {long[:-1]}c"), (None, "Étude étude étude etude"), (None, None), (3, ""), (3, "Straße STRASSE straße straße"), (3, "Straße STRASSE straße straße"), (4, "abcde abcd abcd abcd 12345 ____"), (5, "œuvres œuvres œuvres Ààààà")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, `a.b` int")
    assert got(spelling.variants(frame)) == brute(docs)
    assert got(spelling.variants(frame.filter("doc_id = 4"))) == {} == got(spelling.variants(frame.filter("false")))


def test_keys_of_edits_are_keys_of_the_edited_words():
    for word in ("abcdef", "ééàbc"):
        n = len(word)
        c = spelling.letters([word], n)
        term = c * spelling.powers(n)
        upto, total = np.cumsum(term, axis=1, dtype=np.uint64), term.sum(dtype=np.uint64)
        cut = upto - term + (total - upto) * spelling.INVERSE
        for i in range(n):
            assert spelling.mixed(cut[:, i], n - 1)[0] == spelling.keys_of([word[:i] + word[i + 1 :]], n - 1)[0]
            put = total + (np.uint64(ord("z")) - c[:, i]) * spelling.powers(n)[i]
            assert spelling.mixed(put, n)[0] == spelling.keys_of([word[:i] + "z" + word[i + 1 :]], n)[0]


def test_filters_know_their_keys_and_little_else(spark):
    rng = np.random.default_rng(4)
    known = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9)) for _ in range(20000)]
    vocab = spelling.vocabulary(spark.createDataFrame([(w, 3) for w in known], "word string, n long")).cache()
    filters = spelling.Filters({9: vocab.count()}, 1 << 15)
    assert len(filters.passes) > 1
    for which in filters.passes:
        for (kind, part), words in spelling.build(vocab, filters, which, 4).items():
            def share(key):
                s, block = filters.place(kind, key)
                key, block = key[s == part], block[s == part]
                assert block.max() < len(words)
                return np.mean(np.logical_and.reduce([(words[block, j] & spelling.bit(key, j)) > 0 for j in range(8)]))
            assert share(spelling.keys_of(known, 9)) == 1
            assert share(rng.integers(0, 1 << 63, 50000).astype(np.uint64) * np.uint64(2)) < 0.01
