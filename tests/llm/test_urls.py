import re

from tallymart.llm import urls


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    host = lower(host)
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    terms = [t for t in urls.STRICT + urls.SOFT if re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", lower(rest))]
    bad = any(t in urls.STRICT for t in terms) or sum(t in urls.SOFT for t in terms) >= 2
    if fits:
        best = max(fits, key=lambda r: len(r.rule))
        return host, path, best.rule, best.verdict
    return host, path, None, "block" if bad else "allow"


URLS = [
    None, "", "nothing", "http://", "http://a.net", "HTTP://WWW.Example.ORG/en/12", "http://example.org/es/x", "http://example.org/es", "http://notexample.org/es/", "https://x.com/de/1?u=://b", "http://com/fr/",
    "http://casino-win.example.net/a", "http://mycasino.net/", "http://free.net/bets", "http://free.net/freebets", "http://free-free.net/", "http://a.net/?q=win&x=xxx", "http://FREE.net/#Win", "mailto://porn@x.net", "http://org/", "http://org", "a://b.net/" + "free/" * 9000 + "pills",
]


def test_against_brute_force(spark, sf):
    from tallymart.llm.common import table

    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, verdict_note string")
    for r in urls.judge(pages).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute(URLS[r.page_id]), URLS[r.page_id]
    given = {r.page_id: r.url for r in table(spark, sf, "pages").collect()}
    rows = urls.op9_url_filters(spark, sf).collect()
    assert len(rows) == len(given)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == brute(given[r.page_id])


def test_counts_overlaps_and_empty(spark):
    v = urls.Vocabulary(("bet", "bets", "free-bets"))
    assert v.count("free-bets bet bets alphabets") == {"free-bets": 1, "bets": 2, "bet": 1}
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_repeats_and_taken_names(spark):
    pages = spark.createDataFrame([(1, "http://casino.net/", "h", "p", "r", "t"), (1, "http://casino.net/", "h", "p", "r", "t")], "page_id long, url string, host string, PATH string, rule string, terms string")
    got = urls.judge(pages)
    assert got.columns[:6] == pages.columns and {"host_", "path_", "rule_", "terms_", "verdict"} <= set(got.columns)
    assert [(r.host, r.PATH, r.rule, r.terms, r.host_, r.verdict) for r in got.collect()] == [("h", "p", "r", "t", "casino.net", "block")] * 2
