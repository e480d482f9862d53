"""Operator 10: main text of HTML pages by a recurrent block labeller.

A page is cut into blocks: runs of text between block-level tags, with the path of open elements (names, and words of
class and id). Each block becomes a vector of hashed path words, hashed text words and a few measures; a bidirectional
LSTM, in numpy, reads the whole sequence of a page and gives every block the chance of being main text.

The model is trained here, on the driver, on about ``SAMPLE_PAGES`` pages (those of small hashes, twice as many at most). Labels come
from the pages themselves: blocks in an article element are main text, blocks in navigation, headers, footers, asides,
forms or elements named like them are not, the rest has no label. Each sampled page is also read in other layouts, in
which its containers are renamed and blocks of other sampled pages stand in as comments, notices and lists, so that the
labeller does not hang on one layout.

Defined results: a null or empty page has an empty text; broken and unclosed tags are read as browsers do in the main
(an open paragraph ends where a block begins, stray end tags are left out); pages are read whole; repeated rows give
the same text each; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_sample, map_column, one_blas_thread, table

SAMPLE_PAGES, TRAIN_BLOCKS = 192, 48
PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 64, 32, 8, 16
WIDTH = PATH_DIM + WORD_DIM + MEASURES

COMMENT_END = "-->"
TAG = re.compile(r"(/?)([A-Za-z][^\s/>]*+)([^>=]*+(?:=(?:\s*+(?:\"[^\"]*+\"|'[^']*+'))?+[^>=]*+)*+)>")
NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements inside a run of text; all others begin and end blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in ("script", "style", "textarea", "noscript", "template", "iframe", "svg", "select", "object")}
#: A start tag of the key ends an open element of the values.
ENDS = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",), "body": ("head",)}
#: Ends of paragraphs and cells do not reach beyond these.
SCOPE = frozenset("ul ol dl table div section article main aside nav header footer form body html td th blockquote".split())


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


@dataclass
class _Open:
    name: str
    words: tuple[str, ...] = field(default=())


def name_words(attributes: str) -> tuple[str, ...]:
    """Lower-cased words of class, id and role."""
    out: list[str] = []
    for m in NAMED.finditer(attributes):
        out += re.findall(r"[a-z0-9]+", (m[2] or m[3] or m[4] or "").lower())
    return tuple(out)


def blocks(html: str | None) -> list[Block]:
    """The non-empty blocks of a page in page order."""
    html = html or ""
    out: list[Block] = []
    stack: list[_Open] = []
    text: list[str] = []
    linked = anchors = 0

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join(unescape("".join(text)).split())
            if words:
                out.append(Block(tuple(w for o in stack if o.name not in INLINE for w in (o.name, *(f".{x}" for x in o.words))), words, linked))
            text.clear()
        linked = 0

    def close(names: tuple[str, ...], scope: frozenset[str] = SCOPE) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].name in names:
                del stack[k:]
                return
            if stack[k].name in scope:
                return

    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            text.append(html[at:lt])
            if anchors:
                linked += lt - at
        if lt == size:
            break
        m = TAG.match(html, lt + 1)
        if m is None:
            if html.startswith("!--", lt + 1):
                end = html.find(COMMENT_END, lt + 4)
                at = size if end < 0 else end + 3
            elif html[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = html.find(">", lt)
                at = size if end < 0 else end + 1
            elif html[lt + 1 : lt + 2].isalpha():
                at = size  # a tag that never ends
            else:
                text.append("<")
                at = lt + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            if name in INLINE:
                anchors = max(0, anchors - (name == "a"))
                continue
            flush()
            if name != "br":
                close((name,), frozenset() if name in SCOPE else SCOPE)
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in RAW:
            end = RAW[name].search(html, at)
            at = size if end is None else end.end()
            continue
        if name in INLINE:
            anchors += name == "a"
            continue
        flush()
        anchors = 0
        close(ENDS.get(name, ("p", "h1", "h2", "h3", "h4", "h5", "h6") if name not in VOID else ()))
        if name not in VOID and not m[3].endswith("/"):
            stack.append(_Open(name, name_words(m[3])))
    flush()
    return out


# ---------------------------------------------------------------- labels and layouts for training

#: Names of elements and words of class or id that mark what is not main text.
APART = frozenset("nav header footer aside form menu head title".split())
APART_WORDS = frozenset("ad ads advert advertisement sponsored promo sidebar comment comments reply cookie consent notice banner menu nav navbar breadcrumb footer header related share social newsletter subscribe login popup widget".split())
MAIN = frozenset(("article", "main"))


def silver(path: tuple[str, ...]) -> int:
    """1 main text, 0 apart, -1 unknown."""
    if any(p in APART or p[:1] == "." and p[1:] in APART_WORDS for p in path):
        return 0
    return 1 if any(p in MAIN for p in path) else -1


MAIN_LAYOUTS = (("article",), ("main",), ("main", "article"), ("article", ".post"), ("div", ".content"), ("div", ".article", "div", ".body"), ("section", ".article"), ("div", ".entry", ".content"), ("div", ".post"), ("div", ".story"), ("main", "div", ".main", ".text"))
APART_LAYOUTS = (
    ("nav", "ul", "li"), ("div", ".menu", "ul", "li"), ("header",), ("div", ".header"), ("footer",), ("div", ".footer"), ("aside",), ("aside", ".sidebar"), ("div", ".sidebar"), ("div", ".ad"), ("div", ".ads"),
    ("div", ".advert"), ("div", ".sponsored"), ("div", ".cookie", ".notice"), ("div", ".notice"), ("div", ".banner"), ("form",), ("form", ".newsletter"), ("div", ".related", "ul", "li"), ("ul", ".breadcrumb", "li"),
    ("section", ".comments", "p"), ("div", ".comments", "div", ".comment"), ("ol", ".comment", ".list", "li"), ("div", ".comment", "p"), ("div", ".share"), ("div", ".login"), ("div", ".popup"), ("div", ".widget"),
)


def other_layout(page: list[Block], others: list[Block], r: np.random.Generator) -> list[Block]:
    """The page with its containers renamed, and blocks of other pages added apart from the main text."""
    main = [b for b in page if silver(b.path) == 1]
    apart = [b for b in page if silver(b.path) == 0]
    inner = MAIN_LAYOUTS[r.integers(len(MAIN_LAYOUTS))]
    body = ("html", "body") + (() if r.random() < 0.5 else ("div", ".page"))

    def dress(bs: list[Block]) -> list[Block]:
        out: list[Block] = []
        while bs:
            k = int(r.integers(1, 7))
            layout = APART_LAYOUTS[r.integers(len(APART_LAYOUTS))]
            inside = inner if r.random() < 0.2 else ()
            for b in bs[:k]:
                out.append(Block(body + inside + layout, b.text, len(b.text) if layout[0] == "nav" else b.linked))
            bs = bs[k:]
        return out

    def some(n: int) -> list[Block]:
        return [others[i] for i in r.integers(0, len(others), int(r.integers(0, n)))]

    middle = [Block(body + inner + b.path[-1:], b.text, b.linked) for b in main]
    at = int(r.integers(0, len(middle) + 1))
    return dress(apart[: len(apart) // 2] + some(5)) + middle[:at] + dress(some(2)) + middle[at:] + dress(some(8) + apart[len(apart) // 2 :])


# ---------------------------------------------------------------- vectors


def _slot(word: str, dims: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode("utf-8", "replace"))
    return h % dims, 1.0 if h >> 16 & 1 else -1.0


def vectors(page: list[Block]) -> np.ndarray:
    x = np.zeros((len(page), WIDTH), np.float32)
    slots: dict[str, tuple[int, float]] = {}
    for k, b in enumerate(page):
        for p in b.path:
            at = slots.get("\0" + p)
            if at is None:
                at = slots["\0" + p] = _slot(p, PATH_DIM)
            x[k, at[0]] += at[1]
        words = b.text.split()
        row = [0.0] * WORD_DIM
        for w in words:
            at = slots.get(w)
            if at is None:
                at = slots[w] = _slot(w, WORD_DIM)
            row[at[0]] += at[1]
        x[k, PATH_DIM : PATH_DIM + WORD_DIM] = row
        n = len(b.text)
        x[k, PATH_DIM + WORD_DIM :] = (
            np.log1p(n) / 5,
            np.log1p(len(words)) / 4,
            min(b.linked / max(n, 1), 1.0),
            k / max(len(page) - 1, 1),
            b.text[-1] in ".!?…:;\"'",
            sum(map(b.text.count, ".,;:!?")) / max(len(words), 1),
            len(b.path) / 10,
            1.0,
        )
    x[:, :PATH_DIM] = np.clip(x[:, :PATH_DIM], -2, 2)
    words_part = x[:, PATH_DIM : PATH_DIM + WORD_DIM]
    words_part /= np.sqrt((words_part**2).sum(axis=1, keepdims=True) + 1)
    return x


# ---------------------------------------------------------------- the network


def new_model(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p["w" + d] = r.normal(0, 0.15, (WIDTH, 4 * HIDDEN)).astype(np.float32)
        p["u" + d] = r.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        p["b" + d] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)  # forget gates begin open
    p["o"] = r.normal(0, 0.15, (2 * HIDDEN, 1)).astype(np.float32)
    p["c"] = np.zeros(1, np.float32)
    return p


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def run_lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """Hidden states (time, batch, HIDDEN); masked steps carry the state on."""
    steps, batch = x.shape[:2]
    h = np.zeros((batch, HIDDEN), np.float32)
    c = np.zeros_like(h)
    z_in = x @ w + b
    out, saved = np.zeros((steps, batch, HIDDEN), np.float32), []
    for t in range(steps):
        z = z_in[t] + h @ u
        i, f, o = (sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        c2 = f * c + i * g
        tc = np.tanh(c2)
        if keep:
            saved.append((h, c, i, f, o, g, tc, m))
        h = m * (o * tc) + (1 - m) * h
        c = m * c2 + (1 - m) * c
        out[t] = h
    return out, saved


def lstm_gradients(x: np.ndarray, u: np.ndarray, saved: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dh = np.zeros_like(dout[0])
    dc = np.zeros_like(dh)
    dw, du, db = np.zeros((x.shape[2], 4 * HIDDEN), np.float32), np.zeros_like(u), np.zeros(4 * HIDDEN, np.float32)
    for t in range(len(saved) - 1, -1, -1):
        h, c, i, f, o, g, tc, m = saved[t]
        dh = dh + dout[t]
        here, dc_here = dh * m, dc * m
        dc_here = dc_here + here * o * (1 - tc * tc)
        dz = np.concatenate([dc_here * g * i * (1 - i), dc_here * c * f * (1 - f), here * tc * o * (1 - o), dc_here * i * (1 - g * g)], axis=1)
        dw += x[t].T @ dz
        du += h.T @ dz
        db += dz.sum(axis=0)
        dh = dh * (1 - m) + dz @ u.T
        dc = dc * (1 - m) + dc_here * f
    return dw, du, db


def batch_of(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
        mask[: len(p), k] = 1
    return x, mask


def chances(pages: list[np.ndarray], p: dict[str, np.ndarray]) -> list[np.ndarray]:
    """The chance of main text for every block of every page. Pages of like length run together."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        take = order[at : at + max(1, min(128, 20_000 // len(pages[order[min(at + 127, len(order) - 1)]])))]
        at += len(take)
        x, mask = batch_of([pages[k] for k in take])
        fwd, _ = run_lstm(x, mask, p["wf"], p["uf"], p["bf"])
        bwd, _ = run_lstm(x[::-1], mask[::-1], p["wb"], p["ub"], p["bb"])
        y = sigmoid(np.concatenate([fwd, bwd[::-1]], axis=2) @ p["o"] + p["c"])[:, :, 0]
        for j, k in enumerate(take):
            out[k] = y[: len(pages[k]), j]
    return out


def step(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, y: np.ndarray, known: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss over the known labels and its gradients."""
    fwd, sf = run_lstm(x, mask, p["wf"], p["uf"], p["bf"], True)
    bwd, sb = run_lstm(x[::-1], mask[::-1], p["wb"], p["ub"], p["bb"], True)
    both = np.concatenate([fwd, bwd[::-1]], axis=2)
    z = (both @ p["o"] + p["c"])[:, :, 0]
    q, n = sigmoid(z), max(known.sum(), 1)
    loss = float((known * (np.logaddexp(0, z) - y * z)).sum() / n)
    dz = ((q - y) * known / n)[:, :, None].astype(np.float32)
    g = {"o": (both.reshape(-1, 2 * HIDDEN).T @ dz.reshape(-1, 1)), "c": dz.sum(axis=(0, 1))}
    dboth = dz @ p["o"].T
    g["wf"], g["uf"], g["bf"] = lstm_gradients(x, p["uf"], sf, dboth[:, :, :HIDDEN])
    g["wb"], g["ub"], g["bb"] = lstm_gradients(x[::-1], p["ub"], sb, dboth[::-1, :, HIDDEN:])
    return loss, g


def fit(pages: list[list[Block]], steps: int = 220, rate: float = 0.02, seed: int = 11) -> dict[str, np.ndarray]:
    """Adam over batches of pages, half as they are, half in other layouts; long pages by windows."""
    p, r = new_model(), np.random.default_rng(seed)
    pages = [b for b in pages if b]
    others = [b for page in pages for b in page]
    if not pages:
        return p
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    for t in range(1, steps + 1):
        chosen = []
        for k in r.integers(0, len(pages), 16):
            page = pages[k] if r.random() < 0.5 else other_layout(pages[k], others, r) or pages[k]
            start = int(r.integers(0, max(1, len(page) - TRAIN_BLOCKS + 1)))
            chosen.append((page, start))
        x, mask = batch_of([vectors(page)[s : s + TRAIN_BLOCKS] for page, s in chosen])
        y, known = np.zeros_like(mask), np.zeros_like(mask)
        for j, (page, s) in enumerate(chosen):
            for i, b in enumerate(page[s : s + TRAIN_BLOCKS]):
                label = layout_label(b.path)
                y[i, j], known[i, j] = max(label, 0), label >= 0
        _, g = step(p, x, mask, y, known)
        norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
        pace = rate * min(1, 2 * (steps - t + 1) / steps)
        for k in p:
            v = g[k] * min(1, 5 / (norm + 1e-9))
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.99 * m2[k] + 0.01 * v * v
            p[k] -= (pace * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return p


def layout_label(path: tuple[str, ...]) -> int:
    """silver(), with the containers of MAIN_LAYOUTS too."""
    label = silver(path)
    if label < 0:
        joined = " ".join(path)
        return 1 if any(" ".join(m) in joined for m in MAIN_LAYOUTS) else -1
    return label


def train(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> dict[str, np.ndarray]:
    """A model from the bounded sample; its pages, about SAMPLE_PAGES, reach the driver."""
    some = hashed_sample(pages.select(F.col(page_id).alias("id"), F.col(html).alias("html")), "id", "blocks", SAMPLE_PAGES).limit(2 * SAMPLE_PAGES)
    return fit([blocks(r.html) for r in sorted(some.collect(), key=lambda r: (r.id is None, r.id or 0, r.html or ""))])


def extract(pages: DataFrame, html: str = "html", target: str = "main_text", model: dict[str, np.ndarray] | None = None, page_id: str = "page_id") -> DataFrame:
    """Adds the main text: the blocks that the labeller takes, one on each line."""
    p = train(pages, page_id, html) if model is None else model

    def texts(rows: list[str | None]) -> list[str]:
        cut = [blocks(h) for h in rows]
        found = chances([vectors(b) for b in cut], p)
        return ["\n".join(b.text for b, y in zip(bs, ys) if y > 0.5) for bs, ys in zip(cut, found)]

    def make() -> Callable[[list], list]:
        one_blas_thread()
        return texts

    return map_column(pages, html, target, pa.string(), "string", make)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
