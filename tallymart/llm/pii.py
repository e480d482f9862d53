"""Operator 4: personal data by patterns and a skip-chain conditional random field.

Patterns with checks find the base spans of four kinds. A conditional random field then labels the places of a text
that look like personal data but missed a pattern (a phone number without its plus sign, a number that repeats one
found elsewhere in other punctuation). Its nodes are these candidates and the base spans, whose labels are known; its
edges join neighbours, and, however far apart, mentions with the same or a similar normal form. Three or more mentions
of one form are joined through one more node, which stands for the form, so edges grow with mentions and every mention
is two steps from every other. Loopy belief propagation spreads what is known along the edges until messages settle; a
candidate becomes a span if one kind is sure enough. Base spans always stay.

The weights of a node's features come from a logistic model that is trained here, on the driver, by numpy: its rows
are base spans and candidates of about ``SAMPLE_DOCS`` documents (those of small hashes) and at most ``SAMPLE_ROWS``
rows of these. The checks (digit sums, ranges, the plus sign) are not among the features, so that the
model learns what the kinds look like. Weights of edges are fixed parameters.

Defined results: a null or empty text has no spans; offsets are code points; repeated rows get the same spans each;
texts are read whole; an empty table gives no rows (the model is then all zeros); the input's
columns pass through unchanged (if one is called like the new column, that one comes under the first free name of
name_, name__ ...); of overlapping spans of one start the kind first listed comes first.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_sample, map_column, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SAMPLE_DOCS, SAMPLE_ROWS = 10_000, 20_000
#: Log-potentials of agreement: same normal form, similar form, next candidate. A belief of SURE makes a span.
SAME, SIMILAR, NEXT, SURE, NEAR_CHARS = 5.0, 3.5, 0.3, 0.9, 60
#: Propagation ends when no message changes by more; the rounds guard against fields that never settle.
SETTLED, ROUNDS = 1e-6, 1000

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: A match can only begin where a run of digits does, so the rest of a run is not tried.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOOSE_NUMBER = re.compile(r"(?<![0-9A-Za-z_@.+-])\(?[0-9](?:[\x20().-]{0,2}[0-9])+(?![0-9A-Za-z_@])")
LOOSE_MAIL = re.compile(r"(?<![^\x20\x09-\x0D<>()\[\],;\"'])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]++(?![^\x20\x09-\x0D<>()\[\],;\"'])")

Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches without overlap, one for each at-sign at most: a match holds the whole run of local
    characters before its at-sign, as far as no earlier match reaches."""
    out, after, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), 0))
            after = m.end()
        else:
            after = max(after, at + 1)
        at = text.find("@", max(at + 1, after))
    return out


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[Span]:
    """The spans of the patterns that pass their checks, by start, then kind."""
    out: list[Span] = emails(text) if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = re.sub("[^0-9]", "", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Places that look like personal data and do not touch a base span."""
    found = [m.span() for m in LOOSE_MAIL.finditer(text)] if "@" in text else []
    for m in LOOSE_NUMBER.finditer(text):
        digits = len(re.sub("[^0-9]", "", m[0]))
        if 9 <= digits <= 19 and text[m.end() : m.end() + 1] not in _MORE and text[m.start() - 1 : m.start()] not in _MORE:
            found.append(m.span())
    out, k, reach = [], 0, 0
    for a, b in sorted(found):
        while k < len(base) and base[k][0] < b:
            reach = max(reach, base[k][1])
            k += 1
        if a >= reach:
            out.append((a, b))
            reach = b
    return out


_MORE = frozenset("/:=#\\")
CUES = (
    ("mail", "email", "e-mail", "correo", "courriel", "contact"),
    ("ip", "host", "server", "addr", "address"),
    ("card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta"),
    ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono", "whatsapp", "sms"),
)
WIDTH = 8 + 20 + 5 + len(CUES)


def features(text: str, start: int, end: int) -> np.ndarray:
    """What a mention looks like, the plus sign and all checks left out."""
    s, x = text[start:end], np.zeros(WIDTH)
    digits = sum("0" <= c <= "9" for c in s)
    x[:8] = 1, "@" in s, " " in s, "-" in s, "(" in s, "." in s, digits > 0, s.strip("0123456789") == ""
    x[8 + min(digits, 19)] = 1
    x[28 + min(s.count("."), 4)] = 1
    before = text[max(0, start - 24) : start].lower()
    words = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", before)[-2:]
    for k, cue in enumerate(CUES):
        x[33 + k] = any(w in cue for w in words)
    return x


def forms(text: str, start: int, end: int) -> tuple[str, str]:
    """Normal form and similar form: an address and its local part, all digits and the last seven."""
    s = text[start:end]
    if "@" in s:
        s = s.lower().strip(".")
        return "m" + s, "l" + s.partition("@")[0]
    digits = re.sub("[^0-9]", "", s)
    return "d" + digits, "s" + digits[-7:]


def allowed(s: str) -> np.ndarray:
    """Labels that a mention can have by its characters."""
    if "@" in s:
        return np.array([1, 1, 0, 0, 0], bool)
    digits = sum("0" <= c <= "9" for c in s)
    return np.array([1, 0, s.count(".") == 3 and not set(s) & set(" ()-"), 12 <= digits <= 19, 9 <= digits <= 15], bool)


def through(weight: float) -> float:
    """Weight of edges to a shared node by which two mentions agree just as along one edge of ``weight``."""
    g = np.exp(weight)
    return float(np.log(g + np.sqrt(g * g + (len(LABELS) - 2) * g - (len(LABELS) - 1))))


def edges(text: str, nodes: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs of nodes (sorted by place), their weights, and how many nodes stand for forms; those follow the others."""
    out: dict[tuple[int, int], float] = {}
    total = len(nodes)

    def join(members: list[int], weight: float) -> int:
        """The node that stands for the members: the first, or a new one."""
        nonlocal total
        if len(members) < 3:
            if len(members) == 2:
                out[members[0], members[1]] = weight
            return members[0]
        total += 1
        out.update(((i, total - 1), through(weight)) for i in members)
        return total - 1

    same: dict[str, list[int]] = {}
    similar: dict[str, dict[str, None]] = {}
    own = [forms(text, a, b) for a, b in nodes]
    for j, (form, like) in enumerate(own):
        same.setdefault(form, []).append(j)
        similar.setdefault(like, {})[form] = None
        if j and nodes[j][0] - nodes[j - 1][1] <= NEAR_CHARS and like != own[j - 1][1]:
            out[j - 1, j] = NEXT
    stands = {form: join(members, SAME) for form, members in same.items()}
    for alike in similar.values():
        join([stands[form] for form in alike], SIMILAR)
    return np.array(list(out), np.int64).reshape(-1, 2), np.array(list(out.values())), total - len(nodes)


def propagate(unary: np.ndarray, pairs: np.ndarray, weights: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Beliefs of the nodes by loopy sum-product in log space; every edge rewards equal labels by its weight."""
    n, k = unary.shape
    src, dst = np.r_[pairs[:, 0], pairs[:, 1]], np.r_[pairs[:, 1], pairs[:, 0]]
    back = np.r_[np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))]
    gain = np.expm1(np.r_[weights, weights])[:, None]
    message = np.zeros((len(src), k))
    for _ in range(rounds if len(pairs) else 0):
        total = unary.copy()
        np.add.at(total, dst, message)
        into = total[src] - message[back]
        into = np.exp(into - into.max(axis=1, keepdims=True))
        new = np.log(into.sum(axis=1, keepdims=True) + gain * into)
        new -= new.max(axis=1, keepdims=True)
        step = 0.5 * (new - message)  # damped, which loops need
        message += step
        if np.abs(step).max() < SETTLED:
            break
    total = unary.copy()
    np.add.at(total, dst, message)
    total = np.exp(total - total.max(axis=1, keepdims=True))
    return total / total.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[Span], weights: np.ndarray) -> list[Span]:
    """What the field adds to the base spans."""
    loose = candidates(text, base)
    if not loose:
        return []
    nodes = sorted([(a, b, -1) for a, b in loose] + base)
    unary = np.stack([features(text, a, b) for a, b, _ in nodes]) @ weights
    unary -= unary.max(axis=1, keepdims=True)
    for i, (a, b, kind) in enumerate(nodes):
        if kind >= 0:
            unary[i] = -30
            unary[i, kind + 1] = 0
        else:
            unary[i, ~allowed(text[a:b])] = -30
    pairs, strength, more = edges(text, [n[:2] for n in nodes])
    belief = propagate(np.r_[unary, np.zeros((more, len(LABELS)))], pairs, strength)
    out = []
    for (a, b, kind), p in zip(nodes, belief):
        best = int(p[1:].argmax()) + 1
        if kind < 0 and p[best] >= SURE:
            out.append((a, b, best - 1))
    return out


def training_rows(text: str | None) -> list[tuple[int, list[float]]]:
    text = text or ""
    base = base_spans(text)
    rows = [(k + 1, features(text, a, b).tolist()) for a, b, k in base]
    return rows + [(0, features(text, a, b).tolist()) for a, b in candidates(text, base)]


def fit(x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Multinomial logistic regression by full gradients; classes weigh alike."""
    w = np.zeros((WIDTH, len(LABELS)))
    if not len(y):
        return w
    target = np.eye(len(LABELS))[y]
    share = (1 / np.maximum(target.sum(axis=0), 1))[y][:, None] * len(y) / len(LABELS)
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= rate * (x.T @ (share * (p - target)) / len(y) + decay * w)
    return w


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """Weights (features, labels) from the bounded sample. Only feature rows reach the driver."""
    some = hashed_sample(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "id", "pii", SAMPLE_DOCS)
    some = some.filter(F.col("text").rlike("[0-9@]")).select("text")
    kind = pa.list_(pa.struct([("y", pa.int32()), ("x", pa.list_(pa.float64()))]))
    rows = map_column(some, "text", "rows", kind, "array<struct<y:int,x:array<double>>>", lambda: lambda ts: [[{"y": y, "x": x} for y, x in training_rows(t)] for t in ts])
    # The rows of the smallest hashes, in their order: which rows fit the model does not depend on how they are dealt out.
    got = rows.select(F.explode("rows").alias("r")).select("r.*").orderBy(F.xxhash64("y", "x"), "y").limit(SAMPLE_ROWS).collect()
    return fit(np.array([r.x for r in got]).reshape(-1, WIDTH), np.array([r.y for r in got], int))


def find(docs: DataFrame, text: str = "text", spans: str = "pii", weights: np.ndarray | None = None, doc_id: str = "doc_id") -> DataFrame:
    """Adds an array of (kind, start, end, base), by start, then kind."""
    model = train(docs, doc_id, text) if weights is None else weights
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def one(t: str | None) -> list[dict]:
        if not t or not ("@" in t or DIGIT.search(t)):
            return []
        base = base_spans(t)
        both = [(*s, True) for s in base] + [(*s, False) for s in added_spans(t, base, model)]
        both.sort(key=lambda s: (s[0], s[2], s[1]))
        return [{"kind": KINDS[k], "start": a, "end": b, "base": is_base} for a, b, k, is_base in both]

    def make() -> Callable[[list], list]:
        return lambda texts: [one(t) for t in texts]

    return map_column(docs, text, spans, kind, "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>", make)


def redact(docs: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """Puts <KIND> in place of each span (of overlapping ones the first); drops the spans. A null text stays null."""
    # Every piece is the gap before a span that overlaps no earlier one, and its mark; the tail follows.
    t, e = F.col(text), F.col(spans)
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(s: Column, x: Column) -> Column:
        overlaps = x["start"] < s["at"]
        gap = t.substr((s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        mark = F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        return F.struct(F.when(overlaps, s["out"]).otherwise(F.concat(s["out"], gap, mark)).alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    done = F.aggregate(e, state, step)
    whole = F.concat(done["out"], t.substr((done["at"] + 1).cast("int"), F.length(t)))
    return docs.withColumn(text, F.when(F.size(e) > 0, whole).otherwise(t)).drop(spans)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["base"])
    counts = [_count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
