"""Operator 3: byte-level BPE encoding and decoding.

The vocabulary is a file of byte tokens with ranks; it is read, never trained. A text is cut by the vocabulary's
pattern into pieces, and each piece is encoded on its own. Within a piece the exact merge result is found without
merging: an Aho-Corasick automaton over the tokens (bytes as Latin-1 characters) gives the longest token at each
position, and a left-to-right search takes the longest token that may stand after the previous one, falls back to the
next shorter one, and steps back where none is left. Two tokens may stand side by side if merging their bytes from
scratch gives the two back; that test, made on the parts along the border, is memoised. A position from which no way
leads on is marked and never tried again, so the work is linear in the piece.

Ids are kept as bytes of int32 from the memos on, so a text is one join of memo entries and a batch one Arrow list.

Defined results: a null or empty text has no ids and decodes to no bytes; texts are never cut short; repeated rows are
encoded each; a table without rows gives none; the input's columns pass through unchanged. A new column whose name is
taken comes under the first free one of name_, name__ and so on (see ``common.free_name``).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, map_column, table

#: Memo sizes in one worker; when one is full it starts anew, which costs time but changes no result.
MAX_PARTS, MAX_PIECES, MAX_PIECE_CHARS, MAX_PAIRS = 400_000, 200_000, 64, 600_000
#: A space within white space or at the end of a text, where cutting a text before its spaces would change the pieces.
INNER_SPACE = re.compile(r" (?:\s|\Z)")


def read_vocabulary(path: str) -> list[tuple[bytes, int]]:
    """Tokens and ranks of a vocabulary file: a base64 token and its rank on each line."""
    lines = (x.split() for x in Path(path).read_bytes().splitlines() if x)
    return [(base64.b64decode(token), int(rank)) for token, rank in lines]


class Memo(dict):
    """What ``work`` gives for a string. Met lately and before that are kept apart: what is met again moves up, the
    rest goes when the memo is full."""

    def __init__(self, work: Callable[[str], bytes], most: int):
        super().__init__()
        self.work, self.most, self.older = work, most, {}

    def __missing__(self, s: str) -> bytes:
        found = self.older.get(s)
        if found is None:
            found = self.work(s)
        if len(s) <= MAX_PIECE_CHARS:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[s] = found
        return found


class Encoder:
    """Encodes and decodes texts by a ranked byte vocabulary and a pattern."""

    def __init__(self, vocabulary: list[tuple[bytes, int]], pattern: str):
        self.find = regex.compile(pattern).findall
        self.rank = {token.decode("latin-1"): rank for token, rank in vocabulary}
        self.token = {rank: token.decode("latin-1") for token, rank in vocabulary}
        self.raw = raw_tokens(vocabulary)
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token in self.rank:
            self.trie.add_word(token, len(token))
        self.trie.make_automaton()
        self.fits: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        #: For each token, the longest token that is a proper prefix of it; -1 if there is none.
        self.shorter = {r: next((q for k in range(len(s) - 1, 0, -1) if (q := self.rank.get(s[:k])) is not None), -1) for r, s in self.token.items()}
        self.size = {r: len(s) for r, s in self.token.items()}
        self.ids = max(self.token, default=0) + 1
        self.pieces = Memo(self.piece, MAX_PIECES)
        #: The public pattern lets a piece begin with one space and holds none further on, so a text may be cut before
        #: every space that stands alone: parts are encoded apart, pieces of frequent parts are found only once.
        self.spaced = Memo(lambda part: self.by_pieces(" " + part), MAX_PARTS) if pattern == public_tokenizers.PATTERN else None

    def split(self, s: str) -> tuple[str, str] | None:
        """The two tokens whose merge makes token s; None for a single byte. By the merge rule itself: the adjacent
        pair of lowest rank first, leftmost of equals."""
        parts = list(s)
        while len(parts) > 2:
            _, at = min((self.rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def edge(self, token: int, right: bool) -> list[tuple[str, int]]:
        """What stands at an end of the token while it is being built: each part with the rank of the merge that
        ends it."""
        known = self.edges[right].get(token)
        if known is None:
            known, s, until = [], self.token[token], 1 << 60
            while s:
                known.append((s, until))
                until, parts = self.rank[s], self.split(s)
                s = parts[right] if parts else ""
            self.edges[right][token] = known
        return known

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b from scratch gives a and b: no merge over the border comes before the
        merges that take its two parts away (of equal merges, the left one comes first)."""
        known = self.fits.get(a * self.ids + b)
        if known is None:
            if len(self.fits) >= MAX_PAIRS:
                self.fits.clear()
            known, get = True, self.rank.get
            for x, x_until in self.edge(a, True):
                for y, y_until in self.edge(b, False):
                    over = get(x + y)
                    if over is not None and over < x_until and over <= y_until:
                        known = False
            self.fits[a * self.ids + b] = known
        return known

    def encode_bytes(self, s: str) -> list[int]:
        """Ids of one piece, given as Latin-1 characters of its bytes."""
        whole = self.rank.get(s)
        if whole is not None:
            return [whole]
        rank, size, shorter, fits, ids = self.rank, self.size, self.shorter, self.fits, self.ids
        longest = [0] * len(s)
        for end, n in self.trie.iter(s):  # ends ascend, so the longest match from a start is written last
            longest[end - n + 1] = n
        dead: set[int] = set()
        out: list[int] = []
        at, last, previous = 0, len(s), -1
        trial = rank[s[: longest[0]]]
        while True:
            if trial < 0:  # nothing fits here: give the position up, and try a shorter token before it
                dead.add(at)
                trial = out.pop()
                at -= size[trial]
                previous = out[-1] if out else -1
                trial = shorter[trial]
                continue
            end = at + size[trial]
            if end not in dead:
                fit = True if previous < 0 else fits.get(previous * ids + trial)
                if fit is None:
                    fit = self.may_follow(previous, trial)
                if fit:
                    out.append(trial)
                    if end == last:
                        return out
                    at, previous = end, trial
                    trial = rank[s[at : at + longest[at]]]
                    continue
            trial = shorter[trial]

    def piece(self, piece: str) -> bytes:
        return np.array(self.encode_bytes(piece.encode("utf-8", "surrogatepass").decode("latin-1")), np.int32).tobytes()

    def by_pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def packed(self, text: str | None) -> bytes:
        """Ids of a text as bytes of int32."""
        if not text:
            return b""
        if self.spaced is None or INNER_SPACE.search(text):
            return self.by_pieces(text)
        first, *parts = text.split(" ")
        return self.by_pieces(first) + b"".join(map(self.spaced.__getitem__, parts))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: list[int] | None) -> bytes:
        return b"".join(self.raw[ids].tolist()) if ids else b""


def raw_tokens(vocabulary: list[tuple[bytes, int]]) -> np.ndarray:
    """Bytes of each id; ids that the vocabulary leaves free stand for none."""
    out = np.full(max((rank for _, rank in vocabulary), default=-1) + 1, b"", object)
    for token, rank in vocabulary:
        out[rank] = token
    return out


def id_lists(packed: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def decoded_bytes(raw: np.ndarray, ids: pa.ListArray) -> pa.Array:
    tokens = raw[ids.flatten().to_numpy()].tolist()
    ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy()).tolist()
    return pa.array([b"".join(tokens[a:b]) for a, b in zip([0, *ends], ends)], pa.binary())


def vocabulary_of(name: str = "byte_bpe_50k.tiktoken") -> list[tuple[bytes, int]]:
    return read_vocabulary(public_tokenizers.path(name))


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", vocabulary: list[tuple[bytes, int]] | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds the column of token ids. The vocabulary, of a fixed size (about 1 MB), is read once and broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or vocabulary_of())

    def make() -> Callable[[list], pa.Array]:
        packed = _encoder(shared.value, pattern).packed
        return lambda texts: id_lists([packed(t) for t in texts])

    return map_column(docs, text, ids, pa.list_(pa.int32()), "array<int>", make, rows=128)


def decode(docs: DataFrame, ids: str = "ids", decoded: str = "decoded", vocabulary: list[tuple[bytes, int]] | None = None) -> DataFrame:
    """Adds the bytes that the ids stand for."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or vocabulary_of())

    def make() -> Callable[[list], pa.Array]:
        raw = raw_tokens(shared.value)
        return lambda rows: decoded_bytes(raw, pa.array(rows, pa.list_(pa.int32())))

    return map_column(docs, ids, decoded, pa.binary(), "binary", make, rows=128)


def round_trip(docs: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", vocabulary: list[tuple[bytes, int]] | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds the ids and the bytes decoded from them, in one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or vocabulary_of())
    ids, decoded = free_name(docs, ids), free_name(docs, decoded)
    both = free_name(docs, "__both")
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def make() -> Callable[[list], pa.Array]:
        encoder = _encoder(shared.value, pattern)

        def run(texts: list) -> pa.Array:
            lists = id_lists([encoder.packed(t) for t in texts])
            return pa.StructArray.from_arrays([lists, decoded_bytes(encoder.raw, lists)], fields=list(kind))

        return run

    out = map_column(docs, text, both, kind, "struct<ids:array<int>,decoded:binary>", make, rows=128)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(both)["ids"].alias(ids), F.col(both)["decoded"].alias(decoded))


_kept: dict[tuple[bytes, str], Encoder] = {}


def _encoder(vocabulary: list[tuple[bytes, int]], pattern: str) -> Encoder:
    """One encoder with its memos for each vocabulary in a worker, kept from task to task."""
    key = (hashlib.sha256(repr(vocabulary).encode()).digest(), pattern)
    if key not in _kept:
        _kept[key] = Encoder(vocabulary, pattern)
    return _kept[key]


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    return round_trip(docs.select("doc_id", "text")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
