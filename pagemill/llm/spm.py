"""SentencePiece encoding and decoding.

The vocabulary comes from a public model file (a path parameter), read with a small parser of its
wire format. An Aho-Corasick automaton over the pieces walks a text once; at each position the
output links list the pieces that end there, from longest to shortest, and each relaxes the best
score of that position (Viterbi). Characters that no piece covers cost ``UNKNOWN_PENALTY`` below
the least score and become byte pieces, or the unknown piece where the vocabulary has no bytes.

No piece crosses from another character to the blank mark, nor holds a character that only bytes
cover, so a text falls into words that are segmented alone and remembered (in a bounded table);
the result is that of one pass over the whole text, with exact sums for texts of any length.

Null text: null ids. Empty text: no ids. Decoding gives the text back, but for the mark U+2581
itself, which decodes to a blank.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_pass, quoted

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of one message in wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) in the order of ids."""
    out = []
    for number, value in _fields(open(path, "rb").read()):
        if number == 1:
            parts = dict(_fields(value))
            score = struct.unpack("<f", parts[2])[0] if 2 in parts else 0.0
            out.append((parts.get(1, b"").decode(), score, parts.get(3, NORMAL)))
    return out


class Automaton:
    """Aho-Corasick over pieces: ``goto``, ``fail``, the piece of a node, and the output link."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        self.goto: list[dict[str, int]] = [{}]
        self.piece: list[tuple[int, int, float] | None] = [None]
        for text, (number, score) in pieces.items():
            node = 0
            for c in text:
                if c not in self.goto[node]:
                    self.goto[node][c] = len(self.goto)
                    self.goto.append({})
                    self.piece.append(None)
                node = self.goto[node][c]
            self.piece[node] = (len(text), number, score)
        self.fail = [0] * len(self.goto)
        self.output = [0] * len(self.goto)
        queue = list(self.goto[0].values())
        for node in queue:  # breadth first: the list grows while it is read
            for c, child in self.goto[node].items():
                back = self.fail[node]
                while back and c not in self.goto[back]:
                    back = self.fail[back]
                self.fail[child] = self.goto[back].get(c, 0)
                queue.append(child)
            link = self.fail[node]
            self.output[node] = link if self.piece[link] else self.output[link]

    def matches(self, text: str) -> Iterator[tuple[int, int]]:
        """(end, node) for every position: the longest piece or prefix that ends there."""
        node = 0
        for end, c in enumerate(text, 1):
            while node and c not in self.goto[node]:
                node = self.fail[node]
            node = self.goto[node].get(c, 0)
            yield end, node


class SentencePiece:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str, cache_words: int = 300_000):
        pieces = read_pieces(path)
        self.texts = [p for p, _, _ in pieces]
        usable = {p: (i, s) for i, (p, s, k) in enumerate(pieces) if k in (NORMAL, USER)}
        self.automaton = Automaton(usable)
        self.unknown = next(i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN)
        self.byte_ids = {int(p[3:-1], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.silent = {i for i, (_, _, k) in enumerate(pieces) if k in (CONTROL, UNUSED)}
        self.unknown_score = min((s for _, s, k in pieces if k == NORMAL), default=0.0) - UNKNOWN_PENALTY
        inner = any(MARK in p.lstrip(MARK) for p in usable)
        lines = "" if any("\n" in p for p in usable) else "\n"
        # A word: marks and what follows them up to the next mark or line end.
        self.words = None if inner else re.compile(f"{lines}|{MARK}*[^{MARK}{lines}]+|{MARK}+" if lines else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.cache: dict[str, tuple[int, ...]] = {}
        self.cache_words = cache_words

    def viterbi(self, text: str) -> tuple[int, ...]:
        """Ids of the best segmentation; ties go to the longer last piece."""
        auto, low = self.automaton, float("-inf")
        best = [low] * (len(text) + 1)
        back: list[tuple[int, int]] = [(0, 0)] * (len(text) + 1)
        best[0] = 0.0
        for end, node in auto.matches(text):
            single = False
            link = node if auto.piece[node] else auto.output[node]
            while link:
                size, number, score = auto.piece[link]
                single |= size == 1
                if (total := best[end - size] + score) > best[end]:
                    best[end], back[end] = total, (size, number)
                link = auto.output[link]
            if not single and (total := best[end - 1] + self.unknown_score) > best[end]:
                best[end], back[end] = total, (1, -1)
        out, at = [], len(text)
        while at:
            size, number = back[at]
            if number < 0:
                raw = text[at - 1].encode("utf-8", "surrogatepass")
                out += [self.byte_ids[b] for b in reversed(raw)] if self.byte_ids else [self.unknown]
            else:
                out.append(number)
            at -= size
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        """Ids of a text; a blank is put before a text that isn't empty."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if self.words is None:
            return list(self.viterbi(marked))
        out: list[int] = []
        cache = self.cache
        for word in self.words.findall(marked):
            ids = cache.get(word)
            if ids is None:
                ids = self.viterbi(word)
                if len(word) < 200:
                    if len(cache) >= self.cache_words:
                        cache.clear()
                    cache[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, runs of byte pieces as UTF-8, the first blank dropped."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.silent:
                out.append(self.texts[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def load(path: str) -> SentencePiece:
    """One vocabulary for each Python worker."""
    return SentencePiece(path)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, ids, n_tokens. ``model_path`` is a file that every executor has."""
    base = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            ids = [None if t is None else model.encode(t) for t in batch.column("text").to_pylist()]
            counts = pa.array([None if x is None else len(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int32())), counts], names=["id", "ids", "n_tokens"])

    out = arrow_pass(base, run, f"id {dict(base.dtypes)['id']}, ids array<int>, n_tokens long")
    return out.withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: id_col, ids, text."""
    base = encoded.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(ids_col)).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("ids"), pa.array(texts, pa.string())], names=["id", "ids", "text"])

    out = arrow_pass(base, run, f"id {dict(base.dtypes)['id']}, ids array<int>, text string")
    return out.withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, ids, n_tokens, round_trip (whether the ids decode to the text; null for a null text)."""
    base = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids = [None if t is None else model.encode(t) for t in texts]
            # The mark itself decodes to a blank.
            same = [None if t is None else model.decode(x) == t.replace(MARK, " ") for t, x in zip(texts, ids, strict=True)]
            counts = pa.array([None if x is None else len(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(ids, pa.list_(pa.int32())), counts, pa.array(same, pa.bool_())],
                names=["id", "ids", "n_tokens", "round_trip"],
            )

    out = arrow_pass(base, run, f"id {dict(base.dtypes)['id']}, ids array<int>, n_tokens long, round_trip boolean")
    return out.withColumnRenamed("id", id_col)
