"""Fuzzy line dedup.

Lines of ``MIN_WORDS`` words and more are normalised (A-Z lower-cased, digit runs to one zero,
punctuation dropped, white space squeezed). Equal normalised lines are one node. Candidate buckets
are ``BANDS`` bands of MinHashes, ``WORD_MINS`` of the set of words and one of the pairs of
neighbouring words, so a band is met with probability J(words)^3 * J(pairs). SimHash blocks were tried
first and lose most links at this similarity; the README gives the recall of both.
Candidates are verified by the edit
similarity of the whole normalised lines (1 - Levenshtein distance / longer length, at least
``PERCENT`` %), and of every connected group one occurrence stays: that in the document with the
smallest id, then the earliest line.

Short and blank lines stay. Null and empty texts stay as they are; an empty table gives an empty result.
A repeated row (same id, same text) is the same document and loses the same lines; a null id sorts last.
Lines are taken whole, however long. Further columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_pass, bits_apart, discard, join_unique, linked, materialise, open_pairs, quoted

MIN_WORDS = 5
PERCENT = 75
BANDS, WORD_MINS = 8, 3
#: Counts of character pairs kept for a line; their parities are the print of a line.
BITS = 512
#: Open buckets of more members are searched in parts of so many; pairs of smaller ones are joined, so that a
#: member has at most CROWD pairs in a bucket.
CROWD, SEARCH = 64, 256
#: Distances are taken together for as many pairs as need CELLS words of 64 bits; shorter sides of more than WIDE
#: words are taken one by one. Every CHECK columns the pairs that can't be alike any more go. LETTERS bounds the table
#: of characters. Pairs wait until there are WAITING of them, or HEAVY characters.
CELLS, WIDE, CHECK, LETTERS = 1 << 14, 64, 16, 512
WAITING, HEAVY = 1 << 14, 1 << 24
#: How many words two lines move on to meet again, fewest first.
_MOVES = sorted(((i, j) for i in range(5) for j in range(5) if i + j), key=lambda m: (max(m), sum(m)))
_ONE, _LAST = np.array(1, np.uint64), np.array(63, np.uint64)
#: Band keys that a task holds at once, and keys in a part of all keys.
HELD, PART_KEYS = 1 << 19, 1 << 18
_FACTORS = np.random.default_rng(6).integers(1 << 62, 1 << 63, BANDS * (WORD_MINS + 1), np.uint64) | np.uint64(1)
_ZEROS = re.compile(rb"00+")
_FOLD = bytes(b"0"[0] if chr(b).isdigit() and b < 128 else b + 32 if 65 <= b <= 90 else 32 if b in b"\t\r\v\f" else b for b in range(256))
_DROP = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def fold(text: bytes) -> bytes:
    """Whole texts after normalisation of their characters; line ends stay, other white space is blanks."""
    return _ZEROS.sub(b"0", text.translate(_FOLD, _DROP))


def squeezed(line: bytes) -> bytes:
    """A folded line with one blank between words."""
    while b"  " in line:
        line = line.replace(b"  ", b" ")
    return line.strip(b" ")


def normal(line: bytes) -> list[bytes]:
    """Words of a line after normalisation."""
    return fold(line).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHashes:
    """64-bit hashes of many words at once: the sum of the bytes, each times the factor of its place, mixed."""

    def __init__(self) -> None:
        self.factors = self._factors(256)

    @staticmethod
    def _factors(n: int) -> np.ndarray:
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def __call__(self, lines: list[bytes]) -> np.ndarray:
        """Hashes of the words of all lines, one blank between words."""
        x = np.frombuffer(b" ".join(lines) + b" ", np.uint8)  # the blank after a word marks its length
        ends = np.flatnonzero(x == 32)
        starts = np.append(0, ends[:-1] + 1)
        lengths = ends + 1 - starts
        if (longest := int(lengths.max())) > len(self.factors):
            self.factors = self._factors(longest)
        values = self.factors[np.arange(len(x)) - np.repeat(starts, lengths)]
        values *= x
        return mix(np.add.reduceat(values, starts))


def text_bands(lines: list[bytes], hashes: WordHashes) -> np.ndarray:
    """``BANDS`` 64-bit keys for each line (one word or more, one blank between words)."""
    out = np.empty((len(lines), BANDS), np.uint64)
    n_words = np.fromiter((x.count(b" ") + 1 for x in lines), np.int64, len(lines))
    total = np.cumsum(n_words)
    begin = 0
    while begin < len(lines):  # some 20,000 words at a time
        end = max(begin + 1, int(np.searchsorted(total, total[begin] - n_words[begin] + 20_000, "right")))
        lengths = n_words[begin:end]
        x = hashes(lines[begin:end])
        starts = np.cumsum(lengths) - lengths
        after = np.append(x[1:], np.uint64(0))
        after[starts + lengths - 1] = 0  # the last word of a line is paired with its end
        pairs = mix(mix(x) * np.uint64(3) + after)
        for band in range(BANDS):
            key = np.full(end - begin, band, np.uint64)
            for i in range(WORD_MINS + 1):
                values = (x if i < WORD_MINS else pairs) * _FACTORS[band * (WORD_MINS + 1) + i]
                key = mix(key + np.minimum.reduceat(values, starts)) * np.uint64(0x9E3779B97F4A7C15)
            out[begin:end, band] = key
        begin = end
    return out


def line_bands(lines: list[list[bytes]], hashes: WordHashes) -> np.ndarray:
    """``text_bands`` of lines as lists of words."""
    return text_bands([b" ".join(words) for words in lines], hashes)


def _line_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        row, number, lines = [], [], []
        for i, text in enumerate(texts):
            for k, line in enumerate(fold(text).split(b"\n") if text else ()):
                if len(line) >= 2 * MIN_WORDS - 1 and (line := squeezed(line)).count(b" ") >= MIN_WORDS - 1:
                    row.append(i)
                    number.append(k)
                    lines.append(line)
        ids = pa.array(row, pa.int64())
        nodes = [xxhash.xxh3_128_digest(x) for x in lines]
        bands = pa.array(text_bands(lines, hashes).view(np.int64).ravel())
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(bands) + 1, BANDS), pa.int32()), bands)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(ids), batch.column("text_hash").take(ids), pa.array(number, pa.int32()), pa.array(nodes, pa.binary())]
            + [pa.array([len(x.decode("utf-8", "replace")) for x in lines], pa.int32()), bands],
            names=["doc_id", "text_hash", "line", "node", "size", "bands"],
        )


def distance_at_most(a: str, b: str, most: int) -> bool:
    """Whether the Levenshtein distance is at most ``most``; bit-parallel over the shorter text."""
    if abs(len(a) - len(b)) > most:
        return False
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if len(a) > len(b):
        a, b = b, a
    if len(b) <= most:
        return True
    if not a:
        return False
    # One bit for each character of ``a``: where the column of the table steps up and where down.
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    up, down, score, left = full, 0, len(a), len(b)
    for c in b:
        left -= 1
        same = where.get(c, 0)
        flat = (((same & up) + up) ^ up) | same
        rise, fall = down | (full & ~(flat | up)), up & flat
        score += bool(rise & top) - bool(fall & top)
        if score - left > most:
            return False
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        keep = same | down
        up, down = fall | (full & ~(keep | rise)), rise & keep
    return score <= most


def alike(a: str, b: str) -> bool:
    longer = max(len(a), len(b))
    return distance_at_most(a, b, (100 - PERCENT) * longer // 100)


def bigrams(text: str) -> np.ndarray:
    """Counts of the pairs of neighbouring characters, hashed to BITS places."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount((x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(33 - BITS.bit_length()), minlength=BITS)


def may_be_alike(a: str, b: str) -> bool:
    """Rules out only pairs that aren't alike: one edit changes at most four of the counts by one."""
    longer = max(len(a), len(b))
    return int(np.abs(bigrams(a) - bigrams(b)).sum()) <= 4 * ((100 - PERCENT) * longer // 100)


def parities(text: str) -> np.ndarray:
    """The parities of ``bigrams`` as 64-bit words."""
    return np.packbits((bigrams(text) & 1).astype(np.uint8)).view(np.int64)


def parities_of(texts: list[str]) -> np.ndarray:
    """``parities`` of many texts, one row for each."""
    out = np.empty((len(texts), BITS // 64), np.int64)
    for begin in range(0, len(texts), 1024):
        x, n = _codes(texts[begin : begin + 1024])
        row = np.repeat(np.arange(len(n)), n)
        place = (x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(33 - BITS.bit_length())
        inside = row[1:] == row[:-1]
        counts = np.bincount(row[1:][inside] * BITS + place[inside], minlength=len(n) * BITS)
        out[begin : begin + len(n)] = np.packbits((counts & 1).astype(np.uint8)).view(np.int64).reshape(len(n), -1)
    return out


def may_link(x: str, y: str) -> Column:
    """Holds for all alike lines: lengths within PERCENT, and at most four parities turned by each edit."""
    n, k = F.col(f"{x}.size"), F.col(f"{y}.size")
    most = F.floor((100 - PERCENT) * F.greatest(n, k) / 100)
    return (100 * F.least(n, k) >= PERCENT * F.greatest(n, k)) & (bits_apart(x, y, BITS // 64) <= 4 * most)


def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one after the other, and the lengths of the texts."""
    x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return x, np.fromiter(map(len, texts), np.int64, len(texts))


def _within(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Whether the Levenshtein distances of pairs, ``a`` not longer than ``b``, are at most ``most``.

    By blocks of bits as in ``distance_at_most``. Word w of a column is done w steps after word 0, so the words of all
    pairs go at once. Two things are left out that change no answer: words beyond the diagonals that a path of cost
    ``most`` can reach (values there only come out too high), and pairs in which every value of the last columns done
    plus the difference of the lengths that remain is above ``most``. Pairs end in the same column; the columns before
    a shorter ``b`` change nothing.
    """
    n, (x, la), (y, lb) = len(a), _codes(a), _codes(b)
    ids = np.zeros(int(max(x.max(), y.max())) + 1, np.int64)
    ids[x] = 1
    letters = int(ids.sum()) + 1
    if letters > LETTERS and n > 1:
        k = n // 2
        return np.append(_within(a[:k], b[:k], most[:k]), _within(a[k:], b[k:], most[k:]))
    ids = np.where(ids == 1, np.cumsum(ids), 0)  # characters that no ``a`` has are 0
    words, long = int(-(-la.max() // 64)), int(lb.max())
    row, at = np.repeat(np.arange(n), la), np.arange(len(x)) - np.repeat(np.cumsum(la) - la, la)
    bit = (at % 64).astype(np.uint8)
    order = np.argsort(bit, kind="stable")  # one bit of all words at a time: no cell is named twice
    spot, ends = ((row * letters + ids[x]) * words + at // 64)[order], np.searchsorted(bit[order], np.arange(65))
    where = np.zeros(n * letters * words, np.uint64)
    for k in range(64):
        where[spot[ends[k] : ends[k + 1]]] |= np.uint64(1 << k)
    off = long - lb
    text = np.zeros((long + words + 1, n), np.int64)  # columns from 1 on
    text[np.arange(1, len(y) + 1) + np.repeat(off - (np.cumsum(lb) - lb), lb), np.repeat(np.arange(n), lb)] = ids[y] * words
    # A path of cost ``most`` is at most so many rows below and columns beyond the diagonal.
    low, over = int(((most - lb + la) // 2).max()), int(((most + lb - la) // 2).max() + off.max())
    begins = [max(1, 64 * w + 1 - low) + w for w in range(words)] + [1 << 62]
    leaves = [64 * (w + 1) + over + w for w in range(words - 1)] + [1 << 62]
    final, who, out = (la - 1) // 64, np.arange(n), np.zeros(n, bool)
    up, down = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    more, less = np.zeros((words + 1, n), np.uint64), np.zeros((words + 1, n), np.uint64)  # what enters a word from below
    lo = hi = since = 0
    base = None  # values above word ``lo`` in step ``since`` if it isn't the first

    def room() -> list[np.ndarray]:
        cell = np.arange(len(who)) * (letters * words) + np.arange(words)[:, None]
        return [cell, *[np.empty((words, len(who)), k) for k in (np.uint64, np.int64, *[np.uint64] * 4)]]

    def values() -> tuple[np.ndarray, np.ndarray]:
        """Values above the words lo to hi and at their last bits, each in the column that its word has reached."""
        first = np.maximum(0, step - off) if base is None else base + (step - since)
        steps = np.bitwise_count(up[lo:hi]).astype(np.int64) - np.bitwise_count(down[lo:hi])
        turn = less[lo + 1 : hi + 1].astype(np.int64) - more[lo + 1 : hi + 1].astype(np.int64)
        steps[0] += first
        steps[1:] += turn[:-1]
        bottom = np.cumsum(steps, axis=0)
        return np.concatenate([first[None], bottom + turn]), bottom

    cell, same, idx, t, rise, fall, keep = room()
    for step in range(1, long + words):
        while begins[hi] <= step:
            hi += 1
        if base is None:
            more[0] = step > off
        w = hi - lo
        S, I, T, R, D, K = same[:w], idx[:w], t[:w], rise[:w], fall[:w], keep[:w]
        P, M, hp, hm = up[lo:hi], down[lo:hi], more[lo:hi], less[lo:hi]
        np.add(text[step - hi + 1 : step - lo + 1][::-1], cell[lo:hi], out=I)
        where.take(I, out=S, mode="clip")
        np.bitwise_or(S, M, out=K)
        np.bitwise_or(S, hm, out=S)
        np.bitwise_and(S, P, out=T)
        np.add(T, P, out=T)
        np.bitwise_xor(T, P, out=T)
        np.bitwise_or(T, S, out=T)
        np.bitwise_or(T, P, out=R)
        np.invert(R, out=R)
        np.bitwise_or(R, M, out=R)
        np.bitwise_and(P, T, out=D)
        np.left_shift(R, _ONE, out=T)
        np.bitwise_or(T, hp, out=T)
        np.left_shift(D, _ONE, out=P)
        np.bitwise_or(P, hm, out=P)
        np.right_shift(R, _LAST, out=more[lo + 1 : hi + 1])
        np.right_shift(D, _LAST, out=less[lo + 1 : hi + 1])
        np.bitwise_and(T, K, out=M)
        np.bitwise_or(T, K, out=T)
        np.invert(T, out=T)
        np.bitwise_or(P, T, out=P)
        if step >= long:  # word step - long has reached the last column
            w = step - long
            own = np.flatnonzero(final == w)
            if len(own):
                mask = ~np.uint64(0) >> (63 - (la[own] - 1) % 64).astype(np.uint64)
                ups, downs = (np.bitwise_count(v[w][own] & mask).astype(np.int64) for v in (up, down))
                out[who[own]] = values()[0][w - lo][own] + ups - downs <= most[own]
        elif step % CHECK == 0 and words > 1:
            top, bottom = values()
            w = np.arange(lo, hi)[:, None]
            ahead = la - long + np.maximum(step - w, off) - 64 * w  # rows from the top of a word to the end's diagonal
            live = np.maximum(top[:-1] - ahead, bottom + ahead - 64).min(axis=0) - 1 <= most  # 1: words end a column apart
            n_live = int(live.sum())
            if not n_live:
                return out
            if n_live <= 0.7 * len(who):
                where = where.reshape(len(who), -1)[live].ravel()
                who, la, most, off, final, base = (v if v is None else v[live] for v in (who, la, most, off, final, base))
                text, up, down, more, less = (v[:, live] for v in (text, up, down, more, less))
                cell, same, idx, t, rise, fall, keep = room()
        if step >= leaves[lo]:
            base, since = values()[0][1], step
            lo += 1
            more[lo], less[lo] = 1, 0
    return out


def clearly_alike(a: str, b: str, most: int) -> bool:
    """Holds only if ``a`` turns into ``b`` with ``most`` edits, by runs of equal words and what stands between them."""
    x, y = a.split(" "), b.split(" ")
    n, m, i, j, cost = len(x), len(y), 0, 0, 0
    while i < n and j < m:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        for p, q in _MOVES:
            if i + p < n and j + q < m and x[i + p] == y[j + q]:
                break
        else:
            break
        cost += max(sum(map(len, x[i : i + p])) + p, sum(map(len, y[j : j + q])) + q)
        if cost > most:
            return False
        i, j = i + p, j + q
    return cost + max(sum(map(len, x[i:])) + n - i, sum(map(len, y[j:])) + m - j) <= most


def alike_many(pairs: list[tuple[str, str]]) -> np.ndarray:
    """``alike`` of many pairs: like lengths are measured together."""
    out = np.zeros(len(pairs), bool)
    todo = []
    for i, (a, b) in enumerate(pairs):
        if len(a) > len(b):
            a, b = b, a
        most = (100 - PERCENT) * len(b) // 100
        if len(b) - len(a) > most:
            continue
        if clearly_alike(a, b, most):
            out[i] = True
            continue
        n = shared(a, b)
        a, b = a[n:], b[n:]
        if n := shared(a[::-1], b[::-1]):
            a, b = a[:-n], b[:-n]
        if len(b) <= most:
            out[i] = True
        elif len(a) > 64 * WIDE:
            out[i] = may_be_alike(*pairs[i]) and distance_at_most(a, b, most)
        elif a:
            todo.append((len(b), i, a, b, most))
    todo.sort(key=lambda p: p[:2])
    begin = 0
    while begin < len(todo):
        end, longest = begin + 1, todo[begin][0] * 5 // 4 + 16
        while end < len(todo) and todo[end][0] <= longest and (end - begin + 1) * -(-todo[end][0] // 64) <= CELLS:
            end += 1
        _, at, a, b, most = zip(*todo[begin:end], strict=True)
        out[list(at)] = _within(list(a), list(b), np.array(most))
        begin = end
    return out


class Search:
    """Links between different components, as many as join them, from one (part of a) bucket after the other."""

    def __init__(self) -> None:
        self.hashes = WordHashes()
        self.now: dict[int, int] = {}  # labels joined by the links found here
        self.waiting: list[tuple] = []
        self.heavy = 0

    def root(self, x: int) -> int:
        while (y := self.now.get(x, x)) != x:
            self.now[x] = x = self.now.get(y, y)
        return x

    def settle(self) -> pa.RecordBatch:
        """The links among the pairs that wait."""
        met = [p for p in self.waiting if self.root(p[0]) != self.root(p[1])]
        self.waiting, self.heavy, out = [], 0, []
        for (x, y, a, b, _, _), good in zip(met, alike_many([p[4:] for p in met]), strict=True):
            if good and self.root(x) != self.root(y):
                out.append((min(a, b), max(a, b)))
                self.now[self.root(x)] = self.root(y)
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def meet(self, group: pa.Table) -> Iterator[pa.RecordBatch]:
        """Pairs of one group wait, each in its first common bucket; yields links when enough wait."""
        column = lambda c: group.column(c).to_numpy()
        node, label, size, part = column("node"), column("label"), column("size").astype(np.int64), column("part")
        matrix = lambda c: group.column(c).combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        bits, texts = matrix("bits").view(np.uint64), group.column("text").to_pylist()
        bands = text_bands([t.encode() for t in texts], self.hashes).view(np.int64)
        bucket, big, crossed = group.column("bucket")[0].as_py(), group.column("big")[0].as_py(), column("low")[0] != column("high")[0]
        nodes, labels = node.tolist(), label.tolist()
        for x in np.flatnonzero(label != big):
            longer = np.maximum(size, size[x])
            fits = (label != label[x]) & ((label == big) | (node > node[x])) & (100 * np.minimum(size, size[x]) >= PERCENT * longer)
            if crossed:
                fits &= part != part[x]
            near = np.flatnonzero(fits)
            apart = np.bitwise_count(bits[near] ^ bits[x]).sum(axis=1)
            near = near[apart <= 4 * ((100 - PERCENT) * longer[near] // 100)]
            near = near[bands[x][(bands[near] == bands[x]).argmax(axis=1)] == bucket]
            self.waiting += [(labels[x], labels[y], nodes[x], nodes[y], texts[x], texts[y]) for y in near.tolist()]
            self.heavy += int(size[near].sum()) + len(near) * int(size[x])
            if len(self.waiting) >= WAITING or self.heavy >= HEAVY:
                yield self.settle()


def _search_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of groups of rows that stand together (bucket, low, high), one group in memory at a time."""
    held, last, search = [], None, Search()
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "low", "high")], axis=1).astype(np.int64)
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
        for begin, end in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(keys[begin]) if end > begin else last
            if key != last and held:
                yield from search.meet(pa.Table.from_batches(held))
                held = []
            last = key
            held.append(batch.slice(begin, end - begin))
    if held:
        yield from search.meet(pa.Table.from_batches(held))
    if search.waiting:
        yield search.settle()


def open_links(at: DataFrame) -> DataFrame:
    """Links between different components of a crowded bucket, as many as join what belongs together.

    Pairs never become rows, and a pair is looked at in its first common bucket only.
    Buckets are cut into parts of about SEARCH members, and any two parts meet in one group of rows. The work
    is in the comparisons, not in the bytes, so the number of tasks is set.
    """
    tasks = 4 * at.sparkSession.sparkContext.defaultParallelism
    parts = F.ceil(F.col("members") / SEARCH).cast("int")
    rows = at.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select(
        "bucket", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "part", "node", "label", "big", "size", "bits", "text"
    )
    rows = rows.repartition(tasks, "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    return arrow_pass(rows, _search_batches, "a long, b long").distinct()


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def kept(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        group = pa.Table.from_batches(held).combine_chunks()
        x, y = (group.column(c).to_pylist() for c in ("text_a", "text_b"))
        good = group.select(["a", "b"]).filter(pa.array(alike_many(list(zip(x, y, strict=True)))))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in good.columns], names=["a", "b"])

    held, n, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n >= WAITING or size >= HEAVY:
            yield kept(held)
            held, n, size = [], 0, 0
    if n:
        yield kept(held)


def _deal(held: list[pa.RecordBatch], parts: int) -> pa.RecordBatch:
    """Band keys and their nodes as bytes, one row for each part of the keys.

    Of the nodes here that share a key only the least, the leader, goes to the part of the key, as ~node; the
    others go with their leaders to a part of their own, numbered from ``parts`` on. So a hot key has few rows.
    """
    group = pa.Table.from_batches(held)
    node = group.column("node").to_numpy()
    order = np.argsort(node)
    keys = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)[order].ravel().view(np.uint64)
    node = np.repeat(node[order], BANDS)
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((keys, part))  # stable: the nodes of a key ascend
    keys, node, part = keys[order], node[order], part[order]
    first = np.append(True, keys[1:] != keys[:-1])
    starts = np.flatnonzero(first)
    leader = np.repeat(node[starts], np.diff(np.append(starts, len(keys))))
    several = np.diff(np.append(starts, len(keys))) > 1
    heads, of, at = keys[starts], np.where(several, ~node[starts], node[starts]), part[starts]
    cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    ends = np.append(cuts[1:], len(at))
    rows = [(int(at[b]), heads[b:e].tobytes(), of[b:e].tobytes(), b"") for b, e in zip(cuts, ends, strict=True)]
    if not first.all():
        rows.append((parts + int(node[0]) % parts, keys[~first].tobytes(), node[~first].tobytes(), leader[~first].tobytes()))
    columns = zip(*rows, strict=True)
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "keys", "nodes", "leaders"])


def _deal_batches(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows * BANDS
        if n >= HELD:
            yield _deal(held, parts)
            held, n = [], 0
    if n:
        yield _deal(held, parts)


def _meet_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, node, leader, top) of the keys of one part after the other."""
    names = ["bucket", "node", "leader", "top"]

    def met(held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        keys, node = (np.frombuffer(b"".join(x[i] for x in held), np.int64) for i in (0, 1))
        several, node = node < 0, np.where(node < 0, ~node, node)
        order = np.lexsort((node, keys))
        keys, node, several = keys[order], node[order], several[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(starts, len(keys)))
        keep = np.repeat((sizes > 1) | np.logical_or.reduceat(several, starts), sizes)
        top = np.repeat(node[starts], sizes)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (keys, node, node, top)], names=names)

    held, last = [], None
    for batch in batches:
        for part, keys, nodes, leaders in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "nodes", "leaders")), strict=True):
            if leaders:
                own = [pa.array(np.frombuffer(x, np.int64)) for x in (keys, nodes, leaders, leaders)]
                yield pa.RecordBatch.from_arrays(own, names=names)
                continue
            if part != last and held:
                yield met(held)
                held = []
            last = part
            held.append((keys, nodes))
    if held:
        yield met(held)


def band_members(nodes: DataFrame, n_nodes: int) -> DataFrame:
    """``bucket_members`` of the band keys of ``nodes`` (node, bands), with all keys of a task sorted at once.

    Keys travel in blocks of bytes, and rows are made of keys of several nodes only. A leader is the least of the
    nodes with a key in some HELD keys, whose top is the least of the bucket.
    """
    parts = max(32, n_nodes * BANDS // PART_KEYS)
    dealt = arrow_pass(nodes, partial(_deal_batches, parts=parts), "part long, keys binary, nodes binary, leaders binary")
    dealt = dealt.repartition("part").sortWithinPartitions("part")
    return arrow_pass(dealt, _meet_batches, "bucket long, node long, leader long, top long")


def _pick_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, size, bits, normalised line) from (text, wanted: array of (line, node, n, size))."""
    for batch in batches:
        picked, lines = [], []
        for text, wanted in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            split = text.split(b"\n")
            picked += wanted
            lines += [squeezed(fold(split[w["line"]])).decode("utf-8", "replace") for w in wanted]
        numbers = [pa.array([w[c] for w in picked], t) for c, t in (("node", pa.int64()), ("n", pa.int64()), ("size", pa.int32()))]
        bits = pa.array(list(parities_of(lines)), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*numbers, bits, pa.array(lines, pa.string())], names=["node", "n", "size", "bits", "text"])


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lines to remove: (doc_id, text_hash, line), line counted from 0, one row for each."""
    text = F.col(quoted(text_col))
    base = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    id_type = dict(base.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, text_hash long, line int, node binary, size int, bands array<long>"
    lines = materialise(arrow_pass(base, _line_batches, schema), "lines")

    place = F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "text_hash", "line")
    nodes = lines.groupBy("node").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("bands").alias("bands")
    )
    nodes = materialise(nodes.withColumn("id", F.monotonically_increasing_id()), "line-nodes")
    grouped = materialise(band_members(nodes.select(F.col("id").alias("node"), "bands"), nodes.count()), "line-buckets")

    wanted = nodes.join(grouped.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    wanted = wanted.groupBy(F.col("first.doc_id").alias("key"), F.col("first.text_hash").alias("hash")).agg(
        F.collect_list(F.struct(F.col("first.line").alias("line"), F.col("id").alias("node"), "n", "size")).alias("wanted")  # lines of one document
    )
    found = base.join(wanted, F.col("doc_id").eqNullSafe(F.col("key")) & (F.col("text_hash") == F.col("hash"))).select("text", "wanted")
    picked = arrow_pass(found, _pick_batches, "node long, n long, size int, bits array<long>, text string")
    picked = materialise(picked, "line-picked")
    # A line that stands once stands in one row; others may come from several repeated rows, and one is enough.
    several = picked.where("n > 1").groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "bits", "text")])
    texts = materialise(picked.where("n = 1").drop("n").unionByName(several), "line-texts")
    discard(picked)

    def verify(pairs: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(texts.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}"), F.col("text").alias(f"text_{end}")), end)
        pairs = pairs.where(100 * F.least("size_a", "size_b") >= PERCENT * F.greatest("size_a", "size_b"))
        return materialise(arrow_pass(pairs.select("a", "b", "text_a", "text_b"), _verify_batches, "a long, b long"), "line-links")

    def meet(at: DataFrame, turn: int | None) -> DataFrame:
        if turn is not None:
            return open_pairs(at, may_link, turn)
        crowded = F.col("members") > CROWD
        return open_pairs(at.where(~crowded).drop("text"), may_link).unionByName(open_links(at.where(crowded))).distinct()

    labels = linked(grouped, verify, texts, meet)
    discard(grouped, texts)
    # Only groups with more than one occurrence lose lines.
    named = nodes.select("id", "node", "n", "first").join(labels.withColumnsRenamed({"node": "id"}), "id", "left")
    named = materialise(named.where("n > 1 or label is not null"), "line-named")
    alone = named.where("label is null").select("node", "first")
    chained = named.where("label is not null")
    first = chained.groupBy("label").agg(F.min("first").alias("keep"))
    chained = join_unique(chained, first, ["label"]).select("node", F.col("keep").alias("first"))
    keep = materialise(alone.unionByName(chained), "line-keep")
    discard(nodes, named, labels)
    repeats = join_unique(lines.select("doc_id", "text_hash", "line", "node"), keep, ["node"]).where("first is not null")
    return repeats.where(~place.eqNullSafe(F.col("first"))).select("doc_id", "text_hash", "line")


def _strip_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        clean, gone = [], batch.column("gone").to_pylist()
        for text, numbers in zip(batch.column("text").to_pylist(), gone, strict=True):
            if numbers:
                drop = set(numbers)
                text = "\n".join([x for k, x in enumerate(text.split("\n")) if k not in drop])
            clean.append(text)
        counts = pa.array([len(g or ()) for g in gone], pa.int64())
        yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "clean": pa.array(clean, pa.string()), "n_removed": counts})


def _cleaned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, clean, n_removed): the other columns of ``docs`` in a struct, the text less its repeated lines."""
    gone = repeated_lines(docs, id_col, text_col)
    gone = gone.distinct().groupBy(F.col("doc_id").alias("key"), F.col("text_hash").alias("hash")).agg(F.collect_list("line").alias("gone"))
    gone = materialise(gone, "line-gone")
    id_, text = F.col(quoted(id_col)), F.col(quoted(text_col))
    others = F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col])
    base = docs.select(others.alias("row"), text.alias("text"), id_.alias("id"), F.xxhash64(text).alias("text_hash"))
    found = base.join(gone, F.col("id").eqNullSafe(F.col("key")) & (F.col("text_hash") == F.col("hash")), "left").select("row", "text", "gone")
    return arrow_pass(found, _strip_batches, f"row {dict(found.dtypes)['row']}, clean string, n_removed long")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "__removed") -> DataFrame:
    """All rows and columns of ``docs`` with the text less its repeated lines, and ``removed_col``, how many went.

    A column of ``docs`` with that name is replaced.
    """
    names = {c: "clean" if c == text_col else f"row.c{i}" for i, c in enumerate(docs.columns) if c != removed_col}
    return _cleaned(docs, id_col, text_col).select(*[F.col(at).alias(c) for c, at in names.items()], F.col("n_removed").alias(removed_col))


def keep_clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without repeated lines; a document goes only if it loses lines and keeps no word."""
    out = _cleaned(docs, id_col, text_col).where((F.col("n_removed") == 0) | F.col("clean").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.col("clean" if c == text_col else f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
