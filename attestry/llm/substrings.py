"""Exact removal of long repeated passages by recompression.

Each document's words are named by 64-bit hashes and compressed in rounds: complete runs of one symbol, then pairs of a symbol
of the left half of the alphabet and one of the right half, become one symbol each. Names and halves are functions of the
symbols alone, so every task gives equal substrings equal interior symbols, everywhere and without a dictionary. A symbol
remembers the interval of words on which its existence depends. A window of 50 words is represented by the longest symbol
(then the least hash, then the leftmost) whose interval lies inside it, which is the same in every equal window. Consecutive
windows with one such anchor form a stretch: one row for about 15 windows.

Spark steps then work on the anchors. Stretches whose anchor occurs in one document only hold no repeat. Equal stretches of
several documents are settled at once. Where stretches with one anchor differ, their windows are compared one by one, for one
stretch of each kind. What is equal is decided by a digest of the words themselves, by another function than that of the
names, so two names that collide remove nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, Sieve, binaries, column, discard, kept, mix, ship, steps, stored, word_hashes

WINDOW = 50
ROUNDS, LONGEST = 3, 8
#: Texts that are held as objects at a time.
ROWS = 256
_RUN, _PAIR = 0xA0761D6478BD642F, np.uint64(0xE7037ED1A0B428DB)
_TOP = np.uint64(63)


class Symbols:
    """The symbols of some documents after a number of rounds: name, start, end, and the interval lo..hi they depend on."""

    def __init__(self, h: np.ndarray, first: np.ndarray, rounds: int = ROUNDS, longest: int = LONGEST) -> None:
        n = len(h)
        self.name, self.start, self.end = h, np.arange(n), np.arange(1, n + 1)
        self.lo, self.hi = self.start.copy(), self.end.copy()
        self.open = np.zeros(n + 1, bool)  # a document begins at this word
        self.open[first[first <= n]] = True
        self.longest = longest
        for k in range(rounds):
            self._runs(np.uint64(_RUN * (2 * k + 1) % (1 << 64)))
            self._pairs(np.uint64(_RUN * (2 * k + 2) % (1 << 64)))

    def _near(self) -> tuple[np.ndarray, np.ndarray]:
        """lo of the symbol before and hi of the one behind; beyond the ends of the document no window reaches."""
        before, behind = np.empty_like(self.lo), np.empty_like(self.hi)
        before[1:], behind[:-1] = self.lo[:-1], self.hi[1:]
        head, tail = self.open[self.start], self.open[self.end]
        before[head], behind[tail] = self.start[head] - 1, self.end[tail] + 1
        return before, behind

    def _take(self, group: np.ndarray, name: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Keep the first symbol of each group, with the end and hi of its last."""
        last = np.append(group[1:], len(self.name)) - 1
        self.name, self.start, self.end, self.lo, self.hi = name, self.start[group], self.end[last], lo[group], hi[last]

    def _runs(self, salt: np.uint64) -> None:
        n = len(self.name)
        if n < 2:
            return
        before, behind = self._near()
        edge = np.ones(n, bool)
        edge[1:] = (self.name[1:] != self.name[:-1]) | self.open[self.start[1:]]
        first = np.flatnonzero(edge)
        size = np.diff(np.append(first, n))
        words = self.end[first + size - 1] - self.start[first]
        whole = (size > 1) & (words <= self.longest)
        # a member of a longer run depends on what shows, on either side, that the run is longer or where it ends
        at = np.flatnonzero(np.repeat((size > 1) & ~whole, size))
        if len(at):
            run = (np.cumsum(edge) - 1)[at]
            head, tail = first[run], first[run] + size[run] - 1
            more = self.longest // (self.end[head] - self.start[head])
            lo = np.where(at - more >= head, self.lo[np.maximum(at - more, 0)], before[head])
            hi = np.where(at + more <= tail, self.hi[np.minimum(at + more, n - 1)], behind[tail])
            before[at], behind[at] = lo, hi
        keep = np.repeat(~whole, size) | edge
        group = np.flatnonzero(keep)
        name = self.name[group]
        merged = whole[np.cumsum(edge)[group] - 1]
        name[merged] = mix((name[merged] ^ salt) + size[whole].astype(np.uint64) * _PAIR)
        self._take(group, name, before, behind)

    def _pairs(self, salt: np.uint64) -> None:
        n = len(self.name)
        if n < 2:
            return
        before, behind = self._near()
        right = (mix(self.name ^ salt) >> _TOP).astype(bool)
        pair = np.zeros(n, bool)
        pair[:-1] = ~right[:-1] & right[1:] & ~self.open[self.start[1:]] & (self.end[1:] - self.start[:-1] <= self.longest)
        second = np.zeros(n, bool)
        second[1:] = pair[:-1]
        lo, hi = np.where(right & ~second, before, self.lo), np.where(~right & ~pair, behind, self.hi)
        group = np.flatnonzero(~second)
        name = self.name[group]
        at = pair[group]
        left = np.flatnonzero(pair)
        name[at] = mix(mix(self.name[left] + salt) + self.name[left + 1] * _PAIR)
        self._take(group, name, lo, hi)


def stretches(h: np.ndarray, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """doc, start (in all words), windows and anchor (a hash) of every stretch of windows with one anchor.

    h are the word hashes of documents that begin at first (with the end as last entry). A window without an anchor is a
    stretch of its own, under its own hash.
    """
    size = np.diff(first)
    n_win = np.maximum(size - window + 1, 0)
    doc = np.repeat(np.arange(len(size)), n_win)
    empty = np.zeros(0, np.int64)
    if not len(doc):
        return empty, empty, empty, empty.view(np.uint64)
    s = np.arange(len(doc)) - np.repeat(np.cumsum(n_win) - n_win, n_win) + first[:-1][doc]
    sym = Symbols(h, first)
    rank = mix(sym.name) >> np.uint64(4) | (np.uint64(15) - np.minimum(sym.end - sym.start, 15).astype(np.uint64)) << np.uint64(60)
    a = np.searchsorted(sym.lo, s)
    b = np.searchsorted(sym.hi, s + window, "right") - 1
    none = b < a
    a, b = np.where(none, 0, a), np.where(none, 0, b)
    level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    best = np.arange(len(rank))
    anchor = np.zeros(len(s), np.int64)
    for k in range(int(level.max()) + 1):
        if k:
            half = 1 << (k - 1)
            x, y = best[:-half], best[half:]
            best = np.where(rank[x] <= rank[y], x, y)
        at = np.flatnonzero(level == k)
        if len(at):
            x, y = best[a[at]], best[b[at] - (1 << k) + 1]
            anchor[at] = np.where(rank[x] <= rank[y], x, y)
    anchor[none] = -1
    edge = np.ones(len(s), bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | none[1:]
    at = np.flatnonzero(edge)
    count = np.diff(np.append(at, len(s)))
    start, own = s[at], anchor[at]
    prefix = WORDS.prefix(h)
    lo, hi = np.where(own < 0, start, sym.lo[own]), np.where(own < 0, start + window, sym.hi[own])
    return doc[at], start, count, WORDS.spans(prefix, lo, hi)


class Words:
    """The words of some texts, one blank between two: their hashes, where each text's begin, and digests of their runs."""

    def __init__(self, texts: list[bytes]) -> None:
        own = [b" ".join(x.split()) for x in texts]
        self.h, self.first = word_hashes(own)
        self.flat = b" ".join(x for x in own if x)
        gap = np.flatnonzero(np.frombuffer(self.flat, np.uint8) == 32) if self.flat else np.zeros(0, np.int64)
        self.begin, self.end = np.append(0, gap + 1), np.append(gap, len(self.flat))

    def digests(self, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        """64-bit digests of runs of words, as signed numbers."""
        digest, flat = xxhash.xxh3_64_intdigest, memoryview(self.flat)
        return np.array([digest(flat[a:b]) for a, b in zip(self.begin[start].tolist(), self.end[start + count - 1].tolist(), strict=True)], np.uint64).view(np.int64)


def _mark(text: bytes) -> int:
    """Tells apart texts under one doc_id."""
    return xxhash.xxh3_64_intdigest(text, 5) >> 1


def _pos(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 6) | count.astype(np.int64)


def _scan(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(0, batch.num_rows, ROWS):
                texts, ids = binaries(batch.slice(r, ROWS), 1), batch.column(0).slice(r, ROWS).to_numpy()
                for i, j in steps(texts, 1 << 20):
                    part = Words(texts[i:j])
                    doc, start, count, key = stretches(part.h, part.first)
                    if len(doc):
                        mark = np.array([_mark(x) for x in texts[i:j]], np.int64)
                        e = part.digests(start, count + WINDOW - 1)
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(e), pa.array(ids[i:j][doc]), pa.array(mark[doc]), pa.array(_pos(start - part.first[:-1][doc], count))], names=["k", "e", "doc", "m", "pos"])

    return docs.mapInArrow(run, "k long, e long, doc long, m long, pos long")


def _listed(texts: list[bytes], ids: np.ndarray, lists: list) -> Iterator[pa.RecordBatch]:
    part, out = Words(texts), []
    for r, text in enumerate(texts):
        mark = _mark(text)
        own = [(x["k"], x["pos"]) for x in lists[r] if x["m"] == mark]
        if own:
            k, pos = np.array(own, np.int64).T
            n = pos & 63
            s = np.repeat(pos >> 6, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append((np.repeat(k, n), part.digests(s + part.first[r], np.full(len(s), WINDOW)), np.full(len(s), ids[r]), np.full(len(s), mark), s << 6 | 1))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["k", "w", "doc", "m", "pos"])


def _windows(rows: DataFrame) -> DataFrame:
    """k, w (a digest), doc, m, pos of every window of the listed stretches (k, m, pos) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                cut = batch.slice(a, ROWS)
                texts, ids, lists = [zlib.decompress(x) for x in cut.column(1).to_pylist()], cut.column(0).to_numpy(), cut.column(2).to_pylist()
                for i, j in steps(texts, 1 << 20):
                    yield from _listed(texts[i:j], ids[i:j], lists[i:j])

    return rows.mapInArrow(run, "k long, w long, doc long, m long, pos long")


def repeats(docs: DataFrame) -> DataFrame:
    """doc, m and pos of stretches whose windows all start in a document with a smaller id; docs has doc_id and text."""
    rows = stored(_scan(docs.where("doc_id is not null")))
    # a written side of a join leaves it free to divide a hot key
    keys = stored(rows.groupBy("k").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x < y").select("k"))
    shared = stored(rows.join(keys, "k", "left_semi"))
    discard(rows)
    discard(keys)
    kinds = stored(shared.groupBy("k", "e").agg(F.min(F.struct("doc", "m", "pos")).alias("f")).select("k", "e", F.col("f.doc").alias("d"), F.col("f.m").alias("dm"), F.col("f.pos").alias("p")))
    whole = shared.join(kinds, ["k", "e"]).where("doc > d").select("doc", "m", "pos")
    several = stored(kinds.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k"))
    open_ = stored(kinds.join(several, "k", "left_semi"))
    discard(several)
    listed = stored(open_.groupBy(F.col("d").alias("doc_id")).agg(F.collect_list(F.struct("k", F.col("dm").alias("m"), F.col("p").alias("pos"))).alias("own")))
    each = stored(_windows(_squeezed(docs, Sieve(listed.select("doc_id"), "doc_id")).join(listed.hint("merge"), "doc_id").select("doc_id", "z", "own")))
    discard(listed)
    least = stored(each.groupBy("k", "w").agg(F.min("doc").alias("d"), F.max("doc").alias("y")).where("d < y").select("k", "w", "d"))
    single = stored(each.join(least, ["k", "w"]).where("doc > d").select("k", "doc", "m", "pos"))
    discard(each)
    discard(least)
    # a stretch that occurs again in its first document has the same windows there
    again = shared.join(open_, ["k", "e"]).where("doc = d and (pos <> p or m <> dm)").select("k", "doc", F.col("m").alias("qm"), F.col("pos").alias("q"), "dm", "p")
    moved = again.join(single, ["k", "doc"]).where("m = dm and shiftright(pos, 6) between shiftright(p, 6) and shiftright(p, 6) + (p & 63) - 1")
    shifted = moved.select("doc", F.col("qm").alias("m"), F.expr("shiftleft(shiftright(q, 6) + shiftright(pos, 6) - shiftright(p, 6), 6) | 1L").alias("pos"))
    return whole.union(single.select("doc", "m", "pos")).union(shifted)


def _squeezed(docs: DataFrame, sieve: Sieve) -> DataFrame:
    """The texts whose ids the sieve holds, compressed to travel."""
    sent = sieve.sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.array(kept(sent, batch.column(2))))
            for i in range(0, own.num_rows, ROWS):
                part = own.slice(i, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([zlib.compress(x, 1) for x in binaries(part, 1)], pa.binary())], names=["doc_id", "z"])

    return docs.select("doc_id", "text", sieve.slot("doc_id")).mapInArrow(run, "doc_id long, z binary")


def keep_mask(text: bytes, n: int, stretches_: list[tuple[int, int]]) -> np.ndarray:
    """Which of the n words of a text stay, given the stretches (m, pos) to remove."""
    step = np.zeros(n + 1, np.int64)
    mark = _mark(text)
    pos = np.array([p for m, p in stretches_ if m == mark], np.int64)
    np.add.at(step, pos >> 6, 1)
    np.add.at(step, (pos >> 6) + (pos & 63) + WINDOW - 1, -1)
    return np.cumsum(step[:-1]) == 0


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words, n_removed.

    A word goes if it is covered by a window of 50 words of its document whose words also start in a document with a smaller
    doc_id; windows are judged on the input. Null and empty texts have no words. Texts of fewer than 50 words stay; very long
    ones are searched whole. Rows that share a doc_id are not earlier than each other, so repeated rows stay as they are, and
    several texts under one doc_id are told apart by 63 bits of a digest. A row without doc_id stays whole and no other row is
    compared with it. Ids are integers. Other columns are not read. An empty table gives no rows. Only texts that may lose a
    word are moved.
    """
    ship(docs.sparkSession)
    own = docs.select(column(docs, doc_id, "long").alias("doc_id"), column(docs, text, "string").alias("text"))
    gone = stored(repeats(own).groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("m", "pos")).alias("gone")))
    sieve = Sieve(gone.select("doc_id"), "doc_id")
    sent = sieve.sent

    def less(ids: pa.Array, texts: list[bytes], lists: list) -> pa.RecordBatch:
        out, n_words, n_removed = [], [], []
        for x, own_ in zip(texts, lists, strict=True):
            words = x.split()
            left = words
            if own_ and len(words) >= WINDOW:
                mask = keep_mask(x, len(words), [(g["m"], g["pos"]) for g in own_])
                left = [w for w, k in zip(words, mask.tolist(), strict=True) if k]
            out.append(b" ".join(left).decode("utf-8", "replace"))
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
        return pa.RecordBatch.from_arrays([ids, pa.array(out, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=["doc_id", "text", "n_words", "n_removed"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                yield less(part.column(0), [zlib.decompress(z) for z in part.column(1).to_pylist()], part.column(2).to_pylist())

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.filter(pa.array(~kept(sent, batch.column(2))))
            for i in range(0, whole.num_rows, ROWS):
                part = whole.slice(i, ROWS)
                yield less(part.column(0), binaries(part, 1), [None] * part.num_rows)

    shape = "doc_id long, text string, n_words long, n_removed long"
    moved = _squeezed(own, sieve).join(gone.hint("merge"), "doc_id", "left").select("doc_id", "z", "gone").mapInArrow(cut, shape)
    return moved.union(own.select("doc_id", "text", sieve.slot("doc_id")).mapInArrow(rest, shape))


def digests(docs: DataFrame, **names: str) -> DataFrame:
    out = deduplicated(docs, **names)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
