"""Hierarchical packing: documents routed to context-size tiers, each tier packed, gaps filled from shorter tiers."""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, column, parts, ship, stored
from .tokenizer import default_path, word_ids

WINDOW, SMALLEST = 4096, 256
END = 2
#: Tokens that a task packs at a time, and tokens of a step group.
BUFFER, STEP = 1 << 21, 64 * WINDOW

Piece = tuple[int, int, int]  # length, document, start


class Packer:
    """Sequences of tiers SMALLEST, twice that, ... WINDOW, filled to the last token.

    Whole windows of a long document are sequences of their own. What is left of a document belongs to the smallest tier that
    holds it. From the largest tier down, the longest piece opens a sequence; the gap takes the longest pieces that fit,
    most of them from shorter tiers, and at last the head of the shortest piece left, whose rest is routed anew. When the
    pieces run out, the open sequence waits for the next documents. At the very end it is cut into tiers, and what is left,
    less than the smallest, is one sequence of that tier, the only one that is padded.
    """

    def __init__(self, window: int = WINDOW, smallest: int = SMALLEST) -> None:
        self.window, self.tiers = window, [t for t in (smallest << k for k in range(32)) if t <= window]
        self.pools: list[list[Piece]] = [[] for _ in self.tiers]

    def _tier(self, n: int) -> int:
        return max(0, (n - 1).bit_length() - (self.tiers[0].bit_length() - 1))

    def _put(self, piece: Piece) -> None:
        insort(self.pools[self._tier(piece[0])], piece)

    def _fitting(self, room: int) -> Piece | None:
        for k in range(self._tier(room), -1, -1):
            at = bisect_right(self.pools[k], (room, 1 << 62, 0)) - 1
            if at >= 0:
                return self.pools[k].pop(at)
        return None

    def pack(self, pieces: list[Piece], last: bool) -> Iterator[tuple[int, list[Piece]]]:
        """Sequences as a tier and pieces; all but the last of a task are full."""
        for n, doc, start in pieces:
            while n >= self.window:
                yield self.window, [(self.window, doc, start)]
                n, start = n - self.window, start + self.window
            if n:
                self._put((n, doc, start))
        for k in range(len(self.tiers) - 1, -1, -1):
            while self.pools[k]:
                own = [self.pools[k].pop()]
                room = self.tiers[k] - own[0][0]
                while room:
                    piece = self._fitting(room)
                    if piece is None:
                        pool = next((p for p in self.pools if p), None)
                        if pool is None:
                            break
                        n, doc, start = pool.pop(0)
                        self._put((n - room, doc, start + room))
                        piece = room, doc, start
                    own.append(piece)
                    room -= piece[0]
                if not room:
                    yield self.tiers[k], own
                elif last:
                    yield from self._cut(own)
                else:
                    for piece in own:
                        self._put(piece)
                    return

    def _cut(self, pieces: list[Piece]) -> Iterator[tuple[int, list[Piece]]]:
        left = sum(p[0] for p in pieces)
        while left:
            size = max(1 << (left.bit_length() - 1), self.tiers[0])
            out, room = [], min(size, left)
            while room:
                n, doc, start = pieces[0]
                take = min(n, room)
                out.append((take, doc, start))
                room -= take
                pieces = pieces[1:] if take == n else [(n - take, doc, start + take), *pieces[1:]]
            yield size, out
            left -= min(size, left)


def balanced(sizes: list[int], step: int = STEP) -> list[int]:
    """A step group for each sequence, so that the groups hold about equal numbers of tokens."""
    heap = [(0, g) for g in range(max(1, round(sum(sizes) / step)))]
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        load, g = heap[0]
        heapq.heapreplace(heap, (load + sizes[k], g))
        out[k] = g
    return out


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
#: Added to the sequence and group numbers of what is packed from the remainders of several tasks.
_LATER = 1 << 55


class _Task:
    """Packs what one task reads: pieces of documents, each with its bytes, its document's size and where it starts there."""

    def __init__(self, base: int, window: int, smallest: int) -> None:
        self.packer, self.base, self.held, self.fresh, self.waiting = Packer(window, smallest), base, {}, [], 0
        self.n_seq = self.n_step = self.n = 0

    def add(self, key: int | None, ids: bytes, start: int, size: int) -> None:
        self.held[self.n] = key, ids, start, size
        self.fresh.append((len(ids) // 4, self.n, 0))
        self.n += 1
        self.waiting += len(ids) // 4

    def rows(self, last: bool) -> pa.RecordBatch:
        done = list(self.packer.pack(self.fresh, last))
        self.fresh, self.waiting = [], 0
        groups = balanced([size for size, _ in done])
        out = [[] for _ in NAMES]
        for (size, pieces), g in zip(done, groups, strict=True):
            offset = 0
            for n, doc, start in pieces:
                key, ids, first, all_ = self.held[doc]
                row = (key, first + start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), all_, self.base + self.n_seq, offset, size, self.base + self.n_step + g)
                for c, v in zip(out, row, strict=True):
                    c.append(v)
                offset += n
            self.n_seq += 1
        self.n_step += max(groups, default=-1) + 1
        left = {doc for pool in self.packer.pools for _, doc, _ in pool}
        for doc in [d for d in self.held if d not in left]:
            del self.held[doc]
        return _batch(out, [None] * len(out[0]))

    def remainder(self) -> pa.RecordBatch:
        """What is left, less than a window, with its ids."""
        out, ids = [[] for _ in NAMES], []
        for pool in self.packer.pools:
            for n, doc, start in pool:
                key, own, first, all_ = self.held[doc]
                for c, v in zip(out, (key, first + start, n, None, all_, None, None, None, None), strict=True):
                    c.append(v)
                ids.append(own[4 * start : 4 * (start + n)])
        return _batch(out, ids)


def _batch(columns: list[list], ids: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(ids, pa.binary())], names=[*NAMES, "ids"])


def packed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, window: int = WINDOW, smallest: int = SMALLEST) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    Null and empty texts have the end token only. A text of any length is cut; every token lies in one piece. Every row of a
    table is packed, repeated ones and ones without doc_id too; ids are integers and other columns are not read. An empty
    table gives no rows. Tokenising, cutting and packing happen where the rows are read; a task holds BUFFER tokens and one
    document at a time. Only the remainders of the tasks, less than a window each, are moved and packed together. A sequence
    is as long as its tier, but for one of about two million tokens of remainders that holds less than the smallest.
    """
    ship(docs.sparkSession)
    path = tokenizer or default_path()
    schema = ", ".join(f"`{c}` long" for c in NAMES) + ", ids binary"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(TaskContext.get().partitionId() << 32, window, smallest)
        ids, end = word_ids(path), END.to_bytes(4, "little")
        for batch in parts(batches):
            for key, x in zip(batch.column(0).to_pylist(), binaries(batch, 1), strict=True):
                own = ids.text(x) + end
                task.add(key, own, 0, len(own) // 4)
                if task.waiting >= BUFFER:
                    yield task.rows(False)
        yield task.rows(False)
        yield task.remainder()

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(_LATER + (TaskContext.get().partitionId() << 32), window, smallest)
        for batch in batches:
            for key, start, size, own in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                task.add(key, own, start, size)
        yield task.rows(True)

    own = docs.select(column(docs, doc_id, "long").alias("doc_id"), column(docs, text, "string").alias("text"))
    done = stored(own.mapInArrow(first, schema))
    left = done.where("ids is not null").select("doc_id", "start", "doc_tokens", "ids")
    tasks = int((left.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()[0] // 4) // BUFFER) + 1
    later = left.repartition(tasks).sortWithinPartitions("doc_id", "start").mapInArrow(rest, schema)
    return done.where("ids is null").union(later).select(*NAMES)
