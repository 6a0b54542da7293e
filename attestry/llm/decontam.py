"""Benchmark decontamination: a broadcast hash set of item windows, a scan of document windows, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORDS, binaries, column, parts, ship, steps, stored, word_hashes

WINDOW = 8
#: Text of the items in one set, at most, by far the largest part of which are 24 bytes a word; a larger benchmark is cut into
#: several sets, and the documents are scanned once for each.
SET_BYTES = 16 << 20
#: Bits of a hash that a table tests before the hash itself is looked up, at most.
TABLE_BITS = 24

#: A-Z to a-z; every other byte outside 0-9, a-z and \x80-\xFF to a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class ItemSet:
    """The windows of benchmark items as sorted hashes, with their words for verification; flat arrays only."""

    def __init__(self, items: list[tuple[int | None, bytes]], size: int = WINDOW) -> None:
        kept = [(i, b" ".join(words(t))) for i, t in items if i is not None]
        kept = [(i, t) for i, t in kept if t]
        self.text = b" ".join(t for _, t in kept)
        own = [t for _, t in kept]
        cuts = [word_hashes(own[i:j]) for i, j in steps(own)]
        h = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in cuts)])
        n = np.concatenate([np.zeros(0, np.int64), *(np.diff(f) for _, f in cuts)])
        first = np.append(0, np.cumsum(n))
        count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        doc = np.repeat(np.arange(len(kept)), count)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][doc] if len(doc) else np.zeros(0, np.int64)
        width = np.minimum(n, size)[doc] if len(doc) else np.zeros(0, np.int64)
        gap = np.flatnonzero(np.frombuffer(self.text, np.uint8) == 32) if self.text else np.zeros(0, np.int64)
        begin, end = np.append(0, gap + 1), np.append(gap, len(self.text))
        hashes = WORDS.spans(WORDS.prefix(h), at, at + width) if len(doc) else np.zeros(0, np.uint64)
        order = np.lexsort((doc, hashes, width))
        self.lengths = np.unique(width).tolist()
        self.parts = {}
        ids = np.array([i for i, _ in kept], np.int64)
        for w in self.lengths:
            own = order[width[order] == w]
            value = hashes[own]
            bits = min(TABLE_BITS, max(10, int(len(own)).bit_length() + 4))
            table = np.zeros(1 << bits, bool)
            table[(value & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
            self.parts[w] = value, begin[at[own]], end[at[own] + w - 1], ids[doc[own]], table, np.uint64((1 << bits) - 1)

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray | None, np.ndarray]]:
        """For each text: number of words, which of them are hit, the items found, sorted. Only texts with a hit get a mask."""
        flat = [x.translate(FOLD) for x in texts]
        h, first = word_hashes(flat)
        prefix = WORDS.prefix(h)
        hits: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        split: dict[int, list[bytes]] = {}
        for n in self.lengths:
            value, begin, end, ids, table, low = self.parts[n]
            if len(h) < n:
                continue
            start = np.arange(len(h) - n + 1)
            own = WORDS.spans(prefix, start, start + n)
            start = start[table[(own & low).astype(np.int64)]]
            row = np.searchsorted(first, start, "right") - 1
            fit = start + n <= first[row + 1]
            start, row = start[fit], row[fit]
            own = own[start]
            lo, hi = np.searchsorted(value, own), np.searchsorted(value, own, "right")
            for k in np.flatnonzero(lo < hi):
                r, s = int(row[k]), int(start[k])
                if r not in split:
                    split[r] = flat[r].split()
                at = s - int(first[r])
                same = b" ".join(split[r][at : at + n])
                right = [m for m in range(int(lo[k]), int(hi[k])) if self.text[begin[m] : end[m]] == same] if hi[k] - lo[k] < 64 else self._same(int(lo[k]), int(hi[k]), begin, end, same)
                if len(right):
                    hits.setdefault(r, []).append((at, n, ids[right]))
        counts = np.diff(first)
        for r, n in enumerate(counts.tolist()):
            if r not in hits:
                yield n, None, np.zeros(0, np.int64)
                continue
            mask = np.zeros(n, bool)
            for s, m, _ in hits[r]:
                mask[s : s + m] = True
            yield n, mask, np.unique(np.concatenate([x[2] for x in hits[r]]))

    def _same(self, lo: int, hi: int, begin: np.ndarray, end: np.ndarray, same: bytes) -> np.ndarray:
        """Of many windows with one hash those with the words; equal words are compared once for each distinct place's bytes."""
        k = np.arange(lo, hi)
        k = k[end[k] - begin[k] == len(same)]
        if not len(k):
            return k
        a = np.frombuffer(self.text, np.uint8)
        return k[(a[begin[k][:, None] + np.arange(len(same))] == np.frombuffer(same, np.uint8)).all(1)]


def _items(benchmark: DataFrame, item_id: str, text: str) -> tuple[DataFrame, int]:
    """The items with text, and in how many sets they go."""
    rows = benchmark.select(column(benchmark, item_id, "long").alias("item"), column(benchmark, text, "binary").alias("text")).where("item is not null and text is not null")
    total = rows.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    return rows, int(total // SET_BYTES) + 1


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """All columns of docs, and _words long, _hit long, _items array<long>, _clean string (the text without the hit words).

    Null and empty texts have no words; an item of fewer words than a window is one window; items without words, without
    text or without id are not looked for. Items with the same id are one item; ids are integers. Very long texts are
    scanned whole, one at a time. The scan moves no rows. The set of windows is sent to the tasks; a benchmark of more than
    SET_BYTES of text goes there in several sets, one after the other: each is sent, the documents are scanned for it and
    what it hits is written, before the next is built, so the driver and a task hold one set. A single item is never cut.
    """
    ship(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("_words", "_hit", "_items", "_clean")]
    out = docs.select(*(f"`{c}`" for c in names))
    more = [T.StructField("_words", T.LongType()), T.StructField("_hit", T.LongType()), T.StructField("_items", T.ArrayType(T.LongType())), T.StructField("_clean", T.StringType())]
    schema = T.StructType([*out.schema.fields, *more])
    at = names.index(text) if text in names else None
    rows, n_sets = _items(benchmark, item_id, item_text)
    told = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]
    if n_sets == 1:
        sent = docs.sparkSession.sparkContext.broadcast(ItemSet([(r.item, bytes(r.text)) for r in rows.collect()], size))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts(batches):
                texts = binaries(batch, at) if at is not None else [b""] * batch.num_rows
                cells: list[list] = [[], [], [], []]
                for i, j in steps(texts):
                    for x, (n, mask, found) in zip(texts[i:j], sent.value.scan(texts[i:j]), strict=True):
                        for c, v in zip(cells, _row(x, n, mask, found), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(cells, told, strict=True))], names=[*names, "_words", "_hit", "_items", "_clean"])

        return out.mapInArrow(run, schema)
    # equal texts have equal hits, so two hashes of a text name its row
    body = F.col(f"`{text}`").cast("string") if at is not None else F.lit(None).cast("string")
    named = {"_x": F.xxhash64(body), "_y": F.xxhash64(F.lit("y"), body)}
    scanned = docs.select(*(v.alias(k) for k, v in named.items()), body.alias("t"))
    seen = None
    for k in range(n_sets):
        sent = docs.sparkSession.sparkContext.broadcast(ItemSet([(r.item, bytes(r.text)) for r in rows.where(F.pmod(F.xxhash64("item"), F.lit(n_sets)) == k).collect()], size))

        def sparse(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in parts(batches):
                texts = binaries(batch, 2)
                for i, j in steps(texts):
                    own = [(r, mask, found) for r, (_, mask, found) in enumerate(sent.value.scan(texts[i:j]), i) if mask is not None]
                    where = pa.array([r for r, _, _ in own], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array([np.packbits(m).tobytes() for _, m, _ in own], pa.binary()), pa.array([f.tolist() for _, _, f in own], pa.list_(pa.int64()))], names=["_x", "_y", "mask", "items"])

        one = stored(scanned.mapInArrow(sparse, "_x long, _y long, mask binary, items array<long>").dropDuplicates(["_x", "_y"]))
        sent.destroy()
        seen = one if seen is None else seen.unionByName(one)
    merged = seen.groupBy("_x", "_y").agg(F.collect_list("mask").alias("_masks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_found"))
    joined = out.withColumns(named).join(merged, ["_x", "_y"], "left").select(*(f"`{c}`" for c in names), "_masks", "_found")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = binaries(batch, at) if at is not None else [b""] * batch.num_rows
            cells: list[list] = [[], [], [], []]
            for x, masks, found in zip(texts, batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True):
                n = len(words(x))
                mask = np.logical_or.reduce([np.unpackbits(np.frombuffer(m, np.uint8), count=n).astype(bool) for m in masks]) if masks else None
                for c, v in zip(cells, _row(x, n, mask, found or []), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(c, t) for c, t in zip(cells, told, strict=True))], names=[*names, "_words", "_hit", "_items", "_clean"])

    return joined.mapInArrow(join, schema)


def _row(text: bytes, n: int, mask: np.ndarray | None, found: np.ndarray | list[int]) -> tuple:
    return n, 0 if mask is None else int(mask.sum()), list(found), None if mask is None else without(text, mask)


def without(text: bytes, mask: np.ndarray) -> str:
    """The text less its hit words and what stands between two of them."""
    flat, out, last, inside = text.translate(FOLD), [], 0, False
    pos = 0
    for k, w in enumerate(flat.split()):
        s = flat.index(w, pos)
        pos = s + len(w)
        if mask[k] and not inside:
            out.append(text[last:s])
            inside = True
        elif not mask[k] and inside:
            last, inside = s, False
    if not inside:
        out.append(text[last:])
    return b"".join(out).decode("utf-8", "replace").strip()


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the ids sorted as strings), contaminated (two items or more)."""
    own = docs.select(column(docs, doc_id, "long").alias("doc_id"), column(docs, text, "string").alias("text"))
    found = hits(own, benchmark, **options)
    listed = F.array_join(F.array_sort(F.transform("_items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", F.col("_words").alias("n_words"), F.col("_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.size("_items") >= 2).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", most: float = 0.5, **options) -> DataFrame:
    """docs without contaminated documents, and without the hit words of the others.

    A document goes if it holds windows of two items or more, or if at least `most` of its words are hit (above 1: whatever
    its words are); in the others the spans of one item are cut out and the rest stays. Documents without a hit stay as they are.
    """
    found = hits(docs, benchmark, text=text, **options)
    keep = (F.size("_items") < 2) & ((F.col("_hit") == 0) | (F.col("_hit") < most * F.col("_words")))
    names = [c for c in docs.columns]
    out = found.where(keep).withColumn(text, F.coalesce("_clean", F.col(f"`{text}`")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("_hit") > 0, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*(f"`{c}`" for c in names))
