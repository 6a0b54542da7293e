"""Near-duplicate documents by the Jaccard similarity of their word shingles: MinHash finds candidates, whole sets decide.

Texts with one set of shingles are one node. Nodes that agree in a band of MinHash values are compared by a signature of 64
bytes, which drops chance meetings only. Components of what is left hold every link that was met, so each node's set
travels to one component, where the similarity of all pairs is computed from the sets. A pair at similarity 0.8 shares no
band with probability (1 - 0.8 ** 5) ** 32, or 3e-6, and is dropped by the signature with about 1e-7; more similar pairs are lost less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import cells, join, verified
from .common import WORDS, binaries, column, discard, looked_up, mix, parts, ship, steps, stored, word_hashes
from .components import components

SHINGLE, JACCARD = 5, 0.8
BANDS, DEPTH = 32, 5
#: Bytes of a signature, how many agree at least at JACCARD (51 do on average, with a deviation of 3.2).
SIGNED, AGREE = 64, 34
#: Sets in a block of a component, and columns of the incidence matrix held at once.
PER, WIDE = 512, 4096
_FACTORS = mix(np.arange(1, BANDS * DEPTH + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted hashes of the shingles of each text: A-Z lower-cased, words without \\x20 and \\x09-\\x0D; fewer words than size are one shingle."""
    h, first = word_hashes([x.lower() for x in texts])
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at = np.cumsum(count) - count
    doc = np.repeat(np.arange(len(n)), count)
    start = np.arange(len(doc)) - at[doc] + first[:-1][doc]
    v = WORDS.spans(WORDS.prefix(h), start, np.minimum(start + size, first[1:][doc])) if len(doc) else np.zeros(0, np.uint64)
    return [np.unique(v[a : a + c]) for a, c in zip(at.tolist(), count.tolist(), strict=True)]


def name(own: np.ndarray) -> int:
    """The name of a set, as a signed number."""
    x = xxhash.xxh64_intdigest(own.tobytes(), 7)
    return x - (1 << 64) if x >> 63 else x


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The least value of each set (none of them empty) under every hash function."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    return np.stack([np.minimum.reduceat(flat * f, at) for f in _FACTORS], axis=1)


def keys(least: np.ndarray) -> np.ndarray:
    """A key for each band."""
    out = np.tile(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(least), 1))
    for k in range(DEPTH):
        out = mix(out ^ mix(least[:, k::DEPTH]) + np.uint64(k))
    return out


def signature(least: np.ndarray) -> np.ndarray:
    return (mix(least[:, :SIGNED]) >> np.uint64(56)).astype(np.uint8)


def similar(sets: list[np.ndarray], least: float = JACCARD) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of sets with at least that Jaccard similarity, exactly."""
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    values, col, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    several = np.flatnonzero(seen > 1)
    place = np.full(len(values), -1)
    place[several] = np.arange(len(several))
    col = place[col]
    row, col = row[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((n, n), np.float64)
    for a in range(0, len(several), WIDE):
        i, j = np.searchsorted(col, [a, a + WIDE])
        m = np.zeros((n, min(WIDE, len(several) - a)), np.float32)
        m[row[i:j], col[i:j] - a] = 1
        both += m @ m.T
    # in whole numbers: a pair at the threshold is linked
    union = size[:, None] + size[None, :] - both
    return np.nonzero(np.triu(both * 1000 >= round(least * 1000) * union, 1))


def candidates(signed: DataFrame, least: float) -> DataFrame:
    """Components of the sets whose signatures agree: node, component. signed has s, size, sig and keys."""
    hashed = stored(signed.select(F.col("s").alias("node"), F.explode("keys").alias("key")))
    shared = stored(hashed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    met = hashed.join(shared, "key", "left_semi").join(signed.select(F.col("s").alias("node"), "size", "sig"), "node")

    def sized(rows: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = rows["size"][i], rows["size"][j]
        return np.minimum(a, b) * 1000 >= round(least * 1000) * np.maximum(a, b)

    def pairs(rows: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = sized(rows, i, j)
        out[out] = (rows["sig"][i[out]] == rows["sig"][j[out]]).sum(1) >= AGREE
        return out

    def dense(rows: dict, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.ascontiguousarray(rows["sig"][i0:i1].T), np.ascontiguousarray(rows["sig"][j0:j1].T)
        same = np.zeros((i1 - i0, j1 - j0), np.uint8)
        for k in range(SIGNED):
            same += x[k][:, None] == y[k]
        i, j = np.nonzero(same >= AGREE)
        fit = sized(rows, i + i0, j + j0)
        return i[fit] + i0, j[fit] + j0

    found = verified(cells(met), ["size", "sig"], pairs, dense, lambda rows, i, j: np.zeros(len(i), bool))
    out = stored(components(found.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    discard(hashed)
    return out


def links(rows: DataFrame, least: float) -> DataFrame:
    """a and b: a spanning forest of the pairs of one component (key) that are similar; rows have key, node and v, the set as bytes."""

    def run(t: pa.Table) -> pa.Table:
        node = t.column("node").to_numpy()
        i, j = similar([np.frombuffer(x, np.uint64) for x in t.column("v").to_pylist()], least)
        label = np.arange(len(node))
        join(label, i, j)
        while (label[label] != label).any():
            label = label[label]
        out = np.flatnonzero(label != np.arange(len(node)))
        return pa.table({"a": pa.array(node[out]), "b": pa.array(node[label[out]])})

    return cells(rows, per=PER).select("key", "cell_a", "cell_b", "node", "v").groupBy("key", "cell_a", "cell_b").applyInArrow(run, "a long, b long")


def by_sets(docs: DataFrame, text: str, doc_id: str, size: int, jaccard: float, sketch: Callable[[list[np.ndarray]], list[list]], kinds: dict[str, tuple[pa.DataType, str]], meet: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id and component_id by pairs of at least that similarity, among those that meet() finds.

    sketch gives columns (of those kinds) for sets that are not empty; meet takes s, size and these columns and returns node
    and component of sets that may be similar. What it returns is compared by the whole sets.
    """
    ship(docs.sparkSession)
    own = docs.select(column(docs, doc_id, "long").alias("doc_id"), column(docs, text, "string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = binaries(batch, 1)
            for i, j in steps(texts):
                sets = shingle_sets(texts[i:j], size)
                some = [k for k, x in enumerate(sets) if len(x)]
                cells: list[list] = [[None] * len(sets) for _ in kinds]
                for c, v in zip(cells, sketch([sets[k] for k in some]) if some else [], strict=False):
                    for k, x in zip(some, v, strict=True):
                        c[k] = x
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([name(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), *(pa.array(c, t) for c, (t, _) in zip(cells, kinds.values(), strict=True))], names=["doc_id", "s", "size", *kinds])

    told = stored(own.mapInArrow(run, "doc_id long, s long, size long, " + ", ".join(f"{c} {t}" for c, (_, t) in kinds.items())))
    nodes = stored(told.groupBy("s").agg(F.min("doc_id").alias("node")).where("node is not null"))
    firsts = told.join(nodes.hint("merge"), (told.s == nodes.s) & (told.doc_id == nodes.node)).where("size > 0").select(told.s, "size", *kinds)
    groups = meet(stored(firsts.dropDuplicates(["s"])))
    roots = groups.select(F.col("component").alias("node"), "component").distinct()
    wanted = nodes.join(groups.union(roots).select(F.col("node").alias("s"), F.col("component").alias("key")), "s").select("s", "key", F.col("node").alias("doc_id"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts, s = binaries(batch, 0), batch.column(1).to_pylist()
            for i, j in steps(texts):
                sets = shingle_sets(texts[i:j], size)
                at = [k for k, x in enumerate(sets) if name(x) == s[i + k]]  # not another text of this doc_id
                yield pa.RecordBatch.from_arrays([pa.array([s[i + k] for k in at], pa.int64()), batch.column(2).take(pa.array([i + k for k in at], pa.int64())), pa.array([sets[k].tobytes() for k in at], pa.binary())], names=["node", "key", "v"])

    sets = stored(own.join(wanted.hint("merge"), "doc_id").select("text", "s", "key").mapInArrow(whole, "node long, key long, v binary"))
    edges = links(sets, jaccard)
    several = told.groupBy("doc_id").agg(F.min("s").alias("x"), F.max("s").alias("y")).where("x <> y and doc_id is not null").select("doc_id", "x")
    more = told.join(several.hint("merge"), "doc_id").select(F.col("s").alias("a"), F.col("x").alias("b"))
    linked = stored(components(edges.union(more)))
    labels = stored(nodes.join(linked.select(F.col("node").alias("s"), "component"), "s", "left").withColumn("component", F.coalesce("component", "s")))
    least = labels.groupBy("component").agg(F.min("node").alias("component_id"))
    given = stored(labels.join(least.hint("merge"), "component").select("s", "component_id"))
    for x in (sets, nodes, linked, labels, groups):
        discard(x)
    return looked_up(told.select("doc_id", "s"), given, "s", "doc_id").select("doc_id", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, jaccard: float = JACCARD) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable by pairs of at least that Jaccard similarity of their shingles).

    jaccard is JACCARD or more, for which the bands are chosen. Texts without a word, null ones too, are alike. Rows with one
    doc_id are one document with several texts. A row without doc_id gets the component of its shingles, or null if no row
    with a doc_id has them. Other columns are not read. An empty table gives no rows.
    """
    if jaccard < JACCARD:
        raise ValueError(f"the bands reach pairs of a similarity of {JACCARD} or more")

    def sketch(sets: list[np.ndarray]) -> list[list]:
        m = minima(sets)
        return [[x.tobytes() for x in signature(m)], list(keys(m).view(np.int64))]

    kinds = {"sig": (pa.binary(), "binary"), "keys": (pa.list_(pa.int64()), "array<long>")}
    return by_sets(docs, text, doc_id, size, jaccard, sketch, kinds, lambda signed: candidates(signed, jaccard))
