"""Near-duplicate documents by SimHash: a segment-popcount embedding, a grid join under Manhattan distance, exact checks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import cells, verified
from .common import binaries, column, discard, looked_up, mix, parts, ship, steps, stored
from .components import components
from .minhash import JACCARD, by_sets
from .minhash import SHINGLE as SET_SHINGLE

SHINGLE, SEED, BITS = 4, 42, 4
#: Cost of a row in a grid, in comparisons of two fingerprints; bands at least, so that tables of up to some million
#: fingerprints have the same number of rows for each.
ROW, LEAST_BANDS = 150, 6
_ODD = np.uint64(0x5555555555555555)

#: Words of 64 bits of a wide fingerprint, its two-bit segments, and how many of them a fine grid takes.
WIDE, FINE = 8, 10
SEGMENTS = 32 * WIDE
#: Bits in which sets at JACCARD differ at most: 78 on average, with a deviation of 8; sets of FEW shingles or less, whose
#: majorities are close, 96 on average.
WIDE_BITS, FEW_BITS, FEW = 128, 148, 7
#: Share of bits that differ at JACCARD: the most for any two sets (13 and 14 shingles), and for sets of 4 and 5.
APART, FEW_APART = 0.1612, 0.1875
#: Chance that a pair at JACCARD meets in no grid; rows of a block; sheaves at least, and what moving a row costs in fine grids.
LOST, PER, SHEAVES, MOVED = 1e-6, 1 << 18, 16, 256
#: Pairs that are compared at a time; rows from which on a group is a crowd; rows of a coarse cell that needs no fine grids.
AT_ONCE, CROWD, ALL = 1 << 17, 32, 256
_LANES = np.uint64(0x0101010101010101)
_WIDE = mix(np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def fingerprints(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """SimHash of each text: A-Z lower-cased, words without \\x20 and \\x09-\\x0D, shingles of some words with repeats."""
    hashed: list[int] = []
    count = np.zeros(len(texts), np.int64)
    add, digest = hashed.extend, xxhash.xxh64_intdigest
    for k, x in enumerate(texts):
        words = x.lower().split()
        n = len(words)
        if not n:
            continue
        line = b" ".join(words)
        if n <= size:
            add((digest(line, SEED),))
            count[k] = 1
            continue
        end = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        start = np.zeros(n, np.int64)
        start[1:] = end[:-1]
        add([digest(line[s:e], SEED) for s, e in zip(start[: n - size + 1].tolist(), (end[size - 1 :] - 1).tolist(), strict=True)])
        count[k] = n - size + 1
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        bits = np.unpackbits(np.array(hashed, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = np.cumsum(count[some]) - count[some]
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > count[some][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def embedded(fp: np.ndarray) -> np.ndarray:
    """The bit counts of the 32 two-bit segments of a fingerprint, each in two bits."""
    return (fp & _ODD) + ((fp >> np.uint64(1)) & _ODD)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of two embeddings; never more than the Hamming distance of the fingerprints."""
    x = a ^ b
    high = (x >> np.uint64(1)) & _ODD
    return np.bitwise_count(x & _ODD).astype(np.int64) + 2 * np.bitwise_count(high & ~x)


def bands_for(n: int, bits: int = BITS) -> int:
    """The number of bands at which n random fingerprints cost least, in rows of grids and in comparisons by chance.

    With b bands at most `bits` of them differ, so b - bits agree in full: no link is lost at any number of bands. Two random
    two-bit segments have equal counts in 3 of 8 cases. It is 15 grids for a million fingerprints, 35 for 10**8, 70 for 10**9.
    """
    return min(range(max(bits + 1, LEAST_BANDS), 17), key=lambda b: comb(b, bits) * (ROW + n * 0.375 ** (32 * (b - bits) / b)))


def masks(bands: int, bits: int = BITS) -> np.ndarray:
    """Which segments of the embedding each grid takes: all choices of bands - bits bands."""
    cut = [32 * k // bands for k in range(bands + 1)]
    one = [sum(3 << (2 * s) for s in range(cut[k], cut[k + 1])) for k in range(bands)]
    return np.array([sum(one[k] for k in c) for c in combinations(range(bands), bands - bits)], np.uint64)


def linked(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Components of the fingerprints that differ in few bits: node, component, for nodes that reach a smaller one.

    fps has one row per fingerprint: fp and node. The cells of a grid hold fingerprints that agree in bands - bits bands of
    the embedding. A large cell is cut into pairs of blocks, and only a spanning forest of each cell leaves it.
    """
    grid = masks(bands_for(fps.count(), bits), bits)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, node = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()
            e = embedded(fp.view(np.uint64))
            for k, m in enumerate(grid):
                key = mix((e & m) ^ mix(np.full(len(e), k + 1, np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node), pa.array(fp)], names=["key", "node", "fp"])

    def pairs(rows: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        fp = rows["fp"].view(np.uint64)
        out = manhattan(embedded(fp[i]), embedded(fp[j])) <= bits
        out[out] = np.bitwise_count(fp[i[out]] ^ fp[j[out]]) <= bits
        return out

    def dense(rows: dict, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray]:
        fp = rows["fp"].view(np.uint64)
        i, j = np.nonzero(np.bitwise_count(fp[i0:i1, None] ^ fp[None, j0:j1]) <= bits)
        return i + i0, j + j0

    dealt = cells(fps.select("fp", "node").mapInArrow(keys, "key long, node long, fp long"))
    found = verified(dealt, ["fp"], pairs, dense, lambda rows, i, j: np.zeros(len(i), bool))
    return components(found.select(F.col("node").alias("a"), F.col("label").alias("b")))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id (the smallest doc_id reachable by links).

    Texts that are null, empty or blank have fingerprint zero, which links like any other. Equal fingerprints are one node, so
    a group of exact copies costs one row. Rows with one doc_id are one document with several fingerprints. A row without
    doc_id gets the component of its fingerprint, or null if no row with a doc_id has it. Ids are integers. Very long texts
    are hashed whole, one at a time. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = binaries(batch, 1)
            fp = np.concatenate([fingerprints(texts[i:j]) for i, j in steps(texts)] or [np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    own = stored(docs.select(column(docs, doc_id, "long").alias("doc_id"), column(docs, text, "string").alias("text")).mapInArrow(run, "doc_id long, fp long"))
    nodes = stored(own.groupBy("fp").agg(F.min("doc_id").alias("node")))
    several = own.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y and doc_id is not null").select("doc_id")
    fps = nodes.where("node is not null")
    groups = stored(linked(fps, bits))
    more = own.join(several, "doc_id").join(nodes.select("fp", "node"), "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b")
    if more.limit(1).count():
        groups = stored(components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)))
    labels = stored(fps.join(groups.hint("merge"), "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")))
    discard(nodes)
    discard(groups)
    return looked_up(own, labels, "fp", "doc_id").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def wide(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash of WIDE words of each set of hashes (none of them empty): a bit is 1 if set in over half of them."""
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets)
    # eight counts lie in the bytes of a word, so they are summed over pieces of at most 255 hashes
    pieces = -(-size // 255)
    first = np.cumsum(pieces) - pieces
    at = np.repeat(np.cumsum(size) - size, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    ones = np.empty((len(sets), WIDE, 8, 8), np.int64)
    for w in range(WIDE):
        x = mix(flat ^ _WIDE[w])
        for k in range(8):
            part = np.add.reduceat((x >> np.uint64(k)) & _LANES, at).astype("<u8").view(np.uint8).reshape(-1, 8)
            ones[:, w, :, k] = np.add.reduceat(part, first, axis=0, dtype=np.int64)
    return np.packbits((2 * ones > size[:, None, None, None]).reshape(len(sets), -1), axis=1, bitorder="little").view("<u8")


def _met(share: float, taken: int) -> tuple[np.ndarray, np.ndarray]:
    """How likely 0, 1, ... segments of two fingerprints have equal counts, and then all those that a grid takes."""
    same = (1 - share) ** 2 + share**2 / 2
    p = np.array([comb(SEGMENTS, k) * same**k * (1 - same) ** (SEGMENTS - k) for k in range(SEGMENTS + 1)])
    return p, np.array([comb(k, taken) / comb(SEGMENTS, taken) for k in range(SEGMENTS + 1)])


def lost(share: float, coarse: int, sheaves: int, fine: int) -> float:
    """Chance that two fingerprints, each bit of which differs with that probability, meet in no grid of any sheaf."""
    p, met = _met(share, FINE)
    return float((p * (1 - _met(share, coarse)[1] * (1 - (1 - met) ** fine)) ** sheaves).sum())


@cache
def sheaves(coarse: int, fine: int, share: float) -> int:
    """The number of sheaves at which no more than LOST is lost."""
    low, high = 1, 1 << 20
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if lost(share, coarse, middle, fine) <= LOST else (middle + 1, high)
    return max(low, SHEAVES)


def sheaf_plan(n: int) -> tuple[int, int, int, int]:
    """Segments of a coarse grid, sheaves, sheaves for small sets, fine grids of a sheaf, for n fingerprints.

    A sheaf is a coarse grid, by which rows are dealt to tasks, and fine grids within its cells. What costs least is taken, in
    rows moved and grids; a cell of more than a block is cut, and its rows are moved once for each block.
    """
    options = ((c, k) for c in range(17) for k in ((64,) if c == 0 else (64, 128, 256)))
    coarse, fine = min(options, key=lambda x: max(1.0, n * 0.375 ** x[0] / PER) * sheaves(x[0], x[1], APART) * (MOVED + x[1]))
    own = sheaves(coarse, fine, APART)
    return coarse, own, max(own, sheaves(coarse, fine, FEW_APART)), fine


def taken(e: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Counts of the given segments as one number; e holds the embedding, a row for each word."""
    out = np.zeros(e.shape[1], np.uint64)
    for s in segments.tolist():
        out = out * np.uint64(3) + ((e[s // 32] >> np.uint64(2 * (s % 32))) & np.uint64(3))
    return out


def close(fp: np.ndarray, e: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether pairs are within `most`: first by the Manhattan distance of the embeddings, part by part, then by differing bits."""
    out = np.arange(len(i))
    distance = np.zeros(len(i), np.int64)
    for a, b in ((0, WIDE // 2), (WIDE // 2, 3 * WIDE // 4), (3 * WIDE // 4, WIDE)):
        for w in range(a, b):
            distance += manhattan(e[w][i[out]], e[w][j[out]])
        near = distance <= most[out]
        out, distance = out[near], distance[near]
    apart = sum(np.bitwise_count(fp[w][i[out]] ^ fp[w][j[out]]).astype(np.int64) for w in range(WIDE))
    result = np.zeros(len(i), bool)
    result[out[apart <= most[out]]] = True
    return result


def united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels, each the smallest row of its tree, after the trees of i and j are joined."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while ((up := label[label]) != label).any():
            label = up


def forest(fp: np.ndarray, size: np.ndarray, block: np.ndarray, grids: list[np.ndarray], least: float) -> np.ndarray:
    """The smallest row that each row reaches by links between rows that agree in a grid, between any without a grid.

    Where there are two blocks, the rows of one need not meet."""
    n = len(size)
    e, label = embedded(fp), np.arange(n)
    several = n and (block != block[0]).any()
    scaled = round(least * 1000)

    def tell(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal label
        if several:
            other = block[i] != block[j]
            i, j = i[other], j[other]
        a, b = size[i], size[j]
        fit = np.flatnonzero((np.minimum(a, b) * 1000 >= scaled * np.maximum(a, b)) & (label[i] != label[j]))
        i, j = i[fit], j[fit]
        ok = close(fp, e, i, j, np.where(np.minimum(size[i], size[j]) <= FEW, FEW_BITS, WIDE_BITS))
        label = united(label, i[ok], j[ok])

    def all_between(order: np.ndarray, first: np.ndarray, end: np.ndarray) -> None:
        """The rows at each place with those from `first` to `end`, places of order too."""
        total = np.append(0, np.cumsum(end - first))
        a, places = 0, len(order)
        while a < places and total[a] < total[-1]:
            b = max(a + 1, int(np.searchsorted(total, total[a] + AT_ONCE, "right")) - 1)
            count = total[a + 1 : b + 1] - total[a:b]
            j = np.arange(total[b] - total[a]) + np.repeat(first[a:b] - total[a:b] + total[a], count)
            tell(np.repeat(order[a:b], count), order[j])
            a = b

    def ends(edge: np.ndarray) -> np.ndarray:
        end = np.append(np.flatnonzero(edge) + 1, len(edge) + 1)
        return np.repeat(end, np.diff(end, prepend=0))

    if not grids:
        tell(*np.triu_indices(n, 1))
        return label
    # neighbours first, so that a group of near copies has one label before its rows would all meet each other
    keys = [taken(e, g).astype(np.uint16) for g in grids]
    for key in keys[:8]:
        order = np.argsort(key, kind="stable")
        for d in (1, 2):
            i = np.flatnonzero(key[order[:-d]] == key[order[d:]])
            tell(order[i], order[i + d])
    crowd = np.bincount(label, minlength=n)[label] > CROWD
    # rows outside such groups meet those of a cell that are up to 1 / least times as large
    light = np.flatnonzero(~crowd)
    light = light[np.argsort(size[light], kind="stable")]
    wide_as = int(size.max()) * 2 if n else 1
    for key in keys if len(light) > 1 else []:
        order = light[np.argsort(key[light], kind="stable")]
        at, own = key[order].astype(np.int64) * wide_as, size[order]
        end = np.searchsorted(at + own, at + np.minimum(own * 1000 // scaled, wide_as - 1), "right")
        all_between(order, np.arange(1, len(order) + 1), end)
    # rows of such a group meet all others of a cell but not each other
    heavy = np.flatnonzero(crowd)
    for key in keys if len(heavy) else []:
        seen = np.zeros(1 << 16, bool)
        seen[key[heavy]] = True
        rows = np.flatnonzero(seen[key])
        rows = rows[np.argsort(label[rows], kind="stable")]
        order = rows[np.argsort(key[rows], kind="stable")]
        x, y = key[order], label[order]
        edge = x[1:] != x[:-1]
        all_between(order, ends(edge | (y[1:] != y[:-1])), ends(edge))
    return label


def segments_of(sheaf: int, coarse: int, fine: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The segments of a sheaf's coarse grid and of its fine grids."""
    r = np.random.default_rng([9, sheaf])
    return r.choice(SEGMENTS, coarse, replace=False), [r.choice(SEGMENTS, FINE, replace=False) for _ in range(fine)]


def met(signed: DataFrame, least: float) -> DataFrame:
    """Components of the sets whose fingerprints are close: node, component. signed has s, size and fp."""
    coarse, own, more, fine = sheaf_plan(signed.count())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            few = pa.array(batch.column(1).to_numpy() <= FEW)
            for part, which in ((batch, range(own)), (batch.filter(few), range(own, more))):
                if not part.num_rows:
                    continue
                e = embedded(_words(part.column(2)))
                for k in which:
                    key = mix(taken(e, segments_of(k, coarse, 0)[0]) ^ mix(np.full(part.num_rows, k + 1, np.uint64)))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(part.num_rows, k, np.int32)), *part.columns], names=["key", "sheaf", "node", "size", "fp"])

    def run(t: pa.Table) -> pa.Table:
        node = t.column("node").to_numpy()
        grids = segments_of(t.column("sheaf")[0].as_py(), coarse, fine)[1] if not coarse or t.num_rows > ALL else []
        label = forest(_words(t.column("fp")), t.column("size").to_numpy(), t.column("block").to_numpy(), grids, least)
        out = np.flatnonzero(label != np.arange(len(node)))
        return pa.table({"a": pa.array(node[out]), "b": pa.array(node[label[out]])})

    dealt = cells(signed.select("s", "size", "fp").mapInArrow(deal, "key long, sheaf int, node long, size long, fp binary"), per=PER)
    found = dealt.groupBy("key", "cell_a", "cell_b").applyInArrow(run, "a long, b long")
    return stored(components(found))


def _words(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Wide fingerprints as an array with a row for each of their words."""
    return np.ascontiguousarray(np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, WIDE).T)


def similar_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SET_SHINGLE, jaccard: float = JACCARD) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable by pairs of at least that Jaccard similarity of their shingles).

    SimHash of 512 bits finds the candidates: fingerprints of the sets of shingles meet in grids over the counts of their
    two-bit segments, and are compared by the Manhattan distance of all counts, then by their differing bits. A pair goes
    into a component only if the whole sets have the similarity. Of pairs at JACCARD LOST are not met; of more similar ones
    less. jaccard is JACCARD or more. Texts without a word, null ones too, are alike. Rows with one doc_id are one document
    with several texts. A row without doc_id gets the component of its shingles, or null if no row with a doc_id has them.
    Other columns are not read. An empty table gives no rows.
    """
    if jaccard < JACCARD:
        raise ValueError(f"the grids reach pairs of a similarity of {JACCARD} or more")

    def sketch(sets: list[np.ndarray]) -> list[list]:
        return [[x.tobytes() for x in wide(sets)]]

    return by_sets(docs, text, doc_id, size, jaccard, sketch, {"fp": (pa.binary(), "binary")}, lambda signed: met(signed, jaccard))
