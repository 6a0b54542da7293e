"""Exact verification inside hash buckets without listing a bucket's pairs.

A bucket of up to PER rows is one cell. A larger one is cut into blocks of about PER rows, and each pair of blocks is a cell
of its own, so that no task holds more than two blocks. A cell compares its rows in numpy and emits one row for each row that
has a link there: its smallest linked neighbour within the cell's links (enough for connected components) and the number of
its links that no earlier table has seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

PER = 1024
#: Groups of up to so many rows are compared by shifting the sorted rows against themselves.
SMALL = 48
STRIPE = 256
OUT = "node long, label long, links long"


def cells(rows: DataFrame, key: str = "key", node: str = "node", per: int = PER) -> DataFrame:
    """Rows of buckets with at least two rows, dealt to cells; adds cell_a <= cell_b and block."""
    sizes = stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    parts = F.ceil(F.col("_n") / per).cast("int")
    own = rows.join(sizes, key).withColumn("_p", parts).drop("_n")
    own = own.withColumn("block", F.pmod(F.xxhash64(node, F.lit("block")), F.col("_p")).cast("int"))
    own = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_p") - 1)))
    return own.withColumns({"cell_a": F.least("block", "_o"), "cell_b": F.greatest("block", "_o")}).drop("_o", "_p")


def verified(dealt: DataFrame, payload: list[str], pairs: Callable[[dict, np.ndarray, np.ndarray], np.ndarray], dense: Callable[[dict, int, int, int, int], tuple[np.ndarray, np.ndarray]], new: Callable[[dict, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """One row for each row with a link in its cell: node, label, links.

    pairs(rows, i, j) tells which pairs are linked; dense(rows, i0, i1, j0, j1) returns the linked pairs between two ranges;
    new(rows, i, j) tells which linked pairs no earlier table holds. rows maps column names to arrays, binary ones to
    byte matrices filled with zeros and name_size to their lengths; a link counts as many
    times as the weight of its other end, where rows have a weight.
    """
    columns = ["key", "cell_a", "cell_b", "block", "node", *payload]
    cut = dealt.select(*columns).repartition("key", "cell_a", "cell_b").sortWithinPartitions("key", "cell_a", "cell_b", "block", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            same = np.ones(t.num_rows, bool)
            for c in columns[:3]:
                x = t.column(c).to_numpy()
                same &= x == x[-1]
            last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if last:
                yield from whole(pa.concat_tables([*held, t.slice(0, last)]))
                held = [t.slice(last)]
            else:
                first = held and all(held[0].column(c)[0] == t.column(c)[0] for c in columns[:3])
                if held and not first:
                    yield from whole(pa.concat_tables(held))
                    held = []
                held.append(t)
        if held:
            yield from whole(pa.concat_tables(held))

    def whole(t: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = {}
        for c in t.column_names:
            if pa.types.is_binary(t.column(c).type):
                rows[c], rows[f"{c}_size"] = matrix(t.column(c).to_pylist())
            else:
                rows[c] = t.column(c).to_numpy()
        n = t.num_rows
        edge = np.zeros(n, bool)
        edge[0] = True
        for c in columns[:3]:
            edge[1:] |= rows[c][1:] != rows[c][:-1]
        start = np.flatnonzero(edge)
        size = np.diff(np.append(start, n))
        group = np.repeat(np.arange(len(start)), size)
        label, links = np.arange(n), np.zeros(n, np.int64)
        for k in np.flatnonzero(size > SMALL):
            lo, hi = int(start[k]), int(start[k] + size[k])
            if rows["cell_a"][lo] == rows["cell_b"][lo]:
                ranges = [(i, min(i + STRIPE, hi), i, hi) for i in range(lo, hi, STRIPE)]
            else:
                middle = lo + int(np.searchsorted(rows["block"][lo:hi], rows["cell_b"][lo]))
                ranges = [(i, min(i + STRIPE, middle), middle, hi) for i in range(lo, middle, STRIPE)]
            for i0, i1, j0, j1 in ranges:
                if j1 > j0:
                    i, j = dense(rows, i0, i1, j0, j1)
                    told(rows, i[i < j], j[i < j], label, links)
        for d in range(1, min(SMALL, int(size.max()))):
            i = np.flatnonzero((group[:-d] == group[d:]) & (size[group[:-d]] <= SMALL)) if d < n else np.zeros(0, int)
            if not len(i):
                break
            i = i[(rows["cell_a"][i] == rows["cell_b"][i]) | (rows["block"][i] != rows["block"][i + d])]
            i = i[pairs(rows, i, i + d)]
            told(rows, i, i + d, label, links)
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt
        out = np.flatnonzero((links > 0) | (label != np.arange(n)))
        yield pa.RecordBatch.from_arrays([pa.array(rows["node"][out]), pa.array(rows["node"][label[out]]), pa.array(links[out])], names=["node", "label", "links"])

    def told(rows: dict, i: np.ndarray, j: np.ndarray, label: np.ndarray, links: np.ndarray) -> None:
        if not len(i):
            return
        fresh = new(rows, i, j)
        i1, j1, w = i[fresh], j[fresh], rows.get("weight")
        links += np.bincount(i1, None if w is None else w[j1], len(links)).astype(np.int64) + np.bincount(j1, None if w is None else w[i1], len(links)).astype(np.int64)
        join(label, i, j)

    return cut.mapInArrow(run, OUT)


def matrix(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as rows of one width, shorter ones filled with zeros, and their lengths."""
    size = np.fromiter(map(len, values), np.int64, len(values))
    wide = int(size.max()) if len(size) else 0
    flat = b"".join(values) if (size == wide).all() else b"".join(x.ljust(wide, b"\0") for x in values)
    return np.frombuffer(flat, np.uint8).reshape(len(values), wide), size


def join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of i and j in place; a label is never larger than its row."""
    while True:
        a, b = label[i], label[j]
        while True:
            c, d = label[a], label[b]
            if (c == a).all() and (d == b).all():
                break
            a, b = c, d
        differ = a != b
        if not differ.any():
            return
        np.minimum.at(label, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
