"""Near-duplicate embeddings: Euclidean p-stable hashing in several tables, then exact cosine checks.

Bucket rows carry ids and 256 sign bits only. Pairs that share a bucket and differ in few sign bits make candidate
components; each vector then travels once, to its component, where the cosines of all pairs are computed and links are
counted. So no pair is listed, none is counted twice, and a link that shares no bucket is found if its component holds both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import cells, verified
from .common import column, discard, looked_up, mix, ship, stored
from .components import components

COSINE = 0.9
WIDTH, LEAST_HASHES = 2.5, 12
#: The chance that a pair at the threshold shares no bucket, at most.
MISSED = 0.02
#: Cost of a row in a bucket, in comparisons of two signatures.
ROW = 150
#: Sign bits that may differ. At cosine 0.9 it is 36.8 of 256 on average, with a deviation of 5.6; of random pairs 128, with 8,
#: so no component grows by chance.
SIGNS, DIFFER = 256, 64
WORDS = tuple(f"s{k}" for k in range(SIGNS // 64))


def agreement(distance: float, width: float = WIDTH) -> float:
    """The chance that one quantised projection of two vectors at a distance is the same."""
    x = width / distance
    return 1 - math.erfc(x / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def sizes_for(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """Tables and hashes at which n vectors cost least, in bucket rows and comparisons by chance, with MISSED at the threshold.

    23 tables of 12 hashes up to about 10**4 vectors; then the tables grow as the 0.27th power of n: 27 for 10**5, 52 for 10**6, 182 for 10**8.
    """
    near, far = agreement(math.sqrt(2 - 2 * cosine)), agreement(math.sqrt(2))
    tables = lambda k: math.ceil(math.log(MISSED) / math.log1p(-(near**k)))
    k = min(range(LEAST_HASHES, 60), key=lambda k: tables(k) * (ROW + n * far**k))
    return tables(k), k


class Tables:
    """Quantised random projections of unit vectors; the same for every process."""

    def __init__(self, tables: int, hashes: int, width: float = WIDTH, seed: int = 7) -> None:
        self.tables, self.hashes, self.width, self.seed, self.kept = tables, hashes, width, seed, {}

    def signs(self, unit: np.ndarray) -> np.ndarray:
        """The signs of SIGNS projections as 64-bit numbers."""
        d = unit.shape[1]
        if -d not in self.kept:
            self.kept[-d] = np.random.default_rng([self.seed + 1, d]).standard_normal((d, SIGNS))
        return np.packbits(unit @ self.kept[-d] > 0, axis=1).view(np.int64)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """One 64-bit bucket for each vector and table."""
        d = unit.shape[1]
        if d not in self.kept:
            r = np.random.default_rng([self.seed, d])
            odd = r.integers(1, 1 << 62, self.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            self.kept[d] = r.standard_normal((d, self.tables * self.hashes)), r.uniform(0, self.width, self.tables * self.hashes), odd
        a, b, odd = self.kept[d]
        cell = np.floor((unit @ a + b) / self.width).astype(np.int64).view(np.uint64).reshape(len(unit), self.tables, self.hashes)
        salt = mix(np.arange(1, self.tables + 1, dtype=np.uint64) * np.uint64(d + 1))
        return mix((cell * odd).sum(2, dtype=np.uint64) ^ salt)


def units(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the vectors of each length, and the vectors divided by their lengths in double precision."""
    size, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
    first = np.cumsum(size) - size
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        m = flat[first[at][:, None] + np.arange(d)]
        m = m / np.abs(m).max(1, keepdims=True)
        yield at, m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, tables: Tables | None = None) -> DataFrame:
    """vec_id, n_links (other vectors at the cosine or above), component_id (smallest vec_id reachable), kept.

    One row per input row. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor
    do vectors of different length. Equal vectors are one node with a weight, so exact copies are never paired. Rows with one
    vec_id are one vector, the least of theirs that is usable. A row without vec_id links with nothing and has a null
    component. Ids are integers; vectors of any length are compared whole. A pair exactly at the cosine is linked. Other
    columns are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(column(vectors, vec_id, "long").alias("vec_id"), column(vectors, embedding, "array<double>").alias("e"))
    ok = F.col("vec_id").isNotNull() & (F.size("e") > 0) & ~F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("e", lambda c: c != 0)
    whole = stored(rows.where(F.coalesce(ok, F.lit(False))).withColumn("e", F.transform("e", lambda c: c + F.lit(0.0))).groupBy("vec_id").agg(F.min("e").alias("e")))
    # equal vectors meet by a 128-bit name, not by their components
    name = F.struct(F.xxhash64("e").alias("x"), F.xxhash64(F.lit("y"), "e").alias("y"))
    named = whole.select("vec_id", name.alias("name"))
    nodes = stored(named.groupBy("name").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight")))
    firsts = nodes.select(F.col("node").alias("vec_id"), "weight").join(whole.hint("merge"), "vec_id").select(F.col("vec_id").alias("node"), "weight", "e")
    tables = tables or Tables(*sizes_for(nodes.count(), cosine))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            for at, m in units(batch.column(1)):
                for s in range(0, len(at), 512):
                    k, own, sign = tables.keys(m[s : s + 512]).view(np.int64), at[s : s + 512], tables.signs(m[s : s + 512])
                    t = tables.tables
                    yield pa.RecordBatch.from_arrays([pa.array(k.T.ravel()), pa.array(np.tile(node[own], t)), *(pa.array(np.tile(x, t)) for x in sign.T)], names=["key", "node", *WORDS])

    hashed = stored(firsts.select("node", "e").mapInArrow(keyed, ", ".join(f"{c} long" for c in ("key", "node", *WORDS))))

    def far(rows: dict, i, j) -> np.ndarray:
        out = 0
        for c in WORDS:
            s = rows[c].view(np.uint64)
            out = np.bitwise_count(s[i] ^ s[j]).astype(np.int16) + out
        return out

    def alike(rows: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return far(rows, i, j) <= DIFFER

    def all_alike(rows: dict, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.nonzero(far(rows, np.arange(i0, i1)[:, None], np.arange(j0, j1)[None]) <= DIFFER)
        return i + i0, j + j0

    met = verified(cells(hashed), list(WORDS), alike, all_alike, lambda rows, i, j: np.zeros(len(i), bool))
    groups = stored(components(met.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    discard(hashed)
    roots = groups.select(F.col("component").alias("node"), "component").distinct()
    wanted = groups.union(roots).select("node", F.col("component").alias("key"))

    def vector_rows(rows: dict) -> np.ndarray:
        if "m" not in rows:
            rows["m"] = np.ascontiguousarray(rows["v"]).view(np.float64)
        return rows["m"]

    def pairs(rows: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        m = vector_rows(rows)
        return np.einsum("ij,ij->i", m[i], m[j]) >= cosine

    def dense(rows: dict, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray]:
        m = vector_rows(rows)
        i, j = np.nonzero(m[i0:i1] @ m[j0:j1].T >= cosine)
        return i + i0, j + j0

    dealt = packed(cells(firsts.join(wanted.hint("merge"), "node").select("key", "node", "weight", "e")))
    found = stored(verified(dealt, ["weight", "v"], pairs, dense, lambda rows, i, j: np.ones(len(i), bool)))
    discard(groups)
    return _told(rows, named, nodes, found)


def packed(dealt: DataFrame) -> DataFrame:
    """The components as bytes of unit vectors; all vectors of a candidate component have one length, on which keys depend."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, m in units(batch.column(batch.schema.get_field_index("e"))):
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names), pa.array([x.tobytes() for x in m], pa.binary())], names=[*names, "v"])

    names = ["key", "cell_a", "cell_b", "block", "node", "weight"]
    return dealt.select(*names, "e").mapInArrow(run, "key long, cell_a int, cell_b int, block int, node long, weight long, v binary")


def _told(rows: DataFrame, named: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Links and components of the nodes, given to every row."""
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = stored(components(found.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    full = stored(nodes.join(links.hint("merge"), "node", "left").join(groups.hint("merge"), "node", "left").select("name", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    for x in (found, groups, nodes):
        discard(x)
    given = looked_up(named, full, "name", "vec_id").select("vec_id", "n_links", "component_id")
    out = rows.select("vec_id").join(given.hint("merge"), "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
