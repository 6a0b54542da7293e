"""Pieces that several operators share: scratch tables in the shared folder, Arrow text access and vectorised hashing."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])
_OWN: dict[str, str] = {}
_WHITE = re.compile(rb"[\x09-\x0D ]")

#: Bytes of text that one vectorised step takes at a time; arrays of eight bytes a byte stay near 16 MB.
STEP_BYTES = 1 << 21

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2, _S = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package; on a cluster it is installed or sent with --py-files."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session where it is unset a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="attestry-")
    return _OWN[app]


def stored(df: DataFrame, *, files: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back, so that a lost executor costs no more than the step at hand."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._attestry_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a stored() table that no later step reads."""
    path = getattr(df, "_attestry_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def column(df: DataFrame, name: str, kind: str) -> F.Column:
    """A column, or typed nulls where a table has none of that name. Ids are integers or texts of integers: another text raises."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches cut to so many rows, so that few texts are held as objects at a time; nothing is copied."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def binaries(batch: pa.RecordBatch, at: int) -> list[bytes]:
    """A text column as bytes; null is empty."""
    return [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]


def strings(batch: pa.RecordBatch, at: int) -> list[str]:
    return [x or "" for x in batch.column(at).to_pylist()]


def steps(texts: list[bytes], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about limit bytes; a longer text stands alone."""
    first = size = 0
    for i, x in enumerate(texts):
        if i > first and size + len(x) > limit:
            yield first, i
            first, size = i, 0
        size += len(x) + 1
    if first < len(texts):
        yield first, len(texts)


def runs(text: bytes, limit: int = STEP_BYTES) -> Iterator[bytes]:
    """A text in pieces of about limit bytes, cut at ASCII white space only."""
    at = 0
    while len(text) - at > limit:
        cut = _WHITE.search(text, at + limit)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def bounded(df: DataFrame, most: int, salt: str, *keys: str) -> DataFrame:
    """At most `most` rows, chosen by a hash of the keys. Rows are first thinned to about that number where they are read, so
    that the tasks together, not each of them, send so many to the driver."""
    n = df.count()
    rank = F.pmod(F.xxhash64(*keys, F.lit(salt)), F.lit(1 << 24))
    thin = df.where(rank < int(min(1.0, (1.2 * most + 50) / max(n, 1)) * (1 << 24)))
    return thin.orderBy(rank, *keys).limit(most)


#: Keys with more than one row in HOT are hot; there are fewer than HOT of them, whatever the table.
HOT = 1000


def looked_up(rows: DataFrame, labels: DataFrame, key: str, spread: str) -> DataFrame:
    """rows left-joined with labels, which has one row for each value of key, by a merge join that no hot key unbalances.

    The labels of hot keys, fewer than HOT rows, are broadcast; their rows then carry a salt by a hash of `spread`, so that they
    are dealt over all tasks, where they need nothing more. No other label is sent or copied.
    """
    names = [c for c in labels.columns if c != key]
    counts = stored(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = counts.where(F.col("_n") > max(1, total // HOT)).select(key)
    given = labels.join(F.broadcast(hot), key, "left_semi").select(F.col(key), *(F.col(c).alias(f"_h_{c}") for c in names), F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(given), key, "left")
    salt = F.when(F.col("_hot") | F.col(key).isNull(), F.pmod(F.xxhash64(spread, F.lit("spread")), F.lit(1 << 20)) + 1).otherwise(0)
    cold = labels.withColumn("_salt", F.lit(0).cast("long")).hint("merge")
    out = marked.withColumn("_salt", salt.cast("long")).join(cold, [key, "_salt"], "left")
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), *(F.when(F.col("_hot"), F.col(f"_h_{c}")).otherwise(F.col(c)).alias(c) for c in names))


#: Bits of a Sieve; it has 8 MB, whatever the tables.
SIEVE_BITS = 26


class Sieve:
    """A set of keys as one bit for the hash of each: what is not in it is surely not wanted.

    It goes to the tasks, where it tells which rows need not be moved for a join with the wanted keys; few more are kept than
    there are. It has a fixed size. With very many wanted keys it fills and fewer rows are spared; nothing is lost.
    """

    def __init__(self, wanted: DataFrame, key: str) -> None:
        v = self.slot(key) + 1
        bits = wanted.select(v.alias("v")).groupBy(F.bitmap_bucket_number("v").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits"))
        table = np.zeros((1 << SIEVE_BITS) >> 3, np.uint8)
        for r in bits.collect():
            table[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
        self.sent = wanted.sparkSession.sparkContext.broadcast(table)

    @staticmethod
    def slot(key: str) -> F.Column:
        """A column of the rows, which kept() takes."""
        return F.pmod(F.xxhash64(key), F.lit(1 << SIEVE_BITS))


def kept(sent, slots: pa.Array) -> np.ndarray:
    """Which slots are in the broadcast table of a sieve."""
    at = slots.to_numpy()
    return (sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse: prefix sums give the hash of any interval in one step."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        return self.up[:n], self.down[:n]

    def prefix(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.to(len(values))[0], dtype=np.uint64, out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the intervals start..end, whatever stands around them."""
        down = self.to(len(prefix))[1]
        return mix(((prefix[end] - prefix[start]) * down[start]) ^ ((end - start).astype(np.uint64) * _GOLD))


BYTES, WORDS = Powers(0x5851F42D4C957F2D), Powers(0xD1342543DE82EF95)
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
#: The separators \x20 and \x09-\x0D.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some texts, one after the other, and where each text's words begin (one more entry than texts)."""
    a = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    gap = BLANK[a]
    start = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    h = BYTES.spans(BYTES.prefix(BYTE_VALUES[a]), start, end) if len(start) else np.zeros(0, np.uint64)
    at = np.cumsum([1, *(len(x) + 1 for x in texts)])
    return h, np.searchsorted(start, at)
