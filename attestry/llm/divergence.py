"""How the sources of a language differ in their terms: dense group-by-term tiles, partial pair matrices, per-group heaps.

The kept terms of a language are dealt to blocks by a hash, and so are its sources. A tile is one block of terms against two
blocks of sources, a dense int64 matrix of probabilities from which numpy takes the distances of all pairs of sources at once.
Partial matrices are summed, and every tile hands on the best terms of its sources only.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binaries, column, discard, looked_up, parts, runs, ship, stored

#: Documents of a language that a term needs, ranks of terms that are told, the unit of probabilities and what is added to counts.
LEAST_DOCS, RANKS, UNIT, ADDED = 30, 50, 1_000_000_000, 5
#: Terms and sources of a block, on average.
TERMS, SOURCES = 256, 64
#: Pairs of a group and a term that a task counts before it hands them on.
HELD = 400_000
#: Bytes of terms: letters of any script and all other characters beyond ASCII. A-Z become small, the rest separates.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def probabilities(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(UNIT * (count + ADDED) / (total + ADDED * kept)), in three exact steps of long division by thousands."""
    a, b = count + ADDED, total + ADDED * kept
    out = a // b
    rest = a - out * b
    for _ in range(3):
        rest = rest * 1000
        digit = rest // b
        out, rest = out * 1000 + digit, rest - digit * b
    return out + 1


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs for each group and each of its terms, and a row with a null term for each group.

    Tasks count in dictionaries of at most about HELD entries and hand their sums on, so what is moved is pre-aggregated.
    """
    group = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in counts.items():
                words = [None, *n]
                size = len(words)
                cols = [pa.array([lang]).take(pa.array(np.zeros(size, np.int32))), pa.array([source]).take(pa.array(np.zeros(size, np.int32)))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(words, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[w] for w in n)], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            counts.clear()

        for part in parts(batches):
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), binaries(part, 2), strict=True):
                n, own = counts.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for piece in runs(text.translate(_TERM)):
                    words = piece.split()
                    n.update(words)
                    seen.update(words)
                own.update(seen)
            if sum(len(n) for n, _ in counts.values()) >= HELD:
                yield from told()
        yield from told()

    found = docs.select(*group, column(docs, "text", "string").alias("text")).mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least: int) -> DataFrame:
    """lang, term, n of the terms that occur in at least `least` documents of the language."""
    return counts.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")


def tile(block: pa.Table, first: int, second: int, ranks: int) -> tuple[list, list]:
    """Of one tile, the distances of the sources of block `first` from those of `second`, and each source's best terms where
    both are one block. The rows are the tile's terms (part 0, with the language's count and total), its sources (part 1, with
    their totals) and the counts that are not 0 (part 2)."""
    part, n, total = (block.column(c).to_numpy() for c in ("part", "n", "total"))
    kept = block.column("kept")[0].as_py()
    text = lambda name, rows: block.column(name).take(pa.array(rows)).to_pylist()
    whole, groups, cells = (np.flatnonzero(part == k) for k in range(3))
    terms, names, side = text("term", whole), text("source", groups), block.column("block").to_numpy()[groups]
    count = np.zeros((len(names), len(terms)), np.int64)
    at_source, at_term = {s: k for k, s in enumerate(names)}, {t: k for k, t in enumerate(terms)}
    count[[at_source[s] for s in text("source", cells)], [at_term[t] for t in text("term", cells)]] = n[cells]
    p = probabilities(count, total[groups][:, None], kept) if len(terms) else count
    left, right = np.flatnonzero(side == first), np.flatnonzero(side == second)
    pairs, best = [], []
    step = max(1, (1 << 20) // max(1, len(right) * len(terms)))
    for i in range(0, len(left), step):
        some = left[i : i + step]
        far = np.abs(p[some][:, None] - p[right][None]).sum(2)
        pairs += [(names[a], names[b], int(far[x, y])) for x, a in enumerate(some.tolist()) for y, b in enumerate(right.tolist()) if first != second or names[a] < names[b]]
    if first == second and len(terms):
        over = p - probabilities(n[whole], total[whole], kept)
        for k, name in enumerate(names):
            found = np.flatnonzero((over[k] > 0) & (count[k] > 0)).tolist()
            best += [(name, t, -v) for v, t in heapq.nsmallest(ranks, ((-int(over[k, j]), terms[j]) for j in found))]
    return pairs, best


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS, terms: int = TERMS, sources: int = SOURCES) -> DataFrame:
    """lang, source, part, item, value, rank: how far each other source of the language is (part pair), and the terms that a
    source has more often than its language (part term).

    Null text, lang and source are empty, and so is a column that is missing. Terms are runs of letters and of characters
    beyond ASCII, A-Z made small; a language keeps those in at least `least_docs` of its documents. Every group (lang, source)
    that occurs, also one without terms, and every language gives each kept term probabilities(); value is the difference in
    units of 1e-9. Pairs sum it over all kept terms, 0 without any, and have all ranks; terms that occur in the group and
    are likelier there have the first `ranks`. Equal values are ordered by the item's UTF-8. Counts are exact up to 9e15.
    Repeated rows count each. doc_id and other columns are not read; texts of any length are read in pieces. A group of a
    language without other sources has no pairs. An empty table gives no rows.

    `terms` and `sources` are the sizes of a block on average. A tile has at most about two blocks of sources times one of
    terms, whatever the tables, and a hot group or term is one row in it.
    """
    ship(docs.sparkSession)
    own = docs.select(*(column(docs, c, "string").alias(c) for c in ("lang", "source", "text")))
    counts = stored(term_counts(own))
    kept = stored(kept_terms(counts, least_docs))
    groups = counts.where(F.col("term").isNull()).select("lang", "source")
    blocks = lambda n, size: F.greatest(F.ceil(n / size), F.lit(1)).cast("long")
    zero = F.lit(0).cast("long")
    known = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("spoken"))
    facts = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups")).join(known, "lang", "left")
    facts = stored(facts.select("lang", F.coalesce("kept", zero).alias("kept"), F.coalesce("spoken", zero).alias("spoken"), blocks(F.coalesce("kept", zero), terms).alias("t"), blocks(F.col("groups"), sources).alias("s")))
    wide = stored(looked_up(kept, facts, "lang", "term"))
    cells = stored(counts.where(F.col("term").isNotNull()).join(wide.select("lang", "term", "kept", "t", "s"), ["lang", "term"]).select("lang", "source", "term", "n", "kept", "t", "s"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    marks = looked_up(groups.join(totals, ["lang", "source"], "left"), facts, "lang", "source")

    side, block = F.pmod(F.xxhash64("source"), F.col("s")), F.pmod(F.xxhash64("term"), F.col("t"))
    every = lambda n: F.sequence(zero, n - 1)
    null = F.lit(None)
    shape = lambda df, part, source, term, n, total: df.select("lang", "tblock", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), F.lit(part).alias("part"), source.cast("string").alias("source"), term.cast("string").alias("term"), n.cast("long").alias("n"), total.cast("long").alias("total"), "block", "kept")
    col = F.col
    of_terms = wide.withColumn("tblock", block).withColumn("block", F.explode(every(col("s")))).withColumn("other", F.explode(F.sequence("block", col("s") - 1)))
    of_groups = marks.withColumn("block", side).withColumn("tblock", F.explode(every(col("t")))).withColumn("other", F.explode(every(col("s"))))
    of_cells = cells.withColumns({"block": side, "tblock": block}).withColumn("other", F.explode(every(col("s"))))
    rows = shape(of_terms, 0, null, col("term"), col("n"), col("spoken")).union(shape(of_groups, 1, col("source"), null, zero, F.coalesce("total", zero))).union(shape(of_cells, 2, col("source"), col("term"), col("n"), zero))

    def tiled(key: tuple, block: pa.Table) -> pa.Table:
        pairs, best = tile(block, key[2].as_py(), key[3].as_py(), ranks)
        source, item, value = zip(*pairs, *best, strict=True) if pairs or best else ((), (), ())
        size = len(source)
        return pa.table({"lang": pa.array([key[0].as_py()] * size, pa.string()), "part": pa.array(["pair"] * len(pairs) + ["term"] * len(best), pa.string()), "source": pa.array(source, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})

    tiles = stored(rows.groupBy("lang", "tblock", "first", "second").applyInArrow(tiled, "lang string, part string, source string, item string, value long"))
    for x in (counts, kept, facts, wide, cells):
        discard(x)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    sums = tiles.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.inline(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    told = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return told(sums.select("lang", "value", both), "pair").union(told(tiles.where("part = 'term'"), "term").where(F.col("rank") <= ranks))
