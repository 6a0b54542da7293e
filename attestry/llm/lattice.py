"""Likelihood of texts by lattices of subwords: all segmentations of a word count, each by the scores of its pieces.

The pieces are those of a public tokenizer, and their first scores follow from its ranks. The words of the training texts
then move the scores by expectation maximisation over the same lattices. A word is a path from its first byte to its last;
the forward recursion adds, in logarithms, over all of them. White space only separates words, so a text's probability is
the product of its words' and of its end.

Words that were learned have one more arc over the whole word, with the share of their count less a discount; the pieces
get what the discounts leave. The languages of the training texts have scores of their own, and a text's probability is the
mean over them by their shares. So every text has a probability, and all of them add up to one at most.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binaries, column, parts, runs, ship, stored

#: Bytes of a piece at most, rounds of expectation maximisation, what is added to the expected count of a piece.
LONGEST, ROUNDS, ADDED = 16, 3, 0.1
#: What is added to a rank, so that first scores fall as those of words do.
RANK = 10
#: Bytes of words that one step takes, bytes of a word beyond which it stands alone, and words that a task counts at most
#: before it hands them on.
STEP, LONG, HELD = 1 << 17, 128, 400_000
#: Words that are sent to all tasks at most, the most frequent; the others are joined.
SENT = 1 << 18
#: Kinds of texts with scores of their own at most.
KINDS = 8


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Vocabulary:
    """Pieces of a byte-level vocabulary that can stand in a word of small letters, as a trie in sorted arrays.

    A word has a space before its first byte, which is the first byte of pieces that begin a word. Bytes that the vocabulary
    lacks are added behind its last rank, so every word has a segmentation. Longer pieces than LONGEST are left out.
    """

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        end = max(ranks.values(), default=0) + 1
        ranks |= {bytes([b]): end for b in range(256) if bytes([b]) not in ranks}
        white = set(b"\t\n\v\f\r ")
        able = lambda p: p == p.lower() and len(p) <= LONGEST and not white & set(p[1:]) and p[:1] not in (b"\t", b"\n", b"\v", b"\f", b"\r")
        self.pieces = sorted(p for p in ranks if able(p))
        weight = np.array([1 / (ranks[p] + RANK) for p in self.pieces])
        self.scores = np.log(weight / weight.sum())
        children: dict[int, int] = {}
        piece = [-1]
        for k, p in enumerate(self.pieces):
            node = 0
            for b in p:
                edge = node * 256 + b
                if edge not in children:
                    children[edge] = len(piece)
                    piece.append(-1)
                node = children[edge]
            piece[node] = k
        self.edges = np.array(sorted(children), np.int64)
        self.targets = np.array([children[e] for e in self.edges.tolist()], np.int64)
        self.piece = np.array(piece, np.int32)
        self.first = np.full(256, -1, np.int64)
        self.first[self.edges[self.edges < 256]] = self.targets[self.edges < 256]

    def arcs(self, a: np.ndarray) -> np.ndarray:
        """For each byte and length, the piece of that length that ends with the byte, or the number of pieces for none. No
        piece has a space behind its first byte, so none reaches into the next word."""
        out = np.full((len(a), LONGEST), len(self.pieces), np.int32)
        at = np.arange(len(a))
        node = self.first[a]
        for n in range(LONGEST):
            ok = node >= 0
            at, node = at[ok], node[ok]
            found = self.piece[node]
            ends = found >= 0
            out[at[ends] + n, n] = found[ends]
            inside = at + n + 1 < len(a)
            at, node = at[inside], node[inside]
            edge = node * 256 + a[at + n + 1]
            k = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
            node = np.where(self.edges[k] == edge, self.targets[k], -1)
        return out


def forward(ids: np.ndarray, scores: np.ndarray, posterior: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probabilities of words of one length over all segmentations, and the probability of every arc given its word.

    ids[w, e, n] is the piece of n + 1 bytes that ends with byte e of word w; scores end with the -inf of none."""
    n, length, most = ids.shape
    alpha = np.zeros((n, length + 1))
    ways = np.zeros(ids.shape) if posterior else None
    for e in range(length):
        m = min(most, e + 1)
        reached = alpha[:, e + 1 - m : e + 1][:, ::-1] + scores[ids[:, e, :m]]
        top = reached.max(1, keepdims=True)
        reached = np.exp(reached - top)
        total = reached.sum(1)
        alpha[:, e + 1] = top[:, 0] + np.log(total)
        if posterior:
            ways[:, e, :m] = reached / total[:, None]
    if posterior:
        mass = np.zeros_like(alpha)
        mass[:, -1] = 1
        for e in range(length - 1, -1, -1):
            m = min(most, e + 1)
            ways[:, e, :m] *= mass[:, e + 1, None]
            mass[:, e + 1 - m : e + 1] += ways[:, e, m - 1 :: -1]
    return alpha[:, -1], ways


class Lattices:
    """A vocabulary with scores for each kind of text: natural logarithms that add up to one in each row."""

    def __init__(self, vocabulary: Vocabulary, scores: np.ndarray) -> None:
        self.vocabulary, self.scores = vocabulary, np.pad(scores, ((0, 0), (0, 1)), constant_values=-np.inf)

    def _groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of the words of one length, and the arcs of each, for words of at most LONG bytes."""
        flat = b" " + b" ".join(words)
        size = np.array([len(w) + 1 for w in words])
        first = np.cumsum(size) - size
        ids = self.vocabulary.arcs(np.frombuffer(flat, np.uint8))
        for length in np.unique(size):
            at = np.flatnonzero(size == length)
            yield at, ids[first[at][:, None] + np.arange(length)]

    def _long(self, word: bytes) -> list[float]:
        """The same recursion for one long word, in pieces of STEP bytes that hand on the last LONGEST sums."""
        a, m = np.frombuffer(b" " + word, np.uint8), LONGEST
        last = np.full((len(self.scores), m), -np.inf)
        last[:, 0] = 0
        for i in range(0, len(a), STEP):
            ids = self.vocabulary.arcs(a[max(0, i - m) : i + STEP])[min(i, m) :]
            for row in ids:
                reached = last + self.scores[:, row]
                top = reached.max(1, keepdims=True)
                last[:, 1:] = last[:, :-1].copy()
                last[:, :1] = top + np.log(np.exp(reached - top).sum(1, keepdims=True))
        return last[:, 0].tolist()

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """A row for each word, a column for each kind of text."""
        out = np.empty((len(words), len(self.scores)))
        for at, short in steps_of(words):
            if short:
                for group, ids in self._groups([words[k] for k in at]):
                    for k, scores in enumerate(self.scores):
                        out[at[group], k] = forward(ids, scores)[0]
            else:
                out[at[0]] = self._long(words[at[0]])
        return out

    def expected(self, words: list[bytes], among: np.ndarray) -> np.ndarray:
        """How often each piece is expected in each kind of text, a word once in each kind that `among` says. Words of more than
        LONG bytes are learned in cuts of LONG bytes."""
        total = np.zeros(self.scores.shape)
        cut = [(w[i : i + LONG], k) for k, w in enumerate(words) for i in range(0, len(w), LONG)]
        own, row = [w for w, _ in cut], np.array([k for _, k in cut], np.int64)
        for at, _ in steps_of(own):
            for group, ids in self._groups([own[k] for k in at]):
                for k, scores in enumerate(self.scores):
                    some = ids[among[row[at[group]], k]]
                    if len(some):
                        total[k] += np.bincount(some.ravel(), forward(some, scores, posterior=True)[1].ravel(), total.shape[1])
        return total[:, :-1]


def steps_of(words: list[bytes]) -> Iterator[tuple[np.ndarray, bool]]:
    """Positions of words of at most LONG bytes, about STEP bytes at a time, and each longer one alone."""
    size = np.array([len(w) for w in words], np.int64)
    short = np.flatnonzero(size <= LONG)
    step = np.cumsum(size[short] + 1) // STEP
    for group in np.split(short, np.flatnonzero(np.diff(step)) + 1):
        if len(group):
            yield group, True
    for k in np.flatnonzero(size > LONG):
        yield np.array([k]), False


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(7)) == 2, F.lit(False))


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, A-Z made small, a few megabytes at a time."""
    for piece in runs(text):
        yield piece.lower().split()


def word_counts(texts: DataFrame, kinds: list[str]) -> DataFrame:
    """word, n, and own, the counts in each kind of text, over columns text and kind; kinds that are not listed go to the last.

    The empty word stands for the ends of texts. Tasks hand on sums of about HELD words."""
    at = {k: i for i, k in enumerate(kinds)}
    last = max(0, len(kinds) - 1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in range(last + 1)]

        def told() -> Iterator[pa.RecordBatch]:
            for k, c in enumerate(counts):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(np.full(len(c), k, np.int32)), pa.array(list(c.values()), pa.int64())], names=["word", "k", "n"])
                c.clear()

        for part in parts(batches):
            for kind, text in zip(part.column(0).to_pylist(), binaries(part, 1), strict=True):
                own = counts[at.get(kind, last)]
                own[b""] += 1
                for words in words_of(text):
                    own.update(words)
                if sum(map(len, counts)) >= HELD:
                    yield from told()
        yield from told()

    rows = texts.select("kind", "text").mapInArrow(counted, "word binary, k int, n long")
    own = F.array(*(F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0)) for k in range(last + 1)))
    return rows.groupBy("word").agg(F.sum("n").alias("n"), own.alias("own"))


class Model:
    """Scores of pieces for each kind of text, sizes of the training texts and discounts; the words' counts stay in a table.

    tokens, words, ends, and discount have an entry for each kind of text, total is of all of them: tokens, distinct words, ends.
    """

    def __init__(self, vocabulary: Vocabulary, scores: np.ndarray, total: tuple[int, int, int], tokens: np.ndarray, words: np.ndarray, ends: np.ndarray, discount: np.ndarray) -> None:
        self.lattices, self.total, self.tokens, self.words, self.ends, self.discount = Lattices(vocabulary, scores), total, tokens, words, ends, discount

    def base(self, count: np.ndarray) -> np.ndarray:
        """log10 of each count plus one among all tokens plus all distinct ones and one."""
        return np.log10((np.asarray(count) + 1) / (self.total[0] + self.total[1] + 1))

    def score(self, counts: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """log10 probability of words in each kind of text, from their counts there and log probabilities by their pieces."""
        if not self.total[0]:
            return (lattice + math.log(0.5)) / math.log(10)
        whole = np.log(np.maximum(counts - self.discount, 0) / self.tokens, where=counts > 0, out=np.full(counts.shape, -np.inf))
        return np.logaddexp(whole, lattice + np.log(self.discount * self.words / self.tokens)) / math.log(10)

    def end(self) -> np.ndarray:
        return np.log10((self.ends - self.discount) / self.tokens) if self.total[0] else np.full(len(self.tokens), math.log10(0.5))

    def prior(self) -> np.ndarray:
        """log10 share of each kind of text."""
        return np.log10(self.ends / self.ends.sum()) if self.total[0] else np.zeros(len(self.ends))


def fitted(counts: DataFrame, kinds: int, tokenizer: str | None = None, rounds: int = ROUNDS) -> Model:
    """The model of a written table of word_counts(); the sums of a round, one for each piece and kind, go to the driver."""
    spark = counts.sparkSession
    vocabulary = Vocabulary(tokenizer or default_path())
    own = lambda k: F.col("own")[k]
    some = lambda on: F.coalesce(F.sum(F.when(on, 1)), F.lit(0))
    ends = F.col("word") == b""
    each = [x for k in range(kinds) for x in (F.coalesce(F.sum(own(k)), F.lit(0)), some(own(k) > 0), F.coalesce(F.sum(F.when(ends, own(k))), F.lit(0)), some(own(k) == 1), some(own(k) == 2))]
    got = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(ends, F.col("n"))), F.lit(0)), *each).first()
    total, of = tuple(got[:3]), np.array(got[3:]).reshape(kinds, 5)
    tokens, words, ends, once, twice = of.T
    # the usual estimate of an absolute discount, kept between two ends that it must not reach
    discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.05, 0.95)
    scores = np.tile(vocabulary.scores, (kinds, 1))
    sent = spark.sparkContext.broadcast(vocabulary)
    for _ in range(rounds if total[1] > 1 else 0):
        lattices = spark.sparkContext.broadcast(scores)

        def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Lattices(sent.value, lattices.value)
            sums = np.zeros(lattices.value.shape)
            for part in parts(batches, 1 << 14):
                sums += model.expected(binaries(part, 0), part.column(1).flatten().to_numpy().reshape(part.num_rows, -1) > 0)
            k, piece = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(sums[k, piece])], names=["k", "piece", "v"])

        rows = counts.where(F.col("word") != b"").select("word", "own").mapInArrow(expected, "k int, piece int, v double").groupBy("k", "piece").agg(F.sum("v").alias("v")).toPandas()
        weight = np.full(scores.shape, ADDED)
        weight[rows["k"].to_numpy(), rows["piece"].to_numpy()] += rows["v"].to_numpy()
        scores = np.log(weight / weight.sum(1, keepdims=True))
    return Model(vocabulary, scores, total, tokens, words, ends, discount)


def _kinds(train: DataFrame, most: int) -> list[str]:
    """The most frequent kinds of the training texts, at most so many, the rarest last; ties by name."""
    rows = train.groupBy("kind").count().orderBy(F.desc("count"), "kind").limit(most).collect()
    return [r.kind for r in rows] or [""]


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent words, at most so many: those above a step of counts that a histogram of a few hundred steps finds."""
    step = F.floor(F.log2("n") * 16)
    below, least = 0, None
    for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():
        below += r.n
        if below > most:
            break
        least = r.step
    return counts.where(step >= least) if least is not None else counts.limit(0)


def scored(docs: DataFrame, train: Column, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", tokenizer: str | None = None, most: int = SENT, rounds: int = ROUNDS, kinds: int = KINDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every text, learned from the rows that `train` chooses.

    Tokens are the words between white space, A-Z made small, and one end. base_score sums log10((c + 1) / (N + V + 1)) over
    them; score is the log10 probability of the text over all segmentations of its words and all kinds of text. A kind is
    the lang of training texts, null being one too: the `kinds` most frequent have counts and scores of their own, all others are learned
    with the rarest of these. A text's own lang is never read when it is scored. Null texts are empty: one token, the end.
    Texts and words of any length are read whole. Repeated rows and rows without doc_id each count for themselves and get a
    row of their own; equal texts get equal scores. Without training texts all counts are 0 and pieces keep their first
    scores. Other columns are not read. An empty table gives no rows.

    The most frequent words, at most `most`, are sent to the tasks; occurrences of others are pre-aggregated by text and
    joined with their counts, so no vocabulary of the corpus goes to one place. tokenizer is a file of ranks.
    """
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(column(docs, doc_id, "long").alias("doc_id"), column(docs, text, "string").alias("text"), F.coalesce(column(docs, lang, "string"), F.lit("")).alias("kind"))
    known_kinds = _kinds(own.where(train), kinds)
    counts = stored(word_counts(own.where(train), known_kinds))
    model = fitted(counts, len(known_kinds), tokenizer, rounds)
    size = len(known_kinds)
    sent = spark.sparkContext.broadcast(model)
    scores = [f"s{k}" for k in range(size)]

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Base and scores of words by their counts; equal words that lie together are computed once."""
        m = sent.value
        for part in parts(batches, 1 << 14):
            words = part.column(0).dictionary_encode()
            at = words.indices.to_numpy()
            n = part.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            c = np.stack([part.column(3 + k).fill_null(0).to_numpy(zero_copy_only=False) for k in range(size)], 1)
            lattice = m.lattices.log_probabilities(words.dictionary.to_pylist())[at]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(m.base(n)), *(pa.array(x) for x in m.score(c, lattice).T)], names=[*part.schema.names[:3], "base", *scores])

    shape = ", ".join(["base double", *(f"{c} double" for c in scores)])
    own_counts = [F.col("own")[k].alias(f"c{k}") for k in range(size)]
    best = _frequent(counts.where(F.col("word") != b""), most).select("word", "n", F.lit(0).cast("long").alias("row"), *own_counts).mapInArrow(valued, f"word binary, n long, row long, {shape}").toArrow()
    known = {bytes(w): k for k, w in enumerate(best.column("word").to_pylist())}
    value = np.stack([best.column(c).to_numpy() for c in ("base", *scores)], 1) if known else np.zeros((0, size + 1))
    end = np.array([model.base(model.total[2]), *model.end()])
    table = spark.sparkContext.broadcast((known, value, end))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, value, end = table.value
        row = TaskContext.get().partitionId() << 40
        for part in parts(batches):
            tokens, seen, sums, word, times, offsets = [], [], [], [], [], [0]
            for text in binaries(part, 1):
                n, k, total, other = 1, 0, end, Counter()
                for words in words_of(text):
                    at = np.array(list(map(known.get, words, repeat(-1))), np.int64)
                    hit = at >= 0
                    n, k, total = n + len(words), k + int(hit.sum()), total + value[at[hit]].sum(0)
                    other.update([words[j] for j in np.flatnonzero(~hit)])
                tokens.append(n)
                seen.append(k)
                sums.append(total)
                word += other
                times += other.values()
                offsets.append(len(word))
            rest = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(word, pa.binary()), pa.array(times, pa.int64())], names=["word", "times"]))
            keys = np.arange(row, row + part.num_rows)
            row += part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(keys), part.column(0), pa.array(tokens, pa.int64()), pa.array(seen, pa.int64()), rest, *(pa.array(c) for c in np.array(sums).T)], names=["row", "doc_id", "n_tokens", "seen", "rest", "base", *scores])

    whole = stored(own.select("doc_id", "text").mapInArrow(read, f"row long, doc_id long, n_tokens long, seen long, rest array<struct<word:binary,times:long>>, {shape}"))
    # the rows of a text's rare words, then their counts: number of occurrences stands in `row` beside its text's
    rare = whole.select(F.col("row").alias("of"), F.inline("rest")).join(counts, "word", "left")
    told = rare.select("word", "n", F.struct("of", "times").alias("row"), *own_counts).mapInArrow(valued, f"word binary, n long, row struct<of:long,times:long>, {shape}")
    summed = told.groupBy(F.col("row.of").alias("row")).agg(F.sum(F.when(F.col("n").isNotNull(), F.col("row.times"))).alias("k"), *(F.sum(F.col("row.times") * F.col(c)).alias(f"_{c}") for c in ("base", *scores)))
    out = whole.join(summed, "row", "left").withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0.0)) for c in ("base", *scores)})
    of = [F.col(c) + float(p) for c, p in zip(scores, model.prior(), strict=True)]
    top = F.greatest(*of) if size > 1 else of[0]
    # the end is a known token where there is a training text
    return out.select(
        "doc_id", "n_tokens", (F.col("seen") + F.coalesce("k", F.lit(0)) + F.lit(int(model.total[2] > 0))).cast("long").alias("n_known"), F.lit(model.total[0]).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), (top + F.log10(sum((F.pow(F.lit(10.0), x - top) for x in of), F.lit(0.0)))).alias("score"),
    )
