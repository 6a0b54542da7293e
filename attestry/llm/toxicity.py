"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows that tell quotation from abuse.

Texts are cut into words by one rule, when terms are learned and when texts are scored: runs of letters and digits of any
script, of any length. In scripts that set no blanks between words every letter begins a word that lasts to the end of its
run, so that terms are found inside a run.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, column, parts, ship, steps, stored, strings

#: The fit takes at most so many toxic and other labelled documents, chosen by a hash of doc_id.
TRAIN_TOXIC, TRAIN_OTHER = 2500, 5000
TERMS, STEM, LEAST_DOCS, LEAST_ODDS = 400, 4, 3, 3.0
#: Terms that chance alone is expected to bring, at most, among all words that toxic documents share.
BY_CHANCE = 0.5
#: A beginning of words is a term only if so many different words of toxic documents have it and no one of them makes up most.
LEAST_FORMS, MOST_OF_ONE = 4, 0.5
#: Terms of so many letters match with one edit, unless edits of them are common in other texts.
FUZZY_FROM, MOST_FUZZY = 5, 0.005
#: Words on both sides of a hit that its context score sees.
CONTEXT = 20
QUOTES = frozenset("\"“”„«»‹›「」『』")
GRAM = (2, 4)
FEATURES = 8

#: Letters, digits and the marks that belong to them; and those of scripts without blanks between words, by Unicode block:
#: Thai and Lao, Burmese, Khmer, kana, Han.
WORD = np.array([unicodedata.category(chr(c))[0] in "LNM" for c in range(0x110000)])
BARE = np.zeros(0x110000, bool)
for _a, _b in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0x20000, 0x3FFFF)):
    BARE[_a : _b + 1] = WORD[_a : _b + 1]


def words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and whether it stands in a run without blanks, where every letter begins one."""
    word, bare = np.concatenate([[False], WORD[codes], [False]]), np.concatenate([[False], BARE[codes], [False]])
    start = np.flatnonzero(word[1:-1] & (~word[:-2] | bare[1:-1] | bare[:-2]))
    stop = np.flatnonzero(word[1:-1] & (~word[2:] | (bare[1:-1] != bare[2:])))
    return start, stop[np.searchsorted(stop, start)] + 1, bare[1:-1][start]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)


def vocabulary(text: str) -> set[str]:
    """What terms are learned from: the words of a lower-cased text; of a run without blanks its pieces of 2 to 4 letters."""
    out: set[str] = set()
    for a, b, bare in zip(*(x.tolist() for x in words(points(text))), strict=True):
        if bare:
            out.update(text[a : a + n] + "*" for n in range(GRAM[0], min(GRAM[1], b - a) + 1))
        elif b - a >= 3:
            out.add(text[a:b])
    return out


class Lexicon:
    """A trie of terms, run together with the Levenshtein automata of distance one of its longer terms.

    A term that ends in * matches every word it begins. States of the product are sets of (node, errors), made when a text
    first needs them; a word runs until its set is empty or nothing that follows can change what it matched, which for most
    words is after three or four letters, however long they are. tolerant names the terms that may be misspelt.
    """

    def __init__(self, terms: dict[str, float], fuzzy_from: int = FUZZY_FROM, tolerant: set[str] | None = None) -> None:
        self.terms, self.weights = list(terms), np.array([*terms.values(), 0.0])
        self.nodes: list[dict[str, int]] = [{}]
        self.ends: dict[int, int] = {}
        self.stems: dict[int, int] = {}
        self.deep = {0}
        self.soft: set[int] = set()
        for k, term in enumerate(self.terms):
            at, word = 0, term.rstrip("*")
            own = not term.endswith("*") and len(word) >= fuzzy_from if tolerant is None else term in tolerant
            for c in word:
                if c not in self.nodes[at]:
                    self.nodes[at][c] = len(self.nodes)
                    self.nodes.append({})
                at = self.nodes[at][c]
                if own:
                    self.deep.add(at)
            (self.stems if term.endswith("*") else self.ends)[at] = k
            if own:
                self.soft.add(k)
        letters = sorted({c for node in self.nodes for c in node})
        self.letters = ["", *letters]  # 0: any other letter
        self.points = np.array([ord(c) for c in letters], np.int64)
        start = self._closed({(0, 0)})
        self.sets, self.ids = [frozenset(), start], {frozenset(): 0, start: 1}
        self.table = np.full((2, len(self.letters)), -1, np.int64)
        self.table[0] = 0
        self.told = [self._accept(s) for s in self.sets]

    def _closed(self, states: set) -> frozenset:
        """A letter of the term may be missing in the word; a beginning of words that is complete stays matched."""
        out = set(states)
        for node, e in states:
            if e == 0 and node in self.deep:
                out |= {(n, 1) for n in self.nodes[node].values() if n in self.deep}
        for node, e in list(out):
            if node > 0 and node in self.stems and (e == 0 or self.stems[node] in self.soft):
                out.add((-1 - self.stems[node], e))
        return frozenset(out)

    def _accept(self, states: frozenset) -> tuple[int, int, int]:
        """Term and errors of the best match, or no term; and whether later letters cannot change it."""
        best = [(e, self.ends[n]) for n, e in states if n >= 0 and n in self.ends and (e == 0 or self.ends[n] in self.soft)]
        best += [(e, -1 - n) for n, e in states if n < 0]
        settled = all(n < 0 for n, _ in states)
        return (min(best)[1], min(best)[0], settled) if best else (len(self.terms), 0, settled)

    def _step(self, state: int, letter: int) -> int:
        c, out = self.letters[letter], set()
        for node, e in self.sets[state]:
            if node < 0:
                out.add((node, e))
                continue
            to = self.nodes[node].get(c) if c else None
            if to is not None:
                out.add((to, e))
            if e == 0 and node in self.deep:
                out.add((node, 1))  # a letter too many
                out |= {(n, 1) for ch, n in self.nodes[node].items() if ch != c and n in self.deep}  # another letter
        new = self._closed(out)
        if new not in self.ids:
            self.ids[new] = len(self.sets)
            self.sets.append(new)
            self.told.append(self._accept(new))
            if len(self.sets) > len(self.table):
                self.table = np.vstack([self.table, np.full_like(self.table, -1)])
        return self.ids[new]

    def _class(self, codes: np.ndarray) -> np.ndarray:
        """Which letter of the lexicon each code point is, or 0."""
        if not len(self.points):
            return np.zeros(len(codes), np.int64)
        k = np.minimum(np.searchsorted(self.points, codes), len(self.points) - 1)
        return np.where(self.points[k] == codes, k + 1, 0)

    def match(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words match, their terms and errors; codes are lower-case code points."""
        state = np.ones(len(start), np.int64)
        live, k = np.arange(len(start)), 0
        done = np.array([x[2] for x in self.told])
        while True:
            live = live[(size[live] > k) & ~done[state[live]]]
            if not len(live):
                break
            s, c = state[live], self._class(codes[start[live] + k])
            nxt = self.table[s, c]
            gaps = np.unique(s[nxt < 0] * len(self.letters) + c[nxt < 0])
            for g in gaps.tolist():
                a, b = divmod(g, len(self.letters))
                self.table[a, b] = self._step(a, b)
            if len(gaps):
                nxt = self.table[s, c]
                done = np.array([x[2] for x in self.told])
            state[live] = nxt
            k += 1
        told = np.array(self.told, np.int64)
        term = told[state, 0]
        hit = np.flatnonzero(term < len(self.terms))
        return hit, term[hit], told[state[hit], 1]

    def hits(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """doc, word (its number in all texts), term, errors and quoted of every match, and where each text's words begin."""
        flat = "\n".join(texts).lower()
        if len(flat) != sum(map(len, texts)) + max(0, len(texts) - 1):  # a letter whose lower case is longer
            texts = [x.lower() for x in texts]
            flat = "\n".join(texts)
        codes = points(flat)
        start, end, _ = words(codes)
        first = np.cumsum([0, *(len(x) + 1 for x in texts)])
        at = np.searchsorted(start, first)
        hit, term, errors = self.match(codes, start, end - start)
        doc = np.searchsorted(at, hit, "right") - 1
        quote = np.concatenate([[0], np.cumsum(np.isin(codes, [ord(c) for c in QUOTES]))])
        odd = ((quote[start[hit]] - quote[first[doc]]) % 2 == 1) & (quote[first[doc + 1] - 1] > quote[np.minimum(end[hit], first[doc + 1] - 1)])
        return doc, hit, term, errors, odd, at

    def features(self, texts: list[str]) -> np.ndarray:
        """Of each text: matches right and misspelled, distinct terms, weights, density, and context scores of its hits.

        A hit in quotation marks counts apart. The context score of another hit is the sum of the weights of the unquoted
        hits within CONTEXT words, its own included, less that of the quoted ones: abuse clusters, quotation is marked.
        """
        out = np.zeros((len(texts), FEATURES))
        doc, hit, term, errors, odd, at = self.hits(texts)
        weight = self.weights[term] * np.where(errors > 0, 0.5, 1.0)
        signed = np.where(odd, -weight, weight)
        total = np.concatenate([[0], np.cumsum(signed)])
        lo = np.maximum(np.searchsorted(hit, hit - CONTEXT), np.searchsorted(doc, doc))
        hi = np.minimum(np.searchsorted(hit, hit + CONTEXT, "right"), np.searchsorted(doc, doc, "right"))
        near = total[hi] - total[lo]
        add = lambda k, v: np.add.at(out[:, k], doc, v)
        add(0, (errors == 0) & ~odd)
        add(1, (errors > 0) & ~odd)
        add(2, odd)
        pairs = np.unique(np.stack([doc, term]), axis=1) if len(doc) else np.zeros((2, 0), int)
        np.add.at(out[:, 3], pairs[0], 1)
        add(4, signed)
        np.maximum.at(out[:, 5], doc, near)
        np.maximum.at(out[:, 6], doc, weight * ~odd)
        out[:, 7] = 100 * (out[:, 0] + out[:, 1]) / np.maximum(np.diff(at), 1)
        out[:, :4] = np.log1p(out[:, :4])
        out[:, 4:7] = np.sign(out[:, 4:7]) * np.log1p(np.abs(out[:, 4:7]))
        out[:, 7] = np.log1p(out[:, 7])
        return out


def learned_terms(toxic: list[set[str]], other: list[set[str]], most: int = TERMS) -> dict[str, float]:
    """Words and beginnings of words (with *) that far more toxic documents have than others, with their log odds.

    A beginning is a term only where many different words of toxic documents share it and none of them makes up most of its
    documents, so an inflected stem is one and the first letters of a single insult are not; of beginnings that the same
    documents have it is the longest. It is weighed against all its completions in the other documents. Pieces of runs
    without blanks (with * already) are terms as they are. Words stand beside their beginnings; `most` bounds each kind. Of
    all terms fewer than BY_CHANCE are expected by chance, so a small sample gives few terms rather than wrong ones.
    """
    toxic = [set(x) for x in {frozenset(x) for x in toxic}]

    def stems(words: set[str]) -> set[str]:
        return {w[:k] + "*" for w in words if not w.endswith("*") for k in range(STEM, min(len(w), 13))}

    words = Counter(w for x in toxic for w in x)
    begun = Counter(p for x in toxic for p in stems(x))
    begun = {p: n for p, n in begun.items() if n >= LEAST_DOCS}
    forms, peak = Counter(), Counter()
    for w, n in words.items():
        for p in stems({w}):
            if p in begun:
                forms[p] += 1
                peak[p] = max(peak[p], n)
    longer = {p[:-2] + "*" for p, n in begun.items() if begun.get(p[:-2] + "*") == n}
    pos = {w: n for w, n in words.items() if n >= LEAST_DOCS}
    pos |= {p: n for p, n in begun.items() if forms[p] >= LEAST_FORMS and peak[p] <= MOST_OF_ONE * n and p not in longer}
    neg: Counter = Counter()
    for x in other:
        neg.update(p for p in x | stems(x) if p in pos)
    P, N = len(toxic) + 1, len(other) + 1
    odds = {p: float(np.log((n + 0.5) / (P - n + 0.5)) - np.log((neg[p] + 0.5) / (N - neg[p] + 0.5))) for p, n in pos.items()}
    share = P / (P + N)
    chance = lambda p: sum(comb(pos[p] + neg[p], k) * share**k * (1 - share) ** (pos[p] + neg[p] - k) for k in range(pos[p], pos[p] + neg[p] + 1)) * len(pos)
    good = sorted((p for p in odds if odds[p] >= LEAST_ODDS and neg[p] <= 0.1 * pos[p] and chance(p) <= BY_CHANCE), key=lambda p: (-odds[p], len(p), p))
    begins = [p for p in good if p.endswith("*")][:most]
    return {p: odds[p] for p in sorted({*begins, *[p for p in good if not p.endswith("*")][:most]}, key=lambda p: (-odds[p], p))}


class Scorer:
    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.mean, self.scale, self.coef = lexicon, np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1)
        self.coef[0] = -2.0

    def fit(self, x: np.ndarray, y: np.ndarray, penalty: float = 0.3, rounds: int = 40) -> Scorer:
        """Logistic regression by Newton's method with a ridge."""
        if not len(y) or y.min() == y.max():
            self.coef[0] = -2.0 if not len(y) or y[0] == 0 else 2.0
            return self
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        b, ridge = np.zeros(z.shape[1]), np.diag([0.0, *[penalty] * x.shape[1]])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge + 1e-9 * np.eye(len(b)), z.T @ (y - p) - ridge @ b)
            b += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-6:
                break
        self.coef = b
        return self

    def scores(self, texts: list[str]) -> np.ndarray:
        z = (self.lexicon.features(texts) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.coef[0] + z @ self.coef[1:], -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, other: int = TRAIN_OTHER) -> DataFrame:
    """text and toxic of a bounded choice of labelled documents, none of them held out; ids go to the tasks, texts stay."""
    own = labels.select(column(labels, "doc_id", "long").alias("doc_id"), column(labels, "toxic", "int").alias("toxic")).where("doc_id is not null and pmod(crc32(cast(doc_id as string)), 5) <> 0")
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = stored(bounded(own.where("toxic = 1"), toxic, "toxicity", "doc_id").union(bounded(own.where("toxic = 0"), other, "toxicity", "doc_id")))
    return docs.join(F.broadcast(ids), "doc_id").select("text", "toxic")


def fitted(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Terms and coefficients from a bounded sample; the words of a text are gathered where it is read.

    Which terms may be misspelt is learned too: those whose edits occur in few of the other documents.
    """
    chosen = stored(sample(docs, labels))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets = [" ".join(sorted(vocabulary(x.lower()))) for x in strings(batch, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.string()), batch.column(1)], names=["words", "toxic"])

    rows = chosen.mapInArrow(words, "words string, toxic int").collect()
    split = {y: [set(r.words.split()) for r in rows if r.toxic == y] for y in (0, 1)}
    terms = learned_terms(split[1], split[0])
    free = Lexicon(terms, tolerant={t for t in terms if len(t.rstrip("*")) >= FUZZY_FROM})

    def misspelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            doc, _, term, errors, _, _ = free.hits(strings(batch, 0))
            pairs = np.unique(np.stack([doc, term])[:, errors > 0], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[1], pa.int64())], names=["term"])

    common = chosen.where("toxic = 0").select("text").mapInArrow(misspelt, "term long").groupBy("term").count().collect()
    bad = {free.terms[r.term] for r in common if r["count"] > MOST_FUZZY * len(split[0])}
    scorer = Scorer(Lexicon(terms, tolerant={free.terms[k] for k in free.soft} - bad))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            x = scorer.lexicon.features(strings(batch, 0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    told = chosen.mapInArrow(features, "x array<double>, toxic int").collect()
    x, y = np.array([r.x for r in told]).reshape(-1, FEATURES), np.array([r.toxic for r in told], float)
    order = np.lexsort([*x.T, y])  # sums do not depend on the order in which tasks end
    return scorer.fit(x[order], y[order])


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score and predicted for every row; null and empty texts are scored as texts without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts, out = strings(batch, 1), []
            raw = [x.encode("utf-8", "replace") for x in texts] if max(map(len, texts), default=0) > 1 << 16 else None
            for i, j in steps(raw or texts, 1 << 19):
                out.append(scorer.scores(texts[i:j]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted, for every row of docs.

    Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0; a score depends on the text alone. With no
    labels, or labels of one class, every text gets the same score. Labels that are null are not learned from; a document
    labelled twice counts as toxic if one label says so. A row without doc_id is not held out. Ids are integers, or texts of
    integers. Very long texts are scored whole, one at a time; a word of any length and script is looked up. Repeated rows
    get equal scores; other columns are not read; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    own = docs.select(column(docs, doc_id, "long").alias("doc_id"), column(docs, text, "string").alias("text"))
    found = scored(own, fitted(own, labels))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
