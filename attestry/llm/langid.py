"""Language by a byte convolutional network: filters of several widths, max pooling and softmax, trained in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binaries, bounded, column, parts, ship, steps

WIDTH, EMBED, FILTERS, WIDTHS = 256, 8, 24, (2, 3, 4)
#: The fit takes at most so many labelled documents, chosen by a hash of doc_id, and at most so many windows of each.
TRAIN_DOCS, TRAIN_WINDOWS = 4000, 3
BATCH, ROUNDS, RATE, SEED = 96, 420, 4e-3, 5
LETTER = re.compile(r"[^\W\d_]")


class ByteNet:
    """Byte embedding, filters over 2 to 4 bytes, the maximum of each filter over a window of 256 bytes, softmax."""

    def __init__(self, langs: list[str], seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"e": r.normal(0, 0.5, (256, EMBED))}
        for w in WIDTHS:
            self.p |= {f"w{w}": r.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)), f"b{w}": np.zeros(FILTERS)}
        self.p |= {"o": r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))), "c": np.zeros(len(langs))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    @staticmethod
    def _patches(x: np.ndarray, w: int) -> np.ndarray:
        n, length, d = x.shape
        out = np.empty((n, length - w + 1, w * d), np.float32)
        for o in range(w):
            out[:, :, o * d : (o + 1) * d] = x[:, o : length - w + 1 + o]
        return out

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list]:
        """Pooled features for the fit, with the patches and where each filter is largest."""
        x, out, seen = self.p["e"][windows], [], []
        for w in WIDTHS:
            patch = self._patches(x, w)
            y = (patch.reshape(-1, patch.shape[2]) @ self.p[f"w{w}"]).reshape(len(x), -1, FILTERS)
            top = y.argmax(1)
            seen.append((patch, top))
            out.append(np.take_along_axis(y, top[:, None], 1)[:, 0] + self.p[f"b{w}"])
        return np.maximum(np.concatenate(out, 1), 0), seen

    def _joined(self) -> np.ndarray:
        """All filters as one matrix over the longest width."""
        out = np.zeros((FILTERS * len(WIDTHS), max(WIDTHS) * EMBED), np.float32)
        for k, w in enumerate(WIDTHS):
            out[k * FILTERS : (k + 1) * FILTERS, : w * EMBED] = self.p[f"w{w}"].T
        return out

    def probabilities(self, windows: np.ndarray, at_once: int = 16) -> np.ndarray:
        """Positions lie along the rows, so that one product serves all widths and maxima run over adjacent numbers."""
        out, filters, table = np.empty((len(windows), len(self.langs)), np.float32), self._joined(), np.ascontiguousarray(self.p["e"].T)
        for s in range(0, len(windows), at_once):
            part = windows[s : s + at_once]
            n, x = part.size, np.take(table, part.ravel(), axis=1)
            shifted = np.zeros((max(WIDTHS) * EMBED, n), np.float32)
            for o in range(max(WIDTHS)):
                shifted[o * EMBED : (o + 1) * EMBED, : n - o] = x[:, o:]
            y = (filters @ shifted).reshape(len(filters), len(part), WIDTH)
            h = np.concatenate([y[k * FILTERS : (k + 1) * FILTERS, :, : WIDTH - w + 1].max(2) + self.p[f"b{w}"][:, None] for k, w in enumerate(WIDTHS)])
            z = np.maximum(h, 0).T @ self.p["o"] + self.p["c"]
            z = np.exp(z - z.max(1, keepdims=True))
            out[s : s + at_once] = z / z.sum(1, keepdims=True)
        return out

    def fit(self, windows: np.ndarray, target: np.ndarray, seed: int = SEED) -> ByteNet:
        """Adam on the cross-entropy; gradients pass a filter's maximum only."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for t in range(1, ROUNDS + 1):
            at = r.integers(0, len(windows), BATCH)
            x, y = windows[at], target[at]
            h, seen = self.pooled(x)
            z = h @ self.p["o"] + self.p["c"]
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(y)), y] -= 1
            z /= len(y)
            g = {"o": h.T @ z, "c": z.sum(0), "e": np.zeros_like(self.p["e"])}
            dh = (z @ self.p["o"].T) * (h > 0)
            for k, w in enumerate(WIDTHS):
                patch, top = seen[k]
                d = dh[:, k * FILTERS : (k + 1) * FILTERS]
                best = np.take_along_axis(patch, top[:, :, None], 1)
                g[f"w{w}"], g[f"b{w}"] = np.einsum("nf,nfd->df", d, best), d.sum(0)
                back = d[:, :, None] * self.p[f"w{w}"].T
                for o in range(w):
                    np.add.at(g["e"], np.take_along_axis(x, top + o, 1), back[:, :, o * EMBED : (o + 1) * EMBED])
            for k, x in self.p.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                x -= (RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self

    def texts(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """The language of each text and its share of the windows' probability; und and 0 without a letter."""
        size = [-(-len(x) // WIDTH) for x in texts]
        flat = np.zeros(sum(size) * WIDTH, np.uint8)
        first = np.cumsum([0, *size])
        for x, s in zip(texts, first.tolist(), strict=False):
            flat[s * WIDTH : s * WIDTH + len(x)] = np.frombuffer(x, np.uint8)
        total = np.zeros((len(texts), len(self.langs)))
        if len(flat) and self.langs:
            m = flat.reshape(-1, WIDTH)
            weight = (m != 0).sum(1, keepdims=True)
            some = np.flatnonzero(size)
            total[some] = np.add.reduceat(self.probabilities(m) * weight, first[:-1][some], axis=0)
        lang, score = [], []
        for x, t in zip(texts, total, strict=True):
            ok = t.sum() > 0 and LETTER.search(x.decode("utf-8", "replace"))
            lang.append(self.langs[int(t.argmax())] if ok else "und")
            score.append(float(t.max() / t.sum()) if ok else 0.0)
        return lang, score


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1


def fitted(docs: DataFrame, most: int = TRAIN_DOCS) -> ByteNet:
    """A network that learned from windows of at most `most` documents with a lang, none of them held out."""
    raw = F.col("text").cast("binary")
    n = F.length(raw)
    at = F.transform(F.sequence(F.lit(0), F.lit(TRAIN_WINDOWS - 1)), lambda k: (F.pmod(F.xxhash64("doc_id", k), F.greatest(F.floor(n / WIDTH), F.lit(1))) * WIDTH + 1).cast("int"))
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(), F.lit(True)))
    rows = bounded(own.select("doc_id", "lang", F.array_distinct(F.transform(at, lambda p: F.substring(raw, p, F.lit(WIDTH)))).alias("w")), most, "sample", "doc_id", "lang").collect()
    langs = sorted({r.lang for r in rows})
    pairs = [(bytes(w), langs.index(r.lang)) for r in rows for w in r.w if w]
    net = ByteNet(langs)
    if not pairs:
        return ByteNet([])
    m = np.zeros((len(pairs), WIDTH), np.uint8)
    for k, (w, _) in enumerate(pairs):
        m[k, : len(w)] = np.frombuffer(w, np.uint8)
    return net.fit(m, np.array([y for _, y in pairs]))


def languages(docs: DataFrame, net: ByteNet | None = None, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """All columns of docs, then lang_pred and score; columns of these names in docs are replaced.

    Every window of a text counts, by its bytes. Null texts and texts without a letter are und with score 0; so is every text
    when no labelled row is there to learn from. Long texts are scored window by window. Equal texts get equal results.
    """
    ship(docs.sparkSession)
    if net is None:
        net = fitted(docs.select(column(docs, doc_id, "long").alias("doc_id"), column(docs, text, "string").alias("text"), column(docs, lang, "string").alias("lang")))
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts, langs, scores = binaries(batch, at), [], []
            for i, j in steps(texts, 1 << 19):
                a, b = net.texts(texts[i:j])
                langs += a
                scores += b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    own = docs.select(*(f"`{c}`" for c in names))
    shape = own.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return own.mapInArrow(run, shape)


def predictions(docs: DataFrame) -> DataFrame:
    own = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"), column(docs, "lang", "string").alias("lang"))
    net = fitted(own)
    return languages(own.select("doc_id", "text"), net).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """docs whose language is one of the learned ones with a score of at least `least`; und goes."""
    names = docs.columns
    found = languages(docs)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*(f"`{c}`" for c in names))
