"""Personal data: generators propose spans freely, boosted trees score format and context, calibrated thresholds select.

Spans of the base patterns always stay. Where a proposed span overlaps none of them, it is added if its trees' score reaches
the threshold of its kind, the best score first.

The trees learn from examples that do not come from the base patterns: personal data in formats that those miss (spelt-out
and broken addresses, national telephone numbers, cards and account numbers with other separators, keys) and look-alikes
(dates, versions, order numbers, sums, identifiers, numbers that fail their check digits) are planted in cuts of the
corpus's own texts. Thresholds are set on examples of other formats, in other cuts. The number of examples is the same for a
corpus of any size.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, column, parts, ship, strings

# fixed values: the base patterns
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "secret", "account", "number")
EMAIL_K, IP_K, CARD_K, PHONE_K, SECRET_K, ACCOUNT_K, NUMBER_K = range(7)

#: What the numeric patterns consist of; every match lies in one run.
RUN = re.compile(r"[0-9+][\x20().0-9+-]*")
LOOSE = re.compile(r"[0-9(+][0-9 ()./\[\]+-]*")
NOT_DIGIT = re.compile(r"[^0-9]+")
AT = re.compile(r"\s?[\[({]?(?<![A-Za-z0-9])[aA][tT](?![A-Za-z0-9])[\])}]?\s?|\s?[\[({]@[\])}]\s?")
DOTTED = re.compile(r"[A-Za-z0-9-]+(?:\s?[\[({]?(?<![A-Za-z0-9])[dD][oO][tT](?![A-Za-z0-9])[\])}]?\s?[A-Za-z0-9-]+|\s?[\[({]\.[\])}]\s?[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+")
BROKEN_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?: ?\[\.\] ?| \. |\(\.\))[0-9]{1,3}){3}(?![0-9])")
IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}(?:::?)){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SECRET = re.compile(r"(?:[Tt]oken|[Ss]ecret|[Pp]assw(?:or)?d|[Aa]pi[_-]?[Kk]ey|TOKEN|SECRET|KEY)[\"']?\s?[=:]\s?[\"']?([A-Za-z0-9_/+=-]{12,})")
SECRET_WORDS = ("oken", "ecret", "assw", "pi_key", "pikey", "pi-key", "piKey", "TOKEN", "SECRET", "KEY")

#: Cuts of the corpus in which examples are planted: so many of so many characters, chosen by a hash of doc_id.
CUTS, CUT_CHARS = 600, 400
#: Examples for the trees and for the thresholds.
PLANTED, CALIBRATION = 6000, 6000
PRECISION = 0.98

Span = tuple[int, int, int]  # start, end, position in KINDS


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The valid matches of the base patterns, ordered by start, then kind."""
    out: list[Span] = []
    if "@" in text:
        out += [(m.start(), m.end(), 0) for m in _emails(text)]
    for run in RUN.finditer(text):
        part = run[0]
        if len(part) < 7:
            continue
        at = run.start()
        if part.count(".") >= 3:
            for m in IP.finditer(part):
                if all(len(n := x.lstrip("0")) <= 3 and int(n or 0) <= 255 for x in m[0].split(".")):
                    out.append((at + m.start(), at + m.end(), 1))
        if len(part) >= 12:
            for m in CARD.finditer(part):
                if m.end() - m.start() >= 12:
                    digits = NOT_DIGIT.sub("", m[0])
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append((at + m.start(), at + m.end(), 2))
        if "+" in part:
            for m in PHONE.finditer(part):
                if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((at + m.start(), at + m.end(), 3))
    out.sort(key=lambda s: (s[0], s[2], s[1]))
    return out


def _emails(text: str) -> Iterator[re.Match]:
    """The matches of EMAIL; only runs that end at an @ are tried."""
    last, at = 0, text.find("@")
    while at >= 0:
        k = at
        while k > last and (text[k - 1].isascii() and (text[k - 1].isalnum() or text[k - 1] in "._%+-")):
            k -= 1
        m = EMAIL.match(text, k) if k < at else None
        if m:
            yield m
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _spelt(text: str) -> Iterator[tuple[int, int]]:
    """Addresses written with words or brackets for their signs: what stands before an `at`, and names joined by `dot` behind it."""
    for m in AT.finditer(text):
        host = DOTTED.match(text, m.end())
        s = m.start()
        while s > 0 and (text[s - 1].isalnum() or text[s - 1] in "._%+-"):
            s -= 1
        if host and s < m.start():
            yield s, host.end()


def _wide(text: str) -> Iterator[tuple[int, int]]:
    """Around every @ as far as no blank, quotation mark or bracket stands; of any length."""
    stop, at, last = " \t\r\n\x0b\x0c@<>\"'(),;:", text.find("@"), 0
    while at >= 0:
        s, e = at, at + 1
        while s > last and text[s - 1] not in stop:
            s -= 1
        while e < len(text) and text[e] not in stop:
            e += 1
        if s < at and e > at + 1:
            yield s, e
        last = e
        at = text.find("@", e)


def candidates(text: str) -> list[Span]:
    """Spans that may be personal data, of any format close to it; they may overlap."""
    out: list[Span] = []
    for run in LOOSE.finditer(text):
        s, part = run.start(), run[0].rstrip(" ()./[]+-")
        digits = len(NOT_DIGIT.sub("", part))
        if digits < 7:
            continue
        whole = s, s + len(part)
        if 12 <= digits <= 19:
            out.append((*whole, CARD_K))
        if digits <= 15:
            out.append((*whole, PHONE_K))
        if digits == 9:
            out.append((*whole, NUMBER_K))
        if digits > 9:  # several numbers that only blanks part
            at = s
            for piece in part.split(" "):
                n = len(NOT_DIGIT.sub("", piece))
                if len(piece) < len(part) and 7 <= n <= 19:
                    out += [(at, at + len(piece), k) for k, fits in ((CARD_K, n >= 12), (PHONE_K, n <= 15), (NUMBER_K, n == 9)) if fits]
                at += len(piece) + 1
    if "@" in text:
        out += [(*x, EMAIL_K) for x in _wide(text)]
    if "t" in text or "T" in text or "@" in text:
        out += [(*x, EMAIL_K) for x in _spelt(text)]
    if "." in text:
        out += [(m.start(), m.end(), IP_K) for m in BROKEN_IP.finditer(text)]
    if ":" in text:
        out += [(m.start(), m.end(), IP_K) for m in IP6.finditer(text)]
    out += [(m.start(), m.end(), ACCOUNT_K) for m in IBAN.finditer(text)]
    if any(w in text for w in SECRET_WORDS):
        out += [(m.start(1), m.end(1), SECRET_K) for m in SECRET.finditer(text)]
    return out


# fixed values: words before a span that name its kind, and words that name something else
CUES = (("mail", "contact", "write", "reach"), ("ip", "host", "server", "addr"), ("card", "visa", "paid", "payment"), ("tel", "phone", "call", "fax", "mobile", "ring"), ("token", "key", "secret", "passw"), ("iban", "account", "bank", "transfer"), ("ssn", "social", "insurance", "tax id"))
OTHER = ("order", "invoice", "version", "release", "isbn", "serial", "item", "ticket", "page", "ref", "no.", "build", "since", "from", "dated")


def mod97(x: str) -> bool:
    """The check of an international account number."""
    flat = "".join(c for c in x if c.isalnum()).upper()
    return flat[:4].isascii() and flat.isalnum() and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4] if c.isascii()) or "0") % 97 == 1


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate: kind, characters, groups, entropy, check digits, neighbours and words before it."""
    s, e, kind = span
    x, before = text[s:e], text[max(0, s - 32) : s].lower()
    digits, letters = sum(c.isdigit() for c in x), sum(c.isalpha() for c in x)
    groups = [len(g) for g in re.split(r"[^0-9A-Za-z]+", x) if g]
    counts = [x.count(c) for c in set(x)]
    entropy = -sum(n / len(x) * math.log2(n / len(x)) for n in counts)
    tail = x.rpartition(".")[2]
    numbers = NOT_DIGIT.sub("", x)
    prev, nxt = text[s - 1 : s], text[e : e + 1]
    date = bool(re.search(r"(?<!\d)(?:19|20)\d\d[-/.](?:0?[1-9]|1[0-2])[-/.]|[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)\d\d|^(?:19|20)\d{6}|(?<!\d)(?:19|20)\d\d ?- ?(?:19|20)?\d\d(?!\d)", x))
    return [
        kind, len(x), digits, letters, digits / len(x), len(groups), max(groups, default=0), min(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0, x.count("."), x.count("-"), x.count(" "), x.count("/"), float("(" in x and ")" in x),
        float(x[0] == "+"), float(x[:2] == "00"), float(x[:1] == "0"), float("@" in x), float("dot" in x.lower() or "[.]" in x or "(.)" in x), len(tail) if tail.isalpha() else 0, entropy, float(any(c.isupper() for c in x) and any(c.islower() for c in x)),
        float(prev.isalnum() or prev in tuple("-./+#$€=")), float(nxt.isalnum() or nxt in tuple("-/%")), float(any(w in before for w in CUES[kind])), float(any(w in before for w in OTHER)), float(luhn(numbers) if digits else 0), float(kind == ACCOUNT_K and mod97(x)), float(date), x.count(":") + x.count("::"),
    ]


class Planter:
    """Examples for one seed: texts with a planted span each, its kind (or -1 for a look-alike). side tells apart the formats
    of the trees (0) and those of the thresholds (1); some formats belong to both."""

    def __init__(self, cuts: list[str], seed: int, side: int) -> None:
        self.r, self.cuts, self.side = random.Random(seed), cuts or [""], side

    def _d(self, n: int, first: str = "123456789") -> str:
        return self.r.choice(first) + "".join(self.r.choice("0123456789") for _ in range(n - 1)) if n else ""

    def _word(self, n: tuple[int, int] = (3, 9)) -> str:
        return "".join(self.r.choice("bcdfghklmnprstvw" if k % 2 else "aeiou") for k in range(self.r.randint(*n)))

    def _checked(self, n: int, good: bool) -> str:
        while True:
            x = self._d(n)
            if luhn(x) == good:
                return x

    def _iban(self, good: bool) -> str:
        head, body = self.r.choice(("DE", "FR", "ES", "GB", "NL", "CH")), self._d(self.r.choice((14, 16, 18, 20)))
        if self.r.random() < 0.4:
            body = "".join(self.r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(4)) + body[4:]
        sum_ = 98 - int("".join(str(int(c, 36)) for c in body + head + "00")) % 97
        return f"{head}{(sum_ if good else (sum_ + self.r.randint(1, 90)) % 97):02d}{body}"

    def _fours(self, x: str, sep: str) -> str:
        return sep.join(x[k : k + 4] for k in range(0, len(x), 4))

    def positive(self) -> tuple[str, int, str]:
        """Text, kind and a word that may stand before it."""
        r, side = self.r, self.side
        kind = r.choice((EMAIL_K, EMAIL_K, IP_K, CARD_K, PHONE_K, PHONE_K, SECRET_K, ACCOUNT_K, NUMBER_K))
        cue = r.choice(CUES[kind])
        if kind == EMAIL_K:
            name = self._word() + r.choice(("", ".", "_")) + self._word((2, 6)) + r.choice(("", str(r.randint(1, 99))))
            host, end = self._word() + r.choice(("", f"-{self._word()}")), r.choice(("com", "org", "net", "de", "fr", "es", "edu", "io"))
            forms = ((" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", "."), ("(@)", ".")), ((" AT ", " DOT "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" {at} ", " {dot} "), ("[@]", "[.]"))
            at, dot = r.choice(forms[side])
            return f"{name}{at}{host}{dot}{end}", kind, cue
        if kind == IP_K:
            four = [str(r.randint(0, 255)) for _ in range(4)]
            six = [f"{r.randint(0, 65535):x}" for _ in range(r.choice((4, 5, 6)))]
            return r.choice((r.choice(("[.]", " . ") if side else ("[.]", "(.)")).join(four), ":".join(six[:3]) + "::" + ":".join(six[3:]), ":".join(f"{r.randint(0, 65535):04x}" for _ in range(8)))), kind, cue
        if kind == CARD_K:
            return self._fours(self._checked(16, True), r.choice(("/", ".") if side else (".", " - "))), kind, cue
        if kind == PHONE_K:
            a, b, c = self._d(3, "23456789"), self._d(3), self._d(4)
            own = (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"0{a} {b}{c}", f"0{a}/{b}{c}", f"00{r.randint(1, 99)} {a} {b}{c}"), (f"{a}.{b}.{c}", f"({a}){b}-{c}", f"0{a}-{b}{c}", f"00{r.randint(1, 99)}-{a}-{b}-{c}", f"(0{a}) {b}{c}")
            return r.choice(own[side]), kind, cue
        if kind == SECRET_K:
            size = r.randint(20, 48)
            key = "".join(r.choice("0123456789abcdef" if r.random() < 0.5 else "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-") for _ in range(size))
            if r.random() < 0.5:
                key = "".join(r.choice("0123456789abcdef") for _ in range(size))
            return r.choice(("token = ", "secret: ", "api_key=", "Token: ", "password = ", "API-key: ")) + r.choice(("", '"')) + key, kind, ""
        if kind == ACCOUNT_K:
            x = self._iban(True)
            return self._fours(x, " ") if r.random() < 0.6 else x, kind, cue
        x = self._d(9)
        return r.choice((f"{x[:3]}-{x[3:5]}-{x[5:]}", f"{x[:3]} {x[3:5]} {x[5:]}")), kind, cue

    def negative(self) -> tuple[str, str]:
        """A look-alike and a word that may stand before it."""
        r = self.r
        y, m, d = r.randint(1950, 2035), r.randint(1, 12), r.randint(1, 28)
        n = r.choice((8, 9, 10, 11, 12, 13, 14, 15, 16))
        name = "_".join(self._word((4, 8)) for _ in range(r.randint(2, 4)))
        return r.choice((
            f"{y}-{m:02d}-{d:02d}", f"{d:02d}/{m:02d}/{y} {r.randint(0, 23):02d}", f"{d:02d}.{m:02d}.{y} - {d:02d}.{m:02d}.{y + 1}", f"{y}-{y + r.randint(1, 9)}", f"{y}{m:02d}{d:02d}", f"{y}{m:02d}{d:02d}-{self._d(6)}", self._checked(16, False), self._checked(16, False), self._checked(16, r.random() < 0.1),
            self._d(n), self._d(n), self._d(n), f"{self._d(3)}.{self._d(3)}.{self._d(3)},00", f"{r.randint(1, 30)}.{r.randint(0, 20)}.{self._d(7)}", f"978-{self._d(1)}-{self._d(2)}-{self._d(6)}-{self._d(1)}", f"{self._d(4)}-{self._d(4)}-{self._d(2)}", f"0.{self._d(n)}", f"{self._d(5)}-{self._d(5)}",
            self._fours(self._checked(16, False), r.choice((".", "/", " - "))), self._iban(False), "".join(r.choice("0123456789abcdef") for _ in range(r.randint(24, 48))), f"#{self._d(n)}", f"{self._d(2)}:{self._d(2)}:{self._d(2)}", f"{name}.{self._word()}::{self._word()}", f"{self._word()} at {self._word()}.", f"at {self._word()} dot matrix",
            f"@{self._word()}", f"{self._word()}@{self._word()}", f"{self._d(2)}@{self._d(3)}", f"token = {name}", f"secret: {name}", f"password = {self._word((12, 16))}", f"key: {name}", f"{self._word()} at {self._word()}", f"{self._d(3)} {self._d(3)} {self._d(3)} {self._d(3)}", f"x{self._d(n)}y",
        )), r.choice(OTHER)

    def examples(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Features and labels of the candidates that touch n planted spans."""
        r, x, y = self.r, [], []
        for _ in range(n):
            cut = r.choice(self.cuts)
            kind, cue = -1, ""
            if r.random() < 0.5:
                own, kind, cue = self.positive()
            else:
                own, cue = self.negative()
            gaps = [m.start() for m in re.finditer(r"\s", cut)]
            at = r.choice(gaps) if gaps else len(cut)
            cue = f"{cue}{r.choice((':', '', '', ' is', ' no'))} " if cue and r.random() < 0.5 else ""
            end = r.choice((" ", ".", ",", " ", "\n", '" '))
            text = f"{cut[:at]} {cue}{own}{end}{cut[at:].lstrip()}"
            s = at + 1 + len(cue)
            e = s + len(own)
            if kind == SECRET_K:
                s = e - len(re.split(r"[=:]\s?\"?", own)[-1])
            for c in candidates(text):
                if c[0] < e and s < c[1]:
                    x.append(features(text, c))
                    y.append(float(c[2] == kind and c[0] <= s and c[1] >= e and c[1] - c[0] <= e - s + 2))
        return np.array(x).reshape(-1, N_FEATURES), np.array(y)


N_FEATURES = len(features("1", (0, 1, CARD_K)))


class Trees:
    """Gradient boosting of the logistic loss with shallow trees over quantile bins."""

    def __init__(self, rounds: int = 24, depth: int = 3, rate: float = 0.3, bins: int = 16) -> None:
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[list[tuple[int, float]], np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        z = np.full(len(y), self.start)
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], 1)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p) + 1e-6
            node, splits = np.zeros(len(y), np.int64), []
            for depth in range(self.depth):
                # one split for all nodes of a level
                best = (-1.0, 0, 0)
                n = 1 << depth
                for f in range(x.shape[1]):
                    k = len(self.edges[f]) + 1
                    if k < 2:
                        continue
                    G, H = (np.bincount(node * k + b[:, f], v, n * k).reshape(n, k).cumsum(1) for v in (g, h))
                    gain = (G[:, :-1] ** 2 / (H[:, :-1] + 1) + (G[:, -1:] - G[:, :-1]) ** 2 / (H[:, -1:] - H[:, :-1] + 1)).sum(0)
                    c = int(gain.argmax())
                    if gain[c] > best[0] + 1e-9:
                        best = (float(gain[c]), f, c)
                _, f, c = best
                splits.append((f, float(self.edges[f][c]) if len(self.edges[f]) else math.inf))
                node = 2 * node + (b[:, f] > c)
            n = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, n) / (np.bincount(node, h, n) + 1)
            self.trees.append((splits, leaf))
            z = z + leaf[node]
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for splits, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for f, edge in splits:
                node = 2 * node + (x[:, f] > edge)
            z += leaf[node]
        return 1 / (1 + np.exp(-z))


class Finder:
    """Trees and the threshold of each kind, beyond 1 for kinds in which the look-alikes cannot be told apart."""

    def __init__(self) -> None:
        self.trees, self.thresholds = Trees(rounds=80, depth=4), [2.0] * len(KINDS)

    def fit(self, cuts: list[str], planted: int = PLANTED, calibration: int = CALIBRATION) -> Finder:
        """Trees from examples in one half of the cuts; of other formats in the other half, the lowest score of each kind at
        which PRECISION is still reached. All that a cut has of candidates is taken out first, so what is learned does not
        depend on how much personal data a corpus has."""
        cuts = [SECRET.sub(" ", x) for x in cuts]
        cuts = [re.sub(r"\[[A-Z]+\]", " ", redacted(x, [*base_spans(x), *candidates(x)])) for x in cuts]
        self.trees.fit(*Planter(cuts[::2], 11, 0).examples(planted))
        x, y = Planter(cuts[1::2], 12, 1).examples(calibration)
        s = self.trees.scores(x)
        for k in range(len(KINDS)):
            own = x[:, 0] == k
            order = np.argsort(-s[own], kind="stable")
            right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
            good = np.flatnonzero(right >= PRECISION)
            if len(good):
                self.thresholds[k] = max(0.5, float(s[own][order][good[-1]]))
        return self

    def added(self, text: str, base: list[Span]) -> list[Span]:
        own = [c for c in candidates(text) if self.thresholds[c[2]] <= 1 and not any(b[0] < c[1] and c[0] < b[1] for b in base)]
        if not own:
            return []
        scores = self.trees.scores(np.array([features(text, c) for c in own]))
        out: list[Span] = []
        for k in np.argsort(-scores, kind="stable"):
            c = own[k]
            if scores[k] >= self.thresholds[c[2]] and not any(o[0] < c[1] and c[0] < o[1] for o in out):
                out.append(c)
        return out


def fitted(docs: DataFrame, cuts: int = CUTS) -> Finder:
    """A finder that learned from examples planted in cuts of a bounded choice of documents, or in nothing where there are none."""
    begin = F.pmod(F.xxhash64("doc_id", F.lit("cut")), F.greatest(F.length("text") - CUT_CHARS, F.lit(1))).cast("int") + 1
    rows = bounded(docs.where(F.length("text") > 0).select("doc_id", F.substring("text", begin, F.lit(CUT_CHARS)).alias("cut")), cuts, "pii", "doc_id", "cut").collect()
    own = sorted(r.cut for r in rows)
    random.Random(5).shuffle(own)
    return Finder().fit(own)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or several that overlap, replaced by its kind in brackets."""
    out, last = [], 0
    for s, e, k in sorted(spans, key=lambda x: (x[0], -x[1], x[2])):
        if s >= last:
            out += [text[last:s], f"[{KINDS[k].upper()}]"]
        last = max(last, e)
    return "".join([*out, text[last:]])


def issued(digits: str) -> bool:
    """Whether a network issues card numbers that begin so and are so long; one in ten of any numbers passes the check digit."""
    n, two, four = len(digits), int(digits[:2]), int(digits[:4])
    return (
        (digits[0] == "4" and n in (13, 16, 19)) or (n == 16 and (51 <= two <= 55 or 2221 <= four <= 2720)) or (n == 15 and two in (34, 37)) or (n >= 16 and 3528 <= four <= 3589)
        or (n >= 14 and (two in (36, 38, 39) or 300 <= int(digits[:3]) <= 305)) or digits[0] == "6" or two in (50, 56, 57, 58)
    )


def holds_card(digits: str) -> bool:
    """Whether a number, or some of the groups in which it is written, is one that a network may have issued."""
    groups = re.split(r"[\x20-]", digits)
    for i in range(len(groups)):
        for j in range(i + 1, len(groups) + 1):
            own = "".join(groups[i:j])
            if 12 <= len(own) <= 19 and luhn(own) and issued(own):
                return True
    return False


def private(text: str) -> list[Span]:
    """The base spans that are personal data: of numbers that pass as cards, those that hold one a network may have issued."""
    return [s for s in base_spans(text) if s[2] != CARD_K or holds_card(text[s[0] : s[1]])]


def cleaned(text: str, finder: Finder) -> str:
    """The text redacted until no such span is left: what stood beside a span may have hidden another."""
    spans = private(text)
    spans += finder.added(text, base_spans(text))
    while spans:
        text = redacted(text, spans)
        spans = private(text)
    return text


def _own(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(column(docs, doc_id, "long").alias("doc_id"), column(docs, text, "string").alias("text"))


def personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", finder: Finder | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, for every row.

    Counts and digest are of the base spans, spans lists all; positions are code points, ends exclusive. Null and empty texts
    have none. Whole texts are searched, of any length. Spans that overlap a base span are not added; of those that overlap
    each other the one with the best score is, then the first. Ids are integers, or texts of integers; repeated rows are
    searched alike and other columns are not read. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    own = _own(docs, text, doc_id)
    finder = finder or fitted(own)
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            out: list[list] = [[] for _ in names[1:]]
            for x in strings(batch, 1):
                base = base_spans(x)
                more = finder.added(x, base)
                every = sorted([*base, *more], key=lambda s: (s[0], s[2], s[1])) if more else base
                row = (*(sum(s[2] == k for s in base) for k in range(4)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), len(more))
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=names)

    return own.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def without_personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", finder: Finder | None = None) -> DataFrame:
    """docs with every span in a text replaced by its kind; all rows and columns stay, n_chars follows the text.

    A number that passes as a card but that no network issues stays, so that other long numbers do.
    """
    ship(docs.sparkSession)
    finder = finder or fitted(_own(docs, text, doc_id))
    names = docs.columns
    at, size = names.index(text), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            columns = list(batch.columns)
            texts, sizes = batch.column(at).to_pylist(), columns[size].to_pylist() if size is not None else None
            for k, x in enumerate(texts):
                if x:
                    clean = cleaned(x, finder)
                    if clean != x:
                        texts[k] = clean
                        if sizes:
                            sizes[k] = len(clean)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if sizes is not None:
                columns[size] = pa.array(sizes, batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    own = docs.select(*(f"`{c}`" for c in names))
    return own.mapInArrow(run, own.schema)
