"""Toxic spans by a linear-chain conditional random field.

Tokens are words; each is inside a toxic span (state 1) or not (state 0). Documents carry labels, tokens don't: a word or
a word's beginning is taken as a mark of toxicity where training documents with it are toxic far more often than others,
and the tokens of toxic training documents are labelled by these marks. The field has weights for the word and its first
letters, and for the transitions; it is fitted on all stretches of tokens around marks by gradient ascent on the exact
conditional likelihood (forward-backward).

A text is scored whole. Tokens without any weighted feature share one emission, so stretches of them are powers of one
two-by-two matrix: forward and backward passes visit the informative tokens only and stay exact. Within a stretch the
marginals are sums of powers of that matrix's eigenvalues: their total is a geometric series, and they are evaluated one
by one only where a bound says that some may reach one half. Marginals give the offending spans, neighbouring tokens
joined; the probability that some token is toxic, the largest marginal and the expected number of toxic tokens beyond that
of plain text of the same length give the document's score through a logistic function. That function is fitted on
training documents under fields that were fitted without them, part by part.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from sys import intern
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import beside, held_out, keyed_texts, table, trim

#: Bounds of the training sample: toxic documents, clean ones for each, and characters of a document that may be in it.
SAMPLE, CLEAN_EACH, SAMPLE_CHARS = 1200, 3, 20_000
#: Lengths of word beginnings that are features.
STEMS = (4, 5, 6)
#: Tokens around a mark that make a training stretch, and tokens after which a longer stretch is cut in two.
AROUND, STRETCH = 8, 32
#: Parts of the training sample for the logistic function.
FOLDS = 2
#: Word groups of a document's sketch, the least by hash, by which near copies are told in training.
SKETCH = 24
_WORDS = re.compile(r"\w+")


def lowered(text: str) -> str:
    """The text in lower case, code point by code point: those whose lower case is longer stay, so places are the text's."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


@dataclass
class _Gap:
    """A stretch of plain tokens. The marginal of its t-th is a + b * small ** t + c * small ** (length - 1 - t) + d."""

    first: int
    length: int
    a: float
    b: float
    c: float
    d: float
    small: float

    @classmethod
    def between(cls, first: int, length: int, start: np.ndarray, end: np.ndarray, vectors: np.ndarray, inverse: np.ndarray, small: float) -> _Gap:
        """start: forward weights of the first token; end: backward weights of the last."""
        left, right = start @ vectors, inverse @ end
        far = small ** (length - 1)
        whole = left[0] * right[0] + left[1] * right[1] * far
        x, y = left * inverse[:, 1] / whole, right * vectors[1]
        return cls(first, length, float(x[0] * y[0]), float(x[1] * y[0]), float(x[0] * y[1]), float(x[1] * y[1] * far), small)

    def expected(self) -> float:
        """Sum of the marginals, by geometric series."""
        return self.length * (self.a + self.d) + (self.b + self.c) * (1 - self.small**self.length) / (1 - self.small)

    def bound(self) -> float:
        """No marginal is above it."""
        return abs(self.a) + abs(self.b) + abs(self.c) + abs(self.d)

    def edges(self) -> tuple[float, float]:
        far = self.small ** (self.length - 1)
        return self.a + self.b + self.c * far + self.d, self.a + self.b * far + self.c + self.d

    def marginals(self) -> np.ndarray:
        up = np.float64(self.small) ** np.arange(self.length)
        return self.a + self.b * up + self.c * up[::-1] + self.d


@dataclass
class Tagger:
    """The fitted field: weights of state 1 by feature, transitions, and the document's logistic function."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    moves: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    document: tuple[float, float, float, float] = (-3.0, 6.0, 0.0, 0.0)

    def emission(self, word: str) -> float | None:
        """Weight of state 1 over state 0 of a word; None without any feature (then it is the bias)."""
        w, s = self.words.get(word), self.stems
        hits = [s[p] for n in STEMS if len(word) >= n and (p := word[:n]) in s] if s else []
        if w is None and not hits:
            return None
        return self.bias + (w or 0.0) + sum(hits)

    def passes(self, emissions: dict[int, float], n: int) -> tuple[np.ndarray, float, float, list[_Gap]]:
        """(marginal of state 1 at each key of emissions in order, log P(no toxic token), expected toxic tokens, gaps) of a
        text of n tokens; gaps are the stretches of tokens without emissions of their own, whose weight is the bias."""
        move = np.exp(np.array(self.moves)).reshape(2, 2)
        plain = move * np.array([1.0, np.exp(self.bias)])
        # a gap is a power of plain, scaled by its largest eigenvalue: gap(g) = vectors @ diag(1, small ** g) @ inverse
        values, vectors = np.linalg.eig(plain)
        order = np.argsort(-np.abs(values))
        values, vectors = values[order], vectors[:, order]
        inverse, log_top, small = np.linalg.inv(vectors), float(np.log(values[0])), values[1] / values[0]

        def power(g: int) -> np.ndarray:
            return vectors * np.array([1.0, small**g]) @ inverse

        at = sorted(emissions)
        own = [np.array([1.0, np.exp(emissions[i])]) for i in at]
        lengths = (np.diff([-1, *at, n]) - 1).tolist()
        starts, forward, scale, state = [], [], 0.0, None
        for j, g in enumerate(lengths):
            starts.append(None)
            if g:
                starts[j] = np.array([1.0, np.exp(self.bias)]) if state is None else state @ plain
                state = starts[j] @ power(g - 1)
                scale += (g - 1) * log_top
            if j < len(at):
                state = own[j] if state is None else (state @ move) * own[j]
                total = state.sum()
                scale += float(np.log(total))
                state = state / total
                forward.append(state)
        log_all = scale + float(np.log(state.sum()))
        ends, backward = [np.ones(2)], []
        for j in range(len(at) - 1, -1, -1):
            back = power(lengths[j + 1]) @ ends[-1]
            backward.append(back / back.sum())
            ends.append(move @ (own[j] * backward[-1]))
        ends.reverse(), backward.reverse()
        gaps = [_Gap.between(0 if j == 0 else at[j - 1] + 1, g, starts[j], ends[j], vectors, inverse, float(small)) for j, g in enumerate(lengths) if g]
        both = np.array(forward).reshape(-1, 2) * np.array(backward).reshape(-1, 2)
        p = both[:, 1] / both.sum(axis=1)
        log_none = (n - 1) * float(np.log(move[0, 0])) - log_all
        return p, min(0.0, log_none), float(p.sum()) + sum(g.expected() for g in gaps), gaps

    def marginals(self, emissions: dict[int, float], n: int) -> tuple[np.ndarray, float, float]:
        """(marginal of state 1 at each key of emissions in order, log P(no toxic token), expected toxic tokens)."""
        return self.passes(emissions, n)[:3]

    def emissions(self, words: list[str]) -> dict[int, float]:
        """Weights of state 1 at informative tokens."""
        own, stems, out = self.words, self.stems, {}
        for i, w in enumerate(words):
            if (w in own or w[:4] in stems or w[:5] in stems or w[:6] in stems) and (e := self.emission(w)) is not None:
                out[i] = e
        return out

    def inputs(self, words: list[str]) -> tuple[dict[int, float], tuple[float, float, float]]:
        """(marginals of state 1 by token, of all tokens that may reach one half, inputs of the score): the probability
        of a toxic token, the largest marginal at and beside informative tokens, and the expected toxic tokens beyond what
        the same number of plain ones has, so that length alone doesn't count."""
        found = self.emissions(words)
        if not found:
            return {}, (0.0, 0.0, 0.0)
        p, log_none, expected, gaps = self.passes(found, len(words))
        out, most = dict(zip(sorted(found), p.tolist(), strict=True)), float(p.max())
        for gap in gaps:
            if gap.bound() >= 0.5:
                own = gap.marginals()
                out.update(zip(range(gap.first, gap.first + gap.length), own.tolist(), strict=True))
                most = max(most, float(own.max()))
            else:
                most = max(most, *gap.edges())
        plain = self.passes({}, len(words))[2]
        return out, (float(-np.expm1(log_none)), most, max(0.0, expected - plain))

    def tag(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """(score of the document, (start, end, largest marginal) of its toxic spans in code points of the text:
        neighbouring tokens that are toxic at least as likely as not)."""
        low = lowered(text)
        p, inputs = self.inputs(_WORDS.findall(low))
        toxic = {i for i, x in p.items() if x >= 0.5}
        spans: list[list] = []
        if toxic:
            for i, m in enumerate(_WORDS.finditer(low)):
                if i in toxic:
                    if i - 1 in toxic:
                        spans[-1][1:] = [m.end(), max(spans[-1][2], p[i])]
                    else:
                        spans.append([m.start(), m.end(), p[i]])
        return self.score(*inputs), [tuple(x) for x in spans]

    def score(self, some: float, most: float, expected: float) -> float:
        c, a, b, d = self.document
        return float(1 / (1 + np.exp(-(c + a * some + b * most + d * np.log1p(expected)))))


@dataclass
class _Example:
    """A training document: its words, label, words and beginnings of words that it has, and sketch."""

    words: list[str]
    label: int
    own: set[str] = field(init=False)
    stems: set[str] = field(init=False)
    sketch: list[int] = field(init=False)

    def __post_init__(self):
        d = self.words
        self.own = set(d)
        self.stems = {w[:n] for w in self.own for n in STEMS if len(w) > n}
        self.sketch = sorted({crc32(" ".join(d[i : i + 4]).encode()) for i in range(max(1, len(d) - 3))})[:SKETCH]


def _marks(toxic: list[_Example], clean: list[_Example]) -> tuple[set[str], set[str]]:
    """Words, and beginnings of words, that mark toxicity: seen in enough toxic documents, and there far more often."""

    def pick(of):
        t, c = Counter(), Counter()
        for docs, to in ((toxic, t), (clean, c)):
            for d in docs:
                to.update(of(d))
        share = len(toxic) / (len(toxic) + len(clean))
        often = {k: n for k, n in t.items() if n >= 3}
        # likelihood ratio against the same share everywhere, beyond what so many candidates reach by chance
        least = 2 * np.log(max(50, len(often)))
        out = {}
        for k, n in often.items():
            m = c[k]
            a, b = (n + 0.5) / (len(toxic) + 1), (m + 0.5) / (len(clean) + 1)
            g = 2 * (n * np.log(n / ((n + m) * share)) + (m * np.log(m / ((n + m) * (1 - share))) if m else 0.0))
            if a > 4 * b and g > least:
                out[k] = n
        return out

    words, stems = pick(lambda d: d.own), pick(lambda d: d.stems)
    return set(words), {s for s, n in stems.items() if n >= 2 * max([words.get(s, 0), 1])}


def _unlike(docs: list[_Example]) -> list[_Example]:
    """The documents without those that share many word groups with one before: copies would make any word a mark."""
    seen: set[int] = set()
    out = []
    for d in docs:
        if 4 * sum(h in seen for h in d.sketch) < len(d.sketch):
            out.append(d)
        seen.update(d.sketch)
    return out


def _sequences(docs: list[_Example], toxic: bool, marks: tuple[set[str], set[str]]) -> list[tuple[list[str], list[int]]]:
    """Stretches around all marks of the documents, joined where they meet, in pieces of STRETCH tokens; the middle of a
    document without marks."""
    words, stems = marks
    out, memo = [], {}
    for d in docs:
        for w in d.own:
            if w not in memo:
                memo[w] = w in words or any(w[:n] in stems for n in STEMS)
        known = {w for w in d.own if memo[w]}
        stretches: list[list[int]] = []
        n = len(d.words)
        for i in [i for i, w in enumerate(d.words) if w in known] if known else [n // 2] * bool(n):
            a, b = max(0, i - AROUND), min(n, i + AROUND + 1)
            if stretches and a <= stretches[-1][1]:
                stretches[-1][1] = b
            else:
                stretches.append([a, b])
        for a, b in stretches:
            for k in range(a, b, STRETCH):
                piece = d.words[k : min(b, k + STRETCH)]
                out.append((piece, [int(toxic and w in known) for w in piece]))
    return out


def fit(rows: list[tuple[str, int]], rounds: int = 60) -> Tagger:
    """The field for (text, label) rows. No rows, or rows of one label, give a tagger that scores all alike."""
    docs = [_Example(list(map(intern, _WORDS.findall(lowered(text)))), label) for text, label in dict(rows).items()]
    tagger = _field(docs, rounds)
    labels = [d.label for d in docs]
    if len(set(labels)) < 2:
        return tagger
    # parts by hash, so that the order of rows doesn't matter
    part = [crc32(" ".join(d.words).encode()) % FOLDS for d in docs]
    inputs = [(0.0, 0.0, 0.0)] * len(docs)
    for k in range(FOLDS):
        other = _field([x for x, f in zip(docs, part, strict=True) if f != k], rounds)
        for i, d in enumerate(docs):
            if part[i] == k:
                inputs[i] = other.inputs(d.words)[1]
    x = np.array([[1.0, s, m, np.log1p(e)] for s, m, e in inputs])
    y = np.array(labels, dtype=np.float64)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    theta = np.zeros(4)
    for _ in range(25):  # Newton steps of a logistic regression with a small penalty
        p = 1 / (1 + np.exp(-x @ theta))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(4)
        theta = theta + np.linalg.solve(h, x.T @ (share * (y - p)) - 0.5 * theta)
    tagger.document = tuple(float(t) for t in theta)
    return tagger


def _field(docs: list[_Example], rounds: int) -> Tagger:
    """The field without its logistic function."""
    toxic, clean = [d for d in docs if d.label], [d for d in docs if not d.label]
    tagger = Tagger()
    if not toxic or not clean:
        tagger.document = (-3.0 if not toxic else 3.0, 0.0, 0.0, 0.0)
        return tagger
    toxic, clean = _unlike(toxic), _unlike(clean)
    marks = _marks(toxic, clean)
    sequences = _sequences(toxic, True, marks) + _sequences(clean, False, marks)
    if not sequences:
        return tagger
    names = {("w", w): k for k, w in enumerate(sorted(marks[0]))}
    names.update({("s", s): len(names) + k for k, s in enumerate(sorted(marks[1]))})
    length = max(len(s) for s, _ in sequences)
    width = 1 + len(STEMS)
    none = len(names)
    ids = np.full((len(sequences), length, width), none)
    gold = np.zeros((len(sequences), length), dtype=np.int64)
    there = np.zeros((len(sequences), length), dtype=bool)
    found: dict[str, list[int]] = {}
    for r, (words, labels) in enumerate(sequences):
        for w in words:
            if w not in found:
                found[w] = [names.get(("w", w), none), *(names.get(("s", w[:n]), none) if len(w) >= n else none for n in STEMS)]
        ids[r, : len(words)] = [found[w] for w in words]
        gold[r, : len(labels)] = labels
        there[r, : len(words)] = True
    weights, bias, moves = np.zeros(none + 1), -2.0, np.zeros((2, 2))
    moment = [np.zeros_like(weights), 0.0, np.zeros_like(moves)]
    # time first, so that a step of the recursions is over contiguous columns; few tokens have a feature at all
    ids, gold, there = ids.transpose(1, 0, 2), np.ascontiguousarray(gold.T), np.ascontiguousarray(there.T)
    informative = np.flatnonzero((ids != none).any(axis=2))
    ids = ids.reshape(-1, width)[informative]
    pairs = [[int(((gold[:-1] == a) & (gold[1:] == b) & there[1:]).sum()) for b in (0, 1)] for a in (0, 1)]
    for _ in range(rounds):
        emit = np.full(there.size, bias)
        emit[informative] += weights[ids].sum(axis=1)
        up = np.exp(emit).reshape(there.shape)  # of state 1; of state 0 it is 1
        step = np.exp(moves)
        # forward and backward over all stretches side by side, each vector scaled to a sum of 1
        fwd, back = np.empty((2, *there.shape)), np.full((2, *there.shape), 0.5)
        fwd[0, 0], fwd[1, 0] = 1 / (1 + up[0]), up[0] / (1 + up[0])
        for i in range(1, length):
            x = step[0, 0] * fwd[0, i - 1] + step[1, 0] * fwd[1, i - 1]
            y = (step[0, 1] * fwd[0, i - 1] + step[1, 1] * fwd[1, i - 1]) * up[i]
            fwd[0, i], fwd[1, i] = x / (x + y), y / (x + y)
        for i in range(length - 2, -1, -1):
            y = up[i + 1] * back[1, i + 1]
            x0, x1 = step[0, 0] * back[0, i + 1] + step[0, 1] * y, step[1, 0] * back[0, i + 1] + step[1, 1] * y
            on = there[i + 1]
            back[0, i], back[1, i] = np.where(on, x0 / (x0 + x1), 0.5), np.where(on, x1 / (x0 + x1), 0.5)
        both = fwd * back
        miss = (gold - both[1] / both.sum(axis=0)) * there
        g_w = np.bincount(ids.ravel(), weights=np.repeat(miss.ravel()[informative], width), minlength=none + 1)
        g_w[none] = 0
        q = [[fwd[a, :-1] * step[a, b] * (up[1:] if b else 1.0) * back[b, 1:] for b in (0, 1)] for a in (0, 1)]
        whole = q[0][0] + q[0][1] + q[1][0] + q[1][1]
        g_m = np.array([[pairs[a][b] - (q[a][b] / whole)[there[1:]].sum() for b in (0, 1)] for a in (0, 1)])
        grads = (g_w - 0.05 * weights, miss.sum() - 0.05 * bias, g_m - 0.5 * moves)
        steps = []
        for k, g in enumerate(grads):
            moment[k] = moment[k] + g * g
            steps.append(0.5 * g / (np.sqrt(moment[k]) + 1e-8))
        weights, bias, moves = weights + steps[0], bias + steps[1], moves + steps[2]
        moves -= moves[0, 0]
    tagger.words = {k: float(weights[i]) for (kind, k), i in names.items() if kind == "w" and abs(weights[i]) > 1e-3}
    tagger.stems = {k: float(weights[i]) for (kind, k), i in names.items() if kind == "s" and abs(weights[i]) > 1e-3}
    tagger.bias, tagger.moves = float(bias), tuple(float(x) for x in moves.ravel())
    return tagger


def training_rows(documents: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """A bounded sample of labelled documents that aren't held out: at most sample of label 1 and
    CLEAN_EACH times as many of label 0, the first by a hash of the id, of at most chars characters each. A document with both labels has label 1.
    Labels are picked before texts are read."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = None
    for value in (1, 0):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample if value else CLEAN_EACH * sample)
        picked = part if picked is None else picked.unionByName(part)
    # at most four times sample rows of a number each
    texts = keyed_texts(documents).where(F.length("text") <= chars).join(F.broadcast(picked), "doc_id")
    return sorted((r["text"], int(r["label"])) for r in texts.select("text", "label").collect())


def toxicity(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every row, and with keep row, the whole row as a struct. spans:
    (start, end, marginal) of neighbouring tokens at least as likely toxic as not, in code points of the text.

    A null text is empty and scores as a text without toxic words. Null ids count as not held out and are never
    trained on; repeated rows keep their number; other columns are ignored. Without labels all score alike.
    """
    tagger = fit(training_rows(documents, labels, sample=sample))
    trim()

    def tag(texts):
        out = [tagger.tag(t) for t in texts]
        return [s for s, _ in out], [[{"start": a, "end": b, "marginal": p} for a, b, p in x] for _, x in out]

    scored = beside(documents, "score double, spans array<struct<start:int,end:int,marginal:double>>", tag)
    scored = scored.withColumn("doc_id", F.col("row")[documents.select(documents["doc_id"]).columns[0]].cast("long"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans", *["row"] * keep)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
