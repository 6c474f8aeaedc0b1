"""Toxicity: a linear-chain conditional random field over words tags toxic spans.

Token labels come from document labels: in a toxic training document, the words that mark
toxic documents in the training sample are labelled toxic, every other token clean. The CRF
(two states; word, prefix and suffix features, transitions, start weight) is fitted by gradient
ascent on the forward-backward expectations. Documents are scored in parallel from their
texts alone: forward-backward marginals give the expected number of toxic words and the
largest marginal, and a logistic link fitted on the training sample turns both into a score.

The fit uses at most ``per_class`` labelled documents of either class, of at most
``max_chars`` characters each; everything else covers all rows and whole texts.

Defined results: a null text counts as empty; an empty text has no words and gets the score
of a document without evidence. Repeated rows are scored alike. Without labels, or with one
class only, every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import fresh

PER_CLASS, MAX_CHARS, STEPS, THRESHOLD, SPAN_AT = 1200, 20_000, 50, 0.3, 0.5
MIN_DOCS, MIN_SHARE, MIN_RATIO = 3, 0.02, 12.0
CACHE = 150_000
#: Characters of the texts that a task scores at once.
AT_ONCE = 1_000_000
#: Steps of a chain that are worked on at once.
STEPS_AT_ONCE = 1 << 18
STRIP = ".,;:!?*#%$&|\"'()[]{}<>"


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 4, is 2: never used for learning."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def fold(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(STRIP)


#: Lengths of proper prefixes that are features.
PREFIXES = (5, 7)


def features(word: str) -> list[str]:
    """The word, its proper prefixes and its suffix; each has one kind of weight."""
    return ["w:" + word, *(f"p:{word[:k]}" if len(word) > k else "" for k in PREFIXES), "s:" + word[-3:]]


@dataclass
class Model:
    weight: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    trans: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    start: float = 0.0
    link: tuple[float, float, float] = (0.0, 0.0, 0.0)
    prior: float = 0.0
    fitted: bool = False

    def emit(self, token: bytes) -> float:
        return self.bias + sum(self.weight.get(f, 0.0) for f in features(fold(token)))


class Emissions(dict):
    """Word -> log-odds of the toxic state, computed once per distinct word; emptied when full."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, token: bytes) -> float:
        if len(self) >= CACHE:
            self.clear()
        out = self[token] = self.model.emit(token)
        return out


def _scan(n: int, part):
    """r[t] = (n0[t] + n1[t] r[t-1]) / (d0[t] + d1[t] r[t-1]) for all t < n, from r[-1] = 1; part(a, b): n0, n1, d0, d1 of a <= t < b.

    The chain is cut into rows: products of 2 x 2 steps give each row's entry value, then all
    rows advance together. Rows are taken for about STEPS_AT_ONCE steps at a time, so that only what goes in and comes out is as long as the chain.
    """
    cols = max(1, int(np.sqrt(n / 8)))
    some = max(1, STEPS_AT_ONCE // cols) * cols
    out, r = np.empty(n), 1.0
    for at in range(0, n, some):
        end = min(at + some, n)
        rows = -(-(end - at) // cols)
        pad = rows * cols - (end - at)
        n0, n1, d0, d1 = (np.concatenate([x, np.full(pad, v)]).reshape(rows, cols).T.copy() for x, v in zip(part(at, end), (0.0, 1.0, 1.0, 0.0), strict=True))
        a, b, c, d = np.zeros(rows), np.ones(rows), np.ones(rows), np.zeros(rows)  # r -> (a + b r) / (c + d r)
        for k in range(cols):
            a, b, c, d = n0[k] * c + n1[k] * a, n0[k] * d + n1[k] * b, d0[k] * c + d1[k] * a, d0[k] * d + d1[k] * b
            m = np.maximum(np.maximum(a, b), np.maximum(c, d))
            a, b, c, d = a / m, b / m, c / m, d / m
        now = np.empty(rows)
        for i, (x, y, z, w) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)):
            now[i] = r
            r = min(max((x + y * r) / max(z + w * r, 1e-300), 1e-30), 1e30)
        own = np.empty((cols, rows))
        for k in range(cols):
            now = np.clip((n0[k] + n1[k] * now) / np.maximum(d0[k] + d1[k] * now, 1e-300), 1e-30, 1e30)
            own[k] = now
        out[at:end] = own.T.reshape(-1)[: end - at]
    return out


def ratios(e: np.ndarray, first: np.ndarray, last: np.ndarray, trans, start: float):
    """Forward and backward odds of the toxic state over concatenated documents; also exp(e)."""
    n, x = len(e), np.exp(np.clip(e, -30, 30))
    a00, a01, a10, a11 = (float(np.exp(v)) for v in trans)
    s = float(np.exp(start))

    def forward(a, b):
        own, new = x[a:b], first[a:b]
        return np.where(new, own * s, own * a01), np.where(new, 0.0, own * a11), np.where(new, 1.0, a00), np.where(new, 0.0, a10)

    def backward(a, b):
        own, end = np.append(x[n - b + 1 : n - a + 1], 1.0)[: b - a][::-1], last[n - b : n - a][::-1]
        return np.where(end, 1.0, a10), np.where(end, 0.0, a11 * own), np.where(end, 1.0, a00), np.where(end, 0.0, a01 * own)

    return _scan(n, forward), _scan(n, backward)[::-1].copy(), x


def marginals(e, first, last, trans, start):
    fwd, bwd, _ = ratios(e, first, last, trans, start)
    o = fwd * bwd
    return o / (1 + o)


def _ends(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, last = np.zeros(lengths.sum(), bool), np.zeros(lengths.sum(), bool)
    at = np.cumsum(lengths[lengths > 0])
    last[at - 1] = True
    first[0 if len(first) else slice(0)] = True
    first[at[:-1]] = True
    return first, last


def fit(texts: list[str], toxic: list[int], prior: float) -> Model:
    """Fits the CRF and the link on a bounded sample; prior: share of toxic labels in all training labels."""
    y = np.array(toxic, int)
    if not len(y) or y.min() == y.max():
        return Model(prior=prior)
    number: dict[str, int] = {}
    once: dict[bytes, int] = {}
    for t in texts:
        for w in words(t):
            if w not in once:
                once[w] = number.setdefault(fold(w), len(number))
    # A word is kept once; a document is the numbers of its words.
    coded = [np.array([once[w] for w in words(t)], np.int32) for t in texts]
    known = [features(w) for w in number]
    empty = number.get("", -1)
    del once, number
    seen = (Counter(), Counter())
    for ws, k in zip(coded, y, strict=True):
        seen[k].update({f for w in set(ws.tolist()) - {empty} for f in known[w]})
    nt, nc = int(y.sum()), int(len(y) - y.sum())
    cue = {f for f, n in seen[1].items() if f[:2] in ("w:", "p:") and n >= max(MIN_DOCS, MIN_SHARE * nt) and (n / nt) / ((seen[0][f] + 0.5) / nc) >= MIN_RATIO}
    used = sorted(f for f in {*seen[0], *seen[1]} - {""} if seen[0][f] + seen[1][f] >= MIN_DOCS)
    at, none = {f: i for i, f in enumerate(used)}, len(used)
    lengths = np.array([len(ws) for ws in coded])
    if not lengths.sum():
        return Model(prior=prior)
    ids = np.array([[at.get(f, none) for f in fs] for fs in known]).T
    marks = np.array([not cue.isdisjoint(fs) for fs in known])
    code = np.concatenate(coded)
    gold = marks[code] & np.repeat(y == 1, lengths)
    first, last = _ends(lengths)
    del coded, known, seen, cue, used
    size = [none + 1, 1, 4, 1]
    theta = np.zeros(sum(size))
    theta[none + 1] = -4.0
    cut = np.cumsum(size)[:-1]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    keep = np.ones_like(theta)
    keep[none] = 0.0  # features outside the sample have no weight
    pair = ~first
    truth = np.bincount(gold[:-1][pair[1:]] * 2 + gold[1:][pair[1:]], minlength=4)
    emitted = lambda w, b: w[ids].sum(0)[code] + b[0]
    for step in range(1, STEPS + 1):
        w, b, tr, st = np.split(theta, cut)
        fwd, bwd, x = ratios(emitted(w, b), first, last, tr, st[0])
        diff = fwd * bwd
        diff /= 1 + diff
        np.subtract(gold, diff, out=diff)
        x, bwd, fwd = x[pair], bwd[pair], fwd[:-1][pair[1:]]
        ex = np.exp(tr)
        xi = (lambda: np.full(len(x), ex[0]), lambda: ex[1] * x * bwd, lambda: fwd * ex[2], lambda: fwd * ex[3] * x * bwd)
        every = sum(f() for f in xi)
        met = np.array([(f() / every).sum() for f in xi])
        grad = np.concatenate([sum(np.bincount(row[code], diff, size[0]) for row in ids), [diff.sum()], truth - met, [diff[first].sum()]])
        grad = (grad - 0.05 * theta) * keep
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w, b, tr, st = np.split(theta, cut)
    model = Model({f: round(float(w[i]), 5) for f, i in at.items() if abs(w[i]) > 1e-4}, float(b[0]), tuple(map(float, tr)), float(st[0]), prior=prior, fitted=True)
    p = marginals(emitted(w, b), first, last, tr, st[0])
    feats = np.array([evidence(q) for q in np.split(p, np.cumsum(lengths)[:-1])])
    weight = np.where(y == 1, prior / nt, (1 - prior) / nc) * len(y)
    model.link = _logistic(feats, y, weight)
    return model


def evidence(p: np.ndarray) -> tuple[float, float]:
    return (float(p.max()), float(np.log1p(p.sum()))) if len(p) else (0.0, 0.0)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.5, 0.5])
        b = b + np.linalg.solve(h, x.T @ (weight * (y - p)) - np.array([0, 0.5, 0.5]) * b)
    return tuple(map(float, b))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    """Fits on at most per_class documents of either class that are not held out."""
    truth = labels.select("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    seen = truth.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("t")).first()
    prior = seen.t / seen.n if seen.n else 0.0
    picked = None
    for k in (0, 1):
        part = truth.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.union(part)
    # At most 2 * per_class ids: a bounded side.
    rows = docs.select("doc_id", "text").filter(F.length("text") <= max_chars).join(F.broadcast(picked), "doc_id").orderBy("doc_id", F.xxhash64("text"), "text").limit(4 * per_class).collect()
    once = {(r.text, int(r.toxic)) for r in rows}  # copies would make their own words look like cues
    texts, toxic = zip(*sorted(once), strict=True) if once else ((), ())
    del rows, once
    model = fit(list(texts), list(toxic), prior)
    fresh()  # the driver goes on with what the fit needed
    return model


def spans(text: str, p: np.ndarray) -> str:
    """Runs of words whose marginal is SPAN_AT or more, as start:end in code points, comma-joined."""
    import re

    out, run = [], None
    for k, x in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text)):
        if p[k] >= SPAN_AT:
            run = (run[0] if run else x.start(), x.end())
        elif run:
            out.append(run)
            run = None
    return ",".join(f"{a}:{b}" for a, b in out + [run] * bool(run))


class Scorer:
    """Scores batches of texts with one model; lives as long as a task."""

    def __init__(self, model: Model):
        self.model, self.emissions = model, Emissions(model)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Scores, expected toxic words and toxic spans; AT_ONCE characters (one text at least) at a time."""
        found, at, n = [], 0, 0
        for k, t in enumerate(texts):
            if k > at and n + len(t) > AT_ONCE:
                found.append(self._some(texts[at:k]))
                at, n = k, 0
            n += len(t)
        found.append(self._some(texts[at:]))
        scores, expected, tags = zip(*found, strict=True)
        return np.concatenate(scores), np.concatenate(expected), sum(tags, [])

    def _some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        model = self.model
        scores, tags, expected = np.full(len(texts), model.prior), [""] * len(texts), np.zeros(len(texts))
        if not model.fitted or not texts:
            return scores, expected, tags
        tokens = [words(t) for t in texts]
        lengths = np.array([len(t) for t in tokens])
        get, e = self.emissions.__getitem__, np.empty(lengths.sum())
        at = np.concatenate([[0], np.cumsum(lengths)]).astype(int)
        for k, ts in enumerate(tokens):
            e[at[k] : at[k + 1]] = list(map(get, ts))
        p = marginals(e, *_ends(lengths), model.trans, model.start) if len(e) else e
        feats = np.array([evidence(p[at[k] : at[k + 1]]) for k in range(len(texts))]).reshape(-1, 2)
        scores = 1 / (1 + np.exp(-(model.link[0] + feats @ np.array(model.link[1:]))))
        for k in np.flatnonzero(feats[:, 0] >= SPAN_AT):
            tags[k] = spans(texts[k], p[at[k] : at[k + 1]])
        return scores, np.expm1(feats[:, 1]), tags


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, n_toxic (expected toxic words), spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            scores, expected, tags = scorer(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": scores, "n_toxic": expected, "spans": tags})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, n_toxic double, spans string")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_toxic", "spans")


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that score below the threshold; a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            yield batch.filter(pa.array(scorer(texts)[0] < THRESHOLD, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
