"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Learning, from labelled documents only:
1. Token features (the word, its prefixes) are counted by document and class over the training
   sample; those significantly over-represented in toxic documents are candidates, and sequential
   covering picks from them the cues that explain toxic documents not yet explained, so that words
   which only keep company with a cue are left out. A token of a toxic document that shows a cue
   is labelled 1, every other token 0: the labelled tokens.
2. A two-state chain over windows of `WINDOW` tokens is fitted to them by gradient ascent of the
   regularised conditional likelihood (numpy, forward-backward over all windows at once).
3. A logistic fit turns the largest and the summed marginal of a training document into its score.

Scoring runs the same forward-backward over whole texts: windows overlap by `MARGIN` tokens on
either side and every token's marginal is read where it has context on both sides.

The training sample is bounded: labelled documents are thinned by a hash of their id to about
`TRAIN_DOCS` (a documented limit of the classifier, not of what is scored).

Defined results: null or empty texts and texts without letters have no tokens and get the score of
no evidence; without both classes in the training rows every score is 0; labels that are null are
not used; a document labelled more than once counts once, toxic if any label says so.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_DOCS = 12_000
MAX_CUES = 4_096
PREFIXES = range(3, 8)
MIN_DOCS, MIN_ODDS, MIN_Z, CLEAN_COST = 3, 3.0, 3.0, 2.0
WINDOW, MARGIN = 64, 8
CACHE = 1 << 20
TOKEN = re.compile(r"[^\W\d_]+")
SPANS = "array<struct<start:int,end:int,text:string>>"


def features(token: str) -> list[str]:
    """The word and its proper prefixes."""
    low = token.lower()
    return [f"w:{low}", *[f"p:{low[:n]}" for n in PREFIXES if n < len(low)]]


# --- the chain -------------------------------------------------------------------------------


def forward_backward(emit: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of state 1, pair marginals summed over places, and log partition sums.

    emit: (windows, places) score of state 1 (state 0 scores 0); mask: which places exist, without
    gaps from the left; trans: 2 x 2 scores. Scaled probabilities, all windows at a time.
    """
    n, width = emit.shape
    t = np.exp(trans)
    e1 = np.exp(np.clip(emit, -30, 30))
    alpha, beta = np.empty((width, 2, n)), np.ones((width, 2, n))
    scale = np.ones((width, n))
    alpha[0, 0], alpha[0, 1] = 1.0, e1[:, 0]
    for k in range(width):
        if k:
            a0, a1 = alpha[k - 1]
            alpha[k] = np.stack([a0 * t[0, 0] + a1 * t[1, 0], (a0 * t[0, 1] + a1 * t[1, 1]) * e1[:, k]])
            alpha[k] = np.where(mask[:, k], alpha[k], alpha[k - 1])
        scale[k] = alpha[k].sum(axis=0)
        alpha[k] /= scale[k]
    pairs = np.zeros((2, 2))
    for k in range(width - 2, -1, -1):
        b0, b1 = beta[k + 1, 0], beta[k + 1, 1] * e1[:, k + 1]
        nxt = np.stack([t[0, 0] * b0 + t[0, 1] * b1, t[1, 0] * b0 + t[1, 1] * b1])
        live = mask[:, k + 1]
        joint = alpha[k][:, None, :] * t[:, :, None] * np.stack([b0, b1])[None] / np.maximum(scale[k + 1], 1e-300)
        pairs += joint[:, :, live].sum(axis=2)
        beta[k] = np.where(live, nxt / np.maximum(scale[k + 1], 1e-300), beta[k + 1])
    p = (alpha[:, 1] * beta[:, 1]).T
    return np.where(mask, p, 0.0), pairs, np.log(scale).sum(axis=0)


@dataclass
class Chain:
    """Weights of the field, and the logistic fit on top of it."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    head: tuple[float, float, float] | None = None
    _seen: dict[str, float] = field(default_factory=dict, repr=False)

    def emission(self, token: str) -> float:
        found = self._seen.get(token)
        if found is None:
            if len(self._seen) >= CACHE:
                self._seen.clear()
            found = self._seen[token] = self.bias + sum(self.weights.get(f, 0.0) for f in features(token))
        return found

    def marginals(self, docs: list[list[str]]) -> list[np.ndarray]:
        """Per document the probability of each token to be toxic."""
        sizes = np.array([len(d) for d in docs], np.int64)
        flat = np.fromiter((self.emission(t) for d in docs for t in d), np.float64, int(sizes.sum()))
        out, first = np.zeros(len(flat)), np.r_[0, np.cumsum(sizes)[:-1]]
        step = WINDOW - 2 * MARGIN
        n_win = np.maximum(1, -(-(sizes - 2 * MARGIN) // step)) * (sizes > 0)
        doc = np.repeat(np.arange(len(docs)), n_win)
        nth = np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(n_win)[:-1]], n_win)
        for at in range(0, len(doc), 4096):
            d, w = doc[at : at + 4096], nth[at : at + 4096]
            place = (w * step)[:, None] + np.arange(WINDOW)
            mask = place < sizes[d][:, None]
            index = first[d][:, None] + np.where(mask, place, 0)
            p, _, _ = forward_backward(flat[index], mask, self.trans)
            inner = np.arange(WINDOW)[None, :]
            own = mask & ((inner >= MARGIN) | (w == 0)[:, None]) & ((inner < WINDOW - MARGIN) | (w == n_win[d] - 1)[:, None])
            out[index[own]] = p[own]
        return np.split(out, np.cumsum(sizes)[:-1])

    def evidence(self, p: np.ndarray) -> tuple[float, float]:
        return (float(p.max()), float(np.log1p(p.sum()))) if len(p) else (0.0, 0.0)

    def scores(self, marginals: list[np.ndarray]) -> np.ndarray:
        if self.head is None:
            return np.zeros(len(marginals))
        x = np.array([self.evidence(p) for p in marginals]).reshape(-1, 2)
        a, b, c = self.head
        return 1.0 / (1.0 + np.exp(-np.clip(a + b * x[:, 0] + c * x[:, 1], -50, 50)))


def covering_cues(docs: list[tuple[int, list[tuple[int, list[int]]], int]], candidates: list[str]) -> list[int]:
    """Candidate numbers, best first: each explains at least MIN_DOCS toxic documents that those
    before it do not, less CLEAN_COST for every clean document that shows it."""
    toxic: list[set[int]] = [set() for _ in candidates]
    clean = np.zeros(len(candidates))
    for d, (_, shown, y) in enumerate(docs):
        for f in {f for _, fs in shown for f in fs}:
            if y:
                toxic[f].add(d)
            else:
                clean[f] += 1
    left, picked = set(range(len(candidates))), []
    while left:
        # ties: fewer other documents, then the longer feature, then its text
        best = max(left, key=lambda f: (len(toxic[f]) - CLEAN_COST * clean[f], len(candidates[f]), candidates[f]))
        if len(toxic[best]) - CLEAN_COST * clean[best] < MIN_DOCS:
            break
        picked.append(best)
        done = set(toxic[best])
        for f in left:
            toxic[f] -= done
        left.discard(best)
    return picked


def fit_chain(docs: list[tuple[int, list[tuple[int, list[int]]], int]], cues: list[str], steps: int = 150, rate: float = 0.3, l2: float = 1e-3) -> Chain:
    """docs: (number of tokens, [(place, cue numbers)] of the tokens that show cues, label)."""
    chain = Chain()
    if not docs or len({y for _, _, y in docs}) < 2:
        return chain
    weight, bias, trans = np.zeros(len(cues)), -6.0, np.array([[1.0, -1.0], [-1.0, 1.0]])
    # Windows of tokens around cues teach the weights; windows without any teach the bias.
    wins, tags, feats = [], [], []
    for n, shown, y in docs:
        by = {}
        for place, fs in shown:
            by.setdefault(place // WINDOW, []).append((place % WINDOW, fs))
        for w in sorted({*by, 0}):
            wins.append(min(WINDOW, n - w * WINDOW))
            for place, fs in by.get(w, []):
                feats += [(len(wins) - 1, place, f) for f in fs]
                if y:
                    tags.append((len(wins) - 1, place))
    keep = np.array(wins) > 0
    mask = np.arange(WINDOW)[None, :] < np.array(wins)[:, None]
    gold = np.zeros(mask.shape)
    if tags:
        gold[tuple(np.array(tags).T)] = 1.0
    f = np.array(feats, np.int64).reshape(-1, 3)
    pair_gold, total = np.zeros((2, 2)), max(1, int(mask.sum()))
    g, live = gold.astype(int), mask[:, 1:]
    np.add.at(pair_gold, (g[:, :-1][live], g[:, 1:][live]), 1)
    # Adam on the mean log-likelihood; a cue's gradient is taken per occurrence.
    theta, m, v = np.r_[weight, bias, trans.ravel()], 0.0, 0.0
    seen = np.maximum(1.0, np.bincount(f[:, 2], minlength=len(cues)))
    for k in range(1, steps + 1):
        emit = np.full(mask.shape, theta[len(cues)])
        np.add.at(emit, (f[:, 0], f[:, 1]), theta[f[:, 2]])
        p, pairs, _ = forward_backward(emit[keep], mask[keep], theta[-4:].reshape(2, 2))
        off = np.zeros(mask.shape)
        off[keep] = p
        off = np.where(mask, gold - off, 0.0)
        grad = np.r_[np.bincount(f[:, 2], off[f[:, 0], f[:, 1]], minlength=len(cues)) / seen, off.sum() / total * 50, ((pair_gold - pairs) / total).ravel()]
        grad -= l2 * np.r_[theta[: len(cues)], 0.0, theta[-4:]]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    chain.weights = {c: float(w) for c, w in zip(cues, theta)}
    chain.bias, chain.trans = float(theta[len(cues)]), theta[-4:].reshape(2, 2).copy()
    return chain


def fit_head(chain: Chain, docs: list[tuple[int, list[tuple[int, list[int]]], int]], cues: list[str], ridge: float = 1e-2) -> None:
    """Logistic regression of the label on a document's largest and summed marginal (Newton steps)."""
    if not docs or len({y for _, _, y in docs}) < 2:
        return
    emissions = []
    for n, shown, _ in docs:
        e = {place: chain.bias + sum(chain.weights[cues[f]] for f in fs) for place, fs in shown}
        emissions.append([e.get(i, chain.bias) for i in range(n)])
    numbered = Chain(bias=chain.bias, trans=chain.trans)
    numbered.emission = lambda x: x  # tokens are given by their emissions here
    x = np.array([chain.evidence(p) for p in numbered.marginals(emissions)])
    x, y = np.c_[np.ones(len(x)), x], np.array([d[2] for d in docs], float)
    b = np.zeros(3)
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -50, 50)))
        h = (x * (q * (1 - q))[:, None]).T @ x + ridge * np.eye(3)
        b = b + np.clip(np.linalg.solve(h, x.T @ (y - q) - ridge * b), -5, 5)
    chain.head = tuple(float(z) for z in b)


# --- Spark -----------------------------------------------------------------------------------


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def flush():
        rows = [(f, n, y) for y, c in seen.items() for f, n in c.items()]
        for c in seen.values():
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32())], ["feature", "n", "label"])

    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen[y].update({f for t in set(TOKEN.findall(text or "")) for f in features(t)})
            if len(seen[0]) + len(seen[1]) > CACHE:
                yield flush()
    yield flush()


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, limit: int = TRAIN_DOCS) -> DataFrame:
    """text and label of the sample: the labelled documents that `learn` (over doc_id) allows, thinned
    by a hash of the id to about `limit` where there are more."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn)
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    share = limit / max(1, known.count())
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    return docs.select("doc_id", "text").join(known, "doc_id").select("text", (F.col("label") > 0).cast("int").alias("label"))


def learn_chain(docs: DataFrame, labels: DataFrame, learn: Column, limit: int = TRAIN_DOCS) -> Chain:
    """Fit the field. The driver sees at most MAX_CUES features and, per sampled document, its length
    and the places of its cues."""
    sample = training_rows(docs, labels, learn, limit)
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return Chain()
    counts = sample.mapInArrow(_count_features, "feature string, n bigint, label int")
    counts = counts.groupBy("feature").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("n0"))
    a, b, c, d = F.col("n1") + 0.5, n[1] - F.col("n1") + 0.5, F.col("n0") + 0.5, n[0] - F.col("n0") + 0.5
    odds, se = F.log(a * d / (b * c)), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    strong = counts.where((F.col("n1") >= MIN_DOCS) & (odds >= MIN_ODDS) & (odds / se >= MIN_Z))
    cues = [r["feature"] for r in strong.orderBy((odds / se).desc(), "feature").limit(MAX_CUES).select("feature").collect()]
    number = {f: i for i, f in enumerate(cues)}

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [TOKEN.findall(t or "") for t in batch.column(0).to_pylist()]
            hits = [[(i, number[f]) for i, t in enumerate(d) for f in features(t) if f in number] for d in tokens]
            places, numbers = [[i for i, _ in h] for h in hits], [[f for _, f in h] for h in hits]
            kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[pa.array(x, k) for x, k in zip(([len(t) for t in tokens], places, numbers), kinds)], batch.column(1)], ["n", "places", "cues", "label"])

    rows = sample.mapInArrow(shown, "n int, places array<int>, cues array<int>, label int").collect()
    train = []
    for r in sorted(rows, key=lambda r: (r["label"], r["n"], r["places"], r["cues"])):
        by: dict[int, list[int]] = {}
        for place, f in zip(r["places"], r["cues"]):
            by.setdefault(place, []).append(f)
        train.append((r["n"], list(by.items()), r["label"]))
    new = {f: i for i, f in enumerate(covering_cues(train, cues))}
    cues = [cues[f] for f in new]
    train = [(n, [(place, own) for place, fs in shown if (own := [new[f] for f in fs if f in new])], y) for n, shown, y in train]
    chain = fit_chain(train, cues)
    fit_head(chain, train, cues)
    return chain


def _spans(text: str, p: np.ndarray) -> list[dict]:
    """Runs of tokens that are toxic with probability over one half, as character offsets."""
    found: list[list[int]] = []
    last = -2
    for i, m in enumerate(TOKEN.finditer(text)):
        if p[i] > 0.5:
            if last == i - 1:
                found[-1][1] = m.end()
            else:
                found.append([m.start(), m.end()])
            last = i
    return [{"start": a, "end": b, "text": text[a:b]} for a, b in found]


def scorer(chain: Chain, spans: bool):
    """A column function of the text: struct of score and, if asked for, the toxic spans."""
    kind = f"struct<score:double,spans:{SPANS}>" if spans else "struct<score:double>"

    @F.pandas_udf(kind)
    def score(texts: pd.Series) -> pd.DataFrame:
        texts = [t or "" for t in texts]
        out, found = [], []
        for at in range(0, len(texts), 256):
            part = texts[at : at + 256]
            p = chain.marginals([TOKEN.findall(t) for t in part])
            out.append(chain.scores(p))
            if spans:
                found += [_spans(t, q) if len(q) and q.max() > 0.5 else [] for t, q in zip(part, p)]
        table = {"score": np.concatenate([np.zeros(0), *out])}
        return pd.DataFrame(table | ({"spans": found} if spans else {}))

    return score


def toxicity(docs: DataFrame, chain: Chain, keep: list[Column]) -> DataFrame:
    """`keep` columns, score and spans of each document."""
    return docs.select(*keep, scorer(chain, True)("text").alias("_s")).select(*[c for c in docs.select(*keep).columns], "_s.score", "_s.spans")


def drop_toxic(docs: DataFrame, chain: Chain, threshold: float) -> DataFrame:
    """The documents that score below the threshold, all columns as they came."""
    score = scorer(chain, False)("text")["score"]
    return docs.where(score < threshold)
