"""A small causal self-attention language model in numpy, with gradients written out.

The next token is predicted in two factors: its class and the token within its class. A class is a group and a class within it, each a softmax whose logits are the sum of a direct path
from the current token (smoothed log counts, one row per input row) and of causal attention over the
window: queries, keys and values from token embeddings, a learned score per distance, HEADS heads. The token within its class follows
counts given the cluster of the current token. So every factor is a distribution and the model's
probabilities of all texts of a length sum to one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

GROUPS, IN_GROUP = 16, 16  # groups of classes, and classes in each
CLASSES, SINGLE = GROUPS * IN_GROUP, 192  # of the classes, how many hold one frequent token alone
ROWS, SHARED = 4096, 256  # input rows of frequent tokens; rows that the others share
CLUSTERS = 64
WIDTH, HEADS = 16, 2
WINDOW, STRIDE = 32, 24  # tokens that a window sees, and that it alone scores
LEARNED = ["emb", "wq", "wk", "wv", "w1", "w2", "rel"]


@dataclass
class Vocabulary:
    """What the counts of subword ids say: input row, class and share within class of each id."""

    row: np.ndarray
    cls: np.ndarray
    within: np.ndarray
    start: int  # input row before the first token

    @classmethod
    def of_counts(cls, n: np.ndarray) -> Vocabulary:
        size, ids = len(n), np.arange(len(n))
        order = np.argsort(-n, kind="stable")
        rank = np.empty(size, np.int64)
        rank[order] = ids
        row = np.where(rank < ROWS, rank, ROWS + ids % SHARED)
        own = np.minimum(rank, SINGLE)
        mass = np.cumsum(n[order[SINGLE:]] + 0.1)
        own[order[SINGLE:]] = SINGLE + np.minimum((mass / mass[-1] * (CLASSES - SINGLE)).astype(np.int64), CLASSES - SINGLE - 1)
        within = (n + 0.05) / np.bincount(own, n + 0.05, minlength=CLASSES)[own]
        return cls(row.astype(np.int32), own.astype(np.int32), within, ROWS + SHARED)

    @property
    def rows(self) -> int:
        return self.start + 1


def clusters(profile: np.ndarray, weight: np.ndarray, k: int = CLUSTERS, rounds: int = 12) -> np.ndarray:
    """Weighted k-means of the rows' next-class profiles, started from the heaviest rows."""
    x = np.sqrt(profile)
    c = x[np.argsort(-weight, kind="stable")[:k]].copy()
    for _ in range(rounds):
        near = ((c**2).sum(1)[None] - 2 * x @ c.T).argmin(1)
        hit = np.zeros((k, len(x)))
        hit[near, np.arange(len(x))] = weight
        total = hit.sum(1, keepdims=True)
        c = np.where(total > 0, hit @ x / np.maximum(total, 1e-9), c)
    return near


@dataclass
class Model:
    """Tables from counts and learned attention weights."""

    vocabulary: Vocabulary
    group: np.ndarray  # rows x groups: log probabilities
    direct: np.ndarray  # groups x rows x classes of the group: log probabilities within the group
    cluster: np.ndarray  # row -> cluster
    within: np.ndarray  # clusters x ids: log10 share of the id within its class
    weights: dict[str, np.ndarray]

    @classmethod
    def of_counts(cls, v: Vocabulary, n: np.ndarray, pairs: np.ndarray) -> Model:
        """pairs: counts of (current row, class of the next token)."""
        prior = np.bincount(v.cls, n + 0.05, minlength=CLASSES)
        prior /= prior.sum()
        p = (pairs + 20.0 * prior) / (pairs.sum(1, keepdims=True) + 20.0)
        seen = pairs.sum(1) + 1.0
        near = clusters(p, seen)
        # embeddings start as the leading directions of what tokens say about the next class
        lift = np.log(p / prior)
        _, axes = np.linalg.eigh((lift * np.sqrt(seen)[:, None]).T @ (lift * np.sqrt(seen)[:, None]))
        emb = lift @ axes[:, -WIDTH:]
        emb /= np.sqrt((emb**2 * seen[:, None]).sum(0) / seen.sum()) + 1e-9
        rng = np.random.default_rng(7)
        eye = lambda: np.eye(WIDTH) + rng.normal(0, 0.1, (WIDTH, WIDTH))
        rel = np.zeros((HEADS, WINDOW))
        for h in range(HEADS):  # heads start out looking 1, 2, .. tokens back more than elsewhere
            rel[h, h + 1] = 2.0
        weights = {"emb": emb, "wq": 0.1 * eye(), "wk": 0.1 * eye(), "wv": eye(), "w1": np.zeros((WIDTH, GROUPS)), "w2": np.zeros((GROUPS, WIDTH, IN_GROUP)), "rel": rel}
        split = p.reshape(len(p), GROUPS, IN_GROUP)
        total = split.sum(axis=2)
        direct = np.log(split / total[:, :, None]).transpose(1, 0, 2)
        f32 = lambda x: np.ascontiguousarray(x, np.float32)
        return cls(v, f32(np.log(total)), f32(direct), near, np.log10(v.within)[None], {k: f32(w) for k, w in weights.items()})

    def folded(self) -> Model:
        """The same model for scoring, with queries, keys and values worked out for every input row."""
        w = self.weights
        rows = {"rows": w["emb"] @ _projections(w)}
        return Model(self.vocabulary, self.group, self.direct, self.cluster, self.within, w | rows)

    def with_clusters(self, counts: np.ndarray) -> None:
        """counts: (cluster of the current token, id of the next), smoothed by the share over all."""
        v, out = self.vocabulary, np.empty(counts.shape, np.float32)
        for k, row in enumerate(counts):
            total = np.bincount(v.cls, row, minlength=CLASSES)
            out[k] = np.log10((row + 5.0 * v.within) / (total[v.cls] + 5.0))
        self.within = out


_BACK = np.maximum(np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :], 0)
_AHEAD = np.triu(np.full((WINDOW, WINDOW), -1e4, np.float32), 1)
_AT = np.eye(WINDOW, dtype=np.float32)[_BACK]
_HEAD = WIDTH // HEADS
_OF = np.repeat(np.eye(HEADS, dtype=np.float32), _HEAD, axis=0)  # which head a column belongs to
_CELLS = np.arange((ROWS + SHARED + 1) * WIDTH).reshape(-1, WIDTH)  # where a row's embedding lies
EARLY = WINDOW - STRIDE  # places that only a text's first window scores


def _projections(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w["wq"], w["wk"], w["wv"]], axis=1)


def _heads(x: np.ndarray) -> np.ndarray:
    """A view of (windows, places, WIDTH) as (windows, heads, places, columns of a head)."""
    return x.reshape(*x.shape[:2], HEADS, _HEAD).transpose(0, 2, 1, 3)


def _row_max(s: np.ndarray) -> np.ndarray:
    """max(axis=-1, keepdims=True), halving the rows: quick where they are short."""
    while (k := s.shape[-1]) > 1:
        s = np.maximum(s[..., : (k + 1) // 2], s[..., k // 2 :])
    return s


def attend(w: dict[str, np.ndarray], rows: np.ndarray, lo: int = 0):
    """Attention output (windows, places from lo on, WIDTH) and what the gradients need. A column of ones
    beside the values sums the weights up. Only where scores are far from zero, they are shifted by the
    greatest of their row before exp."""
    n, size = rows.shape
    flat, e = rows.ravel(), None
    if "rows" in w:
        qkv = w["rows"].take(flat, axis=0)
    else:
        e = w["emb"].take(flat, axis=0)
        qkv = e @ _projections(w)
    qkv = qkv.reshape(n, size, 3 * WIDTH)
    q, k = _heads(qkv[:, lo:, :WIDTH]), _heads(qkv[:, :, WIDTH : 2 * WIDTH])
    v = np.ones((n, HEADS, size, _HEAD + 1), qkv.dtype)
    v[..., :_HEAD] = _heads(qkv[:, :, 2 * WIDTH :])
    across = np.ascontiguousarray(k.transpose(0, 1, 3, 2))
    bias = w["rel"].take(_BACK[lo:size, :size], axis=1) + _AHEAD[lo:size, :size]
    for least in (1e-15, 0):  # with a shift, no sum is below 1
        s = np.matmul(q, across)
        s += bias
        if least == 0 or s.max(initial=0) > 40:
            s -= _row_max(s)
        o = np.matmul(np.exp(s, out=s), v)
        total = o[..., _HEAD:]
        if total.min(initial=1) > least:
            break
    out = np.empty((n, size - lo, WIDTH), qkv.dtype)
    np.divide(o[..., :_HEAD], total, out=_heads(out))
    return out, (e, q, k, v, s, total)


def _attend_back(w: dict[str, np.ndarray], rows: np.ndarray, lo: int, out: np.ndarray, do: np.ndarray, kept: tuple, g: dict[str, np.ndarray]) -> None:
    """Adds to g what the gradient `do` of attend's output gives."""
    e, q, k, v, s, total = kept
    n, size = rows.shape
    # with a = s / total: ds = a * (do . v - do . out), where both come from one product with v's ones
    d = np.empty((n, HEADS, size - lo, _HEAD + 1), v.dtype)
    d[..., :_HEAD] = _heads(do)
    d[..., _HEAD] = ((do * out).reshape(-1, WIDTH) @ -_OF).reshape(n, -1, HEADS).transpose(0, 2, 1)
    d /= total
    dqkv = np.empty((n, size, 3 * WIDTH), v.dtype)
    dqkv[:, :lo, :WIDTH] = 0
    dq, dk, dv = (_heads(dqkv[:, :, i * WIDTH : (i + 1) * WIDTH]) for i in range(3))
    ahead = s.transpose(0, 1, 3, 2)
    np.matmul(ahead, d[..., :_HEAD], out=dv)
    s *= np.matmul(d, np.ascontiguousarray(v.transpose(0, 1, 3, 2)))
    np.matmul(s, k, out=dq[:, :, lo:])
    np.matmul(ahead, q, out=dk)
    g["rel"] += s.sum(axis=0).reshape(HEADS, -1) @ _AT[lo:size, :size].reshape(-1, WINDOW)
    dw = np.matmul(e.reshape(n, size, WIDTH).transpose(0, 2, 1), dqkv).sum(axis=0)
    for i, name in enumerate(("wq", "wk", "wv")):
        g[name] += dw[:, i * WIDTH : (i + 1) * WIDTH]
    de = dqkv.reshape(-1, 3 * WIDTH) @ _projections(w).T
    np.add.at(g["emb"].reshape(-1), _CELLS.take(rows.ravel(), axis=0).ravel(), de.ravel())


def _parts(places: np.ndarray) -> list[tuple[np.ndarray | slice, int, int]]:
    """What must be attended to: (windows, first place that looks, end of the places looked at). Places that only
    first windows score are left to them."""
    early = np.flatnonzero(places[:, :EARLY].any(axis=1))
    return [(slice(None), EARLY, WINDOW)] + ([(early, 0, EARLY)] if len(early) else [])


@dataclass
class _Scored:
    """The scored places in order of their target's group, and their softmaxes' logits."""

    order: np.ndarray  # of the targets
    at: np.ndarray  # place in the windows laid end to end
    groups: list[tuple[int, int, int]]  # group, and where its targets begin and end
    own: np.ndarray  # where the targets stand in the logits laid end to end: groups, then classes
    base: np.ndarray  # (2 * targets, classes): direct logits

    @classmethod
    def of(cls, model: Model, rows: np.ndarray, places: np.ndarray, target: np.ndarray) -> _Scored:
        group = (target // IN_GROUP).astype(np.int16)  # 16 bits are sorted by counting
        order = np.argsort(group, kind="stable")
        group, at, m = group[order], np.flatnonzero(places)[order], len(order)
        ends = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        now, group = rows.ravel()[at], group.astype(np.int64)
        base = np.empty((2 * m, GROUPS), model.group.dtype)
        base[:m] = model.group.take(now, axis=0)
        base[m:] = model.direct.reshape(-1, IN_GROUP).take(group * len(model.group) + now, axis=0)
        own = np.arange(0, 2 * m * GROUPS, GROUPS)
        own[:m] += group
        own[m:] += target[order] % IN_GROUP
        return cls(order, at, [(g, ends[g], ends[g + 1]) for g in range(GROUPS) if ends[g] < ends[g + 1]], own, base)

    def softmaxes(self, w: dict[str, np.ndarray], o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of the logits and its sums. Shifted as in attend."""
        m = len(o)
        z = self.base.astype(o.dtype)
        z[:m] += o @ w["w1"]
        for g, a, b in self.groups:
            z[m + a : m + b] += o[a:b] @ w["w2"][g]
        for least in (1e-15, 0):
            x = np.exp(z - _row_max(z) if least == 0 or z.max(initial=0) > 40 else z)
            total = x @ np.ones(GROUPS, x.dtype)
            if total.min(initial=1) > least:
                break
        return x, total


def class_log10(model: Model, rows: np.ndarray, places: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log10 probability of the target class at the chosen (boolean) places, in their order: of its
    group, and of the class within the group."""
    w, (n, size) = model.weights, rows.shape
    out = np.empty((n, size, WIDTH), w["emb"].dtype)
    for at, lo, upto in _parts(places):
        out[at, lo:upto] = attend(w, rows[at, :upto], lo)[0]
    scored, m = _Scored.of(model, rows, places, target), len(target)
    x, total = scored.softmaxes(w, out.reshape(-1, WIDTH).take(scored.at, axis=0))
    share = x.reshape(-1).take(scored.own) / total
    p = np.empty(m, x.dtype)
    p[scored.order] = share[:m] * share[m:]
    return np.log10(np.maximum(p, np.float32(1e-30)))


def gradients(model: Model, rows: np.ndarray, places: np.ndarray, target: np.ndarray, into: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Gradient of the mean log-likelihood of the classes at the chosen places; added to `into`."""
    w, (n, size) = model.weights, rows.shape
    g = {k: np.zeros_like(w[k]) for k in LEARNED} if into is None else into
    out, parts = np.empty((n, size, WIDTH), w["emb"].dtype), []
    for at, lo, upto in _parts(places):
        got, kept = attend(w, rows[at, :upto], lo)
        out[at, lo:upto] = got
        parts.append((at, lo, upto, got, kept))
    scored, m = _Scored.of(model, rows, places, target), len(target)
    o, scale = out.reshape(-1, WIDTH).take(scored.at, axis=0), w["emb"].dtype.type(1 / max(1, m))
    p, total = scored.softmaxes(w, o)
    p *= (-scale / total)[:, None]
    p.reshape(-1)[scored.own] += scale
    g["w1"] += o.T @ p[:m]
    back = p[:m] @ w["w1"].T
    for b, at, end in scored.groups:
        g["w2"][b] += o[at:end].T @ p[m + at : m + end]
        back[at:end] += p[m + at : m + end] @ w["w2"][b].T
    do = np.zeros_like(out)
    do.reshape(-1, WIDTH)[scored.at] = back
    for at, lo, upto, got, kept in parts:
        _attend_back(w, rows[at, :upto], lo, got, do[at, lo:upto], kept, g)
    return g


class Trainer:
    """Adam on a model's learned weights, which it holds in a row."""

    def __init__(self, model: Model, rate: float, seed: int = 0):
        self.model, self.rate, self.rng, self.step = model, rate, np.random.default_rng(seed), 0
        self.flat = np.concatenate([model.weights[k].ravel() for k in LEARNED])
        self.g, self.m, self.v, self.a, self.b = (np.zeros_like(self.flat) for _ in range(5))
        self.parts, at = {}, 0
        for k in LEARNED:
            shape, size = model.weights[k].shape, model.weights[k].size
            self.parts[k] = self.g[at : at + size].reshape(shape)
            model.weights[k] = self.flat[at : at + size].reshape(shape)
            at += size

    def run(self, rows: np.ndarray, places: np.ndarray, target: np.ndarray, batch: int = 128) -> None:
        """One pass over the windows. target: the class at every place, read where places holds."""
        order = self.rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            b = np.sort(order[at : at + batch])
            chosen = places[b]
            self.g.fill(0)
            gradients(self.model, rows[b], chosen, target[b][chosen], self.parts)
            self._adam()

    def _adam(self) -> None:
        self.step += 1
        g, m, v, a, b = self.g, self.m, self.v, self.a, self.b
        m *= 0.9  # m and v are sums, 10 and 100 times the running means
        m += g
        v *= 0.99
        v += np.multiply(g, g, out=a)
        level = (1 - 0.99**self.step) ** 0.5
        np.sqrt(v, out=a)
        a += 1e-5 * level
        np.multiply(m, float(self.rate) * level / (1 - 0.9**self.step), out=b)
        self.flat += np.divide(b, a, out=b)


def windows(rows: np.ndarray, sizes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts laid end to end. Input at place t is the row of the token before it, so a
    window predicts tokens; each token is scored by one window, all but those of a text's first
    window with at least WINDOW - STRIDE tokens of context.

    Returns the input rows (windows, WINDOW), the index of the token that each place predicts, and
    which places score.
    """
    count = np.maximum(1, -(-(sizes - (WINDOW - STRIDE)) // STRIDE)) * (sizes > 0)
    text = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = (np.cumsum(sizes) - sizes)[text]
    nth, first, sizes = nth.astype(np.int32), first.astype(np.int32), sizes.astype(np.int32)
    place = nth[:, None] * np.int32(STRIDE) + np.arange(WINDOW, dtype=np.int32)[None]
    live = place < sizes[text][:, None]
    index = first[:, None] + np.where(live, place, 0)
    before = np.where(place > 0, rows[np.maximum(index - 1, 0)], start)
    own = live & ((np.arange(WINDOW)[None] >= WINDOW - STRIDE) | (nth == 0)[:, None])
    return np.where(live, before, start), index, own
