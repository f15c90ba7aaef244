"""Boosted regression trees by histograms, for all cross-validation folds at once.

Features are cut into at most BINS bins, missing values have a bin of their own, and a split sends
them to the side where they help more. Trees grow leaf by leaf (largest gain first) up to LEAVES
leaves, for squared loss: a leaf adds STEP times the mean of what is still missing to the target.

Rows with equal fold and bins behave alike in every tree, so they are added up first, as a count and
a sum: cells. A fold's model learns from the cells of all other folds.

* Up to CELLS different bin vectors (a few discrete features never have more, however many rows),
  each fold's trees are grown by one task from these sums.
* Beyond that, cells stay distributed: one job a level serves all folds and brings back only sums by
  (fold, leaf, feature, bin); after every few trees the cells are written with their predictions.

Both ways grow the same trees. The driver holds the trees: folds x iterations x at most 61 nodes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from evalgrid.session import cut_lineage

# Rounds, learning rate, leaves of a tree, bins of a feature, rows of the smallest leaf.
ITERATIONS, STEP, LEAVES, BINS, LEAF_ROWS = 300, 0.05, 31, 255, 20
CELLS = 1 << 17
WRITE_EVERY = 10


@dataclass(frozen=True)
class Rules:
    iterations: int = ITERATIONS
    step: float = STEP
    leaves: int = LEAVES
    leaf_rows: int = LEAF_ROWS


# ---- bins ------------------------------------------------------------------------------------


def bin_edges(df: DataFrame, features: Sequence[str]) -> list[list[float]]:
    """Upper ends of each feature's bins but the last: between all its values if they are at most
    BINS, else at its quantiles. Missing values are not looked at."""
    edges = []
    for f in features:
        v = df.select(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias("v")).where("v is not null")
        some = sorted(r["v"] for r in v.distinct().limit(BINS + 1).collect())
        if len(some) > BINS:
            cuts = v.agg(F.percentile_approx("v", [i / BINS for i in range(1, BINS)], 10_000)).first()[0]
            edges.append(sorted(set(cuts)))
        else:
            edges.append([(a + b) / 2 for a, b in zip(some, some[1:])])
    return edges


def codes(features: Sequence[str], edges: Sequence[Sequence[float]]) -> Column:
    """Array of bin numbers: 0 .. len(edges), and len(edges) + 1 for a missing value."""

    def code(f: str, ends: Sequence[float]) -> Column:
        v = F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))
        cuts = F.array(*[F.lit(float(e)) for e in ends]).cast("array<double>")
        return F.when(v.isNull(), F.lit(len(ends) + 1)).otherwise(F.size(F.filter(cuts, lambda e: e < v)))

    return F.array(*[code(f, e) for f, e in zip(features, edges)])


# ---- one tree --------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes in arrays; node 0 is the root, a leaf has feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def add(self) -> int:
        for name, v in (("feature", -1), ("cut", 0), ("missing_left", False), ("left", 0), ("right", 0), ("value", 0.0)):
            getattr(self, name).append(v)
        return len(self.feature) - 1

    def route(self, code: np.ndarray, missing: np.ndarray, at: np.ndarray) -> None:
        """Moves rows on from the nodes in `at` to the leaves below them."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        to_left, rows = np.array(self.missing_left), np.flatnonzero(feature[at] >= 0)
        while len(rows):
            node = at[rows]
            f = feature[node]
            c = code[rows, f]
            node = np.where(np.where(c == missing[f], to_left[node], c <= cut[node]), left[node], right[node])
            at[rows] = node
            rows = rows[feature[node] >= 0]

    def predict(self, code: np.ndarray, missing: np.ndarray) -> np.ndarray:
        at = np.zeros(len(code), np.int64)
        self.route(code, missing, at)
        return np.array(self.value)[at]


def histograms(code: np.ndarray, leaf: np.ndarray, g: np.ndarray, n: np.ndarray, leaves: int, width: int) -> np.ndarray:
    """(leaf, feature, bin, [sum of g, sum of n]); rows with leaf -1 are left out."""
    use = leaf >= 0
    code, base, g, n = code[use], leaf[use] * width, g[use], n[use]
    out = np.empty((leaves, code.shape[1], width, 2))
    for f in range(code.shape[1]):
        at = base + code[:, f]
        out[:, f, :, 0] = np.bincount(at, g, leaves * width).reshape(leaves, width)
        out[:, f, :, 1] = np.bincount(at, n, leaves * width).reshape(leaves, width)
    return out


def best_splits(h: np.ndarray, missing: np.ndarray, leaf_rows: int) -> list[tuple[float, int, int, bool, float, float] | None]:
    """(gain, feature, cut, missing left, and the left side's sums) of the best split of each node, from
    its histograms (node, feature, bin, 2). Equal gains: the first feature, the lowest cut, missing
    right. A feature that the node never misses sends missing values to the larger side."""
    nodes = np.arange(len(h))
    best = np.full(len(h), -np.inf)
    out = [np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), bool), np.zeros(len(h)), np.zeros(len(h))]
    for f, m in enumerate(missing.tolist()):
        gone = h[:, f, m]
        run = np.cumsum(h[:, f, :m], axis=1)
        g, n = run[:, -1, 0] + gone[:, 0], run[:, -1, 1] + gone[:, 1]
        for side in (False, True):
            left = run + gone[:, None] if side else run
            gl, nl = left[..., 0], left[..., 1]
            gr, nr = g[:, None] - gl, n[:, None] - nl
            ok = (nl >= leaf_rows) & (nr >= leaf_rows)
            if side:
                ok &= gone[:, 1:] > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, gl * gl / nl + gr * gr / nr - (g * g / n)[:, None], -np.inf)
            top = gain.max(axis=1)
            c = np.argmax(gain >= (top - 1e-10 * np.where(np.isfinite(top), np.abs(top), 0))[:, None], axis=1)
            wins = np.isfinite(top) & ((best == -np.inf) | (top > best + 1e-10 * np.abs(np.where(np.isfinite(best), best, 0))))
            goes = np.where(gone[:, 1] > 0, side, 2 * nl[nodes, c] > n)
            best = np.where(wins, top, best)
            out = [np.where(wins, x, o) for x, o in zip((f, c, goes, gl[nodes, c], nl[nodes, c]), out)]
    return [(b, *x) if b > 1e-12 else None for b, *x in zip(best.tolist(), *[o.tolist() for o in out])]


class Growing:
    """A tree that asks for histograms of its nodes until the best-first tree is known. All nodes that
    may be split are asked for at once, so the number of rounds is the tree's depth."""

    def __init__(self, missing: np.ndarray, rules: Rules):
        self.tree, self.missing, self.rules = Tree(), missing, rules
        self.split: dict[int, tuple | None] = {}
        self.sums: dict[int, tuple[float, float]] = {}
        self.taken: list[int] = []

    def learn(self, nodes: list[int], h: np.ndarray) -> None:
        if nodes == [0]:
            self.sums[0] = tuple(h[0, 0, : self.missing[0] + 1].sum(axis=0).tolist())
        self.split.update(zip(nodes, best_splits(h, self.missing, self.rules.leaf_rows)))

    def wanted(self) -> list[int]:
        """Nodes whose histogram is needed now. None: `taken` is final."""
        if 0 not in self.split:
            return [0]
        t, self.taken, unknown, most = self.tree, [], [], self.rules.leaves - 1
        heap = [(-self.split[0][0], 0)] if self.split[0] else []
        while heap and len(self.taken) < most:
            _, node = heapq.heappop(heap)
            self.taken.append(node)
            if t.feature[node] < 0:
                _, f, cut, side, gl, nl = self.split[node]
                a, b = t.add(), t.add()
                t.feature[node], t.cut[node], t.missing_left[node], t.left[node], t.right[node] = f, cut, side, a, b
                g, n = self.sums[node]
                self.sums[a], self.sums[b] = (gl, nl), (g - gl, n - nl)
            for child in (t.left[node], t.right[node]):
                if child not in self.split:
                    unknown.append(child)
                elif self.split[child]:
                    heapq.heappush(heap, (-self.split[child][0], child))
        # no split is left for the children of the last node
        return [] if len(self.taken) == most and set(unknown) <= {t.left[self.taken[-1]], t.right[self.taken[-1]]} else unknown

    def finished(self) -> tuple[Tree, np.ndarray]:
        """The tree with only the splits that were taken, numbered anew, and the value that each node
        of the grown tree adds (below a leaf, the leaf's)."""
        taken, out, t = set(self.taken), Tree(), self.tree
        values, todo = np.zeros(len(t.feature)), [(0, 0)]
        while todo:
            old, new = todo.pop()
            if old in taken:
                a, b = out.add(), out.add()
                out.feature[new], out.cut[new], out.missing_left[new], out.left[new], out.right[new] = t.feature[old], t.cut[old], t.missing_left[old], a, b
                todo += [(t.left[old], a), (t.right[old], b)]
            else:
                g, n = self.sums[old]
                out.value[new] = -self.rules.step * g / n if n else 0.0
                below = [old]
                while below:
                    k = below.pop()
                    values[k] = out.value[new]
                    below += [t.left[k], t.right[k]] if t.feature[k] >= 0 else []
        return out, values


# ---- all folds -------------------------------------------------------------------------------


@dataclass
class Boosted:
    """Bin edges, and for each fold its first prediction and its trees."""

    features: list[str]
    edges: list[list[float]]
    start: dict[int, float]
    trees: dict[int, list[Tree]]

    @property
    def missing(self) -> np.ndarray:
        return np.array([len(e) + 1 for e in self.edges])

    def forest(self, fold: int) -> tuple[np.ndarray, ...]:
        """The fold's trees as arrays (tree, node); leaves lead to themselves."""
        trees = self.trees[fold]
        size = max((len(t.feature) for t in trees), default=1)
        pad = lambda name, kind: np.array([getattr(t, name) + [0] * (size - len(t.feature)) for t in trees], kind).reshape(-1, size)
        feature, left, right = pad("feature", np.int16), pad("left", np.int16), pad("right", np.int16)
        leaf, own = feature < 0, np.arange(size, dtype=np.int16)
        return np.where(leaf, 0, feature), pad("cut", np.int32), pad("missing_left", bool), np.where(leaf, own, left), np.where(leaf, own, right), pad("value", float)

    def predict(self, fold: int, code: np.ndarray, chunk: int = 2048) -> np.ndarray:
        feature, cut, to_left, left, right, value = self.forest(fold)
        out, tree, missing = np.full(len(code), self.start[fold]), np.arange(len(feature))[:, None], self.missing
        for a in range(0, len(code), chunk):
            part = code[a : a + chunk]
            at, row = np.zeros((len(feature), len(part)), np.int16), np.arange(len(part))[None]
            while True:
                f = feature[tree, at]
                c = part[row, f]
                to = np.where(np.where(c == missing[f], to_left[tree, at], c <= cut[tree, at]), left[tree, at], right[tree, at])
                if (to == at).all():
                    break
                at = to
            out[a : a + chunk] += value[tree, at].sum(axis=0)
        return out


def _grow_here(code: np.ndarray, n: np.ndarray, y: np.ndarray, missing: np.ndarray, rules: Rules) -> tuple[float, list[Tree]]:
    """A model from bin vectors with their counts and sums of the target, in memory."""
    start, width, trees = float(y.sum() / n.sum()), int(missing.max()) + 1, []
    p = np.full(len(code), start)
    for _ in range(rules.iterations):
        growing, g, at = Growing(missing, rules), n * p - y, np.zeros(len(code), np.int64)
        while nodes := growing.wanted():
            growing.tree.route(code, missing, at)
            number = np.full(len(growing.tree.feature), -1)
            number[nodes] = np.arange(len(nodes))
            growing.learn(nodes, histograms(code, number[at], g, n, len(nodes), width))
        tree, values = growing.finished()
        trees.append(tree)
        growing.tree.route(code, missing, at)
        p += values[at]
    return start, trees


def _by_fold(cells: DataFrame, folds: list[int], missing: np.ndarray, rules: Rules) -> tuple[dict, dict]:
    """One task a fold: all bin vectors with their sums over all folds and over the own one."""
    named = cells.groupBy("code").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).select(F.explode(F.array(*[F.lit(f) for f in folds])).alias("_model"), "code", "n", "y")
    own = cells.select(F.col("fold").alias("_model"), "code", (-F.col("n")).alias("n"), (-F.col("y")).alias("y"))
    rest = named.unionByName(own).groupBy("_model", "code").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).where("n > 0")
    tree = "struct<feature:array<int>,cut:array<int>,missing_left:array<boolean>,left:array<int>,right:array<int>,value:array<double>>"

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        code = np.array(table["code"].to_pylist(), np.int64)
        order = np.lexsort(code.T[::-1])
        n, y = (table[c].to_numpy()[order].astype(float) for c in ("n", "y"))
        start, trees = _grow_here(code[order], n, y, missing, rules)
        kinds = {"feature": pa.int32(), "cut": pa.int32(), "missing_left": pa.bool_(), "left": pa.int32(), "right": pa.int32(), "value": pa.float64()}
        rows = [{c: getattr(t, c) for c in kinds} for t in trees]
        packed = pa.array([rows], pa.list_(pa.struct([(c, pa.list_(k)) for c, k in kinds.items()])))
        return pa.table({"_model": pa.array([key[0].as_py()], pa.int32()), "start": [start], "trees": packed})

    dealt = rest.repartition(4 * len(folds), "_model")  # a stated number is not brought down to one task
    got = dealt.groupBy("_model").applyInArrow(fit, f"_model int, start double, trees array<{tree}>").collect()
    return {r["_model"]: r["start"] for r in got}, {r["_model"]: [Tree(*t) for t in r["trees"]] for r in got}


def _by_level(cells: DataFrame, folds: list[int], missing: np.ndarray, rules: Rules) -> tuple[dict, dict]:
    """Cells stay distributed; one job a level serves all folds."""
    total = cells.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).collect()
    n_all, y_all = sum(r["n"] for r in total), sum(r["y"] for r in total)
    own = {r["fold"]: r for r in total}
    rest = {f: (n_all - (own[f]["n"] if f in own else 0), y_all - (own[f]["y"] if f in own else 0.0)) for f in folds}
    start = {f: y / n for f, (n, y) in rest.items() if n}
    models, width, p = sorted(start), int(missing.max()) + 1, len(missing)
    trees: dict[int, list[Tree]] = {f: [] for f in models}
    at = cut_lineage(cells.withColumn("p", F.array(*[F.lit(start[f]) for f in models])))
    written = 0

    def parts(batch: pa.RecordBatch, later: dict[int, list[Tree]]) -> tuple[np.ndarray, ...]:
        fold, code, n, y, pred = (batch.column(c) for c in ("fold", "code", "n", "y", "p"))
        code, pred = code.flatten().to_numpy().reshape(-1, p), pred.flatten().to_numpy().reshape(-1, len(models)).copy()
        for k, f in enumerate(models):
            for t in later[f]:
                pred[:, k] += t.predict(code, missing)
        return fold.to_numpy(), code, n.to_numpy().astype(float), y.to_numpy(), pred

    def level(growing: dict[int, Growing], wanted: dict[int, list[int]], later: dict[int, list[Tree]]) -> None:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {f: np.zeros((len(nodes), p, width, 2)) for f, nodes in wanted.items()}
            for batch in batches:
                if not batch.num_rows:
                    continue
                fold, code, n, y, pred = parts(batch, later)
                for k, f in enumerate(models):
                    if f in wanted:
                        number = np.full(len(growing[f].tree.feature), -1)
                        number[wanted[f]] = np.arange(len(wanted[f]))
                        at_node = np.zeros(len(code), np.int64)
                        growing[f].tree.route(code, missing, at_node)
                        leaf = np.where(fold != f, number[at_node], -1)
                        held[f] += histograms(code, leaf, n * pred[:, k] - y, n, len(wanted[f]), width)
            for f, h in held.items():
                flat = np.flatnonzero(h[..., 1])
                cells_ = h.reshape(-1, 2)[flat]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), f, np.int32)), pa.array(flat), pa.array(cells_[:, 0]), pa.array(cells_[:, 1])], ["m", "at", "g", "n"])

        got = at.mapInArrow(sums, "m int, at bigint, g double, n double").groupBy("m", "at").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toPandas()
        for f, nodes in wanted.items():
            mine, h = got[got.m == f], np.zeros((len(nodes) * p * width, 2))
            h[mine["at"].to_numpy()] = mine[["g", "n"]].to_numpy()
            growing[f].learn(nodes, h.reshape(len(nodes), p, width, 2))

    for _ in range(rules.iterations):
        growing = {f: Growing(missing, rules) for f in models}
        later = {f: trees[f][written:] for f in models}
        while wanted := {f: nodes for f in models if (nodes := growing[f].wanted())}:
            level(growing, wanted, later)
        for f in models:
            trees[f].append(growing[f].finished()[0])
        if len(trees[models[0]]) - written == WRITE_EVERY:
            later = {f: trees[f][written:] for f in models}

            def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        pred = parts(batch, later)[-1]
                        yield batch.set_column(batch.num_columns - 1, "p", pa.array(pred.tolist(), pa.list_(pa.float64())))

            at, written = cut_lineage(at.mapInArrow(moved, at.schema)), len(trees[models[0]])
    return start, trees


def fit_folds(df: DataFrame, fold: str, features: Sequence[str], label: str, rules: Rules = Rules(), cells: int = CELLS) -> Boosted:
    """A model for each fold, learned from the rows of all other folds that have a label. `fold` is an
    int; a null fold's rows are learned from by all."""
    known = df.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")))
    edges = bin_edges(known, features)
    missing = np.array([len(e) + 1 for e in edges])
    keyed = known.select(F.coalesce(F.col(fold), F.lit(-1)).cast("int").alias("fold"), codes(features, edges).alias("code"), F.col(label).cast("double").alias("_y"))
    table = cut_lineage(keyed.groupBy("fold", "code").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("y")))
    folds = sorted(r["f"] for r in df.select(F.col(fold).cast("int").alias("f")).where("f is not null").distinct().collect())
    few = table.select("code").distinct().limit(cells + 1).count() <= cells
    start, trees = (_by_fold if few else _by_level)(table, folds, missing, rules) if folds else ({}, {})
    return Boosted(list(features), edges, start, trees)


def predict(df: DataFrame, model: Boosted, fold: str, out: str = "prediction") -> DataFrame:
    """Each row's prediction by the model of its fold, which has not seen it; null where the fold is
    null or nothing could be learned. No shuffle: the trees go to the tasks."""
    rows = df.withColumn("_fold", F.coalesce(F.col(fold).cast("int"), F.lit(-1))).withColumn("_code", codes(model.features, model.edges))
    schema, names = StructType([*df.schema.fields, StructField(out, DoubleType())]), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}  # bin vectors that the task has met, up to CELLS
        for batch in batches:
            where = batch.column("_fold").to_numpy()
            code = batch.column("_code").flatten().to_numpy().reshape(-1, len(model.features))
            p = np.full(len(where), np.nan)
            for f in np.unique(where).tolist():
                if f in model.start:
                    different, index = np.unique(code[where == f], axis=0, return_inverse=True)
                    named = [bytes(r) for r in np.c_[np.full(len(different), f), different].astype(np.int32)]
                    if new := [i for i, k in enumerate(named) if k not in known]:
                        if len(known) > CELLS:
                            known, new = {}, list(range(len(named)))
                        known.update(zip([named[i] for i in new], model.predict(f, different[new]).tolist()))
                    p[where == f] = np.array([known[k] for k in named])[index]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(p, mask=np.isnan(p))], [*names, out])

    return rows.mapInArrow(run, schema)


def cross_predictions(df: DataFrame, fold: str, features: Sequence[str], label: str, rules: Rules = Rules()) -> DataFrame:
    """Out-of-fold predictions of every row."""
    return predict(df, fit_folds(df, fold, features, label, rules), fold)
