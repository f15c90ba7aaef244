"""Periodic runs of words: stretches that repeat one period several times in a row.

Descending-LCP Kruskal. The suffixes of a text are put in order by prefix doubling, which also gives
the length of the longest common prefix (LCP) of neighbours. Neighbours are united in order of
falling LCP; each class keeps its positions in order. When two classes unite at LCP l, positions i < j
of different classes that become neighbours agree in exactly l words, so if j - i <= l the words from
i to j + l have period j - i, and no smaller one (a smaller one would have put a position of the class
between them). The first two periods of every run meet in this way, at its start: a seed is a run if
the word before i differs from the word before j.

A run of length L and period q has an LCP of L - q at its start, so classes below the least such
value are not united; a text in which no stretch of so many words occurs twice has no run.

Defined results: null, empty and blank texts have no words and no runs; equal rows each get a row;
text after the last run is kept; a run is named by its first word's number, its length and its
smallest period. A text's memory is about 200 bytes a word.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from evalgrid.llm.tokens import slices, words_of

LEAST = 6  # words of the shortest run
POWER = 4  # periods that a run holds at least
_CHUNK = 1024
RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])


class Places:
    """A set of positions in order, in chunks of bounded length."""

    def __init__(self, first: int):
        self.chunks, self.lows, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for chunk in self.chunks:
            yield from chunk

    def _at(self, x: int) -> tuple[int, int]:
        c = max(bisect_left(self.lows, x) - 1, 0)
        return c, bisect_left(self.chunks[c], x)

    def around(self, x: int) -> tuple[int, int]:
        """The positions next to x, which is not in the set: before (or -1) and after (or -1)."""
        c, at = self._at(x)
        chunk = self.chunks[c]
        after = chunk[at] if at < len(chunk) else self.lows[c + 1] if c + 1 < len(self.lows) else -1
        return chunk[at - 1] if at else -1, after

    def add(self, x: int) -> None:
        c, at = self._at(x)
        chunk = self.chunks[c]
        chunk.insert(at, x)
        self.lows[c] = chunk[0]
        self.size += 1
        if len(chunk) > _CHUNK:
            half = len(chunk) // 2
            self.chunks[c : c + 1] = [chunk[:half], chunk[half:]]
            self.lows[c : c + 1] = [chunk[0], chunk[half]]


def _repeats(codes: np.ndarray, n: int) -> bool:
    """Whether some n words may occur twice: their hashes do. Equal stretches have equal hashes."""
    h = np.zeros(len(codes) - n + 1, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(h)].astype(np.uint64)
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def _rank_tables(codes: np.ndarray) -> list[np.ndarray]:
    """Table k ranks the stretches of 2^k words by their order; a stretch that reaches the end of the
    text is unlike all others. The last table's ranks are all different. Each ends with -1."""
    ranks, n = np.unique(codes, return_inverse=True)[1].astype(np.int64), len(codes)
    tables, width = [np.r_[ranks, -1]], 1
    while True:
        later = np.r_[ranks[width:] + 1, np.zeros(min(width, n), np.int64)]
        values, ranks = np.unique(ranks * (n + 2) + later, return_inverse=True)
        ranks = ranks.astype(np.int64)
        tables.append(np.r_[ranks, -1].astype(np.int32))
        width *= 2
        if len(values) == n:
            return tables


def _common(tables: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of words that the suffixes at i and at j begin with in common (i and j differ)."""
    i, j, length = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    for k in range(len(tables) - 1, -1, -1):
        step = (tables[k][i] == tables[k][j]) * (1 << k)
        i, j, length = i + step, j + step, length + step
    return length


def runs(codes: np.ndarray, least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least max(least, power * period) numbers, by start,
    then period. `power` is 2 or more."""
    n, floor = len(codes), min(max(least, power * q) - q for q in range(1, least + 1))
    if n < max(least, power) or not _repeats(codes, floor):
        return []
    tables = _rank_tables(codes)
    order = np.argsort(tables[-1][:n])
    lcp = _common(tables, order[:-1], order[1:])
    edges = np.flatnonzero(lcp >= floor)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    parent, classes, found = {}, {}, []

    def root(r: int) -> int:
        while (up := parent.get(r, r)) != r:
            parent[r] = r = parent.get(up, up)
        return r

    def seed(i: int, j: int, length: int) -> None:
        if length + j - i >= max(least, power * (j - i)) and (i == 0 or codes[i - 1] != codes[j - 1]):
            found.append((i, length + j - i, j - i))

    for r, length in zip(edges.tolist(), lcp[edges].tolist()):
        a, b = root(r), root(r + 1)
        large, small = classes.pop(a, None) or Places(int(order[a])), classes.pop(b, None) or Places(int(order[b]))
        if large.size < small.size:
            a, b, large, small = b, a, small, large
        moved = list(small)
        for x, left, right in zip(moved, [-1, *moved[:-1]], [*moved[1:], n]):
            before, after = large.around(x)
            if before > left and x - before <= length:
                seed(before, x, length)
            if x < after < right and after - x <= length:
                seed(x, after, length)
        for x in moved:
            large.add(x)
        parent[b], classes[a] = a, large
    return sorted((i, size, p) for i, size, p in found)


def repeated(found: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Of n words, those that some run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:n]) > 0


def find_runs(docs: DataFrame, keep: list[Column], least: int = LEAST, power: int = POWER) -> DataFrame:
    """`keep` columns, runs (array of start, length, period, in words) and collapsed (the words that no
    run repeats, joined by one space) of each document, from its whole text. One pass, no shuffle."""
    rows = docs.select(*keep, F.col("text").alias("collapsed"))
    schema = StructType([*rows.schema.fields[:-1], StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                texts = pc.fill_null(part.column(part.num_columns - 1), "")
                flat, lists = words_of(pc.ascii_split_whitespace(texts))
                codes = flat.dictionary_encode().indices.to_numpy()
                found = [runs(codes[a:b], least, power) for a, b in zip(lists[:-1], lists[1:])]
                kept = np.ones(len(flat), bool)
                for f, a, b in zip(found, lists[:-1], lists[1:]):
                    if f:
                        kept[a:b] = ~repeated(f, b - a)
                upto = np.r_[0, np.cumsum(kept)][lists].astype(np.int32)
                left = pa.ListArray.from_arrays(pa.array(upto), flat if kept.all() else flat.filter(pa.array(kept)))
                each = np.array([r for f in found for r in f], np.int64).reshape(-1, 3)
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                listed = pa.StructArray.from_arrays([pa.array(each[:, i]) for i in range(3)], ["start", "length", "period"])
                own = part.columns[:-1]
                yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(pa.array(ends), listed), pc.binary_join(left, " ")], names)

    return rows.mapInArrow(run, schema)
