"""Hierarchical packing of documents into training sequences of several lengths.

A document goes to the shortest context tier that holds it; longer ones are cut into whole longest
windows first. From the longest tier down, each document opens a window, the rest of the window is
filled by the longest pieces of shorter tiers that fit, and what is then left is filled by cutting
one piece, whose rest returns to its own tier. So windows are exactly full. Windows of a tier are
dealt into step groups of `STEP_TOKENS` tokens, by attention cost in snake order.

It runs where the rows are: each task packs its own documents batch by batch and carries what does
not fill a window to the next batch, so nothing is shuffled and a task holds one batch. What is
left when a task ends is cut into windows of powers of two, which need no padding. Ids of windows
and steps start at the task's number times 2^32; a task that runs again makes the same ones.

Defined results: null or empty text is the end token alone; equal rows are separate documents; no
rows, no pieces; a text of any length is one document, held whole by one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid.llm.tokens import encode_texts, slices, word_ids

TIERS = [4096, 2048, 1024, 512, 256]
END = 2
STEP_TOKENS = 8 * 4096
SLICE = 8 << 20  # bytes of text that are encoded at once
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_id bigint"
Piece = tuple[int, int, int]  # length, document, start


class Tiers:
    """The pieces that wait, per tier, by length."""

    def __init__(self, tiers: list[int]):
        self.tiers = tiers
        self.pools: list[list[Piece]] = [[] for _ in tiers]

    def add(self, length: int, doc: int, start: int) -> None:
        """Route a piece to the shortest tier that holds it."""
        if length:
            k = max(i for i, t in enumerate(self.tiers) if t >= length)
            insort(self.pools[k], (length, doc, start))

    def fitting(self, gap: int) -> Piece | None:
        """Take the longest piece that fits the gap."""
        for pool in self.pools:
            if at := bisect_right(pool, (gap, 1 << 62, 0)):
                return pool.pop(at - 1)
        return None

    def cut(self, gap: int) -> Piece | None:
        """Fill the gap with the head of the shortest piece of the shortest tier that has any; its
        rest goes back."""
        for pool in reversed(self.pools):
            if pool:
                length, doc, start = pool.pop(0)
                self.add(length - gap, doc, start + gap)
                return gap, doc, start
        return None

    def tokens(self) -> int:
        return sum(p[0] for pool in self.pools for p in pool)

    def windows(self) -> Iterator[tuple[int, list[Piece]]]:
        """Full windows (tier, pieces), longest tier first, until less than one is left."""
        waiting = self.tokens()
        for k, tier in enumerate(self.tiers):
            while self.pools[k] and waiting >= tier:
                held, gap = [self.pools[k].pop()], tier
                gap -= held[0][0]
                while gap and (p := self.fitting(gap) or self.cut(gap)):
                    held.append(p)
                    gap -= p[0]
                waiting -= tier
                yield tier, held

    def rest(self) -> Iterator[tuple[int, list[Piece]]]:
        """What is left, as windows of the powers of two that add up to it."""
        pieces = [p for pool in self.pools for p in reversed(pool)]
        self.pools = [[] for _ in self.tiers]
        left = sum(p[0] for p in pieces)
        while left:
            width, held = min(self.tiers[0], 1 << (left.bit_length() - 1)), []
            left, gap = left - width, width
            while gap:
                length, doc, start = pieces.pop(0)
                held.append((min(gap, length), doc, start))
                if length > gap:
                    pieces.insert(0, (length - gap, doc, start + gap))
                gap -= held[-1][0]
            yield width, held


def step_groups(windows: list[tuple[int, list[Piece]]], step_tokens: int) -> list[int]:
    """A step number per window: windows of one tier only, about step_tokens each, dealt in snake
    order of their attention cost (sum of squared lengths)."""
    steps, base = [0] * len(windows), 0
    for tier in sorted({t for t, _ in windows}, reverse=True):
        own = [i for i, (t, _) in enumerate(windows) if t == tier]
        own.sort(key=lambda i: (-sum(p[0] ** 2 for p in windows[i][1]), i))
        n = max(1, -(-len(own) * tier // step_tokens))
        for place, i in enumerate(own):
            lap, at = divmod(place, n)
            steps[i] = base + (at if lap % 2 == 0 else n - 1 - at)
        base += n
    return steps


def pack(docs: DataFrame, tokenizer: str, tiers: list[int] = TIERS, step_tokens: int = STEP_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier and
    step_id, and the ids if asked for. `tokenizer`: path of a vocabulary file on every machine."""
    tiers = sorted(tiers, reverse=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, wait = word_ids(tokenizer), Tiers(tiers)
        held: dict[int, tuple[int | None, np.ndarray]] = {}  # document number -> its id and ids
        base = TaskContext.get().partitionId() << 32
        n_docs = n_windows = n_steps = 0

        def rows(windows):
            nonlocal n_windows, n_steps
            steps, out, ids = step_groups(windows, step_tokens), [], []
            for (tier, pieces), step in zip(windows, steps):
                offset = 0
                for length, doc, start in pieces:
                    part = held[doc][1][start : start + length]
                    out.append((held[doc][0], start, length, zlib.crc32(part.tobytes()), len(held[doc][1]), base + n_windows, offset, tier, base + n_steps + step))
                    offset += length
                    if with_ids:
                        ids.append(part)
                n_windows += 1
            n_steps += max(steps, default=-1) + 1
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            cols = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
            if with_ids:
                flat = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)), pa.array(flat)))
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            for part in slices(batch, 1, SLICE):
                ids, counts = encode_texts(coder, part.column(1), END)
                for doc_id, own in zip(part.column(0).to_pylist(), np.split(ids, np.cumsum(counts)[:-1])):
                    held[n_docs] = doc_id, own
                    whole = len(own) // tiers[0] * tiers[0]
                    for start in range(0, whole, tiers[0]):
                        wait.add(tiers[0], n_docs, start)
                    wait.add(len(own) - whole, n_docs, whole)
                    n_docs += 1
                yield rows(list(wait.windows()))
                left = {p[1] for pool in wait.pools for p in pool}
                held = {d: (held[d][0], held[d][1].copy()) for d in left}
        yield rows(list(wait.rest()))

    names = [c.split()[0] for c in SCHEMA.split(", ")] + ["ids"] * with_ids
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)
