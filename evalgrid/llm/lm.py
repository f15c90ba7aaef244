"""Scoring texts with a causal self-attention language model, beside a word-count base.

One pass over the texts counts the words of the training rows. The FREQUENT words that occur most
(a table of bounded size) go to every task; a second pass takes each text's share of the base score
from them, keeps its rarer words, and writes its subword ids. Rarer words are joined with the counts
by word; none of them can be a hot key. Everything after that reads the written ids: counts for the
model's tables over all training tokens, training, and scoring.

Training: every window of every training text; each round, every task runs Adam from the same weights
over its own windows, and the weights are averaged by windows with a distributed sum. Scoring: overlapping windows, each token scored once.

Defined results: null text is empty and has one token, the end; without training rows counts are
zero, base probabilities are uniform over the end alone and the model is the uniform one; equal rows
each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.llm import attention as A
from evalgrid.llm.tokens import encode_words, slices, word_ids, words_of
from evalgrid.session import cut_lineage

FREQUENT, LONGEST = 1 << 18, 64  # words that every task holds, and the bytes of the longest of them
ROUNDS = [0.01, 0.004]  # learning rate of each round
TASK_WINDOWS = 4096  # windows that a training task should have at least, where there are as many
SLICE = 2 << 20  # bytes of text that a task cuts into words at a time
END = 50256
SIZE = 50257  # ids of the vocabulary


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lower-cased words of the texts in a row, and where each text's begin and end."""
    return words_of(pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 0, SLICE):
            seen = pc.value_counts(_words(part.column(0))[0])
            yield pa.RecordBatch.from_arrays([seen.field("values"), seen.field("counts")], ["word", "n"])
    pa.default_memory_pool().release_unused()  # the worker lives on into later stages


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n) over whole training texts."""
    return train.select("text").mapInArrow(_count_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_from(counts: DataFrame, most: int) -> int:
    """The lowest count from which there are at most `most` words, to an eighth of an octave: read off
    a histogram of counts, so that no task ranks words."""
    bins = counts.groupBy(F.floor(8 * F.log2("n")).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("w"), F.min("n").alias("n"))
    seen, found = 0, 1 << 62
    for r in bins.orderBy(F.desc("b")).collect():
        seen += r["w"]
        if seen > most:
            break
        found = r["n"]
    return found


def tokenised(docs: DataFrame, tokenizer: str, words: pa.Array, n: np.ndarray) -> DataFrame:
    """row (a number that is fixed by writing the result), doc_id, held_out, n_words, known and logs
    (of the frequent `words`, which occur `n` times: how many, and the sum of log10(n + 0.1)), rare
    (the other words), ids (16-bit, with the end)."""
    logs = np.log10(n + 0.1)
    schema = "row bigint, doc_id bigint, held_out boolean, n_words bigint, known bigint, logs double, rare array<string>, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, made = word_ids(tokenizer, " "), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, 2, SLICE):
                flat, ends = _words(part.column(2))
                coded = flat.dictionary_encode()
                at = pc.index_in(coded.dictionary, words).fill_null(-1).to_numpy()[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
                hit = at >= 0
                gain = np.r_[0.0, np.cumsum(np.where(hit, logs[at], 0.0))] if len(logs) else np.zeros(len(flat) + 1)
                known = np.r_[0, np.cumsum(hit)]
                rare_ends = np.r_[0, np.cumsum(~hit)][ends].astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(rare_ends), flat.filter(pa.array(~hit)))
                ids, counts = encode_words(coder, flat, ends, END)
                raw = [x.tobytes() for x in np.split(ids.astype("<u2"), np.cumsum(counts)[:-1])]
                n = part.num_rows
                cols = [pa.array(np.arange(made, made + n)), part.column(0), part.column(1), pa.array(np.diff(ends)), pa.array(known[ends[1:]] - known[ends[:-1]]), pa.array(gain[ends[1:]] - gain[ends[:-1]]), rare, pa.array(raw, pa.binary())]
                made += n
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in schema.split(", ")])
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def _texts(batch: pa.RecordBatch, column: int, most: int = 400_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of a batch's rows with about `most` ids: first row, end row, ids in a row, ids per text."""
    raw = batch.column(column).cast(pa.binary())
    ends = np.r_[0, np.cumsum(pc.binary_length(raw).to_numpy().astype(np.int64) // 2)]
    first = int(np.frombuffer(raw.buffers()[1], np.int32)[raw.offset]) if ends[-1] else 0
    all_ids = np.frombuffer(raw.buffers()[2] if ends[-1] else b"", "<u2", int(ends[-1]), first)  # no copy
    at = 0
    while at < len(raw):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, upto, all_ids[ends[at] : ends[upto]].astype(np.int64), np.diff(ends[at : upto + 1])
        at = upto


def _histogram(train: DataFrame, size: int, keys) -> np.ndarray:
    """Counts of keys(ids, sizes) in 0..size-1 over all training ids: added up per task, then by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for batch in batches:
            for _, _, ids, sizes in _texts(batch, 0):
                k = keys(ids, sizes)
                if size > 4 * len(k):
                    np.add.at(n, k, 1)
                else:
                    n += np.bincount(k, minlength=size)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["k", "n"])
        pa.default_memory_pool().release_unused()

    got = train.select("ids").mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[got.column("k").to_numpy()] = got.column("n").to_numpy()
    return out


def _before(v: A.Vocabulary, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Input row that each token is predicted from."""
    rows = np.r_[v.start, v.row[ids[:-1]]] if len(ids) else np.zeros(0, np.int64)
    rows[np.cumsum(sizes)[:-1][sizes[1:] > 0]] = v.start
    return rows


def learn(train: DataFrame) -> A.Model:
    """Tables from counts over all training ids, and attention weights. train: ids, a written table."""
    n = _histogram(train, SIZE, lambda ids, sizes: ids)
    v = A.Vocabulary.of_counts(n)
    pairs = _histogram(train, v.rows * A.CLASSES, lambda ids, sizes: _before(v, ids, sizes) * A.CLASSES + v.cls[ids])
    model = A.Model.of_counts(v, n, pairs.reshape(v.rows, A.CLASSES))
    near = model.cluster
    counts = _histogram(train, A.CLUSTERS * SIZE, lambda ids, sizes: near[_before(v, ids, sizes)] * SIZE + ids)
    model.with_clusters(counts.reshape(A.CLUSTERS, SIZE))

    # each task trains over its own windows, so there are no more tasks than give each enough of them
    size = (F.octet_length("ids") / 2).cast("bigint")
    total = train.agg(F.coalesce(F.sum(F.greatest(F.lit(1), F.ceil((size - (A.WINDOW - A.STRIDE)) / A.STRIDE))), F.lit(0)).alias("n")).first()["n"]
    texts = train.select("ids").coalesce(max(1, total // TASK_WINDOWS))
    for number, rate in enumerate(ROUNDS):
        average_round(texts, model, rate, number)
    return model


def average_round(texts: DataFrame, model: A.Model, rate: float, number: int) -> int:
    """One round of training in every task from the model's weights, which become the average; over
    all windows of all texts (ids). Returns how many windows that were."""
    v = model.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = A.Model(model.vocabulary, model.group, model.direct, model.cluster, model.within, dict(model.weights))
        trainer, seen = A.Trainer(own, rate, number), 0
        for batch in batches:
            for _, _, ids, sizes in _texts(batch, 0):
                x, index, places = A.windows(v.row[ids], sizes, v.start)
                trainer.run(x, places, v.cls[ids[index]])
                seen += len(x)
        flat = np.concatenate([own.weights[k].ravel() for k in A.LEARNED]).astype(np.float64) * seen
        flat = np.r_[seen, flat] if seen else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["place", "value"])
        pa.default_memory_pool().release_unused()

    got = texts.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    if not got.num_rows:
        return 0
    flat = np.zeros(got.num_rows)
    flat[got.column("place").to_numpy()] = got.column("value").to_numpy()
    seen, flat, at = int(flat[0]), flat[1:] / flat[0], 0
    for k in A.LEARNED:
        size = model.weights[k].size
        model.weights[k] = flat[at : at + size].reshape(model.weights[k].shape).astype(np.float32)
        at += size
    return seen


def _text_scores(model: A.Model, ids: np.ndarray, sizes: np.ndarray, batch: int = 512) -> np.ndarray:
    """log10 probability of each text."""
    v, model = model.vocabulary, model.folded()
    x, index, own = A.windows(v.row[ids], sizes, v.start)
    gain = np.zeros(len(ids))
    for at in range(0, len(x), batch):
        rows, places = x[at : at + batch], own[at : at + batch]
        token = index[at : at + batch][places]
        y = ids[token]
        gain[token] = A.class_log10(model, rows, places, v.cls[y]) + model.within[model.cluster[rows[places]], y]
    return np.diff(np.r_[0.0, np.cumsum(gain)][np.r_[0, np.cumsum(sizes)]])


def score(docs: DataFrame, held_out: Column, tokenizer: str, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per document; rows where
    `held_out` holds teach nothing. `tokenizer`: path of a vocabulary file on every machine."""
    docs = docs.select(F.col("doc_id").cast("bigint"), "text", held_out.alias("held_out"))
    train = docs.where(~F.col("held_out"))
    counts = cut_lineage(word_counts(train))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train = train.select("doc_id").count()
    n, v = total["n"] + n_train, total["v"] + (n_train > 0)
    top = counts.where((F.octet_length("word") <= LONGEST) & (F.col("n") >= frequent_from(counts, frequent))).select("word", "n").toArrow()
    tokens = cut_lineage(tokenised(docs, tokenizer, top.column("word").combine_chunks(), top.column("n").to_numpy()))
    model = learn(tokens.where(~F.col("held_out")))

    rare = tokens.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rare_logs"), F.count("n").alias("rare_known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_text_scores(model, ids, sizes) for _, _, ids, sizes in _texts(batch, 6)]
            score = pa.array(np.concatenate([np.zeros(0), *got]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], score], [*batch.schema.names[:6], "score"])
        pa.default_memory_pool().release_unused()

    narrow = "row bigint, doc_id bigint, held_out boolean, n_words bigint, known bigint, logs double"
    scored = tokens.select("row", "doc_id", "held_out", "n_words", "known", "logs", "ids").mapInArrow(run, narrow + ", score double")
    base = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) + float(np.log10(n_train + 0.1)) - (F.col("n_words") + 1) * float(np.log10(n + 0.1 * (v + 1)))
    return scored.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + int(n_train > 0)).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
    )
