"""Language of pages by Bayesian fusion of text, declared language, address suffix and host.

- Text: likelihood of the visible text's byte trigrams, hashed to `BUCKETS`, under counts of all
  documents of each language. Trigrams overlap, so the log likelihood is tempered by `TEMPER`.
- Declared language: how often pages that read as language l declare d, over all pages.
- Prior: languages over all pages, smoothed into each address suffix, smoothed into each host, by
  grouped aggregation of what the text alone says; a page's own vote is taken out again.

The languages are those of the documents; the tables that are collected have a bounded size
(languages x buckets, languages x languages); suffixes and hosts are joined.

Defined results: null html is empty text, no evidence: the prior decides; a null or unreadable
address has host and suffix ''; ties go to the language that sorts first; without any document
language the result is null; equal rows each get a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid.session import cut_lineage

BUCKETS = 1 << 14
TEMPER = 0.15
SUFFIX_WEIGHT, HOST_WEIGHT = 20.0, 5.0
_HIDDEN = re.compile(rb"<(script|style|noscript|template)\b")
_ENTITY = re.compile(rb"(?i)&[a-z#0-9]{1,12};")
_TOLD = re.compile(rb"<(html|meta)\b")
_LANG = re.compile(rb"\blang\s*+=\s*+[\"']?+\s*+([a-z]{2,3})\b")
_CONTENT = re.compile(rb"content\s*+=\s*+[\"']?+\s*+([a-z]{2,3})\b")
_HOST = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def trigrams(raw: bytes) -> np.ndarray:
    """Hashed byte trigrams of lower-cased text, runs of white space as one."""
    b = np.frombuffer(b" " + b" ".join(raw.lower().split()) + b" ", np.uint8).astype(np.uint32)
    code = b[:-2] | b[1:-1] << 8 | b[2:] << 16
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def visible(html: str | None) -> bytes:
    """The text outside tags, comments and hidden elements, in one pass; what is not closed goes on to
    the end of the page."""
    raw = (html or "").encode()
    low, out, at, end = raw.lower(), [], 0, len(raw)

    def behind(mark: bytes, start: int) -> int:
        found = low.find(mark, start)
        return end if found < 0 else found + len(mark)

    while at < end:
        tag = low.find(b"<", at)
        out.append(raw[at : tag if tag >= 0 else end])
        if tag < 0:
            break
        if low.startswith(b"<!--", tag):
            at = behind(b"-->", tag + 4)
        elif hidden := _HIDDEN.match(low, tag):
            at = behind(b">", behind(b"</" + hidden[1], hidden.end()))
        else:
            at = behind(b">", tag)
    return _ENTITY.sub(b" ", b" ".join(out))


def declared(html: str | None) -> str:
    """The first language that an html or meta tag names, looked for inside each tag by itself."""
    low, at = (html or "").encode().lower(), 0
    while tag := _TOLD.search(low, at):
        at = low.find(b">", tag.end())
        inside = low[tag.end() : at if at >= 0 else len(low)]
        if tag[1] == b"html":
            m = _LANG.search(inside)
        else:
            said = inside.find(b"content-language")
            m = _CONTENT.search(inside, said + 16) if said >= 0 else None
        if m:
            return m[1].decode()
        if at < 0:
            break
    return ""


def host_of(url: str | None) -> tuple[str, str]:
    """Host and its last label, in lower case."""
    m = _HOST.match((url or "").strip())
    host = m[1].lower().strip(".") if m else ""
    return host, host.rpartition(".")[2]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if lang not in seen:
                seen[lang] = np.zeros(BUCKETS, np.int64)
            if text:
                seen[lang] += np.bincount(trigrams(text.encode()), minlength=BUCKETS)
    for lang, n in seen.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])


def learn_texts(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities (languages, buckets) from all documents."""
    rows = docs.where(F.col("lang").isNotNull()).select("text", "lang").mapInArrow(_count, "lang string, bucket int, n bigint")
    rows = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(rows.column("lang").to_pylist()))
    n = np.full((len(names), BUCKETS), 0.5)
    if names:
        number = {x: i for i, x in enumerate(names)}
        n[[number[x] for x in rows.column("lang").to_pylist()], rows.column("bucket").to_numpy()] += rows.column("n").to_numpy()
    return names, np.log(n / n.sum(axis=1, keepdims=True))


def page_evidence(pages: DataFrame, names: list[str], logp: np.ndarray) -> DataFrame:
    """page_id, host, suffix, said (declared language), loglik per language, read (the language that
    the text alone says, null without text)."""
    known, weight = set(names), np.ascontiguousarray(logp.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            htmls, hosts = batch.column(2).to_pylist(), [host_of(u) for u in batch.column(1).to_pylist()]
            rows = [weight[trigrams(raw)].sum(axis=0) if names and raw.strip() else None for raw in map(visible, htmls)]
            said = [d if d in known or not d else "other" for d in map(declared, htmls)]
            read = [None if r is None else int(r.argmax()) for r in rows]
            like = [[0.0] * len(names) if r is None else r.tolist() for r in rows]
            cols = [batch.column(0), pa.array([h for h, _ in hosts]), pa.array([s for _, s in hosts]), pa.array(said, pa.string()), pa.array(like, pa.list_(pa.float64())), pa.array(read, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "host", "suffix", "said", "loglik", "read"])

    return pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(run, "page_id bigint, host string, suffix string, said string, loglik array<double>, read int")


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, host, suffix for each page."""
    names, logp = learn_texts(docs)
    seen = page_evidence(pages, names, logp)
    if not names:
        none = F.lit(None)
        return seen.select("page_id", none.cast("string").alias("lang"), none.cast("double").alias("confidence"), none.cast("string").alias("text_lang"), F.col("said").alias("declared"), "host", "suffix")
    seen, k = cut_lineage(seen), len(names)
    votes = F.array(*[F.sum(F.when(F.col("read") == i, 1.0).otherwise(0.0)) for i in range(k)])
    total = [x or 0.0 for x in seen.agg(votes.alias("v")).first()["v"]]
    overall = (np.array(total) + 1) / (sum(total) + k)
    # P(declared | language), one more of every kind than seen
    kinds = ["", "other", *names]
    told = np.ones((len(kinds), k))
    for r in seen.where("read is not null").groupBy("said", "read").agg(F.count(F.lit(1)).alias("n")).collect():
        told[kinds.index(r["said"]), r["read"]] += r["n"]
    log_told = np.log(told / told.sum(axis=0))

    suffixes = seen.groupBy("suffix").agg(votes.alias("in_suffix"))
    hosts = seen.groupBy("suffix", "host").agg(votes.alias("in_host"))
    priors = hosts.join(suffixes, "suffix").select("host", "in_host", "in_suffix")

    @F.pandas_udf("struct<lang:string,confidence:double,text_lang:string>")
    def fuse(loglik: pd.Series, read: pd.Series, said: pd.Series, in_host: pd.Series, in_suffix: pd.Series) -> pd.DataFrame:
        n = len(read)
        like, host, suffix = (np.array(x.to_list(), float).reshape(n, k) for x in (loglik, in_host, in_suffix))
        own = (read.to_numpy(float)[:, None] == np.arange(k)).astype(float)
        p = (suffix - own + SUFFIX_WEIGHT * overall) / ((suffix - own).sum(axis=1, keepdims=True) + SUFFIX_WEIGHT)
        p = (host - own + HOST_WEIGHT * p) / ((host - own).sum(axis=1, keepdims=True) + HOST_WEIGHT)
        post = TEMPER * like + np.log(p) + log_told[[kinds.index(s) for s in said]]
        post = np.exp(post - post.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        best = post.argmax(axis=1)
        text = [None if np.isnan(r) else names[int(r)] for r in read.to_numpy(float)]
        return pd.DataFrame({"lang": [names[i] for i in best], "confidence": post.max(axis=1), "text_lang": text})

    fused = seen.join(priors, "host").withColumn("f", fuse("loglik", "read", "said", "in_host", "in_suffix"))
    return fused.select("page_id", "f.lang", "f.confidence", "f.text_lang", F.col("said").alias("declared"), "host", "suffix")
