"""Packing, archives, search and the pipeline: round trips and brute force."""

import gzip
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from helpers import awkward_docs, many_docs  # noqa: E402

from evalgrid.llm import arc, hamming, packing, tokens  # noqa: E402
from evalgrid.session import new_folder  # noqa: E402

WORDS = public_tokenizers.path("word_bpe_49k.json")


# --- tokens and packing


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBÉé́ \t\n\x0b\x0c\r\x00'sΣ漢🎉12.|<>endoftx", max_size=40)), min_size=1, max_size=6))
def test_ids_are_those_of_the_whole_text(texts):
    import pyarrow as pa

    plain = Tokenizer.from_file(WORDS)
    ids, counts = tokens.encode_texts(tokens.word_ids(WORDS), pa.array(texts, pa.string()), 2)
    want = [plain.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_special_strings_and_a_full_cache(monkeypatch):
    plain = Tokenizer.from_file(WORDS)
    monkeypatch.setattr(tokens, "CACHE", 2)
    coder = tokens.WordIds(WORDS)
    for batch in (["<|endoftext|>", "x<|startoftext|>y", "a\x00b", "same"], ["same", "new", "a\x00b"], ["a", "b", "c", "same"]):
        assert coder.encode(batch) == [np.array(plain.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in batch]


def test_both_libraries_spell_words_alike():
    words = ["the", "naïve", "x'sy", "a\xa0b", "12345", "漢字🎉", "a\x00b", "###", "ÉTÉ", "\u2003"]
    a, b = (tokens.WordIds(public_tokenizers.path(f"byte_bpe_50k.{kind}"), " ").encode(words) for kind in ("json", "tiktoken"))
    assert a == b and all(a)


def check_pieces(rows, docs):
    plain = Tokenizer.from_file(WORDS)
    ids = {k: np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for k, t in docs.items()}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(docs)
    for k, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids[k])
            assert r["ids_crc32"] == zlib.crc32(ids[k][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[k])
    padded = total = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and len({(r["tier"], r["step_id"]) for r in pieces}) == 1
        total += at
        padded += 0 if at & (at - 1) == 0 else 4096 - at
    assert padded == 0 and total == sum(map(len, ids.values()))


def test_packing_holds_each_id_once_without_padding(spark):
    docs = many_docs(spark, 500).union(awkward_docs(spark).where("doc_id = 6").withColumn("doc_id", F.lit(9999).cast("bigint")))
    rows = packing.pack(docs.repartition(3), WORDS, with_ids=True).collect()
    check_pieces(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert all(r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
    steps = {}
    for r in rows:
        steps.setdefault(r["step_id"], set()).add((r["sequence_id"], r["tier"]))
    assert all(len({t for _, t in s}) == 1 and sum(t for _, t in s) <= packing.STEP_TOKENS for s in steps.values())


def test_packing_awkward_rows(spark):
    got = packing.pack(awkward_docs(spark, clash=True), WORDS).collect()
    whole = {}
    for r in got:
        whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + r["length"]
    assert whole[3] == whole[4] == whole[5] == 1 and whole[1] == 2 * whole[2]
    assert packing.pack(awkward_docs(spark).limit(0), WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9000), min_size=1, max_size=60))
def test_tiers_fill_windows_exactly(sizes):
    wait, seen = packing.Tiers(packing.TIERS), [0] * len(sizes)
    for d, n in enumerate(sizes):
        for at in range(0, n, 4096):
            wait.add(min(4096, n - at), d, at)
    done = list(wait.windows())
    assert wait.tokens() < 4096
    for width, pieces in [*done, *wait.rest()]:
        assert sum(p[0] for p in pieces) == width and width & (width - 1) == 0
        for length, d, _ in pieces:
            seen[d] += length
    assert seen == sizes


# --- archives


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records_by_declared_length(version):
    body = "line\n\nURL 1.2.3.4 20200101000000 text/html 5\nmore\r\n\r\n"
    made = [arc.version_block(version, "x.arc"), arc.arc_record(version, "x.arc", 0, "http://a b/\n", arc.http_response(7, body)), arc.arc_record(version, "x.arc", 9, "dns:host", "1.2.3.4", "text/dns")]
    info, page, dns = arc.parse_arc(("\n".join(made) + "\n").encode())
    assert info.fields["URL"] == "filedesc://x.arc" and page.fields["URL"] == "http://a%20b/%0A"
    assert page.block[arc.head_of(page.block) :].decode() == body and arc.header(page.block[: arc.head_of(page.block)], b"x-page-id") == "7"
    assert dns.block == b"1.2.3.4" and arc.head_of(dns.block) == 0 and ("Filename" in dns.fields) == (version == 2)


@pytest.mark.parametrize("bad", [b"http://a 1 2 t 99\nshort", b"http://a 1 2 t x\n", b"no end", b"filedesc://x 0 0 t 4\nzzzz", b"http://a 5\nabcde"])
def test_broken_arc_is_an_error(bad):
    with pytest.raises(ValueError):
        list(arc.parse_arc(bad))


def test_warc_round_trip_and_broken_warc():
    blocks = ["", "a\r\n\r\nWARC/1.1\r\n", "é漢"]
    raw = "".join(arc.warc_record("resource", b, "http://x", arc.FETCHED, {"X-N": str(i)}, "text/plain") + arc.TERMINATOR for i, b in enumerate(blocks)).encode()
    got = list(arc.parse_warc(raw))
    assert [r.block.decode() for r in got] == blocks and [r.fields["x-n"] for r in got] == ["0", "1", "2"]
    assert len({r.fields["warc-record-id"] for r in got}) == 3 and got[0].fields["warc-date"] == "2026-01-01T00:00:00Z"
    for cut in (raw[:-3], raw[: len(raw) // 2], b"junk" + raw):
        with pytest.raises(ValueError):
            list(arc.parse_warc(cut))


def test_pages_through_archives(spark):
    long = "x" * 99
    pages = [(5, "http://a/", long + "é"), (3, "http://b c/", long + "é"), (9, None, long + "é"), (3, "http://d/", long + "é"), (None, "u", long + "é"), (1, "u", long), (2, "u", long), (4, "", None), (6, "u", ""), (7, "u", "a\r\n\r\nb\n\nWARC/1.1\r\n\r\n" * 20), (None, "n", "z" * 200), (None, "n", "z" * 200)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("head", F.lit(1)).repartition(3)
    folder = new_folder(spark)
    got = arc.archived_pages(df, folder).collect()
    assert len(got) == len(pages)
    import hashlib
    from collections import Counter

    def row(page_id, html):
        raw = (html or "").encode()
        dup = len(raw) >= 100 and html == long + "é" and page_id != 3
        return page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if dup else "response", 3 if dup else None

    want = Counter(row(p, h) for p, _, h in pages)
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    versions = {next(arc.parse_arc(gzip.decompress(r["content"]))).block[:1] for r in spark.read.format("binaryFile").load(f"{folder}/arc").collect()}
    assert versions == {b"1", b"2"}
    assert arc.archived_pages(df.limit(0), new_folder(spark)).count() == 0


# --- search


def brute(codes, queries, k):
    out = []
    for q in queries:
        best = sorted(((codes[q][1] ^ c).bit_count(), i is None, i or 0) for i, c in codes)[:k]
        out += [(codes[q][0], n + 1, None if none else i, d) for n, (d, none, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("segments", [8, 4])
def test_search_is_exact_with_ties_copies_and_far_queries(spark, segments):
    rng = np.random.default_rng(segments)
    base = [int(x) for x in rng.integers(0, 1 << 62, 60)]
    codes = [(i, base[i % 60] ^ sum(1 << int(b) for b in rng.integers(0, 63, i % 5))) for i in range(400)]
    codes += [(400 + i, 12345) for i in range(150)]  # one code held by many
    df = spark.createDataFrame(codes, "id long, code long").withColumn("n", F.lit(0)).withColumn("bound", F.lit(1))
    got = hamming.top_k(df, F.col("id") % 50 == 0, 10, segments).collect()
    want = brute(codes, [i for i, (x, _) in enumerate(codes) if x % 50 == 0], 10)
    assert sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in got) == want


def test_search_awkward_rows(spark):
    rows = [(0, [1.0, None, float("nan")]), (100, None), (1, []), (2, [1.0] * 130), (None, [1.0]), (0, [1.0, None, float("nan")])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    codes = df.select(F.col("vec_id").alias("id"), hamming.sign_code("embedding").alias("code"))
    assert {(r["id"], r["code"]) for r in codes.collect()} == {(0, 1), (100, None), (1, 0), (2, -1), (None, 1)}
    got = hamming.top_k(codes, F.coalesce(F.col("id") % 100 == 0, F.lit(False)), 10).collect()
    assert sorted((r["rank"], str(r["id"]), r["distance"]) for r in got) == sorted(2 * [(1, "0", 0), (2, "0", 0), (3, "None", 0), (4, "1", 1), (5, "2", 63)])
    assert hamming.top_k(codes.limit(0), F.lit(True), 3).count() == 0
