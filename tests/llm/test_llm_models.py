"""Learned operators: forward-backward and gradients by brute force, held-out accuracy, edge cases."""

import itertools
import math
import random
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import DOCS, awkward_docs, crc, many_docs, words  # noqa: E402

from evalgrid.llm import attention as A  # noqa: E402
from evalgrid.llm import langid, lm, quality, toxicity  # noqa: E402

LABELS = "doc_id bigint, quality int, toxic int"


def auc(score, label):
    a, b = [s for s, y in zip(score, label) if y], [s for s, y in zip(score, label) if not y]
    return sum((x > y) + 0.5 * (x == y) for x in a for y in b) / (len(a) * len(b))


# --- toxicity


def test_forward_backward_sums_over_all_taggings():
    rng = np.random.default_rng(0)
    emit, trans = rng.normal(size=(3, 5)), rng.normal(size=(2, 2))
    mask = np.arange(5)[None] < np.array([5, 3, 1])[:, None]
    p, pairs, logz = toxicity.forward_backward(emit, mask, trans)
    want_pairs = np.zeros((2, 2))
    for w in range(3):
        n = int(mask[w].sum())
        weight = {t: math.exp(sum(emit[w, i] * t[i] for i in range(n)) + sum(trans[t[i - 1], t[i]] for i in range(1, n))) for t in itertools.product((0, 1), repeat=n)}
        z = sum(weight.values())
        assert np.allclose(p[w, :n], [sum(x for t, x in weight.items() if t[i]) / z for i in range(n)]) and not p[w, n:].any()
        assert np.isclose(logz[w], math.log(z))
        for t, x in weight.items():
            for i in range(1, n):
                want_pairs[t[i - 1], t[i]] += x / z
    assert np.allclose(pairs, want_pairs)


def test_marginals_of_long_texts_agree_with_one_window(monkeypatch):
    chain = toxicity.Chain(weights={"w:bad": 9.0}, bias=-6.0, trans=np.array([[0.5, -0.5], [-0.5, 0.7]]))
    rng = random.Random(3)
    doc = [rng.choice(["bad", "good", "fine", "ok"]) for _ in range(500)]
    cut = chain.marginals([doc, [], ["bad"]])
    monkeypatch.setattr(toxicity, "WINDOW", 600)
    whole = chain.marginals([doc, [], ["bad"]])
    assert np.allclose(cut[0], whole[0], atol=1e-3) and len(cut[1]) == 0 and np.allclose(cut[2], whole[2])


@pytest.fixture(scope="module")
def marked(spark):
    """Documents of which a fifth hold insults (one of them with varying ends), and labels."""
    rng, rows, labels = random.Random(11), [], []
    for r in many_docs(spark, 900).collect():
        text, toxic = r["text"].split(), int(r["doc_id"] % 5 == 0)
        for _ in range(toxic * 3):
            text.insert(rng.randrange(len(text) + 1), rng.choice(["Dummkopf", "quaxing", "quaxed", "QUAXY###"]))
        rows.append((r["doc_id"], " ".join(text), r["lang"], r["source"], 0))
        labels.append((r["doc_id"], 1, toxic))
    return spark.createDataFrame(rows, DOCS).cache(), spark.createDataFrame(labels, LABELS).cache()


def test_toxic_documents_and_spans_are_found(spark, marked):
    docs, labels = marked
    chain = toxicity.learn_chain(docs, labels, F.col("doc_id") % 3 != 1)
    got = toxicity.toxicity(docs, chain, [F.col("doc_id"), F.col("text")]).collect()
    held = [r for r in got if r["doc_id"] % 3 == 1]
    assert auc([r["score"] for r in held], [r["doc_id"] % 5 == 0 for r in held]) > 0.99
    assert sum((r["score"] >= 0.7) == (r["doc_id"] % 5 == 0) for r in held) >= 0.98 * len(held)
    for r in held:
        for s in r["spans"]:
            assert r["text"][s["start"] : s["end"]] == s["text"]
            assert all(w.lower().startswith(("dummkopf", "quax")) for w in toxicity.TOKEN.findall(s["text"]))
    left = toxicity.drop_toxic(docs, chain, 0.7)
    assert left.columns == docs.columns and {r["doc_id"] % 5 for r in left.collect()} >= {1, 2, 3, 4}


def test_toxicity_on_awkward_rows_and_without_classes(spark, marked):
    docs = awkward_docs(spark, clash=True)
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, 1, None), (None, 1, 1), (7, 1, 0)], LABELS)
    chain = toxicity.learn_chain(docs, labels, F.lit(True))
    assert all(0 <= r["score"] <= 1 for r in toxicity.toxicity(docs, chain, [F.col("doc_id")]).collect())
    for few in (labels.limit(0), labels.where("toxic = 0")):
        assert {r["score"] for r in toxicity.toxicity(docs, toxicity.learn_chain(docs, few, F.lit(True)), [F.col("doc_id")]).collect()} == {0.0}
    chain = toxicity.learn_chain(*marked, F.lit(True))
    blank = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, chain, [F.col("doc_id")]).collect()}
    assert blank[3] == blank[4] == blank[5] < 0.3
    assert toxicity.toxicity(docs.limit(0), chain, [F.col("doc_id")]).count() == 0


# --- quality


def test_discriminant_is_the_ratio_of_two_gaussians():
    rng = np.random.default_rng(2)
    x = [rng.normal(m, s, (400, 3)) for m, s in ((0, 1), (1, 2))]
    model = quality.Discriminant.of_sums(np.array([400, 400]), np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]))
    pooled = np.diag(sum(np.cov(v.T, bias=True) for v in x) / 2)
    dens = []
    for v in x:
        cov = 0.9 * np.cov(v.T, bias=True) + 0.1 * np.diag(pooled) + 1e-4 * np.eye(3)
        d = x[0] - v.mean(0)
        dens.append(-0.5 * (np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]))
    assert np.allclose(model.difference(x[0]), np.arcsinh((dens[1] - dens[0]) / 2))


def test_quality_held_out(spark):
    docs = many_docs(spark, 900)
    bad = F.col("doc_id") % 4 == 0
    docs = docs.withColumn("text", F.when(bad, F.upper(F.regexp_replace("text", " ", "!! "))).otherwise(F.col("text"))).cache()
    labels = docs.select("doc_id", F.when(bad, 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))
    stats = quality.with_statistics(docs, [F.col("doc_id")])
    got = quality.score(stats, quality.learn(stats, labels, F.col("doc_id") % 5 != 0)).where("doc_id % 5 = 0").collect()
    assert auc([r["score"] for r in got], [r["doc_id"] % 4 != 0 for r in got]) > 0.99
    assert sum((r["score"] >= 0.3) == (r["doc_id"] % 4 != 0) for r in got) >= 0.97 * len(got)


def test_quality_on_awkward_rows(spark):
    docs = awkward_docs(spark, clash=True)
    stats = quality.with_statistics(docs, [F.col("doc_id")])
    both = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (7, 0, 0), (2, None, 0), (None, 0, 0)], LABELS)
    for labels, flat in ((both, None), (both.where("quality = 1"), 1.0), (both.limit(0), 0.0)):
        got = quality.score(stats, quality.learn(stats, labels, F.lit(True))).collect()
        assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got)
        assert flat is None or {r["score"] for r in got} == {flat}


# --- language model


def small_model():
    rng = np.random.default_rng(4)
    n = rng.integers(0, 50, lm.SIZE).astype(float)
    v = A.Vocabulary.of_counts(n)
    model = A.Model.of_counts(v, n, rng.integers(0, 9, (v.rows, A.CLASSES)).astype(float))
    model.with_clusters(rng.integers(0, 3, (A.CLUSTERS, lm.SIZE)).astype(float))
    for k in ("w1", "w2"):
        model.weights[k] = rng.normal(0, 0.3, model.weights[k].shape).astype(np.float32)
    return model


def test_probabilities_of_the_next_token_sum_to_one_and_look_back_only():
    model, rng = small_model(), np.random.default_rng(5)
    rows = rng.integers(0, model.vocabulary.rows, (1, A.WINDOW))
    place = np.zeros((A.CLASSES, A.WINDOW), bool)
    place[:, 9] = True
    p = 10.0 ** A.class_log10(model, np.repeat(rows, A.CLASSES, 0), place, np.arange(A.CLASSES))
    assert np.isclose(p.sum(), 1, atol=1e-4)
    share = 10.0 ** model.within[model.cluster[rows[0, 9]]].astype(float)
    assert np.allclose(np.bincount(model.vocabulary.cls, share, minlength=A.CLASSES), 1, atol=1e-3)
    assert np.allclose(np.log10(p), A.class_log10(model.folded(), np.repeat(rows, A.CLASSES, 0), place, np.arange(A.CLASSES)), atol=1e-4)
    later = rows.copy()
    later[0, 10:] = 0
    one = place[:1]
    assert np.isclose(A.class_log10(model, rows, one, np.array([7])), A.class_log10(model, later, one, np.array([7])))


def test_gradients_match_differences():
    model, rng = small_model(), np.random.default_rng(6)
    model.weights = {k: w.astype(np.float64) for k, w in model.weights.items()}
    rows, places = rng.integers(0, 40, (3, A.WINDOW)), rng.random((3, A.WINDOW)) < 0.5
    y = rng.integers(0, A.CLASSES, int(places.sum()))
    g = A.gradients(model, rows, places, y)
    loss = lambda: float(A.class_log10(model, rows, places, y).mean() * np.log(10))
    for k, at in [("emb", (int(rows[0, 3]), 2)), ("wq", (1, 2)), ("wk", (3, 4)), ("wv", (5, 6)), ("w1", (2, 3)), ("w2", (y[0] // 16, 4, 5)), ("rel", (0, 2))]:
        old = model.weights[k][at]
        model.weights[k][at] = old + 1e-3
        up = loss()
        model.weights[k][at] = old - 1e-3
        down = loss()
        model.weights[k][at] = old
        assert abs((up - down) / 2e-3 - g[k][at]) < 2e-3 + 0.05 * abs(g[k][at]), k


def test_windows_score_each_token_once_with_context():
    sizes = np.array([1, 16, 17, 0, 200])
    x, index, own = A.windows(np.arange(sizes.sum()), sizes, 9999)
    assert sorted(index[own]) == list(range(sizes.sum()))
    first = set(np.cumsum(sizes) - sizes)
    for w, t in zip(*np.nonzero(own)):
        i = index[w, t]
        assert x[w, t] == (9999 if i in first else i - 1)


def test_language_model_trains_on_every_window(spark):
    sizes = np.array([3, 16, 40, 90])
    texts = [np.arange(n, dtype="<u2").tobytes() for n in sizes]
    train = spark.createDataFrame([(bytearray(x),) for x in texts], "ids binary")
    model = lm.learn(train)
    assert np.abs(model.weights["w1"]).max() > 0  # short texts teach, too
    x, _, own = A.windows(np.arange(sizes.sum()), sizes, 9999)
    assert lm.average_round(train, model, 0.01, 0) == len(x) and own.sum() == sizes.sum()


def test_later_windows_look_back_at_least_eight_tokens():
    assert A.HEADS >= 2
    x, index, own = A.windows(np.arange(100), np.array([100]), 9999)
    seen = {index[w, t]: t + 1 for w, t in zip(*np.nonzero(own))}  # places up to the one that predicts
    assert all(n > min(8, i) for i, n in seen.items()) and np.mean(list(seen.values())) > 16


def test_attention_holds_at_large_scores():
    model, rng = small_model(), np.random.default_rng(8)
    model.weights["wq"] = model.weights["wq"] * np.float32(1e4)
    out = A.attend(model.weights, rng.integers(0, 40, (3, A.WINDOW)))[0]
    assert np.isfinite(out).all()


@pytest.mark.parametrize("times", [1.0, 30.0, -1e4])
def test_attention_equals_a_plain_softmax_from_any_place_on(times):
    model, rng = small_model(), np.random.default_rng(9)
    w = model.weights | {"wq": model.weights["wq"] * np.float32(times)}
    rows, dk = rng.integers(0, 40, (3, A.WINDOW)), A.WIDTH // A.HEADS
    want = np.zeros((3, A.WINDOW, A.WIDTH))
    for i, e in enumerate(w["emb"][rows].astype(float)):
        for h in range(A.HEADS):
            own = slice(h * dk, (h + 1) * dk)
            q, k, v = (e @ w[m][:, own].astype(float) for m in ("wq", "wk", "wv"))
            for t in range(A.WINDOW):
                z = k[: t + 1] @ q[t] + w["rel"][h, t::-1]
                a = np.exp(z - z.max())
                want[i, t, own] = a @ v[: t + 1] / a.sum()
    tolerance = 1e-3 if abs(times) < 100 else 0.5
    assert np.allclose(A.attend(w, rows)[0], want, atol=tolerance)
    assert np.allclose(A.attend(w, rows, A.EARLY)[0], want[:, A.EARLY :], atol=tolerance)
    assert np.allclose(A.attend(w, rows[:, : A.EARLY])[0], want[:, : A.EARLY], atol=tolerance)


def test_attention_is_worked_out_from_scoring_places_only(monkeypatch):
    model, plain, cells = small_model(), A.attend, []
    x, index, own = A.windows(np.arange(400) % 40, np.array([300, 100]), model.vocabulary.start)
    monkeypatch.setattr(A, "attend", lambda w, rows, lo=0: cells.append(rows.size * (rows.shape[1] - lo)) or plain(w, rows, lo))
    y = (index % A.CLASSES)[own]
    A.gradients(model, x, own, y)
    assert sum(cells) < 0.8 * x.size * A.WINDOW
    one = [A.class_log10(model, x[i : i + 1], own[i : i + 1], (index[i] % A.CLASSES)[own[i]]) for i in range(len(x))]
    assert np.allclose(A.class_log10(model, x, own, y), np.concatenate(one), atol=1e-4)


def test_runs_of_texts_are_read_from_a_batch_in_place():
    sizes = [3, 0, 5, 9, 0, 2, 40, 1]
    texts = [np.arange(n) + 100 * i for i, n in enumerate(sizes)]
    whole = pa.RecordBatch.from_arrays([pa.array([x.astype("<u2").tobytes() for x in texts], pa.binary())], ["ids"])
    for a, n in [(0, 8), (2, 5), (4, 1), (1, 1), (8, 0)]:
        got = list(lm._texts(whole.slice(a, n), 0, most=10))
        assert [i for at, upto, _, _ in got for i in range(at, upto)] == list(range(n))
        assert all(sum(own) <= 10 or len(own) == 1 for _, _, _, own in got)
        assert [x for *_, own in got for x in own] == sizes[a : a + n]
        assert [int(x) for _, _, ids, _ in got for x in ids] == [int(x) for t in texts[a : a + n] for x in t]


def test_training_steps_are_those_of_adam():
    model, rng = small_model(), np.random.default_rng(10)
    plain = A.Model(model.vocabulary, model.group, model.direct, model.cluster, model.within, dict(model.weights))
    rows, places = rng.integers(0, 40, (4, A.WINDOW)), np.ones((4, A.WINDOW), bool)
    y = rng.integers(0, A.CLASSES, rows.shape)
    trainer, m, v = A.Trainer(model, 0.01), {}, {}
    for step in range(1, 4):
        g = A.gradients(plain, rows, places, y[places])
        for k in A.LEARNED:
            m[k] = 0.9 * m.get(k, 0) + 0.1 * g[k]
            v[k] = 0.99 * v.get(k, 0) + 0.01 * g[k] ** 2
            plain.weights[k] = plain.weights[k] + np.float32(0.01) * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6))
        trainer.run(rows, places, y)
        assert all(np.allclose(model.weights[k], plain.weights[k], atol=2e-3) for k in A.LEARNED)


def test_language_model_base_by_count_and_score_beats_it(spark):
    docs = many_docs(spark, 700).union(awkward_docs(spark))
    rows = docs.collect()
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    hold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    got = lm.score(docs, hold, path, frequent=20).collect()
    low = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words(t)]
    c, n_train = {}, 0
    for r in rows:
        if crc(r["doc_id"], 10):
            n_train += 1
            for w in low(r["text"]):
                c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()) + n_train, len(c) + 1
    want = sorted((len(low(r["text"])) + 1, sum(w in c for w in low(r["text"])) + 1, sum(math.log10((c.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in low(r["text"])) + math.log10((n_train + 0.1) / (n + 0.1 * (v + 1)))) for r in rows)
    have = sorted((r["n_tokens"], r["n_known"], r["base_score"]) for r in got)
    assert len(have) == len(want) and {r["train_tokens"] for r in got} == {n}
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6 * max(1, abs(b[2])) for a, b in zip(have, want))
    held = [r for r in got if r["held_out"] and r["n_tokens"] < 1000]  # prose like the training rows
    assert all(r["score"] < 0 for r in got)
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_on_empty_tables_and_without_training_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = awkward_docs(spark, clash=True)
    assert lm.score(docs.limit(0), F.lit(False), path).count() == 0
    got = lm.score(docs, F.lit(True), path).collect()
    assert len(got) == 11 and {(r["train_tokens"], r["n_known"]) for r in got} == {(0, 0)}
    assert all(math.isfinite(r["base_score"]) and math.isfinite(r["score"]) for r in got)


# --- languages


def test_languages_of_pages(spark):
    docs = many_docs(spark, 400)
    pages, truth = [], {}
    for i, r in enumerate(docs.where("doc_id < 120").collect()):
        said = r["lang"] if i % 7 else "xx"
        pages.append((i, f"http://User@host{i % 5}.{r['lang']}.example.{r['lang']}:80/x", f"<html lang='{said}-AT'><script>var die='der';</script><p>{r['text']}</p></html>"))
        truth[i] = r["lang"]
    pages += [(200, "http://host1.de.example.de/", "<html></html>"), (201, None, None), (202, "no address", "<html lang=en>"), (202, "no address", "<html lang=en>")]
    got = langid.identify(spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("lang", F.lit(1)).withColumn("read", F.lit(2)), docs).collect()
    assert len(got) == len(pages)
    by = {r["page_id"]: r for r in got}
    assert all(by[i]["lang"] == t and by[i]["suffix"] == t for i, t in truth.items())
    assert by[200]["lang"] == "de" and by[200]["text_lang"] is None
    assert by[201]["host"] == "" and by[202]["lang"] == "en" and by[0]["declared"] == "other"
    assert {r["lang"] for r in langid.identify(spark.createDataFrame(pages, "page_id bigint, url string, html string"), docs.limit(0)).collect()} == {None}
    assert langid.identify(spark.createDataFrame([], "page_id bigint, url string, html string"), docs).count() == 0


@pytest.mark.parametrize("page", ["<meta content-language ", "<script ", "<!-- a ", "<html ", "<html lang=", "<meta content-language content= ", "< ", "&a", "<html lang" + " " * 50])
def test_page_scanners_stay_linear_on_unclosed_tags(page):
    import time

    page = page * ((1 << 20) // len(page))
    began = time.thread_time()
    assert isinstance(langid.visible(page), bytes) and langid.declared(page) in ("", "con")
    assert time.thread_time() - began < 1.0


def test_page_scanners_read_as_stated():
    seen = lambda page: b" ".join(langid.visible(page).split())
    assert seen("a<b>c</b><SCRIPT x>no</SCRIPT >d<!-- no > no -->e&amp;f<style>no</style>g") == b"a c d e f g"
    assert seen("a <script>never closed <p>b") == b"a" and seen("a <!-- b <p> c") == b"a" and seen("a <b c") == b"a" and seen(None) == b""
    said = langid.declared
    assert said('<HTML class=x LANG = "De-AT"><html lang=fr>') == "de" and said("<html><meta http-equiv='Content-Language' content='fr'>") == "fr"
    assert said("<meta content='es' http-equiv=content-language>") == "" and said("<html xlang=de data='>' lang=fr") == "" and said("<p lang=de>") == "" and said(None) == ""


def test_languages_match_a_plain_fusion(spark):
    """Every page's posterior, from counts in dictionaries."""
    docs = many_docs(spark, 200)
    pages, rng = [], np.random.default_rng(3)
    for i, r in enumerate(docs.where("doc_id < 90").collect()):
        words_ = " ".join(r["text"].split()[: rng.integers(0, 12)])
        said = ["", "de", "en", "xx"][rng.integers(4)]
        pages.append((i, f"http://h{rng.integers(4)}.{['com', 'de'][rng.integers(2)]}/{i}", f"<html lang={said}>{words_}"))
    pages += [(None, None, None), (500, "http://h1.com/", ""), (500, "http://h1.com/", "")]
    got = langid.identify(spark.createDataFrame(pages, "page_id bigint, url string, html string"), docs).collect()
    names, logp = langid.learn_texts(docs)
    k, votes, rows = len(names), {}, []
    told = [dict.fromkeys(("", "other", *names), 1.0) for _ in names]
    for page_id, url, html in pages:
        host, suffix = langid.host_of(url)
        text, said = langid.visible(html), langid.declared(html)
        said = said if said in names or not said else "other"
        like = [sum(logp[n][g] for g in langid.trigrams(text)) if text.strip() else 0.0 for n in range(k)]
        read = int(np.argmax(like)) if text.strip() else None
        rows.append((page_id, host, suffix, said, like, read))
        if read is not None:
            told[read][said] += 1
            for key in ("all", ("s", suffix), ("h", suffix, host)):
                votes.setdefault(key, [0.0] * k)[read] += 1
    want = []
    for page_id, host, suffix, said, like, read in rows:
        less = [float(read == n) for n in range(k)]
        base = [(v + 1) / (sum(votes["all"]) + k) for v in votes["all"]]
        for key, weight in ((("s", suffix), langid.SUFFIX_WEIGHT), (("h", suffix, host), langid.HOST_WEIGHT)):
            own = [v - o for v, o in zip(votes.get(key, [0.0] * k), less)]
            base = [(v + weight * b) / (sum(own) + weight) for v, b in zip(own, base)]
        post = [langid.TEMPER * like[n] + np.log(base[n]) + np.log(told[n][said] / sum(told[n].values())) for n in range(k)]
        p = np.exp(np.array(post) - max(post))
        want.append((page_id, names[int(p.argmax())], round(float(p.max() / p.sum()), 9)))
    assert sorted(((r["page_id"], r["lang"], round(r["confidence"], 9)) for r in got), key=str) == sorted(want, key=str)
