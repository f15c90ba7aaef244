"""Registered corpus queries: names, SQL comparison, and the pipeline against its stages' plain rules."""

import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from check import compare, duck  # noqa: E402
from helpers import awkward_docs, many_docs, words  # noqa: E402
from test_llm_files import check_pieces  # noqa: E402
from test_llm_rules import plain_statistics  # noqa: E402
from test_llm_simhash import components, plain_fingerprint  # noqa: E402

from evalgrid.llm import queries as Q  # noqa: E402


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 14))
    assert set(Q.oracle_sql()) <= set(Q.queries())


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    con = duck("sf0.001")
    result, _, _ = compare(spark, con, name, SimpleNamespace(build=Q.queries()[name], sql=Q.oracle_sql()[name]), "sf0.001")
    con.close()
    assert result.startswith("ok"), result


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = many_docs(spark, 400)
    copies = docs.where("doc_id < 60").selectExpr("doc_id + 1000 AS doc_id", "text || ' again' AS text", "lang", "source", "n_chars")
    docs = docs.union(copies).union(docs.where("doc_id < 20")).union(awkward_docs(spark))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 300)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, folder).cache()
        assert docs.columns == before.columns == corpus_pipeline.DOCUMENT_COLUMNS, name
        seen[name] = before.collect(), docs.collect()
    before, after = seen["quality_rules"]
    passing = [r for r in before if not plain_statistics(r["text"])[-1]]
    assert set(after) <= set(passing) and len(after) >= 0.98 * len(passing)
    assert sorted(map(str, seen["toxicity"][0])) == sorted(map(str, seen["toxicity"][1]))
    before, after = seen["near_duplicates"]
    fp = [plain_fingerprint(r["text"]) for r in before]
    pairs = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3]
    root, groups = components(range(len(fp)), pairs), {}
    for i, r in enumerate(before):
        groups.setdefault(root[i], []).append(r)
    want = [min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))["doc_id"] for g in groups.values()]
    assert sorted(r["doc_id"] for r in after) == sorted(want)
    before, after = seen["mixing"]
    size = sum(len(words(r["text"])) for r in before)
    assert abs(sum(len(words(r["text"])) for r in after) - 1.5 * size) <= 0.05 * size
    assert max(after.count(r) for r in before) <= 2
    whole = docs.dropDuplicates()
    check_pieces(corpus_pipeline.pack_sequences(spark, whole, folder).collect(), {r["doc_id"]: r["text"] for r in whole.collect()})
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_pipeline_on_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
