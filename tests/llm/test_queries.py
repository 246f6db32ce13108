"""Registered queries on the smallest tables: SQL where there is some, plain versions else, and the pipeline's stages."""

import os

import pytest

from ratiocert.llm.queries import QUERIES, SQL
from tests.compare import compare, connection

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_sql(spark, key):
    state, _, _ = compare(spark, connection(SF), QUERIES[key], SQL[key], SF)
    assert state == "exact", state


def test_one_query_an_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def documents(spark):
    return {x["doc_id"]: x for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_jaccard_query(spark, documents):
    from .test_joins import plain_jaccard

    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in QUERIES["op6_jaccard_join"](spark, SF).collect()}
    assert got == plain_jaccard([(i, x["text"]) for i, x in documents.items()], 4, 85)


def test_suffix_query(spark, documents):
    from .test_joins import plain_removal

    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"]) for x in QUERIES["op1_suffix_dedup"](spark, SF).collect()}
    want = plain_removal([(i, x["text"]) for i, x in documents.items()], 50)
    assert got == {i: (n, removed, len(spans)) for i, (n, removed, spans, _) in want.items()}


def test_language_query_on_held_out_rows(spark, documents):
    got = [x for x in QUERIES["op2_language_crf"](spark, SF).collect() if x["held_out"]]
    assert len(got) > 30 and sum(x["lang_pred"] == documents[x["doc_id"]]["lang"] for x in got) >= 0.95 * len(got)


def test_pipeline(spark, documents):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language", "near duplicates", "decontamination", "personal data", "mixing"]
    docs = p.table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = p.cut_lineage(stage(spark, docs, SF))
        assert docs.columns == columns and docs.count() <= before, name
        before = docs.count()
    kept = {x["doc_id"] for x in docs.collect()}
    from .test_joins import plain_jaccard

    groups = plain_jaccard([(i, x["text"]) for i, x in documents.items()], 5, 80)
    assert all(groups[i][1] == i for i in kept)
    mixed = p.run(spark, SF)
    assert {x["doc_id"] for x in mixed.collect()} == kept


def test_pipeline_on_odd_rows(spark, odd, nothing):
    import corpus_pipeline as p

    narrow = ["doc_id", "text", "lang", "source", "n_chars"]
    for table, least in ((odd.select(narrow), 1), (nothing.select(narrow), 0)):
        docs = table
        for _, stage in p.STAGES:
            docs = p.cut_lineage(stage(spark, docs, SF))
        assert docs.count() >= least
