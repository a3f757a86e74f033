"""Registered queries on the smallest tables: oracles where SQL has one, the pipeline stage by stage."""

import os

import duckdb
import pytest

import corpus_pipeline
from palisade.llm import queries, simhash
from palisade.llm.common import materialize, shared_folder, table


def canon(value):
    return repr(round(value, 9)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    frame, answer = queries.QUERIES[name](spark, sf), con.sql(queries.ORACLES[name])
    cols = sorted(frame.columns)
    assert cols == sorted(answer.columns)
    at = [answer.columns.index(c) for c in cols]
    assert sorted(tuple(canon(r[c]) for c in cols) for r in frame.collect()) == sorted(
        tuple(canon(r[i]) for i in at) for r in answer.fetchall()
    )


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_one_row_per_document(spark, sf, name):
    rows = queries.QUERIES[name](spark, sf).collect()
    ids = [r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()]
    if name == "op9_packing":
        assert {r.doc_id for r in rows} == set(ids)
    else:
        assert sorted(r.doc_id for r in rows) == sorted(ids)


def test_a_cluster_must_name_its_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session)
    Session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session)


def test_the_language_stage_keeps_clashing_columns(spark, sf):
    docs = table(spark, sf, "documents").limit(120).selectExpr("*", "'p' AS prediction", "'r' AS row", "1 AS c0")
    out = corpus_pipeline.language(spark, docs, sf)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all((r.prediction, r.row, r.c0) == ("p", "r", 1) for r in rows)


def test_pipeline_stages(spark, sf):
    docs = table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = set(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), "test-stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = docs.collect()
        now = {r.doc_id for r in rows}
        assert now <= left and len(now) == len(rows) and all(texts[r.doc_id] == r.text for r in rows)
        if name == "language":
            assert now == left
        if name == "quality":
            assert all(len(texts[i].encode().split()) >= 50 for i in now)
        if name == "exact":
            squeezed = {"".join(texts[i].encode().decode().split()) for i in left}
            assert len({"".join(texts[i].split()) for i in now}) == len(now) == len(squeezed)
        if name == "near":
            prints = {i: simhash.fingerprint(texts[i].encode()) for i in left}
            for i in now:
                assert not any(j != i and (prints[i] ^ prints[j]).bit_count() <= 2 for j in now)
        left = now
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in placed} == left


def test_stages_without_rows(spark, sf):
    docs = table(spark, sf, "documents").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.collect() == []
