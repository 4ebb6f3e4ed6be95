"""Registered queries against their SQL, and the pipeline's stages one by one."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import catalog, neardup, pii, repeats, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert ours == sorted((tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall()), key=repr)


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    at, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, at = at, stage(spark, at, DATA).cache()
        assert at.columns == corpus_pipeline.COLUMNS
        assert at.where(F.col("n_chars") != F.length("text")).count() == 0 or name in ("toxicity", "near_duplicates")
        kept.append((before, at))
    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.score_documents(docs, model).where(F.col("score") < toxicity.THRESHOLD).collect()}
    assert {r.doc_id for r in kept[0][1].collect()} == clean
    _, found = neardup.components(kept[1][0])
    assert {r.doc_id for r in kept[1][1].collect()} == {r.component_id for r in found.collect()}
    whole = {r.doc_id: r.n_removed for r in repeats.mark_repeats(kept[2][0]).collect()}
    assert {r.doc_id for r in kept[2][1].collect()} == set(whole)
    assert sum(whole.values()) > 0
    assert {r.doc_id for r in kept[3][1].collect()} == set(whole)
    again = pii.pseudonymise(kept[3][0], pii.EXAMPLE_KEY).agg(F.sum(F.expr("pii.card + pii.phone + pii.ip + pii.email + pii.secret"))).first()[0]
    changed = kept[3][0].alias("a").join(kept[3][1].alias("b"), "doc_id").where("a.text <> b.text").count()
    assert 0 < changed <= again


def test_whole_run(spark):
    pieces = corpus_pipeline.run(spark, DATA)
    sizes = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(r.n & (r.n - 1) == 0 and r.n <= 4096 for r in sizes)
    whole = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("m")).collect()
    assert whole and all(r.n == r.m for r in whole)
