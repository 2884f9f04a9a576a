"""The pipeline against its operators, the registered queries against SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tillpoint.llm import decontaminate, jaccard_join, mixing, queries

SF = "/root/testdata/sf0.001"


def test_every_operator_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).to_arrow_table().to_pandas()
    got = queries.QUERIES[name](spark, SF).toPandas()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert got.equals(want.astype(got.dtypes.to_dict()))


def test_stages_take_effect_one_after_the_other(spark, scratch):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{scratch}/{k}")
        docs = spark.read.parquet(f"{scratch}/{k}")
        kept[name] = docs
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    first = kept["quality classifier"].join(labels, "doc_id")
    assert first.filter("quality = 0").count() <= 1 and first.filter("quality = 1").count() >= 0.97 * labels.filter("quality = 1").count()
    assert jaccard_join.jaccard_join(kept["n-gram Jaccard join"]).filter("class_docs > 1").count() == 0
    found, names = decontaminate.scan(kept["benchmark decontamination"], spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert found.filter(F.col(names["n_hit"]) > 0).count() == 0
    size = lambda d: d.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert 1.3 < size(kept["mixing"]) / size(kept["benchmark decontamination"]) < 1.7
    last = kept["token files"].collect()
    assert len(last) == kept["mixing"].count()
    at = 0
    for r in sorted(last, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(whole.collect()) == sorted(last)


def test_stages_with_odd_and_empty_documents(spark):
    rows = [(1, None, None, None, None), (None, "some words here to keep", "en", None, 3), (None, "some words here to keep", "en", None, 3),
            (2, "", "en", "s", 0), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() <= 2 * len(rows), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_the_rest_does_not_import_the_subpackage():
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for folder, _, files in os.walk(os.path.join(root, "tillpoint")):
        if os.sep + "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as source:
                        assert "tillpoint.llm" not in source.read(), f
