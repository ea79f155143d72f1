"""Held-out accuracy of language identification and toxicity; edges."""

import numpy as np
from pyspark.sql import functions as F

from fathomline.llm import langid, toxicity
from fathomline.llm.common import read_table

from .helpers import documents

SF = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out_rows(spark):
    docs = read_table(spark, SF, "documents")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'")
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 100 and right > 0.95


def test_language_edges(spark):
    docs = documents(spark, ["the cat and the dog " * 5, "der hund und die katze " * 5, None, "", "123 !?", "la " * 30_000], langs=["en", "de"])
    wide = docs.withColumn("held_out", F.lit(1)).withColumn("score", F.lit("x"))
    out = {r.doc_id: r for r in langid.identify(wide.union(wide)).collect()}
    assert [out[d].lang_pred for d in (3, 4, 5)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in out.values())
    assert langid.identify(docs.limit(0)).count() == 0
    nothing = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and {r.score for r in nothing} == {0.0}


def test_toxicity_of_rows_that_it_was_not_fitted_on(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    out = toxicity.toxicity(docs, labels.filter(~fold)).join(labels.filter(fold).filter("toxic is not null").select("doc_id", F.col("toxic").alias("label")), "doc_id").toPandas()
    assert len(out) > 30 and np.mean(out["toxic"].astype(int) == out["label"]) > 0.9


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3))
    first = (x[:, 0] > 0).astype(float)
    chain = toxicity.Chain.fit(x, [first, first], np.ones(600), np.arange(600) % 5)
    assert [len(m) for m in chain.models] == [4, 5] and chain.models[1][3] > 0
    assert ((chain.predict(x)[:, 1] > 0.5) == first).mean() > 0.95


def test_toxicity_edges(spark):
    docs = documents(spark, ["a fine text", None, "", "x " * 30_000])
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    wide = docs.union(docs).withColumn("toxic", F.lit(1)).withColumn("weight", F.lit(1)).withColumn("y0", F.lit(1))
    assert toxicity.toxicity(wide, labels).filter("not toxic").count() == 8
    assert toxicity.toxicity(docs, labels.limit(0)).filter("toxic or p_toxic > 0").count() == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
