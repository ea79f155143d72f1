"""Base counts against plain Python; planted outliers."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fathomline.llm import quality

from .helpers import WORDS, documents, sentence


def brute(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    held = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    counts = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(held))
    return (*counts, len(words) < 10 or 100 * len(held) > 20 * len(words))


def test_base_counts_and_outliers(spark):
    rng = random.Random(3)
    good = [f"{sentence(rng, rng.randrange(20, 200)).capitalize()}." for _ in range(300)]
    junk = [" ".join("##$$%%" for _ in range(60)) + f" {k}" for k in range(5)] + [" ".join(["qq" + "zzzz" * 40] * 3 + ["A B C"] * k + ["yy" * 90] * 30) for k in (2, 3)]
    odd = [None, "", " \n\t", "one two", "a b c d e f g h i j\n" * 3, "é ü ß " * 8, "word " * 50_000]
    docs = documents(spark, good + junk + odd)
    out = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for r in docs.collect():
        assert (*out[r.doc_id][1:6], out[r.doc_id].base_failed) == (brute(r.text)[0], *brute(r.text)[1:5], brute(r.text)[5])
    assert sum(out[d].kept for d in range(1, 301)) >= 297
    assert not any(out[d].kept for d in range(301, 308))
    assert sorted(r.doc_id for r in quality.kept_documents(docs).collect()) == sorted(d for d, r in out.items() if r.kept)


def moments(v):
    return quality._from_moments(len(v), v.sum(0), np.array([(v[:, i] * v[:, j]).sum() for i in range(quality.DIMS) for j in range(i + 1)]))


def squared_distances(v, centre, packed):
    factor = np.zeros((quality.DIMS,) * 2)
    factor[np.tril_indices(quality.DIMS)] = packed
    return np.square((v - centre) @ factor.T).sum(1)


def test_rejects_what_an_estimate_in_memory_rejects(spark):
    """The smallest determinant that 300 random starts in memory come to, each by concentration steps on whole rows."""
    rng = np.random.default_rng(7)
    tables = {}
    for cell, (n, planted) in {"few": (60, 12), "many": (400, 90), "clean": (200, 0)}.items():
        v = rng.normal(1.0, 0.25, (n, quality.DIMS)) @ (np.eye(quality.DIMS) + 0.3 * rng.normal(size=(quality.DIMS,) * 2))
        v[:planted] += rng.normal(5.0, 0.5, (planted, quality.DIMS))
        tables[cell] = (v, planted)
    rows = spark.createDataFrame([(c, k, x.tolist()) for c, (v, _) in tables.items() for k, x in enumerate(v)], "cell string, k int, v array<double>")
    cells = spark.createDataFrame([(c, len(v)) for c, (v, _) in tables.items()], "cell string, m long")
    out = rows.join(quality._estimates(rows, cells), "cell").select("cell", "k", (quality._distance() / F.col("scale") > quality.CUT).alias("out")).toPandas()
    for cell, (v, planted) in tables.items():
        best, h = (np.inf, None), int(np.ceil(quality.SUBSET * len(v)))
        for _ in range(300):
            subset, before = rng.choice(len(v), quality.DIMS + 1, replace=False), np.inf
            while True:
                centre, packed, det = moments(v[subset])
                if len(subset) == h and det >= before - 1e-9:
                    break
                before = det if len(subset) == h else np.inf
                subset = np.argsort(squared_distances(v, centre, packed))[:h]
            best = min(best, (det, tuple(subset)))
        centre, packed, _ = moments(v[list(best[1])])
        d = squared_distances(v, centre, packed)
        wanted = d / max(1.0, np.median(d) / quality.MEDIAN_LAW) > quality.CUT
        mine = out[out["cell"] == cell].sort_values("k")["out"].to_numpy()
        assert mine[:planted].all() and wanted[:planted].all()
        assert (mine == wanted).mean() >= 0.98 and mine[planted:].sum() <= 1 + 0.01 * len(v), cell


def test_edges(spark):
    docs = documents(spark, ["plain words make up this short text of ten words", None])
    assert quality.quality_rules(docs.limit(0)).count() == 0
    wide = docs.union(docs).withColumn("lang", F.lit(None).cast("string")).withColumn("cell", F.lit(1)).withColumn("v", F.lit(1)).withColumn("_kept", F.lit(1)).withColumn("n_words", F.lit("x"))
    assert quality.quality_rules(wide).count() == 4
    assert quality.kept_documents(wide).columns == wide.columns
