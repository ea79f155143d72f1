"""Targets against plain Python; what the mix takes."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from fathomline.llm import mixing

from .helpers import WORDS, documents


def brute_targets(sizes):
    """sizes: source to words; the excess over twice the size is reshared by weight until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    open_, out, left = set(order), {}, 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        open_ -= over
    return out


def table(spark):
    rng = np.random.default_rng(6)
    sources = ["web", "code", None, "books", "Zeta", "é"]
    pick = rng.choice(len(sources), 900, p=[0.6, 0.02, 0.08, 0.2, 0.05, 0.05])
    texts = ["w " * int(n) for n in rng.integers(0, 120, 900)] + [None, "", "w " * 30_000]
    return documents(spark, texts, sources=[sources[k] for k in pick])


def test_targets_and_taken_words(spark):
    docs = table(spark)
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(WORDS.findall(r.text or ""))
    wanted, taken, largest = brute_targets(sizes), defaultdict(int), defaultdict(int)
    source = {r.doc_id: r.source for r in docs.collect()}
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        s = source[r.doc_id]
        assert abs(r.target - wanted[s]) < 1e-6 * max(1, wanted[s]) and r.source_size == sizes[s]
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s, t in wanted.items():
        assert abs(taken[s] - t) <= 2 * largest[s]
    copies = {r.doc_id: r.taken // r.size if r.size else 0 for r in rows}
    assert mixing.mixed_documents(docs.filter("text <> ''")).count() > 0
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows} and set(copies.values()) <= {0, 1, 2}
    mixed = mixing.mixed_documents(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in mixed if copies[r.doc_id]} == {d: c for d, c in copies.items() if c}


def test_pivot_settles_all_but_one_and_keeps_words():
    rng = np.random.default_rng(1)
    p, size = rng.random(500), rng.integers(1, 50, 500).astype(float)
    out, left = mixing.pivot(p, size, rng)
    assert abs(p @ size - out @ size) < 1e-6 and all(x in (0, 1) for k, x in enumerate(out) if k != left)


def test_edges(spark):
    docs = documents(spark, ["a b", None, ""], sources=[None])
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0
    wide = docs.union(docs).withColumn("h", F.lit("x")).withColumn("_place", F.lit(1)).withColumn("_copies", F.lit(1)).withColumn("_copy", F.lit(1)).withColumn("_doc_id", F.lit(1)).withColumn("size", F.lit(9))
    assert mixing.mix(wide).count() == 6
    assert mixing.mixed_documents(wide).columns == wide.columns


def test_sources_come_near_their_targets(spark):
    """Each source's taken words are within a hundredth of its target or its smallest document, however sizes are spread."""
    rng = random.Random(31)
    texts, sources = [], []
    for s in range(12):
        for _ in range(rng.randrange(20, 80)):
            texts.append(" ".join(["w"] * max(1, int(rng.paretovariate(0.8) * 10) % 3000)))
            sources.append(f"s{s:02d}")
    docs = spark.createDataFrame([(k, t, "en", s, len(t)) for k, (t, s) in enumerate(zip(texts, sources))], "doc_id long, text string, lang string, source string, n_chars int").withColumnRenamed("n_chars", "n")
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    for s in set(sources):
        mine = [r for r in rows if r.source == s]
        smallest = min(r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(smallest, 0.01 * mine[0].target), s
        assert all(r.taken in (0, r.size, 2 * r.size) for r in mine)
