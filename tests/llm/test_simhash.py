"""Fingerprints and components against all pairs."""

import random
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from fathomline.llm import simhash
from fathomline.llm.common import connected_components

from .helpers import WORDS, components, documents, lower, sentence


def brute_fingerprint(text):
    words = WORDS.findall(lower(text)) if text else []
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def texts():
    rng = random.Random(4)
    out = [sentence(rng, rng.randrange(1, 60)) for _ in range(60)]
    for k in range(40):  # near copies of long texts
        words = sentence(random.Random(k), 400).split()
        out.append(" ".join(words))
        words[k * 3] = "CHANGED"
        out.append(" ".join(words))
    return out + out[:5] + [None, "", " \t\n", "Two words", "two WORDS", "x" * 300_000, "näher wort ÄÖ"]


def test_components_equal_all_pairs(spark):
    docs = documents(spark, texts())
    rows = docs.collect()
    prints = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    wanted = components(prints, [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    mine = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert mine == {d: (f"{prints[d]:016x}", wanted[d]) for d in prints}
    assert len(set(wanted.values())) < len(wanted)


def test_links_equal_all_pairs_of_close_fingerprints(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(60)})
    df = spark.createDataFrame([(simhash._signed(p), k) for k, p in enumerate(prints)], "fp long, node long")
    mine = sorted(tuple(sorted(r)) for r in simhash.links(df).collect())
    wanted = [(a, b) for a, b in combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert mine == wanted


def shingles(text):
    words = WORDS.findall(lower(text)) if text else []
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}


def test_near_duplicates_against_common_shingles(spark):
    """One row of each group of texts with most shingles in common stays, and nothing else goes."""
    rng = random.Random(12)
    plain = [sentence(rng, rng.randrange(30, 300), 5000) for _ in range(40)]
    copies = []
    for k in range(60):  # up to one word in 100 is another
        words = plain[k % 20].split()
        for _ in range(len(words) // 100):
            words[rng.randrange(len(words))] = f"other{k}"
        copies.append(" ".join(words))
    docs = documents(spark, plain + copies + [None, "", " ", "x" * 300_000])
    rows = {r.doc_id: shingles(r.text) for r in docs.collect()}
    wanted = components(rows, [(a, b) for a, b in combinations(rows, 2) if len(rows[a] & rows[b]) >= 0.8 * len(rows[a] | rows[b])])
    kept = {r.doc_id for r in simhash.near_duplicates_removed(docs).collect()}
    assert kept >= set(wanted.values())
    assert len(rows) - len(kept) >= 0.9 * (len(rows) - len(set(wanted.values())))
    assert kept == {r.doc_id for r in simhash.near_duplicates_removed(docs.repartition(5)).collect()}


def test_rows_without_an_id_are_linked(spark):
    words = sentence(random.Random(3), 400).split()
    copies = (" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in range(400))
    other = next(c for c in copies if (brute_fingerprint(" ".join(words)) ^ brute_fingerprint(c)).bit_count() in (1, 2))
    docs = documents(spark, [" ".join(words), other]).withColumn("doc_id", F.when(F.col("doc_id") == 1, F.lit(7).cast("long")))
    assert [r.component_id for r in simhash.simhash_components(docs).collect()] == [7, 7]


def test_a_hub_of_many_links(spark):
    """Components of a star, a chain and pairs, with more edges than one task should join."""
    edges = spark.range(120_000).select(F.lit(500_000).alias("src"), F.col("id").alias("dst"))
    chain = spark.range(40).select((F.col("id") + 1_000_000).alias("src"), (F.col("id") + 1_000_001).alias("dst"))
    found = connected_components(edges.union(chain).union(edges.limit(10)))
    assert found.groupBy("component").count().orderBy("component").collect() == [(0, 120_001), (1_000_000, 41)]


def test_edges(spark):
    docs = documents(spark, ["a b c d", "a b c d", None])
    assert simhash.simhash_components(docs.limit(0)).count() == 0
    again = docs.union(docs).withColumn("fp", F.lit(1)).withColumn("node", F.lit("x")).withColumn("component_id", F.lit(2))
    assert sorted((r.doc_id, r.component_id) for r in simhash.simhash_components(again).collect()) == [(1, 1), (1, 1), (2, 1), (2, 1), (3, 3), (3, 3)]
    assert simhash.near_duplicates_removed(again).columns == again.columns
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert simhash.simhash_components(nameless).filter("component_id is null").count() == 3


def test_recall_of_near_copies_that_differ(spark):
    """Every copy has at least one other word; pairs with over 0.85 of their five-word shingles in common are found, unlike texts stay."""
    rng = random.Random(21)
    texts = []
    for k in range(150):
        words = sentence(rng, rng.randrange(60, 400), 5000).split()
        texts.append(" ".join(words))
        copy = list(words)
        for j in range(max(1, int(len(words) * rng.uniform(0.001, 0.014)))):
            copy[rng.randrange(len(copy))] = f"other{k}x{j}"
        texts.append(" ".join(copy))
    sets = [shingles(t) for t in texts]
    alike = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    found = {r.doc_id for r in simhash.near_duplicates_removed(documents(spark, texts)).collect()}
    should, gone = [k for k, j in enumerate(alike) if j >= 0.85], [2 * k + 2 not in found for k in range(150)]
    assert len(should) > 100 and sum(gone[k] for k in should) >= 0.9 * len(should)
    assert not any(gone[k] for k, j in enumerate(alike) if j < 0.7) and all(2 * k + 1 in found for k in range(150))


def meet_in_index(a, b):
    """Whether two texts share a band or have index fingerprints at 2 or fewer bits."""
    long, short = ([simhash._shingle_hashes(simhash._words(t.encode()), n) for t in (a, b)] for n in (simhash.VERIFY_WORDS, simhash.INDEX_WORDS))
    bands, (x, y) = map(simhash._bands, long), (simhash._majority(simhash._mixed(h, 0)) for h in short)
    return any(p == q for p, q in zip(*bands)) or (x ^ y).bit_count() <= simhash.MOST_BITS


def test_all_links_at_the_threshold(spark, monkeypatch):
    """Exactly one row of each group stays: of pairs that the index doesn't find, of pairs about the threshold, of a family of texts that are near some of each other."""
    rng = random.Random(31)
    texts, missed = [], 0
    while missed < 3 or len(texts) < 120:
        words = sentence(rng, rng.randrange(5, 200), 5000).split()
        copy, changes = list(words), max(1, round(len(words) * rng.uniform(0.02, 0.027)))
        for j in range(changes):  # spread out, so that each change takes five shingles
            copy[min(len(copy) - 1, (2 * j + 1) * len(copy) // (2 * changes))] = f"other{len(texts)}x{j}"
        pair = [" ".join(words), " ".join(copy)]
        a, b = map(shingles, pair)
        lost = 5 * len(a & b) >= 4 * len(a | b) and not meet_in_index(*pair)
        if lost or len(texts) < 120:
            texts, missed = texts + pair, missed + lost
    base = sentence(rng, 120, 5000).split()
    for k in range(60):
        copy = list(base)
        for j in rng.sample(range(2, 118), 4):
            copy[j] = f"word{k % 3}x{j}"
        texts.append(" ".join(copy))
    docs = documents(spark, texts)
    rows = {k: shingles(t) for k, t in enumerate(texts, 1)}
    linked = [(a, b) for a, b in combinations(rows, 2) if 5 * len(c := rows[a] & rows[b]) >= 4 * (len(rows[a]) + len(rows[b]) - len(c))]
    wanted = set(components(rows, linked).values())
    assert {r.doc_id for r in simhash.near_duplicates_removed(docs).collect()} == wanted
    # The index is no part of the result: without its links the shingles find them all, those of many texts in blocks.
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "_similar", lambda classes: spark.createDataFrame([], "src long, dst long"))
    assert {r.doc_id for r in simhash.near_duplicates_removed(docs).collect()} == wanted


def test_long_unlike_texts_are_sifted(spark, monkeypatch):
    """Texts of any length that share a passage, but not SIMILARITY, are not held against each other on their shingles; near ones of the same length are."""
    rng, pairs = random.Random(41), []
    texts = []
    for k in range(8):
        passage = [f"p{k}x{j}" for j in range(150)]
        texts += [" ".join(passage + [f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(3000, 3600))]) for _ in range(2)]
    words = texts[0].split()
    for at in range(400, 2800, 40):  # too few changes to part them, too many for a band
        words[at] = f"other{at}"
    docs = documents(spark, [*texts, " ".join(words)])
    real = simhash._verified
    monkeypatch.setattr(simhash, "_similar", lambda classes: spark.createDataFrame([], "src long, dst long"))
    monkeypatch.setattr(simhash, "_verified", lambda docs, key, found, classes: (pairs.append(found.count()), real(docs, key, found, classes))[1])
    assert {r.doc_id for r in simhash.near_duplicates_removed(docs).collect()} == set(range(1, 17))
    assert pairs == [0, 1]


def test_parities_bound_the_difference():
    """Parities never differ in more buckets than there are shingles in one set only, also of sets with unlike numbers of buckets."""
    rng = random.Random(6)
    for n, m in ((0, 3), (900, 1100), (1000, 5000), (4000, 4200), (5000, 20_000)):
        a = {rng.getrandbits(64) for _ in range(n)}
        for b in ({rng.getrandbits(64) for _ in range(m)}, {*list(a)[: n // 2], *(rng.getrandbits(64) for _ in range(m))}):
            (x, p), (y, q) = (simhash._parities(np.array([*s] * 2, np.uint64)) for s in (a, b))
            assert (x, y) == (len(a), len(b)) and len(a ^ b) % 2 == simhash._apart(p, q) % 2
            assert simhash._apart(p, q) == simhash._apart(q, p) <= len(a ^ b)


def test_rows_that_stay_are_not_shuffled(spark):
    """Only rows that go, or that are there more than once, meet the keys that stay."""
    rng = random.Random(8)
    docs = documents(spark, [sentence(rng, 40, 5000) for _ in range(60)])
    docs = docs.union(docs.limit(5)).union(docs.filter("doc_id > 50").withColumn("doc_id", F.col("doc_id") + 100)).withColumn("a.b", F.lit("x"))
    out = simhash.near_duplicates_removed(docs)
    assert "Union" in out._jdf.queryExecution().optimizedPlan().toString() and out.columns == docs.columns
    assert sorted(out.collect()) == sorted(docs.filter("doc_id <= 60").distinct().collect())
