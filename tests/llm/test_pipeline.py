"""Each stage on what its predecessor kept."""

import random

import corpus_pipeline
from fathomline.llm import decontaminate, mixing, quality, simhash
from fathomline.llm.common import cut, read_table

from .helpers import sentence

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark):
    docs, seen = read_table(spark, SF, "documents"), []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "mixing"]
    for _, stage in corpus_pipeline.STAGES:
        seen.append((docs, docs := cut(stage(spark, docs, SF))))
    (d0, d1), (_, d2), (_, d3), (_, d4), (_, d5) = seen
    assert all(sorted(after.columns) == sorted(d0.columns) for _, after in seen[:-1])
    assert ids(d1) == ids(quality.quality_rules(d0).filter("kept"))
    assert ids(d2) == ids(d1)
    words = {r.doc_id: tuple((r.text or "").lower().split()) for r in d2.collect()}
    first = {}
    for d in sorted(words):
        first.setdefault(words[d], d)
    assert set(ids(d3)) <= set(first.values()) and len(ids(d3)) > 0.8 * len(first)
    assert ids(d4) == ids(decontaminate.contamination(d3, read_table(spark, SF, "benchmark")).filter("not contaminated"))
    copies = {r.doc_id: r.taken // r.size for r in mixing.mix(d4).collect() if r.size}
    assert ids(d5) == sorted(d for d, c in copies.items() for _ in range(c))


def test_empty_table(spark):
    docs = read_table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF))
    assert docs.count() == 0


def test_null_and_repeated_ids(spark):
    """Rows are told apart by more than their doc_id, in every stage that removes or weighs rows."""
    rng = random.Random(8)
    texts = [sentence(rng, 40, 10_000) for _ in range(60)]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    table = lambda rows: spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], schema)
    held = lambda df: sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in df.collect()))
    named = lambda rows: sorted((d is None, d or 0, t) for d, t in rows)
    # Different texts without an id, or with the same one, all stay; a copy goes, whichever of it has no id.
    rows = [(None, t) for t in texts[:20]] + [(7, t) for t in texts[20:30]] + [(k, t) for k, t in enumerate(texts[30:], 100)]
    assert held(simhash.near_duplicates_removed(table([*rows, (None, texts[35]), (None, texts[3]), (8, texts[25])]))) == named(rows)
    # A rejected row goes and a clean one stays, though they share a doc_id.
    assert held(quality.kept_documents(table([*rows, (None, "too few"), (7, "too few")]))) == held(quality.kept_documents(table(rows))) != []
    assert len(held(quality.kept_documents(table(rows)))) > 50
    items = spark.createDataFrame([(1, texts[0])], "item_id long, text string")
    assert held(decontaminate.clean_documents(table([*rows, (7, texts[0])]), items)) == named(rows[1:])
    # Leaves of the mix stay bounded with one id for all rows, and equal rows count one by one.
    same = table([(None, t) for t in texts] + [(5, "a b c")] * 40)
    assert mixing.sizes(same).select("h").distinct().count() == 100
    taken = sorted((r.size, r.taken) for r in mixing.mix(same).collect())
    mixed = mixing.mixed_documents(same).collect()
    assert len(taken) == 100 and sum(len(r.text.split()) for r in mixed) == sum(t for _, t in taken) > 0


def test_columns_with_any_names(spark):
    docs = read_table(spark, SF, "documents").limit(150).selectExpr("*", "1L AS `a.b`", "'x' AS `c d`", "doc_id AS `e``f`", "2 AS key", "3 AS removed")
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF))
    assert docs.columns[-5:] == ["a.b", "c d", "e`f", "key", "removed"] and docs.filter("`a.b` <> 1 OR `c d` <> 'x' OR `e``f` <> doc_id").isEmpty() and docs.count() > 0
