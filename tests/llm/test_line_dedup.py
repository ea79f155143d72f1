"""Removed lines against every earlier line."""

import random

from pyspark.sql import functions as F

from fathomline.llm import common, line_dedup
from fathomline.llm.common import row_key

from .helpers import WORDS, documents, lower


def brute(rows):
    """{doc_id: removed places}, line by line against all before."""
    earlier, out = [], {}
    for doc_id, text in sorted(rows):
        out[doc_id] = []
        for place, line in enumerate((text or "").split("\n")):
            words = WORDS.findall(lower(line))
            if not words:
                continue
            if any(w == words or min(len(w), len(words)) >= line_dedup.LEAST_WORDS and line_dedup.within_one(w, words) for w in earlier):
                out[doc_id].append(place)
            earlier.append(words)
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def lines(rng, n):
    out = []
    for _ in range(n):
        words = rng.choice(out).split() if out and rng.random() < 0.6 else [f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 12))]
        k = rng.randrange(len(words))
        change = rng.random()
        words = words[:k] + ([] if change < 0.3 and len(words) > 1 else [f"w{rng.randrange(60)}"] if change < 0.6 else [words[k], "w1"]) + words[k + 1 :]
        out.append(" ".join(words))
    return out


def test_report_equals_brute_force(spark):
    rng = random.Random(5)
    all_lines = lines(rng, 260)
    texts = ["\n".join(all_lines[k : k + 13]) for k in range(0, 260, 13)] + [None, "", "\n \n", "A B C D E F", "a b c d e f g", "Long " * 20_000]
    docs = documents(spark, texts)
    mine = {r.doc_id: list(r.removed) for r in line_dedup.line_report(docs).collect()}
    wanted = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert mine == wanted and sum(map(len, wanted.values())) > 50
    left = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(docs).collect()}
    for r in docs.collect():
        kept = [x for k, x in enumerate(r.text.split("\n")) if k not in wanted[r.doc_id]] if r.text is not None else None
        assert left[r.doc_id] == ("\n".join(kept) if kept is not None else None)


def test_within_one_is_the_edit_distance():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ([rng.choice("xyz") for _ in range(rng.randrange(6))] for _ in range(2))
        assert line_dedup.within_one(a, b) == (distance(a, b) <= 1)


def test_edges(spark):
    docs = documents(spark, ["one line of six words here\nother", "one line of six words here", None])
    assert line_dedup.line_report(docs.limit(0)).count() == 0
    wide = docs.union(docs).withColumn("removed", F.lit("r")).withColumn("_doc_id", F.lit(7)).withColumn("h", F.lit(1)).withColumn("line", F.lit(3))
    out = line_dedup.without_repeated_lines(wide)
    assert out.columns == wide.columns and out.count() == 6 and out.filter("removed = 'r' and _doc_id = 7").count() == 6
    assert line_dedup.line_report(wide).count() == 6  # a row out for each row in
    # Different texts without an id are documents of their own.
    assert line_dedup.line_report(docs.withColumn("doc_id", F.lit(None).cast("long"))).count() == 3


def test_null_and_repeated_ids(spark):
    """Rows of one doc_id with different texts are held against each other, in the order of their keys."""
    rng = random.Random(9)
    all_lines = lines(rng, 240)
    texts = ["\n".join(all_lines[k : k + 6]) for k in range(0, 240, 6)]
    docs = documents(spark, texts).withColumn("doc_id", F.expr("case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then 5 else doc_id end"))
    docs = docs.union(docs.filter("doc_id = 5").limit(3))
    order = docs.select("doc_id", row_key("doc_id", "text").alias("key"), "text").distinct().collect()
    order.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.key))
    wanted = brute([(k, r.text) for k, r in enumerate(order)])
    mine = sorted((r.doc_id or 0, list(r.removed)) for r in line_dedup.line_report(docs).collect())
    of_row = {(r.doc_id, r.key): wanted[k] for k, r in enumerate(order)}
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("key")).collect()
    assert mine == sorted((r.doc_id or 0, of_row[r.doc_id, r.key]) for r in rows) and sum(map(len, wanted.values())) > 40
    left = {(r.doc_id, "\n".join(x for p, x in enumerate(r.text.split("\n")) if p not in wanted[k])) for k, r in enumerate(order)}
    out = [(r.doc_id, r.text) for r in line_dedup.without_repeated_lines(docs).collect()]
    assert set(out) == left and len(out) == docs.count()


def test_split_by_keys(spark, monkeypatch):
    """Every row whose key is among the keys is in the first part, whatever the filter's size, and few others are."""
    rows = spark.range(6000).withColumn("key", F.xxhash64("id")).withColumn("a.b", F.lit("x"))
    rows = rows.union(rows.limit(1).select("id", F.lit(None).cast("long"), "`a.b`"))
    keys = rows.filter("id % 3 = 1").select("key")
    for each, most in ((16, 1 << 27), (200, 1 << 27), (16, 1)):
        monkeypatch.setattr(common, "FILTER_BITS", each)
        monkeypatch.setattr(common, "MOST_FILTER_BITS", most)
        some, others = common.split_by_keys(rows, "key", keys)
        assert some.columns == others.columns == rows.columns and some.count() + others.count() == 6001
        assert some.filter("id % 3 = 1").count() == 2000 and others.filter("key is null").count() == 1
        assert some.count() < 2600


def test_texts_without_removed_lines_are_not_shuffled(spark):
    """Only the rows that lose a line, and those with a candidate line, meet others by their key."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) for _ in range(400)] + ["one line of six words here"] * 20
    rows = documents(spark, texts)
    out = line_dedup.without_repeated_lines(rows)
    assert "Union" in out._jdf.queryExecution().optimizedPlan().toString()
    left = {r.doc_id: r.text for r in out.collect()}
    assert left == {r.doc_id: ("" if r.doc_id > 401 else r.text) for r in rows.collect()}


def test_rows_without_a_counterpart_are_not_joined(spark, monkeypatch):
    """Of lines, halves and variants only those that meet another by their key, and few others, go to the joins."""
    rng = random.Random(12)
    texts = ["\n".join(" ".join(f"w{rng.randrange(10**7)}" for _ in range(12)) for _ in range(20)) for _ in range(100)]
    first = texts[0].split("\n")[0].split()
    texts += [" ".join([*first[:11], "other"]), texts[1].split("\n")[3], " ".join([*texts[2].split()[:6], *(f"x{k}" for k in range(6))])]
    joined, real = {}, line_dedup.join_on_counted_key
    monkeypatch.setattr(line_dedup, "join_on_counted_key", lambda left, right, key, count, total: (joined.update({key: left.count()}), real(left, right, key, count, total))[1])
    removed = {r.doc_id: list(r.removed) for r in line_dedup.line_report(documents(spark, texts)).collect() if r.n_removed}
    assert removed == {101: [0], 102: [0]}
    assert sorted(joined) == ["hash", "k", "variant"] and all(2 <= n < 40 for n in joined.values()), joined
