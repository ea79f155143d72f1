"""Hit words against every window at every place."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from fathomline.llm import decontaminate

from .helpers import documents, lower, sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, items):
    words, hit, found = WORD.findall(lower(text or "")), set(), set()
    for item, item_text in items:
        w = WORD.findall(lower(item_text or ""))
        n = min(13, len(w))
        for s in range(len(w) - n + 1) if n else ():
            for at in range(len(words) - n + 1):
                if words[at : at + n] == w[s : s + n]:
                    hit |= set(range(at, at + n))
                    found.add(item)
    ids = ",".join(sorted(map(str, found)))
    return len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def tables(spark):
    rng = random.Random(8)
    items = [(k, sentence(rng, n)) for k, n in enumerate((20, 13, 12, 5, 1, 40, 14, 30), 1)] + [(9, None), (10, ""), (11, "word1 word2 word1 word2"), (12, sentence(random.Random(0), 20))]
    texts = [sentence(rng, rng.randrange(1, 120)) for _ in range(60)]
    for k in range(40):
        w = items[k % len(items)][1] or "nothing"
        texts.append(f"{sentence(rng, rng.randrange(0, 300))} {w.upper().replace(' ', ', ')}! {sentence(rng, 5)}")
    texts += [" ".join(items[0][1].split()[:12]), None, "", "...", items[4][1], items[3][1] * 2, "word1 word2 " * 20, "é " + items[1][1], "word1 " * 30_000]
    return documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")


def test_contamination_equals_brute_force(spark):
    docs, items = tables(spark)
    pairs = [tuple(r) for r in items.collect()]
    wanted = {r.doc_id: brute(r.text, pairs) for r in docs.collect() if len(r.text or "") < 100_000}
    mine = {r[0]: tuple(r[1:]) for r in decontaminate.contamination(docs, items).collect()}
    assert {d: mine[d] for d in wanted} == wanted
    assert 10 < sum(w[-1] for w in wanted.values()) < len(wanted)
    clean = {r.doc_id for r in decontaminate.clean_documents(docs, items).collect()}
    assert clean == {d for d, r in mine.items() if not r[-1]}


def test_edges(spark):
    docs, items = tables(spark)
    docs = docs.limit(3)
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).filter("n_hit > 0 or contaminated").count() == 0
    wide = docs.union(docs)
    for name in ("ws", "row", "place", "token", "_bad", "n_words"):
        wide = wide.withColumn(name, F.lit(1))
    assert decontaminate.contamination(wide, items.withColumn("ws", F.lit(1))).count() == 6
    assert decontaminate.clean_documents(wide, items).columns == wide.columns
