"""Filter interaction audit: what each filter of a set removes in every order in which the set can be applied.

The orders form a trie. It is walked depth first: a node's survivors are a DataFrame that is persisted while the walk is below it, and
one job over them counts, for each filter not yet applied, the rows that it removes there. What survives depends on which filters were
applied, not on their order, so orders that share a set of first filters share one node: 2^n states in place of n! orders. At most
one state a level is held at a time, and a lost executor's part of it is made again from the checkpointed verdicts.
"""

from __future__ import annotations

import uuid
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import checkpoint_folder, cut, left_join_small_or_any, remove_folder

#: The filters of the audit, by letter: a document fails A if it has under 200 words, B if fewer than 50 of 100 of them are distinct,
#: C if over 2 of 100 of its characters are A-Z, D with one of these signs, E if a document with a smaller id has the same text.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 2, r"[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FILTERS = "ABCDE"


def document_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) for each row of documents(doc_id, text, source, ...): which filters it fails, and its labels.

    A null text is empty, a null source the part ''. A row without a doc_id has no label, fails E never and makes no other fail it.
    Rows that share a doc_id aren't smaller than one another. A document with several rows of labels(doc_id, quality, toxic) is
    good, or toxic, if one of them says so.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), words.alias("words"))
    n = F.size("words")
    verdicts = read.select(
        "doc_id", "part", F.sha2("text", 256).alias("text_hash"), (n < LEAST_WORDS).alias("A"), (100 * F.size(F.array_distinct("words")) < LEAST_DISTINCT * n).alias("B"),
        (100 * (F.length("text") - F.length(F.translate("text", CAPITALS, ""))) > MOST_CAPITALS * F.length("text")).alias("C"), F.col("text").rlike(SIGNS).alias("D"),
    )
    verdicts = cut(verdicts)
    # The first id of each text that several rows have: rows of the same text are reduced before they are shuffled.
    first = cut(verdicts.groupBy("text_hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("text_hash", "first"))
    verdicts = left_join_small_or_any(verdicts, first, "text_hash", 8 * first.count())  # a hash has the size of eight longs
    marked = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marked = cut(marked.agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")))
    joined = left_join_small_or_any(verdicts, marked, "doc_id", 4 * marked.count())
    flag = lambda c: F.coalesce(c, F.lit(False))
    return joined.select("part", "A", "B", "C", "D", flag(F.col("first") < F.col("doc_id")).alias("E"), flag(F.col("good")).alias("good"), flag(F.col("toxic")).alias("toxic"))


def trie_states(verdicts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(state, part, n, removed, good_lost, toxic_lost) of each set of applied filters and each part that has rows left.

    state has a bit for each filter applied, n is the survivors' count; the other three have a number for each
    filter: what it removes from these survivors, and how many of those are good and toxic. verdicts has part, good, toxic and a column for each filter.
    """
    spark = verdicts.sparkSession
    folder = f"{checkpoint_folder(spark)}/trie-{uuid.uuid4().hex}"
    seen: set[int] = set()

    def visit(survivors: DataFrame, state: int) -> None:
        seen.add(state)
        # Every state's job has the same form, so its code is compiled once; filters already applied count nothing.
        count = lambda f, also: F.sum((F.col(f) & also).cast("long"))
        by_filter = lambda also: F.array(*[count(f, also) for f in filters])
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        counts = survivors.groupBy("part").agg(F.count("*").alias("n"), by_filter(F.lit(True)).alias("removed"), by_filter(F.col("good")).alias("good_lost"), by_filter(F.col("toxic")).alias("toxic_lost"))
        counts.withColumn("state", F.lit(state)).write.mode("append").parquet(folder)
        for k, f in enumerate(filters):
            if not state >> k & 1 and state | 1 << k not in seen:
                visit(survivors.filter(~F.col(f)), state | 1 << k)
        survivors.unpersist()

    visit(verdicts, 0)
    schema = "state int, part string, n long, removed array<bigint>, good_lost array<bigint>, toxic_lost array<bigint>"
    out = cut(spark.read.schema(schema).parquet(folder))
    remove_folder(spark, folder)
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the five filters and step, with zeros where nothing is left; see document_verdicts for the filters.

    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. An empty table gives no rows;
    other columns are ignored. redundant: failing the step's filter, but removed before it. shapley: what the filter removes, added up over all orders.
    """
    states, n = trie_states(cut(document_verdicts(docs, labels))), len(FILTERS)
    bits = {f: 1 << k for k, f in enumerate(FILTERS)}
    # What each filter removes from each state, zeros included: states that no row of a part reaches have none.
    parts = states.filter("state = 0").select("part", "n", "removed")
    edge = lambda s, f: F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(FILTERS.index(f)).alias("k"), F.lit(factorial(bin(s).count("1")) * factorial(n - 1 - bin(s).count("1"))).cast("long").alias("orders"))
    edges = F.explode(F.array(*[edge(s, f) for f in FILTERS for s in range(1 << n) if not s & bits[f]])).alias("e")
    counts = states.select("state", "part", *(F.col(c).alias(f"_{c}") for c in ("removed", "good_lost", "toxic_lost")))
    at = lambda c: F.coalesce(F.get(f"_{c}", F.col("k")), F.lit(0).cast("long")).alias(c)
    found = parts.select("part", F.col("removed").alias("all_fails"), edges).select("part", "all_fails", "e.*").join(counts, ["state", "part"], "left")
    found = found.select("part", "filter", F.get("all_fails", F.col("k")).alias("fails"), F.struct("state", "orders", at("removed"), at("good_lost"), at("toxic_lost")).alias("x"))
    by_filter = found.groupBy("part", "filter", "fails").agg(F.collect_list("x").alias("xs"))  # 2^(n-1) edges a filter
    by_filter = by_filter.withColumn("shapley", F.aggregate("xs", F.lit(0).cast("long"), lambda a, x: a + x["orders"] * x["removed"]))
    unique = F.filter("xs", lambda x: x["state"] == (1 << n) - 1 - F.element_at(F.create_map(*[F.lit(v) for f, b in bits.items() for v in (f, b)]), F.col("filter")))[0]["removed"]
    by_filter = by_filter.withColumn("unique_fails", unique)
    orders = ["".join(o) for o in permutations(FILTERS)]
    steps = states.sparkSession.createDataFrame([(o, k + 1, o[k], sum(bits[f] for f in o[:k]), sum(bits[f] for f in o[: k + 1])) for o in orders for k in range(n)], "filter_order string, step int, filter string, before int, after int")
    x = F.filter("xs", lambda x: x["state"] == F.col("before"))[0]
    rows = by_filter.join(F.broadcast(steps), "filter").withColumn("x", x)
    kept = states.select("part", F.col("state").alias("after"), F.col("n").alias("left"))
    long = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.join(kept, ["part", "after"], "left").select(
        "part", "filter_order", "step", long(F.col("left")).alias("kept"), long(F.col("x.removed")).alias("removed"), long(F.col("fails") - F.col("x.removed")).alias("redundant"),
        long(F.col("unique_fails")).alias("unique_fails"), long(F.col("x.good_lost")).alias("good_lost"), long(F.col("x.toxic_lost")).alias("toxic_lost"), "shapley",
    )


#: The same for DuckDB: verdicts as bits, counted by part, then met with all orders.
AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
m AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
v AS (
  SELECT part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN coalesce(first < doc_id, false) THEN 16 ELSE 0 END AS fails,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d JOIN m USING (text) LEFT JOIN l USING (doc_id)
), c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM v GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), s AS (SELECT filter_order, k AS step, bits[k] AS bit, CASE WHEN k = 1 THEN 0 ELSE list_sum(bits[1:k - 1]) END::INTEGER AS before FROM o, range(1, 6) g(k)),
t AS (
  SELECT part, filter_order, step, bit, sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & before > 0 AND fails & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM t
"""
