"""Benchmark passages in documents, by a prefix-filtered join; DataFrame functions only.

An item's windows are its runs of WINDOW_WORDS words, or all its words if they are fewer. Tokens are shingles of two words
(the word itself for one-word windows), ordered by rarity: how often the whole corpus has them, then the hash. A document
holds a window only if it holds all its tokens, so the necessary prefix of a window is its one rarest token. Where a
document has such a token, the length and positional bounds leave one place at which the window can be; the words there
are compared, one by one, with the window's.

The documents are read three times: to count the items' tokens in them, to find the places of prefix tokens, and to compare
the words at the places found. Each is a join of the exploded tokens, or of the places by the text's hash, with a table
that is broadcast if its counted size allows and shuffled otherwise; in the usual case no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import BROADCAST_ROWS, columns_of, cut, left_join_small_or_any, row_key, unused

WINDOW_WORDS = 13
#: A document is contaminated if this part of its words, at least, is hit: one in so many.
HIT_PART = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that are neither digits nor lower-case letters.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased, and no other letter; null has none."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, BETWEEN_WORDS), "")


def _tokens(ws: Column) -> Column:
    """The token that starts at each word; the last word's is never a window's."""
    return F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1)))


def _windows(items: DataFrame) -> DataFrame:
    """(item_id, ws, len): distinct windows of each item."""
    ws = items.select("item_id", words(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("ws") - WINDOW_WORDS + 1, F.lit(1))))
    return ws.withColumn("at", at).select("item_id", F.slice("ws", F.col("at"), WINDOW_WORDS).alias("ws")).distinct().withColumn("len", F.size("ws"))


def _window_tokens(windows: DataFrame) -> DataFrame:
    """(ws, len, single, token, off): every token of every distinct window and its place in it."""
    single = F.col("len") == 1
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.col("len") - 2, F.lit(0))), lambda i: F.struct(i.alias("off"), F.xxhash64(F.get("ws", i), F.get("ws", i + 1)).alias("token")))
    ones = F.array(F.struct(F.lit(0).alias("off"), F.xxhash64(F.get("ws", F.lit(0))).alias("token")))
    return windows.select("ws", "len", single.alias("single"), F.inline(F.when(single, ones).otherwise(pairs)))


def _small(df: DataFrame) -> DataFrame:
    """df for broadcast if its counted rows allow, else for a shuffled join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _prefixes(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(ws, len, single, token, off): the rarest token of each distinct window."""
    tokens = cut(_window_tokens(windows.select("ws", "len").distinct()))
    wanted = cut(tokens.filter("not single").select("token").distinct())
    seen = docs.select(F.explode(_tokens(F.col("ws"))).alias("token"))
    if wanted.count() <= BROADCAST_ROWS:
        counts = seen.join(F.broadcast(wanted), "token").groupBy("token").count()
    else:
        counts = seen.groupBy("token").count().join(wanted, "token", "left_semi")
    counted = tokens.join(_small(cut(counts)), "token", "left")
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token", "off")).alias("p")
    return counted.groupBy("ws", "len", "single").agg(rarest).select("ws", "len", "single", "p.token", "p.off")


def _places(docs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(k, spots): by the text's hash, where a window may start, and its length; a text that is repeated counts once."""
    tokens = [_tokens(F.col("ws"))]
    if not prefixes.filter("single").isEmpty():
        tokens.append(F.transform("ws", lambda w: F.xxhash64(w)))
    wanted = _small(cut(prefixes.select("token", "off", "len").distinct()))
    start = F.col("at") - F.col("off")
    found = None
    for each in tokens:
        part = docs.select("k", F.posexplode(each).alias("at", "token")).join(wanted, "token").filter(start >= 0).select("k", start.alias("start"), "len")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("k").agg(F.collect_set(F.struct("start", "len")).alias("spots"))


def benchmark_hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n_words) of each row of documents, and (row, start, len, item_id) of each window found in it."""
    read = docs.select("doc_id", "text", F.xxhash64("text").alias("k"))
    split = read.select("k", words(F.col("text")).alias("ws"))
    windows = cut(_windows(items))
    prefixes = cut(_prefixes(split, windows))
    places = cut(_places(split, prefixes))
    entries = places.agg(F.sum(F.size("spots") + 1)).first()[0] or 0
    rows = left_join_small_or_any(read, places, "k", entries).select("doc_id", words(F.col("text")).alias("ws"), "spots")
    at = F.transform(F.coalesce("spots", F.array().cast("array<struct<start:int,len:int>>")), lambda p: F.struct(p["start"].alias("start"), p["len"].alias("len"), F.slice("ws", p["start"] + 1, p["len"]).alias("ws")))
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("ws").cast("long").alias("n_words"), at.alias("spots")))
    held = rows.select("row", F.inline("spots")).join(_small(windows.select("ws", "item_id")), "ws")
    return rows.select("row", "doc_id", "n_words"), held.select("row", "start", "len", "item_id")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of documents(doc_id, text, ...).

    n_hit counts the words inside any occurrence of a window of items(item_id, text, ...); n_items counts the items with
    an occurring window, whose ids, as strings in order, are comma-joined and hashed. Contaminated: n_hit > 0 and
    HIT_PART * n_hit >= n_words. Null and empty texts have no words; items without words have no window; an item with a
    null id hits words but isn't counted. Repeated rows, and rows that share a doc_id, are judged one by one. Other
    columns are ignored. Without items nothing is hit; without documents there are no rows.
    """
    rows, held = benchmark_hits(docs, items)
    spans = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("start", "len")), lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))))
    ids = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    found = held.groupBy("row").agg(F.size(spans).cast("long").alias("n_hit"), ids.alias("ids"))
    out = rows.join(found, "row", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (HIT_PART * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of documents that aren't contaminated, columns as they are; rows that share a doc_id, null or not, are judged one by one."""
    name = unused(docs, "_bad")
    key = row_key("doc_id", "text")
    bad = cut(contamination(docs.select(key.alias("doc_id"), "text"), items).filter("contaminated").select(F.col("doc_id").alias(name)).distinct())
    return docs.withColumn(name, key).join(_small(bad), name, "left_anti").select(*columns_of(docs))


#: The same for DuckDB.
CONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, ws[i : i + 12] AS w FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, i, l, ws[i : i + l - 1] AS w
  FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d, (SELECT DISTINCT len(w) AS l FROM win))
), hit AS (
  SELECT DISTINCT doc_id, i, l, item_id FROM dw JOIN win USING (w)
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
