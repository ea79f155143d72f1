"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies that each of its documents should get; the whole part is given to
all, the fraction is a probability. Two documents with fractional probabilities are paired: mass moves from one to the
other, at random in which way, so that their expected words stay the same and one probability becomes 0 or 1. The other
goes on to the next pair. What is left of a group is one document, and the ones left are paired again in groups, level by
level, up to one for each source: a reduction tree. So all of a source but one document is settled without changing its
expected words. Settling the last one takes some words too many or too few; a few smaller documents of its node are turned
round to make up for that, so a source of one leaf comes as near to its target as its smallest documents allow. Of
larger ones the last document is a small part.

A group's members are fixed by a hash of the row (of all its columns, and a place among equal rows) and the size of the
source, and so is the random stream of each pair; the partitions that Spark uses have no part in it, and reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import columns_of, cut, join_on_counted_key, numbered, row_key, text_slices, unused

#: Weights of the sources in order, again and again; and the share of all sizes that they part among them.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
#: Documents of a leaf of the tree, and nodes that one node above joins, about.
LEAF_ROWS = 4096
#: Share of a node's words that may be left over or missing before the last document is settled the other way.
CLOSE = 0.005
FAN = 64
SEED = 7


def key_columns(docs: DataFrame) -> list[str]:
    """Columns that tell rows apart: all that can be hashed."""
    return sorted(c for c, t in docs.dtypes if "map<" not in t and t != "variant")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key, place, h) of each row; size: words of the text; h: a hash that orders the documents.

    key is the hash of the row and place, from 1, its place among equal rows; h is made of both, so that neither null nor
    repeated doc_ids nor equal rows fall together.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = batch.column("text").cast(pa.binary())
            n = [len(t.split()) if t else 0 for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64()), batch.column("key")], names=["doc_id", "source", "size", "key"])

    read = docs.select("doc_id", "source", "text", row_key(*key_columns(docs)).alias("key"))
    equal = read.mapInArrow(count, "doc_id long, source string, size long, key long").groupBy("doc_id", "source", "size", "key").count()
    rows = numbered(cut(equal), "count", "place")
    return rows.select("doc_id", "source", "size", "key", "place", F.xxhash64(F.lit(SEED), "key", "place").alias("h"))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(source, n, source_size, target) for each source of sized(source, size).

    Each pass over this table, which has a row for each source, gives what is left of the total to the sources below
    their bound by weight; those that come to stand above it are set to it, until none is.
    """
    by_source = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    order = by_source.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (*x[0], float(weights[x[1] % len(weights)])))
    table = cut(by_source.sparkSession.createDataFrame(order, "source string, n long, source_size long, weight double"))
    bound = MOST_COPIES * F.col("source_size")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, held = 0.0, -1
    while True:
        full = bound <= F.col("weight") * F.lit(level)
        given, weight, count = table.agg(
            F.coalesce(F.sum(F.when(full, bound)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.coalesce(F.sum(full.cast("int")), F.lit(0))
        ).first()
        if count == held or not weight:
            break
        level, held = max(0.0, share * total - given) / weight, count
    target = F.when(full, bound.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return table.select("source", "n", "source_size", F.least(target, bound.cast("double")).alias("target"))


def pivot(p: np.ndarray, size: np.ndarray, stream: np.random.Generator) -> tuple[np.ndarray, int]:
    """Probabilities after pairing each fractional one with the one left so far, and the place of the last left, or -1."""
    p = p.copy()
    draws = stream.random(len(p))
    left = -1
    for k in range(len(p)):
        if not 0 < p[k] < 1:
            continue
        if left < 0:
            left = k
            continue
        a, b = size[left], size[k]
        up = min((1 - p[left]) * a, p[k] * b)  # words that can move to the one left, and from it
        down = min(p[left] * a, (1 - p[k]) * b)
        move = up if draws[k] * (up + down) < down else -down
        new = p[left] + move / a, p[k] - move / b
        moved_all = (1 - p[left]) * a <= p[k] * b if move > 0 else p[left] * a <= (1 - p[k]) * b
        if moved_all:
            p[left], p[k] = float(move > 0), min(1.0, max(0.0, new[1]))
            left = k if 0 < p[k] < 1 else -1
        else:
            p[left], p[k] = min(1.0, max(0.0, new[0])), float(move < 0)
            left = left if 0 < p[left] < 1 else -1
    return p, left


def evened(p: np.ndarray, size: np.ndarray, last: int, taken: float) -> tuple[np.ndarray, float]:
    """(probabilities, words left over or missing): the last one settled as taken says, and a few turned round to make up for it.

    Sizes fall. From the largest on, a document that brings the words nearer to what they should be without going past it is
    given up, or taken; so less is left than the smallest of those that could still be turned.
    """
    p = p.copy()
    rest, p[last] = (taken - p[last]) * size[last], taken
    for k in np.flatnonzero((size > 0) & (size <= abs(rest))):
        if k != last and size[k] <= abs(rest) and p[k] == float(rest > 0):
            p[k] = 1.0 - p[k]
            rest -= np.sign(rest) * size[k]
    return p, abs(rest)


def _settle(level: int):
    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        # Large documents first: what is left at the end is then mostly a small one.
        rows = rows.sort_values(["size", "h", "doc_id", "p"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        first = rows.iloc[0]
        stream = np.random.default_rng([SEED, level, int(first["h"]) & ((1 << 63) - 1), int(first["node"])])
        p, left = pivot(rows["p"].to_numpy(), rows["size"].to_numpy(np.float64), stream)
        rows["p"], rows["open"] = p, np.arange(len(p)) == left
        if first["nodes"] <= 1 and left >= 0:  # the last of its source
            size = rows["size"].to_numpy(np.float64)
            taken = float(stream.random() < p[left])
            found, rest = evened(p, size, left, taken)
            if rest > CLOSE * size.sum():  # too little to turn round: the other way may come nearer
                other, less = evened(p, size, left, 1.0 - taken)
                found = other if less < rest else found
            rows["p"], rows["open"] = found, False
        return rows

    return settle


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """doc_id, size, source_size, target and taken for each row of documents(doc_id, text, source, ...).

    taken: size times the row's copies, 0 to MOST_COPIES. A null text has size 0 and is taken zero times; null is a source of
    its own, after the others. Repeated rows are rows of their own; which of equal rows gets which count is open, but not
    the counts. Other columns are ignored. Empty in, empty out.
    """
    return _copies(docs, weights, share).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def _copies(docs: DataFrame, weights: tuple[float, ...], share: float) -> DataFrame:
    sized = cut(sizes(docs))
    table = targets(sized, weights, share)
    total = table.agg(F.sum("n")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    leaves = F.greatest(F.lit(1), F.ceil(F.col("n") / LEAF_ROWS)).cast("long")
    table = cut(table.select("source", "n", "source_size", "target", rate.alias("rate"), leaves.alias("nodes"), F.monotonically_increasing_id().alias("s")))
    keyed = sized.withColumn("k", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    rows = join_on_counted_key(keyed, table.withColumn("k", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source"), "k", "n", total)
    whole = F.when(F.col("size") > 0, F.floor("rate")).otherwise(0)
    part = F.when(F.col("size") > 0, F.col("rate") - whole).otherwise(0.0)
    columns = ["doc_id", "key", "place", "h", "size", "source_size", "target", "whole", "s", "nodes", "node", "p"]
    rows = rows.select("doc_id", "key", "place", "h", "size", "source_size", "target", whole.cast("long").alias("whole"), "s", "nodes", F.pmod(F.shiftright("h", 8), "nodes").alias("node"), part.alias("p"))
    out, level = None, 0
    while True:
        schema = "doc_id long, key long, place long, h long, size long, source_size long, target double, whole long, s long, nodes long, node long, p double, open boolean"
        settled = cut(rows.select(*columns).groupBy("s", "node").applyInPandas(_settle(level), schema))
        done = settled.filter("not open").select("doc_id", "key", "place", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("long")).alias("copies"))
        out = done if out is None else out.unionByName(done)
        left = settled.filter("open")
        if left.isEmpty():
            return out
        above = F.ceil(F.col("nodes") / FAN).cast("long")
        rows = left.withColumn("node", F.pmod("node", above)).withColumn("nodes", above)
        level += 1


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """documents, columns as they are, each row as often as the mix takes it; rows that it doesn't take are gone.

    Rows equal in all columns are told apart by nothing, so they are made as often as the mix takes all of them together.
    """
    key, copies, copy = (unused(docs, n) for n in ("_key", "_copies", "_copy"))
    counts = _copies(docs, weights, share).groupBy(F.col("key").alias(key)).agg(F.sum("copies").alias(copies)).filter(F.col(copies) > 0)
    # Equal rows are one row here, which is made as often as the mix takes all of them.
    once = docs.withColumn(key, row_key(*key_columns(docs))).dropDuplicates([key])
    return numbered(once.join(cut(counts), key), copies, copy).select(*columns_of(docs))
