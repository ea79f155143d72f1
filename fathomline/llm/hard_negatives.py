"""Hard negatives by exact search over k-means inverted lists.

Centroids come from k-means on a bounded sample of the rows; every row goes to the list of its nearest centroid c, and a list keeps its
radius r, the largest distance of a row from c. By the Cauchy-Schwarz inequality no row of the list scores more than q.c + |q| r with an
anchor q, nor less than q.c - |q| r. An anchor visits lists by falling upper bound, leaves out those whose bounds lie outside
its window of scores, and stops where the bound is strictly below its k-th score so far. What is left out can't be among the
results, so they are those of a full scan, whatever the sample.

On Spark a search is two rounds. In the first an anchor visits the lists with its highest bounds; in the second those of the others
that its k-th score doesn't rule out. Lists are dealt to shards of a bounded number of rows (a long list to several), anchors to blocks
of a bounded number; a task gets one block and one shard, and visits the shard's lists in the anchors' order.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import cut

#: Rows that the centroids are fitted to, about, and most lists.
SAMPLE_ROWS, MOST_LISTS = 100_000, 2048
#: Rows of a shard, anchors of a block, about, and rows and anchors that are scored at a time.
SHARD_ROWS, BLOCK_ANCHORS, TILE_ROWS, TILE_ANCHORS = 16384, 32768, 512, 1024
#: Lists that an anchor visits in its first round.
FIRST_LISTS = 8
#: Squared length that a vector must be under, so that 100 times a score is a long.
MOST_SQUARE = 2**54
#: Beyond all scores.
FAR = 2**61
#: Windows of a negative's score, in hundredths of the positive's; positives and negatives of an anchor.
LOW, HIGH, POSITIVES, NEGATIVES = 50, 95, 5, 3
SCALE = 256


@dataclass(frozen=True)
class Lists:
    """What bounds need and where lists lie: a few numbers a list, which tasks get with their code."""

    centroids: np.ndarray
    radii: np.ndarray
    #: The first shard of each list, and over how many shards it is dealt.
    first: np.ndarray
    pieces: np.ndarray
    dtype: str
    width: int

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(upper, lower) bounds of each anchor's scores in each list; widened by what doubles may round off."""
        middle, reach = q @ self.centroids.T, np.linalg.norm(q, axis=1)[:, None] * self.radii
        slack = 1e-6 + 1e-9 * (np.abs(middle) + reach)
        return middle + reach + slack, middle - reach - slack


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component as a long; null for a null vector, or one with a null or non-finite component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float(2**27 / SCALE)))
    return F.when(whole, F.transform(x, lambda v: F.floor(SCALE * v).cast("long")))


def usable(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, q) of the rows that take part: with an id, a label and a vector whose components are all finite.

    Vectors as long as 2^27 (after scaling) or more don't fit the scores' long and take no part either.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), quantised(F.col(vector)).alias("q"))
    square = F.aggregate("q", F.lit(0).cast("double"), lambda a, v: a + v.cast("double") * v.cast("double"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("q").isNotNull() & (square < float(MOST_SQUARE)))


def _matrix(column: Sequence[bytes], index: Lists, dtype: str | None = None) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype or index.dtype).reshape(len(column), index.width)


def build_index(rows: DataFrame, lists: int | None = None) -> tuple[DataFrame, Lists] | None:
    """(shard, list, vec_id, label, q) of rows(vec_id, label, q), all of them, and their lists; None if there are none. Vectors are filled up with zeros to the longest one's length.

    lists: about the root of the number of rows, MOST_LISTS at most. The sample, of about SAMPLE_ROWS rows, is drawn by hash.
    """
    n, width, biggest = rows.agg(F.count("*"), F.max(F.size("q")), F.max(F.array_max(F.transform("q", F.abs)))).first()
    if not n:
        return None
    width, dtype = max(1, width), "<i2" if (biggest or 0) < 2**15 else "<i8"
    filled = F.slice(F.concat("q", F.array_repeat(F.lit(0).cast("long"), width)), 1, width)
    rows = rows.withColumn("q", filled)
    key = F.xxhash64("vec_id", "q")
    sample = rows.filter(F.pmod(key, F.lit(1 << 20)) < max(1, math.ceil(SAMPLE_ROWS / n * (1 << 20)))) if n > SAMPLE_ROWS else rows
    k = lists or min(MOST_LISTS, max(1, math.isqrt(n)))
    fitted = KMeans(k=k, seed=1, maxIter=10, initMode="random", featuresCol="v").fit(sample.select(array_to_vector(F.col("q").cast("array<double>")).alias("v"))) if k > 1 else None
    centroids = np.array(fitted.clusterCenters()) if fitted else np.zeros((1, width))
    squares = (centroids**2).sum(axis=1)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                q = batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
                exact = q.astype(np.float64)
                nearest = (squares - 2 * exact @ centroids.T).argmin(axis=1)
                far = np.linalg.norm(exact - centroids[nearest], axis=1)
                packed = q.astype(dtype)
                columns = [batch.column("vec_id"), batch.column("label"), pa.array([v.tobytes() for v in packed], pa.binary()), pa.array(nearest.astype(np.int32)), pa.array(far)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "q", "list", "far"])

    assigned = cut(rows.select("vec_id", "label", "q").mapInArrow(assign, "vec_id long, label long, q binary, list int, far double"))
    sizes, radii = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in assigned.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # a row a list
        sizes[r["list"]], radii[r["list"]] = r["n"], r["far"]
    pieces = np.maximum(1, -(-sizes // SHARD_ROWS))
    # Short lists share a shard until it is full; a long one has shards of its own.
    first, shard, held = np.zeros(len(sizes), np.int64), 0, 0
    for c in range(len(sizes)):
        if held and (pieces[c] > 1 or held + sizes[c] > SHARD_ROWS):
            shard, held = shard + 1, 0
        first[c] = shard
        shard, held = (shard + int(pieces[c]), 0) if pieces[c] > 1 else (shard, held + int(sizes[c]))
    spark = rows.sparkSession
    places = spark.createDataFrame([(c, int(first[c]), int(pieces[c])) for c in range(len(sizes))], "list int, first long, pieces long")
    dealt = F.col("first") + F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), "pieces")
    rows = assigned.join(F.broadcast(places), "list").select(dealt.alias("shard"), "list", "vec_id", "label", "q")
    return cut(rows), Lists(centroids, radii + 1e-9 * (1 + radii), first, pieces, dtype, width)


def _visits(anchors: DataFrame, index: Lists, blocks: int, again: bool) -> DataFrame:
    """A row for each anchor and shard that it visits, with the lists there: those of its highest bounds, or the others that may still count.

    anchors: (anchor, label, q, low, high, floor), the last three arrays with a place for each of its searches.
    """
    schema = "shard long, block int, anchor long, label long, q binary, low array<long>, high array<long>, floor array<long>, lists array<int>"
    first_lists, tile_anchors = FIRST_LISTS, TILE_ANCHORS

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, tile_anchors):
                batch = whole.slice(start, tile_anchors)
                upper, lower = index.bounds(_matrix(batch.column("q").to_pylist(), index).astype(np.float64))
                order = np.argsort(-upper, axis=1, kind="stable")
                early = np.zeros(upper.shape, bool)
                np.put_along_axis(early, order[:, :first_lists], True, axis=1)
                searches = [batch.column(c).to_pylist() for c in ("low", "high", "floor")]
                low = [[max(x, f) for x, f in zip(a, c)] for a, c in zip(searches[0], searches[2])]
                rows, at = [], []
                for a in range(batch.num_rows):
                    may = np.zeros(upper.shape[1], bool)
                    for lo, hi in zip(low[a], searches[1][a]):
                        may |= (upper[a] >= lo) & (lower[a] <= hi)
                    lists = np.flatnonzero(may & (~early[a] if again else early[a]))
                    by_shard: dict[int, list[int]] = {}
                    for c in lists:
                        for piece in range(index.pieces[c]):
                            by_shard.setdefault(int(index.first[c]) + piece, []).append(int(c))
                    rows.extend(by_shard.items())
                    at.extend([a] * len(by_shard))
                taken = batch.take(pa.array(at, pa.int64()))
                block = pa.array((np.array(taken.column("anchor").to_pylist(), np.int64) % blocks).astype(np.int32))
                columns = [pa.array([s for s, _ in rows], pa.int64()), block, *(taken.column(c) for c in ("anchor", "label", "q", "low", "high", "floor"))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([c for _, c in rows], pa.list_(pa.int32()))], names=["shard", "block", "anchor", "label", "q", "low", "high", "floor", "lists"])

    return anchors.select("anchor", "label", "q", "low", "high", "floor").mapInArrow(kernel, schema)


class _Best:
    """The best k (score, vec_id) of each search of a block's anchors; higher scores first, then smaller ids."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.copy()
        self.search, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, search: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(search):
            return
        among = np.isin(self.search, search)  # other searches keep what they have
        s, x, i = (np.concatenate([old[among], new]) for old, new in ((self.search, search), (self.score, score), (self.id, ids)))
        order = np.lexsort((i, -x, s))
        s, x, i = s[order], x[order], i[order]
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        rank = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))
        kth = rank == self.k - 1
        self.floor[s[kth]] = np.maximum(self.floor[s[kth]], x[kth])
        keep = rank < self.k
        self.search, self.score, self.id = (np.concatenate([old[~among], new[keep]]) for old, new in ((self.search, s), (self.score, x), (self.id, i)))


def _searched(index: Lists, k: int, same_label: bool):
    """What one block of anchors finds in one shard."""
    columns, tile_rows, tile_anchors = ["anchor", "search", "score", "vec_id"], TILE_ROWS, TILE_ANCHORS

    def find(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if anchors.empty or rows.empty:
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in columns})
        rows = rows.sort_values(["list", "vec_id"], kind="stable")
        lists = rows["list"].to_numpy()
        starts = np.flatnonzero(np.append(True, lists[1:] != lists[:-1]))
        where = {int(lists[a]): (int(a), int(b)) for a, b in zip(starts, np.append(starts[1:], len(lists)))}
        there = np.array(sorted(where))
        x, ids, labels = _matrix(rows["q"].tolist(), index), rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
        q = _matrix(anchors["q"].tolist(), index)
        number, label = anchors["anchor"].to_numpy(np.int64), anchors["label"].to_numpy(np.int64)
        # An anchor with fewer searches than others gets windows that nothing lies in.
        low, high, floor = (np.full((len(q), anchors["low"].map(len).max()), none, np.int64) for none in (FAR, -FAR, FAR))
        for a, searches in enumerate(zip(anchors["low"], anchors["high"], anchors["floor"])):
            for into, values in zip((low, high, floor), searches):
                into[a, : len(values)] = values
        # Sums of doubles are exact below 2^53; longer vectors are multiplied as longs.
        longest = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1).max() * (x.astype(np.float64) ** 2).sum(axis=1).max())
        x, q = (m.astype(np.float64 if longest < 2**52 else np.int64) for m in (x, q))
        many = low.shape[1]
        best = _Best(floor.ravel(), k)
        real = q.astype(np.float64)
        middle, reach = real @ index.centroids[there].T, np.linalg.norm(real, axis=1)[:, None] * index.radii[there]
        slack = 1e-6 + 1e-9 * (np.abs(middle) + reach)
        upper, lower = middle + reach + slack, middle - reach - slack
        meant = np.zeros(upper.shape, bool)
        named = np.concatenate(anchors["lists"].tolist())
        by = np.repeat(np.arange(len(q)), anchors["lists"].map(len).to_numpy())
        held = np.isin(named, there)  # a piece of a long list may be empty
        meant[by[held], np.searchsorted(there, named[held])] = True
        order = np.argsort(np.where(meant, -upper, np.inf), axis=1, kind="stable")
        for step in range(int(meant.sum(axis=1).max())):
            at = order[:, step]
            every = np.arange(len(q))
            up, down = upper[every, at][:, None], lower[every, at][:, None]
            open_ = (up >= np.maximum(best.floor.reshape(len(q), many), low)) & (down <= high)
            active = np.flatnonzero(meant[every, at] & open_.any(axis=1))
            for c in np.unique(at[active]):
                group, (a, b) = active[at[active] == c], where[int(there[c])]
                for tile in range(0, len(group), tile_anchors):
                    some = group[tile : tile + tile_anchors]
                    for begin in range(a, b, tile_rows):
                        end = min(b, begin + tile_rows)
                        scores = (q[some] @ x[begin:end].T).astype(np.int64)
                        fits = (label[some][:, None] == labels[None, begin:end]) == same_label
                        floors = best.floor.reshape(len(q), many)[some]
                        found = [np.nonzero(fits & (scores >= floors[:, [m]]) & (scores >= low[some][:, [m]]) & (scores <= high[some][:, [m]])) for m in range(many)]
                        best.add(
                            np.concatenate([some[r] * many + m for m, (r, _) in enumerate(found)]), np.concatenate([scores[f] for f in found]), np.concatenate([ids[begin:end][j] for _, j in found])
                        )
        return pd.DataFrame({"anchor": number[best.search // many], "search": best.search % many, "score": best.score, "vec_id": best.id})

    return find


def nearest(anchors: DataFrame, rows: DataFrame, index: Lists, k: int, same_label: bool) -> DataFrame:
    """(anchor, search, rank, score, vec_id): the first k rows, from 1, of each search of anchors(anchor, label, q, low, high).

    anchor numbers the rows of anchors. A search is a place in the arrays low and high, between which the scores it takes lie;
    same_label: whether its rows have the anchor's label, or another one. An anchor's own row counts like any other.
    """
    blocks = max(1, -(-anchors.count() // BLOCK_ANCHORS))
    by_search = Window.partitionBy("anchor", "search").orderBy(F.desc("score"), "vec_id")
    first = lambda df: df.withColumn("rank", F.row_number().over(by_search)).filter(F.col("rank") <= k)
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    columns = "anchor long, search long, score long, vec_id long"
    least = -FAR

    def visited(anchors: DataFrame, again: bool) -> DataFrame:
        visits = _visits(anchors, index, blocks, again)
        return visits.groupBy("shard", "block").cogroup(rows.groupBy("shard", "block")).applyInPandas(_searched(index, k, same_label), columns)

    opened = anchors.withColumn("floor", F.transform("low", lambda _: F.lit(least)))
    early = cut(first(visited(opened, False)))
    # The k-th score of each search that has found k; lists whose bound is below it aren't visited.
    kth = early.filter(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("search", "score"))).alias("kth"))
    known = anchors.join(kth, "anchor", "left")
    at = F.transform("low", lambda x, i: F.coalesce(F.col("kth")[i.cast("long")], F.lit(least)))
    late = visited(known.withColumn("floor", F.when(F.col("kth").isNull(), F.transform("low", lambda _: F.lit(least))).otherwise(at)), True)
    return first(early.drop("rank").unionByName(late))


def hard_negatives(rows: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, lists: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows(vec_id, label, q) of usable().

    Anchors are the rows whose vec_id is divisible by every. An anchor's positives are the first rows of its label but itself; the
    negatives of an anchor and positive are the first rows of other labels with low * positive_score <= 100 * score <= high *
    positive_score. First: higher score, then smaller vec_id. Rows are rows: repeated ones count each, an anchor's
    repetition is another row, and an anchor that is twice there has its results twice. No rows give none.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = cut(rows)
    built = build_index(rows, lists)
    if built is None:
        return spark.createDataFrame([], schema)
    rows, index = built
    chosen = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    anchors = cut(chosen.select(F.monotonically_increasing_id().alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "q"))
    span = lambda v: F.array(F.lit(v).cast("long"))
    found = nearest(anchors.withColumn("low", span(-FAR)).withColumn("high", span(FAR)), rows, index, positives + 1, True)
    # One of the rows found that equal the anchor in id and score is the anchor itself.
    dtype, width = index.dtype, index.width

    def own_score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = np.frombuffer(b"".join(batch.column("q").to_pylist()), dtype).reshape(batch.num_rows, width).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("anchor"), batch.column("anchor_id"), batch.column("label"), batch.column("q"), pa.array((q * q).sum(axis=1))], names=["anchor", "anchor_id", "label", "q", "own"])

    anchors = cut(anchors.mapInArrow(own_score, "anchor long, anchor_id long, label long, q binary, own long"))
    by_anchor = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("found"))  # positives + 1 at most
    kept = F.filter("found", lambda x: F.col("self_at").isNull() | (x["rank"] != F.col("self_at")))
    with_positives = anchors.join(by_anchor, "anchor").withColumn("self_at", F.expr("get(filter(found, x -> x.vec_id = anchor_id AND x.score = own), 0).rank")).withColumn("found", F.slice(kept, 1, positives))
    # Scores s with low * p <= 100 * s <= high * p; empty for p < 0.
    window = with_positives.filter(F.size("found") > 0).select(
        "anchor", "anchor_id", "label", "q", "found",
        F.expr(f"transform(found, x -> -(-{low} * x.score - pmod(-{low} * x.score, 100L)) div 100L)").alias("low"),
        F.expr(f"transform(found, x -> ({high} * x.score - pmod({high} * x.score, 100L)) div 100L)").alias("high"),
    )
    window = cut(window)
    best = nearest(window.select("anchor", "label", "q", "low", "high"), rows, index, negatives, False)
    positive = F.col("found")[F.col("search").cast("int")]
    return best.join(window.select("anchor", "anchor_id", "found"), "anchor").select(
        "anchor_id", positive["vec_id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score")
    )


def contract_negatives(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of a table embeddings(vec_id, embedding, label, ...), of which every seventh id's label is first moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(usable(embeddings).withColumn("label", moved))


#: The same for DuckDB: all anchors against all rows.
NEGATIVES_SQL = f"""
WITH r AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.rid, a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM r a, r b WHERE a.vec_id % 50 = 0 AND a.rid <> b.rid
), p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.rid, p.vec_id, p.score ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.rid = s.rid AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
