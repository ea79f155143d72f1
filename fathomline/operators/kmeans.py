"""k-means of a DataFrame with a least size of the clusters, on aggregates: a step moves a few numbers for each cluster, never rows.

Seeds are drawn one by one with a chance in proportion to the squared distance from the nearest seed so far (k-means++). The draw is the row with
the largest of u^(1 / d2), with u a hash of the row's key, so it is one aggregate and the same on any partitioning.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.operators.panel import numbered


def squared_distance(features: Column, centre: np.ndarray) -> Column:
    """Squared distance of an array column from a centre, as one expression."""
    out = F.lit(0.0)
    for k, c in enumerate(centre):
        out = out + (features[k] - float(c)) * (features[k] - float(c))
    return out


def _distances(centres: np.ndarray) -> Column:
    return F.array(*[squared_distance(F.col("features"), c) for c in centres])


def seeds(points: DataFrame, key: str, k: int, seed: int = 1) -> np.ndarray:
    """k of the points(key, features): the first at random, each next in proportion to its squared distance from those before."""
    out: list[np.ndarray] = []
    for step in range(k):
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(step), F.col(key)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        weight = F.array_min(_distances(np.array(out))) if out else F.lit(1.0)
        # log(u) / weight is largest where u^(1 / weight) is; points on a seed come last.
        chance = F.when(weight > 0, F.log(u) / weight).otherwise(F.lit(float("-inf")))
        row = points.agg(F.max_by("features", F.struct(chance.alias("c"), F.col(key).alias("k")))).first()[0]
        if row is None:
            raise ValueError("there are no points")
        out.append(np.array(row, float))
    return np.array(out)


def assigned(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """points with cluster, the nearest centre (the first of equally near ones), and d2s, the squared distances from all."""
    rows = points.withColumn("d2s", _distances(centres))
    return rows.withColumn("cluster", (F.array_position("d2s", F.array_min("d2s")) - 1).cast("int"))


def moved(rows: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(means, sizes) of the clusters of assigned rows; an empty one stays where it is."""
    width = centres.shape[1]
    out, sizes = centres.copy(), np.zeros(len(centres), np.int64)
    for r in rows.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(F.col("features")[k]).alias(f"m{k}") for k in range(width)]).collect():  # a row a cluster
        out[r["cluster"]], sizes[r["cluster"]] = [r[f"m{k}"] for k in range(width)], r["n"]
    return out, sizes


def lloyd(points: DataFrame, centres: np.ndarray, most_steps: int = 100, tolerance: float = 1e-6) -> tuple[np.ndarray, int]:
    """(centres, steps) after means and assignments in turn, until no centre moves by more than tolerance."""
    for steps in range(1, most_steps + 1):
        after, _ = moved(assigned(points, centres), centres)
        still = np.abs(after - centres).max() <= tolerance
        centres = after
        if still:
            break
    return centres, steps


def clusters(points: DataFrame, key: str, k: int, least: int = 1, seed: int = 1, most_steps: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(key, cluster) for each of points(key, features), with at least so many points in each cluster.

    A cluster that is too small gets the points that lose least by going to it, from clusters that are large enough to give them:
    those under a threshold of that loss, which sorting finds. With k times least points or fewer there is no such
    division, which is an error.
    """
    n = points.count()
    if n < k * least:
        raise ValueError(f"{n} points can't make {k} clusters of {least}")
    centres, _ = lloyd(points, seeds(points, key, k, seed), most_steps, tolerance)
    rows = assigned(points, centres).select(key, "cluster", "d2s")
    for _ in range(k):
        sizes = {r["cluster"]: r["count"] for r in rows.groupBy("cluster").count().collect()}
        small = min(range(k), key=lambda c: (sizes.get(c, 0), c))
        need = least - sizes.get(small, 0)
        if need <= 0:
            break
        # Each giver keeps its least: of its rows, in order of loss, only so many may go.
        loss = (F.col("d2s")[small] - F.col("d2s")[F.col("cluster")]).alias("loss")
        offers = None
        for c in (c for c in range(k) if sizes.get(c, 0) > least):
            some = numbered(rows.filter(F.col("cluster") == c).select(key, loss), ["loss", key], "place").filter(F.col("place") < sizes[c] - least)
            offers = some if offers is None else offers.unionByName(some)
        going = numbered(offers.drop("place"), ["loss", key], "place").filter(F.col("place") < need).select(key, F.lit(small).alias("to"))
        rows = rows.join(going, key, "left").select(key, F.coalesce("to", "cluster").cast("int").alias("cluster"), "d2s")
    return rows.select(key, "cluster")
