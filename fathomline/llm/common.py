"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text that a task holds as Python objects at a time.
SLICE_ROWS = 128
#: A key is hot if it has this share of all rows; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 2000
#: Most rows of a table that is broadcast; larger ones take the way for tables of any size.
BROADCAST_ROWS = 200_000
#: Bits of a key filter for each key, and at most; a part of it has so many.
FILTER_BITS, MOST_FILTER_BITS, PART_BITS = 16, 1 << 27, 1 << 15
#: Copies of a row that one task makes.
CHUNK = 4096
#: With no more edges than these a hub is no burden.
FEW_EDGES = 100_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; in local mode, as in tests, one of this machine if it names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or f"{tempfile.gettempdir()}/checkpoints")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder; a lost executor doesn't lose it."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder, for what later passes read by columns."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store and all in it."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as it takes that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of df by name, whatever signs their names hold."""
    return [named(c) for c in df.columns]


def named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def row_key(*columns: str) -> Column:
    """64-bit hash of a row's values in columns, in which a null counts by its place, so that rows with null or repeated doc_ids differ."""
    return F.xxhash64(*[x for c in columns for x in (named(c), named(c).isNull())])


def text_slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of SLICE_ROWS, so that what a task derives from long texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each text, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def join_on_counted_key(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join on a key whose rows in left are counted in right[count]; each key is once in right.

    Rows of hot keys, of which there can be 1 / HOT_SHARE at most, meet their row by broadcast; all other rows are
    shuffled. The count column is dropped.
    """
    least = max(1000, int(total * HOT_SHARE))
    hot = F.broadcast(right.filter(F.col(count) >= least).drop(count))
    cold = right.filter(F.col(count) < least).drop(count)
    if total < 2 * least:
        return left.join(right.drop(count), key)
    return left.join(hot, key).unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def left_join_small_or_any(left: DataFrame, right: DataFrame, key: str, entries: int) -> DataFrame:
    """Left join on a key that is once in right, which is cut already and has so many entries of a few longs.

    Small ones are broadcast. Otherwise both sides are shuffled, but for keys that many rows of left have: at most 1 / HOT_SHARE
    keys, whose rows in right are broadcast.
    """
    if entries <= 10 * BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, "left")
    counts = cut(left.groupBy(key).count())
    least = (counts.agg(F.sum("count")).first()[0] or 0) * HOT_SHARE
    hot = F.broadcast(cut(counts.filter(F.col("count") >= F.greatest(F.lit(1000.0), F.lit(least))).select(key)))
    some = left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, "left")
    return some.unionByName(left.join(hot, key, "left_anti").join(right, key, "left"))


def split_by_keys(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df in two: rows whose key, a 64-bit hash, may be in keys(key), all that are among them; and rows whose key is not, which need no shuffle.

    A bitmap with a bit for each key is broadcast, FILTER_BITS for each key but at most MOST_FILTER_BITS (16 MB); where the keys are more,
    more of the other rows are among the first. Null keys are not in keys.
    """
    bits = PART_BITS
    wanted = FILTER_BITS * keys.count()
    while bits < min(wanted, MOST_FILTER_BITS):
        bits *= 2
    place, part, bit = F.pmod(F.col(key), F.lit(bits)), unused(df, "_part"), unused(df, "_bits")
    parts = keys.select(place.alias("place")).groupBy(F.shiftright("place", 15).alias(part)).agg(F.bitmap_construct_agg(F.col("place") % PART_BITS).alias(bit))
    # As ints of four bytes each, in which a bit is looked up by its place; the bytes of an int come the other way round.
    four = lambda k: F.conv(F.hex(F.substring(bit, 4 * k + 1, F.lit(4))), 16, 10).cast("long")
    parts = parts.select(part, F.transform(F.sequence(F.lit(0), F.lit(PART_BITS // 32 - 1)), lambda k: (F.pmod(four(k) + (1 << 31), F.lit(1 << 32)) - (1 << 31)).cast("int")).alias(bit))
    rows = df.withColumn(part, F.shiftright(place, 15)).join(F.broadcast(cut(parts)), part, "left")
    at = (place % PART_BITS).cast("int")
    there = F.coalesce(F.getbit(F.get(bit, F.shiftright(at, 5)), at.bitwiseAND(31).bitwiseXOR(24)) != 0, F.lit(False))
    return rows.filter(there).select(*columns_of(df)), rows.filter(~there).select(*columns_of(df))


def numbered(df: DataFrame, count: str, place: str) -> DataFrame:
    """Each row as often as count says, with place from 1; what is repeated more than CHUNK times is dealt out before."""
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / CHUNK)))
    many = df.filter(F.col(count) > CHUNK).withColumn(place, first)
    many = many.repartition(place, *[named(c) for c, t in many.dtypes if t == "bigint" and c not in (place, count)])
    low = F.col(place) * CHUNK
    many = many.withColumn(place, F.explode(F.sequence(low + 1, F.least(low + CHUNK, F.col(count)))))
    few = df.filter((F.col(count) > 0) & (F.col(count) <= CHUNK))
    return few.withColumn(place, F.explode(F.sequence(F.lit(1).cast("long"), F.col(count)))).unionByName(many)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(src, dst), both long; component is the smallest node reachable.

    Alternating large-star and small-star steps: in each, every node points its neighbours at the smallest of them, until
    every node points at the smallest of its component. The smallest is an aggregate; nodes with so many neighbours that
    their rows would burden one task meet it by broadcast. Null or equal ends are no edges.
    """
    edges = cut(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("v"), F.least("src", "dst").alias("u")).distinct())
    n, seen = edges.count(), None

    def met(left: DataFrame, around: DataFrame, total: int) -> DataFrame:
        return left.join(around.drop("n"), "v") if total <= FEW_EDGES else join_on_counted_key(left, cut(around), "v", "n", total)

    while True:
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        around = both.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")).select("v", F.least("v", "m").alias("m"), "n")
        # Every neighbour above v points at the smallest node around v.
        large = met(both, around, 2 * n).filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v <> u").distinct()
        large = cut(large) if n > FEW_EDGES else large
        around = large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
        # v and its neighbours below point at the smallest of them.
        small = met(large, around, n).select(F.explode(F.array("u", "v")).alias("v"), F.col("m").alias("u")).filter("v <> u").distinct()
        edges = cut(small)
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if mark == seen:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
                edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
            )
        n, seen = mark[0], mark


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal rows starts."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)
