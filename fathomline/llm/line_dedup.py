"""Near-equal lines by deletion neighbourhoods.

A line is the sequence of its words, A-Z lower-cased; two lines are near if one word inserted, deleted or replaced makes them
equal (lines under LEAST_WORDS words: only if equal). A line goes if an earlier line, by doc_id, row and place, is near it. A row is
told from others of its doc_id by a key of doc_id and text, so that null and repeated doc_ids neither fall together nor into one task.

Equal lines are counted together first. Then each distinct line emits its deletion neighbourhood as hashed keys: itself, all
variants with one word deleted, and all variants with the place of the deletion. Lines that one replacement makes equal
share a variant and its place; where one word more makes them equal, a variant of one is the other itself. Under either sort
of key all lines are near the earliest, so a key needs its earliest line alone, an aggregate, and a line is held against
that; no pairs within a key are made. The edit distance of each line found and its earlier one is verified on their words.
Lines, halves and variants go to their key's counterpart only if a bitmap says that it may have one.

Only lines that can have a near one emit variants: near lines share all words of their first or of their last half, so lines
whose halves' hashes no other line has are left out before. That loses none, and most lines end there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from fathomline.llm.common import byte_texts, columns_of, cut, join_on_counted_key, row_key, split_by_keys, text_slices, unused

LEAST_WORDS = 5
#: Odd base of the variants' polynomial hash modulo 2 ** 64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
REPLACED, DELETED, WHOLE = 0, 1, 2

LINES = "doc_id long, key long, line int, h long, g long, k0 long, k1 long, k2 long, k3 long"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _line_hash(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines with a word: their hash and the keys of their halves; a line has up to four, each for its side and length."""
    half = xxhash.xxh3_64_intdigest
    for batch in text_slices(batches):
        ids, places, hashes, halves = [], [], [], []
        for row, text in enumerate(byte_texts(batch.column("text"))):
            for place, line in enumerate(text.lower().split(b"\n") if text else ()):
                words = line.split()
                n = len(words)
                if not n:
                    continue
                ids.append(row)
                places.append(place)
                hashes.append(_line_hash(words))
                keys = [0, 0, 0, 0]
                if n >= LEAST_WORDS:
                    a, b = (n - 1) // 2, n // 2
                    keys[0], keys[1] = half(b" ".join(words[:a]), 2 * a), half(b" ".join(words[n - a :]), 2 * a + 1)
                    if b > a:
                        keys[2], keys[3] = half(b" ".join(words[:b]), 2 * b), half(b" ".join(words[n - b :]), 2 * b + 1)
                halves.append(keys)
        both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
        keys = np.array(halves, np.uint64).reshape(-1, 4).view(np.int64)
        row = pa.array(ids, pa.int64())
        columns = [batch.column("doc_id").take(row), batch.column("key").take(row), pa.array(places, pa.int32()), *(pa.array(np.ascontiguousarray(c)) for c in (*both.T, *keys.T))]
        yield pa.RecordBatch.from_arrays(columns, names=_names(LINES))


def _candidates(distinct: DataFrame) -> DataFrame:
    """(key, places): the distinct lines, by the row and place of their first occurrence, that share a half with another."""
    keys = F.explode(F.array_distinct(F.array("k0", "k1", "k2", "k3"))).alias("k")
    halves = distinct.filter("k0 <> 0 or k1 <> 0").select("h", F.struct("key", "line").alias("at"), keys).filter("k <> 0")
    shared = halves.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count("*").alias("m")).filter("a <> b").select("k", "m")
    shared = cut(shared)
    total = shared.agg(F.sum("m")).first()[0] or 0
    some, _ = split_by_keys(halves, "k", shared.select("k"))
    found = join_on_counted_key(some, shared, "k", "m", total).select("at.key", "at.line", "h").distinct()
    return found.groupBy("key").agg(F.collect_list(F.struct("line", "h")).alias("places"))


def _taken(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the candidate lines; a line is passed over if another row has the key and another line there."""
    for batch in text_slices(batches):
        out: list[tuple] = []
        for doc_id, key, text, places in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), byte_texts(batch.column("text")), batch.column("places").to_pylist()):
            lines = text.lower().split(b"\n") if text else []
            for place in places:
                words = lines[place["line"]].split() if place["line"] < len(lines) else []
                if int.from_bytes(_line_hash(words)[:8], "little", signed=True) == place["h"]:
                    out.append((doc_id, key, place["line"], place["h"], b" ".join(words)))
        columns = list(zip(*out)) or [(), (), (), (), ()]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "key", "line", "h", "words"])


def variant_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, kinds) of a line's deletion neighbourhood."""
    n = len(words)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    with np.errstate(over="ignore"):
        powers = np.full(n, BASE, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers)])
        without = upto[:-1] + (upto[-1] - upto[1:]) * np.uint64(INVERSE)
        placed = (without ^ (without >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)
    keys = np.concatenate([placed, without, upto[-1:]])
    return keys.view(np.int64), np.concatenate([np.full(n, REPLACED), np.full(n, DELETED), [WHOLE]]).astype(np.int32)


def _variants(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        found = [variant_keys(w.split(b" ")) for w in batch.column("words").to_pylist()]
        row = pa.array(np.repeat(np.arange(len(found)), [len(k) for k, _ in found]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64), np.empty(0, np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), batch.column("at").take(row)], names=["variant", "kind", "at"])


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one inserted, deleted or replaced word, or none, makes the sequences equal."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = [within_one(a.split(b" "), b.split(b" ")) for a, b in zip(batch.column("words").to_pylist(), batch.column("earlier").to_pylist())]
        yield batch.select(["key", "line", "h"]).filter(pa.array(near, pa.bool_()))


def _near(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(key, line, h) of the first occurrences of distinct lines that have a near line before them."""
    candidates = cut(_candidates(distinct))
    some, _ = split_by_keys(docs, "key", candidates.select("key"))
    held = some.join(candidates, "key").select("doc_id", "key", "text", "places")
    lines = held.mapInArrow(_taken, "doc_id long, key long, line int, h long, words binary").distinct()
    # One number for doc_id, key and line, in their order.
    lines = cut(lines.orderBy("doc_id", "key", "line").select(F.monotonically_increasing_id().alias("at"), "key", "line", "h", "words"))
    variants = lines.select("at", "words").mapInArrow(_variants, "variant long, kind int, at long")
    whole = F.col("kind") == WHOLE
    earliest = variants.groupBy("variant").agg(F.min(F.when(whole, F.col("at"))).alias("whole"), F.min(F.when(~whole, F.col("at"))).alias("other"), F.count("*").alias("m"))
    earliest = cut(earliest.filter("m > 1"))
    total = earliest.agg(F.sum("m")).first()[0] or 0
    earlier = F.when(F.col("kind") == DELETED, F.col("whole")).otherwise(F.col("other"))
    some, _ = split_by_keys(variants, "variant", earliest.select("variant"))
    found = join_on_counted_key(some, earliest, "variant", "m", total).select("at", earlier.alias("e")).filter("e < at").distinct()
    pairs = found.join(lines, "at").join(lines.select(F.col("at").alias("e"), F.col("words").alias("earlier")), "e")
    return pairs.mapInArrow(_verified, "key long, line int, h long").distinct()


def _with_key(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", row_key("doc_id", "text").alias("key"), "text")


def removed_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of documents(doc_id, key, text): (key, n_lines), and (key, removed: the places of removed lines with their hash)."""
    lines = cut(docs.mapInArrow(_lines, LINES))
    at = F.struct("doc_id", "key", "line")
    halves = [F.max(k).alias(k) for k in ("k0", "k1", "k2", "k3")]
    distinct = cut(lines.groupBy("h", "g").agg(F.min(at).alias("first"), F.count("*").alias("m"), *halves).select("h", "g", "first.*", "m", "k0", "k1", "k2", "k3"))
    again = distinct.filter("m > 1").select(F.struct("h", "g").alias("hash"), at.alias("first"), "m")
    total = again.agg(F.sum("m")).first()[0] or 0
    some, _ = split_by_keys(lines, "h", again.select("hash.h"))
    equal = join_on_counted_key(some.select(F.struct("h", "g").alias("hash"), "doc_id", "key", "line"), again, "hash", "m", total)
    equal = equal.filter(F.col("first") < at).select("key", "line", F.col("hash.h").alias("h"))
    removed = equal.unionByName(_near(docs, distinct)).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("line", "h"))).alias("removed"))
    return lines.groupBy("key").agg(F.count("*").alias("n_lines")), removed


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and removed for each row of documents(doc_id, text, ...).

    n_lines counts the lines with a word; removed has the places, from 0 and in order, of those that go. Null and empty texts
    have no lines. Rows that share a doc_id, null or not, but not the text are documents of their own, in the order of their
    row_key; rows equal in both have equal reports, as if they were one document. Null is the first doc_id. Lines may be of any length. Other columns are
    ignored. Empty in, empty out.
    """
    docs = _with_key(docs)
    counts, removed = removed_lines(docs)
    places = F.coalesce(F.col("removed.line"), F.array().cast("array<int>"))
    out = docs.select("doc_id", "key").join(counts, "key", "left").join(removed, "key", "left")
    return out.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.size(places).cast("long").alias("n_removed"), places.alias("removed"))


def _rewritten(batches: Iterable[pa.RecordBatch], text: str, removed: str) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        texts = byte_texts(batch.column(text))
        for row, places in enumerate(batch.column(removed).to_pylist()):
            if places and texts[row]:
                lines = texts[row].split(b"\n")
                gone = {p["line"]: p["h"] for p in places}
                texts[row] = b"\n".join(x for k, x in enumerate(lines) if k not in gone or int.from_bytes(_line_hash(x.lower().split())[:8], "little", signed=True) != gone[k])
        new = pa.array(texts, pa.binary()).cast(pa.string())
        columns = [new if n == text else batch.column(n) for n in batch.schema.names if n != removed]
        yield pa.RecordBatch.from_arrays(columns, names=[n for n in batch.schema.names if n != removed])


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """documents, columns as they are, with the removed lines taken out of text and n_chars, if there, counted anew.

    Every row stays, also one that has no line left: its text is then empty. Rows are told apart as line_report does; of rows
    equal in doc_id and text each keeps the same lines.
    """
    _, removed = removed_lines(_with_key(docs))
    key, gone = unused(docs, "_key"), unused(docs, "removed")
    removed = cut(removed.withColumnsRenamed({"key": key, "removed": gone}))
    # Only texts that lose a line are shuffled to meet their places.
    some, others = split_by_keys(docs.withColumn(key, row_key("doc_id", "text")), key, removed.select(key))
    rows = some.join(removed, key, "left").select(*columns_of(docs), gone)
    rows = rows.unionByName(others.select(*columns_of(docs), F.lit(None).cast(removed.schema[gone].dataType).alias(gone)))
    # Plain names on the way through the tasks, as any signs may be in those of docs.
    plain = [f"c{k}" for k in range(len(docs.columns))]
    text, schema = plain[docs.columns.index("text")], StructType([StructField(c, f.dataType, f.nullable) for c, f in zip(plain, docs.schema)])
    out = rows.toDF(*plain, "removed").mapInArrow(lambda batches: _rewritten(batches, text, "removed"), schema).toDF(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
