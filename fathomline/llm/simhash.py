"""Near-duplicates by SimHash over a positional byte index.

A text's fingerprint has 64 bits: bit k is 1 if it is 1 in over half the hashes of the text's word shingles. Two
fingerprints that differ in at most 2 bits agree in at least 6 of their 8 bytes, position by position. The index has a
posting for every choice of 6 byte positions and the bytes there, so a pair shares a posting exactly if its count of
shared positional bytes reaches 6: the count filter is in the key, and a pair that doesn't reach it is never made. What
shares a posting differs in the other two bytes alone, so a posting has at most 65,536 fingerprints, and the pairs in
it are found by looking up, for each fingerprint, the 137 values at 2 or fewer bits from its two free bytes; a posting
of g fingerprints takes g look-ups of each and not g * g comparisons. The tally of shared bytes and the differing bits
of each pair found are then counted on the whole fingerprints.

The stage that removes near duplicates has no such bound of bits: at 0.8 of common shingles two fingerprints differ in some ten. Its index
also holds bands of least hashes of each text's shingles; pairs that either part finds are sifted by a wider fingerprint, and the shingles
of the texts that are left are held against each other. That finds most links at little cost, but not all. Those between the groups so found
come from the shingles themselves: two sets with SIMILARITY in common share one of the first fifth of their shingles in any order that is the
same for all texts. The order is by frequency in a sample, rare ones first, so that few texts meet; it decides the work, not the result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import BROADCAST_ROWS, byte_texts, columns_of, connected_components, cut, join_on_counted_key, row_key, run_starts, split_by_keys, text_slices, unused

SHINGLE_WORDS = 3
SEED = 42
MOST_BITS = 2
#: The stage that removes near duplicates has a fingerprint of INDEX_WORDS-word shingles in its index, and bands of BAND_HASHES least hashes
#: of VERIFY_WORDS-word shingles: a pair with a share j of them in common meets in a band with a chance of 1 - (1 - j^4)^BANDS, 0.985 at
#: SIMILARITY. What the index finds is sifted by VERIFY_PRINTS * 64 bits of VERIFY_WORDS-word shingles and verified on the shingles themselves.
INDEX_WORDS, INDEX_PRINTS = 2, 1
BANDS, BAND_HASHES = 8, 4
VERIFY_WORDS, VERIFY_PRINTS = 5, 4
#: Least share of common shingles, as a fraction too; the bits that differ at the angle that goes with it, and five standard deviations more.
ALIKE = 4, 5
SIMILARITY = ALIKE[0] / ALIKE[1]
_TURN = np.arccos(2 * SIMILARITY / (1 + SIMILARITY)) / np.pi
MOST_WIDE_BITS = int(64 * VERIFY_PRINTS * _TURN + 5 * np.sqrt(64 * VERIFY_PRINTS * _TURN * (1 - _TURN)))
#: The order of shingles is fitted to one text in SAMPLED, but to so many at least and at most; it ranks so many shingles, that so many of them have.
SAMPLED, LEAST_TEXTS, MOST_TEXTS = 50, 4000, 100_000
RANKED, LEAST_SEEN = 500_000, 3
#: Texts that one task holds against each other for a shingle, and pairs that it makes at a time.
BLOCK, PAIRS = 4096, 1 << 20
#: Least buckets of the parities of a text's distinct shingles: texts differ in at least as many shingles as parities. A longer text has
#: at least as many buckets as shingles, for in too few the parities of unlike texts differ by chance alone, and too little.
LEAST_BUCKETS = 1024
LEAST_BYTES = 8 - MOST_BITS
#: The two byte positions that a posting leaves free.
FREE = list(combinations(range(8), 8 - LEAST_BYTES))
#: Values of two bytes with 1 or 2 bits set.
NEAR = np.array([v for v in range(1, 1 << 16) if v.bit_count() <= MOST_BITS], np.uint32)


def _words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def _shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 of each shingle of n words, or of all words if they are fewer; none without a word."""
    if not words:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(n)))) if len(words) >= n else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, max(1, len(words) - n + 1))


def _majority(hashes: np.ndarray) -> int:
    """Bits that are 1 in over half the hashes; 0 without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes | None) -> int:
    """Unsigned fingerprint of a whole UTF-8 text; 0 without a word."""
    return _majority(_shingle_hashes(_words(text), SHINGLE_WORDS))


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        prints = np.fromiter(map(fingerprint, byte_texts(batch.column("text"))), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row of documents; fp holds the 64 bits as a signed long."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hashes under the k-th of a family of mixing functions."""
    with np.errstate(over="ignore"):
        x = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93 + 2 * k)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(32))


#: Odd multipliers of the least hashes, from a seed.
MULTIPLIERS = np.random.default_rng(SEED).integers(1 << 62, size=BANDS * BAND_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _bands(hashes: np.ndarray) -> list[int]:
    """A hash of each band's least hashes; texts without shingles share all bands."""
    least = np.full(len(MULTIPLIERS), (1 << 64) - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 1 << 12):
            x = hashes[at : at + (1 << 12), None] * MULTIPLIERS
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0))
    return [xxhash.xxh3_64_intdigest(band.tobytes()) for band in least.reshape(BANDS, BAND_HASHES)]


def _parities(hashes: np.ndarray) -> tuple[int, bytes]:
    """The number of distinct hashes, and whether it is odd in each bucket, as bits; buckets are a power of two."""
    distinct = np.unique(hashes)
    buckets = max(LEAST_BUCKETS, 1 << (len(distinct) - 1).bit_length())
    odd = np.bincount((distinct % np.uint64(buckets)).astype(np.int64), minlength=buckets) & 1
    return len(distinct), np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """In how many buckets the parities differ; the longer ones are folded to the buckets of the shorter."""
    few, many = sorted((a, b), key=len)
    x, bits = int.from_bytes(many, "little"), 8 * len(many)
    while bits > 8 * len(few):
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return (x ^ int.from_bytes(few, "little")).bit_count()


def _wide_fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A hash of the words, fingerprints of short shingles and bands of long ones for the index, fingerprints of long ones to verify."""
    names = PRINTS
    for batch in text_slices(batches):
        rows, odd = [], []
        for text in byte_texts(batch.column("text")):
            words = _words(text)
            short, long = _shingle_hashes(words, INDEX_WORDS), _shingle_hashes(words, VERIFY_WORDS)
            size, parities = _parities(long)
            rows.append([xxhash.xxh3_64_intdigest(b" ".join(words)), *(_majority(_mixed(short, k)) for k in range(INDEX_PRINTS)), *(_majority(_mixed(long, k)) for k in range(VERIFY_PRINTS)), *_bands(long), size])
            odd.append(parities)
        columns = np.array(rows, np.uint64).reshape(-1, 1 + len(names)).T.view(np.int64) if rows else np.empty((1 + len(names), 0), np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *(pa.array(np.ascontiguousarray(c)) for c in columns), pa.array(odd, pa.binary())], names=["doc_id", "key", "node", *names, "odd"])


#: Longs of a text's prints: index fingerprints, verifying ones, bands, and the number of distinct shingles; their parities are in odd.
PRINTS = [*(f"p{k}" for k in range(INDEX_PRINTS)), *(f"w{k}" for k in range(VERIFY_PRINTS)), *(f"b{k}" for k in range(BANDS)), "size"]


def _pairs_in_posting(prints: np.ndarray, nodes: np.ndarray, free: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the pairs that differ in 1 or 2 bits, each pair once, all of them in one posting's free bytes."""
    shift = np.array([8 * free[0], 8 * free[1]], np.uint64)
    values = ((prints >> shift[0]) & np.uint64(255)) | (((prints >> shift[1]) & np.uint64(255)) << np.uint64(8))
    order = np.argsort(values, kind="stable")
    values, nodes = values[order].astype(np.uint32), nodes[order]
    left, right = [], []
    if len(values) <= len(NEAR):
        i, j = np.triu_indices(len(values), 1)
        near = np.bitwise_count(values[i] ^ values[j]) <= MOST_BITS
        left, right = [i[near]], [j[near]]
    else:
        for change in NEAR:
            other = values ^ change
            at = np.searchsorted(values, other)
            found = (other > values) & (at < len(values))
            found[found] = values[at[found]] == other[found]
            left.append(np.flatnonzero(found))
            right.append(at[found])
    i, j = np.concatenate(left), np.concatenate(right)
    changed = values[i] ^ values[j]
    low, high = (changed & 255) > 0, (changed >> 8) > 0
    # A pair that differs in one byte is in 7 postings; it is taken from the one whose other free byte comes first.
    first = np.where(low & high, True, np.where(low, free[1] == (1 if free[0] == 0 else 0), free[0] == (1 if free[1] == 0 else 0)))
    return nodes[i[first]], nodes[j[first]]


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches are sorted by (free, kept); a run of equal keys may go on in the next batch."""
    names = ["free", "kept", "fp", "node"]
    rest = [np.empty(0, np.int64)] * 4

    def found(columns: list[np.ndarray], starts: np.ndarray, end: int) -> Iterator[pa.RecordBatch]:
        ends = np.append(starts[1:], end)
        left, right = [], []
        for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
            a, b = _pairs_in_posting(columns[2][s:e].view(np.uint64), columns[3][s:e], FREE[columns[0][s] % len(FREE)])
            left.append(a)
            right.append(b)
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["src", "dst"])

    for batch in batches:
        columns = [np.concatenate([r, batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64)]) for r, n in zip(rest, names)]
        starts = run_starts(columns[0], columns[1])
        if len(starts):
            yield from found(columns, starts[:-1], starts[-1])
            rest = [c[starts[-1] :] for c in columns]
    if len(rest[0]):
        yield from found(rest, np.array([0]), len(rest[0]))


def _signed(bits: int) -> int:
    bits &= (1 << 64) - 1
    return bits - (1 << 64) if bits >> 63 else bits


def _candidates(prints: DataFrame) -> DataFrame:
    """(src, dst) of nodes that share a posting and differ in 1 or 2 bits there; prints(index, fp, node), distinct in index and fp."""
    masks = [_signed(~((255 << 8 * a) | (255 << 8 * b))) for a, b in FREE]
    posting = F.explode(F.array(*[F.struct(F.lit(k).alias("free"), F.col("fp").bitwiseAND(F.lit(m)).alias("kept")) for k, m in enumerate(masks)]))
    postings = prints.select("index", "fp", "node", posting.alias("p")).select((F.col("p.free") + len(FREE) * F.col("index")).alias("free"), "p.kept", "fp", "node")
    return postings.repartition("free", "kept").sortWithinPartitions("free", "kept").mapInArrow(_pairs, "src long, dst long")


def links(prints: DataFrame) -> DataFrame:
    """(src, dst) for all pairs of rows of prints(fp, node), distinct in fp, that differ in at most 2 bits."""
    pairs = _candidates(prints.select(F.lit(0).alias("index"), "fp", "node"))
    both = pairs.join(prints.select(F.col("node").alias("src"), F.col("fp").alias("a")), "src").join(prints.select(F.col("node").alias("dst"), F.col("fp").alias("b")), "dst")
    changed = F.col("a").bitwiseXOR(F.col("b"))
    shared = sum((changed.bitwiseAND(F.lit(_signed(m))) == 0).cast("int") for m in (255 << 8 * k for k in range(8)))
    return both.filter((shared >= LEAST_BYTES) & (F.bit_count(changed) <= MOST_BITS)).select("src", "dst")


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of documents(doc_id, text, ...).

    component_id: the smallest doc_id that links reach. Texts without a word, null ones too, have the fingerprint zero and
    are linked like others. Repeated rows share their fingerprint and so their component. Rows with a null doc_id are linked
    like others too, but null is a component's id only if it has no other. Other columns are ignored. Empty in, empty out.
    """
    prints = cut(fingerprints(docs))
    total = prints.count()
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    components = connected_components(links(classes.select("fp", F.col("fp").alias("node"))))
    named = cut(classes.join(components, F.col("fp") == F.col("node"), "left").select("fp", "n", "first", F.coalesce("component", "fp").alias("component")))
    ids = cut(named.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("m")))
    named = join_on_counted_key(named.select("fp", "n", "component"), ids, "component", "m", named.count()).select("fp", "n", "component_id")
    rows = join_on_counted_key(prints, cut(named), "fp", "n", total)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _similar(classes: DataFrame) -> DataFrame:
    """(src, dst) of nodes that the index finds and whose wide fingerprints are near; classes(node, PRINTS).

    Nodes that are equal in a fingerprint or a band are held against the smallest and the largest of them, not all against all.
    """
    total = classes.count()
    keys = [f"p{k}" for k in range(INDEX_PRINTS)] + [f"b{k}" for k in range(BANDS)]
    index = F.explode(F.array(*[F.struct(F.lit(k).alias("index"), F.col(c).alias("fp")) for k, c in enumerate(keys)]))
    prints = classes.select("node", index.alias("p")).select("p.index", "p.fp", "node")
    first = cut(prints.groupBy("index", "fp").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n")).withColumn("at", F.struct("index", "fp")))
    equal = join_on_counted_key(prints.select(F.struct("index", "fp").alias("at"), "node"), first.filter("n > 1").select("at", "least", "most", "n"), "at", "n", len(keys) * total)
    equal = equal.select("node", F.explode(F.array("least", "most")).alias("end")).filter("node <> end").select(F.col("end").alias("src"), F.col("node").alias("dst"))
    pairs = _candidates(first.filter(F.col("index") < INDEX_PRINTS).select("index", "fp", F.col("least").alias("node"))).unionByName(equal)
    pairs = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    wide = lambda end: classes.select(F.col("node").alias(end), *[F.col(f"w{k}").alias(f"{end}{k}") for k in range(VERIFY_PRINTS)])
    apart = sum(F.bit_count(F.col(f"src{k}").bitwiseXOR(F.col(f"dst{k}"))) for k in range(VERIFY_PRINTS))
    return pairs.join(wide("src"), "src").join(wide("dst"), "dst").filter(apart <= MOST_WIDE_BITS).select("src", "dst")


def _shingle_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct hashes of each text's VERIFY_WORDS-word shingles."""
    for batch in text_slices(batches):
        sets = [np.unique(_shingle_hashes(_words(t), VERIFY_WORDS)).view(np.int64) for t in byte_texts(batch.column("text"))]
        flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))
        yield pa.RecordBatch.from_arrays([batch.column("node"), flat], names=["node", "shingles"])


def _verified(docs: DataFrame, key: Column, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs(src, dst) of nodes that have SIMILARITY of their shingles in common; only the texts of nodes in pairs are read for it."""
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    wanted = cut(classes.select("node", F.col("first")["key"].alias("key")).join(nodes, "node"))
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    # Rows equal in doc_id and text share their key; any of them will do.
    texts = docs.select(key.alias("key"), "text").join(few, "key").select("node", "text")
    sets = cut(texts.mapInArrow(_shingle_sets, "node long, shingles array<long>").dropDuplicates(["node"]))
    both = pairs.join(sets.toDF("src", "a"), "src").join(sets.toDF("dst", "b"), "dst")
    common = F.size(F.array_intersect("a", "b"))
    return both.filter(ALIKE[1] * common >= ALIKE[0] * (F.size("a") + F.size("b") - common)).select("src", "dst")


def _frequent(docs: DataFrame) -> tuple[DataFrame, float]:
    """(shingle, seen) of the shingles that most texts of a sample have, and the share of the texts that are in it."""
    total = docs.count()
    share = min(1.0, min(max(LEAST_TEXTS, total / SAMPLED), MOST_TEXTS) / max(1, total))
    sample = docs if share == 1.0 else docs.sample(share, SEED)
    sets = sample.select(F.lit(0).cast("long").alias("node"), "text").mapInArrow(_shingle_sets, "node long, shingles array<long>")
    counts = sets.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("seen"))
    return cut(counts.filter(F.col("seen") >= LEAST_SEEN).orderBy(F.desc("seen"), "shingle").limit(RANKED)), share


def _prefix(shingles: np.ndarray, ranked: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The first of distinct shingles in the common order: as many as SIMILARITY leaves to be missing, and one more."""
    rank = np.zeros(len(shingles), np.int64)
    if len(ranked):
        at = np.minimum(np.searchsorted(ranked, shingles), len(ranked) - 1)
        rank = np.where(ranked[at] == shingles, seen[at], 0)
    most_missing = len(shingles) * (ALIKE[1] - ALIKE[0]) // ALIKE[1]
    return shingles[np.lexsort((shingles, rank))][: most_missing + 1]


def _prefixes(batches: Iterable[pa.RecordBatch], ranked: np.ndarray, seen: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The number of each text's distinct shingles, and their prefix."""
    for batch in text_slices(batches):
        sets = [np.unique(_shingle_hashes(_words(t), VERIFY_WORDS)).view(np.int64) for t in byte_texts(batch.column("text"))]
        firsts = [_prefix(s, ranked, seen) for s in sets]
        flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, firsts)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *firsts])))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(s) for s in sets], pa.int64()), flat], names=["key", "size", "prefix"])


def _pairs_of_shingle(size: np.ndarray, place: np.ndarray, node: np.ndarray, component: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes of different components that have a shingle at these places of their order and may have SIMILARITY in common.

    If the shingle is the first that two texts share, at most left = size - place of either can be common, of which they need
    a share need of the sum of their sizes. By size that leaves each text a run of the larger ones.
    """
    if (component == component[0]).all():
        return
    order = np.argsort(size, kind="stable")
    size, left, node, component = size[order], (size - place)[order], node[order], component[order]
    need, both = ALIKE[0], sum(ALIKE)
    until = np.searchsorted(size, both * left // need - size, side="right")
    many = np.maximum(0, until - np.arange(1, len(size) + 1))
    upto = np.cumsum(many)
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
        i = np.repeat(np.arange(at, end), many[at:end])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many[at:end]) - many[at:end], many[at:end])
        good = (component[i] != component[j]) & (both * left[j] >= need * (size[i] + size[j]))
        yield node[i[good]], node[j[good]]
        at = end


def _meetings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches are sorted by (shingle, cell); a run of equal ones may go on in the next batch."""
    names = ["shingle", "cell", "size", "place", "node", "component"]
    rest = [np.empty(0, np.int64)] * len(names)

    def found(columns: list[np.ndarray], starts: np.ndarray, end: int) -> Iterator[pa.RecordBatch]:
        ends = np.append(starts[1:], end)
        pairs = (p for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]) for p in _pairs_of_shingle(*(c[s:e] for c in columns[2:])))
        for a, b in pairs:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["src", "dst"])

    for batch in batches:
        columns = [np.concatenate([r, batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64)]) for r, n in zip(rest, names)]
        starts = run_starts(columns[0], columns[1])
        if len(starts):
            yield from found(columns, starts[:-1], starts[-1])
            rest = [c[starts[-1] :] for c in columns]
    if len(rest[0]):
        yield from found(rest, np.array([0]), len(rest[0]))


def _sifted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        apart = np.fromiter(map(_apart, batch.column("src_odd").to_pylist(), batch.column("dst_odd").to_pylist()), np.int64, batch.num_rows)
        sizes = batch.column("src_size").to_numpy() + batch.column("dst_size").to_numpy()
        yield batch.select(["src", "dst"]).filter(pa.array(sum(ALIKE) * apart <= (ALIKE[1] - ALIKE[0]) * sizes))


def _may_be_alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs(src, dst) without those whose parities alone show that less than SIMILARITY is common."""
    ends = lambda end: classes.select(F.col("node").alias(end), F.col("size").alias(f"{end}_size"), F.col("odd").alias(f"{end}_odd"))
    return pairs.join(ends("src"), "src").join(ends("dst"), "dst").mapInArrow(_sifted, "src long, dst long")


def _between_groups(docs: DataFrame, key: Column, groups: DataFrame) -> DataFrame:
    """(src, dst) of all nodes of different components that may have SIMILARITY in common; groups(key, node, component), one row a node.

    A shingle that more than BLOCK texts should have has them dealt into blocks, and each two of these meet in a cell of their own.
    """
    frequent, share = _frequent(docs)
    rows = frequent.toPandas().sort_values("shingle")
    ranked, seen = rows["shingle"].to_numpy(np.int64), rows["seen"].to_numpy(np.int64)
    prefixes = docs.select(key.alias("key"), "text").mapInArrow(lambda batches: _prefixes(batches, ranked, seen), "key long, size long, prefix array<long>")
    # Rows equal in doc_id and text share their key; any of them will do.
    prefixes = prefixes.groupBy("key").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix")).join(groups, "key")
    postings = prefixes.select("node", "component", "size", F.posexplode("prefix").alias("place", "shingle"))
    blocks = frequent.select("shingle", F.ceil(F.col("seen") / (share * BLOCK)).cast("int").alias("blocks")).filter("blocks > 1")
    postings = postings.join(F.broadcast(blocks), "shingle", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    postings = postings.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")
    postings = postings.select("shingle", cell.alias("cell"), F.col("size").cast("int").alias("size"), "place", "node", "component")
    return postings.repartition("shingle", "cell").sortWithinPartitions("shingle", "cell").mapInArrow(_meetings, "src long, dst long").distinct()


def near_duplicates_removed(docs: DataFrame) -> DataFrame:
    """documents with one row of each group of near duplicates, columns as they are: the smallest doc_id, null last.

    Texts with equal words, A-Z lower-cased, are duplicates. Others are linked if SIMILARITY of their distinct VERIFY_WORDS-word
    shingles are common, all such pairs; what links join is a group. Texts without a word, null ones too, are one group. Of rows that share the doc_id the one with
    the smallest row_key stays, and of rows equal in doc_id and text any one; null and repeated doc_ids are linked by their texts
    alone. Empty in, empty out.
    """
    name = unused(docs, "_key")
    key = row_key("doc_id", "text")
    columns = [*PRINTS, "odd"]
    schema = "doc_id long, key long, node long, " + ", ".join(f"{c} long" for c in PRINTS) + ", odd binary"
    prints = docs.select("doc_id", key.alias("key"), "text").mapInArrow(_wide_fingerprints, schema)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    classes = cut(prints.groupBy("node").agg(F.min(order).alias("first"), *[F.min(c).alias(c) for c in columns]))
    components = connected_components(_verified(docs, key, cut(_similar(classes)), classes))
    groups = classes.join(components, "node", "left").select(F.col("first")["key"].alias("key"), "node", F.coalesce("component", "node").alias("component"))
    more = _verified(docs, key, cut(_may_be_alike(_between_groups(docs, key, groups), classes)), classes)
    components = connected_components(components.toDF("src", "dst").unionByName(more))
    named = classes.join(components, "node", "left").select(F.coalesce("component", "node").alias("component"), "first")
    kept = cut(named.groupBy("component").agg(F.min("first")["key"].alias(name)).select(name).distinct())
    # Only rows that may go, or that are there more than once, are shuffled to meet the keys that stay.
    rows = docs.withColumn(name, key)
    found = rows.groupBy(name).agg(F.count("*").alias("n")).join(kept.withColumn("stays", F.lit(True)), name, "left")
    some, others = split_by_keys(rows, name, cut(found.filter("n > 1 or stays is null").select(name)))
    some = some.join(kept, name, "left_semi").dropDuplicates([name])
    return some.select(*columns_of(docs)).union(others.select(*columns_of(docs)))
