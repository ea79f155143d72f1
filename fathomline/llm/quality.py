"""Quality rules, with robust multivariate outliers for each language and source.

Beside the plain rules, a document's statistics are transformed into a vector of rates, and each cell (a language and
source) gets a minimum-covariance-determinant estimate of their centre and spread: of all subsets with SUBSET of the cell's
rows, that whose covariance has the smallest determinant. Two starts (medians and quartile ranges; means and covariance)
are improved by concentration steps until no determinant falls, each one pass over all rows: a row's distance under the present estimate falls into a
bin of fixed width, each bin keeps its count, sums and cross-products, and the bins from the nearest up to the subset's
size give the next estimate. So no cell's rows are ever gathered, whatever its size. The start that ends with the smaller
determinant is taken, scaled so that the median distance is that of the normal law, and rows beyond CUT are rejected.

Cells under LEAST_ROWS rows, five for each coordinate, are pooled by language, and the languages under it with one another.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import columns_of, cut, join_on_counted_key, row_key, text_slices, unused

WINDOW = 5
LEAST_WORDS = 10
#: Base rule: at most this percentage of words in repeated windows.
REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b".,;:!?'\"()-"

#: Share of a cell's rows in the subset; most concentration steps, and the fall of a log determinant that counts; squared-distance cut: the normal law's at 1 in 10,000 for DIMS.
SUBSET = 0.6
MOST_STEPS, LEAST_FALL = 20, 1e-3
DIMS = 6
CUT = 27.86
MEDIAN_LAW = 5.348
LEAST_ROWS = 5 * DIMS
#: Words' worth of ordinary text that a document's rates are mixed with, so that short texts don't scatter more than long ones.
PRIOR_WORDS = 15.0
#: Ordinary rates: characters a word, symbols a word, capitals a character, marks a word.
PRIOR = (5.0, 0.0, 0.02, 0.15)
#: Least standard deviation of each coordinate: what is closer than that is alike.
FLOOR = (0.06, 0.06, 0.05, 0.10, 0.10, 0.10)
#: Bins: of coordinates for the quartiles, and of the logarithm of distances.
COORDINATE_BINS, DISTANCE_BINS = 100, 8

#: Counts of a document; an echo is a word that equals the one before it.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_echoes")


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that are found twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, n)
    with np.errstate(over="ignore"):
        ids = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        ids ^= ids >> np.uint64(29)
        keys = np.zeros(n - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            keys = keys * np.uint64(0xD6E8FEB86659FD93) + ids[k : n - WINDOW + 1 + k]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    change = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    change[starts] += 1
    change[starts + WINDOW] -= 1
    return int((np.cumsum(change[:-1]) > 0).sum())


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        points = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
        rows = []
        for text, length in zip(batch.column("text").cast(pa.binary()).to_pylist(), points):
            text = text or b""
            words = text.split()
            lines = [line for line in text.split(b"\n") if line.strip()]
            rows.append((
                len(words), length - sum(map(text.count, (b" ", b"\t", b"\n", b"\r", b"\v", b"\f"))), len(text) - len(text.translate(None, SYMBOLS)),
                len(lines) - len(set(lines)), repeated_words(words), len(text) - len(text.translate(None, UPPER)), len(text) - len(text.translate(None, MARKS)),
                sum(map(eq, words, words[1:])),
            ))
        columns = np.array(rows, np.int64).reshape(-1, len(STATS)).T
        kept = [batch.column(c) for c in ("doc_id", "lang", "source")]
        yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, columns)], names=["doc_id", "lang", "source", *STATS])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts STATS of each row of documents."""
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in STATS)
    return docs.select("doc_id", "lang", "source", "text").mapInArrow(_count, schema)


def _coordinates() -> list[Column]:
    """Transformed rates: word length, symbols, capitals, marks, repeated words, echoes; each about 0 to 3."""
    def rate(count: str, of: str, prior: float, scale: float = 1.0) -> Column:
        return (F.col(count) + F.lit(PRIOR_WORDS * scale * prior)) / (F.col(of) + F.lit(PRIOR_WORDS * scale))

    return [
        F.log(F.greatest(rate("word_chars", "n_words", PRIOR[0]), F.lit(0.1))),
        F.log1p(rate("n_symbols", "n_words", PRIOR[1])),
        F.sqrt(rate("n_upper", "word_chars", PRIOR[2], PRIOR[0])),
        F.log1p(rate("n_marks", "n_words", PRIOR[3])),
        F.sqrt(rate("n_repeat_words", "n_words", 0.0)),
        F.sqrt(rate("n_echoes", "n_words", 0.0)),
    ]


def _from_moments(n: float, total: np.ndarray, cross: np.ndarray) -> tuple[list[float], list[float], float]:
    """Centre, inverse Cholesky factor row by row, and log determinant; no coordinate spreads less than its floor."""
    centre = total / n
    full = np.zeros((DIMS, DIMS))
    full[np.tril_indices(DIMS)] = cross / n
    full = full + np.tril(full, -1).T - np.outer(centre, centre)
    floor = np.diag(np.square(FLOOR))
    # The spread in units of the floors, no direction under 1.
    scale = np.sqrt(np.diag(floor))
    values, vectors = np.linalg.eigh(full / np.outer(scale, scale))
    full = vectors @ np.diag(np.maximum(values, 1.0)) @ vectors.T * np.outer(scale, scale)
    factor = np.linalg.inv(np.linalg.cholesky(full))
    return centre.tolist(), factor[np.tril_indices(DIMS)].tolist(), float(-2 * np.log(np.diag(factor)).sum())


ESTIMATE = "cell string, start int, n long, centre array<double>, factor array<double>, det double, scale double"


def _first_estimates(rows: pd.DataFrame) -> pd.DataFrame:
    """From a cell's histograms (dim, bin, n) the start by quartiles, and from its moments (dim -1) the classical one."""
    moments = rows[rows["dim"] < 0].iloc[0]
    n = int(moments["n"])
    centre, spread = [], []
    for k in range(DIMS):
        bins = rows[rows["dim"] == k].sort_values("bin")
        upto = bins["n"].cumsum().to_numpy()
        low, middle, high = (bins["bin"].iloc[int(np.searchsorted(upto, q * upto[-1]))] for q in (0.25, 0.5, 0.75))
        centre.append((middle + 0.5) / COORDINATE_BINS)
        spread.append(max((high - low) / COORDINATE_BINS / 1.349, FLOOR[k]))
    factor = np.diag(1 / np.array(spread))[np.tril_indices(DIMS)].tolist()
    classical = _from_moments(n, np.array(moments["total"]), np.array(moments["cross"]))
    cell = rows["cell"].iloc[0]
    return pd.DataFrame([(cell, 0, n, centre, factor, np.inf, 1.0), (cell, 1, n, *classical[:2], np.inf, 1.0)], columns=["cell", "start", "n", "centre", "factor", "det", "scale"])


def _next_estimate(bins: pd.DataFrame) -> pd.DataFrame:
    """A concentration step from the bins of one cell and start, at most some hundreds of rows."""
    bins = bins.sort_values("bin")
    n = bins["n"].to_numpy()
    upto = np.cumsum(n)
    last = int(np.searchsorted(upto, SUBSET * upto[-1])) + 1
    total, cross = np.sum(np.stack(bins["total"].iloc[:last]), axis=0), np.sum(np.stack(bins["cross"].iloc[:last]), axis=0)
    centre, factor, det = _from_moments(float(upto[last - 1]), total, cross)
    return pd.DataFrame([(bins["cell"].iloc[0], int(bins["start"].iloc[0]), int(upto[-1]), centre, factor, det, 1.0)], columns=["cell", "start", "n", "centre", "factor", "det", "scale"])


def _scaled(bins: pd.DataFrame) -> pd.DataFrame:
    """(cell, scale): the median squared distance over the normal law's, at least 1."""
    bins = bins.sort_values("bin")
    upto = np.cumsum(bins["n"].to_numpy())
    median = np.exp((bins["bin"].iloc[int(np.searchsorted(upto, 0.5 * upto[-1]))] + 0.5) / DISTANCE_BINS)
    return pd.DataFrame([(bins["cell"].iloc[0], max(1.0, float(median) / MEDIAN_LAW))], columns=["cell", "scale"])


def _distance() -> Column:
    """Squared Mahalanobis distance of the vector v from centre under factor."""
    out = None
    for i in range(DIMS):
        z = sum((F.get("v", F.lit(j)) - F.get("centre", F.lit(j))) * F.get("factor", F.lit(i * (i + 1) // 2 + j)) for j in range(i + 1))
        out = z * z if out is None else out + z * z
    return out


def _moments() -> list[Column]:
    total = F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(DIMS)]).alias("total")
    cross = F.array(*[F.sum(F.get("v", F.lit(i)) * F.get("v", F.lit(j))) for i in range(DIMS) for j in range(i + 1)]).alias("cross")
    return [F.count("*").alias("n"), total, cross]


def _bin() -> Column:
    return F.floor(F.log(F.greatest("d", F.lit(1e-3))) * DISTANCE_BINS).cast("int").alias("bin")


def _with_cells(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their vector and cell, and (cell, n): the cells with LEAST_ROWS rows, the languages' rest, and what is left."""
    named = lambda *c: F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), x), F.lit("")) for x in c]))
    groups = counted.filter("n_words > 0").groupBy("lang", "source").agg(F.count("*").alias("m"))
    small = F.col("m") < LEAST_ROWS
    rest = groups.groupBy("lang").agg(F.coalesce(F.sum(F.when(small, F.col("m"))), F.lit(0)).alias("rest"))
    cell = F.when(~small, named("lang", "source")).when(F.col("rest") >= LEAST_ROWS, named("lang")).otherwise(F.lit("[]"))
    groups = groups.join(rest.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang"))).select(named("lang", "source").alias("k"), cell.alias("cell"), "m")
    groups = cut(groups)
    total = groups.agg(F.sum("m")).first()[0] or 0
    keyed = counted.filter("n_words > 0").select(named("lang", "source").alias("k"), "doc_id", *STATS, F.array(*_coordinates()).alias("v"))
    return cut(join_on_counted_key(keyed, groups, "k", "m", total).drop("k")), cut(groups.groupBy("cell").agg(F.sum("m").alias("m")))


def _estimates(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell, centre, factor, scale, m) of every cell."""
    total = cells.agg(F.sum("m")).first()[0] or 0
    bins = F.explode(F.transform("v", lambda x, i: F.struct(i.alias("dim"), F.floor(x * COORDINATE_BINS).cast("int").alias("bin")))).alias("b")
    none = F.array().cast("array<double>")
    histograms = rows.select("cell", bins).groupBy("cell", "b.dim", "b.bin").agg(F.count("*").alias("n")).select("cell", "dim", "bin", "n", none.alias("total"), none.alias("cross"))
    moments = rows.groupBy("cell").agg(*_moments()).select("cell", F.lit(-1).alias("dim"), F.lit(0).alias("bin"), "n", "total", "cross")
    estimates = cut(histograms.unionByName(moments).groupBy("cell").applyInPandas(_first_estimates, ESTIMATE))

    def measured(now: DataFrame) -> DataFrame:
        each = now.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("start", "centre", "factor"))).alias("starts")).join(cells, "cell")
        near = join_on_counted_key(rows.select("cell", "v"), each, "cell", "m", total)
        return near.select("cell", "v", F.inline("starts")).select("cell", "start", "v", _distance().alias("d"))

    for _ in range(MOST_STEPS):
        stepped = measured(estimates.drop("n", "det", "scale")).groupBy("cell", "start", _bin()).agg(*_moments()).groupBy("cell", "start").applyInPandas(_next_estimate, ESTIMATE)
        both = stepped.join(estimates.select("cell", "start", F.struct("n", "centre", "factor", "det", "scale").alias("before")), ["cell", "start"])
        fell = F.col("det") < F.col("before.det") - LEAST_FALL
        both = cut(both.select("cell", "start", F.when(fell, F.struct("n", "centre", "factor", "det", "scale")).otherwise(F.col("before")).alias("e"), fell.alias("fell")))
        estimates = both.select("cell", "start", "e.*")
        if both.filter("fell").isEmpty():
            break
    best = cut(estimates.groupBy("cell").agg(F.min_by(F.struct("start", "centre", "factor"), F.struct("det", "start")).alias("e")).select("cell", "e.*"))
    scales = measured(best).groupBy("cell", _bin()).agg(F.count("*").alias("n")).groupBy("cell").applyInPandas(_scaled, "cell string, scale double")
    return cut(best.drop("start").join(scales, "cell").join(cells, "cell"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, STATS, base_failed, distance and kept for each row of documents(doc_id, text, lang, source, ...).

    base_failed: under LEAST_WORDS words, or over REPEAT_PERCENT of them in repeated windows. kept: not base_failed, and a
    squared distance of at most CUT. A null or empty text has no words and fails. Null is a language and a source like any
    other. Repeated rows are judged alike, and each counts in the estimates; other columns are ignored. Empty in, empty out.
    """
    counted = cut(statistics(docs))
    rows, cells = _with_cells(counted)
    total = cells.agg(F.sum("m")).first()[0] or 0
    judged = join_on_counted_key(rows, _estimates(rows, cells), "cell", "m", total).select("doc_id", *STATS, (_distance() / F.col("scale")).alias("distance"))
    judged = judged.unionByName(counted.filter("n_words = 0").select("doc_id", *STATS, F.lit(None).cast("double").alias("distance")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return judged.select("doc_id", *STATS, failed.alias("base_failed"), "distance", (~failed & (F.col("distance") <= CUT)).alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of documents that the rules keep, columns as they are; rows that share a doc_id, null or not, are judged one by one."""
    name = unused(docs, "_kept")
    key = row_key("doc_id", "text", "lang", "source")
    kept = quality_rules(docs.select(key.alias("doc_id"), "text", "lang", "source")).filter("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.withColumn(name, key).join(kept, name, "left_semi").select(*columns_of(docs))
