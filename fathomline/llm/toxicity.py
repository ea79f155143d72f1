"""Toxicity by a chain of linear classifiers.

The categories are predicted one after another: each one's logistic regression sees the document's features and the
probabilities of the categories before it. In training those are out-of-fold: a row's come from models that were fitted
without its fold, so that later models meet probabilities as they will be on new documents.

The chain is fitted on a bounded sample of labelled rows, at most about SAMPLE_DOCS of each class of the last category,
weighted back to the class's size. Its features are the FEATURES words, word starts and runs of signs that tell each category
best in the sample. Scoring is one pass over all documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import cut, text_slices

#: Bounds of the sample and of the features of each category.
SAMPLE_DOCS = 4000
FEATURES = 240
LEAST_DOCS = 4
STARTS = (4, 5, 6, 7)
FOLDS = 5
RIDGE = 0.02
THRESHOLD = 0.5
#: (category, label column, label value that is in the category), in the order of the chain.
CATEGORIES = (("low_quality", "quality", 0), ("toxic", "toxic", 1))
TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+")


def features_of(text: str | None) -> Counter:
    """How often a text has each word, each start of a longer word, and each run of signs; and its capitals and all of them."""
    found = Counter(TOKEN.findall(text.lower())) if text else Counter()
    for n in STARTS:
        starts: Counter = Counter()
        for word, count in found.items():
            if len(word) > n and word[0] != "^":
                starts["^" + word[:n]] += count
        found.update(starts)
    return found


def _vector(text: str | None, places: dict[str, int]) -> np.ndarray:
    """log1p counts of the chosen features, then the log number of tokens and the share of capitals."""
    out = np.zeros(len(places) + 2)
    text = text or ""
    tokens = Counter(TOKEN.findall(text.lower()))
    for token, count in tokens.items():
        k = places.get(token)
        if k is not None:
            out[k] += count
        for n in STARTS:
            if len(token) > n:
                k = places.get("^" + token[:n])
                if k is not None:
                    out[k] += count
    out[:-2] = np.log1p(out[:-2])
    out[-2] = np.log1p(sum(tokens.values())) / 5
    out[-1] = sum(map(str.isupper, text)) / max(1, len(text))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge-penalised weighted logistic regression by Newton steps; the last coefficient is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], RIDGE)
    penalty[-1] = 1e-6
    b = np.zeros(x.shape[1])
    value = np.inf
    for _ in range(50):
        z = x @ b
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        new = float(weight @ (np.logaddexp(0, z) - y * z) + 0.5 * penalty @ b**2)
        if value - new < 1e-7 * max(1.0, abs(new)) and np.isfinite(value):
            break
        value = new
        slope = x.T @ (weight * (p - y)) + penalty * b
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while size > 1e-4:  # halve until the penalised loss falls
            z = x @ (b - size * step)
            if weight @ (np.logaddexp(0, z) - y * z) + 0.5 * penalty @ (b - size * step) ** 2 <= value:
                break
            size /= 2
        b = b - size * step
    return b


def probability(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ b[:-1] + b[-1], -35, 35)))


@dataclass
class Chain:
    """One linear model for each category, over the features and the earlier categories' probabilities."""

    models: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, ys: Sequence[np.ndarray], weight: np.ndarray, folds: np.ndarray) -> Chain:
        models = []
        for y in ys:
            models.append(fit_logistic(x, y, weight))
            out_of_fold = np.zeros(len(x))
            for fold in np.unique(folds):
                mine = folds == fold
                out_of_fold[mine] = probability(x[mine], fit_logistic(x[~mine], y[~mine], weight[~mine])) if not mine.all() else probability(x[mine], models[-1])
            x = np.column_stack([x, out_of_fold])
        return cls(models)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(rows, categories)."""
        out = []
        for b in self.models:
            out.append(probability(x, b))
            x = np.column_stack([x, out[-1]])
        return np.column_stack(out)


def _presence(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(feature, docs, c0, c1, ...): weights of the slice's documents that have a feature, in all and in each category."""
    for batch in text_slices(batches):
        found: dict[str, np.ndarray] = {}
        ys = np.column_stack([batch.column(f"y{k}").to_numpy(zero_copy_only=False) for k in range(n)])
        for text, w, y in zip(batch.column("text").to_pylist(), batch.column("weight").to_pylist(), ys):
            add = np.concatenate([[1.0, w], w * y])
            for feature in features_of(text):
                if feature in found:
                    found[feature] += add
                else:
                    found[feature] = add.copy()
        values = np.array(list(found.values())).reshape(-1, n + 2).T
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array(np.ascontiguousarray(v)) for v in values)], names=["feature", "docs", "weight", *(f"y{k}" for k in range(n))])


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: Sequence[tuple[str, str, int]]) -> DataFrame:
    """(doc_id, text, weight, y0, y1, ...): at most about SAMPLE_DOCS rows of each class of the last category, drawn by hash."""
    ys = [F.max((F.col(column) == value).cast("double")).alias(f"y{k}") for k, (_, column, value) in enumerate(categories)]
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(*ys).dropna()
    last = f"y{len(categories) - 1}"
    counts = {r[0]: r[1] for r in known.groupBy(last).count().collect()}
    rate = F.lit(1.0)
    for y, n in counts.items():
        rate = F.when(F.col(last) == y, F.lit(min(1.0, SAMPLE_DOCS / n))).otherwise(rate)
    drawn = known.filter(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 20)) < rate * (1 << 20)).withColumn("weight", 1 / rate)
    # The sample's size is bounded by the rates, so its ids can be broadcast and the texts stay where they are.
    return docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(drawn), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[tuple[str, str, int]] = CATEGORIES) -> tuple[Chain | None, dict[str, int]]:
    """The chain and the places of its features; None without a labelled document of either class."""
    n = len(categories)
    sample = cut(labelled_sample(docs, labels, categories))
    schema = "feature string, docs double, weight double, " + ", ".join(f"y{k} double" for k in range(n))
    sums = [F.sum(c).alias(c) for c in ("docs", "weight", *(f"y{k}" for k in range(n)))]
    present = sample.mapInArrow(lambda batches: _presence(batches, n), schema).groupBy("feature").agg(*sums).filter(F.col("docs") >= LEAST_DOCS)
    present = cut(present)
    totals = sample.agg(F.sum("weight"), *[F.sum(F.col("weight") * F.col(f"y{k}")) for k in range(n)]).first()
    if not totals[0]:
        return None, {}
    chosen: list[str] = []
    for k in range(n):
        # The feature's 2 x 2 table with the category: G-test-like score of the difference of its two rates.
        pos, neg = max(totals[k + 1], 1e-9), max(totals[0] - totals[k + 1], 1e-9)
        a, b = F.col(f"y{k}") / pos, (F.col("weight") - F.col(f"y{k}")) / neg
        score = (a - b) * (a - b) / (a * (1 - a) / pos + b * (1 - b) / neg + 1e-4 / pos + 1e-4 / neg)
        chosen += [r[0] for r in present.orderBy(F.desc(score), "feature").limit(FEATURES).collect()]
    places = {f: k for k, f in enumerate(dict.fromkeys(chosen))}

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            x = [_vector(t, places).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), *(batch.column(c) for c in kept)], names=["x", *kept])

    kept = ["doc_id", "weight", *(f"y{k}" for k in range(n))]
    rows = sample.mapInArrow(vectors, "x array<double>, doc_id long, weight double, " + ", ".join(f"y{k} double" for k in range(n))).toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    folds = np.array([zlib.crc32(str(d).encode()) % FOLDS for d in rows["doc_id"]])
    ys = [rows[f"y{k}"].to_numpy() for k in range(n)]
    return Chain.fit(np.stack(rows["x"]), ys, rows["weight"].to_numpy() / rows["weight"].mean(), folds), places


def toxicity(docs: DataFrame, labels: DataFrame, categories: Sequence[tuple[str, str, int]] = CATEGORIES) -> DataFrame:
    """doc_id, a probability p_<category> for each category, and <last category> as boolean, for each row of documents.

    Of labels(doc_id, ...), rows with a null in a category are left out, and of a doc_id's repeated rows any that is in a
    category counts. A null or empty text, and every text if there are no labels, has probability 0 and is not toxic.
    Repeated rows are judged alike; other columns are ignored. Empty in, empty out.
    """
    chain, places = fit(docs, labels, categories)
    names = [f"p_{c}" for c, _, _ in categories]
    last = categories[-1][0]
    shared = docs.sparkSession.sparkContext.broadcast((chain, places))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, places = shared.value
        for batch in text_slices(batches):
            p = np.zeros((batch.num_rows, len(names)))
            texts = batch.column("text").to_pylist()
            some = [k for k, t in enumerate(texts) if t]
            if chain is not None and some:
                p[some] = chain.predict(np.stack([_vector(texts[k], places) for k in some]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.ascontiguousarray(c)) for c in p.T), pa.array(p[:, -1] >= THRESHOLD)], names=["doc_id", *names, last])

    schema = "doc_id long, " + ", ".join(f"{n} double" for n in names) + f", {last} boolean"
    return docs.select("doc_id", "text").mapInArrow(score, schema)
