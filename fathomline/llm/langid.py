"""Language identification by words first, then character n-grams.

The model has, for each language, the log frequency of the known words, and of the character n-grams of 4, 3, 2 and 1
letters. A document's word that is known scores by its own frequencies; an unseen word by the mean over its known n-grams of
the greatest length of which any is known. The language with the largest sum over all words is predicted.

The model is fitted on a bounded sample of the labelled rows: about SAMPLE_DOCS whole documents of each language, drawn by a
hash of the doc_id. Each language has an equal share of the WORDS and GRAMS entries, its most frequent ones; an entry that
one language brings in keeps its counts in all. The model is small and goes to all tasks; scoring is one pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import cut, text_slices

#: Bounds of the model's sample and size.
SAMPLE_DOCS = 2500
WORDS = 250_000
GRAMS = 80_000
MOST_LANGS = 500
LONGEST = 4
#: Counts added to each entry and language.
SMOOTHING = 0.1
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
#: Documents with this remainder of crc32(doc_id) modulo 4 are held out.
HELD_OUT = 2


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; empty if there is no letter."""
    found = WORD.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == HELD_OUT, F.lit(False))


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, gram, count) of words (n = 0) and n-grams, added up within a slice."""
    for batch in text_slices(batches):
        found: Counter = Counter()
        by_lang: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            by_lang.setdefault(lang, Counter()).update(words_of(text))
        for lang, words in by_lang.items():
            for word, count in words.items():
                found[lang, 0, word] += count
                padded = f" {word} "
                for n in range(1, LONGEST + 1):
                    for at in range(len(padded) - n + 1):
                        found[lang, n, padded[at : at + n]] += count
        columns = list(zip(*found)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "n", "gram", "count"]
        )


def _gram_keys(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key of the n-gram at each place of an array of code points."""
    keys = np.full(max(0, len(points) - n + 1), n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            keys = (keys ^ points[k : k + len(keys)]) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(32)
    return keys


class Model:
    """Log frequencies: words by dictionary, n-grams by sorted keys."""

    def __init__(self, rows: list[tuple[str, int, str, int]]):
        """rows: (lang, n, gram, count)."""
        self.langs = sorted({r[0] for r in rows})
        place = {lang: k for k, lang in enumerate(self.langs)}
        tables: list[dict[str, np.ndarray]] = [{} for _ in range(LONGEST + 1)]
        for lang, n, gram, count in rows:
            tables[n].setdefault(gram, np.zeros(len(place)))[place[lang]] += count
        logs = []
        for table in tables:
            counts = np.array(list(table.values()), float).reshape(len(table), len(place)) + SMOOTHING
            logs.append((np.log(counts / counts.sum(axis=0)) if len(counts) else counts).astype(np.float32))
        self.words = {w: k for k, w in enumerate(tables[0])}
        self.word_logs = logs[0]
        self.grams = []
        for n in range(1, LONGEST + 1):
            keys = np.array([_gram_keys(np.array(list(map(ord, g)), np.uint64), n)[0] for g in tables[n]], np.uint64)
            order = np.argsort(keys)
            self.grams.append((keys[order], logs[n][order]))

    def unseen(self, words: list[str]) -> np.ndarray:
        """(words, langs): mean log frequencies by the longest n-grams that are known; zero if none is."""
        out = np.zeros((len(words), len(self.langs)))
        if not words:
            return out
        padded = " " + "  ".join(words) + " "
        points = np.array(list(map(ord, padded)), np.uint64)
        lengths = np.array([len(w) + 2 for w in words])
        owner = np.repeat(np.arange(len(words)), lengths)
        open_ = np.ones(len(words), bool)
        for n in range(LONGEST, 0, -1):
            keys, logs = self.grams[n - 1]
            if not len(keys):
                continue
            whole = owner[: len(points) - n + 1] == owner[n - 1 :]
            at = np.flatnonzero(whole & open_[owner[: len(points) - n + 1]])
            wanted = _gram_keys(points, n)[at]
            found = np.searchsorted(keys, wanted)
            found[found == len(keys)] = 0
            known = keys[found] == wanted
            mine, rows = owner[at[known]], found[known]
            number = np.bincount(mine, minlength=len(words))
            for k in range(len(self.langs)):
                out[:, k] += np.bincount(mine, logs[rows, k], len(words)) / np.maximum(number, 1)
            open_ &= number == 0
        return out

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, langs) sums of log frequencies, and whether the text has a letter."""
        out, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), bool)
        new, counts, owners = [], [], []
        for k, text in enumerate(texts):
            found = Counter(words_of(text))
            letters[k] = bool(found)
            if not found:
                continue
            rows = np.fromiter(map(self.words.get, found, repeat(-1)), np.int64, len(found))
            times = np.fromiter(found.values(), np.float64, len(found))
            known = rows >= 0
            out[k] = times[known] @ self.word_logs[rows[known]] if known.any() else 0
            if not known.all():
                new += [w for w, r in zip(found, rows.tolist()) if r < 0]
                counts.append(times[~known])
                owners.append(np.full(int((~known).sum()), k))
        if new:
            owners, values = np.concatenate(owners), self.unseen(new) * np.concatenate(counts)[:, None]
            for k in range(len(self.langs)):
                out[:, k] += np.bincount(owners, values[:, k], len(texts))
        return out, letters


def fit(labelled: DataFrame) -> Model:
    """Of documents(doc_id, text, lang, ...), a bounded sample of the rows with a lang and a text."""
    labelled = labelled.filter("lang is not null and text is not null")
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().limit(MOST_LANGS + 1).collect()}
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not counts:
        return Model([])
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, SAMPLE_DOCS / n))])[F.col("lang")]
    drawn = labelled.filter(F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 20)) < rate * (1 << 20))
    grams = cut(drawn.select("lang", "text").mapInArrow(_counts, "lang string, n int, gram string, count long").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count")))
    is_word = F.col("n") == 0
    place = F.row_number().over(Window.partitionBy("lang", is_word).orderBy(F.desc("count"), "n", "gram"))
    chosen = grams.withColumn("place", place).filter(F.col("place") <= F.when(is_word, WORDS // len(counts)).otherwise(GRAMS // len(counts)))
    held = grams.join(chosen.select("n", "gram").distinct(), ["n", "gram"], "left_semi")
    return Model([tuple(r) for r in held.select("lang", "n", "gram", "count").toPandas().itertuples(index=False)])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of documents(doc_id, text, lang, ...).

    The model learns from the text and non-null lang of rows that aren't held out; predictions use the text alone. lang_pred is
    a learned language, of equal scores the first by name, or und with score 0 if the text is null or has no letter, or if
    there is nothing to learn from. score: the language's share under equal priors. A null doc_id is neither learned from nor
    held out. Repeated rows are judged alike; empty in, empty out.
    """
    model = fit(docs.filter("doc_id is not null").filter(~held_out()))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in text_slices(batches):
            scores, letters = model.scores(batch.column("text").to_pylist())
            letters &= bool(model.langs)
            names, shares = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            if model.langs:
                best = scores.argmax(axis=1)
                share = 1 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
                names[letters], shares[letters] = np.array(model.langs, object)[best[letters]], share[letters]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(shares)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
