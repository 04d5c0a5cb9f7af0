"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct character 3- to 5-grams of its words. Log-count ratios are
counted over the training sample on the executors; the features that tell most are kept, each
scaled by its ratio, and a logistic regression is fitted to them, in which both classes weigh
the same.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_stage, documents, narrow
from .linear import Rows, fit, gram_numbers, sigmoid

BITS, SIZES = 20, (3, 4, 5)
#: Labelled rows of each class that are fitted at most, and features that are kept.
SAMPLE, FEATURES = 6000, 5000


def sampled(labels: DataFrame, label: str, key: str = "doc_id", size: int = SAMPLE) -> tuple[list[tuple], dict[int, int]]:
    """Up to `size` (key, label) of each class, by hash of the key, and the classes' full counts.
    Rows without a key or with a label other than 0 and 1 are not used; of a repeated key, one."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias(label))
    counts = {int(r[label]): r["count"] for r in rows.groupBy(label).count().collect()}
    chosen = []
    for value in (0, 1):
        part = rows.where(F.col(label) == value).orderBy(F.xxhash64(key), key).limit(size)
        chosen += [(r[key], value) for r in part.select(key).collect()]
    return chosen, counts


def _texts(batch: pa.RecordBatch, name: str = "text") -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def features(text: str | None) -> np.ndarray:
    """The distinct numbers of a text's n-grams, ascending."""
    parts = [np.unique(p) for p in gram_numbers(text, BITS, SIZES, fold=True)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)


def known_features(text: str | None, table: np.ndarray) -> np.ndarray:
    """The same, of features that the table numbers at 0 or more, by these numbers."""
    parts = []
    for numbers in gram_numbers(text, BITS, SIZES, fold=True):
        found = table[numbers]
        parts.append(found[found >= 0])
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int32)


def _table(numbers: np.ndarray) -> np.ndarray:
    table = np.full(1 << BITS, -1, np.int32)
    table[numbers] = np.arange(len(numbers))
    return table


def _counts(train: DataFrame) -> DataFrame:
    """Rows of (feature, n1, n0): texts of each class that have the feature."""

    def run(stream):
        counts = np.zeros((2, 1 << BITS), np.int64)
        for batch in stream:
            for text, label in zip(_texts(batch), _texts(batch, "label"), strict=True):
                counts[int(label), features(text)] += 1
        some = np.flatnonzero(counts.sum(0))
        for at in range(0, len(some), 100_000):
            part = some[at : at + 100_000]
            yield pa.RecordBatch.from_pydict({"feature": pa.array(part, pa.int32()), "n1": pa.array(counts[1, part]), "n0": pa.array(counts[0, part])})

    return train.mapInArrow(run, "feature int, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


class Model:
    """Features by number, and the weight of each; picklable, of bounded size."""

    def __init__(self, numbers: np.ndarray, weights: np.ndarray, intercept: float):
        self.numbers, self.weights, self.intercept = numbers, weights, intercept

    def scorer(self):
        table = _table(self.numbers)
        return lambda text: float(sigmoid(self.intercept + self.weights[known_features(text, table)].sum()))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", size: int = SAMPLE, n_features: int = FEATURES) -> Model:
    """Fit on up to `size` labelled rows of each class. With one class or none among the labels,
    every text scores the smoothed share of label 1 (one half without labels)."""
    spark = docs.sparkSession
    chosen, counts = sampled(labels, label, key, size)
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    none = Model(np.empty(0, np.int64), np.empty(0), math.log((n1 + 1) / (n0 + 1)))
    if not n1 or not n0:
        return none
    kind = docs.schema[key].dataType.simpleString()
    picked = spark.createDataFrame(chosen, f"{key} {kind}, label int")
    sample = narrow(docs, key, "text").join(F.broadcast(picked), key)  # at most 2 x size rows
    sample = sample.dropDuplicates([key]).select("text", "label").coalesce(8)
    found = _counts(sample).where(F.col("n1") + F.col("n0") >= 3)
    s1, s0 = sum(y for _, y in chosen), sum(1 - y for _, y in chosen)
    ratio = F.log((F.col("n1") + 0.5) / (s1 + 1)) - F.log((F.col("n0") + 0.5) / (s0 + 1))
    strength = F.abs(ratio) / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    best = found.select("feature", ratio.alias("r"), strength.alias("s")).orderBy(F.desc("s"), "feature").limit(n_features).collect()
    if not best:
        return none
    numbers, ratios = np.array([x["feature"] for x in best]), np.array([x["r"] for x in best])

    def pick(stream):
        table = _table(numbers)
        for batch in stream:
            rows = [known_features(t, table).tobytes() for t in _texts(batch)]
            yield pa.RecordBatch.from_pydict({"x": pa.array(rows, pa.binary()), "label": pa.array(_texts(batch, "label"), pa.int32())})

    got = sample.mapInArrow(pick, "x binary, label int").collect()
    y = np.array([r["label"] for r in got], float)
    own = [np.frombuffer(r["x"], np.int32) for r in got]
    rows = Rows(own, [ratios[x] for x in own])
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b = fit(rows, y, len(numbers), weight, l2=1e-3)
    return Model(numbers, w * ratios, b)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns kept and score (0 to 1). A null or empty text has no features: its score is
    the intercept's. Every row gives one row."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double"

    def make():
        scorer = model.scorer()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            kept = {c: batch.column(batch.schema.get_field_index(c)) for c in keep}
            return pa.RecordBatch.from_pydict(kept | {"score": pa.array([scorer(t) for t in _texts(batch, text)], pa.float64())})

        return each

    return arrow_stage(narrow(docs, *keep, text), make, schema)


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(~held_out()), "toxic")
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
