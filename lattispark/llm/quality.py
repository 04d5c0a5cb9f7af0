"""Quality by co-training.

Two logistic regressions look at a document from different sides: one at its text alone (hashed
character n-grams of its words, by how often they occur in so many words, and how its lines are laid
out), one at the page's metadata alone (source, language and recorded length). Both start from the labelled sample. In each round, each scores every unlabelled text, labels those of either class of which
it is surest, and hands these to the other. Each view is then calibrated on labelled rows that neither
has seen. As co-training takes the views to be independent given the class, a document's log-odds are
the sum of both views' less those of the labels' shares.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, arrow_stage, count_words, documents, drop, give_back, narrow, table
from .linear import Rows, fit, gram_numbers, platt, sigmoid
from .toxicity import _texts, sampled

BITS, SIZES = 15, (1, 2, 3)
#: Columns of the text view: hashed n-grams, then the layout of lines.
GRAMS, LAYOUT = 1 << BITS, 6
WIDTH = GRAMS + LAYOUT
#: Labelled rows of each class that take part in the fit, and pseudo-labels of each class that a
#: view gets from the other in the last round, at most.
SAMPLE, PSEUDO = 3000, 500
ROUNDS, CONFIDENT = 4, 0.95
#: Columns of the metadata view: hashed sources and languages, and recorded lengths by octave.
SOURCES, LANGS, LENGTHS = 4096, 256, 34
PAGE_WIDTH = SOURCES + LANGS + LENGTHS
#: A document is rejected below this score.
KEEP = 0.5


def layout(text: str) -> list[float]:
    """How many lines with a word there are, how long they are, how many repeat others, and bars."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    longest = max(map(len, lines), default=0)
    return [
        math.log1p(len(lines)) / 4,
        math.log1p(len(text) / max(len(lines), 1)) / 6,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        math.log1p(longest) / 6,
        text.count("|") / max(len(text), 1) * 20,
        float(not lines),
    ]


def text_view(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features and their values: of an n-gram, how often it occurs by ten words."""
    parts = list(gram_numbers(text, BITS, SIZES, fold=False)) or [np.empty(0, np.int64)]
    own, counts = np.unique(np.concatenate(parts), return_counts=True)
    shares = counts * (10 / max(count_words(text), 1))
    return np.append(own, np.arange(GRAMS, WIDTH)).astype(np.int32), np.append(shares, layout(text or "")).astype(np.float32)


def page_view(source: str | None, lang: str | None, n_chars: int | None) -> list[tuple[int, float]]:
    """Metadata by column. A null source, language or length has a column like any other value."""
    of = lambda value, width: zlib.crc32(repr(value).encode("utf-8", "surrogatepass")) % width
    octave = 0 if n_chars is None else 1 + min(max(int(n_chars), 0).bit_length(), LENGTHS - 2)
    return [(of(source, SOURCES), 1.0), (SOURCES + of(lang, LANGS), 1.0), (SOURCES + LANGS + octave, 1.0)]


class View:
    """A fitted view: weights, intercept and calibration."""

    def __init__(self, weights: np.ndarray, intercept: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.intercept, self.slope, self.shift = weights, intercept, slope, shift

    def odds(self, margin):
        return np.clip(self.slope * (margin + self.intercept) + self.shift, -20, 20)


class Model:
    """Both views, and the log-odds of the labels' shares. Without two classes of labels, both views
    give these alone."""

    def __init__(self, text: View, page: View, prior: float = 0.0):
        self.text, self.page, self.prior = text, page, prior


def cotrain(text: Rows, page: Rows, y: np.ndarray, more: Callable | None = None, rounds: int = ROUNDS, stands: tuple[float, float] = (1.0, 1.0)) -> Model:
    """y: 0 or 1. Every fifth row is kept for calibration, in which a row of class 0 or 1 stands for
    so many labelled rows. more(model, turn) gives, for each view, rows and labels that the other
    view is sure of; it is None where there is no unlabelled text."""
    every = np.arange(len(y))
    apart, start = every[::5], np.setdiff1d(every, every[::5])
    views = (text, page)
    widths = (WIDTH, PAGE_WIDTH)
    first = [v.take(start) for v in views]
    given = [(Rows([]), np.empty(0)), (Rows([]), np.empty(0))]
    fitted: list[tuple[np.ndarray, float]] = [(np.zeros(w), 0.0) for w in widths]
    n1, n0 = (stands[k] * max(float((y == k).sum()), 1e-9) for k in (1, 0))
    for turn in range(rounds + 1):
        for k in (0, 1):
            extra, labels = given[k]
            target = np.concatenate([y[start], labels])
            weight = np.concatenate([np.ones(len(start)), np.full(len(labels), 0.5)])
            ones = max((weight * (target == 1)).sum(), 1e-9)
            zeros = max((weight * (target == 0)).sum(), 1e-9)
            fitted[k] = fit(first[k].plus(extra), target, widths[k], weight * np.where(target == 1, 0.5 / ones, 0.5 / zeros), l2=1e-4, steps=60 if turn else 150, start=fitted[k])
        if turn == rounds or more is None:
            break
        given = more(Model(*(View(w.astype(np.float32), b) for w, b in fitted)), turn)
    out = []
    for k in (0, 1):
        w, b = fitted[k]
        slope, shift = platt(views[k].take(apart).dot(w) + b, y[apart], np.where(y[apart] == 1, stands[1], stands[0]))
        out.append(View(w.astype(np.float32), b, slope, shift))
    return Model(*out, math.log(n1 / n0))


def _featured(docs: DataFrame) -> DataFrame:
    """doc rows with label to rows of packed features of both views."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, v, p, q = [], [], [], []
            for t, s, lang, n in zip(*(_texts(batch, c) for c in ("text", "source", "lang", "n_chars")), strict=True):
                numbers, shares = text_view(t)
                page = page_view(s, lang, n)
                x.append(numbers.tobytes())
                v.append(shares.tobytes())
                p.append(np.array([a for a, _ in page], np.int32).tobytes())
                q.append(np.array([b for _, b in page], np.float32).tobytes())
            return pa.RecordBatch.from_pydict({c: pa.array(d, pa.binary()) for c, d in zip("xvpq", (x, v, p, q), strict=True)} | {"label": pa.array(_texts(batch, "label"), pa.int32())})

        return each

    return arrow_stage(docs, make, "x binary, v binary, p binary, q binary, label int")


def _packed(docs: DataFrame, picked: list[tuple], key: str) -> tuple[list[Rows], np.ndarray]:
    """The rows of both views, and the number that goes with each, of the (key, number) picked."""
    kind = docs.schema[key].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(picked, f"{key} {kind}, label int")
    rows = narrow(docs, key, "text", "source", "lang", "n_chars").join(F.broadcast(chosen), key)
    got = _featured(rows.dropDuplicates([key]).drop(key).coalesce(8)).toArrow()
    y = got.column("label").to_numpy().astype(int)
    raw = {c: got.column(c).to_pylist() for c in "xvpq"}
    del got
    order = sorted(range(len(y)), key=lambda k: (y[k], zlib.crc32(raw["x"][k]), zlib.crc32(raw["q"][k])))
    rows_of = lambda a, b: Rows([np.frombuffer(raw[a][k], np.int32) for k in order], [np.frombuffer(raw[b][k], np.float32) for k in order])
    out = [rows_of("x", "v"), rows_of("p", "q")]
    del raw
    give_back()
    return out, y[order]


def _surest(docs: DataFrame, known: DataFrame, model: Model, quota: int, key: str, sure: float = CONFIDENT) -> list[dict]:
    """For each view, its labels by key: up to `quota` unlabelled documents of each class that it is
    surest of, out of all. Of those it is equally sure of, by hash of the key."""
    scored = score(docs.where(F.col(key).isNotNull()), model, keep=(key,))
    columns = ("text_score", "page_score")
    either = [(F.col(c) >= sure) | (F.col(c) <= 1 - sure) for c in columns]
    # a few bytes a document; the texts aren't kept
    rows = table(scored.where(either[0] | either[1]).select(key, *columns).join(known, key, "left_anti"), "sure")
    out = []
    for c in columns:
        labels: dict = {}
        for label, chance in ((1, F.col(c)), (0, 1 - F.col(c))):
            top = rows.where(chance >= sure).groupBy(key).agg(F.max(chance).alias("chance"))
            for r in top.orderBy(F.desc("chance"), F.xxhash64(F.lit(7), F.col(key)), key).limit(quota).select(key).collect():
                labels.setdefault(r[key], label)
        out.append(labels)
    drop(rows)
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", size: int = SAMPLE, pseudo: int = PSEUDO) -> Model:
    """Fit on up to `size` labelled rows of each class, chosen by hash of the key, and in the last
    round on up to `pseudo` rows of each class that the other view is surest of among all unlabelled
    documents. Labels that have no row in docs are not used."""
    chosen, counts = sampled(labels, label, key, size)
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    flat = View(np.zeros(1), math.log((n1 + 1) / (n0 + 1)) if n1 or n0 else 1.0)
    if not n1 or not n0:
        return Model(flat, flat, flat.intercept)
    views, y = _packed(docs, chosen, key)  # at most 2 x size rows
    if not (y == 1).any() or not (y == 0).any():
        return Model(flat, flat, flat.intercept)
    known = labels.where(F.col(label).isin(0, 1)).select(key).distinct()
    free = narrow(docs, key).where(F.col(key).isNotNull()).join(known, key, "left_anti").distinct().count()

    def more(model: Model, turn: int) -> list[tuple[Rows, np.ndarray]]:
        quota = max(1, min(pseudo, free // 8) * (turn + 1) // ROUNDS)
        by_text, by_page = _surest(docs, known, model, quota, key)
        keys = [*dict.fromkeys([*by_text, *by_page])]
        if not keys:
            return [(Rows([]), np.empty(0))] * 2
        # both labels of a document in one number: from the text view, and from the page view
        both = [(k, 3 * by_text.get(k, 2) + by_page.get(k, 2)) for k in keys]
        rows, codes = _packed(docs, both, key)  # at most 4 x quota rows
        out = []
        for k, of in enumerate((codes % 3, codes // 3)):  # each view learns from the other
            has = np.flatnonzero(of < 2)
            out.append((rows[k].take(has), of[has].astype(float)))
        return out

    # the sample is capped class by class; calibration is to the labels' own shares
    stands = (n0 / min(n0, size), n1 / min(n1, size))
    made = cotrain(*views, y.astype(float), more if free else None, stands=stands)
    views.clear()
    give_back()
    return made


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), scores: bool = True) -> DataFrame:
    """The columns kept, text_score, page_score and score, each the chance of label 1. Nulls in
    any column have features of their own, and a null text counts as empty; texts of any length are
    read whole, in parts; every row gives one row, rows that repeat a key too, so an empty table
    gives none. Other columns are left out."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", text_score double, page_score double, score double"
    inputs = ("text", "source", "lang", "n_chars")
    others = [c for c in keep if c not in inputs]

    def make():
        weights = model.text.weights
        flat = len(weights) == 1

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b = [], []
            for t, s, lang, n in zip(*(_texts(batch, c) for c in inputs), strict=True):
                grams = 0.0 if flat else sum(float(weights[g].sum(dtype=np.float64)) for g in gram_numbers(t, BITS, SIZES, fold=False))
                a.append(0.0 if flat else grams * 10 / max(count_words(t), 1) + float(weights[GRAMS:] @ np.array(layout(t or ""))))
                b.append(0.0 if flat else sum(v * float(model.page.weights[k]) for k, v in page_view(s, lang, n)))
            x, y = model.text.odds(np.array(a)), model.page.odds(np.array(b))
            kept = {c: batch.column(batch.schema.get_field_index(c)) for c in keep}
            return pa.RecordBatch.from_pydict(kept | {"text_score": pa.array(sigmoid(x)), "page_score": pa.array(sigmoid(y)), "score": pa.array(sigmoid(x + y - model.prior))})

        return each

    return arrow_stage(narrow(docs, *others, *inputs), make, schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", "text_score", "page_score", "score", (F.col("score") >= KEEP).alias("kept"))
