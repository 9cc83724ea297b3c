"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

Labels say toxic or not. Grades: 0 not toxic, 1 toxic, 2 toxic with more telling terms than the median toxic text of the
fitting sample. P(grade >= k) = sigmoid(w.x - theta_k) with thresholds theta_1 <= theta_2 and one weight vector for all.
Features: the words and word prefixes that set the labelled toxic texts apart; a text has them or not.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymerge.plans.storage import written

from .common import slices, widened

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5)
GRADES = 3
SAMPLE = 50_000  # labelled rows that a model learns from


def terms(text: str) -> Counter:
    """Words of the case-folded text, and prefixes of longer words, with counts."""
    words = Counter(WORD.findall(text.lower()))
    out = Counter(words)
    for n in PREFIXES:
        for w, c in words.items():
            if len(w) > n:
                out[f"{w[:n]}*"] += c
    return out


def select_features(labelled: DataFrame, most: int = 4096, least_docs: int = 5, z: float = 6.0) -> list[str]:
    """The terms whose share among toxic texts exceeds that among others by ``z`` standard errors, strongest first.

    Document counts cover all rows given; ``most`` bounds the vocabulary, ``least_docs`` the toxic texts a term needs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, grade in zip(batch.column("text").to_pylist(), batch.column("grade").to_pylist()):
                counts[grade > 0].update(terms(text or "").keys())
            names = sorted(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([counts[0][x] for x in names], pa.int64()), pa.array([counts[1][x] for x in names], pa.int64())],
                ["term", "clean", "toxic"])

    sizes = labelled.agg(F.sum((F.col("grade") > 0).cast("bigint")).alias("t"), F.count("*").alias("n")).first()
    toxic, clean = sizes.t or 0, (sizes.n or 0) - (sizes.t or 0)
    if not toxic or not clean:
        return []
    counted = labelled.select("text", "grade").mapInArrow(run, "term string, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    share = (F.col("c") + F.col("t") + 1) / (toxic + clean + 2)
    score = (F.col("t") / toxic - F.col("c") / clean) / F.sqrt(share * (1 - share) * (1 / toxic + 1 / clean))
    best = counted.where(F.col("t") >= least_docs).withColumn("z", score).where(F.col("z") > z).orderBy(F.desc("z"), "term").limit(most)
    return [r.term for r in best.select("term").collect()]


class Ordinal:
    """weights (one per feature) and thresholds of the cumulative logits."""

    def __init__(self, features: list[str], weights: np.ndarray, thresholds: np.ndarray):
        self.features, self.weights, self.thresholds = features, weights, thresholds
        self.index = {f: i for i, f in enumerate(features)}

    def vector(self, text: str) -> list[int]:
        return _vector(text, self.index)

    def cumulative(self, text: str) -> list[float]:
        """P(grade >= 1), P(grade >= 2)."""
        x = sum(self.weights[i] for i in self.vector(text))
        return [1 / (1 + math.exp(-max(-500.0, min(500.0, x - t)))) for t in self.thresholds]


def _vector(text: str, index: dict[str, int]) -> list[int]:
    return [i for term in terms(text) if (i := index.get(term)) is not None]


def fit(labelled: DataFrame, sample: int = SAMPLE, steps: int = 800, l2: float = 1e-3, **selection) -> Ordinal:
    """Fit on (doc_id, text, grade). Features are chosen over all rows given; weights are fitted on the
    ``sample`` rows that come first by hash, of which the driver gets the grade and the few chosen features only. The second threshold has no labels of its
    own: grade 2 is read from the number of a toxic text's telling terms, so it grades how strongly the features speak, not a judged severity. Without both
    toxic and other rows the model has no features and calls nothing toxic."""
    features = select_features(labelled, **selection)
    index = {f: i for i, f in enumerate(features)}
    if not features:
        return Ordinal([], np.zeros(0), np.full(GRADES - 1, 5.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            vectors = [_vector(t or "", index) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), batch.column("grade"), pa.array(vectors, pa.list_(pa.int32()))], ["h", "grade", "at"])

    rows = labelled.select(F.xxhash64("doc_id", "text").alias("h"), F.col("grade").cast("int").alias("grade"), "text").mapInArrow(run, "h bigint, grade int, at array<int>")
    got = rows.orderBy("h").limit(sample).collect()
    return Ordinal(features, *_train(got, len(features), steps, l2))


def _train(rows, width: int, steps: int, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Full gradient descent on the mean negative log-likelihood, with a step size of its own for each coordinate."""
    n = len(rows)
    lengths = np.array([len(r["at"]) for r in rows])
    grade = np.array([r.grade for r in rows])
    grade = np.where((grade > 0) & (lengths > np.median(lengths[grade > 0])), 2, grade) if (grade > 0).any() else grade
    at = np.array([i for r in rows for i in r["at"]], np.int64)
    row = np.repeat(np.arange(n), lengths)
    w, theta = np.zeros(width), np.zeros(GRADES - 1)
    for k in range(1, GRADES):
        p = (np.sum(grade >= k) + 0.5) / (n + 1)
        theta[k - 1] = math.log((1 - p) / p)
    gw, gt = np.full(width, 1e-8), np.full(GRADES - 1, 1e-8)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for _ in range(steps):
        x = np.bincount(row, w[at], n)
        cum = np.column_stack([np.ones(n), *(sigmoid(x - t) for t in theta), np.zeros(n)])
        upper, lower = cum[np.arange(n), grade], cum[np.arange(n), grade + 1]
        p = np.maximum(upper - lower, 1e-12)
        d_up, d_low = upper * (1 - upper) / p, lower * (1 - lower) / p
        grad_w = np.bincount(at, ((d_low - d_up) / n)[row], width) + l2 * w / n
        grad_t = np.array([np.sum(d_up[grade == k]) - np.sum(d_low[grade == k - 1]) for k in range(1, GRADES)]) / n
        gw += grad_w**2
        gt += grad_t**2
        w = w - 0.5 * grad_w / np.sqrt(gw)
        theta = np.maximum.accumulate(theta - 0.5 * grad_t / np.sqrt(gt))
    return w, theta


def grades(labels: DataFrame) -> DataFrame:
    """doc_id and grade (0 or 1, before the sample's median is known): null toxic or doc_id drops the row; of repeated doc_ids the highest counts."""
    known = labels.where("doc_id is not null and toxic is not null")
    return known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("grade"))


def labelled_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, grade) of the bounded sample that a model learns from: the ``sample`` labelled doc_ids that come first by hash.

    Their list (12 bytes each) is broadcast, so texts do not move; the sample's texts are written once.
    """
    chosen = grades(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id"), "labelled")


def score(docs: DataFrame, model: Ordinal, limit: float = 0.5) -> DataFrame:
    """docs' rows and columns with ``__severity`` (expected grade, 0 to 2), ``__grade`` (most probable) and ``__toxic`` (P(grade >= 1) >= limit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            severity, grade, toxic = [], [], []
            for text in batch.column("text").to_pylist():
                up = model.cumulative(text or "")
                each = [a - b for a, b in zip([1.0, *up], [*up, 0.0])]
                severity.append(sum(up)), grade.append(each.index(max(each))), toxic.append(up[0] >= limit)
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns |= {"__severity": pa.array(severity, pa.float64()), "__grade": pa.array(grade, pa.int32()), "__toxic": pa.array(toxic, pa.bool_())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, widened(docs.schema, "__severity double, __grade int, __toxic boolean"))


def severities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity, grade, toxic per document row. Null and empty texts have no features and get the base rate. Each row is
    scored by itself: repeated rows agree, null doc_ids are scored but never labelled, other columns are not read, empty tables give empty results."""
    model = fit(labelled_documents(docs, labels))
    return score(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), model).selectExpr("doc_id", "__severity severity", "__grade grade", "__toxic toxic")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not judged toxic, all columns."""
    return score(docs, fit(labelled_documents(docs, labels))).where("not __toxic").drop("__severity", "__grade", "__toxic")
