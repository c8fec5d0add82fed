"""Toxicity as an ordinal grade: cumulative-link regression on sparse text features.

A text's features are its distinct words and word beginnings. One weight vector serves all ordered thresholds:
P(grade >= k) = sigmoid(w . x - b_k) with b_1 <= b_2 <= ...; the expected severity is the sum of these chances.

Grades come from the labels: 0 for a text that is not toxic; a toxic text has grade 2 if it shows more signs of
toxicity than half of the toxic texts do, else 1. The model is fitted on a bounded sample of labelled rows; every row of
the table is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from tracefork.llm.tables import free_name, settle

#: Toxic and other labelled rows that the fit reads, none longer than so many bytes, and features that are looked at and
#: kept; all bounds of the sample.
SAMPLE_ROWS, SAMPLE_BYTES, CANDIDATES, FEATURES = 6_000, 200_000, 20_000, 3_000
GRADES = 3
BEGINNINGS = range(3, 9)
STEPS, RATE, DECAY = 1000, 0.05, 1e-5
#: A feature is in at least so many toxic texts of the sample, and in this share of them.
LEAST, SHARE = 5, 0.02
WORD = re.compile(r"[^\W\d_]+")


def features_of(text: str | None) -> set[str]:
    """Distinct words and, marked by a star, beginnings of longer words."""
    words = set(WORD.findall((text or "").lower()))
    return words.union(w[:k] + "*" for w in words for k in BEGINNINGS if len(w) > k)


@dataclass
class Model:
    """Weights by feature, and the ordered thresholds."""

    weights: dict[str, float]
    thresholds: np.ndarray

    def score(self, text: str | None, known: dict[str, tuple[str, ...]]) -> float:
        """The weights of the features that the text has; ``known`` remembers those of words."""
        found: set[str] = set()
        for w in set(WORD.findall((text or "").lower())):
            own = known.get(w)
            if own is None:
                if len(known) > 300_000:
                    known.clear()
                names = [w, *(w[:k] + "*" for k in BEGINNINGS if len(w) > k)]
                own = known[w] = tuple(n for n in names if n in self.weights)
            if own:
                found.update(own)
        return sum(map(self.weights.__getitem__, sorted(found)))

    def chances(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...; one row for each score."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds, -50, 50)))


def fit(rows: list[list[int]], grades: np.ndarray, row_weights: np.ndarray, names: list[str]) -> Model:
    """Weights and thresholds by the weighted likelihood of the grades, in steps scaled by running means of the
    gradient. Every feature was chosen as a sign of toxicity, so its weight stays at 0 or above."""
    counts = np.array([len(r) for r in rows], np.int64)
    flat = np.fromiter((x for r in rows for x in r), np.int64, int(counts.sum()))
    row = np.repeat(np.arange(len(rows)), counts)
    w, first, steps = np.zeros(len(names)), np.zeros(1), np.zeros(GRADES - 2)
    means = [(np.zeros(x.shape), np.zeros(x.shape)) for x in (w, first, steps)]
    total = max(row_weights.sum(), 1e-9)
    padded = lambda p: np.concatenate((np.ones((len(p), 1)), p, np.zeros((len(p), 1))), 1)
    at = np.arange(len(rows))
    for step in range(1, STEPS + 1):
        thresholds = first + np.concatenate(([0.0], np.cumsum(np.exp(steps))))
        score = np.bincount(row, weights=w[flat], minlength=len(rows)) if len(flat) else np.zeros(len(rows))
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds, -50, 50)))
        full, slope = padded(p), padded(p * (1 - p))
        slope[:, 0] = 0.0
        chance = np.maximum(full[at, grades] - full[at, grades + 1], 1e-9)
        upper, lower = slope[at, grades] / chance, slope[at, grades + 1] / chance
        by_threshold = np.zeros((len(rows), GRADES + 1))  # of the log chance, by each score - threshold
        by_threshold[at, grades] += upper
        by_threshold[at, grades + 1] -= lower
        by_threshold = by_threshold[:, 1:GRADES] * row_weights[:, None] / total
        to_score = by_threshold.sum(1)
        of_w = np.bincount(flat, weights=to_score[row], minlength=len(names)) if len(flat) else np.zeros(len(names))
        of_b = by_threshold.sum(0)
        later = np.cumsum(of_b[::-1])[::-1]
        ascent = [of_w - DECAY * w, -np.array([of_b.sum()]), -later[1:] * np.exp(steps)]
        for value, gradient, (mean, square) in zip((w, first, steps), ascent, means):
            mean += 0.1 * (gradient - mean)
            square += 0.001 * (gradient**2 - square)
            value += RATE * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
        np.maximum(w, 0.0, out=w)
    kept = {n: float(x) for n, x in zip(names, w) if x}
    return Model(kept, first + np.concatenate(([0.0], np.cumsum(np.exp(steps)))))


FEATURE_COUNT = StructType([StructField("feature", StringType()), StructField("n", IntegerType())])


def counted(sample: DataFrame, allowed: frozenset[str] | None) -> DataFrame:
    """(``feature``, ``n``): in how many texts each feature is; only allowed ones if such are given."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = features_of(text)
                for f in found if allowed is None else found & allowed:
                    totals[f] = totals.get(f, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(totals.values(), pa.int32())], names=["feature", "n"])

    return sample.select("text").mapInArrow(count, FEATURE_COUNT).groupBy("feature").agg(F.sum("n").alias("n"))


def told(feature: str, counts: dict[str, int]) -> bool:
    """Whether a longer beginning or a word with the same count says the same."""
    if not feature.endswith("*"):
        return False
    stem = feature[:-1]
    return any(n == counts[feature] and f != feature and f.startswith(stem) for f, n in counts.items())


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a bounded sample of labelled documents, the same in every run. Labels that are null or contradict
    each other for one document are left out; without toxic labels every severity is 0."""
    marked = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("high"))
        .where("toxic = high and toxic in (0, 1)")
        .select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    )
    marked = settle(marked)
    there = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit("sample"), "doc_id")
    chosen = [marked.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(SAMPLE_ROWS) for t in (0, 1)]
    picked = chosen[0].unionByName(chosen[1])
    short = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id", "text")
    sample = settle(short.join(F.broadcast(picked), "doc_id"))  # at most 2 * SAMPLE_ROWS ids are shared
    n_toxic = min(there.get(1, 0), SAMPLE_ROWS)
    common = F.col("n") >= max(LEAST, SHARE * n_toxic)
    toxic = {
        r.feature: r.n
        for r in counted(sample.where("toxic = 1"), None).where(common).orderBy(F.desc("n"), "feature").limit(CANDIDATES).collect()
    }
    clean = {r.feature: r.n for r in counted(sample.where("toxic = 0"), frozenset(toxic)).collect()}
    n_clean = min(there.get(0, 0), SAMPLE_ROWS)
    odds = {f: np.log((n + 0.5) / (n_toxic + 1)) - np.log((clean.get(f, 0) + 0.5) / (n_clean + 1)) for f, n in toxic.items()}
    names = sorted((f for f, v in odds.items() if v > 3 and not told(f, toxic)), key=lambda f: (-odds[f], f))[:FEATURES]
    place = {f: i for i, f in enumerate(names)}
    used = StructType.fromDDL("toxic int, features array<int>")

    def use(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(place[f] for f in features_of(t) if f in place) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int32()))], names=["toxic", "features"])

    rows = sorted((r.toxic, r.features) for r in sample.select("toxic", "text").mapInArrow(use, used).collect())
    signs = sorted(len(f) for toxic, f in rows if toxic)
    if not signs or not names:
        return Model({}, np.full(GRADES - 1, 50.0))
    usual = max(signs[len(signs) // 2], 1)
    grades = np.array([toxic + (toxic and len(f) > usual) for toxic, f in rows], np.int64)
    weights = np.array([there[t] / max(sum(x == t for x, _ in rows), 1) for t in (0, 1)])[[t for t, _ in rows]]
    return fit([f for _, f in rows], grades, weights, names)


def grade_toxicity(docs: DataFrame, model: Model, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``severity`` (the expected grade), ``grade`` (the most thresholds that are passed with a chance of
    at least a half) and ``toxic`` (grade 1 or more).

    Null and wordless texts have no features. Rows don't depend on each other. Names that ``docs`` has already get a
    trailing underscore. Without ``keep_text`` the text column is left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    left = [c for c in docs.columns if keep_text or c != "text"]
    names = [free_name(docs, n) for n in ("severity", "grade", "toxic")]
    schema = StructType(
        [*(docs.schema[c] for c in left), StructField(names[0], DoubleType()), StructField(names[1], IntegerType()), StructField(names[2], BooleanType())]
    )
    text = docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            score = np.array([shared.value.score(t, known) for t in batch.column(text).to_pylist()], np.float64)
            p = shared.value.chances(score)
            grade = (p >= 0.5).sum(1).astype(np.int32)
            columns = [c for i, c in enumerate(batch.columns) if keep_text or i != text]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p.sum(1)), pa.array(grade), pa.array(grade > 0)], names=schema.names)

    return docs.mapInArrow(judge, schema)
