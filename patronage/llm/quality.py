"""Quality by naive Bayes support vectors.

Indicators of n-grams are scaled by their class log-count ratios, which count all training rows, and
a linear model with hinge loss is fitted on a bounded sample by dual coordinate descent. Margins
become probabilities by a logistic curve through margins of rows the model had not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm import ngrams as N
from patronage.llm.work import lean

SAMPLE_ROWS = 8_000
LEAST_ROWS = 5  # rows of the rarer class that hold an n-gram
GRAMS = 1 << 17  # of those, the commonest
COST = 1.0
PASSES = 15
FOLDS = 4


@dataclass
class Model:
    """Chosen n-grams with their log-count ratios and weights; the curve from margin to score."""

    grams: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, rows: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        margin = margins(self.ratios, self.weights, self.bias, rows, places, n)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))


def margins(ratios, weights, bias, rows, places, n) -> np.ndarray:
    """Of rows scaled to unit length."""
    length = np.sqrt(np.bincount(rows, ratios[places] ** 2, minlength=n))
    total = np.bincount(rows, (ratios * weights)[places], minlength=n)
    return total / np.maximum(length, 1e-12) + bias


def descend(
    ratios: np.ndarray, rows: list[np.ndarray], y: np.ndarray, cost: float, passes: int
) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model, one dual variable at a time."""
    w, bias, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(rows))
    values = []
    for places in rows:
        x = ratios[places]
        values.append(x / max(np.sqrt(x @ x), 1e-12))
    rng = np.random.default_rng(5)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x, places = values[i], rows[i]
            slope = y[i] * (w[places] @ x + bias) - 1
            size = 2.0 if len(places) else 1.0  # unit length and the bias
            new = min(max(alpha[i] - slope / size, 0.0), cost)
            if new != alpha[i]:
                change = (new - alpha[i]) * y[i]
                w[places] += change * x
                bias += change
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic slope and offset by Newton steps, with targets held off 0 and 1."""
    n, p = len(y), int((y > 0).sum())
    target = np.where(y > 0, (p + 1) / (p + 2), 1 / (n - p + 2))
    a, b = 1.0, float(np.log((p + 1) / (n - p + 1)))
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        error, spread = q - target, q * (1 - q) + 1e-9
        x = np.stack([margin, np.ones(n)], axis=1)
        step = np.linalg.solve((x * spread[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ error)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(float(a), 0.0), float(b)


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from rows with `doc_id`, `text` and `quality` (0 or 1).

    Rows without a label take no part; a null text is empty. Without both classes the score is the
    smoothed share of class 1, a half if there are no rows.
    """
    rows = labelled.where("quality IS NOT NULL").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("quality").cast("bigint")
    )
    n, good = rows.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0))).first()
    rarer = 1 if good < n - good else 0
    grams = N.frequent(
        rows.where(F.col("quality") == rarer), N.words_and_shapes, LEAST_ROWS, GRAMS
    )
    held, total = N.counts(rows, N.words_and_shapes, grams, ["quality"])
    positive = (held[:, 1] + 1) / (total[1] + 2)
    negative = (held[:, 0] - held[:, 1] + 1) / (total[0] - total[1] + 2)
    ratios = np.log(positive / negative)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, own, places in N.indicators(
                batch.column("text"), N.words_and_shapes, grams
            ):
                at = np.searchsorted(own, np.arange(high - low + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(places.astype(np.int64)))
                kept = [batch.column(c).slice(low, high - low) for c in ("doc_id", "quality")]
                yield pa.RecordBatch.from_arrays([*kept, lists], names=["doc_id", "quality", "places"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y, found = [], [], []
        for batch in batches:
            ids += batch.column("doc_id").to_pylist()
            y += batch.column("quality").to_pylist()
            column = batch.column("places")
            flat, at = column.values.to_numpy(), column.offsets.to_numpy()
            found += [flat[a:b] for a, b in zip(at[:-1], at[1:])]
        y = np.where(np.array(y, np.int64) > 0, 1.0, -1.0)
        keys = np.array([i or 0 for i in ids], np.int64).view(np.uint64)
        folds = N.W.mixed(keys) % np.uint64(FOLDS)
        unseen = np.zeros(len(y))
        for fold in range(FOLDS):
            inside = np.flatnonzero(folds != fold)
            w, b = descend(ratios, [found[i] for i in inside], y[inside], COST, PASSES)
            for i in np.flatnonzero(folds == fold):
                x = ratios[found[i]]
                unseen[i] = w[found[i]] @ x / max(np.sqrt(x @ x), 1e-12) + b
        slope, offset = _curve(unseen, y) if len(y) else (0.0, 0.0)
        w, b = descend(ratios, found, y, COST, PASSES)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.tolist()], pa.list_(pa.float64()))]
            + [pa.array([v], pa.float64()) for v in (b, slope, offset)],
            names=["weights", "bias", "slope", "offset"],
        )

    found = N.sampled(rows, sample_rows).mapInArrow(
        lean(pairs), "doc_id bigint, quality bigint, places array<bigint>"
    )
    row = (
        found.repartition(1)
        .sortWithinPartitions("doc_id", "places")
        .mapInArrow(lean(train), "weights array<double>, bias double, slope double, offset double")
        .first()
    )
    if row is None or good in (0, n):
        share = np.log((good + 1) / (n - good + 1))
        return Model(grams, ratios, np.zeros(len(grams)), 0.0, 0.0, float(share))
    weights = np.array(row["weights"])
    return Model(grams, ratios, weights, row["bias"], row["slope"], row["offset"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with `score` (0 to 1, higher: class 1 likelier), by their whole texts alone.

    Null and empty texts hold no n-gram and get the score of the bias. A column `score` is replaced.
    """
    rows = docs.drop("score")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                model.scores(own, places, high - low)
                for low, high, own, places in N.indicators(
                    batch.column("text"), N.words_and_shapes, model.grams
                )
            ]
            column = pa.array(np.concatenate(found) if found else np.zeros(0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, column], names=[*batch.schema.names, "score"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(lean(scored), f"{schema}, score double")
