"""Toxicity by a chain of classifiers, each fed the probabilities of the categories before it.

The features are words and the first bytes of longer words. Those that tell a category's rows from
the others are picked by counts over all labelled rows; the linear models are fitted on a bounded
sample. For the training of later links, the earlier categories' probabilities are made out of fold:
by models that have not seen the row. To score, each category's model of the whole sample is used.
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

SAMPLE_ROWS = 20_000
LEAST_ROWS = 5  # labelled rows of some category that hold a feature
CANDIDATES = 1 << 17
FEATURES = 512  # of the candidates, those that tell most
LEAST_GAIN = 20.0
FOLDS = 5
L2 = 1.0
STEPS = 15


@dataclass
class Chain:
    """For each category in order: weights of the features, then of the earlier probabilities, bias."""

    categories: list[str]
    grams: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: np.ndarray

    def probabilities(self, rows: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, len(self.categories)))
        for c in range(len(self.categories)):
            margin = np.bincount(rows, self.weights[c][places], minlength=n) + self.bias[c]
            out[:, c] = _sigmoid(margin + out[:, :c] @ self.earlier[c, :c])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _fit(
    rows: np.ndarray, places: np.ndarray, n: int, width: int, dense: np.ndarray, y: np.ndarray
) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on indicators and some dense columns, by Newton steps."""
    if not 0 < y.sum() < len(y):  # one class only
        sure = 20.0 if len(y) and y.all() else -20.0
        return np.zeros(width), np.zeros(dense.shape[1]), sure
    x = np.zeros((n, width + dense.shape[1] + 1), np.float32)
    x[rows, places] = 1
    x[:, width:-1], x[:, -1] = dense, 1
    theta = np.zeros(x.shape[1])
    theta[-1] = np.log(y.mean() / (1 - y.mean()))
    penalty = np.full(len(theta), L2)
    penalty[-1] = 1e-6
    for _ in range(STEPS):
        p = _sigmoid(x @ theta)
        slope = x.T @ (p - y) + penalty * theta
        bend = (x * (p * (1 - p))[:, None].astype(np.float32)).T @ x
        step = np.linalg.solve(bend + np.diag(penalty), slope)
        theta -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-3:
            break
    return theta[:width], theta[width:-1], float(theta[-1])


def _part(rows: np.ndarray, places: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of the kept rows, renumbered."""
    inside = kept[rows]
    return (np.cumsum(kept) - 1)[rows[inside]], places[inside]


def train_chain(
    rows: np.ndarray, places: np.ndarray, labels: np.ndarray, folds: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, weights of earlier probabilities and biases from (row, feature) pairs."""
    n, links = labels.shape
    weights, earlier, bias = np.zeros((links, width)), np.zeros((links, links)), np.zeros(links)
    unseen = np.zeros((n, links))  # out-of-fold probabilities
    for c in range(links):
        y, dense = labels[:, c].astype(float), unseen[:, :c]
        weights[c], earlier[c, :c], bias[c] = _fit(rows, places, n, width, dense, y)
        for fold in range(FOLDS) if c + 1 < links else ():
            out = folds == fold
            w, v, b = _fit(*_part(rows, places, ~out), int((~out).sum()), width, dense[~out], y[~out])
            held_rows, held_places = _part(rows, places, out)
            margin = np.bincount(held_rows, w[held_places], minlength=int(out.sum()))
            unseen[out, c] = _sigmoid(margin + dense[out] @ v + b)
    return weights, earlier, bias


def _gain(held: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Likelihood ratio statistic of each feature and the category it tells most about."""
    gain = np.zeros(held.shape)
    n = total[0]
    for with_it, labelled in ((True, True), (True, False), (False, True), (False, False)):
        row = held[:, :1] if with_it else n - held[:, :1]
        column = total[1:] if labelled else n - total[1:]
        both = held[:, 1:] if with_it else total[1:] - held[:, 1:]
        both = both if labelled else row - both
        expected = np.maximum(row * (column / max(n, 1)), 1e-9)
        gain[:, 1:] += 2 * both * np.log(np.maximum(both, 1e-9) / expected)
    return gain.max(axis=1, initial=0)


def fit(labelled: DataFrame, categories: list[str], sample_rows: int = SAMPLE_ROWS) -> Chain:
    """A chain from rows with `doc_id`, `text` and a 0/1 column for each category, in chain order.

    Rows with a null in a category take no part; a null text is empty. Without rows, or with one
    class only, the chain gives that class (none: 0) to all.
    """
    for c in categories:
        labelled = labelled.where(F.col(c).isNotNull()).withColumn(c, F.col(c).cast("bigint"))
    some = labelled.where(" OR ".join(f"`{c}` = 1" for c in categories))
    grams = N.frequent(some, N.words_and_stems, LEAST_ROWS, CANDIDATES)
    held, total = N.counts(labelled, N.words_and_stems, grams, categories)
    gain = _gain(held, total)
    best = np.argsort(-gain, kind="stable")[:FEATURES]
    grams = np.sort(grams[best[gain[best] >= LEAST_GAIN]])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, rows, places in N.indicators(
                batch.column("text"), N.words_and_stems, grams
            ):
                at = np.searchsorted(rows, np.arange(high - low + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(places.astype(np.int64)))
                own = [batch.column(c).slice(low, high - low) for c in ("doc_id", *categories)]
                yield pa.RecordBatch.from_arrays(
                    [*own, lists], names=["doc_id", *categories, "places"]
                )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, _schema(categories)).combine_chunks()
        lists = table.column("places").to_pylist()
        n = len(lists)
        rows = np.repeat(np.arange(n), [len(x) for x in lists]).astype(np.int64)
        places = np.array([p for x in lists for p in x], np.int64)
        labels = np.stack([table.column(c).to_numpy() for c in categories], axis=1)
        ids = table.column("doc_id").fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
        folds = N.W.mixed(ids) % np.uint64(FOLDS)
        weights, earlier, bias = train_chain(rows, places, labels, folds, len(grams))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x.tolist(), pa.list_(pa.float64())) for x in (weights, earlier)]
            + [pa.array(range(len(bias))), pa.array(bias)],
            names=["weights", "earlier", "link", "bias"],
        )

    kinds = ", ".join(f"`{c}` bigint" for c in categories)
    sample = N.sampled(labelled, sample_rows).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", *categories
    )
    found = sample.mapInArrow(lean(pairs), f"doc_id bigint, {kinds}, places array<bigint>")
    model = (
        found.repartition(1)
        .sortWithinPartitions("doc_id", "places")
        .mapInArrow(
            lean(train), "weights array<double>, earlier array<double>, link bigint, bias double"
        )
        .orderBy("link")
        .collect()  # a row for each category
    )
    return Chain(
        categories,
        grams,
        np.array([r["weights"] for r in model]).reshape(len(categories), len(grams)),
        np.array([r["earlier"] for r in model]),
        np.array([r["bias"] for r in model]),
    )


def _schema(categories: list[str]) -> pa.Schema:
    return pa.schema(
        [
            ("doc_id", pa.int64()),
            *((c, pa.int64()) for c in categories),
            ("places", pa.list_(pa.int64())),
        ]
    )


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """The documents with a probability `p_<category>` for each link of the chain.

    Whole texts are scored; null and empty texts have no features and get what the biases give.
    Columns of `docs` of those names are replaced.
    """
    names = [f"p_{c}" for c in chain.categories]
    rows = docs.drop(*names)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                chain.probabilities(own, places, high - low)
                for low, high, own, places in N.indicators(
                    batch.column("text"), N.words_and_stems, chain.grams
                )
            ]
            all_rows = np.concatenate(found) if found else np.zeros((0, len(names)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c) for c in all_rows.T.copy())],
                names=[*batch.schema.names, *names],
            )

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    return rows.mapInArrow(lean(scored), ", ".join([*schema, *(f"`{n}` double" for n in names)]))


# Words that name a person, and words that belittle: fixed values.
INSULTS = ("idiot", "moron", "loser", "clown", "scum")
CONTEMPT = ("pathetic", "worthless", "trash", "disgusting", "stupid")
CATEGORIES = ["insult", "contempt", "toxic"]
THRESHOLD = 0.3


def labelled_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents with the chain's categories, the first two by word among toxic ones."""
    rows = N.with_labels(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))

    def has(words: tuple[str, ...]) -> F.Column:
        found = F.coalesce(F.lower("text"), F.lit("")).rlike(rf"\b({'|'.join(words)})\b")
        return ((F.col("toxic") == 1) & found).cast("int")

    return rows.select(
        "doc_id",
        "text",
        has(INSULTS).alias("insult"),
        has(CONTEMPT).alias("contempt"),
        "toxic",
    )
