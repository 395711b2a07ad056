"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of pairs of neighbours
and of pairs with one word between (runs of letters and digits, lower case; no
pair crosses texts). FTRL-proximal keeps a learning rate for each coordinate and
sets the weights of most to exactly 0 (L1), so the model that is broadcast is
the list of the others, at most 2**BITS.

Null texts count as empty and get the score of the bias. Without labelled rows
every score is 0.5. Null labels teach nothing; a document with several labels
counts as toxic if one says so; rows that repeat a labelled id are learned each.
At most SAMPLE_ROWS labelled rows are learned from, those of the smallest hashes
of their ids, whole however long. Ties and repeated rows don't matter to scores;
an empty table gives an empty result; more columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

BITS = 20
#: The most labelled rows that are learned from, each with all of its features.
SAMPLE_ROWS = 12_000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 4.0, 0.01, 5
THRESHOLD = 0.3

_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:] = False


def grams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash below 2**BITS) of each word, neighbours and skip pair."""
    low = blocks.lower(raw)
    start, end, first = blocks.words(low, off, _GAP)
    name = blocks.word_names(low, start, end)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    out, owner = [name], [text]
    for gap, factor in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F)):
        same = text[gap:] == text[:-gap]
        out.append(blocks.mix(name[:-gap] * blocks.U(factor) + name[gap:])[same])
        owner.append(text[gap:][same])
    return np.concatenate(owner), (np.concatenate(out) >> blocks.U(64 - BITS)).astype(np.int32)


class Ftrl:
    """FTRL-proximal for logistic loss; feature values are 1, index 2**BITS is the bias."""

    def __init__(self) -> None:
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        grown = np.sqrt(self.n[at] + g * g)
        self.z[at] += g - (grown - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g


class Model:
    """Indices and weights other than 0, and the bias."""

    def __init__(self, at: np.ndarray, weight: np.ndarray, bias: float):
        self.at, self.weight, self.bias, self._dense = at, weight, bias, None

    def __getstate__(self):
        return self.at, self.weight, self.bias, None

    def __setstate__(self, state):
        self.at, self.weight, self.bias, self._dense = state

    def score(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self._dense is None:
            self._dense = np.zeros(1 << BITS)
            self._dense[self.at] = self.weight
        text, at = grams(raw, off)
        hit = np.flatnonzero(self._dense[at])
        key = np.unique((text[hit].astype(np.int64) << BITS) | at[hit])
        s = np.bincount(key >> BITS, self._dense[key & ((1 << BITS) - 1)], len(off) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(s, -35, 35)))


def sampled(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int) -> DataFrame:
    """doc_id, text and label of at most ``rows`` labelled training documents; ids are chosen before texts are read."""
    known = labels.where(train & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``rows`` ids


def fit(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int = SAMPLE_ROWS) -> Model:
    """Learns on the driver from all hashes of at most ``rows`` texts: 4 bytes for each distinct one of a text, so 4 * 2**BITS at most."""
    blocks.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists: list[np.ndarray] = []
            for _, raw, off in blocks.texts(batch.column("text")):
                text, at = grams(raw, off)
                key = np.unique((text.astype(np.int64) << BITS) | at)
                lists += [x.astype(np.int32) for x in np.split(key & ((1 << BITS) - 1), np.searchsorted(key >> BITS, np.arange(1, len(off) - 1)))]
            packed = pa.array([x.tobytes() for x in lists], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("_order"), batch.column("_label"), packed], ["o", "y", "x"])

    data = sampled(docs, labels, label, train, rows)
    mixed = F.xxhash64(F.lit(9), "doc_id")  # mixes sources and ages
    got = data.withColumn("_order", mixed).mapInArrow(run, "o long, y int, x binary").toPandas()
    if not len(got):
        return Model(np.zeros(0, np.int32), np.zeros(0), 0.0)
    got = got.sort_values(["o", "x"], kind="stable")
    model = Ftrl()
    xs = [np.append(np.frombuffer(x, np.int32), np.int32(1 << BITS)) for x in got["x"]]
    ys = got["y"].to_numpy()
    for _ in range(EPOCHS):
        for x, y in zip(xs, ys):
            model.learn(x, int(y))
    w = model.weights()
    at = np.flatnonzero(w[:-1]).astype(np.int32)
    return Model(at, w[at], float(w[-1]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row, in one map over the texts."""
    spark = docs.sparkSession
    blocks.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # at most 2**BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [shared.value.score(raw, off) for _, raw, off in blocks.texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate([np.zeros(0), *s]), pa.float64())], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
