"""Document quality by Bradley-Terry pairwise ranking.

A document's score is a linear function of its features; the chance that one
document is preferred over another is the logistic function of the difference
of their scores. Each pair takes one document labelled 1 and one labelled 0,
and the weights minimise the logistic loss on feature differences. The cut is a
quantile of the training scores (the share of label 0), and scores are mapped to
0..1 so that the cut lies at THRESHOLD.

Every labelled training row counts, however many there are. Their features are
staged in the shared folder, where the bins' edges and the cut are exact
quantiles, found digit by digit from counts. Rows meet in pairs in buckets by
the hash of the id: each takes part in OPPONENTS pairs at least (in a bucket
without the other label, against that label's row of the smallest hash). A step
of Newton's method is a sum over all pairs; the driver sees sums only.

Features are computed from the whole text alone; they are binned at training
quantiles, so that the ranking may bend. Null texts count as empty and get the
score of the empty text. Without pairs (no rows of one of the labels) every
score is the share of label 1, or 0.5 without any label. Null labels teach
nothing; of several labels of a document the largest counts; rows that repeat a
labelled id are learned each. Texts of any length count whole; ties and repeated
rows don't matter to scores; an empty table gives an empty result; more columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .exchange import Answers, Staged, _batches, drop_folder, shared_folder

BINS, RIDGE, STEPS = 12, 1e-3, 30
#: Pairs of each row at least; rows of a bucket of pairs, until there are so many buckets; bits that a round of quantiles decides.
OPPONENTS, BUCKET_ROWS, BUCKETS, DIGIT = 2, 20_000, 200, 11
THRESHOLD = 0.3

_KIND = np.zeros(256, np.int8)  # 0 other, 1 lower or non-ASCII, 2 upper, 3 digit, 4 punctuation of prose, 5 symbol
_KIND[33:127] = 5
_KIND[48:58] = 3
_KIND[65:91] = 2
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = 4
FEATURES = 12


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """FEATURES numbers for each text: sizes, shares of kinds of characters, repetition."""
    n = len(off) - 1
    kind = _KIND[raw]

    def total(mask: np.ndarray, at: np.ndarray = off) -> np.ndarray:
        s = np.zeros(len(mask) + 1, np.float64)
        np.cumsum(mask, out=s[1:])
        return np.diff(s[at])

    start, end, first = blocks.words(raw, off)
    size = np.diff(off).astype(float)
    count = np.diff(first).astype(float)
    letters = total(kind == 1) + total(kind == 2)
    name = blocks.word_names(raw, start, end)
    owner = np.repeat(np.arange(n), np.diff(first))
    key = np.sort((owner.astype(np.uint64) << np.uint64(42)) | (name >> np.uint64(22)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[new] >> np.uint64(42)).astype(np.int64), minlength=n)
    same = np.zeros(len(name), bool)
    same[1:] = (name[1:] == name[:-1]) & (owner[1:] == owner[:-1])
    ends = raw[end - 1] if len(end) else np.zeros(0, np.uint8)
    one = np.maximum(count, 1)
    length = (end - start).astype(float)
    mean = total(length, first) / one
    newline = total(raw == 10)
    return np.column_stack(
        [
            np.log1p(size),
            total(kind == 2) / np.maximum(letters, 1),
            total(kind == 3) / np.maximum(size, 1),
            total(kind == 4) / one,
            total(kind == 5) / one,
            total(raw == 33) / one,
            newline / one,
            mean,
            np.sqrt(np.maximum(total(length**2, first) / one - mean**2, 0)),
            distinct / np.sqrt(one),
            total(same, first) / one,
            total(_KIND[ends] == 5, first) / one,
        ]
    )


class Model:
    """Cut points of the features, weights of their bins, and the map of scores to 0..1; or one score for all."""

    def __init__(self, cuts: list[np.ndarray], constant: float | None = None):
        self.cuts, self.constant = cuts, constant
        self.columns = sum(map(len, cuts))
        self.cut, self.scale = 0.0, 1.0

    def weigh(self, w: np.ndarray) -> None:
        """Takes the weights of ``bins``: a bin's value is the sum over the cut points that it lies beyond."""
        self.values = [np.append(0, np.cumsum(x)) for x in np.split(w, np.cumsum([len(c) for c in self.cuts])[:-1])]

    def pattern(self, x: np.ndarray) -> np.ndarray:
        """How many of its cut points each feature has passed, 4 bits each."""
        out = np.zeros(len(x), np.int64)
        for k, c in enumerate(self.cuts):
            out |= np.searchsorted(c, x[:, k], side="left") << (4 * k)
        return out

    def bins(self, pattern: np.ndarray) -> np.ndarray:
        """One column a cut point: 1 if the feature has passed it."""
        return np.concatenate([((pattern >> (4 * k)) & 15)[:, None] > np.arange(len(c)) for k, c in enumerate(self.cuts)], axis=1).astype(np.float64)

    def raw(self, pattern: np.ndarray) -> np.ndarray:
        s = np.zeros(len(pattern))
        for k, v in enumerate(self.values):
            s += v[(pattern >> (4 * k)) & 15]
        return s

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        s = (self.raw(self.pattern(x)) - self.cut) * self.scale + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float64()))


# --- exact quantiles


def _keys(x: np.ndarray) -> np.ndarray:
    """Numbers in the order of the floats."""
    bits = (x + 0.0).view(np.uint64)  # one zero only
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _float(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else ~key & (1 << 64) - 1
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def quantiles(rows: DataFrame, wanted: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
    """Linear quantiles of each column of ``x``, an array of doubles in which NaN is no value; wanted: how many values a column has, and the shares.

    A round tells DIGIT more bits of each value that is looked for, from counts of the values that share the bits known so far.
    """
    sought = sorted({(c, r) for c, (n, shares) in enumerate(wanted) for q in shares for r in (int((n - 1) * q), min(int((n - 1) * q) + 1, n - 1))})
    known = {s: (0, s[1]) for s in sought}  # bits, and the rank among the values that have them
    done = 64
    while done:
        shift = max(done - DIGIT, 0)
        size = 1 << (done - shift)
        groups = [np.array(sorted({known[s][0] for s in sought if s[0] == c}), np.uint64) for c in range(len(wanted))]
        first = np.cumsum([0, *map(len, groups)])

        def count(batches: Iterator[pa.RecordBatch], done: int = done, shift: int = shift, size: int = size, groups: list = groups, first: np.ndarray = first) -> Iterator[pa.RecordBatch]:
            total = np.zeros(int(first[-1]) * size, np.int64)
            for batch in batches:
                x = _numbers(batch.column(0), len(groups))
                for c, group in enumerate(groups):
                    key = _keys(x[:, c][~np.isnan(x[:, c])])
                    start = key >> np.uint64(done) if done < 64 else np.zeros(len(key), np.uint64)
                    at = np.minimum(np.searchsorted(group, start), max(len(group) - 1, 0))
                    on = np.flatnonzero(group[at] == start) if len(group) else at[:0]
                    digit = (key[on] >> np.uint64(shift)) & np.uint64(size - 1)
                    np.add.at(total, (first[c] + at[on]) * size + digit.astype(np.int64), 1)
            cell = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(total[cell], pa.int64())], ["cell", "n"])

        total = np.zeros(int(first[-1]) * size, np.int64)
        told = rows.select("x").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        total[told["cell"].to_numpy(np.int64)] = told["n"].to_numpy(np.int64)
        for s in sought:
            bits, rank = known[s]
            row = int(first[s[0]] + np.searchsorted(groups[s[0]], np.uint64(bits)))
            below = np.cumsum(total[row * size : (row + 1) * size])
            digit = int(np.searchsorted(below, rank, side="right"))
            known[s] = (bits << (done - shift)) | digit, rank - int(below[digit - 1] if digit else 0)
        done = shift

    def value(c: int, n: int, q: float) -> float:
        low, share = int((n - 1) * q), (n - 1) * q - int((n - 1) * q)
        a, b = (_float(known[c, r][0]) for r in (low, min(low + 1, n - 1)))
        return a + (b - a) * share if share < 0.5 else b - (b - a) * (1 - share)

    return [np.array([value(c, n, q) for q in shares]) for c, (n, shares) in enumerate(wanted)]


# --- learning


def _features(docs: DataFrame) -> DataFrame:
    """doc_id and features of every row."""
    blocks.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(raw, off) for _, raw, off in blocks.texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(np.concatenate([np.zeros((0, FEATURES)), *x]))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, x array<double>")


def _staged(rows: DataFrame, at: str) -> DataFrame:
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def _paired(binned: DataFrame, n: int, spare: tuple[int, int]) -> DataFrame:
    """Patterns of rows labelled 1 and 0 that are compared; spare: those that stand in for a label that a bucket hasn't."""
    buckets = min(-(-n // BUCKET_ROWS), BUCKETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[batch.column(k).to_numpy() for k in range(3)] for batch in batches]
        if not held:
            return
        h, y, z = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((y, z, h))
        y, z = y[order], z[order]
        good, bad = (z[y == label] if (y == label).any() else np.array([x], np.int64) for label, x in ((1, spare[0]), (0, spare[1])))
        i = np.arange(max(len(good), len(bad)))
        for k in range(OPPONENTS):
            yield pa.RecordBatch.from_arrays([pa.array(good[i % len(good)]), pa.array(bad[(i + k) % len(bad)])], ["good", "bad"])

    return binned.select("h", "y", "z").repartitionById(buckets, F.pmod("h", F.lit(buckets)).cast("int")).mapInArrow(run, "good long, bad long")


def _weights(pairs: Staged, model: Model) -> np.ndarray:
    """Newton's method on the logistic loss of the differences of all pairs; the sums of a step are always added in one order."""
    w = np.zeros(model.columns)
    for _ in range(STEPS):

        def work(file: int, path: str, _: Answers, w: np.ndarray = w) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(w) + 1, len(w)))
            n = 0
            for batch in _batches(path, 1000, ["good", "bad"]):
                d = model.bins(batch.column(0).to_numpy()) - model.bins(batch.column(1).to_numpy())
                p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
                total[:-1] += (d * (p * (1 - p))[:, None]).T @ d
                total[-1] += d.T @ p
                n += len(d)
            yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["file", "n", "total"])

        told = sorted(pairs.run([], work, "file int, n long, total binary").collect(), key=lambda r: r["file"])
        n = sum(r["n"] for r in told)
        total = sum(np.frombuffer(r["total"]).reshape(len(w) + 1, len(w)) for r in told)
        step = np.linalg.solve(total[:-1] / n + RIDGE * np.eye(len(w)), total[-1] / n - RIDGE * w)
        w = w + step
        if np.abs(step).max(initial=0) < 1e-8:
            break
    return w


def _learned(x: DataFrame, labels: DataFrame, label: str, train: Column, folder: str) -> Model:
    known = labels.where(train & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    rows = _staged(x.join(known, "doc_id").select(F.xxhash64("doc_id").alias("h"), "y", "x"), f"{folder}/train")
    by = {r["y"]: r for r in rows.groupBy("y").agg(F.count("*").alias("n"), F.min(F.struct("h", "x")).alias("least")).collect()}
    n = sum(r["n"] for r in by.values())
    if 0 not in by or 1 not in by:
        return Model([], sum(y * r["n"] for y, r in by.items()) / n if n else 0.5)
    model = Model([np.unique(q) for q in quantiles(rows, [(n, np.linspace(0, 1, BINS + 1)[1:-1])] * FEATURES)])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = model.pattern(_numbers(batch.column(2), FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.int64())], ["h", "y", "z"])

    patterns = _staged(rows.mapInArrow(binned, "h long, y int, z long"), f"{folder}/binned")
    spare = tuple(int(model.pattern(np.array([by[y]["least"]["x"]]))[0]) for y in (1, 0))
    model.weigh(_weights(Staged.of(_paired(patterns, n, spare), folder, "pairs", 0), model))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, s = batch.column(1).to_numpy(), model.raw(batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([_lists(np.stack([s, np.where(y == 1, s, np.nan), np.where(y == 0, s, np.nan)], 1))], ["x"])

    half = np.array([0.5])
    cut, good, bad = quantiles(patterns.mapInArrow(scored, "x array<double>"), [(n, np.array([by[0]["n"] / n])), (by[1]["n"], half), (by[0]["n"], half)])
    model.cut, model.scale = float(cut[0]), 4 / max(float(good[0] - bad[0]), 1e-6)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str, train: Column) -> Model:
    spark = docs.sparkSession
    folder = shared_folder(spark)
    model = _learned(_staged(_features(docs), f"{folder}/features"), labels, label, train, folder)  # features, not texts, meet the labels
    drop_folder(spark, folder)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row, in one map over the texts."""
    return _scores(_features(docs), model)


def fit_predict(docs: DataFrame, labels: DataFrame, label: str, train: Column) -> DataFrame:
    """What ``predict`` says after ``fit``, with one map over the texts for both."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    out = f"{folder}-quality"
    x = _staged(_features(docs), f"{folder}/features")
    scores = _staged(_scores(x, _learned(x, labels, label, train, folder)), out)
    drop_folder(spark, folder)
    return scores


def _scores(x: DataFrame, model: Model) -> DataFrame:
    shared = x.sparkSession.sparkContext.broadcast(model)  # FEATURES * BINS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(_numbers(batch.column(1), FEATURES)), pa.float64())], ["doc_id", "score"])

    return x.mapInArrow(run, f"doc_id {dict(x.dtypes)['doc_id']}, score double")
