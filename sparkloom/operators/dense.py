"""Vector search: exact scan and an inverted-file index.

Both keep positive cosines only, ranked by (similarity desc, id). The index
clusters vectors around centroids (the vectors with the smallest hashes of their
ids, moved by a few Lloyd steps), probes the nearest lists of a query and scores
their vectors exactly; probing all lists gives the exact scan's result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config, DenseScanTooLarge


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "id")
    return scored.where("similarity > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "id", "similarity", "rank")


def _score(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, k: int, lists: list[set[int]] | None = None) -> Iterator[pa.RecordBatch]:
    """The best k of each batch for each query: a map side that sends no more than can matter."""
    for b in batches:
        if not b.num_rows:
            continue
        at, sim = b.column("id").to_numpy(), unit(matrix(b.column("vector"), q.shape[1])) @ q.T
        if lists is not None:
            cell = b.column("list").to_numpy()
            for j, probed in enumerate(lists):
                sim[~np.isin(cell, list(probed)), j] = 0
        out = []
        for j, query in enumerate(ids.tolist()):
            order = np.lexsort((at, -np.round(sim[:, j], 9)))[:k]
            order = order[sim[order, j] > 0]
            out.append((np.full(len(order), query), at[order], sim[order, j]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "id", "similarity"])


def exact(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int, most: int | None = None) -> DataFrame:
    """query_id, id, similarity, rank over vectors (id, vector) for a batch of query vectors, which each task gets."""
    if most is not None and vectors.limit(most + 1).count() > most:
        raise DenseScanTooLarge(f"more than {most} vectors")
    ids, q = np.array([i for i, _ in queries], np.int64), unit(np.array([v for _, v in queries], np.float64))
    right = vectors.where(F.size("vector") == q.shape[1]).select(F.col("id").cast("long").alias("id"), "vector")
    return _ranked(right.mapInArrow(lambda b: _score(b, ids, q, k), "query_id long, id long, similarity double"), k)


@dataclass
class Index:
    """Centroids on the driver, lists as a table (id, vector, list)."""

    centroids: np.ndarray
    lists: DataFrame
    fingerprint: tuple

    def search(self, queries: list[tuple[int, list[float]]], k: int, probes: int) -> DataFrame:
        ids, q = np.array([i for i, _ in queries], np.int64), unit(np.array([v for _, v in queries], np.float64))
        probed = [set(r.tolist()) for r in np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, :probes]]
        wanted = sorted(set().union(*probed))
        rows = self.lists.where(F.col("list").isin(wanted))  # prunes lists that no query probes
        return _ranked(rows.mapInArrow(lambda b: _score(b, ids, q, k, probed), "query_id long, id long, similarity double"), k)

    def stats(self) -> DataFrame:
        """Vectors of each list."""
        return self.lists.groupBy("list").agg(F.count("*").alias("vectors"))


def fingerprint(vectors: DataFrame, model: str = "") -> tuple:
    n, top = vectors.agg(F.count("*"), F.max("id")).first()
    return model, n, top


def build(vectors: DataFrame, lists: int = 64, steps: int = 3, model: str = "") -> Index:
    """An index of vectors (id, vector); centroid sums of a step are aggregated by task, so a step ships lists * dim numbers a task."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), "vector")
    first = rows.orderBy(F.xxhash64("id"), "id").limit(lists).toArrow()  # ``lists`` vectors
    dim = len(first.column("vector")[0])
    centroids = unit(matrix(first.column("vector"), dim))

    def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (unit(x) @ c.T).argmax(1)

    for _ in range(steps):
        c = centroids

        def sums(batches: Iterator[pa.RecordBatch], c: np.ndarray = c) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(c), dim))
            for b in batches:
                if b.num_rows:
                    x = unit(matrix(b.column("vector"), dim))
                    np.add.at(total, (x @ c.T).argmax(1), x)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["list", "total"])

        parts = rows.mapInArrow(sums, "list int, total array<double>").select("list", F.posexplode("total").alias("d", "v")).groupBy("list", "d").agg(F.sum("v").alias("v")).toPandas()
        total = np.zeros_like(c)
        total[parts["list"], parts["d"]] = parts["v"]
        moved = unit(total)
        centroids = np.where((moved**2).sum(1, keepdims=True) > 0, moved, c)
    c = centroids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vector"), pa.array(assign(matrix(b.column("vector"), dim), c).astype(np.int32))], ["id", "vector", "list"])

    kind = dict(rows.dtypes)["vector"]
    return Index(c, rows.mapInArrow(place, f"id long, vector {kind}, list int"), fingerprint(rows, model))


def use_index(cfg: Config, count: int, filtered: bool) -> bool:
    """brute never; hnsw (here: the inverted file) always; auto from ann_min_chunks on or beyond the scan's limit; never with filters."""
    if filtered or cfg.ann_mode == "brute":
        return False
    return cfg.ann_mode != "auto" or count >= cfg.ann_min_chunks or count > cfg.max_dense_scan
