"""Exact top-k search by inner product: a Voronoi kNN join.

Every vector belongs to the cell of its nearest pivot. The summary of a cell is
its size and the largest distance to its pivot; by Cauchy-Schwarz the product of
a query q with a vector of cell j lies within q.p_j -+ |q| r_j. The lower bounds
of enough cells give each query a score that its k-th answer can't be below, and
only cells whose upper bound reaches it are searched. Queries are grouped by
cell, GROUP to a group; cells are cut into chunks of CHUNK vectors, and a chunk
is replicated only to groups with a query that needs its cell. Each task solves
one group against one chunk with a matrix product and sends at most k rows a
query, which are merged.

There are PIVOTS pivots, or the square root of the number of vectors if that is
more.

Components are floor(1024 * x). Vectors that are null or hold a null or
non-finite component take no part, nor do rows without an id. Where lengths
differ, missing components count as 0, so an empty vector is the zero vector.
Rows that share the query's id are its own and no candidates; other repeated ids
are candidates each. Every query row has its own answer, also where ids repeat;
whether a row is a query must follow from its id. Ties go to the smaller id.
Products of 2**53 and more are computed in integers. An empty table, or one
without queries, gives an empty result; more columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PIVOTS, CHUNK, GROUP = 128, 20_000, 2_000


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (array<bigint>) of the rows that take part."""
    e = F.col("embedding")
    whole = e.isNotNull() & (F.size(e) >= 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.col("vec_id").isNotNull()
    return vectors.where(whole).select("vec_id", F.transform(e, lambda x: F.floor(F.lit(1024.0) * x.cast("double"))).alias("vec"))


def _matrix(column: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """Rows of a list column, filled up with 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (size == width).all():
        return flat.reshape(-1, width).astype(kind)
    out = np.zeros((len(size), width), kind)
    out[np.arange(width)[None, :] < size[:, None]] = flat
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of each query row."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    data = integers(vectors)
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    width, rows, top = data.agg(F.max(F.size("vec")), F.count("*"), F.max(square)).first()
    if width is None:
        return empty
    width, kind = max(width, 1), np.float64 if top < 2**53 else np.int64
    asks = data.where(is_query).groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]  # rows that share a query's id
    if not asks:
        return empty
    pivots = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(PIVOTS, math.isqrt(rows))).select("vec").toArrow()  # as many vectors at most
    centre = np.unique(_matrix(pivots.column(0), width), axis=0)
    norm = (centre**2).sum(1)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("vec"), width)
                d = norm[None, :] - 2 * (x @ centre.T)
                c = d.argmin(1)
                r = np.sqrt(((x - centre[c]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(pa.int64()), b.column("vec"), pa.array(c, pa.int32()), pa.array(r)], ["vec_id", "vec", "cell", "r"])

    placed = data.mapInArrow(cells, "vec_id long, vec array<bigint>, cell int, r double")
    asked = placed.where(is_query).groupBy("vec_id", "vec", "cell").agg(F.count("*").alias("times"))
    summary = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("r"), F.sum(is_query.cast("int")).alias("q")).toPandas()  # a row a cell
    if not len(summary) or not summary["q"].sum():
        return empty
    summary = summary.sort_values("cell")
    cell, count, radius = summary["cell"].to_numpy(), summary["n"].to_numpy(), summary["r"].to_numpy()
    chunks = -(-count // CHUNK)
    # groups of queries: neighbouring cells together up to GROUP, large cells cut
    group_of, cut, group, filled = {}, {}, 0, 0
    for c, q in zip(cell.tolist(), summary["q"].tolist()):
        if filled and filled + q > GROUP:
            group, filled = group + 1, 0
        group_of[c], cut[c] = group, max(1, -(-q // GROUP))
        group, filled = (group, filled + q) if cut[c] == 1 else (group + cut[c], 0)

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vec"), width)
            if not len(x):
                continue
            dot, size = x @ centre[cell].T, np.sqrt((x**2).sum(1))[:, None] * radius[None, :] * (1 + 1e-9) + 1e-6
            low, high = dot - size, dot + size
            order = np.argsort(-low, axis=1)
            enough = (np.cumsum(count[order], axis=1) >= k + asks).argmax(1)  # the query's own rows may be among them
            few = count.sum() < k + asks
            least = np.full(len(x), -np.inf) if few else np.take_along_axis(low, np.take_along_axis(order, enough[:, None], 1), 1)[:, 0]
            own = b.column("cell").to_numpy()
            ids = b.column("vec_id").to_numpy()
            g = np.array([group_of[c] + (int(i) // 1000003 + int(i)) % cut[c] for c, i in zip(own.tolist(), ids.tolist())], np.int32)
            q, j = np.nonzero(high >= least[:, None])
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(q)), b.column("vec").take(pa.array(q)), b.column("times").take(pa.array(q)), pa.array(g[q]), pa.array(cell[j].astype(np.int32))], ["vec_id", "vec", "times", "g", "cell"])

    wanted = asked.mapInArrow(needs, "vec_id long, vec array<bigint>, times long, g int, cell int")
    sizes = spark.createDataFrame(pd.DataFrame({"cell": cell.astype("int32"), "chunks": chunks.astype("int32")}))
    chunked = placed.join(F.broadcast(sizes), "cell").select("cell", F.expr("cast(pmod(xxhash64(vec_id, vec), chunks) as int)").alias("chunk"), "vec_id", "vec")
    spread = wanted.join(F.broadcast(sizes), "cell").select("g", "cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "vec_id", "vec", "times")
    pairs = spread.select("g", "cell", "chunk").distinct()
    replicated = chunked.join(pairs, ["cell", "chunk"]).select("g", "cell", "chunk", "vec_id", "vec", F.lit(0).cast("long").alias("times"), F.lit(0).cast("long").alias("key"))
    both = replicated.unionByName(spread.withColumn("key", F.xxhash64("vec")))

    def solve(t: pa.Table) -> pa.Table:
        times, keys = t.column("times").to_numpy(), t.column("key").to_numpy()
        asks = times > 0
        ids, x = t.column("vec_id").to_numpy(), _matrix(t.column("vec"), width, kind)
        order = np.argsort(ids[~asks], kind="stable")
        s_id, s = ids[~asks][order], x[~asks][order]
        q_id, q, q_key, q_times = ids[asks], x[asks], keys[asks], times[asks]
        least = -np.inf if kind is np.float64 else np.iinfo(np.int64).min
        out = []
        for a in range(0, len(q_id), 256):
            score = q[a : a + 256] @ s.T
            for i, row in enumerate(score):
                own = s_id == q_id[a + i]
                row[own] = least
                best = np.argpartition(-row, min(k, len(row)) - 1)[:k] if len(row) > k else np.arange(len(row))
                if len(row) > k:  # all that tie with the k-th, in the order of ids
                    best = np.flatnonzero(row >= row[best].min())
                best = best[np.lexsort((s_id[best], -row[best]))][:k]
                best = best[~own[best]]
                out.append((np.full(len(best), q_id[a + i]), np.full(len(best), q_key[a + i]), np.full(len(best), q_times[a + i]), s_id[best], row[best].astype(np.int64)))
        columns = [np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "key", "times", "vec_id", "score"])

    found = both.groupBy("g", "cell", "chunk").applyInArrow(solve, "query_id long, key long, times long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.withColumn("_", F.explode(F.sequence(F.lit(1), "times"))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vec FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.vec) = len(c.vec) AND len(q.vec) > 0 THEN CAST(list_inner_product(q.vec, c.vec) AS BIGINT) ELSE CAST(coalesce(list_sum(list_transform(list_zip(q.vec, c.vec), lambda z: coalesce(z[1] * z[2], 0))), 0) AS BIGINT) END AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
