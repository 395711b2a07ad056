"""Near duplicates by ProbMinHash over weighted word shingles.

A text's shingles are its runs of SHINGLE words (all its words, if it has
fewer), lower case, weighted by how often they occur. Each shingle is a Poisson
process whose rate is its weight; an arrival carries a register, and a register
keeps the shingle of its earliest arrival, so that two texts agree in a register
with the probability Jaccard of their weights. Arrivals are generated only up to
a horizon that fills all registers: shingles that arrive later end at once.

Texts with the same weights are one node. Nodes that share a band of ROWS
registers are candidates; in each band every node is tried against the smallest
one, and after that only pairs of the band that are still in different
components, so no link between different texts is lost and no group is expanded
into its pairs. Candidates are verified by the exact probability Jaccard, which
must be SIMILARITY or more, and links make classes. A pair of that similarity
shares no band with a probability of 7e-6.

Texts without words (null ones, too) are classes of their own. Rows may repeat,
and count each; of equal ids the first row in the staged files stays. Texts of
any length are sketched whole. More columns are ignored by ``classes`` and kept
by ``representatives``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .components import components
from .exchange import ANSWERS, Answers, Staged, chunks, drop_folder, pack, shared_folder, tidy_shuffles

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 5
REGISTERS = BANDS * ROWS
#: Pairs of a band are tried in the second round if so many registers agree: five standard deviations below SIMILARITY.
AGREE = int(REGISTERS * (SIMILARITY - 5 * (SIMILARITY * (1 - SIMILARITY) / REGISTERS) ** 0.5))


def shingles(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, name) of each shingle, in order, with repetitions."""
    low = blocks.lower(raw)
    start, end, first = blocks.words(low, off)
    name = blocks.word_names(low, start, end)
    count = np.diff(first)
    size = np.minimum(count, SHINGLE)
    text = np.repeat(np.arange(len(count)), np.where(count, count - size + 1, 0))
    at = first[text] + np.arange(len(text)) - np.searchsorted(text, text)
    s = blocks.prefix(name)
    return text, blocks.mix(blocks.spans(s, at, at + size[text]) + size[text].astype(np.uint64))


def weighted(text: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, name) and the weight of each."""
    order = np.lexsort((name, text))
    text, name = text[order], name[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (name[1:] != name[:-1])
    at = np.flatnonzero(new)
    return text[at], name[at], np.diff(np.append(at, len(text)))


def _exponential(name: np.ndarray, turn: int) -> np.ndarray:
    u = blocks.mix(name + blocks.U((0x9E3779B97F4A7C15 * (2 * turn + 1)) & (2**64 - 1)))
    return -np.log(((u >> blocks.U(11)).astype(np.float64) + 0.5) * 2.0**-53)


def signatures(text: np.ndarray, name: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """The registers (texts x REGISTERS) of distinct weighted shingles."""
    m = REGISTERS
    total = np.bincount(text, weight, texts)
    horizon = np.zeros(texts)
    some = total > 0
    horizon[some] = m * (np.log(m) + 4) / total[some]
    best = np.full(texts * m, np.inf)
    out = np.zeros(texts * m, np.int32)
    when = _exponential(name, 0) / weight
    turn = np.zeros(len(name), np.int64)
    live = np.flatnonzero(some[text])
    step = 0
    while len(live):
        now = live[when[live] <= horizon[text[live]]]
        while len(now):  # one arrival of each shingle that comes before the horizon
            h = when[now]
            k = text[now] * m + (blocks.mix(name[now] ^ blocks.mix(turn[now].astype(np.uint64) + blocks.U(1))) % blocks.U(m)).astype(np.int64)
            earlier = np.flatnonzero(h < best[k])
            earlier = earlier[np.argsort(-h[earlier], kind="stable")]
            best[k[earlier]] = h[earlier]
            out[k[earlier]] = (name[now[earlier]] >> blocks.U(32)).astype(np.uint32).view(np.int32)
            turn[now] += 1
            u = blocks.mix(name[now] + blocks.U(0x9E3779B97F4A7C15) * (turn[now].astype(np.uint64) * blocks.U(2) + blocks.U(1)))
            when[now] = h - np.log(((u >> blocks.U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[now]
            now = now[when[now] <= horizon[text[now]]]
        open_ = some & np.isinf(best.reshape(texts, m)).any(1)
        horizon[open_] *= 2
        live = np.flatnonzero(open_[text])
        step += 1
    return out.reshape(texts, m)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The probability Jaccard of two sets of (sorted names, weights)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    only_x, only_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    below = np.concatenate([[0.0], np.cumsum(y)])[np.searchsorted(ratio, ratio, side="left")]
    above = x.sum() - np.concatenate([[0.0], np.cumsum(x)])[np.searchsorted(ratio, ratio, side="left")]
    return float((x / (above + only_x + ratio * (below + only_y))).sum())


def _sketch(staged: Staged) -> DataFrame:
    """file, chunk, row, doc_id, node of each row with words; registers for the first row of a node in its chunk."""

    def work(file: int, path: str, _: Answers) -> Iterator[pa.RecordBatch]:
        for c, batch in enumerate(chunks(path, ["doc_id", "text"])):
            rows, nodes, sigs, seen = [], [], [], set()
            for first, raw, off in blocks.texts(batch.column("text")):
                text, name, weight = weighted(*shingles(raw, off))
                n = len(off) - 1
                mixed = blocks.mix(name) * (weight.astype(np.uint64) * blocks.U(2) + blocks.U(1))
                at = np.searchsorted(text, np.arange(n + 1))
                sums = np.zeros(len(text) + 1, np.uint64)
                np.cumsum(mixed, out=sums[1:])
                node = blocks.mix(np.diff(sums[at]) + np.diff(at).astype(np.uint64)).view(np.int64)
                has = np.flatnonzero(np.diff(at))
                new = [i for i in has.tolist() if node[i] not in seen and not seen.add(node[i])]
                number = np.full(n, -1)
                number[new] = np.arange(len(new))
                pick = number[text] >= 0
                made = signatures(number[text[pick]], name[pick], weight[pick], len(new))
                rows += (first + has).tolist()
                nodes += node[has].tolist()
                sigs += [made[number[i]] if number[i] >= 0 else None for i in has.tolist()]
            ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            k = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([file] * k, pa.int32()), pa.array([c] * k, pa.int32()), pa.array(rows, pa.int32()), ids, pa.array(nodes, pa.int64()), pa.array(sigs, pa.list_(pa.int32()))], ["file", "chunk", "row", "doc_id", "node", "sig"])

    out = f"{staged.folder}/sketch"
    schema = f"file int, chunk int, row int, doc_id {dict(staged.table.dtypes)['doc_id']}, node long, sig array<int>"
    staged.run([], work, schema).write.parquet(out)
    return staged.spark.read.schema(schema).parquet(out)


def _rows_asked(tag: str, rows: DataFrame) -> DataFrame:
    """Rows (file, chunk, row, more columns of long) as answers to their files: one blob a chunk."""
    more = [c for c in rows.columns if c not in ("file", "chunk", "row")]

    def packed(t: pa.Table) -> pa.Table:
        columns = [t.column(c).cast(pa.int64()).to_numpy() for c in ("row", *more)]
        file, chunk = t.column("file")[0].as_py(), t.column("chunk")[0].as_py()
        return pa.table([[tag], pa.array([file], pa.int32()), pa.array([1], pa.int64()), [pack([(file, chunk, 0, np.column_stack(columns).tobytes())])]], names=["tag", "file", "asks", "blob"])

    return rows.groupBy("file", "chunk").applyInArrow(packed, ANSWERS)


def _texts(staged: Staged, wanted: DataFrame) -> DataFrame:
    """node and text of the rows (file, chunk, row, node) that are wanted."""

    def work(_: int, path: str, own: Answers) -> Iterator[pa.RecordBatch]:
        for c, batch in enumerate(chunks(path, ["text"])):
            blob = own.of("text", c).get(0)
            if blob is not None:
                rows = np.frombuffer(blob, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, 1]), batch.column("text").take(pa.array(rows[:, 0]))], ["node", "text"])

    return staged.run([_rows_asked("text", wanted)], work, "node long, text string")


def _verified(staged: Staged, reps: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) of nodes that are similar, as a table."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = _texts(staged, reps.join(ends, "node").select("file", "chunk", "row", "node"))
    path = f"{staged.folder}/texts-{name}"
    texts.write.option("compression", "zstd").parquet(path)
    texts = staged.spark.read.parquet(path)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
            out = []
            for _, raw, off in blocks.texts(column):
                text, what, weight = weighted(*shingles(raw, off))
                cut = np.searchsorted(text, np.arange(1, len(off) - 1))
                out += zip(np.split(what, cut), np.split(weight, cut))
            return out

        for b in batches:
            keep = [similarity(x, y) >= SIMILARITY - 1e-12 for x, y in zip(sets(b.column("ta")), sets(b.column("tb")))]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    out = f"{staged.folder}/links-{name}"
    joined.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long").write.parquet(out)
    return staged.spark.read.schema("a long, b long").parquet(out)


def _classes(staged: Staged) -> tuple[DataFrame, DataFrame]:
    """The rows with words (file, chunk, row, doc_id, node), and class_id, class_size and keeper's place of each node."""
    spark = staged.spark
    rows = _sketch(staged)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "chunk", "row")
    reps = rows.groupBy("node").agg(F.min(place).alias("rep"), F.count("*").alias("size")).select("node", "size", "rep", "rep.file", "rep.chunk", "rep.row")
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.slice("sig", b * ROWS + 1, F.lit(ROWS))))
    bands = rows.where("sig is not null").select("node", F.explode(band).alias("band")).distinct()
    lows = bands.groupBy("band").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    path = f"{staged.folder}/bands"
    bands.join(lows, "band").write.parquet(path)
    bands = spark.read.parquet(path)
    stars = bands.where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    links = _verified(staged, reps, stars, "stars")
    found = components(links)
    # bands of three or more with more than one component: the pairs between components that weren't tried
    open_ = bands.where("n > 2").join(found, "node", "left").select("band", "node", "b", F.coalesce("root", "node").alias("root"))
    mixed = open_.groupBy("band").agg((F.min("root") != F.max("root")).alias("mixed")).where("mixed").select("band")
    sig = rows.where("sig is not null").groupBy("node").agg(F.first("sig").alias("sig"))
    path = f"{staged.folder}/open"
    open_.join(mixed, "band").join(sig, "node").write.parquet(path)
    open_ = spark.read.parquet(path)
    x, y = open_.alias("x"), open_.alias("y")
    agree = F.aggregate(F.zip_with("x.sig", "y.sig", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    cross = x.join(y, F.expr("x.band = y.band and x.root < y.root and x.node <> y.b and y.node <> x.b")).where(agree >= AGREE)
    cross = cross.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()
    path = f"{staged.folder}/cross"
    cross.write.parquet(path)
    cross = spark.read.schema("a long, b long").parquet(path)
    if not cross.isEmpty():
        more = _verified(staged, reps, cross, "cross")
        if not more.isEmpty():
            found = components(links.unionByName(more))
    joined = reps.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = joined.groupBy("root").agg(F.min("rep").alias("keeper"), F.sum("size").alias("class_size"))
    nodes = joined.select("node", "root").join(whole, "root").select("node", F.col("keeper.doc_id").alias("class_id"), "class_size", "keeper")
    return rows.select("file", "chunk", "row", "doc_id", "node"), nodes


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class) and class_size of every row."""
    spark = docs.sparkSession
    staged = Staged(docs.select("doc_id", "text"), shared_folder(spark))
    out = f"{staged.folder}-classes"
    with tidy_shuffles(spark):
        rows, nodes = _classes(staged)
        named = rows.join(nodes, "node").select("file", "chunk", "row", "doc_id", "class_id", "class_size")

        def work(file: int, path: str, own: Answers) -> Iterator[pa.RecordBatch]:
            for c, batch in enumerate(chunks(path, ["doc_id", "text"])):
                alone = [row + i for row, raw, off in blocks.texts(batch.column("text")) for i in np.flatnonzero(np.diff(blocks.words(raw, off)[2]) == 0).tolist()]
                if alone:
                    ids = batch.column("doc_id").take(pa.array(alone))
                    yield pa.RecordBatch.from_arrays([ids, ids, pa.array([1] * len(alone), pa.int64())], ["doc_id", "class_id", "class_size"])

        kind = dict(docs.dtypes)["doc_id"]
        schema = f"doc_id {kind}, class_id {kind}, class_size long"
        named.select("doc_id", "class_id", "class_size").unionByName(staged.run([], work, schema)).write.parquet(out)
    drop_folder(spark, staged.folder)
    return spark.read.schema(schema).parquet(out)


def representatives(docs: DataFrame) -> DataFrame:
    """One row, all its columns, of each class: that of the smallest doc_id. Rows without words all stay."""
    spark, columns = docs.sparkSession, docs.columns
    staged = Staged(docs, shared_folder(spark))
    with tidy_shuffles(spark):
        rows, nodes = _classes(staged)
        here = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "chunk", "row")
        dropped = rows.join(nodes, "node").where(here != F.col("keeper")).select("file", "chunk", "row")
        path = f"{staged.folder}/dropped"
        _rows_asked("drop", dropped).write.parquet(path)
        answers = spark.read.schema(ANSWERS).parquet(path)

    def work(_: int, path: str, own: Answers) -> Iterator[pa.RecordBatch]:
        for c, batch in enumerate(chunks(path, columns)):
            blob = own.of("drop", c).get(0)
            if blob is not None:
                keep = np.ones(batch.num_rows, bool)
                keep[np.frombuffer(blob, np.int64)] = False
                batch = batch.filter(pa.array(keep))
            yield batch

    return staged.run([answers], work, docs.schema)


#: No two sets of weights have a probability Jaccard above the sum of the smaller of their shares, which picks the pairs that are worth the exact formula.
ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0b\x0c\r]+'), lambda v: v <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM t),
c AS (SELECT doc_id, g, count(*) AS x FROM s GROUP BY 1, 2),
m AS (SELECT doc_id, md5(string_agg(g || ':' || x, '|' ORDER BY g)) AS node FROM c GROUP BY 1),
n AS (SELECT node, min(doc_id) AS rep, count(*) AS size FROM m GROUP BY 1),
k AS (SELECT c.doc_id AS id, g, CAST(x AS DOUBLE) AS x, x / sum(x) OVER (PARTITION BY c.doc_id) AS share FROM c JOIN n ON c.doc_id = n.rep),
p AS (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2 HAVING sum(least(a.share, b.share)) >= 0.7999),
u AS (SELECT a, b, g, max(x) AS x, max(y) AS y FROM (SELECT a, b, g, x, 0 AS y FROM p JOIN k ON id = a UNION ALL SELECT a, b, g, 0, x FROM p JOIN k ON id = b) GROUP BY 1, 2, 3),
j AS (SELECT i.a, i.b, i.g, 1 / sum(greatest(o.x / i.x, o.y / i.y)) AS part FROM u i JOIN u o ON i.a = o.a AND i.b = o.b WHERE i.x > 0 AND i.y > 0 GROUP BY 1, 2, 3),
l AS (SELECT a, b FROM j GROUP BY 1, 2 HAVING sum(part) >= 0.8 - 1e-12),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep AS id, rep AS root FROM n UNION SELECT r.id, e.b FROM r JOIN e ON r.root = e.a),
f AS (SELECT id, min(root) AS class_id FROM r GROUP BY 1),
z AS (SELECT class_id, sum(size) AS class_size FROM f JOIN n ON n.rep = f.id GROUP BY 1)
SELECT m.doc_id, class_id, CAST(class_size AS BIGINT) AS class_size FROM m JOIN n USING (node) JOIN f ON f.id = n.rep JOIN z USING (class_id)
UNION ALL SELECT doc_id, doc_id, 1 FROM t WHERE w IS NULL OR len(w) = 0
"""
