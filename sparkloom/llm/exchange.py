"""Questions from numbered files to shards, and answers back.

A table is staged once as files in the folder that all executors share. A task
reads one file chunk by chunk, turns what it must know about each chunk into one
blob a shard, and each shard's task sees all blobs of its shard at a time. An
answer goes back to where its blob came from, in the blob's order, so neither
positions nor texts travel.

Blobs travel in packets: all that a file has for one destination is one row
(a few, where it has more than PACKET_BYTES). Up
to FAN shards, the destinations are the shards. Beyond, packets take two hops:
first to a group of FAN shards for a slice of FAN files, where they are sorted
out and joined, then to the shard, and back the same way. A round has
files * shards / FAN rows then, not files * shards.

Everything is a Spark shuffle or a committed table: a lost executor's tasks are
run again and read the same files.
"""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks

#: The most rows of a chunk, bytes of text in one (of more than one row), and rows of a staged file.
CHUNK_ROWS, CHUNK_BYTES, FILE_ROWS = 1000, 8 << 20, 20_000
SIZE = "__sparkloom_bytes"
#: Bytes of text for each shard.
SHARD_BYTES = 16 << 20
#: Shards that a packet's first hop can tell apart; tasks of a stage at most; bytes of packets that a task holds back.
FAN, TASKS, HELD_BACK = 256, 20_000, 24 << 20
#: Bytes from which a packet is sent: what a row may take in each of the JVM's and Python's copies.
PACKET_BYTES = 6 << 20
PACKETS = "at long, blob binary"
ANSWERS = "tag string, file int, asks long, blob binary"
#: In place of a shard: what comes back as it is, and a sign that a chunk isn't done.
KEEP, OPEN = -1, -2
Item = tuple[int, int, int, bytes]


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below the one in spark.checkpoint.dir; where that is unset, and only on one machine, below one of its own."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or getattr(spark, "_own_folder", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark._own_folder = "file://" + tempfile.mkdtemp(prefix="shared-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def tidy_shuffles(spark: SparkSession):
    """Shuffle files of the jobs inside go when each of them ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def pack(items: list[Item]) -> bytes:
    """Items (file, chunk, shard, bytes) as one value."""
    head = np.array([(f, c, s, len(b)) for f, c, s, b in items], np.int64).reshape(-1, 4)
    return b"".join([np.int64(len(items)).tobytes(), head.tobytes(), *(x[3] for x in items)])


def unpack(packet: bytes) -> Iterator[Item]:
    n = int(np.frombuffer(packet, np.int64, 1)[0])
    head = np.frombuffer(packet, np.int64, 4 * n, 8).reshape(n, 4).tolist()
    at = 8 + 32 * n
    for f, c, s, size in head:
        yield f, c, s, packet[at : at + size]
        at += size


class Answers(dict):
    """By (tag, chunk): the answer of each shard that gave one."""

    def add(self, tag: str, chunk: int, shard: int, blob: bytes) -> None:
        self.setdefault((tag, chunk), {})[shard] = blob

    def of(self, tag: str, chunk: int) -> dict[int, bytes]:
        return self.get((tag, chunk), {})


class Staged:
    """Numbered Parquet files of a table in the shared folder, and how many shards its questions have."""

    def __init__(self, docs: DataFrame, folder: str):
        """Of texts: with their bytes, cut into chunks by ``chunks``."""
        sized = docs.withColumn(SIZE, F.coalesce(F.octet_length("text"), F.lit(0)))
        self._write(sized, folder, "texts", FILE_ROWS)
        size = self.table.agg(F.coalesce(F.sum(SIZE), F.lit(0))).first()[0]
        self.shards = max(8, -(-size // SHARD_BYTES))

    @classmethod
    def of(cls, rows: DataFrame, folder: str, name: str, rows_a_file: int, shards: int = 8) -> Staged:
        """Of any table: each row is a chunk."""
        self = cls.__new__(cls)
        self._write(rows, folder, name, rows_a_file)
        self.shards = shards
        return self

    def _write(self, rows: DataFrame, folder: str, name: str, rows_a_file: int) -> None:
        self.spark, self.folder, self.fan = rows.sparkSession, folder, FAN
        blocks.small_batches(self.spark)
        at = f"{folder}/{name}"
        rows.write.option("maxRecordsPerFile", rows_a_file).option("compression", "zstd").parquet(at)
        p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        listed = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p)
        self.paths = sorted(x.getPath().toString() for x in listed if x.getPath().getName().endswith(".parquet"))
        self.table = self.spark.read.schema(rows.schema).parquet(at)

    def tasks(self, answers: list[DataFrame]) -> DataFrame:
        """A partition for each file, with the answers that it got."""
        n = max(len(self.paths), 1)
        rows = self.spark.range(0, len(self.paths), 1, n).select(F.lit("").alias("tag"), F.col("id").cast("int").alias("file"), F.lit(0).cast("long").alias("asks"), F.lit(None).cast("binary").alias("blob"))
        if not answers:
            return rows
        for a in answers:
            rows = rows.unionByName(a)
        return rows.repartitionById(n, F.col("file"))

    def run(self, answers: list[DataFrame], work: Callable[[int, str, Answers], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
        """work(number, path, answers) of every file."""
        paths = self.paths

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got: dict[int, Answers] = defaultdict(Answers)
            for b in batches:
                for tag, file, packet in zip(*(b.column(k) for k in (0, 1, 3))):
                    mine = got[file.as_py()]
                    if packet.is_valid:
                        for _, chunk, shard, blob in unpack(packet.as_py()):
                            mine.add(tag.as_py(), chunk, shard, blob)
            for file in sorted(got):
                yield from work(file, paths[file], got.pop(file))
            blocks.trim()

        return self.tasks(answers).mapInArrow(run, schema)

    def ask(self, tag: str, answers: list[DataFrame], emit: Callable[[str, Answers], Iterable[tuple[int, int, bytes]]], judge: Callable[[list[bytes], list[tuple[int, int]]], list[bytes | None]]) -> DataFrame:
        """The answers to what ``emit`` sends as (chunk, shard, blob), as a table in the shared folder.

        ``judge`` gets all blobs of a shard and the (file, chunk) of each, in their order, and returns an answer, or None, for each.
        Blobs for the shards KEEP and OPEN come back as they are. The column ``asks`` counts the answers of a row but for KEEP's.
        """
        shards, fan = self.shards, self.fan
        slices = -(-max(len(self.paths), 1) // fan)
        two = shards > fan
        cell = (lambda f, s: (s // fan) * slices + f // fan) if two else (lambda f, s: s)

        def send(file: int, path: str, own: Answers) -> Iterator[pa.RecordBatch]:
            items = ((-1 - file if s < 0 else cell(file, s), (file, c, s, b)) for c, s, b in emit(path, own))
            return _packets(items)

        def sort_out(to: Callable[[Item], int]):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                return _packets((to(x), x) for b in batches for p in b.column(1) for x in unpack(p.as_py()))

            return run

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _packets((cell(r[0], r[2]) if two and r[2] >= 0 else r[0], r) for at, items in _grouped(batches) for r in reply(at, items))

        def reply(at: int, items: list[Item]) -> Iterator[Item]:
            items.sort(key=lambda r: r[:2])
            replies = [r[3] for r in items] if at < 0 else judge([r[3] for r in items], [r[:2] for r in items])
            return ((f, c, s, a) for (f, c, s, _), a in zip(items, replies) if a is not None)

        def deliver(packets_of: Callable):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in packets_of(batches):
                    yield tagged(b)
                blocks.trim()

            return run

        def tagged(b: pa.RecordBatch) -> pa.RecordBatch:
            packets = [list(unpack(p)) for p in b.column(1).to_pylist()]
            asks = [sum(x[2] != KEEP for x in p) for p in packets]
            n = len(packets)
            return pa.RecordBatch.from_arrays([pa.array([tag] * n), pa.array([p[0][0] for p in packets], pa.int32()), pa.array(asks, pa.int64()), b.column(1)], ["tag", "file", "asks", "blob"])

        sent = self.run(answers, send, PACKETS)
        if two:
            sent = _spread(sent, min(len(self.paths), TASKS)).mapInArrow(sort_out(lambda x: -1 - x[0] if x[2] < 0 else x[2]), PACKETS)
        # one Python worker a task: what follows in the same stage is one function
        back, last = _spread(sent, min(shards, TASKS)).sortWithinPartitions("at"), answer
        if two:
            back, last = _spread(back.mapInArrow(answer, PACKETS), min(len(self.paths), TASKS)), sort_out(lambda x: x[0])
        out = f"{self.folder}/{tag}"
        back.mapInArrow(deliver(last), ANSWERS).write.option("compression", "zstd").parquet(out)
        return self.spark.read.schema(ANSWERS).parquet(out)


def asked(table: DataFrame) -> bool:
    """Whether a table of answers holds any but KEEP's."""
    return not table.where("asks > 0").isEmpty()


def _spread(packets: DataFrame, tasks: int) -> DataFrame:
    n = max(tasks, 1)
    return packets.repartitionById(n, F.pmod(F.when(F.col("at") < 0, -F.col("at")).otherwise(F.col("at")), F.lit(n)).cast("int"))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[Item]]]:
    """Destinations and all their items, of packets sorted by destination."""
    last, items = None, []
    for b in batches:
        for at, packet in zip(b.column(0).to_pylist(), b.column(1)):
            if at != last and items:
                yield last, items
                items = []
            last = at
            items.extend(unpack(packet.as_py()))
    if items:
        yield last, items


def _packets(items: Iterable[tuple[int, Item]]) -> Iterator[pa.RecordBatch]:
    """(destination, item) as packets, one for each destination of those that are held back together."""
    held: dict[int, list[Item]] = defaultdict(list)
    sizes: dict[int, int] = defaultdict(int)
    size = 0

    def row(at: int) -> pa.RecordBatch:
        del sizes[at]
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([pack(held.pop(at))], pa.binary())], ["at", "blob"])

    for at, item in items:
        held[at].append(item)
        sizes[at] += len(item[3]) + 64
        size += len(item[3]) + 64
        if sizes[at] >= PACKET_BYTES:
            size -= sizes[at]
            yield row(at)
        if size >= HELD_BACK:
            for k in sorted(held):
                yield row(k)
            size = 0
    for k in sorted(held):
        yield row(k)


def chunks(path: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The chunks of a staged file of texts, always the same ones, with the columns asked for."""
    for batch in _batches(path, CHUNK_ROWS, [*columns, SIZE]):
        end = np.cumsum(batch.column(SIZE).to_numpy())
        wanted = batch.select(columns)
        row, done = 0, 0
        while row < len(end):
            to = max(row + 1, int(np.searchsorted(end, done + CHUNK_BYTES, side="right")))
            yield wanted.slice(row, to - row)
            row, done = to, int(end[to - 1])


def rows(path: str, columns: list[str] | None = None) -> Iterator[dict]:
    """The rows of a staged file, one at a time."""
    for batch in _batches(path, 1, columns):
        yield {name: batch.column(k)[0] for k, name in enumerate(batch.schema.names)}


def _batches(path: str, size: int, columns: list[str] | None) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_file(at) as f:
        yield from pq.ParquetFile(f).iter_batches(size, columns=columns)
