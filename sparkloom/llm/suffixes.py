"""Suffix-array dedup: bytes that lie in a WINDOW-byte string that also starts earlier are removed.

Difference-cover blockwise construction. The suffixes at the positions of a
difference cover modulo PERIOD (8 in 57) are the sample: for any two positions
i, j some d < PERIOD puts i + d and j + d both into it, so two equal windows
hold two sample suffixes with equal first SAMPLE bytes at the same offset. First
the sample is sorted, bucket by bucket, by names of these prefixes; suffixes
that no repeated sample prefix touches differ from all others before WINDOW
bytes and need no sorting. Then the suffixes that the cover leaves tied are
sorted, one range of buckets at a time (a pass), each bucket in one task, by the
name of their first WINDOW bytes and then by place; all but the first of a run
of equal suffixes start earlier elsewhere. Buckets are ranges of names, not of
leading bytes: equal suffixes still meet, no bucket is hot because of a common
beginning, and dedup asks only for equality, never for the order of different
suffixes. The first pass leaves a note of the tied runs of each chunk, so the
others read and name only those. Names of sample prefixes may clash (that only
adds work); names of windows have 96 bits beside the bucket's.

A text that equals an earlier one is found by its digest and leaves whole, so
groups of copies don't fill buckets. Documents are ordered by doc_id, null ids
last; rows that share an id by their place in the staged files. Null and empty
texts keep nothing and lose nothing. Texts shorter than WINDOW stay; long ones
are treated whole, in a chunk of their own. More columns are ignored by
``digests`` and kept by ``deduplicated``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .exchange import KEEP, Answers, Staged, chunks, drop_folder, shared_folder, tidy_shuffles

WINDOW, PERIOD = 100, 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
SAMPLE = WINDOW - PERIOD + 1
#: Ranges of buckets that are sorted one after another.
PASSES = 4
#: Bytes of text that are named at a time, or one longer text.
PIECE = 256 << 10
DIGEST, ORDER, LAST = "__sparkloom_digest", "__sparkloom_order", "__sparkloom_last"
COLUMNS = [DIGEST, ORDER, LAST]


def _split(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts by shard, and where each shard begins."""
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _bits(answers: Answers, tag: str, chunk: int, order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What the shards said of each item, in the items' order."""
    out = np.zeros(len(order), bool)
    for s, a in answers.of(tag, chunk).items():
        if s == KEEP:
            continue
        n = at[s + 1] - at[s]
        out[order[at[s] : at[s + 1]]] = np.unpackbits(np.frombuffer(a, np.uint8), count=n).astype(bool)
    return out


def _order(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in the order of the ids, and which rows come after all others."""
    return batch.column(ORDER).to_numpy(), batch.column(LAST).to_numpy(zero_copy_only=False)


# --- whole copies


def _firsts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests (n x 2), ids, null ids, and which rows are the first of their digest in the chunk."""
    digest = np.frombuffer(b"".join(x or b"\0" * 16 for x in batch.column(DIGEST).to_pylist()), np.uint64).reshape(-1, 2)
    ids, null = _order(batch)
    order = np.lexsort((np.arange(len(ids)), ids, null, digest[:, 1], digest[:, 0]))
    first = np.ones(len(ids), bool)
    first[order[1:]] = (digest[order[1:]] != digest[order[:-1]]).any(1)
    return digest, ids, null, first


def _copies(batch: pa.RecordBatch, chunk: int, answers: Answers, shards: int) -> np.ndarray:
    """Rows whose text an earlier row has too."""
    digest, _, _, first = _firsts(batch)
    sent = np.flatnonzero(first)
    order, at = _split((digest[sent, 0] % blocks.U(shards)).astype(np.int64), shards)
    copy = ~first
    copy[sent] = _bits(answers, "copies", chunk, order, at)
    return copy


def _find_copies(staged: Staged) -> DataFrame:
    shards = staged.shards

    def emit(path: str, _: Answers) -> Iterator[tuple[int, int, bytes]]:
        for c, batch in enumerate(chunks(path, COLUMNS)):
            digest, ids, null, first = _firsts(batch)
            sent = np.flatnonzero(first)
            order, at = _split((digest[sent, 0] % blocks.U(shards)).astype(np.int64), shards)
            rows = np.column_stack([digest[:, 0], digest[:, 1], ids.view(np.uint64), null.astype(np.uint64)])[sent[order]]
            for s in np.flatnonzero(np.diff(at)):
                yield c, int(s), rows[at[s] : at[s + 1]].tobytes()

    def judge(blobs: list[bytes], _: list) -> list[bytes | None]:
        rows = np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, 4)
        order = np.lexsort((np.arange(len(rows)), rows[:, 2].view(np.int64), rows[:, 3], rows[:, 1], rows[:, 0]))
        copy = np.zeros(len(rows), bool)
        copy[order[1:]] = (rows[order[1:], :2] == rows[order[:-1], :2]).all(1)
        return _reply(copy, [len(b) // 32 for b in blobs])

    return staged.ask("copies", [], emit, judge)


def _reply(flags: np.ndarray, sizes: list[int]) -> list[bytes | None]:
    return [np.packbits(x).tobytes() if x.any() else None for x in np.split(flags, np.cumsum(sizes)[:-1])]


# --- the cover's sample


def _sample(off: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Positions of a block's sample suffixes, in order."""
    room = np.maximum(np.where(skip, 0, np.diff(off)) - SAMPLE + 1, 0)
    count = room // PERIOD * len(COVER) + np.searchsorted(COVER, room % PERIOD)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(off[:-1], count) + k // len(COVER) * PERIOD + np.array(COVER)[k % len(COVER)]


def _sample_names(batch: pa.RecordBatch, copy: np.ndarray) -> np.ndarray:
    names = [np.zeros(0, blocks.U)]
    for row, raw, off in blocks.texts(batch.column("text"), PIECE):
        at = _sample(off, copy[row : row + len(off) - 1])
        names.append(blocks.mix(blocks.spans(blocks.prefix(blocks.BYTE[raw]), at, at + SAMPLE)))
    return np.concatenate(names)


class _Sampled:
    """The distinct names of a chunk's sample: which name each suffix has, their order by shard, and which occur again in the chunk."""

    def __init__(self, batch: pa.RecordBatch, copy: np.ndarray, shards: int):
        name = _sample_names(batch, copy)
        at, self.which = blocks.distinct(name)
        self.name = name[at]
        self.again = np.bincount(self.which, minlength=len(at)) > 1
        self.order, self.at = _split(((self.name >> blocks.U(40)) % blocks.U(shards)).astype(np.int64), shards)


def _rank_sample(staged: Staged, copies: DataFrame) -> DataFrame:
    shards = staged.shards

    def emit(path: str, answers: Answers) -> Iterator[tuple[int, int, bytes]]:
        for c, batch in enumerate(chunks(path, ["doc_id", "text", *COLUMNS])):
            sample = _Sampled(batch, _copies(batch, c, answers, shards), shards)
            low, again = sample.name[sample.order].view(np.uint8).reshape(-1, 8)[:, :5], sample.again[sample.order]
            for s in np.flatnonzero(np.diff(sample.at)):
                k = slice(sample.at[s], sample.at[s + 1])
                yield c, int(s), np.int64(k.stop - k.start).tobytes() + low[k].tobytes() + np.packbits(again[k]).tobytes()

    def judge(blobs: list[bytes], _: list) -> list[bytes | None]:
        sizes = [int(np.frombuffer(b, np.int64, 1)[0]) for b in blobs]
        name = np.zeros((sum(sizes), 8), np.uint8)
        name[:, :5] = np.frombuffer(b"".join(b[8 : 8 + 5 * n] for b, n in zip(blobs, sizes)), np.uint8).reshape(-1, 5)
        name = name.view(np.uint64).ravel()
        again = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8, offset=8 + 5 * n), count=n) for b, n in zip(blobs, sizes)]).astype(bool)
        ranked = np.sort(name)
        tied = np.unique(np.concatenate([ranked[1:][ranked[1:] == ranked[:-1]], name[again]]))
        where = np.searchsorted(tied, name)
        flags = tied[np.minimum(where, len(tied) - 1)] == name if len(tied) else np.zeros(len(name), bool)
        return _reply(flags, sizes)

    return staged.ask("sample", [copies], emit, judge)


# --- suffixes that the cover leaves tied


def _runs(batch: pa.RecordBatch, chunk: int, copy: np.ndarray, answers: Answers, shards: int) -> np.ndarray:
    """Runs of a chunk's tied suffixes, in order: row, place of the first, place after the last."""
    out = [np.zeros((0, 3), np.int32)]
    if not answers.of("sample", chunk):
        return out[0]
    sample = _Sampled(batch, copy, shards)
    said = _bits(answers, "sample", chunk, sample.order, sample.at)[sample.which]
    done = 0
    for row, _, off in blocks.texts(batch.column("text"), PIECE):
        where = _sample(off, copy[row : row + len(off) - 1])
        tied = where[said[done : done + len(where)]]
        done += len(where)
        text = np.searchsorted(off, tied, side="right") - 1
        low, high = np.maximum(tied - PERIOD + 1, off[text]), np.minimum(tied + 1, off[text + 1] - WINDOW + 1)
        room = low < high
        low, high, text = low[room], high[room], text[room]
        if not len(low):
            continue
        new = np.append(True, (low[1:] > high[:-1]) | (text[1:] != text[:-1]))
        low, high, text = low[new], high[np.append(new[1:], True)], text[new]
        out.append(np.column_stack([row + text, low - off[text], high - off[text]]).astype(np.int32))
    return np.concatenate(out)


class _Tied:
    """The tied suffixes of a chunk, or those of one pass: row and place in it, the two names of each one's window, and its bucket.

    The first pass finds copies and runs, and keeps them in a note for those that follow.
    """

    def __init__(self, batch: pa.RecordBatch, chunk: int, answers: Answers, shards: int, only: int | None = None):
        self.note = answers.of("pass0", chunk).get(KEEP)
        if self.note is None:
            self.copy = _copies(batch, chunk, answers, shards)
            runs = _runs(batch, chunk, self.copy, answers, shards)
            self.note = np.packbits(self.copy).tobytes() + runs.tobytes()
        else:
            n = -(-batch.num_rows // 8)
            self.copy = np.unpackbits(np.frombuffer(self.note, np.uint8, n), count=batch.num_rows).astype(bool)
            runs = np.frombuffer(self.note, np.int32, offset=n).reshape(-1, 3)
        parts = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, blocks.U), np.zeros(0, np.uint32), np.zeros(0, np.uint32))]
        for row, raw, off in blocks.texts(batch.column("text"), PIECE):
            a, b = np.searchsorted(runs[:, 0], [row, row + len(off) - 1])
            if a < b:
                parts.append(_windows(raw, off, row, runs[a:b], shards, only))
        self.row, self.place, self.name, self.more, self.bucket = map(np.concatenate, zip(*parts))

        ids, null = _order(batch)
        rank = np.empty(batch.num_rows, np.int64)
        rank[np.lexsort((np.arange(batch.num_rows), ids, null))] = np.arange(batch.num_rows)
        self.rank = rank

    def of_pass(self, k: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a pass: the suffixes that an earlier place of the chunk has too; the others, their order by shard, and where each shard begins.

        Only the first of equal suffixes of a chunk travels, so neither repetitions nor hot passages fill a bucket.
        """
        mine = np.flatnonzero((self.bucket >= k * shards) & (self.bucket < (k + 1) * shards))
        rank = self.rank[self.row[mine]] if len(mine) else mine
        if (np.diff(rank) < 0).any():
            mine = mine[np.argsort(rank, kind="stable")]
        back = mine[::-1]
        at, which = blocks.distinct(self.name[back])
        if (self.more[back][at][which] != self.more[back]).any():  # different suffixes of one name
            _, number = np.unique(np.column_stack([self.name[back], self.more[back]]), axis=0, return_inverse=True)
            at, which = blocks.distinct(blocks.mix(number.ravel().astype(blocks.U)))
        first = np.zeros(len(mine), bool)
        first[at] = True
        again, mine = np.sort(back[~first]), np.sort(back[first])
        order, begin = _split((self.bucket[mine] - np.uint32(k * shards)).astype(np.int64), shards)
        return again, mine, order, begin


def _windows(raw: np.ndarray, off: np.ndarray, row: int, runs: np.ndarray, shards: int, only: int | None) -> tuple[np.ndarray, ...]:
    """Row, place, two names and bucket of the suffixes in a block's runs; only the runs' bytes are named."""
    count = (runs[:, 2] - runs[:, 1]).astype(np.int64)
    ends = np.cumsum(count + WINDOW - 1)
    begin = ends - count - WINDOW + 1
    bytes_ = raw[np.arange(ends[-1]) + np.repeat(off[runs[:, 0] - row] + runs[:, 1] - begin, count + WINDOW - 1)]
    start = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
    name = blocks.mix(blocks.spans(blocks.prefix(blocks.BYTE[bytes_]), start, start + WINDOW))
    bucket = ((name & blocks.U(0xFFFFFFFF)) * blocks.U(shards * PASSES) >> blocks.U(32)).astype(np.uint32)
    which = np.repeat(np.arange(len(runs)), count)
    if only is not None:
        mine = np.flatnonzero((bucket >= only * shards) & (bucket < (only + 1) * shards))
        start, name, bucket, which = start[mine], name[mine], bucket[mine], which[mine]
    more = (blocks.mix(blocks.spans(blocks.prefix(blocks.BYTE2[bytes_]), start, start + WINDOW)) >> blocks.U(32)).astype(np.uint32)
    return runs[which, 0], (start + (runs[:, 1] - begin)[which]).astype(np.int32), name, more, bucket


def _narrow(column: np.ndarray) -> np.ndarray:
    """Numbers from 0 in as few bytes as the largest needs; none at all where that is 0."""
    most = int(column.max(initial=0))
    return column.astype(np.min_scalar_type(most)) if most else np.zeros((len(column), 0), np.uint8)


def _sort_pass(staged: Staged, known: list[DataFrame], k: int) -> DataFrame:
    shards = staged.shards

    def emit(path: str, answers: Answers) -> Iterator[tuple[int, int, bytes]]:
        for c, batch in enumerate(chunks(path, ["doc_id", "text", *COLUMNS])):
            tied = _Tied(batch, c, answers, shards, k)
            if k == 0:
                yield c, KEEP, tied.note
            _, mine, order, at = tied.of_pass(k, shards)
            mine = mine[order]
            row, name, more = tied.row[mine], tied.name[mine], tied.more[mine]
            new = np.append(True, row[1:] != row[:-1])[: len(row)]
            shard = np.flatnonzero(np.diff(at))
            new[at[shard]] = True
            head = np.flatnonzero(new)
            ids, null = _order(batch)
            base = ids[~null].min() if not null.all() else np.int64(0)
            of = row[head]
            away = np.where(null, 0, ids.view(np.uint64) - base.view(np.uint64))
            columns = [_narrow(x) for x in (away[of], null[of], of, np.diff(np.append(head, len(mine))))]
            form = base.tobytes() + bytes(x.itemsize * (x.ndim == 1) for x in columns)
            from_ = np.searchsorted(head, at)
            for s in shard:
                a, b = from_[s], from_[s + 1]
                yield c, int(s), b"".join([form, np.int32(b - a).tobytes(), *(x[a:b].tobytes() for x in columns), name[at[s] : at[s + 1]].tobytes(), more[at[s] : at[s + 1]].tobytes()])

    def judge(blobs: list[bytes], places: list[tuple[int, int]]) -> list[bytes | None]:
        heads, names, more = [], [], []
        for i, b in enumerate(blobs):
            base, n = np.frombuffer(b, np.int64, 1)[0], int(np.frombuffer(b, np.int32, 1, 12)[0])
            head, done = np.zeros((5, n), np.int64), 16
            for column, width in zip(head, b[8:12]):
                if width:
                    column[:] = np.frombuffer(b, f"u{width}", n, done).astype(np.uint64).view(np.int64)
                    done += width * n
            head[0, head[1] == 0] += base
            head[4] = i
            size = int(head[3].sum())
            heads.append(head.T)
            names.append(np.frombuffer(b, np.uint64, size, done))
            more.append(np.frombuffer(b, np.uint32, size, done + 8 * size))
        head, name, more = np.concatenate(heads), np.concatenate(names), np.concatenate(more)
        # runs of one document each, put into the order of documents; blobs already are in that of files and chunks
        run = np.lexsort((head[:, 2], head[:, 4], head[:, 0], head[:, 1]))
        size = head[run, 3]
        begin = (np.cumsum(head[:, 3]) - head[:, 3])[run]
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(name))
        ordered = name[at]
        order = np.argsort(ordered, kind="stable")
        same = ordered[order[1:]] == ordered[order[:-1]]
        other = more[at]
        if (other[order[1:]] != other[order[:-1]])[same].any():
            order = np.lexsort((np.arange(len(at)), other, ordered))
            same = (ordered[order[1:]] == ordered[order[:-1]]) & (other[order[1:]] == other[order[:-1]])
        flags = np.zeros(len(at), bool)
        flags[at[order[1:]]] = same
        return _reply(flags, [len(x) for x in names])

    return staged.ask(f"pass{k}", known, emit, judge)


# --- the texts that are left


def _cut(batch: pa.RecordBatch, chunk: int, answers: Answers, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets, removed bytes) of a chunk's blocks."""
    tied = _Tied(batch, chunk, answers, shards)
    repeated = np.zeros(len(tied.row), bool)
    for k in range(PASSES):
        if len(tied.row):
            again, mine, order, at = tied.of_pass(k, shards)
            repeated[again] = True
            repeated[mine] = _bits(answers, f"pass{k}", chunk, order, at)
    row, place = tied.row[repeated], tied.place[repeated]
    for first, raw, off in blocks.texts(batch.column("text"), PIECE):
        n = np.diff(off)
        a, b = np.searchsorted(row, [first, first + len(n)])
        start = off[row[a:b] - first] + place[a:b]
        mark = np.zeros(len(raw) + WINDOW + 1, np.int32)
        mark[start] += 1
        mark[start + WINDOW] -= 1
        whole = tied.copy[first : first + len(n)] & (n >= WINDOW)
        yield first, raw, off, (np.cumsum(mark)[: len(raw)] > 0) | np.repeat(whole, n)


def _digests(batch: pa.RecordBatch, chunk: int, answers: Answers, shards: int) -> pa.RecordBatch:
    bytes_, removed, spans, sha = [], [], [], []
    for _, raw, off, gone in _cut(batch, chunk, answers, shards):
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        firsts = off[:-1][np.diff(off) > 0]
        begin[firsts] = gone[firsts]
        for mask, out in ((gone, removed), (begin, spans)):
            s = np.zeros(len(raw) + 1, np.int64)
            np.cumsum(mask, out=s[1:])
            out.append(np.diff(s[off]))
        bytes_.append(np.diff(off))
        for a, b in zip(off[:-1], off[1:]):
            sha.append(hashlib.sha256(raw[a:b][~gone[a:b]].tobytes()).hexdigest())
    columns = [pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in (bytes_, removed, spans)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, blocks.strings(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _solve(docs: DataFrame) -> tuple[Staged, list[DataFrame]]:
    spark = docs.sparkSession
    number = dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint")
    order, last = (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull()) if number else (F.lit(0).cast("long"), F.lit(False))
    rows = docs if number else docs.orderBy(F.col("doc_id").asc_nulls_last())  # then the order of the files is that of the ids
    staged = Staged(rows.withColumns({DIGEST: F.unhex(F.md5(F.col("text").cast("binary"))), ORDER: order, LAST: last}), shared_folder(spark))
    with tidy_shuffles(spark):
        copies = _find_copies(staged)
        known = [copies, _rank_sample(staged, copies)]
        passes = [_sort_pass(staged, known, 0)]
        passes += [_sort_pass(staged, passes[:1], k) for k in range(1, PASSES)]
    return staged, passes


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of every row."""
    spark = docs.sparkSession
    staged, answers = _solve(docs.select("doc_id", "text"))
    shards = staged.shards
    kind = dict(docs.dtypes)["doc_id"]

    def work(_: int, path: str, own: Answers) -> Iterator[pa.RecordBatch]:
        for c, batch in enumerate(chunks(path, ["doc_id", "text", *COLUMNS])):
            yield _digests(batch, c, own, shards)

    out = f"{staged.folder}-digests"
    with tidy_shuffles(spark):
        staged.run(answers, work, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").write.parquet(out)
    drop_folder(spark, staged.folder)
    return spark.read.parquet(out)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows, all their columns, with what is left of each text (n_chars, where there is one, follows it).

    A window may begin or end inside a character; what is left of such characters is dropped. Null texts stay null.
    """
    staged, answers = _solve(docs)
    shards = staged.shards
    names = docs.columns
    schema = docs.schema

    def work(_: int, path: str, own: Answers) -> Iterator[pa.RecordBatch]:
        for c, batch in enumerate(chunks(path, [*names, *COLUMNS])):
            text = []
            for _, raw, off, gone in _cut(batch, c, own, shards):
                text += [raw[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") for a, b in zip(off[:-1], off[1:])]
            kept = pa.array([t if ok else None for t, ok in zip(text, batch.column("text").is_valid().to_pylist())], pa.string())
            new = {"text": kept}
            if "n_chars" in names and pa.types.is_integer(batch.column("n_chars").type):
                new["n_chars"] = pa.array([None if t is None else len(t) for t in kept.to_pylist()], batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names)

    return staged.run(answers, work, schema)


ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, pos, substr(h, CAST(2 * pos + 1 AS BIGINT), 200) AS s FROM (SELECT doc_id, h, unnest(range(greatest(n - 99, 0))) AS pos FROM d)),
o AS (SELECT doc_id, pos, min(doc_id * 100000000 + pos) OVER (PARTITION BY s) AS first FROM w),
r AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 100 THEN 0 ELSE 1 END AS begins FROM o WHERE doc_id * 100000000 + pos > first),
g AS (SELECT doc_id, pos, sum(begins) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM r),
runs AS (SELECT doc_id, run, min(pos) AS a, max(pos) + 100 AS b FROM g GROUP BY doc_id, run),
c AS (SELECT doc_id, run, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS before FROM runs),
k AS (SELECT c.doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS stop, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY run) AS head FROM c JOIN d USING (doc_id) GROUP BY c.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(stop, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
