"""Embeddings: feature hashing, and latent semantic analysis trained on the chunks.

The hashing embedder needs no training: unigrams by 1 + ln(count), their
character trigrams at 0.3 of that, neighbours at 0.5, into signed buckets by
seeded FNV-1a. LSA keeps a vocabulary of bounded size, so its matrices are
vocabulary x dimension on the driver, while all passes over chunks are tasks
that send one such matrix each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import columns as X
from ..sources.extract import sha, slices
from ..text import tokenize

_SEED, _MASK = 0x9E3779B97F4A7C15, 2**64 - 1
#: Bytes of text that a task embeds together.
PART_BYTES = 1 << 19


def bucket(token: str, salt: int, dim: int, seed: int = _SEED) -> tuple[int, float]:
    h = 14695981039346656037 ^ seed ^ (salt * 0x517CC1B727220A95 & _MASK)
    for b in token.encode():
        h = (h ^ b) * 1099511628211 & _MASK
    return h % dim, -1.0 if h >> 63 else 1.0


class HashingEmbedder:
    """Deterministic lexical vectors; at least 64 dimensions."""

    name = "hashing"

    def __init__(self, dim: int = 256):
        self.dim = max(64, dim)
        self._seen: dict[tuple[str, int], tuple[int, float]] = {}

    def _at(self, token: str, salt: int) -> tuple[int, float]:
        key = token, salt
        if key not in self._seen:
            if len(self._seen) > 200_000:
                self._seen.clear()
            self._seen[key] = bucket(token, salt, self.dim)
        return self._seen[key]

    def embed(self, text: str) -> np.ndarray:
        words = tokenize(text)
        v = np.zeros(self.dim)
        for w, c in Counter(words).items():
            weight = 1 + math.log(c)
            i, s = self._at(w, 1)
            v[i] += s * weight
            for k in range(len(w) - 2):
                i, s = self._at(w[k : k + 3], 3)
                v[i] += s * 0.3 * weight
        for a, b in zip(words, words[1:]):
            i, s = self._at(f"{a} {b}", 2)
            v[i] += s * 0.5
        n = math.sqrt(v @ v)
        return v / n if n > 1e-7 else v


    def embed_all(self, texts: list[str]) -> np.ndarray:
        """The vectors of many texts, a row each; hashes of all distinct tokens and neighbours are made together."""
        words = [tokenize(t) for t in texts]
        n = len(texts)
        size = np.array([len(w) for w in words], np.int64)
        numbers: dict[str, int] = {}
        code = np.array([numbers.setdefault(x, len(numbers)) for w in words for x in w], np.int64)
        if not len(code):
            return np.zeros((n, self.dim))
        row = np.repeat(np.arange(n), size)
        distinct = list(numbers)
        raw = [x.encode() for x in distinct]
        key, count = np.unique(row * len(distinct) + code, return_counts=True)
        r, c = key // len(distinct), key % len(distinct)
        weight = 1 + np.log(count)
        at, sign = self._places(_hashed(raw, 1))
        cells, values = [r * self.dim + at[c]], [sign[c] * weight]
        # character trigrams of each distinct token
        pieces: dict[str, int] = {}
        inner = [[pieces.setdefault(x[k : k + 3], len(pieces)) for k in range(len(x) - 2)] for x in distinct]
        if pieces:
            length = np.array([len(x) for x in inner], np.int64)
            flat, begin = np.array([k for x in inner for k in x], np.int64), np.cumsum(length) - length
            at, sign = self._places(_hashed([x.encode() for x in pieces], 3))
            many = length[c]
            which = np.repeat(begin[c] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            cells.append(np.repeat(r, many) * self.dim + at[flat[which]])
            values.append(sign[flat[which]] * 0.3 * np.repeat(weight, many))
        # neighbours: the hash of "a b" goes on from that of "a "
        next_to = np.flatnonzero(row[1:] == row[:-1])
        if len(next_to):
            pair, which = np.unique(code[next_to] * len(distinct) + code[next_to + 1], return_inverse=True)
            head = _hashed([x + b" " for x in raw], 2)
            at, sign = self._places(_hashed(raw, 2, head[pair // len(distinct)], pair % len(distinct)))
            cells.append(row[next_to] * self.dim + at[which])
            values.append(sign[which] * 0.5)
        v = np.bincount(np.concatenate(cells), np.concatenate(values), n * self.dim).reshape(n, self.dim)
        norm = np.sqrt((v * v).sum(1))
        return np.where(norm[:, None] > 1e-7, v / np.maximum(norm, 1e-30)[:, None], v)

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h % np.uint64(self.dim)).astype(np.int64), np.where(h >> np.uint64(63), -1.0, 1.0)


def _hashed(strings: list[bytes], salt: int, start: np.ndarray | None = None, which: np.ndarray | None = None) -> np.ndarray:
    """FNV-1a of many strings (of those that ``which`` picks), one byte of all at a time; ``start`` has hashes to go on from."""
    raw = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint64)
    size = np.array([len(x) for x in strings], np.int64)
    begin = np.cumsum(size) - size
    if which is not None:
        begin, size = begin[which], size[which]
    h = np.full(len(size), 14695981039346656037 ^ _SEED ^ (salt * 0x517CC1B727220A95 & _MASK), np.uint64) if start is None else start.copy()
    order = np.argsort(-size, kind="stable")
    begin, out = begin[order], h[order]
    live = np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), side="right")
    for k, a in enumerate(live):
        out[:a] = (out[:a] ^ raw[begin[:a] + k]) * np.uint64(1099511628211)
    h[order] = out
    return h


@dataclass
class LsaModel:
    terms: list[str]
    vectors: np.ndarray  # terms x dim

    def __post_init__(self) -> None:
        self.at = {t: i for i, t in enumerate(self.terms)}

    @property
    def dim(self) -> int:
        return self.vectors.shape[1]

    @property
    def name(self) -> str:
        return f"lsa-{self.dim}-{sha(chr(1).join(sorted(self.terms)).encode())[:12]}"

    def embed(self, text: str) -> np.ndarray:
        """The sum of (1 + ln count) * term vector over known terms, of length 1; zero if no term is known."""
        counts = Counter(t for t in tokenize(text) if t in self.at)
        if not counts:
            return np.zeros(self.dim)
        v = np.array([1 + math.log(c) for c in counts.values()]) @ self.vectors[[self.at[t] for t in counts]]
        n = math.sqrt(v @ v)
        return v / n if n > 0 else v


def vocabulary(chunks: DataFrame, cfg: Config) -> list[tuple[str, int]]:
    """(term, chunks that have it) of the cfg.lsa_max_vocab most widespread terms, at least cfg.lsa_min_df."""
    df = chunks.select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    top = df.where(F.col("df") >= cfg.lsa_min_df).orderBy(F.desc("df"), "term").limit(cfg.lsa_max_vocab)
    return [(r[0], r[1]) for r in top.collect()]


def _gaussian_rows(ids: np.ndarray, width: int) -> np.ndarray:
    """A row of standard normals for each id, the same wherever it is made."""
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, 2 * width + 1, dtype=np.uint64)[None, :] * np.uint64(0xBF58476D1CE4E5B9))
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    u = ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    return np.sqrt(-2 * np.log(u[:, :width])) * np.cos(2 * np.pi * u[:, width:])


def train(chunks: DataFrame, cfg: Config = Config(), power: int = 4) -> LsaModel | None:
    """A model by randomized range finding: Y = A O, then ``power`` times Y = A (A' Y); None for fewer than 4 chunks or 8 terms.

    A is terms x chunks with ln(1 + tf) * ln(1 + N / df). Texts are read once, into counts of known terms that are kept
    until the model is made; each pass is a map over them with Y broadcast (at most lsa_max_vocab x (lsa_dim + 8)) that
    returns one matrix a task.
    """
    n = chunks.count()
    vocab = vocabulary(chunks, cfg)
    if n < 4 or len(vocab) < 8:
        return None
    terms = [t for t, _ in vocab]
    at = {t: i for i, t in enumerate(terms)}
    idf = np.log(1 + n / np.array([d for _, d in vocab], float))
    dim = min(cfg.lsa_dim, len(vocab), n)
    width = min(dim + 8, n)
    spark = chunks.sparkSession
    shared = spark.sparkContext.broadcast((at, idf))
    code = np.dtype("<u2" if len(terms) <= 1 << 16 else "<u4")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value[0]
        for b in slices(batches, "text", PART_BYTES):
            rows = []
            for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                counts = Counter(t for t in tokenize(text or "") if t in at)
                if counts:
                    rows.append((i, np.fromiter((at[t] for t in counts), code, len(counts)).tobytes(), np.fromiter(counts.values(), "<u4", len(counts)).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (b.column("id").type, pa.binary(), pa.binary()))], ["id", "terms", "counts"])

    counted = chunks.select("id", "text").mapInArrow(count, f"id {dict(chunks.dtypes)['id']}, terms binary, counts binary").persist(StorageLevel.MEMORY_AND_DISK)
    few = counted.coalesce(max(1, spark.sparkContext.defaultParallelism))  # each task sends a matrix: as many as cores, however many files

    def a_pass(y: np.ndarray | None) -> np.ndarray:
        held = spark.sparkContext.broadcast(y)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf = shared.value[1]
            total = np.zeros((len(idf), width))
            for b in batches:
                for i, terms, counts in zip(*(b.column(c).to_pylist() for c in ("id", "terms", "counts"))):
                    k = np.frombuffer(terms, code).astype(np.int64)
                    a = np.log1p(np.frombuffer(counts, "<u4").astype(float)) * idf[k]
                    row = _gaussian_rows(np.array([i]), width)[0] if held.value is None else a @ held.value[k]
                    total[k] += np.outer(a, row)
            used = np.flatnonzero(np.abs(total).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(list(total[used]), pa.list_(pa.float64()))], ["term", "row"])

        parts = few.mapInArrow(run, "term int, row array<double>").select("term", F.posexplode("row").alias("d", "v")).groupBy("term", "d").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros((len(terms), width))
        out[parts.column("term").to_numpy(), parts.column("d").to_numpy()] = parts.column("v").to_numpy()
        held.unpersist()
        return out

    y = a_pass(None)
    for _ in range(power):
        y = a_pass(y / max(np.abs(y).max(), 1e-300))
    counted.unpersist()
    best = np.argsort(-(y**2).sum(0), kind="stable")[:dim]
    q: list[np.ndarray] = []
    for c in best:  # modified Gram-Schmidt
        v = y[:, c].copy()
        for w in q:
            v -= (w @ v) * w
        size = math.sqrt(v @ v)
        if size > 1e-10 * math.sqrt(y[:, c] @ y[:, c] + 1e-300):
            v /= size
            q.append(v * np.sign(v[np.abs(v).argmax()]))
    return LsaModel(terms, np.array(q).T)


def embedded(chunks: DataFrame, model: HashingEmbedder | LsaModel) -> DataFrame:
    """id, vector (array<float>) and embedding_model of every chunk."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)
    name = model.name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", PART_BYTES):
            texts = [t or "" for t in b.column("text").to_pylist()]
            v = shared.value.embed_all(texts) if isinstance(shared.value, HashingEmbedder) else np.array([shared.value.embed(t) for t in texts])
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), vectors, pa.array([name] * len(texts))], ["id", "vector", "embedding_model"])

    return chunks.select("id", "text").mapInArrow(run, "id long, vector array<float>, embedding_model string")


def stale(chunks: DataFrame, target: str) -> DataFrame:
    """Chunks whose vectors come from another model, or none."""
    return chunks.where(~F.col("embedding_model").eqNullSafe(F.lit(target)))
