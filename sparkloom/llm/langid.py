"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text gives
longest matches: a text is cut greedily into the longest phrases that occur in
the sample, and the language whose phrases are fewest, weighted by the bits that
point into its sample (log2 of its size), wins. The automata become flat
transition tables that end a phrase and begin the next one in one step, so many
texts advance together, one byte each at a step. Segments of SEGMENT bytes of a
text are parsed side by side, each as if a phrase began with it; then each is
parsed again from the state in which its predecessor ends, only until both
parses agree, so the phrases are those of the whole text.

A language's sample is of whole documents: of at most SAMPLE_DOCS, those that
together have at most SAMPLE_BYTES (if all are longer, the shortest one).
Languages are learned however many there are; SLICE_LANGS of them are broadcast
at a time, and more make more passes over the texts.

Null texts, and texts without a letter, get ``und`` and score 0. Rows keep their
multiplicity; null labels teach nothing; without any labelled row every text is
``und``. Ties go to the first language by name. Texts are parsed whole at any
length; an empty table gives an empty result; more columns are ignored, or kept
by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import blocks
from .exchange import shared_folder

#: The sample of a language: at most so many documents, and so many bytes of them.
SAMPLE_DOCS, SAMPLE_BYTES = 60, 48_000
#: Languages whose automata (at most 2 * SAMPLE_BYTES states each, some 20 MB) are in memory together.
SLICE_LANGS = 16
SEGMENT = 1024
#: Rounds of corrections that all segments make together; what is still open then is parsed text by text.
ROUNDS = 3
#: The least mean length of the best language's phrases, in bytes, of a text that counts as language: noise has shorter ones.
ACCEPT = 2.0

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def normalise(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters with one space for each run of others, and the new offsets."""
    low = blocks.lower(raw)
    letter = _LETTER[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    starts = off[:-1][np.diff(off) > 0]
    keep[starts] = letter[starts]
    low[~letter] = 32
    count = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=count[1:])
    return low[keep], count[off]


def automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of text; state 0 is the start."""
    nexts, link, length, last = [{}], [-1], [0], 0
    for c in text:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts


class Model:
    """Flat parse tables of some languages: an entry is the next state, doubled, plus 1 where a phrase began."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.langs = sorted(samples)
        joined = {k: b"\n".join(v) for k, v in samples.items()}  # \n isn't a byte of normalised text
        used = sorted(set(b"".join(joined.values())) - {10})
        self.width = len(used) + 1  # class 0: bytes that no sample has
        self.classes = np.zeros(256, np.int32)
        self.classes[used] = np.arange(1, self.width)
        self.tables, self.weights = [], []
        for lang in self.langs:
            states = automaton(joined[lang])
            table = np.full((len(states), self.width), -1, np.int32)
            for s, moves in enumerate(states):
                for c, to in moves.items():
                    if c != 10:
                        table[s, self.classes[c]] = to
            root = np.where(table[0] >= 0, table[0], 0)
            table = np.where(table >= 0, table * 2, root * 2 + 1)
            self.tables.append((table[:, :] // 2 * self.width * 2 + (table & 1)).ravel().astype(np.int32))
            self.weights.append(np.log2(len(joined[lang]) + 2.0))

    def parse(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Normalised phrases of each text (rows) in each language."""
        n = np.diff(off)
        parts = -(-n // SEGMENT)
        text = np.repeat(np.arange(len(n)), parts)
        k = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = off[:-1][text] + k * SEGMENT
        size = np.minimum(SEGMENT, n[text] - k * SEGMENT)
        order = np.argsort(-size, kind="stable")
        active = np.searchsorted(-size[order], -np.arange(1, SEGMENT + 1), side="right")
        cls = self.classes[raw]
        langs = len(self.tables)
        state = np.zeros((langs, len(start)), np.int32)
        phrases = np.zeros((langs, len(start)), np.int32)
        for t in range(int(size.max()) if len(size) else 0):
            a = active[t]
            c = cls[start[order[:a]] + t]
            for j, table in enumerate(self.tables):
                v = table.take(state[j, :a] + c)
                phrases[j, :a] += v & 1
                state[j, :a] = v >> 1
        out = np.zeros((len(n), langs))
        for j, table in enumerate(self.tables):
            end, count = np.empty_like(state[j]), np.empty_like(phrases[j])
            end[order], count[order] = state[j], phrases[j]
            count += self._corrected(table, cls, start, size, np.flatnonzero(k), end)
            out[:, j] = (np.bincount(text, count, len(n)) + (n > 0)) * self.weights[j]
        return out

    @staticmethod
    def _corrected(table: np.ndarray, cls: np.ndarray, start: np.ndarray, size: np.ndarray, later: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many more phrases the segments ``later`` have if they begin in the states in which those before them end.

        A correction ends where both parses are in one state; a segment in which they never are ends in another state, and the next one is corrected again.
        """
        more = np.zeros(len(start), np.int32)
        follows = np.zeros(len(start) + 1, bool)
        follows[later] = True
        todo = later
        for _ in range(ROUNDS):
            if not len(todo):
                return more
            own, real = np.zeros(len(todo), np.int32), end[todo - 1]
            more[todo] = 0
            live, t = np.flatnonzero(own != real), 0
            while len(live):
                c = cls[start[todo[live]] + t]
                x, y = table.take(real[live] + c), table.take(own[live] + c)
                more[todo[live]] += (x & 1) - (y & 1)
                real[live], own[live] = x >> 1, y >> 1
                t += 1
                live = live[(real[live] != own[live]) & (t < size[todo[live]])]
            moved = todo[real != own]
            changed = moved[end[moved] != real[real != own]]
            end[moved] = real[real != own]
            todo = changed + 1
            todo = todo[follows[todo]]
        for s in todo.tolist():  # one after another: periodic texts
            while follows[s]:
                real, own, extra = int(end[s - 1]), 0, 0
                for c in cls[start[s] : start[s] + size[s]].tolist():
                    x, y = int(table[real + c]), int(table[own + c])
                    extra += (x & 1) - (y & 1)
                    real, own = x >> 1, y >> 1
                    if real == own:
                        break
                more[s] = extra
                if real == own or end[s] == real:
                    break
                end[s] = real
                s += 1
        return more


def fit(docs: DataFrame, train: Column, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> list[Model]:
    """Learns from at most ``sample_docs`` whole documents a language, those of the smallest hashes of their ids; a model for each SLICE_LANGS languages.

    Only ids and lengths travel to choose them (each partition sends at most sample_docs a language); then only their texts are read.
    """
    taught = train & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    size = F.octet_length("text")
    rows = docs.where(taught).select("doc_id", "lang", size.alias("size"))
    order = W.partitionBy("lang").orderBy(F.when(F.col("size") <= sample_bytes, 0).otherwise(F.col("size")), F.xxhash64("doc_id"), "doc_id")
    top = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample_docs)
    samples: dict[str, list[bytes]] = {}
    picked: dict[str, list] = {}
    used: dict[str, int] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["rank"])):
        got = used.get(r["lang"], 0)
        if not got or got + r["size"] <= sample_bytes:
            picked.setdefault(r["lang"], []).append(r["doc_id"])
            used[r["lang"]] = got + max(r["size"], 1)
    ids = {i for x in picked.values() for i in x}
    if ids:
        found = docs.where(F.col("doc_id").isin(sorted(ids)) & taught).select("lang", "doc_id", "text")
        per = {lang: set(x) for lang, x in picked.items()}
        for lang, _, text in sorted({tuple(r) for r in found.collect() if r["doc_id"] in per.get(r["lang"], ())}):
            raw = np.frombuffer(text.encode(), np.uint8)
            low, _ = normalise(raw, np.array([0, len(raw)]))
            if low.tobytes().strip():
                samples.setdefault(lang, []).append(low.tobytes())
    langs = sorted(samples)
    return [Model({x: samples[x] for x in langs[k : k + SLICE_LANGS]}) for k in range(0, len(langs), SLICE_LANGS)]


_JUDGED = "__sparkloom_lang string, __sparkloom_best double, __sparkloom_second double, __sparkloom_size double"
_NAMES = [x.split()[0] for x in _JUDGED.split(", ")]


def _judged(docs: DataFrame, models: list[Model]) -> DataFrame:
    """The rows with the best language (null: the text has no letter), its normalised phrases and the next one's, and the mean bytes of its phrases."""
    spark = docs.sparkSession
    blocks.small_batches(spark)
    columns, kinds = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs
    for at, model in enumerate(models):
        shared = spark.sparkContext.broadcast(model)  # at most SLICE_LANGS tables of 2 * SAMPLE_BYTES states

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first: bool = at == 0) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = _compare(shared.value, batch.column("text"))
                if not first:
                    got = _better([batch.column(c).to_pylist() for c in _NAMES], got)
                made = [pa.array(got[0], pa.string()), *(pa.array(x, pa.float64()) for x in got[1:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *made], [*columns, *_NAMES])

        out = out.mapInArrow(run, f"{kinds}, {_JUDGED}")
        if at < len(models) - 1:
            path = shared_folder(spark)
            out.write.parquet(path)
            out = spark.read.schema(out.schema).parquet(path)
    return out


def _compare(m: Model, column: pa.Array) -> tuple[list, list, list, list]:
    lang, best, second, size = [], [], [], []
    for _, raw, off in blocks.texts(column):
        low, at = normalise(raw, off)
        cost = m.parse(low, at)
        some = np.diff(at) > 0
        for i in np.flatnonzero(some & ~_ascii_letter(raw, off)):
            some[i] = any(map(str.isalpha, bytes(raw[off[i] : off[i + 1]]).decode("utf-8", "replace")))
        which = cost.argmin(1)
        two = np.sort(cost, 1)[:, :2]
        lang += [m.langs[b] if s else None for b, s in zip(which, some)]
        best += two[:, 0].tolist()
        second += (two[:, 1] if len(m.langs) > 1 else np.full(len(some), np.inf)).tolist()
        size += (np.diff(at) / np.maximum(two[:, 0] / np.array(m.weights)[which], 1)).tolist()
    return lang, best, second, size


def _better(old: list[list], new: tuple[list, list, list, list]) -> tuple[list, list, list, list]:
    """The better of two judgements, row by row; ties stay with the old one."""
    rows = []
    for (l1, b1, s1, z1), (l2, b2, s2, z2) in zip(zip(*old), zip(*new)):
        rows.append((l1, b1, min(s1, b2), z1) if b1 <= b2 else (l2, b2, min(s2, b1), z2))
    return tuple(map(list, zip(*rows))) if rows else ([], [], [], [])


def predict(docs: DataFrame, models: list[Model], keep: list[str] = ()) -> DataFrame:
    """doc_id, the ``keep`` columns, lang_pred and score for every row, in one map over the texts for each model.

    The score compares the two best languages' phrases: 1 - best / second, doubled, at most 1; with one language 1.
    """
    kept = ["doc_id", *keep]
    rows = docs.select(*kept, *(["text"] if "text" not in kept else []))
    if not models:
        return rows.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    lang, best, second = (F.col(c) for c in _NAMES[:3])
    sure = F.when(second == float("inf"), F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * (1 - best / second)))
    return _judged(rows, models).select(*kept, F.coalesce(lang, F.lit("und")).alias("lang_pred"), F.when(lang.isNull(), 0.0).otherwise(sure).alias("score"))


def accepted(docs: DataFrame, models: list[Model], least: float = ACCEPT) -> DataFrame:
    """The rows, all their columns, whose text has a language: not ``und``, and cut into phrases of ``least`` bytes or more on average.

    How close two languages come doesn't matter: short texts, and texts in two languages, stay.
    """
    if not models:
        return docs.where(F.lit(False))
    return _judged(docs, models).where(F.col(_NAMES[0]).isNotNull() & (F.col(_NAMES[3]) >= least)).select(docs.columns)


def _ascii_letter(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    count = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_LETTER[raw] & (raw < 128), out=count[1:])
    return np.diff(count[off]) > 0
