"""Benchmark decontamination: a BM25 inverted index of test items, queried by every training passage.

Texts are cut into passages of two strides that overlap by one, where a stride
is as long as the longest unit of an item, so that a unit that stands in a text
stands in one of its passages whole. A unit is an item, or one of the parts of
PART_WORDS words of a longer one. A unit's BM25 score for a passage is divided
by its score for itself; all units at RETRIEVE or more are retrieved by
block-max WAND: terms' posting lists have a maximum and one for each block of
BLOCK postings; cursors advance to the pivot, the first unit that the lists'
maxima let reach the threshold, and past blocks whose maxima can't. Passages of
which all lists' maxima together stay below it, or do so in every block of
UNIT_BLOCK units, are never begun, and cursors move only within blocks of units
that may reach it. What is
retrieved is verified on word overlap: the question (all lines but the last) by
word 5-grams in the passage, and the answer (the last line) by word pairs, in
the passage or, if the item is long, in the whole text.

Document frequencies, the number of units and their mean length are those of all
items. Items are indexed in slices of about SLICE_ITEMS items and SLICE_BYTES of
text (and one item more, at most), each of which is broadcast; several slices
are passes over the texts, one after another.

Words are lower-case runs of letters, digits and non-ASCII bytes. Null or empty
texts and items without words match nothing. Repeated rows are judged one by
one, equal items found each by its id; equal scores don't matter. Texts of any
length are searched whole. More columns are ignored, or kept by ``clean``; empty
tables give no leaks.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .exchange import shared_folder
from .toxicity import _GAP

K1, B = 1.2, 0.75
RETRIEVE, QUESTION, ANSWER = 0.5, 0.6, 0.5
SLICE_ITEMS, SLICE_BYTES, BLOCK, UNIT_BLOCK, MIN_STRIDE, PART_WORDS = 2048, 2 << 20, 16, 8, 32, 512


def _names(text: str) -> np.ndarray:
    raw = blocks.lower(np.frombuffer(text.encode(), np.uint8))
    start, end, _ = blocks.words(raw, np.array([0, len(raw)]), _GAP)
    return blocks.word_names(raw, start, end)


def _shingles(names: np.ndarray, n: int) -> set[int]:
    if not len(names):
        return set()
    n = min(n, len(names))
    h = np.zeros(len(names) - n + 1, np.uint64)
    for k in range(n):
        h = h * blocks.U(0xD6E8FEB86659FD93) + names[k : len(names) - n + 1 + k]
    return set(h.tolist())


@dataclass
class Unit:
    """What is retrieved at once: its item, its words, and the shingles of question and answer."""

    item: object
    names: np.ndarray
    question: set[int]
    question_size: int
    answer: set[int]
    answer_size: int
    part: bool


def units(item: object, text: str) -> list[Unit]:
    names = _names(text)
    lines = [x for x in text.split("\n") if x.strip()]
    answer = _names(lines[-1]) if len(lines) > 1 else np.zeros(0, np.uint64)
    question = names[: len(names) - len(answer)]
    ends = (_shingles(answer, 2), min(2, max(len(answer), 1)))
    if len(names) <= PART_WORDS:
        return [Unit(item, names, _shingles(question, 5), min(5, max(len(question), 1)), *ends, False)] if len(names) else []
    parts = np.array_split(question, -(-len(question) // PART_WORDS)) if len(question) else np.array_split(names, -(-len(names) // PART_WORDS))
    return [Unit(item, x, _shingles(x, 5), min(5, len(x)), *ends, True) for x in parts]


@dataclass
class Stats:
    """Of all items: how many units, their mean length, the passages' stride, and document frequencies (of the terms that matter here)."""

    n: int
    mean: float
    stride: int
    terms: np.ndarray
    df: np.ndarray

    @staticmethod
    def of(every: list[Unit]) -> Stats:
        terms, df = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(u.names) for u in every)]), return_counts=True)
        size = [len(u.names) for u in every]
        return Stats(len(every), sum(size) / max(len(size), 1), max([MIN_STRIDE, *size]), terms, df)


class Index:
    """Posting lists of units' normalised impacts, with maxima by list and by block."""

    def __init__(self, every: list[Unit], stats: Stats):
        every = sorted(every, key=lambda u: len(u.names))  # units of like length share blocks
        self.units, self.stride = every, stats.stride
        n = len(every)
        self.terms, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *(u.names for u in every)]), return_inverse=True)
        item = np.repeat(np.arange(n), [len(u.names) for u in every])
        posting, tf = np.unique(at.astype(np.int64) * max(n, 1) + item, return_counts=True)
        term, item = posting // max(n, 1), posting % max(n, 1)
        df = stats.df[np.searchsorted(stats.terms, self.terms)][term] if len(term) else tf
        length = np.array([len(u.names) for u in every], float)[item] if n else np.zeros(0)
        impact = np.log1p((stats.n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(stats.mean, 1e-9)))
        impact = impact / np.bincount(item, impact, n)[item] if n else impact
        begin = np.searchsorted(term, np.arange(len(self.terms) + 1))
        blocks_of = -(-np.diff(begin) // BLOCK)
        first = np.cumsum(blocks_of) - blocks_of
        block = (first[term] + (np.arange(len(term)) - begin[term]) // BLOCK) if len(term) else np.zeros(0, np.int64)
        maxima, last = np.zeros(int(blocks_of.sum())), np.zeros(int(blocks_of.sum()), np.int32)
        np.maximum.at(maxima, block, impact)
        np.maximum.at(last, block, item.astype(np.int32))
        self.by_list = np.zeros(len(self.terms))
        np.maximum.at(self.by_list, term, impact)
        self.by_block = np.zeros((len(self.terms), -(-n // UNIT_BLOCK)), np.float32)
        np.maximum.at(self.by_block, (term, item // UNIT_BLOCK), (impact * (1 + 1e-6)).astype(np.float32))
        self.begin, self.first = begin.tolist(), first.tolist()
        self.item, self.impact = array("i", item.astype(np.int32).tobytes()), array("d", impact.tobytes())
        self.maxima, self.last = array("d", maxima.tobytes()), array("i", last.tobytes())
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.terms >> blocks.U(48)).astype(np.int64)] = True

    def wand(self, terms: list[int], low: int, high: int) -> list[tuple[int, float]]:
        """(unit, score) of all units from ``low`` to before ``high`` at RETRIEVE or more for a set of terms."""
        items, impacts, least = self.item, self.impact, RETRIEVE - 1e-9
        lists = []
        for t in terms:
            at = bisect_left(items, low, self.begin[t], self.begin[t + 1])
            end = bisect_left(items, high, at, self.begin[t + 1])
            if at < end:
                lists.append([items[at], at, end, t, float(self.by_list[t])])
        out = []

        def seek(c: list, unit: int) -> None:
            c[1] = bisect_left(items, unit, c[1], c[2])
            c[0] = items[c[1]] if c[1] < c[2] else 1 << 31

        while True:
            lists.sort()
            while lists and lists[-1][1] >= lists[-1][2]:
                lists.pop()
            total, pivot = 0.0, -1
            for k, c in enumerate(lists):
                total += c[4]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                return out
            unit = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == unit:
                pivot += 1
            bound, beyond = 0.0, lists[pivot + 1][0] if pivot + 1 < len(lists) else 1 << 31
            for c in lists[: pivot + 1]:
                at = bisect_left(items, unit, c[1], c[2])
                if at < c[2]:
                    b = self.first[c[3]] + (at - self.begin[c[3]]) // BLOCK
                    bound += self.maxima[b]
                    beyond = min(beyond, self.last[b] + 1)
            if bound < least:
                for c in lists[: pivot + 1]:
                    seek(c, max(beyond, unit + 1))
            elif lists[0][0] == unit:
                score = sum(impacts[c[1]] for c in lists[: pivot + 1])
                if score >= least:
                    out.append((unit, score))
                for c in lists[: pivot + 1]:
                    seek(c, unit + 1)
            else:
                for c in lists[:pivot]:
                    seek(c, unit)

    def retrieve(self, name: np.ndarray, owner: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(text, first word of the passage, unit, score) of all units at RETRIEVE or more, by passage."""
        if not len(self.units) or not len(name):
            return []
        maybe = np.flatnonzero(self.filter[(name >> blocks.U(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, name[maybe]), len(self.terms) - 1)
        sure = self.terms[at] == name[maybe]
        where, term = maybe[sure], at[sure]
        cell = (where - first[owner[where]]) // self.stride
        cells = -(-np.diff(first) // self.stride) + 1  # passage c of a text holds cells c - 1 and c
        base = np.cumsum(cells) - cells
        passage = np.concatenate([base[owner[where]] + cell, base[owner[where]] + cell + 1])
        key = np.unique(passage * len(self.terms) + np.concatenate([term, term]))
        passage, term = key // len(self.terms), key % len(self.terms)
        if not len(key):
            return []
        new = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
        size = np.diff(np.append(new, len(key)))
        out = []
        live = np.flatnonzero(np.add.reduceat(self.by_list[term], new) >= RETRIEVE - 1e-9)
        for part in np.array_split(live, max(1, int(size[live].sum()) * self.by_block.shape[1] // (4 << 20) + 1)):
            if not len(part):
                continue
            heads = np.cumsum(size[part]) - size[part]
            rows = np.repeat(new[part] - heads, size[part]) + np.arange(int(size[part].sum()))
            which, block = np.nonzero(np.add.reduceat(self.by_block[term[rows]], heads, axis=0) >= RETRIEVE - 1e-5)
            for i, k in zip(part[which].tolist(), block.tolist()):
                here = term[new[i] : new[i] + size[i]]
                found = self.wand(here[self.by_block[here, k] > 0].tolist(), k * UNIT_BLOCK, (k + 1) * UNIT_BLOCK)
                if found:
                    c = int(passage[new[i]])
                    text = int(np.searchsorted(base, c, side="right")) - 1
                    out += [(text, max(0, c - int(base[text]) - 1) * self.stride, unit, score) for unit, score in found]
        return out

    def leaks(self, raw: np.ndarray, off: np.ndarray) -> list[tuple[int, object, float, float, float]]:
        """Verified (text, item, score, question overlap, answer overlap), one for each text and item, that of the best passage."""
        low = blocks.lower(raw)
        start, end, first = blocks.words(low, off, _GAP)
        name = blocks.word_names(low, start, end)
        owner = np.repeat(np.arange(len(off) - 1), np.diff(first))
        best: dict[tuple[int, object], tuple[float, float, float]] = {}
        for text, at, unit, score in self.retrieve(name, owner, first):
            u = self.units[unit]
            whole = name[first[text] : first[text + 1]]
            here = whole[at : at + 2 * self.stride]
            q = _share(u.question, u.question_size, here)
            a = _share(u.answer, u.answer_size, whole if u.part else here)
            if q >= QUESTION and a >= ANSWER:
                best[text, u.item] = max(best.get((text, u.item), (0.0, 0.0, 0.0)), (score, q, a))
        return [(t, i, *x) for (t, i), x in sorted(best.items(), key=lambda x: (x[0][0], str(x[0][1])))]


def _share(wanted: set[int], n: int, words: np.ndarray) -> float:
    if not wanted:
        return 1.0
    return len(wanted & _shingles(words, n)) / len(wanted) if len(words) >= n else 0.0


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = [u for i, t in enumerate(batch.column("text").to_pylist()) for u in units(i, t)]
        terms = np.concatenate([np.zeros(0, np.uint64), *(np.unique(u.names) for u in every)]).view(np.int64)
        size = np.concatenate([np.zeros(0, np.int64), *([len(u.names)] + [0] * (len(np.unique(u.names)) - 1) for u in every)]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(size)], ["term", "size"])


def indexes(items: DataFrame) -> Iterator[Index]:
    """An index for each slice of the items, every slice of a bounded size, all with the statistics of all items."""
    items = items.where(F.col("text").isNotNull()).select("item_id", "text")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    slices = max(-(-2 * n // SLICE_ITEMS), -(-2 * size // SLICE_BYTES))
    if slices < 3:  # one table of at most that size
        slices = min(slices, 1)
    terms = items.select("text").mapInArrow(_term_rows, "term long, size long") if slices > 1 else None
    if terms is not None:
        path = shared_folder(items.sparkSession)
        terms.write.parquet(path)
        terms = items.sparkSession.read.schema("term long, size long").parquet(path)
        count, words, most = terms.where("size > 0").agg(F.count("*"), F.sum("size"), F.max("size")).first()
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        every = [u for i, t in sorted(map(tuple, part.collect()), key=str) for u in units(i, t)]
        if not every:
            continue
        stats = Stats.of(every)
        if terms is not None:
            here = part.select("text").mapInArrow(_term_rows, "term long, size long").select("term").distinct()
            df = terms.join(here, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")).toPandas()  # a slice's terms
            name = df["term"].to_numpy(np.int64).view(np.uint64)
            by = np.argsort(name)
            stats = Stats(count, words / count, max(MIN_STRIDE, most), name[by], df["df"].to_numpy()[by])
        yield Index(every, stats)


def _passes(docs: DataFrame, items: DataFrame, one: Callable[[DataFrame, object], DataFrame], step: Callable[[DataFrame, DataFrame], DataFrame]) -> Iterator[DataFrame]:
    """The result of each slice; if there are several, each is written before the next slice is broadcast."""
    spark = docs.sparkSession
    blocks.small_batches(spark)
    before = None
    for index in indexes(items):
        if before is not None:
            path = shared_folder(spark)
            before.write.parquet(path)
            done = spark.read.schema(before.schema).parquet(path)
            shared.unpersist()
            docs = step(docs, done)
            yield done
        shared = spark.sparkContext.broadcast(index)
        before = one(docs, shared)
    if before is not None:
        yield before


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap and answer_overlap of every verified leak; a map over the texts for each slice."""
    kinds, item_kind = dict(docs.dtypes), dict(items.dtypes)["item_id"]
    schema = f"doc_id {kinds['doc_id']}, item_id {item_kind}, score double, question_overlap double, answer_overlap double"
    arrow = pa.int64() if item_kind == "bigint" else None

    def one(texts: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(row + t, i, *x) for row, raw, off in blocks.texts(batch.column("text")) for t, i, *x in shared.value.leaks(raw, off)]
                if found:
                    t, i, *rest = map(list, zip(*found))
                    columns = [batch.column("doc_id").take(pa.array(t)), pa.array(i, arrow), *(pa.array(x, pa.float64()) for x in rest)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return texts.mapInArrow(run, schema)

    out = None
    for part in _passes(docs.select("doc_id", "text"), items, one, lambda texts, _: texts):
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, all their columns, in which no item was verified."""

    def one(texts: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, raw, off in blocks.texts(batch.column("text")):
                    for t, *_ in shared.value.leaks(raw, off):
                        keep[row + t] = False
                yield batch if keep.all() else batch.filter(pa.array(keep))

        return texts.mapInArrow(run, docs.schema)

    out = docs
    for out in _passes(docs, items, one, lambda _, done: done):
        pass
    return out
