"""Keywords, entities and claims of chunks."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as X
from ..text import STOPWORDS, byte_offset, canonical_key, negative, sentences, tokenize
from .lexical import token_parts

EMAIL, URL, MONEY, PERCENT, DATE, ORG, PERSON = "email", "url", "money", "percent", "date", "organization", "person"
_FORMS = "AG Association Corp Corporation Foundation GmbH Group Holdings Inc Institute LLC LLP Laboratories Laboratory Labs Limited Ltd PLC Systems University".split()
_FULL = "January February March April May June July August September October November December".split()
_CAP = r"[A-Z][A-Za-z0-9&\-]*"
_full = "|".join(_FULL)
_FAMILIES = [
    (EMAIL, 0.95, re.compile(r"\b[\w.%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", re.A)),
    (URL, 0.95, re.compile(r"\bhttps?://[^]\s)>\"']+")),
    (MONEY, 0.9, re.compile(r"[€£$]\s?\d[\d,.]*\s?[BKM]?")),
    (PERCENT, 0.9, re.compile(r"\b\d{1,3}(?:\.\d+)?%")),
    (DATE, 0.85, re.compile(rf"\b(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{4}}-\d{{2}}|(?:{'|'.join(m[:3] for m in _FULL)})[a-z]*\.?\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}\s+(?:{_full}),?\s+\d{{4}}|(?:{_full})\s+\d{{4}}|(?:19|20)\d{{2}})\b")),
    # a form that begins another one must not win over it: the bounds decide, so the order is free
    (ORG, 0.8, re.compile(rf"\b{_CAP}(?:\s+{_CAP}){{0,3}}?\s+(?:{'|'.join(_FORMS)})\b")),
    (PERSON, 0.55, re.compile(r"\b[A-Z][a-z]{1,15}\s+[A-Z][a-z]{1,15}\b")),
]
_NOT_NAMES = frozenset(
    "about above abstract after although appendix background because before below between chapter class code conclusion const def document during enum error export false figure file fn furthermore however image impl import into introduction let meanwhile methodology moreover new none note onto over overview pub references results return section self since struct summary table than that the then there therefore these this those thus todo true type under var warning when where while with within without".split()
)


def _person(name: str) -> bool:
    low = name.lower()
    return _NOT_NAMES.isdisjoint(low.split()) and not low.startswith(tuple(m.lower() for m in _FULL))


def entities(text: str) -> list[tuple[str, str, int, int, float]]:
    """(surface, type, start, end in bytes, confidence): all families, the earliest and longest of those that overlap."""
    found = []
    for kind, sure, pattern in _FAMILIES:
        for m in pattern.finditer(text):
            surface, end = m[0], m.end()
            if kind == ORG:
                words = surface.split()
                cut = next((i for i, w in enumerate(words) if i and w in _FORMS), len(words) - 1)
                if cut < len(words) - 1:
                    surface = " ".join(words[: cut + 1])
                    end = m.start() + len(surface)
                if len(surface) <= 2:
                    continue
            elif kind == PERSON and not _person(surface):
                continue
            found.append((m.start(), end, surface, kind, sure))
    found.sort(key=lambda x: (x[0], -x[1]))
    out, last = [], 0
    for start, end, surface, kind, sure in found:
        if start >= last:
            last = end
            a = byte_offset(text, start)
            out.append((surface, kind, a, a + len(surface.encode()), sure))
    return out


def keywords(text: str, most: int = 12) -> list[tuple[str, float]]:
    """Words of 3 bytes or more that are no stop words or numbers, by 1 + ln(count), the first ones among equals."""
    count: dict[str, int] = {}
    for w in tokenize(text):
        if len(w.encode()) >= 3 and w not in STOPWORDS and not (w.isascii() and w.isdigit()):
            count[w] = count.get(w, 0) + 1
    return sorted(((w, 1 + math.log(c)) for w, c in count.items()), key=lambda x: -x[1])[:most]


_SUBJECT = r"\b([A-Z][\w&.\-]*(?:[ \t]+[A-Za-z][\w&.\-]*){0,%d})[ \t]+"
_METRICS = "arr funding growth market share mrr profit revenue sales users".replace("market share", "market_share").split()
_ACTIONS = "acquired announced deployed founded introduced joined launched published released".split()
_NUMERIC = re.compile("(?i)" + _SUBJECT % 3 + rf"({'|'.join(_METRICS).replace('_', ' ')})[ \t]+(?:=|grew to|hit|is|of|reached|was|were)[ \t]+([€£$]?[ \t]?\d[\d,.]*[ \t]?(?:billion|million|thousand|[BKMm%])?)")
_ACTION = re.compile(_SUBJECT % 3 + rf"({'|'.join(_ACTIONS)})[ \t]+([A-Z0-9][^!.?]{{2,120}})")
_COPULA = re.compile(_SUBJECT % 2 + r"(are|is|was|were)[ \t]+((?:an|a|the)?[ \t]?[A-Za-z0-9][^!.?]{2,120})")
_FROM = re.compile(r"(?i)\b(?:as of|from|in|since|starting)\s+((?:19|20)\d{2}(?:-\d{2}-\d{2})?)")
_UNTIL = re.compile(r"(?i)\b(?:by|ending|through|till|until)\s+((?:19|20)\d{2}(?:-\d{2}-\d{2})?)")


def claim(sentence: str) -> tuple[str, str, str, float] | None:
    """(subject, predicate, object, confidence) by the first family that matches: metric, action, copula."""
    no = negative(sentence)
    if m := _NUMERIC.search(sentence):
        return m[1].strip(), m[2].lower(), m[3].strip(), 0.45 if no else 0.6
    if m := _ACTION.search(sentence):
        return m[1].strip(), m[2].lower(), m[3].strip().rstrip("."), 0.35 if no else 0.5
    if m := _COPULA.search(sentence):
        subject, thing = m[1].strip(), m[3].strip().rstrip(".")
        if len(subject.encode()) > 2 and len(thing.encode()) > 3:
            return subject, "is", thing, 0.3 if no else 0.4
    return None


def claims(text: str) -> list[tuple]:
    """(subject, predicate, object, sentence, start, end, negated, confidence, valid_from, valid_until) of sentences of 12 to 400 bytes."""
    out = []
    for at, s in sentences(text):
        n = len(s.encode())
        if 12 <= n <= 400 and (c := claim(s)):
            begin, end = _FROM.search(s), _UNTIL.search(s)
            out.append((c[0], c[1], c[2], s, at, at + n, negative(s), c[3], begin and begin[1], end and end[1]))
    return out


# --- over tables of chunks (id, document_id, text)

MENTIONS = "chunk_id long, document_id long, ordinal int, surface string, entity_type string, start_offset long, end_offset long, confidence double, key string"
CLAIMS = "claim_id long, document_id long, chunk_id long, subject string, predicate string, object string, sentence string, start_offset long, end_offset long, negated boolean, confidence double, valid_from string, valid_until string, subject_key string, predicate_key string"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def _mapped(chunks: DataFrame, rows_of, schema: str) -> DataFrame:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for chunk, doc, text in zip(*(b.column(k).to_pylist() for k in range(3))) for r in rows_of(chunk, doc, text or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(zip(*rows), kinds)], names)

    return chunks.select("id", "document_id", "text").mapInArrow(run, schema)


def mentions(chunks: DataFrame) -> DataFrame:
    """Entity candidates that are kept: no urls and percentages, keys of 2 bytes or more."""

    def rows(chunk: int, doc: int, text: str) -> Iterator[tuple]:
        for i, (surface, kind, a, b, sure) in enumerate(entities(text)):
            key = canonical_key(surface)
            if kind not in (URL, PERCENT) and len(key.encode()) >= 2:
                yield chunk, doc, i, surface, kind, a, b, sure, key

    return _mapped(chunks, rows, MENTIONS)


def claim_table(chunks: DataFrame) -> DataFrame:
    """Claims of chunks; ids are chunk id * 2**10 + ordinal."""

    def rows(chunk: int, doc: int, text: str) -> Iterator[tuple]:
        for i, (s, p, o, sentence, a, b, no, sure, begin, end) in enumerate(claims(text)):
            yield chunk * 1024 + i, doc, chunk, s, p, o, sentence, a, b, no, sure, begin, end, canonical_key(s), p.lower()

    return _mapped(chunks, rows, CLAIMS)


def keyword_rows(chunks: DataFrame, most: int = 12) -> DataFrame:
    """term, chunk_id, document_id, n and r of each chunk's keywords: their count, and rank by (count desc, first position).

    A map finds the keywords of a chunk without an exchange; chunks whose id occurs again are counted together by one.
    """
    again = chunks.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("id").alias("again"))
    same = F.col("id").eqNullSafe(F.col("again"))
    alone, several = (chunks.join(F.broadcast(again), same, how) for how in ("left_anti", "left_semi"))  # few ids, if any

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = pa.array(sorted(STOPWORDS))
        for part, size, tokens in token_parts(batches):
            coded = tokens.dictionary_encode()
            word = coded.dictionary
            fit = pc.and_not(pc.greater_equal(pc.binary_length(word), 3), pc.or_(pc.is_in(word, stop), pc.match_substring_regex(word, "^[0-9]+$")))
            fit, code = fit.to_numpy(zero_copy_only=False).astype(bool), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.flatnonzero(fit[code])
            key, first, n = np.unique(np.repeat(np.arange(len(size)), size)[at] * max(1, len(word)) + code[at], return_index=True, return_counts=True)
            row, code = key // max(1, len(word)), key % max(1, len(word))
            order = np.lexsort((first, -n, row))
            row, code, n = row[order], code[order], n[order]
            r = np.arange(len(row)) - np.searchsorted(row, row) + 1
            row, code, n, r = (x[r <= most] for x in (row, code, n, r))
            yield pa.RecordBatch.from_arrays([word.take(pa.array(code)), part.column("chunk_id").take(pa.array(row)), part.column("document_id").take(pa.array(row)), pa.array(n), pa.array(r)], ["term", "chunk_id", "document_id", "n", "r"])

    words = alone.select(F.col("id").alias("chunk_id"), "document_id", X.tokens(F.col("text")).alias("tokens"))
    kinds = dict(words.dtypes)
    top = words.mapInArrow(run, f"term string, chunk_id {kinds['chunk_id']}, document_id {kinds['document_id']}, n long, r long")
    words = several.select(F.col("id").alias("chunk_id"), "document_id", F.posexplode(X.tokens(F.col("text"))).alias("pos", "term"))
    words = words.where((F.octet_length("term") >= 3) & ~F.col("term").isin(sorted(STOPWORDS)) & ~F.col("term").rlike("^[0-9]+$"))
    tf = words.groupBy("chunk_id", "document_id", "term").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    rest = tf.withColumn("r", F.row_number().over(W.partitionBy("chunk_id").orderBy(F.desc("n"), "first")).cast("long")).where(F.col("r") <= most)
    return top.unionByName(rest.select("term", "chunk_id", "document_id", "n", "r"))


def keyword_table(chunks: DataFrame, most: int = 12) -> DataFrame:
    """chunk_id, document_id, term, weight and rank of each chunk's keywords, weighted by document frequency.

    Weight: 1 + ln(count), times max(ln(documents / df), 0.15) where there is more than one document; df counts documents
    that keep the term as a keyword.
    """
    top = keyword_rows(chunks, most).select("chunk_id", "document_id", "term", (1 + F.log("n")).alias("tf"), "r")
    df = term_df(top)
    total = chunks.agg(F.countDistinct("document_id").alias("documents"))
    weight = F.when(F.col("documents") > 1, F.col("tf") * F.greatest(F.log(F.col("documents") / F.col("df")), F.lit(0.15))).otherwise(F.col("tf"))
    out = top.join(df, "term").crossJoin(F.broadcast(total)).withColumn("weight", weight)  # one row
    return out.withColumn("rank", F.row_number().over(W.partitionBy("chunk_id").orderBy(F.desc("weight"), "r"))).select("chunk_id", "document_id", "term", "weight", "rank")


def term_df(keyword_rows: DataFrame) -> DataFrame:
    return keyword_rows.groupBy("term").agg(F.countDistinct("document_id").alias("df"))
