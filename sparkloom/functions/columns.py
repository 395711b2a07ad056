"""Column expressions: everything here stays inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{IsAlphabetic}\p{N}]+"
_LEGAL = "ag bv co company corp corporation gmbh group holdings inc incorporated limited llc llp ltd oy plc sa sas".split()


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def normalize(text: Column) -> Column:
    """Unix line ends, no trailing blanks or control characters but tabs, at most two empty lines in a row, a final line end."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(F.concat(t, F.lit("\n")), r"[ \t\f\x0B]+\n", "\n")
    t = F.regexp_replace(t, r"[\x00-\x08\x0B-\x1F\x7F-\x9F]", "")
    return F.regexp_replace(F.regexp_replace(t, r"\n{4,}", "\n\n\n"), r"^\n{3,}", "\n\n")


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def canonical_key(surface: Column) -> Column:
    words = tokens(surface)
    legal = F.array(*map(F.lit, _LEGAL))
    return F.array_join(F.filter(words, lambda w, i: (i == 0) | ~F.array_contains(legal, w)), " ")


def negative(sentence: Column) -> Column:
    low = F.lower(sentence)
    out = F.lit(False)
    for x in ("not", "n't", " never ", " no longer ", " without "):
        out = out | low.contains(x)
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), F.lit(0.0)).otherwise(dot(a, b) / norms)


_YEAR = r"((?:19|20)\d{2}(?:-\d{2}-\d{2})?)"


def valid_from(sentence: Column) -> Column:
    return F.nullif(F.regexp_extract(sentence, rf"(?i)\b(?:as of|from|in|since|starting)\s+{_YEAR}", 1), F.lit(""))


def valid_until(sentence: Column) -> Column:
    return F.nullif(F.regexp_extract(sentence, rf"(?i)\b(?:by|ending|through|till|until)\s+{_YEAR}", 1), F.lit(""))


def first_number(text: Column) -> Column:
    """The first token that is a number, times its unit or the unit word after it; commas separate tokens."""
    raw = F.split(text, r"[\s$€£,;]+")
    clean = F.filter(F.transform(raw, lambda t: F.regexp_replace(t, r"^[.!?():]+|[.!?():]+$", "")), lambda t: t != "")
    number = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)$"

    def parts(t: Column, i: Column) -> Column:
        bare = F.regexp_replace(t, "%$", "")
        unit = F.lower(F.regexp_extract(bare, r"^\d.*([mbkMBK])$", 1))
        core = F.when(unit != "", F.regexp_replace(bare, r"[mbkMBK]$", "")).otherwise(bare)
        times = F.when(unit == "m", 1e6).when(unit == "b", 1e9).when(unit == "k", 1e3).otherwise(1.0)
        nxt = F.lower(F.coalesce(F.get(clean, i + 1), F.lit("")))
        word = F.when(nxt.isin("million", "mln"), 1e6).when(nxt.isin("billion", "bln"), 1e9).when(nxt.isin("thousand", "k"), 1e3).otherwise(1.0)
        return F.when(core.rlike(number), core.try_cast("double") * F.when(times == 1.0, word).otherwise(times))

    return F.get(F.filter(F.transform(clean, parts), lambda v: v.isNotNull()), F.lit(0))


def intent(text: Column) -> Column:
    """The kind of question, by the first rule that fits: summary, comparative, temporal, exact, entity, semantic."""
    low = F.trim(F.lower(text))

    def any_of(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | low.contains(w)
        return out

    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    core = F.transform(words, lambda w: F.regexp_replace(w, r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$", ""))
    digits = F.transform(words, lambda w: F.regexp_replace(w, r"^[^0-9]+|[^0-9]+$", ""))
    year = F.exists(digits, lambda d: d.rlike(r"^0*(19\d\d|20\d\d|2100)$"))
    exact = F.exists(
        core,
        lambda c: ((F.octet_length(c) > 2) & c.rlike("^[A-Z_]+$") & c.rlike("[A-Z]")) | c.contains("_") | (c.rlike("[A-Z]") & c.rlike("[a-z]") & (F.octet_length(c) > 6)) | c.contains("."),
    )
    late = F.exists(F.slice(words, 3, F.greatest(F.size(words), F.lit(1))), lambda w: w.rlike(r"^\p{Lu}"))
    return (
        F.when(any_of("summarize", "summarise", "summary of", "overview of", "tl;dr", "tldr", "what is this document about", "main points of"), "summary")
        .when(any_of("compare", "difference between", "versus", " vs ", "contradict"), "comparative")
        .when(year | any_of("when", "latest", "most recent", "before", "after", "since", "until"), "temporal")
        .when(text.contains('"') | exact, "exact")
        .when(low.startswith("who is") | low.startswith("who was") | (low.startswith("what is ") & late) | any_of("everything about", "documents about"), "entity")
        .otherwise("semantic")
    )
