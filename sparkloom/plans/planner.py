"""From a request to a plan: intent, mode, weights, temporal constraint; and from hits to a context."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..config import Config, QueryRequest
from ..text import dates

_SUMMARY = ("main points of", "overview of", "summarise", "summarize", "summary of", "tl;dr", "tldr", "what is this document about")
_COMPARE = (" vs ", "compare", "contradict", "difference between", "versus")
_TIME = ("after", "before", "latest", "most recent", "since", "until", "when")


def _edges(word: str, keep) -> str:
    a, b = 0, len(word)
    while a < b and not keep(word[a]):
        a += 1
    while b > a and not keep(word[b - 1]):
        b -= 1
    return word[a:b]


def _year(digits: str) -> int | None:
    return int(digits) if re.fullmatch(r"\+?[0-9]{1,9}", digits) and 1900 <= int(digits) <= 2100 else None


def classify_intent(query: str) -> str:
    low = query.lower().strip()
    if any(x in low for x in _SUMMARY):
        return "summary"
    if any(x in low for x in _COMPARE):
        return "comparative"
    words = query.split()
    if any(x in low for x in _TIME) or any(_year(_edges(w, lambda c: c in "0123456789")) for w in words):
        return "temporal"
    if '"' in query:
        return "exact"
    for w in words:
        core = _edges(w, str.isalnum)
        capitals = any("A" <= c <= "Z" for c in core)
        if len(core.encode()) > 2 and capitals and all("A" <= c <= "Z" or c == "_" for c in core):
            return "exact"
        if "_" in core or "." in core or capitals and any("a" <= c <= "z" for c in core) and len(core.encode()) > 6:
            return "exact"
    if low.startswith(("who is", "who was")) or "everything about" in low or "documents about" in low or low.startswith("what is ") and any(w[0].isupper() for w in words[2:]):
        return "entity"
    return "semantic"


@dataclass(frozen=True)
class Temporal:
    """none, latest, or years from ``low`` to ``high``."""

    kind: str = "none"
    low: int = 0
    high: int = 0

    def score(self, text: str, this_year: int) -> float:
        """How well the dates of a text fit; the year is given, never read from a clock."""
        if self.kind == "none":
            return 0.5
        years = [d[0] for d in dates(text)]
        if self.kind == "latest":
            if not years:
                return 0.0
            age = this_year - max(years)
            return 1.0 if age <= 2 else 0.6 if age <= 6 else 0.3
        return float(any(self.low <= y <= self.high for y in years))


def detect_temporal(query: str) -> Temporal:
    low = query.lower()
    if any(x in low for x in ("current", "latest", "most recent")):
        return Temporal("latest")
    years = [y for w in low.split() if (y := _year(_edges(w, str.isalnum)))]
    return Temporal("years", min(years), max(years)) if years else Temporal()


@dataclass(frozen=True)
class QueryPlan:
    intent: str
    mode: str
    w_vector: float
    w_fts: float
    use_summary: bool
    use_entities: bool
    temporal: Temporal
    explanation: str


def plan(request: QueryRequest, cfg: Config = Config()) -> QueryPlan:
    """A forced mode counts as a semantic question; exact ones search text only, temporal and exact ones weigh it more."""
    intent = classify_intent(request.text) if request.mode == "auto" else "semantic"
    mode = request.mode if request.mode != "auto" else "lexical" if intent == "exact" else "hybrid"
    wv, wf = {"exact": (0.25, 0.75), "temporal": (0.35, 0.65)}.get(intent, (cfg.weight_vector, cfg.weight_fts))
    when = detect_temporal(request.text)
    notes = [f"{intent} question, {mode} search, dense {wv:.2f}, lexical {wf:.2f}"]
    notes += ["stored summary first"] * (intent == "summary") + ["with entities"] * (intent in ("entity", "comparative"))
    notes += [f"dates: {when.kind}" + f" {when.low}-{when.high}" * (when.kind == "years")] * (when.kind != "none")
    return QueryPlan(intent, mode, wv, wf, intent == "summary", intent in ("entity", "comparative"), when, "; ".join(notes))


def assemble_context(hits: list[dict], budget: int = 3000, max_per_document: int = 3) -> str:
    """Blocks of hits (document_id, document, section, text) within a budget of bytes, then a line of citations.

    A document gives at most ``max_per_document`` blocks, a block at most 700 characters; the first that overflows ends it.
    """
    out, used, cites, per = [], 0, [], {}
    for i, h in enumerate(hits, 1):
        if per.get(h["document_id"], 0) >= max_per_document:
            continue
        cite = f"[{i}] {h['document']} :: {h['section'] if h['section'] is not None else '-'}"
        block = f"{cite}\n{h['text'][:700]}\n\n"
        size = len(block.encode())
        if used + size > budget:
            break
        used += size
        per[h["document_id"]] = per.get(h["document_id"], 0) + 1
        out.append(block)
        cites.append(cite)
    return "".join(out) + (f"CITATIONS: {' | '.join(cites)}\n" if cites else "")


def grounded_prompt(question: str, context: str) -> str:
    return f"Use nothing but the numbered sources, and cite them as [n]. If they don't say, answer that the library doesn't know.\n\n{context}\nQuestion: {question}\nAnswer:"
