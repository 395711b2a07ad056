"""Plain functions of strings. Offsets are bytes of UTF-8 where they are named so."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

_LEGAL = frozenset("ag bv co company corp corporation gmbh group holdings inc incorporated limited llc llp ltd oy plc sa sas".split())
STOPWORDS = frozenset(
    "a about after all also an and any are as at be because been before between both but by can could did do does done during each for from had has have he her his how i if in into is it its may might more most must no not of on only or other our over same shall she should so some such than that the their them then there these they this to use used using very via was we were what when where which while who will with would you your".split()
)
_MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)} | {"sept": 9}


_RUN = re.compile(r"[^\W_]+")  # of characters that isalnum() holds for


def tokenize(text: str) -> list[str]:
    """Lower-case runs of letters and digits of any script; each character's own lower case, whatever stands beside it."""
    if text.isascii():
        return _RUN.findall(text.lower())
    return "\n".join(_RUN.findall(text)).replace("Σ", "σ").lower().split("\n") if _RUN.search(text) else []


def canonical_key(surface: str) -> str:
    """Lower-case words without legal forms, unless they come first."""
    kept: list[str] = []
    for w in tokenize(surface):
        if not (kept and w in _LEGAL):
            kept.append(w)
    return " ".join(kept)


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    left = []
    for i, ch in enumerate(a):
        for k in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[k] and b[k] == ch:
                taken[k] = True
                left.append(ch)
                break
    if not left:
        return 0.0
    right = [ch for ch, t in zip(b, taken) if t]
    m, moved = len(left), sum(x != y for x, y in zip(left, right))
    return (m / len(a) + m / len(b) + (m - moved / 2) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by a tenth for each of the first four characters in common if it is above 0.7."""
    j = jaro(a, b)
    if j <= 0.7:
        return j
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return min(1.0, j + 0.1 * same * (1 - j))


def _control(ch: str) -> bool:
    return unicodedata.category(ch) == "Cc"


def normalize(text: str) -> str:
    """Unix line ends, no trailing blanks or control characters but tabs, at most two empty lines in a row."""
    out, empty = [], 0
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = line.rstrip()
        if line:
            empty = 0
            out.append("".join(c for c in line if c == "\t" or not _control(c)))
        else:
            empty += 1
            if empty <= 2:
                out.append("")
    return "".join(x + "\n" for x in out)


def control_share(text: str) -> float:
    return sum(_control(c) and c not in "\n\t\r" for c in text) / len(text) if text else 1.0


def byte_offset(text: str, at: int) -> int:
    return len(text[:at].encode())


def sentences(text: str) -> list[tuple[int, str]]:
    """(byte offset, sentence); a stop counts before blanks and before a capital or digit, so decimals are cut too."""
    out, start, base, done = [], 0, 0, 0
    for i, ch in enumerate(text):
        if ch in ".!?":
            after = text[i + 1 : i + 3]
            lead = after.lstrip()
            if not after.strip() or lead[0].isupper() or lead[0] in "0123456789":
                s = text[start : i + 1].strip()
                if s:
                    out.append((base, s))
                base += len(text[start : i + 1].encode())
                start = i + 1
    tail = text[start:].strip()
    if tail:
        out.append((base, tail))
    return out


def negative(sentence: str) -> bool:
    """Whether a sentence has "not" or "n't" anywhere, or one of three other words."""
    low = sentence.lower()
    return any(x in low for x in ("not", "n't", " never ", " no longer ", " without "))


_UNITS = {"m": 1e6, "b": 1e9, "k": 1e3}
_WORDS = {"million": 1e6, "mln": 1e6, "billion": 1e9, "bln": 1e9, "thousand": 1e3, "k": 1e3}
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|inf(?:inity)?|nan)", re.I)


def first_number(text: str) -> float | None:
    """The first token that is a number, times its unit or the unit word after it. Commas separate tokens."""
    tokens = [t.strip(".!?()():") for t in re.split(r"[\s$€£,;]+", text)]
    tokens = [t for t in tokens if t]
    for i, token in enumerate(tokens):
        core, times = token.removesuffix("%"), 1.0
        if len(core) >= 2 and core[-1].lower() in _UNITS and core[0] in "0123456789":
            core, times = core[:-1], _UNITS[core[-1].lower()]
        if _NUMBER.fullmatch(core):
            if times == 1.0 and i + 1 < len(tokens):
                times = _WORDS.get(tokens[i + 1].lower(), 1.0)
            return float(core) * times
    return None


_YEAR = r"(?:19|20)\d{2}"
_DATE = re.compile(
    rf"(?P<iso>{_YEAR}-(?:1[0-2]|0[1-9])(?:-(?:3[01]|[12]\d|0[1-9]))?)|(?P<month>{'|'.join(x.title() for x in _MONTHS)})[a-z]*\.?\s(?:[0-3]?\d,\s)?(?P<month_year>{_YEAR})|Q(?P<quarter>[1-4])\s(?P<quarter_year>{_YEAR})|\b(?P<year>{_YEAR})\b"
)


def dates(text: str) -> list[tuple[int, int, int, bool]]:
    """Distinct (year, month, day, whether the day is known) in order of appearance."""
    out: list[tuple[int, int, int, bool]] = []
    for m in _DATE.finditer(text):
        if m["iso"]:
            p = [int(x) for x in m["iso"].split("-")]
            d = (p[0], p[1], p[2] if len(p) > 2 else 1, len(p) > 2)
        elif m["month"]:
            d = (int(m["month_year"]), _MONTHS.get(m["month"].lower(), 1), 1, False)
        elif m["quarter"]:
            d = (int(m["quarter_year"]), 3 * int(m["quarter"]) - 2, 1, False)
        else:
            d = (int(m["year"]), 1, 1, False)
        if 1900 <= d[0] <= 2100 and d not in out:
            out.append(d)
    return out


def strip_diacritics(token: str) -> str:
    return token if token.isascii() else "".join(c for c in unicodedata.normalize("NFKD", token) if not unicodedata.combining(c))


# --- Porter's stemmer (1980)

_VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    if w[i] in _VOWELS:
        return False
    return w[i] != "y" or i == 0 or not _consonant(w, i - 1)


def _measure(stem: str) -> int:
    kinds = [_consonant(stem, i) for i in range(len(stem))]
    return sum(1 for a, b in zip(kinds, kinds[1:]) if not a and b)


def _vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


def _longest_first(rules: str) -> list[list[str]]:
    return sorted((x.split(":") for x in rules.split()), key=lambda r: -len(r[0]))


_STEP2 = _longest_first("ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble")
_STEP3 = _longest_first("icate:ic ative: alize:al iciti:ic ical:ic ful: ness:")
_STEP4 = sorted("al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize".split(), key=len, reverse=True)


def _swap(w: str, rules: list[list[str]]) -> str:
    for old, new in rules:
        if w.endswith(old):
            stem = w[: -len(old)]
            return stem + new if _measure(stem) > 0 else w
    return w


def stem(w: str) -> str:
    """Porter's stem of a lower-case ASCII word; other tokens stay as they are."""
    if len(w) < 3 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else None
        if cut is not None and _vowel(cut):
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _STEP2), _STEP3)
    for end in _STEP4:
        if w.endswith(end):
            root = w[: -3 if end in ("sion", "tion") else -len(end)]
            if _measure(root) > 1:
                w = root
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def index_term(token: str) -> str:
    """A token as the full-text index holds it: without diacritics, stemmed."""
    return stem(strip_diacritics(token))


def windows(items: list, size: int) -> Iterator[list]:
    for i in range(len(items) - size + 1):
        yield items[i : i + size]
