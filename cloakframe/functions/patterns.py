"""The sixteen span patterns as data, in the order in which they claim text.

A pattern has an expression, the places where a match can start, the group that is the span (0: the
whole match), and a check of the matched text. Most matches start at or just before a run of digits, so a text is searched
for those once; the expressions are only tried where they can match, and long texts take linear time.
"""

from __future__ import annotations

import calendar
import heapq
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from cloakframe.functions.checksums import is_aba, is_luhn

STREET_WORDS = (
    "alley ave avenue blvd boulevard chase cir circle close court cres crescent ct dr drive freeway fwy garden gardens gate glen green "
    "grove heath highway hill hwy lane ln loop meadow mews mount park parkway pass pkwy pl place plaza rd ridge rise road row sq square "
    "st street terr terrace trail trl vale view walk way"
).split()
#: Names and abbreviations of the months, as alternatives of an expression.
MONTH_WORDS = sorted({*calendar.month_name[1:], *calendar.month_abbr[1:]}, key=lambda m: (-len(m), m))
MONTHS = "|".join(MONTH_WORDS)

_YEAR_FIRST = r"(?:19|20)\d\d-(?:1[0-2]|0[1-9])-(?:3[01]|[12]\d|0[1-9])"
_NUMERIC = r"\d{1,2}[-/.]\d{1,2}[-/.]\d{4}"
_DAY_MONTH = rf"\d{{1,2}}[-\s,]+(?:{MONTHS})[-\s,]+\d{{4}}"
_MONTH_DAY = rf"(?:{MONTHS})[\s,]+\d{{1,2}}[\s,]+\d{{4}}"
_OCTET = r"(?:2[0-4]\d|25[0-5]|1\d\d|[01]?\d\d?)"
_KEY = "[-0-9A-Z_a-z]"
KEY_PREFIXES = ("sk-", "sk_", "ghp_", "gho_", "ant-api-", "AIzaSy", "AKIA")
_PREFIXES = rf"(?:{'|'.join(KEY_PREFIXES)})"


_EDGE_ASCII = r"(?-i:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def ascii_words(regex: str) -> str:
    r"""The expression with \b, \d and \s of ASCII alone, as RE2 (and so SQL) has them, for Python and Java."""
    out, inside = [], False
    for x in re.findall(r"\\.|.", regex, re.DOTALL):
        own = {r"\d": "0-9", r"\s": r"\t\n\f\r "}.get(x)
        out.append(_EDGE_ASCII if x == r"\b" else x if own is None else own if inside else f"[{own}]")
        inside = x == "[" or inside and x != "]"
    return "".join(out)


class Text:
    """A text with what several patterns ask of it: its runs of digits, and its lower case of the same length.

    `ascii`: words and digits are those of ASCII, see `ascii_words`.
    """

    def __init__(self, text: str, ascii: bool = False):
        self.text, self.ascii = text, ascii
        #: Where the last match of the pattern at work ended.
        self.end = 0
        self.runs = [m.span() for m in re.finditer("[0-9]+" if ascii else r"\d+", text)]
        low = text.lower()
        self.low = low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)

    def char(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""


Places = Callable[[Text], Iterator[int]]


def _runs(*lengths: int, after: str = "", before: str = "") -> Places:
    """Starts of runs of digits with one of `lengths`, and the places of characters in `before` that stand before them.

    `after`: what must follow a run, "." and the like (" " stands for any blank).
    """

    def places(t: Text) -> Iterator[int]:
        for a, b in t.runs:
            if (not lengths or b - a in lengths) and (not after or (c := t.char(b)) and (c in after or " " in after and c.isspace())):
                if before and a and t.text[a - 1] in before:
                    yield a - 1
                yield a

    return places


def _dates(t: Text) -> Iterator[int]:
    for a, b in t.runs:
        if b - a > 4:
            continue
        if b - a <= 2:
            i = a
            while i and (t.text[i - 1] == "," or t.text[i - 1].isspace()):
                i -= 1
            word = t.low[max(0, i - 9) : i]
            if i < a:
                yield from sorted({i - len(m) for m in MONTH_WORDS if word.endswith(m.lower())})
        yield a


def _postcodes(t: Text) -> Iterator[int]:
    for a, _ in t.runs:
        if a and t.text[a - 1].isalpha():
            if a > 1 and t.text[a - 2].isalpha():
                yield a - 2
            yield a - 1


def _wallets(t: Text) -> Iterator[int]:
    for a, _ in t.runs:
        if t.text.startswith("bc", max(0, a - 2)) and a > 1:
            yield a - 2
        yield a


_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789%+._-\u017f\u212a"
_EDGES = {False: re.compile(r"\b"), True: re.compile(_EDGE_ASCII)}


def _emails(t: Text) -> Iterator[int]:
    """The first word edge of what can be a user name before each @; the rest of a match doesn't depend on its start."""
    at, last = t.text.find("@"), 0
    while at >= 0:
        low = max(last, t.end)
        start = low + len(t.text[low:at].rstrip(_LOCAL))
        if start < at and (m := _EDGES[t.ascii].search(t.text, start, at)) and m.start() < at:
            yield m.start()
        last, at = at + 1, t.text.find("@", at + 1)


_UPPER = re.compile("[A-Z]")
_NAME = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"


def _keys(t: Text) -> Iterator[int]:
    """Places of the prefixes, and the names before "=" and a prefix; a name may be cut where the last match ended."""
    found: set[tuple[int, int]] = set()
    for word in (*KEY_PREFIXES, "Bearer"):
        i = t.text.find(word)
        while i >= 0:
            found.add((i, i))
            i = t.text.find(word, i + 1)
    if not found:
        return
    for i, _ in sorted(found):
        if t.char(i - 1) == "=":
            low = t.text.rfind("=", 0, i - 1) + 1
            if m := _UPPER.search(t.text, low + len(t.text[low : i - 1].rstrip(_NAME)), i - 1):
                found.add((m.start(), i - 1))
    heap = sorted(found)
    while heap:
        start, stop = heapq.heappop(heap)
        if start >= t.end:
            yield start
        elif m := _UPPER.search(t.text, t.end, stop) if t.end < stop else None:
            heapq.heappush(heap, (m.start(), stop))


_SELF = re.compile(r"i(?:\s+a|')m\s")


def _genders(t: Text) -> Iterator[int]:
    found = set()
    for word in ("gender", "sex", "they/them", "she/her", "he/him"):
        i = t.low.find(word)
        while i >= 0:
            found.add(i)
            i = t.low.find(word, i + 1)
    found.update(m.start() for m in _SELF.finditer(t.low))
    return iter(sorted(found))


_LICENCE = re.compile(r"driver|licen[cs]e|dl(?![0-9a-z_])|d\.l\.")


def _licences(t: Text) -> Iterator[int]:
    return (m.start() for m in _LICENCE.finditer(t.low))


@dataclass(frozen=True)
class Pattern:
    type: str
    regex: str
    places: Places
    group: int = 0
    check: Callable[[str], bool] | None = None
    ascii: bool = False
    match: Callable[[str, int], re.Match | None] = field(init=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "match", re.compile(ascii_words(self.regex) if self.ascii else self.regex).match)

    def matches(self, t: Text) -> Iterator[re.Match]:
        """All matches that don't overlap, from the left: what a search through the whole text finds."""
        t.end = 0
        for i in self.places(t):
            if i >= t.end and (m := self.match(t.text, i)):
                t.end = m.end()
                yield m


PATTERNS: tuple[Pattern, ...] = (
    Pattern("address", rf"(?i:\b\d+\s+(?:[a-z]+\s+){{0,4}}(?:{'|'.join(STREET_WORDS)})\.?\b)", _runs(after=" ")),
    Pattern("ssn", r"\b\d{3}[- ]\d{2}[- ]\d{4}\b|\b\d{9}\b", _runs(3, 9), check=lambda m: "-" in m or " " in m or not is_aba(m)),
    Pattern("email", r"(?i:\b[a-z0-9%+._-]+@[a-z0-9.-]+\.[a-z]{2,}\b)", _emails),
    Pattern("phone_us", r"(?<!\d)(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}(?!\d)", _runs(1, 3, 4, 6, 7, 10, 11, before="(+")),
    Pattern("phone_uk", r"(?<!\d)(?:0|\+44\s?)(?:\d{4}[-\s]?\d{6}|\d{3}[-\s]?\d{3}[-\s]?\d{4}|\d{2}[-\s]?\d{4}[-\s]?\d{4})(?!\d)", _runs(before="+")),
    Pattern("phone_intl", r"(?<!\d)\+(?!44[-. ]|1[-. ])[1-9]\d{0,2}[-. ]\d{3,6}[-. ]\d{3,8}(?:[-. ]\d{2,6})?(?!\d)", _runs(1, 2, 3, after="-. ", before="+")),
    Pattern("credit_card", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", _runs(4, 8, 12, 16), check=lambda m: is_luhn("".join(c for c in m if c != "-" and not c.isspace()))),
    Pattern("dob", rf"(?i:\b(?:{_YEAR_FIRST}|{_NUMERIC}|{_DAY_MONTH}|{_MONTH_DAY})\b)", _dates),
    Pattern("ip_address", rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b", _runs(1, 2, 3, after=".")),
    Pattern("api_key", rf"sk[-_]{_KEY}{{16,}}|ant-api-{_KEY}{{16,}}|Bearer\s+{_KEY}{{16,}}|gh[po]_[A-Za-z0-9]{{20,}}|AKIA[A-Z0-9]{{16}}|AIzaSy{_KEY}{{10,}}|[A-Z][_A-Z0-9]*={_PREFIXES}{_KEY}{{12,}}", _keys),
    Pattern("gender_indicator", r"(?i:\b(?:(?:sex|gender)\s*[=:]\s*(?:female|male|f|m|woman|man|girl|boy|nb|non-binary)|i(?:\s+a|')m\s+a\s+(?:female|male|woman|man|girl|boy)|they/them|she/her|he/him)\b)", _genders),
    Pattern("postcode_uk", r"(?i:\b[a-z]{1,2}\d[a-z\d]?\s*\d[a-z]{2}\b)", _postcodes),
    Pattern("crypto", r"\b[13][1-9A-HJ-NP-Za-km-z]{25,36}\b|\bbc1[02-9ac-hj-np-z]{6,87}\b|\b0x[A-Fa-f0-9]{40}\b", _wallets),
    Pattern("us_bank_number", r"(?<!\d)\d{9}(?!\d)", _runs(9), check=lambda m: is_aba(m)),
    Pattern(
        "us_driver_license",
        r"(?i:(?:driver'?s?\s+licen[cs]e(?:\s+(?:no|num|number|#))?|licen[cs]e\s*(?:num|number|no|#)|\bdl\b|\bd\.l\.\b)[-#:\s]*(?:(?:was|is)\s+)?(?-i:([0-9A-Z]{5,20}))\b)",
        _licences,
        group=1,
    ),
    Pattern("zip_us", r"\b\d{5}(?:-\d{4})?\b", _runs(5)),
)

BY_TYPE = {p.type: p for p in PATTERNS}
#: The same with words and digits of ASCII: what SQL finds.
ASCII_PATTERNS = tuple(replace(p, ascii=True) for p in PATTERNS)
