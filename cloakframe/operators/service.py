"""Requests for services and facts: texts whose places are what is asked for, not who asks."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions.patterns import STREET_WORDS, ascii_words
from cloakframe.functions.spans import let, replace_pairs
from cloakframe.schema import PAIRS

#: Topics that are never treated as a request. Plain substrings, as they stand.
SENSITIVE = (
    "abortion addiction aids counsel detox hiv homeless immigration overdose psychiatr rehab shelter std sti suicide therapist therapy undocumented".split()
    + ["domestic violence", "eating disorder", "mental health", "self.harm", "substance abuse"]
)
_CLOSE = "near|close|around"


def _chain(first: str, gap: int, then: str, gap2: int = -1, last: str = "") -> str:
    """One of `first`, then one of `then` within `gap` characters, then one of `last` within `gap2`."""
    return f"(?:{first}).{{0,{gap}}}(?:{then})" + (f".{{0,{gap2}}}(?:{last})" if gap2 >= 0 else "")


SERVICE = [
    _chain("any|best|find|get|good|locate|recommend|show|suggest", 60, "bistro|breakfast|brunch|cafe|coffee|diner|dinner|eatery|food|lunch|place|restaurant|spot", 40, f"by|in|{_CLOSE}"),
    _chain("any|what|where|which", 50, "near|around|close to|in the area"),
    _chain("best|closest|good|nearest|open|popular|top", 40, f"by|to|{_CLOSE}"),
    _chain("are there any|is there a?|find (?:a|me|some|the)", 60, f"by|in|{_CLOSE}"),
    _chain("directions?", 25, "from|to"),
    _chain("how (?:can i|do i|to) get|navigate|route", 25, "from|to"),
    _chain("forecast|humidity|rain|snow|temperature|weather", 25, "at|for|in|near"),
    _chain("what.{0,15}(?:close|closed|hours|open)|is.{0,5}(?:closed|open)", 40, "in|near"),
    _chain("activities?|areas?|places?|spots?|things? to do", 25, "around|in|near"),
    _chain("atm|charging station|fuel|gas station|parking|petrol", 40, _CLOSE),
    _chain("chemist|clinic|doctor|hospital|pharmacy|urgent care", 40, f"in|{_CLOSE}"),
    _chain("grocery|mall|market|shop|store|supermarket", 40, f"in|{_CLOSE}"),
    _chain("check (?:if|whether)", 60, f"in|{_CLOSE}"),
]
SERVICE_REGEX = "(?i)" + "|".join(f"(?:{x})" for x in SERVICE)
SENSITIVE_REGEX = "(?i)" + "|".join(SENSITIVE)

_STREET = "|".join(w for w in STREET_WORDS if w not in ("alley", "chase", "garden", "gardens", "gate", "glen", "green", "grove", "heath", "hill", "meadow", "mount", "park", "pkwy", "ridge", "rise", "vale", "view", "walk"))
ADDRESS = rf"(?i)\b(\d+)\s+([a-z0-9 ]+?(?:{_STREET}|pkwy)\.?)(?:\s*,\s*([a-z][a-z\s]{{1,30}}?))?(?:\s*,\s*([a-z]{{2}}))?\b"


#: Each expression with the plain words of which a match holds one; none where an expression has other than plain words there.
_GATED = [(re.compile(f"(?i){x}"), re.compile(x), [g for g in (m.split("|") for m in re.findall(r"\(\?:([^()]*)\)", x)) if all(re.fullmatch("[a-z ]+", w) for w in g)]) for x in SERVICE]
_SENSITIVE = re.compile(SENSITIVE_REGEX)
#: Letters that an expression takes for others in either case, and `lower` doesn't.
_FOLDED = re.compile("[\u0130\u0131\u017f\u212a]")


def asks_for_service(text: str | None) -> bool:
    """`is_service_query` of one text: the expressions are tried where the text has their words."""
    if not text:
        return False
    low = text.lower()
    odd = not text.isascii() and _FOLDED.search(text)
    for regex, lower, groups in _GATED:
        # Without regard to case the start of a match can't be looked for quickly.
        if all(any(w in low for w in g) for g in groups) and (regex.search(text) if odd else lower.search(low)):
            return not _SENSITIVE.search(text)
    return False


def is_service_query(text: Column) -> Column:
    """Whether a text asks for a service and touches no sensitive topic; a null text doesn't."""
    whole = F.coalesce(text, F.lit(""))
    return ~whole.rlike(SENSITIVE_REGEX) & whole.rlike(SERVICE_REGEX)


def address_pairs(text: Column, seed: Column, ascii: bool = False) -> Column:
    """Addresses of a text, each with the one next door: the house number goes up or down by 1, not below 1.

    The direction comes from a hash of seed and address, so the same address moves the same way. `ascii`: words end at letters that
    aren't ASCII, as in SQL.
    """
    g = lambda k: F.regexp_extract_all(text, F.lit(_ADDRESS_ASCII if ascii else ADDRESS), F.lit(k))

    def pair(z: Column) -> Column:
        up = F.conv(F.substring(F.md5(F.concat(seed, F.lit("|"), z["whole"])), 1, 1), 16, 10).cast("int") % 2 * 2 - 1
        size, end = F.length(z["number"]), F.substring(z["number"], -1, 1).cast("int")
        # A number too long to count with moves by its last digit, without a carry.
        long = F.concat(F.substring(z["number"], F.lit(1), size - 1), (end + F.when(end == 0, 1).when(end == 9, -1).otherwise(up)).cast("string"))
        number = F.when(size < 30, F.greatest(F.lit(1), z["number"].try_cast("decimal(38,0)") + up).cast("string")).otherwise(long)
        tail = lambda x: F.when(F.length(F.trim(x)) > 0, F.concat(F.lit(", "), F.trim(x))).otherwise("")
        return F.struct(F.trim(z["whole"]).alias("original"), F.concat(number, F.lit(" "), F.trim(z["street"]), tail(z["city"]), tail(z["state"])).alias("surrogate"))

    rows = F.arrays_zip(*[g(k).alias(n) for k, n in enumerate(("whole", "number", "street", "city", "state"))])
    found = F.array_distinct(F.transform(rows, pair))
    return F.when(text.rlike(r"\d\s+[A-Za-z0-9]"), found).otherwise(F.array()).cast(PAIRS)


_ADDRESS = re.compile(ADDRESS)
# Java folds the cases of ASCII alone without "u", SQL those of Unicode (long s, Kelvin sign).
_ADDRESS_ASCII = ascii_words(ADDRESS.replace("(?i)", "(?iu)", 1))


def moved_addresses(text: str, seed: str) -> dict[str, str]:
    """`address_pairs` of one text."""
    out = {}
    for m in _ADDRESS.finditer(text):
        up = int(hashlib.md5(f"{seed}|{m[0]}".encode()).hexdigest()[0], 16) % 2 * 2 - 1
        end = int(m[1][-1])
        number = str(max(1, int(m[1]) + up)) if len(m[1]) < 30 else m[1][:-1] + str(end + (1 if end == 0 else -1 if end == 9 else up))
        out[m[0].strip()] = ", ".join([f"{number} {m[2].strip()}", *(x.strip() for x in (m[3], m[4]) if x and x.strip())])
    return out


def fuzz_addresses(text: Column, seed: Column) -> Column:
    """struct<text, pairs>: the text with each address moved next door, longest address first."""
    return let(address_pairs(text, seed), lambda p: F.struct(replace_pairs(text, p).alias("text"), p.alias("pairs")))
