"""Secret scans with a trigram index.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must
hold. Each batch of texts is a shard of an inverted index (trigram -> ascending text numbers, for the
trigrams that some rule asks for); a rule's query intersects and unites postings, and only the texts
that it leaves are verified with the expression itself. A rule without mandatory trigrams is run over
every text. The index is on ASCII-folded bytes, so that rules that ignore case can use it as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from re import _constants as K
from re import _parser as sre

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm.common import FOLD, buffers, map_batches, table

#: A private key: the body and the END line (five dashes end a body, so two keys are never one), or where END
#: is missing the header fields and the run of base64 lines. Line ends may be escaped.
_GAP = r"(?:[ \t\r\n]|\\[nr])"
_KEY_BODY = rf"(?:(?:-{{0,4}}[^-])*-----END [A-Z ]*PRIVATE KEY-----|(?:{_GAP}*(?:Proc-Type|DEK-Info):[^\r\n\\]*)*(?:(?:{_GAP}*[0-9A-Za-z+/=]{{16,}})+(?:(?:[\r\n]|\\[nr])+[ \t]*[0-9A-Za-z+/]+={{0,2}})?)?)"

#: name, expression. ASCII classes and no look-around, so that RE2 takes them as well.
RULES: list[tuple[str, str]] = [
    ("aws_access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("bearer_jwt", r"\beyJ[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}"),
    ("github_token", r"\bgh[opsu]_[0-9A-Za-z]{36}\b"),
    ("google_api_key", r"\bAIza[0-9A-Za-z_-]{35}"),
    ("hex_40", r"\b[0-9a-f]{40}\b"),
    ("named_secret", r"""(?i)\b(?:token|secret|passwd|password|api_?key|access_key)["' ]{0,3}[:=]{1,2}["' ]{0,3}[0-9a-z_+/-]{12,}"""),
    ("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----" + _KEY_BODY),
    ("slack_token", r"\bxox[abeprs]-[0-9A-Za-z-]{10,}"),
    ("stripe_key", r"\b[rs]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    ("url_credentials", r"\b[a-z]{3,}://[0-9A-Za-z._~-]{1,}:[0-9A-Za-z._~!$&*+=-]{3,}@[0-9A-Za-z.-]{1,}"),
]

# --- Boolean trigram queries ----------------------------------------------------------------------
# A query is True (every text), ("tri", t), ("and", {...}) or ("or", {...}).

#: Larger sets of exact strings, prefixes or suffixes are turned into a query and forgotten.
MOST_STRINGS, MOST_CLASS = 16, 8


def _and(*queries):
    parts = set()
    for q in queries:
        if q is True:
            continue
        parts |= q[1] if q[0] == "and" else {q}
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def _or(*queries):
    if any(q is True for q in queries):
        return True
    parts = set()
    for q in queries:
        parts |= q[1] if q[0] == "or" else {q}
    return next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def _trigrams_of(strings: Iterable[bytes]):
    """What a text that holds one of the strings must hold."""
    return _or(*[_and(*[("tri", s[i : i + 3]) for i in range(len(s) - 2)]) for s in strings])


class Info:
    """What is known of an expression: its strings if they are few (exact), else the strings that a
    match begins and ends with, and a query that a text with a match meets."""

    def __init__(self, exact=None, prefix=frozenset([b""]), suffix=frozenset([b""]), match=True):
        self.exact, self.prefix, self.suffix, self.match = exact, prefix, suffix, match

    def loose(self) -> Info:
        if self.exact is None:
            return self
        return Info(None, frozenset(self.exact), frozenset(self.exact), _trigrams_of(self.exact))

    def trimmed(self) -> Info:
        if self.exact is not None and (len(self.exact) > MOST_STRINGS or max(map(len, self.exact), default=0) > 40):
            return self.loose().trimmed()
        if self.exact is None:
            self.prefix = _few({x[:2] for x in self.prefix}, -1)
            self.suffix = _few({x[-2:] for x in self.suffix}, 1)
        return self


def _few(strings: set[bytes], cut: int) -> frozenset[bytes]:
    while len(strings) > MOST_STRINGS:
        strings = {x[:cut] if cut < 0 else x[cut:] for x in strings}
    return frozenset(strings)


def _cross(a: Info, b: Info) -> Info:
    if a.exact is not None and b.exact is not None:
        return Info(frozenset(x + y for x in a.exact for y in b.exact)).trimmed()
    x, y = a.loose(), b.loose()
    between = _trigrams_of({s + p for s in x.suffix for p in y.prefix})
    prefix = frozenset(s + p for s in a.exact for p in y.prefix) if a.exact is not None else x.prefix
    suffix = frozenset(s + p for s in x.suffix for p in b.exact) if b.exact is not None else y.suffix
    return Info(None, prefix, suffix, _and(x.match, y.match, between)).trimmed()


def _union(infos: list[Info]) -> Info:
    if all(i.exact is not None for i in infos):
        return Info(frozenset().union(*[i.exact for i in infos])).trimmed()
    loose = [i.loose() for i in infos]
    return Info(None, frozenset().union(*[i.prefix for i in loose]), frozenset().union(*[i.suffix for i in loose]), _or(*[i.match for i in loose])).trimmed()


def _fold(code: int) -> bytes:
    return chr(code).lower().encode() if code < 128 else chr(code).encode()


def _info(node, flags: int = 0) -> Info:
    out = Info(frozenset([b""]))
    for op, arg in node:
        if op is K.LITERAL:
            # A non-ASCII letter may match in another case; nothing is asked for then.
            now = Info() if arg >= 128 else Info(frozenset([_fold(arg)]))
        elif op is K.IN:
            now = _class(arg)
        elif op is K.SUBPATTERN:
            now = _info(arg[-1])
        elif op is K.BRANCH:
            now = _union([_info(x) for x in arg[1]])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            low, high, inner = arg
            one = _info(inner)
            if high == 1:
                now = one if low else _union([Info(frozenset([b""])), one])
            elif low:
                now = one
                for _ in range(min(low, 3) - 1):
                    now = _cross(now, one)
                if low != high or low > 3:
                    # More copies may stand between the first ones and the last one.
                    now = _cross(_cross(now, Info()), one)
            else:
                now = Info()
        elif op is K.AT:
            now = Info(frozenset([b""]))
        elif op in (K.ASSERT, K.ASSERT_NOT):
            now = Info(frozenset([b""]))
        elif op is K.ATOMIC_GROUP:
            now = _info(arg)
        else:
            now = Info()
        out = _cross(out, now)
    return out


def _class(items) -> Info:
    found: set[bytes] = set()
    for op, arg in items:
        if op is K.LITERAL and arg < 128:
            found.add(_fold(arg))
        elif op is K.RANGE and arg[1] < 128 and arg[1] - arg[0] < 4 * MOST_CLASS:
            found |= {_fold(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return Info()
    return Info(frozenset(found)) if len(found) <= MOST_CLASS else Info()


def trigram_query(pattern: str):
    """The Boolean query that each text with a match of `pattern` meets; True if it asks for nothing."""
    return _info(sre.parse(pattern)).loose().match


def trigrams(query) -> set[bytes]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*[trigrams(q) for q in query[1]])


# --- the index of one shard -----------------------------------------------------------------------


class Scanner:
    """Rules with their queries; built once in each Python worker."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = [(name, re.compile(p, re.ASCII), trigram_query(p)) for name, p in rules]
        self.wanted = sorted(set().union(*[trigrams(q) for _, _, q in self.rules]))
        self.number = {t: i for i, t in enumerate(self.wanted)}
        self.slot = np.zeros(1 << 24, np.uint16)
        for t, i in self.number.items():
            self.slot[t[0] | t[1] << 8 | t[2] << 16] = i + 1

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> dict[bytes, np.ndarray]:
        """For each wanted trigram the ascending numbers of the texts that hold it."""
        if len(data) < 3:
            return {}
        s = FOLD[data].astype(np.uint32)
        slot = self.slot[s[:-2] | s[1:-1] << 8 | s[2:] << 16]
        at = np.flatnonzero(slot)
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[text + 1]
        key = np.unique(slot[at[inside]].astype(np.int64) << 32 | text[inside])
        cut = np.searchsorted(key >> 32, np.arange(1, len(self.wanted) + 2))
        return {t: key[cut[i] : cut[i + 1]] & 0xFFFFFFFF for i, t in enumerate(self.wanted)}

    def candidates(self, query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
        if query is True:
            return np.arange(n)
        if query[0] == "tri":
            return postings.get(query[1], np.zeros(0, np.int64))
        lists = [self.candidates(q, postings, n) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(lists))
        lists.sort(key=len)
        out = lists[0]
        for x in lists[1:]:
            if not len(out):
                break
            out = np.intersect1d(out, x, assume_unique=True)
        return out

    def scan(self, col: pa.Array) -> list[tuple[int, str, int, int]]:
        """(text number, rule, start, end) of all matches; positions count characters."""
        data, offsets = buffers(col)
        n = len(offsets) - 1
        postings = self.postings(data, offsets)
        raw, decoded, found = data.tobytes(), {}, []
        for name, pattern, query in self.rules:
            for i in self.candidates(query, postings, n).tolist():
                if i not in decoded:
                    decoded[i] = raw[offsets[i] : offsets[i + 1]].decode()
                found += [(i, name, m.start(), m.end()) for m in pattern.finditer(decoded[i])]
        return found


_scanners: dict[tuple, Scanner] = {}


def scanner(rules: list[tuple[str, str]]) -> Scanner:
    key = tuple(rules)
    if key not in _scanners:
        _scanners[key] = Scanner(rules)
    return _scanners[key]


def secrets(docs: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(doc_id, rule, start, stop): each match of each rule; start counts characters from 0, stop is exclusive.

    Matches of one rule don't overlap; those of several rules may. Null and empty texts have none; a
    null doc_id stays null; repeated rows give repeated results; an empty table gives an empty result. Whole texts
    are searched, however long. Other columns than doc_id and text are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = scanner(rules).scan(batch.column("text"))
        ids = batch.column("doc_id").cast(pa.int64()).take(pa.array([x[0] for x in found], pa.int64()))
        return pa.RecordBatch.from_arrays([ids, pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.int64())], ["doc_id", "rule", "start", "stop"])

    return map_batches(docs, ["doc_id", "text"], run, "doc_id long, rule string, start long, stop long", "text")


def redact(docs: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """`docs` with each secret replaced by [SECRET]; overlapping matches are replaced as one.

    Where a text changes and there is a column n_chars, it gets the new length. All rows and all other
    values stay, null and empty texts, null ids and repeated rows included, and columns of any names. An empty table
    stays empty.
    """
    counted = "n_chars" in docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans: dict[int, list[tuple[int, int]]] = {}
        for i, _, a, b in scanner(rules).scan(batch.column("text")):
            spans.setdefault(i, []).append((a, b))
        if not spans:
            return batch
        k = batch.schema.get_field_index("text")
        text = batch.column(k).to_pylist()
        changed = {i: _without(text[i], sorted(x)) for i, x in spans.items()}
        arrays = list(batch.columns)
        arrays[k] = pa.array([changed.get(i, t) for i, t in enumerate(text)], batch.schema.field(k).type)
        if counted:
            c = batch.schema.get_field_index("n_chars")
            lengths = batch.column(c).to_pylist()
            arrays[c] = pa.array([len(changed[i]) if i in changed else x for i, x in enumerate(lengths)], batch.schema.field(c).type)
        return pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return map_batches(docs, docs.columns, run, docs.schema, "text")


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], "[SECRET]"]
        at = b
    return "".join([*out, text[at:]])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`secrets` over the whole table `documents`, all RULES; no shuffle."""
    return secrets(table(spark, sf_dir, "documents"))


def _rule_sql(name: str, pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"""
      SELECT doc_id, '{name}' AS rule, unnest(list_transform(range(1, len(m) + 1), lambda i: coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda g: length(g))), 0)))::BIGINT AS start, unnest(m) AS hit
      FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS gaps FROM documents WHERE regexp_matches(text, '{p}'))"""


OP1_SQL = "SELECT doc_id, rule, start, start + length(hit) AS stop FROM (" + " UNION ALL ".join(_rule_sql(name, p) for name, p in RULES) + ")"
