"""Corrections of what the stages found: structural organisations, names behind addresses, parts of names, places as topics."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions.spanlist import Claimed, Entity

ORG_KINDS = "associates|company|corp|corporation|enterprise|firm|group|holdings|inc|llc|ltd|organisation|organization|solutions|ventures"
_NAME = r"[A-Za-z]+(?:\s+[A-Za-z]+){0,3}?"
STRUCTURAL = rf"(?i)\b(?:an|a|the)\s+({_NAME})\s+(?:{ORG_KINDS})\b"
CONJUNCTIONS = "although|and|because|but|despite|however|nevertheless|or|since|so|therefore|though|unless|when|whereas|while|yet"
CLAUSE_END = rf"(?i)[.!?]+\s+|\s+(?:{CONJUNCTIONS})\s+|,\s+"
_ASKING = {
    "what": "are|can|did|do|does|is|was|were|would", "how": "can|did|do|does|many|much|to|would", "which": "are|is|was|were|would", "where": "are|can|do|is|should|would",
    "when": "are|can|did|do|does|is|was|were", "who": "are|can|do|does|is|was|were|would", "why": "are|did|do|does|is|should|was|were|would",
    "give|tell|show|find|help|get": "me", "look": "up|for", "search": "for", "is|are": "there",
    "i": r"(?:want|need|would\s+like|'d\s+like)\s+(?:to\s+(?:find|know|learn|understand)|advice|details|help|information)",
}
_FRAMES = "|".join([*(rf"(?:{a})\s+(?:{b})" for a, b in _ASKING.items()), "advise|compare|describe|explain|list|recommend|suggest|summari[sz]e"])
QUERY_FRAME = rf"(?i)^\s*(?:please\s+|(?:can|could|would)\s+you\s+(?:please\s+)?)?(?:{_FRAMES})"

_FRAME, _END, _STRUCTURAL = re.compile(QUERY_FRAME), re.compile(CLAUSE_END), re.compile(STRUCTURAL)
#: Places whose names may be topics.
TOPICS = ("GPE", "LOC")


def structural_orgs(text: str, existing: list[Entity]) -> list[Entity]:
    """Pass A. Names before words such as "corporation", unless they meet an entity or one another."""
    out: list[Entity] = []
    low = text.lower()
    if not any(kind in low for kind in ORG_KINDS.split("|")):
        return out
    taken = Claimed(existing)
    for m in _STRUCTURAL.finditer(text):
        if taken.free(m.start(1), m.end(1)):
            taken.add(m.start(1), m.end(1))
            out.append(Entity(m[1].strip(), m.start(1), m.end(1), "ORG", 0.90, "pattern"))
    return out


def names_behind_addresses(entities: list[Entity]) -> list[Entity]:
    """Pass B. An organisation that some email's user name starts with is a person."""
    users = {name.lower() for kind, (name, at, _) in ((e.type, e.text.partition("@")) for e in entities) if at and kind == "email"}
    person = lambda e: e.type == "ORG" and len(e.text) >= 3 and any(u.startswith(e.text.lower()) for u in users)
    return [e._replace(type="PERSON", score=0.88) if users and person(e) else e for e in entities]


def without_parts_of_names(entities: list[Entity]) -> list[Entity]:
    """Pass C. A person all of whose words are in another person's goes; persons come last.

    Only names that share a word are compared, so many persons don't take quadratic time.
    """
    others: list[Entity] = []
    persons: list[Entity] = []
    for e in entities:
        (persons if e.type == "PERSON" else others).append(e)
    words = {e.text: frozenset(e.text.split()) for e in persons}
    having: dict[str, set[str]] = {}
    for name, own in words.items():
        for w in own:
            having.setdefault(w, set()).add(name)
    gone = {name for name, own in words.items() if own and set.intersection(*[having[w] for w in own]) - {name}}
    return others + [e for e in persons if e.text not in gone]


def clause_list(text: str) -> list[str]:
    return [c.strip() for c in _END.split(text) if c.strip()]


def clauses(text: Column) -> Column:
    """The text's clauses, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, CLAUSE_END), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), lambda c: c != "")


def is_query_frame(clause: Column) -> Column:
    return clause.rlike(QUERY_FRAME)


def is_proper(name: str, text: str) -> bool:
    """Capitalised, or at a sentence's start, or not in the text at all."""
    if name[:1].isupper():
        return True
    at = text.find(name)
    at = text.lower().find(name.lower()) if at < 0 else at
    before = text[: max(at, 0)].rstrip()
    return at < 0 or not before or before[-1] in ".!?;"


def without_topics(entities: list[Entity], text: str) -> tuple[list[Entity], list[Entity]]:
    """Pass D. (kept, skipped): places that only clauses with a question name are what it is about; those in
    lower case within a sentence are common words. Kept places come last."""
    places = [e for e in entities if e.type in TOPICS]
    if not places:
        return entities, []
    marked = [(c.lower(), bool(_FRAME.match(c))) for c in clause_list(text)]
    asked, told = "\0".join(c for c, asks in marked if asks), "\0".join(c for c, asks in marked if not asks)
    topic = lambda e: not is_proper(e.text, text) or e.text.lower() in asked and e.text.lower() not in told
    skipped = [e for e in places if topic(e)]
    return [e for e in entities if e.type not in TOPICS] + [e for e in places if e not in skipped], skipped
