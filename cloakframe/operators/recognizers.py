"""Named entities: a recogniser interface, a native one from lists, shapes and contexts, and the two stages that use it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

from cloakframe.config import EngineConfig
from cloakframe.functions.spanlist import MARK, Claimed, Entity

#: Scores by label, for recognisers that give none.
LABEL_SCORES = {"FAC": 0.70, "LOC": 0.74, "GPE": 0.85, "ORG": 0.85, "PERSON": 0.88}
#: Words for fields, titles, months, weekdays and time zones: never an entity by themselves.
BLOCKED = frozenset("address am apr aug bic cvc cvv dec dob dr email est expiry fax feb fri gmt iban id jan jr jul jun mar mon mr mrs ms nov oct passport phone pin pm postcode prof pst sat sep sr ssn sun thu tue uid utc wed zip".split())
TITLES = frozenset("al capt col dame de dr el gen jr la le lord lt mr mrs ms prof professor rev sgt sir sr van von".split())
#: Words before a supposed organisation that make it a place.
PLACE_WORDS = frozenset("based birthplace born grew hometown in live lived lives moved near raised relocate relocated reside residing".split())
PLACES = frozenset(["FAC", "GPE", "LOC"])

FIRST_NAMES = frozenset(
    "Aaron Abigail Adam Ahmed Aisha Alan Albert Alejandro Alex Alexander Alice Amanda Amy Ana Andrea Andrew Angela Anita Ann Anna Anne Anthony Antonio Arjun Arthur Ashley Barbara Ben Benjamin Beth Brandon Brian Bruce Carl Carlos Carmen Carol Caroline Catherine Charles Charlotte Chen Chloe Chris Christian Christina "
    "Christine Christopher Claire Craig Cynthia Daniel David Deborah Denise Dennis Diana Diane Donald Donna Dorothy Douglas Dylan Edward Elena Elizabeth Ella Ellen Emily Emma Eric Ethan Eva Evelyn Fatima Fiona Frances Francisco Frank Gabriel Gary George Gerald Grace Greg Gregory Hannah Harold Harry Hassan Heather Helen Henry "
    "Howard Ian Isabella Isla Jack Jacob James Jamie Jane Janet Janice Jason Jean Jeffrey Jennifer Jeremy Jerry Jessica Jim Joan Joe John Jonathan Jordan Jorge Jose Joseph Joshua Joyce Juan Judith Judy Julia Julie Justin Karen Kate Katherine Kathleen Keith Kelly Kenneth Kevin Kim Kyle Larry Laura Lauren Lawrence Leo Liam Linda "
    "Lisa Lucas Lucy Luis Lynn Marcus Margaret Maria Marie Marilyn Mark Martha Martin Mary Matthew Megan Mei Melissa Michael Michelle Miguel Mike Mohammed Muhammad Nancy Natalie Nathan Nicholas Nicole Nina Noah Olivia Omar Oscar Pamela Patricia Patrick Paul Peter Philip Phillip Priya Rachel Rahul Raj Ralph Raymond Rebecca Richard "
    "Robert Robin Roger Ronald Rosa Rose Roy Russell Ruth Ryan Sam Samantha Samuel Sandra Sanjay Sara Sarah Scott Sean Sharon Shirley Simon Sofia Sophia Sophie Stephanie Stephen Steve Steven Susan Teresa Thomas Tim Timothy Tom Tyler Vanessa Victor Victoria Vincent Virginia Walter Wayne Wei William Yuki Zachary Zoe".split()
)
CITIES = "Amsterdam|Atlanta|Austin|Baltimore|Bangalore|Barcelona|Beijing|Berlin|Birmingham|Boston|Bristol|Brussels|Cambridge|Cardiff|Charlotte|Chicago|Cleveland|Copenhagen|Dallas|Delhi|Denver|Detroit|Dubai|Dublin|Edinburgh|Frankfurt|Geneva|Glasgow|Hamburg|Hong Kong|Houston|Istanbul|Leeds|Lisbon|Liverpool|London|Los Angeles|Madrid|Manchester|Melbourne|Mexico City|Miami|Milan|Minneapolis|Montreal|Moscow|Mumbai|Munich|Nashville|New Orleans|New York|New York City|Orlando|Oslo|Oxford|Paris|Philadelphia|Phoenix|Pittsburgh|Portland|Prague|Rome|Sacramento|San Antonio|San Diego|San Francisco|San Jose|Seattle|Shanghai|Singapore|Springfield|Stockholm|Sydney|Tampa|Tempe|Tokyo|Toronto|Tucson|Vancouver|Vienna|Warsaw|Zurich"
REGIONS = "Alabama|Alaska|Arizona|Arkansas|California|Colorado|Connecticut|Delaware|Florida|Georgia|Hawaii|Idaho|Illinois|Indiana|Iowa|Kansas|Kentucky|Louisiana|Maine|Maryland|Massachusetts|Michigan|Minnesota|Mississippi|Missouri|Montana|Nebraska|Nevada|New Hampshire|New Jersey|New Mexico|North Carolina|North Dakota|Ohio|Oklahoma|Oregon|Pennsylvania|Rhode Island|South Carolina|South Dakota|Tennessee|Texas|Utah|Vermont|Virginia|Washington|West Virginia|Wisconsin|Wyoming|Argentina|Australia|Austria|Belgium|Brazil|Canada|Chile|China|Colombia|Denmark|Egypt|England|Finland|France|Germany|Greece|India|Ireland|Israel|Italy|Japan|Kenya|Mexico|Netherlands|New Zealand|Nigeria|Norway|Pakistan|Peru|Poland|Portugal|Russia|Scotland|South Africa|South Korea|Spain|Sweden|Switzerland|Turkey|UK|US|USA|Ukraine|United Kingdom|United States|Vietnam|Wales"
FACILITIES = frozenset("Airport Arena Bridge Building Cathedral Center Centre Clinic Hospital Hotel Library Mall Museum Palace Stadium Station Terminal Theatre Tower".split())
COMPANY_WORDS = frozenset("Airlines Association Bank Capital Co College Consulting Corp Corporation Foundation Group Holdings Inc Industries Institute Insurance LLC Labs Laboratories Logistics Ltd Media Motors Partners Pharmaceuticals School Services Solutions Studios Systems Technologies Technology University Ventures".split())
LAND_AFTER = frozenset("Bay Beach Canyon Coast Desert Falls Forest Island Islands Lake Mountain Mountains Ocean Peninsula River Sea Valley".split())
LAND_BEFORE = frozenset("Cape Gulf Lake Mount River".split())
#: Words that are capitalised at a sentence's start or for other reasons, and no name.
COMMON = frozenset(
    "A About After All Also Am An And Any Are As At Be Because Before But By Can Call Contact Could Dear Did Do Does Email English Find For French From German Get Give Had Has Have He Hello Help Her Here Hey Hi His How However I If In Is It Its Just Let Meet List Mail Make May My No Not Now Of On Once One Or Our Please Phone Regarding SSN See She Should "
    "Show Since So Some Spanish Tell Thank Thanks That The Their Then There These They This Those To Today Under Until Us Was We Were What When Where Which While Who Why Will With Would Yes You Your January February March April June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
)

_HEAD = r"[A-ZÀ-ÖØ-Þ]"
#: Capitalised words side by side; a point may follow an initial or a title. The capital comes before the edge, so that a search skips to it.
_CAPITALS = re.compile(rf"{_HEAD}(?<=\b.)[\w'’&-]*(?:(?: {{1,2}}|(?<=\b[A-Z])\. |(?<=\b(?:Dr|Mr|Ms|St))\. |(?<=\b(?:Mrs|Rev))\. |(?<=\bProf)\. )(?:of (?:the )?)?{_HEAD}[\w'’&-]*)*")
_PART = re.compile(r"[\w'’&-]+")
_TITLE = frozenset("Capt Dr Lord Mr Mrs Ms Prof Professor Rev Sgt Sir".split())
_PERSON_BEFORE = re.compile(r"(?:\bname(?: is|:|['’]s| -|)|\bnamed|\bcalled|\bi am|\bi['’]m|\bthis is|\bcontact|\bcall|\bdear|\bregards,|\bsincerely,|\bpatient|\bclient|\bcustomer|\bemployee|\bapplicant|\bcandidate|\bpartner|\btenant|\bmember|\battendee|\breferral:?|\bcolleague|\bboss|\bmanager|\bfriend|\bbrother|\bsister|\bwife|\bhusband|\bson|\bdaughter|\bmother|\bfather|\bdoctor|\bfor|\bby|\bto|\bwith|\band)\s*\Z", re.I)
_ORG_BEFORE = re.compile(r"(?:\bwork(?:s|ed|ing)? (?:at|for)|\bjob at|\bemploye[ed]+ (?:at|by|of)|\bemployer(?: is|:)?|\boffer from|\baccount (?:at|with)|\bcustomer of|\bintern(?:ed|ing|ship)? at|\bcompany|\bengineer at|\bmanager at|\bposition at|\bjoin(?:ed|ing)?)\s*\Z", re.I)
_STATE_AFTER = re.compile(r", [A-Z]{2}\b")
_LEFT = re.compile(r".*[^\w'’:,]", re.S)
_PLACE_BEFORE = re.compile(r"(?:\b(?:live|lives|lived|living|born|raised|based|located|reside|resides|residing|stay|staying|grew up) (?:in|at|near)|\bmov(?:e|ed|ing) to|\bfrom|\bflying to|\bflight to|\btravel(?:ing|led)? to|\btrip to|\bvisit(?:ing|ed)?|\bhometown(?: is|:)?|\bin|\bnear)\s*\Z", re.I)

#: The last words of what the expressions above ask for: without one of them none can match.
_CUES = frozenset(
    "is - name name: name's name’s customer employee applicant candidate partner tenant member attendee referral referral: named called am i'm i’m contact call dear regards, sincerely, patient client colleague boss manager friend brother sister wife husband son daughter mother father doctor for by to with and "
    "at of employer employer: from company join joined in near visit visited visiting hometown hometown:".split()
)


class Recognizer(Protocol):
    """Finds entities of a text (type = label). It is sent to the workers, so models are best loaded at the first use."""

    def find(self, text: str) -> list[Entity]: ...


class Gazetteer:
    """Names, places and organisations among capitalised words, by lists, shapes and the words before them."""

    def __init__(self, first_names: frozenset[str] = FIRST_NAMES, places: str = f"{CITIES}|{REGIONS}"):
        self.names, self.places = first_names, frozenset(places.split("|"))
        self.longest = max(p.count(" ") for p in self.places) + 1

    def find(self, text: str) -> list[Entity]:
        out = []
        for m in _CAPITALS.finditer(text):
            if " " not in (word := m[0]) and not self._alone(word, text, m.start(), m.end()):
                continue
            parts = [(p[0], m.start() + p.start(), m.start() + p.end()) for p in _PART.finditer(m[0])]
            for label, i, j in self._named(parts, text):
                a, b = parts[i][1], parts[j - 1][2]
                own = text[a:b]
                if own.endswith(("'s", "’s")):
                    b -= 2
                if label == "PERSON" and j - i < 3 and _STATE_AFTER.match(text, b):
                    # A city before the two letters of its state.
                    label = "GPE"
                out.append(Entity(text[a:b], a, b, label, LABEL_SCORES[label], "ner"))
        return out

    def _alone(self, word: str, text: str, start: int, end: int) -> bool:
        """Whether a word without capitals beside it can be an entity: most words that start a sentence can't."""
        w = word[:-2] if word.endswith(("'s", "’s")) else word
        if w in self.places or w in self.names:
            return True
        if w in COMMON:
            return False
        # Behind a sentence's end there is no cue.
        first = start > 1 and text[start - 1].isspace() and text[start - 2] in ".!?"
        return not first and self._cued(text[max(0, start - 40) : start]) or text.startswith(", ", end)

    @staticmethod
    def _cued(before: str) -> bool:
        """Whether the last word of `before` is one of the cues."""
        last = before.rstrip().rpartition(" ")[2].lower()
        return last in _CUES or not last.isalpha() and _LEFT.sub("", last) in _CUES

    def _named(self, parts: list[tuple[str, int, int]], text: str) -> Iterator[tuple[str, int, int]]:
        words = [w[:-2] if w.endswith(("'s", "’s")) else w for w, _, _ in parts]
        i, n = 0, len(words)
        while i < n:
            if words[i] in _TITLE:
                i += 1
                j = self._name_end(words, i, n)
                if j > i:
                    yield "PERSON", i, j
                i = max(i, j)
                continue
            found = self._whole(words, i, n) or self._by_context(words, i, n, text[max(0, parts[i][1] - 40) : parts[i][1]])
            if not found and words[i] not in COMMON and _STATE_AFTER.match(text, parts[n - 1][2]):
                found = "GPE", i, n
            if found:
                yield found
                i = found[2]
            else:
                i += 1

    def _whole(self, words: list[str], i: int, n: int) -> tuple[str, int, int] | None:
        if words[i] in LAND_BEFORE and i + 1 < n:
            j = i + 1 + (words[i + 1] == "of")
            return ("LOC", i, j + 1) if j < n else None
        if words[i] in ("University", "Bank", "Institute", "College") and i + 2 < n and words[i + 1] == "of":
            return "ORG", i, n
        if words[i] not in COMMON:
            for j in range(i + 1, min(n, i + 4)):
                last = words[j]
                if last in COMMON:
                    break
                label = "ORG" if last in COMPANY_WORDS else "FAC" if last in FACILITIES else "LOC" if last in LAND_AFTER else None
                if label:
                    while label == "ORG" and j + 1 < n and words[j + 1] in COMPANY_WORDS:
                        j += 1
                    return label, i, j + 1
        for j in range(min(n, i + self.longest), i, -1):
            if " ".join(words[i:j]) in self.places and not (j == i + 1 and words[i] in self.names and j < n and words[j] not in COMMON):
                return "GPE", i, j
        if words[i] in self.names:
            return "PERSON", i, self._name_end(words, i, n)
        return None

    def _name_end(self, words: list[str], i: int, n: int) -> int:
        j = i
        while j < n and j < i + 4 and words[j] not in COMMON and words[j] != "of" and (j == i or words[j] not in self.places):
            j += 1
        return j

    def _by_context(self, words: list[str], i: int, n: int, before: str) -> tuple[str, int, int] | None:
        """Names that no list has: by the words before the first of them."""
        if words[i] in COMMON or len(words[i]) < 2 or words[i].isupper() and len(words[i]) > 5:
            return None
        if not self._cued(before):
            return None
        last = before.rstrip().rpartition(" ")[2].lower()
        if last == "-" and not before.rstrip(" -").lower().endswith("name"):
            return None
        j = self._name_end(words, i, n)
        if j == i:
            # "of" between two names starts none.
            return None
        if _ORG_BEFORE.search(before):
            return "ORG", i, j
        if _PLACE_BEFORE.search(before):
            return "GPE", i, j
        if j - i in (2, 3) and not any(w.isupper() and len(w) > 1 for w in words[i:j]) and _PERSON_BEFORE.search(before):
            return "PERSON", i, j
        if _PERSON_BEFORE.search(before) and re.search(r"(?:name(?: is|:|['’]s)|named|called|dear|i am|i['’]m|sincerely,|regards,)\s*\Z", before, re.I):
            return "PERSON", i, j
        return None


class Nothing:
    """No second model: verifies what the first one found, and finds nothing more."""

    def find(self, text: str) -> list[Entity]:
        return []


def as_place(e: Entity, text: str) -> Entity:
    """An organisation with a place word among the words of the 50 characters before it is a place."""
    if e.type == "ORG" and PLACE_WORDS & set(text[max(0, e.start - 50) : e.start].lower().split()):
        return e._replace(type="GPE", score=LABEL_SCORES["GPE"])
    return e


def trace(masked: str, existing: list[Entity], recognizer: Recognizer) -> list[Entity]:
    """Entities of the first model: not blocked, not over `existing`; places that were taken for
    organisations are relabelled."""
    taken, out = Claimed(existing), []
    for e in recognizer.find(masked):
        if e.type in LABEL_SCORES and e.text.lower().strip() not in BLOCKED and taken.free(e.start, e.end):
            out.append(as_place(e._replace(score=e.score or LABEL_SCORES[e.type], source="ner"), masked))
    return out


def routed(found: list[Entity], config: EngineConfig) -> tuple[list[Entity], list[Entity]]:
    """(confirmed, borderline) by score; lower scores are dropped."""
    return [e for e in found if e.score >= config.trace_high], [e for e in found if config.trace_low <= e.score < config.trace_high]


_LEADING = re.compile(r"^[^A-Za-z0-9]+")


def clean_token(text: str) -> str:
    """Without word-piece marks and leading punctuation."""
    return _LEADING.sub("", text.replace("##", "")).strip()


def guard(masked: str, borderline: list[Entity], recognizer: Recognizer, config: EngineConfig) -> tuple[list[Entity], list[Entity]]:
    """(confirmed, uncertain): borderline entities by the second threshold, and what a second model finds in
    the rest of the text (marks blanked and ends trimmed, so its positions count from the first word)."""
    more = []
    for e in recognizer.find(masked.replace(MARK, " ").strip()):
        own, label = clean_token(e.text), "PERSON" if e.type == "PER" else e.type
        if len(own) >= 3 and own.lower() not in TITLES and label in ("GPE", "LOC", "ORG", "PERSON"):
            more.append(e._replace(text=own, type=label, source="slm"))
    both = borderline + more
    return [e for e in both if e.score >= config.guard_threshold], [e for e in both if e.score < config.guard_threshold]
