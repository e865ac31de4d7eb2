"""Surrogate generators over the digits of an MD5, so that a value always gets the same surrogate.

Each generator is written once, over the operations of a `Maker`: `Value` makes the surrogate itself, `Sql` the text of a
DuckDB expression that makes the same one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import cache

FIRST = (
    "Ada|Agnes|Alba|Alma|Anders|Anton|Arlo|Astrid|Axel|Bela|Berta|Bruno|Carla|Casper|Clara|Dagny|Dario|Diego|Dora|Edda|Edgar|Edith|Egon|Elin|Elsa|Emil|Enzo|Erik|Esther|Fabio|Felix|Fiona|Flora|Franz|Frida|Gerda|Gino|Greta|Gustav|Hanna|"
    "Hedda|Helga|Henrik|Hilda|Hugo|Ida|Igor|Ilse|Ines|Inga|Irma|Ivan|Jonas|Julius|Karin|Karl|Kira|Klara|Knut|Lars|Leo|Lina|Lorenz|Luca|Ludwig|Magda|Malte|Marta|Mats|Mila|Mona|Nadia|Nils|Nora|Olaf|Olga|Oskar|Otto|Paula|Pavel|Petra|Ragna|Rita|"
    "Rolf|Rosa|Runa|Selma|Sigrid|Silvia|Sven|Thea|Tilda|Tomas|Ulla|Uwe|Vera|Viktor|Wanda|Xenia|Yara|Zeno"
)
#: Last names in three parts.
LAST = (
    "Abel|Alder|Arn|Aster|Bak|Berg|Birk|Blom|Bor|Brand|Dahl|Dorn|Eber|Eck|Edel|Eich|Falk|Fels|Feld|Fors|Gar|Gold|Grim|Grun|Haber|Hag|Hall|Hart|Hede|Holm|Jans|Kall|Kant|Kess|Kling|Koben|Land|Lang|Lind|Lod|Lund|Marg|Mor|Nord|Oster|Palm|Quist|Rand|Rehn|Rosen|Sand|Sel|Sjo|Sol|Stein|Strand|Sund|Thor|Tor|Ulm|Vester|Wald|Weid|Zell",
    "ach|ack|adel|agen|al|am|an|ar|au|aven|bach|bak|bek|bo|bor|brek|dal|del|den|e|eck|ed|eg|el|em|en|er|ert|es|fel|ga|gen|gar|gren|ha|hag|hau|hed|hol|i|ik|in|is|ka|kel|ken|la|len|lo|lun|man|mar|me|na|ner|o|or|ra|ren|ro|sel|ta|ter|vi",
    "ak|berg|by|dahl|er|gaard|holt|ing|lund|mann|ov|quist|sen|son|strom|vik",
)
PLACES = (
    "Alden|Amber|Ash|Bay|Beck|Birch|Black|Bram|Bright|Brook|Cal|Cedar|Clay|Clear|Cob|Copper|Cran|Dale|Dun|East|Elm|Fair|Fern|Fox|Glen|Gold|Grand|Gray|Har|Haw|Hazel|High|Hollow|Iron|Ivy|Kings|Lake|Lark|Lime|Long|Maple|Mill|Moss|North|Oak|Pine|Port|Raven|Red|Ridge|Rock|Rose|Sand|Silver|South|Spring|Stone|Sun|Thorn|Water|West|White|Willow|Wren",
    "borough|bourne|bridge|brook|burgh|bury|cliff|combe|cross|dale|den|fell|field|ford|gate|grove|ham|haven|hurst|leigh|mere|minster|mont|mouth|port|shaw|stead|ton|vale|view|wick|worth",
)
STREETS = "Alder|Aspen|Beech|Birch|Bramble|Cedar|Cherry|Chestnut|Clover|Cypress|Dogwood|Elder|Elm|Fern|Fir|Gorse|Hawthorn|Hazel|Heather|Hickory|Holly|Ivy|Juniper|Larch|Laurel|Linden|Magnolia|Maple|Myrtle|Oak|Pine|Poplar|Rowan|Sage|Spruce|Sycamore|Tamarack|Thistle|Walnut|Willow"
SUFFIXES = "Ave|Blvd|Ct|Dr|Ln|Rd|St|Way"
COMPANIES = (
    "Acorn|Anchor|Arbor|Argent|Aspen|Atlas|Beacon|Blue|Bright|Cedar|Cinder|Clear|Cobalt|Copper|Coral|Crest|Crown|Delta|Drift|Echo|Ember|Ever|Falcon|Fern|Flint|Fox|Frost|Glade|Granite|Harbor|Hawk|High|Iron|Jade|Juniper|Key|Lantern|Lark|Lumen|Maple|Meridian|Mist|Moss|North|Oak|Onyx|Orchard|Pine|Prairie|Quarry|Quartz|Raven|River|Rook|Sable|Slate|Solar|Summit|Tide|Umber|Vale|Vista|Willow|Zephyr",
    "bridge|brook|craft|crest|dale|field|fin|fire|forge|gate|glove|grove|haven|hill|key|leaf|light|line|mark|mere|mill|point|port|ridge|rise|song|spring|star|stone|water|way|wood",
)
KINDS = "and Sons|Group|Holdings|Inc|LLC|Ltd|Partners|Works"
CODES = "+20|+27|+30|+31|+32|+33|+34|+36|+39|+40|+41|+43|+45|+46|+47|+48|+49|+51|+52|+54|+55|+56|+57|+60|+61|+62|+63|+64|+65|+66|+81|+82|+84|+86|+90|+91|+98"
GENDERS = "Female|Male|Non-binary|Woman|Man|Agender|Genderfluid|Genderqueer|Bigender|Undisclosed"
LETTERS = "A|B|C|D|E|F|G|H|J|K|L|M|N|P|R|S|T|U|V|W|X|Y|Z"
HEX = "0123456789abcdef"
#: Surrogates of these types may repeat, and may be the original.
REPEATABLE = frozenset(["gender_indicator"])
#: Draws of an unused surrogate within one text, before a suffix makes it one.
TRIES = 50


@cache
def _words(pool: str) -> list[str]:
    return pool.split("|")


class Value:
    """Surrogates themselves, from 32 hexadecimal digits."""

    def __init__(self, digits: str):
        self.digits = digits

    def more(self) -> Value:
        return Value(hashlib.md5(self.digits.encode()).hexdigest())

    def n(self, k: int) -> int:
        """The k-th number of 32 bits."""
        return int(self.digits[8 * k : 8 * k + 8], 16)

    def mod(self, n: int, by: int, plus: int = 0) -> int:
        return n % by + plus

    def div(self, n: int, by: int) -> int:
        return n // by

    def text(self, n: int, width: int = 0) -> str:
        return str(n).rjust(width, "0")

    def pick(self, pool: str, n: int) -> str:
        words = _words(pool)
        return words[n % len(words)]

    def hexed(self, at: int, size: int, letters: str) -> str:
        """`size` digits from the one at `at`, each one as the letter of its value."""
        return "".join(letters[int(c, 16)] for c in self.digits[at : at + size])

    def cut(self, text: str, n: int) -> str:
        return text[:n]

    def cat(self, *parts: str) -> str:
        return "".join(parts)

    def const(self, text: str) -> str:
        return text

    def lower(self, text: str) -> str:
        return text.lower()

    def luhn(self, text: str) -> str:
        """The check digit after fifteen digits."""
        return str(-sum(int(c) if i % 2 else int("0246813579"[int(c)]) for i, c in enumerate(text)) % 10)

    def aba(self, text: str) -> str:
        """The check digit after eight digits; the weights are 3, 7, 1."""
        return str(-sum((3, 7, 1)[i % 3] * int(c) for i, c in enumerate(text)) % 10)


class Sql:
    """The same as DuckDB expressions; `digits` is SQL text."""

    def __init__(self, digits: str):
        self.digits = digits

    def more(self) -> Sql:
        return Sql(f"md5({self.digits})")

    def n(self, k: int) -> str:
        return f"('0x' || substr({self.digits}, {8 * k + 1}, 8))::BIGINT"

    def mod(self, n: str, by: int, plus: int = 0) -> str:
        return f"(({n}) % {by} + {plus})"

    def div(self, n: str, by: int) -> str:
        return f"(({n}) // {by})"

    def text(self, n: str, width: int = 0) -> str:
        return f"lpad(({n})::VARCHAR, {width}, '0')" if width else f"({n})::VARCHAR"

    def pick(self, pool: str, n: str) -> str:
        return f"split_part('{pool}', '|', (({n}) % {pool.count('|') + 1} + 1)::INT)"

    def hexed(self, at: int, size: int, letters: str) -> str:
        return f"translate(substr({self.digits}, {at + 1}, {size}), '{HEX}', '{letters}')"

    def cut(self, text: str, n: str) -> str:
        return f"substr({text}, 1, ({n})::INT)"

    def cat(self, *parts: str) -> str:
        return "(" + " || ".join(parts) + ")"

    def const(self, text: str) -> str:
        return f"'{text}'"

    def lower(self, text: str) -> str:
        return f"lower({text})"

    def _check(self, total: str) -> str:
        return f"((10 - ({total}) % 10) % 10)::VARCHAR"

    def luhn(self, text: str) -> str:
        doubled = f"translate({text}, '0123456789', '0246813579')"
        return self._check(" + ".join(f"substr({doubled if i % 2 else text}, {i}, 1)::INT" for i in range(1, 16)))

    def aba(self, text: str) -> str:
        return self._check(" + ".join(f"{(3, 7, 1)[(i - 1) % 3]} * substr({text}, {i}, 1)::INT" for i in range(1, 9)))


Maker = Value | Sql
DIGITS = "0123456789012345"


def _person(a: Maker):
    return a.cat(a.pick(FIRST, a.n(0)), a.const(" "), a.pick(LAST[0], a.n(1)), a.pick(LAST[1], a.n(2)), a.pick(LAST[2], a.n(3)))


def _city(a: Maker):
    return a.cat(a.pick(PLACES[0], a.n(0)), a.pick(PLACES[1], a.n(1)))


def _company(a: Maker):
    return a.cat(a.pick(COMPANIES[0], a.n(0)), a.pick(COMPANIES[1], a.n(1)), a.const(" "), a.pick(KINDS, a.n(2)))


def _ssn(a: Maker):
    # Areas from 001 to 665, as given numbers have them.
    return a.cat(a.text(a.mod(a.n(0), 665, 1), 3), a.const("-"), a.text(a.mod(a.n(1), 99, 1), 2), a.const("-"), a.text(a.mod(a.n(2), 9999, 1), 4))


def _address(a: Maker):
    return a.cat(a.text(a.mod(a.n(0), 9899, 100)), a.const(" "), a.pick(STREETS, a.n(1)), a.const(" "), a.pick(SUFFIXES, a.n(2)), a.const(", "), a.pick(PLACES[0], a.n(3)), a.pick(PLACES[1], a.div(a.n(3), 64)))


def _postcode(a: Maker):
    b = a.more()
    return a.cat(a.pick(LETTERS, a.n(0)), a.pick(LETTERS, a.n(1)), a.text(a.mod(a.n(2), 9, 1)), a.const(" "), a.text(a.mod(a.n(3), 10)), a.pick(LETTERS, b.n(0)), a.pick(LETTERS, b.n(1)))


def _card(a: Maker):
    body = a.cat(a.const("4"), a.hexed(0, 14, DIGITS))
    return a.cat(body, a.luhn(body))


def _bank(a: Maker):
    body = a.cat(a.const("2"), a.hexed(0, 7, DIGITS))
    return a.cat(body, a.aba(body))


def _wallet(a: Maker):
    letters = "2345679ABCDEFGhk"
    return a.cat(a.const("1"), a.cut(a.cat(a.hexed(0, 32, letters), a.more().hexed(0, 32, letters)), a.mod(a.n(0), 9, 25)))


GENERATORS: dict[str, Callable[[Maker], object]] = {
    "email": lambda a: a.cat(a.lower(a.pick(FIRST, a.n(0))), a.const("."), a.text(a.mod(a.n(1), 1_000_000), 6), a.const("@example."), a.pick("org|com|net", a.n(2))),
    "ssn": _ssn,
    "phone_us": lambda a: a.cat(a.const("+1-"), a.text(a.mod(a.n(0), 800, 200)), a.const("-"), a.text(a.mod(a.n(1), 800, 200)), a.const("-"), a.text(a.mod(a.n(2), 10_000), 4)),
    "phone_uk": lambda a: a.cat(a.const("+44 7"), a.text(a.mod(a.n(0), 1000), 3), a.const(" "), a.text(a.mod(a.n(1), 1_000_000), 6)),
    "phone_intl": lambda a: a.cat(a.pick(CODES, a.n(0)), a.const(" "), a.text(a.mod(a.n(1), 9000, 1000)), a.const(" "), a.text(a.mod(a.n(2), 1_000_000), 6)),
    "PERSON": _person,
    "person": _person,
    "address": _address,
    "credit_card": _card,
    "dob": lambda a: a.cat(a.text(a.mod(a.n(0), 12, 1), 2), a.const("/"), a.text(a.mod(a.n(1), 28, 1), 2), a.const("/"), a.text(a.mod(a.n(2), 62, 1945))),
    "ip_address": lambda a: a.cat(*[x for k in range(4) for x in ((a.const("."),) if k else ()) + (a.text(a.mod(a.n(k), 254, 1)),)]),
    "zip_us": lambda a: a.text(a.mod(a.n(0), 100_000), 5),
    "postcode_uk": _postcode,
    "api_key": lambda a: a.cat(a.const("sk-"), a.hexed(0, 32, "GhJkLmNpQrStUvWx")),
    "implicit_location": lambda a: a.cat(_city(a), a.const(" area")),
    "GPE": _city,
    "LOC": lambda a: a.cat(_city(a), a.const(" region")),
    "ORG": _company,
    "FAC": lambda a: a.cat(_company(a), a.const(" Building")),
    "crypto": _wallet,
    "us_bank_number": _bank,
    "us_driver_license": lambda a: a.cat(a.pick(LETTERS, a.n(0)), a.text(a.mod(a.n(1), 10_000_000), 7)),
    "gender_indicator": lambda a: a.pick(GENDERS, a.n(0)),
}


def _other(a: Maker):
    """Two letters, two digits, twice."""
    letters = "abcdefghjkmnpqrs"
    return a.cat(a.hexed(0, 2, letters), a.text(a.mod(a.n(1), 100), 2), a.hexed(16, 2, letters), a.text(a.mod(a.n(3), 100), 2))


def draw(type_: str, original: str, session: str, salt: str, attempt: int = 0) -> str:
    """The surrogate of a value in a session. The salt keys the hash: without it nobody can confirm a guess."""
    digits = hashlib.md5(f"{salt}|{session}|{type_}|{original}|{attempt}".encode()).hexdigest()
    return GENERATORS.get(type_, _other)(Value(digits))


def draw_sql(type_: str, original: str, session: str, salt: str, attempt: str = "0", types: list[str] | None = None) -> str:
    """`draw` as a DuckDB expression; all arguments but `salt` and `types` are SQL text."""
    digits = f"md5('{salt}|' || {session} || '|' || {type_} || '|' || {original} || '|' || ({attempt})::VARCHAR)"
    cases = " ".join(f"WHEN '{t}' THEN {make(Sql('m'))}" for t, make in GENERATORS.items() if types is None or t in types)
    return f"list_transform([{digits}], lambda m: CASE {type_} {cases} ELSE {_other(Sql('m'))} END)[1]"


def pairs_of(entities: list[tuple[str, str]], session: str, salt: str, known: dict[str, str] | None = None) -> dict[str, str]:
    """original -> surrogate of each distinct text of (type, text), in order.

    Originals in `known` keep their surrogate. A surrogate that is taken, or is the original itself, is drawn again,
    after TRIES draws it gets a suffix that counts the pairs.
    """
    known, out = known or {}, {}
    taken = set(known.values())
    for type_, text in entities:
        if text in out:
            continue
        if text in known:
            out[text] = known[text]
            continue
        made = draw(type_, text, session, salt)
        if type_ not in REPEATABLE:
            for k in range(1, TRIES):
                if made not in taken and made != text:
                    break
                made = draw(type_, text, session, salt, k)
            else:
                made = f"{made}_{len(taken):04x}" if made in taken or made == text else made
            taken.add(made)
        out[text] = made
    return out
