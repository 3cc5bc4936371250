"""Names, addresses and phones of places in comparable parts."""

from __future__ import annotations

import html
import re
import unicodedata
from typing import NamedTuple

#: Spellings of street types, directions, small ordinals and business words.
TYPES = {
    **dict.fromkeys(["street", "st", "str"], "st"), **dict.fromkeys(["avenue", "ave", "av"], "ave"), **dict.fromkeys(["boulevard", "blvd", "blv", "boul"], "blvd"),
    **dict.fromkeys(["drive", "dr", "drv"], "dr"), **dict.fromkeys(["lane", "ln"], "ln"), **dict.fromkeys(["road", "rd"], "rd"), **dict.fromkeys(["court", "ct", "crt"], "ct"),
    **dict.fromkeys(["place", "pl", "plc"], "pl"), **dict.fromkeys(["parkway", "pkwy", "pky", "pkway"], "pkwy"), **dict.fromkeys(["way", "wy"], "way"),
    **dict.fromkeys(["highway", "hwy"], "hwy"), **dict.fromkeys(["circle", "cir"], "cir"), **dict.fromkeys(["terrace", "ter"], "ter"), **dict.fromkeys(["square", "sq"], "sq"), **dict.fromkeys(["trail", "trl"], "trl"), **dict.fromkeys(["alley", "aly"], "aly"),
}
DIRECTIONS = {"n": "n", "no": "n", "north": "n", "s": "s", "so": "s", "south": "s", "e": "e", "east": "e", "w": "w", "west": "w", "ne": "ne", "nw": "nw", "se": "se", "sw": "sw", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw"}
ORDINALS = dict(zip("first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split(), [f"{n}{'st' if n == 1 else 'nd' if n == 2 else 'rd' if n == 3 else 'th'}" for n in range(1, 21)]))
BUSINESS = frozenset(
    "bar grill grille pub public house tap room taproom taphouse saloon lounge cocktail bistro bistrot cafe café coffee kitchen brewing brewery brew brewpub distillery distilling distillers pizzeria pizza pizzas smokehouse smoke wine winebar ale alehouse mexican cantina restaurant eatery tavern co company llc inc ltd and the of".split()
)
_UNIT = re.compile(r"(?:\b(?:suite|ste|unit|apt|apartment|rm|room)\b[\s.#:-]*|#\s*)([0-9]{1,4}[a-z]?|[a-z][0-9]{0,3})\b")
_ZIP = re.compile(r"(?<![\d-])(\d{5})(?:-\d{4})?(?![\d-])")
#: The state and country, unless a street is named after it.
_STATE = re.compile(rf"\b(?:m\.\s?t\.?|m t|mt|montana)(?=[\s,.:|-]|$)(?![\s.]+(?:{'|'.join(TYPES)})\b)|\b(?:usa|u\.s\.a\.?|united states)\b")
_NUMBER = re.compile(r"\d{1,7}[a-z]?")


def fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", html.unescape(text))
    return "".join(c for c in text if not unicodedata.combining(c)).lower().replace("’", "'")


def _digits(word: str) -> str:
    """A number in which letters were read for digits."""
    return word.replace("o", "0").replace("l", "1") if re.fullmatch(r"(?=.*\d)[\dol]{2,5}", word) else word


class Address(NamedTuple):
    number: str
    street: str
    direction: str
    type: str
    unit: str
    town: str
    zip: str


def parse_address(text: str | None) -> Address | None:
    """Null for a blank address and for one without a house number and a street."""
    if not text or not text.strip():
        return None
    s = re.sub(r"\([^)]*\)", " ", fold(text)).replace("\xa0", " ")
    s = re.sub(r"\s[-–—]\s", " , ", re.sub(r"[|:;\n]", " , ", s))
    unit = ""
    if m := _UNIT.search(s):
        unit, s = m[1], s[: m.start()] + " , " + s[m.end() :]
    zips = list(_ZIP.finditer(s))
    zip_ = ""
    # A number of five digits at the head is the house number, unless another number is.
    if zips and not s[: zips[-1].start()].strip(" ,") and not re.search(r"\d", s[zips[-1].end() :]) and re.match(r"\s+[a-z]", s[zips[-1].end() :]):
        zips = []
    if zips:
        m = zips[-1]
        zip_, s = m[1], s[: m.start()] + " , " + s[m.end() :]
    s = _STATE.sub(" , ", s)
    parts = [[_digits(w) for w in re.split(r"[^a-z0-9']+", p) if w] for p in s.split(",")]
    # A number or a direction set apart belongs to the street beside it.
    joined: list[list[str]] = []
    for p in filter(None, parts):
        alone = len(p) == 1 and (_NUMBER.fullmatch(p[0]) or p[0] in DIRECTIONS)
        before = joined and all(_NUMBER.fullmatch(w) or w in DIRECTIONS for w in joined[-1])
        if joined and (before or alone and not any(w.isdigit() for w in joined[-1]) and any(w in TYPES for w in joined[-1])):
            joined[-1] += p
        else:
            joined.append(list(p))
    at = next((i for i, p in enumerate(joined) if _NUMBER.fullmatch(p[0]) and len(p) > 1), None)
    if at is None:
        at = next((i for i, p in enumerate(joined) if len(p) > 1 and _NUMBER.fullmatch(p[-1])), None)
        if at is not None:
            joined[at] = [joined[at][-1], *joined[at][:-1]]
    if at is None:
        # The number stands between the street's type and the town.
        found = ((i, j) for i, p in enumerate(joined) for j in range(2, len(p)) if _NUMBER.fullmatch(p[j]) and p[j - 1] in TYPES)
        at, j = next(found, (None, 0))
        if at is None:
            return None
        joined[at] = [joined[at][j], *joined[at][:j], *joined[at][j + 1 :]]
    number, *words = joined[at]
    words = [ORDINALS.get(w, w) for w in words]
    direction = ""
    if words and words[0] in DIRECTIONS and len(words) > 1 and words[1] not in TYPES:
        direction, words = DIRECTIONS[words[0]], words[1:]
    end = next((i for i, w in enumerate(words) if i and w in TYPES), None)
    type_ = ""
    if end is None:
        # Without a type the street ends with its part where another part names the town, else it is taken to be one word.
        apart = any(p and not any(w.isdigit() for w in p) for p in joined[at + 1 :])
        street, rest = (words, []) if apart else (words[:1], words[1:])
        if len(street) > 1 and street[-1] in DIRECTIONS:
            direction, street = direction or DIRECTIONS[street[-1]], street[:-1]
    else:
        street, type_, rest = words[:end], TYPES[words[end]], words[end + 1 :]
    if rest and rest[0] in DIRECTIONS and not direction:
        direction, rest = DIRECTIONS[rest[0]], rest[1:]
    if not street:
        return None
    towns = ["".join(p) for p in [rest, *joined[:at], *joined[at + 1 :]] if p and not any(w.isdigit() for w in p)]
    town = towns[0] if towns else ""
    half = len(town) // 2
    if town and town[:half] == town[half:]:
        town = town[:half]
    return Address(number.lstrip("0") or "0", "".join(street).replace("'", ""), direction, type_, unit.lstrip("0") or unit, town.replace("'", ""), zip_)


def close(a: str, b: str) -> bool:
    """Equal but for one slip of the pen (two in long words): a letter more, less, other, or two swapped."""
    if a == b:
        return True
    if not a or not b or abs(len(a) - len(b)) > 2 or a[0].isdigit() or b[0].isdigit():
        return False
    return distance(a, b, 2) <= (2 if min(len(a), len(b)) >= 8 else 1)


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, up to ``most`` + 1."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def same_location(a: Address, b: Address) -> bool:
    """No component contradicts, and house number and street agree."""
    if a.number != b.number or not close(a.street, b.street):
        return False
    if any(x and y and x != y for x, y in ((a.direction, b.direction), (a.type, b.type), (a.unit, b.unit))):
        return False
    if a.zip and b.zip:
        return a.zip == b.zip or distance(a.zip, b.zip, 1) == 1 and bool(a.town) and close(a.town, b.town)
    return not (a.town and b.town) or close(a.town, b.town)


def name_words(text: str | None) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The words of a name that are its own, and the business words."""
    if not text or not text.strip():
        return (), ()
    s = re.sub(r"\([^)]*\)|\s[-–—]\s.*$", " ", fold(text))
    words = re.split(r"[^a-z0-9]+", re.sub(r"'s\b|'", "", s.replace("&", " and ").replace("+", " and ")))
    own = tuple(w for w in words if w and w not in BUSINESS)
    rest = tuple(w for w in words if w in BUSINESS)
    return (own, rest) if own else (rest, ())


def same_name(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """All own words agree in order, but for slips and initials; or the same letters without spaces."""
    if not a or not b:
        return False
    if len(a) == len(b) and all(close(x, y) or (min(len(x), len(y)) == 1 and x[0] == y[0] and len(a) > 1) for x, y in zip(a, b)):
        return True
    return close("".join(a), "".join(b)) or sorted(a) == sorted(b)


def holds_name(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """All words of one stand in the other, but for slips."""
    short, long = sorted((set(a), set(b)), key=len)
    return bool(short) and all(any(close(v, w) for w in long) for v in short)


def phone_digits(text: str | None) -> str:
    """The last ten digits, or seven; extensions and shorter numbers are left out."""
    digits = re.sub(r"\D", "", re.sub(r"(?i)(?:ext|x|#).*$", "", text or ""))
    return digits[-10:] if len(digits) >= 10 else digits if len(digits) == 7 else ""


def street_keys(a: Address) -> list[str]:
    """Tokens of number and street of which a slip of the pen leaves one whole: both ends, shorter in short words."""
    if a.street[:1].isdigit():
        return [f"{a.number}:{a.street}"]
    ends = [k for k, fits in ((1, len(a.street) <= 6), (3, len(a.street) >= 5)) if fits]
    return sorted({x for k in ends for x in (f"{a.number}:{k}{a.street[:k]}", f"{a.number}:~{k}{a.street[-k:]}")})


def word_keys(word: str) -> list[str]:
    """Keys of which two words that are ``close`` have one in common. One slip leaves two letters at an end whole (one
    in words of up to four letters); where two slips spoil both ends, the pairs of letters after the second to fourth
    hold one that is whole, as they are moved by one place at most."""
    n = len(word)
    ends = [k for k, fits in ((1, n <= 4), (2, n >= 4)) if fits]
    keys = [x for k in ends for x in (f"<{k}{word[:k]}", f">{k}{word[-k:]}")]
    if n == 1:
        keys.append("*")  # Any two single letters are one slip apart.
    elif n == 2:
        keys.append("~" + "".join(sorted(word)))
    elif n >= 8:
        keys += [f"-{word[i : i + 2]}" for i in (2, 3, 4)]
    return keys


def name_keys(own: tuple[str, ...], right: bool) -> list[str]:
    """Keys of which a name of the left and one of the right side have one in common if they are the ``same_name`` or a
    word of one is ``close`` to a word of the other."""
    keys = {k for w in (*own, "".join(own)) for k in word_keys(w)}
    if len(own) > 1:
        # An initial on one side stands for the word on the other: each side names its word for the other's initial.
        keys |= {f"{'l' if right else 'r'}{own[0][0]}"} | ({f"{'r' if right else 'l'}{own[0]}"} if len(own[0]) == 1 else set())
    return sorted(keys)
