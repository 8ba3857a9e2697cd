"""Reading a postal address: house number, street, unit, town and region words, postal code."""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

from recordweave.functions.translit import fold, romanise
from recordweave.llm.names import near, plain, sound

# Word lists in natural order; a street type's first form stands for all.
STREET_TYPES = [
    "avenue ave av", "boulevard blvd bd bld boul", "chemin ch che", "circle cir", "colony col", "court ct crt", "cross xroad crs", "drive dr drv", "highway hwy", "impasse imp", "lane ln", "marg mg",
    "nagar ngr", "parkway pkwy pky", "place pl", "road rd", "rue r", "route rte", "square sq", "street st str", "terrace ter", "way", "allee all", "quai", "cours",
]
TYPES = {form: t.split()[0] for t in STREET_TYPES for form in t.split()}
BEFORE_NAME = {"chemin", "impasse", "place", "rue", "route", "allee", "quai", "cours", "boulevard", "avenue"}
UNITS = "apartment apt suite ste unit floor fl shop flat room rm bureau etage bte building bldg".split()
NUMBER_WORDS = "no number nos hno house door plot".split()
LANDMARK_WORDS = "near nr opposite opp behind beside next above".split()
QUARTERS = "peth gunj wadi layout".split()
ONE_WORD = set("church main park bridge mill school market station temple college fort bazaar hill high river lake eglise gare mairie bains".split())
SMALL = set("de des du la le les l d of the and et a".split())
REGION_HEADS = "pradesh valley".split()
SPLIT_NUMBER = re.compile(r"(?<![\w-])(\d{1,3}(?:-\d{1,3})+(?:\s?/\s?|\s)?\d{0,3}|\d{1,4}/\d{1,4})(?![\w-])")
POSTAL = [re.compile(p) for p in (r"\bpin\b[\s:.-]*(\d{3}[\s-]?\d{3}|\d{5,6})\b", r"(?<![\w-])(\d{5})-(\d{4})(?![\w-])", r"(?<![\w/-])([1-9]\d{5})(?![\w/-])", r"(?<![\w/-])([1-9]\d{2})[ -](\d{3})(?=\s*$|\s*[,;]|\s+-)", r"(?<![\w/-])(\d{5})(?:\.0)?(?=\s*$)", r"(?<![\w/-])([1-9]\d{4})(?![\w/-])")]


class Address(NamedTuple):
    number: str | None
    street: str  # words in shared spelling, joined
    kind: str  # street type or ''
    rest: tuple  # town and region words in the order written, parts separated by None
    postal: str | None
    unit: str | None = None  # apartment, floor, shop and the like, as written
    typed: str = ""  # the street with its vowels as typed
    other: Address | None = None  # another reading: the street's name is one word, the next ones are the town's
    plain: tuple = ()  # rest with its vowels as typed


NOWHERE = Address(None, "", "", (), None)


@functools.lru_cache(100_000)
def kind_of(w: str) -> str | None:
    if w in TYPES:
        return TYPES[w]
    if len(w) > 4:
        for t in ("avenue", "boulevard", "parkway", "street", "colony", "court", "drive", "nagar", "place", "chemin", "impasse"):
            if w[0] == t[0] and near(w, t):
                return t
    return None


def postal_code(raw: str | None) -> str | None:
    """Five or six digits of a delivered postal code, letters typed for digits repaired; else None."""
    if not raw:
        return None
    s = re.sub(r"\.0$|-\d{4}$", "", raw.strip().upper().replace("PIN", ""))
    s = re.sub(r"[^0-9]", "", s.replace("O", "0").replace("I", "1").replace("L", "1"))
    return s if len(s) in (5, 6) else None


def read_address(raw: str | None) -> Address:
    """The parts of an address in any order and writing. Null and empty addresses have none."""
    if not raw or not raw.strip():
        return NOWHERE
    s = (fold(romanise(raw)) or "").lower().replace("’", "'").replace("#", " ")
    postal = None
    for p in POSTAL[:4]:
        if m := p.search(s):
            postal = postal or "".join(m.groups())[:6]
            s = s[: m.start()] + " , " + s[m.end() :]
    number = None
    if m := SPLIT_NUMBER.search(s):
        number = re.sub(r"\D+", "-", m[1].strip())
        s = s[: m.start()] + " # " + s[m.end() :]
    s = re.sub(r"\bh\.?\s?no\b\.?|\bdoor no\b\.?", " no ", s)
    s = re.sub(r"\bl'|\bd'", " ", s)
    s = re.sub(r"\bcross\s+(?:road|rd)\b|\bx[\s-]+(?:road|rd)\b|\bcrs\s+(?:road|rd)\b", " xroad ", s)
    s = re.sub(r"(?<=\w)-+(?=\w)", "_", s)
    s = re.sub(r"\s-+\s|[,;]|\s-+$|^-+\s", " , ", s)
    words = re.findall(r"[a-z_]+|\d+[a-z]?|[,#]", s.replace("'", "").replace(".", " "))
    out: list[str] = []
    units: list[str] = []
    i = 0
    while i < len(words):
        w = words[i]
        nxt = words[i + 1] if i + 1 < len(words) else ""
        if w in UNITS and nxt[:1].isdigit():
            units.append(f"{w} {nxt}")
            out.append(",")
            i += 2
            continue
        if w in LANDMARK_WORDS:
            out.append(",")
            i += 3 if i + 2 < len(words) and words[i + 2] != "," else 2
            continue
        if w == "zone" and nxt.startswith("art") or w == "centre" and nxt.startswith("comm"):
            i += 2
            continue
        if w in NUMBER_WORDS or w == "null" or w == "none":
            i += 1
            continue
        if nxt in QUARTERS and w.isalpha():
            out.append(",")
            i += 2
            continue
        if w[0].isdigit():
            later = any(x[0].isdigit() and len(x) < 5 and words[j - 1] not in UNITS for j, x in enumerate(words[i + 1 :], i + 1))
            if number is None and len(w.lstrip("0")) <= 5 and not (len(w) == 5 and later):
                number = w.lstrip("0") or "0"
                out.append("#")
            elif len(w) in (5, 6):
                postal = postal or w
                out.append(",")
            i += 1
            continue
        if w == "la" and out[-1:] and out[-1].isalpha() and out[-1] not in SMALL and (not nxt or nxt[0] in ",#0123456789" or nxt == "no"):
            w = "lane"
        out.append(w)
        i += 1
    x = _place(out, number, postal, False)
    other = _place(out, number, postal, True)
    return x._replace(unit=" ".join(units) or None, other=other if other.street != x.street else None)


def _place(w: list[str], number: str | None, postal: str | None, short: bool) -> Address:
    """The address of words around the number's place (#); short: a name behind its street type is one word long."""
    at = w.index("#") if "#" in w else -1
    kinds = [(i, k) for i, x in enumerate(w) if x not in ",#" and (k := kind_of(x))]
    # the type beside the number and its words, else the first type that has words beside it
    best = None
    for i, k in kinds:
        lo = i
        while lo > 0 and w[lo - 1] not in ",#" and i - lo < 3 and not kind_of(w[lo - 1]):
            lo -= 1
        hi = i + 1
        while hi < len(w) and w[hi] not in ",#" and hi - i < 5 and not (kind_of(w[hi]) and hi > i + 1):
            hi += 1
        front, back = [x for x in w[lo:i] if x not in SMALL], [x for x in w[i + 1 : hi] if x not in SMALL]
        french = k in BEFORE_NAME and (not front or w[i + 1 : i + 2] and w[i + 1] in SMALL)
        if french and back:
            most = 1 if short else 2
            span, name = (i, hi), back[:most]
            if len(back) > most:  # the words behind them are the town
                names = 0
                for hi2 in range(i + 1, hi):
                    names += w[hi2] not in SMALL
                    if names == most:
                        span = (i, hi2 + 1)
                        break
        elif front:
            span, name = (lo, i + 1), front
            if len(front) > 2:
                span, name = (i - 2, i + 1), front[-2:]
        else:
            continue
        beside = at >= 0 and (span[0] - 1 <= at <= span[1] or at == span[0] - 2 and w[span[0] - 1] == ",")
        score = (beside, -i)
        if best is None or score > best[0]:
            best = (score, span, name, k)
    kind = ""
    if best and (best[0][0] or at < 0 or not _named(w, at)):
        _, span, name, kind = best
    elif at >= 0 and (named := _named(w, at)):
        span, name = named
    elif best:
        _, span, name, kind = best
    else:
        span, name = (0, 0), []
    rest: list = []
    for i, x in enumerate(w):
        if span[0] <= i < span[1]:
            if rest and rest[-1] is not None:
                rest.append(None)
        elif x in ",#":
            if rest and rest[-1] is not None:
                rest.append(None)
        elif x not in ("in",):
            rest.append(x.replace("_", ""))
    while rest and rest[-1] is None:
        rest.pop()
    typed = [x if x is None or len(x) < 3 else plain(x) for x in rest]
    rest = [x if x is None or len(x) < 3 else sound(x) for x in rest]
    joined = lambda f: "".join(f(x.replace("_", "")) for x in name)
    return Address(number, joined(sound), kind, tuple(rest), postal, typed=joined(plain), plain=tuple(typed))


def _named(w: list[str], at: int):
    """The two words behind a number, where the street's type is left out."""
    i = at + 1
    if i < len(w) and w[i] == ",":
        i += 1
    j = i
    while j < len(w) and w[j] not in ",#" and j - i < 2:
        j += 1
    if j > i and w[i].replace("'", "") in ONE_WORD:
        return (i, i + 1), [w[i]]
    if j > i and all(len(x) > 2 for x in w[i:j]):
        return (i, j), [x for x in w[i:j] if x not in SMALL]
    return None
