"""What of a business name identifies the organisation: its proper words, in a spelling that romanisations share."""

from __future__ import annotations

import functools
import re

from recordweave.functions import fixed
from recordweave.functions.text import domain
from recordweave.functions.translit import fold, romanise

# Word lists in natural order.
LEGAL = set("and et the of a le la les de des du m s ms co company companies corp corporation inc incorporated llc llp lp ltd limited plc pvt private pte pvtltd regd sa sarl sas sasu eurl cie compagnie sci snc p l c".split())
TITLES = set("mr mrs dr sri shri shree sree smt m/s messrs ets etablissements etablissement ste societe maison".split())
TRADE = (
    "associates brothers center centre chemicals construction distributors electricals engineering enterprises foods furniture hardware industries international logistics manufacturing "
    "packaging printers services sons technologies textiles trading transport transports batiment boulangerie electricite librairie maconnerie menuiserie pharmacie fils holdings group branch"
).split()
SHORT = set(
    "assoc assocs assn bros bro ctr chem chems const constr dist distr distrib elec elect electr engg engr eng ent entps enterp fds food furn hdw hdwe ind inds indus int intl log logist mfg manuf mfrs pack packg pkg print prtrs serv svcs svc "
    "tech technol tex txtl trdg trad tpt tpts transp bat bati boul boulang lib libr libra mac macon men menuis pharm phie hldgs grp br son".split()
)
NICKNAMES = {
    "theodore": "ted teddy theo",
    "edward": "ned ted teddy ed eddie",
    "richard": "rick dick rich ricky",
    "robert": "rob bob bobby bert",
    "william": "will bill billy willy liam",
    "margaret": "peggy maggie meg marge",
    "katherine": "kathy kate katie kat",
    "elizabeth": "liz betty beth eliza lizzie",
    "venkatesh": "venky venkat",
    "rajendra": "raju rajan raj",
    "krishnan": "kittu krish krishna",
    "subrahmanya": "subbu subramani subra subramanya",
    "lakshmi": "lacchu laxmi lachu",
    "marguerite": "margot",
    "elisabeth": "lise babette elise",
    "francois": "fanfan",
    "alexandre": "alex",
    "jeanbaptiste": "jb jean baptiste",
}
GIVEN: dict[str, frozenset] = {}
for _full, _forms in NICKNAMES.items():
    for _f in [_full, *_forms.split()]:
        GIVEN[_f] = GIVEN.get(_f, frozenset()) | {_full}
TRADING_AS = re.compile(r"\b(?:" + "|".join(fixed.TRADING_AS) + r")\b", re.I)
FORMERLY = re.compile(r"\b(?:" + "|".join([*fixed.FORMERLY, "formerly", "n[eé]e?"]) + r")\b", re.I)
HOST = re.compile(r"^\W*" + domain([*fixed.DOMAIN_ENDINGS, "example"])[1:], re.I)  # example: the ending reserved for examples
LEET = str.maketrans(*fixed.LEET)
_steps = lambda *pairs: [(re.compile(a), b) for a, b in pairs]
CONSONANTS = _steps(("ph", "f"), ("[ck]h?|q|ck", "k"), ("w", "v"), ("z", "j"), ("([bdgtj])h", r"\1"), ("y", "i"), (r"([^aeiou])\1+", r"\1"))
VOWELS = _steps(("aa", "a"), ("ee|ii", "i"), ("oo|ou", "u"), ("au|oa", "o"), ("ai|ei", "e"), (r"(.)\1+", r"\1"))


@functools.lru_cache(100_000)
def plain(word: str) -> str:
    """The word with one letter for consonants that sound alike; its vowels stay as typed, as a lost consonant leaves two that are no long one."""
    for pattern, by in CONSONANTS:
        word = pattern.sub(by, word)
    return word


@functools.lru_cache(100_000)
def sound(word: str) -> str:
    """The word in one of the spellings that the same sounds have in Roman letters."""
    word = plain(word)
    for pattern, by in VOWELS:
        word = pattern.sub(by, word)
    return word


def skeleton(word: str) -> str:
    return re.sub(r"[aeiouyh]", "", word.replace("x", "ks").replace("c", "k").replace("sh", "s").replace("z", "s"))


TRADE_BONES = {skeleton(w) for w in [*TRADE, "limited", "private", "company", "corporation", "and"] if len(skeleton(w)) > 3} | {"lmtt", "prvt", "lmtd", "prvtt", "kmpn", "krpsn", "llp"}


def near(a: str, b: str) -> bool:
    """One edit or swap of neighbours apart, at most."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:]


BY_START: dict[str, list[str]] = {}
for _w in [*TRADE, *(w for w in LEGAL if len(w) > 6)]:
    for _k in {_w[:1], _w[1:2], _w[:2][::-1][:1]}:
        BY_START.setdefault(_k, []).append(_w)


@functools.lru_cache(200_000)
def generic(word: str) -> bool:
    """A legal form, title or trade word, also shortened or misspelt; no proper name."""
    if word in LEGAL or word in TITLES or word in SHORT or word in TRADE:
        return True
    return len(word) > 5 and any(len(w) > 5 and near(word, w) for w in BY_START.get(word[0], []))


def parts(raw: str) -> str:
    """The part of a name that names the organisation: before an added trade name, behind a former name's marker."""
    m = FORMERLY.search(raw)
    if m and raw[m.end() :].strip(" .-,"):
        raw = raw[m.end() :]
    m = TRADING_AS.search(raw)
    if m and raw[: m.start()].strip(" .-,"):
        raw = raw[: m.start()]
    return raw


def proper(raw: str | None) -> tuple[list[str], list[str]]:
    """(proper words in shared spelling, given names) of a business name. See proper_words."""
    words, given = proper_words(raw)
    return [sound(w) if len(w) > 1 else w for w in words], given


def proper_words(raw: str | None) -> tuple[list[str], list[str]]:
    """(proper words, given names) of a business name, both in the order written; initials are proper words of one letter.

    Null and empty names give two empty lists. A name of generic words only keeps them.
    """
    if not raw or not raw.strip():
        return [], []
    indic = any("ऀ" <= c <= "ൿ" for c in raw)
    s = (fold(romanise(raw)) or "").lower().replace("’", "'")
    s = parts(s)
    if m := HOST.match(s):
        s = m[1]
    s = re.sub(r"\bm\s*/\s*s\b\.?", " ", s)
    s = re.sub(r"\b((?:[a-z]\.){2,}[a-z]?)(?![a-z])", lambda m: m[1].replace(".", ""), s)
    s = re.sub(r"jean[\s-]+baptiste", "jeanbaptiste", s)
    words = []
    for w in re.findall(r"[a-z0-9]+", s.replace("'", "")):
        if not w.isalpha() and not w.isdigit():
            w = w.translate(LEET)
        words.append(w)
    given = [w for w in words if w in GIVEN]
    left = [w for w in words if w not in GIVEN and (not generic(w) or len(w) == 1) and not (indic and (skeleton(w) in TRADE_BONES or len(w) < 2))]
    if indic and sum(len(w) > 2 for w in left) > 2:  # the trade words stand behind the proper ones
        left = [w for w in left if len(w) > 2][:2]
    long = [w for w in left if len(w) > 1]
    single = [w for w in left if len(w) == 1]
    if long and single:
        # letters of a spelt-out legal form stand behind the words; an initial stands before or beside one
        order = [w for w in left]
        first = order.index(long[0])
        lead = order[:first]
        long_or = order[first:]
        keep = [w for w in lead if w not in "aml" or len(long) == 1][-1:] if len(long) < 3 else []
        behind = [w for w in long_or if len(w) == 1][:1] if not keep and len(long) == 1 and not indic else []
        left = keep + [w for w in long_or if len(w) > 1] + [w for w in behind if w not in "pslc"]
    elif not long:
        left = [] if given else words
    return left, given


def edits(a: str, b: str, most: int = 3) -> int:
    """Edits and swaps of neighbours from a to b; most + 1 stands for more.

    The columns of the table of distances are kept as bits, one step a letter of b. Each letter that one string lacks
    altogether costs an edit, and what both begin and end with costs none.
    """
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    x, y = set(a), set(b)
    if len(x - y) > most or len(y - x) > most:
        return most + 1
    lo, m, n = 0, len(a), len(b)
    short = min(m, n)
    while lo < short and a[lo] == b[lo]:
        lo += 1
    while m > lo and n > lo and a[m - 1] == b[n - 1]:
        m -= 1
        n -= 1
    a, b = a[lo:m], b[lo:n]
    d, left = len(a), len(b)
    if not d or not left:
        return d + left  # no more than most, as the lengths differ by so much
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << d) - 1, 1 << d - 1
    up, down, same, before = full, 0, 0, 0
    for c in b:
        left -= 1
        here = places.get(c, 0)
        swapped = (~same & here) << 1 & before
        same = ((here & up) + up ^ up | here | down | swapped) & full
        more, less = down | full & ~(same | up), same & up
        if more & top:
            d += 1
        elif less & top:
            d -= 1
        if d - left > most:
            return most + 1
        more, less = more << 1 | 1, less << 1
        up, down, before = (less | ~(same | more)) & full, more & same, here
    return min(d, most + 1)


UNIT = re.compile(r"sh|[^aeiou]|[aeiou]")


def other_word(a: str, b: str) -> bool:
    """Words that differ in two letters, or in more consonants, each replaced in place: another word, not a misspelling.

    Neighbours that changed places are a misspelling.
    """
    x, y = UNIT.findall(a), UNIT.findall(b)
    if len(x) != len(y):
        return False
    differ = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
    vowel = any(p in "aeiou" or q in "aeiou" for p, q in differ)
    if len(differ) == 2:
        return not (vowel and differ[0] == differ[1][::-1])
    return len(differ) > 2 and not vowel


def same_word(a: str, b: str) -> bool:
    """One edit apart, or two that don't make another word; short words allow one."""
    d = edits(a, b, 2)
    return d <= 1 or d == 2 and min(len(a), len(b)) > 4 and not other_word(a, b)


def same_words(a: list[str], b: list[str]) -> bool:
    """Two lists of proper words, of full words each, read as one name in either order or run together."""
    if len(a) == 2 and len(b) == 2:
        return any(same_word(a[0], x) and same_word(a[1], y) for x, y in ((b[0], b[1]), (b[1], b[0])))
    if min(len(a), len(b)) == 2 and max(len(a), len(b)) > 2:  # a misspelt trade word beside them
        two, more = sorted((a, b), key=len)
        return any(same_words(two, [p, q]) for i, p in enumerate(more) for q in more[i + 1 :])
    x, ys = "".join(a), {"".join(b), "".join(reversed(b))}
    xs = {x, "".join(reversed(a))}
    return any(edits(p, q, 2) <= 2 and not other_word(p, q) for p in xs for q in ys)
