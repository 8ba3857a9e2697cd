"""Fixed values of the linkage contract: they must be these for results to be right. Plain tables, in natural order."""

# Tokens that stand for a missing value.
NULL_TOKENS = ["null", "none", "nan", "na"]

# Legal forms and their common spelling, romanised ones included.
LEGAL = {
    "corporation": "corp",
    "incorporated": "inc",
    "limited": "ltd",
    "private": "pvt",
    "company": "co",
    "companies": "co",
    "compagnie": "cie",
    "llc": "llc",
    "llp": "llp",
    "lp": "lp",
    "plc": "plc",
    "ltd": "ltd",
    "inc": "inc",
    "corp": "corp",
    "pvt": "pvt",
    "pte": "pvt",
    "prv": "pvt",
    "priv": "pvt",
    "co": "co",
    "sarl": "sarl",
    "sas": "sas",
    "sasu": "sas",
    "sa": "sa",
    "eurl": "eurl",
    "cie": "cie",
    "sci": "sci",
    "snc": "snc",
    "praivet": "pvt",
    "prayvet": "pvt",
    "piraivet": "pvt",
    "pirayvet": "pvt",
    "limitet": "ltd",
    "limiteda": "ltd",
    "elelpi": "llp",
    "elelapi": "llp",
    "karporeshan": "corp",
    "kampani": "co",
    "pvtltd": "pvt ltd",
}

# Tokens beside the legal forms that name no one.
FILLERS = ["and", "the", "of", "ms", "m", "s", "sri", "shri", "shree", "sree"]

# Address words and their short form.
ADDRESS = {
    "road": "rd",
    "street": "st",
    "str": "st",
    "avenue": "ave",
    "av": "ave",
    "boulevard": "blvd",
    "bd": "blvd",
    "bld": "blvd",
    "drive": "dr",
    "lane": "ln",
    "court": "ct",
    "place": "pl",
    "square": "sq",
    "highway": "hwy",
    "parkway": "pkwy",
    "circle": "cir",
    "terrace": "ter",
    "suite": "ste",
    "apartment": "apt",
    "building": "bldg",
    "floor": "fl",
    "near": "nr",
    "opposite": "opp",
    "north": "n",
    "south": "s",
    "east": "e",
    "west": "w",
    "northeast": "ne",
    "northwest": "nw",
    "southeast": "se",
    "southwest": "sw",
    "mount": "mt",
    "saint": "st",
    "sainte": "ste",
    "route": "rte",
    "chemin": "ch",
    "impasse": "imp",
    "allee": "all",
    "rue": "r",
    "faubourg": "fbg",
    "sector": "sec",
    "nagar": "ngr",
    "colony": "col",
    "marg": "mg",
    "cross": "crs",
    "main": "mn",
    "first": "1st",
    "second": "2nd",
    "third": "3rd",
    "fourth": "4th",
    "fifth": "5th",
    "sixth": "6th",
    "seventh": "7th",
    "eighth": "8th",
    "ninth": "9th",
    "tenth": "10th",
    "eleventh": "11th",
    "twelfth": "12th",
    "ground": "gr",
    "gf": "gr fl",
}

# Address tokens that say nothing.
ADDRESS_NOISE = ["no", "number", "hno", "h", "door", "unit", "plot", "house", "flat", "nos"]

# Digits typed for letters, and those letters.
LEET = ("0134578", "oleastb")

# Markers between a name and another name of the same business; a name before the first, a former one before the second.
TRADING_AS = [
    r"d\s*/\s*b\s*/\s*a",
    "dba",
    r"a\s*/\s*k\s*/\s*a",
    "aka",
    r"t\s*/\s*a",
    r"trading\s+as",
    r"doing\s+business\s+as",
    r"also\s+known\s+as",
]
FORMERLY = [
    r"f\s*/\s*k\s*/\s*a",
    "fka",
    r"formerly\s+known\s+as",
]

# How web addresses end that stand for a name.
DOMAIN_ENDINGS = ["com", "net", "org", "in", r"co\.in", "fr", "biz", "info", "us", "io", "co"]

# The steps to a consonant skeleton, in this order.
SOUND_STEPS = [
    ("tion", "sn"),
    ("sion", "sn"),
    ("chh", "s"),
    ("ch", "s"),
    ("sh", "s"),
    ("ph", "p"),
    ("ck", "k"),
    ("c([eiy])", "s$1"),
    ("c", "k"),
    ("q", "k"),
    ("x", "ks"),
    ("z", "s"),
    ("w", "v"),
    ("f", "p"),
    ("b", "p"),
    ("d", "t"),
    ("g", "k"),
    ("j", "s"),
    ("[aeiouyh]", ""),
    (r"(.)\1+", "$1"),
]

# The layout that the nine Brahmic blocks from U+0900 on share: place in the block, Roman letters.
VOWELS = {
    0x05: "a",
    0x06: "a",
    0x07: "i",
    0x08: "i",
    0x09: "u",
    0x0A: "u",
    0x0B: "ri",
    0x0C: "li",
    0x0D: "e",
    0x0E: "e",
    0x0F: "e",
    0x10: "ai",
    0x11: "o",
    0x12: "o",
    0x13: "o",
    0x14: "au",
    0x60: "ri",
    0x61: "li",
}
CONSONANTS = {
    0x15: "k",
    0x16: "kh",
    0x17: "g",
    0x18: "gh",
    0x19: "n",
    0x1A: "ch",
    0x1B: "chh",
    0x1C: "j",
    0x1D: "jh",
    0x1E: "n",
    0x1F: "t",
    0x20: "th",
    0x21: "d",
    0x22: "dh",
    0x23: "n",
    0x24: "t",
    0x25: "th",
    0x26: "d",
    0x27: "dh",
    0x28: "n",
    0x29: "n",
    0x2A: "p",
    0x2B: "ph",
    0x2C: "b",
    0x2D: "bh",
    0x2E: "m",
    0x2F: "y",
    0x30: "r",
    0x31: "r",
    0x32: "l",
    0x33: "l",
    0x34: "l",
    0x35: "v",
    0x36: "sh",
    0x37: "sh",
    0x38: "s",
    0x39: "h",
    0x58: "q",
    0x59: "kh",
    0x5A: "gh",
    0x5B: "z",
    0x5C: "r",
    0x5D: "rh",
    0x5E: "f",
    0x5F: "y",
}
VOWEL_SIGNS = {
    0x3E: "a",
    0x3F: "i",
    0x40: "i",
    0x41: "u",
    0x42: "u",
    0x43: "ri",
    0x44: "ri",
    0x45: "e",
    0x46: "e",
    0x47: "e",
    0x48: "ai",
    0x49: "o",
    0x4A: "o",
    0x4B: "o",
    0x4C: "au",
    0x62: "li",
    0x63: "li",
}
OTHER_SIGNS = {
    0x01: "n",
    0x02: "n",
    0x03: "h",
}
VIRAMA = 0x4D
SILENT_SIGNS = [0x3C, 0x3D, 0x51, 0x52, 0x53, 0x54, 0x55, 0x56, 0x57, 0x70, 0x71]
DIGIT_ZERO = 0x66
