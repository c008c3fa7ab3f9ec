"""Word lists and patterns. All of these are fixed values: results depend on every entry."""

from __future__ import annotations

# Names, richer form.
# fmt: off
NAME_CANON = {
    "limited": "ltd", "private": "pvt", "incorporated": "inc", "corporation": "corp", "company": "co", "centre": "center", "service": "services", "cntr": "center",
    "intl": "international", "mfg": "manufacturing", "bros": "brothers", "assoc": "associates", "tech": "technologies", "technology": "technologies",
    "pvtltd": "pvt ltd",
}
NAME_STOP = [
    "ltd", "pvt", "inc", "corp", "co", "llc", "llp", "lp", "pc", "pllc", "pa", "plc", "public", "the", "and", "of", "dr", "mr", "mrs", "ms", "smt", "sri", "shri",
    "center", "services", "partners", "group", "board", "formerly", "dba", "aka", "as", "doing", "business", "known", "nee", "ta", "id", "www", "com", "net", "org",
    "sa", "sas", "sarl", "eurl", "sci", "snc", "ste", "societe", "cie", "et", "de", "du", "des", "la", "le", "les", "sasu", "gmbh", "sl", "trading", "a", "m", "s",
    "l", "c", "p", "d", "k", "b", "f", "t", "n", "g", "h", "j", "i", "e", "o", "r", "u", "v", "w", "x", "y", "z", "q",
]
# fmt: on
ALIAS = r"\b(?:formerly|dba|d/b/a|aka|a\.k\.a\.?|t/a|trading as|doing business as|nee|known as|fka|f/k/a)\b"
DOMAIN = r"[a-z0-9]\.(?:com|net|org|in|fr|biz|info|us|io|co)\b"
DOMAIN_ENDS = r"\.(?:com|net|org|co\.in|in|fr|biz|info|us|io|co)\b"
NOT_TOKEN = r"[^\p{L}\p{M}\p{N}]+"
LATIN_MARKS = r"[\x{0300}-\x{036F}]"
LEET_FROM, LEET_TO = "0134578", "oleastb"
#: Cleaning of names before they are split, in this order: (pattern, new).
NAME_STEPS = (
    (r"\(\s*id\s*:?\s*\d+\s*\)|\bid\s*:\s*\d+", " "), (r"\d{7,}", " "), (r"\bwww\.", " "), (DOMAIN_ENDS, " "), (r"[&+]", " and "), (r"['’`.]", ""), (NOT_TOKEN, " "),
)
ALIAS_STEPS = ((r"['’`.]", ""), (NOT_TOKEN, " "))

# Addresses, richer form.
# fmt: off
ADDR_CANON = {
    "st": "street", "str": "street", "rd": "road", "raod": "road", "dr": "drive", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "bd": "boulevard",
    "bvd": "boulevard", "ln": "lane", "ct": "court", "cir": "circle", "pl": "place", "hwy": "highway", "pkwy": "parkway", "ter": "terrace", "trl": "trail",
    "sq": "square", "mt": "mount", "ft": "fort", "nr": "near", "opp": "opposite", "r": "rue", "fl": "floor", "flr": "floor", "apt": "apartment", "ste": "suite",
    "rte": "route", "chem": "chemin", "imp": "impasse", "fbg": "faubourg", "hn": "house", "hno": "house", "bldg": "building", "cr": "crescent", "jn": "junction",
    "mg": "mg", "pb": "pb", "sec": "sector", "extn": "extension", "ext": "extension", "first": "1", "second": "2", "third": "3", "fourth": "4", "fifth": "5",
    "sixth": "6", "seventh": "7", "eighth": "8", "ninth": "9", "tenth": "10",
}
ADDR_STOP = [
    "street", "road", "drive", "avenue", "lane", "court", "circle", "place", "no", "door", "flat", "plot", "unit", "apartment", "suite", "floor", "near",
    "opposite", "po", "box", "pmb", "city", "township", "cdp", "the", "of", "block", "house", "building", "rue", "de", "du", "la", "le", "des", "and", "boulevard",
    "null", "na", "none", "nos", "number", "at", "post", "dist", "district", "taluk", "tq", "village", "vill", "ward", "sy", "survey", "sector", "phase", "stage",
    "main", "cross", "highway", "way", "parkway", "terrace", "trail", "square", "route", "chemin", "impasse", "allee", "d", "l", "a", "b", "c", "e", "f", "g", "h",
    "i", "j", "k", "m", "n", "o", "p", "q", "r", "s", "t", "u", "v", "w", "x", "y", "z",
]
# fmt: on
#: Cleaning of addresses before they are split: words for nothing, endings of ordinal numbers.
ADDRESS_STEPS = ((r"<null>|\bnull\b|\bn/a\b|\bnone\b", " "), (r"(\d+)\s*(?:st|nd|rd|th)\b", "$1"))
#: Letters and digits are taken apart.
APART_STEPS = ((r"(\d)([a-z])", "$1 $2"), (r"([a-z])(\d)", "$1 $2"))

# States by country, as name: code; codes stand for themselves.
# fmt: off
STATES = {
    "US": {
        "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de",
        "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky",
        "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo",
        "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc",
        "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc",
        "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv",
        "wisconsin": "wi", "wyoming": "wy", "district of columbia": "dc", "puerto rico": "pr",
    },
    "India": {
        "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg", "goa": "ga", "gujarat": "gj", "haryana": "hr",
        "himachal pradesh": "hp", "jharkhand": "jh", "karnataka": "ka", "kerala": "kl", "madhya pradesh": "mp", "maharashtra": "mh", "manipur": "mn",
        "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl", "odisha": "od", "orissa": "od", "punjab": "pb", "rajasthan": "rj", "sikkim": "sk", "tamil nadu": "tn",
        "telangana": "tg", "tripura": "tr", "uttar pradesh": "up", "uttarakhand": "uk", "west bengal": "wb", "delhi": "dl", "jammu and kashmir": "jk",
        "jammu kashmir": "jk", "ladakh": "la", "chandigarh": "ch", "puducherry": "py", "pondicherry": "py", "andaman and nicobar islands": "an",
        "dadra and nagar haveli": "dn", "daman and diu": "dd", "lakshadweep": "ld",
    },
}
STATE_ALIASES = {"India": {"ts": "tg", "or": "od", "ct": "cg", "ut": "uk", "uttaranchal": "uk", "dl": "dl"}}

# The plainer form of names and addresses.
LEGAL = (
    "incorporated|corporation|corp|inc|private limited|pvt ltd|pvt|private|limited|ltd|llp|llc|plc|co|"
    "company|enterprises|enterprise|gmbh|sarl|sasu|sas|eurl|sci|snc|sa"
)
#: Spellings of one legal form.
LEGAL_CANON = {
    "incorporated": "inc", "corporation": "corp", "private limited": "ltd", "pvt ltd": "ltd", "pvt": "ltd", "private": "ltd", "limited": "ltd", "company": "co",
    "enterprises": "enterprise",
}
NAME_WORDS = {
    "intl": "international", "int'l": "international", "mfg": "manufacturing", "mfr": "manufacturer", "svc": "service", "svcs": "services", "tech": "technologies",
    "techs": "technologies", "ent": "enterprises", "assoc": "associates", "assocs": "associates", "bros": "brothers", "dept": "department", "&": "and",
    "grp": "group", "mgmt": "management", "natl": "national", "dist": "district", "dba": "",
}
STREET_WORDS = {
    "rd": "road", "st": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "bd": "boulevard", "ln": "lane", "dr": "drive", "ct": "court",
    "cir": "circle", "ter": "terrace", "pl": "place", "sq": "square", "hwy": "highway", "pkwy": "parkway", "apt": "apartment", "bldg": "building", "fl": "floor",
    "flr": "floor", "no": "number", "nr": "near", "opp": "opposite", "sec": "sector", "colony": "colony", "rte": "route", "jct": "junction", "expy": "expressway",
}
# fmt: on
PLAIN_DOMAIN = r"(?i)\.(com|net|org|in|co|biz|info)\b"
#: Cleaning of names in the plainer form: beginnings of addresses of the web, their ends, brackets, what stands before the first letter or digit.
PLAIN_STEPS = ((r"(?i)^(https?://)?(www\.)?", ""), (PLAIN_DOMAIN, " "), (r"[\[\](){}]", " "), (r"(?U)^[\W_]+", ""))
LANDMARK = r"(?i)\b(near|nr\.?|opp\.?|opposite|behind|beside|adjacent to|next to)\b[^,]*"
POSTCODE = r"(?<!\d)\d{5}(?:-\d{4})?(?!\d)"
HOUSE_NUMBER = r"\b0*(\d{2,}[a-zA-Z]?(?:/\d+[a-zA-Z]?)?)\b"

# Key types of blocking with their caps, and the signals of the plainer index: (share, shortest, cap, weight).
KEY_TYPES = ("nt", "np", "nc", "ap", "at", "nn", "nw", "aa", "ns", "nx")
KEY_CAPS = {"nt": 300, "np": 300, "nc": 100, "ap": 300, "at": 300, "nn": 300, "nw": 300, "aa": 300, "ns": 300, "nx": 1000}
SIGNALS = {"name": (0.02, 2, 1500, 1.0), "gram": (0.02, 4, 1500, 0.4), "postcode": (0.5, 3, 3000, 2.0), "house": (0.05, 1, 1500, 1.5)}
