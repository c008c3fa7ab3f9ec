"""PII: detected entities get surrogates.

A surrogate is keyed and of the same type and format. Digits and letters go through a keyed permutation of all strings of
their format (a Feistel network, walking on until the result is of the right kind), so distinct entities of a format get
distinct surrogates and an entity gets the same one everywhere, whatever its case, spacing or punctuation. Card numbers keep
whether their check digit is right, IBANs keep country and valid check digits, phone numbers their country, addresses of
private networks stay private, reserved mail domains stay reserved.
Names are found behind titles, behind listed given names, and in lines that say so. Listed given names are permuted within
the list of their gender and script; surnames (and given names in no list) become words of keyed syllables in the same
script and case, and keep a feminine ending. Other mentions of a word of a name in its document, alone or in capitals,
change with it.

Collision check: all distinct entities of the corpus with their surrogates are aggregated. Where two entities share a
surrogate, or a surrogate is itself an entity of the corpus, all but the first try further permutations, twice as many in
each round, and take the first value that is no entity and nobody's surrogate, until all have one; words get more syllables
on the way, so they can't run out. Others can where entities fill a format: if its entities and those that need a surrogate
of it are more than its values, surrogates there may be entities (the first permutation, in which no two share one), and
given names, permuted within their lists, may be too. Up to MAX_EXCEPTIONS entities beside their first surrogate are sent to
all tasks; more stay in a table that is joined with the texts.

Defined cases: null stays null and empty stays empty; texts without entities are unchanged; overlapping finds count once,
in the order mail, IBAN, address, card, social security number, phone, name; texts are searched whole; repeated rows give
repeated results; an empty table gives an empty result; redact() keeps all other columns, but for those named as a count
that is asked for.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_columns, map_texts, table

KEY = b"kinfold surrogates"
KINDS = ("email", "iban", "ip", "card", "ssn", "phone", "name")
#: Exceptions up to which they are sent to all tasks.
MAX_EXCEPTIONS = 1 << 17

EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![\w-])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = re.compile(rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\w)")
#: May be an address of the newer kind: with two colons side by side, or eight groups.
IP6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*::|(?:[0-9A-Fa-f]{1,4}:){7})[0-9A-Fa-f:]{6,39}(?![\w:])")
CARD = re.compile(r"(?<![\w.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w]|\.\d)")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
PHONE = re.compile(r"(?<![\w+])(?:\+\d{8,15}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}([.-])\d{3}\1\d{4}|(?<!\d )(?:\d{3} \d{3} \d{4}|0\d{2,4} \d{3,4} \d{3,4})(?! ?\d))(?!\w)")
_UP = "A-ZÀ-ÖØ-ÞА-ЯЁ"
_WORD = rf"[{_UP}][\w'’-]+"
#: A first word, initials and particles, up to three words more.
NAME = re.compile(rf"\b([{_UP}][\w.'’-]*)(?:[ \t]+(?:[{_UP}]\.|van|von|zu|de|der|den|di|da|la|le|bin|al|del|dos))*[ \t]+({_WORD})(?:[ \t]+({_WORD}))?(?:[ \t]+({_WORD}))?")
#: Lines and phrases that say what follows is a name.
CUE = re.compile(rf"(?:(?:^|(?<=[\n,;(]))[ \t]*(?:Full )?[Nn]ame:|\b[Mm]y name is)[ \t]+({_WORD})(?:[ \t]+[{_UP}]\.)*[ \t]+({_WORD})(?:[ \t]+({_WORD}))?")
MENTION = re.compile(rf"(?<!\w)[{_UP}]\w+(?:['’-]\w+)*")

#: Titles by gender; a capitalised word or two behind one is a name.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Mister": "m", "Sir": "m", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Sra": "f", "Dr": "", "Prof": "", "Господин": "m", "Госпожа": "f"}
#: Given names by script and gender.
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Steven Paul Andrew Kevin Brian George Hans Klaus Jürgen Stefan Uwe Jean Pierre Michel Luc Juan Carlos José Luis Pedro Miguel "
    "Wei Hiroshi Kenji Raj Arjun Ravi Sanjay Amit Vikram Mohammed Ahmed Omar Hassan Yusuf Mehmet Sergei Dmitri Pavel Tomasz Piotr Lars Sven Erik Antonio Marco Giuseppe Paolo Diego Alejandro João".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Donna Michelle Carol Laura Ursula Monika Sabine Petra Heike Marie Sophie Camille Claire María Carmen Ana Isabel Lucía Elena "
    "Ann Anne Jane Mei Yuki Priya Ananya Lakshmi Sunita Deepa Fatima Aisha Layla Zeynep Natasha Olga Anna Julia Katarzyna Ingrid Astrid Giulia Francesca Chiara Valentina Sofia Gabriela Beatriz".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Виктор Владимир Дмитрий Иван Михаил Николай Павел Сергей".split(),
    ("cyrillic", "f"): "Анна Вера Галина Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
}
GENDER = {n: k for k, names in GIVEN.items() for n in names}
SYLLABLES = {
    "latin": [a + b for a in "b d f g h k l m n p r s t v z".split() for b in "a e i o u an el in".split()],
    "cyrillic": [a + b for a in "б в г д ж з к л м н п р с т".split() for b in "а е и о у ан ел ин".split()],
}
ENDING = {"latin": "", "cyrillic": "ов"}


def _round(key: bytes, tweak: str, i: int, half: int, bits: int) -> int:
    digest = hashlib.blake2b(b"%d|%d|" % (i, half) + tweak.encode(), key=key[:64], digest_size=max(8, (bits + 7) // 8 + 1) if bits < 480 else 64).digest()
    n = int.from_bytes(digest, "big")
    while n.bit_length() + 8 < bits:
        digest = hashlib.blake2b(digest, key=key[:64]).digest()
        n = n << 512 | int.from_bytes(digest, "big")
    return n & ((1 << bits) - 1)


def permuted(x: int, size: int, key: bytes, tweak: str, ok=None) -> int:
    """A keyed bijection of the numbers below size (with ok: of those that it accepts, x among them)."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for i in range(8):
            a, b = b, a ^ _round(key, tweak, i, b, half)
        x = a << half | b
        if x < size and (ok is None or ok(x)):
            return x


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def put_digits(form: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in form)


def only_digits(x: str) -> str:
    return "".join(c for c in x if c in "0123456789")


def permuted_string(x: str, key: bytes, tweak: str) -> str:
    """Each class of ASCII characters of x (lower, upper, digits) permuted as one number, in place; others stay."""
    classes = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
    form = "".join("aA0"[k] if (k := next((i for i, s in enumerate(classes) if c in s), 3)) < 3 else c for c in x)
    out = list(x)
    for k, letters in enumerate(classes):
        at = [i for i, c in enumerate(x) if c in letters]
        if at:
            n = 0
            for i in at:
                n = n * len(letters) + letters.index(x[i])
            # What the classes before became is part of the tweak: the whole stays a bijection.
            n = permuted(n, len(letters) ** len(at), key, f"{tweak}|{form}|{k}")
            for i in reversed(at):
                n, r = divmod(n, len(letters))
                out[i] = letters[r]
    return "".join(out)


RESERVED = re.compile(r"(?:^|\.)(?:example\.(?:com|org|net)|test|example|invalid|localhost)$", re.I)


def lowered(x: str) -> str:
    """A-Z in lower case; everything keeps its place."""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x)


def _email(x: str, key: bytes, tweak: str) -> str:
    """The case of an address makes no difference; the surrogate has capitals in the same places."""
    low = lowered(x)
    local, _, domain = low.rpartition("@")
    m = RESERVED.search(domain)
    at = m.start() if m else domain.rindex(".")
    host = ".".join(permuted_string(p, key, "host") for p in domain[:at].split(".")) if at else ""
    new = permuted_string(local, key, f"{tweak}|{len(local)}")
    other = [c for c in local if c.isalpha() and not c.isascii()]
    if other:
        new = "".join(chr(permuted(ord(c) - 0xE0, 23, key, tweak, lambda v: v != 0xF7 - 0xE0) + 0xE0) if 0xE0 <= ord(c) < 0xF7 else c for c in new)
    return "".join(n if o == c else n.upper() for n, o, c in zip(f"{new}@{host}{domain[at:]}", x, low, strict=True))


def _iban(x: str, key: bytes, tweak: str) -> str:
    flat = x.replace(" ", "")
    body = permuted_string(flat[4:], key, f"{tweak}|{flat[:2]}")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    valid = number(flat[4:] + flat[:4]) % 97 == 1
    check = f"{98 - number(body + flat[:2] + '00') % 97:02d}" if valid else flat[2:4]
    it = iter(flat[:2] + check + body)
    return "".join(c if c == " " else next(it) for c in x)


def _network(n: int) -> int:
    """Which private network an address is of; 0: none."""
    return 1 if n >> 24 == 10 else 2 if n >> 20 == 0xAC1 else 3 if n >> 16 == 0xC0A8 else 4 if n >> 24 == 127 else 0


def _network6(x: str) -> tuple[int, int]:
    """(address, bits that may change): private, link-local and documentation networks stay what they are."""
    n = int(ipaddress.IPv6Address(x))
    return n, 121 if n >> 121 == 0x7E else 118 if n >> 118 == 0x3FA else 96 if n >> 96 == 0x20010DB8 else 112


def _ip6(x: str, key: bytes, tweak: str) -> str:
    """Two colons side by side stay if the address allows it."""
    n, bits = _network6(x)
    new = ipaddress.IPv6Address(n >> bits << bits | permuted(n & ((1 << bits) - 1), 1 << bits, key, f"{tweak}|6|{bits}|{n >> bits}"))
    out = new.compressed if "::" in x else ":".join(f"{int(g, 16):x}" for g in new.exploded.split(":"))
    return out.upper() if x.isupper() else out


def _ip(x: str, key: bytes, tweak: str) -> str:
    if ":" in x:
        return _ip6(x, key, tweak)
    n = 0
    for p in x.split("."):
        n = n << 8 | int(p)
    bits = {0: 32, 1: 24, 2: 20, 3: 16, 4: 24}[_network(n)]
    low = permuted(n & ((1 << bits) - 1), 1 << bits, key, f"{tweak}|{bits}|{n >> bits}", (lambda v: not _network(v)) if bits == 32 else None)
    n = n >> bits << bits | low
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


def _card(x: str, key: bytes, tweak: str) -> str:
    d = only_digits(x)
    was = luhn(d)
    new = permuted(int(d), 10 ** len(d), key, f"{tweak}|{len(d)}|{was}", lambda v: luhn(str(v).zfill(len(d))) == was)
    return put_digits(x, str(new).zfill(len(d)))


def phone_parts(x: str) -> tuple[str, str]:
    """(digits that stay, digits that change). Numbers of ten digits are the same with or without +1."""
    d = only_digits(x)
    if d[0] == "0" or (len(d) == 11 and d[0] == "1"):
        return d[0].strip("1"), d[1:]
    n = min(10, len(d) - 2) if x.startswith("+") else len(d)
    return d[: len(d) - n], d[len(d) - n :]


def _phone(x: str, key: bytes, tweak: str) -> str:
    stays, body = phone_parts(x)
    n, d = len(body), only_digits(x)
    return put_digits(x, d[: len(d) - n] + str(permuted(int(body), 10**n, key, f"{tweak}|{stays}|{n}")).zfill(n))


def _ssn(x: str, key: bytes, tweak: str) -> str:
    return put_digits(x, str(permuted(int(only_digits(x)), 10**9, key, tweak)).zfill(9))


def script_of(word: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in word) else "latin"


def _name(word: str, key: bytes, tweak: str, syllables: int) -> str:
    """Surrogate of one word of a name, in its case."""
    title = word[:1].upper() + word[1:].lower()
    script = script_of(word)
    if title in GENDER:
        names = GIVEN[GENDER[title]]
        new = names[permuted(names.index(title), len(names), key, f"{tweak}|{GENDER[title]}")]
    else:
        parts, n = SYLLABLES[script], int.from_bytes(hmac.new(key, f"{tweak}|{word.lower()}".encode(), hashlib.sha256).digest(), "big")
        new = ""
        for _ in range(syllables):
            n, r = divmod(n, len(parts))
            new += parts[r]
        new = (new + ENDING[script] + ("а" if script == "cyrillic" and word.lower().endswith(("а", "я")) else "")).capitalize()
    return new.upper() if word.isupper() and len(word) > 1 else new.lower() if word.islower() else new


MAKERS = {"email": _email, "iban": _iban, "ip": _ip, "card": _card, "ssn": _ssn, "phone": _phone}


def norm(kind: str, x: str) -> str:
    """What makes two mentions the same entity."""
    if kind in ("card", "ssn"):
        return only_digits(x)
    if kind == "phone":
        stays, body = phone_parts(x)
        return f"+{stays} {body}" if stays else body
    if kind == "ip":
        return ipaddress.IPv6Address(x).compressed if ":" in x else x
    return x.replace(" ", "") if kind == "iban" else x.lower() if kind == "name" else lowered(x)


def space(kind: str, x: str) -> tuple[str, int]:
    """Format of an entity (as norm() has it), and how many values it has."""
    if kind == "ip" and ":" in x:
        n, bits = _network6(x)
        return f"6|{bits}|{n >> bits}", 1 << bits
    if kind == "ip":
        n = 0
        for p in x.split("."):
            n = n << 8 | int(p)
        bits = {0: 32, 1: 24, 2: 20, 3: 16, 4: 24}[_network(n)]
        return (f"{bits}|{n >> bits}", 1 << bits) if bits < 32 else ("32", (1 << 32) - (1 << 25) - (1 << 20) - (1 << 16))
    if kind == "card":
        return f"{len(x)}|{luhn(x)}", 10 ** (len(x) - 1) * (1 if luhn(x) else 9)
    if kind in ("ssn", "phone"):
        stays, _, body = x.rpartition(" ")
        return f"{stays}|{len(body)}", 10 ** len(body)
    if kind == "name":
        return "", 0
    rest, body = (x[:4], x[4:]) if kind == "iban" else (x[x.rindex("@") :], x[: x.rindex("@")])
    if kind == "iban" and int("".join(str(int(c, 36)) for c in body + rest)) % 97 == 1:
        rest = rest[:2]
    form, size, seen = "", 1, ""
    for c in body:
        if c in "0123456789":
            form, size = form + "0", size * 10
        elif c.isascii() and c.isalpha():
            form, size = form + ("a" if c.islower() else "A"), size * 26
        elif kind == "email" and 0xE0 <= ord(c) < 0xF7:
            # Equal letters stay equal.
            if c not in seen:
                size, seen = size * (23 - len(seen)), seen + c
            form += chr(0xE0 + seen.index(c))
        else:
            form += c
    return f"{form}|{rest}", size


class Surrogates:
    """exceptions: {(kind, norm): attempt} for entities whose first surrogates collide; more: a table (kind, entity, attempt)
    in its place, if there are too many."""

    def __init__(self, key: bytes = KEY, syllables: int = 4, exceptions: dict | None = None, more: DataFrame | None = None):
        self.key, self.syllables, self.exceptions, self.more = key, syllables, exceptions or {}, more

    def __call__(self, kind: str, x: str) -> str:
        return self.attempt(kind, x, self.exceptions.get((kind, norm(kind, x)), 0) if self.exceptions else 0)

    def attempt(self, kind: str, x: str, k: int) -> str:
        tweak = f"{kind}|{k}" if k else kind
        return _name(x, self.key, tweak, self.syllables + max(0, k.bit_length() - 1)) if kind == "name" else MAKERS[kind](x, self.key, tweak)


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), apart and in order; a name has a span for each of its words."""
    out: list[tuple[int, int, str]] = []

    def add(spans, kind: str) -> None:
        """Spans, in order, that overlap none of those before."""
        nonlocal out
        i, new = 0, []
        for a, b in spans:
            while i < len(out) and out[i][1] <= a:
                i += 1
            if (i == len(out) or out[i][0] >= b) and (not new or new[-1][1] <= a):
                new.append((a, b, kind))
        if new:
            out = sorted(out + new)

    if "@" in text:
        add((m.span() for m in EMAIL.finditer(text)), "email")
    digits = DIGITS.search(text)
    if digits:
        add((m.span() for m in IBAN.finditer(text) if any(c.isdigit() for c in m.group()[4:])), "iban")
        add((m.span() for m in IP.finditer(text)), "ip")
    if "::" in text or (text.count(":") > 6 and COLONS.search(text)):
        add((m.span() for m in IP6.finditer(text) if is_ip6(m.group())), "ip")
    if digits:
        for kind, pattern in (("card", CARD), ("ssn", SSN), ("phone", PHONE)):
            add((m.span() for m in pattern.finditer(text)), kind)
    names = name_spans(text)
    if names:
        add(names, "name")
        words = {text[a:b].lower() for a, b in names}
        add(mentions(text, words), "name")
    return out


DIGITS = re.compile(r"\d[\d ().-]{5}")
COLONS = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}")


def is_ip6(x: str) -> bool:
    """Whether it is an address with three groups and a digit at least."""
    try:
        ipaddress.IPv6Address(x)
    except ValueError:
        return False
    return sum(g != "" for g in x.split(":")) >= 3 and any(c.isdigit() for c in x)


def given(word: str) -> bool:
    """Whether a word, or what stands before its hyphen, is a listed given name, maybe in capitals."""
    w = word.split("-")[0]
    return w in GENDER or (len(w) > 1 and w.isupper() and w.capitalize() in GENDER)


def word_span(m: re.Match, g: int) -> tuple[int, int]:
    """A group's span without the ending of a genitive."""
    a, b = m.span(g)
    return a, b - 2 if m[g].endswith(("'s", "’s")) else b


def name_spans(text: str) -> list[tuple[int, int]]:
    """Words of names: behind a title or a listed given name (with one more if those are given names too), or a cue."""
    out, at = [], 0
    while m := NAME.search(text, at):
        lead = m[1].rstrip(".")
        if lead in TITLES and not (m[1].endswith(".") and len(m[1]) - len(lead) > 1):
            own = [g for g in (2, 3) if m[g]] + ([4] if m[4] and given(m[2]) and given(m[3]) else [])
        elif given(lead) and "." not in m[1] and (not lead.isupper() or m[2].isupper()):
            own = [1, 2] + ([3] if m[3] and given(m[2]) else [])
        else:
            own = []
        out += [word_span(m, g) for g in own]
        at = m.end(own[-1]) if own else m.end(1)
    if "ame:" in text or "name is" in text:
        out = sorted({*out, *(word_span(m, g) for m in CUE.finditer(text) for g in (1, 2, 3) if m[g] and (g < 3 or given(m[2])))})
    return out


def mentions(text: str, words: set[str]):
    """Spans of the words (in lower case) wherever they begin with a capital; of joined words each is looked at."""
    for m in MENTION.finditer(text):
        if m[0].lower() in words:
            yield m.span()
        elif len(parts := re.split("['’-]", m[0])) > 1:
            at = m.start()
            for p in parts:
                if p[:1].isupper() and p.lower() in words:
                    yield at, at + len(p)
                at += len(p) + 1


def replaced(text: str, spans: list[tuple[int, int, str]], make: Surrogates) -> str:
    out, last = [], 0
    for a, b, kind in spans:
        out += [text[last:a], make(kind, text[a:b])]
        last = b
    return "".join([*out, text[last:]])


def entities(docs: DataFrame, make: Surrogates) -> DataFrame:
    """(kind, entity, surrogate) of all distinct entities."""

    def run(parts):
        for p in parts:
            got = set()
            for text in p["text"]:
                for a, b, kind in find(text or ""):
                    x = norm(kind, text[a:b])
                    got.add((kind, x, norm(kind, make(kind, text[a:b]))))
            got = sorted(got)
            yield {k: [x[i] for x in got] for i, k in enumerate(("kind", "entity", "surrogate"))}

    return map_columns(docs.select("text"), run, "kind string, entity string, surrogate string").groupBy("kind", "entity").agg(F.min("surrogate").alias("surrogate"))


def formats(all_: DataFrame) -> DataFrame:
    """all_ with the format of each entity (own), that of its surrogate (target) and the number of values of the latter."""

    def run(parts):
        for p in parts:
            own, target = ([space(k, x) for k, x in zip(p["kind"], p[c], strict=True)] for c in ("entity", "surrogate"))
            yield {**p, "own": [f for f, _ in own], "target": [f for f, _ in target], "size": [min(n, 1 << 62) for _, n in target]}

    return map_columns(all_, run, "kind string, entity string, surrogate string, own string, target string, size long")


def collisions(all_: DataFrame, real: DataFrame) -> DataFrame:
    """(kind, entity, surrogate, lax) that need another surrogate; lax: one that may be an entity (real), as its format is full."""
    from .common import cut, discard

    shared = all_.groupBy("kind", "surrogate").agg(F.count("*").alias("c")).where("c > 1").select("kind", "surrogate")
    met = cut(all_.join(shared.unionByName(real.join(all_, ["kind", "surrogate"], "left_semi")).distinct(), ["kind", "surrogate"], "left_semi"), "met")
    if met.isEmpty():
        out = cut(met.withColumn("lax", F.lit(False)), "bad")
        discard(all_.sparkSession, met)
        return out
    form = cut(formats(all_), "formats")
    here = form.where("kind <> 'name'").groupBy("kind", F.col("own").alias("target")).agg(F.count("*").alias("e"))
    there = form.where("kind <> 'name'").groupBy("kind", "target").agg(F.count("*").alias("s"), F.max("size").alias("size"))
    full = there.join(here, ["kind", "target"], "left").where("s + coalesce(e, 0) > size").select("kind", "target", F.lit(True).alias("full"))
    given = F.col("entity").isin([n.lower() for n in GENDER])
    rows = formats(met).join(full, ["kind", "target"], "left").withColumn("first", F.when(F.col("kind") == "name", given).otherwise(F.coalesce("full", F.lit(False))))
    rows = rows.withColumn("lax", F.col("first") | (F.col("kind") == "name")).join(real.withColumn("real", F.lit(True)), ["kind", "surrogate"], "left")
    rows = cut(rows.withColumn("ok", F.col("lax") | F.col("real").isNull()).select("kind", "entity", "surrogate", "first", "lax", "ok"), "met")
    best = rows.where("ok").groupBy("kind", "surrogate").agg(F.min(F.struct(~F.col("first"), "entity")).getField("entity").alias("entity"))
    out = cut(rows.join(best, ["kind", "surrogate", "entity"], "left_anti").select("kind", "entity", "surrogate", "lax"), "bad")
    discard(all_.sparkSession, met, form, rows)
    return out


def checked(docs: DataFrame, key: bytes = KEY, syllables: int = 4) -> Surrogates:
    """Surrogates without collisions over all of docs."""
    from .common import cut, discard

    spark = docs.sparkSession
    make = Surrogates(key, syllables)
    all_ = cut(entities(docs, make), "entities")
    # Given names are permuted within their lists, so a surrogate among the entities is no sign of a collision.
    real = all_.where("kind <> 'name'").select("kind", F.col("entity").alias("surrogate"))
    bad = collisions(all_, real)
    used = all_.join(bad, ["kind", "entity"], "left_anti").select("kind", "surrogate")
    found: list[DataFrame] = []
    spent: list[DataFrame] = []
    while not bad.isEmpty():
        low = 1 << len(found)

        def tries(parts, low=low):
            for p in parts:
                for kind, x, lax in zip(p["kind"], p["entity"], p["lax"], strict=True):
                    for at in range(low, 2 * low, 4096):
                        ks = range(at, min(at + 4096, 2 * low))
                        yield {"kind": [kind] * len(ks), "entity": [x] * len(ks), "lax": [lax] * len(ks), "attempt": list(ks), "surrogate": [norm(kind, make.attempt(kind, x, k)) for k in ks]}

        tried = map_columns(bad.select("kind", "entity", "lax"), tries, "kind string, entity string, lax boolean, attempt long, surrogate string")
        free = tried.join(used, ["kind", "surrogate"], "left_anti").join(real.withColumn("real", F.lit(True)), ["kind", "surrogate"], "left").where("lax or real is null")
        pick = free.groupBy("kind", "entity").agg(F.min(F.struct("attempt", "surrogate")).alias("p")).select("kind", "entity", "p.attempt", "p.surrogate")
        got = pick.groupBy("kind", "surrogate").agg(F.min(F.struct("entity", "attempt")).alias("p")).select("kind", "p.entity", "p.attempt", "surrogate")
        found.append(cut(got, "found"))
        used = used.unionByName(found[-1].select("kind", "surrogate"))
        old, bad = bad, cut(bad.join(found[-1], ["kind", "entity"], "left_anti"), "bad")
        spent.append(old)
    if found:
        exceptions = found[0]
        for more in found[1:]:
            exceptions = exceptions.unionByName(more)
        exceptions = exceptions.select("kind", "entity", "attempt")
        rows = exceptions.limit(MAX_EXCEPTIONS + 1).collect()
        if len(rows) > MAX_EXCEPTIONS:
            make = Surrogates(key, syllables, more=cut(exceptions, "exceptions"))
        else:
            make = Surrogates(key, syllables, {(r["kind"], r["entity"]): r["attempt"] for r in rows})
    discard(spark, all_, bad, *found, *spent)
    return make


def with_exceptions(docs: DataFrame, more: DataFrame, row: str, column: str) -> DataFrame:
    """docs with a column of the exceptions in each text. row: a name for numbers of rows that docs has no column of."""
    from .common import cut

    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "rows")

    def run(parts):
        for p in parts:
            got = [(i, *e) for i, text in zip(p[row], p["text"], strict=True) for e in sorted({(k, norm(k, text[a:b])) for a, b, k in find(text or "")})]
            yield {k: [x[i] for x in got] for i, k in enumerate((row, "kind", "entity"))}

    each = map_columns(rows.select(row, "text"), run, f"{row} long, kind string, entity string").join(more, ["kind", "entity"])
    lists = each.groupBy(row).agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias(column))
    return rows.join(lists, row, "left").drop(row)


def redact(docs: DataFrame, make: Surrogates | None = None, counts: bool = False) -> DataFrame:
    """docs with surrogates in text (and n_chars brought up to date); counts: with n_<kind> of all kinds."""
    make = make or checked(docs)
    more = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] if counts else []
    docs = docs.drop(*(x.name for x in more))
    schema = T.StructType([*docs.schema.fields, *more])
    row, column = fresh(docs, "kinfold_row"), fresh(docs, "kinfold_exceptions")
    if make.more is not None:
        docs, make = with_exceptions(docs, make.more, row, column), Surrogates(make.key, make.syllables)

    def f(part, texts: list[str]) -> dict:
        found = [find(x) for x in texts]
        makes = [make] * len(texts)
        if column in part.schema.names:
            own = part.column(part.schema.get_field_index(column)).to_pylist()
            makes = [Surrogates(make.key, make.syllables, {(e["kind"], e["entity"]): e["attempt"] for e in x or ()}) for x in own]
        new = [replaced(x, s, m) if s else x for x, s, m in zip(texts, found, makes, strict=True)]
        null = part.column(part.schema.get_field_index("text")).is_null().to_pylist()
        out = {"text": [None if n else x for n, x in zip(null, new, strict=True)]}
        if "n_chars" in part.schema.names:
            old = part.column(part.schema.get_field_index("n_chars")).to_pylist()
            out["n_chars"] = [len(x) if s else n for x, s, n in zip(new, found, old, strict=True)]
        if counts:
            out |= {f"n_{k}": [sum(x[2] == k for x in s) for s in found] for k in KINDS}
        return out

    return map_texts(docs, f, schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
