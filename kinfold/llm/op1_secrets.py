"""Secret scans.

Fixed patterns give the base spans (assigned values, access keys, hex strings). Character Markov models add more: a
candidate run of characters, outside of all base spans, is scored by each model of random strings (one for each alphabet)
and by the model of ordinary identifiers; it is a secret when the log-likelihood ratio is high enough. Where the whole run
isn't, its parts between signs are scored, then the stretch that sticks out most (the largest sum of ratios over the
threshold), so a key glued to a path or to a name is found. All models are trained from labelled samples: by default
random strings drawn with a fixed seed (label 1), and identifiers, paths, words and numbers made by rule from lists of
common words and syllables (label 0), the same with any version of Python; Model takes any other labelled samples.

Defined cases: null and empty texts have no spans; very long texts are scanned whole; runs of more than LONGEST
characters are scored in pieces of that length; repeated rows give repeated results; an empty table gives an empty
result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_texts, table

# Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "markov")

#: What the Markov models look at: runs of these characters, of this length at least; pieces of runs are this long at most.
SHORTEST, LONGEST = 16, 4096
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SIGNS = re.compile(r"[/_=+-]+")
ALPHABET = string.ascii_letters + string.digits + "+/_=-."
CODE = np.full(128, len(ALPHABET), dtype=np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))

RANDOM_ALPHABETS = {
    "hex": "0123456789abcdef",
    "upper hex": "0123456789ABCDEF",
    "base32": string.ascii_uppercase + "234567",
    "base36": string.ascii_lowercase + string.digits,
    "base62": string.ascii_letters + string.digits,
    "base64": string.ascii_letters + string.digits + "+/",
    "url-safe": string.ascii_letters + string.digits + "-_",
}


#: Words of ordinary identifiers and paths, and syllables of ordinary prose in a few languages.
WORDS = (
    "access account action active address agent alert alias amount append apply archive array asset async attribute audio author backup balance batch binary block body bool branch buffer "
    "build bundle button cache callback cancel channel char check child class clean client clone close cluster code collection column command comment commit compare component config "
    "connect console container content context control convert copy count create current custom data database date debug decode default delete deploy depth detail device dict digest "
    "dir disable display document domain download driver edge editor element email enable encode engine entry error event example exception execute export extension field file filter "
    "final find first flag float folder format frame function gateway generator global graph group handler hash header height home host icon image import index info input insert "
    "instance integer interface internal item job json kernel key label language last layout length level library limit line link list load local lock log login loop main manager map "
    "match memory message method metric middleware migration mode model module monitor mutable name network next node notification null number object offset open operator option order "
    "output override package page panel param parent parse patch path payload permission plugin point policy port prefix process product"
).split()
SYLLABLES = "the and ing ion ent ver ich keit lich ung schaft tion ment able ness heit zer ge be ein aus auf der die das und que les des est pour dans ion eur aux ette ado ando ción para los las por con der re un in de en er an te le ra to no ma ti se la".split()
#: Words that one identifier is made of at most.
PARTS = 6


def labelled_samples(n: int = 2000, seed: int = 11) -> list[tuple[str, int, str]]:
    """(text, label, class): random strings are 1, ordinary identifiers are 0."""
    rnd = random.Random(seed)
    out = [("".join(rnd.choices(a, k=rnd.randint(SHORTEST, 64))), 1, k) for k, a in RANDOM_ALPHABETS.items() for _ in range(n)]
    plain: list[str] = []
    for _ in range(n * 4):
        words = rnd.choices(WORDS, k=rnd.randint(1, PARTS))
        joined = rnd.choice("_-/") .join(words)
        plain += [joined, joined.upper() if rnd.random() < 0.3 else joined + rnd.choice(["", "/", "s", "_id", f"_{rnd.randrange(100)}", f"-v{rnd.randrange(10)}"])]
        plain += ["".join(w.capitalize() for w in words), words[0] + "".join(w.capitalize() for w in words[1:]) + rnd.choice(["", "s", "Test", str(rnd.randrange(10))])]
        long = "".join(rnd.choices(SYLLABLES, k=rnd.randint(2, 9)))
        plain += [long, long.capitalize(), rnd.choice("-/_").join(("".join(rnd.choices(SYLLABLES, k=rnd.randint(1, 4))) for _ in range(rnd.randint(2, 5))))]
    for _ in range(n * 2):
        plain += ["".join(rnd.choices(WORDS, k=rnd.randint(2, 5))), str(rnd.randrange(10 ** rnd.randint(4, 30))), rnd.choice("-=_+/x0") * rnd.randint(3, 60)]
        plain.append(f"{rnd.randint(1990, 2040)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 31):02d}" + rnd.choice(["", f"_{rnd.randrange(24):02d}-{rnd.randrange(60):02d}-{rnd.randrange(60):02d}", f"/{rnd.choice(WORDS)}"]))
    return out + [(x, 0, "identifier") for x in plain]


class Markov:
    """Log probabilities of the first character and of each next one given the one before (add-k smoothing)."""

    def __init__(self, texts: list[str], k: float = 0.05):
        n = len(ALPHABET) + 1
        first, then = np.full(n, k), np.full((n, n), k)
        for x in texts:
            c = codes(x)
            if len(c):
                first[c[0]] += 1
                np.add.at(then, (c[:-1], c[1:]), 1)
        self.first, self.then = np.log(first / first.sum()), np.log(then / then.sum(1, keepdims=True))

    def score(self, c: np.ndarray) -> float:
        return float(self.first[c[0]] + self.then[c[:-1], c[1:]].sum())


def codes(x: str) -> np.ndarray:
    b = np.frombuffer(x.encode("ascii", "replace"), dtype=np.uint8)
    return CODE[np.minimum(b, 127)]


class Model:
    """Log-likelihood ratio of random against ordinary; threshold: nats a character."""

    def __init__(self, samples: list[tuple[str, int, str]]):
        by: dict[str, list[str]] = {}
        held: list[tuple[str, int]] = []
        for i, (x, label, kind) in enumerate(samples):
            if i % 5:
                by.setdefault(kind if label else "", []).append(x)
            elif len(x) >= SHORTEST:
                held.append((x, label))
        self.plain, self.random = Markov(by.pop("")), [Markov(x) for _, x in sorted(by.items())]
        # Half of what all but one in a hundred held-out random strings exceed, and above every held-out ordinary one.
        high = sorted(self.ratio(x) for x, label in held if label)
        self.threshold = max([high[len(high) // 100] / 2 if high else 0.0, *(self.ratio(x) + 0.05 for x, label in held if not label)])
        self.recall = sum(self.ratio(x) > self.threshold for x, label in held if label) / max(1, sum(label for _, label in held))

    def ratio(self, x: str) -> float:
        c = codes(x)
        s = [m.score(c) for m in self.random]
        top = max(s)
        mean = top + math.log(sum(math.exp(v - top) for v in s) / len(s))
        return (mean - self.plain.score(c)) / len(c)

    def found(self, x: str) -> list[tuple[int, int]]:
        """(start, end) of what is random in a run, in order and apart."""
        if self.ratio(x) > self.threshold:
            return [(0, len(x))]
        out, at = [], 0
        for m in [*SIGNS.finditer(x), None]:
            end = m.start() if m else len(x)
            if end - at >= SHORTEST and end - at < len(x) and self.ratio(x[at:end]) > self.threshold:
                out.append((at, end))
            at = m.end() if m else end
        return out or self.stretches(x)

    def stretches(self, x: str) -> list[tuple[int, int]]:
        """The stretch of the largest sum of ratios over the threshold, by any of the models; then on either side of it."""
        c = codes(x)
        plain = self.plain.then[c[:-1], c[1:]] + self.threshold
        gain = np.stack([m.then[c[:-1], c[1:]] for m in self.random]) - plain
        out, todo = [], [(0, len(x))]
        while todo:
            a, b = todo.pop()
            if b - a < SHORTEST:
                continue
            upto = np.concatenate((np.zeros((len(gain), 1)), np.cumsum(gain[:, a : b - 1], axis=1)), axis=1)
            low = np.minimum.accumulate(upto, axis=1)
            k, j = np.unravel_index(int(np.argmax(upto - low)), upto.shape)
            i = int(np.argmin(upto[k, : j + 1]))
            s, e = a + i, a + int(j) + 1
            if e - s >= SHORTEST and self.ratio(x[s:e]) > self.threshold:
                out.append((s, e))
                todo += [(a, s), (e, b)]
        return sorted(out)


@lru_cache(1)
def default_model() -> Model:
    return Model(labelled_samples())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def markov_spans(text: str, base: list[tuple[int, int, int]], model: Model) -> list[tuple[int, int, int]]:
    """What the models call random in the candidates, outside of the base spans (in order of their start)."""
    out, k, edge = [], 0, 0
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        # What base spans leave of the candidate; edge is where those that began before end.
        while at < end:
            while k < len(base) and base[k][0] <= at:
                edge = max(edge, base[k][2])
                k += 1
            at = max(at, edge)
            stop = min(end, base[k][0]) if k < len(base) else end
            for a in range(at, stop, LONGEST):
                b = min(a + LONGEST, stop)
                if b - a >= SHORTEST:
                    out += [(a + s, 3, a + e) for s, e in model.found(text[a:b])]
            at = max(at, stop)
    return out


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): counts by kind and all spans as kind:start:end."""
    model = model or default_model()

    def f(_, texts: list[str]) -> dict:
        out = {x.name: [] for x in SCHEMA.fields[1:]}
        for text in texts:
            base = base_spans(text)
            more = markov_spans(text, base, model)
            for i, k in enumerate(KINDS):
                out[f"n_{k}"].append(sum(x[1] == i for x in base) if i < 3 else len(more))
            out["base_sha256"].append(hashlib.sha256(digest(base).encode()).hexdigest())
            out["spans"].append(digest(sorted(base + more)))
        return out

    return map_texts(docs.select("doc_id", "text"), f, SCHEMA)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
