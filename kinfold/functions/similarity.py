"""String similarities on a scale of 0 to 100 (Jaro-Winkler: 0 to 1), and a column function for several at once.

Columns are compared by Scores.java, which has the same definitions; the functions here are for single pairs.

A Text keeps what several similarities need of one text, so it is made once: its words, their sorted form, and the bits of
each character's places.
"""

from __future__ import annotations

import hashlib
import tempfile
import zipfile
from collections import deque
from collections.abc import Callable
from functools import cached_property
from pathlib import Path

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Text(str):
    """A text with forms of it that are made when first asked for."""

    @cached_property
    def words(self) -> frozenset[str]:
        return frozenset(self.split())

    @cached_property
    def by_word(self) -> Text:
        """Its words in order."""
        return Text(" ".join(sorted(self.split())))

    @cached_property
    def places(self) -> dict[str, int]:
        """For each character a number whose bits are its places."""
        out: dict[str, int] = {}
        bit = 1
        for c in self:
            out[c] = out.get(c, 0) | bit
            bit <<= 1
        return out

    @cached_property
    def codes(self) -> np.ndarray:
        return np.frombuffer(self.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def common(places: dict[str, int], n: int, b: str) -> int:
    """Length of the longest common subsequence of a text of n characters and b, one row of bits at a time."""
    full = row = (1 << n) - 1
    for c in b:
        u = row & places.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence. What both begin and end with is taken off if it is much."""
    n, most = 0, min(len(a), len(b))
    if a[: most // 4] == b[: most // 4]:
        while n < most and a[n] == b[n]:
            n += 1
    k = 0
    if n or a[len(a) - most // 4 :] == b[len(b) - most // 4 :]:
        while k < most - n and a[-1 - k] == b[-1 - k]:
            k += 1
    if n + k:
        a, b = a[n : len(a) - k], b[n : len(b) - k]
    if not a or not b:
        return n + k
    return n + k + common((a if isinstance(a, Text) else Text(a)).places, len(a), b)


def ratio(a: str, b: str) -> float:
    """Indel similarity: twice the common subsequence over both lengths. Two empty texts are equal."""
    return 100.0 * 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(as_text(a).by_word, as_text(b).by_word)


def token_set_ratio(a: str, b: str) -> float:
    """The best of comparing the shared words, and the shared words with either side's rest. 0 if a side has no word."""
    x, y = as_text(a).words, as_text(b).words
    if not x or not y:
        return 0.0
    both, only_a, only_b = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_a or not only_b):
        return 100.0
    left, right = " ".join(only_a), " ".join(only_b)
    if not both:
        return ratio(left, right)
    # Both sides begin with the shared words and a blank, which any longest common subsequence may take whole.
    shared = len(" ".join(both))
    n, k = shared + 1 + len(left), shared + 1 + len(right)
    out = max(100.0 * 2 * shared / (shared + n), 100.0 * 2 * shared / (shared + k))
    if 100.0 * 2 * min(n, k) / (n + k) > out:
        out = max(out, 100.0 * 2 * (shared + 1 + lcs(left, right)) / (n + k))
    return out


#: Edges of grids that are combed together, cells of a diagonal that are combed at a time, and cells that take as long as
#: a diagonal takes besides its cells.
EDGES, CELLS, BESIDES = 1 << 19, 1 << 15, 1 << 14


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a stretch of the longer one of its length, which may reach over its ends."""
    return partial_ratios([(a, b)])[0]


def partial_ratios(pairs: list[tuple[str, str]]) -> list[float]:
    """partial_ratio of each pair."""
    return [x for x, _ in partials(pairs)]


def partials(pairs: list[tuple[str, str]]) -> list[tuple[float, float | None]]:
    """(partial_ratio, ratio) of each pair; pairs are combed together. ratio: None where it didn't come with the other."""
    out: list = []
    left = []
    for k, (a, b) in enumerate(pairs):
        if len(a) > len(b):
            a, b = b, a
        out.append((100.0 if a or not b else 0.0, None))
        if a and a not in b:
            left.append((len(b), len(a), k, as_text(a), as_text(b)))
    left.sort(key=lambda x: x[:3])
    while left:
        # Grids of about one length, the longest first.
        n = max(1, EDGES // left[-1][0])
        some, left = left[-n:], left[:-n]
        for (m, n, k, _, _), begin in zip(some, combed([(a.codes, b.codes) for *_, a, b in some]), strict=True):
            size, shared = through(begin, n)
            out[k] = (float((200.0 * shared / (n + size)).max()), 100.0 * 2 * int(m - np.count_nonzero(begin >= 0)) / (n + m))
    return out


def combed(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each pair (a, b) and each place of b: where the strand that leaves below it entered from above, less than 0 if it
    entered from the left.

    Strands enter a grid of a against b from the left and from above and leave it to the right and below. They are combed
    cell by cell, all cells of a diagonal together: where characters are equal both strands turn, and so do strands that
    have crossed before. A stretch of b shares as many characters with a as it has, less the strands that enter from above
    it and leave below it. Grids are made of one size by characters that are equal to none, and combed by strips of rows; a
    grid whose rows have all been combed takes no part in the strips that follow.
    """
    order = sorted(range(len(pairs)), key=lambda k: -len(pairs[k][0]))
    rows, m = np.array([len(pairs[k][0]) for k in order]), max(len(b) for _, b in pairs)
    n = int(rows[0])
    seen = np.zeros(int(max(x.max() for p in pairs for x in p)) + 1, dtype=bool)
    for x in (x for p in pairs for x in p):
        seen[x] = True
    code = np.cumsum(seen, dtype=np.uint32) + np.uint32(1)
    # Numbers of strands are larger than any difference of two codes. Sums of strands may wrap around.
    base = 1 << int(code[-1]).bit_length()
    kind = np.uint16 if base + n + m < 1 << 16 else np.uint32
    back, over = np.zeros((n, len(order)), dtype=kind), np.ones((m, len(order)), dtype=kind)
    for at, k in enumerate(order):
        a, b = pairs[k]
        back[n - len(a) :, at], over[: len(b), at] = code[a[::-1]], code[b]
    above = np.empty_like(over)
    above[:] = np.arange(base + n, base + n + m, dtype=kind)[:, None]
    out: list = [None] * len(pairs)
    done, on = 0, len(order)
    while on:
        h = min(height(rows[:on] - done, m), n - done)
        left = np.empty((h, on), dtype=kind)
        left[:] = np.arange(base + n - done - h, base + n - done, dtype=kind)[:, None]
        comb(np.ascontiguousarray(back[n - done - h : n - done, :on]), over, left, above)
        done += h
        stay = int(np.count_nonzero(rows > done))
        for at in range(stay, on):
            k = order[at]
            out[k] = above[: len(pairs[k][1]), at].astype(np.int64) - (base + n)
        if 0 < stay < on:
            over, above = np.ascontiguousarray(over[:, :stay]), np.ascontiguousarray(above[:, :stay])
        on = stay
    return out


def height(rows: np.ndarray, m: int) -> int:
    """Rows of the next strip, so that most cells are combed in a time: grids that have fewer rows left are padded."""
    some = np.append(np.unique(rows[rows * len(rows) <= CELLS]), max(1, CELLS // len(rows)))
    cells = np.minimum(rows[:, None], some).sum(0)
    return int(some[np.argmax(cells / (some * len(rows) + BESIDES * (1 + some / m)))])


def comb(back: np.ndarray, over: np.ndarray, left: np.ndarray, above: np.ndarray) -> None:
    """Comb a strip: back has its rows' characters from the last to the first, left and above their strands; one column a pair."""
    h, m = len(back), len(over)
    one = back.dtype.type(1)
    free, both = np.empty_like(left), np.empty_like(left)
    for d in range(h + m - 1):
        lo, hi = max(0, d - h + 1), min(m - 1, d) + 1
        at = slice(h - 1 - d + lo, h - 1 - d + hi)
        x, y, t, s = left[at], above[lo:hi], free[: hi - lo], both[: hi - lo]
        # Equal characters: the largest number there is, and else less than any strand.
        np.bitwise_xor(back[at], over[lo:hi], out=t)
        np.subtract(t, one, out=t)
        np.maximum(t, x, out=t)
        np.add(x, y, out=s)
        np.minimum(t, y, out=x)
        np.subtract(s, x, out=y)


def through(begin: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, common subsequences) of stretches; begin: where the strand that leaves below each place entered from above."""
    m = len(begin)
    leaves = np.full(m, m + 1)
    inside = (begin >= 0) & (begin < m)
    leaves[begin[inside]] = np.flatnonzero(inside)
    ends = np.arange(1, n + m)
    s, e = np.maximum(0, ends - n), np.minimum(ends, m)
    # A longer stretch gets the strands that leave below its new end and began within it; a shorter one loses those that
    # began above its old start and leave within it.
    more = np.where(ends <= m, begin[np.minimum(ends, m) - 1] >= s, False)
    less = np.where(s > 0, leaves[np.maximum(s - 1, 0)] < np.where(ends <= m, e - 1, e), False)
    return e - s, (e - s) - np.cumsum(more.astype(np.int64) - less)


def jaro(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free: dict[str, deque[int]] = {}
    for j, c in enumerate(b):
        free.setdefault(c, deque()).append(j)
    taken, left = [], []
    for i, c in enumerate(a):
        # The window only moves on, so places before it are of no use any more.
        own = free.get(c)
        while own and own[0] < i - reach:
            own.popleft()
        if own and own[0] <= i + reach:
            taken.append(own.popleft())
            left.append(c)
    if not left:
        return 0.0
    right = [b[j] for j in sorted(taken)]
    m = len(left)
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    j = jaro(a, b)
    if j <= 0.7:
        return j
    n = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        n += 1
    return j + n * 0.1 * (1 - j)


def as_text(x: str) -> Text:
    return x if isinstance(x, Text) else Text(x)


SCORERS: dict[str, Callable[[str, str], float]] = {"ratio": ratio, "tset": token_set_ratio, "tsort": token_sort_ratio, "partial": partial_ratio, "jw": jaro_winkler}


#: Sessions' applications that have the class of Scores.java already.
_compiled: set[str] = set()


def compiled(spark: SparkSession) -> None:
    """Compile Scores.java by the compiler that Spark itself brings, and send the classes to the executors (once an application)."""
    app = spark.sparkContext.applicationId
    if app in _compiled:
        return
    compiler = spark.sparkContext._jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook((Path(__file__).parent / "Scores.java").read_text(encoding="utf-8"))
    jar = Path(tempfile.mkdtemp()) / "kinfold-scores.jar"
    with zipfile.ZipFile(jar, "w") as z:
        for name, code in dict(compiler.getBytecodes()).items():
            z.writestr(f"{name.replace('.', '/')}.class", bytes(code))
    spark.sql(f"ADD JAR '{jar}'")
    _compiled.add(app)


def scores(wanted: dict[str, tuple[str, Column, Column]]) -> Column:
    """A struct of similarities {name: (scorer, a, b)}, as the functions above have them. All are made together, by Scores.java."""
    spark = SparkSession.active()
    compiled(spark)
    given: dict[str, int] = {}
    columns: list[Column] = []

    def place(c: Column) -> int:
        key = str(c)
        if key not in given:
            given[key] = len(columns)
            columns.append(c)
        return given[key]

    kinds = ",".join(f"{kind}:{place(a)}:{place(b)}" for kind, a, b in wanted.values())
    name = "kinfold_scores_" + hashlib.sha256(",".join(wanted).encode()).hexdigest()[:16]
    kind = T.StructType([T.StructField(k, T.DoubleType()) for k in wanted])
    java = spark._jsparkSession
    scorer = java.sharedState().jarClassLoader().loadClass("kinfold.Scores").newInstance()
    java.udf().register(name, scorer, java.parseDataType(kind.json()))
    return F.call_function(name, F.lit(kinds), F.array(*columns))
