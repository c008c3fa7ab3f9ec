"""Quality rules on repetition.

Words get numbers, and rolling hashes of several lengths over these, in numpy, find the word runs that occur more than
once in a text. What is measured is coverage: the share of a text's word characters inside repeated runs, inside lines
that occur before, and in signs whose run of three characters (the sign in the middle) recurs, as in word***, | tables
and rows of ###. The base rules of the contract come first; a text that passes them is kept unless a coverage exceeds
its limit.

Limits: LIMITS, LINE_LIMIT and SIGN_LIMIT at least, as in published rules of this kind for long runs. fitted() raises
them where labels say so: to what one in a thousand of the texts of quality 1 exceeds, over all labelled rows that
aren't held out, from exact counts of each permille.

Defined cases: null counts as empty; a text without words has zeros throughout and fails the base rule (under 50 words);
texts are measured whole; repeated rows give repeated results; without labels the limits stay; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _MIX, cut, keeps, map_texts, table

#: Most permille of word characters inside repeated runs of so many words, inside repeated lines, and in recurring signs.
#: A run of a few words may recur in ordinary prose; the longer the run, the less of the text.
LIMITS = {5: 150, 7: 130, 10: 100}
LINE_LIMIT, SIGN_LIMIT = 200, 100
#: A text is measured over again only if it has so many words.
LEAST_WORDS, MOST_REPEATED = 50, 50

SPACES = bytes(range(9, 14)) + b" "
NOT_SYMBOLS = bytes(set(range(256)) - set(b"#*$%&|<>"))
CONTINUATION = bytes(range(0x80, 0xC0))
BLANK = bytes(0x20 if c in SPACES else c for c in range(256))
SIGN = np.isin(np.arange(256), list(b"#*$%&|<>"))


class Numbers:
    """Numbers of words, from 0, started afresh when there are too many. 21 bits each, so three fit into 64."""

    def __init__(self, most: int = 1 << 19):
        self.most, self.known = most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        out = list(map(known.get, words))
        if None in out:
            for i, v in enumerate(out):
                if v is None:
                    out[i] = known.setdefault(words[i], len(known))
        return np.array(out, dtype=np.uint64)


def repeated(keys: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in a run (of n words, by keys) that occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(words + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(steps, at, 1)
    np.subtract.at(steps, at + n, 1)
    return np.cumsum(steps[:-1]) > 0


def recurring_signs(text: bytes) -> int:
    """Signs whose run of three characters, the sign in the middle, occurs twice or more; any white space counts as a blank."""
    c = np.frombuffer(f" {text.translate(BLANK).decode('utf-8', 'replace')} ".encode("utf-32-le"), dtype=np.uint32)
    at = np.flatnonzero(SIGN[np.minimum(c, 255)])
    c = c.astype(np.uint64)
    _, times = np.unique(c[at - 1] << np.uint64(42) | c[at] << np.uint64(21) | c[at + 1], return_counts=True)
    return int(times[times > 1].sum())


def measure(text: bytes, numbers: Numbers) -> tuple:
    """(words, characters, symbols, repeated lines, words in repeated runs of 3, permille by length, of lines, of signs)."""
    words = text.split()
    n = len(words)
    symbols = len(text.translate(None, NOT_SYMBOLS))
    if not n:
        return 0, 0, symbols, 0, 0, [0] * len(LIMITS), 0, 0
    size = np.fromiter(map(len, words), dtype=np.int64, count=n)
    if not text.isascii():
        size -= np.fromiter((len(w) - len(w.translate(None, CONTINUATION)) for w in words), dtype=np.int64, count=n)
    chars = int(size.sum())
    ids = numbers(words)
    wide = len(numbers.known) >= 1 << 21
    n3, permille = 0, []
    if n >= 3:
        keys = _rolled(ids, 3) if wide else ids[:-2] << np.uint64(42) | ids[1:-1] << np.uint64(21) | ids[2:]
        three = repeated(keys, 3, n)
        n3 = int(three.sum())
    for k in LIMITS:
        # A repeated run of k words holds repeated runs of 3.
        permille.append(0 if n < k or n3 < k else int(1000 * size[repeated(_rolled(ids, k), k, n)].sum() // chars))
    lines, again, dup_chars = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip(SPACES):
            if line in lines:
                again += 1
                dup_chars += len(line.translate(None, SPACES + CONTINUATION))
            else:
                lines.add(line)
    return n, chars, symbols, again, n3, permille, 1000 * dup_chars // chars, 1000 * recurring_signs(text) // chars if symbols > 1 else 0


def _rolled(ids: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of runs of k numbers."""
    with np.errstate(over="ignore"):
        x = (ids + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        acc = x[: len(x) - k + 1].copy()
        for i in range(1, k):
            acc = acc * _MIX + x[i : len(x) - k + 1 + i]
        return acc


MEASURES = (*(f"dup{k}_permille" for k in LIMITS), "dup_line_permille", "sign_permille")
DEFAULT = dict(zip(MEASURES, (*LIMITS.values(), LINE_LIMIT, SIGN_LIMIT), strict=True))
LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *MEASURES)
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(x, T.LongType()) for x in LONGS), T.StructField("base_failed", T.BooleanType())])
_numbers = Numbers()
keeps(__name__, _numbers.known.clear)


def measured(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): the measures and base_failed."""

    def f(_, texts: list[bytes]) -> dict:
        rows = []
        for x in texts:
            n, chars, symbols, again, n3, permille, line, sign = measure(x, _numbers)
            rows.append((n, chars, symbols, again, n3, *permille, line, sign, n < LEAST_WORDS or 100 * n3 > MOST_REPEATED * n))
        return dict(zip(SCHEMA.fieldNames()[1:], map(list, zip(*rows, strict=True)), strict=True))

    return map_texts(docs.select("doc_id", "text"), f, SCHEMA, as_bytes=True)


def judged(rows: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """rows (as measured() gives them) with kept."""
    ok = ~F.col("base_failed")
    for k, most in (DEFAULT | (limits or {})).items():
        ok = ok & (F.col(k) <= most)
    return rows.withColumn("kept", ok)


def judge(docs: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): the measures, base_failed and kept."""
    return judged(measured(docs), limits)


def fitted(rows: DataFrame, labels: DataFrame, spared: float = 0.999) -> dict[str, int]:
    """Limits that spare such a share of the texts of quality 1 that pass the base rules, out of the rows not held out.

    rows: as measured() gives them. At most 1,001 values of each measure reach the driver.
    """
    good = labels.where("quality = 1 AND doc_id IS NOT NULL AND pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5) <> 0").select("doc_id").distinct()
    rows = rows.where("NOT base_failed").join(good, "doc_id", "left_semi")
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in MEASURES))).alias("m")).groupBy("m.k", "m.v").agg(F.count("*").alias("n"))
    seen: dict[str, list[tuple[int, int]]] = {}
    for r in long.collect():
        seen.setdefault(r["k"], []).append((r["v"], r["n"]))
    out = dict(DEFAULT)
    for k, values in seen.items():
        values.sort()
        upto = np.cumsum([n for _, n in values])
        out[k] = max(out[k], values[int(np.searchsorted(upto, spared * upto[-1]))][0])
    return out


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts are measured once; limits and verdicts are made of the measures, which are small.
    rows = cut(measured(table(spark, sf_dir, "documents")), "quality")
    return judged(rows, fitted(rows, table(spark, sf_dir, "labels")))


_W = r"[\x20\x09-\x0D]"
#: The rows of crc32 over a text of digits, a bit at a time.
_CRC = "xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, 4294967295::BIGINT), 4294967295)"
OP9_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{_W}+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d),
l1 AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS r FROM l0 WHERE regexp_matches(line, '[^ 	-
]')),
l AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '{_W}', '', 'g'))) AS line_chars FROM l1 WHERE r > 1 GROUP BY 1),
g AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM d, unnest([3, 5, 7, 10]) AS t(k), unnest(range(1, len(w) - k + 2)) AS u(i) WHERE len(w) >= k),
h AS (SELECT doc_id, k, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k, g) > 1),
p AS (SELECT DISTINCT doc_id, k, p FROM h, unnest(range(i, i + k)) AS t(p)),
r AS (SELECT doc_id, count(*) FILTER (k = 3) AS n3, {", ".join(f"coalesce(sum(length(w[p])) FILTER (k = {k}), 0) AS c{k}" for k in LIMITS)} FROM p JOIN d USING (doc_id) GROUP BY 1),
s0 AS (SELECT doc_id, string_split(' ' || regexp_replace(text, '{_W}', ' ', 'g') || ' ', '') AS x FROM d),
s1 AS (SELECT doc_id, x[i - 1] || x[i] || x[i + 1] AS g, count(*) AS n FROM s0, unnest(range(2, len(x))) AS t(i) WHERE regexp_matches(x[i], '[#*$%&|<>]') GROUP BY ALL),
s AS (SELECT doc_id, sum(n) AS signs FROM s1 WHERE n > 1 GROUP BY 1),
m AS (SELECT c.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n3, 0) AS n_repeat_words, {", ".join(f"coalesce(1000 * c{k} // word_chars, 0)::BIGINT AS dup{k}_permille" for k in LIMITS)},
coalesce(1000 * line_chars // word_chars, 0)::BIGINT AS dup_line_permille, coalesce(1000 * signs // word_chars, 0)::BIGINT AS sign_permille, n_words < {LEAST_WORDS} OR 100 * coalesce(n3, 0) > {MOST_REPEATED} * n_words AS base_failed
FROM c LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id)),
good AS (SELECT m.* FROM m WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND {_CRC} % 5 <> 0)),
lim AS (SELECT {", ".join(f"greatest({most}, coalesce(list_sort(list({k}))[ceil(0.999::DOUBLE * count(*))::BIGINT], 0)) AS {k}" for k, most in DEFAULT.items())} FROM good)
SELECT m.*, NOT base_failed AND {" AND ".join(f"m.{k} <= lim.{k}" for k in MEASURES)} AS kept FROM m, lim
"""
