"""Benchmark decontamination by a generalised suffix automaton.

The automaton holds the word sequences of all benchmark items. The words of a document are streamed through it, keeping
the length of the longest run of words, ending here, that some item has. A run as long as the window (10 words) marks its
words as hit; an item shorter than the window marks them when it occurs whole. Words that no item has end a run, so only
stretches of words of the items' vocabulary are streamed.

The automaton is built on the executors from the items' words. Items are dealt by a hash into blocks of about BLOCK_WORDS
words, which go through the driver one at a time. A benchmark of more than one block first sorts out the documents: a bit
table of the hashes of all windows (of fixed size, at most 2 ** MOST_BITS bits) tells which may hold one; only these are
then streamed, once for each block.

Defined cases: null and empty texts have no words; items without words or without an id are left out; with no items
nothing is hit; repeated items each count, equal rows of items once; repeated rows of documents give repeated results;
texts of any length are streamed whole; an empty table gives an empty result; other columns, of any name, are kept by
remove_spans() and ignored by scan().
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, WordHashes, cut, discard, fresh, keeps, map_columns, map_texts, mix, shingle_hashes, table

WINDOW, BLOCK_WORDS = 10, 400_000
#: The bit table has this many bits for a window, and as a power of two at most so many in all.
BITS, MOST_BITS = 256, 30
#: remove_spans() leaves out a document of which so many percent of the words are hit.
COVERAGE = 80

#: The contract's words: 0-9, a-z (after lower-casing A-Z) and everything beyond ASCII.
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
FOLDED = bytes(b if WORD.match(bytes([b])) else 0x20 for b in range(256)).translate(LOWER)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLDED).split()


class Automaton:
    """Generalised suffix automaton over word numbers."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window, self.number = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        ends: list[tuple[int, int]] = []  # (state of a prefix, item)
        whole: list[tuple[int, int, int]] = []
        for item, words in items:
            last = 0
            for w in words:
                last = self._extend(last, self.number.setdefault(w, len(self.number)))
                ends.append((last, item))
            if words and len(words) < window:
                whole.append((last, len(words), item))
        self.least = min([window, *(k for _, k, _ in whole)])
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        #: Items that have the runs of a state, as far as these are as long as the window.
        self.items: dict[int, set[int]] = {}
        for s, item in ends:
            if self.length[s] >= window:
                self.items.setdefault(s, set()).add(item)
        for s in reversed(order):
            if s in self.items and self.length[self.link[s]] >= window:
                self.items.setdefault(self.link[s], set()).update(self.items[s])
        #: The state of a run's last words, as many as the window has.
        self.ten = list(range(len(self.length)))
        #: Short items that end a state's runs: (words, item).
        self.short: list[list[tuple[int, int]]] = [[] for _ in self.length]
        for s, k, item in whole:
            self.short[s].append((k, item))
        for s in order:
            up = self.link[s]
            if self.length[up] >= window:
                self.ten[s] = self.ten[up]
            if self.short[up]:
                self.short[s] = self.short[s] + self.short[up]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(c)) is not None:
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = self._state(length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _state(self, length: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Stretches (start, end) of hit words, in order and apart, and the items that occur."""
        found: set[int] = set()
        spans: list[list[int]] = []
        if len(words) < self.least or not self.number:
            return [], found
        ids = np.array(list(map(self.number.get, words, [-1] * len(words))), dtype=np.int64)
        known = np.concatenate(([False], ids >= 0, [False]))
        edges = np.flatnonzero(known[1:] != known[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= self.least:
                self._stream(ids[a:b].tolist(), a, spans, found)
        return [(a, b) for a, b in spans], found

    def _stream(self, ids: list[int], at: int, spans: list[list[int]], found: set[int]) -> None:
        nxt, link, length, window, s, n = self.next, self.link, self.length, self.window, 0, 0
        for i, c in enumerate(ids, at + 1):
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            if c in nxt[s]:
                s, n = nxt[s][c], n + 1
            long = 0
            if n >= window:
                found |= self.items[self.ten[s]]
                long = n
            if self.short[s]:
                for k, item in self.short[s]:
                    if k <= n:
                        found.add(item)
                        long = max(long, k)
            if long:
                a = i - long
                while spans and spans[-1][0] >= a:
                    spans.pop()
                if spans and spans[-1][1] >= a:
                    spans[-1][1] = i
                else:
                    spans.append([a, i])


_built: dict[str, Automaton] = {}
_hashes = WordHashes()
keeps(__name__, lambda: (_built.clear(), _hashes.place.clear()))


def automaton(items: list[tuple[int, list[bytes]]], window: int, key: str) -> Automaton:
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(items, window)
    return _built[key]


class Items:
    """The items of a benchmark, in blocks of about so many words (a longer item is one by itself)."""

    def __init__(self, items: DataFrame, window: int, most: int):
        words = F.size(F.filter(F.split(F.lower("text"), r"[^0-9a-z\x{80}-\x{10FFFF}]+"), lambda x: x != ""))
        self.rows = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
        self.window, self.words = window, self.rows.agg(F.sum(words)).first()[0] or 0
        self.n = max(1, -(-self.words // most))

    def block(self, k: int) -> list[tuple[int, list[bytes]]]:
        own = self.rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(self.n)) == k) if self.n > 1 else self.rows
        got = sorted((r["item_id"], words_of(bytes(r["text"]))) for r in own.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator())
        return [(i, words) for i, words in got if words]

    def bits(self) -> tuple[np.ndarray, list[int]]:
        """A bit table of all windows, in 64-bit words, and the lengths that these have."""
        size = min(MOST_BITS, max(16, (self.words * BITS).bit_length()))
        window = self.window

        def run(parts):
            for p in parts:
                at, bit, lengths = [], [], set()
                for x in p["text"]:
                    h = _hashes(words_of(bytes(x)))
                    if len(h):
                        lengths.add(min(window, len(h)))
                        both = np.concatenate(places(shingle_hashes(h, window), size))
                        at.append(both >> np.uint64(6))
                        bit.append(np.uint64(1) << (both & np.uint64(63)))
                word = np.concatenate([*at, np.array(sorted(-k for k in lengths), dtype=np.int64).view(np.uint64)]).view(np.int64)
                yield {"word": pa.array(word), "bit": pa.array(np.concatenate([*bit, np.zeros(len(lengths), dtype=np.uint64)]).view(np.int64))}

        # Negative words stand for lengths. At most 2 ** (MOST_BITS - 6) words reach the driver.
        got = map_columns(self.rows.select(F.col("text").cast("binary").alias("text")), run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
        word, bit = got.column("word").to_numpy(), got.column("bit").to_numpy()
        out = np.zeros(1 << (size - 6), dtype=np.uint64)
        out[word[word >= 0]] = bit[word >= 0].view(np.uint64)
        return out, sorted(-word[word < 0])


def places(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a bit table for each hash."""
    return h >> np.uint64(64 - size), mix(h) >> np.uint64(64 - size)


def may_hold(words: list[bytes], table_: np.ndarray, lengths: list[int]) -> bool:
    """Whether a window of the table may be among the words."""
    h, size = _hashes(words), len(table_).bit_length() + 5
    for k in lengths:
        if len(h) >= k:
            a, b = places(shingle_hashes(h, k), size)
            if np.any((table_[a >> np.uint64(6)] >> (a & np.uint64(63))) & (table_[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1)):
                return True
    return False


HITS = [T.StructField("kinfold_words", T.LongType()), T.StructField("kinfold_spans", T.ArrayType(T.LongType())), T.StructField("kinfold_items", T.ArrayType(T.LongType()))]


def with_hits(docs: DataFrame, items: Items) -> DataFrame:
    """docs with kinfold_words (their number), kinfold_spans (start and end word of each stretch in turn) and kinfold_items.

    docs has no columns of these names.
    """
    schema = T.StructType([*docs.schema.fields, *HITS])
    if items.n == 1:
        return streamed(docs, items.block(0), items.window, schema)
    bits, lengths = items.bits()
    shipped = docs.sparkSession.sparkContext.broadcast(bits)
    sorted_ = T.StructType([*docs.schema.fields, HITS[0], T.StructField("kinfold_may", T.BooleanType())])

    def f(_, texts: list[bytes]) -> dict:
        words = [words_of(x) for x in texts]
        return {"kinfold_words": list(map(len, words)), "kinfold_may": [may_hold(w, shipped.value, lengths) for w in words]}

    parted = map_texts(docs, f, sorted_, as_bytes=True)
    empty = F.array().cast("array<bigint>")
    none = parted.where("NOT kinfold_may").drop("kinfold_may").withColumn("kinfold_spans", empty).withColumn("kinfold_items", empty)
    out = parted.where("kinfold_may").drop("kinfold_may", "kinfold_words")
    for k in range(items.n):
        old, out = out, cut(streamed(out, items.block(k), items.window, schema), "hits")
        if k:
            discard(docs.sparkSession, old)
    return none.unionByName(out)


def streamed(docs: DataFrame, block: list[tuple[int, list[bytes]]], window: int, schema: T.StructType) -> DataFrame:
    """docs with the hits of a block of items, added to those that it may have already."""
    key = uuid.uuid4().hex
    has = "kinfold_spans" in docs.columns

    def f(part, texts: list[bytes]) -> dict:
        a = automaton(block, window, key)
        n, spans, found = [], [], []
        of = lambda c: part.column(part.schema.get_field_index(c)).to_pylist() if has else [()] * len(texts)
        for text, old, had in zip(texts, of("kinfold_spans"), of("kinfold_items"), strict=True):
            words = words_of(text)
            got, ids = a.hits(words)
            n.append(len(words))
            spans.append([x for s in joined([*zip(old[::2], old[1::2], strict=True), *got]) for x in s])
            found.append(sorted(ids | set(had)))
        return {"kinfold_words": n, "kinfold_spans": spans, "kinfold_items": found}

    return map_texts(docs, f, schema, as_bytes=True)


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, most: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of docs: words, hit words, items that occur."""
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size("kinfold_spans") - 1), F.lit(0).cast("long"), lambda acc, i: acc + F.when(i % 2 == 1, F.get("kinfold_spans", i)).otherwise(-F.get("kinfold_spans", i)))
    ids = F.array_join(F.array_sort(F.transform("kinfold_items", lambda x: x.cast("string"))), ",")
    return (
        with_hits(docs.select("doc_id", "text"), Items(items, window, most))
        .withColumn("n_hit", F.when(F.size("kinfold_spans") > 0, n_hit).otherwise(F.lit(0).cast("long")))
        .select("doc_id", F.col("kinfold_words").alias("n_words"), "n_hit", F.size("kinfold_items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
    )


def remove_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, most: int = BLOCK_WORDS) -> DataFrame:
    """docs with hit words cut out of text; documents covered to so many percent or more are left out."""
    own = Items(items, window, most)
    names = [fresh(docs, f"kinfold_own_{k}") for k in range(len(docs.columns))]
    if own.n > 1:
        # The table's own columns step aside, whatever their names, but for those that are needed here.
        aside = {c: n for c, n in zip(docs.columns, names, strict=True) if c not in ("text", "n_chars")}
        found, block, key = with_hits(docs.withColumnsRenamed(aside), own), None, ""
    else:
        aside, found, block, key = {}, docs, own.block(0), uuid.uuid4().hex
    keep = fresh(docs, "kinfold_keep")
    schema = T.StructType([*(T.StructField(aside.get(x.name, x.name), x.dataType) for x in docs.schema), T.StructField(keep, T.BooleanType())])

    def f(part, texts: list[bytes]) -> dict:
        new, kept = [], []
        column = lambda c: part.column(part.schema.get_field_index(c))
        if block is None:
            hits = [(list(zip(s[::2], s[1::2], strict=True)), n) for s, n in zip(column("kinfold_spans").to_pylist(), column("kinfold_words").to_pylist(), strict=True)]
        else:
            words = map(words_of, texts)
            hits = [(automaton(block, window, key).hits(w)[0], len(w)) for w in words]
        for text, (spans, n) in zip(texts, hits, strict=True):
            hit = sum(b - a for a, b in spans)
            kept.append(not hit or 100 * hit < coverage * n)
            new.append(without(text, spans) if hit else text)
        old = column("text")
        fresh_ = pa.array(new, pa.binary()).cast(pa.string())
        out = {"text": pc.if_else(old.is_null(), pa.scalar(None, pa.string()), fresh_), keep: kept}
        if "n_chars" in part.schema.names:
            now = pc.utf8_length(fresh_).cast(part.schema.field("n_chars").type)
            out["n_chars"] = pc.if_else(pc.equal(pc.fill_null(old, ""), fresh_), column("n_chars"), now)
        return out

    return map_texts(found, f, schema, as_bytes=True).where(keep).drop(keep).withColumnsRenamed({n: c for c, n in aside.items()})


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without these stretches of words, nor what stands between their words."""
    at = [m.span() for m in WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    out.append(text[last:])
    return b"".join(out)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark)),
win AS (SELECT DISTINCT item_id, least(n, 10) AS k, array_to_string(list_slice(w, i, i + least(n, 10) - 1), ' ') AS g FROM iw, unnest(range(1, n - least(n, 10) + 2)) AS t(i) WHERE n > 0),
ks AS (SELECT DISTINCT k FROM win),
dg AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM dw, ks, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
hit AS (SELECT doc_id, item_id, i, dg.k FROM dg JOIN win ON dg.g = win.g AND dg.k = win.k),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + k)) AS t(p) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',')) AS s FROM hit GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
