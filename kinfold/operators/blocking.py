"""Candidate generation: records that share a key become pairs, unless the key is too common.

A key carries its country, so a pair never crosses countries. Document frequencies count candidates (sources 2 and 3);
dropping keys over their cap before the join bounds what a key can multiply, on the candidates' side; a key that very many
records of source 1 have is dealt out to several tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..functions import vocabulary as V
from ..plans.session import dealt, stored
from . import features


def _pairs_of(a: Column) -> Column:
    """Unordered pairs of different places of an array, as 'x|y' with x first in order."""
    at = F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    both = F.flatten(F.transform(at, lambda p: F.transform(F.filter(at, lambda q: q["i"] > p["i"]), lambda q: F.concat(F.least(p["x"], q["x"]), F.lit("|"), F.greatest(p["x"], q["x"])))))
    return both


def _product(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(x, F.lit("|"), y))))


def _head(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


def _long(a: Column, n: int) -> Column:
    return F.filter(a, lambda x: F.length(x) >= n)


def _tagged(a: Column, kind: str) -> Column:
    return F.transform(a, lambda x: F.struct(F.lit(kind).alias("kt"), x.alias("key")))


def keys(df: DataFrame) -> DataFrame:
    """(src, entity_id, country, kt, key) of records in normal form; each key of a record once. kt: name of the type."""
    ct = _head(F.array_distinct(_long(F.col("core_tok"), 2)), 6)
    at = F.array_distinct(_long(F.col("addr_tok"), 3))
    an = _head(F.array_distinct("addr_num"), 3)
    base = df.select("src", "entity_id", "country", "concat", "state", ct.alias("ct"), at.alias("at"), an.alias("an"))
    c, a, n = F.col("ct"), F.col("at"), F.col("an")
    one = lambda ok, value: F.when(ok, F.array(value)).otherwise(F.array().cast("array<string>"))
    size = F.length("concat")
    of = {
        "nt": c, "np": _pairs_of(_head(c, 5)), "nc": one(size >= 5, F.substring("concat", 1, 8)), "ap": _product(n, _head(a, 4)), "at": _long(_head(a, 8), 4),
        "nn": _product(_head(c, 3), n), "nw": _product(_head(c, 3), _long(_head(a, 4), 4)), "aa": _pairs_of(_head(a, 5)),
        "ns": one((F.col("state") != "") & (size >= 4), F.concat(F.substring("concat", 1, 8), F.lit("|"), F.col("state"))), "nx": one(size >= 5, F.col("concat")),
    }
    all_ = F.concat(*(_tagged(F.array_distinct(of[k]), k) for k in V.KEY_TYPES))
    return base.select("src", "entity_id", "country", F.explode(all_).alias("k")).select("src", "entity_id", "country", "k.*")


def signals(df: DataFrame) -> DataFrame:
    """(src, entity_id, country, kt, key) of records in the plainer form: name words, 4-grams, postcode, house numbers."""
    post = F.when(F.col("a.postcode") != "", F.array("a.postcode")).otherwise(F.array().cast("array<string>"))
    of = {"name": F.col("n.tokens"), "gram": X.grams(F.col("n.despaced")), "postcode": post, "house": F.col("a.house_numbers")}
    all_ = F.concat(*(_tagged(F.array_distinct(_long(of[k], V.SIGNALS[k][1])), k) for k in V.SIGNALS))
    return df.select("src", "entity_id", "country", F.explode(all_).alias("k")).select("src", "entity_id", "country", "k.*")


def caps(scale: float = 1.0) -> dict[str, int]:
    return {k: max(2, int(c * scale)) for k, c in V.KEY_CAPS.items()}


def usable_keys(cand_keys: DataFrame, records: DataFrame, most: dict[str, int] | None = None) -> DataFrame:
    """(country, kt, key, df, w): keys of candidates within their cap, with weight ln(n) - ln(df), n by country."""
    n = records.where("src <> 1").groupBy("country").agg(F.count("*").alias("n"))
    cap = F.create_map(*(F.lit(x) for kv in (most or caps()).items() for x in kv))
    df = cand_keys.groupBy("country", "kt", "key").agg(F.count("*").alias("df")).where(F.col("df") <= cap[F.col("kt")])
    return df.join(n, "country").select("country", "kt", "key", "df", (F.log("n") - F.log("df")).alias("w"))


def usable_signals(cand: DataFrame, records: DataFrame) -> DataFrame:
    """(src, country, kt, key, df, w): postings of each source within max(1, min(share of its records, cap)); w: weight over the root of df."""
    n = records.where("src <> 1").groupBy("src", "country").agg(F.count("*").alias("n"))
    of = lambda i: F.create_map(*(F.lit(x) for k, v in V.SIGNALS.items() for x in (k, float(v[i]))))[F.col("kt")]
    df = cand.groupBy("src", "country", "kt", "key").agg(F.count("*").alias("df")).join(n, ["src", "country"])
    most = F.greatest(F.lit(1), F.least(F.floor(F.col("n") * of(0)), of(2).cast("long")))
    return df.where(F.col("df") <= most).select("src", "country", "kt", "key", "df", (of(3) / F.sqrt("df")).alias("w"))


#: Records of source 1 with one key that one task joins with the key's candidates.
HEAVY = 1 << 16


def paired(usable: DataFrame, all_keys: DataFrame) -> DataFrame:
    """usable with first: how many records of source 1 have the key. Keys that none has fall away."""
    on = ["country", "kt", "key"]
    return usable.join(all_keys.where("src = 1").groupBy(*on).agg(F.count("*").alias("first")), on)


def shared(all_keys: DataFrame, usable: DataFrame) -> DataFrame:
    """(s1_id, cand_id, src, kt, key, w) for each usable key that a record of source 1 shares with a candidate, by s1_id.

    usable has first. All candidates of a key, bounded by the cap, go as one list to the records of source 1 that have it, and
    are taken apart where these are: what follows by s1_id isn't shuffled as pairs. A key that very many records of source 1
    have is dealt out: its list goes to every part.
    """
    on = ["country", "kt", "key"]
    own = ["src", *on] if "src" in usable.columns else on
    a = all_keys.where("src = 1").select(F.col("entity_id").alias("s1_id"), *on)
    b = all_keys.where("src <> 1").select(F.col("entity_id").alias("cand_id"), "src", *on)
    listed = b.join(usable, own).groupBy("src", *on, "w", "first").agg(F.array_sort(F.collect_list("cand_id")).alias("l"))
    columns = ["s1_id", "src", "kt", "key", "w", "l"]
    lean, heavy = listed.where(F.col("first") <= HEAVY), usable.where(F.col("first") > HEAVY)
    out = a.join(lean, on).select(*columns)
    if not heavy.isEmpty():
        parts = heavy.groupBy(*on).agg(F.max(F.ceil(F.col("first") / HEAVY).cast("int")).alias("parts"))
        a = a.join(parts, on).withColumn("part", F.pmod(F.xxhash64("s1_id"), F.col("parts")).cast("int")).drop("parts")
        listed = listed.join(parts, on).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        out = out.unionByName(a.join(listed, [*on, "part"]).select(*columns))
    return dealt(out, "s1_id").select("s1_id", F.explode("l").alias("cand_id"), "src", "kt", "key", "w")


def scored(pairs: DataFrame, kinds: tuple[str, ...] = V.KEY_TYPES) -> DataFrame:
    """(s1_id, cand_id, src, a sum of weights for each kind, bscore)."""
    sums = [F.round(F.coalesce(F.sum(F.when(F.col("kt") == k, F.col("w"))), F.lit(0.0)), 6).alias(k) for k in kinds]
    return pairs.groupBy("s1_id", "cand_id", "src").agg(*sums, F.round(F.sum("w"), 6).alias("bscore"))


def top(df: DataFrame, score: str, n: int, by: tuple[str, ...] = ("s1_id",), rank: str | None = None) -> DataFrame:
    """The n rows of highest score in each group, ties by cand_id; rank: name of a column with their place, from 0."""
    out = df.withColumn("kinfold_rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), "cand_id"))).where(F.col("kinfold_rank") <= n)
    return out.withColumn(rank, F.col("kinfold_rank") - 1).drop("kinfold_rank") if rank else out.drop("kinfold_rank")


#: Pairs, counted once for each key, up to which a block goes by lists (shared); more are met in cells. Candidates and records
#: of source 1 of one cell, and sums that are held at a time for each kind.
PAIRS, CANDIDATES, FIRSTS, SUMS = 1 << 25, 1 << 17, 1 << 16, 1 << 20


def many(usable: DataFrame) -> bool:
    return (usable.select(F.sum(F.col("df") * F.col("first")).alias("n")).first()["n"] or 0) > PAIRS


def celled(all_keys: DataFrame, usable: DataFrame, kinds: tuple[str, ...], n: int | None, by: tuple[str, ...]) -> DataFrame:
    """scored() and top() of very many pairs, or for n None all pairs without scores, of which none is shuffled or written.

    A country's candidates and its records of source 1 are dealt into parts, and each pair of parts meets in a cell: a
    candidate's keys go to as many cells as there are parts of source 1. A cell holds its candidates by key and takes the
    other records one after another, so all keys of a pair are there at once, and only the first n of a record leave it.
    """
    on = ["country", "kt", "key"]
    own = ["src", *on] if "src" in usable.columns else on
    # Written first, so that numbers stay as they are.
    usable = stored(usable.select(*own, "w", F.monotonically_increasing_id().alias("k")))
    of = lambda k, names: stored(k.join(usable.select(*names, "k"), names).groupBy("src", "country", "entity_id").agg(F.collect_list("k").alias("keys")))
    # A record of source 1 has the keys of either source.
    first = of(all_keys.where("src = 1"), on)
    second = of(all_keys.where("src <> 1"), own)
    spark = usable.sparkSession
    a, b = ({r["country"]: r["count"] for r in x.groupBy("country").count().collect()} for x in (first, second))
    most = max(1, min(FIRSTS, math.ceil(sum(a.values()) / (4 * spark.sparkContext.defaultParallelism))))
    rows, cells = [], 0
    for c in sorted(a.keys() & b.keys()):
        i, j = math.ceil(a[c] / most), math.ceil(b[c] / CANDIDATES)
        rows.append((c, cells, i, j))
        cells += i * j
    grid = F.broadcast(spark.createDataFrame(rows, "country string, at int, is int, js int"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    part = lambda n: F.pmod(F.xxhash64("entity_id"), n).cast("int")
    i, j = F.col("is"), F.col("js")
    none = lambda kind: F.lit(None).cast(kind)
    kind = F.array_position(F.array(*map(F.lit, kinds)), F.col("kt")).cast("int") - 1
    weights = usable.groupBy("country", F.pmod("k", F.lit(64)).alias("some")).agg(F.collect_list("k").alias("keys"), F.collect_list("w").alias("ws"), F.collect_list(kind).alias("kinds"))
    at = F.col("at")
    sides = (
        weights.join(grid, "country").select(F.explode(F.transform(every(i * j), lambda x: at + x)).alias("cell"), F.lit(0).alias("side"), none("string").alias("id"), none("byte").alias("src"), "keys", "ws", "kinds"),
        second.join(grid, "country").select(F.explode(F.transform(every(i), lambda x: at + x * j + part(j))).alias("cell"), F.lit(1).alias("side"), F.col("entity_id").alias("id"), "src", "keys", none("array<double>").alias("ws"), none("array<int>").alias("kinds")),
        first.join(grid, "country").select(F.explode(F.transform(every(j), lambda x: at + part(i) * j + x)).alias("cell"), F.lit(2).alias("side"), F.col("entity_id").alias("id"), "src", "keys", none("array<double>").alias("ws"), none("array<int>").alias("kinds")),
    )
    dealt_out = sides[0].unionAll(sides[1]).unionAll(sides[2]).repartitionById(max(1, cells), F.col("cell")).sortWithinPartitions("cell", "side")
    scores = [] if n is None else [*kinds, "bscore"]
    apart, places = "src" in by, len(kinds)
    out = dealt_out.mapInArrow(lambda batches: meet(batches, places, n, apart, scores), ", ".join(["s1_id string", "cand_id string", "src byte", *(f"{c} double" for c in scores)]))
    return top(out, "bscore", n, by) if n is not None and any(r[3] > 1 for r in rows) else out


def lists_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a column of lists."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), lengths


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many as its length."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Cell:
    """Candidates by key. Rows come in the order of their sides: weights of keys, candidates, records of source 1."""

    def __init__(self, kinds: int, n: int | None, apart: bool, scores: list[str]):
        self.kinds, self.n, self.apart, self.scores = kinds, n, apart, scores
        self.given: list[list] = [[], []]
        self.ready = False

    def take(self, side: int, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if side < 2:
            self.given[side].append(rows)
            return
        if not self.ready:
            self.build()
        size = max(1, SUMS // max(1, len(self.ids)))
        for i in range(0, rows.num_rows, size):
            yield from self.meet(rows.slice(i, size))

    def build(self) -> None:
        self.ready = True
        u, b = (pa.Table.from_batches(x) if x else None for x in self.given)
        column = lambda t, c: t[c].combine_chunks() if t is not None else pa.array([], "list<int64>")
        self.given = [[], []]
        keys, of = lists_of(column(u, "keys"))[0], np.argsort(lists_of(column(u, "keys"))[0])
        self.keys, self.w, self.kind = keys[of], lists_of(column(u, "ws"))[0][of], lists_of(column(u, "kinds"))[0][of]
        if b is None:
            self.ids, self.src, self.starts, self.post = pa.array([], "string"), np.zeros(0, np.int8), np.zeros(len(keys) + 1, np.int64), np.zeros(0, np.int64)
            return
        # Places of candidates are in the order of their ids, which decides ties.
        b = b.sort_by("id")
        self.ids, self.src = b["id"].combine_chunks(), b["src"].to_numpy()
        keys, lengths = lists_of(b["keys"].combine_chunks())
        at = np.searchsorted(self.keys, keys)
        self.post = np.repeat(np.arange(len(lengths)), lengths)[np.argsort(at, kind="stable")]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(self.keys)))])

    def meet(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        g, m = rows.num_rows, len(self.ids)
        keys, lengths = lists_of(rows["keys"])
        at, row = np.searchsorted(self.keys, keys), np.repeat(np.arange(g), lengths)
        hit, sums = np.zeros(g * m, dtype=bool), []
        for k in range(self.kinds):
            own = self.kind[at] == k
            key, times = at[own], self.starts[at[own] + 1] - self.starts[at[own]]
            cells = self.post[runs(self.starts[key], times)] + np.repeat(row[own] * m, times)
            hit[cells] = True
            if self.scores:
                sums.append(np.bincount(cells, np.repeat(self.w[key], times), g * m) if len(cells) else None)
        found = np.flatnonzero(hit)
        if not self.scores:
            yield from self.out(rows, found, [])
            return
        of = lambda x, c: np.floor(x[c] * 1e6 + 0.5) / 1e6 if x is not None else np.zeros(len(c))
        total = np.zeros(g * m)
        for x in sums:
            if x is not None:
                total += x
        score, best = of(total, found), []
        ends = np.searchsorted(found, np.arange(g + 1) * m)
        for i in range(g):
            own, s = found[ends[i] : ends[i + 1]], score[ends[i] : ends[i + 1]]
            sources = self.src[own - i * m] if self.apart else None
            for group in np.unique(sources) if self.apart else (None,):
                c, x = (own[sources == group], s[sources == group]) if self.apart else (own, s)
                if len(c) > self.n:
                    near = x >= np.partition(x, len(x) - self.n)[len(x) - self.n]
                    c, x = c[near], x[near]
                best.append(c[np.argsort(-x, kind="stable")[: self.n]])
        chosen = np.concatenate(best) if best else found[:0]
        yield from self.out(rows, chosen, [*(of(x, chosen) for x in sums), of(total, chosen)])

    def out(self, rows: pa.RecordBatch, cells: np.ndarray, scores: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        m = max(1, len(self.ids))
        for i in range(0, len(cells), 1 << 17):
            c = cells[i : i + (1 << 17)]
            columns = [rows["id"].take(pa.array(c // m)), self.ids.take(pa.array(c % m)), pa.array(self.src[c % m], "int8"), *(pa.array(x[i : i + len(c)]) for x in scores)]
            yield pa.RecordBatch.from_arrays(columns, ["s1_id", "cand_id", "src", *self.scores])


def meet(batches: Iterator[pa.RecordBatch], kinds: int, n: int | None, apart: bool, scores: list[str]) -> Iterator[pa.RecordBatch]:
    """The pairs of sorted rows (cell, side, id, src, keys, ws, kinds)."""
    cell, held = -1, None
    for batch in batches:
        number, side = batch["cell"].to_numpy(), batch["side"].to_numpy()
        edges = np.flatnonzero((np.diff(number) != 0) | (np.diff(side) != 0)) + 1
        for i, k in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            if i == k:
                continue
            if number[i] != cell:
                cell, held = number[i], Cell(kinds, n, apart, scores)
            yield from held.take(int(side[i]), batch.slice(i, k - i))


def block(records: DataFrame, depth: int = 120, scale: float = 1.0) -> DataFrame:
    """Shortlist by summed weights of all key types, over records in normal form. Keys are made once and written."""
    k = stored(keys(records))
    usable = stored(paired(usable_keys(k.where("src <> 1"), records, caps(scale)), k))
    if many(usable):
        return celled(k, usable, V.KEY_TYPES, depth, ("s1_id",))
    return top(scored(shared(k, usable)), "bscore", depth)


def block_plain(records: DataFrame, n: int = 25) -> DataFrame:
    """Shortlist of each source by rarity of shared signals, over records in the plainer form."""
    k = stored(signals(records))
    usable = stored(paired(usable_signals(k.where("src <> 1"), records), k))
    if many(usable):
        return celled(k, usable, tuple(V.SIGNALS), n, ("s1_id", "src"))
    return top(scored(shared(k, usable), tuple(V.SIGNALS)), "bscore", n, ("s1_id", "src"))


def union_candidates(records: DataFrame) -> DataFrame:
    """(s1_id, cand_id, src): every candidate that shares any signal within the caps, unscored."""
    k = stored(signals(records))
    usable = stored(paired(usable_signals(k.where("src <> 1"), records), k))
    if many(usable):
        return celled(k, usable, tuple(V.SIGNALS), None, ())
    return shared(k, usable).select("s1_id", "cand_id", "src").distinct()


RERANK = ("r_bs", "r_brank", "r_name", "r_addr", "r_addr_missing", "r_num_conflict", "r_num_match")


def rerank_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """pairs with the features of RERANK: place and share of the block score, word-set similarities, numbers."""
    from ..functions.similarity import scores

    texts = ("core_str", "addr_str", "addr_num")
    held = 2 * features.held_by(records)
    side = lambda own, key, x: own.select(F.col("entity_id").alias(key), *(F.col(c).alias(f"{c}_{x}") for c in texts))
    both = F.size(F.array_intersect("addr_num_a", "addr_num_b"))
    flag = lambda c: c.cast("double")

    def make(p: DataFrame, a: DataFrame, b: DataFrame, slices: int) -> DataFrame:
        p = features.met(p, side(a, "s1_id", "a"), side(b, "cand_id", "b"), held, slices)
        p = p.withColumn("kinfold_s", scores({"name": ("tset", F.col("core_str_a"), F.col("core_str_b")), "addr": ("tset", F.col("addr_str_a"), F.col("addr_str_b"))}))
        return p.withColumns({
            "r_name": F.col("kinfold_s.name") / 100, "r_addr": F.col("kinfold_s.addr") / 100, "r_addr_missing": flag(F.col("addr_str_b") == ""),
            "r_num_conflict": flag((F.size("addr_num_a") > 0) & (F.size("addr_num_b") > 0) & (both == 0)), "r_num_match": flag(both > 0),
        }).drop("kinfold_s", *(f"{c}_{x}" for c in texts for x in "ab"))

    # Texts are gone before pairs are ranked.
    w = W.partitionBy("s1_id")
    return features.by_slices(pairs, records, held, make).withColumns({
        "r_bs": F.col("bscore") / F.max("bscore").over(w), "r_brank": F.log1p(F.row_number().over(w.orderBy(F.desc("bscore"), "cand_id"))),
    })


def rerank(pairs: DataFrame, weights: dict[str, float], n: int | None = 25) -> DataFrame:
    """pairs with rscore (a linear score) and brank (place, from 0); the first n of each record, or all."""
    linear = F.lit(weights.get("bias", 0.0))
    for f in RERANK:
        linear = linear + F.col(f) * F.lit(weights.get(f, 0.0))
    return top(pairs.withColumn("rscore", F.round(linear, 6)), "rscore", n or 1 << 30, rank="brank")


def rerank_weights(labelled: DataFrame) -> dict[str, float]:
    """Weights of the linear score by logistic regression over pairs with the features of RERANK and y."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=list(RERANK), outputCol="features", handleInvalid="keep").transform(labelled)
    m = LogisticRegression(labelCol="y", regParam=1e-4, maxIter=100).fit(v)
    return {"bias": float(m.intercept), **dict(zip(RERANK, map(float, m.coefficients.toArray()), strict=True))}
