"""N-gram Jaccard join by token-combination prefixes.

A document's set is that of its distinct word shingles. All sets are sorted in one global order: rare shingles first,
frequent ones last, by hash within a class. Two sets whose similarity reaches the threshold can miss only few of each
other's shingles, so their beginnings (prefixes) must meet. A rare shingle of the prefix is indexed by itself. Where the
rare ones don't suffice, the prefix is extended into the frequent ones, which fall into groups by hash, and is indexed by
pairs of shingles of a group: the extension goes on until missing as many shingles as the threshold allows would still
leave two in some group. Sets that meet are then verified over all their shingles.

Frequent shingles: each task counts its shingles block by block and passes on those that occur twice in a block; sums
over all tasks pick at most MAX_FREQUENT. Any choice of classes gives right results, so this summary needs no exact
counts, and its size, which is sent to all tasks, is bounded.

What would be all pairs of a large group is avoided in three ways. Equal sets are one class, by digest. Within an index
entry, members are first compared with one of them (the smallest), each document with the one that it meets most often;
links found make components, and rounds of this go on while they find many. Only for entries that still hold
several components, pairs across components are compared, after a filter that bounds their overlap by counts over slices
of the hash space. No link between different sets is lost: every pair that meets is linked, in one component, or compared.
Entries whose documents are all in one component stay so and are left out of later rounds. Classes, entries and documents
with a large share of all rows (known from a sample: which way a row is joined decides nothing else) are joined by
broadcast, so that no task gets all rows of one.

Defined cases: null and empty texts have an empty set and are linked with nothing; a text with fewer words than a shingle
has the whole sequence as its only one; rows with the same doc_id count as one document and are linked; rows without a
doc_id are linked with nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, TIMES, WordHashes, cut, discard, keeps, map_columns, map_texts, mix, shingle_hashes, skewed, table
from .graph import components

SHINGLE, PERCENT = 3, 90
#: Bound on the frequent shingles, times that one is counted before it is frequent, shingles in a block of counting.
MAX_FREQUENT, FREQUENT, BLOCK = 1 << 17, 24, 1 << 21
#: Rows up to which a list of ids is sent to all tasks; beyond, the join shuffles.
SMALL = 1 << 19
SLICES = 128
#: Documents of an index entry that are compared in one task.
TOGETHER = 1_000
#: Rounds of comparing with one member, at most, before all pairs across components are compared; a round that finds under
#: one in FEW of the links so far is the last.
ROUNDS, FEW = 6, 50
#: Entries before it that a row of an entry knows.
EARLIER = [f"before{k}" for k in range(4)]

#: An entry, or a document, is hot with more than one in so many rows; shingles of a set that may go to all tasks.
HOT_ENTRIES, HOT_SETS, HOT_SIZE = 1000, 100, 1 << 16

EDGES = np.arange(SLICES, dtype=np.uint64) << np.uint64(57)
_hashes = WordHashes()
keeps(__name__, _hashes.place.clear)


def shingle_set(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    h = np.sort(shingle_hashes(_hashes(text.translate(LOWER).split()), n))
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def sketch(h: np.ndarray) -> bytes:
    """How many of the hashes lie in each slice of the hash space, in a byte each; 255 stands for any number from 255."""
    return np.minimum(np.diff(np.searchsorted(h, EDGES), append=len(h)), 255).astype(np.uint8).tobytes()


def bits(h: np.ndarray) -> bytes:
    """A set of bits, the low bits of each hash, of some four places or more a hash."""
    size = 1 << max(3, (4 * len(h) - 1).bit_length())
    out = np.zeros(size, dtype=np.uint8)
    out[(h & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def facts(docs: DataFrame, shingle: int) -> DataFrame:
    """kind 0: (doc_id, n, d1, d2, sketch, bits) of a document; kind 1: (d1: shingle, n: times counted)."""
    from xxhash import xxh3_128_digest

    def run(parts):
        buffer, held, seen = [], 0, set()

        def counts():
            keys, times = np.unique(np.concatenate(buffer), return_counts=True)
            keys, times = keys[times > 1].view(np.int64), times[times > 1]
            for at in range(0, len(keys), 20_000):
                k, t = keys[at : at + 20_000], times[at : at + 20_000]
                none = pa.nulls(len(k), pa.int64())
                yield {"kind": pa.array(np.ones(len(k), np.int8)), "doc_id": none, "n": pa.array(t.astype(np.int64)), "d1": pa.array(k), "d2": none, "sketch": pa.nulls(len(k), pa.binary()), "bits": pa.nulls(len(k), pa.binary())}

        for part in parts:
            rows = []
            for i, x in zip(part["doc_id"], part["text"], strict=True):
                h = shingle_set(bytes(x or b""), shingle)
                d = xxh3_128_digest(h.tobytes())
                d1, d2 = np.frombuffer(d, dtype=np.int64).tolist()
                rows.append((0, i, len(h), d1, d2, sketch(h), bits(h)))
                if d1 not in seen:
                    seen.add(d1)
                    buffer.append(h)
                    held += len(h)
                if held >= BLOCK:
                    yield from counts()
                    buffer, held, seen = [], 0, set()
            yield dict(zip(("kind", "doc_id", "n", "d1", "d2", "sketch", "bits"), map(list, zip(*rows, strict=True)), strict=True))
        if buffer:
            yield from counts()

    return map_columns(docs.select("doc_id", F.col("text").cast("binary").alias("text")), run, "kind byte, doc_id long, n long, d1 long, d2 long, sketch binary, bits binary")


def least_overlap(n: np.ndarray | int, percent: int):
    """Shingles that a set of n shares at least with any set that it is linked with."""
    return (percent * n + 99) // 100


def size_classes(n: int, percent: int) -> list[int]:
    """Powers of two that the larger set of a linked pair with this one may have."""
    return list(range(n.bit_length() - 1, (100 * n // percent).bit_length()))


def signatures(h: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Index entries of a set. Sets too small to be linked with another have none."""
    n = len(h)
    if not n or n == 100 * n // percent:
        return h[:0]
    need = n - least_overlap(n, percent) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        often = frequent[at] == h
        rare = h[~often][:need]
    else:
        return h[:need]
    if len(rare) == need:
        return rare
    out, many = [rare], h[often]
    for j in size_classes(n, percent):
        groups = np.uint64(max(1, (1 << j) // 32))
        g = mix(many) % groups
        first = np.ones(len(many), dtype=np.int64)
        first[np.unique(g, return_index=True)[1]] = 0
        stop = int(np.searchsorted(np.cumsum(first), need - len(rare))) + 1
        order = np.argsort(g[:stop], kind="stable")
        gs, hs = g[:stop][order], many[:stop][order]
        for step in range(1, len(hs)):
            same = gs[step:] == gs[:-step]
            if not same.any():
                break
            a, b = hs[:-step][same], hs[step:][same]
            with np.errstate(over="ignore"):
                out.append(mix(mix(np.minimum(a, b) + np.uint64(j + 1)) * np.uint64(3) + np.maximum(a, b)))
    return np.unique(np.concatenate(out))


def with_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs semi- or anti-joined with a table of ids, sent to all tasks only if it is small."""
    small = ids.limit(SMALL + 1).count() <= SMALL
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", how)


def index(docs: DataFrame, frequent: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """(sig, doc, n: size of the set) for each entry of each document."""

    def run(parts):
        for part in parts:
            sets = [shingle_set(bytes(x or b""), shingle) for x in part["text"]]
            got = [signatures(h, frequent, percent) for h in sets]
            times = [len(x) for x in got]
            ids, sizes = np.repeat(np.array(part["doc_id"], dtype=np.int64), times), np.repeat(np.array([len(h) for h in sets], dtype=np.int32), times)
            yield {"sig": pa.array(np.concatenate(got).view(np.int64)), "doc": pa.array(ids), "n": pa.array(sizes)}

    return map_columns(docs.select("doc_id", F.col("text").cast("binary").alias("text")), run, "sig long, doc long, n int")


def hot_values(rows: DataFrame, column: str, share: int) -> list[int]:
    """Values that more than about one in share of the rows have, by a sample of some 1,000 rows for each."""
    n = rows.count()
    sample = rows.sample(min(1.0, 1000 * share / n), seed=1) if n > 1000 * share else rows
    got = sample.groupBy(column).agg(F.count("*").alias("times")).where(F.col("times") * share > min(n, 1000 * share)).where("times > 100")
    return sorted(r[0] for r in got.orderBy(F.desc("times"), column).limit(2 * share).collect())


def joined_apart(rows: DataFrame, table_: DataFrame, on: str, hot: list[int]) -> DataFrame:
    """rows joined with a table of unique keys; what it has of the hot ones goes to all tasks. Both are read twice if there are any."""
    if not hot:
        return rows.join(table_, on)
    here = F.col(on).isin(hot)
    return rows.where(~here).join(table_, on).unionByName(rows.where(here).join(F.broadcast(table_.where(here)), on))


def folded(bits: bytes, size: int) -> int:
    """The bits as a number, of so many bytes: those of the same place modulo size are one."""
    x, k = int.from_bytes(bits, "little"), 8 * len(bits)
    while k > 8 * size:
        k //= 2
        x = (x >> k) | (x & ((1 << k) - 1))
    return x


def overlapping(nu: int, nv: int, a: bytes, b: bytes, percent: int) -> bool:
    """Whether sizes and bits leave the threshold within reach: a bit that one set alone has is an element that it alone has."""
    size = min(len(a), len(b))
    x, y = folded(a, size), folded(b, size)
    most = min(nu - x.bit_count(), nv - y.bit_count()) + (x & y).bit_count()
    return 100 * most >= percent * (nu + nv - most)


def in_bits(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose bits leave the threshold within reach. pairs is read more than once."""

    def side(x: str) -> tuple[DataFrame, str, list[int]]:
        return reps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}")), x, large(x)

    def large(x: str) -> list[int]:
        """Hot documents; only bits of a bounded size may go to all tasks."""
        found = hot_values(pairs, x, HOT_SETS)
        return [r[0] for r in reps.where(F.col("rep").isin(found)).where(F.col("n") <= HOT_SIZE).select("rep").distinct().collect()] if found else []

    def run(parts):
        for p in parts:
            ok = [k for k, x in enumerate(zip(p["nu"], p["nv"], p["bu"], p["bv"], strict=True)) if overlapping(*x, percent)]
            yield {k: [p[k][i] for i in ok] for k in "uv"}

    both = joined_apart(joined_apart(pairs, *side("u")), *side("v"))
    return map_columns(both, run, "u long, v long").distinct()


def linked(docs: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets reach the threshold, compared in full. pairs is read more than once."""
    ids = pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct()

    def f(_, texts: list[bytes]) -> dict:
        got = [shingle_set(x, shingle) for x in texts]
        ends = np.cumsum([0, *map(len, got)])
        return {"h": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(got).view(np.int64)))}

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("h", T.ArrayType(T.LongType()))])
    sets = cut(map_texts(with_ids(docs.select("doc_id", "text"), ids, "left_semi"), f, schema, as_bytes=True), "sets")

    def hot(side: str) -> list[int]:
        """Hot documents; only sets of a bounded size may go to all tasks."""
        found = hot_values(pairs, side, HOT_SETS)
        return [r[0] for r in sets.where(F.col("doc_id").isin(found)).where(F.size("h") <= HOT_SIZE).select("doc_id").distinct().collect()] if found else []

    a, b = sets.select(F.col("doc_id").alias("u"), F.col("h").alias("a")), sets.select(F.col("doc_id").alias("v"), F.col("h").alias("b"))
    both = joined_apart(joined_apart(pairs, a, "u", hot("u")), b, "v", hot("v")).withColumn("o", F.size(F.array_intersect("a", "b")))
    out = cut(both.where(100 * F.col("o") >= percent * (F.size("a") + F.size("b") - F.col("o"))).select("u", "v").distinct(), "links")
    discard(docs.sparkSession, sets)
    return out


def reachable(nu: np.ndarray, nv: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and sketches leave the threshold within reach, row by row."""
    full = ((a == 255) & (b == 255)).any(1)
    least = np.where(a == 255, b, np.where(b == 255, a, np.minimum(a, b)))
    most = np.where(full, np.minimum(nu, nv), least.sum(1, dtype=np.int64))
    return (100 * nu >= percent * nv) & (100 * nv >= percent * nu) & (100 * most >= percent * (nu + nv - most))


def sketches_of(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(-1, SLICES)


def within_reach(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The rows of pairs (u, v, ...) whose sizes and sketches leave the threshold within reach."""
    names = pairs.columns
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").where(f"100 * nu >= {percent} * nv and 100 * nv >= {percent} * nu")

    def run(parts):
        for p in parts:
            ok = np.flatnonzero(reachable(np.array(p["nu"]), np.array(p["nv"]), sketches_of(p["su"]), sketches_of(p["sv"]), percent)).tolist() if p["u"] else []
            yield {k: [p[k][i] for i in ok] for k in names}

    return map_columns(both, run, pairs.schema)


def close_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """(u, v): documents of different components that share an entry (sig, doc, label, n, sketch, before0, ...), within reach.

    The rows of an entry lie next to each other; each is compared with those behind it, all entries of a batch together,
    and only pairs within reach are passed on. before: the entries of the same set that come before this one in order (0:
    none); two sets that have one of these in common are compared there, so copies that share many entries are compared
    in the first and a few more, not in all of them. An entry of more than TOGETHER documents is dealt out to blocks, and each
    two of its blocks are compared on their own, so no task holds a large group.
    """
    sizes = entries.groupBy("sig").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("blocks")).where("blocks > 1")
    dealt = entries.join(sizes, "sig", "left").withColumn("own", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("doc"), F.col("blocks"))).otherwise(0).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))))
    dealt = dealt.select("sig", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "doc", "label", "n", "sketch", *EARLIER)
    keys = ["sig", "a", "b"]

    def compared(rows: dict[str, list]) -> dict[str, list]:
        col = {k: np.array(rows[k], dtype=np.int64) for k in ("sig", "a", "b", "own", "doc", "label", "n", *EARLIER)}
        s, out = sketches_of(rows["sketch"]), []
        at, step = np.arange(len(col["sig"])), 0
        while True:
            step += 1
            at = at[at + step < len(col["sig"])]
            at = at[np.logical_and.reduce([col[k][at] == col[k][at + step] for k in keys])]
            if not len(at):
                break
            to = at + step
            # Two documents of one block are compared where the block meets itself.
            ok = (col["label"][at] != col["label"][to]) & (col["doc"][at] != col["doc"][to]) & ((col["a"][at] == col["b"][at]) | (col["own"][at] != col["own"][to]))
            i, j = at[ok], to[ok]
            met = np.zeros(len(i), dtype=bool)
            for x in EARLIER:
                own = col[x][i]
                # Not 0, and not this entry itself, which one document may have twice.
                real = (own != 0) & (own != col["sig"][i])
                for y in EARLIER:
                    met |= real & (own == col[y][j])
            i, j = i[~met], j[~met]
            ok = reachable(col["n"][i], col["n"][j], s[i], s[j], percent)
            u, v = col["doc"][i[ok]], col["doc"][j[ok]]
            out.append(np.stack([np.maximum(u, v), np.minimum(u, v)], 1))
        u, v = (np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), dtype=np.int64)).T.tolist()
        return {"u": u, "v": v}

    def run(parts):
        held: dict[str, list] = {}
        for p in parts:
            held = {k: held[k] + v for k, v in p.items()} if held else p
            n = len(held["sig"])
            last = n
            while last and all(held[k][last - 1] == held[k][n - 1] for k in keys):
                last -= 1
            if last >= 4000:
                yield compared({k: v[:last] for k, v in held.items()})
                held = {k: v[last:] for k, v in held.items()}
        if held and held["sig"]:
            yield compared(held)

    return map_columns(dealt.repartition(*keys).sortWithinPartitions(*keys), run, "u long, v long").distinct()


def join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs (doc_id, text): n_shingles, class_id (smallest doc_id with the same set), component_id."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    both = cut(facts(docs, shingle), "facts")
    top = both.where("kind = 1").groupBy("d1").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "d1").limit(MAX_FREQUENT).select("d1").toArrow()
    frequent = np.sort(top.column("d1").to_numpy().view(np.uint64))

    rows = both.where("kind = 0").select("doc_id", "n", "d1", "d2", "sketch", "bits")
    classes = cut(rows.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias(TIMES)), "classes")
    total = classes.agg(F.sum(TIMES)).first()[0] or 0
    classed = skewed(rows, classes, ["d1", "d2", "n"], total, "left")
    own = [F.when(F.col("doc_id") == F.col("rep"), F.col(x)).alias(x) for x in ("sketch", "bits")]
    members = cut(classed.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep"), *own), "members")
    per_id = members.where("rep is not null").groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("rep")).cast("int")).alias("is_rep"), F.min("rep").alias("least"), F.max("rep").alias("most"), F.count("*").alias(TIMES))
    several = cut(per_id.where("least <> most").select("doc_id", "least", TIMES), "several")
    same_id = skewed(members, several, ["doc_id"], total).where("rep <> least").select(F.col("rep").alias("u"), F.col("least").alias("v"))
    # A row for each set that a doc_id with several stands for: two documents are within reach if any of their sets are.
    reps = cut(members.where("doc_id = rep").select("rep", "n", "sketch", "bits").distinct(), "sketches")

    copies = per_id.where("is_rep = 0").select("doc_id")
    entries = cut(index(with_ids(docs.where("doc_id is not null"), copies, "left_anti"), frequent, shingle, percent), "index")
    # An entry's share of all entries can only grow as others settle; those that are hot now are treated so throughout.
    hot = hot_values(entries, "sig", HOT_ENTRIES)

    def within(rows: DataFrame, ends) -> DataFrame:
        """rows (sig, ...) joined with what ends(rows) has for their entries."""
        if not hot:
            return rows.join(ends(rows), "sig")
        here, rest = rows.where(F.col("sig").isin(hot)), rows.where(~F.col("sig").isin(hot))
        return rest.join(ends(rest), "sig").unionByName(here.join(F.broadcast(ends(here)), "sig"))

    met = cut(within(entries, lambda x: x.groupBy("sig").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high").select("sig")), "met")
    edges = cut(same_id, "links")
    discard(spark, both, classes, several, entries)

    label = components(edges)
    tried: list[DataFrame] = []
    links = 0

    def compare(pairs: DataFrame) -> int:
        nonlocal edges, label
        near = cut(in_bits(pairs, reps, percent), "near")
        found = linked(docs, near, shingle, percent)
        discard(spark, near)
        n = found.count()
        if n:
            old = edges, label
            edges = cut(edges.unionByName(found), "links")
            label = components(edges)
            discard(spark, *old)
        discard(spark, found)
        return n

    def unsettled(met: DataFrame) -> DataFrame:
        """(sig, doc, n, label, low, high) of the entries that still hold several components: low and high are (label, doc, n)."""
        now = met.select("sig", "doc", "n").join(label.select(F.col("node").alias("doc"), F.col("root").alias("label")), "doc", "left").select("sig", "doc", "n", F.coalesce("label", "doc").alias("label"))
        ends = lambda x: x.groupBy("sig").agg(F.min(F.struct("label", "doc", "n")).alias("low"), F.max(F.struct("label", "doc", "n")).alias("high")).where("low.label <> high.label")
        out = cut(within(now, ends), "met")
        discard(spark, met)
        return out

    for step in range(ROUNDS):
        met = unsettled(met)
        center = "high" if step % 2 else "low"
        fits = f"label <> {center}.label AND 100 * n >= {percent} * {center}.n AND 100 * {center}.n >= {percent} * n"
        votes = met.where(fits).groupBy(F.col("doc").alias("u"), F.col(f"{center}.doc").alias("v")).agg(F.count("*").alias("times"))
        for old in tried:
            votes = votes.join(old, ["u", "v"], "left_anti")
        near = within_reach(votes, reps, percent)
        tried.append(cut(near.groupBy("u").agg(F.max_by("v", F.struct("times", -F.col("v"))).alias("v")), "pairs"))
        n = compare(tried[-1])
        links += n
        if FEW * n <= links:
            break
    met = unsettled(met)
    order = Window.partitionBy("doc", "n").orderBy("sig")
    earlier = {x: F.coalesce(F.lag("sig", k + 1).over(order), F.lit(0)) for k, x in enumerate(EARLIER)}
    info = met.select("sig", "doc", "label", "n").withColumns(earlier).join(reps.select(F.col("rep").alias("doc"), F.col("n").cast("int").alias("n"), "sketch"), ["doc", "n"])
    last = cut(close_pairs(info, percent), "pairs")
    compare(last)
    discard(spark, met, last, reps, edges, *tried)
    out = members.join(label.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("root", "rep", "doc_id").alias("component_id"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs without those that another document of their component, with a smaller doc_id, stands for."""
    found = join(docs, shingle, percent)
    rest = docs.where("doc_id is not null")
    kept = with_ids(rest, found.where("doc_id <> component_id").select("doc_id").distinct(), "left_anti")
    twice = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    if twice.isEmpty():
        out = kept
    else:
        out = with_ids(kept, twice, "left_anti").unionByName(with_ids(kept, twice, "left_semi").dropDuplicates(["doc_id"]))
    return out.unionByName(docs.where("doc_id is null"))


OP4_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(list_slice(w, i, i + {SHINGLE} - 1), ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * o >= {PERCENT} * (x.n + y.n - o)),
two AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach AS (SELECT DISTINCT u AS a, u AS b FROM two UNION SELECT a, v FROM reach JOIN two ON u = b),
c AS (SELECT a, min(b) AS root FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON a = doc_id
"""
