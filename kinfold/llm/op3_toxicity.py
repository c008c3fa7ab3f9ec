"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, accents and invisible characters off, homoglyphs to Latin letters, letters that are
set apart put together, digits and signs inside words to the letters that they stand for. An Aho-Corasick automaton then
finds the entries of the lexicon (word beginnings and whole words) and the exception phrases (neighbours that make an
entry harmless). The weights of all entries, but those of words inside an exception phrase, are summed and normalised by
length; a logistic curve over the sum and the normalised sum gives the score.

Everything is learned from labelled rows that aren't held out: entries with their weights, where entry and label depend on
each other beyond chance, then exceptions and the curve. How much an entry has to say at least (SETTINGS) is chosen by
training on one half of these rows and measuring the loss on the other. Bounds, all of them parameters of the model:
MAX_TRAIN labelled rows are used, chosen by a hash of doc_id; the lexicon has MAX_ENTRIES entries at most, those that
depend on the label most, and as many exception phrases at most, the most frequent ones; ties go by the text.

Defined cases: null and empty texts have no entries and get the score of a text without any; texts are scored whole;
repeated rows give repeated results; an empty table gives an empty result; without labels of both kinds the score is 0.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, discard, fresh, map_columns, map_texts, table

#: Bounds on the labelled rows that train the model, and on the entries of the lexicon (and on its exceptions).
MAX_TRAIN, MAX_ENTRIES = 20_000, 1 << 16
#: Log odds that an entry has at least; training chooses one.
SETTINGS = (1.2, 1.6, 2.0, 2.6)

#: Letters that look like a Latin one.
LOOKALIKES = {
    "a": "аαɑᴀ", "b": "вβʙ", "c": "сᴄ", "d": "ԁđᴅ", "e": "еεᴇ", "f": "ꜰ", "g": "ɡցɢ", "h": "һнհʜ", "i": "іιıɩɪ", "j": "јᴊ", "k": "кκᴋ", "l": "łʟ", "m": "мᴍ",
    "n": "нոɴ", "o": "оοօøᴏ", "p": "рρᴘ", "q": "ԛ", "r": "гʀ", "s": "ѕꜱ", "t": "тτᴛ", "u": "υսᴜ", "v": "νѵᴠ", "w": "ѡԝᴡ", "x": "хχ", "y": "уʏ", "z": "ᴢ", "ss": "ß", "ae": "æ", "oe": "œ",
}
#: Digits and signs that stand for letters inside a word. 1 stands for i or l; fold() writes l as i everywhere.
LEET = str.maketrans("0134578@$!", "oieastbasi")
#: Characters without any width: soft hyphen, joiners, direction marks.
INVISIBLE = "\u00ad\u034f\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\ufeff"
FOLD = str.maketrans({c: latin for latin, own in LOOKALIKES.items() for c in own} | dict.fromkeys(INVISIBLE))
MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
#: Three or more single letters with one and the same sign between them; a bar in a short word.
SPELLED = re.compile(r"(?<![^\W_])[^\W\d_]([-.*_|/~+ ])[^\W\d_](?:\1[^\W\d_])+(?![^\W_])")
BARRED = re.compile(r"(?<![^\W_|])([^\W\d_]{1,3})\|([^\W\d_]{1,3})(?![^\W_|])")
#: Entries that a task counts before it passes them on.
PASS_ON = 200_000
TOKEN = re.compile(r"[^\W_]+(?:[@$!]+[^\W_]+)*|[@$][^\W_]+")
MIXED = re.compile(r"[a-z]*(?:[a-z][0134578@$!]+|[0134578@$!]+[a-z])[a-z0-9@$!]*")


def fold(text: str) -> list[str]:
    """Words of a text in the form that the lexicon has."""
    low = text.lower()
    if not low.isascii():
        low = MARKS.sub("", unicodedata.normalize("NFKD", low.translate(FOLD)).lower())
    low = SPELLED.sub(lambda m: m[0].replace(m[1], ""), low)
    if "|" in low:
        low = BARRED.sub(r"\1i\2", low)
    words = TOKEN.findall(low.replace("l", "i"))
    return [w if w.isalpha() else w.translate(LEET) if MIXED.fullmatch(w) else w for w in words]


def entries_of(words: set[str], most: int = 8) -> set[str]:
    """Candidates for the lexicon: beginnings of 3 to 8 letters, and whole words (with a blank behind)."""
    out = set()
    for w in words:
        if len(w) >= 3:
            out.add(w + " ")
            out.update(w[:n] for n in range(3, min(len(w), most) + 1))
    return out


class Lexicon:
    """weights: by entry; exceptions: two words, of which one begins with an entry, that excuse both."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], curve: tuple[float, float, float]):
        self.weights, self.exceptions, self.curve, self.auto = weights, exceptions, curve, None

    def __getstate__(self):
        return self.__dict__ | {"auto": None}

    def automaton(self):
        import ahocorasick

        if self.auto is None:
            self.auto = ahocorasick.Automaton()
            for w, x in self.weights.items():
                self.auto.add_word(f" {w}", (len(w) + 1, x, 0))
            for w in self.exceptions:
                self.auto.add_word(f" {w} ", (len(w) + 2, 0.0, w.index(" ") + 1))
            self.auto.make_automaton()
        return self.auto

    def weight(self, word: str) -> float:
        """The largest weight of an entry that the word begins with."""
        return max([self.weights.get(f"{word} ", 0.0), *(self.weights.get(word[:k], 0.0) for k in range(3, min(len(word), 8) + 1))])

    def evidence(self, words: list[str]) -> tuple[float, float]:
        """(log of the sum of weights, log of the sum for 1,000 words), each from 0."""
        if not words or not self.weights:
            return 0.0, 0.0
        # Matches are known by the place of the blank before their first word.
        found, excused = [], set()
        for end, (size, x, second) in self.automaton().iter(f" {' '.join(words)} "):
            at = end - size + 1
            if second:
                excused.update((at, at + second))
            else:
                found.append((at, x))
        total = sum(x for at, x in found if at not in excused)
        return math.log1p(total), math.log1p(1000 * total / (len(words) + 50))

    def score(self, text: str) -> float:
        a, b = self.evidence(fold(text))
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fold_of(col: str = "doc_id"):
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(5))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(words, toxic, half) of at most about max_rows labelled rows that aren't held out, chosen by a hash of the id.

    words are folded; equal texts are in one half.
    """
    lab = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(fold_of() != 0)
    n = lab.count()
    if n > max_rows:
        lab = lab.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * max_rows / n))

    def run(parts):
        for part in parts:
            words = [" ".join(fold(x or "")) for x in part["text"]]
            yield {"words": words, "toxic": part["toxic"], "half": [zlib.crc32(x.encode("utf-8", "replace")) & 1 for x in words]}

    # The bound makes the side small enough to send to every executor.
    return map_columns(docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id").select("text", "toxic"), run, "words string, toxic int, half int")


def counted(rows: DataFrame) -> DataFrame:
    """(entry, p0, n0, p1, n1): toxic and other training texts with an entry, by half; each task adds up its own first."""
    names = ("p0", "n0", "p1", "n1")

    def run(parts):
        seen = [Counter() for _ in names]

        def counts():
            keys = sorted(set().union(*seen))
            for at in range(0, len(keys), 50_000):
                some = keys[at : at + 50_000]
                yield {"entry": some} | {k: [c[x] for x in some] for k, c in zip(names, seen, strict=True)}
            for c in seen:
                c.clear()

        for part in parts:
            for words, toxic, half in zip(part["words"], part["toxic"], part["half"], strict=True):
                seen[2 * half + 1 - toxic].update(entries_of(set(words.split())))
                if sum(map(len, seen)) > PASS_ON:
                    yield from counts()
        yield from counts()

    return map_columns(rows, run, "entry string, p0 long, n0 long, p1 long, n1 long").groupBy("entry").agg(*(F.sum(k).alias(k) for k in names))


def chosen(counts: list[tuple[str, int, int]], n_pos: int, n_neg: int, least: float, most: int = MAX_ENTRIES) -> dict[str, float]:
    """Entries with log odds of at least so much; a longer one only where it says more than its beginnings."""
    weights: dict[str, float] = {}
    surprise: dict[str, float] = {}
    for w, p, n in sorted(counts, key=lambda x: (len(x[0]), x[0])):
        if p < 3:
            continue
        odds = math.log((p + 0.5) / (n_pos + 1)) - math.log((n + 0.5) / (n_neg + 1))
        shorter = max((weights.get(w[:k], 0.0) for k in range(3, len(w))), default=0.0)
        if odds >= least and odds > shorter + 0.7 and (much := _surprise(p, n, n_pos, n_neg)) > 20:
            weights[w], surprise[w] = odds, much
    return {w: weights[w] for w in sorted(weights, key=lambda w: (-surprise[w], w))[:most]}


def _surprise(p: int, n: int, n_pos: int, n_neg: int) -> float:
    """Twice the log-likelihood ratio of a dependence between the entry and the label."""
    total, rate = 0.0, (p + n) / (n_pos + n_neg)
    for k, m in ((p, n_pos), (n, n_neg)):
        for x, q in ((k, rate), (m - k, 1 - rate)):
            if x > 0 and m > 0:
                total += x * math.log(x / (m * q))
    return 2 * total


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 60) -> tuple[float, ...]:
    """Weights of a logistic curve by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN, max_entries: int = MAX_ENTRIES) -> Lexicon:
    spark = docs.sparkSession
    rows = cut(training_rows(docs, labels, max_rows), "toxic-train")
    n = {(r["half"], r["toxic"]): r["n"] for r in rows.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = ([n.get((h, k), 0) for h in (0, 1)] for k in (1, 0))
    lex = Lexicon({}, [], (-30.0, 0.0, 0.0))
    if sum(pos) and sum(neg):
        # Other entries can reach no setting; the rest is as many as the bounded sample has.
        telling = f"(p0 + p1 >= 3 and (p0 + p1) * {sum(neg)} > 2 * (n0 + n1) * {sum(pos)}) or (p0 >= 3 and p0 * {neg[0]} > 2 * n0 * {pos[0]})"
        counts = [tuple(r) for r in counted(rows).where(telling).collect()]
        least = best_setting(rows, counts, pos, neg, max_entries) if all((*pos, *neg)) else SETTINGS[0]
        lex.weights = chosen([(w, p0 + p1, n0 + n1) for w, p0, n0, p1, n1 in counts], sum(pos), sum(neg), least, max_entries)
        lex.exceptions = exceptions(rows, [lex], sum(pos) / sum(neg), max_entries)[0]
        x, y = evidence(rows, [lex])[0]
        lex.curve = logistic(x, y) if len(set(y)) > 1 else lex.curve
    discard(spark, rows)
    return lex


def best_setting(rows: DataFrame, counts: list[tuple], pos: list[int], neg: list[int], max_entries: int) -> float:
    """The setting whose lexicon, learned on half 0, has the least loss on half 1; the smaller one of equal ones."""
    tried = [Lexicon(chosen([(w, p, n) for w, p, n, _, _ in counts], pos[0], neg[0], least, max_entries), [], (0.0, 0.0, 0.0)) for least in SETTINGS]
    for lex, own in zip(tried, exceptions(rows.where("half = 0"), tried, pos[0] / neg[0], max_entries), strict=True):
        lex.exceptions = own
    losses = []
    for (x, y), (x1, y1) in zip(evidence(rows.where("half = 0"), tried), evidence(rows.where("half = 1"), tried), strict=True):
        c = logistic(x, y)
        p = 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x1)), x1]) @ np.array(c), -30, 30)))
        losses.append(round(-float(np.mean(np.log(np.where(y1 > 0, p, 1 - p) + 1e-12))), 6))
    return SETTINGS[losses.index(min(losses))]


def exceptions(rows: DataFrame, lexica: list[Lexicon], ratio: float, most: int) -> list[list[str]]:
    """For each lexicon: pairs of neighbours around an entry that stand in harmless texts only, more often than by chance.

    ratio: toxic texts over others. A text with an entry of weight w is harmless at a rate of 1 / (1 + ratio * exp(w)).
    """

    def run(parts):
        seen: Counter = Counter()
        starts = {w[:3] for lex in lexica for w in lex.weights}

        def counts():
            keys = sorted(seen)
            out = {"k": [x[0] for x in keys], "phrase": [x[1] for x in keys], "toxic": [x[2] for x in keys], "weight": [x[3] for x in keys], "n": [seen[x] for x in keys]}
            seen.clear()
            return out

        for part in parts:
            for text, toxic in zip(part["words"], part["toxic"], strict=True):
                words = text.split()
                at = [i for i, w in enumerate(words) if w[:3] in starts]
                for k, lex in enumerate(lexica):
                    own = {i: x for i in at if (x := lex.weight(words[i]))}
                    begins = {j for i in own for j in (i - 1, i) if 0 <= j < len(words) - 1}
                    seen.update({(k, f"{words[j]} {words[j + 1]}", toxic, max(own.get(j, 0.0), own.get(j + 1, 0.0))) for j in begins})
                if len(seen) > PASS_ON:
                    yield counts()
        yield counts()

    got = (
        map_columns(rows, run, "k int, phrase string, toxic int, weight double, n long")
        .groupBy("k", "phrase").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("fine"), F.sum("toxic").alias("bad"), F.max("weight").alias("weight"))
        .where("bad = 0 and fine >= 3").where(F.col("fine") * F.log1p(F.lit(ratio) * F.exp("weight")) > 4)
    )
    out: list[list[str]] = [[] for _ in lexica]
    for r in got.orderBy(F.desc("fine"), "phrase").limit(most * len(lexica)).collect():
        if len(out[r["k"]]) < most:
            out[r["k"]].append(r["phrase"])
    return out


def evidence(rows: DataFrame, lexica: list[Lexicon]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each lexicon: the evidence of the training texts, and their labels."""

    def run(parts):
        for part in parts:
            words = [x.split() for x in part["words"]]
            for k, lex in enumerate(lexica):
                got = list(map(lex.evidence, words))
                yield {"k": [k] * len(got), "a": [x[0] for x in got], "b": [x[1] for x in got], "toxic": part["toxic"]}

    got = map_columns(rows, run, "k int, a double, b double, toxic int").groupBy("k", "a", "b", "toxic").agg(F.count("*").alias("n")).collect()
    out = []
    for k in range(len(lexica)):
        own = sorted((r["a"], r["b"], r["toxic"], r["n"]) for r in got if r["k"] == k)
        times = [n for *_, n in own]
        out.append((np.repeat(np.array([x[:2] for x in own]).reshape(-1, 2), times, axis=0), np.repeat(np.array([x[2] for x in own], dtype=float), times)))
    return out


def score(docs: DataFrame, lex: Lexicon, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of keep (but for those named as a result), held_out, score and predicted."""
    keep = tuple(k for k in keep if k not in ("doc_id", "held_out", "score", "predicted"))
    fields = {x.name: x for x in docs.schema}
    schema = T.StructType([fields["doc_id"], *(fields[k] for k in keep), T.StructField("score", T.DoubleType())])
    return (
        map_texts(docs.select("doc_id", *dict.fromkeys(("text", *keep))), lambda _, texts: {"score": [lex.score(x) for x in texts]}, schema)
        .withColumn("held_out", F.coalesce(fold_of() == 0, F.lit(False)))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )


def keep_clean(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """docs without the texts that score 0.5 or more; all columns stay as they are."""
    keep = fresh(docs, "kinfold_keep")
    schema = T.StructType([*docs.schema.fields, T.StructField(keep, T.BooleanType())])
    return map_texts(docs, lambda _, texts: {keep: [lex.score(x) < 0.5 for x in texts]}, schema).where(keep).drop(keep)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")
