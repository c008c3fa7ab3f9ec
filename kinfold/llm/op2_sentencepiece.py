"""SentencePiece encoding and decoding of merge-type (BPE) models.

Encoding by a prefix table: the encoding of every prefix of a word ends in a unique token. For each prefix, an
Aho-Corasick automaton over all pieces lists the pieces that end there, longest first; the first that the merges leave
whole, and that is compatible with the last token of the prefix before it, is the last token. Two tokens are compatible
when merging their joint text gives just these two; results of that test are kept. The ids are then read backwards from
the last prefix. The test undoes the merges of both tokens step by step, last first, and looks whether at some step the
merges would have joined across the boundary. A text is first cut where no piece of the vocabulary can cross: at white space, then inside what lies
between. What a cut part encodes and decodes to is kept, so the work is in proportion to the distinct parts.

Defined cases: null counts as empty; an empty text has no ids and decodes to an empty text; characters outside of the
vocabulary become byte pieces; texts of any length are taken whole; repeated rows give repeated results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import keeps, map_texts, table

SPACE = "▁"


def fields(raw: bytes) -> dict[int, list]:
    """The fields of a protocol buffer message by number: numbers, or bytes of what has a length."""
    out: dict[int, list] = {}
    at = 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = raw[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            value, at = raw[at : at + size], at + size
        out.setdefault(key >> 3, []).append(value)
    return out


def check_model(model_file: str) -> None:
    """ValueError unless it is a merge-type model that takes texts as they are, with a space in front."""
    with open(model_file, "rb") as f:
        model = fields(f.read())
    trainer, normalizer = fields(model.get(2, [b""])[0]), fields(model.get(3, [b""])[0])
    if trainer.get(3, [1])[-1] != 2:
        raise ValueError(f"{model_file} is no merge-type (BPE) model")
    if normalizer.get(2, [b""])[-1] or normalizer.get(4, [1])[-1] or not normalizer.get(3, [1])[-1] or not normalizer.get(5, [1])[-1] or trainer.get(24, [0])[-1]:
        raise ValueError(f"{model_file} changes texts before it encodes them, which this encoder does not")


class Codec:
    """Encoder and decoder of one model file.

    most: words of each kind, and tests of pairs, that are kept; longest: of characters in a part that is kept.
    """

    def __init__(self, model_file: str, most: int = 300_000, longest: int = 32):
        import ahocorasick
        import sentencepiece

        check_model(model_file)
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.most, self.longest = most, longest
        self.pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        normal = [i for i in range(sp.vocab_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        self.rank = {i: k for k, i in enumerate(sorted(normal, key=lambda i: (-sp.get_score(i), i)))}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(sp.vocab_size()) if sp.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        self.control = {i for i in range(sp.vocab_size()) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        self.special = frozenset({*self.value, *self.control, self.unknown})
        self.chars = {c for p in self.ids for c in p}
        self.compatible: dict[int, bool] = {}
        self.auto = ahocorasick.Automaton()
        # Every character of the vocabulary on its own is a piece; a piece that merging does not reach never ends a prefix.
        self.halves: dict[int, tuple[int, int]] = {}
        for p, i in self.ids.items():
            if self.merged(p) == [i]:
                self.auto.add_word(p, (i, len(p)))
                if len(p) > 1:
                    self.halves[i] = tuple(self.merged(p, 2))
        self.auto.make_automaton()
        self.part = re.compile(self._cuts())
        #: Entries of words by themselves, and of words with a space in front.
        self.known: tuple[dict, dict] = ({}, {})
        self.lines = "\n" not in self.chars and self.part.pattern != r"(?s:.+)"

    def _cuts(self) -> str:
        """A pattern of parts: a new one begins wherever no piece holds both characters side by side.

        Pairs of neighbours are compared by class: spaces, letters and marks by being word characters, anything else by
        itself. The pattern is only as fine as the vocabulary allows.
        """
        inner = {(p[k] == SPACE, p[k + 1] == SPACE) for p in self.ids for k in range(len(p) - 1)}
        if (False, True) in inner:
            return r"(?s:.+)"
        letter = re.compile(r"[^\W\d_]").match
        mixed = any(bool(letter(a)) != bool(letter(b)) and SPACE not in (a, b) for p in self.ids for a, b in zip(p, p[1:], strict=False))
        word = rf"{SPACE}*[^{SPACE}]+|{SPACE}+" if mixed else rf"{SPACE}*[^\W\d_]+|{SPACE}*[^{SPACE}\W\d_]+|{SPACE}*[\W\d_]+?(?=[{SPACE}]|[^\W\d_]|$)|{SPACE}+"
        return rf"(?s:{word})"

    def merged(self, text: str, least: int = 1) -> list[int]:
        """Plain merging: of all neighbours whose joint text is a piece, the best ranked, leftmost first; until least are left."""
        ids, rank = self.ids, self.rank
        sym: list[str | None] = list(text)
        nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int) -> None:
            b = nxt[a]
            if b < len(sym) and (i := ids.get(sym[a] + sym[b])) is not None:
                heapq.heappush(heap, (rank[i], a, b, sym[a] + sym[b]))

        for a in range(len(sym)):
            offer(a)
        left = len(sym)
        while heap and left > least:
            _, a, b, both = heapq.heappop(heap)
            if sym[a] is None or sym[b] is None or nxt[a] != b or sym[a] + sym[b] != both:
                continue
            sym[a], sym[b], nxt[a] = both, None, nxt[b]
            left -= 1
            if nxt[a] < len(sym):
                prv[nxt[a]] = a
            offer(a)
            if prv[a] >= 0:
                offer(prv[a])
        return [ids.get(s, self.unknown) for s in sym if s is not None]

    def fits(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.compatible.get(key)
        if known is None:
            known = self.apart(a, b)
            if len(self.compatible) < self.most:
                self.compatible[key] = known
        return known

    def apart(self, a: int, b: int) -> bool:
        """Whether merging the joint text of two tokens gives just these two.

        x and y are the tokens on either side of the boundary at a time; limit is the rank of the merge that took one of
        them up. Of equal merges the left one comes first.
        """
        ids, rank, halves, pieces = self.ids, self.rank, self.halves, self.pieces
        x, y, limit = a, b, len(pieces)
        while True:
            both = ids.get(pieces[x] + pieces[y])
            if both is not None and rank[both] < limit:
                return False
            left, right = halves.get(x), halves.get(y)
            if left is not None and (right is None or rank[x] > rank[y]):
                limit, x = rank[x], left[1]
            elif right is not None:
                limit, y = rank[y] + 1, right[0]
            else:
                return True

    def run(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are in the vocabulary."""
        last, size = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        compatible, fits = self.compatible, self.fits
        for end, (i, n) in self.auto.iter(text):
            if last[end + 1] < 0:
                before = end + 1 - n
                if before:
                    p = last[before]
                    ok = compatible.get(p << 20 | i)
                    if not (fits(p, i) if ok is None else ok):
                        continue
                last[end + 1], size[end + 1] = i, n
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def part_ids(self, part: str) -> list[int]:
        """Ids of a part; characters outside of the vocabulary become bytes."""
        if all(map(self.chars.__contains__, part)):
            return self.run(part)
        out, at = [], 0
        for k, c in enumerate(part):
            if c not in self.chars:
                if k > at:
                    out += self.run(part[at:k])
                out += [self.byte.get(b, self.unknown) for b in c.encode("utf-8", "replace")]
                at = k + 1
        return out + (self.run(part[at:]) if at < len(part) else [])

    def entry(self, w: str, spaced: int) -> str | tuple[str, str]:
        """Ids of a word as decimals with commas; with what they decode to, if that isn't the word itself."""
        source = SPACE + w if spaced else w
        ids = [i for p in self.part.findall(source) for i in self.part_ids(p)]
        out, back = ",".join(map(str, ids)), self.decode(ids, False)
        return out if back == source.replace(SPACE, " ") else (out, back)

    def word(self, w: str, spaced: int) -> str | tuple[str, str]:
        """The entry of a word with or without a space in front; a stop or comma behind it is looked up by itself."""
        known = self.known[spaced]
        got = None
        if len(w) > 1 and w[-1] in ".," and w[-2].isalpha():
            body, tail = known.get(w[:-1]) or self.word(w[:-1], spaced), self.known[0].get(w[-1]) or self.word(w[-1], 0)
            if body.__class__ is tail.__class__ is str:
                got = f"{body},{tail}"
        if got is None:
            got = self.entry(w, spaced)
        if len(w) <= self.longest:
            # When there are enough, those that came first stay; they are the frequent ones.
            if len(known) < self.most:
                known[w] = got
        return got

    def encoded(self, text: str) -> tuple[str, str]:
        """(ids as decimals with commas, what they decode to)."""
        if not text:
            return "", ""
        if "  " in text or text[0] == " " or SPACE in text or not self.lines:
            ids = [i for p in self.part.findall(SPACE + text.replace(" ", SPACE)) for i in self.part_ids(p)]
            back = self.decode(ids, False)
            return ",".join(map(str, ids)), back[1:] if back[:1] == " " else back
        alone, after = self.known[0].get, self.known[1].get
        got = []
        for k, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            if k:
                got.append(alone("\n") or self.word("\n", 0))
                if first:
                    got.append(alone(first) or self.word(first, 0))
            else:
                got.append(after(first) or self.word(first, 1))
            got += [after(w) or self.word(w, 1) for w in rest]
        try:
            return ",".join(got), text
        except TypeError:
            return self.mended(text, got)

    @staticmethod
    def mended(text: str, got: list) -> tuple[str, str]:
        """The same where some words don't decode to themselves."""
        back: list[str] = []
        at = iter(got)
        for k, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            sources = ([("\n", ""), *([(first, "")] if first else [])] if k else [(first, " ")]) + [(w, " ") for w in rest]
            for w, space in sources:
                x = next(at)
                back.append(space + w if x.__class__ is str else x[1])
        out = "".join(back)
        return ",".join([x if x.__class__ is str else x[0] for x in got]), out[1:] if out[:1] == " " else out

    def encode(self, text: str) -> list[int]:
        return ids_of(self.encoded(text)[0]).tolist()

    def decode(self, ids: list[int] | np.ndarray, first: bool = True) -> str:
        """Text of ids: pieces joined, spaces restored, the space that encoding put in front taken off (if first)."""
        if not first and not self.special.intersection(ids):
            return "".join([self.pieces[i] for i in ids]).replace(SPACE, " ")
        out: list[str] = []
        raw = bytearray()
        for i in ids if isinstance(ids, list) else ids.tolist():
            if i in self.value:
                raw.append(self.value[i])
                first = False
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            if i in self.control:
                continue
            p = " ⁇ " if i == self.unknown else self.pieces[i]
            out.append(p[1:] if first and p[:1] == SPACE else p)
            first = False
        if raw:
            out.append(_utf8(bytes(raw)))
        return "".join(out).replace(SPACE, " ")


def _utf8(raw: bytes) -> str:
    """Bytes as text; each byte that belongs to no character becomes U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def ids_of(decimals: str) -> np.ndarray:
    return np.fromstring(decimals, dtype=np.int32, sep=",") if decimals else np.zeros(0, dtype=np.int32)


_codecs: dict[str, Codec] = {}


keeps(__name__, _codecs.clear)


def codec(model_file: str) -> Codec:
    if model_file not in _codecs:
        _codecs[model_file] = Codec(model_file)
    return _codecs[model_file]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


DIGEST = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def encode(docs: DataFrame, model_file: str, with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of keep (but for those named as a result), n_tokens, digests of the ids and of the decoded text, and
    ids if asked for."""
    keep = tuple(k for k in keep if k not in ("doc_id", "ids", *(x.name for x in DIGEST)))
    fields = {x.name: x for x in docs.schema}
    schema = T.StructType([fields["doc_id"], *(fields[k] for k in keep), *DIGEST, *[T.StructField("ids", T.ArrayType(T.IntegerType()))][: int(with_ids)]])

    def f(_, texts: list[str]) -> dict:
        c = codec(model_file)
        got = [c.encoded(x) for x in texts]
        out: dict[str, list] = {
            "n_tokens": [x.count(",") + 1 if x else 0 for x, _ in got],
            "ids_sha256": [hashlib.sha256(x.encode()).hexdigest() for x, _ in got],
            "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for _, x in got],
        }
        if with_ids:
            out["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *out["n_tokens"]]), pa.int32()), pa.array(ids_of(",".join([x for x, _ in got if x]))))
        return out

    return map_texts(docs.select("doc_id", "text", *keep), f, schema)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), model_path())
