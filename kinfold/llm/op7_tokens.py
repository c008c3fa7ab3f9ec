"""Token-ID output in seekable files, and reading it back.

Documents are encoded with the tokenizers library, an end id is appended, and each document becomes one independent
zstandard frame (little-endian unsigned 32-bit ids, with the frame's own checksum). A file holds the frames of a range of
documents in ascending doc_id order, then a frame that readers of plain zstandard skip with the doc_ids, and a trailing
seek table in zstandard's seekable format: sizes and a checksum of every frame. A reader gets the table from the end of
the file and decompresses only the documents that are asked for.

Encoding: with a tokenizer that normalises and splits as AS_WRITTEN says, no token crosses white space, so texts are cut
there, after A-Z went to lower case as the library would have it (not where it might join marks to a letter first, nor
near its special tokens). Ids of the distinct parts of a batch are kept; only parts not seen before go through the
library, all of a batch together. Texts go through any other tokenizer whole.

Files hold ranges of about equal bytes: the keys and sizes of all rows (not their texts) are sorted in ranges of a few
files, and each range is cut where its running sum of bytes says; only the first key of every file reaches the driver.
Frames, not texts, are then dealt out, one file to a task. Files get their name by range, are written under a name of the
attempt and then renamed, so a repeated task leaves the same file.

Defined cases: null and empty texts have the end id only; rows with one doc_id stay next to each other, in the order of a
hash of their texts, and may be in several files (rows that are alike in both are in one); rows without a doc_id come
first (in the files their id is -2 ** 63); a file holds at most about FILE_BYTES of text, or one text; an empty table
gives no file and an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import ship
from .common import enter, keeps, map_columns, new_path, table

END_ID = 2
#: Bytes of text for one file.
FILE_BYTES = 64 << 20
#: Bytes of text that are encoded together (one text may have more).
TOGETHER = 8 << 20

#: Files whose rows are sorted in one task, and rows of these at most.
FILES, ROWS = 8, 1 << 20

#: How the tokenizers that words can be encoded one by one for normalise texts and split them.
AS_WRITTEN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

# Fixed values of zstandard's seekable format.
SKIPPABLE_IDS, SKIPPABLE_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


class Encoder:
    """most: parts whose ids are kept at a time; longest: bytes of a part that is kept."""

    def __init__(self, tokenizer_file: str, most: int = 600_000, longest: int = 40):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.most, self.longest = most, longest
        self.known: dict[bytes, bytes] = {}
        self.stops = {c: self._encoded([c.decode()])[0] for c in (b".", b",")}
        spec = json.loads(self.tokenizer.to_str())
        special = {t["content"] for t in spec["added_tokens"]}
        self.by_word = all(spec[k] == v for k, v in AS_WRITTEN.items()) and spec["model"]["type"] == "BPE" and spec["model"]["end_of_word_suffix"] == "</w>" and all(x.startswith("<|") for x in special)
        if not self.by_word:
            return
        # The same vocabulary and merges for single words in lower case, without the steps that leave these alone.
        spec["normalizer"] = None
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.single = Tokenizer.from_str(json.dumps(spec))
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        #: Which ids end a word.
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _encoded(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _words(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that are one word each to the library: encoded together, cut behind every id that ends a word."""
        ids = np.array(self.single.encode(" ".join(parts).lower(), add_special_tokens=False).ids, dtype="<u4")
        at = np.flatnonzero(self.ends[ids]) + 1 if not len(ids) or ids.max() < len(self.ends) else ()
        if len(at) != len(parts):
            return self._encoded(parts)
        raw, at = ids.tobytes(), [0, *(4 * at).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _learn(self, new: set[bytes]) -> None:
        known = self.known
        known[b""] = b""
        body = {w: self.body(w) for w in new}
        words, others = {}, {}
        for b in body.values():
            if b not in known:
                s = b.decode("utf-8", "replace")
                # Latin letters that stay letters in lower case.
                (words if s.isalpha() and max(s) < "\u0180" and "\u0130" not in s else others)[b] = s
        for some, f in ((words, self._words), (others, self._encoded)):
            if some:
                known.update(zip(some, f(list(some.values())), strict=True))
        for w, b in body.items():
            if b != w:
                known[w] = known[b] + self.stops[w[-1:]] if len(b) < len(w) else known[b]

    def __call__(self, texts: pa.Array, end: int = END_ID) -> list[bytes]:
        """Ids of each text (null as empty) and the end id, as little-endian unsigned 32-bit numbers."""
        tail = struct.pack("<I", end)
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            return [x + tail for x in self._encoded(texts.to_pylist())]
        known = self.known
        full = len(known) > self.most
        low = pc.if_else(pc.match_substring_regex(texts, "<\\||[\u0300-\u036f]"), texts, pc.ascii_lower(texts))
        parts = pc.ascii_split_whitespace(low)
        each = parts.flatten().dictionary_encode()
        words = each.dictionary.cast(pa.binary()).to_pylist()
        got = list(map(known.get, words))
        if None in got:
            before = len(known)
            self._learn({w for w, v in zip(words, got, strict=True) if v is None})
            got = list(map(known.__getitem__, words))
            if full:
                # The parts that came first stay; they are the frequent ones.
                for w in list(islice(reversed(known), len(known) - before)):
                    del known[w]
        # Ids of all distinct parts one after the other; where those of a part begin, and how many they are.
        ids = np.frombuffer(b"".join(got), dtype="<u4")
        size = np.fromiter(map(len, got), dtype=np.int32, count=len(got)) // 4
        first = np.cumsum(size, dtype=np.int64) - size
        at = each.indices.to_numpy()
        n = size[at]
        ends = np.cumsum(n, dtype=np.int64)
        take = np.repeat(first[at] - (ends - n), n)
        take += np.arange(len(take))
        flat = ids[take]
        bounds = np.concatenate(([0], ends))[parts.offsets.to_numpy() - parts.offsets[0].as_py()].tolist()
        out = [flat[a:b].tobytes() + tail for a, b in zip(bounds, bounds[1:], strict=False)]
        for w in words:
            if len(w) > self.longest:
                known.pop(w, None)
                known.pop(self.body(w), None)
        return out

    @staticmethod
    def body(w: bytes) -> bytes:
        """What has to be encoded of a part: less one stop behind a letter or digit."""
        return w[:-1] if w[-1:] in (b".", b",") and w[-2:-1].isalnum() and b"<|" not in w else w


_encoders: dict[str, Encoder] = {}


keeps(__name__, _encoders.clear)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Writer:
    """One file of frames with its seek table. where: a URI or a local path."""

    def __init__(self, where: str):
        self.store, self.path = located(where)
        self.store.create_dir(os.path.dirname(self.path), recursive=True)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.tmp)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.tokens = 0

    def add(self, doc_id: int | None, frame: bytes, size: int, checksum: int) -> None:
        self.out.write(frame)
        self.entries.append((len(frame), size, checksum))
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.tokens += size // 4

    def close(self) -> None:
        from zstandard import ZstdCompressor

        ids = ZstdCompressor(level=3).compress(np.array(self.ids, dtype="<i8").tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_IDS, len(ids)) + ids)
        entries = [*self.entries, (8 + len(ids), 0, 0)]
        body = np.array(entries, dtype="<u4").tobytes() + struct.pack("<IBI", len(entries), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(body)) + body)
        self.out.close()
        self.store.move(self.tmp, self.path)


class Reader:
    """Reads documents of one file by number, each from its own frame."""

    def __init__(self, where: str):
        from zstandard import ZstdDecompressor

        store, path = located(where)
        self.file, self.zstd = store.open_input_file(path), ZstdDecompressor()
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError(f"{path} has no seek table")
        entries = np.frombuffer(self.file.read_at(12 * n, end - 9 - 12 * n), dtype="<u4").reshape(n, 3).astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(entries[:, 0])))
        self.entries, self.starts = entries[:-1], starts[:-1]
        raw = self.file.read_at(int(entries[-1, 0]), int(starts[-2]))
        self.ids = np.frombuffer(self.zstd.decompress(raw[8:]), dtype="<i8")
        self.first = np.concatenate(([0], np.cumsum(self.entries[:, 1] // 4)))[:-1]

    def __len__(self) -> int:
        return len(self.entries)

    def tokens(self, k: int) -> bytes:
        """The ids of document number k; its frame alone is read and checked."""
        from xxhash import xxh64_intdigest

        size, plain, checksum = self.entries[k].tolist()
        data = self.zstd.decompress(self.file.read_at(size, int(self.starts[k])), max_output_size=plain)
        if len(data) != plain or xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return data

    def find(self, doc_id: int) -> list[int]:
        """Numbers of the documents with this id."""
        a, b = np.searchsorted(self.ids, [doc_id, doc_id + 1])
        return list(range(int(a), int(b)))


def located(where: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(where) if "://" in where or where.startswith("file:") else (fs.LocalFileSystem(), where)


def slices(batch: pa.RecordBatch, most: int):
    """Slices of a batch with so many bytes of text at most, or one row."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


NO_ID = -(1 << 63)


def first_keys(docs: DataFrame, file_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, hash of the text) of the first row of every file but the first one, in order."""
    size = F.octet_length("text")
    total, rows = docs.agg(F.sum(F.coalesce(size, F.lit(0)) + 16), F.count("*")).first()
    ranges = max(1, -(-(total or 0) // (FILES * file_bytes)), -(-rows // ROWS))
    keys = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("h"), (F.coalesce(size, F.lit(0)) + 16).alias("bytes"))

    def run(parts):
        held = [(np.array(p["id"], dtype=np.int64), np.array(p["h"], dtype=np.int64), np.array(p["bytes"], dtype=np.int64)) for p in parts]
        if held:
            i, h, n = map(np.concatenate, zip(*held, strict=True))
            before = np.cumsum(n) - n
            files = -(-int(n.sum()) // file_bytes)
            at = np.unique(np.searchsorted(before, np.arange(files) * (n.sum() / files)))
            yield {"id": i[at[at < len(i)]], "h": h[at[at < len(i)]]}

    dealt = keys.repartitionByRange(ranges, "id", "h").sortWithinPartitions("id", "h")
    got = sorted(map(tuple, map_columns(dealt, run, "id long, h long").distinct().collect()))[1:]
    return np.array([x[0] for x in got], dtype=np.int64), np.array([x[1] for x in got], dtype=np.int64)


def files_of(ids: np.ndarray, hashes: np.ndarray, first: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Number of the file that each key belongs to."""
    low, high = np.searchsorted(first[0], ids, "left"), np.searchsorted(first[0], ids, "right")
    # Files that begin within the rows of one id.
    for k in np.flatnonzero(low != high).tolist():
        high[k] = low[k] + np.searchsorted(first[1][low[k] : high[k]], hashes[k], "right")
    return high.astype(np.int32)


def write(docs: DataFrame, tokenizer_file: str, folder: str, file_bytes: int = FILE_BYTES, end: int = END_ID) -> list[tuple[int, str, int, int]]:
    """Write docs (doc_id, text) into folder; [(first id's place, file, documents, ids)] in order, one for each file."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    first = first_keys(docs, file_bytes)
    n = len(first[0]) + 1
    shipped = docs.sparkSession.sparkContext.broadcast(first)

    def encode(batches):
        from xxhash import xxh64_intdigest
        from zstandard import ZstdCompressor

        pack = ZstdCompressor(level=1, write_checksum=True, write_content_size=True).compress
        enter(encoder.__module__)
        enc = encoder(tokenizer_file)
        for whole in batches:
            for p in slices(whole, TOGETHER):
                ids = p.column(0)
                raw = enc(p.column(1), end)
                file = files_of(pc.fill_null(ids, NO_ID).to_numpy(zero_copy_only=False), p.column(2).to_numpy(zero_copy_only=False), shipped.value)
                yield pa.RecordBatch.from_arrays(
                    [ids, p.column(2), pa.array([pack(x) for x in raw], pa.binary()), pa.array([len(x) for x in raw], pa.int64()), pa.array([xxh64_intdigest(x) & 0xFFFFFFFF for x in raw], pa.int64()), pa.array(file)],
                    names=["doc_id", "h", "frame", "size", "checksum", "file"],
                )

    def store(parts):
        out, at = None, None
        for p in parts:
            for k, i, frame, size, checksum in zip(p["file"], p["doc_id"], p["frame"], p["size"], p["checksum"], strict=True):
                if k != at:
                    if out is not None:
                        out.close()
                        yield {"file": [at], "docs": [len(out.ids)], "tokens": [out.tokens]}
                    out, at = Writer(f"{folder}/{k:08d}.tok.zst"), k
                out.add(i, frame, size, checksum)
        if out is not None:
            out.close()
            yield {"file": [at], "docs": [len(out.ids)], "tokens": [out.tokens]}

    frames = docs.withColumn("h", F.xxhash64("text")).mapInArrow(encode, "doc_id long, h long, frame binary, size long, checksum long, file int")
    dealt = frames.repartitionById(n, F.col("file")).sortWithinPartitions("file", "doc_id", "h")
    made = map_columns(dealt, store, "file int, docs long, tokens long").collect()
    out, first = [], 0
    for r in sorted(made):
        out.append((first, f"{folder}/{r['file']:08d}.tok.zst", r["docs"], r["tokens"]))
        first += r["tokens"]
    return out


def read(spark: SparkSession, files: list[tuple[int, str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def run(parts):
        for p in parts:
            for first, path in zip(p["first"], p["path"], strict=True):
                r = Reader(path)
                for at in range(0, len(r), 2000):
                    some = range(at, min(at + 2000, len(r)))
                    data = [r.tokens(k) for k in some]
                    ids = r.ids[at : at + 2000]
                    yield {"doc_id": pa.array(ids, mask=ids == NO_ID), "start": pa.array(r.first[at : at + 2000] + first), "n_tokens": [len(x) // 4 for x in data], "ids_crc32": [zlib.crc32(x) for x in data]}

    table_ = spark.createDataFrame([(k, a, b) for k, (a, b, _, _) in enumerate(files)], "k int, first long, path string").repartitionById(max(1, len(files)), F.col("k"))
    return map_columns(table_, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, write(table(spark, sf_dir, "documents"), tokenizer_path(), new_path(spark, "tokens")))
