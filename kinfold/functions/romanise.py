"""Romanisation of Indic scripts. The nine blocks share one layout, so a table of offsets serves all."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NATIVE = r"[\x{0900}-\x{0DFF}]"

# First code points of the blocks, and sounds by offset.
BLOCKS = (0x0900, 0x0980, 0x0A00, 0x0A80, 0x0B00, 0x0B80, 0x0C00, 0x0C80, 0x0D00)
# fmt: off
CONSONANTS = {
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "n", 0x1A: "ch", 0x1B: "chh", 0x1C: "j", 0x1D: "jh", 0x1E: "n", 0x1F: "t", 0x20: "th",
    0x21: "d", 0x22: "dh", 0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n", 0x29: "n", 0x2A: "p", 0x2B: "f", 0x2C: "b", 0x2D: "bh",
    0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "r", 0x32: "l", 0x33: "l", 0x34: "l", 0x35: "v", 0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h", 0x58: "q",
    0x59: "kh", 0x5A: "g", 0x5B: "z", 0x5C: "d", 0x5D: "dh", 0x5E: "f", 0x5F: "y",
}
VOWELS = {
    0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "ri", 0x0D: "e", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x11: "o", 0x12: "o",
    0x13: "o", 0x14: "au",
}
SIGNS = {
    0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x43: "ri", 0x45: "e", 0x46: "e", 0x47: "e", 0x48: "ai", 0x49: "o", 0x4A: "o", 0x4B: "o",
    0x4C: "au",
}
# fmt: on
NASALS = {0x01: "n", 0x02: "n", 0x03: "h"}
DIGITS = {0x66 + d: str(d) for d in range(10)}
VIRAMA = 0x4D

#: offset → (sound, what happens to a consonant's own vowel before it, whether it leaves one open).
_SOUNDS = {o: (s, "a", True) for o, s in CONSONANTS.items()} | {o: (s, "", False) for o, s in SIGNS.items()} | {o: (s, "a", False) for t in (VOWELS, NASALS, DIGITS) for o, s in t.items()} | {VIRAMA: ("", "", False)}
_TABLE = {chr(b + o): v for b in BLOCKS for o, v in _SOUNDS.items()}
#: Digits of the nine blocks, and Arabic ones, with their values.
NATIVE_DIGITS = {chr(b + d): str(d) for b in (*(b + 0x66 for b in BLOCKS), 0x0660, 0x06F0) for d in range(10)}
_KNOWN = {chr(b + o) for b in BLOCKS for o in range(0x80)}


def romanise(token: str) -> str:
    """One token in Latin letters; a consonant's vowel is dropped at the end, doubled letters become one."""
    out, open_ = "", False
    for c in token:
        if c in _TABLE:
            sound, before, leaves = _TABLE[c]
            out += (before if open_ else "") + sound
            open_ = leaves
        elif c not in _KNOWN:
            out += ("a" if open_ else "") + (c.lower() if c.isascii() and c.isalnum() else "")
            open_ = False
    return re.sub(r"(.)\1+", r"\1", out)


@F.arrow_udf(T.StringType())
def _romanised(tokens: pa.Array) -> pa.Array:
    return pa.array([None if x is None else romanise(x) for x in tokens.to_pylist()], pa.string())


def romanised(c: Column) -> Column:
    return _romanised(c)


def script(c: Column) -> Column:
    """Number of the block (0 to 8) that most of a text's native letters are in; null without any."""
    counts = F.array(*(F.struct(F.length(F.regexp_replace(c, f"[^\\x{{{b:04X}}}-\\x{{{b + 0x7F:04X}}}]", "")).alias("n"), F.lit(-k).alias("k")) for k, b in enumerate(BLOCKS)))
    top = F.array_max(counts)
    return F.when(top["n"] > 0, -top["k"])
