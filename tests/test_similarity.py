from __future__ import annotations

import random

import pytest

from kinfold.functions import similarity as s


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_goldens():
    assert s.ratio("kitten", "sitting") == pytest.approx(61.5385, abs=1e-4)
    assert s.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert s.jaro_winkler("abcd", "xbcd") == pytest.approx(0.833333, abs=1e-6)
    assert s.ratio("", "") == 100 and s.token_set_ratio("", "a") == 0
    assert s.token_sort_ratio("new york mets", "mets york new") == 100
    assert s.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert s.partial_ratio("abc", "xxabcxx") == 100


def test_lcs_equals_quadratic_algorithm():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choices("abcd", k=rnd.randint(0, 90))) for _ in "ab")
        assert s.lcs(a, b) == lcs(a, b)


def test_partial_ratio_tries_every_stretch_of_short_texts():
    rnd = random.Random(2)
    for _ in range(150):
        a, b = ("".join(rnd.choices("abc", k=rnd.randint(1, 12))) for _ in "ab")
        if len(a) > len(b):
            a, b = b, a
        n, best = len(a), 0.0
        for e in range(1, len(b) + n):
            w = b[max(0, e - n) : min(e, len(b))]
            best = max(best, 200.0 * lcs(a, w) / (n + len(w)))
        assert s.partial_ratio(a, b) == pytest.approx(best)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnop "])
def test_partial_ratio_of_long_texts_tries_every_stretch(alphabet):
    rnd = random.Random(5)
    for _ in range(25):
        a, b = ("".join(rnd.choices(alphabet, k=rnd.randint(70, 300))) for _ in "ab")
        if rnd.random() < 0.4:
            at = rnd.randrange(len(b))
            b = b[:at] + "".join(c for c in a if rnd.random() < 0.9) + b[at:]
        if len(a) > len(b):
            a, b = b, a
        n = len(a)
        best = max(200.0 * lcs_fast(a, w) / (n + len(w)) for e in range(1, len(b) + n) for w in [b[max(0, e - n) : min(e, len(b))]])
        assert s.partial_ratio(a, b) == pytest.approx(best, abs=1e-9) == s.partial_ratio(b, a)


def lcs_fast(a, b):
    """Rows of the quadratic algorithm as numpy: matches of a new character, then running maxima."""
    import numpy as np

    x, row = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.zeros(len(a) + 1, np.int64)
    for c in b:
        new = row.copy()
        new[1:] = np.maximum(row[1:], row[:-1] + (x == ord(c)))
        row = np.maximum.accumulate(new)
    return int(row[-1])


def test_scores_of_columns_equal_the_functions(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(6)
    rows = [(" ".join("".join(rnd.choices("abcé", k=rnd.randint(1, 6))) for _ in range(rnd.randint(0, 30))), " ".join(rnd.choices(["abc", "ab", "cé", "a"], k=rnd.randint(0, 30)))) for _ in range(60)] + [(None, "a"), (None, None), ("same text", "same text")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", s.scores({k: (k, F.col("a"), F.col("b")) for k in s.SCORERS}).alias("s")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["s"].asDict() == {k: pytest.approx(f(r["a"] or "", r["b"] or "")) for k, f in s.SCORERS.items()}


def test_partial_ratio_of_long_texts_finds_the_stretch():
    rnd = random.Random(3)
    inner = "".join(rnd.choices("abcdefghij ", k=300))
    noisy = "".join("#" if rnd.random() < 0.05 else c for c in inner)
    outer = "".join(rnd.choices("abcdefghij ", k=900)) + inner + "".join(rnd.choices("abcdefghij ", k=900))
    assert s.partial_ratio(noisy, outer) > 90


def test_jaro_winkler_equals_duckdb():
    import duckdb

    con, rnd = duckdb.connect(), random.Random(4)
    for _ in range(200):
        a, b = ("".join(rnd.choices("abcdef ", k=rnd.randint(1, 80))) for _ in "ab")
        assert s.jaro_winkler(a, b) == pytest.approx(con.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0])


def test_token_set_ratio_compares_only_what_is_not_shared(monkeypatch):
    rnd, cells = random.Random(3), []
    words = ["".join(rnd.choices("abcde", k=rnd.randint(1, 6))) for _ in range(60)]

    def whole(a: str, b: str) -> float:
        x, y = set(a.split()), set(b.split())
        both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
        if not x or not y or both and (not left or not right):
            return 100.0 if x and y else 0.0
        p, q, shared = " ".join(both + left), " ".join(both + right), len(" ".join(both))
        return max([s.ratio(p, q), *(100.0 * 2 * shared / (shared + len(z)) for z in (p, q) if both)])

    pairs = [tuple(" ".join(rnd.sample(words, rnd.randint(0, 30))) for _ in "ab") for _ in range(300)]
    expected = [whole(a, b) for a, b in pairs]
    assert [s.token_set_ratio(a, b) for a, b in pairs] == expected
    kept = s.common
    monkeypatch.setattr(s, "common", lambda places, n, b: cells.append(n * len(b)) or kept(places, n, b))
    # A sixth of either side is shared: less than what lcs() looks for itself.
    a, b = " ".join(["aa" * 20, "x" * 200]), " ".join(["aa" * 20, "y" * 200])
    assert s.token_set_ratio(a, b) == whole(a, b)
    cells.clear()
    s.token_set_ratio(a, b)
    assert sum(cells) <= 200 * 200


def test_columns_are_compared_without_python_and_exactly_as_the_functions_do(spark):
    from pyspark.sql import functions as F

    rnd, odd = random.Random(8), "ab é中\U0001f600￮￿ 　\x1c\x85​Z0"
    rows = [tuple("".join(rnd.choices(odd[: rnd.choice((3, 5, 15))], k=rnd.randint(0, 300))) for _ in "ab") for _ in range(120)]
    # More rows than a strip has, a common part, and strands and characters of more than two bytes.
    inner = "".join(rnd.choices("abcdefgh ", k=2500))
    rows += [(inner, "".join(c for c in inner if rnd.random() < 0.9) + "xyz" * 400), ("ab" * 20, "".join(rnd.choices("abc", k=66_000))), (" \U0001f600b" * 40, "a\U0001f600￿b" * 50), (None, ""), (" ", "a")]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", s.scores({k: (k, F.col("a"), F.col("b")) for k in s.SCORERS}).alias("s"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
    for r in df.collect():
        assert r["s"].asDict() == {k: f(r["a"] or "", r["b"] or "") for k, f in s.SCORERS.items()}
