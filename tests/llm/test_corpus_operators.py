"""op4, op6, op7 and the pipeline: against brute force, round trips, edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinfold.llm import common, op2_sentencepiece, op3_toxicity, op4_jaccard, op5_pii, op6_sharding, op7_tokens
from kinfold.llm.graph import components

from .conftest import ODD, prose


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# -- Jaccard join


def brute_components(rows, shingle=3, percent=90):
    low = bytes(range(256)).lower()
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(low).split()
        n = min(shingle, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(rnd, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture
def copies():
    rnd = random.Random(11)
    base, passage = prose(rnd, 160), prose(rnd, 60)
    texts = [*ODD, *([base] * 5), *(near_copies(rnd, base, rnd.randint(1, 9)) for _ in range(120))]
    texts += [f"{prose(rnd, 8)} {passage} {prose(rnd, 8)}" for _ in range(60)] + [passage] * 3
    for _ in range(25):
        one = prose(rnd, rnd.randint(3, 120))
        texts += [one, near_copies(rnd, one, rnd.randint(0, 3)), one.upper() + " tail"]
    texts += [" ".join(f"k{i}" for i in range(n)) for n in range(1, 15)]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize(("frequent", "together", "rounds"), [(24, 1000, 6), (3, 8, 0), (2, 16, 1), (10**9, 1000, 2)])
def test_jaccard_join_matches_brute_force(docs, copies, monkeypatch, frequent, together, rounds):
    monkeypatch.setattr(op4_jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(op4_jaccard, "TOGETHER", together)
    monkeypatch.setattr(op4_jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(op4_jaccard, "SMALL", 10 if rounds == 1 else 1 << 19)
    if rounds < 6:
        monkeypatch.setattr(op4_jaccard, "HOT_ENTRIES", 10**6)
        monkeypatch.setattr(op4_jaccard, "HOT_SETS", 10**6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op4_jaccard.join(docs(copies)).collect()}
    assert got == brute_components(list(enumerate(copies)))


def test_two_sets_that_may_be_linked_share_an_entry():
    rnd = random.Random(12)
    universe = np.array([rnd.getrandbits(64) for _ in range(3000)], dtype=np.uint64)
    frequent = np.sort(universe[:2000])
    for _ in range(400):
        n = rnd.randint(2, 400)
        x = np.unique(universe[rnd.sample(range(rnd.choice([2000, 3000])), n)])
        drop = rnd.randint(0, max(1, n // 18))
        y = np.unique(np.concatenate((np.delete(x, rnd.sample(range(n), drop)), universe[rnd.sample(range(3000), rnd.randint(0, max(1, n // 20)))])))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 90 * (len(x) + len(y) - both) and not np.array_equal(x, y):
            assert len(np.intersect1d(op4_jaccard.signatures(x, frequent, 90), op4_jaccard.signatures(y, frequent, 90)))


def test_bits_lose_no_link_and_drop_what_slices_let_through():
    rnd, dropped = np.random.default_rng(4), 0
    for n in [1, 2, 3, 7, 40, 130, 300, 2500, 2500]:
        for share in (1.0, 0.95, 0.9, 0.8, 0.7, 0.5, 0.0):
            common_ = rnd.integers(0, 1 << 63, int(n * share), dtype=np.uint64)
            a, b = (np.unique(np.concatenate((common_, rnd.integers(0, 1 << 63, k, dtype=np.uint64)))) for k in (n - len(common_), n // 3 + 1))
            o = len(np.intersect1d(a, b))
            for percent in (50, 80, 90):
                got = op4_jaccard.overlapping(len(a), len(b), op4_jaccard.bits(a), op4_jaccard.bits(b), percent)
                assert got or 100 * o < percent * (len(a) + len(b) - o)
                sketches = [np.frombuffer(op4_jaccard.sketch(x), dtype=np.uint8)[None] for x in (a, b)]
                dropped += bool(op4_jaccard.reachable(np.array([len(a)]), np.array([len(b)]), *sketches, percent)[0]) and not got
    assert dropped > 10


def test_writing_an_intermediate_table_leaves_no_shuffle_files(spark):
    import glob

    top = spark.sparkContext.getConf().get("spark.local.dir", None) or spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    files = lambda: set(glob.glob(f"{top}/**/shuffle_*", recursive=True))
    before = files()
    back = common.cut(spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").agg(F.sum("id").alias("n")), "test")
    assert {r["k"]: r["n"] for r in back.collect()} == {k: sum(range(k, 1000, 7)) for k in range(7)}
    assert not files() - before
    common.discard(spark, back)


def test_jaccard_join_of_odd_tables(spark, docs):
    assert op4_jaccard.join(docs([])).collect() == []
    rows = [(1, "a b c d", "en", "s", 1), (1, "x y z w", "en", "s", 1), (2, "x y z w", "en", "s", 1), (None, "a b c d", "en", "s", 1), (3, None, "en", "s", 0), (4, "", "en", "s", 0)]
    got = sorted(((r["doc_id"] or -1, r["component_id"]) for r in op4_jaccard.join(docs(rows)).collect()), key=str)
    assert got == sorted([(-1, None), (1, 1), (1, 1), (2, 1), (3, 3), (4, 4)], key=str)
    kept = op4_jaccard.keep_one(docs(rows).withColumn("rep", F.lit("clash")))
    assert kept.columns == [*docs([]).columns, "rep"] and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "None"]


@pytest.mark.parametrize("rounds", [6, 0])
def test_jaccard_join_keeps_all_sets_of_a_repeated_id_apart(docs, monkeypatch, rounds):
    monkeypatch.setattr(op4_jaccard, "ROUNDS", rounds)
    rnd = random.Random(18)
    long, short = prose(rnd, 300, 10**6), prose(rnd, 90, 10**6)
    rows = [(5, long), (5, short), (8, near_copies(rnd, long, 1)), (9, near_copies(rnd, short, 1)), (10, prose(rnd, 90, 10**6))]
    got = {r["doc_id"]: r["component_id"] for r in op4_jaccard.join(docs([(i, t, "en", "s", len(t)) for i, t in rows])).collect()}
    assert got == {5: 5, 8: 5, 9: 5, 10: 10}


def test_components(spark):
    rnd = random.Random(13)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    root = {i: i for e in edges for i in e}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(i, i) == find(i) for i in root)
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.parametrize("plain", [1 << 18, 0])
def test_components_of_a_long_path_and_of_a_hub(spark, monkeypatch, plain):
    from kinfold.llm import graph

    monkeypatch.setattr(graph, "PLAIN", plain)
    rnd = random.Random(20)
    path = list(range(5000))
    rnd.shuffle(path)
    edges = [*zip(path, path[1:], strict=False), *((9000, i) for i in range(9001, 11_000)), (20_001, 20_000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(i, i) == 0 for i in path) and all(got.get(i, i) == 9000 for i in range(9000, 11_000)) and got[20_001] == 20_000


def test_hot_keys_are_joined_apart(spark):
    ids = spark.range(300).selectExpr("CASE WHEN id < 150 THEN 7 ELSE id END AS u", "id AS x")
    assert op4_jaccard.hot_values(ids, "u", 10) == [7] and op4_jaccard.hot_values(ids, "u", 1) == []
    table_ = spark.range(300).selectExpr("id AS u", "id * 2 AS y")
    assert sorted(map(tuple, op4_jaccard.joined_apart(ids, table_, "u", [7]).select("u", "x", "y").collect())) == sorted(map(tuple, ids.join(table_, "u").select("u", "x", "y").collect()))
    rows = spark.createDataFrame([(1, i) for i in range(500)] + [(k, 0) for k in range(2, 300)] + [(None, 5)], "k long, x long")
    keyed = spark.createDataFrame([(1, "hot", 500), *((k, str(k), 1) for k in range(2, 200))], f"k long, name string, {common.TIMES} long")
    got = common.skewed(rows, keyed, ["k"], 800, "left", share=10)
    want = rows.join(keyed.drop(common.TIMES), ["k"], "left")
    assert sorted(map(str, got.select("k", "x", "name").collect())) == sorted(map(str, want.select("k", "x", "name").collect()))
    assert common.skewed(rows, keyed, ["k"], 800).count() == 698


# -- sharding


@pytest.mark.parametrize("limit", [64, 500, 5000, 10**9])
def test_sharding_matches_brute_force(docs, limit):
    rnd = random.Random(14)
    rows = [(i, prose(rnd, rnd.randint(0, 30)), "en", "s", 0) for i in range(300)] + [(7, "again" * 30, "en", "s", 0), (None, "x", "en", "s", 0), (900, None, "en", "s", 0), (901, "y" * 9000, "en", "s", 0)]
    bits = lambda i: bin(1 << 60 | int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16))[3:]
    sizes = {}
    for i, t, *_ in rows:
        for d in range(61):
            k = bits(i)[:d]
            sizes[k] = sizes.get(k, 0) + len((t or "").encode())
    got = op6_sharding.assign(docs(rows).withColumn("depth", F.lit("clash")), limit).collect()
    assert len(got) == len(rows)
    for r in got:
        d = next(d for d in range(61) if sizes[bits(r["doc_id"])[:d]] <= limit or d == 60)
        assert (r["depth"], r["shard"], r["shard_bytes"]) == (d, bits(r["doc_id"])[:d], sizes[bits(r["doc_id"])[:d]])


def test_sharding_of_an_empty_table_and_files(docs, tmp_path, spark):
    assert op6_sharding.assign(docs([])).collect() == []
    table = docs([prose(random.Random(i), 40) for i in range(50)]).withColumn("shard", F.lit("own"))
    op6_sharding.write_shards(table, str(tmp_path / "out"), 2000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b")).where("b > 2000").count() == 0


# -- token files


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op7_tokens.tokenizer_path())
    return [[*e.ids, 2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_files_round_trip(docs, spark, tmp_path):
    rnd = random.Random(15)
    alphabet = "abcABC .,'’sé日🤖0123\n\t\x0b\x1c ́<|>İǰß"
    texts = [*ODD, "<|endoftext|> <|ENDOFTEXT|>. a<|startoftext|>", "J̌ ǰ İ İ a ́b don't IT'S x's. U.S.A. é. .. ,.", *("".join(rnd.choices(alphabet, k=rnd.randint(1, 80))) for _ in range(200))]
    files = op7_tokens.write(docs(texts), op7_tokens.tokenizer_path(), str(tmp_path), file_bytes=20_000)
    assert len(files) > 1
    want, first = library_ids(texts), 0
    got = sorted(op7_tokens.read(spark, files).collect())
    for i, (r, ids) in enumerate(zip(got, want, strict=True)):
        assert tuple(r) == (i, first, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        first += len(ids)


def test_token_files_are_equal_in_bytes_with_skewed_lengths_and_repeated_ids(docs, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op7_tokens, "FILES", 2)
    rnd = random.Random(24)
    rows = [(i, prose(rnd, 400 if i < 60 else 4), "en", "s", 0) for i in range(600)] + [(77, prose(rnd, 30), "en", "s", 0) for _ in range(300)] + [(78, "same", "en", "s", 0)] * 9
    files = op7_tokens.write(docs(rows), op7_tokens.tokenizer_path(), str(tmp_path), file_bytes=8000)
    size = sum(len(t) + 16 for _, t, *_ in rows)
    assert size / 8000 <= len(files) < 1.5 * size / 8000 + 2
    texts = {k: sum(1 for _ in range(len(op7_tokens.Reader(path)))) for k, (_, path, _, _) in enumerate(files)}
    assert sum(texts.values()) == len(rows)
    # Bytes of text in a file, by the documents that it holds; several files hold parts of id 77.
    ids = [set(op7_tokens.Reader(path).ids.tolist()) for _, path, _, _ in files]
    assert sum(77 in x for x in ids) > 1
    by = {i: len(t) + 16 for i, t, *_ in rows if i not in (77, 78)}
    assert all(sum(by.get(i, 0) for i in x) < 2 * 8000 for x in ids)
    got = op7_tokens.read(spark, files).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted(i for i, *_ in rows)
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:], strict=False))


def test_texts_go_whole_through_a_tokenizer_of_another_kind(docs, spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert op7_tokens.Encoder(op7_tokens.tokenizer_path()).by_word and not op7_tokens.Encoder(path).by_word
    texts = ["Mixed CASE text", None, "  two  spaces\n", "é日🤖"]
    want = [[*Tokenizer.from_file(path).encode(x or "", add_special_tokens=False).ids, 2] for x in texts]
    got = op7_tokens.read(spark, op7_tokens.write(docs(texts), path, str(tmp_path))).orderBy("doc_id").collect()
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(np.array(ids, "<u4").tobytes()) for ids in want]


def test_a_reader_decompresses_only_what_is_asked_for(docs, tmp_path):
    import io

    import zstandard

    texts = [f"word {i} " * 40 for i in range(30)]
    (_, path, n, _), *more = op7_tokens.write(docs(texts), op7_tokens.tokenizer_path(), str(tmp_path))
    assert n == 30 and not more
    r = op7_tokens.Reader(path)
    want = library_ids(texts)
    assert np.frombuffer(r.tokens(17), "<u4").tolist() == want[17] and r.find(17) == [17] and r.find(99) == []
    # Any reader of zstandard gets all ids, and skips the rest of the file.
    raw = open(path, "rb").read()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert np.frombuffer(whole, "<u4").tolist() == [i for x in want for i in x]
    at = int(r.starts[17]) + int(r.entries[17][0]) - 1
    open(path, "wb").write(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :])
    damaged = op7_tokens.Reader(path)
    assert damaged.tokens(16) and damaged.tokens(18)
    with pytest.raises(Exception, match=r".+"):
        damaged.tokens(17)


def test_token_files_of_odd_tables(docs, spark, tmp_path):
    assert op7_tokens.write(docs([]), op7_tokens.tokenizer_path(), str(tmp_path / "a")) == []
    assert op7_tokens.read(spark, []).collect() == []
    rows = [(5, "b b", "en", "s", 0), (None, "a", "en", "s", 0), (5, "a", "en", "s", 0), (-3, None, "en", "s", 0)]
    got = op7_tokens.read(spark, op7_tokens.write(docs(rows), op7_tokens.tokenizer_path(), str(tmp_path / "b"))).orderBy("start").collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in got] == [(None, 2), (-3, 1), (5, 2), (5, 3)]


def test_a_full_cache_changes_nothing():
    import pyarrow as pa

    texts = [prose(random.Random(i), 50) for i in range(40)]
    small, big = op7_tokens.Encoder(op7_tokens.tokenizer_path(), most=20), op7_tokens.Encoder(op7_tokens.tokenizer_path())
    for at in range(0, 40, 10):
        assert small(pa.array(texts[at : at + 10])) == big(pa.array(texts[at : at + 10]))
    assert len(small.known) < len(big.known)


# -- pipeline


def test_pipeline_matches_its_stages_by_brute_force(spark, docs, sf):
    rnd = random.Random(16)
    item = " ".join(f"q{i}" for i in range(14))
    texts, labels = [], []
    for i in range(300):
        t = prose(rnd, rnd.randint(30, 90))
        if i % 6 == 0:
            t += " grumblewort"
        texts.append(t)
        labels.append((i, 1, int(i % 6 == 0)))
    texts += [texts[1], near_copies(rnd, texts[2], 1) if len(texts[2].split()) > 70 else texts[2], f"{texts[3]} {item} {prose(rnd, 40)}", "write to me@mail.org now " + prose(rnd, 40), None, ""]
    table = docs(texts)
    folder = sf(documents=table, benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = by_id(corpus_pipeline.run(spark, folder))

    lex = op3_toxicity.train(table, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [(i, t) for i, t in enumerate(texts) if lex.score(t or "") < 0.5]
    assert {i for i in range(300) if i % 6 == 0}.isdisjoint(i for i, _ in rows)
    comp = brute_components(rows)
    rows = [(i, t) for i, t in rows if comp[i][1] == i]
    rows = [(i, (t or "").replace(item, "")) for i, t in rows]
    make = op5_pii.Surrogates()
    c = op2_sentencepiece.codec(op2_sentencepiece.model_path())
    want = {i: c.encode(op5_pii.replaced(t, op5_pii.find(t), make)) for i, t in rows}
    assert {i: r["ids"] for i, r in got.items()} == want


def test_near_copies_stage_matches_brute_force_at_five_words_and_80_percent(spark, docs, copies):
    rnd = random.Random(17)
    # One run of five words replaced in 100: 87/105 = 0.829 at five words, 91/105 at three; two words far apart: 86/106 and 92/104.
    for _ in range(20):
        w, at = prose(rnd, 100, 10**6).split(), rnd.randrange(10, 85)
        copies += [" ".join(w), " ".join([*w[:at], *(f"r{k}" for k in range(5)), *w[at + 5 :]]), " ".join([*w[:20], "s", *w[21:70], "t", *w[71:]])]
    rows = list(enumerate(copies))
    want = {i for i, (_, root) in brute_components(rows, 5, 80).items() if i == root}
    assert want < {i for i, (_, root) in brute_components(rows).items() if i == root}
    got = [r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs(copies), "").select("doc_id").collect()]
    assert len(got) == len(want) and set(got) == want


def test_stages_keep_the_columns_and_survive_odd_rows(spark, docs, sf):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(ODD)] + [(None, "null id", "en", "s", 1), (3, "word", None, None, None)]
    table = docs(rows)
    folder = sf(documents=table, benchmark=spark.createDataFrame([(1, None)], "item_id long, text string"), labels=spark.createDataFrame([(0, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int"))
    for name, stage in corpus_pipeline.STAGES:
        for given in (table, docs([])):
            out = stage(spark, given, folder)
            assert name == "tokens" or out.columns == table.columns
            assert out.count() <= given.count()


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    assert common.shared_dir(spark)

    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                class Conf:
                    get = staticmethod(lambda key: None)

                return Conf

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Cluster)
