from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kinfold.functions import text as X
from kinfold.functions.romanise import romanise, script
from kinfold.operators import normalize

RECORD = "src byte, entity_id string, name string, addr string, country string"


@pytest.fixture
def column(spark):
    def apply(f, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
        return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]

    return apply


def test_folding(column):
    assert column(X.folded, "Ássociates", "TRÁNSALTA", "ﬁ", None) == ["Associates", "TRANSALTA", "fi", None]
    assert column(X.cleaned, "É कि", None) == ["e कि", ""]


def test_leet_repair(column):
    assert column(X.name_tokens, "br0thers 8uilders holding5 2024") == [["brothers", "builders", "holdings", "2024"]]


def test_name_tokens_drop_ids_and_domains(column):
    got = column(X.name_tokens, "Acme & Sons (id: 123) www.acme.com 12345678", "O'Neil's S.A.", None)
    assert got == [["acme", "and", "sons", "acme"], ["oneils", "sa"], []]


def test_grams(column):
    assert column(X.grams, "", "abc", "abcde") == [[], ["abc"], ["abcd", "bcde"]]


@pytest.mark.parametrize(
    ("address", "postcode", "numbers"),
    [
        ("13614 Peacockfarm Rd", "13614", []), ("013614 Peacockfarm Rd", "", ["13614"]), ("12 Main St, 12345-6789", "12345-6789", ["12", "12345", "6789"]),
        ("005 Elm St", "", ["05"]), ("5 Elm St", "", []), ("12/4B MG Road", "", ["12/4b"]), ("1 Oak, 01234", "01234", ["1234"]),
    ],
)
def test_postcode_and_house_numbers_of_the_compatible_form(column, address, postcode, numbers):
    a = column(lambda c: X.plain_address(c, compat=True), address)[0]
    assert (a["postcode"], a["house_numbers"]) == (postcode, numbers)


@pytest.mark.parametrize(
    ("address", "postcode", "numbers"),
    [
        ("13614 Peacockfarm Rd", "13614", []), ("013614 Peacockfarm Rd", "", ["13614"]), ("13614 Peacockfarm Rd, Austin 78701", "78701", ["13614"]),
        ("12 Main St, 12345-6789", "12345-6789", ["12"]), ("1 Oak, 01234", "01234", []), ("22 Elm, 12345-67890 x", "67890", ["12345", "22"]),
        ("12345 Oak, 54321\n", "54321", ["12345"]), ("12/4B MG Road", "", ["12/4b"]), ("123456 x", "", ["123456"]),
    ],
)
def test_postcode_is_the_last_run_of_five_digits_and_no_house_number(column, address, postcode, numbers):
    a = column(X.plain_address, address)[0]
    assert (a["postcode"], a["house_numbers"]) == (postcode, numbers)


#: Worked out by hand: name, all words, core words, alias, whether it is a domain.
NAMES = [
    ("Ácme Holdings Limited", "acme holdings ltd", "acme holdings", "", False),
    ("The Smith & Sons Co.", "the smith and sons co", "smith sons", "", False),
    ("J.P. Morgan Services, Inc", "jp morgan services inc", "jp morgan", "", False),
    ("Br0wn's Centre (ID: 4521)", "browns center", "browns", "", False),
    ("www.example-shop.co.in", "example shop", "example shop", "", True),
    ("Tata Motors dba Tata Mfg Intl", "tata motors dba tata manufacturing international", "tata motors tata manufacturing international", "tata mfg intl", False),
    ("Société Générale S.A.", "societe generale sa", "generale", "", False),
    ("Acme a.k.a Widget Works", "acme aka widget works", "acme widget works", "widget works", False),
    ("7-Eleven 24 Store", "7 eleven 24 store", "7 eleven 24 store", "", False),
    (None, "", "", "", False),
    ("A & B Bros", "a and b brothers", "brothers", "", False),
    ("Customer 12345678 Ltd", "customer ltd", "customer", "", False),
    ("O'Brien+Partners LLP", "obrien and partners llp", "obrien", "", False),
    ("कमल Pvt Ltd", "kamal pvt ltd", "kamal", "", False),
    ("PVTLTD Steel", "pvt ltd steel", "steel", "", False),
    ("Int3rnational Cafe formerly Old-Place 9", "international cafe formerly old place 9", "international cafe old place 9", "old place 9", False),
]
#: Worked out by hand: address, country, state, words and numbers, words, numbers, whether it is missing.
ADDRESSES = [
    ("12 Oak St, Austin, TX", "US", "tx", "12 oak street austin", "oak austin", "12", False),
    ("5th Avenue, New York", "US", "ny", "5 avenue", "", "5", False),
    ("007 MG Road, Bengaluru, Karnataka", "India", "ka", "7 mg road bengaluru", "mg bengaluru", "7", False),
    ("<null>", "US", "", "", "", "", True),
    ("N/A", "US", "", "", "", "", True),
    ("Flat 4B, 2nd Floor, Goa", "India", "ga", "flat 4 b 2 floor", "", "4 2", False),
    ("Texas", "US", "tx", "", "", "", True),
    ("1 Rue de la Paix, Paris", "France", "", "1 rue de la paix paris", "paix paris", "1", False),
    ("Twelve Oaks, TX, Texas", "US", "tx", "twelve oaks", "twelve oaks", "", False),
    ("१२ Main Rd, Kerala", "India", "kl", "12 main road", "", "12", False),
    ("12 Main St, Texas", "France", "", "12 main street texas", "texas", "12", False),
    ("Plot 3, Sector 21, Chandigarh", "India", "ch", "plot 3 sector 21", "", "3 21", False),
    ("Opp. City Mall, 45 Hwy 6", "US", "", "opposite city mall 45 highway 6", "mall", "45 6", False),
    ("first cross, third main", "India", "", "1 cross 3 main", "", "", False),
]


def test_names_worked_out_by_hand(spark):
    df = spark.createDataFrame([(1, str(i), n, "", "US") for i, (n, *_) in enumerate(NAMES)], RECORD)
    got = {r["entity_id"]: r for r in normalize.names(df).collect()}
    for i, (name, words, core, alias, domain) in enumerate(NAMES):
        r = got[str(i)]
        assert (r["name_str"], r["core_str"], r["alias_str"], r["is_domain"]) == (words, core, alias, domain), name
        assert r["concat"] == core.replace(" ", "")


def test_addresses_worked_out_by_hand(spark):
    df = spark.createDataFrame([(1, str(i), "x", a, c) for i, (a, c, *_) in enumerate(ADDRESSES)], RECORD)
    got = {r["entity_id"]: r for r in normalize.addresses(df).collect()}
    for i, (address, _, state, text, words, numbers, missing) in enumerate(ADDRESSES):
        r = got[str(i)]
        assert (r["state"], r["addr_str"], " ".join(r["addr_tok"]), " ".join(r["addr_num"]), r["addr_missing"]) == (state, text, words, numbers, missing), address


def test_dictionaries_of_native_words_and_states(spark):
    from kinfold.operators import learn

    rows, links = [], []
    for i in range(25):
        rows += [(1, f"S1-{i}", f"kamla shop {i}", f"{i} road, kerala", "India"), (2, f"S2-{i}", f"कमल shop {i}", f"{i} road, केरल", "India")]
        links.append((f"S1-{i}", f"S2-{i}"))
    rows += [(2, "S2-x", "कमल", "केरल", "France"), (2, "S2-y", "दिल्ली", "गोवा", "India")]
    e, l = spark.createDataFrame(rows, RECORD), spark.createDataFrame(links, "s1_id string, cand_id string")
    tokens, states = learn.dictionaries(normalize.unromanised(e), l)
    assert [tuple(r) for r in tokens.collect()] == [("कमल", "kamla")] and [tuple(r) for r in states.collect()] == [("केरल", "kl")]
    got = {r["entity_id"]: r for r in normalize.normalized(e, tokens, True, states).collect()}
    assert got["S2-3"]["name_str"] == "kamla shop 3" and got["S2-3"]["state"] == "kl" and got["S2-3"]["addr_str"] == "3 road"
    assert got["S2-x"]["state"] == "kl" and got["S2-x"]["addr_missing"]  # a state of any country
    assert got["S2-y"]["name_str"] == "dili" and got["S2-y"]["state"] == ""
    assert learn.dictionaries(normalize.unromanised(e), l.limit(3))[1].count() == 0


def test_plain_address_edge_cases(column):
    a, b, c = column(X.plain_address, None, "  ", "Near City Mall, 12 Oak St")
    assert a["is_missing"] and b["is_missing"] and a["tokens"] == [] and not c["is_missing"]
    assert c["landmark"] == "Near City Mall" and c["norm"] == "12 oak street"


def test_plain_name(column):
    n = column(X.plain_name, "-- [Inc] Médical & Tech Svcs Pvt. Ltd.", "healthwomensunited.com", None)
    assert n[0]["norm"] == "medical and technologies services" and n[0]["suffix"] == "inc"
    assert n[1]["is_domain"] and n[1]["despaced"] == "healthwomensunited"
    assert n[2]["norm"] == "" and not n[2]["is_domain"]
    spelled = column(lambda c: X.plain_name(c, canonical_suffix=False), "Acme Limited")[0]
    assert spelled["suffix"] == "limited" and column(X.plain_name, "Acme Limited")[0]["suffix"] == column(X.plain_name, "Acme Ltd.")[0]["suffix"]


def test_romanisation(spark, column):
    assert [romanise(x) for x in ("कमल", "दिल्ली", "मुंबई", "abc", "")] == ["kamal", "dili", "munbai", "abc", ""]
    assert column(script, "कमल", "abc", "ಕನ್ನಡ") == [0, None, 7]


def test_states_last_one_wins_and_leaves_the_address(spark):
    rows = [(1, "a", "x", "12 Oak St, Texas, TX", "US"), (2, "b", "x", "Texas", "US"), (2, "c", "x", "5th Main, Kerala", "India"), (2, "d", "x", "12 Rue, Texas", "France"), (3, "e", "x", None, "US")]
    got = {r["entity_id"]: r for r in normalize.addresses(spark.createDataFrame(rows, RECORD)).collect()}
    assert (got["a"]["state"], got["a"]["addr_str"], got["a"]["addr_num"]) == ("tx", "12 oak street", ["12"])
    assert got["b"]["state"] == "tx" and got["b"]["addr_missing"]
    assert got["c"]["state"] == "kl" and got["c"]["addr_str"] == "5 main"
    assert got["d"]["state"] == "" and got["d"]["addr_tok"] == ["texas"]
    assert got["e"]["addr_missing"] and got["e"]["state"] == ""


def test_names_with_native_scripts_and_dictionary(spark):
    rows = [(2, "a", "कमल Traders Pvt Ltd", "", "India"), (2, "b", "Plain Name dba Other Thing", "", "US")]
    df = spark.createDataFrame(rows, RECORD)
    got = {r["entity_id"]: r for r in normalize.names(df).collect()}
    assert got["a"]["name_str"] == "kamal traders pvt ltd" and got["a"]["core_str"] == "kamal traders" and got["a"]["concat"] == "kamaltraders"
    assert got["b"]["alias_str"] == "other thing"
    learned = spark.createDataFrame([("कमल", "kamala")], "native string, latin string")
    assert {r["entity_id"]: r["core_str"] for r in normalize.names(df, learned).collect()}["a"] == "kamala traders"


def test_word_edges_are_those_of_the_sql(spark):
    """ß and other letters beyond ASCII end a word in RE2 (SQL); Java takes them for a part of it."""
    import duckdb

    from kinfold.plans.sql import ADR, ENT, NAM, PLAIN, TOK, joined

    texts = ["Acme dbaß x\n12 stß 40 Elm, noneß 5thß", "acme.comß ltdß\nnearß 77ß x, 88 y", "foo dba bar\rbaz\n7\x0bst 9 rd", "Größe coß pvtß\n33å 44 opp.ß z"]
    docs = [(i, t, "de") for i, t in enumerate(texts)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    from kinfold.sources.records import document_entities

    e = document_entities(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    n = normalize.plain(normalize.normalized(e, native=False))
    got = n.orderBy("entity_id").select("entity_id", "name_str", "alias_str", "is_domain", "addr_str", F.array_join("addr_num", " "), "n.norm", "n.suffix", "a.norm", "a.landmark", F.array_join("a.house_numbers", " ")).collect()
    want = con.execute(
        f"WITH {ENT}, {TOK}, {NAM}, {ADR}, {PLAIN} SELECT rec.entity_id, name_str, alias_str, rec.is_domain, addr_str, {joined('addr_num')}, n_norm, n_suffix, a_norm, landmark, {joined('house')} FROM rec JOIN pl USING (entity_id) ORDER BY 1"
    ).fetchall()
    assert [tuple(r) for r in got] == want
