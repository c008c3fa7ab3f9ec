"""DuckDB SQL that gives the same rows as the queries, out of common table expressions."""

from __future__ import annotations

from ..functions import vocabulary as V
from ..functions.text import state_table
from ..operators.blocking import caps
from ..operators.decode import TAUS


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def rr(x: str, *steps: tuple[str, str]) -> str:
    for pattern, new in steps:
        x = f"regexp_replace({x}, {q(pattern.replace('(?U)', ''))}, {q(new.replace('$', chr(92)))}, 'g')"
    return x


def case(x: str, table: dict[str, str], other: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {other} END"


def names(stop: list[str]) -> str:
    return "(" + ", ".join(map(q, stop)) + ")"


def split(x: str, by: str = " ") -> str:
    return f"list_filter(string_split({x}, {q(by)}), lambda x: x <> '')"


def mapped(x: str, table: dict[str, str]) -> str:
    return f"list_filter(flatten(list_transform({x}, lambda x: string_split({case('x', table, 'x')}, ' '))), lambda x: x <> '')"


def joined(x: str, by: str = " ") -> str:
    return f"coalesce(array_to_string({x}, {q(by)}), '')"


def unique(x: str) -> str:
    """Distinct elements in order of their first place; x is a column."""
    return f"list_filter({x}, lambda z, k: list_position({x}, z) = k)"


def clean(x: str) -> str:
    return f"strip_accents(lower(coalesce({x}, '')))"


ENT = f"""ent AS (SELECT (doc_id % 3 + 1)::TINYINT AS src, 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id, split_part(t, chr(10), 1) AS name,
length(t) || ' ' || {joined("string_split(t, chr(10))[2:]")} || ', ' || ['texas', 'ohio', 'kerala', 'goa', 'paris'][length(t) % 5 + 1] AS addr,
CASE lang WHEN 'en' THEN 'US' WHEN 'de' THEN 'India' ELSE coalesce(lang, '') END AS country, t AS text FROM (SELECT *, coalesce(text, '') AS t FROM documents))"""
TRUTH = "truth AS (SELECT a.entity_id AS s1_id, b.entity_id AS cand_id FROM ent a JOIN ent b ON a.text = b.text WHERE a.src = 1 AND b.src <> 1 AND a.text <> '')"

_tokens = rr(clean("name"), *V.NAME_STEPS)
_leet = rf"list_transform({split(_tokens)}, lambda x: CASE WHEN regexp_matches(x, '\p{{L}}') AND regexp_matches(x, '\d') THEN translate(x, '{V.LEET_FROM}', '{V.LEET_TO}') ELSE x END)"
_alias = "trim(" + rr(f"regexp_extract({clean('name')}, {q(V.ALIAS + r'\s+(.+)$')}, 1)", *V.ALIAS_STEPS) + ")"
TOK = f"tok AS (SELECT *, {_leet} AS raw_tok FROM ent)"
NAM = f"""nam0 AS (SELECT *, {mapped("raw_tok", V.NAME_CANON)} AS name_tok FROM tok), nam1 AS (SELECT *, list_filter(name_tok, lambda x: x NOT IN {names(V.NAME_STOP)}) AS core_tok FROM nam0),
nam AS (SELECT *, {joined("name_tok")} AS name_str, {joined("core_tok")} AS core_str, {joined("core_tok", "")} AS concat, {_alias} AS alias_str, regexp_matches({clean("name")}, {q(V.DOMAIN)}) AS is_domain FROM nam1)"""
_digits = "".join(chr(b + d) for b in range(0x0966, 0x0DE7, 0x80) for d in range(10))
_base = rr(f"translate({clean('addr')}, '{_digits}', '{'0123456789' * 9}')", *V.ADDRESS_STEPS)
_zeros = lambda x: rf"regexp_replace({x}, '^0+(\d)', '\1')"
ADR_PARTS = f"""adr0 AS (SELECT *, list_transform(string_split({_base}, ','), lambda c: trim({rr("c", (V.NOT_TOKEN, " "), (r"\s+", " "))})) AS parts FROM nam),
adr1 AS (SELECT *, list_transform(parts, lambda c: {case("country || '|' || c", state_table(), "NULL")}) AS codes FROM adr0)"""
_apart = split(rr("rest", *V.APART_STEPS))
ADR_REST = f"""adr2 AS (SELECT *, coalesce(list_filter(codes, lambda c: c IS NOT NULL)[-1], '') AS state, {joined("list_filter(parts, lambda c, i: codes[i] IS NULL AND c <> '')")} AS rest FROM adr1),
adr3 AS (SELECT *, list_transform(regexp_extract_all(rest, '\\d+'), lambda x: {_zeros("x")}) AS addr_num, {mapped(_apart, V.ADDR_CANON)} AS addr_all FROM adr2),
rec AS (SELECT *, {joined(f"list_transform(addr_all, lambda x: {_zeros('x')})")} AS addr_str, list_filter(addr_all, lambda x: NOT regexp_full_match(x, '\\d+') AND x NOT IN {names(V.ADDR_STOP)}) AS addr_tok, trim(rest) = '' AS addr_missing FROM adr3)"""
ADR = f"{ADR_PARTS}, {ADR_REST}"
REC = ", ".join((ENT, TOK, NAM, ADR))

# Another script: consonants that candidates are written with, and what the rules make of them.
LATIN, LETTERS, DIGITS = "kgcjtdnpbmyrlvsh", "कगचजटडनपबमयरलवसह", "०१२३४५६७८९"
SOUNDS = {"क": "k", "ग": "g", "च": "ch", "ज": "j", "ट": "t", "ड": "d", "न": "n", "प": "p", "ब": "b", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "v", "स": "s", "ह": "h"}
NATIVE = r"[\x{0900}-\x{0DFF}]"


def romanised(x: str) -> str:
    """A token of these letters in Latin ones: a consonant has an a behind it unless it is the last character; doubled letters are one."""
    other = "CASE WHEN regexp_matches(c, '[A-Za-z0-9]') THEN lower(c) ELSE '' END"
    sound = f"CASE WHEN regexp_matches(c, '{NATIVE}') THEN {case('c', SOUNDS, repr(''))} || CASE WHEN i < length({x}) THEN 'a' ELSE '' END ELSE {other} END"
    out = f"array_to_string(list_transform(string_split({x}, ''), lambda c, i: {sound}), '')"
    for c in "abcdefghijklmnopqrstuvwxyz0123456789":
        out = f"regexp_replace({out}, '{c}{c}+', '{c}', 'g')"
    return out


_other = f"CASE WHEN src <> 1 THEN translate(lower(name), '{LATIN}', '{LETTERS}') ELSE name END AS name, CASE WHEN src <> 1 THEN translate(lower(addr), '{LATIN}0123456789', '{LETTERS}{DIGITS}') ELSE addr END AS addr"
NATIVE_TOK = ", ".join((ENT.replace("ent AS", "ent0 AS", 1), f"ent AS (SELECT src, entity_id, {_other}, country, text FROM ent0)", TRUTH, TOK))
NATIVE_ADR = ", ".join((NAM, ADR_PARTS))
_best = "SELECT native, {0} FROM (SELECT *, row_number() OVER (PARTITION BY native ORDER BY n DESC, {0}) AS r, sum(n) OVER (PARTITION BY native) AS total FROM {1}) WHERE r = 1 AND n >= 2 AND n / total {2}"
LEARNED_TOKENS = f"""lt AS (SELECT unnest(list_zip(a.raw_tok, b.raw_tok)) AS z FROM truth t JOIN tok a ON a.entity_id = s1_id JOIN tok b ON b.entity_id = cand_id WHERE len(a.raw_tok) = len(b.raw_tok)),
lc AS (SELECT z[2] AS native, z[1] AS latin, count(*) AS n FROM lt WHERE regexp_matches(z[2], '{NATIVE}') GROUP BY ALL), dict AS ({_best.format("latin", "lc", ">= 0.4")})"""
LEARNED_STATES = f"""ls AS (SELECT unnest(b.parts) AS native, coalesce(list_filter(a.codes, lambda c: c IS NOT NULL)[-1], '') AS code FROM truth t JOIN adr1 a ON a.entity_id = s1_id JOIN adr1 b ON b.entity_id = cand_id),
lsc AS (SELECT native, code, count(*) AS n FROM ls WHERE code <> '' AND regexp_matches(native, '{NATIVE}') GROUP BY ALL), sdict AS ({_best.format("code", "lsc", "> 0.6")})"""
ROMANISED_TOK = f"""rt0 AS (SELECT entity_id, unnest(raw_tok) AS t, unnest(range(1, len(raw_tok) + 1)) AS i FROM tok),
rt1 AS (SELECT entity_id, i, CASE WHEN regexp_matches(t, '{NATIVE}') THEN coalesce(latin, {romanised("t")}) ELSE t END AS t FROM rt0 LEFT JOIN dict ON t = native),
rt2 AS (SELECT entity_id, list(t ORDER BY i) FILTER (t <> '') AS rt FROM rt1 GROUP BY 1), rtok AS (SELECT tok.* EXCLUDE (raw_tok), coalesce(rt, []) AS raw_tok FROM tok LEFT JOIN rt2 USING (entity_id))"""

_fold = lambda c: f"strip_accents(coalesce({c}, ''))"
_low = "lower(" + rr(_fold("name"), *V.PLAIN_STEPS[:3], (r"^[^\p{L}\p{N}]+", "")) + ")"
_last = "(?s)^(.*[^0-9]|)([0-9]{5}(?:-[0-9]{4})?)([^0-9].*|)$"
_rest = rr(_fold("addr"), (V.LANDMARK, " "))
PLAIN = f"""pl0 AS (SELECT *, {_low} AS low, {_rest} AS arest, trim(coalesce(addr, '')) = '' AS is_missing FROM ent),
pl1 AS (SELECT *, regexp_extract(low, {q(rf"\b({V.LEGAL})\b\.?")}, 1) AS suffix0, {mapped("list_filter(regexp_split_to_array(" + rr("low", (rf"\b(?:{V.LEGAL})\b\.?", " "), ("&", " and "), (r"[^a-z0-9\s]", " ")) + r", '\s+'), lambda x: x <> '')", V.NAME_WORDS)} AS n_tok,
(regexp_matches(trim({_fold("name")}), {q(V.PLAIN_DOMAIN)}) OR (NOT contains(trim({_fold("name")}), ' ') AND length(trim({_fold("name")})) > 8 AND regexp_matches({_fold("name")}, '\\p{{L}}'))) AS is_domain,
CASE WHEN is_missing THEN '' ELSE regexp_extract(arest, '{_last}', 2) END AS postcode,
CASE WHEN is_missing THEN [] ELSE {mapped("list_filter(regexp_split_to_array(" + rr("lower(arest)", (r"[^a-z0-9\s]", " ")) + r", '\s+'), lambda x: x <> '')", V.STREET_WORDS)} END AS a_tok,
CASE WHEN is_missing THEN [] ELSE list_distinct(list_transform(regexp_extract_all(regexp_replace(arest, '{_last}', '\\1 \\3'), {q(V.HOUSE_NUMBER)}, 1), lambda x: lower(x))) END AS house0,
trim(regexp_extract({_fold("addr")}, {q(V.LANDMARK)})) AS landmark FROM pl0),
pl AS (SELECT *, {joined("n_tok")} AS n_norm, {joined("list_sort(n_tok)")} AS n_sorted, {joined("n_tok", "")} AS n_despaced, {case("suffix0", V.LEGAL_CANON, "suffix0")} AS n_suffix, {joined("a_tok")} AS a_norm, list_sort(house0) AS house FROM pl1)"""

_pairs = lambda h: f"flatten(list_transform({h}, lambda x, i: list_transform(list_filter({h}, lambda y, j: j > i), lambda y: least(x, y) || '|' || greatest(x, y))))"
_product = lambda a, b: f"flatten(list_transform({a}, lambda x: list_transform({b}, lambda y: x || '|' || y)))"
_long = lambda a, n: f"list_filter({a}, lambda x: length(x) >= {n})"
_one = lambda ok, v: f"CASE WHEN {ok} THEN [{v}] ELSE []::VARCHAR[] END"
KEY_SQL = {
    "nt": "ct", "np": _pairs("ct[:5]"), "nc": _one("length(concat) >= 5", "left(concat, 8)"), "ap": _product("an", "aw[:4]"), "at": _long("aw[:8]", 4),
    "nn": _product("ct[:3]", "an"), "nw": _product("ct[:3]", _long("aw[:4]", 4)), "aa": _pairs("aw[:5]"),
    "ns": _one("state <> '' AND length(concat) >= 4", "left(concat, 8) || '|' || state"), "nx": _one("length(concat) >= 5", "concat"),
}
KEYS = f"""kb0 AS (SELECT src, entity_id, country, concat, state, {_long("core_tok", 2)} AS c0, {_long("addr_tok", 3)} AS a0, addr_num AS n0 FROM rec),
kb AS (SELECT *, ({unique("c0")})[:6] AS ct, {unique("a0")} AS aw, ({unique("n0")})[:3] AS an FROM kb0),
keys AS (""" + " UNION ALL ".join(f"SELECT src, entity_id, country, '{k}' AS kt, unnest(list_distinct({v})) AS key FROM kb" for k, v in KEY_SQL.items()) + ")"  # fmt: skip
USABLE = f"""cn AS (SELECT country, count(*) AS n FROM ent WHERE src <> 1 GROUP BY 1),
usable AS (SELECT country, kt, key, df, ln(n) - ln(df) AS w FROM (SELECT country, kt, key, count(*) AS df FROM keys WHERE src <> 1 GROUP BY ALL) JOIN cn USING (country) WHERE df <= {case("kt", {k: str(v) for k, v in caps().items()}, "NULL")}::BIGINT)"""
SCORED = "scored AS (SELECT a.entity_id AS s1_id, b.entity_id AS cand_id, b.src, " + ", ".join(f"round(coalesce(sum(w) FILTER (kt = '{k}'), 0), 6) AS {k}" for k in V.KEY_TYPES) + ", round(sum(w), 6) AS bscore FROM keys a JOIN usable u USING (country, kt, key) JOIN keys b USING (country, kt, key) WHERE a.src = 1 AND b.src <> 1 GROUP BY ALL)"


def top(source: str, n: int, by: str = "s1_id") -> str:
    return f"SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY bscore DESC, cand_id) <= {n}"


BLOCK = ", ".join((REC, KEYS, USABLE, SCORED))
#: Pairs with a probability out of the block score.
PAIRS = f"{BLOCK}, {TRUTH}, pairs AS (SELECT s1_id, cand_id, src, bscore, round(bscore / (bscore + 40), 6) AS p FROM ({top('scored', 25)}))"

_sig = lambda i: case("kt", {k: str(v[i]) for k, v in V.SIGNALS.items()}, "NULL") + "::DOUBLE"
SIGNALS = f"""sig0 AS (SELECT src, entity_id, country, n_tok, CASE WHEN n_despaced = '' THEN [] WHEN length(n_despaced) <= 4 THEN [n_despaced] ELSE list_transform(range(1, length(n_despaced) - 2), lambda i: substr(n_despaced, i, 4)) END AS grams, postcode, house FROM pl),
keys AS (SELECT src, entity_id, country, 'name' AS kt, unnest(list_distinct({_long("n_tok", 2)})) AS key FROM sig0 UNION ALL SELECT src, entity_id, country, 'gram', unnest(list_distinct({_long("grams", 4)})) FROM sig0
UNION ALL SELECT src, entity_id, country, 'postcode', postcode FROM sig0 WHERE length(postcode) >= 3 UNION ALL SELECT src, entity_id, country, 'house', unnest(list_distinct(house)) FROM sig0),
cn AS (SELECT src, country, count(*) AS n FROM ent WHERE src <> 1 GROUP BY ALL),
usable AS (SELECT src, country, kt, key, df, {_sig(3)} / sqrt(df) AS w FROM (SELECT src, country, kt, key, count(*) AS df FROM keys WHERE src <> 1 GROUP BY ALL) JOIN cn USING (src, country) WHERE df <= greatest(1, least(floor(n * {_sig(0)}), {_sig(2)})))"""
PLAIN_SCORED = "scored AS (SELECT a.entity_id AS s1_id, b.entity_id AS cand_id, b.src, " + ", ".join(f"round(coalesce(sum(w) FILTER (kt = '{k}'), 0), 6) AS {k}" for k in V.SIGNALS) + ", round(sum(w), 6) AS bscore FROM keys b JOIN usable u USING (src, country, kt, key) JOIN keys a USING (country, kt, key) WHERE a.src = 1 AND b.src <> 1 GROUP BY ALL)"
PLAIN_BLOCK = ", ".join((ENT, PLAIN, SIGNALS, PLAIN_SCORED))


def both(record: str, *columns: str, pairs: str = "pairs") -> str:
    return f"SELECT p.*, " + ", ".join(f"{x}.{c} AS {c}_{x}" for c in columns for x in "ab") + f" FROM {pairs} p JOIN {record} a ON a.entity_id = s1_id JOIN {record} b ON b.entity_id = cand_id"  # noqa: F541


def jac(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END"


def f_score(tp: str, named: str, true: str) -> str:
    return f"CASE WHEN {true} = 0 AND {named} = 0 THEN 1.0 WHEN {true} = 0 OR {named} = 0 THEN 0.0 ELSE 1.25 * {tp} / (0.25 * {true} + {named}) END"


COUNTS = """per AS (SELECT e.entity_id AS s1_id, (SELECT count(*) FROM links l WHERE l.s1_id = e.entity_id) AS named, (SELECT count(*) FROM truth t WHERE t.s1_id = e.entity_id) AS true_,
(SELECT count(*) FROM links l JOIN truth t USING (s1_id, cand_id) WHERE l.s1_id = e.entity_id) AS tp FROM ent e WHERE src = 1)"""
METRICS = f"""SELECT round(avg(f), 6) AS f05, round(avg(f) FILTER (true_ = 0), 6) AS f05_singletons, round(avg(f) FILTER (true_ > 0), 6) AS f05_nonsingletons, round(sum(tp) / greatest(sum(named), 1), 6) AS micro_precision,
round(sum(tp) / greatest(sum(true_), 1), 6) AS micro_recall, count(*) AS n_entities FROM (SELECT *, {f_score("tp", "named", "true_")} AS f FROM per)"""

_num = lambda x: f"list_filter({x}, lambda z: length(z) BETWEEN 1 AND 9)"
_w1, _w2 = "PARTITION BY s1_id", "PARTITION BY cand_id"
_words = lambda x: f"list_filter(list_distinct(string_split({x}, ' ')), lambda z: z <> '')"
WORDS = f"""nb AS ({both("rec", "name_str")}), wl AS (SELECT s1_id, cand_id, y, list_filter(wb, lambda z: NOT list_contains(wa, z)) AS extra, list_filter(wa, lambda z: NOT list_contains(wb, z)) AS miss FROM
(SELECT nb.*, (truth.cand_id IS NOT NULL)::INTEGER AS y, {_words("name_str_a")} AS wa, {_words("name_str_b")} AS wb FROM nb LEFT JOIN truth USING (s1_id, cand_id))),
lw AS (SELECT s1_id, cand_id, y, 'extra' AS side, unnest(extra) AS tok FROM wl UNION ALL SELECT s1_id, cand_id, y, 'miss', unnest(miss) FROM wl),
llr AS (SELECT side, tok, ln((sum(y) + 1) / (sum(1 - y) + 1)) - ln(((SELECT sum(y) FROM wl) + 1) / ((SELECT sum(1 - y) FROM wl) + 1)) AS llr FROM lw GROUP BY ALL HAVING count(*) >= 5)"""

SQL: dict[str, str] = {
    "entities": f"WITH {ENT} SELECT src, entity_id, name, addr, country FROM ent",
    "truth_links": f"WITH {ENT}, {TRUTH} SELECT * FROM truth",
    "name_tokens": f"WITH {ENT}, {TOK} SELECT entity_id, {joined('raw_tok')} AS tokens, len(raw_tok)::INTEGER AS n FROM tok",
    "names": f"WITH {ENT}, {TOK}, {NAM} SELECT entity_id, name_str, core_str, concat, alias_str, is_domain FROM nam",
    "addresses": f"WITH {REC} SELECT entity_id, state, {joined('addr_tok')} AS addr_tok, {joined('addr_num')} AS addr_num, addr_str, addr_missing FROM rec",
    "plain_names": f"WITH {ENT}, {PLAIN} SELECT entity_id, n_norm AS norm, n_sorted AS sorted, n_despaced AS despaced, n_suffix AS suffix, is_domain FROM pl",
    "plain_addresses": f"WITH {ENT}, {PLAIN} SELECT entity_id, a_norm AS norm, postcode, {joined('house', ',')} AS house_numbers, CASE WHEN is_missing THEN '' ELSE landmark END AS landmark, is_missing FROM pl",
    "grams": f"WITH {ENT}, {PLAIN}, {SIGNALS} SELECT gram, count(*) AS n FROM (SELECT unnest(grams) AS gram FROM sig0) GROUP BY 1",
    **{f"keys_{k}": f"WITH {REC}, {KEYS} SELECT entity_id, country, key FROM keys WHERE kt = '{k}'" for k in V.KEY_TYPES},
    "key_weights": f"WITH {REC}, {KEYS}, {USABLE} SELECT country, kt, key, df, round(w, 6) AS w FROM usable",
    "signal_postings": f"WITH {ENT}, {PLAIN}, {SIGNALS} SELECT src, country, kt, key, df, round(w, 6) AS w FROM usable",
    "block_idf": f"WITH {BLOCK} {top('scored', 120)}",
    "block_rarity": f"WITH {PLAIN_BLOCK} {top('scored', 25, 's1_id, src')}",
    "union_candidates": f"WITH {PLAIN_BLOCK} SELECT s1_id, cand_id, src FROM scored",
    "blocking_diagnostics": f"WITH {PAIRS}, links AS (SELECT s1_id, cand_id FROM pairs), {COUNTS} SELECT round(sum(tp) / sum(true_), 6) AS recall_ceiling, round(avg(named), 6) AS avg_candidates_per_s1, sum(true_)::BIGINT AS total_true_edges, sum(tp)::BIGINT AS recovered_edges FROM per",
    "overlap_features": f"""WITH {PAIRS}, f AS ({both("rec", "core_tok", "addr_tok", "addr_num", "state", "concat", "name", "addr_missing", "is_domain")}),
g AS (SELECT *, len(list_intersect(list_distinct(core_tok_a), list_distinct(core_tok_b))) AS ci, len(list_intersect(list_distinct(addr_tok_a), list_distinct(addr_tok_b))) AS ai, len(list_intersect(list_distinct(addr_num_a), list_distinct(addr_num_b))) AS ni FROM f)
SELECT s1_id, cand_id, ci::INTEGER AS c_inter, len(core_tok_a)::INTEGER AS c_len_a, len(core_tok_b)::INTEGER AS c_len_b, ai::INTEGER AS aw_inter, len(addr_tok_a)::INTEGER AS aw_len_a, len(addr_tok_b)::INTEGER AS aw_len_b, ni::INTEGER AS num_inter,
len(addr_num_a)::INTEGER AS num_len_a, len(addr_num_b)::INTEGER AS num_len_b, coalesce(addr_num_a[1] = addr_num_b[1], false)::INTEGER AS num_first_eq, (len(addr_num_a) > 0 AND len(addr_num_b) > 0 AND ni = 0)::INTEGER AS num_conflict,
CASE WHEN state_a = '' OR state_b = '' THEN 0 WHEN state_a = state_b THEN 1 ELSE -1 END::INTEGER AS state_cmp, addr_missing_b::INTEGER AS addr_missing_b, is_domain_b::INTEGER AS is_domain_b,
({joined("list_transform(core_tok_a, lambda x: left(x, 1))", "")} = concat_b)::INTEGER AS acronym_b, 0 AS native_b, src::INTEGER AS src_b, length(concat_a)::INTEGER AS x_len_a, length(concat_b)::INTEGER AS x_len_b,
len(list_filter(range(1, least(length(concat_a), length(concat_b)) + 1), lambda i: left(concat_a, i) = left(concat_b, i)))::INTEGER AS x_prefix,
round(ci / greatest(len(core_tok_a), 1), 6) AS c_cov_a, round(ci / greatest(len(core_tok_b), 1), 6) AS c_cov_b, round(ai / greatest(len(addr_tok_b), 1), 6) AS aw_cov_b, round(ni / greatest(len(addr_num_b), 1), 6) AS num_cov_b FROM g""",
    "plain_features": f"""WITH {PLAIN_BLOCK}, pairs AS ({top("scored", 25, "s1_id, src")}), gr AS (SELECT pl.*, grams FROM pl JOIN sig0 USING (entity_id)),
f AS ({both("gr", "n_norm", "n_sorted", "n_despaced", "n_tok", "grams", "n_suffix", "is_missing", "a_norm", "a_tok", "postcode", "house")})
SELECT s1_id, cand_id, (n_norm_a = n_norm_b AND n_norm_a <> '')::INTEGER AS name_exact, (n_sorted_a = n_sorted_b AND n_sorted_a <> '')::INTEGER AS name_sorted_exact, (n_despaced_a = n_despaced_b AND n_despaced_a <> '')::INTEGER AS name_despaced_exact,
round({jac("list_distinct(grams_a)", "list_distinct(grams_b)")}, 6) AS name_char_ngram_jaccard, round({jac("list_distinct(n_tok_a)", "list_distinct(n_tok_b)")}, 6) AS name_token_jaccard, coalesce(n_tok_a[1] = n_tok_b[1], false)::INTEGER AS name_first_token_match,
round(CASE WHEN greatest(length(n_norm_a), length(n_norm_b)) > 0 THEN least(length(n_norm_a), length(n_norm_b)) / greatest(length(n_norm_a), length(n_norm_b)) ELSE 1 END, 6) AS name_len_ratio,
(n_suffix_a = n_suffix_b AND n_suffix_a <> '')::INTEGER AS suffix_match, (n_suffix_a <> '' AND n_suffix_b <> '' AND n_suffix_a <> n_suffix_b)::INTEGER AS suffix_conflict,
(NOT is_missing_a AND NOT is_missing_b AND a_norm_a = a_norm_b)::INTEGER AS addr_exact, round(CASE WHEN NOT is_missing_a AND NOT is_missing_b THEN {jac("list_distinct(a_tok_a)", "list_distinct(a_tok_b)")} ELSE 0 END, 6) AS addr_token_jaccard,
(postcode_a <> '' AND postcode_b <> '')::INTEGER AS postcode_both_present, (postcode_a <> '' AND postcode_a = postcode_b)::INTEGER AS postcode_match, round({jac("house_a", "house_b")}, 6) AS house_num_overlap, (len(house_a) > 0 AND len(house_b) > 0)::INTEGER AS house_num_any,
is_missing_a::INTEGER AS addr_s1_missing, is_missing_b::INTEGER AS addr_cand_missing, (is_missing_a OR is_missing_b)::INTEGER AS addr_either_missing, (src = 2)::INTEGER AS is_source2 FROM f""",
    "jaro_winkler": f"WITH {PAIRS}, f0 AS ({both('rec', 'core_str')}), f AS (SELECT s1_id, cand_id, {rr('core_str_a', ('[^a-z0-9 ]', ''))} AS a, {rr('core_str_b', ('[^a-z0-9 ]', ''))} AS b FROM f0) SELECT s1_id, cand_id, round(CASE WHEN a = b THEN 1 WHEN a = '' OR b = '' THEN 0 ELSE jaro_winkler_similarity(a, b) END, 6) AS jw FROM f",
    "number_relations": f"""WITH {PAIRS}, f AS ({both("rec", "addr_num")}), g AS (SELECT s1_id, cand_id, {_num("addr_num_a")} AS na, {_num("addr_num_b")} AS nb FROM f),
x AS (SELECT s1_id, cand_id, na, nb, unnest(na) AS a FROM g), y AS (SELECT s1_id, cand_id, na, nb, a, unnest(nb) AS b FROM x),
z AS (SELECT s1_id, cand_id, bool_or(a::BIGINT <> b::BIGINT AND length(a) = length(b) AND length(a) >= 2 AND abs(a::BIGINT - b::BIGINT) <= 20 AND NOT list_contains(nb, a) AND NOT list_contains(na, b)) AS near,
bool_or(a::BIGINT <> b::BIGINT AND least(length(a), length(b)) >= 2 AND (starts_with(a, b) OR ends_with(a, b) OR starts_with(b, a) OR ends_with(b, a))) AS trunc FROM y GROUP BY ALL)
SELECT s1_id, cand_id, coalesce(near, false)::INTEGER AS n_near, coalesce(trunc, false)::INTEGER AS n_trunc, len(list_filter(list_intersect(list_distinct(na), list_distinct(nb)), lambda x: length(x) >= 2))::INTEGER AS n_exact2,
coalesce(list_contains(nb, list_max(list_transform(na, lambda x: x::BIGINT))::VARCHAR), false)::INTEGER AS "n_bigA_in_B", coalesce(list_contains(na, list_max(list_transform(nb, lambda x: x::BIGINT))::VARCHAR), false)::INTEGER AS "n_bigB_in_A" FROM g LEFT JOIN z USING (s1_id, cand_id)""",
    "word_weights": f"WITH {PAIRS}, {WORDS} SELECT side, tok, round(llr, 6) AS llr FROM llr",
    "word_features": f"""WITH {PAIRS}, {WORDS}, agg AS (SELECT s1_id, cand_id, lw.side, min(llr) AS mn, max(llr) AS mx, sum(llr) AS sm, count(*) FILTER (llr IS NULL) AS unk FROM lw LEFT JOIN llr ON llr.side = lw.side AND llr.tok = lw.tok GROUP BY ALL),
e AS (SELECT * FROM agg WHERE side = 'extra'), m AS (SELECT * FROM agg WHERE side = 'miss')
SELECT wl.s1_id, wl.cand_id, round(coalesce(e.mn, 0), 6) AS llr_extra_min, round(coalesce(e.mx, 0), 6) AS llr_extra_max, round(coalesce(e.sm, 0), 6) AS llr_extra_sum, coalesce(e.unk, 0)::BIGINT AS llr_extra_unk, round(coalesce(m.mn, 0), 6) AS llr_miss_min, round(coalesce(m.sm, 0), 6) AS llr_miss_sum,
coalesce(m.unk, 0)::BIGINT AS llr_miss_unk, len(extra)::INTEGER AS n_extra, len(miss)::INTEGER AS n_miss FROM wl LEFT JOIN e ON e.s1_id = wl.s1_id AND e.cand_id = wl.cand_id LEFT JOIN m ON m.s1_id = wl.s1_id AND m.cand_id = wl.cand_id""",
    "sibling_numbers": f"""WITH {PAIRS}, f AS (SELECT p.*, addr_str, addr_num FROM pairs p JOIN rec ON entity_id = cand_id), g AS (SELECT a.s1_id, a.cand_id, count(*) AS n, max((len(list_filter(list_intersect(list_distinct(a.addr_num), list_distinct(b.addr_num)), lambda x: length(x) >= 2)) > 0)::INTEGER) AS num,
max((a.addr_str = b.addr_str AND length(a.addr_str) > 0)::INTEGER) AS exact FROM f a JOIN f b ON a.s1_id = b.s1_id AND a.cand_id <> b.cand_id AND b.p >= 0.5 GROUP BY ALL) SELECT s1_id, cand_id, coalesce(n, 0)::BIGINT AS sib_n, coalesce(num, -1)::INTEGER AS sib_num, coalesce(exact, -1)::INTEGER AS sib_addr_exact FROM pairs LEFT JOIN g USING (s1_id, cand_id)""",
    "context": f"""WITH {PAIRS}, t AS (SELECT *, max(p) OVER ({_w1}) AS top FROM pairs), u AS (SELECT *, max(CASE WHEN p < top THEN p END) OVER ({_w1}) AS below, row_number() OVER ({_w1} ORDER BY p DESC, cand_id) AS r1, row_number() OVER ({_w2} ORDER BY p DESC, s1_id) AS rc FROM t)
SELECT s1_id, cand_id, r1::INTEGER AS p_rank_s1, round(top - p, 6) AS p_gap_s1, round(coalesce(p - below, 0), 6) AS p_margin_s1, rc::INTEGER AS p_rank_c, round(max(p) OVER ({_w2}) - p, 6) AS p_gap_c, count(*) OVER ({_w2}) AS p_n_c, count(*) OVER ({_w1}) AS p_n_s1,
sum((p > 0.5)::INTEGER) OVER ({_w1})::BIGINT AS p_n_hi_s1, (r1 = 1 AND rc = 1)::INTEGER AS p_mutual_best FROM u""",
    "source_context": f"WITH {PAIRS} SELECT s1_id, cand_id, coalesce(max(p) FILTER (src = 2) OVER ({_w1}), 0) AS best_s2, coalesce(max(p) FILTER (src = 3) OVER ({_w1}), 0) AS best_s3, round(sum(p) OVER ({_w1}), 6) AS sum_s1, round(sum(p) OVER ({_w2}), 6) AS sum_c FROM pairs",
    "scaled_scores": f"WITH {PAIRS} SELECT s1_id, cand_id, round(bscore / max(bscore) OVER ({_w1}), 6) AS bscore_share, round(ln(1 + row_number() OVER ({_w1} ORDER BY bscore DESC, cand_id)), 6) AS bscore_log_rank FROM pairs",
    "one_owner": f"WITH {PAIRS} SELECT s1_id, cand_id, CASE WHEN p >= max(p) OVER ({_w2}) THEN p ELSE 0 END AS owned, CASE WHEN row_number() OVER ({_w2} ORDER BY p DESC, s1_id) = 1 THEN p ELSE 0 END AS owned_strict FROM pairs",
    "prune": f"WITH {PAIRS} SELECT s1_id, cand_id, p FROM pairs WHERE p >= 0.3 QUALIFY row_number() OVER ({_w1} ORDER BY p DESC, cand_id) <= 12",
    "threshold_decode": f"WITH {PAIRS} SELECT s1_id, array_to_string(list_sort(list(cand_id)), ',') AS ids FROM pairs WHERE p >= 0.7 GROUP BY 1",
    "threshold_search": f"""WITH {PAIRS}, taus AS (SELECT unnest({TAUS}) AS tau), e AS (SELECT entity_id AS s1_id, (SELECT count(*) FROM truth t WHERE t.s1_id = entity_id) AS true_ FROM ent WHERE src = 1),
l AS (SELECT tau, s1_id, count(*) AS named, count(truth.cand_id) AS tp FROM taus JOIN pairs ON p >= tau LEFT JOIN truth USING (s1_id, cand_id) GROUP BY ALL)
SELECT tau::DOUBLE AS tau, round(avg({f_score("coalesce(tp, 0)", "coalesce(named, 0)", "true_")}), 6) AS f05 FROM taus CROSS JOIN e LEFT JOIN l USING (tau, s1_id) GROUP BY 1""",
    "macro_f05": f"WITH {PAIRS}, links AS (SELECT s1_id, cand_id FROM pairs WHERE p >= 0.7), {COUNTS} {METRICS}",
    "oracle_f05": f"WITH {PAIRS}, links AS (SELECT s1_id, cand_id FROM pairs JOIN truth USING (s1_id, cand_id)), {COUNTS} {METRICS}",
    "sink_matches": f"WITH {PAIRS} SELECT entity_id AS source1_entity_id, coalesce(array_to_string(list(cand_id ORDER BY p DESC, cand_id) FILTER (cand_id IS NOT NULL), ','), '') AS matched_entity_ids FROM ent LEFT JOIN (SELECT * FROM pairs WHERE p >= 0.7) ON s1_id = entity_id WHERE ent.src = 1 GROUP BY 1",
    "sink_candidates": f"WITH {PAIRS} SELECT entity_id AS source1_entity_id, coalesce(array_to_string(list(cand_id ORDER BY cand_id) FILTER (cand_id IS NOT NULL), ','), '') AS candidate_entity_ids FROM ent LEFT JOIN pairs ON s1_id = entity_id WHERE ent.src = 1 GROUP BY 1",
    "truth_parsed": f"WITH {ENT}, {TRUTH} SELECT * FROM truth",
    "token_dictionary": f"WITH {NATIVE_TOK}, {LEARNED_TOKENS} SELECT native, latin FROM dict",
    "state_dictionary": f"WITH {NATIVE_TOK}, {NATIVE_ADR}, {LEARNED_STATES} SELECT native, code FROM sdict",
    "native_names": f"WITH {NATIVE_TOK}, {LEARNED_TOKENS}, {ROMANISED_TOK}, {NAM.replace('FROM tok)', 'FROM rtok)')} SELECT entity_id, name_str, core_str, concat, is_domain FROM nam",
    "native_addresses": f"""WITH {NATIVE_TOK}, {NATIVE_ADR}, {LEARNED_STATES},
p1 AS (SELECT entity_id, unnest(parts) AS part, unnest(codes) AS code, unnest(range(1, len(parts) + 1)) AS i FROM adr1),
p2 AS (SELECT entity_id, list(part ORDER BY i) AS parts, list(coalesce(p1.code, sdict.code) ORDER BY i) AS codes FROM p1 LEFT JOIN sdict ON part = native GROUP BY 1),
adr1n AS (SELECT adr1.* EXCLUDE (parts, codes), p2.parts, p2.codes FROM adr1 JOIN p2 USING (entity_id)),
{ADR_REST.replace("FROM adr1)", "FROM adr1n)").replace(_apart, f"list_filter(list_transform({_apart}, lambda t: CASE WHEN regexp_matches(t, '{NATIVE}') THEN {romanised('t')} ELSE t END), lambda t: t <> '')")}
SELECT entity_id, state, {joined('addr_tok')} AS addr_tok, {joined('addr_num')} AS addr_num, addr_str, addr_missing FROM rec""",
    "reranked_fixed": f"""WITH {BLOCK}, f AS ({both("rec", "addr_num", "addr_str", pairs="(" + top("scored", 120) + ")")}),
g AS (SELECT *, len(list_intersect(addr_num_a, addr_num_b)) AS ni, bscore / max(bscore) OVER (PARTITION BY s1_id) AS bs, ln(1 + row_number() OVER (PARTITION BY s1_id ORDER BY bscore DESC, cand_id)) AS br FROM f),
h AS (SELECT s1_id, cand_id, bs, br, (addr_str_b = '')::DOUBLE AS am, (len(addr_num_a) > 0 AND len(addr_num_b) > 0 AND ni = 0)::DOUBLE AS nc, (ni > 0)::DOUBLE AS nm FROM g),
r AS (SELECT *, round(-1.0::DOUBLE + bs * 2.0::DOUBLE + br * (-0.5)::DOUBLE + am * 0.25::DOUBLE + nc * (-0.75)::DOUBLE + nm * 0.5::DOUBLE, 6) AS rscore FROM h)
SELECT s1_id, cand_id, round(bs, 6) AS r_bs, round(br, 6) AS r_brank, am AS r_addr_missing, nc AS r_num_conflict, nm AS r_num_match, rscore, (row_number() OVER (PARTITION BY s1_id ORDER BY rscore DESC, cand_id) - 1)::INTEGER AS brank FROM r
QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY rscore DESC, cand_id) <= 25""",
    "expected_f_decode": f"""WITH {PAIRS}, r AS (SELECT s1_id, cand_id, p, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, cand_id) AS r FROM pairs QUALIFY r <= 12),
l AS (SELECT s1_id, list(p ORDER BY r) AS ps FROM r GROUP BY 1), u AS (SELECT DISTINCT ps, len(ps) AS n FROM l),
m AS (SELECT ps, n, mask, bit_count(mask) AS t, list_product(list_transform(ps, lambda p, i: CASE WHEN (mask >> (i - 1)::BIGINT) & 1 = 1 THEN p ELSE 1 - p END)) AS w FROM u, unnest(range(0, (1::BIGINT << n::BIGINT))) AS x(mask)),
e AS (SELECT ps, k, round(fsum(w * CASE WHEN k = 0 THEN (t = 0)::INTEGER WHEN t = 0 THEN 0 ELSE 1.25 * bit_count(mask & ((1::BIGINT << k::BIGINT) - 1)) / (0.25 * t + k) END), 12) AS f FROM m, unnest(range(0, n + 1)) AS y(k) GROUP BY ALL),
b AS (SELECT ps, k FROM e QUALIFY row_number() OVER (PARTITION BY ps ORDER BY f DESC, k) = 1)
SELECT s1_id, cand_id FROM r JOIN l USING (s1_id) JOIN b USING (ps) WHERE r <= k""",
    "romanised_tokens": f"""WITH {ENT}, t AS (SELECT DISTINCT unnest(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')) AS token FROM ent)
SELECT token, translate(token, '{LATIN}', '{LETTERS}') AS native, {romanised(f"translate(token, '{LATIN}', '{LETTERS}')")} AS latin, CASE WHEN regexp_matches(token, '[{LATIN}]') THEN 0 END AS script FROM t WHERE token <> ''""",
}
