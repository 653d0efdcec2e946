"""Oracle SQL for the registered queries, for DuckDB over the same driver tables.

Written from the rules themselves, with other means where there are any: octets
as numbers, word stems replaced before the name test, staged samples.
"""

from __future__ import annotations

from .. import rules
from . import planted

SURVEY = planted.duck_text(planted.SURVEY)
STOPS = planted.duck_text(planted.STOPS)
LAND = planted.LAND

# column name -> kind, in table order
SURVEY_COLS = {
    "respondent_id": "int", "full_name": "str", "email": "str", "prolific_pid": "str", "panel_code": "str",
    "ip_addr": "str", "phone": "int", "age": "int", "likert": "int", "consent_flag": "bool",
    "q_a": "dbl", "q_b": "dbl", "zscore": "dbl", "score": "dbl", "segment": "str", "seg3": "str",
    "note": "str", "empty_col": "str",
}
STOPS_COLS = {"stop_id": "int", "gps_y": "dbl", "gps_x": "dbl", "detour": "dbl", "priority": "str"}
TABLE_COLS = {
    "region": {"r_regionkey": "int", "r_name": "str"},
    "nation": {"n_nationkey": "int", "n_name": "str", "n_regionkey": "int"},
    "customer": {"c_custkey": "int", "c_name": "str", "c_nationkey": "int", "c_acctbal": "dbl", "c_mktsegment": "str"},
    "supplier": {"s_suppkey": "int", "s_name": "str", "s_nationkey": "int", "s_acctbal": "dbl"},
    "part": {"p_partkey": "int", "p_name": "str", "p_brand": "str", "p_type": "str", "p_size": "int",
             "p_retailprice": "dbl"},
    "orders": {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "str", "o_totalprice": "dbl",
               "o_orderdate": "ts", "o_orderpriority": "str"},
    "lineitem": {"l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int",
                 "l_quantity": "dbl", "l_extendedprice": "dbl", "l_discount": "dbl", "l_tax": "dbl",
                 "l_returnflag": "str", "l_linestatus": "str", "l_shipdate": "ts"},
    "events": {"event_id": "int", "ts": "ts", "user_id": "int", "event_type": "str", "value": "dbl", "props": "str"},
    "documents": {"doc_id": "int", "text": "str", "lang": "str", "source": "str", "n_chars": "int"},
    "embeddings": {"vec_id": "int", "embedding": "other", "label": "int"},
    "pages": {"page_id": "int", "url": "str", "html": "str"},
    "benchmark": {"item_id": "int", "text": "str"},
    "labels": {"doc_id": "int", "quality": "int", "toxic": "int"},
    "conversations": {"conv_id": "int", "turn": "int", "role": "str", "text": "str"},
}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hit(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(by)}, 'g')"


def trim(x: str) -> str:
    return sub(x, rf"^[{rules.WS}]+|[{rules.WS}]+$", "")


def as_text(x: str, kind: str) -> str:
    return f"cast({x} AS varchar)" if kind != "str" else x


# --- profiles and the cascade -------------------------------------------------

def profile(rel: str, cols: dict[str, str], idx_from: int = 0) -> str:
    parts = []
    for i, (c, kind) in enumerate(cols.items(), start=idx_from):
        num, string = kind in ("int", "dbl"), kind == "str"
        frac = {"int": f"CASE WHEN count({c}) > 0 THEN false ELSE false END",
                "dbl": f"coalesce(bool_or({c} % 1 <> 0), false)"}.get(kind, "cast(NULL AS boolean)")
        parts.append(f"""
SELECT {i} AS col_idx, '{c}' AS col_name, '{kind}' AS kind, count(*) AS n_rows, count({c}) AS n_nonnull,
  {f'cast(max(abs({c})) AS double)' if num else 'cast(NULL AS double)'} AS max_abs,
  {f'cast(max(abs({c})) AS varchar)' if num else 'cast(NULL AS varchar)'} AS max_text, {frac} AS has_frac,
  {f'cast(max(length({c})) AS int)' if string else 'cast(NULL AS int)'} AS max_len,
  count(DISTINCT {c}) AS n_unique,
  (SELECT min(k) FROM (SELECT count(*) AS k FROM {rel} WHERE {c} IS NOT NULL GROUP BY {c})) AS min_count
FROM {rel}""")
    return "\nUNION ALL".join(parts)


PROFILE_OUT = "col_idx, col_name, n_rows, n_nonnull, max_abs, has_frac, max_len, n_unique, min_count"


def forced(text: str) -> str:
    stems = "|".join(rules.AGE_NOT_AFTER)
    no_stems = f"regexp_replace(lower({text}), '({stems})age', '#', 'g')"
    return f"(contains({no_stems}, 'age') OR regexp_matches(lower({text}), '{'|'.join(rules.FORCED_NAME_PARTS)}'))"


def platform(text: str) -> str:
    t = f"lower({trim(text)})"
    return (f"({t} = 'workerid' OR contains({t}, 'prolific')"
            f" OR (contains({t}, 'mturk') AND NOT contains({t}, 'mturkcode')))")


def cascade_code(gps: str = "false") -> str:
    both = "concat(col_name, ' ', col_name)"
    return f"""CASE WHEN {gps} THEN 'gps' WHEN n_nonnull = 0 THEN 'empty'
  WHEN {forced(both)} THEN 'forced_name' WHEN {platform('col_name')} THEN 'platform_name'
  WHEN kind = 'bool' THEN 'boolean' WHEN kind = 'ts' THEN 'datetime'
  WHEN kind IN ('int', 'dbl') AND max_abs < 1000 THEN 'small_number'
  WHEN kind IN ('int', 'dbl') AND has_frac THEN 'large_fraction'
  WHEN kind IN ('int', 'dbl') THEN 'large_integer'
  WHEN kind = 'str' AND max_len < 4 THEN 'short_text'
  WHEN kind = 'str' AND n_unique <= 20 AND min_count >= 10 AND n_unique / n_nonnull < 0.1 THEN 'categorical'
  WHEN kind = 'str' THEN 'text' ELSE 'unknown_type' END"""


SENT = "('forced_name','platform_name','datetime','large_integer','text','unknown_type','gps')"
REASON = """CASE reason_code WHEN 'empty' THEN 'no values at all'
  WHEN 'forced_name' THEN 'name or label is on the always-check list'
  WHEN 'platform_name' THEN 'name or label announces a platform participant ID'
  WHEN 'boolean' THEN 'boolean column' WHEN 'datetime' THEN 'date or time column'
  WHEN 'small_number' THEN concat('small numbers (largest ', max_text, ')')
  WHEN 'large_fraction' THEN concat('large numbers with fractions (largest ', max_text, ')')
  WHEN 'large_integer' THEN concat('large whole numbers, maybe IDs or phones (largest ', max_text, ')')
  WHEN 'short_text' THEN concat('short text (longest ', max_len, ')')
  WHEN 'categorical' THEN concat('categories (', n_unique, ' values, rarest seen ', min_count, ' times)')
  WHEN 'text' THEN concat('text (longest ', max_len, ')') END"""


# --- coordinates ---------------------------------------------------------------

def gps_ok(x: str) -> str:
    s = f"(CASE WHEN {x} NOT IN {rules.GPS_SENTINELS} THEN {x} END)"
    return f"coalesce(max(abs({s})) <= 180 AND bool_or({s} <> round({s}, 2)), false)"


def precheck(rel: str, cols: dict[str, str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT {i} AS col_idx, '{c}' AS col_name, {gps_ok(f'cast({c} AS double)') if k == 'dbl' else 'bool_and(false)'} AS gps_precheck FROM {rel}"
        for i, (c, k) in enumerate(cols.items()) if k in ("int", "dbl"))


def pair_ctes(rel: str, cols: dict[str, str], key: str) -> str:
    """CTEs ending in comp (pair completeness) and shares (per orientation) of pre-checked pairs."""
    names = list(cols)
    doubles = [i for i, c in enumerate(names) if cols[c] == "dbl"]
    pairs = [(i, j) for i in doubles for j in doubles if 0 < j - i <= 2]
    vals = "\nUNION ALL ".join(f"""SELECT {i} AS a_idx, {j} AS b_idx, k,
  CASE WHEN NOT coalesce(a = 0 AND b = 0, false) THEN a END AS a,
  CASE WHEN NOT coalesce(a = 0 AND b = 0, false) THEN b END AS b
FROM (SELECT md5(cast({key} AS varchar)) AS k,
  CASE WHEN {names[i]} NOT IN {rules.GPS_SENTINELS} THEN {names[i]} END AS a,
  CASE WHEN {names[j]} NOT IN {rules.GPS_SENTINELS} THEN {names[j]} END AS b FROM {rel})""" for i, j in pairs)
    return f"""
pre AS ({precheck(rel, cols)}),
vals AS ({vals}),
comp AS (SELECT a_idx, b_idx, count(*) FILTER (a IS NOT NULL OR b IS NOT NULL) AS n_either,
  count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_both
  FROM vals WHERE a_idx IN (SELECT col_idx FROM pre WHERE gps_precheck)
    AND b_idx IN (SELECT col_idx FROM pre WHERE gps_precheck) GROUP BY ALL
  HAVING n_both > 0 AND (n_either - n_both) / n_either <= 0.1),
samp AS (SELECT v.*, row_number() OVER (PARTITION BY a_idx, b_idx ORDER BY k, a, b) AS pt
  FROM vals v SEMI JOIN comp USING (a_idx, b_idx) WHERE a IS NOT NULL AND b IS NOT NULL QUALIFY pt <= 2000),
ways AS (SELECT a_idx, b_idx, pt, true AS a_is_lat, a AS lat, b AS lon FROM samp
  UNION ALL SELECT a_idx, b_idx, pt, false, b, a FROM samp),
land AS ({LAND}),
steps AS (SELECT unnest([-0.01::double, 0::double, 0.01::double]) AS d),
judged AS (SELECT w.a_idx, w.b_idx, w.pt, w.a_is_lat, any_value(w.lat) AS lat,
    bool_or(l.lat_idx IS NOT NULL) AND any_value(w.lat) >= -60 AS on_land
  FROM ways w, steps y, steps x LEFT JOIN land l ON l.lat_idx = least(floor(least(greatest(w.lat + y.d, -90), 90) + 90), 179)
    AND least(floor(least(greatest(w.lon + x.d, -180), 180) + 180), 359) BETWEEN l.lon_start AND l.lon_end
  GROUP BY ALL),
shares AS (SELECT a_idx, b_idx, a_is_lat, count(*) FILTER (on_land) / count(*) AS share, count(*) AS n
  FROM judged GROUP BY ALL HAVING max(abs(lat)) <= 90)"""


def candidate_ctes(cols: dict[str, str]) -> str:
    named = ", ".join(f"({i}, '{c}')" for i, c in enumerate(cols))
    return f""",
good AS (SELECT a_idx, b_idx, max_by(a_is_lat, (share, a_is_lat)) AS a_is_lat, max(share) AS share, any_value(n) AS n
  FROM shares GROUP BY ALL HAVING max(share) >= 0.9),
sides AS (SELECT a_idx AS i, b_idx AS j, a_is_lat AS is_lat, share, n FROM good
  UNION ALL SELECT b_idx, a_idx, NOT a_is_lat, share, n FROM good),
colnames(idx, cname) AS (VALUES {named}),
gps AS (SELECT i, c.cname AS col_name, CASE WHEN is_lat THEN 'latitude' ELSE 'longitude' END AS role, share, n,
    concat('read as ', CASE WHEN is_lat THEN 'latitude' ELSE 'longitude' END, ' next to ', p.cname, ', ',
      cast(round_even(100 * share, 0) AS int), '% of ', n, ' sampled positions lie on land') AS reason
  FROM sides JOIN colnames c ON c.idx = i JOIN colnames p ON p.idx = j
  QUALIFY row_number() OVER (PARTITION BY i ORDER BY share DESC, j) = 1)"""


def pair_query(rel_name: str, rel: str, cols: dict[str, str], key: str) -> str:
    return (f"WITH {rel_name} AS ({rel}), {pair_ctes(rel_name, cols, key)} "
            "SELECT a_idx, b_idx, n_either, n_both, a_is_lat, share, n FROM shares JOIN comp USING (a_idx, b_idx)")


def gps_query(rel_name: str, rel: str, cols: dict[str, str], key: str) -> str:
    return (f"SELECT '{rel_name}' AS table_name, col_name, role, share, n, reason FROM (WITH {rel_name} AS ({rel}), "
            f"{pair_ctes(rel_name, cols, key)} {candidate_ctes(cols)} SELECT * FROM gps)")


# --- patterns ----------------------------------------------------------------------

EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[a-zA-Z]{2,}"
LONG_DIGIT = rf"(^|[^\p{{L}}\p{{N}}_.])([-{rules.WS}]*\p{{Nd}}){{9}}[-\p{{Nd}}{rules.WS}]*($|[^\p{{L}}\p{{N}}_.])"


def email(x: str) -> str:
    return hit(x, EMAIL)


def web(x: str) -> str:
    return hit(x, rf"(?i)(https?://|www\.)[^{rules.WS}]")


def long_digit(x: str) -> str:
    return hit(x, LONG_DIGIT)


def prolific(x: str) -> str:
    return hit(trim(x), "^[0-9a-fA-F]{24}$")


def mturk(x: str) -> str:
    return hit(trim(x), "^[Aa][A-Za-z0-9]{9,20}$")


def ip_class(x: str) -> str:
    t = trim(x)
    shape = r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$"
    a, b, c, d = (f"cast(nullif(regexp_extract({t}, {lit(shape)}, {i}), '') AS int)" for i in (1, 2, 3, 4))
    return f"""CASE WHEN NOT coalesce({hit(t, shape)}, false) THEN 0
  WHEN greatest({a}, {b}, {c}, {d}) > 255 THEN 1
  WHEN ({a} + {b} + {c} + {d} = 0) OR {a} IN (10, 127) OR ({a} = 172 AND {b} BETWEEN 16 AND 31)
    OR ({a} = 192 AND {b} = 168) OR ({a} = 169 AND {b} = 254) OR ({a} = 100 AND {b} BETWEEN 64 AND 127) THEN 2
  ELSE 3 END"""


def stats(rel: str, cols: dict[str, str], table: str = "") -> str:
    return "\nUNION ALL ".join(f"""SELECT '{table}' AS table_name, {i} AS col_idx, '{c}' AS col_name, count({c}) AS n_nonnull,
  count(*) FILTER ({prolific(c)}) AS prolific_n, count(*) FILTER ({mturk(c)}) AS mturk_n,
  count(*) FILTER (({ip_class(c)}) >= 1) AS ip_loose_n, count(*) FILTER (({ip_class(c)}) >= 2) AS ip_strict_n,
  count(*) FILTER (({ip_class(c)}) >= 3) AS ip_public_n FROM {rel}"""
                               for i, (c, k) in enumerate(cols.items()) if k == "str")


FLOORS = f"""
h AS (SELECT *, {platform('col_name')} AS named,
  CASE WHEN n_nonnull < 30 THEN prolific_n > 3 ELSE prolific_n / n_nonnull > 0.1 END AS pv,
  CASE WHEN n_nonnull < 30 THEN mturk_n > 3 ELSE mturk_n / n_nonnull > 0.1 END AS mv,
  ip_loose_n >= 1 AND ip_strict_n / ip_loose_n >= 0.5 AND ip_public_n >= 1 AS ip FROM st),
g AS (SELECT *, CASE WHEN (pv OR (named AND prolific_n >= 1)) AND prolific_n >= mturk_n THEN 'prolific'
  WHEN pv OR mv OR (named AND prolific_n + mturk_n >= 1) THEN 'mturk' END AS pf FROM h),
f AS (SELECT *, pf IS NOT NULL OR ip AS floor_met, coalesce(pf, CASE WHEN ip THEN 'ip' END) AS pii_type,
  CASE WHEN pf = 'prolific' THEN prolific_n ELSE mturk_n END AS m,
  CASE WHEN pf = 'prolific' THEN 'Prolific' ELSE 'MTurk' END AS brand FROM g),
floors AS (SELECT *, concat_ws(' ',
  CASE WHEN pf IS NOT NULL AND named AND m >= 1 THEN concat('[Pattern: platform-ID name, ',
      cast(round_even(100 * (m / n_nonnull), 0) AS int), '% (', m, '/', n_nonnull, ') of values have the ', brand, ' ID form]')
    WHEN pf IS NOT NULL THEN concat('[Pattern: ', cast(round_even(100 * (m / n_nonnull), 0) AS int), '% (', m, '/',
      n_nonnull, ') of values have the ', brand, ' ID form, name says nothing]') END,
  CASE WHEN ip THEN concat('[Pattern: ', cast(round_even(100 * (ip_strict_n / ip_loose_n), 0) AS int), '% (', ip_strict_n,
    '/', ip_loose_n, ') valid IP addresses, ', ip_public_n, ' public]') END) AS note FROM f)"""


def floors_query(out: str, only: tuple[str, ...] | None = None) -> str:
    cols = {c: k for c, k in SURVEY_COLS.items() if only is None or c in only}
    return f"WITH survey AS ({SURVEY}), st AS ({stats('survey', cols)}), {FLOORS} SELECT {out} FROM floors"


# --- value samples --------------------------------------------------------------------

def samples(rel: str, column: str) -> str:
    v = sub(column, rules.CONTROL_CHARS, "")
    return f"""
WITH c AS (SELECT value, cnt, md5(value) AS digest, length(value) AS len, {email('value')} AS email, {web('value')} AS web,
    {long_digit('value')} AS long_digit
  FROM (SELECT {v} AS value, count(*) AS cnt FROM {rel} WHERE {column} IS NOT NULL GROUP BY 1)),
n AS (SELECT (SELECT count(*) FROM c) AS n_unique, (SELECT count(*) FROM {rel}) AS n_rows),
p1 AS (SELECT *, row_number() OVER (ORDER BY cnt, digest) AS o FROM c WHERE email QUALIFY o <= 5),
p2 AS (SELECT *, row_number() OVER (ORDER BY cnt, digest) AS o FROM c WHERE web
  AND digest NOT IN (SELECT digest FROM p1) QUALIFY o <= 5),
p3 AS (SELECT *, row_number() OVER (ORDER BY cnt, digest) AS o FROM c WHERE long_digit
  AND digest NOT IN (SELECT digest FROM p1 UNION ALL SELECT digest FROM p2) QUALIFY o <= 5),
other AS (SELECT *, row_number() OVER (ORDER BY s, o) AS rank FROM (
  SELECT 1 AS s, * FROM p1 UNION ALL SELECT 2, * FROM p2 UNION ALL SELECT 3, * FROM p3)),
longest AS (SELECT *, row_number() OVER (ORDER BY len DESC, cnt DESC, digest) AS rank FROM c
  WHERE digest NOT IN (SELECT digest FROM other) QUALIFY rank <= 10),
rare AS (SELECT *, row_number() OVER (ORDER BY cnt, digest) AS o FROM c
  WHERE digest NOT IN (SELECT digest FROM other UNION ALL SELECT digest FROM longest) QUALIFY o <= 20),
rnd AS (SELECT *, row_number() OVER (ORDER BY md5(concat('0|', digest))) AS rank FROM c WHERE digest NOT IN (
  SELECT digest FROM other UNION ALL SELECT digest FROM longest UNION ALL SELECT digest FROM rare) QUALIFY rank <= 20),
shown AS (
  SELECT 'all' AS grp, row_number() OVER (ORDER BY cnt DESC, digest) AS rank, value, cnt FROM c, n WHERE n_unique <= 50
  UNION ALL SELECT 'longest', rank, value, cnt FROM longest, n WHERE n_unique > 50
  UNION ALL SELECT 'rarest', row_number() OVER (ORDER BY cnt DESC, digest), value, cnt FROM rare, n WHERE n_unique > 50
  UNION ALL SELECT 'random', rank, value, cnt FROM rnd, n WHERE n_unique > 50
  UNION ALL SELECT 'other', rank, value, cnt FROM other, n WHERE n_unique > 50)
SELECT grp, cast(rank AS int) AS rank, value, cnt, cnt / n_rows * 100 AS pct, n_unique FROM shown, n"""


def rendered(rel: str, column: str) -> str:
    """The sample of one column as a text cell."""
    return f"""SELECT '{column}' AS col_name, concat(string_agg(block, chr(10) || chr(10) ORDER BY o),
  CASE WHEN max(n_unique) > 50 THEN concat(chr(10), chr(10), '  (chosen from ', max(n_unique), ' different values)')
  ELSE '' END) AS tabulation
FROM (SELECT list_position(['all', 'longest', 'rarest', 'random', 'other'], grp) AS o, max(n_unique) AS n_unique,
    concat(['[All values]', '[Longest values]', '[Least frequent values]', '[Random sample]', '[Other values]'][
      list_position(['all', 'longest', 'rarest', 'random', 'other'], grp)], chr(10), string_agg(concat('  ',
      CASE WHEN length(value) < 50 THEN rpad(value, 50, ' ') ELSE value END, ' ',
      CASE WHEN length(cast(cnt AS varchar)) < 6 THEN lpad(cast(cnt AS varchar), 6, ' ') ELSE cast(cnt AS varchar) END,
      ' (', printf('%.1f', pct), '%)'), chr(10) ORDER BY rank)) AS block
  FROM ({samples(rel, column)}) GROUP BY grp)"""


def reserve(column: str) -> str:
    return f"""SELECT '{column}' AS col_name, pattern, value, cnt FROM (
WITH c AS (SELECT value, cnt, md5(value) AS digest, {email('value')} AS email, {web('value')} AS web,
    {long_digit('value')} AS long_digit
  FROM (SELECT {sub(column, rules.CONTROL_CHARS, '')} AS value, count(*) AS cnt FROM survey WHERE {column} IS NOT NULL GROUP BY 1)),
p1 AS (SELECT * FROM c WHERE email ORDER BY cnt, digest LIMIT 5),
p2 AS (SELECT * FROM c WHERE web AND digest NOT IN (SELECT digest FROM p1) ORDER BY cnt, digest LIMIT 5),
p3 AS (SELECT * FROM c WHERE long_digit AND digest NOT IN (SELECT digest FROM p1 UNION ALL SELECT digest FROM p2)
  ORDER BY cnt, digest LIMIT 5)
SELECT 'email' AS pattern, * FROM p1 UNION ALL SELECT 'web', * FROM p2 UNION ALL SELECT 'long_digit', * FROM p3)"""


def melted(rel: str, cols: dict[str, str], counted: bool) -> str:
    parts = []
    for i, (c, k) in enumerate(cols.items()):
        v = as_text(c, k)
        parts.append(f"SELECT {v} AS value, count(*) AS cnt, {i} AS col_idx, '{c}' AS col_name FROM {rel} WHERE {c} IS NOT NULL GROUP BY ALL"
                     if counted else f"SELECT {v} AS value, {i} AS col_idx, '{c}' AS col_name FROM {rel}")
    return "\nUNION ALL ".join(parts)


# --- duplicates, results, answers, ledger -----------------------------------------------

DOC_FILES = """files AS (SELECT source AS dataset_id, cast(doc_id AS varchar) AS path, sha256(text) AS digest,
  n_chars > 200 AS loaded, doc_id, min(cast(doc_id AS varchar)) OVER (PARTITION BY source, sha256(text)) AS primary_path FROM documents)"""
DOC_RESULTS = """prim AS (SELECT dataset_id, path AS file, unnest(['text', 'lang']) AS col_name,
  ['direct_pii', 'possible_indirect', 'internal_id', 'not_pii', 'error'][doc_id % 5 + 1] AS evaluation, '' AS duplicate_of
  FROM files WHERE loaded AND path = primary_path),
results AS (SELECT * FROM prim UNION ALL
  SELECT p.dataset_id, f.path, p.col_name, p.evaluation, p.file FROM files f JOIN prim p ON p.file = f.primary_path AND p.dataset_id = f.dataset_id
  WHERE f.path <> f.primary_path)"""
COUNTS = """rc AS (SELECT dataset_id, count(*) FILTER (duplicate_of = '') AS n_columns_checked,
  count(*) FILTER (evaluation = 'direct_pii') AS n_direct_pii, count(*) FILTER (evaluation = 'possible_indirect') AS n_indirect,
  count(*) FILTER (evaluation = 'internal_id') AS n_internal_id FROM results GROUP BY 1),
fc AS (SELECT dataset_id, count(*) AS n_files_total, count(*) FILTER (path = primary_path AND loaded) AS n_data_files,
  count(*) FILTER (path <> primary_path) AS n_duplicates,
  count(*) FILTER (path = primary_path AND NOT loaded) AS n_files_not_loaded FROM files GROUP BY 1),
run AS (SELECT dataset_id, n_files_total, n_data_files, n_duplicates, n_files_not_loaded,
  coalesce(n_columns_checked, 0) AS n_columns_checked, coalesce(n_direct_pii, 0) AS n_direct_pii,
  coalesce(n_indirect, 0) AS n_indirect, coalesce(n_internal_id, 0) AS n_internal_id FROM fc LEFT JOIN rc USING (dataset_id))"""
DOCS = f"WITH {DOC_FILES}, {DOC_RESULTS}, {COUNTS} "


def verdict_case(gps: str, value: str, floor: str) -> str:
    word = f"regexp_extract(lower({trim(value)}), '^[a-z]*')"
    return (f"CASE WHEN {gps} THEN CASE WHEN {word} = 'no' THEN 'not_pii' ELSE 'direct_pii' END"
            f" WHEN {floor} THEN 'direct_pii' WHEN {value} IS NULL THEN 'error' ELSE {value} END")


def _oracle() -> dict[str, str]:
    o: dict[str, str] = {}
    with_survey = f"WITH survey AS ({SURVEY})"
    o["column_profile"] = f"{with_survey} SELECT {PROFILE_OUT} FROM ({profile('survey', SURVEY_COLS)})"
    o["column_profile_lineitem"] = f"SELECT {PROFILE_OUT} FROM ({profile('lineitem', TABLE_COLS['lineitem'])})"
    out = PROFILE_OUT.replace(", n_unique, min_count", "")
    o["arriving_profile"] = f"SELECT {out} FROM ({profile('orders', TABLE_COLS['orders'])})"
    screened = f"""{with_survey}, prof AS ({profile('survey', SURVEY_COLS)}),
{pair_ctes('survey', SURVEY_COLS, 'respondent_id')} {candidate_ctes(SURVEY_COLS)},
coded AS (SELECT prof.*, gps.reason AS gps_reason, {cascade_code('gps.reason IS NOT NULL').replace('col_name', 'prof.col_name')} AS reason_code
  FROM prof LEFT JOIN gps ON gps.i = prof.col_idx)"""
    o["candidate_columns"] = (f"{screened} SELECT col_idx, col_name, reason_code, coalesce(gps_reason, {REASON}) AS reason, "
                              f"reason_code IN {SENT} AS is_candidate FROM coded")
    o["candidate_columns_catalog"] = "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, col_idx, col_name, {cascade_code()} AS reason_code, "
        f"({cascade_code()}) IN {SENT} AS is_candidate FROM ({profile(t, cols)})" for t, cols in TABLE_COLS.items())
    o["name_predicates"] = f"""
WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS word FROM documents),
l AS (SELECT word, CASE length(word) % 5 WHEN 0 THEN concat(' MTurk', word) WHEN 1 THEN concat('mturkcode', word)
  WHEN 2 THEN ' WorkerID ' ELSE '' END AS label FROM w WHERE length(word) > 0)
SELECT word, {forced("concat(word, ' ', label)")} AS forced, {platform('word')} OR {platform('label')} AS platform FROM l"""
    o["melted_cells"] = melted("part", TABLE_COLS["part"], False)
    o["value_counts_segment"] = (f"{with_survey} SELECT {sub('segment', rules.CONTROL_CHARS, '')} AS value, count(*) AS cnt "
                                 "FROM survey WHERE segment IS NOT NULL GROUP BY 1")
    o["value_counts_orders"] = melted("orders", TABLE_COLS["orders"], True)
    o["tabulation_all"] = samples("orders", "o_orderpriority")
    o["tabulation_sampled"] = samples(f"({SURVEY})", "note")
    o["tabulation_names"] = samples("customer", "c_name")
    o["tabulation_documents"] = samples("documents", "text")
    o["arriving_samples"], o["arriving_samples_documents"] = o["tabulation_names"], o["tabulation_documents"]
    o["tabulation_pages"] = samples("pages", "html")
    o["tabulation_conversations"] = samples("conversations", "text")
    o["pattern_reserve"] = f"{with_survey} {reserve('note')} UNION ALL {reserve('email')}"
    part_text = "(SELECT cast(p_partkey AS varchar) AS p_partkey, p_name, p_brand, p_type FROM part)"
    o["rendered_samples"] = " UNION ALL ".join(
        f"SELECT col_name, tabulation FROM ({rendered(part_text, c)}) WHERE col_name IN "
        f"(SELECT col_name FROM ({profile('part', TABLE_COLS['part'])}) WHERE ({cascade_code()}) IN {SENT})"
        for c in ("p_partkey", "p_name", "p_brand", "p_type"))
    o["text_identifier_rates"] = "\nUNION ALL ".join(
        f"SELECT '{t}.{c}' AS source, count(*) AS n, count(*) FILTER ({email(c)}) AS n_email, "
        f"count(*) FILTER ({web(c)}) AS n_web, count(*) FILTER ({long_digit(c)}) AS n_long_digit FROM {t}"
        for t, c in (("documents", "text"), ("pages", "url"), ("pages", "html"), ("conversations", "text")))
    o["token_identifiers"] = f"""
WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \\n]+')) AS word FROM documents)
SELECT word, {email('word')} AS email, {web('word')} AS web, {long_digit('word')} AS long_digit,
  {prolific('word')} AS prolific, {mturk('word')} AS mturk, {ip_class('word')} AS ip_class FROM w WHERE length(word) > 0"""
    o["platform_id_floor"] = floors_query("col_name, n_nonnull, prolific_n, mturk_n, floor_met, pii_type, note",
                                          ("prolific_pid", "panel_code"))
    o["ip_floor"] = floors_query("col_name, ip_loose_n, ip_strict_n, ip_public_n, floor_met, pii_type, note", ("ip_addr",))
    o["pattern_floors"] = floors_query("col_name, floor_met, pii_type, note")
    stat_cols = "col_name, n_nonnull, prolific_n, mturk_n, ip_loose_n, ip_strict_n, ip_public_n"
    o["pattern_stats_catalog"] = "\nUNION ALL ".join(
        f"SELECT table_name, {stat_cols} FROM ({stats(t, cols, t)})"
        for t, cols in TABLE_COLS.items() if "str" in cols.values())
    o["pattern_stats_counts"] = (f"{with_survey} SELECT {stat_cols} FROM ({stats('survey', SURVEY_COLS)}) WHERE n_nonnull > 0")
    o["gps_precheck"] = (f"{with_survey}, stops AS ({STOPS}) SELECT 'survey' AS table_name, * FROM ({precheck('survey', SURVEY_COLS)}) "
                         f"UNION ALL SELECT 'stops', * FROM ({precheck('stops', STOPS_COLS)})")
    o["gps_pairs"] = pair_query("survey", SURVEY, SURVEY_COLS, "respondent_id")
    o["gps_pairs_sampled"] = o["arriving_coordinates"] = pair_query("stops", STOPS, STOPS_COLS, "stop_id")
    o["gps_edges"] = pair_query("edges", planted.duck_text(planted.EDGES), {"edge_id": "int", "pos_y": "dbl", "pos_x": "dbl"}, "edge_id")
    o["gps_candidates"] = (gps_query("survey", SURVEY, SURVEY_COLS, "respondent_id") + " UNION ALL "
                           + gps_query("stops", STOPS, STOPS_COLS, "stop_id"))
    o["exact_duplicates"] = DOCS + "SELECT path, digest, primary_path FROM files"
    o["duplicate_groups"] = DOCS + "SELECT digest, min(path) AS primary_path, count(*) AS n_files FROM files GROUP BY 1"
    o["duplicate_results"] = DOCS + "SELECT * FROM results"
    o["saved_results"] = DOCS + """SELECT dataset_id, count(*) AS n FROM results WHERE dataset_id <> 'src1' GROUP BY 1
UNION ALL SELECT DISTINCT dataset_id, 0 FROM files WHERE dataset_id = 'src1'
UNION ALL SELECT dataset_id, 0 FROM files f WHERE dataset_id <> 'src1' AND dataset_id NOT IN (SELECT dataset_id FROM results) GROUP BY 1"""
    o["saved_results_interrupted"] = o["saved_results"]
    o["result_counts"] = DOCS + "SELECT * FROM rc"
    o["file_counts"] = DOCS + "SELECT * FROM fc"
    shown = [(k, lab) for k, lab in rules.OVERVIEW_LABELS if k not in ("n_warnings", "n_errors")]
    cells = {"package_name": "dataset_id", "model": "'rules'", "ended": lit(rules.UNFINISHED)}
    order = {k: i for i, (k, _) in enumerate(rules.OVERVIEW_LABELS, start=1)}
    o["overview_rows"] = DOCS + " UNION ALL ".join(
        f"SELECT dataset_id, {order[k]} AS ord, {lit(lab)} AS metric, cast({cells.get(k, k)} AS varchar) AS value FROM run"
        for k, lab in shown)
    o["metadata_rows"] = DOCS + " UNION ALL ".join(
        f"SELECT dataset_id, '{k}' AS key, cast({k} AS varchar) AS value FROM run"
        for k in ("n_files_total", "n_data_files", "n_duplicates", "n_files_not_loaded", "n_columns_checked",
                  "n_direct_pii", "n_indirect", "n_internal_id"))
    o["parse_answers"] = f"""
WITH a AS ({planted.duck_text(planted.ANSWERS)}),
b AS (SELECT *, regexp_extract_all(raw, '(?s)```(?:json)?\\s*(.*?)```', 1) AS blocks FROM a),
t AS (SELECT *, list_filter(list_transform(CASE WHEN len(blocks) > 0 THEN list_reverse(blocks) ELSE [raw] END,
  lambda x: trim(x, chr(10) || ' ')), lambda x: json_valid(x))[1] AS ans FROM b)
SELECT conv_id, turn, ans ->> '$.evaluation' AS evaluation, ans ->> '$.reasoning' AS reasoning,
  regexp_extract(lower({trim("(ans ->> '$.looks_like_coordinate')")}), '^[a-z]*') AS word,
  (ans ->> '$.evaluation') IS NOT NULL AS valid FROM t"""
    attempts = planted.duck_text(planted.ATTEMPTS)
    o["first_valid_attempt"] = (f"SELECT col_key, attempt, prompt_tokens FROM ({attempts}) WHERE valid "
                                "QUALIFY row_number() OVER (PARTITION BY col_key ORDER BY attempt) = 1")
    why, note = "coalesce(answer_reasoning, '')", "Values pair with a neighbouring column as positions on land."
    word = f"regexp_extract(lower({trim('value')}), '^[a-z]*')"
    failed = "no usable answer in 4 attempts"
    o["merged_verdicts"] = f"""
SELECT event_id, {verdict_case('is_gps', 'value', 'floor_met')} AS evaluation,
  CASE WHEN is_gps AND value IS NULL THEN 'Possible coordinate. {note} Classifier: {failed}; kept to be safe.'
    WHEN is_gps AND {word} = 'yes' THEN concat('Coordinate. {note} Name or label agrees. Classifier: ', {why})
    WHEN is_gps AND {word} = 'no' THEN concat('Not a coordinate. {note} Name or label says otherwise. Classifier: ', {why})
    WHEN is_gps THEN concat('Possible coordinate. {note} Name or label does not tell. Classifier: ', {why})
    WHEN floor_met AND value IS NULL THEN concat(note, ' Classifier: {failed}')
    WHEN floor_met AND value = 'direct_pii' THEN concat(note, ' Classifier: ', {why})
    WHEN floor_met THEN concat(note, ' Classifier: ', {why}, ' (its own verdict: ', value, ')')
    WHEN value IS NULL THEN 'Classifier: {failed}' ELSE {why} END AS reasoning
FROM ({planted.duck_text(planted.VERDICT_INPUTS)})"""
    o["survey_verdicts"] = f"""{screened}, st AS ({stats('survey', SURVEY_COLS)}), {FLOORS},
v AS (SELECT c.col_idx, c.col_name, c.reason_code = 'gps' AS is_gps, coalesce(floors.floor_met, false) AS floor_met,
  CASE WHEN c.col_idx = 10 THEN 'Yes!' WHEN c.col_idx = 11 THEN 'no, it''s a score' WHEN c.col_idx % 4 = 0 THEN NULL
    WHEN c.col_idx % 4 = 1 THEN 'direct_pii' WHEN c.col_idx % 4 = 2 THEN 'not_pii' ELSE 'internal_id' END AS value
  FROM coded c LEFT JOIN floors ON floors.col_idx = c.col_idx WHERE c.reason_code IN {SENT})
SELECT col_idx, col_name, {verdict_case('is_gps', 'value', 'floor_met')} AS evaluation FROM v"""
    o["screen_survey"] = f"""{screened}, st AS ({stats('survey', SURVEY_COLS)}), {FLOORS},
v AS (SELECT c.col_name, c.n_rows, coalesce(c.gps_reason, {REASON.replace('CASE reason_code', 'CASE c.reason_code').replace('max_text', 'c.max_text')}) AS filter_reason,
  c.reason_code = 'gps' AS is_gps, coalesce(floors.floor_met, false) AS floor_met,
  CASE WHEN c.reason_code = 'gps' THEN 'unclear' WHEN c.col_name IN ('full_name', 'email', 'phone') THEN 'direct_pii'
    ELSE 'not_pii' END AS value
  FROM coded c LEFT JOIN floors ON floors.col_idx = c.col_idx WHERE c.reason_code IN {SENT})
SELECT 'survey' AS file, col_name, n_rows, filter_reason, {verdict_case('is_gps', 'value', 'floor_met')} AS evaluation,
  '' AS duplicate_of FROM v"""
    o["screen_survey_again"] = o["screen_survey"]
    o["screen_damaged_column"] = o["screen_survey"] + """
UNION ALL SELECT 'survey', 'damaged', count(*), 'error', 'error', '' FROM customer"""
    o["dry_run_catalog"] = "\nUNION ALL ".join(
        f"SELECT '{t}' AS file, col_name, n_rows, {lit(rules.DRY_RUN_EVALUATION)} AS evaluation "
        f"FROM ({profile(t, cols)}) WHERE ({cascade_code()}) IN {SENT}" for t, cols in TABLE_COLS.items())
    o["usage_totals"] = f"""SELECT dataset_id, count(*) AS n_calls, cast(sum(prompt_tokens) AS bigint) AS prompt_tokens,
  cast(sum(completion_tokens) AS bigint) AS completion_tokens, round(sum(seconds), 3) AS seconds FROM ({attempts}) GROUP BY 1"""
    o["throughput_minute"] = """
SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS columns_processed FROM events GROUP BY 1
UNION ALL SELECT 'TOTAL', count(*) FROM events"""
    o["throughput_stream"] = """
SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS columns_processed FROM events GROUP BY 1"""
    o["archive_manifest_rows"] = """
WITH top AS (SELECT source AS dataset_id, concat(doc_id, ['.zip', '.tar.gz', '/in.csv', '/deep.zip', '.RAR'][doc_id % 5 + 1]) AS path,
  cast(round(n_chars * 1000 / 1024.0 / 1024.0, 2) AS double) AS mb, sha256(text) AS digest FROM documents WHERE doc_id % 5 NOT IN (2, 3))
SELECT dataset_id, string_agg(path, '; ' ORDER BY path) AS archive_files,
  string_agg(cast(mb AS varchar), '; ' ORDER BY path) AS archive_sizes_mb,
  string_agg(digest, '; ' ORDER BY path) AS archive_sha256s FROM top GROUP BY 1"""
    ledger = f"""known AS ({planted.duck_text(planted.LEDGER)}), found AS ({planted.duck_text(planted.DISCOVERED)}),
led AS (SELECT package_path, CASE WHEN status = 'running' THEN 'pending' ELSE status END AS status, notes, n_files_total,
    cast(NULL AS varchar) AS archive_files, priority FROM known
  UNION ALL SELECT package_path, 'pending', NULL, NULL, NULL, NULL FROM found WHERE package_path NOT IN (SELECT package_path FROM known))"""
    o["ledger_transition"] = f"WITH {ledger} SELECT package_path, status, notes, n_files_total, priority FROM led"
    o["sketched_distinct"] = " UNION ALL ".join(
        f"SELECT '{c}' AS col_name, count(DISTINCT {c}) AS n_unique, true AS in_bounds FROM lineitem" for c in TABLE_COLS["lineitem"])
    o["text_files"] = """
WITH cells AS (SELECT c_nationkey AS nation, c_custkey, unnest(['c_custkey', 'c_name', 'code', 'segment', 'flag']) AS col_name FROM customer)
SELECT nation, col_name, CASE WHEN col_name = 'c_custkey' OR (col_name = 'code' AND nation % 3 < 2) THEN 'numeric'
    WHEN col_name = 'flag' THEN 'bool' ELSE 'string' END AS kind, count(*) AS n_rows,
  count(*) FILTER (col_name <> 'segment' OR c_custkey % 4 <> 0) AS n_nonnull
FROM cells WHERE col_name <> 'flag' OR nation % 2 = 1 GROUP BY ALL"""
    o["ledger_versions"] = o["ledger_transition"]
    o["ledger_status_counts"] = f"""WITH {ledger} SELECT count(*) FILTER (status = 'pending') AS n_pending,
  count(*) FILTER (status = 'done') AS n_done, count(*) FILTER (status = 'skip') AS n_skip FROM led"""
    o["ledger_finish"] = f"""WITH {ledger}, s AS ({planted.duck_text(planted.SUMMARIES)})
SELECT l.package_path, CASE WHEN s.package_path IS NULL THEN l.status WHEN s.failed THEN 'error'
    WHEN contains(lower(s.archive_files), 'b.rar') THEN {lit(rules.STATUS_RAR)}
    WHEN s.n_files_total = 0 THEN {lit(rules.STATUS_NO_FILES)} ELSE 'done' END AS status, l.notes,
  CASE WHEN s.package_path IS NULL OR s.failed THEN l.n_files_total ELSE s.n_files_total END AS n_files_total,
  CASE WHEN s.package_path IS NULL OR s.failed THEN l.archive_files ELSE s.archive_files END AS archive_files, l.priority
FROM led l LEFT JOIN s ON s.package_path = l.package_path"""
    marks = (("chr(9)", 0), ("','", 1), ("';'", 2), ("'|'", 3))
    votes = "\nUNION ALL ".join(
        f"SELECT path, {m} AS mark, {i} AS o, min(k) AS lo FROM (SELECT path, length(line) - length(replace(line, {m}, '')) AS k "
        f"FROM heads) GROUP BY 1 HAVING min(k) = max(k) AND min(k) > 0" for m, i in marks)
    o["ledger_two_writers"] = o["ledger_finish"]
    o["dialect_detection"] = f"""
WITH lines AS ({planted.duck_text(planted.TEXT_LINES)}),
heads AS (SELECT * FROM lines WHERE length({trim('line')}) > 0
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no) <= 10),
votes AS ({votes}),
best AS (SELECT path, mark FROM votes QUALIFY row_number() OVER (PARTITION BY path ORDER BY lo DESC, o) = 1)
SELECT h.path, best.mark AS delimiter FROM (SELECT DISTINCT path FROM heads) h LEFT JOIN best ON best.path = h.path"""
    o["encoding_check"] = "SELECT doc_id, doc_id % 10 <> 0 AS is_utf8 FROM documents"
    tokens = "(" + ", ".join(lit(t) for t in rules.MISSING_TOKENS) + ")"
    o["missing_tokens"] = (f"SELECT count(*) AS n, count(*) FILTER (v NOT IN {tokens}) AS n_v, "
                           f"count(*) FILTER (w NOT IN {tokens}) AS n_w FROM ({planted.duck_text(planted.MARKED_CELLS)})")
    o["path_parts"] = f"""
WITH p AS (SELECT path, split_part(path, '/', -1) AS base, lower(split_part(path, '/', -1)) AS low,
  lower(path) AS lpath FROM ({planted.duck_text(planted.FILE_PATHS)})),
e AS (SELECT *, regexp_extract(low, '.\\.([^.]*)$', 1) AS ext FROM p)
SELECT path, base, ext, low = 'thumbs.db' OR contains(path, '/.git/') OR contains(lpath, '__macosx/') AS junk,
  CASE WHEN ext IN ('tgz', 'tar') OR low LIKE '%.tar.gz' OR low LIKE '%.tar.bz2' THEN 'tar'
    WHEN ext IN ('gz', 'zip', 'rar', '7z') THEN ext END AS archive,
  CASE WHEN ext IN ('csv', 'tsv', 'tab') THEN 'delimited' WHEN ext IN ('txt', 'dat') THEN 'sniffed'
    WHEN ext IN ('parquet', 'orc', 'json') THEN 'columnar' END AS kind FROM e"""
    return o


ORACLE = _oracle()
