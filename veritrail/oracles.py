"""DuckDB SQL for the queries' rows."""

from veritrail import rules
from veritrail.queries import REPORTS, SENTENCES, TALES, TEXTS

#: normalize_invisibles: RE2 has no look-around, so the mark inside a word is replaced twice, for matches that share a letter.
_ODD = "'' || chr(160) || chr(8239) || chr(8201) || chr(8202) || chr(8199) || chr(65533) || chr(65283) || chr(65285) || chr(65292) || chr(65294)"
_GONE = "'[' || chr(65279) || chr(8203) || chr(8204) || chr(8205) || chr(8288) || ']'"


def _twice(c: str) -> str:
    inside = "[0-9A-Za-z가-힣]"
    once = f"regexp_replace({c}, '({inside})\\?({inside})', '\\1 \\2', 'g')"
    return f"regexp_replace({once}, '({inside})\\?({inside})', '\\1 \\2', 'g')"


def _norm(c: str) -> str:
    return _twice(f"translate(regexp_replace({c}, {_GONE}, '', 'g'), {_ODD}, '      #%,.')")


def _lines(test: str) -> str:
    return f"WITH {TEXTS} SELECT kind, id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: {test})) AS BIGINT) AS n_lines FROM t"


def _texts(columns: str) -> str:
    return f"WITH {TEXTS} SELECT kind, id, {columns} FROM t"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


_bare = lambda x: f"regexp_replace({_trim(x)}, '^([-*+]\\s+)+', '')"
_cells = lambda x: f"list_transform(string_split(regexp_replace({_bare(x)}, '^\\|+|\\|+$', '', 'g'), '|'), lambda c: {_trim('c')})"
_row = lambda x: f"starts_with({_bare(x)}, '|') AND ends_with({_bare(x)}, '|')"
_heading = lambda x: f"regexp_matches({_bare(x)}, '^(\\\\+#|\\s*#)')"
_title = lambda x: f"regexp_full_match({_trim(x)}, '\\d+\\.\\s+[가-힣A-Za-z\\s]{{1,20}}')"
_rule = lambda x: f"regexp_full_match({x}, '\\s{{0,3}}(-{{3,}}|\\*{{3,}}|_{{3,}})\\s*')"
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_joined = lambda c: f"array_to_string({c}, '|')"
_uniq = lambda c: f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"
_header = lambda x: f"({_row(x)} AND (list_has_all({_cells(x)}, {_list(rules.EXCLUDED_HEADERS)}) OR len(list_filter({_cells(x)}, lambda c: list_contains({_list(rules.FINANCE_KEYS)}, c))) >= 4))"
_figures = lambda x: f"len(list_filter({_cells(x)}[2:], lambda c: regexp_full_match(replace(c, ' ', ''), '-?(\\d{{1,3}}(,\\d{{3}})+|\\d+)(\\.\\d+)?(%|%p|p)?씅?')))"
_yearly = lambda x: f"({_row(x)} AND regexp_full_match({_cells(x)}[1], '(19|20)\\d{{2}}') AND len(list_filter({_cells(x)}[2:], lambda c: c <> '')) >= 6 AND {_figures(x)} >= 5 AND (len(list_filter({_cells(x)}[2:], lambda c: contains(c, '%'))) > 0 OR {_figures(x)} >= 7))"
_NUMBER = r"(?:(?:\d{1,3}(?:,\d{3})+)|\d+)(?:\.\d+)?(?:\s?(?:%|배|개월|년|원|백만원|억원|%p|p))?"
_numbers = lambda c: _uniq(f"list_transform(regexp_extract_all({c}, '{_NUMBER}'), lambda n: regexp_replace(n, '\\s+', '', 'g'))")
_units = lambda c: f"list_filter({_list(rules.UNITS)}, lambda u: contains({c}, u))"
_metrics = lambda c: "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower({c}), '{s.lower()}')" for s in syns) + f" THEN '{k}' END" for k, syns in rules.METRICS.items()) + "], lambda m: m IS NOT NULL)"
_years = lambda c: f"list_transform(regexp_extract_all({c}, '(19|20)\\d{{2}}\\s*년?'), lambda x: translate(x, ' 년', ''))"
_matching = lambda c: _trim(f"regexp_replace(lower({_norm(c)}), '\\s+', ' ', 'g')")


def _variants(c: str) -> str:
    """A number's spellings in order."""
    number, unit = (f"regexp_extract({c}, '^([0-9][0-9,]*(?:\\.[0-9]+)?)(.*)$', {k})" for k in (1, 2))
    plain = f"replace({number}, ',', '')"
    base = f"[{number} || {unit}, {plain} || {unit}, format('{{:,}}', CAST(regexp_extract({plain}, '^\\d+') AS BIGINT)) || regexp_extract({plain}, '\\.\\d+$') || {unit}]"
    spelled = f"flatten(list_transform({base}, lambda b: CASE WHEN contains(b, '%') THEN [b, replace(b, '%', '％')] ELSE [b] END))"
    factor = "CASE " + unit + " " + " ".join(f"WHEN '{k}' THEN {v}.0::DOUBLE" for k, v in rules.WON.items()) + " END"
    parts = []
    for into, won in rules.WON.items():
        v = f"CAST({plain} AS DOUBLE) * ({factor}) / {won}.0::DOUBLE"
        parts.append(f"CASE WHEN {unit} = '{into}' OR ({factor}) IS NULL THEN [] WHEN {v} >= 1 THEN [CAST(CAST(floor({v}) AS BIGINT) AS VARCHAR) || '{into}', format('{{:,}}', CAST(floor({v}) AS BIGINT)) || '{into}'] ELSE [format('{{:.3f}}', {v}) || '{into}'] END")
    return f"list_concat({spelled}, {', '.join(parts)})"


_spelled_in = lambda numbers, text: f"list_filter({numbers}, lambda n: len(list_filter({_variants('n')}, lambda v: contains({text}, v))) > 0)"
_CONFLICT = " OR ".join(f"(contains(claim, '{a}') AND contains(evidence, '{b}'))" for x, y in rules.OPPOSITES for a, b in ((x, y), (y, x)))
_DIRECTIONS = _list(rules.UP_WORDS + rules.DOWN_WORDS)
_CHUNKS = """CASE WHEN text IS NULL THEN [] ELSE list_transform(range(0, CAST(greatest(ceil((length(text) - 900) / 780.0), 0) AS BIGINT) + 1), lambda k: regexp_replace(substr(text, k * 780 + 1, 900), '^\\s+|\\s+$', '', 'g')) END"""

_PAGE_CHUNKS = f"""p AS (SELECT conv_id AS case_id, turn + 1 AS page, text FROM conversations WHERE role <> 'assistant'),
cu AS (SELECT case_id, page, unnest(u) AS text, generate_subscripts(u, 1) - 1 AS chunk_id FROM (SELECT case_id, page, list_filter({_CHUNKS}, lambda t: t <> '') AS u FROM p)),
ch AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY page, chunk_id) - 1 AS ord FROM cu)"""
_GRAMS = lambda c: f"list_transform(flatten([list_transform(range(1, greatest(length({c}) - n + 2, 1)), lambda i: [i, n]) for n in [2, 3, 4, 5]]), lambda g: substr({c}, g[1], g[2]))"
_TFIDF = f"""{_PAGE_CHUNKS},
tf AS (SELECT case_id, ord, ngram, count(*) AS tf FROM (SELECT case_id, ord, unnest({_GRAMS('t')}) AS ngram FROM (SELECT case_id, ord, regexp_replace(lower(text), '\\s\\s+', ' ', 'g') AS t FROM ch)) GROUP BY ALL),
nn AS (SELECT case_id, count(*) AS n FROM ch GROUP BY case_id),
idf AS (SELECT case_id, ngram, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM tf JOIN nn USING (case_id) GROUP BY case_id, ngram),
rw AS (SELECT case_id, ord, ngram, tf * idf AS r FROM tf JOIN idf USING (case_id, ngram)),
nm AS (SELECT case_id, ord, sqrt(sum(r * r)) AS m FROM rw GROUP BY case_id, ord),
w AS (SELECT case_id, ord, ngram, r / m AS w FROM rw JOIN nm USING (case_id, ord))"""
_TOPK = f"""{_TFIDF},
cl AS (SELECT conv_id AS case_id, turn AS claim_id, regexp_replace(lower({_norm('text')}), '\\s\\s+', ' ', 'g') AS t FROM conversations WHERE role = 'assistant'),
ct AS (SELECT case_id, claim_id, ngram, count(*) * any_value(idf) AS r FROM (SELECT case_id, claim_id, unnest({_GRAMS('t')}) AS ngram FROM cl) JOIN idf USING (case_id, ngram) GROUP BY case_id, claim_id, ngram),
cm AS (SELECT case_id, claim_id, sqrt(sum(r * r)) AS m FROM ct GROUP BY ALL),
sc AS (SELECT case_id, claim_id, ord, sum(r * w) / any_value(m) AS score FROM ct JOIN w USING (case_id, ngram) JOIN cm USING (case_id, claim_id) GROUP BY case_id, claim_id, ord),
al AS (SELECT cl.case_id, cl.claim_id, ch.ord, coalesce(sc.score, 0.0) AS score FROM cl JOIN ch ON cl.case_id = ch.case_id LEFT JOIN sc ON sc.case_id = cl.case_id AND sc.claim_id = cl.claim_id AND sc.ord = ch.ord),
top AS (SELECT *, row_number() OVER (PARTITION BY case_id, claim_id ORDER BY round(score, 9) DESC, ord DESC) AS rank FROM al QUALIFY rank <= 3)"""

_FEATURES = """f AS (SELECT *, l_discount * 10 AS sim, l_tax * 10 AS cov, l_quantity / 50 AS block, l_discount * 5 + 0.2 AS near, l_quantity / 100 AS big, l_tax * 5 AS unit, l_linenumber / 7 AS dir, l_returnflag = 'R' AS conflict, l_linestatus = 'O' AS numeric, l_quantity > 40 AS exact, l_linenumber % 2 = 0 AS metric FROM lineitem),
g AS (SELECT *, least(greatest(CASE WHEN numeric THEN 0.32 * sim + 0.22 * cov + 0.22 * block + 0.12 * near + 0.08 * big + 0.03 * unit + 0.01 * dir ELSE 0.55 * sim + 0.40 * cov + 0.03 * near + 0.01 * unit + 0.01 * dir END - CASE WHEN conflict THEN 0.15 ELSE 0 END, 0), 1) AS score FROM f)"""

_CELL_SQL = """c AS (SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS case_id, 1 AS row_no, unnest([0, 1, 2, 3]) AS col_no, unnest(['항목', '매출액', '비율(%)', '잔액(억원)']) AS value FROM supplier
UNION ALL SELECT CAST(s_nationkey AS BIGINT), s_suppkey + 2, unnest([0, 1, 2, 3]), unnest([s_name, CASE WHEN s_suppkey % 10 = 0 THEN format('{:,}', CAST(floor(abs(s_acctbal)) AS BIGINT)) || '백만원' ELSE CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) AS VARCHAR) END, CAST(s_suppkey % 100 AS VARCHAR), CAST(CAST(sign(s_acctbal) * floor(abs(s_acctbal) + 0.5) AS BIGINT) AS VARCHAR)]) FROM supplier)"""

_has = lambda k: f"list_contains(tags, '{k}')"
_any = lambda *ks: "(" + " OR ".join(_has(k) for k in ks) + ")"
_ATT = _any("NUM_MISSING", "BIG_NUM_MISSING", "DIR_CONFLICT", "UNIT_MISMATCH", "NUM_CONFLICT")
_ST = "['SUPPORTED', 'PARTIAL', 'UNSUPPORTED']"
_REVIEW = f"""r0 AS (SELECT l_suppkey AS case_id, l_orderkey * 10 + l_linenumber AS claim_id, 'line ' || CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) AS claim_norm, CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) AS dg, l_quantity > 10 AS hn,
 CASE WHEN l_quantity > 10 AND l_returnflag = 'R' THEN [CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR)] WHEN l_quantity > 10 AND l_returnflag = 'A' THEN ['7'] ELSE [] END AS missing,
 {_ST}[l_linenumber % 3 + 1] AS st, {_ST}[(l_linenumber + 1) % 3 + 1] AS sp, {_ST}[(l_linenumber + 2) % 3 + 1] AS sx, l_discount * 10 AS score, l_tax * 5 AS sheet, l_tax * 10 AS cov, l_discount * 2 AS prox, l_linestatus = 'O' AND l_linenumber = 1 AS dc, l_linenumber = 5 AS nc FROM lineitem),
r1 AS (SELECT *, list_filter([CASE WHEN hn AND len(missing) > 0 THEN 'NUM_MISSING' END, CASE WHEN len(list_filter(missing, lambda x: length(x) >= 3)) > 0 THEN 'BIG_NUM_MISSING' END, CASE WHEN cov >= 0.55 AND prox <= 0.15 THEN 'DISPERSED' END,
 CASE WHEN sp = 'SUPPORTED' AND sx <> 'SUPPORTED' THEN 'PDF_ONLY' END, CASE WHEN sx = 'SUPPORTED' AND sp <> 'SUPPORTED' THEN 'JSON_ONLY' END, CASE WHEN dc THEN 'DIR_CONFLICT' END, CASE WHEN nc THEN 'NUM_CONFLICT' END], lambda x: x IS NOT NULL) AS tags,
 ['CONFIRMED', 'EDIT', 'DELETE', 'HOLD', 'NONE'][(claim_id + CASE WHEN claim_id % 7 = 0 THEN 0 ELSE 1 END) % 5 + 1] AS decision, CASE WHEN claim_id % 7 = 0 THEN 'again' ELSE 'first' END AS note, least(greatest(score, 0), 1) AS s FROM r0),
r2 AS (SELECT *, 1.0 + CASE WHEN hn THEN 0.3 ELSE 0 END + CASE WHEN {_has('NUM_MISSING')} THEN 0.4 ELSE 0 END + CASE WHEN {_has('BIG_NUM_MISSING')} THEN 0.6 ELSE 0 END + CASE WHEN {_has('DIR_CONFLICT')} THEN 0.7 ELSE 0 END + CASE st WHEN 'UNSUPPORTED' THEN 0.4 WHEN 'PARTIAL' THEN 0.2 ELSE 0 END AS weight,
 CASE WHEN st = 'SUPPORTED' AND s < 0.35 THEN 'PARTIAL' ELSE st END AS s1 FROM r1),
r3 AS (SELECT *, CASE WHEN s1 = 'PARTIAL' AND s < 0.20 THEN 'UNSUPPORTED' ELSE s1 END AS s2, st <> 'SUPPORTED' OR {_ATT} OR score <= 0.20 AS insufficient,
 CASE st WHEN 'UNSUPPORTED' THEN CASE WHEN hn THEN 0 ELSE 1 END WHEN 'PARTIAL' THEN CASE WHEN hn THEN 2 ELSE 3 END ELSE 5 END - CASE WHEN {_has('NUM_MISSING')} THEN 0.6 ELSE 0 END - CASE WHEN {_has('BIG_NUM_MISSING')} THEN 0.4 ELSE 0 END - CASE WHEN {_has('DIR_CONFLICT')} THEN 0.6 ELSE 0 END - CASE WHEN {_has('DISPERSED')} THEN 0.15 ELSE 0 END + (1.0 - s) AS priority,
 CASE WHEN decision = 'NONE' THEN NULL WHEN (st = 'SUPPORTED' AND decision = 'CONFIRMED') OR (st = 'PARTIAL' AND decision IN ('EDIT', 'HOLD')) OR (st = 'UNSUPPORTED' AND decision IN ('EDIT', 'DELETE', 'HOLD')) THEN 0.0 ELSE 1.0 END AS mismatch,
 CASE WHEN decision = 'CONFIRMED' THEN 0.12 + 0.20 * (1 - s) ELSE 1.0 END AS cs, CASE WHEN decision = 'CONFIRMED' THEN 0.10 + 0.25 * (1 - s) ELSE 0.55 + 0.45 * (1 - s) END AS ms FROM r2),
ba AS (SELECT * FROM (VALUES ('CONFIRMED', 0.92, 0.05, 0.04, 0.03), ('EDIT', 0.70, -0.05, -0.08, -0.10), ('DELETE', 0.52, -0.14, -0.18, -0.22), ('HOLD', 0.58, 0.0, -0.02, -0.05), ('NONE', 0.25, -0.08, -0.12, -0.20)) AS t(decision, b, a1, a2, a3)),
r4 AS (SELECT r3.*, CAST(b + CASE s2 WHEN 'SUPPORTED' THEN a1 WHEN 'PARTIAL' THEN a2 ELSE a3 END AS DOUBLE) + CASE decision WHEN 'CONFIRMED' THEN CASE s2 WHEN 'SUPPORTED' THEN 0.13 WHEN 'PARTIAL' THEN 0.11 ELSE 0.10 END * s + CASE WHEN s >= 0.85 THEN 0.015 ELSE 0 END WHEN 'EDIT' THEN 0.08 * s - 0.05 * (1 - s) WHEN 'DELETE' THEN 0.06 * s - 0.14 * (1 - s) WHEN 'HOLD' THEN 0.05 * s ELSE 0.02 * s END
 - CASE WHEN {_has('DIR_CONFLICT')} THEN 0.22 * cs ELSE 0 END - CASE WHEN {_has('NUM_CONFLICT')} THEN 0.22 * cs ELSE 0 END - CASE WHEN {_has('BIG_NUM_MISSING')} THEN 0.12 * ms ELSE 0 END - CASE WHEN {_has('NUM_MISSING')} THEN 0.05 * ms ELSE 0 END AS q FROM r3 JOIN ba USING (decision)),
rv AS (SELECT *, least(greatest(CASE WHEN decision = 'CONFIRMED' THEN greatest(q, 0.78) ELSE q END, 0), 1) AS quality FROM r4)"""
_AUDIT = "st = 'UNSUPPORTED' AND decision = 'CONFIRMED' AND hn"
_status = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.STATUS_LABELS.items()) + " END"
_LABELS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in rules.TAG_LABELS.items()) + "}"

_escaped = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#039;')"


def _protected(c: str) -> str:
    """Dots of acronyms, two letters at a time, then that of a last single letter."""
    pairs = f"regexp_replace({c}, '([A-Za-z])\\.([A-Za-z])\\.', '\\1?DOT?\\2' || chr(2), 'g')"
    return f"replace(regexp_replace({pairs}, chr(2) || '([A-Za-z])\\.', '?DOT?\\1?DOT?', 'g'), chr(2), '?DOT?')"


#: Claims of rp(kind, case_id, text): cl, lines kept and joined; bl, blocks; cm, claims.
_excluded = lambda x: f"({_header(x)} OR {_yearly(x)})"
_collapsed = lambda c: _trim(f"regexp_replace({c}, '\\s+', ' ', 'g')")
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_bullets = lambda c, mark: f"regexp_replace({c}, '(?m)(^|\\s){mark}\\s+(\\D)', '\\1' || chr(10) || chr(10) || '\\2', 'g')"
_SIGNS = "regexp_replace(translate(j, '씅', '-'), '\\s*\\(\\s*[+-]\\s*\\)\\s*', chr(10) || chr(10), 'g')"
_cut = lambda c: f"regexp_replace({c}, '([^0-9])\\.([^0-9])', '\\1.' || chr(3) || '\\2', 'g')"
_CLAIMS = f"""ca AS (SELECT kind, case_id, {_twice(f"regexp_replace(regexp_replace({_norm("coalesce(text, '')")}, '(?s)```.*?```', '', 'g'), '\\[\\^[^\\]]+\\]', '', 'g')")} AS bare FROM rp),
cl AS (SELECT kind, case_id, array_to_string(list_filter(regexp_split_to_array(bare, '{_BREAK}'), lambda x: NOT ({_heading('x')} OR {_title('x')} OR {_rule('x')} OR {_excluded('x')})), chr(10)) AS j FROM ca),
cp AS (SELECT kind, case_id, {_protected(f"regexp_replace({_bullets(_bullets(_SIGNS, '[+]'), '-')}, '\\n{{3,}}', chr(10) || chr(10), 'g')")} AS j FROM cl),
bl AS (SELECT kind, case_id, unnest(bs) AS b, generate_subscripts(bs, 1) AS pos FROM (SELECT kind, case_id, list_filter(list_transform(regexp_split_to_array(j, '\\n{{2,}}'), lambda x: {_trim('x')}), lambda x: x <> '') AS bs FROM cp)),
bt AS (SELECT *, contains(b, '|') AND contains(b, chr(10)) AND regexp_matches(b, '(?m)^\\|.*\\|$') AS tabular FROM bl WHERE NOT {_excluded('b')}),
tr AS (SELECT kind, case_id, pos, list_filter(list_transform(regexp_split_to_array(b, '{_BREAK}'), lambda x: {_twice(_trim('x'))}), lambda x: starts_with(x, '|') AND ends_with(x, '|') AND NOT regexp_full_match(x, '\\|\\s*[-: ]+\\s*(\\|\\s*[-: ]+\\s*)+\\|')) AS ls FROM bt WHERE tabular),
ps AS (SELECT kind, case_id, pos, list_filter(list_transform(ls, lambda x: {_collapsed('x')}), lambda x: NOT {_excluded('x')}) AS cs FROM tr WHERE NOT coalesce({_header('ls[1]')}, false)
 UNION ALL SELECT kind, case_id, pos, list_transform(string_split(replace({_cut(_cut(_cut(_cut("chr(1) || b || chr(1)"))))}, chr(1), ''), chr(3)), lambda x: regexp_replace({_collapsed(_twice('x'))}, '\\s(-{{3,}}|\\*{{3,}}|_{{3,}})\\s', ' ', 'g')) FROM bt WHERE NOT tabular),
cu AS (SELECT kind, case_id, pos, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM ps),
cm AS (SELECT kind, case_id, row_number() OVER (PARTITION BY kind, case_id ORDER BY pos, i) AS claim_id, replace(c, '?DOT?', '.') AS claim_text FROM cu WHERE length(c) >= 8 AND NOT ({_heading('c')} OR {_rule('c')} OR {_title('c')}))"""
#: Of s(o_orderkey, claim, evidence): fb(o_orderkey, score) over windows of three sentences, px(o_orderkey, proximity).
_FACTS = f"""fc AS (SELECT o_orderkey, {_metrics('claim')} AS ms, {_years('claim')} AS ys, {_units('claim')} AS us, {_spelled_in(_numbers('claim'), _matching('claim'))} AS ns, list_filter(list_transform(regexp_split_to_array(evidence, '[\\n.?!]+'), lambda x: {_trim('x')}), lambda x: x <> '') AS ss FROM s),
fw AS (SELECT o_orderkey, unnest(list_transform(range(1, len(ss) + 1), lambda i: array_to_string(ss[i:i + 2], ' '))) AS w FROM fc),
fx AS (SELECT o_orderkey, {_metrics('w')} AS wm, {_years('w')} AS wy, {_units('w')} AS wu, {_spelled_in(_numbers('w'), _matching('w'))} AS wn FROM fw),
fy AS (SELECT o_orderkey, list_has_any(wm, ms) AS m, list_has_any(wn, ns) AS n, len(ys) = 0 OR list_has_any(wy, ys) AS y, len(us) = 0 OR list_has_any(wu, us) AS u FROM fx JOIN fc USING (o_orderkey)),
fz AS (SELECT o_orderkey, max(CASE WHEN m AND n AND y AND u THEN 1.0 WHEN m AND n AND (y OR u) THEN 0.85 WHEN m AND n THEN 0.65 WHEN m AND (y OR u) THEN 0.45 WHEN m OR n THEN 0.20 ELSE 0.0 END) AS score FROM fy GROUP BY o_orderkey),
fb AS (SELECT o_orderkey, CASE WHEN len(ms) = 0 OR len(ns) = 0 THEN 0.0 ELSE coalesce(score, 0.0) END AS score FROM fc LEFT JOIN fz USING (o_orderkey))"""
_PROXIMITY = f"""pn AS (SELECT o_orderkey, unnest(ns) AS n, generate_subscripts(ns, 1) AS k FROM (SELECT o_orderkey, {_numbers('claim')} AS ns FROM s)),
pp AS (SELECT s.o_orderkey, n, k, strpos(replace(claim, ' ', ''), n) - 1 AS at FROM pn JOIN s USING (o_orderkey) WHERE contains(replace(claim, ' ', ''), n)),
pw AS (SELECT o_orderkey, w, strpos(claim, w) - 1 AS at FROM (SELECT o_orderkey, claim, unnest({_list(rules.INDICATORS)}) AS w FROM s) WHERE contains(claim, w)),
pk AS (SELECT DISTINCT o_orderkey, w, n, k FROM (SELECT pp.o_orderkey, w, n, k, abs(pp.at - pw.at) AS far, row_number() OVER (PARTITION BY pp.o_orderkey, w ORDER BY abs(pp.at - pw.at), k) AS r FROM pp JOIN pw USING (o_orderkey)) WHERE r = 1 AND far <= 80),
pv AS (SELECT n, {_variants('n')} AS vs FROM (SELECT DISTINCT n FROM pk)),
po AS (SELECT o_orderkey, w, q FROM (SELECT pk.o_orderkey, w, evidence, unnest(range(0, length(evidence))) AS q FROM pk JOIN s USING (o_orderkey)) WHERE substr(evidence, q + 1, length(w)) = w),
ph AS (SELECT DISTINCT pk.o_orderkey, pk.w, pk.k FROM pk JOIN po ON po.o_orderkey = pk.o_orderkey AND po.w = pk.w JOIN pv USING (n) JOIN s ON s.o_orderkey = pk.o_orderkey WHERE len(list_filter(vs, lambda v: contains(substr(evidence, greatest(q - 40, 0) + 1, q + length(pk.w) + 40 - greatest(q - 40, 0)), v))) > 0),
px AS (SELECT s.o_orderkey, CASE WHEN count(pk.w) = 0 THEN 0.5 ELSE count(ph.w) / count(pk.w) END AS proximity FROM s LEFT JOIN pk ON pk.o_orderkey = s.o_orderkey LEFT JOIN ph ON ph.o_orderkey = pk.o_orderkey AND ph.w = pk.w AND ph.k = pk.k GROUP BY s.o_orderkey)"""

ORACLES: dict[str, str] = {
    "normalize_invisibles": _texts(f"md5({_norm('text')}) AS md5"),
    "norm_for_match": _texts(f"md5({_matching('text')}) AS md5"),
    "word_tokens": f"""WITH {TEXTS}, w AS (SELECT kind, id, regexp_extract_all({_norm('text')}, '[가-힣]{{2,}}|[A-Za-z]{{2,}}[A-Za-z0-9\\-_/]*') AS ws FROM t), u AS (SELECT kind, id, w, min(p) AS p FROM (SELECT kind, id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM w) GROUP BY ALL)
SELECT kind, id, count(u.w) AS n, md5(coalesce(string_agg(u.w, '|' ORDER BY p), '')) AS md5 FROM w LEFT JOIN u USING (kind, id) GROUP BY kind, id""",
    "unique_keep_order": f"""WITH {TEXTS}, w AS (SELECT kind, id, regexp_split_to_array(text, '[ \\n]') AS ws FROM t), u AS (SELECT kind, id, w, min(p) AS p FROM (SELECT kind, id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM w) WHERE w <> '' GROUP BY ALL)
SELECT kind, id, md5(coalesce(string_agg(u.w, '|' ORDER BY p), '')) AS md5 FROM w LEFT JOIN u USING (kind, id) GROUP BY kind, id""",
    "split_sentences": f"WITH {TEXTS} SELECT kind, id, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(w, '|')) AS md5 FROM (SELECT kind, id, list_filter(list_transform(regexp_split_to_array(text, '[\\n.?!]+'), lambda x: {_trim('x')}), lambda x: x <> '') AS w FROM t)",
    "html_escape": _texts(f"md5({_escaped('text')}) AS md5"),
    "acronym_dots": _texts(f"md5({_protected('text')}) AS kept, md5(replace({_protected('text')}, '?DOT?', '.')) AS restored"),
    "is_heading": _lines(_heading(_norm("x"))),
    "is_numbered_title": _lines(_title(_norm(_trim("x")))),
    "is_rule_line": _lines(_rule(_norm("x"))),
    "is_excluded_table_header": _lines(_header(_norm("x"))),
    "is_excluded_finance_row": _lines(_yearly(_norm("x"))),
    "extract_numbers": _texts(f"{_joined(_numbers(_norm('text')))} AS numbers"),
    "number_tokens": f"""WITH {TALES} SELECT o_orderkey, {_joined(_numbers('claim'))} AS numbers, {_joined(_years('evidence'))} AS years, {_joined(_units('claim'))} AS units, {_joined(_metrics('claim'))} AS metrics,
 {_joined(f"list_filter({_numbers('claim')}, lambda n: length(regexp_replace(n, '\\D', '', 'g')) >= 3)")} AS big, CAST(replace(regexp_extract(token, '^[0-9][0-9,]*'), ',', '') AS DOUBLE) * CASE regexp_extract(token, '^[0-9][0-9,.]*(.*)$', 1) WHEN '백만원' THEN 1.0 WHEN '억원' THEN 100.0 WHEN '원' THEN 0.000001::DOUBLE END AS amount FROM s""",
    "number_variants": f"WITH {TALES} SELECT o_orderkey, {_joined(_uniq(_variants('token')))} AS variants FROM s",
    "unit_match": f"WITH {TALES} SELECT o_orderkey, round(CASE WHEN len({_units('claim')}) = 0 THEN 0.5 ELSE len(list_filter({_units('claim')}, lambda u: contains(evidence, u))) / len({_units('claim')}) END, 6) AS unit_match FROM s",
    "direction": f"WITH {TALES} SELECT o_orderkey, CAST(CASE WHEN len(list_filter({_DIRECTIONS}, lambda w: contains(claim, w))) = 0 THEN 0.5 WHEN {_CONFLICT} THEN 0.0 ELSE 0.5 + 0.5 * len(list_filter({_DIRECTIONS}, lambda w: contains(claim, w) AND contains(evidence, w))) / len(list_filter({_DIRECTIONS}, lambda w: contains(claim, w))) END AS DOUBLE) AS score, {_CONFLICT} AS conflict FROM s",
    "fact_block": f"WITH {TALES}, {_FACTS} SELECT o_orderkey, CAST(score AS DOUBLE) AS score FROM fb",
    "features": f"""WITH {TALES}, {_PROXIMITY}, f AS (SELECT o_orderkey, ns, list_filter(ns, lambda n: length(regexp_replace(n, '\\D', '', 'g')) >= 3) AS big, {_spelled_in('ns', 'e')} AS near FROM (SELECT o_orderkey, {_numbers('claim')} AS ns, {_matching('evidence')} AS e FROM s)),
 g AS (SELECT *, CASE WHEN len(big) > 0 THEN big ELSE ns END AS asked FROM f)
SELECT o_orderkey, {_joined('near')} AS matched, round(CASE WHEN len(ns) = 0 THEN 0.5 ELSE len(list_filter(asked, lambda n: list_contains(near, n))) / len(asked) END, 6) AS recall, round(proximity, 6) AS proximity FROM g JOIN px USING (o_orderkey)""",
    "combine_status": f"WITH {_REVIEW} SELECT claim_id, CASE WHEN sp = 'SUPPORTED' OR sx = 'SUPPORTED' THEN 'SUPPORTED' WHEN sp = 'PARTIAL' OR sx = 'PARTIAL' THEN 'PARTIAL' ELSE 'UNSUPPORTED' END AS status FROM rv",
    "clean_pages": f"SELECT page_id, md5({_trim(f"regexp_replace({_norm("regexp_replace(html, '<[^>]*>', ' ', 'g')")}, '[ \\t]+', ' ', 'g')")}) AS md5 FROM pages",
    "highlights": f"""WITH {TALES}, h AS (SELECT o_orderkey, '<a & b> ' || evidence AS plain, list_concat(flatten(list_transform({_numbers('claim')}, lambda n: {_variants('n')})), list_filter({_uniq("regexp_extract_all(claim, '[가-힣]{2,}|[A-Za-z]{2,}[A-Za-z0-9\\-_/]*')")}, lambda w: NOT list_contains({_list([*rules.UNITS, '천원', '만원'])}, w))) AS raw FROM s),
 k AS (SELECT o_orderkey, plain, list_filter({_uniq('raw')}, lambda t: contains(plain, t)) AS ts FROM h),
 o AS (SELECT o_orderkey, plain, list_transform(list_sort(list_transform(ts, lambda t, i: {{'n': -length(t), 'i': i, 't': t}})), lambda x: x.t) AS ts FROM k)
SELECT o_orderkey, list_reduce(list_prepend({_escaped('plain')}, list_transform(ts, lambda t: {_escaped('t')})), lambda acc, x: replace(acc, x, '<b>' || x || '</b>')) AS html FROM o""",
    "split_claims": f"WITH {REPORTS}, {_CLAIMS} SELECT kind, case_id, claim_id, claim_text, {_norm('claim_text')} AS claim_norm FROM cm",
    "index_pages": f"SELECT case_id, CAST(k AS BIGINT) AS chunk_id, CAST(length(text) AS BIGINT) AS n, md5(text) AS md5 FROM (SELECT doc_id AS case_id, unnest(u) AS text, generate_subscripts(u, 1) - 1 AS k FROM (SELECT doc_id, list_filter({_CHUNKS}, lambda t: t <> '') AS u FROM documents))",
    "char_tfidf": f"WITH {_TFIDF} SELECT case_id, page, chunk_id, count(*) AS n_ngrams, round(sum(w), 6) AS w_sum FROM w JOIN ch USING (case_id, ord) GROUP BY case_id, page, chunk_id",
    "topk_evidence": f"WITH {_TOPK} SELECT case_id, claim_id, rank, page, chunk_id, round(score, 6) AS score FROM top JOIN ch USING (case_id, ord)",
    "best_evidence": f"""WITH {_TOPK}, e AS (SELECT top.case_id, top.claim_id, top.rank, top.score, ch.page, ch.text FROM top JOIN ch ON top.case_id = ch.case_id AND top.ord = ch.ord)
SELECT case_id, claim_id, round(max(score), 6) AS sim_best, min(page) FILTER (rank = 1) AS page, md5(replace({_trim('substr(min(text) FILTER (rank = 1), 1, 500)')}, chr(10), ' ')) AS snippet_md5, md5({_norm("string_agg(text, chr(10) ORDER BY rank)")}) AS text_md5 FROM e GROUP BY case_id, claim_id""",
    "word_idf": f"""WITH {_PAGE_CHUNKS}, t AS (SELECT case_id, list_distinct(regexp_extract_all(lower({_norm('text')}), '[가-힣]{{2,}}|[a-z]{{2,}}[a-z0-9\\-_/]*|\\d+(?:\\.\\d+)?')) AS w FROM ch), n AS (SELECT case_id, count(*) AS n FROM ch GROUP BY case_id), u AS (SELECT case_id, unnest(w) AS token FROM t)
SELECT case_id, token, round(ln((1 + any_value(n)) / (1 + count(*))) + 1, 6) AS idf FROM u JOIN n USING (case_id) GROUP BY case_id, token""",
    "number_presence": f"""WITH {TALES}, v AS (SELECT DISTINCT o_orderkey, case_id, unnest({_variants('token')}) AS needle FROM s)
SELECT v.o_orderkey, needle FROM v WHERE EXISTS (SELECT 1 FROM s WHERE s.case_id = v.case_id AND contains(s.evidence, v.needle))""",
    "amount_match": "WITH a AS (SELECT DISTINCT o_custkey AS case_id, CAST(floor(o_totalprice / 100) * 100 AS DOUBLE) AS v FROM orders), x AS (SELECT o_custkey AS case_id, o_totalprice + 900 AS x FROM orders) SELECT case_id, v FROM a WHERE EXISTS (SELECT 1 FROM x WHERE x.case_id = a.case_id AND (abs(x.x - a.v) < 0.01 OR (x.x <> 0 AND abs((x.x - a.v) / x.x) < 0.01)))",
    "sheet_rows": f"WITH {_CELL_SQL} SELECT case_id, CAST(row_no AS BIGINT) AS row_no, string_agg(value, ' ' ORDER BY col_no) AS text FROM c GROUP BY case_id, row_no",
    "sheet_amounts": f"WITH {_CELL_SQL} SELECT case_id, CAST(row_no AS BIGINT) AS row_no, value AS cell_text, round(CAST(replace(replace(value, '백만원', ''), ',', '') AS DOUBLE) * CASE WHEN col_no = 3 THEN 0.000001 ELSE 1 END, 6) AS value_mkrw FROM c WHERE row_no > 1 AND col_no IN (1, 3)",
    "json_text_rows": """SELECT case_id, CAST(row_no AS BIGINT) AS row_no, text FROM (SELECT event_id AS case_id, unnest(r) AS text, generate_subscripts(r, 1) AS row_no FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN [event_type || ' now', 'x y z' || chr(10) || 'w', '', 'last'] WHEN 1 THEN [event_type, 'two words'] WHEN 2 THEN [event_type || ' f'] ELSE [] END AS r FROM events))""",
    "final_score": f"WITH {_FEATURES} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(score, 6) AS score FROM g",
    "decide_status": f"""WITH {_FEATURES}, h AS (SELECT *, round(score, 9) AS x FROM g) SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN conflict THEN CASE WHEN x >= 0.22 THEN 'PARTIAL' ELSE 'UNSUPPORTED' END
 WHEN numeric THEN CASE WHEN x >= 0.30 AND (block >= 0.65 OR (metric AND big > 0 AND cov >= 0.45) OR exact) THEN 'SUPPORTED' WHEN x >= 0.22 AND (block >= 0.35 OR big > 0 OR cov >= 0.30 OR sim >= 0.20) THEN 'PARTIAL' WHEN block >= 0.55 AND (cov >= 0.35 OR sim >= 0.25) THEN 'PARTIAL' ELSE 'UNSUPPORTED' END
 WHEN x >= 0.30 AND cov >= 0.45 THEN 'SUPPORTED' WHEN (x >= 0.22 AND cov >= 0.30) OR (cov >= 0.55 AND sim >= 0.18) THEN 'PARTIAL' ELSE 'UNSUPPORTED' END AS status FROM h""",
    "review_rows": f"""WITH {_REVIEW} SELECT case_id, claim_id, decision, note, array_to_string(tags, ',') AS tags, round(CAST(weight AS DOUBLE), 6) AS weight, round(CAST(quality AS DOUBLE), 6) AS quality, CAST(mismatch AS DOUBLE) AS mismatch, round(CAST(priority AS DOUBLE), 6) AS priority, insufficient, decision <> 'CONFIRMED' AND (st <> 'SUPPORTED' OR {_ATT}) AS attention,
 decision = 'NONE' AND (insufficient OR weight >= 1.8 OR {_any('BIG_NUM_MISSING', 'DIR_CONFLICT', 'NUM_CONFLICT', 'UNIT_MISMATCH')}) AS must_review,
 CASE WHEN {_any('DIR_CONFLICT', 'BIG_NUM_MISSING')} THEN '수정 권장' WHEN st = 'UNSUPPORTED' AND hn THEN '수정/삭제 권장' WHEN st = 'SUPPORTED' AND len(tags) = 0 THEN '확인 권장' WHEN st = 'PARTIAL' THEN '수정 또는 보류 권장' ELSE '검토 필요' END AS action,
 array_to_string(list_filter([CASE WHEN {_has('DISPERSED')} THEN 'R: 근거분산(coverage↑ proximity↓)' END, CASE WHEN {_has('NUM_MISSING')} THEN 'R: 숫자누락 ' || len(missing) || '개' END, CASE WHEN {_has('DIR_CONFLICT')} THEN 'R: 방향성 모순' END, CASE st WHEN 'UNSUPPORTED' THEN 'R: 근거미확인' WHEN 'PARTIAL' THEN 'R: 부분근거' END], lambda x: x IS NOT NULL), ',') AS reasons FROM rv""",
    "review_kpis": f"WITH {_REVIEW} SELECT case_id, count(*) AS total, count(*) FILTER (st = 'SUPPORTED') AS supported, count(*) FILTER (st = 'PARTIAL') AS partial, count(*) FILTER (st = 'UNSUPPORTED') AS unsupported, count(*) FILTER ({_has('NUM_MISSING')}) AS number_risk, count(*) FILTER (decision <> 'NONE') AS decided FROM rv GROUP BY case_id",
    "review_scores": f"""WITH {_REVIEW}, a AS (SELECT case_id, count(*) AS total, count(*) FILTER (decision <> 'NONE') AS reviewed, count(*) FILTER ({_AUDIT}) AS audit_risk, count(*) FILTER (decision = 'NONE' AND insufficient) AS required_undecided, CAST(sum(weight) AS DOUBLE) AS ws, 100 * sum(CAST(weight AS DOUBLE) * quality) / sum(CAST(weight AS DOUBLE)) AS qs,
 100.0 * count(*) FILTER (decision <> 'NONE') / count(*) AS completion, 100 * sum(CASE WHEN decision = 'EDIT' THEN CAST(weight AS DOUBLE) ELSE 0 END) / sum(CAST(weight AS DOUBLE)) AS es, 100 * sum(CAST(weight AS DOUBLE) * coalesce(mismatch, 0)) / sum(CAST(weight AS DOUBLE)) AS ms, 100.0 * count(*) FILTER (decision = 'DELETE') / count(*) AS ds FROM rv GROUP BY case_id)
SELECT case_id, total, reviewed, audit_risk, required_undecided, round(ws, 4) AS weight_sum, round(CAST(qs AS DOUBLE), 4) AS quality_score, round(CAST(completion AS DOUBLE), 4) AS completion, round(CAST(es AS DOUBLE), 4) AS edit_share, round(CAST(ms AS DOUBLE), 4) AS mismatch_share, round(CAST(ds AS DOUBLE), 4) AS delete_share,
 CASE {' '.join(f"WHEN qs >= {at} THEN '{g}'" for at, g in rules.GRADES)} ELSE 'F' END AS grade FROM a""",
    "review_queue": f"WITH {_REVIEW} SELECT case_id, claim_id, row_number() OVER (PARTITION BY case_id ORDER BY round(CAST(priority AS DOUBLE), 9), claim_id) AS place FROM rv",
    "kpi_drilldown": f"WITH {_REVIEW} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, case_id, claim_id FROM rv WHERE {t}" for k, t in (("quality_kept", "decision <> 'DELETE'"), ("completion_unreviewed", "decision = 'NONE'"), ("audit_risk", _AUDIT), ("edit", "decision = 'EDIT'"), ("mismatch", "mismatch = 1.0"), ("delete", "decision = 'DELETE'"))),
    "filter_results": f"WITH {_REVIEW} SELECT case_id, claim_id FROM rv WHERE (contains(lower(claim_norm), 'line 1') OR (hn AND contains(dg || ' 7', 'line 1'))) AND (claim_id BETWEEN 10 AND 9000 OR claim_id BETWEEN 70000 AND 90000) AND st = 'PARTIAL' AND {_has('NUM_MISSING')} AND decision = 'EDIT'",
    "review_export": f"""WITH {_REVIEW} SELECT case_id, claim_id, claim_norm AS claim_text, st AS system_status, round(CAST(weight AS DOUBLE), 1) AS quality_w, round(round(CAST(quality AS DOUBLE), 9), 1) AS quality_a, array_to_string(tags, '|') AS quality_tags, decision, note, CAST(CASE WHEN claim_id % 7 = 0 THEN 2000 ELSE 1000 END AS BIGINT) AS updated_at,
 format('{{:.3f}}', score) AS pdf_score, format('{{:.3f}}', sheet) AS xlsx_score, array_to_string(missing, '|') AS missing_numbers, array_to_string(list_transform(tags, lambda t: {_LABELS}[t]), '|') AS risk_tags, claim_id AS id, {_status('st')} AS overall, st AS overall_raw, format('{{:.3f}}', score) AS score_overall, {_status('sp')} AS pdf, sp AS pdf_raw, format('{{:.3f}}', score) AS score_pdf,
 {_status('sx')} AS xlsx, sx AS xlsx_raw, format('{{:.3f}}', sheet) AS score_xlsx, CASE WHEN hn THEN 2 ELSE 0 END AS num_total, CAST(len(missing) AS INT) AS num_missing, CASE WHEN hn THEN dg || '|7' ELSE '' END AS numbers, claim_norm AS claim FROM rv""",
}

_OPENS = "CASE WHEN regexp_matches(line, '^\\d+\\.\\s+\\S') THEN 'h2' WHEN (line LIKE '[%' AND line LIKE '%]') OR (line LIKE '【%' AND line LIKE '%】') THEN 'h3' WHEN regexp_matches(line, '^[oO•-]\\s+') THEN 'list' WHEN contains(line, chr(9)) THEN 'table' ELSE 'paragraph' END"
ORACLES["segment_blocks"] = f"""
WITH {REPORTS}, l AS (SELECT {{'k': kind, 'i': case_id}} AS case_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS pos FROM (SELECT kind, case_id, string_split({_trim(_norm("coalesce(text, '')"))}, chr(10)) AS ls FROM rp)),
n AS (SELECT case_id, pos, raw, {_trim('raw')} AS line FROM l),
o AS (SELECT *, {_OPENS} AS opens, contains(raw, chr(9)) AS tabbed, sum(CAST(line = '' AS INT)) OVER w AS run, sum(CAST(NOT contains(raw, chr(9)) AS INT)) OVER w AS tabs FROM n WINDOW w AS (PARTITION BY case_id ORDER BY pos)),
t AS (SELECT * REPLACE (CASE WHEN tabbed AND bool_or(opens = 'table') OVER (PARTITION BY case_id, run, tabs ORDER BY pos) THEN 'table' ELSE opens END AS opens) FROM o WHERE line <> ''),
k AS (SELECT *, CASE WHEN bool_or(opens = 'paragraph') OVER (PARTITION BY case_id, run ORDER BY pos) THEN 'paragraph' ELSE opens END AS kind FROM t),
s AS (SELECT *, CAST(kind IN ('h2', 'h3') OR lag(kind) OVER w IS DISTINCT FROM kind OR lag(run) OVER w IS DISTINCT FROM run AS INT) AS starts FROM k WINDOW w AS (PARTITION BY case_id ORDER BY pos)),
b AS (SELECT *, sum(starts) OVER (PARTITION BY case_id ORDER BY pos) AS block_id, CASE kind WHEN 'list' THEN regexp_replace(line, '^[oO•-]\\s+', '') WHEN 'table' THEN array_to_string(list_transform(string_split(raw, chr(9)), lambda c: {_trim('c')}), chr(9)) ELSE line END AS part FROM s)
SELECT b.case_id.k AS kind, b.case_id.i AS case_id, CAST(b.block_id AS BIGINT) AS block_id, b.kind AS block_kind, CAST(CASE WHEN b.kind = 'paragraph' THEN 1 ELSE count(*) END AS BIGINT) AS n_rows, md5(CASE WHEN b.kind = 'paragraph' THEN string_agg(part, ' ' ORDER BY pos) ELSE string_agg(part, chr(10) ORDER BY pos) END) AS md5 FROM b GROUP BY b.case_id, b.block_id, b.kind"""
ORACLES["locate_claims"] = f"""WITH {SENTENCES}, n AS (SELECT case_id, o_orderkey, claim, row_number() OVER (PARTITION BY case_id ORDER BY o_orderkey) AS r FROM s), m AS (SELECT *, min(r) OVER (PARTITION BY case_id, claim) AS first FROM n)
SELECT case_id, o_orderkey AS claim_id, ['must_review', 'confirmed', 'edit', 'delete', 'must_review'][o_orderkey % 5 + 1] AS mark, CAST(first AS BIGINT) AS block_id FROM m WHERE o_orderkey % 3 > 0"""

#: The whole of a verification with one piece of evidence a source: of tl, the tales, each both a claim and a page, and a sheet of amounts.
_weighted = lambda weights: " + ".join(f"{w} * {x}" for w, x in zip(weights, ("sim", "coverage", "block", "near_share", "recall", "unit", "direction"), strict=True))
_words = _uniq("regexp_extract_all(claim, '[가-힣]{2,}|[A-Za-z]{2,}[A-Za-z0-9\\-_/]*')")
_VERIFIED = f"""{TALES.replace("s AS (SELECT o_orderkey, case_id, CASE", "tl AS (SELECT o_orderkey, case_id, CASE")},
cl AS (SELECT case_id, o_orderkey, row_number() OVER (PARTITION BY case_id ORDER BY o_orderkey) AS claim_id, claim, regexp_replace(lower(claim), '\\s\\s+', ' ', 'g') AS t FROM tl),
ch AS (SELECT *, regexp_replace(lower(text), '\\s\\s+', ' ', 'g') AS t FROM (SELECT case_id, 'pdf' AS source, o_orderkey AS place, {_trim("regexp_replace(evidence, '[ \\t]+', ' ', 'g')")} AS text FROM tl UNION ALL SELECT case_id, 'xlsx', o_orderkey + 2, CAST(CAST(price AS BIGINT) AS VARCHAR) FROM tl UNION ALL SELECT DISTINCT case_id, 'xlsx', 1, '매출액' FROM tl)),
tf AS (SELECT case_id, source, place, ngram, count(*) AS tf FROM (SELECT case_id, source, place, unnest({_GRAMS('t')}) AS ngram FROM ch) GROUP BY ALL),
nn AS (SELECT case_id, source, count(*) AS n, string_agg({_matching('text')}, chr(10)) AS folded, string_agg({_norm('text')}, chr(10)) AS plain FROM ch GROUP BY case_id, source),
idf AS (SELECT case_id, source, ngram, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM tf JOIN nn USING (case_id, source) GROUP BY case_id, source, ngram),
rw AS (SELECT case_id, source, place, ngram, tf * idf AS r FROM tf JOIN idf USING (case_id, source, ngram)),
nm AS (SELECT case_id, source, place, sqrt(sum(r * r)) AS m FROM rw GROUP BY ALL),
ct AS (SELECT case_id, claim_id, source, ngram, count(*) * any_value(idf) AS r FROM (SELECT case_id, claim_id, unnest({_GRAMS('t')}) AS ngram FROM cl) JOIN idf USING (case_id, ngram) GROUP BY ALL),
cq AS (SELECT case_id, claim_id, source, sqrt(sum(r * r)) AS m FROM ct GROUP BY ALL),
sc AS (SELECT ct.case_id, ct.claim_id, ct.source, rw.place, sum(ct.r * rw.r) / any_value(nm.m) / any_value(cq.m) AS score FROM ct JOIN rw ON rw.case_id = ct.case_id AND rw.source = ct.source AND rw.ngram = ct.ngram JOIN nm ON nm.case_id = rw.case_id AND nm.source = rw.source AND nm.place = rw.place JOIN cq ON cq.case_id = ct.case_id AND cq.claim_id = ct.claim_id AND cq.source = ct.source GROUP BY ct.case_id, ct.claim_id, ct.source, rw.place),
ev AS (SELECT cl.case_id, cl.claim_id, ch.source, cl.o_orderkey * 2 + CAST(ch.source = 'xlsx' AS INT) AS o_orderkey, claim, ch.text AS evidence, ch.place, coalesce(sc.score, 0.0) AS sim FROM cl JOIN ch ON ch.case_id = cl.case_id LEFT JOIN sc ON sc.case_id = cl.case_id AND sc.claim_id = cl.claim_id AND sc.source = ch.source AND sc.place = ch.place
 QUALIFY row_number() OVER (PARTITION BY cl.case_id, cl.claim_id, ch.source ORDER BY round(coalesce(sc.score, 0.0), 9) DESC, ch.place DESC) = 1),
s AS (SELECT o_orderkey, claim, evidence FROM ev), {_FACTS}, {_PROXIMITY},
tk AS (SELECT o_orderkey, token, bool_or(numeric) AS numeric FROM (SELECT o_orderkey, unnest(list_filter({_words}, lambda w: NOT list_contains({_list(rules.STOP_WORDS)}, w))) AS token, false AS numeric FROM ev UNION ALL SELECT o_orderkey, unnest({_numbers('claim')}), true FROM ev) GROUP BY o_orderkey, token),
tv AS (SELECT *, length(regexp_replace(token, '[^0-9]', '', 'g')) AS digits, CASE WHEN numeric THEN list_transform({_variants('token')}, lambda v: lower(v)) ELSE [{_matching('token')}] END AS needles FROM tk),
wi AS (SELECT case_id, source, token, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM (SELECT case_id, source, unnest(list_distinct(regexp_extract_all(lower({_norm('text')}), '[가-힣]{{2,}}|[a-z]{{2,}}[a-z0-9\\-_/]*|\\d+(?:\\.\\d+)?'))) AS token FROM ch) JOIN nn USING (case_id, source) GROUP BY ALL),
tw AS (SELECT tv.o_orderkey, CASE WHEN numeric THEN CASE WHEN digits >= 3 THEN 2 ELSE 1 END * greatest(CASE WHEN digits > 0 THEN digits ELSE length(tv.token) END, 1) ELSE greatest(length(tv.token), 1) * coalesce(wi.idf, 1.0) END AS w, len(list_filter(needles, lambda v: contains({_matching('ev.evidence')}, v))) > 0 AS near, len(list_filter(needles, lambda v: contains(nn.folded, v))) > 0 AS far
 FROM tv JOIN ev ON ev.o_orderkey = tv.o_orderkey JOIN nn ON nn.case_id = ev.case_id AND nn.source = ev.source LEFT JOIN wi ON NOT tv.numeric AND wi.case_id = ev.case_id AND wi.source = ev.source AND wi.token = {_matching('tv.token')}),
co AS (SELECT o_orderkey, sum(CASE WHEN near THEN w ELSE 0 END) / sum(w) AS here, sum(CASE WHEN far THEN w ELSE 0 END) / sum(w) AS whole FROM tw GROUP BY o_orderkey),
nu AS (SELECT ev.*, ns, list_filter(ns, lambda n: length(regexp_replace(n, '[^0-9]', '', 'g')) >= 3) AS big, folded, plain, least(greatest(coalesce(here, 0), coalesce(0.85 * whole + 0.15 * here, 0), 0), 1) AS coverage FROM ev JOIN (SELECT o_orderkey, {_numbers('claim')} AS ns FROM ev) USING (o_orderkey) JOIN nn USING (case_id, source) LEFT JOIN co USING (o_orderkey)),
na AS (SELECT o_orderkey, n, replace(regexp_extract(n, '^[0-9][0-9,]*(?:\\.[0-9]+)?'), ',', '')::DOUBLE * CASE regexp_extract(n, '^[0-9][0-9,.]*(.*)$', 1) WHEN '백만원' THEN 1.0 WHEN '억원' THEN 100.0 WHEN '원' THEN 0.000001::DOUBLE END AS v, case_id FROM (SELECT o_orderkey, case_id, unnest(ns) AS n FROM nu WHERE source = 'xlsx')),
nb AS (SELECT o_orderkey, list(n) AS hits FROM na WHERE EXISTS (SELECT 1 FROM tl WHERE tl.case_id = na.case_id AND (abs(price - v) < 0.01 OR (price <> 0 AND abs((price - v) / price) < 0.01))) GROUP BY o_orderkey),
nc AS (SELECT nu.*, CASE WHEN len(big) > 0 THEN big ELSE ns END AS asked, list_filter(ns, lambda n: list_contains(coalesce(hits, []), n)) AS amounts, {_spelled_in('ns', 'plain')} AS textual, {_spelled_in('ns', _matching('evidence'))} AS close FROM nu LEFT JOIN nb USING (o_orderkey)),
nd AS (SELECT *, CASE WHEN source = 'xlsx' THEN list_filter(asked, lambda n: list_contains(amounts, n)) ELSE close END AS found, list_concat(amounts, list_filter(textual, lambda n: NOT list_contains(amounts, n))) AS matched FROM nc),
ne AS (SELECT nd.*, len(ns) > 0 AS numbered, CASE WHEN len(ns) = 0 THEN 0.5 ELSE len(list_filter(asked, lambda n: list_contains(found, n))) / len(asked) END AS recall, len(list_filter(big, lambda n: list_contains(found, n))) AS exact, px.proximity AS near_share, fb.score AS block, len({_metrics('claim')}) > 0 AS metric,
 CASE WHEN len({_units('claim')}) = 0 THEN 0.5 ELSE len(list_filter({_units('claim')}, lambda u: contains(evidence, u))) / len({_units('claim')}) END AS unit, {_CONFLICT} AS conflict,
 CASE WHEN len(list_filter({_DIRECTIONS}, lambda w: contains(claim, w))) = 0 THEN 0.5 WHEN {_CONFLICT} THEN 0.0 ELSE 0.5 + 0.5 * len(list_filter({_DIRECTIONS}, lambda w: contains(claim, w) AND contains(evidence, w))) / len(list_filter({_DIRECTIONS}, lambda w: contains(claim, w))) END AS direction
 FROM nd JOIN px USING (o_orderkey) JOIN fb USING (o_orderkey)),
nf AS (SELECT *, least(greatest(CASE WHEN numbered THEN {_weighted(rules.NUMBER_WEIGHTS)} ELSE {_weighted(rules.TEXT_WEIGHTS)} END - CASE WHEN conflict THEN 0.15 ELSE 0 END, 0), 1) AS score FROM ne),
ng AS (SELECT *, CASE WHEN conflict THEN CASE WHEN score >= 0.22 THEN 'PARTIAL' ELSE 'UNSUPPORTED' END
 WHEN numbered THEN CASE WHEN score >= 0.30 AND (block >= 0.65 OR (metric AND recall > 0 AND coverage >= 0.45) OR exact >= 1) THEN 'SUPPORTED' WHEN score >= 0.22 AND (block >= 0.35 OR recall > 0 OR coverage >= 0.30 OR sim >= 0.20) THEN 'PARTIAL' WHEN block >= 0.55 AND (coverage >= 0.35 OR sim >= 0.25) THEN 'PARTIAL' ELSE 'UNSUPPORTED' END
 WHEN score >= 0.30 AND coverage >= 0.45 THEN 'SUPPORTED' WHEN (score >= 0.22 AND coverage >= 0.30) OR (coverage >= 0.55 AND sim >= 0.18) THEN 'PARTIAL' ELSE 'UNSUPPORTED' END AS status,
 numbered AND score >= 0.22 AND len(list_filter(ns, lambda n: NOT list_contains(matched, n))) > 0 AS doubt FROM nf),
vo AS (SELECT p.*, x.status AS xstatus, x.score AS xscore, CASE WHEN p.status = 'SUPPORTED' OR x.status = 'SUPPORTED' THEN 'SUPPORTED' WHEN p.status = 'PARTIAL' OR x.status = 'PARTIAL' THEN 'PARTIAL' ELSE 'UNSUPPORTED' END AS overall, list_filter(p.ns, lambda n: NOT list_contains(p.matched, n) AND NOT list_contains(x.matched, n)) AS missing, x AS x FROM ng p JOIN ng x ON x.o_orderkey = p.o_orderkey + 1 WHERE p.source = 'pdf')"""
_bar = lambda c: f"array_to_string({c}, ' | ')"
_two = lambda name, c: f"round({c}, 6) AS {name}_pdf, round(x.{c}, 6) AS {name}_xlsx"
ORACLES["verify_orders"] = f"""WITH {_VERIFIED} SELECT case_id, claim_id, {_status('overall')} AS status_overall, overall AS raw_status_overall, {_status('status')} AS status_pdf, status AS raw_status_pdf, {_status('xstatus')} AS status_xlsx, xstatus AS raw_status_xlsx, round(greatest(score, xscore), 6) AS best_score_overall, round(score, 6) AS best_score_pdf, round(xscore, 6) AS best_score_xlsx,
 {', '.join(_two(*x) for x in (('sim_best', 'sim'), ('coverage', 'coverage'), ('proximity', 'near_share'), ('big_num_recall', 'recall'), ('unit_match', 'unit'), ('direction_score', 'direction')))}, exact AS exact_big_num_matches_pdf, x.exact AS exact_big_num_matches_xlsx, CAST(conflict AS BIGINT) AS direction_conflict_pdf, CAST(x.conflict AS BIGINT) AS direction_conflict_xlsx,
 len(ns) AS num_total, len(matched) AS pdf_num_matched, len(x.matched) AS xlsx_num_matched, len(missing) AS num_missing_all, {_bar('ns')} AS numbers_in_claim, {_bar('matched')} AS matched_numbers_pdf, {_bar('x.matched')} AS matched_numbers_xlsx, {_bar('missing')} AS missing_numbers_all, CAST(doubt AS BIGINT) AS num_conflict_pdf, CAST(x.doubt AS BIGINT) AS num_conflict_xlsx, claim AS claim_text,
 place AS pdf_top_page, CAST(0 AS BIGINT) AS pdf_top_chunk, round(sim, 6) AS pdf_top_score, replace(evidence, chr(10), ' ') AS pdf_top_snippet, x.place AS xlsx_top_row, CAST(0 AS BIGINT) AS xlsx_top_chunk, round(x.sim, 6) AS xlsx_top_score, '[sales.xlsx] row ' || x.place || ': ' || x.evidence AS xlsx_top_snippet FROM vo"""
ORACLES["verify_indexed"] = ORACLES["verify_orders"]
ORACLES["whole_queue"] = f"WITH {_REVIEW} SELECT case_id, claim_id, row_number() OVER (ORDER BY score DESC, case_id, claim_id) AS place FROM rv"
_KEYED = "k AS (SELECT case_id, claim_id, round(CAST(priority AS DOUBLE), 9) AS queue_key FROM rv)"
ORACLES["queue_page"] = f"""WITH {_REVIEW}, {_KEYED}, f AS (SELECT * FROM k WHERE case_id = 7 ORDER BY queue_key, claim_id LIMIT 1)
SELECT k.* FROM k, f WHERE (k.queue_key, k.case_id, k.claim_id) > (f.queue_key, f.case_id, f.claim_id) ORDER BY k.queue_key, k.case_id, k.claim_id LIMIT 40"""
ORACLES["grade_counts"] = f"SELECT grade, count(*) AS cases FROM ({ORACLES['review_scores']}) GROUP BY grade"
ORACLES["report_files"] = f"SELECT case_id, claim_id, count(*) OVER (PARTITION BY case_id) AS total_claims, raw_status_overall, best_score_overall, numbers_in_claim, missing_numbers_all, pdf_top_snippet FROM ({ORACLES['verify_orders']})"
ORACLES["report_csv"] = f"SELECT case_id, claim_id, claim_text, status_overall, num_total, pdf_num_matched, best_score_pdf FROM ({ORACLES['verify_orders']})"
_TOLD = _norm("('매출％ ' || coalesce(text, ''))")
ORACLES["read_reports"] = f"SELECT doc_id, CAST(length({_TOLD}) AS BIGINT) AS n, md5({_TOLD}) AS md5, true AS good FROM documents"
ORACLES["running_decisions"] = f"WITH {_REVIEW} SELECT DISTINCT case_id, claim_id, decision, note, CAST(CASE WHEN claim_id % 7 = 0 THEN 2000 ELSE 1000 END AS BIGINT) AS updated_at FROM rv"
ORACLES["verify_json"] = f"""SELECT v.* REPLACE (r.place AS pdf_top_page) FROM ({ORACLES['verify_orders']}) v JOIN (SELECT o_custkey AS case_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders) r ON r.case_id = v.case_id AND r.o_orderkey = v.pdf_top_page"""
_MARKED = f"""sn AS (SELECT o_orderkey AS k, claim, replace(evidence, chr(10), ' ') AS plain FROM vo UNION ALL SELECT o_orderkey + 1, claim, '[sales.xlsx] row ' || x.place || ': ' || x.evidence FROM vo),
ha AS (SELECT k, plain, list_concat(flatten(list_transform({_numbers('claim')}, lambda n: {_variants('n')})), list_filter({_uniq("regexp_extract_all(claim, '[가-힣]{2,}|[A-Za-z]{2,}[A-Za-z0-9\\-_/]*')")}, lambda w: NOT list_contains({_list([*rules.UNITS, '천원', '만원'])}, w))) AS raw FROM sn),
hb AS (SELECT k, plain, list_filter({_uniq('raw')}, lambda t: contains(plain, t)) AS ts FROM ha),
hc AS (SELECT k, plain, list_transform(list_sort(list_transform(ts, lambda t, i: {{'n': -length(t), 'i': i, 't': t}})), lambda x: x.t) AS ts FROM hb),
hd AS (SELECT k, plain, list_reduce(list_prepend({_escaped('plain')}, list_transform(ts, lambda t: {_escaped('t')})), lambda acc, x: replace(acc, x, '<b>' || x || '</b>')) AS html FROM hc)"""
ORACLES["payload_orders"] = f"""WITH {_VERIFIED}, {_MARKED} SELECT case_id, claim_id, claim, {_status('overall')} AS overall, overall AS overall_raw, round(greatest(score, xscore), 6) AS score_overall, round(coverage, 6) AS coverage_pdf, x.doubt AS num_conflict_xlsx, {_joined('ns')} AS numbers, {_joined('missing')} AS missing_numbers, len(ns) AS num_total, len(missing) AS num_missing,
 CAST(1 AS BIGINT) AS n_pdf, place AS pdf_page, round(sim, 6) AS pdf_score, a.plain AS pdf_raw, a.html AS pdf_html, CAST(1 AS BIGINT) AS n_xlsx, x.place AS xlsx_row, round(x.sim, 6) AS xlsx_score, b.plain AS xlsx_raw, b.html AS xlsx_html FROM vo JOIN hd a ON a.k = vo.o_orderkey JOIN hd b ON b.k = vo.o_orderkey + 1"""
ORACLES["repaired_claims"] = f"WITH {REPORTS}, {_CLAIMS.replace('?DOT?', chr(0xE000))} SELECT kind, case_id, claim_id, claim_text FROM cm"
ORACLES["index_rows"] = f"""WITH r AS (SELECT doc_id AS case_id, list_filter(['head', ' ', coalesce(text, '')], lambda x: {_trim(_norm('x'))} <> '') AS rs FROM documents), e AS (SELECT case_id, unnest(rs) AS raw, generate_subscripts(rs, 1) AS row_no FROM r),
c AS (SELECT case_id, row_no, {_trim(f"regexp_replace({_norm('raw')}, '[ \\t]+', ' ', 'g')")} AS text FROM e), u AS (SELECT case_id, row_no, list_filter({_CHUNKS}, lambda t: t <> '') AS u FROM c)
SELECT case_id, CAST(row_no AS BIGINT) AS row_no, CAST(k AS BIGINT) AS chunk_id, CAST(length(text) AS BIGINT) AS n, md5(text) AS md5 FROM (SELECT case_id, row_no, unnest(u) AS text, generate_subscripts(u, 1) - 1 AS k FROM u)"""
_LARGE = _TOPK.replace("SELECT conv_id AS case_id, turn + 1 AS page, text FROM conversations WHERE role <> 'assistant'", "SELECT 0 AS case_id, doc_id AS page, text FROM documents").replace("SELECT conv_id AS case_id, turn AS claim_id,", "SELECT 0 AS case_id, item_id AS claim_id,").replace("FROM conversations WHERE role = 'assistant'", "FROM benchmark")
ORACLES["topk_large_case"] = f"WITH {_LARGE} SELECT claim_id, rank, page, chunk_id, round(score, 6) AS score FROM top JOIN ch USING (case_id, ord)"
