"""SQL for DuckDB that gives the rows of the queries in cvlake.queries, written apart from the column expressions.

Only the SQL of the derived corpus and of the derived listing, and lists of fixed values, are shared with the queries.
"""

from __future__ import annotations

from cvlake import config as c
from cvlake.operators.phone_plan import GB_PLAN
from cvlake.plans.corpus import CORPUS_SQL
from cvlake.queries import CHOICES, CV_QUERY, DOC_QUERY, EDGES_SQL

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return f"trim({x}, {WS})"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(_q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


CV = f"cv AS ({CORPUS_SQL})"
CV_LINES = f"{CV}, ln AS (SELECT doc_id, no, {_strip('raw')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM cv))"
DOC_LINES = f"dl AS (SELECT doc_id, no, {_strip('raw')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents))"
HEADING = f"(length(line) >= 3 AND len({_words('line')}) <= 6 AND (ends_with(line, ':') OR (upper(line) = line AND regexp_matches(line, '\\p{{L}}') AND length(line) <= 40)))"


def _first_spellings(source: str, keys: str) -> str:
    """SQL over source(keys, pos, item): the first spelling of each item by key, joined in order."""
    return f"""SELECT {keys}, string_agg(item, '|' ORDER BY pos) AS items FROM (
      SELECT {keys}, lower(item) AS low, min(pos) AS pos, arg_min(item, pos) AS item FROM (SELECT {keys}, pos, {_strip('item')} AS item FROM {source}) WHERE item <> '' GROUP BY ALL) GROUP BY ALL"""


def _month(s: str) -> str:
    cases = " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in c.MONTHS.items())
    return f"CASE {s} {cases} END"


def _month_year(s: str) -> str:
    """(date, confidence) expressions of a lower-cased, trimmed string."""
    name = f"regexp_extract({s}, '^([a-z]{{3,9}})\\s+(19|20)[0-9][0-9]$', 1)"
    year = f"TRY_CAST(right({s}, 4) AS INT)"
    month = f"coalesce({_month(name)}, {_month(f'left({name}, 3)')})"
    plain = f"regexp_full_match({s}, '(19|20)[0-9][0-9]')"
    return f"CASE WHEN {plain} THEN make_date({year}, 1, 1) WHEN {name} <> '' AND {month} IS NOT NULL THEN make_date({year}, {month}, 1) END", f"CASE WHEN {plain} THEN CAST(0.7 AS DOUBLE) WHEN {name} <> '' AND {month} IS NOT NULL THEN CAST(0.9 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


MONTH_TEXTS = """mt AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(year(o_orderdate) AS VARCHAR)
  WHEN 1 THEN CASE o_orderkey % 5 WHEN 0 THEN 'Jan' WHEN 1 THEN 'March' WHEN 2 THEN 'Sept' WHEN 3 THEN 'Octob' ELSE 'Xyz' END || ' ' || year(o_orderdate)
  WHEN 2 THEN 'may ' || year(o_orderdate) ELSE year(o_orderdate) || 'x' END AS s FROM orders)"""

CATALOGUE = f"""canon(low, name) AS (SELECT lower(n), n FROM (VALUES {_rows((x,) for x in c.CANONICAL_SKILLS)}) AS t(n)),
vari(low, name) AS (VALUES {_rows((v, k) for k, vs in c.SKILL_VARIANTS.items() for v in vs)}),
abbr(up, name, conf) AS (VALUES {_rows((k, v[0], 0.88 if len(v) == 1 else 0.70) for k, v in c.SKILL_ABBREVIATIONS.items())})"""


def _canonicalise(source: str) -> str:
    """SQL over source(token): (token, canonical, confidence, method)."""
    t = _strip("token")
    title = f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"
    capital = f"list_aggregate(list_transform(string_split(lower({title}), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ')"
    return f"""SELECT s.token, CASE WHEN {t} = '' THEN '' ELSE coalesce(canon.name, vari.name, abbr.name, CASE WHEN upper({title}) = {title} AND regexp_matches({title}, '\\p{{Lu}}') THEN {capital} ELSE {title} END) END AS canonical,
      CAST(CASE WHEN {t} = '' THEN 0 WHEN canon.name IS NOT NULL THEN 0.98 WHEN vari.name IS NOT NULL THEN 0.95 WHEN abbr.name IS NOT NULL THEN abbr.conf ELSE 0.55 END AS DOUBLE) AS confidence,
      CASE WHEN {t} = '' THEN 'passthrough' WHEN canon.name IS NOT NULL THEN 'exact' WHEN vari.name IS NOT NULL THEN 'variant' WHEN abbr.name IS NOT NULL THEN 'abbrev' ELSE 'passthrough' END AS method
      FROM {source} s LEFT JOIN canon ON canon.low = lower({t}) LEFT JOIN vari ON vari.low = lower({t}) LEFT JOIN abbr ON abbr.up = upper(regexp_replace({t}, '[^A-Za-z]', '', 'g'))"""


ALIASES = f"alias(ord, alias, section) AS (VALUES {_rows((i, a, s) for i, (s, a) in enumerate((s, a) for s, al in c.SECTION_ALIASES.items() for a in al))})"
OPENS = f"""heads AS (SELECT DISTINCT line, replace(trim(trim(lower(line), ': '), {WS}), '&', 'and') AS h FROM every WHERE {HEADING}),
opens AS (SELECT line, arg_min(section, ord) AS section FROM heads JOIN alias ON h = alias OR (len({_words('h')}) <= 4 AND (contains(alias, h) OR contains(h, alias))) GROUP BY line)"""
SECTIONED = f"""{ALIASES}, {OPENS},
placed AS (SELECT e.doc_id, e.no, e.line, o.section AS opened, coalesce(last_value(o.section IGNORE NULLS) OVER (PARTITION BY e.doc_id ORDER BY e.no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'header') AS section FROM every e LEFT JOIN opens o ON o.line = e.line),
sec AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS ord, section, line FROM placed WHERE opened IS NULL AND line <> '')"""
CV_SEC = f"{CV_LINES}, every AS (SELECT * FROM ln), {SECTIONED}"

RE_DATE = f"(?i)((?:{c.MONTH_NAME})\\s+[0-9]{{4}}|\\b(?:19|20)[0-9][0-9]\\b)\\s*(?:-+|–|to)\\s*((?:{c.MONTH_NAME})\\s+[0-9]{{4}}|\\b(?:19|20)[0-9][0-9]\\b|present|current|now)"
RE_BULLET = "^\\s*(?:[•\\-*●○▪·]+|[0-9]+\\.)\\s+"


def _blocks(lines: str) -> str:
    """CTEs blocks(doc_id, block, lines) from lines(doc_id, ord, line), ord counting from 0 without gaps."""
    return f"""bl AS (SELECT doc_id, list(line ORDER BY ord) AS ls, list(ord ORDER BY ord) FILTER (WHERE regexp_matches(line, {_q(RE_DATE)})) AS dated FROM {lines} GROUP BY doc_id),
st AS (SELECT doc_id, ls, list_reduce(list_transform(coalesce(dated, []), lambda x: [CAST(x AS BIGINT)]), lambda a, b: CASE WHEN b[1] - a[-1] >= 2 THEN list_concat(a, b) ELSE a END, [CAST(0 AS BIGINT)]) AS starts FROM bl),
en AS (SELECT doc_id, ls, unnest(starts) AS s, unnest(list_append(starts[2:], CAST(len(ls) AS BIGINT))) AS e FROM st),
kp AS (SELECT doc_id, ls, s, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS block, lead(s, 1, CAST(len(ls) AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY s) AS e FROM en WHERE s = 0 OR e - s > 2),
blocks AS (SELECT doc_id, block, ls[s + 1 : e] AS lines FROM kp)"""


EXP_LINES = "xl AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS ord, line FROM sec WHERE section = 'experience')"


def _term_counts(docs: str, query: str) -> str:
    """CTE tf: how often each term is in each document, and as document -1 in the query."""
    stop = _list(c.SEARCH_STOP)
    terms = lambda x: f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({stop}, w))"
    pairs = "list_concat(tk, list_transform(range(1, greatest(len(tk), 1)), lambda i: tk[i] || ' ' || tk[i + 1]))"
    return f"""tok AS (SELECT doc_id, {terms("text")} AS tk FROM {docs} UNION ALL SELECT -1, {terms(query)}),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({pairs}) AS term FROM tok) GROUP BY ALL)"""


def _tfidf(query: str) -> str:
    return f"""{_term_counts("documents", _q(query))},
n AS (SELECT count(*) + 1 AS n FROM documents),
idf AS (SELECT term, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), n WHERE df <= 0.98::DOUBLE * n),
w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
norm AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM w GROUP BY doc_id),
sc AS (SELECT a.doc_id, sum(a.w * b.w) / (any_value(na.l) * any_value(nb.l)) AS s FROM w a JOIN w b ON a.term = b.term AND b.doc_id = -1 JOIN norm na ON na.doc_id = a.doc_id JOIN norm nb ON nb.doc_id = -1 WHERE a.doc_id <> -1 GROUP BY a.doc_id),
tfidf AS (SELECT d.doc_id, coalesce(least(1, greatest(0, s)), 0)::DOUBLE AS tfidf FROM documents d LEFT JOIN sc ON sc.doc_id = d.doc_id)"""


def _overlap(text: str) -> str:
    terms = DOC_QUERY.split(" ")
    return f"least(1, len(list_filter({_list(terms)}, lambda t: contains(lower({text}), t)))::DOUBLE / {max(6, len(terms))})"


TFIDF_OUT = f"WITH {_tfidf(DOC_QUERY)} SELECT doc_id, round(tfidf, 6) AS tfidf FROM tfidf"
EDGES = f"edges AS ({EDGES_SQL})"
KEYWORDS = f"""kw AS (SELECT doc_id, word, count(*) AS n, min(pos) AS pos FROM (
    SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM documents))
  WHERE regexp_full_match(word, '[a-z]{{3,}}') AND NOT list_contains({_list(c.KEYWORD_STOP)}, word) GROUP BY ALL),
top AS (SELECT doc_id, list(word ORDER BY n DESC, pos)[:35] AS kws FROM kw GROUP BY doc_id)"""
ITEM = """it AS (SELECT o_orderkey, o_orderkey % 7 AS k, o_orderstatus AS st, o_custkey AS ck FROM orders)"""


def _phones(x: str) -> str:
    s = "[ \\t\\n\\v\\f\\r]"
    return f"regexp_extract_all({x}, '(\\+44{s}?[0-9][0-9 \\t\\n\\v\\f\\r]{{8,13}}|\\b0[0-9][0-9 \\t\\n\\v\\f\\r]{{8,13}})', 1)"


def _postcodes(x: str, whole: str = "regexp_replace(upper(m), '^([A-Z]{1,2}[0-9]{1,2}[A-Z]?)\\s*([0-9][A-Z]{2})$', '\\1 \\2')") -> str:
    return f"list_transform(regexp_extract_all({x}, '(?i)\\b[A-Z]{{1,2}}[0-9]{{1,2}}[A-Z]?\\s*[0-9][A-Z]{{2}}\\b'), lambda m: {whole})"


def _numbered(rows: str, key: str, values: str) -> str:
    """(key, pos, item) of a list-valued expression."""
    return f"(SELECT {key}, unnest(v) AS item, generate_subscripts(v, 1) AS pos FROM (SELECT {key}, {values} AS v FROM {rows}))"


def oracle_sql() -> dict[str, str]:
    date, conf = _month_year("lower(trim(s))")
    sd, scf = _month_year("lower(trim(a))")
    ed, ecf = _month_year("lower(trim(b))")
    out = {
        "n1": f"SELECT t.conv_id, t.turn, coalesce(f.items, '') AS items FROM conversations t LEFT JOIN ({_first_spellings(_numbered('conversations', 'conv_id, turn', chr(34) + 'x' + chr(34)).replace(chr(34) + 'x' + chr(34), 'string_split(text, chr(32))'), 'conv_id, turn')}) f ON f.conv_id = t.conv_id AND f.turn = t.turn",
        "n2": f"""SELECT doc_id, {_strip("regexp_replace(regexp_replace(regexp_replace(replace(replace(' ' || chr(9) || chr(13) || chr(10) || text || chr(13) || chr(10) || chr(10) || chr(10) || '  x  ' || chr(9) || ' y' || chr(13), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS clean FROM documents""",
        "n3": "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0.0::DOUBLE WHEN s_acctbal > 5000 THEN 1.0::DOUBLE ELSE s_acctbal / 5000 END AS clipped FROM supplier",
        "n4": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a, embeddings b WHERE b.vec_id = 0",
        "n5": f"WITH {CV_LINES}, {DOC_LINES}, u AS (SELECT line FROM ln UNION ALL SELECT line FROM dl) SELECT line, count(*) AS n FROM u WHERE {HEADING} GROUP BY line",
        "n6": "SELECT n_nationkey, upper(n_name[1:4]) || ' ' || upper(n_name) AS code FROM nation",
        "n7": f"WITH {MONTH_TEXTS} SELECT o_orderkey, CAST({date} AS VARCHAR) AS date, {conf} AS confidence FROM mt",
        "n8": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders",
        "n9": "SELECT o_orderkey, CAST((year(o_orderdate) - 1993) * 12 + month(o_orderdate) - 5 AS BIGINT) AS months FROM orders",
        "n10": "WITH x AS (SELECT p_partkey, regexp_replace(trim(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END || ' ' || p_type), '\\s+', ' ', 'g') AS s FROM part) SELECT p_partkey, CASE WHEN s = upper(s) AND regexp_matches(s, '[A-Z]') THEN list_aggregate(list_transform(string_split(lower(s), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') ELSE s END AS title FROM x",
        "c1": f"WITH {CV}, t(variant, canonical) AS (VALUES {_rows((v, k) for k, vs in c.SKILL_VARIANTS.items() for v in vs)}) SELECT variant, canonical, CAST(sum(CASE WHEN contains(lower(text), variant) THEN 1 ELSE 0 END) AS BIGINT) AS n FROM t, cv GROUP BY ALL",
        "c2": f"WITH {CV_LINES}, tok AS (SELECT DISTINCT unnest(list_concat([line], list_concat(string_split(line, ','), list_concat(string_split(line, '|'), string_split(line, '/'))))) AS token FROM ln), {CATALOGUE} {_canonicalise('tok')}",
        "c2_embed": f"""WITH e AS (SELECT v.vec_id, b.vec_id AS b, list_cosine_similarity(v.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings v, embeddings b WHERE b.vec_id < 10),
          m AS (SELECT vec_id, arg_max(b, s) AS b, max(s) AS s FROM e GROUP BY vec_id)
          SELECT vec_id, CASE WHEN s >= 0.7 THEN {_list(c.CANONICAL_SKILLS[:10])}[b + 1] ELSE 'item ' || vec_id END AS canonical, round(CASE WHEN s >= 0.7 THEN 0.6 + 0.35 * least(1, (s - 0.7) / 0.3) ELSE 0.55 END::DOUBLE, 6) AS confidence, CASE WHEN s >= 0.7 THEN 'embed' ELSE 'passthrough' END AS method FROM m""",
        "c2_table": """WITH e AS (SELECT v.vec_id, b.vec_id AS b, list_cosine_similarity(v.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings v, embeddings b WHERE b.vec_id % 3 = 0 AND v.vec_id % 3 <> 0),
          m AS (SELECT vec_id, 'entry ' || arg_max(b, s) AS nearest, max(s) AS s FROM e WHERE s > 0 GROUP BY vec_id)
          SELECT vec_id, nearest, round(s, 6) AS similarity, CASE WHEN s >= 0.7 THEN nearest ELSE 'item ' || vec_id END AS canonical, round(CASE WHEN s >= 0.7 THEN 0.6 + 0.35 * least(1, (s - 0.7) / 0.3) ELSE 0.55 END::DOUBLE, 6) AS confidence, CASE WHEN s >= 0.7 THEN 'embed' ELSE 'passthrough' END AS method FROM m""",
        "g1": f"WITH {CV_LINES}, {DOC_LINES}, every AS (SELECT * FROM ln UNION ALL SELECT -doc_id - 1, no, line FROM dl), {SECTIONED} SELECT doc_id, CAST(ord AS INT) AS ord, section, line FROM sec",
        "g2": f"WITH {CV_LINES}, every AS (SELECT * FROM ln), {ALIASES}, {OPENS} SELECT h.line, o.section FROM heads h LEFT JOIN opens o ON o.line = h.line",
        "g3": f"WITH {CV_SEC}, {EXP_LINES}, {_blocks('xl')} SELECT doc_id, CAST(block AS INT) AS block, array_to_string(lines, '|') AS lines FROM blocks",
        "g4": f"""WITH {CV_SEC}, {EXP_LINES}, bare AS (SELECT doc_id, ord AS pos, trim(regexp_replace(line, {_q(RE_BULLET)}, '')) AS line FROM xl),
          kept AS (SELECT doc_id, pos, line AS item FROM bare WHERE NOT {HEADING} AND length(line) >= 8), f AS ({_first_spellings('kept', 'doc_id')})
          SELECT cv.doc_id, coalesce(items, '') AS lines FROM cv LEFT JOIN f ON f.doc_id = cv.doc_id""",
        "e1": f"""WITH {CV}, u AS (SELECT doc_id, text FROM cv UNION ALL SELECT -doc_id - 1, text FROM documents),
          m AS {_numbered('u', 'doc_id', "regexp_extract_all(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b')")}, f AS ({_first_spellings('m', 'doc_id')})
          SELECT u.doc_id, coalesce(items, '') AS emails FROM u LEFT JOIN f ON f.doc_id = u.doc_id""",
        "e2": f"""WITH {CV}, m AS (SELECT doc_id, pos, trim(regexp_replace(item, '\\s+', ' ', 'g')) AS item FROM {_numbered('cv', 'doc_id', _phones('text'))}),
          g AS (SELECT doc_id, min(pos) AS pos, item FROM m GROUP BY doc_id, item HAVING length(regexp_replace(item, '[^0-9]', '', 'g')) >= 10),
          f AS (SELECT doc_id, array_to_string(list(item ORDER BY pos)[:3], '|') AS phones FROM g GROUP BY doc_id)
          SELECT cv.doc_id, coalesce(phones, '') AS phones FROM cv LEFT JOIN f ON f.doc_id = cv.doc_id""",
        "e2_plan": f"""WITH {CV}, x AS (SELECT doc_id, text || chr(10) || 'Office 0' || ['20 7946 0', '113 496 0', '1632 96', '800 11', '10 5555 5', '845 46', '99 9999 9', '7624 46 0'][CAST(doc_id % 8 + 1 AS INT)] || lpad((doc_id % 1000)::VARCHAR, 3, '0') AS text FROM cv),
          plan(prefix, lengths) AS (VALUES {_rows((p, '/' + '/'.join(map(str, ns)) + '/') for p, _, ns in GB_PLAN)}),
          r AS (SELECT doc_id, pos, item, regexp_replace(regexp_replace(item, '[^0-9+]', '', 'g'), '^(\\+44|0044)?0?', '') AS n FROM {_numbered('x', 'doc_id', _phones('text'))}),
          b AS (SELECT doc_id, pos, any_value(item) AS item, n, arg_max(lengths, length(prefix)) AS lengths FROM r LEFT JOIN plan ON starts_with(n, prefix) GROUP BY doc_id, pos, n),
          v AS (SELECT doc_id, '+44' || n AS phone, min(pos) AS pos FROM b WHERE contains(lengths, '/' || length(n) || '/') GROUP BY doc_id, n),
          vf AS (SELECT doc_id, array_to_string(list(phone ORDER BY pos)[:3], '|') AS phones FROM v GROUP BY doc_id),
          g AS (SELECT doc_id, min(pos) AS pos, trim(regexp_replace(item, '\\s+', ' ', 'g')) AS item FROM r GROUP BY doc_id, trim(regexp_replace(item, '\\s+', ' ', 'g')) HAVING length(regexp_replace(any_value(r.item), '[^0-9]', '', 'g')) >= 10),
          f AS (SELECT doc_id, array_to_string(list(item ORDER BY pos)[:3], '|') AS phones FROM g GROUP BY doc_id)
          SELECT x.doc_id, coalesce(vf.phones, f.phones, '') AS phones FROM x LEFT JOIN vf ON vf.doc_id = x.doc_id LEFT JOIN f ON f.doc_id = x.doc_id""",
        "e3": f"""WITH {CV}, m AS {_numbered('cv', 'doc_id', _postcodes('text'))}, f AS ({_first_spellings('m', 'doc_id')})
          SELECT cv.doc_id, coalesce(items, '') AS postcodes FROM cv LEFT JOIN f ON f.doc_id = cv.doc_id""",
        "e4": f"""WITH {CV_LINES}, nb AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS i, line FROM ln WHERE line <> ''),
          pc AS (SELECT doc_id, pos, replace(item, ' ', '') AS pc FROM {_numbered('cv', 'doc_id', _postcodes('text'))}),
          hit AS (SELECT pc.doc_id, pc.pos, nb.i FROM pc JOIN nb ON nb.doc_id = pc.doc_id AND contains(upper(replace(nb.line, ' ', '')), pc.pc)),
          win AS (SELECT h.doc_id, h.pos, h.i, trim(regexp_replace(string_agg(trim(nb.line, ' ,'), ', ' ORDER BY nb.i), '\\s+', ' ', 'g')) AS a FROM hit h JOIN nb ON nb.doc_id = h.doc_id AND nb.i BETWEEN h.i - 3 AND h.i + 1 GROUP BY ALL),
          sc AS (SELECT *, 0.4 + CASE WHEN regexp_matches(a, '(?i)\\b({'|'.join(c.STREET_WORDS)})\\b') THEN 0.25 ELSE 0 END + CASE WHEN regexp_matches(a, '\\b[0-9]{{1,4}}\\b') THEN 0.15 ELSE 0 END + CASE WHEN length(a) >= 20 THEN 0.1 ELSE 0 END AS s FROM win),
          b AS (SELECT doc_id, arg_min(a, (-s, pos, i)) AS a, max(s) AS s FROM sc GROUP BY doc_id)
          SELECT cv.doc_id, b.a AS address, coalesce(round(b.s::DOUBLE, 6), 0) AS confidence, CASE WHEN b.a IS NULL THEN 'none' ELSE 'postcode_window' END AS source FROM cv LEFT JOIN b ON b.doc_id = cv.doc_id""",
        "p1": f"""WITH {CV}, a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(filename, '^(.+)\\.[^.]+$', '\\1'), '(?i)\\b(resume|cv)\\b', ' ', 'g'), '(?i)\\b(final|latest|updated)\\b', ' ', 'g'), '[_.-]+', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '\\b[0-9]+\\b', ' ', 'g') AS s FROM cv),
          w AS (SELECT doc_id, {_words('s')}[:6] AS ws FROM a),
          n AS (SELECT doc_id, len(ws) AS k, list_aggregate(list_transform(ws, lambda x: CASE WHEN upper(x) = x AND regexp_matches(x, '[A-Z]') THEN x ELSE upper(x[1]) || lower(x[2:]) END), 'string_agg', ' ') AS name FROM w)
          SELECT doc_id, CASE WHEN k >= 2 AND NOT regexp_matches(name, '[^A-Za-z\\s''’-]') THEN name END AS name, CASE WHEN k < 2 OR regexp_matches(name, '[^A-Za-z\\s''’-]') THEN 0.0::DOUBLE WHEN k <= 4 THEN 0.8::DOUBLE ELSE 0.65::DOUBLE END AS confidence FROM n""",
        "p3_tokens": f"""WITH RECURSIVE {CV}, w AS (SELECT doc_id,string_split_regex(filename, '[-_ .]+')[2] AS f, sector FROM cv),
          n AS (SELECT doc_id, concat_ws(' ', f, translate(sector, 's', 'z'), 'Of') AS a, concat_ws(' ', upper(sector[1]) || sector[2:], replace(f, 'a', 'e'), CASE WHEN doc_id % 3 = 0 THEN 'Of' END) AS b FROM w),
          t AS (SELECT doc_id, a, b, list_distinct(list_filter(string_split(a, ' '), lambda x: x <> '')) AS ta, list_distinct(list_filter(string_split(b, ' '), lambda x: x <> '')) AS tb FROM n),
          s AS (SELECT doc_id, a, b, array_to_string(list_sort(list_filter(ta, lambda x: list_contains(tb, x))), ' ') AS sect, array_to_string(list_sort(list_filter(ta, lambda x: NOT list_contains(tb, x))), ' ') AS x, array_to_string(list_sort(list_filter(tb, lambda x: NOT list_contains(ta, x))), ' ') AS y FROM t),
          bits AS (SELECT DISTINCT x, y, ((1::HUGEINT << length(x)) - 1) AS m FROM s),
          walk AS (SELECT x, y, m, m AS v, 0 AS i FROM bits UNION ALL
            SELECT x, y, m, ((v + (v & u)) | (v - (v & u))) & m, i + 1 FROM (SELECT *, list_sum(list_transform(range(length(x)), lambda k: CASE WHEN x[k + 1] = y[i + 1] THEN 1::HUGEINT << k ELSE 0 END))::HUGEINT AS u FROM walk WHERE i < length(y) AND length(x) > 0)),
          lcs AS (SELECT x, y, length(x) - bit_count(arg_max(v, i)) AS c FROM walk GROUP BY x, y, m),
          g AS (SELECT s.*, length(sect) AS n, CASE WHEN sect <> '' THEN 1 ELSE 0 END AS gap, length(s.x) AS na, length(s.y) AS nb, coalesce(c, 0) AS c FROM s LEFT JOIN lcs ON lcs.x = s.x AND lcs.y = s.y)
          SELECT doc_id, a, b, round(CASE WHEN n > 0 AND (na = 0 OR nb = 0) THEN 1 ELSE greatest(1 - (na + nb - 2 * c)::DOUBLE / (2 * n + 2 * gap + na + nb), CASE WHEN n > 0 THEN greatest(1 - (gap + na)::DOUBLE / (2 * n + gap + na), 1 - (gap + nb)::DOUBLE / (2 * n + gap + nb)) ELSE 0 END) END::DOUBLE, 6) AS ratio FROM g""",
        "p4": "WITH x AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type || ' ' || p_name), ' ')) AS b FROM part) SELECT p_partkey, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM x",
        "p5": f"SELECT p_partkey, replace(items, '|', ' ') AS merged FROM ({_first_spellings(_numbered('part', 'p_partkey', chr(34)).replace(chr(34), _words(chr(35)).replace(chr(35), 'p_name || chr(32) || upper(p_type || chr(32) || p_name)')), 'p_partkey')})",
        "l1": f"""WITH {CV_SEC}, own AS (SELECT DISTINCT doc_id FROM sec WHERE section = 'certifications'),
          pick AS (SELECT doc_id, ord, line, 'certifications' AS source FROM sec WHERE section = 'certifications' UNION ALL SELECT doc_id, no, line, 'content' FROM ln WHERE line <> '' AND doc_id NOT IN (SELECT doc_id FROM own)),
          hit AS (SELECT doc_id, ord, line AS token, source FROM pick WHERE length(line) >= 3 AND len(list_filter({_list(c.LICENCE_KEYWORDS)}, lambda k: contains(lower(line), k))) > 0),
          toks AS (SELECT DISTINCT token FROM hit), {CATALOGUE}, can AS ({_canonicalise('toks')}),
          fst AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(canonical) ORDER BY ord) AS rn FROM hit JOIN can USING (token))
          SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INT) AS ord, token AS text, canonical, confidence, source, method FROM fst WHERE rn = 1""",
        "l4": f"""WITH {CV}, dict(ord, key, text, name, conf, method) AS (VALUES {_rows([(i, x.lower(), x, x, '0.85', 'dictionary') for i, x in enumerate(c.CANONICAL_SKILLS)] + [(100 + i, v, v, k, '0.82', 'dictionary') for i, (k, v) in enumerate((k, v) for k, vs in c.SKILL_VARIANTS.items() for v in vs)])}),
          ab(ord, key, name) AS (VALUES {_rows((200 + i, k, v[0]) for i, (k, v) in enumerate(c.SKILL_ABBREVIATIONS.items()))}),
          h AS (SELECT doc_id, ord, d.text || ':' || name || ':' || conf || ':' || method AS x FROM cv JOIN dict d ON contains(lower(cv.text), d.key) UNION ALL SELECT doc_id, ord, key || ':' || name || ':0.75:abbrev' FROM cv JOIN ab ON regexp_matches(cv.text, '(?i)\\b' || key || '\\b'))
          SELECT cv.doc_id, coalesce(string_agg(x, '|' ORDER BY ord), '') AS hits FROM cv LEFT JOIN h ON h.doc_id = cv.doc_id GROUP BY cv.doc_id""",
        "l4_table": """WITH k AS (SELECT DISTINCT unnest([lower(p_type), lower(p_brand || ' ' || p_size), lower(p_name)]) AS key FROM part),
          t AS (SELECT p_partkey AS doc_id, lower('We sell ' || upper(p_name) || ' of ' || p_type || ' in ' || p_brand || ' ' || p_size || ' today') AS text FROM part)
          SELECT doc_id, count(*) AS n, string_agg(upper(key), '|' ORDER BY upper(key)) AS hits FROM t JOIN k ON contains(text, key) GROUP BY doc_id""",
        "l5": f"""WITH {CV_LINES}, u AS (SELECT DISTINCT line FROM ln WHERE line <> ''), t AS (SELECT line,
            list_filter(list_transform(string_split_regex(line, '[;,/|]+'), lambda x: trim(x)), lambda x: x <> '' AND lower(x) NOT IN ('skills', 'technical skills')) AS a,
            list_filter(list_transform(string_split_regex(line, '\\s*,\\s*'), lambda x: trim(x)), lambda x: x <> '') AS b,
            CASE WHEN contains(lower(line), ' and ') THEN list_filter(list_transform(string_split_regex(line, '(?i)\\band\\b'), lambda x: trim(x)), lambda x: x <> '') ELSE [] END AS d FROM u)
          SELECT line, coalesce(list_aggregate(list_filter(list_concat([line], list_concat(a, list_concat(b, CASE WHEN len(d) BETWEEN 2 AND 4 THEN d ELSE [] END))), lambda p: len({_words('p')}) <= 14), 'string_agg', '~'), '') AS parts FROM t""",
        "r3": f"WITH {CV_LINES} SELECT DISTINCT line FROM ln WHERE regexp_matches(line, {_q(RE_DATE)})",
        "r4": f"""WITH {CV_LINES}, u AS (SELECT DISTINCT line, regexp_extract(line, {_q(RE_DATE)}, 1) AS a, regexp_extract(line, {_q(RE_DATE)}, 2) AS b FROM ln WHERE regexp_matches(line, {_q(RE_DATE)})),
          v AS (SELECT line, lower(b) AS b, {sd} AS sd, {scf} AS sc, {ed} AS ed, {ecf} AS ec FROM u)
          SELECT line, strftime(sd, '%Y-%m') AS start_date, CASE WHEN sd IS NULL THEN NULL WHEN b IN ('present', 'current', 'now') THEN 'Current' ELSE strftime(ed, '%Y-%m') END AS end_date,
          round(CASE WHEN sd IS NULL THEN 0 WHEN b IN ('present', 'current', 'now') THEN 0.9 WHEN ed IS NULL THEN 0.7 ELSE least(0.92, 0.6 + 0.2 * sc + 0.2 * ec) END::DOUBLE, 6) AS confidence FROM v""",
        "r5": f"""WITH {CV_LINES}, u AS (SELECT DISTINCT line FROM ln WHERE line <> ''), t AS (SELECT line, list_filter(list_transform(string_split_regex(line, '\\s*\\|\\s*|\\s*-\\s*|\\s*•\\s*|\\s*,\\s*'), lambda x: trim(x)), lambda x: x <> '')[:6] AS p FROM u)
          SELECT line, p[1] AS job_title, p[2] AS employer, CASE WHEN p[1] IS NOT NULL AND len({_words('p[1]')}) <= 8 THEN 0.7::DOUBLE ELSE 0.55::DOUBLE END AS title_confidence, CASE WHEN p[2] IS NOT NULL AND len({_words('p[2]')}) <= 12 THEN 0.6::DOUBLE ELSE 0.45::DOUBLE END AS employer_confidence FROM t""",
        "r6": "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 < 2 OR o_orderdate >= DATE '1996-04-01' THEN -1 ELSE (1996 - year(o_orderdate)) * 12 + 3 - month(o_orderdate) + 1 END AS INT) AS months FROM orders",
        "r7": f"""WITH {CV_SEC}, {EXP_LINES}, {_blocks('xl')}, f AS (SELECT doc_id, list_filter(lines[:8], lambda l: regexp_matches(l, {_q(RE_DATE)}))[1] AS l FROM blocks WHERE len(lines) >= 2),
          x AS (SELECT doc_id, regexp_extract(l, {_q(RE_DATE)}, 1) AS a, regexp_extract(l, {_q(RE_DATE)}, 2) AS b FROM f WHERE l IS NOT NULL), y AS (SELECT doc_id, {sd} AS s, {ed} AS e FROM x),
          z AS (SELECT doc_id, sum((year(e) - year(s)) * 12 + month(e) - month(s) + 1) AS m FROM y WHERE e >= s GROUP BY doc_id) SELECT cv.doc_id, CAST(coalesce(m, 0) AS INT) AS months FROM cv LEFT JOIN z ON z.doc_id = cv.doc_id""",
        "a1": f"WITH {KEYWORDS} SELECT d.doc_id, coalesce(array_to_string(kws, '|'), '') AS keywords FROM documents d LEFT JOIN top ON top.doc_id = d.doc_id",
        "a2": f"""WITH RECURSIVE {KEYWORDS}, {DOC_LINES},
          nb AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS i, line, len({_words('line')}) AS n FROM dl WHERE line <> ''),
          sc AS (SELECT nb.*, len(list_filter(top.kws[:18], lambda k: contains(lower(nb.line), k))) AS s FROM nb JOIN top ON top.doc_id = nb.doc_id WHERE i <= 120 AND n >= 6),
          bs AS (SELECT doc_id, line, n, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, i) AS r FROM sc WHERE s > 0),
          fold AS (SELECT doc_id, 0 AS r, 0::BIGINT AS wc, []::VARCHAR[] AS ls FROM documents UNION ALL
            SELECT f.doc_id, b.r, CASE WHEN f.wc + b.n > 160 THEN f.wc ELSE f.wc + b.n END, CASE WHEN f.wc + b.n > 160 THEN f.ls ELSE list_append(f.ls, b.line) END FROM fold f JOIN bs b ON b.doc_id = f.doc_id AND b.r = f.r + 1 AND b.r <= 6),
          fin AS (SELECT doc_id, arg_max(ls, r) AS ls FROM fold GROUP BY doc_id)
          SELECT d.doc_id, CASE WHEN len(ls) > 0 THEN array_to_string(ls, ' ') ELSE coalesce(array_to_string({_words('d.text')}[:160], ' '), '') END AS summary FROM documents d JOIN fin ON fin.doc_id = d.doc_id""",
        "q2": f"WITH {CV_LINES} SELECT DISTINCT line, coalesce(TRY_CAST(regexp_extract(line, '(?i)\\b([0-9]{{1,2}})\\s*\\+?\\s*(?:years|yrs|year)\\b', 1) AS INT), -1) AS years FROM ln",
        "q3": f"WITH {CV_LINES}, u AS (SELECT DISTINCT line FROM ln), m AS {_numbered('u', 'line', _postcodes('line'))}, f AS ({_first_spellings('m', 'line')}) SELECT u.line, coalesce(items, '') AS postcodes FROM u LEFT JOIN f ON f.line = u.line",
        "q4": f"""WITH {CV_LINES}, u AS (SELECT DISTINCT line FROM ln), m AS (SELECT line, pos, trim(item) AS token FROM {_numbered('u', 'line', "regexp_extract_all(line, '[A-Za-z0-9][A-Za-z0-9+/& -]{1,40}')")}),
          toks AS (SELECT DISTINCT token FROM m), {CATALOGUE}, can AS ({_canonicalise('toks')}), hit AS (SELECT line, pos, canonical AS item FROM m JOIN can USING (token) WHERE method <> 'passthrough' AND confidence >= 0.7),
          f AS ({_first_spellings('hit', 'line')}) SELECT u.line, coalesce(items, '') AS skills FROM u LEFT JOIN f ON f.line = u.line""",
        "q5": f"""WITH m AS (SELECT conv_id, turn, item, min(pos) AS pos FROM {_numbered('conversations', 'conv_id, turn', "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')")} WHERE regexp_full_match(item, '[a-z0-9]{{2,}}') AND NOT list_contains({_list(c.QUERY_STOP)}, item) GROUP BY ALL),
          f AS (SELECT conv_id, turn, array_to_string(list(item ORDER BY pos)[:30], '|') AS terms FROM m GROUP BY ALL) SELECT t.conv_id, t.turn, coalesce(f.terms, '') AS terms FROM conversations t LEFT JOIN f ON f.conv_id = t.conv_id AND f.turn = t.turn""",
        "h1": TFIDF_OUT,
        "h1_fast": TFIDF_OUT,
        "h1_index": f"WITH {_term_counts('documents', _q(DOC_QUERY))} SELECT d.lang, tf.term, count(*) AS df, CAST(sum(tf.tf) AS BIGINT) AS tf FROM tf JOIN documents d ON d.doc_id = tf.doc_id WHERE term IN (SELECT term FROM tf WHERE doc_id = -1) GROUP BY ALL",
        "h10_index": " UNION ALL ".join(f"SELECT * FROM (WITH {CV}, cd AS (SELECT doc_id, text FROM cv WHERE sector IN ({', '.join(map(_q, chosen))})), {_tfidf(CV_QUERY).replace('documents', 'cd')} SELECT {_q('+'.join(chosen))} AS sectors, doc_id::VARCHAR AS file_id, round(tfidf, 6) AS tfidf FROM tfidf WHERE round(tfidf, 6) > 0)" for chosen in CHOICES),
        "h2": "SELECT a.vec_id, round(least(1, greatest(0, (list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2)), 6) AS embed FROM embeddings a, embeddings b WHERE b.vec_id = 7",
        "h3": f"SELECT doc_id, round({_overlap('text')}, 6) AS overlap FROM documents",
        "h4": "WITH x AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS held FROM part) SELECT p_partkey, round(least(1, len(list_filter(['cctv monitoring', 'order', 'access control', 'red', 'steel'], lambda s: list_contains(held, s)))::DOUBLE / 5), 6) AS bonus FROM x",
        "h5": f"WITH {CV} SELECT doc_id FROM cv WHERE {_postcodes('text')}[1] IN ('M1 0NU', 'TW2 1XB', 'M5 4AE')",
        "h6": "SELECT o_orderkey FROM orders WHERE (o_custkey % 60) / 12 + 0.01 >= 3",
        "h7": "SELECT l_orderkey, l_linenumber, round((0.45::DOUBLE * (l_orderkey % 7) / 7 + 0.35::DOUBLE * (l_orderkey % 11) / 11 + 0.1::DOUBLE * (l_orderkey % 3) / 3 + 0.1::DOUBLE * (l_orderkey % 5) / 5), 6) AS score FROM lineitem",
        "h8": f"WITH {_tfidf(DOC_QUERY)} SELECT round(0.45::DOUBLE * tfidf + 0.1::DOUBLE * {_overlap('text')}, 6) AS score, t.doc_id FROM tfidf t JOIN documents d ON d.doc_id = t.doc_id ORDER BY score DESC, t.doc_id LIMIT 20",
        "h10": f"WITH {CV} SELECT doc_id, sector FROM cv WHERE sector <> 'hospitality'",
        "s1": f"""WITH {EDGES} SELECT DISTINCT name, regexp_matches(lower(name), '^(resume|cv)([-_ ].*)?\\.(pdf|docx)$') AS ok FROM edges""",
        "s2": """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'abcd' || lpad(page_id::VARCHAR, 5, '0') WHEN 1 THEN 'zz' || lpad(page_id::VARCHAR, 8, '0') WHEN 2 THEN 'Ab' || lpad(page_id::VARCHAR, 8, '0')
          ELSE list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda p: regexp_full_match(p, '[A-Za-z0-9]{8,}'))[-1] END AS resource_id FROM pages""",
        "s3": f"WITH {ITEM} SELECT o_orderkey, o_orderkey::VARCHAR AS id, CASE WHEN k = 3 THEN '' ELSE 'n' || ck END AS name FROM it",
        "s4": f"WITH {ITEM} SELECT o_orderkey, k IN (0, 1, 4, 5) AS is_folder FROM it",
        "s5": f"WITH {ITEM} SELECT o_orderkey, k IN (2, 6) AS is_file FROM it",
        "s6": "SELECT CAST(o_orderkey // 50 AS BIGINT) AS page, CAST(count(*) AS INT) AS n_items, count(*) >= 50 AS has_more FROM orders GROUP BY ALL",
        "s7": f"""WITH RECURSIVE {EDGES}, walk AS (SELECT 'root' AS id, '' AS prefix, 0 AS depth, ['root'] AS seen UNION ALL
            SELECT e.id, w.prefix || e.name || '/', w.depth + 1, list_append(w.seen, e.id) FROM walk w JOIN edges e ON e.parent_id = w.id AND e.is_folder AND NOT list_contains(w.seen, e.id)),
          fol AS (SELECT id, arg_min(prefix, (depth, prefix)) AS prefix FROM walk GROUP BY id)
          SELECT e.id, e.name, f.prefix || e.name AS virtual_path FROM edges e JOIN fol f ON f.id = e.parent_id WHERE NOT e.is_folder AND regexp_matches(lower(e.name), '^(resume|cv)([-_ ].*)?\\.(pdf|docx)$')""",
        "s7_paged": f"""WITH RECURSIVE {EDGES}, walk AS (SELECT 'root' AS id, '' AS prefix, 0 AS depth, ['root'] AS seen UNION ALL
            SELECT e.id, w.prefix || e.name || '/', w.depth + 1, list_append(w.seen, e.id) FROM walk w JOIN edges e ON e.parent_id = w.id AND e.is_folder AND NOT list_contains(w.seen, e.id)),
          fol AS (SELECT id, arg_min(prefix, (depth, prefix)) AS prefix FROM walk GROUP BY id)
          SELECT e.id, e.name, f.prefix || e.name AS virtual_path FROM edges e JOIN fol f ON f.id = e.parent_id WHERE NOT e.is_folder AND regexp_matches(lower(e.name), '^(resume|cv)([-_ ].*)?\\.(pdf|docx)$')""",
        "o2": f"""WITH RECURSIVE {EDGES}, walk AS (SELECT r_name AS sector, 'r' || r_regionkey AS id, '' AS prefix, 0 AS depth, ['r' || r_regionkey] AS seen FROM region UNION ALL
            SELECT w.sector, e.id, w.prefix || e.name || '/', w.depth + 1, list_append(w.seen, e.id) FROM walk w JOIN edges e ON e.parent_id = w.id AND e.is_folder AND NOT list_contains(w.seen, e.id)),
          fol AS (SELECT sector, id, arg_min(prefix, (depth, prefix)) AS prefix FROM walk GROUP BY ALL)
          SELECT f.sector, 'folder00' || e.id AS id, e.name, f.prefix || e.name AS virtual_path FROM edges e JOIN fol f ON f.id = e.parent_id WHERE NOT e.is_folder AND regexp_matches(lower(e.name), '^(resume|cv)([-_ ].*)?\\.(pdf|docx)$')""",
        "s8": "SELECT item_id || chr(9) || replace(text, chr(10), ' ') AS line FROM benchmark",
        "s9": f"WITH {EDGES} SELECT id, 'https://store.example/file/' || id AS url FROM edges WHERE NOT is_folder",
        "s13": f"WITH {CV} SELECT doc_id, sector, filename AS file_name FROM cv WHERE sector IN ('security', 'hospitality')",
        "x1": "SELECT trim(regexp_replace(item_id || chr(9) || replace(text, chr(10), ' '), '[ \\t]+', ' ', 'g')) AS line, NULL::VARCHAR AS error FROM benchmark",
        "x4": "SELECT doc_id, length(regexp_replace(text, '\\P{L}', '', 'g')) < 400 AS ocr FROM documents",
        "x6": """WITH pg AS (SELECT l_orderkey, l_linenumber, l_returnflag AS f, l_partkey % 3 AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_partkey % 3) AS page, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
          l AS (SELECT l_orderkey, page, n, unnest(['flag ' || f, 'part ' || k, 'line ' || l_linenumber]) AS line, unnest([1, 2, 3]) AS p FROM pg),
          k AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, line) AS c FROM l)
          SELECT l_orderkey, coalesce(string_agg(line, '|' ORDER BY page, p) FILTER (WHERE n < 2 OR c < greatest(2, ceil(n * 0.6::DOUBLE))), '') AS lines FROM k GROUP BY l_orderkey""",
        "k1": f"WITH {CV} SELECT doc_id, sector, filename AS file_name FROM cv WHERE sector <> 'warehouse' OR doc_id % 2 = 0",
        "k2": "SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS version FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0",
        "k3": f"WITH {CV} SELECT sector, count(*) AS total_files_seen, count(*) FILTER (WHERE doc_id % 3 > 0) AS total_candidates, count(*) FILTER (WHERE doc_id % 10 = 0) AS errors FROM cv GROUP BY sector",
        "o1": f"WITH {CV} SELECT doc_id AS file_id, sector, filename AS file_name, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN 2 ELSE 1 END AS run FROM cv WHERE doc_id % 2 = 0 OR (doc_id % 3 = 0 AND doc_id % 5 <> 0)",
        "o1_stream": """WITH ch AS (SELECT o_orderkey AS file_id, o_orderstatus AS sector, o_totalprice AS price, 1 AS synced_at FROM orders
            UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice + 1, 5 FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice + 2, 3 FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'Z', o_totalprice + 3, 2 FROM orders WHERE o_orderkey % 5 = 0)
          SELECT file_id, sector, arg_max(price, synced_at) AS price, max(synced_at) AS synced_at FROM ch GROUP BY file_id, sector""",
        "k2_index": f"""WITH {CV}, last AS (SELECT text || CASE WHEN doc_id % 3 = 0 THEN ' forklift night shifts' ELSE '' END AS text FROM cv WHERE sector <> 'warehouse' AND (doc_id % 2 = 0 OR doc_id % 3 = 0) UNION ALL SELECT text FROM cv WHERE sector = 'warehouse' AND doc_id % 5 = 0),
          numbered AS (SELECT row_number() OVER () AS doc_id, text FROM last), {_term_counts('numbered', "''")} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM tf WHERE doc_id <> -1 GROUP BY term""",
        "x2": "SELECT n_nationkey, CASE WHEN n_nationkey % 5 <> 0 THEN n_name || '~' || lower(n_name) || ' & more~' || n_nationkey || ' | ' || n_name || '~' || n_nationkey * 2 END AS text, n_nationkey % 5 = 0 AS failed FROM nation",
        "x3": """WITH pg AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_partkey % 3) AS page, [l_returnflag || ' flag', 'line ' || l_linenumber, 'part ' || l_partkey % 3] AS ls FROM lineitem),
          n AS (SELECT l_orderkey, count(*) AS n FROM pg GROUP BY 1),
          l AS (SELECT l_orderkey, page, unnest(ls) AS line, unnest([1, 2, 3]) AS p FROM pg),
          k AS (SELECT l.*, n.n, count(*) OVER (PARTITION BY l.l_orderkey, line) AS c FROM l JOIN n ON n.l_orderkey = l.l_orderkey),
          t AS (SELECT l_orderkey, page, coalesce(string_agg(line, '~' ORDER BY p) FILTER (WHERE n < 2 OR c < greatest(2, ceil(n * 0.6::DOUBLE))), '') AS t FROM k GROUP BY ALL)
          SELECT l_orderkey, trim(string_agg(t, '~~' ORDER BY page), '~') AS text FROM t GROUP BY l_orderkey""",
        "s12": f"WITH {CV} SELECT doc_id, filename AS file_name, true AS missing_fails, true AS broken_fails FROM cv WHERE sector = 'security'",
        "s14": """WITH p AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
          SELECT n_nationkey, n_name[1] || lower(n_name[2:]) AS w, r_name AS canonical, 0.95::DOUBLE AS confidence, 'variant' AS method FROM p
          UNION ALL SELECT n_nationkey, lower(r_name), r_name, 0.98, 'exact' FROM p UNION ALL SELECT n_nationkey, r_name[1] || '.' || r_name[2] || '.' || r_name[3], r_name, 0.88, 'abbrev' FROM p
          UNION ALL SELECT n_nationkey, 'PLACE  ' || n_name, array_to_string(list_transform(string_split('PLACE ' || n_name, ' '), lambda x: x[1] || lower(x[2:])), ' '), 0.55, 'passthrough' FROM p""",
    }
    from cvlake.oracle_records import records_sql  # which builds on this module

    return out | records_sql(out)
