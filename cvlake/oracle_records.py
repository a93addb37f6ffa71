"""SQL for DuckDB of the queries over whole records: names, contacts, skills, roles, candidates and their ranking.

Written apart from the column expressions, over rows and windows where those fold arrays. Smaller queries' SQL is nested.
"""

from __future__ import annotations

from cvlake import config as c
from cvlake.oracle import CATALOGUE, CV, CV_LINES, CV_SEC, HEADING, KEYWORDS, RE_BULLET, RE_DATE, _blocks, _canonicalise, _first_spellings, _list, _month_year, _numbered, _phones, _postcodes, _q, _rows, _strip, _tfidf, _words
from cvlake.queries import CV_QUERY

NAME = r"[A-Za-z][A-Za-z'’-]+(?:[ \t]+[A-Za-z][A-Za-z'’-]+){1,4}"
GIVEN = rf"(?i)\bname\s*[:\-]\s*({NAME})\b"
NB = "nb AS (SELECT doc_id, rn - 1 AS ord, rn, line FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS rn, line FROM ln WHERE line <> ''))"


def _noise(x: str) -> str:
    for pattern in ("(?i)" + c.EMAIL, c.PHONE, r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/\S+", r"(?i)(?:https?://)?(?:www\.)?github\.com/\S+"):
        x = f"regexp_replace({x}, {_q(pattern)}, ' ', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _no_name(x: str) -> str:
    return f"len(list_filter({_list(c.NOT_A_NAME)}, lambda k: contains(lower({x}), k))) > 0"


def _content_names() -> str:
    fine = f"bare <> '' AND NOT {_no_name('bare')}"
    return f"""{CV_LINES}, {NB}, hd AS (SELECT doc_id, ord AS i, line, {_noise('line')} AS bare FROM nb WHERE rn <= 15),
nc AS (SELECT doc_id, 2 * i AS k, bare AS name, least(1, 0.78::DOUBLE + greatest(0, (10 - i) * 0.01::DOUBLE)) AS score FROM hd WHERE {fine} AND regexp_full_match(bare, {_q(NAME)})
  UNION ALL SELECT doc_id, 2 * i + 1, regexp_extract(line, {_q(GIVEN)}, 1), 0.88::DOUBLE FROM hd WHERE {fine} AND regexp_matches(line, {_q(GIVEN)})),
bn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, len({_words('name')}) DESC, k) AS rn FROM nc) WHERE rn = 1)"""


def _reconciled(file_names: str) -> str:
    pair = f"""pr AS (SELECT cv.doc_id, bn.name AS c, f.name AS f, coalesce(bn.score, 0) AS cc, f.confidence AS fc,
    list_distinct({_words("lower(coalesce(bn.name, ''))")}) AS cw, list_distinct({_words("lower(coalesce(f.name, ''))")}) AS fw
  FROM cv LEFT JOIN bn ON bn.doc_id = cv.doc_id JOIN fn f ON f.doc_id = cv.doc_id),
sm AS (SELECT *, CASE WHEN len(cw) > 0 AND len(fw) > 0 THEN len(list_intersect(cw, fw))::DOUBLE / len(list_distinct(list_concat(cw, fw))) ELSE 0 END AS sim FROM pr)"""
    both = _numbered("sm", "doc_id", f"list_concat({_words('c')}, {_words('f')})")
    pick = lambda *v: " ".join(f"WHEN {w} THEN {x}" for w, x in zip(("c IS NOT NULL AND f IS NULL", "f IS NOT NULL AND c IS NULL", "c IS NULL", "sim >= 0.9", "sim >= 0.75", "cc >= fc", "true"), v))
    return f"""WITH {_content_names()}, fn AS ({file_names}), {pair}, mg AS ({_first_spellings(both, 'doc_id')})
SELECT sm.doc_id, CASE {pick("c", "f", "NULL", "c", "replace(mg.items, '|', ' ')", "c", "f")} END AS full_name,
  CASE {pick("'content'", "'filename'", "'none'", "'merged'", "'merged'", "'content'", "'filename'")} END AS name_source,
  round(least(1, greatest(0, CASE {pick("cc", "fc", "0", "greatest(cc, fc) + 0.05", "greatest(cc, fc) - 0.05", "cc - 0.1", "fc - 0.1")} END))::DOUBLE, 6) AS name_confidence
FROM sm LEFT JOIN mg ON mg.doc_id = sm.doc_id"""


def _contacts() -> str:
    mail = _numbered("cv", "doc_id", r"regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')")
    phone = f"(SELECT doc_id, pos, trim(regexp_replace(item, '\\s+', ' ', 'g')) AS item FROM {_numbered('cv', 'doc_id', _phones('text'))})"
    first = lambda rows, more="": f"(SELECT doc_id, arg_min(item, pos) AS v FROM {rows} WHERE item <> '' {more} GROUP BY doc_id)"
    long = "AND length(regexp_replace(item, '[^0-9]', '', 'g')) >= 10"
    conf = lambda t, x: f"CASE WHEN {t}.v IS NULL THEN 0 ELSE {x} END::DOUBLE"
    return f"""WITH {CV} SELECT cv.doc_id, e.v AS email, {conf('e', 0.95)} AS email_confidence, p.v AS phone, {conf('p', 0.9)} AS phone_confidence, z.v AS postcode, {conf('z', 0.92)} AS postcode_confidence
FROM cv LEFT JOIN {first(mail)} e ON e.doc_id = cv.doc_id LEFT JOIN {first(phone, long)} p ON p.doc_id = cv.doc_id LEFT JOIN {first(_numbered('cv', 'doc_id', _postcodes('text')))} z ON z.doc_id = cv.doc_id"""


def _parts(x: str) -> str:
    """The list of a line and its parts."""
    cut = lambda pattern: f"list_filter(list_transform(string_split_regex({x}, {_q(pattern)}), lambda y: trim(y)), lambda y: y <> '')"
    pieces = f"list_filter({cut('[;,/|]+')}, lambda y: lower(y) NOT IN ('skills', 'technical skills'))"
    halves = cut(r"(?i)\band\b")
    joined = f"CASE WHEN contains(lower({x}), ' and ') AND len({halves}) BETWEEN 2 AND 4 THEN {halves} ELSE [] END"
    comma = cut("\\s*,\\s*")
    return f"list_filter(list_concat([trim({x})], list_concat({pieces}, list_concat({comma}, {joined}))), lambda p: len({_words('p')}) <= 14)"


SKILLS = f"""{CV_SEC},
ml AS (SELECT doc_id, CASE section WHEN 'skills' THEN 0 WHEN 'summary' THEN 1 ELSE 2 END AS grp, section, ord, line FROM sec
  WHERE section IN ('skills', 'summary') OR (section = 'experience' AND (regexp_matches(line, {_q(RE_BULLET)}) OR (len({_words('line')}) <= 12 AND length(line) >= 8)))),
mp AS (SELECT doc_id, grp, section, ord, line, unnest(ps) AS item, generate_subscripts(ps, 1) AS pos FROM (SELECT *, {_parts('bare')} AS ps FROM (SELECT *, trim(regexp_replace(line, {_q(RE_BULLET)}, '')) AS bare FROM ml))),
mf AS (SELECT doc_id, grp, section, ord, line, arg_min(trim(item), pos) AS token, min(pos) AS pos FROM mp WHERE length(item) >= 2 GROUP BY doc_id, grp, section, ord, line, lower(trim(item))),
toks AS (SELECT DISTINCT token FROM mf), {CATALOGUE}, can AS ({_canonicalise('toks')}),
mm AS (SELECT doc_id, grp, section, ord, pos, token AS text, canonical, line AS sentence, method,
  greatest(confidence, CASE grp WHEN 0 THEN CASE WHEN method IN ('exact', 'variant', 'abbrev') THEN 0.9 ELSE {0.9 - 0.1!r} END WHEN 1 THEN {0.7 - 0.1!r} ELSE {0.65 - 0.1!r} END)::DOUBLE AS confidence FROM mf JOIN can USING (token))"""
HITS = f"""dict(ord, key, text, name, conf) AS (VALUES {_rows([(i, x.lower(), x, x, 0.85) for i, x in enumerate(c.CANONICAL_SKILLS)] + [(100 + i, v, v, k, 0.82) for i, (k, v) in enumerate((k, v) for k, vs in c.SKILL_VARIANTS.items() for v in vs)])}),
short(ord, key, name) AS (VALUES {_rows((200 + i, k, v[0]) for i, (k, v) in enumerate(c.SKILL_ABBREVIATIONS.items()))}),
an AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY grp, ord, pos) AS n FROM (
  SELECT doc_id, grp, ord, pos, text, canonical, section, confidence FROM mm
  UNION ALL SELECT doc_id, 3, ord, 0, d.text, name, 'content', conf::DOUBLE FROM cv JOIN dict d ON contains(lower(cv.text), d.key)
  UNION ALL SELECT doc_id, 3, ord, 0, key, name, 'content', 0.75::DOUBLE FROM cv JOIN short ON regexp_matches(cv.text, '(?i)\\b' || key || '\\b'))),
sk AS (SELECT doc_id, list(item ORDER BY pos) AS all_skills FROM (SELECT doc_id, min(n) AS pos, arg_min(trim(canonical), n) AS item FROM an WHERE trim(canonical) <> '' GROUP BY doc_id, lower(trim(canonical))) GROUP BY doc_id)"""


def _roles(lines: str) -> str:
    """CTE ro of the blocks of lines(doc_id, ord, line): what a role is made of, and whether it is one."""
    start, sure_s = _month_year("lower(trim(a))")
    end, sure_e = _month_year("lower(trim(b))")
    open_end = "lower(b) IN ('present', 'current', 'now')"
    return f"""{_blocks(lines)},
ra AS (SELECT doc_id, block, lines AS ls, nullif(coalesce(list_position(list_transform(lines[:8], lambda l: regexp_matches(l, {_q(RE_DATE)})), true), 0), 0) AS spot FROM blocks),
rh AS (SELECT *, list_filter(list_transform(string_split_regex(trim(array_to_string(CASE WHEN spot IS NULL THEN ls[:2] ELSE ls[1:spot - 1] END, ' | ')), '\\s*\\|\\s*|\\s*-\\s*|\\s*•\\s*|\\s*,\\s*'), lambda x: trim(x)), lambda x: x <> '')[:6] AS p,
  ls[coalesce(spot, least(len(ls), 2)) + 1:] AS tail, regexp_extract(ls[spot], {_q(RE_DATE)}, 1) AS a, regexp_extract(ls[spot], {_q(RE_DATE)}, 2) AS b FROM ra),
rd AS (SELECT *, {start} AS s, {sure_s} AS ss, {end} AS e, {sure_e} AS es FROM rh),
rt AS (SELECT doc_id, block, unnest(tail) AS raw, generate_subscripts(tail, 1) AS pos FROM rd),
rc AS (SELECT doc_id, block, pos, trim(regexp_replace(raw, {_q(RE_BULLET)}, '')) AS line FROM rt),
rr AS (SELECT doc_id, block, list(item ORDER BY pos) AS resp FROM (SELECT doc_id, block, min(pos) AS pos, arg_min(line, pos) AS item FROM rc WHERE NOT {HEADING} AND length(line) >= 8 GROUP BY doc_id, block, lower(line)) GROUP BY doc_id, block),
ro AS (SELECT rd.doc_id, rd.block, len(ls) >= 2 AND (len(p) > 0 OR spot IS NOT NULL) AS ok, p[1] AS job_title, p[2] AS employer, strftime(s, '%Y-%m') AS start_date,
  CASE WHEN s IS NULL THEN NULL WHEN {open_end} THEN 'Current' ELSE strftime(e, '%Y-%m') END AS end_date,
  CASE WHEN NOT {open_end} AND e >= s THEN (year(e) - year(s)) * 12 + month(e) - month(s) + 1 END AS months, coalesce(resp, []) AS resp,
  round(0.25 * CASE WHEN p[1] IS NOT NULL AND len({_words('p[1]')}) <= 8 THEN 0.7 ELSE 0.55 END + 0.25 * CASE WHEN p[2] IS NOT NULL AND len({_words('p[2]')}) <= 12 THEN 0.6 ELSE 0.45 END + 0.3
    + 0.2 * CASE WHEN s IS NULL THEN 0 WHEN {open_end} THEN 0.9 WHEN e IS NULL THEN 0.7 ELSE least(0.92, 0.6 + 0.2 * ss + 0.2 * es) END::DOUBLE, 6) AS overall
  FROM rd LEFT JOIN rr ON rr.doc_id = rd.doc_id AND rr.block = rd.block)"""


HISTORY = f"""{CV_SEC}, {NB}, own AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS ord, line FROM sec WHERE section = 'experience'),
hl AS (SELECT * FROM own UNION ALL SELECT doc_id, ord, line FROM nb WHERE doc_id NOT IN (SELECT doc_id FROM own)), {_roles('hl')}"""


def _query(source: str) -> str:
    """CTE qp(id, raw, years_min, postcodes, skills, must_terms) of source(id, q)."""
    code = _first_spellings(_numbered("qs", "id", _postcodes("q")), "id")
    words = _numbered("qs", "id", "regexp_extract_all(lower(q), '[\\p{L}\\p{N}_]+')")
    token = _numbered("qs", "id", "regexp_extract_all(q, '[A-Za-z0-9][A-Za-z0-9+/& -]{1,40}')")
    return f"""qs AS (SELECT id, {_strip('q')} AS q FROM {source}), qc AS ({code}), qt AS (SELECT id, pos, trim(item) AS token FROM {token}),
qtoks AS (SELECT DISTINCT token FROM qt), {CATALOGUE}, qcan AS ({_canonicalise('qtoks')}),
qh AS (SELECT id, pos, canonical AS item FROM qt JOIN qcan USING (token) WHERE method <> 'passthrough' AND confidence >= 0.7), qk AS ({_first_spellings('qh', 'id')}),
qw AS (SELECT id, array_to_string(list(item ORDER BY pos)[:30], '|') AS items FROM (SELECT id, item, min(pos) AS pos FROM {words} WHERE regexp_full_match(item, '[a-z0-9]{{2,}}') AND NOT list_contains({_list(c.QUERY_STOP)}, item) GROUP BY ALL) GROUP BY id),
qp AS (SELECT qs.id, q AS raw, TRY_CAST(regexp_extract(q, '(?i)\\b([0-9]{{1,2}})\\s*\\+?\\s*(?:years|yrs|year)\\b', 1) AS INT) AS years_min, coalesce(qc.items, '') AS postcodes, coalesce(qk.items, '') AS skills, coalesce(qw.items, '') AS must_terms
  FROM qs LEFT JOIN qc ON qc.id = qs.id LEFT JOIN qk ON qk.id = qs.id LEFT JOIN qw ON qw.id = qs.id)"""


def _candidates(sql: dict[str, str]) -> str:
    """CTE ca: a row for each candidate with what searches need."""
    kept = "lambda x: x IS NOT NULL AND x <> ''"
    cv_summary = sql["a2"].replace("documents", "cv").replace("WITH RECURSIVE ", f"WITH RECURSIVE {CV}, ")
    return f"""ca AS MATERIALIZED (WITH {CV}, nm AS ({sql['p3']}), ct AS ({sql['e5']}), ad AS ({sql['e4']}), sks AS (WITH {SKILLS}, {HITS} SELECT * FROM sk),
lc AS (SELECT doc_id, count(*) AS n, list(CASE WHEN canonical <> '' THEN canonical ELSE text END ORDER BY ord) AS names FROM ({sql['l1']}) GROUP BY doc_id),
rs AS (WITH {HISTORY} SELECT doc_id, count(*) AS n, coalesce(sum(months) FILTER (WHERE months > 0), 0) AS months, flatten(list(list_concat([job_title, employer], resp) ORDER BY block)) AS said FROM ro WHERE ok GROUP BY doc_id),
{KEYWORDS.replace('documents', 'cv')}, sy AS ({cv_summary})
SELECT cv.doc_id, cv.doc_id::VARCHAR AS file_id, cv.sector, cv.filename AS file_name, coalesce(rs.months, 0) AS months, coalesce(rs.n, 0) AS n_roles, coalesce(lc.n, 0) AS n_licences,
  nm.full_name, ct.email, ct.phone, ct.postcode, coalesce(sks.all_skills, []) AS all_skills, coalesce(top.kws, []) AS kws, sy.summary,
  array_to_string(list_filter(flatten([[nm.full_name, ct.email, ct.phone, ct.postcode, ad.address], coalesce(sks.all_skills, []), coalesce(lc.names, []), coalesce(rs.said, []), coalesce(top.kws, []), [sy.summary]]), {kept}), chr(10)) AS search_text
FROM cv JOIN nm ON nm.doc_id = cv.doc_id JOIN ct ON ct.doc_id = cv.doc_id JOIN ad ON ad.doc_id = cv.doc_id JOIN sy ON sy.doc_id = cv.doc_id
  LEFT JOIN sks ON sks.doc_id = cv.doc_id LEFT JOIN lc ON lc.doc_id = cv.doc_id LEFT JOIN rs ON rs.doc_id = cv.doc_id LEFT JOIN top ON top.doc_id = cv.doc_id)"""


def _ranked(sql: dict[str, str], query: str, top_k: int, min_score: float = -1.0) -> str:
    """CTE rk: the best candidates for a query, in order of place."""
    split = lambda x: f"list_filter(string_split({x}, '|'), lambda y: y <> '')"
    hits = "len(list_filter(terms, lambda t: contains(lower(search_text), t)))"
    held = "len(list_filter(asked, lambda s: list_contains(list_transform(all_skills, lambda h: lower(h)), lower(s))))"
    return f"""WITH {_candidates(sql)}, cd AS (SELECT doc_id, search_text AS text FROM ca), {_tfidf(query).replace('documents', 'cd')}, one(id, q) AS (VALUES (0, {_q(query)})), {_query('one')},
ask AS (SELECT years_min, skills, {split('postcodes')} AS codes, {split('skills')} AS asked, {split('must_terms')} AS terms FROM qp),
pt AS (SELECT ca.*, tfidf, skills AS query_skills, CASE WHEN len(terms) > 0 THEN least(1, {hits}::DOUBLE / greatest(6, len(terms))) ELSE 0 END AS overlap, CASE WHEN len(asked) > 0 THEN least(1, {held}::DOUBLE / greatest(2, len(asked))) ELSE 0 END AS bonus
  FROM ca JOIN tfidf ON tfidf.doc_id = ca.doc_id, ask WHERE (len(codes) = 0 OR list_contains(codes, postcode)) AND (years_min IS NULL OR months / 12.0::DOUBLE + 0.01::DOUBLE >= years_min)),
sx AS (SELECT *, 0.45::DOUBLE * tfidf + 0.1::DOUBLE * overlap + 0.1::DOUBLE * bonus AS score FROM pt),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, list_position({_list(c.CONFIG.sectors)}, sector), lower(file_name), file_id) AS place FROM sx WHERE score >= {min_score}) WHERE place <= {top_k})"""


def records_sql(sql: dict[str, str]) -> dict[str, str]:
    """The SQL of the queries over whole records, given that of the smaller ones."""
    parts = _words("replace(line, '.', '')")
    out = {
        "p6": f"""WITH {CV_LINES} SELECT line, {_noise('line')} AS bare, line <> '' AND NOT {_no_name('line')} AND length(line) <= 60 AND NOT regexp_matches(line, '[^A-Za-z\\s''’\\-.]') AND len({parts}) BETWEEN 2 AND 5 AND len(list_filter({parts}, lambda p: length(p) = 1)) < 2 AS plausible FROM (SELECT DISTINCT line FROM ln)""",
        "p2": f"WITH {_content_names()} SELECT cv.doc_id, bn.name, round(coalesce(bn.score, 0), 6) AS confidence FROM cv LEFT JOIN bn ON bn.doc_id = cv.doc_id",
        "p3": _reconciled(sql["p1"]),
        "e5": _contacts(),
        "l3": f"WITH {SKILLS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord, pos) - 1 AS INT) AS ord, text, canonical, sentence, round(confidence, 6) AS confidence, method FROM mm WHERE grp = 0",
        "l2": f"""WITH {SKILLS}, {HITS}, mt AS (SELECT doc_id, CAST(count(*) AS INT) AS n, string_agg(canonical || ':' || text || ':' || section || ':' || round(confidence, 4)::VARCHAR, '|' ORDER BY confidence DESC, n) AS mentions
            FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(canonical), lower(text), lower(section) ORDER BY n) AS rn FROM an) WHERE rn = 1 GROUP BY doc_id)
          SELECT cv.doc_id, coalesce(array_to_string(all_skills, '|'), '') AS all_skills, coalesce(mt.n, 0) AS n_mentions, coalesce(mentions, '') AS mentions FROM cv LEFT JOIN sk ON sk.doc_id = cv.doc_id LEFT JOIN mt ON mt.doc_id = cv.doc_id""",
        "r1": f"WITH {HISTORY} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS INT) AS ord, job_title, employer, start_date, end_date, CAST(months AS INT) AS duration_months, array_to_string(resp, '|') AS responsibilities, overall FROM ro WHERE ok",
        "r2": f"WITH {CV_LINES}, {NB}, {_roles('nb')} SELECT doc_id, CAST(block AS INT) AS block, CASE WHEN ok THEN job_title END AS job_title, CASE WHEN ok THEN employer END AS employer, CASE WHEN ok THEN start_date END AS start_date, CASE WHEN ok THEN end_date END AS end_date FROM ro",
        "q1": f"WITH {CV}, src AS (SELECT doc_id AS id, '  ' || replace(text[:180], chr(10), ',') || ' forklift, CCTV, ' || doc_id % 30 || '+ yrs ' AS q FROM cv), {_query('src')} SELECT CAST(id AS INT) AS id, raw, years_min, postcodes, skills, must_terms FROM qp",
        "x5": """WITH RECURSIVE w AS (SELECT l_orderkey, l_returnflag || '-' || l_partkey AS text, l_linenumber * 1.5::DOUBLE AS top, l_suppkey % 50 AS x0 FROM lineitem),
          o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(top, 1), x0, text) AS r FROM w),
          f AS (SELECT l_orderkey, r, top AS start, 1 AS no FROM o WHERE r = 1 UNION ALL
            SELECT o.l_orderkey, o.r, CASE WHEN abs(o.top - f.start) > 2 THEN o.top ELSE f.start END, CASE WHEN abs(o.top - f.start) > 2 THEN f.no + 1 ELSE f.no END FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.r = f.r + 1),
          l AS (SELECT o.l_orderkey, f.no, string_agg(o.text, ' ' ORDER BY o.r) AS line FROM o JOIN f ON f.l_orderkey = o.l_orderkey AND f.r = o.r GROUP BY ALL)
          SELECT l_orderkey, string_agg(line, '|' ORDER BY no) AS lines FROM l GROUP BY l_orderkey""",
    }
    sql = sql | out
    ranked = _ranked(sql, CV_QUERY, 20)
    skills = lambda n: f"array_to_string(all_skills[:{n}], ', ') AS top_skills"
    years = "round(months / 12.0::DOUBLE, 2)"
    return out | {
        "a3": f"WITH {_candidates(sql)} SELECT file_id, search_text FROM ca",
        "a4": f"WITH {_candidates(sql)} SELECT doc_id, full_name, email, postcode, CAST(len(all_skills) AS INT) AS n_skills, CAST(n_roles AS INT) AS n_roles, CAST(n_licences AS INT) AS n_licences, array_to_string(kws, '|') AS keywords FROM ca",
        "h8_full": f"{ranked} SELECT file_id, round(score, 6) AS score FROM rk",
        "h8_index": f"{ranked} SELECT file_id, round(score, 6) AS score FROM rk",
        "h9": f"{ranked} SELECT file_id, round(tfidf, 6) AS tfidf, 0::DOUBLE AS embed, round(overlap, 6)::DOUBLE AS overlap, bonus::DOUBLE AS skill_bonus, {years} AS years, postcode, query_skills FROM rk",
        "h11": f"{_ranked(sql, 'forklift, customer service', 25, 0.1)} SELECT file_id, round(score, 6) AS score FROM rk",
        "h12": f"{_ranked(sql, CV_QUERY, 20, 0.05)} SELECT round(score, 4) AS score, sector, full_name AS name, email, phone, postcode, {years} AS years_est, {skills(12)}, file_name AS file, '/file/' || file_id AS resume_url FROM rk",
        "h13": f"{ranked} SELECT coalesce(full_name, file_name) AS name, round(score, 3) AS score, sector, '/file/' || file_id AS resume_url, {skills(25)}, summary FROM rk WHERE place <= 10",
    }
