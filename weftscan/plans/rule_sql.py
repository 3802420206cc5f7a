"""SQL for the rules over any evidence that is given as common table expressions fx_<table>, to hold the DataFrame queries against."""

from __future__ import annotations

import re
from collections.abc import Callable

from weftscan.plans import rules as R

OK = "coalesce(p.status BETWEEN 200 AND 299, false)"
BAD = "coalesce(p.status IN (404, 410) OR p.status BETWEEN 500 AND 599, false)"
HTML = "contains(lower(coalesce(p.content_type, '')), 'html')"
SEEN = f"({OK} AND {HTML} AND coalesce(p.rendered, false))"
DEP = "coalesce(p.delta >= 0.8 AND coalesce(p.rendered_len, 0) - p.raw_len >= 200 AND p.raw_len + p.hidden_len <= (1 - 0.8) * coalesce(p.rendered_len, 0), false)"
PRIMARY = "('home', 'product', 'article', 'doc', 'about')"
READABLE = "(p.lang IS NULL OR regexp_split_to_array(lower(trim(p.lang)), '[-_]')[1] IN ('en', ''))"
UNDATED = "(coalesce(p.date_published, '') = '' AND coalesce(p.date_modified, '') = '')"
PATH = r"coalesce(nullif(regexp_extract({0}, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/')"
HOST = r"regexp_extract({0}, '^[a-z]+://([^/:?#]*)', 1)"
ORG = "({0}.type IN (" + ", ".join(f"'{t}'" for t in R.ORG_TYPES) + "))"
ORG_NODE = "(" + ORG.format("x") + " OR list_has_any(x.fields, ['logo', 'sameAs']))"


def types(hit: str) -> str:
    return f"coalesce(array_to_string(list_sort(list(DISTINCT p.page_type) FILTER (WHERE {hit})), ','), '')"


def addresses(hit: str) -> str:
    return f"coalesce(array_to_string((list(p.url ORDER BY p.page_seq, p.url) FILTER (WHERE {hit}))[1:{R.MOST_REFS}], ' '), '')"


def quoted(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def header_tokens(rows: str, key: str) -> str:
    """A table tokens (key, i, scope, token) of the x_robots headers of ``rows``: a scope holds until the next one."""
    return rf"""cut AS (SELECT {key}, generate_subscripts(string_split(x_robots, ','), 1) AS i, trim(unnest(string_split(x_robots, ','))) AS s FROM ({rows}) WHERE x_robots IS NOT NULL),
named AS (SELECT *, lower(trim(split_part(s, ':', 1))) AS head, CASE WHEN contains(s, ':') THEN trim(s[strpos(s, ':') + 1:]) ELSE '' END AS rest FROM cut WHERE s <> ''),
scoped AS (SELECT *, contains(s, ':') AND head NOT IN {quoted(R.COLON_DIRECTIVES)} AND rest <> '' AS is_scope FROM named),
tokens AS (SELECT {key}, i, last_value(CASE WHEN is_scope THEN head END IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY i ROWS UNBOUNDED PRECEDING) AS scope,
  regexp_replace(lower(CASE WHEN is_scope THEN rest ELSE s END), '\s*:\s*', ':', 'g') AS token FROM scoped)"""


def in_force(page: str, scopes: list[str]) -> str:
    """The header tokens of a page without a scope or with one of ``scopes``."""
    return f"coalesce((SELECT list(t.token) FROM tokens t WHERE t.site_id = {page}.site_id AND t.page_seq = {page}.page_seq AND (t.scope IS NULL OR t.scope IN {quoted(scopes)})), CAST([] AS VARCHAR[]))"


TARGET = r"(coalesce(nullif(regexp_extract({0}, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') || regexp_extract({0}, '^[^?#]*(\?[^#]*)', 1))"


def decisions(asked: str) -> str:
    """Tables asked (site_id, agent, named), rules and decided (site_id, agent, path, allowed) of the fixture's policies for agents."""
    return rf"""lines AS (SELECT *, lower(regexp_extract(trim(user_agent), '^[A-Za-z0-9_-]+')) AS token FROM fx_groups),
asked AS (SELECT DISTINCT a.site_id, a.agent, EXISTS (SELECT 1 FROM lines l WHERE l.site_id = a.site_id AND l.token = lower(a.agent)) AS named FROM ({asked}) a),
own AS (SELECT a.site_id, a.agent, l.allow, l.disallow FROM asked a JOIN lines l ON l.site_id = a.site_id AND CASE WHEN a.named THEN l.token = lower(a.agent) ELSE trim(l.user_agent) = '*' END),
rules AS (SELECT site_id, agent, true AS allow, unnest(allow) AS pattern FROM own UNION ALL SELECT site_id, agent, false, unnest(disallow) FROM own),
paths AS (SELECT DISTINCT site_id, {TARGET.format("final_url")} AS path FROM fx_pages),
held AS (SELECT o.site_id, o.agent, p.path, r.allow, r.pattern, length(r.pattern) AS n FROM (SELECT DISTINCT site_id, agent FROM own) o JOIN paths p ON p.site_id = o.site_id LEFT JOIN rules r ON r.site_id = o.site_id
  AND r.agent = o.agent AND r.pattern <> '' AND regexp_matches(p.path, '^' || replace(regexp_escape(rtrim(r.pattern, '$')), '\*', '.*') || CASE WHEN ends_with(r.pattern, '$') THEN '$' ELSE '' END)),
decided AS (SELECT site_id, agent, path, path = '/robots.txt' OR coalesce(arg_max(allow, n * 2 + allow::INT), true) AS allowed FROM held GROUP BY 1, 2, 3)"""


def _excluded(rule_id: str, named: bool) -> str:
    shut = f"SELECT site_id, agent FROM fx_agents WHERE agent IN {quoted(R.RETRIEVAL_AGENTS)} AND verdict = 'disallowed'"
    one_kind = decisions(shut).replace("FROM asked a JOIN lines", f"FROM (SELECT * FROM asked WHERE named = {str(named).lower()}) a JOIN lines")
    agg = f"""WITH {one_kind}, closed AS (SELECT DISTINCT site_id, path FROM decided WHERE NOT allowed),
    hit AS (SELECT p.site_id, count(*) AS n, count(c.path) AS hit, {types("c.path IS NOT NULL")} AS types FROM fx_pages p LEFT JOIN closed c ON c.site_id = p.site_id AND c.path = {TARGET.format("p.final_url")} GROUP BY 1)
    SELECT a.site_id, count(*) AS agents, any_value(h.n) AS n, any_value(h.hit) AS hit, any_value(h.types) AS types,
      (SELECT bool_or(r.allow AND r.pattern NOT IN ('', '/')) FROM rules r WHERE r.site_id = a.site_id) AS content
    FROM asked a LEFT JOIN hit h ON h.site_id = a.site_id WHERE a.named = {str(named).lower()} GROUP BY a.site_id"""
    return rule_sql(rule_id, "pages groups agents", agg, fired="agents > 0", assessed="robots_ok AND robots_reason = 'ok'", passed="robots_reason IN ('absent_4xx', 'not_plausibly_robots')", breadth="CASE WHEN content THEN 'section' ELSE 'site' END", importance="'primary'", affected="coalesce(hit, 0)", examined="coalesce(n, 0)", types="types", urls="origin || '/robots.txt'")


def _same_as() -> str:
    social, platform = quoted(R.SOCIAL_HOSTS), quoted(R.PLATFORM_HANDLES)
    absolute = r"regexp_matches(e, '^https?://\S+$', 'i')"
    account = rf"list_filter(list_transform(list_filter(string_split(regexp_extract(e, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')[1:3], lambda s: lower(regexp_replace(s, '^@+', ''))), lambda s: s IN {platform})[1]"
    host = r"regexp_replace(lower(regexp_extract(e, '^[A-Za-z]+://([^/:?#]*)', 1)), '^(www\.)?(m\.)?(mobile\.)?', '')"
    agg = f"""WITH x AS (SELECT p.site_id, p.page_seq, p.url, p.page_type, coalesce(split_part(s.domain, '.', 1), '') AS own, unnest(p.nodes) AS x FROM fx_pages p JOIN fx_sites s ON s.site_id = p.site_id WHERE {OK}),
    y AS (SELECT *, row_number() OVER () AS k, string_split(element_at(x.vals, 'sameAs')[1], ' | ') AS entries FROM x WHERE {ORG.format("x")} AND list_contains(x.fields, 'sameAs')),
    z AS (SELECT site_id, page_seq, url, page_type, own, k, trim(unnest(entries)) AS e FROM y WHERE entries IS NOT NULL),
    b AS (SELECT site_id, page_seq, url, page_type, k, NOT bool_or({absolute}) AS broken, bool_or({absolute}) AND bool_or({absolute} AND {host} IN {social} AND coalesce({account} <> own, false)) AS borrowed FROM z GROUP BY ALL),
    p AS (SELECT site_id, page_seq, url, page_type, bool_or(broken) AS broken, bool_or(borrowed) AS borrowed FROM b GROUP BY ALL),
    f AS (SELECT *, bool_or(broken) OVER (PARTITION BY site_id) AS any_broken FROM p)
    SELECT p.site_id, count(*) FILTER (WHERE hits) AS hit, (SELECT count(*) FROM fx_pages q WHERE q.site_id = p.site_id AND {OK.replace("p.", "q.")}) AS n_ok, {types("hits")} AS types, {addresses("hits")} AS urls
    FROM (SELECT *, CASE WHEN any_broken THEN broken ELSE borrowed END AS hits FROM f) p GROUP BY p.site_id"""
    return rule_sql("IDM-002", "pages", agg, fired="hit > 0", assessed="hit IS NOT NULL", breadth="CASE WHEN list_contains(string_split(types, ','), 'home') OR hit * 2 >= n_ok THEN 'site' ELSE 'page' END", affected="hit", examined="n_ok", types="types", urls="urls")


def _scripted() -> str:
    """Pages whose text scripts build: of the whole site, else of sections by their first segment and what their hits share, else of page types."""
    segments = f"list_filter(string_split({PATH.format('p.url')}, '/'), lambda s: s <> '')"
    cols = lambda hits: f"count(*) FILTER (WHERE {hits}) AS hit, count(*) AS members, {types(hits)} AS types, bool_and(p.raw_len < 200) FILTER (WHERE {hits}) AS bare, {addresses(hits)} AS urls"
    agg = f"""WITH c AS (SELECT p.*, {DEP} AS dep, lower(coalesce({segments}[1], '')) AS segment, list_transform({segments}[2:-2], lambda s: lower(s)) AS inn FROM fx_pages p WHERE {SEEN}),
    t AS (SELECT site_id, {cols("p.dep")}, bool_or(p.dep AND p.page_type = 'home') AS home FROM c p GROUP BY 1),
    w AS (SELECT *, hit >= 2 AND hit * 2 >= members AND (home OR contains(types, ',')) AS whole FROM t),
    r AS (SELECT c.* FROM c JOIN w ON w.site_id = c.site_id AND NOT w.whole),
    h AS (SELECT * FROM r WHERE dep AND segment <> ''),
    k AS (SELECT site_id, segment, part, count(*) AS k FROM (SELECT site_id, segment, unnest(list_distinct(inn)) AS part FROM h) GROUP BY ALL),
    shared AS (SELECT g.site_id, g.segment, coalesce(list(k.part) FILTER (WHERE k.k = g.n), CAST([] AS VARCHAR[])) AS parts FROM (SELECT site_id, segment, count(*) AS n FROM h GROUP BY ALL) g LEFT JOIN k ON k.site_id = g.site_id AND k.segment = g.segment GROUP BY 1, 2),
    sec AS (SELECT p.site_id, p.segment, {cols("p.dep")} FROM r p JOIN shared s ON s.site_id = p.site_id AND s.segment = p.segment WHERE list_has_all(p.inn, s.parts) GROUP BY 1, 2 HAVING hit >= 2 AND hit * 2 >= members),
    cov AS (SELECT DISTINCT p.site_id, p.url FROM r p JOIN shared s ON s.site_id = p.site_id AND s.segment = p.segment JOIN sec ON sec.site_id = p.site_id AND sec.segment = p.segment WHERE p.dep AND list_has_all(p.inn, s.parts)),
    l AS (SELECT r.* EXCLUDE (dep), r.dep AND v.url IS NULL AS dep FROM r LEFT JOIN cov v ON v.site_id = r.site_id AND v.url = r.url WHERE r.page_type IN {PRIMARY}),
    kind AS (SELECT p.site_id, p.page_type, {cols("p.dep")} FROM l p GROUP BY 1, 2 HAVING hit >= 1 AND (p.page_type = 'home' OR (hit >= 2 AND hit * 2 >= members))),
    g AS (SELECT site_id, 'site' AS breadth, hit, members, types, bare, urls FROM w WHERE whole UNION ALL SELECT site_id, 'section', hit, members, types, bare, urls FROM sec UNION ALL SELECT site_id, 'section', hit, members, types, bare, urls FROM kind)
    SELECT w.site_id, w.members AS n, g.breadth, g.hit, g.members, g.types, g.bare, g.urls FROM w LEFT JOIN g ON g.site_id = w.site_id"""
    return rule_sql("RND-001", "pages", agg, fired="hit IS NOT NULL", assessed="js_render AND coalesce(n, 0) >= 2", confidence="CASE WHEN bare THEN 'high' ELSE 'medium' END", breadth="breadth", importance=f"CASE WHEN list_has_any(string_split(types, ','), {list(R.PRIMARY_TYPES)}) THEN 'primary' ELSE 'secondary' END", affected="hit", examined="members", types="types", urls="urls")


def any_node(condition: str) -> str:
    return f"(coalesce(len(list_filter(p.nodes, lambda x: coalesce({condition}, false))), 0) > 0)"


def rule_sql(rule_id: str, tables: str, agg: str, *, fired: str, assessed: str = "true", passed: str = "false", confidence: str = "'high'", breadth: str = "'site'", importance: str = "'secondary'", affected: str = "0", examined: str = "0", types: str = "''", urls: str = "''") -> str:
    """The outcome of a rule for each site, from a query ``agg`` over evidence tables with a row or more for each site_id. The names between @ stand for their expressions."""
    found = "outcome = 'finding'"
    return f"""WITH @sites {tables}@,
agg AS ({agg}),
j AS (SELECT s.*, agg.* EXCLUDE (site_id) FROM fx_sites s LEFT JOIN agg ON agg.site_id = s.site_id),
o AS (SELECT *, CASE WHEN coalesce({passed}, false) THEN 'passed' WHEN NOT coalesce({assessed}, false) THEN 'not_assessed'
             WHEN coalesce({fired}, false) THEN 'finding' ELSE 'passed' END AS outcome FROM j)
SELECT site_id, '{rule_id}' AS rule_id, outcome, CASE WHEN {found} THEN {confidence} END AS confidence, CASE WHEN {found} THEN {breadth} END AS breadth,
  CASE WHEN {found} THEN {importance} END AS importance, CASE WHEN {found} THEN CAST({affected} AS BIGINT) END AS pages_affected,
  CASE WHEN {found} THEN CAST({examined} AS BIGINT) END AS pages_examined, CASE WHEN {found} THEN coalesce({types}, '') ELSE '' END AS page_types,
  CASE WHEN {found} THEN coalesce({urls}, '') ELSE '' END AS urls FROM o"""


def _templates(rule_id: str, eligible: str, hit: str, sure: str, unsure: str) -> str:
    agg = f"""SELECT p.site_id, any_value(n_primary) AS n_primary, string_agg(DISTINCT kind, ',' ORDER BY kind) AS types, sum(hit) AS hit, sum(members) AS members,
  array_to_string(list_transform(list_sort(flatten(list(urls)))[1:{R.MOST_REFS}], lambda x: x.u), ' ') AS urls FROM (
    SELECT b.site_id, n_primary, kind, hit, members, urls, CASE WHEN merged THEN '' ELSE kind END AS g FROM (
      SELECT site_id, count(*) FILTER (WHERE primary_type) AS n_primary, count(*) AS n_ok FROM flagged GROUP BY site_id) b
    LEFT JOIN (SELECT f.*, count(*) OVER (PARTITION BY site_id) >= 2 AND sum(hit) OVER (PARTITION BY site_id) * 2 >= n_ok2 AS merged FROM fired f) f USING (site_id)) p
  GROUP BY p.site_id, g"""
    with_flags = f"""SELECT p.*, p.page_type IN {PRIMARY} AS primary_type, ({eligible}) AS eligible, ({hit}) AS hits FROM fx_pages p WHERE {OK}"""
    fired = """SELECT site_id, page_type AS kind, count(*) FILTER (WHERE eligible) AS members, count(*) FILTER (WHERE eligible AND hits) AS hit,
  list({'k': page_seq, 'u': url} ORDER BY page_seq, url) FILTER (WHERE eligible AND hits) AS urls, any_value(n_ok2) AS n_ok2
  FROM (SELECT *, count(*) OVER (PARTITION BY site_id) AS n_ok2 FROM flagged) WHERE primary_type GROUP BY 1, 2
  HAVING hit > 0 AND (kind = 'home' OR (hit >= 2 AND hit * 2 >= members))"""
    body = f"WITH {header_tokens('SELECT site_id, page_seq, x_robots FROM fx_pages', 'site_id, page_seq')}, flagged AS ({with_flags}), fired AS ({fired}) {agg}"
    return rule_sql(rule_id, "pages", body, fired="types IS NOT NULL", assessed="coalesce(n_primary, 0) > 0", confidence=f"CASE WHEN hit >= 3 OR types = 'home' THEN '{sure}' ELSE '{unsure}' END", breadth="CASE WHEN contains(types, ',') THEN 'site' ELSE 'section' END", importance="'primary'", affected="hit", examined="members", types="types", urls="urls")


def _pages(columns: str, where: str = "true") -> str:
    return f"SELECT p.site_id, {columns} FROM fx_pages p JOIN fx_sites s ON s.site_id = p.site_id WHERE {where} GROUP BY p.site_id"


def _articles(rule_id: str, gate: str, hit: str) -> str:
    where = f"{OK} AND p.page_type = 'article' AND coalesce(p.type_confidence, 0) >= 0.8 AND {READABLE} AND {gate}"
    return rule_sql(rule_id, "pages", _pages(f"count(*) AS n, count(*) FILTER (WHERE {hit}) AS hit, {addresses(hit)} AS urls", where), fired="hit >= 2 AND hit * 2 >= n", assessed="coalesce(n, 0) >= 2", confidence="'medium'", breadth="'section'", affected="hit", examined="n", types="'article'", urls="urls")


def with_tables(sql: str, ctes: Callable[..., str]) -> str:
    """``sql`` with the expressions that ``ctes`` gives for the names between @."""
    return re.sub("@([a-z_ ]+)@", lambda m: ctes(*m[1].split()), sql)


def oracle(ctes: Callable[..., str]) -> dict[str, str]:
    """SQL by rule id over the evidence that ``ctes`` writes."""
    return {rule_id: with_tables(sql, ctes) for rule_id, sql in _oracle().items()}


def _oracle() -> dict[str, str]:
    out = {"ACC-001": _excluded("ACC-001", False), "ACC-008": _excluded("ACC-008", True), "IDM-002": _same_as(), "RND-001": _scripted()}
    out["ACC-002"] = rule_sql("ACC-002", "pages", _pages(f"count(*) AS n, {types('true')} AS types"), fired="robots_reason IN ('server_error', 'rate_limited')", assessed="robots_fetched AND robots_status IS NOT NULL", confidence="'low'", importance="'primary'", affected="coalesce(n, 0)", examined="coalesce(n, 0)", types="types", urls="origin || '/robots.txt'")
    meta = "list_transform(p.meta_robots, lambda x: replace(lower(trim(x)), ' ', ''))"
    noindex = f"list_has_any(list_concat({meta}, {in_force('p', R.INDEX_SCOPES)}), ['noindex', 'none'])"
    nosnippet = f"list_has_any(list_concat({meta}, {in_force('p', R.SNIPPET_SCOPES)}), ['nosnippet', 'max-snippet:0'])"
    out["ACC-003"] = _templates("ACC-003", "p.canonical IS NULL OR coalesce(p.canonical_self, false)", noindex, "high", "medium")
    out["ACC-004"] = _templates("ACC-004", f"NOT {noindex}", nosnippet, "medium", "low")
    aliases = "('/', '/index.html', '/index.php', '/home', '/default.aspx')"
    declaring = f"(p.canonical IS NOT NULL AND {PATH.format('p.final_url')} NOT IN {aliases})"
    folded = f"({declaring} AND NOT coalesce(p.canonical_self, false) AND ({HOST.format('p.canonical')} = coalesce(s.domain, {HOST.format('s.origin')}) OR ends_with({HOST.format('p.canonical')}, '.' || coalesce(s.domain, {HOST.format('s.origin')}))) AND {PATH.format('p.canonical')} = '/')"
    cols = f"count(*) AS n_ok, count(*) FILTER (WHERE {declaring}) AS declaring, count(*) FILTER (WHERE {folded}) AS hit, count(DISTINCT {PATH.format('p.final_url')}) FILTER (WHERE {folded}) AS paths, count(*) FILTER (WHERE {folded} AND p.page_type IN {PRIMARY}) AS n_primary, {types(folded)} AS types, {addresses(folded)} AS urls"
    out["ACC-005"] = rule_sql("ACC-005", "pages", _pages(cols, OK), fired="paths >= 2 AND hit * 2 >= declaring", assessed="coalesce(declaring, 0) >= 2", confidence="CASE WHEN hit >= 3 THEN 'high' ELSE 'medium' END", breadth="CASE WHEN hit * 2 >= n_ok THEN 'site' ELSE 'section' END", importance="CASE WHEN n_primary > 0 THEN 'primary' ELSE 'secondary' END", affected="hit", examined="declaring", types="types", urls="urls")
    root = f"({HOST.format('p.final_url')} = {HOST.format('s.origin')} AND {PATH.format('p.final_url')} IN {aliases})"
    cols = f"count(*) AS n, bool_or({OK} AND (p.page_type = 'home' OR {root})) AS home, count(*) FILTER (WHERE {BAD}) AS bad, count(*) FILTER (WHERE {BAD} AND p.status >= 500) AS bad5, {addresses(BAD)} AS urls"
    out["ACC-007"] = rule_sql("ACC-007", "pages", _pages(cols), fired="bad >= 2 AND bad * 10 >= n", assessed="coalesce(n, 0) >= 5 AND coalesce(home, false)", confidence="CASE WHEN bad5 > 0 THEN 'medium' ELSE 'high' END", breadth="CASE WHEN bad * 2 >= n THEN 'site' WHEN bad * 4 >= n THEN 'section' ELSE 'page' END", affected="bad", examined="n", urls="urls")
    bad = "(m.status IN (404, 410) OR m.status BETWEEN 500 AND 599 OR (m.status BETWEEN 200 AND 299 AND NOT coalesce(m.parse_ok, false)))"
    agg = f"SELECT d.site_id, count(*) AS n, count(*) FILTER (WHERE {bad}) AS bad, count(*) FILTER (WHERE {bad} AND m.status >= 500) AS bad5, array_to_string((list(d.url ORDER BY d.seq, d.url) FILTER (WHERE {bad}))[1:{R.MOST_REFS}], ' ') AS urls FROM fx_declared d JOIN fx_sites s ON s.site_id = d.site_id AND s.robots_ok JOIN fx_sitemaps m ON m.site_id = d.site_id AND m.url = d.url WHERE m.status IS NOT NULL AND m.status NOT IN (401, 403, 429) GROUP BY d.site_id"
    out["ACC-009"] = rule_sql("ACC-009", "declared sitemaps", agg, fired="bad > 0", assessed="coalesce(n, 0) > 0", confidence="CASE WHEN bad5 > 0 THEN 'medium' ELSE 'high' END", breadth="CASE WHEN bad = n THEN 'site' ELSE 'section' END", affected="bad", examined="n", urls="urls")
    refused = "(401, 403, 404, 406, 410, 451)"
    agg = f"""WITH u AS (SELECT site_id, url, max(status) FILTER (WHERE agent = 'browser-ua') AS browser, max(status) FILTER (WHERE agent = 'Googlebot') AS google,
      count(*) FILTER (WHERE agent IN ('GPTBot', 'ClaudeBot', 'PerplexityBot', 'OAI-SearchBot', 'CCBot')) AS named FROM fx_probe GROUP BY 1, 2),
    c AS (SELECT * FROM u WHERE browser BETWEEN 200 AND 299 AND named > 0),
    a AS (SELECT b.site_id, b.agent, bool_and(coalesce(b.status IN {refused}, false)) AS refused FROM fx_probe b JOIN c USING (site_id, url)
      WHERE b.agent IN ('GPTBot', 'ClaudeBot', 'PerplexityBot', 'OAI-SearchBot', 'CCBot') GROUP BY 1, 2),
    r AS (SELECT DISTINCT b.site_id, b.url, c.google FROM fx_probe b JOIN a ON a.site_id = b.site_id AND a.agent = b.agent AND a.refused JOIN c ON c.site_id = b.site_id AND c.url = b.url)
    SELECT c.site_id, count(DISTINCT c.url) AS n, count(DISTINCT r.url) AS hit, bool_and(coalesce(r.google IN {refused}, false)) FILTER (WHERE r.url IS NOT NULL) AS edge,
      array_to_string(list_sort(list(DISTINCT r.url))[1:{R.MOST_REFS}], ' ') AS urls, bool_or(r.url = s.origin || '/') AS at_home,
      (SELECT string_agg(DISTINCT p.page_type, ',' ORDER BY p.page_type) FROM fx_pages p JOIN r t ON t.site_id = p.site_id AND t.url IN (p.url, p.final_url) WHERE p.site_id = c.site_id) AS types FROM c JOIN fx_sites s ON s.site_id = c.site_id LEFT JOIN r ON r.site_id = c.site_id GROUP BY c.site_id"""
    out["ACC-006"] = rule_sql("ACC-006", "probe pages", agg, fired="hit > 0", assessed="coalesce(n, 0) > 0 AND NOT coalesce(edge, false)", confidence="'low'", breadth="CASE WHEN at_home THEN 'site' ELSE 'section' END", importance="'primary'", affected="hit", examined="n", types="types", urls="urls")
    page_html = f"({OK} AND {HTML})"
    cols = f"count(*) FILTER (WHERE {SEEN}) AS seen, count(*) FILTER (WHERE {page_html}) AS n, bool_or({page_html} AND p.page_type = 'home') AS home, bool_and(p.raw_len + p.hidden_len < 200) FILTER (WHERE {page_html}) AS thin, bool_and(coalesce(p.raw_hash = s.soft404_hash, false)) FILTER (WHERE {page_html}) AS shell, {types(page_html)} AS types, {addresses(page_html)} AS urls"
    out["RND-002"] = rule_sql("RND-002", "pages", _pages(cols), fired="thin", assessed="coalesce(seen, 0) = 0 AND coalesce(home, false)", confidence="CASE WHEN shell THEN 'high' ELSE 'medium' END", importance="'primary'", affected="n", examined="n", types="types", urls="urls")
    structured = any_node("list_has_any(x.fields, ['offers.price', 'offers.lowPrice'])")
    sign = r"(₹|\$|€|£|¥|\bRs\.?|\bINR\b|\bUSD\b|\bEUR\b|\bGBP\b|\bJPY\b)\s?\d"
    hit = f"(NOT regexp_matches(p.raw_text, '{sign}') AND NOT regexp_matches(p.raw_text, '\\d\\s?(€|£|₹|\\$|EUR\\b)') AND regexp_matches(p.rendered_text, '{sign}') AND NOT {structured})"
    where = f"{SEEN} AND p.page_type = 'product' AND coalesce(p.type_confidence, 0) >= 0.6 AND NOT {DEP} AND p.raw_text IS NOT NULL AND p.rendered_text IS NOT NULL"
    out["RND-003"] = rule_sql("RND-003", "pages", _pages(f"count(*) AS n, count(*) FILTER (WHERE {hit}) AS hit, {addresses(hit)} AS urls", where), fired="hit >= 0.6 * n", assessed="js_render AND coalesce(n, 0) >= 5", confidence="CASE WHEN n >= 8 THEN 'high' ELSE 'medium' END", breadth="'section'", importance="'primary'", affected="hit", examined="n", types="'product'", urls="urls")
    person = any_node("x.type = 'Person'")
    home = "(p.page_type = 'home')"
    cols = f"count(*) FILTER (WHERE {home}) AS homes, arg_min(p.url, p.page_seq) FILTER (WHERE {home}) AS url, arg_min(p.microdata, p.page_seq) FILTER (WHERE {home}) AS microdata, arg_min({any_node(ORG_NODE)} OR {person}, p.page_seq) FILTER (WHERE {home}) AS said, bool_or(p.page_type = 'about' AND {any_node(ORG_NODE)}) AS about"
    sub = f"(coalesce(domain, '') <> '' AND {HOST.format('origin')} NOT IN (domain, 'www.' || domain))"
    out["IDM-001"] = rule_sql("IDM-001", "pages", _pages(cols, OK), fired="true", passed="homes > 0 AND NOT microdata AND (said OR about)", assessed=f"homes > 0 AND NOT microdata AND NOT {sub}", affected="1", examined="1", types="'home'", urls="url")
    failure = any_node("NOT x.valid AND coalesce(x.type, '') = '' AND len(x.fields) = 0")
    cols = f"count(*) AS n_ok, count(*) FILTER (WHERE len(p.nodes) > 0) AS n, count(*) FILTER (WHERE {failure}) AS hit, {types(failure)} AS types, {addresses(failure)} AS urls"
    out["IDM-003"] = rule_sql("IDM-003", "pages", _pages(cols, OK), fired="hit > 0", assessed="coalesce(n, 0) > 0", breadth="CASE WHEN hit * 2 >= n_ok THEN 'site' WHEN hit >= 2 THEN 'section' ELSE 'page' END", affected="hit", examined="n", types="types", urls="urls")
    price = "x.type IN ('Product', 'ProductGroup', 'IndividualProduct', 'Offer', 'AggregateOffer') AND TRY_CAST(replace(coalesce(nullif(element_at(x.vals, 'offers.price')[1], ''), element_at(x.vals, 'price')[1]), ',', '') AS DOUBLE) > 0"
    wrong = any_node(f"{price} AND x.contradicts")
    cols = f"count(*) FILTER (WHERE {any_node(price)}) AS n, count(*) FILTER (WHERE {wrong}) AS hit, {types(wrong)} AS types, {addresses(wrong)} AS urls"
    out["IDM-004"] = rule_sql("IDM-004", "pages", _pages(cols, OK), fired="hit > 0", assessed="coalesce(n, 0) > 0", confidence="CASE WHEN hit >= 2 THEN 'high' ELSE 'medium' END", breadth="CASE WHEN hit >= 2 THEN 'section' ELSE 'page' END", importance="'primary'", affected="hit", examined="n", types="types", urls="urls")
    news = any_node("x.type IN ('NewsArticle', 'ReportageNewsArticle', 'LiveBlogPosting')")
    long_where = f"{OK} AND p.page_type IN ('article', 'doc') AND p.words >= 1500 AND NOT {news}"
    agg = f"""WITH l AS (SELECT p.*, count(*) OVER (PARTITION BY p.site_id) AS n_long FROM fx_pages p WHERE {long_where}),
    k AS (SELECT site_id, page_type, any_value(n_long) AS n_long, count(*) AS n, count(*) FILTER (WHERE n_headings < 3) AS hit, array_to_string((list(url ORDER BY page_seq, url) FILTER (WHERE n_headings < 3))[1:{R.MOST_REFS}], ' ') AS urls FROM l GROUP BY 1, 2)
    SELECT site_id, n_long, page_type, n, hit, urls FROM k WHERE hit >= 2 AND hit * 2 >= n
    UNION ALL SELECT site_id, max(n_long), NULL, NULL, NULL, NULL FROM k GROUP BY site_id HAVING NOT bool_or(hit >= 2 AND hit * 2 >= n)"""
    out["ANS-001"] = rule_sql("ANS-001", "pages", agg, fired="hit IS NOT NULL", assessed="coalesce(n_long, 0) >= 2", confidence="'medium'", breadth="'section'", affected="hit", examined="n", types="page_type", urls="urls")
    out["FRC-001"] = _articles("FRC-001", "true", f"({UNDATED} AND p.n_dates = 0)")
    agg = "SELECT h.site_id, count(*) AS n, count(*) FILTER (WHERE NOT h.matches) AS bad, arg_min(c.confidence, h.seq) FILTER (WHERE NOT h.matches) AS sure FROM fx_hits h JOIN fx_claims c ON c.site_id = h.site_id AND c.id = h.claim_id WHERE h.origin = 'wikidata.org' AND c.kind = 'founded_year' AND c.confidence IN ('high', 'medium') AND c.ambiguity <> 'high' GROUP BY h.site_id"
    out["FRC-002"] = rule_sql("FRC-002", "hits claims", agg, fired="bad > 0", assessed="egress AND attempted AND coalesce(n, 0) > 0", confidence="CASE WHEN sure = 'high' THEN 'medium' ELSE 'low' END")
    agg = f"""WITH t AS (SELECT p.site_id, p.page_type, p.url, p.ttfb - coalesce(p.connect, 0) AS ms FROM fx_pages p WHERE {OK} AND p.ttfb IS NOT NULL),
    w AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ms DESC, url) AS k FROM t WHERE ms > 1800)
    SELECT t.site_id, count(*) AS n, median(ms) AS mid, count(*) FILTER (WHERE ms > 1800) AS slow, string_agg(DISTINCT page_type, ',' ORDER BY page_type) FILTER (WHERE ms > 1800) AS types,
      (SELECT string_agg(w.url, ' ' ORDER BY k DESC) FROM w WHERE w.site_id = t.site_id AND k <= 10) AS urls FROM t GROUP BY t.site_id"""
    out["ARR-001"] = rule_sql("ARR-001", "pages", agg, fired="mid > 1800", assessed="coalesce(n, 0) >= 5", confidence="'low'", affected="slow", examined="n", types="types", urls="urls")
    agg = "SELECT site_id, any_value(status) AS status, any_value(present) AS present FROM fx_well_known WHERE path = '/llms.txt' GROUP BY site_id"
    out["PRO-001"] = rule_sql("PRO-001", "well_known", agg, fired="NOT present", assessed="status IS NOT NULL", confidence="'low'", breadth="'page'")
    agg = r"SELECT site_id, count(*) FILTER (WHERE kind = 'legal_name') AS n FROM fx_claims WHERE confidence IN ('high', 'medium') AND kind IN ('legal_name', 'founded_year', 'product_name') AND regexp_matches(coalesce(value, ''), '^[\w .,&''()/-]{1,80}$') GROUP BY site_id"
    out["PRO-002"] = rule_sql("PRO-002", "claims", agg, fired="true", assessed="coalesce(n, 0) > 0", confidence="'medium'")
    anchor = f"(p.page_type IN ('home', 'about') AND {any_node(ORG.format('x'))})"
    same_as = any_node("list_contains(x.fields, 'sameAs')")
    cols = f"count(*) AS n, arg_min(p.url, p.page_seq) FILTER (WHERE {anchor}) AS url, arg_min(p.page_type, p.page_seq) FILTER (WHERE {anchor}) AS kind, bool_or({same_as}) AS declares"
    out["PRO-003"] = rule_sql("PRO-003", "pages claims", _pages(cols, OK), fired="NOT declares", assessed="url IS NOT NULL", confidence="CASE WHEN EXISTS (SELECT 1 FROM fx_claims c WHERE c.site_id = o.site_id AND kind = 'legal_name' AND ambiguity = 'high') THEN 'high' ELSE 'medium' END", affected="1", examined="n", types="kind", urls="url")
    out["PRO-004"] = _articles("PRO-004", "p.n_dates > 0", UNDATED)
    return out


def findings(ctes: Callable[..., str]) -> str:
    """All findings from the SQL of the rules: derived, one of each kind, arbitrated and in report order."""
    from weftscan.plans import compose as K

    rank = lambda c, order: f"list_position({list(order)}, {c})"
    facts = ", ".join(f"({i}, '{r.rule_id}', '{r.skill}', '{r.category}', '{r.status}', {str(r.blocking).lower()}, '{r.effort}')" for i, r in enumerate(R.CATALOGUE.values()))
    bare = {k: re.sub("@([a-z_ ]+)@,\\n", "", sql) for k, sql in _oracle().items()}
    tables = sorted({t for sql in _oracle().values() for m in re.findall("@([a-z_ ]+)@", sql) for t in m.split()})
    outcomes = " UNION ALL ".join(f"SELECT * FROM ({sql})" for sql in bare.values())
    absence, content = f"rule_id IN {quoted(sorted(K.ABSENCE_RULES))}", f"(skill IN {quoted(sorted(K.CONTENT_SKILLS))} AND category = 'discoverability')"
    return f"""WITH {ctes(*tables)},
facts AS (SELECT * FROM (VALUES {facts}) AS t(rule_seq, rule_id, skill, category, status, blocking, effort)),
outcomes AS ({outcomes}),
d AS (SELECT o.*, f.* EXCLUDE (rule_id), greatest(CASE WHEN blocking AND breadth = 'site' AND importance = 'primary' THEN 1 WHEN blocking AND breadth <> 'page' THEN 2
    WHEN NOT blocking AND breadth = 'site' AND importance = 'primary' THEN 2 WHEN breadth <> 'page' THEN 3 ELSE 4 END,
    CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, CASE status WHEN 'proactive' THEN 3 ELSE 1 END) AS r FROM outcomes o JOIN facts f ON f.rule_id = o.rule_id WHERE outcome = 'finding'),
e AS (SELECT *, ['critical', 'high', 'medium', 'low'][r] AS severity, CASE WHEN status = 'proactive' THEN CASE effort WHEN 'high' THEN 'P3' ELSE 'P2' END WHEN r = 1 THEN 'P0'
    WHEN r = 2 THEN CASE effort WHEN 'high' THEN 'P2' ELSE 'P1' END WHEN r = 3 THEN 'P2' ELSE 'P3' END AS priority FROM d WHERE NOT (status = 'risk' AND r = 1)),
one AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY site_id, rule_id, page_types, list_sort(string_split(urls, ' ')) ORDER BY rule_seq, pages_affected DESC, breadth) = 1),
up AS (SELECT site_id, list_sort(list(DISTINCT rule_id) FILTER (WHERE rule_id = 'RND-002' OR (rule_id = 'RND-001' AND breadth = 'site'))) AS empty,
    string_agg(page_types, ',') FILTER (WHERE rule_id = 'RND-001' AND breadth <> 'site' AND page_types <> '') AS js_types, bool_or(rule_id = 'ACC-003' AND breadth = 'site') AS hidden FROM one GROUP BY site_id),
c AS (SELECT one.*, list_concat(CASE WHEN {absence} THEN coalesce(empty, []) ELSE [] END,
    CASE WHEN {absence} AND page_types <> '' AND list_has_any(string_split(page_types, ','), string_split(js_types, ',')) THEN ['RND-001'] ELSE [] END, CASE WHEN {content} AND hidden THEN ['ACC-003'] ELSE [] END) AS needs
  FROM one JOIN up ON up.site_id = one.site_id)
SELECT *, array_to_string(needs, ',') AS conditional_on, 'F-' || lpad(CAST(row_number() OVER (PARTITION BY site_id ORDER BY {rank("priority", K.PRIORITIES)}, status = 'proactive', len(needs) > 0,
  {rank("severity", K.SEVERITIES)}, {rank("effort", K.EFFORTS)}, rule_seq, page_types, urls) AS VARCHAR), 3, '0') AS id FROM c"""
