"""The registered queries once more, in DuckDB's SQL over the same tables."""

from __future__ import annotations

from usemeter.config import BACKBONE_COLOURS, TAG_COLOURS
from usemeter.functions.text import BLANKS
from usemeter.plans.inputs import CORPUS_SPEC

ORACLE: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_contains(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


STRIP_CHARS = quoted(BLANKS)

# --- repo = customer -----------------------------------------------------------------

CUSTOMER_DEFINITIONS = """
li AS (
  SELECT l_orderkey, count(*) AS nodes, bool_or(l_returnflag = 'A') AS has_agent,
         bool_or(l_linestatus = 'O') AS has_llm,
         count(*) FILTER (WHERE l_returnflag = 'R') AS tools
  FROM lineitem GROUP BY 1),
defs AS (
  SELECT o_custkey AS repo_key, 'order ' || o_orderkey AS name, o_orderstatus = 'F' AS called,
         coalesce(nodes, 0) AS nodes, coalesce(has_agent, false) AS has_agent,
         coalesce(has_llm, false) AS has_llm, coalesce(tools, 0) AS tools
  FROM orders LEFT JOIN li ON o_orderkey = l_orderkey),
rolled AS (
  SELECT repo_key, count(*) AS total, count(*) FILTER (WHERE called) AS ncalled,
         bool_or(called AND (has_agent OR has_llm)) AS runs,
         sum(CASE WHEN NOT called THEN -1.0::DOUBLE
             ELSE 2.0::DOUBLE + CASE WHEN has_agent THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
               + CASE WHEN nodes >= 9 THEN 1.0::DOUBLE WHEN nodes >= 4 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END
               + CASE WHEN has_llm OR tools > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END END) AS points
  FROM defs GROUP BY 1)"""


def facts(suffix: str = "", where: str = "true") -> str:
    return f"""
ev{suffix} AS (
  SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS callsites,
         count(DISTINCT event_type) AS spread, bool_or(event_type = 'signup') AS hosted,
         bool_or(event_type = 'error') AS competing
  FROM events WHERE {where} GROUP BY 1),
facts{suffix} AS (
  SELECT c_custkey AS repo_key, c_mktsegment IN ('BUILDING', 'MACHINERY') AS dependency,
         coalesce(callsites, 0) AS callsites, coalesce(spread, 0) AS spread,
         coalesce(hosted, false) AS hosted, coalesce(competing, false) AS competing
  FROM customer LEFT JOIN ev{suffix} ON user_id = c_custkey),
scored{suffix} AS (
  SELECT repo_key, coalesce(ncalled, 0) AS pipelines_called, coalesce(total, 0) AS pipelines_total,
         greatest(0.0::DOUBLE, coalesce(points, 0.0::DOUBLE)
           + CASE WHEN dependency THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
           + CASE WHEN hosted THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
           + CASE WHEN callsites >= 3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END
           + CASE WHEN spread >= 2 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS score,
         CASE WHEN NOT (coalesce(runs, false) OR hosted) THEN 'No'
              WHEN competing THEN 'Partial' ELSE 'Yes' END AS raw
  FROM facts{suffix} LEFT JOIN rolled USING (repo_key)),
tagged{suffix} AS (
  SELECT *, CASE WHEN score >= 4 AND raw <> 'No' THEN 'Significant' WHEN score >= 2 THEN 'Moderate'
                 WHEN score >= 1 THEN 'Less' ELSE 'None' END AS tag FROM scored{suffix}),
verdicts{suffix} AS (
  SELECT repo_key, tag, CASE WHEN tag IN ('None', 'Less') THEN 'No' ELSE raw END AS backbone, score,
         pipelines_called, pipelines_total FROM tagged{suffix})"""


VERDICTS = f"WITH {CUSTOMER_DEFINITIONS}, {facts()}"

ORACLE["evaluate_score"] = f"{VERDICTS} SELECT * FROM verdicts"

ORACLE["given_layers"] = f"""{VERDICTS}
SELECT repo_key, CASE WHEN repo_key % 3 > 0 AND repo_key % 2 = 0 THEN 'acme' ELSE 'none' END AS ingest, 'none' AS retrieval,
       CASE WHEN backbone IN ('Yes', 'Partial') THEN 'acme' ELSE 'none' END AS orchestration,
       CASE WHEN repo_key % 3 > 0 AND repo_key % 5 = 0 THEN 'other' WHEN backbone = 'Yes' THEN 'acme'
            WHEN backbone = 'Partial' THEN 'other' ELSE 'none' END AS reasoning, 'none' AS output
FROM verdicts"""

ORACLE["score_breakdown"] = f"""{VERDICTS}
SELECT repo_key, 0::BIGINT AS part, '' AS name, 'dependency in manifest' AS signal, 1.0::DOUBLE AS points
FROM facts WHERE dependency
UNION ALL SELECT repo_key, 1, name, 'pipeline called: ' || name, 2.0::DOUBLE FROM defs WHERE called
UNION ALL SELECT repo_key, 1, name, 'agent node in ' || name, 1.0::DOUBLE FROM defs WHERE called AND has_agent
UNION ALL SELECT repo_key, 1, name, 'complexity high (' || nodes || ' nodes)', 1.0::DOUBLE
FROM defs WHERE called AND nodes >= 9
UNION ALL SELECT repo_key, 1, name, 'complexity mid (' || nodes || ' nodes)', 0.5::DOUBLE
FROM defs WHERE called AND nodes BETWEEN 4 AND 8
UNION ALL SELECT repo_key, 1, name, 'tool/llm node in ' || name, 0.5::DOUBLE
FROM defs WHERE called AND (has_llm OR tools > 0)
UNION ALL SELECT repo_key, 1, name, 'PENALTY pipeline never called: ' || name, -1.0::DOUBLE
FROM defs WHERE NOT called
UNION ALL SELECT repo_key, 2, '', 'hosted-pipeline usage', 1.0::DOUBLE FROM facts WHERE hosted
UNION ALL SELECT repo_key, 2, '', 'SDK call-sites (' || callsites || ')', 0.5::DOUBLE
FROM facts WHERE callsites >= 3
UNION ALL SELECT repo_key, 2, '', 'SDK spread (' || spread || ' files)', 0.5::DOUBLE
FROM facts WHERE spread >= 2"""

ORACLE["verdict_summary"] = f"""{VERDICTS},
grouped AS (SELECT *, CASE WHEN pipelines_total > 0 THEN backbone ELSE 'review' END AS review_group
            FROM verdicts)
SELECT CASE WHEN grouping(tag) = 0 THEN 'tag' WHEN grouping(backbone) = 0 THEN 'backbone'
            ELSE 'review_group' END AS facet,
       coalesce(tag, backbone, review_group) AS value, count(*) AS n
FROM grouped GROUP BY GROUPING SETS ((tag), (backbone), (review_group))"""

EXPECTED = f"""{VERDICTS},
want AS (
  SELECT repo_key, CASE WHEN repo_key % 10 = 3 THEN 'Less' ELSE tag END AS w_tag,
         CASE WHEN repo_key % 7 <> 2 THEN backbone END AS w_backbone,
         CASE WHEN repo_key % 5 = 1 THEN score + 0.5::DOUBLE ELSE score END AS w_score FROM verdicts),
diffs AS (
  SELECT repo_key, 'tag' AS field, w_tag AS expected, tag AS actual
  FROM want JOIN verdicts USING (repo_key) WHERE w_tag IS NOT NULL AND w_tag IS DISTINCT FROM tag
  UNION ALL SELECT repo_key, 'backbone', w_backbone, backbone
  FROM want JOIN verdicts USING (repo_key)
  WHERE w_backbone IS NOT NULL AND w_backbone IS DISTINCT FROM backbone
  UNION ALL SELECT repo_key, 'score', w_score::VARCHAR, score::VARCHAR
  FROM want JOIN verdicts USING (repo_key) WHERE w_score IS DISTINCT FROM score)"""

ORACLE["expected_diff"] = f"{EXPECTED} SELECT * FROM diffs"
ORACLE["case_tally"] = f"""{EXPECTED}
SELECT count(*) FILTER (WHERE repo_key NOT IN (SELECT repo_key FROM diffs)) AS passed,
       count(*) FILTER (WHERE repo_key IN (SELECT repo_key FROM diffs)) AS failed FROM want"""

ORACLE["verdict_drift"] = f"""
WITH {CUSTOMER_DEFINITIONS}, {facts("_a", "ts < TIMESTAMP '2024-01-16 00:00:00'")},
{facts("_b", "ts >= TIMESTAMP '2024-01-16 00:00:00'")}
SELECT repo_key, a.tag AS before, b.tag AS after
FROM verdicts_a a JOIN verdicts_b b USING (repo_key) WHERE a.tag IS DISTINCT FROM b.tag"""

ORACLE["timing_stats"] = """
SELECT round(avg(value), 6) AS avg_seconds, max(value) AS max_seconds, count(*) AS n
FROM events WHERE value <> 0"""

# --- signals -----------------------------------------------------------------------------

ORACLE["definition_metrics"] = """
WITH made AS (
  SELECT *, l_quantity NOT IN (1, 2) AS ok,
         list_transform(range(1, l_linenumber + l_partkey % 6 + 1), lambda i:
           ['agent_x', 'llm_y', 'tool_z', 'webhook', 'memory_m'][(i * i + l_suppkey) % 5 + 1]) AS p
  FROM lineitem)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, l_quantity,
       CASE WHEN ok THEN len(p)::BIGINT END AS nodes,
       CASE WHEN ok AND len(p) >= 9 THEN 'high' WHEN ok AND len(p) >= 4 THEN 'medium' ELSE 'low' END AS band,
       CASE WHEN ok THEN list_contains(p, 'agent_x') END AS has_agent,
       CASE WHEN ok THEN list_contains(p, 'llm_y') END AS has_llm,
       CASE WHEN ok THEN len(list_filter(p, lambda x: x = 'tool_z'))::BIGINT END AS tool_count,
       CASE WHEN ok THEN array_to_string(p, '|') END AS providers,
       CASE WHEN ok THEN l_returnflag END AS project_id
FROM made"""


def word_starts(text: str, words) -> str:
    """Words (Unicode letters, marks, digits, connectors) that begin with one of the tokens."""
    runs = rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+')"
    test = " OR ".join(f"starts_with(w, {quoted(w)})" for w in words)
    return f"len(list_filter({runs}, lambda w: {test}))::BIGINT"


S = CORPUS_SPEC
CALLS = word_starts("text", S.call_tokens)
IMPORTS = any_contains("lower(text)", S.import_markers)
HOSTED = any_contains("lower(text)", S.hosted_markers)
ENGINE = any_contains("lower(text)", S.engine_markers)

ORACLE["sdk_activity"] = f"""
WITH f AS (SELECT source, {CALLS} AS calls, {IMPORTS} AS imports, {HOSTED} AS hosted,
                  {ENGINE} AS engine FROM documents)
SELECT source AS repo_key, sum(calls)::BIGINT AS callsites,
       count(*) FILTER (WHERE calls > 0 OR imports) AS file_spread,
       bool_or(hosted) AS hosted, bool_or(engine) AS engine
FROM f GROUP BY 1"""

ORACLE["dependency_lines"] = f"""
SELECT doc_id, line_no, trim(line, {STRIP_CHARS}) AS line
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)
WHERE contains(lower(line), 'license')"""

WORDS = "(VALUES " + ", ".join(f"({quoted(w)})" for w in S.platforms) + ") AS v(p)"

ORACLE["platform_dictionary"] = f"""
SELECT source AS repo_key, string_agg(DISTINCT p, ', ' ORDER BY p) AS platforms
FROM documents JOIN {WORDS} ON contains(lower(text), p) GROUP BY 1"""

PATTERNS = (
    "(VALUES " + ", ".join(f"({i}, {quoted(w)})" for i, w in enumerate(S.source_patterns, 1))
    + ") AS v(pattern_no, pattern)"
)

ORACLE["source_patterns"] = f"""
SELECT source, rank, doc_id, pattern FROM (
  SELECT source, doc_id, pattern,
         row_number() OVER (PARTITION BY source ORDER BY doc_id, pattern_no) AS rank
  FROM documents JOIN {PATTERNS} ON contains(lower(text), pattern))
WHERE rank <= 20"""

ORACLE["source_selection"] = """
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS repo_key,
                  regexp_extract(url, '^https?://[^/]+/(.*)$', 1) AS path FROM pages),
k AS (SELECT *, CASE WHEN path LIKE '%#top' THEN 'definition' WHEN path LIKE '%.html' THEN 'source' END AS kind
      FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY repo_key, kind ORDER BY
        (kind = 'source' AND (contains(lower(path), 'en/') OR contains(lower(path), 'fr/'))) DESC,
        page_id) AS rank FROM k WHERE kind IS NOT NULL)
SELECT repo_key, kind, path, rank FROM r
WHERE rank <= CASE kind WHEN 'definition' THEN 12 ELSE 28 END"""

# --- documents as a corpus ----------------------------------------------------------------

CORPUS = f"""
docs AS (
  SELECT *, source || '/r' || (doc_id // 2000) AS repo_key, (doc_id // 20) % 10 AS d,
         regexp_extract(text, '[a-z]{{0,4}}tion') AS word FROM documents),
paths AS (
  SELECT *, CASE WHEN d < 2 THEN 'definition' WHEN d = 2 THEN 'manifest' WHEN d < 9 THEN 'source' END AS kind,
         CASE WHEN d < 2 THEN 'pipelines/' || doc_id || '/' || CASE WHEN word = '' THEN 'none.tion' ELSE word END
              WHEN d = 2 THEN 'lib/' || doc_id || '/package.json'
              WHEN d < 9 THEN CASE WHEN lang = 'en' THEN 'src/api/' ELSE 'src/' END || doc_id || '.py'
              WHEN lang = 'de' THEN 'p' || doc_id || '/.claude/rules/license.md'
              ELSE 'docs/' || doc_id || '.md' END AS path
  FROM docs),
repos AS (
  SELECT repo_key, CASE WHEN split_part(repo_key, '/', 1) = 'src19' THEN 404 ELSE 200 END AS status,
         CASE WHEN split_part(repo_key, '/', 1) = 'src18' THEN 409 ELSE 200 END AS tree_status,
         split_part(repo_key, '/', 1) = 'src17' AS truncated,
         count(*) AS file_count, bool_or(d = 9 AND lang = 'de') AS scaffold,
         bool_or(d < 2) AS folder
  FROM docs GROUP BY 1),
opened AS (SELECT repo_key FROM repos WHERE status = 200 AND tree_status = 200),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY repo_key, kind
           ORDER BY (kind = 'source' AND lang = 'en') DESC, doc_id) AS rk
  FROM paths SEMI JOIN opened USING (repo_key) WHERE kind IS NOT NULL),
defs AS (
  SELECT repo_key, rk, path, lower(split_part(path, '/', 3)) AS base, n_chars % 17 <> 0 AS ok,
         CASE WHEN n_chars % 17 <> 0 THEN n_chars % 13 ELSE 0 END AS nodes,
         list_transform(range(1, n_chars % 13 + 1), lambda i: (i + doc_id) % 4) AS p
  FROM ranked WHERE kind = 'definition'),
manifests AS (
  SELECT repo_key, bool_or(contains(lower(text), 'license')) AS dependency
  FROM ranked WHERE kind = 'manifest' GROUP BY 1),
sources AS (SELECT repo_key, rk, path, text FROM ranked WHERE kind = 'source'),
platforms AS (
  SELECT repo_key, list(DISTINCT p ORDER BY p) AS other
  FROM (SELECT repo_key, text FROM sources
        UNION ALL SELECT repo_key, text FROM ranked WHERE kind = 'manifest') t
  JOIN {WORDS} ON contains(lower(text), p) GROUP BY 1),
sdk AS (
  SELECT repo_key, sum(calls)::BIGINT AS callsites,
         count(*) FILTER (WHERE calls > 0 OR imports) AS spread,
         bool_or(hosted) AS hosted, bool_or(engine) AS engine
  FROM (SELECT repo_key, {CALLS} AS calls, {IMPORTS} AS imports, {HOSTED} AS hosted,
               {ENGINE} AS engine FROM sources) GROUP BY 1),
callers AS (
  SELECT * FROM sources WHERE contains(lower(text), 'tion')
  AND {any_contains("lower(text)", S.call_strings)}),
first_caller AS (
  SELECT f.repo_key, f.rk, min(c.rk) AS crk FROM defs f JOIN callers c
  ON f.repo_key = c.repo_key AND contains(lower(c.text), f.base) GROUP BY 1, 2),
site_lines AS (
  SELECT f.repo_key, f.rk, f.path, c.path AS file, f.base,
         unnest(string_split(c.text, chr(10))) AS raw,
         unnest(range(1, len(string_split(c.text, chr(10))) + 1)) AS line
  FROM defs f JOIN first_caller x USING (repo_key, rk)
  JOIN callers c ON c.repo_key = x.repo_key AND c.rk = x.crk),
sites AS (
  SELECT *, left(trim(raw, {STRIP_CHARS}), 110) AS snippet FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_key, rk ORDER BY line) AS n FROM site_lines
    WHERE contains(lower(raw), base) OR {any_contains("lower(raw)", S.call_strings)})),
site_lists AS (
  SELECT repo_key, rk, count(*) AS n_sites, min(file) AS file,
         string_agg(file || ':' || line, '; ' ORDER BY n) FILTER (WHERE n <= 3) AS shown
  FROM sites GROUP BY 1, 2),
pipes AS (
  SELECT repo_key, rk, path, ok, nodes, crk IS NOT NULL AS called, file,
         coalesce(n_sites, 0) AS n_sites, coalesce(shown, '') AS shown,
         ok AND list_contains(p, 0) AS has_agent, ok AND list_contains(p, 1) AS has_llm,
         ok AND list_contains(p, 2) AS has_tool
  FROM defs LEFT JOIN first_caller USING (repo_key, rk) LEFT JOIN site_lists USING (repo_key, rk)),
evidence AS (
  SELECT repo_key, status = 200 AS accessible, status = 200 AND tree_status <> 200 AS fetch_incomplete,
         status, CASE WHEN status = 200 AND tree_status <> 200
                      THEN 'tree fetch failed (HTTP ' || tree_status || ')' END AS note,
         CASE WHEN repo_key IN (FROM opened) THEN file_count ELSE 0 END AS file_count,
         coalesce(dependency, false) AS dependency,
         scaffold AND repo_key IN (FROM opened) AND NOT coalesce(dependency, false)
           AND repo_key NOT IN (SELECT repo_key FROM defs) AS scaffold_only,
         coalesce(other, []) AS other, coalesce(callsites, 0) AS callsites,
         coalesce(spread, 0) AS spread, coalesce(hosted, false) AS hosted,
         coalesce(engine, false) AS engine, tree_status, truncated, folder, scaffold
  FROM repos LEFT JOIN manifests USING (repo_key) LEFT JOIN platforms USING (repo_key)
  LEFT JOIN sdk USING (repo_key))"""

ORACLE["evidence_assembly"] = f"""WITH {CORPUS}
SELECT repo_key, accessible, fetch_incomplete, status::BIGINT AS status, note, file_count, dependency,
       scaffold_only, array_to_string(other, ',') AS other_platforms, callsites,
       spread AS file_spread, hosted, engine,
       (SELECT count(*) FROM defs WHERE defs.repo_key = evidence.repo_key) AS definitions
FROM evidence"""

ORACLE["call_verification"] = f"""WITH {CORPUS}
SELECT repo_key, path, called, file AS caller, n_sites FROM pipes"""

ORACLE["call_sites"] = f"""WITH {CORPUS}
SELECT repo_key, path, file, line, snippet FROM sites"""

BREAKDOWN = f"""{CORPUS},
parts AS (
  SELECT repo_key, 0 AS a, 0 AS b, 0 AS c, 'dependency in manifest' AS signal, 1.0::DOUBLE AS points
  FROM evidence WHERE dependency
  UNION ALL SELECT repo_key, 1, rk, 0, 'pipeline called: ' || path, 2.0::DOUBLE FROM pipes WHERE called
  UNION ALL SELECT repo_key, 1, rk, 1, 'agent node in ' || path, 1.0::DOUBLE FROM pipes WHERE called AND has_agent
  UNION ALL SELECT repo_key, 1, rk, 2, 'complexity high (' || nodes || ' nodes)', 1.0::DOUBLE
  FROM pipes WHERE called AND nodes >= 9
  UNION ALL SELECT repo_key, 1, rk, 2, 'complexity mid (' || nodes || ' nodes)', 0.5::DOUBLE
  FROM pipes WHERE called AND nodes BETWEEN 4 AND 8
  UNION ALL SELECT repo_key, 1, rk, 3, 'tool/llm node in ' || path, 0.5::DOUBLE
  FROM pipes WHERE called AND (has_llm OR has_tool)
  UNION ALL SELECT repo_key, 1, rk, 4, 'PENALTY pipeline never called: ' || path, -1.0::DOUBLE
  FROM pipes WHERE NOT called
  UNION ALL SELECT repo_key, 2, 0, 0, 'hosted-pipeline usage', 1.0::DOUBLE FROM evidence WHERE hosted
  UNION ALL SELECT repo_key, 2, 0, 1, 'SDK call-sites (' || callsites || ')', 0.5::DOUBLE
  FROM evidence WHERE callsites >= 3
  UNION ALL SELECT repo_key, 2, 0, 2, 'SDK spread (' || spread || ' files)', 0.5::DOUBLE
  FROM evidence WHERE spread >= 2),
summed AS (
  SELECT repo_key, sum(points) AS points, count(*) AS n_parts,
         string_agg(signal || '=' || printf('%.1f', points), '|' ORDER BY a, b, c) AS breakdown
  FROM parts GROUP BY 1),
counted AS (
  SELECT repo_key, count(*) AS total, count(*) FILTER (WHERE called) AS ncalled,
         bool_or(called AND (has_agent OR has_llm)) AS runs, sum(least(n_sites, 6))::BIGINT AS n_sites
  FROM pipes GROUP BY 1),
scored AS (
  SELECT e.*, CASE WHEN accessible THEN greatest(0.0::DOUBLE, coalesce(points, 0.0::DOUBLE)) ELSE 0.0::DOUBLE END AS score,
         CASE WHEN accessible THEN coalesce(ncalled, 0) ELSE 0 END AS pipelines_called,
         CASE WHEN accessible THEN coalesce(total, 0) ELSE 0 END AS pipelines_total,
         CASE WHEN accessible THEN coalesce(breakdown, '') ELSE '' END AS breakdown,
         coalesce(n_parts, 0) AS n_parts, coalesce(n_sites, 0) AS n_sites,
         CASE WHEN NOT accessible OR NOT (coalesce(runs, false) OR hosted OR engine) THEN 'No'
              WHEN list_has_any(other, ['les', 'que']) THEN 'Partial' ELSE 'Yes' END AS raw
  FROM evidence e LEFT JOIN summed USING (repo_key) LEFT JOIN counted USING (repo_key)),
tagged AS (
  SELECT *, CASE WHEN NOT accessible THEN 'None' WHEN scaffold_only AND pipelines_called = 0 THEN 'Less'
                 WHEN score >= 4 AND raw <> 'No' THEN 'Significant' WHEN score >= 2 THEN 'Moderate'
                 WHEN score >= 1 THEN 'Less' ELSE 'None' END AS tag FROM scored),
verdicts AS (
  SELECT *, CASE WHEN tag IN ('None', 'Less') THEN 'No' ELSE raw END AS backbone FROM tagged)"""

ORACLE["corpus_verdicts"] = f"""WITH {BREAKDOWN}
SELECT repo_key, tag, backbone, score, pipelines_called, pipelines_total, breakdown FROM verdicts"""

ORACLE["digest"] = f"""WITH {CORPUS},
dep AS (
  SELECT repo_key, count(*) AS n, string_agg(hit, '|' ORDER BY nth) FILTER (WHERE nth <= 20) AS hits
  FROM (SELECT repo_key, path || ': ' || trim(raw, {STRIP_CHARS}) AS hit,
               row_number() OVER (PARTITION BY repo_key ORDER BY rk, line) AS nth
        FROM (SELECT repo_key, rk, path, unnest(string_split(text, chr(10))) AS raw,
                     unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line
              FROM ranked WHERE kind = 'manifest')
        WHERE contains(lower(raw), 'license')) GROUP BY 1),
sig AS (
  SELECT repo_key, count(*) AS n, string_agg(path || ': ' || pattern, '|' ORDER BY nth) FILTER (WHERE nth <= 20) AS hits
  FROM (SELECT repo_key, path, pattern, row_number() OVER (PARTITION BY repo_key ORDER BY rk, pattern_no) AS nth
        FROM ranked JOIN {PATTERNS} ON kind = 'source' AND contains(lower(text), pattern))
  GROUP BY 1),
plat AS (SELECT repo_key, string_agg(DISTINCT p, '|' ORDER BY p) AS other
         FROM ranked JOIN {WORDS} ON kind <> 'definition' AND contains(lower(text), p) GROUP BY 1),
pf AS (SELECT repo_key, count(*) AS n, string_agg(path, '|' ORDER BY rk) FILTER (WHERE rk <= 12) AS files
       FROM ranked WHERE kind = 'definition' GROUP BY 1)
SELECT repo_key, 'main' AS default_branch, file_count, coalesce(files, '') AS pipe_files,
       coalesce(pf.n, 0) AS pipe_file_count, folder AS definitions_folder,
       coalesce(dep.hits, '') AS dependencies, coalesce(dep.n, 0) AS dependency_count,
       coalesce(sig.hits, '') AS source_signals, coalesce(sig.n, 0) AS signal_count,
       coalesce(other, '') AS other_platforms,
       scaffold AND dep.hits IS NULL AND sig.hits IS NULL AND files IS NULL AS scaffold_only,
       truncated AS tree_truncated
FROM repos LEFT JOIN dep USING (repo_key) LEFT JOIN sig USING (repo_key)
LEFT JOIN plat USING (repo_key) LEFT JOIN pf USING (repo_key)
WHERE status = 200 AND tree_status = 200"""

ORACLE["scaffold_repos"] = r"""
WITH p AS (
  SELECT regexp_extract(url, '^https?://([^/]+)', 1) || '/' || (page_id // 7) AS repo_key,
         regexp_extract(url, '^https?://[^/]+/(.*)$', 1) AS path FROM pages)
SELECT repo_key, count(*) AS file_count, count(*) FILTER (WHERE path LIKE '%#top') AS definitions,
       bool_or(path LIKE '%/') AND NOT bool_or(path LIKE '%#top') AS scaffold_only,
       CASE WHEN bool_or(path LIKE '%/') AND NOT bool_or(path LIKE '%#top') THEN 'Less' ELSE 'None' END AS tag
FROM p GROUP BY 1"""

# --- scalar functions ----------------------------------------------------------------------

PAGE_REPO = r"(?i)example\.(?:com|net|org)[/:]+([^/\s]+)/([^/\s#?]+)"

PAGE_KEY = f"""CASE WHEN regexp_matches(url, '{PAGE_REPO}')
  THEN regexp_replace(lower(regexp_extract(url, '{PAGE_REPO}', 1) || '/' || regexp_extract(url, '{PAGE_REPO}', 2)), '\\.git$', '')
  ELSE lower(url) END"""

ORACLE["repo_keys"] = f"""
SELECT page_id, {PAGE_KEY} AS repo_key, regexp_extract(url, '{PAGE_REPO}', 1) AS owner,
       regexp_replace(regexp_extract(url, '{PAGE_REPO}', 2), '\\.git$', '') AS name,
       NOT contains(lower(url), 'example.org') AS missing
FROM pages"""

ORACLE["name_keys"] = """
SELECT p_partkey, lower(regexp_replace(trim(p_name || '  ' || p_type || ' ' || p_brand), '\\s+', ' ', 'g'))
       AS name_key FROM part"""

ORACLE["header_keys"] = """
SELECT doc_id, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS header_md5 FROM documents"""

ORACLE["link_extract"] = r"""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN url
       ELSE CASE WHEN regexp_matches(bare, 'example\.(com|net|org)/') OR page_id % 3 = 1 THEN
         CASE WHEN page_id % 3 = 1 THEN 'https://WWW.' || bare
              ELSE 'https://' || regexp_extract(bare, '(?:www\.|example\.(?:com|net|org)/)\S+') END END END AS link
FROM (SELECT page_id, url, regexp_replace(url, '^https?://', '') AS bare FROM pages)"""

# --- results -------------------------------------------------------------------------------

MEMBERS = f"""
rows AS (SELECT page_id AS ord, 'p' || (page_id % 7) AS project, {PAGE_KEY} AS repo_key,
                CASE WHEN page_id % 2 = 0 THEN 'seen' ELSE '' END AS notes FROM pages),
sizes AS (SELECT repo_key, count(*) AS n FROM rows GROUP BY 1 HAVING count(*) > 1)"""

ORACLE["duplicate_members"] = f"""WITH {MEMBERS}
SELECT repo_key, ord, project, n FROM rows JOIN sizes USING (repo_key)"""

ORACLE["duplicate_notes"] = f"""WITH {MEMBERS},
notes AS (
  SELECT ord, 'duplicate repo (' || n || ' rows share ' || repo_key || ')' AS note
  FROM rows JOIN sizes USING (repo_key))
SELECT ord, project, CASE WHEN note IS NULL THEN notes ELSE trim(notes || '; ' || note, '; ') END AS notes
FROM rows LEFT JOIN notes USING (ord)"""

NO_REPO_NOTE, NO_REPO_WHY = (quoted(t) for t in S.with_(title="Acme").route_texts["no_repo"])


def route_sql(title: str) -> str:
    """CASE expressions for notes and justification of rows that are not evaluated."""
    spec = S.with_(title=title)
    texts = spec.route_texts

    def fill(text: str, value: str) -> str:
        return "||".join(quoted(p) for p in [text]).replace("%s", f"' || {value} || '")

    shown = "CASE WHEN route = 'unparseable' THEN '?' ELSE coalesce(status::VARCHAR, 'None') END"
    tree = "'tree fetch failed (HTTP ' || coalesce(tree_status::VARCHAR, 'None') || ')'"
    parts = []
    for i in (0, 1):
        parts.append(
            f"""CASE WHEN route = 'no_repo' THEN {quoted(texts['no_repo'][i])}
            WHEN route IN ('inaccessible', 'unparseable') THEN {fill(texts['inaccessible'][i], shown)}
            WHEN route = 'incomplete' THEN {fill(texts['incomplete'][i], tree)} END"""
        )
    return f"{parts[0]} AS route_notes, {parts[1]} AS route_why"


ROUTE = r"""CASE WHEN NOT contains(lower(github), 'github.com') THEN 'no_repo'
  WHEN NOT regexp_matches(github, '(?i)github\.com[/:]+([^/\s]+)/([^/\s#?]+)') THEN 'unparseable'
  WHEN status IS DISTINCT FROM 200 THEN 'inaccessible'
  WHEN tree_status IS DISTINCT FROM 200 THEN 'incomplete' ELSE 'evaluate' END"""

ROUTED = f"""
subs AS (
  SELECT o_orderkey AS ord, 'order ' || o_orderkey AS project, '' AS names, '' AS emails,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'tbd' WHEN '2-HIGH' THEN 'github.com/' || o_custkey
              ELSE 'git@github.com:Cust' || o_custkey || '/Repo?tab=1' END AS github,
         o_orderpriority AS feedback, o_custkey FROM orders),
access AS (
  SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 404 WHEN c_nationkey < 8 THEN NULL ELSE 200 END AS status,
         CASE WHEN c_nationkey < 12 THEN 409 ELSE 200 END AS tree_status FROM customer),
routed AS (
  SELECT *, {ROUTE} AS route FROM subs LEFT JOIN access
  ON c_custkey = o_custkey AND feedback NOT IN ('1-URGENT', '2-HIGH')),
noted AS (SELECT *, {route_sql("Acme")},
                 CASE WHEN route = 'evaluate' THEN true WHEN route <> 'incomplete' THEN false END AS repo_accessible
          FROM routed)"""

ORACLE["access_routing"] = f"""WITH {ROUTED}
SELECT ord, route, repo_accessible, route_notes AS notes, route_why AS justification FROM noted"""

ORACLE["failed_rows"] = f"""WITH {ROUTED}
SELECT ord, project, names, emails, github, feedback FROM noted WHERE repo_accessible IS NOT TRUE"""

ORACLE["resubmission"] = f"""WITH {ROUTED}
SELECT project, github, feedback FROM noted WHERE repo_accessible IS NOT TRUE"""

ORACLE["needs_rerun"] = f"""WITH {ROUTED}
SELECT c_custkey AS customer FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM noted WHERE repo_accessible)"""

ORACLE["default_names"] = """
SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 4 = 0 THEN 'order ' || o_orderkey
       WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN ' ' ELSE 'Repo' END AS project
FROM orders"""

REPLIES = """
replies AS (
  SELECT conv_id AS ord, turn + 1 AS attempt, turn, text,
         '{"description":"about ' || role || '","license_usage":"turn ' || turn || '","more":{"x":1}}' AS good,
         'about ' || role AS description, 'turn ' || turn AS usage
  FROM conversations),
prose AS (
  SELECT ord, min_by(description, attempt) AS description, min_by(usage, attempt) AS usage,
         '' AS justification
  FROM replies WHERE turn % 4 <> 0 GROUP BY 1)"""

ORACLE["reply_objects"] = f"""WITH {REPLIES}
SELECT ord, attempt, CASE WHEN turn % 4 <> 0 THEN good END AS last_object,
       CASE WHEN turn % 4 = 3 THEN good END AS simple_object,
       CASE WHEN turn % 4 = 3 THEN good END AS verdict_object FROM replies"""

ORACLE["reply_prose"] = f"WITH {REPLIES} SELECT * FROM prose"

RESULTS = rf"""{BREAKDOWN}, {REPLIES},
subs AS (
  SELECT c_custkey AS ord, 'Team ' || (c_custkey // 3) AS project, c_name AS names,
         CASE WHEN c_nationkey % 2 = 0 THEN 'a@b.example' ELSE '' END AS emails,
         CASE WHEN c_nationkey = 7 THEN 'n/a' WHEN c_nationkey = 8 THEN 'https://github.com/solo'
              WHEN c_nationkey = 9 THEN 'https://github.com/nobody/r0'
              ELSE 'https://GitHub.com/src' || (c_custkey % 20) || '/r' || ((c_custkey // 20) % ranges) || '.git' END AS github,
         CASE WHEN c_nationkey = 7 THEN NULL WHEN c_nationkey = 8 THEN 'https://github.com/solo'
              WHEN c_nationkey = 9 THEN 'nobody/r0'
              ELSE 'src' || (c_custkey % 20) || '/r' || ((c_custkey // 20) % ranges) END AS repo_key,
         CASE WHEN c_nationkey = 1 THEN 'www.demo.example/x).' ELSE '' END AS demo, '' AS deployed,
         c_mktsegment AS feedback
  FROM customer, (SELECT max(doc_id // 2000) + 1 AS ranges FROM documents)),
routed AS (SELECT *, {ROUTE} AS route FROM subs LEFT JOIN verdicts USING (repo_key)),
lines AS (
  SELECT repo_key, string_agg(path || ' — ' || nodes || ' nodes (' ||
           CASE WHEN nodes >= 9 THEN 'high' WHEN nodes >= 4 THEN 'medium' ELSE 'low' END || '), ' ||
           CASE WHEN has_agent THEN 'agent' ELSE 'no agent' END || ' — ' ||
           CASE WHEN called AND shown <> '' THEN 'CALLED @ ' || shown WHEN called THEN 'CALLED'
                ELSE 'NOT called (present for show)' END, chr(10) ORDER BY rk) AS text,
         string_agg(path || ':' || nodes || ':' || called, '|' ORDER BY rk) FILTER (WHERE rk <= 8) AS digest
  FROM pipes GROUP BY 1),
noted AS (
  SELECT r.*, {route_sql("License")}, p.description AS d, p.usage AS u, p.ord IS NULL AS silent,
         'Deterministic score ' || printf('%.1f', score) || ' -> ' || tag || ' / backbone ' || backbone || '; '
           || pipelines_called || '/' || pipelines_total || ' pipeline(s) called.' AS vnote,
         lines.text AS def_lines, lines.digest
  FROM routed r LEFT JOIN prose p USING (ord) LEFT JOIN lines ON lines.repo_key = r.repo_key),
groups AS (SELECT repo_key, count(*) AS n FROM subs WHERE repo_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
dup AS (
  SELECT ord, 'duplicate repo (' || n || ' rows share ' || repo_key || ')' AS text
  FROM subs JOIN groups USING (repo_key)),
final AS (
  SELECT noted.ord, project, names, emails, github, demo, deployed, route,
         CASE WHEN route = 'evaluate' THEN tag ELSE 'None' END AS f_tag,
         CASE WHEN route = 'evaluate' THEN backbone ELSE 'No' END AS f_backbone,
         CASE WHEN route = 'evaluate' THEN score ELSE 0.0::DOUBLE END AS f_score,
         CASE WHEN route = 'evaluate' THEN pipelines_called ELSE 0 END AS f_called,
         CASE WHEN route = 'evaluate' THEN pipelines_total ELSE 0 END AS f_total,
         CASE WHEN route = 'evaluate' THEN coalesce(d, '') ELSE '' END AS f_description,
         CASE WHEN route = 'evaluate' THEN coalesce(u, '') ELSE '' END AS f_usage,
         CASE WHEN route <> 'evaluate' THEN route_why
              WHEN silent THEN vnote || {quoted(S.PROSE_MISSING)} ELSE '' END AS f_why,
         CASE WHEN dup.text IS NULL THEN plain ELSE trim(plain || '; ' || dup.text, '; ') END AS f_notes,
         route = 'evaluate' AND silent AS explain_failed,
         CASE WHEN route = 'evaluate' THEN true WHEN route <> 'incomplete' THEN false END AS repo_accessible,
         CASE WHEN route = 'evaluate' THEN
           coalesce(def_lines || chr(10), '') || 'SDK: ' || callsites || ' call-site(s) across ' || spread || ' file(s)'
           || CASE WHEN hosted THEN ', hosted/Cloud usage' ELSE '' END
           || CASE WHEN len(other) > 0 THEN chr(10) || 'Other platforms in code: ' || array_to_string(other, ', ') ELSE '' END
           ELSE '' END AS f_evidence,
         CASE WHEN route = 'evaluate' THEN coalesce(digest, '') ELSE '' END AS f_digest
  FROM (SELECT *, CASE WHEN route <> 'evaluate' THEN route_notes
                       WHEN silent THEN vnote || {quoted(S.PROSE_PENDING)} ELSE vnote END AS plain FROM noted) noted
  LEFT JOIN dup USING (ord))"""

ORACLE["sheet_projection"] = f"""WITH {RESULTS}
SELECT ord, project AS project_name, CASE WHEN emails = '' THEN names ELSE names || ' / ' || emails END AS team_details,
       f_description AS description, f_usage AS usage, f_tag AS usage_tag, f_backbone AS backbone,
       github AS repo_link, f_notes AS notes, f_why AS justification, demo, deployed, f_score AS score,
       f_called || ' / ' || f_total AS called_total, f_evidence AS evidence
FROM final"""


def colour_case(column: str, colours: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in colours.items()
    ) + " END"


ORACLE["public_fields"] = f"""WITH {RESULTS}
SELECT ord, project, f_tag AS tag, f_backbone AS backbone, f_usage AS license_usage, repo_accessible,
       explain_failed, CASE f_backbone WHEN 'Yes' THEN 'none,none,license,license,none'
         WHEN 'Partial' THEN 'none,none,license,other,none' ELSE 'none,none,none,none,none' END AS layers,
       f_digest AS digest, {colour_case("f_tag", TAG_COLOURS)} AS tag_colour,
       {colour_case("f_backbone", BACKBONE_COLOURS)} AS backbone_colour
FROM final"""

ORACLE["explanation_requests"] = f"""WITH {RESULTS}
SELECT ord, project, feedback, tag, backbone, score, n_parts AS parts, n_sites AS sites, callsites,
       array_to_string(other, '|') AS other_platforms
FROM routed WHERE route = 'evaluate'"""

ORACLE["result_lines"] = f"""WITH {RESULTS}
SELECT project, github, f_tag AS tag, f_score AS score, repo_accessible, demo,
       CASE WHEN f_backbone IN ('Yes', 'Partial') THEN 'license' ELSE 'none' END AS orchestration,
       CASE f_backbone WHEN 'Yes' THEN 'license' WHEN 'Partial' THEN 'other' ELSE 'none' END AS reasoning
FROM final"""

UPSERT = r"""
WITH sheet AS (
  SELECT c_custkey + 2 AS row_no, CASE WHEN c_nationkey = 3 THEN '' ELSE ' Cust  ' || (c_custkey // 2) END AS project_name,
         CASE WHEN c_nationkey = 5 THEN 'none' ELSE 'https://github.com/o/R' || (c_custkey // 4) END AS repo_link,
         c_mktsegment AS notes, c_acctbal AS score FROM customer),
chg AS (
  SELECT o_orderkey AS ord, CASE o_orderstatus WHEN 'F' THEN 'cust ' || (o_custkey // 2)
           WHEN 'O' THEN 'new ' || (o_custkey % 50) ELSE '' END AS project_name,
         CASE WHEN o_orderpriority < '4' THEN 'github.com/O/r' || (o_custkey // 3) || '.git' ELSE '-' END AS repo_link,
         o_orderpriority AS notes, o_totalprice AS score FROM orders),
by_name AS (
  SELECT regexp_replace(lower(trim(project_name)), '\s+', ' ', 'g') AS k, max(row_no) AS row_no
  FROM sheet WHERE project_name <> '' GROUP BY 1),
by_repo AS (
  SELECT lower(regexp_extract(repo_link, 'github\.com/(.*)', 1)) AS k, max(row_no) AS row_no
  FROM sheet WHERE contains(repo_link, 'github.com') GROUP BY 1),
matched AS (
  SELECT chg.*, coalesce(n.row_no, r.row_no) AS target FROM chg
  LEFT JOIN by_name n ON n.k = regexp_replace(lower(trim(project_name)), '\s+', ' ', 'g')
  LEFT JOIN by_repo r ON r.k = regexp_replace(lower(regexp_extract(repo_link, 'github\.com/(.*)', 1)), '\.git$', '')
    AND contains(repo_link, 'github.com')),
last AS (SELECT * FROM matched WHERE target IS NOT NULL
         QUALIFY row_number() OVER (PARTITION BY target ORDER BY ord DESC) = 1)
SELECT s.row_no, CASE WHEN l.ord IS NULL THEN s.project_name ELSE l.project_name END AS project_name,
       CASE WHEN l.ord IS NULL THEN s.repo_link ELSE l.repo_link END AS repo_link,
       CASE WHEN l.ord IS NULL THEN s.notes ELSE l.notes END AS notes,
       CASE WHEN l.ord IS NULL THEN s.score ELSE l.score END AS score
FROM sheet s LEFT JOIN last l ON l.target = s.row_no
UNION ALL
SELECT (SELECT max(row_no) FROM sheet) + row_number() OVER (ORDER BY ord), project_name, repo_link, notes, score
FROM matched WHERE target IS NULL"""

ORACLE["upsert_merge"] = UPSERT


def _upsert_batches(batches: int) -> str:
    """The upsert batch by batch: each meets the sheet as the ones before left it."""
    name = r"regexp_replace(lower(trim(project_name)), '\s+', ' ', 'g')"
    repo = r"regexp_replace(lower(regexp_extract(repo_link, 'github\.com/(.*)', 1)), '\.git$', '')"
    parts = [UPSERT[UPSERT.index("sheet AS (") : UPSERT.index("by_name AS (")].rstrip().rstrip(",").replace("sheet AS (", "s0 AS MATERIALIZED (", 1)]
    for b in range(batches):
        parts.append(
            f"""n{b} AS (SELECT {name} AS k, max(row_no) AS row_no FROM s{b} WHERE project_name <> '' GROUP BY 1),
r{b} AS (SELECT {repo} AS k, max(row_no) AS row_no FROM s{b} WHERE contains(repo_link, 'github.com') GROUP BY 1),
m{b} AS MATERIALIZED (
  SELECT c.*, coalesce(n.row_no, r.row_no) AS target
  FROM (SELECT *, {name} AS nk, CASE WHEN contains(repo_link, 'github.com') THEN {repo} END AS rk FROM chg WHERE ord % {batches} = {b}) c
  LEFT JOIN n{b} n ON n.k = nk LEFT JOIN r{b} r ON r.k = rk),
l{b} AS MATERIALIZED (SELECT * FROM m{b} WHERE target IS NOT NULL QUALIFY row_number() OVER (PARTITION BY target ORDER BY ord DESC) = 1),
s{b + 1} AS MATERIALIZED (
  SELECT * FROM s{b} WHERE row_no NOT IN (SELECT target FROM l{b})
  UNION ALL SELECT target, project_name, repo_link, notes, score FROM l{b}
  UNION ALL SELECT (SELECT max(row_no) FROM s{b}) + row_number() OVER (ORDER BY ord), project_name, repo_link, notes, score
  FROM m{b} WHERE target IS NULL)"""
        )
    return f"WITH {', '.join(parts)} SELECT * FROM s{batches}"


ORACLE["stream_upsert"] = _upsert_batches(4)

# --- sheets --------------------------------------------------------------------------------

ORACLE["column_resolver"] = """
SELECT 's' || c_nationkey AS sheet_id, c_custkey + 2 AS row_no,
       CASE WHEN c_nationkey % 4 = 2 THEN c_mktsegment ELSE c_name END AS project,
       CASE WHEN c_nationkey % 4 IN (0, 1) THEN c_name ELSE '' END AS names,
       CASE WHEN c_nationkey % 4 IN (0, 1) THEN c_name || '@x.example' ELSE '' END AS emails,
       'https://github.com/O/' || c_custkey AS github,
       CASE WHEN c_nationkey % 4 = 0 THEN c_mktsegment ELSE '' END AS feedback,
       '' AS demo, '' AS deployed
FROM customer"""

ORACLE["column_profile"] = """
WITH d AS (
  SELECT 's' || c_nationkey AS sheet_id, c_nationkey % 4 AS l, c_custkey::VARCHAR AS num, c_name AS nm,
         c_name || '@x.example' AS mail, 'https://github.com/O/' || c_custkey AS repo, c_mktsegment AS txt
  FROM customer),
data AS (
  SELECT sheet_id, CASE l WHEN 0 THEN [nm, nm, mail, repo, txt] WHEN 1 THEN [num, nm, mail, repo, txt]
                          WHEN 2 THEN [num, txt, repo, mail] ELSE [num, txt, nm, repo, ''] END AS cells FROM d),
heads AS (
  SELECT DISTINCT 's' || c_nationkey AS sheet_id, CASE c_nationkey % 4 WHEN 2 THEN ['x', 'x', 'x', 'x']
    ELSE ['x', 'x', 'x', 'x', 'x'] END AS cells FROM customer
  UNION ALL SELECT DISTINCT 's' || c_nationkey, ['x'] FROM customer),
-- headers are plain text except '#', which is filled and no number
cells AS (
  SELECT sheet_id, unnest(range(0, len(cells))) AS col_no, unnest(cells) AS v
  FROM (SELECT * FROM data UNION ALL SELECT * FROM heads))
SELECT sheet_id, col_no, count(*) AS rows, count(*) FILTER (WHERE v <> '') AS filled,
       count(*) FILTER (WHERE contains(v, 'github.com')) AS repo_links,
       count(*) FILTER (WHERE v LIKE 'http%') AS links, count(*) FILTER (WHERE v LIKE '%@%') AS emails,
       count(*) FILTER (WHERE regexp_matches(v, '^[0-9]+$')) AS numbers
FROM cells GROUP BY 1, 2"""

ORACLE["csv_scan"] = f"""
SELECT lang, row_number() OVER (PARTITION BY lang, doc_id // 2000 ORDER BY doc_id) AS row_no, 'Doc ' || doc_id AS project,
       source AS names, lang || '@x.example' AS emails,
       'https://github.com/' || source || '/d' || doc_id AS github, '' AS demo, '' AS deployed,
       md5(trim(text, {STRIP_CHARS})) AS feedback_md5
FROM documents"""

ORACLE["csv_ranges"] = ORACLE["csv_scan"]

ORACLE["attached_replies"] = """
SELECT 'order ' || o_orderkey AS project, 'https://github.com/o/r' || o_custkey AS github,
       o_orderpriority AS feedback, CASE WHEN o_orderpriority < '3' THEN 'order ' || o_orderkey END AS description
FROM orders"""

ORACLE["sheet_inventory"] = """
SELECT 'good' AS kind, count(*) AS rows, 'loaded' AS reason FROM customer WHERE c_nationkey NOT IN (10, 11, 12)
UNION ALL SELECT 'unmappable', 0, 'no repo column and label column found'
UNION ALL SELECT 'wide', 0, 'more than 8 columns'
UNION ALL SELECT 'foreign', 0, 'not a CSV file'"""

ORACLE["old_encoding_sheet"] = """
SELECT 'Caf\u00e9 \u2013 \u20ac ' || c_custkey AS project, 'github.com/o/r' || c_custkey AS github FROM customer"""

ORACLE["limited_load"] = """
SELECT 'order ' || o_orderkey AS project, 'github.com/o/r' || o_custkey AS github
FROM orders ORDER BY o_orderkey LIMIT 100"""

ORACLE["snapshot_scan"] = f"""WITH {CORPUS}
SELECT repo_key, status::BIGINT AS status, tree_status::BIGINT AS tree_status, truncated AS tree_truncated,
       file_count AS paths, last, characters
FROM repos JOIN (
  SELECT repo_key, max(doc_id) AS last, sum(length(CASE WHEN d >= 2 THEN text ELSE
    '{{"components":[' || array_to_string(list_transform(range(1, n_chars % 13 + 1), lambda i:
      '{{"id":"' || i || '","provider":"' || ['agent_x', 'llm_y', 'tool_z', 'webhook'][(i + doc_id) % 4 + 1] || '"}}'), ',')
    || '],"project_id":"' || source || '"}}' || CASE WHEN n_chars % 17 = 0 THEN '{{' ELSE '' END END))::BIGINT AS characters
  FROM paths_of_docs GROUP BY 1) USING (repo_key)""".replace("paths_of_docs", "docs")

ORACLE["clustered_scan"] = f"""WITH scan AS ({ORACLE["snapshot_scan"]}), ranges AS (SELECT max(doc_id // 2000) + 1 AS n FROM documents),
sent AS (SELECT DISTINCT 'src' || (c_custkey % 20) || '/r' || ((c_custkey // 20) % n) AS repo_key
         FROM customer, ranges WHERE c_nationkey NOT IN (7, 8, 9))
SELECT scan.* FROM scan SEMI JOIN sent USING (repo_key)"""

ORACLE["clustered_verification"] = ORACLE["sheet_projection"]

ORACLE["written_sheet"] = f"""WITH {RESULTS}
SELECT row_number() OVER (ORDER BY ord) AS row_no, project AS project_name, github AS repo_link,
       f_tag AS usage_tag, f_backbone AS backbone, f_score AS score
FROM final"""

ORACLE["ordered_cases"] = """
WITH c AS (
  SELECT s_name AS name, s_suppkey AS n, s_suppkey % 5 <> 4 AS open,
         CASE WHEN s_suppkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
         + CASE WHEN s_suppkey % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
         + CASE WHEN s_suppkey >= 3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END
         + CASE WHEN s_suppkey % 4 >= 2 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS points FROM supplier),
s AS (
  SELECT *, CASE WHEN open THEN points ELSE 0.0::DOUBLE END AS score,
         CASE WHEN NOT open OR NOT (n % 3 = 0 OR n % 8 = 5) THEN 'No'
              WHEN n % 7 = 0 THEN 'Partial' ELSE 'Yes' END AS raw FROM c),
t AS (
  SELECT *, CASE WHEN NOT open OR n % 6 = 2 THEN 'None' WHEN n % 4 = 1 THEN 'Less'
                 WHEN score >= 4 AND raw <> 'No' THEN 'Significant' WHEN score >= 2 THEN 'Moderate'
                 WHEN score >= 1 THEN 'Less' ELSE 'None' END AS tag FROM s)
SELECT row_number() OVER (ORDER BY n) AS place, name, tag, CASE WHEN tag IN ('None', 'Less') THEN 'No' ELSE raw END AS backbone, score FROM t"""

# --- streams -------------------------------------------------------------------------------

HAS_VERDICT = """(contains(props, '"k": 1') OR contains(props, '"k": 7') OR contains(props, 'Significant'))"""

ORACLE["stream_counts"] = f"""
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE {HAS_VERDICT}) AS verdicts
FROM events GROUP BY 1"""

ORACLE["stream_running_counts"] = """
WITH r AS (
  SELECT CASE WHEN failed OR event_id % 3 <> 0 THEN 'None' ELSE 'Moderate' END AS tag,
         CASE WHEN failed THEN 'No' WHEN event_id % 5 = 0 THEN 'Yes' ELSE '?' END AS backbone,
         failed, event_id % 11 <> 0 AND event_id % 7 <> 0 AS through
  FROM (SELECT *, event_type IN ('error', 'signup') AS failed FROM events WHERE event_type <> 'view'))
SELECT 'tag' AS facet, tag AS value, count(*) AS n FROM r GROUP BY 1, 2
UNION ALL SELECT 'backbone', backbone, count(*) FROM r GROUP BY 1, 2
UNION ALL SELECT 'review_group', CASE WHEN failed OR NOT through THEN 'review' ELSE backbone END, count(*)
FROM r GROUP BY 1, 2"""

ORACLE["stream_results"] = """
SELECT CASE WHEN failed OR event_id % 3 <> 0 THEN 'None' ELSE 'Moderate' END AS tag,
       CASE WHEN failed THEN 'No' WHEN event_id % 5 = 0 THEN 'Yes' ELSE '?' END AS backbone,
       count(*) AS n, count(*) FILTER (WHERE failed) AS failed
FROM (SELECT *, event_type IN ('error', 'signup') AS failed FROM events WHERE event_type <> 'view')
GROUP BY 1, 2"""

ORACLE["stream_latest_counts"] = """
WITH e AS (
  SELECT *, user_id AS run, event_id % 10 AS idx FROM events WHERE event_type <> 'view'),
named AS (
  SELECT event_id, event_type FROM e WHERE event_type <> 'signup'
  QUALIFY row_number() OVER (PARTITION BY run, idx ORDER BY event_id DESC) = 1),
r AS (
  SELECT CASE WHEN failed OR event_id % 3 <> 0 THEN 'None' ELSE 'Moderate' END AS tag,
         CASE WHEN failed THEN 'No' WHEN event_id % 5 = 0 THEN 'Yes' ELSE '?' END AS backbone,
         failed, event_id % 11 <> 0 AND event_id % 7 <> 0 AS through
  FROM (SELECT event_id, event_type = 'error' AS failed FROM named
        UNION ALL SELECT event_id, true FROM e WHERE event_type = 'signup'))
SELECT 'tag' AS facet, tag AS value, count(*) AS n FROM r GROUP BY 1, 2
UNION ALL SELECT 'backbone', backbone, count(*) FROM r GROUP BY 1, 2
UNION ALL SELECT 'review_group', CASE WHEN failed OR NOT through THEN 'review' ELSE backbone END, count(*)
FROM r GROUP BY 1, 2"""

ORACLE["stream_exact_progress"] = """
SELECT user_id AS run_id, max(regexp_extract(props, '"k": (\\d+)', 1)::BIGINT) AS total,
       count(DISTINCT event_id % 10) FILTER (WHERE event_type IN ('purchase', 'error')) AS results,
       count(DISTINCT event_id % 10) FILTER (WHERE event_type IN ('purchase', 'error'))
         >= max(regexp_extract(props, '"k": (\\d+)', 1)::BIGINT) AS done
FROM events GROUP BY 1"""

ORACLE["stream_latest"] = """
SELECT user_id AS run_id, event_id % 10 AS idx, max(event_id) AS seq,
       arg_max(event_type, event_id) AS event, arg_max(value, event_id) AS value
FROM events GROUP BY 1, 2"""

ORACLE["stream_progress"] = """
SELECT user_id AS run_id, max(regexp_extract(props, '"k": (\\d+)', 1)::BIGINT) AS total,
       count(*) FILTER (WHERE event_type IN ('purchase', 'error')) AS results,
       count(*) FILTER (WHERE event_type IN ('purchase', 'error'))
         >= max(regexp_extract(props, '"k": (\\d+)', 1)::BIGINT) AS done
FROM events GROUP BY 1"""

ORACLE["stream_monitor"] = f"""
SELECT time_bucket(INTERVAL '150 seconds', ts, TIMESTAMP '1970-01-01 00:00:00') AS window_start,
       event_type AS event, count(*) AS n, count(*) FILTER (WHERE {HAS_VERDICT}) AS verdicts
FROM events GROUP BY 1, 2"""
